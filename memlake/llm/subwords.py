"""Subword ids of whole texts with a public tokenizer, encoding each distinct unit once.

Units are a run of blanks and the word after it (the word alone where the vocabulary drops
white space). Neither of the two vocabularies joins anything across the place where a word
ends and a blank begins, so a text's ids are its units' ids in a row. Nor do they join letters
and the marks after them: a plain word and its marks are two units, so a word is encoded once
whatever follows it, and goes straight to the tokenizer's model. Other units go through the
whole tokenizer, and the few texts that hold white space whose class is in doubt are encoded
whole. Tests compare all of it with the plain call.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Marks after a plain word; they don't begin with an apostrophe.
MARKS = r"[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*"
MARK_CHARS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
END = r"(?=[ \n]|\Z)"
#: A plain word, the marks after one, and all else up to the next blank.
UNIT = re.compile(rf" ?[{LETTERS}]+(?=(?:{MARKS})?(?:[ \n]|\Z))|(?<=[{LETTERS}]){MARKS}{END}|[ \n]*[^ \n]+|[ \n]+")
WORD_UNIT = re.compile(rf"[{LETTERS}]+(?=(?:{MARKS})?(?:[ \n]|\Z))|(?<=[{LETTERS}]){MARKS}{END}|[^ \n]+")
#: White space other than blank and newline, in any reading of the term.
DOUBTFUL = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Beyond so many units or characters the cache becomes the older one of two, and the one before
#: it goes. Units in use move to the younger, so common ones stay; both take some 160 MB.
MAX_UNITS, MAX_CHARS = 400_000, 6_000_000
PLAIN = re.compile(rf"( ?)([{LETTERS}]+)")


class Cache:
    """Ids of units in one growing array; unit k has those from starts[k] to starts[k + 1]."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.chars, self.size, self.flat_size = 0, 0, 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)

    def add(self, units: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        k, n = self.size, len(units)
        while k + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.flat_size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.flat_size:self.flat_size + len(ids)] = ids
        self.starts[k + 1:k + n + 1] = self.flat_size + np.cumsum(counts)
        self.codes.update(zip(units, range(k, k + n)))
        self.size, self.flat_size = k + n, self.flat_size + len(ids)
        self.chars += sum(map(len, units))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in a row, and the count of each."""
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        places = np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[places], counts


class Subwords:
    """``encode(texts)`` gives all ids in a row (uint32) and the count of each text."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.lowers = self.tokenizer.normalizer is not None  # that vocabulary drops blanks, too
        self.split = (WORD_UNIT if self.lowers else UNIT).findall
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark_id = min(added)
        self.mark = added[self.mark_id].content
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [32, *range(0xAA, 0x100)]}
        self.young, self.old = Cache(), Cache()

    def _whole(self, units: list[str]) -> list[list[int]]:
        """Through the whole tokenizer in one call, with a special token between units."""
        if any(self.mark in u for u in units):
            return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        out: list[list[int]] = [[]]
        for i in self.tokenizer.encode_batch_fast([self.mark.join(units)], add_special_tokens=False)[0].ids:
            if i == self.mark_id:
                out.append([])
            else:
                out[-1].append(i)
        return out

    def _add(self, units: list[str]) -> None:
        lists: list[list[int] | None] = []
        tokenize, plain, odd = self.model.tokenize, PLAIN.fullmatch, []
        lowers, blank, table = self.lowers, self.bytes[32], self.bytes
        for k, u in enumerate(units):
            if u.isascii() and (u[1:] if u[0] == " " and not lowers else u).isalpha():  # the commonest kind
                lists.append([t.id for t in tokenize(u.lower() if lowers else u.replace(" ", blank))])
            elif m := plain(u):
                lead, core = m.groups()
                word = core.lower() if lowers else blank + core if lead else core
                lists.append([t.id for t in tokenize(word if core.isascii() else word.translate(table))])
            else:
                odd.append(k)
                lists.append(None)
        for i in range(0, len(odd), 20_000):
            for k, ids in zip(odd[i:i + 20_000], self._whole([units[k] for k in odd[i:i + 20_000]])):
                lists[k] = ids
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.young.add(units, np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts)

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and the count of each unit."""
        if self.young.size > MAX_UNITS or self.young.chars > MAX_CHARS:
            self.young, self.old = Cache(), self.young
        codes = self.young.codes
        at = np.fromiter(map(codes.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            fresh = list({units[k] for k in new})
            before = np.fromiter(map(self.old.codes.get, fresh, repeat(-1)), np.int64, len(fresh))
            known = np.flatnonzero(before >= 0)
            self.young.add([fresh[k] for k in known.tolist()], *self.old.take(before[known]))
            gc.disable()  # many small lists, none in a cycle
            try:
                self._add([fresh[k] for k in np.flatnonzero(before < 0).tolist()])
            finally:
                gc.enable()
            at[new] = [codes[units[k]] for k in new]
        return self.young.take(at)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts of one word each, whose parts are mostly told without a pattern."""
        units, cuts, odd = [], [0], []
        for k, w in enumerate(words):
            if w.isascii() and w.isalpha():
                units.append(w)
            elif w.isascii() and (core := w.rstrip(MARK_CHARS)).isalpha() and w[len(core)] != "'":
                units += (core, w[len(core):])
            else:
                odd.append(k)
            cuts.append(len(units))
        ids, counts = self._units(units)
        sums = np.concatenate([[0], np.cumsum(counts)])[np.array(cuts)]
        if not odd:
            return ids, np.diff(sums)
        lengths = np.diff(sums)
        rest, own = self.encode([words[k] for k in odd])
        lengths[odd] = own
        ends = np.cumsum(lengths)
        out = np.empty(ends[-1], np.uint32)
        of_odd = np.zeros(len(words), bool)
        of_odd[odd] = True
        which = np.repeat(of_odd, lengths)
        out[which], out[~which] = rest, ids
        return out, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        units: list[str] = []
        cuts = [0]
        whole: list[tuple[int, np.ndarray]] = []
        for k, text in enumerate(texts):
            if DOUBTFUL.search(text):
                whole.append((k, np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)))
            else:
                units += self.split(text)
            cuts.append(len(units))
        ids, counts = self._units(units)
        sums = np.concatenate([[0], np.cumsum(counts)])[np.array(cuts)]
        if not whole:
            return ids, np.diff(sums)
        pieces = [ids[a:b] for a, b in zip(sums[:-1], sums[1:])]
        for k, own in whole:
            pieces[k] = own
        return np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)


@lru_cache(maxsize=2)
def subwords(file: str) -> Subwords:
    """One per Python worker and vocabulary file."""
    return Subwords(file)


def release() -> None:
    """Frees the subwords that a Python worker holds, for tasks that go on without them: Spark
    gives one worker to the operators in turn."""
    if subwords.cache_info().currsize:
        subwords.cache_clear()
        gc.collect()


def parcels(texts: list[str], chars: int = 1_000_000):
    """(from, to) of runs of texts of about ``chars`` characters: what is held at once."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
