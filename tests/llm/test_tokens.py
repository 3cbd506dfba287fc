"""Subword caching, Simple-8b, token files and packing: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from memlake.llm import packing, simple8b, subwords as sw, token_files

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ALPHABET = "abcTHE'sé.,!?  \n\t\u00a0\x1c\u2003\u0301ß😀1٣\r\u200b<|endoftext|>"


def plain(file, texts):
    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(file)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("file", FILES)
def test_cached_ids_equal_the_plain_call(file, monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "\n\n", "a  b", " lead", "trail ", "x\n y", "it's  they'll", "<|endoftext|> in <|startoftext|>text"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    encoder = sw.Subwords(public_tokenizers.path(file))
    monkeypatch.setattr(sw, "MAX_UNITS", 500)  # emptied again and again
    for i in range(0, len(texts), 100):
        ids, counts = encoder.encode(texts[i:i + 100])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain(file, texts[i:i + 100])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49_407), st.integers(0, 2**32 - 1)), max_size=300), st.integers(1, 60))
def test_simple8b_round_trip(values, times):
    ids = np.array(values * times, np.uint32)
    words, firsts = simple8b.pack(ids)
    assert len(firsts) == -(-len(ids) // simple8b.BLOCK)
    assert (simple8b.unpack_blocks(words, firsts, len(ids)) == ids).all()


def test_simple8b_words_hold_what_fits():
    words, _ = simple8b.pack(np.zeros(60, np.uint32))
    assert len(words) == 1
    words, _ = simple8b.pack(np.array([2**32 - 1, 5, 5], np.uint32))
    assert len(words) == 2 and int(words[0]) >> 60 == 0  # an escape, then a packed word


def test_token_files(odd, empty):
    vocabulary = public_tokenizers.path(FILES[0])
    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    ids = [x + [2] for x in plain(FILES[0], [r.text or "" for r in rows])]
    got = token_files.token_report(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), vocabulary).orderBy("doc_id").collect()
    start = 0
    for r, own, g in zip(rows, ids, got, strict=True):
        assert tuple(g) == (r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    whole = token_files.token_report(odd, vocabulary).collect()
    spans = sorted((r.start, r.n_tokens) for r in whole)
    assert len(whole) == odd.count() and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert token_files.token_report(empty, vocabulary).count() == 0


def test_packing(odd, empty):
    vocabulary = public_tokenizers.path(FILES[1])
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = docs.collect()
    ids = {r.doc_id: x + [2] for r, x in zip(rows, plain(FILES[1], [r.text or "" for r in rows]))}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in packing.pack(docs, vocabulary).collect():
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for doc_id, own in ids.items():
        ps = sorted(by_doc[doc_id], key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(-(-len(own) // 1024))) and all(p.length == 1024 for p in ps[1:])
        assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]] and sum(p.length for p in ps) == len(own)
        assert all(p.ids_crc32 == zlib.crc32(np.array(own[p.start:p.start + p.length], "<u4").tobytes()) for p in ps)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(odd, vocabulary).where("piece = 0").count() == odd.count()
    assert packing.pack(empty, vocabulary).count() == 0


def test_best_fit_closes_the_fullest():
    p = packing.Packer(10, open_bins=2)
    assert [p.place(n) for n in (6, 7, 3, 8, 4, 2, 10)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 8), (3, 0)]
    q = packing.Packer(10, open_bins=1)
    assert [q.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0)]  # bin 0 closed when bin 1 opened


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.geometric(1 / 300, 20_000), 1023)
    bins, _ = packing.pack_lengths(lengths.tolist(), packing.Packer())
    assert len(set(bins.tolist())) < 1.03 * lengths.sum() / 1024


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_alone_equal_texts_of_one_word(name):
    encoder = sw.Subwords(public_tokenizers.path(name))
    words = ["plain", "Marks!?", "don't", "x'", "'x", "a.b", "...", "é", "Straße,", "日本", "a\u00a0b", "A1", "x" * 3000, "&amp;", "end's.", "plain"]
    ids, counts = encoder.encode_words(words)
    want = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert encoder.encode_words([])[1].tolist() == []
