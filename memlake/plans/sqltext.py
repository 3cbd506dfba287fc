"""Pieces of oracle SQL shared between plan modules."""

from __future__ import annotations

from memlake.functions import rules


def q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def words(items) -> str:
    return ", ".join(q(w) for w in items)


REDACT = "regexp_replace(regexp_replace(regexp_replace({}, %s, '[REDACTED]', 'g'), %s, '[REDACTED]', 'g'), %s, '[REDACTED]', 'g')" % tuple(
    q(p) for p in rules.SECRET_PATTERNS)


def redact(expr: str) -> str:
    return REDACT.replace("{}", expr, 1) if REDACT.count("{}") == 1 else REDACT.replace("replace({}, ", f"replace({expr}, ", 1)


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'), ' ')"


def fold_words(expr: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all(lower({expr}), '[a-z0-9]+'), lambda x:
        CASE WHEN length(x) > 3 AND x LIKE '%s' AND right(x, 2) NOT IN ('ss', 'is', 'us') THEN left(x, length(x) - 1) ELSE x END), ' ')"""


def slug(expr: str, sep: str = "-", default: str = "untitled") -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower(trim(coalesce({expr}, ''))), '[^a-z0-9]+', '{sep}', 'g'), '{sep}'), ''), '{default}')"


def terms(expr: str) -> str:
    """Query terms, falling back to all of them when every one is a stop word."""
    raw = f"list_filter(list_transform(string_split_regex(lower(trim({expr}, ' ')), '\\s+'), lambda x: regexp_replace(x, '^[^\\w]+|[^\\w]+$', '', 'g')), lambda x: x <> '')"
    content = f"list_filter({raw}, lambda x: x NOT IN ({words(rules.SCAN_STOPWORDS)}))"
    return f"(CASE WHEN len({content}) > 0 THEN {content} ELSE {raw} END)"


def bm25_tokens(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), {q(rules.BM25_TOKEN)}), lambda x: x NOT IN ({words(rules.BM25_STOPWORDS)}))"


def count_of(text: str, needle: str) -> str:
    return f"((length({text}) - length(replace({text}, {needle}, ''))) // length({needle}))"
