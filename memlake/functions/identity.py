"""Content hashes and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.functions.text import nfc


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; every string trimmed and NFC-normalised.
    Null fields are left out."""
    parts = F.struct(*[F.trim(fields[k]).alias(k) for k in sorted(fields)])
    return F.to_json(parts)


def content_hash(fields: dict[str, Column], normalise: bool = True) -> Column:
    """``sha256:<hex>`` of the canonical form. Pass ``normalise=False`` for text known to be NFC."""
    text = canonical_json(fields)
    return F.concat(F.lit("sha256:"), F.sha2(nfc(text) if normalise else text, 256))


def event_id(harness: Column, hash_: Column, conversation: Column, turn: Column, namespace: Column | None = None) -> Column:
    """``harness:conversation:turn`` when both ids are known, else the content hash form."""
    hex_ = F.regexp_replace(hash_, r"^[^:]*:", "")
    middle = F.coalesce(F.nullif(namespace, F.lit("")), F.lit("sha256")) if namespace is not None else F.lit("sha256")
    native = (F.coalesce(conversation, F.lit("")) != "") & (F.coalesce(turn, F.lit("")) != "")
    return F.when(native, F.concat_ws(":", harness, conversation, turn)).otherwise(F.concat_ws(":", harness, middle, hex_))


def origin_id(source: Column, heading: Column, text: Column) -> Column:
    """``src_`` and 16 hex digits of source, heading and text in folded form."""

    def fold(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")

    raw = F.concat(F.lower(source), F.lit(":"), fold(heading), F.lit(":"), fold(text))
    return F.concat(F.lit("src_"), F.left(F.sha2(raw, 256), F.lit(16)))


def fingerprint(origin: Column, at: Column) -> Column:
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.left(F.sha2(F.concat(origin, F.lit(":"), F.coalesce(iso, F.lit("undated"))), 256), F.lit(16))
