"""Text expressions: cleaning, keys, ids. Everything is a native Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: C0 controls but TAB, LF and CR.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
#: White space as Python's ``\s`` has it, for Java's expressions.
SPACE = r"(?U)[\s\x1c-\x1f]+"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Namespace of URLs, RFC 4122 (fixed value).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def clean_text(value: Column, strip_controls: bool = True, collapse: bool = True) -> Column:
    """Controls are deleted first, then runs of white space become one blank, then the ends are stripped; null is empty."""
    out = F.coalesce(value, F.lit(""))
    if strip_controls:
        out = F.regexp_replace(out, CONTROLS, "")
    if collapse:
        return F.trim(F.regexp_replace(out, SPACE, " "))
    return F.regexp_replace(out, EDGE_SPACE, "")


def is_blank(value: Column) -> Column:
    return F.regexp_replace(value, SPACE, "") == ""


def truthy(value: Column) -> Column:
    """Text that counts as given: neither null nor empty."""
    return F.when(value != "", value)


def source_of(path: Column) -> Column:
    """The first ``dataset=`` part of a path, else ``unknown``."""
    return F.coalesce(truthy(F.regexp_extract(path, "dataset=([^/]+)", 1)), F.lit("unknown"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Version-5 UUID of a name: 16 bytes of SHA-1 with the version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def rank_key(seed: int, purpose: str, stratum: Column, ident: Column) -> Column:
    """A reproducible pseudo-random order within a stratum: the SHA-256 of seed, purpose, stratum and id."""
    return sha256(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), stratum, ident))


def strict_json(value: Column, field: str) -> Column:
    """A JSON text as VARIANT; null stays null, and text that is no JSON is an error that names the field."""
    parsed = F.try_parse_json(value)
    wrong = value.isNotNull() & parsed.isNull()
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"invalid JSON in {field}: "), F.substring(value, 1, 80))).cast("variant")).otherwise(parsed)
