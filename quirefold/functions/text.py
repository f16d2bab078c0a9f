"""Column functions over strings: identity, legality, lengths in UTF-16 units, escaping, base64, byte counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier format, and the shapes of credentials that no identifier may have.
SAFE_ID_FORMAT = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,255}\z"
CREDENTIAL_SHAPES = (
    r"(?iu)\Ask-(?:proj-)?[A-Za-z0-9._:-]{8,}\z",
    r"\A(?:AKIA|ASIA)[A-Z0-9]{12,}\z",
    r"(?iu)\Abearer[.:-][A-Za-z0-9._:-]{8,}\z",
    r"(?iu)\AeyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\z",
    r"(?iu)\A(?:-----)?BEGIN[.:-]?(?:(?:RSA|EC|OPENSSH)[.:-]?)?PRIVATE[.:-]?KEY",
    r"(?iu)\Axox[baprs]-[A-Za-z0-9._:-]{8,}\z",
    r"(?iu)\A(?:gh[pousr]|github_pat)_",
)
#: Characters that XML 1.0, or the codec's stricter rule, forbids.
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F￾￿]"


def content_id(namespace: str, value: Column) -> Column:
    """Content-addressed identifier."""
    return F.concat(F.lit(f"struct-{namespace}-"), F.substring(F.sha2(value, 256), 1, 24))


def credential_shaped(value: Column) -> Column:
    found = F.lit(False)
    for shape in CREDENTIAL_SHAPES:
        found = found | value.rlike(shape)
    return found


def safe_id(value: Column) -> Column:
    return value.rlike(SAFE_ID_FORMAT) & ~credential_shaped(value)


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 code units, which inline ranges and text counts are in."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("long")


def utf16_slice(value: Column, start: Column, end: Column) -> Column:
    """value[start:end] in UTF-16 units; null where an end lies within a surrogate pair."""
    units = F.encode(value, "UTF-16BE")
    part = F.substring(units, (2 * start + 1).cast("int"), (2 * (end - start)).cast("int"))
    hexed = F.hex(part)
    # a half of a pair at either end would make the decoding fail
    whole = ~(F.substring(hexed, 1, 2).between("DC", "DF") | F.substring(hexed, -4, 2).between("D8", "DB"))
    return F.when(whole, F.decode(F.when(whole, part), "UTF-16BE"))


def legal_text(value: Column) -> Column:
    return ~value.rlike(ILLEGAL)


def escape_text(value: Column) -> Column:
    out = value
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_attribute(value: Column) -> Column:
    return F.replace(escape_text(value), F.lit('"'), F.lit("&quot;"))


def canonical_base64(value: Column) -> Column:
    """Whether decoding and encoding again gives the same text."""
    return F.coalesce(F.regexp_replace(F.base64(F.try_to_binary(value, F.lit("base64"))), "\r?\n", "") == value, F.lit(False))


def sha256_format(value: Column) -> Column:
    return value.rlike(r"\A[a-f0-9]{64}\z")


def media_type(value: Column) -> Column:
    token = r"[!#$%&'+.^_`|~0-9A-Za-z-]+"
    return value.rlike(rf"\A{token}/{token}\z")
