"""Canonical JSON text and digests of decoded documents."""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal
from functools import lru_cache
from json.encoder import encode_basestring as string_text


def number_text(value: int | float) -> str:
    """The shortest text that reads back as the number, with exponents from 1e21 and below 1e-6 only."""
    if isinstance(value, int):
        value = float(value) if abs(value) > 2**53 else value
        if isinstance(value, int):
            return str(value)
    if not math.isfinite(value):
        return "null"
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        text = d + "0" * (point - len(d)) if len(d) <= point else f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + d
    else:
        text = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + text


def code_units(key: str) -> bytes:
    """Sorts as UTF-16 code units do."""
    return key.encode("utf-16-be", "surrogatepass")


@lru_cache(4096)
def _fields(keys: tuple[str, ...], order) -> list[tuple[str, str]]:
    """Keys in order, with their text: objects of one kind have the same keys."""
    return [(k, string_text(k) + ":") for k in sorted(keys, key=order)]


def canonical(value, order=code_units) -> str:
    """JSON text without blanks, keys in the given order (of UTF-16 code units by default)."""
    if isinstance(value, str):
        return string_text(value)
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join([canonical(v, order) for v in value]) + "]"
    return joined({k: canonical(v, order) for k, v in value.items()}, order)


def joined(texts: dict[str, str], order=code_units) -> str:
    """An object of values that are canonical text already."""
    return "{" + ",".join([label + texts[k] for k, label in _fields(tuple(texts), order)]) + "}"


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def receipt_input(document: dict) -> dict:
    """What a document's receipt is a digest of: all but the receipt and the assets' bytes, with its counters and consultations."""
    out = {k: v for k, v in document.items() if k != "receipt"}
    out["conservation"] = document["receipt"]["conservation"]
    if document["receipt"].get("modelConsultations"):
        out["modelConsultations"] = document["receipt"]["modelConsultations"]
    out["assets"] = [{k: v for k, v in a.items() if k != "bytes"} for a in document["assets"]]
    return out


def receipt_digest(document: dict) -> str:
    return digest(receipt_input(document))
