"""Strict decoding of raw JSON documents, and the relational tables of what was decoded.

One Arrow pass interprets the schema of quirefold.sources.schema over each document by itself; everything after
it is ordinary DataFrame work on tables that all carry doc_key. A document fails with the code and path of the
first violation in the schema's order; raw text that is not JSON fails with code JSON.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical, code_units, digest, receipt_input
from ..functions.text import CREDENTIAL_SHAPES, SAFE_ID_FORMAT
from . import schema as S


class Rejected(ValueError):
    def __init__(self, code: str, path: str, message: str):
        super().__init__(f"{code} at {path}: {message}")
        self.code, self.path, self.message = code, path, message


def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?iu)", "(?i)").replace(r"\z", r"\Z"))


SAFE, SHAPES = _python(SAFE_ID_FORMAT), [_python(p) for p in CREDENTIAL_SHAPES]
FRAGMENT = re.compile(r"#[A-Za-z0-9][A-Za-z0-9._:-]{0,255}\Z")
CONTROL, ILLEGAL = re.compile(r"[\x00-\x1f\x7f]"), re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff￾￿]")
MIME = re.compile(r"[!#$%&'+.^_`|~0-9A-Za-z-]+/[!#$%&'+.^_`|~0-9A-Za-z-]+\Z")
URL = re.compile(r"(https?)://([a-z0-9_-]+(?:\.[a-z0-9_-]+)*\.?)(?::([1-9]\d{0,4}))?(/[^\s?#\"<>`{}\\^|\x7f-\U0010ffff]*)(\?[^\s#\"<>'\x7f-\U0010ffff]*)?(#[^\s\"<>`\x7f-\U0010ffff]*)?\Z")
LANGUAGE = re.compile(r"(?:(?:[A-Za-z]{2,3}(?:-[A-Za-z]{3}){0,3}|[A-Za-z]{4,8})(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|\d{3}))?(?P<variants>(?:-(?:[A-Za-z0-9]{5,8}|\d[A-Za-z0-9]{3}))*)(?:-[0-9A-WY-Za-wy-z](?:-[A-Za-z0-9]{2,8})+)*(?:-x(?:-[A-Za-z0-9]{1,8})+)?|x(?:-[A-Za-z0-9]{1,8})+)\Z")
# Language tags registered before the grammar.
GRANDFATHERED = set("art-lojban cel-gaulish en-gb-oed i-ami i-bnn i-default i-enochian i-hak i-klingon i-lux i-mingo i-navajo i-pwn i-tao i-tay i-tsu no-bok no-nyn sgn-be-fr sgn-be-nl sgn-ch-de zh-guoyu zh-hakka zh-min zh-min-nan zh-xiang".split())
# Paths that the package itself uses.
RESERVED_PATHS = set("package.opf nav.xhtml content.xhtml styles.css struct.json profile.json".split())


def is_safe_id(text: str) -> bool:
    return bool(SAFE.match(text)) and not any(p.match(text) for p in SHAPES)


def is_canonical_url(text: str) -> bool:
    """Whether a URL is in its canonical form; forms that this subset of the URL rules can't decide are refused."""
    if text.startswith("mailto:"):
        return bool(re.fullmatch(r"mailto:[!-~]+", text)) and not re.search(r"[\"<>`{}]", text)
    m = URL.match(text)
    if not m:
        return False
    scheme, host, port, path = m[1], m[2], m[3], m[4]
    if port and (int(port) > 65535 or int(port) == {"http": 80, "https": 443}[scheme]):
        return False
    last = host.rstrip(".").split(".")[-1]
    if last.isdigit() or last.startswith("0x"):
        parts = host.split(".")
        if len(parts) != 4 or not all(p.isdigit() and str(int(p)) == p and int(p) < 256 for p in parts):
            return False
    return not any(seg.lower().replace("%2e", ".") in (".", "..") for seg in path.split("/"))


def utf16_units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


class Decoder:
    """Interprets the schema; every method returns the checked value or raises Rejected."""

    def __call__(self, kind: tuple, value, path: str):
        return getattr(self, "is_" + kind[0])(value, path, *kind[1:])

    # -- scalars
    def is_text(self, v, path):
        if not isinstance(v, str):
            raise Rejected("TYPE", path, "expected a string")
        if len(v) * 4 > S.STRING_BYTES and len(v.encode("utf-8", "surrogatepass")) > S.STRING_BYTES:
            raise Rejected("BUDGET", path, "string exceeds the textual resource bound")
        if ILLEGAL.search(v):
            raise Rejected("STRING", path, "string holds a character that is not permitted")
        return v

    def is_number(self, v, path, domain=None):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise Rejected("TYPE", path, "expected a number")
        if not math.isfinite(v):
            raise Rejected("NON_FINITE_NUMBER", path, "number must be finite")
        if v == 0 and math.copysign(1, v) < 0:
            raise Rejected("NUMBER", path, "negative zero is not canonical")
        if domain == "positive" and v <= 0 or domain == "unit" and not 0 <= v <= 1:
            raise Rejected("RANGE", path, f"number must be {'positive' if domain == 'positive' else 'between 0 and 1'}")
        return v

    def is_int(self, v, path, least):
        v = self.is_number(v, path)
        if v != int(v) or abs(v) > 2**53 - 1 or v < least:
            raise Rejected("NUMBER", path, f"number must be a safe integer of at least {least}")
        return int(v)

    def is_angle(self, v, path):
        v = self.is_int(v, path, 0)
        if v >= 360:
            raise Rejected("RANGE", path, "rotation must be less than 360 degrees")
        return v

    def is_bool(self, v, path):
        if not isinstance(v, bool):
            raise Rejected("TYPE", path, "expected a boolean")
        return v

    def is_null(self, v, path, kind):
        return None if v is None else self(kind, v, path)

    def is_enum(self, v, path, allowed):
        if self.is_text(v, path) not in allowed:
            raise Rejected("ENUM", path, f"unexpected value {v!r}")
        return v

    def is_id(self, v, path):
        if not is_safe_id(self.is_text(v, path)):
            raise Rejected("IDENTIFIER", path, "identifier is not canonical")
        return v

    def is_ref(self, v, path):
        self.is_text(v, path)
        if CONTROL.search(v) or not (is_safe_id(v) or FRAGMENT.match(v) or is_canonical_url(v)):
            raise Rejected("REFERENCE", path, "reference must be an id, a fragment or a canonical URL")
        return v

    def is_href(self, v, path):
        self.is_text(v, path)
        if CONTROL.search(v) or not (FRAGMENT.match(v) or is_canonical_url(v)):
            raise Rejected("URL", path, "href must be a fragment or a canonical URL")
        return v

    def is_hash(self, v, path):
        if not re.fullmatch(r"[a-f0-9]{64}", self.is_text(v, path)):
            raise Rejected("HASH", path, "expected a lowercase SHA-256 digest")
        return v

    def is_mime(self, v, path):
        if not MIME.match(self.is_text(v, path)):
            raise Rejected("MIME", path, "media type must be a strict type/subtype")
        return v

    def is_package_path(self, v, path):
        self.is_text(v, path)
        if CONTROL.search(v) or re.search(r"[\\?#:%\s﻿]", v) or any(seg in ("", ".", "..") for seg in v.split("/")) or v in RESERVED_PATHS:
            raise Rejected("HREF", path, "asset href must be a free canonical package path")
        return v

    def is_language(self, v, path):
        self.is_text(v, path)
        m = LANGUAGE.match(v)
        if v.lower() not in GRANDFATHERED:
            if not m:
                raise Rejected("LANGUAGE", path, "language must be a valid tag")
            variants = (m["variants"] or "").lower().split("-")[1:]
            if len(set(variants)) < len(variants):
                raise Rejected("LANGUAGE", path, "language must not repeat a variant")
        singles = [t for t in re.split(r"(?i)(?:^|-)x(?:-|$)", v)[0].lower().split("-") if len(t) == 1]
        if len(set(singles)) < len(singles):
            raise Rejected("LANGUAGE", path, "language must not repeat an extension singleton")
        return v

    def is_date(self, v, path):
        m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", self.is_text(v, path))
        year, month, day = map(int, m.groups()) if m else (0, 0, 0)
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        if not m or not 1 <= month <= 12 or not 1 <= day <= (31, 28 + leap, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]:
            raise Rejected("DATE", path, "date must be a real full-date")
        return v

    def is_datetime(self, v, path):
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])", self.is_text(v, path)):
            raise Rejected("DATE_TIME", path, "timestamp must be a date-time")
        self.is_date(v[:10], path)
        return v

    def is_version(self, v, path):
        if v not in S.VERSIONS or not isinstance(v, str):
            raise Rejected("SCHEMA_VERSION", path, f"unsupported schema version {json.dumps(v)}")
        return v

    def is_bytes(self, v, path):
        if isinstance(v, list):
            if len(v) > S.ASSET_BYTES or not all(type(b) in (int, float) and b == int(b) and 0 <= b <= 255 for b in v):
                raise Rejected("BYTES", path, "bytes must be between 0 and 255")
            return base64.b64encode(bytes(map(int, v))).decode()
        if not isinstance(v, str):
            raise Rejected("TYPE", path, "expected a string or a byte array")
        try:
            data = base64.b64decode(v, validate=True)
        except (binascii.Error, ValueError):
            data = None
        if data is None or len(data) > S.ASSET_BYTES or base64.b64encode(data).decode() != v:
            raise Rejected("BYTES", path, "bytes must use canonical base64 within the bound")
        return v

    def is_attributes(self, v, path):
        out = {}
        for key in sorted(self.fields(v, path), key=code_units):
            at = f"{path}.{key}"
            if key in ("", "__proto__", "constructor", "prototype"):
                raise Rejected("FIELD", at, "attribute key is not safe")
            if isinstance(v[key], str):
                out[key] = self.is_text(v[key], at)
            elif isinstance(v[key], bool):
                out[key] = v[key]
            elif isinstance(v[key], (int, float)):
                out[key] = self.is_number(v[key], at)
            else:
                raise Rejected("TYPE", at, "attribute value must be a string, number or boolean")
        return out

    def is_consultations(self, v, path):
        """A closed receipt: known top-level keys, bounded size, no key or value shaped like a credential.

        What is met first, a bound or a fault, decides the code. Texts and keys count in UTF-8 bytes.
        """
        nodes = held = 0

        def fault(broken):
            if broken:
                raise Rejected("MODEL_RECEIPT", path, "receipt is not a closed record free of credentials")

        def bound(exceeded):
            if exceeded:
                raise Rejected("BUDGET", path, "receipt exceeds its bounds")

        def count(x):
            nonlocal held
            size = len(x.encode("utf-8", "surrogatepass"))
            held += size
            bound(size > S.RECEIPT_STRING_BYTES or held > S.RECEIPT_BYTES)

        def visit(x, depth):
            nonlocal nodes
            nodes += 1
            bound(depth > S.RECEIPT_DEPTH or nodes > S.RECEIPT_NODES)
            if isinstance(x, str):
                count(x)
                fault(any(p.match(x) for p in SHAPES))
            elif isinstance(x, float):
                fault(not math.isfinite(x) or x == 0 and math.copysign(1, x) < 0)
            elif isinstance(x, (list, dict)):
                bound(len(x) > S.RECEIPT_NODES - nodes)
                for y in x:
                    if isinstance(x, dict):
                        plain = re.sub(r"[^A-Za-z0-9]", "", y).lower()
                        fault(not is_safe_id(y) or any(f in plain for f in S.SECRET_KEYS.split()))
                        count(y)
                        y = x[y]
                    visit(y, depth + 1)

        visit(v, 0)
        fault(not isinstance(v, dict) or set(v) - set(S.RECEIPT_KEYS.split()))
        hashed = lambda x: isinstance(x, str) and re.fullmatch(r"[a-f0-9]{64}", x)
        fault(v.get("schemaVersion") != S.RECEIPT_VERSION or not isinstance(v.get("documentId"), str) or not is_safe_id(v["documentId"]))
        fault("sourceSha256" not in v or v["sourceSha256"] is not None and not hashed(v["sourceSha256"]))
        fault("semanticStateSha256" in v and not hashed(v["semanticStateSha256"]))
        fault(not isinstance(v.get("metrics"), dict))
        for name in ("consultations", "decisions"):
            fault(not isinstance(v.get(name), list) or not all(isinstance(x, dict) for x in v[name]))
        return v

    # -- composites
    def fields(self, v, path):
        if not isinstance(v, dict):
            raise Rejected("TYPE", path, "expected an object")
        if len(v) > S.OBJECT_KEYS:
            raise Rejected("BUDGET", path, "object has too many fields")
        return v

    def shape(self, v, path, required, optional):
        self.fields(v, path)
        for key in required:
            if key not in v:
                raise Rejected("REQUIRED", f"{path}.{key}", "field is required")
        for key in v:
            if key not in required and key not in optional:
                raise Rejected("UNKNOWN_FIELD", f"{path}.{key}", "unknown field is not declared")

    def is_record(self, v, path, required, optional, steps, then):
        self.shape(v, path, required, optional)
        out = {}
        for name, kind in steps:
            if kind[0] == "rule":
                getattr(self, kind[1])(out, v, path)
            elif name in v:
                out[name] = self.is_runs(v[name], f"{path}.{name}", kind[1], out["text"]) if kind[0] == "runs" else self(kind, v[name], f"{path}.{name}")
        return out

    def items(self, v, path, most):
        if not isinstance(v, list):
            raise Rejected("TYPE", path, "expected an array")
        if most is not None and len(v) > most:
            raise Rejected("BUDGET", path, f"array exceeds {most} items")
        return v

    def is_list(self, v, path, item, unique=None, most=None, of=None):
        out = [self(item, x, f"{path}[{i}]") for i, x in enumerate(self.items(v, path, most))]
        if unique:
            self.distinct([x[of] if of else x for x in out], path, unique)
        return out

    def distinct(self, values, path, label):
        seen = set()
        for x in values:
            if x in seen:
                raise Rejected("DUPLICATE_IDENTIFIER", path, f"duplicate {label} {x}")
            seen.add(x)

    def is_assets(self, v, path, kind):
        left = S.ASSET_BYTES
        for i, x in enumerate(self.items(v, path, S.ASSETS)):
            # sizes and shapes of all come before the contents of any
            size = 0
            if isinstance(self.fields(x, f"{path}[{i}]").get("bytes"), (str, list)):
                b = x["bytes"]
                size = len(b) if isinstance(b, list) else len(b) * 3 // 4 - (b[-2:].count("="))
            if size > left:
                raise Rejected("ASSET_BOUNDS", path, "asset bytes exceed the resource bound")
            self.shape(x, f"{path}[{i}]", kind[1], kind[2])
            left -= size
        return [self(kind, x, f"{path}[{i}]") for i, x in enumerate(v)]

    def is_runs(self, v, path, kind, text):
        out, n = self(kind, v, path), utf16_units(text)
        for i, run in enumerate(out):
            if run["end"] > n:
                raise Rejected("RANGE", f"{path}[{i}]", "inline end must not exceed text length")
        return out

    # -- rules over what has been read so far
    def run_range(self, out, v, path):
        if out["end"] < out["start"] or out["end"] == out["start"] and any(k in v for k in S.MARKS.split()):
            raise Rejected("RANGE", path, "inline end must not precede start, and an empty run carries nothing")

    def table_size(self, out, v, path):
        area = out["rows"] * out["columns"]
        if max(out["rows"], out["columns"], area) > S.TABLE_SIZE:
            raise Rejected("TABLE_BOUNDS", path, "table is too large")
        if isinstance(v["cells"], list) and len(v["cells"]) > area:
            raise Rejected("TABLE_BOUNDS", f"{path}.cells", "more cells than the table has places")

    def table_fit(self, out, v, path):
        for i, c in enumerate(out["cells"]):
            for at, span, size in (("row", "rowSpan", "rows"), ("column", "columnSpan", "columns")):
                if c[at] + c[span] > out[size]:
                    raise Rejected("TABLE_BOUNDS", f"{path}.cells[{i}].{at}", "cell must fit within the table")
        taken: set = set()
        for i, c in enumerate(out["cells"]):
            own = {(r, k) for r in range(c["row"], c["row"] + c["rowSpan"]) for k in range(c["column"], c["column"] + c["columnSpan"])}
            if own & taken:
                raise Rejected("TABLE_OVERLAP", f"{path}.cells[{i}]", "table cells cannot overlap")
            taken |= own

    def heading_level(self, out, v, path):
        level = out.get("attributes", {}).get("level")
        if out["kind"] == "heading" and level is not None and (isinstance(level, (bool, str)) or level not in range(1, 7)):
            raise Rejected("ATTRIBUTE", f"{path}.attributes.level", "heading level must be an integer from 1 through 6")

    def bytes_hash(self, out, v, path):
        if "bytes" in out and hashlib.sha256(base64.b64decode(out["bytes"])).hexdigest() != out["sha256"]:
            raise Rejected("BYTES_HASH", f"{path}.bytes", "asset bytes do not match their digest")

    def ids_by_kind(self, out, v, path):
        for name, of, label in (("blocks", "id", "block id"), ("assets", "id", "asset id"), ("relationships", "id", "relationship id"), ("diagnostics", "id", "diagnostic id"), ("pages", "page", "page number")):
            self.distinct([x[of] for x in out[name]], f"{path}.{name}", label)


def loads(raw: str):
    """JSON with the last of repeated keys, numbers as written: integers exact while safe, and -0 kept."""
    def integer(s):
        return -0.0 if s == "-0" else int(s) if len(s) < 17 else float(s)

    def constant(s):
        raise ValueError(s)

    return json.loads(raw, parse_int=integer, parse_constant=constant)


def decode_one(raw: str | None) -> tuple[dict | None, str | None, str | None]:
    """(document, None, None) or (None, code, path)."""
    try:
        value = loads(raw or "")
    except (ValueError, RecursionError):
        return None, "JSON", "$"
    try:
        return Decoder()(S.DOCUMENT, value, "$"), None, None
    except Rejected as e:
        return None, e.code, e.path


def latin_order(key: str) -> tuple:
    """The order of most locales for the schema's keys: letters before case, lower case first."""
    return key.lower(), [c.isupper() for c in key]


def digests(document: dict) -> list[str]:
    """The receipt digests that count: by code units, and for legacy documents by the usual collation too."""
    own = receipt_input(document)
    out = [digest(own)]
    if document["schemaVersion"] == S.LEGACY:
        out.append(hashlib.sha256(canonical(own, latin_order).encode()).hexdigest())
    return out


# -- DataFrames
def ddl(kind: tuple) -> str:
    """The Spark type of a decoded value."""
    name = kind[0]
    if name == "record":
        fields = [(n, k) for n, k in kind[3] if n]
        return "struct<" + ",".join(f"`{n}`:{ddl(k)}" for n, k in fields) + ">"
    if name in ("list", "assets"):
        return f"array<{ddl(kind[1])}>"
    if name in ("null", "runs"):
        return ddl(kind[1])
    return {"int": "bigint", "angle": "bigint", "number": "double", "bool": "boolean", "attributes": "map<string,struct<s:string,d:double,b:boolean>>"}.get(name, "string")


def _typed(kind: tuple, value):
    """A decoded value as JSON for the Spark type: attributes tagged by their type, receipts as text."""
    if value is None:
        return None
    if kind[0] == "record":
        return {n: _typed(k, value[n]) for n, k in kind[3] if n in value}
    if kind[0] in ("list", "assets"):
        return [_typed(kind[1], v) for v in value]
    if kind[0] in ("null", "runs"):
        return _typed(kind[1], value)
    if kind[0] == "attributes":
        return {k: {"b" if isinstance(v, bool) else "s" if isinstance(v, str) else "d": v} for k, v in value.items()}
    if kind[0] == "consultations":
        return canonical(value)
    return value


def decode(raw: DataFrame, key_col: str = "doc_key", raw_col: str = "raw") -> DataFrame:
    """doc_key, code and path (null where the document decodes), doc (the typed document), canonical text and digests.

    The schema is checked here; quirefold.operators.invariants checks what relates its parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                doc, code, path = decode_one(text)
                rows.append((code, path, json.dumps(_typed(S.DOCUMENT, doc), ensure_ascii=False) if doc else None, canonical(doc) if doc else None, digests(doc) if doc else None))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_key", "code", "path", "typed", "encoded", "digests"])

    kind = dict(raw.dtypes)[key_col]
    out = raw.select(F.col(key_col).alias("doc_key"), raw_col).mapInArrow(run, f"doc_key {kind}, code string, path string, typed string, encoded string, digests array<string>")
    return out.withColumn("doc", F.from_json("typed", ddl(S.DOCUMENT))).drop("typed")


def tables(decoded: DataFrame) -> dict[str, DataFrame]:
    """Child tables of the decoded documents, each with doc_key and its position."""
    docs = decoded.filter("code is null")

    def child(parent: DataFrame, path: str, pos: str, *keep: str) -> DataFrame:
        return parent.select("doc_key", *keep, F.posexplode(path).alias(pos, "item")).select("doc_key", *keep, pos, "item.*")

    blocks = child(docs, "doc.blocks", "pos")
    edges = child(docs, "doc.relationships", "pos")
    pages = child(docs, "doc.pages", "pos")
    cells = blocks.filter("table is not null").select("doc_key", F.col("pos").alias("block_pos"), F.posexplode("table.cells").alias("cell_pos", "item")).select("doc_key", "block_pos", "cell_pos", "item.*")
    runs = (
        blocks.select("doc_key", F.col("pos").alias("block_pos"), F.lit(-1).alias("cell_pos"), "text", F.posexplode("inline").alias("run_pos", "item"))
        .unionByName(cells.select("doc_key", "block_pos", "cell_pos", "text", F.posexplode("inline").alias("run_pos", "item")))
        .select("doc_key", "block_pos", "cell_pos", "text", "run_pos", "item.*")
    )
    return {
        "documents": docs, "blocks": blocks, "assets": child(docs, "doc.assets", "pos"), "edges": edges, "pages": pages, "diagnostics": child(docs, "doc.diagnostics", "pos"),
        "cells": cells, "runs": runs, "notes": child(docs, "doc.metadata.authorNotes", "pos"), "issues": child(docs, "doc.recovery.issues", "pos"),
        "edge_targets": edges.select("doc_key", F.col("pos").alias("edge_pos"), F.posexplode("to").alias("pos", "target")),
        "edge_candidates": edges.select("doc_key", F.col("pos").alias("edge_pos"), F.posexplode("candidates").alias("pos", "item")).select("doc_key", "edge_pos", "pos", "item.*"),
        "page_blocks": pages.select("doc_key", F.col("pos").alias("page_pos"), "page", F.posexplode("blocks").alias("pos", "block_id")),
        "page_columns": pages.select("doc_key", F.col("pos").alias("page_pos"), "page", F.posexplode("columns").alias("column_pos", "item")).select("doc_key", "page_pos", "page", "column_pos", "item.*"),
    }
