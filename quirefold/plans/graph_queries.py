"""Queries whose answers are known beforehand: graphs with one fault each, and the graph operators over the driver's tables.

`faulty_graphs` builds a whole graph (runs, table, furniture, figure, caption, notes, asset, edges, diagnostics) around
every document's text and breaks one rule in it, by the document's id; its SQL states what each fault must be called and
where it must be found. The other queries read orders as documents, their line items as edges, targets or runs.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import receipt_digest
from ..operators import invariants, ordering, reading, recovery
from ..sources import decode as codec
from ..sources import schema as S
from ..sources.store import spread, stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- graphs
def _proof(page: int = 1) -> dict:
    return {"confidence": 1, "pages": [page], "boxes": [{"page": page, "x": 0, "y": 0, "width": 5, "height": 5, "rotation": 0}], "sourceIds": ["s-1"]}


def _block(name: str, kind: str, text: str, **more) -> dict:
    return {"id": name, "kind": kind, "text": text, "page": 1, "order": 0, "column": "single", "inline": [], "evidence": _proof()} | more


def _edge(name: str, kind: str, start: str, *ends: str, **more) -> dict:
    return {"id": name, "kind": kind, "from": start, "to": list(ends), "status": "matched", "confidence": 1, "evidence": _proof()} | more


def graph(doc_id: int, text: str) -> dict:
    """A graph around a text, without its receipt's counts."""
    said = "".join(c for c in text if c >= " " and c != "\x7f" and not "\ud800" <= c <= "\udfff" and c not in "￾￿")
    cell = {"row": 0, "column": 0, "rowSpan": 1, "columnSpan": 1, "headerScope": None, "inline": [], "evidence": _proof()}
    blocks = [
        _block("b-0", "heading", "Title", attributes={"level": 1}),
        _block("b-1", "paragraph", "Some words. " + said, inline=[{"start": 0, "end": 4, "bold": True}, {"start": 2, "end": 9, "href": "#b-2", "relationshipId": "r-1", "targetIds": ["b-2"]}]),
        _block("b-2", "footnote", "A note"),
        _block("b-3", "furniture", "Page 1", furniture={"classification": S.FURNITURE_CLASSES.split()[0], "band": S.BANDS.split()[0], "pages": [1], "boxes": [], "evidence": []}),
        _block("b-4", "figure", "", fallbackAssetIds=["a-1"], sourceObservationAnchorIds=["o-1"]),
        _block("b-5", "caption", "Said below"),
        _block("b-6", "table", "", table={"rows": 2, "columns": 2, "semantic": S.TABLE_SEMANTICS.split()[0], "cells": [cell | {"id": "c-1", "text": "one"}, cell | {"id": "c-2", "text": "two", "row": 1, "columnSpan": 2}]}),
    ]
    for i, b in enumerate(blocks):
        b["order"] = i
    data = b"art"
    asset = {"id": "a-1", "kind": S.ASSET_KINDS.split()[0], "href": "art.png", "mediaType": "image/png", "sha256": hashlib.sha256(data).hexdigest(), "bytes": base64.b64encode(data).decode(), "width": 1, "height": 1, "sourceObjectIds": [], "evidence": _proof(), "fallback": S.ASSET_FALLBACKS.split()[0]}
    names = [b["id"] for b in blocks]
    return {
        "schemaVersion": S.CURRENT, "documentId": f"doc-{doc_id}", "source": {"format": "docx", "fileName": "a.docx", "sha256": "b" * 64, "byteLength": 3, "pageCount": 1, "localOnly": True},
        "metadata": {"title": "T", "subtitle": "", "authors": ["Ann"], "abstract": "", "language": "en", "authorNotes": [{"id": "n-1", "author": "Ann", "label": "1", "target": "b-2"}]},
        "blocks": blocks, "assets": [asset],
        "relationships": [_edge("r-1", "footnote", "b-1", "b-2"), _edge("r-2", "caption", "b-4", "b-5", candidates=[{"target": "b-5", "confidence": 1, "evidence": _proof()}])],
        "pages": [{"page": 1, "width": 600, "height": 800, "rotation": 0, "blocks": names, "columns": [{"id": "c-1", "side": "single", "blockIds": names}]}],
        "diagnostics": [{"id": "d-1", "severity": "info", "category": "source", "title": "t", "message": "m", "pages": [1], "sourceIds": []}],
        "recovery": {"status": "ready", "title": "t", "summary": "s", "issues": [{"category": "source", "title": "t", "count": 1, "pages": [1]}]},
    }


def sealed(doc: dict) -> dict:
    """With a receipt that fits it."""
    units = lambda blocks: sum(codec.utf16_units(b["text"]) for b in blocks if isinstance(b.get("text"), str))
    furniture = [b for b in doc["blocks"] if b.get("kind") == "furniture"]
    n = {"Block": len(doc["blocks"]), "Asset": len(doc["assets"]), "Relationship": len(doc["relationships"]), "Diagnostic": len(doc["diagnostics"]), "TextCharacter": units(doc["blocks"])}
    counters = dict.fromkeys(S.COUNTERS.split(), 0) | {f"struct{k}Count": v for k, v in n.items()} | {"sourceTextCharacterCount": n["TextCharacter"]}
    for k in ("Asset", "Relationship", "Diagnostic"):
        counters[f"source{k}Count"] = counters[f"accountedSource{k}Count"] = n[k]
    m = units(furniture)
    counters |= dict(zip(S.FURNITURE_COUNTERS.split()[:5], (len(furniture), len(furniture), m, len(furniture), m), strict=True))
    doc["receipt"] = {
        "schemaVersion": doc["schemaVersion"], "documentId": doc["documentId"], "sourceSha256": doc["source"]["sha256"], "blockCount": n["Block"], "assetCount": n["Asset"],
        "relationshipCount": n["Relationship"], "diagnosticCount": n["Diagnostic"], "textCharacterCount": n["TextCharacter"], "conservation": counters, "generatedSha256": "0" * 64,
    }
    doc["receipt"]["generatedSha256"] = receipt_digest(doc)
    return doc


GONE = object()
_box = {"page": 2, "x": 0, "y": 0, "width": 5, "height": 5, "rotation": 0}
_note = {"id": "n-1", "author": "Ann", "label": "1", "target": "b-2"}
#: Where each fault is put, what it is, and whether the receipt is made to fit afterwards.
FAULTS: tuple[tuple[str, object, bool], ...] = (
    ("", None, True),
    ("extra", 1, False), ("blocks.0.attributes.level", 7, False), ("blocks.1.inline.0.end", 10**6, False), ("blocks.1.id", "sk-abcdefgh1", False), ("blocks.1.evidence.confidence", 1.5, False),
    ("blocks.1.evidence.boxes.0.x", -0.0, False), ("blocks.2.id", "b-1", False), ("metadata.language", "en-x-", False), ("metadata.publicationDate", "2026-02-30", False),
    ("relationships.0.to", ["http://a.example"], False), ("schemaVersion", "0.3.0", False), ("blocks.0.text", "a\u0001", False), ("blocks.0.kind", "poem", False), ("blocks.0.order", -1, False),
    ("assets.0.href", "../x", False), ("assets.0.mediaType", "a/*", False), ("assets.0.width", 0, False), ("assets.0.bytes", "AR==", False), ("assets.0.bytes", "AQ==", False), ("assets.0.sha256", "x", False),
    ("blocks.6.table.cells.1.row", 2, False), ("blocks.6.table.cells.1.row", 0, False), ("blocks.6.table.cells.1.id", "c-1", False), ("blocks.6.table.rows", 10**9, False),
    ("blocks.1.inline.0.end", 0, False), ("source.byteLength", GONE, False), ("pages.0.rotation", 360, False),
    ("relationships.0.from", "nope", True), ("relationships.0.to", ["#nope"], True), ("relationships.1.candidates.0.target", "nope", True), ("blocks.1.inline.1.href", "#nope", True),
    ("blocks.1.inline.1.relationshipId", "nope", True), ("blocks.1.inline.1.targetIds", ["nope"], True), ("blocks.4.fallbackAssetIds", ["nope"], True), ("pages.0.blocks.0", "nope", True),
    ("metadata.authorNotes.0.target", "nope", True), ("metadata.authorNotes.0.author", "Bob", True), ("metadata.authorNotes", [_note | {"id": "r-1"}], True),
    ("metadata.authorNotes", [_note | {"id": "r-1", "target": "b-1"}], True), ("metadata.authors", ["Ann", "Ann"], True), ("diagnostics.0.id", "b-1", True), ("blocks.4.sourceObservationAnchorIds", ["b-1"], True),
    ("documentId", "b-1", True), ("pages.0.columns.0.side", "left", True), ("pages.0.columns.0.blockIds", ["b-0"], True), ("diagnostics.0.pages", [2], True), ("recovery.issues.0.pages", [2], True),
    ("blocks.1.evidence.boxes.0.page", 2, True), ("blocks.1.evidence.pages", [1, 2], True), ("blocks.1.page", None, True), ("pages.0.page", 2, True), ("blocks.3.furniture.boxes", [_box], True),
    ("blocks.6.table.cells.0.evidence.pages", [2], True),
    ("receipt.blockCount", 9, False), ("receipt.textCharacterCount", 1, False), ("receipt.generatedSha256", "0" * 64, False), ("receipt.sourceSha256", "0" * 64, False), ("receipt.schemaVersion", "0.1.0", False),
    ("receipt.documentId", "doc-x", False), ("receipt.conservation.structBlockCount", 1, False), ("receipt.conservation.accountedSourceNodeCount", 1, False),
    ("receipt.conservation.accountedSourceAssetCount", 0, False), ("receipt.conservation.structFurnitureBlockCount", 2, False), ("receipt.conservation.sourceFurnitureBlockCount", GONE, False),
    ("receipt.conservation.structTextCharacterCount", 0, False),
)
#: What each must be called and where it must be found, in the same order; null where the graph is valid all the same.
VERDICTS = """(NULL, NULL),
 ('UNKNOWN_FIELD', '$.extra'), ('ATTRIBUTE', '$.blocks[0].attributes.level'), ('RANGE', '$.blocks[1].inline[0]'), ('IDENTIFIER', '$.blocks[1].id'), ('RANGE', '$.blocks[1].evidence.confidence'),
 ('NUMBER', '$.blocks[1].evidence.boxes[0].x'), ('DUPLICATE_IDENTIFIER', '$.blocks'), ('LANGUAGE', '$.metadata.language'), ('DATE', '$.metadata.publicationDate'),
 ('REFERENCE', '$.relationships[0].to[0]'), ('SCHEMA_VERSION', '$.schemaVersion'), ('STRING', '$.blocks[0].text'), ('ENUM', '$.blocks[0].kind'), ('NUMBER', '$.blocks[0].order'),
 ('HREF', '$.assets[0].href'), ('MIME', '$.assets[0].mediaType'), ('RANGE', '$.assets[0].width'), ('BYTES', '$.assets[0].bytes'), ('BYTES_HASH', '$.assets[0].bytes'), ('HASH', '$.assets[0].sha256'),
 ('TABLE_BOUNDS', '$.blocks[6].table.cells[1].row'), ('TABLE_OVERLAP', '$.blocks[6].table.cells[1]'), ('DUPLICATE_IDENTIFIER', '$.blocks[6].table.cells'), ('TABLE_BOUNDS', '$.blocks[6].table'),
 ('RANGE', '$.blocks[1].inline[0]'), ('REQUIRED', '$.source.byteLength'), ('RANGE', '$.pages[0].rotation'),
 ('REFERENCE', '$.relationships[0].from'), ('REFERENCE', '$.relationships[0].to[0]'), ('REFERENCE', '$.relationships[1].candidates[0].target'), ('REFERENCE', '$.blocks[1].inline[1].href'),
 ('REFERENCE', '$.blocks[1].inline[1].relationshipId'), ('REFERENCE', '$.blocks[1].inline[1].targetIds[0]'), ('REFERENCE', '$.blocks[4].fallbackAssetIds[0]'), ('REFERENCE', '$.pages[0].blocks[0]'),
 ('REFERENCE', '$.metadata.authorNotes[0].target'), ('REFERENCE', '$.metadata.authorNotes[0].author'), (NULL, NULL),
 ('DUPLICATE_IDENTIFIER', '$.metadata.authorNotes[0].id'), ('DUPLICATE_IDENTIFIER', '$.metadata.authors'), ('DUPLICATE_IDENTIFIER', '$.diagnostics'), ('DUPLICATE_IDENTIFIER', '$.blocks.sourceObservationAnchorIds'),
 ('DUPLICATE_IDENTIFIER', '$.documentId'), ('PAGE_BINDING', '$.pages[0].columns[0].blockIds[0]'), ('PAGE_BINDING', '$.pages[0]'), ('PAGE_BINDING', '$.diagnostics[0].pages[0]'), ('PAGE_BINDING', '$.recovery.issues[0].pages[0]'),
 ('PAGE_BINDING', '$.blocks[1].evidence.boxes[0].page'), ('PAGE_BINDING', '$.blocks[1].evidence.pages[1]'), ('PAGE_BINDING', '$.pages[0].blocks[1]'), ('PAGE_BINDING', '$.pages[0].page'), ('PAGE_BINDING', '$.blocks[3].furniture.boxes[0].page'),
 ('PAGE_BINDING', '$.blocks[6].table.cells[0].evidence.pages[0]'),
 ('COUNT', '$.receipt'), ('COUNT', '$.receipt.textCharacterCount'), ('DIGEST', '$.receipt.generatedSha256'), ('BINDING', '$.receipt.sourceSha256'), ('SCHEMA_VERSION', '$.receipt.schemaVersion'),
 ('BINDING', '$.documentId'), ('COUNT', '$.receipt.conservation.structBlockCount'), ('CONSERVATION', '$.receipt.conservation.accountedSourceNodeCount'),
 ('CONSERVATION', '$.receipt.conservation.accountedSourceAssetCount'), ('CONSERVATION', '$.receipt.conservation.structFurnitureBlockCount'), ('CONSERVATION', '$.receipt.conservation'),
 ('COUNT', '$.receipt.conservation.structTextCharacterCount')"""


def faulty(doc_id: int, text: str) -> str:
    """The raw graph of a document, with the fault that its id gives it."""
    where, what, fit = FAULTS[doc_id % len(FAULTS)]
    doc = graph(doc_id, text)
    if not fit:
        doc = sealed(doc)
    if where:
        *way, last = [int(k) if k.isdigit() else k for k in where.split(".")]
        at = doc
        for k in way:
            at = at[k]
        if what is GONE:
            del at[last]
        else:
            at[last] = copy.deepcopy(what)
    return json.dumps(sealed(doc) if fit else doc, ensure_ascii=False)


def faulty_graphs(spark, sf_dir):
    """Documents as graphs with one fault each, by their id: the code and path of the first violation (null text: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [faulty(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_key", "raw"])

    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    decoded = stored(codec.decode(spread(docs, "doc_id").mapInArrow(run, "doc_key long, raw string")), "faulty")
    found = invariants.verdicts(decoded, codec.tables(decoded))
    return found.select(F.col("doc_key").alias("doc_id"), F.pmod("doc_key", F.lit(len(FAULTS))).alias("fault"), "code", "path")


# -- orders as documents
def caption_links(spark, sf_dir):
    """Captions of hosts: line items as edges from one of four hosts (one missing) to one of five captions (one missing)."""
    spell = lambda name, kind, text: F.struct(F.lit(name).alias("id"), F.lit(kind).alias("kind"), F.lit(text).alias("text"))
    held = F.array(spell("h-0", "figure", ""), spell("h-1", "table", "Cap 1"), spell("h-2", "equation", "Other"), *(spell(f"c-{i}", "caption", f" Cap {i} ") for i in range(4)))
    blocks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_key"), F.explode(held).alias("b")).select("doc_key", "b.*")
    i = F.col("l_linenumber")
    edges = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_key"), F.concat(F.lit("e-"), i).alias("id"), i.alias("pos"), F.when(F.col("l_linestatus") == "O", "caption").otherwise("footnote").alias("kind"),
        F.when(F.col("l_returnflag") == "A", "ambiguous").otherwise("matched").alias("status"), F.concat(F.lit("h-"), F.col("l_suppkey") % 4).alias("from"),
        F.array(F.concat(F.when(i % 2 == 1, "#").otherwise(""), F.lit("c-"), F.col("l_partkey") % 5)).alias("to"),
    )
    return reading.attached_captions({"blocks": blocks, "edges": edges}).withColumnRenamed("doc_key", "order_id")


def link_targets(spark, sf_dir):
    """What line items point to: assets, blocks, furniture, external addresses and what is none of these."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_key"))
    name = lambda prefix, n: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.lit(prefix), k))).alias("id")
    assets = orders.select("doc_key", name("a-", 2)).withColumn("href", F.concat("id", F.lit(".png")))
    blocks = orders.select("doc_key", name("b-", 2)).withColumn("kind", F.when(F.col("id") == "b-1", "furniture").otherwise("paragraph"))
    n = F.col("l_partkey") % 3
    target = (
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("#a-"), n)).when(F.col("l_linenumber") % 5 == 1, F.concat(F.lit("b-"), n)).when(F.col("l_linenumber") % 5 == 2, F.concat(F.lit("https://x.example/"), n))
        .when(F.col("l_linenumber") % 5 == 3, F.concat(F.lit("#b-"), n)).otherwise(F.concat(F.lit("mailto:"), n))
    )
    targets = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_key"), "l_linenumber", target.alias("target"))
    return reading.resolved_targets(targets, {"assets": assets, "blocks": blocks}).withColumnRenamed("doc_key", "order_id")


def note_links(spark, sf_dir):
    """Notes with the edges that lead to them, where a run carries the edge: line items as edges, and as runs of the next line's."""
    i = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem")
    edges = rows.select(
        F.col("l_orderkey").alias("doc_key"), i.alias("pos"), F.concat(F.lit("r-"), i).alias("id"), F.when(F.col("l_returnflag") == "A", "unresolved").otherwise("matched").alias("status"),
        F.element_at(F.array(F.lit("footnote"), F.lit("endnote"), F.lit("citation")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("kind"), F.array(F.concat(F.lit("#n-"), F.col("l_partkey") % 3)).alias("to"),
    )
    runs = rows.select(F.col("l_orderkey").alias("doc_key"), F.when(i % 4 > 0, F.concat(F.lit("r-"), i + 1)).alias("relationshipId"), F.when(F.col("l_linestatus") == "O", "note-reference").alias("semanticRole"))
    return reading.note_backlinks({"runs": runs, "edges": edges}).select(F.col("doc_key").alias("order_id"), "note_id", F.array_join("edge_ids", ",").alias("edge_ids"))


def referred_targets(spark, sf_dir):
    """What referring runs point to: every line item is a run with a target of its own, most are also its relationship."""
    rows, i = read(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    key, name = F.col("l_orderkey").alias("doc_key"), F.concat(F.lit("r-"), i)
    runs = rows.select(key, F.lit(0).alias("block_pos"), F.lit(-1).alias("cell_pos"), i.alias("run_pos"), F.when(F.col("l_linestatus") == "O", "citation").alias("semanticRole"), name.alias("relationshipId"), F.array(F.concat(F.lit("#b-"), F.col("l_suppkey") % 2)).alias("targetIds"))
    label = F.when(i % 3 == 0, "7, 8 ").when(i % 3 == 1, " 7,, ")
    edges = rows.filter("l_partkey % 4 > 0").select(key, name.alias("id"), F.when(F.col("l_returnflag") == "A", "ambiguous").otherwise("matched").alias("status"), F.array(F.lit("a-0"), F.lit("#b-0"), F.lit("c")).alias("to"), label.alias("label"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_key"))
    assets = orders.select("doc_key", F.lit("a-0").alias("id"), F.lit("a.png").alias("href"))
    blocks = orders.select("doc_key", F.lit("b-0").alias("id"), F.lit("paragraph").alias("kind"))
    out = reading.reference_targets({"runs": runs, "edges": edges, "assets": assets, "blocks": blocks})
    return out.select(F.col("doc_key").alias("order_id"), F.col("run_pos").alias("line"), F.col("n").cast("long").alias("n"), "target", "label", "kind", "href")


def author_notes(spark, sf_dir):
    """The notes of each author: orders have three authors, their line items are notes of four, one unknown."""
    authors = F.struct(F.struct(F.array(F.lit("A"), F.lit("B"), F.lit("C")).alias("authors")).alias("metadata")).alias("doc")
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_key"), authors)
    i = F.col("l_linenumber")
    notes = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_key"), i.alias("pos"), F.concat(F.lit("n-"), i).alias("id"), i.cast("string").alias("label"), F.concat(F.lit("b-"), F.col("l_partkey")).alias("target"),
        F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("author"),
    )
    said = F.array_join(F.transform("notes", lambda n: F.concat_ws(":", n["label"], n["id"], n["target"])), ",")
    return reading.notes_by_author({"documents": docs, "notes": notes}).select(F.col("doc_key").alias("order_id"), F.col("author_pos").cast("long").alias("author_pos"), "author", said.alias("notes"))


def figure_assets(spark, sf_dir):
    """Line items as figures with three fallback assets, of which each order has some."""
    rows = read(spark, sf_dir, "lineitem")
    blocks = rows.select(F.col("l_orderkey").alias("doc_key"), F.col("l_linenumber").alias("pos"), F.transform(F.array("l_partkey", "l_suppkey", "l_linenumber"), lambda k: F.concat(F.lit("a-"), k.cast("long") % 4)).alias("fallbackAssetIds"))
    assets = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 4)).alias("k")).select("doc_key", F.concat(F.lit("a-"), "k").alias("id"), F.concat(F.lit("art/"), "k", F.lit(".png")).alias("href"))
    return reading.figure_artwork({"blocks": blocks, "assets": assets}).select(F.col("doc_key").alias("order_id"), F.col("block_pos").alias("line"), F.array_join("hrefs", ",").alias("hrefs"))


def page_columns(spark, sf_dir):
    """Pages with their blocks and columns in reading order: events as blocks of their user, the day as the page."""
    kinds = F.pmod(F.length("event_type"), F.lit(4))
    side = F.when(kinds == 0, "span").when(kinds == 1, "left").when(kinds == 2, "right")
    blocks = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_key"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("id"), F.dayofmonth("ts").cast("long").alias("page"), side.alias("column"), F.col("event_id").alias("order"),
        F.struct(F.col("value").alias("y"), F.lit(0.0).alias("x")).alias("box"),
    )
    pages = blocks.select("doc_key", "page").distinct()
    columns = F.array_join(F.transform("columns", lambda c: F.concat(c["id"], F.lit(":"), c["side"], F.lit("="), F.array_join(c["blockIds"], "+"))), ";")
    return ordering.page_layouts(pages, blocks).select(F.col("doc_key").alias("user_id"), "page", F.array_join("blocks", ",").alias("blocks"), columns.alias("columns"))


def list_attributes(spark, sf_dir):
    """Turns of users as list items with typed attributes: level, order, ordinal and list of each."""
    value = lambda s=None, d=None, b=None: F.struct(*(x.alias(n) if x is not None else F.lit(None).cast(t).alias(n) for n, t, x in (("s", "string", s), ("d", "double", d), ("b", "boolean", b))))
    t, n = F.col("turn"), F.length("text")
    given = F.create_map(
        F.lit("listLevel"), value(d=F.when(t % 3 == 0, (n % 4).cast("double")).when(t % 3 == 1, F.lit(0.5))), F.lit("listOrdinal"), value(d=(n % 7 - 2).cast("double")),
        F.lit("listOrdered"), value(b=F.when(t % 4 == 0, n % 2 == 0)), F.lit("ordered"), value(b=F.when(t % 4 < 2, n % 2 == 1)), F.lit("listId"), value(s=F.col("role")),
    )
    blocks = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("pos"), F.col("turn").alias("id"), F.when(F.col("role") == "user", "list-item").when(t % 5 == 4, "furniture").otherwise("paragraph").alias("kind"), given.alias("attributes"))
    return reading.list_items(blocks).select(F.col("doc_key").alias("conv_id"), F.col("pos").alias("turn"), F.col("run").cast("long").alias("run"), "level", "ordered", "ordinal", "list_id", "declares_nesting")


def recovery_facts(spark, sf_dir):
    """Events as diagnostics with every known code and one unknown, by their id: id, category, title, pages and whether a user must act."""
    known = [c for codes in recovery.CODES.values() for c in codes.split()] + ["SOMETHING_ELSE"]
    code = F.element_at(F.array(*map(F.lit, known)), (F.pmod("event_id", F.lit(len(known))) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.lit(None).cast("string").alias("id"), code.alias("code"), F.lit("warning").alias("severity"), F.col("event_type").alias("message"),
        F.when(F.col("value") >= 0, F.dayofmonth("ts")).alias("page"), F.lit(None).cast("array<string>").alias("source_ids"), F.when(F.col("event_id") % 2 == 0, "do").when(F.col("event_id") % 3 == 0, "").alias("action"),
    )
    made = recovery.diagnostics(rows).withColumn("fact", recovery.fact(F.col("code"), F.col("message")))
    return made.select("event_id", "id", "fact.category", "fact.title", "fact.message", F.array_join("pages", ",").alias("pages"), recovery.has_actionable(F.col("action")).alias("actionable"), (F.col("category") == F.col("fact.category")).alias("agrees"))


QUERIES = {f.__name__: f for f in (faulty_graphs, caption_links, link_targets, note_links, referred_targets, author_notes, figure_assets, page_columns, list_attributes, recovery_facts)}

# Diagnostic codes by category, in the order in which recovery_facts deals them out.
_CODES = """('text', 'OCR_REQUIRED'), ('text', 'LOW_CONFIDENCE_OCR'), ('text', 'NO_RECONSTRUCTABLE_TEXT'), ('text', 'ISOLATED_PROSE_GLYPH'), ('text', 'INCOMPLETE_TEXT_COVERAGE'),
 ('text', 'UNRESOLVED_CORRUPTING_JOIN'), ('text', 'INCOMPLETE_INLINE_STYLE_COVERAGE'), ('layout', 'AMBIGUOUS_READING_ORDER'), ('layout', 'READING_ORDER_CYCLE'), ('layout', 'FURNITURE_REVIEW_REQUIRED'),
 ('layout', 'FURNITURE_CONTAMINATION'), ('layout', 'UNRESOLVED_FRONT_MATTER'), ('visuals', 'UNRESOLVED_VISUAL_OBJECT'), ('visuals', 'UNREFERENCED_VISUAL_ASSET'), ('visuals', 'AMBIGUOUS_VISUAL_MATCH'),
 ('visuals', 'INCOMPLETE_ASSET_COVERAGE'), ('visuals', 'MISSING_IMAGE_PART'), ('visuals', 'MISSING_IMAGE_CAPTION'), ('tables', 'INCOMPLETE_SEMANTIC_TABLE_COVERAGE'), ('tables', 'BOUNDED_TABLE_FALLBACK'),
 ('equations', 'UNRESOLVED_EQUATION_TRANSCRIPT'), ('links', 'UNRESOLVED_HYPERLINK'), ('links', 'INCOMPLETE_RELATIONSHIP_COVERAGE'), ('links', 'UNRESOLVED_CITATION_REFERENCE'),
 ('links', 'UNRESOLVED_SCHOLARLY_CROSS_REFERENCE'), ('links', 'UNMAPPED_CITATION_ANCHOR'), ('links', 'DANGLING_EPUB_INTERNAL_REFERENCE'), ('notes', 'AMBIGUOUS_NOTE_MATCH'), ('notes', 'UNRESOLVED_NOTE_REFERENCE'),
 ('notes', 'UNREFERENCED_NOTE'), ('notes', 'DANGLING_NOTE_REFERENCE'), ('source', 'SOMETHING_ELSE')"""
_SIDE = "CASE length(event_type) % 4 WHEN 0 THEN 'span' WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'single' END"
ORACLES = {
    "faulty_graphs": f"""WITH v AS (SELECT row_number() OVER () - 1 AS fault, code, path FROM (VALUES {VERDICTS}) t(code, path))
        SELECT doc_id, v.fault, code, path FROM documents JOIN v ON doc_id % (SELECT count(*) FROM v) = v.fault""",
    "caption_links": """WITH h(host_id, host_text) AS (VALUES ('h-0', ''), ('h-1', 'Cap 1'), ('h-2', 'Other')),
        p AS (SELECT l_orderkey AS order_id, 'e-' || l_linenumber AS edge_id, host_id, host_text, 'c-' || l_partkey % 5 AS caption_id, 'Cap ' || l_partkey % 5 AS said
              FROM lineitem JOIN h ON host_id = 'h-' || l_suppkey % 4 WHERE l_linestatus = 'O' AND l_returnflag <> 'A' AND l_partkey % 5 < 4 AND l_orderkey IN (SELECT o_orderkey FROM orders)),
        a AS (SELECT order_id, host_id, count(DISTINCT caption_id) AS n FROM p GROUP BY 1, 2), b AS (SELECT order_id, caption_id, count(DISTINCT host_id) AS m FROM p GROUP BY 1, 2)
        SELECT order_id, host_id, caption_id, edge_id, n = 1 AND m = 1 AND (host_text = '' OR host_text = said) AS ok FROM p JOIN a USING (order_id, host_id) JOIN b USING (order_id, caption_id)""",
    "link_targets": """WITH t AS (SELECT l_orderkey AS order_id, l_linenumber, l_linenumber % 5 AS k, l_partkey % 3 AS n, l_orderkey IN (SELECT o_orderkey FROM orders) AS here FROM lineitem)
        SELECT order_id, l_linenumber, CASE k WHEN 0 THEN '#a-' WHEN 1 THEN 'b-' WHEN 2 THEN 'https://x.example/' WHEN 3 THEN '#b-' ELSE 'mailto:' END || n AS target,
        CASE WHEN k IN (2, 4) THEN 'external' WHEN n = 2 OR NOT here THEN 'unknown' WHEN k = 0 THEN 'asset' WHEN n = 1 THEN 'furniture' ELSE 'block' END AS kind,
        CASE WHEN k = 2 THEN 'https://x.example/' || n WHEN k = 4 THEN 'mailto:' || n WHEN n = 2 OR NOT here THEN NULL WHEN k = 0 THEN 'a-' || n || '.png' ELSE '#b-' || n END AS href FROM t""",
    "note_links": """SELECT e.l_orderkey AS order_id, 'n-' || e.l_partkey % 3 AS note_id, string_agg('r-' || e.l_linenumber, ',' ORDER BY e.l_linenumber) AS edge_ids FROM lineitem e
        WHERE e.l_returnflag <> 'A' AND e.l_suppkey % 3 < 2 AND EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = e.l_orderkey AND r.l_linenumber % 4 > 0 AND r.l_linenumber + 1 = e.l_linenumber AND r.l_linestatus = 'O') GROUP BY 1, 2""",
    "referred_targets": """WITH e AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_returnflag <> 'A' AS matched, CASE l_linenumber % 3 WHEN 0 THEN ['7', '8'] WHEN 1 THEN ['7'] ELSE [] END AS labels FROM lineitem WHERE l_partkey % 4 > 0),
        r AS (SELECT l_orderkey AS order_id, l_linenumber AS line, '#b-' || l_suppkey % 2 AS own, l_orderkey IN (SELECT o_orderkey FROM orders) AS here FROM lineitem WHERE l_linestatus = 'O'),
        j AS (SELECT r.*, coalesce(matched, false) AS matched, coalesce(labels, []) AS labels FROM r LEFT JOIN e USING (order_id, line)),
        t AS (SELECT order_id, line, n, ['a-0', '#b-0', 'c'][n + 1] AS target, labels, here FROM j, (VALUES (0), (1), (2)) v(n) WHERE matched UNION ALL SELECT order_id, line, 0, own, labels, here FROM j WHERE NOT matched)
        SELECT order_id, line, CAST(n AS BIGINT) AS n, target, coalesce(labels[n + 1], CAST(n + 1 AS VARCHAR)) AS label, CASE WHEN here AND target = 'a-0' THEN 'asset' WHEN here AND target = '#b-0' THEN 'block' ELSE 'unknown' END AS kind,
        CASE WHEN here AND target = 'a-0' THEN 'a.png' WHEN here AND target = '#b-0' THEN '#b-0' END AS href FROM t""",
    "author_notes": """SELECT o_orderkey AS order_id, CAST(p AS BIGINT) AS author_pos, author, coalesce(string_agg(l_linenumber || ':n-' || l_linenumber || ':b-' || l_partkey, ',' ORDER BY l_linenumber, 'b-' || l_partkey), '') AS notes
        FROM orders CROSS JOIN (VALUES (0, 'A'), (1, 'B'), (2, 'C')) a(p, author) LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey % 4 = p GROUP BY 1, 2, 3""",
    "figure_assets": """WITH w AS (SELECT l_orderkey AS order_id, l_linenumber AS line, unnest([0, 1, 2]) AS n, unnest([l_partkey % 4, l_suppkey % 4, l_linenumber % 4]) AS k FROM lineitem)
        SELECT order_id, line, string_agg('art/' || k || '.png', ',' ORDER BY n, k) AS hrefs FROM w JOIN orders ON o_orderkey = order_id WHERE k <= order_id % 4 GROUP BY 1, 2""",
    "page_columns": f"""WITH e AS (SELECT user_id, CAST(day(ts) AS BIGINT) AS page, event_id, {_SIDE} AS side, CASE {_SIDE} WHEN 'span' THEN 0 WHEN 'single' THEN 1 WHEN 'left' THEN 2 ELSE 3 END AS r, value FROM events),
        c AS (SELECT user_id, page, r, 'page-' || page || '-' || side || ':' || side || '=' || string_agg(CAST(event_id AS VARCHAR), '+' ORDER BY value, event_id) AS said FROM e GROUP BY user_id, page, r, side)
        SELECT user_id, page, b.blocks, string_agg(said, ';' ORDER BY r) AS columns FROM c JOIN (SELECT user_id, page, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r, value, event_id) AS blocks FROM e GROUP BY 1, 2) b USING (user_id, page) GROUP BY 1, 2, 3""",
    "list_attributes": """WITH k AS (SELECT *, length(text) AS n FROM conversations WHERE role = 'user' OR turn % 5 <> 4), g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS breaks FROM k)
        SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY breaks) - 1 AS BIGINT) AS run, CASE WHEN turn % 3 = 0 THEN n % 4 ELSE 0 END AS level,
        CASE WHEN turn % 4 = 0 THEN n % 2 = 0 WHEN turn % 4 = 1 THEN n % 2 = 1 ELSE false END AS ordered, CASE WHEN n % 7 >= 2 THEN n % 7 - 2 END AS ordinal, role AS list_id, turn % 3 = 0 OR turn % 4 = 0 AS declares_nesting
        FROM g WHERE role = 'user'""",
    "recovery_facts": f"""WITH c AS (SELECT row_number() OVER () - 1 AS k, category, code FROM (VALUES {_CODES}) t(category, code))
        SELECT event_id, code || '-' || CASE WHEN value >= 0 THEN CAST(day(ts) AS VARCHAR) ELSE 'document' END AS id, category, substr(code, 1, 1) || substr(replace(lower(code), '_', ' '), 2) AS title, event_type AS message,
        CASE WHEN value >= 0 THEN CAST(day(ts) AS VARCHAR) ELSE '' END AS pages, event_id % 2 = 0 AS actionable, true AS agrees FROM events JOIN c ON event_id % (SELECT count(*) FROM c) = k""",
}
