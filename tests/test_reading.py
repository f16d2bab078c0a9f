import json

from pyspark.sql import functions as F

from quirefold.operators import ordering, reading, recovery
from quirefold.renderers import xhtml
from quirefold.sources import decode as D

from .fixtures import block, changed, evidence


def graph():
    asset = {"id": "art", "kind": "figure", "href": "art.png", "mediaType": "image/png", "sha256": "c" * 64, "width": 1, "height": 1, "sourceObjectIds": [], "evidence": evidence(), "fallback": "asset"}

    def edge(i, kind, a, *to, status="matched"):
        return {"id": i, "kind": kind, "from": a, "to": list(to), "status": status, "confidence": 1, "evidence": evidence()}

    def change(doc):
        doc["assets"] = [asset]
        doc["blocks"] += [
            block(4, "figure", "", fallbackAssetIds=["art", "lost"]), block(5, "caption", "One"), block(6, "figure", ""), block(7, "caption", "Two"),
            block(8, "list-item", "a", attributes={"listLevel": 1, "listOrdinal": -2, "listId": "x"}), block(9, "furniture", "f"), block(10, "list-item", "b", attributes={"ordered": True, "listLevel": 0.5}),
            block(11), block(12, "list-item", "c", attributes={"listOrdered": False, "ordered": True}),
        ]
        doc["blocks"][1]["inline"][1]["semanticRole"] = "note-reference"
        doc["relationships"] += [edge("c-1", "caption", "b-4", "#b-5"), edge("c-2", "caption", "b-6", "b-5", "b-7"), edge("r-9", "footnote", "b-1", "b-2"), edge("c-3", "caption", "b-6", "b-7", status="ambiguous")]

    return changed(change)


def test_graph(spark):
    doc, code, path = D.decode_one(json.dumps(graph()))
    assert code is None, path
    t = D.tables(D.decode(spark.createDataFrame([(1, json.dumps(graph()))], "doc_key long, raw string")).cache())
    captions = {(r.host_id, r.caption_id): r.ok for r in reading.attached_captions(t).collect()}
    assert captions == {("b-4", "b-5"): False, ("b-6", "b-5"): False, ("b-6", "b-7"): False}  # b-5 has two hosts, b-6 two captions
    assert [(r.block_pos, r.hrefs) for r in reading.figure_artwork(t).collect()] == [(4, ["art.png"])]
    assert [(r.note_id, r.edge_ids) for r in reading.note_backlinks(t).collect()] == [("b-2", ["r-1"])]  # nothing carries r-9
    wanted = spark.createDataFrame([(1, x) for x in ("#b-1", "art", "b-3", "https://a.example/", "zzz")], "doc_key long, target string")
    got = {r.target: (r.kind, r.href) for r in reading.resolved_targets(wanted, t).collect()}
    assert got == {"#b-1": ("block", "#b-1"), "art": ("asset", "art.png"), "b-3": ("furniture", "#b-3"), "https://a.example/": ("external", "https://a.example/"), "zzz": ("unknown", None)}
    items = {r.id: r for r in reading.list_items(t["blocks"]).collect()}
    assert [(items[i].run, items[i].level, items[i].ordered, items[i].ordinal, items[i].declares_nesting) for i in ("b-8", "b-10", "b-12")] == [(0, 1, False, None, True), (0, 0, True, None, False), (1, 0, False, None, True)]
    assert reading.flat_lists(reading.list_items(t["blocks"])).count() == 0  # both runs declare nesting


def test_wrappers_references_and_notes(spark):
    """The table operators against the renderer's choice on a document with every kind of run."""
    def change(doc):
        doc["metadata"] |= {"authors": ["Ann", "Bob"], "authorNotes": [{"id": f"n-{i}", "label": x, "author": "Bob", "target": "b-2"} for i, x in enumerate("*+")]}
        doc["blocks"][1] |= {"text": "one two three four", "inline": [
            {"start": 0, "end": 18, "bold": True}, {"start": 0, "end": 7, "href": "https://a.example/"}, {"start": 4, "end": 13, "semanticRole": "citation", "relationshipId": "r-1"},
            {"start": 8, "end": 18, "targetIds": ["b-0"]}, {"start": 14, "end": 18, "semanticRole": "cross-reference", "relationshipId": "r-2", "targetIds": ["b-0"]},
        ]}
        doc["relationships"][0] |= {"kind": "citation", "to": ["b-2", "#b-0"], "label": "7, "}
        doc["relationships"].append(doc["relationships"][0] | {"id": "r-2", "status": "ambiguous", "to": [], "candidates": []})

    raw = json.dumps(changed(change))
    doc, code, path = D.decode_one(raw)
    assert code is None, path
    t = D.tables(D.decode(spark.createDataFrame([(1, raw)], "doc_key long, raw string")).cache())
    got = [(r.start, r.end, r.wrapper, r.by) for r in reading.segment_owners(t).orderBy("start").collect()]
    assert got == [(0, 4, 1, "link"), (4, 7, 2, "reference"), (7, 8, 2, "reference"), (8, 13, 2, "reference"), (13, 14, 3, "link"), (14, 18, 4, "reference")]
    runs = doc["blocks"][1]["inline"]
    for start, end, wrapper, _ in got:  # the renderer's segments and owners
        owners = next(o for a, b, o in xhtml.segments(18, runs) if (a, b) == (start, end))
        assert wrapper == runs.index(next((r for r in owners if r.get("relationshipId")), None) or next(r for r in owners if r.get("href") or r.get("targetIds")))
    refs = sorted((r.run_pos, r.n, r.target, r.label, r.kind, r.href) for r in reading.reference_targets(t).collect())
    assert refs == [(2, 0, "b-2", "7", "block", "#b-2"), (2, 1, "#b-0", "2", "block", "#b-0"), (4, 0, "b-0", "7", "block", "#b-0")]
    notes = {r.author: [(n.label, n.id, n.target) for n in r.notes] for r in reading.notes_by_author(t).collect()}
    assert notes == {"Ann": [], "Bob": [("*", "n-0", "b-2"), ("+", "n-1", "b-2")]}


def test_order_and_layouts(spark):
    box = lambda y, x=0.0: {"y": float(y), "x": float(x)}
    rows = [
        (1, 0, "r", 1, "right", 0, box(1)), (1, 1, "l2", 1, "left", 1, box(9)), (1, 2, "s", 1, "span", 2, box(50)), (1, 3, "l1", 1, "left", 3, box(2)), (1, 4, "none", None, None, 9, None),
        (1, 5, "m2", 2, None, 8, None), (1, 6, "m1", 2, "single", 7, box(3)), (2, 0, "a", 1, None, 0, box(1, 5)), (2, 1, "b", 1, "single", 1, box(1, 4)),
    ]
    blocks = spark.createDataFrame(rows, "doc_key long, pos long, id string, page long, column string, order long, box struct<y:double,x:double>")
    placed = {(r.doc_key, r.place): r.id for r in ordering.order_blocks(blocks).collect()}
    assert [placed[1, n] for n in range(7)] == ["s", "l1", "l2", "r", "m1", "m2", "none"] and [placed[2, n] for n in range(2)] == ["b", "a"]
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_key long, page long")
    made = {r.page: r for r in ordering.page_layouts(pages, blocks).collect()}
    assert made[1].blocks == ["s", "l1", "l2", "r"] and [(c.id, c.side, c.blockIds) for c in made[1].columns] == [("page-1-span", "span", ["s"]), ("page-1-left", "left", ["l1", "l2"]), ("page-1-right", "right", ["r"])]
    assert made[3].blocks == [] and made[3].columns == []


def test_recovery(spark):
    rows = [
        ("d", 0, "OCR_REQUIRED", "error", False, [2, 1]), ("d", 1, "OCR_REQUIRED", "error", None, [2]), ("d", 2, "UNRESOLVED_NOTE_REFERENCE", "warning", False, []), ("d", 3, "UNRESOLVED_NOTE_REFERENCE", "warning", False, []),
        ("d", 4, "ODD_CODE", "info", False, [9]), ("d", 5, "ODD_CODE", "error", True, [9]), ("e", 0, "ODD_CODE", "error", False, [4]),
    ]
    diagnostics = spark.createDataFrame(rows, "doc_key string, pos long, code string, severity string, automatic boolean, pages array<long>")
    documents = spark.createDataFrame([("d", False), ("e", True), ("f", True)], "doc_key string, ready boolean")
    got = {r.doc_key: r for r in recovery.summary(diagnostics, documents).collect()}
    assert [(i.category, i.title, i["count"], i.pages) for i in got["d"].issues] == [("text", "Ocr required", 2, [1, 2]), ("notes", "Unresolved note reference", 1, [])]
    assert [got[k].summary for k in "def"] == ["3 unresolved recovery issues.", "1 unresolved recovery issue.", "No unresolved recovery issues."]
    assert (got["d"].status, got["f"].status) == ("review-required", "ready")
    only = recovery.summary(diagnostics, documents, blocking=["ODD_CODE"]).filter("doc_key = 'd'").first()
    assert only.issue_count == 0
    own = recovery.diagnostics(spark.createDataFrame([(None, "OCR_REQUIRED", "error", "m", None, None), ("x", "Y", "info", "m", 3, ["s"])], "id string, code string, severity string, message string, page long, source_ids array<string>"))
    assert [(r.id, r.category, r.pages) for r in own.collect()] == [("OCR_REQUIRED-document", "text", []), ("x", "source", [3])]
    assert own.select(recovery.has_actionable(F.lit("")).alias("a"), recovery.has_actionable(F.lit("do")).alias("b")).first() == (False, True)


def test_segments(spark):
    rows = [(1, 10, 0, 2, 6), (1, 10, 1, 2, 4), (1, 10, 2, 5, 9), (1, 10, 3, 3, 3), (2, 4, 0, 0, 4)]
    runs = spark.createDataFrame(rows, "k long, text_units long, run_pos int, start long, end long")
    got = sorted((r.k, r.start, r.end, r.owners) for r in reading.segments(runs, ["k"]).collect())
    assert got == [(1, 0, 2, []), (1, 2, 4, [0, 1]), (1, 4, 5, [0]), (1, 5, 6, [0, 2]), (1, 6, 9, [2]), (1, 9, 10, []), (2, 0, 4, [0])]


def test_segments_over_a_whole_text(spark):
    """Many overlapping and far-apart runs, against a brute force."""
    rows = [(k, 600, p, s, min(600, s + 1 + s * 7 % 40 + 300 * (p % 50 == 0))) for k in range(3) for p, s in enumerate(range(k, 600, 4))]
    runs = spark.createDataFrame(rows, "k int, text_units long, run_pos int, start long, end long")
    got = sorted((r.k, r.start, r.end, r.owners) for r in reading.segments(runs, ["k"]).collect())
    want = []
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        cuts = sorted({0, 600, *(r[3] for r in own), *(r[4] for r in own)})
        for s, e in zip(cuts, cuts[1:], strict=False):
            want.append((k, s, e, [r[2] for r in sorted(own, key=lambda r: (r[3], -r[4], r[2])) if r[3] <= s and r[4] >= e]))
    assert got == want and len(got) > 400
