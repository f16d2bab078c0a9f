import hashlib
import json
import zipfile
from io import BytesIO

import pytest

from quirefold.renderers import epub, mathml, xhtml
from quirefold.sources import decode as D
from quirefold.sources import schema as S

from .fixtures import SHA, block, changed, document, sealed

# Frozen digests of three documents' markup and of their packages' contents.
GOLDEN = {
    "typography": ("dca6647dae2ef2daca2505269dd0a3ab0c86d82c9891c9f7bcfdb1f05a2e3c30", "4c71a76c6eae54fa42dc9064369a1b87274476919fb78b86806dcbe4e76eab67"),
    "assets-links": ("01916b4859b1e9d2495cbbf0e18e7fc2313109e9d4050436982e7f0b0cb4f4fa", "e9afb1434ca464a6d367fe03ba233ea564357eced1596a82afac74acbccba365"),
    "order": ("36e097ab8626c2ba7bdfddf7484a4018b12329cd21f644845fd04c2530c2ba6b", "6bef8f24acef00d0fc404caa9a9423a461b1b6ce745bed5ea978a5882fe15289"),
}


def proof():
    return {"confidence": 1, "pages": [1], "boxes": [{"page": 1, "x": 0, "y": 0, "width": 10, "height": 10, "rotation": 0}], "sourceIds": ["s04-source-node"]}


def golden(name):
    # Three documents whose digests are known.
    def b(i, kind, text, inline=(), column="single", **more):
        return {"id": "s04-" + i, "kind": kind, "text": text, "page": 1, "column": column, "inline": list(inline), "evidence": proof()} | more

    def edge(i, kind, a, to, **more):
        return {"id": "s04-rel-" + i, "kind": kind, "from": "s04-" + a, "to": ["s04-" + to], "status": "matched", "confidence": 1, "evidence": proof()} | more

    assets, edges, diagnostics = [], [], []
    if name == "typography":
        title, item = "Typographic baseline", {"attributes": {"ordered": True, "listId": "s04-list"}}
        marks = [{"start": 0, "end": 4, "bold": True}, {"start": 5, "end": 11, "italic": True}, {"start": 12, "end": 17, "verticalAlign": "superscript"}, {"start": 18, "end": 21, "verticalAlign": "subscript"}, {"start": 22, "end": 25, "semanticRole": "citation", "relationshipId": "s04-rel-citation"}]
        blocks = [b("title", "heading", title, attributes={"level": 1}), b("emphasis", "paragraph", "Bold italic super sub end.", marks), b("quote", "quote", "Quoted passage."), b("list-1", "list-item", "First ordered item", **item), b("list-2", "list-item", "Second ordered item", **item), b("code", "code", "const x = 1"), b("footnote", "footnote", "Footnote body text")]
        edges = [edge("citation", "citation", "emphasis", "footnote", label="1")]
    elif name == "assets-links":
        title = "Assets and links baseline"
        links = [{"start": 4, "end": 14, "href": "#s04-figure", "semanticRole": "cross-reference", "relationshipId": "s04-rel-figure"}, {"start": 23, "end": 29, "href": "https://example.org/source"}]
        blocks = [b("figure-intro", "paragraph", "See figure one and the source.", links), b("figure", "figure", "", label="Figure one", fallbackAssetIds=["s04-asset-figure"], attributes={"objectType": "figure"}), b("caption", "caption", "Measured figure caption")]
        data = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A, 0, 0, 0, 1])
        assets = [{"id": "s04-asset-figure", "kind": "figure", "href": "assets/s04-figure.png", "mediaType": "image/png", "sha256": hashlib.sha256(data).hexdigest(), "width": 320, "height": 200, "bytes": "iVBORw0KGgoAAAAB", "sourceObjectIds": ["s04-source-asset"], "evidence": proof(), "fallback": "asset"}]
        edges = [edge("figure", "caption", "caption", "figure")]
    else:
        title = "Reading order baseline"
        blocks = [b(f"{c}-{n}", "paragraph", t, column=c) for c, n, t in (("left", 1, "Left column first."), ("left", 2, "Left column second."), ("right", 1, "Right column first."), ("span", 1, "Spanning paragraph."))]
        diagnostics = [{"id": "s04-diagnostic", "severity": "info", "category": "source", "title": "Fixture diagnostic", "message": "Constructor diagnostic for the S04 fixture.", "pages": [1], "sourceIds": ["s04-source-node"]}]
    for n, x in enumerate(blocks):
        x["order"] = n
    ids = [x["id"] for x in blocks]
    sides = list(dict.fromkeys(x["column"] for x in blocks))
    return sealed({
        "schemaVersion": S.CURRENT, "documentId": "s04-" + name, "source": {"format": "docx", "fileName": "s04-fixture.docx", "sha256": SHA, "byteLength": 4096, "pageCount": 1, "localOnly": True},
        "metadata": {"title": title, "subtitle": "Repeatability fixture", "authors": ["Ada Lovelace", "Grace Hopper"], "abstract": "Frozen S04 renderer baseline fixture.", "language": "en", "baseDirection": "ltr", "publicationDate": "2026-10-20", "artifactModifiedAt": "2026-10-20T00:00:00Z", "updated": "2026-10-20", "affiliations": ["Analytical Engine Laboratory"], "authorAffiliations": [{"author": "Ada Lovelace", "label": "1"}, {"author": "Grace Hopper", "label": "1"}]},
        "blocks": blocks, "assets": assets, "relationships": edges,
        "pages": [{"page": 1, "width": 600, "height": 800, "rotation": 0, "blocks": ids, "columns": [{"id": f"page-1-{s}", "side": s, "blockIds": [x["id"] for x in blocks if x["column"] == s]} for s in sides]}],
        "diagnostics": diagnostics, "recovery": {"status": "ready", "title": "Ready", "summary": "No recovery required", "issues": []},
    }, **{f"{a}{k}Count": len(blocks) for a in ("source", "accountedSource") for k in ("Node", "Annotation")})


BOUNDS = [
    # runs of 1 unit side by side: 1 segment, 1 visit and 64 bytes each
    ("segments", lambda n: ("x" * n, [{"start": i, "end": i + 1, "bold": True} for i in range(n)])),
    # n runs over the same unit: n visits
    ("owner visits", lambda n: ("x", [{"start": 0, "end": 1, "bold": True}] * n)),
    ("events", lambda n: ("x", [{"start": 0, "end": 1, "bold": True}] * (n // 2))),
    ("wrapper bytes", lambda n: ("x", [{"start": 0, "end": 1, "bold": True}] * (n // xhtml.OWNER_BYTES))),
    # numbers in a citation that no label spells
    ("citation matches", lambda n: ("1 " * n, [{"start": 0, "end": 2 * n, "semanticRole": "citation", "relationshipId": "r"}])),
]


@pytest.mark.parametrize(("name", "made"), BOUNDS)
def test_budgets(monkeypatch, name, made):
    """What just reaches a budget is rendered, one step more is not."""
    for other in xhtml.BUDGETS:
        monkeypatch.setitem(xhtml.BUDGETS, other, 640 if other == name else 1 << 40)
    doc = {"blocks": [], "assets": [], "relationships": [], "metadata": {}}
    step = xhtml.OWNER_BYTES if name == "wrapper bytes" else 2 if name == "events" else 1
    assert xhtml.Publication(doc).inline(*made(640))
    with pytest.raises(xhtml.Unrenderable, match=name):
        xhtml.Publication(doc).inline(*made(640 + step))


def test_many_runs():
    """Segments by sweep against a brute force, and 50,000 runs in passable time."""
    runs = [{"start": s, "end": min(600, s + s * 7 % 40 + 300 * (s % 50 == 0)), "n": n} for n, s in enumerate([*range(0, 600, 4), *range(0, 600, 9)])]
    solid = sorted((r for r in runs if r["end"] > r["start"]), key=lambda r: (r["start"], -r["end"]))
    got = [(a, b, list(o)) for a, b, o in xhtml.segments(600, runs)]
    assert [g[0] for g in got] == sorted({0, *(r["start"] for r in solid), *(r["end"] for r in solid)} - {600})
    assert all(o == [r for r in solid if r["start"] <= a and r["end"] >= b] for a, b, o in got)
    assert sum(1 for _ in xhtml.segments(100_000, [{"start": 2 * i, "end": 2 * i + 1} for i in range(50_000)])) == 100_000


@pytest.mark.parametrize("name", GOLDEN)
def test_frozen_markup(name):
    doc, code, path = D.decode_one(json.dumps(golden(name)))
    assert (code, path) == (None, None)
    assert hashlib.sha256(xhtml.render(doc).encode()).hexdigest() == GOLDEN[name][0]


def items(*rows):
    return [dict(zip(("level", "ordered", "list_id", "nested", "ordinal", "block"), (*r, None, n), strict=False)) for n, r in enumerate(rows)]


def shape(lists):
    return [(x["tag"], [(e["item"]["block"], shape(e["lists"])) for e in x["entries"]]) for x in lists]


def test_lists():
    flat = items((0, True, "a", False), (0, False, "a", False), (0, False, "b", False))
    assert shape(xhtml.nested_lists(flat)) == [("ol", [(0, []), (1, [])]), ("ul", [(2, [])])]
    nested = items((0, False, None, True), (1, True, None, True), (1, False, None, True), (0, False, None, True), (2, False, "x", True))
    # the list of another id opens below the last item that was published one level up, wherever that stands
    assert shape(xhtml.nested_lists(nested)) == [("ul", [(0, [("ol", [(1, [])]), ("ul", [(2, [("ul", [(4, [])])])])]), (3, [])])]
    deep = xhtml.nested_lists(items(*[(n, False, None, True) for n in range(40)]))
    depth, at = 0, deep
    while at:
        depth, at = depth + 1, at[0]["entries"][-1]["lists"]
    assert depth == xhtml.DEEPEST_LIST + 1


def test_overlapping_runs_and_surrogates():
    p = xhtml.Publication(document())
    out = p.inline("a😀bc", [{"start": 0, "end": 3, "bold": True}, {"start": 1, "end": 4, "code": True}])
    assert out == "<strong>a</strong><code><strong>😀</strong></code><code>b</code>c"


def test_what_cannot_be_published():
    captions = [block(4, "figure", "Own text"), block(5, "caption", "Other text")]
    edge = {"id": "r-2", "kind": "caption", "from": "b-4", "to": ["b-5"], "status": "matched", "confidence": 1, "evidence": proof()}

    def add(doc):
        doc["blocks"] += captions
        doc["relationships"].append(edge)

    with pytest.raises(xhtml.Unrenderable):
        xhtml.render(changed(add))
    captions[0]["text"] = ""
    assert '<figcaption id="b-5" data-struct-id="b-5" data-relationship-id="r-2">Other text</figcaption>' in xhtml.render(changed(add))


def test_packages(spark):
    names = list(GOLDEN)
    rows = [(n, json.dumps(golden(n))) for n in names] + [("review", json.dumps(changed(lambda d: d["recovery"].update(status="review-required"))))]
    decoded = D.decode(spark.createDataFrame(rows, "doc_key string, raw string"))
    got = {r.doc_key: r for r in epub.published(decoded, package=True).collect()}
    assert [got[n].content_sha256 for n in names] == [GOLDEN[n][1] for n in names]
    with zipfile.ZipFile(BytesIO(got["order"].epub)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.read("EPUB/content.xhtml").decode() == got["order"].xhtml
    assert got["review"].error and got["review"].epub is None and got["order"].file_name == f"reading-order-baseline-{golden('order')['receipt']['generatedSha256'][:12]}.epub"


MATH = "http://www.w3.org/1998/Math/MathML"


@pytest.mark.parametrize("value", ["<math><mi>x</mi></math>", "<math\ndisplay='block'><mn>1</mn><!-- one --></math>", f'<m:math xmlns:m="{MATH}"><m:mi xml:lang="en">x</m:mi></m:math>'])
def test_formula_gets_its_namespace(value):
    at = 1 + len(value[1:].split(">")[0].split()[0])
    assert mathml.mathml(value) == f'{value[:at]} xmlns="{MATH}"{value[at:]}'


def test_formulas():
    own = f'<math xmlns="{MATH}"><mfrac><mi>a</mi><mi>b</mi></mfrac></math>'
    assert mathml.mathml(own) == own
    refused = (
        "", "x", "<math/>", " <math></math>", "<math></math> ", "<mrow></mrow>", "<math><script/></math>", "<math><mi href='x'/></math>", "<math><mi STYLE='x'/></math>", "<math><mi onclick='x'/></math>",
        "<math><mi></math>", "<math></math><math></math>", "<?xml version='1.0'?><math></math>", "<!DOCTYPE math><math></math>", "<math><?a b?></math>", "<math></math><!-- c -->", "<!-- c --><math></math>",
        "<math xmlns='http://www.w3.org/1999/xhtml'></math>", "<m:math></m:math>", "<math><mi xmlns=''/></math>", "<math><mi xml:base='x'/></math>", f"<math><mi xmlns:m='{MATH}' m:id='x'/></math>", "<math>&nbsp;</math>",
    )
    assert [v for v in refused if mathml.mathml(v) is not None] == []


def test_equation_and_profile():
    def add(doc):
        doc["blocks"].append(block(4, "equation", "x over y", attributes={"mathml": "<math><mi>x</mi></math>"}))

    doc = changed(add)
    assert '<figure id="b-4" data-struct-id="b-4" class="equation">' in xhtml.render(doc)
    assert f'<math xmlns="{MATH}"><mi>x</mi></math><figcaption>x over y</figcaption></figure>' in xhtml.render(doc)
    profile = {"id": "wide", "version": "1", "fileName": "wide.epub", "pageProgressionDirection": "rtl", "renditionFlow": "paginated", "configurationSha256": "c" * 64, "css": "p{}"}
    files = epub.entries(doc, profile)
    opf = files["EPUB/package.opf"].decode()
    assert 'media-type="application/xhtml+xml" properties="mathml" />' in opf and '<spine page-progression-direction="rtl">' in opf and '<meta property="rendition:flow">paginated</meta>' in opf
    assert list(files)[-1] == "EPUB/profile.json" and json.loads(files["EPUB/profile.json"]) == {"schemaVersion": "1.0.0"} | {k: v for k, v in profile.items() if k != "css"} | {"cssSha256": hashlib.sha256(b"p{}").hexdigest()}
    assert files["EPUB/styles.css"] == b"p{}" and epub.identifier(doc, epub.checked_profile(profile)).endswith(":wide:1:" + "c" * 16)
    for wrong in ({"id": "-"}, {"fileName": "wide.zip"}, {"css": ""}, {"css": "\0"}, {"renditionFlow": "auto"}, {"version": "1\n"}, {"configurationSha256": None}):
        with pytest.raises(xhtml.Unrenderable):
            epub.entries(doc, profile | wrong)


def test_links_of_a_package():
    def check(body, **more):
        epub.check_links({"d/a.xhtml": f"<html>{body}</html>".encode(), "b.xhtml": b"<p id='x'/>"} | more, ["d/a.xhtml", "b.xhtml"])

    check("<a href='../b.xhtml#x'/><a href='./../b.xhtml'/><a id='y' href='#y'/><a href='HTTPS://e.org/#q'/><b>&nbsp;</b>")
    for body in ("<a href='../b.xhtml#y'/>", "<a href='#'/>", "<a href='/b.xhtml'/>", "<a href='../../b.xhtml'/>", "<a href='c.xhtml'/>", "<a href='javascript:x'/>", "<a href='b?c'/>", "<a href=' #y'/>", "<i id='q'/><b id='q'/>", "<b>", "<a href='a\\b'/>", "<a href='//e.org'/>"):
        with pytest.raises(xhtml.Unrenderable):
            check(body)


def test_long_nested_lists():
    """Ten thousand items of changing levels and kinds stay linear, and every item is published once, in order of its list."""
    rows = [(n * n % 11, n % 5 == 0, "a" if n % 1000 else "b", True) for n in range(10_000)]
    places = xhtml.list_places(items(*rows))
    assert all(holder is None or holder < n for n, (_, holder) in enumerate(places))

    def walk(lists):
        for x in lists:
            for e in x["entries"]:
                yield e["item"]["block"]
                yield from walk(e["lists"])

    assert sorted(walk(xhtml.nested_lists(items(*rows)))) == list(range(10_000))
