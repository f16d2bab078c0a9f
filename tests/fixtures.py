"""Small documents of our own that break one rule at a time."""

import copy

from quirefold.functions.canonical import receipt_digest
from quirefold.sources import schema as S

SHA = "b" * 64


def evidence(page=1):
    return {"confidence": 1, "pages": [page], "boxes": [{"page": page, "x": 0, "y": 0, "width": 5, "height": 5, "rotation": 0}], "sourceIds": ["s-1"]}


def block(i, kind="paragraph", text="Some text", **more):
    return {"id": f"b-{i}", "kind": kind, "text": text, "page": 1, "order": i, "column": "single", "inline": [], "evidence": evidence()} | more


def sealed(doc, **counters):
    """The document with counters and digest that fit it."""
    units = sum(len(b["text"].encode("utf-16-le")) // 2 for b in doc["blocks"])
    furniture = [b for b in doc["blocks"] if b["kind"] == "furniture"]
    n = {"Block": len(doc["blocks"]), "Asset": len(doc["assets"]), "Relationship": len(doc["relationships"]), "Diagnostic": len(doc["diagnostics"]), "TextCharacter": units}
    c = dict.fromkeys(S.COUNTERS.split(), 0) | {f"struct{k}Count": v for k, v in n.items()} | {"sourceTextCharacterCount": units}
    c |= counters
    for k in ("Asset", "Relationship", "Diagnostic"):
        c[f"source{k}Count"] = c[f"accountedSource{k}Count"] = n[k]
    if furniture:
        m = sum(len(b["text"]) for b in furniture)
        c |= dict(zip(S.FURNITURE_COUNTERS.split()[:5], (len(furniture), len(furniture), m, len(furniture), m), strict=True))
    doc["receipt"] = {
        "schemaVersion": doc["schemaVersion"], "documentId": doc["documentId"], "sourceSha256": doc["source"]["sha256"], "blockCount": n["Block"], "assetCount": n["Asset"],
        "relationshipCount": n["Relationship"], "diagnosticCount": n["Diagnostic"], "textCharacterCount": units, "conservation": c, "generatedSha256": SHA,
    }
    doc["receipt"]["generatedSha256"] = receipt_digest(doc)
    return doc


def document():
    blocks = [block(0, "heading", "Title 😀", attributes={"level": 1}), block(1, inline=[{"start": 0, "end": 4, "bold": True}, {"start": 2, "end": 9, "href": "#b-2", "relationshipId": "r-1"}]), block(2, "footnote", "A note"), block(3, "furniture", "Page 1")]
    return sealed({
        "schemaVersion": "0.2.0", "documentId": "doc-1", "source": {"format": "docx", "fileName": "a.docx", "sha256": SHA, "byteLength": 3, "pageCount": 1, "localOnly": True},
        "metadata": {"title": "T", "subtitle": "", "authors": ["Ann"], "abstract": "", "language": "en"}, "blocks": blocks, "assets": [],
        "relationships": [{"id": "r-1", "kind": "footnote", "from": "b-1", "to": ["b-2"], "status": "matched", "confidence": 1, "evidence": evidence()}],
        "pages": [{"page": 1, "width": 600, "height": 800, "rotation": 0, "blocks": [b["id"] for b in blocks], "columns": [{"id": "c-1", "side": "single", "blockIds": [b["id"] for b in blocks]}]}],
        "diagnostics": [{"id": "d-1", "severity": "info", "category": "source", "title": "t", "message": "m", "pages": [1], "sourceIds": []}],
        "recovery": {"status": "ready", "title": "t", "summary": "s", "issues": []},
    })


def changed(change, seal=True):
    doc = copy.deepcopy(document())
    change(doc)
    return sealed(doc) if seal else doc
