"""EPUB packages of decoded documents, and both renderings as DataFrame operations."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources import schema as S
from ..sources.decode import loads
from .mathml import formula
from .xhtml import Unrenderable, attr, packaged, render, text

MOST_BYTES, RESERVE, MOST_CSS = 256 * 1024 * 1024, 64 * 1024, 4 * 1024 * 1024
# The package's style sheet and container, and the order of a receipt's fields in struct.json.
CSS = """body { font-family: serif; line-height: 1.5; margin: 5%; }
img { display: block; height: auto; max-width: 100%; }
table { border-collapse: collapse; width: 100%; }
td, th { border: 1px solid currentColor; padding: 0.25rem; }
figure { break-inside: avoid; margin: 1.5rem 0; }
.visually-hidden, .additional-semantic-reference { clip: rect(0 0 0 0); clip-path: inset(50%); height: 1px; overflow: hidden; position: absolute; white-space: nowrap; width: 1px; }"""
CONTAINER = '<?xml version="1.0" encoding="UTF-8"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml" /></rootfiles></container>'
RECEIPT = "schemaVersion documentId sourceSha256 modelConsultations blockCount assetCount relationshipCount diagnosticCount textCharacterCount conservation generatedSha256".split()

# A reading profile's fields in order, and the schemes that may lead out of a package.
PROFILE = "id version fileName pageProgressionDirection renditionFlow configurationSha256".split()
SCHEMES = ("http", "https", "mailto")


def checked_profile(profile: dict) -> dict:
    """The record of a reading profile that goes into the package; its css is recorded by digest."""
    word = r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}"
    forms = dict(zip(PROFILE, (word, word, word + r"\.epub", "ltr|rtl", "paginated|scrolled-continuous", "[a-f0-9]{64}"), strict=True))
    css = profile.get("css")
    fits = all(isinstance(profile.get(k), str) and re.fullmatch(form, profile[k]) for k, form in forms.items())
    if not fits or not isinstance(css, str) or not css or "\0" in css or len(css.encode()) > MOST_CSS:
        raise Unrenderable("profile is not valid")
    return {"schemaVersion": "1.0.0"} | {k: profile[k] for k in PROFILE} | {"cssSha256": hashlib.sha256(css.encode()).hexdigest()}


def links_of(name: str, markup: bytes) -> tuple[set[str], list[str]]:
    """The ids and the hrefs of a well-formed document."""
    ids, hrefs = [], []

    def start(_tag: str, attributes: dict[str, str]) -> None:
        for key, value in attributes.items():
            {"id": ids, "href": hrefs}.get(key.rpartition(":")[2], []).append(value)

    parser = expat.ParserCreate()
    parser.UseForeignDTD(True)  # named characters are no errors
    parser.StartElementHandler = start
    try:
        parser.Parse(markup, True)
    except expat.ExpatError as e:
        raise Unrenderable(f"{name} is not well-formed") from e
    if len(set(ids)) < len(ids):
        raise Unrenderable(f"{name} repeats an id")
    return set(ids), hrefs


def within(base: str, path: str) -> str | None:
    """A relative path from a document of the package as a path of the package; None if it leads out of it."""
    at = base.split("/")[:-1]
    for part in path.split("/"):
        if part == ".." and not at:
            return None
        at = at[:-1] if part == ".." else at if part == "." else [*at, part]
    return "/".join(at)


def check_links(files: dict[str, bytes], documents: list[str]) -> None:
    """Every href of the documents leads to a file of the package, and to an id in it, or out by a known scheme."""
    known = {d: links_of(d, files[d]) for d in documents}
    for d, (_, hrefs) in known.items():
        for href in hrefs:
            if href != href.strip() or re.search(r"[\\\x00-\x1f\x7f]", href) or href.startswith("/"):
                raise Unrenderable(f"{d} has an unsafe href")
            if scheme := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", href):
                if scheme[1].lower() not in SCHEMES:
                    raise Unrenderable(f"{d} has an href of an unsafe scheme")
                continue
            path, mark, fragment = href.partition("#")
            target = None if "?" in path else within(d, path) if path else d
            if not target:
                raise Unrenderable(f"{d} has an unsafe href")
            if target not in files or mark and fragment not in known.get(target, (set(), []))[0]:
                raise Unrenderable(f"{d} has a dangling reference")


def slug(value: str) -> str:
    plain = unicodedata.normalize("NFKD", value)
    return re.sub(r"^-|-$", "", re.sub(r"[^a-zA-Z0-9]+", "-", plain)).lower() or "publication"


def entries(document: dict, profile: dict | None = None) -> dict[str, bytes]:
    """The package's files, in their order in the archive."""
    record = checked_profile(profile) if profile is not None else None
    if document["recovery"]["status"] != "ready":
        raise Unrenderable("recovery must be reviewed first")
    meta = document["metadata"]
    hrefs = [a["href"] for a in document["assets"]]
    for a in document["assets"]:
        if "bytes" not in a or not packaged(a["id"]) or hrefs.count(a["href"]) > 1:
            raise Unrenderable(f"asset cannot be packaged: {a['id']}")
    language = meta.get("language", "und")
    modified = re.sub(r"\.\d{3}Z$", "Z", meta.get("artifactModifiedAt") or f"{meta.get('updated', '1970-01-01')}T00:00:00Z")
    creators = "\n    ".join(f"<dc:creator>{text(a)}</dc:creator>" for a in meta["authors"])
    items = "\n    ".join(f'<item id="{attr(a["id"])}" href="{attr(a["href"])}" media-type="{attr(a["mediaType"])}" />' for a in document["assets"])
    flow = f'<meta property="rendition:flow">{record["renditionFlow"]}</meta>' if record else ""
    direction = f' page-progression-direction="{record["pageProgressionDirection"]}"' if record else ""
    profiled = '<item id="profile" href="profile.json" media-type="application/json" />' if record else ""
    math = ' properties="mathml"' if any(map(formula, document["blocks"])) else ""
    # The wording of the package and of its navigation, byte for byte.
    package = f"""<?xml version="1.0" encoding="UTF-8"?>
<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="publication-id" xml:lang="{attr(language)}">
  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
    <dc:identifier id="publication-id">{identifier(document, record)}</dc:identifier>
    <dc:title>{text(meta["title"])}</dc:title>
    <dc:language>{text(language)}</dc:language>
    {creators}
    <meta property="dcterms:modified">{text(modified)}</meta>
    {flow}
  </metadata>
  <manifest>
    <item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav" />
    <item id="content" href="content.xhtml" media-type="application/xhtml+xml"{math} />
    <item id="styles" href="styles.css" media-type="text/css" />
    <item id="struct" href="struct.json" media-type="application/json" />
    {profiled}
    {items}
  </manifest>
  <spine{direction}><itemref idref="content" /></spine>
</package>
"""
    headings = "".join(f'<li><a href="content.xhtml#{attr(b["id"])}">{text(b["text"])}</a></li>' for b in document["blocks"] if b["kind"] == "heading")
    nav = (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{attr(language)}"><head><title>Contents</title></head>'
        f'<body><nav epub:type="toc"><h1>Contents</h1><ol><li><a href="content.xhtml">{text(meta["title"])}</a></li>{headings}</ol></nav></body></html>\n'
    )
    source = document["source"] | {"fileName": re.split(r"[\\/]", document["source"]["fileName"])[-1] or "source"}
    receipt = document["receipt"] | {"conservation": in_order(document["receipt"]["conservation"], (S.COUNTERS + " " + S.FURNITURE_COUNTERS).split())}
    origin = {"schemaVersion": document["schemaVersion"], "source": in_order(source, S.SOURCE[1]), "receipt": in_order(receipt, RECEIPT)}
    out = {
        "mimetype": b"application/epub+zip", "META-INF/container.xml": CONTAINER.encode(), "EPUB/package.opf": package.encode(), "EPUB/nav.xhtml": nav.encode(),
        "EPUB/content.xhtml": render(document).encode(), "EPUB/styles.css": (profile["css"] if record else CSS).encode(), "EPUB/struct.json": (json.dumps(origin, ensure_ascii=False, separators=(",", ":")) + "\n").encode(),
    }
    if record:
        out["EPUB/profile.json"] = (json.dumps(record, ensure_ascii=False, separators=(",", ":")) + "\n").encode()
    out |= {f"EPUB/{a['href']}": base64.b64decode(a["bytes"]) for a in document["assets"]}
    if sum(map(len, out.values())) > MOST_BYTES - RESERVE:
        raise Unrenderable("archive is too large")
    inside = {n.removeprefix("EPUB/"): data for n, data in out.items() if n.startswith("EPUB/")}
    check_links(inside, ["nav.xhtml", "content.xhtml", *(a["href"] for a in document["assets"] if a["mediaType"] == "application/xhtml+xml")])
    return out


def in_order(record: dict, names) -> dict:
    return {n: record[n] for n in names if n in record}


def identifier(document: dict, record: dict | None = None) -> str:
    more = f":{record['id']}:{record['version']}:{record['configurationSha256'][:16]}" if record else ""
    return f"urn:sha256:{document['receipt']['generatedSha256']}{more}"


def file_name(document: dict, record: dict | None = None) -> str:
    return record["fileName"] if record else f"{slug(document['metadata']['title'])}-{document['receipt']['generatedSha256'][:12]}.epub"


def archive(files: dict[str, bytes]) -> bytes:
    """A zip with fixed dates, its type first and uncompressed."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in files.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return held.getvalue()


def content_hash(files: dict[str, bytes]) -> str:
    """What does not depend on the compressor: names and digests of the files."""
    return hashlib.sha256("\n".join(f"{n}\0{hashlib.sha256(files[n]).hexdigest()}" for n in sorted(files)).encode()).hexdigest()


def reopened(data: bytes, files: dict[str, bytes]) -> bytes:
    """The archive, once it has been read back and holds just the files."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if len(data) > MOST_BYTES or {n: z.read(n) for n in z.namelist()} != files:
            raise Unrenderable("archive does not hold what was put in")
    return data


def published(decoded: DataFrame, package: bool = False, profile: dict | None = None) -> DataFrame:
    """doc_key, error, xhtml (and with package: epub, file_name, identifier, content_sha256) of valid documents.

    decoded: doc_key and encoded (canonical text), of documents without violations. What cannot be published has an
    error. A reading profile (its record and css) applies to all packages; one that is not valid fails at once.
    """
    record = checked_profile(profile) if profile is not None else None
    fields = [("xhtml", pa.string()), *([("epub", pa.binary()), ("file_name", pa.string()), ("identifier", pa.string()), ("content_sha256", pa.string())] if package else [])]

    def one(raw: str) -> tuple:
        document = loads(raw)
        try:
            if not package:
                return None, render(document)
            files = entries(document, profile)
            return None, files["EPUB/content.xhtml"].decode(), reopened(archive(files), files), file_name(document, record), identifier(document, record), content_hash(files)
        except Unrenderable as e:
            return str(e), *([None] * len(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(raw) for raw in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate([("error", pa.string()), *fields])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_key", "error", *(n for n, _ in fields)])

    kind = dict(decoded.dtypes)["doc_key"]
    shape = f"doc_key {kind}, error string, " + ", ".join(f"{n} {'binary' if n == 'epub' else 'string'}" for n, _ in fields)
    return decoded.filter("code is null").select("doc_key", "encoded").mapInArrow(run, shape)
