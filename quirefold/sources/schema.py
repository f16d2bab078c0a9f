"""The closed schema of a document, as data: what each record holds, in the order in which it is checked.

A record is (required names, optional names, steps); a step is (name, type). Types are the tuples that
quirefold.sources.decode interprets. The first violation in this order is the one that is reported.
"""

from __future__ import annotations

VERSIONS = ("0.1.0", "0.2.0")
LEGACY, CURRENT = VERSIONS

# Fixed values of the enumerations.
SOURCE_FORMATS = "pdf docx html image unknown"
BLOCK_KINDS = "heading paragraph quote list-item figure table equation caption footnote endnote code furniture unknown"
FURNITURE_CLASSES = "repeated-text incrementing-numeral rotated-margin separator-rule explicit-paratext"
BANDS = "top bottom left right"
SEMANTIC_ROLES = "citation cross-reference note-reference affiliation-marker bibliography-entry"
HEADER_SCOPES = "column row colgroup rowgroup"
TABLE_SEMANTICS = "verified source-preserved unresolved"
ASSET_KINDS = "figure diagram table equation page-region unknown"
ASSET_FALLBACKS = "asset source-region text"
EDGE_KINDS = "caption figure table equation footnote endnote citation cross-reference hyperlink reading-order"
EDGE_STATUSES = "matched ambiguous unresolved source-preserved"
SEVERITIES = "info warning error"
CATEGORIES = "text layout visuals tables equations links notes source"
SIDES = "single left right span"
# Fixed resource bounds.
ITEMS, TABLE_SIZE, ASSETS, ASSET_BYTES = 100_000, 100_000, 512, 128 * 1024 * 1024
RECOVERY_ISSUES, RECOVERY_PAGES, STRING_BYTES, OBJECT_KEYS = 10_000, 100_000, 4 * 1024 * 1024, 100_000
# Bounds of a consultation receipt, its keys, and what no key in it may hold.
RECEIPT_VERSION, RECEIPT_DEPTH, RECEIPT_NODES, RECEIPT_STRING_BYTES, RECEIPT_BYTES = "1.0.0", 128, 100_000, 1024 * 1024, 8 * 1024 * 1024
RECEIPT_KEYS = "schemaVersion documentId sourceSha256 consultations decisions metrics semanticStateSha256"
SECRET_KEYS = "apikey authorization credential password privatekey secret token"
# Fixed names of the conservation counters.
COUNTERS = (
    "sourceNodeCount accountedSourceNodeCount sourceRegionCount accountedSourceRegionCount sourceAnnotationCount accountedSourceAnnotationCount "
    "sourceAssetCount accountedSourceAssetCount sourceRelationshipCount accountedSourceRelationshipCount sourceDiagnosticCount "
    "accountedSourceDiagnosticCount sourceTextCharacterCount structBlockCount structAssetCount structRelationshipCount structDiagnosticCount structTextCharacterCount"
)
FURNITURE_COUNTERS = "sourceFurnitureBlockCount accountedFurnitureBlockCount sourceFurnitureTextCharacterCount structFurnitureBlockCount structFurnitureTextCharacterCount furnitureContaminationCount"

TEXT, ID, REF, HREF, HASH, BOOL = ("text",), ("id",), ("ref",), ("href",), ("hash",), ("bool",)
NATURAL, POSITIVE, COUNT1 = ("int", 0), ("int", 1), ("int", 1)
FINITE, SIZE, UNIT, ANGLE = ("number", None), ("number", "positive"), ("number", "unit"), ("angle",)


def enum(values: str) -> tuple:
    return ("enum", tuple(values.split()))


def many(item: tuple, unique: str | None = None, most: int | None = None, of: str | None = None) -> tuple:
    """A list; its items (or their field `of`) are unique if a label for them is given."""
    return ("list", item, unique, most, of)


def maybe(kind: tuple) -> tuple:
    return ("null", kind)


def record(required: str, optional: str = "", *steps: tuple, then: str | None = None) -> tuple:
    """then: the name of a rule over the whole record, in quirefold.sources.decode."""
    return ("record", tuple(required.split()), tuple(optional.split()), steps, then)


PAGES = many(POSITIVE, "page")
IDS = many(ID, "identifier")
BOX = record("page x y width height rotation", "", ("page", POSITIVE), ("x", FINITE), ("y", FINITE), ("width", SIZE), ("height", SIZE), ("rotation", ANGLE))
EVIDENCE = record("confidence pages boxes sourceIds", "signals", ("pages", PAGES), ("sourceIds", IDS), ("confidence", UNIT), ("boxes", many(BOX)), ("signals", many(TEXT)))
MARKS = "href annotationId relationshipId targetIds bold italic code verticalAlign compactMathAtom semanticRole"
RUN = record(
    "start end", MARKS, ("start", NATURAL), ("end", NATURAL), ("", ("rule", "run_range")), ("href", HREF), ("annotationId", ID), ("relationshipId", ID), ("targetIds", IDS),
    ("bold", BOOL), ("italic", BOOL), ("code", BOOL), ("verticalAlign", enum("superscript subscript")), ("compactMathAtom", BOOL), ("semanticRole", enum(SEMANTIC_ROLES)),
)
RUNS = ("runs", many(RUN))
CELL = record(
    "id text row column rowSpan columnSpan headerScope inline evidence", "", ("text", TEXT), ("id", ID), ("row", NATURAL), ("column", NATURAL), ("rowSpan", COUNT1), ("columnSpan", COUNT1),
    ("headerScope", maybe(enum(HEADER_SCOPES))), ("inline", RUNS), ("evidence", EVIDENCE),
)
TABLE = record("rows columns cells semantic", "", ("rows", NATURAL), ("columns", NATURAL), ("", ("rule", "table_size")), ("cells", many(CELL, "table cell id", None, "id")), ("", ("rule", "table_fit")), ("semantic", enum(TABLE_SEMANTICS)))
FURNITURE = record(
    "classification band pages boxes evidence", "normalizedText sequence sourceRunIndexes", ("pages", PAGES), ("classification", enum(FURNITURE_CLASSES)), ("band", enum(BANDS)),
    ("boxes", many(BOX)), ("evidence", many(TEXT)), ("normalizedText", TEXT), ("sequence", many(NATURAL)), ("sourceRunIndexes", many(NATURAL)),
)
REVIEW = record("reason band pages boxes evidence", "", ("pages", PAGES), ("reason", enum("single-occurrence-margin")), ("band", enum(BANDS)), ("boxes", many(BOX)), ("evidence", many(TEXT)))
BLOCK = record(
    "id kind text page order column inline evidence", "label sourceObservationAnchorIds table fallbackAssetIds furniture furnitureReview attributes",
    ("text", TEXT), ("kind", enum(BLOCK_KINDS)), ("attributes", ("attributes",)), ("", ("rule", "heading_level")), ("id", ID), ("label", TEXT), ("page", maybe(POSITIVE)), ("order", NATURAL),
    ("column", maybe(enum(SIDES))), ("inline", RUNS), ("evidence", EVIDENCE), ("sourceObservationAnchorIds", IDS), ("table", TABLE), ("fallbackAssetIds", IDS), ("furniture", FURNITURE), ("furnitureReview", REVIEW),
)
ASSET = record(
    "id kind href mediaType sha256 width height sourceObjectIds evidence fallback", "bytes", ("href", ("package_path",)), ("sha256", HASH), ("bytes", ("bytes",)), ("", ("rule", "bytes_hash")), ("id", ID),
    ("kind", enum(ASSET_KINDS)), ("mediaType", ("mime",)), ("width", SIZE), ("height", SIZE), ("sourceObjectIds", IDS), ("evidence", EVIDENCE), ("fallback", enum(ASSET_FALLBACKS)),
)
CANDIDATE = record("target confidence evidence", "", ("target", REF), ("confidence", UNIT), ("evidence", EVIDENCE))
EDGE = record(
    "id kind from to status confidence evidence", "label candidates", ("candidates", many(CANDIDATE, "candidate target", None, "target")), ("id", ID), ("kind", enum(EDGE_KINDS)), ("from", ID),
    ("to", many(REF, "reference")), ("label", TEXT), ("status", enum(EDGE_STATUSES)), ("confidence", UNIT), ("evidence", EVIDENCE),
)
DIAGNOSTIC = record(
    "id severity category title message pages sourceIds", "action", ("pages", PAGES), ("id", ID), ("severity", enum(SEVERITIES)), ("category", enum(CATEGORIES)), ("title", TEXT), ("message", TEXT), ("action", TEXT), ("sourceIds", IDS),
)
COLUMN = record("id side blockIds", "", ("id", ID), ("side", enum(SIDES)), ("blockIds", IDS))
PAGE = record("page width height rotation blocks columns", "", ("columns", many(COLUMN, "column id", None, "id")), ("page", POSITIVE), ("width", SIZE), ("height", SIZE), ("rotation", ANGLE), ("blocks", IDS))
ISSUE = record("category title count pages", "action", ("pages", PAGES), ("category", enum(CATEGORIES)), ("title", TEXT), ("count", NATURAL), ("action", TEXT))
RECOVERY = record("status title summary issues", "userAction", ("issues", many(ISSUE, None, RECOVERY_ISSUES)), ("status", enum("ready review-required")), ("title", TEXT), ("summary", TEXT), ("userAction", TEXT))
CONSERVATION = record(COUNTERS, FURNITURE_COUNTERS, *((name, NATURAL) for name in (COUNTERS + " " + FURNITURE_COUNTERS).split()))
RECEIPT = record(
    "schemaVersion sourceSha256 blockCount assetCount relationshipCount diagnosticCount textCharacterCount conservation generatedSha256", "documentId modelConsultations",
    ("modelConsultations", ("consultations",)), ("schemaVersion", ("version",)), ("documentId", ID), ("sourceSha256", HASH), ("blockCount", NATURAL), ("assetCount", NATURAL), ("relationshipCount", NATURAL),
    ("diagnosticCount", NATURAL), ("textCharacterCount", NATURAL), ("conservation", CONSERVATION), ("generatedSha256", HASH),
)
SOURCE = record("format fileName sha256 byteLength pageCount localOnly", "", ("format", enum(SOURCE_FORMATS)), ("fileName", TEXT), ("sha256", HASH), ("byteLength", NATURAL), ("pageCount", NATURAL), ("localOnly", BOOL))
NOTE = record("id author label target", "", ("id", ID), ("author", TEXT), ("label", TEXT), ("target", ID))
METADATA = record(
    "title subtitle authors abstract", "language baseDirection publicationDate artifactModifiedAt updated affiliations authorAffiliations authorNotes", ("authors", many(TEXT)), ("title", TEXT), ("subtitle", TEXT),
    ("abstract", TEXT), ("language", ("language",)), ("baseDirection", enum("ltr rtl unknown")), ("publicationDate", ("date",)), ("artifactModifiedAt", ("datetime",)), ("updated", ("date",)),
    ("affiliations", many(TEXT)), ("authorAffiliations", many(record("author label", "", ("author", TEXT), ("label", TEXT)))), ("authorNotes", many(NOTE, "author note id", None, "id")),
)
DOCUMENT = record(
    "schemaVersion source metadata blocks assets relationships pages diagnostics recovery receipt", "documentId", ("schemaVersion", ("version",)),
    ("blocks", many(BLOCK, None, ITEMS)), ("assets", ("assets", ASSET)), ("relationships", many(EDGE, None, ITEMS)), ("pages", many(PAGE, None, ITEMS)), ("diagnostics", many(DIAGNOSTIC, None, ITEMS)),
    ("", ("rule", "ids_by_kind")), ("documentId", ID), ("source", SOURCE), ("metadata", METADATA), ("recovery", RECOVERY), ("receipt", RECEIPT),
)
