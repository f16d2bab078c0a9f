"""The document operators over the driver's tables, and the same in SQL.

The tables are no document graphs; how each is read as one is said with its query. Every query reads its whole
tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.canonical import receipt_digest
from ..functions.text import SAFE_ID_FORMAT, escape_attribute, escape_text, legal_text, safe_id, content_id, utf16_length, utf16_slice
from ..operators import invariants, ordering, reading, recovery
from ..renderers.epub import published
from ..sources import bundle
from ..sources import decode as codec
from ..sources import schema as S
from ..sources.store import spread, stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: UTF-16 units of text, in SQL: code points, and one more for each beyond the first plane.
UNITS = "CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT)"


def content_ids(spark, sf_dir):
    """Content-addressed ids, digests and lengths of documents."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", content_id("doc", t).alias("content_id"), F.sha2(t, 256).alias("digest"), utf16_length(t).alias("units"), F.octet_length(t).cast("long").alias("bytes"))


def duplicate_content(spark, sf_dir):
    """Contents that several documents share, with the first document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def lines(spark, sf_dir) -> DataFrame:
    """Documents as blocks: one per line; a null text is one empty line."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


LINES = "SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"


def block_split(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", content_id("block", F.col("text")).alias("block_id"), utf16_length(F.col("text")).alias("units"))


def conservation_counts(spark, sf_dir):
    """Blocks and text of each document against its declared n_chars: what is accounted never exceeds the source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    per = lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(utf16_length(F.col("text"))).alias("units"))
    return docs.join(per, "doc_id").select("doc_id", "blocks", "units", (F.col("units") + F.col("blocks") - 1 == F.col("n_chars")).alias("conserved"))


def legal_identifiers(spark, sf_dir):
    """Which conversation ids and roles, and page urls, are legal text and safe identifiers."""
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("value"))
    urls = read(spark, sf_dir, "pages").select(F.col("url").alias("value"))
    v = F.col("value")
    return turns.unionByName(urls).groupBy(safe_id(v).alias("safe"), legal_text(v).alias("legal"), F.col("value").startswith("http").alias("url")).count().withColumnRenamed("count", "n")


def recovery_issues(spark, sf_dir):
    """Events as diagnostics of their user: the type in capitals is the code, the day the page, a negative value the automatic recovery."""
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_key"), F.col("event_id").alias("pos"), F.upper("event_type").alias("code"), F.lit("warning").alias("severity"),
        (F.col("value") < 0).alias("automatic"), F.array(F.dayofmonth("ts").cast("long")).alias("pages"),
    )
    return recovery.issues(rows).select(F.col("doc_key").alias("user_id"), "category", "title", F.array_join("pages", ",").alias("pages"), "count", "first_pos")


def recovery_summaries(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_key"), F.col("event_id").alias("pos"), F.upper("event_type").alias("code"), F.lit("warning").alias("severity"),
        F.lit(False).alias("automatic"), F.array(F.dayofmonth("ts").cast("long")).alias("pages"),
    )
    users = rows.groupBy("doc_key").agg((F.count("*") < 10).alias("ready"))
    return recovery.summary(rows, users).select(F.col("doc_key").alias("user_id"), "status", "summary", "issue_count", F.array_join(F.transform("issues", lambda i: i["title"]), ";").alias("titles"))


def dangling_references(spark, sf_dir):
    """References of orders, line items and labels that name nothing, per kind."""
    def lost(rows, column, known, to):
        return invariants.dangling(read(spark, sf_dir, rows).withColumn("doc_key", F.lit(0)), column, read(spark, sf_dir, known).withColumn("doc_key", F.lit(0)), to).select(F.lit(rows).alias("kind"), F.col(column).cast("long").alias("target"))

    return lost("orders", "o_custkey", "customer", "c_custkey").unionByName(lost("lineitem", "l_orderkey", "orders", "o_orderkey")).unionByName(lost("labels", "doc_id", "documents", "doc_id"))


def membership(spark, sf_dir):
    """Documents against labels as sets of ids: which side lacks what."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id").distinct()
    return reading.set_difference(docs, labels, ["doc_id"], ["doc_id"])


def speaker_runs(spark, sf_dir):
    """Unbroken runs of user turns within a conversation."""
    turns = read(spark, sf_dir, "conversations")
    return reading.runs_of(turns, F.col("role") == "user", ["conv_id"], ["turn"]).groupBy("conv_id", "run").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns")).withColumn("run", F.col("run").cast("long"))


def flat_lists(spark, sf_dir):
    """Turns as list items whose list is their role."""
    items = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_key"), F.lit(0).alias("run"), F.col("turn").alias("pos"), F.col("role").alias("list_id"), (F.length("text") % 2 == 0).alias("ordered"), F.lit(False).alias("declares_nesting")
    )
    return reading.flat_lists(items).select(F.col("doc_key").alias("conv_id"), F.col("pos").alias("turn"), F.col("list").cast("long").alias("list"), "ordered")


def inline_segments(spark, sf_dir):
    """Texts with four overlapping runs each, cut into segments with their owners and words."""
    docs = read(spark, sf_dir, "documents").withColumn("text_units", utf16_length(F.col("text")))
    runs = docs.select("doc_id", "text_units", F.posexplode(F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((0, 12), (4, 9), (4, 20), (15, 30))))).alias("run_pos", "r"))
    runs = runs.select("doc_id", "text_units", "run_pos", F.least("r.start", "text_units").alias("start"), F.least("r.end", "text_units").alias("end"))
    cut = reading.segments(runs, ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id")
    return cut.select("doc_id", "start", "end", F.array_join("owners", ",").alias("owners"), F.sha2(utf16_slice(F.col("text"), F.col("start"), F.col("end")), 256).alias("words"))


def sentence_runs(spark, sf_dir) -> DataFrame:
    """Whole texts with a run for each sentence, and one from its middle to the end of the sentence after the next."""
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "part")).withColumn("u", utf16_length(F.col("part")))
    w = W.partitionBy("doc_id")
    placed = parts.withColumn("end", F.sum(F.col("u") + 2).over(w.orderBy("i")) - 2).withColumn("text_units", F.max("end").over(w))
    far = F.lead("end", 2).over(w.orderBy("i"))
    made = F.array(F.struct((2 * F.col("i")).alias("run_pos"), (F.col("end") - F.col("u")).alias("start"), "end"), F.struct((2 * F.col("i") + 1).alias("run_pos"), (F.col("end") - F.col("u") + F.floor(F.col("u") / 2)).alias("start"), far.alias("end")))
    return placed.withColumn("runs", made).select("doc_id", "text_units", F.explode("runs").alias("r")).select("doc_id", "text_units", "r.*").filter("`end` is not null")


def sentence_segments(spark, sf_dir):
    """Whole texts cut where the runs of their sentences start and end."""
    return reading.segments(sentence_runs(spark, sf_dir), ["doc_id"]).select("doc_id", "start", "end", F.array_join("owners", ",").alias("owners"))


def wrapped_segments(spark, sf_dir):
    """The same with the run that wraps each segment: of five runs in a row one refers, two link and two only mark."""
    n = F.col("run_pos") % 5
    facts = {"semanticRole": F.when(n == 0, "citation"), "relationshipId": F.when(n == 0, "r-1"), "href": F.when(n == 1, "#b-1"), "targetIds": F.when(n == 2, F.array(F.lit("b-2")))}
    runs = sentence_runs(spark, sf_dir).withColumns(facts | {"doc_key": F.col("doc_id"), "block_pos": F.lit(0), "cell_pos": F.lit(-1)})
    return reading.segment_owners({"runs": runs}).select(F.col("doc_key").alias("doc_id"), "start", "end", F.col("wrapper").cast("long").alias("wrapper"), "by")


def first_emission(spark, sf_dir):
    """Pages: whether a page is the first of its host."""
    pages = read(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).withColumn("doc_key", F.lit(0))
    return reading.first_emission(pages, [], "host", ["page_id"]).select("page_id", "host", "first")


def layout_order(spark, sf_dir):
    """Events as blocks: the user is the document, the day the page, the type decides the column, value and id the box."""
    kinds = F.pmod(F.length("event_type"), F.lit(4))
    side = F.when(kinds == 0, "span").when(kinds == 1, "left").when(kinds == 2, "right").otherwise("single")
    blocks = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_key"), F.col("event_id").alias("pos"), F.dayofmonth("ts").cast("long").alias("page"), side.alias("column"), F.col("event_id").alias("order"),
        F.struct(F.col("value").alias("y"), F.pmod("event_id", F.lit(7)).cast("double").alias("x")).alias("box"),
    )
    return ordering.order_blocks(blocks).select(F.col("doc_key").alias("user_id"), F.col("pos").alias("event_id"), F.col("place").cast("long").alias("place"))


def escaped_blocks(spark, sf_dir):
    """Lines as escaped XHTML paragraphs, digested."""
    b = lines(spark, sf_dir)
    markup = F.concat(F.lit('<p id="'), escape_attribute(F.concat(F.lit('b"'), F.col("pos").cast("string"))), F.lit('">'), escape_text(F.col("text")), F.lit("</p>"))
    return b.select("doc_id", "pos", F.sha2(markup, 256).alias("markup"))


def running_budget(spark, sf_dir):
    """Documents as assets of their source: bytes so far, and whether they fit 100,000."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_key"), F.col("doc_id").alias("pos"), F.base64(F.col("text").cast("binary")).alias("bytes"))
    return reading.asset_budget(docs, 100_000).select(F.col("doc_key").alias("source"), F.col("pos").alias("doc_id"), F.col("so_far").cast("long").alias("so_far"), "within")


def graphs(spark, sf_dir) -> DataFrame:
    """Documents as sealed document graphs in raw JSON: a heading of the first line, paragraphs of the others."""
    def build(doc_id: int, text: str) -> str:
        proof = {"confidence": 1, "pages": [1], "boxes": [], "sourceIds": []}
        blocks = [{"id": f"b-{i}", "kind": "paragraph" if i else "heading", "text": line, "page": 1, "order": i, "column": "single", "inline": [], "evidence": proof} for i, line in enumerate(text.split("\n"))]
        units, ids = sum(codec.utf16_units(b["text"]) for b in blocks), [b["id"] for b in blocks]
        counters = dict.fromkeys(S.COUNTERS.split(), 0) | {"structBlockCount": len(blocks), "structTextCharacterCount": units, "sourceTextCharacterCount": units}
        doc = {
            "schemaVersion": S.CURRENT, "documentId": f"doc-{doc_id}", "source": {"format": "unknown", "fileName": "", "sha256": "0" * 64, "byteLength": 0, "pageCount": 1, "localOnly": True},
            "metadata": {"title": blocks[0]["text"], "subtitle": "", "authors": [], "abstract": ""}, "blocks": blocks, "assets": [], "relationships": [],
            "pages": [{"page": 1, "width": 1, "height": 1, "rotation": 0, "blocks": ids, "columns": [{"id": "c", "side": "single", "blockIds": ids}]}], "diagnostics": [],
            "recovery": {"status": "ready", "title": "", "summary": "", "issues": []},
            "receipt": {"schemaVersion": S.CURRENT, "documentId": f"doc-{doc_id}", "sourceSha256": "0" * 64, "blockCount": len(blocks), "assetCount": 0, "relationshipCount": 0, "diagnosticCount": 0, "textCharacterCount": units, "conservation": counters},
        }
        doc["receipt"]["generatedSha256"] = receipt_digest(doc)
        return json.dumps(doc, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([build(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], names=["doc_key", "raw"])

    return spread(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").mapInArrow(run, "doc_key long, raw string")


def decoded_graphs(spark, sf_dir):
    """Documents as graphs, decoded and checked: the verdict, blocks and text units of each."""
    decoded = stored(codec.decode(graphs(spark, sf_dir)), "decoded")  # many checks read it
    t = codec.tables(decoded)
    held = t["blocks"].groupBy("doc_key").agg(F.count("*").alias("blocks"), F.sum(utf16_length(F.col("text"))).alias("units"))
    return invariants.verdicts(decoded, t).join(held, "doc_key", "left").select(F.col("doc_key").alias("doc_id"), F.coalesce("code", F.lit("valid")).alias("verdict"), "blocks", "units")


def published_graphs(spark, sf_dir):
    """Documents as graphs, rendered: the digest of each publication's XHTML."""
    out = published(codec.decode(graphs(spark, sf_dir)))
    return out.select(F.col("doc_key").alias("doc_id"), F.sha2("xhtml", 256).alias("xhtml"))


def packaged_graphs(spark, sf_dir):
    """Documents as graphs, packed as EPUB: identifier, file name and content digest. No SQL: the archive is built file by file."""
    out = published(codec.decode(graphs(spark, sf_dir)), package=True)
    return out.select(F.col("doc_key").alias("doc_id"), "error", "identifier", "file_name", "content_sha256", F.octet_length("epub").alias("bytes"))


def bundled_graphs(spark, sf_dir):
    """Documents as graphs, bundled and verified again. No SQL: a bundle is canonical JSON around a digest of itself."""
    made = bundle.bundled(codec.decode(graphs(spark, sf_dir))).select("doc_key", "bundle", "bundle_sha256")
    checked = bundle.verified(stored(made, "bundles"), expected="bundle_sha256")
    return checked.select(F.col("doc_key").alias("doc_id"), F.coalesce("code", F.lit("ok")).alias("verdict"), F.sha2("document", 256).alias("document_sha256"))


QUERIES = {f.__name__: f for f in (
    content_ids, duplicate_content, block_split, conservation_counts, legal_identifiers, recovery_issues, recovery_summaries, dangling_references, membership, speaker_runs, flat_lists,
    inline_segments, sentence_segments, wrapped_segments, first_emission, layout_order, escaped_blocks, running_budget, decoded_graphs, published_graphs, packaged_graphs, bundled_graphs,
)}

_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_XHTML = """SELECT doc_id, sha256('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) ||
    '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="und" lang="und">' || chr(10) || '<head>' || chr(10) || '  <meta charset="utf-8" />' || chr(10) ||
    '  <title>' || min(t) FILTER (pos = 0) || '</title>' || chr(10) || '  <link rel="stylesheet" type="text/css" href="styles.css" />' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) ||
    '  <header><h1>' || min(t) FILTER (pos = 0) || '</h1></header>' || chr(10) || '  ' ||
    string_agg('<' || tag || ' id="b-' || pos || '" data-struct-id="b-' || pos || '">' || t || '</' || tag || '>', chr(10) || '  ' ORDER BY pos) || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS xhtml
    FROM (SELECT doc_id, pos, CASE WHEN pos = 0 THEN 'h2' ELSE 'p' END AS tag, {esc} AS t FROM ({lines})) GROUP BY 1"""

SAFE_SQL = SAFE_ID_FORMAT.replace("'", "''")
_ISSUES = """SELECT user_id, 'source' AS category, upper(substr(w, 1, 1)) || substr(w, 2) AS title, event_id, day(ts) AS page
FROM (SELECT *, replace(lower(event_type), '_', ' ') AS w FROM events{where})"""
_SENTENCES = f"""WITH s AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents)),
        u AS (SELECT doc_id, i, {UNITS} AS u FROM s), e AS (SELECT *, CAST(sum(u + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 AS BIGINT) AS e FROM u),
        r AS (SELECT doc_id, 2 * i AS p, e - u AS s, e FROM e UNION ALL SELECT doc_id, 2 * i + 1, e - u + u // 2, lead(e, 2) OVER (PARTITION BY doc_id ORDER BY i) FROM e), solid AS (SELECT * FROM r WHERE e > s),
        c AS (SELECT DISTINCT doc_id, a FROM (SELECT doc_id, unnest([0, s, e]) AS a FROM solid UNION ALL SELECT doc_id, max(e) FROM e WHERE doc_id IN (SELECT doc_id FROM solid) GROUP BY 1)),
        cut AS (SELECT * FROM (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM c) WHERE b IS NOT NULL)
        """
ORACLES = {
    "content_ids": f"SELECT doc_id, 'struct-doc-' || substr(sha256(text), 1, 24) AS content_id, sha256(text) AS digest, {UNITS} AS units, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "duplicate_content": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "block_split": f"SELECT doc_id, pos, 'struct-block-' || substr(sha256(text), 1, 24) AS block_id, {UNITS} AS units FROM ({LINES})",
    "conservation_counts": f"SELECT d.doc_id, blocks, units, units + blocks - 1 = n_chars AS conserved FROM documents d JOIN (SELECT doc_id, count(*) AS blocks, CAST(sum({UNITS}) AS BIGINT) AS units FROM ({LINES}) GROUP BY 1) USING (doc_id)",
    "legal_identifiers": f"""SELECT regexp_matches(value, '{SAFE_SQL}') AND NOT regexp_matches(value, '(?i)\\A(sk-(proj-)?[a-z0-9._:-]{{8,}}\\z|bearer[.:-]|xox[baprs]-|gh[pousr]_|github_pat_)') AS safe,
        NOT regexp_matches(value, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') AS legal, starts_with(value, 'http') AS url, count(*) AS n
        FROM (SELECT concat_ws(':', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role) AS value FROM conversations UNION ALL SELECT url FROM pages) GROUP BY 1, 2, 3""",
    "recovery_issues": "SELECT user_id, category, title, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, count(DISTINCT page) AS count, min(event_id) AS first_pos FROM (" + _ISSUES.format(where=" WHERE NOT value < 0") + ") GROUP BY 1, 2, 3",
    "recovery_summaries": "WITH i AS (SELECT user_id, title, count(DISTINCT page) AS n, min(event_id) AS first_pos, count(*) AS events FROM (" + _ISSUES.format(where="") + ") GROUP BY 1, 2) "
        "SELECT user_id, CASE WHEN sum(events) < 10 THEN 'ready' ELSE 'review-required' END AS status, sum(n)::BIGINT || ' unresolved recovery ' || CASE WHEN sum(n) = 1 THEN 'issue.' ELSE 'issues.' END AS summary, sum(n)::BIGINT AS issue_count, string_agg(title, ';' ORDER BY first_pos) AS titles FROM i GROUP BY 1",
    "dangling_references": "SELECT 'orders' AS kind, CAST(o_custkey AS BIGINT) AS target FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'labels', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "membership": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS state FROM documents d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "speaker_runs": "SELECT conv_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS BIGINT) AS run, first_turn, turns FROM (SELECT conv_id, g, min(turn) AS first_turn, count(*) AS turns FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) WHERE role = 'user' GROUP BY 1, 2)",
    "flat_lists": "WITH a AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS list FROM a) "
        "SELECT conv_id, turn, CAST(list AS BIGINT) AS list, first_value(length(text) % 2 = 0) OVER (PARTITION BY conv_id, list ORDER BY turn) AS ordered FROM b",
    "inline_segments": f"""WITH d AS (SELECT doc_id, text, {UNITS} AS u FROM documents), r AS (SELECT doc_id, u, p, least(s, u) AS s, least(e, u) AS e FROM d, (VALUES (0, 0, 12), (1, 4, 9), (2, 4, 20), (3, 15, 30)) v(p, s, e)), solid AS (SELECT * FROM r WHERE e > s),
        c AS (SELECT DISTINCT doc_id, unnest([0, u, s, e]) AS a FROM solid), cut AS (SELECT * FROM (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM c) WHERE b IS NOT NULL)
        SELECT cut.doc_id, a AS start, b AS "end", coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY s, -e, p), '') AS owners, sha256(substr(any_value(text), CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))) AS words
        FROM cut JOIN d USING (doc_id) LEFT JOIN solid ON solid.doc_id = cut.doc_id AND s <= a AND e >= b GROUP BY 1, 2, 3""",
    "sentence_segments": _SENTENCES + """SELECT cut.doc_id, a AS start, b AS "end", coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY s, -e, p), '') AS owners
        FROM cut LEFT JOIN solid ON solid.doc_id = cut.doc_id AND s <= a AND e >= b GROUP BY 1, 2, 3""",
    "wrapped_segments": _SENTENCES + """, o AS (SELECT *, CASE p % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS rank FROM solid),
        w AS (SELECT cut.doc_id, a, b, (list(p ORDER BY rank, s, -e, p) FILTER (rank IS NOT NULL))[1] AS wrapper FROM cut LEFT JOIN o ON o.doc_id = cut.doc_id AND s <= a AND e >= b GROUP BY 1, 2, 3)
        SELECT doc_id, a AS start, b AS "end", CAST(wrapper AS BIGINT) AS wrapper, CASE WHEN wrapper % 5 = 0 THEN 'reference' WHEN wrapper IS NOT NULL THEN 'link' END AS by FROM w""",
    "first_emission": "SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) = 1 AS first FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)",
    "layout_order": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day(ts), CASE length(event_type) % 4 WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END, value, event_id % 7, event_id) - 1 AS BIGINT) AS place FROM events",
    "escaped_blocks": f"""SELECT doc_id, pos, sha256('<p id="b&quot;' || pos || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>') AS markup FROM ({LINES})""",
    "published_graphs": _XHTML.format(esc=_ESC, lines=LINES),
    "running_budget": "SELECT source, doc_id, CAST(s AS BIGINT) AS so_far, s <= 100000 AS within FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents)",
    "decoded_graphs": f"SELECT doc_id, CASE WHEN bool_or(regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) THEN 'STRING' ELSE 'valid' END AS verdict, count(*) AS blocks, CAST(sum({UNITS}) AS BIGINT) AS units FROM ({LINES}) GROUP BY 1",
}
