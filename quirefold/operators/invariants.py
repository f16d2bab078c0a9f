"""What must hold between the parts of a decoded document, as anti-joins, aggregates and set comparisons.

Every check is a query over the child tables that emits all of its violations as (doc_key, rank, code, path).
rank is an array of longs: its first place is the family of checks, the rest the position within the document, so
the least rank is the violation that is met first. All joins carry doc_key; a table repartitioned by doc_key
once serves them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import safe_id, utf16_length
from ..sources import schema as S

VERSION, BINDING, COUNTS, NAMES, LINKS, PAGES, CONSULTED, DIGEST = range(1, 9)


def violation(df: DataFrame, code: str, path: Column | str, *rank: Column | int) -> DataFrame:
    places = [(F.lit(r) if isinstance(r, int) else r).cast("long") for r in rank]
    return df.select("doc_key", F.array(*places).alias("rank"), F.lit(code).alias("code"), (F.lit(path) if isinstance(path, str) else path).alias("path"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dangling(rows: DataFrame, column: str, known: DataFrame, to: str = "id") -> DataFrame:
    """Rows whose column names nothing in known, within the document."""
    return rows.join(known.select("doc_key", F.col(to).alias(column)), ["doc_key", column], "left_anti")


def nodes(t: dict[str, DataFrame]) -> DataFrame:
    return t["blocks"].select("doc_key", "id").unionByName(t["assets"].select("doc_key", "id"))


def bindings(t: dict[str, DataFrame]) -> DataFrame:
    d = t["documents"].select("doc_key", "doc.*")
    legacy, bound = F.col("schemaVersion") == S.LEGACY, F.col("documentId").isNotNull()
    consulted = F.col("receipt.modelConsultations")
    return _all([
        violation(d.filter("receipt.schemaVersion <> schemaVersion"), "SCHEMA_VERSION", "$.receipt.schemaVersion", VERSION, 0),
        violation(d.filter("receipt.sourceSha256 <> source.sha256"), "BINDING", "$.receipt.sourceSha256", BINDING, 0),
        violation(d.filter(legacy & (bound | F.col("receipt.documentId").isNotNull() | consulted.isNotNull())), "MIGRATION", "$", BINDING, 1),
        violation(d.filter(~legacy & ~(bound & F.coalesce(F.col("receipt.documentId") == F.col("documentId"), F.lit(False)))), "BINDING", "$.documentId", BINDING, 1),
        violation(
            d.filter(consulted.isNotNull() & ~(F.get_json_object(consulted, "$.documentId").eqNullSafe(F.col("documentId")) & F.get_json_object(consulted, "$.sourceSha256").eqNullSafe(F.col("source.sha256")))),
            "BINDING", "$.receipt.modelConsultations", CONSULTED, 0),
        violation(t["documents"].filter(~F.array_contains("digests", F.col("doc.receipt.generatedSha256"))), "DIGEST", "$.receipt.generatedSha256", DIGEST, 0),
    ])


def conservation(t: dict[str, DataFrame]) -> DataFrame:
    """Counts of what the document holds against its receipt's counters."""
    furniture = F.col("kind") == "furniture"
    units = utf16_length(F.col("text"))
    text = t["blocks"].groupBy("doc_key").agg(
        F.count("*").alias("n_blocks"), F.sum(units).alias("units"), F.count_if(furniture).alias("n_furniture"), F.sum(F.when(furniture, units).otherwise(0)).alias("furniture_units")
    )
    d = t["documents"].select("doc_key", F.col("doc.receipt").alias("r"), F.col("doc.receipt.conservation").alias("c"), *(F.size(f"doc.{name}").cast("long").alias(n) for name, n in (("assets", "n_assets"), ("relationships", "n_edges"), ("diagnostics", "n_diagnostics"))))
    d = d.join(text, "doc_key", "left").na.fill(0, ["n_blocks", "units", "n_furniture", "furniture_units"])
    at, c = "$.receipt.conservation", lambda n: F.col(f"c.{n}")
    checks: list[tuple[Column, str, str]] = [
        ((F.col("r.blockCount") != F.col("n_blocks")) | (F.col("r.assetCount") != F.col("n_assets")) | (F.col("r.relationshipCount") != F.col("n_edges")) | (F.col("r.diagnosticCount") != F.col("n_diagnostics")), "COUNT", "$.receipt"),
        (F.col("r.textCharacterCount") != F.col("units"), "COUNT", "$.receipt.textCharacterCount"),
        (F.col("r.textCharacterCount") != c("sourceTextCharacterCount"), "COUNT", f"{at}.sourceTextCharacterCount"),
    ]
    held = {"Block": "n_blocks", "Asset": "n_assets", "Relationship": "n_edges", "Diagnostic": "n_diagnostics", "TextCharacter": "units"}
    checks += [(c(f"struct{k}Count") != F.col(n), "COUNT", f"{at}.struct{k}Count") for k, n in held.items()]
    checks += [(c(f"accountedSource{k}Count") > c(f"source{k}Count"), "CONSERVATION", f"{at}.accountedSource{k}Count") for k in ("Node", "Region", "Annotation", "Asset", "Relationship", "Diagnostic")]
    checks += [(c(f"accountedSource{k}Count") != F.col(held[k]), "CONSERVATION", f"{at}.accountedSource{k}Count") for k in ("Asset", "Relationship", "Diagnostic")]
    checks.append((c("structTextCharacterCount") > c("sourceTextCharacterCount"), "CONSERVATION", f"{at}.structTextCharacterCount"))
    five = S.FURNITURE_COUNTERS.split()[:5]
    given = sum((c(n).isNotNull().cast("int") for n in five), F.lit(0))
    every = given == 5
    source_blocks, accounted, source_text, own_blocks, own_text = (c(n) for n in five)
    checks += [
        ((given > 0) & ~every, "CONSERVATION", at),
        (every & (accounted > source_blocks), "CONSERVATION", f"{at}.accountedFurnitureBlockCount"),
        (every & ((own_blocks != F.col("n_furniture")) | (accounted != F.col("n_furniture"))), "CONSERVATION", f"{at}.structFurnitureBlockCount"),
        (every & (own_text != F.col("furniture_units")), "CONSERVATION", f"{at}.structFurnitureTextCharacterCount"),
        (every & (own_text > source_text), "CONSERVATION", f"{at}.structFurnitureTextCharacterCount"),
        ((given == 0) & (F.col("n_furniture") > 0), "CONSERVATION", at),
        (c("furnitureContaminationCount") > c("sourceTextCharacterCount"), "CONSERVATION", f"{at}.furnitureContaminationCount"),
    ]
    # one pass over the documents: the checks that fail, as an array
    failed = F.array(*(F.when(test, F.struct(F.array(F.lit(COUNTS).cast("long"), F.lit(i).cast("long")).alias("rank"), F.lit(code).alias("code"), F.lit(path).alias("path"))) for i, (test, code, path) in enumerate(checks)))
    return d.select("doc_key", F.explode(F.array_compact(failed)).alias("v")).select("doc_key", "v.*")


def repeated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of their keys."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy("doc_key", *keys).orderBy(*order))).filter("_nth > 1").drop("_nth")


def names(t: dict[str, DataFrame]) -> DataFrame:
    """Identifiers are unique across kinds; an author note may share that of a matched foot- or endnote that points where it does."""
    authors = t["documents"].select("doc_key", F.posexplode("doc.metadata.authors").alias("pos", "author"))
    ids = [t[k].select("doc_key", F.lit(i).alias("kind"), F.lit(-1).alias("pos"), F.lit(f"$.{path}").alias("path"), "id", F.lit(False).alias("lone")) for i, (k, path) in enumerate((("blocks", "blocks"), ("assets", "assets"), ("edges", "relationships"), ("diagnostics", "diagnostics")), 1)]
    shared = (
        t["edges"].filter(F.col("status").eqNullSafe("matched") & F.col("kind").isin("footnote", "endnote"))
        .select("doc_key", "id", F.explode("to").alias("target")).distinct()
    )
    lone = t["notes"].join(shared, ["doc_key", "id", "target"], "left_anti")
    ids.append(lone.select("doc_key", F.lit(5).alias("kind"), "pos", F.concat(F.lit("$.metadata.authorNotes["), F.col("pos"), F.lit("].id")).alias("path"), "id", F.lit(True).alias("lone")))
    ids.append(t["blocks"].select("doc_key", F.lit(6).alias("kind"), F.lit(-1).alias("pos"), F.lit("$.blocks.sourceObservationAnchorIds").alias("path"), F.explode("sourceObservationAnchorIds").alias("id"), F.lit(False).alias("lone")))
    ids.append(t["documents"].filter("doc.documentId is not null").select("doc_key", F.lit(7).alias("kind"), F.lit(-1).alias("pos"), F.lit("$.documentId").alias("path"), F.col("doc.documentId").alias("id"), F.lit(False).alias("lone")))
    unknown = dangling(t["notes"].withColumnRenamed("author", "name"), "name", authors.withColumnRenamed("author", "name"), "name")
    return _all([
        violation(repeated(authors, ["author"], ["pos"]).select("doc_key").distinct(), "DUPLICATE_IDENTIFIER", "$.metadata.authors", NAMES, 0),
        violation(repeated(_all(ids), ["id"], ["kind", "pos"]), "DUPLICATE_IDENTIFIER", F.col("path"), NAMES, F.col("kind"), 2 * F.col("pos") + 1),
        violation(unknown, "REFERENCE", F.concat(F.lit("$.metadata.authorNotes["), F.col("pos"), F.lit("].author")), NAMES, 5, 2 * F.col("pos")),
        violation(repeated(t["assets"], ["href"], ["pos"]).select("doc_key").distinct(), "DUPLICATE_IDENTIFIER", "$.assets", NAMES, 8),
    ])


def at(template: str, *columns: str) -> Column:
    """A path with the columns in place of its blanks."""
    return F.format_string(template, *[F.col(c) for c in columns])


def links(t: dict[str, DataFrame]) -> DataFrame:
    """Local references name what exists."""
    known, edges, blocks = nodes(t), t["edges"], t["blocks"].select("doc_key", "id")
    local = lambda df, c: df.withColumn("local", F.regexp_replace(c, "^#", "")).filter(safe_id(F.col("local")))
    runs = t["runs"]
    where = F.when(F.col("cell_pos") < 0, at("$.blocks[%d].inline[%d]", "block_pos", "run_pos")).otherwise(at("$.blocks[%d].table.cells[%d].inline[%d]", "block_pos", "cell_pos", "run_pos"))
    runs = runs.withColumn("where", where)
    targets = runs.select("doc_key", "block_pos", "cell_pos", "run_pos", "where", F.posexplode("targetIds").alias("pos", "target"))
    fallbacks = t["blocks"].select("doc_key", F.col("pos").alias("block_pos"), F.posexplode("fallbackAssetIds").alias("pos", "asset"))
    members = t["page_columns"].select("doc_key", "page_pos", "column_pos", F.posexplode("blockIds").alias("pos", "block_id"))
    place = lambda *c: [F.col(x) for x in c]
    return _all([
        violation(dangling(edges, "from", known), "REFERENCE", at("$.relationships[%d].from", "pos"), LINKS, 1, F.col("pos"), 0, 0),
        violation(dangling(local(t["edge_targets"], "target"), "local", known), "REFERENCE", at("$.relationships[%d].to[%d]", "edge_pos", "pos"), LINKS, 1, F.col("edge_pos"), 1, F.col("pos")),
        violation(dangling(local(t["edge_candidates"], "target"), "local", known), "REFERENCE", at("$.relationships[%d].candidates[%d].target", "edge_pos", "pos"), LINKS, 1, F.col("edge_pos"), 2, F.col("pos")),
        violation(dangling(fallbacks, "asset", t["assets"]), "REFERENCE", at("$.blocks[%d].fallbackAssetIds[%d]", "block_pos", "pos"), LINKS, 2, F.col("block_pos"), -2, F.col("pos")),
        violation(dangling(local(runs.filter("href like '#%'"), "href"), "local", known), "REFERENCE", F.concat("where", F.lit(".href")), LINKS, 2, *place("block_pos", "cell_pos", "run_pos"), -1),
        violation(dangling(targets, "target", known), "REFERENCE", F.concat("where", F.lit(".targetIds["), "pos", F.lit("]")), LINKS, 2, *place("block_pos", "cell_pos", "run_pos", "pos")),
        violation(dangling(runs.filter("relationshipId is not null"), "relationshipId", edges), "REFERENCE", F.concat("where", F.lit(".relationshipId")), LINKS, 2, *place("block_pos", "cell_pos", "run_pos"), 1 << 40),
        violation(dangling(t["page_blocks"], "block_id", blocks), "REFERENCE", at("$.pages[%d].blocks[%d]", "page_pos", "pos"), LINKS, 3, F.col("page_pos"), -1, F.col("pos")),
        violation(dangling(members, "block_id", blocks), "REFERENCE", at("$.pages[%d].columns[%d].blockIds[%d]", "page_pos", "column_pos", "pos"), LINKS, 3, *place("page_pos", "column_pos", "pos")),
        violation(dangling(t["notes"], "target", known), "REFERENCE", at("$.metadata.authorNotes[%d].target", "pos"), LINKS, 4, F.col("pos")),
    ])


def evidences(t: dict[str, DataFrame]) -> DataFrame:
    """Every evidence of a document: place (two numbers), path, pages, boxes."""
    def own(df, family, first, second, column, path):
        return df.filter(F.col(column).isNotNull()).select("doc_key", F.lit(family).alias("family"), F.col(first).alias("a"), (F.lit(second) if isinstance(second, int) else F.col(second)).alias("b"), path.alias("where"), F.col(f"{column}.pages").alias("pages"), F.col(f"{column}.boxes").alias("boxes"))

    return _all([
        own(t["blocks"], 2, "pos", -1, "evidence", at("$.blocks[%d].evidence", "pos")),
        own(t["cells"], 2, "block_pos", "cell_pos", "evidence", at("$.blocks[%d].table.cells[%d].evidence", "block_pos", "cell_pos")),
        own(t["blocks"], 2, "pos", 1 << 20, "furniture", at("$.blocks[%d].furniture", "pos")),
        own(t["blocks"], 2, "pos", (1 << 20) + 1, "furnitureReview", at("$.blocks[%d].furnitureReview", "pos")),
        own(t["assets"], 3, "pos", 0, "evidence", at("$.assets[%d].evidence", "pos")),
        own(t["edges"], 4, "pos", -1, "evidence", at("$.relationships[%d].evidence", "pos")),
        own(t["edge_candidates"], 4, "edge_pos", "pos", "evidence", at("$.relationships[%d].candidates[%d].evidence", "edge_pos", "pos")),
    ])


def page_bindings(t: dict[str, DataFrame]) -> DataFrame:
    """Pages, their blocks and columns, and all evidence agree."""
    docs, pages, blocks, columns = t["documents"], t["pages"], t["blocks"], t["page_columns"]
    limit = docs.select("doc_key", F.col("doc.source.pageCount").alias("page_count"))
    known = pages.select("doc_key", "page")
    side = F.coalesce("column", F.lit("single"))
    of_block = blocks.select("doc_key", F.col("id").alias("block_id"), side.alias("own_side"), F.col("page").alias("own_page"))
    members = columns.select("doc_key", "page_pos", "column_pos", "side", F.posexplode("blockIds").alias("pos", "block_id"))
    in_columns = members.select("doc_key", "page_pos", "block_id")
    in_page = t["page_blocks"].select("doc_key", "page_pos", "block_id")
    placed = blocks.filter("page is not null").select("doc_key", "pos", "id", "page", F.col("evidence.pages").alias("seen"))
    listed = t["page_blocks"].select("doc_key", "page", F.col("block_id").alias("id"))
    proof = evidences(t)
    each_page = proof.select("doc_key", "family", "a", "b", "where", F.posexplode("pages").alias("pos", "page"))
    each_box = proof.select("doc_key", "family", "a", "b", "where", "pages", F.posexplode("boxes").alias("pos", "box")).select("*", F.col("box.page").alias("page"))
    shown = lambda key, path: docs.select("doc_key", F.posexplode(key).alias("a", "item")).select("doc_key", "a", F.posexplode("item.pages").alias("pos", "page")).withColumn("where", at(path, "a", "pos"))
    f, a, b, pos, page_pos = (F.col(c) for c in ("family", "a", "b", "pos", "page_pos"))
    return _all([
        violation(docs.filter(F.size("doc.pages") > F.col("doc.source.pageCount")), "PAGE_BINDING", "$.pages", PAGES, 0),
        violation(pages.join(limit, "doc_key").filter("page > page_count"), "PAGE_BINDING", at("$.pages[%d].page", "pos"), PAGES, 1, pos, 0),
        violation(repeated(columns, ["page_pos", "side"], ["column_pos"]), "PAGE_BINDING", at("$.pages[%d].columns[%d].side", "page_pos", "column_pos"), PAGES, 1, page_pos, 1, F.col("column_pos"), -1),
        violation(members.join(of_block, ["doc_key", "block_id"]).filter("own_side <> side"), "PAGE_BINDING", at("$.pages[%d].columns[%d].blockIds[%d]", "page_pos", "column_pos", "pos"), PAGES, 1, page_pos, 1, F.col("column_pos"), pos),
        violation(in_columns.groupBy("doc_key", "page_pos", "block_id").count().filter("count > 1"), "PAGE_BINDING", at("$.pages[%d].columns", "page_pos"), PAGES, 1, page_pos, 2),
        violation(in_page.exceptAll(in_columns).unionByName(in_columns.exceptAll(in_page)).select("doc_key", "page_pos").distinct(), "PAGE_BINDING", at("$.pages[%d]", "page_pos"), PAGES, 1, page_pos, 3),
        violation(t["page_blocks"].join(of_block, ["doc_key", "block_id"]).filter("not own_page <=> page"), "PAGE_BINDING", at("$.pages[%d].blocks[%d]", "page_pos", "pos"), PAGES, 1, page_pos, 4, pos),
        violation(dangling(placed, "page", known, "page"), "PAGE_BINDING", at("$.blocks[%d].page", "pos"), PAGES, 2, pos, -2, 0),
        violation(placed.filter("not array_contains(seen, page)"), "PAGE_BINDING", at("$.blocks[%d].page", "pos"), PAGES, 2, pos, -2, 1),
        violation(placed.join(listed, ["doc_key", "page", "id"], "left_anti"), "PAGE_BINDING", at("$.blocks[%d].page", "pos"), PAGES, 2, pos, -2, 2),
        violation(dangling(each_page, "page", known, "page"), "PAGE_BINDING", F.concat("where", F.lit(".pages["), "pos", F.lit("]")), PAGES, f, a, b, 0, pos),
        violation(dangling(each_box, "page", known, "page"), "PAGE_BINDING", F.concat("where", F.lit(".boxes["), "pos", F.lit("].page")), PAGES, f, a, b, 1, pos, 0),
        violation(each_box.filter("not array_contains(pages, page)"), "PAGE_BINDING", F.concat("where", F.lit(".boxes["), "pos", F.lit("].page")), PAGES, f, a, b, 1, pos, 1),
        violation(dangling(shown("doc.diagnostics", "$.diagnostics[%d].pages[%d]"), "page", known, "page"), "PAGE_BINDING", F.col("where"), PAGES, 5, a, pos),
        violation(dangling(shown("doc.recovery.issues", "$.recovery.issues[%d].pages[%d]"), "page", known, "page"), "PAGE_BINDING", F.col("where"), PAGES, 6, a, pos),
    ])


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """All violations of all documents."""
    return _all([bindings(t), conservation(t), names(t), links(t), page_bindings(t)])


def verdicts(decoded: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """doc_key, code and path of each document's first violation; null where it is valid."""
    first = violations(t).groupBy("doc_key").agg(F.min_by(F.struct("code", "path"), "rank").alias("v"))
    return decoded.select("doc_key", "code", "path").join(first, "doc_key", "left").select("doc_key", F.coalesce("code", "v.code").alias("code"), F.coalesce("path", "v.path").alias("path"))
