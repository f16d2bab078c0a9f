"""Recovery facts and summaries of diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Diagnostic codes by category; any other code is of the source.
CODES = {
    "text": "OCR_REQUIRED LOW_CONFIDENCE_OCR NO_RECONSTRUCTABLE_TEXT ISOLATED_PROSE_GLYPH INCOMPLETE_TEXT_COVERAGE UNRESOLVED_CORRUPTING_JOIN INCOMPLETE_INLINE_STYLE_COVERAGE",
    "layout": "AMBIGUOUS_READING_ORDER READING_ORDER_CYCLE FURNITURE_REVIEW_REQUIRED FURNITURE_CONTAMINATION UNRESOLVED_FRONT_MATTER",
    "visuals": "UNRESOLVED_VISUAL_OBJECT UNREFERENCED_VISUAL_ASSET AMBIGUOUS_VISUAL_MATCH INCOMPLETE_ASSET_COVERAGE MISSING_IMAGE_PART MISSING_IMAGE_CAPTION",
    "tables": "INCOMPLETE_SEMANTIC_TABLE_COVERAGE BOUNDED_TABLE_FALLBACK",
    "equations": "UNRESOLVED_EQUATION_TRANSCRIPT",
    "links": "UNRESOLVED_HYPERLINK INCOMPLETE_RELATIONSHIP_COVERAGE UNRESOLVED_CITATION_REFERENCE UNRESOLVED_SCHOLARLY_CROSS_REFERENCE UNMAPPED_CITATION_ANCHOR DANGLING_EPUB_INTERNAL_REFERENCE",
    "notes": "AMBIGUOUS_NOTE_MATCH UNRESOLVED_NOTE_REFERENCE UNREFERENCED_NOTE DANGLING_NOTE_REFERENCE",
}
DEFAULT = "source"


def category(code: Column) -> Column:
    out = F.lit(DEFAULT)
    for name, codes in CODES.items():
        out = F.when(code.isin(codes.split()), name).otherwise(out)
    return out


def title(code: Column) -> Column:
    words = F.replace(F.lower(code), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def fact(code: Column, message: Column) -> Column:
    return F.struct(category(code).alias("category"), title(code).alias("title"), message.alias("message"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """Diagnostics of rows (id, code, severity, message, page, source_ids); ids default to the code and the page or `document`."""
    own = F.concat(F.col("code"), F.lit("-"), F.coalesce(F.col("page").cast("string"), F.lit("document")))
    return rows.withColumns({
        "id": F.coalesce("id", own), "category": category(F.col("code")), "title": title(F.col("code")),
        "pages": F.when(F.col("page").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(F.col("page").cast("bigint"))),
        "source_ids": F.coalesce("source_ids", F.array().cast("array<string>")),
    })


def issues(rows: DataFrame, key: str = "doc_key", blocking: list[str] | None = None) -> DataFrame:
    """One row per document and issue: category, title, pages in order, count, and place of the issue's first diagnostic.

    rows: key, pos, code, severity, automatic (recovered by itself), pages (array). Only actionable ones count, and
    where blocking codes are given only these. An issue's count is its number of pages, or one if it has none.
    """
    counts = (F.col("severity") != "info") & ~F.coalesce(F.col("automatic"), F.lit(False))
    if blocking:
        counts = counts & F.col("code").isin(blocking)
    flat = rows.filter(counts).select(key, "pos", category(F.col("code")).alias("category"), title(F.col("code")).alias("title"), F.explode_outer("pages").alias("page"))
    return flat.groupBy(key, "category", "title").agg(
        F.array_sort(F.collect_set("page")).alias("pages"), F.greatest(F.count_distinct("page"), F.lit(1)).alias("count"), F.min("pos").alias("first_pos")
    )


def summary(rows: DataFrame, documents: DataFrame, key: str = "doc_key", blocking: list[str] | None = None) -> DataFrame:
    """Per document of documents (key, ready): status, title, summary text and issues in the order in which they first came."""
    per = issues(rows, key, blocking).groupBy(key).agg(
        F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("first_pos", "category", "title", "count", "pages"))).alias("issues")
    )
    total = F.coalesce(F.col("total"), F.lit(0))
    text = F.when(total == 0, "No unresolved recovery issues.").otherwise(F.concat(total, F.lit(" unresolved recovery "), F.when(total == 1, "issue.").otherwise("issues.")))
    return documents.join(per, key, "left").select(
        key, F.when(F.col("ready"), "ready").otherwise("review-required").alias("status"),
        F.when(F.col("ready"), "Recovery status: ready").otherwise("Recovery status: review required").alias("title"), text.alias("summary"), total.alias("issue_count"), "issues",
    )


def has_actionable(user_action: Column) -> Column:
    return F.length(F.coalesce(user_action, F.lit(""))) > 0
