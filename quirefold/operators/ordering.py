"""Reading order by layout, and page layouts from blocks."""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spans come first on a page, then single, left and right columns.
RANK = {"span": 0, "single": 1, "left": 2, "right": 3}


def column_rank(column: Column) -> Column:
    out = F.lit(RANK["single"])
    for name, rank in RANK.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


def order_blocks(blocks: DataFrame, key: str = "doc_key") -> DataFrame:
    """Blocks with `place`, from 0 within the document: by page (none last), column, y, x, order.

    blocks: key, pos, page, column, order, box (the first, or null). A page on which every block has a box is a
    window sort. Blocks without a box compare by order alone with every other, which is not a total order; pages
    that hold one are sorted, stably and by such comparisons, in a pass of their own.
    """
    page = F.coalesce("page", F.lit(2**53 - 1))
    on_page = W.partitionBy(key, "page")
    marked = blocks.withColumns({"_mixed": F.max(F.col("box").isNull()).over(on_page), "_before": page})
    whole = marked.filter("not _mixed").withColumn("_place", F.row_number().over(on_page.orderBy(column_rank(F.col("column")), "box.y", "box.x", "order", "pos")))

    def sort(f: pd.DataFrame) -> pd.DataFrame:
        rows = f.sort_values("pos").to_dict("records")

        def compare(a, b) -> int:
            if a["box"] is None or b["box"] is None:
                return a["order"] - b["order"]
            left, right = ((RANK[r["column"] or "single"], r["box"]["y"], r["box"]["x"], r["order"]) for r in (a, b))
            return (left > right) - (left < right)

        ordered = sorted(rows, key=cmp_to_key(compare))
        return pd.DataFrame({c: [r[c] for r in ordered] for c in f.columns} | {"_place": range(1, len(ordered) + 1)})

    mixed = marked.filter("_mixed")
    shape = ", ".join(f"`{n}` {t}" for n, t in mixed.dtypes) + ", _place int"
    mixed = mixed.groupBy(key, "_before").applyInPandas(sort, shape)
    both = whole.unionByName(mixed)
    # places within the document: a page's blocks come after all of the pages before it
    sizes = both.groupBy(key, "_before").agg(F.count("*").alias("_n"))
    start = sizes.withColumn("_start", F.sum("_n").over(W.partitionBy(key).orderBy("_before")) - F.col("_n")).drop("_n")
    return both.join(start, [key, "_before"]).withColumn("place", F.col("_start") + F.col("_place") - 1).drop("_mixed", "_before", "_place", "_start")


def page_layouts(pages: DataFrame, blocks: DataFrame, key: str = "doc_key") -> DataFrame:
    """Pages (key, page, ...) with blocks (ids in reading order) and columns (id, side, blockIds) in the order in which they are met."""
    placed = order_blocks(blocks, key).filter("page is not null").withColumn("side", F.coalesce("column", F.lit("single")))
    ids = lambda: F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    sides = placed.groupBy(key, "page", "side").agg(F.min("place").alias("first"), ids().alias("blockIds"))
    columns = sides.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("first", F.concat(F.lit("page-"), "page", F.lit("-"), "side").alias("id"), "side", "blockIds"))).alias("columns"))
    whole = placed.groupBy(key, "page").agg(ids().alias("blocks"))
    none = F.array().cast("array<string>")
    return (
        pages.join(whole, [key, "page"], "left").join(columns, [key, "page"], "left")
        .withColumn("blocks", F.coalesce("blocks", none))
        .withColumn("columns", F.coalesce(F.transform("columns", lambda c: F.struct(c["id"].alias("id"), c["side"].alias("side"), c["blockIds"].alias("blockIds"))), F.array()))
    )
