"""Exact duplicates by distributed most-significant-byte-first radix partitioning.

Documents start in one group. Each pass splits every group by the next run of bytes of its documents (64, 512,
4,096, ... at a time, so a text of any length takes few passes); a document leaves when it is alone in its group, or
when its bytes have ended, since then all of its group spelt the same bytes and ended with it. Equality rests on
the bytes themselves: no digest takes part in it, and text_sha256 is only reported.

The first pass deals the rows out by their first 64 bytes and writes them; nearly all are alone by then. The passes
after it hold only an id and the bytes not yet compared of the rows that are left, and what they find comes back by
that id. A run that many rows share is salted: counts are kept per run and salt, added up over the salts of a run,
and handed back per run and salt, so the rows of a group that holds a third of the table go to as many tasks as
there are shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Scratch, bundle, carried, table, unbundled

FIRST, GROW = 64, 8
#: Rows of a group of copies that meet its summary in one task.
SHARE = 1000


def _split(rows: DataFrame, size: int, salts: int) -> DataFrame:
    """rows (rid, grp, bytes and others) with n, how many spell the same next bytes, grp, one number for these, over,
    and the bytes that follow."""
    # the length tells a text that ended within the run from one that goes on with the same bytes
    run = F.struct("grp", F.substring("bytes", 1, size).alias("spelt"), (F.length("bytes") <= size).alias("ended"))
    keyed = rows.withColumn("run", run).withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
    each = keyed.groupBy("run", "salt").agg(F.count("*").alias("n"), F.min("rid").alias("least"))
    same = W.partitionBy("run")
    counts = each.select("run", "salt", F.sum("n").over(same).alias("n"), F.min("least").over(same).alias("new_grp"))
    return (
        keyed.drop("grp").join(counts, ["run", "salt"])
        .withColumn("over", (F.col("n") == 1) | F.col("run.ended"))
        .withColumn("bytes", F.when(~F.col("over"), F.expr(f"substring(bytes, {size + 1})")))
        .withColumnRenamed("new_grp", "grp").drop("run", "salt")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of df with keep_id, group_size, kept and text_sha256 beside the carried columns (the id by default).

    Texts are equal when identical after no change; a null text counts as empty. Of equal texts the row with the
    largest id stays (null ids come below all others); of rows repeated with the same id exactly one stays.
    Empty tables give an empty result. Columns of df that are not carried play no part; carried ones that
    bear the name of a result, in whatever case, give way to it. id_col and text_col may be fields of a struct (a.b).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carry = carried(carry or [id_col], "keep_id", "group_size", "kept", "text_sha256")
    inside = text_col.split(".")[0] in carry  # then the row brings its text along, and it is not held twice
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = F.coalesce(F.col(f"row.{text_col}"), F.lit("")).cast("binary") if inside else F.col("text")
    rows = df.select(bundle(carry).alias("row"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), *([] if inside else [text.alias("text")]))
    rows = rows.withColumn("grp", F.lit(0).cast("long")).withColumn("sha", F.sha2(own, 256)).withColumn("bytes", own)
    if inside:
        # only the run's bytes and one more are needed here: that one tells that the text goes on
        rows = rows.withColumn("bytes", F.substring("bytes", 1, FIRST + 1))
    first = _split(rows.drop("text"), FIRST, salts)
    first = scratch.write(first.drop("bytes") if inside else first)
    rest = F.substring(own, FIRST + 1, 2**31 - 1) if inside else F.col("bytes")
    left, size = first.filter("not over").select("rid", "id", "grp", rest.alias("bytes")), FIRST * GROW
    copies, late = first.filter("over and n > 1").select("rid", "id", "n", "grp"), None
    while not left.isEmpty():
        split = scratch.write(_split(left, size, salts))
        over = split.filter("over").select("rid", "id", "n", "grp")
        copies = copies.unionByName(over.filter("n > 1"))
        late = over.filter("n = 1") if late is None else late.unionByName(over.filter("n = 1"))
        left, size = split.filter("not over").select("rid", "id", "grp", "bytes"), min(size * GROW, 1 << 30)
    # a group of n copies meets its summary in n / SHARE places
    copies = copies.withColumn("places", F.ceil(F.col("n") / SHARE))
    best = (
        copies.groupBy("grp").agg(F.max("places").alias("places"), F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "rid")).alias("best"))
        .select("grp", "best", F.explode(F.expr("sequence(0L, places - 1)")).alias("place"))
    )
    judged = copies.withColumn("place", F.pmod(F.xxhash64("rid"), "places")).join(best, ["grp", "place"]).select("rid", "n", F.col("best.id").alias("keep_id"), (F.col("best.rid") == F.col("rid")).alias("kept"))
    if late is not None:
        judged = judged.unionByName(late.select("rid", "n", F.col("id").alias("keep_id"), F.lit(True).alias("kept")))
    # rows that were alone after the first pass need no join
    alone = first.filter("over and n = 1").select("row", "sha", "n", F.col("id").alias("keep_id"), F.lit(True).alias("kept"))
    others = first.filter("not over or n > 1").select("row", "sha", "rid").join(judged, "rid").select("row", "sha", "n", "keep_id", "kept")
    return alone.unionByName(others).select(*unbundled("row", carry), "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays, its group's size and its digest (see exact_dedup for odd rows)."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
