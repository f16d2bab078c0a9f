"""Documents that keep arriving in a folder: decoded and checked batch by batch.

Every operator works within one document, so batches need no state and no watermark. A batch writes to folders of
its own number: when it is run again after a failure, it replaces what it had written, and nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import invariants
from ..sources import decode as codec

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, names: str = "*.json", files_per_batch: int = 10_000) -> DataFrame:
    """A stream of doc_key (the file's path) and raw (its text; null where its bytes are not UTF-8)."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.col("path").alias("doc_key"), F.try_validate_utf8(F.col("content").cast("string")).alias("raw"))


def keep(documents: DataFrame, out: str, until_done: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Starts writing the tables `documents` (decoded) and `verdicts` (each document's first violation) below out.

    until_done: stop after what is there now; else a batch starts every so often. Progress is kept in out, so a query
    that is started again goes on where the last one ended. Both tables have the batch as a partition column.
    """
    spark = documents.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        def put(df: DataFrame, name: str) -> DataFrame:
            path = f"{out}/{name}/batch={number}"
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        decoded = put(codec.decode(rows), "documents")  # many checks read it
        put(invariants.verdicts(decoded, codec.tables(decoded)), "verdicts")

    written = documents.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_progress")
    return written.trigger(**({"availableNow": True} if until_done else {"processingTime": every})).start()
