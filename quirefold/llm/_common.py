"""What the operators of this subpackage share: reading tables, scratch tables, hold-out remainders."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds as objects at a time (one row at least).
BATCH_BYTES = 8_000_000
_left: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where none is set, one of this machine, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "quirefold-scratch")
    return shared.rstrip("/")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    """Tables that results may still be read from stay as long as the driver's process."""
    for spark, root in _left:
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the JVM may have gone first
            return


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive the executors that wrote them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        _left.append((spark, self.root))

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        w = df.write.option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path) if not partition_by else self.spark.read.parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        _delete(self.spark, df._scratch_path)


def carried(columns: list[str], *results: str) -> list[str]:
    """The columns that an operator hands on: one that bears the name of a result, in whatever case, gives way to it."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def named(column: str) -> Column:
    """A column by its plain name, whatever signs that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def bundle(columns: list[str]) -> Column:
    """The columns as one struct, in which their names clash with nothing."""
    return F.struct(*map(named, columns)) if columns else F.struct(F.lit(0).alias("none"))


def unbundled(name: str, columns: list[str]) -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in columns]


def give_back() -> None:
    """Hands memory that this Python worker no longer uses back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, carry: list[str], value: str, fields: str, make: Callable[[list], list[list]], most_bytes: int = BATCH_BYTES) -> DataFrame:
    """df's carried columns and the fields that make() gives for lists of the values, as one list a field.

    value names a column, or a field within one (a.b). The carried columns travel as one struct, so they may have
    any names, and a value that is among them travels once. make() gets rows of most_bytes at a time (one at least).
    """
    own = T._parse_datatype_string(fields)
    carry = carried(carry, *own.fieldNames())
    path = value.split(".")
    inside = path[0] in carry
    kept = df.select(bundle(carry).alias("carried"), *([] if inside else [F.col(value).alias("value")]))
    shape = T.StructType([kept.schema.fields[0], *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in own.fields]
        for b in batches:
            values = pc.struct_field(b.column(0), path) if inside else b.column(1)
            sizes = (pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length)(values).fill_null(0).to_pylist()
            for lo, hi in sub_batches(sizes, most_bytes):
                made = make(values.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=shape.fieldNames())
        give_back()

    return kept.mapInArrow(run, shape).select(*unbundled("carried", carry), *own.fieldNames())


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def sub_batches(sizes, most_bytes: int):
    """Splits rows of the given sizes into runs [i, j) of at most most_bytes, one row at least."""
    i = total = 0
    for j, s in enumerate(sizes):
        if j > i and total + s > most_bytes:
            yield i, j
            i, total = j, 0
        total += s
    if i < len(sizes):
        yield i, len(sizes)
