"""What the corpus operators share: intermediate tables, byte-bounded text batches, checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds as one block.
BLOCK_BYTES = 1 << 20
#: A table is broadcast only after a count shows that it has no more rows and bytes than this.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20
#: The words of every contract: runs of bytes other than space and \t\n\v\f\r; bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error, for a folder of one machine
    would be lost with that machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = _local_dir()
    return path.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='corpus-')}"


class Scratch:
    """Parquet tables in the shared folder: they cut lineage, survive a lost executor and can be dropped early.

    What isn't dropped goes with the driver's JVM, as results may still be read from it till then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        fs, path = self._place(self.root)
        fs.deleteOnExit(path)

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def save(self, df: DataFrame) -> Table:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.mode("overwrite").parquet(path)
        return Table(self, path, df.schema)

    def drop(self, *tables: Table) -> None:
        """Deletes tables, and lets the driver collect its garbage: only then do the shuffles of ended jobs leave the disks."""
        for table in tables:
            table.drop()
        self.spark._jvm.System.gc()


class Table:
    def __init__(self, scratch: Scratch, path: str, schema: T.StructType):
        self._scratch, self.path, self._schema = scratch, path, schema

    def read(self) -> DataFrame:
        return self._scratch.spark.read.schema(self._schema).parquet(self.path)

    def drop(self) -> None:
        fs, path = self._scratch._place(self.path)
        fs.delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows and bytes are counted to be few enough; otherwise as it is, for a shuffled join."""
    width = sum((F.coalesce(_bytes(df[c], f.dataType), F.lit(0)) + 8 for c, f in zip(df.columns, df.schema.fields, strict=True)), F.lit(0))
    n, total = df.select(width.cast("long").alias("width")).limit(rows + 1).agg(F.count("*"), F.sum("width")).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def _bytes(column: Column, kind: T.DataType) -> Column:
    """The bytes of a value of variable length, beside the eight that any value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(column)
    return F.octet_length(F.to_json(F.struct(column))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.lit(0)


def unclashed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1 ..., and the new name of each: whatever df's columns are called, internal ones can't clash."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Record batches cut so that the text column of each has about BLOCK_BYTES (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        # Only a block's texts are copied, so that a worker holds a batch and a block.
        held = lambda start, n: column.slice(start, n).cast(pa.large_binary()).to_pylist()  # noqa: B023, E731
        start = size = 0
        for row, length in enumerate(pc.binary_length(column).to_pylist()):
            size += length or 0
            if size >= BLOCK_BYTES:
                yield batch.slice(start, row + 1 - start), held(start, row + 1 - start)
                start, size = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start), held(start, batch.num_rows - start)


def give_back() -> None:
    """Gives what a task has freed back to the system: Spark keeps its Python workers, and other tasks need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors collect their garbage, as a heap that one stage has filled isn't given back by itself, and the next
    stage's Python workers need that memory beside it."""
    n = 4 * spark.sparkContext.defaultParallelism  # whichever executor takes a task, it collects its own
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def map_text(df: DataFrame, text: str, keep: list[str], made: T.StructType, work: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """keep columns of df, and the columns of made, which work()(texts) gives by name for each block of texts.

    work is called once in a task; texts are bytes or None. Only keep and text are read, so that other columns of df,
    whatever their names, neither cost nor clash.
    """
    names = [f"k{i}" for i in range(len(keep))]
    at = f"k{keep.index(text)}" if text in keep else "t"
    own = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], *([] if text in keep else [F.col(f"`{text}`").cast("string").alias("t")]))
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], *made.fields])
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch, texts in blocks(batches, at):
            got = function(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(got[f.name]) for f in made.fields]], names=out_names)
        del function
        give_back()

    return own.mapInArrow(run, schema)
