"""Tables in the folder that driver and executors share, and what several operators need."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import tempfile
import typing
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Whether the end of a query deletes its shuffle files.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="motifold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    What the query shuffled goes once it is written, so a long run doesn't pile up the files of all its steps."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/motifold/{name}-{uuid.uuid4().hex}", spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before)
    trimmed(spark)
    return spark.read.schema(df.schema).parquet(path), path


def trimmed(spark: SparkSession) -> bool:
    """Have the driver give memory back: what its compiler, codecs and Python freed stays with glibc else, query by query.

    Whether its JVM could (only one of glibc can)."""
    give_back()
    try:
        java, gateway = spark._jvm.java.lang, spark.sparkContext._gateway
        name, texts = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), java.Class.forName("[Ljava.lang.String;")
        kinds = gateway.new_array(java.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;")):
            kinds[i] = java.Class.forName(kind)
        kinds[3] = texts
        args = gateway.new_array(java.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        # the server's class isn't open to reflection, its interface is
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``stored`` wrote and that no plan reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return to the system what this process's allocators keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """Have a task's Python function give memory back when it ends: workers live on, and hold what their allocators keep."""

    def freed(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    # Spark reads how many arguments there are, and their types
    wrapped = (lambda key, parts: freed(key, parts)) if len(inspect.signature(run).parameters) == 2 else (lambda batches: freed(batches))
    wrapped.__annotations__ = typing.get_type_hints(run)
    return wrapped


#: Bits of the bitmaps that stand for sets of ids; 2 MB, whatever the input.
BITMAP_BITS = 1 << 24


def slot(col: str) -> F.Column:
    """The bit that stands for an id."""
    return F.xxhash64(F.col(col)).bitwiseAND(F.lit(BITMAP_BITS - 1))


def bitmap(ids: DataFrame, col: str) -> bytes:
    """A one-hash Bloom filter of a column in BITMAP_BITS bits: a bounded hint of which rows a join may want.

    It never misses an id; the join that follows drops what it lets through wrongly."""
    bits = ids.select((slot(col) + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = bytearray(BITMAP_BITS // 8)
    for b, m in bits.collect():  # at most BITMAP_BITS / 32768 rows of 4 KB
        out[(b - 1) * 4096 : b * 4096] = m  # bucket b holds bits 32768 * (b - 1) to 32768 * b - 1
    return bytes(out)


#: A key with more than one in HUBS of all rows, and more than FEW, is hot: fewer a task can hold whatever they are.
HUBS, FEW = 1000, 100_000


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], total: int, often: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key and in ``often`` how many of the ``total`` rows have it.

    Rows are shuffled by key but for those of hot keys, of which there are HUBS at most: these come to the rows."""
    if total <= FEW:  # there is none
        return rows.join(table.drop(often), on)
    few = table.where(F.col(often) > max(FEW, total // HUBS)).drop(often).collect()
    table = table.drop(often)
    if not few:
        return rows.join(table, on)
    hot = F.broadcast(rows.sparkSession.createDataFrame(few, table.schema))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(table, on))


LONG, DOUBLE, STRING, BINARY, INT = T.LongType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.IntegerType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
