"""Helpers shared by the training-data operators: frozen tables, skew-safe lookups, text normalisation."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of anything but space and the five control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: No more than this many keys can each hold more than 1/HOT_KEYS of the rows; it bounds what ``lookup`` broadcasts.
HOT_KEYS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, one in the temporary
    folder, if all run in this process; on a cluster, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's switch to drop a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Settings that keep an Arrow batch to a few megabytes, whatever its rows hold.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]):
    """The session with these settings, as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trimmed(run):
    """``run`` over a task's batches; when they are read, its worker returns what memory it no longer uses."""

    def inner(batches):
        yield from run(batches)
        _trim()

    return inner


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
    if trim:
        trim(0)


def relieve(spark: SparkSession) -> None:
    """The driver returns what memory it no longer uses. Its JVM lets the heap grow with the garbage of planning, however
    little of it is in use, and only a full collection shrinks it again; what its compilers have freed stays with malloc."""
    gc.collect()  # first, since what Python refers to stays in the JVM
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with suppress(Py4JJavaError):  # a JVM without this command
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        connection = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection")  # the server's own class is closed to others
        invoke = next(m for m in connection.getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        args[0], args[1] = command, "systemTrimNativeHeap"
        invoke.invoke(server, args)
    _trim()


def freeze(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one evaluation, no lineage, safe from lost executors, and no
    shuffle files left. With ``by`` (a column of few values) the table lies in a folder for each value, and a filter on it
    reads those alone."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with configured(spark, {CLEANUP: "true"}):
        df.write.parquet(path, partitionBy=by, compression=codec)
    read = spark.read.schema(df.schema).parquet(path)
    read.frozen_at = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete frozen tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.frozen_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, in a column of the name returned, which no other column has.

    The number is the place of the row in its file, so that it is the same whenever the table is read, however it is split.
    What is not read from files is written first. A table of files takes part in a broadcast: a row each.
    """
    spark, name = docs.sparkSession, unused("_row", docs.columns)
    try:
        if "_metadata" in (c.lower() for c in docs.columns):
            raise AnalysisException("a column hides the files' own")
        return _placed(docs, name), name
    except AnalysisException:
        return _placed(freeze(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]), "numbered"), name, docs.columns), name


def _placed(docs: DataFrame, name: str, names: list[str] | None = None) -> DataFrame:
    """The table read from files with its rows' numbers, and its columns by ``names``."""
    placed = docs.select(*columns_of(docs), F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_index"))
    paths = sorted(r[0] for r in placed.select(f"{name}_file").distinct().collect())
    files = docs.sparkSession.createDataFrame([(p, i << 40) for i, p in enumerate(paths)], f"{name}_file string, {name}_first long")
    rows = placed.join(F.broadcast(files), f"{name}_file")
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names or docs.columns, strict=True)]
    return rows.select(*own, (F.col(f"{name}_first") + F.col(f"{name}_index")).alias(name))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only, so that the result is the same in every engine and locale; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lookup(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Left-join ``groups`` (one row per key, ``count`` = its number of rows) to ``rows`` without a hot task.

    Keys that hold more than 1/HOT_KEYS of all rows are at most HOT_KEYS many: that side alone is broadcast. The
    others meet in a shuffled join in which no key has more than that share. Both inputs should be frozen tables.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    limit = max(1000, total // HOT_KEYS)
    hot, cold = groups.filter(F.col(count) > limit), groups.filter(F.col(count) <= limit)
    added = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    done = marked.filter("_hot").select(*rows.columns, *added)
    rest = marked.filter("_hot is null").select(*rows.columns).join(cold, key, "left").select(*rows.columns, *added)
    return done.unionByName(rest)
