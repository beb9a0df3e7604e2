"""What the operators of this subpackage share: intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where the session names none (tests, a local master) a temporary folder is taken, once for each session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="kinship-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing has yet. Unless it is to be kept, what is written there goes with the scope."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep and _made.get() is not None:
        _made.get().append(path)
    return path


@contextmanager
def scope(spark: SparkSession):
    """Delete the tables that operators store inside, once what they returned has been written elsewhere."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            drop(spark, path)
        _made.reset(token)


def stored(df: DataFrame, name: str, rows: int = 100, batch: tuple[int, int] = (1000, 4)) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors, and gives the
    optimizer the size of the table, so that it broadcasts only what is under spark.sql.autoBroadcastJoinThreshold. Shuffle files of
    the write go with its end. rows: how many the writer takes before it looks at their size, few where rows are of megabytes. batch: rows and megabytes of
    an Arrow batch."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession, *batch), shuffles_removed(df.sparkSession):
        df.write.option("parquet.block.size.row.check.min", rows).option("parquet.block.size.row.check.max", 100 * rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Have Spark remove the shuffle files of each execution inside at its end, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 4):
    """Arrow batches of so many rows and megabytes at most, as rows hold whole texts; for jobs that run inside. A longer row is a batch
    of its own."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": mb << 20}
    before = {k: spark.conf.get(k) for k in keys}
    for k, most in keys.items():
        now = int(before[k].rstrip("b"))
        spark.conf.set(k, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path by the file system that it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan, as expressions."""
    names = [c.split(" ", 1)[0] for c in _top_level(schema)]
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(c.split(" ", 1)[1]).alias(n) for c, n in zip(_top_level(schema), names, strict=True)))
    row = lambda r: F.struct(*(_literal(v).cast(c.split(" ", 1)[1]).alias(n) for v, c, n in zip(r, _top_level(schema), names, strict=True)))
    return spark.range(1).select(F.explode(F.array(*map(row, rows))).alias("r")).select("r.*")


def _literal(v):
    if isinstance(v, list):
        return F.array(*map(_literal, v))
    if isinstance(v, tuple):
        return F.struct(*map(_literal, v))
    return F.lit(v)


def _top_level(schema: str) -> list[str]:
    """The columns of a schema string, commas inside < > left alone."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


def row_key(*columns: str):
    """A 64-bit key of a row, equal for equal values, null-safe. Callers must bear a collision."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns))


def partitions_for(df: DataFrame, mb: int = 24) -> int:
    """Partitions that hold about mb megabytes of df each by Catalyst's estimate, spark.sql.shuffle.partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(estimated_bytes(df) // (mb << 20), (1 << 31) - 1))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size, or a sum over its rows where it has none, as of data that is no table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:
        size = df.select(F.sum(sum(F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns))).first()[0] or 0
    return size


def released() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_kept: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What the functions of a module keep in this worker from task to task; what those of others kept is let go."""
    for other in [m for m in _kept if m != module]:
        del _kept[other]
    return _kept.setdefault(module, {})


def lean(run):
    """A function of Arrow batches that releases memory at its end: workers stay, idle, beside those of the next stage. Arrow allocates
    by the C library, whose memory can be given back. What other modules keep is let go at its begin."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        kept(run.__module__)
        try:
            yield from run(batches)
        finally:
            released()

    return out
