"""Shared plumbing of the corpus operators: tables, stashes and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regex class body.
SPACE = r"\x20\x09-\x0D"
#: Text bytes that one vectorised step works on (longer documents go alone).
CHUNK_BYTES = 2 << 20

#: Has Spark delete the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Stands for a null doc_id, which is the smallest.
NULL_ID = -(1 << 63)

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="faultline-"))
    return f"file://{_own_dir[0]}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, label: str = "stash") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage, survives the loss of executors and keeps an
    intermediate result that several branches read from being made twice. Shuffle
    files of the write go when it ends, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    atexit.register(_quietly_remove, spark, path)
    return out


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    except Exception:  # the session has ended; the folder belongs to the cluster
        pass


def unstash(df: DataFrame) -> None:
    """Delete a stash that nothing reads any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        _remove(df.sparkSession, path)


def whole_text(col: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that a join sends to all tasks because they are the most frequent ones.
HOT_KEYS = 1_000
#: Row names (two longs each) that may be broadcast.
FEW_ROWS = 200_000


def join_hot(rows: DataFrame, small: DataFrame, on: list[str], uses: str) -> DataFrame:
    """``rows`` joined with ``small``, a written table with unique keys and a count of their uses.

    The HOT_KEYS most frequent keys are broadcast, so no key that is left has
    more than that part of all rows.
    """
    hot = F.broadcast(small.orderBy(F.desc(uses), *on).limit(HOT_KEYS))
    names = F.broadcast(hot.select(*on))
    cold = rows.join(names, on, "left_anti").join(small.join(names, on, "left_anti"), on)
    return rows.join(hot, on).unionByName(cold)


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NULL_ID))


def fold() -> Column:
    """What tells the texts under one doc_id apart."""
    return F.xxhash64(whole_text())


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``gone`` names by id and fold; a short list is broadcast."""
    names = stash(gone.select(F.col("id").alias("gone_id"), F.col("fold").alias("gone_fold")).distinct(), "gone")
    few = names.count() <= FEW_ROWS
    row = docs.select(F.struct(*docs.columns).alias("row"), doc_key().alias("id"), fold().alias("fold"))
    left = row.join(F.broadcast(names) if few else names, (F.col("id") == F.col("gone_id")) & (F.col("fold") == F.col("gone_fold")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def slices(batch: pa.RecordBatch, col: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Split a batch into runs of rows with at most ``limit`` text bytes."""
    texts = batch.column(col).cast(pa.large_binary()).to_pylist()
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > at and size + n > limit:
            yield at, i, [x or b"" for x in texts[at:i]]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts), [x or b"" for x in texts[at:]]
