"""Helpers shared by the training-data operators.

A *document* is a row ``(doc_id, text)``.  Rows that repeat both columns are one
document that happens to be listed twice: every copy of the row receives that
document's result.  A null ``doc_id`` is a legal key which sorts after all others.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside packed integer arrays; sorts last.
NULL_ID = (1 << 63) - 1
#: Bytes of an Arrow batch that goes to a Python worker, beside its last row.
BATCH_BYTES = 4 << 20

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one JVM (tests) is a temporary folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return _LOCAL_ROOTS[app]


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """While a table is written: Arrow batches of few bytes, and shuffle files that go with the job."""
    wanted = {
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),  # rows may hold whole texts or sets
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class Workspace:
    """Intermediate tables of one operator run, written in the shared folder.

    A written table cuts lineage and survives lost executors.  ``drop`` frees the
    disk of a table once nothing lazy reads from it any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with bounded(self.spark):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_words_count(column: str | Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(column: str) -> Column:
    """A non-null long for a nullable id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def bucket_count(n_items: int, per_bucket: int) -> int:
    """A power of two of buckets such that each holds about ``per_bucket`` items or fewer."""
    n = 1
    while n * per_bucket < n_items:
        n *= 2
    return n


def with_key(ws: Workspace, docs: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """``key, doc_id`` and ``columns`` of documents, text null read as empty.

    Keys are longs in the order of doc_id, null last, then of a hash of the text; rows that
    repeat both share a key.  Where ids are unique and non-null the key is the id itself;
    else keys are ranks of a range sort.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[text_of(c).alias(c) if c == "text" else F.col(c) for c in columns])
    clash = base.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if clash.isEmpty():
        return base.select(F.col("doc_id").alias("key"), "doc_id", *columns)
    hashed = base.withColumn("_h", F.xxhash64("text"))
    ranks = hashed.select("doc_id", "_h").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "_h")
    ranks = ws.save(ranks.withColumn("key", F.monotonically_increasing_id()), "keys").alias("r")
    h = hashed.alias("h")
    joined = h.join(ranks, F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h._h") == F.col("r._h")))
    return joined.select("r.key", "h.doc_id", *[f"h.{c}" for c in columns])


def few_rows(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; counts no further."""
    return df.limit(bound + 1).count() <= bound
