"""What the training-data operators share: the documents table, written tables, folds, sampling."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on labelled rows that any classifier here is fitted on.
FIT_ROWS = 12_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables that written() gave and that are still held.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null becomes empty); every other column is left behind, so clashing names cannot matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; a temporary one only where it is unset in local mode (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tideframe-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table: cuts lineage, survives lost executors, and is computed once.

    The write's own shuffle files go when it ends, as nothing reads them again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() gave, once what was made of them is written too; others are left alone."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(mod: int) -> Column:
    """crc32 of the doc_id as text, modulo mod; a null doc_id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % mod


def drawn(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """About `bound` of rows, or all if they are fewer: the lowest in a hash order of doc_id, by a threshold of one part in 2^40."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) <= (bound << 40) // n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trainable: Column, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, y of at most about `bound` labelled rows that `trainable` admits, the lowest in a hash order of doc_id.

    A label or doc_id that is null, or a doc_id with two different labels, labels nothing. The rows
    are drawn by a threshold on the hash, so that no sort and no single task sees them all.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & trainable)
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1"))
        .where(F.col("y") == F.col("y1")).drop("y1")
    )
    return keyed_text(docs).join(drawn(known, bound, 17), "doc_id")
