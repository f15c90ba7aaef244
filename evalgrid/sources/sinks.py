"""Result tables, resumable appends and per-subject replacement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.operators.sampling import pending


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result table as parquet, csv (with header) or json."""
    w = df.write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_pending(work: DataFrame, path: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> None:
    """Compute and append only what the output does not hold yet, so that a stopped run resumes."""
    spark = work.sparkSession
    todo = pending(work, spark.read.parquet(path), keys) if exists(spark, path) else work
    compute(todo).write.mode("append").parquet(path)


def incomplete(expected: DataFrame, done: DataFrame, subject: str) -> DataFrame:
    """Subjects whose output does not hold as many rows as expected."""
    want = expected.groupBy(subject).agg(F.count(F.lit(1)).alias("_w"))
    have = done.groupBy(subject).agg(F.count(F.lit(1)).alias("_h"))
    return want.join(have, subject, "left").where(F.coalesce("_h", F.lit(0)) != F.col("_w")).select(subject)


def replace_subjects(df: DataFrame, path: str, subject: str) -> None:
    """Replace only the subjects present in `df`; other partitions of the table stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(subject).parquet(path)
