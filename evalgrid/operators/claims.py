"""Claim checking: stated values against recomputed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_claims(df: DataFrame, keys: Sequence[str], values: Sequence[str], prefix: str = "") -> DataFrame:
    """Melt a result table into (claim_id, got), claim_id = prefix.key.key.value."""
    parts = ([F.lit(prefix)] if prefix else []) + [F.col(k).cast("string") for k in keys]
    cells = F.array(*[F.struct(F.concat_ws(".", *parts, F.lit(v)).alias("claim_id"), F.col(v).cast("double").alias("got")) for v in values])
    return df.select(F.inline(cells))


def check(claims: DataFrame, got: DataFrame) -> DataFrame:
    """Full outer join on claim_id: a claim nobody recomputed fails, a value nobody claimed is
    reported as unclaimed. tol 0 asks for equality."""
    j = claims.join(got, "claim_id", "full_outer")
    near = F.abs(F.col("got") - F.col("expected")) <= F.col("tol") + 1e-12
    verdict: Column = (
        F.when(F.col("expected").isNull(), "unclaimed").when(F.col("got").isNull(), "missing").when(near, "ok").otherwise("fail")
    )
    return j.withColumn("verdict", verdict)


def failures(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("verdict").isin("fail", "missing"))
