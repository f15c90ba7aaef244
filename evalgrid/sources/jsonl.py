"""JSON-lines sources: half-written lines, nested sensor rows, recording starts, annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, dropped lines) of a JSONL file that may end in a half-written line.

    Lines are parsed with from_json, so both sides come from one text scan; blank lines are skipped.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    good = parsed.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)
    bad = parsed.where(F.col(f"r.{CORRUPT}").isNotNull()).select(F.col("value").alias("line"))
    return good, bad


def last_record(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Keep the last record of each key: an aggregate, so duplicates collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return one.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


SENSOR_SCHEMA = T.StructType([
    T.StructField("true_time", T.DoubleType()),
    T.StructField("left_gaze_point_on_display_area", T.ArrayType(T.DoubleType())),
    T.StructField("right_gaze_point_on_display_area", T.ArrayType(T.DoubleType())),
    T.StructField("left_pupil_validity", T.IntegerType()),
    T.StructField("right_pupil_validity", T.IntegerType()),
])


def sensor_samples(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t_ms, tx, ty, tvalid): mean of the valid eyes, one sample per millisecond.

    An eye counts if it is flagged valid and both its coordinates are finite. Of several rows in
    one millisecond the first by full timestamp is kept.
    """
    def eye(side: str) -> tuple[Column, Column]:
        p = F.col(f"{side}_gaze_point_on_display_area")
        x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        ok = (F.col(f"{side}_pupil_validity") == 1) & x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        return F.when(ok, x), F.when(ok, y)

    (lx, ly), (rx, ry) = eye("left"), eye("right")

    def mean(a: Column, b: Column) -> Column:
        return F.coalesce((a + b) / 2, a, b)

    d = raw.select(*keys, "true_time", F.bround(F.col("true_time") * 1000).cast("bigint").alias("t_ms"), mean(lx, rx).alias("tx"), mean(ly, ry).alias("ty"))
    first = d.groupBy(*keys, "t_ms").agg(F.min_by(F.struct("tx", "ty"), F.struct("true_time", "tx", "ty")).alias("s"))
    ok = F.col("s.tx").isNotNull() & F.col("s.ty").isNotNull()
    return first.select(*keys, "t_ms", F.col("s.tx").alias("tx"), F.col("s.ty").alias("ty"), ok.cast("int").alias("tvalid"))


def recording_starts(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, video, start_ms) from a browser log (type, sessionString, epoch, seq); the last
    start of a video wins."""
    e = events.where((F.col("type") == "recording start") & (F.coalesce("sessionString", F.lit("")) != ""))
    e = e.select(*keys, F.concat(F.regexp_replace("sessionString", "/", "-"), F.lit(".webm")).alias("video"), F.col("epoch").cast("bigint").alias("start_ms"), "seq")
    return last_record(e, [*keys, "video"], "seq").select(*keys, "video", "start_ms")


def positive_sets(annotations: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(image_id, pos): sorted set of annotated categories; `mapping` (category_id, target_id)
    renames a second source's categories and drops the unmapped ones."""
    a = annotations.select("image_id", "category_id")
    if mapping is not None:
        a = a.join(mapping, "category_id").select("image_id", F.col("target_id").alias("category_id"))
    # distinct first: a unit collects at most one entry per category
    return a.distinct().groupBy("image_id").agg(F.sort_array(F.collect_set("category_id")).alias("pos"))
