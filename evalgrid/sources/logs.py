"""Event logs whose header changed over time, the two-stream files, and small dimension files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid.operators.skew import attach, running

# Columns of every header generation with their types, and what a missing one means.
LOG_TYPES = {
    "site": "string", "t_ms": "bigint", "block": "int", "condition_pattern": "string", "condition_guard": "string", "condition_calib": "string",
    "trial": "int", "cue_item": "string", "event": "string", "zone": "int", "item": "string", "page": "int", "detail": "string",
    "frame_ms": "double", "px": "double", "py": "double", "eye_px": "double", "cue_zone": "double",
}
LOG_DEFAULTS = {"condition_guard": "none", "condition_calib": "free", "site": "S?"}
LOG_GLOB = "*_study_*.csv"


def _lines(spark: SparkSession, folder: str, glob: str, include: Sequence[str]) -> DataFrame:
    d = spark.read.option("pathGlobFilter", glob).text(folder).select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block_start")
    )
    if include:
        hit = F.lit(False)
        for part in include:
            hit = hit | F.col("file").contains(part)
        d = d.where(hit)  # a filter on file metadata prunes whole files
    return d.withColumn("line", F.monotonically_increasing_id())


def read_event_logs(spark: SparkSession, folder: str, include: Sequence[str] = (), glob: str = LOG_GLOB) -> DataFrame:
    """All logs of a folder whatever their header generation, one row per event.

    Each file's own header names its columns (a positional schema would shift values), missing
    columns are filled, and cue_recorded tells a log that has cue_zone from one that never had it.
    `seq` numbers the rows of a session in file order. Fails when no log matches.
    """
    lines = _lines(spark, folder, glob, include)
    names = F.split("value", ",")
    is_header = F.array_contains(names, "t_ms") & F.array_contains(names, "event")
    heads = lines.where(is_header).groupBy("file").agg(F.split(F.trim(F.min("value")), ",").alias("names"))
    width = heads.agg(F.max(F.size("names"))).first()[0]
    if width is None:
        raise FileNotFoundError(f"no session log in {folder} matches {list(include) or glob}")
    body = attach(lines.where(~is_header & (F.trim("value") != "")), heads, ["file"], ["line"], how="inner")
    # one parse for every generation: values by place, then each column from the place its file gives it
    values = F.from_csv("value", ", ".join(f"v{i} string" for i in range(width)))
    rows = body.select("file", "block_start", "line", "names", values.alias("r")).withColumn("r", F.array(*[F.col(f"r.v{i}") for i in range(width)]))
    own = [F.get("r", (F.array_position("names", c) - 1).cast("int")).try_cast(t).alias(c) for c, t in LOG_TYPES.items()]
    d = rows.select("file", "block_start", "line", *own, F.array_contains("names", "cue_zone").alias("cue_recorded"))
    d = d.fillna(LOG_DEFAULTS)
    d = running(d, ["file"], "block_start", ["line"], count="seq")
    session = F.regexp_replace("file", r"\.csv$", "")
    return d.select(session.alias("session"), F.split_part("file", F.lit("_"), F.lit(1)).alias("participant"), F.col("seq").cast("bigint").alias("seq"), *LOG_TYPES, "cue_recorded")


FRAME_STREAM = (
    "participant string, setup string, task string, video string, frame int, pts_raw_ms double, t_rel_ms double, epoch_ms double,"
    " detected int, px double, py double, tobii_x double, tobii_y double, tobii_dt_ms double"
)
REFERENCE_STREAM = "participant string, task string, video string, t_ms bigint, tx double, ty double, tvalid int"


def read_streams(spark: SparkSession, folder: str, frames: str | T.StructType = FRAME_STREAM, refs: str | T.StructType = REFERENCE_STREAM) -> tuple[DataFrame, DataFrame]:
    """(frames, reference samples) of a study folder, with detected filled and is_laptop derived."""
    def csv(schema: str | T.StructType, glob: str) -> DataFrame:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("pathGlobFilter", glob).csv(folder)

    f = csv(frames, "P_*_frames.csv").fillna({"detected": 0})
    f = f.withColumn("is_laptop", F.coalesce((F.lower("setup") == "laptop").cast("int"), F.lit(0)))
    return f, csv(refs, "P_*_tobii.csv")


def read_characteristics(spark: SparkSession, path: str) -> DataFrame:
    """(participant, setup, screen_w_px, screen_h_px): rows that start with P_ and parse; the last
    row of a participant counts."""
    parts = F.split("value", ",")
    d = spark.read.text(path).where(F.startswith("value", F.lit("P_"))).withColumn("line", F.monotonically_increasing_id())
    d = d.select(
        F.get(parts, F.lit(0)).alias("participant"), F.trim(F.get(parts, F.lit(3))).alias("setup"),
        F.trim(F.get(parts, F.lit(4))).try_cast("int").alias("screen_w_px"), F.trim(F.get(parts, F.lit(5))).try_cast("int").alias("screen_h_px"), "line",
    )
    ok = d.where("setup IS NOT NULL AND screen_w_px IS NOT NULL AND screen_h_px IS NOT NULL")
    last = ok.groupBy("participant").agg(F.max_by(F.struct("setup", "screen_w_px", "screen_h_px"), "line").alias("r"))
    return last.select("participant", "r.*")


def keep_interval(refs: DataFrame, frames: DataFrame, keys: Sequence[str], t: str, frame_t: str, margin: int = 500) -> DataFrame:
    """Reference samples from `margin` before each stream's first frame to `margin` after its last."""
    span = frames.groupBy(*keys).agg((F.min(frame_t) - margin).alias("_from"), (F.max(frame_t) + margin).alias("_to"))
    j = attach(refs, span, keys, [t], how="inner")
    return j.where((F.col(t) >= F.col("_from")) & (F.col(t) <= F.col("_to"))).drop("_from", "_to")
