"""Interface event log -> trials, selections, condition tables, hypotheses.

Input columns: participant, trial (or any trial key), seq (order in the log), event, item,
cue_item, cue_zone, detail, frame_ms and the condition columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.scores import READING_WINDOW_S, bits_per_selection, rate, same_item
from evalgrid.operators.resample import bootstrap_ci, paired_differences
from evalgrid.operators.skew import attach, quantiles
from evalgrid.session import cut_lineage

# Frame times at or above this are not frame times; design rule; match band.
FRAME_MS_CAP = 500
DESIGN_RATE = 0.05
PREDICTION_BAND = 0.10


def trial_starts(log: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Zone of the cue when each trial began: first logged row that is not the trial's end.

    By default rows without a cue zone are passed over; `strict` takes the very first row.
    """
    rows = log.where(F.col("event") != "trial_end")
    if strict:
        first = F.min_by(F.struct("cue_zone"), "seq")["cue_zone"]
    else:
        first = F.min_by("cue_zone", F.when(F.col("cue_zone").isNotNull(), F.col("seq")))
    return rows.groupBy(*keys).agg(first.alias("cue_zone_at_start"))


def reachability(log: DataFrame, keys: Sequence[str], recorded_by: str, strict: bool = False) -> DataFrame:
    """Was the cue on screen at the start? Where `recorded_by` (a participant or session) never
    recorded cue zones there is no evidence, and the trial is kept."""
    seen = log.groupBy(recorded_by).agg((F.count("cue_zone") > 0).alias("cue_recorded"))
    spread = [k for k in keys if k != recorded_by]
    r = attach(trial_starts(log, keys, strict), seen, [recorded_by], spread)
    return r.withColumn("reachable", ~F.col("cue_recorded") | F.col("cue_zone_at_start").isNotNull())


def exclusion_report(reach: DataFrame, by: str) -> DataFrame:
    return reach.groupBy(by).agg(
        F.count(F.lit(1)).alias("trials"),
        F.sum((~F.col("reachable")).cast("bigint")).alias("excluded"),
        F.first("cue_recorded").alias("cue_recorded"),
    )


def keep_reachable(rows: DataFrame, reach: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows of unreachable trials; a trial without a verdict is kept."""
    j = rows.join(reach.select(*keys, "reachable"), list(keys), "left")
    return j.where(F.coalesce("reachable", F.lit(True))).drop("reachable")


def selections(log: DataFrame) -> DataFrame:
    return log.where(F.col("event").isin("select", "reject")).withColumn("correct", same_item(F.col("item"), F.col("cue_item")))


def trial_ends(log: DataFrame, reading_s: float = READING_WINDOW_S) -> DataFrame:
    """Closed trials with `wrong`, `seconds_raw` and `seconds` (reading window taken off).

    The duration is the numeric detail; only if no trial of the log has one is it frame_ms.
    """
    ends = log.where(F.col("event") == "trial_end")
    ends = ends.withColumn("_d", F.expr("try_cast(detail AS DOUBLE)"))
    has = ends.agg((F.count("_d") > 0).alias("has")).scalar()
    ends = ends.withColumn("raw_ms", F.when(has, F.col("_d")).otherwise(F.col("frame_ms").cast("double"))).drop("_d")
    left = F.when(F.col("raw_ms").isNotNull(), F.greatest(F.col("raw_ms") - 1000 * reading_s, F.lit(0.0)))
    return ends.select(
        "*", left.alias("ms"), (F.col("raw_ms") / 1000).alias("seconds_raw"), (left / 1000).alias("seconds"),
        (~same_item(F.col("item"), F.col("cue_item"))).alias("wrong"),
    )


def condition_cells(sel: DataFrame, trials: DataFrame, cell: Sequence[str], who: str, reps: int, seed: int = 0) -> DataFrame:
    """Per condition: participants, trials, accuracy, error rate and times, with participant-
    clustered intervals. Both facts are reduced to (cell, participant) first; the summary and the
    bootstrap read only those. Cells without trials are left out."""
    t = trials.groupBy(*cell, who).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("wrong").cast("bigint")).alias("w"), F.sum("ms").alias("s"),
        F.sum("raw_ms").alias("sr"), F.count("raw_ms").alias("ns"), F.avg(F.col("wrong").cast("double")).alias("v"),
    )
    e = sel.groupBy(*cell, who).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("bigint")).alias("c"), F.avg(F.col("correct").cast("double")).alias("v")
    )
    t, e = cut_lineage(t), cut_lineage(e)
    units = e.select(*cell, who, "v", F.lit("acc").alias("of")).unionByName(t.select(*cell, who, "v", F.lit("wrong").alias("of")))
    ci = bootstrap_ci(units, [*cell, "of"], who, "v", reps, seed)
    ends = ci.groupBy(*cell).agg(*[
        F.max(F.when(F.col("of") == of, F.col(c))).alias(f"{of}_{c}") for of in ("acc", "wrong") for c in ("ci_lo", "ci_hi")
    ])
    ts = t.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("participants"), F.sum("n").alias("trials"), (F.sum("w") / F.sum("n")).alias("wrong_item_rate"),
        (rate(F.sum("s"), F.sum("ns")) / 1000).alias("seconds_per_trial"), (rate(F.sum("sr"), F.sum("ns")) / 1000).alias("seconds_incl_reading"),
    )
    es = e.groupBy(*cell).agg(F.sum("n").alias("_sel"), (F.sum("c") / F.sum("n")).alias("per_selection_accuracy"))
    j = ts.join(es, list(cell), "left").join(ends, list(cell), "left")
    return j.withColumn("selections_per_trial", F.coalesce("_sel", F.lit(0)) / F.col("trials")).drop("_sel")


def clustered_accuracy(rows: DataFrame, cell: Sequence[str], who: str, flag: str, reps: int, seed: int = 0) -> DataFrame:
    """Pooled rate over rows with an interval over participant means: (cell, n, estimate, ci)."""
    per = rows.groupBy(*cell, who).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(flag).cast("bigint")).alias("_c"), F.avg(F.col(flag).cast("double")).alias("_v"))
    per = cut_lineage(per)
    pooled = per.groupBy(*cell).agg(F.sum("_n").alias("n"), (F.sum("_c") / F.sum("_n")).alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    ci = bootstrap_ci(per, cell, who, "_v", reps, seed).select(*cell, "ci_lo", "ci_hi")
    return pooled.join(ci, list(cell), "left")


def paired_rates(rows: DataFrame, side: Column, pairs: DataFrame, who: str, flag: str, reps: int, seed: int = 0) -> DataFrame:
    """Difference a - b of per-participant rates, over participants that have both sides."""
    rates = rows.withColumn("_side", side).groupBy("_side", who).agg(F.avg(F.col(flag).cast("double")).alias("_v")).withColumn("_all", F.lit(0))
    diff = paired_differences(rates, pairs, who, ["_all"], "_side", "_v")
    return bootstrap_ci(diff, ["a", "b"], who, "diff", reps, seed)


def frame_time(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median frame time per session, frame rows only (longer values are trial durations)."""
    ok = log.where(F.col("frame_ms") < FRAME_MS_CAP)
    return quantiles(ok, keys, "frame_ms", {"median_ms": 0.5})


def block_range(trials: DataFrame, measure: str) -> DataFrame:
    """Lowest and highest block mean per (pattern, guard), and over both guards ("either")."""
    blocks = trials.groupBy("pattern", "guard", "block").agg(F.avg(F.col(measure).cast("double")).alias("m"))
    p, g = F.col("pattern"), F.col("guard")
    out = blocks.groupingSets([[p, g], [p]], p, g).agg(F.min("m").alias("low"), F.max("m").alias("high"), F.count(F.lit(1)).alias("blocks"))
    return out.withColumn("guard", F.coalesce("guard", F.lit("either")))


def throughput(outcomes: DataFrame, keys: Sequence[str], zones: str) -> DataFrame:
    """Roll-up of message outcomes (selections, seconds, wrong, abandoned, unsayable) per interface.

    Means are over the messages the interface can say; coverage is the share it can say.
    """
    say = ~F.col("unsayable")
    o = outcomes.groupBy(*keys, zones).agg(
        F.count(F.lit(1)).alias("messages"),
        F.avg(say.cast("double")).alias("coverage"),
        F.avg(F.when(say, F.col("selections").cast("double"))).alias("selections_mean"),
        F.avg(F.when(say, F.col("seconds"))).alias("seconds_mean"),
        F.avg(F.when(say, F.col("wrong").cast("double"))).alias("wrong_rate"),
        F.avg(F.when(say, F.col("abandoned").cast("double"))).alias("abandoned_rate"),
    )
    reach = 1 - F.col("wrong_rate")
    ok = reach * F.col("coverage")
    tiny = F.lit(1e-9)
    return o.select(
        "*",
        (F.col("seconds_mean") / F.greatest(tiny, ok)).alias("seconds_per_correct"),
        (F.col("seconds_mean") / F.greatest(tiny, reach)).alias("seconds_per_correct_if_sayable"),
        (60.0 * ok / F.greatest(tiny, F.col("seconds_mean"))).alias("correct_per_minute"),
        bits_per_selection(reach, F.greatest(F.col(zones), F.lit(2)), floor_at_chance=False).alias("bits"),
    )


def design_threshold(swept: DataFrame, keys: Sequence[str], value: str, rate_col: str, limit: float = DESIGN_RATE) -> DataFrame:
    """First swept value whose rate meets the design rule; null where none does."""
    return swept.groupBy(*keys).agg(F.min(F.when(F.col(rate_col) <= limit, F.col(value))).alias("threshold"))


def phase_means(df: DataFrame, phase: str, order: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """Mean of the watched columns per phase, numbered in the given order."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col(phase))
    return df.groupBy(phase).agg(*[F.avg(c).alias(c) for c in watched], F.count(F.lit(1)).alias("n")).withColumn("phase_no", rank)


def observed_vs_predicted(observed: DataFrame, predicted: DataFrame, keys: Sequence[str], band: float = PREDICTION_BAND) -> DataFrame:
    """Join per condition: difference and whether it lies within the band."""
    j = observed.join(predicted, list(keys))
    d = F.col("observed") - F.col("predicted")
    return j.withColumn("difference", d).withColumn("within_band", F.abs(d) <= band)


def operator_table(log: DataFrame, keys: Sequence[str], who: str) -> DataFrame:
    """Attempted / skipped / excluded / analysed trials, hits per trial and per selection, median
    frame time; per operator and pooled. Every row is counted under both in one pass."""
    starts = trial_starts(log, keys)
    level = F.explode(F.array(F.col(who).cast("string"), F.lit("pooled"))).alias("who")
    ends = log.where(F.col("event") == "trial_end").join(starts, list(keys), "left")
    ok, skipped, on = same_item(F.col("item"), F.col("cue_item")), F.coalesce(F.col("detail") == "skipped", F.lit(False)), F.col("cue_zone_at_start").isNotNull()

    def n(c: Column) -> Column:
        return F.sum(c.cast("bigint"))

    t = ends.select(level, ok.alias("ok"), skipped.alias("sk"), on.alias("on")).groupBy("who").agg(
        F.count(F.lit(1)).alias("attempted"), n(F.col("sk")).alias("skipped"), n(~F.col("sk") & ~F.col("on")).alias("excluded"),
        n(~F.col("sk") & F.col("on")).alias("analysed"), n(~F.col("sk") & F.col("on") & F.col("ok")).alias("trial_hits"), n(~F.col("sk") & F.col("ok")).alias("unexcluded_hits"),
    )
    closed = ends.select(*keys, on.alias("on"))
    s = selections(log).join(closed, list(keys), "left").where(F.coalesce("on", F.lit(False)))
    s = s.select(level, "correct").groupBy("who").agg(F.count(F.lit(1)).alias("selections"), n(F.col("correct")).alias("selection_hits"))
    m = frame_time(log.select(level, "frame_ms"), ["who"])
    return t.join(s, "who", "left").join(m, "who", "left")
