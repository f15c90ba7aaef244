"""Stream operators keyed by session, each with a batch twin over the same definition."""

from __future__ import annotations

import statistics
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from evalgrid.functions.scores import same_item
from evalgrid.operators.chain import jump_chain
from evalgrid.operators.skew import attach, join_on, running
from evalgrid.operators.windows import MIN_FPS, RATE_FRAMES, slow_frames
from evalgrid.streaming import keyed

# Fixed value: least time between two slowness alerts, in ms.
ALERT_EVERY = 4000


def dwell_candidates(df: DataFrame, keys: Sequence[str], ts: str, zone: str, zones: int, dwell: str, step: str, min_share: float = 0.6, min_frames: int = 1, delay: str = "10 minutes", closed_at: str | None = None) -> DataFrame:
    """(keys, t, zone): sliding windows in which one zone fills enough of all frames, unseen ones
    counted; `t` is the window's end in microseconds. Ties go to the lower zone; windows with fewer
    than `min_frames` frames are not observed well enough. The same on a stream and on a table;
    `closed_at` adds the window's event time, which the next stateful step of a stream needs."""
    if df.isStreaming:
        df = df.withWatermark(ts, delay)
    votes = [F.count_if(F.col(zone) == z).alias(f"_z{z}") for z in range(zones)]
    g = df.groupBy(F.window(ts, dwell, step), *keys).agg(F.count(F.lit(1)).alias("_n"), *votes)
    best = F.array_max(F.array(*[F.struct(F.col(f"_z{z}").alias("n"), F.lit(-z).alias("low")) for z in range(zones)]))
    closed = [F.window_time("window").alias(closed_at)] if closed_at else []
    g = g.where(F.col("_n") >= min_frames).select(*keys, F.unix_micros("window.end").alias("t"), "_n", best.alias("_b"), *closed)
    return g.where(F.col("_b.n") >= min_share * F.col("_n")).select(*keys, "t", (-F.col("_b.low")).alias("zone"), *([closed_at] if closed_at else []))


def refractory(candidates: DataFrame, keys: Sequence[str], t: str, gap: int, slot_len: int) -> DataFrame:
    """Candidates that count when each one silences its key for `gap`: the first, then always the
    first at least `gap` later. One candidate per key and time."""
    return jump_chain(candidates, keys, t, F.col(t) + gap, slot_len)


def refractory_stream(candidates: DataFrame, keys: Sequence[str], t: str, zone: str, gap: int) -> DataFrame:
    """The stream twin: the state is when the key's silence ends."""

    def step(st: dict, row: dict) -> list:
        if st["until"] is not None and row[t] < st["until"]:
            return []
        st["until"] = int(row[t]) + gap
        return [(int(row[t]), int(row[zone]))]

    return keyed.run_stream(candidates.select(*keys, t, zone), keys, [t], lambda row: {"until": None}, step, "t bigint, zone int")


def two_step(df: DataFrame, keys: Sequence[str], seq: str, zone: str, yes: int = 0, slot_len: int = 100_000) -> DataFrame:
    """Adds `step` and `item`: odd choices of a key ask about their own zone, the even one after it
    answers - zone `yes` selects what was asked about, any other cancels it. `seq` numbers each key's
    rows from 1, so what was asked about is the value one row back."""
    d = running(df.withColumn("_slot", F.floor(F.col(seq) / slot_len)), keys, "_slot", [seq], lasts={"_asked": zone})
    answer = F.col(seq) % 2 == 0
    step = F.when(~answer, "ask").when(F.col(zone) == yes, "select").otherwise("cancel")
    return d.select(*df.columns, step.alias("step"), F.when(answer, F.col("_asked")).otherwise(F.col(zone)).alias("item"))


def two_step_stream(stream: DataFrame, keys: Sequence[str], seq: str, zone: str, yes: int = 0) -> DataFrame:
    """The stream twin: the state is the zone asked about."""

    def step(st: dict, row: dict) -> list:
        z, asked = int(row[zone]), st["asked"]
        st["asked"] = z if asked is None else None
        return [(int(row[seq]), z, "ask", z) if asked is None else (int(row[seq]), z, "select" if z == yes else "cancel", asked)]

    return keyed.run_stream(stream.select(*keys, seq, zone), keys, [seq], lambda row: {"asked": None}, step, "seq bigint, zone int, step string, item int")


def timed_pages(df: DataFrame, keys: Sequence[str], t: str, seq: str, every: int, pages: int, pause: int, slot_len: int = 100_000) -> DataFrame:
    """Adds what a timer that turns the page every `every` makes of each row of a session, counted
    from its first row: `page`, `locked` (within `pause` of a turn) and `cancelled` (a turn since the
    row before, which ends what was half chosen). `seq` numbers each key's rows from 1."""
    began = df.groupBy(*keys).agg(F.min(t).alias("_t0"))
    d = attach(df, began, keys, [seq], null_safe=True)
    since = F.col(t) - F.col("_t0")
    d = d.withColumn("_turns", F.floor(since / every)).withColumn("_slot", F.floor(F.col(seq) / slot_len))
    d = running(d, keys, "_slot", [seq], lasts={"_before": "_turns"})
    locked = (F.col("_turns") > 0) & (since - F.col("_turns") * every < pause)
    return d.select(*df.columns, (F.col("_turns") % pages).cast("int").alias("page"), locked.alias("locked"), F.coalesce(F.col("_turns") != F.col("_before"), F.lit(False)).alias("cancelled"))


def user_pages(df: DataFrame, keys: Sequence[str], seq: str, zone: str, turn: int, per_page: int, items: int, slot_len: int = 100_000) -> DataFrame:
    """Adds what a choice means where zone `turn` turns the page and the others hold items: `page`
    (after the choice), `choice` (page, item or blank) and `item` (its number, null unless an item).
    A turn ends what was half chosen; slots behind the last item are blank and mean nothing."""
    pages = max(1, -(-items // per_page))
    d = df.withColumn("_turn", (F.col(zone) == turn).cast("int")).withColumn("_slot", F.floor(F.col(seq) / slot_len))
    d = running(d, keys, "_slot", [seq], sums={"_turns": "_turn"})
    number = (F.col("_turns") % pages) * per_page + F.col(zone) - (F.col(zone) > turn).cast("int")
    choice = F.when(F.col("_turn") == 1, "page").when(number < items, "item").otherwise("blank")
    page = ((F.col("_turns") + F.col("_turn")) % pages).cast("int")
    return d.select(*df.columns, page.alias("page"), choice.alias("choice"), F.when(choice == "item", number.cast("int")).alias("item"))


def rate_alerts_stream(stream: DataFrame, keys: Sequence[str], t: str, seq: str, value: str, limit: float = 1000 / MIN_FPS, last: int = RATE_FRAMES, every: int = ALERT_EVERY) -> DataFrame:
    """(keys, t, median) when the median of the last frames is above the limit, throttled."""

    def begin(row: dict) -> dict:
        return {"recent": [], "alerted": None}

    def step(st: dict, row: dict) -> list:
        st["recent"] = [*st["recent"], float(row[value])][-last:]
        if len(st["recent"]) < last:
            return []
        middle, now = statistics.median(st["recent"]), int(row[t])
        if middle <= limit or (st["alerted"] is not None and now - st["alerted"] <= every):
            return []
        st["alerted"] = now
        return [(now, middle)]

    return keyed.run_stream(stream.select(*keys, t, seq, value), keys, [t, seq], begin, step, "t bigint, median_ms double")


def rate_alerts_batch(df: DataFrame, keys: Sequence[str], t: str, seq: str, value: str, limit: float = 1000 / MIN_FPS, last: int = RATE_FRAMES, every: int = ALERT_EVERY) -> DataFrame:
    """Batch twin: the sliding medians are computed in parallel, and the alerts are the greedy chain
    of the slow frames. `seq` numbers each session's rows from 1."""
    slow = slow_frames(df.select(*keys, t, seq, value), keys, seq, value, limit, last).where("slow")
    slow = slow.groupBy(*keys, F.col(t).cast("bigint").alias("t")).agg(F.min_by("recent", seq).alias("median_ms"))
    return jump_chain(slow, keys, "t", F.col("t") + every + 1, 1000 * every)


def repeat_confirm(df: DataFrame, keys: Sequence[str], seq: str, value: str, slot_len: int = 100_000) -> DataFrame:
    """Verdict of each value under "same value twice in a row": select, first of two, disagreed.

    Batch twin without state: in a run of equal values every second one selects; a run's first
    value disagrees if the run before it ended half way. `seq` numbers each key's rows from 1; a null
    equals nothing, null keys are keys.
    """
    d = df.withColumn("_slot", F.floor(F.col(seq) / slot_len)).withColumn("_v", F.struct(F.col(value).alias("v")))
    d = running(d, keys, "_slot", [seq], lasts={"_prev": "_v"})
    d = d.withColumn("_new", F.coalesce(F.col("_prev.v") != F.col(value), F.lit(True)).cast("int"))
    d = running(d, keys, "_slot", [seq], sums={"_runs": "_new"}).withColumn("_run", F.col("_runs") + F.col("_new"))
    runs = d.groupBy(*keys, "_run").agg(F.min(seq).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = runs.select(*keys, (F.col("_run") + 1).alias("_run"), (F.col("_n") % 2 == 1).alias("_open"))
    d = join_on(d, join_on(runs, before, [*keys, "_run"], "left"), [*keys, "_run"])
    place = F.col(seq) - F.col("_first")
    verdict = F.when(place % 2 == 1, "select").when((place == 0) & F.coalesce("_open", F.lit(False)), "disagreed").otherwise("first of two")
    return d.select(*df.columns, verdict.alias("verdict"))


def repeat_within(df: DataFrame, keys: Sequence[str], seq: str, value: str, ended: Column, counts: Column, slot_len: int = 100_000) -> DataFrame:
    """`repeat_confirm` where a row whose `ended` holds first ends what was half chosen, as a page
    turn does, and only rows whose `counts` holds are choices (the others are left out). `seq` numbers
    each key's rows from 1."""
    d = df.withColumn("_slot", F.floor(F.col(seq) / slot_len)).withColumn("_end", F.coalesce(ended, F.lit(False)).cast("int"))
    d = running(d, keys, "_slot", [seq], sums={"_ends": "_end"}).withColumn("_part", F.col("_ends") + F.col("_end"))
    d = running(d.where(counts), [*keys, "_part"], "_slot", [seq], count="_nth")
    return repeat_confirm(d.drop("_slot"), [*keys, "_part"], "_nth", value, slot_len).select(*df.columns, "verdict")


class PageTimer(StatefulProcessor):
    """Turns a page every `every` ms of event time by an event-time timer, without any input."""

    def __init__(self, every: int, pages: int, names: Sequence[str]):
        self.every, self.pages, self.names = every, pages, list(names)

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "page int, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows))
        if not self.at.exists():
            due = int(d["t_ms"].min()) + self.every
            self.at.update((0, due))
            self.handle.registerTimer(due)
        yield pd.DataFrame([], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        page, due = self.at.get()
        now = timerValues.getCurrentWatermarkInMs()
        out = []
        while due <= now:
            page, due = (page + 1) % self.pages, due + self.every
            out.append((*key, due - self.every, page))
        self.at.update((page, due))
        self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def page_timer_stream(stream: DataFrame, keys: Sequence[str], every: int, pages: int, delay: str = "0 seconds") -> DataFrame:
    """stream: keys, ts TIMESTAMP, t_ms BIGINT -> keys, t_ms, page."""
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{kinds}, t_ms bigint, page int")
    return stream.withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=PageTimer(every, pages, schema.names), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


TRIAL_FIELDS = "trial int, selections bigint, rejects bigint, closed_at bigint, item bigint, correct boolean"


def _trial_step():
    def begin(row: dict) -> dict:
        return {"trial": 0, "select": 0, "reject": 0}

    def step(st: dict, row: dict) -> list:
        if row["event"] in ("select", "reject"):
            st[row["event"]] += 1
        if row["event"] != "trial_end":
            return []
        done = (st["trial"], st["select"], st["reject"], int(row["t_us"]), row["item"], row["item"] is not None and row["item"] == row["cue_item"])
        st.update({"trial": st["trial"] + 1, "select": 0, "reject": 0})
        return [done]

    return begin, step


def trials_stream(stream: DataFrame, who: str) -> DataFrame:
    """Close a trial on trial_end and emit its counts, end, item and correctness."""
    begin, step = _trial_step()
    return keyed.run_stream(stream.select(who, "t_us", "seq", "event", "item", "cue_item"), [who], ["seq"], begin, step, TRIAL_FIELDS)


def trials_batch(log: DataFrame, who: str) -> DataFrame:
    """Batch twin where the log already carries its trial number: one aggregate, no state."""
    end = F.col("event") == "trial_end"
    g = log.groupBy(who, "trial").agg(
        F.count_if(F.col("event") == "select").alias("selections"), F.count_if(F.col("event") == "reject").alias("rejects"),
        F.max(F.when(end, F.col("t_us"))).alias("closed_at"), F.max(F.when(end, F.col("item"))).alias("item"),
        F.bool_or(end & same_item(F.col("item"), F.col("cue_item"))).alias("correct"),
    )
    return g.where(F.col("closed_at").isNotNull())


def windowed_counts(df: DataFrame, ts: str, keys: Sequence[str], size: str, delay: str = "10 minutes") -> DataFrame:
    """Counts per key and event-time window; on a stream, closed windows only (append mode)."""
    if df.isStreaming:
        df = df.withWatermark(ts, delay)
    g = df.groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("w_start"), *keys, "n")


def first_seen(df: DataFrame, ts: str, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a key; on a stream the memory of a key is bounded by the watermark."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))
