import random

from pyspark.sql import functions as F

from evalgrid.operators.chain import jump_chain
from evalgrid.operators.skew import running
from evalgrid.streaming import live as L
from evalgrid.streaming import steps as S


def sessions(spark, n=4):
    rnd, rows = random.Random(8), []
    for s in range(n):
        zone = 0
        for i in range(400):
            if rnd.random() < 0.04:
                zone = rnd.choice([0, 1, 2, None])
            rows.append((s, i + 1, i * 33, zone, float(rnd.choice([20, 90]) if i > 150 else 20)))
    return spark.createDataFrame(rows, "session int, seq bigint, t bigint, zone int, frame_ms double")


def stream_of(spark, df, tmp_path, by, parts=3):
    """A file stream that delivers the rows in `by` order over several micro-batches."""
    src = str(tmp_path / "in")
    low, top = df.agg(F.min(by), F.max(by) + 1).first()
    cuts = [low + (top - low) * i // parts for i in range(parts + 1)]
    for a, b in zip(cuts, cuts[1:]):
        df.where((F.col(by) >= a) & (F.col(by) < b)).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def drain(spark, out, tmp_path, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def key(df):
    return sorted(map(str, df.collect()))


def chosen(spark):
    rnd = random.Random(9)
    rows = [(s, i + 1, i * 500 + s, rnd.randrange(3)) for s in range(3) for i in range(60)]
    return spark.createDataFrame([*rows, *[(None, i + 1, i * 500, i % 3) for i in range(20)]], "session int, seq bigint, t bigint, zone int")


def test_greedy_chain_equals_a_walk(spark):
    rnd = random.Random(4)
    rows = sorted({(s, rnd.randrange(4000)) for s in (1, 2, None) for _ in range(150 if s else 7)}, key=str)
    want = set()
    for s in (1, 2, None):
        free = -1
        for t in sorted(t for k, t in rows if k == s):
            if t >= free:
                want.add((s, t))
                free = t + 100 + t % 7
    d = spark.createDataFrame([*rows, (1, None)], "k int, t bigint").withColumn("more", F.col("t") * 2)
    for slot in (50, 10_000):
        got = jump_chain(d, ["k"], "t", F.col("t") + 100 + F.col("t") % 7, slot)
        assert {(r["k"], r["t"]) for r in got.collect()} == want and got.columns == d.columns
    assert jump_chain(d.limit(0), ["k"], "t", F.col("t") + 1, 9).count() == 0


def test_dwell_on_a_stream_equals_batch(spark, tmp_path):
    d = sessions(spark).withColumn("ts", F.timestamp_millis(F.col("t") + DAY_MS)).select("session", "t", "ts", "zone")
    def find(x):
        return L.dwell_candidates(x, ["session"], "ts", "zone", 3, "500 milliseconds", "100 milliseconds", 0.6, 10, "1 second")

    got = drain(spark, find(stream_of(spark, d, tmp_path, "t")), tmp_path, "dwell")
    batch = find(d)
    closed = got.agg(F.max("t")).first()[0]
    assert got.count() > 50 and key(got) == key(batch.where(F.col("t") <= closed))
    frames = [r for r in d.where("session = 0").collect()]
    for r in batch.where("session = 0").collect():
        end = r["t"] // 1000 - DAY_MS
        seen = [f["zone"] for f in frames if end - 500 <= f["t"] < end]
        assert seen.count(r["zone"]) >= 0.6 * len(seen) and r["zone"] == max(range(3), key=lambda z: (seen.count(z), -z))
    kept = L.refractory(batch, ["session"], "t", 900_000, 10**7)
    fed = stream_of(spark, batch, tmp_path / "again", "t")
    assert key(drain(spark, L.refractory_stream(fed, ["session"], "t", "zone", 900_000), tmp_path, "quiet")) == key(kept)
    assert batch.count() > kept.count() > 10


def test_two_step_on_a_stream_equals_batch(spark, tmp_path):
    d = chosen(spark)
    for slot in (7, 100_000):
        batch = L.two_step(d, ["session"], "seq", "zone", slot_len=slot).select("session", "seq", "zone", "step", "item")
        assert batch.where("session IS NULL").count() == 20
    got = drain(spark, L.two_step_stream(stream_of(spark, d.where("session IS NOT NULL"), tmp_path, "seq"), ["session"], "seq", "zone"), tmp_path, "ask")
    assert key(got) == key(batch.where("session IS NOT NULL")) and {r["step"] for r in got.collect()} == {"ask", "select", "cancel"}


def test_timed_and_user_pages(spark):
    d = chosen(spark)
    rows = {(r["session"], r["seq"]): r for r in L.timed_pages(d, ["session"], "t", "seq", 3000, 3, 600, slot_len=11).collect()}
    assert len(rows) == 200
    for (s, n), r in rows.items():
        since = (n - 1) * 500
        assert r["page"] == since // 3000 % 3 and r["locked"] == (since >= 3000 and since % 3000 < 600) and r["cancelled"] == (n > 1 and since // 3000 != (since - 500) // 3000)
    got = {(r["session"], r["seq"]): r for r in L.user_pages(d, ["session"], "seq", "zone", 1, 2, 5, slot_len=13).collect()}
    for s in (0, 1, 2, None):
        page = 0
        for n in range(1, 61 if s is not None else 21):
            r = got[s, n]
            if r["zone"] == 1:
                page = (page + 1) % 3
                assert (r["choice"], r["page"], r["item"]) == ("page", page, None)
            else:
                item = page * 2 + (r["zone"] == 2)
                assert (r["choice"], r["page"], r["item"]) == (("item", page, item) if item < 5 else ("blank", page, None))


def test_rate_alerts_stream_equals_batch(spark, tmp_path):
    d = sessions(spark)
    batch = L.rate_alerts_batch(d, ["session"], "t", "seq", "frame_ms", limit=50.0)
    got = drain(spark, L.rate_alerts_stream(stream_of(spark, d, tmp_path, "t"), ["session"], "t", "seq", "frame_ms", limit=50.0), tmp_path, "alerts")
    assert batch.count() >= 4 and key(got) == key(batch.select(got.columns))
    times = [r["t"] for r in batch.where("session = 0").orderBy("t").collect()]
    assert all(b - a > 4000 for a, b in zip(times, times[1:]))


def test_trials_stream_equals_batch(spark, tmp_path):
    from evalgrid.plans.roles import event_log

    log = event_log(spark, "/root/testdata/sf0.001")
    batch = L.trials_batch(log, "participant").select("participant", "trial", "selections", "rejects", "closed_at", "item", "correct")
    cols = log.select("participant", "trial", "seq", "t_us", "event", "item", "cue_item")
    got = drain(spark, L.trials_stream(stream_of(spark, cols, tmp_path, "seq"), "participant"), tmp_path, "trials")
    assert batch.count() > 100 and key(got.select(batch.columns)) == key(batch)


def test_repeat_confirm_equals_state_machine(spark):
    rnd, rows, want = random.Random(6), [], {}
    for s in range(3):
        held = None
        for i in range(1, 200):
            z = rnd.randrange(3)
            rows.append((s, i, z))
            if held == z:
                want[s, i], held = "select", None
            else:
                want[s, i], held = ("first of two" if held is None else "disagreed"), z
    d = spark.createDataFrame(rows, "s int, seq bigint, zone int")
    for slot in (10, 100_000):
        assert {(r["s"], r["seq"]): r["verdict"] for r in L.repeat_confirm(d, ["s"], "seq", "zone", slot).collect()} == want


DAY_MS = 86_400_000  # rows at the epoch itself would be late from the start


def timed(spark, hours):
    rows = [(s, DAY_MS + h * 3600_000 + s * 1000) for h in range(hours) for s in range(3)]
    d = spark.createDataFrame(rows, "session int, t_ms bigint")
    return d.withColumn("ts", F.timestamp_millis("t_ms"))


def test_page_timer_fires_by_event_time(spark, tmp_path):
    d = timed(spark, 12)
    out = L.page_timer_stream(stream_of(spark, d, tmp_path, "t_ms", 4), ["session"], 2 * 3600_000, 3)
    got = [tuple(r) for r in drain(spark, out, tmp_path, "pages").collect()]
    assert got and len(got) == len(set(got))
    for s in range(3):
        mine = sorted(r for r in got if r[0] == s)
        first = DAY_MS + s * 1000
        assert [r[1] for r in mine] == [first + 2 * 3600_000 * (i + 1) for i in range(len(mine))]
        assert [r[2] for r in mine] == [(i + 1) % 3 for i in range(len(mine))]


def test_windows_and_dedupe_on_a_stream(spark, tmp_path):
    d = timed(spark, 24)
    d = d.unionByName(d.where("session = 1"))
    src = stream_of(spark, d, tmp_path, "t_ms")
    got = drain(spark, L.windowed_counts(src, "ts", ["session"], "6 hours"), tmp_path, "win")
    batch = L.windowed_counts(d, "ts", ["session"], "6 hours")
    closed = got.agg(F.max("w_start")).first()[0]
    assert key(got) == key(batch.where(F.col("w_start") <= closed)) and got.count() >= 6
    once = drain(spark, L.first_seen(src, "ts", ["session", "t_ms"], "1 day"), tmp_path, "once")
    assert once.count() == 72


def shuffled(spark, d, tmp_path, late=4000):
    """Rows of `d` (t in ms) as a stream that delivers them out of order, up to `late` ms behind,
    over five micro-batches, with a far row of another session that lets all others out."""
    rnd = random.Random(3)
    rows = [(*r, r["t"] + rnd.randrange(late)) for r in d.collect()]
    far = (99, 1, max(r[2] for r in rows) + 10**8, 0, max(r[-1] for r in rows) + 1)
    x = spark.createDataFrame([*rows, far], f"{', '.join(f'{n} {t}' for n, t in d.dtypes)}, arrival bigint")
    x = stream_of(spark, x.withColumn("ts", F.timestamp_millis(F.col("t") + DAY_MS)), tmp_path, "arrival", 5)
    return x.drop("arrival")


def some_choices(spark):
    """Choices with gaps, repeats and unknown zones; (session, seq, t, zone)."""
    rnd, rows = random.Random(12), []
    for s in range(4):
        t, zone = s * 17, 0
        for i in range(120):
            t += rnd.choice([200, 500, 900])
            zone = zone if rnd.random() < 0.4 else rnd.choice([0, 1, 2, None])
            rows.append((s, i + 1, t, zone))
    return spark.createDataFrame(rows, "session int, seq bigint, t bigint, zone int")


def run_ordered(spark, d, tmp_path, name, stages, fields):
    out = S.ordered(shuffled(spark, d, tmp_path), ["session"], "ts", ["seq"], stages, fields, "5 seconds")
    return drain(spark, out, tmp_path, name).where("session < 99")


def test_repeat_guard_on_a_shuffled_stream_equals_batch(spark, tmp_path):
    d = some_choices(spark)
    got = run_ordered(spark, d, tmp_path, "rep", [S.repeat_confirm("zone")], "seq bigint, zone int, verdict string")
    batch = L.repeat_confirm(d, ["session"], "seq", "zone", 13).select(got.columns)
    assert key(got) == key(batch) and {r["verdict"] for r in got.collect()} == {"select", "disagreed", "first of two"}
    nobody = L.repeat_confirm(d.withColumn("session", F.lit(None).cast("int")).where("seq = 1 AND t < 1000").limit(1), ["session"], "seq", "zone")
    assert nobody.count() == 1


def test_timer_locks_and_cancels_on_a_shuffled_stream(spark, tmp_path):
    d = some_choices(spark)
    pages = S.timed_pages("t", 3000, 3, 600)
    got = run_ordered(spark, d, tmp_path, "tp", [pages], "seq bigint, page int, locked boolean, cancelled boolean")
    assert key(got) == key(L.timed_pages(d, ["session"], "t", "seq", 3000, 3, 600).select(got.columns))
    chain = [pages, S.flag("free", lambda r: not r["locked"]), S.repeat_confirm("zone", "cancelled", "free")]
    both = run_ordered(spark, d, tmp_path / "both", "tpr", chain, "seq bigint, page int, zone int, verdict string")
    batch = L.timed_pages(d, ["session"], "t", "seq", 3000, 3, 600)
    batch = L.repeat_within(batch, ["session"], "seq", "zone", F.col("cancelled"), ~F.col("locked"), 11).select(both.columns)
    assert key(both) == key(batch) and 0 < both.count() < d.count()
    alone = L.repeat_confirm(d, ["session"], "seq", "zone").where("verdict = 'select'").count()
    assert 0 < both.where("verdict = 'select'").count() < alone  # turns end what was half chosen


def test_user_pages_on_a_shuffled_stream_equal_batch(spark, tmp_path):
    d = some_choices(spark)
    pages = S.user_pages("zone", 1, 2, 5)
    got = run_ordered(spark, d, tmp_path, "up", [pages], "seq bigint, page int, choice string, item int")
    batch = L.user_pages(d, ["session"], "seq", "zone", 1, 2, 5)
    assert key(got) == key(batch.select(got.columns))
    chain = [pages, S.flag("turned", lambda r: r["choice"] == "page"), S.flag("named", lambda r: r["choice"] == "item"), S.repeat_confirm("zone", "turned", "named")]
    both = run_ordered(spark, d, tmp_path / "both", "upr", chain, "seq bigint, item int, verdict string")
    want = L.repeat_within(batch, ["session"], "seq", "zone", F.col("choice") == "page", F.col("choice") == "item", 17)
    assert key(both) == key(want.select(both.columns)) and both.count() > 50


def test_silence_then_two_steps_on_a_shuffled_stream(spark, tmp_path):
    d = some_choices(spark)
    chain = [S.refractory("t", 800), S.two_step("zone")]
    got = run_ordered(spark, d, tmp_path, "quiet2", chain, "seq bigint, zone int, step string, asked int")
    want = []
    for s in range(4):
        free, asked = -1, None
        for r in d.where(F.col("session") == s).orderBy("seq").collect():
            if r["t"] < free:
                continue
            free = r["t"] + 800
            step = "ask" if asked is None else "select" if r["zone"] == 0 else "cancel"
            want.append((s, r["seq"], r["zone"], step, r["zone"] if asked is None else asked[0]))
            asked = (r["zone"],) if asked is None else None
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_dwell_windows_feed_the_chain_in_one_stream(spark, tmp_path):
    d = sessions(spark).select("session", "seq", "t", "zone")
    def find(x):
        return L.dwell_candidates(x, ["session"], "ts", "zone", 3, "500 milliseconds", "100 milliseconds", 0.6, 10, "5 seconds", closed_at="closed")

    chain = [S.refractory("t", 900_000), S.repeat_confirm("zone")]
    out = S.ordered(find(shuffled(spark, d, tmp_path)), ["session"], "closed", ["t"], chain, "t bigint, zone int, verdict string", None)
    got = drain(spark, out, tmp_path, "whole").where("session < 99")
    kept = L.refractory(find(d.withColumn("ts", F.timestamp_millis(F.col("t") + DAY_MS))).drop("closed"), ["session"], "t", 900_000, 10**7)
    batch = L.repeat_confirm(running(kept.withColumn("_s", F.floor(F.col("t") / 10**7)), ["session"], "_s", ["t"], count="n"), ["session"], "n", "zone")
    assert key(got) == key(batch.select(got.columns)) and got.count() > 10


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [(1, 1, 50_000, 0, 0), (2, 1, 90_000, 0, 1), (1, 2, 10_000, 1, 2), (1, 3, 95_000, 2, 2), (1, 4, None, 2, 2), (2, 2, 10**7, 0, 3)]
    d = spark.createDataFrame(rows, "session int, seq bigint, t bigint, zone int, arrival bigint").withColumn("ts", F.timestamp_millis(F.col("t") + DAY_MS))
    out = S.ordered(stream_of(spark, d, tmp_path, "arrival", 4).drop("arrival"), ["session"], "ts", ["seq"], [], "seq bigint", "5 seconds")
    assert {tuple(r) for r in drain(spark, out, tmp_path, "late").collect()} == {(1, 1), (2, 1), (1, 3)}
