import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid.sources import features, jsonl, logs, sinks

OLD = "t_ms,block,condition_pattern,condition_guard,trial,cue_item,event,zone,item,page,detail,frame_ms,px,py"
MID = "t_ms,block,condition_pattern,condition_guard,condition_calib,trial,cue_item,event,zone,item,page,detail,frame_ms,px,py"
NEW = MID + ",eye_px,cue_zone"
SITE = "site," + NEW


@pytest.fixture
def log_dir(tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "P00_study_1.csv").write_text(OLD + "\n5,0,direct,,1,cup,dwell,2,,0,,14.5,0.9,0.5\n5,0,direct,,1,cup,select,2,cup,0,,14.5,0.9,0.5\n")
    (d / "P00_study_2.csv").write_text(MID + "\n7,0,scan,double,,1,tea,trial_end,1,\"tea, hot\",0,1200,900.0,0.5,0.5\n")
    (d / "P01_study_3.csv").write_text(NEW + "\n9,0,scan,none,calibrated,1,tea,select,1,tea,0,,20.0,0.5,0.5,55.0,1.0\n9,0,scan,none,calibrated,1,tea,reject,1,tea,0,,20.0,0.5,0.5,55.0,\n")
    (d / "P02_study_4.csv").write_text(SITE + "\nS2,9,0,scan,none,free,1,tea,select,1,tea,0,,20.0,0.5,0.5,55.0,\n")
    (d / "P03_study_5.csv").write_text(NEW + "\n")
    (d / "P00_check_6.csv").write_text(OLD + "\n1,0,direct,,1,cup,dwell,2,,0,,14.5,0.9,0.5\n")
    return str(d)


def test_event_logs_with_drifting_headers(spark, log_dir):
    d = logs.read_event_logs(spark, log_dir)
    rows = {(r["session"], r["seq"]): r for r in d.collect()}
    assert len(rows) == 6
    first = rows["P00_study_1", 1]
    assert (first["participant"], first["condition_guard"], first["condition_calib"], first["site"]) == ("P00", "none", "free", "S?")
    assert (first["event"], rows["P00_study_1", 2]["event"]) == ("dwell", "select")  # file order, not time
    assert rows["P00_study_2", 1]["item"] == "tea, hot" and rows["P00_study_2", 1]["frame_ms"] == 900.0
    assert rows["P01_study_3", 1]["cue_zone"] == 1.0 and rows["P01_study_3", 2]["cue_zone"] is None
    assert rows["P02_study_4", 1]["site"] == "S2" and rows["P02_study_4", 1]["t_ms"] == 9
    assert [rows[k]["cue_recorded"] for k in (("P00_study_2", 1), ("P02_study_4", 1))] == [False, True]


def test_event_logs_include(spark, log_dir):
    assert {r["session"] for r in logs.read_event_logs(spark, log_dir, ["_1", "_4"]).collect()} == {"P00_study_1", "P02_study_4"}
    with pytest.raises(FileNotFoundError):
        logs.read_event_logs(spark, log_dir, ["nobody"])


def test_jsonl_half_written(spark, tmp_path):
    p = tmp_path / "out.jsonl"
    p.write_text('{"method":"a","unit":1,"items":["x"]}\n\n{"method":"a","unit":1,"items":["y"]}\n{"method":"b","un')
    good, bad = jsonl.read_jsonl(spark, str(p), T.StructType.fromDDL("method string, unit int, items array<string>"))
    assert (good.count(), bad.count()) == (2, 1)
    last = jsonl.last_record(good.withColumn("seq", F.when(F.array_contains("items", "y"), 2).otherwise(1)), ["method", "unit"], "seq")
    assert last.first()["items"] == ["y"]


def test_sensor_samples(spark, tmp_path):
    def row(t, left, right, lv=1, rv=1):
        return json.dumps({"true_time": t, "left_gaze_point_on_display_area": left, "right_gaze_point_on_display_area": right, "left_pupil_validity": lv, "right_pupil_validity": rv})

    p = tmp_path / "s.txt"
    p.write_text("\n".join([row(1.0, [0.2, 0.4], [0.4, 0.6]), row(1.01, [0.2, 0.4], [0.9, 0.9], rv=0), row(1.02, [0.1, 0.1], [0.1, 0.1], 0, 0), row(1.0, [0.8, 0.8], [0.8, 0.8]), '{"true_ti']))
    good, bad = jsonl.read_jsonl(spark, str(p), jsonl.SENSOR_SCHEMA)
    s = {r["t_ms"]: r for r in jsonl.sensor_samples(good).collect()}
    assert bad.count() == 1 and sorted(s) == [1000, 1010, 1020]
    assert (s[1000]["tx"], s[1000]["ty"]) == (pytest.approx(0.3), pytest.approx(0.5))
    assert s[1010]["tx"] == 0.2 and s[1020]["tvalid"] == 0 and s[1020]["tx"] is None


def test_recording_starts_and_annotations(spark):
    e = spark.createDataFrame([("recording start", "p/dot", 10.0, 1), ("recording start", "p/dot", 20.0, 2), ("stop", "p/dot", 30.0, 3), ("recording start", "", 5.0, 4)], "type string, sessionString string, epoch double, seq int")
    assert [tuple(r) for r in jsonl.recording_starts(e).collect()] == [("p-dot.webm", 20)]
    a = spark.createDataFrame([(1, 5), (1, 3), (1, 5), (2, 9)], "image_id int, category_id int")
    m = spark.createDataFrame([(5, 50), (3, 30)], "category_id int, target_id int")
    assert {r["image_id"]: r["pos"] for r in jsonl.positive_sets(a).collect()} == {1: [3, 5], 2: [9]}
    assert {r["image_id"]: r["pos"] for r in jsonl.positive_sets(a, m).collect()} == {1: [30, 50]}


def test_feature_files(spark, tmp_path):
    schema = T.StructType.fromDDL("subject string, file string, gt_px_x double, gt_px_y double, screen_w_px double, screen_h_px double, detected int, reye_h double")
    head = "subject,file,gt_px_x,gt_px_y,screen_w_px,screen_h_px,detected,reye_h\n"
    (tmp_path / "p00.csv").write_text(head + "p00,day01/1.jpg,100,50,200,100,1,NaN\np00,day02/2.jpg,50,50,200,100,,0.5\n")
    (tmp_path / "p01.csv").write_text(head + "p01,day01/1.jpg,100,50,200,100,1,0.1\n")
    (tmp_path / "p00.dry.csv").write_text(head + "dry,day01/1.jpg,1,1,1,1,1,1\n")
    d = features.read_frames(spark, str(tmp_path), schema)
    rows = {(r["subject"], r["day"]): r for r in d.collect()}
    assert set(rows) == {("p00", "day01"), ("p00", "day02"), ("p01", "day01")}
    assert rows["p00", "day01"]["gx"] == 0.5 and rows["p00", "day01"]["reye_h"] is None and rows["p00", "day02"]["detected"] == 0
    cov = features.coverage(d.groupBy("subject").agg(F.count("*").alias("n")), [], "n")
    assert {r["subject"]: r["low_coverage"] for r in cov.collect()} == {"p00": False, "p01": True}


def test_annotations(spark, tmp_path):
    (tmp_path / "p07").mkdir()
    f = tmp_path / "p07" / "p07.txt"
    f.write_text("day01/1.jpg " + " ".join(str(i) for i in range(26)) + " left\n\n")
    r = features.read_annotations(spark, str(f)).first()
    assert (r["subject"], r["file"], r["gt_px_y"], r["ann_gt2"], r["ann_eval_eye"]) == ("p07", "day01/1.jpg", 1.0, 25.0, "left")
    f.write_text("too short\n")
    with pytest.raises(Exception, match="expected 28 fields"):
        features.read_annotations(spark, str(f)).collect()


def test_streams_and_characteristics(spark, tmp_path):
    (tmp_path / "P_1_frames.csv").write_text("participant,setup,epoch_ms,detected\nP_1,Laptop,10.0,\nP_1,PC,20.0,1\n")
    (tmp_path / "P_1_tobii.csv").write_text("participant,t_ms,tx,tvalid\nP_1,-600,0.1,1\nP_1,15,0.2,1\n")
    f, t = logs.read_streams(spark, str(tmp_path), T.StructType.fromDDL("participant string, setup string, epoch_ms double, detected int"), T.StructType.fromDDL("participant string, t_ms bigint, tx double, tvalid int"))
    assert sorted((r["detected"], r["is_laptop"]) for r in f.collect()) == [(0, 1), (1, 0)]
    assert [r["t_ms"] for r in logs.keep_interval(t, f, ["participant"], "t_ms", "epoch_ms").collect()] == [15]
    (tmp_path / "c.csv").write_text("junk\nP_1,a,b, Laptop ,1280,720\nP_2,a,b,PC,x,720\nP_3,a\nP_1,a,b,PC,1920,1080\n")
    assert [tuple(r) for r in logs.read_characteristics(spark, str(tmp_path / "c.csv")).collect()] == [("P_1", "PC", 1920, 1080)]


def test_resume_and_replace(spark, tmp_path):
    out, calls = str(tmp_path / "out"), []
    work = spark.createDataFrame([(m, u) for m in "ab" for u in range(5)], "method string, unit int")

    def compute(todo):
        calls.append(todo.count())
        return todo.withColumn("score", F.lit(1.0))

    sinks.append_pending(work.where("unit < 3"), out, ["method", "unit"], compute)
    sinks.append_pending(work, out, ["method", "unit"], compute)
    assert calls == [6, 4] and spark.read.parquet(out).count() == 10
    t = str(tmp_path / "t")
    sinks.replace_subjects(spark.createDataFrame([("a", 1), ("b", 1)], "subject string, v int"), t, "subject")
    sinks.replace_subjects(spark.createDataFrame([("b", 2)], "subject string, v int"), t, "subject")
    assert sorted((r["subject"], r["v"]) for r in spark.read.parquet(t).collect()) == [("a", 1), ("b", 2)]
    exp = spark.createDataFrame([("a",), ("a",), ("b",)], "subject string")
    assert [r[0] for r in sinks.incomplete(exp, spark.read.parquet(t), "subject").collect()] == ["a"]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_table_sinks(spark, tmp_path, fmt):
    p = str(tmp_path / fmt)
    sinks.write_table(spark.range(3), p, fmt)
    r = spark.read.option("header", True).format(fmt).load(p)
    assert r.count() == 3 and r.columns == ["id"]
