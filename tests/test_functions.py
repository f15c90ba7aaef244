import math

import pytest
from pyspark.sql import functions as F

from evalgrid.functions import geometry as G
from evalgrid.functions import text as X
from evalgrid.functions.draws import normal_cdf, normal_quantile
from evalgrid.functions.scores import bits_per_selection, snr_verdict, verdict
from evalgrid.functions.zones import strip_zone, threshold_zone, zone_of


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_zone_edges(spark):
    xs = [-0.1, 0.0, 1 / 3, 0.999, 1.0, 1.2, None, float("nan"), float("inf")]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in d.orderBy("i").select(strip_zone("x", 3)).collect()]
    assert got == [0, 0, 1, 2, 2, 2, -1, -1, -1]
    assert one(spark, zone_of(F.lit(0.9), F.lit(0.1), 2, 2), threshold_zone(F.lit(0.9995), F.lit(0.4))) == (1, 5)
    # dividing by 0.333 and multiplying by 3 part ways next to a boundary
    assert one(spark, threshold_zone(F.lit(0.6662), F.lit(0.1)), zone_of(F.lit(0.6662), F.lit(0.1), 3, 3)) == (2, 1)


@pytest.mark.parametrize("p,n,bits", [(1.0, 2, 1.0), (0.5, 2, 0.0), (1.0, 8, 3.0), (0.1, 8, 0.0)])
def test_bits(spark, p, n, bits):
    assert one(spark, bits_per_selection(F.lit(p), F.lit(n)))[0] == pytest.approx(bits, abs=1e-6)


def test_verdicts(spark):
    pos, neg = F.array(F.lit(1)), F.array(F.lit(2))
    null = F.lit(None).cast("int")
    assert list(one(spark, *[verdict(c, pos, neg) for c in (F.lit(1), F.lit(2), F.lit(3), null)])) == ["correct", "wrong", "unverifiable", "unverifiable"]
    assert list(one(spark, *[snr_verdict(F.lit(x)) for x in (1.0, 2.0, 3.0)])) == ["nothing to recover", "marginal", "workable"]


def test_names(spark):
    r = one(spark, X.canon(F.lit("glass_(drink_container)")), X.canon(F.lit("television_set")), X.norm_item(F.lit("  A  Red-Cup!  2 ")))
    assert list(r) == ["glass", "television set", "a redcup 2"]


def test_singular_forms(spark):
    r = one(spark, *[X.singular_forms(F.lit(w)) for w in ("berries", "knives", "boxes", "s")])
    assert r[0] == ["berry", "berri", "berrie"]
    assert r[1] == ["knif", "knife", "kniv", "knive"]
    assert r[2] == ["box", "box", "boxe"]
    assert r[3] == []


def test_phrases(spark):
    text = "The two white pillows, a lamp and a painting hanging on the wall. There is a wooden coffee table near it, a lamp"
    assert one(spark, X.phrase_items(F.lit(text)))[0] == ["pillows", "lamp", "painting", "wall", "coffee table"]


def test_list_items(spark):
    text = "1. Cup, 2) cup; - Book.\n* " + "x" * 41 + ", TV"
    assert one(spark, X.list_items(F.lit(text)))[0] == ["Cup", "Book", "TV"]
    many = ", ".join(f"item{i}" for i in range(30))
    assert one(spark, X.list_items(F.lit(many)))[0] == [f"item{i}" for i in range(12)]


def test_prompt_template_picks(spark):
    r = one(
        spark, X.strip_prompt(F.lit(" Question: WHAT? a cup "), F.lit("question: what?")), X.want_sentence(F.array(*map(F.lit, "abc"))),
        X.want_sentence(F.array(*map(F.lit, "ab"))), X.want_sentence(F.array(F.lit("a"))), X.ranked_picks(F.lit("3, 99, 3 and 1. 0"), 10),
    )
    assert list(r) == ["a cup", "I want a, b and c.", "I want a and b.", "I want a.", [2, 0]]


def test_tokens(spark):
    a, b = X.word_set(F.lit("Please bring me the RED cup")), X.word_set(F.lit("a red cup is red"))
    r = one(spark, a, X.jaccard(a, b), X.jaccard(X.word_set(F.lit("the")), X.word_set(F.lit("a"))))
    assert sorted(r[0]) == ["bring", "cup", "red"] and r[1] == pytest.approx(2 / 3) and r[2] == 0


def test_normal(spark):
    for z in (-3.0, -1.0, 0.0, 0.5, 2.5):
        p = 0.5 * math.erfc(-z / math.sqrt(2))
        assert one(spark, normal_cdf(F.lit(z)))[0] == pytest.approx(p, abs=2e-7)
        assert one(spark, normal_quantile(F.lit(p)))[0] == pytest.approx(z, abs=1e-6)


def test_eye_geometry(spark):
    def pt(x, y):
        return F.lit(float(x)), F.lit(float(y))

    right = G.eye_geometry(pt(0, 0), pt(10, 0), pt(5, -2), pt(5, 2), pt(4, 1))
    left = G.eye_geometry(pt(30, 0), pt(20, 0), pt(25, -2), pt(25, 2), pt(26, 1))
    shut = G.eye_geometry(pt(0, 0), pt(10, 0), pt(5, 0), pt(5, 0.1), pt(4, 1))
    r, lf = (one(spark, *[e[k] for k in ("h", "v", "vlid", "open")]) for e in (right, left))
    assert list(r) == pytest.approx([0.4, 0.1, 0.75, 0.4])
    assert list(lf) == pytest.approx([0.4, 0.1, 0.75, 0.4])  # mirrored eye, same sign below the corner line
    assert one(spark, shut["vlid"])[0] is None


def test_head_angles_and_centre(spark):
    yaw, pitch, roll = 0.3, -0.2, 0.1
    cy, sy, cp, sp, cr, sr = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch), math.cos(roll), math.sin(roll)
    m = [[cr * cy, cr * sy * sp - sr * cp, cr * sy * cp + sr * sp], [sr * cy, sr * sy * sp + cr * cp, sr * sy * cp - cr * sp], [-sy, cy * sp, cy * cp]]
    a = G.head_angles([[F.lit(v) for v in row] for row in m])
    assert list(one(spark, a["yaw"], a["pitch"], a["roll"])) == pytest.approx([math.degrees(v) for v in (yaw, pitch, roll)])
    assert one(spark, G.centred(F.array(F.lit(0.4), F.lit(0.6)), F.lit(0.45)))[0] == pytest.approx(0.55)


@pytest.mark.parametrize("text, want", [
    ("a lamp éand chair", ["lamp  and chair"]),  # no word of its own, so no split
    ("caféin table on wall", ["caf in table", "wall"]),
    ("niño eating cake", ["ni o", "cake"]),
    ("über under bed", ["ber", "bed"]),
])
def test_phrases_beside_accented_letters(spark, text, want):
    assert one(spark, X.phrase_items(F.lit(text)))[0] == want
