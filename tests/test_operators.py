import pytest
from pyspark.sql import functions as F

from sievework.functions import sequences as q
from sievework.operators import columns as C
from sievework.operators import design as D
from sievework.operators import genes as g
from sievework.operators import metrics as M

ROWS = [("a", "g1", 60.0, 1.0), ("b", "g1", 90.0, 1.0), ("c", "g1", 95.0, 3.0), ("d", "g2", 85.0, None), ("e", "g2", None, 2.0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "guide_id string, gene string, efficacy double, score double").withColumn("tool", F.lit("t"))


def test_buckets_at_edges(frame):
    e = F.col("efficacy")
    rows = frame.orderBy("guide_id").select(C.three_classes(e), C.three_bins(e), C.margin_classes(e, 85, 95), C.two_classes(e, 90)).collect()
    assert [tuple(r) for r in rows] == [
        ("Moderate", "Poor", "poor", "other"), ("Good", "Moderate", "ignore", "good"), ("Good", "Good", "ignore", "good"), ("Moderate", "Moderate", "ignore", "other"), (None, None, "ignore", "other"),
    ]


def test_auc_with_ties_and_its_mirror(frame):
    up = M.auc(frame, F.col("efficacy") >= 90).first()["auc"]
    down = M.auc(frame.withColumn("score", -F.col("score")), F.col("efficacy") >= 90).first()["auc"]
    assert up == pytest.approx(0.75) and up + down == pytest.approx(1)


def test_strict_auroc_counts_ties_as_zero(frame):
    r = {x["gene"]: x["auroc"] for x in g.strict_auroc(frame, F.col("efficacy") >= 90).collect()}
    assert r["g1"] == pytest.approx(0.5)


def test_empty_frames(spark, frame):
    none = frame.limit(0)
    assert M.auc(none, F.col("efficacy") >= 90).count() == 0
    assert g.balanced_sample(none.withColumn("bucket", F.lit("good"))).count() == 0
    assert D.enumerate_guides(spark.createDataFrame([(1, "ACGT")], "contig int, seq string")).count() == 0


def test_required_columns_are_named(frame):
    with pytest.raises(ValueError, match="absent"):
        C.require_columns(frame, ["gene", "absent"])


def test_reverse_complement_twice(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), ("GGC",)], "s string")
    assert all(r[0] == r[1] for r in df.select("s", q.reverse_complement(q.reverse_complement(F.col("s")))).collect())


@pytest.mark.parametrize("hot", [2, 1_000_000])
def test_near_sequences_equal_brute_force(spark, hot):
    import random

    random.seed(3)
    seqs = ["".join(random.choice("ACGT") for _ in range(20)) for _ in range(40)]
    seqs += [s[:i] + random.choice("ACGT") + s[i + 1 :] for s in seqs[:20] for i in (2, 11)]
    seqs += seqs[:9] * 3 + ["A" * 20, "A" * 17 + "CCC", "ACGTN" * 4, "ACGT"]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    got = sorted(tuple(r) for r in D.near_sequences(df.limit(70), df, hot=hot).select(q.decoded(F.col("a"), 20), q.decoded(F.col("b"), 20), "mismatches", "n").collect())
    good = [s for s in seqs if len(s) == 20 and "N" not in s]
    want = sorted((a, b, m, good.count(b)) for a in set(good[:70]) for b in set(good) if (m := sum(x != y for x, y in zip(a, b))) <= 3)
    assert got == want
