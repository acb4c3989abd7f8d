"""Near duplicates of the pipeline against the Jaccard of all pairs."""

import random

import pytest

import corpus_pipeline
from sievework.llm import shingles


def plain(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(x, y):
    return 1.0 if x == y else len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def rows():
    """Texts of short words, changed in ever more places so that their likenesses lie around 0.7, 0.8 and 0.9."""
    rng = random.Random(9)
    some = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(n)]
    passage, out = some(30), []
    for k in range(16):
        base = some(rng.randrange(60, 200)) + passage
        out.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 6, 8, 10):
            t = list(base)
            for at in rng.sample(range(len(t)), changes):
                t[at] = "x" + str(rng.randrange(1000))
            out.append(" ".join(t))
    out += [out[0], out[5].upper(), "", None, "  ", "one two", "one two", "one two three"]
    rng.shuffle(out)
    return [(None if i % 23 == 5 else i, t) for i, t in enumerate(out)]


def rows_by_group(rows, least):
    """The rows of each group: for each row its number, so that rows of one doc_id are told apart."""
    sets, up = [plain(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least - 1e-12:
                up[root(i)] = root(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(root(i), []).append(r)
    return out


@pytest.mark.parametrize(("least", "bucket_rows"), [((7, 10), 4096), ((4, 5), 4096), ((4, 5), 3), ((9, 10), 4096)])
def test_groups_are_those_of_the_exact_jaccard(spark, rows, least, bucket_rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = shingles.near_duplicates(df.selectExpr("doc_id", "text"), least, bucket_rows).collect()
    named = [r for r in found if r["doc_id"] is not None]
    groups = rows_by_group(rows, least[0] / least[1]).values()
    of = {d: i for i, g in enumerate(groups) for d, _ in g if d is not None}
    got = {}
    for r in named:
        got.setdefault(r["component"], set()).add(of[r["doc_id"]])
    assert len(found) == len(rows)
    assert all(len(x) == 1 for x in got.values())  # nothing is linked that is not near
    assert len(got) <= 1.05 * len(set(of.values()))  # and hardly a link is lost


def survivors(rows):
    """One row of each group: the smallest doc_id, null last."""
    return sorted(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] or -1 for g in rows_by_group(rows, 0.8).values())


def test_stage_keeps_the_smallest_of_each_group(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    ids = [r["doc_id"] or -1 for r in got]
    assert set(survivors(rows)) <= set(ids) and len(ids) <= 1.05 * len(survivors(rows))
    texts = dict(rows)
    assert all(r["doc_id"] is None or texts[r["doc_id"]] == r["text"] for r in got)


def test_stage_drops_rows_and_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 7, "p"), (5, a, 7, "q"), (5, b, 7, None), (7, c, None, "r"), (7, b + " b40", 7, "s"), (9, b, 1, "t"), (9, b, 1, "t"), (None, c, 2, "u"), (None, "x", 2, "v"), (None, "x", 2, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, of_text long, component string")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in got.collect()) == [("1", "a"), ("5", "b"), ("7", "c"), ("None", "x")]
    two = df.where("doc_id = 9")
    assert [tuple(r) for r in corpus_pipeline.near_duplicates(spark, two, "").collect()] == [(9, b, 1, "t")]


def test_many_equal_prints_end(spark):
    """5,000 texts with the same fingerprints that differ otherwise: a bucket is cut into blocks and ends."""
    import numpy as np

    rng = np.random.default_rng(1)
    bits = [(rng.random(1024) < 0.1).astype(np.uint8) for _ in range(3000)]
    rows = [(11, 0, i % 2, i, i, 5, 300, bytearray(np.packbits(b).tobytes())) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "key long, start int, block int, node long, comp long, print long, size int, sketch binary")
    assert shingles._pairs(df, (4, 5), 1).count() < len(rows)


def test_recall_of_the_candidates():
    """Sets at a similarity of 0.8 share one of the six fingerprints at 0.986."""
    import numpy as np

    rng = np.random.default_rng(3)
    met, n = 0, 400
    for _ in range(n):
        both, x, y = (rng.integers(0, 2**64, k, np.uint64) for k in (160, 20, 20))
        a, b = (shingles.prints(np.unique(np.concatenate([both, z])), shingles.prints_for((4, 5))) for z in (x, y))
        met += bool((np.bitwise_count(a ^ b) <= shingles.DISTANCE).any())
    assert met / n > 0.96


def test_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shingles.near_duplicates(none).count() == 0
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0


def test_a_large_group_meets_only_the_other_rows_of_its_bucket(spark):
    """100 rows of a bucket, 90 of one group, in blocks of about 20: no two of the group are left to meet, all others are."""
    hot = spark.createDataFrame([(7, 0, i, 5, 100) for i in range(100)], "key long, start int, node long, print long, n long")
    members = spark.createDataFrame([(i, 0) for i in range(90)], "node long, component long")
    rows = shingles._in_blocks(hot, members, 20).toPandas()
    met = set()
    for _, g in rows.groupby("key"):
        one = g["block"].nunique() == 1
        met |= {(min(a, b), max(a, b)) for a, x in zip(g["node"], g["block"]) for b, y in zip(g["node"], g["block"]) if a != b and (one or x != y)}
    assert met == {(a, b) for b in range(90, 100) for a in range(b)}
    assert len(rows) <= 90 + 10 * 7  # 90 rows in some five blocks, 10 in one
    whole = spark.createDataFrame([(i, 0) for i in range(100)], "node long, component long")
    assert shingles._in_blocks(hot, whole, 20).count() == 0


def test_leaders_are_in_each_part_of_a_large_bucket(spark):
    hot = spark.createDataFrame([(7, 0, i, 5, 100) for i in range(100)], "key long, start int, node long, print long, n long")
    rows = shingles._with_leaders(hot, 20).toPandas()
    assert sorted(rows[rows["block"] == 0]["node"]) == list(range(100))
    leaders = {k: set(g[g["block"] < 0]["node"]) for k, g in rows.groupby("key")}
    assert len(leaders) == 5 and len(set(map(frozenset, leaders.values()))) == 1 and 1 <= len(leaders[rows["key"][0]]) <= shingles.LEADERS
