"""Operators and queries that SQL can't express, or whose SQL shares their idea, against plain versions."""

import math
import random
import zlib
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import sequences as q
from sievework.operators import design as D
from sievework.operators import metrics as M
from sievework.operators import models, prefix
from sievework.operators import screen as S
from sievework.plans import catalog, tables
from sievework.sources import files

D_SMALL = "/root/testdata/sf0.001"
PAIR = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(PAIR)[::-1]


def plain_guides(seq, flank=0):
    for i in range(len(seq) - 22):
        w = seq[i : i + 23]
        strand = "+" if w.endswith("GG") else "-" if w.startswith("CC") else None
        if strand:
            yield (i + 1, strand, w if strand == "+" else rc(w), seq[max(0, i - flank) : i], seq[i + 23 : i + 23 + flank])


@pytest.mark.parametrize("step", [40, 4096])
def test_guides_of_pieces_are_those_of_whole_contigs(spark, monkeypatch, step):
    rng = random.Random(1)
    seqs = {i: "".join(rng.choice("ACGGC") for _ in range(n)) for i, n in enumerate([0, 22, 23, 39, 40, 41, 83, 500, 9000])}
    df = spark.createDataFrame([*seqs.items(), (99, None)], "contig int, seq string")
    monkeypatch.setattr(D, "SITE_PIECE", step)
    got = {(r["contig"], r["start"], r["strand"], r["target"], r["before"], r["after"]) for r in D.enumerate_guides(df, flank=12).collect()}
    assert got == {(c, *g) for c, s in seqs.items() for g in plain_guides(s, 12)}


def test_time_goes_with_the_contig(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(1, "".join(rng.choices("ACGT", k=400_000)))], "contig int, seq string")
    assert D.enumerate_guides(df).count() > 40_000


def test_near_sequences_with_a_seed(spark):
    rng = random.Random(3)
    seqs = sorted({"".join(rng.choice("AC") for _ in range(20)) for _ in range(120)})
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    found = D.near_sequences(df, df, 3, 20, (8, 1)).select(q.decoded(F.col("a"), 20), q.decoded(F.col("b"), 20), "mismatches")
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert {tuple(r) for r in found.collect()} == {(a, b, far(a, b)) for a in seqs for b in seqs if far(a, b) <= 3 and far(a[-8:], b[-8:]) <= 1}


def genome_with_copies():
    rng = random.Random(8)
    unit = ["".join(rng.choices("ACGT", k=23 + 12)) for _ in range(4)]
    parts = [rng.choice(unit)[:21] + "GG" + rng.choice(("", "CC", "CCTT")) for _ in range(60)]
    parts += [u[:5] + rng.choice("ACGT") + u[6:20] + "AGG" for u in unit for _ in range(6)]
    rng.shuffle(parts)
    return {1: "".join(parts[:40]), 2: "".join(rng.choices("ACGT", k=900)), 3: "".join(parts[40:]), 4: "ACGT", 5: ""}


@pytest.mark.parametrize("cap", [3, 300])
def test_off_targets_of_both_strands(spark, cap):
    contigs = genome_with_copies()
    genome = D.site_table(spark.createDataFrame(list(contigs.items()), "contig int, seq string")).cache()
    sites = [(c, i + 1, s, w[:20]) for c, t in contigs.items() for i in range(len(t) - 22) for s, w in (("+", t[i : i + 23]), ("-", rc(t[i : i + 23]))) if w.endswith("GG")]
    first = {(c, i, s) for c, i, s, _ in sites if s == "+" or (c, i, "+") not in {x[:3] for x in sites}}
    assert {tuple(r) for r in genome.collect()} == {(*x, x[:3] in first) for x in sites}
    assert len(first) < len(sites)  # some places have both
    guides = genome.where("first").select(F.concat_ws(":", "contig", "start").alias("guide"), "contig", "start", "strand", "seq")
    pairs = D.near_sequences(guides, genome)
    want, counts = set(), set()
    for c, i, s, w in sites:
        if (c, i, s) in first:
            hits = sorted((m, x[3], *x[:3]) for x in sites if x[:3] != (c, i, s) and (m := sum(a != b for a, b in zip(w, x[3]))) <= 3)
            want |= {(f"{c}:{i}", h[2], h[3], h[4], h[0], h[1]) for h in hits[:cap]}
            counts.add((f"{c}:{i}", *(sum(h[0] == m for h in hits) for m in range(4)), len(hits) > cap))
    assert {tuple(r) for r in D.off_targets(guides, genome, pairs, cap).collect()} == want
    assert {tuple(r) for r in D.hit_counts(guides, pairs, cap).collect()} == counts and any(c[1:5] == (0, 0, 0, 0) for c in counts)


def places(rng, n, span):
    return [(c, p, rng.randrange(9) / 2) for c in range(3) for p in sorted(rng.sample(range(span), n))]


@pytest.mark.parametrize("stretch", [37, 65_536])
def test_greedy_choices_by_islands_are_those_of_whole_contigs(spark, monkeypatch, stretch):
    monkeypatch.setattr(D.islands, "__defaults__", (stretch,))
    rng = random.Random(6)
    for n, span in ((60, 900), (60, 9000)):
        rows = places(rng, n, span)
        df = spark.createDataFrame(rows, "contig int, start int, score double").repartition(3)
        chosen, walked = set(), set()
        for c in range(3):
            own, free, taken = [r for r in rows if r[0] == c], -1, []
            for _, p, s in sorted(own, key=lambda r: (r[2], r[1])):
                if all(abs(p - x) > 40 for x in taken):
                    taken.append(p)
            chosen |= {(c, p) for p in taken}
            for _, p, _ in own:
                if p >= free:
                    walked.add((c, p))
                    free = p + 23
        assert {(r[0], r[1]) for r in D.spaced(df, "contig", "start", "score", 40).collect()} == chosen
        assert {(r[0], r[1]) for r in D.without_overlap(df, "contig", "start", 23).collect()} == walked


@pytest.mark.parametrize("stretch", [29, 65_536])
def test_clusters_are_carried_from_stretch_to_stretch(spark, stretch):
    rng = random.Random(7)
    rows = [(c, p, p + rng.randrange(1, 60)) for c in range(3) for p in sorted(rng.sample(range(1500), 70))]
    want = set()
    for c in range(3):
        run, place, end = 0, 0, None
        for _, a, b in sorted(r for r in rows if r[0] == c):
            run, place = (run, place + 1) if end is not None and a <= end else (run + 1, 0)
            want.add((c, a, b, f"{run}.{place // 2}"))
            end = b
    df = spark.createDataFrame(rows, "contig int, a int, b int").repartition(3)
    assert {tuple(r) for r in D.clusters(df, "contig", "a", "b", stretch).collect()} == want


def test_ranks_without_a_sort_of_the_group(spark):
    rng = random.Random(10)
    rows = [(g, float(rng.randrange(20)), i) for g in range(3) for i in range(200)]
    want = {(g, s, i, k + 1) for g in range(3) for k, (s, i) in enumerate(sorted((s, i) for h, s, i in rows if h == g))}
    assert {tuple(r) for r in D.ranked(spark.createDataFrame(rows, "g int, s double, i int"), "g", "s", "i").collect()} == want


def test_amplicons(spark):
    rng = random.Random(11)
    guides = [("g", f"x{i:02}", 7 * i, rng.randrange(4) / 2) for i in range(40)]
    primers = [(g[1], rng.choice("fg"), rng.choice("rs"), rng.randrange(2), p) for g in guides for p in range(2)]
    got = D.amplicons(spark.createDataFrame(guides, "gene string, guide string, position int, score double"), spark.createDataFrame(primers, "guide string, forward string, reverse string, off_targets int, place int"), ["b1", "b2"], 20)
    taken, used, want = [], {}, set()
    for _, g, p, s in sorted(guides, key=lambda r: (r[3], r[2])):
        if all(abs(p - x) > 20 for _, x in taken):
            taken.append((g, p))
    for g, _ in sorted(taken):
        clean = sorted((p, f, r) for x, f, r, n, p in primers if x == g and n == 0)
        if clean:
            pair = clean[0][1:]
            k = used[pair] = used.get(pair, -1) + 1
            want.add(("g", g, *pair, ["b1", "b2"][k] if k < 2 else None))
    assert {tuple(r) for r in got.collect()} == want


def test_one_target_is_read_from_its_own_folder(spark, tmp_path):
    rows = [(t, k, f"g{t}.{k}", "ACGT", "1:5", "+", k) for t in (3, 40, 7) for k in (1, 2)]
    df = spark.createDataFrame(rows, "target long, rank int, guide string, hit string, locus string, hit_strand string, mismatches int")
    files.write_hits(df, f"file://{tmp_path}/hits")
    one = files.read_target_hits(spark, f"file://{tmp_path}/hits", 40)
    assert {r["guide"] for r in one.collect()} == {"g40.1", "g40.2"}
    assert "PartitionFilters: [isnotnull(target" in one._jdf.queryExecution().toString() and {r[0].split("target=")[1][:2] for r in one.select(F.input_file_name()).collect()} == {"40"}
    assert files.read_target_hits(spark, f"file://{tmp_path}/hits").count() == 6


def test_many_targets_share_few_folders(spark, tmp_path):
    """A folder for each target took most of the time where there are many."""
    rows = [(t, k, f"g{t}.{k}", "ACGT", "1:5", "+", k) for t in range(40) for k in (1, 2)]
    df = spark.createDataFrame(rows, "target long, rank int, guide string, hit string, locus string, hit_strand string, mismatches int")
    files.write_hits(df, f"file://{tmp_path}/hits", 5)
    assert len([p for p in (tmp_path / "hits").iterdir() if p.is_dir()]) <= 5
    columns = sorted(df.columns)
    read = lambda **x: sorted(tuple(r) for r in files.read_target_hits(spark, f"file://{tmp_path}/hits", folders=5, **x).select(*columns).collect())
    assert read() == sorted(tuple(r) for r in df.select(*columns).collect()) and {r[0] for r in read(target=7)} == {"g7.1", "g7.2"}
    one = files.read_target_hits(spark, f"file://{tmp_path}/hits", 7, 5).select(F.input_file_name()).distinct().collect()
    assert len(one) == 1 and "PartitionFilters: [isnotnull(folder" in files.read_target_hits(spark, f"file://{tmp_path}/hits", 7, 5)._jdf.queryExecution().toString()


def plain_logistic(x, y, w, penalty):
    b = np.zeros(x.shape[1] + 1)
    x = np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x.T * (w * p * (1 - p))) @ x / w.sum() + np.diag([0.0] + [penalty] * (len(b) - 1)), x.T @ (w * (p - y)) / w.sum() + penalty * np.r_[0.0, b[1:]])
    return b


def test_cross_validated_consensus_equals_a_plain_fit(spark):
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=400), rng.normal(size=400)
    e = 60 + 20 * a - 8 * b + rng.normal(size=400) * 12
    rows = [(f"G{i // 4}", float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, e))] + [("G1", None, 1.0, 2.0), ("G2", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "gene string, a double, b double, efficacy double").repartition(3)
    model, held, thresholds = models.cross_validated(df, ["a", "b"], "efficacy", 70)
    x = np.column_stack([(v - v.mean()) / v.std(ddof=1) for v in (a, b)])
    y = (e >= 70).astype(float)
    w = np.where(y == 1, 1.0, y.sum() / (len(y) - y.sum()))
    want = plain_logistic(x, y, w, 0.01)
    assert np.allclose([model["intercept"], model["betas"]["a"], model["betas"]["b"]], want, atol=1e-6)
    alone = models.fit_logistic(df, ["a", "b"], "efficacy", 70)
    assert np.allclose([alone["intercept"], alone["betas"]["a"], alone["betas"]["b"]], want, atol=1e-3)
    fold = {r["gene"]: r["fold"] for r in models.folds(df).select("gene", "fold").distinct().collect()}
    own = np.array([fold[f"G{i // 4}"] for i in range(400)])
    found = {(r["a"], r["b"]): r["probability"] for r in held.collect()}
    best = []
    for f in range(5):
        m = plain_logistic(x[own != f], y[own != f], w[own != f], 0.01)
        p = 1 / (1 + np.exp(-(m[0] + x[own == f] @ m[1:])))
        assert np.allclose([found[float(i), float(j)] for i, j in zip(a[own == f], b[own == f])], p, atol=1e-6)
        youden = lambda t, p=p, f=f: round(((p >= t) & (y[own == f] == 1)).sum() / (y[own == f] == 1).sum() - ((p >= t) & (y[own == f] == 0)).sum() / (y[own == f] == 0).sum(), 12)
        best.append(max((t / 100 for t in range(1, 100)), key=lambda t: (youden(t), t)))
    assert {r["fold"]: r["threshold"] for r in thresholds.collect()} == dict(enumerate(best)) and model["threshold"] == pytest.approx(np.mean(best))
    with pytest.raises(ValueError, match="classes"):
        models.cross_validated(df, ["a"], "efficacy", 1e9)


def test_normal_tail():
    z = np.array([0.0, -1.0, 1.0, -1.96, 3.0, -3.0, -6.0, 8.0, -40.0])
    assert np.allclose(S.normal_tail(z), [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rtol=1e-12, atol=0) and np.isnan(S.normal_tail(np.array([np.nan])))[0]


def test_depletion_against_a_plain_version(spark):
    rng = np.random.default_rng(13)
    rows = [(f"g{i}", s, int(v)) for i in range(60) for s, v in zip(("c1", "c2", "t1"), rng.poisson(40 + i, 3) * (1, 1, 0.2 if i < 15 else 1))]
    long = spark.createDataFrame([("e", *r) for r in rows], "experiment string, guide_id string, sample string, count long")
    got = {r["guide_id"]: r for r in S.depletion(long, ["c1", "c2"], ["t1"]).collect()}
    x = np.array([[v for g, _, v in rows if g == f"g{i}"] for i in range(60)], float)
    whole = (x > 0).all(1)
    x = x / np.median(x[whole] / np.exp(np.log(x[whole]).mean(1))[:, None], axis=0)
    mc, mt, v = x[:, :2].mean(1), x[:, 2], x[:, :2].var(axis=1, ddof=1)
    over = (v > mc) & (mc > 0)
    slope, cut = np.polyfit(np.log(mc[over]), np.log(v[over] - mc[over]), 1)
    z = (mt - mc) / np.sqrt(mc + np.exp(cut) * mc**slope)
    p = np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in z])
    order = np.argsort(-p)
    fdr = np.empty(60)
    fdr[order] = np.minimum.accumulate(np.minimum(1, p[order] * 60 / (60 - np.arange(60))))
    for i in range(60):
        r = got[f"g{i}"]
        assert (r["lfc"], r["p"], r["fdr"]) == pytest.approx((np.log2((mt[i] + 1) / (mc[i] + 1)), p[i], fdr[i]), rel=1e-6)


RUNS = [([[0.3, -0.2], [1.5, 0.8]], [-0.4, 0.1]), ([[2.0], [-1.0]], [0.5])]
LENGTHS = [([[1.2]], [-3.0])]
RATE = {"intercept": -1.0, "precision": 0.5, "log_total": 0.2, "5A": 0.4, "3G": -0.3}
BASES = {b: {"A": 0.5, b: 0.5} if b != "A" else {"A": 1.0} for b in "ACGT"}


def plain_outcomes(seq, cut):
    """(category, length, position, mh_len, inserted): weight, by loops."""
    score = lambda layers, x: float(S.forward(layers, np.array([x], float))[0])
    out = {}
    for n in range(1, min(59, cut, len(seq) - cut) + 1):
        left, right = seq[cut - n : cut], seq[cut : cut + n]
        alone = math.exp(score(LENGTHS, [n]) - 0.25 * n)
        i = 0
        while i < n:
            j = i
            while j < n and left[j] == right[j]:
                j += 1
            if j > i:
                gc = sum(c in "GC" for c in left[i:j]) / (j - i)
                out["del", n, j, j - i, None] = math.exp(score(RUNS, [j - i, gc]) - 0.25 * n) + (alone if j - i == n else 0)
            i = max(j, i + 1)
        if left != right:
            out["del", n, None, 0, None] = alone
    total = sum(out.values())
    out = {k: v / total for k, v in out.items()}
    short = np.array([sum(v for k, v in out.items() if k[1] == n) for n in range(1, 29)])
    short = short[short > 0] / short.sum()
    precision = 1 + (short * np.log(short)).sum() / math.log(28)
    odds = math.exp(-1.0 + 0.5 * precision + 0.2 * math.log(total) + (0.4 if seq[cut - 1] == "A" else 0) - (0.3 if seq[cut] == "G" else 0))
    out |= {("ins", 1, None, 0, b): odds * p for b, p in BASES[seq[cut - 1]].items()}
    return {k: v / sum(out.values()) for k, v in out.items()}


def test_repair_outcomes_and_genotypes(spark):
    rng = random.Random(14)
    seqs = {f"s{i}": "".join(rng.choices("ACGT" if i % 2 else "AC", k=120)) for i in range(6)} | {"rep": "ACACAC" * 20, "short": "ACGTACGT"}
    df = spark.createDataFrame([(g, s, len(s) // 2) for g, s in seqs.items()], "guide string, seq string, cut int").repartition(2)
    found = S.with_insertions(S.deletion_outcomes(df, RUNS, LENGTHS), RATE, BASES)
    got, parts = {}, {}
    for r in found.collect():
        got.setdefault(r["guide"], {})[r["category"], r["length"], r["position"], r["mh_len"], r["inserted"]] = r["freq"]
    for r in S.outcome_genotypes(found).collect():
        parts.setdefault(r["guide"], []).append(r)
    for g, s in seqs.items():
        want, cut = plain_outcomes(s, len(s) // 2), len(s) // 2
        assert got[g].keys() == want.keys() and all(got[g][k] == pytest.approx(v, rel=1e-9) for k, v in want.items())
        assert sum(r["freq"] for r in parts[g]) == pytest.approx(1)
        split = {}
        for r in parts[g]:
            n, p = r["length"], r["position"]
            if r["category"] == "ins":
                assert r["genotype"] == s[:cut] + r["name"][3:] + s[cut:]
            elif p is None:
                assert r["name"] == f"del{n}" and r["genotype"] is None
                split.setdefault(n, []).append((None, r["freq"]))
            else:
                assert r["genotype"] == s[: cut - n + p] + s[cut + p :] and r["name"] == "del" + s[cut - n + p : cut + p]
                if not r["mh_len"]:
                    split.setdefault(n, []).append((p, r["freq"]))
        for (kind, n, p, m, _), f in want.items():
            if kind == "del" and p is None:
                differ = [a != b for a, b in zip(s[cut - n : cut], s[cut : cut + n])]
                ends, middle = [k for k, d in ((0, differ[0]), (n, differ[-1])) if d], [i for i in range(1, n) if differ[i - 1] and differ[i]]
                kinds = len(ends) + bool(middle)
                plain = {k: f / kinds for k in ends} | {k: f / kinds / len(middle) for k in middle} if kinds else {None: f}
                assert dict(split[n]) == pytest.approx(plain)


def test_feature_vectors(spark):
    rng = random.Random(15)
    seqs = {f"s{i}": "".join(rng.choices("ACGT", k=24)) + "AGG" + "".join(rng.choices("ACGT", k=3)) for i in range(30)}
    vectors = S.feature_vectors(spark.createDataFrame(list(seqs.items()), "guide string, seq string")).cache()
    names, dense = S.feature_names(), {}
    for r in vectors.collect():
        assert len(set(r["places"])) == len(r["places"])
        dense[r["guide"]] = dict(zip((names[p] for p in r["places"]), r["values"]))
    for g, s in seqs.items():
        sp, want = s[4:24], {}
        for k in (1, 2):
            for i in range(21 - k):
                want[f"{sp[i : i + k]}_{i}"] = 1.0
                want[sp[i : i + k]] = want.get(sp[i : i + k], 0) + 1.0
        gc = sum(c in "GC" for c in sp)
        want |= {f"nggx_{s[24]}{s[27]}": 1.0} | ({"gc": gc} if gc else {}) | ({"gc_high": 1.0} if gc > 10 else {}) | ({"gc_low": 1.0} if gc < 10 else {})
        rest = {n: v for n, v in dense[g].items() if not n.startswith("tm") and n != "weight"}
        assert rest == want and {"tm", "tm_near", "tm_middle", "tm_far", "weight"} <= set(dense[g])
    x = np.array([[dense[g].get(n, 0.0) for n in names] for g in sorted(dense)])
    mean, std = S.feature_statistics(vectors)
    assert np.allclose(mean, x.mean(0)) and np.allclose(std, x.std(0, ddof=1))
    z = np.array([r["z"] for r in S.z_scored(vectors, mean, std).orderBy("guide").collect()])
    still = x.std(0, ddof=1) < 1e-9
    assert np.allclose(z[:, ~still], (x - x.mean(0))[:, ~still] / x.std(0, ddof=1)[~still]) and (z[:, still] == 0).all()
    with pytest.raises(ValueError, match="null values of tm"):
        S.feature_statistics(S.feature_vectors(spark.createDataFrame([("n", "N" * 30)], "guide string, seq string")))


def test_sums_of_z_scores_are_those_of_the_dense_vectors(spark):
    """Dense vectors were looked up feature by feature, and a guide's sums joined to them by a shuffle."""
    rng = random.Random(16)
    rows = [(f"s{i}", "".join(rng.choices("ACGT", k=25)) + "GG" + "".join(rng.choices("ACGT", k=3))) for i in range(50)]
    vectors = S.feature_vectors(spark.createDataFrame(rows, "guide string, seq string").repartition(3))
    mean, std = S.feature_statistics(vectors)
    z = {r["guide"]: np.array(r["z"]) for r in S.z_scored(vectors, mean, std).collect()}
    found = S.z_sums(vectors, mean, std)
    for r in found.collect():
        assert (r["z_sum"], r["z_squares"]) == pytest.approx((z[r["guide"]].sum(), (z[r["guide"]] ** 2).sum()), abs=1e-6)
    filled = {r["guide"]: sum(std[p] > 1e-9 for p in r["places"]) for r in vectors.collect()}
    assert {r["guide"]: r["filled"] for r in found.collect()} == filled and len(filled) == 50
    assert "Exchange hashpartitioning" not in plan_of(found).replace("REPARTITION", "") and "Join" not in plan_of(found)


def test_control_guides_have_no_near_site(spark):
    got = [r[0] for r in catalog.QUERIES["d19_control_guides"](spark, D_SMALL).select("seq").collect()]
    sites = {r["seq"] for r in D.site_table(catalog.design.t.dna(spark, D_SMALL)).collect()}
    codes = np.array([np.frombuffer(s.encode(), np.uint8) for s in sites])
    assert len(set(got)) == len(got) == 100
    assert all((codes != np.frombuffer(s.encode(), np.uint8)).sum(1).min() > 3 for s in got)
    assert not any(m in x for s in got for x in (s, rc(s)) for _, m in catalog.design.ENZYMES)


def test_student_t():
    assert np.allclose(M.t_tail(np.array([2.0, 0.0, 1.0, 2.0]), np.array([10.0, 5.0, 1.0, 58000.0])), [0.0733880, 1.0, 0.5, 0.0455049], atol=1e-6)


def test_p_of_spearman(spark):
    df = spark.createDataFrame([(0.5, 12), (1.0, 9), (0.2, 2), (None, 9)], "spearman double, n long")
    got = [r["p"] for r in M.spearman_p(df).collect()]
    assert got[0] == pytest.approx(0.0978, abs=1e-3) and got[1:] == [0.0, None, None]


def test_kendall_within_groups(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(6)), float(rng.randrange(5))) for k in range(8) for _ in range(rng.randrange(3, 14))] + [(1, None, 2.0)]
    got = {r["k"]: r["tau_b"] for r in M.kendall_within(spark.createDataFrame(rows, "k int, score double, efficacy double"), ("k",)).collect()}
    for k in range(8):
        some = [(x, y) for g, x, y in rows if g == k and x is not None]
        pairs = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for i, a in enumerate(some) for b in some[:i]]
        s, tx, ty = sum(p * q for p, q in pairs), sum(p != 0 for p, _ in pairs), sum(q != 0 for _, q in pairs)
        assert got[k] == pytest.approx(s / (tx * ty) ** 0.5) if tx * ty else got[k] is None


@pytest.mark.parametrize("piece", [64, 4096])
def test_reanchored_guides_are_the_nearest_of_whole_contigs(spark, monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    rng, reach = random.Random(9), 40
    contigs = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((500, 64, 30, 0))}
    guides, want = [], set()
    for k in range(120):
        c = rng.randrange(3)
        at = rng.randrange(max(1, len(contigs[c]) - 8))
        seq = contigs[c][at : at + 8]
        noted, strand = max(1, at + 1 + rng.randrange(-60, 60)), rng.choice("+-")
        seq = rc(seq) if rng.random() < 0.5 else seq
        guides.append((k, c, noted, strand, seq))
        low = max(0, noted - 1 - reach)
        bases = contigs[c][low : noted + reach] if noted <= len(contigs[c]) else ""
        first, other = (seq, rc(seq)) if strand == "+" else (rc(seq), seq)
        place, flipped = (bases.find(first), False) if first in bases else (bases.find(other), True)
        if bases and place >= 0:
            want.add((k, c, low + place + 1, flipped))
    got = D.reanchored(spark.createDataFrame(guides, "guide int, contig int, at int, strand string, seq string"), spark.createDataFrame(list(contigs.items()), "contig int, seq string"), reach)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_transcript_coordinates(spark):
    exons = spark.createDataFrame([("g", "a", "+", 100, 150), ("g", "a", "+", 200, 260), ("g", "b", "-", 100, 150), ("g", "b", "-", 200, 300), ("h", "c", "+", 200, 300)], "gene string, tx string, strand string, exon_start int, exon_end int")
    targets = spark.createDataFrame([("t", "g", 211, 221), ("u", "g", 141, 161), ("v", "g", 101, 151)], "target string, gene string, start int, end int")
    for width in (7, 1024):
        got = {tuple(r) for r in D.transcript_coordinates(targets, exons, width).collect()}
        assert got == {("t", "a", 60, 70), ("t", "b", 80, 90), ("v", "a", 0, 50), ("v", "b", 100, 150)}
    pairing = spark.createDataFrame([("a", p, float(p)) for p in range(110)], "tx string, place long, p double")
    found = D.isoform_structure(targets, D.transcript_coordinates(targets, exons), pairing).collect()
    assert {tuple(r) for r in found} == {("t", 64.5), ("u", 100.0), ("v", 24.5)}


def test_constitutive_targets_lie_in_every_transcript(spark):
    exons = spark.createDataFrame([("g", "a", "+", 100, 150), ("g", "b", "-", 100, 150), ("g", "b", "-", 200, 260), ("h", "c", "+", 200, 300)], "gene string, tx string, strand string, exon_start int, exon_end int")
    targets = spark.createDataFrame([("t", "g", 111, 121), ("u", "g", 211, 221), ("v", "h", 211, 221), ("w", "h", 500, 510)], "target string, gene string, start int, end int")
    got = {tuple(r) for r in D.constitutive(targets, D.transcript_coordinates(targets, exons), exons).collect()}
    assert got == {("t", True), ("u", False), ("v", True), ("w", False)}


def test_enzymes_that_cut(spark):
    df = spark.createDataFrame([("AGCTTTAGCTGGCC",), ("",), (None,), ("GAATTC",)], "s string")
    assert [r[0] for r in df.select(q.site_list(F.col("s"), catalog.design.ENZYMES)).collect()] == ["AluI:2;HaeIII:1", "", "", "EcoRI:1"]


def test_isoform_hits(spark):
    word = {n: "".join(random.Random(n).choices("ACGT", k=20)) for n in range(3)}
    near = "T" + word[0][1:] if word[0][0] != "T" else "A" + word[0][1:]
    sites = [(1, word[0]), (2, word[0]), (2, word[0]), (3, near), (1, word[1]), (4, word[2]), (4, word[2])]
    isoforms = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3), ("k", 4)], "gene string, tx int")
    guides = spark.createDataFrame([("x", 1, word[0], 50.0), ("y", 1, word[1], 0.0), ("z", 4, word[2], 1.0), ("v", 3, near, 2.0)], "guide string, tx int, seq string, p double")
    places = spark.createDataFrame(sites, "tx int, seq string")
    got = {tuple(r) for r in D.isoform_hits(guides, places, D.near_sequences(guides, places), isoforms, F.col("p")).collect()}
    assert got == {("x", 3, 0, 1, 0, 0, True, 850.0), ("y", 1, 0, 0, 0, 0, False, 0.0), ("z", 2, 0, 0, 0, 0, True, 1.0), ("v", 1, 0, 3, 0, 0, True, 2402.0)}


def test_medians(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(9 + 60 * k))) for k, n in enumerate((1, 2, 7, 500, 501)) for _ in range(n)]
    want = {(k, statistics.median(v for q, v in rows if q == k)) for k in range(5)}
    df = spark.createDataFrame([*rows, (0, None), (9, None)], "k int, v double")
    for few in (False, True):
        assert {tuple(r) for r in prefix.medians(df, ("k",), "v", few).collect()} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_near_sequences_are_not_broadcast(spark, tmp_path):
    """Keys are exploded twenty times after their size is guessed; as a broadcast they went through the driver."""
    spark.createDataFrame([("ACGTACGTACGTACGTACGT", "x", 1, "+")], "seq string, contig string, start int, strand string").write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    near = D.near_sequences(s, s)
    joins = [x for x in plan_of(near).splitlines() if "Join" in x and "piece" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    g = s.withColumn("guide", F.lit("g"))
    assert "BroadcastHashJoin [a#" not in plan_of(D.hit_counts(g, near)) + plan_of(D.off_targets(g, s, near))


def test_guides_at_every_kind_of_place(spark, monkeypatch):
    """PAMs at the first and last place of a contig and of its pieces, overlapping ones, and letters beyond ACGT; no place is
    looked at by itself (that took twice the time)."""
    contigs = ["A" * 20 + "GGG", "CCCC" + "A" * 20, "G" * 60, "C" * 40 + "G" * 40, "A" * 20 + "NGG" + "A" * 20 + "TGG", "A" * 22, "", "CCT" + "A" * 17 + "TGG"]
    monkeypatch.setattr(D, "SITE_PIECE", 30)
    df = spark.createDataFrame(list(enumerate(contigs)), "contig int, seq string")
    found = D.enumerate_guides(df)
    want = {(c, i + 1, "+" if p else "-", s[i : i + 23] if p else rc(s[i : i + 23])) for c, s in enumerate(contigs) for i in range(len(s) - 22)
            for p in [s[i + 21 : i + 23] == "GG" and s[i + 20] in "ACGT"] if p or (s[i : i + 2] == "CC" and s[i + 2] in "ACGT")}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    both = {(r["contig"], r["start"], r["strand"], r["first"]) for r in D.site_table(df).collect()}
    assert {x[:3] for x in both if x[3]} == {x[:3] for x in want} and {(7, 1, "-", False), (7, 1, "+", True)} <= both
    assert "split(" in plan_of(found)


def test_ridge_with_a_large_mean(spark):
    """Sums of products of z-scores with a target far from 0 lost digits that decide how a prediction is rounded."""
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), 1e9 + rng.random()) for _ in range(2000)]
    m = models.fit_ridge(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] - 1e9 for r in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose([m["weights"]["a"], m["weights"]["b"]], want, rtol=1e-6)


def test_choices_take_many_islands_at_once(spark):
    """A group or an island was a call of its own; now batches hold many."""
    rng = random.Random(5)
    rows = [(g, 10**17 + p if g == "b" else p, rng.choice([None, 0.25, 0.5])) for g in ("a", "b", *map(str, range(300))) for p in rng.sample(range(3000), 40)]
    df = spark.createDataFrame(rows, "g string, pos long, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        spaced, walked = D.spaced(df, "g", "pos", "score", 60), D.without_overlap(df, "g", "pos", 23)
        got = {(r["g"], r["pos"]) for r in spaced.collect()}, {(r["g"], r["pos"]) for r in walked.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set(), set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, r[2] or 0, r[1]))
        for _, p, _ in own:
            if all(abs(p - x) > 60 for k, x in want[0] if k == g):
                want[0].add((g, p))
        free = None
        for p in sorted(r[1] for r in own):
            if free is None or p >= free:
                want[1].add((g, p))
                free = p + 23
    assert got == want
    assert "FlatMapGroupsInPandas" not in plan_of(spaced) + plan_of(walked)


def test_isoform_structure_from_stretches(spark):
    """Pairing values by stretches give what values by place give, over the ends of stretches and where there are none."""
    rng = random.Random(8)
    p = {tx: [rng.choice([None, 10.0 * rng.randrange(11)]) for _ in range(n)] for tx, n in (("a", 40), ("b", 16), ("c", 1))}
    targets = spark.createDataFrame([(f"t{i}",) for i in range(12)], "target string")
    placed = spark.createDataFrame([(f"t{i}", tx, a, a + rng.randrange(24)) for i in range(10) for tx in ("a", "b", "c", "d") for a in [rng.randrange(40)]], "target string, tx string, tx_start long, tx_end long")
    rows = spark.createDataFrame([(tx, i, v) for tx, vs in p.items() for i, v in enumerate(vs)], "tx string, place long, p double")
    cut = spark.createDataFrame([(tx, i, vs[i * 16 : i * 16 + 16]) for tx, vs in p.items() for i in range(-(-len(vs) // 16))], "tx string, stretch long, values array<double>")
    want, got = D.isoform_structure(targets, placed, rows), D.isoform_structure_by_stretch(targets, placed, cut, 16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hits_of_copies_are_numbered_once(spark):
    """Copies of a guide share the list of hits; each leaves its own place out, also where that is beyond the cap."""
    places = [(c, 1, "+", "ACGTACGTACGTACGTACGT") for c in range(5)] + [(9, 4, "-", "ACGTACGTACGTACGTACGA")]
    sites = spark.createDataFrame(places, "contig long, start int, strand string, seq string")
    guides = sites.withColumn("guide", F.concat_ws(":", "contig", "start"))
    for cap in (1, 2, 5):
        found = D.off_targets(guides, sites, D.near_sequences(guides, sites), cap)
        order = [sorted((p for p in places if p[:3] != own[:3]), key=lambda p, s=own[3]: (p[3] != s, p[0]))[:cap] for own in places]
        want = {(f"{own[0]}:1" if own[0] < 9 else "9:4", p[0]) for own, hits in zip(places, order) for p in hits}
        got = [(r["guide"], r["hit_contig"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().toString()
    assert "windowspecdefinition(guide" not in plan  # hits of all guides are not sorted
    assert "SortMergeJoin [bases" in plan  # few keys are alike in what is sorted by first


def test_exons_of_a_gene_are_sorted_in_small_tasks(spark, monkeypatch):
    """Partitions follow the lines, and what follows by gene shuffles nothing more: orders, lines and exons once each."""
    monkeypatch.setattr(tables, "EXONS_A_TASK", 100)
    d = "/root/testdata/sf0.001"
    exons = tables.exons(spark, d)
    assert exons.rdd.getNumPartitions() > tables.read(spark, d, "lineitem").count() // 100
    for df in (D.consensus(exons.selectExpr("gene", "tx", "exon_start as start", "exon_end as end")), D.splice_sites(exons)):
        keys = {line.split("hashpartitioning(")[1].split("#")[0] for line in plan_of(df).splitlines() if "hashpartitioning(" in line}
        assert keys == {"o_orderkey", "l_orderkey", "gene"} and plan_of(df).count("REPARTITION_BY_NUM") == plan_of(df).count("hashpartitioning(")


def test_tool_correlations_rank_counts_of_equal_pairs(spark):
    """Ties in both tools, nulls and a tool that never varies; rows are grouped before any of them is shuffled."""
    a, b = [1.0, 1.0, 2.0, 2.0, 3.0, 5.0, None], [2.0, 2.0, 1.0, 4.0, 4.0, 6.0, 7.0]
    df = spark.createDataFrame([(x, y, 1.0) for x, y in zip(a, b)] * 3, "a double, b double, c double")
    found = M.tool_correlations(df, ("a", "b", "c"))
    got = {(r["tool_a"], r["tool_b"]): (r["n"], r["pearson"], r["spearman"]) for r in found.collect()}
    x, y = a[:6] * 3, b[:6] * 3
    rank = lambda v: [sum(w < u for w in v) + (v.count(u) + 1) / 2 for u in v]
    want = (18, statistics.correlation(x, y), statistics.correlation(rank(x), rank(y)))
    assert got["a", "b"] == pytest.approx(want) and got["b", "a"] == pytest.approx(want)
    assert len(got) == 6 and got["a", "c"][0] == 18 and got["c", "b"][0] == 21 and got["a", "c"][2] is None
    assert "corr(_x" not in plan_of(found)  # ranks are joined to counts of pairs, not to rows


def test_genotype_sums_are_those_of_the_rows_of_outcomes(spark):
    """Every outcome was a row with its sequence, shuffled and sorted by guide for sums of weights."""
    rng = random.Random(21)
    seqs = {f"s{i}": "".join(rng.choices("ACGT" if i % 2 else "AC", k=120)) for i in range(5)} | {"rep": "ACACAC" * 20, "one": "GT", "n": "ACNTACGT", "none": "ACGT"}
    df = spark.createDataFrame([(g, s, len(s) // 2 if g != "none" else 0) for g, s in seqs.items()], "guide string, seq string, cut int").repartition(2)
    bases = {"A": {"AC": 0.5, "T": 0.5}, "C": {"G": 1.0}, "G": {"A": 1.0}}  # none after T
    found = S.genotype_sums(df, RUNS, LENGTHS, RATE, bases)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in S.outcome_genotypes(S.with_insertions(S.deletion_outcomes(df, RUNS, LENGTHS), RATE, bases)).collect():
        want.setdefault((r["guide"], r["category"], r["length"]), []).append((r["freq"], zlib.crc32(r["name"].encode()), zlib.crc32((r["genotype"] or "").encode())))
    rows = found.collect()
    assert len(rows) == len(want)
    for r in rows:
        x = want[r["guide"], r["category"], r["length"]]
        assert (r["n"], r["names"], r["genotypes"]) == (len(x), sum(v[1] for v in x), sum(v[2] for v in x))
        assert r["freq"] == pytest.approx(sum(v[0] for v in x), rel=1e-9)


def test_outcome_sums_and_runs_are_made_without_a_shuffle(spark):
    """Outcomes were rows with their sequence that were shuffled by guide, and runs of shared bases were cut out of texts one by one."""
    rng = random.Random(22)
    seqs = {f"s{i}": "".join(rng.choices("ACGT" if i % 2 else "AC", k=120)) for i in range(5)} | {"rep": "ACACAC" * 20, "one": "GT", "n": "ACNTACGT", "none": "ACGT"}
    df = spark.createDataFrame([(g, s, len(s) // 2 if g != "none" else 0) for g, s in seqs.items()], "guide string, seq string, cut int").repartition(2)
    found, want = S.outcome_sums(df, RUNS, LENGTHS, RATE, BASES), {}
    assert "Exchange hashpartitioning" not in plan_of(found)
    for r in S.with_insertions(S.deletion_outcomes(df, RUNS, LENGTHS), RATE, BASES).collect():
        want.setdefault((r["guide"], r["category"], r["length"], r["inserted"]), []).append((r["freq"], (r["position"] or 0) * r["mh_len"]))
    rows = found.collect()
    assert {(r["guide"], r["category"], r["length"], r["inserted"]) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        x = want[r["guide"], r["category"], r["length"], r["inserted"]]
        assert (r["n"], r["homology"]) == (len(x), sum(v[1] for v in x))
        assert (r["freq"], r["highest"]) == pytest.approx((sum(v[0] for v in x), max(v[0] for v in x)), rel=1e-9)
    runs, plain = S.microhomologies(df), set()
    for g, s in seqs.items():
        cut = len(s) // 2 if g != "none" else 0
        for n in range(1, min(59, cut, len(s) - cut) + 1):
            left, right, i = s[cut - n : cut], s[cut : cut + n], 0
            while i < n:
                j = i
                while j < n and left[j] == right[j]:
                    j += 1
                if j > i:
                    plain.add((g, n, i, j - i, round(sum(c in "GC" for c in left[i:j]) / (j - i), 9)))
                i = max(j, i + 1)
    assert sorted((*r[:4], round(r[4], 9)) for r in runs.select("guide", "length", "start", "mh_len", "gc").collect()) == sorted(plain)
    assert "MapInArrow" in plan_of(runs)


def test_keys_of_near_sequences_are_dealt_once(spark, tmp_path):
    """Keys were made and shuffled for their counts, for guides and for sites; a seed that has to agree was asked for only afterwards."""
    rng = random.Random(23)
    seqs = sorted({"".join(rng.choice("AC") for _ in range(20)) for _ in range(150)})
    spark.createDataFrame([(s,) for s in seqs], "seq string").write.parquet(str(tmp_path / "s"))
    s, far = spark.read.parquet(str(tmp_path / "s")), lambda a, b: sum(x != y for x, y in zip(a, b))
    for seed, hot in ((None, 20), ((8, 0), 20), ((8, 0), 10**6)):
        near = D.near_sequences(s.limit(60), s, seed=seed, hot=hot).select(q.decoded(F.col("a"), 20), q.decoded(F.col("b"), 20), "mismatches")
        found, few = {tuple(r) for r in near.collect()}, {r[0] for r in s.limit(60).collect()}
        assert found == {(a, b, far(a, b)) for a in few for b in seqs if far(a, b) <= 3 and (seed is None or a[-8:] == b[-8:])}
        assert "ReusedExchange" in plan_of(near)
    assert "array(4095" not in plan_of(near) and "[65535]" in plan_of(near)  # one key a sequence


def test_places_of_hits_are_not_looked_up_by_a_join(spark):
    """Every site was numbered and joined to the guides by its place; hits were rows with their texts when they were shuffled."""
    places = [(c, 1, "+", "ACGTACGTACGTACGTACGT") for c in range(5)] + [(9, 4, "-", "ACGTACGTACGTACGTACGA")]
    sites = spark.createDataFrame(places, "contig long, start int, strand string, seq string")
    guides = sites.withColumn("guide", F.concat_ws(":", "contig", "start"))
    found = D.off_targets(guides, sites, D.near_sequences(guides, sites), 3)
    assert not [x for x in plan_of(found).splitlines() if "Join" in x and "contig" in x]
    assert found.schema["hit_start"].dataType == sites.schema["start"].dataType and found.where("guide = '9:4'").count() == 3


def test_hits_of_pairs_are_read_once(spark, tmp_path):
    """Hits were made and shuffled for either member, and again for bins of the left one's."""
    rng = random.Random(24)
    hits = [(g, rng.randrange(2), rng.randrange(1, 200), rng.choice("+-")) for g in "abcd" for _ in range(30)]
    spark.createDataFrame(hits, "guide string, hit_contig int, hit_start int, hit_strand string").write.parquet(str(tmp_path / "h"))
    pairs = [(f"{x}|{y}", x, y, rng.choice("+-")) for x, y in ("ab", "bc", "ad", "ae")]
    df = spark.createDataFrame(pairs, "pair string, left string, right string, strand string")
    for low, high, kind in ((20, 40, "nickase"), (0, 15, "talen")):
        found = D.scored_pairs(df, spark.read.parquet(str(tmp_path / "h")), low, high, kind)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
        for r in found.collect():
            met = [x[3] == y[3] for x in hits if x[0] == r["left"] for y in hits if y[0] == r["right"] and x[1] == y[1] and low <= abs(x[2] - y[2]) <= high]
            assert (r["off_same"], r["off_other"]) == (sum(met), len(met) - sum(met))
            cost = D.PAIR_PENALTY[kind]
            assert r["score"] == sum(met) * cost[0] + (len(met) - sum(met)) * cost[1] + (D.PAM_IN_PENALTY if kind == "nickase" and r["strand"] == "+" else 0)


def test_counts_of_hits_take_a_guide_of_several_columns(spark):
    """Lines of the report met their counts by a join on a name, and guides were found once more for it."""
    df = spark.createDataFrame([(1, "x", "ACGTACGTACGTACGTACGT"), (2, "y", "ACGTACGTACGTACGTACGA")], "rank int, target string, seq string")
    found = D.hit_counts(df.select(F.struct("rank", "target").alias("guide"), "seq"), D.near_sequences(df, df), 0).select("guide.*", "mm0", "mm1", "capped")
    assert sorted(map(tuple, found.collect())) == [(1, "x", 0, 1, True), (2, "y", 0, 1, True)]


def test_ranks_of_spearman_are_joined_to_counts(spark):
    """Every row was joined to its two ranks, and shuffled for it."""
    a, b = [1.0, 1.0, 2.0, 2.0, 3.0, 5.0], [2.0, 2.0, 1.0, 4.0, 4.0, 6.0]
    rows = [("t", x, y) for x, y in zip(a, b)] * 3 + [("t", None, 1.0), ("t", 1.0, None), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0)]
    found = M.spearman(spark.createDataFrame(rows, "tool string, score double, efficacy double"))
    got = {r["tool"]: (r["spearman"], r["n"]) for r in found.collect()}
    rank = lambda v: [sum(w < u for w in v) + (v.count(u) + 1) / 2 for u in v]
    assert got["t"] == (pytest.approx(statistics.correlation(rank(a * 3), rank(b * 3))), 18) and got["flat"] == (None, 2)
    assert "corr(" not in plan_of(found) and plan_of(found).count("partial_count(1)") > 0
