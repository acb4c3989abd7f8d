"""Queries that once did less than their whole job, against brute force on documents made for that."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sievework.operators import columns as C
from sievework.operators import genes, metrics, screen
from sievework.plans import catalog, design


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Copies of a contig, near copies, and places with a PAM on both strands."""
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("ACGGGTCC") for _ in range(n))
    first = make(160)
    near = first[:60] + rc(first[60])[0] + first[61:]
    texts = [first, first, near, make(450), "CCA" + make(17) + "TGG", "A" * 20 + "TGG", "ACGT"]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, texts


def places(texts):
    """(contig, start, strand, sequence, whether a guide) of each site."""
    for c, s in enumerate(texts):
        for i in range(len(s) - 22):
            w = s[i : i + 23]
            if w.endswith("GG"):
                yield c, i + 1, "+", w[:20], True
            if w.startswith("CC"):
                yield c, i + 1, "-", rc(w)[:20], not w.endswith("GG")


def differences(a, b):
    return sum(x != y for x, y in zip(a, b))


@pytest.mark.parametrize("name, seed", [("j18_near_sites", 0), ("j18_seed_rule", 11)])
def test_near_sites_name_every_place(spark, corpus, name, seed):
    """Only sequences came, with counts: which guides and sites have them could not be told."""
    path, texts = corpus
    rows = catalog.QUERIES[name](spark, path).collect()
    of = {(r["contig"], r["start"], r["strand"]): (r["site"], r["guide"]) for r in rows if r["contig"] is not None}
    pairs = {(r["guide"], r["site"]): r["mismatches"] for r in rows if r["contig"] is None}
    sites = list(places(texts))
    assert of == {x[:3]: (x[3], x[3] if x[4] else None) for x in sites}
    links = lambda a, b: differences(a, b) <= 3 and (not seed or a[-seed:] == b[-seed:])
    want = {(x[:3], y[:3], differences(x[3], y[3])) for x in sites if x[4] for y in sites if links(x[3], y[3])}
    assert {(x, y, pairs[g, s]) for x, (_, g) in of.items() if g for y, (s, _) in of.items() if (g, s) in pairs} == want


def clustered(texts):
    """(contig, start_a, start_b, cluster) of all pairs of guides of opposite strands 11 to 60 bases apart."""
    for c in range(len(texts)):
        g = [x for x in places(texts) if x[0] == c and x[4]]
        run, last, place = 0, None, 0
        for a, b in sorted((x[1], y[1]) for x in g for y in g if 10 < y[1] - x[1] <= 60 and x[2] != y[2]):
            run, place = (run, place + 1) if last is not None and a <= last else (run + 1, 0)
            last = b
            yield c, a, b, f"{run}.{place // 2}"


@pytest.mark.parametrize("name", ["w10_clusters", "d14_best_of_clusters", "t06_reranked"])
def test_clusters_take_pairs_of_all_places(spark, corpus, name):
    """Guides in a quarter of a contig, and those over the ends of its exons, were left out."""
    path, texts = corpus
    want = sorted(clustered(texts))
    assert any((a - 1) // 400 != (b - 1) // 400 or (a - 1) % 400 >= 300 for _, a, b, _ in want)
    found = catalog.QUERIES[name](spark, path)
    if name != "w10_clusters":
        best = {}
        for c, a, b, k in want:
            best[c, k] = min(best.get((c, k), (9**9,)), (b - a, a, b))
        rank = lambda c, x: 1 + sum(y < x for (d, _), y in best.items() if d == c)
        want = sorted((c, k, *x[1:]) if name[0] == "d" else (c, k, rank(c, x)) for (c, k), x in best.items())
    columns = {"w10_clusters": ["contig", "start_a", "start_b", "cluster"], "d14_best_of_clusters": ["contig", "cluster", "start_a", "start_b"], "t06_reranked": ["contig", "cluster", "rank"]}
    assert sorted(tuple(r) for r in found.select(*columns[name]).collect()) == want


def test_sorted_hits_have_no_cap(spark, tmp_path):
    """A guide's hits beyond 300 were left out."""
    rng = random.Random(9)
    text = "".join(rng.choice("ACGGGTCC") for _ in range(90))
    texts = [text] * 320 + [text[:40] + rc(text[40])[0] + text[41:]] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sites, of = list(places(texts)), {}
    for x in sites:
        of.setdefault(x[3], []).append(x)
    want = set()
    for a in {x[3] for x in sites if x[4]}:
        hits = sorted((*x[:3], differences(a, b), x[4]) for b, xs in of.items() if differences(a, b) <= 3 for x in xs)
        want |= {(a, i + 1, *h) for i, h in enumerate(hits)}
    found = catalog.QUERIES["t05_sorted_hits"](spark, str(tmp_path)).select("guide", "place", "hit_contig", "hit_start", "hit_strand", "mismatches", "own")
    assert {tuple(r) for r in found.collect()} == want and max(x[1] for x in want) > 300


def test_one_hot_takes_every_guide_with_its_whole_context(spark, corpus):
    """Guides near an end of their contig were left out, and the context was 7 bases instead of 120."""
    path, texts = corpus
    want = set()
    for c, i, strand, _, own in places(texts):
        if own:
            s = ("N" * 60 + texts[c] + "N" * 60)[i - 1 : i + 142]
            s = s if strand == "+" else rc(s)
            want.add((f"{c}:{i}", sum(x in "AN" for x in s), sum(x in "CN" for x in s)))
    assert {tuple(r) for r in catalog.QUERIES["d25_one_hot"](spark, path).select("guide", "a", "c").collect()} == want


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_rows_of_a_gene_are_shuffled_once(spark, tmp_path):
    """Rows of every tool were shuffled by tool and gene, and again for each rank and join."""
    rng = random.Random(3)
    rows = [(f"{i:03x}", f"g{rng.randrange(30)}", float(rng.randrange(5)), *(rng.choice([None, 0.0, 1.0, 2.5]) if k else rng.random() for k in range(3))) for i in range(200)]
    spark.createDataFrame(rows, "guide_id string, gene string, efficacy double, a double, b double, c double").write.parquet(str(tmp_path / "g"))
    wide = spark.read.parquet(str(tmp_path / "g"))
    ids, tools = ("guide_id", "gene", "efficacy"), ("a", "b", "c")
    long, together = C.to_long(wide, ids, tools), C.to_long(wide, ids, tools, together="gene")
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    assert plain(long) == plain(together.select(long.columns))
    for f in (genes.top_and_bottom, genes.spearman_within, genes.within_gene_ranking, genes.agreement_within, lambda x: metrics.kendall_within(x, ("tool", "gene"))):
        assert plain(f(long)) == plain(f(together))
        assert all("(gene#" in x or "(tool#" in x and "gene#" not in x for x in exchanges(f(together)))
    assert len(exchanges(C.to_wide(long, ["guide_id"], tools))) == 1
    assert plain(C.to_wide(long, ["guide_id"], tools)) == plain(wide.select("guide_id", *tools))


def test_depletion_shuffles_a_guide_once_for_its_counts(spark):
    """Every row was shuffled with its guide's name for the factors, for the means and again for each table of experiments."""
    rng = random.Random(6)
    rows = [(e, f"{e}{i}", x, rng.randrange(1, 60)) for e in "uv" for i in range(60) for x in ("t0", "t1", "t2")]
    long = spark.createDataFrame(rows, "experiment string, guide_id string, sample string, count long")
    found = screen.depletion(long, ["t0", "t1"], ["t2"])
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in x]
    assert not any("guide_id#" in x for x in joins)
    counts = {(e, g, x): n for e, g, x, n in rows}
    for e in "uv":
        names = [f"{e}{i}" for i in range(60)]
        mean = {g: math.prod(counts[e, g, x] for x in ("t0", "t1", "t2")) ** (1 / 3) for g in names}
        f = {x: statistics.median(counts[e, g, x] / mean[g] for g in names) for x in ("t0", "t1", "t2")}
        want = {g: math.log2((counts[e, g, "t2"] / f["t2"] + 1) / ((counts[e, g, "t0"] / f["t0"] + counts[e, g, "t1"] / f["t1"]) / 2 + 1)) for g in names}
        got = {r["guide_id"]: r["lfc"] for r in found.where(F.col("experiment") == e).collect()}
        assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("name", ["w10_clusters", "d14_best_of_clusters", "t06_reranked", "w12_ranked"])
def test_short_contigs_are_shuffled_once(spark, corpus, monkeypatch, name):
    """Guides were found two or three times, and shuffled again for pairs, stretches, counts and ranks; long contigs still are."""
    path, texts = corpus
    found = catalog.QUERIES[name](spark, path)
    assert len(exchanges(found)) == 1
    monkeypatch.setattr(design, "SHORT", 200)
    both = catalog.QUERIES[name](spark, path)
    assert len(exchanges(both)) > 2
    rows = lambda df: sorted(tuple(r) for r in df.select(*found.columns).collect())
    assert rows(both) == rows(found) and len({r[0] for r in rows(found)}) > 3


def test_hits_are_written_compressed_and_pairs_once(spark, corpus):
    """The sink of hits was plain text; pairs of sequences were found twice for hits in a guide's own gene."""
    path, _ = corpus
    sink = catalog.QUERIES["s20_hit_sink"](spark, path)
    assert sink.inputFiles() and all(f.endswith(".csv.gz") for f in sink.inputFiles()) and sink.count() > 0
    assert "Generate posexplode" not in catalog.QUERIES["d16_own_gene_hits"](spark, path)._jdf.queryExecution().optimizedPlan().toString()
