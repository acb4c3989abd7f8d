"""Periodic runs, first-fit packing and whitening against plain versions, and on nulls, repeats and empty tables."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import firstfit, packing, periodic, whitening
from tests.llm.test_llm_queries import documents, empty, full  # noqa: F401


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(all(w[a] == w[a + p] for a in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_facts(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, best[1] * 1000 // best[2])
    digests = ["".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(x for i, x in enumerate(w) if i not in dropped)]
    return (doc, len(found), *four, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            letters, w = rng.choice([1, 2, 3, 50]), []
            while rng.random() < 0.9 and len(w) < 160:
                part = [rng.randrange(letters) for _ in range(rng.randrange(1, 20))]
                w += (part * rng.randrange(2, 8))[: rng.randrange(1, 100)] if rng.random() < 0.5 else part
            docs.append(w)
        ends, want, at = np.cumsum([len(d) for d in docs]), [], 0
        for d in docs:
            want += [(s + at, n, q) for s, n, q in plain_runs(d)]
            at += len(d)
        assert periodic.runs(np.array(sum(docs, []), np.int64), ends) == want


def test_long_periodic_documents_take_no_square_of_time():
    for w in ([0] * 300_000, list(range(7)) * 50_000, [random.Random(2).randrange(2) for _ in range(100_000)]):
        found = periodic.runs(np.array(w), np.array([len(w)]))
        assert len(found) < len(w) / 10


def texts_with_runs():
    rng = random.Random(3)
    out = []
    for i in range(160):
        w = [rng.choice("ab cd ef gh ij é".split()) for _ in range(rng.randrange(0, 60))]
        part = [rng.choice("xy zz é".split()) for _ in range(rng.randrange(1, 9))]
        out.append(" \t\x0b".join([*w, *(part * rng.randrange(1, 9)), *w[:9]]))
    return out


def test_op12(spark, full):  # noqa: F811
    rows = [*[(i - 80, t) for i, t in enumerate(texts_with_runs())], (None, "a a a a a a a b"), (2**62 + 1, "x " * 40), (5, None), (5, ""), (5, " \n"), (5, "a\xa0b " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(map(str, r))
    for found, want in ((periodic.collapse(df, with_edits=True), rows), (periodic.op12_periodic_runs(spark, full), [r[:2] for r in documents() if len(r[1] or "") < 9000])):
        got = [tuple(r) for r in found.collect()]
        short = {key(plain_facts(*r)) for r in want}
        assert short <= set(map(key, got))
        assert len(got) == (len(rows) if want is rows else len(documents()))
    text = {r["doc_id"]: r["collapsed"] for r in periodic.collapse(df.where("doc_id > 100"), with_text=True).collect()}
    assert text == {2**62 + 1: "x"}


def test_runs_of_a_long_document(spark):
    text = "one two three " * 100_000 + "end"
    r = periodic.collapse(spark.createDataFrame([(1, text)], "doc_id int, text string"), with_text=True).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["collapsed"]) == (1, 0, 300_000, 3, "one two three end")


def test_tournament_finds_the_first_bin():
    rng = random.Random(4)
    for _ in range(50):
        tree, room = firstfit.Tournament(60, 100), [100] * 60
        for _ in range(60):
            n = rng.randrange(1, 101)
            want = next(i for i, r in enumerate(room) if r >= n)
            room[want] -= n
            assert tree.place(n) == want


def test_groups_are_whole_and_only_powers_of_two_are_not_full():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.choice([1, 2, 31, 64, 65, 640]) if rng.random() < 0.3 else rng.randrange(1, 90) for _ in range(rng.randrange(0, 60))]
        covered = collections.Counter()
        for pieces in firstfit.pack_group(lengths, 64):
            total = sum(n for _, _, n in pieces)
            assert total == 64 or total < 64 and total & (total - 1) == 0
            covered.update((i, k) for i, at, n in pieces for k in range(at, at + n))
        assert covered == collections.Counter((i, k) for i, n in enumerate(lengths) for k in range(n))


def test_op13(spark, full):  # noqa: F811
    got = firstfit.op13_packing(spark, full).collect()
    from tokenizers import Tokenizer

    engine = Tokenizer.from_file(packing.default_tokenizer())
    ids = {(str(d), len(x)): x for d, t, *_ in documents() for x in [engine.encode(t or "", add_special_tokens=False).ids + [1]]}
    count = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in got:
        x = ids[str(r["doc_id"]), r["doc_tokens"]]
        part = x[r["start"] : r["start"] + r["length"]]
        data = np.array(part, "<u4").tobytes()
        if zlib.crc32(data) == r["ids_crc32"]:  # of equal ids and lengths any text may be meant
            count[str(r["doc_id"]), r["doc_tokens"]] += len(part)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    repeats = collections.Counter((str(d), len(engine.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in documents())
    assert count == {k: k[1] * n for k, n in repeats.items()}
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def test_small_groups_repeated_rows_and_the_same_packing_again(spark):
    df = spark.range(400).select(F.lit(7).alias("doc_id"), F.lit("the same text again").alias("text"), F.lit(1).alias("start")).repartition(2)
    packed = firstfit.pack(df, size=8, group_tokens=50)
    first = sorted(map(tuple, packed.collect()))
    assert sum(r[2] for r in first) == 400 * first[0][4] and first == sorted(map(tuple, packed.collect()))


def plain_whitening(x, n, sums, k):
    v = (x - np.array(sums) / n).T @ (x - np.array(sums) / n) / n
    e, u = np.linalg.eigh(v)
    return e[::-1][:k], u[:, ::-1][:, :k].T, v


def plain_polynomial(a):
    """By traces of powers, in whole numbers."""
    d = len(a)
    c, m = [0] * d + [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        m = a @ m + c[d - k + 1] * np.eye(d, dtype=int).astype(object)
        c[d - k] = -sum((a @ m)[i, i] for i in range(d)) // k
    return c


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(6)
    for d in (1, 2, 5, 12):
        x = rng.integers(-400, 400, (d + 3, d)).astype(object)
        x[:, d // 2] = x[:, 0]  # singular from two dimensions on
        a = x.T @ x
        assert whitening.characteristic_polynomial(spark, a) == plain_polynomial(a)
    assert whitening.polynomial_modulo(np.array([[0, 0, 5], [0, 2, 0], [5, 0, 0]], object), 101) == [50, 76, 99, 1]


def test_roots_count_repeated_ones(spark):
    a = np.diag([5, 5, 5, 2, 0]).astype(object)
    c = whitening.characteristic_polynomial(spark, a)
    assert [whitening.roots_above(c, v) for v in (-1, 0, 1, 2, 4, 5)] == [5, 4, 4, 3, 3, 0]
    roots, shift = whitening.largest_roots(c, 4, 17)
    assert np.allclose([r / 2**shift for r in roots], [5, 5, 5, 2])
    v = np.array(whitening.null_vectors(a, roots, shift))
    assert np.allclose(v @ v.T, np.eye(4)) and np.allclose(v @ a.astype(float), np.array([[5], [5], [5], [2]]) * v)


def embeddings(rng, n, d):
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / 8
    return [(i, [float(v) for v in r], "e") for i, r in enumerate(x.astype(np.float32))]


def test_whitening(spark):
    rows = embeddings(np.random.default_rng(7), 300, 9)
    rows += [(i, rows[3][1], "again") for i in range(300, 420)] + [(3, rows[4][1], None), (None, rows[5][1], None), (600, None, ""), (601, [1.0, None] + [0.0] * 7, ""), (602, [float("nan")] * 9, ""), (603, [float("-inf")] * 9, ""), (604, [0.5, -0.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").repartition(5)
    got = whitening.whiten(df).collect()
    good = [(i, np.floor(256 * np.array([*v, *[0.0] * (9 - len(v))], np.float64)).astype(int)) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(v) for _, v in good}))
    n, sums = len(distinct), distinct.sum(0)
    e, u, v = plain_whitening(distinct, n, sums, 4)
    assert len(got) == 4 * len(good)
    for k in range(4):
        mine = [r for r in got if r["component"] == k + 1]
        want = collections.defaultdict(list)
        for i, x in good:
            want[str(i), int(((n * x - sums) ** 2).sum())].append(float((x - sums / n) @ u[k] / np.sqrt(e[k])))
        sign = np.sign(sum(r["whitened"] * want[str(r["vec_id"]), r["deviation"]][0] for r in mine))
        for r in mine:
            assert r["n"] == n and r["explained"] == pytest.approx(e[k] / np.trace(v), rel=1e-9) and r["identity_error"] < 1e-9
            assert r["whitened"] * sign == pytest.approx(want[str(r["vec_id"]), r["deviation"]][0], abs=1e-8)


def test_whitening_of_large_numbers_and_few_dimensions(spark):
    rows = [(1, [1e14, 0.0]), (2, [-1e14, 3e13]), (3, [2e13, 5e13]), (4, [1e300, -1e300])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-9 for r in got)
    assert all(r["deviation"] is None for r in got) and sum(r["explained"] for r in got if r["vec_id"] == 1) == pytest.approx(1)
    flat = spark.createDataFrame([(1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(flat).count() == 0 and whitening.whiten(flat.where("vec_id > 5")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_op11(spark, full, empty):  # noqa: F811
    got = whitening.op11_whitening(spark, full).collect()
    assert len(got) == 4 * (130 + 301 + 1) and got[0]["identity_error"] < 1e-9
    assert whitening.op11_whitening(spark, empty).count() == 0
