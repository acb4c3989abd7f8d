"""Each registered query and each stage of the pipeline on tables with nulls, repeated rows, empty and very long texts,
extra columns with clashing names, and on empty tables."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import common, fingerprints, queries

#: Names that operators use inside.
CLASHING = "row slot shard bucket c0 c1 key component component_id kept copy place lang_pred score batch piece word n".split()


def sentence(rng, n, lang="en"):
    part = {"en": ["the", "and", "ship", "thing", "water", "light"], "fr": ["eux", "ère", "çon", "que", "leur", "fois"]}[lang]
    return " ".join(rng.choice(part) + rng.choice(part) + str(rng.randrange(30)) for _ in range(n))


def texts():
    rng = random.Random(11)
    own = [(sentence(rng, rng.randrange(5, 90), l), l) for _ in range(30) for l in ("en", "fr")]
    passage = sentence(rng, 25)
    own += [(sentence(rng, 40) + " " + passage, "en"), (sentence(rng, 40) + " " + passage + " " + sentence(rng, 9), "en")]
    words = sentence(rng, 120).split()
    own += [(" ".join(words), "en"), (" ".join([*words[:60], "new", *words[61:]]), "en")]
    own += [("", "en"), (None, "fr"), ("   \n\t", None), ("12 34 ½", "en"), ("é" * 70 + " \U0001f600", None), (sentence(rng, 9000), "en")]
    return own


def documents():
    rows = [(i * 2, t, l, None if i % 7 == 0 else "s", None if t is None else len(t)) for i, (t, l) in enumerate(texts())]
    rows += [rows[4], rows[4], rows[4], (None, "a text without an id that nobody else has at all", "en", None, None), (None, None, None, None, None)]
    rows += [(1, rows[6][1], "en", "s", 3), (rows[8][0], "another text of an id that is there already", "en", "s", 3)]
    return rows


def put(path, columns, types, rows, clashing=True):
    data = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(columns, types))}
    if clashing:
        data |= {c: pa.array([None if i % 2 else str(i) for i in range(len(rows))], pa.string()) for c in CLASHING if c not in data}
    pq.write_table(pa.table(data), path)


def tables(folder, rows=True):
    some = lambda x: x if rows else []
    put(folder / "documents.parquet", ["doc_id", "text", "lang", "source", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()], some(documents()))
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).round(2).tolist(), i % 3) for i in range(130)]
    vectors += [(7, vectors[7][1], 0)] * 300 + [(7, [float(x) for x in range(6)], 0), (200, None, 0), (201, [1.0, None, 0, 0, 0, 0], 0), (202, [float("inf")] * 6, 0), (None, vectors[0][1], 0)]
    put(folder / "embeddings.parquet", ["vec_id", "embedding", "label"], [pa.int64(), pa.list_(pa.float32()), pa.int32()], some(vectors))
    long = "<p>" + "ü" * 900
    pages = [(1, "u", long), (2, None, long), (3, "u", None), (4, "a b", "x"), (5, "u", "x"), (6, "u", long + "."), (7, "u", "y" * 300_000)]
    put(folder / "pages.parquet", ["page_id", "url", "html"], [pa.int64(), pa.string(), pa.string()], some(pages))
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, None, None), (3, 0, "user", ""), (6, 0, "user", "alone"), (None, 0, "user", "x"), (8, None, "user", "z"), (9, None, "user", "z")]
    put(folder / "conversations.parquet", ["conv_id", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()], some(turns))
    return f"file://{folder}"


@pytest.fixture(scope="module")
def full(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("full"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), rows=False)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_without_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, full, name):
    duck = duckdb.connect()
    for t in ("embeddings", "pages", "conversations"):
        duck.sql(f"create view {t} as select * from '{full[7:]}/{t}.parquet'")
    rel, found = duck.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, full)
    columns = sorted(rel.columns)
    want = sorted(str([dict(zip(rel.columns, r))[c] for c in columns]) for r in rel.fetchall())
    assert want and sorted(str(list(r)) for r in found.select(*columns).collect()) == want


def by_id(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def test_op1(spark, full):
    got = queries.QUERIES["op1_sharding"](spark, full).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in documents())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    shards = collections.defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op3_and_op8_keep_every_row(spark, full):
    for name in ("op3_simhash", "op8_suffix_dedup"):
        got = queries.QUERIES[name](spark, full).collect()
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d for d, *_ in documents())


def test_op5(spark, full):
    got = queries.QUERIES["op5_language_id"](spark, full).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d for d, *_ in documents())
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    und = {d for d, t, *_ in documents() if not any(c.isalpha() for c in t or "")}
    clear = {d for d, *_ in documents()} - {d for d, n in collections.Counter(d for d, *_ in documents()).items() if n > 1}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} & clear == und & clear
    assert {r["lang_pred"] for r in got} == {"und", "en", "fr"}


def test_op6(spark, full):
    got = queries.QUERIES["op6_sentencepiece"](spark, full).collect()
    want = sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest(), True) for d, t, *_ in documents())
    assert sorted((str(r["doc_id"]), r["decoded_sha256"], r["round_trip"]) for r in got) == want


def test_op7(spark, full):
    got = queries.QUERIES["op7_fingerprints"](spark, full).collect()
    # Descending by id, null ids last; equal ids by text, null texts last.
    order = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    want, likeness = [], []
    for i, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest()))
        likeness.append((want[-1], t, edited, after))
    key = lambda r: (str(r["doc_id"]), r["n_chars"], r["edited_sha256"])
    assert sorted(map(key, got)) == sorted(want)
    prints = collections.defaultdict(set)
    of = {key(r): r for r in got}
    off = []

    def jaccard(a, b):
        a, b = (collections.Counter(x.lower().split()) for x in (a, b))
        return 1.0 if not a and not b else sum((a & b).values()) / sum((a | b).values())

    for k, t, edited, after in likeness:
        r = of[k]
        prints[t].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        off += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, after)]
    assert all(len(v) == 1 for v in prints.values())
    spread = 0.5 / math.sqrt(fingerprints.SAMPLES)  # the greatest standard error of a share
    assert abs(np.mean(off)) < spread / 2 and np.sqrt(np.mean(np.square(off))) < spread


def test_op9(spark, full):
    got = queries.QUERIES["op9_packing"](spark, full).collect()
    from tokenizers import Tokenizer

    engine = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    sizes = collections.Counter()
    for d, t, *_ in documents():
        sizes[d] += len(engine.encode(t or "", add_special_tokens=False).ids) + 1
    assert {d: sum(r["length"] for r in rows) for d, rows in by_id(got).items()} == dict(sizes)
    ends = collections.defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in ends.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_columns_and_clean_rows(spark, full, empty):
    docs = common.table(spark, full, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = common.written(stage(spark, docs, full), name)
        assert found.columns == docs.columns and dict(found.dtypes) == dict(docs.dtypes)
        assert stage(spark, common.table(spark, empty, "documents"), empty).count() == 0
        got, before = found.select("doc_id", "text", "n_chars", "slot").collect(), docs.select("doc_id", "text", "n_chars", "slot").collect()
        if name == "language_id":
            assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
            assert len(got) > 0.9 * sum(any(c.isalpha() for c in r["text"] or "") for r in before)
        elif name == "near_duplicates":
            shingled = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
            sets = [shingled(r["text"]) for r in got]
            near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
            assert not near
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in got} <= {r[0] for r in documents() if r[1] in {x[1] for x in documents() if x is not r}} | {2 * 63}
        else:
            assert len(got) == len(before)
            assert sum(r["text"] not in {x["text"] for x in before} for r in got) >= 1
            assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] not in {x["text"] for x in before})
        docs = found
    assert corpus_pipeline.run(spark, empty).count() == 0
    packed = corpus_pipeline.run(spark, full)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
