"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import chat, fingerprints, langid, packing, sentencepiece, sharding, simhash, suffixes, vafile, warc


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gam", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    out = [*base, base[3], base[3], base[5] + " tail", base[7][:200] + words(rng, 30) + base[9][-150:], None, "", "   ", "é" * 80, words(rng, 4000)]
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "l" + str(d % 2), 7) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, row int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sharding(spark, docs, none, texts, tmp_path):
    df = docs.union(docs.where("doc_id = 9")).withColumnRenamed("kept", "slot")
    done = sharding.shuffle_into_shards(df, 8, bucket_bytes=2000)
    rows = done.select("row.doc_id", "row.text", "shard", "slot").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in df.collect())
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shuffle_into_shards(none, 8).count() == 0
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(done, path)
    back = spark.read.parquet(path)
    assert sorted(map(str, rows)) == sorted(map(str, back.select("row.doc_id", "row.text", "shard", "slot").collect()))
    for f in {r[0] for r in back.select(F.input_file_name()).distinct().collect()}:
        slots = [r["slot"] for r in spark.read.parquet(f).collect()]
        assert slots == sorted(slots)


def test_sharding_spreads_repeated_rows(spark):
    df = spark.range(4).select(F.explode(F.sequence(F.lit(1), F.lit(500))).alias("n")).select(F.lit(1).alias("doc_id"), F.lit("the same text").alias("text"))
    sizes = [r["count"] for r in sharding.shuffle_into_shards(df, 4, bucket_bytes=10_000).groupBy("bucket").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 2 * min(sizes) + 100


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 1500
    pages = [(1, "http://a/ b\n", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", long), (None, "u", "ü" * 900)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    back = warc.read_archives(warc.write_archives(warc.label_revisits(df), f"file://{tmp_path}/w", archive_bytes=2000)).collect()
    assert len(back) == len(pages)
    by = {r["page_id"]: r for r in back}
    assert by[1]["url"] == pages[0][1] and by[2]["url"] is None
    assert [(by[i]["record_type"], by[i]["refers_to"]) for i in (1, 2, 3, 4, 5, 6)] == [("revisit", 6), ("revisit", 6), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert bytes(by[6]["payload"]) == long.encode() and by[1]["payload_bytes"] == len(long)
    assert all(by[p]["payload_digest"] == hashlib.sha1((h or "").encode()).hexdigest() for p, _, h in pages)
    records = [warc.record(i, "u", (long + str(i)).encode(), hashlib.sha1((long + str(i)).encode()).hexdigest(), "response", None) for i in range(200)]
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    (tmp_path / "one.warc.zst").write_bytes(data)
    assert list(warc.records_of(f"file://{tmp_path}/one.warc.zst")) == records


def plain_simhash(text, k=3):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps, most):
    up = {d: d for d in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_simhash(docs, none, texts):
    fps = {d: plain_simhash(t) for d, t in texts}
    want = components(fps, 2)
    got = simhash.near_duplicates(docs).collect()
    assert all(r["print"] % 2**64 == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in got)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_simhash_links_lose_no_connection(spark, bucket_rows):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {i: centres[i % 6] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for i in range(300)}
    rows, seen = [], {}
    for d, f in fps.items():
        if f not in seen:
            seen[f] = d
            rows.append((d, f - (f >> 63 << 64)))
    df = spark.createDataFrame(rows, "node long, print long")
    from sievework.llm import graph

    got = {r["node"]: r["component"] for r in graph.connected_components(simhash.links(df, bucket_rows=bucket_rows)).collect()}
    want = components({d: fps[d] for d, _ in rows}, 2)
    assert {d: got.get(d, d) for d in want} == want


def plain_top_k(rows, queries, k):
    longest = max(len(v) for _, v in rows + queries)
    full = lambda v: [*v, *[0] * (longest - len(v))]
    held = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    found = []
    for own, q in queries:
        best = sorted((-held(sum(a * b for a, b in zip(full(v), full(q)))), i) for i, v in rows if i != own)[:k]
        found += [(own, rank, i, -x) for rank, (x, i) in enumerate(best, 1)]
    return sorted(found)


@pytest.mark.parametrize("scale, bits", [(1, 5), (40, 1), (40, 9), (1 << 40, 5), (1 << 62, 5)])
def test_top_k_equals_a_scan(spark, scale, bits):
    dice = random.Random(scale)
    rows = [(i, [dice.randint(-scale, scale) for _ in range(dice.choice([3, 5, 5, 5]))]) for i in dice.sample(range(-200, 1000), 260)]
    rows += [(i + 2000, rows[0][1]) for i in range(60)]  # many ids of a vector
    rows += [rows[1]] * 9 + [(rows[2][0], [scale, -scale, scale])] * 2  # repeated rows, two vectors of an id
    queries = [rows[0], rows[1], rows[270], (-999, [scale] * 7), (5000, [-scale])] + rows[3:9]
    kind = "vec_id long, v array<long>"
    got = vafile.top_k(spark.createDataFrame([(*r, "x") for r in rows], kind + ", row string"), spark.createDataFrame(queries, kind), 6, block_rows=100, group_queries=5, bits=bits)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top_k(rows, list({i: v for i, v in queries}.items()), 6)


def test_cells_bound_every_score():
    rng = np.random.default_rng(4)
    for low, high in ((-3, 9), (-(1 << 63), (1 << 63) - 1), (5, 5)):
        rows, queries = (rng.integers(low, high, (n, 8), endpoint=True) for n in (200, 9))
        grid = vafile.Cells(rows.min(0).tolist(), rows.max(0).tolist())
        for i, centre, slack in vafile.bounds(grid, grid.of(rows), queries):
            score = [sum(int(a) * int(b) for a, b in zip(r, queries[i])) for r in rows]
            assert all(c - slack <= x <= c + slack for c, x in zip(centre, score))


def test_top_k_leaves_out_broken_vectors(spark):
    bad = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [3.0, -1.0]), (20, [1.0, 1.0]), (5, [1.0, 2.0])]
    rows = vafile.integral(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    got = vafile.top_k(rows, rows.where("vec_id % 20 = 0"), 2, block_rows=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 20480), (0, 2, 20, 12288), (20, 1, 0, 12288), (20, 2, 5, 12288)]
    assert vafile.top_k(rows.limit(0), rows.limit(0), 2).count() == 0


def test_language_id(spark, none):
    rng = random.Random(1)
    part = {"aa": ["the", "and", "shon", "ting"], "bb": ["eux", "ère", "çon", "que"], "cc": ["ung", "sch", "ß", "keit"]}
    rows = [(i, " ".join("".join(rng.choice(part[k]) for _ in range(2)) for _ in range(60)), k) for i, k in enumerate(list(part) * 60)]
    rows += [(1000, None, "aa"), (1001, "123 --", "bb"), (1002, "", None), (1003, "½ ² Ⅷ ①", None)] + [(1004, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(df)).selectExpr("c0 as doc_id", "c2 as lang", "lang_pred", "score").collect()
    held = [r for r in got if r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 1000} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.predict(none, None).count() == 0


def test_sentencepiece_equals_the_library_and_round_trips(texts):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    p = proto.ModelProto()
    with open(sentencepiece.default_model(), "rb") as f:
        p.ParseFromString(f.read())
    p.trainer_spec.model_type = 1  # unigram: Viterbi over the scores
    for x in p.pieces:
        if x.type == sentencepiece.NORMAL:
            x.score = x.score / 1000 if x.score > -1e8 else -100.0  # exact enough in the library's single precision
    library = SentencePieceProcessor(model_proto=p.SerializeToString())
    own = sentencepiece.Pieces([(x.piece, x.score, x.type) for x in p.pieces])
    for _, t in texts:
        if t and "\n" not in t and "  " not in t and len(t) < 400:
            a, b = np.frombuffer(own.encode(t), "<u4").tolist(), library.encode(t)
            cost = lambda ids: sum(p.pieces[i].score for i in ids)
            assert a == b or cost(a) >= cost(b) - 1e-3
    real = sentencepiece.Pieces.load(sentencepiece.default_model())
    for t in [t or "" for _, t in texts] + ["a  b", "一\U0001f600 x", "\n\n", " lead", "tail ", "\x00"]:
        assert real.decode(real.encode(t)) == t


def test_sentencepiece_has_the_ids_of_a_bpe_model(texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=sentencepiece.default_model())
    own = sentencepiece.Pieces.load(sentencepiece.default_model())
    dice = random.Random(6)
    made = ["".join(dice.choice("  aaabcdeinorst.,0一é\n\t▁😀") for _ in range(dice.randrange(1, 60))) for _ in range(3000)]
    for t in [t or "" for _, t in texts] + made + ["a" * 5000, " " * 77, "in" * 900 + "the", "x  y   z     ", "▁", "\n\n"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t), t[:99]


@pytest.mark.parametrize("prefix, squeeze", [(True, False), (False, False), (True, True), (False, True)])
def test_sentencepiece_follows_the_flags_of_a_unigram_model(prefix, squeeze):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    p, dice = proto.ModelProto(), random.Random(7)
    own_words = ["▁", "a", "b", "c", "ab", "▁a", "bc", "abc", "▁ab", "cab", "▁c", "ca"]
    for piece, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(w, 1) for w in own_words] + [("bab", 4), ("ac", 5)]:
        p.pieces.add(piece=piece, score=-dice.randrange(100, 900) / 128 if kind == 1 else 0.0, type=kind)
    p.trainer_spec.model_type = 1
    p.normalizer_spec.name, p.normalizer_spec.add_dummy_prefix, p.normalizer_spec.remove_extra_whitespaces = "identity", prefix, squeeze
    library = SentencePieceProcessor(model_proto=p.SerializeToString())
    own = sentencepiece.Pieces([(x.piece, x.score, x.type) for x in p.pieces], prefix=prefix, squeeze=squeeze)
    score = {x.piece: x.score for x in p.pieces}
    for _ in range(2000):
        t = "".join(dice.choice("aabbcc  ") for _ in range(dice.randrange(0, 25)))
        got, want = np.frombuffer(own.encode(t), "<u4").tolist(), library.encode(t)
        if got != want:  # of equal scores either
            cost = lambda ids: sum(score[p.pieces[i].piece] if p.pieces[i].type == 1 else 0.2 for i in ids)
            assert cost(got) == pytest.approx(cost(want), abs=1e-4), t
        assert own.decode(np.array(want, "<u4").tobytes()) == library.decode(want)


def test_sentencepiece_refuses_what_it_does_not_know(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    p = proto.ModelProto()
    with open(sentencepiece.default_model(), "rb") as f:
        p.ParseFromString(f.read())
    p.normalizer_spec.precompiled_charsmap = b"x"
    (tmp_path / "m").write_bytes(p.SerializeToString())
    with pytest.raises(ValueError):
        sentencepiece.Pieces.load(str(tmp_path / "m"))
    for kind, pieces in ((3, []), (2, [("ab", 0.0, 4)]), (2, [("ab", 0.0, 5)]), (1, [("a▁", 0.0, 1)])):
        with pytest.raises(ValueError):
            sentencepiece.Pieces(pieces, kind=kind)


def test_sentencepiece_viterbi_equals_all_segmentations():
    own = sentencepiece.Pieces([("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3, 1), ("▁a", -2.5, 1), ("ba", -2.2, 1), ("aba", -4.1, 1)])
    table = {t: s for t, s in (("▁", -3), ("a", -2), ("b", -2), ("ab", -3), ("▁a", -2.5), ("ba", -2.2), ("aba", -4.1))}

    def best(s):
        return 0 if not s else max((table[s[:n]] + best(s[n:]) for n in (1, 2, 3) if s[:n] in table), default=-1e9)

    scores = {2: -2, 1: -3, 3: -2, 4: -3, 5: -2.5, 6: -2.2, 7: -4.1}
    for t in ("abab", "aabba", "bababab", "ab ba aba"):
        got = np.frombuffer(own.encode(t), "<u4").tolist()
        assert sum(scores[i] for i in got) == pytest.approx(sum(best(w) for w in sentencepiece._WORD.findall("▁" + t.replace(" ", "▁"))))


def test_fingerprints(docs, none, texts, spark):
    rows = {r["doc_id"]: r for r in fingerprints.in_order(docs, bucket_docs=7).where("not copy").collect()}
    ordered = sorted(texts, reverse=True)
    for i, (d, _) in enumerate(ordered):
        assert rows[d]["next_text"] == ordered[(i + 1) % len(ordered)][1]
    assert fingerprints.in_order(none).count() == 0
    one = fingerprints.in_order(spark.createDataFrame([(5, "x")], "doc_id long, text string")).where("not copy").collect()
    assert [r["next_text"] for r in one] == ["x"]
    prints = {r["id"]: r["samples"] for r in fingerprints.fingerprint(docs.select(F.col("doc_id").alias("id"), "text"), 128).collect()}
    by = dict(texts)
    assert prints[9] == prints[120] and prints[by and 132] == prints[135]  # copies; null and empty

    def jaccard(a, b):
        a, b = (collections.Counter((x or "").lower().split()) for x in (a, b))
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    off = [np.mean(np.array(prints[a]) == np.array(prints[b])) - jaccard(by[a], by[b]) for a in (0, 6, 9, 15, 21, 129) for b in (15, 27, 126, 129, 144)]
    assert np.abs(off).mean() < 0.05


@pytest.mark.parametrize("how", [{}, {"windows": 40, "batch_bytes": 300, "part_bytes": 500}])
def test_suffix_dedup(docs, none, texts, how):
    first, want = {}, {}
    for d, t in texts:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in texts:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                mark[i : i + 50] = True
        want[d] = (len(b), int(mark.sum()), int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum()), np.frombuffer(b, np.uint8)[~mark].tobytes())
    got = {r["c0"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(docs, **how).collect()}
    assert got == want
    assert suffixes.remove_repeats(none).count() == 0


def test_suffix_sort_orders_by_bytes():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, 600).astype(np.uint8)
    p = suffixes.Prefixes(text)
    starts, lengths = rng.integers(0, 540, 300), rng.integers(1, 50, 300)
    order = suffixes.suffix_sort(p, starts, lengths, np.zeros(300, np.int64))
    cut = [text[s : s + n].tobytes() for s, n in zip(starts[order], lengths[order])]
    assert cut == sorted(cut)


def test_plan_is_exact_and_tight():
    rng = random.Random(3)
    counts = collections.Counter(min(2048, int(rng.lognormvariate(6.2, 0.9)) + 1) for _ in range(8000))
    runs, made = packing.plan(dict(counts))
    seen, spans = collections.defaultdict(set), collections.defaultdict(list)
    for length, rank, n, first, each, offset in runs:
        for k in range(n):
            seen[length].add(rank + k)
            spans[first + k // each].append((offset + k % each * length, length))
    assert all(seen[n] == set(range(c)) for n, c in counts.items()) and set(spans) == set(range(made))
    for v in spans.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    assert made <= 1.03 * sum(n * c for n, c in counts.items()) / 2048 + 1
    assert packing.plan({}) == ([], 0)


def test_packing_has_the_ids_of_whole_texts(docs, none, texts):
    from tokenizers import Tokenizer

    engine = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d, t in texts:
        ids = np.array([*engine.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        rows = sorted(by[d], key=lambda r: r["piece"])
        assert sum(r["length"] for r in rows) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
        assert all(r["length"] == 2048 for r in rows[1:])
    assert packing.pack_documents(none).count() == 0
    odd = [" a", "a  b", "a \nb", "", "  ", "a\tb", "it's o'clock  ' s", "<|endoftext|> x", "a b "]
    coder = packing.WordEncoder(packing.default_tokenizer())
    odd += ["a <|endoftext|> x", "x<|endoftext|>", " <|endoftext|>"]
    plain = [np.array(engine.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert coder.encode(odd) == plain


def test_preferences(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "x"), (0, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.createOrReplaceTempView("c")
    whole = chat.conversations(df).collect()
    assert {r["conv_id"]: len(r["turns"]) for r in whole} == {0: 2, 1: 3, 2: 1, 4: 1, 5: 1}
    pair = chat.conversations(df).where("conv_id in (0, 1)").groupBy().agg(F.max(F.when(F.col("conv_id") == 0, F.col("turns"))).alias("chosen"), F.max(F.when(F.col("conv_id") == 1, F.col("turns"))).alias("rejected"))
    r = chat.format_preferences(pair).first()
    assert (r["n_prompt_turns"], r["prompt"], r["chosen_completion"]) == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n")
    assert [tuple(x) for x in r["rejected_mask"]] == [(14, 25)] and r["rejected_completion"][14:25] == "bad<|end|>\n"


def ids_of_all_kinds():
    rng = random.Random(21)
    far = [*range(-40, 300), 2**62, -(2**63), 2**63 - 1, 5 - 2**61]
    return {
        "far apart": far, "hashed": [rng.getrandbits(64) - 2**63 for _ in range(400)], "three": [-9 * 10**18, 5, 9 * 10**18], "mostly null": [None] * 900 + [4, 2**60],
        "one repeated": [7] * 900 + list(range(30)), "ends repeated": [-(2**63)] * 300 + [2**63 - 1] * 300 + [0] * 20, "one": [3], "all null": [None] * 200,
    }


@pytest.mark.parametrize("kind", ids_of_all_kinds())
def test_documents_in_order_whatever_the_ids(spark, kind):
    ids = ids_of_all_kinds()[kind]
    df = spark.createDataFrame([(d, f"text {i % 97}" if i % 5 else None) for i, d in enumerate(ids)], "doc_id long, text string").repartition(3).cache()
    df.count()
    rows = fingerprints.in_order(df, bucket_docs=16).collect()
    own = sorted((r for r in rows if not r["copy"]), key=lambda r: (-r["bucket"], r["place"]))
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in own])) == sorted(map(str, map(tuple, df.collect())))
    found = [r["doc_id"] for r in own]
    assert found == sorted(found, key=lambda d: (d is not None, d or 0), reverse=True)
    assert [r["next_text"] for r in own] == [own[(i + 1) % len(own)]["text"] for i in range(len(own))]
    assert max(collections.Counter(r["bucket"] for r in rows).values()) <= 80  # a bucket of 16, ties, copies and chance
