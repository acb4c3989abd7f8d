"""Near duplicates by SimHash, decided by the exact Jaccard similarity of the sets of five-word shingles.

A fingerprint of all shingles differs in 15 % of its bits at a similarity of 0.8, too many for any key to find. So a
text gets several fingerprints, each the SimHash of the ``SAMPLED`` shingles with the least seeded hashes: at a
similarity s one of n is the same with a probability of 1 - (1 - s**SAMPLED)**n, and n is such that this is at least
``RECALL`` for the least similarity and more above it (6 for 0.8). Texts with a fingerprint within ``DISTANCE`` bits
meet through the pigeonring keys of the operator.

Candidates then pass two bounds that a near pair can't fail, the ratio of the sizes and the bits in which sketches
differ (each shingle flips one bit, so these are at most as many as the shingles in which the sets differ), and what is
left is decided by the shingles themselves.

Pairs are proposed in three turns, so that a large group of copies costs few of them: rows to a leader that is near many
of its bucket; then, between what is not connected by then, the best pair of each row with each group; then all that
remain. A bucket of more than ``BUCKET_ROWS`` texts goes through a turn before these: its rows, dealt over tasks, meet a
few leaders. Rows of the largest group that comes of it need no longer meet each other, only the bucket's other rows. What
has to meet is cut into blocks, and each two blocks meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, simhash

WORDS = 5
#: The least Jaccard similarity, as a fraction.
LEAST = (4, 5)
RECALL = 0.98
SAMPLED = 3
DISTANCE = 1
SEGMENTS = 4
BUCKET_ROWS = 4096
#: Leaders that all rows of a larger bucket meet first.
LEADERS = 4
#: Bits of a sketch: a power of two of at least four for each shingle, within these.
SKETCH_BITS = (1 << 10, 1 << 20)
PAIRS_AT_ONCE = 100_000


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of each five words, sorted; of all words if they are fewer; none without words."""
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return np.unique(simhash._hashes(b" ".join(words), ends, WORDS))


def prints_for(least: tuple[int, int]) -> int:
    """Fingerprints that find a pair at the least similarity with a probability of RECALL."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (least[0] / least[1]) ** SAMPLED))


def prints(found: np.ndarray, count: int, sampled: int = SAMPLED) -> np.ndarray:
    """The SimHash of the shingles with the least hashes, for each of ``count`` seeds."""
    out = np.zeros(count, np.uint64)
    for i in range(count):
        order = simhash._mixed(found, i + 1)
        some = found[np.argpartition(order, sampled - 1)[:sampled]] if len(found) > sampled else found
        out[i] = simhash._majority(simhash._mixed(some, 99))
    return out


def sketch(found: np.ndarray) -> bytes:
    """Bit h modulo the bits is set if an odd number of shingles falls there; a longer sketch folds to a shorter one by XOR."""
    bits = min(max(SKETCH_BITS[0], 1 << (4 * len(found)).bit_length()), SKETCH_BITS[1])
    at, n = np.unique((found >> np.uint64(16)).astype(np.int64) % bits, return_counts=True)
    odd = np.zeros(bits, bool)
    odd[at[n % 2 == 1]] = True
    return np.packbits(odd).tobytes()


class Bucket:
    """Texts that share a key: which of them may be near."""

    def __init__(self, pdf: pd.DataFrame, least: tuple[int, int], distance: int):
        self.p, self.q = least
        self.distance = distance
        self.node, self.comp, self.print = (pdf[c].to_numpy() for c in ("node", "comp", "print"))
        self.print = self.print.view(np.uint64)
        self.size = pdf["size"].to_numpy().astype(np.int64)
        self.block = pdf["block"].to_numpy()
        self.two_blocks = self.block.min() != self.block.max()
        self.turned = bool(pdf["start"].iloc[0])
        raw = pdf["sketch"].tolist()
        self.kind = np.fromiter(map(len, raw), np.int64, len(raw))
        self.at = np.zeros(len(raw), np.int64)
        self.bits: dict[int, np.ndarray] = {}
        for k in np.unique(self.kind).tolist():
            rows = np.flatnonzero(self.kind == k)
            self.at[rows] = np.arange(len(rows))
            self.bits[k] = np.frombuffer(b"".join([raw[i] for i in rows]), np.uint64).reshape(len(rows), k // 8)

    def near(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those of others that may be near row i, the share of shingles in which the sketches tell them to differ)."""
        p, q = self.p, self.q
        total = self.size[others] + self.size[i]
        ok = (q * np.minimum(self.size[others], self.size[i]) >= p * np.maximum(self.size[others], self.size[i])) & (self.node[others] != self.node[i])
        bits = np.bitwise_count(self.print[others] ^ self.print[i])
        ok &= (bits <= self.distance) & (bits > 0) if self.turned else bits <= self.distance  # equal prints meet at the first start
        if self.two_blocks:
            ok &= self.block[others] != self.block[i]
        others, total = others[ok], total[ok]
        differ = np.full(len(others), -1, np.int64)
        own = int(self.kind[i])
        mine = self.bits[own][self.at[i]]
        for k in (own // 2, own, own * 2):
            some = np.flatnonzero(self.kind[others] == k)
            if not len(some):
                continue
            rows = self.bits[k][self.at[others[some]]]
            x = mine
            if k > own:
                rows = rows[:, : own // 8] ^ rows[:, own // 8 :]
            elif k < own:
                x = mine[: k // 8] ^ mine[k // 8 :]
            differ[some] = np.bitwise_count(rows ^ x).sum(1, dtype=np.int64)
        ok = (differ >= 0) & (differ * (p + q) <= (q - p) * total)
        return others[ok], differ[ok] / np.maximum(total[ok], 1)

    def leaders(self) -> Iterator[tuple[int, int]]:
        """Pairs that give each row which has a near one a pair: with a leader, or a leader's own nearest."""
        left = np.ones(len(self.node), bool)
        everyone = np.arange(len(self.node))
        while len(open_ := np.flatnonzero(left)):
            tried = open_[:: max(1, len(open_) // 4)][:4] if len(open_) > 32 else open_[:1]
            found = [(i, *self.near(i, everyone)) for i in tried.tolist()]
            i, others, differ = max(found, key=lambda x: left[x[1]].sum())
            new = left[others]
            for j in others[new].tolist():
                yield i, j
            left[others[new]] = False
            if not new.all():  # near one that another leader has
                yield i, int(others[~new][differ[~new].argmin()])
            left[i] = False
            alone = [x[0] for x in found if not len(x[1])]
            left[alone] = False

    def led(self) -> Iterator[tuple[int, int]]:
        """A pair for each row that may be near a leader, with the first such one; leaders are in block -1."""
        left = np.flatnonzero(self.block >= 0)
        for i in np.flatnonzero(self.block < 0).tolist():
            others = self.near(i, left)[0]
            for j in others.tolist():
                yield i, j
            left = np.setdiff1d(left, others, assume_unique=True)

    def between(self, best_only: bool) -> Iterator[tuple[int, int]]:
        """Pairs of different groups: for a row the best one with each other group, or all."""
        if (self.comp == self.comp[0]).all():
            return
        _, group, n = np.unique(self.comp, return_inverse=True, return_counts=True)
        order = np.lexsort((group, -n[group]))  # the largest group first, whose rows look for none
        edge = np.concatenate(([True], group[order][1:] != group[order][:-1]))
        begin = np.maximum.accumulate(np.where(edge, np.arange(len(order)), 0))
        for at in np.flatnonzero(begin > 0).tolist():
            i = int(order[at])
            others, differ = self.near(i, order[: begin[at]])
            if best_only and len(others):
                rank = np.lexsort((differ, self.comp[others]))
                others = others[rank]
                others = others[np.concatenate(([True], self.comp[others][1:] != self.comp[others][:-1]))]
            for j in others.tolist():
                yield i, j


def _pairs(rows: DataFrame, least: tuple[int, int], turn: int) -> DataFrame:
    """(a, b), a < b, for rows (key, start, block, node, comp, print, size, sketch): what turn 0, 1, 2 or 3 proposes."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int]] = []

        def flush() -> pd.DataFrame:
            both = np.unique(np.sort(np.array(held, np.int64), 1), axis=0)
            held.clear()
            return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

        for pdf in common.groups(batches, "key"):
            bucket = Bucket(pdf, least, DISTANCE)
            for i, j in bucket.led() if turn == 0 else bucket.leaders() if turn == 1 else bucket.between(turn == 2):
                held.append((bucket.node[i], bucket.node[j]))
                if len(held) >= PAIRS_AT_ONCE:
                    yield flush()
        if held:
            yield flush()

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInPandas(task, "a long, b long").distinct()


def _met(nodes: DataFrame, count: int) -> DataFrame:
    """(key, start, node, print, n) of the texts that share a key with n - 1 others: pigeonring keys of each print.

    Texts whose print is the same meet at the first start of its ring; the other starts are for those that differ.
    """
    keys = [k for i in range(count) for k in simhash.ring_keys(F.col("prints")[i], i, DISTANCE, SEGMENTS)]
    rows = nodes.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.start", "k.key", "k.print").repartition("key")
    of = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("low"), F.max("print").alias("high"), F.min("start").alias("s"))
    return rows.join(of.where("n > 1 and (s = 0 or low <> high)").select("key", "n"), "key").select("key", "start", "node", "print", "n")


def _with_leaders(hot: DataFrame, bucket_rows: int) -> DataFrame:
    """(key, start, block, node, print): the rows of large buckets in parts of about bucket_rows, the leaders in each of them."""
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    part = lambda at: F.xxhash64("key", at).alias("key")
    least = [F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node", "print")) for i in range(LEADERS)]
    leaders = hot.groupBy("key", "n").agg(F.array(*least).alias("l")).select("key", "n", F.explode(F.array_distinct(F.transform("l", lambda x: F.struct(x["node"].alias("node"), x["print"].alias("print"))))).alias("l"))
    leaders = leaders.select("key", "l.*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("at"))
    rows = hot.select(part(F.pmod(F.xxhash64("node"), parts)), F.lit(0).alias("start"), F.lit(0).alias("block"), "node", "print")
    return rows.union(leaders.select(part(F.col("at").cast("long")), F.lit(0), F.lit(-1), "node", "print"))


def _in_blocks(hot: DataFrame, members: DataFrame, bucket_rows: int) -> DataFrame:
    """(key, start, block, node, print): large buckets as one for each two blocks whose rows have to meet.

    Members of a bucket's largest group are in even blocks, all others in odd ones; two even blocks don't meet. A
    bucket that is one group gives no rows.
    """
    rows = hot.join(members, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    groups = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
    of = groups.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("top"), F.sum("rows").alias("all"))
    blocks = lambda n: F.ceil(n / bucket_rows).cast("int")
    of = of.select("key", F.col("top.comp").alias("top"), blocks(F.col("top.rows")).alias("even"), blocks(F.col("all") - F.col("top.rows")).alias("odd")).where("odd > 0")
    met = rows.join(of, "key")
    in_top, at = F.col("comp") == F.col("top"), F.xxhash64("node")
    block = F.when(in_top, F.pmod(at, "even") * 2).otherwise(F.pmod(at, "odd") * 2 + 1).cast("int")
    odd, even = F.sequence(F.lit(1), F.col("odd") * 2 - 1, F.lit(2)), F.sequence(F.lit(0), F.col("even") * 2 - 2, F.lit(2))
    met = met.select("key", "start", "node", "print", block.alias("block"), F.explode(F.when(in_top, odd).otherwise(F.concat(even, odd))).alias("other"))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return met.select(pair.alias("key"), "start", "block", "node", "print")


def _judged(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs whose sets are at the similarity."""
    p, q = least

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"]):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append(q * both >= p * ((len(x) + len(y)) // 8 - both))
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(task, "a long, b long")


def near_duplicates(docs: DataFrame, least: tuple[int, int] = LEAST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, of_text, component) for each row of (doc_id, text); of_text is the xxhash64 of the text.

    Rows have the same component if pairs at the similarity connect their texts; texts with equal sets of shingles are
    near, those without words (null, empty, white space) among them. Any column may be null, rows may be repeated, and
    an empty table gives an empty one. Other columns of docs are not read.
    """
    common.small_batches(docs.sparkSession)
    count = prints_for(least)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of_text"), "text")

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found = shingles(text)
                rows.append((xxhash.xxh3_64_intdigest(found.tobytes()), len(found), prints(found, count).view(np.int64), sketch(found)))
            node, size, of, bits = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "of_text": pdf["of_text"], "node": np.array(node, np.uint64).view(np.int64), "size": size, "prints": of, "sketch": bits})

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "shingles": [shingles(t).tobytes() for t in pdf["text"]]})

    whole = common.keep(texts.mapInPandas(signed, "doc_id long, of_text long, node long, size int, prints array<long>, sketch binary"))
    nodes = common.keep(whole.groupBy("node").agg(F.min_by(F.struct("of_text", "size", "prints", "sketch"), "of_text").alias("x")).select("node", "x.*"))
    signed_rows = whole.select("doc_id", "of_text", "node")
    facts = nodes.select("node", "size", "sketch")
    rows = common.keep(_met(nodes, count))
    hot = rows.where(F.col("n") > bucket_rows)
    met = rows.where(F.col("n") <= bucket_rows).select("key", "start", F.lit(0).alias("block"), "node", "print")

    def sets_for(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = wanted if known is None else wanted.join(known.select("node"), "node", "left_anti")
        named = common.sent_out(common.keep(nodes.join(wanted, "node").select("node", "of_text")))
        return common.keep(texts.join(named, "of_text").groupBy("node").agg(F.first("text").alias("text")).mapInPandas(sets_of, "node long, shingles binary"))

    led = None
    if not hot.isEmpty():
        led = common.keep(_pairs(_with_leaders(hot, bucket_rows).join(facts, "node").withColumn("comp", F.col("node")), least, 0))
        sets = sets_for(led)
        near = common.keep(_judged(led, sets, least))
        met = met.union(_in_blocks(hot, graph.connected_components(near), bucket_rows))
    met = common.keep(met.join(facts, "node"))
    tested = _pairs(met.withColumn("comp", F.col("node")), least, 1)
    if led is None:
        tested = common.keep(tested)
        sets = sets_for(tested)
        linked = common.keep(_judged(tested, sets, least))
    else:
        tested = common.keep(tested.join(led, ["a", "b"], "left_anti"))
        sets = sets.union(sets_for(tested, sets))
        linked = common.keep(near.union(_judged(tested, sets, least)))
        tested = tested.union(led)
    met = common.keep(met.join(sets.select("node"), "node", "left_semi"))
    groups = common.keep(graph.connected_components(linked))
    for turn in (2, 3):
        grouped = met.join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        open_ = grouped.groupBy("key").agg(F.min("comp").alias("m"), F.max("comp").alias("x")).where("m <> x").select("key")
        more = common.keep(_pairs(grouped.join(open_, "key", "left_semi"), least, turn).join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(more)
        linked = common.keep(_judged(more, sets, least))
        if not linked.isEmpty():  # a row's link to its component stands for all earlier links
            linked = linked.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
            groups = common.keep(graph.connected_components(linked))
    return signed_rows.join(groups, "node", "left").select("doc_id", "of_text", F.coalesce("component", "node").alias("component"))
