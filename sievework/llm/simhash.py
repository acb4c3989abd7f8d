"""Near-duplicate documents by SimHash with pigeonring filtering.

A 64-bit fingerprint is seen as a ring of ``segments`` segments. If two differ in at most d bits, then from some
segment on every chain of l consecutive segments has at most l * d / segments differing bits. For the first
segments that bound is below one bit, so these are equal, and they are the key by which candidates meet (one key for
each start); in a bucket the longer chains are tested next, and what passes gets the full Hamming check.

A bucket passes on a star for each of its groups of linked fingerprints instead of all its links: no connection is
lost, and a bucket of n gives at most n - 1 rows. Buckets of more than ``bucket_rows`` fingerprints are keyed anew by
further equal bits (of d + 1 parts of the other bits one has no difference), again and again while they are
too large: nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

SEED = 42
BUCKET_ROWS = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Settings:
    """``shingle``: words of a feature; fingerprints link within ``distance`` bits; the ring has ``segments``."""

    shingle: int = 3
    distance: int = 2
    segments: int = 16


def _hashes(joined: bytes, ends: np.ndarray, k: int) -> np.ndarray:
    """XXH64 of each k words of the space-joined words; of all of them if they are fewer."""
    n = len(ends)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[: n - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, n - k + 1)


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Another 64-bit hash of the same features (splitmix64 of the first one); turn 0 keeps it."""
    if not turn:
        return h
    x = h + np.uint64((turn * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, how: Settings = Settings()) -> int:
    """The fingerprint of a whole text, repeated shingles included. No words: zero."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return _majority(_hashes(b" ".join(words), ends, how.shingle))


def prints(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(doc_id, print) for each row of (doc_id, text), over whole texts; a null text has no words."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "print": np.array([fingerprint(t, how) for t in pdf["text"]], np.uint64).view(np.int64)})

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(task, "doc_id long, print long")


def _rotated(fp, by: int):
    return fp if by == 0 else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by))


def _equal_segments(distance: int, segments: int) -> int:
    """Segments that are equal at the start of a chain, as their budget is below one bit."""
    return max(l for l in range(1, segments + 1) if l * distance < segments)


def ring_keys(fp, which: int, distance: int, segments: int) -> list:
    """For each start of the ring of a fingerprint: (start, key, rest, print), rest the bits that are not in the key."""
    step, equal = 64 // segments, _equal_segments(distance, segments)
    out = []
    for s in range(segments):
        turned = _rotated(fp, s * step)
        key = turned.bitwiseAND(F.lit((1 << equal * step) - 1))
        out.append(F.struct(F.lit(s).alias("start"), F.xxhash64(F.lit(which), F.lit(s), key).alias("key"), F.shiftrightunsigned(turned, equal * step).alias("rest"), fp.alias("print")))
    return out


def _stars(rows: DataFrame, how: Settings) -> DataFrame:
    """(a, b) for the rows (key, start, node, print) of each bucket: a star for each linked group."""
    step = 64 // how.segments
    quotas = [(l * step, l * how.distance // how.segments) for l in range(1, how.segments)]
    quotas = [q for i, q in enumerate(quotas) if i == len(quotas) - 1 or quotas[i + 1][1] > q[1]]  # the longest chain of a quota covers the shorter ones

    def near(x: np.ndarray, start: np.ndarray) -> np.ndarray:
        turn = (start * step).astype(np.uint64)
        r = np.where(turn == 0, x, (x >> turn) | (x << (np.uint64(64) - np.maximum(turn, np.uint64(1)))))
        ok = np.ones(len(x), bool)
        for width, most in quotas:
            ok &= (np.bitwise_count(r & np.uint64((1 << width) - 1)) <= most) | (start < 0)
        return ok & (np.bitwise_count(x) <= how.distance)

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        key, node, start, own = (pdf[c].to_numpy() for c in ("key", "node", "start", "print"))
        own = own.view(np.uint64)
        label = np.arange(len(key))
        d, at = 1, label
        while len(at := at[at + d < len(key)]) and len(at := at[key[at] == key[at + d]]):
            other = at + d
            ok = (label[at] != label[other]) & near(own[at] ^ own[other], start[at])
            a, b = at[ok], other[ok]
            while len(a):  # rows of a shift are joined at once; only their labels are kept
                low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                root = np.arange(len(key))
                np.minimum.at(root, high, low)
                while (root != (up := root[root])).any():
                    root = up
                label = root[label]
                still = label[a] != label[b]
                a, b = a[still], b[still]
            d += 1
        moved = np.flatnonzero(label != np.arange(len(key)))
        return pd.DataFrame({"a": node[moved], "b": node[label[moved]]}).drop_duplicates()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cut = int(np.searchsorted(pdf["key"].to_numpy(), pdf["key"].iloc[-1]))  # the last bucket may go on
            held = pdf.iloc[cut:]
            yield stars(pdf.iloc[:cut])
        if held is not None:
            yield stars(held)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInPandas(task, "a long, b long")


def links(nodes: DataFrame, how: Settings = Settings(), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect all of (node, print) that are near; prints differ, nodes are their ids."""
    bits = 64 - _equal_segments(how.distance, how.segments) * (64 // how.segments)
    keys = ring_keys(F.col("print"), 0, how.distance, how.segments)
    rows = nodes.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.*")
    found = None
    parts = how.distance + 1
    while True:
        width = bits // parts
        hot = None
        if width:  # prints differ, so a bucket without further bits has one row
            hot = common.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("key"))
            hot = None if hot.isEmpty() else hot
        some = _stars(rows if hot is None else rows.join(hot, "key", "left_anti"), how)
        found = some if found is None else found.union(some)
        if hot is None:
            return found.distinct()
        deeper = []
        for j in range(parts):
            part = F.shiftrightunsigned("rest", j * width).bitwiseAND(F.lit((1 << width) - 1))
            low = F.col("rest").bitwiseAND(F.lit((1 << j * width) - 1))
            rest = F.shiftleft(F.shiftrightunsigned("rest", (j + 1) * width), j * width).bitwiseOR(low)
            deeper.append(F.struct(F.lit(-1).alias("start"), F.xxhash64("key", F.lit(j), part).alias("key"), rest.alias("rest"), "print"))
        rows = rows.join(hot, "key", "left_semi").select("node", F.explode(F.array(*deeper)).alias("k")).select("node", "k.*")
        bits -= width


def near_duplicates(docs: DataFrame, how: Settings = Settings(), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, print, component_id) for each row of (doc_id, text).

    component_id is the smallest doc_id that links reach. Rows of equal print are linked; they are brought together
    before the search, so copies cost nothing there. A row without a doc_id keeps the component of its print, or null
    if no row of it has one. Repeated rows each get their own; an empty table gives an empty one; other columns of
    docs are not read.
    """
    signed = common.keep(prints(docs, how))
    nodes = common.keep(signed.groupBy("print").agg(F.min("doc_id").alias("node")).where("node is not null"))
    # Prints of a repeated doc_id can share it as their least one: they search under ids of their own.
    by_print = nodes.select(F.col("print").alias("node"), "print")
    members = graph.connected_components(links(by_print, how, bucket_rows))
    ids = nodes.join(members.withColumnRenamed("node", "print"), "print", "left").select("print", "node", F.coalesce("component", "print").alias("component"))
    least = ids.groupBy("component").agg(F.min("node").alias("component_id"))
    ids = ids.join(least, "component").select("print", "component_id")
    return signed.join(ids, "print", "left").select("doc_id", "print", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
