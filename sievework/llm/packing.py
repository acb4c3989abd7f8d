"""Best-fit packing of tokenised documents by the linear grouping scheme.

A document's ids end with id 0; only documents longer than a sequence are cut. What decides a packing is how many
pieces have each length, at most ``size`` counts however large the corpus is, so the plan is made from those counts
alone, and Spark deals the pieces out by their rank among the pieces of their length.

The plan: (1) pieces that fill a sequence stand alone; (2) large lengths are rounded up within groups of equal
cardinality to the longest of the group, which leaves few sizes; (3) for these sizes configurations are found one
after the other, each the fullest that holds the largest size left, and used as often as the counts allow; (4) actual
documents, longest first, take the places of their group; (5) small ones go, longest first, where they fit best.
"""

from __future__ import annotations

import array
import bisect
import functools
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import common

SIZE = 2048
END_ID = 0
#: Lengths up to this part of a sequence count as small.
SMALL_PART = 16
GROUPS = 512
#: Words whose ids a worker keeps at most.
CACHED_WORDS = 400_000

#: A space between two characters that are no white space: tokens never cross it, they start with it.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class WordEncoder:
    """Ids of whole texts by a byte-level BPE of ``tokenizers``, word by word with a cache.

    The pre-tokeniser of such a BPE never lets a token cross from one word over the following single space, so a text
    is cut before those spaces, and each different word is encoded once. Ids are those of the whole text.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.engine = Tokenizer.from_file(path)
        self.added = [t.content for t in self.engine.get_added_tokens_decoder().values()]
        self.batch = getattr(self.engine, "encode_batch_fast", self.engine.encode_batch)
        self.cached, self.words = cached, {}
        vocabulary = self.engine.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that start with a space
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [[t] if any(a in t for a in self.added) else self._split(t) for t in texts]  # added tokens may cross words
        firsts = self._whole([s[0] for s in split])
        get = self.words.get
        found = [[*map(get, s)] for s in split]  # of the first word, which has no space before it, nothing is used
        need = {w for s, ids in zip(split, found) if None in ids for w, x in zip(s, ids) if x is None}
        if need:
            new = self._words(list(need))
            if len(self.words) + len(new) <= self.cached:
                self.words.update(new)
            found = [[new[w] if x is None else x for w, x in zip(s, ids)] if None in ids else ids for s, ids in zip(split, found)]
        return [b"".join([first, *ids[1:]]) for first, ids in zip(firsts, found)]

    @staticmethod
    def _split(text: str) -> list[str]:
        words = text.split(" ")
        return _BETWEEN.split(text) if "" in words or [*map(str.strip, words)] != words else words

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word with a space before it. Words without a space inside are encoded as one text of them all,
        which is then cut before each token that starts with a space."""
        plain, other = [], []
        for w in words:
            (plain if w and " " not in w and not w[0].isspace() and not w[-1].isspace() else other).append(w)
        out = dict(zip(other, self._whole([" " + w for w in other])))
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.batch([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.begins[ids]) * 4).tolist()
            data = ids.tobytes()
            out.update(zip(some, (data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)]))))
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document of (doc_id, text).

    A null text is an empty one: the end id alone. The first piece of a document that is cut takes what is over.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_encoder(tokenizer)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                rows = []
                for doc, ids in zip(part["doc_id"], coder.encode(["" if t is None else t for t in part["text"]])):
                    ids += END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    start, end, k = 0, n if n <= size else n % size or size, 0
                    while start < n:
                        rows.append((doc, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                        start, end, k = end, end + size, k + 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    common.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(task, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Queue:
    """Lengths of a group with the number of pieces left, longest first; gives ranks within the length."""

    def __init__(self, lengths: list[list[int]]):
        self.left = lengths[::-1]  # [length, first rank, count], the longest at the end

    def take(self, most: int) -> tuple[int, int, int]:
        length, rank, count = run = self.left[-1]
        n = min(count, most)
        run[1], run[2] = rank + n, count - n
        if not run[2]:
            self.left.pop()
        return length, rank, n


def _fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How often to take each size so that the sum is the largest one of at most ``room``: subset sums as bits of an int."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []  # what was reachable before one more of size i
    for i, s in enumerate(sizes):
        for _ in range(min(left[i], room // s)):
            grown = (reach | reach << s) & mask
            if grown == reach:
                break
            steps.append((i, reach))
            reach = grown
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, [0] * len(sizes)
    for i, before in reversed(steps):
        if not before >> total & 1:
            used[i] += 1
            total -= sizes[i]
    return used


def plan(counts: dict[int, int], size: int = SIZE, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, rank, n, sequence, each, offset) and the number of sequences.

    A run puts the pieces of a length with ranks rank to rank+n-1, ``each`` of them in a sequence, into sequences
    from ``sequence`` on, from ``offset`` on. Runs are as many as configurations and lengths, not as pieces.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    made = counts.get(size, 0)
    if made:
        runs.append((size, 0, made, 0, 1, 0))
    small = size // SMALL_PART
    large = sorted((n for n in counts if small < n < size), reverse=True)
    each = max(1, -(-sum(counts[n] for n in large) // groups))
    sizes, queues, left = [], [], []
    held: list[list[int]] = []
    for i, n in enumerate(large):
        held.append([n, 0, counts[n]])
        if sum(x[2] for x in held) >= each or i == len(large) - 1:
            sizes.append(held[0][0])
            left.append(sum(x[2] for x in held))
            queues.append(_Queue(held))
            held = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: ranges (first sequence, number)
    while any(left):
        top = next(i for i, n in enumerate(left) if n)
        left[top] -= 1
        alive = [i for i, n in enumerate(left) if n]
        used = [0] * len(sizes)
        for i, n in zip(alive, _fullest([sizes[i] for i in alive], [left[i] for i in alive], size - sizes[top])):
            used[i] = n
        used[top] += 1
        left[top] += 1
        times = min(left[i] // n for i, n in enumerate(used) if n)
        ranges = [(made, times, 0)]  # first sequence, number, tokens used
        made += times
        for i, n in enumerate(used):
            left[i] -= n * times
            for _ in range(n):
                filled = []
                for first, number, taken in ranges:
                    while number:
                        length, rank, got = queues[i].take(number)
                        runs.append((length, rank, got, first, 1, taken))
                        filled.append((first, got, taken + length))
                        first, number = first + got, number - got
                ranges = filled
        for first, number, taken in ranges:
            room[size - taken].append((first, number))
    free = sorted(room)
    for n in sorted((n for n in counts if n <= small), reverse=True):
        rank, count = 0, counts[n]
        while count:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                k = size // n
                number = -(-count // k)
                room[size].append((made, number))
                made += number
                free.append(size)
                at = len(free) - 1
            gap = free[at]
            first, number = room[gap].pop()
            if not room[gap]:
                del free[at]
            k, offset = gap // n, size - gap
            whole = min(number, count // k)
            changed = []
            if whole:
                runs.append((n, rank, whole * k, first, k, offset))
                changed.append((gap - k * n, first, whole))
                rank, count = rank + whole * k, count - whole * k
            if count and whole < number:  # fewer than k are over: one more sequence takes them
                runs.append((n, rank, count, first + whole, count, offset))
                changed.append((gap - count * n, first + whole, 1))
                rank, count, whole = rank + count, 0, whole + 1
            if whole < number:
                changed.append((gap, first + whole, number - whole))
            for g, a, b in changed:
                if g:
                    if not room[g]:
                        bisect.insort(free, g)
                    room[g].append((a, b))
    return runs, made


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(). An empty table stays empty.

    Ranks are taken within (length, salt), so a length that a third of all pieces have is spread over many tasks;
    the counts of (length, salt) give each salt's first rank.
    """
    spark = parts.sparkSession
    n = parts.count()
    salts = max(16, math.ceil(n / 100_000))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs, _ = plan(counts, size)
    before = W.Window.partitionBy("length").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    if size * salts <= 1_000_000:  # its number of rows cannot be larger
        offsets = F.broadcast(offsets)
    at = F.row_number().over(W.Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("at", at).join(offsets, ["length", "salt"]).withColumn("rank", F.col("ahead") + F.col("at") - 1)
    names = ["run_length", "run_rank", "run_n", "first_sequence", "each", "run_offset"]
    schema = T.StructType([T.StructField(c, T.LongType(), False) for c in names])
    places = F.broadcast(spark.createDataFrame(runs, schema))  # bounded by configurations and lengths, not by the corpus
    here = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("run_rank")) & (F.col("rank") < F.col("run_rank") + F.col("run_n"))
    k = F.col("rank") - F.col("run_rank")
    return ranked.join(places, here).select(
        *parts.columns,
        (F.col("first_sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + k % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of (doc_id, text) with their sequence and the place in it.

    Repeated rows are packed each by itself; pieces of equal length, and of equal doc_id among these, may take each
    other's place. A null doc_id is one like any other, an empty table gives an empty one, and other columns of docs are
    not read.
    """
    return pack(common.keep(pieces(docs, tokenizer or default_tokenizer(), size)), size)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
