"""First-fit decreasing packing with a tournament tree of bin capacities, in randomised groups of documents.

Rows are dealt to partitions by a seeded hash and put in its order, so each stretch of a partition is a random sample of
the corpus. A task tokenises its documents and closes a group whenever that holds ``group_tokens`` ids; a group is packed
by itself, so packing needs no shuffle of ids, no plan of the whole and no more memory than a group.

Within a group: (1) a document longer than a sequence first fills whole sequences; (2) the rest of each goes, longest
first, into the first bin that has room, which a tournament tree finds: its leaves are the bins' capacities, each inner
node the larger of its two, so the first leaf that is large enough is one walk down; (3) as cutting is free, bins beyond
the fewest possible, the emptiest ones, are dissolved and their documents fill the gaps of the others; (4) what is then
over, less than a sequence, is cut into sequences that are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import default_tokenizer, word_encoder

SIZE = 2048
END_ID = 1
#: Ids of a group; a document longer than this is a group with those before it.
GROUP_TOKENS = 4_000_000
#: Texts that are encoded together, and rows of a batch of results.
TEXTS, ROWS = 500, 20_000


class Tournament:
    """Bins of equal capacity in a row; finds the first with enough room."""

    def __init__(self, bins: int, size: int):
        self.first_leaf = 1 << max(0, bins - 1).bit_length()
        self.room = [size] * (2 * self.first_leaf)

    def place(self, n: int) -> int:
        """Take n from the first bin that has so much, and return its number."""
        room, at = self.room, 1
        while at < self.first_leaf:
            at *= 2
            if room[at] < n:
                at += 1
        leaf = at
        room[at] -= n
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return leaf - self.first_leaf


def pack_group(lengths: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length): each id of each document once; only powers of two are not full."""
    full: list[list[tuple[int, int, int]]] = []
    rest = []
    for i, n in enumerate(lengths):
        full += [[(i, at, size)] for at in range(0, n - size + 1, size)]
        if n % size:
            rest.append((n % size, i))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins, used = Tournament(len(rest), size), [], []
    for n, i in rest:
        b = tree.place(n)
        if b == len(bins):
            bins.append([])
            used.append(0)
        bins[b].append((i, lengths[i] - n, n))
        used[b] += n
    keep = sum(used) // size
    order = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    over = [piece for b in order[keep:] for piece in bins[b]][::-1]  # the next one at the end

    def take(n: int) -> list[tuple[int, int, int]]:
        taken = []
        while n:
            i, at, m = over.pop()
            if m > n:
                over.append((i, at + n, m - n))
                m = n
            taken.append((i, at, m))
            n -= m
        return taken

    full += [bins[b] + take(size - used[b]) for b in order[:keep]]
    left = sum(m for _, _, m in over)
    while left:
        n = 1 << left.bit_length() - 1
        full.append(take(n))
        left -= n
    return full


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, group_tokens: int = GROUP_TOKENS, seed: int = 42) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of (doc_id, text).

    A null text is an empty one: the end id alone. Repeated rows are documents each, null ids are ids like others, other
    columns are not read, an empty table gives no rows. The deal takes a row's place in its input partition along with
    its id, so no id or text is dealt to one task however often it is repeated; the same partitions and seed give
    the same packing, also where a task is run again.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        ids, coded, held = [], [], 0
        rows: list[tuple] = []

        def close() -> None:
            nonlocal sequence, held
            lengths = [len(c) // 4 for c in coded]
            for pieces in pack_group(lengths, size):
                offset = 0
                for i, at, n in pieces:
                    rows.append((ids[i], at, n, zlib.crc32(memoryview(coded[i])[4 * at : 4 * (at + n)]), lengths[i], sequence, offset))
                    offset += n
                sequence += 1
            ids.clear(), coded.clear()
            held = 0

        def drain(most: int) -> Iterator[pa.RecordBatch]:
            while len(rows) > most:
                some, rows[:ROWS] = rows[:ROWS], []
                kinds = [doc_type, *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], NAMES)

        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            docs_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), TEXTS):
                for doc, data in zip(docs_of[at : at + TEXTS], coder.encode([t or "" for t in texts[at : at + TEXTS]])):
                    ids.append(doc)
                    coded.append(data + END_ID.to_bytes(4, "little"))
                    held += len(data) // 4 + 1
                    if held >= group_tokens:
                        close()
                yield from drain(ROWS)
        if coded:
            close()
        yield from drain(0)

    common.small_batches(docs.sparkSession)
    dealt = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()).alias("deal"))
    mixed = dealt.repartition("deal").sortWithinPartitions("deal", "doc_id").select("doc_id", "text")
    return mixed.mapInArrow(task, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
