"""Periodic runs of words in documents, found by seed-and-extend along diagonals.

A run of period q is a stretch in which words q apart are identical, of at least max(6, 4q) words: on the diagonal of
lag q at least max(6 - q, 3q) places match. Lags are taken in classes [2**t, 2**(t+1)). The least overlap that a class
guarantees is the length of its seeds, the k-grams of that many words: 5, 6, 12, 24, ... A k-gram of the next class
begins with one of this class, so only k-grams that occur again in their document live on, and each class joins two
numbers of the class before to one: k-grams are compared exactly, not by hashes.

A seed is a pair of occurrences of a k-gram in one document whose lag is of the class. Pairs of neighbouring
occurrences are enough, and there are no more of them than words: a k-gram is no shorter than the lag, so if it came
again within less than a run's period, the run would have a smaller period. A table keeps, for each lag, how far its
diagonal is covered; a seed within that is passed over, any other is extended to both sides as far as words match.

A document is a row, so the work is a narrow map over the table, without a shuffle and without a hot key.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Characters of texts that are gone through together; a longer text is gone through by itself.
BLOCK_CHARS = 4_000_000


class _Numbers(dict):
    """Numbers for words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def overlap(lag: int) -> int:
    """Matching places that a run of this period has at least on its diagonal."""
    return max(LEAST_WORDS, LEAST_PERIODS * lag) - lag


def classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(k, first lag, last lag) of each class whose runs fit into ``longest`` words."""
    low = 1
    while LEAST_PERIODS * low <= longest:
        yield min(overlap(q) for q in (low, min(low + 1, 2 * low - 1))), low, 2 * low - 1
        low *= 2


def _again(keys: np.ndarray, places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, place) of the keys that occur more than once, and (earlier, later) places of neighbouring occurrences.

    A place takes ``bits`` bits; key and place are sorted as one number.
    """
    if len(keys) and int(keys.max()) >> (62 - bits):
        keys = np.unique(keys, return_inverse=True)[1]
    both = np.sort(keys << bits | places)
    keys, places = both >> bits, both & ((1 << bits) - 1)
    new = keys[1:] != keys[:-1]
    alive = np.zeros(len(keys), bool)
    alive[1:] |= ~new
    alive[:-1] |= ~new
    numbers = np.concatenate(([0], np.cumsum(new)))[: len(keys)]
    return numbers[alive], places[alive], places[:-1][~new], places[1:][~new]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key for each pair of numbers, both below 2**31."""
    return a * (int(b.max(initial=0)) + 1) + b


def _matching(words: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many places match from (a, b) on in the direction of step (1 or -1), ``most`` at most."""
    done, size = 0, 64
    while done < most:
        n = min(size, most - done)
        left, right = (words[a + done : a + done + n], words[b + done : b + done + n]) if step > 0 else (words[a - done - n + 1 : a - done + 1][::-1], words[b - done - n + 1 : b - done + 1][::-1])
        differ = left != right
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, size = done + n, size * 4
    return most


def runs(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start and then period, of documents that lie one after the other in ``words``.

    ``ends`` has where each document ends. Starts are places in ``words``.
    """
    if not len(words):
        return []
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), sizes)
    doc_end, doc_start = np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)
    bits = len(words).bit_length()
    table: dict[tuple[int, int], int] = {}  # (document, lag): how far the diagonal is covered
    found: list[tuple[int, int, int]] = []
    k, numbers, places = 0, None, None
    for need, low, high in classes(int(sizes.max())):
        if numbers is None:
            places = np.flatnonzero(np.arange(len(words)) + need <= doc_end)
            numbers = doc[places]  # k-grams of different documents are never equal
            for i in range(need):  # what does not come again now can't do so with more words
                numbers, places, earlier, after = _again(_joined(numbers, words[places + i]), places, bits)
        elif need > k:
            where = np.full(len(words) + need, -1)
            where[places] = numbers
            second = where[places + need - k]  # the k-gram that ends where the longer one ends
            both = (second >= 0) & (places + need <= doc_end[places])
            numbers, places, earlier, after = _again(_joined(numbers[both], second[both]), places[both], bits)
        k = need
        if not len(places):
            break
        lags = after - earlier
        fits = (lags >= low) & (lags <= high)
        earlier, lags = earlier[fits], lags[fits]
        order = np.lexsort((earlier, lags))
        earlier, lags = earlier[order], lags[order]
        new = np.ones(len(earlier), bool)
        new[1:] = (lags[1:] != lags[:-1]) | (earlier[1:] != earlier[:-1] + 1) | (doc_start[earlier[1:]] != doc_start[earlier[:-1]])
        for at, lag in zip(earlier[new].tolist(), lags[new].tolist()):
            begin, end = int(doc_start[at]), int(doc_end[at])
            if at < table.get((begin, lag), -1):
                continue
            right = at + _matching(words, at, at + lag, end - lag - at, 1)  # the first place that does not match
            left = at - _matching(words, at - 1, at - 1 + lag, at - begin, -1) if at > begin else at
            table[begin, lag] = right
            if right + lag - left >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((left, right + lag - left, lag))
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def edited(numbers: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of the query's contract: for a tenth of the ids, words from a place on repeat with a period."""
    n = len(numbers)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return numbers
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = numbers.copy()
    out[a:] = numbers[a + np.arange(n - a) % p]
    return out


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _facts(found: list[tuple[int, int, int]], numbers: np.ndarray, names: list[bytes]) -> tuple[tuple, bytes]:
    """What is returned of a document's runs, and its words without the repetitions, joined by spaces."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = None
    for s, n, q in found:  # by start, then period: only a greater exponent wins
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    if found:
        depth = np.zeros(len(numbers) + 1, np.int64)
        for s, n, q in found:
            depth[s + q] += 1
            depth[s + n] -= 1
        numbers = numbers[np.cumsum(depth[:-1]) == 0]
    collapsed = b" ".join([names[i] for i in numbers.tolist()])
    four = (None,) * 4 if best is None else (*best, best[1] * 1000 // best[2])
    return (len(found), *four, hashlib.sha256(listed.encode()).hexdigest()), collapsed


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > BLOCK_CHARS:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if texts:
        yield slice(begin, len(texts))


def collapse(docs: DataFrame, with_edits: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id and COLUMNS for each row of (doc_id, text), and with ``with_text`` the text without repetitions.

    Words are what ASCII white space parts. A null text has no words, an empty or blank one neither: no runs, and the
    digests of nothing. Rows that repeat, and null ids, are rows like any other; an empty table gives no rows; other
    columns are not read, so their names can't clash. A text of any length is gone through whole, in memory in
    proportion to it. ``with_edits`` first changes words as ``edited`` says; a null id has no edit.
    """

    from_id = docs.schema["doc_id"].dataType
    schema = f"doc_id {from_id.simpleString()}, {COLUMNS}" + (", collapsed string" if with_text else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for part in _blocks(texts):
                yield one(ids[part.start : part.stop], texts[part])

    def one(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        known = _Numbers()
        documents = []
        for doc, text in zip(ids.to_pylist(), texts):
            words = text.encode().split() if text else []  # bytes are split at ASCII white space only
            numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            documents.append(edited(numbers, doc) if with_edits else numbers)
        names = list(known)
        ends = np.cumsum([len(w) for w in documents], dtype=np.int64)
        found = runs(np.concatenate(documents), ends)
        at, rows = 0, []
        for numbers, end in zip(documents, ends.tolist()):
            own, begin = [], end - len(numbers)
            while at < len(found) and found[at][0] < end:
                own.append((found[at][0] - begin, *found[at][1:]))
                at += 1
            facts, text = _facts(own, numbers, names)
            rows.append((*facts, hashlib.sha256(text).hexdigest(), text.decode()))
        kinds = [pa.int64()] * 5 + [pa.string()] * (3 if with_text else 2)
        columns = [ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
        return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in schema.split(", ")])

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(task, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(common.table(spark, sf_dir, "documents"), with_edits=True)
