"""Exact removal of repeated byte strings by hash-compared suffix sorts.

A byte goes if a string of ``width`` bytes that covers it also starts in a document with a smaller doc_id. Equal
strings share their minimizer (the least hash of their ``gram``-byte strings), so strings are looked for by it:

1. Documents are dealt into batches by a hash of the id and text, one exchange that all later steps use. A batch sends
   each partition of the minimizers those that it has, once each, without saying which documents have them: four bytes
   for a minimizer. The partition sends back what more than one batch has.
2. Stretches of text whose windows have a minimizer that another batch, or another document of the batch, has too are
   dealt out by it, and each task sorts the suffixes at these windows. Prefix polynomial hashes and a binary search give
   the common extension of two suffixes, so that a comparison takes a logarithm of the width; a bottom-up mergesort makes
   all comparisons of a level at once. Windows whose hash no other document of the chunk has need no place in the order.
   Equal neighbours are compared byte by byte; after a collision the task's suffixes are sorted by their bytes.
3. The spans found go back to the documents.

A document whose whole text is that of one with a smaller doc_id (by SHA-256) goes as a whole and is not looked up further.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 50
GRAM = 20
#: Text of a batch, of what numpy looks at together, of an exchange's partition, and for each partition of the minimizers.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 18
TASK_BYTES = 24 << 20
PART_BYTES = 24 << 20
#: Partitions of the minimizers share tasks beyond this many.
MOST_TASKS = 20_000
#: Windows that a task sorts at a time; a group of more is gone through in several goes.
CHUNK_WINDOWS = 60_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least; a worker keeps the longest tables so far."""

    def up(base: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0], have, step = 1, 1, base
        while have < n:  # step is base**have
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(step)
            have, step = have + more, step * step & _MASK
        return out

    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES[:] = [up(_BASE), up(pow(_BASE, -1, 1 << 64))]
    return _TABLES[0], _TABLES[1]


class Prefixes:
    """Prefix polynomial hashes of bytes: the hash of any stretch in constant time."""

    def __init__(self, text: np.ndarray):
        self.text = text
        powers, self.inverse = _powers(max(1 << 16, len(text) + 1))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[: len(text)], out=self.sums[1:])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        """A mixed hash of the k bytes at each position."""
        n = max(0, len(self.text) - k + 1)
        x = (self.sums[k : k + n] - self.sums[:n]) * self.inverse[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    have = 1
    while have * 2 <= w:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def stretches(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, number of windows, minimizer) of the longest stretches of windows with one minimizer."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(texts), np.uint8)
    if len(text) < width:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    least = _least(Prefixes(text).grams(gram), width - gram + 1)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    at = np.arange(len(least)) - starts[doc]
    ok = at + width <= sizes[doc]  # windows within their document
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(first)
    number = np.add.reduceat(ok, begin) if len(begin) else np.empty(0, np.int64)
    return doc[begin], at[begin], number.astype(np.int64), least[begin]


def _compare(p: Prefixes, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for the suffixes at a and b of lengths la and lb: the common extension by binary search over hashes."""
    both = np.minimum(la, lb)
    out = np.sign(la - lb)
    odd = np.flatnonzero(p.hash(a, both) != p.hash(b, both))
    if len(odd):
        x, y, low, high = a[odd], b[odd], np.zeros(len(odd), np.int64), both[odd] - 1
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = p.hash(x, middle) == p.hash(y, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        out[odd] = np.sign(p.text[x + low].astype(np.int64) - p.text[y + low])
    return out


def suffix_sort(p: Prefixes, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the suffixes within each group: mergesort, a level at a time for all groups."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
    size = np.diff(np.append(edge, len(g)))
    left, end = np.repeat(edge, size), np.repeat(edge + size, size)
    run = 1
    while run < size.max(initial=0):
        i = np.flatnonzero(end - left > run)
        block = left[i] + (i - left[i]) // (2 * run) * (2 * run)
        middle = np.minimum(block + run, end[i])
        is_left = i < middle
        low = first = np.where(is_left, middle, block)
        high = np.where(is_left, np.minimum(block + 2 * run, end[i]), middle)
        mine = order[i]
        while len(live := np.flatnonzero(low < high)):
            m = (low[live] + high[live]) >> 1
            a, b = order[m], mine[live]
            c = _compare(p, starts[a], starts[b], lengths[a], lengths[b])
            ahead = np.where(is_left[live], c < 0, c <= 0)
            low, high = low.copy(), high.copy()
            low[live[ahead]], high[live[~ahead]] = m[ahead] + 1, m[~ahead]
        own = i - np.where(is_left, block, middle)
        order[block + own + (low - first)] = mine
        run *= 2
    return order


def equal_runs(p: Prefixes, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the class along the order): suffixes of a group with the same bytes have the same class."""
    order = suffix_sort(p, starts, lengths, group)
    a, b = order[:-1], order[1:]
    same = (group[a] == group[b]) & (lengths[a] == lengths[b])
    same &= p.hash(starts[a], lengths[a]) == p.hash(starts[b], lengths[b])
    pairs = np.flatnonzero(same)
    for at in range(0, len(pairs), 20_000):  # collision verification, byte by byte
        x, y = a[pairs[at : at + 20_000]], b[pairs[at : at + 20_000]]
        n = lengths[x]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (p.text[np.repeat(starts[x], n) + inside] != p.text[np.repeat(starts[y], n) + inside]).any():
            data = p.text.tobytes()
            keys = [(g, data[s : s + k]) for g, s, k in zip(group.tolist(), starts.tolist(), lengths.tolist())]
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
            same = np.array([keys[i] == keys[j] for i, j in zip(order[:-1], order[1:])], bool)
            break
    return order, np.concatenate(([0], np.cumsum(~same))) if len(order) else order


def _classes(p: Prefixes, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representative, least doc) of each suffix: those of a group with the same bytes have the same representative.

    Suffixes whose hash is met once, or in one doc only, are their own representatives and are not sorted.
    """
    n = len(starts)
    lead, least = np.arange(n), doc.copy()
    if not n:
        return lead, least
    _, of = np.unique(p.hash(starts, lengths), return_inverse=True)
    low, high = np.full(of.max() + 1, np.iinfo(np.int64).max), np.full(of.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, of, doc)
    np.maximum.at(high, of, doc)
    some = np.flatnonzero((low < high)[of])
    if len(some):
        order, number = equal_runs(p, starts[some], lengths[some], group[some])
        order = some[order]
        edge = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        lead[order] = order[edge][number]
        least[order] = np.minimum.reduceat(doc[order], edge)[number]
    return lead, least


def earlier(segments: list[bytes], key: np.ndarray, doc: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, Prefixes, np.ndarray]:
    """For the windows of all stretches in turn: (stretch, least doc with the same window, prefixes, window starts)."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    offset = np.cumsum(sizes) - sizes
    p = Prefixes(np.frombuffer(b"".join(segments), np.uint8))
    group = np.unique(key, return_inverse=True)[1]
    lead, least = _classes(p, offset, sizes, group, doc)  # equal stretches are one from here on
    own = np.flatnonzero(lead == np.arange(len(lead)))
    n = sizes - width + 1
    base = np.zeros(len(segments), np.int64)
    base[own] = np.cumsum(n[own]) - n[own]
    which = np.repeat(own, n[own])
    start = offset[which] + np.arange(len(which)) - base[which]
    grams = p.grams(gram)
    owner = np.repeat(np.arange(len(segments)), sizes)[: len(grams)]
    anchors = np.flatnonzero(grams.view(np.int64) == key[owner])
    offset_in = anchors[np.searchsorted(anchors, start)] - start  # equal windows have their minimizer in the same place
    found = _classes(p, start, np.full(len(start), width), group[which] * width + offset_in, least[which])[1]
    member = np.repeat(np.arange(len(segments)), n)
    inside = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    return member, found[base[lead[member]] + inside], p, offset[member] + inside


def _spans(mark: np.ndarray, member: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, start, end) of the bytes that marked windows cover, windows in a row taken together."""
    i = np.flatnonzero(mark)
    if not len(i):
        return i, i, i
    new = np.concatenate(([True], (np.diff(i) > 1) | (member[i[1:]] != member[i[:-1]])))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(i) - 1]))
    return member[i[new]], at[i[new]], at[i[last]] + width


class Seen:
    """The windows so far of a group that goes on over several chunks, byte for byte, with the least doc of each."""

    def __init__(self, key: int, names: np.ndarray, least: np.ndarray):
        self.key = key
        self.names, self.least = self._reduced(names, least)

    @staticmethod
    def _reduced(names: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, of = np.unique(names, return_inverse=True)
        out = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(out, of, least)
        return names, out

    def add(self, names: np.ndarray, least: np.ndarray) -> None:
        self.names, self.least = self._reduced(np.concatenate([self.names, names]), np.concatenate([self.least, least]))

    def lower(self, names: np.ndarray, least: np.ndarray) -> np.ndarray:
        """least, where an earlier chunk has the window for a smaller doc that one."""
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, np.minimum(least, self.least[at]), least)


def _distinct(p: Prefixes, start: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as byte strings, least doc of each, which of them each window is).

    Windows of one hash are one if their bytes are; should they ever differ, all windows are given as they are. A last
    byte of 1 keeps zeros at a window's end.
    """

    def text(at: np.ndarray) -> np.ndarray:
        out = np.ones((len(at), width + 1), np.uint8)
        out[:, :width] = p.text[at[:, None] + np.arange(width)]
        return out

    _, first, of = np.unique(p.hash(start, width), return_index=True, return_inverse=True)
    own = text(start[first])
    if not all((text(start[i : i + 50_000]) == own[of[i : i + 50_000]]).all() for i in range(0, len(start), 50_000)):
        own, of, first = text(start), np.arange(len(start)), np.arange(len(start))
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, of, least)
    return own.reshape(-1).view(f"S{width + 1}"), low, of


def _in_slices(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """stretches() of the texts, looked at about SLICE_BYTES at a time, a long text in pieces that overlap."""
    found, pieces, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        doc, at, number, least = stretches(pieces, width, gram)
        who, begin = np.array(held, np.int64).reshape(-1, 2).T
        found.append((who[doc], at + begin[doc], number, least))
        pieces.clear()
        held.clear()
        size = 0

    for d, text in enumerate(texts):
        for a in range(0, max(1, len(text) - width + 1), SLICE_BYTES):
            pieces.append(text[a : a + SLICE_BYTES + width - 1])
            held.append((d, a))
            size += len(pieces[-1])
            if size >= SLICE_BYTES:
                flush()
    if pieces:
        flush()
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty, np.zeros(0, np.uint64))


def _bytes_of(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def minimizer_entries(texts: list[bytes], parts: int, width: int, gram: int) -> Iterator[tuple[int, bytes]]:
    """(partition, minimizers as unsigned 32-bit numbers) of a batch: each minimizer once."""
    slot = np.unique(_slots(_in_slices(texts, width, gram)[3], parts))
    part = (slot >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
        yield int(part[a]), (slot[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def _slots(least: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a minimizer in the upper 32 bits, what it is called there in the lower ones."""
    return least % np.uint64(parts) << np.uint64(32) | (least // np.uint64(parts)) & np.uint64(0xFFFFFFFF)


def repeated_spans(rows: DataFrame, base: DataFrame, doc_id: str, text: str, batches: int, total: int, width: int, gram: int, part_bytes: int, windows: int) -> DataFrame:
    """(batch, doc_id, rid, begin, end) of the bytes to remove, for rows with a batch and a rid, which
    tells texts of a doc_id apart; base is rows dealt out by batch."""
    parts = max(1, base.sparkSession.sparkContext.defaultParallelism, math.ceil(total / part_bytes))
    tasks = min(parts, MOST_TASKS)
    hashed = rows.where(F.octet_length(text) >= width).where(F.col(doc_id).isNotNull()).select("batch", F.col(doc_id).cast("long").alias("doc_id"), "rid", F.sha2(F.encode(text, "UTF-8"), 256).alias("h"))
    whole = hashed.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    copies = common.keep(hashed.join(whole, "h").where("doc_id > least").select("batch", "doc_id", "rid").distinct())
    text_at = base.columns.index(text)

    def entries(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, batch = [], None

        def out() -> pa.RecordBatch:
            rows = list(minimizer_entries(held, parts, width, gram))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([batch] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "batch", "slots"])

        for frame in frames:
            number = frame.column(frame.schema.get_field_index("batch")).to_numpy()
            data = frame.column(text_at).cast(pa.binary())
            for b, t in zip(number.tolist(), data.to_pylist()):
                if b != batch:
                    if held:
                        yield out()
                    held, batch = [], b
                if t and len(t) >= width:
                    held.append(t)
        if held:
            yield out()

    def between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in common.groups(frames, "part"):
            slot = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["slots"]])
            row = np.repeat(np.arange(len(pdf), dtype=np.uint32), [len(x) // 4 for x in pdf["slots"]])
            order = np.argsort(slot, kind="stable")
            slot, row = slot[order], row[order]
            del order
            same = slot[1:] == slot[:-1]
            shared = np.append(same, False) | np.append(False, same)
            slot, row = slot[shared], row[shared]
            order = np.argsort(row, kind="stable")
            slot, row = slot[order].astype(np.int64) | (int(pdf["part"].iloc[0]) << 32), row[order]
            edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
            rows = [(pdf["batch"].iloc[int(row[a])], slot[a:b].tobytes()) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(row)])]
            if rows:
                yield pd.DataFrame(rows, columns=["batch", "slots"])

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        live, gone = [], set()
        for slots, d, r in zip(right["slots"].to_pylist(), right["doc_id"].to_pylist(), right["rid"].to_pylist()):
            live.append(np.frombuffer(slots, np.uint64)) if slots is not None else gone.add((d, r))
        rows, seen = [], gone
        for i, who in enumerate(zip(left[doc_id].cast(pa.int64()).to_pylist(), left["rid"].to_pylist())):
            if who[0] is not None and who not in seen:
                rows.append(i)
                seen.add(who)  # rows of equal id and text are looked at once
        some = left.take(pa.array(rows, pa.int64()))
        texts = _bytes_of(some[text])
        doc, start, number, least = _in_slices(texts, width, gram)
        slot = _slots(least, parts)
        order = np.lexsort((doc, slot))
        first = np.concatenate(([True], slot[order][1:] != slot[order][:-1])) if len(order) else np.zeros(0, bool)
        edge = np.flatnonzero(first)
        several = doc[order][edge] != doc[order][np.append(edge[1:], len(order)) - 1] if len(edge) else np.zeros(0, bool)
        keep = np.zeros(len(doc), bool)
        keep[order] = several[np.cumsum(first) - 1] if len(edge) else False
        if live:
            keep |= np.isin(slot, np.concatenate(live))
        i = np.flatnonzero(keep)
        ids, rids = _longs(some[doc_id].cast(pa.int64())), _longs(some["rid"])
        cut = [texts[d][s : s + k] for d, s, k in zip(doc[i].tolist(), start[i].tolist(), (number[i] + width - 1).tolist())]
        return pa.table({"key": least[i].view(np.int64), "doc_id": ids[doc[i]], "rid": rids[doc[i]], "at": start[i], "segment": pa.array(cut, pa.binary())})

    def sort_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Seen | None = None

        def done(pdf: pd.DataFrame, goes_on: bool) -> pd.DataFrame:
            nonlocal seen
            key, ids = pdf["key"].to_numpy(), pdf["doc_id"].to_numpy()
            member, least, p, start = earlier(list(pdf["segment"]), key, ids, width, gram)
            if seen is not None and seen.key != key[0]:
                seen = None
            if seen is not None:
                hot = np.flatnonzero(key[member] == seen.key)
                names, low, of = _distinct(p, start[hot], least[hot], width)
                least[hot] = np.minimum(least[hot], seen.lower(names, low)[of])
            if goes_on:
                hot = np.flatnonzero(key[member] == key[-1])
                names, low, _ = _distinct(p, start[hot], least[hot], width)
                if seen is not None and seen.key == key[-1]:
                    seen.add(names, low)
                else:
                    seen = Seen(key[-1], names, low)
            else:
                seen = None
            offset = np.concatenate(([0], np.cumsum(pdf["segment"].map(len).to_numpy())))
            who, begin, end = _spans(least < ids[member], member, start - offset[member] + pdf["at"].to_numpy()[member], width)
            return pd.DataFrame({"doc_id": ids[who], "rid": pdf["rid"].to_numpy()[who], "begin": begin, "end": end})

        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) and (number := (held["segment"].map(len) - width + 1).cumsum().to_numpy())[-1] > windows:
                key = held["key"].to_numpy()
                cut = max(1, int(np.searchsorted(number, windows, "right")))
                own = int(np.searchsorted(key, key[min(cut, len(key) - 1)]))
                goes_on = own == 0
                cut = cut if goes_on else own
                yield done(held.iloc[:cut].reset_index(drop=True), goes_on)
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield done(held, False)

    sent = base.sortWithinPartitions("batch").mapInArrow(entries, "part int, batch long, slots binary")
    sent = sent.repartitionById(tasks, F.pmod("part", F.lit(tasks)))
    if parts > tasks:
        sent = sent.sortWithinPartitions("part")
    live = sent.mapInPandas(between, "batch long, slots binary")
    none = F.lit(None).cast("long")
    notes = live.select("batch", "slots", none.alias("doc_id"), none.alias("rid")).union(copies.select("batch", F.lit(None).cast("binary"), "doc_id", "rid"))
    segments = base.groupBy("batch").cogroup(notes.groupBy("batch")).applyInArrow(cut_out, "key long, doc_id long, rid long, at long, segment binary")
    sorted_ = segments.repartition("key").sortWithinPartitions("key", "doc_id", "rid", "at")
    found = sorted_.mapInPandas(sort_groups, "doc_id long, rid long, begin long, end long")
    found = found.select(_batch(F.col("doc_id"), batches).alias("batch"), "doc_id", "rid", "begin", "end")
    return found.union(copies.select("batch", "doc_id", "rid", F.lit(0).cast("long"), F.lit(1 << 62)))


def _batch(doc_id, batches: int):
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.col("rid")), F.lit(batches)).cast("long")


def _kept(data: bytes, spans: np.ndarray, width: int) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, runs removed)."""
    if not len(spans) or len(data) < width:
        return data, 0, 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    spans[:, 1] = np.minimum(spans[:, 1], len(data))
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    start, end = spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]
    out, at = [], 0
    for a, b in zip(start.tolist(), end.tolist()):
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out), int((end - start).sum()), len(start)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES, windows: int = CHUNK_WINDOWS) -> DataFrame:
    """(c0, c1, ..., n_bytes, n_removed, n_spans, kept, kept_text) for each row: c0 and so on are the columns of docs.

    ``kept`` has the bytes that remain; ``kept_text`` is these as text, without characters that lost a part. A null
    text is an empty one. A row without a doc_id keeps all bytes and takes none from others. Rows of equal doc_id
    take none from one another. Extra columns come through as they are, whatever their names; an empty table gives an
    empty one.
    """
    common.small_batches(docs.sparkSession)
    own = common.numbered(docs)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    total = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, math.ceil(total / batch_bytes))
    partitions = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    base = own.withColumn("rid", F.xxhash64(doc_id, text))
    base = base.withColumn("batch", _batch(F.col(doc_id), batches))
    rows, base = base, base.repartition(partitions, "batch")
    spans = repeated_spans(rows, base, doc_id, text, batches, total, width, gram, part_bytes, windows)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        where: dict[tuple[int, int], list[int]] = {}
        for i, who in enumerate(zip(right["doc_id"].to_pylist(), right["rid"].to_pylist())):
            where.setdefault(who, []).append(i)
        found = np.stack([_longs(right["begin"]), _longs(right["end"])], 1)
        nothing = np.zeros((0, 2), np.int64)
        facts = []
        for who in zip(left[doc_id].cast(pa.int64()).to_pylist(), left["rid"].to_pylist(), _bytes_of(left[text])):
            data = who[2]
            at = where.get(who[:2])
            kept, removed, number = _kept(data, found[at] if at else nothing, width)
            facts.append((len(data), removed, number, kept, kept.decode("utf-8", "ignore")))
        out = left.drop_columns(["rid", "batch"])
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "kept_text": pa.string()}
        for i, (name, kind) in enumerate(kinds.items()):
            out = out.append_column(name, pa.array([f[i] for f in facts], kind))
        return out

    schema = common.ddl(own) + ", n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"
    return base.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(task, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs)
    return done.select(F.col("c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
