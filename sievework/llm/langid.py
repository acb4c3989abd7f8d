"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths run over a fixed-length window, each filter keeps its largest
response, and a softmax over these gives the language. A text is cut into windows that cover all of it; its
language is the one with the largest mean probability over the windows (weighted by their bytes).

For prediction the embedding and the filters are multiplied out: a response is a sum over bytes of a table row, and
two neighbouring bytes share one row of a table of 65,536. That is the same network, with look-ups for products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: The fit sees at most this many texts of a language, and this many bytes of each.
SAMPLE_TEXTS = 400
SAMPLE_BYTES = 1024
EPOCHS = 12
SEED = 7

_LETTER = regex.compile(r"\p{L}")


def _windows(data: bytes) -> np.ndarray:
    """All of the bytes in rows of WINDOW, the last one filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    """Parameters: embedding (256, e), kernels (widest, e, filters; zero beyond a filter's width), bias, softmax layer."""

    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]

    def pair_tables(self) -> np.ndarray:
        """(2, 65536, filters): responses of the first two and the last two positions of the widest filter."""
        single = np.einsum("ve,wef->wvf", self.embedding, self.kernel).astype(np.float32)  # position, byte, filter
        pairs = single[0::2, None, :, :] + single[1::2, :, None, :]  # a pair read as a little-endian number: high byte second
        return np.ascontiguousarray(pairs.reshape(2, 65536, -1))

    def probabilities(self, windows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64].astype(np.uint16)
            pair = x[:, :-1] | x[:, 1:] << np.uint16(8)
            response = np.take(tables[0], pair[:, :-2], axis=0)
            response += np.take(tables[1], pair[:, 2:], axis=0)
            held = np.maximum(response.max(1) + self.bias, 0)
            z = held @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 64] = z / z.sum(1, keepdims=True)
        return out


def train(texts: Sequence[bytes], labels: Sequence[str], seed: int = SEED) -> Network | None:
    """Fit by Adam on the windows of the texts; the same samples give the same network. None without samples."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    x = np.concatenate([w := _windows(t) for t in texts])
    y = np.repeat([languages.index(l) for l in labels], [len(_windows(t)) for t in texts])
    widest, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    live = np.concatenate([np.repeat((np.arange(widest) < w)[:, None], FILTERS, 1) for w in WIDTHS], 1)[:, None, :]
    p = [rng.normal(0, 0.5, (256, EMBEDDING)), rng.normal(0, 0.3, (widest, EMBEDDING, n_filters)) * live, np.zeros(n_filters), rng.normal(0, 0.3, (n_filters, len(languages))), np.zeros(len(languages))]
    p = [a.astype(np.float32) for a in p]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    turn = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            b, t = x[some], y[some]
            e, k, bias, out, out_bias = p
            n = WINDOW - widest + 1
            columns = np.stack([e[b[:, j : j + n]] for j in range(widest)], 2).reshape(len(b), n, -1)
            response = columns @ k.reshape(-1, n_filters)
            best = response.argmax(1)
            top = np.take_along_axis(response, best[:, None], 1)[:, 0] + bias
            held = np.maximum(top, 0)
            z = held @ out + out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(t)), t] -= 1
            z /= len(t)
            d_held = z @ out.T * (top > 0)
            g_k, g_e = np.zeros_like(k), np.zeros_like(e)
            rows = np.arange(len(b))[:, None]
            for j in range(widest):
                seen = b[rows, best + j]  # the byte under position j of each filter's best response
                g_k[j] = np.einsum("bfe,bf->ef", e[seen], d_held)
                np.add.at(g_e, seen, d_held[:, :, None] * k[j].T[None])
            grads = [g_e, g_k * live, d_held.sum(0), held.T @ z, z.sum(0)]
            turn += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] -= 0.005 * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.999**turn)) + 1e-8)
    return Network(*p, languages)


def held_out():
    """Rows that a fit must not see."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2


def sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES) -> tuple[list[bytes], list[str]]:
    """At most ``texts`` texts of each language that is given, by the hash of the id, with ``size`` bytes of each.

    Only rows with text and lang that are not held out. Languages with fewer rows give all of them. Rows that are
    repeated count once, however many they are.
    """
    rows = docs.where("text is not null and lang is not null").where(~F.coalesce(held_out(), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    place = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * texts / n + 20 / n))])
    start = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id")), F.greatest(F.length("text") - size, F.lit(1))) + 1
    part = F.substring("text", start.cast("int"), F.lit(size))
    some = rows.select("doc_id", "lang", place.alias("place"), part.alias("part")).where(F.col("place") < share[F.col("lang")])
    got = some.groupBy("lang", "place").agg(F.min("doc_id").alias("doc_id"), F.min("part").alias("part")).collect()
    out, used = [], dict.fromkeys(counts, 0)
    for r in sorted(got, key=lambda r: (r["place"], str(r["doc_id"]), r["part"])):
        data = r["part"].encode()[:size]
        if used[r["lang"]] < texts and _LETTER.search(r["part"]):
            used[r["lang"]] += 1
            out.append((data, r["lang"]))
    return [a for a, _ in out], [b for _, b in out]


def fit(docs: DataFrame) -> Network | None:
    return train(*sample(docs))


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """(c0, c1, ..., lang_pred, score) for each row, over whole texts: c0 and so on are the columns of docs.

    A text that is null or without a letter is ``und`` with score 0, and so is every text where nothing was learned. Rows
    that are repeated are rows like any other; an empty table gives none.
    """
    common.small_batches(docs.sparkSession)
    own, at_text = common.numbered(docs), f"c{docs.columns.index('text')}"
    tables = network.pair_tables() if network is not None else None
    shared = docs.sparkSession.sparkContext.broadcast((network and vars(network), tables))  # about 12 MB, whatever the input

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tables = shared.value
        net = Network(**held) if held else None
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                texts = [t if t is not None and _LETTER.search(t) else None for t in part[at_text]]
                lang, score = [UNDETERMINED] * len(part), [0.0] * len(part)
                live = [i for i, t in enumerate(texts) if t is not None] if net else []
                if live:
                    data = [texts[i].encode() for i in live]
                    windows = [_windows(d) for d in data]
                    p = net.probabilities(np.concatenate(windows), tables)
                    size = np.concatenate([[WINDOW] * (len(w) - 1) + [len(d) - WINDOW * (len(w) - 1)] for w, d in zip(windows, data)])
                    edges = np.cumsum([0, *map(len, windows)][:-1])
                    mean = np.add.reduceat(p * size[:, None], edges, axis=0) / np.array([len(d) for d in data])[:, None]
                    for i, row in zip(live, mean):
                        lang[i], score[i] = net.languages[int(row.argmax())], float(min(1.0, row.max()))
                yield part.assign(lang_pred=lang, score=score)

    return own.mapInPandas(task, common.ddl(own) + ", lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs)).withColumnRenamed("c0", "doc_id")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
