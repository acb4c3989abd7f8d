"""SentencePiece encoding and decoding of whole texts, with the ids that the model itself gives.

An Aho-Corasick automaton over the pieces finds, at each position, all pieces that end there (a match and its output
links, longest first), and one pass over the text decides that position from them: Viterbi without a second scan.

* Unigram model: the best sum of scores is relaxed with each piece. A character that no piece covers costs
  ``UNKNOWN_COST`` more than the worst piece.
* BPE model: scores are the order of merges and don't add up. The segmentation of a prefix ends in the one piece that
  stays apart from the piece before it when the two are merged on their own, since a segmentation stands if and only
  if each two neighbours do. So the step from a position is open to a piece only after the piece that got there lets
  it; of the matches one is open.

Unknown characters become their byte pieces. Spaces become the mark U+2581; whether one is put before the text and
whether runs of spaces count as one is read from the model. A model with other rules (a normaliser's table, word or
character pieces, marks at the end) is refused, as its ids would not be its own.

No piece has the mark after another character, so no piece crosses the start of a marked word, and the segmentation of
a text is that of its words one after the other. A worker keeps the words that it has segmented.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Fixed values of the model format: kinds of pieces, and what an unknown character costs beyond the worst piece.
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_COST = 10.0
CACHED_WORDS = 600_000
CACHED_PAIRS = 1_000_000

_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_SPACES = re.compile(" +")


class Pieces:
    """The automaton and tables of a model: pieces as (piece, score, kind) in the order of their ids.

    prefix: a space is put before a text; squeeze: spaces at its ends go and runs of them count as one.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], cached: int = CACHED_WORDS, kind: int = UNIGRAM, prefix: bool = True, squeeze: bool = False):
        kinds = {of for _, _, of in pieces}
        if any(MARK in p.lstrip(MARK) for p, _, of in pieces if of in (NORMAL, USER_DEFINED)):
            raise ValueError("a piece has the space mark inside")
        if kind not in (UNIGRAM, BPE) or kind == BPE and kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only unigram models and BPE models without user-defined or unused pieces are known")
        self.bpe, self.prefix, self.squeeze = kind == BPE, prefix, squeeze
        self.merges = {p: s for p, s, of in pieces if of == NORMAL}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        worst = min(self.merges.values(), default=0.0)
        self.unknown, self.bytes, self.unk = worst - UNKNOWN_COST, {}, 0
        self.text: list[bytes] = []
        for i, (piece, score, kind) in enumerate(pieces):
            shown = b""
            if kind in (NORMAL, USER_DEFINED) and piece:
                if kind == USER_DEFINED:  # measured on the library: no score of its own, more than any pieces of scores below zero
                    score = 0.1 * (len(piece.encode()) - 1)
                self.automaton.add_word(piece, (len(piece), score, i))
                shown = piece.replace(MARK, " ").encode()
            elif kind == BYTE:
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                shown = bytes([value])
            elif kind == UNKNOWN:
                self.unk = i
                shown = " ⁇ ".encode()
            self.text.append(shown)
        self.automaton.make_automaton()
        self.cached, self.words = cached, {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kind = model.normalizer_spec, model.trainer_spec
        if rules.precompiled_charsmap or not rules.escape_whitespaces or kind.treat_whitespace_as_suffix:
            raise ValueError("the model has rules for texts that are not known here")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], kind=kind.model_type, prefix=rules.add_dummy_prefix, squeeze=rules.remove_extra_whitespaces)

    def merged(self, text: str) -> list[str]:
        """The merges of a BPE model on a few characters: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            found = [(-self.merges[both], i) for i in range(len(parts) - 1) if (both := parts[i] + parts[i + 1]) in self.merges]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def apart(self, before: str, piece: str) -> bool:
        """Whether a piece stays as it is after another (none: at the start of a word)."""
        found = self.pairs.get((before, piece))
        if found is None:
            found = self.merged(before + piece) == ([before, piece] if before else [piece])
            if len(self.pairs) < CACHED_PAIRS:
                self.pairs[before, piece] = found
        return found

    def _steps_of_merges(self, word: str) -> list:
        """The last step (length, id) to each position; id -1 is an unknown character."""
        last, step = [""] * (len(word) + 1), [None] * (len(word) + 1)
        matches = self.automaton.iter(word)
        found = next(matches, None)
        for end, character in enumerate(word):
            via = None
            while found is not None and found[0] == end:  # the longest first, then along the output links
                size, _, i = found[1]
                if via is None and self.apart(last[end + 1 - size], word[end + 1 - size : end + 1]):
                    via = (size, i)
                found = next(matches, None)
            step[end + 1] = via = via or (1, -1)
            last[end + 1] = word[end + 1 - via[0] : end + 1]
        return step

    def _steps_of_scores(self, word: str) -> list:
        """The same by the best sum of scores. Of equal scores the longer last piece wins."""
        n = len(word)
        best, step = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        matches = self.automaton.iter(word)
        found = next(matches, None)
        for end in range(n):
            score, via, single = best[end + 1], None, False
            while found is not None and found[0] == end:  # the longest first, then along the output links
                size, own, i = found[1]
                single |= size == 1
                if (total := best[end + 1 - size] + own) > score:
                    score, via = total, (size, i)
                found = next(matches, None)
            if not single and (total := best[end] + self.unknown) > score:
                score, via = total, (1, -1)
            best[end + 1], step[end + 1] = score, via
        return step

    def segment(self, word: str) -> list[int]:
        """The ids of one word."""
        step = self._steps_of_merges(word) if self.bpe else self._steps_of_scores(word)
        ids: list[int] = []
        at = len(word)
        while at:
            size, i = step[at]
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(word[at - 1 : at].encode())]
            else:
                ids.append(self.unk)
            at -= size
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; none for an empty text."""
        if self.squeeze:
            text = _SPACES.sub(" ", text.lstrip(" ")).rstrip(" " + MARK)
        if not text:
            return b""
        words, known = _WORD.findall(MARK * self.prefix + text.replace(" ", MARK)), self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        parts = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.segment(w), "<u4").tobytes()
                if len(known) < self.cached and len(w) <= 64:
                    known[w] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids: without the space before it; bytes that form no character become U+FFFD."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and (self.prefix or self.squeeze) else text


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces.load(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) to (doc_id, text); a null text has no ids.

    Texts are encoded whole, whatever their length; repeated rows are rows each, an empty table gives none, and other
    columns are not read.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                yield part.assign(ids=[pieces.encode(t or "") for t in part["text"]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(task, f"doc_id {kind}, text string, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, decoded) for each row of (doc_id, ids)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "decoded": [pieces.decode(x) for x in pdf["ids"]]})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInPandas(task, f"doc_id {kind}, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode in one pass: (doc_id, n_ids, ids_crc32, decoded_sha256, round_trip).

    round_trip tells whether the decoded text is the text (null: empty); it is not where a text has U+2581 itself.
    Texts are taken whole, whatever their length; repeated rows are rows each, an empty table gives none, and other
    columns are not read.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model)
        for pdf in batches:
            ids = [pieces.encode(t or "") for t in pdf["text"]]
            text = [pieces.decode(x) for x in ids]
            same = [a == (b or "") for a, b in zip(text, pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_ids": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "decoded": text, "round_trip": same})

    common.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInPandas(task, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded string, round_trip boolean")
    return found.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "round_trip")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), default_model())
