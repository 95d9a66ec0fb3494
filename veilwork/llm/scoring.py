"""Language-model scores by deleted interpolation of word pairs, words and a uniform share.

The chance of a word after another is ``a * c(pair) / c(first) + b * c(word) / N
+ c / (V + 1)``.  The three weights depend on how often the first word occurs
(by powers of two) and are learned by expectation-maximisation on held-out
counts: a fifth of the training texts is deleted from the counts for that, and
counted again afterwards.

All counts are exact and cover all training texts.  Tasks turn their texts into
blocks of a bounded number of words; a block asks for the counts of its distinct
words and pairs (64 and 56 bits of a hash, which no two words or pairs of a
corpus share but by a chance below 1e-4), packed per bucket of the hash range.
Each bucket is one group: it adds what the blocks brought and answers each of
them, so a frequent word costs one number per block, and no table of counts is
ever gathered or sent to all.  The number of buckets follows the size of the
texts.  For the weights only a table of bounded size (context class and two
chances in quarter powers of two, with how many words) reaches the driver.

Defined results: NULL and empty texts are one end token; repeated rows count as
often as they occur; a NULL id counts as a training text; without training texts
all counts are 0; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Workspace, held_out, read
from .words import combine, pieces

FOLDS, FOLD = 7, 2
#: Of the training texts, those with this remainder of the spread id are deleted for learning the weights.
DELETED_FOLDS = 5
BLOCK_WORDS = 1 << 20
BUCKET_BYTES = 1 << 24
STEPS_PER_OCTAVE = 4
ROUNDS = 40

_END, _START = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_TEST, _KEPT, _DELETED = 0, 1, 2
_DOCS, _WORDS, _PAIRS, _TOTALS = 0, 1, 2, 3
_ROW = "slot long, block long, kind int, fold int, data binary, keys array<long>"
_CLASSES, _CHANCES = 48, 256
_HEAD = struct.Struct("<QB")


def pack(values: np.ndarray, squeeze: bool = True) -> bytes:
    """Unsigned integers at the least number of bytes, byte by byte (all lowest ones first)."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return _HEAD.pack(len(values), width | (squeeze << 7)) + (zlib.compress(planes, 1) if squeeze else planes)


def unpack(data: bytes) -> np.ndarray:
    n, width = _HEAD.unpack_from(data)
    planes = memoryview(data)[_HEAD.size:]
    if width >> 7:
        planes, width = zlib.decompress(planes), width & 127
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _frames(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def _unframe(data: bytes, n: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{n}Q", data)
    at = np.concatenate([[8 * n], 8 * n + np.cumsum(sizes)])
    return [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:])]


def _sorted_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), squeeze=False)


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _pairs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """56-bit hashes of each token with the one before it in its text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = _START
    return combine(before, words) >> np.uint64(8)


@dataclass
class _Block:
    """Texts of one fold, gathered until there are enough words."""

    words: list[np.ndarray] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    keys: list[pa.Array] = field(default_factory=list)
    n: int = 0

    def rows(self, block: int, fold: int, buckets: int) -> Iterator[dict]:
        words, sizes = np.concatenate(self.words), np.concatenate(self.sizes)
        codes, distinct = pd.factorize(words)
        counts = np.bincount(codes)
        order = np.argsort(distinct)
        keys, counts = distinct[order], counts[order]
        often = np.empty(len(keys), np.int64)  # place of each distinct word in order of its count
        often[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        stream = often[place[codes]]
        yield {"slot": buckets + block, "block": block, "kind": _DOCS, "fold": fold, "keys": pa.concat_arrays(self.keys),
               "data": _frames(_sorted_keys(keys), pack(counts), pack(sizes), pack(stream))}
        asked = ((_WORDS, keys, counts, 32), (_PAIRS, *np.unique(_pairs(words, sizes), return_counts=True), 24))
        for kind, keys, counts, shift in asked:
            bucket = ((keys >> np.uint64(shift)) * np.uint64(buckets)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                yield {"slot": int(bucket[a]), "block": block, "kind": kind, "fold": fold, "keys": None,
                       "data": _frames(_sorted_keys(keys[a:b]), pack(counts[a:b]) if fold != _TEST else b"")}


def _blocks(docs: DataFrame, buckets: int, block_words: int) -> DataFrame:
    """Turn ``key, fold, text`` into blocks and what they ask for."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    names = [part.split()[0] for part in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        open_blocks = {fold: _Block() for fold in (_TEST, _KEPT, _DELETED)}

        def close(fold: int) -> Iterator[pa.RecordBatch]:
            nonlocal nth
            for row in open_blocks[fold].rows((part << 32) + nth, fold, buckets):
                keys = row["keys"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[n]], t) for n, t in zip(names[:-1], types)] +
                    [pa.array([None], types[-1]) if keys is None else
                     pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)], names=names)
            nth += 1
            open_blocks[fold] = _Block()

        for batch in batches:
            folds = batch.column(1).to_numpy()
            for piece in pieces(batch.column(2), lower=True):
                words, sizes = piece.hashes(), piece.n_words
                mine = folds[piece.rows]
                for fold in np.unique(mine):
                    use = mine == fold
                    block = open_blocks[int(fold)]
                    some = words[np.repeat(use, sizes)] if not use.all() else words
                    block.words.append(np.insert(some, np.cumsum(sizes[use]), _END))
                    block.sizes.append(sizes[use] + 1)
                    block.keys.append(batch.column(0).slice(piece.rows.start, len(piece)).filter(pa.array(use)))
                    block.n += len(block.words[-1])
                    if block.n >= block_words:
                        yield from close(int(fold))
        for fold, block in list(open_blocks.items()):
            if block.n:
                yield from close(fold)

    return docs.select("key", "fold", "text").mapInArrow(run, _ROW)


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Add up one bucket's counts and answer every block; texts pass through."""
    out = [frame[frame["kind"] == _DOCS]]
    for kind in (_WORDS, _PAIRS):
        asked = frame[frame["kind"] == kind]
        if not len(asked):
            continue
        parts = [_unframe(d, 2) for d in asked["data"]]
        keys = [_keys(p[0]) for p in parts]
        places = np.unique(np.concatenate(keys), return_inverse=True)[1]
        ends = np.cumsum([len(k) for k in keys])
        places = [places[b - len(k):b] for k, b in zip(keys, ends)]
        total = {fold: np.zeros(int(max(p.max() for p in places)) + 1, np.uint64) for fold in (_KEPT, _DELETED)}
        for fold, at, p in zip(asked["fold"], places, parts):
            if fold != _TEST:
                total[fold][at] += unpack(p[1])
        full = total[_KEPT] + total[_DELETED]
        out.append(pd.DataFrame({
            "slot": asked["slot"], "block": asked["block"], "kind": kind, "fold": asked["fold"], "keys": None,
            "data": [_frames(pack(full[at]), pack(total[_KEPT][at]) if fold == _DELETED else b"")
                     for fold, at in zip(asked["fold"], places)]}))
        if kind == _WORDS:
            sums = [int((full > 0).sum()), int(full.sum()), int(total[_KEPT].sum())]
            out.append(pd.DataFrame({"slot": asked["slot"].iloc[:1], "block": -1, "kind": _TOTALS, "fold": 0,
                                     "data": [b""], "keys": [sums]}))
    return pd.concat(out, ignore_index=True)[["slot", "block", "kind", "fold", "data", "keys"]]


@dataclass
class _Tokens:
    """Counts behind every token of a block: of its word, its pair, and the word before."""

    keys: list
    sizes: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    context: np.ndarray


def _tokens(frame: pd.DataFrame, kept: bool, n_texts: int) -> _Tokens:
    docs = frame[frame["kind"] == _DOCS].iloc[0]
    keys, counts, sizes, stream = _unframe(docs["data"], 4)
    keys, counts, sizes, stream = _keys(keys), unpack(counts).astype(np.int64), unpack(sizes).astype(np.int64), unpack(stream)
    order = np.argsort(-counts, kind="stable")
    place = order[stream.astype(np.int64)]

    def answers(kind: int) -> np.ndarray:
        rows = frame[frame["kind"] == kind].sort_values("slot")
        return np.concatenate([unpack(_unframe(d, 2)[int(kept)]) for d in rows["data"]]).astype(np.float64)

    words = keys[place]
    pair_place = np.unique(_pairs(words, sizes), return_inverse=True)[1]
    word = answers(_WORDS)[place]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(sizes) - sizes] = n_texts
    return _Tokens(list(docs["keys"]), sizes, word, answers(_PAIRS)[pair_place], context)


def _class(context: np.ndarray) -> np.ndarray:
    """Class of a context by its count: 0 if never seen, else one more than its whole power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _steps(chance: np.ndarray) -> np.ndarray:
    """Place of a chance on a logarithmic scale, 0 for none."""
    with np.errstate(divide="ignore"):
        steps = np.floor(-np.log2(chance) * STEPS_PER_OCTAVE)
    return np.where(chance > 0, np.clip(steps, 0, _CHANCES - 2) + 1, 0).astype(np.int64)


def learn_weights(cells: np.ndarray, counts: np.ndarray, uniform: float) -> np.ndarray:
    """Weights of pair, word and uniform share for each class of contexts, by expectation-maximisation."""
    kind, pair, word = cells // (_CHANCES * _CHANCES), cells // _CHANCES % _CHANCES, cells % _CHANCES

    def chance(steps: np.ndarray) -> np.ndarray:
        return np.where(steps > 0, 2.0 ** (-(steps - 0.5) / STEPS_PER_OCTAVE), 0)

    parts = np.stack([chance(pair), chance(word), np.full(len(cells), uniform)], axis=1)
    weights = np.tile([0.4, 0.5, 0.1], (_CLASSES, 1))
    weights[0] = [0, 0.9, 0.1]
    for _ in range(ROUNDS):
        share = weights[kind] * parts
        share *= (counts / share.sum(axis=1))[:, None]
        total = np.zeros((_CLASSES, 3))
        np.add.at(total, kind, share)
        seen = total.sum(axis=1) > 0
        weights[seen] = np.maximum(total[seen] / total[seen].sum(axis=1, keepdims=True), 1e-6)
        weights[0, 0] = 0
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text",
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``training`` is a condition on the columns of ``docs``; texts where it holds are learned from.
    """
    work = Workspace(docs.sparkSession, "scoring")
    fold = F.when(~training, _TEST).when(
        F.pmod(F.xxhash64(F.col(key), F.lit("deleted")), F.lit(DELETED_FOLDS)) == 0, _DELETED).otherwise(_KEPT)
    known = docs.select(F.col(key).cast("long").alias("key"), fold.alias("fold"), F.col(text).alias("text"))
    size, texts, kept_texts = known.agg(
        F.sum(F.octet_length("text")), F.count(F.when(F.col("fold") != _TEST, 1)),
        F.count(F.when(F.col("fold") == _KEPT, 1))).head()
    buckets = max(8, -(-(size or 0) // BUCKET_BYTES))
    answers = work.save(_blocks(known, buckets, block_words).groupBy("slot").applyInPandas(_answer, _ROW), "answers")
    totals = answers.where(F.col("kind") == _TOTALS).agg(
        *(F.coalesce(F.sum(F.col("keys")[i]), F.lit(0)) for i in range(3))).head()
    distinct, tokens, kept_tokens = totals
    uniform = 1 / (distinct + 1)

    def cells(frame: pd.DataFrame) -> pd.DataFrame:
        t = _tokens(frame, True, kept_texts)
        pair = np.where(t.context > 0, t.pair / np.maximum(t.context, 1), 0)
        cell = (_class(t.context) * _CHANCES + _steps(pair)) * _CHANCES + _steps(t.word / max(kept_tokens, 1))
        found, n = np.unique(cell, return_counts=True)
        return pd.DataFrame({"cell": found, "n": n})

    asked = answers.where(F.col("kind") < _TOTALS)
    table = asked.where(F.col("fold") == _DELETED).groupBy("block").applyInPandas(cells, "cell long, n long").groupBy(
        "cell").agg(F.sum("n").alias("n")).toPandas()  # at most 48 * 256 * 256 rows, however large the corpus
    weights = learn_weights(table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.float64), uniform)

    def scores(frame: pd.DataFrame) -> pd.DataFrame:
        t = _tokens(frame, False, texts)
        w = weights[_class(t.context)]
        chance = w[:, 0] * np.where(t.context > 0, t.pair / np.maximum(t.context, 1), 0)
        chance += w[:, 1] * t.word / max(tokens, 1) + w[:, 2] * uniform
        first = np.cumsum(t.sizes) - t.sizes
        return pd.DataFrame({
            "doc_id": pd.array(t.keys, dtype="Int64"), "n_tokens": t.sizes,
            "n_known": np.add.reduceat((t.word > 0).astype(np.int64), first),
            "train_tokens": tokens,
            "base_score": np.add.reduceat(np.log10((t.word + 1) / (tokens + distinct + 1)), first),
            "score": np.add.reduceat(np.log10(chance), first)})

    return asked.groupBy("block").applyInPandas(
        scores, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, ~held_out(F.col("doc_id"), FOLDS, FOLD))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


QUERIES = {"op9_deleted_interpolation": op9_deleted_interpolation}
ORACLES: dict[str, str] = {}
