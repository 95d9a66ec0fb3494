"""SentencePiece encoding and decoding over lattices of units.

A text is cut into units wherever no piece of the model holds the two characters
at hand; that never separates a piece.  A unit's lattice has an edge for each of
its substrings, up to the longest piece, that joins the piece table; a fold over
the edges finds its pieces.  Which fold is right depends on the model:

* Unigram models have log chances as scores, and Viterbi's path has the largest
  sum.  The lattice is relational: substrings of each block's distinct units are
  exploded, joined with the piece table and grouped by unit, and the fold is one
  of Spark's higher-order functions.  Paths and texts meet by block.
* Models of merges have ranks as scores, whose sum means nothing (Viterbi agrees
  with the library on hardly any text).  There the best merge is made again and
  again, as the library does.  The same lattice is built from arrays: hashes of
  all substrings, joined by search in the sorted piece table, grouped by unit and
  folded for all units at once.  A worker keeps the ids of units it has met, up
  to ``CACHED_UNITS``, so nothing is shuffled or written in between.

Characters that are no piece become the model's byte pieces.  The piece table has
the size of the vocabulary, which bounds what is sent to tasks.

Defined results: NULL and empty texts have no ids; the character that stands for
a blank (U+2581) is read as one, so it does not survive a round trip, as in the
library; of equal paths the one with the longer last piece counts, of equal
merges the leftmost; repeated rows are encoded alike; texts of any length are
worked on in pieces, but for one text's own arrays; other columns play no part,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .tables import Workspace, arrow_map, read
from .words import PIECE_BYTES, Piece, combine, pieces

BLOCK_UNITS = 1 << 20
#: Longer units (long runs that pieces could chain through) are folded where they are met, in time about linear in
#: their length; the result is the same.
LONG_UNIT = 128
BLANK = "▁"
#: How far below the worst piece a character stands that is none.
UNKNOWN_PENALTY = 10.0

#: Units of models of merges that a worker remembers, and characters of new ones whose lattices are built at once.
CACHED_UNITS = 400_000
_CHARACTERS = 1 << 16
_PIECE_BYTES = 1 << 20

#: Scores below are marks of pieces reserved by hand.
_RESERVED = -1e8
_BLOCK = ("block long, keys array<long>, crcs array<long>, sizes array<long>, stream binary, units array<string>, "
          "long_at array<long>, long_ids array<array<int>>")


@dataclass
class Vocabulary:
    """What the model says of its pieces."""

    pieces: list[tuple[str, int, float]]
    bytes: list[int]
    texts: list[bytes]
    merges: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in every]
        found = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in every if not special[i]]
        of_byte = {model.id_to_piece(i): i for i in every if model.is_byte(i)}
        texts = [b"" if special[i] else model.id_to_piece(i).replace(BLANK, " ").encode() for i in every]
        for i in every:
            if model.is_byte(i):
                texts[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        scores = [s for _, _, s in found if s > _RESERVED]
        merges = scores == sorted(scores, reverse=True) and all(s == int(s) for s in scores)
        return cls(found, [of_byte[f"<0x{b:02X}>"] for b in range(256)], texts, merges)

    @property
    def digest(self) -> int:
        return zlib.crc32(repr((self.pieces, self.bytes)).encode())

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character of the pieces (0: none), and which two stand side by side in a piece."""
        chars = sorted({c for p, _, _ in self.pieces for c in p})
        number = np.zeros(0x110000, np.int16)
        number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number[0x20] = number[ord(BLANK)]
        beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        pairs = np.array([[ord(a), ord(b)] for p, _, _ in self.pieces for a, b in zip(p, p[1:])]).reshape(-1, 2)
        beside[tuple(number[pairs].T)] = True
        return number, beside

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def unknown(self) -> float:
        return min((s for _, _, s in self.pieces if s > _RESERVED), default=0.0) - UNKNOWN_PENALTY

    def path(self, unit: str) -> list[int]:
        """The ids of one unit, by the same choice as the fold over its lattice."""
        pieces_ = {p: (i, s) for p, i, s in self.pieces} if not hasattr(self, "_known") else self._known
        self._known = pieces_
        ends = self._merge(unit, pieces_) if self.merges else self._best(unit, pieces_)
        ids, at = [], 0
        while at < len(unit):
            found = pieces_.get(unit[at:ends[at]])
            ids += [found[0]] if found else [self.bytes[b] for b in unit[at:ends[at]].encode()]
            at = ends[at]
        return ids

    def _merge(self, unit: str, known: dict[str, tuple[int, float]]) -> list[int]:
        """The end of the part that starts at each place, after merging the best pair again and again."""
        n, longest = len(unit), self.longest
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[float, int, int]] = []

        def offer(left: int) -> None:
            if left >= 0 and ends[left] < n and (end := ends[ends[left]]) - left <= longest:
                if found := known.get(unit[left:end]):
                    heapq.heappush(waiting, (-found[1], left, end))

        for i in range(n):
            offer(i)
        while waiting:
            _, left, end = heapq.heappop(waiting)
            middle = ends[left]
            if not left < middle < n or ends[middle] != end:
                continue
            ends[left], ends[middle] = end, 0
            if end < n:
                before[end] = left
            offer(before[left])
            offer(left)
        return ends

    def _best(self, unit: str, known: dict[str, tuple[int, float]]) -> list[int]:
        """The end of the part that starts at each place of the path with the largest sum."""
        n, longest = len(unit), self.longest
        best, back = [0.0] + [0.0] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            found = None
            for start in range(max(0, end - longest), end):
                piece = known.get(unit[start:end])
                if piece or end - start == 1:
                    total = best[start] + (piece[1] if piece else self.unknown)
                    if found is None or total > found:
                        found, back[end] = total, start
            best[end] = found
        ends, at = [0] * n, n
        while at:
            ends[back[at]] = at
            at = back[at]
        return ends

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pieces, "piece string, id int, score double")


@dataclass
class _Block:
    keys: list[pa.Array] = field(default_factory=list)
    crcs: list[int] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    units: dict[int, str] = field(default_factory=dict)
    n: int = 0

    def add(self, piece: Piece, keys: pa.Array, number: np.ndarray, beside: np.ndarray) -> None:
        starts, ends, first = _units(piece, number, beside)
        bare = np.zeros(len(starts), bool)  # at the start of a text the model puts a blank
        bare[first[:-1][np.diff(first) > 0]] = True
        hashes = piece.spans(starts, ends)
        hashes[bare] = combine(hashes[bare], np.uint64(1))
        codes, distinct = pd.factorize(hashes)
        at = np.empty(len(distinct), np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        for h, a, b, bare_ in zip(distinct.tolist(), starts[at].tolist(), ends[at].tolist(), bare[at].tolist()):
            if h not in self.units:
                text = piece.buf[a:b].tobytes().decode().replace(" ", BLANK)
                self.units[h] = BLANK + text if bare_ else text
        self.keys.append(keys)
        self.crcs += [zlib.crc32(piece.buf[a:b]) for a, b in zip(piece.offsets[:-1], piece.offsets[1:])]
        self.sizes.append(np.diff(first))
        self.hashes.append(hashes)
        self.n += len(hashes)

    def row(self, block: int, vocabulary: Vocabulary) -> pa.RecordBatch:
        codes, distinct = pd.factorize(np.concatenate(self.hashes))
        order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        units = [self.units[h] for h in distinct[order].tolist()]
        long = [i for i, u in enumerate(units) if len(u) > LONG_UNIT]
        paths = [vocabulary.path(units[i]) for i in long]
        units = [None if len(u) > LONG_UNIT else u for u in units]
        keys = pa.concat_arrays(self.keys)
        columns = [pa.array([block], pa.int64()), _one(keys), _one(pa.array(self.crcs, pa.int64())),
                   _one(pa.array(np.concatenate(self.sizes))), pa.array([_shrink(place[codes])], pa.binary()),
                   _one(pa.array(units, pa.string())), _one(pa.array(long, pa.int64())),
                   _one(pa.array(paths, pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in _BLOCK.split(", ")])


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _shrink(places: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes(), 1)


def _grow(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _units(piece: Piece, number: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and where each text's begin."""
    chars = np.frombuffer(piece.buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((piece.buf & 0xC0) != 0x80)
    begin = np.ones(len(chars), bool)
    known = number[chars]
    begin[1:] = ~beside[known[:-1], known[1:]]
    texts = piece.offsets[:-1]
    begin[np.searchsorted(at, texts[texts < piece.offsets[1:]])] = True
    starts = at[begin]
    return starts, np.append(starts[1:], len(piece.buf)), np.searchsorted(starts, piece.offsets)


def _blocks(docs: DataFrame, vocabulary: Vocabulary, block_units: int) -> DataFrame:
    """Blocks of texts (columns ``key, text``) with their distinct units."""
    number, beside = vocabulary.neighbours()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for piece in pieces(batch.column(1)):
                block.add(piece, batch.column(0).slice(piece.rows.start, len(piece)), number, beside)
                if block.n >= block_units:
                    yield block.row((part << 32) + nth, vocabulary)
                    nth, block = nth + 1, _Block()
        if block.sizes:
            yield block.row((part << 32) + nth, vocabulary)

    return docs.select("key", "text").mapInArrow(run, _BLOCK)


def edges(units: DataFrame, on: list[str], vocabulary: Vocabulary) -> DataFrame:
    """``on, start, end, score, id``: every piece that fits in a unit (columns ``on, unit``).

    A character that is no piece has an edge with its code point below zero as id.
    """
    length = F.char_length("unit")
    spans = units.select(*on, "unit", F.explode(F.sequence(F.lit(0), length - 1)).alias("start")).select(
        *on, "unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), length - F.col("start"))))
        .alias("size"))
    spans = spans.select(*on, "start", "size", F.substring("unit", F.col("start") + 1, F.col("size")).alias("piece"))
    table = F.broadcast(vocabulary.table(units.sparkSession))  # as large as the vocabulary
    fits = spans.join(table, "piece", "left").where((F.col("size") == 1) | F.col("id").isNotNull())
    return fits.select(*on, "start", (F.col("start") + F.col("size")).alias("end"),
                       F.coalesce("score", F.lit(vocabulary.unknown)).alias("score"),
                       F.coalesce("id", -1 - F.ascii("piece")).alias("id"))


def lattice(units: DataFrame, on: list[str], vocabulary: Vocabulary) -> DataFrame:
    """``on, edges``: the edges of each unit, in order of their ends."""
    return edges(units, on, vocabulary).groupBy(*on).agg(
        F.sort_array(F.collect_list(F.struct("end", "start", "score", "id"))).alias("edges"))


_STEP = """
    named_struct('end', e.end, 'score', e.score + if(e.start = s.cur.end, s.cur.score, s.scores[e.start]),
                 'start', e.start, 'id', e.id)"""

#: The fold: ``scores`` and ``backs`` of all earlier ends, and the best edge so far to the current end.
_VITERBI = f"""
    aggregate(edges,
        named_struct('scores', cast(array() AS array<double>), 'backs', cast(array() AS array<struct<start: int, id: int>>),
                     'cur', named_struct('end', 0, 'score', 0D, 'start', 0, 'id', 0)),
        (s, e) -> if(e.end = s.cur.end,
            named_struct('scores', s.scores, 'backs', s.backs,
                         'cur', if(e.score + s.scores[e.start] > s.cur.score, {_STEP}, s.cur)),
            named_struct('scores', concat(s.scores, array(s.cur.score)),
                         'backs', concat(s.backs, array(named_struct('start', s.cur.start, 'id', s.cur.id))),
                         'cur', {_STEP})),
        s -> concat(s.backs, array(named_struct('start', s.cur.start, 'id', s.cur.id))))"""

#: From the last end back along the path.
_PATH = """
    aggregate(reverse(sequence(1, size(backs) - 1)),
        named_struct('at', size(backs) - 1, 'ids', cast(array() AS array<int>)),
        (s, p) -> if(p = s.at, named_struct('at', backs[p].start, 'ids', concat(array(backs[p].id), s.ids)), s),
        s -> s.ids)"""


def best_path(lattices: DataFrame, on: list[str], vocabulary: Vocabulary) -> DataFrame:
    """``on, ids``: the pieces of the path with the largest sum of scores through each lattice."""
    found = lattices.select(*on, F.expr(_VITERBI).alias("backs")).select(*on, F.expr(_PATH).alias("ids"))
    return found.withColumn("ids", F.when(F.exists("ids", lambda i: i < 0), _with_bytes(F.col("ids"), vocabulary))
                            .otherwise(F.col("ids")))


def merged(unit: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray, ids: np.ndarray,
           vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units and how many each has, from the edges of units ``0, 1, ...`` in order.

    In each round every unit makes its best merge: of the edges that join two
    neighbouring parts the one with the best score, the leftmost of equals.
    """
    n_units = int(unit[-1]) + 1 if len(unit) else 0
    sizes = np.zeros(n_units, np.int64)
    np.maximum.at(sizes, unit, end)
    base = np.cumsum(sizes + 1) - sizes - 1  # a place for each boundary
    left, right = base[unit] + start, base[unit] + end
    follow = np.arange(1, int((sizes + 1).sum()) + 1)
    begins = np.ones(len(follow), bool)
    last = base + sizes
    todo = np.flatnonzero(end - start > 1)
    todo = todo[np.lexsort((start[todo], -score[todo], unit[todo]))]
    while len(todo):
        a, b, u = left[todo], right[todo], unit[todo]
        middle = follow[a]
        possible = begins[a] & begins[b] & (middle < b)
        todo, a, b, u, middle = todo[possible], a[possible], b[possible], u[possible], middle[possible]
        joins = np.flatnonzero(follow[middle] == b)
        if not len(joins):
            break
        best = joins[np.unique(u[joins], return_index=True)[1]]
        follow[a[best]] = b[best]
        begins[middle[best]] = False
    begins[last] = False
    parts = np.flatnonzero(begins)
    step = vocabulary.longest + 1
    keys = left * step + (end - start)
    order = np.argsort(keys, kind="stable")
    found = ids[order[np.searchsorted(keys[order], parts * step + follow[parts] - parts)]]
    counts = np.bincount(np.searchsorted(base, parts, "right") - 1, minlength=n_units)
    if (found < 0).any():  # characters that are no piece
        each = [[i] if i >= 0 else [vocabulary.bytes[b] for b in chr(-1 - i).encode()] for i in found.tolist()]
        owner = np.repeat(np.arange(n_units), counts)
        counts = np.bincount(owner, [len(x) for x in each], n_units).astype(np.int64)
        found = np.array([i for x in each for i in x], np.int64)
    return found.astype(np.int32), counts


class Merges:
    """Ids of texts under a model of merges; each distinct unit's lattice is folded once."""

    def __init__(self, vocabulary: Vocabulary, long_unit: int):
        self.vocabulary, self.long_unit = vocabulary, long_unit
        self._number, self._beside = vocabulary.neighbours()
        table = _joined([p for p, _, _ in vocabulary.pieces])
        hashes = table.spans(table.offsets[:-1], table.offsets[1:])
        order = np.argsort(hashes)
        self._pieces = hashes[order]
        self._ids = np.array([i for _, i, _ in vocabulary.pieces], np.int64)[order]
        self._scores = np.array([s for _, _, s in vocabulary.pieces])[order]
        self._text = np.frombuffer(b"".join(vocabulary.texts), np.uint8)
        self._text_at = np.concatenate([[0], np.cumsum([len(t) for t in vocabulary.texts])])
        self._known, self._sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._at, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lattice(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """``unit, start, end, score, id`` of every edge: substrings joined with the piece table."""
        text = _joined(units)
        at = np.append(np.flatnonzero((text.buf & 0xC0) != 0x80), len(text.buf))
        first = np.searchsorted(at, text.offsets)
        size = np.diff(first)
        unit = np.repeat(np.arange(len(units)), size)
        place = np.arange(len(unit)) - first[unit]
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        found = []
        for length in range(1, self.vocabulary.longest + 1):
            start = np.flatnonzero(place + length <= size[unit])
            hashes = text.spans(at[start], at[start + length])
            row = np.searchsorted(self._pieces, hashes)
            row[row == len(self._pieces)] = 0
            fits = self._pieces[row] == hashes
            if length == 1:  # a character that is no piece has its code point below zero as id
                score = np.where(fits, self._scores[row], self.vocabulary.unknown)
                ids = np.where(fits, self._ids[row], -1 - codes[start])
            else:
                start, score, ids = start[fits], self._scores[row[fits]], self._ids[row[fits]]
            found.append((unit[start], place[start], place[start] + length, score, ids))
        columns = [np.concatenate(c) for c in zip(*found)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)

    def _fold(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and how many each has."""
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        short = [i for i, u in enumerate(units) if len(u) <= self.long_unit]
        for i in set(range(len(units))) - set(short):
            ids[i] = np.array(self.vocabulary.path(units[i]), np.int32)
        total = np.cumsum([len(units[i]) for i in short])
        for a, b in _parts(np.concatenate([[0], total]), _CHARACTERS):
            found, counts = merged(*self.lattice([units[i] for i in short[a:b]]), self.vocabulary)
            for i, x in zip(short[a:b], np.split(found, np.cumsum(counts)[:-1])):
                ids[i] = x
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _learn(self, piece: Piece, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, bare: np.ndarray) -> None:
        """Fold new units and put them in their places among the known ones; ``keys`` ascend."""
        units = [BLANK * b + piece.buf[x:y].tobytes().decode().replace(" ", BLANK)
                 for x, y, b in zip(starts.tolist(), ends.tolist(), bare.tolist())]
        flat, sizes = self._fold(units)
        place = np.searchsorted(self._known, keys)
        self._known = np.insert(self._known, place, keys)
        self._sizes = np.insert(self._sizes, place, sizes)
        self._at = np.insert(self._at, place, len(self._flat) + np.cumsum(sizes) - sizes)
        self._flat = np.concatenate([self._flat, flat])

    def piece(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece, and where each text's begin."""
        starts, ends, first = _units(piece, self._number, self._beside)
        bare = np.zeros(len(starts), bool)  # at the start of a text the model puts a blank
        bare[first[:-1][np.diff(first) > 0]] = True
        hashes = piece.spans(starts, ends)
        hashes[bare] = combine(hashes[bare], np.uint64(1))
        codes, keys = pd.factorize(hashes)
        new = np.flatnonzero(~np.isin(keys, self._known))
        if len(new):
            if len(self._known) > CACHED_UNITS:
                self._known, self._sizes = self._known[:0], self._sizes[:0]
                self._at, self._flat = self._at[:0], self._flat[:0]
                new = np.arange(len(keys))
            new = new[np.argsort(keys[new])]
            at = np.empty(len(keys), np.int64)
            at[codes[::-1]] = np.arange(len(codes))[::-1]
            self._learn(piece, keys[new], starts[at[new]], ends[at[new]], bare[at[new]])
        place = np.searchsorted(self._known, keys)[codes]
        sizes = self._sizes[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._flat[np.repeat(self._at[place] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[first]

    def decoded(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts that ids stand for, and where each text's begin (with the blank the model put first)."""
        start, size = self._text_at[ids], self._text_at[ids + 1] - self._text_at[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self._text[np.repeat(start - total[:-1], size) + np.arange(total[-1])], total[first]


def _joined(texts: list[str]) -> Piece:
    encoded_ = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded_])]).astype(np.int64)
    return Piece(np.frombuffer(b"".join(encoded_), np.uint8), offsets, slice(0, len(texts)), False)


_kept: dict[tuple[int, int], Merges] = {}


def _merges(vocabulary: Vocabulary, digest: int, long_unit: int) -> Merges:
    """The worker's state for a model; of one model at a time."""
    if (digest, long_unit) not in _kept:
        _kept.clear()
        _kept[digest, long_unit] = Merges(vocabulary, long_unit)
    return _kept[digest, long_unit]


def _by_merges(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids, text_crc, round_trip`` of texts (columns ``key, text``): each text alone, without a shuffle."""
    digest, long_unit = vocabulary.digest, LONG_UNIT

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        model = _merges(vocabulary, digest, long_unit)
        for piece in pieces(batch.column(1), size=_PIECE_BYTES):
            ids, first = model.piece(piece)
            data, at = model.decoded(ids, first)
            crcs = [zlib.crc32(piece.buf[a:b]) for a, b in zip(piece.offsets[:-1], piece.offsets[1:])]
            again = [zlib.crc32(data[a + (a < b and data[a] == 0x20):b]) for a, b in zip(at[:-1], at[1:])]
            yield {"doc_id": batch.column(0).slice(piece.rows.start, len(piece)),
                   "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())),
                   "text_crc": crcs, "round_trip": np.equal(crcs, again)}

    return arrow_map(docs.select("key", "text"), "doc_id long, ids array<int>, text_crc long, round_trip boolean", work)


def _with_bytes(ids: Column, vocabulary: Vocabulary) -> Column:
    """Replace characters that are no piece by their UTF-8 bytes' pieces."""
    of_byte = F.array(*(F.lit(i) for i in vocabulary.bytes))

    def expand(i: Column) -> Column:
        code = -1 - i
        tail = [F.shiftright(code, s).bitwiseAND(63) + 128 for s in (12, 6, 0)]
        bytes_ = (F.when(code < 0x80, F.array(code))
                  .when(code < 0x800, F.array(F.shiftright(code, 6) + 192, tail[2]))
                  .when(code < 0x10000, F.array(F.shiftright(code, 12) + 224, tail[1], tail[2]))
                  .otherwise(F.array(F.shiftright(code, 18) + 240, *tail)))
        return F.when(i >= 0, F.array(i)).otherwise(F.transform(bytes_, lambda b: F.element_at(of_byte, b + 1)))

    return F.flatten(F.transform(ids, expand))


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text",
           block_units: int = BLOCK_UNITS) -> DataFrame:
    """``doc_id, ids`` and ``text_crc`` (crc32 of the text's bytes) of every document."""
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if vocabulary.merges:
        return _by_merges(plain, vocabulary).select("doc_id", "ids", "text_crc")
    work_ = Workspace(docs.sparkSession, "subwords")
    blocks = work_.save(_blocks(plain, vocabulary, block_units), "blocks", compression="zstd")
    units = blocks.select("block", F.posexplode("units").alias("nth", "unit")).where("unit IS NOT NULL")
    paths = best_path(lattice(units, ["block", "nth"], vocabulary), ["block", "nth"], vocabulary)
    chunks = paths.select("block", F.array("nth").alias("nth"), F.array("ids").alias("ids"))
    coded = chunks.groupBy("block").agg(F.collect_list(F.struct("nth", "ids")).alias("paths"))
    together = blocks.drop("units").join(coded.select(
        "block", F.flatten("paths.nth").alias("nth"), F.flatten("paths.ids").alias("ids")), "block", "left")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(len(batch)):
            keys, crcs, sizes, stream = (batch.column(name)[i] for name in ("keys", "crcs", "sizes", "stream"))
            places = _grow(stream.as_py())
            flat, lengths, at = _paths([(batch.column(x)[i], batch.column(y)[i]) for x, y in (
                ("nth", "ids"), ("long_at", "long_ids"))])
            sizes = sizes.values.to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in _parts(first, PIECE_BYTES):
                some = places[first[a]:first[b]]
                n = lengths[some]
                total = np.cumsum(n)
                out = flat[np.repeat(at[some] - total + n, n) + np.arange(total[-1] if len(total) else 0)]
                bounds = np.concatenate([[0], total])[first[a:b + 1] - first[a]].astype(np.int32)
                yield {"doc_id": keys.values.slice(a, b - a), "text_crc": crcs.values.slice(a, b - a),
                       "ids": pa.ListArray.from_arrays(pa.array(bounds), pa.array(out, pa.int32()))}

    return arrow_map(together.drop("block"), "doc_id long, ids array<int>, text_crc long", work)


def _paths(lists: list[tuple[pa.ListScalar, pa.ListScalar]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and for each unit how many are its and where they begin, from lists of units and their ids."""
    units, lengths, begins, flat, n = [], [], [], [], 0
    for which, ids in lists:
        if which.is_valid and len(which.values):
            starts = ids.values.offsets.to_numpy().astype(np.int64)  # of all values, not of this part of them
            units.append(which.values.to_numpy())
            lengths.append(np.diff(starts))
            begins.append(starts[:-1] - starts[0] + n)
            flat.append(ids.values.values.to_numpy()[starts[0]:starts[-1]])
            n += len(flat[-1])
    if not units:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.concatenate(units))
    return np.concatenate(flat), np.concatenate(lengths)[order], np.concatenate(begins)[order]


def _parts(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` units."""
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + most, "right")) - 1)
        yield a, b
        a = b


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids: pieces in turn, without the blank that the model puts first."""
    at, names, texts = coded.columns.index(ids), coded.columns, vocabulary.texts

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        column = batch.column(at)
        decoded = [b"".join([texts[i] for i in row.values.to_numpy()]).removeprefix(b" ").decode("utf-8", "replace")
                   if row.is_valid else None for row in column]
        yield dict(zip(names, batch.columns)) | {"decoded": pa.array(decoded, pa.string())}

    return arrow_map(coded, StructType([*coded.schema.fields, StructField("decoded", StringType())]), work)


def encoded(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids`` and whether decoding them gives the text back."""
    if vocabulary.merges:
        plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        return _by_merges(plain, vocabulary).select(
            "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
    found = decode(encode(docs, vocabulary, key, text), vocabulary)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids",
                        (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc")).alias("round_trip"))


def op2_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return encoded(read(spark, sf_dir, "documents"), vocabulary)


QUERIES = {"op2_sentencepiece_lattice": op2_sentencepiece_lattice}
ORACLES: dict[str, str] = {}
