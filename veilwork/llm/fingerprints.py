"""Near duplicates: SimHash fingerprints linked over vantage-point trees.

A fingerprint has a bit where more than half of the text's three-word shingles
have it in their XXH64.  Fingerprints within ``RADIUS`` bits of each other differ
in at most one bit of their upper or of their lower half, so each half has a
vantage-point tree over Hamming distances, searched within ``REACH``: what lies
at most as far from a node's vantage point as the node's bound goes inside, the
rest outside, and by the triangle inequality a search leaves out a side that its
reach cannot touch.  A sample fits the upper part of the trees, whose leaves are
shards; every different fingerprint goes to its own shard and, as a guest, to
those that its reach overlaps.  A shard goes on dividing by vantage points and
compares whole fingerprints in small leaves.  Shards too large for a task, as
where very many fingerprints share a half, are dealt out as pairs of blocks.
Tasks return one edge per linked fingerprint, never pairs, and components of
these edges are found by rounds of joins.

Defined results: NULL texts and texts without words have fingerprint zero and
are linked like any other; shorter texts are one shingle of all their words;
repeated rows share fingerprint and component; NULL ids are no candidates for a
component's id, which is NULL if there is no other; texts of any length are
worked on in pieces; an empty table gives an empty table.  Other columns play no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, smallest
from .tables import Workspace, arrow_map, read
from .words import Piece, pieces

SHINGLE = 3
SEED = 42
RADIUS = 3
HALVES = 2
REACH = RADIUS // HALVES
#: Fingerprints of a shard, how many of them the sample holds that the trees are fitted to, and its largest size.
SHARD = 1 << 13
SAMPLED = 32
LARGEST_SAMPLE = 1 << 22
#: Rows that one task compares at a time.
CELL = 1 << 17
_LEAF = 128
_COMPARED = 1 << 20
_CHUNK = 1 << 17


def _joined(piece: Piece, a: int, b: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words ``a`` to ``b`` of a piece with one space between, and where each begins and ends."""
    lengths = piece.ends[a:b] - piece.starts[a:b]
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full(ends[-1] + 1, 0x20, np.uint8)
    out[within + np.repeat(starts, lengths)] = piece.buf[within + np.repeat(piece.starts[a:b], lengths)]
    return out.tobytes(), starts, ends


def simhash(piece: Piece) -> np.ndarray:
    """The fingerprint of each text of a piece (lower-cased)."""
    n = piece.n_words
    shingles = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(piece)), shingles)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + piece.first[owner]
    end = np.minimum(begin + SHINGLE, piece.first[owner + 1])
    set_ = np.zeros((len(piece), 64), np.int64)
    for a in range(0, len(owner), _CHUNK):
        at, to, of = begin[a:a + _CHUNK], end[a:a + _CHUNK], owner[a:a + _CHUNK]
        text, starts, ends = _joined(piece, at[0], to[-1])
        places = zip(starts[at - at[0]].tolist(), ends[to - 1 - at[0]].tolist())
        h = np.array([xxhash.xxh64_intdigest(text[s:e], SEED) for s, e in places], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        set_[of[firsts]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
    return np.packbits(2 * set_ > shingles[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` (its 64 bits as a long) of every document."""
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in pieces(batch.column(1), lower=True):
            yield {"key": batch.column(0).slice(piece.rows.start, len(piece)), "fingerprint": simhash(piece).view(np.int64)}

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, "key long, fingerprint long", work)


def _half(fingerprint: np.ndarray, which: int) -> np.ndarray:
    return (fingerprint.view(np.uint64) >> np.uint64(32 * which)).astype(np.uint32)


def _apart(values: np.ndarray, vantage: np.uint32) -> np.ndarray:
    return np.bitwise_count(values ^ vantage).astype(np.int64)


def _vantage(values: np.ndarray) -> tuple[np.uint32, int] | None:
    """A vantage point and bound that leave few values within reach of both sides; None if nothing divides them.

    Of some candidates and bounds near the middle, that with the least product
    of what searches see on either side.
    """
    best = None
    for vantage in values[:: max(1, len(values) // 4)][:4]:
        upto = np.cumsum(np.bincount(_apart(values, vantage), minlength=34 + REACH))
        total = upto[-1]
        for bound in range(33):
            inside = upto[bound]
            if not 0 < inside < total:
                continue
            outside = total - inside
            seen = upto[bound + REACH] * inside + (total - (upto[bound - REACH] if bound >= REACH else 0)) * outside
            if best is None or seen < best[0]:
                best = (seen, vantage, bound)
    return best and best[1:]


class Shards:
    """The upper part of a vantage-point tree; a child below zero is shard ``-1 - child``."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.nodes: list[tuple[np.uint32, int, int, int]] = []
        self.count = 0
        self.root = self._grow(sample, leaf)

    def _grow(self, values: np.ndarray, leaf: int) -> int:
        found = _vantage(values) if len(values) > leaf else None
        if found is None:
            self.count += 1
            return -self.count
        inside = _apart(values, found[0]) <= found[1]
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (*found, self._grow(values[inside], leaf), self._grow(values[~inside], leaf))
        return at

    def reached(self, values: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """Shards and the places of the values whose reach touches them."""
        waiting = [(self.root, np.arange(len(values)))]
        while waiting:
            at, places = waiting.pop()
            if not len(places):
                continue
            if at < 0:
                yield -1 - at, places
                continue
            vantage, bound, inner, outer = self.nodes[at]
            d = _apart(values[places], vantage)
            waiting += [(inner, places[d - reach <= bound]), (outer, places[d + reach > bound])]


def _route(reps: DataFrame, trees: list[Shards]) -> DataFrame:
    """``half, shard, home, fingerprint``: each fingerprint in its shard, and as a guest in later ones."""
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        marks = batch.column(0).to_numpy()
        for which, tree in enumerate(trees):
            values = _half(marks, which)
            home = np.empty(len(values), np.int64)
            for shard, places in tree.reached(values, 0):
                home[places] = shard
            for shard, places in tree.reached(values, REACH):
                places = places[home[places] <= shard]  # two that are near reach each other's shards: once suffices
                yield {"half": np.full(len(places), which), "shard": np.full(len(places), shard),
                       "home": home[places] == shard, "fingerprint": marks[places]}

    return arrow_map(reps, "half int, shard long, home boolean, fingerprint long", work)


def _near(values: np.ndarray, whole: np.ndarray, home: np.ndarray, guests: np.ndarray,
          found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Report places of ``home`` and ``guests`` whose whole fingerprints link, by dividing ``home``."""
    waiting = [(home, guests)]
    while waiting:
        home, guests = waiting.pop()
        if not len(home) or not len(guests):
            continue
        split = _vantage(values[home]) if len(home) > _LEAF else None
        if split is None:
            for a in range(0, len(home), _LEAF):
                some = home[a:a + _LEAF]
                step = max(1, _COMPARED // len(some))
                for b in range(0, len(guests), step):
                    others = guests[b:b + step]
                    x, y = np.nonzero(np.bitwise_count(whole[some][:, None] ^ whole[others]) <= RADIUS)
                    found(some[x], others[y])
            continue
        vantage, bound = split
        mine, theirs = _apart(values[home], vantage), _apart(values[guests], vantage)
        waiting += [(home[mine <= bound], guests[theirs - REACH <= bound]),
                    (home[mine > bound], guests[theirs + REACH > bound])]


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """An edge from each fingerprint of a cell to the first of its part of the cell."""
    marks = frame["fingerprint"].to_numpy()
    whole, values = marks.view(np.uint64), _half(marks, int(frame["half"].iloc[0]))
    home, block = frame["home"].to_numpy(), frame["block"].to_numpy()
    low, high = frame["low"].iloc[0], frame["high"].iloc[0]
    root, left, right, held = np.arange(len(marks)), [], [], 0

    def settle() -> None:
        nonlocal root, left, right, held
        root = smallest(len(marks), np.concatenate([np.arange(len(marks)), *left]), np.concatenate([root, *right]))
        left, right, held = [], [], 0

    def found(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal held
        new = root[x] != root[y]
        left.append(x[new])
        right.append(y[new])
        held += int(new.sum())
        if held > _COMPARED:
            settle()

    for one, other in ((low, high), (high, low)):
        _near(values, whole, np.flatnonzero(home & (block == one)), np.flatnonzero(block == other), found)
        if low == high:
            break
    settle()
    tied = np.flatnonzero(root != np.arange(len(marks)))
    return pd.DataFrame({"a": marks[tied], "b": marks[root[tied]]})


def _edges(reps: DataFrame, work: Workspace) -> DataFrame:
    """Edges ``a, b`` that connect fingerprints within the radius of each other."""
    # Drawn by hash, 256 bytes a shard and 32 MB at most; beyond that shards grow, and are dealt out as cells.
    rate = max(SHARD // SAMPLED, -(-reps.count() // LARGEST_SAMPLE))
    drawn = reps.where(F.pmod(F.xxhash64("fingerprint"), F.lit(rate)) == 0).toPandas()["fingerprint"]
    trees = [Shards(np.sort(_half(drawn.to_numpy(np.int64), which)), SAMPLED) for which in range(HALVES)]
    routed = work.save(_route(reps, trees), "routed")
    sizes = routed.groupBy("half", "shard").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("blocks"))
    cells = (routed.join(sizes, ["half", "shard"])
             .withColumn("block", F.pmod(F.xxhash64("fingerprint"), "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("half", "shard", "home", "fingerprint", "block",
                     F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    return work.save(cells.groupBy("half", "shard", "low", "high").applyInPandas(_linked, "a long, b long"), "edges")


def linked_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` (the key), ``fingerprint`` and ``component_id`` of every document."""
    work = Workspace(docs.sparkSession, "fingerprints")
    marks = work.save(fingerprints(docs, key, text), "marks")
    reps = work.save(marks.groupBy("fingerprint").agg(F.min("key").alias("least")), "reps")
    labels = components(_edges(reps.select("fingerprint"), work), work, "components")
    grouped = work.save(reps.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")), "grouped")
    smallest_ids = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    found = grouped.join(smallest_ids, "label").select("fingerprint", "component_id")
    return marks.join(found, "fingerprint", "left").select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op12_vantage_point_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op12_vantage_point_simhash": op12_vantage_point_simhash}
ORACLES: dict[str, str] = {}
