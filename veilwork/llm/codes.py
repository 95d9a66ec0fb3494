"""Vector codes: product quantisation by Lloyd rounds over cover trees.

A component ``x`` counts as the integer ``floor(4096 * x)``; a vector is cut into
eight equal parts, each with a codebook of sixteen entries that six rounds fit to
all vectors.  Rows are packed into blocks once; in each block the different parts
of a position form a cover tree, whose nodes are ranges of one order of points,
so that cumulative sums along that order give the sum of any subtree.  A round
sends the codebooks to the blocks: a node is settled with all that is below it
if its nearest entry is nearer than any other by more than twice its radius;
others hand over to their children, and only points of ambiguous leaves are
compared one by one, in integers.  What comes back is one count and sum per
entry and task.  Results are those of comparing every part with every entry.

Defined results: vectors that are NULL, empty, or hold NULL or non-finite
components are left out.  Vectors must share one length, a multiple of eight,
and components stay within ``largest`` (92,000 for parts of eight), so that sums
of squares are exact; anything else stops the job with a message.  NULL ids come last in order, repeated ids in order of their vectors;
repeated rows count as often as they are there; NULL labels are one label.
Ties between entries go to the lower index.  With fewer than sixteen vectors
there are as many entries as vectors; an empty table gives an empty table.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import Workspace, arrow_map, read

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors of a block, and points below which a node is not divided.
BLOCK_ROWS = 1 << 14
LEAF = 8

_NODE = np.dtype([("center", "<i4"), ("start", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4"),
                  ("radius", "<f8")])
_TREE = "array<struct<points:binary, place:binary, nodes:binary>>"


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    length = end - start
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


def _lengths(difference: np.ndarray) -> np.ndarray:
    return np.sqrt((difference * difference).sum(axis=-1).astype(np.float64))


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points and the nodes of their cover tree, level by level, children of a node together.

    The children of a node have centres more than half the width of its level
    apart and hold what lies within that of them, so ``radius`` falls by half a
    level; a centre stays its own first child.
    """
    n = len(points)
    order, node = np.arange(n), np.zeros(n, np.int64)
    away = _lengths(points - points[0])
    width = float(away.max(initial=0.0))
    levels = [np.array([(0, 0, n, 0, 0, width)], _NODE)]
    first = 0  # number of the level's first node
    while True:
        level = levels[-1]
        open_ = (level["end"] - level["start"] > LEAF) & (level["radius"] > 0)
        if not open_.any():
            break
        width /= 2
        parent = np.flatnonzero(open_)
        at = _ranges(level["start"][parent], level["end"][parent])  # places in the order
        owner = np.repeat(np.arange(len(parent)), level["end"][parent] - level["start"][parent])
        who = order[at]
        child, far = np.zeros(len(at), np.int64), away[who]
        center = [level["center"][parent].astype(np.int64)]
        centers = [(np.arange(len(parent)), np.zeros(len(parent), np.int64), center[0])]
        left, number = np.flatnonzero(far > width), 0
        while len(left):
            number += 1
            owners, where = np.unique(owner[left], return_index=True)
            pick = np.zeros(len(parent), np.int64)
            pick[owners] = who[left[where]]
            centers.append((owners, np.full(len(owners), number), pick[owners]))
            d = _lengths(points[who[left]] - points[pick[owner[left]]])
            near = d <= width
            child[left[near]], far[left[near]] = number, d[near]
            left = left[~near]
        away[who] = far
        sorted_ = np.lexsort((child, owner))
        order[at] = who[sorted_]
        key_owner, key_child, key_center = (np.concatenate(x) for x in zip(*centers))
        of = np.lexsort((key_child, key_owner))
        key_owner, key_center = key_owner[of], key_center[of]
        o, c = owner[sorted_], child[sorted_]
        begins = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])]))
        ends = np.append(begins[1:], len(at))
        made = np.zeros(len(begins), _NODE)
        made["center"], made["start"] = key_center, at[begins]
        made["end"] = at[ends - 1] + 1
        made["radius"] = np.maximum.reduceat(far[sorted_], begins)
        level["children"][parent] = np.bincount(key_owner, minlength=len(parent))
        level["child"][parent] = first + len(level) + np.searchsorted(key_owner, np.arange(len(parent)))
        first += len(level)
        levels.append(made)
    return order, np.concatenate(levels)


class Tree:
    """One part of a block's vectors: different points in tree order, their counts, and the nodes."""

    def __init__(self, points: np.ndarray, place: np.ndarray, nodes: np.ndarray):
        self.points, self.place, self.nodes = points, place, nodes
        self.counts = np.bincount(place, minlength=len(points))
        self.cumulated = np.zeros((len(points) + 1, points.shape[1] + 1), np.int64)
        np.cumsum(np.column_stack([self.counts, points * self.counts[:, None]]), axis=0, out=self.cumulated[1:])

    @classmethod
    def of(cls, rows: np.ndarray) -> Tree:
        points, place = np.unique(rows, axis=0, return_inverse=True)
        order, nodes = cover_tree(points)
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        nodes["center"] = moved[nodes["center"]]
        return cls(points[order], moved[place.reshape(-1)], nodes)

    @classmethod
    def load(cls, stored: dict, width: int) -> Tree:
        return cls(np.frombuffer(stored["points"], "<i4").reshape(-1, width).astype(np.int64),
                   np.frombuffer(stored["place"], "<i4"), np.frombuffer(stored["nodes"], _NODE))

    def stored(self) -> dict:
        return {"points": self.points.astype("<i4").tobytes(), "place": self.place.astype("<i4").tobytes(),
                "nodes": self.nodes.tobytes()}

    def settle(self, book: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Ranges of points with the entry nearest to all of them, and single points with theirs."""
        ranges, singles, front = [], [], np.array([0])
        while len(front):
            node = self.nodes[front]
            d = _lengths(self.points[node["center"]][:, None, :] - book)
            nearest = d.argmin(axis=1)
            best = d[np.arange(len(d)), nearest]
            d[np.arange(len(d)), nearest] = np.inf
            # A little more than the triangle inequality asks for, so that rounding cannot settle a tie.
            clear = d.min(axis=1) - best > 2 * node["radius"] * (1 + 1e-9) + 1e-6 * (1 + best)
            ranges.append((node["start"][clear], node["end"][clear], nearest[clear]))
            node = node[~clear]
            leaf = node["children"] == 0
            at = _ranges(node["start"][leaf], node["end"][leaf])
            exact = self.points[at][:, None, :] - book
            singles.append((at, (exact * exact).sum(axis=2).argmin(axis=1)))
            front = _ranges(node["child"][~leaf], node["child"][~leaf] + node["children"][~leaf])
        return (tuple(np.concatenate(x) for x in zip(*ranges)), tuple(np.concatenate(x) for x in zip(*singles)))

    def sums(self, book: np.ndarray) -> np.ndarray:
        """Per entry: how many parts are nearest to it, and their sum."""
        (start, end, entry), (at, single) = self.settle(book)
        out = np.zeros((len(book), self.cumulated.shape[1]), np.int64)
        np.add.at(out, entry, self.cumulated[end] - self.cumulated[start])
        np.add.at(out, single, self.cumulated[at + 1] - self.cumulated[at])
        return out

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector: the entry of its part, and their squared distance."""
        (start, end, entry), (at, single) = self.settle(book)
        found = np.empty(len(self.points), np.int64)
        found[_ranges(start, end)] = np.repeat(entry, end - start)
        found[at] = single
        off = self.points - book[found]
        return found[self.place], (off * off).sum(axis=1)[self.place]


def _usable(vector: Column) -> Column:
    fits = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fits


def largest(width: int) -> float:
    """Components below this have squared distances of parts within 62 bits."""
    return (2.0 ** 62 / width) ** 0.5 / (2 * SCALE) - 1


def _integers(flat: np.ndarray, width: int) -> np.ndarray:
    if len(flat) and np.abs(flat).max() > largest(width):
        raise ValueError(f"components of more than {largest(width):.0f} are out of range")
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64)


def _blocks(rows: DataFrame, length: int) -> DataFrame:
    """Vectors packed: per block its ids, its labels and the trees of its parts."""
    kinds = {c: rows.schema[c].dataType for c in ("id", "label")}
    schema = T.StructType([T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])),
                           T.StructField("trees", T._parse_datatype_string(_TREE))])
    fields = to_arrow_schema(schema)

    def block(table: pa.Table) -> pa.RecordBatch:
        vectors = table.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if not (np.diff(vectors.offsets.to_numpy()) == length).all():
            raise ValueError(f"vectors have lengths other than {length}")
        parts = _integers(flat, length // PARTS).reshape(len(table), PARTS, -1)
        trees = [Tree.of(parts[:, p]).stored() for p in range(PARTS)]
        columns = [pa.array([table.column(c).to_pylist()], fields.field(i).type) for i, c in enumerate(("id", "label"))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([trees], fields.field(2).type)], schema=fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK_ROWS))
                held = table.slice(BLOCK_ROWS).to_batches()
        if sum(map(len, held)):
            yield block(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    return rows.select("id", "label", "vector").mapInArrow(work, schema)


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[dict, list[Tree]]]:
    for i in range(len(batch)):
        row = batch.slice(i, 1)
        yield row, [Tree.load(t, width) for t in row.column("trees").to_pylist()[0]]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: one row per part, entry and task is shuffled."""
    width = books.shape[2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, books.shape[1], width + 1), np.int64)
        for batch in batches:
            for _, trees in _trees(batch, width):
                for p, tree in enumerate(trees):
                    total[p] += tree.sums(books[p])
        part, entry = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "sums": list(total[part, entry])})
        pa.default_memory_pool().release_unused()

    found = blocks.mapInArrow(work, "part long, entry long, sums array<long>")
    out = books.copy()
    for row in found.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[i]) for i in range(width + 1)]).collect():
        part, entry, count, *sums = row
        out[part, entry] = [s // count for s in sums]
    return out


def _assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    width = books.shape[2]

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, trees in _trees(batch, width):
            codes, errors = zip(*[tree.nearest(books[p]) for p, tree in enumerate(trees)])
            text = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * PARTS
            yield {"vec_id": row.column("ids").flatten(), "label": row.column("labels").flatten(),
                   "code": [text[a:a + step] for a in range(0, len(text), step)], "error": sum(errors)}

    kinds = {c: blocks.schema[f].dataType.elementType for c, f in (("vec_id", "ids"), ("label", "labels"))}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()] + [
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return arrow_map(blocks, schema, work)


def fitted(rows: DataFrame, work: Workspace) -> tuple[DataFrame, np.ndarray] | None:
    """The packed blocks of ``id, label, vector`` rows and the codebooks (part, entry, component); None without rows."""
    seeds = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    if not seeds:
        return None
    length = len(seeds[0]["vector"])
    if length % PARTS or any(len(s["vector"]) != length for s in seeds):
        raise ValueError(f"vectors need one length, a multiple of {PARTS}")
    blocks = work.save(_blocks(rows, length), "blocks")
    books = np.stack([_integers(np.array(s["vector"]), length // PARTS).reshape(PARTS, -1) for s in seeds], axis=1)
    for _ in range(ROUNDS):
        books = _round(blocks, books)
    return blocks, books


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id`` (the key), ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every usable vector."""
    work = Workspace(vectors.sparkSession, "codes")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label")).where(
        _usable(F.col("vector")))
    found = fitted(rows, work)
    if found is None:
        return rows.limit(0).select(
            F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    blocks, books = found
    coded = work.save(_assigned(blocks, books), "coded")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    width = f"(len(v) // {PARTS})"
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * {width} + 1 : (p + 1) * {width}] AS x
        FROM kept, range({PARTS}) r(p))""",
             f"""book0 AS MATERIALIZED (SELECT p, e, v[p * {width} + 1 : (p + 1) * {width}] AS c FROM (
        SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}), range({PARTS}) r(p))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x,
            min({{'d': d, 'e': e}}) AS best FROM (SELECT vec_id, label, p, e, x,
              list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
              FROM parts JOIN book{k} USING (p)) GROUP BY vec_id, p)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN (
              SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i)::BIGINT[] AS m FROM (
                SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM near{k}, unnest(range(1, len(x) + 1)) u(i)
                GROUP BY ALL) GROUP BY p, e) USING (p, e))""")
    last = ROUNDS
    return f"""WITH {', '.join(steps)},
      coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e::INTEGER), '' ORDER BY p) AS code,
        sum(best.d)::BIGINT AS error FROM near{last} GROUP BY vec_id)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{last}) AS codebooks_sha256 FROM coded"""


QUERIES = {"op11_cover_tree_codes": op11_cover_tree_codes}
ORACLES = {"op11_cover_tree_codes": _sql()}
