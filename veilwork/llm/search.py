"""Ranked lexical search: posting lists in geometric blocks with exact summaries.

Documents become sparse vectors over the terms of the items, written once; a
second pass searches them shard by shard, and a task keeps the best documents of
each item over all its shards.  Within a shard every term that a search visits
has its posting list clustered by the similarity of its documents, and each
block carries the largest value that any of its documents has in each coordinate
that items with this term still ask for.  An item visits its terms by falling largest
contribution.  It ends when the terms left cannot add up to its tenth best score;
a block is skipped only when its summary cannot either.  Both are bounds on exact
integers, so nothing that belongs to the result is ever left out.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, with
``A`` to ``Z`` lower-cased.  A document's score for an item is the sum, over the
item's terms once each, of ``w * ((10^9 tf) div (1000 tf + 8 m))`` with ``w`` the
term's weight and ``m`` the document's length factor.

Defined results: NULL texts and texts without terms count nowhere and are never
found; every row is a document, so repeated rows are found as often as they are
there; equal scores go by document id, NULL last; rows of one item id (NULL
included) are one item with the terms of all; items without terms, and documents
with score zero, give no rows; texts of any length are worked on in pieces; empty
tables give an empty table.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, arrow_map, read
from .words import pieces

TOP = 10
#: Pairs of item and term that one search takes to the tasks; more items are searched in blocks.
PAIRS = 1 << 20
#: Postings and documents of a shard, documents of a block, coordinates of a sketch, values of kept summaries.
SHARD_POSTINGS = 1 << 21
SHARD_DOCS = 1 << 15
BLOCK = 64
SKETCH = 16
KEPT = 1 << 23

_TERM = np.full(256, 0x20, np.uint8)
for _from, _to in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_from:_to + 1] = np.arange(_from, _to + 1)
_TERM[0x41:0x5B] += 32


def _spaced(column: pa.Array) -> pa.Array:
    """The texts lower-cased, with a space for whatever separates terms."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    mapped = _TERM[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(column.type, len(column), [None, places, pa.py_buffer(mapped)], offset=column.offset)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, terms``: the hashes of each row's different terms."""
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in pieces(_spaced(batch.column(1))):
            hashes, owner = piece.hashes().view(np.int64), piece.owner
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            places = np.searchsorted(owner[new], np.arange(len(piece) + 1)).astype(np.int32)
            yield {"item": batch.column(0).slice(piece.rows.start, len(piece)),
                   "terms": pa.ListArray.from_arrays(places, hashes[new])}

    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, "item long, terms array<long>", work)


def term_vectors(docs: DataFrame, vocabulary: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n, terms, tfs``: number of terms, and which of the vocabulary (sorted hashes) occur how often."""
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in pieces(_spaced(batch.column(1))):
            hashes = piece.hashes()
            at = np.searchsorted(vocabulary, hashes)
            at[at == len(vocabulary)] = 0
            known = vocabulary[at] == hashes
            cells, tfs = np.unique(piece.owner[known] * len(vocabulary) + at[known], return_counts=True)
            owner, term = np.divmod(cells, len(vocabulary))
            places = np.searchsorted(owner, np.arange(len(piece) + 1)).astype(np.int32)
            yield {"doc": batch.column(0).slice(piece.rows.start, len(piece)), "n": piece.n_words,
                   "terms": pa.ListArray.from_arrays(places, term.astype(np.int32)),
                   "tfs": pa.ListArray.from_arrays(places, tfs.astype(np.int64))}

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, "doc long, n long, terms array<int>, tfs array<long>", work)


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term occurs, counted per task before it is shuffled."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": term, "n": counts[term]})

    found = vectors.select("terms").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


def length_factors(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    if len(n) and int(n.max()) * 90 * documents >= 1 << 63:  # beyond 64 bits: one by one
        return np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)
    return 10 + 90 * n * documents // terms


class Items:
    """Items with their terms as places in a vocabulary of sorted hashes."""

    def __init__(self, ids: list[int | None], terms: list[np.ndarray]):
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.vocabulary, t) for t in terms]
        owner = np.repeat(np.arange(len(ids)), [len(t) for t in self.terms])
        flat = np.concatenate(self.terms) if terms else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self._owners, self._first = owner[order], np.searchsorted(flat[order], np.arange(len(self.vocabulary) + 1))

    def asked_with(self, term: int) -> np.ndarray:
        """All terms of the items that have this one."""
        return np.unique(np.concatenate([self.terms[q] for q in self._owners[self._first[term]:self._first[term + 1]]]))


class Blocks:
    """One posting list, clustered: ``docs[first[b]:first[b + 1]]`` are block ``b``, ``summary[b]`` its maxima."""

    def __init__(self, shard: Shard, term: int):
        docs = shard.posted[shard.list[term]:shard.list[term + 1]]
        cluster = np.zeros(len(docs), np.int64)
        if len(docs) > BLOCK:
            pivots = shard.sketches[docs[::BLOCK]]
            for a in range(0, len(docs), 4096):
                cluster[a:a + 4096] = (shard.sketches[docs[a:a + 4096]] @ pivots.T).argmax(axis=1)
        order = np.argsort(cluster, kind="stable")
        self.docs, cluster = docs[order], cluster[order]
        begin = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
        begin = np.concatenate([np.arange(a, b, 2 * BLOCK) for a, b in zip(begin, np.append(begin[1:], len(docs)))])
        self.first = np.append(begin, len(docs))
        # Coordinates of terms that items visit before this one are never asked for here.
        self.columns = shard.items.asked_with(term)
        self.columns = self.columns[shard.largest[self.columns] <= shard.largest[term]]
        column_of = np.full(len(shard.largest), -1, np.int32)
        column_of[self.columns] = np.arange(len(self.columns))
        start, end = shard.place[self.docs], shard.place[self.docs + 1]
        at = _ranges(start, end)
        column = column_of[shard.term[at]]
        here = column >= 0
        block = np.repeat(np.repeat(np.arange(len(begin)), np.diff(self.first)), end - start)[here]
        self.summary = np.zeros((len(begin), len(self.columns)), np.int64)
        np.maximum.at(self.summary.reshape(-1), block * len(self.columns) + column[here], shard.value[at[here]])


class Shard:
    """Documents as sparse vectors of contributions, forward and by term."""

    def __init__(self, items: Items, docs: np.ndarray, unknown: np.ndarray, place: np.ndarray, term: np.ndarray,
                 value: np.ndarray):
        self.items, self.docs, self.unknown = items, docs, unknown
        self.place, self.term, self.value = place, term, value
        order = np.argsort(term, kind="stable")
        owner = np.repeat(np.arange(len(docs)), np.diff(place))
        self.posted = owner[order]
        size = len(items.vocabulary)
        self.list = np.searchsorted(term[order], np.arange(size + 1))
        self.largest = np.zeros(size, np.int64)
        np.maximum.at(self.largest, term, value)
        signs = np.random.default_rng(13).choice(np.array([-1, 1], np.float32), (SKETCH, size))
        full = np.flatnonzero(np.diff(place))
        self.sketches = np.zeros((len(docs), SKETCH), np.float32)
        for k in range(SKETCH if len(full) else 0):
            self.sketches[full, k] = np.add.reduceat(value * signs[k][term], place[full])
        self.sketches /= np.maximum(np.linalg.norm(self.sketches, axis=1, keepdims=True), 1)
        self._blocks: dict[int, Blocks] = {}
        self._kept = 0
        self.seen = np.zeros(len(docs), bool)
        self.skipped = self.searched = 0

    def blocks(self, term: int) -> Blocks:
        if term not in self._blocks:
            made = Blocks(self, term)
            self._kept += made.summary.size
            while self._kept > KEPT and self._blocks:
                self._kept -= self._blocks.pop(next(iter(self._blocks))).summary.size
            self._blocks[term] = made
        return self._blocks[term]

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of documents with a posting; ``asked`` flags the item's terms."""
        start, end = self.place[docs], self.place[docs + 1]
        at = _ranges(start, end)
        return np.add.reduceat(np.where(asked[self.term[at]], self.value[at], 0), np.cumsum(end - start) - (end - start))

    def search(self, q: int, best: list[tuple[int, bool, int]]) -> list[tuple[int, bool, int]]:
        """The best of ``best`` (score below zero, whether without id, id) and this shard's documents for item ``q``."""
        terms = self.items.terms[q]
        terms = terms[self.largest[terms] > 0]
        terms = terms[np.argsort(-self.largest[terms], kind="stable")]
        rest = np.cumsum(self.largest[terms][::-1])[::-1]
        asked = np.zeros(len(self.items.vocabulary), bool)
        asked[terms] = True
        self.seen[:] = False
        for i, term in enumerate(terms):
            least = -best[-1][0] if len(best) == TOP else 0
            if rest[i] < least:
                break
            blocks = self.blocks(term)
            # Documents of earlier lists were scored or shown to be too low, so those left have only terms from here on.
            bound = blocks.summary[:, np.searchsorted(blocks.columns, terms[i:])].sum(axis=1)
            waiting, step = np.argsort(-bound, kind="stable"), 4
            while len(waiting):
                least = -best[-1][0] if len(best) == TOP else 0
                live = bound[waiting] >= least
                self.skipped += int((~live).sum())
                waiting = waiting[live]
                now, waiting, step = waiting[:step], waiting[step:], 2 * step
                self.searched += len(now)
                docs = blocks.docs[_ranges(blocks.first[now], blocks.first[now + 1])]
                docs = docs[~self.seen[docs]]
                if not len(docs):
                    continue
                self.seen[docs] = True
                score = self.scores(docs, asked)
                high = score >= max(least, 1)
                docs, score = docs[high], score[high]
                order = np.lexsort((self.docs[docs], self.unknown[docs], -score))[:TOP]
                best = sorted([*best, *zip((-score[order]).tolist(), self.unknown[docs[order]].tolist(),
                                           self.docs[docs[order]].tolist())])[:TOP]
        return best


def _shards(batches: Iterator[pa.RecordBatch], items: Items, weight: np.ndarray, documents: int, terms: int) -> Iterator[Shard]:
    def shard(held: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        doc, lists = table.column("doc").combine_chunks(), table.column("terms").combine_chunks()
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        place = np.concatenate([[0], np.cumsum(size)])
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table.column("tfs").combine_chunks().flatten().to_numpy()
        m = np.repeat(length_factors(table.column("n").to_numpy(), documents, terms), size)
        return Shard(items, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), place, term,
                     weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m)))

    held, docs, postings = [], 0, 0
    for batch in batches:
        for a in range(0, len(batch), 1024):
            part = batch.slice(a, 1024)
            held.append(part)
            docs, postings = docs + len(part), postings + len(part.column("terms").flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard(held)
                held, docs, postings = [], 0, 0
    if held:
        yield shard(held)


def _found(vectors: DataFrame, items: Items, weight: np.ndarray, documents: int, terms: int) -> DataFrame:
    """Each task's best documents of every item."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items.ids]
        for shard in _shards(batches, items, weight, documents, terms):
            for q in range(len(items.ids)):
                best[q] = shard.search(q, best[q])
        rows = [(items.ids[q], None if unknown else doc, -score) for q, found in enumerate(best) for score, unknown, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)],
                                         ["item_id", "doc_id", "score"])
        pa.default_memory_pool().release_unused()

    return vectors.where("size(terms) > 0").mapInArrow(work, "item_id long, doc_id long, score long")


def _gathered(terms: DataFrame) -> Items:
    by_item: dict[int | None, list[int]] = {}
    for row in terms.collect():
        by_item.setdefault(row["item"], []).extend(row["terms"])
    return Items(list(by_item), [np.unique(np.array(t, np.int64).view(np.uint64)) for t in by_item.values()])


def ranked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id",
           text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of every item."""
    work = Workspace(docs.sparkSession, "search")
    asked = work.save(item_terms(items, item_key, text).where("size(terms) > 0"), "items")
    pairs = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(pairs / PAIRS))
    found = []
    for b in range(blocks):
        block = _gathered(asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b))
        vectors = work.save(term_vectors(docs, block.vocabulary, doc_key, text), f"vectors-{b}") if block.ids else None
        documents, terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first() if block.ids else (0, 0)
        if documents:
            weight = weights(document_frequencies(vectors, len(block.vocabulary)), documents)
            found.append(f"found-{b}")
            hits = work.save(_found(vectors, block, weight, documents, terms), found[-1])
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return work.read(hits, *found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select(
        "item_id", "rank", "doc_id", "score")


def op13_geometric_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_terms = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

QUERIES = {"op13_geometric_blocking": op13_geometric_blocking}
ORACLES = {"op13_geometric_blocking": f"""WITH
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_terms} AS terms FROM documents),
  f AS MATERIALIZED (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
  s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM f),
  p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) GROUP BY ALL),
  w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, docs),
  q AS (SELECT DISTINCT item_id, unnest({_terms}) AS t FROM benchmark),
  x AS (SELECT item_id, doc_id, r,
          sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
        FROM q JOIN p USING (t) JOIN w USING (t) JOIN f USING (r), s GROUP BY ALL)
  SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
  WHERE rank <= {TOP}"""}
