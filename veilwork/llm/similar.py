"""Near duplicates: Jaccard similarity of five-word shingles, by a MinHash forest.

A text's shingles are its runs of five words (a shorter text is one shingle).
Texts with equal shingle sets are one representative from the start.  Each has
``TREES`` signatures of ``DEPTH`` minima; a tree is the trie of one signature,
and two texts meet in it if they share its first minima.  How many these are is
the longest prefix by which even pairs at the threshold are met with the target
recall, so no pair depends on what else the corpus holds.

Pairs that meet and of whose minima ``AGREEING`` agree (a chance of 1e-6 for a pair
at the threshold not to) form a graph; its components
are the only places where similar texts can be.  There every pair is verified
exactly, in blocks of bounded size, from the texts read again.  A task returns a
count of links and one edge per text, never pairs; large tries, groups and
components are split over many tasks.

Defined results: NULL texts and texts without words are classes of their own
without links; documents with equal sets (exact copies, repeated rows) are
linked to each other; ties do not matter, as classes are components; an empty
table gives an empty table; texts of any length are worked on in pieces of whole
texts.  The class id is its smallest document id (NULL if all are).  Columns added replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, smallest
from .tables import Workspace, arrow_map, read
from .words import Piece, combine, mix, pieces

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
TARGET_RECALL = 0.9995
#: Of the minima, this share must agree for a pair to count: five standard deviations below the threshold.
AGREEING = 0.6
BLOCK = 512
GROUP_ROWS = 5_000

_ROUND = np.random.default_rng(77).integers(1, 1 << 63, (TREES * DEPTH, 2), dtype=np.uint64) | np.uint64(1)
_COLUMNS = 1 << 13


def shingles(piece: Piece, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in order, and where each text's begin."""
    words, counts = piece.hashes(), piece.n_words
    n = len(words)
    rolled = words.copy()
    for step in range(1, min(size, n)):
        rolled[:n - step] = combine(rolled[:n - step], words[step:])
    stop = np.repeat(piece.first[1:], counts)
    full = np.arange(n) + size <= stop
    owner = piece.owner
    hashes, owners = [rolled[full]], [owner[full]]
    for length in range(1, size):  # short texts are one shingle of all their words
        at = piece.first[:-1][counts == length]
        h = words[at] if len(at) else np.zeros(0, np.uint64)
        for step in range(1, length):
            h = combine(h, words[at + step])
        hashes.append(mix(h + np.uint64(length)))
        owners.append(np.flatnonzero(counts == length))
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(len(piece) + 1))


def _set_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two signed integers per text."""
    out = []
    for salt in (0x1234567, 0x7654321):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[first[1:]] - total[first[:-1]] + np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def _minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of every text under all hash functions (32 bits each); texts without shingles get zeros."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, len(_ROUND)), np.uint32)
    if len(full):
        for k, (a, b) in enumerate(_ROUND):
            h = hashes * a
            h += b
            h >>= np.uint64(32)
            out[full, k] = np.minimum.reduceat(h.astype(np.uint32), first[:-1][full])
    return out


def _bytes(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix)
    width = flat.shape[1] * flat.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _matrix(column: pd.Series, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def signed(docs: DataFrame) -> DataFrame:
    """``key, text_hash, set1, set2, size, minima`` of every document; no words: NULL set."""
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in pieces(batch.column(2)):
            part = batch.slice(piece.rows.start, len(piece))
            hashes, first = shingles(piece)
            none = first[1:] == first[:-1]
            set1, set2 = _set_keys(hashes, first)
            yield {"key": part.column(0), "text_hash": part.column(1), "set1": pa.array(set1, mask=none),
                   "set2": pa.array(set2, mask=none), "size": np.diff(first), "minima": _bytes(_minima(hashes, first))}

    return arrow_map(docs.select("key", "text_hash", "text"),
                     "key long, text_hash long, set1 long, set2 long, size long, minima binary", work)


def _met(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """Chance that a pair shares a prefix of this depth in one of the trees."""
    return 1 - (1 - similarity ** depth) ** TREES


def _prefixes(reps: DataFrame, depth: int) -> DataFrame:
    """``rep, size, keys, prefixes, sketch``: hashes of tree and prefix for all trees, eight bits of every minimum."""
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        minima = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
        keys = np.broadcast_to(np.arange(TREES, dtype=np.uint64), minima.shape[:2])
        for level in range(depth):
            keys = combine(keys, minima[:, :, level].astype(np.uint64))
        yield {"rep": batch.column(0), "size": batch.column(1), "keys": _bytes(keys.view(np.int64)),
               "prefixes": list(keys.view(np.int64)),
               "sketch": _bytes(minima.reshape(len(minima), -1).astype(np.uint8))}

    return arrow_map(reps.select("rep", "size", "minima"),
                     "rep long, size long, keys binary, prefixes array<long>, sketch binary", work)


def _cells(members: DataFrame, group: list[str], count: str, rows: int) -> DataFrame:
    """Split groups into blocks, give each pair of blocks a cell, and put small cells together in batches.

    Adds ``low, high`` (the cell's blocks), ``block`` (the row's own) and
    ``batch``, by which rows meet.
    """
    blocks = F.ceil(F.col(count) / BLOCK)
    own = F.pmod(F.xxhash64("rep"), blocks)
    name = F.xxhash64(*group)
    spread = F.when(blocks == 1, F.pmod(name, F.lit(max(1, rows // GROUP_ROWS)))).otherwise(
        F.xxhash64(name, "low", "high"))
    return (members.withColumn("block", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
            .withColumn("alone", blocks > 1).withColumn("batch", spread).drop("other"))


def _pairs(run: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within each run (sorted ids); in a cell of two blocks only pairs across."""
    last = np.searchsorted(run, run, "right")
    each = last - np.arange(len(run)) - 1
    left = np.repeat(np.arange(len(run)), each)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + left + 1
    across = (low[left] == high[left]) | (block[left] != block[right])
    return left[across], right[across]


def _meetings(frame: pd.DataFrame) -> pd.DataFrame:
    """Edges within cells, from a text to the smallest place of its part."""
    frame = frame.sort_values(["prefix", "low", "high"], kind="stable", ignore_index=True)
    run = frame.groupby(["prefix", "low", "high"], sort=False).ngroup().to_numpy()
    keys, sketch = _matrix(frame["keys"], np.int64), _matrix(frame["sketch"], np.uint8)
    size, rep = frame["size"].to_numpy(), frame["rep"].to_numpy()
    tree = (keys == frame["prefix"].to_numpy()[:, None]).argmax(axis=1)
    lefts, rights = [], []
    left, right = _pairs(run, frame["block"].to_numpy(), frame["low"].to_numpy(), frame["high"].to_numpy())
    for a in range(0, len(left), 1 << 16):
        x, y = left[a:a + (1 << 16)], right[a:a + (1 << 16)]
        fits = np.minimum(size[x], size[y]) >= THRESHOLD * np.maximum(size[x], size[y])
        x, y = x[fits], y[fits]
        first = (keys[x] == keys[y]).argmax(axis=1) == tree[x]  # met here before any other tree
        x, y = x[first], y[first]
        close = (sketch[x] == sketch[y]).sum(axis=1) >= AGREEING * sketch.shape[1]
        lefts.append(x[close])
        rights.append(y[close])
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    root = smallest(len(run), left, right)
    tied = np.flatnonzero(root != np.arange(len(run)))
    return pd.DataFrame({"a": rep[tied], "b": rep[root[tied]]})


def _meet(reps: DataFrame, work: Workspace) -> DataFrame:
    """Edges between texts that may be similar, from the deepest prefix with the target recall at the threshold."""
    depth = next((d for d in range(DEPTH, 1, -1) if _met(THRESHOLD, d) >= TARGET_RECALL), 1)
    known = _prefixes(reps, depth)
    places = known.select("rep", F.explode("prefixes").alias("prefix"))
    shared = places.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    members = work.save(places.join(shared, "prefix"), "members")
    cells = _cells(members, ["prefix"], "n", members.count()).join(known.drop("prefixes"), "rep")
    return work.save(cells.groupBy("batch", "alone").applyInPandas(_meetings, "a long, b long"), "met")


def _jaccard(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether pairs of sets reach the threshold, exactly: common members by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    column, _ = pd.factorize(np.concatenate(sets))
    often = np.bincount(column)[column] > 1
    column, member = pd.factorize(column[often])[0], member[often]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, [a, a + _COLUMNS]))
        matrix = np.zeros((len(sets), min(_COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        matrix[member[part], column[part] - a] = 1
        common += matrix @ matrix.T
    both = common[left, right].astype(np.int64)
    return both * 10 >= round(THRESHOLD * 10) * (sizes[left] + sizes[right] - both)


def _verify(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of each text within its cells, counting copies, and an edge to its part of the cell."""
    frame = frame.sort_values(["label", "low", "high"], kind="stable", ignore_index=True)
    out = []
    for _, cell in frame.groupby(["label", "low", "high"], sort=False):
        sets = [np.frombuffer(s, np.uint64) for s in cell["shingles"]]
        left, right = _pairs(np.zeros(len(cell), int), *(cell[c].to_numpy() for c in ("block", "low", "high")))
        linked = _jaccard(sets, left, right)
        left, right = left[linked], right[linked]
        rep, copies = cell["rep"].to_numpy(), cell["copies"].to_numpy()
        links = np.zeros(len(cell), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        out.append(pd.DataFrame({"rep": rep, "root": rep[smallest(len(cell), left, right)], "links": links}))
    return pd.concat(out, ignore_index=True)


def _with_shingles(docs: DataFrame) -> DataFrame:
    """Shingle sets of the texts of chosen representatives (columns ``text, rep, set1, set2``, others go)."""
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in pieces(batch.column(0)):
            rows = batch.slice(piece.rows.start, len(piece))
            hashes, first = shingles(piece)
            set1, set2 = _set_keys(hashes, first)
            right = (rows.column(2).to_numpy() == set1) & (rows.column(3).to_numpy() == set2)
            yield {"rep": rows.column(1), "right": right,
                   "shingles": [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]}

    return arrow_map(docs, "rep long, right boolean, shingles binary", work).where("right").drop("right").dropDuplicates(
        ["rep"])


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("key"),
                       F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))


def _classes(plain: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The shingle sets of all documents, and of each different set its class, its links and its first document."""
    sets = work.save(signed(plain), "sets")
    reps = work.save(
        sets.where("set1 IS NOT NULL").groupBy("set1", "set2").agg(
            F.count("*").alias("copies"), F.min("key").alias("least"), F.first("size").alias("size"),
            F.first("minima").alias("minima"), F.min(F.struct("key", "text_hash")).alias("source"))
        .withColumn("rep", F.monotonically_increasing_id()), "reps")
    candidates = components(_meet(reps, work), work, "candidates")
    chosen = work.save(
        candidates.join(candidates.groupBy("label").agg(F.count("*").alias("n")), "label")
        .join(reps.select("set1", "set2", "copies", "source", "rep"), F.col("node") == F.col("rep")).drop("node"), "chosen")
    source = chosen.select("rep", "set1", "set2", "source.*")
    # By sorting at any size: the texts are as many as the documents, the chosen ones grow with them.
    again = plain.alias("d").join(source.alias("s").hint("merge"), F.expr("d.key <=> s.key AND d.text_hash = s.text_hash")).select(
        "d.text", "rep", "set1", "set2")
    known = work.save(_with_shingles(again), "shingles")
    cells = _cells(chosen.select("rep", "label", "n", "copies"), ["label"], "n", chosen.count()).join(known, "rep")
    links = work.save(cells.groupBy("batch", "alone").applyInPandas(_verify, "rep long, root long, links long"), "links")
    labels = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), work, "classes")
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classed = reps.select("rep", "set1", "set2", "copies", "least", "source").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left").select(
        "set1", "set2", "least", "source", F.coalesce("label", "rep").alias("class"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sets, work.save(classed, "classed")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` (the key), ``class_id`` and ``n_links`` (other documents at the threshold or above) of every document."""
    sets, classed = _classes(_plain(docs, key, text), Workspace(docs.sparkSession, "similar"))
    found = classed.join(classed.groupBy("class").agg(F.min("least").alias("class_id")), "class")
    member = sets.select("key", "set1", "set2").join(
        found.select("set1", "set2", "class", "class_id", "n_links"), ["set1", "set2"], "left")
    return member.select(F.col("key").alias("doc_id"),
                         F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
                         F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id (NULL first); columns unchanged."""
    plain = _plain(docs, key, text)
    _, classed = _classes(plain, Workspace(docs.sparkSession, "similar"))
    first = classed.groupBy("class").agg(F.min("source").alias("source")).select("source.*")
    some_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = plain.where(some_word).alias("d").join(
        first.alias("s"), F.expr("d.key <=> s.key AND d.text_hash = s.text_hash")).select("d.*")
    kept = kept.dropDuplicates(["key", "text_hash"])  # rows repeated as they are
    return kept.select("row.*").unionByName(plain.where(~some_word).select("row.*"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_minhash_forest": op4_minhash_forest}
ORACLES = {"op4_minhash_forest": f"""WITH RECURSIVE
  w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT r, h FROM (SELECT r, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) END) AS h FROM w)),
  n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.r < b.r GROUP BY ALL),
  l AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y
    WHERE 10 * k >= {round(THRESHOLD * 10)} * (a.n + b.n - k)),
  e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  reach AS (SELECT r, r AS other FROM w UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.other)
  SELECT w.doc_id, (SELECT min(o.doc_id) FROM reach JOIN w o ON o.r = reach.other WHERE reach.r = w.r) AS class_id,
    (SELECT count(*) FROM e WHERE e.x = w.r) AS n_links FROM w"""}
