"""Nearest neighbours by largest inner product, with a permutation index.

Each vector is represented by the order of its nearest pivots by angle, queries
and rows alike, and by its length.  The footrule distance between two orders
(places differ by how much, summed over the pivots) stands for a cosine; a row
of length ``l`` ranks by that cosine less ``t / l``, where ``t`` is the product
that a query's nearest reach, so short rows must lie at a smaller angle.  The
first rows of that ranking are reranked by the exact product in double
precision.

Vectors are posted in the files of their first ``POSTED`` pivots, long ones in a
common file; a query probes the common file and those of its own first pivots.
How large a share of all vectors is reranked (``LEAST_KEPT`` vectors at least),
and from which length on vectors are in the common file, is chosen so
that a bounded sample of queries finds ``TARGET_RECALL`` of its true nearest in
a bounded sample of vectors, as many of them as the sample has of the ``k``.  If
need be that is all vectors.  The products that the share and ``t`` stand for
are read off the same sample, for each query.

Files and their queries are cut into blocks by hash, so no task holds a whole
file; equal vectors are indexed once and carry their smallest ids, of which no
more than ``k + 1`` can ever be answers.  Pivots and samples are bounded, every
vector is indexed.  ``recall`` measures against brute force.

Defined results: rows whose vector is NULL, empty, zero or has NULL or
non-finite components, whose id is NULL, or whose dimension is not the commonest
(the largest of equally common ones) take no part; a row repeated with its id
counts once; ties go to the smaller id; with fewer candidates than ``k`` all are
returned; an empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, read

PIVOTS = 128
POSTED = 16
LEAST_KEPT = 1500
SAMPLE = 4096
#: Queries that measure the index, the share of true neighbours it must find, and the share that the ranking must keep.
TRIALS = 256
TARGET_RECALL = 0.95
RANKED_RECALL = 0.97
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 512
#: The common file has about as many blocks as there are files of pivots, of this many vectors at least.
COMMON, COMMON_VECTORS = -1, 256


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v`` of the rows that take part."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"),
                          F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v")).where(
        F.col("id").isNotNull() & good)
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1)
    size = common.head()
    return rows.where(F.size("v") == (size["size"] if size else 0))


class Index:
    """Pivots, a sample and what was measured on it, as arrays small enough to send along."""

    def __init__(self, vectors: np.ndarray, trials: np.ndarray, k: int, pivots: int, posted: int, total: int):
        self.lengths, directions = polar(vectors)
        self.directions = directions
        self.pivots = directions[:pivots]
        self.posted = min(posted, len(self.pivots))
        self.sample = self.places(self.order(directions))
        self.wanted = min(len(vectors), -(-k * len(vectors) // max(total, 1)))
        own, asked = polar(trials)
        near = self.places(self.order(asked))
        far = np.array([footrule(self.sample, p) for p in near], np.int64).reshape(len(asked), len(vectors))
        self.cosines = self._cosines(far, asked @ directions.T)
        self.share, self.long = self._measured(far, near, own, asked, LEAST_KEPT / max(total, 1))

    def order(self, directions: np.ndarray) -> np.ndarray:
        return np.argsort(-(directions @ self.pivots.T), axis=1, kind="stable")

    @staticmethod
    def places(order: np.ndarray) -> np.ndarray:
        """The place of every pivot in the order of each vector."""
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None], 1)
        return out.astype(np.int16)

    def posts(self, lengths: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        """The files of each vector."""
        common = np.array([COMMON], np.int32)
        return [common if a >= self.long else o for a, o in zip(lengths, order[:, :self.posted].astype(np.int32))]

    def _cosines(self, far: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """The mean cosine at every footrule distance, which never grows with it."""
        far, cosines = far.ravel(), cosines.ravel()
        order = np.argsort(far, kind="stable")[np.count_nonzero(far == 0):]
        parts = [p for p in np.array_split(order, max(1, min(200, len(order) // 20))) if len(p)]
        x, y = [0.0, *(far[p].mean() for p in parts)], [1.0, *(cosines[p].mean() for p in parts)]
        return np.interp(np.arange(len(self.pivots) ** 2 // 2 + 1), x, np.minimum.accumulate(y))

    def reach(self, lengths: np.ndarray, directions: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the product that its nearest reach, and the rank within which the wanted share of all vectors lies."""
        product, rank = np.zeros(len(places)), np.full(len(places), -np.inf)
        at = min(len(self.sample), int(np.ceil(self.share * len(self.sample))))
        for i, (a, d, p) in enumerate(zip(lengths, directions, places)):
            product[i] = self.product(*self.others(a, d))
            if self.share < 1:
                ranks = ranked(self.cosines, footrule(self.sample, p), self.lengths, product[i])
                rank[i] = np.partition(ranks, len(ranks) - at)[len(ranks) - at]
        return product, rank

    def others(self, length: float, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sample without a query's own vector, and its products with the query's direction."""
        cosines = self.directions @ direction
        own = (cosines > 1 - 1e-12) & (np.abs(self.lengths - length) <= 1e-12 * length)
        return np.flatnonzero(~own), (cosines * self.lengths)[~own]

    def product(self, others: np.ndarray, products: np.ndarray) -> float:
        """What the nearest of a query of length 1 reach."""
        at = max(0, len(others) - self.wanted)
        return float(np.partition(products, at)[at]) if len(others) else 0.0

    def _measured(self, far: np.ndarray, near: np.ndarray, own: np.ndarray, asked: np.ndarray,
                  least: float) -> tuple[float, float]:
        """The share to rerank, and the length from which vectors go to the common file."""
        behind, met, lengths = [], [], []
        for f, p, a, d in zip(far, near, own, asked):
            others, products = self.others(a, d)
            true = others[np.argsort(-products, kind="stable")[:self.wanted]]
            ranks = ranked(self.cosines, f, self.lengths, self.product(others, products))
            behind.append(len(ranks) - np.searchsorted(np.sort(ranks), ranks[true]))  # itself and all that rank as high
            met.append((self.sample[true][:, p < self.posted] < self.posted).any(axis=1))
            lengths.append(self.lengths[true])
        if not sum(map(len, behind)):
            return min(1.0, least), -np.inf
        behind, met, lengths = np.concatenate(behind), np.concatenate(met), np.concatenate(lengths)
        at = int(np.ceil(RANKED_RECALL * len(behind))) - 1
        share = min(1.0, max(least, np.partition(behind, at)[at] / len(self.sample)))
        kept = behind <= np.ceil(share * len(self.sample))
        lost = np.sort(lengths[kept & ~met])[::-1]
        more = int(np.ceil(TARGET_RECALL * len(behind))) - np.count_nonzero(kept & met)
        return share, lost[more - 1] if more > 0 else np.inf


def polar(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions."""
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    scaled = vectors / largest
    norm = np.linalg.norm(scaled, axis=1, keepdims=True)
    return (largest * norm)[:, 0], scaled / norm


def ranked(cosines: np.ndarray, far: np.ndarray, lengths: np.ndarray, product: float) -> np.ndarray:
    """Rank of rows, the larger the likelier a nearest neighbour: how far the estimated cosine lies above the needed one."""
    return cosines[far] - product / lengths


def footrule(places: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.abs(places - query).sum(axis=1, dtype=np.int64)


def _matrix(column: pd.Series, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def _represent(rows: DataFrame, index: Index, queries: bool) -> DataFrame:
    """``rep, least, v, places, posts`` (bytes; posts as an array) with rows' ``length``, or queries' ``product, reach``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.iloc[a:a + 1024]
                v = np.stack(part["v"].to_numpy()).astype(np.float64)
                lengths, directions = polar(v)
                order = index.order(directions)
                places = index.places(order)
                out = pd.DataFrame({
                    "rep": part["rep"].to_numpy(), "least": part["least"].to_numpy(),
                    "v": [x.tobytes() for x in v], "places": [x.tobytes() for x in places]})
                if queries:
                    out["posts"] = list(np.insert(order[:, :index.posted], 0, COMMON, axis=1).astype(np.int32))
                    out["product"], out["reach"] = index.reach(lengths, directions, places)
                else:
                    out["posts"] = index.posts(lengths, order)
                    out["length"] = lengths
                yield out

    return rows.select("rep", "least", "v").mapInPandas(
        run, "rep long, least long, v binary, places binary, posts array<int>, "
             + ("product double, reach double" if queries else "length double"))


def _search(posted: int, k: int, cosines: np.ndarray):
    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(x) and len(q):
            places, vectors = _matrix(x["places"], np.int16), _matrix(x["v"], np.float64)
            reps, least, lengths = x["rep"].to_numpy(), x["least"].to_numpy(), x["length"].to_numpy()
            for rep, own, v, nth, product, reach in zip(
                    q["rep"], _matrix(q["places"], np.int16), _matrix(q["v"], np.float64), q["nth"], q["product"],
                    q["reach"]):
                earlier = np.flatnonzero(own < nth)  # none in the common file, whose vectors are in no other
                near = np.flatnonzero((places[:, earlier] >= posted).all(axis=1))
                if reach > -np.inf:
                    near = near[ranked(cosines, footrule(places[near], own), lengths[near], product) >= reach]
                score = vectors[near] @ v
                best = np.lexsort((least[near], -score))[:k + 1]
                found.append(pd.DataFrame({"query": rep, "rep": reps[near[best]], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "rep": [], "score": []})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            pivots: int = PIVOTS, posted: int = POSTED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each usable row where ``queries`` holds.

    ``queries`` is a condition on ``id``, the row's id.
    """
    work = Workspace(vectors.sparkSession, "nearest")
    rows = work.save(usable(vectors, key, vector).distinct(), "rows")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    reps = work.save(
        rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(
            F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.monotonically_increasing_id().alias("rep"), "v", "ids", F.col("ids")[0].alias("least")), "reps")
    asked = work.save(rows.where(queries).join(reps.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep"),
                      "asked")
    total = reps.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = reps.join(asked.select("rep").distinct(), "rep", "left_semi")
    sample, trials = (np.array([r.v for r in rows.orderBy(F.xxhash64("v"), "least").limit(most).select("v").collect()],
                               np.float64) for rows, most in ((reps, max(SAMPLE, pivots)), (wanted, TRIALS)))
    index = Index(sample, trials.reshape(len(trials), sample.shape[1]), k, pivots, posted, total)
    posts = work.save(_represent(reps, index, False), "posts").withColumn("pivot", F.explode("posts"))
    probes = work.save(_represent(wanted, index, True), "probes").select(
        "*", F.posexplode("posts").alias("nth", "pivot")).withColumn("nth", F.col("nth") - 1)
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_VECTORS), F.when(
        F.col("pivot") == COMMON, F.least(F.ceil(F.count("*") / COMMON_VECTORS), F.lit(pivots))))
    blocks = posts.groupBy("pivot").agg(parts.alias("parts")).join(
        probes.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("query_parts")), "pivot")
    blocks = F.broadcast(blocks)  # at most one row per pivot
    spread = F.xxhash64("rep")
    here = posts.join(blocks, "pivot").select(
        "rep", "least", "v", "places", "length", "pivot", F.pmod(spread, "parts").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts") - 1)).alias("query_part"))
    ask = probes.join(blocks, "pivot").select(
        "rep", "v", "places", "product", "reach", "nth", "pivot", F.pmod(spread, "query_parts").alias("query_part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    on = ["pivot", "part", "query_part"]
    found = here.groupBy(*on).cogroup(ask.groupBy(*on)).applyInPandas(
        _search(index.posted, k, index.cosines), "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = found.join(reps.select("rep", "ids"), "rep").select(
        "query", "score", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(best)).where(
        F.col("nth") <= k + 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.join(asked.withColumnRenamed("rep", "query"), "query").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def recall(found: DataFrame, vectors: DataFrame, queries: list[int], k: int = 20, key: str = "vec_id",
           vector: str = "embedding") -> float:
    """Share of the true ``k`` nearest of some queries (a bounded list of ids) that was found."""
    rows = usable(vectors, key, vector).distinct()
    asked = rows.where(F.col("id").isin(queries)).collect()
    ids, matrix = np.array([r.id for r in asked]), np.array([r.v for r in asked], np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = np.stack(batch["v"].to_numpy()) @ matrix.T
            for j, query in enumerate(ids):
                other = np.flatnonzero(batch["id"].to_numpy() != query)
                best = other[np.lexsort((batch["id"].to_numpy()[other], -scores[other, j]))[:k]]
                yield pd.DataFrame({"query_id": query, "vec_id": batch["id"].to_numpy()[best], "score": scores[best, j]})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = rows.mapInPandas(run, "query_id long, vec_id long, score double").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return true.join(found, ["query_id", "vec_id"], "left_semi").count() / max(1, true.count())


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op6_permutation_index": op6_permutation_index}
ORACLES: dict[str, str] = {}
