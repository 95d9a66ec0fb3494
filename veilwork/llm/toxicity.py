"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are words, sequences are sentences; each token is toxic or not.  Labels
exist for documents only, so tokens are labelled by the smallest set of word and
prefix features that explains the toxic documents of the sample: features that
hardly occur in clean ones, chosen greedily until every toxic document is
covered ``COVER`` times.  The field is then trained on those tokens by Adam;
its features are the word, its beginnings and ending and its neighbours, hashed
into one table.  Forward and backward recursions give the chance of every token;
their largest and their sum give the score of a document by a logistic curve
fitted to the labels of the sample.

The sample has at most ``TOXIC_TEXTS`` toxic documents and ``CLEAN_TIMES`` as
many clean ones, chosen by a hash of the id.  Of a text of more characters than
``EXCERPTS`` times ``EXCERPT_CHARS`` it has that many excerpts of that length,
spread evenly and cut out by the tasks, so what the driver gets is bounded
however long the texts are; it holds about 100 bytes a token.  The field learns from all sentences with a marked
token and at most eight times as many others (``LEAST_OTHERS`` at least), cut
after ``MAX_TRAINING_SEQUENCE`` tokens.  Everything else covers all documents.
Whole texts are scored, in pieces of whole texts, so memory follows the longest
text; time follows the longest sentence, as its tokens come one after the other.

Defined results: NULL and empty texts score as documents without toxic words; a
label that is NULL teaches nothing, of several for one id the largest counts;
without both classes among the labels every score is 0; repeated rows score
alike; an empty table gives an empty table.  The columns added replace input
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import arrow_map, held_out, read
from .words import Piece, combine, mix, pieces

FOLDS, FOLD = 5, 0
#: Documents of the sample: of the toxic class, and how many times as many clean ones.
TOXIC_TEXTS = 800
CLEAN_TIMES = 2
#: Excerpts that stand for a longer text while learning, and the characters of each.
EXCERPTS, EXCERPT_CHARS = 4, 4096
COVER = 10
#: A feature marks tokens if its share among toxic texts is this many times that among clean ones, more than chance
#: allows for as many features, and if it occurs between this many different pairs of words there (what one passage
#: repeats proves nothing).
LEAST_RATIO = 10.0
LEAST_CONTEXTS = 5
TABLE_BITS = 22
PREFIXES = (3, 4, 5, 6)
SUFFIX = 4
MAX_TRAINING_SEQUENCE = 64
OTHERS_TIMES, LEAST_OTHERS = 8, 4000
EPOCHS = 8
LEAST_STEPS = 150
RATE = 0.05
DECAY = 1e-4
SPAN = 0.5

_BATCH = 256
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"')(]}[{")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True
_SLOTS = 1 + len(PREFIXES) + 1 + 2
_COLUMN, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _features(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word, beginnings and ending of each token (columns), and whether a token begins a sentence."""
    starts, ends = piece.starts, piece.ends.copy()
    for _ in range(3):
        ends -= _MARKS[piece.buf[ends - 1]] & (ends - starts > 1)
    begins = starts + (_MARKS[piece.buf[starts]] & (ends - starts > 1))
    out = np.empty((len(starts), 2 + len(PREFIXES)), np.uint64)
    out[:, 0] = piece.spans(begins, ends)
    for k, length in enumerate(PREFIXES, 1):
        out[:, k] = piece.spans(begins, np.minimum(begins + length, ends)) + np.uint64(k)
    out[:, -1] = piece.spans(np.maximum(ends - SUFFIX, begins), ends) + np.uint64(99)
    opens = np.zeros(len(starts), bool)
    if len(starts):
        opens[piece.first[:-1][piece.n_words > 0]] = True
        opens[1:] |= _STOPS[piece.buf[piece.ends[:-1] - 1]]
        feeds = np.concatenate([[0], np.cumsum(piece.buf == 10, dtype=np.int64)])[starts]
        opens[1:] |= feeds[1:] > feeds[:-1]
    return out, opens


def _slots(features: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Places in the weight table: own features, then the words before and after in the sentence."""
    word = features[:, 0]
    before, after = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    if len(word):
        before[1:] = np.where(opens[1:], 0, word[:-1])
        after[:-1] = np.where(opens[1:], 0, word[1:])
    out = np.empty((len(word), _SLOTS), np.int32)
    for k, column in enumerate((*features.T, before, after)):
        out[:, k] = mix(column + np.uint64(_COLUMN * (k + 1) & _MASK)) >> np.uint64(64 - TABLE_BITS)
    return out


def marginals(odds: np.ndarray, opens: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of each token to be toxic, and the forward and backward ratios behind it.

    ``odds`` are ``exp`` of a token's own score, ``steps[a, b]`` of that of state
    ``b`` after ``a``.  With two states the recursions need one ratio per token;
    sequences advance side by side, the longest first.
    """
    n = len(odds)
    forward, backward = odds.astype(np.float64), np.ones(n)
    begin = np.flatnonzero(opens)
    length = np.diff(np.concatenate([begin, [n]]))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")  # longer than t
    (a00, a01), (a10, a11) = steps
    for t in range(1, len(active)):
        at = begin[:active[t]] + t
        r = forward[at - 1]
        forward[at] = np.clip(odds[at] * (a01 + r * a11) / (a00 + r * a10), 1e-100, 1e100)
    for t in range(len(active) - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        q = odds[at + 1] * backward[at + 1]
        backward[at] = np.clip((a10 + a11 * q) / (a00 + a01 * q), 1e-100, 1e100)
    both = np.clip(forward * backward, 1e-200, 1e200)
    return both / (1 + both), forward, backward


@dataclass
class Model:
    table: np.ndarray
    steps: np.ndarray  # logarithms, state after state
    curve: np.ndarray  # weights of (1, log odds of the largest chance, log of 1 + their sum)

    def tokens(self, features: np.ndarray, opens: np.ndarray) -> np.ndarray:
        own = self.table[_slots(features, opens)].sum(axis=1) if len(opens) else np.zeros(0)
        return marginals(np.exp(np.clip(own, -60, 60)), opens, np.exp(self.steps))[0]

    def documents(self, chances: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each text from its tokens' chances."""
        return 1 / (1 + np.exp(-np.clip(_evidence(chances, first) @ self.curve, -30, 30)))


def _evidence(chances: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    top = np.full(n, 1e-6)
    np.maximum.at(top, owner, chances)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    total = np.bincount(owner, np.where(chances > 0.01, chances, 0), minlength=n)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(total)], axis=1)


def mark_tokens(features: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic texts that carry one of the explaining features."""
    n_texts = np.bincount(toxic.astype(int), minlength=2)
    short = (features >> np.uint64(32)).astype(np.uint32)
    pairs = np.concatenate([np.unique(owner.astype(np.uint64) << np.uint64(32) | column) for column in short.T])
    text, (feature, keys) = (pairs >> np.uint64(32)).astype(np.int64), pd.factorize(pairs.astype(np.uint32))
    bad = np.bincount(feature[toxic[text]], minlength=len(keys))
    clean = np.bincount(feature, minlength=len(keys)) - bad
    ratio = (bad / n_texts[1]) / ((clean + 0.5) / n_texts[0])
    around = combine(np.roll(features[:, 0], 1), np.roll(features[:, 0], -1)) >> np.uint64(32)
    in_toxic = toxic[owner]
    meets = np.concatenate([np.unique(column[in_toxic].astype(np.uint64) << np.uint64(32) | around[in_toxic])
                            for column in short.T]) >> np.uint64(32)
    contexts = np.bincount(pd.Index(keys).get_indexer(meets.astype(np.uint32)), minlength=len(keys))
    share = n_texts[1] / n_texts.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = bad * np.log(bad / ((bad + clean) * share)) + np.where(
            clean > 0, clean * np.log(clean / ((bad + clean) * (1 - share))), 0)
    able = (ratio >= LEAST_RATIO) & (contexts >= LEAST_CONTEXTS) & (surprise >= np.log(len(keys)))
    use = able[feature] & toxic[text]
    text, (feature, keys) = text[use], pd.factorize(keys[feature[use]])
    missing = np.where(toxic, COVER, 0)
    chosen: list[int] = []
    unused = np.ones(len(keys), bool)
    while len(keys):
        open_pairs = missing[text] > 0
        gain = np.bincount(feature[open_pairs], minlength=len(keys)) * unused
        best = int(gain.argmax())
        if not gain[best]:
            break
        chosen.append(best)
        unused[best] = False
        missing[text[(feature == best) & open_pairs]] -= 1
    return np.isin(short, keys[chosen]).any(axis=1) & toxic[owner]


def train(slots: np.ndarray, opens: np.ndarray, tags: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weight table and transitions, by maximum likelihood of the tags (Adam on batches of sequences)."""
    rng = np.random.default_rng(seed)
    table, steps = np.zeros(1 << TABLE_BITS, np.float32), np.array([[1.0, -1.0], [0.0, 0.0]])
    begin = np.flatnonzero(opens)
    end = np.concatenate([begin[1:], [len(opens)]])
    marked = np.add.reduceat(tags, begin) > 0 if len(begin) else np.zeros(0, bool)
    others = np.flatnonzero(~marked)
    others = rng.permutation(others)[:max(OTHERS_TIMES * int(marked.sum()), LEAST_OTHERS)]
    use = np.concatenate([np.flatnonzero(marked), others])
    squares, mean = np.zeros_like(table), np.zeros_like(table)
    step_mean, step_squares, rounds = np.zeros((2, 2)), np.zeros((2, 2)), 0
    batches = max(1, len(use) // _BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches))):
        for part in np.array_split(rng.permutation(use), batches):
            length = end[part] - begin[part]
            first = np.repeat(np.cumsum(length) - length, length)
            at = np.repeat(begin[part], length) + np.arange(length.sum()) - first
            start = np.zeros(len(at), bool)
            start[np.cumsum(length) - length] = True
            odds = np.exp(np.clip(table[slots[at]].sum(axis=1), -60, 60))
            trans = np.exp(steps)
            p, forward, backward = marginals(odds, start, trans)
            y = tags[at].astype(float)
            inner = np.flatnonzero(~start)
            prev = forward[inner - 1]
            next_ = odds[inner] * backward[inner]
            joint = np.stack([np.full(len(inner), trans[0, 0]), trans[0, 1] * next_, trans[1, 0] * prev,
                              trans[1, 1] * prev * next_])
            joint /= joint.sum(axis=0)
            seen = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4)
            step_slope = ((joint.sum(axis=1) - seen) / len(part)).reshape(2, 2)
            flat = slots[at]
            touched, place = np.unique(flat, return_inverse=True)
            slope = np.bincount(place.ravel(), np.repeat((p - y) / len(part), _SLOTS)) + DECAY * table[touched]
            rounds += 1
            mean[touched] += 0.1 * (slope - mean[touched])
            squares[touched] += 0.01 * (slope ** 2 - squares[touched])
            table[touched] -= RATE * mean[touched] / (np.sqrt(squares[touched]) + 1e-6)
            step_mean += 0.1 * (step_slope - step_mean)
            step_squares += 0.01 * (step_slope ** 2 - step_squares)
            steps -= RATE * step_mean / (np.sqrt(step_squares) + 1e-6)
    return table, steps


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a slightly regularised logistic curve, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.diag([1e-6] + [0.05] * (len(w) - 1))
        slope = x.T @ (p - y) + penalty @ w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), slope)
    return w


def excerpts(text: Column) -> Column:
    """The text, or lines that are excerpts of a longer one: its beginning, its end, and what lies evenly between."""
    size = F.length(text)
    apart = (size - EXCERPT_CHARS) / (EXCERPTS - 1)
    parts = [F.substring(text, F.floor(apart * k).cast("int") + 1, F.lit(EXCERPT_CHARS)) for k in range(EXCERPTS)]
    return F.when(size <= EXCERPTS * EXCERPT_CHARS, text).otherwise(F.concat_ws("\n", *parts))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
        toxic_texts: int = TOXIC_TEXTS) -> Model | None:
    """Train on at most ``toxic_texts`` toxic documents and ``CLEAN_TIMES`` as many others; None unless both occur.

    The sample is drawn among ids, and its bounded list of them fetches the texts, or excerpts of long ones.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(
        F.max(toxic).cast("int").alias("toxic"))
    known = known.join(docs.where(F.length(text) > 0).select(key).distinct(), key, "left_semi")
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64(key), key).limit(n)
             for c, n in ((0, CLEAN_TIMES * toxic_texts), (1, toxic_texts))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # as many rows as the two limits allow
    found = docs.select(key, F.col(text).alias("text")).join(chosen, key).where(F.length("text") > 0).select(
        excerpts(F.col("text")).alias("text"), "toxic").dropDuplicates(["text"]).orderBy(F.xxhash64("text"), "text").toArrow()
    labels = found.column("toxic").to_numpy().astype(bool)
    if labels.all() or not labels.any():
        return None
    features, opens, owner, counts = [], [], [], []
    for piece in pieces(found.column("text").combine_chunks(), lower=True):
        f, o = _features(piece)
        features.append(f)
        opens.append(o)
        owner.append(piece.rows.start + piece.owner)
        counts.append(piece.n_words)
    features, opens, owner = np.concatenate(features), np.concatenate(opens), np.concatenate(owner)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    tags = mark_tokens(features, owner, labels)
    slots = _slots(features, opens)
    cut = opens.copy()
    at = np.arange(len(cut))
    cut |= (at - np.maximum.accumulate(np.where(opens, at, 0))) % MAX_TRAINING_SEQUENCE == 0
    table, steps = train(slots, cut, tags)
    model = Model(table, steps, np.zeros(3))
    model.curve = _logistic(_evidence(model.tokens(features, opens), first), labels.astype(float))
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", span: float = SPAN) -> DataFrame:
    """Add ``score``, ``predicted`` and ``spans`` (code-point offsets of tokens with a chance of ``span`` or more)."""
    added = StructType.fromDDL("score double, predicted int, spans array<struct<start: long, end: long>>")
    docs = docs.drop(*added.names)
    at, names = docs.columns.index(text), docs.columns

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in pieces(batch.column(at), lower=True):
            rows = batch.slice(piece.rows.start, piece.rows.stop - piece.rows.start)
            if model is None:
                points, hits = np.zeros(len(piece)), np.zeros(0, np.int64)
            else:
                chances = model.tokens(*_features(piece))
                points, hits = model.documents(chances, piece.first), np.flatnonzero(chances >= span)
            place = np.concatenate([[0], np.cumsum((piece.buf & 0xC0) != 0x80, dtype=np.int64)])
            base = place[piece.offsets[:-1]][piece.owner[hits]]
            spans = pa.StructArray.from_arrays(
                [pa.array(place[piece.starts[hits]] - base), pa.array(place[piece.ends[hits]] - base)], ["start", "end"])
            bounds = np.searchsorted(hits, piece.first).astype(np.int32)
            yield dict(zip(names, rows.columns)) | {
                "score": points, "predicted": (points >= 0.5).astype(np.int32),
                "spans": pa.ListArray.from_arrays(pa.array(bounds), spans)}

    return arrow_map(docs, StructType([*docs.schema.fields, *added.fields]), work)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), FOLDS, FOLD)
    model = fit(docs.where(~out), read(spark, sf_dir, "labels").where(~out))
    found = score(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", "predicted", "spans")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
