"""Language identification with a convolutional network over bytes.

The network embeds bytes (A to Z lower-cased), convolves them with filters of several widths, takes
the maximum of each filter over a window of fixed length and ends in a softmax.
It is trained in numpy by Adam on a bounded sample: ``PER_LANGUAGE`` labelled
texts of each language, chosen by a hash of the id, and ``WINDOWS_PER_TEXT``
windows of each at most, drawn by hash over the whole text in the tasks that read
it.  So the driver gets 600 kB a language, however long texts are.  Prediction
cuts every text into consecutive windows, all of them, and averages their
probabilities by length.

Defined results: NULL, empty and letterless texts are ``und`` with score 0; with
no labelled row every text is; of equally likely languages the first by name
counts; repeated rows get equal predictions; texts of any length are cut the same
way; an empty table gives an empty table.  The columns added replace input columns
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import arrow_map, filter_rows, held_out, read
from .words import Piece, mix, pieces

FOLDS, FOLD = 5, 0
PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 6
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
EPOCHS = 6
UNDETERMINED = "und"
#: A text is rejected by ``known_language`` below this score.
MIN_SCORE = 0.35

_PAD = 256
_BATCH = 64
_RATE = 0.01
_AT_ONCE = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """Embeddings of the ``max(WIDTHS)`` bytes from each place on: windows x places x taps."""
        wide = np.ascontiguousarray(self.embedding[windows]).reshape(len(windows), -1)
        taps = max(WIDTHS) * EMBEDDING
        places = WINDOW - max(WIDTHS) + 1
        view = np.lib.stride_tricks.as_strided(
            wide, (len(windows), places, taps), (wide.strides[0], EMBEDDING * wide.itemsize, wide.itemsize))
        return np.ascontiguousarray(view).reshape(-1, taps)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = (self._columns(windows) @ self.filters).reshape(len(windows), -1, self.filters.shape[1]).max(axis=1)
        return _softmax(np.maximum(pooled + self.bias, 0) @ self.weights + self.offset)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and owners of the consecutive windows of each text."""
    sizes = np.diff(piece.offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = piece.offsets[:-1][owner] + nth * WINDOW
    return starts, np.minimum(WINDOW, piece.offsets[1:][owner] - starts), owner


def _take(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    places = np.arange(WINDOW)
    inside = places < lengths[:, None]
    return np.where(inside, buf[np.where(inside, starts[:, None] + places, 0)].astype(np.int16), _PAD)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Fit the network to windows of bytes and the index of their language."""
    rng = np.random.default_rng(seed)
    taps, n_filters = max(WIDTHS) * EMBEDDING, FILTERS * len(WIDTHS)
    mask = np.zeros((taps, n_filters), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    model = Model(languages, normal(_PAD + 1, EMBEDDING, scale=0.5), normal(taps, n_filters, scale=0.3) * mask,
                  np.zeros(n_filters, np.float32), normal(n_filters, len(languages), scale=0.3),
                  np.zeros(len(languages), np.float32))
    model.embedding[_PAD] = 0
    names = ("embedding", "filters", "bias", "weights", "offset")
    first = {n: np.zeros_like(getattr(model, n)) for n in names}
    second = {n: np.zeros_like(getattr(model, n)) for n in names}
    balance = (len(labels) / (len(languages) * np.maximum(np.bincount(labels, minlength=len(languages)), 1)))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), _BATCH):
            batch = order[at:at + _BATCH]
            x, y, n = windows[batch], labels[batch], len(batch)
            columns = model._columns(x)
            response = (columns @ model.filters).reshape(n, -1, n_filters)
            best = response.argmax(axis=1)
            pooled = np.take_along_axis(response, best[:, None], 1)[:, 0] + model.bias
            hidden = np.maximum(pooled, 0)
            error = _softmax(hidden @ model.weights + model.offset)
            error[np.arange(n), y] -= 1
            error *= (balance[y] / n)[:, None].astype(np.float32)
            back = (error @ model.weights.T) * (pooled > 0)
            chosen = columns.reshape(n, -1, taps)[np.arange(n)[:, None], best]
            to_taps = (back[:, :, None] * model.filters.T).reshape(n, n_filters, max(WIDTHS), EMBEDDING)
            bytes_at = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))]
            embedding = np.zeros_like(model.embedding)
            np.add.at(embedding, bytes_at.ravel(), to_taps.reshape(-1, EMBEDDING))
            embedding[_PAD] = 0
            slopes = {"embedding": embedding, "filters": np.einsum("bf,bft->tf", back, chosen) * mask,
                      "bias": back.sum(axis=0), "weights": hidden.T @ error, "offset": error.sum(axis=0)}
            step += 1
            for n_, g in slopes.items():
                first[n_] += 0.1 * (g - first[n_])
                second[n_] += 0.001 * (g * g - second[n_])
                rate = _RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                setattr(model, n_, getattr(model, n_) - (rate * first[n_] / (np.sqrt(second[n_]) + 1e-8)).astype(np.float32))
    return model


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model | None:
    """Train on at most ``per_language`` rows of each language; None without any."""
    spread = F.xxhash64(F.col(key))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    nth = F.row_number().over(Window.partitionBy(lang).orderBy(spread, key))
    chosen = rows.select(key, lang).withColumn("nth", nth).where(F.col("nth") <= per_language).select(key).distinct()
    # As many rows as there are languages times ``per_language``.
    sample = rows.join(F.broadcast(chosen), key).where(F.length(text) > 0).dropDuplicates([key, lang])
    found = _drawn(sample.select(spread.alias("spread"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))).toPandas()
    found = found.sort_values(["spread", "lang", "nth"], ignore_index=True)
    languages = sorted(set(found["lang"]))
    if not languages:
        return None
    lengths = found["window"].map(len).to_numpy()
    flat = np.frombuffer(b"".join(found["window"]), np.uint8)
    windows = _take(flat, np.cumsum(lengths) - lengths, lengths)
    return train(windows, np.searchsorted(languages, found["lang"].to_numpy(str)), languages)


def _drawn(texts: DataFrame) -> DataFrame:
    """``spread, lang, nth, window``: some windows of each text, by a hash of ``spread`` and their number."""
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in pieces(batch.column(2), lower=True):
            starts, lengths, owner = windows_of(piece)
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            spread = batch.column(0).to_numpy()[piece.rows][owner]
            order = np.lexsort((mix(spread.view(np.uint64) + _STEP * nth.astype(np.uint64)), owner))
            use = np.sort(order[np.arange(len(order)) - np.searchsorted(owner[order], owner[order]) < WINDOWS_PER_TEXT])
            yield {"spread": spread[use], "lang": batch.column(1).slice(piece.rows.start, len(piece)).take(pa.array(owner[use])),
                   "nth": nth[use], "window": [piece.buf[a:a + n].tobytes() for a, n in zip(starts[use], lengths[use])]}

    return arrow_map(texts, "spread long, lang string, nth long, window binary", work)


def _score(piece: Piece, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest language of each text and its mean probability over the windows."""
    starts, lengths, owner = windows_of(piece)
    total = np.zeros((len(piece), len(model.languages)))
    for a in range(0, len(starts), _AT_ONCE):
        part = slice(a, a + _AT_ONCE)
        p = model.probabilities(_take(piece.buf, starts[part], lengths[part]))
        np.add.at(total, owner[part], p * lengths[part, None])
    total /= np.maximum(np.diff(piece.offsets), 1)[:, None]
    best = total.argmax(axis=1)
    return best, np.clip(total[np.arange(len(best)), best], 0, 1)


def _predict(texts: pa.Array, model: Model | None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, languages and scores for parts of a column of texts."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(False)
    for piece in pieces(texts, lower=True):
        some = letters[piece.rows]
        if model is None:
            yield piece.rows, np.full(len(piece), UNDETERMINED, object), np.zeros(len(piece))
        else:
            best, score = _score(piece, model)
            language = np.where(some, np.array(model.languages, object)[best], UNDETERMINED)
            yield piece.rows, language, np.where(some, score, 0.0)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to documents."""
    added = StructType.fromDDL("lang_pred string, score double")
    docs = docs.drop(*added.names)
    at, names = docs.columns.index(text), docs.columns

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, language, score in _predict(batch.column(at), model):
            part = batch.slice(rows.start, rows.stop - rows.start)
            yield dict(zip(names, part.columns)) | {"lang_pred": language, "score": score}

    return arrow_map(docs, StructType([*docs.schema.fields, *added.fields]), work)


def known_language(docs: DataFrame, model: Model | None, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is determined with at least ``min_score``, columns unchanged."""
    def keep(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(
            (language != UNDETERMINED) & (score >= min_score) for _, language, score in _predict(texts, model))])

    return filter_rows(docs, text, keep)


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), FOLDS, FOLD)
    model = fit(docs.where(~out))
    found = identify(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_byte_cnn": op8_byte_cnn}
ORACLES: dict[str, str] = {}
