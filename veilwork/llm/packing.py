"""Token ids in a bit-packed file format: write, read back, random access.

A block holds whole documents in order.  Its bytes are a header (magic, bits per
id, number of documents, number of ids), the place of each document's first id
as 64-bit integers, and all ids at the least width that holds the vocabulary,
lowest bit first.  Because the width is fixed, any id is one shift away, and a
range of ids is unpacked by numpy without touching the rest.

Blocks are rows of a Parquet table in the shared folder, ordered by range
partitioning on (id, hash of the text): a hot id or source splits over tasks.
Only one row per block is gathered to number the ids of the corpus, summed first
within its partition.

Texts are tokenized by the ``tokenizers`` library.  Its pre-tokenizer never looks
across a word's boundary other than at white space, so the library encodes each
distinct word (with the blank before it) once per worker, in a cache of at most
``CACHED_WORDS``; texts with white space outside ASCII, or with the string of an
added token, are encoded whole.  Tests compare the ids with the library's on whole
texts.

Defined results: NULL and empty texts have only the end id; documents with equal
ids keep one row each, ordered by text hash; a NULL id sorts last; strings of added
tokens inside a text become those tokens, as the library has it; texts of any
length are one row of a block; other columns play no part, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, arrow_map, read
from .words import Piece, pieces

END_ID = 2
BLOCK_IDS = 1 << 20
CACHED_WORDS = 800_000

_MAGIC = b"VWB1"
_JOINED = 256
_PIECE_BYTES = 1 << 20
_HEADER = struct.Struct("<4sBxxxIQ")
#: White space that is none in ASCII, and control characters on which libraries differ.
_OTHER_SPACE = (r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_PLAIN[[c for c in range(128) if chr(c).isalnum()]] = True


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, ``bits`` each, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: memoryview | bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of packed bytes, reading only those."""
    low, high = start * bits // 8, -(-stop * bits // 8)
    if bits == 16:
        return np.frombuffer(data, "<u2", stop - start, low).astype(np.uint32)
    part = np.frombuffer(bytes(data[low:high]) + bytes(8), np.uint8)
    at = np.arange(start, stop, dtype=np.int64) * bits - low * 8
    words = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_block(ids: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
    return _HEADER.pack(_MAGIC, bits, len(counts), len(ids)) + starts.tobytes() + pack(ids, bits)


class Block:
    """Documents of a block, unpacked on demand."""

    def __init__(self, data: bytes):
        magic, self.bits, n, self.n_ids = _HEADER.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a block of packed ids")
        self.starts = np.frombuffer(data, "<i8", n + 1, _HEADER.size)
        self._packed = memoryview(data)[_HEADER.size + 8 * (n + 1):]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return unpack(self._packed, self.bits, int(self.starts[i]), int(self.starts[i + 1]))


def _tail(piece: Piece) -> np.ndarray:
    """1 for words that end in an ASCII letter or digit and one mark, else 0."""
    last, before = piece.buf[piece.ends - 1], piece.buf[np.maximum(piece.ends - 2, 0)]
    return (_MARK[last] & _PLAIN[before] & (piece.ends - piece.starts > 1)).astype(np.int64)


class Encoder:
    """Ids of texts by a byte-level tokenizer file, each distinct word encoded once."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached = cached
        self._feed, = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._keys, self._sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._at, self._ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _units(self, piece: Piece, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and owners of the spans that are tokenized on their own, in order, and which are words.

        A word takes the blank before it along; of more white space all but the
        last character stand together; white space at the end of a text too.  A
        mark after an ASCII letter or digit stands alone.
        """
        n, words = len(piece), len(piece.starts)
        owner = piece.owner
        slots = (words + n, 4)
        start, end = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        row = np.arange(words) + owner
        before = np.concatenate([[0], piece.ends[:-1]])[:words]
        at_first = piece.first[:-1][piece.n_words > 0]
        before[at_first] = piece.offsets[owner[at_first]]
        gap = piece.starts - before
        blank = (gap > 0) & (piece.buf[np.maximum(piece.starts - 1, 0)] == 0x20)
        lead = piece.starts - (gap > 0)
        start[row, 0], end[row, 0] = before, np.maximum(lead, before)
        start[row, 1], end[row, 1] = lead, np.where(blank, lead, piece.starts)
        mark = piece.ends - _tail(piece)
        start[row, 2], end[row, 2] = np.where(blank, lead, piece.starts), mark
        start[row, 3], end[row, 3] = mark, piece.ends
        texts = np.arange(n)
        last = piece.first[1:] + texts
        rest = piece.offsets[:-1].copy()
        some = piece.n_words > 0
        rest[some] = piece.ends[piece.first[1:][some] - 1]
        start[last, 2], end[last, 2] = rest, piece.offsets[1:]
        owners = np.zeros(words + n, np.int64)
        owners[row], owners[last] = owner, texts
        if whole.any():
            end[whole[owners]] = start[whole[owners]]
            start[last[whole], 2], end[last[whole], 2] = piece.offsets[:-1][whole], piece.offsets[1:][whole]
        is_word = np.zeros(slots, bool)
        is_word[row, 2:] = True
        owners = np.repeat(owners, 4)
        start, end = start.ravel(), end.ravel()
        full = end > start
        return start[full], end[full], owners[full], is_word.ravel()[full]

    def _encode(self, units: list[str], is_word: np.ndarray) -> list[list[int]]:
        """Ids of each unit.  Words are joined by line feeds, which are tokens of their own, to save calls."""
        single, words = np.flatnonzero(~is_word).tolist(), np.flatnonzero(is_word).tolist()
        found: list[list[int]] = [[]] * len(units)
        for i, e in zip(single, self.tokenizer.encode_batch_fast([units[i] for i in single], add_special_tokens=False)):
            found[i] = e.ids
        groups = [words[a:a + _JOINED] for a in range(0, len(words), _JOINED)]
        lines = ["\n".join(units[i] for i in group) for group in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids, at = e.ids, 0
            for i in group[:-1]:
                to = ids.index(self._feed, at)
                found[i], at = ids[at:to], to + 1
            found[group[-1]] = ids[at:]
        return found

    def _learn(self, piece: Piece, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> None:
        """Encode new units and put them in their places among the known ones; ``keys`` ascend."""
        found = self._encode([piece.buf[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())], is_word)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        place = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, place, keys)
        self._sizes = np.insert(self._sizes, place, sizes)
        self._at = np.insert(self._at, place, len(self._ids) + np.cumsum(sizes) - sizes)
        self._ids = np.concatenate([self._ids, ids])

    def piece(self, piece: Piece, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece, and their number in each."""
        start, end, owner, is_word = self._units(piece, whole)
        codes, keys = pd.factorize(piece.spans(start, end))
        kept = self._keys, self._sizes, self._at, self._ids
        at = np.zeros(len(keys), np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        place = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self._keys)
        known[inside] = self._keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(keys[new])]
            self._learn(piece, keys[new], start[at[new]], end[at[new]], is_word[at[new]])
        place = np.searchsorted(self._keys, keys)[codes]
        sizes = self._sizes[place]
        total = np.cumsum(sizes)
        ids = self._ids[np.repeat(self._at[place] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
        if len(self._keys) > self.cached:
            self._keys, self._sizes, self._at, self._ids = kept
        return ids, np.bincount(owner, sizes, len(piece)).astype(np.int64)

    def batches(self, column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, ids and numbers of ids for parts of a column of texts."""
        whole = pc.match_substring_regex(column, _OTHER_SPACE)
        for token in self._added:
            whole = pc.or_(whole, pc.match_substring(column, token))
        whole = pc.fill_null(whole, False).to_numpy(False)
        for piece in pieces(column, size=_PIECE_BYTES):
            yield piece.rows, *self.piece(piece, whole[piece.rows])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """Append the end id to each document."""
    return np.insert(ids, np.cumsum(counts), end_id)


def write_ids(docs: DataFrame, tokenizer: str, work: Workspace, key: str = "doc_id", text: str = "text",
              end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode texts and write their ids as blocks in ascending order of the key.

    Returns the written table: ``part, block, keys, n_ids, data``.
    """
    order = [F.col("key").asc_nulls_last(), "spread"]
    ordered = (docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
               .withColumn("spread", F.xxhash64("text"))
               .repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text"))
    schema = "part int, block int, keys array<long>, n_ids long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer)
        bits = bits_for(encode.tokenizer.get_vocab_size())
        keys, ids, counts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            data = write_block(np.concatenate(ids), np.concatenate(counts), bits)
            flat = pa.concat_arrays(keys)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                   pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                   pa.array([held], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "keys", "n_ids", "data"])

        for batch in batches:
            for rows, found, sizes in encode.batches(batch.column(1)):
                keys.append(batch.column(0)[rows.start:rows.stop])
                ids.append(_with_end(found, sizes, end_id))
                counts.append(sizes + 1)
                held += len(ids[-1])
                if held >= block_ids:
                    yield close()
                    keys, ids, counts, held, block = [], [], [], 0, block + 1
        if keys:
            yield close()
        pa.default_memory_pool().release_unused()

    return work.save(ordered.mapInArrow(run, schema), "blocks")


def read_ids(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the written blocks."""
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all_ids").over(earlier), F.lit(0)).alias("before"))
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(parts, "part").select(
        "part", "block", (F.col("before") + F.col("inner")).alias("first"))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, block, keys, data in zip(*(batch.column(i) for i in range(4))):
            ids = Block(data.as_py())
            yield {"part": np.full(len(ids), part.as_py(), np.int32), "block": np.full(len(ids), block.as_py(), np.int32),
                   "doc_id": keys.values, "at": ids.starts[:-1].astype(np.int64),
                   "n_tokens": np.diff(ids.starts),
                   "ids_crc32": np.array([zlib.crc32(ids[i].astype("<u4")) for i in range(len(ids))], np.int64)}

    found = arrow_map(blocks.select("part", "block", "keys", "data"),
                      "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long", work)
    return found.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    blocks = write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), Workspace(spark, "packed"))
    return read_ids(blocks)


QUERIES = {"op7_bit_packing": op7_bit_packing}
ORACLES: dict[str, str] = {}
