"""Packing documents into fixed-length sequences along a space-filling curve."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

END = 2
_END_BYTES = np.array([END], "<u4").tobytes()
#: Chunks a worker remembers before it starts anew, about 200 bytes each.
_KNOWN_CHUNKS = 1 << 19
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|\Z)")
_BUCKETS, _DIMS, _BITS = 256, 3, 16
#: Documents drawn for each range to place its border.
_SAMPLE = 64
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_WITH_IDS = _PIECES + ", ids array<int>"


def hilbert_index(point: list[int], bits: int) -> int:
    """Position on the Hilbert curve of a point with ``bits`` bits a dimension: inverse undo of the curve's rotations
    (exchange and invert of lower bits, top bit down), a Gray code, then the dimensions' bits interleaved."""
    x, n = list(point), len(point)
    mask = 1 << (bits - 1)
    while mask > 1:
        low = mask - 1
        for i in range(n):
            if x[i] & mask:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        mask >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, mask = 0, 1 << (bits - 1)
    while mask > 1:
        if x[n - 1] & mask:
            turn ^= mask - 1
        mask >>= 1
    index = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | ((v ^ turn) >> bit & 1)
    return index


def document_vector(data: bytes) -> np.ndarray:
    """Character trigrams hashed into buckets; roots of the counts, centred and scaled to length 1 (0 for texts too short)."""
    codes = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    grams = (codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]) * np.uint32(0x9E3779B1) >> np.uint32(24)
    vector = np.sqrt(np.bincount(grams, minlength=_BUCKETS))
    vector -= vector.mean()
    size = np.sqrt((vector * vector).sum())
    return vector / size if size else vector


Place = tuple[int, int, int]


def _place(key: int, tie: int, doc: int | None) -> Place:
    return key, tie, -1 << 63 if doc is None else doc


def _keys(borders: list[Place]):
    """Add the Hilbert key of the document vector's projection on fixed random axes, and the range between the borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = np.random.Generator(np.random.PCG64(11)).standard_normal((_DIMS, _BUCKETS))
        top = (1 << _BITS) - 1
        for batch in batches:
            keys = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                place = axes @ document_vector(data or b"")
                spread = np.clip((place / 6 + 0.5) * top, 0, top).astype(np.int64)
                keys.append(hilbert_index(spread.tolist(), _BITS))
            ranges = [bisect_right(borders, _place(*p)) for p in zip(keys, batch.column(2).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64()), pa.array(ranges, pa.int32())], ["id", "text", "tie", "key", "range"])

    return run


_KEYED = "id bigint, text string, tie bigint, key bigint, range int"


def _borders(source: DataFrame, ranges: int) -> list[Place]:
    """Borders of ranges of about the same number of characters. About ``_SAMPLE`` documents a range are drawn, whatever the table holds; the driver gets
    their keys and lengths, no texts."""
    rows = source.count()
    drawn = source.sample(min(1.0, _SAMPLE * ranges / max(rows, 1)), 11).mapInArrow(_keys([]), _KEYED)
    found = sorted((_place(r.key, r.tie, r.id), r.chars) for r in drawn.select("key", "tie", "id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).toLocalIterator())
    total, ahead, borders = sum(chars + 1 for _, chars in found), 0, []
    for place, chars in found:
        if ahead * ranges >= (len(borders) + 1) * total and (not borders or borders[-1] < place):
            borders.append(place)
        ahead += chars + 1
    return borders


class _ChunkIds(dict):
    """Token ids, as bytes, of text between blanks. The tokenizer drops white space and never joins over it, so a text's ids are those
    of its chunks in order; only chunks the worker has not met are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder = Tokenizer.from_file(path)
        names = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)), re.I) if names else None

    def of(self, text: str) -> np.ndarray:
        if self.special is not None and self.special.search(text):  # the tokenizer cuts at these names before anything else
            return np.array([*self.encoder.encode(text, add_special_tokens=False).ids, END], "<u4")
        # A-Z are lower-cased as the tokenizer does anyway, and a full stop or comma after an ASCII letter is a token of its own anyway: fewer chunks differ.
        chunks = _STOP.sub(rb" \1", text.encode().lower()).replace(b"\n", b" ").split(b" ")
        new = [c for c in set(chunks) if c not in self]
        if len(self) > _KNOWN_CHUNKS:
            self.clear()
            new = list(set(chunks))
        for chunk, found in zip(new, self.encoder.encode_batch_fast([c.decode() for c in new], add_special_tokens=False)):
            self[chunk] = array("I", found.ids).tobytes()
        return np.frombuffer(b"".join([*map(self.__getitem__, chunks), _END_BYTES]), "<u4")


@cache
def _chunk_ids(path: str) -> _ChunkIds:
    """The worker process's own table; it serves one task after the other."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return _ChunkIds(path)


def _packer(tokenizer: str, length: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lay a range's documents end to end and cut at every ``length`` ids; the last ids are cut into powers of two."""
        encode = _chunk_ids(tokenizer)
        sequence, filled, open_pieces = TaskContext.get().partitionId() << 40, 0, []

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[p[:7] for p in pieces])) if pieces else [[]] * 7
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                arrays, names = arrays + [pa.array([p[7].astype(np.int32) for p in pieces], pa.list_(pa.int32()))], names + ["ids"]
            return pa.RecordBatch.from_arrays(arrays, names)

        def piece(doc: int | None, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> tuple:
            return doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, ids

        for batch in batches:
            done = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode.of(text or "")
                start = 0
                while start < len(ids):
                    take = min(length - filled, len(ids) - start)
                    open_pieces.append(piece(doc, start, ids[start:start + take], len(ids), sequence, filled))
                    start, filled = start + take, filled + take
                    if filled == length:
                        done += open_pieces
                        sequence, filled, open_pieces = sequence + 1, 0, []
            yield batch_of(done)
        # The rest, fewer than ``length`` ids: sequences of descending powers of two need no padding.
        done, room, offset = [], 0, 0
        for doc, start, count, _, total, _, _, ids in open_pieces:
            at = 0
            while at < count:
                if offset == room:
                    sequence, offset, room = sequence + bool(room), 0, 1 << (filled.bit_length() - 1)
                    filled -= room
                take = min(room - offset, count - at)
                done.append(piece(doc, start + at, ids[at:at + take], total, sequence, offset))
                at, offset = at + take, offset + take
        yield batch_of(done)

    return pack


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, with_ids: bool = True,
) -> DataFrame:
    """Return the pieces of documents in sequences of at most ``length`` ids, with their ids if ``with_ids``.

    Each document's character trigrams are hashed into a count vector, which fixed random axes project to three dimensions; its cell's place on a Hilbert curve
    is the sort key, so like documents lie near each other. Texts are range-sorted by the key - ranges hold about as many characters each, their
    borders come from a bounded sample, ties go by a hash of the text and by id, so equal documents spread over ranges - and each range lays its
    documents end to end. Every sequence is full except for the last ids of a range, which fill sequences of descending powers of two: nothing is
    padded. A task holds one batch of texts and one open sequence. Keys are made once, and ids once after the sort.

    Ids are the tokenizer's own with ``add_special_tokens=False``: the names of its special tokens in a text stand for these tokens. A null or empty
    text is the end id alone. Documents of any length are cut freely over sequences; one document is in one range. Repeated rows
    are packed as often as they stand there. ``sequence_id`` is unique, its upper bits name the range. ``docs`` is read three times (number, sample,
    texts), so store it first if it is costly.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = source.mapInArrow(_keys(_borders(source, ranges)), _KEYED)
    ranged = keyed.repartitionById(ranges, F.col("range")).sortWithinPartitions("key", "tie", "id").select("id", "text")
    return ranged.mapInArrow(_packer(tokenizer, length, with_ids), _WITH_IDS if with_ids else _PIECES)
