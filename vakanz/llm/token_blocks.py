"""Token ids in files of patched frame-of-reference blocks.

A file segment holds the ids of consecutive documents in blocks of ``BLOCK`` ids. A block stores its
minimum and, for every id, the difference to it in ``width`` bits. The width is what the chosen
percentile of the differences needs; larger differences go to the exception list (place, value) and
leave zero bits behind. Layout, little-endian:

``PFB1``, docs u32, ids u64, blocks u32 | doc ids i64, their null marks u8, ids per doc u32 |
per block: start of its bits u32, minimum u32, width u8, exceptions u8 | bits, 16 * width bytes a
block | exceptions: places u8, values u32.

The starts index the blocks, so one block is decoded without the others (:func:`read_ids`). Segments
are rows of a Parquet folder (part, segment, payload): Spark's writers then work on any store, commit
by task and leave nothing behind when an executor is lost.

Documents are range-partitioned by id and sorted within their part, so (part, segment) is the order
of the ids; a part is streamed and never held whole. The start of a document is the sum of the parts
before it (one row per part), of the segments before it in its part, and its place in its segment.

Defined results: null and empty texts are written as the end id alone; documents with a null id come
first; rows with equal ids stand next to each other in the order of their texts; an empty table
gives no file row and an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vakanz.llm.common import stage

BLOCK = 128
PERCENTILE = 90
HEAD = struct.Struct("<4sIQI")
SEGMENT_IDS = 1 << 20
CACHE_PARTS = 1 << 20
# Fixed value: how the byte-level tokenizer cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENTS = "part int, segment int, n_docs long, n_ids long, payload binary"
DOCS = "part int, segment int, place int, doc_id long, start long, n_tokens long, ids_crc32 long"


def limits(width: np.ndarray) -> np.ndarray:
    """Largest value of so many bits."""
    return ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def chosen_width(diff: np.ndarray) -> np.ndarray:
    """Bits that hold PERCENTILE per cent of each row, by bisection."""
    need = -(-BLOCK * PERCENTILE // 100)
    low, high = np.zeros(len(diff), dtype=np.uint8), np.full(len(diff), 32, dtype=np.uint8)
    while (low < high).any():
        middle = (low + high) // 2
        enough = (diff <= limits(middle)[:, None]).sum(axis=1) >= need
        high, low = np.where(enough, middle, high), np.where(enough, low, middle + 1)
    return low.astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 2 * width words."""
    out = np.zeros((len(values), 2 * width), dtype=np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[:, word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= columns[i] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, len(words)), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | columns[word + 1] << np.uint64(64 - shift)
        out[i] = value & mask
    return out.T


def encode_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Payload of one segment; ``ids`` are those of all its documents in order."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, dtype=np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    width = chosen_width(diff)
    above = diff > limits(width)[:, None]
    spot_row, spot = np.nonzero(above)
    values = diff[spot_row, spot].astype("<u4")
    plain = np.where(above, 0, diff)
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    bits = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed = pack(plain[own], int(w)).astype("<u8").view(np.uint8)
            bits[starts[own][:, None] + np.arange(packed.shape[1])] = packed
    missing = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join((
        HEAD.pack(b"PFB1", len(doc_ids), len(ids), n_blocks),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), missing.tobytes(), lengths.astype("<u4").tobytes(),
        starts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(),
        above.sum(axis=1).astype(np.uint8).tobytes(), bits.tobytes(), spot.astype(np.uint8).tobytes(), values.tobytes()))


class Segment:
    """Reader of one payload."""

    def __init__(self, payload: bytes):
        magic, self.n_docs, self.n_ids, self.n_blocks = HEAD.unpack_from(payload)
        if magic != b"PFB1":
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += got.nbytes
            return got

        ids = take("<i8", self.n_docs)
        missing = take("u1", self.n_docs)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(ids, missing)]
        self.lengths = take("<u4", self.n_docs)
        self.starts, self.low = take("<u4", self.n_blocks), take("<u4", self.n_blocks)
        self.width, self.n_except = take("u1", self.n_blocks), take("u1", self.n_blocks)
        self.bits = take("u1", int(self.width.astype(np.int64).sum()) * (BLOCK // 8))
        n = int(self.n_except.astype(np.int64).sum())
        self.spots, self.values = take("u1", n), take("<u4", n)

    def blocks(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Rows of BLOCK ids of the blocks first to last (not included)."""
        last = self.n_blocks if last is None else min(last, self.n_blocks)
        width, out = self.width[first:last], np.zeros((max(0, last - first), BLOCK), dtype=np.uint32)
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                size = int(w) * (BLOCK // 8)
                at = self.starts[first:last][own].astype(np.int64)[:, None] + np.arange(size)
                out[own] = unpack(self.bits[at].view("<u8"), int(w))
        ends = np.cumsum(self.n_except.astype(np.int64))
        a, b = (int(ends[first - 1]) if first else 0), (int(ends[last - 1]) if last > first else 0)
        if b > a:
            row = np.repeat(np.arange(last - first), self.n_except[first:last])
            out[row, self.spots[a:b]] = self.values[a:b]
        return out + self.low[first:last][:, None]

    def ids(self) -> np.ndarray:
        return self.blocks().reshape(-1)[: self.n_ids]


def read_ids(payload: bytes, start: int, n: int) -> np.ndarray:
    """``n`` ids from place ``start`` of a segment; decodes only the blocks they lie in."""
    first = start // BLOCK
    blocks = Segment(payload).blocks(first, -(-(start + n) // BLOCK)).reshape(-1)
    return blocks[start - first * BLOCK: start - first * BLOCK + n]


class _Odd(Exception):
    """A text that can't be cut at its spaces."""


class _Parts(dict):
    """Ids by part of a text: what stands between two spaces, with the space before it.

    The first ``limit`` different parts stay; later ones are encoded whenever they come.
    """

    def __init__(self, tokenizer, pattern, limit: int):
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        self.cut = pattern.findall
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes come after 255
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.space = chr(self.letters[32])
        self.others: dict[str, bytes] = {}
        self.marks = {c: self.token(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def token(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if piece.isascii() and piece[0] == " " and piece[1:].isalnum():
            spelled = self.space + piece[1:]
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def often(self, piece: str) -> bytes:
        """Ids of a pre-token that is not a part: punctuation, the first word of a line."""
        ids = self.others.get(piece)
        if ids is None:
            ids = self.token(piece)
            if len(self.others) < self.limit >> 3:
                self.others[piece] = ids
        return ids

    def keep(self, part: str, ids: bytes) -> bytes:
        if len(self) < self.limit:
            self[part] = ids
        return ids

    def latin(self, part: str) -> bool:
        """Letters of the Latin script only."""
        return part.isalpha() and (part.isascii() or max(part) < "\u0250")

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace():
            raise _Odd
        mark = self.marks.get(part[-1])
        if mark is not None and self.latin(word := part[:-1]):
            return self[word] + mark
        if "<|" not in part and (part.isascii() or max(part) < "\u0250"):
            if part.isalpha():
                return self.keep(part, self.token(" " + part))
            lines = part.split("\n")
            if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                # a single line break between two words is a token of its own
                return self[lines[0]] + b"".join(map(self.line, lines[1:]))
            return self.keep(part, b"".join(map(self.often, self.cut(" " + part))))
        return self.keep(part, self.whole(" " + part))

    def line(self, part: str) -> bytes:
        """Ids of a line break and the Latin part behind it; a word alone needs no pattern."""
        if part.isalpha():
            return self.often("\n") + self.often(part)
        mark = self.marks.get(part[-1])
        if mark is not None and part[:-1].isalpha():
            return self.often("\n") + self.often(part[:-1]) + mark
        return b"".join(map(self.often, self.cut("\n" + part)))


class Encoder:
    """Byte-level BPE ids of whole texts, put together from those of their parts.

    The tokenizer cuts a text before every space in front of anything but white space, whatever
    surrounds it, so the ids of such parts are the ids of the text; most parts repeat. Inside a part
    of Latin letters the pre-tokens are those of ``pattern``; other parts, and texts with white space
    beside a space, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.parts = _Parts(Tokenizer.from_file(path), regex.compile(PATTERN), CACHE_PARTS)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian u32."""
        first, *rest = text.split(" ")
        if not rest or not first or first[0].isspace():
            return self.parts.whole(text) if text else b""
        try:
            return self.parts.whole(first) + b"".join(map(self.parts.__getitem__, rest))
        except _Odd:
            return self.parts.whole(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _write(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches):
        part, number = TaskContext.get().partitionId(), 0
        docs, lengths, ids, held = [], [], [], 0

        def row():
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            payload = encode_segment(docs, np.array(lengths), flat)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()),
                "n_docs": [len(docs)], "n_ids": [len(flat)], "payload": pa.array([payload], pa.binary())})

        encode = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    found = encode(text or "") + end
                    docs.append(doc_id)
                    ids.append(found)
                    lengths.append(len(found) // 4)
                    held += lengths[-1]
                    if held >= SEGMENT_IDS:
                        yield row()
                        number, held = number + 1, 0
                        docs, lengths, ids = [], [], []
        if docs:
            yield row()

    return segments


def write_files(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Segments of all documents in ascending id order; the caller chooses where to write them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(_write(tokenizer, end_id), SEGMENTS)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment(row["payload"])
            ids = segment.ids().astype("<u4")
            ends = np.cumsum(segment.lengths.astype(np.int64))
            starts = ends - segment.lengths
            raw = ids.tobytes()
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = segment.n_docs
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                pa.array(range(n), pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(starts),
                pa.array(segment.lengths.astype(np.int64)), pa.array(crc, pa.int64()),
            ], ["part", "segment", "place", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from written segments."""
    sizes = files.select("part", "segment", "n_ids")
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    shift = parts.select("part", F.coalesce(F.sum("ids").over(across), F.lit(0)).alias("shift"))
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(shift, "part").select(
        "part", "segment", (F.col("inner") + F.col("shift")).alias("offset"))
    docs = files.select("part", "segment", "payload").mapInArrow(_read, DOCS)
    return docs.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    return read_documents(stage(write_files(docs, tokenizer, **options)))
