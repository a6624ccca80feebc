"""Token-id files of patched frame-of-reference blocks.

A file is a Parquet table of segments in (part, seq) order; a segment holds whole documents and is one byte string:

    magic b"PFR1" | u32 documents | u32 blocks | u64 tokens
    i64 x documents ids | u8 x documents id is null | u32 x documents lengths
    u32 x blocks minimum | u8 x blocks width | u8 x blocks exceptions | u64 x blocks start of packed bits
    packed bits of all blocks | u8 x exceptions position | u32 x exceptions value

Each block of 128 ids is stored less its minimum, in the bit width that holds 90 % of them; ids that need more
are in the exception list with their place in the block and full difference.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import tokenizer

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_TOKENS = 1 << 16
HEAD = struct.Struct("<4sIIQ")


def encode_segment(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    """One segment of documents given as little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    a = np.zeros((blocks, BLOCK), "u4")
    a.ravel()[:n] = ids
    if n % BLOCK:
        a[-1, n % BLOCK :] = ids[-1]
    low = a.min(1) if blocks else np.zeros(0, "u4")
    a -= low[:, None]
    bits = np.frexp(a.astype("f8"))[1].astype("u1")  # bit length; exact below 2^53
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, "u1")
    odd = bits > width[:, None]
    starts = np.concatenate([[0], np.cumsum(width.astype("u8") * (BLOCK // 8))])
    packed = np.zeros(int(starts[-1]), "u1")
    for w in np.unique(width):
        if w:
            at_w = np.flatnonzero(width == w)
            wide = "<u4" if w > 16 else "<u2" if w > 8 else "u1"
            planes = np.unpackbits(a[at_w].astype(wide).view("u1").ravel(), bitorder="little").reshape(-1, 8 * np.dtype(wide).itemsize)[:, : int(w)]
            packed[(starts[at_w][:, None] + np.arange(int(w) * BLOCK // 8, dtype="u8")).astype("i8")] = np.packbits(planes.reshape(len(at_w), -1), axis=1, bitorder="little")
    null = np.array([d is None for d in doc_ids], "u1")
    return b"".join(
        [
            HEAD.pack(b"PFR1", len(docs), blocks, n),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            null.tobytes(),
            np.array([len(d) // 4 for d in docs], "<u4").tobytes(),
            low.astype("<u4").tobytes(),
            width.tobytes(),
            odd.sum(1).astype("u1").tobytes(),
            starts[:-1].astype("<u8").tobytes(),
            packed.tobytes(),
            np.nonzero(odd)[1].astype("u1").tobytes(),
            a[odd].astype("<u4").tobytes(),
        ]
    )


def decode_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, document lengths, and all token ids of a segment."""
    magic, docs, blocks, n = HEAD.unpack_from(raw)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    low, width, odd, starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u8", blocks)
    packed = take("u1", int(width.astype("u8").sum()) * (BLOCK // 8))
    places, values = take("u1", int(odd.astype("u8").sum())), take("<u4", int(odd.astype("u8").sum()))
    a = np.zeros((blocks, BLOCK), "u4")
    for w in np.unique(width):
        if w:
            at_w = np.flatnonzero(width == w)
            rows = packed[(starts[at_w][:, None] + np.arange(int(w) * BLOCK // 8, dtype="u8")).astype("i8")]
            wide = "<u4" if w > 16 else "<u2" if w > 8 else "u1"
            planes = np.unpackbits(rows, axis=1, bitorder="little").reshape(-1, int(w))
            if w not in (8, 16, 32):
                planes, narrow = np.zeros((len(planes), 8 * np.dtype(wide).itemsize), "u1"), planes
                planes[:, : int(w)] = narrow
            a[at_w] = np.packbits(planes.ravel(), bitorder="little").view(wide).reshape(-1, BLOCK)
    a[np.repeat(np.arange(blocks), odd), places] = values
    a += low[:, None]
    return [None if x else int(d) for d, x in zip(doc_ids.tolist(), null)], lengths, a.ravel()[:n]


def write_tokens(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int, text_col: str = "text") -> None:
    """Tokenize whole texts, end each with `end_id`, and write them to `path` in rising doc_id order.

    The rows are dealt out by ranges of doc_id and each range is written in order, so that (part, seq) orders the
    whole file. Null ids come first; rows that repeat an id stand side by side, by text. Null and empty texts are the end id alone.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = int(end_id).to_bytes(4, "little")

        def row() -> pa.RecordBatch:
            values = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([size // 4], pa.int64()), pa.array([encode_segment(ids, held)], pa.binary())]
            return pa.RecordBatch.from_arrays(values, ["part", "seq", "n_docs", "n_tokens", "segment"])

        for batch in batches:
            for k, got in zip(batch.column("doc_id").to_pylist(), tokenizer(tokenizer_path).encode(batch.column("t").to_pylist())):
                held.append(got + end)
                ids.append(k)
                size += len(got) + 4
                if size >= 4 * SEGMENT_TOKENS:
                    yield row()
                    seq, held, ids, size = seq + 1, [], [], 0
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("t")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "t")
    rows.mapInArrow(encode, "part int, seq int, n_docs int, n_tokens long, segment binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Read such a file: doc_id, start (ids of all documents before it), n_tokens, ids (binary), in any order.

    `digest`: ids_crc32, the unsigned crc32 of a document's ids, in place of ids.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(k).to_pylist() for k in ("part", "seq", "segment"))):
                keys, lengths, ids = decode_segment(raw)
                sizes = lengths.astype("i8")
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat, cuts, n = pa.py_buffer(ids.astype("<u4").tobytes()), 4 * ends, len(keys)
                if digest:
                    view, at = memoryview(flat), cuts.tolist()
                    last = pa.array([zlib.crc32(view[a:b]) for a, b in zip(at, at[1:])], pa.int64())
                else:
                    last = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts), flat]).cast(pa.binary())
                values = [pa.array(np.full(n, part, "i4")), pa.array(np.full(n, seq, "i4")), pa.array(keys, pa.int64()), pa.array(ends[:-1]), pa.array(sizes), last]
                yield pa.RecordBatch.from_arrays(values, ["part", "seq", "doc_id", "at", "n_tokens", name])

    name, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    stored = spark.read.parquet(path)
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written partition
    parts = parts.select("part", F.coalesce(F.sum("_all").over(over), F.lit(0)).alias("_part"))
    base = stored.select("part", "seq", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("_seg")).join(parts, "part")
    rows = stored.select("part", "seq", "segment").mapInArrow(decode, f"part int, seq int, doc_id long, at long, n_tokens long, {name} {kind}")
    base = base.select("part", "seq", (F.col("_seg") + F.col("_part")).alias("_base"))
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", name)
