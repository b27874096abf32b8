"""Operator 2: token files with directly addressable codes.

A file holds segments.  A segment holds the ids of consecutive documents as
directly addressable codes: each id is cut into chunks of `bits` bits, lowest
first; level k holds the k-th chunk of the ids that have one, and a bitmap that
says which of them go on to level k+1.  A rank directory counts the set bits
before each block of the bitmap, so the position of an id in the next level is
one directory entry and a popcount away.  Any id, and any range of ids, is read
without decoding what stands before it.

Segments are rows of a table (part, segment, first, n_docs, n_tokens, payload;
first: ids before it in its part) that
Spark's own committer writes: a task that is repeated, or an executor that is
lost, leaves no half-written segment behind, and any store that Spark can
write to will do.  A payload is self-contained; `export_files` puts payloads
into plain files on the machine that calls it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunk_tokens import chunk_tokens

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: A segment is closed once it has so many ids; a longer document has one of its own.
SEGMENT_TOKENS = 1 << 20
#: Bits of a bitmap that one rank directory entry covers.
RANK_BLOCK = 512
MAGIC = b"DAC1"
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class Level:
    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    def rank(self, i: int) -> int:
        """Set bits before position i."""
        block = i // RANK_BLOCK
        whole, rest = (block * RANK_BLOCK) // 8, i // 8
        n = int(self.ranks[block]) + int(_POPCOUNT[self.bitmap[whole:rest]].sum())
        if i % 8:
            n += int(_POPCOUNT[int(self.bitmap[rest]) & ((1 << i % 8) - 1)])
        return n

    def flags(self, a: int, b: int) -> np.ndarray:
        bits = np.unpackbits(self.bitmap[a // 8 : (b + 7) // 8], bitorder="little")
        return bits[a % 8 : a % 8 + b - a].view(bool)


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int = 8) -> bytes:
    """Payload of one segment; bits is 8 or 16."""
    dtype = np.dtype({8: "u1", 16: "<u2"}[bits])
    levels, rest = [], np.asarray(ids).astype("u4")
    while True:
        more = (rest >> bits) > 0 if bits < 32 else np.zeros(len(rest), bool)
        bitmap = np.packbits(more, bitorder="little")
        counts = np.concatenate([[0], np.cumsum(more, dtype="i8")])[: len(rest) + 1 : RANK_BLOCK]
        levels.append(((rest & ((1 << bits) - 1)).astype(dtype), bitmap, counts.astype("<u4")))
        if not more.any():
            break
        rest = rest[more] >> bits
    null = np.array([x is None for x in doc_ids], bool)
    named = np.array([x or 0 for x in doc_ids], "<i8")
    out = [MAGIC, struct.pack("<BBQQ", bits, len(levels), len(doc_ids), len(ids)), named.tobytes(), np.packbits(null).tobytes(), np.array(lengths, "<u8").tobytes()]
    for chunks, bitmap, counts in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), counts.tobytes()]
    return b"".join(out)


class Segment:
    """Random access to a payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.bits, n_levels, n_docs, self.n_tokens = struct.unpack_from("<BBQQ", payload, 4)
        at = 4 + struct.calcsize("<BBQQ")

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, dtype, n, at)
            at += x.nbytes
            return x

        named, null = take("<i8", n_docs), np.unpackbits(take("u1", (n_docs + 7) // 8))[:n_docs]
        self.doc_ids = [None if x else y for x, y in zip(null.tolist(), named.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(take("<u8", n_docs).astype("i8"))])
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<Q", 1)[0])
            self.levels.append(Level(take({8: "u1", 16: "<u2"}[self.bits], n), take("u1", (n + 7) // 8), take("<u4", n // RANK_BLOCK + 1)))

    def token(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = level.rank(i), shift + self.bits
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids at positions a to b."""
        value = np.zeros(max(0, b - a), "<u4")
        where: np.ndarray | slice = slice(None)
        for k, level in enumerate(self.levels):
            if b <= a:
                break
            value[where] |= level.chunks[a:b].astype("u4") << np.uint32(k * self.bits)
            go_on = level.flags(a, b)
            where = np.flatnonzero(go_on) if isinstance(where, slice) else where[go_on]
            a = level.rank(a)
            b = a + int(go_on.sum())
        return value

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def token_segments(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int | None = END_ID, id_column: str = "doc_id", text_column: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Segments of all documents in ascending id order (null ids first, equal ids in the order of their texts' hashes).

    Null texts count as empty; rows that repeat an id, or all of a row, are
    documents of their own; an empty table has no segment.  One range exchange,
    which splits even rows that are all equal; a task holds one segment at a time.
    """
    common.short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens, part, segment = chunk_tokens(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([] if end_id is None else [end_id], "<u4")
        names: list = []
        held: list[np.ndarray] = []
        first = n = 0

        def close() -> pa.RecordBatch:
            return common.record(schema, [[part], [segment], [first], [len(names)], [n], [encode_segment(np.concatenate([*held, np.array([], "u4")]), names, [len(x) for x in held])]])

        for batch in common.nonempty(batches):
            for name, ids in zip(batch.column(0).to_pylist(), tokens.ids(common.strings(batch.column(1)))):
                ids = np.concatenate([ids.astype("<u4"), end])
                if names and n + len(ids) > segment_tokens:
                    yield close()
                    segment, first, names, held, n = segment + 1, first + n, [], [], 0
                names.append(name)
                held.append(ids)
                n += len(ids)
        if names:
            yield close()

    return common.in_id_order(rows).mapInArrow(run, "part int, segment int, first long, n_docs long, n_tokens long, payload binary")


def write_token_files(docs: DataFrame, path: str, **options) -> None:
    token_segments(docs, **options).write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Rows of documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with with_ids, ids."""
    files = spark.read.schema("part int, segment int, first long, n_docs long, n_tokens long, payload binary").parquet(path)
    # One number for each part, of which there are as many as partitions that wrote: a bounded list.
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    first, at = [], 0
    for part, n in sums:
        first.append((part, at))
        at += n
    firsts = spark.createDataFrame(first, "part int, before long")
    rows = files.join(F.broadcast(firsts), "part").select((F.col("before") + F.col("first")).alias("base"), "payload")
    more = [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *more])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Segment(payload.as_py())
                ids = [s.document(k) for k in range(len(s.doc_ids))]
                columns = [s.doc_ids, (s.starts[:-1] + base).tolist(), [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids]]
                yield common.record(schema, columns + ([[x.astype("i4") for x in ids]] if with_ids else []))

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def export_files(spark, path: str, folder: str) -> int:
    """Plain files `<part>-<segment>.dac` in a local folder, one segment at a time through the driver; returns their number."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in spark.read.parquet(path).select("part", "segment", "payload").toLocalIterator():
        with open(f"{folder}/{row['part']:06d}-{row['segment']:06d}.dac", "wb") as f:
            f.write(row["payload"])
        n += 1
    return n


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    path = common.new_folder(spark, "tokens")
    write_token_files(common.table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, with_ids=False)
