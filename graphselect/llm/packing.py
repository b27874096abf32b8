"""Operator 4: hierarchical multi-length packing.

Sequences come in tiers of context sizes, all powers of two.  A document is
routed to the smallest tier that holds it; the whole windows of a longer one go
to the largest tier directly, its rest is routed like a document.  Tiers are
packed from the longest to the shortest: a routed piece opens a window of its
tier, the gap after it is filled with the largest pieces of shorter tiers that
fit, and a last gap with the head of a piece that is too long, whose tail is
routed anew.  What is left when nothing fills a gap any more goes into windows
of falling powers of two, so that no window is padded.  Windows of a tier are
dealt to step groups of equal token count, the costliest first and in turns to
and fro, so that the groups' attention costs are close.

A task packs its own documents in blocks of bounded size; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunk_tokens import chunk_tokens

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
WINDOW = 2048
SHORTEST = 64
#: Ids that a task holds while it packs a block.
BLOCK_TOKENS = 1 << 22
#: Windows of the largest tier in a step group.
STEP_WINDOWS = 8


def pack(lengths: list[int], window: int = WINDOW, shortest: int = SHORTEST) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows as (size, [(document, start, length), ...]); window and shortest are powers of two.

    Each id of each document lies in one piece, and each window is full.
    """
    tiers = [window >> k for k in range((window // shortest).bit_length())]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    # Pieces of each tier, ascending by length: (length, document, start).
    routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def tier_of(n: int) -> int:
        return max(shortest, 1 << (n - 1).bit_length())

    for doc, n in enumerate(lengths):
        whole = n // window
        windows += [(window, [(doc, k * window, window)]) for k in range(whole)]
        if n % window:
            routed[tier_of(n % window)].append((n % window, doc, whole * window))
    for pieces in routed.values():
        pieces.sort()

    def take(gap: int, below: int) -> tuple[int, int, int] | None:
        """The longest piece of at most gap ids in tiers up to `below`."""
        for t in tiers:
            if t <= below and (t // 2 < gap or t == shortest) and routed[t]:  # the shortest tier has pieces of any length up to it
                k = bisect.bisect_right(routed[t], (gap, 1 << 62, 0)) - 1
                if k >= 0:
                    return routed[t].pop(k)
        return None

    def head(gap: int) -> tuple[int, int, int] | None:
        """The first gap ids of the shortest piece that is longer; its tail is routed anew."""
        for t in reversed(tiers):
            if t > gap and routed[t]:
                k = bisect.bisect_right(routed[t], (gap, 1 << 62, 0))
                if k < len(routed[t]):
                    n, doc, start = routed[t].pop(k)
                    bisect.insort(routed[tier_of(n - gap)], (n - gap, doc, start + gap))
                    return gap, doc, start
        return None

    for t in tiers:
        while routed[t]:
            n, doc, start = routed[t].pop()
            row, gap = [(doc, start, n)], t - n
            while gap and (piece := take(gap, t) or head(gap)):
                row.append((piece[1], piece[2], piece[0]))
                gap -= piece[0]
            if not gap:
                windows.append((t, row))
                continue
            # Nothing else is left: windows of falling powers of two.
            left, size = t - gap, t
            while left:
                while size > left:
                    size //= 2
                cut, room = [], size
                while room:
                    d, s, n = row.pop(0)
                    cut.append((d, s, min(n, room)))
                    if n > room:
                        row.insert(0, (d, s + room, n - room))
                    room -= cut[-1][2]
                windows.append((size, cut))
                left -= size
    return windows


def step_groups(windows: list, window: int = WINDOW, step_windows: int = STEP_WINDOWS) -> list[int]:
    """The step group of each window, counted from 0; a group has windows of one size and step_windows * window ids at most."""
    group, first = [0] * len(windows), 0
    for size in sorted({s for s, _ in windows}, reverse=True):
        own = [k for k, (s, _) in enumerate(windows) if s == size]
        own.sort(key=lambda k: (-sum(n * n for _, _, n in windows[k][1]), k))
        groups = -(-len(own) // (step_windows * window // size))
        for at, k in enumerate(own):
            turn, place = divmod(at, groups)
            group[k] = first + (place if turn % 2 == 0 else groups - 1 - place)
        first += groups
    return group


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int | None = END_ID, window: int = WINDOW, shortest: int = SHORTEST, step_windows: int = STEP_WINDOWS, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group and, with with_ids, ids.

    Null texts count as empty (their end id is packed); null ids are kept; a
    document that appears twice is packed twice; an empty table gives no row.
    Pieces of equal length are taken in the order of the documents in their task.
    """
    common.short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("tier", pa.int32()), ("step_group", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens = chunk_tokens(tokenizer)
        base = TaskContext.get().partitionId() << 33
        end = np.array([] if end_id is None else [end_id], "<u4")
        sequences = groups = 0

        def block(ids: list, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            windows = pack([len(x) for x in held], window, shortest)
            group = step_groups(windows, window, step_windows)
            out: list[tuple] = []
            for (size, pieces), g in zip(windows, group):
                offset = 0
                for d, s, n in pieces:
                    piece = held[d][s : s + n]
                    out.append((ids[d], s, n, zlib.crc32(piece.tobytes()), len(held[d]), base + sequences, offset, size, base + groups + g, *([piece.astype("i4")] if with_ids else [])))
                    offset += n
                sequences += 1
                if len(out) >= 4096:
                    yield common.record(schema, list(zip(*out)))
                    out = []
            groups += max(group, default=-1) + 1
            if out:
                yield common.record(schema, list(zip(*out)))

        ids: list = []
        held: list[np.ndarray] = []
        n = 0
        for batch in common.nonempty(batches):
            for name, x in zip(batch.column(0).to_pylist(), tokens.ids(common.strings(batch.column(1)))):
                ids.append(name)
                held.append(np.concatenate([x.astype("<u4"), end]))
                n += len(held[-1])
            if n >= block_tokens:
                yield from block(ids, held)
                ids, held, n = [], [], 0
        yield from block(ids, held)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + (", ids array<int>" if with_ids else ""))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
