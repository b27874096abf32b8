"""Near copies for the pipeline: SimHash proposes, shared rare shingles propose the rest, the likeness of shingle sets decides.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more.  The tiled exact comparison of the sets' SimHashes
proposes pairs, which are confirmed on the whole sets and give components.  What
is not in one component yet is proposed again by prefixes, which miss no pair:
sets of n and m members that are alike have a member in common among the first
n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 of any order of all members.  The
order here begins with rare ones.  Pairs within a component are never made, so
a group of near copies costs pairs in proportion to its size.  Members that
only one component has go first, without any pair.  Of what is left, pairs are
made where their signatures are: bits of odd counts, which differ in no more
places than the sets have members that are not shared.  So hardly any pair that
is not alike is made, and whole sets are moved for few others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import BLOCK, SEED, closest_near_links, fingerprint_of, one_of_each, placed_components, shingle_hashes

SHINGLE = 5
#: Differing bits of SimHashes up to which texts are proposed by the tiled comparison.
RADIUS = 12
#: Bits of the filter of texts whose sets are needed: a matter of speed only.
BITMAP = 1 << 24
#: Counters that tell frequent shingles from rare ones: a matter of speed only.
COUNTERS = 1 << 18


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct five-word shingles, ascending; a shorter text is one shingle, and one without words none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def name_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def set_name(text: str) -> int:
    """The same for texts with equal shingle sets."""
    return name_of(shingles(text))


def alike(common_size, a, b):
    """Whether sets of sizes a and b with so many members in common have a similarity of 0.8 or more."""
    return 9 * common_size >= 4 * (a + b)


def _texts(docs: DataFrame, run: Callable, schema: str) -> DataFrame:
    common.short_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, schema)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, tokens binary): the shingle set of each fp of wanted(fp), which is without repetition."""
    schema = pa.schema([("fp", pa.int64()), ("tokens", pa.binary())])
    place = F.col("fp").bitwiseAND(BITMAP - 1)
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    bitmap = bitmap.view(np.uint64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.nonempty(batches):
            found = []
            for text in common.strings(batch.column(0)):
                own = shingles(text)
                fp = name_of(own)
                at = fp & (BITMAP - 1)
                if fp not in seen and int(bitmap[at >> 6]) >> (at & 63) & 1:
                    seen.add(fp)
                    found.append((fp, own.tobytes()))
            if found:
                yield common.record(schema, [list(x) for x in zip(*found)])

    got = _texts(docs, run, "fp long, tokens binary")
    return got.join(wanted.hint("merge"), "fp", "left_semi").dropDuplicates(["fp"])


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose sets are alike.

    A pair moves two sets, so pairs are taken in turns, whose sets have about as
    many bytes as docs; a turn takes all pairs of some sets u, and moves only
    those sets u.
    """
    sets = common.written(sets_of(docs, pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()), "sets")
    common.short_batches(pairs.sparkSession)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    left, right = sets.select(F.col("fp").alias("u"), F.col("tokens").alias("a")), sets.select(F.col("fp").alias("v"), F.col("tokens").alias("b"))

    def like(a: pa.Scalar, b: pa.Scalar) -> bool:
        x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
        return bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            keep = pa.array([like(a, b) for a, b in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield batch.select([0, 1]).filter(keep).cast(schema)

    sizes = sets.select("fp", F.length("tokens").alias("bytes"))
    weighed = pairs.join(sizes.select(F.col("fp").alias("u"), F.col("bytes").alias("a")), "u").join(sizes.select(F.col("fp").alias("v"), F.col("bytes").alias("b")), "v")
    moved = weighed.agg(F.sum(F.col("a").cast("long") + F.col("b"))).first()[0] or 0
    turns = -(-max(moved, 1) // max(common.known_bytes(docs), common.PARTITION_BYTES))
    found = None
    for turn in range(turns):
        mine = F.pmod(F.xxhash64("u"), F.lit(turns)) == turn
        got = common.written(pairs.where(mine).join(left.where(mine), "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "alike")
        found = got if found is None else found.union(got)
    common.discard(sets)
    return found


def signature(found: np.ndarray) -> np.ndarray:
    """Words of bits, 2 to 4 for each member of the set: a bit is 1 if an odd number of members fall on it."""
    n = max(64, 1 << int(2 * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount(((found >> np.uint64(20)) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The signature that the set has in width words."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def differing(bits: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of places in bits the number of bits that differ: never more than the members that only one of the two sets has."""
    width = np.array([len(x) for x in bits], np.int64)
    least, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        step = max(1, (1 << 18) // w)
        for some in (pairs[k : k + step] for k in range(0, len(pairs), step)):
            used, place = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
            rows = np.stack([_folded(bits[k], w) for k in used.tolist()])
            out[some] = np.bitwise_count(rows[place[: len(some)]] ^ rows[place[len(some) :]]).sum(axis=1)
    return out


def maybe_alike(differ, a, b):
    """Whether sets of sizes a and b whose signatures differ in so many bits may be alike; all that are alike may."""
    return 9 * differ <= a + b


def named_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, print, size, bits binary): the name of each text's shingle set, and the set's SimHash, size and signature; null texts count as empty."""
    common.short_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("print", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            sets = [shingles(x) for x in common.strings(batch.column(1))]
            yield common.record(schema, [batch.column(0), [name_of(x) for x in sets], [fingerprint_of(x) for x in sets], [len(x) for x in sets], [signature(x).tobytes() for x in sets]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, print long, size long, bits binary")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(fp, print, size, bits), one row for each fp of named_fingerprints."""
    return rows.groupBy("fp").agg(*(F.first(x).alias(x) for x in ("print", "size", "bits")))


def closeness(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(u, v, d): those of pairs(u, v) that may be alike, and the share of their members that differ at least."""
    common.short_batches(pairs.sparkSession)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.float64())])
    left, right = (named.select(F.col("fp").alias(x), F.col("size").alias("size_" + x), F.col("bits").alias("bits_" + x)) for x in "uv")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            n = batch.num_rows
            bits = [np.frombuffer(x.as_buffer(), np.uint64) for k in (4, 5) for x in batch.column(k)]
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            differ = differing(bits, np.arange(n), np.arange(n, 2 * n))
            keep = pa.array(maybe_alike(differ, a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(differ / np.maximum(a + b, 1))], schema=schema).filter(keep)

    return pairs.join(left, "u").join(right, "v").select("u", "v", "size_u", "size_v", "bits_u", "bits_v").mapInArrow(run, "u long, v long, d double")


def prefix_length(n: int) -> int:
    """Of a set of n members, so many of the first in any common order have one that an alike set has among its own."""
    return n - -(-4 * n // 5) + 1 if n else 0


def levels_of(docs: DataFrame) -> np.ndarray:
    """For each counter (a shingle's last bits) a level that grows with the number of texts that have such shingles."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    width = COUNTERS // 64

    def count(batches) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in common.nonempty(batches):
            for text in common.strings(batch.column(0)):
                np.add.at(held, (shingles(text) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield common.record(schema, [list(range(64)), [held[k * width : (k + 1) * width].tobytes() for k in range(64)]])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in parts["counts"])
        return pa.table([pa.array([parts["part"][0].as_py()], pa.int32()), pa.array([np.frexp(total.astype(np.float64))[1].astype(np.uint8).tobytes()], pa.binary())], schema=schema)

    levels = np.zeros(COUNTERS, np.uint8)
    for row in _texts(docs, count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # COUNTERS bytes
        levels[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.uint8)
    return levels


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(fp, size long, tokens binary): of each distinct shingle set its size and its prefix in an order of levels, then of hashes."""
    schema = pa.schema([("fp", pa.int64()), ("size", pa.int64()), ("tokens", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            out = {}
            for text in common.strings(batch.column(0)):
                own = shingles(text)
                order = np.argsort(shared.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")  # own is ascending
                out[name_of(own)] = (len(own), own[order[: prefix_length(len(own))]].tobytes())
            yield common.record(schema, [list(out), *(list(x) for x in zip(*out.values()))])

    return _texts(docs, run, "fp long, size long, tokens binary").dropDuplicates(["fp"])


def apart_pairs(tokens: np.ndarray, at: np.ndarray, place: np.ndarray, names: np.ndarray, roots: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of names with different roots that have a token at places and with sizes that let them be alike.

    Token k is at place[k] of the prefix of the set at[k]; names, roots and sizes
    are of sets.  A pair that is alike comes at the first token it has in common;
    it may come again.
    """
    order = np.argsort(tokens, kind="stable")
    tokens, at, place = tokens[order], at[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(tokens))
    if len(starts):
        own = roots[at]
        mixed = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
        starts, ends = starts[mixed], ends[mixed]
    for a, b in zip(starts.tolist(), ends.tolist()):
        left = sizes[at[a:b]] - place[a:b]  # members from this one on
        order = np.argsort(sizes[at[a:b]], kind="stable")
        left, own = left[order], at[a:b][order]
        n = sizes[own]
        for k in range(0, b - a, BLOCK):
            # Of sets that are no smaller, those of up to 5/4 of the size.
            for m in range(k, int(np.searchsorted(4 * n, 5 * n[min(k + BLOCK, b - a) - 1], side="right")), 4096):
                x, y = slice(k, k + BLOCK), slice(m, m + 4096)
                fit = 9 * np.minimum(left[x, None], left[None, y]) >= 4 * (n[x, None] + n[None, y])
                fit &= roots[own[x], None] != roots[None, own[y]]
                i, j = np.nonzero(fit)
                i, j = i + k, j + m
                i, j = own[i[i < j]], own[j[i < j]]
                if len(i):
                    yield np.minimum(names[i], names[j]), np.maximum(names[i], names[j])


def apart_members(tokens: np.ndarray, at: np.ndarray, place: np.ndarray, roots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Those of 0..len(tokens)-1 that are in a pair of apart_pairs; of tokens that more than 2048 sets have, all if roots differ."""
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    own = roots[at[order]]
    ends = np.append(starts[1:], len(tokens))
    if len(starts):
        mixed = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
        starts, ends = starts[mixed], ends[mixed]
    found = [np.zeros(0, np.int64)]
    for a, b in zip(starts.tolist(), ends.tolist()):
        some = order[a:b]
        if b - a <= 2048:
            n, root = sizes[at[some]], own[a:b]
            left = n - place[some]
            fit = 9 * np.minimum(left[:, None], left[None, :]) >= 4 * (n[:, None] + n[None, :])
            fit &= root[:, None] != root[None, :]
            some = some[fit.any(axis=1)]
        found.append(some)
    return np.concatenate(found)


def shared_members(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """roots(fp, root) of all distinct sets of docs -> (fp, token, left): members of prefixes that sets with other roots have in theirs, and how many follow in the set's order.

    Rows are in proportion to members of prefixes, however many sets share one.
    """
    marked = prefixes(docs, levels_of(docs)).join(roots, "fp")
    parts = common.partitions_for(docs)
    names = ["part", "tokens", "at", "place", "names", "sizes", "joined", "roots"]
    block = pa.schema([(n, pa.binary() if k else pa.int32()) for k, n in enumerate(names)])

    def deal(batches) -> Iterator[pa.RecordBatch]:
        """Of each batch and part the prefixes' members (32 bits: what is equal there is compared anyway), their sets, and roots of sets that are not their own."""
        for batch in common.nonempty(batches):
            found = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
            n = np.array([len(x) for x in found], np.int64)
            tokens = np.concatenate(found)
            at = np.repeat(np.arange(len(n)), n)
            # A lower place than the true one lets more pairs pass, and loses none.
            place = np.minimum(np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n), 65535)
            part = (tokens >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            fps, sizes, roots = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            rows = []
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(some):
                    sets, index = np.unique(at[some], return_inverse=True)
                    joined = np.flatnonzero(roots[sets] != fps[sets])
                    rows.append((int(part[some[0]]), *(x.tobytes() for x in (tokens[some].astype("<u4"), index.astype("<u2"), place[some].astype("<u2"), fps[sets], sizes[sets].astype("<u4"), joined.astype("<u2"), roots[sets[joined]]))))
            if rows:
                yield common.record(block, [list(x) for x in zip(*rows)])

    def meet(rows: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows[name]]
        own = read("names", "<i8")
        first = np.cumsum([0, *map(len, own)])
        whole = lambda name: np.concatenate([x.astype(np.int64) + f for x, f in zip(read(name, "<u2"), first)])
        own = np.concatenate(own)
        roots = own.copy()
        roots[whole("joined")] = np.concatenate(read("roots", "<i8"))
        tokens, at, place, sizes = np.concatenate(read("tokens", "<u4")), whole("at"), np.concatenate(read("place", "<u2")).astype(np.int64), np.concatenate(read("sizes", "<u4")).astype(np.int64)
        some = apart_members(tokens, at, place, roots, sizes)
        token = (rows["part"][0].as_py() << 32) + tokens[some].astype(np.int64)
        return pa.table([pa.array(own[at[some]]), pa.array(token), pa.array((sizes[at[some]] - place[some]))], names=["fp", "token", "left"])

    dealt = marked.select("fp", "size", "tokens", "root").mapInArrow(deal, "part int, " + ", ".join(f"{n} binary" for n in names[1:]))
    return dealt.repartition(parts, "part").groupBy("part").applyInArrow(meet, "fp long, token long, left long")


def rest_of_pairs(docs: DataFrame, roots: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """roots(fp, root) of all distinct sets of docs -> pairs (u, v) with different roots: all that are alike, and few others.

    named is distinct_sets of docs, which is made here if it is not given.
    """
    if named is None:
        named = common.written(distinct_sets(named_fingerprints(docs)), "named")
    parts = common.partitions_for(docs)
    shared = common.written(shared_members(docs, roots), "shared")

    def meet(rows: pa.Table) -> pa.Table:
        column = lambda name: rows[name].to_numpy()
        names, first, at = np.unique(column("fp"), return_index=True, return_inverse=True)
        bits = [np.frombuffer(rows["bits"][k].as_buffer(), np.uint64) for k in first.tolist()]
        sizes, own = column("size")[first], column("root")[first]
        found, held, n = [], [], 0

        def settle() -> None:
            pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *held]))
            u, v = pairs // len(names), pairs % len(names)
            found.append(pairs[maybe_alike(differing(bits, u, v), sizes[u], sizes[v])])
            held.clear()

        for u, v in apart_pairs(column("token"), at, sizes[at] - column("left"), np.arange(len(names)), own, sizes):
            held.append(u * len(names) + v)
            n += len(u)
            if n > 1 << 20:
                settle()
                n = 0
        settle()
        pairs = np.unique(np.concatenate(found))
        u, v = names[pairs // len(names)], names[pairs % len(names)]
        return pa.table([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    marked = shared.join(named.select("fp", "size", "bits"), "fp").join(roots, "fp").withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"))
    return marked.repartition(parts, "part").groupBy("part").applyInArrow(meet, "u long, v long").distinct()


def _roots(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) of all of distinct(fp)."""
    nodes = connected_components(links).withColumnRenamed("node", "fp")
    return common.written(distinct.select("fp").join(nodes, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def close_links(docs: DataFrame, named: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct_sets of docs -> links (u, v) that connect what alike sets connect."""
    pairs = common.written(closest_near_links(named.select(F.col("print").alias("fp"), F.col("fp").alias("name")), radius).distinct(), "candidates")
    # First for each set its closest partner and, of all, the one whose hash is least: rows in proportion to sets. Most of the other pairs are within a component then.
    measured = common.written(closeness(pairs, named), "measured")
    both = measured.union(measured.select("v", "u", "d"))
    hub = F.xxhash64("v")
    best = both.groupBy("u").agg(F.min(F.struct("d", hub.alias("hub"), "v"))["v"].alias("a"), F.min(F.struct(hub.alias("hub"), "v"))["v"].alias("b"))
    best = best.select("u", F.explode(F.array("a", "b")).alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = confirmed(docs, common.written(best, "closest"))
    rest = common.written(rest_of_pairs(docs, _roots(named, links), named), "candidates")
    return links.union(confirmed(docs, rest))


def one_of_each_close_copy(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of docs, one of each component of links, as in simhash.one_of_each_group.

    Links are all pairs of texts whose five-word shingle sets have a similarity
    of 0.8 or more.  radius is a matter of speed only: SimHashes that differ in
    up to so many bits are compared first, and prefixes find what they leave.
    """
    rows = common.written(named_fingerprints(docs), "fingerprints")

    def links(distinct: DataFrame) -> DataFrame:
        named = common.written(distinct_sets(rows), "named")
        return common.written(close_links(docs, named, radius), "links")

    return one_of_each(docs, rows.select("doc_id", "fp"), placed_components(rows.select("doc_id", "fp"), links), set_name)
