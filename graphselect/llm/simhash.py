"""Operator 8: SimHash near-duplicates by tiled exact comparison.

Each document gets a 64-bit fingerprint of its word shingles; two documents are
linked if their fingerprints differ in at most `radius` bits.  Distinct
fingerprints only are compared: they are grouped by population count into tiles
of bounded size, and tiles whose population counts are further apart than the
radius never meet, since the counts of two words differ by no more than the
words do.  Within two tiles that meet, rows are ordered by the population
counts of their four quarters, and blocks are skipped by the same argument on
the quarters' sum.  Blocks that remain are compared with exclusive-or and bit
counts.  A pair of tiles returns a spanning forest of its links, not the links,
so a group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a tile: at least and at most; between them, as many as give each shuffle partition a tile.
TILE = (4096, 65536)
BLOCK = 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_POSITION = (np.arange(8, dtype=np.int64) * 256)[None, :]


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of the shingles of words of a text, in its order; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and split at 20 and 09-0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of words of a text; 0 if it has no word."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _POSITION).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row of docs; null texts count as empty."""
    common.short_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            yield common.record(schema, [batch.column(0), [fingerprint(x) for x in common.strings(batch.column(1))]])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Disjoint sets over 0..n-1 with whole arrays at once; a root is its set's least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while True:
            q = self.parent[p]
            if (q == p).all():
                self.parent[x] = p
                return p
            p = q

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _ordered(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fps in the order of their quarters' population counts, and each block's least and greatest counts."""
    fps = fps.astype(np.int64).view(np.uint64)
    quarters = _quarters(fps)
    order = np.lexsort((*quarters.T[::-1], quarters.sum(axis=1)))
    fps, quarters = fps[order], quarters[order]
    starts = np.arange(0, len(fps), BLOCK)
    return fps, starts, np.minimum.reduceat(quarters, starts), np.maximum.reduceat(quarters, starts)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints of a and b (of a alone, if b is None); fingerprints are distinct.

    Links within a, or within b, count only where b is None.
    """
    fa, sa, low_a, high_a = _ordered(a)
    fb, sb, low_b, high_b = (fa, sa, low_a, high_a) if b is None else _ordered(b)
    all_fps = fa if b is None else np.concatenate([fa, fb])
    shift = 0 if b is None else len(fa)
    forest = Forest(len(all_fps))
    for k, start in enumerate(sa.tolist()):
        apart = np.maximum(np.maximum(low_a[k] - high_b, low_b - high_a[k]), 0).sum(axis=1)
        near = np.flatnonzero(apart <= radius)
        if b is None:
            near = near[near >= k]
        rows = fa[start : start + BLOCK, None]
        for m in near.tolist():
            i, j = np.nonzero(np.bitwise_count(rows ^ fb[None, sb[m] : sb[m] + BLOCK]) <= radius)
            i, j = i + start, j + sb[m] + shift
            forest.link(*((i, j) if b is not None or m != k else (i[i < j], j[i < j])))
    nodes = np.arange(len(all_fps))
    roots = forest.find(nodes)
    leaves = np.flatnonzero(roots != nodes)
    return all_fps[leaves].view(np.int64), all_fps[roots[leaves]].view(np.int64)


def _thinned(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges (i, j) of a spanning forest of 0..n-1 with the least distances d."""
    forest, chosen = Forest(n), []
    for step in np.unique(d):
        at = np.flatnonzero(d == step)
        while len(at):
            a, b = forest.find(i[at]), forest.find(j[at])
            at = at[a != b]
            # Every root takes one edge to a smaller root: such edges close no circle.
            low, high = np.minimum(forest.find(i[at]), forest.find(j[at])), np.maximum(forest.find(i[at]), forest.find(j[at]))
            _, first = np.unique(high, return_index=True)
            chosen.append(at[first])
            forest.link(low[first], high[first])
    return np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int64)


def closest_links(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, radius: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """As tile_links for (fingerprints, names), of which fingerprints may repeat: pairs of names, from a spanning forest with the least distances.

    At most about `most` pairs are held at once; a forest of forests is a forest of all.
    """
    def arranged(fps: np.ndarray, names: np.ndarray) -> tuple:
        order = np.argsort(fps, kind="stable")
        fps, names = fps[order], names[order]
        _, starts, low, high = _ordered(fps)
        place = np.lexsort((*_quarters(fps).T[::-1], _quarters(fps).sum(axis=1)))
        return fps[place].astype(np.int64).view(np.uint64), names[place], starts, low, high

    fa, na, sa, low_a, high_a = arranged(*a)
    fb, nb, sb, low_b, high_b = (fa, na, sa, low_a, high_a) if b is None else arranged(*b)
    names, shift = (na, 0) if b is None else (np.concatenate([na, nb]), len(na))
    held, n = [np.zeros((3, 0), np.int64)], 0
    for k, start in enumerate(sa.tolist()):
        apart = np.maximum(np.maximum(low_a[k] - high_b, low_b - high_a[k]), 0).sum(axis=1)
        near = np.flatnonzero(apart <= radius)
        if b is None:
            near = near[near >= k]
        rows = fa[start : start + BLOCK, None]
        for m in near.tolist():
            bits = np.bitwise_count(rows ^ fb[None, sb[m] : sb[m] + BLOCK])
            i, j = np.nonzero(bits <= radius)
            if b is None and m == k:
                i, j = i[i < j], j[i < j]
            if len(i):
                held.append(np.stack([i + start, j + sb[m] + shift, bits[i, j].astype(np.int64)]))
                n += len(i)
            if n > most:
                edges = np.concatenate(held, axis=1)
                held = [edges[:, _thinned(len(names), *edges)]]
                n = 0
    edges = np.concatenate(held, axis=1)
    edges = edges[:, _thinned(len(names), *edges)]
    return names[edges[0]], names[edges[1]]


def _tiles(counts: dict[int, int], size: int, radius: int) -> list[tuple[int, int, int, int, int]]:
    """For each population count: (count, first tile, tiles, first and last tile that its tiles meet); small counts share a tile."""
    groups: list[list[int]] = []  # members
    held = 0
    for c in sorted(counts):
        if groups and held + counts[c] <= size:
            groups[-1].append(c)
            held += counts[c]
        else:
            groups.append([c])
            held = counts[c]
    first, spans = 0, []
    for g in groups:
        n = max(1, -(-sum(counts[c] for c in g) // size))
        spans.append((g, first, n))
        first += n
    out = []
    for g, at, n in spans:
        meets = [(t, t + m - 1) for h, t, m in spans if h[0] - g[-1] <= radius and g[0] - h[-1] <= radius]
        out += [(c, at, n, min(x for x, _ in meets), max(y for _, y in meets)) for c in g]
    return out


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct(fp long), without repetition -> links (u, v) that connect what pairs within the radius connect."""
    return _tiled(distinct.select("fp", F.col("fp").alias("name")), radius, lambda a, b: tile_links(a[0], None if b is None else b[0], radius))


def closest_near_links(named: DataFrame, radius: int) -> DataFrame:
    """named(fp long, name long), without repetition of names -> links (u, v) of names: in each two tiles a spanning forest, the closest pairs first."""
    return _tiled(named, radius, lambda a, b: closest_links(a, b, radius))


def _tiled(named: DataFrame, radius: int, links: Callable) -> DataFrame:
    spark = named.sparkSession
    counted = named.select("fp", "name", F.bit_count("fp").alias("ones"))
    counts = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    size = max(TILE[0], min(TILE[1], sum(counts.values()) // common.shuffle_partitions(spark)))
    plan = spark.createDataFrame(_tiles(counts, size, radius), "ones int, first int, n int, low int, high int")
    tiled = counted.join(F.broadcast(plan), "ones").withColumn("tile", F.col("first") + F.pmod(F.xxhash64("name"), F.col("n")).cast("int"))
    # Of each row its two numbers, so that they stay beside each other.
    tiles = tiled.groupBy("tile").agg(F.collect_list(F.struct("fp", "name")).alias("rows"), F.first("low").alias("low"), F.first("high").alias("high"))
    tiles = tiles.select("tile", "low", "high", F.col("rows.fp").alias("fps"), F.col("rows.name").alias("names"))
    met = tiles.withColumn("other", F.explode(F.sequence("low", "high"))).select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fps", "names")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(pair: pa.Table) -> pa.Table:
        own = {t: (np.asarray(x.values), np.asarray(y.values)) for t, x, y in zip(pair["tile"].to_pylist(), pair["fps"], pair["names"])}
        a, b = pair["a"][0].as_py(), pair["b"][0].as_py()
        if a not in own or b not in own:  # the other tile is empty
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(x) for x in links(own[a], own[b] if a != b else None)], schema=schema)

    # A pair is little data and much work: partitions must not be merged by size.
    return met.repartition(common.shuffle_partitions(spark), "a", "b").groupBy("a", "b").applyInArrow(compare, "u long, v long")


def components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """As placed_components; fingerprints within the radius are linked."""
    return placed_components(rows, lambda distinct: near_links(distinct.select("fp"), radius))


def placed_components(rows: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows(doc_id, fp), and links (u, v) from distinct fps -> (fp, root, component_id), one row for each distinct fp.

    root is the same for all fingerprints that links connect; component_id is
    the smallest id there, null only if all rows there have null ids.
    """
    distinct = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    nodes = connected_components(links(distinct))
    linked = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = common.written(linked, "roots")
    least = common.written(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return common.written(linked.join(least, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): one row for each row of docs.

    component_id is the smallest id that links reach; it is null only if every
    row reached has a null id.  Equal texts have equal fingerprints and are one
    component; rows with the same id are separate rows with the same component.
    """
    rows = common.written(fingerprints(docs, id_column, text_column), "fingerprints")
    return rows.join(components(rows, radius), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of docs (doc_id, text and any others), one of each component: the one with the smallest id.

    Of rows that repeat that id in a component one stays; an id whose texts are
    in several components may stay in each.  Rows with null ids go if their
    component has an id; of a component without ids one row stays.
    """
    rows = common.written(fingerprints(docs), "fingerprints")
    return one_of_each(docs, rows, components(rows, radius), fingerprint)


def one_of_each(docs: DataFrame, rows: DataFrame, found: DataFrame, fp_of: Callable[[str], int]) -> DataFrame:
    """As one_of_each_group: rows(doc_id, fp) of docs, found as of placed_components, and the function from texts to fps."""
    fp, root = common.fresh_names(docs, "_fp", "_root")
    schema, at = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]), docs.columns.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            fps = [fp_of(x) for x in common.strings(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=[*batch.schema.names, fp])

    named = rows.where("doc_id is not null").join(found, "fp")
    placed = common.written(named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "placed")
    # The ids that go grow with the input: texts and ids meet by exchange at every size.
    kept = docs.where("doc_id is not null").join(placed.where("doc_id <> component_id or n > 1").select("doc_id").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    repeated = placed.where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        # Texts of one id may be in several components: which of its rows stay is told by their fps.
        first = named.where("doc_id = component_id").join(repeated, "doc_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("row")).select("row.doc_id", F.col("row.fp").alias(fp))
        several = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).mapInArrow(run, schema)
        kept = kept.unionByName(several.join(first, ["doc_id", fp], "left_semi").dropDuplicates(["doc_id", fp]).select(*docs.columns))
    if rows.where("doc_id is null").isEmpty():
        return kept
    nameless = docs.where("doc_id is null")
    marked = nameless.mapInArrow(run, schema)
    lone = found.where("component_id is null").select(F.col("fp").alias(fp), F.col("root").alias(root))
    return kept.unionByName(marked.join(lone, fp).dropDuplicates([root]).select(*docs.columns))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
