"""Operator 10: language-model scores by a weighted backoff automaton.

The model is a smoothed trigram model over words and an end token.  Its states
are contexts: the root (none), each word, and each pair of words that training
texts go on from, the start of a text counting as a word.  With c the training
counts, N all tokens and V distinct ones, weights are

    root arc w:          p(w) = (c(w) + ADD) / (N + ADD (V + 1))
    arc w of context h:  p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K)
    failure arc h to h': K / (c(h) + K)

where h' is h without its first word and K is MASS for contexts of that length;
an arc is there only if hw was seen, and leads to the longest context that ends
in hw.  So the weights out of each state sum to one, failures included, with one
share for unknown words.  A text is read once from left to right: from the state
that the token before led to, along failure arcs until the token has an arc.

The tables grow with the corpus, so no machine holds all of them.  Tasks cut
their own texts into blocks of bounded size and write them as tokens; nothing
depends on ids, so equal or missing ids cost nothing.  A block sends the 56-bit
keys of its distinct n-grams, with their counts, by ranges of keys; totals come
back in the order of the keys that were sent, and make the part of the
automaton that the block's texts can reach, which gives the same scores as the
whole.  Where there are more than FAN blocks, groups of FAN are summed up first
and send on what they have as one block, so each range of keys gets bounded
parts at every size, and what is moved stays in proportion to the input.
Every count covers all training texts; nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ADD = 0.1
#: Weight of the shorter context against the counts of a context, by its length.
MASS = (4.0, 2.0)
#: Code points of texts in a block (one text at least).
BLOCK_CHARS = 6 << 20
#: Blocks that are summed up at once; also the most ranges of keys.
FAN = 4096
#: Tokens that one lane of the traversal reads.
LANE = 1024
KEY_BITS = 56
#: Hashes that no word is expected to have.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at 20 and 09-0D
    hashes = np.empty(len(words) + 1, np.uint64)
    hashes[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    hashes[-1] = END
    return hashes


def numbered(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, tokens as numbers of words); frequent words have small numbers, which take little room."""
    words, tokens, n = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return words[order], rank[tokens]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


class Block:
    """Tokens of some texts as numbers of the distinct words, the most frequent first; the n-grams among them.

    Word `len(words)` stands for the start of a text.  The n-grams are
    enumerated in the order of (context, word); a context of two words is the
    number of their pair.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray):
        self.words, self.tokens, self.lengths = words, tokens, lengths
        n, self.start = len(tokens), len(words)
        self.first = np.cumsum(lengths) - lengths
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = self.start
        # Pairs are (word before, word); triples (pair before, word), which the first token of a text has none of.
        self.pairs, self.pair_at = np.unique(before * (self.start + 1) + tokens, return_inverse=True)
        inner = np.ones(n, bool)
        inner[self.first] = False
        self.inner = np.flatnonzero(inner)
        self.triples, self.triple_at = np.unique(self.pair_at[self.inner - 1] * (self.start + 1) + tokens[self.inner], return_inverse=True)

    @classmethod
    def of(cls, texts: list[str]) -> Block:
        hashes = [word_hashes(x) for x in texts]
        return cls(*numbered(hashes), np.array([len(x) for x in hashes], np.int64))

    def keys(self) -> np.ndarray:
        """56-bit keys of words, pairs and triples, one after another; their lowest two bits are the order."""
        hashes = np.append(self.words, START)
        size = np.int64(self.start + 1)
        pair = _mixed(hashes[self.pairs // size] * np.uint64(0xBF58476D1CE4E5B9) + _mixed(hashes[self.pairs % size]))
        triple = _mixed(pair[self.triples // size] * np.uint64(0x94D049BB133111EB) + _mixed(hashes[self.triples % size]))
        return np.concatenate([(x >> np.uint64(64 - KEY_BITS)) & ~np.uint64(3) | np.uint64(k) for k, x in ((1, self.words), (2, pair), (3, triple))])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Training counts, in the order of keys; train says which texts teach."""
        teach = np.repeat(train, self.lengths)
        parts = ((self.tokens[teach], len(self.words)), (self.pair_at[teach], len(self.pairs)), (self.triple_at[teach[self.inner]], len(self.triples)))
        return np.concatenate([np.bincount(at, minlength=n) for at, n in parts])


class BackoffAutomaton:
    """The part of the model that a block reaches; counts are those of all training texts, in the order of the block's keys.

    State 0 is the root, 1 + w the word w as a context, and the pairs follow.
    """

    def __init__(self, block: Block, counts: np.ndarray, tokens: int, distinct: int, starts: int, add: float = ADD, mass: tuple[float, float] = MASS):
        n, m, size = len(block.words), len(block.pairs), np.int64(block.start + 1)
        of_word, of_pair, of_triple = counts[:n], counts[n : n + m], counts[n + m :]
        head, last = block.pairs // size, block.pairs % size
        pair, end = block.triples // size, block.triples % size
        self.size, self.start_state = size, 1 + block.start if starts else 0
        # Words as contexts; a text's end is the context of nothing. Pairs likewise.
        in_context = np.append(of_word, starts)
        in_context[:n][block.words == END] = 0
        pair_context = np.where(in_context[last] > 0, of_pair, 0)
        root = (of_word + add) / (tokens + add * (distinct + 1))
        self.root_weight = np.log10(root)
        self.root_target = np.where(in_context[:n] > 0, 1 + np.arange(n), 0)
        k1, k2 = mass
        p2 = (of_pair + k1 * root[last]) / (in_context[head] + k1)
        p3 = (of_triple + k2 * p2[_pair_of(block, last[pair], end)]) / (pair_context[pair] + k2)
        target2 = np.where(pair_context > 0, 1 + size + np.arange(m), self.root_target[last])
        target3 = target2[_pair_of(block, last[pair], end)]
        seen2, seen3 = of_pair > 0, of_triple > 0
        # Arcs ascend by state and word; a state's failure arc has the state and the weight.
        self.arc = np.concatenate([((1 + head) * size + last)[seen2], ((1 + size + pair) * size + end)[seen3]])
        self.arc_weight = np.log10(np.concatenate([p2[seen2], p3[seen3]]))
        self.arc_target = np.concatenate([target2[seen2], target3[seen3]])
        self.fail_state = np.concatenate([np.zeros(1 + size, np.int64), self.root_target[last]])
        self.fail_weight = np.log10(np.concatenate([[1.0], k1 / (in_context + k1), k2 / (pair_context + k2)]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, states after) of reading each word in each state."""
        weight, target = np.zeros(len(state)), np.zeros(len(state), np.int64)
        at = np.arange(len(state))
        while len(at):
            here = state[at]
            rooted = here == 0
            low = at[rooted]
            weight[low] += self.root_weight[word[low]]
            target[low] = self.root_target[word[low]]
            at = at[~rooted]
            if not len(at):
                break
            key = state[at] * self.size + word[at]
            arc = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[arc] == key if len(self.arc) else np.zeros(len(at), bool)
            weight[at[hit]] += self.arc_weight[arc[hit]]
            target[at[hit]] = self.arc_target[arc[hit]]
            at = at[~hit]
            weight[at] += self.fail_weight[state[at]]
            state[at] = self.fail_state[state[at]]
        return weight, target

    def traverse(self, block: Block, lane: int = LANE) -> np.ndarray:
        """log10 probability of each text.

        Lanes of at most `lane` tokens are read side by side.  A state is the
        longest context that ends with the last two tokens, so a lane that
        begins within a text reads two tokens before its own from the root, and
        is in the state in which the lane before it ends.
        """
        total = np.zeros(len(block.lengths))
        parts = -(-block.lengths // lane)
        text = np.repeat(np.arange(len(parts)), parts)
        within = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * lane
        warm = np.where(within > 0, np.minimum(2, within), 0)
        begin = block.first[text] + within - warm
        length = np.minimum(lane, block.lengths[text] - within) + warm
        order = np.argsort(-length, kind="stable")
        text, begin, length, warm = text[order], begin[order], length[order], warm[order]
        state = np.where(begin == block.first[text], self.start_state, 0)
        sums = np.zeros(len(text))
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, side="left"))
            weight, state = self.step(state[:live], block.tokens[begin[:live] + k])
            sums[:live] += np.where(k >= warm[:live], weight, 0.0)
        np.add.at(total, text, sums)
        return total


def _pair_of(block: Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b), which the block has."""
    return np.searchsorted(block.pairs, a * np.int64(block.start + 1) + b)


def _small(x: np.ndarray) -> bytes:
    """Numbers of at least 0 in as few bytes each as the greatest needs, all lowest bytes first; the first byte says how many."""
    width = -(-int(x.max()).bit_length() // 8) or 1 if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unsmall(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, : data[0]] = planes.T
    return x.view("<i8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences of equal width; the first byte is the width."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = -(-int(steps.max()).bit_length() // 8) or 1 if len(keys) else 1
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _power(n: int) -> int:
    return 1 << (max(1, n) - 1).bit_length()


def _cut(keys: np.ndarray, low: int, span: int, ranges: int) -> list[int]:
    """Where each of `ranges` equal ranges of the keys from low on, span in all, begins and ends."""
    step = span // ranges
    return [*np.searchsorted(keys, np.array([low + k * step for k in range(ranges)], np.uint64)).tolist(), len(keys)]


_PART = "owner long, low long, keys binary, n binary"
_PART_SCHEMA = pa.schema([("owner", pa.int64()), ("low", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def _parts(owner: int, keys: np.ndarray, n: np.ndarray, low: int, span: int, ranges: int) -> pa.RecordBatch:
    """Rows of an owner's keys and counts, one for each range that it reaches; keys are given from the range's start on."""
    edges = _cut(keys, low, span, ranges)
    rows = [(owner, low + k * (span // ranges), a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    columns = [[r[0] for r in rows], [r[1] for r in rows], [pack_keys(keys[a:b] - np.uint64(at)) for _, at, a, b in rows], [_small(n[a:b]) for _, _, a, b in rows]]
    return common.record(_PART_SCHEMA, columns)


def _added(parts: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(places of each part's keys among the distinct ones, distinct keys from the range's start on, their counts)."""
    keys = [unpack_keys(x.as_py()) for x in parts["keys"]]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate([_unsmall(x.as_py()) for x in parts["n"]]), len(found)).astype(np.int64)  # exact up to 2**53
    edges = np.cumsum([0] + [len(x) for x in keys])
    return [at[a:b] for a, b in zip(edges, edges[1:])], found, n


def _totals(parts: DataFrame, owners: int, span: int, fan: int) -> DataFrame:
    """parts (owner, low, keys, n) of `owners` owners, in ranges of `span` keys -> (owner, low, n, tokens, distinct, starts).

    n: totals of the keys of each part. Rows of owner -1 have the totals of all
    training tokens of a range instead. Owners are numbered from 0; a group is
    `fan` owners that follow one another.
    """
    spark = parts.sparkSession
    schema = pa.schema([("owner", pa.int64()), ("low", pa.int64()), ("n", pa.binary()), *((x, pa.int64()) for x in ("tokens", "distinct", "starts"))])
    types = "owner long, low long, n binary, tokens long, distinct long, starts long"
    end = int(END >> np.uint64(64 - KEY_BITS)) & ~3 | 1

    def answer(table: pa.Table) -> pa.Table:
        at, found, n = _added(table)
        low = table["low"][0].as_py()
        word = (found & np.uint64(3)) == 1
        totals = [int(n[word].sum()), int((n[word] > 0).sum()), int(n[found + np.uint64(low) == end].sum())]
        owners = [*table["owner"].to_pylist(), -1]
        columns = [owners, [low] * len(owners), [*(_small(n[x]) for x in at), None], *([None] * len(at) + [x] for x in totals)]
        return pa.Table.from_batches([common.record(schema, columns)])

    groups = (1 << KEY_BITS) // span * -(-owners // fan)
    tasks = max(common.shuffle_partitions(spark), -(-groups // 16))
    if owners <= fan:
        return parts.repartition(tasks, "low").groupBy("low").applyInArrow(answer, types)
    # More owners than one task should meet: groups of them become the owners of narrower ranges.
    ranges = min(fan, _power(-(-owners // fan)))
    group = F.floor(F.col("owner") / fan)
    parts = common.written(parts.withColumn("band", group), "parts")

    def merge(table: pa.Table) -> pa.Table:
        _, found, n = _added(table)
        low = table["low"][0].as_py()
        return pa.Table.from_batches([_parts(table["band"][0].as_py(), found + np.uint64(low), n, low, span, ranges)])

    def hand_down(table: pa.Table, above: pa.Table) -> pa.Table:
        at, found, _ = _added(table)
        above = above.sort_by("low")
        n = np.concatenate([_unsmall(x.as_py()) for x in above["n"]])
        if len(n) != len(found):
            raise RuntimeError("the answers don't fit the parts")
        none = [None] * len(at)
        return pa.Table.from_batches([common.record(schema, [table["owner"].combine_chunks(), table["low"].combine_chunks(), [_small(n[x]) for x in at], none, none, none])])

    merged = parts.repartition(tasks, "low", "band").groupBy("low", "band").applyInArrow(merge, _PART)
    above = common.written(_totals(merged, -(-owners // fan), span // ranges, fan), "totals")
    asked = above.where("owner >= 0").select(F.col("owner").alias("band"), (F.col("low") - F.pmod("low", F.lit(span))).alias("wide"), "low", "n").repartition(tasks, "wide", "band")
    down = parts.withColumnRenamed("low", "wide").select("owner", F.col("wide").alias("low"), "keys", "n", "band", "wide").repartition(tasks, "wide", "band")
    handed = down.groupBy("wide", "band").cogroup(asked.groupBy("wide", "band")).applyInArrow(hand_down, types)
    return handed.union(above.where("owner = -1").select(handed.columns))


def _blocks(docs: DataFrame, train, id_column: str, text_column: str, block_chars: int) -> DataFrame:
    """(task, place, doc_ids, words, tokens, lengths, train): a task's texts, cut into blocks."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    schema = pa.schema([("task", pa.int64()), ("place", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("words", "tokens", "lengths", "train"))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        hashes: list[np.ndarray] = []
        ids: list = []
        teach: list = []
        held = 0

        def close() -> pa.RecordBatch:
            words, tokens = numbered(hashes)
            lengths = np.array([len(x) for x in hashes], np.int64)
            return common.record(schema, [[task], [place], [ids], [words.astype("<u8").tobytes()], [_small(tokens)], [_small(lengths)], [np.array(teach, np.uint8).tobytes()]])

        for batch in common.nonempty(batches):
            for name, text, teaches in zip(batch.column(0).to_pylist(), common.strings(batch.column(1)), batch.column(2).to_pylist()):
                if held and held + len(text) > block_chars:
                    yield close()
                    place, hashes, ids, teach, held = place + 1, [], [], [], 0
                hashes.append(word_hashes(text))
                ids.append(name)
                teach.append(teaches)
                held += len(text)
        if ids:
            yield close()

    return rows.mapInArrow(run, "task long, place long, doc_ids array<long>, words binary, tokens binary, lengths binary, train binary")


def _unpacked(words: bytes, tokens: bytes, lengths: bytes, train: bytes) -> tuple[Block, np.ndarray]:
    return Block(np.frombuffer(words, "<u8"), _unsmall(tokens), _unsmall(lengths)), np.frombuffer(train, np.uint8).astype(bool)


_RESULT = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, train, id_column: str = "doc_id", text_column: str = "text", add: float = ADD, mass: tuple[float, float] = MASS, block_chars: int = BLOCK_CHARS, fan: int = FAN) -> DataFrame:
    """One row for each row of docs; train: a boolean Column over docs, true where a text teaches (null: it doesn't).

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score, score.
    Null and empty texts are one end token; rows that repeat an id, and rows
    without one, are rows of their own; an empty table gives no row. Where no
    text teaches, every token has the share of an unknown one.
    """
    spark = docs.sparkSession
    common.short_batches(spark)
    held = common.written(_blocks(docs, train, id_column, text_column, block_chars), "blocks", "zstd")
    # Blocks are numbered by task and place: one small row for each task.
    counts = sorted(tuple(r) for r in held.groupBy("task").agg(F.count("*").alias("n")).collect())
    numbers, blocks = [], 0
    for task, n in counts:
        numbers.append((task, blocks))
        blocks += n
    held = held.join(F.broadcast(spark.createDataFrame(numbers, "task long, before long")), "task").withColumn("block", F.col("before") + F.col("place")).drop("task", "place", "before")
    spread = common.shuffle_partitions(spark)
    ranges, span = min(fan, _power(max(blocks, spread))), 1 << KEY_BITS

    def send(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *payload in zip(*(c.to_pylist() for c in batch.columns)):
                block, teach = _unpacked(*payload)
                keys = block.keys()
                order = np.argsort(keys)
                yield _parts(number, keys[order], block.counts(teach)[order], 0, span, ranges)

    parts = held.select("block", "words", "tokens", "lengths", "train").mapInArrow(send, _PART)
    found = common.written(_totals(parts, blocks, span // ranges, fan), "totals", "zstd")
    sums = found.where("owner = -1").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "distinct", "starts"))).first()
    tokens, distinct, starts = sums["tokens"], sums["distinct"], sums["starts"]
    result = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), *((x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        (ids, *payload) = (own[c][0].as_py() for c in ("doc_ids", "words", "tokens", "lengths", "train"))
        block, teach = _unpacked(*payload)
        order = np.argsort(block.keys())
        n = np.empty(len(order), np.int64)
        n[order] = np.concatenate([_unsmall(x.as_py()) for x in answers.sort_by("low")["n"]])
        model = BackoffAutomaton(block, n, tokens, distinct, starts, add, mass)
        text = np.repeat(np.arange(len(ids)), block.lengths)
        known, base = (np.bincount(text, x[block.tokens], len(ids)) for x in (n[: len(block.words)] > 0, model.root_weight))
        return pa.Table.from_batches([common.record(result, [ids, teach, block.lengths, known.astype(np.int64), [tokens] * len(ids), base, model.traverse(block)])])

    tasks = max(spread, -(-blocks // 8))
    own = held.repartition(tasks, "block")
    answers = found.where("owner >= 0").select(F.col("owner").alias("block"), "low", "n").repartition(tasks, "block")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _RESULT)


def op10_backoff_lm(spark, sf_dir: str) -> DataFrame:
    scored = score_texts(common.table(spark, sf_dir, "documents"), common.crc_of_id() % 10 != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
