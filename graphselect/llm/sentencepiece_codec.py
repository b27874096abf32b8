"""Operator 1: SentencePiece encoding and decoding with a prefix table.

A merge-type (BPE) encoding has a prefix property: the encoding of a prefix
that ends where a token ends is the same row of tokens.  So every prefix of a
text has one last token, and the table of these last tokens holds the encoding
of all prefixes at once.  The last token at an end position is found among the
vocabulary entries that a string automaton reports there: it is the one whose
join with the last token of the prefix before it is stable, i.e. merging the
two side by side yields exactly these two again.  Walking the table backwards
from the end gives the ids.

No vocabulary entry has a space mark after another character, so texts are cut
before each run of marks, and the pieces are encoded on their own; a piece is
cut again between a letter and punctuation that follows a letter in no entry.
Encodings of pieces are kept in a bounded memo, since words recur.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
MODEL = "piece_bpe_32k.model"
LETTERS = "A-Za-zÀ-ɏ"


class PieceVocabulary:
    """What a model file says: pieces, merge scores and kinds of ids."""

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(m.get_piece_size())
        self.bos, self.eos, self.unk = m.bos_id(), m.eos_id(), m.unk_id()
        special = {i for i in ids if m.is_control(i) or m.is_unknown(i)}
        self.byte_ids = {i: int(m.id_to_piece(i)[3:5], 16) for i in ids if m.is_byte(i)}
        self.byte_to_id = {b: i for i, b in self.byte_ids.items()}
        self.text_of = {i: m.id_to_piece(i) for i in ids if i not in special and i not in self.byte_ids}
        self.id_of = {p: i for i, p in self.text_of.items()}
        self.score = {p: m.get_score(i) for p, i in self.id_of.items()}
        self.size = len(ids)
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a vocabulary entry goes on after a space mark inside it; cutting texts at marks would not be exact")


class PrefixTableEncoder:
    """Exact merge-type encoding; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, model_file: str, memo_entries: int = 600_000, memo_chars: int = 40):
        self.vocab = PieceVocabulary(model_file)
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # of those cut again at punctuation
        self.memo_entries, self.memo_chars = memo_entries, memo_chars
        self.pairs: dict[tuple[int, int], bool] = {}
        self.matcher = ahocorasick.Automaton()
        for p in self.vocab.id_of:
            self.matcher.add_word(p, (len(p), self.vocab.id_of[p]))
        self.matcher.make_automaton()
        joined = [q for q in "\n.,!*%&$#|;:?" if not any(re.search(f"[{LETTERS}]{re.escape(q)}", p) for p in self.vocab.id_of)]
        self.cut = re.compile(f"(?<=[{LETTERS}])(?=[{re.escape(''.join(joined))}])") if joined else None
        size = self.vocab.size
        table = [b""] * size
        for i, p in self.vocab.text_of.items():
            table[i] = p.replace(MARK, " ").encode()
        for i, b in self.vocab.byte_ids.items():
            table[i] = bytes([b])
        if self.vocab.unk >= 0:
            table[self.vocab.unk] = " ⁇ ".encode()
        self.bytes_of = table

    def merged(self, s: str) -> list[str]:
        """Plain merging, best score first, then leftmost: used on one token or two side by side."""
        score = self.vocab.score
        at, after, before = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(at):
                both = at[i] + at[after[i]]
                if both in score:
                    heapq.heappush(heap, (-score[both], i, both))

        for i in range(len(at) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not at[i] or j >= len(at) or at[i] + at[j] != both:
                continue
            at[i], at[j] = both, ""
            after[i] = after[j]
            if after[i] < len(at):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in at if x]

    def token_text(self, code: int) -> str:
        """Codes below the vocabulary's size are ids; the others are single characters that it lacks."""
        return self.vocab.text_of[code] if code < self.vocab.size else chr(code - self.vocab.size)

    def stable(self, before: int, code: int) -> bool:
        """Does the token stay as it is beside the one before it (-1: at the start, on its own)?"""
        tokens = [self.token_text(x) for x in (before, code) if x >= 0]
        if len(self.pairs) >= 2_000_000:
            self.pairs.clear()
        ok = self.pairs[before, code] = self.merged("".join(tokens)) == tokens
        return ok

    def prefix_table(self, s: str) -> tuple[list[int], list[int]]:
        """For each prefix of s, the length and the code of its unique last token."""
        size, known, stable = self.vocab.size, self.pairs.get, self.stable
        lengths, codes = [0] * (len(s) + 1), [-1] * (len(s) + 1)
        settled = 0
        for last, (n, code) in self.matcher.iter(s):
            end = last + 1
            if lengths[end]:
                continue
            while settled < last:  # no entry ends there: a character that the vocabulary lacks
                settled += 1
                if not lengths[settled]:
                    lengths[settled], codes[settled] = 1, size + ord(s[settled - 1])
            before = codes[end - n]
            ok = known((before, code))
            if ok is None:
                ok = stable(before, code)
            if ok:
                lengths[end], codes[end] = n, code
        for k in range(settled + 1, len(s) + 1):
            if not lengths[k]:
                lengths[k], codes[k] = 1, size + ord(s[k - 1])
        return lengths, codes

    def piece_ids(self, s: str) -> bytes:
        """Ids of one piece of text whose spaces are marks already."""
        (lengths, codes), end, ids, v = self.prefix_table(s), len(s), [], self.vocab
        size = v.size
        while end:
            code = codes[end]
            if code < size:
                ids.append(code)
            elif v.byte_to_id:
                ids += [v.byte_to_id[b] for b in reversed(s[end - 1].encode())]
            else:
                ids.append(v.unk)
            end -= lengths[end]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def part_ids(self, part: str) -> bytes:
        # Cuts lie before punctuation, which words of letters and digits don't have.
        pieces = [MARK + part] if part.isalnum() or not self.cut else self.cut.split(MARK + part)
        if len(pieces) == 1:
            return self.piece_ids(pieces[0])
        ids = []
        for x in pieces:
            known = self.pieces.get(x)
            if known is None:
                known = self.piece_ids(x)
                if len(x) <= self.memo_chars:
                    self.pieces[x] = known
            ids.append(known)
        return b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without begin and end."""
        cut, pieces = [0], []
        for text in texts:
            if text:
                text = text.replace(" ", MARK)
                parts = text.split(MARK)
                if "" in parts[:-1]:
                    parts = [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + text)]
                pieces += parts
            cut.append(len(pieces))
        if len(self.memo) > self.memo_entries:
            self.memo.clear()
        if len(self.pieces) > self.memo_entries // 2:
            self.pieces.clear()
        found = list(map(self.memo.get, pieces))
        new = {x: self.part_ids(x) for x in {x for x, y in zip(pieces, found) if y is None}}
        if new:
            self.memo.update((x, y) for x, y in new.items() if len(x) <= self.memo_chars)
            found = [new[x] if y is None else y for x, y in zip(pieces, found)]
        return [b"".join(found[a:b]) for a, b in zip(cut, cut[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, one leading space goes, broken bytes become U+FFFD each."""
        ids = ids.tolist()
        held = [k for k, i in enumerate(ids) if self.bytes_of[i]]
        if not held:
            return ""
        runs, start = [], held[0]  # control ids inside part the bytes on their sides
        if held[-1] - held[0] + 1 > len(held):
            for k, after in zip(held, held[1:]):
                if after > k + 1:
                    runs.append(ids[start : k + 1])
                    start = after
        runs.append(ids[start : held[-1] + 1])
        parts = [b"".join(map(self.bytes_of.__getitem__, run)) for run in runs]
        if self.vocab.text_of.get(ids[held[0]], "").startswith(MARK):
            parts[0] = parts[0][1:]
        return "".join(map(self.text, parts))

    @staticmethod
    def text(joined: bytes) -> str:
        try:
            return joined.decode()
        except UnicodeDecodeError:
            pass
        out, k = [], 0
        while k < len(joined):
            for n in (1, 2, 3, 4):
                try:
                    out.append(joined[k : k + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out, n = [*out, "�"], 1
            k += n
        return "".join(out)


_encoders: dict[str, PrefixTableEncoder] = {}


def encoder(model: str) -> PrefixTableEncoder:
    """One encoder for each worker process; model is a name among the public tokenizers or a path."""
    if model not in _encoders:
        import public_tokenizers

        _encoders[model] = PrefixTableEncoder(model if "/" in model else public_tokenizers.path(model))
    return _encoders[model]


def encode_documents(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text_column: str = "text", bos: bool = True, eos: bool = True, keep: bool = True) -> DataFrame:
    """Encode and decode each text; one row for each row of docs, no shuffle.

    Returns id_column, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids (array<int>) and decoded.
    Null texts count as empty; other columns of docs, whatever their names, are not read.
    """
    common.short_batches(docs.sparkSession)
    head = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    more = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *more])

    def run(batches) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        start, end = (np.array([i] * on, "<u4").tobytes() for i, on in ((e.vocab.bos, bos), (e.vocab.eos, eos)))
        for batch in common.nonempty(batches):
            rows = [start + x + end for x in e.encode(common.strings(batch.column(1)))]
            ids = [np.frombuffer(x, "<u4") for x in rows]
            decoded = [e.decode(x) for x in ids]
            columns = [batch.column(0), [len(x) for x in ids], [hashlib.sha256(x).hexdigest() for x in rows], [hashlib.sha256(x.encode()).hexdigest() for x in decoded]]
            yield common.record(schema, columns + ([[x.astype("i4") for x in ids], decoded] if keep else []))

    types = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return head.mapInArrow(run, types)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"), keep=False)
