"""Whole texts to ids with the tokenizers library, fast where words recur.

A text is cut at spaces where the tokenizer would cut it anyway; each distinct
piece is encoded by the library once and kept in a bounded memo.  The result is
what the library gives for the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Characters that no tokenizer takes for white space or joins with a space before them.
PLAIN = "!-~¡-¬®-ʯ"
#: Letters that stay one letter in lower case.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"


class ChunkTokens:
    """ids(texts) gives for each text its ids, as `dtype`."""

    def __init__(self, tokenizer_file: str, memo_entries: int = 600_000, memo_chars: int = 40, group: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # A byte-level tokenizer keeps white space in its tokens: a piece goes with the space before it.
        self.keeps_space = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.memo_entries, self.memo_chars, self.group = memo_entries, memo_chars, group
        if self.keeps_space:
            # A space before a plain character starts a piece; other spaces may belong to a longer run.
            self.cut, self.plain = re.compile(f" (?=[{PLAIN}])"), re.compile(f"[{PLAIN}]+\\Z").match
            self.doubtful = re.compile(f" (?:[^{PLAIN}]|\\Z)").search
            back = {c: b for b, c in _byte_characters().items()}
            added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            self.bytes_of = np.zeros(size, "i8")
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.bytes_of[i] = added[i] if i in added else sum(c in back for c in token)
        else:
            # White space vanishes. str.split() also splits at characters that are none for the tokenizer.
            self.cut, self.doubtful = re.compile("[ \\n]+"), re.compile("[\x1c-\x1f]").search
            # A word, and one run of signs after it: as many word ends as the tokenizer makes of them.
            self.plain = re.compile(f"[{LETTERS}]+[.,;:!?*%&$#|]*\\Z").match
            suffix = self.tokenizer.model.end_of_word_suffix
            self.ends_word = np.zeros(size, bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.ends_word[i] = bool(suffix) and token.endswith(suffix)

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _fill(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces; many plain ones are encoded in one text, and cut apart again."""
        simple = [x for x in missing if len(x) <= self.memo_chars and self.plain(x)]
        lead = " " if self.keeps_space else ""
        found = {x: self._alone(lead + x) for x in set(missing).difference(simple)}
        groups = [simple[k : k + self.group] for k in range(0, len(simple), self.group)]
        encoded = self.tokenizer.encode_batch_fast([lead + " ".join(g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, self.dtype)
            if self.keeps_space:
                at = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(x.encode()) + 1 for x in g])) + 1
            else:
                ends, count = np.flatnonzero(self.ends_word[ids]), np.cumsum([1 + (not x[-1].isalpha()) for x in g])
                if len(ends) != count[-1]:
                    found.update((x, self._alone(x)) for x in g)
                    continue
                at = ends[count - 1] + 1
            raw, n, start = ids.tobytes(), self.dtype.itemsize, 0
            for x, end in zip(g, (at * n).tolist()):
                found[x] = raw[start:end]
                start = end
        return found

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cut, heads, pieces = [0], [], []
        for text in texts:
            if self.keeps_space:
                parts = self.cut.split(text) if self.doubtful(text) else text.split(" ")
                heads.append(parts[0])
                del parts[0]
            else:
                parts = self.cut.split(text) if self.doubtful(text) else text.split()
            pieces += parts
            cut.append(len(pieces))
        if len(self.memo) > self.memo_entries:
            self.memo.clear()
        found = list(map(self.memo.get, pieces))
        missing = {x for x, y in zip(pieces, found) if y is None}
        if missing:
            new = self._fill(list(missing))
            self.memo.update((x, y) for x, y in new.items() if len(x) <= self.memo_chars)
            found = [new[x] if y is None else y for x, y in zip(pieces, found)]
        rows = [b"".join(found[a:b]) for a, b in zip(cut, cut[1:])]
        if self.keeps_space:
            rows = [self._alone(head) + row for head, row in zip(heads, rows)]
        return [np.frombuffer(x, self.dtype) for x in rows]


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_loaded: dict[str, ChunkTokens] = {}


def chunk_tokens(name: str) -> ChunkTokens:
    """One for each worker process; name is one of the public tokenizers or a path."""
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = ChunkTokens(name if "/" in name else public_tokenizers.path(name))
    return _loaded[name]
