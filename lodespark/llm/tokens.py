"""Exact tokenisation with the tokenizers library, remembering the ids of pieces already seen.

A byte-level BPE works on each piece of the pre-tokenizer by itself. A text of common characters is cut by the
pre-tokenizer's pattern; pieces are looked up, and a new piece goes to the library's BPE model itself. Other texts, whose
characters another Unicode version might class otherwise, are cut only at single spaces between two non-space
characters, which no piece crosses, and each new segment goes through the library's whole encode; so does every text that holds one of
the tokenizer's added tokens, which the library cuts out first, and every text for a tokenizer of another build.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

# Fixed values of byte-level BPE: the pre-tokenizer's pattern over common characters (letters and numbers of Latin
# scripts spelt out), and the character each byte is written as.
PATTERN = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
BYTES = {b: b for b in _SHOWN} | {b: 256 + n for n, b in enumerate(_HIDDEN)}

#: A space with no kind of white space on either side (a superset of what any pre-tokenizer takes for white space).
_EDGE = re.compile("(?<=[^\\s\x1c-\x1f\x85\u200b\ufeff]) (?=[^\\s\x1c-\x1f\x85\u200b\ufeff])")
#: Characters whose classes no Unicode version disputes.
_COMMON = re.compile("[\t\n\r -~\xa1-\u024f]*")
#: Entries of a generation; the one before it is kept too, so what is frequent stays known.
REMEMBERED = 100_000


class Memo(dict):
    """Packed ids by piece or segment; what is new is encoded by `encode`."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.encode(key)
        self[key] = found
        return found

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """encode(texts) gives one unsigned array of ids for each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        built = json.loads(self.tok.to_str())
        before = built.get("pre_tokenizer") or {}
        self.splits = built.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and built["model"]["type"] == "BPE" and not built["model"].get("dropout")
        added = sorted((t["content"] for t in built.get("added_tokens") or []), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.model = self.tok.model
        self.pieces, self.segments = Memo(self._piece), Memo(self.plain)

    def plain(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin1").translate(BYTES))]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.splits:
            return [np.frombuffer(self.plain(t), self.dtype) for t in texts]
        self.pieces.age()
        self.segments.age()
        out = []
        for t in texts:
            if self.added.search(t):
                raw = self.plain(t)
            elif _COMMON.fullmatch(t):
                raw = b"".join(map(self.pieces.__getitem__, PATTERN.findall(t)))
            else:
                first, *rest = _EDGE.split(t)
                raw = b"".join([self.plain(first) if first else b"", *(self.segments[" " + s] for s in rest)])
            out.append(np.frombuffer(raw, self.dtype))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that what one task has seen serves the next."""
    return Encoder(path)


def groups(texts, most: int = 1 << 20):
    """Runs of texts (nulls as empty) of about `most` characters, with the index of the first."""
    own, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if own and size + len(t) > most:
            yield first, own
            own, size, first = [], 0, i
        own.append(t)
        size += len(t)
    if own:
        yield first, own
