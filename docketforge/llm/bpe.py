"""Byte-level BPE by a trie of distinct words: the state of a prefix is its last token.

The encoding of a prefix is the encoding of a shorter prefix followed by one token, and that
token is the only one that ends the prefix and may stand next to the token before it (two
tokens may stand side by side when merging their bytes gives just these two again). So a
depth-first walk over a trie of words needs one number for each node, and words that share
a prefix share its encoding.
"""

from __future__ import annotations

import base64
import re
from array import array

import regex

#: How the public tokenizer divides text into words.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII text, where the standard library's matcher is faster.
SPLIT_ASCII = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"


#: Pairs of tokens whose neighbourhood is remembered.
MAX_PAIRS = 2_000_000


class Vocabulary:
    """Ranks of a byte-level BPE file and which tokens may be neighbours."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.longest = max(map(len, self.ids))
        self.halves: dict[int, tuple[bytes, bytes] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """Plain BPE over given parts: the lowest ranked neighbours merge first."""
        ids = self.ids
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ids.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: bytes, after: bytes) -> bool:
        """Whether plain BPE of before + after gives back exactly these two tokens."""
        key = (self.ids[before], self.ids[after])
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > MAX_PAIRS:
                self.beside.clear()
            both = before + after
            known = self.merged([both[i : i + 1] for i in range(len(both))]) == [before, after]
            self.beside[key] = known
        return known

    def whole(self, token: bytes) -> bool:
        """Whether plain BPE of a token's bytes gives the token itself."""
        return self.merged([token[i : i + 1] for i in range(len(token))]) == [token]


class TrieEncoder:
    """Encodes batches of words. Memory is bounded: past max_words kept words the next batch starts afresh."""

    def __init__(self, vocabulary: Vocabulary, max_words: int = 400_000):
        self.v = vocabulary
        self.max_words = max_words
        self.known: dict[str, bytes] = {}

    def learn(self, words) -> None:
        """Add distinct words: in sorted order a walk over them is the depth-first walk of their trie."""
        v, ids, longest = self.v, self.v.ids, self.v.longest
        path: bytes = b""
        last: list[bytes] = [b""]  # last[n]: the last token of the first n bytes on the way down
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            # go up to the node where this word leaves the way of the word before
            n, most = 0, min(len(path), len(raw))
            while n < most and path[n] == raw[n]:
                n += 1
            del last[n + 1 :]
            for end in range(n + 1, len(raw) + 1):
                found = None
                for start in range(max(0, end - longest), end):
                    token = raw[start:end]
                    if token in ids and (v.fits(last[start], token) if start else v.whole(token)):
                        found = token
                        break
                last.append(found)
            path = raw
            out, end = [], len(raw)
            while end:
                token = last[end]
                out.append(ids[token])
                end -= len(token)
            out.reverse()
            self.known[word] = array("i", out).tobytes()

    def split(self, text: str) -> list[str]:
        return _ascii(text) if text.isascii() else _any(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native 32-bit integers."""
        parts = [self.split(t) for t in texts]
        if len(self.known) > self.max_words:
            self.known.clear()
        self.learn(set().union(*parts) - self.known.keys())
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def count(self, texts: list[str]) -> list[int]:
        return [len(b) // 4 for b in self.encode(texts)]


_ascii = re.compile(SPLIT_ASCII).findall
_any = regex.compile(SPLIT).findall

_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(Vocabulary(path))
    return _encoders[path]
