"""Byte-pair encoding by backtracking over longest matches.

The encoder never replays the merge queue. For each piece of text

1. an Aho-Corasick automaton over all token byte strings gives the longest token that starts at each byte;
2. tokens are taken greedily, longest first, while every adjacent pair is *compatible*: merging the pair's
   concatenation must give exactly this pair;
3. where a pair is incompatible the last token is shortened to its longest token prefix, or dropped when it has
   none, and the search goes on from the token before it. A bitmap of refused byte positions bounds the work.

Compatibility of two tokens is decided from the split of each token into the two parts it was merged from and
is kept in a table, so the whole search is linear in the number of bytes.
"""

from __future__ import annotations

import array
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

# The pre-tokenisation rule of the byte-level vocabularies, as published with them.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A chunk holds whole pieces: white space only stands at its start (one space) or fills it.
CHUNK_PATTERN = r" ?\S+|\s+(?!\S)|\s+"

#: Entries kept in each memo table of a worker; beyond that the table starts anew. Bounds memory, never results.
MEMO_ENTRIES = 200_000


def byte_alphabet() -> dict[str, int]:
    """Character → byte of the byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes, the split of each merged token, and the automaton over them."""

    def __init__(self, definition: bytes):
        model = json.loads(definition)["model"]
        alphabet = byte_alphabet()
        self.token_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items() if all(c in alphabet for c in s)}
        self.id_of: dict[bytes, int] = {b: i for i, b in self.token_bytes.items()}
        vocab = model["vocab"]
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.id_of_pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank_of_pair.setdefault(pair, rank)
            self.id_of_pair.setdefault(pair, whole)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, rank
        self.unreachable = self._never_made()
        self.made = {raw: token for raw, token in self.id_of.items() if token not in self.unreachable}
        self.automaton = ahocorasick.Automaton()
        for raw, token in self.made.items():
            self.automaton.add_word(raw.decode("latin-1"), (len(raw), token))
        self.automaton.make_automaton()
        self._shorter: dict[int, int | None] = {}
        self._compatible: dict[tuple[int, int], bool] = {}

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of `token`."""
        if token not in self._shorter:
            raw = self.token_bytes[token]
            self._shorter[token] = next((t for n in range(len(raw) - 1, 0, -1) if (t := self.made.get(raw[:n])) is not None), None)
        return self._shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left + right leave exactly (left, right).

        The seam between the two tokens is looked at from the last merge backwards: at each step the tokens that
        touch the seam are those present before the younger of the two was made. If they could have merged
        earlier than that, the seam would have vanished.
        """
        key = (left, right)
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= 4 * MEMO_ENTRIES:
                self._compatible.clear()
            known = self._compatible[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, a: int, b: int, until: float = float("inf")) -> bool:
        rank, parts, pair_rank = self.rank, self.parts, self.rank_of_pair
        # Of equal ranks the left occurrence is merged first, so at the seam the left part opens later when undone.
        while True:
            merge = pair_rank.get((a, b))
            if merge is not None and merge < until:
                return False
            made_a, made_b = rank.get(a, -1), rank.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until, a = made_a, parts[a][1]
            else:
                until, b = made_b + 0.5, parts[b][0]

    def encode_piece(self, raw: bytes) -> list[int]:
        """Exact ids of one pre-tokenised piece."""
        whole = self.made.get(raw)
        if whole is not None:
            return [whole]
        size = len(raw)
        longest: list[int | None] = [None] * size
        width = [0] * size
        for end, (n, token) in self.automaton.iter(raw.decode("latin-1")):
            start = end - n + 1
            if n > width[start]:
                width[start], longest[start] = n, token
        lengths, compatible, shorter = self.token_bytes, self.compatible, self.shorter
        refused = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while token is not None:
            end = at + len(lengths[token])
            if not refused[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else None
                continue
            token = shorter(token)
            if token is None:
                if not out:
                    raise ValueError("vocabulary lacks a byte")
                refused[at] = 1
                token = out.pop()
                at -= len(lengths[token])
        return out

    def _never_made(self) -> frozenset[int]:
        """Tokens that merging their own bytes never yields: a part is made too late or never, or the seam between the two
        parts has vanished by the time of the merge."""
        lost = {t for t, raw in self.token_bytes.items() if len(raw) > 1 and t not in self.parts}
        for token, (a, b) in sorted(self.parts.items(), key=lambda x: self.rank[x[0]]):
            r = self.rank[token]
            if a in lost or b in lost or max(self.rank.get(a, -1), self.rank.get(b, -1)) >= r or not self._seam_holds(a, b, r):
                lost.add(token)
        return frozenset(lost)

    def offsets(self) -> tuple[bytes, np.ndarray]:
        """All token bytes end to end and the start of each id: the decoder's table."""
        top = max(self.token_bytes) + 1
        sizes = np.array([len(self.token_bytes.get(i, b"")) for i in range(top)], dtype=np.int64)
        return b"".join(self.token_bytes.get(i, b"") for i in range(top)), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids) -> str:
        """Text of a list of ids, by two look-ups in the offset table per id; the empty list gives the empty text."""
        if not hasattr(self, "_offsets"):
            self._offsets = self.offsets()
        blob, start = self._offsets
        return b"".join(blob[start[i] : start[i + 1]] for i in ids).decode("utf-8", errors="replace")


class _Pieces(dict):
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", errors="surrogatepass")
        packed = array.array("i", self.vocabulary.encode_piece(raw)).tobytes()
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[piece] = packed
        return packed


class _Chunks(dict):
    def __init__(self, pieces: _Pieces):
        self.pieces = pieces
        self.split = regex.compile(PIECE_PATTERN).findall

    def __missing__(self, chunk: str) -> bytes:
        packed = b"".join(map(self.pieces.__getitem__, self.split(chunk)))
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed


class Encoder:
    """Whole texts to ids. Pieces and chunks seen before come from memo tables of bounded size."""

    def __init__(self, definition: bytes):
        import re

        self.vocabulary = Vocabulary(definition)
        self.pieces = _Pieces(self.vocabulary)
        self.chunks = _Chunks(self.pieces)
        self.chunk_split = re.compile(CHUNK_PATTERN).findall
        # These four count as white space for `re` but not for the published rule.
        self.odd = re.compile("[\x1c-\x1f]").search

    def packed(self, text: str | None) -> bytes:
        """Ids as native int32 bytes; empty for an empty or NULL text."""
        if not text:
            return b""
        if self.odd(text):
            return self.chunks.__missing__(text)
        return b"".join(map(self.chunks.__getitem__, self.chunk_split(text)))

    def ids(self, text: str | None) -> list[int]:
        return array.array("i", self.packed(text)).tolist()


@lru_cache(maxsize=2)
def encoder_of(definition: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(definition)
