"""Byte-level BPE by backtracking from longest matches.

The vocabulary's byte strings, mapped to Latin-1, form an Aho-Corasick automaton.  A pass over
a piece gives the longest token that starts at each byte.  The encoder walks forward with the
longest token that is compatible with the one before; where none is, it takes the next shorter
token (by the table of longest proper prefixes) or steps back, and never tries a position
again that led nowhere.  Two adjacent tokens are compatible if merging their joined bytes by
rank gives the same two tokens; that is memoised.  A sequence in which all adjacent tokens are
compatible is the one that the merges produce, so the result is exact, in linear time.

A piece that is itself a token is that token.  Special tokens are not recognised: their text is
ordinary text.

Defined results: null is an empty text, which has no ids; of merges with equal rank the left one
comes first; repeated rows are encoded alike; a text of any length is encoded whole; an empty
table gives an empty result; columns other than the text and those kept are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from ._common import Generations, map_rows

#: Entries in a generation of a worker's memo of pieces; that of pairs has as many.
MEMO = 200_000
#: Above any rank, to make one number of two.
SHIFT = 1 << 32
#: Longer pieces are not memoised.
MEMO_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines with a Base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges by definition: join the adjacent parts of least rank until none has one.  Quadratic."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        least, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if least == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Codec:
    """Encoder and decoder for one vocabulary and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter = _Shorter(ranks)
        self.pairs = _Pairs(ranks, self.tokens, memo)
        self.memo = _Memo(self.encode_piece, memo)

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        n = len(piece)
        longest = [0] * n
        token_at = [0] * n
        for end, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > longest[start]:
                longest[start], token_at[start] = size, rank
        out: list[int] = []
        dead: set[int] = set()  # positions from which no compatible sequence follows
        at, token = 0, token_at[0]
        tokens, pairs, shorter = self.tokens, self.pairs, self.shorter
        while True:
            end = at + len(tokens[token])
            if end not in dead and (pairs[out[-1] * SHIFT + token] if out else pairs.made(token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = token_at[at]
                continue
            token = shorter[token]
            while token is None:  # no token fits here: step back and take a shorter one there
                dead.add(at)
                last = out.pop()
                at -= len(tokens[last])
                token = shorter[last]

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def encode(self, text: str | None) -> list[int]:
        data = self.encode_bytes(text or "")
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Shorter(dict):
    """Token to the longest token that is a proper prefix of it, or None."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.tokens = {r: t for t, r in ranks.items()}
        self.ranks = ranks

    def __missing__(self, token: int) -> int | None:
        t = self.tokens[token]
        out = self[token] = next((r for n in range(len(t) - 1, 0, -1) if (r := self.ranks.get(t[:n])) is not None), None)
        return out


class _Pairs(Generations):
    """Whether two tokens stay as they are side by side; the key is the first's rank * SHIFT + the second's.

    The merges that made the two are undone from the latest.  Before a merge of rank ``limit``
    could use up one of the parts at the border, no join over the border may have come first; of
    equal ranks the left one comes first.
    """

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes], bound: int):
        super().__init__(bound)
        self.ranks, self.tokens = ranks, tokens
        self.parts: dict[int, tuple[int, ...]] = {}

    def make(self, pair: int) -> bool:
        return self._stay(*divmod(pair, SHIFT))

    def _split(self, token: int) -> tuple[int, ...]:
        """The two tokens of a token's last merge, none of a single byte's; itself alone if no merges make it."""
        if token not in self.parts:
            t = self.tokens[token]
            if len(t) == 1:
                self.parts[token] = ()
            else:
                rest = {k: v for n in range(1, len(t)) for i in range(len(t) - n + 1) if (v := self.ranks.get(k := t[i : i + n])) is not None}
                found = merge_by_rank(t, rest)
                self.parts[token] = tuple(found) if len(found) == 2 and merge_by_rank(t, self.ranks) == [token] else (token,)
        return self.parts[token]

    def made(self, token: int) -> bool:
        """Whether merges make this token at all."""
        return self._split(token) != (token,)

    def _stay(self, a: int, b: int) -> bool:
        tokens, join = self.tokens, self.ranks.get
        if not self.made(a) or not self.made(b):
            return False
        limit = 1 << 60
        while True:
            joined = join(tokens[a] + tokens[b])
            if joined is not None and joined < limit:
                return False
            left, right = self._split(a), self._split(b)
            if not left and not right:
                return True
            if left and (a > b or not right):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]


class _Memo(Generations):
    """Piece to the bytes of its ids."""

    def __init__(self, encode: Callable[[bytes], list[int]], bound: int):
        super().__init__(bound)
        self.encode = encode

    def make(self, piece: str) -> bytes:
        ids = self.encode(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) <= MEMO_CHARS else self.make(piece)


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, memo: int = MEMO) -> Codec:
    """The codec of a vocabulary file, made once per process."""
    if (path, pattern, memo) not in _codecs:
        _codecs[path, pattern, memo] = Codec(read_ranks(path), pattern, memo)
    return _codecs[path, pattern, memo]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: str = "doc_id long", with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """Encode every whole text and decode it again.

    Columns: those of ``keep``, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers), decoded_sha256 (of the decoded bytes) and, ``with_ids``, the ids themselves.
    The vocabulary is read from ``path`` on each executor: a file that is installed there.
    ``memo`` bounds the entries that a worker remembers.
    """
    columns = [c.split()[0] for c in keep.split(",")]

    def make():
        coder = codec(path, pattern, memo)

        def rows(batch: dict[str, list]) -> Iterator[tuple]:
            for i, text in enumerate(batch["text"]):
                data = coder.encode_bytes(text or "")
                ids = struct.unpack(f"<{len(data) // 4}I", data)
                decoded = coder.decode(ids)
                out = *(batch[c][i] for c in columns), len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded).hexdigest()
                yield (*out, np.frombuffer(data, "<i4")) if with_ids else out

        return rows

    schema = f"{keep}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs.select(*dict.fromkeys([*columns, "text"])), make, schema, by_batch=with_ids)
