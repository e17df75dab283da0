"""Byte-level BPE by dynamic programming over prefixes.

The encoding of every prefix of a byte string ends in exactly one token, and the
encoding of the prefix before that token is the rest of the encoding. So one
token for each prefix holds all encodings. It is found among the tokens that are
suffixes of the prefix: the one that may follow the last token of what is left.
Two tokens may follow one another if undoing their merges from the latest to the
earliest never meets a merge across the seam that would have come first.

Appending goes on from the last prefix; an edit re-encodes from the piece before
it until pieces fall in step again. Text is first split into pieces by the
pattern that the vocabulary was made with.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, CHUNK_BYTES, drop_clashes, mix, named, prefix_hash, range_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 1_000_000
CACHED_BYTES = 64
NO_LIMIT = 1 << 62


class Vocabulary:
    """Tokens with ranks (also their ids), as in a file of lines ``base64 rank``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {r: b for b, r in ranks.items()}
        self.reach: dict[bytes, int] = {}  # the longest token that ends with these two bytes
        for token in ranks:
            if len(token) > 1:
                self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 1))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.bytes: tuple[np.ndarray, np.ndarray] | None = None
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            pair = self._merge(token, rank)
            if pair:
                self.parts[rank] = pair
                self.merged[pair] = rank

    def _merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``."""
        parts = [token[i: i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at, least = -1, rank
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], NO_LIMIT)
                if r < least:
                    at, least = i, r
            if at < 0:
                return None
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 and all(p in self.ranks for p in parts) else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        pair = (left, right)
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) > 2 * CACHED:
                self.follows.clear()
            known = self.follows[pair] = self._seam(left, right)
        return known

    def _seam(self, left: int, right: int) -> bool:
        bound = NO_LIMIT
        while True:
            if self.merged.get((left, right), NO_LIMIT) < bound:
                return False
            inner_left, inner_right = self.parts.get(left), self.parts.get(right)
            if inner_left is None and inner_right is None:
                return True
            if inner_right is None or inner_left is not None and left > right:
                bound, left = left, inner_left[1]
            else:
                bound, right = right + 1, inner_right[0]

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """``last`` (the last token of each prefix of ``raw`` that is known) completed to all prefixes, in place."""
        get, follows, reach = self.ranks.get, self.follows.get, self.reach.get
        for end in range(len(last) + 1, len(raw) + 1):
            for start in range(max(0, end - reach(raw[max(0, end - 2): end], 1)), end):
                t = get(raw[start:end])
                if t is None:
                    continue
                if start:
                    fits = follows((last[start - 1], t))
                    if fits is None:
                        fits = self.may_follow(last[start - 1], t)
                else:
                    fits = self.plain(t)
                if fits:
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token for byte {raw[end - 1]}")
        return last

    def plain(self, token: int) -> bool:
        return token in self.parts or len(self.token[token]) == 1

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes hold."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[out[-1]])
        return out[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.known.get(text)
        if got is None:
            raw = text.encode()
            whole = self.ranks.get(raw)
            got = (whole,) if whole is not None and self.plain(whole) else tuple(self.walk(self.extend(raw, [])))
            if len(raw) <= CACHED_BYTES:
                if len(self.known) > CACHED:
                    self.known.clear()
                self.known[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        known, piece = self.known, self.piece
        return list(chain.from_iterable([known.get(p) or piece(p) for p in self.pattern.findall(text)]))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens end to end by id, and where each begins."""
        if self.bytes is None:
            parts = [self.token.get(i, b"") for i in range(max(self.token, default=-1) + 1)]
            self.bytes = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return self.bytes

    def decode_bytes(self, tokens) -> bytes:
        token = self.token
        return b"".join([token[t] for t in tokens])


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class Encoded:
    """A text with the last tokens of all prefixes of its pieces; grows and changes without being encoded anew."""

    def __init__(self, text: str = "", vocabulary: Vocabulary | None = None):
        self.v = vocabulary or globals()["vocabulary"]()
        self.text, self.pieces = "", []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of characters [start, end). Returns the number of pieces that were split anew.

        A piece depends on nothing before its start and on one character beyond
        its end, so all but one piece before the edit stand, and so do all
        from the first old boundary after it that the new pieces meet.
        """
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("no such range")
        text = self.text[:start] + new + self.text[end:]
        starts, at = [], 0
        for p, _ in self.pieces:
            starts.append(at)
            at += len(p)
        first = max(0, sum(1 for s in starts if s < start) - 2) if starts else 0
        shift = len(new) - (end - start)
        later = {s + shift: i for i, s in enumerate(starts) if s > end}
        pos, made, rest = starts[first] if starts else 0, [], len(self.pieces)
        while pos < len(text):
            if pos in later:
                rest = later[pos]
                break
            p = self.v.pattern.match(text, pos).group()
            made.append(p)
            pos += len(p)
        old = self.pieces[first:rest]
        entries = []
        for i, p in enumerate(made):
            raw, last = p.encode(), []
            if i < len(old):
                was = old[i][0].encode()
                same = next((k for k, (x, y) in enumerate(zip(raw, was, strict=False)) if x != y), min(len(raw), len(was)))
                last = old[i][1][:same]
            entries.append((p, self.v.extend(raw, last)))
        self.pieces[first:rest] = entries
        self.text = text
        return len(made)

    @property
    def tokens(self) -> list[int]:
        return [t for _, last in self.pieces for t in self.v.walk(last)]


# ---- pieces of whole batches
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = True
_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 others
_KIND[_LETTER] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\xff]*")
_SUFFIX = re.compile(b"'(?:s|t|re|ve|m|ll|d)")


def split_plain(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pieces of ``PATTERN`` in Latin-1 texts that lie end to end between ``bounds``.

    For texts of the characters in ``_PLAIN``, of which it is certain how the
    pattern takes them.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[codes]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last character of white space before anything else of the same text stands alone, or goes with it if it is a space
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == 0) & (kind[1:] != 0) & ~edge[1:-1]
    start |= last
    joined = np.flatnonzero(last & (codes == 32)) + 1
    start[joined] = False
    # an apostrophe that begins a piece takes a suffix with it
    marks = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kind[1:] == 1) & ~edge[1:-1])
    if len(marks):
        raw = codes.tobytes()
        ends = bounds[np.searchsorted(bounds, marks, "right")]
        for at, end in zip(marks.tolist(), ends.tolist(), strict=True):
            m = _SUFFIX.match(raw, at, end)
            if m:
                start[at + 1] = False
                if m.end() < end and kind[m.end()] == 1:
                    start[m.end()] = True
    return np.flatnonzero(start)


def encode_batch(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts end to end, offsets). Each different piece of the batch is encoded once."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
    plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)] if v.pattern.pattern == PATTERN else []
    at = 0
    while at < len(plain):
        size, to = 0, at
        while to < len(plain) and (to == at or size + len(texts[plain[to]]) <= CHUNK_BYTES):
            size, to = size + len(texts[plain[to]]), to + 1
        part = [texts[i].encode("latin-1") for i in plain[at:to]]
        raw = b"".join(part)
        codes = np.frombuffer(raw, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64)
        start = split_plain(codes, bounds)
        end = np.append(start[1:], len(codes)) if len(start) else start
        prefix = prefix_hash(BYTE_CODES[codes])
        h = mix(range_hash(prefix, start, end) + (end - start).astype(np.uint64))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        pieces = [v.piece(raw[a:b].decode("latin-1")) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        many = np.array([len(p) for p in pieces], np.int64)
        flat = np.fromiter(chain.from_iterable(pieces), np.int32, int(many.sum()))
        begin = np.concatenate([[0], np.cumsum(many)])[:-1]
        count = many[which] if len(which) else many
        total = np.concatenate([[0], np.cumsum(count)])
        tokens = flat[np.repeat(begin[which] - total[:-1], count) + np.arange(total[-1])] if len(which) else flat
        cut = total[np.searchsorted(start, bounds)]
        for k, i in enumerate(plain[at:to]):
            out[i] = tokens[cut[k]: cut[k + 1]]
        at = to
    for i in sorted(set(range(len(texts))) - set(plain)):
        out[i] = np.array(v.encode(texts[i]), np.int32)
    return np.concatenate([*out, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def encode(docs: DataFrame, text: str = "text", to: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with a column of token ids; the file at ``path`` is read on every executor.

    A null text gives null, an empty one an empty list. Texts of any length are
    encoded whole. Special tokens are ordinary text. An input column named
    ``to`` is replaced, other columns are kept whatever their names. Repeated
    rows get equal tokens; an empty table gives an empty table.
    """
    docs = docs if to.lower() == text.lower() else drop_clashes(docs, to)

    @F.arrow_udf("array<int>")
    def tokens(texts: pa.Array) -> pa.Array:
        flat, offsets = encode_batch(vocabulary(path), [t or "" for t in texts.to_pylist()])
        return _lists(offsets, pa.array(flat, pa.int32()), texts)

    return docs.withColumn(to, tokens(named(text)))


def _lists(offsets: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    """A list column that is null where ``like`` is."""
    at = pa.array(offsets[:-1].tolist() + [int(offsets[-1])], pa.int32(), mask=np.append(like.is_null().to_numpy(zero_copy_only=False), False)) if like.null_count else pa.array(offsets, pa.int32())
    return pa.ListArray.from_arrays(at, values)


def decode(table: DataFrame, tokens: str = "tokens", to: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``table`` with the text of a column of token ids; bytes that are no UTF-8 become U+FFFD. Null gives null.

    A token that the vocabulary doesn't have, or a null one, is an error.
    """
    table = table if to.lower() == tokens.lower() else drop_clashes(table, to)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        raw, size = vocabulary(path).table()
        out = []
        for lo in range(0, len(column), 256):
            part = column.slice(lo, 256)
            ids = part.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.dtype.kind == "f" or ids.min() < 0 or ids.max() >= len(size) - 1 or (np.diff(size)[ids] == 0).any()):
                raise ValueError("a token that the vocabulary doesn't have")
            many = size[ids + 1] - size[ids]
            total = np.concatenate([[0], np.cumsum(many)])
            text = raw[np.repeat(size[ids] - total[:-1], many) + np.arange(total[-1])].tobytes()
            cut = total[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))])].tolist()
            out += [text[a:b].decode("utf-8", "replace") if known else None for a, b, known in zip(cut[:-1], cut[1:], part.is_valid().to_pylist(), strict=True)]
        return pa.array(out, pa.string())

    return table.withColumn(to, texts(named(tokens)))
