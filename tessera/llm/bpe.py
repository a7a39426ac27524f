"""Byte-level BPE ids of whole Arrow columns.

Texts are cut into pre-tokens by character classes on the byte arrays, pre-tokens are identified
by a 64-bit hash, and only pre-tokens not met before go through the merge rules; ids of all texts
are then gathered from the table of known pre-tokens. Texts with characters outside ASCII and the
Latin letters up to U+024F go through the tokenizer itself, whole.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textbytes import SpanHasher, pieces, ragged

SPACE, BLANK, LETTER, DIGIT, OTHER = range(5)

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13]] = BLANK
_CLASS[32] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = LETTER
_CLASS[97:123] = LETTER
_CLASS[0x80:] = LETTER  # in texts of the fast path every byte above 0x7f belongs to a letter

#: Pre-tokens kept before the table of known ones is begun anew.
KNOWN = 1_000_000


class BytePairIds:
    """Ids by ``tokenizers`` from a vocabulary file; strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.quick = self._ranked(path)
        self.forget()

    def _ranked(self, path: str):
        """The same merges as ranks, for single pre-tokens, if that file lies beside the first."""
        beside = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(beside):
            return None
        import tiktoken

        with open(beside, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        vocabulary = tiktoken.Encoding("pretokens", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        return vocabulary._core_bpe.encode_single_piece

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known pre-tokens
        self.slot = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)  # by slot: where its ids begin in the pool
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, spans: list[bytes]) -> None:
        if self.quick:
            ids = [self.quick(x) for x in spans]
        else:
            ids = [x.ids for x in self.tokenizer.encode_batch([x.decode() for x in spans], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((y for x in ids for y in x), np.uint32, int(count.sum()))
        slot = np.arange(len(self.first), len(self.first) + len(ids))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, flat])
        keys, slot = np.concatenate([self.keys, hashes]), np.concatenate([self.slot, slot])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]

    def slots(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.keys) > KNOWN:
            self.forget()
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = (at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != unique) if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(unique[new], [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, unique)
        return self.slot[at][back]

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and where each row's begin; ``end_id`` is put after every row."""
        ids, counts = [], []
        for _, _, data, at in pieces(column):
            flat, count = self._piece(data, at, end_id)
            ids.append(flat)
            counts.append(count)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(count)])

    def _piece(self, data: np.ndarray, at: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        extra = 0 if end_id is None else 1
        slow = slow_rows(data, at)
        flat, row_of, begin, count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(data):
            starts, ends = pretokens(data, at)
            row_of = np.searchsorted(at, starts, side="right") - 1
            if slow.any():
                keep = ~slow[row_of]
                starts, ends, row_of = starts[keep], ends[keep], row_of[keep]
            if len(starts):
                slot = self.slots(SpanHasher(data)(starts, ends), data, starts, ends)
                begin, count = self.first[slot], self.count[slot]
                flat = self.pool[ragged(begin, count)]
        n = len(at) - 1
        per_row = np.bincount(row_of, weights=count, minlength=n).astype(np.int64) if len(row_of) else np.zeros(n, np.int64)
        others = {}
        if slow.any():
            rows = np.flatnonzero(slow)
            texts = [data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in rows]
            for r, e in zip(rows.tolist(), self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                others[r] = np.array(e.ids, np.uint32)
                per_row[r] = len(e.ids)
        total = per_row + extra
        where = np.cumsum(total) - total
        out = np.full(int(total.sum()), 0 if end_id is None else end_id, np.uint32)
        fast = np.where(slow, 0, per_row)
        out[ragged(where, fast)] = flat
        for r, x in others.items():
            out[where[r] : where[r] + len(x)] = x
        return out, total


def slow_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with bytes that the class table can't place: all but ASCII and letters U+00C0 to U+024F."""
    n = len(at) - 1
    high = data >= 0x80
    odd = high & ((data < 0x80) | (data > 0xC9))
    lead = np.flatnonzero(high & (data >= 0xC0))
    b, nxt = data[lead], data[np.minimum(lead + 1, len(data) - 1)] if len(data) else data[:0]
    bad = (b < 0xC3) | (b > 0xC9) | ((b == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))) | ((b == 0xC9) & (nxt > 0x8F))
    odd[lead[bad]] = True
    odd |= (data >= 28) & (data <= 31)  # whether these are white space differs between libraries
    slow = np.zeros(n, bool)
    where = np.flatnonzero(odd)
    slow[np.searchsorted(at, where, side="right") - 1] = True
    return slow


def pretokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of contractions, runs of letters, digits or other signs with one space before, and white space."""
    kind = _CLASS[data]
    run = np.where(kind == BLANK, SPACE, kind)
    start = np.ones(len(data), bool)
    start[1:] = run[1:] != run[:-1]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[at] = True
    start |= row_start[:-1]
    last = np.zeros(len(data), bool)  # last byte of its row
    last[:-1] = row_start[1:-1]
    last[-1] = True
    white = run == SPACE
    # the last sign of a white run before something else begins a token; if a space, it takes the rest with it
    before = np.zeros(len(data), bool)
    before[:-1] = white[:-1] & ~white[1:]
    before &= ~last
    start |= before
    glued = np.flatnonzero(before & (kind == SPACE)) + 1
    start[glued] = False
    # contractions: an apostrophe that begins a token, with its letters
    quote = np.flatnonzero(start & (data == 39))
    if len(quote):
        room = at[np.searchsorted(at, quote, side="right")] - quote
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = (room >= 2) & np.isin(a, np.frombuffer(b"sdmt", np.uint8))
        two = (room >= 3) & (((a == 108) & (b == 108)) | ((a == 118) & (b == 101)) | ((a == 114) & (b == 101)))
        for hit, k in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            start[q + 1] = False
            inside = q + k
            inside = inside[inside < len(data)]
            start[inside] |= ~row_start[inside] & (run[inside] != SPACE) | start[inside]
            if k == 3:
                start[q + 2] = False
    s = np.flatnonzero(start)
    return s, np.append(s[1:], len(data))


@lru_cache(maxsize=2)
def ids_of(path: str) -> BytePairIds:
    """One per Python worker and vocabulary."""
    return BytePairIds(path)
