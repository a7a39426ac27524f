"""Token counts by a linear longest-match automaton.

A word is cut greedily: the longest vocabulary entry that begins it, then the longest continuation
entry, and so on; a word that can't be cut is one unknown token. The automaton is a trie of both
kinds of entries. Each node has a failure link, to the node that stands for what is left after the
tokens that are certain by then are popped, and how many those are; so a word's count is a sum over
its bytes and no piece is ever built.

Words are what white space parts. Counts of words met before are looked up by hash.

Edge cases: null, empty and blank texts have no words and no tokens; very long words take time in
proportion to their length; null ids are given back as null; rows with the same id, repeated or not, are
counted each; an empty table gives an empty result; other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbytes import SpanHasher, pieces, slices, word_spans

START, CONTINUE, NONE = 0, 1, -1


class Automaton:
    """Transitions by node and byte; ``fail`` and ``popped`` by node."""

    def __init__(self, starting: set[bytes], continuing: set[bytes]) -> None:
        self.step: dict[int, int] = {}
        self.fail, self.popped = [NONE, NONE], [0, 0]
        token = [False, False]
        level = []  # nodes in order of depth: (depth, parent, byte, node)
        for root, entries in ((START, starting), (CONTINUE, continuing)):
            for entry in entries:
                at = root
                for depth, byte in enumerate(entry):
                    key = at << 8 | byte
                    if key not in self.step:
                        self.step[key] = len(self.fail)
                        level.append((depth, at, byte, len(self.fail)))
                        self.fail.append(NONE)
                        self.popped.append(0)
                        token.append(False)
                    at = self.step[key]
                if at != root:
                    token[at] = True
        level.sort(key=lambda x: x[0])
        for _, parent, byte, node in level:
            if token[node]:
                self.fail[node], self.popped[node] = CONTINUE, 1
                continue
            at, count = self.fail[parent], self.popped[parent]
            while at != NONE and at << 8 | byte not in self.step:
                count += self.popped[at]
                at = self.fail[at]
            if at != NONE:
                self.fail[node], self.popped[node] = self.step[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Tokens of a word, 0 if it can't be cut."""
        step, fail, popped = self.step, self.fail, self.popped
        at, n = START, 0
        for byte in word:
            while (after := step.get(at << 8 | byte, NONE)) == NONE:
                n += popped[at]
                at = fail[at]
                if at == NONE:
                    return 0
            at = after
        while at != CONTINUE:
            n += popped[at]
            at = fail[at]
            if at == NONE:
                return 0
        return n


def byte_level(path: str) -> tuple[set[bytes], set[bytes]]:
    """Entries of a byte-level vocabulary file: with a space before them (starting) and without (continuing)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    starting, continuing = set(), set()
    for entry in vocabulary:
        if all(c in byte_of for c in entry):
            raw = bytes(byte_of[c] for c in entry)
            if raw[:1] == b" ":
                starting.add(raw[1:])
            else:
                continuing.add(raw)
    return {x for x in starting if x and not set(x) & set(b" \t\n\v\f\r")}, {x for x in continuing if x and not set(x) & set(b" \t\n\v\f\r")}


@lru_cache(maxsize=2)
def automaton_of(path: str) -> Automaton:
    return Automaton(*byte_level(path))


class Counter:
    """Counts of words by hash; a table of bounded size that is begun anew when full."""

    def __init__(self, automaton: Automaton, most: int = 1_000_000) -> None:
        self.automaton, self.most = automaton, most
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __call__(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if len(self.keys) > self.most:
            self.keys, self.counts = self.keys[:0], self.counts[:0]
        unique, first, back = np.unique(SpanHasher(data)(s, e), return_index=True, return_inverse=True)
        known = np.isin(unique, self.keys, assume_unique=True)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            count = self.automaton.count
            fresh = np.fromiter((count(raw[a:b]) for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)), np.int32, len(new))
            keys, counts = np.concatenate([self.keys, unique[new]]), np.concatenate([self.counts, fresh])
            order = np.argsort(keys, kind="stable")
            self.keys, self.counts = keys[order], counts[order]
        return self.counts[np.searchsorted(self.keys, unique)][back]


COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_tokens (unknown words count one each), n_unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(automaton_of(vocabulary))
        for whole in batches:
            for batch in slices(whole, 1):
                words, tokens, unknown = [], [], []
                for _, _, data, at in pieces(batch.column(1)):
                    s, e, before = word_spans(data, at)
                    n = counter(data, s, e) if len(s) else np.zeros(0, np.int32)
                    sums = np.concatenate([[0], np.cumsum(np.maximum(n, 1))])
                    zero = np.concatenate([[0], np.cumsum(n == 0)])
                    words.append(np.diff(before))
                    tokens.append(sums[before[1:]] - sums[before[:-1]])
                    unknown.append(zero[before[1:]] - zero[before[:-1]])
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (words, tokens, unknown)]], names=[x.split()[0] for x in COUNTS.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, COUNTS)
