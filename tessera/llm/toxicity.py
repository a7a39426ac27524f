"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and full-width forms
to Latin ones, and undoes digit and sign substitutions (``l0ser``, ``tr@sh``); ``l`` and ``i`` fold
together because ``1`` stands for both. All else but letters becomes a space, so entries are matched
with their word borders: ``" word "`` is a whole word, ``" stem"`` the beginning of one.

Entries and weights are log-odds learned from labelled documents; a word seldom met is kept only if
its association is beyond what so many candidates show by chance. Two-word phrases that clear
documents use with an entry become exceptions: a match inside one doesn't count. The score is a
logistic function of the matched weight and of that weight per word.

Edge cases: null or empty text matches nothing and gets the base score; without labelled rows of
both classes the lexicon is empty and every score is the share of label 1 (0 without labels); a null
id is given back as null and never learned from; rows with the same id, repeated or not, are scored each;
of entries that begin at one place the longest counts; very long texts are matched whole; an empty table
gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out
from .textbytes import slices

# fixed values: letters of other scripts that look like Latin ones, and signs that stand for letters
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "i", "ⅰ": "i", "ß": "s", "ø": "o", "đ": "d", "ł": "i", "æ": "a",
}
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = re.compile(r"[@$](?=\w)(?<![@$].)")
SIGN_LETTERS = {"@": "a", "$": "s"}
#: Signs that readers don't see, dropped within words.
INVISIBLE = {0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}


class _Fold(dict):
    def __missing__(self, code: int):
        """All letters a character stands for: its marks go, ligatures come apart, syllables stay whole."""
        own = unicodedata.normalize("NFKD", chr(code))
        if code in INVISIBLE or all(unicodedata.combining(c) for c in own):
            self[code] = None
            return None
        plain = unicodedata.normalize("NFC", "".join(c for c in own if not unicodedata.combining(c))).lower()
        known = LOOK_ALIKES.get(chr(code).lower())
        self[code] = _letters(plain) if known is None else known
        return self[code]


def _letters(plain: str) -> str:
    alike = (LOOK_ALIKES.get(c, SUBSTITUTES.get(c, c)) for c in plain)
    return "".join("i" if c == "l" else c if c.isalpha() else " " for c in alike)


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text between spaces; however a character is composed, it folds alike."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "$" in text or "@" in text:
        text = SIGNS.sub(lambda m: SIGN_LETTERS[m[0]], text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    """entries: pattern (with its word borders) to weight; exceptions: phrases that clear what they hold."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -20.0
    by_weight: float = 0.0
    by_density: float = 0.0

    def automaton(self):
        import ahocorasick

        if not self.entries:
            return None
        out = ahocorasick.Automaton()
        for p in self.exceptions:
            out.add_word(p, (len(p), None))
        for p, w in self.entries.items():
            out.add_word(p, (len(p), w))
        out.make_automaton()
        return out

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = self.bias + self.by_weight * np.log1p(weight) + self.by_density * np.log1p(100 * weight / np.maximum(words, 1))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def matched(automaton, folded: str) -> tuple[float, int]:
    """Summed weight and number of matches: the longest entry at each place, none inside an exception."""
    if automaton is None:
        return 0.0, 0
    best: dict[int, tuple[int, float]] = {}
    clear: list[tuple[int, int]] = []
    for last, (n, w) in automaton.iter(folded):
        at = last - n + 1
        if w is None:
            clear.append((at, last))
        elif n > best.get(at, (0, 0.0))[0]:
            best[at] = (n, w)
    if clear:
        best = {a: x for a, x in best.items() if not any(s <= a and a + x[0] - 1 <= e for s, e in clear)}
    return sum(w for _, w in best.values()), len(best)


#: Bytes of a text up to which it is learned from; what reaches the driver is at most this times two times ``per_class``.
LONGEST = 1 << 17


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class outside the held-out fold, by hash of the id; one text an id.

    Longer texts than ``longest`` bytes aren't learned from; they are scored as all others.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.md5(F.col("doc_id").cast("string"))
    picked = known.where("label = 1").orderBy(order).limit(per_class).union(known.where("label = 0").orderBy(order).limit(per_class))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    once = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return sorted((r["text"], r["label"]) for r in once.select("text", "label").toLocalIterator())  # so that sums don't depend on how rows are dealt


def label_share(labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id") -> float:
    """The share of label 1 among labelled rows outside the held-out fold."""
    x = labels.where(~held_out(doc_id)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return float(x or 0.0)


def candidates(words: Iterable[str], shortest: int = 4, longest: int = 9) -> set[str]:
    """Whole words and word beginnings of one text, with their borders."""
    out = set()
    for w in set(words):
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))
    return out


def learn(rows: list[tuple[str, int]], share: float, least: int = 3, chance: float = 0.02) -> Lexicon:
    """A lexicon from texts labelled 0 or 1; ``share`` is the share of label 1 in the whole."""
    folded = [(fold(t), y) for t, y in rows]
    bad, good = [x for x, y in folded if y], [x for x, y in folded if not y]
    base = min(max(share, 1e-4), 1 - 1e-4) if rows else 1e-9
    lexicon = Lexicon(bias=math.log(base / (1 - base)))
    if not bad or not good:
        return lexicon
    n1, n0 = len(bad), len(good)
    in_bad = support(bad, None)
    in_bad = Counter({p: k for p, k in in_bad.items() if k >= least})
    in_good = support(good, in_bad)
    spread = np.sort(np.array([k + in_good[p] for p, k in in_bad.items()]))
    found = []
    for p, a in in_bad.items():
        b = in_good[p]
        weight = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if weight < 2.5:
            continue
        e1 = (a + b) * n1 / (n1 + n0)
        gain = a * math.log(a / e1) + (b * math.log(b / (a + b - e1)) if b else 0.0)
        rivals = len(spread) - np.searchsorted(spread, a + b)  # candidates as frequent as this one
        if -gain + math.log(max(1, rivals)) < math.log(chance):
            found.append((gain, p, weight))
    # of beginnings that occur in the same texts, the longest; a beginning covers what continues it as purely
    found = [x for x in found if not any(in_bad.get(x[1] + c, 0) == in_bad[x[1]] for c in _next_letters(x[1], in_bad))]
    found.sort(key=lambda x: (-x[0], x[1]))
    for _, p, w in found:
        longer = [q for q in lexicon.entries if q.startswith(p)]
        if any(p.startswith(q) for q in lexicon.entries if q[-1] != " ") or longer and in_bad[p] < 1.3 * sum(in_bad[q] for q in longer):
            continue
        lexicon.entries[p] = round(w, 4)
    lexicon.exceptions = exceptions(lexicon.entries, bad, good)
    automaton = lexicon.automaton()
    x = np.array([(m := matched(automaton, t))[0:1] + (t.count(" "),) for t, _ in folded], float)
    y = np.array([k for _, k in folded], float)
    fit(lexicon, x, y, base)
    return lexicon


def support(texts: list[str], of: Counter | None) -> Counter:
    """By candidate, the number of texts with it, a word between the same two neighbours counted in the first alone.

    So copies of a text, or a passage that many texts share, don't pass for independent evidence.
    """
    out: Counter = Counter()
    seen: set[int] = set()
    for x in texts:
        words = x.split()
        own = set()
        for w, a, b in zip(words, ["", *words], [*words[1:], ""], strict=False):
            if (k := hash((a, w, b))) not in seen:
                seen.add(k)
                own.add(w)
        got = candidates(own)
        out.update(got if of is None else (p for p in got if p in of))
    return out


def _next_letters(prefix: str, known: Counter) -> list[str]:
    return [] if prefix.endswith(" ") else [c for c in "abcdefghijkmnopqrstuvwxyz " if prefix + c in known]


def exceptions(entries: dict[str, float], bad: list[str], good: list[str], least: int = 5) -> list[str]:
    """Phrases of an entry with a neighbour that clear texts use and toxic texts hardly do."""

    def phrases(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for x in texts:
            words = x.split()
            hits = [i for i, w in enumerate(words) if any(f" {w} ".startswith(p) for p in by_letter.get(w[:1], ()))]
            out.update({f" {words[i]} {words[i + 1]} " for i in hits if i + 1 < len(words)} | {f" {words[i - 1]} {words[i]} " for i in hits if i})
        return out

    by_letter: dict[str, list[str]] = {}
    for p in entries:
        by_letter.setdefault(p[1], []).append(p)
    clear, toxic = phrases(good), phrases(bad)
    n0, n1 = len(good), len(bad)
    return sorted(p for p, k in clear.items() if k >= least and k / n0 > 4 * (toxic[p] + 0.5) / n1)


def fit(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, share: float, rounds: int = 50, ridge: float = 0.05) -> None:
    """Logistic regression by Newton steps; the classes weigh as their shares."""
    weight, words = x[:, 0], x[:, 1]
    f = np.stack([np.ones(len(y)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], 1)
    own = y.mean()
    each = np.where(y > 0, share / own, (1 - share) / (1 - own))
    b = np.array([lexicon.bias, 0.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ b, -40, 40)))
        g = f.T @ (each * (p - y)) + ridge * np.array([0, 1, 1]) * b
        h = (f * (each * p * (1 - p))[:, None]).T @ f + ridge * np.diag([1e-3, 1, 1])
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    lexicon.bias, lexicon.by_weight, lexicon.by_density = (float(v) for v in b)


SCORED = "doc_id long, score double, weight double, matches int, words int"


def score(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, score (0 to 1), matched weight, matches and words; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for whole in batches:
            for batch in slices(whole, 1):
                got = []
                for t in batch.column(1).to_pylist():
                    x = fold(t or "")
                    got.append((*matched(automaton, x), len(x.split())))
                weight, hits, words = (np.array(c, k) for c, k in zip(zip(*got, strict=True), (float, np.int32, np.int32), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (lexicon.score(weight, words), weight, hits, words))], names=["doc_id", "score", "weight", "matches", "words"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, threshold: float = 0.7) -> DataFrame:
    """Learn from at most ``per_class`` labelled documents of each class, then score all documents."""
    lexicon = learn(sample_labelled(docs, labels, per_class), label_share(labels))
    scored = score(docs, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "matches", "words")
