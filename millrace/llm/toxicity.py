"""Toxicity: a learned lexicon in a trie, walked together with a Levenshtein automaton of each token.

Terms are whole words or stems (any ending) whose documents are mostly labelled toxic. A token meets a
term at a bounded edit distance, so that misspelled terms count too. Each hit is read in its window of
neighbouring tokens: quotation marks and words of reporting speak for quotation, words of address for
abuse. A logistic regression weighs these counts into a score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, is_held_out, least_by_hash, map_arrow, released

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words of reporting and of address, and quotation marks.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes reported according term word dit écrit selon sagte schrieb laut nannte dijo escribió según".split())
ADDRESS = frozenset("you your you're yours u ur du dich dir dein deine tu te toi ton ta vous votre tú usted ustedes tus".split())
QUOTES = "\"“”„«»‹›"
END = "$"
SHORTEST, LONGEST = 4, 12
FEATURES = ("exact", "fuzzy", "distinct", "density", "cluster", "best", "quoted", "addressed")
#: So many of FEATURES count hits; the last two tell how they are meant.
COUNTS = 6


class Trie:
    """Terms as nested dicts, walked together with the Levenshtein automaton of a token.

    A node keeps its term under the empty string and the most edits of the terms below it under None. A
    stem ends without END. The automaton's state is one bit mask for each number of edits: bit i says
    that the first i letters of the token meet the path with so many edits at most.
    """

    def __init__(self, terms: list[str], allowed: Callable[[str], int]):
        self.allowed = allowed
        self.root: dict = {None: 0}
        for term in terms:
            node = self.root
            for c in term:
                node[None] = max(node[None], allowed(term))
                node = node.setdefault(c, {None: 0})
            node[""] = term
            node[None] = max(node[None], allowed(term))

    def nearest(self, token: str) -> tuple[str, int] | None:
        """The closest term within its allowance of ``token``, ties to the first in order: (term, edits).

        A stem is compared with every beginning of the token, a whole word with all of it.
        """
        n = len(token)
        full, last = (1 << (n + 1)) - 1, 1 << n
        at: dict[str, int] = {}
        for i, c in enumerate(token):
            at[c] = at.get(c, 0) | 1 << i
        best: tuple[int, str] | None = None
        stack = [(self.root, [(1 << (d + 1)) - 1 & full for d in range(self.root[None] + 1)])]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c is None:
                    continue
                if c == "" or c == END:
                    term = child if c == "" else child[""]
                    ends = full if c == "" else last
                    edits = next((d for d in range(min(self.allowed(term) + 1, len(state))) if state[d] & ends), None)
                    if edits is not None and (best is None or (edits, term) < best):
                        best = (edits, term)
                    continue
                met = at.get(c, 0)
                new = [(state[0] & met) << 1]
                for d in range(1, min(child[None] + 1, len(state))):
                    less = state[d - 1]
                    new.append((((state[d] & met) | less | new[d - 1]) << 1 | less) & full)
                if new[-1]:
                    stack.append((child, new))
        return None if best is None else (best[1], best[0])


def edits_allowed(term: str) -> int:
    """Words: 1 from five letters on, 2 from nine; stems: 1 from six; shorter ones 0."""
    letters = len(term.rstrip(END))
    if not term.endswith(END):
        return int(letters >= 6)
    return 0 if letters < 5 else 2 if letters >= 9 else 1


class Matcher(dict):
    """Token -> (term, edits) or None, kept for tokens met before.

    Within e edits, one of e + 1 parts of a term stands in the token unchanged, at most e places away;
    tokens without such a part, or of another length, never reach the automaton.
    """

    def __init__(self, terms: list[str], strengths: list[float]):
        super().__init__()
        self.strength = dict(zip(terms, strengths, strict=True))
        self.words = {t for t in terms if t.endswith(END)}
        self.stems = set(terms) - self.words
        self.stem_lengths = sorted({len(s) for s in self.stems})
        self.trie = Trie([t for t in terms if edits_allowed(t)], edits_allowed)
        self.parts: dict[str, list[tuple[int, int, int, int]]] = {}
        for term in terms:
            letters, edits = term.rstrip(END), edits_allowed(term)
            if edits:
                cuts = [round(i * len(letters) / (edits + 1)) for i in range(edits + 2)]
                most = len(letters) + edits if term in self.words else 1 << 30
                for a, b in zip(cuts, cuts[1:]):
                    self.parts.setdefault(letters[a:b], []).append((a, edits, len(letters) - edits, most))
        self.part_lengths = sorted({len(p) for p in self.parts})
        self.reach = max((a + e for spots in self.parts.values() for a, e, _, _ in spots), default=-1)

    def _near(self, token: str) -> bool:
        n, parts = len(token), self.parts
        for size in self.part_lengths:
            for at in range(min(n - size, self.reach) + 1):
                for a, e, least, most in parts.get(token[at : at + size], ()):
                    if least <= n <= most and a - e <= at <= a + e:
                        return True
        return False

    def __missing__(self, token: str) -> tuple[str, int] | None:
        if len(self) > 200_000:  # about 20 MB; a worker lives on after its stage
            self.clear()
        found = None
        if token + END in self.words:
            found = (token + END, 0)
        elif any(token[:n] in self.stems for n in self.stem_lengths):
            found = (next(token[:n] for n in self.stem_lengths if token[:n] in self.stems), 0)
        elif self._near(token):
            found = self.trie.nearest(token)
        self[token] = found
        return found


@dataclass(frozen=True)
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)  # of FEATURES, then the constant
    window: int = 8
    strengths: list[float] = field(default_factory=list)  # of the terms: log-odds over their texts


def features_of(text: str, matcher: Matcher, window: int) -> list[float]:
    """The counts of FEATURES over a whole text; no hit gives zeros."""
    low = text.lower()
    tokens = _WORD.findall(low)
    hits = {w: m for w in set(tokens) if (m := matcher[w])}
    if not hits:
        return [0.0] * len(FEATURES)
    at = [i for i, w in enumerate(tokens) if w in hits]
    marks = [m.start() for m in re.finditer(f"[{QUOTES}]", low)]
    starts = [m.start() for m in _WORD.finditer(low)] if marks else []
    quoted = addressed = exact = 0
    for i in at:
        around = tokens[max(0, i - window) : i + window + 1]
        k = bisect_left(marks, starts[i]) if marks else 0
        inside = bool(marks) and k % 2 == 1 and k < len(marks) and marks[k] - marks[k - 1] <= 40 * window
        quoted += inside or any(w in REPORTING for w in around)
        addressed += any(w in ADDRESS for w in around)
        exact += hits[tokens[i]][1] == 0
    cluster = max(bisect_left(at, i + 4 * window) - k for k, i in enumerate(at))
    fuzzy = len(at) - exact
    best = max((matcher.strength[t] for t, edits in hits.values() if edits == 0), default=0.0)
    distinct = len({hits[tokens[i]][0] for i in at})
    return [np.log1p(exact), np.log1p(fuzzy), np.log1p(distinct), len(at) / len(tokens), np.log1p(cluster), best, quoted / len(at), addressed / len(at)]


def _stems(text: str) -> dict[str, int]:
    """Every beginning of each word of a text, and the word with END, with a mask of the words before it.

    The mask has one of 64 bits set for each word that stands before; over many texts its bits tell how
    different the places are, however many copies of one text there are.
    """
    tokens = _WORD.findall(text.lower())
    masks: dict[str, int] = {}
    before = " "
    for w in tokens:
        if len(w) >= SHORTEST:
            masks[w] = masks.get(w, 0) | 1 << ((ord(before[0]) * 31 + ord(before[-1]) * 7 + len(before)) & 63)
        before = w
    out: dict[str, int] = {}
    for w, mask in masks.items():
        out[w + END] = mask
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[w[:n]] = out.get(w[:n], 0) | mask
    return out


def choose_terms(toxic: dict[str, int], clean: dict[str, int], precision: float) -> list[str]:
    """Stems and words of whose texts at least the share ``precision`` is toxic.

    Of a chain of beginnings the shortest that qualifies is grown for as long as its texts stay (nearly)
    the same, so that a stem with many endings is one term and a word is that word.
    """
    good = {s: n for s, n in toxic.items() if n >= precision * (n + clean.get(s, 0))}
    following: dict[str, list[str]] = {}
    for s in good:
        following.setdefault(s[:-1], []).append(s)
    terms = []
    for s in good:
        if s[:-1] in good:
            continue
        while more := [x for x in following.get(s, []) if good[x] >= 0.98 * good[s]]:
            s = max(more, key=lambda x: (good[x], x))
        terms.append(s)
    return sorted(set(terms))


def newton(size: int, sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], ridge: float = 1e-2, rounds: int = 60) -> list[float]:
    """Ridge logistic regression by Newton steps; ``sums`` gives, for weights, the number of rows and ``logistic_sums``."""
    w = np.zeros(size)
    for _ in range(rounds):
        n, slope, curve = sums(w)
        step = np.linalg.solve(curve / n + ridge / 10 * np.eye(size), slope / n - ridge / 10 * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def logistic_sums(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the log-likelihood at weights ``w``, added up over rows."""
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return a.T @ (y - p), (a * (p * (1 - p))[:, None]).T @ a


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> list[float]:
    """Ridge logistic regression of rows in memory; the last weight is the constant."""
    a = np.hstack([x, np.ones((len(x), 1))])
    return newton(a.shape[1], lambda w: (len(a), *logistic_sums(a, y, w)), ridge, rounds)


def fit_rising(x: np.ndarray, y: np.ndarray, rising: int) -> list[float]:
    """A regression in which more of the first ``rising`` features never lowers the score: those that would are left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.array(fit_logistic(x * used, y))
        down = np.flatnonzero((w[:rising] < 0) & used[:rising])
        if not len(down):
            return (w * np.append(used, True)).tolist()
        used[down[w[down].argmin()]] = False


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, support: int = 5, precision: float = 0.9, window: int = 8) -> ToxicityModel:
    """A model from at most ``sample`` labelled rows that are not held out, taken in the order of their ids' hash.

    A term must follow ``support`` different words or more in toxic texts, so that the words of one much
    copied text are no terms; all other terms stay, as the sample bounds them. Rows without a text, id or label are not learned from; an id with several labels counts as toxic if
    one of them is. No labels, or labels of one kind, give a model that scores 0 everywhere.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = least_by_hash(known, "doc_id", sample)
    # the chosen ids are bounded by ``sample``
    rows = cut_lineage(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))

    def count(label: int, among: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter[str] = Counter()
            places: dict[str, int] = {}
            for batch in batches:
                for value in batch.column(0):
                    for stem, mask in _stems(value.as_py()).items():
                        if among is None or stem in among:
                            total[stem] += 1
                            places[stem] = places.get(stem, 0) | mask
            masks = np.array([places[s] for s in total], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array(masks)], names=["stem", "n", "places"])

        found = map_arrow(rows.where(F.col("toxic") == label).select("text"), run, "stem string, n long, places long").groupBy("stem").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("places")).alias("places"))
        return {r.stem: r.n for r in found.where(F.col("places") >= support if among is None else F.lit(True)).toLocalIterator()}

    toxic = count(1, None)
    clean = count(0, frozenset(toxic))
    terms = choose_terms(toxic, clean, precision)
    if not terms:
        return ToxicityModel()
    strengths = [float(np.log((toxic[t] + 0.5) / (clean.get(t, 0) + 0.5))) for t in terms]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, strengths)
        for batch in batches:
            x = np.array([features_of(v.as_py(), matcher, window) for v in batch.column(0)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, j]) for j in range(len(FEATURES)))], names=["toxic", *FEATURES])

    table = map_arrow(rows, measure, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    y = table["toxic"].to_numpy(np.float64)
    if len({*y}) < 2:
        return ToxicityModel()
    table = table.sort_values(list(table.columns), kind="stable")  # the sums don't depend on the order of tasks
    return ToxicityModel(terms, fit_rising(table[list(FEATURES)].to_numpy(), table["toxic"].to_numpy(np.float64), COUNTS), window, strengths)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, n_terms`` of every row, from its whole text.

    Null and empty texts are scored as texts without a hit. Repeated rows each get a row; an empty
    table gives an empty result. ``n_terms`` counts the different terms met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms, model.strengths)
        weights = np.array(model.weights)
        for batch in batches:
            x = np.array([features_of(v.as_py() or "", matcher, model.window) for v in batch.column(2)], np.float64).reshape(-1, len(FEATURES))
            scores = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))) if len(weights) else np.zeros(len(x))
            n = np.rint(np.expm1(x[:, 2])).astype(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_terms"])

    kind = dict(docs.dtypes)[key]
    slim = docs.select(F.col(key).alias("doc_id"), is_held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return map_arrow(slim, run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_terms long")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``threshold``; nothing is shuffled."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms, model.strengths)
        weights = np.array(model.weights)
        for batch in batches:
            x = np.array([features_of(v.as_py() or "", matcher, model.window) for v in batch.column(names.index("text"))], np.float64).reshape(-1, len(FEATURES))
            scores = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))) if len(weights) else np.zeros(len(x))
            left = batch.filter(pa.array(scores < threshold))
            # whole rows go back in small batches, each of which is held outside the heap
            yield from (left.slice(at, 1_000) for at in range(0, left.num_rows, 1_000))

    return docs.mapInArrow(released(run), docs.schema)


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(documents, fit_toxicity(documents, labels))
