"""Personal data: base spans by fixed formats, more by boosted trees over high-recall candidates.

Everything that touches rows is a DataFrame expression. Generators propose overlapping spans; gradient
boosted trees over format and context features score them; thresholds calibrated for precision select.
The trees are fitted on the driver from generated examples (their number is a parameter) and become CASE
expressions.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
#: Base kinds in their order. Possessive and anchored forms of the plain formats: the same leftmost matches,
#: found in linear time and without recursion. A card is a whole chain of digits with single separators.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High-recall generators: (kind, format). They may overlap one another and the base spans.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,63}+){1,4}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9])[0-9]{4}[ ./-][0-9]{4,6}[ ./-][0-9]{4,5}(?:[ ./-][0-9]{1,4})?(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[-. /])[0-9]{2,4}[-. ][0-9]{2,5}(?![0-9])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("id", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Z0-9])"),
    ("secret", r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|token|secret|passw(?:or)?d)[\"' ]{0,3}[:=][\"' ]{0,3}[a-z0-9_\-./+]{8,}+"),
    ("secret", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9_-])(?:gh[opsu]_|glpat-|xox[abp]-|[ps]k[-_]|eyJ)(?=[A-Za-z_.-]*+[0-9])[A-Za-z0-9_.-]{16,}+"),
)
#: What a text must hold for a kind's generators to be tried; a digit, if not said here.
NEEDS = {"email": r"(?:\(at\)|\[at\]|\{at\})", "secret": "[=:]|A[KS]IA|gh[opsu]_|glpat-|xox|[ps]k[-_]|eyJ"}
KINDS = ("email", "ip", "card", "phone", "id", "secret")
#: Words that speak for personal data just before a span, and words that speak for other numbers.
FOR = "mail|contact|phone|tel|call|mobile|fax|whatsapp|reach|card|visa|credit|iban|account|ssn|social|address|host|server|login|key|token|secret|password|numéro|nummer|teléfono|correo|konto"
AGAINST = "order|invoice|page|version|isbn|issn|total|price|chapter|section|figure|table|year|date|code|build|release|part|item|ref"
#: Cues are whole words, an s at the end aside.
CUE = r"(?<![a-zà-ÿ])(?:{})s?(?![a-zà-ÿ])"
WINDOW = 32
FEATURES = ("kind", "digits", "length", "marks", "luhn", "speaks", "denies", "joined", "distinct")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    places = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def spans_of(text: Column, pattern: str) -> Column:
    """``start, end, found`` (code points, end exclusive) of every leftmost match, one pass.

    Matches are set between marks and the text is split at them; a mark in the text itself was
    replaced before (``unmarked``), so that lengths add up to positions.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        one = F.struct(a["at"].alias("start"), end.alias("end"), p.alias("found"))
        return F.struct((a["i"] + 1).alias("i"), end.alias("at"), F.when(a["i"] % 2 == 1, F.array_append(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def unmarked(text: Column) -> Column:
    """The text with null as empty and the mark replaced by another control character; lengths stay."""
    return F.translate(F.coalesce(text, F.lit("")), MARK, "\u0002")


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of one kind: leftmost matches that pass the kind's rule; failing ones are dropped."""
    found = spans_of(text, BASE[kind])
    if kind == "ip":
        found = F.filter(found, lambda s: F.forall(F.split(s["found"], r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")))
    if kind == "card":
        found = F.filter(found, lambda s: _luhn(_digits(s["found"])))
    if kind == "phone":
        found = F.filter(found, lambda s: F.length(_digits(s["found"])).between(9, 15))
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9]"), "phone": text.contains("+")}[kind]
    return F.when(needs, found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)"))


# -- the classifier ----------------------------------------------------------------------------


def features_of(kind: str, found: str, before: str, after: str) -> list[float]:
    """The features of one candidate, as ``feature_columns`` computes them."""
    d = re.sub("[^0-9]", "", found)
    total = sum(n if i % 2 == 0 else 2 * n - (9 if n > 4 else 0) for i, n in enumerate(map(int, reversed(d))))
    joined = bool(re.search("[A-Za-z0-9]$", before)) or bool(re.search("^[A-Za-z0-9]", after))
    marks = len(re.sub("[A-Za-z0-9]", "", found))
    near = before.lower()
    return [float(x) for x in (KINDS.index(kind), len(d), len(found), marks, total % 10 == 0, bool(re.search(CUE.format(FOR), near)), bool(re.search(CUE.format(AGAINST), near)), joined, len(set(d)))]


def feature_columns(kind: str, span: Column, text: Column) -> list[Column]:
    found = span["found"]
    before = F.substring(text, F.greatest(F.lit(1), span["start"] - WINDOW + 1), F.least(F.lit(WINDOW), span["start"]))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    d, near = _digits(found), F.lower(before)
    joined = before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")
    distinct = F.size(F.array_distinct(F.filter(F.split(d, ""), lambda c: c != "")))
    flags = [_luhn(d), near.rlike(CUE.format(FOR)), near.rlike(CUE.format(AGAINST)), joined]
    numbers = [F.lit(float(KINDS.index(kind))), F.length(d), F.length(found), F.length(F.regexp_replace(found, "[A-Za-z0-9]", ""))]
    return [*(n.cast("double") for n in numbers), *(F.coalesce(f, F.lit(False)).cast("double") for f in flags), distinct.cast("double")]


def _example(rng: random.Random) -> tuple[str, str, str, str, int]:
    """A generated candidate: kind, span, text before and after it, and whether it is personal data."""

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word(n: int) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    kind, real = rng.choice(KINDS), rng.random() < 0.5
    if kind == "email":
        found = f"{word(rng.randint(3, 9))}{rng.choice([' (at) ', '[at]', ' [at] '])}{word(rng.randint(3, 9))}{rng.choice([' (dot) ', '[dot]', '.'])}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}" if real else f"{word(1)}[at]{word(2)}.{digits(2)}"
    elif kind == "ip":
        found = ":".join(f"{rng.getrandbits(16):x}" for _ in range(rng.choice([6, 8, 8, 8]))) if real else ":".join(digits(2) for _ in range(4))
    elif kind == "card":
        body = digits(15)
        last = next(c for c in "0123456789" if sum(n if i % 2 == 0 else 2 * n - (9 if n > 4 else 0) for i, n in enumerate(map(int, reversed(body + c)))) % 10 == 0)
        number = body + (last if real else rng.choice("0123456789".replace(last, "")))
        sep = rng.choice("./ -")
        found = sep.join(number[i : i + 4] for i in range(0, 16, 4))
    elif kind == "phone":
        found = rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(4)} {digits(3)} {digits(4)}"]) if real else rng.choice([f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(2)} {digits(2)} {digits(2)}"])
    elif kind == "id":
        found = rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", rng.choice(["DE", "FR", "ES", "GB"]) + digits(2) + "".join(f" {digits(4)}" for _ in range(rng.randint(3, 5)))])
    else:
        said, mixed = rng.choice(["token", "api_key", "password", "secret"]), [rng.choice("abcdefABCDEF0123456789_") for _ in range(rng.randint(16, 40))]
        upper = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        prefix = rng.choice(["ghp_", "glpat-", "xoxb-", "sk-", "pk_", "eyJ"])
        if real:
            found = rng.choice([f"{said} = {''.join(mixed)}", f"{said}={''.join(mixed).lower()}", rng.choice(["AKIA", "ASIA"]) + upper, prefix + "".join(mixed) + digits(2)])
        else:
            found = rng.choice([f"{said}: {word(rng.randint(8, 10))}", f"{said}={word(9)}", f"{prefix}{word(6)}-{word(5)}-{word(6)}"])
    speaks, denies = FOR.split("|"), AGAINST.split("|")
    told = rng.random()
    cue = rng.choice(speaks if real else denies) if told < 0.6 else word(5) if told < 0.9 else rng.choice(denies if real else speaks)
    return kind, found, f"{word(4)} {cue}{rng.choice([' ', ': ', ' no. '])}" + ("" if real or rng.random() < 0.8 else word(1)), rng.choice([" ", ".", ",", ""]), int(real)


@dataclass(frozen=True)
class Trees:
    """``f0 <= cut0 ? (f1 <= cut1 ? a : b) : (f2 <= cut2 ? c : d)``, added up from ``start``."""

    start: float
    trees: tuple[tuple[tuple[int, float], tuple[int, float], tuple[int, float], tuple[float, float, float, float]], ...]
    thresholds: dict[str, float]

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for (f0, c0), (f1, c1), (f2, c2), (a, b, c, d) in self.trees:
            total += np.where(x[:, f0] <= c0, np.where(x[:, f1] <= c1, a, b), np.where(x[:, f2] <= c2, c, d))
        return total

    def column(self, features: list[Column]) -> Column:
        def tree(t) -> Column:
            (f0, c0), (f1, c1), (f2, c2), (a, b, c, d) = t
            left = F.when(features[f1] <= c1, a).otherwise(b)
            right = F.when(features[f2] <= c2, c).otherwise(d)
            return F.when(features[f0] <= c0, left).otherwise(right)

        return reduce(lambda s, t: s + tree(t), self.trees, F.lit(self.start))


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, float]:
    best = (0, 0.0, -1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2 if len(values) < 40 else np.quantile(values, np.linspace(0.03, 0.97, 32)):
            low = x[:, f] <= cut
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl * gl / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
            if gain > best[2] + 1e-12:
                best = (f, float(cut), float(gain))
    return best


@cache
def fit_trees(examples: int = 3000, rounds: int = 24, rate: float = 0.4, precision: float = 0.97, seed: int = 11) -> Trees:
    """Boosted depth-two trees on ``examples`` generated candidates; a third of them calibrate each kind's threshold."""
    rng = random.Random(seed)
    made = [_example(rng) for _ in range(examples)]
    x = np.array([features_of(*m[:4]) for m in made])
    y = np.array([m[4] for m in made], float)
    n = examples * 2 // 3
    start, total, trees = 0.0, np.zeros(n), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y[:n] - p, p * (1 - p)
        f0, c0, _ = _best_split(x[:n], g, h)
        splits, leaves = [(f0, c0)], []
        for side in (x[:n, f0] <= c0, x[:n, f0] > c0):
            f, c, _ = _best_split(x[:n][side], g[side], h[side]) if side.any() else (0, 0.0, 0.0)
            splits.append((f, c))
            for leaf in (side & (x[:n, f] <= c), side & (x[:n, f] > c)):
                value = float(rate * g[leaf].sum() / (h[leaf].sum() + 1))
                leaves.append(value)
                total[leaf] += value
        trees.append((splits[0], splits[1], splits[2], tuple(leaves)))
    fitted = Trees(start, tuple(trees), {})
    scores, truth = fitted.logit(x[n:]), y[n:]
    thresholds = {}
    for k, kind in enumerate(KINDS):
        mine = x[n:, 0] == k
        s, t = scores[mine], truth[mine]
        order = np.argsort(-s, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero(good >= precision)
        thresholds[kind] = float(s[order][fine[-1]]) if len(fine) else float("inf")
    return Trees(start, tuple(trees), thresholds)


# -- the operator ------------------------------------------------------------------------------


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Trees | None = None) -> DataFrame:
    """``doc_id, base, more`` of every row: arrays of ``kind, start, end`` in code points, end exclusive.

    ``base`` holds the base spans, by kind in the order of ``BASE`` and then by start. ``more`` holds
    the candidates that the trees select and that overlap no base span and no candidate of a higher
    score (ties: the earlier, then the first kind). Null texts count as empty. Whole texts are read;
    repeated rows each get a row; an empty table gives an empty result. Nothing is shuffled.
    """
    model = model or fit_trees()
    kind_of = "array<struct<kind:string,start:int,end:int>>"
    rows = docs.select(F.col(key).alias("doc_id"), unmarked(F.col(text)).alias("t"))
    has = F.col("t").rlike("[0-9@=:\\[({]|eyJ|gh[opsu]_|xox|[ps]k[-_]|glpat-|A[KS]IA")
    rows = rows.select("doc_id", F.when(has, F.col("t")).otherwise("").alias("t"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")

    def named(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def scored(kind: str, pattern: str) -> Column:
        spans = F.when(F.col("t").rlike(NEEDS.get(kind, "[0-9]")), spans_of(F.col("t"), pattern)).otherwise(none)

        def one(s: Column) -> Column:
            score = model.column(feature_columns(kind, s, F.col("t")))
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

        return F.filter(F.transform(spans, one), lambda s: s["score"] >= model.thresholds[kind])

    rows = rows.select("doc_id", "t", F.concat(*(named(base_spans(F.col("t"), k), k) for k in BASE)).cast(kind_of).alias("base"))
    rows = rows.select("doc_id", "base", F.concat(*(scored(k, p) for k, p in GENERATORS)).alias("found"))

    def clash(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    free = F.filter("found", lambda s: ~F.exists("base", lambda b: clash(s, b)))
    rows = rows.select("doc_id", "base", F.array_distinct(free).alias("found"))

    def beaten(s: Column, o: Column) -> Column:
        first = (o["score"] > s["score"]) | (o["score"] == s["score"]) & ((o["start"] < s["start"]) | (o["start"] == s["start"]) & ((o["kind"] < s["kind"]) | (o["kind"] == s["kind"]) & (o["end"] < s["end"])))
        return clash(s, o) & first

    kept = F.filter("found", lambda s: ~F.exists("found", lambda o: beaten(s, o)))
    return rows.select("doc_id", "base", F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(kind_of).alias("more"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans by kind in the order of KINDS and then by start, comma-joined."""
    order = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in angle brackets."""
    spans = find_pii(docs.select(F.struct(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text")), "row").withColumnRenamed("doc_id", "row")
    every = F.sort_array(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = F.col("row")[text]
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        # base spans of different kinds may overlap: what is covered already isn't repeated
        gap = F.substring(whole, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
        told = F.when(s["end"] > a["at"], F.concat(a["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), told.alias("out"))

    def rest(a: Column) -> Column:
        return F.concat(a["out"], F.substring(whole, a["at"] + 1, F.length(whole)))

    return spans.select(F.col("row")[key].alias(key), F.when(whole.isNotNull(), F.aggregate(every, zero, step, rest)).alias(text))


def pii_digest(documents: DataFrame) -> DataFrame:
    found = find_pii(documents)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{k}") for k in BASE]
    digest = F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    every = F.concat("base", "more")
    return found.select("doc_id", *counts, digest, joined(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
