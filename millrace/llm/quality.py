"""Quality by hierarchical empirical Bayes: a document's own evidence and its path's, host's and corpus's record.

A logistic classifier reads the text. Labelled rows that aren't held out, and they alone, are added up by
path and host; each level's posterior is a Beta mean shrunk toward the level above, with a strength that
the spread between groups decides; and the document's log-odds move the path's posterior. What the
classifier says of unlabelled rows doesn't reach the rates: a path without labels has its host's rate, a
host without labels the corpus's. A row's own label is no part of its own rates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, is_held_out, join_counted, map_arrow
from .toxicity import logistic_sums, newton

FEATURES = ("length", "distinct", "runs", "upper", "symbols", "marks", "digits", "word_length", "lines", "sentences")
_SYMBOL = re.compile(r"[^\w\s.,;:'’()\-]")
_MARK = re.compile(r"[!|#$%&*]")


def features_of(text: str) -> list[float]:
    """Measures of a whole text, each about 0 to 1; an empty one gives zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    letters = max(1, sum(map(len, words)))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    return [
        min(1.0, np.log1p(n) / 10),
        len(set(words)) / n ** 0.8 if n > 1 else 1.0,
        same / n,
        upper / letters,
        len(_SYMBOL.findall(text)) / letters,
        len(_MARK.findall(text)) / n,
        sum(map(text.count, "0123456789")) / letters,
        min(2.0, letters / n / 8),
        len(set(lines)) / len(lines),
        min(1.0, text.count(".") * 10 / n),
    ] if chars else [0.0] * len(FEATURES)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x])


def measure(docs: DataFrame, key: str, text: str, kept: dict[str, Column]) -> DataFrame:
    """``kept`` columns and FEATURES of every row."""
    names = list(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features_of(v.as_py() or "") for v in batch.column(0)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x[:, j]) for j in range(len(FEATURES)))], names=[*names, *FEATURES])

    slim = docs.select(F.col(text).alias("__text"), *(c.alias(n) for n, c in kept.items()))
    kinds = dict(slim.dtypes)
    return map_arrow(slim, run, ", ".join([f"{n} {kinds[n]}" for n in names] + [f"{f} double" for f in FEATURES]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: float) -> float:
    """How many rows the level above counts for: by the spread of group means beyond chance, 2 to 1000."""
    r = groups.where("n >= 2").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) ** 2).alias("ss"), F.count("*").alias("k")).first()
    if not r.k or r.k < 2:
        return 50.0
    chance = mean * (1 - mean)
    between = max(1e-6, (r.ss - (r.k - 1) * chance) / r.n)
    return float(min(1000.0, max(2.0, chance / between)))


def fit_evidence(labelled: DataFrame, n: int, ridge: float = 1e-3) -> list[float]:
    """Weights of FEATURES, their squares and the constant, fitted to ``__good`` of all ``n`` rows of ``labelled``.

    Each Newton step is a pass over the rows; only sums come to the driver. The weights are rounded, so
    that the order in which tasks are added up doesn't show.
    """
    size = 2 * len(FEATURES) + 1
    slim = labelled.select("__good", *FEATURES)

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + size * size)
            for batch in batches:
                x = _squares(np.column_stack([c.to_numpy() for c in batch.columns[1:]]))
                slope, curve = logistic_sums(np.hstack([x, np.ones((len(x), 1))]), batch.column(0).to_numpy(), w)
                total += np.concatenate([slope, curve.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "part"])

        parts = map_arrow(slim, run, "i int, part double").groupBy("i").agg(F.sum("part").alias("part")).collect()
        total = np.zeros(size + size * size)
        total[[r.i for r in parts]] = [r.part for r in parts]
        return n, total[:size], total[size:].reshape(size, size)

    return np.round(newton(size, sums, ridge), 9).tolist()


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, evidence, host_rate, path_rate, score, keep`` of every row.

    ``evidence`` is the classifier's log-odds beyond the prior, held to -8 to 8, ``*_rate`` the shrunken shares of good
    rows, ``score`` the posterior probability of good quality. The classifier and the prior learn from all
    labelled rows that are not held out; the rates from the same rows, but a row's own. An id with several labels counts as good if all are; of its repeated rows each
    leaves out one label. Null hosts and paths are groups
    of their own; null and empty texts have features of zero; without labels every score is 0.5 and
    every row is kept; an empty table gives an empty result.
    """
    known = labels.where(F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("__good"))
    kept = {"doc_id": F.col(key), "held_out": is_held_out(F.col(key)), "host": F.coalesce(host.cast("string"), F.lit("")), "path": F.coalesce(path.cast("string"), F.lit(""))}
    rows = cut_lineage(measure(docs, key, text, kept))
    # rows without an id have no label, and would meet in one task
    rows = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(rows.where("doc_id IS NULL").withColumn("__good", F.lit(None).cast("double")))
    labelled = cut_lineage(rows.where("__good IS NOT NULL").select("host", "path", "__good", *FEATURES))
    seen = labelled.agg(F.count("*").alias("n"), F.avg("__good").alias("mean"), F.countDistinct("__good").alias("kinds")).first()
    prior = float(np.clip(seen.mean, 0.01, 0.99)) if seen.n else 0.5
    weights = fit_evidence(labelled, seen.n) if seen.kinds == 2 else [0.0] * (2 * len(FEATURES)) + [float(np.log(prior / (1 - prior)))]
    n = len(FEATURES)
    odds = sum((F.col(f) * float(weights[j]) + F.col(f) * F.col(f) * float(weights[n + j]) for j, f in enumerate(FEATURES)), F.lit(float(weights[-1])))
    # damped, as neither the classifier nor the record of a site is sure of itself
    evidence = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), odds - float(np.log(prior / (1 - prior)))))
    scored = rows.select("doc_id", "held_out", "host", "path", "__good", evidence.alias("evidence"))
    sums = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("__good").alias("good"))
    paths = cut_lineage(sums)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    strong_host = _strength(hosts, prior)
    strong_path = _strength(paths, prior)
    # every path with its and its host's record and how many rows it has; a hot one is joined apart
    sites = scored.groupBy("host", "path").agg(F.count("*").alias("rows"))
    records = sites.join(paths.withColumnsRenamed({"n": "path_n", "good": "path_good"}), ["host", "path"], "left").join(hosts.withColumnsRenamed({"n": "host_n", "good": "host_good"}), "host", "left")
    merged = join_counted(scored, cut_lineage(records.na.fill(0, ["path_n", "path_good", "host_n", "host_good"])), ["host", "path"], "rows")
    own, mine = F.col("__good").isNotNull().cast("int"), F.coalesce("__good", F.lit(0.0))

    def shrunk(level: str, strength: float, above: Column) -> Column:
        return (F.col(f"{level}_good") - mine + strength * above) / (F.col(f"{level}_n") - own + strength)

    rated = merged.withColumn("host_rate", shrunk("host", strong_host, F.lit(prior))).withColumn("path_rate", shrunk("path", strong_path, F.col("host_rate")))
    inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_rate")))
    score = 1 / (1 + F.exp(-(_logit(inside) + F.col("evidence"))))
    return rated.select("doc_id", "held_out", "evidence", "host_rate", "path_rate", score.alias("score")).withColumn("keep", F.col("score") >= threshold)


def quality_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Hosts are the documents' sources; a source's languages stand for its paths, as the table has no addresses."""
    return score_quality(documents, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
