"""Packing token sequences by cutting-stock column generation.

Each document is cut into full sequences and one remainder. The histogram of the remainders' lengths,
bounded by the capacity, is a cutting-stock problem: a linear program over patterns (how many pieces
of each length class fill one sequence), whose columns are priced by knapsack dynamic programming. The
rounded patterns are handed to the pieces by their rank within their class. The program sees only the
histogram, so its size depends on the capacity alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, cut_lineage, map_arrow
from .tokens import token_bytes

END = b"\0\0\0\0"
PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: full sequences from the start of each document, then its remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_bytes(tokenizer, ranks)
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                ids = encoder.of(value.as_py() or "") + END
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    at.append(i)
                    rows.append((start, len(part) // 4, crc32_of(part), n))
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(numbers[:, j]) for j in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)[key]
    return map_arrow(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), run, PIECES.format(kind=kind))


def best_knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern, pieces repeatable: its value and how many of each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if fits:
            gain = best[c - sizes[:fits]] + values[:fits]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], last[c] = gain[k], k
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), counts


def inverse_of(basis: np.ndarray) -> np.ndarray:
    """By elimination with row exchanges. A threaded BLAS's inverse was seen to wait for ever in a process that had started a JVM."""
    m = len(basis)
    both = np.hstack([basis, np.eye(m)])
    for k in range(m):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        rest = both[:, k].copy()
        rest[k] = 0
        both -= np.outer(rest, both[k])
    return both[:, m:]


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Fractional pattern counts that cover ``demand`` with about the fewest sequences.

    Revised simplex over generated columns, begun with one pattern for each size; it stops when the
    best column's value shows that the optimum is within ``gap``. Any state is a feasible cover, so
    ``rounds`` bounds time, not correctness.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / basis.diagonal())
    amount = (inverse * demand).sum(1)
    for i in range(rounds):
        prices = inverse.sum(0)
        value, column = best_knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + gap:
            break
        step = (inverse * column).sum(1)  # sums, as no product here needs a threaded BLAS
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, amount / step, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        if i % 200 == 199:  # from time to time afresh, so that rounding errors don't add up
            inverse = inverse_of(basis)
            amount = np.maximum((inverse * demand).sum(1), 0)
            continue
        amount = np.maximum(amount - ratio[leave] * step, 0)
        amount[leave] = ratio[leave]
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
    return [(basis[:, j].astype(np.int64), float(amount[j])) for j in range(m) if amount[j] > 1e-9]


@dataclass(frozen=True)
class Plan:
    """For each class, where the ranks of its pieces go: runs of ``per`` pieces for each sequence, from ``base`` on."""

    ends: dict[int, np.ndarray]
    per: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    sequences: int


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """Whole patterns for a histogram of class sizes: rounded down, the rest filled largest first."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes], np.int64)
    chosen: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    for pattern, amount in sorted(solve_patterns(sizes, demand.astype(float), capacity), key=lambda p: -p[1]) if len(sizes) else []:
        n = min(int(amount + 1e-6), int((left[pattern > 0] // pattern[pattern > 0]).min()))
        if n:
            chosen.append((pattern, n))
            left -= pattern * n
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            take = min(int(left[k]), room // int(sizes[k]))
            pattern[k] = take
            room -= take * int(sizes[k])
        n = max(1, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        chosen.append((pattern, n))
        left -= pattern * n
    ends, per, base = ({int(s): [] for s in sizes} for _ in range(3))
    at = 0
    for pattern, n in chosen:
        for k in np.flatnonzero(pattern):
            s = int(sizes[k])
            ends[s].append((ends[s][-1] if ends[s] else 0) + int(pattern[k]) * n)
            per[s].append(int(pattern[k]))
            base[s].append(at)
        at += n
    arrays = [{s: np.array(v, np.int64) for s, v in x.items()} for x in (ends, per, base)]
    return Plan(*arrays, at)


def place(plan: Plan, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The sequence of each piece, by its class and its rank within the class."""
    out = np.empty(len(classes), np.int64)
    for s in np.unique(classes):
        mine = classes == s
        k = ranks[mine]
        run = np.searchsorted(plan.ends[int(s)], k, "right")
        before = np.concatenate([[0], plan.ends[int(s)]])[run]
        out[mine] = plan.base[int(s)][run] + (k - before) // plan.per[int(s)][run]
    return out


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, quantum: int = 8, chunks: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are those of ``tokenizer`` (a file; ``ranks``: the same vocabulary as ranks) and id 0
    after them; null texts count as
    empty and give that one id. Lengths are rounded up to ``quantum`` for the patterns alone; offsets
    are of true lengths, gapless from 0. Repeated rows and ids are packed as often as they come; an
    empty table gives an empty result; extra columns are not read. Ranks are taken within
    ``chunks`` groups a class and shifted by the counts before, a table bounded by
    ``capacity / quantum * chunks`` rows, so no task holds a whole class.
    """
    pieces = cut_lineage(cut_pieces(docs, tokenizer, ranks, capacity, key, text))
    classes = F.ceil(F.col("length") / quantum).cast("int").alias("class")
    chunk = F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)).cast("int").alias("chunk")
    dealt = pieces.select("*", classes, chunk)
    counts = dealt.groupBy("class", "chunk").count()
    before = counts.selectExpr("class", "chunk", "sum(count) OVER (PARTITION BY class ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shift")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    plan = plan_packing(histogram, capacity // quantum)
    ranked = dealt.selectExpr("*", "row_number() OVER (PARTITION BY class, chunk ORDER BY doc_id, start) - 1L AS within")
    ranked = ranked.join(F.broadcast(before), ["class", "chunk"]).withColumn("rank", F.col("within") + F.coalesce("shift", F.lit(0)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seat = place(plan, batch.column("class").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(seat)], names=[*columns, "sequence_id"])

    kind = dict(pieces.dtypes)["doc_id"]
    seated = map_arrow(ranked.select(*columns, "class", "rank"), run, PIECES.format(kind=kind) + ", sequence_id long")
    return seated.selectExpr("*", "coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY length DESC, doc_id, start, ids_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS offset")


def padding(lengths: list[int], capacity: int) -> int:
    """Padding of sequences of these lengths: up to ``capacity``, none at a power of two."""
    return reduce(lambda n, x: n + (0 if x & (x - 1) == 0 else capacity - x), lengths, 0)
