"""Benchmark decontamination: SimHash of item-sized windows, looked up in multi-index Hamming blocks.

A window can only resemble an item if it shares shingles with it, so windows are fingerprinted where the
weight of shared shingles is high enough for the asked similarity; the blocks then find every item
within the radius, and an exact weighted-shingle similarity decides.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_arrow, released

_WORD = re.compile(r"\w+")
#: Odd multipliers of the shingle hash (of our own choice: any odd constants do).
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores: case, punctuation and spacing don't count."""
    return _WORD.findall(text.lower()) if text else []


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 0)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` word hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ hashes[i : len(hashes) - n + 1 + i]) * _STEP
            out ^= out >> np.uint64(29)
        out *= _MIX
    return out ^ (out >> np.uint64(32))


def weighted_print(hashes: np.ndarray, weights: np.ndarray) -> int:
    """SimHash whose bits are voted for by the shingles' weights."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(len(hashes), 64)
    return int(np.packbits(weights @ bits > weights.sum() / 2, bitorder="little").view(np.uint64)[0])


def similarity(x: Counter[int], y: Counter[int], weights: dict[int, float], rare: float) -> float:
    """Weighted Jaccard similarity of two multisets of shingles; ``rare`` is the weight of one not in ``weights``."""
    both = sum(min(n, y[s]) * weights.get(s, rare) for s, n in x.items() if s in y)
    every = sum(max(x[s], y[s]) * weights.get(s, rare) for s in x.keys() | y.keys())
    return both / every if every else 0.0


@dataclass
class ItemIndex:
    """Items of one block of the benchmark."""

    ids: list[int]
    hashes: list[np.ndarray]  # shingles of each item
    sizes: np.ndarray  # words of each item
    vocabulary: dict[str, int]
    word_hashes: np.ndarray  # by vocabulary number; 0 is no item's word
    known: np.ndarray  # sorted shingles of all items
    weights: np.ndarray  # of ``known``
    by_shingle: dict[int, float]  # the same
    counts: list[Counter[int]]  # each item's shingles
    totals: np.ndarray  # each item's weight
    holders: np.ndarray  # items that hold each of ``known``, one after the other
    starts: np.ndarray  # where they start, and the end
    rare: float  # weight of a shingle that no item has
    others: tuple[np.ndarray, np.ndarray]  # sorted shingles that several items of any block have, and their weights
    prints: np.ndarray
    blocks: list[tuple[int, int, dict[int, np.ndarray]]]  # shift, mask, value -> items
    radius: int
    threshold: float
    n: int

    def weights_of(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        rest, weights = np.full(len(hashes), self.rare), self.others
        if len(weights[0]):
            at = np.minimum(np.searchsorted(weights[0], hashes), len(weights[0]) - 1)
            rest = np.where(weights[0][at] == hashes, weights[1][at], self.rare)
        return np.where(self.known[place] == hashes, self.weights[place], rest)

    def promising(self, place: np.ndarray) -> np.ndarray:
        """Items of which a text with these of ``known`` (repeats included) has weight enough somewhere."""
        first, n = self.starts[place], self.starts[place + 1] - self.starts[place]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(self.holders[at], np.repeat(self.weights[place], n), len(self.ids))
        return np.flatnonzero(shared >= self.threshold * self.totals - 1e-9)

    def near(self, fingerprint: int) -> np.ndarray:
        """All items within the radius: they agree on one of radius + 1 blocks at least."""
        found = [table[v] for shift, mask, table in self.blocks if (v := fingerprint >> shift & mask) in table]
        if not found:
            return np.empty(0, np.int64)
        items = np.unique(np.concatenate(found))
        return items[np.bitwise_count(self.prints[items] ^ np.uint64(fingerprint)) <= self.radius]


def build_index(items: list[tuple[int, str]], n: int, radius: int, threshold: float, whole: tuple[int, np.ndarray, np.ndarray] | None = None) -> ItemIndex:
    """Items without a word are left out; an item of fewer than ``n`` words is one shingle.

    ``whole`` is what ``benchmark_spread`` gives, if there are more items than these.
    """
    items = [(i, w) for i, t in items if i is not None and (w := words_of(t))]
    vocabulary = {w: k for k, w in enumerate(sorted({x for _, w in items for x in w}), 1)}
    word_hashes = np.array([0, *map(word_hash, vocabulary)], np.uint64)
    hashes = [shingles(word_hashes[[vocabulary[x] for x in w]], min(n, len(w))) for _, w in items]
    spread = Counter(chain.from_iterable(set(h.tolist()) for h in hashes))
    known = np.array(sorted(spread), np.uint64)
    total, several, held_by = whole or (len(items), np.empty(0, np.uint64), np.empty(0))
    often = dict(zip(several.tolist(), held_by.tolist()))
    weights = np.log1p(total / np.array([often.get(int(s), spread[int(s)]) for s in known], float))
    rare = float(np.log1p(total))
    by_shingle = dict(zip(known.tolist(), weights.tolist()))
    counts = [Counter(h.tolist()) for h in hashes]
    totals = np.array([sum(n * by_shingle[x] for x, n in c.items()) for c in counts])
    held = sorted((x, k) for k, c in enumerate(counts) for x in c)
    starts = np.concatenate([[0], np.cumsum([spread[int(x)] for x in known])]).astype(np.int64)
    holders = np.array([k for _, k in held], np.int64)
    sizes = np.array([len(w) for _, w in items], np.int64)
    index = ItemIndex([i for i, _ in items], hashes, sizes, vocabulary, word_hashes, known, weights, by_shingle, counts, totals, holders, starts, rare, (several, np.log1p(total / held_by)), np.empty(0, np.uint64), [], radius, threshold, n)
    index.prints = np.array([weighted_print(h, index.weights_of(h)) for h in hashes], np.uint64)
    edges = [round(k * 64 / (radius + 1)) for k in range(radius + 2)]
    for a, b in zip(edges, edges[1:]):
        values = (index.prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        index.blocks.append((a, (1 << (b - a)) - 1, {int(v): np.flatnonzero(values == v) for v in np.unique(values)}))
    return index


def leaks_of(text: str | None, index: ItemIndex) -> list[tuple[int, float, int, int]]:
    """``item_id, similarity, first word, words`` of the best window for each item that the text leaks."""
    words = words_of(text)
    if not words or not index.ids:
        return []
    numbers = np.fromiter(map(index.vocabulary.get, words, repeat(0)), np.int64, len(words))
    hashes = index.word_hashes[numbers]
    full: np.ndarray | None = None
    best: dict[int, tuple[float, int, int]] = {}
    for n in sorted({min(index.n, int(s)) for s in index.sizes}):
        runs = shingles(hashes, n)
        if not len(runs):
            continue
        strange = np.concatenate([[0], np.cumsum(numbers == 0)])
        place = np.minimum(np.searchsorted(index.known, runs), len(index.known) - 1)
        hit = (index.known[place] == runs) & (strange[n:] == strange[:-n])
        if not hit.any():
            continue
        likely = index.promising(place[hit])
        likely = likely[np.minimum(index.sizes[likely], index.n) == n]
        if not len(likely):
            continue
        shared = np.concatenate([[0.0], np.cumsum(np.where(hit, index.weights[place], 0.0))])
        for size in np.unique(index.sizes[likely]):
            span = min(int(size) - n + 1, len(runs))  # a text shorter than the item is one window
            least = index.totals[likely[index.sizes[likely] == size]].min()
            # what a window shares with all items bounds what it shares with one
            for at in np.flatnonzero(shared[span:] - shared[:-span] >= index.threshold * least - 1e-9):
                if full is None:  # words that no item has need their own hashes now
                    full = np.fromiter(map(word_hash, words), np.uint64, len(words))
                window = shingles(full[at : at + span + n - 1], n)
                heavy = index.weights_of(window)
                found = index.near(weighted_print(window, heavy))
                counts, weights = Counter(window.tolist()), ChainMap(dict(zip(window.tolist(), heavy.tolist())), index.by_shingle)
                for k in found[index.sizes[found] == size]:
                    s = similarity(counts, index.counts[k], weights, index.rare)
                    if s >= index.threshold and (k not in best or s > best[k][0]):
                        best[int(k)] = (s, int(at), span + n - 1)
    return [(index.ids[k], *v) for k, v in sorted(best.items())]


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = 16 << 20) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``block_bytes`` of text: each is what one pass over the documents looks for.

    The total is measured first; a benchmark under the bound is one block.
    """
    rows = benchmark.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        yield [(r.k, r.t) for r in rows.where(F.pmod(F.xxhash64("k"), F.lit(n)) == b).orderBy("k", "t").collect()]


def benchmark_spread(benchmark: DataFrame, n: int, key: str = "item_id", text: str = "text") -> tuple[int, np.ndarray, np.ndarray]:
    """How many items the whole benchmark has, and the sorted shingles that several of them have, with their number of items.

    Counted by a distributed aggregation; what comes to the driver is 16 bytes for each shingle of several items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int | None] = []
            for value in batch.column(0):
                if w := words_of(value.as_py()):
                    hashes = np.fromiter(map(word_hash, w), np.uint64, len(w))
                    found += [None, *np.unique(shingles(hashes, min(n, len(w)))).view(np.int64).tolist()]  # null stands for the item
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["shingle"])

    rows = benchmark.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(text))
    counted = map_arrow(rows, run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1 OR shingle IS NULL").toArrow()
    held, n_items = counted.column("shingle").combine_chunks(), counted.column("n").to_numpy()
    null = held.is_null().to_numpy(zero_copy_only=False)
    several, held_by = held.drop_null().to_numpy().view(np.uint64), n_items[~null].astype(float)
    order = np.argsort(several)
    return int(n_items[null].sum()), several[order], held_by[order]


def passes(docs: DataFrame, benchmark: DataFrame, words: int = 5, radius: int = 16, threshold: float = 0.8, block_bytes: int = 16 << 20) -> Iterator[tuple[Broadcast, Callable[[DataFrame], DataFrame]]]:
    """The broadcast index of each block of the benchmark, and what ends its pass.

    Of several blocks one at a time is held: a pass is then written to the checkpoint folder, and its index let go.
    """
    blocks = item_blocks(benchmark, block_bytes=block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return
    whole = benchmark_spread(benchmark, words) if second is not None else None
    for block in chain([first], [] if second is None else [second], blocks):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(block, words, radius, threshold, whole))

        def end(done: DataFrame, shared: Broadcast = shared) -> DataFrame:
            if whole is None:
                return done
            done = cut_lineage(done)
            shared.destroy()
            return done

        yield shared, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, similarity, start, words``: for each text and benchmark item it holds, the best window.

    Windows have the item's number of words, and a shorter text is one window; similarity is the weighted Jaccard similarity of their
    shingles of ``words`` words, a shingle weighing more the fewer items have it; ``threshold`` or more
    is a leak. ``start`` counts words. Null and blank texts leak nothing; items without a word are left
    out; repeated rows are reported as often as they come; an empty table on either side gives an
    empty result. Nothing is shuffled; each block of the benchmark is one pass over the documents.
    ``radius=63`` looks at every item whatever its fingerprint (but for an exact complement), so that the similarity alone decides.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, item_id long, similarity double, start long, words long"
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                found = leaks_of(value.as_py(), shared.value)
                at += [i] * len(found)
                rows += found
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=["doc_id", "item_id", "similarity", "start", "words"])

    out = docs.sparkSession.createDataFrame([], schema)
    for shared, end in passes(docs, benchmark, **options):
        out = out.union(end(map_arrow(slim, partial(run, shared), schema)))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item; one pass for each block, nothing shuffled."""
    names = docs.columns

    def run(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not leaks_of(v.as_py(), shared.value) for v in batch.column(names.index(text))], pa.bool_()))

    for shared, end in passes(docs, benchmark, **options):
        docs = end(docs.mapInArrow(released(partial(run, shared)), docs.schema))
    return docs
