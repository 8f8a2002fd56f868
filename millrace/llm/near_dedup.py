"""SimHash near-duplicates: tiled exact comparison by exclusive-or and bit counts.

Fingerprints are first dealt into buckets in which every pair within the radius must meet at least
once; within a bucket, tiles of rows sorted by population count are compared whole, and tile pairs
whose population counts differ by more than the radius are skipped. What leaves a task is a
spanning forest of its links, never all pairs, and components are joined up by distributed
rewriting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.alike import ORDER_ROWS, SET_TILE, fine_tally_of, member_order, prefix_of, similar_components, tally_of, tiled
from .common import BROADCAST_KEYS, CONTENT, content_numbers, cut_lineage, join_counted, map_arrow, stream_groups
from .components import connected_components
from .simhash import fingerprint, shingle_hashes, words_of


class Forest:
    """Union-find over 0..n-1 that keeps, for every node, the label of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)


def tile_links(prints: np.ndarray, radius: int, forest: Forest, verify: Callable[[int, int], bool] | None = None, tile: int = 256) -> None:
    """Unite in ``forest`` all rows of ``prints`` (uint64) at ``radius`` or fewer differing bits, if ``verify`` agrees.

    Pairs that are connected already are not looked at again.
    """
    counts = np.bitwise_count(prints).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    prints, counts = prints[order], counts[order]
    for a in range(0, len(prints), tile):
        left = prints[a : a + tile]
        for b in range(a, len(prints), tile):
            if counts[b] - counts[min(a + tile, len(prints)) - 1] > radius:
                break
            right = prints[b : b + tile]
            near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
            if a == b:
                near = np.triu(near, 1)
            for i in np.flatnonzero(near.any(1)):
                u = order[a + i]
                met = order[b + np.flatnonzero(near[i])]
                for v in met[forest.label[met] != forest.label[u]]:
                    if forest.label[u] != forest.label[v] and (verify is None or verify(u, v)):
                        forest.unite(u, v)


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` and ``fp`` (signed 64-bit) of each row's whole text. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(shingle_hashes(words_of(t.as_py()), words)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["key", "fp"])

    kind = dict(docs.dtypes)[key]
    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of which every pair within ``radius`` agrees on at least one.

    64 bits in ``blocks`` parts; ``radius`` differing bits touch at most ``radius`` parts, so some
    ``blocks - radius`` parts are equal.
    """
    if not radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_components(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``fp, root`` of those distinct fingerprints of column ``fp`` that reach a lesser (signed) one; root is the least reached."""
    distinct = prints.select("fp").where("fp IS NOT NULL").distinct()
    masks = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for i, m in enumerate(block_masks(radius, blocks))]
    keyed = distinct.select("fp", F.explode(F.array(*masks)).alias("k")).select("k.mask", "k.block", "fp")
    by = ["mask", "block", "lo", "hi"]
    pairs = tiled(keyed, ["mask", "block"], F.xxhash64("fp")).repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, by):
            fp = group.column("fp").to_numpy()
            forest = Forest(len(fp))
            tile_links(fp.view(np.uint64), radius, forest)
            linked = forest.label != np.arange(len(fp))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[forest.label[linked]])], names=["a", "b"])

    return connected_components(map_arrow(pairs.select(*by, "fp"), run, "a long, b long"), "a", "b").withColumnsRenamed({"node": "fp"})


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: component_id is the least id reachable over links of ``radius`` bits.

    Null and blank texts have fingerprint 0 and link like any other. Rows that repeat an id are
    returned as often as they come. An empty table gives an empty result.
    """
    prints = cut_lineage(with_fingerprints(docs, key, text, words))
    roots = fingerprint_components(prints, radius, blocks)
    reps = prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("copies")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    owners = reps.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut_lineage(reps.join(owners, "root").select("fp", "component_id", "copies"))
    return join_counted(prints, classes, ["fp"], "copies").select(F.col("key").alias(key), "fp", "component_id")


def simhash_digest(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` for three words and three bits."""
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return simhash_groups(documents).select("doc_id", hexed, "component_id")


# -- near copies at a similarity ----------------------------------------------------------------

#: Multipliers and offsets of the hash order in which a text's least shingles are taken.
_ORDERS = np.random.default_rng(23).integers(1, 1 << 63, (16, 2), np.uint64) | np.uint64(1)


def least_shingles(hashes: np.ndarray, orders: int) -> list[int]:
    """The least shingle in each of ``orders`` pseudo-random orders: texts of similarity s agree on each with probability s."""
    with np.errstate(over="ignore"):
        return [int((hashes * a + b).min().view(np.int64)) if len(hashes) else 0 for a, b in _ORDERS[:orders]]


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, c1, c2, text``: null counts as the empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), *content_numbers(t), t.alias("text"))


def sketches(texts: DataFrame, words: int, orders: int) -> DataFrame:
    """``key, c1, c2, n, fp, least, tally, fine`` of each row: different shingles, their fingerprint, the least ones, their tallies."""
    names, kind = ["key", *CONTENT, "n", "fp", "least", "tally", "fine"], dict(texts.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(3):
                h = np.unique(shingle_hashes(words_of(value.as_py()), words))  # sets, as in the similarity: a repeated passage has no more votes
                rows.append((len(h), np.uint64(fingerprint(h)).view(np.int64), least_shingles(h, orders), tally_of(h), fine_tally_of(h)))
            n, fp, least, *tallies = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(least, pa.list_(pa.int64())), *(pa.array(t, pa.binary()) for t in tallies)], names=names)

    return map_arrow(texts, run, f"key {kind}, c1 long, c2 long, n int, fp long, least array<long>, tally binary, fine binary")


def _sets(texts: DataFrame, words: int, prefix: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``c1, c2, members``: the shingles of each text, or what ``prefix`` takes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (np.unique(shingle_hashes(words_of(v.as_py()), words).view(np.int64)) for v in batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([prefix(s) if prefix else s for s in sets], pa.list_(pa.int64()))], names=[*CONTENT, "members"])

    return map_arrow(texts.select(*CONTENT, "text"), run, "c1 long, c2 long, members array<long>")


def _suspects(classes: DataFrame, radius: int) -> DataFrame:
    """``order, least, uid, fp`` of texts that share a least shingle with another one within ``radius`` bits."""
    keyed = classes.select("uid", "fp", F.posexplode("least").alias("order", "least"))
    marks = keyed.groupBy("order", "least").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("p"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("q")).where("n > 1")
    # least shingles that the same texts have make one bucket
    different = marks.groupBy("n", "p", "q").agg(F.min(F.struct("order", "least")).alias("k")).select("k.order", "k.least", "n")
    by = ["order", "least", "lo", "hi"]
    pairs = tiled(cut_lineage(join_counted(keyed, cut_lineage(different), by[:2], "n")), by[:2], F.xxhash64("uid")).repartition(*by).sortWithinPartitions(*by).select(*by, "uid", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, by):
            prints = group.column("fp").to_numpy().view(np.uint64)
            order = np.argsort(np.bitwise_count(prints), kind="stable")
            prints = prints[order]
            counts, met = np.bitwise_count(prints).astype(np.int16), np.zeros(len(prints), bool)
            for a in range(0, len(prints), 256):
                for b in range(a, len(prints), 256):
                    if counts[b] - counts[min(a + 256, len(prints)) - 1] > radius:
                        break
                    near = np.bitwise_count(prints[a : a + 256, None] ^ prints[None, b : b + 256]) <= radius
                    if a == b:
                        np.fill_diagonal(near, False)
                    met[a : a + 256] |= near.any(1)
                    met[b : b + 256] |= near.any(0)
            if met.any():
                names = [*by[:2], "uid", "fp"]
                one = group.take(pa.array(order[met]))
                yield pa.RecordBatch.from_arrays([one.column(n).combine_chunks() for n in names], names=names)

    return map_arrow(pairs, run, "order int, least long, uid long, fp long").distinct()


def _sketched_links(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, similar: float, radius: int) -> DataFrame:
    """``a, b``: a spanning forest of the links between texts that the sketches bring together, by exact sets of shingles.

    The texts themselves are shuffled, which are half as large as their sets, and each task makes the sets it needs.
    """
    suspects = cut_lineage(_suspects(classes, radius))
    wanted = classes.join(suspects.select("uid").distinct(), "uid", "left_semi").select(*CONTENT, "uid", "copies")
    texts = texts_of(cut_lineage(wanted))
    by = ["order", "least", "lo", "hi"]
    dealt = tiled(suspects, by[:2], F.xxhash64("uid"), SET_TILE).join(texts, "uid").select(*by, "uid", "fp", "text").repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, by):
            ids, prints, texts = group.column("uid").to_numpy(), group.column("fp").to_numpy().view(np.uint64), group.column("text")
            sets: dict[int, np.ndarray] = {}

            def set_of(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = np.unique(shingle_hashes(words_of(texts[i].as_py()), words))
                return sets[i]

            def alike(i: int, j: int) -> bool:
                a, b = set_of(int(i)), set_of(int(j))
                if min(len(a), len(b)) < similar * max(len(a), len(b)):
                    return False
                both = len(np.intersect1d(a, b, assume_unique=True))
                return both >= similar * (len(a) + len(b) - both)

            forest = Forest(len(ids))
            tile_links(prints, radius, forest, alike)
            linked = forest.label != np.arange(len(ids))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[forest.label[linked]])], names=["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def _classes(docs: DataFrame, key: str, text: str, words: int, similar: float, radius: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``key, c1, c2``, and the different texts as ``c1, c2, copies, least, root``.

    least is the least key of a text, and root (``unkeyed, least, c1, c2``) the first text of its group by that key.
    """
    texts = numbered(docs, key, text)
    rows = cut_lineage(sketches(texts, words, orders))
    classes = rows.groupBy(*CONTENT).agg(F.count("*").alias("copies"), F.min("key").alias("first"), *(F.any_value(c).alias(c) for c in ("n", "fp", "least", "tally", "fine")))
    classes = cut_lineage(classes.withColumn("uid", F.monotonically_increasing_id()))  # lasts, as it is written here
    filled = classes.where("n > 0")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """``uid, c1, c2, text`` of ``wanted`` (``c1, c2, uid, copies``), once each."""
        met = join_counted(texts.select(*CONTENT, "text"), wanted, CONTENT, "copies", few=BROADCAST_KEYS * 4)
        return met.groupBy("uid").agg(*(F.any_value(c).alias(c) for c in (*CONTENT, "text")))  # by uid alone, by which it is joined next

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = cut_lineage(classes.join(ids.withColumnRenamed("rep", "uid"), "uid", "left_semi").select(*CONTENT, "uid", "copies"))
        return _sets(texts_of(wanted), words).join(wanted, CONTENT).select(F.col("uid").alias("rep"), "members")

    links = cut_lineage(_sketched_links(filled, texts_of, words, similar, radius))
    share = max(1, classes.count() // ORDER_ROWS)
    order = member_order(_sets(texts.where(F.pmod("c1", F.lit(share)) == 0).dropDuplicates(CONTENT), words))
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def heads_of(labels: DataFrame) -> DataFrame:
        named = filled.select(*CONTENT, F.col("uid").alias("rep")).join(labels, "rep")
        return _sets(texts, words, lambda s: prefix_of(s, similar, shared.value)).dropDuplicates(CONTENT).join(named, CONTENT).select("rep", "root", "members")

    ids = filled.select(F.col("uid").alias("rep"), "tally", "fine")
    roots = cut_lineage(similar_components(heads_of, sets_of, ids, ids.select("rep"), links, similar))
    blank = classes.where("n = 0").agg(F.min("uid")).first()[0]  # texts without words are one group
    group = F.when(F.col("n") == 0, F.lit(blank)).otherwise(F.coalesce("root", "uid"))
    grouped = cut_lineage(classes.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select(*CONTENT, "copies", "first", group.alias("group")))
    firsts = grouped.groupBy("group").agg(F.min(F.struct(F.col("first").isNull().alias("unkeyed"), "first", *CONTENT)).alias("root"))
    return rows.select("key", *CONTENT), cut_lineage(grouped.join(firsts, "group").select(*CONTENT, "copies", "first", "root"))


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similar: float = 0.8, radius: int = 20, orders: int = 6) -> DataFrame:
    """``key, root`` of every row: root is the least key of its group (null if no row of it has one).

    Two texts link if the Jaccard similarity of their sets of ``words``-word shingles is ``similar`` or
    more. Pairs that share one of ``orders`` least shingles and differ in at most ``radius`` fingerprint
    bits are compared first, which finds nearly all links; every other pair that can be at ``similar``
    then meets by its prefixes (``similar_components``), so that neither gate decides anything. Equal
    texts are one from the start; texts without words, null ones too, are one group. Groups are of texts, so rows that
    share a key can be in several.
    """
    rows, classes = _classes(docs, key, text, words, similar, radius, orders)
    return join_counted(rows, classes.select(*CONTENT, "copies", F.col("root.first").alias("root")), CONTENT, "copies").select("key", "root")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similar: float = 0.8, radius: int = 20, orders: int = 6) -> DataFrame:
    """``docs`` with one row of each group of near copies (``near_copy_groups``): the one with the least key, null last.

    Rows go by their group alone: different texts that share a key all stay. Of rows with the same key
    and text one stays. Texts without words are one group. An empty table gives an empty result.
    """
    rows, classes = _classes(docs, key, text, words, similar, radius, orders)
    mine = F.struct(F.col("first").isNull().alias("unkeyed"), "first", *CONTENT) == F.col("root")
    judged = join_counted(rows, classes.select(*CONTENT, "copies", "first", mine.alias("mine")), CONTENT, "copies")
    kept = F.col("mine") & F.col("key").eqNullSafe(F.col("first"))
    counted = cut_lineage(judged.groupBy("key", *CONTENT).agg(F.count("*").alias("n"), F.bool_and(kept).alias("kept")))
    names = ["__key", "__c1", "__c2"]
    gone, twice = (counted.where(c).select("key", *CONTENT).toDF(*names) for c in ("NOT kept", "kept AND n > 1"))
    n = counted.selectExpr("count_if(NOT kept) AS gone", "count_if(kept AND n > 1) AS twice").first()
    marked = docs.select("*", *(c.alias(n) for c, n in zip(content_numbers(F.coalesce(F.col(text), F.lit(""))), names[1:])))

    def matched(left: DataFrame, right: DataFrame, count: int, how: str) -> DataFrame:
        on = left[key].eqNullSafe(right["__key"]) & (left["__c1"] == right["__c1"]) & (left["__c2"] == right["__c2"])
        return left.join(F.broadcast(right) if count <= 4 * BROADCAST_KEYS else right, on, how)

    left = matched(marked, gone, n["gone"], "left_anti")
    if not n["twice"]:
        return left.select(*docs.columns)
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    order = Window.partitionBy(key, *names[1:]).orderBy(F.xxhash64(*plain))
    first = matched(left, twice, n["twice"], "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    return matched(left, twice, n["twice"], "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
