"""Exact set-similarity links, with what they need: lineage cuts, streamed groups, tiles of buckets, components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a tile: two tiles make a comparison of at most TILE x TILE.
TILE = 2048
#: Rows of a tile whose sets are held as well.
SET_TILE = 256
#: Keys that are broadcast after they were counted; of more, only the hot ones are.
BROADCAST_KEYS = 30_000
#: The same for tables of a single number.
BROADCAST_NUMBERS = 500_000
#: A key is hot if it has more than one of so many rows; there are fewer such keys than this.
HOT_SHARE = 1000
#: Texts and commonest members by which the order of prefixes is chosen.
ORDER_ROWS, ORDER_MEMBERS = 4_000, 200_000
#: Members a bin of a fine tally has on average, at most: unrelated sets then share too few by their tallies to be at 0.8.
FINE = 8


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, after whose last batch the worker returns what it has freed to the system, as workers live on after their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Where neither that setting nor a folder set on
    the context exists, a temporary one is made on a single machine; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner", few: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``; column ``n`` of the table tells how many rows have its key.

    The table has one row a key, is cut from its lineage, and is read a few times. Up to ``few`` rows of it are broadcast.
    Of a larger one only hot keys are, so that none of them gathers in a task, and the rest is
    shuffled; ``how`` is inner or left. Column ``n`` goes.
    """
    size = table.agg(F.count("*").alias("keys"), F.sum(n).alias("rows")).first()
    slim = table.drop(n)
    if size["keys"] <= few:
        return rows.join(F.broadcast(slim), keys, how)
    hot = table.where(F.col(n) * HOT_SHARE > size["rows"]).drop(n)
    if not hot.count():
        return rows.join(slim, keys, how)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(slim, keys, how))


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal ``keys`` in a stream sorted by them.

    Only the group that is open is held in memory; a group may span batches.
    """
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if last is not None and row != last:
                if i > start:
                    held.append(table.slice(start, i - start))
                if held:
                    yield pa.concat_tables(held)
                held, start = [], i
            last = row
        held.append(table.slice(start))
    if held:
        yield pa.concat_tables(held)


def tiled(rows: DataFrame, by: list[str], salt: Column, tile: int = TILE) -> DataFrame:
    """Rows of buckets of two or more, in pairs of tiles ``lo, hi`` of about ``tile`` rows.

    A bucket of n rows has ceil(n / tile) tiles and each row goes to as many pairs, so that no task
    gathers a large bucket.
    """
    sizes = cut_lineage(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")))
    dealt = join_counted(rows, sizes, by, "n").withColumn("tile", F.pmod(salt, F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    return dealt.drop("tile", "other", "tiles")


def _hung(pairs: DataFrame, few: bool) -> DataFrame:
    """``pairs`` with ``m``, the least neighbour of each ``u``. A node with very many neighbours is never gathered in one task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if few:
        return pairs.join(F.broadcast(least.drop("n")), "u")
    return join_counted(pairs, cut_lineage(least), ["u"], "n")


def _star(pairs: DataFrame, larger: bool, few: bool) -> DataFrame:
    """One rewriting step: every node's neighbours are hung on the least node it knows; ``few``: there are few pairs."""
    if larger:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = _hung(both, few).select("u", "v", F.least("u", "m").alias("m"))
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    hung = _hung(pairs, few).select("u", "v", "m")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(hung.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node from which a lesser one can be reached: root is the least reachable.

    ``edges`` may hold repeats, self-links and nulls (both are ignored); roots themselves and
    nodes without a link are not returned. An empty table gives an empty result. Every round is cut with a checkpoint in the shared
    folder. Rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    pairs = cut_lineage(pairs)
    n, mark = pairs.count(), None
    for _ in range(max_rounds):
        few = n <= BROADCAST_KEYS
        pairs = cut_lineage(_star(_star(pairs, True, few), False, few))
        now = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        n = now.n
        if (now.n, now.x) == mark or now.n == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (now.n, now.x)
    raise RuntimeError("components did not settle")


def alike_pairs(reps: np.ndarray, roots: np.ndarray, members: np.ndarray, ends: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """A spanning forest (row numbers) of the links between sets of different roots; set i is ``members[ends[i]:ends[i + 1]]``.

    Rows whose roots are or become connected are not compared.
    """
    sizes = np.diff(ends)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    _, label = np.unique(roots, return_inverse=True)
    _, number = np.unique(members, return_inverse=True)
    marks, out = np.zeros(len(number), bool), []
    for at, i in enumerate(order):
        later = order[at + 1 : np.searchsorted(sizes[order], sizes[i] / similar + 1e-6, "right")]
        later = later[label[later] != label[i]]
        if not len(later):
            continue
        mine = number[ends[i] : ends[i + 1]]
        marks[mine] = True
        n = sizes[later]
        first = np.cumsum(n) - n
        both = np.add.reduceat(marks[number[np.repeat(ends[later] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        marks[mine] = False
        for j in later[both >= similar * (sizes[i] + n - both)]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(i), int(j)))
    return out


def links_in_buckets(buckets: DataFrame, by: list[str], sets: DataFrame, similar: float) -> DataFrame:
    """``a, b``: links of the rows ``by, rep, root`` that share a bucket, each bucket in pairs of tiles; ``sets`` has ``rep, members``."""
    deal, kind = [*by, "lo", "hi"], dict(buckets.dtypes)["rep"]
    dealt = tiled(buckets, by, F.xxhash64("rep"), SET_TILE).join(sets, "rep").repartition(*deal).sortWithinPartitions(*deal).select(*deal, "rep", "root", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, deal):
            lists = group.column("members").combine_chunks()
            reps, roots = (group.column(c).to_numpy() for c in ("rep", "root"))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            found = alike_pairs(reps, roots, lists.flatten().to_numpy(), ends, similar)
            if found:
                i, j = np.array(found).T
                ids = group.column("rep").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j))], names=["a", "b"])

    return dealt.mapInArrow(released(run), f"a {kind}, b {kind}")


def member_order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Members that several sets of a bounded sample (``members``) have, sorted, and how many have them: at most ``ORDER_MEMBERS``, the commonest."""
    seen = sets.select(F.explode("members").alias("member")).groupBy("member").count().where("count > 1")
    often = seen.orderBy(F.desc("count"), "member").limit(ORDER_MEMBERS).toPandas().sort_values("member")
    return often["member"].to_numpy(np.int64), often["count"].to_numpy(np.int64)


def prefix_of(members: np.ndarray, similar: float, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """So many members, in one order for all sets, that any two sets at ``similar`` share one.

    Of n members at least ``similar * n`` must be in the other set too, so the first
    ``n - ceil(similar * n) + 1`` can't all be missing there. The order is free; members that are common
    in a sample come last, so that few sets meet without need.
    """
    common, counts = order
    rank = np.zeros(len(members), np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, members), len(common) - 1)
        rank = np.where(common[place] == members, counts[place], 0)
    least = int(np.ceil(similar * len(members) - 1e-9))
    return members[np.lexsort((members, rank))[: len(members) - least + 1]]


def tally_of(members: np.ndarray, bins: int = 256) -> bytes:
    """How many members (64-bit hashes) have each start of so many bits that there are ``bins`` (a power of two); none if a count is beyond a byte.

    Two sets share at most the sum of the lesser counts.
    """
    counts = np.bincount(members.view(np.uint64) >> np.uint64(65 - bins.bit_length()), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def fine_tally_of(members: np.ndarray) -> bytes:
    """The tally of a set for which 256 bins are too few, as most sets of its size would share enough by them; none for other sets."""
    bins = 256
    while bins * FINE < len(members):
        bins *= 2
    return tally_of(members, bins) if bins > 256 else b""


def _counts(tallies: list[bytes], lengths: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of bins: the places, and the counts in so many bins, of all rows that have as many or more."""
    if lengths.min() == lengths.max():
        return {int(lengths[0]): (np.arange(len(lengths)), np.frombuffer(b"".join(tallies), np.uint8).reshape(len(lengths), -1))}
    out = {}
    for bins in np.unique(lengths):
        held = np.flatnonzero(lengths >= bins)
        place = np.full(len(lengths), -1)
        place[held] = np.arange(len(held))
        out[int(bins)] = place, np.array([np.frombuffer(tallies[i], np.uint8).reshape(bins, -1).sum(1, dtype=np.uint32) for i in held])
    return out


def may_link(tallies: list[bytes], roots: np.ndarray, similar: float) -> np.ndarray:
    """Which rows can, by their tallies, be at ``similar`` with a row of another root; a row without a tally can with any.

    Tallies of different numbers of bins are compared in the lesser number.
    """
    if not all(tallies):
        return np.ones(len(roots), bool)
    lengths = np.array([len(t) for t in tallies])
    counts = _counts(tallies, lengths)
    sizes, met = counts[int(lengths.min())][1].sum(1, dtype=np.int64), np.zeros(len(roots), bool)
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    for at, i in enumerate(order):
        later = order[at + 1 : np.searchsorted(ranked, sizes[i] / similar + 1e-6, "right")]
        later = later[roots[later] != roots[i]]
        if len(later):
            place, bins = counts[int(min(lengths[i], lengths[later].min()))]
            most = np.minimum(bins[place[i]], bins[place[later]]).sum(1, dtype=np.int64)
            fit = later[most >= similar * (sizes[i] + sizes[later] - most) - 1e-9]
            met[fit] = True
            met[i] |= bool(len(fit))
    return met


def promising(buckets: DataFrame, by: list[str], tallies: DataFrame, similar: float, tile: int = TILE) -> DataFrame:
    """The rows ``by, rep, root`` of buckets that can be at ``similar`` with another there, by ``tallies`` (``rep, tally``)."""
    deal, names = [*by, "lo", "hi"], [*by, "rep", "root"]
    dealt = tiled(buckets, by, F.xxhash64("rep"), tile).join(tallies, "rep").repartition(*deal).sortWithinPartitions(*deal).select(*deal, "rep", "root", "tally")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, deal):
            met = may_link(group.column("tally").to_pylist(), group.column("root").to_numpy(), similar)
            if met.any():
                some = group.filter(pa.array(met))
                yield pa.RecordBatch.from_arrays([some.column(n).combine_chunks() for n in names], names=names)

    kinds = dict(buckets.dtypes)
    return dealt.mapInArrow(released(run), ", ".join(f"{n} {kinds[n]}" for n in names)).distinct()


def finest(ids: DataFrame, tallies: DataFrame) -> DataFrame:
    """``rep, tally`` of the ids ``rep`` of a table: of ``tallies`` (``rep, tally, fine``) the fine one, if there is one."""
    ids = cut_lineage(ids.select("rep").distinct())
    few = ids.count() <= BROADCAST_NUMBERS
    best = F.when(F.length("fine") > 0, F.col("fine")).otherwise(F.col("tally"))
    return tallies.join(F.broadcast(ids) if few else ids, "rep", "left_semi").select("rep", best.alias("tally"))


def prefixes(sets: DataFrame, similar: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``rep, members, tally, fine``: of each set (``rep, members``) its prefix (``prefix_of``) and tallies."""
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [one.values.to_numpy() for one in batch.column(1)]
            taken, tallies = [prefix_of(m, similar, shared.value) for m in all_], [pa.array([f(m) for m in all_], pa.binary()) for f in (tally_of, fine_tally_of)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(taken, pa.list_(pa.int64())), *tallies], names=["rep", "members", "tally", "fine"])

    return sets.select("rep", "members").mapInArrow(released(run), f"rep {dict(sets.dtypes)['rep']}, members array<long>, tally binary, fine binary")


def similar_components(heads_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], tallies: DataFrame, chosen: DataFrame, links: DataFrame, similar: float) -> DataFrame:
    """``node, root`` of the graph of all pairs of sets at a Jaccard similarity of ``similar``.

    ``heads_of`` gives ``rep, root, members`` of a table ``rep, root``, members being the prefix of each set, ``sets_of`` gives ``rep, members`` (distinct 64-bit hashes) of the ids ``rep`` of a table,
    and ``tallies`` has ``rep, tally, fine``. Ids that aren't in ``chosen`` (``rep``), such as copies, take no part.
    ``links`` (``a, b``) are some true links found by cheaper means: they save comparisons and decide
    nothing. Every other pair that can be at ``similar`` meets by its prefixes; if tallies allow it, first those of 256 bins
    and then, of the few that are left, the fine ones of large sets, it is compared exactly.
    Empty sets link to none. Members are shuffled once, each with its set's id and root, and those that sets of one root have go at once.
    """
    found = cut_lineage(connected_components(links, "a", "b"))
    labels = chosen.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"))
    known = heads_of(labels).select(F.explode("members").alias("member"), "rep", "root")
    met = Window.partitionBy("member")
    marks = {"x": F.min("root"), "y": F.max("root"), "n": F.count("*"), "p": F.bit_xor(F.xxhash64("rep")), "q": F.bit_xor(F.xxhash64(F.lit(1), "rep"))}
    mixed = cut_lineage(known.withColumns({c: f.over(met) for c, f in marks.items()}).where("x <> y").drop("x", "y"))
    # members that the same sets have make one bucket
    buckets = mixed.join(mixed.groupBy("n", "p", "q").agg(F.min("member").alias("member")).select("member"), "member").select("member", "rep", "root")
    buckets = cut_lineage(promising(cut_lineage(buckets), ["member"], tallies.select("rep", "tally"), similar))
    buckets = cut_lineage(promising(buckets, ["member"], finest(buckets, tallies), similar, SET_TILE))
    wanted = cut_lineage(sets_of(buckets.select("rep").distinct()))
    more = links_in_buckets(buckets, ["member"], wanted, similar)
    return connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b")
