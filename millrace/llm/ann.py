"""Approximate nearest neighbours by balanced posting lists.

Centroids of a bounded sample head the lists; every vector goes to its nearest list, and one near a
border also to other lists about as near. A query finds lists by walking a graph of centroids held in
memory and leaves out those whose distance exceeds the nearest one's by more than a ratio. Lists are
then scanned exactly. Inner products become distances by one more coordinate that gives all rows the
same length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, least_by_hash, map_arrow, stream_groups

#: Rows of a cell: a list longer than this, or more queries than this for a list, are dealt to several cells.
LIST_ROWS, QUERY_ROWS = 4096, 1024


@dataclass(frozen=True)
class Lists:
    centroids: np.ndarray  # with the added coordinate
    graph: np.ndarray  # neighbours of each centroid
    longest: float  # of the vectors; gives the added coordinate


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """With a coordinate that makes every length ``longest``: then nearer means a larger inner product."""
    rest = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(1), 0))
    return np.hstack([vectors, rest[:, None]])


def balanced_centroids(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means whose assignment pays for the size of a cluster, so that no list draws most of the rows."""
    rng = np.random.default_rng(seed)
    length = np.linalg.norm(points[0])  # of all of them: they are lifted
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        d = _squared(points, centres)
        owner = (d + load[None, :] * d.min(1).mean()).argmin(1)
        sizes = np.bincount(owner, minlength=k)
        load = np.maximum(load + 0.3 * (sizes * k / len(points) - 1), 0)
        for j in range(k):
            mine = points[owner == j]
            mean = mine.mean(0) if len(mine) else points[rng.integers(len(points))]
            # on the sphere of the points: else a large cluster's short mean would be near to everything
            centres[j] = mean * (length / max(np.linalg.norm(mean), 1e-300))
    return centres


def fit_lists(vectors: np.ndarray, longest: float, rows: int, list_rows: int = 500, degree: int = 16) -> Lists:
    """Lists for ``rows`` rows from a sample: about one for ``list_rows`` rows, at most one for 4 of the sample."""
    points = lifted(vectors, longest)
    k = int(max(1, min(-(-rows // list_rows), len(points) // 4)))
    centres = balanced_centroids(points, k) if len(points) else np.zeros((1, vectors.shape[1] + 1))
    d = _squared(centres, centres)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(degree, k - 1)]
    # a few far links keep the graph connected
    links = np.stack([(np.arange(k) + s) % k for s in (1, max(1, k // 2), max(1, int(k**0.5)))], axis=1)
    return Lists(centres, np.hstack([near, links]), longest)


def walk(lists: Lists, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest centroids met by best-first search of the graph, nearest first, with squared distances."""
    centres, graph = lists.centroids, lists.graph

    def away(ids: np.ndarray) -> np.ndarray:
        return ((centres[ids] - query) ** 2).sum(1)

    begin = np.unique(np.linspace(0, len(centres) - 1, min(8, len(centres))).astype(int))
    seen = np.zeros(len(centres), bool)
    seen[begin] = True
    open_ = [(float(d), int(i)) for d, i in zip(away(begin), begin)]
    heapq.heapify(open_)
    kept = sorted(open_)[:width]
    while open_:
        d, i = heapq.heappop(open_)
        if len(kept) == width and d > kept[-1][0]:
            break
        new = np.unique(graph[i])
        new = new[~seen[new]]
        seen[new] = True
        for e, j in zip(away(new), new):
            if len(kept) < width or e < kept[-1][0]:
                heapq.heappush(open_, (float(e), int(j)))
                kept = sorted([*kept, (float(e), int(j))])[:width]
    return np.array([i for _, i in kept]), np.array([d for d, _ in kept])


def usable(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of rows whose vector is finite and not zero; shorter vectors are filled with zeros to the longest one's length."""
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    n = F.size("vector")
    sizes = rows.agg(F.min(n).alias("least"), F.max(n).alias("most")).first()
    if sizes.least == sizes.most:
        return rows
    return rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(sizes.most) - n)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_vectors(
    rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", column: str = "embedding", sample: int = 8192, share: float = 0.4, least: int = 32, query_ratio: float = 1.45, border_ratio: float = 1.05, copies: int = 3, first: int = 8
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` rows of largest inner product found, but its own id.

    score is the inner product of the vectors as given, in double precision, components that a shorter one
    lacks counting as zero; ties go to the smaller id, and an id is listed once. Vectors that are null, zero, or hold null or non-finite components take no
    part. Fewer candidates than ``k`` are all
    returned; an empty table gives an empty result.

    The lists are fitted on at most ``sample`` rows; all rows are indexed. Of rows with the same vector
    only the ``k + 1`` smallest ids can be among anyone's nearest, so only they are indexed. Lists and
    their queries are dealt to cells of bounded size. ``border_ratio`` and ``copies`` bound the other
    lists a vector also goes to. A query looks at the lists within ``query_ratio`` of its nearest one's
    distance, at most a ``share`` of all lists or ``least``: vectors without structure need so many,
    with structure the ratio leaves few.
    A query's ``first`` lists are scanned before the others, which then give only what is better than
    the k-th found so far.
    """
    fine = cut_lineage(usable(rows, key, column).distinct())
    same = Window.partitionBy("vector").orderBy("vec_id")
    kept = fine.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    facts = fine.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    chosen = least_by_hash(fine, "vec_id", sample).select("vector").toPandas()["vector"]
    points = np.stack([np.asarray(v, np.float64) for v in chosen]) if len(chosen) else np.zeros((0, 1))
    lists = fit_lists(points, float(facts.longest or 0), facts.n)
    shared = rows.sparkSession.sparkContext.broadcast(lists)  # at most sample / 4 centroids

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            d = np.sqrt(_squared(lifted(matrix(batch.column(1)), known.longest), known.centroids))
            near = np.argsort(d, axis=1, kind="stable")[:, : copies + 1]
            far = np.take_along_axis(d, near, 1)
            row, col = np.nonzero(far <= border_ratio * far[:, :1] + 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(near[row, col].astype(np.int32)), *(c.take(pa.array(row)) for c in batch.columns)], names=["list", "vec_id", "vector"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            vectors = matrix(batch.column(1))
            # the query's own length doesn't matter to the order of inner products
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            points = np.hstack([vectors / norms * known.longest, np.zeros((len(vectors), 1))])
            row, col, nth = [], [], []
            for i, point in enumerate(points):
                ids, d = walk(known, point, max(least, int(share * len(known.centroids))))
                ids = ids[np.sqrt(d) <= query_ratio * np.sqrt(d[0]) + 1e-12]
                row += [i] * len(ids)
                col += ids.tolist()
                nth += range(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.int32()), pa.array(nth, pa.int32()), *(c.take(pa.array(row, pa.int64())) for c in batch.columns)], names=["list", "nth", "vec_id", "vector"])

    posted = cut_lineage(map_arrow(kept, post, "list int, vec_id long, vector array<double>"))
    looks = cut_lineage(map_arrow(fine.where(is_query(F.col("vec_id"))), look, "list int, nth int, vec_id long, vector array<double>"))
    # one row for each list: bounded by the sample
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))

    def spread(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def scanned(asking: DataFrame) -> DataFrame:
        """Lists and the queries (``list, vec_id, vector, bound``) that look at them, met in cells."""
        asked = asking.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        cells = F.broadcast(sizes.join(asked, "list"))
        part, block = F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block")
        left = posted.join(cells, "list").select("list", part, spread("blocks").alias("block"), F.lit(False).alias("asks"), "vec_id", "vector", F.lit(0.0).alias("bound"))
        right = asking.join(cells, "list").select("list", spread("parts").alias("part"), block, F.lit(True).alias("asks"), "vec_id", "vector", "bound")
        dealt = left.union(right).repartition(*by).sortWithinPartitions(*by)
        return map_arrow(dealt, scan, "query_id long, vec_id long, score double")

    by = ["list", "part", "block"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in stream_groups(batches, by):
            asks = cell.column("asks").to_numpy()
            ids, vectors = cell.column("vec_id").to_numpy(), matrix(cell.column("vector"))
            (q, x), (qid, xid) = (vectors[asks], vectors[~asks]), (ids[asks], ids[~asks])
            if not len(q) or not len(x):
                continue
            rough = q @ x.T
            slack = 1e-9 * np.abs(rough).max()
            # an id may have several vectors: so many rows hold k + 1 different ids
            need = min((k + 1) * int(np.unique(xid, return_counts=True)[1].max()), len(x))
            least = np.maximum(np.partition(rough, len(x) - need, axis=1)[:, len(x) - need], cell.column("bound").to_numpy()[asks])
            i, j = np.nonzero(rough >= (least - slack)[:, None])
            i, j = i[qid[i] != xid[j]], j[qid[i] != xid[j]]
            score = np.einsum("ij,ij->i", q[i], x[j])  # the same for equal vectors, wherever they stand
            order = np.lexsort((xid[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            _, best_of = np.unique(np.stack([qid[i], xid[j]]), axis=1, return_index=True)  # the first of an id is its best
            best_of.sort()
            i, j, score = i[best_of], j[best_of], score[best_of]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = place < k
            yield pa.RecordBatch.from_arrays([pa.array(qid[i[best]]), pa.array(xid[j[best]]), pa.array(score[best])], names=["query_id", "vec_id", "score"])

    # an id in several lists, or with several vectors, counts once, with its best score
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    early = cut_lineage(best(scanned(looks.where(F.col("nth") < first).select("list", "vec_id", "vector", F.lit(float("-inf")).alias("bound")))))
    bounds = early.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf")).alias("bound"))
    late = looks.where(F.col("nth") >= first).join(bounds, "vec_id", "left").select("list", "vec_id", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    return best(early.select("query_id", "vec_id", "score").union(scanned(late))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbour_digest(embeddings: DataFrame) -> DataFrame:
    return nearest_vectors(embeddings, lambda vec_id: vec_id % 20 == 0)
