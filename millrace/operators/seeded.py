"""Seeded samples and shuffles in the order that CPython's generator gives, for runs that must repeat an earlier selection.

The positions of a sample depend only on the number of rows and on the seed, so the driver draws
positions, as many as were asked for, and rows are numbered and met on the cluster. Where no earlier
selection has to be repeated, the hash order of ``mixture`` needs no numbering.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alike import cut_lineage


def generator(seed: int, salt: str) -> random.Random:
    """A generator of ``seed`` plus the first 64 bits, big-endian, of the salt's SHA-256."""
    return random.Random(seed + int.from_bytes(hashlib.sha256(salt.encode()).digest()[:8], "big"))


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Adds ``nth``: a row's place from 0 within its group of ``by`` in ``order``, ties in any order.

    Rows are sorted by ranges and numbered partition by partition, so that no task holds a group; what is
    broadcast has a row for each partition and group that meet. Null orders come first; an empty table
    gives an empty result.
    """
    laid = cut_lineage(df.repartitionByRange(F.col(by), *order).sortWithinPartitions(by, *order).withColumn("__at", F.monotonically_increasing_id()))
    runs = laid.groupBy(F.col(by).alias("__by"), F.shiftright("__at", 33).alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    earlier = "coalesce(sum(__rows) over (partition by __by order by __part rows between unbounded preceding and 1 preceding), 0)"
    starts = runs.withColumn("__before", F.expr(earlier)).drop("__rows")
    met = laid.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("__by")) & (F.shiftright("__at", 33) == F.col("__part")))
    return met.select(*df.columns, (F.col("__before") + F.col("__at") - F.col("__first")).cast("long").alias("nth"))


def seeded_sample(df: DataFrame, targets: Mapping[str, int], seed: int, salt: str, by: str = "source_dataset", order: tuple[str, ...] = ("id",), whole: bool = False) -> DataFrame:
    """``targets[group]`` rows of each group of ``by``, drawn without replacement; adds ``drawn``, the place in the draw from 0.

    ``salt`` holds ``{}`` for the group's name. A group with fewer rows than its target is an error, or, with
    ``whole``, taken whole in its own order. Groups without a target are left out. Targets bound what the
    driver draws and what is broadcast.
    """
    rows = numbered(df.where(F.col(by).isin(*targets)), by, *order)
    have = {r[0]: r[1] for r in rows.groupBy(by).agg(F.count("*")).collect()}  # at most one row for each target
    picks: list[tuple[str, int, int]] = []
    for name, n in sorted(targets.items()):
        size = have.get(name, 0)
        if n > size and not whole:
            raise ValueError(f"{name}: {n} rows asked for, {size} there")
        places = range(size) if n >= size and whole else generator(seed, salt.format(name)).sample(range(size), n)
        picks += [(name, place, k) for k, place in enumerate(places)]
    drawn = df.sparkSession.createDataFrame(picks, f"`{by}` string, nth long, drawn long")
    return rows.join(F.broadcast(drawn), [by, "nth"]).select(*df.columns, "drawn")


def seeded_shuffle(df: DataFrame, seed: int, salt: str, *order: str) -> DataFrame:
    """Adds ``position``: where each row of ``df``, taken in ``order``, stands after a seeded shuffle.

    The driver holds the permutation, a number a row: for selections of a configured size. Data of any
    size go in the hash order of ``mixture.shuffled_shards``.
    """
    rows = numbered(df.withColumn("__all", F.lit(0)), "__all", *order).drop("__all")
    places = list(range(df.count()))
    generator(seed, salt).shuffle(places)
    moved = df.sparkSession.createDataFrame([(place, k) for k, place in enumerate(places)], "nth long, position long")
    return rows.join(moved, "nth").select(*df.columns, "position")
