"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions alone.

The law that holds is ``key``: a row's id and the number of shards decide its shard, and one more
shard only takes rows into itself. No ring table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

#: Fixed values of the published algorithm: the multiplier of its generator, and 2**64, 2**33, 2**31.
MULTIPLIER = "2862933555777941757"
WORD, SHIFT, SPAN = "18446744073709551616", "8589934592", "2147483648"


def stable_key(df: DataFrame, column: str) -> Column:
    """An unsigned 64-bit key as decimal(20,0): whole numbers themselves, other types their xxhash64; null counts as 0."""
    whole = isinstance(df.schema[column].dataType, (ByteType, ShortType, IntegerType, LongType))
    value = F.col(column).cast("long") if whole else F.when(F.col(column).isNotNull(), F.xxhash64(column))
    value = F.coalesce(value, F.lit(0)).cast("decimal(20,0)")
    return F.when(value < 0, value + F.lit(WORD).cast("decimal(20,0)")).otherwise(value).cast("decimal(20,0)")


def advance(k: Column) -> Column:
    """One step of the generator. Products reach 2**64 times the multiplier, below 10**38, so decimal(38,0) is exact."""
    k = ((k * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1)).cast("decimal(38,0)") % F.lit(WORD).cast("decimal(20,0)")
    return k.cast("decimal(38,0)")


def high_part(k: Column) -> Column:
    """The upper 31 of 64 bits, a whole double."""
    low = k % F.lit(SHIFT).cast("decimal(10,0)")
    return ((k - low) / F.lit(SHIFT).cast("decimal(10,0)")).cast("double")  # a whole quotient: exact


def jump_hash(key: Column, shards: int) -> Column:
    """The bucket of ``key`` (decimal, 0 to 2**64 - 1) among ``shards``: at most ``shards`` jumps, each forward."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    start = F.struct(key.cast("decimal(38,0)").alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        k = advance(s["k"])
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(SPAN)) / (high_part(k) + 1.0))).cast("long")
        done = s["j"] >= shards
        return F.struct(F.when(done, s["k"]).otherwise(k).alias("k"), F.when(done, s["b"]).otherwise(s["j"]).alias("b"), F.when(done, s["j"]).otherwise(j).alias("j"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump, lambda s: s["b"]).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, chunks: int = 1024) -> DataFrame:
    """Every row of ``df`` with ``size, text_crc32, law, shard, slot, grown_shard`` in place of such columns of its own.

    size: UTF-8 bytes of the text (null: none) plus 1. slot: gapless from 0 within a shard, by chunk,
    then by key and text checksum, ties in any order. A chunk is the key's hash plus the text's
    checksum, modulo ``chunks``, so that neither ids with a common step nor many texts under one id
    (or under none) meet in a chunk; rows equal in both do. Ranks are taken in ``shards * chunks``
    groups and shifted by the counts before them; that table of counts is bounded by the two
    parameters and is the only thing broadcast, so no task ever holds a whole shard. Repeated rows each
    get a slot; a null key counts as 0; an empty table gives an empty result.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in df.columns if c not in added]
    bytes_of = F.coalesce(F.col(text), F.lit("")).cast("binary")
    number = stable_key(df, key)
    shard = jump_hash(number, shards).alias("shard")
    chunk = F.pmod(high_part(advance(number.cast("decimal(38,0)"))).cast("long") + F.crc32(bytes_of), F.lit(chunks)).cast("int").alias("__chunk")
    placed = df.select(
        *kept,
        (F.octet_length(bytes_of).cast("long") + 1).alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard,
        jump_hash(number, shards + 1).alias("grown_shard"),
        chunk,
        number.alias("__key"),
    )
    counts = df.select(shard, chunk).groupBy("shard", "__chunk").count()
    sizes = counts.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("__chunk", "count"))).alias("m"))
    before = sizes.select(
        "shard",
        F.posexplode(F.expr(f"aggregate(sequence(0, {chunks - 1}), array(0L), (a, c) -> array_append(a, element_at(a, -1) + coalesce(m[c], 0L)))")).alias("__chunk", "__before"),
    )
    ranked = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, __chunk ORDER BY __key, text_crc32) - 1 AS __rank")
    joined = ranked.join(F.broadcast(before), ["shard", "__chunk"])
    return joined.select(*kept, "size", "text_crc32", "law", "shard", (F.col("__before") + F.col("__rank")).cast("long").alias("slot"), "grown_shard")


def shard_digest(documents: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of ``assign_shards``: ids, sizes, checksums and places, without the texts."""
    slim = documents.select("doc_id", "text")
    return assign_shards(slim, "doc_id", "text", shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: DuckDB SQL for ``shard_digest`` with its default parameters: the checksum byte by byte, the jumps by recursion.
ORACLE = r"""WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k FROM documents),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM docs, tbl),
jumps AS (SELECT r, n, k, -1::BIGINT AS b, 0::BIGINT AS j FROM docs, (VALUES (8), (9)) v(n)
 UNION ALL
 SELECT r, n, k1, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k1 // 8589934592)::DOUBLE + 1)))::BIGINT FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k1 FROM jumps WHERE j < n)),
placed AS (SELECT r, max(b) FILTER (n = 8 AND j >= 8)::INT AS shard, max(b) FILTER (n = 9 AND j >= 9)::INT AS grown_shard FROM jumps GROUP BY r)
SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ((k * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592 + text_crc32) % 1024, k, text_crc32) - 1 AS slot, grown_shard
FROM docs JOIN crc USING (r) JOIN placed USING (r)
"""
