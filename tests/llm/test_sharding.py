import zlib

from millrace.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_against_the_published_loop(spark):
    ids = [*range(300), -1, -5, 2**63 - 1, -(2**63), 12345678901]
    df = spark.createDataFrame([(i, f"text é {i % 7}") for i in ids], "doc_id long, text string")
    rows = sharding.shard_digest(df).collect()
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id % (1 << 64), 8), jump(r.doc_id % (1 << 64), 9)) for r in rows)
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert all(r.size == len(f"text é {r.doc_id % 7}".encode()) + 1 and r.text_crc32 == zlib.crc32(f"text é {r.doc_id % 7}".encode()) for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_odd_rows(odd_docs, no_docs):
    clash = odd_docs.withColumnRenamed("n_chars", "shard")
    rows = sharding.assign_shards(clash).collect()
    assert len(rows) == 11 and {r["size"] for r in rows if r.text is None} == {1}
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(no_docs).count() == 0


def test_text_keys(spark):
    df = spark.createDataFrame([(f"k{i}", "x") for i in range(50)], "doc_id string, text string")
    assert {r.shard for r in sharding.assign_shards(df).collect()} <= set(range(8))


def test_hot_ids_are_spread_over_chunks(spark):
    """Ids with a common step, and texts without an id, don't meet in one chunk; every slot is still given once."""
    steps = [(i * 1024, "same") for i in range(600)]
    df = spark.createDataFrame(steps + [(None, f"text {i}") for i in range(600)], "doc_id long, text string")
    rows = sharding.shard_digest(df).collect()
    for s in range(8):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [r.doc_id for r in mine if r.doc_id is not None]
        assert len(ids) < 20 or ids != sorted(ids)  # they were one chunk, in order of ids
