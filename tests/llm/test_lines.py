import hashlib
import os

import pytest

from millrace.llm import common
from millrace.llm import line_templates as lt
from millrace.llm.queries import ORACLE, QUERIES
from millrace.operators import alike

FOLDER = "/root/testdata/sf0.001"


def drop(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in lt.drop_recurring_lines(df, **options).orderBy("doc_id").collect()]


def test_recurring_lines_keep_one_place(spark):
    got = drop(spark, ["shared line one two three\nfirst own words", "second own words\nshared line one two three", "third own text\nshared line one two three\n\nlast"])
    assert sum("shared line" in t for t in got) == 1
    assert all(x in "\n".join(got) for x in ("first own words", "second own words", "third own text", "last"))


def test_variable_fields(spark):
    lines = [f"user logged in as name{n} from host at {i} today ok" for i, n in enumerate("abcdef")]
    assert sum("logged in" in t for t in drop(spark, [f"{x}\nown {i} text {'z' * i}" for i, x in enumerate(lines)], similar=0.5)) == 1


def test_families_in_one_leaf(spark):
    """Three families of lines share token count and leading tokens; each recurs with other words in one place."""
    families = ["see the notes {} this page was written by our staff", "see the notes {} all rights stay with their first owner", "see the notes {} open every day but not on sundays"]
    texts = [f"{f.format('w' + x)}\nown {x} {'xyz'[k]}" for k, f in enumerate(families) for x in "abcdefg"]
    kept = drop(spark, texts)
    assert sum("see the notes" in t for t in kept) == 3
    assert all(t.split("\n")[1] in "\n".join(kept) for t in texts)
    assert sum("see the notes" in t for t in drop(spark, texts, splits=0)) > 3


def test_hot_keys_apart(spark, monkeypatch):
    """Tables too large to broadcast give the same rows, hot keys broadcast and the rest shuffled."""
    texts = [f"one line that stands in each of them\nline {x} that only one of these texts has {x * 2}\n{'and this in some' if i % 3 else 'x' * i}" for i, x in enumerate("abcdefghijkl")]
    want = drop(spark, texts)
    for few, share in ((0, 1000), (0, 3)):
        monkeypatch.setattr(lt, "join_counted", lambda *a, few=few, **k: common.join_counted(*a, **{**k, "few": few}))
        monkeypatch.setattr(alike, "HOT_SHARE", share)
        assert drop(spark, texts) == want


def test_groups_dealt_whole_or_voting(spark, monkeypatch):
    """All groups hot, some and none give the same rows."""
    families = ["see the notes {} this page was written by our staff", "see the notes {} all rights stay with their first owner", "look at it {} now that all is here to see"]
    texts = [f"{f.format('w' + x)}\nown {x} {'xyz'[k]}" for k, f in enumerate(families) for x in "abcdefg"]
    got = []
    for share in (10**9, 3, 0):
        monkeypatch.setattr(alike, "HOT_SHARE", share)
        got.append(drop(spark, texts))
    assert got[0] == got[1] == got[2] and sum("see the notes" in t or "look at it" in t for t in got[0]) == 3


def test_marked_join_is_a_left_join(spark, monkeypatch):
    """With null, repeated and hot keys, keys that share a mark, and an empty table."""
    rows = spark.createDataFrame([(None, None, "n")] * 2 + [(i * 977, i % 3, f"v{i}") for i in range(300)] + [(0, 0, "again")] * 50, "k long, l long, v string")
    table = spark.createDataFrame([(i * 977, i % 3 if i % 2 else 0, 51 if i == 0 else 1, [i]) for i in range(0, 300, 4)] + [(977, 2, 1, [1])], "k long, l long, n long, p array<int>")
    for some in (table, table.limit(0)):
        want = sorted(map(repr, rows.join(some.drop("n"), ["k", "l"], "left").select("k", "l", "v", "p").collect()))
        for words, share in ((lt.WORDS, 1000), (1, 1000), (2, 3), (lt.WORDS, 0)):
            monkeypatch.setattr(lt, "WORDS", words)
            monkeypatch.setattr(alike, "HOT_SHARE", share)
            assert sorted(map(repr, lt.join_marked(rows, some, ["k", "l"], "n").select("k", "l", "v", "p").collect())) == want


def test_texts_that_keep_all_lines_are_not_shuffled(spark):
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    texts = ["".join(hashlib.sha256(b"%d %d" % (i, j)).hexdigest() for j in range(100)) for i in range(100)] + [f"one line that stands in each\n{x}" for x in "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sum("one line" in r.text for r in lt.drop_recurring_lines(df).collect()) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < shuffled() - before < 0.2 * sum(map(len, texts))


def test_unlike_lines_stay(spark):
    texts = ["the big red fox jumps over some lazy dogs", "the big red house stands near our old river"]
    assert drop(spark, texts) == texts


def test_copies_count_once(spark):
    assert drop(spark, ["only this line here\nand that one"] * 3) == ["only this line here\nand that one"] * 3


def test_odd_rows(odd_docs, no_docs):
    out = lt.drop_recurring_lines(odd_docs.withColumnRenamed("n_chars", "n_lines"), counts=True)
    rows = out.collect()
    assert len(rows) == 11 and sum(r.text is None for r in rows) == 1 and {r.n_dropped for r in rows} == {0}
    assert lt.drop_recurring_lines(no_docs).count() == 0
    assert lt.drop_recurring_lines(odd_docs).columns == odd_docs.columns


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    want = sorted(map(tuple, c.sql(f"select doc_id, text, n_lines, n_dropped from ({ORACLE['op3_line_dedup']})").fetchall()))
    assert sorted(map(tuple, QUERIES["op3_line_dedup"](spark, FOLDER).select("doc_id", "text", "n_lines", "n_dropped").collect())) == want
