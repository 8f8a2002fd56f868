import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

from millrace.queries import ORACLE, QUERIES  # noqa: E402


def table(df):
    def cell(v):
        return "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_minhash_finds_exact_copies(spark):
    from millrace.operators.documents import minhash_pairs

    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text here now"), (4, None), (5, "")], "doc_id long, text string")
    assert [(r.doc_id, r.near_id) for r in minhash_pairs(df, 0.5).collect()] == [(2, 1)]


def test_minhash_against_brute_force(spark):
    import random

    from millrace.operators.documents import minhash_pairs

    rng = random.Random(11)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(rng.choice([30, 60, 120]))]
        for c in range(6):  # drifting copies: the first is not alike to all, and many are just about 0.8
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 2 + c % 2)):
                base[rng.randrange(len(base))] = f"n{rng.randint(0, 9999)}"
    texts += [texts[0], texts[0].upper(), "one two", "one two", "", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").lower().split())}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    got = {r.doc_id: (r.near_id, r.similarity) for r in minhash_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: r for i, r in root.items() if i != r}
    assert all(s == pytest.approx(len(sets[i] & sets[n]) / len(sets[i] | sets[n])) for i, (n, s) in got.items())


def test_tallies_refuse_no_link():
    import numpy as np

    from millrace.operators.alike import may_link, tally_of

    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 700):
        base = rng.integers(-(1 << 63), 1 << 63, n)
        sets = [base] + [np.unique(np.concatenate([base[k:], rng.integers(-(1 << 63), 1 << 63, j)])) for k, j in ((n // 10, 0), (0, n // 5), (n // 12, n // 12), (n // 2, n // 2))]
        tallies = [tally_of(s) for s in sets]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if i != j and both >= 0.8 * (len(a) + len(b) - both):
                    assert may_link([tallies[i], tallies[j]], np.array([1, 2]), 0.8).all()
        far = rng.integers(-(1 << 63), 1 << 63, 700)
        assert n < 700 or not may_link([tallies[0], tally_of(far)], np.array([1, 2]), 0.8).any()
    assert tally_of(np.zeros(300, np.int64)) == b"" and may_link([b"", tallies[0]], np.array([1, 2]), 0.8).all()


def test_components_of_large_graphs(spark, monkeypatch):
    """The plan for many links, with hot nodes joined apart, gives the same components."""
    from millrace.operators import alike

    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(1, 60)} | {i: 100 for i in range(101, 141)}
    monkeypatch.setattr(alike, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(alike, "HOT_SHARE", 5)
    monkeypatch.setattr(alike, "join_counted", lambda *a, inner=alike.join_counted, **k: inner(*a, few=-1, **k))
    assert {r.node: r.root for r in alike.connected_components(df, "a", "b").collect()} == want


def test_samples_against_the_table(spark, duck):
    """The seeded sample is that of a generator of its own over each language's sorted ids; the hashed one is the first rows by hash."""
    import hashlib
    import random

    from millrace.queries import DRAWN

    docs = duck.sql("select doc_id, lang from documents order by doc_id").fetchall()
    got = sorted((r.lang, r.drawn, r.doc_id) for r in QUERIES["mt19937_sample"](spark, FOLDER).collect())
    want = []
    for lang, n in DRAWN.items():
        ids = [i for i, x in docs if x == lang]
        if n < len(ids):
            ids = random.Random(20260710 + int.from_bytes(hashlib.sha256(f"source:{lang}".encode()).digest()[:8], "big")).sample(ids, n)
        want += [(lang, k, i) for k, i in enumerate(ids)]
    assert got == sorted(want)
    hashes = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id", "lang", "xxhash64(42, doc_id) as h").collect()
    first = {(r.doc_id, r.lang) for r in sorted(hashes, key=lambda r: (r.h, r.doc_id))[:100]}
    assert {tuple(r) for r in QUERIES["ingest_sample"](spark, FOLDER).collect()} == first
