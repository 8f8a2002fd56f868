import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import near_dedup
from millrace.llm.simhash import bit_counts
from millrace.operators import alike


def brute_print(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_bit_counts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64)
    assert bit_counts(h).tolist() == [int(((h >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(64)]


def test_digest_against_brute_force(spark):
    rng = random.Random(3)
    texts = {}
    for i in range(60):
        base = [f"w{rng.randint(0, 40)}" for _ in range(rng.choice([0, 1, 2, 3, 8, 300]))]
        texts[i * 2] = " ".join(base)
        texts[i * 2 + 1] = " ".join([*base, "x"] if rng.random() < 0.5 else base).upper()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_dedup.simhash_digest(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    roots = brute_components(prints, 3)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in texts}


def test_chains_of_links(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 62, 6, np.uint64)
    prints = []
    for s in seeds:
        x = int(s)
        for _ in range(20):
            prints.append(x)
            for b in rng.choice(64, 3, replace=False):
                x ^= 1 << int(b)
    df = spark.createDataFrame([(near_dedup._signed(x),) for x in prints], "fp long")
    roots = {r.fp: r.root for r in near_dedup.fingerprint_components(df).collect()}
    want = brute_components(dict(enumerate(prints)), 3)
    groups = {}
    for i, r in want.items():
        groups.setdefault(r, set()).add(near_dedup._signed(prints[i]))
    for g in groups.values():
        assert len(g) == 1 or {roots.get(x, x) for x in g} == {min(g)}


def test_large_buckets_are_dealt_to_tile_pairs(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (2, 98), (3, 97)], "k int, v long")
    met = {}
    for r in near_dedup.tiled(rows, ["k"], F.xxhash64("v"), 10).collect():
        met.setdefault((r.k, r.lo, r.hi), set()).add(r.v)
    assert {(a, b) for (k, *_), g in met.items() if k == 1 for a in g for b in g} == {(a, b) for a in range(50) for b in range(50)}
    assert len(met) == 16 and met[2, 0, 0] == {98, 99} and max(len(g) for g in met.values()) < 40


def test_odd_rows(odd_docs, no_docs):
    rows = near_dedup.simhash_digest(odd_docs.where("doc_id IS NOT NULL").withColumnRenamed("n_chars", "fp")).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == 10 and got[2] == got[3] == 1 and got[5] == 4 and got[9] == 9
    assert near_dedup.simhash_digest(no_docs).count() == 0


def texts_with_copies():
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"t{rng.randint(0, 5000)}" for _ in range(200)]
        for c in range(4):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(200)] = f"n{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(f"u{rng.randint(0, 9000)}" for _ in range(80))) for i in range(20)]
    return rows


def test_near_copies_against_brute_force(spark):
    rows = texts_with_copies()
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.key: r.root for r in near_dedup.near_copy_groups(df).collect()}
    assert got == {i: find(i) for i in sets}
    kept = sorted(r.doc_id for r in near_dedup.drop_near_copies(df).collect())
    assert kept == sorted({find(i) for i in sets})


def test_dropping_odd_rows(odd_docs, no_docs):
    left = near_dedup.drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "6", "8", "9", "None"]
    assert near_dedup.drop_near_copies(no_docs).count() == 0


def test_rows_go_by_group_not_by_id(spark):
    """Ids repeat: different texts stay, and of equal rows one; a null id comes last in its group."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, b, "z"), (1, a, "w"), (None, a, "v"), (None, "no one else has these words", "u")]
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", a), ("1", b), ("None", rows[-1][1])])


def test_near_copies_with_repeated_lines_against_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for _ in range(60):
        lines = [" ".join(f"r{rng.randint(0, 9999)}" for _ in range(12)) for _ in range(9)]
        rows.append((len(rows), "\n".join(lines)))
        often = list(lines)
        often[4:5] = [lines[4]] * 50  # the line's shingles outnumber all others; few are new
        rows.append((len(rows), "\n".join(often)))
        w = " ".join(lines).split()
        for k in rng.sample(range(5, len(w) - 5), 2):
            w[k] = f"n{rng.randint(0, 9999)}"
        rows.append((len(rows), " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"orders": 1, "radius": 3}):  # what the gates refuse is found all the same
        assert {r.key: r.root for r in near_dedup.near_copy_groups(df, **options).collect()} == root


def test_fine_tallies_refuse_large_sets_and_lose_no_link():
    rng = np.random.default_rng(8)
    roots = np.array([1, 2])
    for n in (2048, 2049, 5000, 20_000, 70_000):
        one = rng.integers(-(1 << 63), 1 << 63, n, np.int64)
        far = rng.integers(-(1 << 63), 1 << 63, n, np.int64)
        near = np.concatenate([one[: -(n // 10)], far[: n // 10]])  # 0.9 n of 1.1 n: about 0.82
        part = one[: -(n // 5)]  # 0.8
        best = [alike.fine_tally_of(s) or alike.tally_of(s) for s in (one, far, near, part)]
        assert not alike.may_link([best[0], best[1]], roots, 0.8).any()
        for i in (2, 3):  # part may have half as many bins
            assert alike.may_link([best[0], best[i]], roots, 0.8).all() and alike.may_link([best[i], best[0]], roots, 0.8).all()
        assert alike.may_link([best[0], best[2], alike.tally_of(one[:1000])], np.array([1, 2, 3]), 0.8).tolist() == [True, True, False]
    assert alike.fine_tally_of(np.arange(2048)) == b""


def test_large_sets_that_meet_by_chance_are_not_shuffled(spark):
    rng = np.random.default_rng(11)
    sets = [np.append(rng.integers(-(1 << 62), 1 << 62, 5999, np.int64), -(1 << 63)) for _ in range(12)]  # the shared member is in all prefixes
    sets.append(np.concatenate([sets[0][500:], rng.integers(-(1 << 62), 1 << 62, 500, np.int64)]))
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "rep long, members array<long>").localCheckpoint()
    heads = alike.prefixes(rows, 0.8, (np.empty(0, np.int64), np.empty(0, np.int64))).localCheckpoint()
    asked = []

    def sets_of(ids):
        asked.append({r.rep for r in ids.collect()})
        return rows.join(ids, "rep", "left_semi")

    none = spark.createDataFrame([], "a long, b long")
    got = alike.similar_components(lambda labels: heads.join(labels, "rep"), sets_of, heads.drop("members"), rows.select("rep"), none, 0.8).collect()
    assert [(r.node, r.root) for r in got] == [(12, 0)]
    assert asked == [{0, 12}]
