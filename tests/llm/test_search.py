import random

import numpy as np
import pytest

from millrace.llm import ann, decontaminate


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:900] = x[0]  # one very common vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.neighbour_digest(df).collect()
    exact = x.astype(float) @ x.astype(float).T
    found = {}
    for r in got:
        assert r.score == pytest.approx(exact[r.query_id, r.vec_id], rel=1e-12) and r.vec_id != r.query_id
        found.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    hits = 0
    for q in range(0, 1500, 20):
        rows = sorted(found[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        hits += len({r[2] for r in rows} & set(order))
    assert hits / (75 * 20) >= 0.9
    assert [r[2] for r in sorted(found[0])] == list(range(700, 720))  # ties go to the smaller id


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (20, [2.0, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbour_digest(df).orderBy("query_id", "rank").collect()]
    # a shorter vector takes part: only null, zero and non-finite ones don't
    assert got == [(0, 1, 20, 2.0), (0, 2, 7, 1.0), (0, 3, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 7, 2.0), (20, 3, 1, 1.5)]
    assert ann.neighbour_digest(df.limit(0)).count() == 0


def brute_leaks(text, items, n=5, threshold=0.8):
    """Every window of every item's size, without fingerprints."""
    index = decontaminate.build_index(items, n, 64, threshold)
    words = decontaminate.words_of(text)
    full = np.array([decontaminate.word_hash(w) for w in words], np.uint64)
    out = {}
    for k, i in enumerate(index.ids):
        size = int(index.sizes[k])
        for at in range(len(words) - size + 1):
            window = decontaminate.shingles(full[at : at + size], min(n, size))
            s = decontaminate.similarity(decontaminate.Counter(window.tolist()), index.counts[k], index.by_shingle, index.rare)
            if s >= threshold:
                out[i] = max(out.get(i, 0), s)
    return out


def leak_case():
    rng = random.Random(8)
    items = [(i, " ".join(f"b{rng.randint(0, 150)}" for _ in range(rng.choice([3, 12, 30, 50])))) for i in range(25)] + [(99, "?!"), (98, None), (None, "b1 b2")]
    texts = []
    for k in range(60):
        words = [f"b{rng.randint(0, 150)}" for _ in range(80)]
        if k % 2:
            leak = items[rng.randrange(25)][1].split()
            if k % 4 == 1:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(80)
            words[at:at] = [w.upper() + "," for w in leak]
        texts.append((k, " ".join(words)))
    return items, texts


def test_leaks_against_brute_force(spark):
    items, texts = leak_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(k, i): s for k, t in texts for i, s in brute_leaks(t, [(i, t) for i, t in items if t and i is not None]).items()}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == pytest.approx(want) and len(want) >= 15
    for options in ({"block_bytes": 600}, {"radius": 63}):
        assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, bench, **options).collect()} == pytest.approx(want)
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench, block_bytes=600).collect()} == {k for k, _ in texts} - {k for k, _ in want}
    left = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert left == {k for k, _ in texts} - {k for k, _ in want}


def test_blocks_find_all_within_the_radius():
    rng = random.Random(5)
    index = decontaminate.build_index([(i, " ".join(f"x{rng.randint(0, 999)}" for _ in range(20))) for i in range(60)], 5, 16, 0.8)
    for _ in range(200):
        p = int(index.prints[rng.randrange(60)])
        for b in rng.sample(range(64), rng.randint(0, 20)):
            p ^= 1 << b
        assert index.near(p).tolist() == [k for k in range(60) if (int(index.prints[k]) ^ p).bit_count() <= 16]


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "same words here now"), (2, "word5x0 word6x0 word7x0 word8x0 word9x0 word10x0"), (3, ""), (4, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd_docs.withColumnRenamed("n_chars", "words"), bench).collect())
    assert got == [(4, 1), (5, 1), (5, 1), (6, 2), (7, 2)]
    assert decontaminate.find_leaks(no_docs, bench).count() == 0 and decontaminate.find_leaks(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd_docs, bench).columns == odd_docs.columns


def test_texts_shorter_than_the_item(spark):
    words = [f"b{i}" for i in range(50)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "some other item of eight words is here")], "item_id long, text string")
    texts = [" ".join(words[:48]), " ".join(words[1:]), " ".join(words[4:46]), " ".join(words[:30]), "some other item of eight words is", "b1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.words) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(0, 1): (pytest.approx(44 / 46), 0, 48), (1, 1): (pytest.approx(45 / 46), 0, 49), (2, 1): (pytest.approx(38 / 46), 0, 42)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {3, 4, 5}


def test_blocks_change_no_similarity(spark):
    items, texts = leak_case()
    common = [f"c{i}" for i in range(14)]  # a passage of every second item
    items = [(i, f"{t} {' '.join(common)}" if t and i is not None and i % 2 else t) for i, t in items]
    texts += [(100 + i, f"{t} {' '.join(common[:10])} end") for i, t in items if t and i is not None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = [{(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, bench, block_bytes=n, threshold=0.5).collect()} for n in (1 << 24, 2000, 600)]
    assert len(found[0]) >= 15 and found[1] == pytest.approx(found[0]) and found[2] == pytest.approx(found[0])


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40] = x[41] = x[20] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[40]] * 60 + [(77, (x[20] * (2 + n / 100)).tolist()) for n in range(40)]  # a repeated row; an id of many vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbour_digest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    best = {}
    for i, a in rows:
        for j, b in rows:
            if i % 20 == 0 and i != j:
                best[i, j] = max(best.get((i, j), -np.inf), float(np.asarray(a, float) @ np.asarray(b, float)))
    for q in range(0, 300, 20):
        assert [v for _, v in sorted(got[q])] == sorted((j for i, j in best if i == q), key=lambda j: (-best[q, j], j))[:20]


def test_lengths_and_other_columns(spark):
    """Shorter vectors count as filled with zeros, and columns named like the answer's don't matter."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3 + i % 4).tolist(), i, 0.5) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long, score double")
    long = {i: np.concatenate([v, np.zeros(6 - len(v))]) for i, v, *_ in rows}
    got = {}
    for r in ann.neighbour_digest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40]
    for q, found in got.items():
        want = sorted((j for j in long if j != q), key=lambda j: (-(long[q] @ long[j]), j))[:20]
        assert [v for _, v, _ in sorted(found)] == want
        assert [x for *_, x in sorted(found)] == pytest.approx([long[q] @ long[j] for j in want])
