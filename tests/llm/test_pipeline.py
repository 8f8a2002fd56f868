import random

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm.tokens import token_bytes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic documents, a boilerplate line, exact and near copies, and a leak."""
    rng = random.Random(12)
    at = str(tmp_path_factory.mktemp("corpus"))

    def words(n):
        return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}{rng.randint(0, 50)}" for _ in range(n)]

    leak = " ".join(words(30))
    rows, labels = [], []
    for i in range(160):
        text = words(120)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(100), "grumbag")
        lines = [" ".join(text)] + ["this boilerplate line stands in all of the texts"] * (i % 3 == 0)
        rows.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, clean[k][1], "en", "s", 0) for k in range(5)]
    near = []
    for k in range(5, 10):
        w = clean[k][1].split(" ")
        w[7] = "changed"
        near.append((1000 + k, " ".join(w), "en", "s", 0))
    rows += near + [(2000, " ".join(words(40)) + " " + leak + " " + " ".join(words(40)), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def survivors(rows):
    """Ids that a near-dedup by brute force keeps: the least of each group of texts at a similarity of 0.8."""
    sets = [(r.doc_id, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := r.text.lower().split()) else set()) for r in sorted(rows)]
    root = {i: i for i, _ in sets}
    for n, (i, x) in enumerate(sets):
        for j, y in sets[n + 1 :]:
            if (not x and not y or x and y and len(x & y) >= 0.8 * len(x | y)) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return set(root.values())


@pytest.fixture(scope="module")
def seen(spark, folder, tmp_path_factory):
    """Each stage's result on its predecessor's."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        assert name == "packing" or made.columns == docs.columns
        made.write.parquet(str(at / name))
        out[name] = docs = spark.read.parquet(str(at / name))
    return out


def test_stages(seen):
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    clean = {i for i in range(160) if i % 4}
    assert ids["toxicity"] == clean | {1000 + k for k in range(10)} | {2000}
    assert ids["line dedup"] == ids["toxicity"]
    lines = seen["line dedup"].collect()
    assert sum("boilerplate" in r.text for r in lines) <= 2
    # a near copy's line is recurring: one of the two texts keeps it
    whole = {r.doc_id for r in lines if len(r.text.split()) >= 100}
    originals = [i for i in sorted(clean)][5:10]
    assert all(len({i, 1005 + k} & whole) == 1 for k, i in enumerate(originals))
    assert ids["simhash near-dedup"] == survivors(lines) and not ids["simhash near-dedup"] & {1000 + k for k in range(5)}
    assert ids["decontamination"] == ids["simhash near-dedup"] - {2000}
    assert ids["packing"] == ids["decontamination"]
    texts = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    encoder = token_bytes(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    n = {i: len(encoder.whole(t)) // 4 + 1 for i, t in texts.items()}
    assert {r.doc_id: r.n for r in seen["packing"].groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()} == n


def test_near_dedup_on_its_own_input(spark, seen, folder):
    docs = seen["toxicity"]
    left = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, folder).collect()}
    assert left == survivors(docs.collect()) == {i for i in range(160) if i % 4} | {2000}


def test_stages_on_odd_and_empty_tables(spark, folder, odd_docs, no_docs):
    """Null, empty and blank texts, null and repeated ids, very long texts; and no rows at all."""
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd_docs, folder), stage(spark, no_docs, folder)
        assert none.count() == 0, name
        if name in ("toxicity", "line dedup", "decontamination"):
            assert out.count() == 11 and out.columns == odd_docs.columns, name
        elif name != "packing":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "6", "8", "9", "None"]


def test_run(spark, seen, folder):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert got == sorted(map(tuple, seen["packing"].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_workers_return_what_they_freed():
    """A freed block under one that is still held stays with the process unless it is returned."""
    import resource

    from millrace.llm.common import map_arrow

    class Frame:
        def mapInArrow(self, fn, schema):
            return fn

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize() / 1e6

    pins = []

    def work(batches):
        held = [b"%d" % i * 200 for i in range(100_000)]
        pins.append(b"%d" % len(held) * 200)
        del held
        yield from batches

    before = resident()
    assert list(map_arrow(Frame(), work, "")(iter([1, 2]))) == [1, 2]
    assert resident() - before < 30
