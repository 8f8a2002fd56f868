import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, quality, toxicity
from millrace.llm.common import fold_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = ["idiot$", "disgusting$", "worthless$", "lostra", "scum$", "abcdef", "vequ"]
    trie, allowed = toxicity.Trie(terms, toxicity.edits_allowed), toxicity.edits_allowed
    matcher = toxicity.Matcher(terms, [1.0] * len(terms))
    for _ in range(1500):
        token = list(rng.choice(terms).rstrip("$") + rng.choice(["", "", "ing"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(token) + 1)
            token[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "s", "i"])
        token = "".join(token)
        found = []
        for t in terms:
            row = distance(t.rstrip("$"), token)
            edits = row[-1] if t.endswith("$") else min(row)
            if edits <= allowed(t):
                found.append((edits, t))
        want = min(found) if found else None
        assert trie.nearest(token) == (want and (want[1], want[0]))
        if want and want[0]:
            assert matcher[token] == (want[1], want[0])
        assert (matcher[token] is None) == (want is None)


def labelled(spark, n=400):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ta", "ri", "mon", "sel") for b in ("ka", "lo", "pen", "dur", "vi")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(30), rng.choice(["grumbag", "snotface", "wortzel" + rng.choice(["a", "en", "ix"])]))
        rows.append((i, " ".join(words) + ".", "en", f"s{i % 3}"))
        labels.append((i, int(i % 7 != 0), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").collect()
    assert {r.held_out for r in got} == {True, False} and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    model = toxicity.fit_toxicity(docs, labels)
    typo = spark.createDataFrame([(1, "taka grumbog snotfase rilo"), (2, "taka rilo")], "doc_id long, text string")
    hit, clean = toxicity.score_toxicity(typo, model).orderBy("doc_id").collect()
    assert hit.n_terms == 2 and hit.score >= clean.score
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and 300 < left.count() < 330


def test_quotation_is_told_apart():
    matcher = toxicity.Matcher(["grumbag$"], [3.0])
    f = toxicity.FEATURES.index
    assert toxicity.features_of('the judge wrote "what a grumbag" in it', matcher, 8)[f("quoted")] == 1
    assert toxicity.features_of("you grumbag", matcher, 8)[f("addressed")] == 1
    assert toxicity.features_of("nothing here", matcher, 8) == [0.0] * len(toxicity.FEATURES)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_digest(odd_docs.withColumnRenamed("n_chars", "score"), none).collect()
    assert len(rows) == 11 and all(r.score == 0 and r.predicted == 0 for r in rows)
    docs, labels = labelled(spark, 100)
    assert toxicity.score_toxicity(no_docs, toxicity.fit_toxicity(docs, labels)).count() == 0
    assert toxicity.score_toxicity(odd_docs, toxicity.fit_toxicity(docs, labels)).count() == 11


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        words = [f"w{rng.randint(0, 400)}" for _ in range(40)]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:5] * 8)
        rows.append((i, text, "en", f"s{i % 5}"))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_digest(docs, known).join(known, "doc_id").collect()
    assert len(got) == 300 and np.mean([r.keep == bool(r.quality) for r in got if r.held_out]) > 0.97
    none = known.limit(0)
    odd = quality.quality_digest(odd_docs.withColumnRenamed("n_chars", "score"), none).collect()
    assert len(odd) == 11 and all(r.keep and r.score == pytest.approx(0.5) for r in odd)
    assert quality.quality_digest(no_docs, known).count() == 0
    assert len(quality.quality_digest(odd_docs, known).collect()) == 11


def test_sparse_sites_shrink_to_the_prior(spark):
    rng = random.Random(1)
    rows = [(i, "same text", "big" if i < 280 else f"tiny{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    labels = spark.createDataFrame([(i, int(rng.random() < (0.2 if i < 280 else 1.0)), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels, F.col("host"), F.col("host")).collect()}
    assert got[0].host_rate < 0.4 and got[299].host_rate < 0.75


TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog while the other animals were watching from their houses and nothing happened",
    "de": "der schnelle braune fuchs springt über den faulen hund während die anderen tiere aus ihren häusern zuschauten und nichts geschah",
    "fr": "le rapide renard brun saute par dessus le chien paresseux pendant que les autres animaux regardaient depuis leurs maisons",
}


def test_language(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(TEXTS[lang].split(), k=25)), lang) for i, lang in enumerate(list(TEXTS) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(TEXTS.items())] + [(i + 10, t, lang) for i, (lang, t) in enumerate(TEXTS.items())], "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(docs)
    rows = langid.identify_languages(odd_docs.withColumnRenamed("n_chars", "score"), profiles).collect()
    assert len(rows) == 11 and [r.lang_pred for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert langid.identify_languages(no_docs, profiles).count() == 0
    assert {r.lang_pred for r in langid.language_digest(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bundles_are_sums_of_bound_trigrams():
    letters = langid.letter_vectors(64, 7)
    text = "Ab ba-c"
    slots = [0, 1, 2, 0, 2, 1, 0, 3, 0]
    want = np.zeros(64)
    for a, b, c in zip(slots, slots[1:], slots[2:]):
        want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    assert np.array_equal(langid.bundles([text, ""], letters)[0], want)


def test_blocks_of_long_texts_join(monkeypatch):
    text = "abc de  fgh " * 50
    whole = np.concatenate(list(langid.gram_codes(text)))
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.array_equal(np.concatenate(list(langid.gram_codes(text))), whole)


def test_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "i long").select("i", fold_of(F.col("i")).alias("f"))
    assert all(r.f == zlib.crc32(str(r.i).encode()) % 4 for r in df.collect())


def test_toxicity_whole_result_against_brute_force(spark):
    """Every score from plain edit distances to all terms and loops over all tokens."""
    import re

    docs, labels = labelled(spark, 200)
    extra = [(1000, 'he said "you grumbog" and left'), (1001, "snotfase, snotface! wortzelen"), (1002, None), (1003, "taka")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    model = toxicity.fit_toxicity(docs, labels)
    assert model.terms
    for r in toxicity.score_toxicity(docs, model).join(docs, "doc_id").collect():
        low = (r.text or "").lower()
        found = list(re.finditer(r"[^\W\d_]+(?:['’][^\W\d_]+)*", low))
        tokens, hits = [m.group() for m in found], {}
        for i, w in enumerate(tokens):
            near = []
            for t in model.terms:
                row = distance(t.rstrip("$"), w)
                edits = row[-1] if t.endswith("$") else min(row)
                if edits <= toxicity.edits_allowed(t):
                    near.append((edits, t))
            if near:
                hits[i] = min(near)
        x = [0.0] * len(toxicity.FEATURES)
        if hits:
            marks = [i for i, c in enumerate(low) if c in toxicity.QUOTES]
            quoted = addressed = 0
            for i in hits:
                around, at = tokens[max(0, i - model.window) : i + model.window + 1], found[i].start()
                before, after = [m for m in marks if m < at], [m for m in marks if m > at]
                inside = len(before) % 2 == 1 and bool(after) and after[0] - before[-1] <= 40 * model.window
                quoted += inside or bool(set(around) & toxicity.REPORTING)
                addressed += bool(set(around) & toxicity.ADDRESS)
            exact = sum(e == 0 for e, _ in hits.values())
            strength = dict(zip(model.terms, model.strengths))
            cluster = max(sum(i <= j < i + 4 * model.window for j in hits) for i in hits)
            x = [np.log1p(exact), np.log1p(len(hits) - exact), np.log1p(len({t for _, t in hits.values()})), len(hits) / len(tokens), np.log1p(cluster)]
            x += [max((strength[t] for e, t in hits.values() if e == 0), default=0.0), quoted / len(hits), addressed / len(hits)]
        score = 1 / (1 + np.exp(-(np.dot(x, model.weights[:-1]) + model.weights[-1])))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(score >= 0.3), r.text


def test_quality_whole_result_against_brute_force(spark):
    """Every rate by adding up all other labelled rows of the path and host."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["ab", "cd!", "EF", "gh.", "9"]) for _ in range(rng.randint(0, 30))), f"h{i % 7 % 4}", f"p{i % 5}") for i in range(240)] + [(None, "ab cd", "h0", "p0")] * 3
    labels = {i: int(rng.random() < 0.3 + 0.15 * (i % 4)) for i in range(240) if i % 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    known = spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, known, F.col("host"), F.concat("host", "path")).collect()
    used = [r for r in rows if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    x, y = np.array([quality.features_of(r[1]) for r in used]), np.array([labels[r[0]] for r in used], float)
    table = sorted(map(tuple, np.column_stack([y, x])))
    prior = y.mean()
    fitted = np.array(table)
    weights = np.array(toxicity.fit_logistic(np.hstack([fitted[:, 1:], fitted[:, 1:] ** 2]), fitted[:, 0], ridge=1e-3))

    def strength(group):
        sums = {}
        for r in used:
            n, good = sums.get(group(r), (0, 0))
            sums[group(r)] = (n + 1, good + labels[r[0]])
        sums = [s for s in sums.values() if s[0] >= 2]
        spread = sum(n * (good / n - prior) ** 2 for n, good in sums)
        between = max(1e-6, (spread - (len(sums) - 1) * prior * (1 - prior)) / sum(n for n, _ in sums))
        return min(1000.0, max(2.0, prior * (1 - prior) / between))

    host_strength, path_strength = strength(lambda r: r[2]), strength(lambda r: r[2] + r[3])
    want = {}
    for r in rows:
        f = np.array(quality.features_of(r[1]))
        evidence = np.clip(np.dot(np.hstack([f, f * f]), weights[:-1]) + weights[-1] - np.log(prior / (1 - prior)), -8, 8)
        host = [labels[o[0]] for o in used if o[2] == r[2] and o is not r]
        path = [labels[o[0]] for o in used if o[2:] == r[2:] and o is not r]
        host_rate = (sum(host) + host_strength * prior) / (len(host) + host_strength)
        path_rate = (sum(path) + path_strength * host_rate) / (len(path) + path_strength)
        want[r[0]] = (evidence, host_rate, path_rate, 1 / (1 + np.exp(-(np.log(path_rate / (1 - path_rate)) + evidence))))
    assert len(got) == len(rows)
    for r in got:
        assert (r.evidence, r.host_rate, r.path_rate, r.score) == pytest.approx(want[r.doc_id], abs=1e-7)


def test_quality_learns_from_all_labelled_rows(spark):
    """More labelled rows than were once sampled; prior and weights are those of a fit in memory over each of them."""
    kinds = ["ab cd ef", "AB CD!", "ab ab 9.", "gh. ij. kl"]
    rows = [(i, kinds[i * 7 % 4], int(zlib.crc32(b"%d x" % i) % 10 < 2 + i * 7 % 4 * 2)) for i in range(30_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    used = [(kinds.index(t), q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(used) > 20_000
    x, (at, y) = np.array([quality.features_of(t) for t in kinds]), np.array(used).T
    x = np.hstack([x, x * x])
    weights, prior = np.array(toxicity.fit_logistic(x[at], y, ridge=1e-3)), y.mean()
    want = x @ weights[:-1] + weights[-1] - np.log(prior / (1 - prior))
    got = quality.score_quality(docs, labels, F.lit("h"), F.lit("p")).where("doc_id < 4").collect()
    assert len(got) == 4 and all(r.evidence == pytest.approx(want[r.doc_id * 7 % 4], abs=1e-7) for r in got)


def test_language_whole_result_against_brute_force(spark):
    """Every prediction from trigrams bound one by one."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(TEXTS[lang] + " -É9") for _ in range(rng.randint(0, 60))), lang if i % 9 else None) for i, lang in enumerate(list(TEXTS) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters, table = langid.letter_vectors(1024, 7).astype(float), langid.slot_table()

    def bundle(text):
        slots = [0]
        for c in text + " ":
            s = int(table[ord(c)])
            if s or slots[-1]:
                slots.append(s)
        grams = [(a, b, c) for a, b, c in zip(slots, slots[1:], slots[2:]) if b or (a and c)]
        return sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in grams), np.zeros(1024))

    sums = {}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + bundle(text)
    for r in langid.language_digest(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        mine = bundle(r.text)
        if not mine.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {lang: mine @ s / np.linalg.norm(mine) / np.linalg.norm(s) for lang, s in sums.items()}
        assert r.score == pytest.approx(max(0, max(cosines.values())), abs=1e-5)
        assert cosines[r.lang_pred] == pytest.approx(max(cosines.values()), abs=1e-5)
