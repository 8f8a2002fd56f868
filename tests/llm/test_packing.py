import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import packing
from millrace.llm.queries import RANKS, TOKENIZER
from millrace.llm.tokens import token_bytes

FILES = (public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
ODD = ["", " ", "a  b", "a \nb\n\n c", "\n\nx", "x<|endoftext|>y", "a b c　", "don't  I'll\t\tx", " lead", "trail ", "a\x1cb \x1c c", "日本 語 \n の", "x \n\n y", "é😀 ñ", "tab\tend\n"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers(text):
    encoder = token_bytes(*FILES)
    assert encoder.of(text) == encoder.whole(text) == token_bytes(FILES[0]).of(text)


def check(rows, texts, capacity=1024):
    encoder = token_bytes(*FILES)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, copies in texts.items():
        ids = encoder.whole(copies[0]) + b"\0\0\0\0"
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(copies) * len(ids) // 4
        for r in pieces:
            assert r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_sequence


def test_round_trip_and_padding(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 40, 90, 200, 900]))) for i in range(300)}
    rows = packing.pack_documents(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), *FILES).collect()
    sequences = check(rows, {i: [t] for i, t in texts.items()})
    lengths = [sum(r.length for r in p) for p in sequences.values()]
    assert packing.padding(lengths, 1024) < 0.05 * sum(lengths)


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.where("doc_id IS NOT NULL").withColumnRenamed("n_chars", "length")
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    rows = packing.pack_documents(docs, *FILES).collect()
    check(rows, texts)
    assert packing.pack_documents(no_docs, *FILES).count() == 0


def test_inverse_by_elimination():
    rng = np.random.default_rng(9)
    for m in (1, 7, 128):
        basis = rng.integers(0, 5, (m, m)) + np.eye(m) * 9
        assert np.allclose(packing.inverse_of(basis) @ basis, np.eye(m), atol=1e-8)


def test_patterns_cover_the_histogram():
    rng = random.Random(4)
    histogram = {s: rng.randint(1, 300) for s in range(1, 129)}
    plan = packing.plan_packing(histogram, 128)
    used = defaultdict(int)
    for s, n in histogram.items():
        for q in packing.place(plan, np.full(n, s), np.arange(n)):
            used[q] += s
    assert max(used.values()) <= 128 and len(used) == plan.sequences
    assert plan.sequences <= sum(s * n for s, n in histogram.items()) / 128 * 1.02 + 2


def test_no_pieces():
    assert packing.plan_packing({}, 128).sequences == 0
