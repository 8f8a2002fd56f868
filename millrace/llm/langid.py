"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; the vector of a letter trigram binds the vectors of its
letters, each permuted by its place, by multiplication; a text or a language bundles its trigrams by
addition; and a text goes to the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, map_arrow

#: Letter slots: 0 between words, 1 to 26 for a to z, the others for all other letters by their code point.
SLOTS = 96
UNKNOWN = "und"
#: Characters handled at once, so that very long texts take bounded memory.
BLOCK = 1 << 20
#: Trigram codes that a task keeps, over all languages, before it counts them.
WAITING = 1 << 23


def _slot_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(len(table)):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            low = ord(low) if len(low) == 1 else cp
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (SLOTS - 27)
    return table


_tables: dict[str, np.ndarray] = {}


def slot_table() -> np.ndarray:
    if "slots" not in _tables:
        _tables["slots"] = _slot_table()
    return _tables["slots"]


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """Codes of the letter trigrams of a text with one blank for each stretch of other characters, in blocks."""
    table = slot_table()
    tail = np.zeros(1, np.int32)  # the blank before the first word
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        slots = np.concatenate([tail, table[points].astype(np.int32)])
        if at + BLOCK >= len(text):
            slots = np.append(slots, 0)
        keep = np.ones(len(slots), bool)
        keep[1:] = (slots[1:] != 0) | (slots[:-1] != 0)  # one blank at a time
        slots = slots[keep]
        if len(slots) >= 3:
            codes = (slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:]
            yield codes[(slots[1:-1] != 0) | (slots[:-2] != 0) & (slots[2:] != 0)]
        tail = slots[-2:]


def letter_vectors(dimension: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SLOTS, dimension))


def gram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes: the permutation is a rotation by the letter's distance from the end."""
    first, second, third = codes // (SLOTS * SLOTS), codes // SLOTS % SLOTS, codes % SLOTS
    return np.roll(letters, 2, 1)[first] * np.roll(letters, 1, 1)[second] * letters[third]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # one unit vector for each language
    dimension: int
    seed: int


def fit_profiles(docs: DataFrame, dimension: int = 1024, seed: int = 7, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Language prototypes from all rows with a text and a language that are not held out.

    Tasks add up trigram counts by language and the sums are added over the corpus; what comes to the
    driver has at most languages x trigram codes rows, whatever the corpus. The bundle of counts is the
    sum of the texts' bundles, because bundling is addition. No learned row: no languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for name, parts in waiting.items():
                total = np.bincount(np.concatenate(parts), minlength=1)
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["lang", "code", "n"])
            waiting.clear()

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for codes in gram_codes(value.as_py()):
                    waiting.setdefault(name, []).append(codes)
                    held += len(codes)
                if held > WAITING:
                    yield from counted()
                    held = 0
        yield from counted()

    known = docs.where(~is_held_out(F.col(key)) & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = map_arrow(known, run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    letters = letter_vectors(dimension, seed)
    languages = sorted(sums["lang"].unique()) if len(sums) else []
    prototypes = np.zeros((len(languages), dimension))
    for i, name in enumerate(languages):
        mine = sums[sums["lang"] == name]
        codes, n = mine["code"].to_numpy(), mine["n"].to_numpy(np.float64)
        for at in range(0, len(codes), 4096):
            prototypes[i] += n[at : at + 4096] @ gram_vectors(codes[at : at + 4096], letters)
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Profiles(list(languages), prototypes / np.where(norms == 0, 1, norms), dimension, seed)


def bundles(texts: list[str], letters: np.ndarray) -> np.ndarray:
    """The bundled vector of each text: its trigram counts times the trigrams' vectors."""
    codes, owner = [], []
    for i, text in enumerate(texts):
        for part in gram_codes(text):
            codes.append(part)
            owner.append(np.full(len(part), i, np.int64))
    out = np.zeros((len(texts), letters.shape[1]), np.float32)
    if not codes:
        return out
    every, whose = np.concatenate(codes), np.concatenate(owner)
    seen = np.flatnonzero(np.bincount(every, minlength=SLOTS**3))
    number = np.zeros(SLOTS**3, np.int64)
    number[seen] = np.arange(len(seen))
    place = number[every]
    for at in range(0, len(seen), 8192):
        part = seen[at : at + 8192]
        mine = (place >= at) & (place < at + 8192) if len(seen) > 8192 else slice(None)
        counts = np.bincount(whose[mine] * len(part) + (place[mine] - at), minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ gram_vectors(part, letters).astype(np.float32)
    return out


def identify_languages(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its whole text.

    lang_pred is the learned language of largest cosine, ties to the first in order; ``und`` with
    score 0 for a null text, one without letters, or where nothing was learned. score: that cosine,
    negative ones as 0. Repeated rows each get a row; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x dimension numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        letters = letter_vectors(known.dimension, known.seed)
        for batch in batches:
            names, scores = [], []
            texts, held = [], 0
            values = batch.column(2)

            def flush() -> None:
                vectors = bundles(texts, letters)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ known.prototypes.T / np.where(norms == 0, 1, norms)[:, None] if known.languages else np.zeros((len(texts), 0))
                for norm, row in zip(norms, cosines):
                    best = int(row.argmax()) if len(row) and norm else -1
                    names.append(known.languages[best] if best >= 0 else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, row[best]))) if best >= 0 else 0.0)
                texts.clear()

            for value in values:
                one = value.as_py() or ""
                texts.append(one)
                held += len(one)
                if len(texts) == 128 or held > BLOCK:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)[key]
    slim = docs.select(F.col(key).alias("doc_id"), is_held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return map_arrow(slim, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_digest(documents: DataFrame) -> DataFrame:
    return identify_languages(documents, fit_profiles(documents))
