"""Document filters and signals: language, length, private data, normal forms, dedup, quality, contamination, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, sha256
from .alike import ORDER_ROWS, cut_lineage, links_in_buckets, member_order, prefixes, similar_components

#: Common function words of each language.
STOP_WORDS = {
    "en": ("the", "of", "and", "is", "that", "with", "for", "was", "are", "this"),
    "fr": ("le", "les", "des", "et", "est", "une", "dans", "pour", "avec", "sur"),
    "de": ("der", "die", "das", "und", "ist", "von", "mit", "für", "auf", "den"),
    "es": ("el", "los", "las", "y", "del", "una", "para", "con", "por", "que"),
}


def words_of(text: Column) -> Column:
    """Lower-cased words without the marks at their ends."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.,;:!?\"()|]", " "), r"\s+"), lambda w: w != "")


def language_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, words``, stop words met by language, and ``lang_guess``: the most, ties in the order of STOP_WORDS; none: und."""
    counted = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    hits = [_stop_hits(F.col("w"), lang).alias(f"hits_{lang}") for lang in STOP_WORDS]
    rows = counted.select("doc_id", F.size("w").cast("long").alias("words"), *hits)
    best = F.greatest(*(F.col(f"hits_{x}") for x in STOP_WORDS))
    guess = F.when(best == 0, "und")
    for lang in STOP_WORDS:
        guess = guess.when(F.col(f"hits_{lang}") == best, lang)
    return rows.withColumn("lang_guess", guess)


def _stop_hits(words: Column, lang: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS[lang]))).cast("long")


def length_filter(docs: DataFrame, least: int = 200, most: int = 20_000) -> DataFrame:
    """Documents of ``least`` to ``most`` characters."""
    return docs.where(F.length("text").between(least, most))


EMAIL, IPV4, LONG_NUMBER, SECRET = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", r"[0-9]{10,}", r"(?i)(?:token|secret|password|api_key) = \"[^\"]+\""


def pii_counts(docs: DataFrame) -> DataFrame:
    """Counts of e-mail addresses, IPv4 addresses, long numbers and quoted secrets; and the text with them masked."""
    t = F.coalesce(F.col("text"), F.lit(""))
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, SECRET, "<secret>"), EMAIL, "<email>"), IPV4, "<ip>"), LONG_NUMBER, "<number>")
    kinds = {"emails": EMAIL, "ips": IPV4, "numbers": LONG_NUMBER, "secrets": SECRET}
    return docs.select("doc_id", *(F.regexp_count(t, F.lit(p)).cast("long").alias(k) for k, p in kinds.items()), F.length(masked).cast("long").alias("masked_chars"))


def normal_forms(docs: DataFrame) -> DataFrame:
    """Whitespace, case and encoding normal forms: the clean lower-cased text's length and SHA-256."""
    form = F.lower(clean_text(F.col("text")))
    return docs.select("doc_id", F.length(form).cast("long").alias("chars"), sha256(form).alias("form_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Of documents with the same normal form the one with the least id, and how many copies it stands for.

    Only keys are shuffled; a partial aggregate folds each task's copies first.
    """
    forms = docs.select("doc_id", sha256(F.lower(clean_text(F.col("text")))).alias("form_sha256"))
    return forms.groupBy("form_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, members``: the different word shingles as 64-bit hashes. Texts of fewer words are one shingle; texts without words are left out."""
    w = docs.select("doc_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    return w.select("doc_id", F.sort_array(F.array_distinct(runs)).alias("members"))


def minhash_signature(members: Column, orders: int = 16) -> Column:
    """The least hash of the members under each of ``orders`` seeds."""
    return F.array(*(F.array_min(F.transform(members, lambda x, k=seed: F.xxhash64(F.lit(k), x))) for seed in range(orders)))


def minhash_pairs(docs: DataFrame, threshold: float = 0.8, bands: int = 8, rows: int = 2) -> DataFrame:
    """Near-duplicates as ``doc_id, near_id, similarity``: each document that has a lesser one in its group, and the least.

    Groups are the components over all pairs whose sets of five-word shingles have a Jaccard similarity
    of ``threshold`` or more; ``similarity`` is that to the least document, which in a chain can be below
    ``threshold``. Members of a band bucket are compared with one another in pairs of tiles; pairs that
    share no bucket meet by their prefixes (``similar_components``), so none is lost. Documents with a
    null id or without words take no part.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(texts.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")).withColumnRenamed("doc_id", "rep")

    signature = minhash_signature(F.col("members"), bands * rows).alias("s")
    signed = cut_lineage(shingle_sets(texts).select("doc_id", F.struct(F.xxhash64("members").alias("x"), F.xxhash64(F.lit(1), "members").alias("y"), F.size("members").alias("n")).alias("c"), signature))
    reps = cut_lineage(signed.groupBy("c").agg(F.min("doc_id").alias("rep"), F.any_value("s").alias("s")))
    chosen = reps.select("rep").distinct()
    banded = reps.select("rep", F.col("rep").alias("root"), F.posexplode(F.array(*(F.xxhash64(F.slice("s", b * rows + 1, rows)) for b in range(bands)))).alias("band", "bucket"))
    # band buckets with the same documents are one
    marks = banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("p"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("q")).where("n > 1")
    different = marks.groupBy("n", "p", "q").agg(F.min(F.struct("band", "bucket")).alias("k")).select("k.band", "k.bucket")
    buckets = cut_lineage(banded.join(different, ["band", "bucket"]))
    links = cut_lineage(links_in_buckets(buckets, ["band", "bucket"], cut_lineage(sets_of(buckets.select("rep").distinct())), threshold))
    share = max(1, reps.count() // ORDER_ROWS)
    order = member_order(sets_of(chosen.where(F.pmod(F.xxhash64("rep"), F.lit(share)) == 0)))
    heads = cut_lineage(prefixes(shingle_sets(texts).withColumnRenamed("doc_id", "rep"), threshold, order).join(chosen, "rep", "left_semi").dropDuplicates(["rep"]))
    roots = similar_components(lambda labels: heads.join(labels, "rep"), sets_of, heads.select("rep", "tally", "fine"), chosen, links, threshold).withColumnsRenamed({"node": "rep", "root": "near_id"})
    near = signed.select("doc_id", "c").join(reps.select("c", "rep"), "c").join(roots, "rep", "left").select("doc_id", F.coalesce("near_id", "rep").alias("near_id"))
    near = cut_lineage(near.where("doc_id <> near_id").distinct())
    sets = cut_lineage(sets_of(near.select(F.col("doc_id").alias("rep")).union(near.select("near_id")).distinct()))
    pairs = near.join(sets.withColumnRenamed("rep", "doc_id"), "doc_id").join(sets.select(F.col("rep").alias("near_id"), F.col("members").alias("b")), "near_id")
    both = F.size(F.array_intersect("members", "b"))
    return pairs.select("doc_id", "near_id", (both / (F.size("members") + F.size("b") - both)).alias("similarity")).groupBy("doc_id", "near_id").agg(F.max("similarity").alias("similarity"))


def quality_signals(docs: DataFrame) -> DataFrame:
    """Symbol share, repeated-line share, mean word length, and a rule on them."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    words = F.filter(F.split(t, r"[ \n]+"), lambda x: x != "")
    rows = docs.select(
        "doc_id",
        (F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:'-]", "")) / F.greatest(F.length(t), F.lit(1))).alias("symbol_share"),
        (1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))).alias("repeated_lines"),
        ((F.length(t) - F.size(words) + 1) / F.greatest(F.size(words), F.lit(1))).alias("word_length"),
        (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("distinct_words"),
    )
    good = (F.col("symbol_share") < 0.05) & (F.col("repeated_lines") < 0.5) & F.col("word_length").between(2, 12)
    return rows.withColumn("good", good)


def quality_gate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How the rule agrees with the labels: counts by label and verdict."""
    return quality_signals(docs).join(labels.select("doc_id", "quality"), "doc_id").groupBy("quality", "good").agg(F.count("*").alias("n"))


def flagged_by_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxic or poor documents by label, counted by source: the automatic quality check."""
    joined = docs.select("doc_id", "source").join(labels, "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("poor"))


def shingles_of(df: DataFrame, key: str, words: int) -> DataFrame:
    """``key, shingle`` of each different run of ``words`` words (a shorter text: its whole sequence), as 64-bit hashes."""
    w = df.select(key, words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    return w.select(key, F.explode(F.array_distinct(runs)).alias("shingle"))


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 13) -> DataFrame:
    """``doc_id, items, shingles``: documents that share a run of ``words`` words with benchmark items.

    The benchmark's shingles are the smaller side; whether they are broadcast is left to the planner's
    size check.
    """
    items = shingles_of(benchmark, "item_id", words)
    return shingles_of(docs, "doc_id", words).join(items, "shingle").groupBy("doc_id").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("shingle").alias("shingles"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, words: int = 13) -> DataFrame:
    return docs.join(contaminated(docs, benchmark, words).select("doc_id"), "doc_id", "left_anti")


def token_statistics(docs: DataFrame) -> DataFrame:
    """White-space tokens by source and language: sum, mean, and the largest text."""
    n = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[ \n]+"), lambda x: x != "")).cast("long")
    return docs.select("source", "lang", n.alias("n")).groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("largest"))


def top_documents(docs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` longest documents of each source, ties by id."""
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return docs.select("source", "doc_id", "n_chars").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
