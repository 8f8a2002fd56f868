"""Registered queries over the tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import messages as M
from .functions.text import clean_text
from .operators import audit, documents, mixture, raw, records, scoring, seeded, sharegpt
from .operators.clean import CleanConfig, bronze, drop_counts, silver
from .sources import catalog, scan
from .streaming.incremental import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

POLICY = audit.AuditPolicy(max_chars=3000, long_chars=2000, max_messages=6)
CLEAN = CleanConfig(min_messages=3, min_assistant_chars=2, max_chars=3000)
TARGETS, HELD = {"set0": 5, "set1": 4, "set2": 3}, {"set0": 2, "set3": 2}
MIXTURE = mixture.MixtureConfig(TARGETS, 0.25, 4)


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records_of_turns(table(spark, sf_dir, "conversations"))


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.inspect(turns_as_records(spark, sf_dir), POLICY)


# The same records, flags and samples in DuckDB.
RECS = r"""
turns AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS content FROM conversations),
recs0 AS (SELECT conv_id, 'set' || (conv_id % 4) AS source_dataset, list(struct_pack(role := role, content := content) ORDER BY turn) AS messages,
  sum(length(content))::BIGINT AS chars, count(*) AS n, count(*) FILTER (role = 'assistant') AS assistants,
  max(CASE WHEN role = 'assistant' THEN length(content) ELSE 0 END) AS answered, string_agg(role, ' -> ' ORDER BY turn) AS sequence,
  sha256(string_agg(role || ':' || content, chr(10) ORDER BY turn)) AS key FROM turns WHERE content <> '' GROUP BY conv_id),
recs1 AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('{"messages":' || to_json(messages)::VARCHAR || ',"raw_id":"' || conv_id || '","row_index":' || conv_id || ',"source_dataset":"' || source_dataset || '"}')) AS h FROM recs0),
recs AS (SELECT * EXCLUDE (h), h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM recs1),
sides AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM turns WHERE content <> '' AND role <> 'system'),
bad_order AS (SELECT conv_id FROM sides GROUP BY conv_id HAVING bool_or((i % 2 = 1) <> (role IN ('user', 'tool')))),
flagged AS (SELECT r.*, list_filter([
  CASE WHEN n < 2 THEN 'schema_error' END, CASE WHEN assistants = 0 THEN 'missing_assistant' END,
  CASE WHEN b.conv_id IS NOT NULL OR s.conv_id IS NULL THEN 'invalid_turn_order' END, CASE WHEN chars > 3000 THEN 'too_long' END,
  CASE WHEN chars > 2000 AND chars <= 3000 THEN 'long_sample' END, CASE WHEN n > 6 THEN 'too_many_messages' END], lambda x: x IS NOT NULL) AS flags
  FROM recs r LEFT JOIN bad_order b USING (conv_id) LEFT JOIN (SELECT DISTINCT conv_id FROM sides) s ON s.conv_id = r.conv_id),
insp AS (SELECT *, list_has_any(flags, ['schema_error', 'missing_assistant', 'invalid_turn_order', 'too_long', 'too_many_messages']) AS blocking FROM flagged)
"""
GOLD = RECS + r""",
targets AS (SELECT * FROM (VALUES ('set0', 5), ('set1', 4), ('set2', 3)) t(source_dataset, target)),
ranks AS (SELECT i.*, target, row_number() OVER (PARTITION BY i.source_dataset ORDER BY sha256('20260710:selection:' || i.source_dataset || ':' || id), id) AS r FROM insp i JOIN targets USING (source_dataset) WHERE NOT blocking),
gold AS (SELECT *, CASE WHEN r <= greatest(CAST(round_even(target * 0.25, 0) AS INT), 1) THEN 'validation' ELSE 'train' END AS split FROM ranks WHERE r <= target)
"""


@query(f"""WITH {RECS}, p AS (SELECT source_dataset, blocking, chars, n FROM insp),
c AS (SELECT source_dataset, list(chars ORDER BY chars) AS cs, list(n ORDER BY n) AS ns, count(*) AS k, count(*) FILTER (NOT blocking) AS eligible, count(*) FILTER (blocking) AS blocked FROM p GROUP BY source_dataset)
SELECT source_dataset, k AS records, eligible, blocked, 0::BIGINT AS with_tools, 0::BIGINT AS with_function_calls, 0::BIGINT AS with_observations,
 cs[1] AS chars_min, cs[1 + floor((k - 1) * 0.5::DOUBLE)::INT] AS chars_p50, cs[1 + floor((k - 1) * 0.9::DOUBLE)::INT] AS chars_p90, cs[1 + floor((k - 1) * 0.99::DOUBLE)::INT] AS chars_p99, cs[k::INT] AS chars_max,
 ns[1] AS messages_min, ns[1 + floor((k - 1) * 0.5::DOUBLE)::INT] AS messages_p50, ns[1 + floor((k - 1) * 0.9::DOUBLE)::INT] AS messages_p90, ns[k::INT] AS messages_max FROM c""")
def audit_profile(spark, sf_dir):
    return audit.source_profile(inspected(spark, sf_dir), POLICY)


@query(f"WITH {RECS} SELECT id, source_dataset, array_to_string(flags, ',') AS flags, blocking, chars AS total_chars, n AS message_count, assistants AS assistant_count FROM insp")
def audit_inspection(spark, sf_dir):
    rows = inspected(spark, sf_dir)
    return rows.select("id", "source_dataset", F.array_join("flags", ",").alias("flags"), "blocking", "metrics.total_chars", "metrics.message_count", "metrics.assistant_count")


@query(f"WITH {RECS} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM insp) GROUP BY flag")
def audit_flag_counts(spark, sf_dir):
    return audit.flag_counts(inspected(spark, sf_dir))


@query(f"""WITH {RECS}, t AS (SELECT count(*) AS records, count(*) FILTER (blocking) AS blocked, count(*) FILTER (len(flags) > 0) AS flagged, count(*) FILTER (list_contains(flags, 'schema_error')) AS violations FROM insp)
SELECT *, coalesce(blocked::DOUBLE / nullif(records, 0), 1.0::DOUBLE) AS blocked_fraction,
 CASE WHEN coalesce(blocked::DOUBLE / nullif(records, 0), 1.0) > 0.01 OR violations > 0 THEN 'failed' WHEN flagged > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM t""")
def audit_gate(spark, sf_dir):
    return audit.gate(inspected(spark, sf_dir), POLICY)


@query(f"""WITH {RECS}, c AS (SELECT source_dataset, sequence, count(*) AS n, min(conv_id) AS f FROM recs GROUP BY ALL)
SELECT source_dataset, row_number() OVER (PARTITION BY source_dataset ORDER BY n DESC, f)::INT AS rank, sequence, n FROM c QUALIFY rank <= 5""")
def audit_role_sequences(spark, sf_dir):
    return audit.role_sequences(turns_as_records(spark, sf_dir))


@query(f"""WITH {RECS}, s AS (SELECT id, 'source:' || source_dataset AS reason FROM insp UNION ALL SELECT id, 'flag:' || unnest(flags) FROM insp),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY reason ORDER BY sha256('20260710:review:' || reason || ':' || id), id) <= 5)
SELECT id, array_to_string(list_sort(list(DISTINCT reason)), ',') AS selection_reasons, sha256('silver-audit.v1:' || id) AS review_id FROM t GROUP BY id""")
def audit_review_queue(spark, sf_dir):
    return audit.review_queue(inspected(spark, sf_dir), POLICY).withColumn("selection_reasons", F.array_join("selection_reasons", ","))


@query(f"""WITH {RECS}, d AS (SELECT CASE WHEN n < 3 THEN 'too_few_messages' WHEN answered < 2 THEN 'missing_assistant' WHEN chars > 3000 THEN 'too_long' END AS reason, key FROM recs),
x AS (SELECT reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT key) FROM d WHERE reason IS NULL)
SELECT reason, n FROM x WHERE n > 0""")
def clean_drop_counts(spark, sf_dir):
    return drop_counts(turns_as_records(spark, sf_dir), CLEAN)


@query(f"""WITH {RECS} SELECT id, source_dataset, key, chars AS total_chars, 'sft' AS task_family, 'general' AS domain FROM recs WHERE n >= 3 AND answered >= 2 AND chars <= 3000
QUALIFY row_number() OVER (PARTITION BY key ORDER BY 'raw/source=hf/dataset=' || source_dataset, conv_id) = 1""")
def clean_silver(spark, sf_dir):
    rows = silver(bronze(turns_as_records(spark, sf_dir), CLEAN))
    return rows.select("id", "source_dataset", F.col("meta.dedupe_key_sha256").alias("key"), M.total_chars(F.col("messages")).alias("total_chars"), "task_family", "domain")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


@query(f"WITH {RECS} SELECT conv_id, array_to_string(list_transform(messages, lambda m: m.role || ':' || m.content), chr(10)) AS messages FROM recs")
def adapt_raw_shapes(spark, sf_dir):
    """Conversations written out in the raw shapes by turns, and read back by the shape dispatch."""
    turns = table(spark, sf_dir, "conversations")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))

    def items(a: str, b: str, roles: dict[str, str]):
        names = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv))
        return F.transform("m", lambda m: F.struct(F.coalesce(F.try_element_at(names, m["role"]), m["role"]).alias(a), m["text"].alias(b)))

    plain = F.to_json(F.struct(items("role", "content", {}).alias("messages")))
    talks = F.to_json(F.struct(items("from", "value", {"user": "human", "assistant": "gpt"}).alias("conversations")))
    spoken = F.to_json(F.struct(items("speaker", "text", {}).alias("messages"), F.lit("[]").alias("tools")))
    line = F.when(F.col("conv_id") % 3 == 0, plain).when(F.col("conv_id") % 3 == 1, talks).otherwise(spoken)
    lines = grouped.select(F.lit("raw/dataset=set/part.jsonl").alias("raw_object_key"), F.col("conv_id").alias("raw_row_index"), line.alias("line"))
    rows = raw.adapt_rows(lines)
    return rows.select(F.col("raw_row_index").alias("conv_id"), F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n").alias("messages"))


@query("""WITH s AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events)
SELECT event_id, user_id, (seen - min(seen) OVER (PARTITION BY user_id))::BIGINT AS trace_index FROM s""")
def trace_segments(spark, sf_dir):
    return raw.segmented(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup").select("event_id", "user_id", "trace_index")


@query("""WITH s AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events),
t AS (SELECT *, (seen - min(seen) OVER (PARTITION BY user_id))::BIGINT AS trace_index FROM s)
SELECT user_id::VARCHAR AS user_id, trace_index, count(*) AS raw_event_count, min(event_id) AS raw_row_index, arg_max(event_id::VARCHAR, event_id) FILTER (event_type = 'signup') AS raw_id,
 arg_max(event_id::VARCHAR, event_id) FILTER (event_type = 'click') AS model_id, coalesce(array_to_string(list('m' || event_id ORDER BY event_id) FILTER (event_type = 'view'), '|'), '') AS messages FROM t GROUP BY ALL""")
def trace_folds(spark, sf_dir):
    """Events written out as agent trace lines and folded."""
    e = table(spark, sf_dir, "events")
    text = F.col("event_id").cast("string")
    session = F.to_json(F.struct(F.lit("session").alias("type"), text.alias("id")))
    change = F.to_json(F.struct(F.lit("model_change").alias("type"), text.alias("modelId")))
    part = F.struct(F.lit("text").alias("type"), F.concat(F.lit("m"), text).alias("text"))
    told = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("user").alias("role"), F.array(part).alias("content")).alias("message")))
    line = F.when(F.col("event_type") == "signup", session).when(F.col("event_type") == "click", change).when(F.col("event_type") == "view", told).otherwise('{"type":"other"}')
    rows = raw.fold_traces(e.select(F.col("user_id").cast("string").alias("raw_object_key"), F.col("event_id").alias("raw_row_index"), line.alias("line")))
    joined = F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("messages")
    return rows.select(F.col("raw_object_key").alias("user_id"), "trace_index", "raw_event_count", "raw_row_index", "raw_id", "model_id", joined)


@query(f"WITH {GOLD} SELECT id, source_dataset, split FROM gold")
def gold_selection(spark, sf_dir):
    return mixture.gold_mixture(inspected(spark, sf_dir), MIXTURE).select("id", "source_dataset", "split")


@query(f"""WITH {GOLD}, o AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY sha256('20260710:shuffle:' || split || ':' || id), id) - 1 AS position FROM gold)
SELECT id, split, position, (position // 4)::INT AS shard FROM o""")
def gold_shards(spark, sf_dir):
    return mixture.shuffled_shards(mixture.gold_mixture(inspected(spark, sf_dir), MIXTURE), MIXTURE).select("id", "split", "position", "shard")


@query(f"""WITH {GOLD}, a AS (SELECT source_dataset, count(*) AS available FROM insp WHERE NOT blocking GROUP BY 1),
g AS (SELECT source_dataset, count(*) AS selected, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation FROM gold GROUP BY 1)
SELECT source_dataset, available, coalesce(selected, 0) AS selected, coalesce(train, 0) AS train, coalesce(validation, 0) AS validation FROM a LEFT JOIN g USING (source_dataset)""")
def gold_summary(spark, sf_dir):
    rows = inspected(spark, sf_dir)
    return mixture.mixture_summary(rows, mixture.gold_mixture(rows, MIXTURE))


@query(f"""WITH {GOLD} SELECT count(*) AS records, sha256(coalesce(string_agg(id, chr(10) ORDER BY id), '')) AS sorted_sha256,
 coalesce(sum(('0x' || substr(sha256(id), 1, 12))::BIGINT), 0)::VARCHAR AS sum_fingerprint FROM gold""")
def gold_fingerprint(spark, sf_dir):
    return mixture.selection_fingerprint(mixture.gold_mixture(inspected(spark, sf_dir), MIXTURE))


HOLD = GOLD + """, held AS (SELECT i.*, row_number() OVER (PARTITION BY i.source_dataset ORDER BY sha256('20260712:holdout:' || i.source_dataset || ':' || i.id), i.id) AS r
 FROM insp i ANTI JOIN gold g ON i.id = g.id WHERE NOT blocking AND i.source_dataset IN ('set0', 'set3') QUALIFY r <= 2)"""


@query(f"WITH {HOLD} SELECT id, source_dataset FROM held")
def holdout_selection(spark, sf_dir):
    rows = inspected(spark, sf_dir)
    return mixture.holdout(rows, mixture.gold_mixture(rows, MIXTURE), HELD).select("id", "source_dataset")


@query(f"WITH {HOLD} SELECT count(*) AS n FROM held h SEMI JOIN gold g ON h.id = g.id")
def holdout_overlap(spark, sf_dir):
    rows = inspected(spark, sf_dir)
    chosen = mixture.gold_mixture(rows, MIXTURE)
    return mixture.overlap(mixture.holdout(rows, chosen, HELD), chosen).agg(F.count("*").alias("n"))


SHARE = RECS + r""",
t0 AS (SELECT conv_id, id, source_dataset, list_transform(list_filter(messages, lambda m: m.role <> 'system'), lambda m: {'f': CASE m.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE 'observation' END, 'v': m.content}) AS ts,
 array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'system'), lambda m: m.content), chr(10) || chr(10)) AS system FROM recs),
t1 AS (SELECT *, CASE ts[-1].f WHEN 'human' THEN 'trimmed_trailing_human_turn' WHEN 'observation' THEN 'trimmed_trailing_observation' END AS repair FROM t0),
share AS (SELECT id, source_dataset, system, repair, CASE WHEN repair IS NULL THEN ts ELSE ts[1:len(ts) - 1] END AS conv FROM t1)
"""


@query(f"""WITH {SHARE} SELECT id, source_dataset, system, '' AS tools, repair, CASE WHEN len(conv) = 0 THEN 'no turns' END AS error,
 array_to_string(list_transform(conv, lambda t: t.f || ':' || t.v), chr(10)) AS conversations FROM share""")
def sharegpt_export(spark, sf_dir):
    rows = sharegpt.export_rows(turns_as_records(spark, sf_dir))
    return rows.withColumn("conversations", F.array_join(F.transform("conversations", lambda t: F.concat_ws(":", t["from"], t["value"])), "\n"))


@query(f"WITH {SHARE} SELECT count(*) AS records, count(*) FILTER (len(conv) > 0) AS valid, count(repair) AS repaired, 0::BIGINT AS with_calls FROM share")
def sharegpt_stats(spark, sf_dir):
    return sharegpt.export_stats(sharegpt.export_rows(turns_as_records(spark, sf_dir)))


@query(f"WITH {SHARE} SELECT side, count(*) AS n FROM (SELECT unnest(conv).f AS side FROM share) GROUP BY side")
def sharegpt_sides(spark, sf_dir):
    return sharegpt.side_counts(sharegpt.export_rows(turns_as_records(spark, sf_dir)))


@query(f"WITH {SHARE} SELECT repair, count(*) AS n FROM share WHERE repair IS NOT NULL GROUP BY repair")
def sharegpt_repairs(spark, sf_dir):
    return sharegpt.repair_counts(sharegpt.export_rows(turns_as_records(spark, sf_dir)))


@query(f"""WITH {SHARE} SELECT id, source_dataset, (len(conv) - 1 + (system <> '')::INT)::INT AS prompt_messages, conv[-1].v AS label FROM share WHERE len(conv) > 0 AND conv[-1].f IN ('gpt', 'function_call')""")
def prompt_labels(spark, sf_dir):
    rows = sharegpt.prompt_and_label(sharegpt.export_rows(turns_as_records(spark, sf_dir)).where("error IS NULL"))
    return rows.select("id", "source_dataset", F.size("prompt").alias("prompt_messages"), "label")


def predictions(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Prediction rows made of events: right, misnamed, wrong arguments, doubled, broken, fenced and wrapped answers by turns."""
    e = table(spark, sf_dir, "events")
    name, args = F.col("event_type"), F.col("props")
    call = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}"))
    wrapped = F.concat(F.lit("<tool_call>\n"), call, F.lit("\n</tool_call>"))
    k = (F.col("event_id") + shift) % 8
    predict = (
        F.when(k == 0, call).when(k == 1, wrapped).when(k == 2, F.concat(F.lit("["), call, F.lit(", "), call, F.lit("]"))).when(k == 3, F.concat(F.lit('{"name": "other", "arguments": '), args, F.lit("}")))
        .when(k == 4, F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": {}}'))).when(k == 5, F.lit("sure, done")).when(k == 6, F.concat(F.lit("```json\n"), call, F.lit("\n```")))
        .otherwise(F.concat(F.lit('{"parameters": '), args, F.lit(', "name": "'), name, F.lit('"}')))
    )
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("source_dataset"), predict.alias("predict"), wrapped.alias("label"))


@query("""WITH k AS (SELECT event_id % 8 AS k FROM events), s AS (SELECT count(*) AS total, count(*) FILTER (k <> 5) AS json_valid, count(*) FILTER (k = 1) AS wrapper_valid,
 count(*) FILTER (k NOT IN (2, 5)) AS count_exact, count(*) FILTER (k NOT IN (2, 3, 5)) AS names_exact, count(*) FILTER (k IN (0, 1, 6, 7)) AS arguments_exact FROM k)
SELECT *, round(json_valid::DOUBLE / total, 6) AS json_valid_rate, round(wrapper_valid::DOUBLE / total, 6) AS wrapper_valid_rate, round(count_exact::DOUBLE / total, 6) AS count_exact_rate,
 round(names_exact::DOUBLE / total, 6) AS names_exact_rate, round(arguments_exact::DOUBLE / total, 6) AS arguments_exact_rate FROM s""")
def tool_call_scores(spark, sf_dir):
    return scoring.score(scoring.judged(predictions(spark, sf_dir, 0)))


@query("""SELECT event_id::VARCHAR AS id, event_id % 8 <> 5 AS json_valid, event_id % 8 IN (0, 1, 6, 7) AS arguments_exact FROM events WHERE event_id % 8 NOT IN (0, 1, 6, 7) ORDER BY event_id::VARCHAR LIMIT 5""")
def tool_call_failures(spark, sf_dir):
    return scoring.failures(scoring.judged(predictions(spark, sf_dir, 0)), "id").select("id", "json_valid", "arguments_exact")


@query("""WITH k AS (SELECT event_id % 8 IN (0, 1, 6, 7) AS b, (event_id + 1) % 8 IN (0, 1, 6, 7) AS a FROM events)
SELECT CASE WHEN a AND b THEN 'both_right' WHEN a THEN 'fixed' WHEN b THEN 'regressed' ELSE 'both_wrong' END AS outcome, count(*) AS n FROM k GROUP BY 1""")
def paired_outcomes(spark, sf_dir):
    return scoring.paired_outcomes(scoring.judged(predictions(spark, sf_dir, 0)), scoring.judged(predictions(spark, sf_dir, 1)))


@query("""SELECT event_type AS source_dataset, CASE WHEN user_id % 2 = 0 THEN 'agent' ELSE 'code' END AS domain,
 CASE event_id % 8 WHEN 5 THEN 'invalid_json' WHEN 2 THEN 'wrong_count' WHEN 3 THEN 'wrong_name' ELSE 'wrong_arguments' END AS cause, count(*) AS n FROM events WHERE event_id % 8 NOT IN (0, 1, 6, 7) GROUP BY ALL""")
def badcase_counts(spark, sf_dir):
    facts = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("source_dataset"), F.when(F.col("user_id") % 2 == 0, "agent").otherwise("code").alias("domain"))
    return scoring.badcases(scoring.judged(predictions(spark, sf_dir, 0)), facts)


@query("""WITH v AS (SELECT c_custkey::VARCHAR AS id, c_mktsegment AS dataset_id FROM customer),
f AS (SELECT o_custkey::VARCHAR AS id, count(*) AS files, sum(o_shippriority)::BIGINT AS bytes FROM (SELECT *, o_orderkey % 1000 AS o_shippriority FROM orders) GROUP BY 1)
SELECT id, dataset_id, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, coalesce(files, 0) AS records FROM v LEFT JOIN f USING (id)""")
def catalog_versions_with_files(spark, sf_dir):
    versions = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("dataset_id"))
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("dataset_version_id"), (F.col("o_orderkey") % 1000).alias("size_bytes"), F.lit(1).cast("long").alias("record_count"))
    return catalog.versions_with_files(versions, files)


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 5")
def catalog_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return catalog.latest(rows, 5)


def _stops(lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in documents.STOP_WORDS[lang])
    return f"len(list_filter(w, lambda x: x IN ({listed})))::BIGINT AS hits_{lang}"


WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[.,;:!?\"()|]', ' ', 'g'), '\s+'), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), h AS (SELECT doc_id, len(w)::BIGINT AS words, {", ".join(map(_stops, documents.STOP_WORDS))} FROM d),
b AS (SELECT *, greatest(hits_en, hits_fr, hits_de, hits_es) AS best FROM h)
SELECT * EXCLUDE (best), CASE WHEN best = 0 THEN 'und' WHEN hits_en = best THEN 'en' WHEN hits_fr = best THEN 'fr' WHEN hits_de = best THEN 'de' ELSE 'es' END AS lang_guess FROM b""")
def language_filter(spark, sf_dir):
    return documents.language_scores(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 200 AND 20000")
def length_filter(spark, sf_dir):
    return documents.length_filter(table(spark, sf_dir, "documents")).select("doc_id", "n_chars")


def _found(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))::BIGINT"


@query(f"""SELECT doc_id, {_found(documents.EMAIL)} AS emails, {_found(documents.IPV4)} AS ips, {_found(documents.LONG_NUMBER)} AS numbers, {_found(documents.SECRET)} AS secrets,
 length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{documents.SECRET}', '<secret>', 'g'), '{documents.EMAIL}', '<email>', 'g'), '{documents.IPV4}', '<ip>', 'g'), '{documents.LONG_NUMBER}', '<number>', 'g'))::BIGINT AS masked_chars FROM documents""")
def pii_filter(spark, sf_dir):
    return documents.pii_counts(table(spark, sf_dir, "documents"))


FORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"SELECT doc_id, length({FORM})::BIGINT AS chars, sha256({FORM}) AS form_sha256 FROM documents")
def normal_forms(spark, sf_dir):
    return documents.normal_forms(table(spark, sf_dir, "documents"))


@query(f"SELECT sha256({FORM}) AS form_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, sf_dir):
    return documents.exact_dedup(table(spark, sf_dir, "documents"))


@query(None)
def minhash_near_duplicates(spark, sf_dir):
    return documents.minhash_pairs(table(spark, sf_dir, "documents"))


@query(r"""WITH d AS (SELECT doc_id, text AS t, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, length(regexp_replace(t, '[\p{L}\p{N}\s.,;:''-]', '', 'g'))::DOUBLE / greatest(length(t), 1) AS symbol_share, 1 - len(list_distinct(ls))::DOUBLE / greatest(len(ls), 1) AS repeated_lines,
 (length(t) - len(ws) + 1)::DOUBLE / greatest(len(ws), 1) AS word_length, len(list_distinct(ws))::DOUBLE / greatest(len(ws), 1) AS distinct_words FROM d)
SELECT *, symbol_share < 0.05 AND repeated_lines < 0.5 AND word_length BETWEEN 2 AND 12 AS good FROM s""")
def quality_signals(spark, sf_dir):
    return documents.quality_signals(table(spark, sf_dir, "documents"))


@query(r"""WITH d AS (SELECT doc_id, text AS t, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, length(regexp_replace(t, '[\p{L}\p{N}\s.,;:''-]', '', 'g'))::DOUBLE / greatest(length(t), 1) < 0.05 AND 1 - len(list_distinct(ls))::DOUBLE / greatest(len(ls), 1) < 0.5
 AND (length(t) - len(ws) + 1)::DOUBLE / greatest(len(ws), 1) BETWEEN 2 AND 12 AS good FROM d)
SELECT quality, good, count(*) AS n FROM s JOIN labels USING (doc_id) GROUP BY ALL""")
def quality_gate(spark, sf_dir):
    return documents.quality_gate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("SELECT source, count(*) AS labelled, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0) AS poor FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_flags(spark, sf_dir):
    return documents.flagged_by_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _shingles(key: str, source: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i + 1:i + 13], ' ') AS s FROM (SELECT {key}, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM (SELECT {key}, {WORDS} AS w FROM {source}) WHERE len(w) > 0)"


@query(f"WITH d AS ({_shingles('doc_id', 'documents')}), b AS ({_shingles('item_id', 'benchmark')}) SELECT doc_id, count(DISTINCT item_id) AS items, count(DISTINCT s) AS shingles FROM d JOIN b USING (s) GROUP BY doc_id")
def contaminated_documents(spark, sf_dir):
    return documents.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"WITH d AS ({_shingles('doc_id', 'documents')}), b AS ({_shingles('item_id', 'benchmark')}) SELECT doc_id, n_chars FROM documents ANTI JOIN (SELECT doc_id FROM d JOIN b USING (s)) x USING (doc_id)")
def decontaminated_documents(spark, sf_dir):
    return documents.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_chars")


@query(r"""WITH d AS (SELECT source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda x: x <> ''))::BIGINT AS n FROM documents)
SELECT source, lang, count(*) AS docs, sum(n)::BIGINT AS tokens, max(n) AS largest FROM d GROUP BY ALL""")
def token_statistics(spark, sf_dir):
    return documents.token_statistics(table(spark, sf_dir, "documents"))


@query("SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 3")
def longest_by_source(spark, sf_dir):
    return documents.top_documents(table(spark, sf_dir, "documents"))


@query(None)
def ingest_sample(spark, sf_dir):
    return scan.hashed_sample(table(spark, sf_dir, "documents"), 100, 42, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id >= 20 AND doc_id < 170 AND (doc_id % 7 <> 3 OR doc_id IN (24, 31))")
def id_slices(spark, sf_dir):
    slice_ = scan.id_range(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", 20, 170)
    return slice_.where("doc_id % 7 <> 3").unionByName(scan.id_list(slice_.where("doc_id % 7 = 3"), "doc_id", [24, 31]))


#: Rows that the seeded sample draws of each language.
DRAWN = {"en": 40, "fr": 10, "de": 10, "es": 5}


@query(None)
def mt19937_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return seeded.seeded_sample(rows, DRAWN, 20260710, "source:{}", "lang", ("doc_id",), whole=True)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_events(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def orders_by_nation(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
