"""Line dedup by a log-template tree, in DataFrame expressions alone.

A line's tokens are its lower-cased words; those that hold digits, if they are no more than half, are
variable from the start. The tree has a fixed depth: number of tokens, the leading tokens, and then
``splits`` levels that part the lines that fit no template yet by the token that most of them share. In a
group, the places where most distinct lines agree are the template's constants and the others its
variable fields; a line near enough to them takes that template. A line that no group's template takes
is its own. A template that recurs in several texts is dropped wherever it stands, but for one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import alike
from .common import BROADCAST_NUMBERS, CONTENT, content_numbers, cut_lineage, join_counted

VARIABLE = "<*>"
#: Words of 64 bits in which texts that lose lines are marked; so many rows are broadcast at most.
WORDS = 1 << 18
#: A token that holds a digit.
HOLED = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def lines_of(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """A row per line that isn't blank: text's numbers, place, tokens ``n``, form, leaf, and two hashes ``a, b`` of the form.

    A line's form is its tokens with one blank between them. Columns that several others use are made one
    after the other, as the planner would else compute them anew for each.
    """
    t = F.col(text)
    odd = reduce(Column.__or__, (t.contains(x) for x in ("  ", "\t", "\r", "\x0b", "\x0c")))
    texts = docs.where(t.isNotNull()).select(*content_numbers(t), odd.alias("odd"), F.split(F.lower(t), "\n").alias("lines"))
    # outer, though no text is without lines: else the planner splits it once more to see that it has some
    lines = texts.select(*CONTENT, "odd", F.posexplode_outer("lines").alias("place", "line"))
    spaced = F.trim(F.when(F.col("odd"), F.regexp_replace("line", r"\s+", " ")).otherwise(F.col("line")))
    rows = lines.select(*CONTENT, "place", spaced.alias("spaced")).where("spaced <> ''")
    words = F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1
    counted = rows.select(*CONTENT, "place", "spaced", words.alias("n"))
    # a line that is mostly numbers has too few constants to be a template
    sparse = F.regexp_count("spaced", F.lit(HOLED)) * 2 <= F.col("n")
    form = F.when(F.col("spaced").rlike("[0-9]") & sparse, F.regexp_replace("spaced", HOLED, VARIABLE)).otherwise(F.col("spaced"))
    formed = counted.select(*CONTENT, "place", "n", form.alias("form"))
    leaf = F.xxhash64("n", F.substring_index("form", " ", depth))
    return formed.select("*", leaf.alias("leaf"), F.xxhash64("form").alias("a"), F.xxhash64(F.lit(1), "form").alias("b"))


def group_templates(lines: DataFrame, similar: float) -> DataFrame:
    """``lines`` (``g, a, b, tokens``) with ``taken``: whether a line takes its group's template.

    A place is constant if more than half of the group's lines, and two at least, have the same token there.
    Groups are dealt out whole, once, and vote where they are; hot ones send votes, so that none of them gathers in a task.
    """
    sizes = cut_lineage(lines.groupBy("g").agg(F.count("*").alias("lines")).where("lines > 1"))
    total = sizes.agg(F.sum("lines")).first()[0] or 0
    hot = sizes.where(F.col("lines") * alike.HOT_SHARE > total)

    def voted(some: DataFrame) -> DataFrame:
        return some.select("g", F.posexplode("tokens").alias("i", "t")).groupBy("g", "i", "t").agg(F.count("*").alias("votes")).where("votes >= 2")

    def gathered(constants: DataFrame, *more: Column) -> DataFrame:
        # a group has one constant for each place at most
        return constants.where("votes * 2 > size").groupBy("g").agg(*more, F.collect_list(F.struct("i", "t")).alias("constants"))

    def marked(met: DataFrame) -> DataFrame:
        hits = F.size(F.filter("constants", lambda c: F.get("tokens", c["i"]) == c["t"]))
        return met.select("g", "a", "b", "tokens", F.coalesce(hits >= similar * F.size("tokens"), F.lit(False)).alias("taken"))

    many = hot.count()
    cold = (lines.join(F.broadcast(hot.select("g")), "g", "left_anti") if many else lines).repartition("g")
    out = marked(cold.join(gathered(voted(cold).join(cold.groupBy("g").agg(F.count("*").alias("size")), "g")), "g", "left"))
    if not many:
        return out
    warm = lines.join(F.broadcast(hot.select("g")), "g")
    templates = gathered(join_counted(voted(warm), hot.withColumn("size", F.col("lines")), ["g"], "lines"), F.first("size").alias("lines"))
    return out.unionByName(marked(join_counted(warm, cut_lineage(templates), ["g"], "lines", "left")))


def split_groups(lines: DataFrame, depth: int) -> DataFrame:
    """``lines`` with their next group: that of the token, behind the leading ones, that most lines of the group share.

    Ties go to the first place. A token that all lines of a group have parts nothing; lines that share no other are left out.
    """
    single = lines.select("g", "a", "b", F.posexplode("tokens").alias("i", "t")).where(F.col("i") >= depth)
    sizes = cut_lineage(lines.groupBy("g").agg(F.count("*").alias("lines")).where("lines > 1"))
    votes = single.groupBy("g", "i", "t").agg(F.count("*").alias("votes")).where("votes >= 2")
    parting = cut_lineage(join_counted(votes, sizes.withColumn("size", F.col("lines")), ["g"], "lines").where("votes < size").select("g", "i", "t", "votes", F.col("votes").alias("v")))
    top = 1 << 24  # more tokens than a line has; votes and place in one number are aggregated without a sort
    best = join_counted(single, parting, ["g", "i", "t"], "votes").groupBy("a", "b").agg(F.max(F.col("v") * top + (top - 1 - F.col("i"))).alias("best"))
    place = (F.lit(top - 1) - F.col("best") % top).cast("int")
    named = lines.join(best, ["a", "b"]).withColumn("i", place)
    return named.select(F.xxhash64("g", "i", F.get("tokens", F.col("i"))).alias("g"), "a", "b", "tokens")


def line_templates(docs: DataFrame, shared: DataFrame, text: str, depth: int, similar: float, least: int, splits: int) -> DataFrame:
    """``a, b, g`` of the lines that take a template, that of group ``g``.

    ``shared`` has the lines of leaves that several texts have. Only leaves of two or more different lines
    are opened, and each different line once.
    """
    leaves = shared.where(F.col("n") >= least).groupBy("leaf").agg(F.min("a").alias("x"), F.max("a").alias("y"), F.count("*").alias("rows"))
    leaves = cut_lineage(leaves.where("x <> y").select("leaf", "rows"))
    forms = join_counted(lines_of(docs, text, depth).where(F.col("n") >= least), leaves, ["leaf"], "rows", few=BROADCAST_NUMBERS).select("leaf", "a", "b", "form").distinct()
    rest = cut_lineage(forms.select(F.col("leaf").alias("g"), "a", "b", F.transform(F.split("form", " "), lambda x: F.xxhash64(x)).alias("tokens")))
    found = []
    for level in range(splits + 1):
        tried = cut_lineage(group_templates(rest, similar))
        found.append(tried.where("taken").select("a", "b", "g"))
        if level < splits:
            rest = cut_lineage(split_groups(tried.where("NOT taken"), depth))
    return reduce(DataFrame.union, found)


def dropped_lines(docs: DataFrame, text: str = "text", depth: int = 3, similar: float = 0.8, least: int = 5, texts: int = 2, splits: int = 2) -> DataFrame:
    """``c1, c2, places, n``: the lines of each text whose template recurs elsewhere, and how many rows have the text."""
    keys = cut_lineage(lines_of(docs, text, depth).drop("form"))
    several = keys.groupBy("leaf").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in CONTENT for f in (F.min, F.max)), F.count("*").alias("rows"))
    several = cut_lineage(several.where("min_c1 <> max_c1 OR min_c2 <> max_c2").select("leaf", "rows"))
    shared = join_counted(keys, several, ["leaf"], "rows", few=BROADCAST_NUMBERS)
    found = line_templates(docs, shared, text, depth, similar, least, splits)
    # a line can only recur if it takes a template or stands in several texts itself
    forms = shared.groupBy("a", "b").agg(F.count("*").alias("rows"), *(f(c).alias(f"{f.__name__}_{c}") for c in CONTENT for f in (F.min, F.max)))
    forms = forms.join(found, ["a", "b"], "left").where("g IS NOT NULL OR min_c1 <> max_c1 OR min_c2 <> max_c2")
    forms = cut_lineage(forms.select("a", "b", "rows", F.coalesce("g", "a").alias("s"), F.when(F.col("g").isNull(), F.col("b")).otherwise(0).alias("t")))
    named = join_counted(shared.select(*CONTENT, "place", "a", "b"), forms, ["a", "b"], "rows").select(*CONTENT, "place", "s", "t")
    # a text's repeats are folded first, so that a template's texts are counted, not its lines
    per_text = named.groupBy("s", "t", *CONTENT).agg(F.min("place").alias("place"), F.count("*").alias("rows"))
    recurring = per_text.groupBy("s", "t").agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"), F.min(F.struct(*CONTENT, "place")).alias("first"))
    recurring = cut_lineage(recurring.where(F.col("texts") >= texts).select("s", "t", "rows", "first"))
    gone = join_counted(named, recurring, ["s", "t"], "rows").where(F.struct(*CONTENT, "place") != F.col("first"))
    # each copy of a text has sent its places once
    return gone.groupBy(*CONTENT).agg(F.collect_set("place").alias("places"), F.count("*").alias("sent")).select(*CONTENT, "places", F.expr("sent div size(places)").alias("n"))


def join_marked(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``keys``, the first of which is a hash; column ``n`` tells how many rows have a key, and goes.

    The table's keys are marked in a field of bits, which is broadcast. Rows without a mark have no match
    and those of hot keys meet a broadcast one; the others alone are shuffled, those marked by chance included.
    """
    bit, word = (F.col(keys[0]) % 64).cast("int"), F.shiftright(keys[0], 6) % WORDS
    marks = table.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bits"))
    marks = cut_lineage(marks.groupBy("__word").agg(F.bit_or("__bits").alias("__bits")))
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.where(F.col(n) * alike.HOT_SHARE > total).drop(n)
    marked = rows.withColumn("__word", word).join(F.broadcast(marks), "__word", "left")
    marked = marked.withColumn("__met", F.coalesce(F.call_function("shiftrightunsigned", "__bits", bit).bitwiseAND(1) == 1, F.lit(False))).drop("__word", "__bits")
    known = marked.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    here = known.where("NOT __met OR __hot").drop("__met", "__hot")
    apart = marked.where("__met").drop("__met").join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return here.unionByName(apart.join(table.drop(n), keys, "left"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", counts: bool = False, **options) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``; all rows and columns stay.

    A template recurs if lines of ``texts`` different texts take it; copies of one text count once and
    keep the same lines. One place, the first line of the text with the smallest MD5, keeps it. ``depth`` leading
    tokens and the token count lead to a leaf; ``similar`` is the share of a line's places that must be
    the template's constants, for lines of ``least`` tokens or more; shorter lines only match themselves.
    A leaf holds one template and, for lines that don't fit it, ``splits`` more levels of groups.
    Blank lines are never dropped; null texts stay null; a text whose lines all go becomes empty. With
    ``counts``, columns ``n_lines`` and ``n_dropped`` are added (in place of such columns). Key columns
    of ``docs`` may be null or repeat. An empty table gives an empty result.
    """
    gone = cut_lineage(dropped_lines(docs.select(text), text, **options))
    names = ["__c1", "__c2", "__places", "__n"]
    numbered = docs.select("*", *(c.alias(n) for c, n in zip(content_numbers(F.col(text)), names)))
    joined = join_marked(numbered, gone.toDF(*names), names[:2], "__n")
    pieces = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), "__places")
    # the text is split once, and its lines taken by number
    kept = F.get(F.transform(F.array(pieces), lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), "\n")), 0)
    changed = F.when(F.col("__places").isNull(), F.col(text)).otherwise(kept)
    added = {"n_lines": F.coalesce(F.size(pieces), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size("__places"), F.lit(0)).cast("long")} if counts else {}
    columns = [changed.alias(c) if c == text else F.col(c) for c in docs.columns if c not in added]
    return joined.select(*columns, *(c.alias(n) for n, c in added.items()))


def line_digest(documents: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every document."""
    return drop_recurring_lines(documents.select("doc_id", "text"), counts=True)


def _levels(splits: int) -> str:
    """SQL of the levels below the leaf: the lines of group level k are ``lines{k}``, those that take a template ``close{k}``."""
    out = ""
    for k in range(splits + 1):
        out += f"""
single{k} AS (SELECT grp, tokens, n, unnest(tokens) AS token, unnest(range(n)) AS i FROM lines{k}),
sizes{k} AS (SELECT grp, count(*) AS lines FROM lines{k} GROUP BY grp),
votes{k} AS (SELECT grp, i, token, count(*) AS votes FROM single{k} GROUP BY ALL),
constants{k} AS (SELECT grp, i, token FROM votes{k} JOIN sizes{k} USING (grp) WHERE votes >= 2 AND votes * 2 > lines),
close{k} AS MATERIALIZED (SELECT grp, tokens FROM single{k} JOIN constants{k} USING (grp, i, token) GROUP BY grp, tokens, n HAVING count(*) >= CAST(0.8 AS DOUBLE) * n),"""
        if k < splits:
            out += f"""
rest{k} AS MATERIALIZED (SELECT l.* FROM lines{k} l ANTI JOIN close{k} c ON l.grp = c.grp AND l.tokens = c.tokens),
apart{k} AS (SELECT grp, tokens, n, unnest(tokens) AS token, unnest(range(n)) AS i FROM rest{k}),
left{k} AS (SELECT grp, count(*) AS lines FROM rest{k} GROUP BY grp),
parting{k} AS (SELECT grp, i, token, votes FROM (SELECT grp, i, token, count(*) AS votes FROM apart{k} WHERE i >= 3 GROUP BY ALL) JOIN left{k} USING (grp) WHERE votes >= 2 AND votes < lines),
lines{k + 1} AS MATERIALIZED (SELECT grp || ' ' || best.i || ' ' || best.token AS grp, tokens, n FROM
  (SELECT grp, tokens, n, arg_max({{'i': i, 'token': token}}, votes * 16777216 - i) AS best FROM apart{k} JOIN parting{k} USING (grp, i, token) GROUP BY grp, tokens, n)),"""
    return out


#: DuckDB SQL for ``line_digest`` with its default parameters.
ORACLE = rf"""
WITH docs AS (SELECT doc_id, text, substr(md5(text), 1, 30) AS content FROM documents),
texts AS (SELECT DISTINCT content, text FROM docs WHERE text IS NOT NULL),
pieces AS (SELECT content, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM texts),
plain AS (SELECT content, place, string_split(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), ' ') AS w FROM pieces WHERE regexp_matches(line, '\S')),
words AS (SELECT content, place, CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) * 2 <= len(w)
  THEN list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) ELSE w END AS tokens FROM plain),
keyed AS MATERIALIZED (SELECT content, place, tokens, len(tokens) AS n, (len(tokens) || ' ' || array_to_string(tokens[1:3], ' ')) AS leaf FROM words),
leaves AS (SELECT leaf FROM keyed GROUP BY leaf HAVING min(content) <> max(content)),
lines0 AS MATERIALIZED (SELECT DISTINCT leaf AS grp, tokens, n FROM keyed WHERE n >= 5 AND leaf IN (SELECT leaf FROM leaves)),{_levels(2)}
close AS (SELECT grp, tokens FROM close0 UNION ALL SELECT grp, tokens FROM close1 UNION ALL SELECT grp, tokens FROM close2),
named AS (SELECT k.content, k.place, CASE WHEN c.grp IS NULL THEN '=' || array_to_string(k.tokens, ' ') ELSE '~' || c.grp END AS template
  FROM keyed k LEFT JOIN close c ON k.tokens = c.tokens),
per_text AS (SELECT template, content, min(place) AS place FROM named GROUP BY ALL),
recurring AS (SELECT template, min(content) AS c, arg_min(place, content) AS p FROM per_text GROUP BY template HAVING count(*) >= 2),
gone AS (SELECT n.content, n.place FROM named n JOIN recurring r USING (template) WHERE n.content <> r.c OR n.place <> r.p),
kept AS (SELECT p.content, string_agg(p.line, chr(10) ORDER BY p.place) AS text FROM pieces p ANTI JOIN gone g ON p.content = g.content AND p.place = g.place GROUP BY p.content),
counted AS (SELECT content, count(*) AS n_dropped FROM gone GROUP BY content)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(c.n_dropped, 0) AS BIGINT) AS n_dropped
FROM docs d LEFT JOIN kept k USING (content) LEFT JOIN counted c USING (content)
"""
