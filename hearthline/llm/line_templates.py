"""Line dedup by a log-template tree, in DataFrame operations only.

A line is trimmed and split at single blanks; tokens that hold a digit are variable fields and
become ``<*>``. The tree has a fixed depth: token count, then the leading tokens. Lines of one
leaf are generalised position by position: a token that fewer than ``min_docs`` lines of the
leaf share at its place is variable too. A template needs ``similarity`` of its tokens fixed.
Templates that occur in ``min_docs`` documents are dropped from all of them.

Leaves that too few documents reach are set aside before any text moves on, which leaves a small
part of the lines. Equal lines of a leaf are one row with a count, so a line that a third of all
documents share costs what a rare one does; documents are counted from distinct (template,
document) pairs with map-side combining. Equal texts are one document here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import stage, table

FIELD = "<*>"
LEADING = 3


def masked(line: Column) -> Column:
    """The trimmed line with tokens that hold a digit generalised."""
    line = F.trim(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ 0-9]*[0-9][^ ]*", FIELD)).otherwise(line)


def recurring_lines(docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, similarity: float = 0.5) -> DataFrame:
    """``tid`` (hash of a text) and ``drop``: the numbers, from 0, of its lines to drop."""
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("tid"), "text")
    lines = texts.select("tid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("tid", "pos", masked(F.col("line")).alias("line"))
    tokens = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n", tokens).where(F.col("n") >= min_tokens)
    lines = lines.withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", LEADING)))

    leaves = lines.select("leaf", "tid").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs)
    reached = lines.join(leaves.select("leaf"), "leaf", "left_semi")
    reached = stage(reached.select("leaf", "tid", "pos", "n", F.xxhash64("line").alias("key"), "line"), "reached-lines")

    kinds = reached.select("leaf", "key", "tid", "n", "line").groupBy("leaf", "key", "tid").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    kinds = kinds.groupBy("leaf", "key").agg(F.count(F.lit(1)).alias("docs"), F.first("line").alias("line"), F.first("n").alias("n"))
    parts = kinds.select("leaf", "key", "n", "docs", F.posexplode(F.split("line", " ")).alias("place", "token"))
    common = parts.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("lines")).where(F.col("lines") >= min_docs)
    fixed = parts.join(common.select("leaf", "place", "token", F.lit(True).alias("common")), ["leaf", "place", "token"], "left")
    is_fixed = F.col("common").isNotNull() & (F.col("token") != FIELD)
    templates = fixed.groupBy("leaf", "key").agg(
        F.first("n").alias("n"), F.sum(is_fixed.cast("int")).alias("n_fixed"),
        F.sort_array(F.collect_list(F.struct("place", F.when(is_fixed, F.col("token")).otherwise(F.lit(FIELD)).alias("token")))).alias("parts"),
    ).where(F.col("n_fixed") >= F.col("n") * similarity)
    templates = templates.select("leaf", "key", F.xxhash64(F.transform("parts", lambda p: p.token)).alias("template"))

    placed = reached.select("leaf", "key", "tid", "pos").join(templates, ["leaf", "key"])
    many = placed.select("leaf", "template", "tid").distinct().groupBy("leaf", "template").count().where(F.col("count") >= min_docs)
    found = placed.join(many.select("leaf", "template"), ["leaf", "template"], "left_semi")
    return found.groupBy("tid").agg(F.collect_set("pos").alias("drop"))


def drop_recurring(docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, similarity: float = 0.5) -> DataFrame:
    """``docs`` with lines of recurring templates taken out of ``text``, and n_lines, n_dropped.

    A null text stays null with no lines; a text without such lines stays as it is; one of which
    all lines go becomes empty. Repeated rows give repeated results. Columns named n_lines or
    n_dropped are replaced, all others stay.
    """
    found = recurring_lines(docs, min_docs, min_tokens, similarity).withColumnRenamed("tid", "_tid").withColumnRenamed("drop", "_drop")
    hashed = docs.withColumn("_tid", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, k: ~F.array_contains(F.col("_drop"), k))
    joined = hashed.join(found, "_tid", "left")
    counted = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    counted = counted.withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
    done = counted.withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return done.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


ORACLE = r"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
lines AS (SELECT text, pos, regexp_replace(trim(line, ' '), '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS line FROM raw),
leafed AS (SELECT text, pos, line, string_split(line, ' ') AS tokens, len(string_split(line, ' ')) AS n,
  array_to_string(string_split(line, ' ')[1:3], ' ') AS lead FROM lines WHERE len(string_split(line, ' ')) >= 3),
leaves AS (SELECT n, lead FROM leafed GROUP BY ALL HAVING count(DISTINCT text) >= 5),
reached AS (SELECT * FROM leafed SEMI JOIN leaves USING (n, lead)),
kinds AS (SELECT n, lead, line, any_value(tokens) AS tokens, count(DISTINCT text) AS docs FROM reached GROUP BY n, lead, line),
parts AS (SELECT n, lead, line, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM kinds),
common AS (SELECT n, lead, place, token FROM parts GROUP BY ALL HAVING sum(docs) >= 5),
marked AS (SELECT p.*, c.token IS NOT NULL AND p.token <> '<*>' AS fixed FROM parts p LEFT JOIN common c USING (n, lead, place, token)),
templates AS (SELECT n, lead, line, list(CASE WHEN fixed THEN token ELSE '<*>' END ORDER BY place) AS template
  FROM marked GROUP BY n, lead, line HAVING count(*) FILTER (fixed) >= n * 0.5),
placed AS (SELECT text, pos, n, lead, template FROM reached JOIN templates USING (n, lead, line)),
many AS (SELECT n, lead, template FROM placed GROUP BY ALL HAVING count(DISTINCT text) >= 5),
gone AS (SELECT text, pos FROM placed SEMI JOIN many USING (n, lead, template)),
kept AS (SELECT r.text, string_agg(r.line, chr(10) ORDER BY r.pos) AS left_text FROM raw r ANTI JOIN gone g USING (text, pos) GROUP BY r.text),
counts AS (SELECT text, count(*) AS n_dropped FROM gone GROUP BY text)
SELECT d.doc_id, CASE WHEN c.n_dropped IS NULL THEN d.text ELSE coalesce(k.left_text, '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(c.n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN counts c ON d.text = c.text LEFT JOIN kept k ON d.text = k.text
"""
