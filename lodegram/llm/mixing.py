"""Mixing sources to target weights by Efraimidis-Spirakis sampling to token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegram.llm.common import FILE, ROW, repeat_rows, saved, stored, with_row_key, write_side

SEED = "mix-1"
#: A source's target weight is its share of tokens to this power, unless weights are given.
TEMPERATURE = 0.5
#: Tokens to draw in all, as a share of those there are.
BUDGET = 1.0
#: A document's quality weight by its label; unlabelled ones have 1.
GOOD, BAD = 2.0, 0.5
#: Keys are cut in so many ranges for the prefix sums, so that no task sorts a whole source.
RANGES = 4096


def mixture(spark: SparkSession, docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """FILE, ROW, doc_id, source, n_tokens, copies: how often each row of docs is drawn.

    Tokens are the runs of other than white space. A source's budget is its target weight's share of
    budget times all tokens. It holds as many complete epochs as fit; the rest is filled in order of
    the exponential key -ln(u)/w, u from a hash of doc_id, w the quality weight, as long as the sum
    of tokens is within it. Ties go by doc_id, then file and row; repeated rows count as rows. A null
    text has no token and is drawn with the complete epochs, or where its key comes within the
    budget; a null source is a source of its own; a null doc_id has a key like any other. Several
    labels of a document are averaged, null ones left out. Sources that weights doesn't name get none.
    """
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0b]+")), F.lit(0)).cast("long")
    rows = with_row_key(docs, ["doc_id", "source", "text"]).select(FILE, ROW, "doc_id", "source", tokens.alias("n_tokens"))
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    rows = rows.join(quality, "doc_id", "left")
    weight = F.coalesce(F.when(F.col("q") >= 0.5, GOOD).when(F.col("q") < 0.5, BAD), F.lit(1.0))
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = rows.select(FILE, ROW, "doc_id", "source", "n_tokens", (-F.log(u) / weight).alias("key"))
    span = F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int")
    rows = saved(rows.withColumn("span", span), "keys")

    spans = rows.groupBy("source", "span").agg(F.sum("n_tokens").alias("n"))
    of = W.partitionBy("source")
    spans = spans.withColumns({"total": F.sum("n").over(of), "before": F.sum("n").over(of.orderBy("span").rowsBetween(W.unboundedPreceding, -1))})
    totals = spans.groupBy("source").agg(F.max("total").alias("total"))
    if weights is None:
        share = F.pow(F.col("total").cast("double"), F.lit(TEMPERATURE)) if TEMPERATURE != 0.5 else F.sqrt(F.col("total").cast("double"))
    else:
        share = F.coalesce(F.create_map([F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    totals = totals.select(F.col("source").alias("s"), "total", share.alias("w"))
    sums = totals.agg(F.sum("w").alias("all_w"), F.sum("total").alias("all_n"))
    goal = F.floor(F.coalesce(F.try_divide(F.lit(budget) * F.col("all_n") * F.col("w"), F.col("all_w")), F.lit(0.0))).cast("long")
    goals = totals.crossJoin(sums).select("s", "total", goal.alias("goal"))
    epochs = F.when(F.col("total") > 0, F.floor(F.col("goal") / F.col("total"))).otherwise(0).cast("long")
    goals = goals.select("s", epochs.alias("epochs"), (F.col("goal") - epochs * F.col("total")).alias("rest"))
    spans = spans.join(goals, spans["source"].eqNullSafe(goals["s"])).select(F.col("source").alias("s"), F.col("span").alias("sp"), F.coalesce("before", F.lit(0)).alias("before"), "epochs", "rest")

    order = W.partitionBy("source", "span").orderBy("key", F.col("doc_id").asc_nulls_last(), FILE, ROW).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("n_tokens").over(order))
    rows = rows.join(spans, rows["source"].eqNullSafe(spans["s"]) & (rows["span"] == spans["sp"]))
    copies = (F.col("epochs") + (F.col("before") + F.col("upto") <= F.col("rest")).cast("long")).alias("copies")
    return rows.select(FILE, ROW, "doc_id", "source", "n_tokens", copies)


def mix_sources(spark: SparkSession, docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """docs with each row as many times as mixture() draws it; columns and texts as they were."""
    docs = stored(docs)
    drawn = mixture(spark, docs, labels, weights, budget).select(FILE, ROW, "copies")
    return repeat_rows(docs, write_side(drawn, "mix", docs), "copies", 0)


ORACLE = f"""
WITH q AS (SELECT doc_id, avg(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
rows_ AS (
  SELECT d.doc_id, d.source,
         coalesce(len(list_filter(regexp_split_to_array(d.text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')), 0)::BIGINT AS n_tokens,
         -ln((('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}.0)
           / CASE WHEN q.q >= 0.5 THEN {GOOD} WHEN q.q < 0.5 THEN {BAD} ELSE 1.0 END AS key
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS total, sqrt(sum(n_tokens)::DOUBLE) AS w FROM rows_ GROUP BY source),
goals AS (SELECT source, total, floor({BUDGET} * (SELECT sum(total) FROM totals) * w / (SELECT sum(w) FROM totals))::BIGINT AS goal FROM totals),
sums AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM rows_)
SELECT s.doc_id, s.source, s.n_tokens,
       (CASE WHEN total > 0 THEN goal // total ELSE 0 END
        + CASE WHEN upto <= goal - (CASE WHEN total > 0 THEN goal // total ELSE 0 END) * total THEN 1 ELSE 0 END)::BIGINT AS copies
FROM sums s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
"""
