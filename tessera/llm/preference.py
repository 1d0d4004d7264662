"""Preference formatting: one prompt, two masked completions.

A pair has a chosen and a rejected conversation. The turns that both begin with (same role, same
text) are rendered once as the prompt; what follows is rendered on either side as a completion with a
mask of equal length: '1' on the characters that training learns (an assistant's text and its end
mark), '0' elsewhere. DataFrame functions only.

Defined results: turns are ordered by turn, role, text, and turns that repeat each stand; whole texts are
rendered, however long; other columns, whatever their names, are not read; two empty tables give none; null role reads 'unknown', null text is
empty; turns without a pair are dropped; a pair that one side lacks has an empty completion there;
equal conversations have two empty completions. Marks inside texts are broken by a space, so a text
cannot open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import table

#: Fixed values of the rendered format.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def safe(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def masked(turn: Column) -> Column:
    head = F.length(turn["role"]) + len(OPEN + CLOSE)
    body = F.length(turn["text"]) + len(END)
    return F.concat(F.repeat(F.lit("0"), head), F.repeat(F.when(turn["role"] == "assistant", "1").otherwise("0"), body))


def gathered(turns: DataFrame, side: str) -> DataFrame:
    """One row a pair: its turns in order."""
    text = safe(F.coalesce("text", F.lit("")))
    turn = F.struct(F.col("turn"), safe(F.coalesce("role", F.lit("unknown"))).alias("role"), text.alias("text"))
    return turns.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.array_sort(F.collect_list(turn)).alias(side))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prefix, prompt, chosen, rejected and their masks, from turns (pair_id, turn, role, text)."""
    both = gathered(chosen, "c").join(gathered(rejected, "r"), "pair_id", "full")
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = both.select("pair_id", F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    both = both.withColumn("n_prefix", F.when(differs > 0, differs - 1).otherwise(shorter))
    rest = lambda side: F.slice(side, F.col("n_prefix") + 1, F.greatest(F.size(side) - F.col("n_prefix"), F.lit(0)))
    said = lambda turns, how: F.array_join(F.transform(turns, how), "")
    return both.select(
        "pair_id",
        "n_prefix",
        said(F.slice("c", F.lit(1), F.col("n_prefix")), rendered).alias("prompt"),
        said(rest("c"), rendered).alias("chosen"),
        said(rest("r"), rendered).alias("rejected"),
        said(rest("c"), masked).alias("chosen_mask"),
        said(rest("r"), masked).alias("rejected_mask"),
    )


def with_other_answer(turns: DataFrame) -> DataFrame:
    """Rejected side for a table of conversations: the last assistant turn gives way to that of the
    neighbour conversation (ids 2k and 2k+1 are neighbours), or to an empty one if there is none."""
    answers = turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max_by(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")), F.struct("turn", F.coalesce("text", F.lit("")))).alias("a"))
    other = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("a.text").alias("other"))
    last = answers.select("conv_id", F.col("a.turn").alias("at"), F.col("a.text").alias("was")).join(other, "conv_id", "left")
    put = (F.col("role") == "assistant") & (F.col("turn") == F.col("at")) & (F.coalesce("text", F.lit("")) == F.col("was"))
    joined = turns.join(last, "conv_id", "left")
    return joined.select("conv_id", "turn", "role", F.when(put, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_preferences(turns.withColumnRenamed("conv_id", "pair_id"), with_other_answer(turns).withColumnRenamed("conv_id", "pair_id"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(replace(role, '<|', '< |'), 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (
  SELECT conv_id, turn AS at, text AS was FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM t WHERE role = 'assistant') WHERE k = 1),
r AS (
  SELECT t.conv_id, t.turn, t.role,
         CASE WHEN t.role = 'assistant' AND t.turn = a.at AND t.text = a.was THEN coalesce(o.was, '') ELSE t.text END AS text
  FROM t LEFT JOIN a ON a.conv_id = t.conv_id LEFT JOIN a o ON o.conv_id = xor(t.conv_id, 1)),
cn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
rn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM r),
p AS (
  SELECT cn.conv_id, coalesce(min(cn.k) FILTER (WHERE cn.role <> rn.role OR cn.text <> rn.text) - 1, count(*)) AS n
  FROM cn JOIN rn ON cn.conv_id = rn.conv_id AND cn.k = rn.k GROUP BY cn.conv_id),
x AS (
  SELECT 'c' AS side, conv_id, k, role, text FROM cn UNION ALL SELECT 'r', conv_id, k, role, text FROM rn),
y AS (
  SELECT x.*, p.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said,
         repeat('0', length(role) + 5) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, length(text) + 8) AS mask
  FROM x JOIN p USING (conv_id))
SELECT conv_id AS pair_id, CAST(any_value(n) AS INTEGER) AS n_prefix,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= n), '') AS prompt,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE side = 'c' AND k > n), '') AS chosen,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE side = 'r' AND k > n), '') AS rejected,
       coalesce(string_agg(mask, '' ORDER BY k) FILTER (WHERE side = 'c' AND k > n), '') AS chosen_mask,
       coalesce(string_agg(mask, '' ORDER BY k) FILTER (WHERE side = 'r' AND k > n), '') AS rejected_mask
FROM y GROUP BY conv_id
"""
