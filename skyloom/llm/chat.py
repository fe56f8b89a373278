"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, each time a few turns longer.
A rolling hash over the turns identifies every prefix; a conversation whose whole
hash is a proper prefix of another is dropped by an anti-join, equal ones keep
the smallest id, and what remains is rendered as one training string.

Two 64-bit hashes with different seeds stand for a prefix.  Each turn is hashed
with its position and the hashes are combined by exclusive or, so the running
value is an ordinary window aggregate.

Edge cases: turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows have one order; null roles render as ``unknown`` and null texts as
nothing (and equal only nulls when prefixes are compared); rows without a
conversation id are ignored; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rendering of a turn, and of the end of a turn.
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row for each turn with its position and the hashes of the prefix it ends."""
    order = Window.partitionBy("x_conv").orderBy(F.col("x_turn").asc_nulls_first(), F.col("x_role").asc_nulls_first(), F.col("x_text").asc_nulls_first())
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("x_conv"), F.col(turn_col).alias("x_turn"), F.col(role_col).alias("x_role"), F.col(text_col).alias("x_text"))
    placed = rows.withColumn("x_n", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def hashed(seed: int):
        parts = [F.lit(seed), F.col("x_n"), F.col("x_role").isNull(), F.col("x_role"), F.col("x_text").isNull(), F.col("x_text")]
        return F.bit_xor(F.xxhash64(*parts)).over(running)

    return placed.withColumn("x_h1", hashed(1)).withColumn("x_h2", hashed(2))


def collapse_and_render(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Maximal conversations: ``conv_id, n_turns long, n_copies long, rendered string``.

    ``n_copies`` counts the conversations that are equal to the kept one.
    """
    prefixes = prefix_hashes(turns, conv_col, turn_col, role_col, text_col)
    hashes = prefixes.select("x_conv", "x_n", "x_h1", "x_h2")
    whole = hashes.groupBy("x_conv").agg(F.max(F.struct("x_n", "x_h1", "x_h2")).alias("x_last")).select("x_conv", "x_last.*")
    distinct = whole.groupBy("x_n", "x_h1", "x_h2").agg(F.min("x_conv").alias("x_conv"), F.count("*").alias("n_copies"))
    inner = hashes.withColumn("x_next", F.lead("x_n").over(Window.partitionBy("x_conv").orderBy("x_n"))).where(F.col("x_next").isNotNull())
    proper = inner.groupBy("x_n", "x_h1", "x_h2").agg(F.count("*").alias("x_seen"))
    kept = distinct.join(proper, ["x_n", "x_h1", "x_h2"], "left_anti").select("x_conv", "n_copies")
    line = F.concat(F.lit(TURN_OPEN), F.coalesce("x_role", F.lit("unknown")), F.lit("\n"), F.coalesce("x_text", F.lit("")), F.lit(TURN_CLOSE + "\n"))
    ordered = prefixes.select("x_conv", "x_n", line.alias("x_line")).join(kept, "x_conv")
    return ordered.groupBy("x_conv").agg(F.count("*").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("x_n", "x_line"))).alias("x_lines")).select(
        F.col("x_conv").alias(conv_col), "n_turns", "n_copies", F.array_join(F.transform("x_lines", lambda x: x["x_line"]), "").alias("rendered")
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations of ``conversations``, rendered."""
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
WITH placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
                FROM conversations WHERE conv_id IS NOT NULL),
prefixes AS (SELECT conv_id, n, CAST(list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY n) AS VARCHAR) AS p FROM placed),
lengths AS (SELECT conv_id, max(n) AS total FROM placed GROUP BY 1),
whole AS (SELECT conv_id, total, p FROM prefixes JOIN lengths USING (conv_id) WHERE n = total),
proper AS (SELECT DISTINCT p FROM prefixes JOIN lengths USING (conv_id) WHERE n < total),
kept AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM whole WHERE p NOT IN (SELECT p FROM proper) GROUP BY p)
SELECT conv_id, count(*) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY n) AS rendered
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id
"""
