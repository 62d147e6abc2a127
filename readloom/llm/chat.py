"""Multi-party perspective rotation of dialogues, in DataFrame operations alone.

For every participant of a conversation (each distinct role but `system`; a null role is the speaker `unknown`) the dialogue is rendered
with that speaker as the assistant and all others as named users; the mask has the spans of the assistant's words and end marks,
the only ones a model should learn from. System turns stay system turns.

A dialogue comes as chunks of at most 256 turns; chunk after chunk they are the whole dialogue, and spans count from the
chunk's start. So a conversation of any length is never gathered in one row: turns get their positions from a range-partitioned
sort and sums of counts, and a chunk alone is gathered.

Defined results: turns are ordered by turn (nulls first), role, text; a null text is empty; a null conv_id is a conversation of its own;
repeated turns are all kept; a conversation of system turns alone gives no rows; control marks in texts and names are broken by a space; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import written

CHUNK = 256


def positions(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with _pos, the place in the conversation; no task holds a whole conversation."""
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    parts = max(2, turns.rdd.getNumPartitions())
    dealt = turns.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by, F.col("_tie")).sortWithinPartitions(*by, "_tie")
    ranked = written(dealt.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "turns")
    runs = ranked.groupBy("conv_id", "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_run"), "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = ranked.join(runs, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_run")))
    return joined.select("conv_id", "turn", "role", "text", (F.col("_at") - F.col("_low") + F.col("_before")).alias("_pos"))


def rotate(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation, participant and chunk: the rendered text, the mask's spans and their sum."""
    plain = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    placed = positions(plain)
    chunks = placed.groupBy("conv_id", F.floor(F.col("_pos") / chunk).cast("long").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "role", "text"))).alias("turns")
    )
    people = plain.where("role <> 'system'").groupBy("conv_id", "role").agg(F.lit(1).alias("_one")).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker"))
    rows = chunks.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    name = lambda t: F.replace(F.replace(t["role"], F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    head = lambda t: F.when(t["role"] == "system", F.lit("<|system|>\n")).when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name(t), F.lit("|>\n")))
    rows = rows.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit("<|end|>\n")).alias("body"), (t["role"] == F.col("speaker")).alias("own"))))
    span = lambda acc, p: F.struct((acc["at"] + F.length(p["head"])).cast("long").alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("end"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
    walk = F.aggregate(
        "pieces", start,
        lambda acc, p: F.struct(span(acc, p)["end"].alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span(acc, p)))).otherwise(acc["spans"]).alias("spans")),
    )
    rows = rows.withColumn("walk", walk)
    return rows.select(
        "conv_id", "speaker", "chunk", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.transform(F.col("walk.spans"), lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias("mask"),
        F.aggregate(F.col("walk.spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("masked_chars"),
    )


def op7_chat_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ROTATION_SQL = """
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
p as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos from t),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
r as (
  select p.conv_id, s.speaker, pos // 256 as chunk, pos, p.role = s.speaker as own,
    case when p.role = 'system' then '<|system|>' || chr(10) when p.role = s.speaker then '<|assistant|>' || chr(10)
         else '<|user name=' || replace(replace(p.role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) end as head,
    p.text || '<|end|>' || chr(10) as body
  from p join s on p.conv_id is not distinct from s.conv_id),
a as (
  select *, coalesce(sum(length(head) + length(body)) over (
      partition by conv_id, speaker, chunk order by pos rows between unbounded preceding and 1 preceding), 0) as start from r)
select conv_id, speaker, chunk, count(*) as n_turns,
  string_agg(head || body, '' order by pos) as rendered,
  coalesce(string_agg(cast(start + length(head) as bigint) || '-' || cast(start + length(head) + length(body) as bigint), ',' order by pos) filter (own), '') as mask,
  cast(coalesce(sum(length(body)) filter (own), 0) as bigint) as masked_chars
from a group by conv_id, speaker, chunk
"""
