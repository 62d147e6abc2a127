"""A deterministic paired-read table made from the `orders` table by one SQL text that any engine with these functions runs alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.options import KNOWN_ADAPTERS

READS_SQL = """
with k as (
  select o_orderkey as ordinal, case when o_orderkey % 10 = 9 then o_orderkey - 1 else o_orderkey end as key from orders),
b as (
  select ordinal, key, cast(15 + (key * 37) % 235 as int) as ilen,
    translate(concat(md5(concat(cast(key as string), ':s0')), md5(concat(cast(key as string), ':s1')), md5(concat(cast(key as string), ':s2')), md5(concat(cast(key as string), ':s3')),
                     md5(concat(cast(key as string), ':s4')), md5(concat(cast(key as string), ':s5')), md5(concat(cast(key as string), ':s6')), md5(concat(cast(key as string), ':s7'))),
              '0123456789abcdef', 'ACGTACGTACGTACGT') as pool,
    translate(concat(md5(concat(cast(ordinal as string), ':q0')), md5(concat(cast(ordinal as string), ':q1')), md5(concat(cast(ordinal as string), ':q2')),
                     md5(concat(cast(ordinal as string), ':q3')), md5(concat(cast(ordinal as string), ':q4'))),
              '0123456789abcdef', '#,:FFFFFFFFFFFFF') as qpool
  from k),
i as (select ordinal, key, qpool, substr(pool, 1, ilen) as ins from b),
r as (
  select ordinal, key, concat('@SIM:', cast(ordinal as string)) as stem,
    substr(concat(ins, repeat('{ADAPTER1}', 5)), 1, 150) as s1,
    substr(concat(reverse(translate(ins, 'ACGT', 'TGCA')), repeat('{ADAPTER2}', 5)), 1, 150) as s2,
    substr(qpool, 1, 150) as q
  from i)
select ordinal,
  concat(stem, ' 1:N:0:', case when key % 5 = 0 then 'ACGT+TGCA' else 'GGTT+CCAA' end) as name1,
  case when key % 13 = 0 then concat(substr(s1, 1, 20), 'NNNNNNNN', substr(s1, 29)) when key % 17 = 0 then concat(substr(s1, 1, 120), repeat('G', 30)) else s1 end as seq1,
  '+' as plus1,
  case when ordinal % 7 = 0 then concat(repeat('!', 8), substr(q, 9, 130), repeat('!', 12)) else q end as qual1,
  concat(stem, ' 2:N:0:', case when key % 5 = 0 then 'ACGT+TGCA' else 'GGTT+CCAA' end) as name2,
  case when key % 13 = 0 then concat(substr(s2, 1, 20), 'NNNNNNNN', substr(s2, 29))
       when key % 3 = 0 then concat(substr(s2, 1, 10), translate(substr(s2, 11, 1), 'ACGT', 'CATG'), substr(s2, 12)) else s2 end as seq2,
  '+' as plus2,
  case when ordinal % 11 = 0 then repeat('!', 150) when key % 3 = 0 then concat(repeat('I', 10), '#', substr(q, 12)) else q end as qual2
from r
""".replace("{ADAPTER1}", KNOWN_ADAPTERS[0]).replace("{ADAPTER2}", KNOWN_ADAPTERS[1])


#: Reads that a task makes at most, but for chance: a task's time and memory do not grow with the table.
READS_OF_A_TASK = 100_000


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (ordinal, name1, seq1, plus1, qual1, name2, seq2, plus2, qual2) of a data folder."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    parts = max(spark.sparkContext.defaultParallelism, -(-orders.count() // READS_OF_A_TASK))
    orders = orders.repartition(parts)  # keys alone are dealt out; splits of a file follow its bytes and row groups, not its rows
    return spark.sql(READS_SQL.replace("from orders", "from {orders}"), orders=orders)
