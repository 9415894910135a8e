"""Sharding by a permutation-filled lookup table (native).

Each shard walks its own permutation of a prime-sized table; the shards take turns, and
on its turn a shard claims the next slot of its walk that is still free.  Every shard
ends up with its share of slots to within one, and adding or removing a shard moves
little more than that share.  A document's slot is a hash of its id modulo the table's
size, so its placement is one look-up in the broadcast table.  The table's size is a
parameter, never a function of the data: ``TABLE_SIZE`` rows of two integers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm.store import table

SHARDS = 64
TABLE_SIZE = 6421  # a prime, about 100 slots a shard: shares differ by 1 % at most
HEX = 13  # hex digits of the hash taken as a number: 52 bits


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX], 16)


def lookup_table(shards: int = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The shard of each slot. ``size`` must be prime and at least ``shards``."""
    if shards < 1 or size < shards or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime not below the number of shards")
    at = [_number(f"offset/{s}") % size for s in range(shards)]
    step = [_number(f"skip/{s}") % (size - 1) + 1 for s in range(shards)]
    owner = [-1] * size
    for turn in range(size):
        s = turn % shards
        while owner[at[s]] >= 0:
            at[s] = (at[s] + step[s]) % size
        owner[at[s]] = s
    return owner


def place(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (both int), one row for each input row.

    Rows with equal keys share a shard; a null key is placed as the empty string is.
    Columns of ``docs`` named slot or shard are replaced; an empty table gives none.  No shuffle: a key that holds
    a third of all rows costs no more than any other.
    """
    spark = docs.sparkSession
    docs = docs.drop("slot", "shard")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    number = F.conv(F.substring(digest, 1, HEX), 16, 10).cast("long")
    slots = spark.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot int, shard int")
    return docs.withColumn("slot", F.pmod(number, F.lit(size)).cast("int")).join(F.broadcast(slots), "slot").select(*docs.columns, "slot", "shard")


def write_shards(placed: DataFrame, path: str, spread: int = 8) -> None:
    """One folder for each shard, its rows dealt over ``spread`` files so that no task writes a whole shard."""
    salted = placed.withColumn("_spread", F.pmod(F.xxhash64(*placed.columns), F.lit(spread)))
    salted.repartition("shard", "_spread").drop("_spread").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"))


#: The look-up as SQL over the filled table; tests fill the table another way.
ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {HEX}))::BIGINT % {TABLE_SIZE})::INTEGER AS slot
  FROM documents
), filled AS (SELECT {lookup_table()}::INTEGER[] AS owner)
SELECT doc_id, slot, owner[slot + 1] AS shard FROM docs, filled
"""
