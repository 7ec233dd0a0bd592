"""Joining per-group facts back to rows when one group may hold much of the table.

Rows get a salt from a hash of their id.  Group facts are first aggregated per
(group, salt), which also tells which salts a group really has; after the facts
are final they are handed back once per salt.  A group of any size is so spread
over as many tasks as the session's shuffles have partitions, small groups are not copied more often than they have
rows, and nothing needs to be known about the keys beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SALTS = 64


def salt_count(df: DataFrame) -> int:
    return max(LEAST_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_salt(df: DataFrame, row_id: str | list[str] = "record_id", salts: int | None = None) -> DataFrame:
    """Adds which of the parts of its group a row belongs to.

    There are as many parts as shuffle partitions, which follow the size of the data and of the cluster: a group with a
    third of all rows is then no larger per part than a partition.
    """
    columns = [row_id] if isinstance(row_id, str) else row_id
    return df.withColumn("salt", F.pmod(F.xxhash64(*columns), F.lit(salts or salt_count(df))).cast("int"))


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], row_id: list[str]) -> DataFrame:
    """Inner join of rows with a table on keys of a handful of values, or on none (each row with each).

    One key may hold much of the rows, so rows get a salt from the columns ``row_id`` and the other table is handed out
    once per salt.  It is a merge join on purpose: Spark's size estimates leave out what ``explode`` adds, so either
    side could be sent through the driver whole.
    """
    salted = with_salt(rows, row_id)
    parts = F.lit(salt_count(rows) - 1)
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), parts)))
    return salted.join(copies.hint("merge"), [*keys, "salt"]).drop("salt")


def join_back(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of facts (one row per key, with their ``salts``) to salted rows.

    Null keys match each other, because untimed rows form a group of their own.
    """
    spread = facts.withColumn("salt", F.explode("salts")).drop("salts")
    renamed = spread.select(*[F.col(k).alias(f"fact_{k}") for k in keys], F.col("salt").alias("fact_salt"),
                            *[c for c in spread.columns if c not in [*keys, "salt"]])
    same = rows["salt"] == renamed["fact_salt"]
    for k in keys:
        same = same & rows[k].eqNullSafe(renamed[f"fact_{k}"])
    return rows.join(renamed, same, "left").drop("fact_salt", *[f"fact_{k}" for k in keys])
