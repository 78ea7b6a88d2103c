"""Joins whose left side may have a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of a shuffle partition's fair share of the rows is dealt to several tasks.
FAIR = 4


def salted_join(rows: DataFrame, counted: DataFrame, keys: list[str], by: list[str], total: int, places: str = "places", how: str = "inner", only: Column | None = None) -> DataFrame:
    """``rows`` joined with ``counted``, which has one row for each value of ``keys`` and tells in ``places`` how many rows have it.

    A key with more than total / (FAIR * partitions) rows is hot. As the counts add up to ``total`` (or less), there are at
    most FAIR * partitions hot keys, whatever the data: so they can be broadcast, and each is dealt by a hash of ``by`` into
    as many parts as it holds fair shares. All other keys meet in one task each, as in any join. With ``only``, a condition on
    ``counted``, the other keys are dealt alike but joined with nothing.
    """
    share = max(1, total // (FAIR * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.ceil(F.col(places) / share).cast("int")
    named = {k: f"_{k}" for k in keys}
    hot = counted.where(F.col(places) > share).select(*(F.col(k).alias(f"_{k}") for k in keys), salts.alias("_salts"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    marked = rows.join(F.broadcast(hot), same, "left").withColumn("_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*by), "_salts").cast("int")).otherwise(0)).drop("_salts", *named.values())
    dealt = (counted if only is None else counted.where(only)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return marked.join(dealt, [*keys, "_salt"], how).drop("_salt")
