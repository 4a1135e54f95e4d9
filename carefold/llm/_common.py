"""Shared plumbing of the training-data operators: inputs, shared storage, joins on hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.storage import materialize, shared_dir

__all__ = ["ASCII_SPACE", "HOT_PARTS", "join_salted", "join_with_hot_keys", "materialize", "rows_as", "shared_dir", "sliced", "table", "text_key"]

#: A value with more than this share of all rows is hot; there are at most HOT_PARTS such values.
HOT_PARTS = 1000

#: ASCII white space as every operator here understands it: space, tab, \n, \v, \f, \r.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """Tells rows that repeat a doc_id apart by their text (null counts as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join_with_hot_keys(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join ``left`` to ``right`` (one row per ``key``) where single keys may hold a third of all rows.

    ``right`` has, in column ``n``, the number of left rows of each key. Keys above a 1/HOT_PARTS share
    are at most HOT_PARTS in number whatever the input, so they alone are broadcast; all others meet in a
    shuffle whose largest key is then small. ``n`` is not returned.
    """
    is_hot = F.col(n) > F.lit(max(1, total // HOT_PARTS))
    hot = right.filter(is_hot)
    marks = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    left = left.join(marks, key, "left")
    cold = left.filter(F.col("_hot").isNull()).join(right.filter(~is_hot), key, "left")
    warm = left.filter(F.col("_hot").isNotNull()).join(F.broadcast(hot), key)
    return cold.unionByName(warm).drop("_hot", n)


def join_salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``, many rows to many, where single keys may hold a third of ``left``'s rows.

    ``left`` is a stored table: its rows are counted. Those of a key with more than a 1/HOT_PARTS share (at most
    HOT_PARTS keys, whose names alone are broadcast) are dealt over as many parts as a shuffle has, by a hash of the
    row, and ``right``'s rows of such a key go to each part.
    """
    salts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = left.groupBy(key).agg(F.count("*").alias("n_of_key"))
    hot = counts.filter(F.col("n_of_key") > max(1, left.count() // HOT_PARTS)).select(key, F.lit(True).alias("is_hot"))
    hot = F.broadcast(materialize(hot, "hot-keys"))
    part = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")).otherwise(0)
    parts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, key, "left").withColumn("part", part).drop("is_hot")
    copied = right.join(hot, key, "left").withColumn("part", F.explode(parts)).drop("is_hot")
    return dealt.join(copied, [key, "part"]).drop("part")


def sliced(rows: DataFrame, key: str, n: str, by: str, most: int) -> DataFrame:
    """``rows`` with groups of more than ``most`` cut up: ``key`` then names two slices, each of half of ``most`` or so.

    ``n`` is the size of a row's group. Each two rows of a group have a slice pair in common, so whatever compares all
    rows of a key still compares them; ``by`` tells which slice a row is in. Keys are longs that are hashes.
    """
    slices = F.ceil(F.col(n) * 2 / most).cast("int")
    large = F.col(n) > most
    own = F.when(large, F.pmod(F.xxhash64(by), slices)).otherwise(0)
    others = F.when(large, F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.lit(0)))
    met = rows.withColumn("own", own).withColumn("other", F.explode(others))
    pair = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    return met.withColumn(key, F.when(large, pair).otherwise(F.col(key))).drop("own", "other")


def rows_as(docs: DataFrame, name: str = "r") -> DataFrame:
    """``docs`` with each row as one struct, so that its column names meet no others; ``select("r.*")`` undoes it."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name))
