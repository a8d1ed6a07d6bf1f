"""References to records that are not there, at the time of the reference.

A reference is (ref_table, owner_id, ref_field, key, at); a parent is (key, present_from, present_until). A reference
is an orphan if no parent of its key is present at its time: present_from <= at and present_until null or > at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least one in HOT_SHARE of all references is spread over SALTS tasks; at most HOT_SHARE keys can be.
HOT_SHARE, SALTS = 64, 32
#: Below so many references a key is never hot.
HOT_LEAST = 20_000


def references(df: DataFrame, table: str, owner: str, at: str, fields: dict[str, str]) -> DataFrame:
    """References of a table with one column per field: fields maps the field's name to its key column."""
    pairs = F.array(*(F.struct(F.lit(name).alias("ref_field"), F.col(column).cast("long").alias("key")) for name, column in fields.items()))
    rows = df.select(F.lit(table).alias("ref_table"), F.col(owner).alias("owner_id"), F.col(at).alias("at"), F.explode(pairs).alias("r"))
    return rows.select("ref_table", "owner_id", F.col("r.ref_field").alias("ref_field"), F.col("r.key").alias("key"), "at").filter("key is not null")


def member_references(df: DataFrame, table: str, owner: str, at: str, members: str, role: str, key: str) -> DataFrame:
    """References held in a list of structs; a null or empty list, a null item and a null key give none."""
    rows = df.select(F.lit(table).alias("ref_table"), F.col(owner).alias("owner_id"), F.col(at).alias("at"), F.explode(members).alias("m"))
    return rows.select("ref_table", "owner_id", F.col(f"m.{role}").alias("ref_field"), F.col(f"m.{key}").cast("long").alias("key"), "at").filter("key is not null")


def _hot_keys(refs: DataFrame) -> DataFrame:
    """Keys with many references, counted map-side first. No more than HOT_SHARE rows, so they may be broadcast."""
    least = max(HOT_LEAST, -(-refs.count() // HOT_SHARE))
    return refs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("key")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose key has no present parent at their time.

    Null keys are no references. A reference without a time is an orphan only if its key has no parent at all; a parent
    without present_from is never present. Repeated parent rows count once; repeated references stay as often as given
    (group or drop them at the call). References of hot keys are salted, and only the parents of those keys, the few
    rows of at most HOT_SHARE keys, are repeated for each salt.
    """
    hot = F.broadcast(_hot_keys(refs).withColumn("hot", F.lit(True)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("owner_id", "ref_field", "at"), F.lit(SALTS)).cast("int")).otherwise(0)
    left = refs.filter("key is not null").join(hot, "key", "left").withColumn("salt", salt).drop("hot").alias("r")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = (
        parents.select("key", "present_from", "present_until").filter("key is not null and present_from is not null").distinct()
        .join(hot, "key", "left").withColumn("salt", F.explode(salts)).drop("hot").alias("p")
    )
    there = F.col("r.at").isNull() | ((F.col("p.present_from") <= F.col("r.at")) & (F.col("p.present_until").isNull() | (F.col("p.present_until") > F.col("r.at"))))
    return left.join(right, (F.col("r.key") == F.col("p.key")) & (F.col("r.salt") == F.col("p.salt")) & there, "left_anti").select(*refs.columns)


def missing_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Keys referred to that no parent row ever had: distinct keys, reduced map-side, against distinct parent keys."""
    return refs.filter("key is not null").select("key").distinct().join(parents.select("key").distinct(), "key", "left_anti")


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def orphan_report(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Per table, field and month: references, orphans, orphan keys, and orphans whose key never existed.

    The never-existing keys come from a left anti-join of distinct keys and are joined back to the orphans.
    Periods without an orphan stay, with zeros; references without a time have a null month.
    """
    by = ["ref_table", "ref_field", "ref_month"]
    never = missing_keys(refs, parents).withColumn("never", F.lit(1))
    lost = orphans(refs, parents).withColumn("ref_month", month(F.col("at"))).join(never, "key", "left")
    # First by key, so that one hot key or one period is reduced before the shuffle by period.
    lost = lost.groupBy(*by, "key").agg(F.count("*").alias("n"), F.count("never").alias("never"))
    lost = lost.groupBy(*by).agg(F.sum("n").alias("orphans"), F.count("*").alias("orphan_keys"), F.sum("never").alias("never_existed"))
    seen = refs.filter("key is not null").withColumn("ref_month", month(F.col("at"))).groupBy(*by).agg(F.count("*").alias("refs"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]
    joined = seen.alias("s").join(lost.alias("l"), same, "left")
    return joined.select(*(F.col(f"s.{c}").alias(c) for c in by), "refs", *(F.coalesce(F.col(f"l.{c}"), F.lit(0)).alias(c) for c in ("orphans", "orphan_keys", "never_existed")))
