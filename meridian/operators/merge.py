"""Upserts, snapshot diffs, gated rebuilds and guarded changes: Parquet tables are rewritten, so each gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """old with new's rows put in by key; with update new ones replace, else they only add."""
    first, second = (new, old) if update else (old, new)
    return first.select(*old.columns).unionByName(second.join(first.select(*keys), keys, "left_anti").select(*old.columns))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed, changed or unchanged."""
    values = [x for x in old.columns if x not in keys]
    a = old.select(*keys, F.struct(*values).alias("__o"))
    b = new.select(*keys, F.struct(*values).alias("__n"))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__o").eqNullSafe(F.col("__n")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def replace_keys(old: DataFrame, new: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in `gone` replaced by new's."""
    return old.join(gone, keys, "left_anti").unionByName(new)


def hash_gate(rows: DataFrame, stored: DataFrame, key: str, text_hash: Column) -> DataFrame:
    """(key, action): build, rebuild where the hash differs, keep, or prune what is no more."""
    now = rows.select(key, text_hash.alias("__now"))
    both = now.join(stored.select(key, F.col("text_hash").alias("__was")), key, "full")
    action = F.when(F.col("__now").isNull(), "prune").when(F.col("__was").isNull(), "build").when(F.col("__now") == F.col("__was"), "keep").otherwise("rebuild")
    return both.select(key, action.alias("action"))


def fold_merges(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(id, survivor) after a log of merge and unmerge steps (loser, winner, step, op): the last step of each loser holds."""
    last = log.groupBy("loser").agg(F.max_by(F.struct("op", "winner"), "step").alias("l"))
    moved = last.filter("l.op = 'merge'").select(F.col("loser").alias("id"), F.col("l.winner").alias("__w"))
    return rows.select("id").join(moved, "id", "left").select("id", F.coalesce("__w", "id").alias("survivor"))


def transition(rows: DataFrame, chosen: Column, was: str, to: str, status: str = "status") -> DataFrame:
    """Chosen rows of status `was` go to `to`; moved tells which."""
    moved = F.coalesce(chosen & (F.col(status) == was), F.lit(False))
    return rows.withColumn("moved", moved).withColumn(status, F.when(F.col("moved"), to).otherwise(F.col(status)))


def by_priority(rows: DataFrame, keys: list[str], source: str, order: tuple[str, ...], ties: list[Column]) -> DataFrame:
    """Of each key the row of the most trusted source."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    w = Window.partitionBy(*keys).orderBy(F.when(at == 0, len(order) + 1).otherwise(at), *ties)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
