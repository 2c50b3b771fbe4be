"""Loaders by natural key: numbers that stay, parents before children, and verdicts asked for by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolution import durable

#: Rows of one part of a numbering, about, and parts at most.
PART_ROWS, PARTS = 100_000, 4096


def numbered(rows: DataFrame, order: list[str], after: int = 0, name: str = "id") -> DataFrame:
    """rows with numbers from after + 1 on in the order of some columns, which tell rows apart.

    Rows are dealt out by ranges of the order; each range numbers its own, on top of
    how many the ranges before it have, so no task has all.
    """
    parts = min(PARTS, rows.count() // PART_ROWS + 1)
    dealt = durable(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))  # PARTS rows at most
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before") + after
    return dealt.join(before, "__part").withColumn(name, place.cast("long")).drop("__part", "__before")


def key_map(known: DataFrame, rows: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """known (keys, id) and, for keys of rows that it lacks, new numbers above its highest in the order of the keys. A key keeps its number over loads; a null in a key is a value like others."""
    met = rows.select(*keys).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    new = met.join(known.select(*[F.col(k).alias(f"__{k}") for k in keys]), cond, "left_anti")
    top = known.agg(F.max(name)).first()[0] or 0
    return known.select(*keys, name).unionByName(numbered(new, keys, top, name).select(*keys, name))


def with_ids(rows: DataFrame, ids: DataFrame, keys: list[str], name: str, how: str = "inner") -> DataFrame:
    """rows with the number of their natural key, in place of the key."""
    own = ids.select(*[F.col(k).alias(f"__{k}") for k in ids.columns if k != "id"], F.col("id").alias(f"__id_{name}"))
    cond = F.lit(True)
    for k, of in zip(keys, [c for c in ids.columns if c != "id"], strict=True):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{of}"))
    return rows.join(own, cond, how).drop(*keys, *[f"__{c}" for c in ids.columns if c != "id"]).withColumnRenamed(f"__id_{name}", name)


def load(table: DataFrame, ids: DataFrame, rows: DataFrame, keys: list[str], parents: dict[str, tuple[DataFrame, list[str]]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the table after the load, the key map after it, rows whose parent isn't known).

    table: id and rows' other columns; ids: (keys, id). Rows are put in by natural key, a row of a
    known key replaces the old one. parents: column -> (that parent's key map, the columns of rows that name it), which must
    have been loaded before. A load done twice changes nothing. Rows that agree in the key must agree in all.
    """
    left, orphans = rows, None
    for column, (of, names) in (parents or {}).items():
        joined = durable(with_ids(left.withColumns({f"{n}__was": F.col(n) for n in names}), of, names, column, "left"))
        lost = joined.filter(F.col(column).isNull()).select(*keys)
        orphans = lost if orphans is None else orphans.unionByName(lost)
        left = joined.filter(F.col(column).isNotNull()).drop(*[f"{n}__was" for n in names])
    left = left.distinct()
    new_ids = durable(key_map(ids, left, keys))
    placed = with_ids(left, new_ids, keys, "id")
    kept = table.join(placed.select("id"), "id", "left_anti")
    return kept.unionByName(placed.select(*table.columns)), new_ids, orphans if orphans is not None else rows.select(*keys).limit(0)


def content_hash(*parts: Column) -> Column:
    """The hash under which a verdict on some texts is kept, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array(*[F.sha2(F.coalesce(p, F.lit("")), 256) for p in parts])), " "), 256)


def undecided(pairs: DataFrame, verdicts: DataFrame, version: int) -> DataFrame:
    """(hash, a_name, b_name) of pairs (a_name, b_name) that no verdict (hash, same, version) of this version knows, each once: what to ask. A text that changes has another hash, so it is asked again."""
    asked = pairs.withColumn("hash", content_hash(F.col("a_name"), F.col("b_name"))).groupBy("hash").agg(F.min(F.struct("a_name", "b_name")).alias("p"))
    return asked.join(verdicts.filter(F.col("version") == version), "hash", "left_anti").select("hash", "p.*")


def adjudicated(pairs: DataFrame, verdicts: DataFrame, version: int, auto: float, review: float) -> DataFrame:
    """pairs (a_name, b_name, similarity) with what becomes of them: merge from auto on or by verdict, review in between without one or with an open one (same null), apart below review or by verdict."""
    own = verdicts.filter(F.col("version") == version).groupBy("hash").agg(F.max("same").alias("__same"))
    known = pairs.withColumn("hash", content_hash(F.col("a_name"), F.col("b_name"))).join(own, "hash", "left")
    action = F.when(F.col("similarity") >= auto, "merge").when(F.col("similarity") < review, "apart").when(F.col("__same"), "merge").when(~F.col("__same"), "apart").otherwise("review")
    return known.withColumn("action", action).drop("hash", "__same")
