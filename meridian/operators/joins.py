"""Join shapes that need more than an equal key: space, blocks, trees, diffs, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c

DEGREE_M = 111_000.0


def within_distance(places: DataFrame, radius_m: float, key: str = "id", by: str | None = None, part: int = 16_000) -> DataFrame:
    """(a, b, meters) of pairs of places, a < b, at most radius_m apart: by grid cells of at least the radius, then the distance.

    Each place is put in its own cell and asks that one, the next of its row and the three around it in the next row toward the pole, whose cells are wider, so two neighbours meet once.
    A cell of many places falls into parts of about `part`, and those who ask for it into parts of four times as many; each part of one meets each of the other, so a crowded cell is no one task's work, and rows are dealt out anew only where a part is full. Cells without places are asked by nobody.
    Both sides are merged, never broadcast: what they grow to here can't be told from a file's size. Distances are worked out only inside the square around a place.
    """
    cell = radius_m / DEGREE_M * 1.01
    own = places.filter("lat IS NOT NULL AND lng IS NOT NULL").select(key, "lat", "lng", *([by] if by else []), F.floor(F.col("lat") / cell).alias("__y"))
    # The width of a cell follows from its row alone, so a neighbour row's own width is used when it is asked for.
    width = lambda row: cell / F.greatest(F.cos(F.radians(F.greatest(F.abs(row * cell), F.abs((row + 1) * cell)))), F.lit(0.01))
    left = own.withColumn("__y2", F.explode(F.array_compact(F.array("__y", F.when(F.col("__y") >= 0, F.col("__y") + 1), F.when(F.col("__y") <= 0, F.col("__y") - 1)))))
    left = left.withColumn("__x0", F.floor(F.col("lng") / width(F.col("__y2")))).withColumn("__x", F.explode(F.sequence(F.col("__x0") - F.when(F.col("__y2") == F.col("__y"), 0).otherwise(1), F.col("__x0") + 1)))
    left = left.select(F.col(key).alias("__k"), "lat", "lng", *([by] if by else []), "__y2", "__x", ((F.col("__y2") == F.col("__y")) & (F.col("__x") == F.col("__x0"))).alias("__home"), width(F.col("__y2")).alias("__w"))
    right = own.select(F.col(key).alias("__kb"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"), F.col("__y").alias("__yb"), F.floor(F.col("lng") / width(F.col("__y"))).alias("__xb"), *([F.col(by).alias("__by")] if by else []))
    meters = c.haversine_m(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b"))
    many = lambda rows, y, x, n, name: rows.groupBy(F.col(y).alias("__y2"), F.col(x).alias("__x")).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = many(right, "__yb", "__xb", part, "__parts").join(many(left, "__y2", "__x", 4 * part, "__asks").hint("merge"), ["__y2", "__x"])
    own_part, each_part = lambda k, n: F.pmod(F.xxhash64(k), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes.hint("merge"), ["__y2", "__x"]).withColumn("__q", own_part("__k", "__asks")).withColumn("__p", each_part("__parts")).drop("__parts", "__asks")
    right = right.join(sizes.withColumnsRenamed({"__y2": "__yb", "__x": "__xb"}).hint("merge"), ["__yb", "__xb"]).withColumn("__pb", own_part("__kb", "__parts")).withColumn("__qb", each_part("__asks")).drop("__parts", "__asks")
    met = (F.col("__y2") == F.col("__yb")) & (F.col("__x") == F.col("__xb")) & (F.col("__p") == F.col("__pb")) & (F.col("__q") == F.col("__qb"))
    if by:
        met = met & (F.col(by) == F.col("__by"))
    once = (~F.col("__home") | (F.col("__k") < F.col("__kb"))) & (F.col("__k") != F.col("__kb"))
    square = (F.abs(F.col("lat") - F.col("lat_b")) <= cell) & (F.abs(F.col("lng") - F.col("lng_b")) <= F.col("__w"))
    found = left.join(right.hint("merge"), met & once & square).withColumn("meters", meters).filter(F.col("meters") <= radius_m)
    return found.select(F.least("__k", "__kb").alias("a"), F.greatest("__k", "__kb").alias("b"), "meters")


def nearest_node(places: DataFrame, nodes: DataFrame, max_m: float, key: str = "id") -> DataFrame:
    """(key, node_id, meters): the nearest node within max_m, ties by id; places without one aren't listed. nodes is a vocabulary: (node_id, node_lat, node_lng), few rows.

    A place finds its node inside its own row, so no row is held for each place and node; places are dealt out first, since a file of few columns may be one task's.
    """
    listed = nodes.agg(F.collect_list(F.struct("node_id", "node_lat", "node_lng")).alias("__nodes"))
    met = places.filter("lat IS NOT NULL AND lng IS NOT NULL").select(key, "lat", "lng").repartition(key).crossJoin(F.broadcast(listed))
    each = F.transform("__nodes", lambda n: F.struct(c.haversine_m(F.col("lat"), F.col("lng"), n["node_lat"], n["node_lng"]).alias("meters"), n["node_id"].alias("node_id")))
    # Exploded, not filtered afterwards: the planner would work out the distances once more for each use of them.
    own = met.select(key, F.explode(F.filter(F.array(F.array_min(each)), lambda m: m["meters"] <= max_m)).alias("m"))
    return own.groupBy(key).agg(F.min("m").alias("m")).select(key, F.col("m.node_id").alias("node_id"), F.col("m.meters").alias("meters"))


def best_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__rn = 1").drop("__rn")


ROLES = ("featured", "reviewed", "mentioned")


def lead_mention(mentions: DataFrame) -> DataFrame:
    """Of each article the mention by role, then id: the LATERAL top one as a window."""
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    return best_of(mentions, ["article_id"], [F.when(rank == 0, len(ROLES) + 1).otherwise(rank), F.col("id"), F.col("place_id")])


def evidence(places: DataFrame, mentions: DataFrame) -> DataFrame:
    """Places with counts of their mentions, those without any included: mentions are summed first."""
    sums = mentions.groupBy("place_id").agg(
        F.count(F.when(F.col("role") == "featured", 1)).alias("featured"), F.count("*").alias("mentions"), F.count_distinct("article_id").alias("articles"), F.max("article_id").alias("newest")
    )
    return places.join(sums, places["id"] == sums["place_id"], "left").drop("place_id").na.fill(0, ["featured", "mentions", "articles"])


def closure(tree: DataFrame, depth: int = 12) -> DataFrame:
    """(id, ancestor, steps) of a tree (id, parent_id), each node its own ancestor at 0: one join a level until a level is empty, at most depth."""
    out = level = tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps"))
    up = tree.filter("parent_id IS NOT NULL").select(F.col("id").alias("__n"), "parent_id")
    for step in range(1, depth + 1):
        level = level.join(up, F.col("ancestor") == F.col("__n")).select("id", F.col("parent_id").alias("ancestor"), F.lit(step).alias("steps"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


#: Longs of 64 parity bits each that a set takes along to where it meets others.
PARITY = 4


def token_sets(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(id, s, members): distinct token sets, each under the least key that has it; empty ones left out."""
    sets = rows.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("s")).filter(F.size("s") > 0)
    return sets.groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("members"))


def token_pairs(sets: DataFrame, at_least: float) -> DataFrame:
    """(a, b, similarity) of distinct token sets (id, s), a < b, with a Jaccard similarity of at_least: every such pair.

    Two such sets share a token among the first n - ceil(at_least n) + 1 of each
    in one order of all tokens; the order is by how many sets have a token, so
    common ones are rarely among those. Where two meet, what must be shared is
    held against what comes after the place of the token in each, which holds at
    the first one they share, and what may differ against the bits in which the
    parities of their hashed tokens differ, of which each token turns one. So few
    others are handed on, and the sets themselves are compared for those alone.
    """
    each = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("k"))
    bit, word = F.expr("shiftleft(1L, cast(pmod(xxhash64(t), 64) AS int))"), F.expr(f"pmod(shiftright(xxhash64(t), 6), {PARITY})")
    parity = [F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"x{w}") for w in range(PARITY)]
    ordered = each.join(often, "t").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("p"), *parity)
    prefix = F.slice("p", 1, (F.col("n") - F.ceil(at_least * F.col("n") - 1e-9) + 1).cast("int"))["t"]
    first = ordered.select("id", "n", *[f"x{w}" for w in range(PARITY)], F.posexplode(prefix).alias("at", "t"))
    share = F.ceil(at_least / (1 + at_least) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    turned = sum((F.bit_count(F.col(f"a_x{w}").bitwiseXOR(F.col(f"b_x{w}"))) for w in range(PARITY)), F.lit(0))
    enough = (F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= share) & (turned <= F.col("a_n") + F.col("b_n") - 2 * share)
    met = block_pairs(first, "t", part=4000).filter(F.least("a_n", "b_n") >= at_least * F.greatest("a_n", "b_n") - 1e-9).filter(enough)
    pairs = met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    return both.withColumn("similarity", c.jaccard(F.col("sa"), F.col("sb"), 1.0)).filter(F.col("similarity") >= at_least).select("a", "b", "similarity")


def block_pairs(rows: DataFrame, block: str, key: str = "id", part: int = 1000) -> DataFrame:
    """Pairs of rows in one block, a < b, with all columns under a_ and b_.

    A large block falls into parts of about `part` rows on both sides, and each
    part of one meets each of the other, so no join key has more work than part
    times part; of a block's rows as many copies are dealt out as it has parts.
    """
    known = rows.filter(F.col(block).isNotNull())
    parts = known.groupBy(F.col(block).alias("__block")).agg(F.ceil(F.count("*") / part).cast("int").alias("__parts"))
    sized = known.join(parts, F.col(block) == F.col("__block")).drop("__block")
    own, all_ = F.pmod(F.xxhash64(key), F.col("__parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    a = sized.select(*[F.col(x).alias(f"a_{x}") for x in known.columns], own.alias("__a1"), all_.alias("__a2"))
    b = sized.select(*[F.col(x).alias(f"b_{x}") for x in known.columns], own.alias("__b2"), all_.alias("__b1"))
    met = (F.col(f"a_{block}") == F.col(f"b_{block}")) & (F.col("__a1") == F.col("__b1")) & (F.col("__a2") == F.col("__b2")) & (F.col(f"a_{key}") < F.col(f"b_{key}"))
    return a.join(b, met).drop("__a1", "__a2", "__b1", "__b2")


def close_pairs(rows: DataFrame, block: str, within: int, key: str = "id") -> DataFrame:
    """(block, a, b) of pairs of rows in one block, a < b, whose integer keys differ by less than `within`: each row meets its own stretch of `within` keys and the next one, so a block's size doesn't matter."""
    known = rows.filter(F.col(block).isNotNull()).select(block, key, F.floor(F.col(key) / within).alias("__s"))
    a = known.select(block, F.col(key).alias("a"), F.explode(F.array("__s", F.col("__s") + 1)).alias("__s"))
    return a.join(known.withColumnRenamed(key, "b"), [block, "__s"]).filter((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") < within)).select(block, "a", "b")


def fallback(rows: DataFrame, lookups: list[DataFrame], on: list[str], value: str) -> DataFrame:
    """rows with the value of the first lookup that has one; lookup i joins on column on[i]."""
    out = rows
    names = []
    for i, (lookup, key) in enumerate(zip(lookups, on, strict=True)):
        out = out.join(lookup.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}")), F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        names.append(f"__v{i}")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def diff(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left_value, right_value) of what differs; a row on one side only has field '' and which side as value."""
    a = left.select(F.col(key), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields], F.lit(True).alias("__a"))
    b = right.select(F.col(key), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields], F.lit(True).alias("__b"))
    both = a.join(b, key, "full")
    one = F.array(F.struct(F.lit("").alias("field"), F.when(F.col("__a"), "left").alias("left_value"), F.when(F.col("__b"), "right").alias("right_value")))
    each = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("left_value"), F.col(f"b_{f}").alias("right_value")) for f in fields]), lambda d: ~d["left_value"].eqNullSafe(d["right_value"]))
    return both.select(key, F.explode(F.when(F.col("__a").isNull() | F.col("__b").isNull(), one).otherwise(each)).alias("d")).select(key, "d.*")
