"""The first places around subjects, by widening rings of grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .joins import DEGREE_M
from .resolution import durable
from .retrieval import ranked

#: How much a ring grows from round to round, and the widest one: half way round.
WIDER, HALF_WAY_M = 3, math.pi * c.EARTH_M


def first_around(subjects: DataFrame, places: DataFrame, k: int, order: list[Column], sure: Callable[[float], Column], where: Column | None = None, on: list[str] = (), most_m: float = HALF_WAY_M, expected: float = 30, key: str = "subject_id") -> DataFrame:
    """(all columns, m): of each subject (key, s_lat, s_lng, ...) the first k by `order` of the places (lat, lng, ...) within most_m, of those that are equal in the columns `on` and pass `where`.

    A subject meets the places of the cells around it, at first within a radius that holds about `expected` places by their mean density.
    It is done when sure(radius) holds for k of them: that nothing beyond the radius comes before such a row.
    The others go on with a radius three times as wide, to most_m, so who stands among many meets few, and no place within reach is lost. Places without a point are nowhere.
    """
    located = places.filter("lat IS NOT NULL AND lng IS NOT NULL")
    box = located.agg(F.count("*").alias("n"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lng").alias("c"), F.max("lng").alias("d")).first()
    area = (box.b - box.a) * (box.d - box.c) * DEGREE_M**2 * math.cos(math.radians((box.a + box.b) / 2)) if box.n else 0.0
    radius = min(most_m, max(1.0, math.sqrt(expected * max(area, 0.0) / (math.pi * box.n)) if box.n else most_m))
    left, out = subjects.filter("s_lat IS NOT NULL AND s_lng IS NOT NULL"), None
    while True:
        cell = radius / DEGREE_M * 1.01
        width = lambda row, cell=cell: cell / F.greatest(F.cos(F.radians(F.greatest(F.abs(row * cell), F.abs((row + 1) * cell)))), F.lit(0.01))
        put = located.withColumn("__y", F.floor(F.col("lat") / cell))
        put = put.withColumn("__x", F.floor(F.col("lng") / width(F.col("__y"))))
        row = F.floor(F.col("s_lat") / cell)
        asked = left.withColumn("__y", F.explode(F.sequence(row - 1, row + 1)))
        column = F.floor(F.col("s_lng") / width(F.col("__y")))
        asked = asked.withColumn("__x", F.explode(F.sequence(column - 1, column + 1)))
        met = put.join(asked, [*on, "__y", "__x"]).drop("__y", "__x")
        met = met if where is None else met.filter(where)
        met = met.withColumn("m", c.haversine_m(F.col("s_lat"), F.col("s_lng"), F.col("lat"), F.col("lng"))).filter(F.col("m") <= radius)
        first = ranked(met, [key], order, k).drop("rank")
        if radius >= most_m:
            return first if out is None else out.unionByName(first)
        first = durable(first.withColumn("__sure", sure(radius)))
        done = first.groupBy(key).agg(F.count_if(F.col("__sure")).alias("__n")).filter(F.col("__n") >= k).select(key)
        some = first.join(done, key, "left_semi").drop("__sure")
        out = some if out is None else out.unionByName(some)
        left = durable(left.join(done, key, "left_anti"))
        if left.isEmpty():
            return out
        radius = min(most_m, radius * WIDER)
