"""What a run asks of the world outside, as tables to tables, and stand-ins that need no network."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from . import itinerary


class Embedder(Protocol):
    """Vectors for texts: (key, text) to (key, embedding array<float>)."""

    def embed(self, texts: DataFrame) -> DataFrame: ...


class Geocoder(Protocol):
    """Points for addresses: (key, address) to (key, lat, lng), rows it can't place left out."""

    def points(self, addresses: DataFrame) -> DataFrame: ...


class Travel(Protocol):
    """Minutes between places: (a, lat_a, lng_a, b, lat_b, lng_b) to (a, b, minutes)."""

    def minutes(self, pairs: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """Vectors of unit length from hashes of a text's words: equal texts have equal ones, texts with common words close ones."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: DataFrame) -> DataFrame:
        words = texts.select("key", F.explode(F.array_distinct(c.tokens(F.coalesce("text", F.lit(""))))).alias("w"))
        places = words.select("key", F.pmod(F.xxhash64("w"), F.lit(self.size)).alias("i"), F.when(F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("x"))
        sums = places.groupBy("key", "i").agg(F.sum("x").alias("x")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
        at = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.size - 1).cast("long")), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).cast("float"))
        none = F.array_repeat(F.lit(0.0).cast("float"), self.size)
        return texts.select("key").join(sums.select("key", at.alias("embedding")), "key", "left").select("key", F.coalesce("embedding", none).alias("embedding"))


class TableGeocoder:
    """Addresses looked up in a table (address, lat, lng), small letters and spaces aside."""

    def __init__(self, known: DataFrame) -> None:
        self.known = known

    def points(self, addresses: DataFrame) -> DataFrame:
        bare = lambda x: c.normalize_name(F.col(x))
        one = self.known.select(bare("address").alias("__a"), F.struct("lat", "lng").alias("__p")).groupBy("__a").agg(F.min("__p").alias("__p"))
        return addresses.select("key", bare("address").alias("__a")).join(one, "__a").select("key", "__p.lat", "__p.lng")


class Haversine:
    """Minutes by distance alone, and measured ones (a, b, minutes) where a table has them."""

    def __init__(self, measured: DataFrame) -> None:
        self.measured = measured

    def minutes(self, pairs: DataFrame) -> DataFrame:
        return itinerary.pair_minutes(pairs, self.measured)
