"""Itineraries: who may fill which slot and when, whether a day can work, and an independent check; plans are made in planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from .planning import EARTH_KM, LEAST_MINUTES, SPEED_KMH, plan

__all__ = ["checks", "eligible", "override_slots", "pair_minutes", "plan", "precheck", "satisfaction", "travel_minutes", "violations"]

#: Fixed values of the domain.
PER_SLOT = 40


def eligible(stops: DataFrame, slots: DataFrame, needs: list[str] = (), ceiling: str | None = None, per_slot: int = PER_SLOT) -> DataFrame:
    """(day, slot, place_id, ..., earliest, latest): stops of a slot's type, for the party and its purse, open for the dwell within the slot, with when one may arrive; the best per_slot.

    slots: day, weekday, slot, types, opens, closes (minutes), a small table. stops: place_id, type, score, price_band,
    dwell, hours (array of weekday, opens, closes; none: open), and a boolean for
    each need (null: unknown, and so not met).
    """
    rows = stops
    for need in needs:
        rows = rows.filter(F.coalesce(F.col(need), F.lit(False)))
    if ceiling in c.PRICE_BANDS:
        rows = rows.filter(F.coalesce(c.price_rank(F.col("price_band")) <= c.PRICE_BANDS.index(ceiling), F.lit(True)))
    met = rows.crossJoin(F.broadcast(slots)).filter(F.array_contains("types", F.col("type")))

    def fits(h: Column) -> Column:
        return (h["weekday"] == F.col("weekday")) & (F.least(h["closes"], F.col("closes")) - F.greatest(h["opens"], F.col("opens")) >= F.col("dwell"))

    anytime = F.coalesce(F.size("hours") == 0, F.lit(True)) | (F.size("hours") <= 0)
    # Of several hours on the day those count that share most with the slot.
    shared = lambda h: F.least(h["closes"], F.col("closes")) - F.greatest(h["opens"], F.col("opens"))
    hours = F.array_max(F.transform(F.filter("hours", fits), lambda h: F.struct(shared(h).alias("n"), (-h["opens"]).alias("o"), h["closes"].alias("c"))))
    met = met.withColumn("__h", F.when(~anytime, hours)).withColumns(
        {"earliest": F.greatest("opens", -F.col("__h.o")), "latest": F.least(F.col("closes"), F.col("__h.c")) - F.col("dwell")}
    )
    open_ = (anytime | F.col("__h").isNotNull()) & (F.col("latest") >= F.col("earliest"))
    w = Window.partitionBy("day", "slot").orderBy(F.desc("score"), "place_id")
    return met.filter(open_).drop("__h").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_slot)


def precheck(candidates: DataFrame, slots: DataFrame, max_per_org: int) -> DataFrame:
    """(slots, supply, feasible): different stops that could fill slots, of an organisation at most max_per_org, against the slots; and empty slots."""
    each = candidates.select("place_id", "org_id").distinct()
    orgs = each.filter("org_id IS NOT NULL").groupBy("org_id").agg(F.least(F.count("*"), F.lit(max_per_org)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("by_org"))
    free = each.filter("org_id IS NULL").agg(F.count("*").alias("free"))
    empty = slots.join(candidates.select("day", "slot").distinct(), ["day", "slot"], "left_anti").agg(F.count("*").alias("empty"))
    need = slots.agg(F.count("*").alias("slots"))
    out = need.crossJoin(F.broadcast(orgs)).crossJoin(F.broadcast(free)).crossJoin(F.broadcast(empty))
    return out.select("slots", (F.col("by_org") + F.col("free")).alias("supply"), "empty", ((F.col("by_org") + F.col("free") >= F.col("slots")) & (F.col("empty") == 0)).alias("feasible"))


def travel_minutes(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    km = c.haversine_m(lat1, lng1, lat2, lng2, EARTH_KM)
    return F.greatest(F.lit(LEAST_MINUTES), F.bround(km / SPEED_KMH * 60).cast("int"))


def pair_minutes(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, minutes): the known time, that of the way back, else by distance. pairs have lat_a, lng_a, lat_b, lng_b."""
    k = known.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("minutes").alias("__m"))
    out = pairs.join(k, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left").withColumnRenamed("__m", "__there").drop("__a", "__b")
    out = out.join(k, (F.col("b") == F.col("__a")) & (F.col("a") == F.col("__b")), "left").withColumnRenamed("__m", "__back").drop("__a", "__b")
    far = travel_minutes(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    return out.select("a", "b", F.coalesce("__there", "__back", far).alias("minutes"))


def violations(plans: DataFrame, stops: DataFrame, slots: DataFrame, max_per_org: int) -> DataFrame:
    """(request_id, rule, day, place_id) of what a plan breaks: repeats, wrong types, organisations over the cap, no time to travel, slots left empty.

    Plans with a column arrives are held to it, others to the slots' beginnings; where
    slots has a column required, only those that are may not be empty.
    """
    starts = F.col("arrives") if "arrives" in plans.columns else F.col("opens")
    p = plans.join(stops, "place_id").join(slots.select("day", "slot", "types", "opens"), ["day", "slot"]).withColumn("starts", starts)
    pick = lambda d, rule: d.select("request_id", F.lit(rule).alias("rule"), F.col("day").cast("int").alias("day"), F.col("place_id").cast("long").alias("place_id"))
    repeats = p.withColumn("__n", F.count("*").over(Window.partitionBy("request_id", "place_id"))).filter("__n > 1")
    types = p.filter(~F.array_contains("types", F.col("type")))
    orgs = p.filter("org_id IS NOT NULL").withColumn("__n", F.count("*").over(Window.partitionBy("request_id", "org_id"))).filter(F.col("__n") > max_per_org)
    w = Window.partitionBy("request_id", "day").orderBy("starts")
    late = p.withColumns({"__lat": F.lag("lat").over(w), "__lng": F.lag("lng").over(w), "__end": F.lag(F.col("starts") + F.col("dwell")).over(w)})
    late = late.filter(F.col("__end") + travel_minutes(F.col("__lat"), F.col("__lng"), F.col("lat"), F.col("lng")) > F.col("starts"))
    must = slots.filter("required") if "required" in slots.columns else slots
    wanted = plans.select("request_id").distinct().crossJoin(F.broadcast(must.select("day", "slot")))
    empty = wanted.join(plans, ["request_id", "day", "slot"], "left_anti").withColumn("place_id", F.lit(None).cast("long"))
    out = pick(repeats, "repeat")
    for rows, rule in ((types, "type"), (orgs, "organisation"), (late, "travel"), (empty, "empty")):
        out = out.unionByName(pick(rows, rule))
    return out


def checks(stops: DataFrame, parties: DataFrame) -> DataFrame:
    """(itinerary_id, rule, place_id) of what finished itineraries break; rules of a whole day or trip name no place.

    stops: itinerary_id, place_id, day, starts, ends (minutes), travel (minutes
    from the stop before), price, category, opens, closes (null: not known),
    kids, accessible, halal, vegetarian (null: no). parties: itinerary_id, budget, repeats (most stops of a
    category in a day), trip_start, trip_end, and needs as booleans under the names need_kids, need_accessible, need_halal, need_vegetarian.
    """
    w = Window.partitionBy("itinerary_id", "day").orderBy("starts", "place_id")
    both = stops.withColumn("__before", F.lag("ends").over(w)).join(parties, "itinerary_id")
    lacks = lambda need, has: F.col(need) & ~F.coalesce(F.col(has), F.lit(False))
    eats = F.col("category") == "eat"
    rules = {
        "closed": (F.col("starts") < F.col("opens")) | (F.col("ends") > F.col("closes")),
        "travel": F.col("starts") < F.col("__before") + F.col("travel"),
        "outside_trip": (F.col("day") < F.col("trip_start")) | (F.col("day") > F.col("trip_end")),
        "kids": lacks("need_kids", "kids"),
        "accessible": lacks("need_accessible", "accessible"),
        "halal": eats & lacks("need_halal", "halal"),
        "vegetarian": eats & lacks("need_vegetarian", "vegetarian"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in rules.items()]))
    single = both.select("itinerary_id", F.explode(broken).alias("rule"), "place_id")
    none = F.lit(None).cast("long")
    spent = both.groupBy("itinerary_id", "budget").agg(F.sum("price").alias("total")).filter("total > budget").select("itinerary_id", F.lit("budget").alias("rule"), none.alias("place_id"))
    often = both.groupBy("itinerary_id", "day", "category", "repeats").agg(F.count("*").alias("n")).filter("n > repeats").select("itinerary_id", F.lit("repeats").alias("rule"), none.alias("place_id"))
    return single.unionByName(spent).unionByName(often)


def satisfaction(found: DataFrame, itineraries: DataFrame) -> DataFrame:
    """(itineraries, satisfied, rate, passed): the gate holds only where every itinerary is without fault."""
    bad = found.select("itinerary_id").distinct().withColumn("__bad", F.lit(1))
    sums = itineraries.select("itinerary_id").distinct().join(bad, "itinerary_id", "left").agg(F.count("*").alias("itineraries"), F.count(F.when(F.col("__bad").isNull(), 1)).alias("satisfied"))
    return sums.select("itineraries", "satisfied", (F.col("satisfied") / F.nullif("itineraries", F.lit(0))).alias("rate"), (F.col("satisfied") == F.col("itineraries")).alias("passed"))


def override_slots(defaults: DataFrame, overrides: DataFrame, fields: tuple[str, ...] = ("types", "opens", "closes")) -> DataFrame:
    """Slots of each request: the defaults, with the fields that it sets itself, and slots that only it has. defaults: slot, fields; overrides: request_id, slot, fields (null: as the default)."""
    asked = overrides.select("request_id").distinct()
    base = asked.crossJoin(F.broadcast(defaults.select("slot", *[F.col(f).alias(f"__{f}") for f in fields])))
    return base.join(overrides, ["request_id", "slot"], "full").select("request_id", "slot", *[F.coalesce(f, f"__{f}").alias(f) for f in fields])
