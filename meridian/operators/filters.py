"""Hard, contextual and soft filters over candidates, and the ladder that relaxes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c

#: Fixed values of the domain.
QUALITY_FLOOR = 0.35
UNKNOWN = "unknown"
PARTY_AMENITIES = {"accessibility": ("wheelchair-accessible",), "halal": ("halal-certified",), "vegetarian": ("vegetarian-friendly", "vegan-options"), "kids": ("kids-club",)}
LOW_AFFINITY, SEEN_NOT_CLICKED, CROWDED_AREA, CROWDED_FROM, AFFINITY_FROM = 0.7, 0.85, 0.9, 3, 0.3
READ_DAYS = 14
FILL_TIMES = 3


def excluded_types(relations: DataFrame) -> DataFrame:
    """(subject_type, excluded) for every known type and for the null subject.

    A subject that excludes its own type also excludes the unknown one and those
    it competes with. The null subject excludes what any such subject does.
    Subjects that aren't listed, and the empty one, exclude nothing.
    """
    known = relations.select(
        F.col("type").alias("subject_type"),
        F.when(F.col("exclude_same"), F.array_sort(F.array_distinct(F.concat(F.array("type", F.lit(UNKNOWN)), F.coalesce("competes_with", F.array()))))).otherwise(F.array().cast("array<string>")).alias("excluded"),
    )
    strict = relations.filter("exclude_same")
    types = strict.select("type").unionAll(strict.select(F.explode("competes_with"))).unionAll(relations.sparkSession.range(1).select(F.lit(UNKNOWN)))
    nobody = types.agg(F.array_sort(F.collect_set("type")).alias("excluded")).select(F.lit(None).cast("string").alias("subject_type"), "excluded")
    return known.unionAll(nobody)


def is_competitor(excluded: Column, candidate: Column) -> Column:
    """Whether a candidate's type is excluded; one without a type is, wherever anything is."""
    some = F.size(F.coalesce(excluded, F.array().cast("array<string>"))) > 0
    return some & (candidate.isNull() | (candidate == "") | F.coalesce(F.array_contains(excluded, candidate), F.lit(False)))


def above_floor(rows: DataFrame, scores: DataFrame, key: str = "id", floor: float = QUALITY_FLOOR) -> DataFrame:
    """Rows but for those with a score under the floor; unscored rows stay."""
    low = scores.filter(F.col("score") < floor).select(F.col("entity_id").alias("__low"))
    return rows.join(low, F.col(key) == F.col("__low"), "left_anti")


@dataclass(frozen=True)
class Around:
    lat: float
    lng: float
    radius_m: float

    def holds(self, lat: Column, lng: Column) -> Column:
        """Within the radius: a box that Parquet statistics can use, then the distance."""
        dlat = self.radius_m / 111_000
        box = lat.between(self.lat - dlat * 1.01, self.lat + dlat * 1.01)
        return box & (c.haversine_m(F.lit(self.lat), F.lit(self.lng), lat, lng) <= self.radius_m)


def places_hard(places: DataFrame, scores: DataFrame, excluded: list[str] = (), self_id: int | None = None, areas: list[str] = (), around: Around | None = None, floor: float = QUALITY_FLOOR) -> DataFrame:
    """Active places but the subject, of types that aren't excluded (untyped ones drop out), in the areas and the radius, above the floor."""
    out = places.filter("status = 'active'")
    if self_id is not None:
        out = out.filter(F.col("id") != self_id)
    if excluded:
        out = out.filter(~F.col("type").isin(*excluded))
    if areas:
        out = out.filter(F.col("area_term").isin(*areas))
    if around is not None:
        out = out.filter(around.holds(F.col("lat"), F.col("lng")))
    return above_floor(out, scores, floor=floor)


def series_dedup(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Of each series the article with the best score (unscored last, then the least id); those without a series stay."""
    joined = articles.join(scores.select(F.col("entity_id").alias("__id"), F.col("score").alias("__score")), F.col("id") == F.col("__id"), "left")
    w = Window.partitionBy(F.coalesce("series_key", F.concat(F.lit("noseries:"), F.col("id").cast("string")))).orderBy(F.col("__score").desc_nulls_last(), "id")
    return joined.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__id", "__score")


def articles_hard(articles: DataFrame, scores: DataFrame, as_of_day: int, excluded: list[str] = (), self_id: int | None = None, rivals: DataFrame | None = None, floor: float = QUALITY_FLOOR, dedup: bool = True) -> DataFrame:
    """Published articles that are out, but the subject, competitors (untyped ones too), hidden rivals, those under the floor and later ones of a series."""
    out = articles.filter("status = 'published' AND published_day IS NOT NULL").filter(F.col("published_day") <= as_of_day)
    if self_id is not None:
        out = out.filter(F.col("id") != self_id)
    if excluded:
        out = out.filter(F.col("primary_type").isNotNull() & ~F.col("primary_type").isin(*excluded))
        if rivals is not None:
            out = out.join(rivals.filter(F.col("matched_type").isin(*excluded)).select(F.col("article_id").alias("__r")), F.col("id") == F.col("__r"), "left_anti")
    out = above_floor(out, scores, floor=floor)
    return series_dedup(out, scores) if dedup else out


def events_hard(events: DataFrame, places: DataFrame, as_of: int) -> DataFrame:
    """Published events that haven't ended, at no place or at an active one."""
    active = places.filter("status = 'active'").select(F.col("id").alias("__p"))
    out = events.filter("status = 'published'").filter(F.coalesce("ends_at", "starts_at") >= as_of)
    return out.join(active, F.col("place_id") == F.col("__p"), "left").filter("place_id IS NULL OR __p IS NOT NULL").drop("__p")


def without(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't in `gone`: shown in the session, planned, thumbed down."""
    return rows.join(gone.select(F.col(gone.columns[0]).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def open_at(hours: Column, day: int, minute: int) -> Column:
    """Whether one of hours (day 0-6, opens, closes in minutes) holds; past midnight a window belongs to the day before; none known: open."""
    before = (day - 1) % 7

    def holds(h: Column) -> Column:
        over = h["closes"] <= h["opens"]
        today = (h["day"] == day) & (h["opens"] <= minute) & (over | (h["closes"] > minute))
        return today | ((h["day"] == before) & over & (h["closes"] > minute))

    known = F.filter(hours, lambda h: h["opens"].isNotNull() & h["closes"].isNotNull())
    return hours.isNull() | (F.size(hours) == 0) | F.exists(known, holds)


def in_trip(ends_at: Column, start: Column | None, end: Column | None) -> Column:
    """Rows with an end that lies in the trip, and all without one."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (start.isNull() | (ends_at >= start))
    if end is not None:
        ok = ok & (end.isNull() | (ends_at <= end))
    return ends_at.isNull() | ok


def suits_party(amenities: Column, price_band: Column, needs: tuple[str, ...] = (), ceiling: str | None = None) -> Column:
    """Each need by one of its amenities; bands over the ceiling don't suit, unknown ones do."""
    ok = F.lit(True)
    for need in needs:
        ok = ok & F.arrays_overlap(amenities, F.array(*map(F.lit, PARTY_AMENITIES[need])))
    if ceiling in c.PRICE_BANDS:
        ok = ok & F.coalesce(c.price_rank(price_band) <= c.PRICE_BANDS.index(ceiling), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def read_weight(age_days: Column) -> Column:
    """0 just after reading, 1 again after two weeks; 1 if never read."""
    return F.when(age_days.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), age_days / READ_DAYS)))


def soft_weight(read: Column, affinities: Column, seen_not_clicked: Column, same_area_before: Column) -> Column:
    """Product of mild penalties: facets the reader cares little for on average, cards seen in vain, crowded areas."""
    known = F.filter(affinities, lambda a: a.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, a: s + a) / F.nullif(F.size(known), F.lit(0))
    return (
        read
        * F.when(mean < AFFINITY_FROM, LOW_AFFINITY).otherwise(1.0)
        * F.when(seen_not_clicked, SEEN_NOT_CLICKED).otherwise(1.0)
        * F.when(F.coalesce(same_area_before, F.lit(0)) >= CROWDED_FROM, CROWDED_AREA).otherwise(1.0)
    )


def not_muted(facets: Column, muted: Column) -> Column:
    return ~F.coalesce(F.arrays_overlap(facets, muted), F.lit(False))


def trace(checks: dict[str, tuple[Column, Column]]) -> Column:
    """What each filter said of a candidate: array of (filter, passed, reason)."""
    return F.array(*[F.struct(F.lit(k).alias("filter"), F.coalesce(ok, F.lit(False)).alias("passed"), F.when(~F.coalesce(ok, F.lit(False)), why).alias("reason")) for k, (ok, why) in checks.items()])


def survived(entries: Column) -> Column:
    return F.forall(entries, lambda e: e["passed"])


def facet_candidates(rows: DataFrame, chosen: DataFrame, tags: DataFrame, key: str = "id") -> DataFrame:
    """Rows that have, of every facet chosen, one of its chosen terms: (facet, term_id) and tags (entity_id, term_id)."""
    needed = chosen.select("facet").distinct().agg(F.count("*").alias("need"))
    have = tags.join(chosen, "term_id").groupBy(F.col("entity_id").alias("__e")).agg(F.count_distinct("facet").alias("have"))
    full = have.crossJoin(F.broadcast(needed)).filter("have = need").select("__e")
    return rows.join(full, F.col(key) == F.col("__e"), "left_semi")


def resolve_selectors(selectors: DataFrame, terms: DataFrame) -> DataFrame:
    """(selector, facet, term_id) of 'facet:slug' selectors; term_id is null where none is found."""
    split = selectors.select("selector", F.substring_index("selector", ":", 1).alias("facet"), F.expr("substring(selector, instr(selector, ':') + 1)").alias("slug"))
    return split.join(terms.select("facet", "slug", F.col("id").alias("term_id")), ["facet", "slug"], "left").select("selector", "facet", "term_id")


@dataclass(frozen=True)
class Rung:
    name: str
    radius_m: float | None = None
    open_now: bool = False
    area_level: str = "area"
    fresh: bool = True


#: Fixed values of the domain: how the nearby rail relaxes.
LADDER = (
    Rung("strict", 2000, True),
    Rung("widen_radius_5km", 5000, True),
    Rung("widen_radius_15km", 15000, True),
    Rung("drop_open_now", 15000),
    Rung("area_to_district", None, False, "district"),
    Rung("district_to_city", None, False, "city"),
    Rung("drop_freshness", None, False, "city", False),
    Rung("editorial_fallback", None, False, "city", False),
)


def climb(rows: DataFrame, holds: Callable[[Rung], Column], slots: int, rungs: tuple[Rung, ...] = LADDER, by: list[str] = (), order: list[Column] = ()) -> DataFrame:
    """The rows of the first rung that has `slots` of them, cut to slots, or all rows of the last rung; with rung, for each key of `by`.

    Rungs relax, so a row's first rung is enough: running counts by rung tell
    where the ladder stops, with no pass for each rung.
    """
    first = F.coalesce(*[F.when(holds(r), i) for i, r in enumerate(rungs)])
    return _filled(rows.withColumn("rung", first).filter("rung IS NOT NULL"), slots, len(rungs), by, order)


def invariant(excluded: Column, candidate: Column, status: Column) -> Column:
    """What no rung relaxes: no competitor (nor one without a type where anything is excluded), and no place that isn't active; rows without a status aren't places."""
    return ~is_competitor(excluded, candidate) & (status.isNull() | (status == "active"))


def ladder_target(k: int, pool: int) -> int:
    """How many rows a ladder asks for that should fill k slots: some room to choose, but no more than the pool."""
    return min(pool, max(FILL_TIMES * k, k))


def ladder_targets(k: Column, pool: Column) -> Column:
    """The same for columns."""
    return F.least(pool, F.greatest(FILL_TIMES * k, k))


def climb_fetched(fetch: Callable[[Rung], DataFrame], holds_always: Column, slots: int, rungs: tuple[Rung, ...] = LADDER, by: list[str] = (), order: list[Column] = (), key: str = "id", near: Column | None = None) -> DataFrame:
    """climb() over what `fetch` gives for each rung, whatever that is: rows that break `holds_always` are dropped again at every rung, and a row counts from its first rung on.

    near: the first of `order`, if it is a number that rises. Each rung is then cut to rows that a ladder can take before anything is sorted or shuffled; `by` has few values.
    """
    found = None
    for i, rung in enumerate(rungs):
        part = fetch(rung).filter(holds_always).withColumn("rung", F.lit(i))
        if near is not None:
            part = _nearest(part, 2 * slots - 1, by, near, key)
        found = part if found is None else found.unionByName(part)
    rest = [x for x in found.columns if x not in (*by, key)]
    first = found.groupBy(*by, key).agg(F.min_by(F.struct(*rest), "rung").alias("__r")).select(*by, key, "__r.*")
    return _filled(first, slots, len(rungs), by, order)


def _nearest(rows: DataFrame, k: int, by: list[str], near: Column, key: str) -> DataFrame:
    """rows of each `by` without those that surely have k other keys before them: fewer than `slots` of a rung's rows are known from the rungs before, so 2 slots - 1 of it are enough.

    Keys fall into 4 k buckets; k buckets' least values are those of k keys, so what lies beyond the k-th of them is left. That is one pass that holds a number a bucket.
    """
    least = rows.groupBy(*by, F.pmod(F.xxhash64(key), F.lit(4 * k)).alias("__b")).agg(F.min(near).alias("__m")).filter("__m IS NOT NULL")
    limit = least.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy("__m", "__b"))).filter(F.col("__rn") == k).select(*by, F.col("__m").alias("__limit"))
    met = rows.join(F.broadcast(limit), list(by), "left") if by else rows.join(F.broadcast(limit), F.lit(True), "left")
    return met.filter(F.coalesce(near <= F.col("__limit"), F.lit(True))).drop("__limit")


def _filled(ranked: DataFrame, slots: int, rungs: int, by: list[str], order: list[Column]) -> DataFrame:
    """Rows with their first rung, up to the rung where a key's ladder stops."""
    counts = ranked.groupBy(*by, "rung").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy("rung").rowsBetween(Window.unboundedPreceding, 0)
    filled = counts.withColumn("__have", F.sum("__n").over(w)).filter(F.col("__have") >= slots).groupBy(*by).agg(F.min("rung").alias("__stop"))
    joined = ranked.join(filled, list(by), "left") if by else ranked.crossJoin(F.broadcast(filled))
    kept = joined.withColumn("__stop", F.coalesce("__stop", F.lit(rungs - 1))).filter("rung <= __stop").withColumn("rung", F.col("__stop")).drop("__stop")
    if not by:  # an unfilled ladder has less than slots rows, so the limit cuts filled ones only
        return kept.orderBy(*order).limit(slots)
    return kept.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rank") <= slots).drop("__rank")
