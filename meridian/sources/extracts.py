"""Entities out of a blog's tables or exports: articles, attachments, events, places on maps, redirects, users, venues, and loaders of what comes beside them.

Posts: (ID, post_type, post_status, post_title, post_name, post_content, post_excerpt, post_date, post_modified, post_author, guid, post_mime_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, php

#: Fixed values of the format: names of meta rows.
ARTICLE_META = ("_thumbnail_id", "_yoast_wpseo_focuskw", "_yoast_wpseo_metadesc", "_yoast_wpseo_primary_category", "_yoast_wpseo_title")
ATTACHMENT_META = ("_wp_attached_file", "_wp_attachment_image_alt", "_wp_attachment_metadata")
EVENT_META = ("_EventAllDay", "_EventCost", "_EventCurrencySymbol", "_EventEndDate", "_EventOrganizerID", "_EventStartDate", "_EventVenueID", "_thumbnail_id")
VENUE_META = ("_VenueAddress", "_VenueCity", "_VenueCountry", "_VenuePhone", "_VenueProvince", "_VenueState", "_VenueStateProvince", "_VenueURL", "_VenueVenue", "_VenueZip", "_thumbnail_id")


def _with_meta(posts: DataFrame, postmeta: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    meta = files.meta_map(postmeta, list(keys)).withColumnRenamed("post_id", "__m")
    return posts.join(meta, F.col("ID") == F.col("__m"), "left").drop("__m").withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def _meta(key: str) -> Column:
    """A meta value; empty ones are null."""
    return F.nullif(F.try_element_at("meta", F.lit(key)), F.lit(""))


def _id(key: str) -> Column:
    return F.nullif(_meta(key).try_cast("long"), F.lit(0).cast("long"))


def _common(kind: str | Column) -> list[Column]:
    return [F.col("ID").alias("wp_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.col("post_status").alias("status"), F.col("post_name").alias("slug"), files.iso(F.col("post_date")).alias("date"), files.iso(F.col("post_modified")).alias("modified")]


def articles(posts: DataFrame, categories: DataFrame, postmeta: DataFrame, home: str) -> DataFrame:
    """Published posts with their categories, the primary one first, and their meta values. categories: (object_id, names, term_ids)."""
    rows = _with_meta(files.posts(posts, "post"), postmeta, ARTICLE_META).join(categories.withColumnRenamed("object_id", "__o"), F.col("ID") == F.col("__o"), "left")
    at = F.array_position("term_ids", _id("_yoast_wpseo_primary_category"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    first = F.when(at > 0, F.concat(F.slice("names", at.cast("int"), 1), F.slice("names", 1, (at - 1).cast("int")), F.slice("names", (at + 1).cast("int"), F.size("names")))).otherwise(names)
    return rows.select(
        *_common("post"),
        F.col("post_title").alias("title"),
        F.col("post_content").alias("content_html"),
        F.col("post_excerpt").alias("excerpt"),
        F.concat(F.lit(home.rstrip("/") + "/"), F.col("post_name"), F.lit("/")).alias("permalink"),
        F.col("post_author").alias("author_id"),
        F.coalesce(first, names).alias("categories"),
        F.map_filter("meta", lambda k, _: k != "_thumbnail_id").alias("meta"),
        _id("_thumbnail_id").alias("thumbnail_id"),
    )


def attachments(posts: DataFrame, postmeta: DataFrame, home: str) -> DataFrame:
    """Attachments of any status with the address of their file, which the attached file tells more surely than the guid, and their size."""
    rows = _with_meta(posts.filter("post_type = 'attachment'"), postmeta, ATTACHMENT_META).withColumn("__size", php.php_to_json(_meta("_wp_attachment_metadata")))
    file = _meta("_wp_attached_file")
    size = lambda k: F.get_json_object("__size", f"$.{k}").try_cast("int")
    return rows.select(*_common("attachment"), F.coalesce(F.concat(F.lit(home.rstrip("/") + "/wp-content/uploads/"), file), "guid").alias("url"), file.alias("file"), F.col("post_mime_type").alias("mime"), F.col("post_title").alias("title"), _meta("_wp_attachment_image_alt").alias("alt"), size("width").alias("width"), size("height").alias("height"))


def events(posts: DataFrame, categories: DataFrame, postmeta: DataFrame) -> DataFrame:
    """Calendar events of any status with their organiser's name; posts that only announce have no dates of their own. categories: (object_id, names) of both kinds of event."""
    organisers = posts.filter("post_type = 'tribe_organizer'").select(F.col("ID").alias("__org"), F.col("post_title").alias("organizer_name"))
    rows = _with_meta(posts.filter("post_type IN ('tribe_events', 'upcoming-events')"), postmeta, EVENT_META).withColumn("organizer_id", _id("_EventOrganizerID"))
    rows = rows.join(organisers, F.col("organizer_id") == F.col("__org"), "left").join(categories.select(F.col("object_id").alias("__o"), "names"), F.col("ID") == F.col("__o"), "left")
    dated = F.col("post_type") == "tribe_events"
    own = lambda x: F.when(dated, x)
    return rows.select(
        *_common(F.col("post_type")),
        F.col("post_title").alias("title"),
        own(files.iso(_meta("_EventStartDate"))).alias("start_date"),
        own(files.iso(_meta("_EventEndDate"))).alias("end_date"),
        own(F.coalesce(_meta("_EventAllDay") == "yes", F.lit(False))).alias("all_day"),
        own(_id("_EventVenueID")).alias("venue_id"),
        own(F.col("organizer_id")).alias("organizer_id"),
        own(F.col("organizer_name")).alias("organizer_name"),
        own(_meta("_EventCost")).alias("cost"),
        own(_meta("_EventCurrencySymbol")).alias("currency"),
        F.coalesce("names", F.array().cast("array<string>")).alias("categories"),
        _id("_thumbnail_id").alias("thumbnail_id"),
    )


def venues(posts: DataFrame, postmeta: DataFrame) -> DataFrame:
    rows = _with_meta(posts.filter("post_type = 'tribe_venue'"), postmeta, VENUE_META)
    named = {"address": "_VenueAddress", "city": "_VenueCity", "province": "_VenueProvince", "zip": "_VenueZip", "country": "_VenueCountry", "phone": "_VenuePhone", "url": "_VenueURL"}
    return rows.select(*_common("tribe_venue"), F.coalesce(_meta("_VenueVenue"), "post_title").alias("name"), F.coalesce(_meta("_VenueState"), _meta("_VenueStateProvince")).alias("state"), *[_meta(k).alias(n) for n, k in named.items()], _id("_thumbnail_id").alias("thumbnail_id"))


def map_points(maps: DataFrame, placed: DataFrame) -> DataFrame:
    """(map_id, wp_id, poi_index, title, address, lat, lng) of the points of serialised maps, or of a map's centre where it has none, for each post that shows the map. maps: (mapid, obj); placed: (postid, mapid)."""
    point = "struct<title:string,address:string,lat:string,lng:string,point:struct<lat:string,lng:string>>"
    read = lambda kind: F.from_json("__json", f"title string, center struct<lat:string,lng:string>, pois {kind}")
    rows = maps.withColumn("__json", php.php_to_json(F.col("obj"))).filter("__json IS NOT NULL")
    rows = rows.withColumns({"__m": read(f"array<{point}>"), "__keyed": read(f"map<string,{point}>")})
    pois = F.coalesce(F.col("__m.pois"), F.map_values("__keyed.pois"), F.array().cast(f"array<{point}>"))
    each = rows.select("mapid", "__keyed.title", "__keyed.center", F.posexplode_outer(pois).alias("poi_index", "p"))
    at = lambda k: F.coalesce(F.col(f"p.{k}"), F.col(f"p.point.{k}"), F.when(F.col("p").isNull(), F.col(f"center.{k}"))).try_cast("double")
    shown = placed.select(F.col("mapid").alias("__map"), F.col("postid").alias("wp_id"))
    return each.join(shown, F.col("mapid") == F.col("__map"), "left").select(F.col("mapid").alias("map_id"), "wp_id", "poi_index", F.coalesce("p.title", "title").alias("title"), F.col("p.address").alias("address"), F.when(at("lng").isNotNull(), at("lat")).alias("lat"), F.when(at("lat").isNotNull(), at("lng")).alias("lng"))


def redirects(items: DataFrame) -> DataFrame:
    """Redirection rules as they stand; empty targets are null."""
    blank = lambda x: F.nullif(F.col(x), F.lit(""))
    return items.select(F.col("id").alias("wp_id"), F.col("url").alias("source_url"), blank("match_url").alias("match_url"), (F.col("regex") == 1).alias("is_regex"), "match_type", "status", "action_type", "action_code", blank("action_data").alias("target"), "group_id", F.col("last_count").alias("hit_count"))


def users(rows: DataFrame, posts: DataFrame) -> DataFrame:
    """Users with how many posts they have published; nothing that opens a door comes along."""
    counts = files.posts(posts, "post").groupBy(F.col("post_author").alias("__a")).agg(F.count("*").alias("posts"))
    return rows.join(counts, F.col("ID") == F.col("__a"), "left").select(F.col("ID").alias("wp_id"), F.col("user_login").alias("login"), F.col("user_nicename").alias("slug"), F.col("user_email").alias("email"), "display_name", files.iso(F.col("user_registered")).alias("registered"), F.coalesce("posts", F.lit(0)).alias("published"))


def coverage(rows: DataFrame, **known: Column) -> DataFrame:
    """One row of an extract's statistics: its rows, and for each named condition how many meet it and their share in percent."""
    share = lambda n: F.round(100 * F.col(n) / F.nullif("rows", F.lit(0)), 1)
    sums = rows.agg(F.count("*").alias("rows"), *[F.count(F.when(ok, 1)).alias(n) for n, ok in known.items()])
    return sums.select("rows", *known, *[F.coalesce(share(n), F.lit(0.0)).alias(f"{n}_pct") for n in known])


def from_export(items: DataFrame, kind: str) -> DataFrame:
    """Articles, attachments, authors, terms, points (geo) or events of an XML export's items (files.read_wxr), one row a key over several files."""
    once = files.dedupe_items(items)
    if kind == "articles":
        return once.filter("type = 'post' AND status = 'publish'").select("wp_id", "type", "status", "title", "slug", "content_html", "excerpt", "date", "permalink", "author", "categories", "tags")
    if kind == "attachments":
        return once.filter("type = 'attachment'").select("wp_id", F.col("attachment_url").alias("url"), "title", "slug", "date")
    if kind == "authors":
        return once.filter("author IS NOT NULL").groupBy("author").agg(F.count("*").alias("items"), F.count(F.when((F.col("type") == "post") & (F.col("status") == "publish"), 1)).alias("published"))
    if kind == "terms":
        each = once.select(F.explode(F.concat(F.transform("categories", lambda x: F.struct(F.lit("category").alias("taxonomy"), x.alias("slug"))), F.transform("tags", lambda x: F.struct(F.lit("post_tag").alias("taxonomy"), x.alias("slug"))))).alias("t"))
        return each.groupBy("t.taxonomy", "t.slug").agg(F.count("*").alias("items"))
    if kind == "geo":  # points that posts carry themselves; maps of a plugin's own tables aren't in an export
        read = F.from_json(php.php_to_json(F.col("meta").getItem("google_map")), "name string, address string, lat string, lng string, place_id string")
        rows = once.withColumn("g", read).filter("g IS NOT NULL")
        at = {k: F.col(f"g.{k}").try_cast("double") for k in ("lat", "lng")}
        both = at["lat"].isNotNull() & at["lng"].isNotNull()
        return rows.select("wp_id", F.col("g.name").alias("title"), F.col("g.address").alias("address"), *[F.when(both, x).alias(k) for k, x in at.items()], F.col("g.place_id").alias("place_id"))
    if kind == "events":
        value = lambda k: F.nullif(F.col("meta").getItem(k), F.lit(""))
        return once.filter("type IN ('tribe_events', 'upcoming-events')").select("wp_id", "type", "status", "title", "slug", files.iso(value("_EventStartDate")).alias("start_date"), files.iso(value("_EventEndDate")).alias("end_date"), value("_EventVenueID").try_cast("long").alias("venue_id"), value("_EventCost").alias("cost"), "categories")
    raise ValueError(f"no extract {kind!r}")


#: Category priors: what a category says of the articles in it.
PRIORS = "categories array<struct<wp_term_id:long,name:string,slug:string,parent:long,is_print_issue:boolean,published:long,yoast_primary:long,prior:struct<type:string,subtype:string,format:string,location:string,facets:array<string>>,per_article:array<string>>>"


def category_priors(spark: SparkSession, path: str) -> DataFrame:
    """(wp_term_id, slug, parent, type, subtype, format, location, facet) of a mapping file, one row a facet; categories of print issues left out."""
    rows = spark.read.schema(PRIORS).option("multiLine", True).json(path).select(F.explode("categories").alias("c"))
    return rows.filter("NOT coalesce(c.is_print_issue, false)").select("c.wp_term_id", "c.slug", "c.parent", "c.prior.type", "c.prior.subtype", "c.prior.format", "c.prior.location", F.explode_outer("c.prior.facets").alias("facet"))


def search_rows(articles_: DataFrame) -> DataFrame:
    """(entity_id, title, dek, body, text_hash) as search and embedding stages read them: published articles, read from Parquet with their filter pushed down."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("dek", F.lit("")), F.coalesce("body", F.lit("")))
    return articles_.filter("status = 'published'").select(F.col("id").cast("string").alias("entity_id"), "title", "dek", "body", F.sha2(text, 256).alias("text_hash"))
