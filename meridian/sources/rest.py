"""Records of a content service's REST answers as flat rows: posts, terms, users, comments, media.

Items come as JSON texts (pages.read_pages, commits.read_sink); each kind has the
schema of what is taken of it, so a field that an answer lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

_TEXT = "struct<raw:string,rendered:string>"
_SIZE = "struct<file:string,width:int,height:int,mime_type:string,source_url:string,filesize:long>"
#: Fixed values of the domain: what is read of each kind of record.
SCHEMAS = {
    "posts": f"id long, type string, status string, title {_TEXT}, content {_TEXT}, excerpt {_TEXT}, date string, date_gmt string, modified string, author long, link string, slug string, categories array<long>, tags array<long>, featured_media long, comment_status string, format string, template string",
    "terms": "id long, taxonomy string, name string, slug string, parent long, count long, description string",
    "users": "id long, slug string, name string, email string, url string, registered_date string, description string, avatar_urls map<string,string>",
    "comments": f"id long, post long, parent long, author long, author_name string, author_url string, date string, date_gmt string, content {_TEXT}, status string, type string",
    "media": f"id long, source_url string, guid {_TEXT}, mime_type string, media_type string, title {_TEXT}, caption {_TEXT}, slug string, alt_text string, filename string, filesize long, post long, author long, date string, date_gmt string, modified_gmt string, media_details struct<file:string,width:int,height:int,filesize:long,sizes:map<string,{_SIZE}>,image_meta:struct<credit:string,copyright:string>>",
}


def _known(x: Column) -> Column:
    """Text with something in it, else null."""
    return F.when(F.trim(x) != "", x)


def _id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0).cast("long")).alias(name)


def _rendered(name: str) -> Column:
    return _known(F.col(f"{name}.rendered"))


def _raw(name: str) -> Column:
    """What was written, where the answer has it; else what is shown."""
    return F.when(F.col(f"{name}.raw").isNotNull(), _known(F.col(f"{name}.raw"))).otherwise(_rendered(name))


def _decoded(x: Column) -> Column:
    """Text with named and numeric entities decoded."""

    def part(p: Column, i: Column) -> Column:
        code = F.regexp_extract(p, "^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        number = F.when(F.lower(code).startswith("x"), F.conv(F.substr(code, F.lit(2)), 16, 10)).otherwise(code).cast("long")
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(i == 0, p).when(code == "", F.concat(F.lit("&#"), p)).otherwise(F.concat(sign, F.regexp_replace(p, "^[xX]?[0-9a-fA-F]+;", "")))

    numeric = F.array_join(F.transform(F.split(x, "&#", -1), part), "")
    return c.unescape(F.when(F.contains(x, F.lit("&#")), numeric).otherwise(x))


def _plain(x: Column) -> Column:
    return _known(F.trim(_decoded(F.regexp_replace(x, "<[^>]+>", ""))))


def records(items: DataFrame, kind: str, column: str = "item") -> DataFrame:
    """The records of JSON texts under their kind's schema; a text that doesn't parse, or has no id, is left out."""
    return items.select(F.from_json(column, SCHEMAS[kind]).alias("r")).filter("r.id IS NOT NULL").select("r.*")


def posts(rows: DataFrame, terms_: DataFrame | None = None) -> DataFrame:
    """Posts with the raw text where there is one, and with terms_ (term_id, name) the names of their categories and tags in order; unknown ids have no name."""
    out = rows.select(
        F.col("id").alias("wp_id"), "type", "status", _plain(F.col("title.rendered")).alias("title"), _raw("content").alias("content_html"), F.col("content.raw").isNotNull().alias("content_is_raw"), _raw("excerpt").alias("excerpt"),
        "date", "date_gmt", "modified", F.col("author").alias("author_id"), F.col("link").alias("permalink"), "slug",
        F.coalesce("categories", F.array().cast("array<long>")).alias("category_ids"), F.coalesce("tags", F.array().cast("array<long>")).alias("tag_ids"),
        _id("featured_media").alias("thumbnail_id"), "comment_status", "format", F.nullif(F.col("template"), F.lit("")).alias("template"),
    )
    if terms_ is None:
        return out
    for name in ("category", "tag"):
        each = out.select("wp_id", F.posexplode(f"{name}_ids").alias("pos", "term_id")).join(terms_.filter("name IS NOT NULL").select("term_id", "name"), "term_id")
        named = each.groupBy(F.col("wp_id").alias("__w")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("__n"))
        out = out.join(named, F.col("wp_id") == F.col("__w"), "left").withColumn({"category": "categories", "tag": "tags"}[name], F.coalesce("__n", F.array().cast("array<string>"))).drop("__w", "__n")
    return out


def terms(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("term_id"), F.col("id").alias("term_taxonomy_id"), "taxonomy", _known(_decoded(F.col("name"))).alias("name"), "slug", _id("parent"), "count", _known(F.col("description")).alias("description"))


def users(rows: DataFrame) -> DataFrame:
    """Users; address and registration are null where the answer hides them, as is the number of posts, which no answer has."""
    return rows.select(F.col("id").alias("wp_id"), F.col("slug").alias("login"), F.col("slug").alias("nicename"), _known(_decoded(F.col("name"))).alias("display_name"), "email", _known(F.col("url")).alias("url"), F.col("registered_date").alias("registered"), _known(F.col("description")).alias("description"), F.when(F.size("avatar_urls") > 0, F.col("avatar_urls")).alias("avatar_urls"), F.lit(None).cast("long").alias("published_post_count"))


def comments(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("wp_id"), F.col("post").alias("post_wp_id"), _id("parent").alias("parent_wp_id"), _id("author").alias("author_wp_id"), _known(_decoded(F.col("author_name"))).alias("author_name"), _known(F.col("author_url")).alias("author_url"), "date", "date_gmt", _raw("content").alias("content_html"), "status", "type")


def match_keys(url: Column, file: Column) -> Column:
    """What an address in a text may be known by, surest first: the path, the path of the file, its name, and the name without size or copy suffix."""
    path = F.nullif(F.regexp_replace(F.regexp_replace(url, "^[a-z][a-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", ""), F.lit(""))
    name = F.nullif(F.element_at(F.split(F.coalesce(path, file, F.lit("")), "/"), -1), F.lit(""))
    stem, ext = F.regexp_extract(name, "^(.*)\\.([^.]*)$", 1), F.regexp_extract(name, "^(.*)\\.([^.]*)$", 2)
    bare = F.regexp_replace(stem, "-[0-9]+x[0-9]+$", "")
    dotted = lambda x: F.when(F.contains(name, F.lit(".")), F.concat(x, F.lit("."), ext))
    keys = F.array(path, F.concat(F.lit("/wp-content/uploads/"), _known(file)), name, dotted(bare), dotted(F.regexp_replace(bare, "-[0-9]+$", "")))
    return F.array_distinct(F.array_compact(keys))


def media(rows: DataFrame) -> DataFrame:
    """Attachments with the address to fetch, their sizes by name, and the keys that an address in a text may match."""
    d = lambda k: F.col(f"media_details.{k}")
    url = F.coalesce("source_url", _rendered("guid"))
    size = lambda k, v: F.struct(k.alias("name"), *[v[x].alias(x) for x in ("file", "width", "height")], v["mime_type"].alias("mime"), v["source_url"].alias("source_url"), v["filesize"].alias("filesize"))
    sizes = F.array_sort(F.transform(F.map_entries(d("sizes")), lambda e: size(e["key"], e["value"])))
    return rows.select(
        F.col("id").alias("wp_id"), url.alias("url"), _rendered("guid").alias("guid"), d("file").alias("file"), F.coalesce("filename", F.element_at(F.split(d("file"), "/"), -1)).alias("filename"), F.col("mime_type").alias("mime"), "media_type",
        _rendered("title").alias("title"), "slug", _known(F.trim("alt_text")).alias("alt"), _rendered("caption").alias("caption"), _known(F.trim(d("image_meta.credit"))).alias("credit"), _known(F.trim(d("image_meta.copyright"))).alias("copyright"),
        d("width").alias("width"), d("height").alias("height"), F.coalesce(F.nullif(F.col("filesize"), F.lit(0).cast("long")), d("filesize")).alias("filesize"), _id("post").alias("parent_post_id"), _id("author").alias("author_wp_id"),
        "date", "date_gmt", "modified_gmt", F.coalesce(sizes, F.array().cast("array<struct<name:string,file:string,width:int,height:int,mime:string,source_url:string,filesize:long>>")).alias("sizes"), match_keys(url, d("file")).alias("match_keys"),
    )
