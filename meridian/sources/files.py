"""Files in and out: JSON lines, CSV, XML exports, sitemaps, seeds, logs, blobs, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE = "wp_id long, type string, status string, title string, slug string, content_html string, excerpt string, date string, modified string, permalink string, author_id long, thumbnail_id long, categories array<string>, tags array<string>, meta map<string,string>"
SEARCH_CONSOLE = "Query string, Page string, Clicks int, Impressions int, CTR string, Position double"
PERMALINK = "legacy_url string, target_slug string, source string, wp_id long, status int, conflict boolean"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, lines that don't parse are kept in _bad."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return rows


def write_jsonl(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Rows as JSON lines; times as ISO 8601."""
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").option("compression", compression).mode("errorifexists").json(path)


def iso(mysql: Column) -> Column:
    """'2020-01-02 03:04:05' as ISO 8601; the zero date is null."""
    parsed = F.try_to_timestamp(mysql, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(~mysql.startswith("0000"), F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def search_queries(export: DataFrame, permalinks: DataFrame, min_clicks: int = 1) -> DataFrame:
    """(query, wp_id, clicks, impressions): clicked queries of pages whose address is known, slash or none at its end."""
    bare = lambda u: F.regexp_replace(F.lower(u), "/+$", "")
    known = permalinks.filter("NOT coalesce(conflict, false)").select(bare(F.col("legacy_url")).alias("__u"), "wp_id")
    rows = export.filter(F.col("Clicks") >= min_clicks).withColumn("__p", bare(F.col("Page")))
    return rows.join(known, F.col("__p") == F.col("__u")).groupBy(F.col("Query").alias("query"), "wp_id").agg(F.sum("Clicks").alias("clicks"), F.sum("Impressions").alias("impressions"))


def _last_of_key(metas: Column) -> Column:
    """A map of meta values; of a key that comes more than once the last value."""
    some = F.filter(F.coalesce(metas, F.array().cast("array<struct<`wp:meta_key`:string,`wp:meta_value`:string>>")), lambda m: m["wp:meta_key"].isNotNull())
    keys = F.array_distinct(F.transform(some, lambda m: m["wp:meta_key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(some, lambda m: m["wp:meta_key"] == k), -1)["wp:meta_value"]))


def read_wxr(spark: SparkSession, path: str) -> DataFrame:
    """Items of an XML export: one row an <item>, read split by split."""
    term = "array<struct<_VALUE:string,_domain:string,_nicename:string>>"
    schema = f"title string, link string, `content:encoded` string, `excerpt:encoded` string, `wp:post_id` long, `wp:post_type` string, `wp:status` string, `wp:post_name` string, `wp:post_date` string, `dc:creator` string, `wp:attachment_url` string, category {term}, `wp:postmeta` array<struct<`wp:meta_key`:string,`wp:meta_value`:string>>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "item").option("ignoreNamespace", False).load(path)
    terms = lambda d: F.transform(F.filter("category", lambda c: c["_domain"] == d), lambda c: c["_nicename"])
    return rows.select(
        F.col("`wp:post_id`").alias("wp_id"),
        F.col("`wp:post_type`").alias("type"),
        F.col("`wp:status`").alias("status"),
        "title",
        F.col("`wp:post_name`").alias("slug"),
        F.col("`content:encoded`").alias("content_html"),
        F.col("`excerpt:encoded`").alias("excerpt"),
        iso(F.col("`wp:post_date`")).alias("date"),
        F.col("link").alias("permalink"),
        F.col("`dc:creator`").alias("author"),
        F.col("`wp:attachment_url`").alias("attachment_url"),
        F.coalesce(terms("category"), F.array().cast("array<string>")).alias("categories"),
        F.coalesce(terms("post_tag"), F.array().cast("array<string>")).alias("tags"),
        _last_of_key(F.col("`wp:postmeta`")).alias("meta"),
        F.input_file_name().alias("file"),
    )


def dedupe_items(items: DataFrame, key: str = "wp_id", source: str = "file") -> DataFrame:
    """One row a key over several files: that of the first file."""
    w = Window.partitionBy(key).orderBy(source)
    return items.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def posts(rows: DataFrame, post_type: str, status: str = "publish") -> DataFrame:
    return rows.filter((F.col("post_type") == post_type) & (F.col("post_status") == status))


def terms_by_object(relationships: DataFrame, taxonomy: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """(object_id, names, term_ids) of a taxonomy: three tables joined and gathered."""
    joined = relationships.join(F.broadcast(taxonomy.filter(F.col("taxonomy") == kind)), "term_taxonomy_id").join(F.broadcast(terms), "term_id")
    listed = joined.groupBy("object_id").agg(F.array_sort(F.collect_set(F.struct("name", "term_id"))).alias("l"))
    return listed.select("object_id", F.transform("l", lambda x: x["name"]).alias("names"), F.transform("l", lambda x: x["term_id"]).alias("term_ids"))


def meta_map(postmeta: DataFrame, keys: list[str]) -> DataFrame:
    """(post_id, meta): one map a post; of a key's several rows the last holds."""
    last = postmeta.filter(F.col("meta_key").isin(*keys)).groupBy("post_id", "meta_key").agg(F.max_by("meta_value", "meta_id").alias("v"))
    return last.groupBy("post_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("meta_key", "v")))).alias("meta"))


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """Distinct addresses that sitemap files name: (loc, child), child for those of sitemap indexes."""
    docs = spark.read.text(path, wholetext=True)
    child = F.col("value").rlike("(?i)<sitemapindex")
    return docs.select(child.alias("child"), F.explode(F.regexp_extract_all("value", F.lit("(?is)<loc>\\s*(?:<!\\[CDATA\\[)?\\s*(.*?)\\s*(?:\\]\\]>)?\\s*</loc>"), 1)).alias("loc")).distinct()


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A tree of terms, three levels deep, as (facet, slug, label, parent, depth)."""
    leaf = "struct<slug:string,label:string>"
    mid = f"struct<slug:string,label:string,children:array<{leaf}>>"
    top = f"struct<slug:string,label:string,children:array<{mid}>>"
    seed = spark.read.schema(f"facet string, terms array<{top}>").option("multiLine", True).json(path)
    a = seed.select("facet", F.explode("terms").alias("t"))
    b = a.select("facet", F.col("t.slug").alias("parent"), F.explode("t.children").alias("t"))
    c = b.select("facet", F.col("t.slug").alias("parent"), F.explode("t.children").alias("t"))
    level = lambda d, parent, n: d.select("facet", "t.slug", "t.label", parent.alias("parent"), F.lit(n).alias("depth"))
    return level(a, F.lit(None).cast("string"), 0).unionByName(level(b, F.col("parent"), 1)).unionByName(level(c, F.col("parent"), 2))


def check_seed(seed: DataFrame) -> DataFrame:
    """(facet, slug, problem): slugs given twice in a facet, and empty labels."""
    twice = seed.groupBy("facet", "slug").agg(F.count("*").alias("n")).filter("n > 1").select("facet", "slug", F.lit("twice").alias("problem"))
    return twice.unionByName(seed.filter("label IS NULL OR trim(label) = ''").select("facet", "slug", F.lit("no label").alias("problem")))


def append_events(batch: DataFrame, path: str, as_of_day: str, back: int = 1, ahead: int = 7) -> int:
    """Append a batch by day, all or nothing: a row outside [as_of - back, as_of + ahead] or without a valid id refuses the batch."""
    day = F.to_date("ts")
    inside = day.between(F.date_sub(F.lit(as_of_day).cast("date"), back), F.date_add(F.lit(as_of_day).cast("date"), ahead))
    valid = inside & F.col("session_id").rlike("^[0-9a-fA-F-]{36}$") & F.coalesce(F.col("entity_id").rlike("^(0|[1-9][0-9]*)$"), F.lit(True))
    counts = batch.agg(F.count("*").alias("n"), F.count(F.when(~F.coalesce(valid, F.lit(False)), 1)).alias("bad")).first()
    if counts.bad:
        raise ValueError(f"{counts.bad} of {counts.n} events are out of range or malformed; none was written")
    batch.withColumn("dt", day).write.partitionBy("dt").mode("append").parquet(path)
    return counts.n


def retained(log: DataFrame, as_of_day: str, days: int) -> DataFrame:
    """Days that are kept: a filter on the partition column, so older folders aren't read."""
    return log.filter(F.col("dt") >= F.date_sub(F.lit(as_of_day).cast("date"), days))


def fresh(cache: DataFrame, as_of: int, ttl_s: int = 6 * 3600) -> DataFrame:
    """Rows of a keyed cache that aren't over their time."""
    return cache.filter(F.col("computed_at") >= as_of - ttl_s)


def feature_log(features: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept."""
    return features.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def not_done(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows that a ledger of done keys doesn't have: how a run goes on after a stop."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti")


def media_inventory(inline: DataFrame, attachments: DataFrame) -> DataFrame:
    """(key, urls, sources): media addresses of bodies and attachments, folded by their address without query and size suffix."""
    both = inline.select("url", F.lit("inline").alias("source")).unionByName(attachments.select("url", F.lit("attachment").alias("source")))
    bare = F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "-[0-9]+x[0-9]+(\\.[a-z0-9]+)$", "$1")
    return both.groupBy(F.regexp_replace(bare, "^https?://(www\\.)?", "").alias("key")).agg(F.array_sort(F.collect_set("url")).alias("urls"), F.array_sort(F.collect_set("source")).alias("sources"))


#: First bytes of image formats, in hex.
MAGIC = (("jpg", "^FFD8FF"), ("png", "^89504E470D0A1A0A"), ("gif", "^474946383[79]61"), ("webp", "^52494646.{8}57454250"), ("svg", "^(EFBBBF)?3C(3F786D6C|737667)"))


def sniff_image(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(MAGIC):
        out = F.when(head.rlike(pattern), kind).otherwise(out)
    return out


def blobs(spark: SparkSession, path: str, city: str) -> DataFrame:
    """Binary files by content: (object_key, sha256, ext, path, bytes); equal contents have one key."""
    files = spark.read.format("binaryFile").load(path)
    sha, ext = F.sha2("content", 256), sniff_image(F.col("content"))
    key = F.concat(F.lit(f"{city}/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.coalesce(F.concat(F.lit("."), ext), F.lit("")))
    return files.select(key.alias("object_key"), sha.alias("sha256"), ext.alias("ext"), "path", F.col("length").alias("bytes"))


def stratified(urls: DataFrame, by: str, n: int, seed: str = "0") -> DataFrame:
    """n addresses, spread over strata in turn, by a stable hash."""
    each = urls.withColumn("__t", F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "url"), 256))))
    return each.orderBy("__t", F.sha2(F.concat_ws(":", F.lit(seed), by), 256), "url").limit(n).drop("__t")


def side_metadata(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with numbers only; values that aren't any are dropped, the largest of a key's stays."""
    return rows.select(F.expr(f"try_cast({key} AS long)").alias(key), F.expr(f"try_cast({value} AS long)").alias(value)).filter(f"{key} IS NOT NULL AND {value} IS NOT NULL").groupBy(key).agg(F.max(value).alias(value))


def report(title: str, rows: DataFrame, limit: int = 50) -> str:
    """A markdown table of at most `limit` rows, for reading: the sizes of reports are fixed."""
    got = rows.limit(limit).collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got) + "\n"
