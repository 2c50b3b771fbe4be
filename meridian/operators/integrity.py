"""Integrity: drift between a column and its facts, orphans, effective dates, schemas, links, triage."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c


def drift(rows: DataFrame, facts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, fact, kind): rows whose column disagrees with the fact, or has none. facts: (key, fact)."""
    both = rows.select(key, value).join(facts.select(key, "fact"), key, "left")
    kind = F.when(F.col("fact").isNull() & F.col(value).isNotNull(), "missing").when(~F.col(value).eqNullSafe(F.col("fact")), "disagree")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL")


def reconcile(found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action, fact): rows that set the fact right."""
    return found.select(key, F.when(F.col("kind") == "missing", "insert").otherwise("update").alias("action"), F.col(value).alias("fact"))


def orphans(rows: DataFrame, known: DataFrame, reference: str, key: str, samples: int = 5) -> DataFrame:
    """(reference, n, samples) of references that nothing known bears."""
    lost = rows.filter(F.col(reference).isNotNull()).join(known.select(F.col(key).alias("__k")), F.col(reference) == F.col("__k"), "left_anti")
    counts = lost.groupBy(reference).agg(F.count("*").alias("n"))
    if rows.columns[0] == reference:
        return counts.withColumn("samples", F.array())
    return counts.join(_least(lost, reference, rows.columns[0], samples), reference)


def _least(rows: DataFrame, by: str, value: str, samples: int) -> DataFrame:
    """(by, samples): the least few distinct values of each key, cut by rank before they are collected."""
    some = rows.filter(F.col(value).isNotNull()).select(by, value).distinct().withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(value))).filter(F.col("__rank") <= samples)
    return some.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("samples"))


def effective(status: Column, starts: Column, ends: Column, at: Column) -> Column:
    """Active, begun, and not yet over; no end holds on."""
    return (status == "active") & (starts.isNull() | (starts <= at)) & (ends.isNull() | (ends > at))


def schema_hash(df: DataFrame) -> str:
    """SHA-256 of a schema's canonical form: columns by name, with type and whether null."""
    fields = sorted((f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields)
    return hashlib.sha256(json.dumps(fields).encode()).hexdigest()


def schema_diff(a: DataFrame, b: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """(column, kind, left, right) of columns that were added, removed or changed their type."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    out = []
    for name in sorted({*x, *y}):
        if x.get(name) != y.get(name):
            out.append((name, "added" if name not in x else "removed" if name not in y else "changed", x.get(name), y.get(name)))
    return out


#: Fixed values of the domain: hosts that are no partner, by class; their subdomains are of the same class.
HOST_CLASSES = {
    "social": ("facebook.com", "instagram.com", "line.me", "linkedin.com", "linktr.ee", "open.spotify.com", "pinterest.com", "threads.net", "tiktok.com", "twitter.com", "x.com", "youtu.be", "youtube.com"),
    "stock": ("flickr.com", "freepik.com", "gettyimages.com", "istockphoto.com", "pexels.com", "pixabay.com", "shutterstock.com", "unsplash.com"),
    "shortener": ("app.link", "bit.ly", "buff.ly", "cutt.ly", "go2cloud.org", "goo.gl", "lnk.bio", "onelink.me", "ow.ly", "rebrand.ly", "s.id", "t.co", "tinyurl.com"),
    "utility": ("api.whatsapp.com", "apps.apple.com", "calendly.com", "eepurl.com", "forms.gle", "google.com", "gravatar.com", "mailchimp.com", "schema.org", "w.org", "wa.me", "wikipedia.org", "wordpress.com", "wp.com", "zoom.us"),
}


def host_class(netloc: Column, own: tuple[str, ...] = ()) -> Column:
    """internal, social, stock, shortener, utility, or null for a host worth following."""
    out = F.lit(None).cast("string")
    for name, suffixes in (*reversed(HOST_CLASSES.items()), ("internal", own)):
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | (netloc == s) | netloc.endswith("." + s)
        out = F.when(hit, name).otherwise(out)
    return out


def links_by_domain(links: DataFrame, samples: int = 8) -> DataFrame:
    """Of each host its links, articles, first and last day, rel kinds and first samples. links: article_id, day, href, rel, netloc."""
    rel = F.coalesce(F.col("rel"), F.lit(""))
    sums = links.groupBy("netloc").agg(
        F.count("*").alias("links"),
        F.count_distinct("article_id").alias("articles"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count(F.when(rel.contains("sponsored"), 1)).alias("sponsored"),
        F.count(F.when(rel.contains("nofollow") & ~rel.contains("sponsored"), 1)).alias("nofollow"),
        F.count(F.when(~rel.contains("sponsored") & ~rel.contains("nofollow"), 1)).alias("plain"),
    )
    return sums.join(_least(links, "netloc", "href", samples), "netloc", "left")


def decorate_link(href: Column, tier: Column, campaign: str) -> Column:
    """A link as its partner's tier has it: paid and listed ones with campaign marks and rel, others without a link."""
    marked = F.concat(href, F.when(F.instr(href, "?") > 0, "&").otherwise("?"), F.lit(f"utm_source=site&utm_campaign={campaign}"))
    rel = F.when(tier == "paid", "sponsored noopener").when(tier == "listed", "nofollow noopener")
    return F.struct(F.when(rel.isNotNull(), marked).alias("href"), rel.alias("rel"))


def triage(verdict: Column, region: Column, evidence: Column, partner: Column) -> Column:
    """What to do with a place: partners stay; junk goes unless there is evidence; the rest by region and rank."""
    return F.when(partner, "keep").when((verdict == "junk") & (evidence == 0), "archive").when(verdict != "ok", "review").when(region == "outside", "review").otherwise("keep")


def in_country(lat: Column, lng: Column) -> Column:
    """Within the country's box."""
    return lat.between(-11.5, 6.5) & lng.between(94.5, 141.5)


def valid_uuid(text: Column) -> Column:
    return F.lower(text).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def valid_native_id(text: Column) -> Column:
    """A canonical 32-bit number as text."""
    return text.rlike("^(0|[1-9][0-9]{0,9})$") & (F.try_to_number(text, F.lit("9999999999")) <= 2147483647)


def redact_query(text: Column, limit: int = 200) -> Column:
    return F.substring(c.collapse(text), 1, limit)
