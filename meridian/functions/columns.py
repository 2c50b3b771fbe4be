"""Column functions: scores, geography, vectors, text and URLs, all of built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain.
PRICE_BANDS = ("budget", "moderate", "upscale", "luxury")
EARTH_M = 6_371_000.0
GEO_SCALE_M = 3000.0
BLEND = {"semantic": 0.35, "covis": 0.15, "freshness": 0.15, "quality": 0.20, "geo": 0.10, "promo": 0.05}
#: Half lives in days by format; null: no decay.
HALF_LIVES = {"news": 21, "event": 14, "offer": None, "review": 540, "listing": 540, "guide": None, "feature": None, "heritage": None, "people": None, "city-guide": None, "opinion": 540}
DEFAULT_HALF_LIFE, FORMAT_TRUST = 365, 0.85
QUALITY_WEIGHTS = {"length": 0.30, "structure": 0.20, "media": 0.20, "yoast": 0.20, "author": 0.10}
STUB_CHARS, STUB_CAP, FULL_CHARS, FULL_MEDIA, FULL_HEADINGS = 500, 0.15, 6000, 4, 3
#: Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
Z_ALPHA, Z_POWER = 1.959964, 0.841621


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geo_proximity(distance_m: Column, scale_m: float = GEO_SCALE_M) -> Column:
    """1 here, less by exp; null where the distance is unknown."""
    return F.exp(-distance_m / scale_m)


def price_rank(band: Column) -> Column:
    """0 for the cheapest band; null for others than the known ones."""
    at = F.array_position(F.array(*map(F.lit, PRICE_BANDS)), band)
    return F.when(at > 0, at - 1)


def price_compat(a: Column, b: Column) -> Column:
    return 1.0 - F.abs(price_rank(a) - price_rank(b)) / (len(PRICE_BANDS) - 1)


def same_area(a: Column, b: Column) -> Column:
    return a == b


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / F.nullif(both, F.lit(0.0)))


def mix(a: Column, b: Column, share: Column | float) -> Column:
    """share of a, the rest of b; where one is null the other."""
    share = share if isinstance(share, Column) else F.lit(share)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: share * x + (1 - share) * y))


def age_days(published_day: Column, as_of_day: Column | int) -> Column:
    return F.greatest((as_of_day if isinstance(as_of_day, Column) else F.lit(as_of_day)) - published_day, F.lit(0)).cast("double")


def half_life(fmt: Column) -> Column:
    """Days of the format's half life, null for formats without decay; the default for unknown formats."""
    out = F.lit(float(DEFAULT_HALF_LIFE))
    for name, days in HALF_LIVES.items():
        out = F.when(fmt == name, F.lit(None if days is None else float(days)).cast("double")).otherwise(out)
    return out


def format_trusted(confidence: Column, source: Column) -> Column:
    return F.coalesce(source == "editor", F.lit(False)) | F.coalesce(confidence >= FORMAT_TRUST, F.lit(False))


def freshness(fmt: Column, age: Column, confidence: Column, source: Column) -> Column:
    """Half-life decay: null without a format; the default curve for one that isn't trusted; 1 where there is no decay."""
    life = F.when(format_trusted(confidence, source), half_life(fmt)).otherwise(float(DEFAULT_HALF_LIFE))
    return F.when(fmt.isNull(), F.lit(None).cast("double")).otherwise(F.when(life.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), age / life)))


def blend(components: dict[str, Column], weights: dict[str, float] = BLEND) -> Column:
    """Weighted mean over the components that aren't null; 0 if all are."""
    parts = [(c, weights[k]) for k, c in components.items()]
    have = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(have > 0, total / F.nullif(have, F.lit(0.0))).otherwise(0.0)


def jaccard(a: Column, b: Column, both_empty: float | None = None) -> Column:
    """Overlap of two arrays as sets. both_empty None: null if either is empty; else that value if both are."""
    share = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    if both_empty is None:
        return F.when((F.size(a) > 0) & (F.size(b) > 0), share)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).otherwise(F.coalesce(share, F.lit(0.0)))


def facet_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """Share of the facets that both know on which they agree; 0 if none is known to both."""
    known = sum((F.when(a.isNotNull() & b.isNotNull(), 1).otherwise(0) for a, b in pairs), F.lit(0))
    equal = sum((F.when(a == b, 1).otherwise(0) for a, b in pairs), F.lit(0))
    return F.when(known > 0, equal / F.nullif(known, F.lit(0))).otherwise(0.0)


def score_length(chars: Column) -> Column:
    low, high = math.log(STUB_CHARS), math.log(FULL_CHARS)
    pos = (F.log(F.greatest(chars, F.lit(1)).cast("double")) - low) / (high - low)
    return F.round(F.when(chars < STUB_CHARS, chars / STUB_CHARS * 0.3).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.3), pos))), 4)


def score_media(count: Column, has_hero: Column) -> Column:
    return F.round(F.least(F.lit(1.0), (count + has_hero.cast("int")) / FULL_MEDIA), 4)


def score_structure(rich_types: Column, headings: Column) -> Column:
    return F.round(0.5 * F.least(F.lit(1.0), rich_types / 3) + 0.5 * F.least(F.lit(1.0), headings / FULL_HEADINGS), 4)


def score_share(flags: list[Column]) -> Column:
    return F.round(sum((f.cast("int") for f in flags), F.lit(0)) / len(flags), 4)


def quality(chars: Column, components: dict[str, Column], weights: dict[str, float] = QUALITY_WEIGHTS) -> Column:
    """Weighted components, capped for stubs, within [0, 1]."""
    raw = F.round(sum((c * weights[k] for k, c in components.items()), F.lit(0.0)), 9)  # so that ties round alike in any order of the sum
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(chars < STUB_CHARS, F.least(raw, F.lit(STUB_CAP))).otherwise(raw))), 4)


def evidence_score(featured: Column, articles: Column, partner: Column, age_years: Column) -> Column:
    """3 for each feature, 1 an article, 2 for a partner, and what is left of five years since the newest."""
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - age_years / 5), F.lit(0.0))
    return 3.0 * featured + articles + 2.0 * partner.cast("int") + recency


def hash_bucket(key: Column, buckets: int) -> Column:
    """Stable bucket by the first 8 hex digits of SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def stable_rank(seed: str, *keys: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]), 256)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def two_proportions(clicks_a: Column, n_a: Column, clicks_b: Column, n_b: Column) -> tuple[Column, Column]:
    """(z, p) of the pooled test; (0, 1) without any variance, null without rows in an arm."""
    a, b = clicks_a / F.nullif(n_a, F.lit(0)), clicks_b / F.nullif(n_b, F.lit(0))
    pooled = (clicks_a + clicks_b) / F.nullif(n_a + n_b, F.lit(0))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(n_a, F.lit(0)) + 1 / F.nullif(n_b, F.lit(0))))
    z = F.when(se == 0, 0.0).otherwise((b - a) / F.nullif(se, F.lit(0.0)))
    return z, F.when(se == 0, 1.0).otherwise(2 * (1 - normal_cdf(F.abs(z))))


def sample_size(rate: Column, effect: float = 0.02) -> Column:
    p1 = F.least(F.greatest(rate, F.lit(0.005)), F.lit(0.5))
    p2 = F.least(p1 + abs(effect), F.lit(0.999))
    return F.ceil((Z_ALPHA + Z_POWER) ** 2 * (p1 * (1 - p1) + p2 * (1 - p2)) / F.pow(p2 - p1, 2))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(point, low, high); null for no trials."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = successes / m
    denom = 1 + z * z / m
    center = (p + z * z / (2 * m)) / denom
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m) / denom
    return p, F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)


# --- text -------------------------------------------------------------------------------------------------

#: Accented Latin letters and what they are without accent.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
STOPWORDS = ("the", "a", "an", "in", "at", "of", "to", "for", "and", "on", "with", "is", "are", "your", "this", "that")


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def normalize_name(text: Column) -> Column:
    """Without accents and apostrophes, small, other signs to spaces, single spaces."""
    plain = F.regexp_replace(F.lower(fold_accents(text)), "[’‘'`]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slugify(text: Column) -> Column:
    return F.regexp_replace(normalize_name(text), " ", "-")


def candidate_key(text: Column) -> Column:
    return F.substring(F.sha1(normalize_name(text)), 1, 16)


def unescape(text: Column) -> Column:
    """The entities that titles and bodies carry."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def normalize_title(title: Column) -> Column:
    """A title without what a yearly refresh changes: years, ordinals, 'updated'."""
    text = F.lower(unescape(title))
    text = F.regexp_replace(text, "(^|[^a-z0-9])updated([^a-z0-9]|$)", "$1 $2")
    text = F.regexp_replace(text, "(^|[^0-9a-z])(19|20)[0-9][0-9]($|[^0-9a-z])", "$1 $3")
    text = F.regexp_replace(text, "(^|[^0-9a-z])[0-9]+(st|nd|rd|th)($|[^0-9a-z])", "$1 $3")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def years(title: Column) -> Column:
    return F.transform(F.regexp_extract_all(title, F.lit("(?<![0-9A-Za-z])((?:19|20)[0-9][0-9])(?![0-9A-Za-z])"), 1), lambda y: y.cast("int"))


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS, longer_than: int = 2) -> Column:
    """Small ASCII words of some length that aren't stop words."""
    found = F.regexp_extract_all(F.lower(fold_accents(text)), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda w: (F.length(w) > longer_than) & ~F.array_contains(F.array(*map(F.lit, stopwords)), w))


def visible_text(html: Column) -> Column:
    """Text of HTML: without scripts, styles, comments and tags, entities decoded, single spaces."""
    html = F.regexp_replace(html, "(?is)<(script|style|svg)[^>]*>.*?</(script|style|svg)>", " ")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    return collapse(unescape(F.regexp_replace(html, "(?s)<[^>]*>", " ")))


#: Fixed values of the domain: elements between whose text a reader sees white space.
RENDERED_APART = (
    "article", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "li", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
)


def rendered_text(html: Column) -> Column:
    """Text of HTML as a reader sees it: words that only inline elements part stay whole, those on two sides of a block, cell or break don't run together."""
    html = F.regexp_replace(html, "(?is)<(script|style|svg)[^>]*>.*?</(script|style|svg)>", " ")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, f"(?is)</?(?:{'|'.join(RENDERED_APART)})(?:[ \t\r\n/][^>]*)?>", " ")
    return collapse(unescape(F.regexp_replace(html, "(?s)<[^>]*>", "")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a[^>]*href="([^"]*)"'), 1)


def sources(html: Column) -> Column:
    """What src and srcset name: image candidates without their sizes."""
    single = F.regexp_extract_all(html, F.lit('(?i)[^a-z]src="([^"]*)"'), 1)
    several = F.flatten(F.transform(F.regexp_extract_all(html, F.lit('(?i)srcset="([^"]*)"'), 1), lambda s: F.split(s, ",")))
    return F.array_distinct(F.concat(single, F.transform(several, lambda s: F.substring_index(F.trim(s), " ", 1))))


def host(url: Column) -> Column:
    """Small host without www. and port; null where the URL has none."""
    found = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(found, "^www\\.", ""), F.lit(""))


#: Suffixes of two labels under which names are registered.
SECOND_LEVEL = ("co.id", "or.id", "go.id", "web.id", "ac.id", "co.uk", "org.uk", "com.au", "com.sg", "co.jp")


def root_domain(netloc: Column) -> Column:
    """The registrable domain of a host."""
    two, three = F.substring_index(netloc, ".", -2), F.substring_index(netloc, ".", -3)
    return F.when(two.isin(*SECOND_LEVEL), three).otherwise(two)


def subdomain(netloc: Column) -> Column:
    root = root_domain(netloc)
    return F.when(netloc != root, F.substring(netloc, F.lit(1), F.length(netloc) - F.length(root) - 1))


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, www., query, fragment or slash at the end."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.concat(host(url), path), "/+$", "")


def minutes_of_day(hhmm: Column) -> Column:
    parts = F.split(hhmm, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def vector_literal(vec: Column) -> Column:
    return F.to_json(vec)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def embedding_text(title: Column, dek: Column, body: Column, limit: int = 1600) -> Column:
    """Non-empty parts with a blank line between; the body up to limit characters."""
    parts = F.array(*[F.nullif(F.trim(p), F.lit("")) for p in (title, dek, F.substring(body, 1, limit))])
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")
