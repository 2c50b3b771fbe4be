"""Names that are no place: ordered rules over a name and its words, as one conditional expression.

A name is taken as it is written, for some rules look at capitals, quotes and
signs; its words are its parts at spaces, small, without signs at their ends.
The first rule that holds gives the verdict: junk where it is sure, suspect where
real places look like that too. What the rules know of the domain are word lists,
which are arguments; the defaults are short.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest name in words, and from where on it is doubtful.
LONGEST, LONG = 14, 7


@dataclass(frozen=True)
class Words:
    """What the rules know of a domain."""

    venues: tuple[str, ...] = ("hotel", "resort", "restaurant", "cafe", "bar", "spa", "club", "lounge", "museum", "gallery", "temple", "park", "market", "mall", "beach", "villa", "school", "theatre")
    kinds: tuple[str, ...] = ("luxury", "local", "rooftop", "seafood", "thai", "italian", "coffee", "tea", "wine", "night", "day", "water", "kids", "indoor", "outdoor", "main", "public", "private")
    glue: tuple[str, ...] = ("the", "a", "and", "&", "of")
    tails: tuple[str, ...] = ("villas", "suites", "residences", "grill", "terrace", "dining", "friends", "sons", "co", "company", "brasserie", "yoga")
    rooms: tuple[str, ...] = ("suite", "suites", "room", "rooms", "bedroom", "bedrooms", "villa", "villas")
    room_words: tuple[str, ...] = ("the", "deluxe", "superior", "junior", "royal", "family", "ocean", "garden", "pool", "view", "king", "queen", "twin", "one", "two", "private", "honeymoon", "executive", "premier")
    events: tuple[str, ...] = ("festival", "celebration", "brunch", "party", "workshop", "promotion", "package", "exhibition", "concert", "edition", "anniversary", "countdown", "weekend", "buffet", "takeover", "pop-up")
    gatherings: tuple[str, ...] = ("competition", "championship", "tournament", "contest", "conference", "summit", "auction", "bazaar", "fundraiser", "screening")
    event_places: tuple[str, ...] = ("park", "walk", "city", "hall", "centre", "center", "plaza", "club", "inn", "house")
    held_at: tuple[str, ...] = ("dinner", "lunch", "class", "tasting", "cooking", "session", "evening", "ceremony", "chef", "breakfast", "treatment")
    leads: tuple[str, ...] = ("discover", "enjoy", "join", "visit", "book", "celebrate", "introducing", "designed", "located", "best", "top", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    lead_exceptions: tuple[str, ...] = ("best western", "top of the")
    openers: tuple[str, ...] = ("as", "to", "if", "so", "or", "but", "on", "this", "that", "these", "those", "some", "every", "how", "why", "what", "when", "where", "who", "there", "here")
    jobs: tuple[str, ...] = ("manager", "director", "chef", "founder", "owner", "sommelier", "bartender", "curator")
    last: tuple[str, ...] = ("getaway", "journey", "interior", "facade", "menu", "offer", "deal", "ritual", "facilities", "services", "programme", "activities", "classes", "community")
    concepts: tuple[str, ...] = ("secrets", "stories", "history", "taste", "flavours", "evolution", "masters")
    superlatives: tuple[str, ...] = ("leading", "best", "finest", "first", "largest", "newest", "only", "favourite", "top", "most", "latest", "premier")
    cut_off: tuple[str, ...] = ("restaurant", "kitchen", "gallery", "resort", "lounge", "bakery", "bistro", "market", "garden", "boutique", "residence", "brasserie", "coffee")
    short: tuple[str, ...] = ("bar", "spa", "pub", "inn", "zoo", "gym", "art", "bay", "sea", "sky", "sun", "one", "two", "co", "la", "le", "de")
    brands: tuple[str, ...] = ()
    areas: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    brand_pairs: tuple[tuple[str, str], ...] = field(default=())


_MONTH = "(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(tember)?|oct(ober)?|nov(ember)?|dec(ember)?)"


def _any(words: tuple[str, ...]) -> str:
    return "(" + "|".join(w.replace(".", "\\.").replace("+", "\\+") for w in words) + ")" if words else "(?!)"


def _in(word: Column, words: tuple[str, ...]) -> Column:
    return word.isin(*words) if words else F.lit(False)


def tokens(name: Column) -> Column:
    """(raw, word) of the parts of a name: as written, and small without signs at the ends; parts of signs only are left out."""
    parts = F.transform(F.split(F.trim(name), "\\s+"), lambda t: F.struct(t.alias("raw"), F.lower(F.regexp_replace(t, '^[.,;:!?()"“”]+|[.,;:!?()"“”]+$', "")).alias("word")))
    return F.filter(parts, lambda t: t["word"] != "")


def _all(words: Column, known: tuple[str, ...]) -> Column:
    return F.forall(words, lambda w: _in(w, known))


def _has(words: Column, known: tuple[str, ...]) -> Column:
    return F.exists(words, lambda w: _in(w, known))


def _splits(ts: Column) -> Column:
    """(left, right, first, sign) of a name's parts around each and or &: words before, words up to the next one, the right side as written, whether the sign."""
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.size(ts), F.lit(2))), lambda i: (i <= F.size(ts)) & F.get(ts, i - 1)["word"].isin("and", "&"))
    words = lambda x: F.transform(x, lambda t: t["word"])

    def around(i: Column) -> Column:
        rest = F.slice(ts, i + 1, F.greatest(F.size(ts) - i, F.lit(0)))
        stop = F.array_position(F.transform(rest, lambda t: t["word"].isin("and", "&")), True)
        right = F.when(stop > 0, F.slice(rest, 1, F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(rest)
        return F.struct(words(F.slice(ts, 1, i - 1)).alias("left"), words(right).alias("right"), F.array_join(F.transform(right, lambda t: t["raw"]), " ").alias("written"), (F.get(ts, i - 1)["word"] == "&").alias("sign"))

    return F.filter(F.transform(places, around), lambda s: (F.size(s["left"]) > 0) & (F.size(s["right"]) > 0))


def rules(name: Column, known: Words | None = None) -> list[tuple[str, Column, bool]]:
    """(reason, whether it holds, whether sure) of every rule, in order."""
    k = known or Words()
    raw = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "\\s+", " "))
    small = F.lower(raw)
    ts = tokens(raw)
    ws = F.transform(ts, lambda t: t["word"])
    n = F.size(ws)
    at = lambda i: F.coalesce(F.get(ws, F.lit(i) if isinstance(i, int) else i), F.lit(""))
    last, before_last = at(n - 1), at(n - 2)
    generic = k.venues + k.kinds
    compound = generic + k.tails
    follows = f"(?!\\W+{_any(k.event_places)}\\b)"
    event = lambda ws_: small.rlike(f"\\b{_any(ws_)}(s|es)?\\b{follows}")
    has_at = F.contains(F.concat(F.lit(" "), small, F.lit(" ")), F.lit(" at "))
    owner = F.filter(F.split(F.lower(F.split(raw, "[’'`]s\\b")[0]), " "), lambda w: (w != "") & (w != "the"))
    splits = _splits(ts)
    first_right = lambda s: F.get(s["right"], 0)
    brands = F.filter(F.array(*[F.when(small.rlike(f"(?<![a-z]){b}(?![a-z])"), F.lit(b)) for b in k.brands]), lambda b: b.isNotNull()) if k.brands else F.array().cast("array<string>")
    paired = F.lit(False)
    for a, b in k.brand_pairs:
        paired = paired | (F.size(F.array_except(brands, F.array(F.lit(a), F.lit(b)))) == 0)
    heads = F.filter(ws, lambda w: _in(w, k.venues))
    outlets = F.filter(F.transform(ws, lambda w, i: F.when(_in(w, k.venues), i)), lambda i: i.isNotNull())
    between = F.slice(ws, F.coalesce(F.array_min(outlets), F.lit(0)) + 2, F.greatest(F.coalesce(F.array_max(outlets) - F.array_min(outlets), F.lit(0)) - 1, F.lit(0)))
    second_venue = lambda s: _has(s["left"], k.venues) & ~_in(first_right(s), compound) & ~_all(s["right"], compound + k.glue) & (_has(s["right"], k.venues) | (~s["sign"] & s["written"].rlike("(^|\\s)[A-Z0-9]")))
    return [
        ("empty", n == 0, True),
        ("url", raw.rlike("^[a-z0-9]+(-[a-z0-9]+){2,}$") | small.rlike("https?://|www\\.|\\.(com|co\\.id|id|net|org)\\b|@"), True),
        ("area", _in(small, k.areas), True),
        ("run_on", n > LONGEST, True),
        ("possessive", raw.rlike("[’'`](s)?\\s*$") | small.rlike(f"[’'`]s\\s+{_any(k.superlatives)}\\b") | small.rlike("[’'`]s\\b.*[’'`]s\\b") | (raw.rlike("[’'`]s\\b") & ((F.size(owner) >= 2) | _has(owner, generic))), True),
        ("phrase", _in(small, k.phrases), True),
        ("lead", _in(at(0), k.leads) & ~small.rlike(f"^{_any(k.lead_exceptions)}"), True),
        ("new_kind", (at(0) == "new") & _in(at(1), generic), True),
        ("the_best", (at(0) == "the") & at(1).isin("best", "new", "top") & ~small.rlike(f"^{_any(k.lead_exceptions)}"), True),
        ("job", small.rlike(f"\\b{_any(k.jobs)} (of|at)\\b|^(executive |head |sous |pastry )*chef\\b|^(the )?(general|bar|hotel|sales|restaurant|spa) {_any(k.jobs)}\\b"), True),
        ("address", small.rlike("\\b(jalan|jl|jln|street no)\\b|\\b(no|lot|rd|road|st|street|blok|kav)\\.?$"), True),
        ("award", small.rlike("\\b(runner.?up|awards?|of the year|top\\s*\\d+|winners?|\\d+(st|nd|rd|th))\\b"), True),
        ("year", small.rlike("^(20\\d\\d\\s+\\S+\\s+\\S+|(18|19|20)\\d\\d\\s+(at|by|and)\\b)|\\b20[0-3]\\d\\b"), True),
        ("event", event(k.events), True),
        ("weekday", small.rlike("\\b(mon|tues|wednes|thurs|fri|satur|sun)day\\b.*\\b(market|session|night)s?\\b"), True),
        ("gathering", event(k.gatherings), True),
        ("day", (last == "day") & (n > 1) & ~before_last.isin("all", "every", "the"), True),
        ("offer", small.rlike("\\b(idr|rp|usd|sgd)\\s*[\\d.,]+|\\$\\s*\\d|\\b(one|two|three|four|five|\\d+)[- ](day|night|hour)s?\\b(?!-)"), True),
        ("time", small.rlike("\\b\\d{1,2}([.:]\\d\\d)?\\s*(am|pm)\\b"), True),
        ("level", small.rlike("\\b(level|lantai|lt\\.?|floor)\\s*\\d+\\s*$|\\bground floor\\b"), True),
        ("month_at", has_at & small.rlike(f"\\b{_MONTH}\\b.*\\bat\\b"), True),
        ("held_at", has_at & small.rlike(_any(k.held_at)), True),
        ("room", small.rlike("\\bsuite\\b.*\\bfor\\s*\\d+$") | last.isin("floor", "floors") | (_in(last, k.rooms) & (n <= 5) & _all(ws, k.rooms + k.room_words)) | ((last == "suite") & (F.size(F.filter(ws, lambda w: w != "the")) <= 2)) | (at(0).isin("one-bedroom", "two-bedroom", "deluxe", "honeymoon") & _has(ws, k.rooms)), True),
        ("caption", _in(last, k.last), True),
        ("concept", small.rlike("\\bof\\b") & _has(F.slice(ws, 1, 2), k.concepts), True),
        ("two_brands", (F.size(brands) >= 2) & ~paired, True),
        ("same_noun", F.size(heads) != F.size(F.array_distinct(heads)), True),
        ("and_at", F.contains(small, F.lit(" and at ")) | (small.rlike("\\band\\b.*\\bat\\b") & ~small.startswith("the ") & ~_has(F.transform(tokens(F.split(small, " at ")[0]), lambda t: t["word"]), k.venues)), True),
        ("cut_after_and", F.exists(splits, lambda s: (F.size(s["right"]) == 1) & (F.length(first_right(s)) <= 3) & ~_in(first_right(s), k.short)), True),
        ("two_venues", F.exists(splits, lambda s: ((first_right(s) == "the") & (F.size(s["right"]) >= 2)) | second_venue(s)), True),
        ("cut_off", (F.length(last) >= 3) & ~_in(last, k.short + generic) & F.exists(F.array(*map(F.lit, k.cut_off)), lambda s: s.startswith(last) & (s != last)), True),
        ("generic", (F.size(F.filter(ws, lambda w: ~_in(w, k.glue))) > 0) & _all(F.filter(ws, lambda w: ~_in(w, k.glue)), generic), True),
        ("opener", _in(at(0), k.openers), False),
        ("joined", F.exists(splits, lambda s: ~_in(first_right(s), compound)), False),
        ("at", has_at, False),
        ("of", F.contains(small, F.lit(" of ")), False),
        ("number", raw.rlike("\\d"), False),
        ("two_outlets", (F.size(F.array_distinct(heads)) >= 2) & (F.size(F.filter(between, lambda w: ~_in(w, generic + k.glue) & (w != "by"))) >= 2), False),
        ("long", n > LONG, False),
    ]


def reason(name: Column, known: Words | None = None) -> Column:
    """The first rule that holds, null if none does. A null name is empty."""
    return F.coalesce(*[F.when(hit, F.lit(why)) for why, hit, _ in rules(name, known)])


def grade(why: Column) -> Column:
    """junk, suspect or ok from a reason."""
    doubtful = [x for x, _, sure in rules(F.lit("")) if not sure]
    return F.when(why.isNull(), "ok").when(why.isin(*doubtful), "suspect").otherwise("junk")


def verdict(name: Column, known: Words | None = None) -> tuple[Column, Column]:
    """(verdict, reason): junk, suspect or ok by the first rule that holds. A null name is empty."""
    why = reason(name, known)
    return grade(why), why


def verdict_counts(places: DataFrame, known: Words | None = None, key: str = "id") -> DataFrame:
    """(verdict, reason, n, first) of places (key, name), first being the least key: each distinct name is judged once, and names are dealt out for that to every core, since few bytes of them are much work (and not to more tasks, since the rules take seconds to load in each)."""
    tasks = places.sparkSession.sparkContext.defaultParallelism
    names = places.groupBy("name").agg(F.count("*").alias("n"), F.min(key).alias("first")).repartition(tasks, "name")
    found = names.groupBy(reason(F.col("name"), known).alias("reason")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return found.select(grade(F.col("reason")).alias("verdict"), "reason", "n", "first")
