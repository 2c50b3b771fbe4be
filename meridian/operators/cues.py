"""Cue scores: weighted patterns in title, lead and body decide a type, a format or a price band, or abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the domain.
ZONE_WEIGHTS = {"title": 3.0, "lead": 1.5, "body": 1.0}
CAP_PER_CUE = 3
WITHOUT_TITLE = 2.0
LEAD_TIMES, LEAD_PLUS, BODY_TIMES, BODY_PLUS = 2.0, 1.5, 1.5, 1.5
LEAD_CHARS, BODY_CHARS = 400, 1600
MIN_SCORE, MIN_MARGIN = 2.5, 1.0

Cues = dict[str, list[tuple[str, float]]]


def zone_scores(text: Column, zone: str, cues: Cues) -> dict[str, Column]:
    """Of each label the weighted hits of its patterns in a zone, each counted at most CAP_PER_CUE times."""
    return {k: sum((F.least(F.regexp_count(text, F.lit(p)), F.lit(CAP_PER_CUE)) * w for p, w in pats), F.lit(0.0)) * ZONE_WEIGHTS[zone] for k, pats in cues.items()}


def combined(title: Column, text: Column, cues: Cues) -> dict[str, Column]:
    """Scores by label: lead and body back what the title says, and can't decide without it."""
    t = zone_scores(title, "title", cues)
    lead = zone_scores(F.substring(text, 1, LEAD_CHARS), "lead", cues)
    body = zone_scores(F.substring(text, LEAD_CHARS + 1, BODY_CHARS - LEAD_CHARS), "body", cues)
    out = {}
    for k in cues:
        head = t[k] + F.least(lead[k], LEAD_TIMES * t[k] + LEAD_PLUS)
        out[k] = F.when(t[k] <= 0, F.least(lead[k] + body[k], F.lit(WITHOUT_TITLE))).otherwise(head + F.least(body[k], BODY_TIMES * head + BODY_PLUS))
    return out


def decide(scores: dict[str, Column], min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> Column:
    """struct(value, margin, confident): the best label (of equal ones the first), null where it doesn't lead enough."""
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]))
    top, second = -ranked[0]["s"], -ranked[1]["s"] if len(scores) > 1 else F.lit(0.0)
    ok = (top >= min_score) & (top - second >= min_margin)
    return F.struct(F.when(ok, ranked[0]["k"]).alias("value"), (top - second).alias("margin"), (ok & (top - second >= 2 * min_margin)).alias("confident"))


def score(docs: DataFrame, title: str, text: str, cues: Cues) -> DataFrame:
    """docs with a column cue; scores are made before they are compared, so that each pattern runs once."""
    names = {k: f"__s{i}" for i, k in enumerate(cues)}
    scored = docs.withColumns({names[k]: v for k, v in combined(F.lower(F.col(title)), F.lower(F.col(text)), cues).items()})
    return scored.withColumn("cue", decide({k: F.col(n) for k, n in names.items()})).drop(*names.values())


def first_person_density(text: Column) -> Column:
    """First-person words for each 1000 words."""
    small = F.lower(text)
    words = F.regexp_count(small, F.lit("[a-z]+"))
    return F.when(words > 0, F.regexp_count(small, F.lit("(?:^|[^a-z])(?:i|we|my|our)(?=[^a-z]|$)")) * 1000.0 / F.nullif(words, F.lit(0))).otherwise(0.0)


def period_stamp(title: Column) -> Column:
    """The month or year that a title is stamped with."""
    return F.nullif(F.regexp_extract(F.lower(title), "((?:january|february|march|april|may|june|july|august|september|october|november|december) (?:19|20)[0-9]{2}|(?:19|20)[0-9]{2})", 1), F.lit(""))


def is_roundup(title: Column) -> Column:
    return F.lower(title).rlike("^(top |best |[0-9]+ )|(roundup|round-up|guide to)")


def language_shares(text: Column, markers: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Share of a text's words that are markers of each language."""
    words = F.filter(F.split(F.lower(text), "[^a-zà-ÿ]+"), lambda w: w != "")
    share = lambda m: F.size(F.filter(words, lambda w: F.array_contains(F.array(*map(F.lit, m)), w))) / F.nullif(F.size(words), F.lit(0))
    return {k: share(m) for k, m in markers.items()}
