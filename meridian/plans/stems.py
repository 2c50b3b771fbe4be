"""The English stemmer in SQL, one expression a step, for DuckDB to check searches with."""

from __future__ import annotations

from ..functions import stemming as s

_V, _C = f"[{s.VOWELS}]", f"[^{s.VOWELS}]"
_SHORT = f"({_C}{_V}[^{s.VOWELS}wxY]|^{_V}{_C})$"


def _case(pairs: list[tuple[str, str]], other: str = "w") -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs) + f" ELSE {other} END"


def _replace(endings: dict[str, str], region: dict[str, str], also: dict[str, str], default: str) -> str:
    """Of the longest ending that the word has: replaced if it lies in its region and what else holds."""
    cut = lambda e: f"left(w, length(w) - {len(e)})"
    inner = lambda e: _case([(f"length(w) - {len(e)} >= {region.get(e, default)}" + (f" AND {also[e].format(cut(e))}" if e in also else ""), f"{cut(e)} || '{endings[e]}'")])
    return _case([(f"ends_with(w, '{e}')", inner(e)) for e in sorted(endings, key=lambda e: (-len(e), e))])


def stem_ctes(source: str, name: str = "st") -> str:
    """WITH clause items that end in name(word, stem), from the words (column t) of source; words are of a-z and 0-9."""
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    kept = f"w IN ({listed(s.KEPT)})"
    prefix = "|".join(s.LONG_PREFIXES)
    region = lambda w: f"coalesce(nullif(length(regexp_extract({w}, '^.*?{_V}{_C}')), 0), length({w}))"
    ied = "CASE WHEN length(w) > 4 THEN left(w, length(w) - 2) ELSE left(w, length(w) - 1) END"
    step_1a = _case([("ends_with(w, 'sses')", "left(w, length(w) - 2)"), ("regexp_matches(w, 'ie[ds]$')", ied), ("regexp_matches(w, '[us]s$')", "w"), (f"ends_with(w, 's') AND regexp_matches(left(w, length(w) - 2), '{_V}')", "left(w, length(w) - 1)")])
    ending = "regexp_extract(w, '(eedly|eed|edly|ed|ingly|ing)$')"
    short = f"regexp_matches(b, '{_SHORT}') AND length(b) <= r1"
    tidy = _case([("regexp_matches(b, '(at|bl|iz)$')", "b || 'e'"), (short, "b || 'e'"), (f"right(b, 2) IN ({listed(s.DOUBLES)})", "left(b, length(b) - 1)")], "b")
    step_1b = _case([(kept, "w"), ("e LIKE 'eed%'", "CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END"), (f"e <> '' AND regexp_matches(b, '{_V}')", tidy)])
    step_1c = _case([(kept, "w"), (f"regexp_matches(w, '.{_C}[yY]$')", "left(w, length(w) - 1) || 'i'")])
    step_2 = _replace(s.STEP_2, {}, {"ogi": "ends_with({}, 'l')", "li": "regexp_matches({}, '[" + s.BEFORE_LI + "]$')"}, "r1")
    step_3 = _replace(s.STEP_3, {"ative": "r2"}, {}, "r1")
    step_4 = _replace(dict.fromkeys(s.STEP_4, ""), {}, {"ion": "regexp_matches({}, '[st]$')"}, "r2")
    short_before = f"regexp_matches(left(w, length(w) - 1), '{_SHORT}')"
    step_5 = _case([(f"ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {short_before}))", "left(w, length(w) - 1)"), ("ends_with(w, 'll') AND length(w) - 1 >= r2", "left(w, length(w) - 1)")])
    irregular = _case([("length(word) < 3", "word"), *[(f"word = '{w}'", f"'{x}'") for w, x in s.IRREGULAR.items()]], "replace(w, 'Y', 'y')")
    steps = "".join(f",\n{name}{k} AS (SELECT word, CASE WHEN {kept} THEN w ELSE {step} END AS w, r1, r2 FROM {name}{k - 1})" for k, step in ((4, step_2), (5, step_3), (6, step_4), (7, step_5)))
    return f"""{name}a AS (SELECT DISTINCT t AS word FROM {source} WHERE t NOT IN ({listed(sorted(s.STOP))})),
{name}b AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS w FROM {name}a),
{name}c AS (SELECT *, CASE WHEN regexp_matches(w, '^({prefix})') THEN length(regexp_extract(w, '^({prefix})')) ELSE {region("w")} END AS r1 FROM {name}b),
{name}0 AS (SELECT word, w, r1, r1 + {region("substring(w, r1 + 1)")} AS r2 FROM {name}c),
{name}1 AS (SELECT word, {step_1a} AS w, r1, r2 FROM {name}0),
{name}2 AS (SELECT word, {step_1b} AS w, r1, r2 FROM (SELECT *, {ending} AS e, left(w, length(w) - length({ending})) AS b FROM {name}1)),
{name}3 AS (SELECT word, {step_1c} AS w, r1, r2 FROM {name}2){steps},
{name} AS (SELECT word, {irregular} AS stem FROM {name}7)"""
