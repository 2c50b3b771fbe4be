"""Stems, the query language, and searches against brute force; the stemmer against its SQL."""

import random
import re

import duckdb
import pytest

from meridian.functions import stemming
from meridian.operators import retrieval
from meridian.plans.stems import stem_ctes

#: Fixed values of the language: published words and their stems.
PUBLISHED = """consigned consign, consistency consist, consistently consist, consolatory consolatori, consolidating consolid, consolingly consol, conspicuously conspicu, conspiracy conspiraci, constables constabl,
constancy constanc, knackeries knackeri, knavish knavish, kneaded knead, knightly knight, knitted knit, knives knive, knocker knocker, generously generous, generate generat, communication communic, relational relat,
conditional condit, hopping hop, hoping hope, filing file, falling fall, happy happi, cry cri, by by, say say, ties tie, cries cri, gas gas, this this, gaps gap, kiwis kiwi, luxuriated luxuri, bed bed, bead bead,
embed emb, shed shed, agreed agre, feed feed, restaurants restaur, beaches beach, dining dine, enjoy enjoy, national nation, rational ration, operator oper, decisiveness decis, hopefulness hope, callousness callous,
formality formal, sensitivity sensit, sensibility sensibl, triplicate triplic, formative format, electrical electr, goodness good, revival reviv, allowance allow, airliner airlin, gyroscopic gyroscop,
adjustable adjust, replacement replac, dependent depend, adoption adopt, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, skies sky,
dying die, news news, inning inning, proceed proceed, yummy yummi, youth youth, boyish boyish, gently gentl, yes yes, eyes eye"""


def test_published_stems():
    pairs = dict(p.split() for p in PUBLISHED.replace("\n", " ").split(", "))
    assert {w: stemming.stem(w) for w in pairs} == pairs
    assert stemming.stem("o'clock") == "o'clock" and stemming.stem("diner's") == "diner" and stemming.stem("is") == "is"


def test_stems_equal_their_sql():
    rng = random.Random(1)
    ends = [*stemming.STEP_2, *stemming.STEP_3, *stemming.STEP_4, "ed", "edly", "ing", "ingly", "eed", "s", "sses", "ies", "ied", "y", "e", "ll", "li"]
    words = {"".join(rng.choice("aeiouybcdlnrstz") for _ in range(rng.randrange(1, 6))) + rng.choice(ends) * rng.randrange(2) + rng.choice(ends) for _ in range(6000)}
    words |= {*stemming.IRREGULAR, *stemming.KEPT, *(k + "ly" for k in stemming.KEPT), "generation", "arsenal", "commune", "2", "4th", "a1"}
    for w in words:
        assert len(stemming.stem(w)) == 1 or stemming.stem(w)[:2] == w[:2] or w in stemming.IRREGULAR
    some = sorted(words)
    only = frozenset(stemming.stem(w) for w in some[::7])
    assert stemming.lexemes(some, 3, only) == [x for x in stemming.lexemes(some, 3) if x[0] in only]
    con = duckdb.connect()
    con.execute("CREATE TABLE words(t VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?)", [(w,) for w in sorted(words)])
    got = dict(con.execute(f"WITH {stem_ctes('words')} SELECT word, stem FROM st").fetchall())
    assert got == {w: stemming.stem(w) for w in words if w not in stemming.STOP}


def test_queries_are_parsed():
    p = lambda q: [(alt, atom, neg, term, off) for alt, atom, neg, term, off, _ in stemming.parse(q)]
    assert p('Best "dining in town" -cheap') == [(0, 0, False, "best", 0), (0, 1, False, "dine", 0), (0, 1, False, "town", 2), (0, 2, True, "cheap", 0)]
    assert p("tea OR coffees or the") == [(0, 0, False, "tea", 0), (1, 1, False, "coffe", 0)]
    assert p('e-mail -"bad words" bars bar') == [(0, 0, False, "e", 0), (0, 0, False, "mail", 1), (0, 1, True, "bad", 0), (0, 1, True, "word", 1), (0, 2, False, "bar", 0)]
    assert p("the of") == p("") == p("-only") == p('"" -') == []


def brute(docs, query, weights=(1.0, 0.2)):
    """Scores by document: all stretches tried for each alternative."""
    out = {}
    rows = stemming.parse(query)
    for i, *texts in docs:
        at, words = {}, 0
        for text, weight in zip(texts, weights, strict=True):
            for w in re.findall("[a-z0-9]+", (text or "").lower()):
                words += 1
                if w not in stemming.STOP:
                    at[words] = (stemming.stem(w), weight)
        for alt in sorted({r[0] for r in rows}):
            atoms = {}
            for a, atom, neg, term, off, _ in rows:
                if a == alt:
                    atoms.setdefault((atom, neg), []).append((term, off))
            hits, ruled_out = [], False  # (position, slot, weight)
            for (atom, neg), parts in atoms.items():
                for start in at:
                    if all(at.get(start + off, ("", 0))[0] == term for term, off in parts):
                        ruled_out |= neg
                        hits += [] if neg else [(start + off, (atom, off), at[start + off][1]) for _, off in parts]
            slots = {(atom, off) for (atom, neg), parts in atoms.items() if not neg for _, off in parts}
            spans = [(x, y) for x in at for y in at if x <= y and slots <= {s for pos, s, _ in hits if x <= pos <= y}]
            for x, y in spans:
                if ruled_out or any((u, v) != (x, y) and x <= u and v <= y for u, v in spans):
                    continue
                own = [w for pos, _, w in hits if x <= pos <= y]
                out[i] = out.get(i, 0) + len(own) / sum(1 / w for w in own) / (1 + max(0, y - x - (len(own) - 1)))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_search_equals_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(retrieval, "ASKED", 0)
    rng = random.Random(7)
    words = ["dining", "dined", "the", "in", "towns", "town", "hotels", "Hotel,", "running", "runs", "spa", "Spâ", "national"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4))), " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(60)] + [(97, None, None), (98, "", "dine"), (99, "run hotel", None)]
    asked = ["dine", "hotels running", '"dining in town"', '"town town" hotel', "spa -run", 'spa or "hotel run" or nation -"spa spa"', "the", "", '"spa hotels" spa']
    df = spark.createDataFrame(docs, "id long, title string, body string")
    got = retrieval.websearch(df, {"A": "title", "C": "body"}, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), 100).collect()
    plain = [(i, (t or "").replace("â", "a"), (b or "").replace("â", "a")) for i, t, b in docs]
    want = {(q, i): x for q, text in enumerate(asked) for i, x in brute(plain, text).items()}
    assert {(r.query_id, r.id): r.score for r in got} == pytest.approx(want, abs=2e-6) and {q for q, _ in want} == {0, 1, 2, 3, 4, 5, 8}
    for q in range(len(asked)):
        mine = [(-r.score, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == sorted(mine)
    some = retrieval.websearch(df, {"A": "title", "C": "body"}, spark.createDataFrame([(0, "dine")], "query_id long, query string"), 5, candidates=df.filter("id % 2 = 0").select("id"))
    assert {r.id % 2 for r in some.collect()} == {0} and some.count() == 5
