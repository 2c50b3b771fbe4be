"""Itineraries against exhaustive search: windows, caps, budget, partners, interests, optional slots."""

import itertools
import random

import pandas as pd
import pytest

from meridian.operators import itinerary, planning

COLUMNS = ["request_id", "day", "slot", "starts", "required", "place_id", "type", "org_id", "price", "partner", "score", "earliest", "latest", "dwell", "lat", "lng"]
SCHEMA = "request_id long, day int, slot string, starts int, required boolean, place_id long, type string, org_id long, price int, partner boolean, score double, earliest int, latest int, dwell int, lat double, lng double"


def request(rng, rid=1, days=2, names=3, stops=6, spread=0.05):
    rows = []
    places = [(p, rng.choice(["eat", "do", "drink"]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 3, 4]), rng.random() < 0.3, round(rng.random(), 2), rng.choice([30, 60, 90]), -6.2 + rng.random() * spread, 106.8 + rng.random() * spread) for p in range(stops)]
    for d in range(days):
        for k in range(names):
            starts, required = 480 + 150 * k, rng.random() < 0.4
            for p, kind, org, price, partner, score, dwell, lat, lng in places:
                if rng.random() < 0.7:
                    early = starts + rng.choice([0, 0, 45])
                    rows.append((rid, d, f"s{k}", starts, required, p, kind, org, price, partner, score, early, max(early, starts + 170 - dwell), dwell, lat, lng))
    return rows


def exhaustive(rows, asked):
    """The most that a plan can be worth, by trying every choice; None if none will do."""
    slots = {}
    for r in rows:
        slots.setdefault((r[1], r[3], r[2], r[4]), []).append(dict(zip(COLUMNS, r, strict=True)))
    best = None
    for pick in itertools.product(*([*own, *([] if key[3] else [None])] for key, own in sorted(slots.items()))):
        got = [r for r in pick if r]
        worth = sum(int(r["score"] * 1000) + 500 * (r["type"] in asked["interests"]) for r in got)
        if best is not None and worth <= best:
            continue
        count = lambda f: max((sum(1 for r in got if f(r) == v) for v in {f(r) for r in got} if v is not None), default=0)  # noqa: B023, E731
        if count(lambda r: r["place_id"]) > 1 or count(lambda r: r["org_id"]) > asked["max_per_org"] or count(lambda r: (r["day"], r["type"])) > asked["max_per_type"]:
            continue
        if asked["budget"] is not None and sum(r["price"] or 0 for r in got) > asked["budget"] or sum(r["partner"] for r in got) < asked["partners"]:
            continue
        last, ok = None, True
        for r in got:
            at = r["earliest"]
            if last and last[0]["day"] == r["day"]:
                at = max(at, last[1] + planning.minutes(last[0]["lat"], last[0]["lng"], r["lat"], r["lng"]))
            ok &= at <= r["latest"]
            last = (r, at + r["dwell"])
        if ok:
            best = worth
    return best


ASKS = [{}, {"max_per_type": 1}, {"max_per_org": 2, "budget": 7}, {"budget": 3, "partners": 1}, {"partners": 2, "interests": ("do",)}, {"interests": ("eat", "drink"), "budget": 5, "max_per_type": 2}]


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_best_plan_equals_exhaustive_search(spread):
    rng, none = random.Random(5), 0
    for k in range(90):
        rows = request(rng, days=1 + k % 2, names=4 - 2 * (k % 2), spread=spread)
        asked = planning.ASKED | ASKS[k % len(ASKS)]
        want = exhaustive(rows, asked)
        got = planning.best_plan(planning.slots_of(pd.DataFrame(rows, columns=COLUMNS), set(asked["interests"])), asked, 10**6)
        none += want is None
        assert (want is None) == (got is None)
        if got:
            assert got[1] and sum(r["worth"] for _, r, _ in got[0]) == want
            assert all(r["earliest"] <= at <= r["latest"] for _, r, at in got[0])
    assert 0 < none < 70


def test_assignment_and_its_prices():
    rng = random.Random(6)
    for _ in range(200):
        worth = [{u: rng.randrange(1, 50) for u in rng.sample("abcdef", rng.randrange(1, 5))} for _ in range(4)]
        must = [rng.random() < 0.3 for _ in worth]
        sums = [sum(w[u] for w, u in zip(worth, pick, strict=True) if u) for pick in itertools.product(*([*w, *([] if m else [None])] for w, m in zip(worth, must, strict=True))) if len({u for u in pick if u}) == sum(1 for u in pick if u)]
        got = planning.matched(worth, must)
        assert (got is None) == (not sums)
        if got:
            value, of_slot, of_unit, chosen = got
            assert sum(worth[i][u] for i, u in chosen.items()) == value and len(set(chosen.values())) == len(chosen)
            assert value == max(sums) and min(of_unit.values()) >= 0
            assert all(w <= of_slot[i] + of_unit[u] for i, own in enumerate(worth) for u, w in own.items()) and all(of_slot[i] >= 0 for i, m in enumerate(must) if not m)
            assert sum(of_slot) + sum(of_unit.values()) >= value


@pytest.mark.parametrize("days,stops,asked", [(3, 60, {}), (2, 40, {"partners": 1, "max_per_org": 2}), (1, 40, {"budget": 10, "partners": 2, "interests": ("do",)})])
def test_large_requests_are_proven(days, stops, asked):
    for seed in range(2):
        data, full = pd.DataFrame(request(random.Random(seed), days=days, names=6, stops=stops, spread=0.2), columns=COLUMNS), planning.ASKED | asked
        data["org_id"] = data["place_id"] % 23
        plan, proven = planning.best_plan(planning.slots_of(data, set(full["interests"])), full, 20_000)
        assert proven and len({r["place_id"] for _, r, _ in plan}) == len(plan) > 3 * days


def test_hard_requests_get_a_plan():
    """Caps that many slots strain against may leave a plan unproven; it is whole all the same."""
    rows = request(random.Random(1), days=3, names=6, stops=60, spread=0.2)
    full = planning.ASKED | {"budget": 24, "partners": 3, "interests": ("do",)}
    plan, _ = planning.best_plan(planning.slots_of(pd.DataFrame(rows, columns=COLUMNS), {"do"}), full, 500)
    assert sum(r["price"] for _, r, _ in plan) <= 24 and sum(r["partner"] for _, r, _ in plan) >= 3 and len(plan) > 9
    assert {(r[1], r[2]) for r in rows if r[4]} <= {(s.day, s.name) for s, _, _ in plan}


def test_plan_by_request(spark):
    rng = random.Random(8)
    rows = [r for rid in range(6) for r in request(rng, rid, names=2)]
    asks = [(0, 1, None, None, None), (1, None, 7, None, ["eat"]), (2, 2, None, 1, None), (3, None, None, None, []), (4, 1, 0, None, None)]
    requests = spark.createDataFrame(asks, "request_id long, max_per_type int, budget int, partners int, interests array<string>")
    got = planning.plan(spark.createDataFrame(rows, SCHEMA), requests).collect()
    by = {a[0]: {"max_per_type": a[1] or 3, "max_per_org": 1, "budget": a[2], "partners": a[3] or 0, "interests": a[4] or ()} for a in asks} | {5: planning.ASKED}
    for rid in range(6):
        own = [r for r in rows if r[0] == rid]
        want, mine = exhaustive(own, by[rid]), [r for r in got if r.request_id == rid]
        worth = {(r[1], r[2], r[5]): int(r[10] * 1000) + 500 * (r[6] in by[rid]["interests"]) for r in own}
        assert sum(worth[r.day, r.slot, r.place_id] for r in mine) == (want or 0) and all(r.proven for r in mine)
    assert planning.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    few = planning.plan(spark.createDataFrame([r for r in rows if r[0] == 5], SCHEMA), nodes=3).collect()
    assert few and not any(r.proven for r in few)
    assert itinerary.plan is planning.plan


def test_times_of_arrival(spark):
    """Of several hours those that share most with the slot; none known: the slot's; what closes too soon is left out."""
    slots = spark.createDataFrame([(0, 2, "lunch", ["eat"], 720, 840)], "day int, weekday int, slot string, types array<string>, opens int, closes int")
    hours = {1: [(2, 600, 730), (2, 750, 830)], 2: [], 3: None, 4: [(2, 600, 770)], 5: [(1, 0, 1440)], 6: [(2, 700, 1500)]}
    rows = [(p, "eat", 1.0, None, 60, [{"weekday": d, "opens": o, "closes": c} for d, o, c in h] if h is not None else None) for p, h in hours.items()] + [(7, "eat", 1.0, None, 130, None)]
    stops = spark.createDataFrame(rows, "place_id long, type string, score double, price_band string, dwell int, hours array<struct<weekday:int,opens:int,closes:int>>")
    got = {r.place_id: (r.earliest, r.latest) for r in itinerary.eligible(stops, slots).collect()}
    assert got == {1: (750, 770), 2: (720, 780), 3: (720, 780), 6: (720, 780)}


def test_the_query_breaks_no_rule(spark, sf_dir):
    from meridian.plans import measures

    slots = measures._slots(spark).selectExpr("*", "slot = 'lunch' AS required")
    plans = measures.N3_plan(spark, sf_dir).cache()
    assert plans.count() > 16 and plans.filter("NOT proven").count() == 0
    stops = measures._stops(spark, sf_dir).drop("kids", "hours", "price_band", "score")
    assert itinerary.violations(plans, stops, slots, 3).count() == 0
