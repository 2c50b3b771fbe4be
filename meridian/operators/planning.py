"""The best itinerary of each request: labels are set slot by slot, the most promising first, until one is complete."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the domain: minutes by distance, worth of a score of one and of a type that the party likes.
SPEED_KMH, LEAST_MINUTES, EARTH_KM = 18.0, 5, 6371.0
SCORE_SCALE, INTEREST = 1000, 500

#: How often the prices of broken rules are gone over.
ROUNDS = 3

#: What a request may ask for, with what holds where it doesn't: most stops of an organisation in the trip, of a type
#: in a day, price bands in all, partners at least, types that are liked.
ASKED = {"max_per_org": 1, "max_per_type": 3, "budget": None, "partners": 0, "interests": ()}


def minutes(lat1: float, lng1: float, lat2: float, lng2: float) -> int:
    x, y = math.radians(lat2 - lat1) / 2, math.radians(lng2 - lng1) / 2
    h = math.sin(x) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(y) ** 2
    return max(LEAST_MINUTES, round(2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h))) / SPEED_KMH * 60))


@dataclass(frozen=True)
class Slot:
    day: int
    name: str
    required: bool
    stops: tuple[dict, ...]  # place_id, type, org_id, price, partner, worth, earliest, latest, dwell, lat, lng


def slots_of(rows: pd.DataFrame, interests: set[str]) -> list[Slot]:
    """The slots of a trip in order, their stops by worth."""
    found: dict[tuple, list[dict]] = defaultdict(list)
    for r in rows.to_dict("records"):
        r["org_id"] = None if pd.isna(r["org_id"]) else r["org_id"]
        r["price"] = 0 if pd.isna(r["price"]) else int(r["price"])
        r["worth"] = int(r["score"] * SCORE_SCALE) + (INTEREST if r["type"] in interests else 0)
        found[r["day"], r["starts"], r["slot"], bool(r["required"])].append(r)
    return [Slot(day, name, required, tuple(sorted(own, key=lambda r: (-r["worth"], r["place_id"])))) for (day, _, name, required), own in sorted(found.items())]


def matched(worth: list[dict], must: list[bool]) -> tuple[int, list[int], dict, dict] | None:
    """(value, price by slot, price by unit, unit by slot): the best assignment of units to slots, each once, and its dual prices; None if a required slot goes empty.

    worth[i] has a slot's units and what they are worth there. Prices cover
    every pair: worth <= price of the slot + price of the unit. Successive
    shortest paths, a slot at a time; an optional slot has an empty unit of its own.
    """
    floor = -(10**9)
    names = sorted({u for w in worth for u in w}, key=str)
    number = {u: k for k, u in enumerate(names)}
    arcs = [{**{number[u]: x for u, x in w.items()}, len(names) + i: floor if m else 0} for i, (w, m) in enumerate(zip(worth, must, strict=True))]
    of_slot, price, holds, at = [0] * len(arcs), [0] * (len(names) + len(arcs)), {}, {}
    for start, own in enumerate(arcs):
        of_slot[start] = max(w - price[u] for u, w in own.items())
        slack, via, done, slot, reached = {}, {}, {}, start, 0
        touched = {start: 0}  # slots in the tree and the distance at which they came in
        while True:
            for u, w in arcs[slot].items():
                d = reached + of_slot[slot] + price[u] - w
                if u not in done and d < slack.get(u, 1 << 60):
                    slack[u], via[u] = d, slot
            reached, _, unit = min((d, u in holds, u) for u, d in slack.items())
            done[unit] = slack.pop(unit)
            if unit not in holds:
                break
            slot = holds[unit]
            touched[slot] = reached
        for s, d in touched.items():
            of_slot[s] -= reached - d
        for u, d in done.items():
            price[u] += reached - d
        while True:  # along the path each slot takes the unit that led on
            slot = via[unit]
            before = at.get(slot)
            holds[unit], at[slot] = slot, unit
            if slot == start:
                break
            unit = before
    of_unit = {u: price[k] for u, k in number.items()}
    value = sum(arcs[i][at[i]] for i in range(len(arcs)))
    return (value, of_slot, of_unit, {i: names[u] for i, u in at.items() if u < len(names)}) if value > floor // 2 else None


def best_plan(slots: list[Slot], asked: dict, nodes: int) -> tuple[list[tuple[Slot, dict, int]], bool] | None:
    """(the (slot, stop, arrival) of the best plan, whether it is proven); None if there can't be one, or none was found in `nodes` labels.

    The bound on what a plan can be worth is that of the assignment of stops (or of
    organisations, where they may appear once) to slots, with the rules that it
    breaks (budget, partners, caps) in the objective at a price. By its dual prices every choice has a cost, what
    it takes off the bound, so the first complete label in order of cost is best.
    A label (slots done, place, when free, what was used) is dropped when another one
    with the same choices left is no dearer, no later, and has spent no more.
    """
    budget, partners = asked["budget"], asked["partners"]
    unit = lambda r: ("org", r["org_id"]) if asked["max_per_org"] == 1 and r["org_id"] is not None else ("place", r["place_id"])

    def counted(slot: Slot, r: dict) -> list[tuple[tuple, int]]:
        """The rules that a stop in a slot counts for, and how much."""
        return [(("budget",), r["price"]), (("partners",), -bool(r["partner"])), (("type", slot.day, r["type"]), 1), (("org", r["org_id"]), 1)]

    def limit(rule: tuple) -> int | None:
        return {"budget": budget, "partners": -partners, "type": asked["max_per_type"], "org": None if rule[-1] is None else asked["max_per_org"]}[rule[0]]

    def priced(slot: Slot, r: dict, prices: dict) -> int:
        return r["worth"] - sum(prices[rule] * n for rule, n in counted(slot, r) if rule in prices)

    def bound(prices: dict) -> tuple | None:
        """(bound, prices of slots and units, how much of each rule the assignment uses) with broken rules at a price."""
        best: list[dict] = [{} for _ in slots]
        for own, slot in zip(best, slots, strict=True):
            for r in slot.stops:
                worth = priced(slot, r, prices)
                if worth > own.get(unit(r), (-(1 << 40), None))[0]:
                    own[unit(r)] = (worth, r)
        got = matched([{u: w for u, (w, _) in own.items()} for own in best], [s.required for s in slots])
        if got is None:
            return None
        used: dict[tuple, int] = defaultdict(int)
        for i, u in got[3].items():
            for rule, n in counted(slots[i], best[i][u][1]):
                used[rule] += n
        return got[0] + sum(p * limit(rule) for rule, p in prices.items()), got[1], got[2], used, prices

    top = bound({})
    for _ in range(ROUNDS):
        broken = [] if top is None else sorted((r for r in {("partners",), *top[3]} if limit(r) is not None and top[3].get(r, 0) > limit(r)), key=str)
        was = top
        for rule in broken:
            step = 512
            while step:  # the bound is convex in each price
                for sign in (1, -1):
                    price = top[4].get(rule, 0) + sign * step
                    new = bound(top[4] | {rule: price}) if price >= 0 else None
                    if new and new[0] < 0:  # no plan is worth less than nothing
                        return None
                    if new and new[0] < top[0]:
                        top = new
                        break
                else:
                    step //= 4
        if was is top:
            break
    if top is None:
        return None
    _, of_slot, of_unit, _, prices = top
    cost = lambda i, r: of_slot[i] + of_unit[unit(r)] - priced(slots[i], r, prices) if r else of_slot[i]
    # What a label has used counts only as far as later slots have it.
    places: list[set] = [set() for _ in range(len(slots) + 1)]
    owners, cheapest, friends_left = [set(x) for x in places], [0] * (len(slots) + 1), [0] * (len(slots) + 1)
    for i in reversed(range(len(slots))):
        own = slots[i].stops
        places[i], owners[i] = places[i + 1] | {r["place_id"] for r in own}, owners[i + 1] | {r["org_id"] for r in own}
        cheapest[i] = cheapest[i + 1] + (min((r["price"] for r in own), default=0) if slots[i].required else 0)
        friends_left[i] = friends_left[i + 1] + any(r["partner"] for r in own)
    dearest, dying = [0] * (len(slots) + 1), [[] for _ in slots]  # what may still be spent; units that no later slot has, whose price goes unused from there on
    for i in reversed(range(len(slots))):
        dearest[i] = dearest[i + 1] + max((r["price"] for r in slots[i].stops), default=0)
    for u, v in of_unit.items():
        if v:
            dying[max(i for i, slot in enumerate(slots) if any(unit(r) == u for r in slot.stops))].append((u, v))
    lam = prices.get(("budget",), 0)

    def unspent(i: int, spent: int) -> int:
        """The price of what is sure to be left of the budget."""
        return lam * max(0, budget - spent - dearest[i]) if lam else 0

    def unused(i: int, label: Label) -> int:
        return sum(v for (kind, name), v in dying[i] if name not in (label.used if kind == "org" else label.places))

    heap, order, seen, popped = [(0, 0, 0, Label())], 0, defaultdict(list), 0
    while heap:
        popped += 1
        if popped > nodes:
            return _dive([x[-1] for x in heap], slots, asked, lam), False
        cost_, _, _, label = heapq.heappop(heap)
        if label.slots == len(slots):
            return _way(label.way), True
        i = label.slots
        for r in _choices(slots[i]):
            new = _step(label, slots, r, asked)
            if new is None or (budget is not None and new.spent + cheapest[i + 1] > budget) or new.friends + friends_left[i + 1] < partners:
                continue
            new_cost = cost_ + cost(i, r) + unused(i, new) + unspent(i + 1, new.spent) - unspent(i, label.spent)
            new.places, new.used = new.places & places[i + 1], tuple(o for o in new.used if o in owners[i + 1])
            key = (i + 1, new.last and new.last["place_id"], new.places, new.types, new.used)
            have = (-new.value, new.free, new.spent, -min(new.friends, partners))
            if any(all(x <= y for x, y in zip(old, have, strict=True)) for old in seen[key]):
                continue
            seen[key].append(have)
            order += 1
            # A complete label costs exactly what it is short of the bound.
            heapq.heappush(heap, (top[0] - new.value if i + 1 == len(slots) else new_cost, -i, order, new))
    return None


@dataclass
class Label:
    """The slots so far: the last stop of the day and when it is left, what was used and spent, what it is worth, and the way here."""

    slots: int = 0
    last: dict | None = None
    free: int = 0
    places: frozenset = frozenset()
    types: tuple = ()
    used: tuple = ()
    spent: int = 0
    friends: int = 0
    value: int = 0
    way: tuple | None = None


def _choices(slot: Slot) -> tuple:
    return slot.stops if slot.required else (*slot.stops, None)


def _step(label: Label, slots: list[Slot], r: dict | None, asked: dict) -> Label | None:
    """What a label becomes when its next slot holds r (None: stays empty); None if that breaks a rule. A day's end forgets the way and the types."""
    i = label.slots
    over = i + 1 == len(slots) or slots[i + 1].day != slots[i].day
    if r is None:
        return replace(label, slots=i + 1, **({"last": None, "free": 0, "types": ()} if over else {}))
    if r["place_id"] in label.places or label.types.count(r["type"]) >= asked["max_per_type"] or (r["org_id"] is not None and label.used.count(r["org_id"]) >= asked["max_per_org"]):
        return None
    last = label.last
    arrive = max(r["earliest"], label.free + minutes(last["lat"], last["lng"], r["lat"], r["lng"]) if last else 0)
    if arrive > r["latest"] or (asked["budget"] is not None and label.spent + r["price"] > asked["budget"]):
        return None
    return Label(
        slots=i + 1,
        last=None if over else r,
        free=0 if over else arrive + r["dwell"],
        places=label.places | {r["place_id"]},
        types=() if over else tuple(sorted((*label.types, r["type"]))),
        used=label.used if r["org_id"] is None else tuple(sorted((*label.used, r["org_id"]))),
        spent=label.spent + r["price"],
        friends=label.friends + bool(r["partner"]),
        value=label.value + r["worth"],
        way=(slots[i], r, arrive, label.way),
    )


def _way(way: tuple | None) -> list[tuple[Slot, dict, int]]:
    out = []
    while way:
        slot, stop, arrive, way = way
        out.append((slot, stop, arrive))
    return out[::-1]


def _dive(labels: list[Label], slots: list[Slot], asked: dict, lam: int, width: int = 400) -> list[tuple[Slot, dict, int]]:
    """A plan from open labels, by keeping the few of each slot that are worth most less the price of what they have spent; empty if none comes through."""
    at: dict[int, list[Label]] = defaultdict(list)
    for label in labels:
        at[label.slots].append(label)
    for i in range(len(slots)):
        for label in sorted(at[i], key=lambda x: lam * x.spent - x.value)[:width]:
            at[i + 1] += [new for r in _choices(slots[i]) if (new := _step(label, slots, r, asked))]
    good = [x for x in at[len(slots)] if x.friends >= asked["partners"]]
    return _way(max(good, key=lambda x: x.value).way) if good else []


def plan(candidates: DataFrame, requests: DataFrame | None = None, nodes: int = 20_000) -> DataFrame:
    """(request_id, day, slot, place_id, arrives, proven): for each request the stops whose scores, and liked types, add up to most.

    candidates: request_id, day, slot, starts (of the slot), required, place_id, type, org_id, price
    (null: 0), partner, score, earliest, latest (minutes to arrive), dwell, lat, lng: at
    most some tens a slot. requests: request_id and any of ASKED, null for the default.

    A slot holds one stop at most, a required one exactly one; no place comes
    twice; caps by organisation and trip, and by type and day; the price bands stay within the
    budget, enough stops are partners; from stop to stop there is time to travel. A request
    that can't be met has no row. The search is exact; if it needs over `nodes`
    labels, the best plan that a beam finds from there stands, with proven false.
    """
    wanted = candidates.select("request_id").distinct()
    have = requests if requests is not None else wanted
    filled = have.select("request_id", *[(F.col(k) if k in have.columns else F.lit(None)).alias(f"ask_{k}") for k in ASKED])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        def given(k: str):
            v = rows[f"ask_{k}"].iloc[0]
            return list(v) if k == "interests" and v is not None else ASKED[k] if k == "interests" or pd.isna(v) else int(v)

        asked = {k: given(k) for k in ASKED}
        found = best_plan(slots_of(rows, set(asked["interests"])), asked, nodes)
        chosen, proven = found or ([], True)
        rid = rows["request_id"].iloc[0]
        return pd.DataFrame([(rid, s.day, s.name, r["place_id"], int(at), proven) for s, r, at in chosen], columns=["request_id", "day", "slot", "place_id", "arrives", "proven"])

    casts = {"max_per_org": "int", "max_per_type": "int", "budget": "int", "partners": "int", "interests": "array<string>"}
    typed = filled.select("request_id", *[F.col(f"ask_{k}").cast(t) for k, t in casts.items()])
    return candidates.join(typed, "request_id", "left").groupBy("request_id").applyInPandas(search, "request_id long, day int, slot string, place_id long, arrives int, proven boolean")
