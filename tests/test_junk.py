"""Junk rules: for each rule names that it takes, and names that it must leave alone."""

from pyspark.sql import functions as F

from meridian.operators import junk

HOTELS = junk.Words(brands=("conrad", "hilton", "ritz"), brand_pairs=(("ritz", "conrad"),), areas=("nusa dua",), phrases=("ubud centre",))

CASES = {
    "empty": ["", None, "  ", "...", '"."'],
    "url": ["www.place.com", "best-warung-in-town", "mail@place", "Place.co.id"],
    "area": ["Nusa  Dua"],
    "run_on": ["a1 " * 15],
    "possessive": ["Made's", "The Guests’", "Bali's Leading Hideaway", "Ann's and Bob's Kitchen", "The Sunset Bar's Terrace", "Old Town's Hideout"],
    "phrase": ["Ubud Centre"],
    "lead": ["Discover Ubud", "Best Warung", "March Madness"],
    "new_kind": ["New Thai Kitchen"],
    "the_best": ["The Best Warung"],
    "job": ["General Manager Ketut", "Chef Wayan", "Founder of Locavore", "Executive Chef at Mozaic"],
    "address": ["Jalan Raya Ubud", "Warung Made Jl. Raya", "Warung Kav"],
    "award": ["Runner-up Warung", "World Travel Awards", "5th Avenue Warung", "Restaurant of the Year"],
    "year": ["2013 Serpentine Pavilion", "1971 at Pike", "Warung Guide 2016"],
    "event": ["Jazz Festival", "Easter Brunch", "Wine Weekend", "Chocolate Workshops"],
    "weekday": ["Sunday Farmers Market", "Friday Jazz Nights"],
    "gathering": ["Barista Championship", "Coffee Conferences"],
    "day": ["Global Wellness Day"],
    "offer": ["Credit of IDR 600,000", "Three Days Retreat", "Dine for $ 20", "2-night Stay"],
    "time": ["10pm Rooftop", "Warung 8.30 am"],
    "level": ["Dahana Level 2", "Ground Floor Dahana"],
    "month_at": ["Jazz in December at Mulia"],
    "held_at": ["Cooking with Love at Mulia", "Wine Dinner at Mulia"],
    "room": ["Deluxe Ocean Room", "The Anvaya Suite", "Suite Lagoon for 2", "Executive Twin Villa", "Honeymoon in a Villa Ubud", "Upper Floors"],
    "caption": ["Ubud Getaway", "Warung Interior", "Degustation Menu"],
    "concept": ["Secrets of Ubud", "The Taste of Java"],
    "two_brands": ["Conrad Hilton Ubud"],
    "same_noun": ["Central Park Tribeca Park"],
    "and_at": ["Sip and at Mulia", "Indulge and Imbibe at Mulia"],
    "cut_after_and": ["Warung Made and Vis", "Made & I"],
    "two_venues": ["Warung Made and the Pool Side", "Sunset Bar and Locavore", "Kayu Hotel & Mozaic Gallery"],
    "cut_off": ["Warung Made Restaur", "Mozaic Gal"],
    "generic": ["The Thai Restaurant", "Seafood Bar and Lounge", "Rooftop"],
    "opener": ["This Is Ubud", "To Kayu"],
    "joined": ["Made and Wayan", "Kayu & Batu"],
    "at": ["Kayu at Mulia"],
    "of": ["Kingdom of Toys"],
    "number": ["25hours Kayu", "Warung 99"],
    "two_outlets": ["Copa Restaurant La Floriane Lounge"],
    "long": ["Kayu Batu Made Wayan Nyoman Ketut Putu Gede"],
    None: ["Warung Made", "Festival Park", "Conference Hall Kayu", "Bar & Grill Kayu", "Made's Kitchen", "Conrad Ritz", "Best Western Kuta", "Kayu Resort & Villas", "Mozaic", "All Day", "Locavore Brasserie", "Café Été", "Bar Luna"],
}


def test_every_rule(spark):
    rows = [(k, why, name) for k, (why, name) in enumerate((w, n) for w, names in CASES.items() for n in names)]
    df = spark.createDataFrame(rows, "id int, why string, name string")
    verdict, reason = junk.verdict(df.name, HOTELS)
    got = {r.name: (r.reason, r.verdict) for r in df.select("name", verdict.alias("verdict"), reason.alias("reason")).collect()}
    sure = {why: s for why, _, s in junk.rules(df.name)}
    assert set(sure) == set(CASES) - {None}
    assert got == {name: (why, "ok" if why is None else "junk" if sure[why] else "suspect") for _, why, name in rows}




def test_each_distinct_name_is_judged_once_and_dealt_out(spark):
    names = ["Kayu at Mulia", "Mozaic", None, "  ", "www.x.com", "Mozaic", "Kayu at Mulia", "Mozaic Gal"]
    df = spark.createDataFrame([(i, names[i * 5 % 8]) for i in range(80)], "id long, name string")
    verdict, reason = junk.verdict(df.name)
    want = sorted(map(str, df.groupBy(verdict.alias("verdict"), reason.alias("reason")).agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()))
    got = junk.verdict_counts(df)
    assert sorted(map(str, got.collect())) == want and len(want) > 3
    assert "RepartitionByExpression [name" in got._jdf.queryExecution().optimizedPlan().toString()
