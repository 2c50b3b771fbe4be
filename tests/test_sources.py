"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from meridian.sources import files, pages, php
from meridian.streaming import events


def test_jsonl_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"wp_id": 1, "title": "x", "meta": {"k": "v"}}\n\nnot json\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), files.ARTICLE).cache()
    assert rows.filter("_bad IS NULL").select("wp_id", "meta").collect()[0].meta == {"k": "v"}
    assert rows.filter("_bad IS NOT NULL").count() == 1
    files.write_jsonl(rows.filter("_bad IS NULL").select("wp_id", "title"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_iso(spark):
    got = spark.createDataFrame([("2020-01-02 03:04:05",), ("0000-00-00 00:00:00",), (None,)], "t string").select(files.iso(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["2020-01-02T03:04:05", None, None]


def test_search_console(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Query,Page,Clicks,Impressions,CTR,Position\nspa bali,https://X.com/a/,3,10,30%,1.5\nnone,https://x.com/b,0,5,0%,9\n")
    links = spark.createDataFrame([("https://x.com/a", "a", "s", 7, 200, False)], files.PERMALINK)
    got = files.search_queries(files.read_csv(spark, str(tmp_path / "q.csv"), files.SEARCH_CONSOLE), links).collect()
    assert [tuple(r) for r in got] == [("spa bali", 7, 3, 10)]


WXR = """<?xml version="1.0"?><rss xmlns:wp="w" xmlns:content="c" xmlns:dc="d" xmlns:excerpt="e"><channel>
<item><title>One</title><link>http://x/1</link><content:encoded><![CDATA[<p>a</p>]]></content:encoded><wp:post_id>1</wp:post_id><wp:post_type>post</wp:post_type><wp:status>publish</wp:status><wp:post_date>2020-01-01 00:00:00</wp:post_date><category domain="category" nicename="food">Food</category><category domain="post_tag" nicename="t">T</category></item>
<item><title>Two</title><wp:post_id>2</wp:post_id><wp:post_type>page</wp:post_type></item></channel></rss>"""


def test_wxr(spark, tmp_path):
    for n in ("a.xml", "b.xml"):
        (tmp_path / n).write_text(WXR)
    items = files.read_wxr(spark, f"{tmp_path}/*.xml")
    got = {r.wp_id: r for r in files.dedupe_items(items).collect()}
    assert set(got) == {1, 2} and got[1].content_html == "<p>a</p>" and got[1].categories == ["food"] and got[1].tags == ["t"] and got[1].file.endswith("a.xml")


def test_terms_and_meta(spark):
    rel = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "object_id long, term_taxonomy_id long")
    tax = spark.createDataFrame([(10, 100, "category"), (11, 101, "tag")], "term_taxonomy_id long, term_id long, taxonomy string")
    terms = spark.createDataFrame([(100, "Food"), (101, "Hot")], "term_id long, name string")
    assert {r.object_id: r.names for r in files.terms_by_object(rel, tax, terms, "category").collect()} == {1: ["Food"], 2: ["Food"]}
    meta = spark.createDataFrame([(1, 5, "k", "old"), (2, 5, "k", "new"), (3, 5, "z", "no")], "meta_id long, post_id long, meta_key string, meta_value string")
    assert files.meta_map(meta, ["k"]).first().meta == {"k": "new"}


def test_php(spark):
    text = 'a:2:{s:3:"lat";s:4:"-6.2";s:3:"lng";d:106.8;}'
    assert php.unserialize(text) == {"lat": "-6.2", "lng": 106.8} and php.unserialize("a:1:{") is None and php.unserialize('a:2:{i:0;b:1;i:1;N;}') == [True, None]
    lat, lng = php.lat_lng(F.col("t"))
    got = spark.createDataFrame([(text,), ("x",), (None,)], "t string").select(lat.alias("lat"), lng.alias("lng")).collect()
    assert [tuple(r) for r in got] == [(-6.2, 106.8), (None, None), (None, None)]


def test_sitemaps_and_seeds(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> http://x/a </loc></url><url><loc><![CDATA[http://x/b]]></loc></url></urlset>")
    assert {r.loc for r in files.sitemap_urls(spark, str(tmp_path / "s.xml")).collect()} == {"http://x/a", "http://x/b"}
    (tmp_path / "seed.json").write_text(json.dumps({"facet": "loc", "terms": [{"slug": "a", "label": "A", "children": [{"slug": "b", "label": "", "children": [{"slug": "a", "label": "C"}]}]}]}))
    seed = files.read_seed(spark, str(tmp_path / "seed.json"))
    assert {(r.slug, r.parent, r.depth) for r in seed.collect()} == {("a", "b", 2), ("a", None, 0), ("b", "a", 1)}
    assert {tuple(r) for r in files.check_seed(seed).collect()} == {("loc", "a", "twice"), ("loc", "b", "no label")}


def test_append_is_all_or_nothing(spark, tmp_path):
    sid = "123e4567-e89b-12d3-a456-426614174000"
    good = spark.createDataFrame([(sid, "5", "2024-01-02 00:00:00")], "session_id string, entity_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    bad = good.unionAll(good.withColumn("ts", F.to_timestamp(F.lit("2020-01-01 00:00:00"))))
    path = str(tmp_path / "log")
    with pytest.raises(ValueError, match="1 of 2"):
        files.append_events(bad, path, "2024-01-02")
    assert files.append_events(good, path, "2024-01-02") == 1
    assert files.retained(spark.read.parquet(path), "2024-01-03", 5).count() == 1 and files.retained(spark.read.parquet(path), "2024-03-03", 5).count() == 0


def test_pages_resume(spark, tmp_path):
    (tmp_path / "posts").mkdir()
    for n in (1, 2):
        (tmp_path / "posts" / f"page-{n}.json").write_text(json.dumps([{"id": n}, {"id": n + 10}]))
    sink = str(tmp_path / "sink")
    assert pages.harvest(spark, str(tmp_path), "posts", sink) == 2
    (tmp_path / "posts" / "page-3.json").write_text("[]")
    (tmp_path / "posts" / "page-4.json").write_text('[{"id": 4}]')
    assert pages.harvest(spark, str(tmp_path), "posts", sink) == 1
    assert spark.read.parquet(sink).count() == 5


def test_blobs_and_inventory(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "b").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    got = files.blobs(spark, str(tmp_path), "city").collect()
    assert len({r.object_key for r in got}) == 1 and {r.ext for r in got} == {"png"}
    inline = spark.createDataFrame([("https://x.com/i-300x200.jpg?v=1",)], "url string")
    att = spark.createDataFrame([("http://www.x.com/i.jpg",)], "url string")
    inv = files.media_inventory(inline, att).collect()
    assert len(inv) == 1 and inv[0].sources == ["attachment", "inline"]


def test_small_sinks(spark):
    rows = spark.createDataFrame([(1, 10), (2, 99999)], "id long, computed_at long")
    assert files.fresh(rows, 100000).count() == 1
    assert files.not_done(rows, rows.filter("id = 1"), "id").first().id == 2
    assert json.loads(files.feature_log(rows.withColumn("n", F.lit(None).cast("int"))).first().value)["n"] is None
    assert "| 1 | 10 |" in files.report("t", rows)
    side = spark.createDataFrame([("1", "5"), ("1", "7"), ("x", "1"), ("2", "y")], "wp_id string, views string")
    assert [tuple(r) for r in files.side_metadata(side, "wp_id", "views").collect()] == [(1, 7)]
    urls = spark.createDataFrame([(f"u{i}", "a" if i < 8 else "b") for i in range(10)], "url string, k string")
    assert files.stratified(urls, "k", 4).groupBy("k").count().collect()[0]["count"] == 2


def _messages(spark, folder):
    rows = [{"event_id": 1, "type": "publish", "entity_id": "a", "user_id": 1, "ts": "2024-01-01T00:00:00Z", "text_hash": "h1"}, {"event_id": 2, "type": "publish", "entity_id": "a", "user_id": 1, "ts": "2024-01-01T01:00:00Z", "text_hash": "h2"}, {"event_id": 3, "type": "odd", "entity_id": "b", "user_id": 1, "ts": "2024-01-01T02:00:00Z"}]
    (folder / "m.txt").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    return spark.readStream.text(str(folder))


def test_routing_quarantines_and_upserts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stream = events.decode(_messages(spark, src))
    table, lost = str(tmp_path / "table"), []
    q = events.route(stream, {"publish": events.upsert_epoch(table, "entity_id")}, str(tmp_path / "ck"), lambda b, e: lost.extend(b.collect()))
    q.awaitTermination()
    got = spark.read.parquet(table).collect()
    assert [(r.entity_id, r.text_hash) for r in got] == [("a", "h2")]
    assert sorted(r.raw[:6] for r in lost)[0] == "broken" and len(lost) == 2


def test_late_rows_are_refused(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2020-01-01 00:00:00"), (3, None)], "event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    ok, late = events.split_late(rows, F.to_timestamp(F.lit("2024-01-01 12:00:00")))
    assert [r.event_id for r in ok.collect()] == [1] and sorted(r.event_id for r in late.collect()) == [2, 3]


def test_once(spark, tmp_path):
    (tmp_path / "d").mkdir()
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "d" / "p"))
    stream = events.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "d" / "p")))
    stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
