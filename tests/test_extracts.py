"""Extracts of a blog's tables and exports, and stand-in providers, on small rows by hand."""

import json

from pyspark.sql import functions as F

from meridian.operators import providers
from meridian.sources import extracts, files

POSTS = "ID long, post_type string, post_status string, post_title string, post_name string, post_content string, post_excerpt string, post_date string, post_modified string, post_author long, guid string, post_mime_type string"


def posts(spark):
    day = "2020-01-02 03:04:05"
    rows = [
        (1, "post", "publish", "One", "one", "<p>a</p>", "e", day, day, 7, "g1", ""),
        (2, "post", "draft", "Two", "two", "", "", day, "0000-00-00 00:00:00", 7, "g2", ""),
        (3, "post", "publish", "Three", "three", "", "", day, day, 8, "g3", ""),
        (4, "attachment", "inherit", "Pic", "pic", "", "", day, day, 7, "http://old/pic-jpg/", "image/jpeg"),
        (5, "attachment", "inherit", "Lost", "lost", "", "", day, day, 7, "http://old/lost.jpg", "image/jpeg"),
        (6, "tribe_events", "publish", "Fair", "fair", "", "", day, day, 7, "g6", ""),
        (7, "upcoming-events", "publish", "Soon", "soon", "", "", day, day, 7, "g7", ""),
        (8, "tribe_organizer", "publish", "Guild", "guild", "", "", day, day, 7, "g8", ""),
        (9, "tribe_venue", "publish", "Hall", "hall", "", "", day, day, 7, "g9", ""),
    ]
    return spark.createDataFrame(rows, POSTS)


def meta(spark):
    size = 'a:2:{s:5:"width";i:640;s:6:"height";i:480;}'
    rows = [
        (1, 1, "_yoast_wpseo_primary_category", "12"), (2, 1, "_thumbnail_id", "4"), (3, 1, "_yoast_wpseo_focuskw", "spa"), (4, 1, "unknown", "x"),
        (5, 4, "_wp_attached_file", "2020/pic.jpg"), (6, 4, "_wp_attachment_metadata", size), (7, 4, "_wp_attachment_image_alt", ""),
        (8, 6, "_EventStartDate", "2020-05-01 10:00:00"), (9, 6, "_EventAllDay", "yes"), (10, 6, "_EventVenueID", "9"), (11, 6, "_EventOrganizerID", "8"), (12, 6, "_EventCost", ""), (13, 7, "_EventStartDate", "2020-05-01 10:00:00"),
        (14, 9, "_VenueCity", "Ubud"), (15, 9, "_VenueStateProvince", "Bali"), (16, 9, "_VenueVenue", ""), (17, 6, "_EventVenueID", "0"),
    ]
    return spark.createDataFrame(rows, "meta_id long, post_id long, meta_key string, meta_value string")


def test_articles_lead_with_the_primary_category(spark):
    cats = spark.createDataFrame([(1, ["Art", "Food", "Spa"], [11, 12, 13]), (2, ["Art"], [11])], "object_id long, names array<string>, term_ids array<long>")
    got = {r.wp_id: r for r in extracts.articles(posts(spark), cats, meta(spark), "https://x.com/").collect()}
    assert set(got) == {1, 3}
    assert got[1].categories == ["Food", "Art", "Spa"] and got[1].meta == {"_yoast_wpseo_primary_category": "12", "_yoast_wpseo_focuskw": "spa"} and got[1].thumbnail_id == 4
    assert got[1].permalink == "https://x.com/one/" and got[3].categories == [] and got[3].meta == {} and got[3].date == "2020-01-02T03:04:05"
    stats = extracts.coverage(extracts.articles(posts(spark), cats, meta(spark), "h"), with_categories=F.size("categories") > 0).first()
    assert (stats.rows, stats.with_categories, stats.with_categories_pct) == (2, 1, 50.0)


def test_attachments_events_venues_users(spark):
    files_ = {r.wp_id: r for r in extracts.attachments(posts(spark), meta(spark), "https://x.com").collect()}
    assert files_[4].url == "https://x.com/wp-content/uploads/2020/pic.jpg" and (files_[4].width, files_[4].height, files_[4].alt) == (640, 480, None)
    assert files_[5].url == "http://old/lost.jpg" and files_[5].width is None
    cats = spark.createDataFrame([(6, ["Fairs"]), (7, ["Soon"])], "object_id long, names array<string>")
    found = {r.wp_id: r for r in extracts.events(posts(spark), cats, meta(spark)).collect()}
    assert found[6].start_date == "2020-05-01T10:00:00" and found[6].all_day and found[6].venue_id is None and found[6].organizer_name == "Guild" and found[6].cost is None and found[6].categories == ["Fairs"]
    assert found[7].start_date is None and found[7].all_day is None and found[7].type == "upcoming-events"
    hall = extracts.venues(posts(spark), meta(spark)).first()
    assert (hall.name, hall.city, hall.state, hall.address) == ("Hall", "Ubud", "Bali", None)
    people = spark.createDataFrame([(7, "a", "a", "a@x", "A", "2019-01-01 00:00:00"), (9, "b", "b", "b@x", "B", None)], "ID long, user_login string, user_nicename string, user_email string, display_name string, user_registered string")
    assert {r.wp_id: r.published for r in extracts.users(people, posts(spark)).collect()} == {7: 1, 9: 0}


def test_points_of_maps(spark):
    one = 'a:3:{s:5:"title";s:1:"M";s:6:"center";a:2:{s:3:"lat";s:4:"-8.5";s:3:"lng";s:5:"115.2";}s:4:"pois";a:1:{i:0;a:2:{s:5:"title";s:1:"P";s:5:"point";a:2:{s:3:"lat";d:-8.4;s:3:"lng";d:115.1;}}}}'
    two = 'a:2:{s:5:"title";s:1:"N";s:6:"center";a:2:{s:3:"lat";s:2:"-8";s:3:"lng";s:3:"115";}}'
    maps = spark.createDataFrame([(1, one), (2, two), (3, "broken"), (4, None)], "mapid long, obj string")
    placed = spark.createDataFrame([(10, 1), (11, 1)], "postid long, mapid long")
    got = {(r.map_id, r.wp_id): (r.poi_index, r.title, r.lat, r.lng) for r in extracts.map_points(maps, placed).collect()}
    assert got == {(1, 10): (0, "P", -8.4, 115.1), (1, 11): (0, "P", -8.4, 115.1), (2, None): (None, "N", -8.0, 115.0)}


def test_redirects_and_rows_for_search(spark):
    items = spark.createDataFrame([(1, "/a", "", 0, "url", "enabled", "url", 301, "/b", 2, 5), (2, "/c.*", "/c", 1, "url", "disabled", "error", 404, "", 2, 0)], "id long, url string, match_url string, regex int, match_type string, status string, action_type string, action_code int, action_data string, group_id long, last_count long")
    got = {r.wp_id: (r.match_url, r.is_regex, r.target) for r in extracts.redirects(items).collect()}
    assert got == {1: (None, False, "/b"), 2: ("/c", True, None)}
    rows = spark.createDataFrame([(1, "published", "t", None, "b"), (2, "draft", "t", "d", "b")], "id long, status string, title string, dek string, body string")
    assert [r.entity_id for r in extracts.search_rows(rows).collect()] == ["1"]


def test_export_and_priors(spark, tmp_path):
    items = spark.createDataFrame(
        [(1, "post", "publish", "x", ["food"], ["t"], "f1", "ann"), (1, "post", "publish", "later", ["food"], [], "f2", "ann"), (2, "attachment", "inherit", "y", [], [], "f1", "bob"), (3, "post", "draft", "z", ["food"], [], "f1", "bob")],
        "wp_id long, type string, status string, title string, categories array<string>, tags array<string>, file string, author string",
    )
    full = items.withColumns({k: F.lit(None).cast("string") for k in ("slug", "content_html", "excerpt", "date", "permalink", "attachment_url")})
    assert [(r.wp_id, r.title) for r in extracts.from_export(full, "articles").collect()] == [(1, "x")]
    assert [r.wp_id for r in extracts.from_export(full, "attachments").collect()] == [2]
    assert {r.author: (r["items"], r.published) for r in extracts.from_export(full, "authors").collect()} == {"ann": (1, 1), "bob": (2, 0)}
    assert {(r.taxonomy, r.slug): r["items"] for r in extracts.from_export(full, "terms").collect()} == {("category", "food"): 2, ("post_tag", "t"): 1}
    (tmp_path / "p.json").write_text(json.dumps({"categories": [{"wp_term_id": 1, "slug": "food", "is_print_issue": False, "prior": {"type": "eat", "facets": ["vibe:a", "vibe:b"]}}, {"wp_term_id": 2, "slug": "issue-1", "is_print_issue": True, "prior": {}}]}))
    assert {(r.slug, r.type, r.facet) for r in extracts.category_priors(spark, str(tmp_path / "p.json")).collect()} == {("food", "eat", "vibe:a"), ("food", "eat", "vibe:b")}
    assert files.dedupe_items(items).count() == 3


def test_providers_that_need_no_network(spark):
    texts = spark.createDataFrame([(1, "quiet garden villa"), (2, "garden villa quiet"), (3, "loud market"), (4, None)], "key long, text string")
    v = {r.key: r.embedding for r in providers.HashEmbedder(32).embed(texts).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert len(v[4]) == 32 and dot(4, 4) == 0 and abs(dot(1, 2) - 1) < 1e-5 and dot(1, 3) < 0.9
    known = spark.createDataFrame([("Jalan 5, Ubud", 1.0, 2.0)], "address string, lat double, lng double")
    asked = spark.createDataFrame([(1, "jalan 5 ubud"), (2, "nowhere")], "key long, address string")
    assert [tuple(r) for r in providers.TableGeocoder(known).points(asked).collect()] == [(1, 1.0, 2.0)]
    pairs = spark.createDataFrame([(1, -6.2, 106.8, 2, -6.2, 106.9), (2, -6.2, 106.9, 3, -6.2, 107.0)], "a long, lat_a double, lng_a double, b long, lat_b double, lng_b double")
    got = {(r.a, r.b): r.minutes for r in providers.Haversine(spark.createDataFrame([(2, 1, 9)], "a long, b long, minutes int")).minutes(pairs).collect()}
    assert got[1, 2] == 9 and got[2, 3] > 9
