"""REST records as flat rows, and points and events of exports."""

import json

from meridian.sources import extracts, files, rest


def rows(spark, kind, *records):
    texts = [(json.dumps(r),) for r in records] + [("{torn",), ("{}",), (None,)]
    return rest.records(spark.createDataFrame(texts, "item string"), kind)


def test_posts_and_their_terms(spark):
    terms = rest.terms(rows(spark, "terms", {"id": 3, "taxonomy": "category", "name": "Food &amp; Wine", "slug": "f", "parent": 0, "count": 2, "description": ""}, {"id": 4, "name": "", "parent": 3}, {"id": 5, "name": "Ubud"}))
    assert sorted((r.term_id, r.name, r.parent, r.description) for r in terms.collect()) == [(3, "Food & Wine", None, None), (4, None, 3, None), (5, "Ubud", None, None)]
    posts = rows(
        spark,
        "posts",
        {"id": 1, "type": "post", "title": {"rendered": "A <b>B</b> &amp; C"}, "content": {"raw": "[x]", "rendered": "<p>x</p>"}, "excerpt": {"rendered": "  "}, "categories": [5, 9, 3], "tags": [4], "featured_media": 0, "template": "", "author": 7, "link": "http://h/1"},
        {"id": 2, "title": {"rendered": " "}, "content": {"rendered": "shown"}, "featured_media": 8},
    )
    got = {r.wp_id: r for r in rest.posts(posts, terms).collect()}
    assert (got[1].title, got[1].content_html, got[1].content_is_raw, got[1].excerpt, got[1].categories, got[1].category_ids, got[1].tags, got[1].thumbnail_id, got[1].template, got[1].author_id) == ("A B & C", "[x]", True, None, ["Ubud", "Food & Wine"], [5, 9, 3], [], None, None, 7)
    assert (got[2].title, got[2].content_html, got[2].content_is_raw, got[2].categories, got[2].thumbnail_id) == (None, "shown", False, [], 8)
    assert "categories" not in rest.posts(posts).columns


def test_users_and_comments(spark):
    (u,) = rest.users(rows(spark, "users", {"id": 1, "slug": "ann", "name": "Ann &#8217;s &#x1F600;&#; &amp; co", "url": "", "avatar_urls": {}})).collect()
    assert (u.login, u.nicename, u.display_name, u.url, u.email, u.avatar_urls, u.published_post_count) == ("ann", "ann", "Ann ’s 😀&#; & co", None, None, None, None)
    (k,) = rest.comments(rows(spark, "comments", {"id": 9, "post": 1, "parent": 0, "author": 0, "author_name": "A &amp; B", "content": {"rendered": "hi"}, "status": "approved"})).collect()
    assert (k.post_wp_id, k.parent_wp_id, k.author_wp_id, k.author_name, k.content_html) == (1, None, None, "A & B", "hi")


def test_media(spark):
    full = {"id": 4, "source_url": "https://h.com/wp-content/uploads/2020/pic-1024x768.jpg?x=1", "guid": {"rendered": "http://old/p"}, "alt_text": " ", "post": 0, "mime_type": "image/jpeg", "media_details": {"file": "2020/pic-1.jpg", "width": 9, "height": 8, "filesize": 70, "sizes": {"thumb": {"file": "t.jpg", "width": 1, "mime_type": "m"}, "large": {"file": "l.jpg"}}, "image_meta": {"credit": " me ", "copyright": ""}}}
    got = {r.wp_id: r for r in rest.media(rows(spark, "media", full, {"id": 5, "guid": {"rendered": "http://old/q"}})).collect()}
    m = got[4]
    assert (m.url, m.guid, m.filename, m.alt, m.credit, m.copyright, m.width, m.filesize, m.parent_post_id) == (full["source_url"], "http://old/p", "pic-1.jpg", None, "me", None, 9, 70, None)
    assert [(s.name, s.file, s.mime) for s in m.sizes] == [("large", "l.jpg", None), ("thumb", "t.jpg", "m")]
    assert m.match_keys == ["/wp-content/uploads/2020/pic-1024x768.jpg", "/wp-content/uploads/2020/pic-1.jpg", "pic-1024x768.jpg", "pic.jpg"]
    assert (got[5].url, got[5].sizes, got[5].match_keys) == ("http://old/q", [], ["/q", "q"])


def test_points_and_events_of_exports(spark, tmp_path):
    meta = lambda k, v: f"<wp:postmeta><wp:meta_key>{k}</wp:meta_key><wp:meta_value><![CDATA[{v}]]></wp:meta_value></wp:postmeta>"
    item = lambda i, kind, *m: f"<item><title>t{i}</title><wp:post_id>{i}</wp:post_id><wp:post_type>{kind}</wp:post_type><wp:status>publish</wp:status>{''.join(m)}</item>"
    good = 'a:4:{s:4:"name";s:4:"Kayu";s:7:"address";s:4:"Ubud";s:3:"lat";s:4:"-8.5";s:3:"lng";d:115.25;}'
    body = item(1, "post", meta("google_map", "old"), meta("google_map", good)) + item(2, "post", meta("google_map", 'a:2:{s:3:"lat";s:0:"";s:3:"lng";s:1:"1";}')) + item(3, "post", meta("google_map", "broken")) + item(4, "tribe_events", meta("_EventStartDate", "2024-01-02 10:00:00"), meta("_EventVenueID", "77"), meta("_EventCost", "")) + item(5, "post")
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?><rss xmlns:wp="http://w/" xmlns:content="http://c/"><channel>{body}</channel></rss>')
    items = files.read_wxr(spark, f"{tmp_path}/*.xml").cache()
    assert sorted(tuple(r) for r in extracts.from_export(items, "geo").collect()) == [(1, "Kayu", "Ubud", -8.5, 115.25, None), (2, None, None, None, None, None)]
    (e,) = extracts.from_export(items, "events").collect()
    assert (e.wp_id, e.type, e.start_date, e.end_date, e.venue_id, e.cost) == (4, "tribe_events", "2024-01-02T10:00:00", None, 77, None)
