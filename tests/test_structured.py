"""Structured data and embedded state of pages."""

import json

from loomwright.operators import crawl, dealers
from loomwright.sources import feeds, pages, structured


def html_of(*blocks):
    return "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks)


def test_entities(spark):
    dealer = {"@type": "AutoDealer", "name": "Lot", "telephone": "1", "address": {"streetAddress": "S 1", "addressLocality": "T", "postalCode": "Z"}, "makesOffer": [{"item": {"@type": "Car", "vehicleModelDate": 2020, "brand": "Ford", "model": "Fiesta", "offers": [{"price": "9", "itemCondition": "x"}], "amenityFeature": [{"name": "AC"}, "ABS"], "itemCondition": "CertifiedCondition"}}, None]}
    course = {"@Type": "Course", "headline": "Sums", "provider": {"name": "Uni"}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": 7}, "image": ["a.png", {"url": "b.png"}], "offers": {"price": 0}}
    menu = {"@type": "MenuItem", "description": "d", "ingredients": ["salt", "pepper"], "nutrition": {"calories": 5}}
    faq = {"@type": "FAQPage", "mainEntity": [{"name": "Q1", "suggestedAnswer": {"text": "A1"}}, {"name": "Q2"}, 5, {}]}
    rows = [(1, "http://a.ca/", html_of("{oops", dealer)), (2, "http://a.com/new-inventory/1", html_of([course, {"@type": "Truck"}, {"@type": "Unknown", "name": "x"}], menu)), (3, "http://a.com/", html_of({"@graph": [faq, {"@type": "Service"}]})), (4, None, None), (5, "u", ""), (6, "u", html_of("[" * 100_000))]
    got = {(r.id, r.place): r for r in structured.entities(spark.createDataFrame(rows, "id int, url string, html string"), "id", "url", "html").collect()}
    assert {k: (r.family, r.title, r.content) for k, r in got.items()} == {
        (1, 0): ("vehicle", "2020 Ford Fiesta", "2020 Ford Fiesta"), (1, 1): ("business", "Lot", "Lot — S 1"), (2, 0): ("course", "Sums", ""), (2, 1): ("vehicle", "Vehicle", "Vehicle"), (2, 2): ("menu", "Menu Item", "d"),
        (3, 0): ("faq", "Q1", "A1"), (3, 1): ("faq", "Q2", "Q2"),
    }
    car, lot, sums, truck = got[1, 0], got[1, 1], got[2, 0], got[2, 1]
    assert (car.price, car.currency, car.details["condition"], car.details["features"], car.details["make"], car.details["year"]) == ("9", "CAD", "cpo", "AC, ABS", "Ford", "2020")
    assert (lot.details["address"], lot.details["phone"], lot.currency) == ("S 1, T  Z", "1", None)
    assert (sums.price, sums.rating, sums.reviews, sums.images, sums.details["instructor"]) == ("0", 4.5, 7, ["a.png", "b.png"], "Uni")
    assert (truck.details["condition"], truck.currency, got[2, 2].details["ingredients"], json.loads(got[2, 2].details["nutrition"])) == ("new", "USD", "salt, pepper", {"calories": 5})


def test_availability_and_depth(spark):
    df = spark.createDataFrame([("https://schema.org/InStock",), ("OUT_OF_STOCK",), ("PreOrder",), ("Sold",), ("http://schema.org/Sold",), ("LimitedAvailability",), ("",), (None,)], "a string")
    assert [r.x for r in df.select(structured.availability(df.a).alias("x")).collect()] == ["In Stock", "Out of Stock", "Pre-Order", "Sold", "Sold", "Limited Availability", "", None]
    thing = {"@type": "Product", "name": "deep"}
    for i in range(300):
        thing = {"@type": "ItemList", "itemListElement": [{"item": thing}]} if i % 2 else {"@type": "OfferCatalog", "itemList": [thing]}
    df = spark.createDataFrame([(html_of(thing),)], "html string").selectExpr("1 AS id", "'u' AS url", "html")
    assert [r.title for r in structured.entities(df, "id", "url", "html").collect()] == ["deep"]


def test_app_state(spark):
    item = {"name": "Lamp", "price": 3}
    deep = item2 = {"products": [{"name": "Deep", "price": 1}]}
    for _ in range(5):
        deep = {"x": deep}
    rsc = json.dumps('3:["$", [{"name": "Chunk [1]; }", "sku": "s"}, 4], {"a": [ {"fullName": "Second", "id": 2}]}')
    stated = [
        (1, f'<script>window.vehicles = {json.dumps([item, {"name": "lamp", "price": 4}, {"name": "No mark"}])};</script><script type="application/json">{json.dumps({"data": [{"title": "Late; }", "id": 1}, {"title": "menu", "id": 2}]})}</script>'),
        (2, f"<script>self.__next_f.push([1, {rsc}])</script>"), (3, f'<script id="__NEXT_DATA__">{json.dumps({"props": deep})}</script>'), (4, f'<script id="__NEXT_DATA__">{json.dumps({"props": {"y": deep}})}</script>'),
        (5, '<script>window.DDC = window.DDC || {}; window.DDC.dataLayer = {"vehicles": [{"year": 2020, "make": "A", "model": "B"}], "t": "};"};</script>'), (6, None), (7, "<script>window.inventory = {broken</script>"),
    ]
    got = {(r.page, r.title, r.raw.get("price")) for r in structured.app_state(spark.createDataFrame(stated, "id int, html string"), "id", "html").collect()}
    assert item2 and got == {(1, "Lamp", "3"), (1, "Late; }", None), (2, "Chunk [1]; }", None), (2, "Second", None), (3, "Deep", "1"), (5, "2020 A B", None)}


def test_feed_texts(spark):
    rows = [(1, "a;b,c;d\n1;2;3\n"), (2, '﻿"x, y"\t z \ta\n"q""r"\t\'s\'\n\t\t\n1\t2\t3\t4'), (3, None), (4, ""), (5, "only,header\n"), (6, "a,,a\n1,2,3"), (7, 'a,b\n"open,1\n2,3')]
    got = {(r.id, r.place): r.raw for r in feeds.csv_items(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()}
    assert got == {(1, 0): {"a": "1", "b,c": "2", "d": "3"}, (2, 0): {"x, y": 'q"r', "z": "'s'", "a": ""}, (2, 1): {"x, y": "1", "z": "2", "a": "3"}, (6, 0): {"a": "3"}, (7, 0): {"a": "open,1\n2,3", "b": ""}}


def test_blocked_by_message(spark):
    df = spark.createDataFrame([(200, "x" * 3000 + "cloudflare", None), (200, "Cloudflare", None), (None, None, "Site-Firewall said no"), (403, None, None), (None, None, None), (200, "fine", "captcha"), (200, "security check", None)], "s int, b string, m string")
    assert [r.x for r in df.select(pages.is_blocked(df.s, df.b, df.m).alias("x")).collect()] == [False, True, True, True, False, False, False]


def test_sections(spark):
    inside = '<div id="top-NAV"><a href="/a">Shop <b>now</b></a><a class=x href=\'https://e.x/q\'>About us</a><a href="https://e.x/r">Elsewhere</a><a href="#shop">Shop</a></div><a href="/z">Outside</a><header class="my header"><a href="/b">shop NOW</a><a href="/_n">Next</a><a>Menu</a></header>'
    rows = [(1, inside), (2, '<nav><a href="/x">Xy</a></nav>'), (3, None), (4, "")]
    got = [tuple(r) for r in pages.sections(spark.createDataFrame(rows, "id int, html string"), "id", "html").orderBy("id", "place").collect()]
    assert got == [(1, 0, "Shop now", "/a"), (1, 1, "About us", "https://e.x/q"), (2, 0, "Xy", "/x")]


def test_opening_hours(spark):
    texts = ["Fr-Mo 9-5pm", '["Mo-Fr 12am-12pm", "junk 10:30-11", "Su off", "Tu"]', '{"dayOfWeek": "https://schema.org/Sun", "openTime": "7"}', "", None, "24/7", "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, h string")
    got = {r.i: None if r.w is None else {d.day: (d.opens, d.closes) for d in r.w if not d.closed} for r in df.select("i", dealers.opening_hours(df.h).alias("w")).collect()}
    nine, noon = ("09:00:00", "17:00:00"), ("00:00:00", "12:00:00")
    assert got == {0: {5: nine, 6: nine, 0: nine, 1: nine}, 1: {1: ("10:30:00", "11:00:00"), 2: noon, 3: noon, 4: noon, 5: noon}, 2: {0: ("07:00:00", None)}, 3: None, 4: None, 5: {}, 6: {}}


def test_escalated(spark):
    asked = [("s", i, label, "http://s.x/home?q") for i, label in enumerate(["Our Team", "team!", "Gone Far", "team", "Gone far", "A", "B"])] + [("empty", 0, "Blog", "http://e.x")]
    found = crawl.escalated(spark.createDataFrame(asked, "site string, place int, label string, start string"), spark.createDataFrame([("s", 0, "http://s.x/the-team"), ("s", 1, "http://s.x/our_team/x"), ("t", 0, "http://e.x/blog"), ("s", 2, None)], "site string, place int, url string"))
    assert [tuple(r) for r in found.orderBy("site", "place").collect()] == [("empty", 0, "http://e.x/blog"), ("s", 0, "http://s.x/our_team/x"), ("s", 1, "http://s.x/the-team"), ("s", 2, "http://s.x/gone-far"), ("s", 3, "http://s.x/team"), ("s", 4, "http://s.x/a")]
