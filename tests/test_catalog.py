import base64
import hashlib
import hmac
from datetime import datetime

from pyspark.sql import functions as F

from loomwright.functions import intent, vehicles
from loomwright.operators import crawl, rerank, retrieval
from loomwright.sources import network, pages


def asked(spark, *texts):
    return [r.intent for r in intent.understood(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, q string"), "q").orderBy("id").collect()]


def test_understood(spark):
    a, b, c, d, e, f = asked(spark, "used SUV under $30k", "between 5,000 and 2,000 newest Jeep 2024", "compare Alpha and Beta", "hello there!", "python course not beginner, at least 4 stars", None)
    assert (a.kind, a.condition, a.body_style, a.entity_type, a.max_price, a.min_price) == ("catalog", "used", "SUV", "vehicle", 30000.0, None)
    assert (b.min_price, b.max_price, b.sort, b.make, b.year) == (2000.0, 5000.0, "newest", "Jeep", 2024)
    assert (c.kind, c.compared) == ("comparison", ["Alpha", "Beta"])
    assert d.kind == "greeting"
    assert (e.negative, e.keywords, e.min_rating) == (["beginner"], ["python"], 4.0)
    assert (f.kind, f.keywords, f.max_price) == ("general", [], None)


def test_vehicles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    none = F.lit(None).cast("string")
    assert one(vehicles.drivetrain(none, F.lit("Jeep AWD"), none)) == "AWD"
    assert one(vehicles.fuel(F.lit("water"), none, none)) == "water"
    assert one(vehicles.condition(none, F.lit("http://a/new-vehicles/1"), none)) == "new"
    assert one(vehicles.ranked_images(F.array(F.lit("a_thumb.jpg"), F.lit("b.jpg"), F.lit("b.jpg")))) == ["b.jpg", "a_thumb.jpg"]
    hours = one(vehicles.opening_hours(F.array(F.lit("Mo-Fr 9am-5:30 PM"), F.lit("Sa Closed"), F.lit("Fr 10:00-12:00"))))
    assert [(h.day, h.opens, h.closes, h.closed) for h in hours][1] == (1, "09:00:00", "17:30:00", False)
    assert (hours[0].closed, hours[5].opens, hours[6].closed) == (True, "10:00:00", True)
    same = lambda **x: one(vehicles.fingerprint({k: F.lit(v) for k, v in x.items()}))
    assert same(vin=" v1 ", price=10.4) == same(vin="V1", price=10.0) != same(vin="V1", price=11.0)


def test_network(spark):
    rows = [(1, "p", "http://api/x", 200, '{"vehicles":[{"vehicleTitle":"Jeep","vin":"1"},{"vehicleTitle":"jeep","vin":"2"},{"name":"menu","id":1},{"name":"bare"}]}'), (2, "p", "http://mixpanel.com/", 200, '[{"name":"Spy","id":1}]'), (3, "p", "http://api/y", 500, '[{"name":"Err","id":1}]'), (4, "p", "http://api/z", None, '{"year":"2024","make":"Ford","model":"F-150","price":5}'), (5, "p", "http://api/w", 200, "{broken")]
    df = spark.createDataFrame(rows, "n int, page string, url string, status int, body string")
    got = {(r.title, r.raw.get("vin")) for r in network.items(df, "page", "url", "status", "body", "n").collect()}
    assert got == {("Jeep", "1"), ("2024 Ford F-150", None)}


def test_signatures(spark):
    key = b"k" * 70
    good = base64.b64encode(hmac.new(key, "bödy".encode(), hashlib.sha256).digest()).decode()
    df = spark.createDataFrame([(1, "bödy", good), (2, "other", good), (3, "bödy", None)], "id int, body string, sig string")
    assert [r.id for r in network.verified(df, "body", "sig", key).collect()] == [1]


def test_shop_products(spark):
    body = '{"products":[{"id":1,"title":"A","variants":[{"price":"0","available":false},{"price":"9.5","available":true}]}]}'
    row = network.shop_products(spark.createDataFrame([("s", body)], "site string, body string"), "site", "body").first()
    assert (row.title, row.price, row.available) == ("A", 9.5, True)


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "e")], "url string, link string")
    seeds = spark.createDataFrame([("s", "a")], "site string, url string")
    assert {(r.url, r.depth) for r in crawl.frontier(seeds, links).collect()} == {("a", 0), ("b", 1), ("e", 1), ("c", 2)}
    assert {r.url for r in crawl.frontier(seeds, links, cap=2).collect()} == {"a", "b"}


def test_coverage(spark):
    urls = spark.createDataFrame([("s", "http://h/new-vehicles/1"), ("s", "http://h/used/2"), ("s", "http://h/about")], "site string, url string")
    row = crawl.coverage(urls, "site", "url").first()
    assert (row.urls, row.new_routes, row.used_routes, row.cpo_routes) == (3, 1, 1, 0)
    sections = spark.createDataFrame([("s", "About", None), ("s", "Courses", "/courses")], "site string, label string, href string")
    assert [r.label for r in crawl.missing_sections(sections, urls).collect()] == ["Courses"]
    d = spark.createDataFrame([("s", 0, "seed", "ok"), ("s", 1, "frontier_bfs", "error")], "site string, depth int, discovery_source string, crawl_status string")
    row = crawl.breakdown(d, "site").first()
    assert (row.pages, row.dynamic, row.failed, row.by_depth) == (2, 1, 1, {0: 1, 1: 1})


def test_paired(spark):
    new = spark.createDataFrame([(1, "x", "t"), (2, "x", "t"), (3, None, "t"), (4, None, "u")], "i int, sku string, title string")
    old = spark.createDataFrame([(10, "x", "q"), (11, None, "t"), (12, None, "t")], "e int, sku string, title string")
    got = {(r.i, r.e, r.rule) for r in crawl.paired(new, old, [F.col("sku"), F.col("title")], "i", "e").collect()}
    assert got == {(1, 10, 0), (2, 11, 1), (3, 12, 1)}


def test_retrieval(spark):
    seen = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("w", "1", "Leetcode Mastery", "text", [1.0, 0.0], seen), ("w", "2", "Gardening", "text", [0.0, 1.0], seen), ("v", "3", "Leetcode Mastery", "text", [1.0, 0.0], seen)], "widget_id string, id string, title string, content string, embedding array<double>, last_seen timestamp")
    got = retrieval.retrieve(rows.withColumn("freshness", F.lit(None).cast("string")), ["w"], rerank.Intent("leetcode mastery"), F.lit(datetime(2024, 1, 1, 12)), [1.0, 0.0])
    assert [r.id for r in got.collect()] == ["1"]
    row = retrieval.grounded(got).first()
    assert (row.grounded, row.confidence, row.hedge) == (True, "high", "light")
    assert retrieval.grounded(got.limit(0)).first().confidence == "unverified"
    assert retrieval.context(got).first().context == "Leetcode Mastery: text"
    assert retrieval.retrieve(rows, [], rerank.Intent("leetcode"), F.lit(seen)).count() == 0
    scored = spark.createDataFrame([("q", "a", 900), ("q", "b", 850), ("r", "c", 400)], "q string, id string, score int")
    assert [(r.id, r.ambiguous) for r in retrieval.decided(scored, "q", "score", "id").collect()] == [("a", True)]


def test_vector_channel(spark):
    """Only the ten rows most like the query, above the least similarity, have one: a row that points away is no worse than one without a vector."""
    vectors = {"away": [-1.0, 0.0], "none": None, "near": [1.0, 0.0], "weak": [0.2, 1.0], **{f"n{i:02}": [1.0, 0.05 * (i + 1)] for i in range(12)}}
    rows = spark.createDataFrame([("w", i, f"Lamp {i}", v) for i, v in vectors.items()], "widget_id string, id string, title string, embedding array<double>")
    got = {r.id: r for r in retrieval.retrieve(rows, ["w"], rerank.Intent("lamp", "catalog", ["lamp"]), F.current_timestamp(), [1.0, 0.0], limit=20).collect()}
    assert got["away"].score == got["none"].score == got["weak"].score == got["n11"].score and got["away"].similarity is None
    assert sum(r.similarity is not None for r in got.values()) == 10 and got["near"].score - got["none"].score == 450 + 50


def test_rules_of_pages_and_meanings(spark):
    rows = spark.createDataFrame([
        ("1", "Grokking Interviews", "leetcode drills", None, None), ("2", "Watercolours", "brushes", None, None), ("3", "Shipping FAQ", "answers", "https://s.x/faq", "faq"), ("4", "All Courses", "list", "https://s.x/courses/", None),
        ("5", "Talent pool", "people for hire", None, "service"), ("6", "Privacy terms", "law", "https://s.x/privacy", None), ("7", "Node course", "lessons", None, "course"),
    ], "id string, title string, content string, source_url string, entity_type string")
    reasons = lambda intent: {r.id: r.reasons for r in rerank.rerank(rows, intent, 20, -99999).collect()}
    coding = reasons(rerank.Intent("coding help", "catalog", ["coding"]))
    assert coding["1"].clusters == 240 and coding["1"].missed == 0 and coding["2"].clusters == 0 and coding["2"].missed == -800
    asked = reasons(rerank.Intent("frequently asked", "faq"))
    assert (asked["3"].topic, asked["3"].page, asked["2"].topic) == (150, 350, 0)
    assert reasons(rerank.Intent("find a freelancer", "catalog"))["5"].talent == 120
    broad = reasons(rerank.Intent("what is there", "catalog"))
    assert (broad["7"].broad, broad["7"].page, broad["2"].broad) == (80, 150, 0)
    wanted = reasons(rerank.Intent("node", "specific_entity", ["node"]))
    assert (wanted["4"].page, wanted["6"].page, wanted["7"].page) == (-250, -500, 150)


def test_page_text_is_whole(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(f"<html><body><main><p>{'</p><p>'.join(words)}</p></main></body></html>",)], "html string")
    assert df.select(pages.page_text(F.col("html")).alias("x")).first().x.split() == words
    assert len(df.select(pages.page_text(F.col("html"), 5000).alias("x")).first().x) == 5000
