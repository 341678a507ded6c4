from datetime import datetime

from pyspark.sql import functions as F

from loomwright.functions import freshness, numbers, text, urls
from loomwright.operators import changes, inventory, keyed, merging, rerank
from loomwright.sources import feeds, pages
from loomwright.streaming import sessions


def one(spark, column, **values):
    row = spark.createDataFrame([values]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_number_variants_differ(spark):
    offer = F.lit("$90/mo for 12")
    assert [one(spark, f(offer)) for f in (numbers.digits_and_dots, numbers.with_thousands, numbers.first_number)] == [9012.0, None, 90.0]
    assert [one(spark, f(F.lit("30k"))) for f in (numbers.digits_and_dots, numbers.with_thousands, numbers.first_number)] == [30.0, 30000.0, 30.0]
    assert one(spark, numbers.half_up(F.lit(-2.5))) == -2


def test_text(spark):
    assert one(spark, text.normalize(F.lit("  Héllo, World-wide! "))) == "h llo world-wide"
    assert one(spark, text.fold(F.lit("Élan Vital-x"))) == "elan vital x"
    assert one(spark, text.content_hash(F.lit("<a> <b>  x"))) == one(spark, text.content_hash(F.lit("<a><b> x")))
    assert one(spark, text.strip_tags(F.lit("<p>a &amp;lt; b</p><script>x</script>"))) == "a < b"
    assert one(spark, text.fuzzy_word(F.lit("leetcode"), F.lit("letcode")))


def test_urls(spark):
    assert one(spark, urls.without_tracking(F.lit("http://a.b/c/?utm_source=x&q=1&gclid=2#top"))) == "http://a.b/c/?q=1"
    assert one(spark, urls.host_and_path(F.lit("HTTP://A.b/C/?q"))) == "a.b/c"
    assert one(spark, urls.is_safe(F.lit("https://shop.example.com/x")))
    assert not any(one(spark, urls.is_safe(F.lit(u))) for u in ("javascript:x", "http://10.0.0.1/", "http://me@host.com/", "//a.b"))
    assert not one(spark, urls.is_page(F.lit("http://a.b/c.JPG?x=1")))


def test_freshness_bounds(spark):
    as_of = F.lit(datetime(2024, 1, 10))
    ago = lambda h: (as_of - F.expr(f"INTERVAL {h} HOURS"))
    status = lambda h, source, listed=True: one(spark, freshness.freshness(ago(h), F.lit(listed), F.lit(source), as_of))
    assert [status(h, "crawl") for h in (2, 6, 24, 25)] == ["fresh", "recent", "recent", freshness.STALE]
    assert [status(h, "feed") for h in (24, 72, 73)] == ["fresh", "recent", freshness.STALE]
    assert status(1, "feed", False) == freshness.STALE and status(-5, "crawl") == "fresh"
    never = F.lit(None).cast("timestamp")
    assert [one(spark, freshness.freshness(never, F.lit(x), F.lit("feed"), as_of)) for x in (None, True, False)] == ["fresh", "fresh", freshness.STALE]
    assert one(spark, freshness.freshness(ago(30), F.lit(True), F.lit(None).cast("string"), as_of, F.lit("connector"))) == "recent"
    assert one(spark, freshness.due_for_sync(F.lit("daily"), F.lit(None).cast("timestamp"), as_of))
    assert not one(spark, freshness.due_for_sync(F.lit("manual"), ago(9999), as_of))


def test_incremental_crawl(spark):
    old = spark.range(250).select(F.col("id").cast("string").alias("url"), F.lit("h").alias("hash"))
    new = old.where("cast(url as int) < 248").withColumn("hash", F.when(F.col("url").cast("int") < 5, "changed").otherwise(F.col("hash"))).union(spark.createDataFrame([("n1", "h"), ("n2", "h")], "url string, hash string"))
    got = {r["action"]: r["count"] for r in changes.actions(old, new, "url", "hash").groupBy("action").count().collect()}
    assert got == {"touch": 243, "update": 5, "unlist": 2, "insert": 2}


def test_reconcile_and_upsert(spark):
    rows = spark.createDataFrame([(1, "v1", None, True, "in_stock"), (2, None, "s2", True, "in_stock"), (3, "v3", "s3", True, "in_stock")], "id int, vin string, stock string, still_listed boolean, availability string")
    seen = spark.createDataFrame([("v1", None), (None, "s2")], "vin string, stock string")
    got = {r.id: (r.still_listed, r.availability) for r in changes.reconcile(rows, seen, ["vin", "stock"]).collect()}
    assert got == {1: (True, "in_stock"), 2: (True, "in_stock"), 3: (False, "out_of_stock")}
    after = changes.upsert(rows, spark.createDataFrame([(3, "new"), (4, "v4")], "id int, vin string"), "id")
    assert {r.id: r.vin for r in after.collect()} == {1: "v1", 2: None, 3: "new", 4: "v4"}


def test_identity_order(spark):
    old = spark.createDataFrame([(1, "v", None), (2, None, "s"), (3, None, "s")], "id int, vin string, stock string")
    new = spark.createDataFrame([("a", "v", "s"), ("b", "x", "s"), ("c", None, None)], "k string, vin string, stock string")
    assert {r.k: r.matched for r in keyed.identified(new, old, ["vin", "stock"], "id").collect()} == {"a": 1, "b": 2, "c": None}


def test_scope_fails_closed(spark):
    assert inventory.scoped(spark.range(3).withColumn("widget_id", F.lit("w")), []).count() == 0


def test_delivered_rows_are_only_filled(spark):
    kind = "struct<title:string,price:double,source:string,metadata:map<string,string>>"
    pairs = spark.createDataFrame([((("A", None, "shopify", {"x": "1"})), ("B", 5.0, "crawl", {"x": "2", "y": "3"})), (("A", 1.0, "crawl", {"x": "1"}), ("B", None, "crawl", {"x": "2"}))], f"old {kind}, new {kind}")
    got = [tuple(r) for r in merging.merged(pairs, ["title", "price"]).collect()]
    assert got == [("A", 5.0, "shopify", {"x": "1", "y": "3"}), ("B", 1.0, "crawl", {"x": "2"})]


def test_rerank(spark):
    rows = spark.createDataFrame([("1", "Leetcode Mastery", 50.0, 0.1), ("2", "Python Basics", 20.0, 0.5), ("3", "Leetcode Mastery!", 60.0, 0.2), ("4", "Gardening", 5.0, 0.0)], "id string, title string, price double, similarity double")
    assert [r.id for r in rerank.rerank(rows, rerank.Intent("leetcode mastery")).collect()][0] in ("1", "3")
    assert [r.id for r in rerank.rerank(rows, rerank.Intent("letcode mastry")).collect()][0] in ("1", "3")
    assert rerank.rerank(rows, rerank.Intent("quantum cooking")).where("id = '4'").count() == 0
    cheap = rerank.rerank(rows, rerank.Intent("leetcode", max_price=55.0)).collect()
    assert cheap[0].id == "1" and "3" not in [r.id for r in cheap]


def test_feeds(spark):
    bodies = spark.createDataFrame([(1, '{"items":[{"sku":"a","name":"Ann","price":"€1,234.50","colour":"red"}]}')], "id int, body string")
    row = feeds.mapped(feeds.json_items(bodies, "id", "body"), "id").first()
    assert (row.external_id, row.title, row.price, row.currency, row.extra) == ("a", "Ann", 1234.5, "EUR", {"colour": "red"})
    xml = spark.createDataFrame([(1, "<rss><item><g:id>7</g:id><title><![CDATA[A & B]]></title><g:price>12.00 USD</g:price></item></rss>")], "id int, body string")
    row = feeds.mapped(feeds.xml_items(xml, "id", "body"), "id").first()
    assert (row.external_id, row.title, row.price) == ("7", "A & B", 12.0)


def test_pages(spark):
    html = '<html><script type="application/ld+json">{"@graph":[{"@type":"Vehicle","name":"Jeep","vehicleIdentificationNumber":"V1","offers":{"price":"100.5"}}]}</script><a href="/x?utm_source=a">x</a><a href="http://other/">y</a><a href="/i.png">z</a></html>'
    df = spark.createDataFrame([(1, "http://h.com/p", html)], "id int, url string, html string")
    car = pages.vehicles(pages.json_ld(df, "id", "html")).first()
    assert (car.title, car.vin, car.price) == ("Jeep", "V1", 100.5)
    assert [r.link for r in pages.links(df, "id", "url", "html").collect()] == ["http://h.com/x"]
    assert one(spark, pages.is_blocked(F.lit(200), F.lit("Access denied")))


def test_sliding_window_forgets_refused_events():
    assert sessions.sliding([0, 1, 2, 3, 61.5], [], 2, 60)[0] == [True, True, False, False, True]
    assert sessions.fixed([0, 1, 2, 61], (0, 0.0), 2, 60)[0] == [True, True, False, True]


def test_stream_as_batch(spark, tmp_path):
    rows = [(1, i, datetime(2024, 1, 1, 0, 0, i)) for i in range(5)] + [(2, 9, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "user long, id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = sessions.rate_limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "ts", "id", 3, 60.0)
    q = stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.user, r.id, r.allowed) for r in sessions.rate_limited(df, "user", "ts", "id", 3, 60.0).collect()}
    assert {tuple(r) for r in spark.table("limits").collect()} == want


def test_changes_sink(spark, tmp_path):
    write = sessions.apply_changes(str(tmp_path / "t"), "id", "at")
    write(spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False)], "id int, v string, at int, deleted boolean"), 0)
    change = spark.createDataFrame([(1, None, 3, True), (3, "d", 3, False)], "id int, v string, at int, deleted boolean")
    write(change, 1)
    write(change, 1)
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()} == {(2, "c"), (3, "d")}


def test_exact_title_stands_alone_and_empty_titles_fall(spark):
    rows = [("1", "Alpha Course"), ("2", "alpha  course!"), ("3", "Alpha Course Two"), ("4", "!!!"), ("5", None)]
    df = spark.createDataFrame(rows, "id string, title string")
    ids = lambda asked: [r.id for r in rerank.rerank(df, rerank.Intent(asked, "catalog"), 5, -10_000).collect()]
    assert ids("alpha course") == ["1"]
    assert sorted(ids("beta")) == ["1", "3"]


def test_lookups_containment_ordinals_and_turn_caps(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, tenant int")
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "id string, tenant int")
    assert {(r.id, r.tenant): r.status for r in inventory.looked_up(asked, rows, "id", "tenant").collect()} == {("a", 1): "own", ("a", 2): "foreign", ("c", 1): "absent"}
    tenants = spark.createDataFrame([("u1", "w1", None), ("u2", "w2", "s2")], "id string, widget_id string, website_id string")
    assert {r.id for r in inventory.tenant_ids(tenants, "s2", ["id", "widget_id", "website_id"]).collect()} == {"u2", "w2", "s2"}
    arrays = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, None), (4, [])], "id int, a array<string>")
    assert [r.id for r in inventory.with_all(arrays, "a", ["x", "y"]).collect()] == [1] and inventory.with_all(arrays, "a", []).count() == 4
    turns = spark.createDataFrame([(" S ", 1), ("s", 2), ("S", 3), (None, 4), ("", 5)], "s string, t int")
    assert {r.t: (r.current_turn, r.allowed) for r in sessions.turn_capped(turns, "s", "t", 2).collect()} == {1: (1, True), 2: (2, True), 3: (2, False), 4: (1, True), 5: (1, True)}
    assert [r.t for r in keyed.nth(turns.where("s is not null").withColumn("s", F.lit("k")), "s", "t", -2).collect()] == [3]
