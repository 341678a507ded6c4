"""Constraints, routing, references, concepts, links and change actions on small tables."""

from datetime import datetime

from pyspark.sql import functions as F

from loomwright.functions import concepts
from loomwright.operators import changes, constraints, entities, references, rerank, routing
from loomwright.sources import pages
from loomwright.streaming import sessions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_strict_and_lenient_constraints(spark):
    df = spark.createDataFrame([("a", "$90", "4.5", "In Stock", True), ("b", None, None, None, True), ("c", "1,200 USD", "3", "sold", True), ("d", "80", "5", "", False), ("e", "call us", "4", "available", None)], "id string, price string, rating string, availability string, still_listed boolean")
    ids = lambda x: [r.id for r in x.collect()]
    assert sorted(ids(constraints.strict(df, max_price=100))) == ["a", "d"]
    assert sorted(ids(constraints.lenient(df, max_price=100))) == ["a", "b", "d", "e"]
    assert sorted(ids(constraints.strict(df, min_rating=4, in_stock=True))) == ["a", "e"]
    assert ids(constraints.sorted_strict(df, "cheapest", "id")) == ["d", "a", "c", "b", "e"]
    assert ids(constraints.sorted_strict(df, "most_expensive", "id")) == ["c", "a", "d", "b", "e"]
    assert ids(constraints.sorted_lenient(df, "expensive", "id")) == ["c", "a", "d", "b", "e"]
    assert ids(constraints.sorted_lenient(df, "best_rated", "id")) == ["d", "a", "e", "c", "b"]
    assert constraints.unmet(df, constraints.strict(df, max_price=1)).count() == 1
    assert constraints.unmet(df, df).count() == 0 and constraints.unmet(df.limit(0), df.limit(0)).count() == 0


def test_large_prices_keep_their_size(spark):
    df = spark.createDataFrame([(1, 2.5e7)], "id int, price double")
    assert constraints.strict(df, min_price=1e7).count() == 1


STOCK = [
    ("1", "Jeep", "Wrangler", "SUV", "used", 2022, 30000.0), ("2", "Jeep", "Grand Cherokee", "SUV", "new", 2024, 50000.0), ("3", "Ford", "F-150", "Truck", "used", 2024, 40000.0),
    ("4", "Ford", "Escape", "SUV", "new", None, None), ("5", "Ford", "Explorer", "SUV", "used", 2021, 28000.0), ("6", "Ram", "1500", "Truck", "new", 2023, 45000.0),
]


def test_vehicle_queries_find_only_what_is_asked(spark):
    stock = spark.createDataFrame([(i, "w", "Untitled", make, model, None, None, body, cond, year, price, 10.0, True, datetime(2024, 1, int(i))) for i, make, model, body, cond, year, price in STOCK], "id string, widget_id string, title string, make string, model string, trim string, category string, body_style string, condition string, year int, price double, mileage double, still_listed boolean, created_at timestamp")
    docs = spark.createDataFrame([("w", "d1", "Opening hours", "we open at nine")], "widget_id string, id string, title string, content string")
    now = F.lit("2024-02-01").cast("timestamp")
    ask = lambda text, asked, kind="catalog", tenants=("w",), **more: routing.routed(docs, stock, list(tenants), rerank.Intent(text, kind, text.split(), entity_type="vehicle" if asked else None), asked, now, **more)
    found = lambda df: sorted(r.id for r in df.collect())
    assert found(ask("2024 Jeep Wrangler", {"make": "Jeep", "model": "Wrangler", "min_year": 2024, "max_year": 2024})) == []
    assert found(ask("used trucks", {"condition": "used", "body_style": "Truck"})) == ["3"]
    assert found(ask("Ford SUVs", {"make": "Ford", "body_style": "SUV"})) == ["4", "5"]
    assert rows(ask("2024 Ford F-150", {"make": "Ford", "model": "F-150", "min_year": 2024, "max_year": 2024})) == [("3", "2024 Ford F-150", "vehicles")]
    assert rows(ask("opening hours", {})) == [("d1", "Opening hours", "retrieval")]
    assert found(ask("anything", {}, tenants=("other",))) == []
    broad = routing.routed(docs.limit(0), stock, ["w"], rerank.Intent("what is there", "catalog"), {}, now, limit=2)
    assert found(broad) == ["5", "6"]
    assert found(routing.routed(docs.limit(0), stock, ["w"], rerank.Intent("compare", "comparison"), {}, now)) == []
    assert found(routing.routed(docs.limit(0), stock, ["w"], rerank.Intent("what is there", "catalog"), {}, now, informational=True)) == []


def test_turns_refer_to_lists_and_pinned_titles(spark):
    talk = [(1, 1, "show me cars", None, None), (1, 2, None, ["Alpha", "Beta", "Gamma"], None), (1, 3, "the SECOND one", None, None), (1, 4, "the fifth", None, None), (1, 5, "is it red", None, None), (1, 6, "ok", [], "Beta"), (1, 7, "how much?", None, None), (1, 8, "red ones", None, None), (2, 1, "open it", None, None), (2, 2, "price", None, None)]
    df = spark.createDataFrame(talk, "conv int, turn int, text string, shown array<string>, pinned string")
    got = {(r.conv, r.turn): (r.refers, r.entity, r.rewritten) for r in references.resolved(df, "conv", "turn", "text", "shown", "pinned").collect()}
    assert got[1, 1] == (False, None, None) and got[1, 8] == (False, None, None)
    assert got[1, 3] == (True, "Beta", "Beta details") and got[1, 4] == (True, "Gamma", "Gamma details")
    assert got[1, 5] == (True, "Alpha", "Alpha is it red") and got[1, 7] == (True, "Beta", "price of Beta")
    assert got[2, 1] == (True, None, None) and got[2, 2] == (False, None, None)


def test_session_context_starts_anew_when_idle(spark):
    df = spark.createDataFrame([("s", 0, 1, "a"), ("s", 60, 2, None), ("s", 60 + 1800, 3, None), ("s", 60 + 3601, 4, None)], "s string, t long, n int, f string").withColumn("t", F.timestamp_seconds("t"))
    assert rows(references.session_context(df, "s", "t", "n", ["f"]).select("n", "turn_count", "f")) == [(1, 1, "a"), (2, 2, "a"), (3, 3, "a"), (4, 1, None)]


def test_concepts(spark):
    terms = {"About Us": "about", "abot": "about", "our terms": "policy", "FAQ's": "faq", "Q&A": "faq", "prices": "pricing", "carers": "careers", "xyz": None, "": None, "documentaton": "docs"}
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", concepts.concept_of(F.col("t")).alias("c")).collect()}
    assert got == terms
    pairs = [("prices", "rates", True), ("faqs", "common questions", True), ("privacy", "gdpr", True), ("blog", "jobs", False), ("zebra", "zebra", True), ("", "", False), ("terms", "legal", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", concepts.related(F.col("a"), F.col("b")).alias("got")).collect())


def test_links_of_all_kinds(spark):
    html = """<a href="/a/">x</a><a href='b.html'>y</a><a href="../c?utm_source=q">z</a><a href="#top">t</a><a href="mailto:m@x.org">m</a><div data-link="/d" data-path='/e'></div><form action="/f"></form>
    <router-link to="/g"></router-link><script>router.push("/h"); location.href = "/i"; navigate('/j')</script><a href="https://other.org/k">o</a><a href="//x.org/l">p</a><a href="/pic.png">q</a><a href="?p=2">r</a><a href="./m">s</a>"""
    df = spark.createDataFrame([(1, "https://x.org/s/t/u", html), (2, "https://x.org", None)], "id int, url string, html string")
    got = rows(pages.links(df, "id", "url", "html", own=True))
    want = {"/a", "/s/t/b.html", "/s/c", "/d", "/e", "/f", "/g", "/h", "/i", "/j", "/l", "/s/t/u", "/s/t/u?p=2", "/s/t/m"}
    assert {link.removeprefix("https://x.org") for i, link in got if i == 1} == want
    assert [link for i, link in got if i == 2] == ["https://x.org"]


def test_srcset(spark):
    got = spark.createDataFrame([("a.jpg 320w, b.jpg 2x, c.jpg 1200w, d.jpg",), ("",)], "s string").select(pages.srcset(F.col("s")).alias("u")).collect()
    assert [r.u for r in got] == [["b.jpg", "c.jpg", "d.jpg", "a.jpg"], []]


def test_entities_and_facets(spark):
    df = spark.createDataFrame([(1, "blog", "Crawl", "t1", "Good Thing", "x"), (2, "page", "feed", "t2", "Request Rejected", "y"), (3, None, "feed", "t1", None, None), (4, "products", "shop", "t1", "Ford", "z")], "id int, entity_type string, source string, tier string, title string, content string")
    ids = lambda **k: [r.id for r in entities.viewed(df, **k).orderBy("id").collect()]
    assert ids() == [1, 2, 3, 4] and ids(tab="entities") == [1, 4] and ids(tab="pages") == [2, 3]
    assert ids(kind="article") == [1] and ids(kind="product") == [4] and ids(source="FEED", tier="t1") == [3] and ids(search=" thing x") == [1]
    assert [r.id for r in df.where(entities.is_artifact("title", "content")).collect()] == [2]


def test_backfill_deletes_and_jobs(spark):
    rows_ = spark.createDataFrame([("1", "w", '{"shopifyId": 7}'), ("2", "w", '{"shopifyId": "8"}'), ("3", "v", '{"shopifyId": 7}'), ("4", "w", None)], "id string, tenant string, m string").withColumn("m", F.parse_json("m"))
    assert rows(changes.without_member(rows_, "tenant", ["w"], "m", "$.shopifyId", "7").select("id")) == [("2",), ("3",), ("4",)]
    table = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, owner int")
    gone = spark.createDataFrame([(10,), (10,), (None,)], "k int")
    assert rows(changes.cascaded(table, gone, "owner", "k").select("id")) == [(2,), (3,)]
    assert changes.cascaded(table.limit(0), gone, "owner", "k").count() == 0


def test_watchdogs(spark):
    at = lambda call, s, kind: (call, s, kind)
    events = [at("a", 0, "start"), at("a", 15, "speech"), at("a", 100, "end"), at("b", 0, "start"), at("b", 16, "speech"), at("b", 30, "end"), at("c", 0, "start"), at("c", 5, "speech"), at("c", 700, "end"), at("d", 0, "start"), at("d", 3, "note"), at("e", 9, "end")]
    df = spark.createDataFrame(events, "call string, s long, kind string").select("call", F.timestamp_seconds("s").alias("ts"), "kind")
    assert rows(sessions.watched_calls(df, "call", "ts", "kind")) == [("a", 100.0, "hangup"), ("b", 15.0, "initial_silence_timeout"), ("c", 600.0, "max_duration_cap"), ("d", None, None)]


def test_models_and_greetings(spark):
    from loomwright.functions import intent

    asked = {
        "Grand Cherokee or cherokee": ("Jeep", "Grand Cherokee"), "toyota mustang mach-e": ("Toyota", "Mustang Mach-E"), "an F150?": ("Ford", "F-150"), "f-150s": (None, None), "wranglers": (None, None), "the ioniq 5": ("Hyundai", "Ioniq 5"),
        "lincoln": ("Lincoln", None), "": (None, None), None: (None, None), "grand\tcherokee": ("Jeep", "Cherokee"), "cx-5 and cx-50": ("Mazda", "CX-50"),
    }
    got = intent.understood(spark.createDataFrame([(a,) for a in asked], "q string"), "q").collect()
    assert {r.q: (r.intent.make, r.intent.model) for r in got} == asked
    said = {"hi": True, "Hello there!": True, "good morning team.": True, "goodevening": True, "good": False, "hi you": False, "hello there all": False, "help!!": True, "": False, "  hey  ": True}
    got = intent.understood(spark.createDataFrame([(a,) for a in said], "q string"), "q").collect()
    assert {r.q: r.intent.kind == "greeting" for r in got} == said
    new = {"what's new": None, "what is new here": None, "new cars": "new", "what's a new car": "new"}
    got = intent.understood(spark.createDataFrame([(a,) for a in new], "q string"), "q").collect()
    assert {r.q: r.intent.condition for r in got} == new
