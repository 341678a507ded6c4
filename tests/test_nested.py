"""Nested values, extraction by schema, sitemaps."""

import json
import random

from pyspark.sql import functions as F

from loomwright.functions import nested
from loomwright.sources import extraction, pages


def tree(rng, depth=0):
    kind = rng.random()
    if depth > 7 or kind < 0.35:
        return rng.choice([None, True, 1, -2, "x", "", 0])
    if kind < 0.5:
        return [tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "c", "apiKey", "Authorization", "password_2", "name"]): tree(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_merged_and_redacted(spark):
    rng = random.Random(2)
    pairs = [({"r": tree(rng)}, {"r": tree(rng), "s": 1}) for _ in range(200)] + [({"a": 1}, None), ({}, {}), ({"a": {"b": [1, 2], "c": 3}}, {"a": {"b": [], "c": None}})]
    df = spark.createDataFrame([(i, json.dumps(a), None if b is None else json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    out = df.select("i", F.to_json(nested.merged(F.parse_json("a"), F.parse_json("b"))).alias("m"), F.to_json(nested.redacted(F.parse_json("a"))).alias("r")).collect()

    def leaves(v, path=()):
        """Paths of a value's leaves; empty objects and lists are leaves."""
        if isinstance(v, dict) and v:
            return {k: x for key, y in v.items() for k, x in leaves(y, (*path, key)).items()}
        return {path: json.dumps(v, sort_keys=True)}

    for r in out:
        a, b = pairs[r.i]
        got = leaves(json.loads(r.m))
        theirs = leaves(b) if b else {}
        for path, value in theirs.items():
            if value != "{}":
                assert got[path] == value
        mine = {p: v for p, v in leaves(a).items() if p and not any(p[:n] in theirs and theirs[p[:n]] != "{}" or any(q[:len(p)] == p for q in theirs) for n in range(1, len(p) + 1))}
        assert all(got[p] == v for p, v in mine.items())
        said = json.loads(r.r)

        def check(v, w, depth=0):
            if depth > 5 or not isinstance(v, (dict, list)):
                assert v == w
            elif isinstance(v, list):
                assert len(v) == len(w)
                for x, y in zip(v, w, strict=True):
                    check(x, y, depth + 1)
            else:
                for k in v:
                    secret = k in ("apiKey", "Authorization", "password_2")
                    assert w[k] == "[REDACTED]" if secret else check(v[k], w[k], depth + 1) is None

        check(a, said)
    assert spark.createDataFrame([(None,)], "a string").select(nested.redacted(F.parse_json("a")).alias("x")).first().x is None


def test_extraction(spark):
    html = '<div class="card big" id="one"><h2>Red <b>lamp</b></h2><a href="/1">go</a><span class="price">$ 12.50 now</span><br><img src="a.png"></div><div class="card"><h2></h2><p>x &amp; y</p></div></section><div class="other card"><h2>Open<script>no</script>'
    schema = {"baseSelector": "div.card", "fields": [{"name": "title", "selector": "h2"}, {"name": "link", "selector": "a", "type": "attribute", "attribute": "href"}, {"name": "price", "selector": "span[class=price]", "type": "regex", "pattern": r"([0-9.]+)"}, {"name": "inner", "selector": "p", "type": "html", "default": "-"}]}
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<div>none</div>")], "id int, html string")
    got = [tuple(r) for r in extraction.extracted(df, "html", schema).drop("html").orderBy("place").collect()]
    assert got == [(1, 0, "Red lamp", "/1", "12.50", "-"), (1, 1, None, None, None, "x &amp; y"), (1, 2, "Open", None, None, "-")]
    nested_ = {"baseSelector": "ul li", "fields": [{"name": "t"}]}
    page = "<ul><li>a<ul><li>b</li></ul></li></ul><li>c</li>"
    assert [r.t for r in extraction.extracted(spark.createDataFrame([(page,)], "html string"), "html", nested_).orderBy("place").collect()] == ["ab", "b"]


def test_sitemaps(spark):
    of = lambda *locs: "<x>" + "".join(f"<loc>{u}</loc>" for u in locs) + "</x>"
    docs = [("http://a.b/s.xml", of("http://a.b/1", "http://a.b/t.xml", "http://a.b/u.xml", "http://z.z/no", "ftp://a.b/x")), ("http://a.b/t.xml", of("http://a.b/s.xml", "http://a.b/2?utm_source=q", "http://a.b/u.xml")), ("http://a.b/u.xml", of("http://a.b/v.xml", "http://a.b/1", "http://a.b/i.png")), ("http://a.b/v.xml", of("http://a.b/w.xml", "http://a.b/3")), ("http://a.b/w.xml", of("http://a.b/4")), ("http://a.b/n.xml", None)]
    roots = spark.createDataFrame([("s", "http://a.b/s.xml"), ("t", "http://a.b/w.xml"), ("t", "http://a.b/gone.xml"), ("n", "http://a.b/n.xml")], "site string, url string")
    got = {(r.site, r.url, r.depth) for r in pages.sitemap_pages(spark.createDataFrame(docs, "url string, body string"), roots, 2).collect()}
    assert got == {("s", "http://a.b/1", 0), ("s", "http://a.b/2", 1), ("s", "http://a.b/3", 2), ("t", "http://a.b/4", 0)}
