"""Routes and endpoints in scripts of pages."""

from pathlib import Path

from loomwright.sources import routes


def test_routes(spark):
    tags = lambda *srcs: "".join(f"<script defer src='{s}'></script>" for s in srcs)
    many = [f"/p{i}.js" for i in range(14)]
    rows = [
        (1, "https://a.b/x?y", tags(*many, "/layout.js?v=1", "/page/app.css")), (2, "http://c.d", tags("https://cdn.e/app/q.mjs", "/_next/static/chunks/pages/_app.js", "/_next/static/chunks/pages/index.js", "/_next/static/chunks/pages/blog/[...slug].js") + '<a x="/_next/static/B1/_buildManifest.js">'),
        (3, None, "x"), (4, "no scheme", tags("/a.js")), (5, "http://c.d/", None), (6, "http://c.d/", '<script id="__NEXT_DATA__">{"page": "/404", "props": {"link": "/l", "name": "/n", "route": "r"}}</script>'), (7, "http://c.d/", '<script id="__NEXT_DATA__">{broken</script>'),
    ]
    scripts = [(f"https://a.b/p{i}.js", f"['/r{i}', \"/r{i}\"]") for i in range(14)] + [("https://a.b/layout.js?v=1", "go('/top')"), ("https://cdn.e/app/q.mjs", "x('/from-cdn', '/pic.png', '/UPPER0123456789ABC')"), ("http://c.d/_next/static/B1/_ssgManifest.js", 'new Set(["/blog/[slug]", "/_skip", "/doc.pdf", "no"])'), ("https://a.b/p0.js", "['/r0']"), ("https://a.b/p1.js", None)]
    got = {(r.id, r.route) for r in routes.routes(spark.createDataFrame(rows, "id int, url string, html string"), spark.createDataFrame(scripts, "url string, body string"), "id", "url", "html").collect()}
    top = {(1, "https://a.b/top")} | {(1, f"https://a.b/r{i}") for i in range(11)}
    assert got == top | {(2, "http://c.d/blog/:param"), (2, "http://c.d/from-cdn"), (2, "http://c.d/blog/[slug]"), (6, "http://c.d/l")}


def test_routes_by_hand(spark):
    """Paths of one script and of several, dealt over pieces, and sites that change a path's normal form."""
    tags = lambda *srcs: "".join(f"<script src='{s}'></script>" for s in srcs)
    props = lambda p: '<script id="__NEXT_DATA__">{"page": "' + p + '"}</script>'
    build = '<a x="/_next/static/B/_buildManifest.js">'
    rows = [(1, "http://a.b/", tags("/one.js", "/two.js") + props("/own")), (1, "http://a.b/x", tags("/one.js")), (2, "http://u&ref=1/", tags("http://a.b/one.js")), (3, "http://h:", tags("http://a.b/two.js")), (4, "http://a.b/", tags("/_next/static/B/_ssgManifest.js") + build)]
    scripts = [("http://a.b/one.js", "'/own','/both','/x0','/x1','/x2','/x3','/x4','/x5'"), ("http://a.b/two.js", "'/both','/y'"), ("http://a.b/two.js", "'/y','/z'"), ("http://a.b/_next/static/B/_ssgManifest.js", "'/','/m?ref=2','/m','/n?q=1','/plain'")]
    for piece in (1, 2, 500):
        df = routes.routes(spark.createDataFrame(rows, "id int, url string, html string"), spark.createDataFrame(scripts, "url string, body string"), "id", "url", "html", piece)
        got = sorted(tuple(r) for r in df.collect())
        xs = [f"/x{i}" for i in range(6)]
        want = [(1, "http://a.b" + p) for p in ["/own", "/both", "/y", "/z", *xs]] + [(2, "http://u")] + [(3, "http://h:" + p) for p in ("/both", "/y", "/z")] + [(4, "http://a.b" + p) for p in ("/m", "/n?q=1", "/plain")]
        assert got == sorted(want)


def test_routes_are_not_shuffled(spark):
    """A path that one script alone names goes from the join to the result."""
    pages = spark.createDataFrame([(1, "http://a.b/", "<script src='/one.js'></script>")], "id int, url string, html string")
    df = routes.routes(pages, spark.createDataFrame([("http://a.b/one.js", "'/x'")], "url string, body string"), "id", "url", "html")
    assert df._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_routes_in_groups_and_bands(spark):
    """Every page that asks for a script gets each of its paths once, whatever the sizes of pieces, groups and bands; null ids too."""
    site = lambda i: f"http://s{i % 7}.b"
    pages = [(i if i % 10 else None, site(i) + f"/{i}", f"<script src='http://cdn.e/{i % 3}.js'></script>") for i in range(60)]
    paths = {k: [f"/k{k}-{j}" for j in range(20 * k + 1)] + ["/all"] for k in range(3)}
    scripts = [(f"http://cdn.e/{k}.js", str(x)) for k, x in paths.items()]
    want = sorted({(i if i % 10 else None, site(i) + p) for i in range(60) for p in paths[i % 3]}, key=str)
    for piece, group, band, least in ((500, 1000, 4000, 500), (3, 2, 1, 1), (7, 1, 10, 2), (1, 5, 30, 1)):
        df = routes.routes(spark.createDataFrame(pages, "id int, url string, html string"), spark.createDataFrame(scripts, "url string, body string"), "id", "url", "html", piece, group, band, least)
        assert sorted((tuple(r) for r in df.collect()), key=str) == want


def test_routes_take_little_room(spark, tmp_path):
    """Routes that many pages of many sites share stand in a file once, not once a page."""
    pages = spark.range(1200).selectExpr("id", "concat('http://a-shop-of-', id % 60, '.example.com/', id) AS url", "'<script src=\"http://cdn.e/all.js\"></script>' AS html")
    paths = "".join(f"'/size-{j % 50}/part_{j}'," for j in range(4000))
    df = routes.routes(pages, spark.createDataFrame([("http://cdn.e/all.js", paths)], "url string, body string"), "id", "url", "html")
    df.write.parquet(out := str(tmp_path / "routes"))
    assert spark.read.parquet(out).count() == 1200 * 4000
    assert sum(f.stat().st_size for f in Path(out).glob("*.parquet")) < 2 * 1200 * 4000


def test_endpoints(spark):
    html = """<div data-url='list.json' data-x="/api"></div><script>$.get("/ajax/a"); prefetch("/no"); axios('https://x.y/z'); fetch("/api/log")</script>"""
    pages = [(1, "http://a.b/p/q", html + '<script src="/index.js"></script><script src="/app/main.js"></script><script src="/other.js"></script><script src="/index.js"></script>'), (2, "http://a.b/", None), (3, None, html), (4, "http://a.b/", "")]
    scripts = [("http://a.b/index.js", "f('gigs')"), ("http://a.b/app/main.js", "f('/users/1','/users/a b','catalog','catalog',{ Url : 'https://k.l/m'}); 'https://s.fly.dev/apix'"), ("http://a.b/other.js", "'courses'"), ("http://a.b/index.js", "f('gigs')")]
    got = {}
    for r in routes.endpoints(spark.createDataFrame(pages, "id int, url string, html string"), spark.createDataFrame(scripts, "url string, body string"), "id", "url", "html").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.endpoint)
    own = ["http://a.b/ajax/a", "http://a.b/list.json", "https://x.y/z"]
    main = ["https://s.fly.dev/api/users/1", "http://a.b/users/1", "https://s.fly.dev/api/catalog", "http://a.b/api/catalog", "https://k.l/m", "https://s.fly.dev/api/gigs", "http://a.b/api/gigs"]
    assert got == {1: own + main}
