"""Registered queries of the engine over the shared tables, and the SQL that gives the same rows.

The tables stand in for the catalog's own: part for inventory, orders of a customer for crawl jobs of a site, documents for knowledge rows,
events for session and usage events, conversations for chat turns, pages for crawled pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import concepts, freshness, intent, nested, numbers, text, urls
from loomwright.operators import aggregates, changes, constraints, crawl, dealers, entities, inventory, keyed, matching, navigation, references, rerank, retrieval, routing, vectors
from loomwright.operators.ordered import spread
from loomwright.sources import cards, extraction, feeds, routes, structured, vehicle_pages
from loomwright.sources import pages as web
from loomwright.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "keyword_score_topk"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part WHERE p_brand = 'Brand#13' AND contains(lower(p_name), 'gear') AND p_size >= 5 AND p_size <= 40 AND p_retailprice <= 1500 ORDER BY p_retailprice, p_partkey LIMIT 50")
def inventory_filter(spark, sf_dir):
    found = inventory.filtered(read(spark, sf_dir, "part"), {"p_brand": "Brand#13"}, {"p_name": "gear"}, {"p_size": (5, 40), "p_retailprice": (None, 1500)})
    return inventory.ordered(found, "price_asc", "p_retailprice", "p_partkey", "p_partkey").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").limit(50)


@query("WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size FROM part) SELECT p_partkey, p_size FROM t WHERE p_size IS NULL OR (p_size >= 10 AND p_size <= 20)")
def inventory_filter_nullpass(spark, sf_dir):
    holes = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"))
    return inventory.filtered(holes, ranges={"p_size": (10, 20)}, lenient=True)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 5)")
def tenant_scan(spark, sf_dir):
    return inventory.scoped(read(spark, sf_dir, "supplier"), [1, 3, 5], "s_nationkey").select("s_suppkey", "s_name")


VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
SIMILARITY = "list_dot_product(embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"


@query(f"WITH q AS (SELECT {VECTOR}::DOUBLE[] AS v) SELECT vec_id, round({SIMILARITY}, 9) AS similarity FROM embeddings, q WHERE {SIMILARITY} > -1 ORDER BY {SIMILARITY} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return vectors.top_k(read(spark, sf_dir, "embeddings"), VECTOR, 10, "embedding", "vec_id").select("vec_id", F.round("similarity", 9).alias("similarity"))


@query(f"WITH q AS (SELECT {VECTOR}::DOUBLE[] AS v) SELECT vec_id, label, round({SIMILARITY}, 9) AS similarity FROM embeddings, q WHERE label IN (2, 5) AND {SIMILARITY} > 0.05 ORDER BY {SIMILARITY} DESC, vec_id LIMIT 10")
def vector_topk_scoped(spark, sf_dir):
    scoped = inventory.scoped(read(spark, sf_dir, "embeddings"), [2, 5], "label")
    return vectors.top_k(scoped, VECTOR, 10, "embedding", "vec_id", 0.05).select("vec_id", "label", F.round("similarity", 9).alias("similarity"))


@query("SELECT doc_id, title, score FROM (SELECT doc_id, title, CASE WHEN contains(title, 'thing') THEN 60 WHEN contains(body, 'thing') THEN 20 ELSE 0 END + CASE WHEN contains(title, 'shed') THEN 60 WHEN contains(body, 'shed') THEN 20 ELSE 0 END AS score FROM (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(text) AS body FROM documents)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def keyword_score_topk(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower(F.substring_index("text", "\n", 1)).alias("title"), F.lower("text").alias("body"))
    score = sum((F.when(F.contains("title", F.lit(k)), 60).when(F.contains("body", F.lit(k)), 20).otherwise(0) for k in ("thing", "shed")), F.lit(0))
    return docs.select("doc_id", "title", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


def ranked_sql(rows: str, query: str, keywords: tuple[str, ...], columns: str, limit: int, most: float | None = None) -> str:
    """SQL of a catalog query's ranking. rows: a SELECT of id, title, category, tags, content, price, similarity, freshness (null where there is none); columns: what is given."""
    plain = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    hit, close = "len(list_filter(tt, lambda x: contains(x, w) OR contains(w, x))) > 0", "len(w) >= 4 AND len(list_filter(tt, lambda x: len(x) >= 4 AND levenshtein(x, w) <= CASE WHEN len(w) >= 6 THEN 2 ELSE 1 END)) > 0"
    word = lambda where, k: f"regexp_matches({where}, '\\b{k}\\b')"
    points = " + ".join(f"CASE WHEN {word('low', k)} THEN 60 WHEN {word('tagged', k)} THEN 45 WHEN {word('corpus', k)} THEN 20 ELSE 0 END" for k in keywords)
    marks = lambda where, words: f"regexp_matches({where}, '\\b({'|'.join(words)})\\b')"
    budget = f"+ CASE WHEN price IS NULL THEN 0 WHEN price <= {most} THEN 80 ELSE -500 END" if most is not None else ""
    return f"""WITH c AS ({rows}), q AS (SELECT {plain(f"'{query}'")} AS q),
n AS (SELECT c.*, q, {plain("coalesce(title, '')")} AS t, lower(coalesce(title, '')) AS low, lower(concat_ws(' ', tags, category)) AS tagged, lower(concat_ws(' ', title, category, tags, content)) AS corpus FROM c, q),
w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: len(x) >= 2) AS tt, list_filter(string_split(q, ' '), lambda x: len(x) >= 2) AS qt FROM n),
f AS (SELECT *, t = q AS exact, t <> q AND len(t) >= 4 AND (contains(q, t) OR contains(t, q)) AS part, len(list_filter(qt, lambda w: NOT ({hit}) AND {close})) AS fuzzy, len(list_filter(qt, lambda w: ({hit}) OR ({close}))) / len(qt) AS overlap, len(t) >= 5 AND levenshtein(t, q) <= 2 AS typo,
 regexp_matches(low, 'terms|privacy|policy|cookie|disclaimer|faq|frequently asked') AS informs, {" + ".join(f"CAST({word('corpus', k)} AS INT)" for k in keywords)} AS hits, {" + ".join(f"CAST({word('low', k)} AS INT)" for k in keywords)} AS title_hits FROM w),
g AS (SELECT *, part OR overlap >= 0.5 OR fuzzy > 0 OR typo AS partly, regexp_matches(low, 'courses\\s*catalog|all\\s*courses|vehicle\\s*inventory|all\\s*inventory') AND NOT informs AS lists, {marks("low", rerank.VEHICLE_MARKS)} AS vehicle, {marks("low || ' ' || lower(coalesce(content, ''))", rerank.COURSE_MARKS)} AS course FROM f),
s AS (SELECT *, CASE WHEN exact THEN 1000 WHEN part AND contains(q, t) THEN 550 WHEN part THEN 500 ELSE 0 END + CASE WHEN overlap >= 0.75 THEN floor(400 * overlap + 0.5) WHEN overlap >= 0.5 THEN floor(250 * overlap + 0.5) ELSE 0 END + 150 * fuzzy + CASE WHEN typo THEN 150 ELSE 0 END
 + coalesce(floor(450 * similarity + 0.5), 0) + {points} + CASE WHEN NOT informs AND NOT lists AND (coalesce(price, 0) <> 0 OR vehicle OR course OR exact) THEN 150 WHEN lists THEN -250 WHEN informs THEN -500 ELSE 0 END
 + 50 * greatest(CAST(exact AS INT) + CAST(partly AS INT) + CAST(similarity IS NOT NULL AS INT) + CAST(hits > 0 AS INT) - 1, 0) + 40 + CASE freshness WHEN 'fresh' THEN 40 WHEN 'recent' THEN 10 WHEN 'stale_or_unlisted' THEN -60 ELSE 0 END + CASE WHEN price IS NOT NULL THEN 30 ELSE 0 END {budget}
 - CASE WHEN NOT (exact OR partly OR coalesce(similarity, 0) >= 0.28) AND (hits = 0 OR ({len(keywords)} >= 2 AND hits < 2 AND title_hits = 0)) THEN 800 ELSE 0 END AS score FROM g),
b AS (SELECT * FROM s WHERE score > 0 AND t <> '' QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, id) = 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM b)
SELECT {columns} FROM (SELECT *, first(exact) OVER (ORDER BY place) AS alone FROM r) WHERE place <= {limit} AND (place = 1 OR NOT alone)"""


@query(ranked_sql("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS category, p_brand AS tags, NULL::VARCHAR AS content, p_retailprice AS price, NULL::DOUBLE AS similarity, NULL::VARCHAR AS freshness FROM part", "hot gear under 1200", ("hot", "gear"), "id, title, price, CAST(score AS BIGINT) AS score", 20, 1200.0))
def rerank_parts(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("tags"))
    intent = rerank.Intent("hot gear under 1200", "catalog", ["hot", "gear"], max_price=1200.0)
    return rerank.rerank(parts, intent, 20).select("id", "title", "price", "score")


@query("SELECT doc_id, title FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS title, row_number() OVER (PARTITION BY trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def title_dedupe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", text.normalize(F.substring_index("text", "\n", 1)).alias("title"))
    return keyed.first_of(docs, F.col("title"), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "title")


@query("SELECT a.s_suppkey AS s_suppkey, a.s_name AS s_name, levenshtein(a.s_name, 'Supplier#000000001') AS distance FROM supplier a WHERE levenshtein(a.s_name, 'Supplier#000000001') <= 2")
def fuzzy_match(spark, sf_dir):
    distance = F.levenshtein("s_name", F.lit("Supplier#000000001"), 2)
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", distance.alias("distance")).where("distance >= 0")


@query("""WITH t AS (SELECT p_partkey, '$' || CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR) || '/mo for ' || p_size AS s FROM part)
SELECT p_partkey, CAST(regexp_replace(s, '[^0-9.]', '', 'g') AS DOUBLE) AS all_digits, CAST(regexp_extract(s, '([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) AS first_number, CAST(NULL AS DOUBLE) AS with_k FROM t""")
def price_parse_variants(spark, sf_dir):
    s = F.concat(F.lit("$"), F.col("p_retailprice").cast("int").cast("string"), F.lit("/mo for "), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", numbers.digits_and_dots(s).alias("all_digits"), numbers.first_number(s).alias("first_number"), numbers.with_thousands(s).alias("with_k"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_job_per_site(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return keyed.latest(orders, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_chain_join(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    out = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_anti(spark, sf_dir):
    return keyed.orphans(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def referenced_semi(spark, sf_dir):
    return keyed.referenced(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "c_custkey", "o_custkey")


@query("""WITH old AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS vin, p_brand || p_size AS stock FROM part WHERE p_partkey % 2 = 0),
new AS (SELECT p_partkey, p_name AS vin, p_brand || p_size AS stock FROM part)
SELECT p_partkey, coalesce((SELECT min(id) FROM old WHERE old.vin = new.vin), (SELECT min(id) FROM old WHERE old.stock = new.stock)) AS matched FROM new""")
def identity_cascade(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    stock = F.concat("p_brand", F.col("p_size").cast("string")).alias("stock")
    old = parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("vin"), stock)
    return keyed.identified(parts.select("p_partkey", F.col("p_name").alias("vin"), stock), old, ["vin", "stock"], "id").select("p_partkey", "matched")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_expand(spark, sf_dir):
    # Every item goes to every linked tenant: that is the operation. Both tables are fixed dimensions (5 and 25 rows).
    return read(spark, sf_dir, "region").select("r_name").join(read(spark, sf_dir, "nation").select("n_name"), F.lit(True))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY n DESC, l_returnflag")
def group_count_desc(spark, sf_dir):
    return aggregates.counts_by(read(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT count(*) AS total, count(*) FILTER (o_totalprice IS NULL OR o_totalprice = 0) AS no_price, count(*) FILTER (o_orderpriority IS NULL OR trim(o_orderpriority) = '') AS no_priority FROM orders")
def null_audit(spark, sf_dir):
    return aggregates.audit(read(spark, sf_dir, "orders"), {"no_price": F.coalesce(F.col("o_totalprice"), F.lit(0)) == 0, "no_priority": aggregates.blank("o_orderpriority")})


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def distinct_count(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("""WITH t AS (SELECT * FROM part WHERE p_partkey IN (3, 5, 8)), u AS (SELECT p_partkey, unnest(['brand', 'size', 'type']) AS attribute, unnest([p_brand, CAST(p_size AS VARCHAR), p_type]) AS value FROM t)
SELECT attribute, max(value) FILTER (p_partkey = 3) AS entity_1, max(value) FILTER (p_partkey = 5) AS entity_2, max(value) FILTER (p_partkey = 8) AS entity_3 FROM u GROUP BY attribute""")
def compare_matrix(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    return aggregates.compare_matrix(parts, "p_partkey", [3, 5, 8], ["brand", "size", "type"])


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id),
t AS (SELECT user_id, greatest(0, 100 - (CASE WHEN failed = n THEN 40 ELSE 0 END + CASE WHEN failed > 0 THEN 35 ELSE 0 END + least(5 * (5 - kinds), 25) + CASE WHEN n < 3 THEN 30 ELSE 0 END)) AS score FROM s)
SELECT user_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 80 THEN 'COMPLETE' WHEN score >= 40 THEN 'PARTIAL' ELSE 'FAILED' END AS grade FROM t""")
def quality_score(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.countDistinct("event_type").alias("kinds"))
    score = aggregates.quality_score(F.col("failed") == F.col("n"), F.col("failed") > 0, 5 - F.col("kinds"), F.col("n") < 3).cast("long")
    return s.select("user_id", score.alias("score"), aggregates.grade(score).alias("grade"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(trim(text), '>\\s+<', '><', 'g'), '\\s+', ' ', 'g')) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""WITH o AS (SELECT doc_id, n_chars AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN n_chars + 1 ELSE n_chars END AS h FROM documents WHERE doc_id % 10 <> 7)
SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'unlist' WHEN o.h = n.h THEN 'touch' ELSE 'update' END AS action FROM o FULL JOIN n USING (doc_id)""")
def incremental_actions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("h"))
    new = docs.where("doc_id % 10 <> 7").withColumn("h", F.when(F.col("doc_id") % 10 == 5, F.col("h") + 1).otherwise(F.col("h")))
    return changes.actions(docs.where("doc_id % 10 <> 3"), new, "doc_id", "h")


AS_OF = "2024-01-30 12:00:00"


@query(f"""WITH t AS (SELECT event_id, event_type, epoch(TIMESTAMP '{AS_OF}' - ts) / 3600 AS age FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'stale_or_unlisted' WHEN event_type = 'purchase' THEN CASE WHEN age <= 24 THEN 'fresh' WHEN age <= 72 THEN 'recent' ELSE 'stale_or_unlisted' END ELSE CASE WHEN age < 6 THEN 'fresh' WHEN age <= 24 THEN 'recent' ELSE 'stale_or_unlisted' END END AS status FROM t""")
def freshness_bucket(spark, sf_dir):
    source = F.when(F.col("event_type") == "purchase", "feed").otherwise("crawl")
    status = freshness.freshness(F.col("ts").cast("timestamp"), F.col("event_type") != "error", source, F.lit(AS_OF).cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("""WITH j AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)
SELECT c_custkey FROM customer LEFT JOIN j ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' AND (last IS NULL OR epoch(TIMESTAMP '1998-08-01' - last) / 3600 >= CASE WHEN c_mktsegment = 'MACHINERY' THEN 720 ELSE 168 END)""")
def due_for_sync(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    sites = read(spark, sf_dir, "customer").join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    frequency = F.when(F.col("c_mktsegment") == "BUILDING", "manual").when(F.col("c_mktsegment") == "MACHINERY", "monthly").otherwise("weekly")
    return sites.where(freshness.due_for_sync(frequency, F.col("last").cast("timestamp"), F.lit("1998-08-01").cast("timestamp"))).select("c_custkey")


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)), '/+$', '') AS page_key FROM pages")
def url_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.host_and_path(F.col("url")).alias("page_key"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def meta_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


LINKS_SQL = """WITH a AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, trim(unnest(regexp_extract_all(html, '\\bhref\\s*=\\s*"([^"]*)"', 1))) AS raw FROM pages),
r AS (SELECT page_id, url, host, CASE WHEN regexp_matches(raw, '^(?i:https?)://') THEN raw WHEN raw[:2] = '//' THEN scheme || ':' || raw WHEN raw[1] = '/' THEN scheme || '://' || host || raw WHEN NOT regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN scheme || '://' || host || coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*/)', 1), ''), '/') || raw END AS full_url FROM a WHERE raw <> '' AND raw[1] <> '#'),
t AS (SELECT page_id, url, host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(full_url, '#.*$', ''), '([?&])(?:(?:utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid|ref|msclkid)=[^&]*(?:&|$))+', '\\1', 'g'), '[?&]$', ''), '([^/:])/$', '\\1') AS link FROM r),
l AS (SELECT DISTINCT page_id, url, link FROM t WHERE lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) = host AND NOT regexp_matches(lower(regexp_replace(link, '[?#].*$', '')), '\\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|pdf|zip|mp4|mp3|woff|woff2|xml|json)$'))"""


def _dropped_sql(x: str, tags: tuple[str, ...]) -> str:
    """x with these elements, whole, as blanks."""
    for tag in tags:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return x


def _decoded_sql(x: str) -> str:
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " ")):
        x = f"replace({x}, '{name}', '{sign}')"
    return x


_MAIN_SQL = _dropped_sql("coalesce(nullif(regexp_extract(html, '(?is)<(?:main|article)\\b[^>]*>(.*?)</(?:main|article)>', 1), ''), html)", ("nav", "header", "footer", "aside", "form"))
_BARE_SQL = f"regexp_replace(regexp_replace({_dropped_sql(_MAIN_SQL, ('script', 'style', 'noscript'))}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
_PLATFORM_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(html), '{marks}') THEN '{name}'" for name, marks in web.PLATFORMS) + " ELSE 'unknown' END"


@query(f"{LINKS_SQL} SELECT page_id, link FROM l")
def link_extract(spark, sf_dir):
    return web.links(read(spark, sf_dir, "pages"), "page_id", "url", "html")


@query(f"SELECT page_id, trim(regexp_replace({_decoded_sql(_BARE_SQL)}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text, {_PLATFORM_SQL} AS platform FROM pages")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.page_text(F.col("html")).alias("text"), web.platform(F.col("html")).alias("platform"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def usage_by_kind(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS calls, count(*) FILTER (event_type = 'view') AS chats, (count(*) FILTER (event_type = 'purchase') > 1 OR count(*) FILTER (event_type = 'view') > 2) AS tripped FROM events GROUP BY ALL")
def daily_breaker(spark, sf_dir):
    usage = aggregates.daily_usage(read(spark, sf_dir, "events"), "user_id", "ts", {"calls": F.col("event_type") == "purchase", "chats": F.col("event_type") == "view"})
    return aggregates.breaker(usage, {"calls": 1, "chats": 2})


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, true AS allowed, [t] AS log FROM e WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, len(l) < 3, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END FROM (SELECT e.user_id, e.event_id, e.rn, e.t, list_filter(r.log, lambda a: a > e.t - 86400) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, allowed FROM r""")
def rate_limit_replay(spark, sf_dir):
    return sessions.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86400.0)


@query("""WITH t AS (SELECT conv_id, turn, lower(trim(role)) AS v FROM conversations), m AS (SELECT *, CASE WHEN v = lag(v) OVER w AND turn - lag(turn) OVER w < 60 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) AS run_length FROM r""")
def dup_runs(spark, sf_dir):
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return keyed.runs(talk, "conv_id", "turn", F.lower(F.trim("role")), F.col("turn"), 60.0).select("conv_id", "turn", F.col("run_length").cast("long").alias("run_length"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM g GROUP BY user_id, s""")
def session_activity(spark, sf_dir):
    found = sessions.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_turn(spark, sf_dir):
    return sessions.last_write(read(spark, sf_dir, "conversations"), "conv_id", "text", "turn")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return read(spark, sf_dir, "events").select("event_type", (k % 10).alias("bucket")).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.02")
def key_intersection(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return lines.where("l_quantity > 45").select("l_orderkey", "l_linenumber").intersect(lines.where("l_discount < 0.02").select("l_orderkey", "l_linenumber"))


@query("SELECT s_name AS title, s_acctbal AS price, 'shopify' AS source, '{\"nation\":\"' || s_nationkey || '\"}' AS metadata FROM supplier")
def merged_profiles(spark, sf_dir):
    """Crawled versions of suppliers merged into delivered ones."""
    from loomwright.operators import merging

    side = lambda source, name: F.struct(name.alias("title"), F.col("s_acctbal").alias("price"), F.lit(source).alias("source"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("metadata"))
    pairs = read(spark, sf_dir, "supplier").select(side("shopify", F.col("s_name")).alias("old"), side("crawl", F.upper("s_name")).alias("new"))
    return merging.merged(pairs, ["title", "price"]).select("title", "price", "source", F.to_json("metadata").alias("metadata"))


@query("WITH t AS (SELECT item_id, list_sum(list_transform(string_split(text, ''), lambda c: ascii(c))) AS total FROM benchmark) SELECT item_id, list_transform(range(0, 64), lambda i: round(sin(total + i) * 0.1, 9)) AS embedding FROM t")
def fallback_embedding(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.transform(vectors.fallback_vector(F.col("text"), 64), lambda x: F.round(x, 9)).alias("embedding"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_quantities(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query()
def query_intents(spark, sf_dir):
    """What the users' turns ask for."""
    asked = intent.understood(read(spark, sf_dir, "conversations").where("role = 'user'"), "text")
    return asked.select("conv_id", "turn", "intent.kind", "intent.entity_type", "intent.max_price", "intent.keywords")


ASKS = (
    "used Grand Cherokee under $30k", "blue F-150 hemi or a silverado", "Mustang Mach-E, all-wheel drive, not electric", "beginner course online", "honda crv with manual", "300 or 1500 diesel in canadian dollars",
    "what's new?", "Wranglers or mustang", "cx-50 phev", "santa  fe expert class", "jeep rav4 v6 automatic €20k", "f150s at 4runner prices",
)
SAID_SQL = f"SELECT p_partkey, lower(coalesce({[*ASKS]!r}[p_partkey % {len(ASKS) + 3} + 1], p_name)) AS q FROM part"


def _first_sql(table: tuple) -> str:
    return "CASE " + " ".join("WHEN regexp_matches(q, '\\b(" + "|".join(w.replace(" ", "\\s+") for w in row[1]) + ")\\b')" + (f" OR contains(q, '{row[2]}')" if len(row) > 2 and row[2] else "") + f" THEN '{row[0]}'" for row in table) + " END"


MODEL_ROWS = ", ".join(f"('{n}', '{make}', '{model}')" for n, (make, model) in intent.model_names().items())


@query(f"""WITH t AS ({SAID_SQL.replace('"', "'").replace("'what's new?'", "'what''s new?'")}), m(name, make, model) AS (VALUES {MODEL_ROWS}),
b AS (SELECT q, arg_max(struct_pack(make := make, model := model), length(name)) AS m FROM (SELECT DISTINCT q FROM t) JOIN m ON regexp_matches(q, '\\b' || name || '\\b') GROUP BY q)
SELECT p_partkey, coalesce({_first_sql(intent.MAKES)}, b.m.make) AS make, b.m.model AS model, {_first_sql(intent.TRANSMISSIONS)} AS transmission, {_first_sql(intent.ALL_WHEELS)} AS drivetrain, {_first_sql(intent.ENGINES)} AS engine, {_first_sql(intent.LEVELS)} AS level, {_first_sql(intent.FORMATS)} AS format, {_first_sql(intent.CURRENCIES)} AS currency,
CASE WHEN contains(q, 'not electric') THEN NULL ELSE {_first_sql(intent.FUELS)} END AS fuel, CASE WHEN q <> 'what''s new?' THEN {_first_sql(intent.CONDITIONS)} END AS condition FROM t LEFT JOIN b USING (q)""")
def model_names(spark, sf_dir):
    """What turns that name models ask for; a model tells its make."""
    asked = F.coalesce(F.get(F.array(*map(F.lit, ASKS)), (F.col("p_partkey") % (len(ASKS) + 3)).cast("int")), F.col("p_name"))
    found = intent.understood(spread(read(spark, sf_dir, "part")).select("p_partkey", asked.alias("asked")), "asked")
    return found.select("p_partkey", *(f"intent.{c}" for c in ("make", "model", "transmission", "drivetrain", "engine", "level", "format", "currency", "fuel", "condition")))


@query("""WITH h AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS site, lower(url) AS url FROM pages)
SELECT site, count(*) AS urls, count(*) FILTER (regexp_matches(url, '\\b(?:new-vehicles|new-inventory|new-cars|searchnew)\\b|/new/')) AS new_routes, count(*) FILTER (regexp_matches(url, '\\b(?:used-vehicles|used-inventory|used-cars|pre-owned|searchused)\\b|/used/')) AS used_routes, count(*) FILTER (regexp_matches(url, '\\b(?:cpo|certified-pre-owned|certified)\\b')) AS cpo_routes FROM h GROUP BY site""")
def crawl_coverage(spark, sf_dir):
    return crawl.coverage(read(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("site"), "url"), "site", "url")


@query(f"""{LINKS_SQL}, e AS (SELECT DISTINCT url, link FROM l), d0 AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS site, url FROM pages),
d1 AS (SELECT DISTINCT site, link AS url FROM d0 JOIN e USING (url) EXCEPT SELECT site, url FROM d0), d2 AS (SELECT DISTINCT site, link AS url FROM d1 JOIN e USING (url) EXCEPT (SELECT site, url FROM d0 UNION ALL SELECT site, url FROM d1)),
f AS (SELECT *, 0 AS depth FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2) SELECT site, url, depth FROM f QUALIFY row_number() OVER (PARTITION BY site ORDER BY depth, url) <= 15""")
def site_frontier(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    links = web.links(pages, "url", "url", "html").select("url", "link")
    return crawl.frontier(pages.select(urls.host(F.col("url")).alias("site"), "url"), links)


@query("""WITH i AS (SELECT p_partkey AS new_id, p_name, p_brand || p_type AS kind FROM part WHERE p_partkey % 2 = 1), e AS (SELECT p_partkey AS old_id, p_name, p_brand || p_type AS kind FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT new_id, old_id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY new_id) AS n FROM i) JOIN (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY old_id) AS n FROM e) USING (p_name, n)),
b AS (SELECT new_id, old_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY new_id) AS n FROM i WHERE new_id NOT IN (SELECT new_id FROM a)) JOIN (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY old_id) AS n FROM e WHERE old_id NOT IN (SELECT old_id FROM a)) USING (kind, n))
SELECT new_id, old_id, 0 AS rule FROM a UNION ALL SELECT new_id, old_id, 1 AS rule FROM b""")
def matched_parts(spark, sf_dir):
    """Odd parts as crawled ones, matched one to one with even ones by name, then by brand and type."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_brand", "p_type").alias("kind"))
    side = lambda rest, name: parts.where(F.col("p_partkey") % 2 == rest).withColumnRenamed("p_partkey", name)
    return crawl.paired(side(1, "new_id"), side(0, "old_id"), [F.col("p_name"), F.col("kind")], "new_id", "old_id")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) || '-' || p_size END AS sku, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS title, p_type AS kind, CASE WHEN p_partkey % 5 < 2 THEN 'shop.example/' || p_size END AS url FROM part),
i AS (SELECT row_number() OVER (ORDER BY id) AS n, * FROM p WHERE id % 2 = 1), e AS (SELECT * FROM p WHERE id % 2 = 0),
m AS (SELECT i.n, i.id AS i, e.id AS e FROM i JOIN e ON i.sku = e.sku OR (i.title <> '' AND i.title = e.title AND i.kind = e.kind) OR (i.url = e.url AND (contains(i.title, e.title) OR contains(e.title, i.title)))),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS e UNION ALL
SELECT n, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END, best FROM (SELECT r.n + 1 AS n, any_value(r.taken) AS taken, min(m.e) FILTER (NOT list_contains(r.taken, m.e)) AS best FROM r LEFT JOIN m ON m.n = r.n + 1 WHERE r.n < (SELECT count(*) FROM i) GROUP BY r.n))
SELECT i.id AS new_id, r.e AS old_id FROM r JOIN i USING (n) WHERE r.e IS NOT NULL""")
def claimed_entities(spark, sf_dir):
    """Odd parts as crawled entities that take even ones by shop number, title with type, or url; each part can be taken once."""
    key, no = F.col("p_partkey"), F.lit(None).cast("string")
    sku = F.when(key % 3 == 0, F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")))
    url = F.when(key % 5 < 2, F.concat(F.lit("https://shop.example/"), F.col("p_size").cast("string"), F.lit("/")))
    rows = read(spark, sf_dir, "part").select(key.cast("long").alias("id"), sku.alias("sku"), no.alias("shopify_id"), no.alias("woo_id"), no.alias("external_id"), F.when(key % 7 == 0, "").otherwise(F.col("p_name")).alias("title"), F.col("p_type").alias("entity_type"), url.alias("source_url"))
    found = matching.matched_entities(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"))
    return found.select(F.col("i").alias("new_id"), F.col("e").alias("old_id"))


@query("""WITH u AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site, lower(regexp_replace(trim(url), '/+$', '')) AS key, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
d AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u QUALIFY row_number() OVER (PARTITION BY site, key ORDER BY page_id) = 1),
e AS (SELECT *, coalesce(parts[-1], '') AS slug, len(parts) >= 2 AS deep, trim(regexp_replace(CASE WHEN title = '' THEN coalesce(parts[-1], 'Page') ELSE title END, '\\s*[—–|•:-]\\s*[^—–|•:-]+$', '')) AS clean FROM d),
f AS (SELECT *, trim(regexp_replace(lower(strip_accents(clean)), '[^a-z0-9]+', ' ', 'g')) AS pc, list_filter(string_split(trim(regexp_replace(lower(slug), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) >= 2) AS slugs FROM e),
q AS (SELECT page_id AS query_id, site, regexp_extract(path, '/([a-z]+)/([0-9]+)', 1) AS one, regexp_extract(path, '/([a-z]+)/([0-9]+)', 2) AS two FROM u),
m AS (SELECT query_id, f.*, one || ' ' || two AS target, list_filter([one, two], lambda x: len(x) >= 2) AS tokens FROM q JOIN f USING (site)),
c AS (SELECT *, len(list_filter(tokens, lambda x: contains(pc, x) OR list_contains(slugs, x))) / len(tokens) AS t, len(list_filter(tokens, lambda x: contains(lower(slug), x))) / len(tokens) AS s FROM m),
s AS (SELECT *, CASE WHEN contains(pc, target) AND pc <> target THEN 950 WHEN pc = target THEN 1000 ELSE 0 END + CASE WHEN ends_with(key, target) THEN 1000 ELSE 0 END + CASE WHEN t >= 1 THEN 850 WHEN t >= 0.6 THEN floor(t * 550 + 0.5) ELSE 0 END + CASE WHEN s >= 1 THEN 700 WHEN s >= 0.5 THEN floor(s * 400 + 0.5) ELSE 0 END AS matched, contains(pc, target) OR ends_with(key, target) OR (t >= 1 AND deep) AS exact FROM c),
r AS (SELECT *, matched + CASE WHEN deep AND matched >= 700 THEN 200 ELSE 0 END + 200 AS score, exact OR (deep AND matched >= 700) AS sure FROM s),
k AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS after, lead(url) OVER w AS next FROM r WHERE score >= 450 WINDOW w AS (PARTITION BY query_id ORDER BY sure DESC, score DESC, page_id))
SELECT query_id, CASE WHEN k.page_id IS NULL THEN 'not_found' WHEN NOT sure AND score - after < 120 AND url <> next THEN 'ambiguous' WHEN sure OR score >= 800 THEN 'exact' WHEN score >= 500 THEN 'partial' ELSE 'not_found' END AS status, CAST(score AS BIGINT) AS score, k.page_id AS id FROM q LEFT JOIN (SELECT * FROM k WHERE rn = 1) k USING (query_id)""")
def navigation_targets(spark, sf_dir):
    """Someone at each page's site asks for its language and number; the pages of the site are the destinations."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("site"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    number = lambda i: F.regexp_extract("url", r"://[^/?#]*/([a-z]+)/([0-9]+)", i)
    asked = pages.select("site", F.col("page_id").alias("query_id"), F.concat(F.lit("Take me to the "), number(1), F.lit(" "), number(2), F.lit(" page")).alias("query"))
    places = pages.select("site", F.col("page_id").alias("id"), "url", "title", F.lit("text").alias("entity_type"), F.lit(False).alias("priced"), F.lit(None).cast("string").alias("facts"))
    return navigation.resolved(asked, places).select("query_id", "status", "score", "id")


@query("""WITH RECURSIVE d AS (SELECT page_id AS i, regexp_replace(split_part(split_part(lower(url), '#', 1), '?', 1), '/+$', '') AS url FROM pages),
r AS (SELECT i AS site, i AS map, 0 AS depth FROM d UNION SELECT site, d.i, depth + 1 FROM r JOIN d ON d.i IN (2 * map + 1, 2 * map + 2, map // 2) WHERE depth < 3)
SELECT CAST(site AS VARCHAR) AS site, 'https://maps.example/page/' || map AS url, CAST(min(depth) AS INT) AS depth FROM r GROUP BY ALL""")
def sitemap_tree(spark, sf_dir):
    """Each page as a sitemap that names one page, two sitemaps below it and the one above it, so that there are cycles and dead ends; each is a site's root."""
    key = F.col("page_id")
    at = lambda n: F.concat(F.lit("https://maps.example/"), n.cast("long").cast("string"), F.lit(".xml"))
    loc = lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))
    page = F.concat(F.lit("https://maps.example/page/"), key.cast("string"), F.lit("/?utm_source=map"))
    body = F.concat(F.lit("<urlset>"), loc(page), *(loc(at(n)) for n in (2 * key + 1, 2 * key + 2, F.floor(key / 2))), loc(F.lit("https://elsewhere.example/x")), F.lit("</urlset>"))
    documents = read(spark, sf_dir, "pages").select("page_id", at(key).alias("url"), body.alias("body"))
    return web.sitemap_pages(documents, documents.select(key.cast("string").alias("site"), "url"))


NAVIGATION = {"baseSelector": "nav li", "fields": [{"name": "label", "selector": "a", "type": "text"}, {"name": "target", "selector": "a[href]", "type": "attribute", "attribute": "href"}, {"name": "note", "selector": "span.note", "default": "none"}, {"name": "first", "selector": "a", "type": "regex", "pattern": "^(.)"}]}


@query("""WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages), u AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label, unnest(range(len(regexp_extract_all(nav, '<a href=')))) AS place FROM n),
t AS (SELECT page_id, CAST(place AS INT) AS place, replace(replace(replace(replace(target, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS target, trim(replace(replace(replace(replace(label, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS label FROM u)
SELECT page_id, place, nullif(label, '') AS label, target, 'none' AS note, nullif(label[1], '') AS first FROM t""")
def extracted_navigation(spark, sf_dir):
    """What a schema takes out of each page's navigation."""
    found = extraction.extracted(read(spark, sf_dir, "pages").select("page_id", "html"), "html", NAVIGATION)
    return found.select("page_id", "place", "label", "target", "note", "first")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'old' END AS color, 12 AS size, CASE WHEN event_id % 3 = 0 THEN '[3]' ELSE '[1,2]' END AS tags, '[REDACTED]' AS token, CASE WHEN event_id % 3 = 0 THEN '[REDACTED]' END AS api_key FROM events""")
def merged_settings(spark, sf_dir):
    """Settings of an event's own over common ones, then with secrets masked."""
    common = F.parse_json(F.lit('{"look": {"color": "old", "size": 12, "tags": [1, 2]}, "login": {"accessToken": "t"}, "k": 0}'))
    own = F.when(F.col("event_id") % 3 == 0, F.lit('{"look": {"color": "new", "tags": [3]}, "deep": [{"apiKey": {"a": 1}}]}'))
    rows = read(spark, sf_dir, "events").select("event_id", nested.merged(nested.merged(common, F.parse_json(own)), F.try_parse_json("props")).alias("v"))
    masked = rows.select("event_id", nested.redacted(F.col("v")).alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    return masked.select("event_id", get("$.k").alias("k"), get("$.look.color").alias("color"), get("$.look.size", "int").alias("size"), get("$.look.tags").alias("tags"), get("$.login.accessToken").alias("token"), get("$.deep[0].apiKey").alias("api_key"))


HYBRID = f"""WITH q AS (SELECT {VECTOR}::DOUBLE[] AS v), d AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, split_part(text, chr(10), 1) AS title, text AS content, epoch(TIMESTAMP '{AS_OF}') - (1706400000 + doc_id % 200000) AS age FROM documents WHERE lang = 'en'),
v AS (SELECT vec_id, {SIMILARITY} AS similarity FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM d) AND {SIMILARITY} > 0.25 ORDER BY 2 DESC, vec_id LIMIT 10)
SELECT id, title, NULL::VARCHAR AS category, NULL::VARCHAR AS tags, content, NULL::DOUBLE AS price, similarity, CASE WHEN age < 21600 THEN 'fresh' WHEN age <= 86400 THEN 'recent' ELSE 'stale_or_unlisted' END AS freshness FROM d LEFT JOIN v ON vec_id = doc_id"""


@query(ranked_sql(HYBRID, "thing near the shed", ("thing", "shed"), "id, CAST(score AS BIGINT) AS score, round(similarity, 9) AS similarity, freshness", 10))
def hybrid_retrieve(spark, sf_dir):
    """Keyword and vector channel over documents; embeddings join by id, as rows of a catalog carry theirs."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    rows = docs.select(F.col("lang").alias("widget_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "embedding", F.timestamp_seconds(1706400000 + F.col("doc_id") % 200_000).alias("last_seen"))
    asked = rerank.Intent("thing near the shed", "catalog", ["thing", "shed"])
    return retrieval.retrieve(rows, ["en"], asked, F.lit(AS_OF).cast("timestamp"), VECTOR, limit=10).select("id", "score", F.round("similarity", 9).alias("similarity"), "freshness")


@query("SELECT c_custkey, CASE WHEN o.o_custkey IS NULL THEN 'absent' WHEN o.o_custkey = c_custkey THEN 'own' ELSE 'foreign' END AS status FROM customer LEFT JOIN orders o ON o.o_orderkey = c_custkey")
def point_lookup(spark, sf_dir):
    """Every customer asks for the order whose number is its own key."""
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_custkey").alias("id"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant"))
    return inventory.looked_up(asked, orders, "id", "tenant").select(F.col("tenant").alias("c_custkey"), "status")


@query("SELECT DISTINCT unnest([CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR)]) AS id FROM supplier WHERE CAST(s_suppkey AS VARCHAR) = '3' OR s_name = '3' OR CAST(s_nationkey AS VARCHAR) = '3'")
def tenant_resolution(spark, sf_dir):
    return inventory.tenant_ids(read(spark, sf_dir, "supplier"), "3", ["s_suppkey", "s_name", "s_nationkey"])


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING list_has_all(list(DISTINCT o_orderstatus), ['F', 'O'])")
def array_containment(spark, sf_dir):
    held = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("statuses"))
    return inventory.with_all(held, "statuses", ["F", "O"]).select("o_custkey")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 2")
def second_turn(spark, sf_dir):
    return keyed.nth(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 2)


@query("SELECT user_id, event_id, CAST(least(rn, 5) AS INT) AS current_turn, rn <= 5 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)")
def turn_caps(spark, sf_dir):
    return sessions.turn_capped(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


PRICED = "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part"


def priced(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"))


@query(f"WITH t AS ({PRICED}) SELECT p_partkey, price FROM t WHERE price <= 950 ORDER BY price DESC, p_partkey LIMIT 20")
def constrained_results(spark, sf_dir):
    return constraints.sorted_strict(constraints.strict(priced(spark, sf_dir), max_price=950.0), "most_expensive", "p_partkey").limit(20)


@query(f"WITH t AS ({PRICED}) SELECT p_partkey, price FROM t WHERE price IS NULL OR price >= 905 ORDER BY coalesce(price, 99999), p_partkey")
def leniently_filtered(spark, sf_dir):
    return constraints.sorted_lenient(constraints.lenient(priced(spark, sf_dir), min_price=905.0), "price_asc", "p_partkey")


@query("""WITH v AS (SELECT p_partkey, 'v' || p_partkey AS id, p_brand AS tenant, p_name AS title, p_size FROM part),
a AS (SELECT 'structured' AS route, id, title, 'vehicles' AS source FROM v WHERE tenant IN ('Brand#13', 'Brand#4') AND p_size % 2 = 1 AND contains(lower(title), 'gear') AND 1990 + p_size >= 2000 ORDER BY p_partkey DESC LIMIT 5),
b AS (SELECT 'broad' AS route, id, title, 'vehicles' AS source FROM v WHERE tenant IN ('Brand#13', 'Brand#4') ORDER BY p_partkey DESC LIMIT 5)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def routed_results(spark, sf_dir):
    """Three queries on two tenants' parts as vehicles: one that finds some, one for a make nobody has (no rows, and none instead), a broad one that retrieval has nothing for."""
    parts = read(spark, sf_dir, "part")
    no = F.lit(None).cast("string")
    used = F.when(F.col("p_size") % 2 == 1, "used").otherwise("new")
    stock = parts.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("widget_id"), F.col("p_name").alias("title"), F.col("p_name").alias("make"), no.alias("model"), no.alias("trim"), no.alias("category"), F.col("p_type").alias("body_style"), used.alias("condition"), (F.col("p_size") + 1990).alias("year"), F.col("p_retailprice").alias("price"), F.lit(None).cast("double").alias("mileage"), F.lit(True).alias("still_listed"), F.timestamp_seconds(1_700_000_000 + F.col("p_partkey")).alias("created_at"))
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("widget_id"), F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    cases = {"structured": ("used gear since 2000", {"condition": "used", "make": "gear", "min_year": 2000}), "nothing": ("used Wrangler", {"condition": "used", "make": "Wrangler"}), "broad": ("what do you have", {})}
    out = None
    for route, (asked, wanted) in cases.items():
        found = routing.routed(rows, stock, ["Brand#13", "Brand#4"], rerank.Intent(asked, "catalog", entity_type="vehicle"), wanted, F.lit(AS_OF).cast("timestamp")).select(F.lit(route).alias("route"), "id", "title", "source")
        out = found if out is None else out.unionByName(found)
    return out


SAID = ("the second one", "how much is it", "open the last one", "pictures of that", "any news")
ASKED = "CASE turn % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAID)) + " END"


@query(f"""WITH t AS (SELECT conv_id, turn, {ASKED} AS said, CASE WHEN role = 'assistant' THEN string_split(text, ' ')[1:3] END AS shown, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN string_split(text, ' ')[1] END AS pinned FROM conversations),
w AS (SELECT conv_id, turn, said, last_value(shown IGNORE NULLS) OVER b AS pool, last_value(pinned IGNORE NULLS) OVER b AS pin FROM t WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, CASE said WHEN 'the second one' THEN pool[least(2, len(pool))] WHEN 'open the last one' THEN pool[len(pool)] END AS place FROM w)
SELECT conv_id, turn, said IN ('how much is it', 'pictures of that') OR (said <> 'any news' AND pool IS NOT NULL) OR (said = 'the second one' AND pool IS NOT NULL) AS refers,
CASE WHEN place IS NOT NULL THEN place WHEN said IN ('how much is it', 'pictures of that') THEN coalesce(pin, pool[1]) END AS entity,
CASE WHEN place IS NOT NULL THEN place || ' details' WHEN said = 'how much is it' AND pin IS NOT NULL THEN 'price of ' || pin WHEN said = 'pictures of that' AND pin IS NOT NULL THEN 'show me pictures of ' || pin WHEN said IN ('how much is it', 'pictures of that') THEN pool[1] || ' ' || said END AS rewritten FROM e""")
def resolved_turns(spark, sf_dir):
    """What follow-up turns refer to: the assistant's turns show their first three words, in even conversations they settle on the first."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("turn") % 5 + 1).cast("int"))
    words, theirs = F.split("text", " "), F.col("role") == "assistant"
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"), F.when(theirs, F.slice(words, 1, 3)).alias("shown"), F.when(theirs & (F.col("conv_id") % 2 == 0), F.get(words, F.lit(0))).alias("pinned"))
    return references.resolved(talk, "conv_id", "turn", "said", "shown", "pinned").select("conv_id", "turn", "refers", "entity", "rewritten")


@query("""WITH e AS (SELECT user_id, event_id, ts, nullif(event_type, 'view') AS kind, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM e)
SELECT user_id, event_id, count(*) OVER w AS turn_count, last_value(kind IGNORE NULLS) OVER w AS kind FROM g WINDOW w AS (PARTITION BY user_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def session_contexts(spark, sf_dir):
    updates = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.nullif("event_type", F.lit("view")).alias("kind"))
    return references.session_context(updates, "user_id", "ts", "event_id", ["kind"], 6 * 3600.0).drop("ts")


TYPED = "CASE lang WHEN 'en' THEN 'Blog' WHEN 'fr' THEN 'page' WHEN 'de' THEN 'vehicle' END"


def typed(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "Blog").when(F.col("lang") == "fr", "page").when(F.col("lang") == "de", "vehicle")
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("tier"), kind.alias("entity_type"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))


@query(f"WITH t AS (SELECT source, {TYPED} AS kind FROM documents) SELECT source, count(*) FILTER (kind IN ('Blog', 'vehicle')) AS entities, count(*) FILTER (kind IS NULL OR kind = 'page') AS pages FROM t GROUP BY source")
def knowledge_counts(spark, sf_dir):
    return entities.counts(typed(spark, sf_dir), "source", "entity_type")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(source), 'src1') AND contains(lower(text), 'the')")
def catalog_view(spark, sf_dir):
    return entities.viewed(typed(spark, sf_dir), "entities", "src1", "article", "EN", " the ".strip()).where(~entities.is_artifact("title", "content")).select("doc_id")


@query("SELECT p_partkey, p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR regexp_matches(p_name, 'car|truck|suv|vehicle|wrangler|cherokee|ram|dodge|durango|chrysler|ford|toyota|honda') AS is_vehicle FROM part")
def vehicle_rows(spark, sf_dir):
    metadata = F.when(F.col("p_partkey") % 7 == 0, F.parse_json(F.lit('{"vin": "1C4"}'))).when(F.col("p_partkey") % 2 == 0, F.parse_json(F.lit('{"make": "", "sku": 4}')))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit(None).cast("string").alias("data_type"), F.when(F.col("p_partkey") % 11 == 0, "vehicle").alias("entity_type"), metadata.alias("metadata"))
    return rows.select("p_partkey", entities.is_vehicle("data_type", "entity_type", "p_name", "metadata").alias("is_vehicle"))


TERMS = ("abot", "Contact-Us", "our storry", "FAQs", "privacy policy", "careeers page", "docs & prices")
NAMES = "[" + ", ".join("{'n': '%s', 'c': '%s'}" % pair for pair in concepts.names().items()) + "]"


@query(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 8 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TERMS))} ELSE p_name END AS term FROM part),
u AS (SELECT *, trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) AS x FROM t), d AS (SELECT DISTINCT x, list_filter(string_split(x, ' '), lambda w: len(w) >= 2) AS words FROM u), n AS (SELECT {NAMES} AS names),
k AS (SELECT x, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM d), m AS (SELECT generate_subscripts(names, 1) AS j, unnest(names) AS v FROM n),
h AS (SELECT x, first(v.c ORDER BY i, j) AS concept FROM k JOIN m ON v.n = w OR CASE WHEN least(len(v.n), len(w)) < 4 THEN false WHEN least(len(v.n), len(w)) = 4 THEN abs(len(v.n) - len(w)) <= 1 AND v.n[1:3] = w[1:3] AND levenshtein(v.n, w) <= 1
WHEN greatest(len(v.n), len(w)) <= 6 THEN abs(len(v.n) - len(w)) <= 1 AND levenshtein(v.n, w) <= 1 ELSE abs(len(v.n) - len(w)) <= 2 AND levenshtein(v.n, w) <= 2 END GROUP BY x)
SELECT p_partkey, coalesce(e.v.c, h.concept) AS concept FROM u LEFT JOIN m e ON e.v.n = u.x LEFT JOIN h ON h.x = u.x""")
def section_concepts(spark, sf_dir):
    """Concepts of section names as people type them; names that many rows share are looked at once."""
    term = F.coalesce(F.get(F.array(*map(F.lit, TERMS)), (F.col("p_partkey") % 8).cast("int")), F.col("p_name"))
    named = read(spark, sf_dir, "part").select("p_partkey", term.alias("term"))
    known = named.select("term").distinct().withColumn("concept", concepts.concept_of(F.col("term")))
    return named.join(known, "term", "left").select("p_partkey", "concept")


@query("SELECT event_id FROM events WHERE NOT coalesce(user_id IN (1, 2, 3, 4, 5, 6, 7, 8) AND json_extract_string(props, '$.k') IN ('5'), false)")
def deleted_products(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.try_parse_json("props").alias("props"))
    return changes.without_member(rows, "user_id", list(range(1, 9)), "props", "$.k", "5").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def cascaded_orders(spark, sf_dir):
    """Orders that stay when a region's nations, with them their customers, are deleted."""
    gone = read(spark, sf_dir, "nation").where("n_regionkey = 1")
    customers = keyed.referenced(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), gone, "c_nationkey", "n_nationkey")
    return changes.cascaded(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey", "c_custkey").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'blocked' WHEN o_orderkey % 6 = 0 THEN 'failed' ELSE 'completed' END AS status,
CASE WHEN o_orderstatus = 'P' THEN 'Crawl blocked by anti-bot firewall (WAF challenge detected).' WHEN o_orderkey % 5 = 0 THEN 'e1; e2; e3' WHEN o_orderkey % 6 = 0 THEN 'Crawl failed to reach http://x: 0 pages analyzed and 0 knowledge records extracted. Verify site accessibility.' END AS error_message FROM orders""")
def job_outcomes(spark, sf_dir):
    key = F.col("o_orderkey")
    errors = F.when(key % 5 == 0, F.array(*map(F.lit, ("e1", "e2", "e3", "e4"))))
    out = changes.job_outcome(F.col("o_orderstatus") == "P", F.when(key % 2 != 0, F.lit(4)), F.when(key % 3 != 0, F.lit(9)), errors, F.lit("http://x"))
    return read(spark, sf_dir, "orders").select("o_orderkey", out.alias("out")).select("o_orderkey", "out.*")


@query("""SELECT s_suppkey, CASE WHEN n_regionkey IS NOT NULL THEN n_name ELSE 'nobody' END AS widget_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'text of it' END AS short_description, CASE WHEN s_suppkey % 3 = 0 THEN 'a.jpg,b.jpg' WHEN s_suppkey % 3 = 1 THEN 'c.jpg' ELSE '' END AS images, CASE WHEN s_suppkey % 5 = 0 THEN 'feed' ELSE 'crawl' END AS data_type
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3""")
def backfilled_rows(spark, sf_dir):
    key = F.col("s_suppkey")
    owners = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("website_id"), F.col("n_name").alias("id"))
    images = F.when(key % 3 == 0, F.lit('"images": ["a.jpg", "b.jpg"]')).when(key % 3 == 1, F.lit('"image": "c.jpg"')).otherwise('"image": ""')
    said = F.when(key % 2 == 0, F.concat(F.lit(', "description": "'), "s_name", F.lit('"'))).otherwise("")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("widget_id"), F.lit(None).cast("string").alias("short_description"), F.lit("text of it").alias("content"), F.array().cast("array<string>").alias("image_urls"), F.when(key % 5 == 0, "feed").otherwise("").alias("data_type"), F.parse_json(F.concat(F.lit("{"), images, said, F.lit("}"))).alias("metadata"))
    return changes.backfilled(rows, owners, "nobody").select("s_suppkey", "widget_id", "short_description", F.array_join("image_urls", ",").alias("images"), "data_type")


@query("""WITH c AS (SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS a, min(ts) FILTER (event_type = 'view') AS s, min(ts) FILTER (event_type = 'error') AS z, max(ts) AS seen FROM events GROUP BY user_id),
d AS (SELECT user_id, z, CASE WHEN (s IS NULL OR s > a + INTERVAL 20 HOUR) AND a + INTERVAL 20 HOUR <= seen THEN a + INTERVAL 20 HOUR END AS quiet, CASE WHEN a + INTERVAL 40 HOUR <= seen THEN a + INTERVAL 40 HOUR END AS cap FROM c WHERE a IS NOT NULL)
SELECT user_id, strftime(least(quiet, cap, z), '%Y-%m-%d %H:%M:%S') AS ended_at, CASE WHEN quiet = least(quiet, cap, z) THEN 'initial_silence_timeout' WHEN cap = least(quiet, cap, z) THEN 'max_duration_cap' WHEN z IS NOT NULL THEN 'hangup' END AS reason FROM d""")
def watched_calls(spark, sf_dir):
    """Users as calls that begin with a purchase; a view is speech, an error the end."""
    kinds = F.when(F.col("event_type") == "purchase", "start").when(F.col("event_type") == "view", "speech").when(F.col("event_type") == "error", "end")
    events = read(spark, sf_dir, "events").select("user_id", "ts", kinds.alias("kind"))
    found = sessions.watched_calls(events, "user_id", "ts", "kind", minutes=2400, silence=72000)
    return found.select("user_id", F.date_format(F.timestamp_seconds("ended_at"), "yyyy-MM-dd HH:mm:ss").alias("ended_at"), "reason")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, 1 AS n, t + 86400 AS until FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.t >= until THEN 1 ELSE n + 1 END, CASE WHEN e.t >= until THEN e.t + 86400 ELSE until END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, n <= 3 AS allowed FROM r""")
def fixed_window_replay(spark, sf_dir):
    return sessions.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86400.0, "fixed")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def customers_without_pending(spark, sf_dir):
    return keyed.orphans(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN 1000.0 + p_size ELSE NULL END::DOUBLE AS with_k FROM part")
def prices_with_thousands(spark, sf_dir):
    size = F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(" K"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("1,"), F.lpad(size, 3, "0"))).otherwise("from 3k")
    return read(spark, sf_dir, "part").select("p_partkey", numbers.with_thousands(s).alias("with_k"))


# Types by the key's remainder, with the family each belongs to and its kind of row.
STATED = (("Product", "product", "product"), ("Car", "vehicle", "product"), ("Course", "course", "service"), ("Apartment", "property", "product"), ("Physician", "health", "contact"), ("MenuItem", "menu", "product"), ("Person", "person", "service"), ("Service", "service", "service"), ("AutoDealer", "business", "contact"), ("FAQPage", "faq", "faq"), ("IndividualProduct", "vehicle", "product"))
FAMILY_SQL = " ".join(f"WHEN {i} THEN '{{}}'" for i in range(len(STATED)))


@query(f"""WITH p AS (SELECT *, p_partkey % 11 AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS said FROM part)
SELECT p_partkey, CAST(place AS INT) AS place, CASE k {FAMILY_SQL.format(*(f for _, f, _ in STATED))} END AS family, CASE k {FAMILY_SQL.format(*(d for _, _, d in STATED))} END AS data_type, p_name || ' ' || place AS title,
CASE WHEN k = 9 THEN 'yes ' || p_size WHEN said IS NOT NULL THEN said WHEN k = 4 THEN p_name || ' ' || place || ' — ' || p_type WHEN k = 6 THEN p_name || ' ' || place || ' —' WHEN k = 8 THEN p_name || ' ' || place || ' — Way ' || p_size ELSE p_name || ' ' || place END AS content,
CASE WHEN k NOT IN (9) THEN CAST(p_size AS VARCHAR) END AS price, CASE WHEN k <> 9 THEN CASE p_partkey % 3 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Out of Stock' ELSE 'Backorder' END END AS availability,
CASE k WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 10 THEN p_brand WHEN 4 THEN p_type WHEN 8 THEN 'Way ' || p_size || ', Town  X1' WHEN 3 THEN CAST(p_size AS VARCHAR) END AS detail FROM p, (VALUES (0), (1)) AS two(place)""")
def structured_entities(spark, sf_dir):
    """Each part as a page that states two entities of one family, up to three lists deep."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = F.element_at(F.array(*(F.lit(t) for t, _, _ in STATED)), (key % 11 + 1).cast("int"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))

    def one(place: str) -> Column:
        name = F.concat("p_name", F.lit(f" {place}"))
        stock = F.element_at(F.array(*map(F.lit, ("https://schema.org/InStock", "OutOfStock", "http://schema.org/Backorder"))), (key % 3 + 1).cast("int"))
        parts = [F.lit('{"@type": ["Thing", '), quoted(kind), F.lit('], "name": '), quoted(name), F.lit(', "brand": {"name": '), quoted(F.col("p_brand")), F.lit('}, "medicalSpecialty": '), quoted(F.col("p_type")), F.lit(', "numberOfBedrooms": '), size]
        parts += [F.lit(', "address": {"streetAddress": "Way '), size, F.lit('", "addressLocality": "Town", "postalCode": "X1"}, "offers": {"price": '), size, F.lit(', "availability": '), quoted(stock), F.lit("}")]
        parts += [F.when(key % 11 == 10, ', "vin": "V1"').otherwise(""), F.when(key % 5 != 0, F.concat(F.lit(', "description": '), quoted(F.col("p_name")))).otherwise(""), F.lit("}")]
        faq = F.concat(F.lit('{"@type": "FAQPage", "mainEntity": [{"name": '), quoted(name), F.lit(', "acceptedAnswer": {"text": "yes '), size, F.lit('"}}]}'))
        return F.when(key % 11 == 9, faq).otherwise(F.concat(*parts))

    two = F.concat(F.lit("["), one("0"), F.lit(', {"item": '), one("1"), F.lit("}]"))
    inner = F.concat(F.lit('{"@type": "ItemList", "itemListElement": '), two, F.lit("}"))
    nested_ = F.when(key % 4 == 0, F.concat(F.lit('{"@graph": ['), inner, F.lit("]}"))).when(key % 4 == 1, inner).otherwise(F.concat(F.lit('{"@type": "OfferCatalog", "itemListElement": [{"item": {"@type": "CollectionPage", "offers": ['), inner, F.lit("]}}]}")))
    html = F.concat(F.lit('<script type="application/ld+json">'), nested_, F.lit('</script><script type="application/ld+json">{broken</script>'))
    found = structured.entities(spread(read(spark, sf_dir, "part")).select("p_partkey", F.lit("http://shop.example/").alias("url"), html.alias("html")), "p_partkey", "url", "html")
    detail = F.coalesce(*(F.col(f"details.{d}") for d in ("brand", "make", "specialty", "address", "bedrooms")))
    detail = F.when(F.col("family") == "property", F.col("details.bedrooms")).otherwise(detail)
    return found.select("p_partkey", "place", "family", "data_type", "title", "content", "price", "availability", detail.alias("detail"))


@query("SELECT c_custkey, lower(c_name) AS title, CAST(min(o_orderkey) AS VARCHAR) AS sku, count(DISTINCT o_orderstatus) AS variants FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def state_items(spark, sf_dir):
    """Each customer as a page whose scripts hold its orders, by status in a list of its own kind; one title a page stays, the first found."""
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("sku")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = F.sort_array(F.collect_list(F.struct("sku", F.col("c_name").alias("name"))))
    page = orders.groupBy("c_custkey").agg(F.to_json(rows).alias("rows"), F.size(rows).alias("variants"))
    at = F.col("c_custkey") % 4
    script = (
        F.when(at == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"a": {"b": {"products": '), "rows", F.lit("}}}}</script>"))).when(at == 1, F.concat(F.lit("<script>window.inventoryData = "), "rows", F.lit("; go()</script>")))
        .when(at == 2, F.concat(F.lit('<script>self.__next_f.push([1, "7:'), F.replace(F.col("rows"), F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))).otherwise(F.concat(F.lit('<script type="application/json">'), "rows", F.lit("</script>")))
    )
    found = structured.app_state(page.select("c_custkey", script.alias("html")), "c_custkey", "html")
    return found.join(page.select(F.col("c_custkey").alias("page"), "variants"), "page").select(F.col("page").alias("c_custkey"), F.lower("title").alias("title"), F.col("raw")["sku"].alias("sku"), F.col("variants").cast("long"))


def bundle(n: Column) -> Column:
    """Address of the script of a number: some of an application's folder, some main ones."""
    return F.concat(F.lit("https://cdn.example"), F.when(n % 10 == 0, "/js/app/s").when(n % 10 == 1, "/js/main-s").otherwise("/js/s"), n.cast("long").cast("string"), F.lit(".js"))


def tag(src: Column) -> Column:
    return F.concat(F.lit('<script src="'), src, F.lit('"></script>'))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site FROM pages), w AS (SELECT page_id, site, i, (page_id + i) % 200 AS n FROM h, range(20) AS r(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE n % 10 WHEN 0 THEN 10 WHEN 1 THEN 3 ELSE 0 END DESC, i) AS rn FROM w)
SELECT DISTINCT page_id, site || path AS route FROM (SELECT page_id, site, unnest(['/own-' || page_id, '/linked/' || page_id, '/shop/:param/' || page_id]) AS path FROM h UNION ALL SELECT page_id, site, '/size-' || p_size || '/part_' || p_partkey FROM k JOIN part ON p_partkey % 200 = n WHERE rn <= 11)""")
def script_routes(spark, sf_dir):
    """Each page loads twenty shared scripts and a chunk of its own, of which twelve count (the chunk by its folder's name is one); parts that share a remainder are in one script."""
    key = F.col("page_id")
    tags = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: tag(bundle((key + i) % 200))), "")
    data = F.concat(F.lit('<script id="__NEXT_DATA__">{"page": "/own-'), key, F.lit('", "props": {"a": [{"HREF": "/linked/'), key, F.lit('?x=1", "url": "http://else"}]}}</script>'))
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.concat(tags, data, tag(F.concat(F.lit("/_next/static/chunks/pages/shop/[id]/"), key, F.lit(".js")))).alias("html"))
    named = F.concat(F.lit('go("/size-'), "p_size", F.lit("/part_"), "p_partkey", F.lit('");'))
    parts = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 200).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(named)), "").alias("body"))
    body = F.concat(F.lit("""x(1,"/_no",'/api/no',"/static/no","/A0B1C2D3E4F5G6H7","/webpack-x","a b","/a b","/end/");"""), "body", F.lit("y('z')"))
    scripts = parts.select(bundle(F.col("n")).alias("url"), body.alias("body"))
    return routes.routes(pages, scripts, "page_id", "url", "html")


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, (2 * page_id) % 200 AS n FROM pages),
b AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'https://svc' || n || '.onrender.com/api/v2' END AS base FROM h),
e AS (SELECT page_id, unnest([site || '/api/v/' || page_id, site || '/data/' || page_id, base || '/courses', site || '/api/courses', base || '/products/' || n, site || '/products/' || n, base || '/products/' || (n + 1), site || '/products/' || (n + 1), base || '/users/search/freelancers', base || '/freelancers', base || '/gigs', base || '/services']) AS endpoint, generate_subscripts(range(12), 1) AS i FROM b)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS place, endpoint FROM e WHERE endpoint IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 10""")
def page_endpoints(spark, sf_dir):
    """Each page names two endpoints and loads two scripts, of which the first may name a backend."""
    key, n = F.col("page_id"), F.col("n")
    address = lambda n: F.concat(F.lit("/js/app/s"), n.cast("long").cast("string"), F.lit(".js"))
    html = F.concat(F.lit('<div data-api="/data/'), key, F.lit('"></div>'), tag(address((2 * key) % 200)), tag(address((2 * key) % 200 + 1)), tag(F.lit("/js/other.js")), F.lit("<script>fetch('/api/v/"), key, F.lit("'); fetch('https://sentry.io/x')</script>"))
    pages = read(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))
    body = F.concat(F.when(n % 4 == 0, F.concat(F.lit('var b="https://svc'), n, F.lit('.onrender.com/api/v2/me";'))).otherwise("var b=0;"), F.lit("q('courses');r({url: \"/products/"), n, F.lit('", s: "/products/x.js", t: "other"})'))
    scripts = pages.select(routes.origin(F.col("url")).alias("site")).distinct().select("site", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("n")).select(F.concat("site", address(n)).alias("url"), body.alias("body"))
    return routes.endpoints(pages, scripts, "page_id", "url", "html")


@query("""SELECT p_partkey, CAST(place AS INT) AS place, CASE place WHEN 0 THEN p_name ELSE p_type || ', "' || p_brand || '"' || chr(10) || '; x' END AS title, CAST(p_size AS VARCHAR) AS price, CASE place WHEN 0 THEN p_brand ELSE '' END AS brand FROM part, (VALUES (0), (1)) AS two(place)""")
def feed_records(spark, sf_dir):
    """Each part as a CSV text of two records, delimited by comma, semicolon or tab; the second record's title has all of a text's pitfalls, and its last value is missing."""
    sep = F.element_at(F.array(*map(F.lit, (",", ";", "\t"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    hard = F.concat(F.lit('"'), "p_type", F.lit(', ""'), "p_brand", F.lit('""\n; x"'))
    body = F.concat(F.lit("title"), sep, F.lit(" price "), sep, F.lit("brand\r\n\r\n"), "p_name", sep, size, sep, "p_brand", F.lit("\r\n"), hard, sep, size, F.lit("\n"))
    found = feeds.csv_items(spread(read(spark, sf_dir, "part")).select("p_partkey", body.alias("body")), "p_partkey", "body")
    return found.select("p_partkey", "place", F.col("raw")["title"].alias("title"), F.col("raw")["price"].alias("price"), F.col("raw")["brand"].alias("brand"))


@query("""SELECT page_id, page_id % 7 = 0 OR page_id % 5 = 0 OR (page_id % 3 = 0 AND length(html) + 32 < 2500) AS blocked FROM pages""")
def blocked_results(spark, sf_dir):
    """Every page as a fetch's outcome, some refused by status, some by message, some by a sign in a short body."""
    key = F.col("page_id")
    status, message = F.when(key % 7 == 0, 429).when(key % 2 == 0, 200), F.when(key % 5 == 0, "Just a Moment... please").when(key % 2 == 0, "timeout")
    body = F.concat("html", F.when(key % 3 == 0, " Verify you are HUMAN to go on..").otherwise(""))
    return read(spark, sf_dir, "pages").select("page_id", web.is_blocked(status, body, message).alias("blocked"))


@query(f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*>.*?</a>', 0, 's') AS links FROM pages), u AS (SELECT page_id, unnest(links) AS a, generate_subscripts(links, 1) AS i FROM a),
x AS (SELECT page_id, i, trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS label, trim(regexp_extract(a, '^<a [^>]*?href="([^"]*)"', 1)) AS href FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(label) ORDER BY i) AS rn FROM x WHERE href <> '' AND href[1] <> '#' AND length(label) BETWEEN 2 AND 30 AND ((href[1] = '/' AND href[:2] <> '/_' AND length(href) < 40) OR list_bool_or(list_transform([{", ".join(f"'{w}'" for w in web.SECTION_WORDS)}], lambda w: contains(lower(label), w)))))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS place, label, href FROM k WHERE rn = 1""")
def nav_sections(spark, sf_dir):
    return web.sections(read(spark, sf_dir, "pages"), "page_id", "html")


@query("""WITH u AS (SELECT c_nationkey AS site, c_custkey AS place, 'http://n' || c_nationkey || '.example/' || lower(replace(c_name, '#', '-')) AS url, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS plain FROM customer),
s AS (SELECT site, p, label, (SELECT arg_min(url, place) FROM u WHERE u.site = n.site AND contains('httpn' || n.site || 'example' || plain, regexp_replace(lower(label), '[^a-z0-9]', '', 'g'))) AS hit FROM (SELECT DISTINCT site FROM u) n, (VALUES (0, 'Customer'), (1, 'CUSTOMER'), (2, 'No  Such'), (3, '0000001'), (4, '#7'), (5, 'Never')) v(p, label)),
t AS (SELECT site, p, CASE WHEN hit IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s b WHERE b.site = s.site AND b.p < s.p AND b.hit = s.hit) THEN hit ELSE 'http://n' || site || '.example/' || regexp_replace(lower(label), '\\s+', '-', 'g') END AS url FROM s)
SELECT site, CAST(p AS INT) AS place, url FROM t WHERE p < 5""")
def section_escalation(spark, sf_dir):
    """Nations as sites whose urls are their customers; five of six missing sections are fetched again."""
    site = F.concat(F.lit("http://n"), F.col("c_nationkey").cast("string"), F.lit(".example/"))
    urls_ = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_custkey").alias("place"), F.concat(site, F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("url"))
    labels = F.array(*map(F.lit, ("Customer", "CUSTOMER", "No  Such", "0000001", "#7", "Never")))
    start = F.concat(F.lit("http://n"), F.col("site").cast("string"), F.lit(".example/home"))
    asked = urls_.select("site").distinct().select("site", start.alias("start"), F.posexplode(labels).alias("place", "label"))
    return crawl.escalated(asked, urls_)


@query("""WITH d AS (SELECT s_suppkey, s_name, s_suppkey % 4 AS k, 7 + s_suppkey % 3 AS o FROM supplier),
w AS (SELECT s_suppkey, day, CASE WHEN k = 0 AND day BETWEEN 1 AND 5 THEN lpad(o::VARCHAR, 2, '0') || ':00:00' WHEN k = 1 AND day IN (6, 0, 1) THEN '10:30:00' WHEN k = 2 AND day IN (2, 4) THEN lpad(o::VARCHAR, 2, '0') || ':15:00' END AS opens, CASE WHEN k = 0 AND day BETWEEN 1 AND 5 THEN CASE WHEN day = 3 THEN '12:00:00' ELSE '18:00:00' END WHEN k = 1 AND day IN (6, 0, 1) THEN '16:00:00' WHEN k = 2 AND day IN (2, 4) THEN '20:00:00' END AS closes FROM d, range(7) r(day))
SELECT d.s_suppkey, s_name AS name, 'T-' || d.s_suppkey AS phone, 'City' || k AS city, CASE WHEN k = 1 THEN 'CA' ELSE 'US' END AS country, CASE WHEN k < 3 THEN (SELECT string_agg(day || '=' || coalesce(opens, '-') || '/' || coalesce(closes, '-'), ' ' ORDER BY day) FROM w WHERE w.s_suppkey = d.s_suppkey) END AS week FROM d""")
def dealer_profiles(spark, sf_dir):
    """Each supplier as a dealer's site of two pages; hours are a list of texts, one text, objects, or not stated."""
    key, o = F.col("s_suppkey"), (F.lit(7) + F.col("s_suppkey") % 3).cast("string")
    hours = (
        F.when(key % 4 == 0, F.concat(F.lit(', "openingHours": ["Mo-Fr '), o, F.lit('am-6pm", "We '), o, F.lit(':00-12:00", "Su closed"]'))).when(key % 4 == 1, ', "openingHours": "Sat-Mon 10:30 - 16"')
        .when(key % 4 == 2, F.concat(F.lit(', "openingHoursSpecification": [{"dayOfWeek": ["http://schema.org/Tuesday", "Thu", "Noday"], "opens": "'), o, F.lit(':15", "closes": "8 PM"}]'))).otherwise("")
    )
    stated = F.concat(F.lit('{"@type": "AutoDealer", "name": "'), "s_name", F.lit('", "telephone": "T-'), key, F.lit('", "address": {"streetAddress": "S", "addressLocality": "City'), key % 4, F.lit('"}'), hours, F.lit("}"))
    script = lambda b: F.concat(F.lit('<script type="application/ld+json">'), b, F.lit("</script>"))
    home = F.concat(F.lit("http://s"), key, F.when(key % 4 == 1, ".ca/").otherwise(".com/"))
    pages = F.array(F.struct(F.concat(home, F.lit("a")).alias("url"), F.concat(script(F.lit('{"@type": "Product", "name": "Ford part"}')), script(stated)).alias("html")), F.struct(F.concat(home, F.lit("b")).alias("url"), script(F.lit('{"@type": "Organization", "name": "Z", "telephone": "0"}')).alias("html")))
    rows = spread(read(spark, sf_dir, "supplier")).select("s_suppkey", F.inline(pages))
    each = structured.entities(rows.select(F.struct("s_suppkey", "url").alias("page"), "url", "html"), "page", "url", "html").select("page.*", "place", "data_type", "title", "content", "description", "images", "details")
    found = dealers.profiles(each, "s_suppkey", "url")
    week = F.array_join(F.transform("hours", lambda h: F.concat(h["day"].cast("string"), F.lit("="), F.coalesce(h["opens"], F.lit("-")), F.lit("/"), F.coalesce(h["closes"], F.lit("-")))), " ")
    return found.select("s_suppkey", "name", "phone", "city", "country", week.alias("week"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Page ' || p_partkey ELSE (2000 + p_size % 20) || ' Land Rover ' || p_name END AS title, CASE WHEN p_partkey % 3 = 1 THEN 'cpo' WHEN p_partkey % 3 = 0 OR (p_partkey % 5 <> 0 AND regexp_matches(p_name, '\\bnew\\b')) THEN 'new' ELSE 'used' END AS condition, CASE WHEN p_partkey % 5 <> 0 THEN 2000 + p_size % 20 WHEN p_partkey BETWEEN 1900 AND 2099 THEN p_partkey END AS year,
CASE WHEN p_partkey % 5 <> 0 THEN 'Land Rover' END AS make, '1HGCM82633A' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS vin, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' & Co' ELSE p_brand END AS exterior_color, p_brand AS engine, 1000 * p_size AS mileage, 4 AS doors, p_retailprice AS price, CAST(p_size + 0.5 AS DOUBLE) AS city_fuel, 'http://shop.ca/i/' || p_partkey || '.png' AS image FROM part""")
def vehicle_specs(spark, sf_dir):
    """Each part as a page about one vehicle, its values in tables, lists, plain text and script."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    vin = F.concat(F.lit("1hgcm82633a"), F.lpad((key % 1_000_000).cast("string"), 6, "0"))
    head = F.when(key % 5 == 0, F.concat(F.lit("<title>Page "), key, F.lit(" | Shop</title>"))).otherwise(F.concat(F.lit("<h1 class=t>"), (2000 + F.col("p_size") % 20).cast("string"), F.lit(" <b>Land Rover</b> "), "p_name", F.lit("</h1>")))
    color = F.when(key % 2 == 0, F.concat(F.lit("<dt>Exterior Colour</dt><dd>"), "p_type", F.lit(" &amp; Co</dd>"))).otherwise(F.concat(F.lit("<li>Color:<b>Grey</b></li><li>Paint: "), "p_brand", F.lit("</li>")))
    body = [F.lit("<table><tr><th> VIN: </th><td>not yet</td></tr></table><script>x({'vin': '"), vin, F.lit("', \"mileage\": 7})</script>"), color, F.lit("<p>Kilometers: "), size, F.lit(",000 km</p><p>Doors: 4</p><p>City</p><p>"), size, F.lit(".5 l</p><p>Engine: "), "p_brand"]
    body += [F.lit('</p><span class="x selling-price big">$ '), F.format_number("p_retailprice", 2), F.lit('</span><img src="logo.png"><img alt="a" data-src="/i/'), key, F.lit('.png">'), F.element_at(F.array(*map(F.lit, ("Brand New", "certified", "renewed"))), (key % 3 + 1).cast("int"))]
    found = vehicle_pages.vehicles(spread(read(spark, sf_dir, "part")).select("p_partkey", F.lit("http://shop.ca/p").alias("url"), F.concat(head, *body).alias("html")), "p_partkey", "url", "html")
    return found.select("p_partkey", "title", "condition", "year", "make", "vin", "exterior_color", "engine", "mileage", "doors", "price", "city_fuel", F.array_join("images", " ").alias("image"))


@query("""SELECT p_partkey, CAST(place AS INT) AS place, CASE place WHEN 0 THEN p_name ELSE p_brand || ' course & more' END AS title, CASE WHEN place = 0 AND p_partkey % 2 = 0 THEN 'http://s.example/p/' || p_partkey ELSE 'http://s.example/list' END AS url, CASE WHEN place = 0 THEN 'product' ELSE 'service' END AS data_type,
CASE WHEN place = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '$ ' || p_size ELSE p_size || ' a piece' END END AS price, CASE WHEN place = 1 THEN 'http://s.example/i.png' END AS image, CASE WHEN place = 0 THEN 'Of type ' || p_type || '.' END AS description FROM part, (VALUES (0), (1)) AS two(place)""")
def page_cards(spark, sf_dir):
    """Each part as a list page: a product's card, a course's card, a repeated title, furniture and a card that shows nothing."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    price = F.when(key % 2 == 0, F.concat(F.lit("<i>$ "), size, F.lit("</i>"))).otherwise(F.concat(F.lit('<i class="big-price">'), size, F.lit(" a piece</i>")))
    link = F.when(key % 2 == 0, F.concat(F.lit('<a href="/p/'), key, F.lit('">x</a>'))).otherwise('<a href="#top">x</a><a href="http://else.example/">y</a>')
    one = [F.lit('<div class="product-list"><div class="my-card"><span class="item-name">'), "p_name", F.lit("</span>"), price, link, F.lit("<p>Of type <b>"), "p_type", F.lit("</b>.</p></div>")]
    two = [F.lit("<li id='course-1'><div><h3>"), "p_brand", F.lit(' course &amp; more</h3><img data-src="i.png"></div></li>')]
    rest = [F.lit('<article class="box"><h2>'), F.upper("p_name"), F.lit('</h2><p>repeated, so it does not count</p></article><div class="card"><h2>Loading</h2><p>furniture of the page, no card</p></div><div class="card"><h2>Nothing beside it</h2><a href="#">nothing to see here</a></div></div>')]
    found = cards.cards(spread(read(spark, sf_dir, "part")).select("p_partkey", F.lit("http://s.example/list").alias("url"), F.concat(*one, *two, *rest).alias("html")), "p_partkey", "url", "html")
    return found.select("p_partkey", "place", "title", "url", "data_type", "price", "image", "description")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, NULL::VARCHAR AS still_listed FROM part")
def projected_scan(spark, sf_dir):
    return inventory.projected(read(spark, sf_dir, "part"), {"p_partkey": "bigint", "p_size": "bigint", "still_listed": "string"})


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN ' ' || chr(10) WHEN turn % 3 = 0 THEN repeat(text, 4) ELSE text END AS x FROM conversations), t AS (SELECT *, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS plain FROM m),
e AS (SELECT *, CASE WHEN coalesce(plain, '') = '' THEN 'empty' WHEN length(plain) > 300 THEN 'too_long' END AS error FROM t) SELECT conv_id, turn, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN plain END AS sanitized FROM e""")
def message_checks(spark, sf_dir):
    x = F.when(F.col("turn") % 5 == 0, " \n").when(F.col("turn") % 3 == 0, F.repeat("text", F.lit(4))).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.message(x, 300).alias("m")).select("conv_id", "turn", "m.*")


@query("""WITH s AS (SELECT c_custkey AS id, c_nationkey AS u, c_custkey % 50 AS created, unnest(['shop' || (c_custkey % 20) || '.example', 'b' || (c_custkey % 7) || '.example']) AS d FROM customer),
n AS (SELECT u, d, max(struct_pack(created := created, id := id)) AS s FROM s GROUP BY u, d), q AS (SELECT o_orderkey AS request, o_custkey % 25 AS u, 'shop' || (o_orderkey % 30) || '.example' AS d FROM orders),
f AS (SELECT u, d, min(request) AS first FROM q GROUP BY u, d)
SELECT request, CASE WHEN s IS NULL AND first = request THEN 'insert' ELSE 'reuse' END AS action, s.id AS site_id, CASE WHEN s IS NULL THEN first END AS made_by, d AS name, CASE WHEN request % 3 <> 0 THEN 'shopify' WHEN s IS NULL THEN 'unknown' ELSE 'p' || s.id END AS platform, CASE WHEN request % 2 = 0 THEN 'daily' WHEN s IS NULL THEN 'off' ELSE 'weekly' END AS frequency FROM q LEFT JOIN n USING (u, d) JOIN f USING (u, d)""")
def connected_sites(spark, sf_dir):
    """Orders as requests to connect a shop, customers as the sites there are."""
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    domain = lambda head, n: F.concat(F.lit(head), n.cast("string"), F.lit(".example"))
    name = domain("shop", key % 30)
    requests = read(spark, sf_dir, "orders").select(key.alias("request"), (F.col("o_custkey") % 25).alias("user"), F.concat(F.lit(" "), F.upper(name)).alias("domain"), F.concat(name, F.lit(" ")).alias("name"), F.when(key % 3 != 0, "shopify").otherwise("unknown").alias("platform"), F.when(key % 2 == 0, "daily").otherwise("off").alias("frequency"))
    sites = read(spark, sf_dir, "customer").select(cust.alias("id"), F.col("c_nationkey").alias("user"), F.array(domain("Shop", cust % 20), domain("b", cust % 7)).alias("domains"), F.concat(F.lit("p"), cust.cast("string")).alias("platform"), F.lit("weekly").alias("frequency"), (cust % 50).alias("created"))
    return changes.connected_sites(requests, sites)
