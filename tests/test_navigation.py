"""Navigation targets over the inverted index, against scoring of every pair."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomwright.functions import concepts
from loomwright.operators import navigation as nav
from loomwright.operators.scratch import materialise


def plain(s):
    s = "".join(c for c in unicodedata.normalize("NFD", (s or "").lower()) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z0-9]+", " ", s).split())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def typo(a, b):
    if a == b:
        return True
    lo, hi, apart = min(len(a), len(b)), max(len(a), len(b)), abs(len(a) - len(b))
    if lo < 4:
        return False
    if lo == 4:
        return apart <= 1 and (a.startswith(b[:3]) or b.startswith(a[:3])) and edits(a, b) <= 1
    return apart <= (1 if hi <= 6 else 2) and edits(a, b) <= (1 if hi <= 6 else 2)


NAMED = [(c, concepts.plain_name(a)) for c, xs in concepts.ALIASES.items() for a in xs]


def concept(term):
    p = plain(term)
    whole = [c for c, a in NAMED if a == p]
    words = [c for w in p.split() if len(w) >= 2 for c, a in NAMED if typo(w, a)]
    return whole[0] if p and whole else words[0] if words else None


def related(a, b):
    a, b = plain(a), plain(b)
    if not a or not b:
        return False
    ca, cb = concept(a), concept(b)
    return a == b or bool(ca) and ca == cb or any(c == ca and typo(x, b) for c, x in NAMED) or any(c == cb and typo(x, a) for c, x in NAMED)


def scored(target, query, d):
    """d: url, title, kind. Score and whether exact, by the rules in words."""
    p, tokens, path = plain(target), [w for w in plain(target).split() if len(w) >= 2], re.sub(r"^[a-z]+://[^/?#]*([^?#]*).*", r"\1", d[0], flags=re.I) or "/"
    parts = [x for x in path.split("/") if x]
    slug = parts[-1] if parts else ""
    title = d[1] or slug or "Page"
    clean = re.sub(r"\s*[—–|•:-]\s*[^—–|•:-]+$", "", title).strip()
    kind, standard = (d[2] or "text").lower(), slug.lower() in nav.SLUGS
    deep = not standard and (len(parts) >= 2 or kind in nav.ENTITY_TYPES)
    page = len(parts) <= 1 or standard or kind in nav.PLAIN_TYPES or not deep
    entity = deep or not page
    has = lambda words: bool(re.search(r"\b(?:" + "|".join(words) + r")\b", query.lower()))
    whole, key, asked = target.lower() in nav.WHOLE, d[0].rstrip("/").lower(), target.rstrip("/").lower()
    score, exact = 0, False

    def add(test, points):
        nonlocal score, exact
        score, exact = score + (points if test else 0), exact or bool(test)
        return bool(test)

    add(p in nav.HOME and (path in ("/", "") or slug in ("", "index.html")), 1000)
    if not add(asked and key.endswith(asked), 1000):
        add(path.lower() == "/" + p or path.lower() == "/" + slug.lower() and p == plain(slug), 950)
    pc = plain(clean)
    if not add(pc and p and p in (pc, plain(title)), 1000):
        add(pc and p and p in pc, 950)
    add(slug and plain(slug) and p and (plain(slug) == p or slug.lower() == p.replace(" ", "-")), 900)
    add(page and (whole or concept(target) in nav.INFORMING) and any(related(target, x) for x in (slug, clean, path[1:])), 900)
    if tokens:
        slugs, all_ = [w for w in plain(slug).split() if len(w) >= 2], [w for w in plain(clean).split() + plain(slug).split() if len(w) >= 2]
        t = sum(x in all_ or x in pc or any(typo(w, x) for w in all_ + pc.split()) for x in tokens) / len(tokens)
        s = sum(x in slugs or x in slug.lower() or any(typo(w, x) for w in [*slugs, slug.lower()]) for x in tokens) / len(tokens)
        score += 850 if t >= 1 else int(t * 550 + 0.5) if t >= 0.6 else 0
        exact |= t >= 1 and entity
        score += 700 if s >= 1 else int(s * 400 + 0.5) if s >= 0.5 else 0
        score += 250 * sum(len(x) >= 4 and any(typo(w, x) and w != x for w in all_) for x in tokens)
    if whole:
        score, exact = score + (350 if page else -500), exact or page
    else:
        if entity and score >= 700:
            score, exact = score + 200, True
        elif page and not has(nav.PAGE_WORDS) and tokens:
            score -= 200
        score += (200 if page else -400) if has(nav.PAGE_WORDS) else 0
        score += (200 if entity else -300) if has(nav.ENTITY_WORDS) else 0
    return score, exact


@pytest.mark.parametrize("seed", [1, 2])
def test_resolved(spark, seed):
    rng = random.Random(seed)
    words = "wrangler wranglers rubicon leetcode mastery about contact privacy policy courses jeep grand cherokee leet code scarf car faq terms python pythons a to".split()
    some = lambda n: [rng.choice(words) for _ in range(n)]
    places = [(i, rng.choice(["s", "t"]), "https://x.com/" + "/".join("-".join(some(rng.randint(1, 2))) for _ in range(rng.randint(0, 2))), rng.choice([None, " ".join(some(rng.randint(1, 4))).title(), " ".join(some(2)).title() + " | Shop"]), rng.choice([None, "vehicle", "page", "course"])) for i in range(40)]
    twist = lambda w: w if len(w) < 5 or rng.random() < 0.6 else w[:2] + w[3:]
    asked = [(i, rng.choice(["s", "t"]), rng.choice(["take me to the ", "open ", "", "Please go to ", "show me the page for "]) + " ".join(twist(w) for w in some(rng.randint(1, 3))) + rng.choice(["", " page", "?", " course", " section"])) for i in range(60)]
    asked += [(100, "s", "home"), (101, "t", "all courses"), (102, "s", ""), (103, "s", "javascript:alert(1)"), (104, "s", "https://x.com/y"), (105, "s", "https://evil.org/"), (106, "s", "//x.com"), (107, "u", "about us"), (108, "s", "who are you"), (109, "s", "https://sub.x.com/y"), (110, "s", "http://10.0.0.1/"), (111, "s", None)]
    target = {r.i: r.t for r in spark.createDataFrame([(i, q) for i, _, q in asked], "i long, q string").select("i", nav.target_of("q").alias("t")).collect()}
    got = {r.query_id: r for r in nav.resolved(
        spark.createDataFrame(asked, "query_id long, site string, query string").repartition(3),
        spark.createDataFrame([(*p, False, None) for p in places], "id long, site string, url string, title string, entity_type string, priced boolean, facts string").repartition(3),
    ).collect()}
    assert len(got) == len(asked)
    seen, unique = set(), []
    for p in places:
        key = (p[1], p[2].rstrip("/").lower())
        if key not in seen:
            seen.add(key)
            unique.append(p)
    for i, site, query in asked:
        if i in (102, 103, 104, 105, 106, 109, 110, 111):
            continue
        ranked = sorted(((not e, -s, d[0], d[2]) for d in unique if d[1] == site for s, e in [scored(target[i], query, d[2:])] if s >= 450))
        if not ranked:
            assert got[i].status == "not_found", (query, got[i])
            continue
        first = ranked[0]
        assert (got[i].id, got[i].score) == (first[2], -first[1]), (query, target[i], got[i], ranked[:3])
        unsure = first[0] and len(ranked) > 1 and ranked[1][1] - first[1] < 120
        want = "ambiguous" if unsure else "exact" if not first[0] or -first[1] >= 800 else "partial" if -first[1] >= 500 else "not_found"
        assert got[i].status == want and (not unsure or got[i].options == [r[3] for r in ranked[:4]])
    assert [got[i].status for i in (102, 103, 104, 105, 106, 109, 110, 111)] == ["not_found", "invalid_url", "exact", "invalid_url", "invalid_url", "exact", "invalid_url", "not_found"]


def test_targets(spark):
    says = {"Take me to the Contact page?": "Contact", "please open up the page for Jeep Wrangler!": "Jeep Wrangler", "where can I learn about the team": "team", "Leetcode Mastery course page.": "Leetcode Mastery", "pricing": "pricing"}
    got = spark.createDataFrame([(s,) for s in says], "s string").select("s", nav.target_of("s").alias("t")).collect()
    assert {r.s: r.t for r in got} == says


def test_numbers_are_not_typed_wrongly(spark):
    places = [("s", i, f"http://a.b/en/{n}", f"Garden {i}", "text", False, None) for i, n in enumerate((7198, 7197, 50447, 31689, 8765))]
    asked = [("s", i, f"Take me to the en {n} page") for i, n in enumerate((7198, 50477, 32689, 8765))] + [("s", 4, "take me to gardne 2")]
    got = nav.resolved(spark.createDataFrame(asked, "site string, query_id int, query string"), spark.createDataFrame(places, "site string, id int, url string, title string, entity_type string, priced boolean, facts string"))
    assert sorted((r.query_id, r.status, r.id) for r in got.collect())[:4] == [(0, "exact", 0), (1, "not_found", None), (2, "not_found", None), (3, "exact", 4)]


def test_pairs_grow_with_requests(spark, monkeypatch):
    """A word that all destinations of a site share leads to no pair of its own: each request is scored at the few that have its rarer word too."""
    places = [("s", i, f"http://a.b/en/{1000 + i}", f"Garden {i}", "text", False, None) for i in range(300)]
    asked = [("s", i, f"Take me to the en {1000 + i} page") for i in range(300)]
    written = []
    monkeypatch.setattr(nav, "materialise", lambda df: written.append(out := materialise(df)) or out)
    got = nav.resolved(spark.createDataFrame(asked, "site string, query_id int, query string"), spark.createDataFrame(places, "site string, id int, url string, title string, entity_type string, priced boolean, facts string"))
    assert all((r.status, r.id) == ("exact", r.query_id) for r in got.collect())
    pairs = [df.count() for df in written if df.columns == ["site", "query_id", "place"]]
    assert max(pairs) <= 2 * len(asked)


def test_words_needed(spark):
    def most(m, n):
        t = m / n
        points = (850 if t >= 1 else int(t * 550 + 0.5) if t >= 0.6 else 0) + (700 if t >= 1 else int(t * 400 + 0.5) if t >= 0.5 else 0)
        return points + (200 if points >= 700 else 0)

    rows = [(n, extra) for n in range(1, 9) for extra in (0, 200, 350, 400)]
    for least in (450, 700, 2000):
        got = spark.createDataFrame(rows, "n int, extra int").select("n", "extra", nav.needed(F.col("n"), F.col("extra"), least).alias("m")).collect()
        assert {(r.n, r.extra): r.m for r in got} == {(n, x): next((m for m in range(1, n + 1) if most(m, n) + x >= least), n) for n, x in rows}


def test_whole_title_and_accented_url(spark):
    """A target that is the title with the site's name, or the end of a url with accents, finds its destination."""
    places = [("s", 0, "http://a.b/café/x", "Menu", "page", False, None), ("s", 1, "http://a.b/p", "Garden | Old Mill Shop", "page", False, None)]
    asked = [("s", 0, "open café/x"), ("s", 1, "open garden old mill shop")]
    got = nav.resolved(spark.createDataFrame(asked, "site string, query_id int, query string"), spark.createDataFrame(places, "site string, id int, url string, title string, entity_type string, priced boolean, facts string"))
    assert sorted((r.query_id, r.status, r.id) for r in got.collect()) == [(0, "exact", 0), (1, "exact", 1)]
