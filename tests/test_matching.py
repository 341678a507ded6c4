"""Matching of entities with claimed rows, against the scan it stands for."""

import random

import pytest

from loomwright.operators import matching, ordered
from loomwright.operators.scratch import materialise


def scan(incoming, existing, fits):
    taken, out = set(), []
    for i in sorted(incoming):
        for e in sorted(existing):
            if e not in taken and fits(incoming[i], existing[e]):
                taken.add(e)
                out.append((i, e))
                break
    return sorted(out)


@pytest.mark.parametrize(("few", "hub_rows"), [(0, 10**6), (60, 20), (10**6, 10**6)])
def test_claimed_by_hubs(spark, few, hub_rows):
    rng = random.Random(few)
    hubs = lambda: {f"h{int(rng.random() ** 2 * 15)}" for _ in range(rng.randint(0, 3))}  # noqa: E731  few hubs, some of them common
    incoming, existing = {i: hubs() for i in range(40)}, {e: hubs() for e in range(35)}
    for i in range(40, 120):
        incoming[i] = {"hot"}
        existing[i] = {"hot", "own"} if i % 10 == 0 else {"hot"}
    frame = lambda rows: spark.createDataFrame([(h, i) for i, hs in rows.items() for h in hs] + [(None, 5)], "hub string, id long")
    got = sorted((r.i, r.e) for r in matching.claimed(frame(incoming), frame(existing), few, hub_rows).collect())
    assert got == scan(incoming, existing, lambda a, b: bool(a & b))


def test_chains_of_competing_rows_need_few_rounds(spark, monkeypatch):
    """Each row's place hangs on the row before: rounds alone would settle one pair at a time."""
    rounds, firmed = [], matching.firmed
    monkeypatch.setattr(matching, "firmed", lambda pairs, live: rounds.append(1) or firmed(pairs, live))
    n = 25
    incoming = spark.createDataFrame([(f"h{h}", i) for i in range(n) for h in (i, i + 1)], "hub string, id long")
    existing = spark.createDataFrame([(f"h{e}", e) for e in range(n)], "hub string, id long")
    assert sorted(tuple(r) for r in matching.claimed(incoming, existing, 0).collect()) == [(i, i) for i in range(n)]
    assert len(rounds) <= 3


def test_claimed_by_blocks(spark):
    """Blocks of a few links on both sides, also where what fits lies blocks away, and ids below 0."""
    rng = random.Random(5)
    hubs = lambda: {f"h{int(rng.random() ** 2 * 12)}" for _ in range(rng.randint(0, 3))}
    incoming, existing = {i - 20: hubs() for i in range(60)}, {e - 10: hubs() for e in range(50)}
    incoming |= {100 + i: {f"far{i}"} for i in range(10)} | {200 + i: {"h0"} for i in range(20)}
    existing |= {-100 - e: {f"far{e}"} for e in range(10)} | {300 + e: {"h1", "none"} for e in range(20)}
    frame = lambda rows: spark.createDataFrame([(h, i) for i, hs in rows.items() for h in hs], "hub string, id long")
    got = sorted(tuple(r) for r in matching.claimed(frame(incoming), frame(existing), block=25).collect())
    assert got == scan(incoming, existing, lambda a, b: bool(a & b))


FIELDS = "id long, sku string, shopify_id string, woo_id string, external_id string, title string, entity_type string, source_url string"


def fits(a, b):
    """The rules in words: a shop number, an id at a platform, title with type, or the url where titles agree."""
    low = lambda x: (x or "").strip().lower()
    at = lambda u: ("" if not u else (u if u.startswith("http") else "https://" + u).split("://", 1)[1].split("?")[0].rstrip("/").lower())
    if low(a[0]) and low(a[0]) == low(b[0]) or any(a[k] and a[k] == b[k] for k in (1, 2, 3)):
        return True
    s, t = low(a[4]), low(b[4])
    if s and s == t and (a[5] or "product") == (b[5] or "product"):
        return True
    return bool(at(a[6])) and at(a[6]) == at(b[6]) and (s in t or t in s)


@pytest.mark.parametrize("seed", range(2))
def test_matched_entities(spark, seed):
    rng = random.Random(seed)
    some = lambda *xs: rng.choice(xs)
    titles = ["Red car", "car", "red", "a", "", None, "Blue red car", "Scarf", "ab", "Table", " TABLE "]
    row = lambda n: (some(None, "", f"S{rng.randint(0, 30)}", f" s{rng.randint(0, 30)}"), some(None, None, f"p{rng.randint(0, 40)}"), some(None, ""), some(None, None, "x1"), rng.choice([*titles, f"t{n}"]), some(None, "", "service"), some(None, "http://a.b/x", "https://a.b/x/", "A.b/y?q", "https://a.b/z"))
    incoming, existing = {n: row(n) for n in range(90)}, {n: row(n) for n in range(80)}
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in rows.items()], FIELDS).repartition(3)
    got = sorted((r.i, r.e) for r in matching.matched_entities(frame(incoming), frame(existing)).collect())
    assert got == scan(incoming, existing, fits)


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], FIELDS)
    one = spark.createDataFrame([(1, "s", None, None, None, "t", None, None)], FIELDS)
    assert matching.matched_entities(none, one).count() == 0 and matching.matched_entities(one, none).count() == 0
    assert [tuple(r) for r in matching.matched_entities(one, one).collect()] == [(1, 1)]


def test_places_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", (i * 7919) % 5000) for i in range(5000)]
    got = ordered.numbered(materialise(spark.createDataFrame(rows, "key string, at long")), "key", "at", range_=300).collect()
    want = {}
    for key, at in sorted(rows):
        want.setdefault(key, []).append(at)
    assert len(got) == 5000 and all(want[r.key][r.place] == r["at"] for r in got)
