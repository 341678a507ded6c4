"""Top-k search, Merkle manifests and vector codes against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import merkle_manifest, topk_search, vector_codes


def brute_top(rows, k, every):
    """rows: (id, list of ints or None). Multiset of (query_id, rank, vec_id, score)."""
    fine = [(i, v) for i, v in rows if v is not None and None not in v and sum(x * x for x in v) < 2**62 - 2**33]
    out = []
    for a, (i, v) in enumerate(fine):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0) for b, (j, w) in enumerate(fine) if a != b and len(v) == len(w))
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("block", "queries", "head"), [(8192, 2048, 2048), (13, 5, 30)])
def test_top_k(spark, block, queries, head):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 8) * int(rng.choice([1, 1, 3, 40]))]) for i in range(300)]
    near = rows[7][1]
    rows += [(300 + i, [x + int(d) for x, d in zip(near, rng.integers(-2, 3, 8), strict=True)]) for i in range(40)]  # high cosines: coordinates prune
    rows += [(400 + i % 20, [9] * 8) for i in range(150)]  # copies, ties, ids given to several rows
    rows += [(600, None), (601, [1, None, 3, 4, 5, 6, 7, 8]), (610, []), (620, []), (630, [0] * 8), (640, [1, 2]), (650, [2, 1]), (None, [9] * 8), (660, [2**31 - 1] * 8), (670, [2**29, -(2**28), 5, 0, 0, 0, 0, 1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, v array<int>, score string").repartition(5)
    got = topk_search.top_k(df, F.col("vec_id") % 10 == 0, 4, "vec_id", "v", block, queries, head)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_top(rows, 4, 10)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 4, "vec_id").count() == 0
    assert topk_search.top_k(df, F.lit(False), 4, "vec_id").count() == 0


def test_coordinates_prune():
    rng = np.random.default_rng(6)
    x = rng.integers(-60, 60, (4000, 16))
    x[:30] = x[0] + rng.integers(-3, 4, (30, 16))
    x = np.rint(200 * x / np.linalg.norm(x, axis=1)[:, None]).astype(int)  # of like length, as in a bucket
    block = topk_search.Block(np.arange(4000), np.arange(4000), x, np.sqrt((x * x).sum(axis=1)))
    q = x[:1]
    low = int(np.sort(x @ q[0])[-12])
    found = list(topk_search.answers(block, np.array([-1]), q, np.sqrt((q * q).sum(axis=1)).astype(float), [low], 10))
    want = sorted((-int(s), i) for i, s in enumerate(x @ q[0]))[:10]
    assert [(int(-s), int(block.ids[p])) for p, s in zip(found[0][1], found[0][2], strict=True)] == want
    assert block.pruned > 0.9 * block.reach(np.array([low / np.linalg.norm(q)]))[0]


def test_quantised(spark):
    df = spark.createDataFrame([([0.5, -0.01],), ([float("nan")],), ([float("inf")],), ([None, 1.0],), (None,), ([],), ([1e30],)], "v array<double>")
    assert [r[0] for r in df.select(topk_search.quantised(F.col("v"), 64)).collect()] == [[32, -1], None, None, None, None, [], None]


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_tree(leaves):
    """Root, and for each leaf its path as (before, after) a level."""
    level, paths, own = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(own):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[i].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        level = [h("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
        own = [at // 8 for at in own]
    return level[0], paths


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    sizes = {None: 1, "": 9, "a": 64, "b": 65, "ü": 700, "z": 2, **{f"g{i}": 1 for i in range(70)}}
    rows = [(None if g == "z" and i else i // 2 if g == "b" else i, g, h(f"{g}{i}"), f"{g}/{i}") for g, n in sizes.items() for i in range(n)]
    rows += [(1, "a", h("same"), "twice")] * 3
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, lang string, leaf string, tag string, path string").repartition(7)
    out = merkle_manifest.manifest(df.drop("path"), "id", "lang", ["id", "tag", "lang"], levels=levels, range_=40)
    out = out.withColumn("again", merkle_manifest.folded(F.col("leaf"), F.col("path"))).withColumn("all", merkle_manifest.siblings(F.col("path"))).collect()
    groups = {}
    for i, g, leaf, _ in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([leaf for *_, leaf in sorted(groups[g])]) for g in order}
    root, above = brute_tree([trees[g][0] for g in order])
    want = [(g, leaf, trees[g][0], "".join(a + b for a, b in path + above[order.index(g)])) for g in order for (*_, leaf), path in zip(sorted(groups[g]), trees[g][1], strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r.lang, r.leaf, r.subroot, r.all)) for r in out)
    assert {r.root for r in out} == {root} == {r.again for r in out}
    assert merkle_manifest.manifest(df.drop("path").limit(0), "id", "lang", ["id"]).count() == 0


def test_traversal_holds_little():
    for n in (1, 2, 8, 9, 63, 64, 65, 512, 700, 4096):
        leaves = [h(str(i)) for i in range(n)]
        root, paths = brute_tree(leaves)
        levels = merkle_manifest.height(n)
        assert merkle_manifest.top(leaves, levels) == root
        assert [[(x["before"], x["after"]) for x in path] for path in merkle_manifest.traversal(leaves, levels)] == paths
    tree, most = merkle_manifest.Treehash(3), 0
    for leaf in leaves:
        tree.take(leaf)
        most = max(most, sum(map(len, tree.stack[:-1])))
    assert most <= 3 * 8


def test_leaf(spark):
    df = spark.createDataFrame([(7, None, "ü"), (None, "", "a:1")], "id long, s string, t string")
    assert [r[0] for r in df.select(merkle_manifest.leaf_of(F.col("id"), F.col("s"), F.col("t"))).collect()] == [h("1:7-2:ü"), h("-0:3:a:1")]


def test_tampering_is_found(spark, tmp_path):
    from loomwright.llm.queries import op12_merkle_manifest

    rows = [(i, f"Text {i}" if i % 4 else None if i % 8 else "small", f"l{i % 3}", "s", i) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.verified for r in op12_merkle_manifest(spark, str(tmp_path)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 != 0 or i % 4 == 0 for i in range(100)}


def brute_codes(rows, k, rounds):
    fine = [(i, label, v) for i, label, v in rows if v is not None and None not in v]
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:k]
    width = len(first[0][2])
    fine = [r for r in fine if len(r[2]) == width]
    first = [r for r in sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:k]]
    where = vector_codes.cuts(width, 4)
    books = [[list(r[2][s]) for r in first] for s in where]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[s], c, strict=True)), j) for j, c in enumerate(book)) for s, book in zip(where, books, strict=True)] for *_, v in fine]

    for _ in range(rounds):
        codes = assigned()
        for p, s in enumerate(where):
            for j in range(len(first)):
                own = [v[s] for (*_, v), c in zip(fine, codes, strict=True) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assigned()
    sha = h(",".join(str(c) for book in books for e in book for c in e))
    total = {}
    for (_, label, _), c in zip(fine, codes, strict=True):
        total[label] = total.get(label, 0) + sum(d for d, _ in c)
    return sorted(repr((i, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), total[label], sha)) for (i, label, _), c in zip(fine, codes, strict=True))


@pytest.mark.parametrize(("width", "spread"), [(8, 4), (10, 1000), (4, 2)])
def test_codes(spark, width, spread, monkeypatch):
    rng = np.random.default_rng(width)
    rows = [(int(i), int(i) % 3 if i % 7 else None, [int(x) for x in rng.integers(-spread, spread, width)]) for i in rng.permutation(400)]
    rows += [(5, 1, rows[0][2])] * 60 + [(None, None, [0] * width), (900, 2, None), (901, 2, [None] * width), (902, 1, [1] * (width + 1))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, v array<int>, code string").repartition(5)
    got = vector_codes.compress(df, k=20, rounds=3)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_codes(rows, 20, 3)
    if width == 4:
        monkeypatch.setattr(vector_codes, "BROADCAST", 0)
        assert sorted(repr(tuple(r)) for r in vector_codes.compress(df, k=20, rounds=3).collect()) == brute_codes(rows, 20, 3)
        few = vector_codes.compress(df.where("vec_id < 6"), k=256, rounds=2)
        assert few.where("error > 0").count() == 0 and vector_codes.compress(df.limit(0)).count() == 0


def test_bounds_prune_and_stay_right():
    rng = np.random.default_rng(8)
    centers = rng.integers(-3000, 3000, (40, 16))
    x = centers[rng.integers(0, 40, 3000)] + rng.integers(-200, 200, (3000, 16))
    book = x[:64].copy()
    entry, upper, lower = vector_codes.from_all(x, book)
    worked = []
    for _ in range(5):
        new = np.array([x[entry == j].sum(axis=0) // max((entry == j).sum(), 1) if (entry == j).any() else book[j] for j in range(64)])
        moved = np.sqrt(((new - book) ** 2).sum(axis=1).astype(float))
        codes, most = vector_codes.packed(lower)
        shown = vector_codes.unpacked(codes, most)
        assert (shown <= lower).all()
        worked.append(vector_codes.reassign(x, vector_codes.Book(new, moved), entry, upper, shown))
        book, lower = new, shown
        d2 = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (entry == d2.argmin(axis=1)).all() and (lower <= np.sqrt(d2)).all() and (upper >= np.sqrt(d2.min(axis=1))).all()
    assert max(worked) < 0.3 * x.shape[0] * 64 and worked[-1] < worked[0]
