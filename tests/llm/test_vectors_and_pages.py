"""Vectors and web pages against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayfold.llm import ann_forest, components, nn_descent, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def test_components(spark):
    rng = random.Random(1)
    pairs = [(a, a + 1) for a in range(0, 60) if a % 7] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def odd_vectors(rng):
    rows = [(k, rng.standard_normal(8).astype(np.float32).tolist(), int(k % 2)) for k in range(120)]
    for k in range(120, 160):
        base = rows[k % 4][1]
        rows.append((k, (np.array(base) + 0.01 * rng.standard_normal(8)).astype(np.float32).tolist(), rows[k % 4][2]))
    rows += [(k, rows[5][1], 1) for k in range(160, 175)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 0), (203, [None] + [1.0] * 7, 0), (204, rows[0][1], None), (205, [1.0], 1)]
    return rows


def test_near_duplicates(spark):
    rows = odd_vectors(np.random.default_rng(2))
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), x) for i, v, x in rows if i < 200]
    near = {i: [j for j, w, y in good if j != i and x == y and v @ w >= 0.93] for i, v, x in good}
    for i, *_ in rows:
        assert got[i].n_links == len(near.get(i, []))
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)
    assert nn_descent.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_pieces_of_a_component_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "PIECE", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(k, (base + 0.02 * rng.standard_normal(8)).astype(np.float32).tolist(), 1) for k in range(90)]
    assert all(r.n_links == 89 for r in nn_descent.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())


def test_tables_follow_width_and_threshold():
    same = 1 - np.arccos(0.93) / np.pi
    for rows in (10, 3_000, 100_000, 10**6, 10**8):
        width, tables = nn_descent.shape(rows, 0.93)
        assert 1 - (1 - same**width) ** tables >= 0.999


def test_lone_pairs_meet_in_narrow_buckets(spark, monkeypatch):
    """Pairs at the threshold without any other neighbour, with buckets as narrow as those of a large label."""
    monkeypatch.setattr(nn_descent, "PER_BUCKET", 0.25)
    monkeypatch.setattr(nn_descent, "REPAIRS", 1)
    rng, rows = np.random.default_rng(6), []
    for k in range(400):
        a, b = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
        rows += [(2 * k, a.tolist(), k % 2), (2 * k + 1, (0.932 * a + np.sqrt(1 - 0.932**2) * b).tolist(), k % 2)]
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert sum(r.n_links == 1 for r in got) >= 796


def test_audit_sees_lone_pairs_beside_a_crowd(spark, monkeypatch):
    """One-link nodes that no bucket joined count as much as a crowded component; a failed audit stops the job."""
    rng, base = np.random.default_rng(7), np.eye(1, 16)[0]
    crowd = [(k, (base + 0.01 * rng.standard_normal(16)).tolist(), 1) for k in range(300)]
    lone = []
    for k in range(300, 360, 2):
        v = rng.standard_normal(16)
        lone += [(k, v.tolist(), 1), (k + 1, (v + 0.001 * rng.standard_normal(16)).tolist(), 1)]
    nodes = nn_descent.pack(spark.createDataFrame(crowd + lone, VECTORS), "vec_id", "embedding", "label")
    nodes = nodes.select(F.col("id").alias("node"), "label", "vector", F.lit(1).cast("long").alias("mult"))
    counted = spark.createDataFrame([(k, 299) for k in range(300)], "node long, others long")
    shares = nn_descent.audit(nodes, counted, 0.93)
    assert shares == [(300, 300), (300, 360)]
    monkeypatch.setattr(nn_descent, "audit", lambda *_: [(0, 0), (300, 360)])
    with pytest.raises(RuntimeError, match="300, 360"):
        nn_descent.near_duplicates(spark.createDataFrame(lone, VECTORS)).collect()


@pytest.mark.parametrize("piece", [1_024, 60])
def test_crowded_groups_keep_their_cross_links(spark, monkeypatch, piece):
    """Two tight groups with cross cosine 0.94 fill every list with own members; also with buckets in several pieces."""
    monkeypatch.setattr(nn_descent, "WHOLE", 2 * piece, raising=False)
    monkeypatch.setattr(nn_descent, "PIECE", piece)
    rng = np.random.default_rng(8)
    a, b = np.eye(2, 24)
    b = 0.94 * a + np.sqrt(1 - 0.94**2) * b
    groups = [c + 0.0005 * rng.standard_normal((110, 24)) for c in (a, b)]
    outsider = [(k, rng.standard_normal(24).tolist(), 1) for k in range(400)]
    rows = outsider + [(1000 * (g + 1) + k, v.tolist(), 1) for g in (0, 1) for k, v in enumerate(groups[g])]
    got = [r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect() if r.vec_id >= 1000]
    assert {(r.n_links, r.component_id, r.kept) for r in got} == {(219, 1000, False), (219, 1000, True)}


def test_search(spark):
    rows = odd_vectors(np.random.default_rng(4))
    df = spark.createDataFrame(rows, VECTORS)
    found = ann_forest.search(df, df.filter("vec_id % 10 = 0"), recall=1.0, leaf=16).collect()
    good = [(i, np.array(v, float)) for i, v, _ in rows if i < 200 or i == 204]
    hits = 0
    for q, v in [g for g in good if g[0] % 10 == 0]:
        want = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != q)[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, *_ in own] == list(range(1, 11))
        assert own == sorted(own, key=lambda r: (r[2], r[1])) or [(s, j) for _, j, s in own] == sorted((s, j) for _, j, s in own)
        hits += len({j for _, j in want} & {j for _, j, _ in own}) / 10
    assert hits / len([g for g in good if g[0] % 10 == 0]) >= 0.9
    empty = spark.createDataFrame([], VECTORS)
    assert ann_forest.search(empty, empty).count() == 0
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert ann_forest.search(few, few.filter("vec_id = 0")).count() == 2


def test_search_with_default_settings(spark, monkeypatch):
    """Crowded and lone vectors against brute force; 150 queries, so that some had no part in setting the width."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 24)) * 3
    table = np.concatenate([centres[rng.integers(0, 40, 5_000)] + rng.standard_normal((5_000, 24)), rng.standard_normal((1_000, 24)) * 4]).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(table)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("point", F.lit("clash")).withColumn("score", F.lit("clash"))
    found: dict[int, list] = {}
    made = []
    true_rank = ann_forest.true_neighbours
    monkeypatch.setattr(ann_forest, "true_neighbours", lambda *a: made.append(len(a[1])) or true_rank(*a))
    for r in ann_forest.search(df, df.filter("vec_id % 40 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert made[:2] == [48, 48]
    exact, hits = table.astype(float), 0
    for q in range(0, 6_000, 40):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        want = sorted((float(x), int(j)) for j, x in enumerate(d) if j != q)[:10]
        own = sorted(found[q])
        assert [r for r, *_ in own] == list(range(1, 11)) and all(s == d[j] for _, j, s in own)
        assert [(s, j) for _, j, s in own] == sorted((s, j) for _, j, s in own)
        hits += len({j for _, j in want} & {j for _, j, _ in own})
    assert hits / 1_500 >= 0.9
    monkeypatch.setattr(ann_forest, "points_opened", lambda trees, sizes, queries, near: [10 ** (1 + len(made))] * 10)
    with pytest.raises(RuntimeError, match="no part"):
        ann_forest.search(df, df.filter("vec_id % 40 = 0"))


def test_search_ties_and_null_ids(spark):
    """Twelve vectors at one distance: the smaller ids come first, and equal vectors share their place."""
    ring = [(k, [float(np.cos(a)), float(np.sin(a)), 1.0], 0) for k, a in enumerate(np.arange(12) * 0)]
    rows = [(100, [1.0, 0.0, 2.0], 0), *ring, (None, [1.0, 0.0, 2.0], 0), (3, ring[3][1], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = ann_forest.search(df, df.filter("vec_id = 100 OR vec_id IS NULL")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(100, k + 1, k, 1.0) for k in range(10)]


def test_loser_tree_merges():
    rng = random.Random(5)
    row = lambda k: (f"k{rng.randint(0, 9)}", "t", k, "u", "response", "d", 1, None, "p", k, 1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((row(100 * r + i) for i in range(rng.randint(0, 12))), key=warc.sort_key) for r in range(k)]
        assert list(warc.merge([iter(r) for r in runs])) == sorted((x for r in runs for x in r), key=warc.sort_key)


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 5)
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(k, f"http://www.Host{k % 3}.org:80/p?{k % 7}", big if k % 4 == 0 else f"page {k}" * (k % 30)) for k in range(300)]
    rows += [(400, None, None), (401, "", ""), (402, "http://a/\r\nb", "short"), (403, "x", "short"), (None, "y", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    runs = warc.write(pages, f"file://{tmp_path}/w", part_bytes=2_000)
    index = warc.index(runs, f"file://{tmp_path}/i", ranges=3, fan_in=3)
    ordered = index.orderBy("range_no", "range_pos").collect()
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys) and len(keys) == len(rows)
    first = {}
    for k, _, html in sorted((r for r in rows if r[0] is not None)):
        first.setdefault(html or "", k)
    for r in warc.read(index).collect():
        html = next(h for k, _, h in rows if k == r.page_id) or ""
        data = html.encode()
        ref = first[html] if len(data) >= 100 and first[html] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), ref)
        assert r.record_type == ("revisit" if ref is not None else "response")
        assert r.payload is None if ref is not None else bytes(r.payload) == data
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.index(warc.write(none))).count() == 0
