import numpy as np
import pytest
from pyspark.sql import functions as F

from barquet.llm import crosspolytope, kdtree, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def sound(rows, zero=True):
    out = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not (zero or any(v)):
            continue
        out.setdefault(i, np.float32(v).astype(float))
    return out


def best(rows, query, k, score, zero=True):
    vecs = sound(rows, zero)
    want = {}
    for q in vecs:
        if query(q):
            found = sorted(((-score(vecs[q], v), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q])))[:k]
            if found:
                want[q] = [(i, -s) for s, i in found]
    return want


def cosine(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def product(a, b):
    return int(np.floor(64 * a) @ np.floor(64 * b))


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 20))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=20)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[40][1]) for i in range(150)]  # a crowd of equal vectors
    rows += [
        (1000, None), (1010, []), (1020, [float("nan")] + [1.0] * 19), (1030, [float("inf")] + [1.0] * 19), (1040, [None] + [1.0] * 19),
        (1050, [0.0] * 20), (1060, [1.0, 2.0]), (1070, [2.0, 1.0]), (1080, [1.0]), (None, [1.0] * 20), (0, rows[0][1]),
    ]
    return rows


@pytest.mark.parametrize("chunk", [7, 4096])
def test_cross_polytope(spark, cloud, chunk):
    found = got(crosspolytope.nearest(table(spark, cloud), F.col("vec_id") % 10 == 0, k=5, chunk=chunk))
    want = best(cloud, lambda i: i % 10 == 0, 5, cosine, zero=False)
    assert set(found) <= set(want)
    vecs = sound(cloud)
    hits = total = 0
    for q, rows in want.items():
        mine = found.get(q, [])
        assert all(abs(s - cosine(vecs[q], vecs[i])) < 1e-12 and i != q for i, s in mine)
        assert [(-round(s, 12), i) for i, s in mine] == sorted((-round(s, 12), i) for i, s in mine)
        total += len(rows)
        hits += len({i for i, _ in mine} & {i for i, _ in rows})
    assert hits >= 0.95 * total
    # equal vectors: nearest are the smallest ids of the crowd
    assert [i for i, _ in found[410]] == [40, 400, 401, 402, 403]


def test_two_hashes_a_table(spark, cloud):
    some = [r for r in cloud if r[0] is not None and r[0] < 400]
    found = got(crosspolytope.nearest(table(spark, some), F.col("vec_id") % 10 == 0, k=3, tables=12, hashes=2, probes=6))
    want = best(some, lambda i: i % 10 == 0, 3, cosine)
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in rows}) for q, rows in want.items())
    assert hits >= 0.8 * sum(map(len, want.values()))


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 13))
    y = crosspolytope.rotated(x, 4)
    assert y.shape == (5, 16)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1) * 16**1.5)
    assert np.allclose(y @ y.T / 16**3, x @ x.T)


@pytest.mark.parametrize("shard, block, leaf", [(8192, 1024, 128), (50, 7, 4), (1, 1, 1)])
def test_kd_tree_is_exact(spark, cloud, shard, block, leaf):
    rows = cloud if shard > 1 else [r for r in cloud if r[0] is None or r[0] % 9 == 0 or r[0] >= 1000][:40]
    df = kdtree.top_products(table(spark, rows), F.col("vec_id") % 10 == 0, k=6, shard=shard, block=block, leaf=leaf)
    assert got(df) == best(rows, lambda i: i % 10 == 0, 6, product)


def test_trees_are_tight_and_complete():
    x = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(float)
    tree = kdtree.grow(x, np.arange(500) * 7, 16)
    ends = tree.nodes[tree.nodes[:, 0] < 0]
    assert sorted(np.concatenate([tree.ids[a:b] for _, _, a, b in ends]).tolist()) == [i * 7 for i in range(500)]
    assert (x[tree.ids // 7] == tree.x).all()
    for (left, right, a, b), low, high in zip(tree.nodes, tree.low, tree.high):
        part = tree.x[a:b]
        assert (part.min(axis=0) == low).all() and (part.max(axis=0) == high).all()
        assert left >= 0 or b - a <= 16 or (low == high).all()
        if left >= 0:
            assert abs((tree.nodes[left][3] - tree.nodes[left][2]) - (tree.nodes[right][3] - tree.nodes[right][2])) <= 1


def test_upper_tree_cuts_at_medians():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3)) * [1, 5, 1]
    sizes = np.bincount(kdtree.shard_of(x, kdtree.cuts(x[:1000], 8)))
    assert len(sizes) == 8 and sizes.max() < 1.4 * sizes.min()
    assert kdtree.cuts(np.ones((50, 3)), 8) == []


def test_traversal_ends_at_the_kth_score():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-9, 9, (200, 6)) + c for c in (0, 300, 600, 900)]).astype(float)
    tree = kdtree.grow(x, np.arange(800), 25)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            seen.append(at)
            return super().__getitem__(at)

    tree.x = tree.x.view(Watched)
    scores, ids = kdtree.traverse(tree, np.ones(6), 5, float("-inf"), 7)
    want = sorted(((-s, i) for i, s in enumerate(x.sum(axis=1)) if i != 5))[:7]
    assert list(zip(-scores, ids)) == want
    leaves = [at for at in seen if isinstance(at, slice)]
    assert len(leaves) <= 200 // 25 + 1  # the far clusters' leaves are never read
    assert len(kdtree.traverse(tree, np.ones(6), 5, float(scores[0]) + 1, 7)[0]) == 0


def test_regions_keep_queries_from_most_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 8)) * 20
    rows = [(i, (centres[i % 16] + rng.normal(size=8)).tolist()) for i in range(800)]
    sent = []
    real = kdtree.staged
    monkeypatch.setattr(kdtree, "staged", lambda df, name: (out := real(df, name), sent.append((name, out)))[0])
    found = kdtree.top_products(table(spark, rows), F.col("vec_id") % 20 == 0, k=5, shard=50, leaf=10, visits=(1, 4))
    assert got(found) == best(rows, lambda i: i % 20 == 0, 5, product)
    pairs = sum(df.count() for name, df in sent if name == "sent")
    assert pairs < 0.6 * 40 * 16


def test_large_numbers_are_exact_or_at_the_edge_of_64_bits(spark):
    huge = [(0, [1e30, 1.0]), (20, [-1e30, 0.5]), (1, [2.0, 3.0]), (2, [1e30, 2.0]), (3, [float(2**40), 1.0]), (4, [float(2**40), -1.0])]
    found = got(kdtree.top_products(table(spark, huge), F.col("vec_id") % 20 == 0, k=4))
    top, low = (1 << 63) - 1, -(1 << 63)
    assert found[0] == [(1, top), (2, top), (3, top), (4, top)]
    assert found[20] == [(0, low), (1, low), (2, low), (3, low)]
    exact = kdtree.top_products(table(spark, [(0, [float(2**24), 1.0]), (1, [float(2**24), 1.0]), (2, [float(2**24), 2.0])]), F.col("vec_id") == 0, k=2)
    assert got(exact)[0] == [(2, 2**60 + 64 * 128), (1, 2**60 + 64 * 64)]


def test_one_id_with_two_vectors_is_one_row(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.0, 2.0]), (2, [0.5, 2.0]), (3, [2.0, 0.2])]
    for search in (crosspolytope.nearest, kdtree.top_products):
        found = search(table(spark, rows), F.col("vec_id") % 2 == 0, k=3).collect()
        assert len({(r["query_id"], r["rank"]) for r in found}) == len(found) == 6
        assert len({(r["query_id"], r["vec_id"]) for r in found}) == 6
    # parallel vectors have one cosine, up to the last bit, and go by id
    same = [(i, (np.array([0.3, 0.7, 0.11]) * (1 + i % 3)).tolist()) for i in range(40)]
    near = got(crosspolytope.nearest(table(spark, same), F.col("vec_id") == 0, k=5))
    assert all(abs(s - 1) < 1e-6 for _, s in near[0])


def test_queries_and_empty_tables(spark, cloud, tmp_path):
    table(spark, cloud).withColumn("score", F.lit("taken")).withColumn("v", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert got(queries.QUERIES["op7_kd_tree"](spark, str(tmp_path))) == best(cloud, lambda i: i % 20 == 0, 20, product)
    assert set(got(queries.QUERIES["op3_cross_polytope"](spark, str(tmp_path)))) >= {0, 50, 100}
    none = table(spark, [])
    assert kdtree.top_products(none, F.col("vec_id") % 10 == 0).count() == 0
    assert crosspolytope.nearest(none, F.col("vec_id") % 10 == 0).count() == 0
