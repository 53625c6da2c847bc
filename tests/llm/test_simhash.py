import random
import re

import numpy as np
import pytest
from llm.cases import awkward, clashing, prose, rows_of
from xxhash import xxh64_intdigest

from barquet.llm import queries, simhash
from barquet.llm.graph import components


def plain_fingerprint(text):
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "ÀB c\x0bd e F", prose(1), prose(2, 3000), "a " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(text, step=7) == plain_fingerprint(text)


def test_embedding_is_a_lower_bound(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(simhash.signed(a), simhash.signed(a ^ b)) for a, b in ((rng.getrandbits(64), rng.getrandbits(64) & rng.getrandbits(64)) for _ in range(200))]
    df = spark.createDataFrame(rows, "a long, b long").select(
        "a", "b", F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("m")
    )
    for a, b, m in df.collect():
        a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
        want = sum(abs((a >> i & 3).bit_count() - (b >> i & 3).bit_count()) for i in range(0, 64, 2))
        assert m == want <= (a ^ b).bit_count()


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("cell_rows", [0, 3, 64])
def test_links_connect_what_brute_force_connects(spark, cell_rows):
    rng = random.Random(cell_rows)
    points = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        points.add(base)
        for _ in range(14):
            points.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))) & (1 << 64) - 1)
    points = sorted(simhash.signed(p & (1 << 64) - 1) for p in points)
    near = [(a, b) for i, a in enumerate(points) for b in points[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    got = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), cell_rows).collect()
    assert {(min(a, b), max(a, b)) for a, b in got} <= set(near)
    assert union([tuple(r) for r in got], points) == union(near, points)


def test_components_of_a_long_chain(spark):
    n = 70
    edges = [(i + 1, i) for i in range(n)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    fps = [plain_fingerprint(t or "") for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = union(near, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(root[i]))) for i, (d, _) in enumerate(rows))


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clashing(docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op1_simhash_components"](spark, str(tmp_path))
    assert rows_of(got) == brute(rows)


def test_near_copies_meet_and_others_stay_apart(spark):
    base = prose(7, 900)
    words = base.split()
    rows = [(0, base), (1, base), (2, " ".join([*words[:-1], "changed"])), (3, prose(8, 900))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_empty_table(spark):
    assert simhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_bit_totals():
    h = np.random.default_rng(0).integers(0, 1 << 63, 70_000, dtype=np.uint64)
    assert simhash.bit_totals(h).tolist() == [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
