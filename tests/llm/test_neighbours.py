import numpy as np

from tidewater.llm import neighbours


def brute(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in rows if i is not None}
    links = {k: 0 for k in range(len(good))}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                if top(i) != top(j):
                    parent[max(top(i), top(j))] = min(top(i), top(j))
    by_row = sorted((i, links[k]) for k, (i, _) in enumerate(good))
    return by_row, {i: top(i) for i in parent}


def check(spark, rows, kind="float"):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, links string")
    out = neighbours.near_duplicates(frame).collect()
    links, parts = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows])
    assert len(out) == len(rows)
    named = {i for i, _ in links}
    got = sorted((r["vec_id"], r["n_links"]) for r in out if r["vec_id"] is not None)
    want = sorted([*links, *[(i, 0) for i, v in rows if i is not None and i not in named]])
    assert got == want
    assert all(r["component_id"] == parts[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)


def test_equal_to_brute_force_with_copies_and_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    rows = [(k, centres[k % 12] + rng.normal(size=32) * (0.02 if k % 3 else 0.6)) for k in range(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(40)] + [(2000, rows[5][1] * 3)]
    check(spark, rows)


def test_different_vectors_under_one_id(spark):
    rows = [(1, [1, 0, 0]), (1, [0, 1, 0]), (2, [1, 0.01, 0]), (3, [0.01, 1, 0]), (4, [0, 0, 1]), (4, [0, 0.01, 1])]
    check(spark, rows)
    rows += [(5, [1, 0, 0]), (7, [-1, 0, 0]), (6, [-1, 0.01, 0]), (6, [0, -1, 0]), (8, [0, -1, 0.01]), (9, [0, -1, 0]), (5, [1, 0, 0])]
    check(spark, rows, "double")


def test_hot_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 16)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    check(spark, [(k, centre + rng.normal(size=16) * 0.12) for k in range(150)], "double")


def test_broken_vectors_and_empty_table(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0])]
    check(spark, rows)
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_chance_to_meet_is_as_planned():
    rng = np.random.default_rng(0)
    a = neighbours.unit(rng.normal(size=(800, 64)))
    o = rng.normal(size=(800, 64))
    o = neighbours.unit(o - (o * a).sum(1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * o
    x, y = (neighbours.bucket_ids(v, tables=6, hashes=1) for v in (a, b))
    direct = (x[:, :, 0] == y[:, :, 0]).mean()
    probed = ((x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)).mean()
    assert direct >= neighbours.MEET and probed >= neighbours.MEET_PROBED


def test_recall_at_the_threshold_in_full_dimension(spark):
    rng = np.random.default_rng(8)
    a = neighbours.unit(rng.normal(size=(600, 768)))
    o = rng.normal(size=a.shape)
    o = neighbours.unit(o - (o * a).sum(1, keepdims=True) * a)
    cosine = np.where(np.arange(600) % 2, 0.9501, 0.9499)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * o
    rows = [(int(k), v.tolist()) for k, v in enumerate(np.concatenate((a, b)))]
    out = {r["vec_id"]: r["n_links"] for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = np.array([out[k] for k in range(600)])
    assert found[0::2].max() == 0 and found[1::2].mean() >= 0.99 and [out[600 + k] for k in range(600)] == found.tolist()
