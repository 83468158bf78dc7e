import os

import numpy as np
import pandas as pd
import pytest

from marlspike.llm.neighbors import _largest, hilbert_key, nearest
from marlspike.llm.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_curve_visits_neighbours():
    side = 16
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    key = hilbert_key(cells, 4)
    assert sorted(key) == list(range(side * side))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    cube = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    path = cube[np.argsort(hilbert_key(cube, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def clusters(n, rng):
    centres = rng.standard_normal((12, 64))
    which = np.minimum(rng.geometric(0.3, n) - 1, 11)
    return centres[which] + 0.3 * rng.standard_normal((n, 64))


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = clusters(3000, rng).astype(np.float32)
    near = v[:600] + 0.05 * rng.standard_normal((600, 64)).astype(np.float32)
    v = np.vstack([v, near])
    u = v.astype(np.float64) / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"{i:05}", f"{j:05}") for i in range(len(v)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    df = spark.createDataFrame([(f"{i:05}", x.tolist()) for i, x in enumerate(v)], "id string, vec array<float>")
    got = nearest(df, 64, 5, 0.9, block=128, overlap=48).collect()
    found = {(r.id, r.other) for r in got}
    assert len(found & want) / len(want) >= 0.97 and not any(abs(s[int(r.id), int(r.other)] - r.score) > 1e-6 for r in got)


def test_copies_ties_and_unusable(spark):
    a, b = [1.0] + [0.0] * 63, [0.96, 0.28] + [0.0] * 62
    rows = [(f"a{i:02}", a) for i in range(40)] + [("b0", b), ("b1", b)]
    rows += [("n", None), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [0.0] * 63), ("hole", [None] + a[1:])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "id string, vec array<float>"), 64, 3, 0.9).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.other
    assert set(got) == {f"a{i:02}" for i in range(40)} | {"b0", "b1"}
    assert list(got["a00"].values()) == ["a01", "a02", "a03"] and list(got["a20"].values()) == ["a00", "a01", "a02"]
    assert [got["b0"][k] for k in (1, 2, 3)] == ["b1", "a00", "a01"]


def test_scaled_copies_are_one_direction(spark):
    rng = np.random.default_rng(5)
    base, other = rng.standard_normal(64), rng.standard_normal(64)
    rows = [(f"c{i:03}", [float(x) for x in base * (1 + i / 7)]) for i in range(300)] + [("o", [float(x) for x in other]), ("z", [float(x) for x in base * 0.97 + other * 0.03])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "id string, vec array<float>"), 64, 3, 0.9, block=16, overlap=4).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.other, round(r.score, 6))
    assert all(len(got[f"c{i:03}"]) == 3 and all(x[0] == "c" and y == 1.0 for x, y in got[f"c{i:03}"].values()) for i in range(300))
    assert all(x[0] == "c" for x, _ in got["z"].values()) and "o" not in got


def test_recall_at_100_000_with_a_dense_cluster(spark):
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    heads = unit(rng.standard_normal((500, 64)))
    which = np.minimum(rng.zipf(1.3, 80_000) - 1, 499)  # the largest cluster holds a quarter
    v = np.vstack([heads[which] + 0.06 * rng.standard_normal((80_000, 64)), unit(rng.standard_normal((20_000, 64)))]).astype(np.float32)
    u, ask = unit(v), rng.choice(80_000, 600, replace=False)
    s = u[ask] @ u.T
    s[np.arange(600), ask] = -2
    want = {(int(i), int(j)) for i, row in zip(ask, s) for j in np.argpartition(-row, 5)[:5] if row[j] >= 0.9}
    rows = spark.createDataFrame(pd.DataFrame({"id": [str(i) for i in range(len(v))], "vec": list(v)}), "id string, vec array<float>")
    only = spark.createDataFrame([(str(i),) for i in ask], "id string")
    found = {(int(r.id), int(r.other)) for r in nearest(rows, 64, 5, 0.9).join(only, "id").collect()}
    assert len(want) > 1000 and len(found & want) / len(want) >= 0.97


def test_empty_and_single(spark):
    assert nearest(spark.createDataFrame([], "id string, vec array<float>"), 64).collect() == []
    assert nearest(spark.createDataFrame([("x", [1.0] * 64)], "id string, vec array<float>"), 64).collect() == []


def test_recall_in_a_crowd_with_production_parameters(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    crowd = centre / np.linalg.norm(centre) + 0.02 * rng.standard_normal((12000, 64))
    v = np.vstack([crowd, rng.standard_normal((3000, 64))]).astype(np.float32)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = u[:1000] @ u.T
    s[np.arange(1000), np.arange(1000)] = -2
    want = {(f"{i:05}", f"{j:05}") for i in range(1000) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    rows = spark.createDataFrame(pd.DataFrame({"id": [f"{i:05}" for i in range(len(v))], "vec": list(v)}), "id string, vec array<float>")
    found = {(r.id, r.other) for r in nearest(rows, 64, 5, 0.9).filter("id < '01000'").collect()}
    assert len(want) == 5000 and len(found & want) / len(want) >= 0.98


def test_crowds_wider_than_a_run(spark):
    rng = np.random.default_rng(6)
    v = (np.ones(64) + 0.01 * rng.standard_normal((6000, 64))).astype(np.float32)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = u[:500] @ u.T
    s[np.arange(500), np.arange(500)] = -2
    want = {(f"{i:05}", f"{j:05}") for i in range(500) for j in np.argsort(-s[i])[:5]}
    rows = spark.createDataFrame(pd.DataFrame({"id": [f"{i:05}" for i in range(len(v))], "vec": list(v)}), "id string, vec array<float>")
    found = {(r.id, r.other) for r in nearest(rows, 64, 5, 0.9, block=128, overlap=48, wide=2500).filter("id < '00500'").collect()}
    assert len(found & want) / len(want) >= 0.9


def test_largest_by_groups():
    s = np.random.default_rng(2).standard_normal((20, 3001)).astype(np.float32)
    want = np.sort(np.argsort(-s, axis=1)[:, :5], axis=1)
    assert (np.sort(_largest(s, 5), axis=1) == want).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_registered_neighbors_without_a_threshold(spark):
    got = {(r.id, r.other) for r in QUERIES["p3_neighbors"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/doc_vector.parquet").filter("id IS NOT NULL").toPandas().sort_values("mod_time").drop_duplicates("id", keep="last")
    rows = rows[[x is not None and len(x) == 64 and bool(np.isfinite(x).all() and np.any(x)) for x in rows["vec"]]]
    u = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s, ids = u @ u.T, rows["id"].to_numpy()
    np.fill_diagonal(s, -2)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:5]}
    assert len(got) == len(want) == 5 * len(ids) and len(got & want) / len(want) >= 0.98


def test_recall_of_loose_groups_with_production_parameters(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    head = unit(rng.standard_normal((4000, 64)))
    v = np.vstack([head, *(0.6 * head + 0.8 * unit(rng.standard_normal(head.shape)) for _ in range(9))]).astype(np.float32)
    u = unit(v.astype(np.float64))
    s = u[:500] @ u.T
    s[np.arange(500), np.arange(500)] = -2
    want = {(f"{i:05}", f"{j:05}") for i in range(500) for j in np.argsort(-s[i])[:5]}
    rows = spark.createDataFrame(pd.DataFrame({"id": [f"{i:05}" for i in range(len(v))], "vec": list(v)}), "id string, vec array<float>")
    found = {(r.id, r.other) for r in nearest(rows, 64).filter("id < '00500'").collect()}
    assert len(found & want) / len(want) >= 0.9
