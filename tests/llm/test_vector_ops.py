"""Operators over vectors against brute force."""

import numpy as np
import pytest

from lexiloom.llm import topk, vectordup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_topk(rows, k):
    ok = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 3 == 0:
            s = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("slices", [2, 4096])
def test_topk(slices, spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=5).round(1).tolist()) for i in range(60)] + [(60 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [(200, None), (201, [None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [1.0]), (207, [2.0]), (210, []), (213, [3e9, -3e9, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    v = topk.integer_vectors(df)
    got = topk.top_k(v.where("vec_id % 3 = 0"), v, k=4, slice_queries=slices)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_topk(rows, 4)


def test_topk_of_empty_sides(spark):
    v = topk.integer_vectors(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))
    assert topk.top_k(v.limit(0), v, k=3).count() == 0
    assert topk.top_k(v, v.limit(0), k=3).count() == 0
    assert topk.top_k(v, v, k=3).count() == 0


def test_topk_of_close_scores_in_a_wide_range(spark):
    rng = np.random.default_rng(5)
    queries = [(q, [0] * q + [1] + [0] * (11 - q)) for q in range(12)]
    far = (1000, [1 << 20] * 12)  # its norm sets the range that is searched
    near = [(100 + i, v.tolist()) for i, v in enumerate(rng.integers(0, 300, (400, 12)) + rng.integers(0, 1 << 18, 12))]
    rows = [*queries, far, *near]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = topk.top_k(df.where("vec_id < 100"), df, k=10)
    want = []
    for q, v in queries:
        best = sorted((-int(np.dot(v, x)), i) for i, x in rows if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted(want)


def test_vector_duplicates(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for c in range(8):
        centre = rng.normal(size=64)
        for _ in range(30):
            rows.append((n, (centre + rng.normal(size=64) * rng.choice([0.02, 0.14, 0.4])).astype(np.float32).tolist(), c % 2))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, (3 * np.array(rows[0][1])).tolist(), 0), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 64, 0), (n + 5, [float("nan")] * 64, 0), (n + 6, [1.0, 0.0], 0), (n + 7, [2.0, 0.0], 0)]
    got = {r["vec_id"]: r for r in vectordup.vector_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    valid = {i: np.array(v, np.float32).astype(float) for i, v, y in rows if v is not None and y is not None and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in rows}
    links = {i: {j for j, w in valid.items() if j != i and label[i] == label[j] and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for i, v in valid.items()}
    comp = {}
    for i in sorted(label):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links.get(x, ())
    missed = sum(len(links.get(i, ())) - got[i]["n_links"] for i in got)
    assert all(got[i]["n_links"] <= len(links.get(i, ())) for i in got) and missed <= 0.01 * sum(map(len, links.values()))
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert vectordup.vector_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_list_decoding_finds_every_filter():
    f = vectordup.Codes(12, 2)
    x = np.random.default_rng(0).normal(size=(20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for code in range(2):
        row, name = f.decode(x, code, cap=0.6)
        s = [(x @ f.rotations[code])[:, c] @ w.T for c, w in f.codes[code]]
        full = (s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]).reshape(20, -1)
        for i in range(20):
            want = np.flatnonzero(full[i] >= 0.6) + code * vectordup.WORDS**3
            assert sorted(name[row == i].tolist()) == want.tolist()


def at_angle(rng, u, cosine):
    z = rng.normal(size=u.shape)
    z -= (z * u).sum(1, keepdims=True) * u
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return cosine * u + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("dim", [8, 64, 384, 768])
def test_recall_at_the_threshold(dim):
    """Random pairs at cosine 0.98 share a filter of some code."""
    rng, n = np.random.default_rng(dim), 400
    count, cap = vectordup.code_count(vectordup.MISS), vectordup.cap_for(dim, 0.98)
    u = rng.normal(size=(n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    f, met = vectordup.codes(dim, count), np.zeros(n, bool)
    for code in range(count):
        a, b = (set(zip(*(x.tolist() for x in f.decode(v, code, cap)))) for v in (u, at_angle(np.random.default_rng(5), u, 0.98)))
        met[[r for r, _ in a & b]] = True
    assert met.mean() >= 0.99


def test_links_of_pairs_at_the_threshold(spark):
    """Pairs a little over 0.98 are all found and none a little under it; ids and labels clash, columns have odd names."""
    rng = np.random.default_rng(9)
    u = rng.normal(size=(150, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    over, under = at_angle(rng, u, 0.9803), at_angle(rng, u, 0.9797)
    rows = [(3 * i + k, v.tolist(), i % 3, "x") for i in range(150) for k, v in enumerate((u[i], over[i], under[i]))]
    rows += [(None, u[0].tolist(), 0, "x"), (7000, u[0].tolist(), 0, "x"), (7000, u[3].tolist(), 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, filter string").repartition(3)
    got = {}
    for r in vectordup.vector_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append(r)
    ok = [(k, i, v, y) for k, (i, v, y, _) in enumerate(rows) if i is not None]
    x, y = np.array([v for _, _, v, _ in ok]), np.array([c for *_, c in ok])
    near = (x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) >= 0.98) & (y[:, None] == y)
    want = {}
    for k, (_, i, _, _) in enumerate(ok):
        want.setdefault(i, []).append(int(near[k].sum()) - 1)
    missed = sum(sum(w) - sum(r["n_links"] for r in got[i]) for i, w in want.items())
    assert all(sum(r["n_links"] for r in got[i]) <= sum(w) for i, w in want.items()) and missed <= 2
    assert all(got[3 * i + 1][0]["component_id"] == got[3 * i][0]["component_id"] for i in range(150) if want[3 * i + 1] == [r["n_links"] for r in got[3 * i + 1]])
    assert [r["component_id"] for r in got[7000]] == [0, 0] and got[9][0]["component_id"] == 0  # one id ties its vectors
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got[None]] == [(0, None, True)]


def test_topk_with_repeated_ids_and_ties(spark):
    """Rows that repeat an id are candidates of their own, but never their own query's; ties go to the smaller id."""
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [1, 0]), (2, [1, 0]), (5, [1, 0]), (9, [0, 1]), (9, [0, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = topk.top_k(df.where("vec_id = 5"), df, k=4).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]
    both = topk.top_k(df.where("vec_id = 1"), df, k=2).collect()  # two rows of one query
    assert sorted((r["rank"], r["vec_id"]) for r in both) == [(1, 2), (1, 2), (2, 2), (2, 2)]
