import numpy as np
import pytest

from roadsky.llm import vantage


def brute(rows, queries, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = {}
    for q in good:
        if queries(q):
            a = np.array(good[q], float)
            scored = [(-float(np.add.reduce(a * np.array(v, float))), i) for i, v in good.items() if i != q and len(v) == len(a)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")


def rows_of(n=700, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, np.round(r.normal(size=8) * r.uniform(0.2, 3), 3).tolist()) for i in range(n)]
    copy = rows[5][1]
    rows += [(1000 + i, copy) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [None] + [1.0] * 7), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8)]
    return [*rows, (None, copy), rows[7], rows[7], (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (4000, [])]


@pytest.mark.parametrize("shard", [100, 10_000])
def test_factor_one_is_exact(spark, shard):
    rows = rows_of()
    vectors = vantage.usable(table(spark, rows))
    found = vantage.search(vantage.build_index(vectors, shard), vectors.filter("vec_id % 20 = 0"), 20, 1.0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert got.keys() == {q for q, near in want.items() if near}
    for q in got:
        assert got[q] == want[q]


def test_recall_of_the_production_factor(spark, tmp_path):
    r = np.random.default_rng(4)
    centres = r.normal(size=(10, 64))
    rows = [(i, (centres[i % 10] + r.normal(size=64)).tolist()) for i in range(3000)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(rows, lambda q: q % 20 == 0, 20)
    got = {}
    for x in vantage.op9_vantage(spark, str(tmp_path)).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_few_and_none(spark):
    vectors = vantage.usable(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0])]))
    found = vantage.search(vantage.build_index(vectors), vectors.filter("vec_id = 0")).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 0.5)]
    none = vantage.usable(table(spark, [(0, [0.0, 0.0])]))
    assert vantage.search(vantage.build_index(none), none).count() == 0


def recall(found, want, k=20):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(got.get(q, set()) & {i for i, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("shard", [150, 10_000])
def test_ties_of_whole_numbers_at_factor_one(spark, shard):
    r = np.random.default_rng(9)
    rows = [(int(i), r.integers(-2, 3, 6).astype(float).tolist()) for i in r.permutation(1500)]
    vectors = vantage.usable(table(spark, rows))
    found = vantage.search(vantage.build_index(vectors, shard), vectors.filter("vec_id % 20 = 0"), 20, 1.0).collect()
    got = {}
    for x in sorted(found, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert got == brute(rows, lambda q: q % 20 == 0, 20)


def shapes(kind, n=2400, width=24):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, width))
    if kind == "clustered":
        x = r.normal(size=(40, width))[r.integers(0, 40, n)] + 0.15 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[7] *= 3
    if kind == "lognormal":
        x *= r.lognormal(0, 1, (n, 1))
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["unit", "one long", "lognormal", "clustered"])
def test_recall_of_the_chosen_factor(spark, kind):
    rows = shapes(kind)
    vectors = vantage.usable(table(spark, rows))
    index = vantage.build_index(vectors, 500)
    assert index.trees.count() >= 4
    queries = vectors.filter("vec_id % 20 = 0")
    want = brute(rows, lambda q: q % 20 == 0, 20)
    factor, measured = vantage.choose_factor(index, queries)
    assert recall(vantage.search(index, queries, 20, factor).collect(), want) >= 0.9
    if kind == "clustered":
        assert measured[factor][1] < 0.3
