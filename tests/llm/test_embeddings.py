import numpy as np
import pytest

from strandwise.llm.embedding_join import near_vectors


def brute(vectors, cosine):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = [0] * n
    lab = list(range(n))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    lab[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(n)]


@pytest.mark.parametrize("cell,block", [(40, 16), (100_000, 2048)])
def test_against_brute_force(spark, cell, block):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(12, 8))
    vs = [list(map(float, base[k % 12] + 0.12 * rnd.normal(size=8))) for k in range(150)]
    vs += [vs[3]] * 20 + [[2 * x for x in vs[3]]] + [None, [0.0] * 8, [float("nan")] * 8, [None] * 8, [float("inf")] + [1.0] * 7, [], [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, v, 1) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", __import__("pyspark").sql.functions.lit(1))
    got = sorted(map(tuple, near_vectors(df, cell=cell, block=block).select("vec_id", "n_links", "component_id", "kept").collect()))
    links, comp = brute(vs, 0.95)
    assert got == [(k, links[k], comp[k], comp[k] == k) for k in range(len(vs))]


def test_null_negative_and_repeated_ids(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(4, 6))
    near = lambda k: list(map(float, base[k] + 0.02 * rnd.normal(size=6)))
    rows = [(5, near(0)), (9, near(0)), (None, near(0)), (-3, near(1)), (9, near(1)), (11, near(1)), (None, near(2)), (None, near(2)), (7, near(3)), (7, near(3)), (8, None), (None, None), (-4, [0.0] * 6)]
    links, comp = brute([v for _, v in rows], 0.95)
    got = sorted(map(str, map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())))
    want = []
    for k, (i, v) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None]
        least = min(ids) if ids else None
        want.append(str((i, links[k], least, least is None or i == least)))
    assert got == sorted(want)


def test_boundary_is_judged_in_double(spark):
    turned = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(0, [1.0, 0.0]), (1, turned(0.95 + 1e-9)), (2, turned(0.95 - 1e-9)), (3, [0.0, -1.0])]
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 0}


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
