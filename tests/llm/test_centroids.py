"""Centroid clustering against plain loops and against its SQL."""

import hashlib

import duckdb
import numpy as np
import pytest

from errorloom.llm import centroids
from errorloom.llm.registered import ORACLE, op12

SCHEMA = "vec_id bigint, vector array<double>, cluster string"


def brute(rows, k, rounds, width):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) and abs(x) < 2**19 for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        groups = {}
        for _, c, _, v in assign():
            groups.setdefault(c, []).append(v)
        for c, vs in groups.items():
            cents[c] = [sum(col) // len(vs) for col in zip(*vs)]
    final = assign()
    per = {}
    for _, c, d, _ in final:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d, _ in final), key=str)


def got(frame):
    return sorted((tuple(r)[:6] for r in frame.collect()), key=str)


@pytest.mark.parametrize("scale", [0.3, 3_000.0, 300_000.0])
def test_against_brute_force(spark, scale):
    random = np.random.default_rng(int(scale))
    rows = [(int(i), (random.normal(0, 1, 8) * scale / 5 + random.integers(0, 3) * scale / 4).tolist()) for i in range(300)]
    rows += [(int(i), rows[0][1]) for i in range(300, 340)]  # copies: equal distances, empty clusters
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    assert got(centroids.cluster(frame, k=12, width=8)) == brute(rows, 12, 5, 8)


def test_awkward_rows(spark):
    good = [0.5, -0.25, 1.0, 0.0]
    rows = [(1, good), (1, good), (None, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, []), (4, good[:3]), (5, [None, 1.0, 1.0, 1.0]),
            (6, [float("nan"), 1.0, 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0, 1.0]), (8, [1e300, 1.0, 1.0, 1.0]), (9, [-0.001] * 4)]
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    assert got(centroids.cluster(frame, width=4)) == brute(rows, 40, 5, 4)
    empty = centroids.cluster(frame.limit(0), width=4)
    assert empty.count() == 0 and empty.columns == centroids.cluster(frame, width=4).columns


def test_elimination_keeps_ties_and_the_least_number():
    random = np.random.default_rng(1)
    vectors, cents = random.integers(-2, 3, (500, 16)), random.integers(-2, 3, (40, 16))
    number, distance = centroids.nearest(vectors, cents)
    all_ = ((vectors[:, None] - cents[None]) ** 2).sum(2)
    assert (number == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_equal_to_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    sql = db.execute(f"select {', '.join(names)} from ({ORACLE['op12_centroid_clustering']})").fetchall()
    assert got(op12(spark, sf_dir).select(*names)) == sorted(sql, key=str)
