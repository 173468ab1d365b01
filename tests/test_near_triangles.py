"""Near triangles: copies meet as one."""

import random

from pyspark.sql import functions as F

from tessera.operators import quality


def test_copies_do_not_multiply_rows(spark):
    r = random.Random(3)
    base = [[tuple(r.uniform(-0.05, 0.05) for _ in range(3)) for _ in range(3)] for _ in range(40)]
    moved = [[tuple(v + (0.002, 0.02)[i % 2] for v in c) for c in t[1:] + t[:1]] for i, t in enumerate(base)]
    kind = "prim_id long, tidx long, p array<struct<x:double,y:double,z:double>>"
    left = spark.createDataFrame([(k % 3, k, base[k % 40]) for k in range(400)], kind)
    right = spark.createDataFrame([(0, k, moved[k % 40]) for k in range(400)], kind)

    def near(p, q):
        return all(any(max(abs(x - y) for x, y in zip(c, e, strict=True)) <= 0.003 for e in q) for c in p)

    wanted = sorted((k % 3, k) for k in range(400) if any(near(base[k % 40], q) for q in moved))
    out = quality.near_triangles(left, right, 0.003)
    assert sorted(tuple(x) for x in out.collect()) == wanted and 0 < len(wanted) < 400
    # both sides are made distinct before they are entered in cells
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [p") + plan.count("Aggregate [q") >= 3, plan
