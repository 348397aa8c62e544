"""The best of a few candidates, without sorting pairs, in tasks of a fixed size."""

import random

from pyspark.sql import functions as F

from callweft.operators import lookup
from callweft.plans import table_queries


def test_best_number_is_best_match(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(30), rng.randrange(9), rng.choice([None, 1, 2, 3, 4])) for _ in range(400)] + [(99, None, 4), (98, 5, None)]
    pairs = spark.createDataFrame(rows, "k int, c int, s int")
    best = {}
    for k, c, s in rows:
        if c is not None and s is not None:
            best[k] = min(best.get(k, (0, 0)), (-s, c))
    got = lookup.best_number(pairs, ["k"], F.col("s"), "c", range(1, 5)).collect()
    assert {r.k: (-r.score, r.c) for r in got} == best and len(got) == len(best)


def test_overloads_are_paired_in_tasks_of_a_fixed_size(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(o, rng.randint(1, 7), float(rng.randint(1, 50)), rng.choice([None, 20000.0, 40000.0])) for o in range(400) for _ in range(rng.randint(0, 6))]
    rows += [(None, 1, 1.0, 1.0), (None, 2, 1.0, 1.0), (7, None, 3.0, 40000.0), (9, 1, None, 1.0), (9, 2, None, 40000.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(table_queries, "LINES_AT_ONCE", 50)
    found = table_queries.overload_best_match(spark, str(tmp_path))
    want = {}
    for o, line, q, _ in rows:
        for p, other, r, price in rows:
            if o is not None and o == p and line is not None and other is not None and line != other:
                score = (1 if q is None or r is None else 3 if q == r else 2 if abs(q - r) <= 2 else 1) + (price is not None and price > 30000)
                want[o, line] = min(want.get((o, line), (0, 0)), (-score, other))
    got = found.collect()
    assert {(r.l_orderkey, r.l_linenumber): (-r.score, r.candidate) for r in got} == want and len(got) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and f", {len(rows) // 50 + 1}), REPARTITION_BY_NUM" in plan
