"""Running values, percentiles, salted joins and greedy runs against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators.stats import auroc, bootstrap_interval, latency_summary
from quillon.scale import block_scan, greedy_runs, join_shuffled, join_small
from quillon.session import written


def test_block_scan_equals_a_walk(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, i * 7 % 11]), rng.randint(-5, 5)) for k in (1, 2) for i in range(57)]
    df = spark.createDataFrame(rows, "k int, i int, v int, d int").repartition(5)
    got = block_scan(
        df, ["k"], F.floor(F.col("i") / 8), ["i"],
        fill=("fill", "v"), before=("before", "v"), run=("sum", "d"), prior=("sum_before", "d"),
        top=("max", "d"), all_=("total", "d"),
    ).orderBy("k", "i").collect()
    for k in (1, 2):
        last, total, top = None, 0, None
        whole = sum(r[3] for r in rows if r[0] == k)
        for row, (_, _, v, d) in zip([r for r in got if r.k == k], [r for r in rows if r[0] == k], strict=True):
            assert row.before == last and row.prior == total and row.all_ == whole
            last = v if v is not None else last
            total += d
            top = d if top is None else max(top, d)
            assert row.fill == last and row.run == total and row.top == top


def test_percentiles_of_a_hot_key(spark):
    rng = random.Random(5)
    values = [("hot", rng.choice([1.5, rng.random() * 100])) for _ in range(3000)] + [("cold", 4.0)]
    got = {r.k: r for r in latency_summary(spark.createDataFrame(values, "k string, v double"), ["k"], "v").collect()}
    hot = np.array([v for k, v in values if k == "hot"])
    for name, q in (("p50", 50), ("p95", 95), ("p99", 99)):
        assert abs(got["hot"][name] - np.percentile(hot, q)) < 1e-9
    assert got["cold"].p50 == got["cold"].p99 == 4.0 and got["hot"].n == 3000


def test_auroc_counts_ties_half(spark):
    rows = [("s", 0.9, True), ("s", 0.5, True), ("s", 0.5, False), ("s", 0.1, False)]
    found = auroc(spark.createDataFrame(rows, "k string, s double, p boolean"), ["k"], "s", "p").first()
    assert found.auroc == (1 + 1 + 0.5 + 1) / 4


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rows = [("a", i, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, q int, v double")
    one = bootstrap_interval(df.repartition(1), ["k"], "q", "v", resamples=200).first()
    two = bootstrap_interval(df.repartition(7), ["k"], "q", "v", resamples=200).first()
    assert one == two and one.low < 0.5 < one.high


def test_salted_join_equals_broadcast(spark):
    big = spark.createDataFrame([(i % 3, i) for i in range(300)], "k int, i int")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "k int, t string")
    rows = lambda fits: sorted(map(tuple, join_small(big, small, ["k"], ["i"], fits=fits).collect()))
    assert rows(True) == rows(False)


def test_greedy_runs_across_blocks(spark):
    rng = random.Random(11)
    sizes = {k: [rng.randint(1, 9) for _ in range(n)] for k, n in (("a", 101), ("b", 1), ("c", 40))}
    rows = [(k, i, s) for k, found in sizes.items() for i, s in enumerate(found)]

    def run_end(columns, i):
        total, at = columns["s"][i], i + 1
        while at < len(columns["s"]) and total + columns["s"][at] <= 12:
            total, at = total + columns["s"][at], at + 1
        return at

    df = spark.createDataFrame(rows, "k string, n int, s int").repartition(3)
    got = greedy_runs(df, ["k"], "n", ["s"], run_end, lookahead=13, block_rows=16)
    starts = {(r.k, r.n) for r in got.where("run_start = 1").collect()}
    want = set()
    for k, found in sizes.items():
        total = 99
        for i, s in enumerate(found):
            if total + s > 12:
                want.add((k, i))
                total = 0
            total += s
    assert starts == want and got.count() == len(rows)


def test_a_join_of_growing_sides_is_never_a_broadcast(spark):
    left = written(spark.range(1000).selectExpr("id", "id % 7 as key"), "left")
    # Stored in a few kilobytes, so that the planner would broadcast it.
    right = written(spark.range(7).selectExpr("id as key", "repeat('x', 1000) as wide"), "right")
    for how, rows in (("inner", 1000), ("left", 1000), ("left_semi", 1000), ("left_anti", 0)):
        for joined in (
            join_shuffled(left, right, "key", how),
            join_small(left, right, ["key"], ["id"], how=how, fits=False),
        ):
            assert joined.count() == rows
            assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
