"""The replay of runs by interval subtraction."""

import random

from conftest import rows
from pyspark.sql import functions as F

from chronolake.operators.ledger import LOWEST, insert, run_gaps, subtract


def test_intervals_like_sets():
    r = random.Random(3)
    for _ in range(300):
        done, seen = [], set()
        for _ in range(12):
            lo = r.randint(0, 40)
            hi = lo + r.randint(1, 9)
            gaps = subtract(lo, hi, done)
            assert [x for a, b in gaps for x in range(a, b)] == sorted(set(range(lo, hi)) - seen) and all(a < b for a, b in gaps)
            insert(lo, hi, done)
            seen |= set(range(lo, hi))
            assert [x for a, b in done for x in range(a, b)] == sorted(seen) and all(x[1] < y[0] for x, y in zip(done, done[1:]))


def test_runs_that_leave_holes(spark):
    runs = spark.createDataFrame([(1, None, 99), (2, 200, 299), (3, None, 299), (4, 50, 399), (5, None, None)], "run long, a long, b long")
    at = lambda c: F.timestamp_micros(F.col(c))
    runs = runs.select("run", at("a").alias("a"), at("b").alias("b"))
    assert rows(run_gaps(runs, run_id="run", cutoff="b", ok=F.lit(True), since="a")) == [(1, 1, LOWEST, 100), (2, 2, 200, 300), (3, 3, 100, 200), (4, 4, 300, 400)]
