import random

import pytest

from plumbline.plans.analysis import analyse
from plumbline.streaming import accumulate
from plumbline.streaming.accumulate import Accumulated

KIND = "t int, size int, price double, holed double, sparse double, kind string, note string"
SECTIONS = ("gates", "columns", "statistics", "correlations", "confidence", "outliers", "normality", "predictions", "insights", "categories")


def made(first, n, seed, sparse=0.0):
    rnd = random.Random(seed)
    rows = []
    for t in range(first, first + n):
        price = rnd.gauss(100, 15) + t
        rows.append((t * 3 % 1009, rnd.randint(1, 40), price, None if rnd.random() < 0.15 else price / 2 + rnd.random(), None if rnd.random() < sparse else rnd.random(),
                     rnd.choice(["a", " a", "b ", None, "c"]), "n" if t % 7 else " n"))
    return rows


def table(df):
    """Rows of a section as comparable values; numbers may differ in their last rounded digit."""
    names = sorted(df.columns)
    rows = [[r[n] for n in names] for r in df.collect()]
    return names, sorted(rows, key=lambda r: str([v for v in r if not isinstance(v, (float, dict))]))


def same(got, want, name):
    assert got[0] == want[0] and len(got[1]) == len(want[1]), name
    for a, b in zip(got[1], want[1], strict=True):
        for x, y, column in zip(a, b, got[0], strict=True):
            if isinstance(x, dict) and isinstance(y, dict):
                assert x.keys() == y.keys() and all(x[k] == y[k] or x[k] == pytest.approx(y[k], abs=2e-4) for k in x), (name, column)
            else:
                assert x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=2e-4), (name, column, x, y)


def check(spark, held, rows, sections=SECTIONS):
    whole = spark.createDataFrame(rows, KIND)
    want, got = analyse(whole, "all", ["t", "price"]), held.report("all")
    assert (got.status, got.stop_reason, got.blocked, got.roles) == (want.status, want.stop_reason, want.blocked, want.roles)
    for name in sections if want.status == "OK" else ("gates",):
        same(table(got.tables[name]), table(want.tables[name]), name)


def test_sections_equal_those_of_all_rows(spark, tmp_path):
    """In order, out of order and delivered again; copies within and across batches; a column that is blocked only by a later batch."""
    first, second, third = made(0, 40, 1), made(40, 60, 2, sparse=0.5), made(100, 50, 3)
    second += first[:10] + second[:3]
    third += [second[0][:5] + (" a ", "n"), second[0][:5] + ("a", "n")]
    held = Accumulated(spark, str(tmp_path / "a"), ["t", "price"])
    frame = lambda rows: spark.createDataFrame(rows, KIND).repartition(2)
    held.add(frame(third), 2)
    assert held.report().blocked == []
    held.add(frame(first), 0)
    held.add(frame(second), 1)
    check(spark, held, first + second + third)
    before = table(held.report().tables["statistics"])
    held.add(frame(second), 1)
    held.add(frame(third), 2)
    same(table(held.report().tables["statistics"]), before, "again")
    held.add(frame(made(40, 60, 2)), 1)  # a number holds what came last under it
    check(spark, held, first + made(40, 60, 2) + third, ("columns", "statistics"))


def test_few_rows_are_blocked_until_there_are_enough(spark, tmp_path):
    held = Accumulated(spark, str(tmp_path / "b"), ["t", "price"])
    held.add(spark.createDataFrame(made(0, 3, 5), KIND), 0)
    assert held.report().status == "BLOCKED"
    held.add(spark.createDataFrame(made(3, 12, 6), KIND), 1)
    check(spark, held, made(0, 3, 5) + made(3, 12, 6), ("gates", "statistics"))


def test_quantiles_leave_no_rounds_to_run_again(spark, tmp_path, monkeypatch):
    """What selects ranks hands over a few rows, not a plan over the value counts; those are stored without a second shuffle."""
    plans, find = [], accumulate.select_ranks
    monkeypatch.setattr(accumulate, "select_ranks", lambda *a: (f := find(*a), plans.append(f._jdf.queryExecution().optimizedPlan().toString()))[0])
    held = Accumulated(spark, str(tmp_path / "c"), ["t", "price"])
    held.add(spark.createDataFrame(made(0, 60, 7), KIND), 0)
    check(spark, held, made(0, 60, 7), ("statistics",))
    assert plans and not any("parquet" in p.lower() for p in plans)
