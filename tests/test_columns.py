import pytest
from pyspark.sql import functions as F

from tessera.operators import columns, layout
from tessera.plans import catalog

SCHEMA = "doc string, page int, line int, run int, x0 double, x1 double, chars int"


def setting(starts, widths, lines=20, chars=40, spanning=0, name="a", ragged=False, short=()):
    """Runs of a page of so many columns, with spanning lines between, the last columns perhaps short."""
    rows = []
    for i in range(lines):
        if spanning and i % spanning == 0:
            rows.append((name, 1, i, 0, 0.0, 590.0, 90))
            continue
        for k, (x, w) in enumerate(zip(starts, widths)):
            if k in short and i % 4:
                continue
            rows.append((name, 1, i, k, float(x), float(x + (w * (0.3 + 0.6 * (i * 7 % 10) / 10) if ragged else w)), chars))
    return rows


@pytest.mark.parametrize(
    "rows,n,why",
    [
        (setting([10], [580]), 1, None), (setting([10, 310], [275, 275]), 2, "one"), (setting([10, 210, 410], [180, 180, 180]), 3, None), (setting([10, 210, 410], [180, 180, 180], spanning=5), 3, None),
        (setting([10, 210, 410], [180, 180, 180], lines=10), 1, "lines"), (setting([10, 210, 410], [180, 180, 180], chars=9), 1, "prose"), (setting([10, 210, 410], [170, 170, 170], lines=40, ragged=True), 1, "ragged"),
        (setting([10, 210, 410], [180, 180, 180], lines=60, short=(2,)), 2, "balance"), (setting([10, 310], [275, 275], lines=3), 1, None), (setting([10, 310], [275, 275], spanning=2), 1, None), (setting([10, 310], [275, 275], spanning=4), 2, "one"),
    ],
)
def test_verdicts(spark, rows, n, why):
    runs = spark.createDataFrame(rows, SCHEMA)
    pages = spark.createDataFrame([("a", 1, 600.0, 10.0), ("empty", 1, 600.0, 10.0)], "doc string, page int, width double, font double")
    got = {r.doc: r for r in columns.verdicts(runs, pages).collect()}
    assert (got["a"].columns, got["a"].why) == (n, why)
    assert (got["a"].left is None) == (n == 1) and (got["a"].right is None) == (n < 3)
    if n == 3:
        assert abs(got["a"].left - 200) < 12 and abs(got["a"].right - 400) < 12
    assert got["empty"].columns == 1 and got["empty"].left is None


def test_body_lines(spark):
    lines = spark.createDataFrame([("a", 1, 400.0, 10.0), ("a", 1, 20.0, 10.0), ("a", 1, 790.0, 10.0), ("a", 1, 300.0, 20.0), ("a", 1, 200.0, 11.0)], "doc string, page int, baseline double, size double")
    assert sorted(r.baseline for r in columns.body(lines, F.lit(800.0)).collect()) == [200.0, 400.0]


@pytest.mark.parametrize("name", ["page_lines", "lines_by_column"])
def test_pages_are_dealt_once_for_all_steps(spark, small, name):
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
    assert "Union" not in plan and "sequence(" not in plan  # neither is an item made twice nor a line spread over bins


def test_tracks_are_those_of_bins_counted_one_by_one(spark):
    lines = [(d, 1, i, float(x), float(w)) for d in range(40) for i, (x, w) in enumerate([((d * 37 + k * 53) % 500 - 20, (d * 11 + k * 29) % 260 - 5) for k in range(1 + d % 9)])]
    want = set()
    for d in range(40):
        n = [0] * layout.BINS
        for _, _, _, x, w in (r for r in lines if r[0] == d):
            for b in range(max(0, int(x // 6)), min(layout.BINS - 1, int((x + w) // 6)) + 1):
                n[b] += 1
        kept = [c > 0 and c >= layout.COVERED * max(n) for c in n] + [False]
        runs, at = [], None
        for b, k in enumerate(kept):
            if k and at is None:
                at = b
            elif not k and at is not None:
                runs.append((at, b - 1))
                at = None
        want |= {(d, i, a, b) for i, (a, b) in enumerate([r for r in runs if r[1] - r[0] + 1 >= layout.NARROW], 1)}
    df = spark.createDataFrame(lines, "doc long, page int, line int, x double, w double")
    got = {(r.doc, r.track, r.lo, r.hi) for r in layout.tracks(df, F.lit(600.0)).collect()}
    assert got == want and len(want) > 20


def test_runs_are_made_once(spark, small):
    plan = catalog.QUERIES["column_verdicts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan  # documents are cut into runs before, and these stored


def test_runs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(columns, "ROWS", 2)
    runs = spark.createDataFrame([("a", 1, i, 0, 0.0, 9.0, 5) for i in range(40)], SCHEMA)
    pages = spark.createDataFrame([("a", 1, 600.0, 10.0)], "doc string, page int, width double, font double")
    v = columns.verdicts(runs, pages)
    assert [r.columns for r in v.collect()] == [1]
    assert "hashpartitioning(doc" in (x := v._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in x
