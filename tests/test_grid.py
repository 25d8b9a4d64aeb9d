"""The grid is worked out at the samples: no row of it is dealt, joined or written on the way."""

from stridewell.operators import resample as R

KEY = ["pid"]


def rows(spark):
    found = [(1, 0, 0.0, 1.0), (1, 1, 3.1, None), (1, 2, 3.2, 4.0), (1, 3, 6.0, 10.0), (1, 4, 8.6, None), (2, 0, 5.0, None), (None, 0, 1.0, 2.0)]
    return spark.createDataFrame(found, "pid long, idx long, t double, x double")


def test_places_and_gaps(spark):
    made = R.filled_grid(rows(spark), KEY, 1.0, 1.0, ("x",), ("idx",)).orderBy("pid", "k", "idx").collect()
    own = [(r.k, r.idx, r.x) for r in made if r.pid == 1]
    # Places 3 has two rows, so the line from the first sample to the third has four steps.
    assert own == [(0, 0, 1.0), (1, None, 1.75), (2, None, 2.5), (3, 1, 3.25), (3, 2, 4.0), (4, None, 6.0), (5, None, 8.0), (6, 3, 10.0), (7, None, None), (8, None, None), (9, 4, None)]
    assert [(r.pid, r.k, r.x) for r in made if r.pid != 1] == [(None, 0, 2.0), (2, 0, None)]


def test_only_samples_are_dealt(spark):
    for made in (R.left_join_grid(rows(spark), KEY, 1.0, 1.0), R.filled_grid(rows(spark), KEY, 1.0, 1.0, ("x",), ("idx",))):
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "Join" not in plan and plan.count("Exchange") == 1
