"""Calendar grids, month windows and event history."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import calendar as cal
from panelspark.operators import windows as w

D = dt.date
T0 = dt.datetime(2024, 1, 1)


def test_month_end_last_skips_nulls_and_keeps_gaps(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 5), 1.0), ("a", D(2020, 1, 20), None), ("a", D(2020, 3, 2), 3.0)],
        "k string, d date, v double",
    )
    out = cal.resample_month_end_last(df, key=["k"], date="d", values=["v"]).orderBy("d").collect()
    assert [(r.d, r.v) for r in out] == [(D(2020, 1, 31), 1.0), (D(2020, 2, 29), None), (D(2020, 3, 31), 3.0)]


def test_densify_equals_spine(spark):
    rows = [("a", D(2020, 2, 27), 1.0), ("a", D(2020, 3, 2), None), ("b", D(2021, 1, 1), 2.0)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    dense = {(r.k, r.d): r.v for r in cal.densify(df, key=["k"], date="d").collect()}
    spine = {(r.k, r.d) for r in cal.calendar_spine(df, key=["k"], date="d").collect()}
    assert set(dense) == spine and len(spine) == 6
    assert dense[("a", D(2020, 2, 27))] == 1.0 and dense[("a", D(2020, 2, 28))] is None


def test_forward_fill_never_backwards_and_sliced(spark):
    rnd = random.Random(3)
    rows = [("hot", i, rnd.choice([None, None, None, float(i)])) for i in range(400)]
    rows += [("cold", 0, None), ("cold", 1, 5.0), ("cold", 2, None)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    want, last = {}, {}
    for k, o, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[(k, o)] = last[k]
    for limit in (None, 30):
        out = cal.forward_fill(df, key=["k"], order="o", values=["v"], slices=limit)
        assert {(r.k, r.o): r.v for r in out.collect()} == want


def test_month_windows_need_complete_history(spark):
    rows = [("a", D(2020, m, 28), None if m == 5 else float(m)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    m = cal.resample_month_end_last(df, key=["k"], date="d", values=["v"])
    m = w.rolling_mean_full(m, key=["k"], order="d", value="v", n=3, out="ma")
    m = w.diff_n(m, key=["k"], order="d", value="v", n=3, out="df")
    m = w.pct_change_complete(m, key=["k"], order="d", value="v", periods=2, out="pc")
    out = {r.d.month: (r.ma, r.df, r.pc) for r in m.collect()}
    assert out[2] == (None, None, None)
    assert out[3] == (2.0, None, 200.0)
    assert out[7][0] is None and out[8][0] == 7.0
    assert out[8][1] is None and out[9][1] == 3.0


def splice_case(spark):
    f = lambda rows: spark.createDataFrame([("a", d, v) for d, v in rows], "k string, date date, value double")
    point = f([(D(2008, 12, 10), 1.0), (D(2008, 12, 15), 2.0), (D(2008, 12, 20), 9.0)])
    lower = f([(D(2008, 12, 1), 7.0), (D(2008, 12, 17), 0.0)])
    upper = f([(D(2008, 12, 16), 0.25), (D(2008, 12, 18), 0.5), (D(2008, 12, 21), None)])
    return point, lower, upper


def test_splice(spark):
    point, lower, upper = splice_case(spark)
    # Both bounds first exist on the 16th; a bound before the calendar is not carried in.
    out = {r.date.day: r for r in cal.splice_series(point, lower, upper, key=["k"]).collect()}
    assert sorted(out) == list(range(10, 19))
    assert out[12].policy_rate == 1.0 and out[12].policy_regime == "point_target"
    assert out[15].target_lower == out[15].target_upper == 2.0
    assert out[16].policy_regime == "target_range" and out[16].target_lower is None
    assert (out[17].target_lower, out[17].target_upper, out[17].policy_rate) == (0.0, 0.25, 0.125)
    assert out[18].policy_rate == 0.25


DECISIONS = ["hike", "hike", "hold", "cut", "cut", "cut", "hike"]


def history(spark, decisions, **kw):
    rows = [("a", T0 + dt.timedelta(days=10 * i), x, int(x != "hold"), float(i)) for i, x in enumerate(decisions)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, decision string, is_change int, rate_change_bps double")
    return w.history_features(df, key=["k"], date="ts", scheduled=None, **kw).orderBy("ts").collect()


def test_hand_made_history(spark):
    out = history(spark, DECISIONS)
    assert [r.same_direction_streak for r in out] == [0, 1, 2, 0, 1, 2, 3]
    assert [r.prior3_direction for r in out] == [0, 1, 2, 2, 0, -2, -3 + 0]
    assert [r.prior3_change_count for r in out] == [0, 1, 2, 2, 2, 2, 3]
    assert [r.days_since_prior_meeting for r in out] == [0, 10, 10, 10, 10, 10, 10]
    assert [r.days_since_prior_change for r in out] == [3650, 10, 10, 20, 10, 10, 10]
    assert [r.prior_rate_change_bps for r in out] == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def reference_history(rows):
    """Row loop over one ordered history."""
    out, code = [], {"cut": -1, "hold": 0, "hike": 1}
    streak, prev, changed = 0, 0, None
    for i, (t, label, size) in enumerate(rows):
        prior = rows[max(0, i - 3):i]
        out.append((
            t,
            code[rows[i - 1][1]] if i else 0,
            int(rows[i - 1][1] != "hold") if i else 0,
            int(rows[i - 2][1] != "hold") if i > 1 else 0,
            sum(x[1] != "hold" for x in prior),
            sum(code[x[1]] for x in prior),
            rows[i - 1][2] if i else 0.0,
            streak,
            (t.date() - rows[i - 1][0].date()).days if i else 0,
            min(max((t.date() - changed.date()).days, 0), 3650) if changed else 3650,
        ))
        c = code[label]
        streak = 0 if c == 0 else (streak + 1 if c == prev else 1)
        prev = c
        if c:
            changed = t
    return out


@pytest.mark.parametrize("seed, slices", [(1, None), (1, "week"), (2, "month"), (3, "auto"), (4, "day")])
def test_history_against_a_loop_and_sliced(spark, seed, slices):
    rnd = random.Random(seed)
    data, want = [], []
    for k, n in (("hot", 150), (None, 40), ("cold", 2)):
        times = sorted(T0 + dt.timedelta(hours=h) for h in rnd.sample(range(20000), n))
        # Long runs, so that streaks and carried changes cross slices.
        labels, cur = [], "hold"
        for _ in times:
            if rnd.random() < 0.15:
                cur = rnd.choice(["cut", "hold", "hike"])
            labels.append(cur)
        rows = [(t, l, round(rnd.random(), 3)) for t, l in zip(times, labels)]
        data += [(k, t, l, int(l != "hold"), s) for t, l, s in rows]
        want += [(k, *r) for r in reference_history(rows)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, decision string, is_change int, rate_change_bps double")
    out = w.history_features(df, key=["k"], date="ts", scheduled=None, slices=slices)
    got = [tuple(r) for r in out.select("k", "ts", *w.HISTORY_COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_equal_instants_are_ordered_by_the_tie_column(spark):
    rows = [(None, T0, i, i % 3) for i in range(9)] + [(None, T0 + dt.timedelta(hours=5), 9, 0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v int").repartition(4)
    for slices in (None, "hour"):
        got = {
            r.id: r.x
            for r in w.prior_rolling_sum(
                df, key=["k"], order="ts", value="v", n=3, out="x", ties=["id"], slices=slices
            ).collect()
        }
        assert got == {i: sum(r[3] for r in rows[max(0, i - 3) : i]) for i in range(10)}


def test_no_job_runs_while_a_plan_is_built(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
    spark.sparkContext.setJobGroup("building", "")
    try:
        w.prior_rolling_sum(df, key=["k"], order="o", value="v", out="x", slices=10)
        cal.forward_fill(df, key=["k"], order="o", values=["v"], slices=10)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_truncation_changes_nothing(spark):
    rows = [("a", T0 + dt.timedelta(days=i), random.Random(i).choice(["cut", "hold", "hike"])) for i in range(30)]
    df = spark.createDataFrame([(k, t, d, int(d != "hold"), 1.0) for k, t, d in rows], "k string, ts timestamp_ntz, decision string, is_change int, rate_change_bps double")
    from pyspark.sql import functions as F

    cutoff = F.lit(T0 + dt.timedelta(days=12)).cast("timestamp_ntz")
    assert w.no_lookahead_recheck(df, key=["k"], date="ts", cutoff=cutoff, scheduled=None).count() == 0


def test_single_history_operators_sliced(spark):
    rows = [("a", i, (i * 7) % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    for limit in (None, 6):
        kw = dict(key=["k"], order="o", value="v", slices=limit)
        lag = {r.o: r.x for r in w.lag_filled(df, n=2, fill=-1, out="x", **kw).collect()}
        assert all(lag[i] == (rows[i - 2][2] if i >= 2 else -1) for i in range(60))
        tot = {r.o: r.x for r in w.prior_rolling_sum(df, n=3, out="x", **kw).collect()}
        assert all(tot[i] == sum(x[2] for x in rows[max(0, i - 3):i]) for i in range(60))
