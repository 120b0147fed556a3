"""As-of joins: hand-made cases, brute force, and hot keys."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelspark.operators import asof
from panelspark.operators.asof import Pick, Source, asof_calendar_offset, asof_join, asof_many
from panelspark.operators.hotkeys import SLICE, slice_of

D = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


RIGHT = [("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 10), 2.0), ("a", D(2020, 1, 20), None), ("a", D(2020, 1, 25), 3.0)]
LEFT = [D(2020, 1, d) for d in (1, 8, 9, 10, 18, 26)]


@pytest.mark.parametrize(
    "kw, want",
    [
        ({}, [1, 1, 1, 2, 2, 3]),
        ({"allow_exact": False, "tolerance_days": 7}, [None, 1, None, None, None, 3]),
        ({"direction": "forward", "allow_exact": False, "tolerance_days": 7}, [None, 2, 2, None, 3, None]),
    ],
)
@pytest.mark.parametrize("unique", [True, False])
def test_directions_and_tolerance(spark, kw, want, unique):
    left = frame(spark, [("a", d) for d in LEFT], "k string, d date")
    right = frame(spark, RIGHT, "k string, rd date, v double").where("v IS NOT NULL")
    out = asof_join(
        left, right, key=["k"], left_date="d", right_date="rd", values=["v"], left_unique=unique, **kw
    )
    assert [r.v for r in out.orderBy("d").collect()] == want


def test_duplicate_left_rows_are_kept(spark):
    left = frame(spark, [(1, "a", D(2020, 1, 5)), (2, "a", D(2020, 1, 5)), (3, "b", D(2020, 1, 5))], "id int, k string, d date")
    right = frame(spark, RIGHT, "k string, rd date, v double")
    out = asof_join(left, right, key=["k"], left_date="d", right_date="rd", values=["v"])
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, 1.0), (2, 1.0), (3, None)]


def test_several_sources_and_availability(spark):
    left = frame(spark, [("a", D(2020, 1, 26))], "k string, d date")
    right = frame(spark, RIGHT, "k string, rd date, v double")
    from pyspark.sql import functions as F

    src = Source(
        right,
        "rd",
        [
            Pick({"v": "any"}, reference_col="any_date"),
            Pick({"v": "low"}, reference_col="low_date", where=F.col("v") < 3),
        ],
    )
    row = asof_many(left, [src], key=["k"], left_date="d", left_unique=True).first()
    assert (row.any, row.any_date) == (3.0, D(2020, 1, 25))
    assert (row.low, row.low_date) == (2.0, D(2020, 1, 10))


def test_calendar_offset_clamps_to_month_end(spark):
    left = frame(spark, [("a", D(2020, 5, 31)), ("a", D(2019, 3, 31))], "k string, d date")
    right = frame(spark, [("a", D(2019, 2, 28), 5.0), ("a", D(2020, 2, 29), 6.0), ("a", D(2020, 3, 1), 7.0)], "k string, rd date, v double")
    out = asof_calendar_offset(
        left, right, key=["k"], event_date="d", series_date="rd", value="v", months=(1, 3), out="m{}"
    )
    got = {r.d: (r.m1, r.m3) for r in out.collect()}
    assert got == {D(2020, 5, 31): (7.0, 6.0), D(2019, 3, 31): (5.0, None)}


def brute(left, right, direction, exact, tol):
    out = []
    for k, t in left:
        best = None
        for rk, rt, v in right:
            if rk != k:
                continue
            ok = (rt < t or (exact and rt == t)) if direction == "backward" else (rt > t or (exact and rt == t))
            if ok and (best is None or abs(rt - t) < abs(best[0] - t)):
                best = (rt, v)
        if best and tol is not None and abs(best[0] - t) > dt.timedelta(days=tol):
            best = None
        out.append((k, t, best[1] if best else None))
    return sorted(out, key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), min_size=1, max_size=25),
    st.sets(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), min_size=1, max_size=25),
    st.sampled_from(["backward", "forward"]),
    st.booleans(),
    st.sampled_from([None, 3, 7]),
)
def test_dates_against_brute_force(spark, left, right, direction, exact, tol):
    day = lambda n: D(2020, 1, 1) + dt.timedelta(days=n)
    left = [(k, day(n)) for k, n in left]
    right = [(k, day(n), float(n)) for k, n in right]
    out = asof_join(
        frame(spark, left, "k string, t date"),
        frame(spark, right, "k string, rt date, v double"),
        key=["k"], left_date="t", right_date="rt", values=["v"],
        direction=direction, allow_exact=exact, tolerance_days=tol,
    )
    assert sorted([tuple(r) for r in out.select("k", "t", "v").collect()], key=repr) == brute(
        left, right, direction, exact, tol
    )


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("unique", [True, False])
def test_hot_timestamp_keys_are_sliced(spark, direction, exact, unique):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    ticks = lambda n: [t0 + dt.timedelta(hours=h) for h in rnd.sample(range(3000), n)]
    left = [("hot", t) for t in ticks(400)] + [("cold", t) for t in ticks(20)]
    right = [("hot", t, i * 1.0) for i, t in enumerate(ticks(60))] + [("cold", t, -1.0 * i) for i, t in enumerate(ticks(5))]
    l = frame(spark, left, "k string, t timestamp_ntz")
    r = frame(spark, right, "k string, rt timestamp_ntz, v double")
    kw = dict(key=["k"], left_date="t", right_date="rt", values=["v"], direction=direction, allow_exact=exact, tolerance_days=3, left_unique=unique)
    sliced = asof_join(l, r, slices="week", **kw)
    assert SLICE in sliced._jdf.queryExecution().optimizedPlan().toString()
    got = sorted([tuple(x) for x in sliced.select("k", "t", "v").collect()], key=repr)
    assert got == brute(left, right, direction, exact, 3)


def test_null_keys_meet_nothing_but_are_kept(spark):
    t0 = dt.datetime(2024, 1, 1)
    left = [(None, t0 + dt.timedelta(hours=h)) for h in range(50)] + [("a", t0 + dt.timedelta(days=3))]
    right = [("a", t0, 1.0), ("a", t0 + dt.timedelta(days=9), 2.0)]
    out = asof_join(
        frame(spark, left, "k string, t timestamp_ntz"),
        frame(spark, right, "k string, rt timestamp_ntz, v double"),
        key=["k"], left_date="t", right_date="rt", values=["v"], slices="day",
    ).collect()
    assert len(out) == 51
    assert {r.v for r in out if r.k is None} == {None} and [r.v for r in out if r.k] == [1.0]


def test_slices_are_bounded_and_ordered(spark):
    df = frame(spark, [(i,) for i in range(4000)], "o int")
    got = df.select("o", slice_of(df, "o", 40).alias(SLICE)).collect()
    assert all(r[SLICE] == r.o // 40 for r in got)
    days = frame(spark, [(D(2020, m, 2),) for m in range(1, 13)], "d date")
    assert days.select(slice_of(days, "d", "quarter").alias("s")).distinct().count() == 4
    with pytest.raises(ValueError):
        slice_of(days, "d", 40)
    with pytest.raises(ValueError):
        slice_of(df, "o", "day")


def test_months_ago_in_one_pass_equals_moving_the_events(spark):
    rnd = random.Random(12)
    days = [dt.date(2023, 12, 20) + dt.timedelta(days=i) for i in range(480)]
    series = spark.createDataFrame(
        [("a", d, float(i)) for i, d in enumerate(days) if rnd.random() < 0.6 or d.day > 27], "k string, d date, v double"
    )
    events = spark.createDataFrame([("a", d, i) for i, d in enumerate(days)] + [("b", days[0], 999)], "k string, t date, id int")
    sources = [
        asof.Source(series, "d", [asof.Pick({"v": f"ago{m}"}, reference_col=f"ref{m}")], months_ago=m) for m in (1, 3, 12)
    ]
    sources.append(asof.Source(series, "d", [asof.Pick({"v": "now"})], allow_exact=False))
    out = asof.asof_many(events, sources, key=["k"], left_date="t", left_unique=True).collect()
    want = asof.asof_calendar_offset(
        events, series, key=["k"], event_date="t", series_date="d", value="v", months=(1, 3, 12), out="ago{}"
    )
    moved = {r.id: (r.ago1, r.ago3, r.ago12) for r in want.collect()}
    assert {r.id: (r.ago1, r.ago3, r.ago12) for r in out} == moved and len(out) == 481
    known = sorted((r.d, r.v) for r in series.collect())
    for r in out[:-1]:
        if r.k == "a":
            assert r.now == max((v for d, v in known if d < r.t), default=None)


def test_repeated_values_of_a_series_are_refused(spark):
    events = spark.createDataFrame([("a", dt.date(2024, 1, 5))], "k string, t date")
    rows = [("a", dt.date(2024, 1, 1), "x", 1.0), ("a", dt.date(2024, 1, 1), "x", 2.0)]
    series = spark.createDataFrame(rows, "k string, date date, series_id string, value double")
    with pytest.raises(Exception, match="x: two values"):
        asof.asof_multi(events, series, key=["k"], event_date="t", series_ids=["x"]).collect()
