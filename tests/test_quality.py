"""Rules, guards and readers that fail loudly."""

import json

import pytest
from pyspark.sql import functions as F

from panelspark.functions import values as fv
from panelspark.operators import quality as q
from panelspark.operators.joins import left_join_one_to_one
from panelspark.sources import readers as rd


def counts(df, rules):
    return {r.rule: r.violations for r in q.violations(df, rules).collect()}


def test_row_rules(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "1", 1.0), ("2020-02-30", "", float("nan")), ("x", "abc", None), (None, " 2 ", float("inf"))],
        "d string, t string, v double",
    )
    got = counts(df, [q.valid_date("d", fmt="yyyy-MM-dd"), q.numeric("t"), q.not_null_finite("v"), q.not_blank("t")])
    assert got == {"valid_date:d": 3, "numeric:t": 1, "finite:v": 3, "not_blank:t": 1}


def test_raise_lists_samples_and_passes_clean_data(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(12)], "id int, v int")
    with pytest.raises(q.RuleViolation) as e:
        q.expect(df, [q.in_range("v", 0, 1), q.Unique("unique:v", ["v"])])
    assert "range:v" in str(e.value) and "unique:v" in str(e.value)
    assert q.expect(df, [q.in_range("v", 0, 2), q.Unique("unique:id", ["id"])]) is df


def test_quarantine_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id int, v double")
    good, bad = q.expect(df, [q.not_null("v"), q.in_range("v", 0)], on_violation="quarantine")
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.broken_rules for r in bad.collect()} == {2: ["not_null:v"], 3: ["range:v"]}


def test_schema_and_leakage(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert q.schema_report(df, ["a", "c"]) == {"missing": ["c"], "unexpected": ["b"], "order": []}
    with pytest.raises(q.RuleViolation):
        q.require_schema(df, ["b", "a"], mode="ordered")
    with pytest.raises(q.RuleViolation):
        q.require_schema(df.where("a > 5"), ["a", "b"], non_empty=True)
    for c in ("rate_after", "Lead_1", "label_x", "next_rate", "future"):
        with pytest.raises(q.RuleViolation):
            q.leakage_column_guard(df.withColumn(c, F.lit(1)), features=["a"])
    with pytest.raises(q.RuleViolation):
        q.leakage_column_guard(df, features=["decision"])
    assert q.leakage_column_guard(df.withColumn("policy_rate_after", F.lit(1)), features=["a"])


def test_variation_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, None, 3), (1, 2, None), (1, 2, None)], "a int, b int, c int")
    df = df.withColumn("n", F.lit(None).cast("int"))
    got = {r.column_name: r.no_variation for r in q.distinct_variation(df, ["a", "b", "c", "n"]).collect()}
    assert got == {"a": True, "b": False, "c": False, "n": True}


def test_one_to_one_is_asserted(spark):
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    two = spark.createDataFrame([(1, "y"), (1, "z")], "k int, w string")
    with pytest.raises(q.RuleViolation):
        left_join_one_to_one(one, two, on=["k"])


@pytest.mark.parametrize("bps, want", [(0.25, "hold"), (0.26, "hike"), (-0.25, "hold"), (-25.0, "cut")])
def test_label_bounds(spark, bps, want):
    assert spark.range(1).select(fv.label_from_bps(F.lit(bps)).alias("x")).first().x == want


def test_series_csv_fails_loudly(spark, tmp_path):
    def read(text, **kw):
        p = tmp_path / f"s{abs(hash(text))}.csv"
        p.write_text(text)
        return rd.read_series_csv(spark, str(p), "x", **kw)

    rows = read("date,value\n2020-01-02,2\n2020-01-01,\n").orderBy("date").collect()
    assert [r.x for r in rows] == [None, 2.0]
    for bad in ("date,value\n2020-01-01,abc\n", "date,value\n2020-13-01,1\n", "date,value\n2020-01-01,1\n2020-01-01,2\n", "date,other\n2020-01-01,1\n"):
        with pytest.raises(q.RuleViolation):
            read(bad)
    good, rejected = read("date,value\n2020-01-01,abc\n2020-01-02,3\n", on_violation="quarantine")
    assert [r.x for r in good.collect()] == [3.0] and rejected.count() == 1


def test_series_json_documents(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"observations": [{"date": "2020-01-02", "value": "."}, {"date": "2020-01-01", "value": "1.5"}]}, indent=1))
    out = {str(r.date): r.value for r in rd.read_series_json(spark, str(p)).collect()}
    assert out == {"2020-01-01": 1.5, "2020-01-02": None}
    p2 = tmp_path / "b.json"
    p2.write_text(json.dumps({"error": "x"}))
    with pytest.raises(q.RuleViolation):
        rd.read_series_json(spark, str(p2))


def test_series_json_quarantine(spark):
    docs = spark.createDataFrame(
        [(1, [("2020-01-01", "1"), ("2020-01-01", "2"), ("x", "3")]), (2, None), (3, [("2020-01-02", ".")])],
        "id int, observations array<struct<date:string,value:string>>",
    )
    good, bad = rd.parse_series_json(docs, key=["id"], on_violation="quarantine")
    assert [(r.id, r.value) for r in good.collect()] == [(3, None)]
    assert sorted((r.id, r.date or "", sorted(r.broken_rules)) for r in bad.collect()) == [
        (1, "2020-01-01", ["unique:date"]),
        (1, "2020-01-01", ["unique:date"]),
        (1, "x", ["valid_date:date"]),
        (2, "", ["observations", "valid_date:date"]),
    ]


def test_quarantine_of_repeated_keys_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (3, None)], "k int, v string")
    good, bad = q.expect(df, [q.Unique("unique:k", ["k"]), q.not_null("v")], on_violation="quarantine")
    assert [tuple(r) for r in good.collect()] == [(2, "c")]
    assert good.columns == df.columns
    assert sorted((r.k or 0, r.v or "", r.broken_rules) for r in bad.collect()) == [
        (0, "d", ["unique:k"]), (0, "e", ["unique:k"]), (1, "a", ["unique:k"]), (1, "b", ["unique:k"]), (3, "", ["not_null:v"]),
    ]


def test_catalog_reads_files_by_name(spark, tmp_path):
    for n in ("target_rate", "unemployment"):
        (tmp_path / f"{n}.csv").write_text("date,value\n2020-01-01,1\n")
    long = rd.read_series_catalog(spark, str(tmp_path))
    assert {r.logical_name for r in long.collect()} == {"target_rate", "unemployment"}
    report = rd.verify_outputs_exist(long, rd.series_catalog(spark))
    assert report.where("rows = 0").count() == 20
    with pytest.raises(q.RuleViolation):
        rd.require_outputs(report)


@pytest.mark.parametrize(
    "name, text",
    [
        ("not_declared", "date,value\n2020-01-01,1\n"),
        ("unemployment", "date,value\nnot-a-date,1\n"),
        ("unemployment", "date,value\n2020-01-01,abc\n"),
        ("unemployment", "date,value\n2020-01-01,1\n2020-01-01,1\n"),
    ],
)
def test_catalog_fails_loudly(spark, tmp_path, name, text):
    (tmp_path / f"{name}.csv").write_text(text)
    with pytest.raises(q.RuleViolation):
        rd.read_series_catalog(spark, str(tmp_path))
    good, bad = rd.read_series_catalog(spark, str(tmp_path), on_violation="quarantine")
    assert good.count() == 0 and bad.count() == text.count("\n") - 1


def test_headers_are_compared(spark, tmp_path):
    (tmp_path / "unemployment.csv").write_text("value,date\n1,2020-01-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        rd.read_series_catalog(spark, str(tmp_path))
    (tmp_path / "calendar.csv").write_text("is_scheduled,meeting_date,source_url\ntrue,2020-01-01,u\n")
    with pytest.raises(Exception, match="(?i)header"):
        rd.read_event_calendar(spark, str(tmp_path / "calendar.csv"))


def test_calendar_fails_loudly(spark, tmp_path):
    path = tmp_path / "calendar.csv"
    path.write_text("meeting_date,is_scheduled,source_url\n2020-01-01,true,u\nnope,maybe,\n")
    with pytest.raises(q.RuleViolation):
        rd.read_event_calendar(spark, str(path))
    good, bad = rd.read_event_calendar(spark, str(path), on_violation="quarantine")
    assert good.count() == 1
    assert set(bad.first().broken_rules) == {"valid_date:meeting_date", "domain:is_scheduled", "not_blank:source_url"}
