"""Published tables and the contract of landed records."""

import json

import pytest
from pyspark.sql import functions as F

from panelspark.operators.quality import Rule, RuleViolation
from panelspark.sources import published as pb
from panelspark.sources.records import landed_faults, validate_landed

def even():
    return Rule("even", F.col("id") % 2 == 1)


def test_a_checked_write_is_one_job(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sparkContext.setJobGroup("publishing", "")
    try:
        said = pb.publish(spark.range(0, 100, 2), path, rules=[even()])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("publishing")
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(jobs) == 1
    assert (said["rows"], said["rules"]) == (50, ["even"])
    assert pb.read_published(spark, path).count() == 50


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    pb.publish(spark.range(4).withColumn("v", F.lit("old")), path, partition_by=["v"])
    broken = spark.range(4).withColumn("v", F.when(F.col("id") < 9, F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        pb.publish(broken, path)
    with pytest.raises(RuleViolation, match="even.*2"):
        pb.publish(spark.range(4), path, rules=[even()])
    with pytest.raises(RuleViolation, match="0 rows"):
        pb.publish(spark.range(0), path)
    assert {(r.id, r.v) for r in pb.read_published(spark, path).collect()} == {(i, "old") for i in range(4)}
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1


def test_a_new_version_replaces_the_old_one_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    pb.publish(spark.range(9), path)
    old = pb.read_published(spark, path)
    pb.publish(spark.range(3).select(F.col("id").cast("string").alias("name")), path, fmt="json")
    assert old.count() == 9  # a reader that began before still reads its version
    assert sorted(r.name for r in pb.read_published(spark, path).collect()) == ["0", "1", "2"]
    assert pb.drop_old_versions(spark, path) == 1
    assert pb.read_published(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        pb.read_published(spark, str(tmp_path / "none"))


GOOD = {
    "source_id": "a", "category": "b", "url": "http://x", "fetched_at_utc": "2024-01-01T00:00:00+00:00",
    "status_code": 200, "title": None, "headings": ["x", ""], "table_previews": [[{"c": None}]], "error": None,
}

CASES = [
    (GOOD, []),
    (GOOD | {"status_code": None, "headings": [], "table_previews": [], "title": "t", "error": "e"}, []),
    ({k: v for k, v in GOOD.items() if k not in ("title", "url")}, ["missing url", "missing title"]),
    (GOOD | {"z": 1, "more": None}, ["unexpected more", "unexpected z"]),
    (GOOD | {"category": " \t\n ", "url": 5, "source_id": None}, ["not text: source_id", "not text: category", "not text: url"]),
    (GOOD | {"status_code": "200"}, ["neither integer nor null: status_code"]),
    (GOOD | {"status_code": True}, ["neither integer nor null: status_code"]),
    (GOOD | {"status_code": 200.5}, ["neither integer nor null: status_code"]),
    (GOOD | {"title": 1, "error": ["x"]}, ["neither text nor null: title", "neither text nor null: error"]),
    (GOOD | {"headings": "x"}, ["not a list of text: headings"]),
    (GOOD | {"headings": ["x", None]}, ["not a list of text: headings"]),
    (GOOD | {"headings": ["x", 2]}, ["not a list of text: headings"]),
    (GOOD | {"headings": None}, ["not a list of text: headings"]),
    (GOOD | {"table_previews": {"a": 1}}, ["not a list: table_previews"]),
    (GOOD | {"status_code": float("nan")}, ["not valid JSON"]),
    (GOOD | {"table_previews": [[{"c": float("inf")}]]}, ["not valid JSON"]),
    ([GOOD], ["not an object"]),
    ("text", ["not an object"]),
]


def lines(spark, cases):
    return spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "id int, value string")


def test_every_fault_of_a_record_is_named(spark):
    texts = [json.dumps(c) for c, _ in CASES] + [None, "", "{", json.dumps(GOOD)[:-5]]
    want = [f for _, f in CASES] + [["not valid JSON"]] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    good, bad = validate_landed(df, on_violation="quarantine")
    assert {r.id for r in good.collect()} == {i for i, f in enumerate(want) if not f}
    assert {r.id: sorted(r.faults) for r in bad.collect()} == {i: sorted(f) for i, f in enumerate(want) if f}
    counts = {r.fault: r.records for r in landed_faults(df).collect()}
    assert counts["not valid JSON"] == 6 and counts["neither integer nor null: status_code"] == 3


def test_valid_lines_pass_and_others_stop(spark):
    fine = lines(spark, [GOOD])
    assert validate_landed(fine) is fine
    with pytest.raises(RuleViolation, match="1 of 2 records"):
        validate_landed(lines(spark, [GOOD, []]))
    with pytest.raises(RuleViolation, match="no record"):
        validate_landed(lines(spark, []))
