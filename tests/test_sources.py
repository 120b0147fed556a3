"""Scratch storage and round trips of the writers."""

import datetime as dt

import pytest

from panelspark.sources import storage
from panelspark.sources import writers as wr


class Conf(dict):
    def get(self, name, default=None):
        return dict.get(self, name, default)


class Context:
    def __init__(self, folder=None):
        self.folder = folder

    def getCheckpointDir(self):
        return self.folder


class Session:
    def __init__(self, folder=None, **conf):
        self.sparkContext = Context(folder)
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_configured_folder_wins():
    session = Session("/mnt/other", spark_checkpoint_dir="hdfs:///shared/")
    assert storage.shared_dir(session) == "hdfs:///shared"
    a, b = (storage.scratch_path(session, "x") for _ in range(2))
    assert a != b and a.startswith("hdfs:///shared/panelspark/x-")


def test_without_setting():
    assert storage.shared_dir(Session("/mnt/shared")) == "/mnt/shared"
    assert storage.shared_dir(Session(spark_sql_warehouse_dir="file:/w")) == "file:/w/_scratch"


def test_panel_csv_has_iso_dates(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 2), 1.5)], "k string, d date, v double")
    wr.write_panel(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert text == "k,d,v\na,2020-01-02,1.5\n"


def test_metrics_json_keeps_nulls(spark, tmp_path):
    df = spark.sql("SELECT struct(1 AS a, CAST(NULL AS STRING) AS b) AS m")
    wr.write_metrics_json(df.coalesce(1), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("part-*.json"))
    assert text == '{"m":{"a":1,"b":null}}\n'


def test_a_warehouse_on_one_machine_is_no_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session(spark_sql_warehouse_dir="file:/w", spark_master="spark://a:7077"))
    far = Session(spark_sql_warehouse_dir="hdfs:///w", spark_master="spark://a:7077")
    assert storage.shared_dir(far) == "hdfs:///w/_scratch"
