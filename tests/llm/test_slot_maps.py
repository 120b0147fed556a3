"""Versions of the slot map from run to run."""

import pytest
from pyspark.sql import functions as F

from panelspark.llm import sharding


def test_a_run_edits_the_stored_map(spark, make_docs, tmp_path):
    path = str(tmp_path / "map")
    assert sharding.stored_map(spark, path) is None
    docs = make_docs([(i, "x" * (i % 50)) for i in range(300)])
    first = {r.doc_id: (r.shard, r.map_version) for r in sharding.assign(docs, shards=4, slots=64, store=path).collect()}
    assert {v for _, v in first.values()} == {1}
    # One more shard: the next version moves slots only as far as the balance asks.
    second = {r.doc_id: (r.shard, r.map_version) for r in sharding.assign(docs, shards=5, slots=64, store=path).collect()}
    assert {v for _, v in second.values()} == {2}
    moved = [i for i in first if first[i][0] != second[i][0]]
    fresh = {r.doc_id: r.shard for r in sharding.assign(docs, shards=5, slots=64).collect()}
    assert 0 < len(moved) < sum(first[i][0] != fresh[i] for i in first)
    for version, shards in ((1, 4), (2, 5), (None, 5)):
        rows = sharding.stored_map(spark, path, version).collect()
        assert sorted(r.slot for r in rows) == list(range(64)) and {r.shard for r in rows} == set(range(shards))


def test_versions_only_go_forward_and_slots_are_placed(spark, tmp_path):
    path = str(tmp_path / "map")
    sharding.store_map(sharding.first_map(spark, 3, 9), path)
    with pytest.raises(ValueError, match="not after"):
        sharding.store_map(sharding.first_map(spark, 3, 9), path)
    lost = sharding.first_map(spark, 3, 9).select(
        (F.col("version") + 1).alias("version"), "slot", F.when(F.col("slot") > 0, F.col("shard")).alias("shard")
    )
    with pytest.raises(ValueError, match="placed:slot"):
        sharding.store_map(lost, path)
    assert {r.version for r in sharding.stored_map(spark, path).collect()} == {0}
