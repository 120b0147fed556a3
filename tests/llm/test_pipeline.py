"""The pipeline stage by stage against brute force, and what plans may hold."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from panelspark.llm import exact, mixing, queries, secrets, sharding, toxicity, urls
from panelspark.llm.common import stage, table

from .conftest import ODD
from .test_dedup import distance, lowered, words
from .test_mixing_packing import check_packing

SF = "/root/testdata/sf0.001"


def near_by_hand(rows):
    """Least id of the class of each (id, text); ids are distinct."""
    tokens = [words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = tokens[i], tokens[j]
            longer = max(len(a), len(b))
            if not longer or min(len(a), len(b)) < 0.8 * longer:
                continue
            if longer - sum((Counter(a) & Counter(b)).values()) > 0.2 * longer:
                continue
            if distance(a, b) <= int(0.2 * longer + 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    return {min(x) for x in ids.values()}


def test_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    out = {}
    before = docs
    for name, function in corpus_pipeline.STAGES:
        out[name] = before = stage(function(spark, before, SF), "test")
    assert list(out) == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    rows = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in out.items() if name != "packing"}
    assert all(df.columns == names for name, df in out.items() if name != "packing")

    start = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, table(spark, SF, "labels"))
    assert sorted(rows["toxicity"]) == sorted(r for r in start if model.score(r[1] or "") < 0.5)
    groups = defaultdict(list)
    for i, t in rows["toxicity"]:
        groups[lowered(t)].append(i)
    assert {i for i, _ in rows["exact dedup"]} == {max(x) for x in groups.values()}
    assert len(rows["exact dedup"]) == len(groups)
    assert sorted(i for i, _ in rows["near dedup"]) == sorted(near_by_hand(rows["exact dedup"]))
    copies = {r.doc_id: r.copies for r in mixing.mix(out["near dedup"]).collect()}
    assert Counter(i for i, _ in rows["mixing"]) == Counter({i: n for i, n in copies.items() if n})
    check_packing(rows["mixing"], out["packing"].collect())


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:4] == ["doc_id", "piece", "start", "length"] and got.count() > 0


def test_stages_take_odd_rows_and_empty_tables(spark, make_docs):
    labels = SF
    for rows in (ODD, []):
        docs = make_docs(rows)
        for name, function in corpus_pipeline.STAGES:
            got = function(spark, docs, labels)
            assert name == "packing" or got.columns == docs.columns
            assert (got.count() > 0) == bool(rows)


@pytest.mark.parametrize("name", ["op3_sharding", "op5_exact_dedup", "op6_secrets", "op10_url_filter"])
def test_native_operators_run_no_python(spark, name):
    text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Pandas", "InArrow", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("module", [exact, secrets, sharding, urls])
def test_native_operators_import_no_python_engine(module):
    assert not {"pd", "np", "pandas", "numpy", "pyarrow"} & set(vars(module))


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names
    assert {x.rsplit("_", 1)[0] for x in __spark_entry__.oracle_sql()} <= {x.rsplit("_", 1)[0] for x in names}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    from check import compare

    problem = compare(spark, SF, queries.QUERIES[name], queries.ORACLE[name])
    assert problem is None, problem
