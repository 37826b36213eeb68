import glob
import os

import duckdb
import pytest

import __spark_entry__
from quillvec.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if x is None or x != x else x for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalogue.SQL:
        want = duck.execute(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.mark.parametrize("name", ["embed_mean", "search_concat", "text_search_top1", "tokenize_metaspace", "valid_token_filter"])
def test_texts_are_tokenised_once(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_tokens_are_summed_before_they_are_shuffled(spark):
    plan = catalogue.valid_token_filter(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "doc_id" not in plan.split("Generate")[0]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_missing_subpackage_is_the_only_error_that_is_passed_over(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name=missing.name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing)
    missing.name = "quillvec.llm"
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and __spark_entry__.oracle_sql() == catalogue.SQL
    missing.name = "xxhash"
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
