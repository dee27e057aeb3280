"""Plan checks: pruning and push-down reach the scan, no cartesian products, bounded broadcasts."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    return E.queries()


def test_scan_prunes_and_pushes_filter(spark, qs):
    plan = _plan(qs["scan_pruned"](spark, SF))
    assert "PushedFilters: [IsNotNull(p_size), GreaterThanOrEqual(p_size,25)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int,p_retailprice:double>" in plan


def test_nested_read_schema_prunes_struct_fields(spark, tmp_path):
    from larder import schemas
    from larder.sources import io as IO
    path = str(tmp_path / "raw")
    spark.createDataFrame([([("en", "Milk")], [("carbohydrates", 1.0, 2.0)])], schemas.PRODUCTS_RAW) \
        .write.parquet(path)
    df = IO.scan(spark, path, schema=schemas.PRODUCTS_RAW_PRUNED)
    plan = _plan(df)
    assert "nutriments:array<struct<name:string,100g:float>>" in plan


@pytest.mark.parametrize("key", ["label_recipes", "vegan_items", "lexicon_hits", "term_matches",
                                 "search_ranked", "knn_exact", "median_join", "ingredient_vocab"])
def test_no_cartesian_product(spark, qs, key):
    plan = _optimized(qs[key](spark, SF))
    assert "CartesianProduct" not in plan and "Join Cross" not in plan


def test_lexicon_lookups_are_broadcast(spark, qs):
    plan = _plan(qs["vegan_items"](spark, SF))
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan


def test_text_rules_stay_in_the_jvm(spark, qs):
    plan = _plan(qs["label_recipes"](spark, SF))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_bounded_broadcast_falls_back(spark):
    from larder.operators.util import bounded_broadcast
    big = spark.range(0, 1000)
    small = spark.range(0, 10)
    j_big = spark.range(0, 100000).join(bounded_broadcast(big, max_rows=100), "id")
    j_small = spark.range(0, 100000).join(bounded_broadcast(small, max_rows=100), "id")
    assert "ResolvedHint (strategy=broadcast)" not in j_big._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in j_small._jdf.queryExecution().analyzed().toString()


def test_every_key_has_an_oracle_or_is_listed(qs):
    sqls = E.oracle_sql()
    from larder.plans.registry import load_all
    assert {k for k in load_all()[0] if k not in sqls} == set()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["p_brand", "p_size", "vegan", "keto", "n_items"]
    assert df.count() > 0


def test_diet_filter_prunes_label_folders(spark, qs):
    plan = _plan(qs["labelled_load"](spark, SF))
    assert "PartitionFilters: [" in plan and "keto" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("key,agg", [("label_recipes", "partial_min"), ("median_per_key", "partial_percentile_approx"),
                                     ("median_hot_groups", "partial_count"),
                                     ("keyword_heuristic", "partial_min"), ("term_stats", "partial_count")])
def test_group_results_are_combined_map_side(spark, qs, key, agg):
    # a key holding a third of the rows is pre-aggregated in every task before the shuffle
    plan = _plan(qs[key](spark, SF))
    assert agg in plan


def test_spread_only_when_the_scan_is_narrow(spark, tmp_path):
    from larder.session import spread
    wide = str(tmp_path / "wide")
    spark.range(0, 200000).repartition(16).write.parquet(wide)
    df = spark.read.parquet(wide)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(df) is df                                   # many splits: no extra shuffle
    narrow = spark.read.parquet(f"{SF}/documents.parquet")
    out = spread(narrow)
    assert out is not narrow and out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    tiny = spark.read.parquet(f"{SF}/region.parquet")
    assert spread(tiny) is tiny                               # too small to be worth a shuffle
