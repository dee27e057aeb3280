"""Product cleaning on the hand-made rows of FIXTURES.md section 3.2."""

import pytest
from pyspark.sql import Row

from larder import schemas
from larder.operators import products as P
from larder.operators.util import with_dense_ids


def _raw(spark, rows):
    return spark.createDataFrame(rows, schemas.PRODUCTS_RAW)


def N(name, value, g100):
    return Row(name=name, value=value, **{"100g": g100})


def L(lang, text):
    return Row(lang=lang, text=text)


def test_language_and_nutriment_pick(spark):
    raw = _raw(spark, [
        ([L("fr", "Lait"), L("EN", "Milk")], [N("fat", 1.0, 1.0), N("Carbohydrates", 5.0, 4.8)]),
        ([L("fr", "Lait")], [N("carbohydrates", 5.0, 4.0)]),
        ([L(None, "Milk")], [N("carbohydrates", 5.0, 4.0)]),
        ([L("en", "Cream")], [N(None, 1.0, 1.0), N("carbohydrates", 5.0, None)]),
    ])
    got = P.select_products(raw).collect()
    assert got[0].product_name == "Milk" and abs(got[0].carbohydrates_100g - 4.8) < 1e-6
    assert got[1].product_name is None and got[2].product_name is None
    assert got[3].product_name == "Cream" and got[3].carbohydrates_100g is None  # no fall back to value


def test_value_fallback_when_field_absent(spark):
    raw = spark.createDataFrame([([L("en", "Milk")], [Row(name="carbohydrates", value=5.0)])],
                                "product_name array<struct<lang:string,text:string>>, "
                                "nutriments array<struct<name:string,value:double>>")
    assert P.select_products(raw).first().carbohydrates_100g == 5.0


def test_clean_products_chain(spark):
    rows = [
        ([L("fr", "Lait"), L("EN", "Milk")], [N("carbohydrates", 5.0, 4.8)]),
        ([L("fr", "Lait")], [N("carbohydrates", 5.0, 4.0)]),
        ([L("en", "Crème Brûlée!")], [N("carbohydrates", 1.0, 20.0)]),
        ([L("en", "牛乳")], [N("carbohydrates", 1.0, 2.0)]),
        ([L("en", "A 1")], [N("carbohydrates", 1.0, 2.0)]),
        ([L("en", "Tomatoes")], [N("carbohydrates", 1.0, 1.0)]),
        ([L("en", "tomato")], [N("carbohydrates", 1.0, 2.0)]),
        ([L("en", "TOMATOES")], [N("carbohydrates", 1.0, 3.0)]),
        ([L("en", "tomato!")], [N("carbohydrates", 1.0, 10.0)]),
        ([L("en", "Bread")], [N("carbohydrates", 1.0, None)]),
    ]
    out = {r.product_name: r.carbohydrates_100g for r in P.clean_products(_raw(spark, rows)).collect()}
    assert out == {"milk": pytest.approx(4.8), "creme brulee": 20.0, "tomato": 2.0}


def test_median_lower_middle(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0)], "k string, v double")
    got = {r.k: r.median for r in P.median_per_key(df, "k", "v").collect()}
    assert got == {"a": 2.0, "b": 5.0}


def test_overrides_and_duplicates(spark):
    df = spark.createDataFrame([(1, "Milk", 4.0), (2, "bread", 40.0)], "id int, name string, carbs double")
    ov = spark.createDataFrame([("milk", 5.0)], "product_name string, carbohydrates_100g double")
    got = {r.id: r.carbs for r in P.apply_overrides(df, ov, "name", "carbs", "product_name", "carbohydrates_100g").collect()}
    assert got == {1: 5.0, 2: 40.0}
    dup = spark.createDataFrame([("milk", 5.0), ("MILK", 6.0)], "product_name string, carbohydrates_100g double")
    with pytest.raises(ValueError):
        P.apply_overrides(df, dup, "name", "carbs", "product_name", "carbohydrates_100g")


def test_append_rows_ids(spark):
    empty = spark.createDataFrame([], "id long, name string")
    rows = spark.createDataFrame([("b",), ("a",)], "name string")
    got = sorted((r.id, r.name) for r in P.append_rows(empty, rows, "id").collect())
    assert got == [(0, "a"), (1, "b")]


def test_dense_ids_are_consecutive(spark):
    df = spark.range(0, 5000).selectExpr("cast(id * 7 % 5003 as string) as s").distinct()
    out = with_dense_ids(df, ["s"], "id", num_partitions=7).orderBy("id").collect()
    assert [r.id for r in out] == list(range(1, len(out) + 1))
    assert [r.s for r in out] == sorted(r.s for r in out)


def test_write_clean_products_observed_counts(spark):
    from larder.session import shared_path
    rows = [
        ([L("EN", "Milk")], [N("carbohydrates", 5.0, 4.8)]),
        ([L("fr", "Lait")], [N("carbohydrates", 5.0, 4.0)]),
        ([L("en", "Tomatoes")], [N("carbohydrates", 1.0, 1.0)]),
        ([L("en", "tomato")], [N("carbohydrates", 1.0, 2.0)]),
        ([L("en", "A 1")], [N("carbohydrates", 1.0, 2.0)]),
    ]
    got = {r.stage: r.rows for r in P.write_clean_products(_raw(spark, rows), shared_path(spark, "t-clean")).collect()}
    assert got == {"input": 5, "named_with_carbs": 4, "cleaned": 3, "distinct_names": 2, "written": 2}


def test_dedupe_alignment_every_nth_positional(spark):
    from larder.operators import evaluate as EV
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("b", 2, 5.0)], "k string, id int, v double")
    assert sorted(tuple(r) for r in P.dedupe_by_key(df, "k", "id").collect()) == [("a", 1, 2.0), ("b", 2, 5.0)]
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, t string")
    right = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "z")], "id int, t string")
    got = {r.id: r.same for r in EV.alignment_check(left, right, "id", "t").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    nums = spark.range(0, 25).withColumnRenamed("id", "n")
    assert sorted(r.n for r in EV.every_nth(nums, "n", 10).collect()) == [0, 10, 20, 24]
    a = spark.createDataFrame([(30,), (10,), (20,)], "x int")
    b = spark.createDataFrame([("c",), ("a",)], "y string")
    got = sorted((r.idx, r.x, r.y) for r in EV.join_by_position(a, b, ["x"], ["y"]).collect())
    assert got == [(1, 10, "a"), (2, 20, "c"), (3, 30, None)]
