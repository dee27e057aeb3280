"""Rules checked on rows made by hand, independent of the oracles."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from larder.operators import evaluate as E
from larder.operators import lexicon as L
from larder.operators import products as P
from larder.operators import recipes as R
from larder.operators.util import written
from larder.sources import io as IO
from larder.streaming import ingest as ING


def test_null_item_is_false_and_empty_list_true(spark):
    recipes = spark.createDataFrame([(1, ["a"]), (2, ["a", None]), (3, [None]), (4, []), (5, None), (6, ["b"])],
                                    "id long, items array<string>")
    labels = spark.createDataFrame([("a", True)], "item string, vegan boolean")
    got = {r.id: r.vegan for r in R.label_recipes(recipes, "id", "items", labels, "item", ["vegan"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: None, 6: False}


def test_ids_by_blanks_and_commas(spark):
    vocab = spark.createDataFrame([(1, "egg"), (3, "milk"), (12, "rice")], "id long, ingredient string")
    for text in ("3 1 12", "3,1,12", " 3 , 1\t12 "):
        rows = R.ids_to_terms(spark, vocab, text).orderBy("pos").collect()
        assert [r.ingredient for r in rows] == ["milk", "egg", "rice"]
    assert R.ids_to_terms(spark, vocab, "").collect() == []
    with pytest.raises(ValueError, match="12345678901234567890"):
        R.ids_to_terms(spark, vocab, "3 12345678901234567890")


def test_hyphen_stays_in_product_names(spark):
    rows = spark.createDataFrame([("Coca-Colas", 1.0), ("coca colas", 2.0)], "product_name string, carbohydrates_100g double")
    got = sorted(r.product_name for r in P.clean_names(rows).collect())
    assert got == ["coca cola", "coca-cola"]


def test_closure_of_any_depth_and_with_a_cycle(spark):
    edges = [(f"n{i + 1}", f"n{i}") for i in range(150)] + [("n0", "n150")]
    got = L.category_closure(spark.createDataFrame(edges, "child string, parent string"),
                             spark.createDataFrame([("n0",)], "root string"))
    assert got.count() == 151


def test_closure_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []

    def counted(df, name):
        rounds.append(name)
        return written(df, name)
    monkeypatch.setattr(L, "written", counted)
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(150)], "child string, parent string")
    got = L.category_closure(chain, spark.createDataFrame([("n0",), ("n100",), ("none",)], "root string"))
    assert sorted(map(tuple, got.groupBy("root").count().collect())) == [("n0", 151), ("n100", 51), ("none", 1)]
    assert len(rounds) <= 10


def test_longest_with_string_ids(spark):
    rows = spark.createDataFrame([("g", "b", "x y"), ("g", "a", "x y"), ("g", "c", "x")], "g string, id string, t string")
    assert [tuple(r) for r in E.longest_per_group(rows, "g", "id", "t").collect()] == [("g", 2, "a")]


def test_resume_commits_chunk_by_chunk(spark, tmp_path):
    target, calls = str(tmp_path / "out"), []

    def failing(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return df
    rows = spark.range(40).withColumnRenamed("id", "k")
    with pytest.raises(RuntimeError):
        IO.resume_missing(rows, "k", failing, target)
    part = spark.read.parquet(target).count()
    assert 0 < part < 40
    assert IO.resume_missing(rows, "k", lambda df: df, target) == 40


def test_ingest_replay_with_an_empty_batch_folder(spark, tmp_path):
    src, out, ckpt, vocab = (str(tmp_path / x) for x in ("src", "out", "ckpt", "vocab"))
    spark.createDataFrame([("b a",), ("c",)], "text string").write.parquet(src)
    os.makedirs(f"{vocab}/batch=0/_temporary")          # what a crash leaves

    def terms(batch):
        return batch.select(F.explode(F.split("text", " ")).alias("term"))
    assert ING.ingest(spark, src, "text string", out, ckpt, lambda b: b, vocab, terms) == 1
    assert sorted((r.term, r.id) for r in spark.read.parquet(vocab).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    from larder import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_query_runs_from_another_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, {0!r}); from larder.session import build_session; "
            "s = build_session('local[2]', 2); from larder.operators.vectors import HashedNgramEncoder, encode_with; "
            "d = encode_with(s.createDataFrame([('egg',)], 't string'), 't', HashedNgramEncoder(8)); "
            "print('rows', d.count(), len(d.first().embedding))").format(
                os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1 8" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("key", ["label_recipes", "label_recipes_knn"])
def test_both_labels_vary(spark, key):
    from larder.plans.registry import load_all
    rows = load_all()[0][key](spark, "/root/testdata/sf0.01").select("vegan", "keto").collect()
    assert {r.vegan for r in rows} == {True, False} == {r.keto for r in rows}


def test_no_query_answers_with_nothing(spark):
    from larder.plans.registry import load_all
    rows = load_all()[0]["contains_any"](spark, "/root/testdata/sf0.01").count()
    assert rows > 0


def test_broadcast_is_bounded_in_bytes_too(spark):
    from larder.operators.util import bounded_broadcast
    wide = spark.createDataFrame([(i, "x" * 1000) for i in range(100)], "k int, t string")

    def hinted(**bounds):
        out = spark.range(10).join(bounded_broadcast(wide, **bounds), F.col("id") == F.col("k"))
        return "strategy=broadcast" in out._jdf.queryExecution().analyzed().toString()
    assert hinted(max_rows=100) and not hinted(max_rows=99) and not hinted(max_rows=100, max_bytes=50_000)


def test_csv_files_are_bounded_in_rows(spark, tmp_path):
    path = IO.write_csv(spark.range(1000).coalesce(1), str(tmp_path / "csv"), max_records_per_file=100)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 10
    assert IO.read_csv(spark, path, "id bigint").count() == 1000
