"""The whole two-label job against a brute-force recomputation on the smallest tables."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from larder.operators import lexicon as L
from larder.operators import products as P
from larder.operators import vectors as V
from larder.plans import inputs as I

SF = "/root/testdata/sf0.001"


def test_label_recipes_knn_brute_force(spark):
    got = {(r.p_brand, r.p_size): (r.vegan, r.keto) for r in E.queries()["label_recipes_knn"](spark, SF).collect()}
    part = spark.read.parquet(f"{SF}/part.parquet")
    raw = part.select(F.col("p_name").alias("product_name"), I.carbs().alias("carbohydrates_100g"))
    cat = P.median_per_key(P.clean_names(raw, fold=False), "product_name", "carbohydrates_100g", "carbs")
    enc = V.fit_text_encoder(cat, "product_name", dim=256)
    cat_rows = enc.transform(cat.withColumn("item_id", F.xxhash64("product_name"))).collect()
    names = [r.product_name for r in cat_rows]
    carbs = np.array([r.carbs for r in cat_rows])
    cmat = np.array([r.embedding for r in cat_rows], dtype=np.float64)
    lines = I.part_lines(spark, SF).withColumn("phrase", L.prepare_phrase("line"))
    phr = lines.select("phrase").distinct()
    qrows = enc.transform(phr.withColumnRenamed("phrase", "product_name")).collect()
    keto_by_phrase = {}
    for r in qrows:
        q = np.array(r.embedding, dtype=np.float64)
        sims = cmat @ q / (np.linalg.norm(cmat, axis=1) * np.linalg.norm(q) + 1e-8)
        order = sorted(range(len(names)), key=lambda j: (-sims[j], cat_rows[j].item_id))
        best = order[0]
        keto_by_phrase[r.product_name] = bool(sims[best] >= 0.1 and carbs[best] <= 10)
    closure = L.category_closure(I.edges_df(spark, SF), spark.createDataFrame([("plant",)], "root string"))
    vegan = {r.phrase: r.vegan for r in
             L.classify_vegan(phr, "phrase", "phrase", I.lexicon_df(spark), closure.select("term")).collect()}
    want = {}
    for r in lines.select("p_brand", "p_size", "phrase").collect():
        k = (r.p_brand, r.p_size)
        v, kt = want.get(k, (True, True))
        want[k] = (v and vegan[r.phrase], kt and keto_by_phrase[r.phrase])
    assert got == want
