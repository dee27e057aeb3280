"""Quality classifier: features and scores against plain Python, held-out accuracy, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import quality_classifier as Q

MASK = (1 << 64) - 1


def plain_form(word):
    classes = "".join("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or ord(c) > 127 else "0" if "0" <= c <= "9" else c
                      for c in word)
    return re.sub(r"(.)\1+", r"\1", classes)


def plain_features(text, bits=Q.BITS):
    """{place: value}, one n-gram at a time."""
    def mix(x):
        x = ((x ^ (x >> 31)) * int(Q._M2)) & MASK
        return x ^ (x >> 29)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    letters = [xxhash.xxh64_intdigest(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode()) for w in words]
    form = [xxhash.xxh64_intdigest(plain_form(w).encode()) for w in words]
    form = [int(Q._REPEAT) if i and letters[i] == letters[i - 1] else f for i, f in enumerate(form)]
    grams = [mix(h) for h in letters] + [mix((h + int(Q._FORM)) & MASK) for h in form]
    for seq, extra in ((letters, Q._WORD_PAIR), (form, Q._FORM_PAIR)):
        grams += [mix((a * int(Q._M1) + b + int(extra)) & MASK) for a, b in zip(seq, seq[1:])]
    count = Counter(g >> (64 - bits) for g in grams)
    length = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values()))
    return {p: math.log1p(c) / length for p, c in count.items()}


TEXTS = ["The cat sat on THE mat", "spam spam spam spam!!", "Über größe 12,5 % | x", "a", "", None, " \t\n", "é\x0bü"]


@pytest.mark.parametrize("text", TEXTS)
def test_features(text):
    place, value = Q.Features()(None if text is None else text.encode())
    want = plain_features(text)
    assert place.tolist() == sorted(want)
    np.testing.assert_allclose(value, [want[p] for p in sorted(want)], rtol=1e-6)


def test_ftrl_update_against_plain_formulas():
    model = Q.FtrlRegression(bits=4, l1=0.01)
    z, n = [0.0] * 17, [0.0] * 17
    rng = np.random.default_rng(3)
    for _ in range(200):
        place = np.sort(rng.choice(16, 3, replace=False)).astype(np.int32)
        value = rng.uniform(0.1, 1, 3).astype(np.float32)
        label = int(place[0] < 4)
        model.update(place, value, label)
        at, x = [*place.tolist(), 16], [*map(float, value), 1.0]
        w = [0.0 if abs(z[i]) <= 0.01 else (math.copysign(0.01, z[i]) - z[i]) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)
             for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, a, b in zip(at, w, x):
            g = (p - label) * b
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA
            z[i] += g - s * a
            n[i] += g * g
    np.testing.assert_allclose(model.z, z, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(model.n, n, rtol=1e-9, atol=1e-12)
    weights = model.weights()
    assert weights[0] > 0 > weights[15]


def corpus(spark, n, words):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = words(60, i)
        rows.append((i, " ".join(w + "$$$" for w in text.split()) if bad else text, int(not bad)))
    return (spark.createDataFrame([(i, t, 7, 8) for i, t, _ in rows], "doc_id long, text string, label int, score int"),
            spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"), rows)


def test_held_out_accuracy_and_scores_against_plain(spark, words):
    docs, labels, rows = corpus(spark, 300, words)
    held = Q.held_out(F.col("doc_id"), 5)
    model = Q.train_quality(docs.where(~held), labels.where(~held))
    out = {r["doc_id"]: r for r in Q.score_quality(docs, model).collect()}
    weights = model.weights()
    for i, text, quality in rows:
        s = sum(v * weights[p] for p, v in plain_features(text).items()) + weights[-1]
        assert out[i]["score"] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-6)
        assert out[i]["label"] == 7
        if zlib.crc32(str(i).encode()) % 5 == 0:
            assert (out[i]["score"] >= 0.5) == bool(quality)
    again = Q.train_quality(docs.where(~held).repartition(7), labels.where(~held).repartition(3))
    assert np.array_equal(weights, again.weights())


def test_sample_bound(spark, words):
    docs, labels, _ = corpus(spark, 400, words)
    got = Q.training_examples(docs, labels, "doc_id", "text", "quality", 100, Q.BITS)
    assert 50 < len(got) < 160


def test_edge_cases(spark, words):
    docs, labels, rows = corpus(spark, 40, words)
    more = spark.createDataFrame([(None, "x", 0, 0), (900, None, 0, 0), (901, "", 0, 0), (902, " \n", 0, 0),
                                  (903, "word " * 300_000, 0, 0), (0, rows[0][1], 0, 0)], docs.schema)
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0), (999, 1, 0)], labels.schema)
    all_docs = docs.unionByName(more)
    model = Q.train_quality(all_docs, labels.unionByName(odd))
    out = Q.score_quality(all_docs, model).collect()
    assert len(out) == 46 and all(0 <= r["score"] <= 1 for r in out)
    constant = {r["score"] for r in out if r["doc_id"] in (900, 901, 902)}
    assert len(constant) == 1 and constant.pop() == pytest.approx(1 / (1 + math.exp(-model.weights()[-1])))
    assert len({r["score"] for r in out if r["doc_id"] == 0}) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.train_quality(docs, labels)
    assert Q.score_quality(docs, model).collect() == []
    some = spark.createDataFrame([(1, "a b")], docs.schema)
    assert Q.score_quality(some, model).first()["score"] == 0.5


def test_query_over_a_folder(spark, tmp_path, words):
    from larder.llm.queries import QUERIES
    docs, labels, rows = corpus(spark, 120, words)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op13_quality_classifier"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert sorted(r["doc_id"] for r in found) == [i for i, _, _ in rows]
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)
    # what held-out rows are labelled makes no difference
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id"), 5), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = tmp_path / "other"
    docs.write.parquet(f"{other}/documents.parquet")
    flipped.write.parquet(f"{other}/labels.parquet")
    assert sorted(QUERIES["op13_quality_classifier"](spark, str(other)).collect()) == sorted(found)
