"""Search: match, BM25 by hand, fuzzy expansion with swaps, id search."""

import math

import pytest

from larder.operators import recipes as R
from larder.operators import search as X


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        (1, "Egg and milk, egg whites"), (2, "Tofu with soy milk"), (3, "Plain rice"), (4, "Eggs Benedict"),
    ], "doc_id long, text string")


def test_match_or_and(spark, docs):
    assert sorted(r.doc_id for r in X.match_search(docs, "doc_id", "text", "egg tofu").collect()) == [1, 2]
    assert sorted(r.doc_id for r in X.match_search(docs, "doc_id", "text", "milk egg", "and").collect()) == [1]
    assert X.match_search(docs, "doc_id", "text", "  ").count() == 0


def test_bm25_by_hand(spark, docs):
    page = X.rank_bm25(docs, "doc_id", "text", "egg milk", digits=None).collect()
    lens = {1: 5, 2: 4, 3: 2, 4: 2}
    avg = sum(lens.values()) / 4
    tf = {(1, "egg"): 2, (1, "milk"): 1, (2, "milk"): 1}
    dfq = {"egg": 1, "milk": 2}

    def score(d):
        s = 0.0
        for t in ("egg", "milk"):
            f = tf.get((d, t), 0)
            if f:
                idf = math.log(1 + (4 - dfq[t] + 0.5) / (dfq[t] + 0.5))
                s += idf * f / (f + 1.2 * (1 - 0.75 + 0.75 * lens[d] / avg))
        return s
    assert [r.doc_id for r in page] == [1, 2]
    assert [r.score for r in page] == pytest.approx([score(1), score(2)])
    assert page[0].total == 2 and [r.rank for r in page] == [1, 2]


def damerau(a, b):
    """Unrestricted edit distance with swaps, cell by cell."""
    big, last = len(a) + len(b), {}
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), db
            cost = a[i - 1] != b[j - 1]
            if not cost:
                db = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1,
                          d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_edit_distance_equals_cell_by_cell(spark):
    import random
    from pyspark.sql import functions as F
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    words += ["milk", "mlik", "egg", "eggs", "ca", "abc"]
    pairs = [(a, b) for a in words for b in rng.sample(words, 20)]
    got = spark.createDataFrame(pairs, "a string, b string") \
        .select("a", "b", X.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all((r.d if r.d is not None else 3) == min(3, damerau(r.a, r.b)) for r in got)


def test_fuzzy_terms_auto(spark, docs):
    vocab = spark.createDataFrame([("milk",), ("egg",), ("eggs",), ("tofu",), ("benedict",), ("rice",)], "term string")
    got = {(r.query_term, r.term): r.distance for r in
           X.fuzzy_terms(spark, vocab, ["mlik", "eg", "benedcit", "ric"]).collect()}
    assert got == {("mlik", "milk"): 1, ("benedcit", "benedict"): 1, ("ric", "rice"): 1}


def test_search_fuzzy_and_by_ids(spark, docs):
    page = X.search_fuzzy(docs, "doc_id", "text", "mlik").collect()
    assert sorted(r.doc_id for r in page) == [1, 2] and page[0].total == 2
    vocab = R.vocab_ids(spark.createDataFrame([("tofu",), ("rice",)], "ingredient string"))
    got = X.search_by_ids(spark, docs, "doc_id", "text", vocab, "2").collect()
    assert [r.doc_id for r in got] == [2]   # ids: rice=1, tofu=2
    with pytest.raises(ValueError):
        X.search_by_ids(spark, docs, "doc_id", "text", vocab, "7")


def test_postings_index_equals_scan(spark, docs):
    postings, lengths = X.build_postings(docs, "doc_id", "text")
    a = [(r.doc_id, r.score, r.total) for r in X.rank_postings(postings, lengths, "egg milk").collect()]
    b = [(r.doc_id, r.score, r.total) for r in X.rank_bm25(docs, "doc_id", "text", "egg milk").collect()]
    assert a == b


@pytest.mark.parametrize("fuzziness", ["AUTO", 0, 1, 2])
def test_fuzzy_terms_equal_brute_force(spark, fuzziness):
    import random
    rng = random.Random(2)
    vocab = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    table = spark.createDataFrame([(w,) for w in vocab], "term string")
    for n in (1, 40):
        terms = rng.sample(vocab, n) + ["zz"]
        want = set()
        for t in terms:
            d = X.auto_fuzziness(len(t)) if fuzziness == "AUTO" else fuzziness
            want |= {(t, w, damerau(t, w)) for w in vocab if damerau(t, w) <= d}
        got = {(r.query_term, r.term, r.distance) for r in
               X.fuzzy_terms(spark, table, terms, fuzziness=fuzziness).collect()}
        assert got == want


def test_fuzziness_above_two_is_refused(spark):
    with pytest.raises(ValueError):
        X.fuzzy_terms(spark, spark.createDataFrame([("a",)], "term string"), ["abcdefgh"], fuzziness=3)


def test_search_without_hits(spark, docs):
    some = X.rank_bm25(docs, "doc_id", "text", "egg")
    labels = spark.createDataFrame([(1, True)], "doc_id long, keto boolean")
    for corpus in (docs, docs.limit(0)):
        for query in ("zzzz", "", "  "):
            assert X.search_total(corpus, "doc_id", "text", query).first().total == 0
            page = X.rank_bm25(corpus, "doc_id", "text", query)
            assert page.collect() == [] and page.schema == some.schema
            page = X.search_fuzzy(corpus, "doc_id", "text", query, labels)
            assert page.collect() == [] and page.columns == [*some.columns, "keto"]


def test_deletion_variants(spark):
    df = spark.createDataFrame([("abc",), ("",)], "w string")
    got = [sorted(r[0]) for r in df.select(X.deletion_variants("w", 2)).collect()]
    assert got[0] == sorted(["abc", "bc", "ac", "ab", "a", "b", "c"])
    assert got[1] == [""]


def test_term_matches_equal_brute_force(spark):
    from larder.operators import matching as M
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_name")
    rows = [(r.p_partkey, r.p_name) for r in part.collect()] + [(-1, None), (-2, "")]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string")
    terms = ["gear", "Red", "ld b", "o", "ri", "xyz", "", "red gear"]

    def plain(extra):
        return {(t, k) for t in terms for k, n in rows if n is not None and t.lower() in n.lower()
                and (extra is None or len(n.split()) <= len(t.split()) + extra)}
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    for given in (terms, table):
        got = M.term_matches(spark, part, "p_name", given).collect()
        assert {(r.term, r.p_partkey) for r in got} == plain(None) and len(got) == len(plain(None))
    got = M.term_matches(spark, part, "p_name", terms, max_extra_words=1).collect()
    assert {(r.term, r.p_partkey) for r in got} == plain(1)
