"""Stored indexes: fuzzy search by deletion variants, two-level vector index, exact medians by counting."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import ann as A
from larder.operators import search as X
from larder.operators import search_index as S
from larder.operators import vectors as V
from larder.operators.selection import exact_quantile
from larder.session import shared_path

WORDS = ["milk", "mlik", "milks", "silk", "kefir", "kefri", "tofu", "toufu", "rice", "ricer", "a", "ab", "über", "uber",
         "anticonstitutionnel", "anticonstitutionel", "antikonstitutionnel", "butterscotch", "buttersoctch", "12345678", "12354678"]


# ------------------------------------------------------------------ search

def docs_of(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 15)))) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, "")], "doc_id long, text string")


@pytest.fixture(scope="module")
def search_index(spark):
    return S.SearchIndex.build(docs_of(spark), "doc_id", "text", shared_path(spark, "t-index"))


def test_prefix_variants_are_what_the_index_stores(spark):
    for w in WORDS + ["", "é" * 9]:
        stored = spark.createDataFrame([(w,)], "term string") \
            .select(F.explode(X.deletion_variants(F.substring("term", 1, S.PREFIX), 2)).alias("v"))
        assert sorted(r.v for r in stored.collect()) == sorted(S.prefix_variants(w, 2))


@pytest.mark.parametrize("fuzziness", ["AUTO", 0, 1, 2])
def test_index_finds_what_a_scan_finds(spark, search_index, fuzziness):
    vocab = spark.createDataFrame([(w,) for w in WORDS], "term string")
    asked = ["mlik", "kefir", "touf", "anticonstitutionnle", "ba", "über", "12534678", "zzzzzz"]
    want = {tuple(r) for r in X.fuzzy_terms(spark, vocab, asked, fuzziness=fuzziness).collect()}
    assert {tuple(r) for r in search_index.fuzzy_terms(asked, fuzziness).collect()} == want
    joined = S.LOOKUP_KEYS
    try:
        S.LOOKUP_KEYS = 0                        # more keys than a filter takes: the same by a join
        assert {tuple(r) for r in search_index.fuzzy_terms(asked, fuzziness).collect()} == want
    finally:
        S.LOOKUP_KEYS = joined


def test_variants_of_random_edits_meet(spark):
    """Two words within d edits share a prefix variant with at most d deletions on each side."""
    rng = random.Random(7)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        b = a
        for _ in range(2):
            i = rng.randint(0, max(0, len(b) - 1))
            kind = rng.choice(["ins", "del", "sub", "swap"])
            b = {"ins": b[:i] + rng.choice("abc") + b[i:], "del": b[:i] + b[i + 1:], "sub": b[:i] + rng.choice("abc") + b[i + 1:],
                 "swap": b[:i] + b[i + 1:i + 2] + b[i:i + 1] + b[i + 2:]}[kind]
        assert S.prefix_variants(a, 2) & S.prefix_variants(b, 2)


@pytest.mark.parametrize("query", ["mlik kefri", "tofu", "nothing here", ""])
def test_pages_equal_the_search_without_an_index(spark, search_index, query):
    docs = docs_of(spark)
    want = X.search_fuzzy(docs, "doc_id", "text", query).collect()
    assert search_index.search(query).collect() == want
    plain = X.rank_bm25(docs, "doc_id", "text", query).collect()
    assert search_index.search(query, fuzzy=False).collect() == plain


def test_ids_and_unknown_ids(spark, search_index):
    terms = {r.id: r.term for r in search_index.vocabulary.collect()}
    assert [terms[i] for i in sorted(terms)] == sorted(set(WORDS))
    assert search_index.terms_of("3, 1 2") == [terms[3], terms[1], terms[2]]
    with pytest.raises(ValueError, match="unknown"):
        search_index.terms_of("3 999")
    assert search_index.search_by_ids("1,2").collect() == search_index.search(f"{terms[1]} {terms[2]}").collect()


def test_open_after_the_build_and_after_a_change(spark):
    docs, source, root = docs_of(spark), shared_path(spark, "t-docs"), shared_path(spark, "t-root")
    docs.write.parquet(source)
    first = S.SearchIndex.stored(docs, "doc_id", "text", source, root)
    again = S.SearchIndex.stored(docs, "doc_id", "text", source, root)
    assert again.path == first.path and again.vocabulary.count() == first.vocabulary.count()
    assert S.SearchIndex.open(spark, root + "/none") is None
    docs.limit(5).write.mode("append").parquet(source)
    assert S.SearchIndex.stored(docs, "doc_id", "text", source, root).path != first.path


def test_empty_collection(spark):
    index = S.SearchIndex.build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", shared_path(spark, "t-index"))
    assert index.search("milk").collect() == [] and index.vocabulary.count() == 0


def test_look_up_reads_few_rows_and_shuffles_no_vocabulary(spark):
    """Row groups that do not hold the keys are not read, and the variants reach the join without an exchange."""
    rows = [(i, " ".join(f"w{i:05d}x{j}" for j in range(4))) for i in range(3000)]
    index = S.SearchIndex.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", shared_path(spark, "t-index"))
    total = index.variants.count()
    found = index.fuzzy_terms(["w01234x1"], 1)
    assert {r.term for r in found.collect()} >= {"w01234x1", "w01234x2"}
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    scan = text[text.index("variant#"):]
    assert "PushedFilters" in text and "Or(" in text or "In(" in text
    join = next(line for line in text.splitlines() if "BroadcastHashJoin" in line)
    below = text[text.index(join) + len(join):]
    assert "Exchange hashpartitioning" not in below.split("Scan parquet")[0] and scan
    read = index.variants.where(S.keys_in("variant", sorted(S.prefix_variants("w01234x1", 1))))
    read.collect()
    rows_read = _scan_rows(read)
    assert 0 < rows_read < total / 2                   # eight files here, and the keys lie in up to four


def _scan_rows(df) -> int:
    """Rows that the Parquet scans of an executed frame gave out."""
    plan, out = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return out


# ------------------------------------------------------------------ vectors

def vectors_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def clustered(n, d, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, d))
    return [(i, heads[rng.integers(12)] + spread * rng.normal(size=d)) for i in range(n)]


def matches(df):
    return {(r.query_id, r["rank"]): (r.item_id, round(r.sim, 9)) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 5])
def test_certified_search_equals_the_exact_one(spark, k):
    rows = clustered(900, 10, 3)
    rows += [(2000 + i, rows[5][1]) for i in range(300)]                  # copies: ties go to the smaller id
    rows += [(3000, np.zeros(10)), (3001, rows[7][1] * 1e-6), (3002, rows[8][1] * 1e6)]
    frame = vectors_of(spark, rows)
    index = A.TwoLevelIndex.build(frame, shared_path(spark, "t-ann"), item_id="vec_id")
    queries = frame.where("vec_id % 7 = 0 OR vec_id >= 2990")
    want = V.knn(queries, frame, k, "vec_id", "vec_id", exclude_same_id=True)
    got = index.query(queries, k, "vec_id", exclude_same_id=True, exact=True)
    assert matches(got) == matches(want)


def test_certified_search_leaves_cells_out(spark, monkeypatch):
    """On clustered data most cells cannot matter, and they are not searched."""
    frame = vectors_of(spark, clustered(3000, 16, 4, 0.05))
    index = A.TwoLevelIndex.build(frame, shared_path(spark, "t-ann"), item_id="vec_id")
    asked = frame.where("vec_id < 50")
    seen = []
    inside = A.TwoLevelIndex._could_matter

    def spy(self, *args):
        out = inside(self, *args)
        seen.append(out.count())
        return out
    monkeypatch.setattr(A.TwoLevelIndex, "_could_matter", spy)
    index.query(asked, 1, "vec_id", exclude_same_id=True, exact=True).count()
    assert seen[0] < 0.5 * 50 * index.cells.count()


def test_approximate_recall_and_sizes(spark):
    frame = vectors_of(spark, clustered(3000, 16, 5))
    index = A.TwoLevelIndex.build(frame, shared_path(spark, "t-ann"), item_id="vec_id")
    want = matches(V.knn(frame, frame, 1, "vec_id", "vec_id", exclude_same_id=True))
    got = matches(index.query(frame, 1, "vec_id", exclude_same_id=True))
    assert sum(got[q][0] == want[q][0] for q in want) >= 0.95 * len(want)
    assert index.codes.select(F.octet_length("code")).distinct().collect() == [(16 // A.SUB,)]
    assert index.codes.count() == index.vectors.count() == 3000
    assert len(index.coarse) <= math.ceil(3000 ** 0.25) and index.cells.count() <= math.ceil(3000 ** 0.25) ** 2


def test_queries_are_not_repeated_for_each_cell(spark, monkeypatch):
    """Vectors without clusters want almost every cell: what is shuffled follows tiles, not cells, and is still exact."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=12)) for i in range(1500)]
    rows += [(i, rows[i][1] * 2 + 1) for i in range(40)]                       # ids with two vectors
    frame = vectors_of(spark, rows)
    index = A.TwoLevelIndex.build(frame, shared_path(spark, "t-ann"), item_id="vec_id")
    monkeypatch.setattr(A, "TILE_BYTES", 12 * 8 * 400)                         # several tiles, cells cut in two
    inside, seen = A._meet, []

    def spy(left, right, keys, fn, schema):
        seen.append(left.count())
        return inside(left, right, keys, fn, schema)
    monkeypatch.setattr(A, "_meet", spy)
    want = matches(V.knn(frame, frame, 3, "vec_id", "vec_id", exclude_same_id=True))
    assert matches(index.query(frame, 3, "vec_id", exclude_same_id=True, exact=True)) == want
    assert max(seen) <= 1500 * 8 < 1500 * index.cells.count() / 3
    approximate = index.query(frame, 3, "vec_id", exclude_same_id=True)
    assert approximate.columns == ["query_id", "item_id", "sim", "rank"] and approximate.count() == 4500


def test_short_list_stays_in_the_task(spark, monkeypatch):
    """The short list grows with the catalogue: what leaves a task is k rows for each query and tile, not the list."""
    rng = np.random.default_rng(12)
    frame = vectors_of(spark, [(i, rng.normal(size=12)) for i in range(1500)])
    index = A.TwoLevelIndex.build(frame, shared_path(spark, "t-ann"), item_id="vec_id")
    inside, seen = A._meet, []

    def spy(*args):
        out = inside(*args)
        seen.append(out.count())
        return out
    monkeypatch.setattr(A, "_meet", spy)
    assert index.query(frame, 1, "vec_id", exclude_same_id=True, short_list=200).count() == 1500
    assert max(seen) <= 1500 * 8


def test_list_of_every_code_finds_the_exact_matches(spark, monkeypatch):
    """Also where the first guess at the list's last score was too high."""
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=10)) for i in range(700)]
    rows += [(i, rows[i][1] * 3) for i in range(30)] + [(900 + i, rows[5][1]) for i in range(20)]           # ids twice, copies
    rows += [(950, np.zeros(10)), (951, rows[9][1] * 1e-6), (952, rows[9][1] * 1e150), (953, np.full(10, np.nan))]
    frame = vectors_of(spark, rows)
    index = A.TwoLevelIndex.build(vectors_of(spark, rows[:-1]), shared_path(spark, "t-ann"), item_id="vec_id")
    want = matches(V.knn(frame, vectors_of(spark, rows[:-1]), 3, "vec_id", "vec_id", exclude_same_id=True))
    whole = dict(query_id="vec_id", exclude_same_id=True, probes=10 ** 6, short_list=len(rows))
    assert matches(index.query(frame, 3, **whole)) == want
    inside, asked = A._bars, []

    def high(books, dim, keep, wider, exclude):
        asked.append(wider)
        return inside(books, dim, keep // 8 if wider == 1 else keep, wider, exclude)
    monkeypatch.setattr(A, "_bars", high)
    assert matches(index.query(frame, 3, **whole)) == want and asked == [1, 2]


def test_recall_is_met_beyond_the_sample(spark):
    """The probes are measured on some vectors; the margin covers what these leave open about the others."""
    rng = np.random.default_rng(14)
    frame = vectors_of(spark, [(i, rng.normal(size=20)) for i in range(9000)])
    index = A.TwoLevelIndex.build(frame, shared_path(spark, "t-ann"), item_id="vec_id")
    want = matches(V.knn(frame, frame, 1, "vec_id", "vec_id", exclude_same_id=True))
    got = matches(index.query(frame, 1, "vec_id", exclude_same_id=True))
    assert sum(got[q][0] == want[q][0] for q in want) >= 0.95 * len(want)


def test_vectors_keep_their_values_when_packed():
    v = np.array([[1.0, 0.1], [2.0, np.nan]])
    some = v.astype(np.float32).astype(np.float64)
    blobs = [A._narrow(some).tobytes(), A._narrow(v).tobytes(), A._narrow(np.array([[1e300, 1.0]])).tobytes()]
    assert [len(b) for b in blobs] == [16, 32, 16]
    assert np.array_equal(A._wide(blobs, np.array([2, 2, 1]), 2), np.vstack([some, v, [[1e300, 1.0]]]), equal_nan=True)
    score = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [0.0, 0.0, -np.inf, 0.0, 5.0]])
    assert A._first_places(score, 2).tolist() == [[False, True, True, False, False], [True, False, False, False, True]]


def test_small_and_odd_catalogues(spark):
    def build(rows):
        return A.TwoLevelIndex.build(vectors_of(spark, rows), shared_path(spark, "t-ann"), item_id="vec_id")
    one = [(1, np.array([1.0, 2.0, 3.0]))]
    asked = spark.createDataFrame([(9, [1.0, 2.0, 2.0]), (8, None), (7, [1.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.item_id) for r in build(one).query(asked).collect()] == [(9, 1)]
    assert [(r.query_id, r.item_id) for r in build(one).query(asked, exact=True).collect()] == [(9, 1)]
    assert build([]).query(asked).collect() == []
    same = build([(i, np.array([0.6, 0.8])) for i in range(40)])
    two = spark.createDataFrame([(1, [0.6, 0.8])], "query_id long, embedding array<double>")
    assert [r.item_id for r in same.query(two, 3, exact=True).collect()] == [0, 1, 2]


def test_best_matches_by_either_way(spark):
    rows = clustered(400, 6, 8)
    frame = vectors_of(spark, rows)
    ways = [A.best_matches(frame, frame, 2, "vec_id", "vec_id", exclude_same_id=True, pairs=p) for p in (10 ** 9, 0)]
    assert matches(ways[0]) == matches(ways[1])


# ------------------------------------------------------------------ medians

def test_exact_quantiles_of_odd_values(spark):
    rng = random.Random(5)
    groups = {"powers": [2.0 ** -i for i in range(1200)], "both": [rng.gauss(0, 1) * 10 ** rng.randint(-300, 300) for _ in range(999)],
              "one": [7.0], "ties": [1.0] * 500 + [2.0] * 499, "huge": [1.7e308, -1.7e308, 1.6e308, 1.5e308],
              "inf": [float("inf"), float("-inf"), 0.0, -0.0], None: [3.0, 1.0, 2.0, 4.0], "near": [1 + i * 2 ** -52 for i in range(777)]}
    rows = [(k, v, 0) for k, vs in groups.items() for v in vs] + [("one", None, 0), ("empty", None, 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double, _n int").repartition(5)
    for q in (0.0, 0.25, 0.5, 1.0):
        got = {r.k: r.m for r in exact_quantile(df, ["k"], "v", q, "m").collect()}
        assert got.pop("empty") is None
        assert got == {k: sorted(vs)[max(math.ceil(q * len(vs)), 1) - 1] for k, vs in groups.items()}


def test_exact_median_of_three_million_rows_in_a_group(spark):
    df = spark.range(3_000_001).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 3_000_001 / 1000).alias("v")) \
        .unionByName(spark.createDataFrame([("cold", 1.0), ("cold", 5.0)], "k string, v double"))
    assert {r.k: r.median for r in exact_quantile(df, ["k"], "v").collect()} == {"hot": 1500.0, "cold": 1.0}


def test_join_and_broadcast_find_the_same(spark):
    rng = random.Random(6)
    rows = [(i % 17, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = {k: statistics.median_low([v for j, v in rows if j == k]) for k in range(17)}
    for bound in (200_000, 0):
        assert {r.k: r.median for r in exact_quantile(df, ["k"], "v", max_broadcast_rows=bound).collect()} == want
    assert exact_quantile(df.where("false"), ["k"], "v").collect() == []


# ------------------------------------------------------------------ substrings

TEXTS = ["red gear", "Red Gears", "gear", "ge", "g", "", None, "a\x00b", "größe", "GRÖSSE", "ΟΔΟΣΑ", "red  red", "red gear", "x" * 5000 + "needle"]
QUERIES = ["", "g", "ge", "gea", "gear", "ear", "Red", "red g", "d  r", "öß", "ΟΔΟΣ", "needle", "zzz", "\x00", "xxxx", "e"]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_substrings_equal_a_scan(spark, ignore_case):
    from larder.operators.substring_index import SubstringIndex
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "id long, text string, n int, gram string")
    index = SubstringIndex.build(df, "id", "text", shared_path(spark, "t-sub"), ignore_case)
    lower = F.lower if ignore_case else (lambda c: c)

    def scan(q):
        return {r.id for r in df.where(F.contains(lower(F.col("text")), lower(F.lit(q)))).collect()}
    for q in QUERIES:
        found = [r.id for r in index.search(q).collect()]
        assert set(found) == scan(q) and len(found) == len(set(found)), q
    terms = spark.createDataFrame([(q,) for q in QUERIES + ["gear", None]], "term string")
    pairs = [(r.term, r.id) for r in index.matches(terms).collect()]
    assert set(pairs) == {(q, i) for q in QUERIES for i in scan(q)} and len(pairs) == len(set(pairs))
    assert SubstringIndex.open(spark, index.path).n == len(TEXTS) - 1
    assert SubstringIndex.open(spark, index.path + "x") is None


def test_substrings_of_an_empty_table(spark):
    from larder.operators.substring_index import SubstringIndex
    index = SubstringIndex.build(spark.createDataFrame([], "id long, text string"), "id", "text", shared_path(spark, "t-sub"))
    assert [index.search(q).count() for q in ("", "a", "abc")] == [0, 0, 0]


def test_many_terms_take_the_joined_way(spark, monkeypatch):
    from larder.operators import matching as M
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k long, t string")
    want = sorted((r.term, r.k) for r in M.term_matches(spark, df, "t", QUERIES).collect())
    monkeypatch.setattr(M, "FEW_TERMS", 2)
    assert sorted((r.term, r.k) for r in M.term_matches(spark, df, "t", QUERIES).collect()) == want
    assert want and sorted((r.term, r.k) for r in M.term_matches(spark, df, "t", QUERIES, 1).collect()) \
        == sorted((q, k) for q, k in want if len(TEXTS[k].split()) <= len(q.split()) + 1)


def test_point_lookups_skip_row_groups(spark):
    rows = [(i, " ".join(f"w{i:05d}x{j}" for j in range(30))) for i in range(3000)]
    index = S.SearchIndex.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", shared_path(spark, "t-index"))
    n = index.vocabulary.count()
    assert n == 90_000
    for asked in (index.entries([5, 70_000]), index.entries(terms=["w00007x3", "w02999x29"])):
        assert len(asked.collect()) == 2
        assert 0 < _scan_rows(asked) <= n / 2
    nothing = index.entries(terms=["w00500x3.5"])          # between two stored terms: the Bloom filter or a page says no
    assert nothing.collect() == [] and _scan_rows(nothing) <= n / 4


def test_stored_variants_are_those_of_the_general_rule(spark):
    from larder.operators.search_index import PREFIX, stored_variants
    words = [(w,) for w in ("a", "ab", "aab", "abcdefg", "abcdefghij", "\u00e9t\u00e9s", "aaaaaaa", "")]
    df = spark.createDataFrame(words, "term string")
    both = df.select(stored_variants("term").alias("new"), X.deletion_variants(F.substring("term", 1, PREFIX), 2).alias("old"))
    assert all(sorted(r.new) == sorted(r.old) for r in both.collect())
    # plain expressions: no lambda is interpreted for each term of the vocabulary
    assert "lambda" not in df.select(stored_variants("term"))._jdf.queryExecution().optimizedPlan().toString()


def test_many_weighted_terms_do_not_shuffle_the_postings(spark, monkeypatch):
    from larder.operators import search_index as I
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} x") for i in range(60)], "doc_id long, text string")
    index = I.SearchIndex.build(docs, "doc_id", "text", shared_path(spark, "t-search"))
    weights = index.vocabulary.select("term", F.lit(1.0).alias("weight"))
    few = {tuple(r) for r in X.bm25(*index.hits(weights), index.stats.select("n", "avgdl"), 1.2, 0.75).collect()}
    monkeypatch.setattr(I, "LOOKUP_KEYS", 5)
    hits, found = index.hits(weights)
    joined = hits.join(found, "term")
    assert "Exchange hash" not in joined._jdf.queryExecution().executedPlan().toString()
    many = X.bm25(hits, found, index.stats.select("n", "avgdl"), 1.2, 0.75).collect()
    assert {(r[0], round(r[1], 9)) for r in many} == {(a, round(b, 9)) for a, b in few}
