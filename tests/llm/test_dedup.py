"""Embedding near-duplicates, repeated strings and the Jaccard join against plain versions."""

import json
import random
import uuid
from collections import Counter

import numpy as np
import pytest

from larder.llm import embedding_dedup as V
from larder.llm import jaccard as J
from larder.llm import suffix_dedup as S
from larder.llm.components import connected_components


def classes(n, links):
    """Smallest index reachable from each."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = classes(500, edges)
    assert got == {k: want[k] for a, b in edges for k in (a, b) if a != b or k in got}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- embeddings

def vectors():
    rng = np.random.default_rng(4)
    rows = [rng.standard_normal(32) for _ in range(150)]
    rows += [rows[i % 20] + 0.15 * rng.standard_normal(32) * rng.random() for i in range(150)]
    return [[float(np.float32(x)) for x in r] for r in rows]


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 16)                     # buckets of several tiles
    rows = vectors()
    unit = np.array([np.array(r) / np.linalg.norm(r) for r in rows])
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    found = V.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    label = classes(len(rows), list(zip(*np.nonzero(link))))
    assert sum(n for n, _, _ in got.values()) >= 0.97 * link.sum()
    assert all(got[i][0] <= link[i].sum() for i in got)
    assert sum(got[i][1] == label[i] for i in got) >= 0.99 * len(rows)
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1e-38, 0.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "vec_id long, embedding array<double>, id string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(table).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False),
                   **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}}
    assert V.near_duplicates(table.limit(0)).count() == 0


def test_collision_and_parameters():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(200_000), rng.random(200_000)
    seen = np.mean(np.floor(b) == np.floor(a * 0.4 / 1.5 + b))
    assert abs(seen - V.collision(0.4, 1.5)) < 0.01
    w, k, tables = V.choose_parameters(10_000, 0.9, 0.99)
    assert 1 - (1 - V.collision(np.sqrt(0.2), w) ** k) ** tables >= 0.99


# ---------------------------------------------------------------- repeated strings

def plain_removal(docs):
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, kept)
    return out


def repeated_docs(words):
    rng = random.Random(8)
    line = words(30, 1)
    base = words(120, 2)
    docs = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 350), (4, "ab" * 300), (5, base), (6, base), (7, base[:-1]),
            (8, "é" * 200), (9, "é" * 120 + "z" + "é" * 90), (10, line + line + line), (11, words(3000, 3))]
    for i in range(12, 60):
        text = list(words(60, i))
        for _ in range(rng.randint(0, 2)):
            text.insert(rng.randrange(len(text)), " " + line + " ")
        if i % 5 == 0:
            part = base[rng.randrange(200):]
            text.append(part[:rng.randint(50, 400)])
        docs.append((i, "".join(text)))
    return docs


@pytest.mark.parametrize("tuples", [100_000, 3])
def test_removal_equals_plain(make_docs, words, monkeypatch, tuples):
    monkeypatch.setattr(S, "TUPLES", tuples)               # small: groups dealt over several parts
    docs = repeated_docs(words)
    rows = S.remove_repeats(make_docs(docs).repartition(5)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert len(rows) == len(docs) and got == plain_removal(docs)


def test_removal_over_chunks_and_shuffle_joins(make_docs, words, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 500)
    monkeypatch.setattr(S, "BROADCAST_ITEMS", 0)
    docs = repeated_docs(words)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
           for r in S.remove_repeats(make_docs(docs)).collect()}
    assert got == plain_removal(docs)


def test_removal_repeated_rows_keep_what_others_share(make_docs, words):
    """Equal rows are one document, the earliest: what it shares with a later one stays in both of them."""
    shared = words(60, 5)
    one, two = words(30, 6) + shared + words(30, 7), words(30, 8) + shared + words(30, 9)
    for rows in ([(1, one), (1, one), (2, two)], [(1, one), (2, two), (2, two), (2, two)]):
        want = plain_removal(set(rows))
        assert want[1][1] == 0 < want[2][1]
        got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
               for r in S.remove_repeats(make_docs(rows).repartition(3)).collect()]
        assert sorted(got) == sorted((i, want[i]) for i, _ in rows)


def test_removal_deals_a_large_group_over_parts(make_docs, words, monkeypatch, tmp_path):
    """Each tuple of a group above the bound goes to one part, and windows that are equal across parts are found."""
    monkeypatch.setattr(S, "TUPLES", 8)
    compare, seen = S._compare, str(tmp_path)

    def counted(batches):
        held = list(batches)
        rows = [r for b in held for r in zip(b["suffix"].to_pylist(), b["part"].to_pylist())]
        with open(f"{seen}/{uuid.uuid4()}", "w") as out:
            json.dump(rows, out)
        yield from compare(iter(held))

    monkeypatch.setattr(S, "_compare", counted)
    phrase = words(30, 1)[:150]
    docs = [(i, words(30, 100 + i) + phrase + words(30, 300 + i)) for i in range(64)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
           for r in S.remove_repeats(make_docs(docs)).collect()}
    groups, parts = Counter(), Counter()
    for f in tmp_path.iterdir():
        for suffix, part in json.loads(f.read_text()):
            groups[suffix] += 1
            parts[suffix, part] += 1
    assert got == plain_removal(docs)
    assert max(groups.values()) == 64                      # one tuple a document, not one a document and part
    assert max(parts.values()) <= 24


def test_removal_repeated_rows_and_empty_table(make_docs, words):
    text = words(60, 4)
    rows = S.remove_repeats(make_docs([(1, text), (1, text), (None, text), (None, None)])).collect()
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in rows)
    n = len(text.encode())
    assert got == [(False, n, n), (False, n, n), (True, 0, 0), (True, n, 0)]
    assert S.remove_repeats(make_docs([])).count() == 0


def broadcast_hints(spark, monkeypatch, module, run):
    """Broadcast hints in the plans of an operator's written tables and of its result."""
    write, plans = module.staged, []

    def plan(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(module, "staged", lambda df, name: write(plan(df), name))
    plan(run())
    return sum(p.count("strategy=broadcast") for p in plans)


def test_removal_joins_small_inputs_as_large_ones(spark, make_docs, words, monkeypatch):
    docs = make_docs(repeated_docs(words))
    assert broadcast_hints(spark, monkeypatch, S, lambda: S.remove_repeats(docs)) == 1   # groups in several parts


# ---------------------------------------------------------------- Jaccard join

def shingle_set(text, n):
    w = [x for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else \
        frozenset([tuple(w)]) if w else frozenset()


def near_copies(words):
    rng = random.Random(6)
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one"), (6, "One two three"),
            (7, words(4000, 1))]
    long = words(4000, 1).split()
    docs.append((8, " ".join(long[:3000] + ["new"] + long[3000:])))
    for g in range(12):
        base = words(rng.choice([9, 12, 40, 150, 400]), 100 + g).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10 ** 6)}"
            docs.append((len(docs), " ".join(copy)))
    common = words(40, 999)
    docs += [(len(docs) + i, words(60, 2000 + i) + " " + common) for i in range(40)]
    return docs


@pytest.mark.parametrize("shingle, percent, least, posting, tile", [
    (3, 90, 8, 16, 4096), (5, 80, 8, 16, 4096), (3, 90, 2, 2, 4), (3, 80, 10 ** 9, 3, 4), (3, 70, 2, 1, 8)])
def test_join_equals_brute_force(make_docs, words, monkeypatch, shingle, percent, least, posting, tile):
    for name, value in (("LEAST_COUNT", least), ("POSTING", posting), ("TILE_ROWS", tile)):
        monkeypatch.setattr(J, name, value)
    docs = near_copies(words)
    sets = [shingle_set(t, shingle) for _, t in docs]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = classes(len(docs), links)
    rows = J.jaccard_join(make_docs(docs).repartition(4), shingle=shingle, percent=percent).collect()
    assert {r.doc_id: (r.j_n, r.j_component) for r in rows} == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert all(r.j_first == (r.doc_id == r.j_component) for r in rows)
    assert len(rows) == len(docs)


def test_join_repeated_rows_null_ids_and_empty_table(make_docs):
    a, b = "one two three four five six", "seven eight nine"
    rows = J.jaccard_join(make_docs([(4, a), (4, a), (None, a), (None, b), (7, None), (7, None)])).collect()
    got = sorted(((r.doc_id, r.j_n, r.j_component, r.j_first) for r in rows), key=str)
    assert got == sorted([(4, 4, 4, True), (4, 4, 4, False), (None, 4, 4, False), (None, 1, None, True),
                          (7, 0, 7, True), (7, 0, 7, True)], key=str)
    assert sum(r.j_first for r in rows if r.j_component == 4) == 1
    assert J.jaccard_join(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        J.jaccard_join(make_docs([]), percent=50)


def test_join_shuffles_small_inputs_as_large_ones(spark, make_docs, words, monkeypatch):
    docs = make_docs(near_copies(words))
    assert broadcast_hints(spark, monkeypatch, J, lambda: J.jaccard_join(docs)) == 0


def test_jaccard_copies_over_partitions_keep_other_columns(spark, make_docs, words):
    """Copies in many partitions, repeated rows and null ids: one row of each class is first, columns come along."""
    from larder.llm.jaccard import jaccard_join
    base = [words(40, i) for i in range(12)]
    rows = [(i, base[i % 12]) for i in range(240)] + [(None, base[0]), (3, base[3]), (3, base[3]), (900, None), (901, "")]
    docs = make_docs(rows).repartition(9)
    got = jaccard_join(docs, shingle=3, percent=90, keep=["doc_id", "text", "lang", "j_set", "h"]).collect()
    assert len(got) == len(rows) and all(r["lang"] == "en" and r["h"] is not None for r in got)
    firsts = [r for r in got if r["j_first"] and r["text"]]
    assert sorted(r["doc_id"] for r in firsts) == list(range(12))
    assert all(r["j_component"] == base.index(r["text"]) for r in got if r["text"])
    assert {r["doc_id"]: r["j_component"] for r in got if not r["text"]} == {900: 900, 901: 901}


def test_discarded_tables_are_gone_and_others_stay(spark):
    import os

    from larder.llm.common import discard, staged
    kept, gone = staged(spark.range(5), "t-kept"), staged(spark.range(5), "t-gone")
    folder = gone.inputFiles()[0].removeprefix("file:").removeprefix("//").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    discard(gone)
    assert not os.path.exists(folder) and kept.count() == 5


def test_filter_by_number_loses_nothing(spark):
    """All wanted rows pass, also through a filter so small that it is full; a sparse one lets few others pass."""
    from pyspark.sql import functions as F

    from larder.llm import jaccard
    sets = spark.range(20_000).select(F.col("id").alias("j_uid"), F.lit(b"x").alias("j_set"))
    wanted = spark.range(0, 20_000, 40).select(F.col("id").alias("uid"))
    for bits, most in ((1 << 26, 520), (1 << 10, 20_000)):
        got = {r.uid for r in jaccard._filtered(sets, wanted, bits).collect()}
        assert got >= set(range(0, 20_000, 40)) and len(got) <= most
    assert jaccard._filtered(sets, wanted.where("false")).count() == 0


def test_many_equal_vectors_are_compared_once(spark, monkeypatch):
    """20,000 copies of one vector and two near ones: three vectors are compared, every link counts."""
    import numpy as np

    from larder.llm import embedding_dedup as D
    rng = np.random.default_rng(3)
    a = rng.normal(size=16)
    near, far = a + 0.05 * rng.normal(size=16), rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in a]) for i in range(20_000)]
    rows += [(30_000, [float(x) for x in near]), (30_001, [float(x) for x in near]), (30_002, [float(x) for x in far]), (-5, None)]
    written, real = {}, D.staged

    def counted(df, name):
        out = real(df, name)
        written[name] = out.count()
        return out
    monkeypatch.setattr(D, "staged", counted)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in D.near_duplicates(frame).collect()}
    assert written["vector-copies"] == 3 and written["vector-links"] <= 3 * 200
    assert got[0] == (20_001, 0, True) and got[19_999] == (20_001, 0, False)
    assert got[30_000] == (20_001, 0, False) and got[30_002] == (0, 30_002, True) and got[-5] == (0, -5, True)


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_runs_over_batch_borders(size):
    """Links of sorted keys, whatever the batches: pairs of short runs of rare tokens, stars of all others."""
    import pyarrow as pa
    rng = random.Random(size)
    rows = set()
    for code in range(60):
        for _ in range(rng.choice([1, 2, 3, 30, J.POSTING, J.POSTING + 1, 300])):
            rows.add((rng.choice([J.PAIR, J.SINGLE]) if code % 2 else J.SINGLE, code, rng.randrange(500)))
    rows = sorted(rows)
    rows += [(J.STAR, 1000 + i, i) for i in range(5)]
    twice = sorted(rows + rng.sample(rows[:-5], 40))
    full = pa.table({"code": pa.array([c for _, c, _ in twice], pa.int64()), "kind": pa.array([k for k, _, _ in twice], pa.int32()),
                     "node": pa.array([n for _, _, n in twice], pa.int64()),
                     "other": pa.array([-1 if k == J.STAR else None for k, _, _ in twice], pa.int64())})
    got = Counter()
    for b in J._runs(iter(full.to_batches(max_chunksize=size))):
        for r in b.to_pylist():
            if r["u"] != r["v"] or r["kind"] == J.SINGLE:
                got[r["u"], r["v"], r["n"], r["kind"]] += 1
    runs, want = {}, Counter()
    for kind, code, node in rows:
        runs.setdefault((kind, code), []).append(node)
    for (kind, code), nodes in runs.items():
        if kind == J.STAR:
            want[nodes[0], -1, None, J.STAR] += 1
        elif kind == J.SINGLE and len(nodes) <= J.POSTING:
            want.update((b, a, None, J.PAIR) for i, a in enumerate(nodes) for b in nodes[i + 1:])
        else:
            want.update((n, nodes[0], None, J.STAR) for n in nodes[1:])
            if kind == J.SINGLE:
                want[code, code, len(nodes), J.SINGLE] += 1
    assert got == want
