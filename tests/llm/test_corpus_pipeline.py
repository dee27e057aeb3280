"""The pipeline against a plain version of its stages on a small corpus."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from larder.llm import mixing, packing, pii, quality
from larder.llm.tokens import default_path, encoder


def corpus(words):
    rng = random.Random(4)
    rows = [(0, None, "en", "a"), (1, "", "en", "a"), (2, words(20, 1), "en", "b"), (3, "same word " * 50, None, None)]
    for i in range(4, 60):
        text = words(rng.randint(55, 160), i)
        if i % 6 == 0:
            text += f" mail {words(1, i)}@example{i}.com or +1 (415) 555-{1000 + i} from 10.0.{i}.7"
        rows.append((i, text, "en", rng.choice(["a", "b", None])))
    for i in range(60, 90):
        base = rows[rng.randrange(4, 20)]
        copy = base[1].split()
        for _ in range(rng.choice([0, 1, 2, 30])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy), "en", base[3]))
    rows.append((90, words(5000, 7), "en", "a"))
    return rows


def near_duplicate_heads(rows):
    sets = {}
    for i, text, *_ in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return {i for i, c in label.items() if i == c}


def test_run_equals_plain_stages(spark, tmp_path, words):
    rows = corpus(words)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "x") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 "q_kept int, j_first string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))

    def passes(text):
        n, _, _, _, repeated, *_ = quality.text_stats((text or "").encode())
        return n >= 50 and 2 * repeated <= n
    kept = [r for r in rows if passes(r[1])]
    heads = near_duplicate_heads(kept)
    kept = [r for r in kept if r[0] in heads]
    assert 40 < len(kept) < 80
    clean = {r[0]: pii.masked(r[1], pii.base_spans(r[1])) for r in kept}
    sizes = {i: len(t.split()) for i, t in clean.items()}
    per = defaultdict(int)
    for r in kept:
        per[r[3]] += sizes[r[0]]
    table = spark.createDataFrame([(r[0], clean[r[0]], r[3]) for r in kept], "doc_id long, text string, source string")
    copies = {r.doc_id: r.m_copies for r in mixing.mix_counts(table).collect()}
    target = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame([(s, n) for s, n in per.items()], "source string, size long")).collect()}
    assert all(int(target[r[3]] / per[r[3]]) <= copies[r[0]] <= int(target[r[3]] / per[r[3]]) + 1 for r in kept)

    enc, want = encoder(default_path()), Counter()
    for i, text in clean.items():
        ids = np.append(next(enc.each([text])), np.zeros(1, "<u4"))
        at = packing.piece_bounds(len(ids), packing.CAPACITY)
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())] += copies[i]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == +want
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CAPACITY


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, c0 int, m_size string"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
