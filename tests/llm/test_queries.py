"""The registered queries on a small folder: columns, their order, and every digest against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import pii
from larder.llm.queries import QUERIES
from larder.llm.tokens import default_path, encoder
from test_dedup import classes, plain_removal, shingle_set
from test_text_operators import personal, plain_spans, plain_stats


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def held(i, folds, which):
    return zlib.crc32(str(i).encode()) % folds == which


@pytest.fixture(scope="module")
def corpus(words):
    """Documents in two made-up languages with copies, personal data, repeated passages, empty and odd texts."""
    rng = random.Random(11)
    passage = words(60, 77)
    rows = []
    for i in range(140):
        text = words(rng.choice([3, 30, 70, 200]), i)
        if i % 2:
            text = re.sub("[a-e]", lambda m: "ôùéèê"["abcde".index(m[0])], text)
        if i % 7 == 0:
            text += " " + passage + " " + words(5, 500 + i)
        if i % 9 == 0:
            text = personal(i, words)
        if i % 10 == 3:
            text = rows[-1][1]
        rows.append((i, text, ["xx", "yy"][i % 2]))
    return rows + [(900, None, "xx"), (901, "", None), (902, " \n\t", "yy"), (903, "12345 ...", "xx"), (904, "Line\nLine\n# $ |", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, corpus):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in corpus],
                          "doc_id long, text string, lang string, source string, n_chars long").repartition(3) \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _, _ in corpus], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in heads[i % 6] + 0.2 * rng.normal(size=12)], 0) for i in range(90)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 12, 0), (204, [float("nan")] + [1.0] * 11, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows


def run(spark, folder, key, columns):
    out = QUERIES[key](spark, folder[0])
    assert out.columns[:len(columns)] == columns
    return out.collect()


def test_op1(spark, folder):
    got = run(spark, folder, "op1_embedding_dedup", ["vec_id", "n_links", "component_id", "kept"])
    fine = {i: np.array(v, float) for i, v, _ in folder[1] if v and np.isfinite(v).all() and any(v)}
    ids = list(fine)
    unit = np.stack([v / np.linalg.norm(v) for v in fine.values()])
    link = unit @ unit.T >= 0.9
    want = {i: int(link[k].sum()) - 1 for k, i in enumerate(ids)}
    label = classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(len(ids)) if link[a, b]])
    low = {i: min(ids[j] for j in range(len(ids)) if label[j] == label[k]) for k, i in enumerate(ids)}
    for r in got:
        assert (r.n_links, r.component_id) == (want.get(r.vec_id, 0), low.get(r.vec_id, r.vec_id))
        assert r.kept == (r.vec_id == r.component_id)
    assert sorted(r.vec_id for r in got) == sorted(i for i, _, _ in folder[1])


def test_op2(spark, folder, corpus):
    got = run(spark, folder, "op2_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    want = plain_removal([(i, t) for i, t, _ in corpus])
    assert {tuple(r)[0]: tuple(r)[1:5] for r in got} == {i: (*w[:3], sha(w[3])) for i, w in want.items()}
    assert sum(w[1] for w in want.values()) > 1000


def test_op5(spark, folder, corpus):
    got = run(spark, folder, "op5_pack_documents",
              ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    enc, seen = encoder(default_path()), defaultdict(list)
    for r in got:
        seen[r.doc_id].append(r)
    for i, text, _ in corpus:
        ids = np.append(enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 0).astype("<u4")
        parts = sorted(seen[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert sum(p.length for p in parts) == len(ids) and (len(parts) == 1 or len(ids) > 2048)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in parts)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        assert [a for a, _ in sorted(places)] == np.cumsum([0] + [n for _, n in sorted(places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 2048
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 2048) + 1


def test_op6(spark, folder, corpus):
    got = run(spark, folder, "op6_language_id", ["doc_id", "held_out", "lang_pred", "score"])
    text = {i: (t, lang) for i, t, lang in corpus}
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        t, lang = text[r.doc_id]
        assert r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert r.lang_pred in ("xx", "yy", "und")
    tested = [r for r in got if r.held_out and r.doc_id < 140 and r.doc_id % 9 and r.doc_id % 10 != 3]
    assert sum(r.lang_pred == text[r.doc_id][1] for r in tested) >= 0.85 * len(tested) > 10


def test_op7(spark, folder, corpus):
    got = run(spark, folder, "op7_quality_rules",
              ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    want = {i: plain_stats(t) for i, t, _ in corpus}
    for r in got:
        assert tuple(r)[1:6] == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert len(got) == len(corpus) and any(r.kept for r in got)


def test_op8(spark, folder, corpus):
    got = run(spark, folder, "op8_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    kinds = pii.LABELS[1:]
    for r in got:
        text = next(t for i, t, _ in corpus if i == r.doc_id) or ""
        base = sorted(plain_spans(text), key=lambda s: (s[1], kinds.index(s[0])))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
        assert not Counter(base) - Counter(spans) and len(spans) == r.n_spans == len(base) + r.n_added
    assert len(got) == len(corpus) and sum(r.n_phone for r in got) > 10


def test_op9(spark, folder, corpus):
    got = run(spark, folder, "op9_jaccard_join", ["doc_id", "n_shingles", "component_id"])
    sets = [shingle_set(t, 3) for _, t, _ in corpus]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    label = classes(len(sets), links)
    want = {i: (len(s), corpus[label[k]][0]) for k, ((i, _, _), s) in enumerate(zip(corpus, sets))}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and links


def test_op10(spark, folder, corpus):
    got = QUERIES["op10_token_counts"](spark, folder[0])
    total = Counter()
    for r in got.collect():
        total[r["doc_id"]] += r["n_tokens"]
    tokenizer = encoder(default_path()).tokenizer
    assert all(total[i] == len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, _ in corpus)


def test_every_query_takes_an_empty_folder(spark, tmp_path):
    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long",
                         "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int",
                         "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for key, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if key.startswith("op3") else 0), key
