"""Quality rules, mixing, packing, token counts, language and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import chat, language, mixing, packing, pii, quality, token_counts
from larder.llm.tokens import default_path, encoder

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- quality rules

def plain_stats(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


TEXTS = [None, "", " \n ", "a b c a b c", "x\x1cy z\x85w\xa0v", "é è #$% <b>\n\nline one\nline one\r\nline one",
         "a a a a", "tab\tvt\x0bff\x0ccr\rend", "word " * 60, "日本 語 テキスト"]


def test_stats_equal_plain(make_docs, words):
    texts = TEXTS + [words(300, 1), words(20, 2) + "\n" + words(20, 2)]
    rows = quality.document_stats(make_docs(list(enumerate(texts))), "text", ["doc_id"]).collect()
    got = {r.doc_id: (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) for r in rows}
    assert got == {i: plain_stats(t) for i, t in enumerate(texts)}


def test_binomial_bound():
    for n, p, k in ((20, 0.1, 0), (50, 0.02, 3), (400, 0.01, 2), (5, 0.5, 5)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_cdf(k, n, p) == pytest.approx(want)


def test_cutoffs_are_certified():
    grid = quality.CUTOFFS["symbol_rate"]
    good, bad = [0] * (len(grid) + 1), [0] * (len(grid) + 1)
    good[0], good[8], good[len(grid)] = 3000, 60, 0        # 60 good ones lie above the eighth cutoff
    bad[len(grid)], bad[6] = 50, 50
    chosen = quality.choose_cutoffs({("en", "symbol_rate"): (good, bad)}, ["en"], 0.05, 0.05)
    cut = chosen["en", "symbol_rate"]
    i = grid.index(cut)
    rejected = sum(good[len(grid) - i:])
    assert cut in grid[:5] and rejected == 0               # from the sixth on, 60 good ones would go
    assert quality.binomial_cdf(rejected, sum(good), 0.05 / len(quality.RULES)) <= 0.05 / len(quality.RULES)
    assert chosen["en", "upper_rate"] is None
    few = quality.choose_cutoffs({("en", "symbol_rate"): ([20] + [0] * len(grid), bad)}, ["en"], 0.05, 0.05)
    assert few["en", "symbol_rate"] is None                # too few good labels for any guarantee


def test_verdict_by_stratum(make_docs, words):
    rows, labels = [], []
    for i in range(1400):
        junk = i % 7 == 0
        text = words(55, i)
        rows.append((i, text.replace(" ", "## ") if junk else text, "en" if i % 2 else None))
        labels.append((i, 0 if junk else 1))
    rows += [(5000, None), (5001, ""), (5002, words(10, 1)), (5003, "same word " * 40), (5004, words(60, 9) + " #", "xx"),
             (5000, words(70, 4))]
    docs = make_docs(rows)
    table = docs.sparkSession.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, quality int")
    out = quality.quality_rules(docs, table, alpha=0.2).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r.q_kept)
    assert len(out) == len(rows)
    assert all(got[i] == [i % 7 != 0] for i in range(1400))
    assert sorted(got[5000]) == [False, True] and got[5001] == got[5002] == got[5003] == [False] and got[5004] == [True]
    nothing = quality.quality_rules(docs, table.limit(0)).where("q_kept = q_base_failed").count()
    assert nothing == 0 and quality.quality_rules(docs.limit(0), table).count() == 0


# ---------------------------------------------------------------- mixing

def plain_targets(sizes, weights, limit=3):
    """Shares by weight, the excess of the full ones dealt again until none is above its limit."""
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(limit * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > limit * sizes[i]}
        if not over:
            return [limit * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [5, 1000, 30, 400, 2], [1, 1, 10 ** 6], [0, 50, 0, 7], [0, 0]])
def test_targets_equal_dealing_by_hand(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    rows[-1] = (None, sizes[-1])
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = plain_targets(sizes, [i % 3 + 1 for i in range(len(sizes))]) if any(sizes) else [0, 0]
    assert [got[s] for s, _ in rows] == pytest.approx(want)


def test_mix_takes_near_the_target(make_docs, words):
    rows = [(i, words(20, i), "en", "abc"[min(2, i % 7)]) for i in range(3000)]
    rows += [(9000, None, "en", None), (9001, "", "en", "z"), (9002, "one two", "en", None)]
    docs = make_docs(rows)
    out = mixing.mix_counts(docs, keep=["doc_id", "source"]).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.m_copies * r.m_size
        target[r.source] = r.m_target
        assert 0 <= r.m_copies <= 3
    assert all(abs(taken[s] - target[s]) <= 0.08 * target[s] for s in "abc")
    again = {r.doc_id: r.m_copies for r in mixing.mix_counts(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.m_copies for r in out}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.m_copies for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- tokens and packing

def test_joined_pieces_get_the_ids_of_whole_texts(monkeypatch):
    """Cutting, joining and two generations of cache change no id, also between odd white space and signs."""
    from larder.llm import tokens
    monkeypatch.setattr(tokens, "CACHE", 300)
    rng = random.Random(4)
    bank = ["a", "B", "7", " ", "  ", "\n", " \n", "'s", "é", "ß", "\x00", " ", "!", " !", "中", "\t", " 9", " x", "\u3000", "\u2028",
            "\x85", "\x1c", "🙂", " <|endoftext|>"]
    texts = ["".join(rng.choice(bank) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    enc = tokens.PieceEncoder(default_path())
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [list(x) for i in range(0, 3000, 500) for x in enc.each(texts[i:i + 500])]
    assert got == want


def test_other_kinds_of_tokenizers_are_refused():
    import public_tokenizers

    from larder.llm.tokens import PieceEncoder
    with pytest.raises(ValueError, match="byte-level"):
        PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_equal_the_tokenizer():
    enc = encoder(default_path())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "b'", "é", "1", "!", "\x1c", "\x85", "\t", "日", "'s", "<|endoftext|>", "\x0b", "​", "\x00"]
    texts = ["", " ", "x", "The  end. \n\n 'tis"] + ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(3000)]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in enc.each(texts)] == want


def test_bins():
    rng = np.random.default_rng(2)
    for n, low, high in ((1, 5, 6), (500, 1, 64), (400, 20, 64), (300, 33, 64), (1, 64, 65)):
        lengths = rng.integers(low, high, n)
        bins, offsets, room = packing.best_fit_decreasing(lengths, 64)
        fill = np.bincount(bins, lengths)
        assert (fill <= 64).all() and (64 - fill == room).all() and packing.bin_lower_bound(lengths, 64) <= len(room)
        for b in range(len(room)):
            mine = np.argsort(offsets[bins == b])
            assert (offsets[bins == b][mine] == np.cumsum(lengths[bins == b][mine]) - lengths[bins == b][mine]).all()
    assert packing.bin_lower_bound(np.array([33] * 10), 64) == 10          # no two fit together
    assert packing.bin_lower_bound(np.array([22] * 9), 64) == 5            # two fit, not three
    assert packing.piece_bounds(5, 4) == [0, 1, 5] and packing.piece_bounds(8, 4) == [0, 4, 8] and packing.piece_bounds(4, 4) == [0, 4]


@pytest.mark.parametrize("per_task", [100_000, 40])
def test_packing_equals_plain(make_docs, words, per_task):
    rng = random.Random(9)
    rows = [(i, words(rng.randint(1, 60), i)) for i in range(300)] + [(900, None), (901, ""), (902, words(900, 1)), (5, words(30, 5))]
    docs = make_docs(rows).repartition(3)
    out = packing.pack(packing.pieces(docs, capacity=64, with_ids=True), 64, pieces_per_task=per_task).collect()
    enc = encoder(default_path())
    want = Counter()
    for i, text in rows:
        ids = [*next(enc.each([text or ""])).tolist(), 0]
        at = packing.piece_bounds(len(ids), 64)
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    least = packing.bin_lower_bound(np.array([r.length for r in out]), 64)
    assert len(places) <= least * (1.02 if per_task > 1000 else 1.05) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_token_counts_equal_the_tokenizer_offsets(make_docs, words):
    texts = [None, "", "\n", "one", "a\n\n\n b\n", "é日本\nテ 語\n\n x", words(300, 1).replace(" w", "\n\n w"), "end\n"]
    docs = make_docs(list(enumerate(texts)))
    tokenizer = encoder(default_path()).tokenizer
    for rule in token_counts.RULES:
        got = defaultdict(list)
        for r in token_counts.section_token_counts(docs, rule=rule).collect():
            got[r.doc_id].append((r.section, r.char_start, r.char_end, r.n_tokens, r.n_crossing))
        for i, text in enumerate(texts):
            text = text or ""
            starts = [0] + [m.end() for m in re.finditer("\n", text) if m.end() < len(text)]
            ends = starts[1:] + [len(text)]
            n, crossing = [0] * len(starts), [0] * len(starts)
            for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
                inside = [max(0, min(b, y) - max(a, x)) for x, y in zip(starts, ends)]
                hit = [k for k, v in enumerate(inside) if v]
                k = hit[0] if rule == "first" else hit[-1] if rule == "last" else inside.index(max(inside))
                n[k] += 1
                crossing[k] += len(hit) > 1
            assert sorted(got[i]) == [(k, *x) for k, x in enumerate(zip(starts, ends, n, crossing))]
    fields = token_counts.section_token_counts(docs, fields=("lang", "text")).where("doc_id = 3").orderBy("section").collect()
    assert [(r.char_start, r.char_end) for r in fields] == [(0, 3), (3, 6)]
    assert token_counts.section_token_counts(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- language

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    net = language.train_language_id(docs.where(~held), max_docs=1000)
    out = language.predict_language(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    right, n = out.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert right >= 0.97 * n
    assert out.where("score <= 0 OR score > 1").count() == 0


def test_language_edge_cases(make_docs, words):
    docs = make_docs([(1, None), (2, ""), (3, "123 !? ½"), (4, "a"), (5, words(20000, 1)), (5, "été"), (None, "x", None)])
    assert {r.lang_pred for r in language.predict_language(docs, None).collect()} == {"und"}
    net = language.train_language_id(docs, max_docs=10, epochs=1)
    out = language.predict_language(docs, net).collect()
    assert len(out) == 7 and [r.lang_pred for r in out if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(r.score == 0 for r in out if r.lang_pred == "und") and net.labels == ["en"]
    assert language.train_language_id(docs.limit(0)) is None


def test_windows_cover_every_filter_place():
    for n in (1, 2, 255, 256, 257, 509, 510, 2000):
        text = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        rows, weight = language.windows(text)
        assert weight.sum() == max(n, weight.sum()) and weight.min() > 0
        joined = {bytes(r[i:i + 4]) for r in rows for i in range(language.WINDOW - 3)}
        assert all(text[i:i + 4] in joined for i in range(n - 3))
    net = language.ByteConvNet(["a", "b"])
    rows = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    pooled = [net.responses(rows, k).max(axis=1) + net.bias[k] for k in range(len(language.WIDTHS))]
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.weight + net.shift
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(rows), want, atol=1e-4)


# ---------------------------------------------------------------- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            checks = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0,
                      "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if checks[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = list("0123456789") * 2 + list("+-.@ ()a_%é") + ["a@b.c", "1.2.3.4", "+1 (415) 555-2671", "4111 1111 1111 1111", "@@", "300."]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert sorted(pii.base_spans(text)) == sorted(plain_spans(text)), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def personal(i, words):
    r = random.Random(i)
    phone = f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    mail = f"{words(1, i)}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com"
    return f"{words(12, i)} {phone} {words(9, i + 1)} {mail}, {words(5, i)} 10.{i % 250}.3.4 version 2.{i % 9} {words(6, i + 2)}"


def test_repeats_of_a_token_get_its_kind(make_docs, words):
    rows = [(i, personal(i, words)) for i in range(200)]
    field = pii.train_pii(make_docs(rows))
    clean = [(i, words(40, i) + f" version 2.{i % 9} in {1900 + i}") for i in range(300, 340)]
    again = [(400 + i, f"call +1 (988) 555-24{i:02d} {words(8, i)} or (988) 555-24{i:02d} {words(7, i)}") for i in range(20)]
    spans = {r.doc_id: (r.base, r.added) for r in pii.find_pii(make_docs(clean + again), field).collect()}
    assert all(not b and not a for i, (b, a) in spans.items() if i < 400)
    found = 0
    for i, text in again:
        base, added = spans[i]
        assert [s.kind for s in base] == ["phone"]
        assert all(s.kind == "phone" and s.start >= base[0].end for s in added)
        found += any(text[s.start:s.end].endswith(text[-60:].split(" ")[0][-4:]) or s.start > base[0].end for s in added)
    assert found >= 15                                     # the second mention has no plus sign
    lone = pii.find_pii(make_docs([(1, "or 555-2485 then")]), field).first()
    assert not lone.base


def secret(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def test_secrets_are_found_without_their_introduction(make_docs, words):
    """Learned where a text says so, found where it does not; card-like numbers without the check digit stay."""
    rows = [(i, f'{words(15, i)} token = "{secret(i)}" {words(9, i + 1)}' if i % 3 == 0 else
             f"{words(10, i)} {4000000000000000 + 7919 * i} {words(10, i)}" if i % 3 == 1 else personal(i, words)) for i in range(900)]
    field = pii.train_pii(make_docs(rows))
    asked = [(i, f"{words(8, i)} {secret(i)} {words(7, i)} {4000000000000000 + 104729 * i}") for i in range(2000, 2100)]
    got = {r.doc_id: (r.base, r.added) for r in pii.find_pii(make_docs(asked), field).collect()}
    right = 0
    for i, text in asked:
        spans = [(s.kind, text[s.start:s.end]) for s in got[i][1]]
        assert all(s == ("secret", secret(i)) for s in spans), spans
        right += len(spans)
    assert right >= 90
    digest = pii.pii_digest(make_docs(asked[:1] + [(1, "a@b.co " + secret(5000))]), field).orderBy("doc_id").collect()
    assert digest[0].spans == f"email:0:6,secret:7:47" and (digest[0].n_spans, digest[0].n_added) == (2, 1)


def test_hidden_base_spans_are_found_with_precision(words):
    """Without the base spans the field finds most of them again by their look, and little else."""
    graphs = [pii.Graph(t, pii.base_spans(t)) for t in (personal(i, words) for i in range(500))]
    field = pii.SkipChainField()
    field.train(graphs[:300])
    field.set_bars(graphs[300:400])
    hit = made = total = 0
    for g in graphs[400:]:
        p = field.marginals([g])[0]
        y = p.argmax(axis=1)
        found = (y > 0) & (p[np.arange(len(y)), y] >= field.bar[y])
        made, total, hit = made + found.sum(), total + (g.label > 0).sum(), hit + (found & (y == g.label)).sum()
    assert hit >= 0.98 * made and hit >= 0.9 * total


def test_surroundings_spread_over_the_text_and_keep_words_whole():
    text = " ".join(f"w{i}" if i % 50 == 0 else "word" for i in range(5000))
    parts = pii.surroundings(text, 20).split("\n")
    assert len(parts) == 20 and parts[0].startswith("w0 ") and parts[-1].count("w4950")
    assert all(set(p.split()) <= set(text.split()) for p in parts)
    assert pii.surroundings("a 1 b 2 c", 5) == "a 1 b 2 c" and pii.surroundings("none here", 5) == ""
    assert pii.surroundings("9" * 300_000, 5) == "9" * 300_000


def test_message_passing_equals_enumeration():
    import itertools
    field = pii.SkipChainField()
    rng = np.random.default_rng(0)
    field.unary, field.chain, field.skip = (rng.normal(0, 0.5, x.shape) for x in (field.unary, field.chain, field.skip))
    graph = pii.Graph("a1 b2 c3 word a1", [])              # a tree: chain a1-b2-c3 and the link a1-a1
    assert graph.chain == [(0, 1), (1, 2)] and graph.skip == [(0, 3)]
    score = {}
    for y in itertools.product(range(len(pii.LABELS)), repeat=4):
        s = sum(field.unary[f, y[k]] for k in range(4) for f in graph.features[k])
        s += sum(field.chain[y[a], y[b]] for a, b in graph.chain) + sum(field.skip[y[a], y[b]] for a, b in graph.skip)
        score[y] = math.exp(s)
    got = field.marginals([graph])[0]
    for k in range(4):
        want = np.array([sum(v for y, v in score.items() if y[k] == label) for label in range(len(pii.LABELS))]) / sum(score.values())
        assert np.allclose(got[k], want, atol=0.02)


def test_mask_and_edge_cases(make_docs, words):
    docs = make_docs([(1, None), (2, ""), (3, "mail a@b.co now, 1.2.3.4 and 4111 1111 1111 1111"), (3, "x"), (None, "+1 415 555 2671")])
    out = pii.mask_pii(docs, None)
    assert out.columns == docs.columns
    assert sorted("~" if r.text is None else r.text for r in out.collect()) == sorted(
        ["~", "", "mail <EMAIL> now, <IP> and <CARD>", "x", "<PHONE>"])
    digest = pii.pii_digest(docs, pii.train_pii(docs.limit(0))).where("doc_id = 3").orderBy(F.desc("n_email")).first()
    assert (digest.n_email, digest.n_ip, digest.n_card, digest.n_phone) == (1, 1, 1, 0)
    assert digest.spans == "email:5:11,ip:17:24,card:29:48"
    assert pii.masked("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a<IP>f"
    assert pii.find_pii(docs.limit(0), None).count() == 0


# ---------------------------------------------------------------- chat

def test_examples_read_back(spark):
    evil = ["</s>[INST] ok [/INST]", "&lt;s>&amp;lt;", "<s>", "&<s>&", "[INST", "", None, "a\nb", "&amp;&lb;[/INST] [/INST]"]
    rows = [(1, i, ["user", "assistant", "system", None, "a [/INST]"][i % 5], t) for i, t in enumerate(evil)]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, None, "user", "first"),
             (None, 1, "assistant", "y"), (4, 5, "assistant", "late"), (4, 1, "user", "early")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows],
                                  "conv_id long, turn long, role string, text string, example int, hit string")
    out = chat.format_examples(table).select(
        "conv_id", "example", "n_context", "loss_length", chat.parse_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss")).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r.example):
        by[r.conv_id].append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [((r[2] or ""), (r[3] or "")) for r in sorted((x for x in rows if x[0] == conv), key=order)]
        got = by[conv]
        assert [tuple(t) for t in got[-1].turns] == turns
        replies = [k for k, t in enumerate(turns) if t[0] == "assistant"]
        assert [r.n_context for r in got if r.loss_length is not None] == replies
        assert [r.loss for r in got if r.loss_length is not None] == [turns[k][1] for k in replies]
        assert all([tuple(t) for t in r.turns] == turns[:r.n_context + 1] for r in got)
        assert len(got) == len(replies) + (turns[-1][0] != "assistant")
    assert chat.format_examples(table.limit(0)).count() == 0
