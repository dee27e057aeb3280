"""Personal data: fixed base patterns, and a skip-chain conditional random field over them.

The base patterns find e-mail addresses, IP addresses, payment cards and phone
numbers; every span they find stays.  The field adds spans of the same kinds.
Its nodes are the tokens that could belong to one (with a digit or ``@``, or
equal to a token of a base span); neighbours in the text are linked, and so
are repeated tokens (equal, or with the same digits) at any distance, each with its
next occurrence.  Loopy message passing over a document's nodes gives each
token a distribution over the kinds, so that occurrences of one token pull
each other to one kind; tokens whose best kind reaches that kind's bar become spans.

It knows a fifth kind, ``secret``: keys and access tokens.  They are no base
spans; the field learns how they look from those that a text introduces as such (``SEED``),
with the introduction left out of the features, and finds them wherever they stand.

The field learns by pseudo-likelihood from at most ``MAX_DOCS`` documents, and
``MAX_TOKENS`` tokens of each, spread evenly over the text.  A fifth of these
documents is held out: their spans are hidden, and a kind's bar is the lowest belief from
which on ``PRECISION`` of what the field finds there is right (``CERTAIN`` where too little is held out).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
MAX_DOCS, MAX_TOKENS = 2000, 200
FEATURES = 1 << 14
STEPS, RATE = 150, 0.05
ROUNDS, DAMPING = 10, 0.5
CERTAIN = 0.97
PRECISION, HELD_OUT = 0.995, 5
SEED = re.compile(r"""\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s*[:=]\s*["']?([A-Za-z0-9+/_-]{16,})""", re.I)

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts, and no shorter run helps it.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
MAYBE = re.compile(r"[0-9@]")
EDGE = ".,;:!?\"'"
HEX = frozenset("0123456789abcdefABCDEF")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns: kind by kind, leftmost and not overlapping, failing matches dropped."""
    out = []
    last = 0
    for m in DOMAIN.finditer(text):
        begin = m.start()
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < m.start():
            out.append(("email", begin, m.end()))
            last = m.end()
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def seed_spans(text: str) -> list[tuple[str, int, int]]:
    """Secrets that the text introduces as such: what the field learns the kind from."""
    return [("secret", *m.span(1)) for m in SEED.finditer(text)]


def mixture(token: str) -> str:
    """Which sorts of characters a token has, and whether a long run of digits ends in its check digit."""
    core = [c for c in token if c.isalnum()]
    sorts = "".join(k for k, yes in (("9", any(c.isdigit() for c in core)), ("a", any(c.islower() for c in core)),
                                     ("A", any(c.isupper() for c in core))) if yes)
    digits = "".join(core) if core and all("0" <= c <= "9" for c in core) else ""
    check = str(luhn(digits)) if 12 <= len(digits) <= 19 else "-"
    return f"{sorts},{all(c in HEX for c in core)},{check},{min(len(core).bit_length(), 8)}"


def shape(token: str) -> str:
    """Character classes, runs shortened to their length up to 4 (longer: to a power of two)."""
    out, i = [], 0
    classes = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token]
    while i < len(classes):
        j = i
        while j < len(classes) and classes[j] == classes[i]:
            j += 1
        n = j - i
        out.append(classes[i] + str(n if n <= 4 or classes[i] == "9" and n <= 20 else 1 << (n.bit_length() - 1)))
        i = j
    return "".join(out[:24])


class Graph:
    """Nodes and links of one document."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        base = sorted(base, key=lambda s: s[1])
        self.spans = []                                   # of the nodes, without punctuation at the edges
        words, active, label = [], [], []
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        inside = self._labels(tokens, base)
        known = {text[a:b].strip(EDGE).lower() for (a, b), y in zip(tokens, inside) if y}
        for i, (a, b) in enumerate(tokens):
            word = text[a:b]
            if inside[i] or MAYBE.search(word) or word.strip(EDGE).lower() in known:
                left = len(word) - len(word.lstrip(EDGE))
                core = word.strip(EDGE) or word
                left = left if word.strip(EDGE) else 0
                active.append(i)
                words.append(core)
                self.spans.append((a + left, a + left + len(core)))
                label.append(inside[i])
        self.label = np.array(label, np.int64)
        self.features = [self._features(words, active, tokens, text, k) for k in range(len(words))]
        self.chain = [(k - 1, k) for k in range(1, len(active)) if active[k] == active[k - 1] + 1]
        self.skip, seen = [], {}
        for k, w in enumerate(words):
            digits = "".join(c for c in w if c.isdigit())
            names = {"w" + w.lower()} | ({"d" + digits} if len(digits) >= 6 else set())
            for j in {seen[x] for x in names if x in seen}:
                if j != k - 1 or (j, k) not in self.chain[-1:]:
                    self.skip.append((j, k))
            seen.update(dict.fromkeys(names, k))

    @staticmethod
    def _labels(tokens, base) -> list[int]:
        out, j = [0] * len(tokens), 0
        ends: list = []
        for i, (a, b) in enumerate(tokens):
            while j < len(base) and base[j][1] < b:
                ends.append(base[j])
                j += 1
            ends = [s for s in ends if s[2] > a]
            if ends:
                out[i] = LABELS.index(min(ends, key=lambda s: LABELS.index(s[0]))[0])
        return out

    @staticmethod
    def _features(words, active, tokens, text, k) -> list[int]:
        word, i = words[k], active[k]
        before = shape(text[slice(*tokens[i - 1])]) if i else "<"
        after = shape(text[slice(*tokens[i + 1])]) if i + 1 < len(tokens) else ">"
        digits = sum(map(str.isdigit, word))
        names = ["s=" + shape(word), f"d={min(digits, 24)}", "l=" + str(min(len(word), 40)),
                 "p=" + "".join(sorted({c for c in word if not c.isalnum()})),
                 "b=" + (before if "9" in before else "word"),
                 "a=" + (after if "9" in after else "word"), "sd=" + shape(word) + (before[:6] if "9" in before else ""),
                 "m=" + mixture(word), "1"]
        return [xxhash.xxh32_intdigest(n) % FEATURES for n in names]


class SkipChainField:
    """Weights of features, of neighbouring tokens and of repeated tokens."""

    def __init__(self):
        self.unary = np.zeros((FEATURES, len(LABELS)))
        self.chain = np.zeros((len(LABELS), len(LABELS)))
        self.skip = np.zeros((len(LABELS), len(LABELS)))
        self.bar = np.full(len(LABELS), CERTAIN)

    def set_bars(self, graphs: list[Graph], precision: float = PRECISION) -> None:
        """Each kind's bar from documents the field has not seen: the lowest belief that keeps the precision."""
        graphs = [g for g in graphs if g.spans]
        if not graphs:
            return
        belief, truth = np.concatenate(self.marginals(graphs)), np.concatenate([g.label for g in graphs])
        best = belief.argmax(axis=1)
        for y in range(1, len(LABELS)):
            mine = best == y
            order = np.argsort(-belief[mine, y], kind="stable")
            p, right = belief[mine, y][order], (truth[mine] == y)[order]
            good = np.flatnonzero(np.cumsum(right) >= precision * np.arange(1, len(p) + 1))
            good = good[good + 1 >= 20] if len(good) else good         # a bar needs twenty findings at least
            if len(good):
                lowest = float(p[good[-1]])
                # above CERTAIN only where something wrong was found there
                self.bar[y] = max(0.5, min(lowest, CERTAIN) if good[-1] == len(p) - 1 else lowest)

    @staticmethod
    def _join(graphs: list[Graph]):
        at = np.cumsum([0] + [len(g.spans) for g in graphs])
        feats = np.array([f for g in graphs for f in g.features], np.int64).reshape(int(at[-1]), -1)
        links = [np.array([(a + o, b + o) for g, o in zip(graphs, at.tolist()) for a, b in getattr(g, kind)],
                          np.int64).reshape(-1, 2) for kind in ("chain", "skip")]
        return feats, *links

    def train(self, graphs: list[Graph]) -> None:
        """Pseudo-likelihood by Adam: each token given its features and its neighbours' labels."""
        graphs = [g for g in graphs if g.spans]
        if not graphs:
            return
        feats, chain, skip = self._join(graphs)
        y = np.concatenate([g.label for g in graphs])
        one = np.eye(len(LABELS))
        params, step = [self.unary, self.chain, self.skip], 0
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(STEPS):
            logits = self.unary[feats].sum(axis=1)
            for links, pot in ((chain, self.chain), (skip, self.skip)):
                np.add.at(logits, links[:, 1], pot[y[links[:, 0]]])
                np.add.at(logits, links[:, 0], pot.T[y[links[:, 1]]])
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - one[y]) / len(y)
            unary = np.zeros_like(self.unary)
            np.add.at(unary, feats.ravel(), np.repeat(p, feats.shape[1], axis=0))
            grads = [unary + 1e-6 * self.unary]
            for links in (chain, skip):
                g = np.zeros((len(LABELS), len(LABELS)))
                np.add.at(g, y[links[:, 0]], p[links[:, 1]])
                np.add.at(g.T, y[links[:, 1]], p[links[:, 0]])
                grads.append(g + 1e-6 * (self.chain if links is chain else self.skip))
            step += 1
            for q, g, m, v in zip(params, grads, mean, var):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)

    def marginals(self, graphs: list[Graph]) -> list[np.ndarray]:
        """Beliefs of the nodes of each document after damped message passing."""
        feats, chain, skip = self._join(graphs)
        local = self.unary[feats].sum(axis=1) if len(feats) else np.zeros((0, len(LABELS)))
        src = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]])
        dst = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]])
        pot = np.concatenate([np.repeat(x[None], n, axis=0) for x, n in
                              ((self.chain, len(chain)), (self.skip, len(skip)),
                               (self.chain.T, len(chain)), (self.skip.T, len(skip)))])
        half = len(src) // 2
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((len(src), len(LABELS)))
        for _ in range(ROUNDS if half else 0):
            belief = local.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[back])[:, :, None] + pot
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        np.add.at(local, dst, message)
        p = np.exp(local - local.max(axis=1, keepdims=True, initial=-np.inf))
        p /= p.sum(axis=1, keepdims=True)
        return np.split(p, np.cumsum([len(g.spans) for g in graphs])[:-1])


def added_spans(graph: Graph, belief: np.ndarray, base: list[tuple[str, int, int]],
                bar: np.ndarray, text: str) -> list[tuple[str, int, int]]:
    """Tokens outside the base spans that reach their kind's bar; neighbours of one kind become one span."""
    taken = sorted((a, b) for _, a, b in base)
    out: list[list] = []
    linked = {k for _, k in graph.chain}
    previous = None
    for k, ((a, b), p) in enumerate(zip(graph.spans, belief)):
        y = int(p.argmax())
        if y == 0 or p[y] < bar[y] or any(x < b and a < z for x, z in taken):
            previous = None
            continue
        while not text[b - 1].isalnum() and b - 1 > a:          # signs around a token are none of it
            b -= 1
        while not (text[a].isalnum() or text[a] in "+(") and a + 1 < b:
            a += 1
        if previous == (k - 1, y) and k in linked:
            out[-1][2] = b
        else:
            out.append([LABELS[y], a, b])
        previous = (k, y)
    return [tuple(x) for x in out]


def find_spans(texts: list[str | None], field: SkipChainField | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    found: list = [([], [])] * len(texts)
    graphs, where = [], []
    for i, text in enumerate(texts):
        if text and MAYBE.search(text):
            base = base_spans(text)
            found[i] = (base, [])
            if field is not None:
                graphs.append(Graph(text, base))
                where.append(i)
    if graphs:
        for i, g, belief in zip(where, graphs, field.marginals(graphs)):
            found[i] = (found[i][0], added_spans(g, belief, found[i][0], field.bar, texts[i]))
    return found


def surroundings(text: str, most: int, reach: int = 64) -> str:
    """The words around up to ``most`` possible tokens, evenly spread over the text; pieces apart stand on lines of their own."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    marked = [i for i, (a, b) in enumerate(tokens) if MAYBE.search(text, a, b)]
    if len(marked) > most:
        marked = [marked[i] for i in np.unique(np.linspace(0, len(marked) - 1, most).astype(int)).tolist()]
    parts: list[list[int]] = []
    for i in marked:
        first, last = i, i
        while first > 0 and tokens[i][0] - tokens[first - 1][0] <= reach:
            first -= 1
        while last + 1 < len(tokens) and tokens[last + 1][1] - tokens[i][1] <= reach:
            last += 1
        if parts and first <= parts[-1][1] + 1:
            parts[-1][1] = max(parts[-1][1], last)
        else:
            parts.append([first, last])
    return "\n".join(text[tokens[a][0]:tokens[b][1]] for a, b in parts)


def train_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> SkipChainField:
    """A field learned from the base and introduced spans of a bounded sample, the lowest hashes of the ids."""
    rows = docs.where(F.col(text_col).rlike(MAYBE.pattern)) \
        .select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The surroundings of up to ``MAX_TOKENS`` possible tokens of a text, evenly spread, a line each."""
        for batch in batches:
            texts = [surroundings(text, MAX_TOKENS) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["h", "text"])

    n = rows.count()
    near = rows.where(F.pmod("h", F.lit(1 << 20)) < F.lit((1 << 20) * 2 * max_docs / max(n, 1)))
    sample = near.mapInArrow(cut, "h long, text string").orderBy("h", "text").limit(max_docs).collect()
    graphs = [Graph(t, base_spans(t) + seed_spans(t)) for _, t in sample]
    kept, hidden = [g for i, g in enumerate(graphs) if i % HELD_OUT], graphs[::HELD_OUT]
    field = SkipChainField()
    field.train(kept)
    field.set_bars(hidden)
    return field


def _batches(field, sc, fn):
    shared = sc.broadcast(field)                                # FEATURES x LABELS weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield fn(batch, texts, find_spans(texts, shared.value))

    return run


def find_pii(docs: DataFrame, field: SkipChainField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, added`` for every row: arrays of ``kind, start, end`` in code points, end exclusive.

    A null or empty text has none.  Base spans of different kinds may overlap,
    added ones overlap nothing.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("base", span),
                           T.StructField("added", span)])
    arrow = to_arrow_schema(schema)

    def fn(batch, texts, found):
        named = [[[dict(zip(("kind", "start", "end"), s)) for s in part] for part in pair] for pair in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array([x[i] for x in named], type=arrow.field(i + 1).type) for i in (0, 1)]],
            schema=arrow)

    return source.mapInArrow(_batches(field, docs.sparkSession.sparkContext, fn), schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by ``<KIND>``; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, field: SkipChainField | None, text_col: str = "text",
             length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data masked; ``length_col``, if given, gets the new length. Null texts stay null."""
    source = docs.withColumn("__p_text", F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields])
    arrow = to_arrow_schema(schema)
    names = docs.columns

    def fn(batch, texts, found):
        new = [t if t is None or not (b or a) else masked(t, b + a) for t, (b, a) in zip(texts, found)]
        columns = list(batch.columns[:-1])
        columns[names.index(text_col)] = pa.array(new, pa.string())
        if length_col in names:
            old = columns[names.index(length_col)].to_pylist()
            columns[names.index(length_col)] = pa.array(
                [len(n) if n is not None and n != t else o for n, t, o in zip(new, texts, old)])
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return source.mapInArrow(_batches(field, docs.sparkSession.sparkContext, fn), schema)


def pii_digest(docs: DataFrame, field: SkipChainField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base spans, their digest, all spans as text, and how many they are and the field added."""
    out = find_pii(docs, field, id_col, text_col)
    order = F.create_map(*[x for i, k in enumerate(LABELS[1:]) for x in (F.lit(k), F.lit(i))])

    def line(spans):
        ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), order[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(id_col, *map(count, KINDS), F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      line(F.concat("base", "added")).alias("spans"),
                      F.size(F.concat("base", "added")).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"))
