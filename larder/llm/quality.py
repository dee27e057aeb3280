"""Quality rules with risk-controlled thresholds.

Each document gets a few scores (symbols per word, upper-case share, ...).  A
rule rejects a document whose score lies above a cutoff.  Cutoffs come from a
fixed grid: for every stratum and rule, the labelled good documents of the
holdout are tested from the most lenient cutoff to the strictest with an exact
binomial test of "false rejection rate >= alpha / rules" and the walk ends at
the first cutoff that is not certified (fixed-sequence testing, so the grid
needs no further correction).  The level of each walk is ``delta`` divided by
the number of walks (Bonferroni over strata and rules).  With probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents.
Among the certified cutoffs the one with the best balance of rejected bad and
rejected good labelled documents is taken; without a certified cutoff, or
without any bad document it would catch, a rule rejects nothing in a stratum.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import map_bytes, small, staged

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))

# The grid of each rule, lenient to strict, fixed before any label is seen.
CUTOFFS = {
    "symbol_rate": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "upper_rate": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "bang_rate": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_rate": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
}
RULES = list(CUTOFFS)
NO_STRATUM = "\x00none"

STATS = [T.StructField(n, T.LongType()) for n in
         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
          "n_letters", "n_bangs")]


def text_stats(text: bytes | None) -> tuple:
    """The counts of ``STATS`` for one text; null counts as empty.

    Lines are split at LF; only lines that hold a word count.  A word counts as
    repeated if any 3-word window over it occurs twice or more in the text.
    """
    text = text or b""
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACES)))
    lines = text.split(b"\n")
    wordy = [x for x in lines if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered[i] = covered[i + 1] = covered[i + 2] = 1
        repeated = sum(covered)
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(wordy) - len(set(wordy)),
            repeated, len(wordy), len(text) - len(text.translate(None, UPPER)),
            len(text) - len(text.translate(None, LETTERS)), text.count(b"!"))


def document_stats(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` plus the columns of ``STATS`` (prefixed ``q_``), one row per document."""
    fields = [T.StructField(f"q_{f.name}", f.dataType) for f in STATS]

    def run(texts: list) -> dict:
        rows = [text_stats(x) for x in texts]
        return {f.name: [r[i] for r in rows] for i, f in enumerate(fields)}

    return map_bytes(docs, text_col, run, fields, keep)


def _ratio(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


SCORES = {
    "symbol_rate": lambda: _ratio("q_n_symbols", "q_n_words"),
    "upper_rate": lambda: _ratio("q_n_upper", "q_n_letters"),
    "bang_rate": lambda: _ratio("q_n_bangs", "q_n_words"),
    "dup_line_rate": lambda: _ratio("q_n_dup_lines", "q_n_lines"),
    "repeat_rate": lambda: _ratio("q_n_repeat_words", "q_n_words"),
}


def base_failed():
    """The fixed base rule: under 50 words, or over half of the words repeated."""
    return (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term."""
    if k >= n:
        return 1.0
    total = 0.0
    for i in range(k + 1):
        total += exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p))
    return min(1.0, total)


def choose_cutoffs(counts: dict, strata: list[str], alpha: float, delta: float) -> dict:
    """(stratum, rule) -> certified cutoff or None.

    ``counts[(stratum, rule)]`` is a pair of lists over ``level`` 0..len(grid):
    good and bad labelled documents whose score exceeds exactly the last
    ``level`` cutoffs of the grid (so level ``len(grid)`` exceeds all).
    """
    level_of = delta / max(1, len(strata) * len(RULES))
    chosen = {}
    for s in strata:
        for rule in RULES:
            grid = CUTOFFS[rule]
            good, bad = counts.get((s, rule), ([0] * (len(grid) + 1), [0] * (len(grid) + 1)))
            n, m = sum(good), sum(bad)
            certified = []
            for i, cut in enumerate(grid):
                k, b = sum(good[len(grid) - i:]), sum(bad[len(grid) - i:])
                if n == 0 or binomial_cdf(k, n, alpha / len(RULES)) > level_of:
                    break
                certified.append((b / m - 5 * k / n if m else 0.0, cut))
            best = max((g for g, _ in certified), default=0.0)
            ties = [c for g, c in certified if g == best]
            chosen[s, rule] = ties[len(ties) // 2] if best > 0 else None
    return chosen


def fit_cutoffs(stats: DataFrame, labels: DataFrame, id_col: str, alpha: float, delta: float) -> dict:
    """Certified cutoffs per stratum from all labelled documents that pass the base rule."""
    truth = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__good"))
    levels = F.array(*[F.struct(F.lit(r).alias("rule"),
                                sum((F.col(f"__s_{r}") > c).cast("int") for c in CUTOFFS[r]).alias("level"))
                       for r in RULES])
    rows = (stats.where(~base_failed()).withColumns({f"__s_{r}": f() for r, f in SCORES.items()})
            .join(truth, F.col(id_col) == F.col("__id"))
            .select("q_stratum", "__good", F.explode(levels).alias("x"))
            .groupBy("q_stratum", "__good", "x.rule", "x.level").count().collect())   # strata x rules x grid rows
    counts: dict = {}
    for s, g, rule, level, n in rows:
        pair = counts.setdefault((s, rule), tuple([0] * (len(CUTOFFS[rule]) + 1) for _ in range(2)))
        pair[0 if g == 1 else 1][level] += n
    return choose_cutoffs(counts, sorted({s for s, _ in counts}), alpha, delta)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", keep: list[str] | None = None, alpha: float = 0.05,
                  delta: float = 0.05) -> DataFrame:
    """``keep`` plus ``q_*`` counts, ``q_base_failed`` and ``q_kept`` for every document.

    ``labels`` has ``id_col`` and ``quality`` (1 good, 0 bad; null ignored; the
    lowest of several labels of a document holds).  A null stratum is a stratum
    of its own.  A null or empty text has no words, so the base rule rejects
    it.  Without labels, only the base rule rejects.  Rows with equal ids are
    judged each by its own text.
    """
    keep = keep or [id_col]
    source = docs.withColumn("q_stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit(NO_STRATUM)))
    stats = staged(document_stats(source, text_col, [id_col, "q_stratum"]), "quality")
    cutoffs = fit_cutoffs(stats, labels, id_col, alpha, delta)
    if keep != [id_col]:                       # counted again rather than written with the texts
        stats = document_stats(source, text_col, list(dict.fromkeys([*keep, "q_stratum"])))
    strata = sorted({s for s, _ in cutoffs})
    spark = docs.sparkSession
    limits = spark.createDataFrame([(s, *[cutoffs[s, r] for r in RULES]) for s in strata],
                                   "q_stratum string, " + ", ".join(f"__c_{r} double" for r in RULES))
    rejected = F.lit(False)
    for r, score in SCORES.items():
        rejected = rejected | F.coalesce(score() > F.col(f"__c_{r}"), F.lit(False))
    out = stats.join(small(limits), "q_stratum", "left").withColumn("q_base_failed", base_failed()) \
        .withColumn("q_kept", ~F.col("q_base_failed") & ~rejected)
    return out.select(*keep, *[f"q_{f.name}" for f in STATS], "q_stratum", "q_base_failed", "q_kept")
