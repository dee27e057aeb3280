import pytest

EXTRA = ["id", "label", "count", "h", "n", "size", "node", "component", "length", "offset", "sequence_id", "q_kept",
         "m_copies", "j_first", "j_set", "head", "part", "kind"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns of names that operators use inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", *range(len(EXTRA)))
                for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, "
                                     + ", ".join(f"{c} int" for c in EXTRA))
    return make


@pytest.fixture(scope="session")
def words():
    import random
    rng = random.Random(5)
    bank = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]

    def text(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(bank) for _ in range(n))
    return text
