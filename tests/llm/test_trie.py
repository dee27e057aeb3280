"""Prefix trie against a plain trie built in a dictionary."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from larder.llm import prefix_trie as P


def plain_nodes(rows, family=5, heads=9):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} of rebuilt conversations."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % family if c >= 0 else -(-c % family))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    for key, who in members.items():
        below = [k for k in members if k[:len(key)] == key]
        ends = sorted(c for c in who if len(built[c]) == len(key))
        out[(min(who), len(key))] = (
            min(members[key[:-1]]) if key else None, len(who), sum(len(k) == len(key) + 1 for k in below),
            sum(not any(len(m) == len(k) + 1 and m[:len(k)] == k for m in members) for k in below),
            sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def spark_nodes(spark, rows, schema="conv_id long, turn long, role string, text string"):
    turns = spark.createDataFrame(rows, schema)
    nodes, ends = P.prefix_trie(*P.rebuild(P.sequence_turns(turns)))
    none = hashlib.sha256(b"").hexdigest()
    found = nodes.join(P.ends_digest(ends), ["node", "depth"], "left").collect()
    keys = [(r["node"], r["depth"]) for r in found]
    assert len(keys) == len(set(keys))
    assert all((r["n_ends"] > 0) == (r["ends_sha256"] is not None) for r in found)
    return {(r["node"], r["depth"]): (r["parent"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_bytes"],
                                      r["ends_sha256"] or none) for r in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-12, 60), 40):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü" * 3, "", None])))
    rng.shuffle(rows)
    assert spark_nodes(spark, rows) == plain_nodes(rows)


def test_small_blocks_and_split_conversations(spark, monkeypatch):
    """Running values carried over blocks of four turns, and end lists over groups of four ids."""
    monkeypatch.setattr(P, "_BITS", 2)
    rng = random.Random(3)
    rows = [(5, t, "user", rng.choice("xyz")) for t in range(130)]
    rows += [(c, t, "user", x[3]) for c in (6, 7, 8, 9, 11) for t, x in enumerate(rows[:rng.randint(3, 130)])]
    assert spark_nodes(spark, rows) == plain_nodes(rows)


def test_copies_collapse_and_ends_come_in_order(spark):
    rows = [(c, t, "user", "same") for c in range(0, 1500, 5) for t in range(2)]
    assert spark_nodes(spark, rows) == plain_nodes(rows)


def test_nulls_ties_repeated_rows_and_role_text_border(spark):
    rows = [(0, None, "user", "first"), (0, 1, "b", "x"), (0, 1, "a", "x"), (0, 1, "a", "x"), (None, 0, "user", "lost"),
            (5, 0, "ab", "c"), (10, 0, "a", "bc"), (15, 0, None, None), (20, 0, "", "")]
    assert spark_nodes(spark, rows) == plain_nodes(rows)


def test_turnless_conversation_counts_at_the_root(spark):
    # none of its own turns is left and the first one of its family is absent
    gone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(gone, 0, "user", "x")]
    assert spark_nodes(spark, rows) == plain_nodes(rows)
    assert list(spark_nodes(spark, rows)) == [(gone, 0)]


def test_empty_table_and_very_long_text(spark):
    assert spark_nodes(spark, []) == {}
    long = "ä" * 400_000
    rows = [(0, 0, "user", long), (5, 0, "user", long), (10, 0, "user", long + "x")]
    assert spark_nodes(spark, rows) == plain_nodes(rows)


def test_extra_columns_with_clashing_names(spark):
    rows = [(0, 0, "user", "x", 1, 2, 3, 4), (5, 0, "user", "x", 1, 2, 3, 4)]
    found = spark_nodes(spark, rows, "conv_id long, turn long, role string, text string, id int, pos int, depth int, node int")
    assert found == plain_nodes([r[:4] for r in rows])


def test_query_over_a_folder(spark, tmp_path):
    from larder.llm.queries import QUERIES
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("abc")) for c in range(30) for t in range(rng.randint(1, 10))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {tuple(r)[:2]: tuple(r)[2:] for r in got.collect()} == plain_nodes(rows)


def test_hot_first_turn_is_aggregated_before_it_is_shuffled(spark):
    """The node aggregate has a partial step, and no join is a product."""
    rows = [(c, t, "user", "hello" if t == 0 else str(c)) for c in range(0, 300, 5) for t in range(2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, _ = P.prefix_trie(*P.rebuild(P.sequence_turns(turns)))
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert nodes.where("depth = 1").select("n_convs").collect()[0][0] == nodes.select(F.max("n_convs")).first()[0]
