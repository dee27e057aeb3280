"""Prefix trie of conversations by collapsing whole sequences.

A turn is known by the first 128 bits of SHA-256 over its length-framed role and text; a sequence of turns by
the exclusive or of 120 hashed bits of each (place, turn), so prefixes are running
exclusive ors that any number of tasks can take in blocks, and a whole conversation
is one aggregate.  Two sequences of one length count as equal if these 120 bits are.

Identical conversations collapse into one weighted sequence; only one of them
goes on, with its weight.  Sequences that are a proper prefix of another drop out by an
anti join, the others are the leaves.  The prefixes of the weighted sequences,
aggregated by their bits, are the trie's nodes: members are a sum of weights, leaves a
sum of leaf sequences.  What a subtree saves is a difference of two sums over the
sequences through its top: each sequence's remaining bytes times its weight, less the bytes of its
remaining nodes, where every node is left to the sequence with the smallest id
(a sequence owns its nodes from some depth on, so these are one suffix of it).

Turns get their places from a range partitioning, running values are taken in
blocks of ``BLOCK`` turns, and end lists in groups of ``BLOCK`` ids: no
conversation, prefix or group of copies has to fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import staged

BLOCK = 4096              # turns of a conversation, or ids of an end list, that are handled together
_BITS = 12                # log2(BLOCK)
KEY = ["depth", "p1", "p2"]


def _framed(role: Column, text: Column) -> Column:
    """One byte string for each (role, text): the role's length in bytes tells where it ends."""
    return F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")


def sequence_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """``id, pos, turn_id, n_bytes``: every turn's place in its conversation (from 0), identity and text bytes.

    Rows are ordered by turn (null first), then role and text; a null role or
    text counts as empty, repeated rows stay.  Rows with a null id belong to no conversation and are left out.
    """
    spark = turns.sparkSession
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "id", F.monotonically_increasing_id().alias("row"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.substring(F.sha2(_framed(F.col("role"), F.col("text")), 256), 1, 32).alias("turn_id"))
    # written once: the row numbers stay, whatever runs again
    placed = staged(placed, "turns").withColumn("part", F.shiftright("row", 33))
    parts = placed.groupBy("id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(parts, ["id", "part"]) \
        .select("id", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "turn_id", "n_bytes")


def rebuild(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of rebuilt conversations: each takes its first h turns from its family's first conversation.

    ``turns`` is what ``sequence_turns`` gives, with integer ids.  Conversation c keeps its own turns
    from the h-th on, h = crc32(c as text) modulo ``heads``; before them come the first h turns of
    conversation c - c % ``family`` (all it has, if fewer; none, if it is absent).  The ids
    include conversations that are left without a turn.
    """
    sizes = staged(turns.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "conversation-sizes")
    base = F.col("id") - F.col("id") % family
    head = (F.crc32(F.col("id").cast("string").cast("binary")) % heads).cast("long")
    families = sizes.select("id", base.alias("base"), head.alias("h")) \
        .join(sizes.select(F.col("id").alias("base"), F.col("n").alias("base_n")), "base", "left") \
        .select("id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    first = turns.where((F.col("pos") < heads - 1) & (F.col("id") % family == 0)) \
        .withColumnRenamed("id", "base").join(families.where("taken > 0"), "base").where("pos < taken") \
        .select("id", "pos", "turn_id", "n_bytes")
    # a conversation of any length meets its one row of ``families`` block by block
    own = families.join(sizes, "id") \
        .select("id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("n", _BITS))).alias("block"))
    rest = turns.withColumn("block", F.shiftright("pos", _BITS)).join(own, ["id", "block"]).where("pos >= h") \
        .select("id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "n_bytes")
    return staged(first.unionByName(rest), "rebuilt-turns"), sizes.select("id")


def _hashed(part: int) -> Column:
    """60 bits of SHA-256 over place and turn."""
    digest = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("turn_id")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 + 15 * part, 15), 16, 10).cast("long")


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie over conversations ``id, pos, turn_id, n_bytes`` (see ``sequence_turns``).

    ``nodes``: ``node, depth, parent, n_convs, n_children, n_leaves, n_ends, saved_bytes, turn_id``; a node is named by
    its smallest member and its depth, the root (depth 0, parent null) included.  ``saved_bytes``
    sums (n_convs - 1) times the bytes of the last text over the node's subtree.  ``ends``:
    ``node, depth, part, ids``, the ids of conversations that end at a node, in sorted lists of up to
    ``BLOCK`` neighbouring ids; ``part`` orders a node's lists.  ``ids`` names all
    conversations, also those without turns; without any conversation both are empty.
    Ids are integers.
    """
    turns = turns.select("id", "pos", "turn_id", "n_bytes", F.shiftright("pos", _BITS).alias("block"),
                         _hashed(0).alias("e1"), _hashed(1).alias("e2"))
    blocks = staged(turns.groupBy("id", "block").agg(
        F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"), F.sum("n_bytes").alias("bytes"),
        F.count(F.lit(1)).alias("n")), "trie-blocks")
    whole = blocks.select("id", "b1", "b2", "bytes", "n")
    if ids is not None:
        zero = [F.lit(0).cast("long").alias(c) for c in ("b1", "b2", "bytes", "n")]
        whole = whole.unionByName(ids.select("id", *zero))
    whole = staged(whole.groupBy("id").agg(
        F.sum("n").alias("depth"), F.bit_xor("b1").alias("p1"), F.bit_xor("b2").alias("p2"),
        F.sum("bytes").alias("total")), "trie-conversations")

    # whole-sequence collapse: one row for each distinct conversation, with its weight
    sequences = staged(whole.groupBy(*KEY).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"),
                                               F.min("total").alias("total")), "trie-sequences")

    # running values of the sequences that stay, block by block
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(fn, column: str) -> Column:
        return F.coalesce(fn(column).over(before), F.lit(0)).cast("long")

    starts = blocks.join(sequences.select("id", "weight", "total"), "id").select(
        "id", "block", "weight", "total", earlier(F.bit_xor, "b1").alias("s1"), earlier(F.bit_xor, "b2").alias("s2"),
        earlier(F.sum, "bytes").alias("s_bytes"))
    within = Window.partitionBy("id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = turns.join(starts, ["id", "block"]).select(
        "id", "pos", "turn_id", "n_bytes", "weight", "total", "e1", "e2",
        F.bit_xor("e1").over(within).bitwiseXOR(F.col("s1")).alias("p1"),
        F.bit_xor("e2").over(within).bitwiseXOR(F.col("s2")).alias("p2"),
        (F.sum("n_bytes").over(within) + F.col("s_bytes")).alias("upto"))
    prefixes = staged(running.select(
        "id", (F.col("pos") + 1).alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("e1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("e2")).alias("q2"), "turn_id", "weight",
        (F.col("total") - F.col("upto") + F.col("n_bytes")).alias("rest")), "trie-prefixes")
    zero = F.lit(0).cast("long")
    null = F.lit(None).cast("long")
    roots = sequences.select("id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), null.alias("q1"),
                             null.alias("q2"), F.lit(None).cast("string").alias("turn_id"), "weight",
                             F.col("total").alias("rest"))
    prefixes = prefixes.unionByName(roots)

    # leaves: sequences that are no proper prefix of another
    proper = prefixes.where("q1 IS NOT NULL").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"),
                                                     F.col("q2").alias("p2")).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("id", F.lit(1).alias("leaf"))

    nodes = staged(prefixes.groupBy(*KEY).agg(
        F.min("id").alias("node"), F.sum("weight").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
        F.sum(F.col("weight") * F.col("rest")).alias("all_bytes"), F.min_by("rest", "id").alias("owner_rest"),
        F.min("turn_id").alias("turn_id")), "trie-nodes")

    # of its remaining bytes a sequence owns those from its first own node on
    owned = nodes.groupBy(F.col("node").alias("id")).agg(F.max("owner_rest").alias("owned"))
    marks = sequences.select("id", F.col("depth").alias("length")).join(leaves, "id", "left").join(owned, "id", "left") \
        .select("id", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("owned", zero).alias("owned"),
                F.explode(F.sequence(zero, F.shiftright("length", _BITS))).alias("block"))
    marked = prefixes.select("id", *KEY, "rest", F.shiftright("depth", _BITS).alias("block")).join(marks, ["id", "block"])
    own = marked.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.least("rest", "owned")).alias("own_bytes"))
    children = nodes.where("q1 IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"),
                                                     F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    ended = sequences.select(*KEY, F.col("weight").alias("n_ends"))
    full = staged(nodes.join(own, KEY).join(children, KEY, "left").join(ended, KEY, "left").select(
        *KEY, "node", "q1", "q2", "turn_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        F.coalesce("n_ends", zero).alias("n_ends"), (F.col("all_bytes") - F.col("own_bytes")).alias("saved_bytes")),
        "trie-full")

    # a node whose parent has the same smallest member needs no look-up: only a sequence's first own node does
    top = full.groupBy("node").agg(F.min("depth").alias("top"))
    linked = full.join(top, "node")
    root = full.where("depth = 0").select(F.col("node").alias("root"))
    root_id = root.first()
    at_root = F.lit(root_id["root"] if root_id else None).cast("long")
    near = linked.where((F.col("depth") <= 1) | (F.col("depth") > F.col("top"))).withColumn(
        "parent", F.when(F.col("depth") == 1, at_root).when(F.col("depth") > 1, F.col("node")))
    far = linked.where((F.col("depth") > 1) & (F.col("depth") == F.col("top"))).join(
        full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"),
                                            F.col("p2").alias("q2"), F.col("node").alias("parent")),
        ["depth", "q1", "q2"])
    columns = ["node", "depth", "parent", "n_convs", "n_children", "n_leaves", "n_ends", "saved_bytes", "turn_id"]
    result = near.select(*columns).unionByName(far.select(*columns))

    ends = whole.groupBy(*KEY, F.shiftright("id", _BITS).alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids")) \
        .join(full.select(*KEY, "node"), KEY).select("node", "depth", "part", "ids")
    return result, ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256`` from the end lists: SHA-256 of a node's ids, ascending, joined by commas.

    The lists of a node arrive in order and are hashed one after the other, so
    memory holds one of them at a time, however many there are.
    """
    chunks = ends.select("node", "depth", "part", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("t"))
    chunks = chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = ["node", "depth", "ends_sha256"]

        def rows(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()),
                 pa.array([h for _, h in done], pa.string())], names=names)

        for batch in batches:
            done = []
            for node, depth, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         batch.column(3).to_pylist()):
                if (node, depth) != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = (node, depth), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield rows(done)
        if key is not None:
            yield rows([(key, state.hexdigest())])

    return chunks.mapInArrow(run, "node long, depth long, ends_sha256 string")
