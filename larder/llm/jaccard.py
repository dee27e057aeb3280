"""N-gram Jaccard self-join by token-combination prefixes.

A document is its set of word shingles.  All sets share one order of the
tokens: rare ones first (by hash), frequent ones last (by frequency).  Let
``t`` be the similarity, ``p(n) = n - ceil(t n) + 1`` and ``P`` the largest
``p`` of a set that can be linked.  Two linked sets share their first ``c``
common tokens within the first ``p + c - 1`` of both.

* If these are all rare, the pair shares ``c`` rare tokens of these prefixes:
  rare prefix tokens are indexed one by one, and pairs with ``c`` of them are candidates.
* Else a frequent token lies in that prefix of both.  The prefix is extended to
  ``p + q - 1`` tokens with ``q = p + P + c - 1``, within which both share ``q``, fewer than ``c``
  of them rare.  At most ``p - 1`` other tokens lie between the frequent ones in either set, so two
  of them are neighbours in both: frequent tokens are indexed as pairs of neighbours.

A token is rare if at most ``POSTING`` sets have it in their prefix; tokens that
turn out to have more become frequent and the prefixes are taken anew, so a
rare token never makes more than a bounded number of pairs.  Any list of
frequent tokens gives the same result.  Pairs of frequent tokens may be shared by any number of
sets; they are linked by stars around the first set, one row per key and set.

Candidates form blocks (components), and inside a block every pair is verified
exactly.  A block beyond the size of a task is cut into tiles; every pair of
tiles is verified in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import discard, map_bytes, release, staged
from larder.llm.components import connected_components

FREQUENT = 1 << 20        # frequent tokens at the start, the most frequent ones, broadcast as 16 MB at most
LEAST_COUNT = 6           # tokens counted less often start as rare
WINDOW = 3_000_000        # tokens counted at a time in a task
KEY_WINDOW = 1_000_000    # index rows combined at a time in a task
POSTING = 48              # sets that share a rare prefix token
PASSES = 2                # times that the prefixes are taken; tokens still above POSTING are linked by stars
SHARED = 4                # rare tokens that make a candidate (fewer for small sets)
TILE_ROWS, TILE_BYTES = 2048, 24 << 20
BLOOM_BITS = 1 << 26      # of a filter: 8 MB, whatever the data
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLOOM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


class WordHashes:
    """64-bit hashes of words, remembered in the worker up to a bound."""

    def __init__(self, bound: int = 150_000):
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.bound:
            self.known = {}
        known = self.known
        known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter document is one shingle."""
    n = min(size, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _M1 + hashes[i:len(hashes) - n + 1 + i]
    return np.unique(_mix(out))


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with a linked one: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int) -> tuple[int, int, int]:
    """(p, P, c) of a set of n tokens."""
    p = n - needed(n, percent) + 1
    largest = n * 100 // percent
    widest = largest - needed(largest, percent) + 1
    return p, widest, max(1, min(SHARED, needed(n, percent) - p - widest + 1))


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> tuple:
    """(rare prefix tokens, keys of neighbouring frequent tokens); ``frequent`` is sorted, ``rank`` orders it."""
    n = len(tokens)
    p, widest, c = prefix(n, percent)
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        common = frequent[at] == tokens
    else:
        common = np.zeros(n, dtype=bool)
    rare = tokens[~common]
    if len(rare) >= p + c - 1:
        return rare[:p + c - 1], rare[:0]
    place = at[common] if len(frequent) else np.zeros(0, np.int64)
    length = 2 * p + widest + c - 2                     # p + q - 1
    tail = tokens[common][np.argsort(rank[place])][:length - len(rare)]
    return rare, _mix(tail[:-1] * _M1 + tail[1:])


def linked_labels(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest node that it reaches by links of similarity percent / 100 or more."""
    g = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(g), size)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    owner, start = owner[order], np.concatenate([[0], np.cumsum(df)])[:-1]
    shared = np.zeros(g * g, np.int32)
    dense = max(2, g // 7)
    for d in np.unique(df[(df > 1) & (df <= dense)]).tolist():
        first = start[df == d]
        a, b = np.triu_indices(d, 1)
        step = max(1, 2_000_000 // len(a))
        for i in range(0, len(first), step):
            members = owner[first[i:i + step, None] + np.arange(d)]
            hit, times = np.unique(members[:, a].ravel() * g + members[:, b].ravel(), return_counts=True)
            shared[hit] += times.astype(np.int32)
    shared = shared.reshape(g, g)
    high = np.flatnonzero(df > dense)
    for i in range(0, len(high), 2048):
        part = high[i:i + 2048]
        m = np.zeros((g, len(part)), np.float32)
        for j, t in enumerate(part.tolist()):
            m[owner[start[t]:start[t] + df[t]], j] = 1
        shared += (m @ m.T).astype(np.int32)
    link = np.zeros((g, g), dtype=bool)
    for i in range(0, g, 512):                             # the counts above the diagonal are whole
        part = shared[i:i + 512].astype(np.int64)
        link[i:i + 512] = np.triu((100 + percent) * part >= percent * (size[i:i + 512, None] + size[None, :]), i + 1) \
            & (part > 0)
    link |= link.T
    label = np.full(g, -1)
    for i in np.argsort(nodes, kind="stable").tolist():
        if label[i] < 0:
            label[i] = i
            todo = [i]
            while todo:
                new = np.flatnonzero(link[todo].any(axis=0) & (label < 0))
                label[new] = i
                todo = new.tolist()
    return nodes[label]


def _sets(docs: DataFrame, text_col: str, keep: list[str], shingle: int, percent: int) -> DataFrame:
    """``keep, j_uid`` and the set of each row; ``j_set`` is null where an earlier row of the partition has the same."""
    fields = [T.StructField("j_n", T.LongType()), T.StructField("j_node", T.LongType()),
              T.StructField("j_set", T.BinaryType())]
    hashes = WordHashes()
    seen: set[int] = set()

    def run(texts: list) -> dict:
        words = [(x or b"").lower().split() for x in texts]
        flat = hashes([w for x in words for w in x])
        ends = np.cumsum([len(x) for x in words])
        out = {"j_n": [], "j_node": [], "j_set": []}
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            tokens = shingle_set(flat[a:b], shingle)
            raw = tokens.tobytes()
            # the low two bits of a node's name tell the c of its set
            node = int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True) & ~3 \
                | prefix(len(tokens), percent)[2] - 1 if raw else None
            out["j_n"].append(len(tokens))
            out["j_node"].append(node)
            out["j_set"].append(None if node in seen or not raw else raw)
            seen.add(node)
        return out

    return map_bytes(docs.withColumn("j_uid", F.monotonically_increasing_id()), text_col, run, fields,
                     [*keep, "j_uid"])


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens (sorted) and their order, least frequent first.

    Every task counts all its documents window by window and passes on tokens
    seen twice or more in a window.  Any list gives right results; a better one
    gives fewer candidates.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(n[some])],
                                              names=["token", "n"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.uint64))
                size += len(held[-1])
                if size >= WINDOW:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counts = staged(sets.where("j_n > 1").select("j_set").mapInArrow(count, "token long, n long")
                    .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "token-counts")
    bands = counts.groupBy(F.floor(F.log2("n") * 16).alias("band")).agg(F.count(F.lit(1)).alias("k")) \
        .orderBy(F.desc("band")).collect()                       # at most 16 rows per doubling of the count
    total, lowest = 0, None
    for band, k in bands:
        if total + k > FREQUENT:
            break
        total, lowest = total + k, band
    if lowest is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.floor(F.log2("n") * 16) >= lowest).toPandas()   # at most FREQUENT rows
    token, n = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(token)
    token, n = token[order], n[order]
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    return token, rank


def _with_frequent(frequent: tuple, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens with ``more`` of them, which come first in their order."""
    token, rank = frequent
    joined = np.concatenate([token, more])
    rank = np.concatenate([rank + len(more), np.argsort(np.lexsort((more, counts)))])
    order = np.argsort(joined)
    return joined[order], rank[order]


PAIR, SINGLE, STAR = 0, 1, 2          # a key of two frequent tokens, a key of one rare token, a link already found


def _keys(sets: DataFrame, frequent: tuple, percent: int) -> DataFrame:
    """``code, kind, node, other`` rows of the index.

    Rows of a key of two tokens are combined before they are shuffled: of the
    sets of a window that share it, all but the first are linked to the first at
    once (``STAR`` rows, dealt by their node), and only the first goes on.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequent)
    names = ["code", "kind", "node", "other"]

    def flush(code: np.ndarray, kind: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((node, code, kind))
        code, kind, node = code[order], kind[order], node[order]
        same = np.concatenate([[False], (code[1:] == code[:-1]) & (kind[1:] == kind[:-1])])
        twice = same & np.concatenate([[False], node[1:] == node[:-1]])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(code))))
        star = same & ~twice & (kind == PAIR)
        rest = ~star & ~twice
        yield pa.RecordBatch.from_arrays(
            [pa.array(code[rest]), pa.array(kind[rest]), pa.array(node[rest]), pa.nulls(int(rest.sum()), pa.int64())], names=names)
        if star.any():
            spread = _mix(node[star].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(np.full(len(spread), STAR, np.int32)), pa.array(node[star]), pa.array(node[head[star]])],
                names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, rank = shared.value
        held: list[tuple] = []
        size = 0
        for batch in batches:
            found = [x for raw in batch.column(1).to_pylist()
                     for x in prefix_keys(np.frombuffer(raw, np.uint64), token, rank, percent)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            node = np.repeat(np.asarray(batch.column(0), dtype=np.int64), 2)
            kind = np.tile(np.array([SINGLE, PAIR], np.int32), len(node) // 2)
            held.append((np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64),
                         np.repeat(kind, sizes), np.repeat(node, sizes)))
            size += len(held[-1][0])
            if size >= KEY_WINDOW:
                yield from flush(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield from flush(*map(np.concatenate, zip(*held)))

    return sets.where("j_n > 1").select("j_node", "j_set") \
        .mapInArrow(run, "code long, kind int, node long, other long")


def _run_links(code: np.ndarray, kind: np.ndarray, node: np.ndarray, start: np.ndarray) -> list[tuple]:
    """(u, v, n, kind) rows of whole runs of equal keys; nodes of a run are sorted and differ."""
    n = np.diff(np.concatenate([start, [len(code)]]))
    out = []
    few = (kind[start] == SINGLE) & (n <= POSTING)
    for d in np.unique(n[few & (n > 1)]).tolist():
        members = node[start[few & (n == d)][:, None] + np.arange(d)]
        a, b = np.triu_indices(d, 1)
        out.append((members[:, b].ravel(), members[:, a].ravel(), None, PAIR))
    many = ~few & (n > 1)
    if many.any():
        first, size = start[many], n[many] - 1
        at = np.repeat(first, size) + 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out.append((node[at], node[np.repeat(first, size)], None, STAR))
        hot = many & (kind[start] == SINGLE)
        if hot.any():
            out.append((code[start[hot]], code[start[hot]], n[hot], SINGLE))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the keys of a partition sorted by kind, code and node.

    ``PAIR`` rows are two sets that share a rare token, ``STAR`` rows link a set to the first one
    of its key, ``SINGLE`` rows name a token of more than ``POSTING`` sets and their number.  An open run is held
    until it ends, beyond ``POSTING`` sets only its first and last node and its size.
    """
    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for u, v, n, kind in found:
            for i in range(0, len(u), 100_000):
                part = slice(i, i + 100_000)
                k = len(u[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u[part]), pa.array(v[part]), pa.nulls(k, pa.int64()) if n is None else pa.array(n[part]),
                     pa.array(np.full(k, kind, np.int32))], names=["u", "v", "n", "kind"])

    none = np.zeros(0, np.int64)
    held = (none, none.astype(np.int32), none)           # rows of the open run
    gone, first = 0, 0                                    # rows of it that were linked already, and its first node
    for batch in batches:
        code, kind, node = (np.asarray(batch.column(i)) for i in range(3))
        star = kind == STAR
        if star.any():
            yield from rows([(node[star], np.asarray(batch.column(3).drop_null(), dtype=np.int64), None, STAR)])
            code, kind, node = code[~star], kind[~star], node[~star]
        code, kind, node = (np.concatenate([h, x]) for h, x in zip(held, (code, kind, node)))
        if not len(code):
            continue
        same = np.concatenate([[False], (code[1:] == code[:-1]) & (kind[1:] == kind[:-1])])
        keep = ~(same & np.concatenate([[False], node[1:] == node[:-1]]))
        code, kind, node, same = code[keep], kind[keep], node[keep], same[keep]
        start = np.flatnonzero(~same)
        if gone and len(start) > 1:                       # the long run ends here
            yield from _close(code, kind, node, start[1], gone, first, rows)
            code, kind, node, start = code[start[1]:], kind[start[1]:], node[start[1]:], start[1:] - start[1]
            gone = 0
        last = start[-1]
        if last:
            yield from rows(_run_links(code[:last], kind[:last], node[:last], start[:-1]))
            code, kind, node = code[last:], kind[last:], node[last:]
        if len(code) > POSTING + 1:                       # too long to hold: link all but the last node
            if not gone:
                first = node[0]
            move = node[:-1] if gone else node[1:-1]
            yield from rows([(move, np.full(len(move), first), None, STAR)])
            gone += len(node) - 1
            code, kind, node = code[-1:], kind[-1:], node[-1:]
        held = (code, kind, node)
    code, kind, node = held
    if gone:
        yield from _close(code, kind, node, len(code), gone, first, rows)
    elif len(code):
        yield from rows(_run_links(code, kind, node, np.zeros(1, np.int64)))


def _close(code, kind, node, end: int, gone: int, first: int, rows) -> Iterator[pa.RecordBatch]:
    """The rest of a run whose beginning was linked already."""
    found = [(node[:end], np.full(end, first), None, STAR)]
    if kind[0] == SINGLE:
        found.append((code[:1], code[:1], np.array([gone + end]), SINGLE))
    yield from rows(found)


def _blocks(sets: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the candidate blocks: components that hold every pair of linked sets."""
    frequent = _frequent(sets)
    for i in range(PASSES):
        found = staged(_keys(sets, frequent, percent).repartition("code", "kind").sortWithinPartitions("kind", "code", "node")
                       .mapInArrow(_runs, "u long, v long, n long, kind int"), f"candidates-{i}")
        release(sets.sparkSession)
        crowded = found.where(F.col("kind") == SINGLE)
        if i == PASSES - 1 or not 0 < crowded.count() <= FREQUENT:
            break
        rows = crowded.select("u", "n").toPandas()                       # at most FREQUENT rows
        frequent = _with_frequent(frequent, rows["u"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))
        discard(found)
    need = F.least(F.col("u").bitwiseAND(F.lit(3)), F.col("v").bitwiseAND(F.lit(3))) + 1
    pairs = found.where(F.col("kind") == PAIR).groupBy("u", "v").count().where(F.col("count") >= need).select("u", "v")
    stars = found.where((F.col("kind") == STAR) & (F.col("u") != F.col("v"))).select("u", "v").distinct()
    blocks = connected_components(pairs.unionByName(stars))
    discard(found)
    release(sets.sparkSession)
    return blocks


def _bloom_places(uid: np.ndarray, bits: int) -> np.ndarray:
    """Three of ``bits`` places (a power of two) for each number (rows x 3)."""
    x = uid.astype(np.uint64)[:, None] * _BLOOM[None, :]
    return (_mix(x) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _filtered(sets: DataFrame, wanted: DataFrame, size: int = BLOOM_BITS) -> DataFrame:
    """``uid, set`` of the rows that are perhaps in ``wanted``: all that are, and few others."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _bloom_places(np.asarray(batch.column(0), dtype=np.int64), size).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = bits.view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], names=["word", "bits"])

    marks = wanted.select("uid").mapInArrow(mark, "word long, bits long").groupBy("word") \
        .agg(F.bit_or("bits").alias("bits")).toPandas()                  # at most size / 64 rows
    words = np.zeros(size // 64, np.int64)
    words[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint8)
        for batch in batches:
            at = _bloom_places(np.asarray(batch.column(0), dtype=np.int64), size)
            yield batch.filter(pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)))

    return sets.where("j_set IS NOT NULL").select(F.col("j_uid").alias("uid"), F.col("j_set").alias("set")) \
        .mapInArrow(keep, "uid long, set binary")


def _verified(blocks: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of linked documents; ``blocks`` has ``node, component`` of candidate blocks.

    Tiles are laid out from the sizes alone; then one row of each set of a block
    is fetched by its number.  A Bloom filter of those numbers (``BLOOM_BITS`` bits at any
    size; a full one lets everything pass) spares the shuffle the sets that are in no block.
    """
    rows = info.where("j_n > 0").join(blocks, F.col("j_node") == F.col("node")) \
        .groupBy("node", F.col("component").alias("block")).agg(F.min("j_uid").alias("uid"), F.min("j_n").alias("n"))
    rows = staged(rows, "block-rows")
    tiles = rows.groupBy("block").agg(F.count(F.lit(1)).alias("k"), (F.sum("n") * 8).alias("bytes")) \
        .where("k > 1").select("block", F.greatest(F.ceil(F.col("k") / (TILE_ROWS // 2)),
                                                   F.ceil(F.col("bytes") / (TILE_BYTES // 2))).alias("n_tiles")) \
        .withColumn("n_tiles", F.when(F.col("n_tiles") <= 2, F.lit(1)).otherwise(F.col("n_tiles")))
    wanted = staged(rows.join(tiles, "block").select("uid", "node", "block", "n_tiles"), "block-tiles")
    rows = _filtered(sets, wanted).join(wanted.hint("merge"), "uid") \
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))) \
        .select("block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "n_tiles",
                "node", "set")

    def verify(group: pa.Table) -> pa.Table:
        nodes = np.asarray(group.column("node"), dtype=np.int64)
        label = linked_labels(nodes, [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()], percent)
        return pa.table({"u": pa.array(nodes), "v": pa.array(label), "tiled": group.column("n_tiles")})

    stars = staged(rows.groupBy("block", "i", "j").applyInArrow(verify, "u long, v long, tiled long")
                   .where("u <> v"), "links")
    done = stars.where("tiled = 1").select(F.col("u").alias("node"), F.col("v").alias("component"))
    tiled = connected_components(stars.where("tiled > 1").select("u", "v"))
    return done.unionByName(tiled)


def located(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the place of each row in its files, and the names of the two columns that tell it.

    Rows that are no plain reading of files are written first.
    """
    names = ["__file", "__row"]

    def place(df: DataFrame) -> DataFrame:
        return df.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))
    try:
        return place(docs), names
    except AnalysisException:
        return place(staged(docs, "documents")), names


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 percent: int = 90, keep: list[str] | None = None) -> DataFrame:
    """``keep`` plus ``j_n, j_component, j_first`` for every row.

    ``j_n`` is the size of the row's set of lower-cased (A-Z) word shingles;
    with fewer words than a shingle the whole sequence is one, without words
    (or with null text) the set is empty and linked with nothing.  Rows are
    linked if 100 * intersection >= percent * union, equal sets always.
    ``j_component`` is the smallest id reachable by links (nulls ignored), and
    ``j_first`` marks one row of each component: the smallest id's first row.
    Sets are taken as equal by a 62-bit name, tokens by 64 bits.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must lie between 70 and 100: below, the extended prefix exceeds a set")
    keep = keep or [id_col]
    more = [c for c in keep if c != id_col]
    source, place = located(docs) if more else (docs, [])
    # every row's set is computed and written once, nowhere shuffled as a whole
    sets = staged(_sets(source, text_col, [id_col, *place], shingle, percent), "shingles")
    info = staged(sets.drop("j_set"), "rows")
    links = _verified(_blocks(sets.where("j_set IS NOT NULL"), percent), info, sets, percent)
    first = F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("j_uid").alias("uid"))
    nodes = info.where("j_n > 0").groupBy("j_node").agg(F.min(first).alias("first")) \
        .join(links.select(F.col("node").alias("j_node"), "component"), "j_node", "left") \
        .withColumn("component", F.coalesce("component", "j_node"))
    nodes = staged(nodes, "nodes")
    discard(sets)
    release(docs.sparkSession)
    names = nodes.groupBy("component").agg(F.min("first").alias("head"))
    label = nodes.join(names, "component").select(F.col("j_node").alias("__node"), F.col("head").alias("j_head"))
    out = info.join(staged(label, "labels"), F.col("j_node") == F.col("__node"), "left")
    out = out.select(id_col, *place, "j_n", F.when(F.col("j_head").isNull(), F.col(id_col))
                     .otherwise(F.col("j_head.id")).alias("j_component"),
                     F.coalesce(F.col("j_head.uid") == F.col("j_uid"), F.lit(True)).alias("j_first"))
    if not more:
        return out.select(*keep, "j_n", "j_component", "j_first")
    # the columns to keep come under names of their own, whatever they are called
    kept = source.select(*place, *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])
    out = kept.join(out.drop(id_col), place).select(*[f"__keep{i}" for i in range(len(keep))], "j_n", "j_component", "j_first")
    return out.toDF(*keep, "j_n", "j_component", "j_first")
