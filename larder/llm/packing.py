"""Best-fit packing with certified bin counts.

Documents are tokenised once, cut where they exceed a sequence, and the pieces
are packed best-fit decreasing inside partitions that a round-robin shuffle
keeps equal in size.  Dual-feasible functions give a lower bound on the bins
of each partition.  A partition that meets its bound is certified; the others
hand the pieces of their loose bins to the next round, where they meet the
pieces of other partitions and are packed again.  A round that does not lower
the number of bins is dropped and the packing before it stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.llm.common import staged
from larder.llm.tokens import default_path, encoder

CAPACITY = 2048
PIECES_PER_TASK = 100_000
ROUNDS = 4


def piece_bounds(length: int, capacity: int) -> list[int]:
    """Cut points of a document: only longer ones are cut, the first piece takes the remainder."""
    if length <= capacity:
        return [0, length]
    first = length % capacity or capacity
    return [0, *range(first, length + 1, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``), one row per piece.

    A document is its text's token ids and then id 0; a null or empty text is
    the id 0 alone.  Rows with equal ids are documents of their own.
    """
    path = tokenizer or default_path()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField(id_col, source.schema["id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.zeros(1, dtype="<u4")
        for batch in batches:
            rows, which = [], []
            for i, ids in enumerate(enc.each(["" if t is None else t for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, end)
                at = piece_bounds(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    row = (k, a, b - a, crc32(ids[a:b]))
                    rows.append(row + (ids[a:b].astype(np.int32),) if with_ids else row)
                    which.append(i)
            columns = list(zip(*rows)) or [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64()))]
                + [pa.array(list(c), type=f.type) for c, f in zip(columns, list(arrow)[1:])], schema=arrow)

    return source.mapInArrow(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the free room of each bin.

    Open bins lie in one stack per amount of room; a bit mask over the amounts
    finds the tightest one that fits.  Items of equal length keep their order.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = mask >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - free
        room[b] = free = free - n
        stacks[free].append(b)
        mask |= 1 << free
    return bins, offsets, np.array(room, np.int64)


def bin_lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of the dual-feasible functions u_k after f_lambda, in whole numbers.

    f_lambda counts items longer than capacity - lambda as whole bins, drops
    those shorter than lambda and keeps the rest; u_k rounds (k + 1) x / capacity
    down to multiples of 1 / k, exact multiples keep their value.  k = 0 keeps all.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    longer = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])        # items of at least this length
    cut = np.arange(1, capacity // 2 + 1)
    best = 0
    for k in range(0, 33):
        if k == 0:
            value, whole = sizes, capacity
        else:
            exact = (k + 1) * sizes % capacity == 0
            value = np.where(exact, k * sizes, (k + 1) * sizes // capacity * capacity)
            whole = k * capacity
        total = np.concatenate([[0], np.cumsum(count * value)])          # items shorter than this length
        sums = longer[capacity - cut + 1] * whole + total[capacity - cut + 1] - total[cut]
        best = max(best, int(-(-max(int(sums.max(initial=0)), int(total[-1])) // whole)))
    return best


def _pack_partition(capacity: int, round_: int, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        lengths = np.asarray(held.column("length"), dtype=np.int64)
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - bin_lower_bound(lengths, capacity)
        loose = np.zeros(len(room), dtype=bool)
        if gap > 0:                                     # not certified: the loosest bins go on
            loose = room >= max(1, capacity // 64)
            loose[np.argsort(-room, kind="stable")[:8 * gap]] = True
        part = TaskContext.get().partitionId()
        number = (np.int64(round_) << 52) + (np.int64(part) << 32) + bins
        base = held.select([f.name for f in list(arrow)[:-3]])
        columns = [c.combine_chunks() for c in base.columns]
        yield from pa.Table.from_arrays(
            [*columns, pa.array(number), pa.array(offsets), pa.array(loose[bins])], schema=arrow) \
            .to_batches(max_chunksize=50_000)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, pieces_per_task: int = PIECES_PER_TASK,
         rounds: int = ROUNDS) -> DataFrame:
    """``items`` plus ``sequence_id`` and ``offset``; ``items`` has ``length`` of 1 to ``capacity``.

    Input columns named like these three are replaced.  No row is dropped, and
    an empty table stays empty.
    """
    items = items.drop("sequence_id", "offset", "__loose")
    schema = T.StructType(items.schema.fields + [T.StructField("sequence_id", T.LongType()),
                                                 T.StructField("offset", T.LongType()),
                                                 T.StructField("__loose", T.BooleanType())])
    todo, done, before = staged(items, "pieces"), [], None
    for round_ in range(rounds):
        n = todo.count()
        tasks = max(1, -(-n // pieces_per_task))
        packed = staged(todo.drop("sequence_id", "offset", "__loose").repartition(tasks)
                        .mapInArrow(_pack_partition(capacity, round_, schema), schema), f"packed-{round_}")
        used = packed.select("sequence_id").distinct().count()
        if before is not None and used >= before:
            done.append(todo)                           # the exchange saved nothing
            break
        done.append(packed.where("NOT __loose"))
        todo = packed.where("__loose")
        before = todo.select("sequence_id").distinct().count()
        if before <= 1 or tasks == 1 or round_ == rounds - 1:
            done.append(todo)
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("__loose")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return pack(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), capacity)
