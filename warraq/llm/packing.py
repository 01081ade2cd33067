"""Best-fit packing of token pieces into sequences of one length, in merging rounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .pieces import lists
from .tokens import word_encoder

TOGETHER = 512
MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>"
#: A bin this full leaves the rounds, as a share of the capacity.
NEARLY_FULL = 0.995
#: Pieces that one task of the first round gets, if there are as many.
PIECES_PER_TASK = 100_000
#: Bins that one task of a later round may get; it bounds the memory of a task.
BINS_PER_TASK = 100_000
#: Underfull bins from so many tasks meet in one task of the next round.
FAN_IN = 8


def token_pieces(text: Column, tokenizer_path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> Column:
    """An array of pieces: the text's ids and ``end_id``, cut only where longer than ``capacity``.

    A null or empty text is the single id ``end_id``. ``ids`` is null unless
    ``with_ids``; ``ids_crc32`` is over the ids as little-endian 32-bit
    numbers. The last piece may be shorter.
    """
    kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>>")
    def cut(texts: pa.Array) -> pa.Array:
        encoder, out = word_encoder(tokenizer_path), []
        end = np.array([end_id], np.int32)
        for at in range(0, len(texts), TOGETHER):
            number, start, length, crc, ids, ends = [], [], [], [], [], [0]
            for found in encoder.encode(texts[at : at + TOGETHER]):
                found = np.concatenate([found, end])
                for k, s in enumerate(range(0, len(found), capacity)):
                    part = found[s : s + capacity]
                    number.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    ids.append(part)
                ends.append(len(number))
            lots = lists(ids) if with_ids else pa.nulls(len(number), pa.list_(pa.int32()))
            columns = [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), lots]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(kind))

    return cut.asNondeterministic()(text)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the open bin with the least room that is enough.

    Bins with the same room form a stack, and the rooms in use are bits of one
    number, so the best room is its lowest bit from the item's size on.
    """
    bins, used, opened = np.empty(len(sizes), np.int64), 0, 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                used ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[i] = b
        if left := room - size:
            stacks[left].append(b)
            used |= 1 << left
    return bins


def pack(pieces: DataFrame, capacity: int, spare_rounds: int = 3) -> DataFrame:
    """Sequences from ``pieces`` (doc_id, piece, start, length, ids_crc32, ids): each gets sequence_id and offset.

    Round 0 packs the pieces of each partition by best fit; partitions with
    few pieces are read together. Bins that are
    nearly full are done; underfull ones travel on, as single items with their
    members, to tasks that each take those of ``FAN_IN`` tasks before, until
    one task is enough or the bins no longer get fewer. A task of a later round
    gets ``BINS_PER_TASK`` bins at most, spread by a hash of their members, so
    its memory is bounded however little the bins shrink.

    Equal rows are separate pieces. Lengths outside 1 to ``capacity`` fail.
    An empty input gives no sequence.
    """
    spark = pieces.sparkSession
    schema = f"sequence_id bigint, size bigint, members array<{MEMBER}>"
    member = F.struct(*(F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")))
    pieces = written(pieces, "pieces")
    pieces = pieces.coalesce(max(1, -(-pieces.count() // PIECES_PER_TASK)))
    bins = pieces.select(F.lit(0).cast("bigint").alias("sequence_id"), F.col("length").cast("bigint").alias("size"), F.array(member).cast(f"array<{MEMBER}>").alias("members"))
    done, tasks, before, round_no = [], None, None, 0
    while True:
        packed = written(bins.mapInArrow(_packer(capacity, round_no), schema), f"bins{round_no}")
        full = F.col("size") >= int(NEARLY_FULL * capacity)
        rest, parts = packed.where(~full).agg(F.count("*"), F.countDistinct(F.shiftright("sequence_id", 34))).first()
        tasks = parts if tasks is None else tasks
        last = tasks <= 1 or rest <= 1
        if not last and before is not None and rest > 0.98 * before:
            spare_rounds -= 1
            last = spare_rounds <= 0
        if last:
            done.append(packed)
            break
        done.append(packed.where(full))
        tasks = max(-(-tasks // FAN_IN), -(-rest // BINS_PER_TASK))
        bins = packed.where(~full).repartition(tasks, F.xxhash64(F.lit(round_no), "sequence_id"))
        before, round_no = rest, round_no + 1
    whole = done[0]
    for other in done[1:]:
        whole = whole.unionByName(other)
    ends = F.expr("transform(members, (m, i) -> named_struct('m', m, 'offset', aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length)))")
    return whole.select("sequence_id", F.explode(ends).alias("e")).select("e.m.*", "sequence_id", "e.offset")


def _packer(capacity: int, round_no: int):
    def run(batches):
        here = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        data = pa.Table.from_batches(got).combine_chunks()
        sizes = data.column("size").to_numpy()
        if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
            raise ValueError("a piece is empty or longer than a sequence")
        bins = best_fit(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        taken = data.column("members").combine_chunks().take(pa.array(order))
        taken = pa.concat_arrays(taken.chunks) if isinstance(taken, pa.ChunkedArray) else taken
        total = np.bincount(bins, weights=sizes).astype(np.int64)
        many = np.zeros(len(total) + 1, np.int64)
        np.add.at(many, bins[order] + 1, np.diff(taken.offsets.to_numpy()))
        ends = np.cumsum(many).astype(np.int32)
        ids = np.arange(len(total), dtype=np.int64) + (round_no << 56) + (here << 34)
        made = pa.table({"sequence_id": ids, "size": total, "members": pa.ListArray.from_arrays(pa.array(ends), taken.flatten())})
        yield from made.to_batches(max_chunksize=20_000)

    return run


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Whole documents to packed pieces: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Needs the columns ``doc_id`` and ``text`` and ignores all others. The
    order of the pieces in a sequence is free; offsets run gapless from 0.
    """
    each = docs.select("doc_id", F.explode(token_pieces(F.col("text"), tokenizer_path, capacity, end_id, with_ids)).alias("p"))
    return pack(each.select("doc_id", "p.*"), capacity)
