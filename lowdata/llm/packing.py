"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut: full pieces fill a sequence of
their own, the remainder is packed.  Pieces are packed in decreasing length into the
open bin that they fit best; when none has room, a bin of a permitted length is opened, and at
the end every bin is downsized to the smallest permitted length that holds its
contents.  ``cost(c) = overhead + c + c * c / attention`` (a fixed price per sequence, one
per position, and a quadratic part).

The lengths are optimised together.  The length of a new bin is the one of least cost per token of what it
would hold: it is filled in thought with the largest pieces left (a count per size is kept), downsized, and priced.
Lengths compete for the same small pieces, which one bin at a time cannot see; so a block is also packed with every
set of lengths that can hold its pieces, each opened at its smallest fitting length, and the plan of
least total cost is kept.

Packing happens inside the input's own partitions, ``block_rows`` documents at a
time: no shuffle, memory bounded by a block, and only the last bins of a
block are less than full.  A retried task packs its rows again in the same way.

Edge cases: null and empty texts have no token besides the end mark that each document
gets (a given length column: null counts as 0; documents of length 0 get one empty
piece); repeated rows are packed each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD, ATTENTION, BLOCK_ROWS = 16, 16384, 50_000


def cost(c: int) -> float:
    return OVERHEAD + c + c * c / ATTENTION


Plan = tuple[list[int], list[int], list[int], list[int]]  # bin of each item, offset of each item, final and opened length of each bin


def _filled(n: int, room: int, left: list[int], sizes: int) -> int:
    """Tokens of a bin that holds a piece of n and the largest pieces left that fit one after another (``sizes``: bits of what is left)."""
    used = n
    while room:
        fit = sizes & ((2 << room) - 1)
        if not fit:
            break
        s = fit.bit_length() - 1
        k = min(left[s], room // s) if s else 0
        used, room = used + k * s, room - k * s
        sizes &= (1 << s) - 1  # smaller ones next
    return used


def one_plan(sizes: list[int], lengths: tuple[int, ...], look_ahead: bool, order: list[int] | None = None) -> Plan:
    """Best fit in decreasing order; a bin opens at the cheapest length by looking ahead, or at the smallest that fits."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)) if order is None else order
    where, offset = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if some open bin has exactly r positions left
    left = [0] * (max(lengths) + 1)
    for n in sizes if look_ahead else ():
        left[n] += 1
    bits = sum(1 << n for n in set(sizes)) if look_ahead else 0
    for i in order:
        n = sizes[i]
        if look_ahead:
            left[n] -= 1
            if not left[n]:
                bits ^= 1 << n
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            c = next(c for c in lengths if c >= n)
            if look_ahead:
                best = None
                for x in lengths:
                    if x >= n:
                        held = _filled(n, x - n, left, bits)
                        price = cost(next(y for y in lengths if y >= held)) / max(held, 1)
                        if best is None or price < best:
                            best, c = price, x
            b, r = len(used), c
            used.append(0)
            opened.append(c)
        where[i], offset[i] = b, used[b]
        used[b] += n
        room = r - n
        if not by_room[room]:
            rooms |= 1 << room
        by_room[room].append(b)
    return where, offset, [next(c for c in lengths if c >= u) for u in used], opened


def total_cost(plan: Plan) -> float:
    return sum(map(cost, plan[2]))


def best_plan(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> Plan:
    """The cheapest of the plan that looks ahead and the plans of every set of lengths; bins are downsized to any permitted length."""
    lengths = tuple(sorted(set(lengths)))
    if not sizes:
        return [], [], [], []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    most = sizes[order[0]]
    best = one_plan(sizes, lengths, True, order)
    for k in range(1, len(lengths) + 1):
        for some in combinations(lengths, k):
            if some[-1] >= most:
                w, o, final, opened = one_plan(sizes, some, False, order)
                fit = [next(c for c in lengths if c >= u) for u in _used(sizes, w, len(final))]
                if sum(map(cost, fit)) < total_cost(best):
                    best = w, o, fit, opened
    return best


def _used(sizes: list[int], where: list[int], n: int) -> list[int]:
    used = [0] * n
    for s, b in zip(sizes, where):
        used[b] += s
    return used


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset of each item, length of each bin); every size is at most the largest length."""
    return best_plan(sizes, lengths)[:3]


def word_count(text: str = "text") -> Column:
    """Words of a text (ASCII white space) and one end mark."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.size(F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")) + 1


def pack(docs: DataFrame, id_col: str = "doc_id", n_tokens: Column | None = None, lengths: tuple[int, ...] = LENGTHS,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, piece, start, n_tokens, bin, bin_length, bin_offset): where every piece of every document goes."""
    most = max(lengths)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(n_tokens if n_tokens is not None else word_count(), F.lit(0)).cast("long").alias("n"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        part, opened = TaskContext.get().partitionId(), 0

        def block(ids: pa.ChunkedArray, sizes: list[int]):
            nonlocal opened
            rows, rests, out = [], [], []  # out: (piece, start, n, bin, length, offset)
            for k, n in enumerate(sizes):
                whole, rest = divmod(n, most)
                for p in range(whole):
                    rows.append(k)
                    out.append((p, p * most, most, opened, most, 0))
                    opened += 1
                if rest or not whole:
                    rests.append((k, whole, rest))
            where, offset, length = best_fit([r for _, _, r in rests], lengths)
            for (k, whole, rest), b, o in zip(rests, where, offset):
                rows.append(k)
                out.append((whole, whole * most, rest, opened + b, length[b], o))
            opened += len(length)
            cols = list(zip(*out))
            ids = ids.take(pa.array(rows, pa.int64())).combine_chunks()
            bins = [f"{part}-{b}" for b in cols[3]]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(bins),
                 pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32())],
                names=["id", "piece", "start", "n_tokens", "bin", "bin_length", "bin_offset"])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= block_rows:
                t = pa.Table.from_batches(held)
                yield from block(t.column("id"), t.column("n").to_pylist())
                held, rows = [], 0
        if rows:
            t = pa.Table.from_batches(held)
            yield from block(t.column("id"), t.column("n").to_pylist())

    return src.mapInArrow(run, f"id {id_type}, piece int, start bigint, n_tokens bigint, bin string, bin_length int, bin_offset int")
