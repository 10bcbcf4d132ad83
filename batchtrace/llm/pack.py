"""Packing documents into sequences by the linear grouping scheme for bin packing.

1. Every text is tokenised, closed by id 0 and cut into pieces of at most the sequence length;
   pieces are ordered by length and numbered by Spark.
2. The histogram of lengths (at most one count a length, whatever the corpus) is packed on the
   driver: large lengths are put into groups of equal cardinality and rounded up to the group's
   largest, the few rounded sizes are packed by the configuration linear program (columns by a
   knapsack), actual lengths take the places of the rounded ones, and small ones are best-fitted
   into what is left. The result is a list of runs: `count` sequences with the same lengths.
3. Spark gives the pieces of each length their places in order of their numbers.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from batchtrace.llm.shared import ship, store
from batchtrace.llm.tokens import word_tokens

CAPACITY = 2048
GROUPS = 32
SMALL = CAPACITY // 4
TOKENIZER = "word_bpe_49k.json"


def knapsack(sizes: list[int], values: list[float], capacity: int) -> tuple[float, list[int]]:
    """Most valuable multiset of sizes that fits: its value and the count of each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    s, v = np.array(sizes), np.array(values)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        gain = np.where(s <= c, best[np.maximum(c - s, 0)] + v, 0.0)
        i = int(gain.argmax())
        if gain[i] > best[c] + 1e-12:
            best[c], last[c] = gain[i], i
    count, c = [0] * len(sizes), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            count[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), count


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """(configuration, times) that cover ``need`` of each size with few sequences: the configuration
    linear program by column generation, rounded down; the rest is left to ``pack_histogram``."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    b = np.array(need, float)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, column = knapsack(sizes, duals.tolist(), capacity)
        if value <= 1 + 1e-7:
            break
        step, x = np.linalg.solve(basis, np.array(column, float)), np.linalg.solve(basis, b)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.floor(np.maximum(np.linalg.solve(basis, b), 0) + 1e-9).astype(int)
    return [([int(v) for v in basis[:, j]], int(t)) for j, t in enumerate(times) if t]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[list[int], int]]:
    """Runs (lengths in a sequence, number of such sequences) that hold exactly ``counts``.

    Work and result depend on the number of distinct lengths and groups, not on the counts."""
    left = {s: n for s, n in counts.items() if n > 0}
    runs: list[tuple[list[int], int]] = []
    if n := left.pop(capacity, 0):
        runs.append(([capacity], n))
    large = sorted((s for s in left if s > small), reverse=True)
    total = sum(left[s] for s in large)
    pools: list[list[list[int]]] = []  # of each group: [length, count], largest first
    quota, room = -(-total // groups) if total else 0, 0
    for s in large:
        n = left[s]
        while n:
            if not room:
                pools.append([])
                room = quota
            take = min(n, room)
            pools[-1].append([s, take])
            n, room = n - take, room - take
    by_size: dict[int, list[list[int]]] = {}  # groups rounded up to the same size are one
    for p in pools:
        by_size.setdefault(p[0][0], []).extend(p)
    sizes = list(by_size)
    open_: list[tuple[list[int], int]] = []

    def fill(config: list[int], times: int) -> None:
        """Put actual lengths into ``times`` sequences of a configuration, in runs of equal ones. The
        last place takes the largest length that the others leave room for, at least the group's own."""
        while times:
            used = []  # (entry of a pool, places it fills in each sequence of this run)
            for size, places in zip(sizes, config, strict=True):
                for p in by_size[size]:
                    if use := min(places, p[1]):
                        used.append((p, use))
                        places -= use
            if not used:
                return
            p, use = used.pop()
            if use > 1:
                used.append((p, use - 1))
            room = capacity - sum(p[0] * use for p, use in used)
            free = {id(p): use for p, use in used}
            last = max((p for pool in by_size.values() for p in pool if p[0] <= room and p[1] > free.get(id(p), 0)), key=lambda p: p[0])
            if id(last) in free:
                used = [(p, use + (p is last)) for p, use in used]
            else:
                used.append((last, 1))
            if capacity - sum(p[0] * use for p, use in used) > small:
                return  # groups have run out, or a configuration that only evens out: best fit does better
            n = min(times, *(p[1] // use for p, use in used))
            for p, use in used:
                p[1] -= n * use
            open_.append(([p[0] for p, use in used for _ in range(use)], n))
            times -= n
            for size in sizes:
                by_size[size] = [p for p in by_size[size] if p[1]]

    for config, times in configurations(sizes, [sum(p[1] for p in by_size[s]) for s in sizes], capacity) if sizes else []:
        fill(config, times)
    # what rounding down left over, and the small lengths: best fit, largest first
    rest = defaultdict(int, {s: n for s, n in left.items() if s <= small})
    for pool in by_size.values():
        for s, n in pool:
            rest[s] += n
    return runs + best_fit(open_, rest, capacity)


def best_fit(open_: list[tuple[list[int], int]], counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Put ``counts`` of each length into the fullest sequences that have room, run by run."""
    by_room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for lengths, n in open_:
        by_room[capacity - sum(lengths)].append((lengths, n))
    rooms = np.zeros(capacity + 1, bool)
    rooms[list(by_room)] = True
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            fits = np.flatnonzero(rooms[s:])
            if len(fits):
                room = s + int(fits[0])
                lengths, m = by_room[room].pop()
                if not by_room[room]:
                    rooms[room] = False
            else:
                room, lengths, m = capacity, [], 0
            each = 1 if lengths else min(room // s, n)
            take = min(n, m) if lengths else n // each
            if m > take:
                by_room[room].append((lengths, m - take))
                rooms[room] = True
            new = room - each * s
            by_room[new].append((lengths + [s] * each, take))
            rooms[new] = True
            n -= take * each
    return [run for at in by_room.values() for run in at]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, which end with id 0."""
    ids += b"\0\0\0\0"
    n = len(ids) // 4
    return [(k, a, min(capacity, n - a), zlib.crc32(ids[4 * a:4 * (a + capacity)])) for k, a in enumerate(range(0, n, capacity))]


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, groups: int = GROUPS) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: empty, so one piece of one id. Repeated rows are packed each. A null doc_id stays
    null. Other columns are not read. Empty table: empty result. Texts are tokenised whole.
    """
    spark = docs.sparkSession
    ship(spark)
    small = capacity // 4

    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def pieces(texts: pd.Series) -> pd.Series:
        tokens = word_tokens(tokenizer)
        return pd.Series([[{"piece": k, "start": a, "length": n, "ids_crc32": c} for k, a, n, c in cut(tokens.encode(t), capacity)]
                          for t in texts], dtype=object)

    cuts = docs.select("doc_id", F.explode(pieces("text")).alias("p")).select("doc_id", "p.*")
    cuts = store(cuts, "pack-pieces")
    # pieces in order of length; the order inside a partition and its number are fixed by storing them
    ordered = cuts.repartitionByRange(F.desc("length"), F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(
        F.desc("length"), "doc_id", "piece")
    ordered = store(ordered.withColumn("_m", F.monotonically_increasing_id()), "pack-ordered")
    ordered = ordered.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {r["length"]: r["n"] for r in ordered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}

    base, at = {}, 0  # number of the first piece of each partition
    for p in sorted(sizes):
        base[p], at = at, at + sizes[p]
    first, at = {}, 0  # and of the first piece of each length
    for s in sorted(counts, reverse=True):
        first[s], at = at, at + counts[s]
    # places: the pieces from number `lo` on take offset `offset` of the sequences from `seq` on
    lo, seq, offset, used, sequence = [], [], [], dict(first), 0
    for lengths, n in pack_histogram(counts, capacity, groups, small):
        o = 0
        for s in lengths:
            lo.append(used[s])
            seq.append(sequence)
            offset.append(o)
            used[s] += n
            o += s
        sequence += n
    order = np.argsort(np.array(lo, np.int64))
    places = spark.sparkContext.broadcast((base, *(np.array(x, np.int64)[order] for x in (lo, seq, offset))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(part: pd.Series, at: pd.Series) -> pd.DataFrame:
        base, lo, seq, offset = places.value
        number = part.map(base).to_numpy(np.int64) + at.to_numpy()
        i = np.searchsorted(lo, number, "right") - 1
        return pd.DataFrame({"sequence_id": seq[i] + number - lo[i], "offset": offset[i]})

    return ordered.withColumn("_p", place("_part", "_at")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")
