"""SimHash near-duplicates found by vantage-point trees over fingerprints.

Two fingerprints within ``max_bits`` differing bits agree up to one bit in at least one of
max_bits // 2 + 1 bit blocks, so there is one tree a block. On each of its levels a tree takes the
Hamming distance to a vantage point within a small group of the block's bits. Distances of disjoint
groups add up, so by the triangle bound a search of radius 1 enters the branch of its own distance on
every level, and on at most one level a branch whose distance is one off; all others are pruned.
Leaves are the shards: every distinct fingerprint goes to its home leaf and, as a query, to the
leaves beyond each boundary it can reach (upward only: the other side finds the pair). Pairs within
a shard are checked by their exact distance. Links are reduced to a spanning forest in each shard
and joined to components by large-star/small-star rounds over stored tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from batchtrace.llm.shared import delete, ship, store

SEED = 42
BITS = 64
GROUP = 2  # bits a tree level looks at
#: Vantage point of all levels (each level uses its own group of the bits).
VANTAGE = 0x9E3779B97F4A7C15
#: Rows of a leaf that are compared in one piece; larger leaves are compared chunk by chunk.
MAX_LEAF = 2048


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of the text's word shingles (repeats count); no word: zero."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        n = len(words) - shingle + 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)]
    count, all_ = np.zeros(BITS, np.int64), np.array(hashes, np.uint64)
    for a in range(0, len(all_), 1 << 16):
        part = all_[a:a + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(all_), bitorder="little")
    return int(bits.view(np.int64)[0])


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """Bit ranges of the trees."""
    m = max_bits // 2 + 1
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def leaf_rows(fps: np.ndarray, max_bits: int) -> pd.DataFrame:
    """(leaf, home, fp): the home leaf of each fingerprint in each tree, and the leaves it queries."""
    x = fps.view(np.uint64) ^ np.uint64(VANTAGE)
    out, base = [], 0
    for lo, hi in blocks(max_bits):
        at = list(range(lo, hi, GROUP))
        dist = np.stack([np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << min(GROUP, hi - a)) - 1)).astype(np.int64)
                         for a in at])
        scale = np.array([(GROUP + 1) ** i for i in range(len(at))], np.int64)
        home = base + scale @ dist
        out.append((home, np.ones(len(fps), bool), fps))
        for d, s, a in zip(dist, scale, at, strict=True):
            up = d < min(GROUP, hi - a)
            out.append((home[up] + s, np.zeros(int(up.sum()), bool), fps[up]))
        base += (GROUP + 1) ** len(at)
    return pd.DataFrame({"leaf": np.concatenate([o[0] for o in out]), "home": np.concatenate([o[1] for o in out]),
                         "fp": np.concatenate([o[2] for o in out])})


def links_of(cell: np.ndarray, home: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (root, other) among the rows of each cell, of pairs within ``max_bits`` bits of
    which at least one row is at home. Rows are sorted by cell."""
    n = len(cell)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    x, us, vs = fp.view(np.uint64), [], []
    i, k = np.arange(n), 1
    while len(i := i[i + k < end[i]]):
        j = i + k
        near = (home[i] | home[j]) & (np.bitwise_count(x[i] ^ x[j]) <= max_bits) & (fp[i] != fp[j])
        us.append(fp[i[near]])
        vs.append(fp[j[near]])
        k += 1
    u, v = np.concatenate(us or [fp[:0]]), np.concatenate(vs or [fp[:0]])
    if not len(u):
        return u, v
    nodes, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ids[:len(u)], ids[len(u):]
    label = np.arange(len(nodes))
    while True:  # smallest label of each component; nodes are sorted, so it is the smallest fingerprint
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def near_links(fps: DataFrame, max_bits: int, max_leaf: int = MAX_LEAF) -> DataFrame:
    """Links (u, v), u < v, that connect exactly the components of distinct fingerprints ``fp``."""
    ship(fps.sparkSession)

    def spread(batches):
        for pdf in batches:
            yield leaf_rows(pdf["fp"].to_numpy(np.int64), max_bits)

    leaves = store(fps.select("fp").mapInPandas(spread, "leaf long, home boolean, fp long"), "simhash-leaves")
    # a leaf beyond max_leaf rows is cut into chunks; each pair of chunks is a cell, so no task gets it whole
    large = (leaves.groupBy("leaf").count().where(F.col("count") > max_leaf)
             .select("leaf", F.ceil(F.col("count") / max_leaf).cast("int").alias("chunks")))
    cells = (leaves.join(large, "leaf", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
             .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
             .withColumn("o", F.explode(F.expr("sequence(0, chunks - 1)")))
             .select(F.xxhash64("leaf", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "home", "fp"))
    cells = cells.repartition("cell").sortWithinPartitions("cell")

    def compare(batches):
        left = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat([left, pdf])
            cell = pdf["cell"].to_numpy()
            done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            left = pdf.iloc[done:]
            if done:
                yield found(pdf.iloc[:done])
        if left is not None and len(left):
            yield found(left)

    def found(pdf):
        u, v = links_of(pdf["cell"].to_numpy(), pdf["home"].to_numpy(), pdf["fp"].to_numpy(), max_bits)
        return pd.DataFrame({"u": u, "v": v})

    return cells.mapInPandas(compare, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links; root is the component's smallest node.

    Alternates large-star and small-star rounds until no link changes; every round is a stored
    table and nothing but its checksum reaches the driver."""
    links = store(links.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "links")
    seen = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are stored, so both sides of the join are plain shuffles that AQE can split at a hot node
        low = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links")
        large = store(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = store(large.groupBy("u").agg(F.min("v").alias("m")), "links")
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = store(small, "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (links, low, large, least):
            delete(old)
        links = after
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def simhash_groups(docs: DataFrame, carry: list[str] | None = None, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``carry`` columns (default: all) of every row plus fingerprint (16 hex digits), component_id, kept.

    Null text counts as empty (fingerprint zero, linked like any other). component_id is the
    smallest doc_id reachable; null doc_ids never are one, and rows reaching no other have null.
    kept: one row a component, that of the smallest doc_id; of several rows with it (repeated rows)
    exactly one. Copies share a fingerprint and are linked once, through it. Empty table: empty
    result. Input columns with the names of result columns are replaced.
    """
    added = ["fingerprint", "component_id", "kept"]
    cols = [c for c in (docs.columns if carry is None else carry) if c not in added]
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col("doc_id").alias("_id"),
                       prints("text").alias("fp"))
    rows = store(rows.withColumn("_rid", F.monotonically_increasing_id()), "simhash-rows")
    rank = F.coalesce(F.col("_id"), F.lit((1 << 63) - 1))
    reps = store(rows.groupBy("fp").agg(F.min("_id").alias("lo"), F.min(rank).alias("rank"),
                                        F.min_by("_rid", rank).alias("rid")), "simhash-reps")
    roots = components(near_links(reps, max_bits))
    labelled = reps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    # stored, so that both sides of the join are plain shuffles, which AQE can split at a large component
    labelled = store(labelled.select("fp", "root", "lo", "rank", "rid"), "simhash-labelled")
    best = store(labelled.groupBy("root").agg(F.min("lo").alias("component_id"), F.min_by("rid", "rank").alias("_keep")), "simhash-best")
    best = store(labelled.select("fp", "root").join(best, "root").select("fp", "component_id", "_keep"), "simhash-groups")
    return rows.join(best, "fp").select(
        "_row.*", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        (F.col("_rid") == F.col("_keep")).alias("kept"))
