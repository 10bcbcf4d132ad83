"""Hard negatives by inner product, searched in an STR-packed R-tree.

Rows are packed by sort-tile-recursive order: range-partitioned into slabs by one coordinate, each
slab into tiles by a second one, and inside a tile sorted by further coordinates into leaves; ties go
by a row number, so equal vectors fill as many tiles as they need. A minimum bounding box and an
anchor give an interval for every coordinate's product, hence one for the score. An anchor first
searches the tile it lies in, then every tile whose interval can still hold an answer. In a tile a
best-first queue opens boxes by their upper bound, leaves out those outside the score window, and ends
at the first bound strictly below the k-th score found (boxes that tie are opened).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from batchtrace.llm.shared import delete, ship, store

#: Rows of a tile (fewer for long vectors: about MAX_CELLS components), of a leaf, and boxes of a node.
TILE, LEAF, FAN, MAX_CELLS = 8192, 256, 16, 1 << 22
#: Boxes of the root directory at most; each covers as many tiles in a row as that takes.
MAX_DIRECTORY = 1024
#: Coordinates that order the leaves of a tile.
SORTED = 4
MOST = (1 << 63) - 1

ASK = "struct<ask: int, same: boolean, low: bigint, high: bigint, least: bigint>"
HIT = "query bigint, ask int, rid bigint, vec_id bigint, score bigint"


def _matrix(vectors, width: int) -> np.ndarray:
    return np.maximum(np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), width), -MOST)


def _products(rows: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; beyond a long, the nearest long."""
    size = most * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if size < 2.0 ** 53:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if size < 2.0 ** 62:
        return rows @ q
    return np.array([max(-MOST, min(MOST, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in rows], np.int64)


def intervals(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each query (row) with each box (column): per coordinate the product
    lies between those with the box's two ends. Widened by what rounding can take away."""
    lo, hi, q = low.astype(np.float64), high.astype(np.float64), queries.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = np.maximum(np.abs(lo), np.abs(hi)).max(initial=0) * np.abs(q).max(initial=0) * max(1, q.shape[1])
    slack = 0.0 if slack < 2.0 ** 53 else slack * 2.0 ** -44
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


class Tree:
    """The packed boxes over one tile's rows."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, rids: np.ndarray):
        spread = rows.astype(np.float64).var(axis=0)
        dims = [int(d) for d in np.argsort(-spread, kind="stable")[:SORTED]] or [0]
        parts = list(self._cut(rows, rids, np.arange(len(rows)), dims))
        order = np.concatenate(parts)
        self.labels, self.ids, self.rids = labels[order], ids[order], rids[order]
        self.rows = rows[order]
        self.most = float(np.abs(self.rows).max(initial=0))
        ends = np.cumsum([len(p) for p in parts])
        self.leaf = [slice(int(e) - len(p), int(e)) for e, p in zip(ends, parts, strict=True)]
        low = np.stack([self.rows[s].min(axis=0) for s in self.leaf])
        high = np.stack([self.rows[s].max(axis=0) for s in self.leaf])
        lows, highs, self.children, first = [low], [high], [None] * len(self.leaf), 0
        while len(low) > 1:
            cuts = range(0, len(low), FAN)
            self.children += [range(first + a, first + min(a + FAN, len(low))) for a in cuts]
            first += len(low)
            low, high = (np.stack([f(x[a:a + FAN], axis=0) for a in cuts]) for f, x in ((np.min, low), (np.max, high)))
            lows.append(low)
            highs.append(high)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)

    def _cut(self, rows, rids, at, dims):
        """Sort-tile-recursive: slices by the first coordinate, each cut by the next ones."""
        if len(at) <= LEAF:
            yield at
            return
        slices = math.ceil(math.ceil(len(at) / LEAF) ** (1 / len(dims)))
        at = at[np.lexsort((rids[at], rows[at, dims[0]] if rows.shape[1] else rids[at]))]
        step = LEAF if len(dims) == 1 else math.ceil(len(at) / slices)
        for a in range(0, len(at), step):
            part = at[a:a + step]
            yield from self._cut(rows, rids, part, dims[1:]) if len(dims) > 1 else [part]

    def search(self, q: np.ndarray, label, own: int, asks, low: np.ndarray, high: np.ndarray, k: int):
        """(ask, rid, vec_id, score) of the first ``k`` rows of each ask; low, high: the query's intervals."""
        scores: dict[int, np.ndarray] = {}
        for ask in asks:
            top, kth, found = ask["high"], max(ask["low"], ask["least"]), []
            heap = [(-min(high[-1], top), len(self.children) - 1)] if low[-1] <= top else []
            while heap:
                bound, node = heapq.heappop(heap)
                if -bound < kth:
                    break
                if self.children[node] is not None:
                    for c in self.children[node]:
                        if high[c] >= kth and low[c] <= top:
                            heapq.heappush(heap, (-min(high[c], top), c))
                    continue
                at = self.leaf[node]
                s = scores.get(node)
                if s is None:
                    s = scores[node] = _products(self.rows[at], q, self.most)
                hit = np.flatnonzero((s >= kth) & (s <= top))
                if len(hit):
                    hit = hit[((self.labels[at][hit] == label) == ask["same"]) & (self.rids[at][hit] != own)]
                if len(hit):
                    found += zip((-s[hit]).tolist(), self.ids[at][hit].tolist(), self.rids[at][hit].tolist(), strict=True)
                    found = heapq.nsmallest(k, found)
                    if len(found) == k:
                        kth = max(kth, -found[-1][0])
            for s, i, r in found:
                yield ask["ask"], r, i, -s


def _searcher(width: int, k: int):
    def run(batches):
        """Rows come sorted by tile, each tile's own rows before the queries on it."""
        tile, parts, tree = None, [], None
        for pdf in batches:
            for (t, query), part in pdf.groupby(["tile", "query"], sort=True):
                if t != tile:
                    tile, parts, tree = t, [], None
                if not query:
                    parts.append((_matrix(part["x"], width), part["label"].to_numpy(), part["vec_id"].to_numpy(), part["rid"].to_numpy()))
                    continue
                if tree is None and parts:
                    tree, parts = Tree(*(np.concatenate(c) for c in zip(*parts, strict=True))), []
                if tree is None:
                    continue
                qs, out = _matrix(part["x"], width), []
                low, high = intervals(tree.low, tree.high, qs)
                for i, (rid, label, asks) in enumerate(zip(part["rid"], part["label"], part["asks"], strict=True)):
                    out += [(rid, *hit) for hit in tree.search(qs[i], label, rid, asks, low[i], high[i], k)]
                if out:
                    yield pd.DataFrame(out, columns=["query", "ask", "rid", "vec_id", "score"])
    return run


def pack_tiles(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (rid, x and others) with their tile, stored: the index holds every row."""
    n = rows.count()
    size = max(LEAF, min(TILE, MAX_CELLS // max(1, width)))
    tiles = max(1, math.ceil(n / size))
    slabs = math.ceil(math.sqrt(tiles))
    spread = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.var_pop(F.col("c").cast("double")).alias("v"))
    best = [r["i"] for r in spread.orderBy(F.desc("v"), "i").limit(2).collect()]
    first, second = (F.get("x", F.lit(d)) for d in (best * 2)[:2]) if best else (F.lit(0), F.lit(0))
    rows = rows.repartitionByRange(slabs, first, "rid").withColumn("_slab", F.spark_partition_id())
    rows = rows.repartitionByRange(slabs * math.ceil(tiles / slabs), "_slab", second, "rid")
    return store(rows.withColumn("tile", F.spark_partition_id()).drop("_slab"), "negatives-index")


def _directory(index: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last tile, low and high corner of at most MAX_DIRECTORY boxes over all tiles."""
    share = max(1, math.ceil(((index.agg(F.max("tile")).first()[0] or 0) + 1) / MAX_DIRECTORY))
    entry = F.floor(F.col("tile") / share).cast("int").alias("d")
    spans = index.groupBy(entry).agg(F.min("tile").alias("a"), F.max("tile").alias("b")).orderBy("d").collect()
    at = {r["d"]: k for k, r in enumerate(spans)}
    low, high = (np.zeros((len(spans), width), np.int64) for _ in range(2))
    for r in index.select(entry, F.posexplode("x").alias("i", "c")).groupBy("d", "i").agg(F.min("c").alias("l"), F.max("c").alias("h")).collect():
        low[at[r["d"]], r["i"]], high[at[r["d"]], r["i"]] = r["l"], r["h"]
    return np.array([r["a"] for r in spans]), np.array([r["b"] for r in spans]), low, high


def _search(index: DataFrame, queries: DataFrame, width: int, k: int, directory=None) -> DataFrame:
    """Hits of ``queries`` (home, rid, label, x, asks): in their home tiles, or with ``directory`` in all
    others that it does not rule out."""
    if directory is None:
        sent = queries.withColumn("tile", F.col("home"))
    else:
        first, last, low, high = directory

        @F.pandas_udf("array<int>")
        def tiles(x: pd.Series, asks: pd.Series, home: pd.Series) -> pd.Series:
            lo, hi = intervals(low, high, _matrix(x, width))
            out = []
            for i, (a, own) in enumerate(zip(asks, home, strict=True)):
                open_ = np.zeros(len(first), bool)
                for ask in a:
                    open_ |= (lo[i] <= ask["high"]) & (hi[i] >= max(ask["low"], ask["least"]))
                out.append([t for d in np.flatnonzero(open_) for t in range(first[d], last[d] + 1) if t != own])
            return pd.Series(out)

        sent = queries.withColumn("tile", F.explode(tiles("x", "asks", "home")))
    none = F.lit(None).cast(f"array<{ASK}>")
    both = (index.select("tile", F.lit(False).alias("query"), "rid", "vec_id", "label", "x", none.alias("asks"))
            .unionByName(sent.select("tile", F.lit(True).alias("query"), "rid", F.lit(0).cast("long").alias("vec_id"), "label", "x", "asks")))
    return both.repartition("tile").sortWithinPartitions("tile", "query").mapInPandas(_searcher(width, k), HIT)


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each ask, with their rank (the limit also runs before the shuffle)."""
    order = Window.partitionBy("query", "ask").orderBy(F.desc("score"), "vec_id", "rid")
    return hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def _answers(index: DataFrame, queries: DataFrame, width: int, k: int, directory, label: str) -> DataFrame:
    """Home tiles first; what they give is the bar for all others."""
    home = store(_first(_search(index, queries, width, k), k), f"{label}-home")
    bars = home.where(f"rank = {k}").groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("_bar"))
    raised = queries.join(bars, queries["rid"] == bars["query"], "left").drop("query").withColumn("asks", F.expr(
        "transform(asks, a -> named_struct('ask', a.ask, 'same', a.same, 'low', a.low, 'high', a.high, "
        "'least', coalesce(_bar[a.ask], a.least)))"))
    away = _search(index, raised, width, k, directory)
    out = store(_first(home.drop("rank").unionByName(away), k), label)
    delete(home)
    return out


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, scale: int = 256, positives: int = 5,
                   negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding and label; ``anchor`` says which rows are anchors, ``label`` may
    replace the label. Components become floor(scale * x); scores are integer inner products, higher
    first, ties by smaller vec_id. An anchor's positives are its first ``positives`` other rows of its
    label; for each, the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part.
    Vectors of different lengths are filled up with zeros (an empty one scores 0). Every row counts:
    rows that share a vec_id, or all columns, are candidates each, are each other's positives or
    negatives, and are anchors each. Scores beyond a long count as the nearest long. Other columns
    are not read. Empty table, or no anchor: empty result. All rows are indexed; the search is exact.
    """
    spark = rows.sparkSession
    ship(spark)
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    whole = F.expr("forall(embedding, c -> c is not null and abs(cast(c as double)) < double('infinity'))")
    base = rows.select("vec_id", F.coalesce(label if label is not None else F.col("label")).cast("long").alias("label"),
                       x.alias("x"), whole.alias("_whole"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = store(base.where("vec_id is not null and label is not null and x is not null and _whole").drop("_whole")
                 .withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    width = base.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), width - F.size("x")))
    index = pack_tiles(base.withColumn("x", filled), width)
    delete(base)
    directory = _directory(index, width)
    queries = index.where("anchor").select(F.col("tile").alias("home"), "rid", "vec_id", "label", "x")

    def ask(no, same, least, most) -> Column:
        return F.struct(no.cast("int").alias("ask"), F.lit(same).alias("same"), least.alias("low"), most.alias("high"),
                        F.lit(-MOST).alias("least"))

    any_ = F.array(ask(F.lit(0), True, F.lit(-MOST), F.lit(MOST)))
    near = _answers(index, queries.drop("vec_id").withColumn("asks", any_), width, positives, directory, "negatives-positive")
    near = near.select("query", F.col("rank").alias("ask"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # integer bounds of the window: low% rounded up, high% rounded down; in decimals, as low * score may pass a long
    score = F.col("positive_score").cast("decimal(20,0)")
    least, most = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    windows = near.where(least <= most).groupBy("query").agg(F.collect_list(ask(F.col("ask"), False, least, most)).alias("asks"))
    asked = queries.drop("vec_id").join(windows, queries["rid"] == windows["query"]).drop("query")
    hard = _answers(index, asked, width, negatives, directory, "negatives-hard")
    names = queries.select(F.col("rid").alias("query"), F.col("vec_id").alias("anchor_id"))
    return (hard.join(near, ["query", "ask"]).join(names, "query")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
