"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 sets bits for the hashes of all texts and keeps the bits that two or more rows set; pass 2
tests every row against those bits. Only rows whose bits are all set twice (the repeated ones and a
small share of false positives) are shuffled by their hash; the rest pass straight through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from batchtrace.llm.shared import ascii_lower, store

#: Bits per hash function and row, and bits per hash function at most: the filter's broadcast has at most
#: 2 * MAX_BITS / 64 rows of two longs (64 MB), whatever the corpus. From about 10^8 rows on that many bits
#: fill up, and more unrepeated rows are shuffled; the result stays the same.
BITS_PER_ROW, MAX_BITS = 64, 1 << 27


def exact_dedup(docs: DataFrame, carry: list[str] | None = None, bits: int | None = None) -> DataFrame:
    """``carry`` columns (default: all) of every row plus keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id stays; of several rows with that same doc_id exactly one stays; null doc_ids
    rank below all others (keep_id is null if the group has no other). An empty table gives an
    empty result. Input columns with the names of result columns are replaced; others pass.
    ``bits`` (a power of two) of the filter follow the number of rows by default.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    cols = [c for c in (docs.columns if carry is None else carry) if c not in added]
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col("doc_id").alias("_id"),
                       F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_rid"))
    rows = store(rows, "exact-rows")
    if bits is None:
        bits = min(MAX_BITS, 1 << max(16, (BITS_PER_ROW * rows.count()).bit_length()))

    h = F.xxhash64("text_sha256")
    slots = [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)) + bits]
    # pass 1: bits set by at least two rows, 64 of them a row
    twice = (rows.select(F.explode(F.array(*slots)).alias("slot")).groupBy("slot").count().where("count >= 2"))
    filt = (twice.groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")))
    # pass 2: a broadcast of bounded size, no shuffle of rows
    tested = rows
    for i, slot in enumerate(slots):
        side = F.broadcast(filt.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}")))
        tested = (tested.withColumn(f"_s{i}", slot)
                  .join(side, F.shiftright(f"_s{i}", 6) == F.col(f"_w{i}"), "left"))
    hit = [F.expr(f"(shiftrightunsigned(coalesce(_m{i}, 0L), cast(_s{i} & 63 as int)) & 1L) = 1L") for i in (0, 1)]
    tested = tested.select("_row", "_id", "_rid", "text_sha256", (hit[0] & hit[1]).alias("_hit"))

    suspects, rest = tested.where("_hit"), tested.where("not _hit")
    # null ids rank lowest; max_by keeps one row id, so the aggregate stays a hash aggregate
    rank = F.coalesce(F.col("_id"), F.lit(-(1 << 63)))
    groups = store(suspects.groupBy("text_sha256")
                   .agg(F.count(F.lit(1)).alias("group_size"), F.max("_id").alias("keep_id"),
                        F.max_by("_rid", rank).alias("_keep_rid")), "exact-groups")
    found = suspects.join(groups, "text_sha256").withColumn("kept", F.col("_rid") == F.col("_keep_rid"))
    single = (rest.withColumn("keep_id", F.col("_id")).withColumn("group_size", F.lit(1).cast("long"))
              .withColumn("kept", F.lit(True)))
    out = ["_row.*", *added]
    return found.select(*out).unionByName(single.select(*out))
