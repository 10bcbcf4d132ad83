"""P3/P4/J9 by index: a postings table of the trigrams of the searched texts, kept beside the table.

``postings`` turns the rows of one write into blocks of at most ``BLOCK`` rows, to be committed together
with them (``sources.commits``): per block its keys once, and per trigram in it the places of the rows that
have it. So a key is not repeated for each of its trigrams, and nothing is shuffled; each file is sorted by
gram, so a search reads the row groups of its grams and the keys alone. ``candidates`` intersects the
places of a term's grams in each block; the caller verifies the candidates with the plain filter.
Terms of fewer than three characters, which have no trigram, scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from batchtrace.session import ship

#: Of a term's trigrams, this many with the fewest postings are looked up; verification does the rest.
LOOKED_UP = 3
#: Rows of a block at most.
BLOCK = 4096
#: Of a block: the places of the rows with a gram, or (gram NULL) the rows' keys in order.
POSTINGS = T.StructType([T.StructField("gram", T.StringType()), T.StructField("block", T.StringType()),
                         T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.StringType()))])
COUNTS = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])


def _inverted(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(POSTINGS)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            keys, places = part.column(0).to_pylist(), {}
            for i, texts in enumerate(part.column(1).to_pylist()):
                for gram in {t[j:j + 3] for t in texts if t is not None for j in range(len(t) - 2)}:
                    places.setdefault(gram, []).append(i)
            block, n = hashlib.sha1(repr(keys).encode()).hexdigest(), len(places)
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(
                ([None, *places], [block] * (n + 1), [None, *places.values()], [keys, *[None] * n]), kinds.types)], schema=kinds)


def postings(rows: DataFrame, key: str, texts: list[Column]) -> DataFrame:
    """``POSTINGS`` of the rows' texts (a column may be an array of texts), each file sorted by gram. Null
    texts have no grams. To be stored before it is searched: a block is named by its rows' keys."""
    ship(rows.sparkSession)
    lists = [t if rows.select(t.alias("t")).schema["t"].dataType.typeName() == "array" else F.array(t) for t in texts]
    low = F.transform(F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull())), F.lower)
    named = rows.select(F.col(key).cast("string").alias("key"), low.alias("texts")).where("key IS NOT NULL")
    return named.mapInArrow(_inverted, POSTINGS).sortWithinPartitions("gram")


def gram_counts(posted: DataFrame) -> DataFrame:
    """Rows per gram of one write (summed over writes, they choose the grams to look up)."""
    return posted.where("gram IS NOT NULL").groupBy("gram").agg(F.sum(F.size("places")).alias("n"))


def candidates(posted: DataFrame, counts: DataFrame, term: str, like: bool = False) -> DataFrame | None:
    """(key) of the rows that may contain ``term`` (``like``: a LIKE pattern, of which the parts between
    wildcards count); None: the term is too short for the index."""
    low = term.lower()
    grams = sorted({part[i:i + 3] for part in (re.split("[%_]", low) if like else [low]) for i in range(len(part) - 2)})
    if not grams:
        return None
    # a row a gram of the term
    known = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    asked = sorted(grams, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]
    # a column a gram asked for; a block that was written twice has the same places twice
    held = posted.where(F.col("gram").isin(asked)).groupBy("block").agg(
        *[F.max(F.when(F.col("gram") == g, F.col("places"))).alias(f"_{i}") for i, g in enumerate(asked)])
    both = held.select("block", reduce(F.array_intersect, [F.col(f"_{i}") for i in range(len(asked))]).alias("places")).where(F.size("places") > 0)
    keys = posted.where("gram IS NULL").select("block", "keys").join(both, "block")
    return keys.select(F.explode(F.transform("places", lambda i: F.get("keys", i))).alias("key")).distinct()


def search(table: DataFrame, key: str, posted: DataFrame, counts: DataFrame, term: str | None,
           verify: Callable[..., DataFrame], children: dict[str, DataFrame] | None = None, like: bool = False) -> DataFrame:
    """``verify(table)`` for the rows that may match. With ``children`` (name -> table with the same
    key), ``verify`` gets those too, cut to the candidates before anything is joined or grouped."""
    found = candidates(posted, counts, term, like) if term else None

    def cut(df: DataFrame) -> DataFrame:
        return df if found is None else df.join(found.withColumnRenamed("key", key), key, "left_semi")
    return verify(cut(table), **{n: cut(c) for n, c in (children or {}).items()})
