"""Hot-key behaviour: one key holds a third of the rows."""

from pyspark.sql import functions as F

from batchtrace.operators import joins as J, paging as O
from batchtrace.operators.numbering import sequence_within


def _settings(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    return old


def _restore(spark, old):
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_skew_safe_left_join_is_split_by_aqe(spark):
    old = _settings(spark, {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    })
    try:
        hows = spark.range(0, 300).select(F.concat(F.lit("H"), F.col("id").cast("string")).alias("processing_code"),
                                          F.col("id").alias("how_no"))
        bags = spark.range(0, 30000).select(
            F.when(F.col("id") % 3 == 0, F.lit("H0")).otherwise(F.concat(F.lit("H"), (F.col("id") % 299 + 1)
                                                                          .cast("string"))).alias("processing_code"),
            F.col("id").alias("bag_no"), F.repeat(F.lit("x"), 40).alias("pad"))
        out = J.skew_safe_left_join(hows, bags, ["processing_code"])
        plain = hows.join(bags, "processing_code", "left")
        assert out.count() == plain.count() == 30000
        assert out.groupBy("processing_code").count().where("processing_code = 'H0'").first()[1] == 10000
        out.collect()  # runs this DataFrame's own adaptive plan to its final form
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final or "isSkewJoin=true" in final
    finally:
        _restore(spark, old)


def test_hot_scope_numbering_and_first_per_key(spark):
    df = spark.range(0, 9000).select(F.col("id").alias("rid"),
                                     F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
                                     .alias("scope"), (F.col("id") * 7 % 1000).alias("o"))
    seq = sequence_within(df, ["scope"], ["o", "rid"], num_partitions=8)
    hot = seq.where("scope = 'hot'")
    assert hot.agg(F.min("_seq0"), F.max("_seq0"), F.countDistinct("_seq0")).first() == (0, 2999, 3000)
    first = O.first_per_key(df, ["scope"], [("o", False), ("rid", False)]).where("scope = 'hot'").first()
    assert (first.o, first.rid) == (0, 0)
