"""Registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchtrace.llm import chat, exact, langid, mix, negatives, pack, quality, rollup, secret_scan, simhash, spans, urls, whiten
from batchtrace.llm.shared import keeping_tables, scratch, table


#: Share of the tokens each domain of the labelled table is to have after mixing; the first keeps its tokens.
TARGETS = {"clean": 0.97, "poor": 0.01, "toxic": 0.02}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every document."""
    return mix.mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS, carry=["doc_id"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches of changes, one of them sent twice.

    Stand-in change rows: every document is inserted; then some are deleted, and some revised to
    the first half of their text; the second batch is sent again before the third."""
    docs = table(spark, sf_dir, "documents")
    image = F.struct("text", "source", "lang")
    half = F.struct(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"), "source", "lang")
    none = F.lit(None).cast(rollup.IMAGE)
    part = F.col("doc_id") % 16

    def changes(rows: DataFrame, op: str, before, after) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), before.alias("before"), after.alias("after"))

    root = scratch(spark, "rollup")
    second = changes(docs.where(part == 5), "delete", image, none).unionByName(changes(docs.where(part == 3), "revise", image, half))
    for batch, rows in ((1, changes(docs, "insert", none, image)), (2, second), (2, second),
                        (3, changes(docs.where(part == 5), "insert", none, half))):
        rollup.commit(rows, root, batch)
    return rollup.totals(spark, root)


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that lie in a run found earlier."""
    return spans.dedup_spans(table(spark, sf_dir, "documents"), carry=["doc_id", "text"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    return pack.pack(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (4-word shingles, at most 4 differing bits)."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), carry=["doc_id"], shingle=4, max_bits=4)
    return groups.select("doc_id", "fingerprint", "component_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, survivor and text hash of every document."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = chat.format_chats(rows.unionByName(extra))
    chats = chats.withColumn("turns", chat.read_back(F.col("formatted")))
    chats = chats.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter (by crc32 of doc_id) is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held_out).select("text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Verdict, host and path of the listed rules.
URL_RULES = [("block", ("net", "/")), ("allow", ("example.net", "/en/")), ("block", ("example.com", "/de/")), ("allow", ("org", "/fr/"))]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url. The labels' ids are taken as page ids: bad is low quality or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    out = urls.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, carry=["page_id"])
    return out.select("page_id", "host", "path", "rule", "verdict")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector's positives; every seventh vector has the next label."""
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), anchor=vec_id % 100 == 0, label=shifted)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First eight whitened components of every vector."""
    finite = F.expr("forall(embedding, c -> c is not null and abs(cast(c as double)) < double('infinity'))")
    near = F.transform("embedding", lambda c: F.least(F.greatest(
        F.floor(c.cast("double") * 1024), F.lit(-whiten.MAX_ENTRY)), F.lit(whiten.MAX_ENTRY)).cast("long") + 100_000)
    return whiten.whiten(table(spark, sf_dir, "embeddings"), F.when(finite, near), carry=["vec_id"])


#: Each result names the tables that were stored for it (``shared.forget`` deletes them).
QUERIES = {f.__name__: keeping_tables(f) for f in (
    op1_mixing, op2_quality_rules, op3_token_rollup, op4_sentence_spans, op5_packing, op6_simhash, op7_secrets,
    op8_exact_dedup, op9_chat, op10_language_id, op11_url_filter, op12_hard_negatives, op13_whitening)}
