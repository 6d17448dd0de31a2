"""The registered queries ``opN_``: production parameters over whole tables.

Each one calls its operator and derives the digest columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseboard.llm import collocations, context_tree, decontaminate, encode, hard_negatives, jaccard_join, lang_id, metric_join, pii, token_counts, toxicity, training_order, url_rules
from pulseboard.llm.oracle import ORACLE_SQL  # noqa: F401  registered with the queries
from pulseboard.llm.shared import read, scratch_path


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "shards")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return training_order.materialise(read(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    return lang_id.identify(docs, model).select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = pii.find_personal(docs, pii.fit(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.size(F.array_compact(F.transform("base.kind", lambda x: F.nullif(x == kind, F.lit(False))))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


#: The contract's given rules, as (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def url_rules_on_derived_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 where labels follow from the URL (pages of plain http under net are bad), so that mined rules decide."""
    pages = read(spark, sf_dir, "pages")
    bad = F.size(F.array_except(F.array(F.lit("http"), F.lit("net")), url_rules.tokens("url"))) == 0
    labels = pages.select(F.col("page_id").alias("doc_id"), F.when(bad, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    return url_rules.judge(pages, labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), outputs="n_tokens ids_sha256 decoded_sha256")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.range_join(read(spark, sf_dir, "embeddings"))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = context_tree.score(docs, docs.where(~context_tree.held_out()))
    return scored.select("doc_id", context_tree.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


#: The contract's score from which a document counts as toxic.
TOXIC = 0.3


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= TOXIC).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted, "toxic_sentences")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_training_order, op3_jaccard_join, op4_lang_id, op5_pii, op6_token_counts, op7_url_rules, op8_bpe, op9_embedding_dedup, op10_context_tree, op11_hard_negatives, op12_collocations, op13_toxicity, url_rules_on_derived_labels)}
