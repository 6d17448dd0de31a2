"""A corpus pipeline of five operators; each stage works on what the one before it kept.

1. language ID: documents without a letter go; a missing language is filled in,
   or stays null where no training-side document has a language.
2. n-gram Jaccard join: the document with the smallest id of each group of near
   duplicates stays (of one id, that with the least hash of the text); a row
   without an id comes after those with one. Rows are told apart by id and text.
3. benchmark decontamination: contaminated documents go.
4. personal data: spans are replaced by their kind, and n_chars follows.
5. BPE encoding: every document's token ids, with digests of the ids and of the
   decoded text.

The first four return the columns of ``docs`` and handle its nulls, empty texts
and repeated rows as the operators say; extra columns are handed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseboard.llm import decontaminate, encode, jaccard_join, lang_id, pii
from pulseboard.llm.queries import vocabulary
from pulseboard.llm.shared import bounded_batches, dropped, read, stored, whole_rows
from pulseboard.operators.membership import may_be_in


#: Rows that go or repeat whose keys are broadcast at most; bits of the set of their keys beyond that.
FEW_KEYS, KEY_BITS = 1 << 16, 1 << 22


def _columns(docs: DataFrame, row: str, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of a struct of the whole row, some of them changed; by field, as names may hold dots."""
    return [changed.get(c, F.col(row)[c]).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    said = lang_id.identify(whole_rows(docs), model, lettered=True).where("lettered")
    known = F.coalesce(F.col("doc_id")["lang"], F.nullif(F.col("lang_pred"), F.lit(lang_id.UND)))
    return said.select(*_columns(docs, "doc_id", lang=known))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    # A row goes by its id and its text, as ids may repeat; one without an id by its text alone, behind all ids.
    key = ["key", "hashed"]
    hashed = F.xxhash64(F.col("row")["text"])
    first = F.coalesce(F.col("row")["doc_id"].cast("long"), hashed.bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62))
    keyed = whole_rows(docs).select(F.col("doc_id").alias("row"), "text").select("row", "text", first.alias("key"), hashed.alias("hashed"))
    found = stored(jaccard_join.near_duplicates(keyed.select(F.struct(*key).alias("doc_id"), "text")), "groups")
    # Few documents go and fewer repeat, so these lists are what joins the texts.
    gone = stored(found.where("doc_id <> component_id").select("doc_id.*").distinct(), "gone")
    # Wordless texts are in no group, so none of them goes.
    kept = found.where("doc_id = component_id and n_shingles > 0").select("doc_id.*").groupBy(*key).count()
    twice = stored(kept.where("count > 1").select(*key), "twice")
    rows, clear = keyed.drop("text"), None
    if gone.count() + twice.count() <= FEW_KEYS:
        gone, twice = F.broadcast(gone), F.broadcast(twice)  # counted: two numbers a row
    else:
        # A bounded set of those keys keeps the texts of all other rows out of the joins' shuffles.
        maybe = may_be_in("hashed", gone.unionByName(twice), "hashed", bits=KEY_BITS)
        rows, clear = rows.where(maybe), rows.where(~maybe)
    rest = rows.join(gone, key, "left_anti")
    one = Window.partitionBy(*key).orderBy(F.to_json("row"))  # any column, also one without an order
    repeated = rest.join(twice, key, "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    kept = rest.join(twice, key, "left_anti").unionByName(repeated.drop("nth"))
    kept = kept if clear is None else kept.unionByName(clear)
    return kept.select(*_columns(docs, "row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = decontaminate.find_benchmark(whole_rows(docs), read(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).where("not contaminated").select(*_columns(docs, "doc_id"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = pii.find_personal(whole_rows(docs), pii.fit(docs))
    n_chars = F.when(F.size("spans") > 0, F.char_length("redacted")).otherwise(F.col("doc_id.n_chars"))
    return found.select(*_columns(docs, "doc_id", text=F.col("redacted"), n_chars=n_chars))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return encode.encode_documents(docs, vocabulary("byte_bpe_50k.json"), outputs="n_tokens ids ids_sha256 decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("BPE encoding and decoding", encode_tokens),
]

#: No stage but the third has an SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            dropped(before)  # each stage's table goes when the next one is written
    return docs
