"""A training corpus from ``documents``: toxic texts go, near-duplicates go, secrets are masked, sources are mixed
to weights, and what is left is encoded. Each stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, mix, secrets, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold, by a lexicon that the labelled rows among ``docs`` teach.

    All columns stay. Null and empty texts have no match and stay; whole texts of any length are scored; repeated
    rows are judged alike; without labels of both kinds, and for an empty table, every row stays.
    """
    lexicon = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    name = common.free_name(docs, "toxicity")
    return docs.withColumn(name, toxicity.score(F.col("text"), lexicon)).where(F.col(name) < toxicity.PREDICT_AT).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id, with all its columns.

    Null ids come last; of rows of one id that with the smaller hash of all columns stays, and of equal rows one.
    Texts without words (null and empty ones too) are one group. An empty table stays empty.
    """
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with all columns; every secret in a text is put by a mark, and n_chars follows where a text changed.

    Null and empty texts, and texts without secrets, stay as they are; repeated rows are masked alike.
    """
    name = common.free_name(docs, "masked")
    masked, old = docs.withColumn(name, secrets.redact(F.col("text"))), {c.lower(): c for c in docs.columns}
    size = F.when(F.col(name).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(name).cast(docs.schema[old["n_chars"]].dataType))
    new = {"text": F.col(name), "n_chars": size}
    return masked.select(*(new[c.lower()].alias(c) if c.lower() in new else common.column(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows, with all columns, as often as the mix takes them: sources weigh 1, 2, 3 in turn, null last, and a
    document comes at most three times.

    Rows without words (null and empty texts) come once; equal rows are taken alike; an empty table stays empty.
    """
    h = common.free_name(docs, "row_hash")
    keyed = docs.withColumn(h, common.row_hash(docs))
    n = common.free_name(keyed, "copy")
    copies = mix.mix(mix.document_sizes(keyed, F.col(h))).where("copies > 0").groupBy(F.col("key").alias(h)).agg(F.max("copies").alias(n))
    copies = copies.select(h, F.explode(F.sequence(F.lit(1), F.col(n))).alias(n))
    return keyed.join(copies, h).select(*(common.column(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and their digests for every row; other columns end here.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows come as often as they are
    there; an empty table has no rows.
    """
    return bpe.round_trip(docs, bpe.public_tokenizer(spark), ("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

#: No stage but the last can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder, read by the next, and deleted
    when that has written its own."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            common.delete_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
