"""What the training-data operators share: scratch tables, document splits and worker-side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete_path, scratch_path  # noqa: F401

#: ASCII white space, as the word definition of the document tables has it.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once into the shared folder and read it back: lineage ends there, whatever executors go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many "_" as it needs to differ from all columns; Spark does not tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, whatever dots and back-ticks it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """64 bits over all columns of a row; what Spark cannot hash goes through JSON."""
    plain = lambda f: "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    return F.xxhash64(*(column(f.name) if plain(f) else F.to_json(F.struct(column(f.name))) for f in df.schema.fields))


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def word_count(text: Column) -> Column:
    """Number of words as a long, 0 for null; runs in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, seed: int = 11) -> DataFrame:
    """Labelled training rows (doc_id, text, y), at most ``limit`` of them, the same ones on every run.

    ``keep`` is the condition on doc_id that lets a row be learned from. Null ids, null labels and labels other
    than 0 and 1 are left out. Ids are chosen by a seeded hash before any text is read, so only the id columns are
    sorted; ids that occur twice among the labels, or with both labels, count once with the larger label, and of
    several documents of one id the one whose text has the smallest hash is taken.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(limit)
    return one_text_each(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))


def one_text_each(rows: DataFrame) -> DataFrame:
    """(doc_id, text, y) with one row for each doc_id and y; repeated ones are put together before they are moved."""
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def on_executors(path: str):
    """(file system, path within it) for files that tasks open themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
