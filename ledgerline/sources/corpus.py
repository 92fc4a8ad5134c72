"""Readers: text archives, lines of tables, and the statements file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions.text import contains_any

#: Folder of an archive to document type, in reading order.
FOLDERS = {"transcripts": "transcript", "emails": "email", "reports": "report"}


def doc_type_of(doc_id: Column) -> Column:
    """Type from the folder that an id begins with, else null."""
    folder = F.substring_index(doc_id, "/", 1)
    kind = F.lit(None).cast("string")
    for name, value in FOLDERS.items():
        kind = F.when(folder == name, value).otherwise(kind)
    return kind


def archive(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """doc_id, doc_type, doc_seq, text of every .txt file of an archive's folders.

    The id is the path below the archive without its suffix; a byte-order mark goes.  ``only``: ids that
    contain one of these strings; the filter is on the file's path, before any text is split.  doc_seq orders
    by folder, then by the file's name with its suffix ("x-2.txt" before "x.txt").
    """
    files = spark.read.text([f"{path.rstrip('/')}/{d}" for d in FOLDERS if _exists(spark, f"{path.rstrip('/')}/{d}")], wholetext=True, pathGlobFilter="*.txt")
    named = files.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"))
    docs = named.withColumn("doc_id", doc_id_of(F.col("_path"))).filter("doc_id <> ''")
    if only:
        docs = docs.filter(contains_any(F.col("doc_id"), only))
    kind = doc_type_of(F.col("doc_id"))
    rank = F.array_position(F.array(*[F.lit(d) for d in FOLDERS]), F.substring_index("doc_id", "/", 1))
    return docs.select("doc_id", kind.alias("doc_type"), F.struct(rank.alias("folder"), F.concat("doc_id", F.lit(".txt")).alias("path")).alias("doc_seq"), plain_text(F.col("text")).alias("text"))


def plain_text(text: Column) -> Column:
    """A file's text without a byte-order mark, every kind of line end as a line feed."""
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n")


def doc_id_of(path: Column) -> Column:
    """Id of a file of an archive: its path below the archive without the suffix, decoded; "" for other files."""
    tail = "|".join(FOLDERS)
    return F.regexp_extract(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), rf".*/((?:{tail})/[^/]*)\.txt$", 1)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def lines_of(documents: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """One row a line with its number from 1, split at line feeds only, so that numbers match an editor's."""
    return documents.select(key, *more, F.posexplode(F.split(text, "\n")).alias("_p", "text")).select(key, *more, (F.col("_p") + 1).alias("line_no"), "text")


def statements_file(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a statements file with block_no, validated by a fixed schema; a broken file fails the read.

    Missing people and summary are [] and "".
    """
    file = spark.read.schema(schemas.STATEMENTS_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = file.select(F.posexplode("documents").alias("block_no", "d")).select("block_no", "d.*")
    return rows.withColumn("people", F.coalesce("people", F.array().cast("array<string>"))).withColumn("summary", F.coalesce("summary", F.lit("")))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry of people from JSON lines."""
    return spark.read.schema(schemas.PERSON).json(path)
