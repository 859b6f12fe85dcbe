"""The corpus pipeline: documents in, tokenized clean documents out.

Each stage takes the documents its predecessor kept and returns the columns of documents; the last adds token ids.
``run`` writes each stage as Parquet in the shared folder and reads it again, so a lost executor costs one stage at most.
Nulls: a row whose text is null is rejected by the first stage; a row without doc_id passes every stage, but is
never dropped as a copy and never loses a passage. Columns other than those of documents are not read, so their names can't clash; an
empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language, roundtrip, shingles, suffixes
from ledgerloom.llm.common import small_batches, table
from ledgerloom.llm.registry import vocabulary_path
from ledgerloom.session import stage, staged_result

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of a batch that a Python worker gets; both ends of the exchange hold a few batches in each task.
BATCH = 2000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected; the model is trained on ``docs``."""
    told = language.identify(docs.select(*COLUMNS))
    return told.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near copies the document of smallest id (of two texts under one id, that of the smaller
    hash), and of rows that share id and text one. Texts without words link with nothing."""
    rows = docs.select(*COLUMNS)

    def verdicts() -> DataFrame:
        """(doc_id, mark, dropped) of the documents that are dropped or occur more than once."""
        found = shingles.near_duplicates(rows.select("doc_id", "text"), count_links=False).where("doc_id IS NOT NULL").select("doc_id", "mark", "group")
        seen = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.first("group").alias("group"))
        stays = seen.groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("stays"))
        judged = seen.join(stays, "group", "left").select("doc_id", "mark", "n", F.coalesce(F.struct("doc_id", "mark") != F.col("stays"), F.lit(False)).alias("dropped"))
        return judged.where("dropped OR n > 1").select("doc_id", "mark", "dropped")

    told = staged_result(spark, verdicts, "near-copies")
    marked, again = rows.withColumn("mark", F.xxhash64("text")), told.where("NOT dropped")
    told, again = (F.broadcast(x) if x.count() <= shingles.SMALL else x for x in (told, again))  # or each text is shuffled to meet them
    kept = marked.join(told.select("doc_id", "mark"), ["doc_id", "mark"], "left_anti")
    once = marked.join(again, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])  # rows that repeat
    return kept.union(once).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document of smaller id has; a document may end up with an empty text, and a null one does."""
    cut = suffixes.deduplicate(docs.select(*COLUMNS), with_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more lies in windows of the benchmark."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids (little-endian unsigned 32-bit), n_tokens, and the digests of ids and decoded text."""
    return roundtrip.encode_documents(docs.select(*COLUMNS), vocabulary_path())


STAGES = [
    ("language ID", identify),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", tokenize),
]

#: A fitted model decides in the first stage, so no SQL says what is left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark, BATCH):
        for name, work in STAGES:
            docs, _ = stage(work(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
