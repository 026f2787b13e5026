"""A training corpus from ``documents``: five stages, each on what its predecessor kept.

``run`` applies them; every stage's output is written as Parquet in the shared folder
and read again as the next one's input.

Defined for every stage but the last: the columns are those of its input, whatever their
names; an empty table stays empty; very long texts are handled whole; rows with a null
doc_id are documents like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import decontaminate, langid, packing, simhash, substring
from tamis.llm.queries import table
from tamis.llm.store import written


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a clear language (learnt from the labelled ones).

    Null texts and those without a letter go; ties between languages go (their margin is 0);
    repeated rows stay or go together; with no labelled row at all every document goes."""
    kept = langid.detect(F.col("text"), langid.learn(docs))["accepted"]
    return docs.where(kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate group.

    Of rows that repeat that id one stays; null, empty and wordless texts are one group; a null
    id stays only where its group has no other."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of repeated windows; documents with none left go, untouched ones stay as they are.

    Null and empty texts have no window and stay; repeated rows get the same result."""
    out = _own(docs, "dedup")
    found = substring.deduplicate(docs, out=out).where((F.col(out)["n_removed"] < F.col(out)["n_words"])
                                                       | (F.col(out)["n_removed"] == 0))
    text = F.when(F.col(out)["n_removed"] > 0, F.col(out)["kept"]).otherwise(F.col("text"))
    sized = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return found.withColumn("text", text).withColumns(sized).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated with benchmark text; removes the hit spans of the others.

    Null and empty texts stay; an empty benchmark changes nothing."""
    out = _own(docs, "match")
    found = decontaminate.match(docs, table(spark, sf_dir, "benchmark"), out=out)
    clean = F.col(out)["clean_text"]
    sized = {"n_chars": F.coalesce(F.length(clean).cast("long"), F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return (found.where(~decontaminate.contaminated(F.col(out)))
            .withColumns({"text": F.coalesce(clean, F.col("text")), **sized}).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence of 2048 tokens (a null text is empty)."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: packing, the sketches and the compression have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
