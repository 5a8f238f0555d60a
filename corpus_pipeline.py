"""From raw documents to encoded training text.

Each stage takes the documents that its predecessor kept, applies one operator to all of them and lets its
decisions take effect. All but the last return the columns of documents.

Every stage takes rows with nulls in any column, empty and very long texts and repeated rows, and an empty table gives an empty
one. Columns beside those of documents are not passed on, so their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.decontaminate import decontaminate
from tracewell.llm.lexicon_bpe import bpe_codec
from tracewell.llm.near_dups import near_duplicates
from tracewell.llm.substring_dedup import dedup_substrings
from tracewell.llm.tables import gathered, shared_folder, table, text_bytes
from tracewell.llm.toxicity import score_toxicity

#: Bytes of text in one file between stages, at least, where the input comes in smaller parts.
PART_BYTES = 4 << 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "word_bpe_49k.json"


def _parts(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The stage's rows in parts of PART_BYTES of its input's text at least, so that no stage leaves a crowd of tiny files to the next."""
    return gathered(out, text_bytes(docs), PART_BYTES)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model learns from the labels of the documents at hand.

    Null and empty texts are scored without savings and stay; without labels, or with labels of one class only, all documents stay.
    """
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _parts(scored.where("predicted = 0").select(*COLUMNS), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id.

    Rows without an id stay, and so do null and empty texts: each is a class of its own. Rows that share the id that stays all stay.
    """
    slim = docs.select(*COLUMNS)
    classes = near_duplicates(slim.select("doc_id", "text"), ids="doc_id").select(F.col("doc_id").alias("gone_id"), "class_id")
    gone = classes.where("gone_id <> class_id").select("gone_id").distinct()
    return _parts(slim.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document has go; texts that lose nothing stay as they are.

    No document goes, not even one that loses all of its words. A null text stays null, and its n_chars too; a row without an id loses nothing.
    """
    out = dedup_substrings(docs.select(*COLUMNS))
    out = out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    return _parts(out, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and rows without an id stay."""
    return _parts(decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to. Null and empty texts have no ids and decode to an empty text."""
    import public_tokenizers

    coded = bpe_codec(docs.select(*COLUMNS), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encode", encode),
]
#: No SQL expresses the stages (trained models, signatures, an id-exact codec): tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again."""
    import uuid

    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
    return docs
