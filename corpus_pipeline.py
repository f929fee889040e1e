"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes the documents that its predecessor kept, as Parquet read again, and
returns those that it keeps itself, in their columns; the last returns the packed pieces.

In all stages a null text is empty, a document is its row: where an id is null or repeated, rows are told apart by a
hash of id and text, and only rows equal in both share a fate. Very long texts are read whole, one at a time.
Columns beside doc_id, text, lang, source and n_chars pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.language_id import identify
from loomgraph.llm.minhash_neardup import near_duplicates
from loomgraph.llm.packing import pack
from loomgraph.llm.quality_rules import without_common_lines
from loomgraph.llm.queries import vocabulary
from loomgraph.llm.storage import row_key, table, written
from loomgraph.llm.substring_dedup import remove_repeats

#: A document is rejected when no language is as likely as this.
LANGUAGE_SCORE = 0.5
#: A line in so few texts of a host is never common; above, the share of the host's texts decides at every size.
FEW_TEXTS = 3


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key, text, lang): whole rows in one column, so that no name of theirs can clash, and what tells them apart."""
    key = row_key(docs, "doc_id", "text")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"), F.col("text"), F.col("lang"))


def _joined(rows: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """rows joined with verdicts(v_key, ...); written first: their Python code and whole texts don't share an executor's memory."""
    # verdicts grow with the corpus: the same join at every size
    return rows.join(written(verdicts, "verdicts").hint("merge"), F.col("key") == F.col("v_key"), how)


def _unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no likely language, go. Ties between languages: see identify."""
    rows = _keyed(docs)
    found = identify(rows, id_col="key").where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE))
    return _unpacked(_joined(rows, found.select(F.col("doc_id").alias("v_key")).distinct(), "left_semi"), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or are depleted go; common lines leave the others' texts, but for the
    document of the smallest id of a host that holds them."""
    added = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there
    out = without_common_lines(docs, line_limit=FEW_TEXTS, added=added)
    columns = {"n_chars": F.when(F.col(added) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays; of rows equal in id and text, one."""
    rows = _keyed(docs)
    found = near_duplicates(rows, id_col="key").where("kept").select(F.col("doc_id").alias("v_key")).distinct()
    kept = _joined(rows, found, "left_semi")
    # rows below the first hashed key are alone with theirs
    several = kept.where(F.col("key") >= 1 << 62).dropDuplicates(["key"])
    return _unpacked(kept.where(F.col("key") < 1 << 62).unionByName(several), docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans leave the texts, but where they stand first by id; a document of which nothing is left goes."""
    rows = _keyed(docs)
    cut = remove_repeats(rows, id_col="key").where("n_removed > 0").select(F.col("doc_id").alias("v_key"), F.col("kept_text").alias("v_text"))
    out = _joined(rows, cut.dropDuplicates(["v_key"]), "left").where("v_key IS NULL OR v_text != ''")
    length = F.when(F.col("v_key").isNotNull(), F.length("v_text").cast("long")).otherwise(F.col("row.n_chars"))
    return _unpacked(out, docs.columns, text=F.coalesce("v_text", "text"), n_chars=length)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per piece: its document, ids and place in a sequence. Rows are packed one by one, whatever their ids."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("substring", substring),
    ("packing", packing),
]

#: SQL can't express the language network, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
