"""The corpus pipeline: which documents stay, what of their texts stays, and in which sequences they are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
one's docs. All but the last keep the columns of documents. In every stage extra columns are handed on as they are, whatever
their names; those that a stage needs besides get names that no column has. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import columns, fresh, table, written
from scholion.llm.crf import score, train
from scholion.llm.exact_dedup import exact_dedup
from scholion.llm.jaccard_join import jaccard_components
from scholion.llm.packing import pack_texts
from scholion.llm.substring_dedup import substring_dedup
from scholion.llm.tokens import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, trained on the labels, takes for good.

    Each row is judged by itself, also where rows repeat an id or a text or have no id. Null and empty texts have a score as
    any other and very long ones are judged whole. A score on the threshold is good.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs, "score", "predicted")
    return score(docs, model, keep=True, names=tuple(names)).where(F.col(names[1]) == 1).select(*columns(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id.

    Rows are told apart by a number written beside them. Null texts equal empty ones. Of rows that share the smallest id one
    stays; a null id is larger than any other.
    """
    row, lost = fresh(docs, "row_number", "lost_number")
    numbered = written(docs.select(*columns(docs), F.monotonically_increasing_id().alias(row)), "numbered")
    gone = exact_dedup(numbered, key_col=row).where("NOT kept").select(F.col(row).alias(lost))
    return numbered.join(gone, F.col(row) == F.col(lost), "left_anti").select(*columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity of 0.8 or more.

    The smallest id stays. Where rows share an id, or have none, numbers of rows take the place of ids. Null and empty
    texts, and those without words, are near to nothing and stay.
    """
    row, lost = fresh(docs, "row_number", "lost_number")
    rows, key = docs, "doc_id"
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        rows, key = written(docs.select(*columns(docs), F.monotonically_increasing_id().alias(row)), "numbered"), row
    found = jaccard_components(rows, key, n=5, percent=80)
    gone = found.where(F.col("component_id") != F.col(key)).select(F.col(key).alias(lost))
    return rows.join(gone, F.col(key) == F.col(lost), "left_anti").select(*columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of more than 50 words that documents with smaller ids hold too; other texts stay as they are.

    A document of which nothing is left goes; one that was null, empty or white from the start stays. Rows carry their other
    columns with them, so repeated rows stay as many as they are. Rows that share an id are one document, which takes nothing from
    itself; rows without an id keep all. n_chars follows the text where that was cut.
    """
    found = substring_dedup(docs, window=50, layout=True, carry=True)
    cut = F.col("n_removed") > 0
    text = F.col("row").getField("text")
    kept = found.where(~cut | (F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) != ""))
    length = F.when(cut, F.char_length(text).cast("long"))
    each = [F.col("row").getField(c) for c in docs.columns]
    return kept.select(*[(F.coalesce(length, x).cast(docs.schema[c].dataType) if c == "n_chars" else x).alias(c) for c, x in zip(docs.columns, each, strict=True)])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of a text, with its place.

    Null and empty texts have the end id alone. Only texts longer than a sequence are cut. Rows that repeat an id or have none
    are packed each by itself; equal pieces take their places in either order.
    """
    return pack_texts(docs, vocabulary("word_bpe_49k.json"), 2048, end=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier's training; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
