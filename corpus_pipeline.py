"""The corpus pipeline: documents through five of the operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import decontaminate, langid, ngram_join, pieces, secrets
from tidewake.llm.common import keep, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the models explain; the others go: null and empty texts, texts without a letter, and those that
    exceed their language's calibrated limit.

    The models learn from docs' own labelled rows. Rows are judged by their texts alone: null or equal doc_ids and repeated rows
    don't matter, a very long text is scored whole, an empty table stays empty, and columns of any name are kept.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8 or more, over any number of links): one with the least doc_id,
    null last; of rows equal in doc_id and text, one.

    Texts without a word belong to no group and stay, all of them. Decisions fall on rows, not doc_ids: other texts under the
    same or a null doc_id stay. A very long text is one set; an empty table stays empty; columns of any name are kept.
    """
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of ten words of the benchmark (or a whole shorter item); the others go, and only they.

    Null, empty and wordless texts stay; equal texts share a verdict, whatever their doc_ids; an empty benchmark drops
    nothing; a very long text is scanned whole; an empty table stays empty; columns of any name are kept.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, the secrets in their texts replaced by a mark and n_chars counted anew; overlapping secrets get one mark.

    Null texts stay null, empty ones empty; every row is worked on alone, so ids, repeats and ties don't matter; texts with
    very many secrets take time in proportion; an empty table stays empty; columns of any name are kept.
    """
    return secrets.redact(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip (decoding gives the text) of every row, repeated ones included.

    Null and empty texts have no ids; null doc_ids stay null; very long texts go by chunks with the same result; an empty
    table gives no rows; other columns are left out, whatever their names.
    """
    return pieces.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece_encoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}

#: SQL can't express the language models, the components or the segmentation.
ORACLE_SQL = None
