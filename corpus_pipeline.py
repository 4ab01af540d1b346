"""The corpus pipeline: five stages over the documents, each written and read again.

What a stage decides of a row is told from the row's own text by a fitted model, as a column beside the others, or is a list of
rows to drop. Texts stay where they are: see drop_rows for lists that are too long to send.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfix.llm.bayes import fit_languages, language_bars, language_verdict
from skyfix.llm.decontamination import contaminated_rows
from skyfix.llm.mixing import mixed_documents
from skyfix.llm.ngram_join import component_rows
from skyfix.llm.quality_model import fit_quality, quality_verdict
from skyfix.llm.shared import cut, documents, drop_rows, perhaps_among, row_keys, spare_name

#: A document whose language is predicted with less posterior than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Each row is judged by its own text: null and empty texts as texts without words, null and repeated ids like any others.
    Columns stay as they are, whatever their names; an empty table gives none.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_verdict(docs, model, "text")["predicted"] == 1)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, and whose n-grams are less unusual in it than those of half the texts of other languages
    are there (language_bars), so that texts in languages or alphabets that were not learnt go.

    Each row is judged by its own text; null, empty and letterless texts go. Null and repeated ids are like any others.
    Columns stay as they are, whatever their names; an empty table gives none.
    """
    name = spare_name(docs, "language_verdict")
    model = fit_languages(docs)
    told = docs.select("*", language_verdict(docs, model).alias(name))
    kept = (F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)
    bars = language_bars(docs, model)
    if bars:
        bar = F.create_map(*(F.lit(x) for pair in bars.items() for x in pair))[F.col(name)["lang_pred"]]
        kept = kept & (F.col(name)["surprise"] <= F.coalesce(bar, F.lit(float("inf"))))
    return told.where(kept).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; rows that repeat it whole stay once.

    Null and empty texts are like nothing and stay; so do rows without doc_id, which can stand for no group. Rows that share a
    doc_id are judged each by its own text. Columns stay as they are, whatever their names; an empty table gives none.
    """
    rows = component_rows(docs)
    kept = drop_rows(docs, cut(rows.where("not is_first").select("key_a", "key_b").distinct(), "dropped"))
    again = cut(rows.where("id is not null").groupBy("key_a", "key_b").count().where("count > 1").select("key_a", "key_b"), "repeated")
    if again.isEmpty():
        return kept
    names = [spare_name(docs, n) for n in ("key_a", "key_b")]
    named = kept.select("*", *(k.alias(n) for k, n in zip(row_keys("doc_id", "text"), names, strict=True)))
    few = perhaps_among(named, again.toDF(*names), names).join(again.toDF(*names), names, "left_semi").dropDuplicates(names).select(docs.columns)
    return drop_rows(kept, again).unionByName(few)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Each row is judged by its own text, and null and empty ones stay; null and repeated ids are like any others. Columns stay
    as they are, whatever their names; an empty table gives none.
    """
    return drop_rows(docs, contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy or more in the mix, and their rate and copies (columns of these names are replaced).

    Documents that labels call toxic go, whatever the classifier says of them. Each other row is rated by its own text, null
    and empty ones as texts without words; a row without doc_id has no label. Other columns stay as they are, whatever their
    names; an empty table gives none.
    """
    return mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ban=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: The quality and mixing stages are fitted models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
