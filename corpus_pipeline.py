"""A corpus pipeline: quality, near duplicates, benchmarks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's
result as Parquet to the shared folder and reads it back as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlabel.llm.bpe import BpeCodec
from peerlabel.llm.common import remove, scratch, shared_dir, table
from peerlabel.llm.decontaminate import Decontaminator
from peerlabel.llm.ngram_join import NgramJoin
from peerlabel.llm.pii import PiiFinder
from peerlabel.llm.quality import QualityRules
from peerlabel.llm.queries import WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    return QualityRules().judge(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Documents without words or without an id are no one's duplicates and stay. Rows that
    share an id are documents of their own: each stays or goes by its own text.
    """
    return NgramJoin().one_of_each(docs.select(*COLUMNS))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that test items do not contaminate, as they are."""
    finder = Decontaminator()
    hits = finder.hits(docs, table(spark, sf_dir, "benchmark"), keep=("lang", "source", "n_chars"))
    return hits.where("NOT contaminated").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind; ``n_chars`` follows."""
    finder = PiiFinder()
    found = finder.find(docs, finder.train(docs), redact=True, keep=("lang", "source", "n_chars"))
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of every document; the last is the
    digest of what the ids decode to."""
    coded = BpeCodec(public_tokenizers.path(WORD_BPE)).round_trip(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = (
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmarks),
    ("personal data", personal_data),
    ("BPE encoding and decoding", tokens),
)

# The personal-data stage decodes a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages leave in the shared folder, and each one's
    result once the next has been made from it, is removed."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
