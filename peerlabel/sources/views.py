"""Labelled views over the star-schema and document tables."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Label order and the stop words that mark the languages.
LANGUAGES = ("de", "en", "es", "fr")
STOP_WORDS = ("the", "der", "el", "le", "und", "los", "les", "and")
COUNTED = (" the ", " der ", " el ", " le ", " und ", " los ", " les ", " and ", "qu", "ch", "th", "ie", "ó", "é", "ü", "ñ")
MOST_COUNTED = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _language_label():
    label = F.when(F.col("lang") == LANGUAGES[0], 0)
    for i, lang in enumerate(LANGUAGES[1:], start=1):
        label = label.when(F.col("lang") == lang, i)
    return label.cast("int")


def flags_of(documents: DataFrame) -> DataFrame:
    """``(row_id, code, label)``: ``code`` has one bit per stop word in the text."""
    code = None
    for bit, word in enumerate(STOP_WORDS):
        flag = F.when(F.col("text").contains(f" {word} "), F.lit(1 << bit)).otherwise(F.lit(0))
        code = flag if code is None else code + flag
    return documents.select(
        F.col("doc_id").alias("row_id"), code.alias("code"), _language_label().alias("label")
    )


def docs_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_of(table(spark, sf_dir, "documents"))


def _hashed_words(rows: DataFrame, n_features: int) -> DataFrame:
    words = rows.withColumn("_words", F.split(F.lower("text"), r"\s+"))
    counts = HashingTF(numFeatures=n_features, inputCol="_words", outputCol="features")
    return counts.transform(words).drop("_words")


def docs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, text, label)``: whole texts and their language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "text", _language_label().alias("label")
    )


def word_features(rows: DataFrame, n_features: int = 64) -> DataFrame:
    """``rows`` with hashed word counts in ``features`` instead of ``text``; row by row."""
    return _hashed_words(rows, n_features).drop("text")


def docs_lang(spark: SparkSession, sf_dir: str, n_features: int = 64) -> DataFrame:
    """``(row_id, features, label)``: hashed word counts of the whole text, language."""
    return word_features(docs_text(spark, sf_dir), n_features).select("row_id", "features", "label")


def docs_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs_flags`` with ``features``, a vector with a one at the row's code."""
    n_codes = 1 << len(STOP_WORDS)
    codes = spark.range(n_codes).select(F.col("id").cast("double").alias("_code"))
    encoder = OneHotEncoder(inputCols=["_code"], outputCols=["features"], dropLast=False).fit(codes)
    return encoder.transform(docs_flags(spark, sf_dir).withColumn("_code", F.col("code").cast("double"))).drop("_code")


def docs_flag_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs_flags`` with ``features``, a vector of the flags themselves."""
    flags = F.array(*[(F.shiftright("code", bit) % 2).cast("double") for bit in range(len(STOP_WORDS))])
    return docs_flags(spark, sf_dir).withColumn("features", array_to_vector(flags))


def docs_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, features, label)``: how often some short strings occur in the text, 15 at most."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def count(part: str):
        left = F.length(F.replace(text, F.lit(part), F.lit("")))
        return F.least(F.floor((F.length(text) - left) / len(part)), F.lit(MOST_COUNTED)).cast("double")

    features = F.array(*[count(part) for part in COUNTED])
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), features.alias("features"), _language_label().alias("label")
    )


def docs_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, features, label)``: text statistics; label NULL where not annotated."""
    text = F.col("text")
    length = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(pattern):
        return F.length(F.regexp_replace(text, pattern, "")) / length

    n_words = F.size(F.split(text, r"\s+")).cast("double")
    n_lines = F.size(F.split(text, "\n")).cast("double")
    statistics = F.array(
        F.log1p(length),
        F.log1p(n_words),
        length / n_words,
        n_lines / n_words,
        share(r"[^\p{L}]"),
        share(r"[^0-9]"),
        share(r"[^\p{Punct}]"),
        share(r"[^\p{Lu}]"),
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", statistics.alias("_numbers"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), array_to_vector("_numbers").alias("features"), "label"
    )


def emb_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, features, label)`` of the embeddings: labels without signal."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("int"),
    )


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two text columns, as a raw feature table stores them: numbers and a label."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            ",",
            F.col("l_linenumber").cast("string"),
            F.col("l_quantity").cast("int").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
        ).alias("features"),
        (F.col("l_linenumber") - 1).cast("string").alias("label"),
    )


def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))


def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))


def order_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, weight)``: orders by their price."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("weight"))
