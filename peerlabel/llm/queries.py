"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlabel.llm import warc
from peerlabel.llm.bpe import BpeCodec
from peerlabel.llm.chat_format import ChatFormatter, loss_text, parse
from peerlabel.llm.common import materialize, table
from peerlabel.llm.decontaminate import Decontaminator
from peerlabel.llm.filter_audit import FilterAudit
from peerlabel.llm.hard_negatives import HardNegatives
from peerlabel.llm.html_text import HtmlExtractor
from peerlabel.llm.ngram_join import NgramJoin
from peerlabel.llm.pii import PiiFinder
from peerlabel.llm.quality import QualityRules
from peerlabel.llm.sharding import HilbertSharder, sized
from peerlabel.llm.token_counts import TokenCounter
from peerlabel.llm.url_filters import TemporalUrlFilter, host_of

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HtmlExtractor().extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = TokenCounter(public_tokenizers.path(BYTE_BPE))
    return counter.counts(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin().components(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BpeCodec(public_tokenizers.path(WORD_BPE)).digests(table(spark, sf_dir, "documents"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents"))
    return HilbertSharder().assign(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return Decontaminator().hits(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    finder = PiiFinder()
    found = finder.find(docs, finder.train(docs))
    by_rule = F.filter("spans", lambda s: s["rule"])

    def number(kind: str):
        return F.size(F.filter(by_rule, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        number("email"),
        number("ip"),
        number("card"),
        number("phone"),
        F.sha2(listed(by_rule), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = QualityRules().judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures (capture_id, url, fetched): pages have no time, so a hash gives the day."""
    day = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("int") % 1460
    fetched = F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries (list, pattern, day, action) about the hosts of ``pages``.

    A hash of the pattern decides: a third of the hosts is on ``spam`` from some day, half of
    these only for a time; a fifth of the sections (host and first step of the path) comes
    and goes on ``adult``; each domain (last two labels) is on ``allow`` for some months.
    """
    host = host_of(F.col("url"))
    section = F.concat(host, F.lit("/"), F.split(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "/")[0])
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    named = pages.select(
        F.explode(
            F.array(
                F.struct(F.lit("spam").alias("list"), host.alias("pattern")),
                F.struct(F.lit("adult").alias("list"), section.alias("pattern")),
                F.struct(F.lit("allow").alias("list"), F.when(F.size(F.split(host, r"\.")) >= 2, domain).alias("pattern")),
            )
        ).alias("entry")
    ).select("entry.list", "entry.pattern")
    named = named.where("pattern IS NOT NULL AND pattern NOT LIKE '%/'").distinct()
    digest = F.md5(F.concat_ws(":", "list", "pattern").cast("binary"))

    def part(at: int, most: int):
        return (F.conv(F.substring(digest, at, 6), 16, 10).cast("int") % most).cast("int")

    every = F.when(F.col("list") == "spam", 3).when(F.col("list") == "adult", 5).otherwise(1)
    chosen = named.select(
        "list", "pattern", part(1, 1 << 24).alias("choice"), part(7, 1200).alias("begin"), part(13, 300).alias("length"),
        part(19, 2).alias("ends"), every.alias("every"),
    ).where("choice % every = 0")
    start = F.lit("2020-01-01").cast("date")
    added = chosen.select("list", "pattern", F.date_add(start, F.col("begin")).alias("day"), F.lit("add").alias("action"))
    removed = chosen.where("ends = 1 OR list <> 'spam'").select(
        "list", "pattern", F.date_add(start, F.col("begin") + F.col("length")).alias("day"), F.lit("remove").alias("action")
    )
    return added.unionByName(removed)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    verdicts = TemporalUrlFilter().verdicts(captures_of(pages), entries_of(pages))
    return verdicts.withColumnRenamed("capture_id", "page_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"))

    def key(column: str):
        # Records of pages without an id have one of their own making, which is not theirs.
        return F.regexp_extract(column, r"^urn:record:(-?[0-9]+)$", 1).try_cast("long")

    return records.select(
        key("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), key("refers_to")).alias("refers_to"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FilterAudit().audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HardNegatives().mine(table(spark, sf_dir, "embeddings"))


def conversations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one more, -7, whose texts hold every kind of control string."""
    text = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = ChatFormatter().format(conversations_of(spark, sf_dir))
    written = materialize(formatted, "formatted")  # what follows is read back from it
    read = written.select("conv_id", "formatted", "round_trip", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    listed = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


REGISTERED = (
    op1_html_text,
    op2_token_counts,
    op3_ngram_jaccard,
    op4_bpe_round_trip,
    op5_hilbert_shards,
    op6_decontaminate,
    op7_personal_data,
    op8_quality_rules,
    op9_url_filters,
    op10_warc,
    op11_filter_audit,
    op12_hard_negatives,
    op13_chat_format,
)
