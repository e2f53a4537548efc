"""Quality rules with thresholds that adapt to each language and source.

Every document gets counts by fixed rules. The counts of each (language, source) go
into mergeable quantile sketches; their quantiles are the thresholds of that group,
joined back to its documents. Every group is judged by its own sketch, to which its language
adds a fixed number of rows (and all rows to the language): they steady small groups and
fade as a group grows. Word lengths are never taken from another language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlabel.llm import bytewords
from peerlabel.llm.common import materialize

WINDOW = 8
GRID = 128  # quantiles of a sketch that stand for its scores; 1/2 and 3/4 are among them
LIMITS = "__limits"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CONTINUES = (np.arange(256) & 0xC0) == 0x80


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of its texts; columns of those names are replaced.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word, equal to an earlier one) and n_repeat_words (words in runs of 8 that occur
    more than once, first time included). NULL and empty texts count 0 throughout.
    """
    others = [c for c in docs.columns if c not in COUNTS]
    schema = docs.select(*(F.col(f"`{c}`") for c in others)).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    at = others.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = count(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(made[c]) for c in COUNTS)], [*others, *COUNTS]
            )

    return docs.select(*(F.col(f"`{c}`") for c in others)).mapInArrow(run, schema)


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    for words in bytewords.split(texts, bytewords.NOT_SPACE):
        rows = slice(words.row0, words.row0 + len(words))
        inside = bytewords.NOT_SPACE[words.data]
        out["n_words"][rows] = np.diff(words.first)
        out["word_chars"][rows] = per_text(inside & ~CONTINUES[words.data], words.bounds)
        out["n_symbols"][rows] = per_text(SYMBOLS[words.data], words.bounds)
        lines = duplicate_lines(words)
        repeats = repeated_words(words)
        out["n_dup_lines"][rows] = lines
        out["n_repeat_words"][rows] = repeats
    return out


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def duplicate_lines(words: bytewords.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data, bounds = words.data, words.bounds
    if not len(data):
        return np.zeros(len(words), np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    texts = np.flatnonzero(np.diff(bounds))
    start = np.union1d(breaks + 1, bounds[texts])
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 0x0A)  # without the line break itself
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    of = np.searchsorted(bounds, start, "right") - 1
    hashes = bytewords.span_hash(data, start, end)
    order = np.lexsort((hashes, of))
    same = (of[order][1:] == of[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return np.bincount(of[order][1:][same], minlength=len(words))


def repeated_words(words: bytewords.Words) -> np.ndarray:
    """Words inside runs of WINDOW words that occur at least twice in their text."""
    out = np.zeros(len(words), np.int64)
    runs = bytewords.run_hash(words.hash, WINDOW)
    if not len(runs):
        return out
    of = np.repeat(np.arange(len(words)), np.diff(words.first))
    whole = np.flatnonzero(of[: len(runs)] == of[WINDOW - 1 :])
    # Runs of different texts differ by the text's number, so one sort serves all.
    keys = bytewords.mix(runs[whole] + of[whole].astype(np.uint64) * np.uint64(bytewords.BASE))
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    twice = np.append(False, same) | np.append(same, False)
    begins = whole[order[twice]]
    depth = np.zeros(len(words.hash) + 1, np.int32)
    np.add.at(depth, begins, 1)
    np.add.at(depth, begins + WINDOW, -1)
    covered = np.cumsum(depth[:-1]) > 0
    return np.bincount(of[covered], minlength=len(words))


@dataclass(frozen=True)
class Measure:
    """A whole-number score of a document; the larger, the odder.

    A group's threshold lies in the middle of the first wide gap above the bulk of its scores
    (see ``QualityRules.thresholds``). ``least_spread`` is the spread of a bulk whose scores
    are all alike. What is usual ``of_language`` tells nothing about other languages:
    there a language with few rows needs a wider gap instead of rows of others.
    """

    name: str
    expression: str
    least_spread: int
    of_language: bool = False


# Scores are shares of a thousand, or thousandths, so that sketches hold integers.
WORD_LENGTH = "word_chars * 1000 DIV greatest(n_words, 1)"
MEASURES = (
    Measure("symbols", "n_symbols * 1000 DIV greatest(word_chars, 1)", 5),
    Measure("dup_lines", "n_dup_lines * 1000 DIV greatest(n_words, 1)", 10),
    Measure("repeats", "n_repeat_words * 1000 DIV greatest(n_words, 1)", 40),
    Measure("long_words", WORD_LENGTH, 50, of_language=True),
    Measure("short_words", f"- ({WORD_LENGTH})", 50, of_language=True),
)
BULK = 0.75  # share of a group's rows that is never odd


@dataclass(frozen=True)
class QualityRules:
    """``gap``: how many times the spread of the bulk a gap has to be wide. ``min_rows``: a
    tenth as many rows of its language count with the rows of each (language, source), and of
    all rows with those of each language, as if they were its own. ``k`` is the sketches' size:
    quantiles are exact up to about k documents a group, beyond that their rank is off by
    about 1.7 / k of the group's documents.
    """

    min_rows: int = 200
    k: int = 4096
    gap: int = 6
    min_words: int = 20
    max_repeat_percent: int = 30
    measures: tuple[Measure, ...] = MEASURES

    def scored(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with counts, ``base_failed`` and a score per measure (``m_<name>``)."""
        counted = with_counts(docs, text_col)
        failed = (F.col("n_words") < self.min_words) | (
            100 * F.col("n_repeat_words") > self.max_repeat_percent * F.col("n_words")
        )
        scores = {f"m_{m.name}": F.expr(m.expression).cast("long") for m in self.measures}
        return counted.withColumn("base_failed", failed).withColumns(scores)

    def thresholds(self, scored: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
        """(lang, source, rows, level, t_<name>...): one row for each group of documents
        that pass the base rules, NULL being a language or source of its own.

        The scores of a group are ``GRID`` quantiles of its sketch, and of its language's and
        all rows' with the weight of the rows lent. Above the value that ``BULK`` of them do not
        exceed, the first step from one score to the next that is ``gap`` times as wide as
        the spread (from the median to the end of the bulk) or wider is a gap; the threshold
        is its middle. NULL is no threshold: no score of the group stands out.

        Sketches are built per task and merged by group, so a group that holds most of
        the documents is no larger in the shuffle than any other.
        """
        k = F.lit(self.k)
        passed = scored.where(~F.col("base_failed"))
        groups = passed.groupBy(F.col(lang_col).alias("lang"), F.col(source_col).alias("source")).agg(
            F.count(F.lit(1)).alias("rows"),
            *(F.kll_sketch_agg_bigint(f"m_{m.name}", k).alias(m.name) for m in self.measures),
        )
        groups = materialize(groups, "quality-sketches")
        merged = [F.kll_merge_agg_bigint(m.name, k).alias(m.name) for m in self.measures]
        rows = F.sum("rows").alias("rows")
        langs = self._named(groups.groupBy("lang").agg(rows, *merged), "l_").withColumnRenamed("l_lang", "of")
        every = self._named(groups.agg(rows, *merged), "a_")
        levels = groups.join(langs, groups["lang"].eqNullSafe(langs["of"])).join(F.broadcast(every))
        limits = [self._threshold(m).alias(f"t_{m.name}") for m in self.measures]
        own, lang = F.col("rows") >= self.min_rows, F.col("l_rows") >= self.min_rows
        # Says how far the rows of a group go; no threshold depends on it.
        level = F.when(own, "source").when(lang, "language").otherwise("all").alias("level")
        return levels.select("lang", "source", "rows", level, *limits)

    def _threshold(self, m: Measure) -> Column:
        lent = self.min_rows / 10
        if m.of_language:
            parts = [("", F.col("rows")), ("l_", F.lit(lent))]
        else:
            whole = F.col("l_rows") + lent
            parts = [("", F.col("rows")), ("l_", lent * F.col("l_rows") / whole), ("a_", lent * lent / whole)]
        grid = F.array(*(F.lit(i / GRID) for i in range(1, GRID + 1)))

        def weighted(values, weight):
            return F.transform(values, lambda v: F.struct(v.alias("value"), weight.cast("double").alias("weight")))

        each = [weighted(F.kll_sketch_get_quantile_bigint(prefix + m.name, grid), weight) for prefix, weight in parts]
        total = GRID * sum((weight for _, weight in parts[1:]), parts[0][1])
        wider = F.col("l_rows") if m.of_language else F.lit(None).cast("long")
        return self._gap(F.sort_array(F.concat(*each)), total, m.least_spread, wider)

    def _gap(self, points: Column, total: Column, least_spread: int, lang_rows: Column) -> Column:
        """The middle of the first gap of sorted (value, weight) points."""
        none = F.lit(None).cast("long")

        def add(seen, point):
            weight, value = seen["weight"] + point["weight"], point["value"]
            spread = F.greatest(seen["bulk"] - seen["median"], F.lit(least_spread).cast("long"))
            # A language of few rows tells little: the size of its scores counts as spread.
            wider = F.coalesce(F.floor(F.abs(seen["bulk"]) * self.min_rows / lang_rows), F.lit(0).cast("long"))
            far = seen["bulk"].isNotNull() & (value - seen["last"] >= self.gap * spread + wider)
            return F.struct(
                weight.alias("weight"),
                value.alias("last"),
                F.coalesce(seen["median"], F.when(weight >= 0.5 * total - 1e-6, value)).alias("median"),
                F.coalesce(seen["bulk"], F.when(weight >= BULK * total - 1e-6, value)).alias("bulk"),
                F.coalesce(seen["middle"], F.when(far, seen["last"] + F.floor((value - seen["last"]) / 2))).alias("middle"),
            )

        start = F.struct(F.lit(0.0).alias("weight"), *(none.alias(c) for c in ("last", "median", "bulk", "middle")))
        return F.aggregate(points, start, add, lambda seen: seen["middle"])

    def _named(self, df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))

    def judge(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
        """``docs`` with the counts, ``base_failed`` and ``kept``.

        The base rules always reject. Of the rest, a document is rejected when a score is
        beyond its group's threshold. Repeated rows
        and NULLs stay and count; an empty table gives an empty one. Columns of the
        names made here (scores ``m_<name>`` too, which are left out) are replaced.
        """
        scored = self.scored(docs, text_col)
        limits = materialize(self.thresholds(scored, lang_col, source_col), "quality-limits")
        return self.verdicts(scored, limits, lang_col, source_col)

    def verdicts(self, scored: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
        """Scored documents with ``kept`` by the thresholds of their groups."""
        limits = limits.select(F.struct(*limits.columns).alias(LIMITS))
        of = F.col(LIMITS)
        same = scored[lang_col].eqNullSafe(of["lang"]) & scored[source_col].eqNullSafe(of["source"])
        judged = scored.join(self._sized(limits), same, "left")
        beyond = F.lit(False)
        for m in self.measures:
            beyond = beyond | F.coalesce(F.col(f"m_{m.name}") > of[f"t_{m.name}"], F.lit(False))
        kept = ~F.col("base_failed") & ~beyond
        made = {"kept", *(f"m_{m.name}" for m in self.measures)}
        return judged.select(*(F.col(f"`{c}`") for c in scored.columns if c not in made), kept.alias("kept"))

    @staticmethod
    def _sized(limits: DataFrame, most: int = 100_000) -> DataFrame:
        """Broadcast while there are at most ``most`` groups; else the join shuffles."""
        return F.broadcast(limits) if limits.count() <= most else limits
