"""URL filters: dated list entries, as they stood when a page was fetched.

Entries say that a pattern was put on a list or taken off it at some time. Per list and
pattern they become validity intervals. A capture is looked up under every pattern that
can match it (its host's suffixes and its path's prefixes); the interval that holds at
its fetch time, if any, says whether the pattern was listed then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peerlabel.llm.common import materialize

SALTS = 32


def epoch() -> Column:
    return F.lit("1970-01-01").cast("date")


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL; NULL where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)


def patterns_of(url: Column) -> Column:
    """Every pattern that matches a URL: for host a.b.c and path /x/y these are a.b.c, b.c,
    c, and the host with /x and /x/y. Each occurs once."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    found = F.array_distinct(F.concat(suffixes, prefixes))
    return F.when(host_of(url).isNotNull(), found).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class TemporalUrlFilter:
    """``bucket_days`` cuts captures into buckets of time, so that a frequent
    pattern with many entries is joined in many small groups. ``small`` rows at most are broadcast."""

    bucket_days: int = 30
    small: int = 500_000

    def intervals(self, entries: DataFrame) -> DataFrame:
        """(list, pattern, since, until) of ``entries`` (list, pattern, day, action).

        ``action`` is 'add' or 'remove'; other rows, and rows with a NULL, are passed over.
        The entry that holds from a day on is the last one of that day, a removal where both
        occur; repeated entries change nothing. ``until`` is exclusive, and NULL for
        what was never taken off.
        """
        daily = (
            entries.where("action IN ('add', 'remove')")
            .dropna(subset=["list", "pattern", "day"])
            .groupBy("list", "pattern", "day")
            .agg(F.max(F.col("action") == "remove").alias("removed"))
        )
        order = W.partitionBy("list", "pattern").orderBy("day")
        until = F.lead("day").over(order)
        spans = daily.select("list", "pattern", F.col("day").alias("since"), until.alias("until"), "removed")
        return spans.where("NOT removed").drop("removed")

    def matches(self, captures: DataFrame, entries: DataFrame) -> DataFrame:
        """(capture_id, list, pattern): a row for every pattern listed when a capture of
        ``captures`` (capture_id, url, fetched) was fetched.

        Captures without a host or a day match nothing. A pattern matches from the day it
        was added to the day before it was taken off.

        Patterns that no entry names are dropped first. For each bucket of time in which a pattern is
        asked for, the interval that reaches into it is carried forward to it, and those that begin in
        it are added: an entry is one row and one for each bucket asked at most, however
        long it holds. These few rows go to the captures if they are ``small``.
        """
        spans = materialize(self.intervals(entries), "url-intervals")
        asked = captures.select("capture_id", "fetched", F.explode(patterns_of(F.col("url"))).alias("pattern"))
        asked = asked.where("fetched IS NOT NULL")
        asked = self._met(asked, spans.select("pattern").distinct(), ["pattern"])
        asked = materialize(asked.withColumn("bucket", self._bucket(F.col("fetched"))), "url-asked")
        buckets = asked.select("pattern", "bucket").distinct().join(spans.select("list", "pattern").distinct(), "pattern")
        begin = F.date_add(epoch(), (F.col("bucket") * self.bucket_days).cast("int"))
        span = F.struct("since", "until")
        events = spans.select("list", "pattern", F.col("since").alias("day"), F.lit(None).cast("long").alias("bucket"), span.alias("span"))
        events = events.unionByName(buckets.select("list", "pattern", begin.alias("day"), "bucket"), allowMissingColumns=True)
        order = W.partitionBy("list", "pattern").orderBy("day", F.col("bucket").isNull())
        carried = F.last("span", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
        held = events.withColumn("held", carried).where("bucket IS NOT NULL AND held IS NOT NULL")
        held = held.where(F.col("held.until").isNull() | (F.col("held.until") > F.col("day")))
        begun = spans.withColumn("bucket", self._bucket(F.col("since")))
        relevant = held.select("list", "pattern", "bucket", "held.*").unionByName(begun)
        found = self._met(asked, materialize(relevant, "url-relevant"), ["pattern", "bucket"])
        found = found.where(F.col("since") <= F.col("fetched")).where(F.col("until").isNull() | (F.col("fetched") < F.col("until")))
        return found.select("capture_id", "list", "pattern")

    def _bucket(self, day: Column) -> Column:
        return F.floor(F.datediff(day, epoch()) / self.bucket_days)

    def _met(self, asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The join of ``asked`` with ``rows``, which go to it if they are few; else both are
        dealt out by key and a salt, so that a key of very many captures is no single task."""
        if rows.count() <= self.small:
            return asked.join(F.broadcast(rows), keys)
        salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("capture_id", "fetched"), F.lit(SALTS)).cast("int")
        return asked.withColumn("salt", salt).join(salted, [*keys, "salt"]).drop("salt")

    def verdicts(self, captures: DataFrame, entries: DataFrame, allow: str = "allow") -> DataFrame:
        """(capture_id, n_matches, lists, blocked) for every row of ``captures``.

        A capture is blocked when a list other than ``allow`` holds one of its patterns and
        ``allow`` holds none. ``lists`` is sorted and comma-joined; captures that share
        an id share a verdict, and those with a NULL id match nothing.
        """
        found = self.matches(captures, entries).groupBy("capture_id").agg(
            F.count_distinct("list", "pattern").alias("n_matches"),
            F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
            F.max(F.col("list") == allow).alias("allowed"),
            F.max(F.col("list") != allow).alias("listed"),
        )
        blocked = F.coalesce(F.col("listed") & ~F.col("allowed"), F.lit(False))
        return captures.select("capture_id").join(found, "capture_id", "left").select(
            "capture_id",
            F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
            F.coalesce("lists", F.lit("")).alias("lists"),
            blocked.alias("blocked"),
        )
