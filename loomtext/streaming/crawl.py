"""The crawl as streams: priorities as pages arrive, running statistics, and a limit on domains.

All take a streaming table and return one; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.functions import segments as S
from loomtext.functions import text as X
from loomtext.operators import counting, frontier


def priorities(links: DataFrame) -> DataFrame:
    """Stateless: directive, cost and rejected of each link with a perplexity."""
    return frontier.prioritize(links)


def windowed_stats(scores: DataFrame, ts: str = "ts", value: str = "value", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Number, minimum, maximum and mean of each window of event time; rows later than ``late`` are dropped."""
    return scores.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def ngram_counts(docs: DataFrame, orders: range = range(1, 4)) -> DataFrame:
    """Running counts of n-grams of the lines that arrive (doc_id, text), for complete or update mode."""
    lined = docs.select(F.explode(S.lines(F.col("text"))).alias("line")).select(S.tagged(S.lower_words(F.col("line"))).alias("tokens"))
    return counting.counts(counting.occurrences(lined.where(F.size("tokens") > 0), orders))


_LAST = "key string, n long, low double, high double, mean double, last array<double>"


def last_values(scores: DataFrame, key: str, value: str, keep: int = 100, ttl: str = "1 hour") -> DataFrame:
    """Running number, minimum, maximum and mean of each key, and its last ``keep`` values in order of arrival; a key's state is dropped after ``ttl`` without rows."""

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, low, high, total, last = state.get if state.exists else (0, float("inf"), float("-inf"), 0.0, [])
        last = list(last)
        for batch in batches:
            values = batch["value"].dropna().tolist()
            n, total = n + len(values), total + sum(values)
            low, high = min([low, *values]), max([high, *values])
            last = (last + values)[-keep:]
        state.update((n, low, high, total, last))
        state.setTimeoutDuration(_milliseconds(ttl))
        yield pd.DataFrame({"key": [group[0]], "n": [n], "low": [low], "high": [high], "mean": [total / n if n else None], "last": [last]})

    rows = scores.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, _LAST, "n long, low double, high double, total double, last array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def new_domains(pages: DataFrame) -> DataFrame:
    """domain and url of the first page of each domain, once each."""
    named = pages.select(X.domain(F.col("url")).alias("domain"), "url")

    def first(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        url: Any = min(u for b in batches for u in b["url"])
        if not state.exists:
            state.update((url,))
            yield pd.DataFrame({"domain": [group[0]], "url": [url]})

    return named.groupBy("domain").applyInPandasWithState(first, "domain string, url string", "url string", "append", GroupStateTimeout.NoTimeout)
