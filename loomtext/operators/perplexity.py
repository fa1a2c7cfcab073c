"""From n-gram probabilities to perplexities of lines, sentences, documents and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import ngrams as N

#: What stands for a perplexity that isn't a finite number.
NONE = 2147483647.0


def log10_of(p: Column) -> Column:
    """log10 with minus infinity for 0, where SQL has null."""
    return F.when(p > 0, F.log10(p)).otherwise(F.lit(float("-inf")))


def perplexity(total: Column, n: Column) -> Column:
    """10 to the power of minus the mean; ``NONE`` for no n-grams and for anything that isn't finite."""
    value = F.when((n > 0) & (total > float("-inf")), F.pow(F.lit(10.0), -total / n))
    return F.coalesce(F.when(value < float("inf"), value), F.lit(NONE))


def score_sentences(sents: DataFrame, scored: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, sent, pos, ngram, log10p and oov_last, one row an n-gram; each distinct n-gram was scored once."""
    each = sents.select("doc_id", "sent", F.posexplode(N.keys(F.col("tokens"), order)).alias("pos", "ngram"))
    return each.join(scored, "ngram").select("doc_id", "sent", "pos", "ngram", log10_of(F.col("p")).alias("log10p"), "oov_last")


def summarize(scores: DataFrame, *keys: str) -> DataFrame:
    """num_ngrams, num_oov, sums of log10 and perplexities, with and without n-grams that end in an unknown word, by ``keys``."""
    known = F.sum(F.when(~F.col("oov_last"), F.col("log10p")))
    out = scores.groupBy(*keys).agg(F.count("*").alias("num_ngrams"), F.count_if("oov_last").alias("num_oov"), F.coalesce(F.sum("log10p"), F.lit(0.0)).alias("log10p"), F.coalesce(known, F.lit(0.0)).alias("log10p_noov"))
    return out.withColumns({"perp": perplexity(F.col("log10p"), F.col("num_ngrams")), "perp_noov": perplexity(F.col("log10p_noov"), F.col("num_ngrams") - F.col("num_oov"))})


def sentence_normalized(scores: DataFrame, *keys: str) -> DataFrame:
    """Perplexity of the mean over sentences of the mean log10."""
    means = scores.groupBy(*keys, "sent").agg(F.avg("log10p").alias("m"))
    return means.groupBy(*keys).agg(F.count("*").alias("num_sentences"), F.pow(F.lit(10.0), -F.avg("m")).alias("perp"))


def entropy_perplexity(times: Column | None = None) -> Column:
    """2 to the entropy of a count column's distribution, as an aggregate over its rows, each of which stands for ``times`` equal ones."""
    c = F.col("cnt").cast("double")
    of = c if times is None else c * times
    return F.pow(F.lit(2.0), F.log2(F.sum(of)) - F.sum(of * F.log2(c)) / F.sum(of))


def filter_lines(lines: DataFrame, most: float = 1000.0) -> DataFrame:
    """Lines of which fewer than half of the n-grams end in unknown words and whose perplexity is at most ``most``."""
    return lines.where((F.col("num_oov") * 2 < F.col("num_ngrams")) & (F.col("perp") <= most))


def sanitize(perp: Column) -> Column:
    """-1 for whatever isn't finite or is at most 1."""
    return F.when((perp > 1) & (perp < NONE), perp).otherwise(F.lit(-1.0))


def crawl_perplexity(scores: DataFrame, *keys: str, order: int = 3) -> DataFrame:
    """Perplexity of documents while crawling: only sentences count that have n-grams and whose last one has full order."""
    last = F.max_by("ngram", "pos").over(Window.partitionBy(*keys, "sent"))
    whole = scores.withColumn("last", last).where(F.size(F.split("last", " ")) == order)
    return summarize(whole, *keys)


def padded(perp: Column) -> Column:
    """As crawl logs hold it: sanitized, twelve characters, leading zeros."""
    return F.format_string("%012g", sanitize(perp))


def below(perp: Column, most: float = 1e4) -> Column:
    """Whether a logged value is a number under the threshold."""
    value = perp.try_cast("double")
    return value.isNotNull() & ~F.isnan(value) & (value < most)
