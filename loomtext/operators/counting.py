"""Sentences, n-gram counts, continuation statistics and the n-gram index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import ngrams as N
from loomtext.functions import segments as S


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores (one small file) is dealt out; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sentences(docs: DataFrame, key: str = "doc_id", tags: int = 3) -> DataFrame:
    """doc_id, sent (line number from 1) and tokens: lower-case words with sentence tags, one row a line that has any."""
    rows = spread(docs.select(F.col(key).alias("doc_id"), "text"))
    lined = rows.select("doc_id", F.posexplode(S.lines(F.col("text"))).alias("pos", "line"))
    tokens = lined.select("doc_id", (F.col("pos") + 1).alias("sent"), S.lower_words(F.col("line")).alias("w"))
    return tokens.where(F.size("w") > 0).select("doc_id", "sent", S.tagged(F.col("w"), tags).alias("tokens"))


def occurrences(sents: DataFrame, orders: range, boundary: int = -1) -> DataFrame:
    """n and ngram, one row an occurrence."""
    each = [_numbered(n, boundary) for n in orders]
    return sents.select(F.explode(F.flatten(F.array(*each))).alias("x")).select("x.n", "x.ngram")


def _numbered(n: int, boundary: int):
    return F.transform(N.keys(F.col("tokens"), n, boundary), lambda g: F.struct(F.lit(n).alias("n"), g.alias("ngram")))


def joined(docs: DataFrame, key: str = "doc_id", tags: int = 3) -> DataFrame:
    """doc_id and tokens: those of all sentences of a row."""
    sents = F.transform(S.lines(F.col("text")), lambda x: S.tagged(S.lower_words(x), tags))
    return spread(docs.select(F.col(key).alias("doc_id"), "text")).select("doc_id", F.flatten(sents).alias("tokens")).where(F.size("tokens") > 0)


def across(docs: DataFrame, orders: range, key: str = "doc_id", tags: int = 3) -> DataFrame:
    """N-grams that cross sentence ends within a document: doc_id, n, ngram, one row an occurrence.

    A row is the unit, as an order over all documents would put them into one task; so is a row whose doc_id others share.
    """
    each = [_numbered(n, -1) for n in orders]
    return joined(docs, key, tags).select("doc_id", F.explode(F.flatten(F.array(*each))).alias("x")).select("doc_id", "x.n", "x.ngram")


def counts(occurring: DataFrame, least: int = 1) -> DataFrame:
    """n, ngram, cnt of n-grams that occur ``least`` times or more."""
    out = occurring.groupBy("n", "ngram").agg(F.count("*").alias("cnt"))
    return out.where(F.col("cnt") >= least) if least > 1 else out


def vocabulary(counted: DataFrame) -> DataFrame:
    """Distinct words of the counted n-grams."""
    return counted.select(F.explode(F.split("ngram", " ")).alias("word")).distinct()


def _continuation(counted: DataFrame, least: int, key, prefix: str) -> DataFrame:
    """Sum of counts and how many n-grams with one key occur once, twice, more often."""
    return counted.where(F.col("n") >= least).groupBy(key.alias("ngram")).agg(
        F.sum("cnt").alias(f"{prefix}_s"),
        F.count_if(F.col("cnt") == 1).alias(f"{prefix}_n1"),
        F.count_if(F.col("cnt") == 2).alias(f"{prefix}_n2"),
        F.count_if(F.col("cnt") >= 3).alias(f"{prefix}_n3"),
    )


def followers(counted: DataFrame) -> DataFrame:
    return _continuation(counted, 2, N.history(F.col("ngram")), "nf")


def preceders(counted: DataFrame) -> DataFrame:
    return _continuation(counted, 2, N.lower_order(F.col("ngram")), "np")


def surrounders(counted: DataFrame) -> DataFrame:
    return _continuation(counted, 3, N.history(N.lower_order(F.col("ngram"))), "nfp")


STATS = [f"{p}_{s}" for p in ("nf", "np", "nfp") for s in ("s", "n1", "n2", "n3")]


def index(counted: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """n, ngram, word, history, lower, cnt and the twelve statistics (0 where absent), of all n-grams or ``only`` those with a ``key`` there.

    The statistics of all counted n-grams come from one aggregation of their (key, kind) rows, not from three
    joins: each n-gram adds to its history, its lower order and its inner part, and keeps its own count.
    """
    key = F.col("ngram")
    kinds = [("own", key, 1), ("nf", N.history(key), 2), ("np", N.lower_order(key), 2), ("nfp", N.history(N.lower_order(key)), 3)]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.col("n") >= least, g).alias("key")) for k, g, least in kinds])
    spread_out = counted.select("n", "cnt", F.explode(F.filter(rows, lambda x: x["key"].isNotNull())).alias("x")).select("n", "cnt", "x.kind", "x.key")
    if only is not None:
        spread_out = spread_out.join(only, "key", "left_semi")
    aggregates = [F.sum(F.when(F.col("kind") == "own", F.col("cnt"))).alias("cnt"), F.max(F.when(F.col("kind") == "own", F.col("n"))).alias("n")]
    for p in ("nf", "np", "nfp"):
        of = F.col("kind") == p
        aggregates += [
            F.coalesce(F.sum(F.when(of, F.col("cnt"))), F.lit(0)).alias(f"{p}_s"),
            F.count_if(of & (F.col("cnt") == 1)).alias(f"{p}_n1"),
            F.count_if(of & (F.col("cnt") == 2)).alias(f"{p}_n2"),
            F.count_if(of & (F.col("cnt") >= 3)).alias(f"{p}_n3"),
        ]
    out = spread_out.groupBy(F.col("key").alias("ngram")).agg(*aggregates).where("cnt is not null")
    return out.select("n", "ngram", N.last_word(key).alias("word"), N.history(key).alias("history"), N.lower_order(key).alias("lower"), "cnt", *STATS)


def count_of_counts(counted: DataFrame) -> DataFrame:
    """n, n_distinct, how many n-grams occur one to four and five or more times, and the total of occurrences."""
    exact = [F.count_if(F.col("cnt") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    return counted.groupBy("n").agg(F.count("*").alias("n_distinct"), *exact, F.count_if(F.col("cnt") >= 5).alias("n5p"), F.sum("cnt").alias("total"))
