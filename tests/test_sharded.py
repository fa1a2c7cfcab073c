"""Statistics by hash against those that have a row for each n-gram."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import counting, sharded
from loomtext.plans import catalog


@pytest.fixture(scope="module")
def text(spark):
    rng = random.Random(5)
    words = ["a", "b", "ab", "ba", "é", "日本", "straße", "cc", "c"]
    made = ["\n".join(" ".join(rng.choices(words, range(1, 10), k=rng.randint(1, 12))) for _ in range(4)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(made), (900, None), (901, ""), (902, made[0])], "doc_id long, text string")
    sents = counting.sentences(docs).cache()
    return docs, sents, counting.counts(counting.occurrences(sents, range(1, 5))).cache()


@pytest.mark.parametrize("most", [8_000_000, 50])
@pytest.mark.parametrize("batch", [2_000_000, 100])
def test_statistics_are_those_of_the_index(spark, text, monkeypatch, most, batch):
    monkeypatch.setattr(sharded, "MOST_KEYS", most)
    monkeypatch.setattr(sharded, "BATCH_WORDS", batch)
    docs, sents, counted = text
    keys = counted.where("n <= 3 and hash(ngram) % 2 = 0").select("ngram").union(spark.createDataFrame([("no such",), ("z",), ("a b a b a b",)], "ngram string"))
    histogram, found = sharded.statistics(sents, 4, sharded.shards(docs), keys, range(1, 3))
    want = counting.index(counted).join(keys.distinct(), "ngram").select("ngram", *sharded.STATS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    made = sharded.count_of_counts(histogram)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, counting.count_of_counts(counted).where("n < 3").select(*made.columns).collect()))


def test_counts_of_all_orders_without_keys(spark, text):
    docs, sents, counted = text
    histogram, none = sharded.statistics(sents, 4, 3)
    assert none is None
    assert sorted(map(tuple, histogram.select("n", "cnt", "times").collect())) == sorted(map(tuple, counted.groupBy("n", "cnt").count().collect()))
    empty, found = sharded.statistics(sents.where("doc_id < 0"), 4, 3, spark.createDataFrame([("a",)], "ngram string"))
    assert empty.count() == 0 and found.count() == 0


def _no_rows(monkeypatch):
    def never(*_):
        raise AssertionError("a row an n-gram")

    monkeypatch.setattr(counting, "occurrences", never)


@pytest.mark.parametrize("name", ["kn_fivegram", "mkn_fivegram_auto", "order_model_pivot", "lm_mle", "lm_static_unknown", "doc_perplexity", "arpa_score", "distribution_perplexity", "count_of_counts", "kn_discounts"])
def test_models_make_no_row_for_each_ngram_of_the_corpus(spark, sf_dir, monkeypatch, name):
    _no_rows(monkeypatch)
    assert catalog.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4], [0, 1, 1, None, None], [None, 1, 2, 3, 4]])
def test_ngrams_across_sentences_are_counted_within_rows(spark, ids):
    texts = ["a b a b\na b", "a b c\nd", "a b c\r\n\nq", "é ß", ""]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want = counting.across(docs, range(2, 4)).groupBy("doc_id", "n").agg(F.count("*"), F.countDistinct("ngram"))
    assert sorted(map(tuple, sharded.across_counts(docs, range(2, 4)).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rows_with_ids_of_their_own_have_no_row_for_each_ngram(spark, sf_dir, monkeypatch):
    def never(*_):
        raise AssertionError("a row an n-gram")

    monkeypatch.setattr(counting, "across", never)
    assert catalog.queries()["ngram_across"](spark, sf_dir).count() > 0
