"""Statistics from windows against those that have a row for each n-gram."""

import random

import pytest

from loomtext.operators import counting, models, sharded, windows
from loomtext.plans import catalog


@pytest.fixture(scope="module")
def text(spark):
    rng = random.Random(5)
    words = ["a", "b", "ab", "ba", "é", "日本", "straße", "cc", "c"]
    made = ["\n".join(" ".join(rng.choices(words, range(1, 10), k=rng.randint(1, 12))) for _ in range(4)) for _ in range(60)]
    sents = counting.sentences(spark.createDataFrame([*enumerate(made), (900, None), (901, "")], "doc_id long, text string")).cache()
    return sents, counting.counts(counting.occurrences(sents, range(1, 4))).cache()


@pytest.mark.parametrize("name,batch", [("followers", 2_000_000), ("preceders", 100), ("surrounders", 100), ("counts", 100), ("index", 100), ("index", 2_000_000)])
def test_windows_give_the_same_rows(spark, text, monkeypatch, name, batch):
    monkeypatch.setattr(sharded, "BATCH_WORDS", batch)
    sents, counted = text
    want = counted if name == "counts" else getattr(counting, name)(counted)
    got = getattr(windows, name)(sents, 5)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_nothing_comes_of_no_sentences(text):
    none = text[0].where("doc_id < 0")
    assert windows.index(none, 3).count() == windows.counts(none, 3, 2).count() == windows.preceders(none, 3).count() == 0


@pytest.mark.parametrize("name", ["nfollow", "nprecede", "nfollowerprecede", "ngram_index", "ngram_counts_min2", "predict_next"])
def test_queries_shuffle_no_string_for_each_ngram(spark, sf_dir, monkeypatch, name):
    def never(*_):
        raise AssertionError("a row an n-gram")

    monkeypatch.setattr(counting, "occurrences", never)
    assert catalog.queries()[name](spark, sf_dir).columns


@pytest.mark.parametrize("seed,frequent", [(1, 100_000), (2, 3), (3, 1)])
def test_predictions_are_those_of_an_index(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(windows, "FREQUENT_WORDS", frequent)
    rng = random.Random(seed)
    words = [*"abcdefgh", "ab", "abc", "é", "日"]
    sents = counting.sentences(spark.createDataFrame([(i, " ".join(rng.choices(words, range(12, 0, -1), k=rng.randint(1, 9)))) for i in range(30 * seed)], "doc_id long, text string"))
    indexed = counting.index(counting.counts(counting.occurrences(sents, range(1, 4)))).cache()
    asked = spark.createDataFrame([(f"{x} {y}",) for x in ["<s>", *words, "zz"] for y in [*words, "<s>", "zz"]], "history string")
    want = models.predict_next(asked, indexed, counting.count_of_counts(indexed))
    got = models.predict_next_of(asked, sents, 3)
    plain = lambda df: sorted((r.history, r.word, round(r.p, 12)) for r in df.collect())
    assert plain(got) == plain(want)
