"""Golden values of the two-sentence corpus, and orderings that any sensible model keeps."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.operators import counting, models, perplexity
from loomtext.sources import files

TRIGRAMS = {
    "<s> the quick": (1.0, 0.79, 0.768563, 0.79),
    "the quick brown": (1.0, 0.79, 0.768563, 0.79),
    "quick brown fox": (0.5, 0.325, 0.282125, 0.325),
    "quick brown cat": (0.5, 0.325, 0.282125, 0.325),
    "brown fox </s>": (1.0, 0.65, 0.607125, 0.65),
    "slow brown fox": (None, 0.25, 0.132125, 0.25),
    "quick black fox": (None, 0.142857, 0.027125, 0.142857),
    "quick brown dog": (0.0, 0.028571, 0.006125, 0.014286),
}


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame([(0, "the quick brown fox"), (1, "the quick brown cat")], "doc_id long, text string")
    indexed = counting.index(counting.counts(counting.occurrences(counting.sentences(docs), range(1, 4)))).cache()
    return indexed, counting.count_of_counts(indexed)


def scores(spark, trained, model, grams=None, discount=0.7):
    table = spark.createDataFrame([(g,) for g in grams or TRIGRAMS], "ngram string")
    return {r.ngram: r.p for r in models.scored(table, *trained, model, discount).collect()}


def test_counts(trained):
    rows = {r.ngram: r for r in trained[0].collect()}
    assert sum(r.n == 1 for r in rows.values()) == 7 and sum(r.n == 2 for r in rows.values()) == 7 and sum(r.n == 3 for r in rows.values()) == 6
    assert (rows["quick brown"].cnt, rows["quick brown"].nf_n1, rows["brown"].nfp_n1, rows["</s>"].np_n1) == (2, 2, 2, 2)


@pytest.mark.parametrize("model,place", [("mle", 0), ("kn_iterative", 1), ("kn_recursive", 2), ("kn_backoff", 3)])
def test_golden(spark, trained, model, place):
    got = scores(spark, trained, model)
    for g, expected in TRIGRAMS.items():
        if expected[place] is not None:
            assert got[g] == pytest.approx(expected[place], abs=1e-6), g


@pytest.mark.parametrize("model", [m for m in models.MODELS if m not in ("mle", "laplace")])
@pytest.mark.parametrize("discount", [0.7, None])
def test_orderings(spark, trained, model, discount):
    p = scores(spark, trained, model, discount=discount)
    assert all(0 < x <= 1.001 and math.isfinite(x) for x in p.values())
    assert p["quick brown fox"] >= p["slow brown fox"] >= p["quick brown dog"]


def test_recursive_mass(spark, trained):
    words = ["<s>", "the", "quick", "brown", "fox", "cat", "</s>"]
    assert sum(scores(spark, trained, "kn_recursive", [f"quick brown {w}" for w in words]).values()) == pytest.approx(0.748875, abs=1e-6)
    assert sum(scores(spark, trained, "kn_iterative", [f"quick brown {w}" for w in words]).values()) == pytest.approx(1.316667, abs=1e-6)


def test_golden_perplexity(spark):
    train = spark.createDataFrame([(0, "the quick brown fox"), (1, "the quick brown cat")], "doc_id long, text string")
    indexed = counting.index(counting.counts(counting.occurrences(counting.sentences(train, tags=0), range(1, 4))))
    test = counting.sentences(train.where("doc_id = 0"), tags=0)
    scored = models.scored(test.selectExpr("'the quick brown' as ngram").union(spark.createDataFrame([("quick brown fox",)], "ngram string")), indexed, counting.count_of_counts(indexed), "mle")
    r = perplexity.summarize(perplexity.score_sentences(test, scored), "doc_id").first()
    assert r.num_ngrams == 2 and r.perp == pytest.approx(1.41421, abs=1e-4)


def test_perplexity_of_nothing(spark):
    r = spark.range(1).select(perplexity.perplexity(F.lit(0.0), F.lit(0)).alias("a"), perplexity.perplexity(F.lit(float("-inf")), F.lit(3)).alias("b"), perplexity.sanitize(F.lit(0.5)).alias("c")).first()
    assert (r.a, r.b, r.c) == (perplexity.NONE, perplexity.NONE, -1.0)


def test_prediction(spark, trained):
    best = models.predict_next(spark.createDataFrame([("the quick",)], "history string"), *trained).first()
    assert best.word == "brown"


@pytest.mark.parametrize("model", ["kn_recursive", "kn_modified"])
def test_prediction_is_the_best_of_all_words(spark, model):
    docs = spark.createDataFrame([(0, "a b zz"), (1, "a b zz"), (2, "c d e f g"), (3, "e c g d f"), (4, "f e d c g"), (5, "d g q e r")], "doc_id long, text string")
    indexed = counting.index(counting.counts(counting.occurrences(counting.sentences(docs), range(1, 4)))).cache()
    asked = spark.createDataFrame([("a b",), ("c d",), ("no such",), ("x g",), ("e d",)], "history string")
    found = [{r.history: (r.word, round(r.p, 9)) for r in models.predict_next(asked, indexed, counting.count_of_counts(indexed), model, top).collect()} for top in (None, 1000, 3)]
    assert found[0] == found[1] and found[0]["a b"][0] == "zz" and found[2]["a b"][0] != "zz"


def test_registered_prediction_has_no_cut(spark, sf_dir):
    from loomtext.plans import catalog

    indexed, coc, test = catalog._trained(spark, sf_dir)
    asked = test.select(F.concat_ws(" ", F.lit("<s>"), F.get("tokens", F.lit(1))).alias("history")).distinct().limit(20)
    want = {r.history: r.p for r in models.predict_next(asked, indexed, coc).collect()}
    got = {r.history: r.p for r in catalog.queries()["predict_next"](spark, sf_dir).collect()}
    assert all(got[h] >= p - 1e-9 for h, p in want.items())


class Recursion:
    """The recursive models as recursions over a dictionary of counts, to hold the unrolled formulas against."""

    def __init__(self, sentences, most, d=0.7):
        self.c, self.d = Counter(), d
        for t in sentences:
            for n in range(1, most + 1):
                self.c.update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
        kinds = lambda k: sum(1 for g in self.c if len(g) == k)
        self.u, self.b2 = kinds(1), kinds(2)
        self.s1, self.s2 = (sum(n for g, n in self.c.items() if len(g) == k) for k in (1, 2))

    def before(self, g):
        return sum(1 for x in self.c if x[1:] == g and len(x) == len(g) + 1)

    def after(self, g):
        return sum(1 for x in self.c if x[:-1] == g and len(x) == len(g) + 1)

    def around(self, g):
        return sum(1 for x in self.c if x[1:-1] == g and len(x) == len(g) + 2)

    def recursive(self, g, lower=False):
        d, h = self.d, g[:-1]
        if len(g) == 1:
            top, size = (self.before(g), self.b2) if lower else (self.c[g], self.s2)
            return max(top - d, 0) / size + d / size / (self.u + 1)
        below = self.recursive(g[1:], True)
        top, size = (self.before(g), self.around(h)) if lower else (self.c[g], self.c[h])
        return max(top - d, 0) / size + d / size * self.after(h) * below if size else d * below

    def back_off(self, g, lower=False):
        d, h = self.d, g[:-1]
        if not self.c[g[-1:]]:
            return d / self.u / self.b2
        if len(g) == 1:
            return self.before(g) / self.b2 or d / self.u / self.b2
        top, size = (self.before(g), self.around(h)) if lower else (self.c[g], self.c[h])
        if not size or (not lower and not top):
            return self.back_off(g[1:], lower)
        return max(top - d, 0) / size + d / size * self.after(h) * self.back_off(g[1:], True)

    def stupid(self, g):
        if not self.c[g[-1:]]:
            return self.d / self.u / self.b2
        s = self.c[g[-1:]] / self.u
        for k in range(2, len(g) + 1):
            x = g[-k:]
            if not self.c[x] or not self.c[x[:-1]]:
                return s if k == len(g) else 0.4 * s
            s = self.c[x] / self.c[x[:-1]]
        return s

    def one(self, g):
        d, h, low = self.d, g[:-1], g[1:]
        unknown = d / self.u * (self.after(g[-2:-1]) or 1 / 1) / self.b2 if len(g) > 1 and self.after(g[-2:-1]) else d / self.u / self.b2
        if not self.c[g[-1:]]:
            return unknown
        size = self.b2 if len(g) == 2 else self.around(low[:-1])
        if not self.before(low) or not size:
            return unknown
        p = self.before(low) / size
        return max(self.c[g] - d, 0) / self.c[h] + d / self.c[h] * self.after(h) * p if self.c[h] else p

    def iterative(self, g):
        d, n = self.d, len(g)
        unknown = d / self.u * self.after(g[-2:-1]) / self.b2 if n > 1 and self.after(g[-2:-1]) else d / self.u / self.b2
        if not self.c[g[-1:]]:
            return unknown

        def run():
            w = g[-1:]
            if not self.before(w):
                return self.c[w] / self.s1
            p, last = self.before(w) / self.b2, None
            for i in range(2, n):
                x, h = g[-i:], g[-i:-1]
                size = max(self.after(h), self.before(h), self.around(h))
                if not size:
                    if last and self.c[last[1]]:
                        return max(self.c[last[0]] - d, 0) / self.c[last[1]] + d / self.c[last[1]] * max(1, self.after(last[1])) * last[2]
                    return p
                old, top = p, max(self.before(x) - d, 0)
                p = top / size + d / size * max(1, self.after(h)) * old
                if not top:
                    return p
                last = (x, h, old)
            h = g[:-1]
            if n > 1 and self.c[h]:
                return max(self.c[g] - d, 0) / self.c[h] + d / self.c[h] * max(1, self.after(h)) * p
            if last and self.c[last[1]]:
                return max(self.c[last[0]] - d, 0) / self.c[last[1]] + d / self.c[last[1]] * max(1, self.after(last[1])) * last[2]
            return p

        return min(1, max(unknown, run()))


@pytest.fixture(scope="module")
def longer(spark):
    rng = random.Random(3)
    text = [" ".join(rng.choices("abcdefg", [7, 5, 4, 3, 2, 1, 1], k=rng.randint(3, 9))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    counted = counting.counts(counting.occurrences(counting.sentences(docs), range(1, 6))).cache()
    return Recursion([["<s>", *t.split(), "</s>"] for t in text], 5), counted, counting.count_of_counts(counted)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_formulas_are_the_recursions(spark, longer, n):
    known, counted, coc = longer
    rng = random.Random(n)
    grams = {tuple(rng.choices(["<s>", *"abcdefg", "z", "</s>"], k=n)) for _ in range(150)} | set(rng.sample(sorted(g for g in known.c if len(g) == n), min(60, sum(len(g) == n for g in known.c))))
    table = spark.createDataFrame([(" ".join(g),) for g in sorted(grams)], "ngram string")
    fixed = models.constants([r.asDict() for r in coc.collect()])
    looked = models.lookup(table, counted, n).withColumns({k: F.lit(v) for k, v in fixed.items()})
    names = {"kn_recursive": known.recursive, "kn_backoff": known.back_off, "stupid_backoff": known.stupid, "kn_iterative": known.iterative} | ({"kn_one_backoff": known.one} if n > 1 else {})
    for r in looked.select("ngram", *[models.probability(m, n).alias(m) for m in names]).collect():
        for m, f in names.items():
            assert r[m] == pytest.approx(f(tuple(r.ngram.split())), rel=1e-9), (m, r.ngram)


def test_index_and_counts_score_alike(spark, longer):
    _, counted, coc = longer
    table = spark.createDataFrame([("a b c",), ("z z z",), ("a z b",)], "ngram string")
    a, b = (sorted(map(tuple, models.scored(table, known, coc, "kn_modified", None).collect())) for known in (counted, counting.index(counted)))
    assert a == b and len(a) == 3


def test_back_off_tables(spark, longer, tmp_path):
    _, counted, coc = longer
    few = counted.where("n <= 3")
    table = models.arpa(few, coc, 3).cache()
    assert table.groupBy("n").count().orderBy("n").collect() == few.groupBy("n").count().orderBy("n").collect()
    files.arpa_lines(table).write.text(str(tmp_path / "arpa"))
    back = files.read_arpa(spark, str(tmp_path / "arpa"))
    grams = spark.createDataFrame([("a b c",), ("z a b",), ("a z b",), ("a b z",), ("c c c",), ("g f e",)], "ngram string")
    k = models.constants([r.asDict() for r in coc.collect()])
    unknown = math.log10(k["d1"] / k["b2"] / (k["u"] + 1))
    want = {r.ngram: math.log10(r.p) for r in models.scored(grams, few, coc, "kn_arpa").collect()}
    for source, far in ((table, 1e-9), (back, 1e-5)):
        got = {r.ngram: r.log10p for r in models.arpa_scored(grams, source, 3, unknown).collect()}
        assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=far) for g in want)


def test_predictions(spark, longer):
    known, counted, coc = longer
    indexed = counting.index(counted).cache()
    for history in (("<s>", "a"), ("a", "b"), ("z", "c")):
        words = {g[0] for g in known.c if len(g) == 1}
        best = max(known.recursive((*history, w)) for w in words)
        r = models.predict_next(spark.createDataFrame([(" ".join(history),)], "history string"), indexed, coc).first()
        assert r.p == pytest.approx(best) and known.recursive((*history, r.word)) == pytest.approx(best)
    starts = spark.createDataFrame([(["<s>", "a"],), (["<s>", "b"],)], "start array<string>")
    for r in models.predict_sentence(starts, indexed, coc, 4).collect():
        assert r.sentence[:2] == r.start and (len(r.sentence) == 6 or r.sentence[-1] == "</s>")


def test_registered_models(spark, trained):
    models.register_model("half", lambda n: "0.5")
    assert set(scores(spark, trained, "half").values()) == {0.5}
    assert {r.p for r in models.dummy(spark.createDataFrame([("a b",)], "ngram string")).collect()} == {1.0}
    assert scores(spark, trained, "kn_recursive", ["quick brown zebra"])["quick brown zebra"] != 1e-9
    got = models.scored(spark.createDataFrame([("quick brown zebra",)], "ngram string"), *trained, "kn_recursive", unknown=-9.0).first()
    assert got.p == 1e-9 and got.oov_last
