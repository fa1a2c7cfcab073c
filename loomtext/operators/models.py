"""Smoothed n-gram models of any order as expressions over looked-up statistics.

Of an n-gram, suffix k is its last k words, and history k is suffix k without its last word. ``lookup`` fetches
what is known of suffixes 1 to n and histories 2 to n with one join of the distinct n-grams' keys; a model is then one SQL
expression over the columns below, in the syntax that Spark and DuckDB share. Recursions are unrolled, nothing is looked up row by row,
no UDF is used.

    c{k}, h{k}                       counts of suffix k and history k
    np{k}, hp{k}                     distinct predecessors of suffix k and of history k
    nf{k}, nf{k}_1.. nf{k}_3         distinct followers of history k (in all; once, twice, more often)
    nfp{k}                           distinct (predecessor, follower) pairs around history k
    u, b2, s1, s2                    distinct unigrams and bigrams, unigram and bigram occurrences
    d{k}, d{k}_1.. d{k}_3            discount of order k; modified ones by count
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import ngrams as N
from loomtext.operators import counting, windows
from loomtext.session import cut, sized

_UNSEEN = "(d1 / u / b2)"
_UNIFORM = "(d1 / b2 / (u + 1))"
_BACK_OFF = 0.4


def _when(condition: str, yes: str, no: str) -> str:
    return f"(CASE WHEN {condition} THEN {yes} ELSE {no} END)"


def _mix(numerator: str, discount: str, denominator: str, weight: str, lower: str) -> str:
    return f"(greatest({numerator} - {discount}, 0) / {denominator} + {weight} / {denominator} * {lower})"


def _unknown(n: int) -> str:
    """What a word that training hasn't gets: the more, the more words follow the one before it."""
    return _when("nf2 > 0", "d1 / u * nf2 / b2", _UNSEEN) if n > 1 else _UNSEEN


def _mle(n: int) -> str:
    return _when(f"c{n} = 0 OR h{n} = 0", "0.0", f"c{n} / h{n}") if n > 1 else "(c1 / s1)"


def _laplace(n: int) -> str:
    return f"((c{n} + 1) / (h{n} + u))" if n > 1 else "((c1 + 1) / u)"


def _stupid_back_off(n: int) -> str:
    """The weight isn't applied where the full n-gram alone is missing."""

    def from_(k: int, score: str) -> str:
        missing = f"c{k} = 0 OR h{k} = 0"
        return _when(missing, score, f"c{k} / h{k}") if k == n else _when(missing, f"{_BACK_OFF} * {score}", from_(k + 1, f"c{k} / h{k}"))

    return _when("c1 = 0", _UNSEEN, from_(2, "c1 / u") if n > 1 else "c1 / u")


def _iterative(n: int) -> str:
    """From the last word up; ends early where a history is unknown or a numerator vanishes. Then the level below is estimated from counts, if it can be."""

    def counted(k: int, discount: str, before: str | None, p: str) -> str:
        return p if before is None else _when(f"h{k} > 0", _mix(f"c{k}", discount, f"h{k}", f"{discount} * greatest(nf{k}, 1)", before), p)

    def from_(k: int, p: str, before: str | None) -> str:
        if k == n:
            return _when(f"h{k} = 0", counted(k - 1, f"d{k}", before, p), _mix(f"c{k}", f"d{k}", f"h{k}", f"d{k} * greatest(nf{k}, 1)", p))
        around = f"greatest(nf{k}, hp{k}, nfp{k})"
        here = _mix(f"np{k}", f"d{k}", around, f"d{k} * greatest(nf{k}, 1)", p)
        return _when(f"{around} = 0", counted(k - 1, f"d{k}", before, p), _when(f"np{k} - d{k} <= 0", here, from_(k + 1, here, p)))

    lowest = _when("c1 = 0", "1 / u", "c1 / s1")
    p = _when("np1 = 0", lowest, from_(2, "np1 / b2", None) if n > 1 else "np1 / b2")
    return _when("c1 = 0", _unknown(n), f"least(1, greatest({_unknown(n)}, {p}))")


def _recursive(n: int) -> str:
    if n == 1:
        return "(greatest(c1 - d1, 0) / s2 + d1 / s2 / (u + 1))"
    p = f"(greatest(np1 - d1, 0) / b2 + {_UNIFORM})"
    for k in range(2, n):
        p = _when(f"nfp{k} = 0", f"d{k} * {p}", _mix(f"np{k}", f"d{k}", f"nfp{k}", f"d{k} * nf{k}", p))
    return f"least(1, {_when(f'h{n} = 0', f'd{n} * {p}', _mix(f'c{n}', f'd{n}', f'h{n}', f'd{n} * nf{n}', p))})"


def _modified(n: int) -> str:
    def discount(k: int, count: str) -> str:
        return f"(CASE WHEN {count} <= 0 THEN 0 WHEN {count} = 1 THEN d{k}_1 WHEN {count} = 2 THEN d{k}_2 ELSE d{k}_3 END)"

    def weight(k: int) -> str:
        return f"(d{k}_1 * nf{k}_1 + d{k}_2 * nf{k}_2 + d{k}_3 * nf{k}_3)"

    if n == 1:
        p = f"(greatest(c1 - {discount(1, 'c1')}, 0) / s2 + d1 / s2 / (u + 1))"
    else:
        p = f"(greatest(np1 - {discount(1, 'np1')}, 0) / b2 + {_UNIFORM})"
        for k in range(2, n):
            p = _when(f"nfp{k} = 0", f"d{k} * {p}", _mix(f"np{k}", discount(k, f"np{k}"), f"nfp{k}", weight(k), p))
        p = _when(f"h{n} = 0", f"d{n} * {p}", _mix(f"c{n}", discount(n, f"c{n}"), f"h{n}", weight(n), p))
    return _when("c1 = 0", _UNIFORM, f"least(1, {p})")


def _back_off(n: int) -> str:
    """An n-gram or history that isn't seen leaves the next lower order of counts, with weight 1."""
    raw = lower = _when("np1 = 0", _UNSEEN, "np1 / b2")
    for k in range(2, n + 1):
        raw = _when(f"c{k} = 0 OR h{k} = 0", raw, _mix(f"c{k}", f"d{k}", f"h{k}", f"d{k} * nf{k}", lower))
        lower = _when(f"nfp{k} = 0", lower, _mix(f"np{k}", f"d{k}", f"nfp{k}", f"d{k} * nf{k}", lower))
    return _when("c1 = 0", _UNSEEN, f"least(1, {raw})")


def _one_back_off(n: int) -> str:
    if n == 1:
        return _when("c1 = 0 OR np1 = 0", _UNSEEN, "np1 / b2")
    k = n - 1
    lower, around = ("(np1 / b2)", "b2") if n == 2 else (f"(np{k} / nfp{k})", f"nfp{k}")
    return _when(f"c1 = 0 OR np{k} = 0 OR {around} = 0", _unknown(n), _when(f"h{n} = 0", lower, f"least(1, {_mix(f'c{n}', f'd{n}', f'h{n}', f'd{n} * nf{n}', lower)})"))


_MADE = {
    "mle": _mle,
    "laplace": _laplace,
    "stupid_backoff": _stupid_back_off,
    "kn_iterative": _iterative,
    "kn_recursive": _recursive,
    "kn_modified": _modified,
    "kn_backoff": _back_off,
    "kn_one_backoff": _one_back_off,
}
MODELS = tuple(_MADE)


def register_model(name: str, formula) -> None:
    """Make a function from an order to an expression available as a model."""
    _MADE[name] = formula


def formula(model: str, n: int = 3, unknown: float | None = None) -> str:
    """Probability of an n-gram of n words; 0 stands for minus infinity. ``unknown``: log10 of a static probability of words that training hasn't."""
    p = _MADE[model](n)
    return p if unknown is None else _when("c1 = 0", f"{10.0**unknown!r}", p)


def statistics(n: int) -> dict[str, tuple[str, str]]:
    """Columns that models of order n read: the key and the statistic that each is."""
    out = {}
    for k in range(1, n + 1):
        out |= {f"c{k}": (f"s{k}", "cnt"), f"np{k}": (f"s{k}", "np")}
        if k > 1:
            out |= {f"h{k}": (f"h{k}", "cnt"), f"hp{k}": (f"h{k}", "np"), f"nf{k}": (f"h{k}", "nf"), f"nfp{k}": (f"h{k}", "nfp")}
            out |= {f"nf{k}_{j}": (f"h{k}", f"nf_n{j}") for j in (1, 2, 3)}
    return out


def keys(key: Column, n: int) -> dict[str, Column]:
    """The suffixes s1 to s{n} and the histories h2 to h{n} of an n-gram."""
    suffixes = {f"s{k}": F.substring_index(key, " ", -k) for k in range(1, n + 1)}
    return suffixes | {f"h{k}": N.history(suffixes[f"s{k}"]) for k in range(2, n + 1)}


def lookup(grams: DataFrame, known: DataFrame, n: int = 3) -> DataFrame:
    """Distinct ``ngram`` of n words with all columns that models read, as doubles.

    ``known`` is an index (of these n-grams' keys at least) or counted n-grams; of the latter only the statistics that are asked for are made.
    """
    distinct = grams.select("ngram").distinct()
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), c.alias("key")) for s, c in keys(F.col("ngram"), n).items()])
    asked = distinct.select(F.col("ngram").alias("gram"), F.explode(slots).alias("x")).select("gram", "x.slot", "x.key")
    if "nf_n1" not in known.columns:
        only = asked.select("key").distinct()
        known = counting.index(known, sized(only, distinct.count() * (2 * n - 1), 64))
    total = lambda p: F.col(f"{p}_n1") + F.col(f"{p}_n2") + F.col(f"{p}_n3")
    found = asked.join(known.select(F.col("ngram").alias("key"), "cnt", *[total(p).alias(p) for p in ("nf", "np", "nfp")], *[f"nf_n{j}" for j in (1, 2, 3)]), "key", "left")
    wide = found.groupBy("gram").agg(*[F.coalesce(F.max(F.when(F.col("slot") == s, F.col(c))), F.lit(0)).cast("double").alias(name) for name, (s, c) in statistics(n).items()])
    return wide.withColumnRenamed("gram", "ngram")


def adjusted(counts: dict[str, float]) -> list[float]:
    """Counts of counts n1 to n5p, forced to satisfy i * N[i] < (i - 1) * N[i - 1]."""
    n = [0.0, *(float(counts[f"n{k}"]) for k in ("1", "2", "3", "4", "5p"))]
    for i in range(5, 1, -1):
        n[i] = n[i] or 1.0
        if i * n[i] >= (i - 1) * n[i - 1]:
            n[i - 1] = n[i] * i + 1
    return n


def constants(coc: list[dict], discount: float | None = 0.7, most: int = 2) -> dict[str, float]:
    """Constants of the models up to order ``most`` from the counts of counts (one row an order); ``discount`` None: estimated for each order that has a row.

    With a discount only the orders 1 and 2 need rows.
    """
    by = {r["n"]: r for r in coc}
    out = {"u": float(by[1]["n_distinct"]), "b2": float(by[2]["n_distinct"]), "s1": float(by[1]["total"]), "s2": float(by[2]["total"])}
    for n in sorted(by.keys() | (set() if discount is None else range(1, most + 1))):
        if discount is not None:
            out |= {f"d{n}": discount} | {f"d{n}_{k}": discount for k in (1, 2, 3)}
            continue
        a = adjusted(by[n])
        y = a[1] / (a[1] + 2 * a[2])
        out[f"d{n}"] = y
        y = min(0.5, max(0.05, y))
        raw = [k - (k + 1) * y * a[k + 1] / a[k] for k in (1, 2, 3)]
        out |= {f"d{n}_{k}": min(0.95, max(0.05, d / sum(raw) * y)) for k, d in zip((1, 2, 3), raw)}
    return out


def probability(model: str, n: int = 3, unknown: float | None = None) -> Column:
    return F.expr(formula(model, n, unknown))


def scored(grams: DataFrame, known: DataFrame, coc: DataFrame, model: str, discount: float | None = 0.7, n: int = 3, unknown: float | None = None) -> DataFrame:
    """ngram, p and oov_last of distinct n-grams of n words. ``coc`` has one row an order and is read by the driver."""
    fixed = constants([r.asDict() for r in coc.collect()], discount, n)
    looked = lookup(grams, known, n).withColumns({k: F.lit(v) for k, v in fixed.items()})
    return looked.select("ngram", probability(model, n, unknown).alias("p"), (F.col("c1") == 0).alias("oov_last"))


def _arpa(k: int, n: int) -> str:
    """As the recursive model, but an unknown history leaves the lower order as it is, which is how a back-off file is read; below order n for n-grams of order k."""
    p = f"(greatest(np1 - d1, 0) / b2 + {_UNIFORM})"
    for j in range(2, min(k, n - 1) + 1):
        p = _when(f"nfp{j} = 0", p, _mix(f"np{j}", f"d{j}", f"nfp{j}", f"d{j} * nf{j}", p))
    return p if k < n else _when(f"h{n} = 0", p, _mix(f"c{n}", f"d{n}", f"h{n}", f"d{n} * nf{n}", p))


register_model("kn_arpa", lambda n: _arpa(n, n))


def arpa(counted: DataFrame, coc: DataFrame, n: int = 3, discount: float | None = 0.7) -> DataFrame:
    """n, ngram, log10p and backoff (null: none) of all counted n-grams, as ``files.arpa_lines`` writes and ``arpa_scored`` reads them.

    ``counted`` may be an index of some n-grams that has all parts of each; then the table has its rows of these.
    """
    fixed = constants([r.asDict() for r in coc.collect()], discount, n)
    known = {k: F.lit(v) for k, v in fixed.items()}
    indexed = counted if "nf_n1" in counted.columns else counting.index(counted)
    if "n" not in indexed.columns:
        indexed = indexed.withColumn("n", F.size(F.split("ngram", " ")))
    out = []
    for k in range(1, n + 1):
        own = indexed.where(F.col("n") == k)
        p = lookup(own, indexed, k).withColumns(known).select("ngram", F.log10(F.expr(_arpa(k, n))).alias("log10p"))
        follow = F.col("nf_n1") + F.col("nf_n2") + F.col("nf_n3")
        around = F.col("cnt") if k == n - 1 else F.col("nfp_n1") + F.col("nfp_n2") + F.col("nfp_n3")
        weight = F.lit(None).cast("double") if k == n else F.when((around > 0) & (follow > 0), F.log10(F.lit(fixed[f"d{k + 1}"]) * follow / around))
        out.append(p.join(own.select("ngram", weight.alias("backoff")), "ngram").select(F.lit(k).alias("n"), "ngram", "log10p", "backoff"))
    return reduce(DataFrame.unionByName, out)


def arpa_scored(grams: DataFrame, table: DataFrame, n: int, unknown: float) -> DataFrame:
    """ngram and log10p of distinct n-grams of n words under a back-off table; ``unknown``: log10 of a word's that it hasn't."""
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), c.alias("key")) for s, c in keys(F.col("ngram"), n).items()])
    asked = grams.select("ngram").distinct().select(F.col("ngram").alias("gram"), F.explode(slots).alias("x")).select("gram", "x.slot", "x.key")
    found = asked.join(table.select(F.col("ngram").alias("key"), "log10p", "backoff"), "key", "left")
    at = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    wide = found.groupBy("gram").agg(*[at(f"s{k}", "log10p").alias(f"p{k}") for k in range(1, n + 1)], *[at(f"h{k}", "backoff").alias(f"b{k}") for k in range(2, n + 1)])
    score = F.coalesce("p1", F.lit(unknown))
    for k in range(2, n + 1):
        score = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"b{k}"), F.lit(0.0)) + score)
    return wide.select(F.col("gram").alias("ngram"), score.alias("log10p"))


def predict_sentence(starts: DataFrame, indexed: DataFrame, coc: DataFrame, words: int = 20, model: str = "kn_recursive") -> DataFrame:
    """``start`` (an array of two tokens at least) and sentence: the most probable word after it, and so on, until the end tag or ``words`` words."""
    state = cut(starts.select("start", F.col("start").alias("sentence")))
    for _ in range(words):
        last = F.concat_ws(" ", F.slice("sentence", -2, 2))
        going = state.where(F.element_at("sentence", -1) != "</s>").withColumn("history", last)
        if going.isEmpty():
            break
        step = going.join(predict_next(going, indexed, coc, model).select("history", "word"), "history")
        done = state.where(F.element_at("sentence", -1) == "</s>")
        state = cut(step.select("start", F.concat("sentence", F.array("word")).alias("sentence")).unionByName(done))
    return state


def dummy(grams: DataFrame) -> DataFrame:
    """The model that knows nothing: log10 probability 0 for all."""
    return grams.select("ngram").distinct().select("ngram", F.lit(1.0).alias("p"), F.lit(False).alias("oov_last"))


def predict_next(histories: DataFrame, indexed: DataFrame, coc: DataFrame, model: str = "kn_recursive", top: int | None = None) -> DataFrame:
    """The most probable word after each two-word history, of the ``top`` most frequent words; of equals the smaller.

    ``top`` None: of all words, for the recursive models. A word that isn't seen after the history's last one has a
    probability that grows with its distinct predecessors only, so the best such word and the seen followers suffice.
    """
    asked = histories.select("history").distinct()
    if "nf_s" not in indexed.columns:
        indexed = cut(counting.index(indexed))
    if top is None:
        if model not in ("kn_recursive", "kn_modified"):
            raise ValueError(f"{model} needs a number of words")
        before = F.col("np_n1") + F.col("np_n2") + F.col("np_n3")
        best = indexed.where("n = 1").orderBy(before.desc(), "ngram").select("ngram").first()
        seen = indexed.where("n = 2").select(N.history(F.col("ngram")).alias("__last"), N.last_word(F.col("ngram")).alias("candidate"))
        followers = asked.withColumn("__last", N.last_word(F.col("history"))).join(seen, "__last").select("history", "candidate")
        pairs = asked.withColumn("candidate", F.lit(best.ngram if best else "")).union(followers).distinct()
    else:
        words = [r.ngram for r in indexed.where("n = 1").orderBy(F.desc("cnt"), "ngram").limit(top).select("ngram").collect()]
        pairs = asked.withColumn("candidate", F.explode(F.lit(words)))
    pairs = pairs.withColumn("ngram", F.concat_ws(" ", "history", "candidate"))
    best = pairs.join(scored(pairs, indexed, coc, model), "ngram").groupBy("history").agg(F.max_by(F.struct("candidate", "p"), _by_p("candidate")).alias("x"))
    return best.select("history", F.col("x.candidate").alias("word"), F.col("x.p").alias("p"))


def _by_p(word: str) -> Column:
    """What is the greatest for the greatest p, of equals for the smaller word."""
    return F.struct("p", F.transform(F.split(word, ""), lambda c: -F.ascii(c)))


def predict_next_of(histories: DataFrame, sents: DataFrame, buckets: int, discount: float = 0.7) -> DataFrame:
    """As ``predict_next`` under the recursive trigram model of ``sents``, of all words, without an index of the corpus.

    Words that a history isn't seen before have a probability in proportion to the lower order's, which depends on the history's last word only. So the
    candidates are the words seen after the history, the best of those seen after its last word, and the best of all; of each last word one is enough, whatever
    histories it ends: if the best is seen after a history too, it is better there than all that aren't.
    """
    asked = cut(histories.select("history").distinct().withColumn("last", N.last_word(F.col("history"))))
    lasts = asked.select(F.col("last").alias("ngram")).distinct()
    found = windows.Continuations(sents, buckets)
    words = cut(found.words())
    size = words.agg(F.count("*").alias("u"), F.sum("np1").alias("b2")).first()
    best = words.orderBy(F.col("np1").desc(), "ngram").first()
    u, b2 = float(size.u), float(size.b2 or 0)
    fixed = {k: F.lit(v) for k, v in {"u": u, "b2": b2, **{f"d{k}": discount for k in (1, 2, 3)}}.items()}
    before = words.select(F.col("ngram").alias("word"), "np1")
    around = cut(lasts.join(words, "ngram", "left").select(F.col("ngram").alias("last"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nf2", "nfp2")]))
    doubles = lambda df: df.withColumns({c: F.col(c).cast("double") for c in ("np1", "np2", "nf2", "nfp2", "c3", "h3", "nf3") if c in df.columns}).withColumns(fixed)
    lower = f"(greatest(np1 - d1, 0) / b2 + {_UNIFORM})"
    lower = _when("nfp2 = 0", f"d2 * {lower}", _mix("np2", "d2", "nfp2", "d2 * nf2", lower))
    after = found.after_words(around.select(F.col("last").alias("ngram"), "nf2"), words, b2, u, discount)
    single = doubles(after.join(before, "word").join(around, "last")).select("last", "word", "np2", "np1", F.expr(lower).alias("p"))
    of_last = cut(single.groupBy("last").agg(F.max_by(F.struct("word", "np2", "np1", "p"), _by_p("word")).alias("x")).select("last", "x.*"))
    most = asked.join(of_last, "last", "left").select(F.col("history").alias("ngram"), F.coalesce("p", F.lit(1.0)).alias("most"))
    seen = cut(found.after_bigrams(most, discount).withColumn("last", N.last_word(F.col("history"))))
    pairs = found.bigrams(seen.select(F.concat_ws(" ", "last", "word").alias("ngram")))
    both = seen.select("history", "last", "word", "c3").join(pairs, ["last", "word"]).join(before, "word").select("history", "word", "c3", "np2", "np1")
    unseen = asked.join(of_last, "last").select("history", "word", F.lit(0).alias("c3"), "np2", "np1")
    common = asked.select("history", F.lit(best.ngram if best else "").alias("word"), F.lit(0).alias("c3"), F.lit(0).alias("np2"), F.lit(best.np1 if best else 0).alias("np1"))
    pairs = both.union(unseen).union(common).groupBy("history", "word").agg(*[F.max(c).alias(c) for c in ("c3", "np2", "np1")])
    of_history = seen.groupBy("history").agg(F.max("h3").alias("h3"), F.max("nf3").alias("nf3"))
    full = pairs.join(asked, "history").join(around, "last").join(of_history, "history", "left").fillna(0, ["h3", "nf3"])
    p = doubles(full).select("history", "word", probability("kn_recursive", 3).alias("p"))
    return p.groupBy("history").agg(F.max_by(F.struct("word", "p"), _by_p("word")).alias("x")).select("history", "x.word", "x.p")
