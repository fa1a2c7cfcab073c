"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document whose metric lies above a cutoff. For each language (stratum) and rule the
cutoffs are tested from the most lenient to the strictest on the documents whose label says quality 1:
the exact binomial tail P(X <= rejected) at a false-rejection rate of ``RISK`` / rules must not exceed
``DELTA`` / (languages * rules). Testing stops at the first cutoff that fails (fixed sequence), and the
division by all tests that may start (Bonferroni) and of the risk by the rules (union) make this hold,
with probability 1 - DELTA, for all languages at once: of the good documents of a language at most a
share of RISK is rejected by any of its rules. Exact copies of a text with one label are one trial, or a much-copied document would
count as many independent ones; near copies aren't told apart from independent texts. Among certified cutoffs that one is taken which
rejects most documents of quality 0, of equals the most lenient; a rule that rejects none has no cutoff.

Metrics are counted in one narrow pass over the text; beyond it, only numbers move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm import kernels as K
from loomtext.llm import spans
from loomtext.session import cut, read

U = np.uint64
RISK, DELTA = 0.05, 0.05
_SHARES = [round(0.95 - 0.05 * k, 2) for k in range(19)]
CUTOFFS = {
    "symbol_ratio": _SHARES,
    "upper_ratio": _SHARES,
    "repeat_ratio": _SHARES,
    "dup_line_ratio": _SHARES,
    "mean_word_length": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 10.0],
}
RULES = list(CUTOFFS)
_METRICS = "doc_id long, lang string, text_hash long, n_words long, " + ", ".join(f"{r} double" for r in RULES)


def _lines() -> np.ndarray:
    if "lines" not in K._tables:
        value = K.mix(np.arange(0x110000).astype(U) + U(0x7F4A7C15))
        value[[0, 10]] = 0
        K._tables["lines"] = value
    return K._tables["lines"]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def metrics(texts: list[str]) -> dict[str, np.ndarray]:
    """Numbers of each text; a ratio whose base is empty is 0."""
    words = K.Words(texts)
    n = np.diff(words.off)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(words.cps) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[words.base[1:]] - total[words.base[:-1]]

    letters = per_text(K.lower_table()[words.cps] != 0)
    marks, upper = per_text(K.visible_table()[words.cps]), per_text(K.upper_table()[words.cps])
    doc = words.doc()
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])) + 1
    lines = K.Words(texts, _lines())
    total = np.diff(lines.off)
    owner = lines.doc()
    order = np.lexsort((lines.hash, owner))
    twice = order[1:][(lines.hash[order][1:] == lines.hash[order][:-1]) & (owner[order][1:] == owner[order][:-1])]
    return {
        "n_words": n,
        "symbol_ratio": _share(marks, marks + letters),
        "upper_ratio": _share(upper, letters),
        "repeat_ratio": _share(np.bincount(doc[again], minlength=len(n)), n),
        "dup_line_ratio": _share(np.bincount(owner[twice], minlength=len(n)), total),
        "mean_word_length": _share(letters, n),
    }


def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in spans.slices(it):
        m = metrics(texts)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(m["n_words"]), *(pa.array(m[r], pa.float64()) for r in RULES)], ["doc_id", "lang", "text_hash", "n_words", *RULES])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable."""
    if k >= n:
        return 1.0
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(j)) for j in range(k + 1)))


def _test(risk: float, delta: float, strata: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        c = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        ok = [binomial_tail(k, n, risk / len(RULES)) <= delta / (strata * len(RULES)) for k, n in zip(c["good_hit"], c["good"])]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(ok, pa.bool_())], ["lang", "rule", "step", "cutoff", "bad_hit", "ok"])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """lang and the chosen cutoff of each rule (null: none), one row a language that has labelled documents."""
    spark = measured.sparkSession
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("q")).where("low = q and q in (0, 1)").select("doc_id", "q")
    held = measured.join(known, "doc_id").groupBy("lang", "q", "text_hash", *RULES).agg(F.count("*").alias("copies"))
    # a metric's level is how many of its cutoffs it exceeds, so a row a rule is enough to count for all cutoffs
    level = [F.struct(F.lit(r).alias("rule"), sum((F.col(r) > x).cast("int") for x in c).alias("level")) for r, c in CUTOFFS.items()]
    counted = held.select("lang", "q", F.explode(F.array(*level)).alias("x")).groupBy("lang", "x.rule", "x.level").agg(F.sum("q").alias("good"), F.sum(1 - F.col("q")).alias("bad"))
    counted = cut(counted)
    grid = spark.createDataFrame([(r, k, x, len(c) - k) for r, c in CUTOFFS.items() for k, x in enumerate(c)], "rule string, step int, cutoff double, least int")
    strata = counted.select("lang").distinct().count()
    table = counted.join(grid, "rule").groupBy("lang", "rule", "step", "cutoff").agg(
        F.sum(F.when(F.col("level") >= F.col("least"), F.col("bad")).otherwise(0)).alias("bad_hit"),
        F.sum(F.when(F.col("level") >= F.col("least"), F.col("good")).otherwise(0)).alias("good_hit"),
        F.sum("good").alias("good"),
    )
    tested = table.select("lang", "rule", "step", "cutoff", "bad_hit", "good_hit", "good").mapInArrow(partial(_test, risk, delta, strata), "lang string, rule string, step int, cutoff double, bad_hit long, ok boolean")
    reached = F.min("ok").over(Window.partitionBy("lang", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    best = tested.withColumn("certified", reached).groupBy("lang", "rule").agg(F.max(F.when(F.col("certified") & (F.col("bad_hit") > 0), F.struct("bad_hit", (-F.col("step")).alias("s"), "cutoff"))).alias("best"))
    return best.groupBy("lang").pivot("rule", RULES).agg(F.first("best.cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, lang, n_words, the metrics, rejected_by (names of rules, comma-separated) and keep, for every row.

    Defined cases: a null or empty text has metrics of 0 and is kept; a null lang is a stratum of its own;
    a language without labels, or with too few for any certificate, has no cutoffs and is kept; labels
    that contradict each other or aren't 0 or 1 aren't used; equal texts with one label count once;
    of cutoffs that reject equally many the most lenient is taken; a metric equal to a cutoff stays; a row without doc_id is measured, but has no label; an empty table gives an empty result. Other
    columns are not read.
    """
    measured = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.xxhash64("text").alias("text_hash")).mapInArrow(_measure, _METRICS))
    limits = cutoffs(measured, labels, risk, delta).withColumnsRenamed({r: f"max_{r}" for r in RULES} | {"lang": "__lang"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    reasons = F.concat_ws(",", *[F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in RULES])
    return joined.select(*[c for c in measured.columns if c != "text_hash"], reasons.alias("rejected_by"), (reasons == "").alias("keep"))


def op1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_GRID = ", ".join(f"('{r}', {k}, {x})" for r, c in CUTOFFS.items() for k, x in enumerate(c))
SQL = {
    "op1_rules": f"""
WITH pieces AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w,
         length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters,
         length(regexp_replace(coalesce(text, ''), '[\\p{{L}}\\p{{N}}\\p{{Z}}\\p{{Cc}}]', '', 'g')) AS marks,
         length(regexp_replace(coalesce(text, ''), '[^\\p{{Lu}}]', '', 'g')) AS upper,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines FROM documents),
m AS (
  SELECT doc_id, lang, md5(text) AS text_hash, len(w) AS n_words,
         CASE WHEN marks + letters > 0 THEN CAST(marks AS DOUBLE) / (marks + letters) ELSE 0.0 END AS symbol_ratio,
         CASE WHEN letters > 0 THEN CAST(upper AS DOUBLE) / letters ELSE 0.0 END AS upper_ratio,
         CASE WHEN len(w) > 0 THEN CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS DOUBLE) / len(w) ELSE 0.0 END AS repeat_ratio,
         CASE WHEN len(lines) > 0 THEN CAST(len(lines) - list_unique(lines) AS DOUBLE) / len(lines) ELSE 0.0 END AS dup_line_ratio,
         CASE WHEN len(w) > 0 THEN CAST(letters AS DOUBLE) / len(w) ELSE 0.0 END AS mean_word_length FROM pieces),
long AS (UNPIVOT m ON {", ".join(RULES)} INTO NAME rule VALUE x),
known AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality) AND min(quality) IN (0, 1)),
held AS (SELECT DISTINCT lang, rule, x, q, text_hash FROM long JOIN known USING (doc_id)),
grid(rule, step, cutoff) AS (VALUES {_GRID}),
counted AS (
  SELECT lang, rule, step, cutoff, sum(CASE WHEN x > cutoff THEN 1 - q ELSE 0 END) AS bad_hit, CAST(sum(CASE WHEN x > cutoff THEN q ELSE 0 END) AS BIGINT) AS k,
         CAST(sum(q) AS BIGINT) AS n FROM held JOIN grid USING (rule) GROUP BY ALL),
strata AS (SELECT count(DISTINCT coalesce(lang, '?')) AS s FROM held),
tested AS (
  SELECT lang, rule, step, cutoff, bad_hit,
         CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - (CASE WHEN j = 0 THEN 0.0 ELSE lgamma(j + 1) END) - lgamma(n - j + 1) + j * ln({RISK / len(RULES)}) + (n - j) * ln(1 - {RISK / len(RULES)})))) END <= {DELTA} / (s * {len(RULES)}) AS ok
  FROM counted, strata),
sequence AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY step ROWS UNBOUNDED PRECEDING) AS certified FROM tested),
best AS (
  SELECT lang, rule, cutoff FROM sequence WHERE certified AND bad_hit > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad_hit DESC, step) = 1),
hits AS (
  SELECT m.doc_id, m.lang, {", ".join(f"coalesce(bool_or(b.rule = '{r}' AND m.{r} > b.cutoff), false) AS hit_{r}" for r in RULES)}
  FROM m LEFT JOIN best b ON m.lang IS NOT DISTINCT FROM b.lang GROUP BY m.doc_id, m.lang)
SELECT m.doc_id, m.lang, m.n_words, {", ".join("m." + r for r in RULES)},
       concat_ws(',', {", ".join(f"CASE WHEN hit_{r} THEN '{r}' END" for r in RULES)}) AS rejected_by,
       NOT ({" OR ".join("hit_" + r for r in RULES)}) AS keep
FROM m JOIN hits USING (doc_id)
"""
}
