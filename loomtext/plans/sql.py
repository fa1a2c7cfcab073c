"""Building blocks of the SQL that the queries are compared with. Written for DuckDB over the same tables."""

from __future__ import annotations

from loomtext.functions import segments as S
from loomtext.operators.models import statistics

TOKEN_PATTERNS = {"space": S.SPACE_RUNS, "class": S.CLASS_RUNS, "single": S.SINGLES}


def type_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({x}, '{p}') THEN '{n}'" for n, p in S.TYPES.items()) + " ELSE 'UNKNOWN' END"


def sentences(table: str = "documents", key: str = "doc_id", name: str = "sents") -> str:
    """CTEs that end in ``name``(doc_id, sent, t)."""
    return f"""
{name}_lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS sent
  FROM (SELECT {key} AS doc_id, regexp_extract_all(text, '{S.LINES}') AS ls FROM {table})),
{name}_words AS (
  SELECT doc_id, sent, list_filter(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_full_match(x, '\\p{{L}}+')) AS w FROM {name}_lines),
{name} AS MATERIALIZED (SELECT doc_id, sent, list_concat(['<s>'], w, ['</s>']) AS t FROM {name}_words WHERE len(w) > 0)"""


def grams(low: int = 1, high: int = 3, source: str = "sents", name: str = "grams") -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, sent, {n} AS n, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(list_slice(t, i, i + {n} - 1), ' '))) AS ngram FROM {source} WHERE len(t) >= {n}" for n in range(low, high + 1))
    return f"{name} AS ({each})"


COUNTS = "counts AS MATERIALIZED (SELECT n, ngram, count(*) AS cnt FROM grams GROUP BY n, ngram)"
HISTORY = "CASE WHEN contains({0}, ' ') THEN regexp_extract({0}, '^(.*) [^ ]+$', 1) ELSE '' END"
LOWER = "CASE WHEN contains({0}, ' ') THEN regexp_extract({0}, '^[^ ]+ (.*)$', 1) ELSE '' END"


def continuation(prefix: str, least: int, key: str) -> str:
    return f"""SELECT {key} AS ngram, CAST(sum(cnt) AS BIGINT) AS {prefix}_s, count(*) FILTER (cnt = 1) AS {prefix}_n1,
  count(*) FILTER (cnt = 2) AS {prefix}_n2, count(*) FILTER (cnt >= 3) AS {prefix}_n3 FROM counts WHERE n >= {least} GROUP BY 1"""


NF = continuation("nf", 2, HISTORY.format("ngram"))
NP = continuation("np", 2, LOWER.format("ngram"))
NFP = continuation("nfp", 3, HISTORY.format("(" + LOWER.format("ngram") + ")"))
INDEX = f"""
nf AS ({NF}), np AS ({NP}), nfp AS ({NFP}),
idx AS (
  SELECT c.n, c.ngram, {", ".join(f"coalesce({p}_{s}, 0) AS {p}_{s}" for p in ("nf", "np", "nfp") for s in ("s", "n1", "n2", "n3"))}, cnt
  FROM counts c LEFT JOIN np USING (ngram) LEFT JOIN nf USING (ngram) LEFT JOIN nfp USING (ngram))"""
COC = """coc AS (
  SELECT n, count(*) AS n_distinct, count(*) FILTER (cnt = 1) AS n1, count(*) FILTER (cnt = 2) AS n2, count(*) FILTER (cnt = 3) AS n3,
         count(*) FILTER (cnt = 4) AS n4, count(*) FILTER (cnt >= 5) AS n5p, CAST(sum(cnt) AS BIGINT) AS total FROM counts GROUP BY n)"""


def discounts(n: int = 3) -> str:
    """CTE ``disc`` (one row) with estimated discounts of the orders 1 to n."""
    steps = """
a5 AS (SELECT n, n1::DOUBLE AS x1, n2::DOUBLE AS x2, n3::DOUBLE AS x3, n4::DOUBLE AS x4, n5p::DOUBLE AS x5 FROM coc),
a4 AS (SELECT n, x1, x2, x3, CASE WHEN 5 * y >= 4 * x4 THEN 5 * y + 1 ELSE x4 END AS x4, y AS x5 FROM (SELECT *, CASE WHEN x5 = 0 THEN 1 ELSE x5 END AS y FROM a5)),
a3 AS (SELECT n, x1, x2, CASE WHEN 4 * y >= 3 * x3 THEN 4 * y + 1 ELSE x3 END AS x3, y AS x4 FROM (SELECT *, CASE WHEN x4 = 0 THEN 1 ELSE x4 END AS y FROM a4)),
a2 AS (SELECT n, x1, CASE WHEN 3 * y >= 2 * x2 THEN 3 * y + 1 ELSE x2 END AS x2, y AS x3, x4 FROM (SELECT *, CASE WHEN x3 = 0 THEN 1 ELSE x3 END AS y FROM a3)),
a1 AS (SELECT n, CASE WHEN 2 * y >= x1 THEN 2 * y + 1 ELSE x1 END AS x1, y AS x2, x3, x4 FROM (SELECT *, CASE WHEN x2 = 0 THEN 1 ELSE x2 END AS y FROM a2)),
ys AS (SELECT *, x1 / (x1 + 2 * x2) AS d, least(0.5, greatest(0.05, x1 / (x1 + 2 * x2))) AS y FROM a1),
raw AS (SELECT n, d, y, 1 - 2 * y * x2 / x1 AS r1, 2 - 3 * y * x3 / x2 AS r2, 3 - 4 * y * x4 / x3 AS r3 FROM ys),
per_n AS (SELECT n, d, least(0.95, greatest(0.05, r1 / (r1 + r2 + r3) * y)) AS m1, least(0.95, greatest(0.05, r2 / (r1 + r2 + r3) * y)) AS m2, least(0.95, greatest(0.05, r3 / (r1 + r2 + r3) * y)) AS m3 FROM raw)"""
    columns = ", ".join(f"max(d) FILTER (n = {k}) AS d{k}, " + ", ".join(f"max(m{j}) FILTER (n = {k}) AS d{k}_{j}" for j in (1, 2, 3)) for k in range(1, n + 1))
    return steps + f",\ndisc AS (SELECT {columns} FROM per_n)"


def fixed(n: int = 3) -> str:
    return "disc AS (SELECT " + ", ".join(f"0.7::DOUBLE AS d{k}, " + ", ".join(f"0.7::DOUBLE AS d{k}_{j}" for j in (1, 2, 3)) for k in range(1, n + 1)) + ")"


def looked(n: int = 3, tag: str = "") -> str:
    """CTE ``looked``(ngram and what models of order n read) of the distinct n-grams of ``test_sents``; needs ``counts``, ``coc`` and ``disc``."""
    part = lambda b, k: f"array_to_string(list_slice(t, i + {b}, i + {b + k - 1}), ' ')"
    suffixes = {f"s{k}": part(n - k, k) for k in range(1, n + 1)}
    slots = suffixes | {f"h{k}": part(n - k, k - 1) for k in range(2, n + 1)}
    each = ", ".join(f"{e} AS {s}" for s, e in slots.items())
    total = lambda p: f"{p}_n1 + {p}_n2 + {p}_n3"
    read = {"cnt": "cnt", "np": total("np"), "nf": total("nf"), "nfp": total("nfp"), **{f"nf_n{j}": f"nf_n{j}" for j in (1, 2, 3)}}
    columns = ", ".join(f"coalesce(max(CASE WHEN slot = '{s}' THEN {read[c]} END), 0)::DOUBLE AS {name}" for name, (s, c) in statistics(n).items())
    asked = " UNION ALL ".join(f"SELECT ngram, '{s}' AS slot, {s} AS key FROM tg{tag}" for s in slots)
    made = lambda prefix, least, key: continuation(prefix, least, key).replace(" GROUP BY 1", f" AND {key} IN (SELECT key FROM asked{tag}) GROUP BY 1")
    return f"""
tg{tag} AS MATERIALIZED (SELECT DISTINCT {part(0, n)} AS ngram, {each} FROM (SELECT t, unnest(range(1, len(t) - {n - 2})) AS i FROM test_sents WHERE len(t) >= {n})),
asked{tag} AS MATERIALIZED ({asked}),
nf{tag} AS ({made("nf", 2, HISTORY.format("ngram"))}), np{tag} AS ({made("np", 2, LOWER.format("ngram"))}), nfp{tag} AS ({made("nfp", 3, HISTORY.format("(" + LOWER.format("ngram") + ")"))}),
idx{tag} AS (
  SELECT c.ngram, cnt, {", ".join(f"coalesce({p}_n{j}, 0) AS {p}_n{j}" for p in ("nf", "np", "nfp") for j in (1, 2, 3))}
  FROM counts c LEFT JOIN np{tag} USING (ngram) LEFT JOIN nf{tag} USING (ngram) LEFT JOIN nfp{tag} USING (ngram) WHERE c.ngram IN (SELECT key FROM asked{tag})),
looked{tag} AS MATERIALIZED (
  SELECT w.*, k.* FROM (SELECT asked{tag}.ngram, {columns} FROM asked{tag} LEFT JOIN idx{tag} ON idx{tag}.ngram = key GROUP BY asked{tag}.ngram) w CROSS JOIN (
    SELECT (SELECT n_distinct FROM coc WHERE n = 1)::DOUBLE AS u, (SELECT n_distinct FROM coc WHERE n = 2)::DOUBLE AS b2, (SELECT total FROM coc WHERE n = 1)::DOUBLE AS s1, (SELECT total FROM coc WHERE n = 2)::DOUBLE AS s2, disc.* FROM disc) k)"""


def scored(probability: str, discount: str | None = None, n: int = 3) -> str:
    """CTE ``scored``(ngram, p, oov_last) of the distinct n-grams of ``test_sents``."""
    return f"\n{discount or fixed(n)},{looked(n)},\nscored AS (SELECT ngram, {probability} AS p, c1 = 0 AS oov_last FROM looked)"


OCCURRENCES = """
occ AS (
  SELECT doc_id, sent, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS ngram
  FROM (SELECT doc_id, sent, t, unnest(range(1, len(t) - 1)) AS i FROM test_sents WHERE len(t) >= 3)),
scores AS (SELECT doc_id, sent, ngram, CASE WHEN p > 0 THEN log10(p) ELSE '-inf'::DOUBLE END AS lp, oov_last FROM occ JOIN scored USING (ngram))"""
PERP = "CASE WHEN {1} > 0 AND {0} > '-inf'::DOUBLE AND pow(10, -{0} / {1}) < 'inf'::DOUBLE THEN pow(10, -{0} / {1}) ELSE 2147483647.0 END"


def summary(keys: str) -> str:
    """Sums and perplexities by keys over ``scores``."""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {keys + ", " if keys else ""}num_ngrams, num_oov, round(log10p, 6) AS log10p, round({PERP.format("log10p", "num_ngrams")}, 4) AS perp,
       round({PERP.format("log10p_noov", "(num_ngrams - num_oov)")}, 4) AS perp_noov
FROM (SELECT {keys + ", " if keys else ""}count(*) AS num_ngrams, count(*) FILTER (oov_last) AS num_oov, coalesce(sum(lp), 0) AS log10p, coalesce(sum(lp) FILTER (NOT oov_last), 0) AS log10p_noov FROM scores {by})"""




def tested(n: int = 3) -> str:
    """Training counts of the orders 1 to n (2 at least, which models need), their counts of counts, and test sentences."""
    return sentences() + ",\n" + grams(1, max(2, n)) + ",\n" + COUNTS + ",\n" + COC + "," + sentences("benchmark", "item_id", "test_sents")
