"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

A test item's n-grams are its windows of ``N`` words (letters and numbers, lower case, so punctuation,
case and spacing don't matter); an item of ``SHORTEST`` to N - 1 words counts as one n-gram of its own
length. A shorter item is too common within running text to be evidence there; it counts where its words are
all the words of a line. The n-grams' Rabin-Karp hashes are broadcast as one
sorted array; each window of each document is looked up, each hit is compared word by word with the
item, and what hits cover is merged into spans. Spans go; a document goes as a whole when they hold
more than ``DROP_SHARE`` of its words.

One narrow pass over the text and no shuffle, as long as the hashes fit ``SLICE_NGRAMS``, which bounds what is broadcast. A larger
benchmark is looked up slice by slice; the hits are then joined to the documents by a hash of the text, and verified by
another, so the result doesn't depend on the number of slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import frames, spans
from loomtext.llm import kernels as K
from loomtext.session import cut, read

U = np.uint64
N, SHORTEST, DROP_SHARE = 13, 6, 0.5
SLICE_NGRAMS = 4_000_000
_REPORT = "doc_id long, contaminated boolean, dropped boolean, n_spans int, span_words long, items array<long>, text string"


class Index:
    """Sorted n-gram hashes of some test items, by length, and the words to verify hits with."""

    def __init__(self, ids: list[int], texts: list[str], n: int) -> None:
        words = K.Words(texts)
        size = np.diff(words.off)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.ids = np.array(ids, np.int64)
        self.words = [[words.word(j) for j in range(words.off[i], words.off[i + 1])] for i in range(len(texts))]
        for length in sorted({n, *(int(s) for s in size if 0 < s < n)}):
            h, at = K.windows(words.hash, words.off, length)
            item = np.searchsorted(words.off, at, "right") - 1
            if length < n:
                own = size[item] == length
                h, at, item = h[own], at[own], item[own]
            order = np.argsort(h, kind="stable")
            if len(order):
                self.tables[length] = (h[order], item[order], (at - words.off[item])[order])

    def find(self, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and item of every verified hit; words are numbered as in ``words``."""
        first, length, item = [], [], []
        for n, (known, owner, place) in self.tables.items():
            h, at = K.windows(words.hash, words.off, n)
            if not len(h):
                continue
            low = np.searchsorted(known, h)
            low[low == len(known)] = 0
            for k in np.flatnonzero(known[low] == h):
                if n < SHORTEST and not _whole_line(words, int(at[k]), n):
                    continue
                own = [words.word(j) for j in range(at[k], at[k] + n)]
                c = low[k]
                while c < len(known) and known[c] == h[k]:
                    if self.words[owner[c]][place[c] : place[c] + n] == own:
                        first.append(at[k])
                        length.append(n)
                        item.append(self.ids[owner[c]])
                    c += 1
        return np.array(first, np.int64), np.array(length, np.int64), np.array(item, np.int64)


def _whole_line(words: K.Words, at: int, n: int) -> bool:
    """Whether a line feed or the text's end is on both sides of ``n`` words from ``at`` on, and none within."""
    doc = int(np.searchsorted(words.off, at, "right")) - 1
    start = words.end[at - 1] if at > words.off[doc] else words.base[doc]
    end = words.start[at + n] if at + n < words.off[doc + 1] else words.base[doc + 1]
    breaks = lambda a, b: bool((words.cps[a:b] == 10).any())
    return (at == words.off[doc] or breaks(start, words.start[at])) and (at + n == words.off[doc + 1] or breaks(words.end[at + n - 1], end)) and not breaks(words.start[at], words.end[at + n - 1])


def _hits(index: Index, texts: list[str]) -> Iterator[tuple[int, K.Words, np.ndarray, np.ndarray, list[int]]]:
    """(text, words, beginnings, ends, items) of every text that has hits; word numbers are the text's own."""
    words = K.Words(texts)
    first, length, item = index.find(words)
    doc = np.searchsorted(words.off, first, "right") - 1
    for d in np.unique(doc):
        own = np.flatnonzero(doc == d)
        own = own[np.argsort(first[own], kind="stable")]
        begin, end = spans.merge(first[own] - words.off[d], length[own])
        yield int(d), words, begin, end, sorted({int(x) for x in item[own]})


def _found(index, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in spans.slices(it):
        rows = [(part.column(0)[d].as_py(), int(K.text_hash(w).view(np.int64)[d]), np.concatenate([b, e]).astype("<i4").tobytes(), items) for d, w, b, e, items in _hits(index.value, texts)]
        key, text, ranges, items = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(text, pa.int64()), pa.array(ranges, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["key", "text_hash", "ranges", "items"])


def _joined_hits(texts: list[str], column: pa.Array) -> Iterator[tuple[int, K.Words, np.ndarray, np.ndarray, list[int]]]:
    """As ``_hits``, from the hits that were found slice by slice."""
    words = K.Words(texts)
    prints = K.text_hash(words).view(np.int64)
    for d in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
        own = [r for r in column[int(d)].as_py() if r["text_hash"] == prints[d]]
        if own:
            both = np.concatenate([np.frombuffer(r["ranges"], "<i4").reshape(2, -1) for r in own], axis=1).astype(np.int64)
            both = both[:, np.argsort(both[0], kind="stable")]
            begin, end = spans.merge(both[0], both[1] - both[0])
            yield int(d), words, begin, end, sorted({x for r in own for x in r["items"]})


def _work(index, share: float, apply: bool, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch without spans and dropped documents (``apply``), or the report on it; ``index`` None: the last column holds the hits."""
    for part, texts in spans.slices(it):
        hits = _joined_hits(texts, part.column(part.num_columns - 1)) if index is None else _hits(index.value, texts)
        n = part.num_rows
        gone, spans_of, words_of, items_of, left = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int64), [[] for _ in range(n)], {}
        for d, words, begin, end, items in hits:
            spans_of[d], words_of[d], items_of[d] = len(begin), int((end - begin).sum()), items
            gone[d] = words_of[d] > share * int(words.off[d + 1] - words.off[d])
            if not gone[d]:
                left[d] = spans.cut_words(texts[d], words, d, begin, end)
        if apply:
            whole = part if index is not None else part.select(part.schema.names[:-1])
            yield spans.with_text(whole, left).filter(pa.array(~gone))
        else:
            text = part.column(1).to_pylist()
            for d, t in left.items():
                text[d] = t
            text = [None if g else t for g, t in zip(gone, text)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans_of > 0), pa.array(gone), pa.array(spans_of), pa.array(words_of), pa.array(items_of, pa.list_(pa.int64())), pa.array(text, pa.string())], ["doc_id", "contaminated", "dropped", "n_spans", "span_words", "items", "text"])


def _indexes(benchmark: DataFrame, n: int, slice_ngrams: int) -> list:
    """Broadcast indexes, each of at most about ``slice_ngrams`` n-grams; items are spread over them by hash."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    k = max(1, -(-chars // (slice_ngrams * 5)))
    out = []
    for i in range(k):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id, text), {k}) = {i}")).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        out.append(benchmark.sparkSession.sparkContext.broadcast(Index(rows["item_id"].to_pylist(), rows["text"].to_pylist(), n)))
    return out


def _run(docs: DataFrame, benchmark: DataFrame, n: int, share: float, apply: bool, slice_ngrams: int) -> DataFrame:
    indexes = _indexes(benchmark, n, slice_ngrams)
    if len(indexes) == 1:
        work = partial(_work, indexes[0], share, apply)
        return frames.map_rows(docs, work) if apply else docs.mapInArrow(work, _REPORT)
    text = F.xxhash64("text")
    rows = docs.where("text is not null").select(text.alias("key"), "text")
    parts = [rows.mapInArrow(partial(_found, x), "key long, text_hash long, ranges binary, items array<long>") for x in indexes]
    key, hits = frames.fresh(docs, "__key"), frames.fresh(docs, "__hits")
    found = cut(reduce(DataFrame.unionByName, parts).groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("text_hash", "ranges", "items")).alias(hits)))
    size = found.agg(F.sum(F.expr(f"32 + aggregate({hits}, 0L, (n, r) -> n + 48 + octet_length(r.ranges) + 8 * size(r.items))"))).first()[0] or 0
    joined = docs.join(frames.sized(found, 1, size), text == F.col(key), "left").select(*frames.every(docs), hits)
    work = partial(_work, None, share, apply)
    return frames.map_rows(joined, work, 1) if apply else joined.mapInArrow(work, _REPORT)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = DROP_SHARE, slice_ngrams: int = SLICE_NGRAMS) -> DataFrame:
    """doc_id, contaminated, dropped, n_spans, span_words, items (whose n-grams were found) and text (what is left), for every row.

    Defined cases: a null or empty text, and one shorter than every n-gram, is clean; ``text`` is null where
    the document is dropped; repeated rows, rows that share a doc_id and rows without one are scanned each for itself;
    items without id, text or word, and an empty
    benchmark, match nothing; of equal items all are reported; an empty table gives an empty result. Other columns are not read.
    """
    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, n, share, False, slice_ngrams)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = DROP_SHARE, slice_ngrams: int = SLICE_NGRAMS) -> DataFrame:
    """``docs`` without contaminated documents and spans; same columns, n_chars made to fit the shorter texts.

    Defined cases: as in ``contamination``; so rows with a null or empty text stay as they are, with any doc_id,
    repeated rows are treated alike, and an empty table stays empty.
    """
    return _run(docs, benchmark, n, share, True, slice_ngrams)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = {
    "op6_decontamination": """
WITH pieces AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS p,
         regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
keys AS (
  SELECT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) >= 6)),
lengths AS (SELECT DISTINCT n FROM keys),
lines AS (
  SELECT doc_id, CAST(coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS i, len(w) AS n, array_to_string(w, ' ') AS g
  FROM (SELECT doc_id, l, regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents))),
grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM pieces, lengths WHERE len(w) >= n)),
hits AS (
  SELECT doc_id, i, g.n, item_id FROM grams g JOIN keys k ON g.g = k.g AND g.n = k.n
  UNION ALL SELECT doc_id, i, n, item_id FROM lines JOIN items ON g = array_to_string(items.w, ' ') WHERE n BETWEEN 1 AND 5),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hits),
numbered AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS k FROM covered),
ranges AS (SELECT doc_id, min(j) AS b, max(j) AS e FROM numbered GROUP BY doc_id, k),
per_doc AS (SELECT doc_id, count(*) AS n_spans, sum(e - b + 1) AS span_words FROM ranges GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY doc_id),
parts AS (
  SELECT doc_id, j, x, sum(CASE WHEN regexp_matches(x, '^[\\p{L}\\p{N}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j) AS wn,
         regexp_matches(x, '^[\\p{L}\\p{N}]') AS is_word
  FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM pieces WHERE doc_id IN (SELECT doc_id FROM per_doc))),
kept AS (
  SELECT p.doc_id, string_agg(p.x, '' ORDER BY p.j) AS text
  FROM parts p WHERE NOT EXISTS (
    SELECT 1 FROM ranges r WHERE r.doc_id = p.doc_id AND p.wn >= r.b AND (p.wn < r.e OR (p.wn = r.e AND p.is_word)))
  GROUP BY p.doc_id)
SELECT d.doc_id, (q.doc_id IS NOT NULL) AS contaminated, coalesce(q.span_words > 0.5 * len(d.w), false) AS dropped,
       CAST(coalesce(q.n_spans, 0) AS INTEGER) AS n_spans, CAST(coalesce(q.span_words, 0) AS BIGINT) AS span_words,
       coalesce(f.items, []) AS items,
       CASE WHEN q.doc_id IS NULL THEN d.text WHEN q.span_words > 0.5 * len(d.w) THEN NULL ELSE coalesce(k.text, '') END AS text
FROM pieces d LEFT JOIN per_doc q USING (doc_id) LEFT JOIN found f USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
}
