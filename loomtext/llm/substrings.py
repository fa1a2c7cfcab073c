"""Exact substring deduplication: Rabin-Karp windows, counted in shards, merged into removal intervals.

Every window of ``LENGTH`` words of every document has a 64-bit Rabin-Karp hash and a check of 16 bits, made
from the sum of its words' hashes; windows are equal if both are. A map task sorts the
windows of up to two million words of documents, counts equal ones once, and sends each shard its range of hashes as a blob of about eleven bytes a
distinct window (gap-coded hash, check, and the number of its first occurrence), with the doc_ids of the documents
that these are in. So a window that stands in most documents costs a shard one entry a batch. A shard finds the windows that
occur more than once and which occurrence is
the first by (doc_id, position); it answers each batch with window numbers only. With the batch's own list of equal windows that
is merged into intervals a document, which join the documents by doc_id: broadcast while they are
counted and found small, shuffled beyond that. Text is never part of the counting shuffle. The number of shards follows the
characters of the input.

All occurrences of a repeated window but the first are removed. Two different windows are taken for equal with a
chance of 2**-80 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import frames
from loomtext.llm import kernels as K
from loomtext.llm import spans as S
from loomtext.session import cut, read

U = np.uint64
LENGTH = 50
_BATCH_WINDOWS, _SHARD_CHARS = 2_000_000, 1 << 24
_ROW = "part int, uid long, kind int, a binary, b binary, c binary"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _row(part: list, uid: list, kind: list, a: list, b: list, c: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((part, uid, kind, a, b, c), _TYPES)], ["part", "uid", "kind", "a", "b", "c"])


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(U)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> U(1)).view(np.int64) ^ -(x & U(1)).astype(np.int64)


def _pack_docs(ids: np.ndarray, first: np.ndarray) -> bytes:
    """doc_ids in batch order and the number of each one's first window."""
    a = K.pack_ints(_zigzag(np.diff(ids, prepend=np.int64(0))))
    return len(a).to_bytes(4, "little") + a + K.pack_ints(np.diff(first, prepend=0))


def _unpack_docs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    return np.cumsum(_unzigzag(K.unpack_ints(blob[4 : 4 + n]))), np.cumsum(K.unpack_ints(blob[4 + n :]).astype(np.int64))


def _pack(*parts: bytes) -> bytes:
    return np.array([len(parts), *(len(p) for p in parts)], "<i4").tobytes() + b"".join(parts)


def _unpack(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    size = np.frombuffer(blob, "<i4", n, 4)
    end = 4 + 4 * n + np.cumsum(size)
    return [blob[e - s : e] for s, e in zip(size, end)]


def window_keys(words: K.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and check of every window, text by text."""
    w, at = K.windows(words.hash, words.off, length)
    total = np.zeros(len(words.hash) + 1, U)
    np.cumsum(K.mix(words.hash), out=total[1:])
    return w, (K.mix(total[at + length] - total[at]) >> U(48)).astype(np.uint16)


def _runs(h: np.ndarray, check: np.ndarray, doc: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by key, where each run of equal ones begins, and the run's first occurrence by (doc_id, place)."""
    order = np.argsort(h)
    key, sums = h[order], check[order]
    new = key[1:] != key[:-1]
    if (sums[1:] != sums[:-1])[~new].any():
        order = np.lexsort((check, h))
        key, sums = h[order], check[order]
        new = (key[1:] != key[:-1]) | (sums[1:] != sums[:-1])
    lead = np.flatnonzero(np.concatenate([[True], new]))
    del key, sums, new
    if (np.diff(doc) > 0).all():  # numbers ascend with (doc_id, place)
        return order, lead, np.minimum.reduceat(order, lead)
    some = np.flatnonzero(np.diff(np.append(lead, len(order))) > 1)
    start = order[lead].copy()
    for r in some:
        own = order[lead[r] : lead[r + 1] if r + 1 < len(lead) else len(order)]
        start[r] = own[np.lexsort((own, own - first[owner[own]], doc[owner[own]]))[0]]
    return order, lead, start


def _emit(buckets: int, length: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[np.ndarray] = []
    prints: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    checks: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        doc, text, n, h, check = (np.concatenate(x) for x in (ids, prints, counts, hashes, checks))
        for x in (ids, prints, counts, hashes, checks):
            x.clear()
        by = np.argsort(doc, kind="stable")
        if (by[1:] < by[:-1]).any():
            start = np.cumsum(n) - n
            move = np.repeat(start[by] - (np.cumsum(n[by]) - n[by]), n[by]) + np.arange(len(h))
            doc, text, n, h, check = doc[by], text[by], n[by], h[move], check[move]
        first = np.cumsum(n) - n
        place = K.mix(np.arange(1, len(doc) + 1, dtype=U) << U(32))
        uid = int(K.mix(np.array([(K.mix(doc.view(U) ^ place) ^ text).sum(dtype=U) ^ U(len(h))], U)).view(np.int64)[0])
        owner = np.repeat(np.arange(len(doc), dtype=np.int32), n)
        order, lead, number = _runs(h, check, doc, first, owner)
        size = np.diff(np.append(lead, len(order)))
        # what is equal to a batch's first occurrence stays here: later ones, and twins at the same place of rows with one doc_id
        more = np.repeat(size > 1, size)
        other, of = order[more], np.repeat(number, size)[more]
        other, of = other[other != of], of[other != of]
        twin = (doc[owner[other]] == doc[owner[of]]) & (other - first[owner[other]] == of - first[owner[of]])
        later, twins, twins_of = np.sort(other[~twin]), other[twin], of[twin]
        key = h[order[lead]]
        at = K.split_at(K.bucket_of(key, buckets), buckets)
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for b in np.flatnonzero(np.diff(at)):
            own = number[at[b] : at[b + 1]]
            here = np.zeros(len(doc), bool)
            here[owner[own]] = True
            here = np.flatnonzero(here)
            sums = check[own].tobytes()
            for column, value in zip(out, (b, uid, 0, _pack(K.pack_sorted(key[at[b] : at[b + 1]]), sums), K.pack_small(own * 2 + (size[at[b] : at[b + 1]] > 1)), _pack_docs(doc[here], first[here]))):
                column.append(value)
        equal = _pack(K.pack_ints(np.diff(later, prepend=0)), K.pack_small(twins), K.pack_small(twins_of))
        for column, value in zip(out, (uid % buckets, uid, 1, doc.astype("<i8").tobytes(), text.astype("<u8").tobytes(), _pack(n.astype("<i8").tobytes(), equal))):
            column.append(value)
        return _row(*out)

    total = 0
    for part, texts in S.slices(it):
        words = K.Words(texts)
        w, check = window_keys(words, length)
        n = np.maximum(np.diff(words.off) - length + 1, 0)
        has = n > 0
        if not has.any():
            continue
        ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[has])
        prints.append(K.text_hash(words)[has])
        counts.append(n[has])
        hashes.append(w)
        checks.append(check)
        total += len(w)
        if total >= _BATCH_WINDOWS:
            yield flush()
            total = 0
    if total:
        yield flush()


def _count(buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of one shard: for each batch the numbers of its repeated windows, those that are the first apart."""
    rows = []
    for batch in it:
        kinds = batch.column(2).to_numpy()
        if (kinds == 1).any():
            yield batch.filter(pa.array(kinds == 1))
        uids = batch.column(1).to_pylist()
        rows += [(uids[i], batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), batch.column(5)[i].as_py()) for i in np.flatnonzero(kinds == 0)]
    if not rows:
        return
    every, often = [], []
    for _, keys, own, _ in rows:
        h = K.unpack_sorted(_unpack(keys)[0])
        every.append(h)
        often.append(h[K.unpack_small(own) % 2 == 1])
    every = np.sort(np.concatenate(every))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *often]))
    del every, often
    if not len(twice):
        return
    hs, sums, many, docs, places, numbers, owners = [], [], [], [], [], [], []
    for k, (_, keys, own, table) in enumerate(rows):
        hashes, check = _unpack(keys)
        h = K.unpack_sorted(hashes)
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        hit = np.flatnonzero(twice[at] == h)
        if len(hit):
            flagged = K.unpack_small(own)[hit]
            number = flagged >> 1
            doc, first = _unpack_docs(table)
            d = np.searchsorted(first, number, "right") - 1
            hs.append(at[hit])
            sums.append(np.frombuffer(check, np.uint16)[hit])
            many.append(flagged % 2 == 1)
            docs.append(doc[d])
            places.append(number - first[d])
            numbers.append(number)
            owners.append(np.full(len(hit), k, np.int32))
    h, check, many, doc, place, number, owner = (np.concatenate(x) for x in (hs, sums, many, docs, places, numbers, owners))
    h = h << 16 | check
    order = np.lexsort((place, doc, h))
    lead = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    size = np.diff(np.append(lead, len(h)))
    run = np.repeat(lead, size)
    later, repeated = np.empty(len(h), bool), np.empty(len(h), bool)
    later[order] = (doc[order] != doc[order[run]]) | (place[order] != place[order[run]])
    repeated[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], lead), size)
    by = np.lexsort((number, owner))
    by = by[repeated[by]]
    at = np.searchsorted(owner[by], np.arange(len(rows) + 1))
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for k in np.flatnonzero(np.diff(at)):
        own = by[at[k] : at[k + 1]]
        x, gone = number[own], later[own]
        uid = rows[k][0]
        for column, value in zip(out, (uid % buckets, uid, 2, K.pack_ints(np.diff(x[~gone], prepend=0)), K.pack_ints(np.diff(x[gone], prepend=0)), b"")):
            column.append(value)
    if out[0]:
        yield _row(*out)


def _intervals(length: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text hash, whether the document has a repeated window, and what to remove, for documents that have one."""
    tables: dict[int, tuple] = {}
    firsts: dict[int, list] = {}
    laters: dict[int, list] = {}
    for batch in it:
        _, uid, kind, a, b, c = (batch.column(i).to_pylist() for i in range(6))
        for i in range(batch.num_rows):
            if kind[i] == 1:
                tables[uid[i]] = (a[i], b[i], c[i])
            else:
                firsts.setdefault(uid[i], []).append(np.cumsum(K.unpack_ints(a[i]).astype(np.int64)))
                laters.setdefault(uid[i], []).append(np.cumsum(K.unpack_ints(b[i]).astype(np.int64)))
    for uid, seen in laters.items():
        sizes, equal = _unpack(tables[uid][2])
        doc, text, n = (np.frombuffer(x, "<i8") for x in (*tables[uid][:2], sizes))
        start = np.cumsum(n) - n
        here, twins, twins_of = _unpack(equal)
        twins, twins_of = K.unpack_small(twins), K.unpack_small(twins_of)
        later, first = np.concatenate(seen), np.concatenate(firsts[uid])
        again = np.isin(twins_of, later)
        later = np.sort(np.concatenate([later, np.cumsum(K.unpack_ints(here).astype(np.int64)), twins[again]]))
        first = np.concatenate([first, twins[~again]])
        has = np.zeros(len(doc), bool)
        has[np.searchsorted(start, first, "right") - 1] = True
        owner = np.searchsorted(start, later, "right") - 1
        has[owner] = True
        at = np.searchsorted(owner, np.arange(len(doc) + 1))
        ids, hashes, blobs = [], [], []
        for d in np.flatnonzero(has):
            begin, end = S.merge(later[at[d] : at[d + 1]] - start[d], length)
            ids.append(doc[d])
            hashes.append(text[d])
            blobs.append(np.concatenate([begin, end]).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "text_hash", "ranges"])


def removal_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and an array of (text_hash, ranges), for documents with a repeated window; ``ranges`` holds word
    numbers as 32-bit integers, all beginnings and then all ends, and is empty where only first occurrences are."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    buckets = frames.shards(rows, _SHARD_CHARS)
    sent = rows.mapInArrow(partial(_emit, buckets, length), _ROW).repartitionById(buckets, F.col("part"))
    answers = sent.mapInArrow(partial(_count, buckets), _ROW).repartitionById(buckets, F.col("part"))
    found = answers.mapInArrow(partial(_intervals, length), "doc_id long, text_hash long, ranges binary")
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("text_hash", "ranges")).alias("ranges"))


def _joined(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` and a last column of ranges."""
    key, ranges = frames.fresh(docs, "__id"), frames.fresh(docs, "__ranges")
    found = cut(removal_intervals(docs, length).withColumnsRenamed({"doc_id": key, "ranges": ranges}))
    size = found.agg(F.sum(F.expr(f"32 + aggregate({ranges}, 0L, (n, r) -> n + 16 + octet_length(r.ranges))"))).first()[0] or 0
    return docs.join(frames.sized(found, 1, size), F.col("doc_id").cast("long") == F.col(key), "left").select(*frames.every(docs), ranges)


def _cuts(part: pa.RecordBatch, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, str]]:
    """(row, words of the text, beginnings, ends, what is left) of the rows with repeated windows."""
    column = part.column(part.num_columns - 1)
    hit = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(hit):
        some = [texts[i] for i in hit]
        words = K.Words(some)
        prints = K.text_hash(words).view(np.int64)
        for k, i in enumerate(hit):
            own = {r["text_hash"]: r["ranges"] for r in column[int(i)].as_py()}.get(int(prints[k]))
            if own is not None:
                begin, end = np.frombuffer(own, "<i4").reshape(2, -1)
                yield int(i), int(words.off[k + 1] - words.off[k]), begin, end, S.cut_words(some[k], words, k, begin, end)


def _apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in S.slices(it):
        changed = {i: left for i, _, begin, _, left in _cuts(part, texts) if len(begin)}
        yield S.with_text(part.select(part.schema.names[:-1]), changed)


def _report(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in S.slices(it):
        n = part.num_rows
        repeats, intervals, removed = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int64)
        left: list[str | None] = part.column(1).to_pylist()
        for i, _, begin, end, text in _cuts(part, texts):
            repeats[i], intervals[i], removed[i], left[i] = True, len(begin), int((end - begin).sum()), text
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(repeats), pa.array(intervals), pa.array(removed), pa.array(left, pa.string())], ["doc_id", "has_repeat", "n_intervals", "removed_words", "text"])


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, has_repeat, n_intervals, removed_words and the text that is left, for every row.

    ``has_repeat``: the document has a window that occurs more than once, here or elsewhere, the
    first occurrence included; removed are the later ones, by (doc_id, position). Defined cases: a
    null text, one under ``length`` words, or a row without doc_id has no windows and stays as it
    is; of windows at one place of rows that share a doc_id none is later than the other, so
    repeated rows are treated alike; rows that share a doc_id but differ in text have intervals each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _joined(rows, length).mapInArrow(_report, "doc_id long, has_repeat boolean, n_intervals int, removed_words long, text string")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the later occurrences of repeated windows: same rows and columns, shorter texts and n_chars.

    Defined cases: as in ``repeats``; so rows with a null or short text, or without doc_id, stay as they are, repeated
    rows are treated alike, and an empty table stays empty.
    """
    return frames.map_rows(_joined(docs, length), _apply, 1)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"))


SQL = {
    "op9_substrings": """
WITH pieces AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS p,
         regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM pieces WHERE len(w) >= 50)),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k, count(*) OVER (PARTITION BY g) AS n FROM grams),
again AS (SELECT doc_id, i FROM ranked WHERE k > 1),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM again),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
ranges AS (SELECT doc_id, k, min(i) AS b, max(i) + 49 AS e FROM numbered GROUP BY doc_id, k),
per_doc AS (SELECT doc_id, count(*) AS n_intervals, sum(e - b + 1) AS removed_words FROM ranges GROUP BY doc_id),
touched AS (SELECT DISTINCT doc_id FROM ranked WHERE n > 1),
parts AS (
  SELECT doc_id, j, x, sum(CASE WHEN regexp_matches(x, '^[\\p{L}\\p{N}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j) AS wn,
         regexp_matches(x, '^[\\p{L}\\p{N}]') AS is_word
  FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM pieces WHERE doc_id IN (SELECT doc_id FROM per_doc))),
kept AS (
  SELECT p.doc_id, string_agg(p.x, '' ORDER BY p.j) AS text
  FROM parts p WHERE NOT EXISTS (
    SELECT 1 FROM ranges r WHERE r.doc_id = p.doc_id AND p.wn >= r.b AND (p.wn < r.e OR (p.wn = r.e AND p.is_word)))
  GROUP BY p.doc_id)
SELECT d.doc_id, (t.doc_id IS NOT NULL) AS has_repeat, CAST(coalesce(q.n_intervals, 0) AS INTEGER) AS n_intervals,
       CAST(coalesce(q.removed_words, 0) AS BIGINT) AS removed_words,
       CASE WHEN q.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN per_doc q USING (doc_id) LEFT JOIN touched t USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
}
