"""N-gram statistics without a row or a string for each n-gram.

A word is known by a 64-bit hash of its bytes and an n-gram by one made of its words' hashes. A task sends each shard of hashes the
distinct n-grams of some million words with their counts, packed into a few rows; what occurs in a shard is complete, so it is added up there by sorting.
Two things come out: how many n-grams of an order occur how often, and, of n-grams that are asked for, what an index has of them. Only the latter
are looked up, in a sorted array that every task has; of orders whose counts aren't asked for, what adds to no such n-gram isn't sent at all.

Among 10^9 distinct n-grams of an order two share a hash with a probability of 3 %; they would be counted as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import frames
from loomtext.llm import kernels as K
from loomtext.operators import counting
from loomtext.session import cut, freeing

U = np.uint64
#: Words of a batch, of rows that are counted one by one, bytes of text for a shard, and n-grams that are looked up in one pass over the text.
BATCH_WORDS, ROW_WORDS, SHARD_BYTES, MOST_KEYS = 1_500_000, 500_000, 1 << 25, 8_000_000
_ROW = "part int, n int, h binary, cnt binary, own binary, nf binary, np binary, nfp binary"
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
_SENT = "kind int, id long, col int, value long"
#: What an index has of an n-gram here: its count, and how many n-grams with it as history, lower order and inner part occur once, twice, more often.
STATS = ["cnt", *[f"{p}_n{j}" for p in ("nf", "np", "nfp") for j in (1, 2, 3)]]


def shards(docs: DataFrame) -> int:
    return frames.shards(docs, SHARD_BYTES)


# -- hashes -------------------------------------------------------------------------------------


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a string array without nulls."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    wide = pa.types.is_large_string(words.type)
    off = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32, n + 1, words.offset * (8 if wide else 4)).astype(np.int64)
    first, size = off[0], np.diff(off)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[first : off[-1]]
    up, down = K._powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(K.mix(np.arange(256).astype(U) + U(0x6A09E667F3BCC909))[data] * up[: len(data)], out=total[1:])
    h = (total[off[1:] - first] - total[off[:-1] - first]) * down[off[:-1] - first]
    return K.mix(h ^ (size.astype(U) * U(0xD6E8FEB86659FD93)))


def longer(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with a word more."""
    return K.mix(g * U(0x9FB21C651E98DF25) + w)


def sentences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a batch whose first column is arrays of them, and how many each row has."""
    column = batch.column(0)
    words = column.flatten().dictionary_encode()
    return hashes(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)], np.diff(column.offsets.to_numpy()).astype(np.int64)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words' hashes, and how many words there are from each to its sentence's end, of some million words."""
    words, sizes, n = [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        w, size = np.concatenate(words), np.concatenate(sizes)
        return w, np.repeat(np.cumsum(size), size) - np.arange(len(w))

    for batch in it:
        if not batch.num_rows:
            continue
        w, size = sentences(batch)
        words.append(w)
        sizes.append(size)
        n += len(w)
        if n >= BATCH_WORDS:
            yield made()
            words, sizes, n = [], [], 0
    if n:
        yield made()


def _keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ngram with h, its hash, of batches of ngram and its words."""
    for batch in it:
        w, size = sentences(batch.select([1]))
        g = np.zeros(len(size), U)
        first = np.cumsum(size) - size
        for k in range(int(size.max()) if len(size) else 0):
            on = size > k
            g[on] = w[first[on]] if k == 0 else longer(g[on], w[first[on] + k])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g.view(np.int64))], ["ngram", "h"])


def keyed(ngrams: DataFrame) -> DataFrame:
    """Distinct ``ngram`` with h, its hash."""
    return ngrams.select("ngram").distinct().select("ngram", F.split("ngram", " ").alias("w")).mapInArrow(_keyed, "ngram string, h long")


# -- shards -------------------------------------------------------------------------------------


class Asked:
    """Numbers from 1 of hashes that are asked for; 0 of all others."""

    def __init__(self, h: np.ndarray) -> None:
        self.h = np.unique(h.view(U))
        self.shift = U(64 - 22)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.h >> self.shift] = True

    def numbers(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), np.int32)
        if len(self.h):
            some = np.flatnonzero(self.maybe[g >> self.shift])
            at = np.searchsorted(self.h, g[some])
            at[at == len(self.h)] = 0
            found = self.h[at] == g[some]
            out[some[found]] = at[found] + 1
        return out


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _rows(buckets: int, n: int, h: np.ndarray, cnt: np.ndarray, roles: list[np.ndarray]) -> pa.RecordBatch:
    """Ascending hashes with their counts and numbers, a row a shard."""
    at = K.split_at(K.bucket_of(h, buckets), buckets)
    some = np.flatnonzero(np.diff(at))
    small = lambda x: K.pack_small(x) if x.any() else None
    cells = [[int(b), n, K.pack_sorted(h[p:q]), K.pack_ints(cnt[p:q]), *[small(r[p:q]) for r in roles], *[None] * (4 - len(roles))] for b, p, q in zip(some, at[some], at[some + 1])]
    return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(_TYPES)], [c.split()[0] for c in _ROW.split(", ")])


def _emit(orders: int, full: frozenset[int], asked: Broadcast, buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for w, left in _batches(it):
        g, numbers = w, []
        for n in range(1, orders + 1):
            if n > 1:
                g = longer(g[:-1], w[n - 1 :])
            if not len(g):
                break
            here = np.flatnonzero(left[: len(g)] >= n)
            numbers.append(asked.value.numbers(g))
            roles = [numbers[n - 1][here]]
            if n > 1:
                roles += [numbers[n - 2][here], numbers[n - 2][here + 1]]
            if n > 2:
                roles.append(numbers[n - 3][here + 1])
                numbers[n - 3] = None
            wanted = reduce(np.logical_or, [r > 0 for r in roles])
            h = g[here]
            if n in full:
                rest = np.sort(h[~wanted])
                first = _firsts(rest)
                if len(first):
                    yield _rows(buckets, n, rest[first], np.diff(np.append(first, len(rest))), [])
            h, roles = h[wanted], [r[wanted] for r in roles]
            order = np.argsort(h)
            h = h[order]
            first = _firsts(h)
            if len(first):
                yield _rows(buckets, n, h[first], np.diff(np.append(first, len(h))), [r[order[first]] for r in roles])


def _sums(kind: int, key: np.ndarray, col: int, value: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(np.full(n, col, np.int32)), pa.array(value.astype(np.int64))], ["kind", "id", "col", "value"])


def _add(full: frozenset[int], asked: Broadcast, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's n-grams, which are complete: kind n has how many occur how often; kind 0 has, by hash, what they add to what is asked for."""
    got: dict[int, list[tuple]] = {}
    for batch in it:
        for n, *cells in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
            got.setdefault(n, []).append(cells)
    for n in sorted(got):
        rows = got.pop(n)
        h, cnt = np.concatenate([K.unpack_sorted(r[0]) for r in rows]), np.concatenate([K.unpack_ints(r[1]) for r in rows]).astype(np.int64)
        size = [int.from_bytes(r[0][1:5], "little") for r in rows]
        roles = [np.concatenate([np.zeros(s, np.int32) if r[2 + k] is None else K.unpack_small(r[2 + k]).astype(np.int32) for s, r in zip(size, rows)]) for k in range(4)]
        del rows
        order = np.argsort(h)
        first = _firsts(h[order])
        cnt = np.add.reduceat(cnt[order], first)
        if n in full:
            yield _sums(n, *(lambda v, t: (v, 0, t))(*np.unique(cnt, return_counts=True)))
        for k, role in enumerate(roles):
            role = role[order[first]]
            some = np.flatnonzero(role)
            number, c = role[some], cnt[some]
            if k == 0:
                yield _sums(0, asked.value.h[number - 1].view(np.int64), 0, c)
                continue
            for j in (1, 2, 3):
                of, times = np.unique(number[c == j if j < 3 else c >= 3], return_counts=True)
                yield _sums(0, asked.value.h[of - 1].view(np.int64), 3 * k - 3 + j, times)


def _pass(sents: DataFrame, orders: int, full: frozenset[int], keys: DataFrame | None, buckets: int) -> DataFrame:
    spark = sents.sparkSession
    h = keys.select("h").toArrow()["h"].to_numpy() if keys is not None else np.zeros(0, np.int64)
    asked = spark.sparkContext.broadcast(Asked(h))
    with freeing(spark):
        sent = sents.select("tokens").mapInArrow(partial(_emit, orders, full, asked, buckets), _ROW).repartitionById(buckets, F.col("part"))
        return cut(sent.mapInArrow(partial(_add, full, asked), _SENT).groupBy("kind", "id", "col").agg(F.sum("value").alias("value")))


def statistics(sents: DataFrame, orders: int, buckets: int, keys: DataFrame | None = None, full: range | None = None) -> tuple[DataFrame, DataFrame | None]:
    """n, cnt, times: how many n-grams of the orders ``full`` (all up to ``orders``) occur how often; and ngram with ``STATS`` of those of ``keys`` that occur.

    N-grams of the orders 1 to ``orders`` of ``sents`` (tokens, an array without nulls) count, none is longer or shorter. More keys than
    ``MOST_KEYS`` are looked up in several passes.
    """
    full = frozenset(full if full is not None else range(1, orders + 1))
    histogram = lambda p: p.where("kind > 0").select(F.col("kind").alias("n"), F.col("id").alias("cnt"), F.col("value").alias("times"))
    if keys is None:
        return histogram(_pass(sents, orders, full, None, buckets)), None
    known = cut(keyed(keys))
    rounds = max(1, -(-known.count() // MOST_KEYS))
    passes = [_pass(sents, orders, full if r == 0 else frozenset(), known.where(F.expr(f"pmod(h, {rounds}) = {r}")), buckets) for r in range(rounds)]
    found = reduce(DataFrame.unionByName, [p.where("kind = 0") for p in passes])
    wide = found.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("col") == i, F.col("value"))), F.lit(0)).alias(c) for i, c in enumerate(STATS)]).where("cnt > 0")
    return histogram(passes[0]), known.join(wide, known["h"] == wide["id"]).select("ngram", *STATS)


def count_of_counts(histogram: DataFrame) -> DataFrame:
    """As ``counting.count_of_counts``, of how many n-grams occur how often."""
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("times"))), F.lit(0))
    exact = [of(F.col("cnt") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    return histogram.groupBy("n").agg(F.sum("times").alias("n_distinct"), *exact, of(F.col("cnt") >= 5).alias("n5p"), F.sum(F.col("cnt") * F.col("times")).alias("total"))


# -- within documents ---------------------------------------------------------------------------


def _row_counts(orders: range, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        ends = whole.column(1).offsets.to_numpy()[1:].astype(np.int64)
        at = 0
        while at < whole.num_rows:  # rows of about ROW_WORDS words at a time, one row at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROW_WORDS, "right")))
            batch, at = whole.slice(at, to - at), to
            w, size = sentences(batch.select([1]))
            row = np.repeat(np.arange(len(size)), size)
            left = np.repeat(np.cumsum(size), size) - np.arange(len(w))
            apart = K.mix(np.arange(len(size)).astype(U) + U(0x3C6EF372FE94F82B))[row]
            g = w
            for n in range(1, orders.stop):
                if n > 1:
                    g = longer(g[:-1], w[n - 1 :])
                if n not in orders:
                    continue
                here = np.flatnonzero(left[: len(g)] >= n)
                of, h = row[here], K.mix(g[here] + apart[here])
                order = np.argsort(h)
                new = order[_firsts(h[order])]
                cnt, distinct = np.bincount(of, minlength=len(size)), np.bincount(of[new], minlength=len(size))
                some = np.flatnonzero(cnt)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(np.full(len(some), n, np.int32)), pa.array(cnt[some]), pa.array(distinct[some])], ["doc_id", "n", "cnt", "n_distinct"])


def across_counts(docs: DataFrame, orders: range, key: str = "doc_id") -> DataFrame:
    """doc_id, n, and how many n-grams, across sentence ends, its row has in all and distinct ones.

    A row is counted within its task. Only what rows share a doc_id with others has a row for each n-gram, so that one that several of them have counts once.
    """
    shared = cut(docs.groupBy(F.col(key).alias("__id")).count().where("count > 1").select("__id"))
    kind = docs.schema[key].dataType.simpleString()
    count = lambda rows: counting.joined(rows, key).mapInArrow(partial(_row_counts, orders), f"doc_id {kind}, n int, cnt long, n_distinct long")
    n = shared.count()
    if not n:
        return count(docs)
    on, ids = F.col(key).eqNullSafe(F.col("__id")), frames.sized(shared, n, 16)
    together = counting.across(docs.join(ids, on, "left_semi"), orders, key).groupBy("doc_id", "n").agg(F.count("*").alias("cnt"), F.countDistinct("ngram").alias("n_distinct"))
    return count(docs.join(ids, on, "left_anti")).unionByName(together)
