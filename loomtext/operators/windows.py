"""Counts and continuation statistics of all uni-, bi- and trigrams, from one exchange of packed windows.

A window is a bigram with the word after it (forward) or before it (backward), or with none where a sentence ends. A task sends each shard, by the bigram's hash,
the distinct windows of some million words with their counts: the words that they use once, and numbers of these. So a shard has all windows of its bigrams:
what is known of bigrams and trigrams is complete there, and what is known of words are sums of as many rows as there are shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import kernels as K
from loomtext.operators import sharded
from loomtext.operators.counting import STATS
from loomtext.session import executed

U = np.uint64
FORWARD, BACKWARD = 0, 1
_CELLS = ["a", "b", "c", "cnt", "words", "sizes"]
_ROW = "part int, side int, " + ", ".join(f"{c} binary" for c in _CELLS)
_OUT_ROWS = 100_000
#: Words whose statistics every task has when it looks for the best after a word.
FREQUENT_WORDS = 100_000
KINDS = {p: [f"{p}_{s}" for s in ("s", "n1", "n2", "n3")] for p in ("nf", "np", "nfp")}


def _ordered(a: np.ndarray, b: np.ndarray, c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of numbers up to ``size``, and where runs of equal ones begin in it."""
    bits = size.bit_length()
    if 3 * bits <= 63:
        x = (a.astype(np.int64) << 2 * bits) | (b.astype(np.int64) << bits) | c
        order = np.argsort(x)
        return order, _first(x[order])
    order = np.lexsort((c, b, a))
    return order, _first(a[order], b[order], c[order])


def _first(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


# -- windows ------------------------------------------------------------------------------------


def _cells(buckets: int, side: int, words: pa.Array, h: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    none = len(words)
    order, first = _ordered(a, b, c, none)
    cnt = np.diff(np.append(first, len(order)))
    a, b, c = (x[order[first]] for x in (a, b, c))
    bucket = K.bucket_of(sharded.longer(h[a], h[b]), buckets)
    order = np.argsort(bucket, kind="stable")
    at = K.split_at(bucket[order], buckets)
    out = []
    for part in np.flatnonzero(np.diff(at)):
        own = order[at[part] : at[part + 1]]
        cell = [x[own] for x in (a, b, c)]
        used = np.unique(np.concatenate(cell))
        cell = [np.searchsorted(used, x) for x in cell]
        used = used[used < none]  # none is the largest, so it is the number after the last word's
        names = words.take(pa.array(used)).cast(pa.large_binary())
        sizes = pc.binary_length(names).to_numpy(zero_copy_only=False)
        out.append((int(part), side, K.pack_ints(np.diff(cell[0], prepend=0)), K.pack_small(cell[1]), K.pack_small(cell[2]), K.pack_ints(cnt[own]), b"".join(names.to_pylist()), K.pack_ints(sizes)))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["part", "side", *_CELLS])


def _emit(buckets: int, sides: tuple[int, ...], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, sizes, n = [], [], 0

    def made() -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array(parts).dictionary_encode().combine_chunks()
        words, i = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        size, none = np.concatenate(sizes), len(coded.dictionary)
        h = np.append(sharded.hashes(words), U(0))
        place = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - place
        after = lambda k: np.where(left > k, np.append(i[k:], np.full(k, none, i.dtype)), none)
        if FORWARD in sides:
            yield _cells(buckets, FORWARD, words, h, i, after(1), after(2))
        if BACKWARD in sides:
            on = np.flatnonzero(left > 1)
            before = np.where(place > 0, np.append(i[:1], i[:-1]), none)
            yield _cells(buckets, BACKWARD, words, h, i[on], after(1)[on], before[on])

    for batch in it:
        if not batch.num_rows:
            continue
        column = batch.column(0)
        parts.append(column.flatten())
        sizes.append(np.diff(column.offsets.to_numpy()).astype(np.int64))
        n += len(parts[-1])
        if n >= sharded.BATCH_WORDS:
            yield from made()
            parts, sizes, n = [], [], 0
    if n:
        yield from made()


def windows(sents: DataFrame, buckets: int, *sides: int) -> DataFrame:
    return sents.select("tokens").mapInArrow(partial(_emit, buckets, sides), _ROW).repartitionById(buckets, F.col("part"))


# -- shards -------------------------------------------------------------------------------------


class Shard:
    """Windows of a shard, ascending and added up, by side: a, b, c (numbers of ``words``; none: the number after the last) and cnt."""

    def __init__(self, it: Iterator[pa.RecordBatch], *only: int) -> None:
        """``only``: the sides that are read; none: all."""
        rows = [row for batch in it for row in zip(*(batch.column(i).to_pylist() for i in range(1, 8))) if not only or row[0] in only]
        names = []
        for row in rows:
            size = K.unpack_ints(row[6]).astype(np.int64)
            off = np.append(0, np.cumsum(size)).astype(np.int32)
            names.append(pa.StringArray.from_buffers(len(size), pa.py_buffer(off.tobytes()), pa.py_buffer(row[5])))
        coded = pa.chunked_array(names or [pa.array([], pa.string())]).dictionary_encode()
        self.words = coded.chunk(0).dictionary if names else pa.array([], pa.string())
        self.none = len(self.words)
        got: dict[int, list] = {FORWARD: [], BACKWARD: []}
        for row, chunk in zip(rows, coded.chunks):
            number = np.append(chunk.indices.to_numpy(zero_copy_only=False), self.none).astype(np.int32)
            a, b, c = np.cumsum(K.unpack_ints(row[1]).astype(np.int64)), K.unpack_small(row[2]), K.unpack_small(row[3])
            got[row[0]].append((number[a], number[b], number[c], K.unpack_ints(row[4]).astype(np.int64)))
        del rows
        self.sides = {side: self._added(cells) for side, cells in got.items() if cells}

    def _added(self, cells: list[tuple]) -> tuple[np.ndarray, ...]:
        a, b, c, cnt = (np.concatenate([x[i] for x in cells]) for i in range(4))
        cells.clear()
        order, first = _ordered(a, b, c, self.none)
        cnt = np.add.reduceat(cnt[order], first)
        return *(x[order[first]] for x in (a, b, c)), cnt

    def bigrams(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, b and cnt of the bigrams, and the bigram that each window is of (their number: of none)."""
        a, b, c, cnt = self.sides[side]
        first = _first(a, b)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
        total = np.add.reduceat(cnt, first)
        real = b[first] < self.none
        number = np.where(real, np.cumsum(real) - 1, int(real.sum()))[of]
        return a[first][real], b[first][real], total[real], number


def _kinds(of: np.ndarray, cnt: np.ndarray, size: int) -> np.ndarray:
    """Sum of counts, and how many are 1, 2 and more, by what they are of."""
    count = lambda some: np.bincount(of[some], minlength=size)
    return np.stack([np.bincount(of, cnt, size).astype(np.int64), count(cnt == 1), count(cnt == 2), count(cnt > 2)])


def _joined(words: pa.Array, *numbers: np.ndarray) -> pa.Array:
    cells = [words.take(pa.array(x)) for x in numbers]
    return cells[0] if len(cells) == 1 else pc.binary_join_element_wise(*cells, " ")


def _batches(names: list[str], n: int, make) -> Iterator[pa.RecordBatch]:
    """``make`` gives a slice's columns; those of numbers may be scalars."""
    for at in range(0, n, _OUT_ROWS):
        part = slice(at, min(n, at + _OUT_ROWS))
        made = make(part)
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.broadcast_to(x, part.stop - part.start)) for x in made], names)


def _of_bigrams(side: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ngram and the four statistics of bigrams that a word follows or precedes."""
    shard = Shard(it)
    if side not in shard.sides:
        return
    a, b, _, of = shard.bigrams(side)
    on = shard.sides[side][2] < shard.none
    kinds = _kinds(of[on], shard.sides[side][3][on], len(a))
    some = np.flatnonzero(kinds[0])
    a, b, kinds = a[some], b[some], kinds[:, some]
    yield from _batches(["ngram", *"0123"], len(a), lambda p: [_joined(shard.words, a[p], b[p]), *kinds[:, p]])


def _counted(least: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, ngram and cnt of bi- and trigrams that occur ``least`` times."""
    shard = Shard(it)
    if not shard.sides:
        return
    a, b, cnt, _ = shard.bigrams(FORWARD)
    some = np.flatnonzero(cnt >= least)
    a, b, cnt = a[some], b[some], cnt[some]
    yield from _batches(["n", "ngram", "cnt"], len(a), lambda p: [np.int32(2), _joined(shard.words, a[p], b[p]), cnt[p]])
    x, y, z, times = shard.sides[FORWARD]
    some = np.flatnonzero((z < shard.none) & (times >= least))
    yield from _batches(["n", "ngram", "cnt"], len(some), lambda p: [np.int32(3), _joined(shard.words, *(v[some[p]] for v in (x, y, z))), times[some[p]]])


_INDEX = ["n", "ngram", "word", "history", "lower", "cnt", *STATS]


def _indexed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an index, of bi- and trigrams."""
    shard = Shard(it)
    if FORWARD not in shard.sides:
        return
    w = shard.words
    a, b, cnt, of = shard.bigrams(FORWARD)
    x, y, z, times = shard.sides[FORWARD]
    on = np.flatnonzero(z < shard.none)
    follow = _kinds(of[on], times[on], len(a))
    if len(a):  # else there are no backward windows either
        back = shard.sides[BACKWARD]
        some = back[2] < shard.none
        precede = _kinds(shard.bigrams(BACKWARD)[3][some], back[3][some], len(a))  # the bigrams are the same, in the same order
        yield from _batches(_INDEX, len(a), lambda p: [np.int32(2), _joined(w, a[p], b[p]), _joined(w, b[p]), _joined(w, a[p]), _joined(w, b[p]), cnt[p], *follow[:, p], *precede[:, p], *[np.int64(0)] * 4])
    yield from _batches(_INDEX, len(on), lambda p: (lambda q: [np.int32(3), _joined(w, x[q], y[q], z[q]), _joined(w, z[q]), _joined(w, x[q], y[q]), _joined(w, y[q], z[q]), times[q], *[np.int64(0)] * 12])(on[p]))


def _of_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a shard adds to its words' counts and statistics."""
    shard = Shard(it)
    for side in shard.sides:
        a, b, cnt, _ = shard.bigrams(side)
        x, y, z, times = shard.sides[side]
        size = shard.none
        parts = [np.zeros((1, size), np.int64), _kinds(a, cnt, size), _kinds(b, cnt, size), np.zeros((4, size), np.int64)]
        on = z < size
        parts[3] = _kinds(y[on], times[on], size)
        if side == FORWARD:
            parts[0] = np.bincount(x, times, size).astype(np.int64)[None]
        made = np.concatenate(parts)
        some = np.flatnonzero(made.any(0))
        yield from _batches(["ngram", "cnt", *STATS], len(some), lambda p: [_joined(shard.words, some[p]), *made[:, some[p]]])
        return  # both sides have the same bigrams and trigrams


def _words(sent: DataFrame) -> DataFrame:
    every = ["cnt", *STATS]
    rows = sent.mapInArrow(_of_words, "ngram string, " + ", ".join(f"{c} long" for c in every))
    return rows.groupBy("ngram").agg(*[F.sum(c).alias(c) for c in every])


def _of_histories(asked: Broadcast, most: Broadcast, discount: float, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """history, word, c3, h3, nf3: the words after bigrams that are asked for, how often each comes, all come, and how many there are.

    ``most``: for each of these the most that the lower order gives to a word after it; words that can't be the best with it are left out.
    """
    shard = Shard(it, FORWARD)
    if not shard.sides:
        return
    h = sharded.hashes(shard.words)
    a, b, cnt, of = shard.bigrams(FORWARD)
    _, _, z, times = shard.sides[FORWARD]
    number = asked.value.numbers(sharded.longer(h[a], h[b]))
    on = np.flatnonzero(np.append(number > 0, False)[of] & (z < shard.none))
    of, z, times = of[on], z[on], times[on]
    many, best = np.bincount(of, minlength=len(a)), np.zeros(len(a), np.int64)
    np.maximum.at(best, of, times)
    on = np.flatnonzero(times + (1 + 1e-9) * discount * many[of] * most.value[number[of] - 1] >= best[of])
    yield from _batches(["history", "word", "c3", "h3", "nf3"], len(on), lambda p: (lambda q: [_joined(shard.words, a[of[q]], b[of[q]]), _joined(shard.words, z[q]), times[q], cnt[of[q]], many[of[q]]])(on[p]))


def _of_lasts(asked: Broadcast, known: Broadcast, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """last, word, np2: the words after words that are asked for, and how many distinct ones come before the two.

    Which one the recursive model's lower order makes the best depends on np1 too, the distinct words before each. ``known`` has that of frequent words, and the most
    that others have, so words that can't be the best of the shard are left out.
    """
    shard = Shard(it, BACKWARD)
    if not shard.sides:
        return
    nf, frequent, np1, rest, b2, u, d = known.value
    h = sharded.hashes(shard.words)
    number = asked.value.numbers(h)
    at = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
    found = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
    p1 = lambda n: np.maximum(n - d, 0) / b2 + d / b2 / (u + 1)
    high, low = (p1(np.where(found, np1[at] if len(np1) else 0, x)) for x in (rest, 0))
    a, b, _, of = shard.bigrams(BACKWARD)
    before = np.bincount(of[shard.sides[BACKWARD][2] < shard.none], minlength=len(a))
    on = np.flatnonzero((number > 0)[a])
    a, b, before = a[on], b[on], before[on]
    own, weight = np.maximum(before - d, 0), d * nf[number[a] - 1]
    best = np.zeros(shard.none)
    np.maximum.at(best, a, own + weight * low[b])
    on = np.flatnonzero(own + weight * high[b] >= best[a] * (1 - 1e-9))
    yield from _batches(["last", "word", "np2"], len(on), lambda p: (lambda q: [_joined(shard.words, a[q]), _joined(shard.words, b[q]), before[q]])(on[p]))


def _of_pairs(asked: Broadcast, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """last, word, np2 of bigrams that are asked for."""
    shard = Shard(it, BACKWARD)
    if not shard.sides:
        return
    h = sharded.hashes(shard.words)
    a, b, _, of = shard.bigrams(BACKWARD)
    before = np.bincount(of[shard.sides[BACKWARD][2] < shard.none], minlength=len(a))
    on = np.flatnonzero(asked.value.numbers(sharded.longer(h[a], h[b])) > 0)
    yield from _batches(["last", "word", "np2"], len(on), lambda p: (lambda q: [_joined(shard.words, a[q]), _joined(shard.words, b[q]), before[q]])(on[p]))


class Continuations:
    """What predictions read of windows. What is asked for is text to be predicted, so its hashes are broadcast."""

    def __init__(self, sents: DataFrame, buckets: int) -> None:
        self.sent = executed(windows(sents, buckets, FORWARD, BACKWARD))
        self.context = sents.sparkSession.sparkContext

    def _asked(self, ngrams: DataFrame, *values: str) -> tuple[Broadcast, list[np.ndarray]]:
        """Hashes of ``ngrams``, and the values of each in their order."""
        keyed = sharded.keyed(ngrams)
        found = (keyed.join(ngrams, "ngram") if values else keyed).select("h", *values).toArrow()
        h = found["h"].to_numpy().view(U)
        first = np.unique(h, return_index=True)[1]
        return self.context.broadcast(sharded.Asked(h)), [found[v].to_numpy()[first] for v in values]

    def words(self) -> DataFrame:
        """ngram, np1, nf2, nfp2 of all words: distinct words before, after, and pairs around."""
        total = lambda p, c: sum((F.col(x) for x in KINDS[p][2:]), F.col(KINDS[p][1])).alias(c)
        return _words(self.sent).select("ngram", total("np", "np1"), total("nf", "nf2"), total("nfp", "nfp2"))

    def after_words(self, lasts: DataFrame, words: DataFrame, b2: float, u: float, discount: float) -> DataFrame:
        """``lasts``: ngram, each once, with nf2. See ``_of_lasts``."""
        asked, (nf,) = self._asked(lasts, "nf2")
        top = words.orderBy(F.desc("np1")).limit(FREQUENT_WORDS).select("ngram", "np1").toArrow().combine_chunks()
        h, np1 = (sharded.hashes(top["ngram"].combine_chunks()), top["np1"].to_numpy()) if top.num_rows else (np.zeros(0, U), np.zeros(0, np.int64))
        order = np.argsort(h)
        rest = int(np1.min()) if len(np1) == FREQUENT_WORDS else 0
        known = self.context.broadcast((nf.astype(np.float64), h[order], np1[order], rest, b2, u, discount))
        return self.sent.mapInArrow(partial(_of_lasts, asked, known), "last string, word string, np2 long")

    def after_bigrams(self, histories: DataFrame, discount: float) -> DataFrame:
        """``histories``: ngram, each once, with most. See ``_of_histories``."""
        asked, (most,) = self._asked(histories, "most")
        return self.sent.mapInArrow(partial(_of_histories, asked, self.context.broadcast(most), discount), "history string, word string, c3 long, h3 long, nf3 long")

    def bigrams(self, ngrams: DataFrame) -> DataFrame:
        return self.sent.mapInArrow(partial(_of_pairs, self._asked(ngrams)[0]), "last string, word string, np2 long")


def _neighbours(sents: DataFrame, buckets: int, side: int, prefix: str) -> DataFrame:
    sent, names = windows(sents, buckets, side), KINDS[prefix]
    of_words = _words(sent).select("ngram", *names).where(f"{names[0]} > 0")
    return sent.mapInArrow(partial(_of_bigrams, side), "ngram string, " + ", ".join(f"{c} long" for c in names)).unionByName(of_words)


def followers(sents: DataFrame, buckets: int) -> DataFrame:
    """As ``counting.followers`` of the counted n-grams of the orders 1 to 3."""
    return _neighbours(sents, buckets, FORWARD, "nf")


def preceders(sents: DataFrame, buckets: int) -> DataFrame:
    return _neighbours(sents, buckets, BACKWARD, "np")


def surrounders(sents: DataFrame, buckets: int) -> DataFrame:
    return _words(windows(sents, buckets, FORWARD)).select("ngram", *KINDS["nfp"]).where("nfp_s > 0")


def counts(sents: DataFrame, buckets: int, least: int = 1) -> DataFrame:
    """As ``counting.counts`` of the orders 1 to 3."""
    sent = windows(sents, buckets, FORWARD)
    of_words = _words(sent).select(F.lit(1).alias("n"), "ngram", "cnt").where(F.col("cnt") >= least)
    return sent.mapInArrow(partial(_counted, least), "n int, ngram string, cnt long").unionByName(of_words)


def index(sents: DataFrame, buckets: int) -> DataFrame:
    """As ``counting.index`` of the counted n-grams of the orders 1 to 3."""
    sent = windows(sents, buckets, FORWARD, BACKWARD)
    rows = sent.mapInArrow(_indexed, "n int, ngram string, word string, history string, lower string, cnt long, " + ", ".join(f"{c} long" for c in STATS))
    return rows.unionByName(_words(sent).select(F.lit(1).alias("n"), "ngram", F.col("ngram").alias("word"), F.lit("").alias("history"), F.lit("").alias("lower"), "cnt", *STATS))
