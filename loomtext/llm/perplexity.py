"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted text is every document whose label says quality 1; four in five, by hash, train the model and
the fifth is held out. Tokens are words (case counts) and runs of other visible characters, each known by 48 bits of its
hash; a text begins after a start and closes with an end. The vocabulary is open: a word that training hasn't is
one of as many unseen words as training has words that follow one word only.

    p(v|u) = (c(uv) - D(c)) / c(u) + gamma(u) * q(v)
    q(v)   = (n(v) - E(n)) / N,   q(unseen) = delta / n1;   gamma(unseen) = 1
    n(v): distinct tokens before v, n1: tokens with one such, N: distinct bigrams, delta: what E takes off in all

With three discounts each, from counts of counts. A document's log probability is the sum, over its tokens, of
log gamma + log q, and, over its bigrams that training has, of log(1 + seen / (gamma q)). So scoring is one lookup of keys,
tokens and bigrams alike, in a table of values, and everything about it is sharded:

- bigram counts go, summed over a batch, to shards by the bigram's hash;
- each of these sends its tokens' partial sums to shards by the token's hash, which return the whole sums, so a frequent
  token costs one entry a shard;
- bigram shards turn sums into values;
- scoring tasks send each shard its keys with the documents they are in, and shards
  answer with one number a document and batch.

What makes up ``FREQUENT`` of training or more, which at most 1 / ``FREQUENT`` tokens and as many bigrams can, is broadcast with its values
(12 bytes each), and isn't sent; equal texts of a batch are scored once. Nothing that grows with the corpus is broadcast or comes to the driver.
Larger tables are scored in ``_ROUNDS``, by the text's hash, each of which writes its results and has its shuffle files deleted before the next one begins, so
that no more than one round's keys are on disk. Text is read once a round and shuffled only where trusted ids are too many to broadcast. Keys have 20 bits more than training has tokens, so a key that training hasn't is taken for one
that it has about once in a million lookups, at any size.

A document stays if its perplexity, over its tokens and the end, is at most the ``QUANTILE`` of held-out trusted documents of its
language; a language with fewer than ``LEAST_HELD_OUT`` of them has no threshold, and its documents stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm import frames, spans
from loomtext.llm import kernels as K
from loomtext.session import cut, freeing, read, release

U = np.uint64
QUANTILE, LEAST_HELD_OUT, HOLD_OUT_ONE_IN = 0.99, 30, 5
START, END = U(1), U(2)
FREQUENT = 5e-7
_BATCH_TOKENS, _SCORE_TOKENS, _SHARD_CHARS, _SPARE_BITS = 3_000_000, 6_000_000, 1 << 24, 20
_WORTH_FREEING = 1 << 27  # bytes of text from which on it is worth seconds to have shuffle files freed
_ROUNDS = 2  # in which such tables are scored
_ROOM = 18  # bits that the number of a text in a batch takes
_ROW = "part int, uid long, kind int, a binary, b binary, c binary"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["part", "uid", "kind", "a", "b", "c"]
COUNTS, STATS, LEVELS, TOKENS, VALUES, OFTEN, REQUEST, BATCH, ANSWER = range(9)
SUMS = 16  # kinds from here on are sums, in uid


def _row(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _zip(*parts: bytes, level: int = 3) -> bytes:
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(bytes([len(parts)]) + head + b"".join(parts))


def _unzip(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = np.frombuffer(raw, "<i8", raw[0], 1)
    end = 1 + 8 * raw[0] + np.cumsum(size)
    return [raw[e - s : e] for s, e in zip(size, end)]


def _sums(values: list[int]) -> pa.RecordBatch:
    return _row([(0, int(v), SUMS + k, None, None, None) for k, v in enumerate(values)])


# -- tokens -------------------------------------------------------------------------------------


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of every token's hash in order, and where each text's tokens begin."""
    words, marks = K.Words(texts, K.cased_values()), K.Words(texts, K.visible_values())
    order = np.argsort(np.concatenate([words.start, marks.start]), kind="stable")
    return np.concatenate([words.hash, ~marks.hash])[order] >> U(16), words.off + marks.off


def bigrams(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, u, v) of every bigram, the start and the end included; a text without tokens has none."""
    some = np.flatnonzero(np.diff(off))
    size = np.diff(off)[some]
    doc = np.repeat(some, size + 1)
    last = np.cumsum(size + 1) - 1
    v = np.empty(len(doc), U)
    inner = np.ones(len(doc), bool)
    inner[last] = False
    v[inner], v[last] = h, END
    u = np.empty(len(doc), U)
    u[1:] = v[:-1]
    u[last - size] = START
    return doc, u, v


def token_key(w: np.ndarray) -> np.ndarray:
    return K.mix(w ^ U(0x5851F42D4C957F2D))


def bigram_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(u + U(0x14057B7EF767814F)) + v * U(0x9E3779B97F4A7C15))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in columns])]))


# -- training -----------------------------------------------------------------------------------


def _pack_counts(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams, ascending, with counts: their tokens once, and two numbers of tokens a bigram."""
    w, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    first = _runs(u)
    return _zip(K.pack_sorted(w), K.pack_ints(np.diff(at[: len(u)][first], prepend=0)), K.pack_ints(np.diff(np.append(first, len(u)))), K.pack_small(at[len(u) :]), K.pack_ints(n))


def _unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, steps, runs, v, n = _unzip(blob)
    w = K.unpack_sorted(w)
    u = w[np.cumsum(K.unpack_ints(steps).astype(np.int64))]
    return np.repeat(u, K.unpack_ints(runs).astype(np.int64)), w[K.unpack_small(v)], K.unpack_ints(n).astype(np.int64)


def _by_bucket(w: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards of ascending tokens, and which of the tokens each has, in order."""
    bucket = K.bucket_of(token_key(w), buckets)
    order = np.argsort(bucket, kind="stable")
    at = K.split_at(bucket[order], buckets)
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), order[at[b] : at[b + 1]]


def _add_counts(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((v, u))
    u, v, n = u[order], v[order], n[order]
    first = _runs(u, v)
    return u[first], v[first], np.add.reduceat(n, first) if len(first) else n


def _bigram_counts(buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's bigram counts, for each shard."""
    us, vs, size = [], [], 0

    def flush() -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        us.clear(), vs.clear()
        u, v, n = _add_counts(u, v, np.ones(len(u), np.int64))
        bucket = K.bucket_of(bigram_key(u, v), buckets)
        order = np.argsort(bucket, kind="stable")
        u, v, n = u[order], v[order], n[order]
        at = K.split_at(bucket[order], buckets)
        return _row([(b, 0, COUNTS, _pack_counts(*(x[at[b] : at[b + 1]] for x in (u, v, n))), None, None) for b in np.flatnonzero(np.diff(at))])

    for _, texts in spans.slices(it):
        _, u, v = bigrams(*tokens(texts))
        us.append(u)
        vs.append(v)
        size += len(u)
        if size >= _BATCH_TOKENS:
            yield flush()
            size = 0
    if size:
        yield flush()


def _shard(buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's bigram counts; what they add to its tokens' statistics, for the tokens' shards; and counts of counts."""
    part, got = None, []
    for batch in it:
        if batch.num_rows:
            part = batch.column(0)[0].as_py()
            got += [_unpack_counts(x) for x in batch.column(3).to_pylist()]
    if part is None:
        return
    u, v, n = _add_counts(*(np.concatenate(x) for x in zip(*got)))
    yield _row([(part, 0, COUNTS, _pack_counts(u, v, n), None, None)])
    yield _sums([*((n == k).sum() for k in (1, 2, 3, 4)), len(n), n.sum()])
    w, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    by_u, by_v = at[: len(u)], at[len(u) :]
    add = lambda of, weights=None: np.bincount(of, weights, len(w)).astype(np.int64)
    stats = [add(by_u, n), add(by_u[n == 1]), add(by_u[n == 2]), add(by_u[n > 2]), add(by_v)]
    for b, own in _by_bucket(w, buckets):
        yield _row([(b, part, STATS, _zip(K.pack_sorted(w[own]), *(K.pack_ints(x[own]) for x in stats)), None, None)])


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A token shard's tokens with their five statistics; of these, what each bigram shard needs, in the order it asked; and sums. Counts pass."""
    part, asked, stats = None, [], []
    for batch in it:
        kind = batch.column(2).to_numpy()
        if (kind != STATS).any():
            yield batch.filter(pa.array(kind != STATS))
        for i in np.flatnonzero(kind == STATS):
            part = batch.column(0)[i].as_py()
            w, *more = _unzip(batch.column(3)[i].as_py())
            asked.append((batch.column(1)[i].as_py(), K.unpack_sorted(w)))
            stats.append(np.stack([K.unpack_ints(x).astype(np.int64) for x in more]))
    if part is None:
        return
    every = np.concatenate([w for _, w in asked])
    order = np.argsort(every, kind="stable")
    first = _runs(every[order])
    w, total = every[order][first], np.add.reduceat(np.concatenate(stats, 1)[:, order], first, axis=1)
    before = total[4]
    yield _sums([0] * 6 + [*((before == k).sum() for k in (1, 2, 3, 4)), (before > 2).sum()])
    yield _row([(part, 0, TOKENS, _zip(K.pack_sorted(w), *(K.pack_ints(x) for x in total)), None, None)])
    for shard, tokens_of in asked:
        at = np.searchsorted(w, tokens_of)
        yield _row([(shard, part, LEVELS, _zip(*(K.pack_ints(x[at]) for x in total[1:])), None, None)])


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more; one half each where there are too few counts to estimate them."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.01), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


class Constants:
    """The few numbers that a model has besides its tables."""

    def __init__(self, sums: list[int]) -> None:
        """``sums``: how many bigrams occur once to four times, how many there are, and occur; how many tokens follow one to four distinct ones, and over two."""
        bigram, token = sums[:6], sums[6:]
        self.top, self.low = discounts(*bigram[:4]), discounts(*token[:4])
        self.distinct = max(1, bigram[4])
        off = self.low[1] * token[0] + self.low[2] * token[1] + self.low[3] * token[4]
        self.unseen = off / self.distinct / max(1, token[0]) if off else 1.0
        self.bits = max(32, min(64, _SPARE_BITS + int(bigram[5]).bit_length()))
        self.often = FREQUENT * bigram[5]

    def short(self, key: np.ndarray) -> np.ndarray:
        return key >> U(64 - self.bits)

    def mass(self, once: np.ndarray, twice: np.ndarray, more: np.ndarray) -> np.ndarray:
        """c(u) gamma(u)."""
        return np.maximum(self.top[1] * once + self.top[2] * twice + self.top[3] * more, 1e-12)

    def q(self, before: np.ndarray) -> np.ndarray:
        return np.maximum(np.where(before > 0, (before - self.low[np.minimum(before, 3)]) / self.distinct, self.unseen), 1e-300)


def _values(k: Constants, buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short keys of a shard's bigrams and tokens, ascending, and their values; and those of frequent ones once more."""
    part, counts, levels, blobs = None, None, {}, []
    for batch in it:
        for part, uid, kind, blob in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if kind == COUNTS:
                counts = _unpack_counts(blob)
            elif kind == LEVELS:
                levels[uid] = blob
            else:
                blobs.append(blob)
    if part is None:
        return
    keys, values, often = [np.zeros(0, U)], [np.zeros(0)], [np.zeros(0, bool)]
    if counts:
        u, v, n = counts
        w = np.unique(np.concatenate([u, v]))
        whole = np.zeros((4, len(w)), np.int64)
        for b, own in _by_bucket(w, buckets):
            whole[:, own] = np.stack([K.unpack_ints(x).astype(np.int64) for x in _unzip(levels[b])])
        mass, q = k.mass(*whole[:3]), k.q(whole[3])
        keys.append(bigram_key(u, v))
        values.append(np.log1p((n - k.top[np.minimum(n, 3)]) / np.maximum(mass[np.searchsorted(w, u)] * q[np.searchsorted(w, v)], 1e-300)))
        often.append(n >= k.often)
    for blob in blobs:
        w, *stats = _unzip(blob)
        total, once, twice, more, before = (K.unpack_ints(x).astype(np.int64) for x in stats)
        keys.append(token_key(K.unpack_sorted(w)))
        values.append(np.log(k.q(before) / k.unseen) + np.where(total > 0, np.log(k.mass(once, twice, more) / np.maximum(total, 1)), 0.0))
        often.append(total >= k.often)
    key, value, often = np.concatenate(keys), np.concatenate(values).astype("<f4"), np.concatenate(often)
    order = np.argsort(key)
    key, value, often = k.short(key[order]), value[order], often[order]
    yield _row([(part, 0, VALUES, _zip(K.pack_sorted(key), value.tobytes()), None, None)])
    yield _row([(part, 0, OFTEN, _zip(K.pack_sorted(key[often]), value[often].tobytes()), None, None)])


def _unpack_values(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unzip(x) for x in blobs]
    key = np.concatenate([np.zeros(0, U), *(K.unpack_sorted(x) for x, _ in parts)])
    value = np.concatenate([np.zeros(0), *(np.frombuffer(x, "<f4") for _, x in parts)])
    order = np.argsort(key, kind="stable")
    return key[order], value[order]


# -- scoring ------------------------------------------------------------------------------------


def _starts(k: Constants, buckets: int) -> list[int]:
    """The least short key of each shard but the first."""
    return [-(-(b << 32) // buckets) << (k.bits - 32) for b in range(1, buckets)]


def _distinct(texts: list[str], seen: dict[int, int], count: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts that the batch hasn't yet, their numbers in the batch, and for every text the number of the first one like it."""
    cps, base = K.codepoints(texts)
    prints = K.cumulative_hash(cps, base).tolist()
    first = np.array([seen.setdefault(x, count + i) for i, x in enumerate(prints)], np.int64)
    own = np.flatnonzero(first == count + np.arange(len(texts)))
    return [texts[i] for i in own], own + count, first


def _requests(k: Constants, frequent: Broadcast, buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``it``: doc_id, text, lang, sample. A batch's keys for each shard, and a record of the batch."""
    metas: list[pa.RecordBatch] = []
    keys: list = []
    sizes: list[np.ndarray] = []
    firsts: list[np.ndarray] = []
    seen: dict[int, int] = {}
    packed = k.bits + _ROOM <= 64  # a key and a text fit one number
    starts = _starts(k, buckets)
    often, value = frequent.value

    def flush() -> pa.RecordBatch:
        n, same = np.concatenate(sizes), np.concatenate(firsts)
        meta = pa.Table.from_batches(metas).combine_chunks()
        if packed:
            both = np.concatenate(keys)
            keys.clear()
            both.sort()
            part = lambda a, b: (both[a:b] >> U(_ROOM), (both[a:b] & U((1 << _ROOM) - 1)).astype(np.int64))
            at = [0, *np.searchsorted(both, np.array([x << _ROOM for x in starts], U)).tolist(), len(both)]
            whole = [both]
        else:
            g, d = (np.concatenate(x) for x in zip(*keys))
            keys.clear()
            order = np.lexsort((d, g))
            g, d = g[order], d[order].astype(np.int64)
            part = lambda a, b: (g[a:b], d[a:b])
            at = [0, *np.searchsorted(g, np.array(starts, U)).tolist(), len(g)]
            whole = [g, d.view(U)]
        mark = sum(int(K.mix(x[i : i + (1 << 20)] + U(j)).sum(dtype=U)) for j, x in enumerate(whole) for i in range(0, len(x), 1 << 20))
        ids = meta["doc_id"].fill_null(0).to_numpy().view(U)
        ids = K.mix(K.mix(ids) ^ K.mix(np.arange(1, len(ids) + 1, dtype=U) << U(32)) ^ same.view(U))
        uid = int(K.mix(np.array([int(ids.sum(dtype=U)) ^ mark & (1 << 64) - 1], U)).view(np.int64)[0])
        base, rows = np.zeros(len(n)), []
        for b in range(buckets):
            own, of = part(at[b], at[b + 1])
            if not len(own):
                continue
            first = _runs(own)
            size = np.diff(np.append(first, len(own)))
            # what the task knows itself needn't be asked
            low, high = np.searchsorted(often, own[[0, -1]], "left")
            mine = often[low : high + 1]
            place = np.searchsorted(own[first], mine)
            place[place == len(first)] = 0
            hit = own[first][place] == mine
            if hit.any():
                known, worth = np.zeros(len(first), bool), np.zeros(len(first))
                known[place[hit]], worth[place[hit]] = True, value[low : high + 1][hit]
                worth, gone = np.repeat(worth, size), np.repeat(known, size)
                base += np.bincount(of[gone], worth[gone], len(n))
                own, of = own[~gone], of[~gone]
                if not len(own):
                    continue
                first = _runs(own)
                size = np.diff(np.append(first, len(own)))
            later = np.ones(len(of), bool)
            later[first] = False
            step = np.diff(of, prepend=of[:1])[later]
            rows.append((b, uid, REQUEST, _zip(K.pack_sorted(own[first]), K.pack_ints(size), K.pack_small(of[first]), K.pack_ints(step), level=9), None, None))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, meta.schema) as out:
            out.write_table(meta)
        rows.append((uid % buckets, uid, BATCH, _zip(sink.getvalue().to_pybytes()), _zip(K.pack_ints(n), K.pack_ints(same)), base.astype("<f4").tobytes()))
        for x in (metas, sizes, firsts, seen):
            x.clear()
        return _row(rows)

    size = count = 0
    pieces = ((whole.slice(at, 1 << 16), all_[at : at + (1 << 16)]) for whole, all_ in spans.slices(it) for at in range(0, len(all_), 1 << 16))
    for part, texts in pieces:
        if count + len(texts) >= 1 << _ROOM:
            yield flush()
            size = count = 0
        new, number, first = _distinct(texts, seen, count)
        h, off = tokens(new)
        doc, u, v = bigrams(h, off)
        some = np.flatnonzero(np.diff(off))
        # every token once, and the start and the end of each text that has any
        own = number[np.concatenate([np.repeat(np.arange(len(new)), np.diff(off)), some, some, doc])]
        key = k.short(np.concatenate([token_key(h), np.repeat(token_key(np.array([START, END])), len(some)), bigram_key(u, v)]))
        keys.append(key << U(_ROOM) | own.astype(U) if packed else (key, own.astype(np.int32)))
        metas.append(part.select(["doc_id", "lang", "sample"]))
        n = np.zeros(len(texts), np.int64)
        n[number - count] = np.diff(off)
        sizes.append(n)
        firsts.append(first)
        size += len(h)
        count += len(texts)
        if size >= (_SCORE_TOKENS if packed else _BATCH_TOKENS):
            yield flush()
            size = count = 0
    if count:
        yield flush()


def _answer(buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables, waiting = [], []
    for batch in it:
        kind = batch.column(2).to_numpy()
        if (kind == BATCH).any():
            yield batch.filter(pa.array(kind == BATCH))
        tables += [batch.column(3)[i].as_py() for i in np.flatnonzero(kind == VALUES)]
        waiting += [tuple(batch.column(c)[i].as_py() for c in (0, 1, 3)) for i in np.flatnonzero(kind == REQUEST)]
    key, value = _unpack_values(tables)
    if not len(key):
        return
    for part, uid, blob in waiting:
        asked, runs, firsts, later = _unzip(blob)
        g, runs = K.unpack_sorted(asked), K.unpack_ints(runs).astype(np.int64)
        first = np.cumsum(runs) - runs
        steps, inner = np.empty(int(runs.sum()), np.int64), np.ones(int(runs.sum()), bool)
        inner[first] = False
        steps[first], steps[inner] = K.unpack_small(firsts), K.unpack_ints(later).astype(np.int64)
        at = np.searchsorted(key, g)
        at[at == len(key)] = 0
        score = np.where(key[at] == g, value[at], 0.0)
        total = np.cumsum(steps)
        doc = total - np.repeat(total[first] - steps[first], runs)
        yield _row([(uid % buckets, uid, ANSWER, zlib.compress(np.bincount(doc, np.repeat(score, runs)).astype("<f4").tobytes(), 1), None, int(part).to_bytes(4, "big"))])


def _combine(k: Constants, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches: list[tuple] = []
    answers: dict[int, dict[bytes, bytes]] = {}  # batches of equal documents in equal order share their answers
    for batch in it:
        _, uid, kind, a, b, c = (batch.column(i).to_pylist() for i in range(6))
        for i in range(batch.num_rows):
            if kind[i] == BATCH:
                batches.append((uid[i], a[i], b[i], c[i]))
            else:
                answers.setdefault(uid[i], {})[c[i]] = a[i]
    for uid, meta, n, base in batches:
        n, same = (K.unpack_ints(x).astype(np.int64) for x in _unzip(n))
        total = np.where(n > 0, (n + 1) * np.log(k.unseen), 0.0) + np.frombuffer(base, "<f4")
        for _, blob in sorted(answers.get(uid, {}).items()):
            got = np.frombuffer(zlib.decompress(blob), "<f4")
            total[: len(got)] += got
        n, total = n[same], total[same]
        table = pa.ipc.open_stream(_unzip(meta)[0]).read_all().combine_chunks()
        for part in table.to_batches():
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), pa.array(total)], ["doc_id", "lang", "sample", "n_tokens", "log_prob"])


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang and sample: 1 for training, 2 held out, 0 for the rest."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1").select("__id")
    good = cut(good)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    joined = rows.join(frames.sized(good, good.count(), 8), F.col("doc_id") == F.col("__id"), "left")
    held = F.when(F.expr(f"pmod(xxhash64(__id, 'held out'), {HOLD_OUT_ONE_IN}) = 0"), 2).otherwise(1)
    return joined.select("doc_id", "text", "lang", F.when(F.col("__id").isNull(), 0).otherwise(held).alias("sample"))


def _added(rows: DataFrame, size: int) -> list[int]:
    """The sums of ``rows``, whatever else is in them."""
    found = {r.kind - SUMS: r.n for r in rows.where(f"kind >= {SUMS}").groupBy("kind").agg(F.sum("uid").alias("n")).collect()}
    return [found.get(k, 0) for k in range(size)]


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, sample, n_tokens and log_prob (natural) of every row of ``docs``."""
    rows = _sampled(docs, labels)
    size = frames.text_bytes(docs)
    buckets = frames.shards(docs, _SHARD_CHARS, size)

    def exchange(df: DataFrame, f) -> DataFrame:
        return df.repartitionById(buckets, F.col("part")).mapInArrow(f, _ROW)

    train = rows.where("sample = 1 and text is not null").select("doc_id", "text")
    with freeing(docs.sparkSession):
        sums = cut(exchange(exchange(train.mapInArrow(partial(_bigram_counts, buckets), _ROW), partial(_shard, buckets)), _merge))
        k = Constants(_added(sums, 11))
        model = cut(exchange(sums.where(f"kind < {SUMS}"), partial(_values, k, buckets)))
    del sums
    if size >= _WORTH_FREEING:
        release(docs.sparkSession)
    often = model.where(f"kind = {OFTEN}").select("a").toArrow()["a"].to_pylist()
    frequent = docs.sparkSession.sparkContext.broadcast(_unpack_values(often))

    def scored(rows: DataFrame) -> DataFrame:
        asked = rows.mapInArrow(partial(_requests, k, frequent, buckets), _ROW).unionByName(model.where(f"kind = {VALUES}"))
        answers = exchange(asked, partial(_answer, buckets))
        return answers.repartitionById(buckets, F.col("part")).mapInArrow(partial(_combine, k), "doc_id long, lang string, sample int, n_tokens long, log_prob double")

    if size < _WORTH_FREEING:
        return scored(rows)
    with freeing(docs.sparkSession):
        return reduce(DataFrame.unionByName, [cut(scored(rows.where(F.expr(f"pmod(xxhash64(text), {_ROUNDS}) = {i}")))) for i in range(_ROUNDS)])


def _quantiles(rows: DataFrame, group: str, quantile: float, least: int) -> DataFrame:
    """The ``quantile`` of ``value`` of each ``group`` with ``least`` rows or more, as threshold: the value at rank ceil(quantile * rows), in any order of the rows.

    Approximate quantiles are within 1e-4 of the rows of the exact ones, so a range that is wider is narrowed down by counting.
    """
    around = [max(0.0, quantile - 5e-4), min(1.0, quantile + 5e-4)]
    bounds = rows.groupBy(group).agg(F.count("*").alias("n"), F.percentile_approx("value", around, 10_000).alias("at")).where(F.col("n") >= least)
    bounds = bounds.select(F.col(group).alias("of"), F.greatest(F.lit(1), F.ceil(F.lit(quantile) * F.col("n"))).alias("rank"), F.col("at")[0].alias("low"), F.col("at")[1].alias("high"))
    value = F.when(F.col("value") >= F.col("low"), F.col("value"))  # null: below the range
    counts = rows.join(F.broadcast(bounds), F.col(group).eqNullSafe(F.col("of"))).where("value <= high").groupBy(group, "rank", value.alias("value")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(F.col("value").asc_nulls_first()))
    return counts.withColumn("upto", upto).where("upto >= rank and value is not null").groupBy(group).agg(F.min("value").alias("threshold"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST_HELD_OUT) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold and keep, for every row.

    Defined cases: a document without a token (null or empty text) has null perplexity and stays;
    a null lang is a language of its own; a language with fewer than ``least`` held-out documents has a null
    threshold, and its documents stay; rows that share a doc_id are scored one by one; a row without
    doc_id is scored, but never trusted; contradicting labels aren't trust; a perplexity equal to the threshold stays; without trusted documents
    all words are alike and everything stays; a text of any length is scored whole; an empty table gives an empty result. Other columns
    are not read.
    """
    scored = cut(perplexities(docs, labels).withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.round(F.exp(-F.col("log_prob") / (F.col("n_tokens") + 1)), 4))))
    held = scored.where("sample = 2 and perplexity is not null").select(F.col("lang").alias("__lang"), F.col("perplexity").alias("value"))
    limits = _quantiles(held, "__lang", quantile, least)
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", keep.alias("keep"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
