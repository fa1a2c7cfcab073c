"""Toxicity from the nearest labelled examples by exact cosine of weighted words, with a block-max inverted index.

The examples are a bounded hash sample of the labelled rows (``EXAMPLES``); they are the model, so
its size doesn't grow with the corpus. Copies of an example with its label (found by a shared minimum
hash of four-word windows, verified by an exact Jaccard index) count once, or the words of a
much-copied document would look telling.
The vocabulary is all words of the examples; a word weighs its inverse document frequency times its
relevance frequency, log2(2 + toxic examples with it / clean ones), for plain TF-IDF finds the topic
rather than the tone. Words that toxic examples hold more often than chance allows (chi-square,
Bonferroni over all words) are listed as evidence, the search doesn't depend on them. A document
without a word of the vocabulary has no neighbour and gets the prior.

Search: examples lie in blocks of ``BLOCK``, ordered so that examples with the same heaviest common word are
neighbours. A query's sums over the short posting lists, of words in less than one of ``COMMON`` examples,
are made in full: they are the first bound. For the long lists the index holds each block's largest weight. A block
is opened only where its best short sum and the long lists' block maxima together reach the k-th best
score found so far (block-max pruning); in open blocks the long lists are added in single precision, and whatever is
within its error of the k-th best is added again in double precision. So the k nearest are
exact, whatever was pruned (ties go to the smaller doc_id). Votes are
weighted with the similarity, a prior vote is added, and the share is calibrated by isotonic
regression on the examples' own leave-one-out shares, which the executors compute.

The corpus is read once to get the examples' word counts, which go to the driver, and once to score;
the model, of bounded size, is broadcast. Text is never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import frames, spans
from loomtext.llm import kernels as K
from loomtext.session import read

U = np.uint64
EXAMPLES, NEIGHBOURS, THRESHOLD = 12_000, 25, 0.6
PRIOR_VOTES, SIGNIFICANCE, EVIDENCE, COPY = 0.5, 0.01, 5, 0.8
BATCH, BLOCK, COMMON, FIRST = 64, 32, 16, 24
_SHINGLE, _MINHASHES, _ROUND, _ERROR = 4, 6, 9, 1e-4
_REPORT = "doc_id long, toxicity double, toxic boolean, n_neighbours int, neighbours array<long>, similarities array<double>, terms array<string>"


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the distinct word hashes, their counts, and the minimum hashes of its windows (none: a short text)."""
    words, n = K.Words(texts), len(texts)
    order = np.lexsort((words.hash, words.doc()))
    doc, h = words.doc()[order], words.hash[order]
    lead = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(lead, len(h)))
    off = np.searchsorted(doc[lead], np.arange(n + 1))
    w, at = K.windows(words.hash, words.off, _SHINGLE)
    owner = np.searchsorted(words.off, at, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(w) else np.zeros(0, np.int64)
    low = {int(d): [] for d in owner[first]}
    for k in range(_MINHASHES if len(w) else 0):
        for d, x in zip(owner[first], np.minimum.reduceat(K.mix(w ^ U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), first)):
            low[int(d)].append(x)
    return [(h[lead[off[i] : off[i + 1]]], count[off[i] : off[i + 1]], np.array(low.get(i, []), U)) for i in range(n)]


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in spans.slices(it):
        terms, counts, lows = zip(*features(texts))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in terms], pa.binary()), pa.array([x.astype("<i4").tobytes() for x in counts], pa.binary()), pa.array([x.tobytes() for x in lows], pa.binary())], ["doc_id", "toxic", "terms", "counts", "lows"])


def _leaders(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], label: list[int]) -> np.ndarray:
    """Examples that aren't copies of an earlier one, itself such an example, of the same label.

    Examples that share a minimum hash are compared; a copy has a Jaccard index of ``COPY`` at least, over words with their counts.
    """
    size = [int(c.sum()) for _, c, _ in examples]
    lead: list[int] = []
    holds: dict[tuple[int, int, int], list[int]] = {}
    for i, (terms, counts, lows) in enumerate(examples):
        keys = [(label[i], k, int(x)) for k, x in enumerate(lows)]
        near = sorted({j for key in keys for j in holds.get(key, ()) if min(size[i], size[j]) >= COPY * max(size[i], size[j])})
        if near:
            h = np.concatenate([examples[j][0] for j in near])
            n = np.concatenate([examples[j][1] for j in near])
            at = np.searchsorted(terms, h)
            at[at == len(terms)] = 0
            shared = np.bincount(np.repeat(np.arange(len(near)), [len(examples[j][0]) for j in near]), np.where(terms[at] == h, np.minimum(n, counts[at]), 0), len(near))
            if (shared >= COPY * (size[i] + np.array([size[j] for j in near]) - shared)).any():
                continue
        lead.append(i)
        for key in keys:
            holds.setdefault(key, []).append(i)
    return np.array(lead, np.int64)


def _chi_square_limit(tests: int) -> float:
    """The chi-square value of one degree of freedom whose upper tail is SIGNIFICANCE / tests."""
    low, high, p = 0.0, 2000.0, SIGNIFICANCE / max(1, tests)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return high


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending xs and the calibrated value from each on."""
    xs, inverse = np.unique(x, return_inverse=True)
    total, count = np.bincount(inverse, y, len(xs)), np.bincount(inverse, minlength=len(xs)).astype(float)
    at: list[list[float]] = []
    for x0, t, c in zip(xs, total, count):
        at.append([x0, t, c])
        while len(at) > 1 and at[-2][1] * at[-1][2] >= at[-1][1] * at[-2][2]:
            _, t1, c1 = at.pop()
            at[-1][1] += t1
            at[-1][2] += c1
    return np.array([a[0] for a in at]), np.array([a[1] / a[2] for a in at])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges of the given sizes, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


Query = tuple[np.ndarray, np.ndarray]


class Model:
    """Examples and their index. A query is (terms, weights), of unit length, like the examples themselves."""

    def __init__(self, ids: list[int], toxic: list[int], examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], neighbours: int = NEIGHBOURS) -> None:
        lead = _leaders(examples, toxic)
        self.k = neighbours
        self.ids = np.array(ids, np.int64)[lead]
        self.label = np.array(toxic, np.int64)[lead]
        n, bad = len(lead), int(self.label.sum())
        self.prior = (bad + 1) / (n + 2)
        none = np.zeros(0, U)
        self.terms, t = np.unique(np.concatenate([none, *(examples[i][0] for i in lead)]), return_inverse=True)
        t = t.astype(np.int32)
        tf = np.concatenate([none.astype(np.int32), *(examples[i][1].astype(np.int32) for i in lead)])
        d = np.repeat(np.arange(n, dtype=np.int32), [len(examples[i][0]) for i in lead])
        size = len(self.terms)
        df = np.bincount(t, minlength=size).astype(float)
        hit = np.bincount(t, self.label[d] if n else None, size).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = n * (hit * (n - bad - df + hit) - (df - hit) * (bad - hit)) ** 2 / (df * (n - df) * bad * (n - bad))
        self.telling = (hit * n > df * bad) & (chi >= _chi_square_limit(size)) & (df > 1)
        self.idf = np.log(1 + n / df) * np.log2(2 + hit / np.maximum(1, df - hit))
        weight = (1 + np.log(tf)) * self.idf[t]
        weight /= np.sqrt(np.bincount(d, weight**2, n))[d]
        # block order: by the heaviest common word, then by how much common words weigh
        common = df[t] * COMMON >= n
        top, mass = np.full(n, -1), np.bincount(d, np.where(common, weight**2, 0.0), n)
        by = np.flatnonzero(common)[np.argsort(weight[common], kind="stable")]
        top[d[by]] = t[by]  # of an example's words the heaviest is written last
        rank = np.empty(n, np.int64)
        rank[np.lexsort((self.ids, mass, top))] = np.arange(n)
        order = np.argsort(rank[d], kind="stable")
        self.of, self.by = t[order], weight[order].astype(np.float32)
        self.first = np.searchsorted(rank[d][order], np.arange(n + 1))
        place = np.argsort(rank)
        self.ids, self.label = self.ids[place], self.label[place]

    def _invert(self) -> None:
        """Postings of short lists; of long ones the weights as rows of examples, and each block's largest. Made where it is used, not broadcast."""
        n, size = len(self.ids), len(self.terms)
        df = np.bincount(self.of, minlength=size)
        common = np.flatnonzero(df * COMMON >= n)
        self.place = np.full(size, -1)
        self.place[common] = np.arange(len(common))
        self.blocks = max(1, -(-n // BLOCK))
        self.repeats = int(np.unique(self.ids, return_counts=True)[1].max()) if n else 1
        d = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first))
        long = self.place[self.of] >= 0
        self.dense = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        self.dense[d[long], self.place[self.of[long]]] = self.by[long]
        self.peak = np.ascontiguousarray(self.dense.reshape(self.blocks, BLOCK, len(common)).max(1).T)
        order = np.flatnonzero(~long).astype(np.int32)
        order = order[np.argsort(self.of[order], kind="stable")]
        self.row, self.weight = d[order], self.by[order]
        self.start = np.searchsorted(self.of[order], np.arange(size + 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "weight", "start", "place", "dense", "peak", "blocks", "repeats")}

    def example(self, i: int) -> Query:
        return self.of[self.first[i] : self.first[i + 1]], self.by[self.first[i] : self.first[i + 1]].astype(float)

    def query(self, terms: np.ndarray, counts: np.ndarray) -> Query:
        values = (1 + np.log(counts)) * self.idf[terms]
        return terms, values / np.sqrt((values**2).sum()) if len(values) else values

    def nearest(self, query: Query, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k nearest examples, the one with doc_id ``own`` apart."""
        return self.neighbours([query], [own])[0]

    def neighbours(self, queries: list[Query], own: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not hasattr(self, "start"):
            self._invert()
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        some = [i for i, q in enumerate(queries) if len(q[0])] if len(self.ids) else []
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            for i, (row, sim) in zip(part, self._search([queries[i] for i in part], [own[i] for i in part])):
                out[i] = row[: self.k], sim[: self.k]
        return out

    def _search(self, queries: list[Query], own: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the rows and similarities of the k nearest examples, best first."""
        n, width = len(self.ids), self.blocks * BLOCK
        exact = np.zeros((len(queries), self.dense.shape[1]))
        short = np.empty((len(queries), width))
        for i, (t, v) in enumerate(queries):
            place = self.place[t]
            long = place >= 0
            exact[i, place[long]] = v[long]
            t, v = t[~long], v[~long]
            size = self.start[t + 1] - self.start[t]
            posting = _ranges(self.start[t], size)
            short[i] = np.bincount(self.row[posting], np.repeat(v, size) * self.weight[posting], width)
        heavy, score = exact.astype(np.float32), short.astype(np.float32)
        # the k-th best score of any k examples bounds the k-th best of all from below; examples with the query's own doc_id may be among them
        k = self.k + self.repeats
        limit = np.zeros(len(queries), np.float32)
        if n > FIRST + k:
            for i, row in enumerate(np.argpartition(score, width - FIRST - k, axis=1)[:, width - FIRST - k :]):
                full = score[i, row] + self.dense[row] @ heavy[i]
                limit[i] = np.partition(full, len(full) - k)[len(full) - k]
        best = score.reshape(len(queries), self.blocks, BLOCK).max(2) + heavy @ self.peak
        self.opened = best + _ERROR >= limit[:, None]
        block, asked = np.nonzero(self.opened.T)
        edge = np.searchsorted(block, np.arange(self.blocks + 1))
        for b in np.flatnonzero(np.diff(edge)):
            q, at = asked[edge[b] : edge[b + 1]], slice(b * BLOCK, (b + 1) * BLOCK)
            score[q, at] += heavy[q] @ self.dense[at].T
        # what is in a closed block can't be among the k best, but its sum isn't complete
        score.reshape(len(queries), self.blocks, BLOCK)[~self.opened] = -1
        out = []
        for i in range(len(queries)):
            line = score[i, :n]
            least = max(0.0, float(np.partition(line, n - k)[n - k]) - _ERROR) if n > k else 0.0
            near = np.flatnonzero((line > 0) & (line >= least))
            sim = np.round(short[i, near] + self.dense[near].astype(float) @ exact[i], _ROUND)
            best_of = np.lexsort((self.ids[near], -sim))
            best_of = best_of[(self.ids[near[best_of]] != own[i]) & (sim[best_of] > 0)] if own[i] is not None else best_of[sim[best_of] > 0]
            out.append((near[best_of], sim[best_of]))
        return out

    def share(self, row: np.ndarray, sim: np.ndarray) -> float:
        return float((sim @ self.label[row] + PRIOR_VOTES * self.prior) / (sim.sum() + PRIOR_VOTES)) if len(row) else self.prior

    def queries(self, texts: list[str]) -> list[tuple[Query, list[str]]]:
        """The query of each text, and its telling words."""
        words = K.Words(texts)
        none: Query = np.zeros(0, np.int64), np.zeros(0)
        out: list[tuple[Query, list[str]]] = [(none, [])] * len(texts)
        if not len(self.terms) or not len(words.hash):
            return out
        low = np.searchsorted(self.terms, words.hash)
        low[low == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[low] == words.hash)
        doc = np.searchsorted(words.off, hit, "right") - 1
        pair, first, count = np.unique(doc * len(self.terms) + low[hit], return_index=True, return_counts=True)
        edge = np.flatnonzero(np.concatenate([[True], np.diff(pair // len(self.terms)) > 0, [True]])) if len(pair) else [0]
        for a, b in zip(edge[:-1], edge[1:]):
            terms = pair[a:b] % len(self.terms)
            names = sorted(words.word(i) for i in hit[first[a:b]][self.telling[terms]])
            out[int(pair[a] // len(self.terms))] = self.query(terms, count[a:b]), names
        return out


class Calibration:
    """Isotonic steps from a share of votes to a probability."""

    def __init__(self, share: np.ndarray, label: np.ndarray, prior: float) -> None:
        self.x, self.y = isotonic(np.round(share, _ROUND), label.astype(float)) if len(share) else (np.zeros(1), np.array([prior]))

    def __call__(self, share: float) -> float:
        return float(self.y[max(0, int(np.searchsorted(self.x, round(share, _ROUND), "right")) - 1)])


def _own_shares(model: Broadcast, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for batch in it:
        rows = batch.column(0).to_pylist()
        found = m.neighbours([m.example(i) for i in rows], [int(m.ids[i]) for i in rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.share(*x) for x in found], pa.float64())], ["id", "share"])


def _score(model: Broadcast, calibrated: Calibration, threshold: float, apply: bool, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for part, texts in spans.slices(it):
        ids = part.column(part.schema.names.index("doc_id")).to_pylist()
        out: list[tuple] = []
        asked = m.queries(texts)
        for (query, names), (row, sim) in zip(asked, m.neighbours([x for x, _ in asked], ids)):
            p = calibrated(m.share(row, sim))
            out.append((p, p >= threshold and len(query[0]) > 0, len(row), m.ids[row[:EVIDENCE]].tolist(), sim[:EVIDENCE].tolist(), names))
        p, toxic, n, near, sims, terms = zip(*out) if out else ([],) * 6
        if apply:
            yield part.filter(pa.array([not x for x in toxic], pa.bool_()))
        else:
            columns = [pa.array(p, pa.float64()), pa.array(toxic, pa.bool_()), pa.array(n, pa.int32()), pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64())), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "toxicity", "toxic", "n_neighbours", "neighbours", "similarities", "terms"])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> tuple[Broadcast, Calibration]:
    """A model of at most ``examples`` labelled documents, those whose hashed doc_id is smallest, and its calibration."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("toxic").alias("__low"), F.max("toxic").alias("__toxic"))
    sample = known.where("__low = __toxic").orderBy(F.xxhash64("__id"), "__id").limit(examples).select("__id", "__toxic")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(frames.sized(sample, examples, 16), F.col("doc_id") == F.col("__id")).select("doc_id", F.col("__toxic").cast("int").alias("toxic"), "text")
    # a doc_id that many rows share is one example: what comes to the driver is bounded
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = rows.mapInArrow(_features, "doc_id long, toxic int, terms binary, counts binary, lows binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    kinds = (("terms", "<u8"), ("counts", "<i4"), ("lows", "<u8"))
    ids, toxic = got["doc_id"].to_pylist(), got["toxic"].to_pylist()
    features = list(zip(*([np.frombuffer(x.as_py(), t) for x in got[c]] for c, t in kinds)))
    del got
    model = Model(ids, toxic, features, neighbours)
    del features
    shared, n = spark.sparkContext.broadcast(model), len(model.ids)
    share = np.full(n, model.prior)
    if n:
        own = spark.range(0, n, 1, max(1, n // 512)).mapInArrow(partial(_own_shares, shared), "id long, share double").toArrow()
        share[own["id"].to_numpy()] = own["share"].to_numpy()
    return shared, Calibration(share, model.label, model.prior)


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, toxicity (calibrated), toxic, n_neighbours and the evidence (nearest examples, similarities, telling words), for every row.

    Defined cases: a null or empty text, or one without a word of the examples, has no neighbour, the calibrated
    prior and isn't toxic; a document isn't its own neighbour; equal similarities go to the smaller doc_id;
    repeated rows are scored alike; examples with contradicting labels aren't used; of texts that share a doc_id one is the example; a row without doc_id is
    scored, but is no example; without labels nothing is toxic; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_score, *fit(docs, labels, examples, neighbours), threshold, False), _REPORT)


def drop_toxic(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the toxic ones; same columns, whatever they are called.

    Defined cases: as in ``toxicity``; so rows with a null or empty text stay, repeated rows stay or go together,
    and an empty table stays empty.
    """
    return frames.map_rows(docs, partial(_score, *fit(docs, labels, examples, neighbours), threshold, True))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
