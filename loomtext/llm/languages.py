"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``WIDTH`` signs, drawn from its code point. The vector of a
trigram binds its letters by multiplication, the first shifted by two places, the second by one; white
space and whatever isn't a letter counts as one blank letter, and the middle one is never blank. A
document is the sum of its trigrams' vectors, a language's prototype the sum over all documents that
are declared to be in it. The language of a document is that of the prototype with the largest
cosine; equal ones go to the smaller name.

A batch is a matrix of trigram counts times the matrix of its distinct trigrams' vectors, ``_BLOCK`` trigrams at a
time, so no vector is built letter by letter and memory doesn't grow with the alphabet or the text: long
texts are cut into segments that share their borders' letters, and the segments' sums added. Two narrow passes over the text: the first sends one vector a
language and task, the second nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import kernels as K
from loomtext.session import read

U = np.uint64
WIDTH, SEED, BLANK, LANGUAGES = 1024, 20_011, 32, 4096
_CHUNK_CHARS, _BLOCK, _ROWS, _ROUND = 1 << 19, 4096, 512, 6
_REPORT = "doc_id long, lang string, predicted string, similarity double, margin double, keep boolean"


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """One row of signs (1 or -1, 32-bit floats) for each code point."""
    words = K.mix((letters.astype(U)[:, None] << U(20)) + np.arange(WIDTH // 64, dtype=U)[None, :] + U(SEED))
    bits = np.unpackbits(K.mix(words ^ U(0xA0761D6478BD642F)).view(np.uint8).reshape(len(letters), WIDTH // 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _letters() -> np.ndarray:
    """Lower-case code point of every letter, blank for everything else."""
    if "letters" not in K._tables:
        table = K.lower_table().copy()
        for cp in range(0x20000):
            if table[cp] and not chr(cp).isalpha():
                table[cp] = 0
        table[table == 0] = BLANK
        K._tables["letters"] = table
    return K._tables["letters"]


def _segments(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Segments of at most ``_CHUNK_CHARS`` letters, and one more at borders inside a text; the text each is of, and how many letters before and after aren't its own."""
    out: list[str] = []
    owner: list[int] = []
    edges: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), _CHUNK_CHARS):
            lead, end = int(at > 0), at + _CHUNK_CHARS
            if size > _CHUNK_CHARS:
                yield out, np.array(owner), np.array(edges)
                out, owner, edges, size = [], [], [], 0
            out.append(t[at - lead : end + 1] if lead or end < len(t) else t)
            owner.append(i)
            edges.append((lead, int(end < len(t))))
            size += len(out[-1])
    if out:
        yield out, np.array(owner), np.array(edges)


def trigrams(texts: list[str], edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams, as keys, and (text, trigram, count) of what the texts hold; no trigram has its middle in the ``edges``."""
    cps, base = K.codepoints(texts)
    low = _letters()[cps]
    if len(low) < 2:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    before = np.concatenate([[BLANK], low[:-1]])
    after = np.concatenate([low[1:], [BLANK]])
    middle = low != BLANK
    if edges is not None and edges.any():
        middle[base[:-1][edges[:, 0] > 0]] = False
        middle[base[1:][edges[:, 1] > 0] - 2] = False
    at = np.flatnonzero(middle)
    key = (before[at].astype(U) << U(42)) | (low[at].astype(U) << U(21)) | after[at].astype(U)
    known, gram = np.unique(key, return_inverse=True)
    text = np.searchsorted(base, at, "right") - 1
    pair, count = np.unique(text * max(1, len(known)) + gram, return_counts=True)
    return known, pair // max(1, len(known)), pair % max(1, len(known)), count


class _Buffers:
    """Arrays that a worker uses again and again, so that their memory isn't fetched anew each time."""

    def __init__(self) -> None:
        self.a = np.empty((_BLOCK, WIDTH), np.float32)
        self.b = np.empty((_BLOCK, WIDTH), np.float32)
        self.counts = np.zeros((_ROWS, _BLOCK), np.float32)


@lru_cache(1)
def _buffers(block: int) -> _Buffers:
    return _Buffers()


def bound(known: np.ndarray) -> np.ndarray:
    """The vectors of at most ``_BLOCK`` trigrams; they are overwritten by the next call."""
    three = [known >> U(42), known >> U(21) & U(0x1FFFFF), known & U(0x1FFFFF)]
    letters = np.unique(np.concatenate(three))
    vectors = letter_vectors(letters)
    a, b, c = (np.searchsorted(letters, x) for x in three)
    out, factor = _buffers(_BLOCK).a[: len(known)], _buffers(_BLOCK).b[: len(known)]
    np.take(np.roll(vectors, 2, 1), a, 0, out, "clip")
    for rows, at in ((np.roll(vectors, 1, 1), b), (vectors, c)):
        np.take(rows, at, 0, factor, "clip")
        out *= factor
    return out


def _bundle(rows: int, known: np.ndarray, row: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the trigrams' vectors, one a row; exact, as the sums of whole numbers stay below 2**24 in a chunk."""
    out = np.zeros((rows, WIDTH), np.float32)
    order = np.argsort(gram // _BLOCK, kind="stable")
    row, gram, count = row[order], gram[order], count[order]
    counts = _buffers(_BLOCK).counts
    for start in range(0, len(known), _BLOCK):
        vectors = bound(known[start : start + _BLOCK])
        own = slice(*np.searchsorted(gram // _BLOCK, [start // _BLOCK, start // _BLOCK + 1]))
        r, g, c = row[own], gram[own] - start, count[own]
        for top in range(0, rows, _ROWS):
            some = slice(*np.searchsorted(r, [top, top + _ROWS]))
            if some.start < some.stop:
                at = r[some] - top, g[some]
                counts[at] = c[some]
                n = min(_ROWS, rows - top)
                out[top : top + n] += counts[:n, : len(vectors)] @ vectors
                counts[at] = 0
    return out


def bundles(texts: list[str], owner: list[int], rows: int) -> np.ndarray:
    """Sums of the vectors of all trigrams of the texts that ``owner`` gives to each row."""
    out = np.zeros((rows, WIDTH))
    of = np.array(owner, np.int64)
    for part, text, edges in _segments(texts):
        known, segment, gram, count = trigrams(part, edges)
        key, at = np.unique(of[text[segment]] * max(1, len(known)) + gram, return_inverse=True)
        total = np.bincount(at, count, len(key))
        out += _bundle(rows, known, key // max(1, len(known)), key % max(1, len(known)), total)
    return out


def _train(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in it:
        for part, texts in K.chunks(batch, chars=_CHUNK_CHARS):
            names = part.column(part.schema.names.index("lang")).to_pylist()
            own = sorted(set(names))
            total = bundles(texts, [own.index(x) for x in names], len(own))
            for k, name in enumerate(own):
                sums[name] = sums.get(name, 0) + np.rint(total[k]).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["lang", "bundle"])


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in table["bundle"].to_pylist())
    return pa.table([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["lang", "bundle"])


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """The bundle of each declared language, by name; an error beyond ``LANGUAGES``, as profiles are broadcast (8 KB each)."""
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    parts = rows.mapInArrow(_train, "lang string, bundle binary").groupBy("lang").applyInArrow(_add, "lang string, bundle binary").limit(LANGUAGES + 1).toArrow()
    if parts.num_rows > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} declared languages")
    got = {a: np.frombuffer(b, "<i8").astype(float) for a, b in zip(parts["lang"].to_pylist(), parts["bundle"].to_pylist())}
    return {k: got[k] for k in sorted(got) if got[k].any()}


def classify(texts: list[str], profiles: dict[str, np.ndarray]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Language, cosine and its lead over the second best, of each text; nothing for a text without letters."""
    names = list(profiles)
    out = np.zeros((len(texts), len(names)))
    sums = bundles(texts, list(range(len(texts))), len(texts))
    norm = np.sqrt((sums**2).sum(1))
    has = norm > 0
    if names:
        unit = np.stack([v / np.sqrt((v**2).sum()) for v in profiles.values()], 1)
        out[has] = np.round((sums[has] @ unit) / norm[has][:, None], _ROUND)
        best = out.argmax(1)
        top = out[np.arange(len(texts)), best]
        second = np.sort(out, 1)[:, -2] if len(names) > 1 else np.zeros(len(texts))
        return [names[b] if h else None for b, h in zip(best, has)], top, np.round(top - second, _ROUND)
    return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))


def _classify(profiles: Broadcast, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for part, texts in K.chunks(batch, chars=_CHUNK_CHARS):
            declared = part.column(2).to_pylist()
            named, top, lead = classify(texts, profiles.value)
            none = pa.array([n is None for n in named])
            keep = [n is None or d is None or n == d for n, d in zip(named, declared)]
            columns = [pa.array(named, pa.string()), pa.array(top, mask=none.to_numpy(False)), pa.array(lead, mask=none.to_numpy(False)), pa.array(keep, pa.bool_())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["doc_id", "lang", "predicted", "similarity", "margin", "keep"])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, lang (declared), predicted, similarity, margin and keep (not contradicted), for every row.

    Defined cases: a text without a letter (null or empty too) has no prediction and is kept; rows without
    a declared lang train nothing, get a prediction and are kept; with one language the margin is the
    similarity; without any, nothing is predicted; more than ``LANGUAGES`` declared ones are an error; of equal cosines the smaller name counts; a text of any length is read whole; repeated rows and rows without doc_id are treated
    like others; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    profiles = docs.sparkSession.sparkContext.broadcast(prototypes(rows))
    return rows.mapInArrow(partial(_classify, profiles), _REPORT)


def op3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
