"""Best-fit packing by minimum bin slack.

A document's length is its number of tokens: words (runs of letters and numbers) and other visible
characters. Documents longer than a bin are split into full bins and a rest, so nothing is cut off: the pieces of a
document, in order, make up its text to the character.
The pieces of a pack group, which a hash assigns and which has about ``GROUP_CHARS`` characters, are packed in
one task: each bin is opened by the longest piece left, and a subset-sum over the lengths that are
left, with reachable sums as the bits of one integer, finds the fullest combination that fits. The
combination is removed and the next bin opened. A piece travels to its group with its text, in the only shuffle, and a
bin comes out as neighbouring rows, so training sequences are read off the result without another one. The number of groups
follows the corpus; each group costs about one partly filled bin, so the share of filled space doesn't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import kernels as K
from loomtext.llm import spans
from loomtext.session import read

U = np.uint64
CAPACITY, GROUP_CHARS = 2048, 16_000_000
_ROW_CHARS = 64  # what a piece counts besides its text, so that many short ones don't share a group
_PIECES = "pack long, key long, doc_id long, piece int, start_token int, n_tokens int, start_char int, text string"
_PACKED = "bin_id long, slot int, doc_id long, piece int, start_token int, n_tokens int, start_char int, bin_tokens int, text string"


def token_counts(words: K.Words) -> np.ndarray:
    marks = np.zeros(len(words.cps) + 1, np.int64)
    np.cumsum(K.visible_table()[words.cps], out=marks[1:])
    return np.diff(words.off) + marks[words.base[1:]] - marks[words.base[:-1]]


def token_starts(words: K.Words, doc: int) -> np.ndarray:
    """Where each token of a text begins, in characters of the text."""
    base, end = words.base[doc], words.base[doc + 1]
    marks = np.flatnonzero(K.visible_table()[words.cps[base:end]])
    return np.sort(np.concatenate([words.start[words.off[doc] : words.off[doc + 1]] - base, marks]))


def _keys(ids: pa.Array, words: K.Words, seen: dict[tuple[int | None, int], int]) -> np.ndarray:
    """A hash of each row: equal rows, and rows without doc_id, get different ones by task and by how many came before.

    Which of some equal rows comes first doesn't matter, so a task that is run again gives the same rows.
    """
    text = K.text_hash(words)
    task = TaskContext.get()
    own = (task.partitionId() if task else 0) + 1
    salt = np.zeros(len(text), U)
    for i, at in enumerate(zip(ids.to_pylist(), text.tolist())):
        n = seen[at] = seen.get(at, -1) + 1
        if n or at[0] is None:
            salt[i] = own << 40 | n + 1
    return K.mix(K.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U) + U(1)) ^ text ^ K.mix(salt))


def _pieces(capacity: int, groups: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[int | None, int], int] = {}
    for part, texts in spans.slices(it):
        words = K.Words(texts)
        n = token_counts(words)
        k = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), k)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        size = np.minimum(n[row] - piece * capacity, capacity)
        char, text = np.zeros(len(row), np.int64), [texts[i] for i in row]
        first = np.cumsum(k) - k
        for d in np.flatnonzero(k > 1):
            at = token_starts(words, d)[capacity::capacity]
            edge = [0, *at.tolist(), len(texts[d])]
            char[first[d] : first[d] + k[d]] = edge[:-1]
            text[first[d] : first[d] + k[d]] = [texts[d][b:e] for b, e in zip(edge[:-1], edge[1:])]
        key = K.mix(_keys(part.column(0), words, seen)[row] ^ (piece.astype(U) * U(0x9E3779B97F4A7C15)))
        columns = [pa.array((key % U(groups)).astype(np.int64)), pa.array(key.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int32()), pa.array(size, pa.int32()), pa.array(char, pa.int32()), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["pack", "key", "doc_id", "piece", "start_token", "n_tokens", "start_char", "text"])


def fill(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers. ``lengths`` descends; all lengths are from 1 to ``capacity``.

    A bin's first piece is the longest that is left; the rest is, of all combinations of what is left,
    one with the largest sum that fits. Of pieces of one length the first goes first.
    """
    value, first, left = np.unique(-lengths, return_index=True, return_counts=True)
    sizes, at, left = [int(-v) for v in value], [int(x) for x in first], [int(x) for x in left]
    bins, top = [], 0
    while True:
        while top < len(sizes) and not left[top]:
            top += 1
        if top == len(sizes):
            return bins
        room = capacity - sizes[top]
        left[top] -= 1
        chosen = [at[top]]
        at[top] += 1
        full, reach = 1 << room, 1
        mask = (full << 1) - 1
        steps: list[tuple[int, int]] = []
        for k in range(top, len(sizes)):
            size = sizes[k]
            if size > room:
                continue
            for _ in range(min(left[k], room // size)):
                wider = (reach | reach << size) & mask
                if wider == reach:
                    break
                steps.append((k, reach))
                reach = wider
            if reach & full:
                break
        total = reach.bit_length() - 1
        for k, before in reversed(steps):
            if not before >> total & 1:
                total -= sizes[k]
                left[k] -= 1
                chosen.append(at[k])
                at[k] += 1
        bins.append(chosen)


def _pack(capacity: int, table: pa.Table) -> pa.Table:
    table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("key", "ascending")])
    n = table["n_tokens"].to_numpy().astype(np.int64)
    group = table["pack"][0].as_py()
    bins = fill(n[n > 0], capacity)
    order = np.array([i for b in bins for i in b], np.int64)
    size = np.array([len(b) for b in bins], np.int64)
    number = np.repeat(np.arange(len(bins)), size)
    slot = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    total = np.zeros(len(bins), np.int64)
    np.add.at(total, number, n[order])
    empty = np.flatnonzero(n == 0)
    none = pa.nulls(len(empty), pa.int64())
    rows = table.take(pa.array(np.concatenate([order, empty])))
    ids = pa.concat_arrays([pa.array((np.int64(group) << 24) + number, pa.int64()), none])
    slots = pa.concat_arrays([pa.array(slot, pa.int32()), none.cast(pa.int32())])
    sums = pa.concat_arrays([pa.array(total[number], pa.int32()), none.cast(pa.int32())])
    return pa.table([ids, slots, rows["doc_id"], rows["piece"], rows["start_token"], rows["n_tokens"], rows["start_char"], sums, rows["text"]], [x.split()[0] for x in _PACKED.split(", ")])


def pack(docs: DataFrame, capacity: int = CAPACITY, group_chars: int = GROUP_CHARS) -> DataFrame:
    """bin_id, slot, doc_id, piece, start_token, n_tokens, start_char, bin_tokens and text, one row a piece.

    The texts of a bin by slot are its training sequence; those of a document by piece are its text.

    Defined cases: a document without a token (null or empty text) is one piece of length 0 with null
    bin_id, slot and bin_tokens, and what text it has ('' for null); repeated rows, and rows that share a doc_id or have none, are packed
    one by one; a text of any length is split over as many bins as it takes; of pieces of one length the one
    with the smaller doc_id goes first; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + _ROW_CHARS)).first()[0] or 0
    groups = max(1, chars // group_chars)
    return rows.mapInArrow(partial(_pieces, capacity, groups), _PIECES).groupBy("pack").applyInArrow(lambda table: _pack(capacity, table), _PACKED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
