"""Cutting word ranges out of texts, shared by the operators that remove passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomtext.llm import kernels as K


def merge(starts: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges [from, to) that ranges beginning at ascending ``starts`` cover; touching ranges join."""
    if not len(starts):
        return starts, starts
    reach = np.maximum.accumulate(starts + length)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return starts[at], reach[np.concatenate([at[1:] - 1, [len(starts) - 1]])]


def cut_words(text: str, words: K.Words, doc: int, begin: np.ndarray, end: np.ndarray) -> str:
    """The text without the words of the ranges and what is between them; ``doc`` is the text's place in ``words``."""
    first, base = words.off[doc], words.base[doc]
    out, at = [], 0
    for b, e in zip(begin, end):
        out.append(text[at : words.start[first + b] - base])
        at = words.end[first + e - 1] - base
    out.append(text[at:])
    return "".join(out)


def with_text(batch: pa.RecordBatch, texts: dict[int, str]) -> pa.RecordBatch:
    """The batch with some rows' texts replaced, and n_chars, where there is such a number, made to fit them."""
    if not texts:
        return batch
    names = batch.schema.names
    columns = list(batch.columns)
    at = names.index("text")
    old = columns[at].to_pylist()
    for i, t in texts.items():
        old[i] = t
    columns[at] = pa.array(old, batch.schema.field(at).type)
    if "n_chars" in names and pa.types.is_integer(batch.schema.field("n_chars").type):
        k = names.index("n_chars")
        n = columns[k].to_pylist()
        for i, t in texts.items():
            n[i] = len(t)
        columns[k] = pa.array(n, batch.schema.field(k).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def slices(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in it:
        yield from K.chunks(batch)
