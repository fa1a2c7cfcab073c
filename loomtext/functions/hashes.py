"""Canonical murmur3 hashes of strings, whose tails the built-in hash treats in another way; computed on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_U32, _U64 = np.uint32, np.uint64
SEED = 42


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    return x << x.dtype.type(k) | x >> x.dtype.type(bits - k)


def _blocks(data: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Values of equal length together: their places, their whole blocks as a matrix of bytes, and the rest, filled up with zeros."""
    size = np.array([len(x) for x in data])
    out = []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        bytes_ = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), n)
        whole = n - n % width
        rest = np.zeros((len(at), width), np.uint8)
        rest[:, : n - whole] = bytes_[:, whole:]
        out.append((at, np.ascontiguousarray(bytes_[:, :whole]), rest))
    return out


def murmur3_32(data: list[bytes], seed: int = SEED) -> np.ndarray:
    out = np.zeros(len(data), _U32)
    a, b = _U32(0xCC9E2D51), _U32(0x1B873593)
    with np.errstate(over="ignore"):
        for at, whole, rest in _blocks(data, 4):
            h = np.full(len(at), seed, _U32)
            for k in whole.view("<u4").T if whole.shape[1] else ():
                h = _rotate(h ^ _rotate(k * a, 15) * b, 13) * _U32(5) + _U32(0xE6546B64)
            h ^= _rotate(rest.view("<u4")[:, 0] * a, 15) * b
            h ^= _U32(len(data[at[0]]))
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                h = (h ^ h >> _U32(shift)) * _U32(factor)
            out[at] = h ^ h >> _U32(16)
    return out


def murmur3_128(data: list[bytes], seed: int = SEED) -> np.ndarray:
    """Two 64-bit words a value."""
    out = np.zeros((len(data), 2), _U64)
    a, b = _U64(0x87C37B91114253D5), _U64(0x4CF5AD432745937F)

    def final(h: np.ndarray) -> np.ndarray:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> _U64(33)) * _U64(factor)
        return h ^ h >> _U64(33)

    with np.errstate(over="ignore"):
        for at, whole, rest in _blocks(data, 16):
            h, g = np.full(len(at), seed, _U64), np.full(len(at), seed, _U64)
            words = whole.view("<u8").T if whole.shape[1] else np.zeros((0, len(at)), _U64)
            for k, j in zip(words[::2], words[1::2]):
                h = (_rotate(h ^ _rotate(k * a, 31) * b, 27) + g) * _U64(5) + _U64(0x52DCE729)
                g = (_rotate(g ^ _rotate(j * b, 33) * a, 31) + h) * _U64(5) + _U64(0x38495AB5)
            k, j = rest.view("<u8").T
            g ^= _rotate(j * b, 33) * a
            h ^= _rotate(k * a, 31) * b
            n = _U64(len(data[at[0]]))
            h, g = h ^ n, g ^ n
            h = h + g
            g = g + h
            h, g = final(h), final(g)
            h = h + g
            out[at] = np.stack([h, g + h], 1)
    return out


def murmur3(text: Column, seed: int = SEED) -> Column:
    """The 32-bit hash of a text's UTF-8 bytes, as a signed number; null of null."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        some = texts.notna()
        out = pd.Series([None] * len(texts), dtype="Int32")
        out[some] = murmur3_32([t.encode() for t in texts[some]], seed).view(np.int32)
        return out

    return run(text)


def murmur3_hex(text: Column, seed: int = SEED) -> Column:
    """The 128-bit hash of a text's UTF-8 bytes, as 32 hexadecimal digits; null of null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        some = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        out[some] = [f"{int(x):016x}{int(y):016x}" for x, y in murmur3_128([t.encode() for t in texts[some]], seed)]
        return out

    return run(text)
