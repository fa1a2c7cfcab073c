"""Array kernels shared by the corpus operators.

Everything here works on whole Arrow batches with numpy: a batch of texts becomes one code
point array, words are maximal runs of letters and numbers (Unicode categories L* and N*),
lower-cased code point by code point so that offsets keep pointing into the original text,
and a word is represented by a 64-bit polynomial hash. No per-word Python runs.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_SCAN_CHARS = 1 << 18
_CHUNK_CHARS = 1 << 21


def _return_freed_arrays() -> None:
    """Workers live for many tasks: what they free goes back to the system. Arrow's pools keep it, and so does glibc, up to the size of what was freed before."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        return


_return_freed_arrays()


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser: a bijection on 64-bit words that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of a fixed odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            base = np.full(size, _B, U)
            base[0] = 1
            self.up = np.multiply.accumulate(base)
            base = np.full(size, _B_INV, U)
            base[0] = 1
            self.down = np.multiply.accumulate(base)
        return self.up[:n], self.down[:n]


_powers = _Powers()
_tables: dict[str, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """Lower-case code point of every letter or number, 0 for every other code point."""
    if "lower" not in _tables:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x20000):
            c = chr(cp)
            if unicodedata.category(c)[0] in "LN":
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
        _tables["lower"] = table
    return _tables["lower"]


def _value_table() -> np.ndarray:
    if "value" not in _tables:
        low = lower_table()
        value = mix(low.astype(U) + U(0x51ED270B))
        value[low == 0] = 0
        _tables["value"] = value
    return _tables["value"]


def visible_table() -> np.ndarray:
    """1 for every code point that is neither white space, control, letter nor number."""
    if "visible" not in _tables:
        table = (lower_table() == 0).astype(np.int8)
        for cp in range(0x3100):
            if chr(cp).isspace() or cp < 32 or 127 <= cp < 160:
                table[cp] = 0
        _tables["visible"] = table
    return _tables["visible"]


def cased_values() -> np.ndarray:
    """As the values that words are made of, but upper case counts."""
    if "cased" not in _tables:
        value = mix(np.arange(0x110000).astype(U) + U(0x51ED270B))
        value[lower_table() == 0] = 0
        _tables["cased"] = value
    return _tables["cased"]


def visible_values() -> np.ndarray:
    if "marks" not in _tables:
        value = mix(np.arange(0x110000).astype(U) + U(0x1B873593))
        value[visible_table() == 0] = 0
        _tables["marks"] = value
    return _tables["marks"]


def upper_table() -> np.ndarray:
    """1 for every upper-case letter."""
    if "upper" not in _tables:
        table = np.zeros(0x110000, np.int8)
        for cp in range(0x20000):
            table[cp] = unicodedata.category(chr(cp)) == "Lu"
        _tables["upper"] = table
    return _tables["upper"]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points with a zero after each text, and where each text starts."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    joined = "\0".join(texts) + "\0" if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


class Words:
    """Words of a list of texts.

    ``hash`` has one value a word; words of text ``i`` are ``off[i]:off[i + 1]``; ``start`` and
    ``end`` are offsets into the joined code points and ``base[i]`` is where text ``i`` begins.
    """

    __slots__ = ("hash", "start", "end", "off", "base", "cps")

    def __init__(self, texts: list[str], values: np.ndarray | None = None) -> None:
        """``values``: a 64-bit value for every code point that words are made of, 0 for every other one."""
        self.cps, base = codepoints(texts)
        self.base = base
        values = _value_table() if values is None else values
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, n = 0, len(self.cps)
        while at < n:
            to = min(n, at + _SCAN_CHARS)
            v = values[self.cps[at:to]]
            while to < n and v[-1]:
                gap = np.flatnonzero(v[-4096:] == 0)
                if len(gap):
                    to -= min(4096, len(v)) - int(gap[-1]) - 1
                    v = v[: to - at]
                    break
                more = min(n, to + _SCAN_CHARS)
                v = np.concatenate([v, values[self.cps[to:more]]])
                to = more
            parts.append(_words_of(v, at))
            at = to
        empty = np.zeros(0, np.int64)
        self.start = np.concatenate([p[0] for p in parts]) if parts else empty
        self.end = np.concatenate([p[1] for p in parts]) if parts else empty
        self.hash = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, U)
        self.off = np.searchsorted(self.start, base)

    def doc(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def word(self, i: int) -> str:
        return "".join(map(chr, lower_table()[self.cps[self.start[i] : self.end[i]]]))


def _words_of(v: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.empty(len(v) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(v, 0, out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers.upto(len(v) + 1)
    total = np.zeros(len(v) + 1, U)
    np.cumsum(v * up[: len(v)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return start + at, end + at, mix(h ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


def word_hash(word: str) -> int:
    return int(Words([word]).hash[0])


def windows(h: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``length`` words that lies in one text, and its first word's index."""
    n = len(h)
    if n < length:
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = _powers.upto(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(h * up[:n], out=total[1:])
    w = mix((total[length:] - total[:-length]) * down[: n - length + 1])
    ok = np.ones(n - length + 1, bool)
    for k in range(1, length):  # a window that begins in a text's last length - 1 words leaves it
        last = off[1:] - k
        last = last[(last >= off[:-1]) & (last <= n - length)]
        ok[last] = False
    at = np.flatnonzero(ok)
    return w[at], at


def text_hash(words: Words) -> np.ndarray:
    """One 64-bit hash of each whole text, code point by code point."""
    return cumulative_hash(words.cps, words.base)


def cumulative_hash(cps: np.ndarray, base: np.ndarray) -> np.ndarray:
    """As ``text_hash``, of code points and where each text starts in them."""
    v = mix(cps.astype(U) + U(0x2545F491))
    up, down = _powers.upto(len(v) + 1)
    total = np.zeros(len(v) + 1, U)
    np.cumsum(v * up[: len(v)], out=total[1:])
    return mix((total[base[1:]] - total[base[:-1]]) * down[base[:-1]])


# -- Arrow batches -----------------------------------------------------------------------------


def chunks(batch: pa.RecordBatch, column: str = "text", chars: int = _CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``chars`` bytes of text each (one text at least); a null text reads as ''."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + chars, "right")))
        part = batch.slice(at, to - at)
        yield part, [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
        at = to


# -- blobs of integers --------------------------------------------------------------------------


def pack_ints(x: np.ndarray) -> bytes:
    """LEB128 of non-negative integers, vectorised."""
    x = x.astype(U)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        big = x >= U(1 << (7 * k))
        if not big.any():
            break
        size += big
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(x) else 0, np.uint8)
    first = ends - size
    for k in range(int(size.max()) if len(x) else 0):
        on = size > k
        out[first[on] + k] = ((x[on] >> U(7 * k)) & U(127)).astype(np.uint8) | np.where(size[on] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack_ints(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.empty(len(last), np.int64)
    first[:1] = 0
    first[1:] = last[:-1] + 1
    size = last - first + 1
    x = np.zeros(len(last), U)
    for k in range(int(size.max()) if len(size) else 0):
        on = size > k
        x[on] |= (b[first[on] + k].astype(U) & U(127)) << U(7 * k)
    return x


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit words: low bytes raw, plane by plane, and the gaps between the high parts as LEB128.

    The number of raw bytes follows from how dense the words are, so that a gap takes little more than a byte.
    """
    n = len(x)
    if not n:
        return b""
    spread = max(1, int(x[-1]) - int(x[0])) // n
    raw = max(0, (spread.bit_length() - 1) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :raw].T.tobytes()
    high = x >> U(8 * raw) if raw < 8 else np.zeros(n, U)
    gaps = np.empty(n, U)
    gaps[0] = high[0]
    np.subtract(high[1:], high[:-1], out=gaps[1:])
    return bytes([raw]) + n.to_bytes(4, "little") + planes + pack_ints(gaps)


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    raw, n = blob[0], int.from_bytes(blob[1:5], "little")
    high = np.cumsum(unpack_ints(blob[5 + n * raw :]))
    x = high << U(8 * raw) if raw < 8 else high * U(0)
    low = np.zeros((n, 8), np.uint8)
    low[:, :raw] = np.frombuffer(blob, np.uint8, n * raw, 5).reshape(raw, n).T
    return x | low.reshape(-1).view("<u8")


def pack_small(x: np.ndarray) -> bytes:
    """Non-negative integers in as few whole bytes each as the largest takes, plane by plane."""
    n = len(x)
    if not n:
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T.tobytes()


def unpack_small(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    width = blob[0]
    n = (len(blob) - 1) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, 1).reshape(width, n).T
    return out.reshape(-1).view("<i8")


def split_at(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in an ascending bucket column, and the end."""
    return np.searchsorted(bucket, np.arange(buckets + 1))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by a hash's leading 32 bits, so that ascending hashes have ascending buckets."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
