"""N-grams of token arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def windows(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))).otherwise(F.expr("cast(array() as array<array<string>>)"))


def ngrams(tokens: Column, n: int, boundary: int = -1) -> Column:
    """Arrays of n tokens. What happens where fewer are left is the boundary mode's:

    -1: a shorter sequence has none; 0: it counts as one n-gram itself; 1: the first token is put before it
    n - 2 times, else as 0; 2: n-grams grow from two tokens to n at the beginning, a single token stays one.
    """
    if boundary == 1 and n > 2:
        tokens = F.when(F.size(tokens) > 0, F.concat(F.array_repeat(F.get(tokens, F.lit(0)), n - 2), tokens)).otherwise(tokens)
    none = F.expr("cast(array() as array<array<string>>)")
    if boundary == -1:
        return windows(tokens, n)
    if boundary in (0, 1):
        return F.when(F.size(tokens) == 0, none).when((F.size(tokens) == 1) | (F.size(tokens) <= n), F.array(tokens)).otherwise(windows(tokens, n))
    size = F.least(F.size(tokens), F.lit(n))
    grown = F.when(size > 2, F.transform(F.sequence(F.lit(2), size - 1), lambda i: F.slice(tokens, F.lit(1), i))).otherwise(none)
    full = F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.slice(tokens, i, size))
    if n == 1:  # one n-gram fewer than there are tokens
        full = F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0)))
    return F.when(F.size(tokens) == 0, none).when(F.size(tokens) == 1, F.array(tokens)).otherwise(F.concat(grown, full))


def keys(tokens: Column, n: int, boundary: int = -1) -> Column:
    """The n-grams as strings, tokens joined by a blank."""
    return F.transform(ngrams(tokens, n, boundary), lambda g: F.array_join(g, " "))


def cardinalities(text: str) -> range:
    """'1-5', '-5' or '5' as a range of n."""
    low, dash, high = text.strip().rpartition("-")
    n = int(high)
    return range(int(low) if low else (1 if dash else n), n + 1)


def history(key: Column) -> Column:
    """All words of an n-gram's key but the last; '' of a single word."""
    return F.when(key.contains(" "), F.regexp_extract(key, r"^(.*) [^ ]+$", 1)).otherwise(F.lit(""))


def lower_order(key: Column) -> Column:
    """All words but the first; '' of a single word."""
    return F.when(key.contains(" "), F.regexp_extract(key, r"^[^ ]+ (.*)$", 1)).otherwise(F.lit(""))


def last_word(key: Column) -> Column:
    return F.substring_index(key, " ", -1)
