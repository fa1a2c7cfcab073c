"""Tokens as column expressions: regular-language tokenizers, types, filters, normalisation, merging.

Patterns keep to the syntax that Java and RE2 share. A segment is a struct of type and text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINES = r"[^\n\r\f\x{2028}]+"
SPACE_RUNS = r"[\p{Z}\p{Cc}]+|[^\p{Z}\p{Cc}]+"
CLASS_RUNS = r"[\p{L}\p{N}]+|[\p{Z}\p{Cc}]+|[^\p{L}\p{N}\p{Z}\p{Cc}]+"
SINGLES = r"\p{L}+|\p{N}+|(?s:.)"
#: Words joined over inner apostrophes and dots, as word-break iterators do, and every other character.
WORD_BREAKS = r"\r\n|[\p{L}\p{N}\p{M}_]+(?:['’.·][\p{L}\p{N}\p{M}_]+)*|(?s:.)"
#: Where a sentence-break iterator ends a sentence: after closing marks and blanks, unless a small letter follows; the next character is taken along.
SENTENCE_BREAKS = r"([.!?]+[\"'”’)\]]*[ \t\x{A0}]+)([^\p{Ll}\s.!?])"

#: Types in order of preference, with what all characters of such a token are.
TYPES = {
    "WORD_UPPERCASE": r"[\p{Lu}\p{Lt}]+",
    "WORD_LOWERCASE": r"[\p{Ll}\p{Lm}\p{Lo}]+",
    "WORD": r"\p{L}+",
    "NUMBER": r"\p{N}+",
    "WORD_WITH_NUMBER": r"[\p{L}\p{N}]+",
    "EMPTY_SPACE": r"[\p{Z}\p{Cc}]+",
    "PUNCTUATION": r"[\p{P}\p{M}]+",
    "NON_WORD": r"[^\p{L}]+",
}
WORDS = ("WORD", "WORD_UPPERCASE", "WORD_LOWERCASE")
READABLE = (*WORDS, "WORD_WITH_NUMBER", "NUMBER", "PUNCTUATION")
SYMBOLS = {"EMPTY_SPACE": " ", "PUNCTUATION": "."}


def runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lines(text: Column) -> Column:
    """Non-empty runs between line separators."""
    return runs(text, LINES)


def space_tokens(text: Column) -> Column:
    return runs(text, SPACE_RUNS)


def class_tokens(text: Column) -> Column:
    """Maximal runs of letters and numbers, of blanks, and of everything else."""
    return runs(text, CLASS_RUNS)


def single_tokens(text: Column) -> Column:
    """Letter runs, number runs, and every other character by itself."""
    return runs(text, SINGLES)


def pretokenized(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " ")), " ")


def break_words(text: Column) -> Column:
    """Words and other characters as a word-break iterator gives them, approximately."""
    return runs(text, WORD_BREAKS)


def break_sentences(text: Column) -> Column:
    """Sentences as a sentence-break iterator gives them, approximately: they end at closing marks that no small letter follows, and with their line."""
    marked = F.regexp_replace(F.regexp_replace(text, SENTENCE_BREAKS, "$1\x01$2"), r"(\r?\n)", "$1\x01")
    return F.filter(F.split(marked, "\x01"), lambda x: x != "")


TOKENIZERS = {"space": space_tokens, "class": class_tokens, "single": single_tokens, "pretokenized": pretokenized, "breaks": break_words, "null": F.array}


def register_tokenizer(name: str, tokenizer) -> None:
    """Make a function from a text column to an array of tokens available by name."""
    TOKENIZERS[name] = tokenizer


def type_of(token: Column) -> Column:
    """The narrowest type that allows all characters of a token; UNKNOWN where none does."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in TYPES.items():
        out = out.when(token.rlike(rf"^(?:{pattern})\z"), F.lit(name))
    return out.otherwise(F.lit("UNKNOWN"))


def typed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(type_of(t).alias("type"), t.alias("text")))


def keep_level(segments: Column, level: int) -> Column:
    """Segments that a filter level leaves: from 2 no blanks, from 3 readable ones only, from 4 no punctuation, from 5 no numbers."""
    gone = [*(["EMPTY_SPACE"] if level >= 2 else []), *(["NON_WORD", "UNKNOWN"] if level >= 3 else []), *(["PUNCTUATION"] if level >= 4 else []), *(["NUMBER", "WORD_WITH_NUMBER"] if level >= 5 else [])]
    return F.filter(segments, lambda s: ~s["type"].isin(gone)) if gone else segments


def normalized(segment: Column, level: int) -> Column:
    """Text of a segment: 1 squeezes repeats in non-words, 2 writes digits as 0, 3 writes blanks and punctuation as one symbol, 4 lowers."""
    kind, text = segment["type"], segment["text"]
    if level >= 1:
        text = F.when(kind == "NON_WORD", F.regexp_replace(text, r"(?s)(.)\1+", "$1")).otherwise(text)
    if level >= 2:
        text = F.when(kind == "NUMBER", F.lit("0")).when(kind == "WORD_WITH_NUMBER", F.regexp_replace(text, r"\p{Nd}+", "0")).otherwise(text)
    if level >= 3:
        for name, symbol in SYMBOLS.items():
            text = F.when(kind == name, F.lit(symbol)).otherwise(text)
    return F.lower(text) if level >= 4 else text


def merge_types(segments: Column) -> Column:
    """The first of each run of equal types; words without numbers are never merged."""
    return F.filter(segments, lambda s, i: (i == 0) | s["type"].isin(*WORDS) | (s["type"] != F.get(segments, i - 1)["type"]))


def merge_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t, i: (i == 0) | (t != F.get(tokens, i - 1)))


def readable(text: Column, tokenizer: str = "class", level: int = 5, normal: int = 4, merge: int = 0) -> Column:
    """Tokens of a text: tokenized, filtered, types merged (1 and 3), normalised, tokens merged (2 and 3)."""
    return finish(keep_level(typed(TOKENIZERS[tokenizer](text)), level), normal, merge)


def finish(segments: Column, normal: int = 4, merge: int = 0) -> Column:
    """Tokens of typed segments, merged and normalised."""
    if merge in (1, 3):
        segments = merge_types(segments)
    tokens = F.transform(segments, lambda s: normalized(s, normal))
    return merge_tokens(tokens) if merge >= 2 else tokens


def lower_words(text: Column) -> Column:
    """``readable`` at its default levels without typing each token: letter runs that touch no number, in lower case."""
    return F.filter(runs(F.lower(text), r"[\p{L}\p{N}]+"), lambda t: t.rlike(r"^\p{L}+\z"))


def tagged(tokens: Column, tags: int = 3) -> Column:
    """Sentence tags: <s> where ``tags`` is odd, </s> where it is over 1; an empty sentence stays empty."""
    parts = [*([F.array(F.lit("<s>"))] if tags % 2 else []), tokens, *([F.array(F.lit("</s>"))] if tags > 1 else [])]
    return F.when(F.size(tokens) > 0, F.concat(*parts)).otherwise(tokens)
