"""Licence scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser evaluates expressions.

One pass of the automaton over the lower-cased text, in which a run of white space and marks that lead
comment lines are one space, finds notice phrases, each of which names a licence
identifier, and tags, after which the rest of the line is read as an expression of identifiers with
AND, OR and WITH (binding in the order WITH, AND, OR) and parentheses. All findings of a document
must be allowed together, so they are joined by AND. Evaluation has three values: an identifier is
allowed, denied or unknown to the policy; OR takes the best of its sides and AND the worst; WITH an
exception that the policy lists allows a licence that it lists for the exception. An expression that doesn't parse is unknown.

The pass is narrow: one read of the text, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import spans
from loomtext.session import read

TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:", "@license", "license:", "licence:")
NOTICES = {
    "released under the mit license": "MIT",
    "licensed under the mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "licensed under the apache license, version 2.0": "Apache-2.0",
    "released under the apache license, version 2.0": "Apache-2.0",
    "licensed under the bsd 2-clause license": "BSD-2-Clause",
    "licensed under the bsd 3-clause license": "BSD-3-Clause",
    "redistribution and use in source and binary forms, with or without modification": "BSD-3-Clause",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "ISC",
    "licensed under the isc license": "ISC",
    "subject to the terms of the mozilla public license, v. 2.0": "MPL-2.0",
    "licensed under the mozilla public license, version 2.0": "MPL-2.0",
    "licensed under the gnu general public license, version 2": "GPL-2.0-only",
    "licensed under the gnu general public license, version 3": "GPL-3.0-only",
    "licensed under the gnu lesser general public license, version 2.1": "LGPL-2.1-only",
    "licensed under the gnu lesser general public license, version 3": "LGPL-3.0-only",
    "licensed under the gnu affero general public license, version 3": "AGPL-3.0-only",
    "under the terms of the gnu general public license": "GPL-2.0-or-later",
    "licensed under cc0 1.0": "CC0-1.0",
    "dedicated to the public domain": "CC0-1.0",
    "licensed under cc by 4.0": "CC-BY-4.0",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4.0",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4.0",
    "licensed under cc by-nd 4.0": "CC-BY-ND-4.0",
    "licensed under cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0",
    "creative commons attribution 4.0 international": "CC-BY-4.0",
    "creative commons attribution-noncommercial 4.0 international": "CC-BY-NC-4.0",
    "all rights reserved": "LicenseRef-All-Rights-Reserved",
}
ALLOWED = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc zlib unlicense 0bsd bsl-1.0 cc0-1.0 cc-by-3.0 cc-by-4.0 python-2.0 mpl-2.0".split())
DENIED = frozenset("gpl-1.0-only gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 licenseref-all-rights-reserved".split())
#: Exceptions that make a licence acceptable, and the licences (by how they begin) that they may stand on.
EXCEPTIONS = {
    "classpath-exception-2.0": ("gpl-2.0", "gpl-3.0"),
    "gcc-exception-3.1": ("gpl-3.0",),
    "llvm-exception": ("apache-2.0",),
    "linux-syscall-note": ("gpl-2.0",),
    "autoconf-exception-3.0": ("gpl-3.0",),
    "bison-exception-2.2": ("gpl-2.0", "gpl-3.0"),
    "font-exception-2.0": ("gpl-2.0", "gpl-3.0"),
}
DENY, UNKNOWN, ALLOW = range(3)
VERDICTS = ("deny", "unknown", "allow")
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.+:-]*)", re.I)
_SPACE = str.maketrans({c: " " for c in "\n\r\t\f\v "})
_GAP = re.compile(r"\s*[\n\r](?:\s*(?:/\*+|\*+/?|//+!?|#+|;+|--+|%+|>+|<!--|\(\*|rem(?=\s)|dnl(?=\s)))*\s*|\s{2,}")
_LINE_END = re.compile("[\n\r]")
_REPORT = "doc_id long, licences array<string>, expressions array<string>, verdict string, keep boolean"


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, operators in lower case; None where it doesn't parse."""
    out: list[str] = []
    waiting: list[str] = []
    operand, at = True, 0
    text = expression.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at, token = m.end(), m.group(1)
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif low in _BINDS:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str, allowed: frozenset = ALLOWED, denied: frozenset = DENIED, exceptions: dict[str, tuple[str, ...]] = EXCEPTIONS) -> int:
    """DENY, UNKNOWN or ALLOW."""
    order = postfix(expression)
    if order is None:
        return UNKNOWN
    stack: list[tuple[int, str]] = []
    for token in order:
        if token in _BINDS:
            (right, name), (left, base) = stack.pop(), stack.pop()
            if token == "with":
                value = ALLOW if base and base.startswith(exceptions.get(name, ())) else left
            else:
                value = max(left, right) if token == "or" else min(left, right)
            stack.append((value, ""))
        else:
            low = token.lower()
            base = low[:-1] if low.endswith("+") else low
            stack.append((ALLOW if base in allowed else DENY if base in denied else UNKNOWN, low))
    return stack[0][0]


def identifiers(expression: str) -> list[str]:
    """Licence identifiers of an expression, exceptions apart; nothing where it doesn't parse."""
    order, stack, out = postfix(expression) or [], [], []
    for token in order:
        if token in _BINDS:
            right = stack.pop()
            stack[-1].extend([] if token == "with" else right)
        else:
            stack.append([token])
    for name in stack[0] if stack else out:
        out.append(name)
    return out


@lru_cache(1)
def _automaton():
    a = ahocorasick.Automaton()
    for tag in TAGS:
        a.add_word(tag, (tag, None))
    for phrase, name in NOTICES.items():
        a.add_word(phrase, (phrase, name))
    a.make_automaton()
    return a


def _flat(low: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with runs of white space, and marks that lead comment lines, as one space; from which places on how many characters are gone."""
    parts, at, gone, done, size = [], [0], [0], 0, 0
    for m in _GAP.finditer(low):
        if m.end() - m.start() > 1:
            parts += [low[done : m.start()], " "]
            size += m.start() - done + 1
            done = m.end()
            at.append(size)
            gone.append(done - size)
    parts.append(low[done:])
    return "".join(parts).translate(_SPACE), np.array(at), np.array(gone)


def _outermost(found: list[tuple]) -> list[tuple]:
    """Findings (begin, end, ...) by place, without those that lie inside a longer one."""
    out, reach = [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[1] > reach:
            reach = x[1]
            out.append(x)
    return out


def scan(text: str) -> tuple[list[str], list[str]]:
    """Identifiers of notices, and expressions after tags, each in order of their places, repeats apart.

    An expression ends with its line, or where the next tag begins.
    """
    low = text.lower()
    flat, at, gone = _flat(low)
    source = text if len(low) == len(text) else low
    notices: list[tuple] = []
    tags: list[tuple] = []
    for last, (phrase, name) in _automaton().iter(flat):
        begin, end = last - len(phrase) + 1, last + 1
        if begin and flat[begin - 1].isalnum():
            continue
        if name is None:
            tags.append((begin, end))
        elif end == len(flat) or not flat[end].isalnum():
            notices.append((begin, end, name))
    tags, found = _outermost(tags), []
    if tags:
        begin, end = (np.array(x) for x in zip(*tags))
        begin, end = (x + gone[np.searchsorted(at, x, "right") - 1] for x in (begin, end))
        for place, most in zip(end.tolist(), [*begin[1:].tolist(), len(source)]):
            stop = _LINE_END.search(source, place, most)
            rest = source[place : stop.start() if stop else most].strip().rstrip("*/#->;,. \t")
            if rest:
                found.append(rest)
    return list(dict.fromkeys(n for _, _, n in _outermost(notices))), list(dict.fromkeys(found))


def judge(text: str, allowed: frozenset = ALLOWED, denied: frozenset = DENIED, exceptions: dict[str, tuple[str, ...]] = EXCEPTIONS) -> tuple[list[str], list[str], str, bool]:
    """(licences, expressions, verdict, keep) of a text."""
    notices, expressions = scan(text)
    if not notices and not expressions:
        return [], [], "none", True
    values = [evaluate(x, allowed, denied, exceptions) for x in [*notices, *expressions]]
    names = sorted({*notices, *(n for x in expressions for n in identifiers(x))})
    return names, expressions, VERDICTS[min(values)], min(values) != DENY


def _scan(allowed: frozenset, denied: frozenset, exceptions: dict, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in spans.slices(it):
        names, found, verdict, keep = zip(*(judge(t, allowed, denied, exceptions) for t in texts))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.list_(pa.string())), pa.array(found, pa.list_(pa.string())), pa.array(verdict, pa.string()), pa.array(keep, pa.bool_())], ["doc_id", "licences", "expressions", "verdict", "keep"])


def licences(docs: DataFrame, allowed: frozenset = ALLOWED, denied: frozenset = DENIED, exceptions: dict[str, tuple[str, ...]] = EXCEPTIONS) -> DataFrame:
    """doc_id, licences, expressions, verdict (allow, deny, unknown or none) and keep (not denied), for every row.

    Defined cases: a null or empty text, or one without tag and notice, has the verdict none and is kept;
    an expression that doesn't parse is listed, names no licence and is unknown; repeated findings
    count once; of findings one inside the other the longer counts; repeated rows and rows without doc_id are treated
    like others; a text of any length is read whole, in time that grows with its length; an empty table gives an
    empty result. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_scan, allowed, denied, exceptions), _REPORT)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(read(spark, sf_dir, "documents"))
