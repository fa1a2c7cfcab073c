"""Cleaning, escaping and formatting of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Controls but tab to carriage return, the byte order mark, the replacement character, and private use.
_ODD = "".join(map(chr, [*range(0, 9), *range(14, 32), *range(127, 160), 0xFEFF, 0xFFFD, *range(0xE000, 0xE020), *range(0xF0A0, 0xF0C0), *range(0x2160, 0x2170)]))
MARK = "¿"


def clean_min(text: Column) -> Column:
    """Byte order marks and replacement characters become inverted question marks."""
    return F.translate(text, "﻿�", MARK * 2)


def clean_ext(text: Column) -> Column:
    """As ``clean_min``, and controls, Roman numeral signs, private characters and pictographs too."""
    return F.regexp_replace(F.translate(text, _ODD, MARK * len(_ODD)), r"[\x{1F000}-\x{1F7FF}]", MARK + "?")


def abbreviate(text: Column, width: int = 50) -> Column:
    """White space collapsed, after cutting to ``width`` with an ellipsis."""
    short = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
    return F.regexp_replace(short, r"\s+", " ")


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")


def squeeze_blanks(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(text, r"[\s\x{A0}]+", by)


def escape_line(text: Column) -> Column:
    """A text as one line: tabs and line feeds written as backslash letters, carriage returns left out."""
    return F.replace(F.replace(F.replace(text, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))


def unescape_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))


def escape_non_ascii(text: str) -> str:
    return "".join(c if ord(c) < 128 else f"\\u{ord(c):04x}" for c in text)


def unescape_unicode(text: str) -> str:
    """Backslash-u, -n, -r, -t and -f escapes of rule files."""
    return text.encode("ascii", "backslashreplace").decode("unicode_escape") if "\\" in text else text


def strip_html(html: Column) -> Column:
    """Visible text by pattern: scripts, styles and comments go, paragraph ends and breaks become lines, other tags blanks, the five common entities are resolved."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title.*?</title>", " ")
    text = F.regexp_replace(text, r"[\n\r]", " ")
    text = F.regexp_replace(text, r"(?i)</p>|<br\s*/?>|</h[1-6]>|</li>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n+", "\n"))


def host(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^[a-zA-Z][\w+\-]+:.*"), url).otherwise(F.concat(F.lit("http://"), url))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def digits_time(ts: Column) -> Column:
    """Seventeen digits, down to milliseconds."""
    return F.date_format(ts, "yyyyMMddHHmmssSSS")


#: Charsets that are decoded, by how declarations call them.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "windows-1252": "windows-1252", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
UNDECODABLE = "charset not known"


def decode(data: Column, charset: Column) -> Column:
    """Bytes as text: by their byte order mark, else in the declared charset, else as UTF-8; what UTF-8 doesn't allow becomes
    replacement characters, and an unknown charset ``UNDECODABLE``."""
    name = F.lower(F.trim(charset))
    head = F.hex(F.substring(data, 1, 3))
    utf8 = F.make_valid_utf8(data.cast("string"))
    out = F.when(data.isNull(), F.lit(None).cast("string")).when(head == "EFBBBF", F.make_valid_utf8(F.substring(data, 4, 2147483647).cast("string")))
    out = out.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(data, "UTF-16"))
    out = out.when(name.isNull() | name.isin("utf-8", "utf8", "us-ascii", ""), utf8)
    for declared, charset_name in CHARSETS.items():
        if charset_name != "UTF-8":
            out = out.when(name == declared, F.decode(data, charset_name))
    return out.otherwise(F.lit(UNDECODABLE))


def declared_charset(html: Column) -> Column:
    """The charset that a page declares in its head, or null."""
    found = F.regexp_extract(html, r"(?i)<meta[^>]*charset=[\"']?([\w-]+)", 1)
    return F.when(found != "", F.lower(found))


def engineering(x: Column) -> Column:
    """A number with up to nine digits and an exponent that is a multiple of three; none for an exponent of 0."""
    exponent = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)) / 3) * 3).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x / F.pow(F.lit(10.0), exponent)), r"0+$", ""), r"\.$", "")
    return F.when(exponent == 0, digits).otherwise(F.concat(digits, F.lit("E"), F.when(exponent < 0, F.format_string("-%02d", -exponent)).otherwise(F.format_string("%02d", exponent))))


def show_blanks(text: Column) -> Column:
    """White space written as letters after a backslash."""
    for char, letter in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f")):
        text = F.replace(text, F.lit(char), F.lit(letter))
    return text


def in_ranges(x: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a number lies in one of some closed ranges."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | x.between(low, high)
    return out
