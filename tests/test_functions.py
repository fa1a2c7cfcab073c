from pyspark.sql import functions as F

from loomtext.functions import hashes as M
from loomtext.functions import ngrams as N
from loomtext.functions import segments as S
from loomtext.functions import text as X
from loomtext.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_types(spark):
    words = {"hello": "WORD_LOWERCASE", "Hello": "WORD", "HELLO": "WORD_UPPERCASE", "w0rd": "WORD_WITH_NUMBER", "42": "NUMBER", "!?": "PUNCTUATION", " \n": "EMPTY_SPACE", "$+": "NON_WORD", "3.5": "NON_WORD", "end.": "UNKNOWN"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.type_of(F.col("w")).alias("t")).collect()
    assert {r.w: r.t for r in got} == words


def test_levels_and_normalisation(spark):
    text = F.lit("Ab  c3 -- 42 $$ x!")
    r = one(spark, l2=S.readable(text, level=2, normal=0), l3=S.readable(text, level=3, normal=3), l5=S.readable(text, level=5, normal=4), n1=S.readable(text, level=1, normal=1))
    assert r.l2 == ["Ab", "c3", "--", "42", "$$", "x", "!"]
    assert r.l3 == ["Ab", "c0", ".", "0", "x", "."]
    assert r.l5 == ["ab", "x"]
    assert "$" in r.n1 and "$$" not in r.n1


def test_merging(spark):
    tokens = F.array(*map(F.lit, ["a", "a", "1", "2", ".", "!", "b", "b"]))
    r = one(spark, t=F.transform(S.merge_types(S.typed(tokens)), lambda s: s["text"]), k=S.merge_tokens(tokens))
    assert r.t == ["a", "a", "1", ".", "b", "b"]
    assert r.k == ["a", "1", "2", ".", "!", "b"]


def test_tags(spark):
    t = F.array(F.lit("a"))
    r = one(spark, a=S.tagged(t, 0), b=S.tagged(t, 1), c=S.tagged(t, 2), d=S.tagged(t, 3), e=S.tagged(F.expr("cast(array() as array<string>)"), 3))
    assert (r.a, r.b, r.c, r.d, r.e) == (["a"], ["<s>", "a"], ["a", "</s>"], ["<s>", "a", "</s>"], [])


def test_boundary_modes(spark):
    t = F.array(*map(F.lit, "abcd"))
    s = F.array(F.lit("a"), F.lit("b"))
    r = one(spark, a=N.keys(t, 3, -1), b=N.keys(t, 3, 0), c=N.keys(t, 3, 1), d=N.keys(t, 3, 2), e=N.keys(s, 3, -1), f=N.keys(s, 3, 0), g=N.keys(t, 1, 2), h=N.keys(s, 5, 0))
    assert r.a == r.b == ["a b c", "b c d"]
    assert r.c == ["a a b", "a b c", "b c d"]
    assert r.d == ["a b", "a b c", "b c d"]
    assert (r.e, r.f, r.h) == ([], ["a b"], ["a b"])
    assert r.g == ["a", "b", "c"]


def test_cardinalities():
    assert (list(N.cardinalities("1-3")), list(N.cardinalities("-2")), list(N.cardinalities("4"))) == ([1, 2, 3], [1, 2], [4])


def test_text(spark):
    r = one(spark, a=X.abbreviate(F.lit("x" * 60)), b=X.unescape_line(X.escape_line(F.lit("a\tb\r\nc"))), c=X.clean_min(F.lit("﻿a�")), d=X.with_scheme(F.lit("a.b/c")), e=X.domain(F.lit("https://m.a.example.org/x")), f=X.strip_html(F.lit("<p>a&amp;b</p><script>x</script>c<br>d")), g=X.clean_ext(F.lit("a\U0001f600")))
    assert len(r.a) == 50 and r.a.endswith("...")
    assert (r.b, r.c, r.d, r.e, r.f, r.g) == ("a\tb\nc", "¿a¿", "http://a.b/c", "example.org", "a&b\nc\nd", "a¿?")
    assert X.unescape_unicode("\\u0041b") == "Ab" and X.escape_non_ascii("ä") == "\\u00e4"


def test_vectors(spark):
    a, b = F.array(*map(F.lit, [3.0, 4.0])), F.array(*map(F.lit, [4.0, 3.0]))
    r = one(spark, n=V.norm(a), c=V.cosine(a, b), e=V.euclid(a, b), k=V.symmetric_kl(a, b), s=V.argsort(F.array(*map(F.lit, [2.0, 1.0, 3.0]))), m=V.argmax(a), z=V.cosine(a, F.array(F.lit(0.0))), h=V.sha256_int(F.lit("abc")))
    assert r.n == 5 and round(r.c, 6) == 0.96 and round(r.e, 6) == 1.414214 and r.k > 0 and r.s == [1, 0, 2] and r.m == 1 and r.z is None
    assert r.h == 0xBA7816BF


def test_murmur3_known_values(spark):
    fox = "The quick brown fox jumps over the lazy dog"
    known = {"": 0, "hello": 0x248BFA47, "hello, world": 0x149BBB7F, fox: 0x2E4FF723}
    assert M.murmur3_32([t.encode() for t in known], 0).tolist() == list(known.values())
    assert M.murmur3_32([b""], 42).tolist() == [0x087FCD5C]
    assert "".join(f"{int(x):016x}" for x in M.murmur3_128([fox.encode()], 0)[0]) == "e34bbc7bbc071b6c7a433ca9c49a9347"
    table = spark.createDataFrame([("hello",), (None,), ("aé",), ("x" * 33,)], "t string")
    got = table.select("t", M.murmur3(F.col("t"), 0).alias("h"), M.murmur3_hex(F.col("t"), 0).alias("x"), F.hash("t").alias("built_in"), M.murmur3(F.col("t")).alias("own")).collect()
    assert got[0].h == 0x248BFA47 and got[1].h is None and got[1].x is None and len(got[3].x) == 32
    # the built-in hash differs in the tail only: four bytes have none
    four = spark.createDataFrame([("abcd",), ("abcdefgh",)], "t string").select(F.hash("t").alias("a"), M.murmur3(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in four) and got[0].built_in != got[0].own


def test_charsets(spark):
    rows = [("é".encode(), None, "é"), ("é".encode(), "UTF-8", "é"), ("é".encode("latin-1"), "ISO-8859-1", "é"), (b"\xef\xbb\xbfx", "latin1", "x"), ("aé".encode("utf-16"), "utf-8", "aé"), (b"a\xff", "utf-8", "a\ufffd"), (b"a", "klingon", X.UNDECODABLE), (None, "utf-8", None), (b"", None, "")]
    got = spark.createDataFrame([r[:2] for r in rows], "b binary, c string").select(X.decode(F.col("b"), F.col("c")).alias("t")).collect()
    assert [r.t for r in got] == [r[2] for r in rows]
    r = one(spark, a=X.declared_charset(F.lit('<meta charset="ISO-8859-1">')), b=X.declared_charset(F.lit("<meta http-equiv=x content='text/html; charset=utf-8'>")), c=X.declared_charset(F.lit("<p>")))
    assert (r.a, r.b, r.c) == ("iso-8859-1", "utf-8", None)


def test_numbers_and_blanks(spark):
    r = one(spark, a=X.engineering(F.lit(12345.0)), b=X.engineering(F.lit(0.00012)), c=X.engineering(F.lit(7.5)), d=X.engineering(F.lit(0.0)), e=X.show_blanks(F.lit("a\tb\n")), f=X.in_ranges(F.lit(5), [(1, 2), (5, 9)]), g=X.in_ranges(F.lit(3), [(1, 2), (5, 9)]))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("12.345E03", "120E-06", "7.5", "0", "a\\tb\\n", True, False)
