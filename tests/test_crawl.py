import gzip
import statistics

import pytest
from pyspark.sql import functions as F

from loomtext import session
from loomtext.functions import segments as S
from loomtext.operators import frontier, perplexity, series
from loomtext.sources import files
from loomtext.streaming import crawl


def test_buckets_and_costs(spark):
    rows = [(0.5, None, None), (400.0, 1, 4), (5000.0, 2, 8), (20000.0, 3, 102), (60000.0, 3, 127), (float("inf"), 3, 127), (None, 3, 127)]
    got = frontier.prioritize(spark.createDataFrame([(r[0],) for r in rows], "perp double")).collect()
    assert [(r.directive, r.cost) for r in got] == [r[1:] for r in rows]
    finite = frontier.prioritize(spark.createDataFrame([(float("nan"),), (9e9,)], "perp double"), (5.0, 50.0, 500.0)).collect()
    assert all(r.rejected for r in finite)


def test_chains_end_circle_and_resolve(spark):
    links = [("a", None, 5.0), ("b", "a", None), ("c", "b", None), ("d", "c", None), ("x", "y", None), ("y", "x", None), ("z", "gone", None), ("s", "s", None)]
    got = {r.uri: (r.source, r.perp) for r in frontier.nearest_scored(spark.createDataFrame(links, "uri string, via string, perp double")).collect()}
    assert got == {"a": ("a", 5.0), "b": ("a", 5.0), "c": ("a", 5.0), "d": ("a", 5.0), "x": (None, None), "y": (None, None), "z": (None, None), "s": (None, None)}


def test_series(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    got = series.numbered(df, ["id"], "v").orderBy("id").collect()
    assert [r.pos for r in got] == list(range(1, 101)) and got[-1].cum == sum(i % 7 for i in range(100))
    split = [r.split for r in series.linear_split(df, ["id"], 6).orderBy("id").collect()]
    assert split == [max(j for j in range(6) if int(j * 100 / 6) <= i) for i in range(100)]
    assert series.budget("1.5K") == 1500 and series.head_by_budget(df, ["id"], "v", 10).count() == 6


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\\tb\nline two\n")
    (tmp_path / "b.md").write_text("no\n")
    assert sorted(r.text for r in files.text_lines(spark, str(tmp_path), escaped=True).collect()) == ["a\tb", "line two"]
    assert {r.file: r.text for r in files.documents(spark, str(tmp_path)).collect()} == {"a.txt": "a\\tb\nline two\n", "b.md": "no\n"}
    table = spark.createDataFrame([("t1", "x\ny", "d"), ("t2", None, "d")], "ts string, sentence string, doc_id string")
    files.write_text(table, str(tmp_path / "out"), compression="gzip")
    assert sorted((r.ts, r.sentence) for r in files.document_sentences(spark, str(tmp_path / "out")).collect()) == [("t1", "x\\ny"), ("t2", "")]
    files.write_once(table, str(tmp_path / "once"))
    files.write_once(table.limit(1), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    (tmp_path / "seeds").write_text("# c\nexample.org\nhttps://b.org/\n")
    assert [r.uri for r in files.seeds(spark, str(tmp_path / "seeds")).collect()] == ["http://example.org", "https://b.org/"]


def test_arpa_round_trip(spark, tmp_path):
    rows = [(1, "a", -1.0, -0.5), (1, "b", -2.0, -0.25), (2, "a b", -0.125, None)]
    files.arpa_lines(spark.createDataFrame(rows, "n int, ngram string, log10p double, backoff double")).coalesce(1).write.text(str(tmp_path / "m"))
    assert sorted(map(tuple, files.read_arpa(spark, str(tmp_path / "m")).collect())) == rows


def test_registry(spark):
    S.register_tokenizer("comma", lambda c: F.split(c, ","))
    assert spark.range(1).select(S.readable(F.lit("a,B"), "comma").alias("t")).first().t == ["a", "b"]


def drain(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(once=True).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        assert q.awaitTermination(25), q.status
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


@pytest.fixture
def stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, "http://x.org/1"), ("a", 3.0, "http://x.org/2"), ("b", 2.0, "http://y.org/1")], "k string, perp double, url string").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k string, perp double, url string").parquet(str(tmp_path / "in"))


def test_streams(stream, tmp_path):
    assert len(drain(crawl.priorities(stream), "append", tmp_path, "prio")) == 3
    last = {r.key: (r.n, r.low, r.high, r.mean, sorted(r["last"])) for r in drain(crawl.last_values(stream, "k", "perp"), "update", tmp_path, "last")}
    assert last == {"a": (2, 1.0, 3.0, 2.0, [1.0, 3.0]), "b": (1, 2.0, 2.0, 2.0, [2.0])}
    assert sorted(r.domain for r in drain(crawl.new_domains(stream), "append", tmp_path, "dom")) == ["x.org", "y.org"]
    counts = drain(crawl.ngram_counts(stream.selectExpr("k as text"), range(1, 2)), "complete", tmp_path, "grams")
    assert {r.ngram: r.cnt for r in counts}["a"] == 2


def test_schedule(spark):
    rows = [("seed", None, None, True, False, False), ("a", "seed", None, False, False, False), ("b", "a", None, False, False, False), ("c", "b", 600.0, False, False, True), ("d", "c", None, False, False, True), ("e", "d", None, False, False, False), ("robots", "e", None, False, True, False), ("f", "robots", None, False, False, False), ("lost", "gone", None, False, False, False)]
    links = spark.createDataFrame(rows, "uri string, via string, perp double, is_seed boolean, is_robots boolean, is_prerequisite boolean")
    got = {r.uri: (r.perp_via, r.directive, r.cost, r.rejected) for r in frontier.schedule(links).collect()}
    assert got["seed"] == (2.0, 1, 4, False) and got["a"] == (3.0, 1, 3, False) and got["b"] == (4.0, 1, 2, False)
    assert got["c"] == (5.0, 0, 1, False) and got["d"] == (600.0, 1, 8, False) and got["e"] == (600.0, 2, 7, False)
    assert got["robots"] == (600.0, 2, 6, False) and got["f"][0] == 49_999.0 and got["f"][1:3] == (3, 126) and got["lost"] == (None, None, None, True)


def test_crawl_rules(spark):
    r = spark.range(1).select(
        frontier.halved(F.lit(9), F.lit(True)).alias("a"), frontier.halved(F.lit(9), F.lit(False)).alias("b"), frontier.fetched(F.lit(206), F.lit(1), F.lit(True)).alias("c"), frontier.fetched(F.lit(404), F.lit(1), F.lit(True)).alias("d"),
        frontier.content_kind(F.lit("http://a/robots.txt"), F.lit(None)).alias("e"), frontier.content_kind(F.lit("http://a/x.PDF"), F.lit(None)).alias("f"), frontier.content_kind(F.lit("http://a/x.pdf"), F.lit("text/html")).alias("g"), frontier.content_kind(F.lit("http://a/x.png"), F.lit(None)).alias("h"),
        perplexity.below(F.lit("12.5")).alias("i"), perplexity.below(F.lit("Infinity")).alias("j"), perplexity.below(F.lit("x")).alias("k"), perplexity.padded(F.lit(12.5)).alias("l"), perplexity.padded(F.lit(0.5)).alias("m"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k) == (4, 9, True, False, "robots", "pdf", "html", "other", True, False, False)
    assert len(r.l) == 12 and float(r.l) == 12.5 and float(r.m) == -1


def test_crawl_perplexity_leaves_short_sentences_out(spark):
    scores = spark.createDataFrame([(1, 1, 0, "a b c", -1.0, False), (1, 1, 1, "b c d", -2.0, False), (1, 2, 0, "x y", -9.0, False)], "doc_id long, sent int, pos int, ngram string, log10p double, oov_last boolean")
    got = perplexity.crawl_perplexity(scores, "doc_id").first()
    assert got.num_ngrams == 2 and got.log10p == -3.0


@pytest.mark.parametrize("block", [65_536, 7, 3])
def test_sliding_windows_in_blocks(spark, block):
    """A key that holds most rows gives the same in blocks of any size."""
    rows = [(i, "hot" if i % 5 else "cold", float(i * 37 % 101)) for i in range(200)]
    df, window = series.sliding(spark.createDataFrame(rows, "i long, k string, v double"), "k", ["i"], 4, 2, block)
    got = {r.i: (r.med, r.low) for r in series.finish(df.withColumns({"med": series.centred_median(F.col("v"), window), "low": F.min("v").over(window)})).collect()}
    assert len(got) == 200
    for k in ("hot", "cold"):
        own = [(i, v) for i, g, v in rows if g == k]
        for at, (i, _) in enumerate(own):
            frame = [v for _, v in own[max(0, at - 4) : at + 3]]
            assert got[i] == (statistics.median(frame), min(frame))


def test_more_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\\tx\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("three\n")
    (tmp_path / "c.md").write_text("no\n")
    assert sorted(tuple(r) for r in files.numbered_lines(spark, str(tmp_path)).collect()) == [("a.txt:1", "one"), ("a.txt:2", "two\tx"), ("b.txt.gz:1", "three")]
    assert sorted(r.text for r in files.text_lines(spark, str(tmp_path)).collect()) == ["one", "three", "two\\tx"]
    (tmp_path / "grams").write_text("a b c\nd\n")
    assert sorted(tuple(r) for r in files.ngram_lines(spark, str(tmp_path / "grams")).collect()) == [("a b c", 3), ("d", 1)]
    (tmp_path / "counts").write_text("a b\t3\n")
    assert tuple(files.counted(spark, str(tmp_path / "counts")).first()) == ("a b", 3, 2)
    (tmp_path / "scored").write_text("x\t2\t1\t-3.0\t31.6\t-1.0\t10.0\n")
    assert tuple(files.scored_lines(spark, str(tmp_path / "scored")).first()) == ("x", 2, 1, -3.0, 31.6, -1.0, 10.0)
    (tmp_path / "log").write_text("1\t2.5\t01\t004\thttp://a\tn\n2\t3.5\t01\t004\thttp://b\tn\n")
    assert files.priority_log(spark, str(tmp_path / "log")).count() == 2 and files.priority_log(spark, str(tmp_path / "log"), 1).count() == 1
    (tmp_path / "crawl").write_text('t0 200 5 http://a/ L http://b/ text/html {"perp": "7.5", "perp_via": "9"}\n')
    assert tuple(files.crawl_log(spark, str(tmp_path / "crawl")).first()) == ("t0", "http://a/", "http://b/", 7.5, 9.0)
    table = spark.range(3000).select(F.lit("t").alias("ts"), F.repeat(F.lit("word "), 200).alias("sentence"), F.lit("u").alias("url"), F.col("id").alias("idx")).coalesce(1)
    files.write_sentences(table, str(tmp_path / "out"), megabytes=1)
    assert len(list((tmp_path / "out").glob("part-*.gz"))) == 3 and spark.read.text(str(tmp_path / "out")).count() == 3000
    files.write_splits(spark.createDataFrame([(0, "a"), (11, "b")], "k int, t string"), str(tmp_path / "splits"), "k")
    assert {p.name for p in (tmp_path / "splits").iterdir() if p.is_dir()} == {"file=prefix_00.txt", "file=prefix_11.txt"}
    indexed = spark.createDataFrame([(1, "a", 2), (2, "a b", 1)], "n int, ngram string, cnt long")
    files.write_index(indexed, str(tmp_path / "index"))
    assert files.read_index(spark, str(tmp_path / "index")).where("n = 2").first().ngram == "a b"


def test_shared_folder_and_stored_rows(spark, monkeypatch):
    rows = session.stored(spark.range(10))
    assert rows.count() == 10 and "parquet" in rows.inputFiles()[0]
    assert session.shared_folder(spark)
    monkeypatch.setattr(session, "tempfile", None)  # a session that names a folder needs no other

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session)
