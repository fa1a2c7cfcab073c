"""Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names, empty tables."""

import pytest
from pyspark.sql import functions as F

from loomtext.llm import chats, contamination, languages, licenses, packing, perplexity, rules, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, group_id string, text_hash string, __id string, __ranges string, __key string, __hits string, `a.b` string, attributes map<string,string>"
LONG = " ".join(f"word{i % 9973} the of" for i in range(70_000))
TEXTS = [(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (2, "the cat sat on the mat", None), (None, "the cat sat on the mat", "en"), (3, None, "en"), (4, "", "de"), (5, " \n\t!!", "de"), (6, LONG, "en"), (7, LONG, "en"), (None, None, None), (8, "Ünïcödé 𝒳 \x00 nul", "xx")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, None, len(t) if t else None, *["x"] * 8, {"k": "v"}) for i, t, g in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 1, 0), (4, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 0), (6, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, "a"), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


REPORTS = {
    "rules": lambda d, x, b: rules.apply_rules(d, x),
    "languages": lambda d, x, b: languages.identify(d),
    "quality": lambda d, x, b: perplexity.quality(d, x),
    "licences": lambda d, x, b: licenses.licences(d),
    "contamination": lambda d, x, b: contamination.contamination(d, b),
    "contamination_sliced": lambda d, x, b: contamination.contamination(d, b, slice_ngrams=2),
    "substrings": lambda d, x, b: substrings.repeats(d),
    "toxicity": lambda d, x, b: toxicity.toxicity(d, x),
}
FILTERS = {
    "toxicity": lambda d, x, b: toxicity.drop_toxic(d, x),
    "simhash": lambda d, x, b: simhash.drop_near_duplicates(d),
    "substrings": lambda d, x, b: substrings.drop_repeats(d),
    "contamination": lambda d, x, b: contamination.decontaminate(d, b),
    "contamination_sliced": lambda d, x, b: contamination.decontaminate(d, b, slice_ngrams=2),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_have_a_row_for_every_row(docs, labels, benchmark, name):
    got = REPORTS[name](docs, labels, benchmark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in TEXTS)
    empty = REPORTS[name](docs.limit(0), labels.limit(0), benchmark.limit(0))
    assert empty.collect() == []
    assert len(REPORTS[name](docs, labels.limit(0), benchmark.limit(0)).collect()) == len(TEXTS)


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(docs, labels, benchmark, name):
    out = FILTERS[name](docs, labels, benchmark)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    left = out.select("doc_id", "text", "keep").collect()
    assert len(left) <= len(TEXTS) and all(r.keep == "x" for r in left)
    ids = [r.doc_id for r in left]
    assert 3 in ids and 4 in ids and 5 in ids
    if name == "simhash":
        assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2 and 6 in ids and 7 not in ids
    if name.startswith("contamination"):
        assert 1 not in ids and 2 not in ids and 6 in ids
    assert FILTERS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).collect() == []


def test_groups_and_packing(docs):
    groups = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    assert set(groups) == {1, 2, 3, 4, 5, 6, 7, 8} and groups[2].group_id == 1 and groups[2].group_size == 2 and groups[7].group_id == 6 and groups[3].keep
    assert simhash.near_groups(docs.limit(0)).collect() == [] and packing.pack(docs.limit(0)).collect() == []
    pieces = packing.pack(docs).collect()
    assert sum(r.n_tokens for r in pieces if r.doc_id == 6) == 210_000 and sum(r.doc_id == 1 for r in pieces) == 2
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in pieces) and sum(r.bin_id is None for r in pieces) == 3
    assert "".join(r.text for r in sorted((r for r in pieces if r.doc_id == 6), key=lambda r: r.piece)) == LONG
    assert {r.text for r in pieces if r.doc_id == 5} == {" \n\t!!"}


def test_texts_under_one_id_are_judged_apart(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "red green blue yellow black white brown orange"]
    rows = [(1, texts[0], 1), (1, texts[1], 2), (2, texts[1], 3), (3, texts[2], 4), (3, texts[2], 5), (0, texts[2], 6), (4, texts[0], 7), (None, texts[0], 8), (None, texts[0], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r int").withColumn("m", F.create_map(F.lit("a"), F.col("r")))
    left = sorted(r.r for r in simhash.drop_near_duplicates(docs).collect())
    assert left == [1, 2, 6, 8, 9]
    found = sorted((r.doc_id, r.group_id, r.group_size, r.keep) for r in simhash.near_groups(docs).collect())
    assert found == [(0, 0, 2, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (3, 0, 2, False), (4, 1, 2, False)]


def test_pipeline_on_edges(spark, docs, labels, benchmark, tmp_path):
    import corpus_pipeline

    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns and dict(rows.dtypes) == dict(docs.dtypes)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {3, 4, 5, 6, 8, None} <= {r.doc_id for r in pieces} and not {1, 2, 7} & {r.doc_id for r in pieces}
    empty = str(tmp_path / "empty")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_chats(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 0, "user", "hi", 9), (1, None, "assistant", "late", 9), (1, 1, None, "no role", 9), (1, 2, "human", None, 9), (None, 0, "user", "x", 9), (None, 0, "user", "x", 9), (2, 0, "GPT", "", 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns long")
    found = chats.format_turn_rows(table).collect()
    got = {r.conv_id: r for r in found}
    assert got["1"].chat == "<|user|>\nhi\n<|end|>\n<|user|>\nno role\n<|end|>\n<|assistant|>\nlate\n<|end|>\n" and got["1"].n_turns == 3
    assert got["2"].n_turns == 0 and set(got) == {"1", "2", None}
    assert [r.chat for r in found if r.conv_id is None] == ["<|user|>\nx\n<|end|>\n"] * 2
    assert chats.format_turn_rows(table.limit(0)).collect() == [] and chats.mixed_records(table.limit(0)).collect() == []
    broken = spark.createDataFrame([("a", None), ("b", "{"), ("c", "[1]"), ("d", '{"x": 1}'), (None, '{"prompt": "p", "response": "r", "turns": []}')], "record_id string, payload string")
    assert [r.layout for r in chats.format_records(broken).collect()] == ["invalid", "invalid", "invalid", "unknown", "prompt_response"]


def test_records_without_ids_stay_apart_and_fields_dont_split_chats(spark):
    payloads = ['{"prompt": "p1", "response": "r1"}', '{"prompt": "p2", "response": "r2"}']
    turns = ['{"conv_id": 7, "turn": "2", "role": "assistant", "text": "b"}', '{"conv_id": 7, "turn": 1, "role": "user", "text": "a", "extra": 1}', '{"conv_id": 7, "turn": 10, "role": "user", "text": "c"}', '{"conv_id": 7, "turn": 5000, "role": "user", "text": "far"}']
    table = spark.createDataFrame([(None, p) for p in payloads + turns], "record_id string, payload string")
    got = sorted((r.conv_id or "", r.part, r.n_turns, r.chat.replace("\n", "")) for r in chats.gather(chats.format_records(table)).collect())
    assert got == [
        ("", 0, 2, "<|user|>p1<|end|><|assistant|>r1<|end|>"), ("", 0, 2, "<|user|>p2<|end|><|assistant|>r2<|end|>"),
        ("7", 0, 3, "<|user|>a<|end|><|assistant|>b<|end|><|user|>c<|end|>"), ("7", 1, 1, "<|user|>far<|end|>"),
    ]


def test_every_layout_by_mixing(spark, sf_dir):
    records = chats.mixed_records(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/conversations.parquet"))
    found = chats.format_records(records)
    assert {r.layout for r in found.select("layout").distinct().collect()} == {"turn_rows", "messages", "conversations", "dialogue", "message_parts", "instruction"}
    assert found.select("fingerprint").distinct().count() >= 7


def test_long_texts_of_many_letters_and_tags():
    rng = __import__("random").Random(1)
    cjk = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(700_000))
    names, top, _ = languages.classify([cjk, "plain words"], {"a": languages.bundles(["plain words here"], [0], 1)[0], "b": languages.bundles([cjk[:1000]], [0], 1)[0]})
    assert names == ["b", "a"] and 0 < top[0] <= 1
    assert licenses.judge("SPDX-License-Identifier: " + " AND ".join(["MIT"] * 20_000) + "\n" + "all rights reserved " * 20_000)[2] == "deny"
