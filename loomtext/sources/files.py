"""Text files, n-gram files and language-model files as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as X

SCORED = "text string, num_ngrams int, num_oov int, log10p double, perp double, log10p_noov double, perp_noov double"
PRIORITY_LOG = "ts long, perp string, directive string, precedence string, uri string, note string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """file and text, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, path: str, pattern: str = "*.txt{,.gz}", escaped: bool = False) -> DataFrame:
    """file and text, one row a line of the folder's files, zipped ones too."""
    value = X.unescape_line(F.col("value")) if escaped else F.col("value")
    return spark.read.option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_name").alias("file"), value.alias("text"))


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*.txt{,.gz}", escaped: bool = True) -> DataFrame:
    """doc_id, the file's name, a colon and the line's number from 1, and text. A file is read whole by one task, which numbers its lines."""
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    each = rows.select(F.col("_metadata.file_name").alias("file"), F.posexplode(lines).alias("pos", "line"))
    return each.select(F.concat("file", F.lit(":"), (F.col("pos") + 1).cast("string")).alias("doc_id"), (X.unescape_line(F.col("line")) if escaped else F.col("line")).alias("text"))


def ngram_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("ngram"), F.size(F.split("value", " ")).alias("n"))


def counted(spark: SparkSession, path: str) -> DataFrame:
    """ngram, cnt and n of lines of an n-gram, a tab and its count."""
    return spark.read.csv(path, sep="\t", schema="ngram string, cnt long", quote="").withColumn("n", F.size(F.split("ngram", " ")))


def document_sentences(spark: SparkSession, path: str) -> DataFrame:
    """ts, sentence and doc_id of tab-separated lines; lines of fewer than three fields are left out."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    return parts.select(F.get("f", F.lit(0)).alias("ts"), F.get("f", F.lit(1)).alias("sentence"), F.get("f", F.lit(2)).alias("doc_id"))


def scored_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SCORED, quote="")


def priority_log(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Logged values; of a report on the first ``most`` lines only these."""
    rows = spark.read.csv(path, sep="\t", schema=PRIORITY_LOG, quote="")
    return rows if most is None else rows.limit(most)


def crawl_log(spark: SparkSession, path: str) -> DataFrame:
    """Columns 1, 4 and 6 of blank-separated lines, and perp and perp_via out of the JSON at their end."""
    fields, tail = F.split("value", r"\s+"), F.regexp_extract("value", r"(\{.*\})\s*$", 1)
    return spark.read.text(path).select(
        F.get(fields, F.lit(0)).alias("ts"), F.get(fields, F.lit(3)).alias("uri"), F.get(fields, F.lit(5)).alias("via"),
        F.get_json_object(tail, "$.perp").cast("double").alias("perp"), F.get_json_object(tail, "$.perp_via").cast("double").alias("perp_via"),
    )


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """uri, perp, directive and cost of a seed list; lines that are empty or begin with # don't count."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    return rows.select(X.with_scheme(F.col("value")).alias("uri"), F.lit(2.0).alias("perp"), F.lit(1).alias("directive"), F.lit(4).alias("cost"))


# -- sinks --------------------------------------------------------------------------------------


def write_text(df: DataFrame, path: str, rows: int = 0, compression: str = "none", mode: str = "append") -> None:
    """All columns as tab-separated, escaped lines; a new file after ``rows`` rows."""
    line = F.concat_ws("\t", *[F.coalesce(X.escape_line(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.mode(mode).option("maxRecordsPerFile", rows).option("compression", compression).text(path)


def write_rolling(df: DataFrame, path: str, megabytes: int = 100, compression: str = "gzip", mode: str = "append") -> None:
    """As ``write_text``, a new file after about ``megabytes`` of text: rows a file follow from the rows' mean size."""
    size = df.agg(F.count("*").alias("n"), F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 1 for c in df.columns), F.lit(0))).alias("bytes")).first()
    rows = max(1, int(size.n * (megabytes << 20) / size.bytes)) if size.bytes else 0
    write_text(df, path, rows, compression, mode)


def write_sentences(sentences: DataFrame, path: str, megabytes: int = 100, compression: str = "gzip") -> None:
    """Lines of time, sentence, url and number, of a table with ts, sentence, url and idx."""
    write_rolling(sentences.select("ts", "sentence", "url", "idx"), path, megabytes, compression)


def write_once(df: DataFrame, path: str) -> None:
    """Written unless it is there already."""
    df.write.mode("ignore").parquet(path)


def write_index(indexed: DataFrame, path: str, mode: str = "overwrite") -> None:
    indexed.write.mode(mode).partitionBy("n").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """A folder a split, called ``prefix_{k:02d}.txt`` by its number."""
    name = F.concat(F.lit("prefix_"), F.lpad(F.col(by).cast("string"), 2, "0"), F.lit(".txt"))
    df.withColumn("file", name).drop(by).write.mode(mode).partitionBy("file").csv(path, sep="\t")


def arpa_lines(probabilities: DataFrame) -> DataFrame:
    """Lines of an ARPA file, in order, of n, ngram, log10p and backoff (null: none)."""
    entry = F.concat_ws("\t", F.format_string("%.6f", "log10p"), "ngram", F.when(F.col("backoff").isNotNull(), F.format_string("%.6f", "backoff")))
    body = probabilities.select("n", F.lit(2).alias("kind"), "ngram", entry.alias("line"))
    sizes = probabilities.groupBy("n").count()
    head = sizes.select(F.lit(0).alias("n"), F.lit(1).alias("kind"), F.lpad(F.col("n").cast("string"), 3, "0").alias("ngram"), F.concat(F.lit("ngram "), "n", F.lit("="), "count").alias("line"))
    section = sizes.select("n", F.lit(1).alias("kind"), F.lit("").alias("ngram"), F.concat(F.lit("\n\\"), "n", F.lit("-grams:")).alias("line"))
    ends = probabilities.sparkSession.createDataFrame([(0, 0, "", "\\data\\"), (999, 0, "", "\n\\end\\")], "n int, kind int, ngram string, line string")
    return head.unionByName(section).unionByName(body).unionByName(ends).orderBy("n", "kind", "ngram").select("line")


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """n, ngram, log10p and backoff of an ARPA file, from the number of fields and words of each line."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    out = rows.select(F.size(F.split(F.get("f", F.lit(1)), " ")).alias("n"), F.get("f", F.lit(1)).alias("ngram"), F.get("f", F.lit(0)).cast("double").alias("log10p"), F.get("f", F.lit(2)).cast("double").alias("backoff"))
    return out.where("log10p is not null")
