"""Markdown folders, question files, logs and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.functions.text import strip
from folioscope.operators.retrieval import send_small
from folioscope.session import materialise

# What an upload may be called and how large it may be.
SAFE_NAME = '^(?i)[^/\\\\:*?"<>|\\x00-\\x1f]+\\.md\\z'
MAX_BYTES = 5 * 1024 * 1024
COMMENT_MARK = "#"


def base_name(path: Column | str) -> Column:
    """The last part of a path, whichever slash was used, trimmed."""
    value = F.col(path) if isinstance(path, str) else path
    return strip(F.substring_index(F.translate(F.coalesce(value, F.lit("")), "\\", "/"), "/", -1))


def admit_files(files: DataFrame) -> DataFrame:
    """``(name, content binary)`` plus ``filename`` and ``reason``; NULL means accepted.

    ``bad_name``, ``not_markdown``, ``too_large`` (over 5 MiB) or ``not_utf8``.
    """
    named = files.withColumn("filename", base_name("name"))
    return named.withColumn(
        "reason",
        F.when((F.col("filename") == "") | F.startswith("filename", F.lit(".")), "bad_name")
        .when(~F.col("filename").rlike(SAFE_NAME), "not_markdown")
        .when(F.octet_length("content") > MAX_BYTES, "too_large")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8"),
    )


def hidden_names(spark: SparkSession, path: str) -> list[str]:
    """Markdown files of a folder whose names begin with a dot or an underscore: Spark's readers pass over them."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{{_,.}}*.[mM][dD]")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(x.getPath().getName() for x in found or ())


def read_markdown(spark: SparkSession, path: str, upload_rules: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents ``(source, content)`` of a folder, and rejected files ``(source, reason)``.

    A file keeps its exact name and may have any size; only bytes that are not UTF-8 and names that
    Spark's readers pass over (``hidden_name``) are rejected, as rows of the second table. With
    ``upload_rules`` the rules for uploads hold too.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[mM][dD]")
        .load(path)
        .select(F.col("path").alias("name"), "content")
    )
    if upload_rules:
        checked = admit_files(raw)
    else:
        valid = F.is_valid_utf8(F.col("content").cast("string"))
        named = raw.withColumn("filename", F.substring_index("name", "/", -1))
        checked = named.withColumn("reason", F.when(~valid, "not_utf8"))
    good = checked.where("reason is null").select(
        F.col("filename").alias("source"), F.col("content").cast("string").alias("content")
    )
    bad = checked.where("reason is not null").select(F.col("filename").alias("source"), "reason")
    hidden = [(name, "hidden_name") for name in hidden_names(spark, path)]
    return good, bad.unionByName(spark.createDataFrame(hidden, bad.schema))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, name, line_no, line)`` of text files of any size, with true line numbers from 1.

    ``file`` is the encoded path, ``name`` the file's own name.

    Spark cuts a file into splits that different tasks read, so a task knows a line's place in its split
    only. Splits are counted, and a line's number is its place plus the lines of the splits before. Lines are
    stored once, so that counting and numbering see the same splits even when executors are lost.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        # The name comes percent-encoded, with a plus sign as itself.
        F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("name"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    rows = materialise(read)
    # A task reads a split's lines one after the other: their ids follow each other.
    splits = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    splits, _ = send_small(splits)
    return rows.join(splits, ["file", "start"]).select("file", "name", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank, non-comment lines of question, sample and score files, trimmed."""
    rows = numbered_lines(spark, path).withColumn("line", strip("line"))
    return rows.where((F.col("line") != "") & ~F.startswith("line", F.lit(COMMENT_MARK)))


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions and rejected lines of a JSON-lines or plain-text question file.

    An absent ``expected_tool`` and a NULL one differ, so its presence is a column of its own.
    Lines that do not start with a brace are questions themselves. A JSON line that does not
    parse, or has no question, is a rejected row. ``question_id`` is the file's name and the line
    number. Files without any question are an error.
    """
    rows = _lines(spark, path)
    is_json = F.startswith("line", F.lit("{"))
    keys = F.when(is_json, F.json_object_keys("line"))
    parsed = rows.withColumn("_json", is_json).withColumn("_keys", keys).withColumn(
        "q", F.when(is_json, F.from_json("line", schemas.QUESTION))
    )
    question = F.when(F.col("_json"), F.col("q.question")).otherwise(F.col("line"))
    has_tool = F.coalesce(F.array_contains("_keys", "expected_tool"), F.lit(False))
    bad = F.col("_json") & (F.col("_keys").isNull() | F.col("q.question").isNull())
    good = parsed.where(~bad).select(
        F.concat_ws(":", "name", F.col("line_no").cast("string")).alias("question_id"),
        "line_no",
        question.alias("question"),
        *[F.col(f"q.{n}").alias(n) for n in schemas.QUESTION.names if n != "question"],
        has_tool.alias("has_expected_tool"),
    )
    rejects = parsed.where(bad).select(
        "file", "line", F.when(F.col("_keys").isNull(), "not_json").otherwise("no_question").alias("reason")
    )
    return require_rows(good, "questions"), rejects


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when a table is empty, as an empty question or sample file is a mistake."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = False, mode: str = "overwrite") -> None:
    """One JSON object per line; non-ASCII text stays as it is."""
    df.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples to be scored and rejected lines; old scores and judges are not read."""
    rows = _lines(spark, path).withColumn("s", F.from_json("line", schemas.SAMPLE))
    bad = F.col("s.user_input").isNull()
    return rows.where(~bad).select("s.*"), rows.where(bad).select("line", F.lit("no_user_input").alias("reason"))


def _request_rows(lines: DataFrame) -> DataFrame:
    """Request lines parsed: known columns, ``stage_ms`` with every ``<stage>_ms``, and ``extra`` with the rest."""
    known = schemas.REQUEST_LOG.names
    parsed = lines.where(F.trim("value") != "").select(
        F.from_json("value", schemas.REQUEST_LOG).alias("r"), F.from_json("value", "map<string,string>").alias("m")
    )
    rest = F.map_filter("m", lambda k, v: ~k.isin(*known))
    stages = F.map_filter(rest, lambda k, v: k.endswith("_ms") & v.try_cast("double").isNotNull())
    return parsed.select(
        "r.*",
        F.transform_values(stages, lambda k, v: v.cast("double")).alias("stage_ms"),
        F.map_filter(rest, lambda k, v: ~(k.endswith("_ms") & v.try_cast("double").isNotNull())).alias("extra"),
    )


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """The request log as a batch table; no key of a line is lost."""
    return _request_rows(spark.read.text(path))


def stream_request_log(spark: SparkSession, path: str) -> DataFrame:
    """The request log as a stream of appended files; no key of a line is lost."""
    return _request_rows(spark.readStream.text(path))


def read_scored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scores in long form ``(judge, combo, user_input, metric, value, skipped, error, reason)``, and rejects.

    The judge named last in a file stands for the whole file, else the file's name does. The last line of
    a (combo, question) wins. A line without scores is a rejected row.
    """
    rows = _lines(spark, path).withColumn("s", F.from_json("line", schemas.SCORED))
    bad = F.col("s.scores").isNull()
    stem = F.regexp_replace("name", "\\.[^.]*\\z", "")
    named = rows.where(~bad).withColumn("named", F.nullif("s.judge", F.lit("")))
    judges = named.where("named is not null").groupBy("file").agg(F.max_by("named", "line_no").alias("judge"))
    keyed = named.join(judges, "file", "left").select(
        F.coalesce("judge", stem).alias("judge"),
        F.coalesce("s.combo", F.lit("")).alias("combo"),
        F.col("s.user_input").alias("user_input"),
        F.col("s.scores").alias("scores"),
        F.struct("file", "line_no").alias("place"),
    )
    last = keyed.groupBy("judge", "combo", "user_input").agg(F.max_by("scores", "place").alias("scores"))
    scores = last.select("judge", "combo", "user_input", F.explode("scores").alias("metric", "cell"))
    rejects = rows.where(bad).select("file", "line_no", "line", F.lit("no_scores").alias("reason"))
    return scores.select("judge", "combo", "user_input", "metric", "cell.*"), rejects
