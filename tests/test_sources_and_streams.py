"""Files, the chunk table and streams end to end."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import chunking as C
from folioscope.operators import embedding as E
from folioscope.operators import pagetext as P
from folioscope.registry import stream_queries
from folioscope.sources import files
from folioscope.sources.store import ChunkTable, list_documents
from folioscope.streaming import flows, state


def test_read_markdown_reports_bad_files(spark, tmp_path):
    (tmp_path / "b c.md").write_text("# 标题\ntext", encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "note.txt").write_text("x")
    good, bad = files.read_markdown(spark, str(tmp_path))
    assert [(r.source, r.content) for r in good.collect()] == [("b c.md", "# 标题\ntext")]
    assert [(r.source, r.reason) for r in bad.collect()] == [("bad.md", "not_utf8")]


def test_admission_rules(spark):
    names = ["../../etc/x.md", "a\\b\\.md", "q?.md", "ok.MD", "x.txt", "", None, "a:b.md", "c\x07.md"]
    df = spark.createDataFrame([(n, b"x") for n in names], "name string, content binary")
    got = [(r.filename, r.reason) for r in files.admit_files(df).collect()]
    assert got == [("x.md", None), (".md", "bad_name"), ("q?.md", "not_markdown"), ("ok.MD", None), ("x.txt", "not_markdown"), ("", "bad_name"), ("", "bad_name"), ("a:b.md", "not_markdown"), ("c\x07.md", "not_markdown")]
    big = spark.createDataFrame([("a.md",)], "name string").withColumn("content", F.repeat(F.lit("x"), 5 * 1024 * 1024 + 1).cast("binary"))
    assert files.admit_files(big).first().reason == "too_large"


def test_questions_tell_absent_from_null(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('# note\n\n{"question": "a", "expected_tool": null}\n{"question": "b"}\nplain\n{"x": 1}\n{broken\n', encoding="utf-8")
    good, bad = files.read_questions(spark, str(path))
    assert {r.question: (r.has_expected_tool, r.expected_tool) for r in good.collect()} == {"a": (True, None), "b": (False, None), "plain": (False, None)}
    assert sorted(r.reason for r in bad.collect()) == ["no_question", "not_json"]


def test_scored_files_and_samples(spark, tmp_path):
    cell = {"m": {"value": 1.0}}
    lines = [{"combo": "c", "user_input": "q", "scores": {"m": {"value": 0.0}}}, {"combo": "c", "user_input": "q", "scores": cell}, {"user_input": "r", "judge": "J", "scores": cell}, {"user_input": "none"}]
    (tmp_path / "alpha.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "beta.jsonl").write_text(json.dumps(lines[1]))
    scores, bad = files.read_scored(spark, str(tmp_path))
    assert {(r.judge, r.combo, r.user_input): r.value for r in scores.collect()} == {("J", "c", "q"): 1.0, ("J", "", "r"): 1.0, ("beta", "c", "q"): 1.0}
    assert [(r.line_no, r.reason) for r in bad.collect()] == [(4, "no_scores")]
    good, bad = files.read_samples(spark, str(tmp_path / "alpha.jsonl"))
    assert good.count() == 4 and bad.count() == 0 and "scores" not in good.columns


def test_markdown_names_and_sizes(spark, tmp_path):
    """Names are kept as they are, no file is too large for a folder, and hidden ones are told."""
    for name in ("a+b.md", "a b.md", "50%25.md", ".x.md", "_x.md"):
        (tmp_path / name).write_text(name)
    (tmp_path / "big.md").write_text("x" * (6 << 20))
    good, bad = files.read_markdown(spark, str(tmp_path))
    assert {r.source: len(r.content) for r in good.collect()} == {"a+b.md": 6, "a b.md": 6, "50%25.md": 8, "big.md": 6 << 20}
    assert {r.source: r.reason for r in bad.collect()} == {".x.md": "hidden_name", "_x.md": "hidden_name"}
    _, bad = files.read_markdown(spark, str(tmp_path), upload_rules=True)
    assert {r.source: r.reason for r in bad.collect()}["big.md"] == "too_large"


def test_question_ids_are_line_numbers(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\none\r\n\ntwo\n")
    good, _ = files.read_questions(spark, str(tmp_path / "q.txt"))
    assert {r.question_id: r.question for r in good.collect()} == {"q.txt:2": "one", "q.txt:4": "two"}
    (tmp_path / "empty.txt").write_text("# only a note\n")
    with pytest.raises(ValueError):
        files.read_questions(spark, str(tmp_path / "empty.txt"))


def test_line_numbers_of_files_in_many_splits(spark, tmp_path):
    """Ids do not depend on where Spark cuts the files."""
    ends = ["\n", "\r\n", "\n\n", "\n# note\n"]
    for name, n in (("a b+%41.txt", 400), ("one.txt", 1), ("q.txt", 150)):
        text = "".join(f"question {name} {i} {'é日' * (i % 7)}" + ends[i % 4] for i in range(n))
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty.txt").write_text("")
    wanted = {}
    for file in tmp_path.iterdir():
        for number, line in enumerate(file.read_text().split("\n"), 1):
            if line.strip() and not line.startswith("#"):
                wanted[f"{file.name}:{number}"] = line.strip()
    assert len(wanted) == 551
    for size in ("97b", "1k", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            splits = spark.read.text(str(tmp_path)).select("_metadata.file_block_start", "_metadata.file_path").distinct().count()
            good, bad = files.read_questions(spark, str(tmp_path))
            assert {r.question_id: r.question for r in good.collect()} == wanted and bad.count() == 0
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert (splits > 50) == (size == "97b")


def test_score_files_in_many_splits(spark, tmp_path):
    """The last line of a question wins and the last named judge stands for the file, across splits."""
    lines = [{"combo": "c", "user_input": f"q{i % 40}", "scores": {"m": {"value": float(i)}}} for i in range(200)]
    lines[150]["judge"] = "early"
    lines[151]["judge"] = "late"
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + '{"user_input": "bad"}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        scores, bad = files.read_scored(spark, str(tmp_path))
        assert {(r.judge, r.user_input): r.value for r in scores.collect()} == {("late", f"q{i}"): 160.0 + i for i in range(40)}
        assert [r.line_no for r in bad.collect()] == [201]
        good, _ = files.read_samples(spark, str(tmp_path / "s.jsonl"))
        assert good.count() == 201
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_request_log_keeps_every_key(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(json.dumps({"trace_id": "t", "latency_ms": 5, "retrieve_ms": 2.5, "odd_ms": "n/a", "top": 3}) + "\n")
    row = files.read_request_log(spark, str(tmp_path)).first()
    assert (row.trace_id, row.latency_ms, row.stage_ms, row.extra) == ("t", 5.0, {"retrieve_ms": 2.5}, {"odd_ms": "n/a", "top": "3"})


def test_jsonl_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("超时", None)], "a string, b string")
    files.write_jsonl(df, str(tmp_path / "o"), keep_nulls=True)
    assert spark.read.text(str(tmp_path / "o")).first()[0] == '{"a":"超时","b":null}'


def stored(spark, rows, signature="s1"):
    docs = spark.createDataFrame(rows, "source string, content string")
    embedder = E.Embedder(signature, lambda c: E.hash_embed(c, 8), lambda c: E.hash_embed(c, 8))
    return E.embed_chunks(C.chunk_documents(docs), embedder)


def test_chunk_table_life(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.read().count() == 0
    table.replace_documents(stored(spark, [("a.md", "one\n\n" + "x" * 700), ("b.md", "two"), ("c.md", "three")]))
    counts = {r.source: r.chunks for r in list_documents(table.read()).collect()}
    assert counts == {"a.md": 3, "b.md": 1, "c.md": 1} or counts["a.md"] >= 2
    table.replace_documents(stored(spark, [("a.md", "new")]))
    table.upsert(stored(spark, [("b.md", "two")]))
    assert {(r.source, r.content) for r in table.read().collect()} == {("a.md", "new"), ("b.md", "two"), ("c.md", "three")}
    assert table.delete_where({"source": "c.md"}) == 1 and table.delete_where({"source": "c.md"}) == 0
    assert sorted(r.source for r in table.read().collect()) == ["a.md", "b.md"]
    assert not table.check_signature("s1") and table.check_signature("s2")
    assert table.read().count() == 0


def test_stream_index_swaps_changed_documents(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=2)
    for text in ("first", "second"):
        spark.createDataFrame([("a.md", text), (f"{text}.md", text)], schemas.DOCUMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        docs = spark.readStream.schema(schemas.DOCUMENTS).parquet(str(tmp_path / "in"))
        flows.stream_index(docs, table, E.get_embedder("hashing"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.source, r.content) for r in table.read().collect()} == {("a.md", "second"), ("first.md", "first"), ("second.md", "second")}


REQUESTS = "created_at timestamp, route string, status string, prompt_tokens long, completion_tokens long, cost double, latency_ms double"


def request_stream(spark, path, batches):
    for times in batches:
        rows = [(t, "agent", "ok", 1, 1, 0.0, 1.0) for t in times]
        df = spark.createDataFrame(rows, REQUESTS.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their age
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_leave_windows_but_stay_in_the_raw_copy(spark, tmp_path):
    # A batch judges lateness by the watermark of the batch before it, hence the second one.
    batches = [["2024-01-01 10:00:00", "2024-01-03 10:00:00"], ["2024-01-03 11:00:00"], ["2024-01-01 11:00:00"], ["2024-01-05 10:00:00"]]
    stream = request_stream(spark, str(tmp_path / "in"), batches)
    for query in flows.metrics_with_raw_copy(stream, str(tmp_path / "m"), str(tmp_path / "raw"), str(tmp_path / "ck")):
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 5
    windows = {str(r.window_start)[:10]: r.requests for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert windows == {"2024-01-01": 1, "2024-01-03": 2}


def test_open_windows_and_sessions_are_closed_once(spark, tmp_path):
    """What a stream emitted stays as it is, what it held open is added, and nothing is counted twice."""
    batches = [["2024-01-01 10:00:00", "2024-01-03 10:00:00"], ["2024-01-03 11:00:00"], ["2024-01-01 11:00:00"], ["2024-01-05 10:00:00", "2024-01-05 10:10:00"]]
    stream = request_stream(spark, str(tmp_path / "in"), batches)
    for query in flows.metrics_with_raw_copy(stream, str(tmp_path / "m"), str(tmp_path / "raw"), str(tmp_path / "ck")):
        query.awaitTermination()
    raw, emitted = spark.read.parquet(str(tmp_path / "raw")), spark.read.parquet(str(tmp_path / "m"))
    for _ in range(2):
        emitted = flows.close_windows(emitted, raw, flows.window_metrics, "1 day", "1 hour", ("route", "status"))
        assert {str(r.window_start)[:10]: r.requests for r in emitted.collect()} == {"2024-01-01": 1, "2024-01-03": 2, "2024-01-05": 2}
    assert flows.close_windows(emitted.limit(0), raw.limit(0), flows.window_metrics, "1 day", "1 hour", ("route", "status")).count() == 0
    named = raw.withColumn("session_id", F.lit("s"))
    done = flows.session_metrics(named).where("started < '2024-01-04'")
    for _ in range(2):
        done = flows.close_sessions(done, named)
    assert sorted((str(r.started)[:16], r.requests) for r in done.collect())[-1] == ("2024-01-05 10:00", 2)
    assert done.count() == flows.session_metrics(named).count()


def test_streamed_failure_runs_cross_batches(spark, tmp_path):
    """Runs over batches in any order within the delay equal the batch form; later calls change nothing."""
    draw = random.Random(4)
    calls = [(d, i, f"2024-01-01 10:{i // 4:02d}:{i % 4 * 15:02d}", draw.random() < 0.4) for i in range(200) for d in ("a", "b") if draw.random() < 0.8]
    schema = "dependency string, call_id long, ts string, ok boolean"
    raw = spark.createDataFrame(calls, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate([calls[i : i + 60] for i in range(0, len(calls), 60)] + [[("a", 999, "2024-01-01 09:00:00", False)]]):
        draw.shuffle(part)
        df = spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.write_files(state.stream_failure_runs(stream, threshold=3, delay="5 minutes"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    emitted = spark.read.parquet(str(tmp_path / "out"))
    wanted = {(r.dependency, r.call_id, r.run) for r in flows.failure_runs(raw, threshold=3).collect()}
    early = {(r.dependency, r.call_id, r.run) for r in emitted.collect()}
    assert early < wanted and len(early) > len(wanted) / 2
    for _ in range(2):
        emitted = state.close_failure_runs(emitted, raw, threshold=3, delay="5 minutes")
        assert {(r.dependency, r.call_id, r.run) for r in emitted.collect()} == wanted and emitted.count() == len(wanted)


def test_answers_with_null_tokens(spark, tmp_path):
    schema = "trace_id long, seq long, type string, content string"
    rows = [(1, 0, "token", "a"), (1, 1, "token", None), (1, 2, "token", "b"), (1, 3, "done", None), (2, 0, "token", None), (2, 1, "error", "x")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    flows.write_files(state.stream_answers(stream, None), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "ab", "done"), (2, "", "error")]


def test_unmatched_votes_and_requests_are_closed(spark):
    schema = "trace_id string, created_at timestamp, route string, verdict string, reason string"
    rows = [(t, f"2024-01-0{d} 00:00:00", "r", v, None) for t, d, v in (("a", 1, "up"), ("b", 2, None), ("c", 3, "down"), ("a", 4, "down"))]
    table = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    asked, votes = table.where("trace_id <> 'c'").where("created_at < '2024-01-04'"), table.where("verdict is not null")
    joined = spark.createDataFrame([("a", None, None, "r", "up", None)], "trace_id string, asked_at timestamp, rated_at timestamp, route string, verdict string, reason string")
    joined = joined.withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in ("asked_at", "rated_at")})
    got = sorted((r.trace_id, r.route, r.verdict, r.asked_at is None, r.rated_at is None) for r in flows.close_feedback(joined, asked, votes).collect())
    assert got == [("a", "r", "up", False, False), ("a", "unknown", "down", True, False), ("b", "r", None, False, True), ("c", "unknown", "down", True, False)]


def test_conversation_state_over_batches(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    out = []
    for part in ([(1, 0, "user", "a"), (1, 1, "assistant", "b")], [(1, i, "user", str(i)) for i in range(2, 7)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        flows.write_files(state.stream_conversations(stream, 5, 3, None), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        out = sorted((r.total, r.folded, [m["content"] for m in json.loads(r.messages)]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [(2, 0, ["a", "b"]), (7, 4, ["4", "5", "6"])]


def test_markdown_from_pages(spark):
    filler = [f"0.{i} Intro {i} ....... 1" for i in range(1, 5)]
    pages = [
        ["Cover of a manual", "legal words"],
        filler + ["1 Getting started ...... 3", "1.1 A title that", "goes on ......... 3"],
        ["Product Guide Release 7 Start", "1 Getting started", "This sentence is long enough to be wrapped at the end of the", "line and goes on here.", "Next paragraph starts now.", "$ kubectl get pods -n name-", "space-7", "NAME READY", "pod-1 1/1", "Expected outcome", "• first  thing", "2. Open the file and read it", "Figure 3: A picture", "7"],
        ["Product Guide Release 7 More", "1.1 A title that goes on", "2 Not in contents", "T o end", "8"],
        ["Product Guide Release 7 End", "closing words", "9"],
        ["Product Guide Release 7 End", "Last one,", "after comma", "10"],
    ]
    rows = [("d", p, i, line) for p, lines in enumerate(pages) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, line string").repartition(5)
    assert {(r.number, r.title) for r in P.parse_toc(df).collect()} >= {("1", "Getting started"), ("1.1", "A title that goes on")}
    assert P.running_header(df).first().header == "Product Guide Release 7"
    titles = spark.createDataFrame([("d", "Guide")], "doc_id string, title string")
    text = P.assemble_markdown(df, titles).first().markdown
    assert text == "\n\n".join(
        [
            "# Guide",
            "## 1 Getting started",
            "This sentence is long enough to be wrapped at the end of the line and goes on here.",
            "Next paragraph starts now.",
            "```\n$ kubectl get pods -n name-space-7\nNAME READY\npod-1 1/1\n```",
            "Expected outcome",
            "- first thing",
            "2. Open the file and read it",
            "*Figure 3: A picture*",
            "### 1.1 A title that goes on",
            "2 Not in contents",
            "To end closing words",
            "Last one, after comma",
        ]
    ) + "\n"


def pages_of(spark, pages):
    rows = [("d", page, k, line) for page, lines in enumerate(pages) for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, line string")


def test_running_header_follows_the_first_of_equals(spark):
    df = pages_of(spark, [["Alpha Beta Gamma"], ["Alpha Beta Gamma"], ["Alpha Delta Epsilon Zeta Eta Theta"], ["Alpha Delta Epsilon Zeta Eta Theta"]])
    assert P.running_header(df).first().header == "Alpha Beta Gamma"


def test_contents_lines_that_close_leave_nothing_open(spark):
    lines = ["1 foo", "3 bar ..... 7", "2 bar ..... 9", "4 long title that", "goes on ..... 12", *[f"{k} more {k} ..... {k}" for k in range(5, 9)]]
    got = {r.number: r.title for r in P.parse_toc(pages_of(spark, [lines])).collect()}
    assert got["2"] == "bar" and got["4"].startswith("long title that goes on") and got["1"].startswith("foo") and "3" not in got


def test_failure_runs_by_batches_carry_runs_and_order_ties_by_number(spark, tmp_path):
    """Batches, shuffled inside, equal the batch form; ids of one time count as numbers in the keyed form too."""
    draw = random.Random(7)
    calls = [(d, i, f"2024-01-01 {10 + i // 120:02d}:{i // 4 % 30 * 2:02d}:00", draw.random() < 0.3) for i in range(480) for d in ("a", "b") if draw.random() < 0.8]
    schema = "dependency string, call_id long, ts string, ok boolean"

    def table(rows):
        return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))

    raw = table(calls)
    wanted = {(r.dependency, r.call_id, r.run) for r in flows.failure_runs(raw).collect()}
    for part in (calls[i : i + 200] for i in range(0, len(calls), 200)):
        draw.shuffle(part)
        table(part).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
        flows.run_batches(stream, str(tmp_path / "runs"), str(tmp_path / "ck"), delay="5 minutes").awaitTermination()
    got = [(r.dependency, r.call_id, r.run) for r in flows.read_runs(raw, str(tmp_path / "runs")).collect()]
    assert set(got) == wanted and len(got) == len(wanted) > 10
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    flows.write_files(state.stream_failure_runs(stream, delay="5 minutes"), str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    early = {(r.dependency, r.call_id, r.run) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert early <= wanted and len(early) > len(wanted) / 2


def test_a_table_in_a_folder_is_streamed_like_one_file(spark, tmp_path):
    """Larger tables are folders of files."""
    rows = [(c, t, "system" if t == 1 else "user", f"{c}-{t}") for c in range(6) for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    docs = spark.createDataFrame([(i, f"title {i}\nbody") for i in range(5)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    answers = stream_queries.stream_answers(spark, str(tmp_path)).collect()
    assert sorted((r.trace_id, r.answer) for r in answers) == [(c, f"{c}-2{c}-3") for c in range(6)]
    assert {(r.conv_id, r.total) for r in stream_queries.stream_conversations(spark, str(tmp_path)).collect()} == {(c, 4) for c in range(6)}
    assert stream_queries.stream_index(spark, str(tmp_path)).count() == 5
