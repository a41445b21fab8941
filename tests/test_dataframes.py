"""The operators on DataFrames, native against Arrow, and queries against their oracle."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from maskwell.functions import engine as E
from maskwell.operators import arrow, metadata, native, report
from maskwell.plans import queries
from maskwell.plans.policy import BUILT_IN, Policy
from maskwell.sources import transcripts
from maskwell.streaming import streams

SF = "/root/testdata/sf0.001"
STANDARD, MAXIMUM = Policy("standard"), Policy("maximum", code_mode="regex")
TEXTS = [None, "", "é mail a@b.org, card 4111 1111 1111 1111 or 4111-1111-1111-1111", "cp /home/alice /home/bob/x and /home/Ann Lee/y", "git@github.com:a/b.git \u2028 10.0.0.1\r\n", "api_key = ghp_" + "0a" * 18, "ü" * 150 + " access_key " + "0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWX " + "ü" * 150]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_native_and_arrow_agree(spark, texts):
    a = texts.select("id", arrow.detector(spark, MAXIMUM)(F.col("text")).alias("m"))
    b = texts.select("id", native.matches(F.col("text"), BUILT_IN).alias("m"))
    plain = [{r["id"]: [(m["rule"], m["offset"], m["length"], m["rule_ord"]) for m in r["m"]] for r in x.collect()} for x in (a, b)]
    assert plain[0] == plain[1] and plain[0][0] == [] and len(plain[0][6]) >= 1
    rules = STANDARD.active_rules
    c = texts.select("id", native.masked(F.col("text"), native.matches(F.col("text"), rules), rules).alias("t"), arrow.masker(spark, STANDARD)(F.col("text")).alias("u"))
    for r in c.collect():
        assert r["t"] == r["u"] == (None if TEXTS[r["id"]] is None else E.mask_text(TEXTS[r["id"]], STANDARD).text)


def test_native_plan_has_no_python(spark, texts):
    plan = texts.select(native.matches(F.col("text"), queries.PII))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_matches_in_one_text_take_little_time(spark):
    import time

    text = " ".join(f"u{i}é@example.org" for i in range(4000))
    df = spark.createDataFrame([(text,)], "text string").select(native.matches(F.col("text"), queries.PII).alias("m"))
    began = time.perf_counter()
    found = df.first()["m"]
    assert time.perf_counter() - began < 20
    assert [(m["rule"], m["offset"], m["length"], m["begin"]) for m in found] == [(m.rule.id, m.offset, m.length, m.begin) for m in E.detect(text, queries.PII)]


def test_last_window_of_a_stream_is_there(spark, tmp_path):
    rows = [(f"2024-01-0{d} 10:00:00", "a@b.org") for d in (1, 1, 2, 3)]
    spark.createDataFrame(rows, "ts string, text string").selectExpr("CAST(ts AS timestamp) AS ts", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    out = streams.run_latest(streams.hit_rates(stream, "text", "ts", STANDARD, "1 day"), ["window_start", "rule"], str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["n"] for r in out.collect()) == [1, 1, 2]


@pytest.mark.parametrize("layout", ["file", "files", "partitions"])
def test_streams_read_whole_tables(spark, tmp_path, layout):
    def put(df, name, by):
        to = str(tmp_path / f"{name}.parquet")
        if layout == "partitions":
            return df.write.partitionBy(by).parquet(to)
        df.repartition(1 if layout == "file" else 3).write.parquet(to if layout == "files" else str(tmp_path / name))
        if layout == "file":
            next((tmp_path / name).glob("part-*.parquet")).rename(to)

    turns = [(c, n, "user", TEXTS[(c + n) % len(TEXTS)]) for c in range(6) for n in range(3)]
    put(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), "conversations", "turn")
    put(spark.createDataFrame([(i, i, f"2024-01-0{i % 3 + 1} 10:00:00") for i in range(9)], "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "CAST(ts AS timestamp) AS ts"), "events", "user_id")
    put(spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string"), "documents", "doc_id")
    out = queries.masked_stream(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted((c, n, None if t is None else E.mask_text(t, STANDARD).text) for c, n, _, t in turns)
    found = {(r["day"], r["rule"]): r["n"] for r in queries.hit_windows(spark, str(tmp_path)).collect()}
    assert {day for day, _ in found} == {19723, 19724, 19725} and {n for (_, rule), n in found.items() if rule == "email"} == {3}


def test_entropy_expressions(spark):
    words = ["aB3xQ9mZ7kL2pR8nT4vY6wU1sE5jC0dF", "abcdefghijklmnopqrstuvwxyz", "12345678901234567890123", "$" + "aB3x" * 9, "x" * 30, "0f" * 16, "01234567-89ab-cdef-0123-456789abcdef", "short"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", native.high_entropy(F.col("w")).alias("h"))
    assert {r["w"]: r["h"] for r in df.collect()} == {w: E.is_high_entropy(w) for w in words}


def test_pipeline_struct_and_report(spark, texts):
    out = {r["id"]: r["r"] for r in texts.select("id", arrow.pipeline(spark, STANDARD)(F.col("text")).alias("r")).collect()}
    assert out[0]["text"] is None and out[1]["matches"] == [] and not out[2]["failed"]
    row = report.report(arrow.match_table(texts, "text", ["id"], STANDARD)).first()
    assert row["total"] == sum(row["counts"].values()) and row["categories"] == [c for c in ("CREDENTIAL", "PII", "PATH", "INTERNAL") if c in row["categories"]]
    empty = report.report(arrow.match_table(texts.limit(0), "text", ["id"], STANDARD)).first()
    assert (empty["total"], empty["counts"], empty["categories"]) == (0, {}, [])


def test_titles_fail_no_job(spark):
    df = spark.createDataFrame([("<user_query>x",), ("fix it",), (None,)], "t string")
    rows = df.select("t", arrow.title_maker(spark, harness="claude-code")(F.col("t")).alias("o")).collect()
    by = {r["t"]: r["o"] for r in rows}
    assert by["<user_query>x"]["text"] is None and "unbalanced" in by["<user_query>x"]["error"] and by["fix it"]["text"] == "fix it" and by[None]["text"] is None


def test_transcript_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"m":"a@b.org"}\r\n\nplain a@b.org\n')
    (tmp_path / "in/b.jsonl").write_text('{"m":"a@b.org"}\n' + "x" * 200 + "\n")
    out = transcripts.mask_lines(transcripts.read_lines(spark, str(tmp_path / "in")), STANDARD, most=100)
    rows = sorted(out.collect(), key=lambda r: (r["file"], r["line_no"]))
    assert [r["line"] for r in rows if not r["too_long"]] == ['{"m":"\\u003cEMAIL\\u003e"}', "", "plain a@b.org"]
    assert [r["line"] for r in rows if r["too_long"]] == ['{"m":"a@b.org"}', "x" * 200]
    transcripts.write_lines(out.filter("NOT too_long"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == '{"m":"\\u003cEMAIL\\u003e"}\n\nplain a@b.org\n'
    docs = transcripts.mask_documents(transcripts.read_documents(spark, str(tmp_path / "in/b.jsonl")), STANDARD)
    assert docs.first()["document"] == '{"m":"\\u003cEMAIL\\u003e"}'


def test_metadata_struct(spark):
    row = ((("/home/ann/x/s.jsonl",), "/home/ann/x", None, ("a@b.org", None, None, None), None, None, None),)
    df = spark.createDataFrame([row, (None,)], "m struct<source:struct<file_path:string>,cwd:string,host_slug:string,git:struct<remote:string,branch:string,worktree:string,tracking:string>,project:struct<file_path:string,name:string>,diagnostics:struct<warnings:array<struct<error_type:string,location:string,message:string,remediation:string>>>,subagents:array<struct<id:string>>>")
    out = [r["m"] for r in df.select(metadata.mask_metadata(spark, STANDARD, F.col("m")).alias("m")).collect()]
    assert out[0]["cwd"] == "/home/<USER>/x" and out[0]["git"]["remote"] == "<EMAIL>" and out[0]["host_slug"] is None and out[1] is None


def test_sql_functions_and_nested_values(spark, texts):
    from maskwell.operators import sql

    names = sql.register(spark, STANDARD)
    assert "mw_mask" in names
    out = spark.sql("SELECT mw_mask('a@b.org') AS t, size(mw_matches('a@b.org 10.0.0.1')) AS n, mw_json('{\"a@b.org\": [\"a@b.org\"]}') AS j").first()
    assert out["t"] == "<EMAIL>" and out["n"] == 2 and out["j"] == '{"a@b.org":["\\u003cEMAIL\\u003e"]}'
    df = spark.createDataFrame([((1.5, ["a@b.org", None], {"a@b.org": "10.0.0.1"}),), (None,)], "v struct<x:double,y:array<string>,z:map<string,string>>")
    rows = [r["v"] for r in df.select(sql.mask_nested(spark, STANDARD, F.col("v"), df.schema["v"].dataType).alias("v")).collect()]
    assert tuple(rows[0]) == (1.5, ["<EMAIL>", None], {"a@b.org": "<IP_ADDRESS>"}) and rows[1] is None


def test_fixture_cases(spark):
    from maskwell.errors import ActionableError
    from maskwell.sources.fixtures import load_cases

    pytest.importorskip("yaml")
    df = load_cases(spark, "cases:\n- {name: a, input: a@b.org, rule: email, expect: match, reason: r, source: s}\n")
    assert df.first()["level"] == "standard"
    with pytest.raises(ActionableError):
        load_cases(spark, "- {name: a, input: x, rule: email, expect: match, level: none}\n")


def test_built_in_cases_hold(spark):
    rows = queries.QUERIES["fixture_cases"](spark, SF).collect()
    assert len(rows) == 2 * len(BUILT_IN) - 2 and all(r["fired"] == (r["expect"] == "match") for r in rows)


def test_sessions_share_names(spark):
    rows = [("s", 2, "```go\nbeta(alpha)\n```"), ("s", 1, "```go\nalpha()\n```"), ("t", 1, "```go\nzeta()\n```"), (None, 1, None), (None, 2, "```go\nbeta()\n```"), (None, 3, "```go\nzeta()\n```")]
    df = spark.createDataFrame(rows, "s string, n int, text string")
    out = {(r["s"], r["n"]): r["text"] for r in arrow.anonymize_sessions(df, "s", "n", "text").collect()}
    assert out == {("s", 1): "```go\nid1()\n```", ("s", 2): "```go\nid2(id1)\n```", ("t", 1): "```go\nid1()\n```", (None, 1): None, (None, 2): "```go\nid1()\n```", (None, 3): "```go\nid1()\n```"}


def test_session_stream_keeps_names_between_batches(spark, tmp_path):
    schema = "s string, n int, text string"
    spark.createDataFrame([("s", 1, "```go\nalpha()\n```")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.anonymize_session_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "s", "n", "text")
    streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    spark.createDataFrame([("s", 2, "```go\nbeta(alpha)\n```")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r["n"]: r["text"] for r in out.collect()} == {1: "```go\nid1()\n```", 2: "```go\nid2(id1)\n```"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["masked_documents", "detect_all_rules", "masked_standard", "report_by_rule", "entropy_masked", "json_values", "titles", "metadata_paths", "release_tags", "masked_maximum", "user_rules", "residue_previews", "fallback_masked", "transcript_lines", "title_cases", "hit_windows", "session_code_names", "documents_detected"])
def test_queries_equal_their_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    mine = queries.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(queries.SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns) and len(mine)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    assert a.equals(b)


def test_entry_points(spark):
    assert set(queries.SQL) <= set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
