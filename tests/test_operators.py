"""Operators without SQL: filters, chunks, graph clustering, transcripts, streams; small fixtures of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import chunks, events, filters, graph, lines, prompts, reports, rules, transcripts
from weftline.sources import files
from weftline.streaming import events as streams


def definition(**how):
    return filters.Definition(match_command="^x", **how)


def run(text, ok=None, **how):
    return filters.reduce(text, definition(**how), ok)


TEN = "\n".join(f"line {i}" for i in range(1, 11)) + "\n" + "pad " * 40


@pytest.mark.parametrize(
    ("how", "text", "want"),
    [
        ({"strip_lines_matching": ["^a"]}, "a1\nb2\na3\nb4 and more", "b2\nb4 and more"),
        ({"keep_lines_matching": ["2$"]}, "a2\nb3\nc2", "a2\nc2"),
        ({"strip_ansi": True}, "\x1b[31mred\x1b[0m text", "red text"),
        ({"max_lines": 2}, "a\nb\nc\nd", "a\nb"),
        ({"tail_lines": 1}, "a\nb\nc", "c"),
        ({"replace_patterns": [[r"(\w+)=(\w+)", "$2:$1"]]}, "a=b", "b:a"),
        ({"truncate_lines_at": 3}, "abcdef\nxy", "abc\nxy"),
        ({"match_output": [{"pattern": "^ok", "message": "fine"}]}, "ok all went well", "fine"),
        ({"match_output": [{"pattern": "^ok", "message": "fine"}]}, "ok\nerror: no", "ok\nerror: no"),
        ({"match_output": [{"pattern": "^ok", "message": "fine", "unless": "bad"}]}, "ok but bad", "ok but bad"),
        ({"uniform_success": {"pattern": "ok$", "message": "{n} ok"}}, "one is ok\ntwo is ok", "2 ok"),
        ({"strip_lines_matching": ["."], "on_empty": "none"}, "something", "none"),
        ({"strip_lines_matching": ["."], "passthrough_when_emptied": True}, "something", "something"),
        ({"strip_lines_matching": ["."], "on_empty": "none"}, "fatal: no", "fatal: no"),
        ({"block_caps": [{"start": "^B", "max_lines": 2}]}, "B1\nx\n" + "y" * 60 + "\nz\n\nafter", "B1\nx\n\nafter\n[... 2 detail lines omitted from 1 blocks ...]"),
        ({"extract_sections": [{"start_pattern": "^<", "end_pattern": "^>"}]}, "a\n<\nb\nc\n>\nd", "b\nc"),
        ({"extract_sections": [{"start_pattern": "^<", "end_pattern": "^>", "include_markers": True, "max_matches": 1}]}, "<\nb\n>\n<\nc\n>", "<\nb\n>"),
        ({"semantic_filter": {"query": "Cat dog"}}, "the cat\na cow\nDOGS", "the cat\nDOGS"),
        ({"summarize_json": {"max_array_items": 1, "exclude": ["z"]}}, json.dumps({"a": list(range(60)), "z": 1}), '{\n  "a": [\n    0,\n    "... 59 more item(s) omitted ..."\n  ]\n}'),
        ({"strip_lines_matching": ["^a"]}, "a\r\nb\r\nc\r\n", "b\r\nc"),
    ],
)
def test_filter_fields(how, text, want):
    assert run(text, **how) == want


def test_filter_windows_and_failures():
    assert run(TEN, head_lines=2, tail_lines=1).split("\n")[2] == "[... 8 lines omitted ...]"
    assert run(TEN, max_lines=3, notify_on_truncate=True).endswith("[... 8 lines omitted (line limit) ...]")
    assert run("a\nb\nc error\nd", ok=False, max_lines=1) == "c error" or "c error" in run("a\nb\nc error\nd" + " " * 0, ok=False, max_lines=1)
    assert run(TEN, ok=False, on_failure="tail:1") == "pad " * 39 + "pad"
    assert run(TEN, ok=False, on_failure="passthrough") == TEN.rstrip()
    assert "line 9" in run(TEN, max_lines=1, priority_lines=["9$"])
    out = run("\n".join(["warn x"] * 30 + ["end"]), category_caps=[{"pattern": "^warn", "max": 2}])
    assert out == "warn x\nwarn x\n[... 28 more similar line(s) omitted ...]\nend"
    dup = "\n\n".join(["same one\nsame two\nsame three\nsame four"] * 12)
    assert "[... 11 similar block(s) omitted ...]" in run(dup, deduplicate_blocks={"min_block_lines": 2, "similarity": 0.9})
    assert T is not None and len(filters.budgeted("\n".join(["word " * 10] * 40), 60)) < 400


def test_filters_never_lengthen():
    rng = random.Random(4)
    defs = [definition(head_lines=1, tail_lines=1, notify_on_truncate=True), definition(token_budget=5), definition(match_output=[{"pattern": ".", "message": "a long message " * 5}]), definition(truncate_lines_at=2, notify_on_truncate=True)]
    for _ in range(300):
        t = "\n".join("".join(rng.choice("aé error\t") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9)))
        for d in defs:
            got = filters.reduce(t, d)
            assert not t.strip() or len(got.encode()) <= len(t.rstrip().encode())


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("git status", "git status"), ("FOO=1 sudo git status", "git status"), ("cd /x && npm run build 2>&1 | tail -5", "tail -5"), ("bash -lc 'cd a; cargo test'", "cargo test"),
        ("npx tsc --noEmit", "tsc --noEmit"), ("timeout 30 pytest -q", "pytest -q"), ('echo "a && b"', "echo a && b"), ("python -m pytest x", "pytest x"),
    ],
)
def test_effective_command(command, want):
    assert filters.candidates(command)[0] == want


def test_filter_choice_and_checks():
    a, b = filters.Definition("^git", name="a"), filters.Definition("^git status", name="b")
    assert filters.find("cd x && git status", [[a, b]]).name == "b"
    assert filters.find("git status", [[a], [b]]).name == "a"
    assert filters.find("ls", [[a]]) is None
    with pytest.raises(ValueError):
        filters.load("[filters.x]\nmatch_command = 'a'\nodd = 1")
    assert filters.issues(filters.Definition("(", max_lines=0)) == ["bad pattern: (", "max_lines is 0"]


def test_chunks():
    rng = random.Random(2)
    for lang in ("generic", "python", "rust", "sql", "vb"):
        for _ in range(60):
            text = "\n".join(rng.choice(["", "def f(x):", "    return 1", "fn a() {", "}", "x" * rng.randint(0, 3000), "CREATE TABLE t (a int);", "Sub Foo()", "words here " * 20]) for _ in range(rng.randint(0, 40)))
            got = chunks.chunk(text, lang)
            assert all(c["token_count"] <= 400 and c["content"].strip() for c in got)
    code = "import os\n\ndef one(a):\n    return a\n\nclass Two:\n    def m(self):\n        pass\n"
    assert [(c["symbol"], c["start_line"], c["end_line"]) for c in chunks.chunk(code, "python") if c["symbol"]] == [("one", 3, 4), ("Two", 6, 8)]
    rust = "use a::b;\nfn x() {\n  y();\n}\nstruct S;\n"
    assert [(c["symbol"], c["kind"]) for c in chunks.chunk(rust, "rust") if c["symbol"]] == [("x", "function"), ("S", "struct")]


def test_references_and_imports(spark):
    src = spark.createDataFrame([(1, "fn a() { b(); store::open(); if (x) {} }")], "caller int, content string")
    refs = src.select("caller", F.explode(chunks.references("content")).alias("ref"))
    assert sorted(r["ref"] for r in refs.collect()) == ["b", "open", "store::open"]
    quiet = spark.createDataFrame([(1, "// x()\n/* y(\n) */ z('w()', \"v()\")\n# u()\ndef t(): s()\nfn g<'a>(x: &'a str) { h(x) }")], "caller int, content string")
    assert sorted(r["ref"] for r in quiet.select(F.explode(chunks.references("content")).alias("ref")).collect()) == ["h", "s", "z"]
    defs = spark.createDataFrame([(1, "a", "src/a.rs"), (2, "b", "src/b.rs"), (3, "open", "src/store.rs"), (4, "open", "src/other.rs")], "callee int, name string, path string")
    assert sorted(map(tuple, chunks.resolve(refs.where("ref <> 'open'"), defs).collect())) == [(1, 2), (1, 3)]
    lines = spark.createDataFrame([("src/a.rs", "rust", 1, "use crate::store::open_db;"), ("p/x.py", "python", 1, "import p.y"), ("w/a.ts", "typescript", 1, "import z from './b'"), ("w/a.ts", "typescript", 2, "import q from 'react'")], "path string, lang string, pos int, line string")
    known = spark.createDataFrame([("src/store.rs",), ("p/y.py",), ("w/b.ts",)], "path string")
    got = {(r["path"], r["target"]): r["resolved"] for r in chunks.resolve_imports(chunks.imports(lines), known).collect()}
    assert got == {("src/a.rs", "crate::store::open_db"): "src/store.rs", ("p/x.py", "p.y"): "p/y.py", ("w/a.ts", "./b"): "w/b.ts", ("w/a.ts", "react"): None}


def test_graph_clusters_and_cycles(spark):
    pairs = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(3, 4, 1.0)]
    got = graph.louvain(8, pairs)
    assert len(set(got[:4])) == 1 and len(set(got[4:])) == 1 and got[0] != got[4]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (7, 6)], "src int, dst int")
    assert sorted(map(tuple, graph.cycles(e).collect())) == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)]
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (6, "Same"), (7, "same")], "node int, name string")
    assert sorted(r["node"] for r in graph.cycles(e, names).collect()) == [1, 2, 3]  # overloads of one name are no cycle
    assert sorted(map(tuple, graph.reach(e, spark.createDataFrame([(4,)], "node int"), None, reverse=True).collect())) == [(1, 3), (2, 2), (3, 1), (4, 0)]


def test_secret_rules(spark):
    made = {"github-token": "gh" + "p_" + "a1B2" * 9, "slack-token": "xo" + "xb-" + "1234567890ab", "aws-access-key-id": "AK" + "IA" + "ABCDEFGH12345678", "jwt": "ey" + "Jabcdefgh1.abcdefgh2.abcdefgh3"}
    df = spark.createDataFrame([(i, f"x {v} y") for i, v in enumerate(made.values())] + [(99, "password = aaaaaaaaaaaaaaaaaaaa")], "id int, text string")
    got = {r["id"]: r["rule"] for r in rules.secrets(df, "id").collect()}
    assert got == dict(enumerate(made))  # and no low-entropy value
    assert rules.load.__doc__


def test_environment_facts_and_transcripts(spark):
    calls = spark.createDataFrame([(1, "pytest -q", "bash: pytest: command not found"), (2, "pytest -q", "zsh: command not found: pytest"), (2, "python -m pytest -q", "3 passed"), (3, "python -m pytest", "ok"), (1, "tsc", "tsc: not found"), (4, "tsc", "done"), (2, "tsc", "tsc: not found")], "session int, command string, output string")
    assert [tuple(r) for r in transcripts.environment_facts(calls).collect()] == [("pytest", 2, "python -m pytest", 2)]
    deep = {"message": {"content": [{"type": "function_call", "call_id": "c", "name": "shell", "arguments": json.dumps({"command": ["ls", "-l"]})}]}}
    got = [r for r in transcripts.flatten(deep) if r[1] == "call"]
    assert got == [("/message/content/0", "call", "c", "shell", "ls -l", None)]


def test_scalars(spark):
    row = spark.createDataFrame([("a\x1b[31mb\x1b[0m", "cargo test --all | tail", "https://user:pw@www.Example.com:80/x?token=1", "a\r\nb\n\n", "src/x.min.js")], "a string, c string, u string, l string, p string").select(
        T.strip_ansi("a"), T.command_label("c"), T.normalize_host("u"), T.normalize_target("u"), T.lines("l"), files.should_index("p"), T.language(F.lit("x/y.TSX")), T.entropy(F.lit("aabb")), T.redact_credentials(F.lit("Authorization: Bearer abc")), T.collapse_redraws(F.lit("10%\r50%\rdone\nx")), T.dominant_eol(F.lit("a\r\nb\r\nc\n"))
    ).first()
    assert list(row) == ["ab", "cargo test", "example.com", "https://www.Example.com:80/x?[REDACTED]", ["a", "b", ""], False, "typescript", 1.0, "[REDACTED]", "done\nx", "\r\n"]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"print(1)\n")
    (tmp_path / "src" / "b.rs").write_bytes("﻿fn x() {}".encode("utf-16"))
    (tmp_path / "src" / "c.py").write_bytes(b"a\0b")
    (tmp_path / ".env").write_bytes(b"x=1")
    got = {r["path"]: (r["lang"], r["text"]) for r in files.repository(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.py", "src/b.rs"} and got["src/a.py"] == ("python", "print(1)\n") and "fn x() {}" in got["src/b.rs"][1]
    log = tmp_path / "log"
    log.mkdir()
    (log / "e.log").write_text('{"ts": 1.0, "tool": "t", "action": "pass", "command": "password=hunter2 x"}\nbroken\n')
    ev = files.event_log(spark, [str(log)])
    assert [(r["tool"], r["phase"]) for r in ev.collect()] == [("t", "pre")]
    files.append_events(ev.drop("log"), str(tmp_path / "out"))
    assert "hunter2" not in spark.read.text(str(tmp_path / "out")).first()[0]


def runs_fixture(spark):
    rng = random.Random(6)
    rows = [(i, f"p{i % 2}", f"c{i % 3}", f"s{rng.randrange(2)}", rng.random() < 0.8, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00") for i in range(600)]
    return spark.createDataFrame(rows, "event_id bigint, project string, command string, signature string, failed boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_streaks_in_batch_and_stream(spark, tmp_path):
    rows = runs_fixture(spark)
    batch = {(r["event_id"], r["n"]) for r in events.failure_streaks(rows).collect()}
    rows.orderBy("ts").coalesce(1).write.json(str(tmp_path / "in"))
    stream = streams.streaks(streams.source(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.format("memory").queryName("streaks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["event_id"], r["n"]) for r in spark.table("streaks").collect()} == batch and batch


def test_sessions_and_outputs_in_stream(spark, tmp_path):
    rows = runs_fixture(spark).where("event_id % 100 < 40").withColumn("digest", F.col("signature"))
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    src = streams.source(spark, str(tmp_path / "in"), rows.schema)
    q = streams.sessions(src, "project").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["project"], r["start"], r["calls"]) for r in spark.table("sessions").collect()}
    w = rows.groupBy("project", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("calls")).select("project", "w.start", "calls")
    whole = {tuple(r) for r in w.collect()}
    assert got <= whole and len(got) >= len(whole) - 2  # the last session of a key is still open
    q = streams.first_outputs(src).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    fine = rows.where("not failed").select("project", "command", "digest").distinct().count()  # failures always pass
    assert spark.table("firsts").count() == rows.where("failed").count() + fine


def test_generic_reduction():
    from weftline.operators import reduce as R

    blob = "iVBORw0KGgo" + "aB3" * 400
    assert R.generic("x " + blob + " y") == f"x [base64 png, {len(blob)} chars omitted] y"
    assert "ab" * 400 in R.generic("hex " + "ab" * 400)
    assert R.generic('{ "b": 1.50,\n "a": [1, 2], "s": "x  y" }') == '{"b":1.50,"a":[1,2],"s":"x  y"}'
    assert R.generic('{"a": 1}\n{"b":  2}\n') == '{"a":1}\n{"b":2}'
    assert R.group_lines("a\na\na\nb") == "a (x3)\nb"
    assert R.group_blocks("h\n" + "x\ny\n" * 4 + "e") == "h\nx\ny\n[block of 2 lines repeated 4 times]\ne"
    long = "start " + "filler words " * 4000 + "some_ident_1234 " + "more words " * 4000 + " end"
    assert R.count(R.ceiling(long)) < 8100 and R.ceiling(long).startswith("start") and R.ceiling(long).endswith("end")
    assert R.generic("10%\r50%\rdone\nok") == "done\nok"
    log = "\n".join(f"commit {i:040x}\nAuthor: a\nDate: d\n\n    message {i}\n" for i in range(20))
    assert R.by_command("cd x && git log -n 20 | cat", log) != log and R.by_command("git log", log).split("\n")[0] == "00000000 message 0"
    ps = "USER PID %CPU COMMAND\n" + "\n".join(f"u {i} {i}.0 c{i}" for i in range(30))
    assert R.by_command("ps aux", ps).split("\n")[1] == "u 29 29.0 c29"
    assert R.group_blocks("\n".join(["a", "b"] * 4 + ["c"] * 300)).startswith("a\nb\n[block of 2 lines repeated 4 times]\nc")
    rng = random.Random(1)
    for _ in range(200):
        t = "\n".join(rng.choice(["a", "b", "", "error x", "path/to/f:3: y", "\x1b[1mz\x1b[0m"]) for _ in range(rng.randint(0, 40)))
        for c in ("git status", "git diff", "grep x", "find .", "ps", "kubectl get pods", "npm install", "terraform plan", "cargo tree", "cargo build"):
            assert len(R.by_command(c, t).encode()) <= len(t.encode())


def test_every_credential_rule_finds_its_form(spark):
    h, a = "0123456789abcdef" * 6, "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9St0Uv" * 6
    forms = {
        "gitlab-runner-token": "GR1348" + "941" + a[:20], "gitlab-pipeline-trigger-token": "glptt" + "-" + h[:40], "gitlab-feed-token": "glft" + "-" + a[:20], "openrouter-key": "sk-or" + "-v1-" + h[:64],
        "replicate-token": "r8" + "_" + a[:37], "groq-key": "gsk" + "_" + a[:40], "perplexity-key": "pplx" + "-" + a[:40], "xai-key": "xai" + "-" + a[:80], "databricks-token": "dapi" + h[:32],
        "stripe-webhook-secret": "whsec" + "_" + a[:32], "shopify-token": "shpat" + "_" + h[:32], "square-access-token": "sq0atp" + "-" + a[:22], "slack-app-token": "xapp" + "-1-A1-2-" + h[:8],
        "telegram-bot-token": "12345678" + ":" + a[:35], "twilio-account-sid": "AC" + h[:32], "mailgun-key": "key" + "-" + h[:32], "mailchimp-key": h[:32] + "-us" + "7", "rubygems-key": "rubygems" + "_" + h[:48],
        "dockerhub-pat": "dckr_pat" + "_" + a[:27], "sonarqube-token": "squ" + "_" + h[:40], "grafana-service-account-token": "glsa" + "_" + a[:32] + "_" + h[:8], "vault-service-token": "hvs" + "." + a[:20],
        "newrelic-user-key": "NRAK" + "-" + a[:27].upper(), "newrelic-license-key": h[:40] + "NRAL", "sentry-dsn": "https://" + h[:32] + "@o1.example.org/12", "datadog-token": "ddap" + "_" + a[:40], "linear-api-key": "lin_api" + "_" + a[:40],
        "notion-token": "ntn" + "_" + a[:43], "airtable-token": "pat" + a[:14] + "." + h[:64], "supabase-token": "sbp" + "_" + h[:40], "planetscale-token": "pscale_pw" + "_" + a[:32], "doppler-token": "dp" + ".pt." + a[:40],
        "age-secret-key": "AGE-SECRET" + "-KEY-1" + a[:58].upper(), "azure-storage-account-key": "AccountKey" + "=" + a[:86] + "==",
    }
    df = spark.createDataFrame(list(forms.items()), "id string, text string")
    found = {(r["id"], r["rule"]) for r in rules.secrets(df, "id").collect()}
    assert {k for k in forms if (k, k) not in found} == set()
    assert rules.secrets(df.select("id", F.lit("plain words, no key").alias("text")), "id").count() == 0
    assert len({r.id for r in rules.SECRET_RULES}) == 63 and len({r.id for r in rules.EGRESS_RULES}) == 18


def test_destinations(spark):
    forms = [("git-remote-https", "git clone https://code.example.org/a/b"), ("docker-registry", "pull ghcr.io/x/y"), ("package-registry", "from pypi.org"), ("aws-endpoint", "https://s3.eu.amazonaws.com/b"),
             ("azure-endpoint", "https://a.blob.core.net/x"), ("npm-install", "npm install https://npm.example.org/x"), ("generic-external-domain", "'https://api.example.org/x'")]
    found = {(r["id"], r["rule"]) for r in rules.egress(spark.createDataFrame(forms, "id string, text string"), "id", "text").collect()}
    assert {(k, k) for k, _ in forms} <= found


def test_retrieve_windows(spark):
    df = spark.createDataFrame([(1, "a\nB\nc\nd\ne"), (2, ""), (3, None)], "id int, text string")

    def got(**how):
        return [r["line"] for r in lines.apply(df, "id", lines.retrieve(**how)).orderBy("id", "pos").collect()]

    assert got() == ["a", "B", "c", "d", "e"]
    assert got(first=2, last=3) == ["2:B", "3:c"] and got(last=1) == ["1:a"] and got(first=9) == []
    assert got(grep="b") == ["2:B"] and got(grep="[B]") == ["2:B"] and got(grep="A") == []
    assert got(head=1, tail=1) == ["a", "[... 3 lines omitted ...]", "e"] and got(head=3, tail=2) == ["a", "B", "c", "d", "e"]
    assert got(head=2) == ["a", "B"] and got(tail=2) == ["d", "e"] and got(head=0, tail=1) == ["[... 4 lines omitted ...]", "e"]
    with pytest.raises(ValueError):
        lines.retrieve(first=3, last=2)


def test_lines_stay_in_their_row(spark):
    """Repeated and null ids: every text is treated by itself; no exchange but the caller's."""
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "x\ny"), (None, "x"), (2, ""), (3, None)], "id int, text string")
    for run in (lines.head_tail(1, 1), lines.failure_first(2), lines.category_caps([("^[ab]", 1)]), lines.block_caps("^a", "^c", 1), lines.runs(), lines.token_budget(100), lines.density(0.5), lines.similar_blocks(), lines.prefix_runs()):
        out = lines.apply(df, "id", run)
        rows = [tuple(r) for r in out.collect()]
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r[0] for r in rows} == {1, None} and sorted(r[1:] for r in rows if r[0] == 1) == sorted(2 * [tuple(r)[1:] for r in lines.apply(df.limit(1), "id", run).collect()])
    assert [r["line"] for r in lines.apply(df.limit(1), "id", lines.head_tail(1, 1)).collect()] == ["a", "[... 1 lines omitted ...]", "c"]
    alike = spark.createDataFrame([(1, "\n".join(["compiling the crate number one", "compiling the crate number two", "compiling the crate number six", "done", "done", "compiling the crate"]))], "id int, text string")
    assert [(r["pos"], r["n"]) for r in lines.apply(alike, "id", lines.prefix_runs()).collect()] == [(1, 3), (4, 1), (5, 1), (6, 1)]


def test_reports(spark):
    nodes = spark.createDataFrame([(1, 'a "x"'), (2, "b<c>"), (3, "unused"), (4, None)], "id int, label string")
    rel = spark.createDataFrame([(1, 2, "r"), (1, 2, "r"), (2, 4, None)], "src int, dst int, reference string")
    text = reports.document(reports.dot(nodes, rel, "t")).head()["text"].split("\n")
    assert text[0] == "digraph relations {" and text[-2:] == ["}", ""] and len(text) == 4 + 3 + 2 + 2
    assert '  N1 [label="a \\"x\\""];' in text and '  N2 -> N4 [label=""];' in text
    chart = reports.document(reports.mermaid(nodes, rel, "t")).head()["text"]
    assert chart.startswith("```mermaid\ngraph LR\n") and "N1[\"a 'x'\"]" in chart and "unused" not in chart
    page = reports.document(reports.html(nodes, rel, "<t>")).head()["text"]
    assert "&lt;t&gt;" in page and page.count("<tr>") == 2 and "b&lt;c&gt;" in page
    empty = reports.document(reports.dot(nodes, rel.limit(0), "t")).head()["text"]
    assert empty.count("\n") == 5


def test_module_labels(spark):
    rows = [("one", "src/a.py")] * 3 + [("one", "src/b.py")] * 2 + [("two", f"src/x/{i}.py") for i in range(5)] + [("three", f"{i}/f{i}.py") for i in range(5)]
    got = {r["module"]: (r["label"], r["size"]) for r in reports.module_labels(spark.createDataFrame(rows, "module string, path string")).collect()}
    assert got == {"one": ("src/a.py", 5), "two": ("src/x/", 5), "three": ("f0.py + f1.py + f2.py +2", 5)}


def test_prompt_weight(spark):
    texts = [("a", "---\nname: fmt\ndescription: formats code\n---\nbody"), ("b", "---\nname: x\ndescription: |\n  one two\n  three\nother: 1\n---\n"), ("c", "plain first\nsecond"), ("d", None)]
    got = {r["f"]: (r["skill"], r["listing"]) for r in prompts.skills(spark.createDataFrame(texts, "f string, text string"), "f", "text").collect()}
    want = {"a": "fmt: formats code", "b": "x: one two three", "c": "c: plain first", "d": "d: "}
    assert got == {k: (v.split(":")[0], -(-len(v) // 4)) for k, v in want.items()}
    servers = spark.createDataFrame([("g", "s1", 3, 2000), ("g", "s2", 4, 1600), ("g", "s3", None, None), ("h", "s4", 1, 10)], "agent string, server string, tools int, tokens int")
    context = spark.createDataFrame([("g", 10), ("i", 9000)], "agent string, tokens int")
    rows = {r["agent"]: r for r in prompts.audit(servers, context, 3000, 2, 50).collect()}
    assert rows["g"]["reasons"] == ["~3600 tool tokens > 3000", "3 servers > 2"] and rows["g"]["advice"][2].startswith("review `s1` first") and len(rows["g"]["advice"]) == 5
    assert not rows["h"]["warn"] and rows["h"]["advice"] == [] and rows["i"]["reasons"] == ["~9000 always-on context tokens > 3000"] and rows["i"]["servers"] == 0


def test_reading_forms():
    from weftline.operators import documents as D

    assert D.clean_markdown("# T\n\n\n* a **b** \\*c\\* <i>d</i> ~~e~~ `f_g`\n***\n| x | y |\n|---|:-:|\n```\n  code [x](y)\n```\n[l](u) ![i](u)!") == "T\n\na b *c* d e f_g\nx  y\ncode [x](y)\nl !"
    code = "// adds\nfn add(\n    a: u8,\n) -> u8 {\n    a\n}\n\nstruct S;\n"
    assert D.signature(code.split("\n"), 2, 6) == "fn add(\n    a: u8,\n) -> u8 {" and D.comment_before(code.split("\n"), 2) == "adds"
    shown = D.outline(code, "a.rs", "rust")
    assert "[a.rs] - 8 lines" in shown and "[function] add: fn add(" in shown and "// adds" in shown
    assert D.read(code, "a.rs", "rust", symbol="AD").startswith("# L2-6 [function] add") and D.read("x\n" * 5, "a.txt", "generic") == "x\n" * 5
    assert D.read("# h\n" * 250, "a.md", "generic").split("\n")[0] == "h"
    long = ["Compiling a"] * 60 + ["[=====================>]"] * 2 + [f"row {i}" for i in range(120)]
    got = D.shorten_long("\n".join(long)).split("\n")
    assert got[:2] == ["Compiling a (59 similar lines)", "[progress bar omitted]"] and len(got) == 61 and "lines omitted" in got[40]
    big = json.dumps({"result": {"content": [{"type": "text", "text": "same\n" * 500}, {"type": "image", "data": "x"}]}})
    assert len(D.tool_result(big)) < 200 and D.tool_result("not json") == "not json" and D.tool_result('{"result": 1}') == '{"result": 1}'


def test_commands_that_are_never_filtered():
    cases = {"git --version": "version", "cargo build -v": None, "node -v": "version", "pytest --help": "help", "make -j 4": None, "jq -j .": "json", "kubectl get x -o yaml": "yaml", "x --log-level=debug": "verbose", "cd /a && npm test --json": "json", "": None}
    assert {c: filters.bypass(c) for c in cases} == cases
    assert filters.find("cat x --json", [filters.BUILT_IN]) is None and filters.find("cat x", [filters.BUILT_IN]).name == "prose"


def test_match_table_lots(spark):
    defs = spark.createDataFrame([(f"f{i}", f"^tool{i}x? run", 1) for i in range(300)] + [("any", "run$", 2), ("alt", "^a|b", 2)], "name string, pattern string, rank int")
    cmds = spark.createDataFrame([(c,) for c in ("tool7x run", "tool7 run", "tool70x run", "do run", "zb")], "command string")
    assert sorted(map(tuple, filters.match_table(cmds, defs).collect())) == [("do run", "any"), ("tool7 run", "f7"), ("tool70x run", "f70"), ("tool7x run", "f7"), ("zb", "alt")]


def test_rotation_and_rename(spark, tmp_path):
    from weftline.sources import stores

    log = str(tmp_path / "events.log")
    assert not stores.rotate(spark, log) and stores.log_generations(spark, log, "a int").count() == 0
    spark.range(10).write.json(log)
    assert not stores.rotate(spark, log) and stores.rotate(spark, log, 1) and stores.log_generations(spark, log, "id bigint").count() == 10
    a = spark.createDataFrame([("n1", "h"), ("n2", "h"), ("n3", "z")], "path string, hash string")
    b = spark.createDataFrame([("o1", "h"), ("o2", "q")], "path string, hash string")
    assert [tuple(r) for r in stores.renames(a, b).collect()] == [("n1", "o1")]
    home = tmp_path / "home" / ".claude" / "projects"
    home.mkdir(parents=True)
    (home / "a.jsonl").write_text("1\n2\n")
    (home / "big.jsonl").write_text("x" * 100)
    (home / "no.bin").write_text("x")
    lines_, told = stores.agent_transcripts(spark, str(tmp_path / "home"), most_bytes=50)
    assert lines_.count() == 2 and [tuple(r) for r in told.collect()] == [("claude", 1, 1)]


def test_modules_by_component(spark):
    edges = [(a, b) for g in (range(4), range(10, 14), range(20, 23)) for a in g for b in g if a < b]
    got = {r["node"]: r["module"] for r in graph.modules(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert len({got[n] for n in range(4)}) == 1 and len(set(got.values())) == 3
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "src int, dst int")
    assert sorted(map(tuple, graph.components(e).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert sorted(map(tuple, graph.dependents(e.union(spark.createDataFrame([(3, 2), (5, 5)], "src int, dst int"))).collect())) == [(2, 3), (3, 3), (5, 1), (8, 1)]
