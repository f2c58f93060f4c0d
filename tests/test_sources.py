"""Sources, checks and texts about code, on small fixtures."""

import subprocess

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import attacks, describe, docs, rules, validate
from corpusmill.operators import diff, graph, parse, scan, summarize
from corpusmill.plans import pipeline
from corpusmill.sources import git, trees

FILES = "file_id long, repo string, path string, content string"


def corpus(spark, *rows):
    return spark.createDataFrame([(i, "r", p, c) for i, (p, c) in enumerate(rows)], FILES)


def test_git_references(spark, tmp_path):
    repo = str(tmp_path / "own")

    def g(*args):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *args], cwd=repo, check=True, capture_output=True)

    (tmp_path / "own").mkdir()
    g("init", "-q", "-b", "main")
    for name, text in (("a.py", "x = 1\n"), ("b.py", "keep\n"), ("c.py", "moved along\n"), ("d.bin", "\0\1")):
        (tmp_path / "own" / name).write_text(text)
    g("add", "-A")
    g("commit", "-qm", "one")
    g("tag", "v1")
    (tmp_path / "own" / "a.py").write_text("x = 2\ny = 3\n")
    (tmp_path / "own" / "c.py").rename(tmp_path / "own" / "c2.py")
    (tmp_path / "own" / "d.bin").write_bytes(b"\0\2")
    g("add", "-A")
    g("commit", "-qm", "two")
    got = {r.path: r for r in git.changes(spark, repo, "v1", "main", binaries=True).collect()}
    assert {p: r.change for p, r in got.items()} == {"a.py": "modified", "c2.py": "renamed", "d.bin": "modified"}
    assert (got["a.py"].additions, got["a.py"].deletions, got["a.py"].content) == (2, 1, "x = 2\ny = 3\n") and got["c2.py"].old_path == "c.py"
    assert got["d.bin"].binary and got["d.bin"].content is None and got["d.bin"].patch is None and got["a.py"].from_ref == "v1"
    assert {r.path for r in git.changes(spark, repo, "v1", "main").collect()} == {"a.py", "c2.py"}
    s = diff.stats(git.changes(spark, repo, "v1", "main", binaries=True)).first()
    assert (s.files, s.additions, s.deletions, s.binary, s.modified, s.renamed) == (3, 2, 1, 1, 2, 1)
    assert git.validate_refs(repo, "v1", "none", "-x", "a..b") == ["none", "-x", "a..b"]
    target = str(tmp_path / "clone")
    read = {r.path for r in git.read_repository(spark, f"file://{repo}", target).collect() if not r.path.startswith(".git/")}
    assert read == {"a.py", "b.py", "c2.py"}
    with pytest.raises(ValueError):
        git.clone("x", target, "--upload-pack=x")
    with pytest.raises(git.GitError):
        git.run("clone", str(tmp_path / "nothing"), str(tmp_path / "t2"))
    assert git.hidden("https://u:secret@h/x failed") == "https://****@h/x failed"


def test_addresses_and_targets(spark):
    rows = [("own/name", "own", "name", None, "shorthand"), ("own/name#dev", "own", "name", "dev", "shorthand"), ("https://h.example/own/name.git", "own", "name", None, "url"), ("https://h.example/own/name/-/tree/v1", "own", "name", "v1", "url"), ("git@h.example:own/name.git", "own", "name", None, "url"), ("./own/name", None, None, None, "path"), ("/abs/x", None, None, None, "path"), ("plain", None, None, None, "path")]
    df = spark.createDataFrame([(r[0],) for r in rows], "a string")
    got = [tuple(r) for r in df.select("a", git.address_parts("a").alias("p"), git.target_kind("a").alias("k")).select("a", "p.owner", "p.name", "p.ref", "k").collect()]
    for r, g in zip(rows, got):
        assert g[4] == r[4] and (r[4] == "path" or g == r)


def test_trees_of_one_file_and_what_is_left_out(spark, tmp_path):
    (tmp_path / "a.py").write_text("x\n")
    (tmp_path / "big.py").write_text("y" * 100)
    (tmp_path / "b.bin").write_bytes(b"\0")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.js").write_text("z")
    assert [(r.path, r.content) for r in trees.read_tree(spark, str(tmp_path / "a.py")).collect()] == [("a.py", "x\n")]
    assert {r.path for r in trees.read_tree(spark, str(tmp_path), max_bytes=50, prune=True).collect()} == {"a.py"}
    assert {(r.path, r.reason) for r in trees.left_out(spark, str(tmp_path), max_bytes=50).collect()} == {("big.py", "too_large"), ("b.bin", "binary")}
    docs_ = trees.documents(corpus(spark, ("a.MD", "x"), ("b.py", "y"))).collect()
    assert [(r.path, r.doc_type) for r in docs_] == [("a.MD", "md")]
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/e.py", "1")
    assert (tmp_path / "out").exists() is False and trees.unzip(str(tmp_path / "z.zip"), str(tmp_path / "out")) and (tmp_path / "out" / "d" / "e.py").read_text() == "1"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../e.py", "1")
    with pytest.raises(ValueError):
        trees.unzip(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_checks(spark):
    df = spark.createDataFrame([("Python", b"abc"), ("py;rm", b"\x80\x80\x80a"), ("__x", b"a\x00"), ("", bytes([0xE9] * 2 + [65] * 98)), (None, b"\x01\x02\xff")], "l string, b binary")
    got = df.select(validate.language_allowed("l"), validate.binary_by_share("b"), validate.binary_by_control("b")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (False, True, True), (False, False, False), (False, True, True)]
    u = spark.createDataFrame([("https://a.b/c?d",), ("ftp://a",), ("https://a b",), (None,)], "u string")
    assert [r[0] for r in u.select(validate.url_allowed("u")).collect()] == [True, False, False, False]
    n = spark.createDataFrame([("a/b:c",), ("..x",), (" ",)], "n string")
    assert [r[0] for r in n.select(validate.clean_filename("n")).collect()] == ["a_b_c", "x", "unnamed"]
    assert validate.conforms(corpus(spark, ("a", "b")), "files") == [] and validate.conforms(df, "issues") == ["file_id missing", "line_number missing", "severity missing"]
    validate.register_schema("own", {"l": "int"})
    assert validate.conforms(df, "own") == ["l is string, not int"]
    for bad in ("(a+)+", "x" * 2000, "(", "(a*)*b"):
        with pytest.raises(ValueError):
            rules.checked_regex(bad)
    assert rules.checked_regex(r"(?:ab)+c\d{2,}") and scan.severity_level("nonsense") == 2 and scan.severity_level("high") == 3


def test_texts_about_code(spark):
    assert [describe.in_string("a = 'b\\'c' + \"d\"", k) for k in (2, 6, 9, 11, 15)] == [False, True, True, False, True]
    assert describe.window_calls("SELECT 1,\n rank() OVER (ORDER BY a), sum(x) over w")[0][:2] == ("rank", 2)
    types = describe.graphql_types('type Q implements N {\n  # no\n  user(id: ID!, n: Int): [User!]! @auth\n  n: Int\n}\ntype User { q: Q }\nenum E { A\n B }\nunion U = Q | User\n')
    assert ("Q", "type", "user", "[User!]!", ["id", "n"]) in types and ("E", "enum", "B", None, []) in types and ("U", "union", "User", "User", []) in types
    df = spark.createDataFrame([(o, f, t) for o, _, f, t, _ in types if t], "owner string, field string, type string")
    e = graph.type_edges(df)
    assert {(r.owner, r.target) for r in e.collect()} == {("Q", "User"), ("User", "Q"), ("U", "Q"), ("U", "User")} and {r.owner for r in graph.referring(e, "Q").collect()} == {"User", "U"}
    one = spark.createDataFrame([(["os", "a"], "```x")], "i array<string>, c string").select(describe.file_text(F.lit("a.py"), F.lit("python"), imports=F.col("i"), issues=F.array().cast("array<string>")), describe.prompt("{CODE}!", CODE="c")).first()
    assert one[0] == "**File:** `a.py`\n**Language:** `python`\n**Imports (2):** `a, os`" and "```" not in one[1]
    chat = spark.createDataFrame([(1, "user", "hello you"), (1, "assistant", "yes")], "conv_id long, role string, text string")
    assert tuple(describe.chat_tokens(chat).first()) == (1, 2, 3 + 3 + 1 + 2 + 3 + 1 + 1)
    sol = spark.createDataFrame([("assembly { } x.call{value: 1}(); selfdestruct(a);",)], "t string").select(*describe.feature_counts("t", "solidity")).first()
    assert (sol.assembly_block, sol.external_call, sol.selfdestruct_call, sol.suicide_call) == (1, 1, 1, 0)


def test_documentation_comments():
    assert docs.clean("/** Reads it.\n * <summary>x</summary>\n */") == "Reads it.\nx"
    assert docs.tags("Text\n@param {string} a - the a\n  more\n@returns nothing") == [("param", "string", "a", "the a more"), ("returns", None, None, "nothing")]
    assert docs.above(["// one", "// two", "@dec", "fn()"], 3) == "one\ntwo" and docs.above(["x", "fn()"], 1) is None
    assert docs.inline("x = 1  # why", "x = 1       ") == "why"
    assert [docs.canonical(k, w) for k, w in (("Fn", None), ("object", "scala"), ("trait", "rust"), ("class", None))] == ["function", "module", "interface", "class"]
    assert parse.indent_end(["def f():", "    a", "", "    # c", "    b", "c"], 0) == 4


def test_attack_rules_agree_in_both_dialects(spark):
    df = corpus(spark, ("a.py", "hashlib.md5 (x)\nhashlib.md5 (x)\nyaml.load(a)\r\n"), ("b.py", "hashlib.sha1(\n"))
    counts = {r.rule: r.matches for r in scan.attack_counts(df).collect()}
    places = {r["rule"]: r["count"] for r in scan.attacks(df).groupBy("rule").count().collect()}
    assert counts == places == {"python_weak_crypto": 2, "python_yaml_load": 1}
    assert scan.attacks(df).first().message in {r.message for r in attacks.ATTACK_RULES}


def test_dangerous_families_by_literal_examples(spark):
    rows = ["require( 'child_process')", "SELECT a FROM b ", "../x", "{{ a }}", "password = 'abcdefgh'", "A" * 40, "plain"]
    got = scan.dangerous(corpus(spark, *((f"{i}", r) for i, r in enumerate(rows)))).orderBy("file_id").collect()
    assert [[k for k in ("exec_patterns", "sql_injection", "path_traversal", "template_injection", "secrets_pattern", "base64_pattern") if r[k]] for r in got] == [[], ["sql_injection"], ["path_traversal"], ["template_injection"], ["secrets_pattern"], ["base64_pattern"], []]
    red = [r[0] for r in corpus(spark, *((f"{i}", r) for i, r in enumerate(rows))).orderBy("file_id").select(scan.redacted("content")).collect()]
    assert red[4] == 'password = "[REDACTED]"' and red[2].endswith("x") and red[6] == "plain"


def test_external_scanner(spark, tmp_path):
    tool = tmp_path / "tool.py"
    tool.write_text('import json,sys\nprint(json.dumps({"results": [{"check_id": "r1", "start": {"line": 2}, "extra": {"severity": "ERROR", "message": "m"}}]} if "bad" in open(sys.argv[1]).read() else {"results": []}))\n')
    import sys

    got = scan.external(corpus(spark, ("a.py", "bad"), ("b.py", "ok"), ("c.py", None)), [sys.executable, str(tool)]).collect()
    assert [(r.file_id, r.rule_id, r.severity, r.line_number) for r in got] == [(0, "r1", 3, 2)]
    assert scan.external(corpus(spark, ("a.py", "x")), ["no-such-tool"]).first().error


def test_summaries_of_functions_and_projects(spark, tmp_path):
    df = corpus(spark, ("a.py", "def f():\n    a = 1\n    b = 2\n    return a\n\ndef g(): pass\n"))
    got = summarize.bodies(df, parse.declarations(df)).collect()
    assert [(r.name, r.code) for r in got] == [("f", "def f():\n    a = 1\n    b = 2\n    return a")]
    said = spark.createDataFrame([("b.py", "two"), ("a.py", "one")], "path string, summary string")
    tree = spark.createDataFrame([("a.py", "├── a.py")], "node string, line string")
    assert "a.py: one\nb.py: two" in summarize.overview(said, tree, lambda p: p)
    summarize.write(spark.createDataFrame([(1, "x")], "file_id long, summary string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1

    @summarize.provider("upper")
    def upper(prompt):
        return prompt.upper()

    assert summarize.PROVIDERS["upper"]("a") == "A"


def test_settings_in_layers(tmp_path):
    (tmp_path / "c.json").write_text('{"level": "high", "excludes": ["a/**"], "extensions": {"foo": "python"}}')
    s = pipeline.Spec.from_file(str(tmp_path / "c.json"), "lean", format="json")
    assert (s.level, s.excludes, s.format, s.compress, s.extensions) == ("high", ("a/**",), "json", True, (("foo", "python"),))
    assert dict(s.provenance)["level"].endswith("c.json") and dict(s.provenance)["compress"] == "preset lean"
    for bad in ({"nonsense": 1}, {"format": "pdf"}):
        with pytest.raises(ValueError):
            pipeline.Spec.of(None, **bad)


def test_command_line(spark, tmp_path, capsys):
    from corpusmill.__main__ import main

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.py").write_text("def f():\n    return 1\n")
    assert main(["formats"]) == 0 and main(["languages"]) == 0 and "py python parsed" in capsys.readouterr().out
    assert main(["init", str(tmp_path / "c.json"), "--preset", "full"]) == 0 and main(["validate", str(tmp_path / "c.json")]) == 0
    assert "level: " in capsys.readouterr().out
    assert main(["diagnose", str(tmp_path / "s")]) == 0 and "syntax_tree" in capsys.readouterr().out
    assert main(["run", str(tmp_path / "s"), str(tmp_path / "o"), "--config", str(tmp_path / "c.json"), "--whole"]) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert "# Corpus report" in text and "def f():" in text
    assert main(["reconstruct", str(tmp_path / "o"), str(tmp_path / "b")]) == 0 and "written" in capsys.readouterr().out
