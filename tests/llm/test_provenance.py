"""Files by how they came about."""

import random

from corpusmill.llm import provenance

random.seed(7)
HAND = "".join(f"def {a}_{b}(items, total):\n    # {a} the {b} of the items\n    return items.{a}(total)\n\n" for a in ("load", "merge", "split", "trim") for b in ("table", "window", "report", "index"))
MINIFIED = "!function(t,n){" + ";".join(f"var {chr(97 + i % 26)}{chr(97 + (i * 7) % 26)}=t.{chr(97 + i % 25)}({i});function {chr(98 + i % 24)}{chr(99 + i % 22)}(a,b){{return a?b[{i}]:n(a)}}" for i in range(60)) + "}(window);\n"
TEMPLATE = "import os\n" + "".join(f"def get_field_{i:02d}(msg):\n    return msg.fields[{i}]\n\n" for i in range(20))
DATA = "TABLE = [\n" + "".join("    " + ", ".join(f"0x{random.randrange(256):02x}" for _ in range(12)) + ",\n" for _ in range(30)) + "]\n"
PACKAGE = "# pack 1.2.3\n" + "".join(f"def helper_{w}(value):\n    result = value * {i}\n    return result + len('{w}')\n\n" for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta".split()))


def test_verdicts(spark, files):
    js = HAND.replace("def ", "function ").replace("# ", "// ").replace("):\n", ") {\n").replace(")\n\n", ")\n}\n\n")
    rows = [(i, f"h{i}.py", HAND) for i in range(5)] + [(100 + i, f"h{i}.js", js) for i in range(40)]
    rows += [
        (20, "dist/a.js", MINIFIED), (21, "x_pb2.py", TEMPLATE), (22, "tables.py", DATA), (23, "lib/pack.py", PACKAGE.replace("1.2.3", "1.2.4") + "# patched\n"), (24, "gen.py", "# Code generated by tool v1. DO NOT EDIT.\n" + HAND), (25, "lock.json", '{"lockfileVersion": 1, "p": {"a": {"integrity": "x"}, "b": {"integrity": "y"}}}'),
        (26, "hand.py", "# Emits the DO NOT EDIT banner that the writer puts on top.\n" + HAND), (27, "vendor/own.py", HAND), (28, "n.py", None), (29, "e.py", ""), (30, "b.py", "\x00\x01"), (31, "t.py", HAND + "# Diese Datei wurde automatisch von x erzeugt und darf nicht geändert werden.\n"), (21, "x_pb2.py", TEMPLATE),
    ]
    upstream = spark.createDataFrame([(1, PACKAGE, "clash"), (2, None, "clash")], "upstream_id int, content string, repo string")
    got = {r.file_id: r.verdict for r in provenance.scored(files(*rows), upstream).collect() if r.verdict}
    assert got == {20: "minified", 21: "generated", 22: "data", 23: "vendored", 24: "generated", 25: "generated", 31: "generated"}
    assert sorted(r.file_id for r in provenance.found(files(*rows), upstream.limit(0)).collect()) == [20, 21, 22, 24, 25, 31]
    assert provenance.found(files((1, "a.py", "")).limit(0), upstream).count() == 0
    signals = {r.file_id: r.signal for r in provenance.scored(files(*rows), upstream).collect() if r.verdict}
    assert signals == {20: "entropy", 21: "diversity", 22: "diversity", 23: "shared text", 24: "banner", 25: "diversity", 31: "banner"}
    long = spark.createDataFrame([(k, f"other text of a package number {k} with words {k}", "x") for k in range(3, 40)] + [(1, PACKAGE, "x")], "upstream_id int, content string, repo string")
    small = {r.file_id: (r.verdict, r.upstream_id) for r in provenance.scored(files(*rows), long, block_chars=500).collect() if r.verdict}
    assert small[23] == ("vendored", 1) and set(small) == set(got)


def test_banner_after_a_long_head_but_not_inside():
    from corpusmill.llm import lexers

    text = "".join(f"# licence line {i}\n" for i in range(40)) + "import os\n# Code generated by tool. DO NOT EDIT.\ndef f():\n    pass\n"
    assert provenance.banner("python", text, lexers.scan("python", text).spans)
    inside = "import os\n" + "def f():\n    pass\n" * 30 + "    # DO NOT EDIT\n" + "x = 1\n" * 30
    assert not provenance.banner("python", inside, lexers.scan("python", inside).spans)


def test_entropy_separates_mangled_names():
    rows = {}
    for n in ("load_table", "merge_table", "load_window", "merge_window"):
        for g in provenance._grams(n):
            rows[g] = rows.get(g, 0) + 50
    m = provenance.Model([("python", g, n) for g, n in rows.items()])
    assert m.entropy("python", {"load_window"}) < 2 < 4 < m.entropy("python", {"qz", "xk"})
