"""One text for each attack rule that it must find, and one place check."""

from corpusmill.functions.attacks import ATTACK_RULES
from corpusmill.operators import scan

ENDING = {"c": "c", "python": "py", "r": "r", "julia": "jl", "go": "go", "php": "php", "rust": "rs", "javascript": "js", "all": "md"}
HITS = {
    "buffer_overflow_strcpy": "strcpy(a, b);", "format_string_vulnerability": "printf( msg );", "command_injection_c": "system(cmd);", "use_after_free": "free(p);\nx = p->y;", "integer_overflow": "malloc(n * 4);",
    "python_eval_injection": "eval(request.body)", "python_exec_injection": "exec(a + b)", "python_pickle_deserialization": "pickle.loads(x)", "python_yaml_load": "yaml.load(f)", "python_sql_injection": "db.execute('select ' 'x' + user_id)", "python_command_injection": "os.system(cmd)", "python_weak_crypto": "hashlib.md5(x)",
    "r_eval_parse_injection": "eval(parse(text = x))", "r_system_command_injection": "system(paste0('a', b))", "r_sql_injection": "dbGetQuery(con, paste('a', b))", "r_unsafe_rds_load": "readRDS(path)", "r_source_injection": "source(path)",
    "julia_eval_injection": "eval(Meta.parse(s))", "julia_unsafe_ccall": "ccall((:f, lib), Int)", "julia_command_injection": "run(`ls $x`)", "julia_include_injection": "include(path)",
    "go_sql_injection": "db.Query(a + b)", "go_command_injection": "exec.Command(name)", "go_path_traversal": "os.Open(path)", "go_weak_random": 'import "math/rand."', "go_template_injection": "template.HTML(x)",
    "php_sql_injection": "mysql_query(\"a\" . $b", "php_command_injection": "system($_GET['a'])", "php_file_inclusion": "include($_GET['a'])", "php_unserialize": "unserialize($_POST['a'])", "php_xss": "echo $_GET['a']",
    "rust_unsafe_unwrap": "x.unwrap()", "rust_unsafe_transmute": "mem::transmute(x)", "rust_unsafe_raw_pointer": "*mut u8", "rust_static_mut": "static mut X",
    "js_dom_xss": "a.innerHTML = b", "js_eval_injection": "eval(x)", "js_prototype_pollution": "a.__proto__ = b", "js_command_injection": "child_process.exec(a + b)", "js_sql_injection": "query(`${a}` + `${b}`)", "js_react_dangerously_set_html_xss": "dangerouslySetInnerHTML={{ __html: x }}",
    "hardcoded_secret_key": "api_key = 'abcdefghijk'", "base64_obfuscation": "a" * 50, "cryptocurrency_wallet": "0x" + "a" * 40, "suspicious_ip_address": "at 192.168.1.1 now",
}


def test_every_rule(spark):
    assert set(HITS) == {r.name for r in ATTACK_RULES} and len(HITS) == 45
    rows = [(i, "r", f"{r.name}.{ENDING[r.languages[0]]}", "\n " + HITS[r.name]) for i, r in enumerate(ATTACK_RULES)]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, content string")
    got = {(r.file_id, r.rule): (r.line_no, r.column) for r in scan.attacks(df).collect()}
    assert all((i, r.name) in got for i, r in enumerate(ATTACK_RULES))
    assert got[(0, "buffer_overflow_strcpy")] == (2, 2)
    assert {r.rule for r in scan.attack_counts(df).collect()} >= set(HITS)
    other = spark.createDataFrame([(1, "r", "a.java", "strcpy(a, b); x.unwrap()"), (2, "r", "b.c", None)], df.schema)
    assert scan.attacks(other).count() == 0


def test_command_line(spark, tmp_path, capsys):
    from corpusmill.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.go").write_text("package b\n")
    assert main(["run", str(tmp_path / "src"), str(tmp_path / "doc"), "--exclude-language", "go"]) == 0
    assert main(["reconstruct", str(tmp_path / "doc"), str(tmp_path / "back")]) == 0
    assert (tmp_path / "back" / "a.py").read_text() == "x = 1\n" and not (tmp_path / "back" / "b.go").exists()
    assert main(["formats"]) == 0 and "xml" in capsys.readouterr().out
