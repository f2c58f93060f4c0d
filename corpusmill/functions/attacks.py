"""Attack rules by language, matched over whole contents. Names, patterns, severities, messages and CWE ids are fixed values."""

from __future__ import annotations

from corpusmill.functions.rules import Rule

_C, _PY, _R, _JL, _GO, _PHP, _RS, _JS, _ALL = ("c", "cpp"), ("python",), ("r",), ("julia",), ("go",), ("php",), ("rust",), ("javascript", "typescript"), ("all",)

ATTACK_RULES = (
    Rule("buffer_overflow_strcpy", r"(?i)\b(strcpy|strcat|sprintf|gets)\s*\(", "Dangerous function that can cause buffer overflow", 4, 0, _C, "CWE-120"),
    Rule("format_string_vulnerability", r'(?i)(printf|fprintf|sprintf|syslog)\s*\(\s*[^"]\w+\s*\)', "Potential format string vulnerability", 3, 0, _C, "CWE-134"),
    Rule("command_injection_c", r'(?i)\b(system|popen|execl|execle|execlp|execv|execvp)\s*\([^"]+\)', "Potential OS command injection", 4, 0, _C, "CWE-78"),
    Rule("use_after_free", r"(?ms)free\s*\([^)]+\).*?\n.*?(?:->|\*)", "Potential use after free vulnerability", 3, 0, _C, "CWE-416"),
    Rule("integer_overflow", r"(?i)(malloc|calloc|realloc)\s*\([^)]*[+*][^)]*\)", "Potential integer overflow in memory allocation", 3, 0, _C, "CWE-190"),
    Rule("python_eval_injection", r"""(?i)\beval\s*\([^"']*(?:user_input|request\.|input\(|argv|f["']|%|\+)[^)]*\)""", "Dangerous use of eval() with potential code injection", 4, 0, _PY, "CWE-95"),
    Rule("python_exec_injection", r"""(?i)\bexec\s*\([^"']*(?:user_|input|another_|request\.|argv|f["']|%|\+)[^)]*\)""", "Dangerous use of exec() with potential code injection", 4, 0, _PY, "CWE-95"),
    Rule("python_pickle_deserialization", r"(?i)pickle\.(loads?|Unpickler)\s*\(", "Insecure deserialization using pickle", 3, 0, _PY, "CWE-502"),
    Rule("python_yaml_load", r"(?i)yaml\.load\s*\([^,)]+\)", "Unsafe yaml.load() - use yaml.safe_load() instead", 3, 0, _PY, "CWE-502"),
    Rule("python_sql_injection", r"""(?is)(execute|executemany|query)\s*\([^)]*["'].*?["'].*?[+%].*?(user_|request\.|input\(|argv|\$|f["'])""", "Potential SQL injection via string concatenation", 4, 0, _PY, "CWE-89"),
    Rule("python_command_injection", r"""(?i)(os\.system|subprocess\.(call|Popen|run))\s*\([^)]*(?:user_|cmd|command|input|request\.|argv|[+%]|f["'])""", "Potential command injection", 4, 0, _PY, "CWE-78"),
    Rule("python_weak_crypto", r"(?i)hashlib\.(md5|sha1)\s*\(", "Use of weak cryptographic hash function", 2, 0, _PY, "CWE-327"),
    Rule("r_eval_parse_injection", r'(?i)eval\s*\(\s*parse\s*\(\s*text\s*=\s*[^")]+\)\s*\)', "Dangerous use of eval(parse()) with potential code injection", 4, 0, _R, "CWE-95"),
    Rule("r_system_command_injection", r"(?i)system\s*\(\s*paste0?\s*\(", "Potential command injection via system() with paste()", 4, 0, _R, "CWE-78"),
    Rule("r_sql_injection", r"(?is)dbGetQuery\s*\([^,)]+,\s*[^,)]+(?:paste|sprintf|paste0)\s*\(", "Potential SQL injection via string concatenation", 4, 0, _R, "CWE-89"),
    Rule("r_unsafe_rds_load", r'(?i)readRDS\s*\(\s*[^")]+\)', "Loading RDS from potentially untrusted source", 2, 0, _R, "CWE-502"),
    Rule("r_source_injection", r'(?i)source\s*\(\s*[^")]+\)', "Loading R code from potentially untrusted source", 3, 0, _R, "CWE-829"),
    Rule("julia_eval_injection", r'(?i)eval\s*\(\s*Meta\.parse\s*\([^")]+\)\s*\)', "Dangerous use of eval(Meta.parse()) with potential code injection", 4, 0, _JL, "CWE-95"),
    Rule("julia_unsafe_ccall", r'(?i)ccall\s*\(\s*\([^,]+,\s*[^")]+\)', "Unsafe ccall with dynamic library name", 3, 0, _JL, "CWE-426"),
    Rule("julia_command_injection", r"(?i)run\s*\(\s*`[^`]*\$", "Potential command injection via run() with interpolation", 4, 0, _JL, "CWE-78"),
    Rule("julia_include_injection", r'(?i)include\s*\(\s*[^")]+\)', "Including code from potentially untrusted source", 3, 0, _JL, "CWE-829"),
    Rule("go_sql_injection", r"(?i)(Query|Exec|QueryRow)\s*\([^)]*[+].*?\)", "Potential SQL injection via string concatenation", 4, 0, _GO, "CWE-89"),
    Rule("go_command_injection", r"(?i)exec\.Command\s*\([^)]+\)", "Potential command injection via exec.Command", 4, 0, _GO, "CWE-78"),
    Rule("go_path_traversal", r'(?i)(ioutil\.ReadFile|os\.Open)\s*\([^")]+\)', "Potential path traversal vulnerability", 3, 0, _GO, "CWE-22"),
    Rule("go_weak_random", r"(?i)math/rand\.", "Use of weak random number generator - use crypto/rand for security", 2, 0, _GO, "CWE-338"),
    Rule("go_template_injection", r'(?i)template\.(HTML|JS|URL)\s*\([^")]+\)', "Potential template injection vulnerability", 3, 0, _GO, "CWE-94"),
    Rule("php_sql_injection", r"""(?i)(mysql_query|mysqli_query|pg_query|PDO::query)\s*\([^)]*["'].*\s*\.\s*\$\w+""", "SQL injection via direct user input concatenation", 4, 0, _PHP, "CWE-89"),
    Rule("php_command_injection", r"(?i)(system|exec|shell_exec|passthru|eval)\s*\([^)]*\$_(GET|POST|REQUEST)", "Command injection via user input", 4, 0, _PHP, "CWE-78"),
    Rule("php_file_inclusion", r"(?i)(include|require|include_once|require_once)\s*\([^)]*\$_(GET|POST|REQUEST)", "Remote/Local file inclusion vulnerability", 4, 0, _PHP, "CWE-98"),
    Rule("php_unserialize", r"(?i)unserialize\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)", "Unsafe deserialization of user input", 4, 0, _PHP, "CWE-502"),
    Rule("php_xss", r"(?i)echo\s+[^;]*\$_(GET|POST|REQUEST)", "Potential XSS via direct echo of user input", 3, 0, _PHP, "CWE-79"),
    Rule("rust_unsafe_unwrap", r"(?i)\.unwrap\(\)|\.expect\(", "Use of unwrap/expect can cause panic - consider proper error handling", 2, 0, _RS, "CWE-248"),
    Rule("rust_unsafe_transmute", r"(?i)mem::transmute", "Use of unsafe transmute can violate memory safety", 3, 0, _RS, "CWE-704"),
    Rule("rust_unsafe_raw_pointer", r"(?i)\*\s*(mut|const)\s+\w+", "Use of raw pointers requires careful validation", 3, 0, _RS, "CWE-787"),
    Rule("rust_static_mut", r"(?i)static\s+mut\s+\w+", "Mutable static variables can cause race conditions", 3, 0, _RS, "CWE-362"),
    Rule("js_dom_xss", r"""(?i)\.(innerHTML|outerHTML)\s*=\s*[^"'`]""", "Potential DOM XSS via innerHTML/outerHTML", 3, 0, _JS, "CWE-79"),
    Rule("js_eval_injection", r'(?i)\beval\s*\([^")]+\)', "Use of eval() with potential code injection", 4, 0, _JS, "CWE-95"),
    Rule("js_prototype_pollution", r"""(?i)(\[["'`]?(__proto__|prototype|constructor)["'`]?\]|\.__proto__|\.(prototype|constructor))\s*=""", "Potential prototype pollution vulnerability", 3, 0, _JS, "CWE-1321"),
    Rule("js_command_injection", r'(?i)child_process\.(exec|spawn)\s*\([^")]+[+`]', "Potential command injection in child_process", 4, 0, _JS, "CWE-78"),
    Rule("js_sql_injection", r"(?i)(query|execute)\s*\([^)]*[+`][^)]*\$\{", "Potential SQL injection via template literals", 4, 0, _JS, "CWE-89"),
    Rule("js_react_dangerously_set_html_xss", r"(?i)dangerouslySetInnerHTML\s*=\s*\{\s*\{", "Use of dangerouslySetInnerHTML can lead to XSS", 3, 0, _JS, "CWE-79"),
    Rule("hardcoded_secret_key", r"""(?i)(secret[_-]?key|api[_-]?key|private[_-]?key)\s*[:=]\s*["'][^"']{10,}["']""", "Hardcoded secret key detected", 3, 0, _ALL, "CWE-798"),
    Rule("base64_obfuscation", r"[A-Za-z0-9+/]{50,}={0,2}", "Large base64 encoded string detected - possible obfuscation", 0, 0, _ALL, "CWE-506"),
    Rule("cryptocurrency_wallet", r"(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,62}|0x[a-fA-F0-9]{40}|4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}", "Cryptocurrency wallet address detected", 2, 0, _ALL, None),
    Rule("suspicious_ip_address", r"\b(?:192\.168|10\.|172\.(?:1[6-9]|2[0-9]|3[01]))\.\d{1,3}\.\d{1,3}\b", "Private IP address detected - verify if intentional", 0, 0, _ALL, None),
)
