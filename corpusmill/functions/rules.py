"""Rules of the line scanner, as data. Patterns, names and severities are fixed values.

The word borders of aws_secret_access_key and generic_password are meant as borders (elsewhere a backspace stands in their place); severity runs from 0 (info) to 4 (critical); ``group`` is
the group that holds the finding; one of the ``hints`` stands on every line that a rule matches (those in small
letters in any case), so that few lines are ever tried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    message: str
    severity: int
    group: int = 0
    languages: tuple[str, ...] = ("all",)
    cwe: str | None = None
    hints: tuple[str, ...] = ()


SECRET_RULES = (
    Rule("aws_access_key_id", r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])", "AWS Access Key ID", 4),
    Rule("aws_secret_access_key", r"(?i)\baws[_\-\s]+secret[_\-\s]+(?:access[_\-\s]+)?key[\"\s:=]+[\"]?([A-Za-z0-9/+=]{40})[\"\s]?", "AWS Secret Access Key", 4, 1),
    Rule("generic_api_key", r"(?i)\b(?:api_key|apikey|api-key|key-id|key_id|secret_key|secret-key)[\"'\s:=]+[\"']?([a-zA-Z0-9\-._/+=]{16,})[\"']?", "Generic API Key", 3, 1),
    Rule("generic_password", r"(?i)\b(?:password|pwd|pass|passphrase|secret)[\"'\s:=]+[\"']?([a-zA-Z0-9!@#$%^&*()_\+-]{12,})[\"']?", "Generic Password", 3, 1),
    Rule("private_key_pem", r"-----BEGIN (?:(?:EC|RSA|DSA|PGP|OPENSSH)\s+)?PRIVATE KEY-----", "Private Key (PEM Format)", 4),
    Rule("github_token", r"(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36,}", "GitHub Token", 4),
    Rule("slack_token", r"xox[pboa]r?-[0-9a-zA-Z]{10,48}", "Slack Token", 4),
    Rule("google_api_key", r"AIza[0-9A-Za-z\-_]{35}", "Google API Key", 4),
    Rule("heroku_api_key", r"[hH]eroku[a-zA-Z0-9]{32}", "Heroku API Key", 4),
    Rule("slack_webhook_url", r"https://hooks.slack.com/services/[A-Za-z0-9_/-]+", "Slack Webhook URL", 4),
    Rule("stripe_secret_key", r"sk_live_[0-9a-zA-Z]{24}", "Stripe Secret Key", 4),
    Rule("twilio_api_key", r"SK[0-9a-fA-F]{32}", "Twilio API Key", 4),
    Rule("jwt_token", r"eyJ[a-zA-Z0-9\-]+?\.[a-zA-Z0-9\-]+?\.[a-zA-Z0-9\-]+", "JWT Token", 3),
    Rule("openssh_private_key", r"-----BEGIN OPENSSH PRIVATE KEY-----", "OpenSSH Private Key", 4),
    Rule("facebook_access_token", r"EAACEdEose0cBA[0-9A-Za-z]+", "Facebook Access Token", 4),
    Rule("aws_session_token", r"(?i)aws_session_token[\"\s:=]+[\"]?([A-Za-z0-9/+=]{16,})[\"\s]?", "AWS Session Token", 4, 1),
    Rule("azure_storage_key", r"(?i)DefaultEndpointsProtocol=https;AccountName=[a-z0-9]+;AccountKey=[A-Za-z0-9+/=]+;EndpointSuffix=core.windows.net", "Azure Storage Key", 4),
)

#: Families of dangerous content. Fixed values.
DANGEROUS = {
    "exec_patterns": r"\b(exec|eval|system|popen|subprocess\.call|subprocess\.Popen|os\.system|child_process\.exec|require\(\s*[\"']child_process[\"']\)|Runtime\.exec|Process\.start|os\.popen|ShellExecute|WScript\.Shell)\b",
    "sql_injection": r"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*?(FROM|INTO|TABLE|DATABASE)\s+",
    "path_traversal": r"\.\./|\.\\|\x00|/etc/passwd",
    "template_injection": r"\{\{.+?\}\}|\$\{.+?\}|<%= .+? %>",
    "secrets_pattern": r"(?i)(password|passwd|pwd|secret|api[-_]?key|access[-_]?key|auth[-_]?token|credential|secret[-_]?key|private[-_]?key)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
    "base64_pattern": r"[A-Za-z0-9+/]{40,}={0,2}",
}

#: Named line patterns of the compressor. Fixed values.
LINE_PATTERNS = {
    "database": r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|query|execute|fetch|commit|rollback|transaction|db\.|cursor|connection|session)\b",
    "api": r"(?i)\b(request|requests\.|fetch|axios|http|https|api|endpoint|REST|GraphQL|gRPC|get|post|put|patch|delete|head)\b",
    "error_handling": r"\b(try|catch|except|finally|raise|throw|throws|error|Error|Exception|assert|require|validate|check)\b",
    "security": r"\b(auth|Auth|token|Token|password|Password|secret|Secret|key|Key|encrypt|decrypt|hash|salt|jwt|JWT|oauth|OAuth|permission|role|sanitize|escape|validate)\b",
    "async": r"\b(async|await|promise|Promise|then|catch|finally|setTimeout|setInterval|callback|emit|on|once)\b",
    "testing": r"\b(test|Test|spec|Spec|describe|it|expect|assert|should|mock|Mock|stub|spy|fixture)\b",
    "config": r"(?i)\b(config|Config|setting|Setting|env|ENV|environment|Environment|option|Option)\b",
}
IMPORT_LINE = r"^\s*(import|from\s+.*\s+import|#include|using\s+|require)"
FLOW_LINE = r"\b(if|else|elif|for|while|switch|case)\b"


def combined(rules=SECRET_RULES) -> str:
    """One alternation that any line with a finding matches; the per-rule work runs on its survivors only."""
    return "|".join(f"(?:{r.regex})" for r in rules)


MAX_REGEX = 1000
#: A quantified group that ends in a quantifier, or repeats alternatives of one form: patterns that may take exponential time.
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*]\)[+*{]|\((?:[^()\\]|\\.)*[+*]\)\?[+*]|\((\w)\|\1\)[+*]")


def checked_regex(pattern: str) -> str:
    """The pattern, or ValueError if it is too long, does not compile or nests quantifiers."""
    if len(pattern) > MAX_REGEX:
        raise ValueError(f"pattern longer than {MAX_REGEX} characters")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern: {e}") from None
    if _NESTED.search(pattern):
        raise ValueError("pattern with nested quantifiers")
    return pattern


#: Literals of which each match holds one, by rule.
_HINTS = {
    "aws_access_key_id": ("AKIA",),
    "aws_secret_access_key": ("aws",),
    "generic_api_key": ("api_key", "apikey", "api-key", "key-id", "key_id", "secret_key", "secret-key"),
    "generic_password": ("pass", "pwd", "secret"),
    "private_key_pem": ("PRIVATE KEY",),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "slack_token": ("xox",),
    "google_api_key": ("AIza",),
    "heroku_api_key": ("heroku",),
    "slack_webhook_url": ("https://hooks",),
    "stripe_secret_key": ("sk_live_",),
    "twilio_api_key": ("SK",),
    "jwt_token": ("eyJ",),
    "openssh_private_key": ("OPENSSH PRIVATE KEY",),
    "facebook_access_token": ("EAACEdEose0cBA",),
    "aws_session_token": ("aws_session_token",),
    "azure_storage_key": ("defaultendpointsprotocol",),
}
SECRET_RULES = tuple(replace(r, hints=_HINTS[r.name]) for r in SECRET_RULES)
