"""Pattern catalogs. A catalog is a sequence of rules; each rule runs on what the one before made."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """pattern and replacement in Java's dialect; name is what counts are reported under."""

    name: str
    pattern: str
    replacement: str


# The patterns below and their replacements, in the order in which they apply.

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_MARK, PHONE_MARK = "[EMAIL_REDACTED]", "[PHONE_REDACTED]"

PHONE_CANDIDATE = (
    r"(?U)\+\d[\d\s.\-]{7,}"
    r"|\(\d{3}\)[\s.\-]?\d{3}[\s.\-]?\d{4}"
    r"|\d{3}[\s.\-]\d{3}[\s.\-]\d{4}"
    r"|1[\s.\-]\d{3}[\s.\-]\d{3}[\s.\-]\d{4}"
    r"|(?<![a-fA-F0-9])\d{10,}(?![a-fA-F0-9])"
    r"|\d{3}[\s.\-]\d{4}"
    r"|\d{3}[\s.\-]\d{3}[\s.\-]\d{1,4}"
)

POLICY = [
    Rule("aws_key", r"AKIA[0-9A-Z]{16}", "[REDACTED_KEY]"),
    Rule("long_key", r"[A-Za-z0-9/+=]{40}", "[REDACTED_KEY]"),
    Rule("key_begin", r"(?U)-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "[REDACTED_TOKEN]"),
    Rule("key_end", r"(?U)-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "[REDACTED_TOKEN]"),
    Rule("bare_begin", r"(?U)BEGIN\s+PRIVATE\s+KEY", "[REDACTED_TOKEN]"),
    Rule("bare_end", r"(?U)END\s+PRIVATE\s+KEY", "[REDACTED_TOKEN]"),
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    Rule("api_key", r"(?i)api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9_-]{16,}['\"]?", "[REDACTED_KEY]"),
    Rule("secret", r"(?i)secret\s*[:=]\s*['\"]?[A-Za-z0-9_-]{16,}['\"]?", "[REDACTED_KEY]"),
]

NET = [
    Rule("ipv4", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
    Rule(
        "ipv6",
        r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
        r"|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b"
        r"|\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b"
        r"|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b"
        r"|\b(?:[0-9a-fA-F]{1,4}:){1,5}::[0-9a-fA-F]{1,4}\b",
        "[REDACTED_IP]",
    ),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{3,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\b", "[REDACTED_TOKEN]"),
    Rule("bearer", r"(?i)Bearer\s+[A-Za-z0-9\-_\.]+", "Bearer [REDACTED_TOKEN]"),
    Rule("api_key", r"(?i)(?:api[_-]?key|apikey)\s*[=:]\s*['\"]?[\w\-]+['\"]?", "api_key=[REDACTED_KEY]"),
    Rule("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    Rule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[REDACTED_EMAIL]"),
    Rule("generic_token", r"\b[A-Za-z0-9+/=_-]{40,}\b", "[REDACTED_TOKEN]"),
    Rule("long_hex", r"\b[0-9a-fA-F]{32,}\b", "[REDACTED_HEX]"),
]
#: Which counter a rule of NET adds to.
NET_COUNTER = {"ipv4": "ips", "ipv6": "ips", "jwt": "tokens", "bearer": "tokens", "api_key": "tokens", "aws_key": "keys", "email": "emails", "generic_token": "tokens", "long_hex": "hex_strings"}

OPS_MARK = "[REDACTED]"
OPS = [
    Rule("aws_key", r"\bAKIA[A-Z0-9]{16}\b", OPS_MARK),
    Rule("aws_secret", r"\b[A-Za-z0-9/+=]{40}\b(?=\s|$|['\"])", OPS_MARK),
    Rule("slack_token", r"\bxox[bpar]-[A-Za-z0-9-]{10,}", OPS_MARK),
    Rule("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9_\-\.]+", OPS_MARK),
    Rule("generic_api_key", r"(?i)(?:api[_-]?key|apikey|api[_-]?secret|secret[_-]?key)[\s]*[=:]\s*['\"]?([A-Za-z0-9_\-]{16,})['\"]?", OPS_MARK),
    Rule("hex_string", r"\b[a-fA-F0-9]{32,}\b", OPS_MARK),
    Rule("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", OPS_MARK),
    Rule("ipv4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", OPS_MARK),
    Rule("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b", OPS_MARK),
    Rule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", OPS_MARK),
    Rule("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", OPS_MARK),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", OPS_MARK),
]
OPS_TOKENS = ("aws_key", "aws_secret", "slack_token", "bearer_token", "generic_api_key", "hex_string", "github_token", "jwt")
OPS_IPS = ("ipv4", "ipv6")

PREVIEW = [
    Rule("api_key", r"(?i)(api[_-]?key|apikey)\s*[:=]\s*[\"']?([a-zA-Z0-9_\-]{20,})[\"']?", "$1=<REDACTED_API_KEY>"),
    Rule("bearer_token", r"(?i)(bearer)\s+([a-zA-Z0-9_\-\.]+)", "$1 <REDACTED_BEARER_TOKEN>"),
    Rule("aws_key", r"(?i)(aws[_-]?(?:access[_-]?key[_-]?id|secret[_-]?access[_-]?key))\s*[:=]\s*[\"']?([A-Z0-9/+=]{16,})[\"']?", "$1=<REDACTED_AWS_KEY>"),
    Rule("password", r"(?i)(password|passwd|pwd|secret|token)\s*[:=]\s*[\"']?([^\s\"']{8,})[\"']?", "$1=<REDACTED>"),
    Rule("private_key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "<REDACTED_PRIVATE_KEY>"),
    Rule("connection_string", r"(?di)((?:mongodb|postgres|mysql|redis|amqp)(?:\+\w+)?://[^:]+:)([^@]+)(@.+)", "$1<REDACTED>$3"),
    Rule("jwt", r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "<REDACTED_JWT>"),
    Rule("github_token", r"gh[pousr]_[a-zA-Z0-9]{36,}", "<REDACTED_GITHUB_TOKEN>"),
    Rule("slack_token", r"xox[baprs]-[a-zA-Z0-9-]+", "<REDACTED_SLACK_TOKEN>"),
    Rule("credit_card", r"\b(?:\d{4}[- ]?){3}\d{4}\b", "<REDACTED_CARD_NUMBER>"),
    Rule("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "<REDACTED_SSN>"),
]

# End of fixed values.

CATALOGS = {"policy": POLICY, "net": NET, "ops": OPS, "preview": PREVIEW}
