"""Security rules over added lines: credentials, personal values, weakened protections.

A rule is a pattern and exclusions for samples; all rules are one expression
over a line. Texts that a pattern can't match without are looked for first,
which most lines are free of. Matched values never reach the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import paths

from .core import top_with_total


@dataclass(frozen=True)
class Rule:
    """Alternatives, each of lower-case texts, one of which a line holds that matches, and a pattern (of the subset that RE2 and Java read alike); and the group that holds the value.

    A pattern is tried only on lines that hold one of its texts.
    """

    kind: str
    severity: str
    label: str
    alternatives: tuple[tuple[str | tuple[str, ...], str], ...]
    group: int = 0
    flags: str = ""

    @property
    def pattern(self) -> str:
        """All alternatives as one."""
        return self.flags + "|".join(p for _, p in self.alternatives)

    def each(self) -> list[tuple[tuple[str, ...], str]]:
        return [((n,) if isinstance(n, str) else n, self.flags + p) for n, p in self.alternatives]


_KEY = r"(?:password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?key|auth[_-]?token|access[_-]?token|refresh[_-]?token|private[_-]?key|client[_-]?secret|credentials?)"
_KEY_NEEDLES = ("passw", "pwd", "secret", "key", "token", "credential")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LITERAL = "secret-named value assigned a literal"

# What each rule looks for. Alternatives of a family stand one a line, each behind a text that it can't match without.
_TLS = (
    ("insecureskipverify", r"InsecureSkipVerify\s*:\s*true"),
    ("rejectunauthorized", r"rejectUnauthorized[\"']?\s*:\s*false"),
    ("node_tls_reject_unauthorized", r"NODE_TLS_REJECT_UNAUTHORIZED[\"']?\s*[:=]\s*[\"']?0"),
    ("verify", r"\bverify\s*=\s*False\b"),
    ("verify", r"ssl_?verify(?:_?peer)?[\"']?\s*[:=]\s*(?:false|0|no)\b"),
    ("curlopt_ssl_verify", r"CURLOPT_SSL_VERIFY(?:PEER|HOST)\s*,\s*(?:false|0)"),
    ("_create_unverified_context", r"ssl\._create_unverified_context"),
    ("check_hostname", r"check_hostname\s*=\s*False"),
    ("cert_none", r"CERT_NONE\b"),
    ("danger_accept_invalid_certs", r"danger_accept_invalid_certs\s*\(\s*true"),
    ("curl", r"\bcurl\b[^\n]*\s(?:-k|--insecure)\b"),
    ("wget", r"\bwget\b[^\n]*--no-check-certificate"),
    ("sslmode", r"sslmode\s*=\s*disable"),
    ("tls.version", r"tls\.Version(?:SSL30|TLS10|TLS11)\b"),
    ("http.sslverify", r"git\s+config[^\n]*http\.sslVerify\s+false"),
)
_DEBUG = (
    ("debug", r"\bDEBUG\s*=\s*(?:True|1|[\"']?true[\"']?)\b"),
    ("debug", r"\bdebug[\"']?\s*:\s*true\b"),
    (".run(", r"\.run\([^)]*debug\s*=\s*True"),
    ("flask_debug", r"FLASK_DEBUG\s*=\s*[\"']?1"),
    ("app_debug", r"APP_DEBUG\s*=\s*[\"']?true"),
    ("gin.debugmode", r"gin\.SetMode\(\s*gin\.DebugMode"),
    ("app.debug", r"app\.debug\s*=\s*True"),
    ("django_debug", r"DJANGO_DEBUG\s*=\s*[\"']?(?:True|1)"),
)
_PERMISSIONS = (
    ("chmod", r"\bchmod\s+(?:-R\s+)?(?:0?777|0?666|a\+w|o\+w|ugo\+w)\b"),
    (("777", "666"), r"\b(?:Chmod|WriteFile|Mkdir|MkdirAll|OpenFile|chmod|makedirs|mkdir|writeFileSync|chmodSync)\s*\([^)]*\b0o?(?:777|666)\b"),
    (("777", "666"), r"\bmode\s*[:=]\s*[\"']?0?(?:777|666)\b"),
    ("privileged", r"\bprivileged\s*:\s*true\b"),
    ("--privileged", r"--privileged\b"),
    ("allowprivilegeescalation", r"allowPrivilegeEscalation\s*:\s*true"),
    ("runasuser", r"runAsUser\s*:\s*0\b"),
    ("runasnonroot", r"runAsNonRoot\s*:\s*false"),
    ("root", r"^\s*USER\s+root\b"),
    ("chmod", r"\bsudo\s+chmod\s+777"),
    ("nopasswd", r"NOPASSWD\s*:\s*ALL"),
    ("hostpid", r"hostPID\s*:\s*true"),
    ("hostnetwork", r"hostNetwork\s*:\s*true"),
    ("cap_add", r"cap_add\s*:\s*\[?\s*[\"']?(?:ALL|SYS_ADMIN)"),
    ("--cap-add", r"--cap-add[= ](?:ALL|SYS_ADMIN)"),
    ("docker.sock", r"/var/run/docker\.sock"),
)
_PROTECTIONS = (
    ("@csrf_exempt", r"@csrf_exempt"),
    ("csrf", r"\bcsrf(?:_?protection|_?enabled)?[\"']?\s*[:=]\s*(?:false|0|[\"']?off)"),
    ("csrf()", r"csrf\(\)\.disable\(\)"),
    ("wtf_csrf_enabled", r"WTF_CSRF_ENABLED\s*=\s*False"),
    ("access-control-allow-origin", r"Access-Control-Allow-Origin[\"']?\s*[:,]\s*[\"']\*[\"']"),
    ("allowallorigins", r"AllowAllOrigins\s*:\s*true"),
    ("origin", r"origin\s*:\s*[\"']\*[\"']"),
    ("allow_origins", r"allow_origins\s*=\s*\[\s*[\"']\*[\"']"),
    ("secure_ssl_redirect", r"SECURE_SSL_REDIRECT\s*=\s*False"),
    ("session_cookie_secure", r"SESSION_COOKIE_SECURE\s*=\s*False"),
    ("httponly", r"\bHttpOnly\s*[:=]\s*false"),
    ("secure", r"\bsecure\s*:\s*false\b"),
    ("autoescape", r"autoescape\s*=\s*False"),
    ("safe", r"\{\{[^}]*\|\s*safe\s*\}\}"),
    ("algorithms", r"algorithms\s*=\s*\[\s*[\"']none[\"']"),
    ("alg", r"alg[\"']?\s*:\s*[\"']none[\"']"),
    ("verify_signature", r"verify_signature[\"']?\s*:\s*False"),
    ("setenforce", r"setenforce\s+0"),
    ("selinux", r"SELINUX\s*=\s*disabled"),
    ("ufw", r"\bufw\s+disable"),
    ("seccomp", r"seccomp[:=]unconfined"),
    ("apparmor", r"apparmor[:=]unconfined"),
    ("write-all", r"permissions\s*:\s*write-all"),
    ("cidr_blocks", r"cidr_blocks\s*=\s*\[\s*[\"']0\.0\.0\.0/0[\"']"),
    ("publicly_accessible", r"publicly_accessible\s*=\s*true"),
    ("acl", r"acl\s*=\s*[\"']public-read(?:-write)?[\"']"),
    ("x-frame-options", r"X-Frame-Options[\"']?\s*[:,]\s*[\"']?ALLOWALL"),
    ("helmet", r"helmet\(\s*\{\s*contentSecurityPolicy\s*:\s*false"),
)


#: Kinds, severities and patterns, in the order of precedence.
RULES = (
    Rule("private_key", "critical", "PEM private key block", ((("private key",), r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----"),)),
    Rule("private_key", "critical", "PuTTY private key", ((("putty",), r"PuTTY-User-Key-File-\d+:"),)),
    Rule("hardcoded_secret", "high", "AWS access key ID", ((("akia", "asia", "agpa", "aida", "aroa", "anpa", "anva", "aipa"), r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA|AIPA)[A-Z0-9]{16}\b"),)),
    Rule("hardcoded_secret", "high", "AWS secret access key", ((("aws",), r"(?i)aws_?secret_?access_?key[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9/+=]{40})\b"),), 1),
    Rule("hardcoded_secret", "high", "GitHub token", ((("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})\b"),)),
    Rule("hardcoded_secret", "high", "GitLab token", ((("glpat-",), r"\bglpat-[A-Za-z0-9_-]{20,}\b"),)),
    Rule("hardcoded_secret", "high", "Slack token", ((("xox",), r"\bxox[abposr]-[A-Za-z0-9-]{10,}\b"),)),
    Rule("hardcoded_secret", "high", "Slack webhook URL", ((("hooks.slack.com",), r"https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]+"),)),
    Rule("hardcoded_secret", "high", "Stripe live key", ((("k_live_",), r"\b(?:sk|rk)_live_[A-Za-z0-9]{16,}\b"),)),
    Rule("hardcoded_secret", "high", "Google API key", ((("aiza",), r"\bAIza[0-9A-Za-z_-]{35}\b"),)),
    Rule("hardcoded_secret", "high", "LLM provider API key", ((("sk-",), r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{32,}\b"),)),
    Rule("hardcoded_secret", "high", "npm token", ((("npm_",), r"\bnpm_[A-Za-z0-9]{36}\b"),)),
    Rule("hardcoded_secret", "high", "Twilio or SendGrid key", ((("sk", "sg."), r"\b(?:SK[0-9a-f]{32}|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})\b"),)),
    Rule("hardcoded_secret", "high", "Azure storage account key", ((("accountkey=",), r"(?i)AccountKey=([A-Za-z0-9+/=]{40,})"),), 1),
    Rule("hardcoded_secret", "high", "JSON Web Token", ((("eyj",), r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),)),
    Rule("hardcoded_secret", "high", _LITERAL, ((_KEY_NEEDLES, r"(?i)\b[\w.-]*" + _KEY + r"[\w.-]*[\"']?\s*(?::=|=>|[:=])\s*[\"'`]([^\"'`\s]{8,})[\"'`]"),), 1),
    Rule("credential_in_url", "high", "user:password in a URL", ((("://",), r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@\"'<>]+:([^\s/@\"'<>]+)@[^\s/\"'<>]+"),), 1),
    Rule("credential_in_url", "high", "secret-named query parameter", ((("=",), r"(?i)[?&](?:api[_-]?key|apikey|access[_-]?token|auth[_-]?token|token|secret|client[_-]?secret|password|passwd|sig|signature)=([^&\s\"'#<>]{8,})"),), 1),
    Rule("hardcoded_email", "low", "e-mail address", ((("@",), r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),)),
    Rule("hardcoded_ip", "low", "IPv4 address in a string or URL", ((('"', "'", "`", "://", "@"), r"(?:[\"'`]|://|@)(" + _OCTET + r"(?:\." + _OCTET + r"){3})(?::\d+)?\b"),), 1),
    Rule("tls_verification_disabled", "high", "TLS verification disabled", _TLS, flags="(?i)"),
    Rule("debug_enabled", "medium", "debug mode enabled", _DEBUG, flags="(?i)"),
    Rule("excessive_permissions", "high", "world-writable mode or root privileges", _PERMISSIONS, flags="(?i)"),
    Rule("protection_disabled", "high", "security protection disabled", _PROTECTIONS, flags="(?i)"),
)
#: Samples and indirect values, which are no secrets.
PLACEHOLDER = r"(?i)^(?:x+|\*+|\.+|0+|1234\w*|changeme|change[_-]?me|example\w*|sample\w*|dummy\w*|fake\w*|test\w*|placeholder\w*|redacted|your[_-]?\w*|<[^>]*>|\$\{[^}]*\}|\$\(?[A-Za-z_]\w*\)?|%\(?\w*\)?s?|\{\{[^}]*\}\}|none|null|nil|undefined|password|secret|token)$"
#: Lines that read a value from elsewhere.
INDIRECTION = r"(?i)(getenv|environ|process\.env|os\.env|env::var|secrets\.|vault|\bconfig\.|ssm:|keyvault|\$\{\{)"
#: Addresses of documentation and of this machine.
BENIGN_EMAIL = r"(?i)@(?:example\.(?:com|org|net)|[\w.-]*\.(?:example|invalid|test|local|localhost)|localhost|users\.noreply\.github\.com|noreply\.[\w.-]+)$|^(?:noreply|no-reply|git|user|test|foo|bar|name|someone|you|me)@"
BENIGN_IP = r"^(?:127\.|0\.0\.0\.0$|255\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)"
#: Fixed value: lock files, whose hashes nobody wrote.
LOCK_FILE = r"(?i)(?:\.lock|\.sum|(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|bun\.lockb))$"
LONGEST_LINE, PER_KIND = 4096, 3
LOW_NOISE = ("hardcoded_email", "hardcoded_ip")
CREDENTIALS = ("hardcoded_secret", "private_key", "credential_in_url")
INTRO, HIDDEN = "Matched by a pattern, not verified: ", "; its value is left out"

_W = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def java(pattern: str) -> str:
    """A pattern whose word boundaries are those of ASCII words, as in RE2."""
    return pattern.replace(r"\b", _EDGE)


def mixed_enough(v: Column) -> Column:
    """Whether a text has a letter, and a digit or a sign that names don't have."""
    return v.rlike("[A-Za-z]") & (v.rlike("[0-9]") | v.rlike("[^A-Za-z0-9_.-]"))


#: The most that a match counts for, by where it stands and whether it is a credential; elsewhere it counts in full.
CEILING = {("docs", True): "medium", ("docs", False): "low", ("test", True): "medium", ("test", False): "medium"}
_ORDER = ("low", "medium", "high", "critical")


def adjusted_severity(kind: Column, severity: Column, test: Column, docs: Column) -> Column:
    """A severity cut at the ceiling of its place: samples in tests and documentation are less likely to be live."""
    credential = kind.isin(*CREDENTIALS)
    ceiling = F.when(docs, F.when(credential, CEILING["docs", True]).otherwise(CEILING["docs", False])).when(test, F.when(credential, CEILING["test", True]).otherwise(CEILING["test", False])).otherwise(_ORDER[-1])
    order = F.array(*map(F.lit, _ORDER))
    return F.element_at(order, F.least(F.array_position(order, severity), F.array_position(order, ceiling)).cast("int"))


#: What keeps a match from counting, by kind or label: in the value without quotes, the value, or the line. Files where samples are expected are left out for ``LOW_NOISE``.
EXCLUDED = {
    "hardcoded_secret": (("bare", PLACEHOLDER), ("bare", "[${}<>]")),
    "credential_in_url": (("bare", PLACEHOLDER), ("bare", "[${}<>]")),
    # A path or address under such a name says where a secret is.
    _LITERAL: (("line", INDIRECTION), ("bare", r"^(?:/|\./|~/)|://")),
    "hardcoded_email": (("value", BENIGN_EMAIL), ("value", r"(?i)\.(?:png|svg)$")),
    "hardcoded_ip": (("value", BENIGN_IP),),
}


def _matches(rule: Rule, line: Column, low: Column, noise: Column) -> Column:
    held = lambda needles: reduce(or_, (F.contains(low, F.lit(n)) for n in needles))
    found = reduce(or_, (held(needles) & line.rlike(java(p)) for needles, p in rule.each()))
    value = F.regexp_extract(line, java(rule.pattern), rule.group)
    places = {"line": line, "value": value, "bare": F.regexp_replace(value, "^[\"'`]+|[\"'`]+$", "")}
    for where, pattern in (*EXCLUDED.get(rule.kind, ()), *EXCLUDED.get(rule.label, ())):
        found = found & ~places[where].rlike(java(pattern))
    if rule.label == _LITERAL:
        found = found & mixed_enough(places["bare"])
    if rule.kind == "hardcoded_email":  # the end of an address with a user
        found = found & ~F.contains(line, F.concat(F.lit("://"), value))
    return found & ~noise if rule.kind in LOW_NOISE else found


def hits(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each added line (path, line, content) and rule that match: path, line, content, kind, severity, rule.

    Lock files and lines of over ``LONGEST_LINE`` bytes aren't read; null lines match nothing.
    """
    line, low, noise = F.col("content"), F.col("_low"), F.col("_noise")
    read = lines.where((F.octet_length("content") <= LONGEST_LINE) & ~F.col("path").rlike(LOCK_FILE))
    # Most lines hold none of the texts that any rule needs: they go first.
    needles = sorted({n for r in rules for ns, _ in r.each() for n in ns})
    # Exploded, since Spark would put the expression in place of a column, and lower each line once a needle.
    lowered = read.select("path", "line", "content", F.explode(F.array(F.lower("content"))).alias("_low"))
    held = lowered.where(reduce(or_, (F.contains(low, F.lit(n)) for n in needles))).withColumn("_noise", paths.is_low_noise(F.col("path")))
    test, docs = paths.is_test(F.col("path")), paths.is_documentation(F.col("path"))
    found = F.array(*(F.when(_matches(r, line, low, noise), F.struct(F.lit(i).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"))) for i, r in enumerate(rules)))
    rows = held.select("path", "line", "content", F.explode(F.filter(found, lambda h: h.isNotNull())).alias("h")).select("path", "line", "content", "h.*")
    return rows.withColumn("severity", adjusted_severity(F.col("kind"), F.col("severity"), test, docs))


def signals(lines: DataFrame, rules: tuple[Rule, ...] = RULES, per_kind: int = PER_KIND) -> DataFrame:
    """The first hits of each kind in a file, in order of its rules' first hits: path, line, kind, severity, rule, evidence, and how many lines each rule hit.

    Evidence names the pattern; the line is quoted only where it holds no secret.
    """
    same = Window.partitionBy("path", "rule")  # hits of one rule in one file
    ordered = hits(lines, rules).withColumn("first", F.min("line").over(same)).withColumn("hits", F.count(F.lit(1)).over(same))
    kept = top_with_total(ordered, ["path", "kind"], [F.col("first"), F.col("rule"), F.col("line")], per_kind)
    label = F.element_at(F.array(*(F.lit(r.label) for r in rules)), F.col("rule") + 1)
    said = F.when(F.col("kind").isin(*CREDENTIALS), HIDDEN).otherwise(F.concat(F.lit(": "), F.substring(F.trim("content"), 1, 240)))
    more = F.when((F.col("line") == F.col("first")) & (F.col("hits") > 1), F.concat(F.lit(", on "), F.col("hits").cast("string"), F.lit(" lines of the file"))).otherwise("")
    return kept.select("path", "line", "kind", "severity", "rule", F.concat(F.lit(INTRO), label, said, more).alias("evidence"), "hits")
