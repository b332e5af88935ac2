"""Lines and texts that carry made-up credentials and settings: drawn at random, by the length and alphabet that a rule asks for."""

from __future__ import annotations

import random
import string

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
MIXED, HEX = UPPER + LOWER + DIGITS, DIGITS + "abcdef"


def drawn(n: int, alphabet: str = MIXED, seed: int = 0) -> str:
    """``n`` characters, the same at every call; the first two a letter and a digit where the alphabet has both."""
    rnd = random.Random(f"{n} {alphabet} {seed}")
    own = [next((c for c in rnd.sample(alphabet, len(alphabet)) if kind(c)), None) for kind in (str.isalpha, str.isdigit)]
    return "".join([*(c for c in own if c), *rnd.choices(alphabet, k=n)][:n])


#: Prefix, least length behind it and alphabet of tokens that services hand out.
TOKENS = (
    ("AROA", 16, UPPER + DIGITS), ("ghs_", 36, MIXED), ("github_pat_", 50, MIXED + "_"), ("glpat-", 20, MIXED), ("xoxr-", 10, MIXED), ("rk_live_", 16, MIXED), ("AIza", 35, MIXED), ("sk-ant-", 32, MIXED), ("npm_", 36, MIXED), ("SK", 32, HEX),
)


def secrets() -> list[str]:
    """A line with a token of each service, one with a token too short to be one, and other forms of keys."""
    whole = [f"call({prefix + drawn(n, alphabet)!r})" for prefix, n, alphabet in TOKENS]
    short = [f"call({prefix + drawn(n - 5, alphabet)!r})" for prefix, n, alphabet in TOKENS]
    pem = "-" * 5 + "BEGIN {} PRIVATE KEY" + "-" * 5
    jwt = ".".join(("eyJ" + drawn(14), "eyJ" + drawn(22, seed=1), drawn(30)))
    return [
        *whole, *short, pem.format("DSA"), pem.format("ENCRYPTED"), pem.format("MADE UP"), f"PuTTY-User-Key-File-{DIGITS[3]}: drawn", f"AWS-SECRET = {drawn(40)}", f"AWS_SECRET_ACCESS_KEY: {drawn(40)}", f"AccountKey={drawn(44)}", f"AccountKey={drawn(12)}",
        f"https://hooks.slack.com/services/T{drawn(8, UPPER)}/B{drawn(8, UPPER)}/{drawn(20)}", f"jot({jwt!r})", f"jot({jwt[3:]!r})",
        f"refresh_token => '{drawn(11)}'", f'"smtp.passwd": "{drawn(9)}"', f"clientSecret = `{drawn(8)}`", f"clientSecret = `{drawn(7)}`", f'pwd: "{drawn(14, LOWER)}"', f'credentials = "{drawn(9)}" + process.env.X', 'access-key := "<fill in>"', 'api_key: "dummyvalue12"', 'SECRET_FILE = "~/keys/a.1"',
        f"redis://worker:{drawn(12)}@cache:6379/2", "ftp://anonymous@mirror/x", "amqp://me:${MQ}@mq", f"GET /v2/rows?limit=3&signature={drawn(16)}", "GET /v2/rows?limit=3&token=none", f"?sig={drawn(7)}",
    ]


def settings() -> list[str]:
    """Lines that weaken a protection, and beside each one that doesn't."""
    return [
        "ssl_verify = no", "ssl_verify = yes", "NODE_TLS_REJECT_UNAUTHORIZED=0", "wget --no-check-certificate host", "wget --check host", "MinVersion: tls.VersionTLS10", "MinVersion: tls.VersionTLS13", "ctx.verify_mode = ssl.CERT_NONE", "ctx.verify_mode = ssl.CERT_REQUIRED",
        "FLASK_DEBUG=1", "FLASK_DEBUG=0", "APP_DEBUG=true", 'json({"debug": true})', 'json({"debug": null})', "chmod a+w shared", "chmod u+w shared", "Path('x').chmod(0o666)", "fs.writeFileSync(f, b, 0o644)", "runAsUser: 0", "runAsUser: 1000", "hostNetwork: true", "hostNetwork: none", "deploy ALL=(ALL) NOPASSWD: ALL", "docker run --cap-add=SYS_ADMIN img",
        "WTF_CSRF_ENABLED = False", "WTF_CSRF_ENABLED = True", "allow_origins=['*']", "allow_origins=[HOME]", "SESSION_COOKIE_SECURE = False", "setenforce 0", "setenforce 1", "publicly_accessible = true", "publicly_accessible = var.open", "X-Frame-Options: ALLOWALL", "X-Frame-Options: DENY", "Environment(autoescape=False)",
        "write('team.lead@firm.io')", "write('nobody@firm.example')", "see icon@2x.png", "peer = '172.20.1.9:53'", "peer = '203.0.113.9'", "build 7.20.1.9", "y = 2",
    ]


#: Texts with a credential and what masking leaves of them; @n stands for a number that tells rows apart.
_DASHES = "-" * 5
MASKED = {
    f"before {_DASHES}BEGIN OPENSSH PRIVATE KEY{_DASHES}\n@n{drawn(30)}\n{drawn(9)}\n{_DASHES}END OPENSSH PRIVATE KEY{_DASHES} after": "before [REDACTED]\n\n\n after",
    f"open {_DASHES}BEGIN DSA PRIVATE KEY{_DASHES}\n\n@n{drawn(20)}": "open [REDACTED]\n\n",
    f"send bearer\t{drawn(12)}@n/=, twice": "send [REDACTED], twice",
    f"auth-token : '{drawn(9)}@n' set": "[REDACTED]' set",
    f"passwd={drawn(6)}@n; rest": "[REDACTED] rest",
    f"{{'access_token': '{drawn(20)}@n', 'n': 1}}": "{'[REDACTED]', 'n': 1}",
    f"Authorization = bearer {drawn(7)}@n! no": "[REDACTED] no",
    f"keys sk-{drawn(8)}@n, ghr_{drawn(8)}@n and AKIA{drawn(16, UPPER)}": "keys [REDACTED], [REDACTED] and [REDACTED]",
    f"jot eyJ{drawn(8)}@n.{drawn(8, seed=1)}.{drawn(9)} end": "jot [REDACTED] end",
    f"from mysql://app@n:{drawn(5)}@db:3306/t on": "from mysql[REDACTED]db:3306/t on",
    "://a:://b:@n@@": "[REDACTED]",  # what is left is again a match, and settles
    "row @n of ok tests, at https://host/a:b and me@host": "row @n of ok tests, at https://host/a:b and me@host",
}
