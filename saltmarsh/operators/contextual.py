"""Readers: detectors that need the line, the assignment or the structure around a value.

A reader gets a text as UTF-8 bytes and yields (start, end, type, confidence, specificity).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from saltmarsh.functions.text import entropy
from saltmarsh.operators.placeholders import is_reference, is_variable_name

LOW, MEDIUM, HIGH = 0, 1, 2
ENTROPY, CONTEXTUAL, STRUCTURAL, PROVIDER, PRIVATE_KEY = range(5)

Found = Iterator[tuple[int, int, str, int, int]]

LINE_END = re.compile(rb"\r\n|[\r\n]|\xe2\x80[\xa8\xa9]")


class Lines:
    """The lines of a text, found once, and which of them match which pattern, looked up once for each line."""

    def __init__(self, data: bytes):
        self.data, self.starts, self.ends = data, [0], []
        for m in LINE_END.finditer(data):
            self.ends.append(m.start())
            self.starts.append(m.end())
        self.ends.append(len(data))
        self._first: dict[tuple[re.Pattern, int], int] = {}

    def number(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def first(self, pattern: re.Pattern, k: int) -> int:
        """Where ``pattern`` first matches on line ``k``, or past the text."""
        if k < 0:
            return len(self.data)
        found = self._first.get((pattern, k))
        if found is None:
            m = pattern.search(self.data, self.starts[k], self.ends[k])
            found = self._first[(pattern, k)] = m.start() if m else len(self.data)
        return found

    def has(self, pattern: re.Pattern, k: int) -> bool:
        return self.first(pattern, k) < len(self.data)


_latest: list = [None, None]


def lines_of(data: bytes) -> Lines:
    """The lines of the text that several readers look at in turn."""
    if _latest[0] is not data:
        _latest[:] = [data, Lines(data)]
    return _latest[1]


def _edges(data: bytes, start: int, end: int, edge: re.Pattern) -> bool:
    return not (edge.match(data[start - 1 : start]) if start else False) and not edge.match(data[end : end + 1])


WIDE_EDGE = re.compile(rb"[A-Za-z0-9_-]")


def _near(pattern: bytes, kind: str, words: bytes, high: bytes | None = None, before: int = 0, edge: re.Pattern = WIDE_EDGE, accept=None):
    """A reader of bare values: on a line (or ``before`` lines earlier) that has one of ``words``.

    Medium, or high where ``high`` matches the text before the value on its line.
    """
    value, near, sure = re.compile(pattern), re.compile(words, re.IGNORECASE), re.compile(high, re.IGNORECASE) if high else None

    def read(data: bytes) -> Found:
        for m in value.finditer(data):
            if not _edges(data, m.start(), m.end(), edge) or accept and not accept(m.group()):
                continue
            lines = lines_of(data)
            k = lines.number(m.start())
            if any(lines.has(near, j) for j in range(k, k - before - 1, -1)):
                confident = sure is not None and lines.has(sure, k)
                yield m.start(), m.end(), kind, HIGH if confident else MEDIUM, PROVIDER

    return read


# The labels of private keys in PEM.
PEM = re.compile(rb"-----(BEGIN|END) ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY)-----")
BASE64_RUN = re.compile(rb"[A-Za-z0-9+/]{16}")


def private_key(data: bytes) -> Found:
    """From the outermost BEGIN to where all that began has ended; nested and mismatched delimiters make one span."""
    open_, first, odd = [], 0, False
    for m in PEM.finditer(data):
        if m[1] == b"BEGIN":
            if not open_:
                first, odd = m.start(), False
            else:
                odd = True
            open_.append(m[2])
        elif open_:
            odd = odd or open_[-1] != m[2]
            open_.pop()
            if not open_ and BASE64_RUN.search(data, first, m.end()):
                yield first, m.end(), "private_key", HIGH, PRIVATE_KEY
    if open_ and odd and BASE64_RUN.search(data, first):
        yield first, len(data), "private_key", HIGH, PRIVATE_KEY


AWS_SECRET = re.compile(rb"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
AWS_NAME = re.compile(rb"secret[A-Za-z0-9_. -]{0,32}[\"']?[ \t]*(?:=>|[:=])[ \t]*(?:\r?\n[ \t]*)?[\"']?$", re.IGNORECASE)
AWS_ID = re.compile(rb"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")


def aws_secret(data: bytes) -> Found:
    for m in AWS_SECRET.finditer(data):
        lines = lines_of(data)
        k = lines.number(m.start())
        if AWS_NAME.search(data[max(0, m.start() - 96) : m.start()]) or lines.has(AWS_ID, k) or lines.has(AWS_ID, k - 1):
            yield m.start(), m.end(), "aws_secret_access_key", HIGH, PROVIDER


TWILIO = re.compile(rb"twilio", re.IGNORECASE)
TWILIO_ACCOUNT = re.compile(rb"(?<![A-Za-z0-9])AC[0-9a-f]{32}(?![A-Za-z0-9])")
TWILIO_KEY = re.compile(rb"(?<![A-Za-z0-9])SK[A-Za-z0-9]{32}(?![A-Za-z0-9])")
TWILIO_AUTH_NAME = re.compile(rb"twilio[A-Za-z0-9_.]{0,64}?auth[_.-]?token", re.IGNORECASE)
TWILIO_AUTH = re.compile(rb"(?<![A-Za-z0-9_-])[0-9a-f]{32}(?![A-Za-z0-9_-])")
TWILIO_SECRET = re.compile(rb"(?<![A-Za-z0-9_-])[A-Za-z0-9]{32}(?![A-Za-z0-9_-])")


def twilio_auth(data: bytes) -> Found:
    for m in TWILIO_AUTH.finditer(data):
        lines = lines_of(data)
        k = lines.number(m.start())
        if lines.has(TWILIO_ACCOUNT, k) or lines.first(TWILIO_AUTH_NAME, k) < m.start():
            yield m.start(), m.end(), "twilio_auth_token", HIGH, PROVIDER
        elif lines.has(TWILIO, k):
            yield m.start(), m.end(), "twilio_auth_token", MEDIUM, PROVIDER


def twilio_secret(data: bytes) -> Found:
    for m in TWILIO_SECRET.finditer(data):
        lines = lines_of(data)
        k = lines.number(m.start())
        if lines.has(TWILIO_KEY, k):
            yield m.start(), m.end(), "twilio_api_key_secret", HIGH, PROVIDER
        elif lines.has(TWILIO, k) and re.search(rb"[G-Zg-z]", m.group()):
            yield m.start(), m.end(), "twilio_api_key_secret", MEDIUM, PROVIDER


DISCORD_TAIL = re.compile(rb"\.[A-Za-z0-9_-]{6}\.(?:[A-Za-z0-9_-]{38}|[A-Za-z0-9_-]{27})(?![A-Za-z0-9_-])")
DISCORD_HEAD = re.compile(rb"(?<![A-Za-z0-9_-])(?:[A-Za-z0-9_-]{26}|[A-Za-z0-9_-]{24})$")


def discord(data: bytes) -> Found:
    """Three parts joined by dots; found by the second part, which few texts have."""
    for m in DISCORD_TAIL.finditer(data):
        low = max(0, m.start() - 27)
        head = DISCORD_HEAD.search(data[low : m.start()])
        if head:
            yield low + head.start(), m.end(), "discord_bot_token", HIGH, PROVIDER


def new_relic_license(data: bytes) -> Found:
    for m in re.finditer(rb"(?<![A-Za-z0-9])(?:eu01xx[0-9a-f]{26}FFFFNRAL|[0-9a-f]{32}FFFFNRAL)(?![A-Za-z0-9])", data):
        yield m.start(), m.end(), "new_relic_license_key", HIGH, PROVIDER
    yield from _near(rb"(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])", "new_relic_license_key", rb"new[ _-]?relic")(data)


MAILCHIMP = re.compile(rb"mailchimp", re.IGNORECASE)


def mailchimp(data: bytes) -> Found:
    """High, but for keys in a host name or path, which need the name of the provider on their line."""
    for m in re.finditer(rb"(?<![A-Za-z0-9_-])[0-9A-Fa-f]{32}-us[0-9]{1,3}(?![A-Za-z0-9_-])", data):
        beside = data[m.start() - 1 : m.start()] + data[m.end() : m.end() + 1]
        lines = lines_of(data)
        if not re.search(rb"[./]", beside):
            yield m.start(), m.end(), "mailchimp_api_key", HIGH, PROVIDER
        elif lines.has(MAILCHIMP, lines.number(m.start())):
            yield m.start(), m.end(), "mailchimp_api_key", MEDIUM, PROVIDER


#: How far before a value its name may begin.
NAME_REACH = 128
OKTA = re.compile(rb"okta", re.IGNORECASE)
OKTA_NAME = re.compile(rb"SSWS[ \t]+$|okta[A-Za-z0-9_.-]*(?:token|key)[\"']?[ \t]*[:=][ \t]*[\"']?$", re.IGNORECASE)


def okta(data: bytes) -> Found:
    for m in re.finditer(rb"(?<![A-Za-z0-9_-])00[A-Za-z0-9_-]{40}(?![A-Za-z0-9_-])", data):
        lines = lines_of(data)
        k = lines.number(m.start())
        if OKTA_NAME.search(data[max(lines.starts[k], m.start() - NAME_REACH) : m.start()]):
            yield m.start(), m.end(), "okta_api_token", HIGH, PROVIDER
        elif lines.has(OKTA, k):
            yield m.start(), m.end(), "okta_api_token", MEDIUM, PROVIDER


UUID = rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


NAMED = re.compile(rb"([A-Za-z0-9_.-]+)[\"']?[ \t]*[:=][ \t]*[\"']?$")
PINECONE = re.compile(rb"pinecone", re.IGNORECASE)


def pinecone(data: bytes) -> Found:
    for m in re.finditer(rb"(?<![A-Za-z0-9_-])pcsk_[A-Za-z0-9]{5,6}_[A-Za-z0-9]{63}(?![A-Za-z0-9_-])", data):
        yield m.start(), m.end(), "pinecone_api_key", HIGH, PROVIDER
    for m in re.finditer(rb"(?<![A-Za-z0-9_-])" + UUID + rb"(?![A-Za-z0-9_-])", data):
        lines = lines_of(data)
        k = lines.number(m.start())
        named = NAMED.search(data[max(lines.starts[k], m.start() - NAME_REACH) : m.start()])
        if named and b"key" in named[1].lower() and lines.has(PINECONE, k):
            yield m.start(), m.end(), "pinecone_api_key", HIGH, PROVIDER


BEARER = re.compile(rb"(?:((?<![A-Za-z-])(?:proxy-)?authorization[\"']?[ \t]{0,64}[:=][ \t]{0,64}[\"']?[ \t]{0,64})?(?<![A-Za-z0-9_])bearer[ \t]+([A-Za-z0-9._~+/%-]+={0,2})|secret-token:([A-Za-z0-9._~%+/=-]{12,}))", re.IGNORECASE)


def bearer(data: bytes) -> Found:
    """16 characters or more after ``Bearer``, 12 in an authorization header; ``secret-token:`` URIs."""
    for m in BEARER.finditer(data):
        k = 2 if m[2] else 3
        value = m[k]
        if len(value) >= (12 if m[1] or k == 3 else 16) and not is_reference(value.decode("latin-1")) and len(set(value)) > 3:
            yield m.start(k), m.end(k), "bearer_token", HIGH, STRUCTURAL


# Schemes of connection strings.
SCHEMES = "postgresql postgres mysql mariadb mongodb+srv mongodb redis rediss amqp amqps https http ftps ftp".split()
CONNECTION = re.compile(rb"(?<![A-Za-z0-9+.-])(" + b"|".join(re.escape(s.encode()) for s in sorted(SCHEMES, key=len, reverse=True)) + rb")(?:\+[a-z0-9_]{1,32})?://([^\s:@/?#\"'<>]*):([^\s@/?#\"'<>]+)@([A-Za-z0-9.-]+|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?(?![A-Za-z0-9])")
AZURE = re.compile(rb"AccountKey=([A-Za-z0-9+/]{40,}={0,2})")


def connection_string(data: bytes) -> Found:
    for m in CONNECTION.finditer(data):
        password = m[3].decode("utf-8", "replace")
        if (m[2] or m[1].startswith(b"redis")) and len(password) <= 4096 and not is_reference(password):
            strong = len(m[3]) >= 12 and entropy(password) >= 2.5
            yield m.start(3), m.end(3), "connection_string_password", HIGH if strong else MEDIUM, STRUCTURAL
    for m in AZURE.finditer(data):
        yield m.start(1), m.end(1), "connection_string_password", HIGH, STRUCTURAL


OTPAUTH = re.compile(rb"otpauth://(?:totp|hotp)/[^\s?\"'<>]{0,2048}\?(?:[^\s\"'<>#]{0,8192}?&)?secret=([A-Z2-7a-z]{16,})(?![A-Za-z0-9])")


def otpauth(data: bytes) -> Found:
    for m in OTPAUTH.finditer(data):
        yield m.start(1), m.end(1), "otpauth_secret", HIGH, STRUCTURAL


# Names of assignments, as fixed values.
HIGH_NAMES = frozenset(
    "api_key apikey secret secret_key access_token refresh_token session_token aws_secret_access_key secret_access_key aws_session_token password passwd private_key client_secret webhook_secret auth_token code_verifier".split()
)
EXACT_NAMES = frozenset("hapikey x_jfrog_art_api mac_secret_base64 personal_access_key hubspot_personal_access_key db_pass fal_key convex_deploy_key convex_self_hosted_admin_key".split())
PREFIXABLE = ("personal_access_key", "hapikey")
AMBIGUOUS_NAMES = ("auth", "credential", "credentials", "signing_key")
QUERY_NAMES = ("code",)
PUBLIC_TOKENS = ("csrf_token", "xsrf_token", "page_token", "next_page_token", "prev_page_token", "pagination_token", "continuation_token", "cancel_token", "cancellation_token", "sync_token", "resume_token", "device_token", "push_token")
OBJECT_NAMES = ("existing_secret", "existing_secret_name")
NOT_SECRET_LEADS = ("redacted", "masked", "hashed", "hash", "obfuscated", "truncated", "sanitized", "publishable")

VALUE_LEAST, VALUE_MOST, STRONG_LEAST, STRONG_ENTROPY, AMBIGUOUS_ENTROPY = 8, 4096, 16, 3.0, 3.5


def normalized(name: str) -> str:
    """camelCase to snake case, lower case, dots and dashes to underscores."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace(".", "_").replace("-", "_")


def _ends(name: str, words) -> bool:
    return any(name == w or name.endswith("_" + w) for w in words)


def name_strength(name: str, query: bool = False, extra: frozenset = frozenset()) -> int:
    """2: names a credential; 1: may; 0: doesn't."""
    if extra:
        return int(name in extra)
    hidden = name.split("_")[0] in NOT_SECRET_LEADS
    if not _ends(name, OBJECT_NAMES):
        if name in HIGH_NAMES or name in EXACT_NAMES or not hidden and _ends(name, (*HIGH_NAMES, *PREFIXABLE)):
            return 2
        if not hidden and name.endswith("_token") and not _ends(name, PUBLIC_TOKENS):
            return 2
    return int(_ends(name, AMBIGUOUS_NAMES) or query and name in QUERY_NAMES)


ASSIGNMENT = re.compile(
    rb"(?:^|(?<=[\s{,;\"'\[(?&#]))([A-Za-z][A-Za-z0-9_.-]*)(?:[\"']?\]?|\\[\"'])[ \t]*(?:=>|:=|[:=])[ \t]*"
    rb"(?=\\?\"((?:[^\"\\\r\n]|\\.)*?)\\?\"|'((?:[^'\\\r\n]|\\.)*)'|([^\s\"'`,;{}()\[\]<>&#]+))",
    re.MULTILINE,
)


def _assignments(data: bytes, extra: frozenset = frozenset()) -> Found:
    for m in ASSIGNMENT.finditer(data):
        query = data[max(0, m.start(1) - 1) : m.start(1)] in (b"?", b"&", b"#")
        name = normalized(m[1].decode("latin-1"))
        strength = name_strength(name, query, extra)
        if not strength:
            continue
        k = 2 if m[2] is not None else 3 if m[3] is not None else 4
        value = m[k]
        text = value.decode("utf-8", "replace")
        if not VALUE_LEAST <= len(value) <= VALUE_MOST or is_reference(text) or normalized(text) == name or k < 4 and is_variable_name(name, text):
            continue
        if k == 4 and (data[m.end(k) : m.end(k) + 1] == b"(" or re.search(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+$", text)):
            continue  # a call, or an attribute of an object: no literal
        bits = entropy(text)
        strong = len(value) >= STRONG_LEAST and bits >= STRONG_ENTROPY and not text.isdigit()
        if strength == 2:
            yield m.start(k), m.end(k), "contextual_secret", HIGH if strong else MEDIUM, CONTEXTUAL
        elif len(value) >= STRONG_LEAST and bits >= AMBIGUOUS_ENTROPY:
            yield m.start(k), m.end(k), "contextual_secret", MEDIUM, CONTEXTUAL


AUTHORIZATION = re.compile(rb"(?<![A-Za-z0-9-])(?:proxy-)?authorization[\"']?[ \t]{0,64}[:=][ \t]{0,64}[\"']?[ \t]{0,64}(basic|token|key|apikey)[ \t]+([A-Za-z0-9._~+/=-]{12,})", re.IGNORECASE)
BARE_VENDOR = re.compile(rb"(?<![A-Za-z0-9_-])(?:sk-(?:proj|svcacct|admin)-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{48})(?![A-Za-z0-9_-])")
NPMRC = re.compile(rb"^[^\s=]*:?_(?:authToken|auth|password)[ \t]*=[ \t]*\"?([^\s\"]{8,4096})\"?[ \t]*\r?$", re.MULTILINE)
EMAIL_TOKEN = re.compile(rb"/token:([A-Za-z0-9]{16,})")
EMAIL_BEFORE = re.compile(rb"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+$")
#: The longest address that is looked for before ``/token:``.
ADDRESS_REACH = 320
CURL = re.compile(rb"\bcurl\b")
CURL_USER = re.compile(rb"[ \t](?:-u|-U|--user|--proxy-user)[ \t=]*[\"']?([^\s:\"']+):([^\s\"']{4,})")
#: How far after ``curl`` its user may be named.
CURL_REACH = 8192
SDK_CALL = re.compile(rb"\b(?:api_key|apiKey|auth_token|authToken|setApiKey|setPassword|set_password|login)\([ \t]*[\"']([^\"'\r\n]{16,4096})[\"'][ \t]*\)")


def _email_tokens(data: bytes):
    return (m for m in EMAIL_TOKEN.finditer(data) if EMAIL_BEFORE.search(data[max(0, m.start() - ADDRESS_REACH) : m.start()]))


def _curl_users(data: bytes):
    """The first user option after each ``curl`` on its line."""
    curls = [m.end() for m in CURL.finditer(data)]
    if not curls:
        return
    used, lines = 0, lines_of(data)
    for m in CURL_USER.finditer(data):
        first = max(used, lines.starts[lines.number(m.start())], m.start() - CURL_REACH)
        k = bisect_right(curls, m.start()) - 1
        if k >= 0 and curls[k] > first:
            used = m.end()
            yield m


def _others(data: bytes) -> Found:
    for m in AUTHORIZATION.finditer(data):
        text = m[2].decode()
        if not is_reference(text):
            yield m.start(2), m.end(2), "authorization_credential", HIGH if len(text) >= 16 and entropy(text) >= 3.0 else MEDIUM, STRUCTURAL
    for m in BARE_VENDOR.finditer(data):
        if entropy(m.group().decode()) >= 3.0:
            yield m.start(), m.end(), "vendor_prefixed_credential", MEDIUM, ENTROPY
    for matches, k, confidence in ((NPMRC.finditer(data), 1, HIGH), (_email_tokens(data), 1, HIGH), (_curl_users(data), 2, HIGH), (SDK_CALL.finditer(data), 1, MEDIUM)):
        for m in matches:
            if not is_reference(m[k].decode("utf-8", "replace")):
                yield m.start(k), m.end(k), "contextual_secret", confidence, CONTEXTUAL


def generic(data: bytes) -> Found:
    seen = {}
    for found in (*_assignments(data), *_others(data)):
        if found[:2] not in seen or found[3:] > seen[found[:2]][3:]:
            seen[found[:2]] = found
    yield from sorted(seen.values())


def ruleset_names(data: bytes, names: frozenset) -> Found:
    """Values assigned to names that a ruleset adds, which count as ambiguous."""
    return _assignments(data, names)


READERS = {
    "private_key": private_key,
    "aws_secret": aws_secret,
    "twilio_auth": twilio_auth,
    "twilio_secret": twilio_secret,
    "discord": discord,
    "datadog_api": _near(rb"[0-9a-f]{32}", "datadog_api_key", rb"datadog|dd[_-]api[_-]key", rb"(?:datadog|dd)[_-]?api[_-]?key"),
    "datadog_app": _near(rb"[0-9a-f]{40}", "datadog_application_key_legacy", rb"(?:datadog|dd)[_ -]?app(?:lication)?[_ -]?key", rb"(?:datadog|dd)[_-]app(?:lication)?[_-]key"),
    "new_relic_license": new_relic_license,
    "mailchimp": mailchimp,
    "mailgun": _near(rb"key-[a-z0-9]{32}|[0-9a-f]{32}-[0-9a-f]{8}-[0-9a-f]{8}", "mailgun_api_key", rb"mailgun", rb"mailgun[A-Za-z0-9_.-]*key"),
    "okta": okta,
    "pinecone": pinecone,
    "confluent_legacy": _near(rb"[A-Za-z0-9+/]{64}", "confluent_cloud_api_secret_legacy", rb"confluent", rb"confluent[A-Za-z0-9_.-]*secret", before=3, edge=re.compile(rb"[A-Za-z0-9+/_-]")),
    "heroku_legacy": _near(UUID, "heroku_api_key_legacy", rb"heroku", rb"heroku[A-Za-z0-9_.-]*(?:key|token)", before=7),
    "travis": _near(rb"[A-Za-z0-9]{22}", "travisci_api_token", rb"travis", rb"travis[A-Za-z0-9_.-]*token", accept=lambda t: re.search(rb"[0-9]", t) and re.search(rb"[A-Z]", t)),
    "mistral": _near(rb"[A-Za-z0-9]{32}", "mistral_api_key", rb"mistral", rb"mistral[A-Za-z0-9_.-]*key"),
    "cohere": _near(rb"[A-Za-z0-9]{40}", "cohere_api_key", rb"cohere|\bco_api_key", rb"(?:cohere[A-Za-z0-9_.-]*|co_api_)key"),
    "ai21": _near(rb"[A-Za-z0-9]{32}", "ai21_api_key", rb"ai21", rb"ai21[A-Za-z0-9_.-]*key"),
    "deepgram": _near(rb"[a-z0-9]{40}", "deepgram_api_key", rb"deepgram", rb"deepgram[A-Za-z0-9_.-]*key|authorization:[ \t]*token", before=8),
    "bearer": bearer,
    "connection_string": connection_string,
    "otpauth": otpauth,
    "generic": generic,
}
