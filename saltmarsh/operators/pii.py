"""Structured personal data, on request: six families, their validators and the labels that make a value sensitive."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from bisect import bisect_left, bisect_right
from typing import NamedTuple

from saltmarsh.functions.text import INVISIBLE_RUN, iban_mod97, luhn, us_ssn

# Fixed values. family: (domain, finding type, in a jurisdiction)
FAMILIES = {
    "email": ("email", "pii_global_email", None),
    "iban": ("iban", "pii_global_iban", None),
    "network-address": ("network-address", "pii_global_network_address", None),
    "payment-card": ("payment-card", "pii_global_payment_card", None),
    "phone": ("phone", "pii_global_phone", None),
    "us-ssn": ("national-id", "pii_jurisdiction_us_ssn", "us"),
}
DETECTOR = "pii-domain"

# Entry: (kind, class, strong, domains, forms).
ALL_DOMAINS = ("email", "payment-card", "network-address", "iban", "phone", "national-id")
VOCABULARY = {
    "en-email-field": ("field", "positive", True, ("email",), ("email", "e-mail", "email address", "e-mail address")),
    "en-network-address-field": ("field", "positive", True, ("network-address",), ("ip", "ip address", "client ip", "source ip", "remote address")),
    "en-iban-field": ("field", "positive", True, ("iban",), ("iban", "international bank account number")),
    "en-payment-card-field": ("field", "positive", True, ("payment-card",), ("payment card", "card number", "credit card number", "debit card number", "pan")),
    "en-phone-field": ("field", "positive", True, ("phone",), ("phone", "phone number", "telephone", "telephone number")),
    "en-us-ssn-field": ("field", "positive", True, ("national-id",), ("ssn", "social security number")),
    "en-us-ssn-negation": ("natural", "negative", True, ("national-id",), ("not ssn", "not social security number")),
    "en-contact-label": ("natural", "positive", False, ("email", "phone"), ("contact",)),
    "en-contact-details-label": ("natural", "positive", True, ("email", "phone"), ("contact details",)),
    "en-example-label": ("natural", "negative", True, ALL_DOMAINS, ("example", "documentation")),
    "en-value-neutral": ("field", "neutral", False, ALL_DOMAINS, ("value",)),
    "ko-email-field": ("field", "positive", True, ("email",), ("이메일", "고객 이메일", "이메일 주소")),
    "ko-network-address-field": ("field", "positive", True, ("network-address",), ("ip", "ip 주소", "클라이언트 ip", "원격 주소", "원격 ip")),
    "ko-iban-field": ("field", "positive", True, ("iban",), ("iban", "국제 계좌번호")),
    "ko-payment-card-field": ("field", "positive", True, ("payment-card",), ("결제 카드", "카드 번호", "신용 카드 번호", "직불 카드 번호", "카드번호", "신용카드번호", "직불카드번호")),
    "ko-phone-field": ("field", "positive", True, ("phone",), ("전화번호", "휴대전화번호")),
    "ko-us-ssn-field": ("field", "positive", True, ("national-id",), ("사회보장번호", "사회 보장 번호", "미국 사회보장번호")),
    "ko-us-ssn-negation": ("natural", "negative", True, ("national-id",), ("사회보장번호 아님", "사회 보장 번호 아님")),
    "ko-contact-label": ("natural", "positive", False, ("email", "phone"), ("연락처",)),
    "ko-example-label": ("natural", "negative", True, ALL_DOMAINS, ("예시",)),
    "ko-value-neutral": ("field", "neutral", False, ALL_DOMAINS, ("값",)),
}
FIELD_REACH, LABEL_REACH = 16, 64

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
        "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
# Numbers that card networks publish for tests.
TEST_CARDS = ("2222420000001113", "2222630000001125", "3566111111111113", "378282246310005", "4111111111111111", "5555555555554444", "6011111111111117")
RESERVED_DOMAINS = ("example", "test", "invalid", "localhost", "example.com", "example.net", "example.org")


# The published id of each family, and ids that are known but have no detection here.
IDS = {
    "email": "pii:global:email",
    "iban": "pii:global:iban",
    "network-address": "pii:global:network-address",
    "payment-card": "pii:global:payment-card",
    "phone": "pii:global:phone",
    "us-ssn": "pii:us:ssn",
}
UNAVAILABLE = ("pii:global:ambiguous-national-id", "pii:global:us-ssn")
# Codes of faulty selectors and their messages.
SELECTOR_ERRORS = {
    "PII_SELECTOR_INVALID": "PII selector is invalid.",
    "PII_SELECTOR_UNSUPPORTED": "PII jurisdiction or family is unsupported.",
    "PII_SELECTOR_UNAVAILABLE": "PII selection is unavailable in this artifact.",
}


class PiiError(ValueError):
    """A selector that is badly formed, not known or without detection; the message never holds it."""

    def __init__(self, code: str):
        super().__init__(SELECTOR_ERRORS[code])
        self.code = code


class Identity(NamedTuple):
    start: int
    end: int
    family: str
    sensitive_by_itself: bool | None  # False: never; None: a label decides
    confidence: int = 2


#: ``pii:<scope>`` or ``pii:family:<scope>:<name>``; a scope is ``global`` or a country.
SELECTOR = re.compile(r"pii:(?P<scope>global|[a-z]{2})|pii:family:(?P<family>(?:global|[a-z]{2}):[a-z0-9]+(?:-[a-z0-9]+)*)")


def canonical(selectors: tuple[str, ...]) -> tuple[str, ...]:
    """Each selector once, sorted; ``pii`` is short for ``pii:global``."""
    return tuple(sorted({"pii:global" if s == "pii" else s for s in selectors}))


def families_of(selectors: tuple[str, ...]) -> tuple[str, ...]:
    """The families that selectors turn on. A country's selector turns the global families on too."""
    chosen = set()
    for s in canonical(selectors):
        parts = SELECTOR.fullmatch(s)
        if not parts:
            raise PiiError("PII_SELECTOR_INVALID")
        if parts["family"]:
            wanted = {f"pii:{parts['family']}"}
            if wanted <= set(UNAVAILABLE):
                raise PiiError("PII_SELECTOR_UNAVAILABLE")
            own = {f for f, i in IDS.items() if i in wanted}
        else:
            scopes = {"global", parts["scope"]}
            if parts["scope"] not in {i.split(":")[1] for i in IDS.values()}:
                raise PiiError("PII_SELECTOR_UNSUPPORTED")
            own = {f for f, i in IDS.items() if i.split(":")[1] in scopes}
        if not own:
            raise PiiError("PII_SELECTOR_UNSUPPORTED")
        chosen |= own
    return tuple(f for f in FAMILIES if f in chosen)


def activation(credentials: str, selectors: tuple[str, ...]) -> str:
    """What is turned on, as one line that is equal for equal selections."""
    ids = sorted(IDS[f] for f in families_of(selectors))
    return f"credentials={credentials};selectors={','.join(canonical(selectors)) or 'off'};families={','.join(ids)};vocabulary=pii-context/v2"


_ATEXT = r"[^\W_]|[!#$%&'*+/=?^_`{|}~-]"
LOCAL = re.compile(rf"(?:{_ATEXT})(?:{_ATEXT}|\.(?!\.|$))*$")
DOMAIN = re.compile(r"(?:[^\W_](?:[^\W_]|-)*\.)+[^\W_](?:[^\W_]|-)*[^\W_]")


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        low = max(done, at - 320)
        before, after = LOCAL.search(text[low:at]), DOMAIN.match(text, at + 1)
        here, at = at, text.find("@", at + 1)
        if not before or not after:
            continue
        start, end = low + before.start(), after.end()
        done = end
        local, domain = text[start:here], text[here + 1 : end]
        if (cut := re.match(r"(?:.*\|)?([^=|]*)=|.*\|", local)) and (cut[1] is None or any(_SEPARATED.sub(" ", cut[1]).lower().endswith(form) for _, _, _, form in _forms("email", "field"))):
            start, local = start + cut.end(), local[cut.end() :]
        before, after = text[start - 1 : start], text[end : end + 1]
        if before in (".", "@", ":") and text[max(0, start - 3) : start].endswith("://") or before == "." or after in ("@",) or after == "-" or re.match(r":[^\s]*@", text[end:]):
            continue
        if re.search(r"://[^\s/]*$", text[max(0, start - 64) : start]):
            continue
        composed = unicodedata.normalize("NFC", local), unicodedata.normalize("NFC", domain)
        sizes = [len(p.encode()) for p in composed]
        if not local or sizes[0] > 64 or sizes[1] > 255 or sum(sizes) + 1 > 254 or any(len(p) > 63 or p.endswith("-") for p in composed[1].split(".")):
            continue
        labels = composed[1].lower().split(".")
        if labels[-1].isdigit():
            continue
        reserved = labels[-1] in RESERVED_DOMAINS or ".".join(labels[-2:]) in RESERVED_DOMAINS
        yield Identity(start, end, "email", False if reserved else None)


IBAN = re.compile(r"(?<![^\W_])([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?))(?![^\W_])")


def _ibans(text: str):
    for m in IBAN.finditer(text):
        size = IBAN_LENGTHS.get(m[1][:2])
        shown = m[1]
        while size and " " in shown and len(shown.replace(" ", "")) > size:
            shown = shown.rpartition(" ")[0]
        compact = shown.replace(" ", "")
        if size and len(compact) == size and iban_mod97(compact):
            yield Identity(m.start(), m.start() + len(shown), "iban", None)


IPV4 = re.compile(r"(?<![^\W_])(?<![.:-])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![^\W_])(?!\.[0-9])(?![/-][^\W_])")
IPV6 = re.compile(r"(?<![^\W_])(?<![:.])((?:[0-9A-Fa-f]{1,4}(?=:)|(?=::))[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3})?)(?![^\W_])(?![:%/])(?!\.[0-9])")


def _addresses(text: str):
    taken = []
    for pattern in (IPV6, IPV4):
        for m in pattern.finditer(text):
            value = m[1]
            if any(s < m.end(1) and m.start(1) < e for s, e in taken):
                continue
            try:
                if pattern is IPV4 and any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
                    continue
                address = ipaddress.ip_address(value)
            except ValueError:
                continue
            taken.append(m.span(1))
            special = address.is_unspecified or address.is_loopback or address.is_multicast or any(
                address in ipaddress.ip_network(n)
                for n in (("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "255.255.255.255/32") if address.version == 4 else ("2001:db8::/32", "3fff::/20"))
            )
            yield Identity(m.start(1), m.end(1), "network-address", False if special else None)


CARD = re.compile(r"(?<![^\W_])(?<![-.])([0-9]{10,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![^\W_])(?![-.][0-9])(?! [0-9])")


def card_brand(digits: str) -> bool:
    """Whether a card network numbers cards like this, by leading digits and length."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return bool(
        digits[0] == "4" and 10 <= n <= 19
        or n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two == 65 or 644 <= int(digits[:3]) <= 649 or 3528 <= four <= 3589)
        or n == 15 and two in (34, 37)
    )


def _cards(text: str):
    for m in CARD.finditer(text):
        digits = re.sub(r"[ -]", "", m[1])
        if card_brand(digits) and luhn(digits):
            yield Identity(m.start(), m.end(), "payment-card", False if digits in TEST_CARDS else None)


PHONE = re.compile(
    r"(?<![^\W_])(?<![-+.(/])(?<!tel:)(?<!fax:)(?:\+1[ .-]?|1[ .-])?(?:(?P<a1>[2-9][0-9]{2})(?P<s>[ .-]?)(?P<b1>[2-9][0-9]{2})(?P=s)(?P<c1>[0-9]{4})|\((?P<a2>[2-9][0-9]{2})\) ?(?P<b2>[2-9][0-9]{2})[ .-]?(?P<c2>[0-9]{4}))"
    r"(?: ext\.? ?[0-9]{1,6})?(?! ?x ?[0-9])(?! *;?ext(?![^\W\d]))(?![^\W_])(?![-.][0-9])",
    re.IGNORECASE,
)
LOCAL_PHONE = re.compile(r"(?<![^\W_])(?<![-+.(/] )(?<![-+.(/0-9])([2-9][0-9]{2})-([0-9]{4})(?![^\W_])(?![-.][0-9])")


def _phones(text: str):
    taken = []
    for m in PHONE.finditer(text):
        area, exchange, line = m["a1"] or m["a2"], m["b1"] or m["b2"], m["c1"] or m["c2"]
        if area[1:] == "11" or exchange[1:] == "11":
            continue
        taken.append(m.span())
        yield Identity(m.start(), m.end(), "phone", False if exchange == "555" and line.startswith("01") else None)
    for m in LOCAL_PHONE.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in taken) and m[1][1:] != "11":
            yield Identity(m.start(), m.end(), "phone", False if m[1] == "555" and m[2].startswith("01") else None, 1)


SSN = re.compile(r"(?<![^\W_])(?<![-.])([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})(?![^\W_])(?![-.][0-9])")


def _ssns(text: str):
    for m in SSN.finditer(text):
        if us_ssn(m[1].replace("-", "")):
            yield Identity(m.start(), m.end(), "us-ssn", None)


FINDERS = {"email": _emails, "iban": _ibans, "network-address": _addresses, "payment-card": _cards, "phone": _phones, "us-ssn": _ssns}


#: What every value made of digits has: at least six of them, but for separators.
NUMERIC = re.compile(r"[0-9][0-9A-Z .()-]{5,}")


def _attached(c: str) -> bool:
    """Characters that make a value part of something longer: words, marks, escapes, blanks that aren't ASCII."""
    return bool(c) and (c.isalnum() or c in "_%" or unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") or c.isspace() and not c.isascii() or INVISIBLE_RUN.fullmatch(c) is not None)


def _whole(text: str, i: Identity) -> bool:
    before, after = text[i.start - 1 : i.start] if i.start else "", text[i.end : i.end + 1]
    if _attached(after) or i.family != "email" and _attached(before):
        return False
    return not (text[max(0, i.start - 2) : i.start] == "{{" or i.family == "us-ssn" and after == "-" or i.family == "payment-card" and re.search(r"://[^\s]*$", text[max(0, i.start - 256) : i.start]))


def identities(text: str, families: tuple[str, ...]) -> list[Identity]:
    """All values of the families' formats, sensitive or not."""
    numeric = NUMERIC.search(text) is not None
    possible = {"email": "@" in text, "iban": numeric, "network-address": numeric or text.count(":") > 1, "payment-card": numeric, "phone": numeric, "us-ssn": numeric}
    return sorted(i for f in families if possible[f] for i in FINDERS[f](text) if _whole(text, i))


_SEPARATED = re.compile(r"[\s_\-]+")
_GAP = re.compile(r"[\s_:=\"'`>|(\[{-]*")


def _forms(domain: str, kind: str):
    for name, (k, cls, strong, domains, forms) in VOCABULARY.items():
        if k == kind and domain in domains:
            for form in forms:
                yield name, cls, strong, _SEPARATED.sub(" ", form)


def _tail_labels(before: str, domain: str):
    """Field labels that end right before a value, but for separators and quotes."""
    gap = re.search(r"[\s_:=\"'`>|(\[{-]*$", before)
    label = _SEPARATED.sub(" ", unicodedata.normalize("NFC", INVISIBLE_RUN.sub("", before[: gap.start()]))).lower()
    if len(before) - gap.start() > FIELD_REACH:
        return
    for name, cls, strong, form in _forms(domain, "field"):
        if label.endswith(form) and not re.search(r"[^\W_]$", label[: len(label) - len(form)]):
            yield len(form), strong, cls, name


class Neighbours:
    """For each of a text's values how far its line and the values beside it let its context reach."""

    def __init__(self, text: str, found: list[Identity]):
        self.breaks = [m.start() for m in re.finditer(r"[\r\n]", text)]
        self.starts, self.ends, self.size = sorted(i.start for i in found), sorted(i.end for i in found), len(text)

    def bounds(self, start: int, end: int) -> tuple[int, int]:
        k, after = bisect_left(self.breaks, start), bisect_left(self.breaks, end)
        before, beyond = bisect_right(self.ends, start), bisect_left(self.starts, end)
        first = max(self.breaks[k - 1] + 1 if k else 0, self.ends[before - 1] if before else 0)
        last = min(self.breaks[after] if after < len(self.breaks) else self.size, self.starts[beyond] if beyond < len(self.starts) else self.size)
        return first, last


#: The longest text before a value that can hold a field's name.
NAME_REACH = 256


def context(text: str, found: Identity, first: int, last: int) -> tuple[bool, bool]:
    """Whether a strong positive label and whether a strong negative one belongs to a value, between ``first`` and ``last``."""
    domain = FAMILIES[found.family][0]
    positive = negative = False
    best = max(_tail_labels(text[max(first, found.start - NAME_REACH) : found.start], domain), default=None)
    if best and best[1]:
        positive, negative = best[2] == "positive", best[2] == "negative"
    for part in (text[max(first, found.start - LABEL_REACH) : found.start], text[found.end : min(last, found.end + LABEL_REACH)]):
        plain = _SEPARATED.sub(" ", part).lower()
        for _, cls, strong, form in _forms(domain, "natural"):
            if strong and re.search(rf"(?<![^\W_]){re.escape(form)}(?![^\W_])", plain):
                positive, negative = positive or cls == "positive", negative or cls == "negative"
    return positive, negative


def sensitive(text: str, families: tuple[str, ...]) -> list[tuple[int, int, str, int]]:
    """(start, end, type, confidence) of values that a label makes sensitive.

    Values of several families over one span and domain become one of an ambiguous type,
    with the least of their confidences.
    """
    found = identities(text, families)
    beside = Neighbours(text, found)
    spans: dict[tuple[int, int, str], list[Identity]] = {}
    for i in found:
        if i.sensitive_by_itself is not False:
            positive, negative = context(text, i, *beside.bounds(i.start, i.end))
            if positive and not negative:
                spans.setdefault((i.start, i.end, FAMILIES[i.family][0]), []).append(i)
    out = []
    for (start, end, domain), group in spans.items():
        several = len({i.family for i in group}) > 1
        kind = f"pii_ambiguous_{domain.replace('-', '_')}" if several else FAMILIES[group[0].family][1]
        out.append((start, end, kind, min(i.confidence for i in group)))
    return sorted(out)
