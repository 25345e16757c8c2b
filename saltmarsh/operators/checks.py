"""Conditions beyond a token's alphabet and length. Each gets the matched bytes and returns whether they pass, or their finding type."""

from __future__ import annotations

import base64
import json
import re
import zlib


def body(token: bytes, prefix: int) -> bytes:
    return token[prefix:]


def varied(token: bytes) -> bool:
    """The part after the first ``_`` or ``-`` isn't one repeated character."""
    rest = re.split(rb"[_-]", token, maxsplit=1)[-1]
    return len(set(rest)) > 1


def _at_most(n: int):
    def check(token: bytes) -> bool:
        prefix = re.match(rb"apify_api_|nvapi-|bb_live_|rpa_|xau_|xao_", token)
        return len(token) - (prefix.end() if prefix else 0) <= n

    return check


def _matching(pattern: bytes):
    compiled = re.compile(pattern)
    return lambda token: compiled.fullmatch(token) is not None


UUID = rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def github(token: bytes) -> str | bool:
    if token.startswith(b"github_pat_"):
        return re.fullmatch(rb"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}", token) is not None
    return True


def openai(token: bytes) -> str:
    return "openai_admin_api_key" if token.startswith(b"sk-admin-") else "openai_api_key"


def stripe(token: bytes) -> str:
    return "stripe_webhook_signing_secret" if token.startswith(b"whsec_") else "stripe_credential"


def slack(token: bytes) -> str:
    if token.startswith(b"xapp-"):
        return "slack_app_level_token"
    return "slack_user_token" if token.startswith((b"xoxp-", b"xoxe.xoxp-")) else "slack_token"


def vercel(token: bytes) -> str | bool:
    if not varied(token):
        return False
    if re.fullmatch(rb"vc[par]_[A-Za-z0-9]{56}", token):
        return {b"vcp": "vercel_personal_access_token", b"vca": "vercel_app_access_token", b"vcr": "vercel_app_refresh_token"}[token[:3]]
    return "vercel_token"


def gitlab_runner(token: bytes) -> bool:
    """A 20-byte body, a legacy one with a type, or a routable payload whose base-36 CRC-32 holds."""
    rest = token[5:]
    if len(rest) == 20 or re.fullmatch(rb"t[0-9a-f]+_.{20}", rest):
        return True
    routed = re.fullmatch(rb"([A-Za-z0-9_-]{27,300})\.([0-9a-z]{2})\.([0-9a-z]{2})([0-9a-z]{7})", rest)
    return routed is not None and int(routed[4], 36) == zlib.crc32(token[: -len(routed[4])])


def confluent(token: bytes) -> bool:
    """The last six characters are the CRC-32 of the body before them, little-endian, in base64 without padding."""
    return base64.b64encode(zlib.crc32(token[4:-6]).to_bytes(4, "little"))[:6] == token[-6:]


def doppler(token: bytes) -> str:
    kinds = {b"st": "service_token", b"pt": "personal_token", b"ct": "cli_token", b"sa": "service_account_token", b"said": "service_account_identity_token", b"scim": "scim_token", b"audit": "audit_token"}
    return "doppler_" + kinds[token.split(b".")[1]]


def helicone(token: bytes) -> str:
    return "helicone_write_api_key" if token.startswith(b"pk-") else "helicone_api_key"


def composio(token: bytes) -> bool:
    return not token.startswith(b"ak_") or re.search(rb"[A-Z]", token[3:]) is not None and re.search(rb"[a-z]", token[3:]) is not None


def convex(token: bytes) -> bool:
    return len(token.rpartition(b"|")[2]) % 2 == 0


def resend(token: bytes) -> bool:
    return re.fullmatch(rb"re_[A-Za-z0-9]{8}_[A-Za-z0-9]{24}", token) is not None and token[3:] not in (token[3:].lower(), token[3:].upper())


def unkey(token: bytes) -> bool:
    rest = token[6:]
    return rest[8:15] == b"unkeyv1" if len(rest) == 57 else rest.startswith(b"3Z")


# The token prefixes of each role.
BUILDKITE = {
    "buildkite_api_access_token": ("bkua",),
    "buildkite_oauth_token": ("bkur", "bktx"),
    "buildkite_agent_token": ("bkaa", "bkar", "bkct", "bkcqt"),
    "buildkite_job_token": ("bkaj", "bkjat"),
    "buildkite_packages_token": ("bkpt", "bkrt"),
    "buildkite_pipeline_token": ("bktr", "bkat"),
    "buildkite_portal_token": ("bkpat", "bkps"),
}


def buildkite(token: bytes) -> str:
    lead = token.split(b"_")[0].decode()
    return next(t for t, leads in BUILDKITE.items() if lead in leads)


def ory(token: bytes) -> str:
    return "ory_session_token" if token.startswith(b"ory_st_") else "ory_oauth2_token"


def jwt(token: bytes) -> bool:
    """False for the public key that Supabase gives to anonymous clients."""
    payload = token.split(b".")[1]
    try:
        claims = json.loads(base64.urlsafe_b64decode(payload + b"=" * (-len(payload) % 4)))
    except ValueError:
        return True
    return not (isinstance(claims, dict) and claims.get("iss") == "supabase" and claims.get("role") == "anon")


CHECKS = {
    "varied": varied,
    "most128": _at_most(128),
    "most36": _at_most(36),
    "github": github,
    "openai": openai,
    "stripe": stripe,
    "slack": slack,
    "vercel": vercel,
    "gitlab_runner": gitlab_runner,
    "confluent": confluent,
    "doppler": doppler,
    "helicone": helicone,
    "composio": composio,
    "convex": convex,
    "resend": resend,
    "unkey": unkey,
    "buildkite": buildkite,
    "ory": ory,
    "jwt": jwt,
    "bedrock_head": lambda t: base64.b64decode(t[4:12]).startswith(b"Bedro"),
    "cloudflare": _matching(rb"cf[ua]t_[A-Za-z0-9]{40}[0-9a-f]{8}"),
    "supabase": lambda t: t[10 + 22 : 10 + 23] == b"_",
    "telegram": lambda t: re.fullmatch(UUID, t.partition(b":")[2].lower()) is None,
    "databricks": _matching(rb"dapi[0-9a-f]{32}(-[0-9]{1,3})?"),
    "postman": _matching(rb"PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    "heroku": lambda t: t.startswith(b"HRKU-AA") and len(t) == 65 or re.fullmatch(rb"HRKU-" + UUID, t) is not None,
    "firecrawl": lambda t: t[3 + 12 : 3 + 13] == b"4" and t[3 + 16 : 3 + 17] in (b"8", b"9", b"a", b"b"),
    "wandb": lambda t: len(t) - 9 <= 96,
    "has_upper": lambda t: re.search(rb"[A-Z]", t) is not None,
    "paddle": _matching(rb"pdl_(live|sdbx)_apikey_[a-z0-9]{26}_[A-Za-z0-9]{22}_[A-Za-z0-9]{3}"),
    "honeycomb": _matching(rb"hc[a-z](ik|ic)_[a-z0-9]{58}"),
    "uuid_body": lambda t: re.fullmatch(UUID, t[5:]) is not None,
    "sourcegraph": _matching(rb"sgp_([A-Za-z0-9]{1,31}_)?[0-9a-fA-F]{40}"),
    "logfire": _matching(rb"pylf_v[0-9]{1,3}_[a-z]{2,16}_([0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}_)?[A-Za-z0-9]{16,}"),
    "baseten": lambda t: t[4 + 8 : 4 + 9] == b"." and t[4:].count(b".") == 1,
}
