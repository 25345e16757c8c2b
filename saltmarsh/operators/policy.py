"""Actions for findings: the default policy, action policies, their diagnostics, and as columns."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.operators.registry import CONFIDENCES, detectors

# Types that only redact at high confidence, and what the generic reader gives besides.
GATED = frozenset(
    "twilio_auth_token twilio_api_key_secret datadog_api_key datadog_application_key_legacy new_relic_license_key mailchimp_api_key mailgun_api_key okta_api_token "
    "confluent_cloud_api_secret_legacy heroku_api_key_legacy travisci_api_token mistral_api_key cohere_api_key ai21_api_key deepgram_api_key contextual_secret".split()
)
GENERIC = ("authorization_credential", "vendor_prefixed_credential")
ACTIONS = ("block", "redact", "warn", "allow")
OBFUSCATIONS = ("none", "invisible-characters")


def always_redacted() -> tuple[str, ...]:
    """The types that redact at any confidence: all built-in ones but keys that block and gated ones."""
    from saltmarsh.operators.checks import BUILDKITE

    extra = ("vercel_app_access_token", "vercel_app_refresh_token", "vercel_personal_access_token", *BUILDKITE, *GENERIC)
    found = {t for d in detectors() for t in d.types} | set(extra)
    return tuple(sorted(found - GATED - {"private_key", "by prefix"}))


def default_action(kind: str, confidence: int) -> str:
    if kind == "private_key":
        return "block"
    return "redact" if kind in _always() or confidence == 2 else "warn"


_cached: list[frozenset] = []


def _always() -> frozenset:
    if not _cached:
        _cached.append(frozenset(always_redacted()))
    return _cached[0]


def default_action_column(kind: Column, confidence: Column) -> Column:
    return F.when(kind == "private_key", "block").when(kind.isin(*always_redacted()) | (confidence == "high"), "redact").otherwise("warn")


class PolicyError(ValueError):
    def __init__(self, kind: str):
        super().__init__(f"INVALID_ACTION_POLICY: {kind}")
        self.kind = kind


@dataclass(frozen=True)
class Rule:
    id: str
    match: dict[str, tuple[str, ...]]
    action: str

    def covers(self, later: Rule) -> bool:
        """Whether all that ``later`` matches matches this one too, provably."""
        return all(k in later.match and set(later.match[k]) <= set(v) for k, v in self.match.items())


@dataclass(frozen=True)
class ActionPolicy:
    rules: tuple[Rule, ...]
    sha256: str = ""


KEYS = {"type": None, "detector": None, "confidence": CONFIDENCES, "obfuscation": OBFUSCATIONS}
MOST_BYTES, MOST_RULES, MOST_MEMBERS = 65_536, 128, 256


def _pairs(pairs):
    if len({k for k, _ in pairs}) != len(pairs):
        raise PolicyError("DUPLICATE_KEY")
    return dict(pairs)


def parse_policy(document: str) -> ActionPolicy:
    """A strict reading of an action policy document; the first violation rejects it."""
    if len(document.encode()) > MOST_BYTES:
        raise PolicyError("TOO_LARGE")
    try:
        top = json.loads(document, object_pairs_hook=_pairs)
    except json.JSONDecodeError:
        raise PolicyError("MALFORMED_JSON") from None
    if not isinstance(top, dict):
        raise PolicyError("WRONG_TYPE")
    if set(top) - {"actionPolicyRevision", "base", "rules"}:
        raise PolicyError("UNKNOWN_KEY")
    if top.get("actionPolicyRevision") != 1 or isinstance(top.get("actionPolicyRevision"), bool):
        raise PolicyError("UNKNOWN_REVISION")
    if top.get("base") != "default":
        raise PolicyError("UNKNOWN_BASE")
    rules = top.get("rules")
    if not isinstance(rules, list):
        raise PolicyError("WRONG_TYPE")
    if len(rules) > MOST_RULES:
        raise PolicyError("TOO_MANY_RULES")
    made, ids = [], set()
    for rule in rules:
        if not isinstance(rule, dict) or not isinstance(rule.get("id"), str) or not isinstance(rule.get("match"), dict):
            raise PolicyError("WRONG_TYPE")
        if set(rule) - {"id", "match", "action"}:
            raise PolicyError("UNKNOWN_KEY")
        if rule["id"] in ids:
            raise PolicyError("DUPLICATE_RULE_ID")
        ids.add(rule["id"])
        if rule.get("action") not in (*ACTIONS, "default"):
            raise PolicyError("UNKNOWN_ACTION")
        if not rule["match"]:
            raise PolicyError("EMPTY_MATCH")
        for key, members in rule["match"].items():
            if key not in KEYS:
                raise PolicyError("UNKNOWN_MATCH_KEY")
            if not isinstance(members, list) or not members or not all(isinstance(m, str) for m in members):
                raise PolicyError("WRONG_TYPE" if members != [] else "EMPTY_SET")
            if len(members) > MOST_MEMBERS:
                raise PolicyError("TOO_MANY_MEMBERS")
            if len(set(members)) != len(members):
                raise PolicyError("DUPLICATE_MEMBER")
            if KEYS[key] and set(members) - set(KEYS[key]):
                raise PolicyError("UNKNOWN_MEMBER")
        made.append(Rule(rule["id"], {k: tuple(v) for k, v in rule["match"].items()}, rule["action"]))
    return ActionPolicy(tuple(made), hashlib.sha256(document.encode()).hexdigest())


def _matches(rule: Rule, finding) -> Column:
    out = F.lit(True)
    for key, members in rule.match.items():
        out = out & finding[key].isin(*members)
    return out


def decide(policy: ActionPolicy | None, finding) -> Column:
    """struct<action, basis, rule_id, rule_index> of a finding, a struct or anything else with its fields.

    The first rule that matches decides; its action ``default``, and no match, mean the default.
    """
    base = default_action_column(finding["type"], finding["confidence"])
    result = lambda action, basis, rule, index: F.struct(action.alias("action"), F.lit(basis).alias("basis"), F.lit(rule).cast("string").alias("rule_id"), F.lit(index).cast("int").alias("rule_index"))
    if policy is None:
        return result(base, "default-policy", None, None)
    out = None
    for k, rule in enumerate(policy.rules):
        made = result(base if rule.action == "default" else F.lit(rule.action), "rule-default" if rule.action == "default" else "rule", rule.id, k)
        out = F.when(_matches(rule, finding), made) if out is None else out.when(_matches(rule, finding), made)
    rest = result(base, "no-rule-matched", None, None)
    return rest if out is None else out.otherwise(rest)


def shadowed(policy: ActionPolicy) -> list[tuple[int, int]]:
    """(rule, an earlier rule that matches all it does)."""
    found = []
    for k, rule in enumerate(policy.rules):
        earlier = next((j for j in range(k) if policy.rules[j].covers(rule)), None)
        if earlier is not None:
            found.append((k, earlier))
    return found


def diagnose(policy: ActionPolicy, enabled: tuple[str, ...] | None = None, most: int = 256) -> list[dict]:
    """What a policy names that no finding can have, and rules that never decide."""
    own = {d.id: d for d in detectors()}
    types = {t for d in own.values() for t in d.types} | set(always_redacted()) | GATED | {"private_key"}
    found = []
    for k, rule in enumerate(policy.rules):
        for key, code, known in (("type", "ACTION_POLICY_UNKNOWN_TYPE", types), ("detector", "ACTION_POLICY_UNKNOWN_DETECTOR", set(own) | {"pii-domain"})):
            for j, member in enumerate(rule.match.get(key, ())):
                path = f"actionPolicy.rules[{k}].match.{key}[{j}]"
                if member not in known:
                    found.append({"code": code, "severity": "warning", "path": path, "id": rule.id})
                elif key == "detector" and enabled is not None and member in own and member not in enabled:
                    found.append({"code": "ACTION_POLICY_RULE_ON_UNENABLED_DETECTOR", "severity": "warning", "path": path, "id": member})
    found += [{"code": "ACTION_POLICY_SHADOWED_RULE", "severity": "warning", "path": f"actionPolicy.rules[{k}]", "id": policy.rules[k].id, "related": policy.rules[j].id} for k, j in shadowed(policy)]
    return found[:most]


def rule_hits(findings: DataFrame, policy: ActionPolicy) -> DataFrame:
    """How many of ``findings`` each rule decides; rules without any have 0."""
    decided = findings.select(decide(policy, F.struct("*")).alias("d")).where("d.rule_index is not null")
    counts = decided.groupBy(F.col("d.rule_index").alias("rule_index")).agg(F.count(F.lit(1)).alias("hits"))
    rules = findings.sparkSession.createDataFrame([(k, r.id) for k, r in enumerate(policy.rules)], "rule_index int, rule_id string")
    return rules.join(counts, "rule_index", "left").select("rule_index", "rule_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
