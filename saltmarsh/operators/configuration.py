"""Configuration as data: resolving JSON requests, naming compositions, and a manifest with its digest."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from saltmarsh.operators import pii
from saltmarsh.operators.policy import ActionPolicy, PolicyError, diagnose, parse_policy
from saltmarsh.operators.rulesets import RulesetError, parse_ruleset
from saltmarsh.operators.scan import ConfigError, ScanConfig

KEYS = ("profile", "include", "exclude", "pii", "ruleset", "actionPolicy", "maxInputBytes", "maxFindings")
MOST_DIAGNOSTICS = 256


def canonical(value) -> str:
    """JSON with sorted keys and no blanks: equal values, equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def composition(config: ScanConfig) -> dict:
    """What a configuration detects, and an id that follows from that alone."""
    what = {"detectors": [d.id for d in config.active()], "pii": list(pii.families_of(config.pii)), "ruleset": hashlib.sha256(config.ruleset.encode()).hexdigest() if config.ruleset else None}
    return what | {"id": f"composition-{digest(what)[:16]}"}


def manifest(config: ScanConfig = ScanConfig(), policy: ActionPolicy | None = None) -> dict:
    """The effective configuration with a digest over its canonical form."""
    what = {
        "composition": composition(config),
        "activation": pii.activation(config.profile, config.pii),
        "limits": {"maxFindings": config.most_findings, "maxInputBytes": config.most_bytes},
        "actionPolicy": policy.sha256 if policy else None,
    }
    return what | {"sha256": digest(what)}


@dataclass(frozen=True)
class Resolved:
    config: ScanConfig | None
    policy: ActionPolicy | None
    diagnostics: tuple[dict, ...]
    truncated: bool

    @property
    def ok(self) -> bool:
        return self.config is not None


def _problem(code: str, path: str, severity: str = "error") -> dict:
    return {"code": code, "severity": severity, "path": path}


def resolve(document: str) -> Resolved:
    """A JSON request as a configuration and policy, or what is wrong with it.

    Judged in a fixed order: keys and types, selection, personal data, limits, ruleset,
    policy. Errors come first; nothing of the document but positions is repeated.
    """
    try:
        request = json.loads(document)
    except ValueError:
        return Resolved(None, None, (_problem("MALFORMED_JSON", ""),), False)
    if not isinstance(request, dict):
        return Resolved(None, None, (_problem("WRONG_TYPE", ""),), False)
    found = [_problem("UNKNOWN_KEY", f"[{k}]") for k, name in enumerate(request) if name not in KEYS]
    kinds = dict.fromkeys(("include", "exclude", "pii"), list) | dict.fromkeys(("profile", "ruleset", "actionPolicy"), str) | dict.fromkeys(("maxInputBytes", "maxFindings"), int)
    for name, kind in kinds.items():
        value = request.get(name)
        if value is not None and (not isinstance(value, kind) or isinstance(value, bool) or kind is list and not all(isinstance(x, str) for x in value)):
            found.append(_problem("WRONG_TYPE", name))
    if found:
        return Resolved(None, None, tuple(found[:MOST_DIAGNOSTICS]), len(found) > MOST_DIAGNOSTICS)
    config = ScanConfig(
        profile=request.get("profile", "full"), include=tuple(request.get("include", ())), exclude=tuple(request.get("exclude", ())), pii=tuple(request.get("pii", ())), ruleset=request.get("ruleset", ""),
        most_bytes=request.get("maxInputBytes", ScanConfig.most_bytes), most_findings=request.get("maxFindings", ScanConfig.most_findings),
    )
    active, policy = (), None
    try:
        active = tuple(d.id for d in config.active())
    except ConfigError as e:
        found.append(_problem(e.code, "selection"))
    try:
        pii.families_of(config.pii)
    except pii.PiiError as e:
        found.append(_problem(e.code, "pii"))
    found += [_problem("LIMIT_OUT_OF_BOUNDS", name) for name in ("maxInputBytes", "maxFindings") if request.get(name, 1) < 1]
    try:
        if config.ruleset:
            parse_ruleset(config.ruleset)
    except RulesetError as e:
        found.append(_problem(e.kind, "ruleset"))
    notes = []
    try:
        if request.get("actionPolicy"):
            policy = parse_policy(request["actionPolicy"])
            notes = diagnose(policy, active)
    except PolicyError as e:
        found.append(_problem(e.kind, "actionPolicy"))
    every = found + notes
    return Resolved(None if found else config, None if found else policy, tuple(every[:MOST_DIAGNOSTICS]), len(every) > MOST_DIAGNOSTICS)
