"""Resolving configurations, compositions and manifests."""

import json

from saltmarsh.operators.configuration import canonical, composition, manifest, resolve
from saltmarsh.operators.scan import ScanConfig


def test_resolve_a_whole_request():
    policy = '{"actionPolicyRevision": 1, "base": "default", "rules": [{"id": "a", "match": {"detector": ["jwt"]}, "action": "warn"}]}'
    got = resolve(json.dumps({"include": ["npm-token"], "pii": ["pii:us"], "maxFindings": 5, "actionPolicy": policy}))
    assert got.ok and got.config == ScanConfig(include=("npm-token",), pii=("pii:us",), most_findings=5) and got.policy.rules[0].id == "a"
    assert [d["code"] for d in got.diagnostics] == ["ACTION_POLICY_RULE_ON_UNENABLED_DETECTOR"] and not got.truncated


def test_what_is_wrong_with_requests():
    codes = lambda doc: [d["code"] for d in resolve(doc if isinstance(doc, str) else json.dumps(doc)).diagnostics]
    assert codes("{") == ["MALFORMED_JSON"] and codes([]) == ["WRONG_TYPE"] and codes({"more": 1, "include": "jwt"}) == ["UNKNOWN_KEY", "WRONG_TYPE"]
    assert codes({"include": ["x"], "pii": ["pii:moon"], "maxFindings": 0, "ruleset": "x", "actionPolicy": "{"}) == ["UNKNOWN_ID", "PII_SELECTOR_INVALID", "LIMIT_OUT_OF_BOUNDS", "UNSUPPORTED_CONSTRUCT", "MALFORMED_JSON"]
    many = resolve(json.dumps({f"k{i}": 1 for i in range(300)}))
    assert not many.ok and many.truncated and len(many.diagnostics) == 256


def test_ids_follow_from_content():
    assert canonical({"b": 1, "a": [1, "é"]}) == '{"a":[1,"é"],"b":1}'
    one, two = composition(ScanConfig(include=("jwt", "npm-token"))), composition(ScanConfig(include=("npm-token", "jwt")))
    assert one == two and one["detectors"] == ["npm-token", "jwt"]
    assert composition(ScanConfig())["id"] != one["id"]
    assert manifest()["sha256"] == manifest()["sha256"] != manifest(ScanConfig(most_findings=3))["sha256"]
