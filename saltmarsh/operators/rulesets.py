"""Declarative rulesets: detectors and assignment names that a caller adds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from saltmarsh.functions.text import IDENTIFIER, INVISIBLE_RUN
from saltmarsh.operators.contextual import normalized
from saltmarsh.operators.registry import by_id

# Fixed values.
RULE_ALPHABETS = {"alnum": "A-Za-z0-9", "alnum-dash": "A-Za-z0-9_-", "alnum-dash-dot": "A-Za-z0-9_.-", "upper-alnum": "A-Z0-9", "digit": "0-9", "lower-hex": "0-9a-f", "base64-body": "A-Za-z0-9+/"}
VALIDATORS = ("none", "trailing-lower-hex")
FIELDS = ("specificity", "prefix", "alphabet", "run", "validator")
MOST_BYTES, MOST_DETECTORS, MOST_NAMES, PREFIX_LEAST, PREFIX_MOST, NAME_MOST, RUN_MOST = 65_536, 64, 32, 3, 64, 64, 4096


class RulesetError(ValueError):
    """The document is rejected as a whole; ``kind`` says why, and nothing of the document is in the message."""

    def __init__(self, kind: str):
        super().__init__(f"INVALID_RULESET: {kind}")
        self.kind = kind


@dataclass(frozen=True)
class RuleDetector:
    id: str
    specificity: str
    prefix: str
    alphabet: str
    exact: bool
    length: int
    validator: str

    @property
    def pattern(self) -> str:
        cls = f"[{RULE_ALPHABETS[self.alphabet]}]"
        return re.escape(self.prefix) + cls + (f"{{{self.length}}}" if self.exact else f"{{{self.length},}}")

    @property
    def edge(self) -> str:
        return RULE_ALPHABETS[self.alphabet]

    def valid(self, token: bytes) -> bool:
        """``trailing-lower-hex``: the last eight characters are lower-case hex digits."""
        return self.validator == "none" or re.search(rb"[0-9a-f]{8}$", token) is not None


@dataclass(frozen=True)
class Ruleset:
    detectors: tuple[RuleDetector, ...]
    names: frozenset


def _field(block: dict, key: str, value: str) -> None:
    if key in block:
        raise RulesetError("UNSUPPORTED_CONSTRUCT")
    if key == "specificity" and value not in ("entropy", "contextual"):
        raise RulesetError("SPECIFICITY_NOT_CLAIMABLE")
    if key == "alphabet" and value not in RULE_ALPHABETS:
        raise RulesetError("UNKNOWN_ALPHABET")
    if key == "validator" and value not in VALIDATORS:
        raise RulesetError("UNKNOWN_VALIDATOR")
    if key == "prefix":
        if len(value) < 2 or value[0] != '"' or value[-1] != '"' or INVISIBLE_RUN.search(value):
            raise RulesetError("UNSUPPORTED_CONSTRUCT")
        value = value[1:-1]
        if len(value.encode()) < PREFIX_LEAST:
            raise RulesetError("PREFIX_TOO_SHORT")
        if len(value.encode()) > PREFIX_MOST:
            raise RulesetError("PREFIX_TOO_LONG")
    if key == "run":
        found = re.fullmatch(r"(exact|at-least) +([0-9]+)", value)
        if not found or re.fullmatch(r"0[0-9]+", found[2]):
            raise RulesetError("UNSUPPORTED_CONSTRUCT")
        if not 1 <= int(found[2]) <= RUN_MOST:
            raise RulesetError("RUN_LENGTH_OUT_OF_BOUNDS")
    block[key] = value


def parse_ruleset(document: str) -> Ruleset:
    """The ruleset of a revision 1 document."""
    if len(document.encode()) > MOST_BYTES:
        raise RulesetError("RULESET_TOO_LARGE")
    if document.startswith("﻿"):
        raise RulesetError("UNSUPPORTED_CONSTRUCT")
    blocks: list[dict] = []
    names: list[str] = []
    current, revised = None, False
    for line in re.split(r"\r?\n", document):
        line = line.strip(" \t")
        if not line:
            continue
        if line.startswith("#") or ":" not in line:
            raise RulesetError("UNSUPPORTED_CONSTRUCT")
        key, value = (x.strip(" \t") for x in line.split(":", 1))
        if not revised:
            if key != "ruleset-revision" or value != "1":
                raise RulesetError("UNKNOWN_REVISION")
            revised = True
        elif key == "detector":
            if len(blocks) == MOST_DETECTORS:
                raise RulesetError("TOO_MANY_DETECTORS")
            if not re.fullmatch(IDENTIFIER[1:-1], value) or len(value) > 64:
                raise RulesetError("UNSUPPORTED_CONSTRUCT")
            if value in by_id() or value in ("pii-domain", "ruleset-names"):
                raise RulesetError("RESERVED_DETECTOR_ID")
            if any(b["id"] == value for b in blocks):
                raise RulesetError("DUPLICATE_DETECTOR_ID")
            blocks.append(current := {"id": value})
        elif key == "names":
            if value != "ambiguous":
                raise RulesetError("NAME_BUCKET_NOT_CLAIMABLE")
            current = names
        elif key == "name" and current is names:
            if len(value) > NAME_MOST:
                raise RulesetError("NAME_TOO_LONG")
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.-]*", value):
                raise RulesetError("UNSUPPORTED_CONSTRUCT")
            if len(names) == MOST_NAMES:
                raise RulesetError("TOO_MANY_NAMES")
            names.append(normalized(value))
        elif key in FIELDS and isinstance(current, dict):
            _field(current, key, value)
        else:
            raise RulesetError("UNKNOWN_FIELD")
    if not revised:
        raise RulesetError("UNKNOWN_REVISION")
    for b in blocks:
        if any(f not in b for f in FIELDS):
            raise RulesetError("MISSING_FIELD")
    if not blocks and not names:
        raise RulesetError("EMPTY_RULESET")
    made = tuple(RuleDetector(b["id"], b["specificity"], b["prefix"], b["alphabet"], b["run"].startswith("exact"), int(b["run"].split()[-1]), b["validator"]) for b in blocks)
    return Ruleset(made, frozenset(names))
