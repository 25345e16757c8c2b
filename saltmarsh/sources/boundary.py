"""Nested values and logs: sanitizing maps, arrays and JSON, with keys as context."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.operators.policy import default_action
from saltmarsh.operators.scan import ScanConfig, Scanner, scanner

OUTCOME = "struct<outcome: string, reason: string, value: string, findings: int>"
MOST_DEPTH, MOST_NODES = 32, 10_000


class Blocked(Exception):
    def __init__(self, reason: str):
        self.reason = reason


class Walk:
    """One nested value: placeholders are numbered through all of it."""

    def __init__(self, scan: Scanner):
        self.scan, self.findings, self.replaced, self.nodes = scan, 0, 0, 0

    def text(self, value: str, key: str | None = None) -> str:
        """A leaf alone; and if that is clean, as the value of its key."""
        found, shift = self.scan.scan(value), 0
        if not found and key:
            lead = json.dumps({key: ""}, ensure_ascii=False)[:-2]
            shift = len(lead.encode())
            data = value.encode()
            quoted = json.dumps(value, ensure_ascii=False)[1:-1]
            found = self.scan.scan(f'{lead}{quoted}"}}') if quoted == value else []
            found = [c for c in found if c.start >= shift and c.end <= shift + len(data)]
        data, out, at = value.encode(), [], 0
        for c in found:
            self.findings += 1
            action = default_action(c.type, c.confidence)
            if action == "block":
                raise Blocked("POLICY_BLOCK")
            if action == "redact":
                self.replaced += 1
                out += [data[at : c.start - shift], f"<SECRET_{self.replaced}>".encode()]
                at = c.end - shift
        return b"".join([*out, data[at:]]).decode()

    def value(self, value, key: str | None = None, depth: int = 0):
        self.nodes += 1
        if depth > MOST_DEPTH or self.nodes > MOST_NODES:
            raise Blocked("STRUCTURE_LIMIT")
        if isinstance(value, str):
            return self.text(value, key)
        if isinstance(value, list):
            return [self.value(v, key, depth + 1) for v in value]
        if isinstance(value, dict):
            out = {}
            for k, v in value.items():
                clean = self.text(k)
                if clean in out:
                    raise Blocked("KEY_COLLISION")
                out[clean] = self.value(v, k, depth + 1)
            return out
        return value


def sanitize_json(value: Column, config: ScanConfig = ScanConfig()) -> Column:
    """A JSON value sanitized leaf by leaf: outcome ok or blocked, reason, value and number of findings."""

    @F.pandas_udf(OUTCOME)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            walk = Walk(scanner(config))
            try:
                rows.append(("ok", None, json.dumps(walk.value(json.loads(v)), ensure_ascii=False), walk.findings) if v is not None else ("ok", None, None, 0))
            except Blocked as e:
                rows.append(("blocked", e.reason, None, walk.findings))
            except ValueError:
                rows.append(("blocked", "NOT_JSON", None, 0))
        return pd.DataFrame(rows, columns=["outcome", "reason", "value", "findings"])

    return run(value)


def sanitize_map(attributes: Column, config: ScanConfig = ScanConfig()) -> Column:
    """A map of strings (log fields, span attributes) with its values sanitized; null where it was blocked."""
    return F.from_json(sanitize_json(F.to_json(attributes), config)["value"], "map<string,string>")


def sanitize_tool_result(result: Column, config: ScanConfig = ScanConfig()) -> Column:
    """A tool's result: its text parts sanitized; binary parts block it."""
    binary = F.exists(F.from_json(F.get_json_object(result, "$.content"), "array<struct<type: string>>"), lambda p: p["type"].isin("image", "audio", "blob"))
    blocked = F.struct(F.lit("blocked").alias("outcome"), F.lit("BINARY_CONTENT").alias("reason"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("findings"))
    return F.when(F.coalesce(binary, F.lit(False)), blocked).otherwise(sanitize_json(result, config))
