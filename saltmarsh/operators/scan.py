"""Scanning text columns: detectors to disjoint findings with actions, and redaction."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.text import INVISIBLE_RUN
from saltmarsh.operators import contextual, pii
from saltmarsh.operators.arbitration import SEVERITY, Candidate, arbitrate
from saltmarsh.operators.checks import CHECKS
from saltmarsh.operators.placeholders import VENDOR_EXAMPLES
from saltmarsh.operators.policy import ActionPolicy, decide, default_action
from saltmarsh.operators.registry import COMMON, CONFIDENCES, FOLDED, SPECIFICITIES, Detector, by_id, detectors
from saltmarsh.operators.rulesets import Ruleset, parse_ruleset

FINDING = "struct<finding_id: string, finding_index: int, type: string, detector: string, confidence: string, specificity: string, obfuscation: string, start: int, end: int>"
FINDINGS = f"array<{FINDING}>"
ERRORS = {"INPUT_TOO_LARGE": "the text has more bytes than allowed", "TOO_MANY_FINDINGS": "the text has more findings than allowed"}


class ConfigError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class ScanConfig:
    """What to look for and within which limits.

    ``profile``: ``full`` or ``common``. ``include`` or ``exclude``: detector ids, at most 256.
    ``pii``: selectors. ``ruleset``: a document. Limits are bytes of text and findings per text.
    """

    profile: str = "full"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    pii: tuple[str, ...] = ()
    ruleset: str = ""
    most_bytes: int = 64 << 20
    most_findings: int = 50_000
    extra: tuple = field(default=(), compare=False)

    def active(self) -> tuple[Detector, ...]:
        """The detectors that run, in registry order."""
        known = by_id()
        if self.profile not in ("full", "common"):
            raise ConfigError("UNKNOWN_PROFILE")
        if self.include and self.exclude:
            raise ConfigError("INCLUDE_AND_EXCLUDE")
        for ids in (self.include, self.exclude):
            if len(ids) > 256:
                raise ConfigError("TOO_MANY_IDS")
            if len(set(ids)) != len(ids):
                raise ConfigError("DUPLICATE_ID")
            if any(i not in known for i in ids):
                raise ConfigError("UNKNOWN_ID")
        out = [d for d in detectors() if self.profile == "full" or d.id in COMMON]
        if self.include:
            out = [d for d in out if d.id in self.include]
        out = [d for d in out if d.id not in self.exclude]
        if not out and not self.pii and not self.ruleset:
            raise ConfigError("EMPTY_SELECTION")
        return tuple(out)


class Gate:
    """Which detectors have one of their literals in a text: one pass for all of them, and exact."""

    def __init__(self, active: tuple[Detector, ...]):
        import ahocorasick

        self.always = {d.order for d in active if not d.literals}
        self.cased, self.folded = ahocorasick.Automaton(), ahocorasick.Automaton()
        groups: dict[tuple[bool, str], set[int]] = {}
        for d in active:
            for literal in d.literals:
                fold = d.id in FOLDED and literal == literal.lower()
                groups.setdefault((fold, literal), set()).add(d.order)
        for (fold, literal), orders in groups.items():
            (self.folded if fold else self.cased).add_word(literal, frozenset(orders))
        self.automata = []
        for automaton, fold in ((self.cased, False), (self.folded, True)):
            if len(automaton):
                automaton.make_automaton()
                self.automata.append((automaton, fold))

    def present(self, text: str) -> list[int]:
        found = set(self.always)
        for automaton, fold in self.automata:
            for _, orders in automaton.iter(text.lower() if fold else text):
                found |= orders
        return sorted(found)


class Scanner:
    """All detection for one text at a time; built once in each worker."""

    def __init__(self, config: ScanConfig):
        self.config = config
        self.active = {d.order: d for d in config.active()}
        self.gate = Gate(tuple(self.active.values()))
        self.compiled = {d.order: (re.compile(d.pattern.encode()), re.compile(f"[{d.edge}]".encode()) if d.edge else None, CHECKS.get(d.check)) for d in self.active.values() if not d.reader}
        self.families = pii.families_of(config.pii)
        self.ruleset = parse_ruleset(config.ruleset) if config.ruleset else Ruleset((), frozenset())
        self.rules = [(r, re.compile(r.pattern.encode()), re.compile(f"[{r.edge}]".encode())) for r in self.ruleset.detectors]

    def _formats(self, d: Detector, data: bytes):
        pattern, edge, check = self.compiled[d.order]
        for m in pattern.finditer(data):
            start, end = m.span()
            if edge and (start and edge.match(data[start - 1 : start]) or edge.match(data[end : end + 1])):
                continue
            token = m.group()
            if d.id == "buildkite-token" or d.id == "sendgrid-token":
                token = token.rstrip(b".")
                end = start + len(token)
            passed = check(token) if check else True
            if passed:
                yield start, end, passed if isinstance(passed, str) else self._type(d, token), contextual.HIGH, contextual.STRUCTURAL if d.id == "jwt" else contextual.PROVIDER

    @staticmethod
    def _type(d: Detector, token: bytes) -> str:
        if len(d.types) == 1:
            return d.types[0]
        return next(f.type for f in sorted(d.formats, key=lambda f: -len(f.prefix)) if token.startswith(f.prefix.encode()))

    def candidates(self, text: str, data: bytes) -> list[Candidate]:
        out = []
        for order in self.gate.present(text):
            d = self.active[order]
            source = contextual.READERS[d.reader](data) if d.reader else self._formats(d, data)
            for k, (start, end, kind, confidence, specificity) in enumerate(source):
                if data[start:end].decode("utf-8", "replace") not in VENDOR_EXAMPLES:
                    out.append(Candidate(start, end, kind, d.id, confidence, specificity, order, k, SEVERITY[default_action(kind, confidence)]))
        first = len(detectors())
        for n, (rule, pattern, edge) in enumerate(self.rules):
            for k, m in enumerate(pattern.finditer(data)):
                start, end = m.span()
                if not (start and edge.match(data[start - 1 : start])) and not edge.match(data[end : end + 1]) and rule.valid(m.group()):
                    out.append(Candidate(start, end, rule.id, rule.id, contextual.MEDIUM, SPECIFICITIES.index(rule.specificity), first + n, k, SEVERITY["warn"]))
        if self.ruleset.names:
            for k, (start, end, kind, confidence, specificity) in enumerate(contextual.ruleset_names(data, self.ruleset.names)):
                out.append(Candidate(start, end, kind, "ruleset-names", confidence, specificity, first + len(self.rules), k, SEVERITY[default_action(kind, confidence)]))
        if self.families:
            byte = [0, *accumulate(len(c.encode()) for c in text)] if not text.isascii() else range(len(text) + 1)
            for k, (start, end, kind, confidence) in enumerate(pii.sensitive(text, self.families)):
                out.append(Candidate(byte[start], byte[end], kind, pii.DETECTOR, confidence, contextual.CONTEXTUAL, first + len(self.rules) + 1, k, SEVERITY[default_action(kind, confidence)]))
        return out

    def scan(self, text: str) -> list[Candidate]:
        """Disjoint findings of ``text``, with offsets in its own UTF-8 bytes."""
        if text.isascii() or not INVISIBLE_RUN.search(text):
            return arbitrate(self.candidates(text, text.encode()))
        clean, starts, ends, at = [], [], [], 0
        for c in text:  # each byte of the clean text: where its character stands in the given one
            size = len(c.encode())
            if not INVISIBLE_RUN.fullmatch(c):
                clean.append(c)
                starts += [at] * size
                ends += [at + size] * size
            at += size
        short = "".join(clean)
        moved = []
        for c in self.candidates(short, short.encode()):
            start, end = starts[c.start], ends[c.end - 1]
            hidden = end - start != c.end - c.start
            if c.detector == pii.DETECTOR and not c.type.endswith("network_address"):
                runs = [m.span() for m in INVISIBLE_RUN.finditer(text)]
                edges = [len(text[:a].encode()) for a, _ in runs], [len(text[:b].encode()) for _, b in runs]
                k = bisect_left(edges[1], start)
                if k < len(runs) and edges[0][k] <= end:
                    continue
            moved.append(c._replace(start=start, end=end, obfuscation="invisible-characters" if hidden else "none"))
        return arbitrate(moved)


_scanners: dict[ScanConfig, Scanner] = {}


def scanner(config: ScanConfig) -> Scanner:
    if config not in _scanners:
        _scanners[config] = Scanner(config)
    return _scanners[config]


def rows_of(found: list[Candidate]) -> list[dict]:
    return [
        {"finding_id": f"finding-{k + 1}", "finding_index": k, "type": c.type, "detector": c.detector, "confidence": CONFIDENCES[c.confidence], "specificity": SPECIFICITIES[c.specificity], "obfuscation": c.obfuscation, "start": c.start, "end": c.end}
        for k, c in enumerate(found)
    ]


def detect(df: DataFrame, text_col: str = "text", config: ScanConfig = ScanConfig()) -> DataFrame:
    """``df`` with ``findings``, an array of structs in order, and ``error``, null or a struct of code and message.

    They replace columns of these names.

    One pass without a shuffle: batches of text go to a Python worker over Arrow; a multi-
    pattern search says which detectors can match at all, and most texts end there. A text
    over a limit has an error and no findings; others go on. A null text has neither.
    """
    config.active()


    @F.pandas_udf(f"struct<findings: {FINDINGS}, error: string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        own, findings, errors = scanner(config), [], []
        for text in texts:
            found, error = [], None
            if text is not None:
                if len(text) > config.most_bytes or len(text) * 4 > config.most_bytes and len(text.encode()) > config.most_bytes:
                    error = "INPUT_TOO_LARGE"
                elif len(found := own.scan(text)) > config.most_findings:
                    found, error = [], "TOO_MANY_FINDINGS"
            findings.append(rows_of(found))
            errors.append(error)
        return pd.DataFrame({"findings": findings, "error": errors})

    others = [c for c in df.columns if c not in ("findings", "error")]
    scanned = df.select(*others, scan(F.col(text_col)).alias("_scan"))
    message = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    error = F.when(F.col("_scan.error").isNotNull(), F.struct(F.col("_scan.error").alias("code"), message[F.col("_scan.error")].alias("message")))
    return scanned.select(*others, F.col("_scan.findings").alias("findings"), error.alias("error"))


def with_actions(df: DataFrame, policy: ActionPolicy | None = None) -> DataFrame:
    """``findings`` with the ``action`` of each by the policy (default: the built-in one)."""
    return df.withColumn("findings", F.transform("findings", lambda f: f.withField("action", decide(policy, f)["action"])))


def typed_label(kind: Column) -> Column:
    return F.upper(F.translate(kind, ".-", "__"))


def redact_column(text: Column, findings: Column, typed: bool = False) -> Column:
    """``text`` with each finding to redact or block replaced by ``<SECRET_1>``, ... or ``<TYPE_1>``, ..."""
    data = F.encode(text, "UTF-8")
    gone = F.filter(findings, lambda f: f["action"].isin("redact", "block"))
    label = lambda f, i: F.concat(F.lit("<"), typed_label(f["type"]) if typed else F.lit("SECRET"), F.lit("_"), (i + 1).cast("string"), F.lit(">"))
    before = lambda i: F.when(i > 0, F.element_at(gone, i)["end"]).otherwise(0)
    pieces = F.transform(gone, lambda f, i: F.concat(F.decode(F.substring(data, before(i) + 1, f["start"] - before(i)), "UTF-8"), label(f, i)))
    tail = F.decode(F.substring(data, F.element_at(gone, -1)["end"] + 1, F.octet_length(data)), "UTF-8")
    return F.when(F.size(gone) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def unsafe_placeholder(text: Column, findings: Column) -> Column:
    """Whether a placeholder would hold the text of a finding: true of very short findings only."""
    data = F.encode(text, "UTF-8")
    value = lambda f: F.decode(F.substring(data, f["start"] + 1, f["end"] - f["start"]), "UTF-8")
    return F.exists(findings, lambda f: F.lit("<SECRET_0123456789>").contains(value(f)))


def scan(df: DataFrame, text_col: str = "text", config: ScanConfig = ScanConfig(), policy: ActionPolicy | None = None) -> DataFrame:
    """``df`` with findings, their actions, and an error where a limit was passed."""
    return with_actions(detect(df, text_col, config), policy)


def redact(df: DataFrame, text_col: str = "text", typed: bool = False) -> DataFrame:
    """``df``, which has findings with actions, with its text sanitized; null where there was an error."""
    clean = F.when(F.col("error").isNull(), redact_column(F.col(text_col), F.col("findings"), typed))
    return df.withColumn(text_col, clean)


def scan_and_redact(df: DataFrame, text_col: str = "text", config: ScanConfig = ScanConfig(), policy: ActionPolicy | None = None, typed: bool = False) -> DataFrame:
    return redact(scan(df, text_col, config, policy), text_col, typed)


def explode_findings(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each finding with the ``keys`` of its text.

    The outer form, then a filter: for the plain one Catalyst would add a filter on the array
    below, and with it a second run of the detection.
    """
    return df.select(*keys, F.explode_outer("findings").alias("_f")).where("_f is not null").select(*keys, "_f.*")
