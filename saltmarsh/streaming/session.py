"""Chunked text: sanitizing a stream whose secrets may lie across chunks, with bounded state."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from saltmarsh.functions.text import INVISIBLE_RUN
from saltmarsh.operators.contextual import PEM
from saltmarsh.operators.policy import default_action
from saltmarsh.operators.scan import ScanConfig, scanner

OUT = "stream_id string, seq long, text string, state string, error string, findings long, replaced long"
STATE = "seq long, session string, early string"
CODES = ("SESSION_NOT_ACCEPTING", "INPUT_LIMIT", "BUFFER_LIMIT", "TIMEOUT")


@dataclass(frozen=True)
class SessionLimits:
    """Bytes of a stream, and of text held back until what it opens has closed."""

    most_bytes: int = 64 << 20
    most_buffered: int = 1 << 20


#: Lines before a value whose words can decide on it: the furthest that any reader looks back.
REACH = 8


class Session:
    """One stream: ``append`` and ``finish`` give sanitized text; in all it is that of the whole text's scan.

    Values end on the line that they begin on, but for key blocks, and no reader looks at
    a later line. So whole lines are given out at once, unless a key block is open: from
    the line of its first BEGIN on they wait until all that began has ended. The last
    lines given out stay as context for what follows.
    """

    def __init__(self, config: ScanConfig = ScanConfig(), limits: SessionLimits = SessionLimits()):
        self.config, self.limits = config, limits
        self.context, self.waiting, self.partial, self.open = "", [], [], 0
        self.buffered, self.state, self.bytes, self.findings, self.replaced = 0, "accepting", 0, 0, 0

    @property
    def kept(self) -> str:
        """What waits: lines of an open key block, and the line without an end."""
        return "".join([*self.waiting, *self.partial])

    def saved(self) -> str:
        """All that ``restored`` needs but the limits and configuration."""
        return json.dumps([self.context, self.waiting, self.partial, self.open, self.buffered, self.state, self.bytes, self.findings, self.replaced])

    def restored(self, saved: str) -> Session:
        self.context, self.waiting, self.partial, self.open, self.buffered, self.state, self.bytes, self.findings, self.replaced = json.loads(saved)
        return self

    def _sanitize(self, text: str) -> str:
        whole = self.context + text
        data, at, out = whole.encode(), len(self.context.encode()), []
        for c in scanner(self.config).scan(whole):
            if c.start < at:
                continue
            self.findings += 1
            if default_action(c.type, c.confidence) in ("redact", "block"):
                self.replaced += 1
                out += [data[at : c.start], f"<SECRET_{self.replaced}>".encode()]
                at = c.end
        lines = whole.rsplit("\n", REACH + 1)
        self.context = whole if len(lines) <= REACH + 1 else "\n".join(lines[1:])
        return b"".join([*out, data[at:]]).decode()

    def _fail(self, code: str) -> tuple[str, str]:
        self.context, self.waiting, self.partial, self.buffered, self.state = "", [], [], 0, "failed"
        return "", code

    def _closed(self, lines: str) -> str:
        """Takes in whole lines; what can be given out now."""
        if not self.open and "-----BEGIN " not in (lines if lines.isascii() else INVISIBLE_RUN.sub("", lines)):
            return lines
        ready = []
        for line in re.findall(r"[^\n]*\n", lines):
            was_open = self.open
            for m in PEM.finditer(INVISIBLE_RUN.sub("", line).encode()):
                self.open = self.open + 1 if m[1] == b"BEGIN" else max(0, self.open - 1)
            if was_open or self.open:
                self.waiting.append(line)
                self.buffered += len(line.encode())
            if not self.open:
                ready += [*self.waiting, *([] if was_open else [line])]
                self.buffered -= sum(len(w.encode()) for w in self.waiting)
                self.waiting = []
        return "".join(ready)

    def append(self, chunk: str) -> tuple[str, str | None]:
        if self.state != "accepting":
            return "", CODES[0]
        size = len(chunk.encode())
        self.bytes += size
        if self.bytes > self.limits.most_bytes:
            return self._fail(CODES[1])
        end = chunk.rfind("\n") + 1
        ready = ""
        if end:
            lines = "".join([*self.partial, chunk[:end]])
            self.buffered -= sum(len(p.encode()) for p in self.partial)
            self.partial = []
            ready = self._closed(lines)
        if end < len(chunk):
            self.partial.append(chunk[end:])
            self.buffered += len(chunk[end:].encode())
        if self.buffered > self.limits.most_buffered:
            return self._fail(CODES[2])
        return self._sanitize(ready) if ready else "", None

    def finish(self) -> tuple[str, str | None]:
        if self.state != "accepting":
            return "", CODES[0]
        out = self._sanitize(self.kept)
        self.context, self.waiting, self.partial, self.buffered, self.state = "", [], [], 0, "finalized"
        return out, None

    def abort(self) -> tuple[str, str | None]:
        if self.state != "accepting":
            return "", CODES[0]
        self.context, self.waiting, self.partial, self.buffered, self.state = "", [], [], 0, "aborted"
        return "", None


def sanitize_stream(chunks: DataFrame, config: ScanConfig = ScanConfig(), limits: SessionLimits = SessionLimits(), timeout: str | None = "10 minutes") -> DataFrame:
    """``chunks`` (stream_id, seq, chunk, op: append, finalize or abort) as sanitized output rows.

    The state of a stream is its open tail, counters and chunks that came early. Chunks are
    taken in the order of ``seq`` from 0; one that isn't the next waits for those before it,
    within the limit on buffered text. A stream that is silent for ``timeout`` fails, and gives
    up what it holds without emitting it (``None``: never). With a timeout Spark keeps running
    batches to look for silent streams, so give such a query a processing-time trigger. The
    checkpoint holds plain text: keep it encrypted.
    """
    wait = int(re.match(r"\d+", timeout)[0]) * {"s": 1000, "m": 60_000, "h": 3_600_000}[timeout.split()[1][0]] if timeout else 0

    def step(key, batches, held: GroupState):
        session, following, early = Session(config, limits), 0, {}
        if held.exists:
            following, saved, waiting = held.get
            session.restored(saved)
            early = {int(k): v for k, v in json.loads(waiting).items()}
        rows = []
        row = lambda seq, text, error: rows.append((key[0], seq, text, session.state, error, session.findings, session.replaced))
        if held.hasTimedOut:
            session._fail(CODES[3])
            row(following, "", CODES[3])
            held.remove()
        else:
            for frame in batches:
                early.update({int(s): (c or "", o) for s, c, o in zip(frame["seq"], frame["chunk"], frame["op"], strict=True) if s >= following})
            while following in early:
                chunk, op = early.pop(following)
                row(following, *(session.append(chunk) if op == "append" else session.finish() if op == "finalize" else session.abort()))
                following += 1
            if session.state == "accepting" and sum(len(c.encode()) for c, _ in early.values()) > limits.most_buffered:
                row(following, *session._fail(CODES[2]))
                early = {}
            held.update((following, session.saved(), json.dumps(early)))
            if wait and session.state == "accepting":
                held.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "text", "state", "error", "findings", "replaced"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def sanitize_batch(chunks: DataFrame, config: ScanConfig = ScanConfig(), limits: SessionLimits = SessionLimits()) -> DataFrame:
    """The same for a table of chunks: one row for each stream with its whole sanitized text.

    Chunks are dealt out by stream and sorted; a task then has one session at a time.
    """

    def run(batches):
        import pyarrow as pa

        names = ["stream_id", "text", "state", "error", "findings", "replaced"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        session, stream, out, error, rows = None, None, [], None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        ended = lambda: (stream, "".join(out), session.state, error, session.findings, session.replaced)
        for batch in batches:
            for following, chunk, op in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "chunk", "op")), strict=True):
                if session is None or following != stream:
                    if session is not None:
                        rows.append(ended())
                    session, stream, out, error = Session(config, limits), following, [], None
                text, failed = session.append(chunk or "") if op == "append" else session.finish() if op == "finalize" else session.abort()
                out.append(text)
                error = error or failed
            if len(rows) >= 1024:
                yield made()
                rows = []
        if session is not None:
            rows.append(ended())
        if rows:
            yield made()

    ordered = chunks.select("stream_id", "seq", "chunk", "op").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInArrow(run, "stream_id string, text string, state string, error string, findings long, replaced long")
