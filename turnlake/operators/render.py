"""Conversations as Markdown: a fold over each transcript's lines in order, which writes text as it goes."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.sources.transcripts import CALLS, OUTPUTS, detect_harness

#: The marks of the format.
START, END = "\n---\n**🔀 SIDECHAIN START**\n---\n\n", "\n---\n**🔀 SIDECHAIN END**\n---\n\n"
TITLE, BODY = "# Conversation\n\n## Metadata\n\n", "---\n\n## Messages\n\n"
FIRST_LABELS = (("sessionId", "Session ID"), ("gitBranch", "Git Branch"), ("cwd", "Working Directory"), ("version", "Agent Version"))
SECOND_LABELS = (("session_id", "Session ID"), ("git_branch", "Git Branch"), ("cwd", "Working Directory"), ("cli_version", "Codex Version"), ("model", "Model"), ("model_provider", "Model Provider"))
#: A tool's result is looked up in so many messages behind its use; longer results are fenced.
AHEAD, INLINE = 5, 100
#: Characters after which a part of the output ends, at the next message.
PART = 1 << 16


def _number(text: str):
    x = float(text)
    return int(x) if x.is_integer() else x


def _parsed(raw: str | None) -> dict | None:
    try:
        out = json.loads(raw or "", parse_float=_number)
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def _pretty(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _when(stamp) -> str:
    try:
        t = datetime.fromisoformat(stamp)
    except (TypeError, ValueError):
        return "Invalid Date"
    t = t.astimezone(timezone.utc) if t.tzinfo else t
    return f"{t.month}/{t.day}/{t.year}, {t.hour % 12 or 12}:{t.minute:02}:{t.second:02} {'PM' if t.hour >= 12 else 'AM'}"


def _text(content) -> str:
    if isinstance(content, str):
        return content
    return "\n".join(b["text"] for b in content if isinstance(b, dict) and isinstance(b.get("text"), str)) if isinstance(content, list) else ""


def _blocks(message: dict) -> list[dict]:
    content = (message.get("message") or {}).get("content")
    return [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []


def _kept(message: dict) -> bool:
    inner = message.get("message") or {}
    some = inner.get("content") or message.get("type") == "assistant" and inner.get("usage")
    return message.get("type") in ("user", "assistant") and bool(message.get("timestamp")) and bool(some)


class FirstDialect:
    """Messages wait until those behind them, in which a tool's result may be, are there."""

    def __init__(self, header: dict):
        self.waiting: deque[tuple[int, dict]] = deque()
        self.seen, self.side, self.any = 0, False, False

    def take(self, line: dict) -> Iterator[str]:
        if not _kept(line):
            return
        if not self.seen:
            yield TITLE + "".join(f"**{label}:** {line[key]}\n\n" for key, label in FIRST_LABELS if line.get(key)) + BODY
        self.waiting.append((self.seen, line))
        self.seen += 1
        if len(self.waiting) > AHEAD:
            yield self._message(*self.waiting.popleft())

    def end(self) -> Iterator[str]:
        while self.waiting:
            yield self._message(*self.waiting.popleft())
        if self.side:
            yield END

    def _message(self, i: int, m: dict) -> str:
        blocks, content, user = _blocks(m), m["message"].get("content"), m["type"] == "user"
        if user and isinstance(content, list) and all(b.get("type") == "tool_result" for b in blocks):
            return ""
        side, out = bool(m.get("isSidechain")), []
        if side != self.side:
            out.append(START if side else END)
            self.side = side
        role = ("Agent" if user else "Subagent") if side else ("User" if user else "Agent")
        out.append(f"### **{role}** ({_when(m['timestamp'])}) {{#{m.get('uuid') or f'msg-{i}'}}}\n\n")
        if user and m.get("toolUseResult"):
            given = m["toolUseResult"]
            out.append("**Tool Result:**\n\n")
            for r in [given] if isinstance(given, str) else given if isinstance(given, list) else []:
                out.append(f"{(r.get('text') or '[object Object]') if isinstance(r, dict) else r}\n\n")
        elif isinstance(content, str):
            out.append(f"{content}\n\n")
        else:
            for b in blocks:
                if b.get("type") == "text" and b.get("text"):
                    out.append(f"{b['text']}\n\n")
                elif b.get("type") == "tool_use" and not user:
                    out += [f"**Tool Use:** `{b.get('name')}`\n\n", *self._input(b.get("input")), *self._result(b.get("id"))]
        usage = None if user else m["message"].get("usage")
        if usage:
            told = [f"in: {usage.get('input_tokens') or 0:,}"]
            told += [f"{label}: {usage[key]:,}" for key, label in (("cache_read_input_tokens", "cache read"), ("cache_creation_input_tokens", "cache create")) if usage.get(key)]
            out.append(f"_{' | '.join([*told, f'out: {usage.get("output_tokens") or 0:,}'])}_\n\n")
        return "".join(out)

    @staticmethod
    def _input(given) -> Iterator[str]:
        if isinstance(given, (dict, list)):
            for key, value in given.items() if isinstance(given, dict) else enumerate(given):
                if isinstance(value, str):
                    yield f"- **{key}:**\n```\n{value}\n```\n" if "\n" in value else f"- **{key}:** {value}\n"
                else:
                    yield f"- **{key}:**\n```json\n{_pretty(value)}\n```\n"
            yield "\n"

    def _result(self, use) -> Iterator[str]:
        found = next((b for _, m in self.waiting if m["type"] == "user" for b in _blocks(m) if b.get("type") == "tool_result" and b.get("tool_use_id") == use), None) if use else None
        if found is not None:
            content = found.get("content")
            yield "**Result:**\n"
            if isinstance(content, str):
                yield f"```\n{content}\n```\n\n" if "\n" in content or len(content) > INLINE else f"{content}\n\n"
            elif isinstance(content, list):
                yield f"```json\n{_pretty(content)}\n```\n\n"


class SecondDialect:
    """Records are written as they come; the metadata, which later ones may change, is in the header."""

    def __init__(self, header: dict):
        self.header, self.seen = header, 0

    def take(self, line: dict) -> Iterator[str]:
        i, p = self.seen, line.get("payload")
        self.seen += 1
        if not i:
            yield self._head()
        if line.get("type") != "response_item" or not isinstance(p, dict):
            return
        kind, at, anchor = p.get("type"), _when(line["timestamp"]) if line.get("timestamp") else "", p.get("call_id") or f"msg-{i}"
        if kind == "message" and (text := _text(p.get("content"))).strip():
            yield f"### **{'User' if p.get('role') == 'user' else 'Agent'}** ({at}) {{#{anchor}}}\n\n{text}\n\n"
        elif kind in CALLS:
            yield f"### **Tool Use** ({at}) {{#{anchor}}}\n\n**Tool Use:** `{p.get('name') or p.get('namespace') or kind}`\n\n{self._input(p)}"
        elif kind in OUTPUTS:
            result = self._output(p.get("output"))
            yield f"### **Tool Result** ({at}) {{#{anchor}-result}}\n\n**Result:**\n" + (f"```\n{result}\n```\n\n" if "\n" in result or len(result) > INLINE else f"{result}\n\n")
        elif kind == "reasoning" and (text := _text(p.get("summary"))).strip():
            yield f"### **Reasoning Summary** ({at}) {{#{anchor}}}\n\n{text}\n\n"

    def _head(self) -> str:
        return TITLE + "**Harness:** Codex\n\n" + "".join(f"**{label}:** {self.header[key]}\n\n" for key, label in SECOND_LABELS if self.header.get(key)) + BODY

    def end(self) -> Iterator[str]:
        return iter(() if self.seen else (self._head(),))

    @staticmethod
    def _input(p: dict) -> str:
        given = next((p[k] for k in ("arguments", "input", "action") if k in p), None)
        if isinstance(p.get("arguments"), str):
            try:
                given = json.loads(given, parse_float=_number)
            except ValueError:
                pass
        if given is None:
            return ""
        if isinstance(given, str):
            return f"```\n{given}\n```\n\n"
        if not isinstance(given, (dict, list)):
            return f"{json.dumps(given)}\n\n"
        out = [f"- **{k}:** {v}\n" if isinstance(v, str) and "\n" not in v else f"- **{k}:**\n```json\n{v if isinstance(v, str) else _pretty(v)}\n```\n"
               for k, v in (given.items() if isinstance(given, dict) else enumerate(given))]
        return "".join([*out, "\n"]) if out else ""

    @staticmethod
    def _output(given) -> str:
        if given is None:
            return ""
        text = _text(given)
        return text if isinstance(given, str) or text.strip() else _pretty(given)


HEADER = ("harness", *(key for key, _ in SECOND_LABELS))


def _folding(part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, fold, held, size, number = None, None, [], 0, 0

        def cut(texts: Iterator[str], last: bool) -> Iterator[tuple[str, int, str]]:
            nonlocal held, size, number
            for t in texts:
                held.append(t)
                size += len(t)
                if size >= part:
                    yield path, number, "".join(held)
                    held, size, number = [], 0, number + 1
            if last and (size or not number):
                yield path, number, "".join(held)

        for batch in batches:
            rows: list[tuple[str, int, str]] = []
            for r in batch.to_pylist():
                if fold is None or r["path"] != path:
                    if fold is not None:
                        rows += cut(fold.end(), True)
                    path, held, size, number = r["path"], [], 0, 0
                    fold = (SecondDialect if r["harness"] == "codex" else FirstDialect)(r)
                line = _parsed(r["raw"])
                if line is not None:
                    rows += cut(fold.take(line), False)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["path", "part", "markdown"])
        if fold is not None:
            rows = list(cut(fold.end(), True))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["path", "part", "markdown"])

    return run


def transcript_headers(lines: DataFrame) -> DataFrame:
    """path, harness and, for the second dialect, the last value of each metadata field that isn't empty."""
    value = lambda kind, at: F.when(F.get_json_object("raw", "$.type").isin(*kind), F.nullif(F.get_json_object("raw", f"$.payload.{at}"), F.lit("")))
    meta, turn = "session_meta", "turn_context"
    found = {"session_id": value([meta], "id"), "git_branch": value([meta], "git.branch"), "cwd": value([meta, turn], "cwd"), "cli_version": value([meta], "cli_version"),
             "model": value([turn], "model"), "model_provider": value([meta], "model_provider")}
    last = lines.filter(F.col("raw").contains("session_meta") | F.col("raw").contains("turn_context")).groupBy("path").agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col("line_no"))).alias(n) for n, v in found.items()])
    return detect_harness(lines).join(last, "path", "left")


def render_conversations(lines: DataFrame, part: int = PART) -> DataFrame:
    """Path, part, markdown of transcripts (path, line_no, raw), their text in parts of about `part` characters in order.

    A transcript's lines pass one task in order, of which it holds the last messages and the part that it writes, never
    the whole. Lines that don't parse are left out; a transcript without messages has one part, empty in the first dialect.
    """
    headed = lines.select("path", "line_no", "raw").join(transcript_headers(lines), "path")
    return headed.repartition("path").sortWithinPartitions("path", "line_no").select("path", "raw", *HEADER).mapInArrow(_folding(part), "path string, part int, markdown string")


def whole_conversations(parts: DataFrame) -> DataFrame:
    """path, markdown of rendered parts, for conversations that fit into a row."""
    return parts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "markdown"))), lambda x: x["markdown"]), "").alias("markdown"))
