"""Answers with fences and open blocks, ids of paragraphs that clash, and conversations as Markdown."""

import hashlib
import json
import random

import pytest

from turnlake.operators import render, topics


def blocks(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r["kind"], r["slug"], r["text"]) for r in topics.parse_topic_answers(df).orderBy("n").collect()]


@pytest.mark.parametrize(("text", "want"), [
    (None, []), ("", []), ("noise\n=== END", []), ("=== FILE a\nx\n=== END", [("file", "a", "x\n")]), ("=== FILE a\r\nx\r\ny\r\n=== END \r\n", [("file", "a", "x\ny\n")]), ("=== FILE a\n=== END", [("file", "a", "\n")]),
    ("=== FILE a\nx\n=== FILE b\ny\n=== END", [("error", "a", None), ("file", "b", "y\n")]), ("=== FILE a\nx\n=== DELETE b", [("error", "a", None), ("delete", "b", None)]),
    ("=== FILE a\n~~~\n=== END\n```\n=== DELETE b\n~~~~ \n=== END\n=== DELETE  c d ", [("file", "a", "~~~\n=== END\n```\n=== DELETE b\n~~~~ \n"), ("delete", "c d", None)]),
    ("=== FILE a\n```\n=== END\n``\n=== END", [("error", "a", None)]), ("=== FILE\nx\n=== END", [("file", "", "x\n")]), ("=== FILEa\n=== DELETE", [("delete", "", None)])])
def test_answers(spark, text, want):
    assert blocks(spark, text) == want


def greedy(rows, digits):
    taken = {(p, i) for p, _, _, _, i in rows if i}
    out = {}
    for p, slug, no, text, given in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n = 0
        while not given:
            parts = [p, slug, text] + ([str(n)] if n else [])
            i = hashlib.sha1("\0".join(parts).encode()).hexdigest()[:digits]
            if (p, i) not in taken:
                break
            n += 1
        taken.add((p, given or i))
        out[p, slug, no] = given or i
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_unit_ids_are_those_of_one_after_the_other(spark, seed):
    rnd = random.Random(seed)
    rows = [(p, slug, no, rnd.choice("abcd"), None) for p in "pq" for slug in ("s", "t", "u") for no in range(4)]
    rows[3] = (*rows[3][:4], "7")
    units = spark.createDataFrame(rows, "project string, slug string, line_no int, text string, unit_id string")
    got = {(r["project"], r["slug"], r["line_no"]): r["unit_id"] for r in topics.assign_unit_ids(units, digits=1).collect()}
    assert got == greedy(rows, 1) and all(len({i for (p, _, _), i in got.items() if p == x}) == 12 for x in "pq")


def said(kind, at, content, **more):
    inner = {"role": kind, "content": content} | ({"usage": more.pop("usage")} if "usage" in more else {})
    return json.dumps({"type": kind, "timestamp": f"2024-03-05T{at}", "message": inner, **more})


def markdown(spark, raws, part=1 << 16):
    lines = spark.createDataFrame([("/p", i + 1, r) for i, r in enumerate(raws)], "path string, line_no int, raw string")
    return [r["markdown"] for r in render.render_conversations(lines, part).orderBy("part").collect()]


def test_first_dialect(spark):
    use = lambda i, **k: {"type": "tool_use", "id": i, "name": "Run", "input": k}
    result = lambda i, content: {"type": "tool_result", "tool_use_id": i, "content": content}
    raws = ["{broken", "", said("user", "13:05:09Z", "hi", sessionId="s", cwd="/w", uuid="u1"), said("assistant", "00:00:00Z", [use("a", x="1", y="l\nm", z=[1, {"k": 2.0}]), use("b"), use("c")], usage={"input_tokens": 1234, "cache_creation_input_tokens": 5}),
            said("user", "00:00:01Z", [result("a", "short")]), said("assistant", "00:00:02Z", "side", isSidechain=True), *[said("user", "00:00:03Z", [result("b", [{"type": "text"}])])], said("assistant", "00:00:04Z", [{"type": "text", "text": "x"}]),
            said("assistant", "00:00:05Z", []), said("assistant", "00:00:06Z", [], usage={"output_tokens": 7}), said("user", "00:00:07Z", [result("c", "too far")]), said("system", "00:00:08Z", "no"),
            said("user", "bad", "t", isSidechain=True, toolUseResult=["r", {"text": "q"}, {}])]
    head = "# Conversation\n\n## Metadata\n\n**Session ID:** s\n\n**Working Directory:** /w\n\n---\n\n## Messages\n\n### **User** (3/5/2024, 1:05:09 PM) {#u1}\n\nhi\n\n"
    tools = ("### **Agent** (3/5/2024, 12:00:00 AM) {#msg-1}\n\n**Tool Use:** `Run`\n\n- **x:** 1\n- **y:**\n```\nl\nm\n```\n- **z:**\n```json\n[\n  1,\n  {\n    \"k\": 2\n  }\n]\n```\n\n**Result:**\nshort\n\n"
             "**Tool Use:** `Run`\n\n\n**Result:**\n```json\n[\n  {\n    \"type\": \"text\"\n  }\n]\n```\n\n**Tool Use:** `Run`\n\n\n_in: 1,234 | cache create: 5 | out: 0_\n\n")
    rest = (render.START + "### **Subagent** (3/5/2024, 12:00:02 AM) {#msg-3}\n\nside\n\n" + render.END + "### **Agent** (3/5/2024, 12:00:04 AM) {#msg-5}\n\nx\n\n### **Agent** (3/5/2024, 12:00:06 AM) {#msg-6}\n\n_in: 0 | out: 7_\n\n"
            + render.START + "### **Agent** (Invalid Date) {#msg-8}\n\n**Tool Result:**\n\nr\n\nq\n\n[object Object]\n\n" + render.END)
    # the third tool's result is the sixth message behind its use
    assert markdown(spark, raws) == [head + tools + rest]
    parts = markdown(spark, raws, 50)
    assert "".join(parts) == head + tools + rest and len(parts) > 4
    assert markdown(spark, ["nothing"]) == [""]


def test_second_dialect(spark):
    item = lambda **p: json.dumps({"type": "response_item", "timestamp": "2024-03-05T12:00:00Z", "payload": p})
    raws = [json.dumps({"type": "session_meta", "payload": {"id": "s", "cwd": "/a"}}), item(type="message", role="user", content=[{"text": "ask"}]), item(type="reasoning", summary=[{"text": "why"}]),
            item(type="custom_tool_call", name="t", call_id="c", input="one\ntwo"), item(type="custom_tool_call_output", call_id="c", output="x" * 101), item(type="message", role="assistant", content=" "),
            json.dumps({"type": "turn_context", "payload": {"cwd": "", "model": "m"}}), item(type="local_shell_call", action={"a": "b", "c": 1})]
    stamp = "(3/5/2024, 12:00:00 PM)"
    want = ("# Conversation\n\n## Metadata\n\n**Harness:** Codex\n\n**Session ID:** s\n\n**Working Directory:** /a\n\n**Model:** m\n\n---\n\n## Messages\n\n"
            f"### **User** {stamp} {{#msg-1}}\n\nask\n\n### **Reasoning Summary** {stamp} {{#msg-2}}\n\nwhy\n\n### **Tool Use** {stamp} {{#c}}\n\n**Tool Use:** `t`\n\n```\none\ntwo\n```\n\n"
            f"### **Tool Result** {stamp} {{#c-result}}\n\n**Result:**\n```\n{'x' * 101}\n```\n\n### **Tool Use** {stamp} {{#msg-7}}\n\n**Tool Use:** `local_shell_call`\n\n- **a:** b\n- **c:**\n```json\n1\n```\n\n")
    assert markdown(spark, raws) == [want]
