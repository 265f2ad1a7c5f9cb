"""Raw files: line numbers, folders, dialects and what doesn't parse."""

from turnlake.sources import transcripts as R


def test_read_transcripts(spark, tmp_path):
    for name, text in {"p0/a b.jsonl": '{"type":"user"}\n\nx\n', "p0/sub/skip/c.jsonl": "y", "p1/d.jsonl": "null\n" + '{"type":"event_msg","payload":{"a":1}}', "p1/e.txt": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    lines = R.read_transcripts(spark, str(tmp_path), ("skip",))
    got = sorted(tuple(r) for r in lines.collect())
    assert got == [("p0/a b.jsonl", "p0", 1, '{"type":"user"}'), ("p0/a b.jsonl", "p0", 2, ""), ("p0/a b.jsonl", "p0", 3, "x"),
                   ("p1/d.jsonl", "p1", 1, "null"), ("p1/d.jsonl", "p1", 2, '{"type":"event_msg","payload":{"a":1}}')]
    assert {tuple(r) for r in R.detect_harness(lines).collect()} == {("p0/a b.jsonl", "claude"), ("p1/d.jsonl", "codex")}


def test_marked_files(spark):
    raw = ['{"type":"user","message":{"content":"MARK"}}', '{"type":"user","message":{"content":[{"type":"tool_result","content":"MARK"}]}}', "MARK {", '{"type":"x","t":"MARK"}']
    lines = spark.createDataFrame([(str(i), 1, r) for i, r in enumerate(raw)], "path string, line_no int, raw string")
    assert {r[0] for r in R.find_marked_files(lines, ("MARK",)).collect()} == {"0", "2"}
