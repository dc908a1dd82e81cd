import hashlib
import json
import zipfile

from pyspark.sql import functions as F

from evidex.sources import artifacts as A
from evidex.sources import exports as X
from evidex.sources import sinks


def test_chatgpt_tree(spark, tmp_path):
    node = lambda parent, children, text=None, role="user": {"parent": parent, "children": children, "message": text and {"id": text, "author": {"role": role}, "content": {"parts": text if isinstance(text, list) else [text]}, "create_time": 1.5}}
    conv = {"id": "c", "title": "t", "mapping": {"root": node(None, ["a", "b"]), "b": node("root", [], "third"), "a": node("root", ["d"], "first"), "d": node("a", [], "second", "assistant"), "lost": node("lost2", [], "fourth"), "lost2": node("lost", ["lost"])}}
    (tmp_path / "conversations.json").write_text(json.dumps([conv, "odd"]))
    (tmp_path / "broken.json").write_text("{")
    rows = X.read_export(spark, str(tmp_path), "chatgpt").orderBy("sequence_index").collect()
    assert [(r["sequence_index"], r["content_text"], r["role"]) for r in rows] == [(0, "first", "user"), (1, "second", "assistant"), (2, "third", "user"), (3, "fourth", "user")]


def test_claude_zip_and_gemini(spark, tmp_path):
    conv = {"uuid": "c", "name": "n", "chat_messages": [{"uuid": "1", "sender": "human", "content": [{"type": "text", "text": "hi"}, {"type": "tool_result", "name": "x", "content": [{"type": "text", "text": "in"}]}]}, "gap", {"uuid": "2", "sender": "assistant", "text": " "}]}
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("export/conversations.json", json.dumps([conv]))
    rows = X.read_export(spark, str(tmp_path), "claude").orderBy("sequence_index").collect()
    assert [(r["sequence_index"], r["content_text"]) for r in rows] == [(0, "hi\n[tool_result:x]\nin"), (2, None)]
    g = tmp_path / "g"
    g.mkdir()
    (g / "MyActivity.json").write_text(json.dumps([{"title": "Prompted why", "time": "2024", "safeHtmlItem": [{"html": "<p>so</p>"}]}, {"title": "Visited"}]))
    assert [(r["role"], r["content_text"]) for r in X.read_export(spark, str(g), "gemini").collect()] == [("user", "why"), ("assistant", "so")]


def test_git(spark, tmp_path):
    rec = A.FIELD.join(["abcdef1", "", "n", "e", "t", "n", "e", "t", "refs", "msg", "\n3\t1\tsrc/{a => b}/x.py\n-\t-\timg.png\n1\t0\told.md => new.md\n"])
    (tmp_path / "log.txt").write_text(A.RECORD + rec + A.RECORD)
    commits = A.git_log(spark, str(tmp_path / "log.txt"))
    rows = A.numstat(commits).orderBy("at").collect()
    assert [(r["old_path"], r["path"], r["added"], r["binary"]) for r in rows] == [("src/a/x.py", "src/b/x.py", 3, False), ("img.png", "img.png", None, True), ("old.md", "new.md", 1, False)]


def test_markdown(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: Named\n---\nintro [l](u.md) ![i](p.png) [[Wiki|w]] <https://x.y> #tag\n# One\ntext\n## Two\n```\n[no](no)\n```\n")
    (tmp_path / "e.md").write_text("\n")
    files = A.markdown_files(spark, str(tmp_path)).cache()
    by = {r["path"].rsplit("/", 1)[-1]: r for r in files.collect()}
    assert by["n.md"]["title"] == "Named" and by["e.md"]["title"] == "e"
    assert [(r["level"], r["heading"], r["anchor"]) for r in A.markdown_chunks(files).orderBy("chunk").collect()] == [(0, None, "section"), (1, "One", "one"), (2, "Two", "two")]
    assert {(r["kind"], r["target"]) for r in A.markdown_links(files).collect()} == {("inline_url", "u.md"), ("image", "p.png"), ("wikilink", "Wiki"), ("autolink", "https://x.y"), ("tag", "tag")}
    cited = A.cited_references(spark.createDataFrame([("a", "see RFC 44\nD077, rfc-0044"), ("b", "D077")], "path string, body string"))
    assert {(r["kind"], r["target"], r["path"], r["line"]) for r in cited.collect()} == {("rfc", "44", "a", 1), ("decision", "077", "a", 2)}


def test_build_artifacts(spark, tmp_path):
    (tmp_path / "junit.xml").write_text('<testsuite><testcase classname="c" name="a" time="1.5"/><testcase classname="c" name="b"><failure message="no"/></testcase></testsuite>')
    (tmp_path / "coverage.json").write_text("{broken")
    (tmp_path / "run.log").write_text("password: hunter2\nok")
    files, found = A.build_artifacts(spark, str(tmp_path))
    assert {(r["kind"], r["level"], r["name"]) for r in found.collect()} == {("junit", "passed", "c.a"), ("junit", "failure", "c.b"), ("other", "warn", "parse failed")}
    log = files.where("kind = 'log'").first()
    assert log["sensitive"] and "hunter2" not in log["body"]


def test_bundle(spark, tmp_path):
    data = '{"sub_kind":"a","external_id":"1"}\n{"sub_kind":"a","external_id":"1"}\n'
    (tmp_path / "a.jsonl").write_text(data)
    (tmp_path / "b.jsonl").write_text("{}\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"files": [{"name": "a.jsonl", "sha256": hashlib.sha256(data.encode()).hexdigest(), "bytes": len(data), "rows": 2}, {"name": "b.jsonl", "sha256": "0", "bytes": 3, "rows": 1}, {"name": "c.jsonl", "sha256": "0", "bytes": 3, "rows": 1}]}))
    rows, defects = A.read_bundle(spark, str(tmp_path))
    assert rows.count() == 3
    assert {(r["file"], r["defect"]) for r in defects.collect()} == {("a.jsonl", "repeated a 1"), ("b.jsonl", "sha256"), ("c.jsonl", "missing")}


def test_topics_contract_and_sinks(spark, tmp_path):
    turns = spark.createDataFrame([("l", 0, 0, None), ("l", 1, 1, None), ("l", 2, 1, None), ("t", 0, None, "a"), ("t", 1, None, None), ("t", 2, None, "a"), ("t", 3, None, "b")], "dialog_id string, turn int, label int, topic string")
    assert {tuple(r) for r in A.topic_boundaries(turns).collect()} == {("l", 2), ("t", 1), ("t", 3)}
    e = spark.createDataFrame([("x", "low"), (" ", "odd"), (None, None)], "name string, tier string")
    assert [r["errors"] for r in A.contract_errors(e, ["name"], {"tier": ["low"]}).collect()] == [[], ["missing_name", "unknown_tier"], ["missing_name"]]
    rows = spark.createDataFrame([("1", "a", 0), ("2", "b", 2)], "id string, h string, privacy_tier int")
    sinks.export_jsonl(rows, str(tmp_path / "j"))
    assert [json.loads(r[0])["id"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ["1"]
    t = str(tmp_path / "t")
    sinks.append_once(rows, t, ["id"], "h")
    sinks.append_once(rows.unionByName(spark.createDataFrame([("3", "c", 0)], rows.schema)), t, ["id"], "h")
    assert spark.read.parquet(t).count() == 3
    try:
        sinks.append_once(rows.withColumn("h", F.lit("z")), t, ["id"], "h")
        raise AssertionError("drift not noticed")
    except ValueError:
        pass
    assert sinks.audit_row(rows, "s", "id").first()["signature"] == sinks.audit_row(rows.orderBy(F.desc("id")), "s", "id").first()["signature"]
    assert "| id |" in sinks.report_markdown(rows, "t")


def test_content_of_exports():
    assert X.content_text({"parts": ["a", {"content_type": "image_asset_pointer", "file_id": "f"}, {"content_type": "image_asset_pointer"}, {"content_type": "audio"}, {"b": 1, "a": "ä"}]}) == "a\n[image_asset_pointer: f]\n[image_asset_pointer: unknown]\n[audio]\n{\"a\":\"\\u00e4\",\"b\":1}"
    assert X.content_text({"content_type": "model_editable_context", "model_set_context": "m", "repo_summary": None, "structured_context": "s"}) == "m\ns"
    assert X.content_text({"content_type": "code", "text": "x"}) is None and X.content_text({"parts": [" "]}) is None and X.content_text(None) is None


def test_manifest_digest_and_signature(spark, tmp_path):
    import hashlib

    for name, text in (("b.json", "two"), ("a.json", "one")):
        (tmp_path / name).write_text(text)
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = h(f"a.json\0{h('one')}\0b.json\0{h('two')}\0")
    r = X.manifest_digest(X.manifest(spark, str(tmp_path)), str(tmp_path)).first()
    assert (r["file_count"], r["content_hash"]) == (2, want)
    from evidex.sources import sinks

    assert sinks.input_signature("root", "x") == h("root\0x")


def test_stable_ids_are_name_based_uuids(spark):
    import uuid

    from pyspark.sql import functions as F

    from evidex.sources import artifacts as A

    df = spark.createDataFrame([("a.md", "x\n## B\ny", "k: 'v'\nk: w\nlist:\n  - a"), ("é.md", "", None)], "path string, body string, front string")
    got = {(r["path"], r["section"]): (r["segment_id"], r["privacy_tier"]) for r in A.synthetic_segments(df).collect()}
    assert got == {("a.md", n): (str(uuid.uuid5(uuid.UUID(A.NAMESPACE), f"segment::a.md::{n}")), 2) for n in (0, 1)}
    assert [r["m"] for r in df.select(A.front_fields(F.col("front")).alias("m")).collect()] == [{"k": "v"}, {}]
