"""Round trips of the readers: rows of the tables are written in a source's format, read by its reader and must come back as they were."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.plans.catalog import query
from evidex.session import load, scratch_path
from evidex.sources import artifacts as A
from evidex.sources import exports as X
from evidex.sources import sinks as K

_MEMBERS_SQL = "(select id, unnest(message_ids) as e, generate_subscripts(message_ids, 1) - 1 as n from segments where len(message_ids) > 0)"


@query(f"select 'chatgpt' as source_kind, id as conversation_id, e as external_id, cast(n as integer) as sequence_index, case when n % 2 = 0 then 'user' else 'assistant' end as role, 'text of ' || e || chr(10) || '[image_asset_pointer: p]' as content_text from {_MEMBERS_SQL}")
def chatgpt_tree_messages(spark, d):
    """Segments as trees: each message is the child of the one before; the nodes come unordered in the mapping."""
    s = load(spark, d, "segments").where("size(message_ids) > 0").select("id", "message_ids")
    m = F.col("message_ids")
    part = F.struct(F.lit("image_asset_pointer").alias("content_type"), F.lit("p").alias("asset_pointer"))
    node = lambda e, i: F.concat(
        F.lit('"'), e, F.lit('":{"parent":'), F.when(i > 0, F.concat(F.lit('"'), F.get(m, i - 1), F.lit('"'))).otherwise("null"), F.lit(',"children":['),
        F.when(i < F.size(m) - 1, F.concat(F.lit('"'), F.get(m, i + 1), F.lit('"'))).otherwise(""), F.lit('],"message":{"id":"'), e, F.lit('","author":{"role":"'), F.when(i % 2 == 0, "user").otherwise("assistant"),
        F.lit('"},"content":{"content_type":"multimodal_text","parts":["text of '), e, F.lit('",'), F.to_json(part), F.lit("]}}}"),
    )
    nodes = F.array_sort(F.transform(m, node))
    whole = F.concat(F.lit('{"conversation_id":"'), "id", F.lit('","title":"t","mapping":{'), F.array_join(nodes, ","), F.lit("}}"))
    got = _read_back(spark, s.select(whole.alias("value")), "chatgpt")
    return got.select("source_kind", "conversation_id", "external_id", "sequence_index", "role", "content_text")


def _read_back(spark, df, kind):
    """What the reader of a kind makes of documents (value) written as files of lines."""
    path = scratch_path(spark, "export")
    df.repartition(8).write.text(path)
    return X.read_export(spark, path, kind, glob="*.txt")


@query(f"select 'claude' as source_kind, id as conversation_id, e as external_id, cast(n as integer) as sequence_index, 'human' as role, 'text of ' || e || chr(10) || '[tool_use:search]' as content_text from {_MEMBERS_SQL}")
def claude_messages(spark, d):
    s = load(spark, d, "segments").where("size(message_ids) > 0")
    message = lambda e: F.struct(
        e.alias("uuid"), F.lit("human").alias("sender"), F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("text of "), e).alias("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("search").alias("name"))).alias("content")
    )
    whole = F.to_json(F.struct(F.col("id").alias("uuid"), F.transform("message_ids", message).alias("chat_messages")))
    return _read_back(spark, s.select(whole.alias("value")), "claude").select("source_kind", "conversation_id", "external_id", "sequence_index", "role", "content_text")


@query("""
select 'gemini' as source_kind, 'u' || id as conversation_id, 0 as sequence_index, 'user' as role, 'ask ' || id as content_text from conversations
union all select 'gemini', 'u' || id, 1, 'assistant', 'Answer to ' || id || chr(10) || 'a < b' from conversations""")
def gemini_messages(spark, d):
    page = F.concat(F.lit("<div><p>Answer   to "), "id", F.lit("</p><p>a &lt; b</p></div>"))
    activity = F.to_json(F.struct(F.concat(F.lit("Prompted ask "), "id").alias("title"), F.concat(F.lit("u"), "id").alias("titleUrl"), F.array(F.struct(page.alias("html"))).alias("safeHtmlItem")))
    return _read_back(spark, load(spark, d, "conversations").select(activity.alias("value")), "gemini").select("source_kind", "conversation_id", "sequence_index", "role", "content_text")


@query("select doc_id, 'Document ' || doc_id || chr(10) || 'source & more' as text from documents")
def html_texts(spark, d):
    page = F.concat(F.lit("<html><script>x()</script><h1>Document   "), F.col("doc_id").cast("string"), F.lit("</h1><br><p>source &amp;   more</p></html>"))
    return load(spark, d, "documents").select("doc_id", T.html_to_text(page).alias("text"))


_COMMITS_SQL = "(select item_id, provenance.commit_sha || substr(sha256(item_id), 1, 12) as sha, external_id from corpus_rows where regexp_matches(provenance.commit_sha, '^[0-9a-f]{10}$'))"


@query(f"""
select sha, external_id as author_name, 0 as at, 3 as added, 1 as deleted, 'src/a/' || item_id || '.py' as old_path, 'src/b/' || item_id || '.py' as path, false as "binary" from {_COMMITS_SQL}
union all select sha, external_id, 1, null, null, 'img.png', 'img.png', true from {_COMMITS_SQL}""")
def git_changes(spark, d):
    c = load(spark, d, "corpus_rows").where(F.col("provenance.commit_sha").rlike("^[0-9a-f]{10}$")).select("item_id", "provenance.commit_sha", "external_id")
    c = c.withColumn("sha", F.concat("commit_sha", F.substring(F.sha2("item_id", 256), 1, 12)))  # a hash for each row
    fields = ["sha", F.lit(""), "external_id", F.lit("a@x"), F.lit("t"), F.lit("c"), F.lit("c@x"), F.lit("t"), F.lit("refs"), F.lit("subject")]
    stat = F.concat(F.lit("\n3\t1\tsrc/{a => b}/"), "item_id", F.lit(".py\n-\t-\timg.png\n"))
    path = scratch_path(spark, "gitlog")
    c.select(F.concat(F.concat_ws(A.FIELD, *fields, stat), F.lit(A.RECORD)).alias("value")).write.text(path)
    log = A.git_log(spark, path)
    return A.numstat(log).join(log.select("sha", "author_name"), "sha").select("sha", "author_name", "at", "added", "deleted", "old_path", "path", "binary")


@query(r"""
with f as (select doc_id::varchar || '.md' as path, source from documents)
select path, 0 as section, 'Intro of ' || path as text from f union all select path, 1, '## First' || chr(10) || chr(10) || 'one' from f union all select path, 2, '## Second' || chr(10) || chr(10) || 'two' from f""")
def markdown_sections(spark, d):
    f = load(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    body = F.concat(F.lit("Intro of "), "path", F.lit("\n\n## First\n\none\n\n## Second\n\ntwo"))
    return A.synthetic_segments(f.withColumn("body", body)).select("path", "section", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


@query("""
select doc_id, 'image' as kind, 'i.png' as target from documents union all select doc_id, 'inline_url', 'https://x.test/' || doc_id from documents union all select doc_id, 'wikilink', 'Page ' || doc_id from documents
union all select doc_id, 'autolink', 'https://y.test' from documents union all select doc_id, 'tag', 'topic' from documents""")
def markdown_links(spark, d):
    i = F.col("doc_id").cast("string")
    body = F.concat(F.lit("![a](i.png) and [b](https://x.test/"), i, F.lit(") or [[Page "), i, F.lit("|alias]] <https://y.test> #topic\n```\n[no](z)\n```"))
    return A.markdown_links(load(spark, d, "documents").select(i.alias("path"), body.alias("body"))).select(F.col("path").cast("long").alias("doc_id"), "kind", "target")


@query("""select doc_id, 'Doc ' || doc_id as title, 'note' as kind from documents""")
def front_matter(spark, d):
    front = F.concat(F.lit("title: \"Doc "), F.col("doc_id").cast("string"), F.lit("\"\nkind: note\ntags:\n  - a\nkind: other"))
    m = A.front_fields(front)
    return load(spark, d, "documents").select("doc_id", m["title"].alias("title"), m["kind"].alias("kind"))


@query(f"""
select id as dialog_id, cast(n as integer) as turn from (select *, last_value(topic ignore nulls) over (partition by id order by n rows between unbounded preceding and 1 preceding) as before
  from (select *, case when substr(e, 1, 1) < '8' then 'low' when substr(e, 1, 1) < 'e' then 'high' end as topic from {_MEMBERS_SQL})) where before is not null and topic is distinct from before""")
def dialogue_boundaries(spark, d):
    t = load(spark, d, "segments").select(F.col("id").alias("dialog_id"), F.posexplode("message_ids").alias("turn", "e"))
    first = F.substring("e", 1, 1)
    return A.topic_boundaries(t.select("dialog_id", "turn", F.lit(None).cast("int").alias("label"), F.when(first < "8", "low").when(first < "e", "high").alias("topic")))


@query(r"""
with l as (select item_id as path, unnest(string_split(content, chr(10))) as t, generate_subscripts(string_split(content, chr(10)), 1) as line from corpus_rows where content is not null),
f as (select path, line, 'rfc' as kind, unnest(regexp_extract_all(t, '(?i)\brfc[\s_-]*0*(\d{1,5})\b', 1)) as target from l union all select path, line, 'decision', unnest(regexp_extract_all(t, '\bD(\d{2,5})\b', 1)) from l
  union all select path, line, 'phase', unnest(regexp_extract_all(t, '(?i)\bphase[\s_-]*(\d{1,2})\b', 1)) from l)
select kind, target, first(path order by path, line) as path, cast(first(line order by path, line) as integer) as line from f group by kind, target""")
def first_citations(spark, d):
    return A.cited_references(load(spark, d, "corpus_rows").select(F.col("item_id").alias("path"), F.col("content").alias("body")))


@query("""
select item_id, array_to_string(list_filter([case when trim(coalesce(export_timezone, '')) = '' then 'missing_export_timezone' end, case when trim(coalesce(content, '')) = '' then 'missing_content' end,
  case when sub_kind not in ('commit', 'rfc', 'run_summary') then 'unknown_sub_kind' end, case when redaction_state not in ('none') then 'unknown_redaction_state' end], lambda x: x is not null), ',') as errors from corpus_rows""")
def contract_errors(spark, d):
    e = A.contract_errors(load(spark, d, "corpus_rows"), ["export_timezone", "content"], {"sub_kind": ["commit", "rfc", "run_summary"], "redaction_state": ["none"]})
    return e.select("item_id", F.array_join("errors", ",").alias("errors"))


@query("select distinct id, source_kind from conversations where id is not null")
def inserted_once(spark, d):
    """Half of the rows, then all of them: each key is there once."""
    c = load(spark, d, "conversations").where("id is not null").select("id", "source_kind")
    path = scratch_path(spark, "once")
    K.append_once(c.where("id < '8'"), path, ["id"])
    K.append_once(c, path, ["id"])
    return spark.read.parquet(path)


@query("select id, privacy_tier, predicate from claims where privacy_tier <= 1")
def exported_labels(spark, d):
    path = scratch_path(spark, "labels")
    K.export_jsonl(load(spark, d, "claims").select("id", "privacy_tier", "predicate"), path)
    return spark.read.schema("id string, privacy_tier int, predicate string").json(path)


@query("select item_id, sub_kind, external_id from corpus_rows")
def bundle_rows(spark, d):
    """Rows written as a bundle's JSONL files, with the manifest that describes them, come back without a defect."""
    path = scratch_path(spark, "bundle")
    c = load(spark, d, "corpus_rows").select("item_id", "sub_kind", F.concat_ws("#", "external_id", "item_id").alias("external_id"))
    c.repartition(9).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/parts")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/parts")
    listed = files.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.txt$", ".jsonl").alias("name"), F.col("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), (F.size(F.split(F.col("content").cast("string"), "\n")) - 1).alias("rows")).collect()  # nine files
    fs = spark._jvm.org.apache.hadoop.fs
    home = fs.Path(path)
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in listed:
        system.rename(fs.Path(r["path"]), fs.Path(f"{path}/{r['name']}"))
    spark.createDataFrame([([{"name": r["name"], "sha256": r["sha256"], "bytes": r["bytes"], "rows": r["rows"]} for r in listed],)], "files array<struct<name:string,sha256:string,bytes:bigint,rows:bigint>>").coalesce(1).write.json(f"{path}/manifest.json")
    rows, defects = A.read_bundle(spark, path)
    bad = defects.agg(F.count(F.lit(1)).alias("bad")).withColumn("one", F.lit(1))  # one row
    item = F.get_json_object("row", "$.item_id")
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(bad), "one").where("bad = 0").select(item.alias("item_id"), "sub_kind", F.expr("substring(external_id, 1, instr(external_id, '#') - 1)").alias("external_id"))
