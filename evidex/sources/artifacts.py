"""Readers of project artifacts: git logs, Markdown trees, build artifacts, bundles, dialogue sets."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions.text import has_secret, redact_secrets, slugify

# ---- git ----

#: Fields of a log written with --format using these separators.
FIELD, RECORD = "\u001f", "\u001e"
FIELDS = ["sha", "parents", "author_name", "author_email", "authored_at", "committer_name", "committer_email", "committed_at", "refs", "message"]


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit of log files with ten separated fields, and its numstat block."""
    records = spark.read.option("lineSep", RECORD).text(path).where(F.trim("value") != "")
    parts = F.split(F.regexp_replace("value", r"^\s+", ""), FIELD, len(FIELDS) + 1)
    return records.select(*(F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(FIELDS)), F.coalesce(F.get(parts, F.lit(len(FIELDS))), F.lit("")).alias("numstat")).where(F.col("sha").rlike("^[0-9a-f]{7,64}$"))


def renamed(path: Column) -> tuple[Column, Column]:
    """Old and new path of a numstat path: 'a/{b => c}/d' or 'a => b', else the same twice."""
    brace = r"^(.*)\{(.*) => (.*)\}(.*)$"
    plain = r"^(.*) => (.*)$"
    pick = lambda g: F.regexp_replace(F.concat(F.regexp_extract(path, brace, 1), F.regexp_extract(path, brace, g), F.regexp_extract(path, brace, 4)), "//+", "/")
    old = F.when(path.rlike(brace), pick(2)).when(path.rlike(plain), F.regexp_extract(path, plain, 1)).otherwise(path)
    new = F.when(path.rlike(brace), pick(3)).when(path.rlike(plain), F.regexp_extract(path, plain, 2)).otherwise(path)
    return old, new


def numstat(commits: DataFrame) -> DataFrame:
    """sha, at, added, deleted, old_path, path, binary of every changed file; binary files have no counts."""
    lines = commits.select("sha", F.posexplode(F.filter(F.split("numstat", "\n"), lambda x: x.rlike(r"^(?:\d+|-)\t(?:\d+|-)\t.+"))).alias("at", "line"))
    cut = F.split("line", "\t", 3)
    old, new = renamed(cut[2])
    return lines.select("sha", "at", F.try_to_number(cut[0], F.lit("999999999")).cast("int").alias("added"), F.try_to_number(cut[1], F.lit("999999999")).cast("int").alias("deleted"), old.alias("old_path"), new.alias("path"), (cut[0] == "-").alias("binary"))


# ---- Markdown ----

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
#: Kinds of links in the order they are taken from a text.
LINKS = [
    ("image", r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"),
    ("inline_url", r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"),
    ("wikilink", r"\[\[([^\]|#]+)[^\]]*\]\]"),
    ("autolink", r"<((?:https?|mailto):[^>\s]+)>"),
    ("tag", r"(?:^|\s)#([A-Za-z][\w/-]*)"),
]


def _targets(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, target) of a pattern's first group."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), F.trim(t).alias("target")))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, front (front matter or null), body, title, sha256 of the Markdown files below path; files of 0 bytes are not listed by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    body = F.regexp_replace(text, FRONT, "")
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    named = F.regexp_extract(F.regexp_extract(text, FRONT, 1), r"(?m)^title:\s*[\"']?(.*?)[\"']?\s*$", 1)
    h1 = F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*#*\s*$", 1)
    return files.select(
        "path", F.nullif(F.regexp_extract(text, FRONT, 1), F.lit("")).alias("front"), body.alias("body"),
        F.coalesce(F.nullif(named, F.lit("")), F.nullif(h1, F.lit("")), stem).alias("title"), F.sha2("content", 256).alias("sha256"),
    )


def markdown_chunks(files: DataFrame) -> DataFrame:
    """path, chunk, level, heading, anchor, text: the body cut before each heading."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), "body"), r"\n(?=#{1,6}\s)"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    rows = files.select("path", F.posexplode(parts).alias("chunk", "text"))
    head = F.regexp_extract("text", r"^\n*(#{1,6})\s+(.+?)\s*#*\s*(?:\n|$)", 2)
    return rows.select("path", "chunk", F.length(F.regexp_extract("text", r"^\n*(#{1,6})\s", 1)).alias("level"), F.nullif(head, F.lit("")).alias("heading"), slugify(head).alias("anchor"), F.trim("text").alias("text"))


def markdown_links(files: DataFrame) -> DataFrame:
    """path, kind, target of every link, image, wiki link, autolink and tag."""
    body = F.regexp_replace("body", r"(?s)```.*?```", "")
    found = [_targets(body, kind, pattern) for kind, pattern in LINKS]
    return files.select("path", F.inline(F.concat(*found)))


def sections(text: Column, level: int = 2) -> Column:
    """Texts between headings of a level."""
    return F.filter(F.split(F.concat(F.lit("\n"), text), rf"\n(?={'#' * level}\s)"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")


def front_fields(front: Column) -> Column:
    """Map of the 'key: value' lines of front matter, without quotes; nested and listed values are left out."""
    lines = F.filter(F.split(F.coalesce(front, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    key = lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1)
    value = lambda x: F.regexp_replace(F.regexp_extract(x, r"^[A-Za-z_][\w-]*:\s*(.*?)\s*$", 1), r"""^(["'])(.*)\1$""", "$2")
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))  # the first of repeated keys counts
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(pairs, lambda x: x["k"] == k)[0]["v"]))


# Fixed value: the name space of stable ids.
NAMESPACE = "e0e0e0e0-0000-4000-8000-000000000017"


def stable_id(*parts: Column) -> Column:
    """Name-based UUID (version 5) of the parts joined by '::'."""
    name = F.concat(F.unhex(F.lit(NAMESPACE.replace("-", ""))), F.encode(F.concat_ws("::", *parts), "UTF-8"))
    h = F.sha1(name)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def synthetic_segments(files: DataFrame, tier: int = 2) -> DataFrame:
    """path, section, segment_id, privacy_tier, text: Markdown bodies cut at headings of level 2, with ids that a repeated run gives again."""
    rows = files.select("path", F.posexplode(sections(F.col("body"))).alias("section", "text"))
    return rows.select("path", "section", stable_id(F.lit("segment"), F.col("path"), F.col("section").cast("string")).alias("segment_id"), F.lit(tier).alias("privacy_tier"), F.trim("text").alias("text"))


# ---- build artifacts ----


def artifact_kind(path: Column) -> Column:
    """junit, coverage, benchmark, lint, log or other, by name and extension."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    return (
        F.when(name.rlike(r"(?:junit|test).*\.xml$"), "junit").when(name.rlike(r"coverage.*\.json$"), "coverage").when(name.rlike(r"bench.*\.json$"), "benchmark")
        .when(name.rlike(r"(?:lint|ruff|eslint).*\.json$"), "lint").when(name.rlike(r"\.(?:log|out)$"), "log").otherwise("other")
    )


def _findings(kind: str, text: str) -> list[tuple[str, str, str | None, float | None]]:
    """(level, name, detail, value) of an artifact."""
    if kind == "junit":
        out = []
        for case in ET.fromstring(text).iter("testcase"):
            state = next((t for t in ("failure", "error", "skipped") if case.find(t) is not None), "passed")
            node = case.find(state)
            out.append((state, f"{case.get('classname') or ''}.{case.get('name') or ''}", None if node is None else node.get("message"), float(case.get("time") or 0)))
        return out
    data = json.loads(text)
    if kind == "coverage":
        files = data.get("files") or {}
        return [("coverage", k, None, float((v.get("summary") or {}).get("percent_covered") or 0)) for k, v in sorted(files.items())]
    if kind == "benchmark":
        return [("benchmark", b.get("name") or "", None, float((b.get("stats") or {}).get("mean") or 0)) for b in data.get("benchmarks") or []]
    return [("lint", x.get("code") or x.get("ruleId") or "", x.get("message"), None) for x in (data if isinstance(data, list) else data.get("results") or [])]


def build_artifacts(spark: SparkSession, path: str, head: int = 4000, tail: int = 4000) -> tuple[DataFrame, DataFrame]:
    """((path, kind, sha256, sensitive, body) of all files, (path, kind, level, name, detail, value) of what they report).

    A file that can't be parsed becomes other, with a warning. Secrets in logs are redacted; long logs keep head and tail.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = files.select("path", artifact_kind(F.col("path")).alias("kind"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, k, t in zip(b["path"], b["kind"], b["text"]):
                try:
                    rows += [(p, k, *f) for f in _findings(k, t)]
                except Exception as e:  # an artifact of any shape must not end the import
                    rows.append((p, "other", "warn", "parse failed", type(e).__name__, None))
            yield pd.DataFrame(rows, columns=["path", "kind", "level", "name", "detail", "value"])

    found = base.where(F.col("kind").isin("junit", "coverage", "benchmark", "lint")).select("path", "kind", "text").mapInPandas(run, "path string, kind string, level string, name string, detail string, value double")
    clean = redact_secrets(F.col("text"))
    short = F.when(F.length(clean) > head + tail, F.concat(F.substring(clean, 1, head), F.lit("\n[...]\n"), F.right(clean, F.lit(tail)))).otherwise(clean)
    log = F.col("kind") == "log"
    return base.select("path", "kind", "sha256", (log & has_secret(F.col("text"))).alias("sensitive"), F.when(log, short).alias("body")), found


# ---- bundles ----


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, sub_kind, external_id, row) of a bundle's JSONL files, (file, defect) against its manifest).

    manifest.json lists files with sha256, bytes and rows; (sub_kind, external_id) must be unique.
    """
    listed = spark.read.option("multiLine", "true").json(f"{path}/manifest.json").select(F.inline("files"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    have = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select(name.alias("file"), F.sha2("content", 256).alias("h"), F.col("length").alias("n"))
    lines = spark.read.text(f"{path}/*.jsonl").select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("row")).where(F.trim("row") != "")
    rows = lines.select("file", F.get_json_object("row", "$.sub_kind").alias("sub_kind"), F.get_json_object("row", "$.external_id").alias("external_id"), "row")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("r"), F.max(F.col("sub_kind").isNull() | F.col("external_id").isNull()).alias("odd"))
    j = listed.select(F.col("name").alias("file"), "sha256", "bytes", "rows").join(have, "file", "full").join(counts, "file", "left")
    defect = (
        F.when(F.col("h").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("h") != F.col("sha256"), "sha256").when(F.col("n") != F.col("bytes"), "bytes")
        .when(F.coalesce("r", F.lit(0)) != F.col("rows"), "rows").when(F.col("odd"), "row shape")
    )
    twice = rows.where("sub_kind is not null and external_id is not null").groupBy("sub_kind", "external_id").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where("n > 1")
    return rows, j.select("file", defect.alias("defect")).where("defect is not null").unionByName(twice.select("file", F.concat_ws(" ", F.lit("repeated"), "sub_kind", "external_id").alias("defect")))


# ---- dialogue sets ----


def topic_boundaries(turns: DataFrame) -> DataFrame:
    """dialog_id, turn of the turns that begin a segment (dialog_id, turn, label, topic).

    A label on a turn that is not the last makes the next one a boundary; without labels a topic that differs from the
    last one seen does. Dialogues are bounded in length.
    """
    w = Window.partitionBy("dialog_id").orderBy("turn")
    before = F.last("topic", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    labelled = F.max(F.col("label").isNotNull()).over(Window.partitionBy("dialog_id"))
    rows = turns.withColumns({"after_label": F.lag("label").over(w), "before": before, "labelled": labelled})
    return rows.where(F.when(F.col("labelled"), F.coalesce(F.col("after_label") == 1, F.lit(False))).otherwise(F.col("before").isNotNull() & ~F.col("topic").eqNullSafe(F.col("before")))).select("dialog_id", "turn")


# ---- reference linter ----

REFS = [("rfc", r"(?i)\brfc[\s_-]*0*(\d{1,5})\b"), ("decision", r"\bD(\d{2,5})\b"), ("phase", r"(?i)\bphase[\s_-]*(\d{1,2})\b")]


def cited_references(files: DataFrame) -> DataFrame:
    """kind, target, path, line: the first place (by path and line) each reference is cited. files: path, body."""
    lines = files.select("path", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    found = [_targets(F.col("text"), kind, pattern) for kind, pattern in REFS]
    rows = lines.select("path", (F.col("line") + 1).alias("line"), F.inline(F.concat(*found)))
    return rows.groupBy("kind", "target").agg(F.min(F.struct("path", "line")).alias("at")).select("kind", "target", "at.path", "at.line")


def unresolved(cited: DataFrame, known: DataFrame) -> DataFrame:
    """Cited references (kind, target) that known lacks."""
    return cited.join(known.select("kind", "target").distinct(), ["kind", "target"], "left_anti")


_SAFE = re.compile(r"[^\w.-]+")


def contract_errors(entries: DataFrame, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """entry columns and errors: missing required fields and words outside of the vocabularies."""
    missing = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing_{_SAFE.sub('_', c)}")) for c in required]
    odd = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(words), F.lit(f"unknown_{_SAFE.sub('_', c)}")) for c, words in allowed.items()]
    return entries.withColumn("errors", F.array_compact(F.array(*missing, *odd)))
