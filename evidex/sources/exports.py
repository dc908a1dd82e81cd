"""Readers of conversation exports: ChatGPT, Claude and Gemini, as message rows.

Files are read whole by Spark and parsed in Arrow batches, one conversation per
output group, so a folder of exports is read in parallel.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "source_kind string, conversation_id string, title string, external_id string, sequence_index int, role string, content_text string, created_at string"
_COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")]


def content_text(content) -> str | None:
    """Text of a ChatGPT content object: string parts by line, markers for typed parts, JSON for other objects; None if empty.

    Without parts only the context a model is set up with has a text.
    """
    if not isinstance(content, dict):
        return None
    parts = content.get("parts")
    if not isinstance(parts, list):
        if content.get("content_type") != "model_editable_context":
            return None
        parts = [str(v) for k in ("model_set_context", "repo_summary", "structured_context") if (v := content.get(k))]
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif isinstance(p, dict):
            kind = p.get("content_type")
            if kind == "image_asset_pointer":
                out.append(f"[{kind}: {p.get('asset_pointer') or p.get('file_id') or 'unknown'}]")
            else:
                out.append(f"[{kind}]" if kind else json.dumps(p, sort_keys=True, separators=(",", ":")))
    return "\n".join(out).strip() or None


def tree_order(mapping: dict) -> list[str]:
    """Node ids depth first from the nodes without a known parent, children in their given order, then the nodes not reached."""
    seen, out = set(), []
    roots = [k for k, n in mapping.items() if (n or {}).get("parent") not in mapping]
    for root in [*roots, *mapping]:
        stack = [root]
        while stack:
            k = stack.pop()
            if k in seen or k not in mapping:
                continue
            seen.add(k)
            out.append(k)
            stack += reversed((mapping[k] or {}).get("children") or [])
    return out


def chatgpt_rows(conversation: dict) -> Iterator[tuple]:
    """Messages of a conversation's tree; only nodes with a message are numbered."""
    mapping = conversation.get("mapping") or {}
    cid = conversation.get("conversation_id") or conversation.get("id")
    nodes = [(k, mapping[k]["message"]) for k in tree_order(mapping) if (mapping[k] or {}).get("message")]
    for n, (k, m) in enumerate(nodes):
        made = m.get("create_time")
        yield "chatgpt", cid, conversation.get("title"), m.get("id") or k, n, (m.get("author") or {}).get("role"), content_text(m.get("content")), None if made is None else str(made)


def claude_part(part) -> str | None:
    """Text of a Claude content part: text, or a marker for tools with the text of nested results."""
    if not isinstance(part, dict):
        return None
    kind = part.get("type")
    if kind == "text":
        return part.get("text")
    if kind == "tool_use":
        return f"[tool_use:{part.get('name') or ''}]"
    if kind == "tool_result":
        inner = part.get("content")
        inner = [inner] if isinstance(inner, (str, dict)) else inner or []
        texts = [x if isinstance(x, str) else claude_part(x) for x in inner]
        return "\n".join([f"[tool_result:{part.get('name') or ''}]", *(t for t in texts if t)])
    return f"[{kind}]" if kind else None


def claude_rows(conversation: dict) -> Iterator[tuple]:
    """Messages by position; the positions of entries that are no objects stay free."""
    for n, m in enumerate(conversation.get("chat_messages") or []):
        if not isinstance(m, dict):
            continue
        parts = [t for t in map(claude_part, m.get("content") or []) if t]
        text = "\n".join(parts).strip() or (m.get("text") or "").strip() or None
        yield "claude", conversation.get("uuid"), conversation.get("name"), m.get("uuid"), n, m.get("sender"), text, m.get("created_at")


def gemini_rows(activity: dict) -> Iterator[tuple]:
    """A prompt and a reply of an activity, either may be missing."""
    from evidex.functions.text import html_to_text

    title, when = activity.get("title") or "", activity.get("time")
    cid = activity.get("titleUrl") or f"{when}|{title}"
    n = 0
    if title.startswith("Prompted "):
        yield "gemini", cid, title, f"{cid}:user", n, "user", title[len("Prompted ") :].strip() or None, when
        n += 1
    page = "".join((x or {}).get("html") or "" for x in activity.get("safeHtmlItem") or [])
    if page:
        yield "gemini", cid, title, f"{cid}:assistant", n, "assistant", html_to_text.func(pd.Series([page]))[0] or None, when


_ROWS = {"chatgpt": chatgpt_rows, "claude": claude_rows, "gemini": gemini_rows}


def _documents(path: str, content: bytes) -> Iterator[bytes]:
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                base = name.rsplit("/", 1)[-1].lower()
                if base.endswith(".json") and ("conversation" in base or "activity" in base):
                    yield z.read(name)
    elif path.lower().endswith((".jsonl", ".txt")):
        yield from (line for line in content.splitlines() if line.strip())  # a document per line
    else:
        yield content


def read_export(spark: SparkSession, path: str, kind: str, glob: str = "*.{json,zip}") -> DataFrame:
    """Messages of all export files below path; a file that is no JSON gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = []
                for raw in _documents(name, bytes(content)):
                    try:
                        data = json.loads(raw)
                    except ValueError:
                        continue
                    for c in data if isinstance(data, list) else [data]:
                        if isinstance(c, dict):
                            rows += _ROWS[kind](c)
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.mapInPandas(run, MESSAGE)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_digest(files: DataFrame, root: str) -> DataFrame:
    """file_count, content_hash of a manifest() (the files of one export): SHA-256 over path, NUL, hash, NUL of each file in the order of paths below root."""
    cut = F.substring("path", F.instr("path", root) + len(root.rstrip("/")) + 1, F.length("path"))
    listed = F.array_sort(F.collect_list(F.struct(cut.alias("p"), "sha256")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["p"], F.lit("\0"), x["sha256"], F.lit("\0"))), "")
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.sha2(text, 256).alias("content_hash"))
