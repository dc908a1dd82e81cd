"""Text functions: normalisation, tokens, references, rendering.

Everything that Spark expresses stays in the JVM; the Unicode normal form and
case folding have no built-in and run in Arrow batches.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """White space (of any script) folded to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode normal form KC."""
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    """Normal form KC, case folded."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normalize_subject(text: Column, unicode_form: bool = True) -> Column:
    """Subject of a claim: lower case, collapsed, without trailing sentence marks. A blank before the marks stays."""
    return F.regexp_replace(collapse(F.lower(nfkc(text) if unicode_form else text)), r"[.,;:!?]+$", "")


def normalize_value(text: Column, unicode_form: bool = True) -> Column:
    """Value that groups claims: lower case, collapsed."""
    return collapse(F.lower(nfkc(text) if unicode_form else text))


def normalize_key(text: Column) -> Column:
    """Entity key: case folded, collapsed."""
    return collapse(casefold(text))


def normalize_fragment(text: Column) -> Column:
    """Case folded words separated by single blanks."""
    return F.trim(F.regexp_replace(casefold(text), r"(?U)[^\w]+", " "))


# Markers of content that holds no text of its own.
MARKER = r"(?i)^\s*\[(?:image|file|attachment|audio|video|tool_use|tool_result|unsupported)[^\]]*\]\s*$"


def embeddable(text: Column) -> Column:
    """Lines without markers and trailing blanks, at most one blank line in a row, trimmed."""
    lines = F.split(text, r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]")
    kept = F.transform(F.filter(lines, lambda x: ~x.rlike(MARKER)), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    """Rough size in tokens: 0 for an empty text, else characters over 2.5, at least 1."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 2.5))).cast("int")


# Fixed value: what a token of a query is.
QUERY_TOKEN = r"[a-z0-9][a-z0-9_\-:#./]+"


def query_tokens(text: Column) -> Column:
    """Lower-case tokens of at least two characters, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({QUERY_TOKEN})"), F.lit(1))


def lexical_score(haystack: Column, tokens: list[str]) -> Column:
    """5 if the tokens appear as a phrase, the occurrences of each token (at most 5 each), a quarter per distinct token present."""
    low = F.lower(haystack)
    score = F.when(F.contains(low, F.lit(" ".join(tokens))), 5.0).otherwise(0.0) if tokens else F.lit(0.0)
    for t in tokens:
        score = score + F.least(F.lit(5), ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int"))
    for t in sorted(set(tokens)):
        score = score + F.when(F.contains(low, F.lit(t)), 0.25).otherwise(0.0)
    return F.round(score, 4)


def slugify(text: Column) -> Column:
    """Lower case, other characters as one hyphen, 'section' where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9-]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", "section").otherwise(slug)


def rfc_id(text: Column) -> Column:
    """First run of one to five digits, optionally after 'rfc', as 'rfc 0044'."""
    digits = F.regexp_extract(text, r"(?i)(?:rfc[\s_-]*)?(?<![0-9])0*([0-9]{1,5})(?![0-9])", 1)
    return F.when(digits != "", F.concat(F.lit("rfc "), F.lpad(digits, 4, "0")))


def decision_id(text: Column) -> Column:
    """First decision id, as 'D077'."""
    found = F.regexp_extract(text, r"(?i)\b(D[0-9]{2,5})\b", 1)
    return F.when(found != "", F.upper(found))


def reference_value(kind: Column, value: Column) -> Column:
    """A reference's value in the form it is looked up by: paths with slashes, hashes and others in lower case, ids in their own form."""
    v = F.trim(value)
    return (
        F.when(kind.isin("path", "logical_path"), F.lower(F.replace(v, F.lit("\\"), F.lit("/"))))
        .when(kind == "rfc_id", F.coalesce(rfc_id(v), F.lower(v)))
        .when(kind == "decision_id", F.coalesce(decision_id(v), F.upper(v)))
        .otherwise(F.lower(v))
    )


def excerpt(text: Column, limit: int) -> Column:
    """At most limit characters without white space at the end, then an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def age(ts: Column, now: Column) -> Column:
    """just now, Nh ago or Nd ago."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600)
    return F.when(hours < 1, "just now").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def words(text: Column) -> Column:
    """Number of words, at least 1."""
    return F.greatest(F.lit(1), F.size(F.split(collapse(F.coalesce(text, F.lit(""))), " ")))


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts separated by NUL; a null part counts as empty."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def opaque_id(fields: Column) -> Column:
    """URL-safe base64 of a struct as JSON, without padding. The struct's fields should be in name order."""
    return F.rtrim(F.translate(F.base64(F.to_json(fields).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def opened_id(value: Column, schema: str) -> Column:
    """The struct of an opaque id, null where it is none."""
    padded = F.rpad(F.translate(value, "-_", "+/"), (F.ceil(F.length(value) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema)


@pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and without blanks; null where the text is no JSON."""

    def one(t):
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


# Keys under which audits may not hold content.
CONTENT_KEYS = ["content", "content_text", "body", "text", "excerpt", "snippet", "raw", "payload"]


def has_content_key(text: Column, keys: list[str] | None = None) -> Column:
    """Whether a JSON text has one of the keys at any depth."""
    return F.coalesce(text.rlike(rf'(?i)"(?:{"|".join(keys or CONTENT_KEYS)})"\s*:'), F.lit(False))


_BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    """Text of HTML: block tags end lines, white space in a line is collapsed, blank lines are dropped."""

    def one(page):
        if page is None:
            return None
        p = _Text()
        p.feed(page)
        p.close()
        lines = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in "".join(p.parts).split("\n"))
        return "\n".join(x for x in lines if x)

    return pages.map(one)


# What is taken for a secret in a log.
SECRETS = [
    r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd)\b\s*[:=]\s*\S+",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]+",
    r"\bglpat-[A-Za-z0-9-]+",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{12,}=*",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
]


def redact_secrets(text: Column) -> Column:
    """Secrets replaced by [REDACTED]."""
    for s in SECRETS:
        text = F.regexp_replace(text, s, "[REDACTED]")
    return text


def has_secret(text: Column) -> Column:
    """Whether the text holds a secret."""
    return F.coalesce(text.rlike("|".join(f"(?:{s})" for s in SECRETS)), F.lit(False))


def confidence_band(c: Column) -> Column:
    """Half-open quarters of [0, 1], 1 included in the last; null outside."""
    return F.when(c < 0, None).when(c < 0.25, "low").when(c < 0.5, "medium_low").when(c < 0.75, "medium_high").when(c <= 1, "high")


def recency_band(ts: Column, now: Column) -> Column:
    """Age in days: up to 7, 30, 90, 365, older."""
    days = F.datediff(now, ts)
    return F.when(ts.isNull(), "unknown").when(days < 7, "week").when(days < 30, "month").when(days < 90, "quarter").when(days < 365, "year").otherwise("older")


def safe_rate(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.when(d == 0, 0.0).otherwise(n / d)
