"""Secret scans: fixed patterns and sliding-window Shannon entropy of candidate strings, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern, group whose length counts, least length; in the order in which kinds are listed. Runs of one class of
#: characters are asked for at full length: no shorter run can hide a longer one.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Strings that the entropy is taken of, and the characters that they are made of.
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20
#: Characters of the blocks that a candidate is scanned in.
BLOCK = 256
#: Parts of a candidate: names and values, with the padding at its end.
PART = r"[^=]+(?:=+$)?"


@dataclass(frozen=True)
class CharClass:
    """A candidate that the pattern fits is a secret if some window of it has at least so many bits a character."""

    pattern: str
    bits: float


#: The first class that fits counts; letters alone or digits alone are words and numbers.
CLASSES = (
    CharClass(r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$|^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", 2.9),
    CharClass(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.4),
    CharClass(r"^(?=(?:[^0-9]*[0-9]){3})(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/=_-]+$", 3.7),
    CharClass(r"^(?=(?:[^0-9]*[0-9]){3})(?=.*[A-Za-z])[A-Za-z0-9+/=_-]+$", 3.7),
)
#: Candidates that are known not to be secrets: identifiers, digests of nothing, examples of manuals. Each pattern is flat, for a group that
#: repeats takes a stack frame a time in Java's matcher.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
    r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdefghij",
)
#: Words and numbers joined by marks are allowed too: no letter stands next to a digit.
JOINED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """start, end (code points) and the group's text of each match, from the left without overlap."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found"), parts.alias("part")), lambda m: m["found"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,part:string>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        begin = s["at"] + F.length(m["gap"])
        end = begin + F.length(m["found"])
        return F.struct(end.alias("at"), F.flatten(F.array(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), m["part"].alias("part"))))).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def max_window_entropy(text: Column, window: int = WINDOW) -> Column:
    """Bits a character of the window of the highest Shannon entropy; a text shorter than the window has none (null).

    Blocks that overlap by all but one character of a window are scanned one by one, so each window is in one of them and the state that a
    step carries along stays small however long the text is.
    """
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{BLOCK}}})).{{1,{BLOCK - window + 1}}}"), F.lit(1))
    return F.array_max(F.transform(blocks, lambda b: _block_entropy(b, window)))


def _block_entropy(text: Column, window: int) -> Column:
    """A step takes the entering character's count up and the leaving one's down, and changes the sum of n * log2(n) by both."""
    n_log_n = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    index = lambda c: (F.instr(F.lit(ALPHABET), c) - 1)
    chars = F.transform(F.split(text, ""), index)

    def change(counts: Column, total: Column, place: Column, by: int) -> tuple[Column, Column]:
        now = F.get(counts, place)
        new = F.transform(counts, lambda n, i: F.when(i == place, n + by).otherwise(n))
        return new, total + F.get(n_log_n, now + by) - F.get(n_log_n, now)

    def step(s: Column, i: Column) -> Column:
        counts, total = change(s["counts"], s["total"], F.get(s["chars"], i), 1)
        gone = F.get(s["chars"], i - window)
        fewer, less = change(counts, total, gone, -1)
        counts, total = F.when(i < window, counts).otherwise(fewer), F.when(i < window, total).otherwise(less)
        return F.struct(s["chars"].alias("chars"), counts.alias("counts"), total.alias("total"), F.when(i < window - 1, s["least"]).otherwise(F.least(s["least"], total)).alias("least"))

    zeros = F.array_repeat(F.lit(0), len(ALPHABET))
    start = F.struct(chars.alias("chars"), zeros.alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
    least = F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), start, step, lambda s: s["least"])
    return F.when(F.length(text) >= window, F.lit(math.log2(window)) - least / window)


def _looks_secret(text: Column) -> Column:
    limit = F.lit(None).cast("double")
    for c in reversed(CLASSES):
        limit = F.when(text.rlike(c.pattern), F.lit(c.bits)).otherwise(limit)
    allowed = text.rlike("^[A-Za-z0-9]") & ~text.rlike(JOINED)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(pattern)
    return F.when(limit.isNull() | allowed, F.lit(False)).otherwise(max_window_entropy(text) >= limit)


def _has_secret(run: Column) -> Column:
    """Class and allow-list are those of a value, not of the name before its =; only a run whose parts are all shorter than a window is judged whole."""
    parts = F.filter(F.regexp_extract_all(run, F.lit(PART), F.lit(0)), lambda p: F.length(p) >= WINDOW)
    return F.when(F.size(parts) > 0, F.exists(parts, _looks_secret)).otherwise(_looks_secret(run))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, rank of the kind, kind, end), ordered, for each row of docs; kind entropy is the method's own.

    A null or empty text has no spans; spans of different kinds may overlap, and a candidate that is within a fixed pattern's span is not
    reported again. Repeated rows have equal spans, an empty table gives no rows, columns other than doc_id and text aren't read.
    Whole texts are read; candidates of any length are judged, in time that grows with their length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind_rank:int,kind:string,end:int>>")
    span = lambda rank, kind: lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found = F.filter(_matches(F.col("text"), pattern, group), lambda m: F.length(m["part"]) >= least)  # noqa: B023
        kinds.append(F.when(F.col("text").rlike(pattern), F.transform(found, span(rank, kind))).otherwise(none).alias(kind))
    candidates = F.when(F.col("text").rlike(CANDIDATE), F.filter(_matches(F.col("text"), CANDIDATE, 0), lambda m: _has_secret(m["part"])))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", *kinds, F.coalesce(F.transform(candidates, span(len(BASE), "entropy")), none).alias("entropy"))
    base = F.flatten(F.array(*(F.col(kind) for kind, *_ in BASE)))
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), "entropy")
    more = F.filter("entropy", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    return rows.select("doc_id", "base", F.array_sort(F.flatten(F.array(F.col("base"), more))).alias("spans"))


def secret_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind, *_ in BASE), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
