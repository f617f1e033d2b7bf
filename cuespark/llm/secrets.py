"""Secret scan (8): fixed patterns, and sliding-window Shannon entropy per character class with allow-list suppression.

Every text is read whole.  Candidates for the entropy test are maximal runs of the characters that keys and tokens are
made of.  A run belongs to the first of the classes below that holds all its characters.  A window of ``WINDOW``
characters slides over it; counts are updated by the character that enters and the one that leaves, and so is the sum of
``c log c`` from which the entropy follows.  The run is a secret where the largest window entropy reaches the threshold of
its class, unless an allow rule explains it.  Spans of the fixed patterns are never suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the contract and the least lengths of what counts (of group 2 for assign).
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

WINDOW = 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+")
#: Character classes from narrow to wide with the window entropy (bits a character) from which a run counts.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), None),
    ("letters of one case", re.compile(r"[a-z]+|[A-Z]+|[A-Z][a-z]+"), None),
    ("hexadecimal", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 3.0),
    ("letters", re.compile(r"[A-Za-z]+"), 4.1),
    ("upper case and digits", re.compile(r"[A-Z0-9]+"), 3.5),
    ("lower case and digits", re.compile(r"[a-z0-9]+"), 3.5),
    ("letters and digits", re.compile(r"[A-Za-z0-9]+"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/=_-]+"), 3.8),
)
#: Runs that an allow rule explains: identifiers, words joined by hyphens, underscores or slashes, placeholders, counted series.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[+=/_-]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)(?:[+=/_-]++|$))*+"),
    re.compile(r"[^!]*(?i:example|placeholder|changeme|your[_-]|dummy|xxxx|0123456789|abcdefghij)[^!]*"),
)


def window_entropy(run: str, width: int = WINDOW) -> float:
    """Largest Shannon entropy of a window of ``width`` characters, from counts kept up to date as it slides."""
    log = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, best = 0.0, 0.0
    for i, ch in enumerate(run):
        if i >= width:
            old = run[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += log[c - 1] - log[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += log[c + 1] - log[c]
        if i >= width - 1:
            best = max(best, math.log2(width) - total / width)
    return best


def is_random(run: str) -> bool:
    """Whether a candidate run reaches the entropy of its class and no allow rule explains it."""
    least = next(bits for _, chars, bits in CLASSES if chars.fullmatch(run))
    return least is not None and not any(rule.fullmatch(run) for rule in ALLOW) and window_entropy(run) >= least


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Random runs that no span of the fixed patterns touches."""
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][2] <= start:
            at += 1
        if (at == len(base) or base[at][0] >= end) and is_random(m[0]):
            out.append((start, 3, end))
    return out


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the fixed patterns and the spans that entropy adds."""
    text = text or ""
    base = base_spans(text)
    return base, entropy_spans(text, base)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans of every row of ``docs``.

    A null text counts as empty and has no span; its base_sha256 is that of the empty string.  Offsets are code points.
    Repeated rows and equal ids give a row each, null ids stay null.  Other columns play no part, whatever their names;
    an empty table gives no rows.  Very long texts are scanned as they are, in time linear in their length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
        for batch in batches:
            counts, shas, texts = [[], [], [], []], [], []
            for text in batch.column(1):
                base, added = spans_of(text.as_py())
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in base) if kind < 3 else len(added))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(base + added))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(each, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string")
