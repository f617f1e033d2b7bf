"""Language identification (4) with error-correcting output codes over hashed byte n-grams.

Each language has a codeword, a row of a Hadamard matrix, so that any two differ in half of their bits.  For each bit there
is a binary classifier: the log ratio of n-gram probabilities of the languages whose bit is one and those whose bit is
zero, averaged over the n-grams of a text.  The n-gram counts come from all texts to learn from, in one aggregation.  A
text gets the language whose codeword has the smallest loss: the logistic loss of each bit's margin, weighted by how well
that bit's classifier separates its two sides.  A text is ambiguous where the runner-up's loss is near, or where the signs
of the margins lie further from the codeword than the code can correct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: A model holds this many n-gram counts for each language; more languages than this are refused.
MAX_LANGUAGES = 1024
#: Sharpness of the logistic loss: margins are mean log ratios a gram, of the order of 0.1 to 1.
SHARPNESS = 8.0
#: Least difference between the two smallest losses, as a share of the sum of weights, for a clear answer.
CLEAR_GAP = 0.05
UNKNOWN = "und"
_BLOCK = 1 << 20
_TO_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed three-byte grams of a lower-cased text, ASCII characters other than letters as spaces."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_TO_LETTERS) + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw) - 2, _BLOCK):
        part = raw[at:at + _BLOCK + 2].astype(np.uint32)
        code = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA6B) + part[2:] * np.uint32(0xC2B2AE35)
        counts += np.bincount(code >> np.uint32(32 - 14), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(ch.isalpha() for ch in text)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1 with every column mixed, from rows of the Sylvester-Hadamard matrix."""
    size = 8
    while size <= n:
        size *= 2
    rows, columns = np.arange(1, n + 1), np.arange(1, size)
    code = 1 - 2 * (np.bitwise_count(rows[:, None] & columns).astype(np.int64) & 1)
    return code[:, np.abs(code.sum(axis=0)) < n]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    ratios: np.ndarray  # bits x buckets
    weights: np.ndarray  # bits

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
        code = codewords(len(languages)) if languages else np.zeros((0, 0), np.int64)
        smooth = np.array([(c + 0.5) / (c.sum() + 0.5 * BUCKETS) for c in (counts[x] for x in languages)])
        ratios, weights = [], []
        for bit in code.T:
            one, zero = smooth[bit > 0].mean(axis=0), smooth[bit < 0].mean(axis=0)
            log = np.log(one / zero)
            ratios.append(log)
            weights.append(float(((one - zero) * log).sum()))  # symmetric divergence of the two sides
        weights = np.array(weights)
        return cls(languages, code, np.array(ratios, np.float32).reshape(-1, BUCKETS), weights / (weights.sum() or 1.0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, and whether it is ambiguous."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = gram_counts(text)
        counts[_BLANK] = 0
        margins = self.ratios @ counts / max(1, counts.sum())
        losses = np.log1p(np.exp(np.clip(-SHARPNESS * self.code * margins, -60, 60))) @ self.weights
        order = np.argsort(losses, kind="stable")
        best = order[0]
        shares = np.exp(SHARPNESS * (losses[best] - losses))
        gap = losses[order[1]] - losses[best] if len(order) > 1 else np.inf
        wrong = int((np.sign(margins) != self.code[best]).sum())
        least = min((int((self.code[best] != self.code[k]).sum()) for k in order[1:]), default=1)
        return self.languages[best], float(1.0 / shares.sum()), bool(gap < CLEAR_GAP or 2 * wrong >= least)


#: The gram of three spaces says nothing about a language.
_BLANK = int(np.nonzero(gram_counts(" "))[0][0])


def held_out(id_col: str) -> Column:
    """Documents whose crc32 of the id as text is divisible by five; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from every row with a text and a language.  What reaches the driver is a row for each language and bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                own = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                own += gram_counts(text.as_py())
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
        for lang, own in sums.items():
            at = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    summed = known.mapInArrow(each, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():
        counts.setdefault(row.lang, np.zeros(BUCKETS, np.int64))[row.bucket] = row.n
    for own in counts.values():
        own[_BLANK] = 0
    return Model.of_counts(counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there was nothing to learn from.
    Equal losses fall to the language that sorts first.  Whole texts are read, very long ones in blocks; repeated rows give
    a row each; null ids stay null and are not held out; other columns play no part; an empty table gives no rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            lang, score, doubt = (pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lang, score, doubt], names)

    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    names = ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(each, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that are not held out and identifies all of them."""
    return identify(docs, train(docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)), text_col, lang_col), id_col, text_col)
