"""BPE encoding and decoding (5) by speculation and verification.

Each distinct word is first cut greedily into the longest vocabulary entries.  Such a cut is the BPE encoding exactly when
every adjacent pair of tokens could stand side by side at the end of merging, that is, when at no moment a merge across
their border was the next one to be applied.  That can be read from the two tokens alone: the right edge of the left token
is, at each moment, one node of a chain in its merge tree, the left edge of the right token one of another chain, and a
merge of rank r of two such nodes comes first if both are still whole at r.  Between equal merges the one further left
comes first.  All new pairs of a batch are tested at once with array operations; tested pairs and finished words are
remembered.  Only words with a failing pair, or with a token that merging cannot produce, are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
#: Words and pairs that a task remembers before it starts afresh: bounds of memory, without effect on results.
WORDS_HELD, PAIRS_HELD = 400_000, 1_000_000
#: New words are looked for in groups of texts of about so many characters (one text at least).
GROUP_CHARS = 4_000_000
NEVER = np.int64(1) << 40
# White space that separates words, and the pattern of a word, both as the vocabulary's file has them.
SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a word-level BPE file, with the chains that pair checks need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts: list[str] = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for text, no in (*self.ids.items(), *self.special.items()):
            self.texts[no] = text
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.longest = max(map(len, self.ids))
        self.letters = byte_letters()
        self._chains()

    # ------------------------------------------------------------ exact merging
    def merge_word(self, symbols: list[str]) -> list[int]:
        """The encoding of one word by merging: lowest rank first, the leftmost among equals."""
        ids = [self.ids[s] for s in symbols]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heap = [(rank, i, new, ids[i], ids[i + 1]) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (m := self.merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, m[1], ids[left], ids[right]))
        return [t for t in ids if t >= 0]

    # ------------------------------------------------------------ pair checks
    def _chains(self) -> None:
        """For each token the nodes of its right and left edge, each with the rank at which it is merged into the next."""
        whole = {}  # token -> (rank, left, right) of the merge that makes it
        for (a, b), (rank, new) in self.merges.items():
            if new not in whole or rank < whole[new][0]:
                whole[new] = (rank, a, b)
        n = len(self.texts)
        right, left = [[] for _ in range(n)], [[] for _ in range(n)]
        for token in range(n):
            for chain, side in ((right, 2), (left, 1)):
                node, until = token, int(NEVER)
                while True:
                    chain[token].append((node, until))
                    if node not in whole:
                        break
                    until, node = whole[node][0], whole[node][side]
        self.right, self.left = self._padded(right), self._padded(left)
        codes = np.array([a * n + b for a, b in self.merges], np.int64)
        ranks = np.array([m[0] for m in self.merges.values()], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks, self.size = codes[order], ranks[order], n
        self.reached = np.zeros(n, bool)  # tokens that merging their own letters gives back
        for text, no in self.ids.items():
            symbols = list(text)
            if self.end and text.endswith(self.end) and text != self.end:
                symbols = list(text.removesuffix(self.end))
                symbols[-1] += self.end
            if all(s in self.ids for s in symbols):
                self.reached[no] = self.merge_word(symbols) == [no]

    @staticmethod
    def _padded(chains: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        width = max(map(len, chains))
        nodes, until = np.full((len(chains), width), -1, np.int64), np.zeros((len(chains), width), np.int64)
        for i, chain in enumerate(chains):
            nodes[i, :len(chain)], until[i, :len(chain)] = zip(*chain, strict=True)
        return nodes, until

    def stand_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For many pairs of tokens at once: whether merging could end with them side by side."""
        good = np.ones(len(a), bool)
        for i in range(self.right[0].shape[1]):
            x = self.right[0][a, i]
            for j in range(self.left[0].shape[1]):
                y = self.left[0][b, j]
                at = np.nonzero(good & (x >= 0) & (y >= 0))[0]
                if not len(at):
                    continue
                code = x[at] * self.size + y[at]
                place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[place] == code
                rank = self.ranks[place]
                # the border's merge comes first if the left node goes later, or the right node not before it
                good[at[hit & (rank < self.right[1][a[at], i]) & (rank <= self.left[1][b[at], j])]] = False
        return good


class Encoder:
    """Encodes words in batches; keeps what it has found out about words and pairs, within bounds."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.word = regex.compile(WORD)
        self.words: dict[str, tuple[str, str, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True)))) if self.v.special else None
        self.merged = 0

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token stands for itself with a leading NUL, which no other word starts with."""
        if self.special is None or not any(s in text for s in self.v.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.plain(text[at:m.start()]), "\0" + m[0]]
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return ["\0\0" + w if w[0] == "\0" else w for w in self.word.findall(text.lower())]

    def speculate(self, symbols: list[str]) -> list[int]:
        """Greedy longest match over the letters of a word."""
        ids, body = self.v.ids, "".join(symbols).removesuffix(self.v.end)
        out, i, n = [], 0, len(body)
        while i < n:
            for j in range(min(n, i + self.v.longest), i, -1):
                no = ids.get(body[i:j] + self.v.end if j == n else body[i:j])
                if no is not None:
                    out.append(no)
                    i = j
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not remembered yet."""
        guesses, symbols = {}, {}
        for w in words:
            if w[0] == "\0" and w[1:2] != "\0":
                no = self.v.special[w[1:]]
                self.words[w] = (str(no), self.v.texts[no], 1)
                continue
            s = [self.v.letters[b] for b in (w[2:] if w[0] == "\0" else w).encode()]
            s[-1] += self.v.end
            symbols[w], guesses[w] = s, self.speculate(s)
        names = list(guesses)
        sizes = np.fromiter((len(guesses[w]) for w in names), np.int64, len(names))
        flat = np.fromiter((t for w in names for t in guesses[w]), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(names)), sizes)
        bad = np.zeros(len(names), bool)
        bad[owner[~self.v.reached[flat]]] = True
        inside = owner[1:] == owner[:-1]
        code = (flat[:-1] * self.v.size + flat[1:])[inside]
        kinds, place = np.unique(code, return_inverse=True)
        fresh = np.array([c for c in kinds.tolist() if c not in self.pairs], np.int64)
        if len(fresh):
            self.pairs.update(zip(fresh.tolist(), self.v.stand_together(fresh // self.v.size, fresh % self.v.size).tolist(), strict=True))
        good = np.fromiter((self.pairs[c] for c in kinds.tolist()), bool, len(kinds))
        bad[owner[1:][inside][~good[place]]] = True
        for w, wrong in zip(names, bad.tolist(), strict=True):
            ids = guesses[w]
            if wrong:
                ids = self.v.merge_word(symbols[w])
                self.merged += 1
            self.words[w] = (" ".join(map(str, ids)), " ".join(self.v.texts[t] for t in ids), len(ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """For each text its ids in decimal and its decoded form, both joined by single spaces, and the number of tokens."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_CHARS):
                size += len(texts[end])
                end += 1
            yield from self._encode_group(texts[at:end])
            at = end

    def _encode_group(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        if len(self.words) > WORDS_HELD:
            self.words.clear()
        if len(self.pairs) > PAIRS_HELD:
            self.pairs.clear()
        split = [self.split(text) for text in texts]
        fresh = set().union(*split).difference(self.words)
        if fresh:
            self.learn(fresh)
        for words in split:
            found = [self.words[w] for w in words]
            yield " ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum([f[2] for f in found])


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder for each worker process, which serves many tasks."""
    return Encoder(path)


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """Text of a list of ids: their tokens, special ones too, joined by single spaces."""
    return " ".join(vocabulary.texts[i] for i in ids)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless ``ids`` is false, the ids of every row of ``docs``.

    A null text counts as empty: no token, and the digests of the empty string.  Repeated rows give a row each, null ids
    stay null, other columns play no part, an empty table gives no rows.  A very long text is encoded as a whole.  ``path``
    is the vocabulary's file as every executor sees it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            lists, counts, shas, backs = [], [], [], []
            for line, text, n in encoder.encode([t.as_py() or "" for t in batch.column(1)]):
                counts.append(n)
                shas.append(hashlib.sha256(line.encode()).hexdigest())
                backs.append(hashlib.sha256(text.encode()).hexdigest())
                if ids:
                    lists.append(np.fromstring(line, np.int32, sep=" ") if line else np.empty(0, np.int32))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(lists, pa.list_(pa.int32()))] * ids, names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    fields = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(each, fields + ", ids array<int>" * ids)
