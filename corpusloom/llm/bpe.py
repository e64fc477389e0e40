"""BPE encoding and decoding with forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be merged over: between such bytes a word is cut,
the fragments are encoded on their own, and their tokens are put after each other.

Rows: null is encoded like an empty text, to no tokens. Repeated rows are encoded alike, a null doc_id like others; extra
columns are ignored; an empty table gives an empty result. Texts are encoded whole; runs without white space of any length
cost n log n at most.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in each of two generations that a Python worker remembers, and the longest such word.
CACHE_WORDS = 250_000
CACHE_CHARS = 48

#: Symbols of a fragment that is merged by list, and the mark of a pair that is never merged.
SHORT = 48
NEVER = (1 << 30, -1)

#: Below this code point normal form C changes nothing and every Unicode version agrees on letters and digits.
PLAIN_END = 0x300


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_tokenizer() -> str:
    return tokenizer_path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return [chr(b) if b in own else chr(256 + b - sum(x < b for x in own)) for b in range(256)]


def _plain_pattern() -> re.Pattern:
    """The word pattern of the tokenizer for texts of plain characters."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(PLAIN_END)):
        kinds.get(unicodedata.category(c)[0], []).append(c)
    letters, digits = ("".join(map(re.escape, kinds[k])) for k in "LN")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\t-\r \x85\xa0{letters}{digits}]+")


class Words(dict):
    """word -> (ids as text, tokens as text, number of tokens), filled on demand; a full one becomes the old generation."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str):
        entry = self.old.get(word) or self.encode(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = entry
        return entry


class ForcedBoundaryBPE:
    """A byte-level BPE tokenizer with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.signs = byte_signs()
        byte = {c: b for b, c in enumerate(self.signs)}
        met = bytearray(1 << 16)
        for t in self.vocab:
            raw = [byte[c] for c in t.removesuffix(self.end) if c in byte]
            for a, b in zip(raw, raw[1:]):
                met[a << 8 | b] = 1
        self.met = bytes(met)
        self.full = Tokenizer.from_file(path)
        grows = "".join(c for c in map(chr, range(PLAIN_END)) if any(ord(x) >= PLAIN_END for x in c.lower()))
        self.plain, self.odd = _plain_pattern(), re.compile(rf"[{grows}]|[^\x00-{chr(PLAIN_END - 1)}]")
        self.words = Words(lambda word: self._entry(word.encode("utf-8")))
        self.raw_words = Words(lambda signs: self._entry(bytes(byte[c] for c in signs)))

    def fragments(self, raw: bytes) -> list[bytes]:
        """raw cut at its forced boundaries."""
        cuts = [0, *(i for i in range(1, len(raw)) if not self.met[raw[i - 1] << 8 | raw[i]]), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_fragment(self, raw: bytes, last: bool) -> list[int]:
        """Merges by rank, the leftmost first; last: the word ends here."""
        signs = [self.signs[b] for b in raw]
        if last:
            signs[-1] += self.end
        ids = [self.vocab[s] for s in signs]
        return self._merged(ids) if len(ids) <= SHORT else self._merged_long(ids)

    def _merged(self, ids: list[int]) -> list[int]:
        """Merges of a short fragment: the least rank is looked for in a list."""
        merges = self.merges
        ranks = [merges.get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """Merges of a long fragment: a heap holds the pairs by rank and place, and stale ones are passed over."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def encode_word(self, raw: bytes) -> list[int]:
        parts = self.fragments(raw)
        return [i for k, part in enumerate(parts) for i in self.encode_fragment(part, k == len(parts) - 1)]

    def _entry(self, raw: bytes) -> tuple[str, str, int]:
        ids = self.encode_word(raw)
        return " ".join(map(str, ids)), " ".join(self.token[i] for i in ids), len(ids)

    def entries(self, text: str) -> list[tuple[str, str, int]]:
        """The words' entries of a text, in order."""
        if not self.odd.search(text):
            if "<" not in text or self.specials is None or len(parts := self.specials.split(text)) == 1:
                return list(map(self.words.__getitem__, self.plain.findall(text.lower())))
        else:
            parts = self.specials.split(text) if self.specials else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append((str(self.special[part]), part, 1))
            elif self.odd.search(part):
                signs = self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(part))
                out += [self.raw_words[s] for s, _ in signs]
            else:
                out += map(self.words.__getitem__, self.plain.findall(part.lower()))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for e in self.entries(text or "") for i in e[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as a tokenizer without a decoder gives them; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ForcedBoundaryBPE:
    """One for each worker process."""
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of docs."""
    path = path or default_tokenizer()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    path = path or default_tokenizer()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text: encode and decode in one pass, without moving the ids."""
    path = path or default_tokenizer()

    def run(batches):
        bpe = tokenizer(path)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                found = bpe.entries(text or "")
                i, t, n = zip(*found) if found else ((), (), ())
                counts.append(sum(n))
                ids.append(sha(" ".join(i).encode()).hexdigest())
                texts.append(sha(" ".join(t).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs)
