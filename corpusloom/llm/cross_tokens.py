"""Cross-tokenizer alignment: which tokens of one tokenizer share bytes with which of another, by products of incidence matrices.

Rows: null and empty texts have no tokens: zeros, and no groups. Nor have texts whose bytes either tokenizer does not give
back (a U+2581, which the pieces read as a space). Repeated rows are aligned alike and all count; a null doc_id is like any
other. Texts are aligned whole, whatever their length. Extra columns are ignored; an empty table gives an empty result.

Texts are laid one after another on one axis of bytes. A and B are the matrices (token, byte) of the two tokenizers, in CSR
form; row i of A . Bt, summed row by row as Gustavson does, holds the B tokens that overlap token i, and how many bytes they
share. Bytes where tokens of both end cut the tokens into groups; with matrices (token, group), the same product gives the tokens that share a group.

Words come again and again, so the products are made of the distinct pieces that a worker meets, many at once, and texts are put together from them.
Counts of id pairs are summed in the tasks before the shuffle. They are as many as the pairs of the two vocabularies at most,
and go to the tasks in blocks of ids of B, each of at most LIMIT pairs (and those of one id); each block is one pass over the texts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from array import array
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import PLAIN_END, byte_signs, tokenizer_path
from corpusloom.sources.scratch import written

#: Characters of texts that are aligned at once, cells of a product that are summed at once, and pairs of ids in a block.
CHUNK, CELLS, LIMIT = 1 << 19, 1 << 22, 2_000_000
#: Pieces of texts that a worker remembers, and characters in them, about.
HELD_RUNS, HELD_CHARS = 500_000, 20_000_000
#: A longer run is left to the slower of two libraries, which has no limit.
LONG_RUN = 1000
MARK = "▁"
#: Odd multipliers of the hash of a run, by place.
PLACES = np.random.default_rng(13).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class CSR:
    """A sparse matrix of whole numbers: row i has data[indptr[i]:indptr[i + 1]] in the columns indices[indptr[i]:indptr[i + 1]]."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, columns: int):
        self.indptr, self.indices, self.data, self.columns = indptr, indices, data, columns

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def spans(cls, ends: np.ndarray, cuts: np.ndarray, weights: np.ndarray | None = None) -> CSR:
        """(token, byte) of tokens that end at ends, one after another.

        Bytes between two of the cuts lie in the same tokens, so their columns are alike; one column with the weight of all stands for them.
        """
        indptr = np.r_[0, np.searchsorted(cuts, ends, side="right")]
        return cls(indptr, np.arange(len(cuts)), np.ones(len(cuts), np.int64) if weights is None else weights, len(cuts))

    @classmethod
    def members(cls, groups: np.ndarray, n_groups: int) -> CSR:
        """(token, group): each token is in one."""
        return cls(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), n_groups)

    def row_of(self) -> np.ndarray:
        """The row of each cell."""
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    def transpose(self) -> CSR:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.r_[0, np.cumsum(np.bincount(self.indices, minlength=self.columns))]
        return CSR(indptr, self.row_of()[order], self.data[order], self.rows)

    def blocks(self, other: CSR):
        """Bounds of rows whose products with other have CELLS cells together, before cells of one place are summed; or one row."""
        cost = np.r_[0, np.cumsum(np.diff(other.indptr)[self.indices])][self.indptr]
        at = 0
        while at < self.rows:
            end = max(at + 1, int(np.searchsorted(cost, cost[at] + CELLS, side="right")) - 1)
            yield at, end
            at = end

    def product(self, other: CSR, at: int = 0, end: int | None = None) -> CSR:
        """Rows at to end of self . other: row i is the sum of the rows k of other, times self[i, k]."""
        end = self.rows if end is None else end
        cells = slice(self.indptr[at], self.indptr[end])
        k = self.indices[cells]
        n = other.indptr[k + 1] - other.indptr[k]
        of = np.repeat(np.arange(len(k)), n)
        place = np.arange(len(of)) + np.repeat(other.indptr[k] - (np.cumsum(n) - n), n)
        row = np.repeat(np.arange(end - at), np.diff(self.indptr[at : end + 1]))[of]
        key, value = row * other.columns + other.indices[place], self.data[cells][of] * other.data[place]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        data = np.add.reduceat(value, first) if len(key) else value
        row, column = np.divmod(key[first], max(1, other.columns))
        return CSR(np.r_[0, np.cumsum(np.bincount(row, minlength=end - at))], column, data, other.columns)

    def times(self, vector: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(self.data * vector[self.indices])]
        return total[self.indptr[1:]] - total[self.indptr[:-1]]


class ByteLevel:
    """The byte-level tokenizer of a tokenizers file.

    ranks: a faster library's reading of the same vocabulary, if its file lies beside. It takes texts of characters on which all
    versions of Unicode agree, without long runs of white space; the slower library, which has no limits, takes the others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_signs())}
        self.bytes = [b""] * self.full.get_vocab_size(with_added_tokens=True)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.ranks = self._ranks(path)
        self.odd = re.compile(rf"[^\x00-{chr(PLAIN_END - 1)}]|\s{{{LONG_RUN}}}")

    @staticmethod
    def _ranks(path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        try:
            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        except FileNotFoundError:
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        slow = self.ranks is None or self.odd.search(text)
        return self.full.encode(text, add_special_tokens=False).ids if slow else self.ranks.encode_ordinary(text)


class Pieces:
    """A sentencepiece model with byte fallback, which puts a space before a text. apart: no piece has a space behind another sign, or a line feed."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = self.model.id_to_piece(list(range(self.model.get_piece_size())))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.space = self.model.piece_to_id(MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Both:
    """Two tokenizers that cut the same texts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << 16:
            raise ValueError("ids of more than two bytes")
        self.lengths = tuple(np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))

    def spell(self, raw: str, a: list[int], b: list[int]) -> bool:
        return all(b"".join(map(t.bytes.__getitem__, ids)) == raw.encode("utf-8", "surrogatepass") for t, ids in ((self.a, a), (self.b, b)))

    def whole(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of a text; none where it is empty, or not what the tokens spell."""
        if text:
            a, b = self.a.encode(f" {text}"), self.b.encode([text])[0]
            if self.spell(f" {text}", a, b):
                return a, b
        return [], []

    def runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of both for runs that begin with a space or a line feed and hold no other white space, nor any character on which
        versions of Unicode differ; and how many each run has of A and of B."""
        # A cuts before a run unless the one before it is nothing but white space.
        apart = [r if len(r) > LONG_RUN or not r.strip(" \n") else None for r in runs]
        a_ids = np.array(self.a.encode("".join(r for r, x in zip(runs, apart) if x is None)), dtype=np.int64)
        sizes = np.array([len(r.encode()) for r, x in zip(runs, apart) if x is None], dtype=np.int64)
        a_n = np.zeros(len(runs), np.int64)
        joined = np.array([x is None for x in apart])
        a_n[joined] = np.diff(np.searchsorted(np.cumsum(self.lengths[0][a_ids]), np.cumsum(sizes), side="right"), prepend=0)
        if not joined.all():
            parts, own = np.split(a_ids, np.cumsum(a_n[joined])[:-1]) if joined.any() else [], {k: self.a.encode(x) for k, x in enumerate(apart) if x is not None}
            each = iter(parts)
            a_ids = np.concatenate([np.array(own[k], dtype=np.int64) if k in own else next(each) for k in range(len(runs))])
            a_n[~joined] = list(map(len, own.values()))
        # B puts a space before a text. It takes the place of a run's first space; before a line feed it is one token too many.
        found = self.b.encode([r[1:] if r[0] == " " else r for r in runs])
        found = [ids[1:] if r[0] == "\n" else ids or [self.b.space] for r, ids in zip(runs, found)]
        b_ids, b_n = np.array(array("H", chain.from_iterable(found)), dtype=np.int64), np.array(list(map(len, found)))
        raw = "".join(runs).encode()
        if not all(b"".join(map(t.bytes.__getitem__, ids.tolist())) == raw for t, ids in ((self.a, a_ids), (self.b, b_ids))):
            raise ValueError("tokens do not spell plain runs")
        return a_ids, b_ids, a_n, b_n


@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers of two bytes, from the left, with room for a sign; and how many each has."""
    spelt = [str(i) for i in range(1 << 16)]
    return np.frombuffer("".join(f"{x:6}" for x in spelt).encode(), np.uint8).reshape(-1, 6), np.array([len(x) for x in spelt])


class Alignment:
    """The tokens of several texts, one after another; a_first, b_first and group_first: where those of each text begin, and the end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
        """Ids of both, and how many each text has of A and of B."""
        self.a, self.b = a, b
        self.a_first, self.b_first = (np.r_[0, np.cumsum(n)].astype(np.int64) for n in (a_n, b_n))
        self.a_end, self.b_end = np.cumsum(a_len[self.a]), np.cumsum(b_len[self.b])
        ends = np.sort(np.concatenate([self.a_end, self.b_end]), kind="stable")
        again = np.r_[False, ends[1:] == ends[:-1]][: len(ends)]
        self.cuts, common = ends[~again], ends[again]
        self.a_group, self.b_group = np.searchsorted(common, self.a_end), np.searchsorted(common, self.b_end)
        self.n_groups = len(common)
        self.group_first = np.r_[self.a_group, self.n_groups][self.a_first]

    @classmethod
    def of(cls, both: Both, texts: list[str | None]) -> Alignment:
        ids = [both.whole(t) for t in texts]
        flat = [np.array(array("H", chain.from_iterable(x[k] for x in ids)), dtype=np.int64) for k in range(2)]
        return cls(*flat, *(np.array([len(x[k]) for x in ids], dtype=np.int64) for k in range(2)), *both.lengths)

    def overlaps(self):
        """(first row, links) by blocks of rows: the product (A token, B token), whose cells are the bytes that they share."""
        a, b = CSR.spans(self.a_end, self.cuts, np.diff(self.cuts, prepend=0)), CSR.spans(self.b_end, self.cuts).transpose()
        for at, end in a.blocks(b):
            yield at, a.product(b, at, end)

    def shared(self):
        """(first row, links) by blocks of rows: the product (A token, B token) over groups, a cell of 1 for each pair in one group."""
        a, b = CSR.members(self.a_group, self.n_groups), CSR.members(self.b_group, self.n_groups).transpose()
        for at, end in a.blocks(b):
            yield at, a.product(b, at, end)

    def n_shared(self) -> np.ndarray:
        """How many cells each row of shared() has."""
        others = CSR.members(self.b_group, self.n_groups).transpose().times(np.ones(len(self.b), np.int64))
        return CSR.members(self.a_group, self.n_groups).times(others)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) of every cell of overlaps()."""
        parts = [(at + p.row_of(), p.indices) for at, p in self.overlaps()]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def of_texts(self, per_a: np.ndarray) -> np.ndarray:
        """The sums over each text of a number for each A token."""
        return np.diff(np.r_[0, np.cumsum(per_a)][self.a_first])

    def spelt(self) -> list[bytes]:
        """Each text's groups: ids of A, a bar, ids of B; groups are parted by semicolons."""
        a_to, b_to = (np.searchsorted(g, np.arange(self.n_groups + 1)) for g in (self.a_group, self.b_group))
        value, sign = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        at = np.arange(len(self.a)) + b_to[self.a_group]
        value[at] = self.a
        sign[at[np.r_[self.a_group[1:], -1][: len(at)] != self.a_group]] = ord("|")
        at = np.arange(len(self.b)) + a_to[self.b_group + 1]
        value[at] = self.b
        sign[at[np.r_[self.b_group[1:], -1][: len(at)] != self.b_group]] = ord(";")
        digits, width = _digits()
        wide = width[value]
        signs = digits[value]
        signs[np.arange(len(value)), wide] = sign
        held = signs[np.arange(6) <= wide[:, None]].tobytes()
        end = np.cumsum(wide + 1)
        first = np.r_[0, end][self.a_first + self.b_first].tolist()
        return [held[i : max(i, j - 1)] for i, j in zip(first, first[1:])]


class Rows:
    """An array that grows."""

    def __init__(self, kind, *shape: int):
        self.held, self.n = np.zeros((1024, *shape), kind), 0

    def add(self, rows: np.ndarray) -> None:
        n = self.n + len(rows)
        if n > len(self.held):
            self.held = np.concatenate([self.held, np.zeros((max(n, 2 * len(self.held)) - len(self.held), *self.held.shape[1:]), self.held.dtype)])
        self.held[self.n : n] = rows
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Runs:
    """What is known of the pieces of texts that a worker has met: their groups as text, counts, and the id pairs of their links.

    Neither tokenizer merges over the beginning of a run of spaces and line feeds with what follows: B by its pieces, A as its words
    begin with white space. So a text is aligned as its runs are, one after another, and most runs come again and again. They are found by a hash and compared
    by all their characters; texts in which hashes of different runs are equal, texts with other white space, and texts with characters on which versions of Unicode
    differ are pieces as a whole. All is forgotten when it becomes too much.
    """

    def __init__(self, both: Both):
        self.both = both
        self.odd = re.compile(rf"[\t\x0b-\r\x85\xa0{chr(PLAIN_END)}-\U0010ffff]")
        self.forget()

    def forget(self) -> None:
        self.groups: list[bytes] = []
        self.whole: dict[str, int] = {}
        self.stats, self.pairs, self.first = Rows(np.int64, len(STATS)), Rows(np.int64), Rows(np.int64)
        self.codes, self.begin = Rows(np.uint16), Rows(np.int64)
        self.first.add(np.zeros(1, np.int64))
        self.begin.add(np.zeros(1, np.int64))
        # Hashes in order and where their runs are: many, and those that came last.
        self.sorted = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.scores, self.scored_by = np.zeros((0, 2), np.int64), None

    def full(self) -> bool:
        return len(self.groups) > HELD_RUNS or self.codes.n + sum(map(len, self.whole)) > HELD_CHARS

    def _add(self, x: Alignment, codes: np.ndarray, sizes: np.ndarray) -> None:
        i, j = x.links()
        at = np.searchsorted(i, x.a_first)
        counts = [np.diff(x.a_first), np.diff(x.b_first), np.diff(x.group_first), np.diff(at), x.of_texts(x.n_shared())]
        self.groups += x.spelt()
        self.stats.add(np.stack(counts, axis=1))
        self.first.add(self.pairs.n + at[1:])
        self.pairs.add(x.a[i] * len(self.both.lengths[1]) + x.b[j])
        self.begin.add(self.codes.n + np.cumsum(sizes))
        self.codes.add(codes)

    def _of_whole(self, text: str) -> int:
        if text not in self.whole:
            self.whole[text] = len(self.groups)
            self._add(Alignment.of(self.both, [text]), np.zeros(0, np.uint16), np.zeros(1, np.int64))
        return self.whole[text]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Where the runs with these hashes are; -1 for unknown ones."""
        out = np.full(len(hashes), -1)
        for known, place in self.sorted:
            if len(known):
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[k] == hashes, place[k], out)
        return out

    def _learn(self, joined: str, codes: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Runs of joined, given by their hashes, which are distinct and unknown, beginnings and sizes."""
        runs = [joined[a : a + n] for a, n in zip(start.tolist(), size.tolist())]
        here = np.arange(len(self.groups), len(self.groups) + len(runs))
        own = codes[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]
        self._add(Alignment(*self.both.runs(runs), *self.both.lengths), own, size)
        merge = lambda a, b: tuple(x[np.argsort(np.concatenate([a[0], b[0]]), kind="stable")] for x in map(np.concatenate, zip(a, b)))
        self.sorted[1] = merge(self.sorted[1], (hashes, here))
        if len(self.sorted[1][0]) > 1 << 16:
            self.sorted = [merge(*self.sorted), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the texts' pieces in what is known, in order, and where those of each text begin, and the end."""
        plain = [bool(t) and self.both.b.apart and not self.odd.search(t) for t in texts]
        joined = "".join([f" {t}" for t, p in zip(texts, plain) if p])
        codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        edges = np.cumsum([0, *(len(t) + 1 for t, p in zip(texts, plain) if p)])
        space = (codes == 32) | (codes == 10)
        begins = space & ~np.r_[False, space[:-1]]
        begins[edges[:-1]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.r_[start, len(codes)])
        place = np.arange(len(codes)) - np.repeat(start, size)
        signs = codes.astype(np.uint64) * PLACES[place % len(PLACES)] + (place // len(PLACES)).astype(np.uint64)
        hashes = hash_of(np.add.reduceat(signs, start) if len(start) else np.zeros(0, np.uint64), size)
        found = self._find(hashes)
        if (found < 0).any():
            new, at = np.unique(hashes[found < 0], return_index=True)
            at = np.flatnonzero(found < 0)[at]
            self._learn(joined, codes, new, start[at], size[at])
            found[found < 0] = self._find(hashes[found < 0])
        # Each run is compared with the known one of its hash.
        held = self.begin.all[found]
        alike = self.begin.all[found + 1] - held == size
        at = np.minimum(np.repeat(held, size) + place, max(self.codes.n - 1, 0))
        other = np.add.reduceat((self.codes.all[at] != codes).astype(np.int64), start) > 0 if len(start) else np.zeros(0, bool)
        owner = np.searchsorted(edges, start, side="right") - 1
        clash = set(owner[~alike | other].tolist())
        counts, nth = [], -1
        per_text = np.bincount(owner, minlength=len(edges) - 1)
        ends = np.r_[0, np.cumsum(per_text)]
        parts = []
        for t, p in zip(texts, plain):
            nth += p
            if p and nth not in clash:
                parts.append(found[ends[nth] : ends[nth + 1]])
            else:
                parts.append(np.array([self._of_whole(t)] if t else [], dtype=np.int64))
            counts.append(len(parts[-1]))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum([0, *counts])

    def score(self, name: str, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """(links that are the best of their B id, sum of the counts of links) of each piece, by sorted pairs; name tells these from others."""
        if self.scored_by != name:
            self.scores, self.scored_by = np.zeros((0, 2), np.int64), name
        done = len(self.scores)
        if done < len(self.groups):
            first = self.first.all[done:]
            key = self.pairs.all[first[0] :]
            k = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            values = [np.where(pair[k] == key, v[k], 0) if len(pair) else key * 0 for v in (best, n)]
            self.scores = np.concatenate([self.scores, np.stack([np.diff(np.r_[0, np.cumsum(v)][first - first[0]]) for v in values], axis=1)])
        return self.scores


def hash_of(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = (sums ^ sums >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
    return h ^ h >> np.uint64(29)


STATS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


@lru_cache(maxsize=2)
def runs_of(a_path: str, b_path: str) -> Runs:
    """One for each worker process."""
    return Runs(Both(a_path, b_path))


def chunks(sizes: list[int]):
    """Bounds of neighbours of CHUNK characters together, or one."""
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if total + n > CHUNK and k > at:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(pair, n): how many links hold each pair of ids; pair is A's id times the size of B's vocabulary, plus B's id.

    A task counts pieces, and gives the pairs of each piece that many times.
    """
    a_path, b_path = paths(a_path, b_path)

    def counted(runs: Runs, times: np.ndarray) -> pa.RecordBatch:
        first = runs.first.all
        pairs, inverse = np.unique(runs.pairs.all[: first[len(times)]], return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, inverse, np.repeat(times, np.diff(first[: len(times) + 1])))
        return pa.RecordBatch.from_arrays([pa.array(x[total > 0]) for x in (pairs, total)], names=["pair", "n"])

    def run(batches):
        runs = runs_of(a_path, b_path)
        times = np.zeros(len(runs.groups), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, end in chunks([len(t or "") for t in texts]):
                if runs.full():
                    yield counted(runs, times)
                    runs.forget()
                    times = np.zeros(0, np.int64)
                more = np.bincount(runs.places(texts[at:end])[0], minlength=len(runs.groups))
                more[: len(times)] += times
                times = more
        yield counted(runs, times)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def judged(counts: DataFrame, n_b: int) -> DataFrame:
    """counts with b, and best: whether no pair of this id of B has a larger count. An id of B has as many pairs as A has ids at most."""
    known = counts.withColumn("b", F.pmod("pair", F.lit(n_b)).cast("int"))
    return known.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def block_bounds(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """(first, last) ids of B of each block, from (id, pairs) in order."""
    out: list[list[int]] = []
    for b, n in sizes:
        if not out or out[-1][2] + n > limit:
            out.append([b, b, 0])
        out[-1][1], out[-1][2] = b, out[-1][2] + n
    return [(x[0], x[1]) for x in out]


RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum")


def counted(docs: DataFrame, pairs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, doc_id), RESULT and groups_sha256 of docs (row, doc_id, text) by one block of pairs (pair, n, best), which is collected and broadcast.

    Pairs outside it count as 0.
    """
    held = pairs.select("pair", "n", "best").toArrow()
    columns = {c: held.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")}
    order = np.argsort(columns["pair"])
    state = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *(columns[c][order] for c in ("pair", "n", "best"))))

    def run(batches):
        runs = runs_of(a_path, b_path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, end in chunks([len(t or "") for t in texts]):
                if runs.full():
                    runs.forget()
                found, ends = runs.places(texts[at:end])
                of = (runs.stats.all[found], runs.score(*state.value)[found])
                sums = np.diff(np.cumsum(np.concatenate([np.zeros((1, len(RESULT)), np.int64), np.concatenate(of, axis=1)]), axis=0)[ends], axis=0)
                flat, groups = found.tolist(), runs.groups
                spelt = [b";".join([groups[k] for k in flat[i:j]]) for i, j in zip(ends.tolist(), ends[1:].tolist())]
                digest = [hashlib.sha256(g).hexdigest() if g else "" for g in spelt]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], batch.column(1)[at:end], *map(pa.array, sums.T), pa.array(digest, pa.string())], names=["row", "doc_id", *RESULT, "groups_sha256"])

    return docs.mapInArrow(run, f"row long, doc_id long, {', '.join(f'{c} long' for c in RESULT)}, groups_sha256 string")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, RESULT and groups_sha256, one row per row of docs."""
    a_path, b_path = paths(a_path, b_path)
    pairs = written(judged(pair_counts(docs, a_path, b_path), len(runs_of(a_path, b_path).both.lengths[1])), "pairs")
    sizes = pairs.groupBy("b").agg(F.count("*").alias("n")).orderBy("b").collect()  # a row for each id of B at most
    bounds = block_bounds([tuple(r) for r in sizes], limit)
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if len(bounds) < 2:
        return counted(named, pairs, a_path, b_path).drop("row")
    # The texts are written once with a number for each row; then block follows block, each written before the next is collected.
    named = written(named, "numbered")
    parts = [written(counted(named, pairs.where(F.col("b").between(*x)), a_path, b_path), "counted") for x in bounds]
    summed = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*(F.sum(c).alias(c) if c in ("n_best", "count_sum") else F.first(c).alias(c) for c in ("doc_id", *RESULT, "groups_sha256")))
    return summed.drop("row")


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = False) -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, n_bytes): every pair of tokens of a text that overlap, by their places from 0.

    With groups, every pair of tokens that share a group, and n_bytes is 1 for each.
    """
    a_path, b_path = paths(a_path, b_path)
    schema = "doc_id long, a_at long, b_at long, a_id int, b_id int, n_bytes long"

    def run(batches):
        both = runs_of(a_path, b_path).both
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, end in chunks([len(t or "") for t in texts]):
                x = Alignment.of(both, texts[at:end])
                for first, block in x.shared() if groups else x.overlaps():
                    i, j = first + block.row_of(), block.indices
                    text = np.searchsorted(x.a_first, i, side="right") - 1
                    own = batch.column(0).take(pa.array(at + text))
                    yield pa.RecordBatch.from_arrays([own, *map(pa.array, (i - x.a_first[text], j - x.b_first[text])), *(pa.array(v, pa.int32()) for v in (x.a[i], x.b[j])), pa.array(block.data)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
