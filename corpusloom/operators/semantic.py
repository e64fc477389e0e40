"""An encoder that is learned from the texts themselves: singular vectors of weighted term counts, so that words which keep the same company are near.

Texts are split into words once: how often each text has each term is kept as a table in the shared folder, and all else reads that.
The matrix (text, term) is never built. A randomised range finder passes over it a few times: each task multiplies its rows by a narrow
matrix of TERMS rows, which is broadcast (its size is fixed: TERMS times width numbers), and returns what its rows add to the next one. What tasks return is
summed in a shuffle by blocks of terms. The driver holds narrow matrices only, whatever the number of texts.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.encoding import Encoder, unit_vectors
from corpusloom.sources.scratch import written

#: Hashed terms; vectors' size, and columns of the range finder beyond it; passes that sharpen the range; rows of terms in one row of the shuffle.
TERMS, SIZE, EXTRA, TURNS, BLOCK = 1 << 15, 64, 16, 2, 512
#: Texts that are split at once; that are multiplied at once as a dense block of their terms; that are encoded at once. What few texts need stays in a core's cache.
TEXTS, ROWS, ENCODED = 256, 32, 4
#: Every task of a pass returns a whole narrow matrix, so a pass has a task for so many texts, but from one to four for each core. Beyond so many tasks, two levels add.
TASK_TEXTS, TASKS_ADDED = 20_000, 64
SEED = 29
WORD = re.compile(r"\w+")


class TermOf(dict):
    """The hashed terms of words, kept from text to text."""

    def __init__(self, terms: int):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        term = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.terms
        return term


def cells_of(texts: list[str | None], term_of: TermOf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often it is met), by text and term."""
    found = [WORD.findall((t or "").lower()) for t in texts]
    lengths = np.array([len(f) for f in found], dtype=np.int64)
    met = np.fromiter(map(term_of.__getitem__, chain.from_iterable(found)), np.int64, lengths.sum())
    key, n = np.unique(np.repeat(np.arange(len(texts)), lengths) * term_of.terms + met, return_counts=True)
    return key // term_of.terms, key % term_of.terms, n


def counts_of(text: str | None, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text in order, and 1 + log of how often each is met."""
    _, at, n = cells_of([text], TermOf(terms))
    return at, 1 + np.log(n)


def weighted(cells: tuple, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, value) of the cells of texts' rows, which have unit length."""
    rows, at, n = cells
    value = (1 + np.log(n)) * weight[at]
    length = np.sqrt(np.bincount(rows, weights=value * value))[rows]
    return rows, at, np.divide(value, length, out=value, where=length > 0)


def times(cells: tuple, n: int, narrow: np.ndarray) -> np.ndarray:
    """The product [text, width] of rows given by cells with a narrow matrix. Each row is summed alone, so equal texts have equal products to the last bit."""
    rows, terms, values = cells
    out = np.zeros((n, narrow.shape[1]))
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat(values[:, None] * narrow[terms], first, axis=0)
    return out


def dense(cells: tuple, n: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms that are met in n rows, in order, and the rows as a matrix [text, term met]."""
    rows, at, values = cells
    there = np.zeros(terms, bool)
    there[at] = True
    out = np.zeros((n, np.count_nonzero(there)))
    out[rows, (np.cumsum(there) - 1)[at]] = values
    return np.flatnonzero(there), out


def counted(docs: DataFrame, text: str, key: str | None = None, terms: int = TERMS) -> DataFrame:
    """(key, terms, n) in the shared folder: the hashed terms of every text, in order, and how often each is met. Without a key, key is null."""
    kind = docs.schema[key].dataType.simpleString() if key else "long"

    def run(batches):
        term_of = TermOf(terms)
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                rows, at, n = cells_of(part.column(1).to_pylist(), term_of)
                ends = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, n)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["key", "terms", "n"])

    named = F.col(key) if key else F.lit(None).cast("long")
    return written(docs.select(named.alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, terms array<int>, n array<int>"), "term-counts")


def row_cells(batch: pa.RecordBatch, weight: np.ndarray, step: int):
    """The weighted cells of a batch of counts, by so many texts at a time, each with the number of its texts."""
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        at, n = (part.column(c) for c in ("terms", "n"))
        rows = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
        yield weighted((rows, at.flatten().to_numpy(), n.flatten().to_numpy()), weight), part.num_rows


def term_weights(counts: DataFrame, terms: int = TERMS) -> np.ndarray:
    """log((1 + texts) / (1 + texts with the term)) + 1 of each hashed term, over all texts. A row for each term, of which there are terms at most, reaches the driver."""

    def run(batches):
        n, met = 0, np.zeros(terms, np.int64)
        for batch in batches:
            n += batch.num_rows
            met += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        used = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[n, met[used]])], names=["term", "n"])

    held = {r["term"]: r["n"] for r in counts.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, met = held.pop(-1, 0), np.zeros(terms)
    for k, v in held.items():
        met[k] = v
    return np.log((1 + n) / (1 + met)) + 1


def passed(counts: DataFrame, tasks: int, weight: np.ndarray, narrow: np.ndarray, gram: bool = False) -> np.ndarray:
    """At . (A . narrow), or with gram (A . narrow)t . (A . narrow), where A are the weighted rows of all texts: one pass over them, of so many tasks at most."""
    width = narrow.shape[1]
    sent = counts.sparkSession.sparkContext.broadcast((weight, narrow))

    def run(batches):
        own, matrix = sent.value
        total, touched = np.zeros((width if gram else len(own), width)), np.zeros(len(own), bool)
        for batch in batches:
            for cells, n in row_cells(batch, own, ROWS):
                met, rows = dense(cells, n, len(own))
                y = rows @ matrix[met]
                if gram:
                    total += y.T @ y
                else:
                    total[met] += rows.T @ y
                    touched[met] = True
        step = len(total) if gram else BLOCK
        blocks = [k for k in range(0, len(total), step) if gram or touched[k : k + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([total[k : k + step].tobytes() for k in blocks], pa.binary())], names=["block", "part"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in part.column("part").to_pylist())
        return pa.table({"block": part.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    parts = counts.select("terms", "n").coalesce(tasks).mapInArrow(run, "block long, part binary")
    if tasks > TASKS_ADDED:  # so that no task adds what all tasks return
        parts = parts.groupBy("block", F.pmod(F.xxhash64("part"), F.lit(math.isqrt(tasks)))).applyInArrow(add, "block long, part binary")
    parts = parts.groupBy("block").applyInArrow(add, "block long, part binary")
    out = np.zeros((width if gram else len(weight), width))
    for block, part in parts.collect():
        own = np.frombuffer(part).reshape(-1, width)
        out[block : block + len(own)] = own
    sent.destroy()
    return out


class SemanticEncoder(Encoder):
    """Texts as products of their weighted terms with singular vectors."""

    def __init__(self, weight: np.ndarray, basis: np.ndarray):
        self.weight, self.basis = weight, basis

    def version(self) -> str:
        return f"SemanticEncoder/{hashlib.sha256(self.weight.tobytes() + self.basis.tobytes()).hexdigest()}"

    @classmethod
    def fit(cls, docs: DataFrame, text: str, size: int = SIZE, terms: int = TERMS, turns: int = TURNS, extra: int = EXTRA) -> SemanticEncoder:
        """The first right singular vectors, size at most, of the weighted rows of all texts, each signed so that its largest part is positive."""
        return cls.fit_counts(counted(docs, text, terms=terms), size, terms, turns, extra)

    @classmethod
    def fit_counts(cls, counts: DataFrame, size: int = SIZE, terms: int = TERMS, turns: int = TURNS, extra: int = EXTRA) -> SemanticEncoder:
        """What fit gives, for texts that are counted already."""
        weight, cores = term_weights(counts, terms), counts.sparkSession.sparkContext.defaultParallelism
        tasks = min(max(counts.count() // TASK_TEXTS, cores), 4 * cores)
        basis = np.random.default_rng(SEED).standard_normal((terms, size + extra))
        for _ in range(turns + 1):
            basis = np.linalg.qr(passed(counts, tasks, weight, basis))[0]
        strength, turn = np.linalg.eigh(passed(counts, tasks, weight, basis, gram=True))
        kept = [k for k in np.argsort(-strength)[:size] if strength[k] > 1e-9 * max(strength.max(), 1e-300)]
        basis = basis @ turn[:, kept]
        if kept:
            basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(kept))])
        return cls(weight, basis if kept else np.zeros((terms, 1)))

    def builder(self):
        weight, basis = self.weight, self.basis

        def build():
            term_of = TermOf(len(weight))
            return lambda rows: np.concatenate([times(weighted(cells_of(rows[a : a + ENCODED], term_of), weight), len(rows[a : a + ENCODED]), basis) for a in range(0, len(rows), ENCODED)])

        return build

    def encode_counts(self, counts: DataFrame, key: str) -> DataFrame:
        """What encode gives, for texts that are counted already; their key is named key."""
        weight, basis, kind = self.weight, self.basis, counts.schema["key"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                part = [times(cells, n, basis) for cells, n in row_cells(batch, weight, ENCODED)]
                if part:
                    yield pa.RecordBatch.from_arrays([batch.column(0), unit_vectors(np.concatenate(part))], names=[key, "vector"])

        return counts.mapInArrow(run, f"`{key}` {kind}, vector array<double>")
