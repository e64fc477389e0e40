"""Encoders: texts to vectors of unit length, with one prefix for passages and another for queries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE, QUERY = "passage: ", "query: "
BATCH = 32


def prefixed(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))


def unit_vectors(part: np.ndarray) -> pa.Array:
    """The rows of a matrix at unit length; rows of zeros stay."""
    length = np.linalg.norm(part, axis=1, keepdims=True)
    unit = np.divide(part, length, out=np.zeros_like(part), where=length > 0)
    return pa.array(list(unit.astype(np.float64)), pa.list_(pa.float64()))


class Encoder:
    """encode() gives (key, vector) for a table of texts. Subclasses give a function that a worker builds once."""

    def builder(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        raise NotImplementedError

    def version(self) -> str:
        """What tells the vectors of this encoder from those of others: its class and plain settings."""
        return "/".join([type(self).__name__, *(f"{k}={v}" for k, v in sorted(vars(self).items()) if isinstance(v, (int, str)))])

    def encode(self, texts: DataFrame, key: str, text: str, prefix: str = "") -> DataFrame:
        build, kind = self.builder(), texts.schema[key].dataType.simpleString()

        def run(batches):
            encode = build()
            for batch in batches:
                rows = batch.column(1).to_pylist()
                for a in range(0, len(rows), BATCH * 32):
                    vectors = unit_vectors(encode(rows[a : a + BATCH * 32]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, BATCH * 32), vectors], names=[key, "vector"])

        return texts.select(key, prefixed(prefix, F.col(text)).alias("text")).mapInArrow(run, f"`{key}` {kind}, vector array<double>")


class HashingEncoder(Encoder):
    """Words of a text, hashed with signs; no model and no randomness."""

    def __init__(self, size: int = 256):
        self.size = size

    def builder(self):
        size = self.size

        def build():
            places: dict[str, tuple[int, float]] = {}

            def encode(rows: list[str]) -> np.ndarray:
                out = np.zeros((len(rows), size))
                for i, row in enumerate(rows):
                    for w in re.findall(r"\w+", row.lower()):
                        if w not in places:
                            if len(places) > 200_000:
                                places.clear()
                            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                            places[w] = (h >> 1) % size, 1.0 if h & 1 else -1.0
                        at, sign = places[w]
                        out[i, at] += sign
                return out

            return encode

        return build


class ModelEncoder(Encoder):
    """A sentence-transformers model, if that library and the model are there; loaded once a worker."""

    def __init__(self, model: str):
        self.model = model

    def builder(self):
        name = self.model

        def build():
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name)
            return lambda rows: np.asarray(model.encode(rows, batch_size=BATCH), dtype=np.float64)

        return build


class PrecomputedEncoder(Encoder):
    """Vectors that a table (key, vector) holds already."""

    def __init__(self, vectors: DataFrame, key: str, vector: str):
        self.vectors, self.key, self.vector = vectors, key, vector

    def encode(self, texts: DataFrame, key: str, text: str, prefix: str = "") -> DataFrame:
        held = self.vectors.select(F.col(self.key).alias("_key"), F.col(self.vector).alias("vector"))
        return texts.select(key).join(held, F.col(key) == F.col("_key")).drop("_key")
