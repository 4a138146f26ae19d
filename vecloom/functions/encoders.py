"""Encoder plug-ins: batches of inputs to L2-normalised float32 vectors.

An encoder is a factory: it is called once per Python worker, loads its model there and
returns a function from a list of inputs (texts, or file contents as bytes) to an
[n, dim] array. Any model runtime can stand behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import unit_rows

Encoder = Callable[[], Callable[[list], np.ndarray]]


def hashed_words(dim: int = 64) -> Encoder:
    """Bag of words over hashed buckets: split on single spaces, keep case.

    A small model-free encoder; the bucket of a word is the first 32 bits of its MD5
    modulo ``dim``.
    """

    class Buckets(dict):
        def __missing__(self, word: str) -> int:
            if len(self) > 1_000_000:
                self.clear()
            self[word] = found = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
            return found

    def load():
        bucket = Buckets().__getitem__

        def encode(texts: list) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for row, text in enumerate(texts):
                words = filter(None, text.split(" "))
                out[row] = np.bincount(np.fromiter(map(bucket, words), np.int64), minlength=dim)
            return out

        return encode

    return load


def hashed_bytes(dim: int = 64) -> Encoder:
    """Histogram of byte values folded to ``dim`` buckets: a stand-in image encoder."""

    def load():
        def encode(blobs: list) -> np.ndarray:
            out = np.zeros((len(blobs), dim), np.float32)
            for row, blob in enumerate(blobs):
                folded = np.frombuffer(blob, np.uint8) % dim
                out[row] = np.bincount(folded, minlength=dim)
            return out

        return encode

    return load


def embed(column: Column, encoder: Encoder, batch_size: int = 256) -> Column:
    """Encode a text column in batches; the result is unit length, and null for a null."""

    def make_predict_fn():
        encode = encoder()

        def predict(inputs: np.ndarray) -> np.ndarray:
            known = np.array([x is not None for x in inputs])
            # A null needs a row too; any will do, since it is not used.
            if not known.any():
                return np.zeros((len(inputs), 1), np.float32)
            vectors = unit_rows(np.asarray(encode(list(inputs[known]))), np.float32)
            return vectors[np.maximum(np.cumsum(known) - 1, 0)]

        return predict

    vector = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )(column)
    return F.when(column.isNotNull(), vector)
