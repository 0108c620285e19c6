"""Encoding of a whole corpus with a public byte-level tokenizer.

Defined results: null and empty texts have the empty list of ids and size 0; a row without an id is encoded like any
other; other columns of the input are ignored; the strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.bpe import Encoder
from evigraph.runtime import ship

#: Characters that are encoded at once; bounds a task's memory whatever the lengths of the texts.
CHUNK_CHARS = 2_000_000


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of columns 0 and 1 in pieces of at most ``limit`` characters, or one text."""
    for b in batches:
        keys, texts, n = [], [], 0
        for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py() or ""
            if texts and n + len(t) > limit:
                yield keys, texts
                keys, texts, n = [], [], 0
            keys.append(k)
            texts.append(t)
            n += len(t)
        if keys:
            yield keys, texts


def _ids(batches: Iterator[pa.RecordBatch], path: str, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for keys, texts in chunks(batches):
        numbers = encoder.numbers(texts)
        sizes = [int(encoder.sizes[n].sum()) for n in numbers]
        flat = encoder.flat(np.concatenate(numbers))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), lists], ["key", "ids"])


def _sizes(batches: Iterator[pa.RecordBatch], path: str, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for keys, texts in chunks(batches):
        sizes = [int(encoder.sizes[n].sum()) for n in encoder.numbers(texts)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(sizes, pa.int64())], ["key", "n_tokens"])


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dict(df.dtypes)[column]]


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "") -> DataFrame:
    """(key, ids array<int>) of every row of ``df``."""
    kind = dict(df.dtypes)[key]
    ship(df.sparkSession)
    two = df.select(key, text)
    out = two.mapInArrow(partial(_ids, path=path, key_type=_arrow_type(df, key)), f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def token_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "") -> DataFrame:
    """(key, n_tokens) of every row of ``df``."""
    kind = dict(df.dtypes)[key]
    ship(df.sparkSession)
    two = df.select(key, text)
    out = two.mapInArrow(partial(_sizes, path=path, key_type=_arrow_type(df, key)), f"key {kind}, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_tokens")
