"""Encoding of a whole corpus with a public tokenizer (problem 6)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm import bpe

#: Vocabulary file of byte_bpe_50k; every operator takes the path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.cache
def vocabulary(path: str) -> bpe.Vocabulary:
    """The vocabulary with its minimal perfect hash, built once on the driver and then broadcast (about 2 MB, fixed)."""
    return bpe.Vocabulary.load(path)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Token ids of every text, without special tokens: (id_col, ids array<int>), one row for each row of df.

    One narrow pass, no shuffle: each task reads only the two columns, cuts pre-tokens over whole Arrow batches and
    looks up each distinct pre-token once. A null and an empty text both give the empty list; no other text is changed.
    Repeated rows, null ids and further columns of df (which are not read, whatever their names) are allowed; an empty
    table gives no rows. A text is handled whole, whatever its length.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    kept = df.select(df[id_col], df[text_col].alias("__text"))
    id_type = kept.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(vocabulary_path, shared.value)
        for batch in batches:
            names, text = batch.column(0), batch.column(1)
            for row, rows, data, bounds in bpe.chunks(text):
                found = encoder.encode(data, bounds)
                total = np.append(0, np.cumsum(found.counts))[found.text_first]
                ids = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(found.ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([names.slice(row, rows), ids], [id_col, "ids"])

    return kept.mapInArrow(run, T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
