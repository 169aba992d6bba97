"""Encoding and decoding with a file of the sentencepiece library, in vectorised merge rounds.

Cases: a null or empty text has the begin and end ids only and decodes to an empty text;
repeated rows and long texts are encoded like any other; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from exprstudy.llm import bpe
from exprstudy.llm import textops as tx

ENCODED = "doc_id bigint, ids array<int>"
DECODED = "doc_id bigint, text string"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    file = bpe.piece_file(path)
    for rows in tx.slices(batches, "text", bpe.UNIT_BYTES):
        ids, at = file.encode(rows.column("text"))
        yield rows.column("doc_id").cast(pa.int64()), ids, at


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The ids of each whole text, with begin and end."""

    def run(batches):
        for keys, ids, at in _encoded(batches, path):
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The texts of ``(doc_id, ids)``."""

    def run(batches):
        file = bpe.piece_file(path)
        for rows in batches:
            lists = rows.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), tx.strings(*file.decode(ids, tx.offsets_of(lengths)))], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode the ids, and digest both; ids and texts do not leave the task."""

    def run(batches):
        file = bpe.piece_file(path)
        for keys, ids, at in _encoded(batches, path):
            data, data_at = file.decode(ids, at)
            raw, text = ids.astype("<u4").tobytes(), data.tobytes()
            n = len(at) - 1
            of_ids = [hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(n)]
            of_text = [hashlib.sha256(text[data_at[i] : data_at[i + 1]]).hexdigest() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.diff(at)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
