"""Token counts (operator 11): batches of texts are encoded in Arrow functions that return lengths only.

A task fills batches up to ``batch_bytes`` of text, whatever rows the bytes come from; a text over
``part_chars`` is cut at places that no token crosses (``encoding.parts``) and its parts go
to the batches like short texts, so that one long text neither makes a long batch nor is
held as ids at once. No ids leave the encoder and no rows are shuffled: a row's count is
the sum of its parts in the task that read it.

Defined results: null and empty texts have no tokens; every row is counted by itself,
repeated rows and null ids included; an empty table gives an empty result; other columns, whatever
their names, are ignored; bytes that are not UTF-8 count as they are in ``n_bytes`` and are
encoded as U+FFFD. A text without a safe place (one unbroken run) is encoded whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.encoding import Tokens, default_path, parts, text_of

BATCH_BYTES, PART_CHARS = 1 << 20, 1 << 16
_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def balanced(texts: Iterator[tuple[int, str]], batch_bytes: int, part_chars: int, tokens: Tokens) -> Iterator[tuple[list, list]]:
    """(rows, parts of their texts) with about ``batch_bytes`` of text each."""
    rows: list[int] = []
    batch: list[str] = []
    held = 0
    for row, text in texts:
        for part in parts(text, part_chars, tokens):
            rows.append(row)
            batch.append(part)
            held += len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
            if held >= batch_bytes:
                yield rows, batch
                rows, batch, held = [], [], 0
    if rows:
        yield rows, batch


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit: more than ``limit`` tokens) per row of ``docs``."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            texts = ((k, text_of(v.as_py())) for k, v in enumerate(b.column(1)))
            for rows, batch in balanced(texts, batch_bytes, part_chars, tokens):
                np.add.at(n, rows, tokens.lengths(batch))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], schema=_OUT)
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).mapInArrow(
        run, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
