"""Operator 3: token counts by finite-state transducers (see token_fst)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lattica.llm.common import sliced, texts_of, tidy
from lattica.llm.token_fst import transducer

ROWS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every text, as the library for the tokenizer file counts them, with no added special tokens.

    Every row gives one row; null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows
    stay; an empty table gives no rows; other columns are not read. A text of exactly `limit` tokens isn't over it. One
    task holds at most about 1 MB of text at a time, or one text, however long.
    """
    # fmt: off
    @tidy("tokens")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in sliced(batches, "text", 1 << 20):
            n = pa.array(machine.counts(texts_of(batch.column("text"))), pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    # fmt: on

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(count, ROWS)
