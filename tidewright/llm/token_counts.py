"""Token counts of whole texts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.bpe import BLOCK, load, proof
from tidewright.llm.common import blocks, text_bytes, texts, tune

#: Tokens over which a text is marked.
LIMIT = 2048


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs; no shuffle.

    tokenizer: a tokenizers file that every executor can open; one whose rules aren't known raises an error. Pre-tokens
    among the vocabulary strings that are proven, once on the driver, to encode alone as one token count one; the rest
    are merged (llm/bpe.py). Texts are taken some MB at a time, a longer one by itself. Ids may be of any
    type, null or repeated: one row out for each row in. A null or empty text has 0 bytes and 0 tokens.
    An empty table gives no rows. Other
    columns of docs are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    proven = proof(docs.sparkSession, tokenizer)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(tokenizer, proven)
        for b in pieces.over(blocks(batches, 1, BLOCK)):
            text = texts(b.column(1))
            _, off = text_bytes(text)
            n = pieces.counts(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(off[1:] - off[:-1]), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
