"""Token counts without ids.

Pieces are counted once for each distinct pre-token; a document's count is the sum of its pre-token
frequencies times those counts. The dictionary of counts lives in the worker that reads the
documents: joining (document, pre-token) pairs through a shuffle would move more than the texts
themselves, so the plan is one scan without an exchange.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import chunks
from weftline.llm.common import pieces


def _counter(path: str | None) -> chunks.ChunkMemo:
    encoder = chunks.LibraryEncoder(path)
    return chunks.ChunkMemo(encoder, encoder.run_counts, len, sum, 800_000)


def count_tokens(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give a row; other
    columns are ignored; an empty table gives no rows. Texts of any length are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = chunks.memo("count", lambda: _counter(tokenizer), tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens: list[int] = []
            for a, b in pieces(texts):
                words = [(t or b"").split() for t in texts[a:b]]
                memo.learn(words)
                get = memo.__getitem__
                n_tokens += [sum(n * get(w) for w, n in Counter(ws).items()) for ws in words]
            sizes = [len(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
