"""Substring dedup over words: a passage that a document with a smaller id holds too is removed.

Method: seed and extend.  Documents meet on winnowed anchors of GRAM words (`windows.py`); the matches are
extended both ways to the whole stretch around the anchor and, where two stretches differ, window by window.
What is found are the maximal repeats of at least `window` words; each word inside one is removed.

* A null or empty text has no words.  A missing id counts as smaller than all others.
* Repeats inside one document stay, unless a smaller one holds them; rows with one id are one document.
* A text of any length is worked on in pieces that overlap by one window, so memory is bounded.
* No row: no row.  Other columns are not looked at.

Stretches and windows are compared by 96 bits of hashes (`windows.py`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

import pyarrow as pa

from sediment.llm import windows
from sediment.llm.arrays import column_bytes, slices
from sediment.llm.columns import id_back, keyed_texts
from sediment.staging import stage

#: Words of an anchor, at most half a window.
GRAM = 5


def remove_repeats(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_words`, `n_removed`, `kept` (the other words, joined by a space) and `spans` (start and length, in words)."""
    spark = docs.sparkSession
    shape = windows.Shape(window, min(GRAM, max(1, window // 2)), words=True, inside_documents=False)
    buckets, partitions = windows.buckets_of(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed_texts(docs, key, text)
    found = stage(windows.met(windows.entries_of(texts, shape, buckets), shape, partitions, ask=True))
    gone = windows.all_gone(texts, found, shape, buckets, partitions)

    def cleaned(batches):
        for batch in slices(batches, "body"):
            body, offsets = column_bytes(batch.column("body"))
            n, removed, kept, spans = [], [], [], []
            for a, b, blobs in zip(offsets[:-1], offsets[1:], batch.column("data").to_pylist()):
                words = body[a:b].tobytes().split()
                start, end = windows.gone_in(blobs, len(words))
                at, left = 0, []
                for low, high in zip(start.tolist(), end.tolist()):
                    left += words[at:low]
                    at = high
                left += words[at:]
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                spans.append([{"start": s, "length": e - s} for s, e in zip(start.tolist(), end.tolist())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                ],
                names=["doc", "n_words", "n_removed", "kept", "spans"],
            )

    out = windows.without_repeats(texts, gone).mapInArrow(
        cleaned, "doc long, n_words long, n_removed long, kept string, spans array<struct<start:long,length:long>>"
    )
    return out.select(id_back("doc").alias("doc_id"), "n_words", "n_removed", "kept", "spans")
