"""Suffix-array dedup over bytes: what occurs earlier in the collection is removed.

Method: a logarithmic family of indexes.  A new batch of documents gets a suffix array, is merge-scanned against
those of all levels for matches of at least `window` bytes, and becomes a level itself; two levels of
one size merge into one of twice the size, so there are as many levels as the number of batches has binary ones.

The suffix arrays are sparse: they hold the suffixes that begin at a stretch of an anchor (`windows.py`), 2 of
about 70, as an array with every suffix would take 8 bytes for each byte of text.  Their order within a
bucket is by fingerprints of what follows instead of by its bytes, which brings equal suffixes together just as
well; a stretch's fingerprint covers all its windows.  Matches that end inside a stretch are settled window by window.

* A null or empty text has no bytes.  A missing id counts as smaller than all others.
* Matches never cross documents.  Rows with one id and equal places are not earlier than each other: both keep them.
* Cuts may fall inside a character, as they are made between bytes; `kept` is binary.
* No row: no row.  Other columns are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import windows
from sediment.llm.arrays import column_bytes, slices
from sediment.llm.columns import id_back, keyed_texts
from sediment.staging import staging_folder
from sediment.types import col

#: Bytes of an anchor, at most half a window.
GRAM = 32


class SuffixLevels:
    """An index in the shared folder, to which batches of documents are added in any order."""

    def __init__(self, spark: SparkSession, window: int = 100):
        self.spark = spark
        self.shape = windows.Shape(window, min(GRAM, max(1, window // 2)), words=False, inside_documents=True)
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = windows.buckets_of(spark)
        self.folder = staging_folder(spark)
        self.levels: list[tuple[int, str]] = []  # batches in a level, and its folder; the largest first
        self.added: list[str] = []

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema("key long, data binary, kind int").parquet(folder).select("kind", "key", "data")

    def _level(self, folder: str, kind: int) -> DataFrame:
        return self._read(folder).where(F.col("kind") == windows.KEPT).withColumn("kind", F.lit(kind))

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.folder}/{len(self.added)}"
        self.added.append(folder)
        rows.write.partitionBy("kind").parquet(folder)
        return folder

    def _merge_equal(self) -> None:
        """Merge the two smallest levels as long as they are of one size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, one), (m, other) = self.levels.pop(), self.levels.pop()
            both = self._level(one, windows.ENTRY).unionByName(self._level(other, windows.ENTRY))
            merged = windows.met(both, self.shape, self.partitions, ask=False, keep=True)
            self.levels.append((n + m, self._write(merged.where(F.col("kind") == windows.KEPT))))
            for folder in (one, other):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/kind={windows.KEPT}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, texts: DataFrame, last: bool = False) -> DataFrame:
        """Add `doc`, `body`; what was found for new and for known documents, as rows of `windows`.

        The `last` batch becomes no level, as nothing will be compared with it.
        """
        self._merge_equal()
        rows = windows.entries_of(texts, self.shape, self.buckets)
        for _, folder in self.levels:
            rows = rows.unionByName(self._level(folder, windows.OLD))
        folder = self._write(windows.met(rows, self.shape, self.partitions, ask=True, keep=not last))
        if not last:
            self.levels.append((1, folder))
        return self._read(folder).where(F.col("kind") != windows.KEPT)


def remove_earlier(docs: DataFrame, window: int = 100, batches: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans` and `kept` (binary) of each row.

    The documents are added in `batches` ranges of their ids, of about equal numbers.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs, key, text)
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.select(F.percentile_approx(col(key).cast("long"), shares).alias("b")).first()["b"] or []
    index, found = SuffixLevels(spark, window), None
    edges = [None, *sorted(set(bounds)), None]
    for low, high in zip(edges[:-1], edges[1:]):
        inside = F.lit(True) if high is None else col(key) <= F.lit(high)
        if low is not None:
            inside = inside & (col(key) > F.lit(low))
        else:
            inside = inside | col(key).isNull()
        part = index.add(keyed_texts(docs.where(inside), key, text), last=high is None)
        found = part if found is None else found.unionByName(part)
    gone = windows.all_gone(texts, found, index.shape, index.buckets, index.partitions)

    def cleaned(batches):
        for batch in slices(batches, "body"):
            body, offsets = column_bytes(batch.column("body"))
            n, removed, spans, kept = [], [], [], []
            for a, b, blobs in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("data").to_pylist()):
                start, end = windows.gone_in(blobs, b - a)
                at, left = a, []
                for low, high in zip(start.tolist(), end.tolist()):
                    left.append(body[at : a + low].tobytes())
                    at = a + high
                left.append(body[at:b].tobytes())
                kept.append(b"".join(left))
                n.append(b - a)
                removed.append(b - a - len(kept[-1]))
                spans.append(len(start))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    out = windows.without_repeats(texts, gone).mapInArrow(
        cleaned, "doc long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return out.select(id_back("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
