"""License scans: which known license texts a document holds.

Method: MinHash bands over overlapping windows.  Templates are put into classes by length; for a class with at most
`size` shingles, a document's windows are 2 * size shingles long and begin every `size`, so any place where the template may
stand is inside one; its length is counted with repeated shingles.  Each of REGISTERS registers is a band of its own; a window retrieves every template with which it
agrees in a band, and the exact containment of the template's shingles in the window decides.

A window that holds 80 % of a template has a Jaccard similarity of at least 0.25 with it (two thirds of `size` shingles
or more, in 2 * size and the missing ones), so it is missed with a probability of at most 0.75 ^ 48, one in a million.

Variants of one text (BSD with two, three and four clauses) are found together; each window's best contained one is marked.

* A null or empty text has no words and no license.  A text of fewer words than a shingle has no window.
* Rows with one id are judged each by itself.  No row: no row.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sediment.llm.arrays import PIECE, U64, Sums, Words, column_bytes, mix, runs, slices
from sediment.llm.columns import bytes_of
from sediment.llm.license_texts import TEMPLATES
from sediment.llm.postings import LOWER, SEPARATORS
from sediment.types import col

SHINGLE, REGISTERS, CONTAINMENT = 3, 48, 0.8

#: The share of the smaller template that two have in common if they are variants of one text.
VARIANTS = 0.5


def template_shingles(text: str) -> np.ndarray:
    """All shingles of a text, in order."""
    body = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return Sums(Words(body, np.array([0, len(body)]), SEPARATORS).hashes()).hash_all(SHINGLE)


def size_class(n: int) -> int:
    """The least of 2, 3, 4, 6, 8, 12, ... that is not less."""
    size = 2
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size // 3 * 4
    return size


def register(shingles: np.ndarray, number: int) -> np.ndarray:
    seed, factor = (int(x) for x in mix(np.array([2 * number + 1, 2 * number + 2], U64)))
    return (shingles ^ U64(seed)) * U64(factor | 1)


class Templates:
    def __init__(self, texts: dict[str, str]):
        found = {k: template_shingles(v) for k, v in sorted(texts.items())}
        self.names = [k for k, v in found.items() if len(v)]
        self.shingles = [np.unique(found[k]) for k in self.names]
        self.classes: dict[int, list[int]] = {}
        for i, k in enumerate(self.names):
            self.classes.setdefault(size_class(len(found[k])), []).append(i)
        #: Of each template, those that are variants of the same text.
        self.variants = [
            {j for j, t in enumerate(self.shingles) if j != i and len(np.intersect1d(s, t)) >= VARIANTS * min(len(s), len(t))}
            for i, s in enumerate(self.shingles)
        ]
        #: Of each class and register, the minima of its templates, sorted, and whose they are.
        self.minima = {}
        for size, members in self.classes.items():
            for r in range(REGISTERS):
                least = np.array([register(self.shingles[i], r).min() for i in members])
                order = np.argsort(least)
                self.minima[size, r] = (least[order], np.array(members)[order])

    def retrieved(self, grams: np.ndarray, cuts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, set[tuple[int, int]]]:
        """Of each class, windows and templates that agree in a band.  A window is a block of shingles and the one that follows, if it does."""
        out: dict[int, set[tuple[int, int]]] = {size: set() for size in cuts}
        for r in range(REGISTERS):
            values = register(grams, r)
            for size, (starts, _, follows) in cuts.items():
                least = np.minimum.reduceat(values, starts)
                window = least.copy()
                window[:-1] = np.where(follows, np.minimum(least[:-1], least[1:]), least[:-1])
                known, whose = self.minima[size, r]
                at = np.searchsorted(known, window, "left")
                for w in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == window):
                    k = at[w]
                    while k < len(known) and known[k] == window[w]:  # templates may have their least shingle in common
                        out[size].add((int(w), int(whose[k])))
                        k += 1
        return out

    def best(self, hits: list[tuple[int, int, int, float]]) -> set[int]:
        """The templates with a window (template, start, end, share) that meets none of a variant that is better contained, or as well and longer."""
        def rank(t, share):
            return share, len(self.shingles[t])

        return {
            t for t, low, high, share in hits
            if not any(u in self.variants[t] and a < high and low < b and rank(u, other) > rank(t, share) for u, a, b, other in hits)
        }

    def scan(self, body: np.ndarray, offsets: np.ndarray) -> list[dict[str, tuple[float, bool]]]:
        """Of each document, the templates found, the largest share of their shingles in one window, and whether no variant fits better."""
        words = Words(LOWER[body], offsets, SEPARATORS)
        hashes, n = words.hashes(), np.diff(words.offsets)
        found: list[dict[str, tuple[float, bool]]] = [{} for _ in n]
        for a, b in runs(n, PIECE):
            low = words.offsets[a]
            every = Sums(hashes[low : words.offsets[b]]).hash_all(SHINGLE)
            owner = np.repeat(np.arange(a, b), n[a:b])
            places = np.flatnonzero(owner[: len(every)] == owner[SHINGLE - 1 :]) if len(every) else np.zeros(0, np.int64)
            if not len(places):
                continue
            grams, owner = every[places], owner[places]
            inner = places + low - words.offsets[owner]
            cuts = {}
            for size in self.classes:
                block = inner // size
                starts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])))
                cuts[size] = starts, np.append(starts[1:], len(grams)), owner[starts[1:]] == owner[starts[:-1]]
            hits: dict[int, list[tuple[int, int, int, float]]] = {}
            for size, pairs in self.retrieved(grams, cuts).items():
                starts, ends, follows = cuts[size]
                for w, t in pairs:
                    end = ends[w + 1] if w < len(follows) and follows[w] else ends[w]
                    share = float(np.isin(self.shingles[t], grams[starts[w] : end]).mean())
                    if share >= CONTAINMENT:
                        hits.setdefault(int(owner[starts[w]]), []).append((t, int(starts[w]), int(end), share))
            for document, mine in hits.items():
                best = self.best(mine)
                for t, _, _, share in mine:
                    found[document][self.names[t]] = max(share, found[document].get(self.names[t], (0.0,))[0]), t in best
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and `licenses` (name, containment, and whether it is the best of its variants there, sorted by name) of each row.

    The templates are an argument, so what tasks are sent is as large as the caller makes it.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in slices(batches, "body"):
            found = known.scan(*column_bytes(batch.column("body")))
            rows = [[{"name": k, "containment": v, "best": best} for k, (v, best) in sorted(f.items())] for f in found]
            kind = pa.list_(pa.struct([("name", pa.string()), ("containment", pa.float64()), ("best", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "licenses"])

    rows = docs.select(col(key).alias("doc_id"), bytes_of(text).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scanned, f"doc_id {kind}, licenses array<struct<name:string,containment:double,best:boolean>>")
