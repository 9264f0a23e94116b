"""Language identification by cross-parsing entropy.

Method: for each language, a suffix automaton of labelled text.  A text is cut into phrases, each the longest match
with that automaton from where the one before ended; the language that needs the fewest phrases, weighted by the logarithm
of the size of its sample, wins.

The models are fitted on a bounded sample: of each language the DOCS documents that come first by a hash of their id,
CHARS characters each, MODEL_BYTES at most altogether, and less where there are so many languages that they would pass ALL_BYTES.  The sample alone
is what tasks are sent; each builds the automata, a table of some MB per language, once.

Texts are parsed whole.  A text is cut into stretches of SPAN bytes, of which thousands are read side by side as if a phrase began with each.
Then each is read once more from where the stretch before it left off, until a phrase begins where one did the first time: from there on both are the same,
mostly after some bytes.  Where that does not happen in a stretch, the next one is read again from the state that it really begins with.
The phrases are those of one reading from the first byte to the last.

* A null text, or one without a letter, is `und` with score 0; so is every text if nothing is labelled.
* Ties go to the language that comes first by its name.  A missing id is never learned from and not held out.
* Rows with one id are judged each by itself.  No row: no row.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.arrays import column_bytes, slices
from sediment.llm.columns import bytes_of
from sediment.types import col

DOCS, CHARS, MODEL_BYTES, ALL_BYTES = 40, 2000, 40_000, 1_000_000
SPAN = 256
FOLDS = 5

#: Letters keep their byte (small ones for A-Z), all else in ASCII is a blank.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[:128] = 0x20
_FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True

_models: dict[tuple, "Models"] = {}


def fold_of(key: str) -> Column:
    return F.crc32(col(key).cast("string").cast("binary")) % FOLDS


def automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for byte in text:
        new = len(steps)
        steps.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and byte not in steps[state]:
            steps[state][byte] = new
            state = link[state]
        if state >= 0:
            target = steps[state][byte]
            if longest[target] == longest[state] + 1:
                link[new] = target
            else:
                copy = len(steps)
                steps.append(dict(steps[target]))
                longest.append(longest[state] + 1)
                link.append(link[target])
                while state >= 0 and steps[state].get(byte) == target:
                    steps[state][byte] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return steps


class Models:
    """The automata of all languages as tables over the bytes that the samples hold."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        folded = {k: _FOLDED[np.frombuffer(v, np.uint8)] for k, v in samples.items()}
        seen = np.unique(np.concatenate([np.array([0x20], np.uint8), *folded.values()]))
        self.symbol = np.zeros(256, np.int64)  # 0: in no sample
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.tables, self.weights = [], []
        for language in self.languages:
            steps = automaton(folded[language].tobytes())
            table = np.full((len(steps) + 1, self.width), -1, np.int32)  # from the last state, nothing goes on
            for state, out in enumerate(steps):
                for byte, target in out.items():
                    table[state, self.symbol[byte]] = target
            table[0, table[0] < 0] = len(steps)  # a byte that is nowhere is a phrase of its own
            self.tables.append(table.ravel())
            self.weights.append(math.log2(len(folded[language]) + 2))

    def phrases(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many phrases each document has in each language."""
        symbols = self.symbol[_FOLDED[body]]
        sizes = np.diff(offsets)
        spans = (sizes + SPAN - 1) // SPAN
        document = np.repeat(np.arange(len(sizes)), spans)
        inner = (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
        start, length = offsets[document] + inner, np.minimum(sizes[document] - inner, SPAN)
        out = np.zeros((len(sizes), len(self.tables)), np.int64)
        for k, table in enumerate(self.tables):
            begins, last = self._alone(table, symbols, start, length)
            count = np.add.reduceat(begins, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
            count += self._mended(table, symbols, start, length, begins, last, inner == 0)
            out[:, k] = np.bincount(document, count, len(sizes))
        return out

    def _alone(self, table: np.ndarray, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every stretch by itself: where phrases begin, and the state after its last byte."""
        begins, last = np.zeros(len(symbols), bool), np.zeros(len(start), np.int64)
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(SPAN), "left")  # how many stretches are longer than each place
        at, state = start[order], np.full(len(start), len(table) // self.width - 1)
        for place in range(SPAN):
            m = int(active[place])
            if not m:
                break
            symbol = symbols[at[:m] + place]
            after = table[state[:m] * self.width + symbol]
            ended = after < 0
            begins[at[:m] + place] = ended
            state[:m] = np.where(ended, table[symbol], after)
        last[order] = state
        return begins, last

    def _mended(self, table: np.ndarray, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, begins: np.ndarray, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many more phrases each stretch has when it goes on with the one before, unless it is a document's first."""
        more, alone = np.zeros(len(start), np.int64), last.copy()
        again = np.flatnonzero(~first)
        while len(again):
            lane, state, change = again, last[again - 1], np.zeros(len(again), np.int64)
            ends = alone[again]  # of a stretch that falls into step
            index = np.arange(len(again))
            for place in range(SPAN):
                going = place < length[lane]
                ends[index[~going]] = state[~going]
                lane, state, index = lane[going], state[going], index[going]
                if not len(lane):
                    break
                at = start[lane] + place
                after = table[state * self.width + symbols[at]]
                ended, before = after < 0, begins[at]
                apart = ~(ended & before)
                change[index] += np.where(apart, ended.astype(np.int64) - before, 0)
                state = np.where(ended, table[symbols[at]], after)[apart]
                lane, index = lane[apart], index[apart]
            ends[index] = state
            more[again] = change
            moved = again[last[again] != ends]
            last[again] = ends
            follows = moved[moved + 1 < len(start)] + 1
            again = follows[~first[follows]]
        return more


def models_of(samples: dict[str, bytes]) -> Models:
    """Built once in a process."""
    key = tuple(sorted(samples.items()))
    if key not in _models:
        _models.clear()
        _models[key] = Models(samples)
    return _models[key]


def sample(labelled: DataFrame, key: str, text: str, lang: str) -> dict[str, bytes]:
    """The bounded sample of each language, of rows that are all labelled."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "body")
    rows = (
        labelled.select(col(lang).alias("lang"), col(key).alias("id"), F.substring(col(text), 1, CHARS).alias("body"))
        .where("length(body) > 0").withColumn("n", F.row_number().over(first)).where(F.col("n") <= DOCS)
    )
    out: dict[str, bytes] = {}
    for row in sorted(rows.collect(), key=lambda r: (r["lang"], r["n"])):
        out[row["lang"]] = out.get(row["lang"], b"") + row["body"].encode() + b"\n"
    most = min(MODEL_BYTES, ALL_BYTES // max(1, len(out)))
    return {k: v[:most] for k, v in out.items()}


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred` and `score` of each row; learned from rows of the other folds alone.

    The score is by how much the runner-up needs more, as a share of what it needs; 1 if there is no other language.
    """
    samples = sample(docs.where((fold_of(key) != 0) & col(lang).isNotNull()), key, text, lang)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = models_of(samples) if samples else None
        for batch in slices(batches, "body"):
            body, offsets = column_bytes(batch.column("body"))
            letters = np.append(0, np.cumsum(_ASCII_LETTER[body]))
            known = (letters[offsets[1:]] > letters[offsets[:-1]]) if models else np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(~known) if models else ():
                known[i] = has_letter(body[offsets[i] : offsets[i + 1]].tobytes())
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if models:
                cost = models.phrases(body, offsets) * np.array(models.weights)
                best = cost.argmin(axis=1)
                least, rest = cost[np.arange(len(best)), best], cost.copy()
                rest[np.arange(len(best)), best] = np.inf
                second = rest.min(axis=1)
                names[known] = np.array(models.languages, object)[best[known]]
                with np.errstate(invalid="ignore", divide="ignore"):
                    score[known] = np.where(np.isinf(second), 1.0, (second - least) / second)[known]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "held_out"]).columns, pa.array(names, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(col(key).alias("doc_id"), F.coalesce(fold_of(key) == 0, F.lit(False)).alias("held_out"), bytes_of(text).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
