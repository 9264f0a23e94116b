"""The same results without Spark, one text at a time, and a small collection with every odd case."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql.types import LongType, StringType, StructField, StructType

NO_ID = -(2**63)
LOWER = {i: i + 32 for i in range(65, 91)}

#: Extra columns with the names that the operators use inside.
CLASHING = ["doc", "body", "row", "data", "kind", "key", "line", "position", "node", "bucket", "pivot", "kept", "file", "n_words", "hits", "rank"]
SCHEMA = StructType(
    [StructField("doc_id", LongType()), *[StructField(c, StringType()) for c in ("text", "lang", "source")], StructField("n_chars", LongType())]
    + [StructField(c, StringType()) for c in CLASHING]
)


def collection(seed: int = 7, long_words: int = 90_000) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, passages and lines in common, and odd ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(1, 9))) for _ in range(600)] + ["Été", "naïve", "日本"]

    def prose(n, per_line=15):
        words = [r.choice(vocabulary) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))

    passage, line = prose(60), "  This one line is found in very many of the documents here \t"
    texts = [prose(r.randint(1, 300)) for _ in range(40)]
    for i in range(0, 40, 3):
        texts[i] += "\n" + passage
    for i in range(0, 40, 4):
        texts[i] = f"{line.upper() if i % 8 else line}\n{texts[i]}\n{line}"
    near = texts[1].split(" ")
    texts += [texts[5], texts[5], " ".join([*near[:-1], "changed"]), " ".join(["other", *near[1:]])]
    texts += [prose(30) + "\n" + "\n".join(["again and again the same words"] * 9), "a b c", "one", "# $ % & | < > *" * 30]
    texts += ["x" * 700, passage, "日本 " * 150, "\n\n\n", " \t\n", "", None, "1234 5678"]
    texts.append(prose(long_words) + "\n" + passage + "\n" + texts[2])
    r.shuffle(texts)
    rows = [(i * 3, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((None, passage, None, None, None))
    rows += [rows[3], rows[3], rows[8]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], SCHEMA).repartition(3)


def ident(i):
    return NO_ID if i is None else i


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def grams(items, n):
    return [tuple(items[i : i + n]) for i in range(len(items) - n + 1)]


def covered(starts, n, size):
    hit = [False] * size
    for s in starts:
        hit[s : s + n] = [True] * n
    return hit


def word_repeats(rows, window=13):
    """doc_id -> (n_words, n_removed, kept)."""
    first = {}
    for i, t, *_ in rows:
        for g in grams(words(t), window):
            first[g] = min(first.get(g, ident(i)), ident(i))
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        hit = covered([s for s, g in enumerate(grams(w, window)) if first[g] < ident(i)], window, len(w))
        out[i] = (len(w), sum(hit), b" ".join(x for x, h in zip(w, hit) if not h).decode())
    return out


def byte_repeats(rows, window=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept)."""
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: ident(r[0])):
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            first.setdefault(b[s : s + window], (ident(i), s))
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        starts = [s for s in range(len(b) - window + 1) if first[b[s : s + window]] < (ident(i), s)]
        hit = covered(starts, window, len(b))
        spans = sum(h and not p for h, p in zip(hit, [False, *hit]))
        out[i] = (len(b), sum(hit), spans, bytes(x for x, h in zip(b, hit) if not h))
    return out


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def line_dedup(rows, min_chars=40, min_docs=5):
    """doc_id -> (n_lines, n_dropped, text)."""
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[line_key(x)].add(ident(i))
    common = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(line_key(x), ident(i)) == ident(i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    twice = Counter(grams(w, 5))
    hit = covered([s for s, g in enumerate(grams(w, 5)) if twice[g] > 1], 5, len(w))
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(hit)


def quality(rows, ratios, trust, min_words=10, max_repeated=20):
    """One (doc_id, measures, base_failed, kept) for each row."""
    where = {"symbols": 2, "chars": 1, "repeats": 4, "lines": 3}

    def width(v):
        return 1 << max(v.bit_length() - 7, 0)

    def bucket(m, name):
        v = m[where[name]] * 1000 // m[0]
        return v - v % width(v)

    def quantile(values, percent):
        return sorted(values)[-(-len(values) * percent // 100) - 1]

    sketches, judged = defaultdict(list), []
    for r in rows:
        m = measures(r[1])
        judged.append((r, m, m[0] < min_words or 100 * m[4] > max_repeated * m[0]))
        for name in where:
            if not judged[-1][2]:
                sketches[name, r[2], r[3]].append(bucket(m, name))
    own, votes = {}, defaultdict(list)
    for group, values in sketches.items():
        _, percent, spreads = ratios[group[0]]
        middle, high = quantile(values, 50), quantile(values, percent)
        own[group] = high + spreads * max(high - middle, width(high))
        votes[group[:2]].append(own[group])

    def limit(name, lang, source):
        usual = quantile(votes[name, lang], 50)
        return min(max(own[name, lang, source], usual), trust * usual)

    return [(r[0], *m, failed, not failed and all(bucket(m, n) <= limit(n, r[2], r[3]) for n in where)) for r, m, failed in judged]


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(rows, items, window=10):
    """doc_id -> (n_words, n_hit, items); rows with one id have equal texts."""
    phrases = defaultdict(set)
    for name, t in items:
        w = terms(t)
        for g in grams(w, min(window, len(w))) if w else ():
            phrases[g].add("" if name is None else str(name))
    sizes = {len(g) for g in phrases}
    out = {}
    for i, t, *_ in rows:
        w, hit, found = terms(t), [False] * len(terms(t)), set()
        for n in sizes:
            for s, g in enumerate(grams(w, n)):
                if g in phrases:
                    hit[s : s + n] = [True] * n
                    found |= phrases[g]
        out[i] = (len(w), sum(hit), sorted(found))
    return out


def shingles(text, weights="one", n=5):
    w = words(text)
    found = grams(w, n) if len(w) >= n else [tuple(w)] if w else []
    return Counter({g: sum(map(len, g)) if weights == "length" else 1 for g in found})


def probability_jaccard(x, y):
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys())
    return total


def near_classes(rows, similarity=0.8, weights="one"):
    """doc_id -> class_id of rows whose ids differ or whose texts are equal."""
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(tuple(words(t)) or ("empty", i), set()).add(ident(i))
    nodes = list(texts)
    sets = [shingles(b" ".join(k).decode(), weights) if k[0] != "empty" else Counter() for k in nodes]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(nodes)), 2):
        common = sum((sets[a] & sets[b]).values())
        if common >= 0.5 * max(sum(sets[a].values()), sum(sets[b].values())) > 0 and probability_jaccard(sets[a], sets[b]) >= similarity:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: 2**63)
    for n, k in enumerate(nodes):
        least[find(n)] = min(least[find(n)], min(texts[k]))
    return {i: least[find(n)] for n, k in enumerate(nodes) for i in texts[k]}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
