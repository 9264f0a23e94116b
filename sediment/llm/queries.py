"""One query per operator over the whole of its table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import langid, licenses, lines, near, packing, phrases, postings, quality, rtree, simhash, substrings, suffixes, warc
from sediment.staging import stage, staging_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM twice, unnest(range(0, 5)) AS r(j)),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY ALL),
m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEATED} AS base_failed FROM m),
v AS (
  SELECT doc_id, lang, source, name, percent, spreads, (x >> s) << s AS bucket FROM (
    SELECT *, greatest(length(bin(x)) - 7, 0) AS s FROM (
      SELECT doc_id, lang, source, unnest({[n for n in quality.RATIOS]}) AS name, unnest({[p for _, p, _ in quality.RATIOS.values()]}) AS percent,
        unnest({[n for _, _, n in quality.RATIOS.values()]}) AS spreads,
        unnest([n_symbols * 1000 // n_words, word_chars * 1000 // n_words, n_repeat_words * 1000 // n_words,
                n_dup_lines * 1000 // n_words]) AS x
      FROM f WHERE NOT base_failed))),
q AS (
  SELECT name, lang, source, spreads, list_sort(list(bucket))[(count(*) + 1) // 2] AS middle, list_sort(list(bucket))[(count(*) * percent + 99) // 100] AS high
  FROM v GROUP BY name, lang, source, percent, spreads),
own AS (SELECT *, high + spreads * greatest(high - middle, 1 << greatest(length(bin(high)) - 7, 0)) AS own FROM q),
wide AS (SELECT name, lang, list_sort(list(own))[(count(*) + 1) // 2] AS usual FROM own GROUP BY name, lang),
verdict AS (
  SELECT v.doc_id, bool_and(bucket <= least(greatest(own, usual), usual * {quality.TRUST})) AS fine
  FROM v JOIN own ON v.name = own.name AND v.lang IS NOT DISTINCT FROM own.lang AND v.source IS NOT DISTINCT FROM own.source
    JOIN wide ON v.name = wide.name AND v.lang IS NOT DISTINCT FROM wide.lang
  GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept
FROM f LEFT JOIN verdict USING (doc_id)
"""


@query("op4_quality_rules", OP4_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {_BLANKS_SQL}), '{lines.UPPER}', '{lines.LOWER}') AS key
  FROM d, unnest(range(1, len(lines) + 1)) AS r(i)),
common AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS g FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT DISTINCT win.doc_id, i + j AS p FROM win JOIN first USING (g), unnest(range(0, 13)) AS r(j) WHERE m < win.doc_id),
gone AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM hit GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, string_agg(w[i], ' ' ORDER BY i) AS t FROM d CROSS JOIN unnest(range(1, len(w) + 1)) AS r(i)
  LEFT JOIN hit ON hit.doc_id = d.doc_id AND hit.p = i WHERE hit.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op3_substring_dedup", OP3_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i,
    unnest(list_transform(range(0, length(h) // 2 - 99), lambda k: md5_number(substr(h, 2 * k + 1, 200)))) AS g FROM d),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
runs AS (
  SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later)),
spans AS (SELECT doc_id, run, min(i) AS low, max(i) + 100 AS high FROM runs GROUP BY ALL),
gaps AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM spans),
cut AS (
  SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query("op10_suffix_dedup", OP10_SQL)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_earlier(table(spark, sf_dir, "documents"), window=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(u=lines.UPPER, l=lines.LOWER)

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_TERMS_SQL} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM phrase),
win AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM d, size, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, win.n, i FROM win JOIN phrase ON win.n = phrase.n AND win.g = phrase.g),
place AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS r(j) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)
"""


@query("op5_decontamination", OP5_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op1_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents"))


@query("op6_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end=2)


@query("op7_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op8_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    found = found.withColumn("licenses", F.filter("licenses", lambda x: x["best"]))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses.name", ",").alias("licenses"), F.coalesce(F.array_max("licenses.containment"), F.lit(0.0)).alias("containment"),
    )


OP2_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{warc.BASE32}',
    ((('0x' || substr(h, (k // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (body)
"""


@query("op2_warc_transactions", OP2_SQL)
def warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staging_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    records = stage(warc.read_records(spark, folder).withColumn(
        "page_id", F.when(F.col("type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"(?m)^page_id: (-?\d+)", 1).try_cast("long"))
    ).drop("payload"))
    assembled = stage(warc.captures(records).select(
        "id", F.col("capture").dropFields("page_id").alias("capture"), "metadata"
    ))
    found = warc.resolved(assembled)
    again = F.col("capture.type") == "revisit"
    return found.select(
        F.col("metadata.page_id").alias("page_id"),
        F.when(again, F.col("original.payload_bytes")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("original.payload_digest")).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(again, F.col("original_metadata.page_id")).alias("refers_to"),
    )


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


@query("op11_hard_negatives", OP11_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


@query("op12_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS a
  FROM p, unnest([1, 2, 3, 4]) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i) GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE a >= 30),
scored AS (
  SELECT f.lang, f.phrase, f.a, c, x.a AS l, y.a AS r, (2000000::HUGEINT * f.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM f, unnest(range(1, k)) AS s(c) JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.w[1:c], ' ')
    JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.w[c + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most
  FROM f, unnest(range(2, k)) AS s(n), unnest(range(1, k - n + 2)) AS r(i) GROUP BY ALL)
SELECT lowest.lang, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank, lowest.phrase, a, l, r, n, score
FROM lowest LEFT JOIN longer USING (lang, phrase) JOIN totals ON totals.lang = lowest.lang
WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
QUALIFY rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).drop("cut")
