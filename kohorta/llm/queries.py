"""The numbered queries of this subpackage over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (bpe, collocations, descent, langid, licenses, lines, multi_index, packing, periodic, quality, simhash, suffix,
               warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
     k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS latest
           FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN latest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN latest <> page_id THEN latest END AS refers_to
FROM k"""


@_query("op1_warc", _WARC_SQL)
def op1(spark, sf):
    return warc.read(warc.write(_table(spark, sf, "pages")), payload=False)


@_query("op2_suffix_dedup")
def op2(spark, sf):
    return suffix.dedup(_table(spark, sf, "documents"))


@_query("op3_multi_index")
def op3(spark, sf):
    return multi_index.search(_table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


@_query("op4_nn_descent")
def op4(spark, sf):
    return descent.near_duplicates(_table(spark, sf, "embeddings"))


@_query("op5_byte_bpe")
def op5(spark, sf):
    return bpe.encode_documents(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query("op6_quality")
def op6(spark, sf):
    docs = _table(spark, sf, "documents")
    model = quality.fit(docs, _table(spark, sf, "labels"), learn=quality.by_id("_id", 5) != 0)
    held = F.coalesce(quality.by_id("doc_id", 5) == 0, F.lit(False))
    return quality.score(docs.select("doc_id", held.alias("held_out"), "text"), model)


@_query("op7_language")
def op7(spark, sf):
    docs = _table(spark, sf, "documents")
    held = F.coalesce(quality.by_id("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model)


@_query("op8_packing")
def op8(spark, sf):
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op9_simhash")
def op9(spark, sf):
    return simhash.near_duplicates(_table(spark, sf, "documents"))


@_query("op10_lines")
def op10(spark, sf):
    return lines.dedup(_table(spark, sf, "documents").select("doc_id", "text"), every=True).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@_query("op11_licenses")
def op11(spark, sf):
    base = F.filter("spans", lambda s: s["base"])
    words = F.transform(base, lambda s: s["first_word"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return licenses.scan(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        "score")


_COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
     g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(ws) - k + 2),
                  lambda i: {'phrase': array_to_string(ws[i:i + k - 1], ' '), 'words': k})))) AS g FROM w),
     n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
     f AS (SELECT lang, g.phrase AS phrase, g.words AS words, string_split(g.phrase, ' ') AS ws, count(*) AS a
           FROM g GROUP BY ALL HAVING count(*) >= 30),
     inside AS (SELECT lang, s AS phrase, max(a) AS most
                FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, words), lambda m: list_transform(
                      range(1, words - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS s FROM f WHERE words > 2)
                GROUP BY ALL),
     kept AS (SELECT f.* FROM f LEFT JOIN inside i ON i.lang = f.lang AND i.phrase = f.phrase
              WHERE f.words > 1 AND (most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * f.a)),
     cut AS (SELECT *, unnest(range(1, words)) AS k FROM kept),
     s AS (SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, 2000000::HUGEINT * c.a // (l.a + r.a) AS score
           FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
                      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:c.words], ' ')),
     low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM top JOIN n USING (lang) WHERE rank <= 2000"""


@_query("op12_collocations", _COLLOCATIONS_SQL)
def op12(spark, sf):
    return collocations.collocations(_table(spark, sf, "documents"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text; in texts with crc32(doc_id) % 10 = 0 each word from a on becomes word a + (i - a) % p (see _RUNS_SQL)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    again = F.expr(r"""transform(transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)),
        w -> struct(w, cast(h div 10 % size(w) as int) as a)), s -> array_join(transform(sequence(0, size(s.w) - 1), i -> s.w[
        if(i < s.a, i, s.a + cast((i - s.a) % (1 + (size(s.w) - s.a) div (3 + h div 10 % 8)) as int))]), ' '))[0]""")
    return docs.select("doc_id", "text", h.alias("h")).select(
        "doc_id", F.when(F.expr(r"h % 10 = 0 and text rlike '[^\\x20\\x09-\\x0D]'"), again).otherwise(F.col("text")).alias("text"))


_RUNS_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)),
                 lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS t),
     d AS (SELECT doc_id, row_number() OVER () AS row, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, tab),
     e AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a FROM d),
     f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
     t AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
                  ELSE ws END AS ws FROM f),
     w AS (SELECT row, unnest(range(n)) AS i, unnest(ws) AS word, n FROM t),
     pair AS (SELECT x.row, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.row = y.row AND x.word = y.word
              AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
     island AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS g FROM pair),
     stretch AS (SELECT row, q, min(i) AS s, count(*) + q AS length FROM island GROUP BY row, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
     r AS (SELECT row, s, length, min(q) AS q FROM stretch GROUP BY row, s, length),
     gone AS (SELECT DISTINCT row, unnest(range(s + q, s + length)) AS i FROM r),
     text AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (row, i) GROUP BY row),
     runs AS (SELECT row, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY row),
     ranked AS (SELECT * FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.row = x.row AND (y.length * x.q > x.length * y.q
                OR (y.length * x.q = x.length * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q))))))
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.length // b.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN runs USING (row) LEFT JOIN ranked b USING (row) LEFT JOIN text USING (row)"""


@_query("op13_periodic", _RUNS_SQL)
def op13(spark, sf):
    best = periodic.strongest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return periodic.collapse(repeated_tails(_table(spark, sf, "documents"))).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
