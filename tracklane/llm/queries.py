"""Queries of this subpackage: thin digests of its operators over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cws, hmm, langid, maintext, media, mixing, packing, phrases, pii, quality, repair, simhash, urlfilter
from .common import fold

RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(table(spark, sf_dir, "pages"), RULES)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    out = quality.judged(table(spark, sf_dir, "documents"), labels, fold(labels.doc_id, 4) != 2)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "passages", "attention_peak")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identified(docs, fold(docs.doc_id, 3) != 1)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edit_study(table(spark, sf_dir, "documents"))


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = hmm.scored(docs, fold(docs.doc_id, 5) != 1)
    return out.withColumn("held_out", fold(F.col("doc_id"), 5) == 1)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_text(table(spark, sf_dir, "pages"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")), present="present")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_best_fit_packing, op3_quality, op4_media, op5_language_id, op6_weighted_sampling, op7_hidden_markov, op8_simhash, op9_source_mix, op10_personal_data, op11_main_text, op12_phrases, op13_conversation_repair)
}

SQL: dict[str, str] = {
    "op9_source_mix": r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS n,
    coalesce(length(translate(text, '!#$%&*|', '')), 0) AS kept,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (n - kept) / greatest(n, 1))) AS sort_key FROM s),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS most FROM a),
l AS (SELECT *, most / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM f) * weight, most)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
        sum(size) OVER (PARTITION BY k.source ORDER BY sort_key, doc_id ROWS UNBOUNDED PRECEDING) AS run
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN run <= budget OR (run - size < budget AND run - budget <= budget - (run - size)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
""",
    "op12_phrases": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
o AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS a FROM o GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
u AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.k, u.phrase, u.a, cut, l.a AS l, r.a AS r, ((2000000::HUGEINT * u.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:cut], ' ')
             JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, part, max(a) AS around FROM (
        SELECT lang, a, array_to_string(w[j:j + m - 1], ' ') AS part FROM (
          SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) GROUP BY 1, 2),
d AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.part = b.phrase WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, crc, CASE WHEN crc = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE crc WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS crc FROM conversations)),
e AS (SELECT conv_id, turn, role, text FROM d, (SELECT unnest([1, 2]) AS copy) WHERE crc != 0 AND (copy = 1 OR crc = 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM e),
r AS (SELECT *, left(role, 1) AS first, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS prior FROM f),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prior || first NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM r GROUP BY conv_id),
w AS (  -- costs of six digits before audits; a state without edits is null
  SELECT conv_id, 0::BIGINT AS i, '000000' AS s0, NULL::VARCHAR AS s1, '000003I' AS s2, '000006II' AS s3, '' AS l0, NULL::VARCHAR AS l1, 'user:' AS l2, 'user:' || chr(10) || 'assistant:' AS l3 FROM g
  UNION ALL
  SELECT conv_id, i, s0, s1, u[1:instr(u, chr(1)) - 1], v[1:instr(v, chr(1)) - 1], l0, l1, u[instr(u, chr(1)) + 1:], v[instr(v, chr(1)) + 1:] FROM (
    SELECT conv_id, i, s0, s1, l0, l1, u, least(n3, printf('%06d', u[1:6]::INT + 3) || u[7:instr(u, chr(1)) - 1] || 'I' || u[instr(u, chr(1)):] || chr(10) || 'assistant:') AS v FROM (
      SELECT *, least(n2, printf('%06d', s0[1:6]::INT + 3) || s0[7:] || 'I' || chr(1) || CASE WHEN l0 = '' THEN '' ELSE l0 || chr(10) END || 'user:',
          printf('%06d', s1[1:6]::INT + 3) || s1[7:] || 'I' || chr(1) || l1 || chr(10) || 'user:', printf('%06d', n3[1:6]::INT + 3) || n3[7:instr(n3, chr(1)) - 1] || 'I' || n3[instr(n3, chr(1)):] || chr(10) || 'user:') AS u FROM (
        SELECT w.conv_id, r.i, printf('%06d', s0[1:6]::INT + 4) || s0[7:] || 'D' AS s0, l0,
          p1[1:instr(p1, chr(1)) - 1] AS s1, p1[instr(p1, chr(1)) + 1:] AS l1,
          least(printf('%06d', s2[1:6]::INT + 4) || s2[7:] || 'D' || chr(1) || l2, CASE WHEN may THEN printf('%06d', b[1:6]::INT + t + CASE WHEN first = 'u' THEN 0 ELSE 3 END) || b[7:instr(b, chr(1)) - 1]
            || CASE WHEN first = 'u' THEN 'K' ELSE 'R' END || b[instr(b, chr(1)):] || CASE WHEN b[instr(b, chr(1)) + 1:] = '' THEN '' ELSE chr(10) END || CASE WHEN first = 'u' THEN role ELSE 'user' END || ':' || text END) AS n2,
          least(printf('%06d', s3[1:6]::INT + 4) || s3[7:] || 'D' || chr(1) || l3, CASE WHEN may THEN printf('%06d', s2[1:6]::INT + t + CASE WHEN first = 'a' THEN 0 ELSE 3 END) || s2[7:]
            || CASE WHEN first = 'a' THEN 'K' ELSE 'R' END || chr(1) || l2 || chr(10) || CASE WHEN first = 'a' THEN role ELSE 'assistant' END || ':' || text END) AS n3
        FROM w JOIN (SELECT *, fault NOT IN ('b', 'd') AS may, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t FROM r) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1,
          LATERAL (SELECT least(printf('%06d', s1[1:6]::INT + 4) || s1[7:] || 'D' || chr(1) || l1, CASE WHEN may AND first = 's' THEN printf('%06d', s0[1:6]::INT + t) || s0[7:] || 'K' || chr(1) || role || ':' || text END) AS p1,
            least(s0 || chr(1) || l0, s1 || chr(1) || l1, s3 || chr(1) || l3) AS b)))))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CASE WHEN w.i IS NULL THEN 0 ELSE least(s0 || chr(1), s3 || chr(1))[1:6]::BIGINT END AS cost, CASE WHEN w.i IS NULL THEN '' WHEN s3 IS NULL OR s0 || chr(1) < s3 || chr(1) THEN s0[7:] ELSE s3[7:] END AS audit,
  sha256(CASE WHEN w.i IS NULL THEN '' WHEN s3 IS NULL OR s0 || chr(1) < s3 || chr(1) THEN l0 ELSE l3 END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = g.last
""",
}
