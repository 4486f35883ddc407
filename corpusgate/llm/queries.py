"""One registered query per operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm import (byte_pairs, exact, importance, language, lines, lm, main_text, merkle,
                            mixing, near, token_counts, topk, warc)
from corpusgate.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.learnable(docs)))
    found = language.predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias(
        "held_out"), "lang_pred", "score", "accepted")


@query("op2_byte_pairs")
def op2(spark, sf_dir):
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"))


def asked(vec_id: Column) -> Column:
    """The stated query set: ids divisible by 100."""
    return F.pmod(vec_id, F.lit(100)) == 0


@query("op3_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, p.vec_id,
         list_inner_product(q.e, p.e)::BIGINT AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id AND len(q.e) = len(p.e)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
WHERE rank <= 10""")
def op3(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), asked)


@query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op5_line_dedup", f"""
WITH parts AS (
  SELECT doc_id, coalesce('=' || source, '') AS site,
         string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, site, unnest(l) AS line, unnest(range(len(l))) AS place FROM parts),
common AS (
  SELECT line FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY line HAVING count(DISTINCT site) >= {lines.MIN_SITES})
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE line IN (SELECT line FROM common)) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
              FILTER (WHERE line NOT IN (SELECT line FROM common)), '')) AS text_sha256
FROM lines GROUP BY doc_id""")
def op5(spark, sf_dir):
    cleaned = lines.clean_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed",
                          F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op6_near_dedup")
def op6(spark, sf_dir):
    return near.near_groups(table(spark, sf_dir, "documents"), width=2)


@query("op7_source_mix")
def op7(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op8(spark, sf_dir):
    return exact.dedup(*exact.split(table(spark, sf_dir, "documents")))


@query("op9_main_text")
def op9(spark, sf_dir):
    return main_text.main_text(table(spark, sf_dir, "pages"))


@query("op10_lm_scores")
def op10(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


# crc32 of an ASCII or hex-coded text, bit by bit: SQL has no such function.
def crc32_sql(hexed: str) -> str:
    """SQL of the unsigned crc32 of the bytes that the hex string `hexed` names."""
    nibble = f"(strpos('0123456789ABCDEF', substr({hexed}, i::INT, 1)) - 1)"
    bits = (f"flatten(list_transform(range(0, length({hexed}) // 2), lambda b: flatten("
            f"list_transform([2 * b + 2, 2 * b + 1], lambda i: list_transform([0, 1, 2, 3], "
            f"lambda k: (({nibble} >> k::INT) & 1)::BIGINT)))))")
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, x: "
            f"xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)")


_FIELD = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in (
    "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_LEAF.format(text="text")} AS leaf,
         CASE WHEN {crc32_sql("hex(encode(doc_id::VARCHAR))")} % 2 = 0
              THEN {_LEAF.format(text="replace(text, chr(10), '')")}
              ELSE {_LEAF.format(text="text")} END AS changed
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves),
tree AS (
  SELECT grp, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM numbered
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3
  FROM tree WHERE n > 1 GROUP BY grp, lvl, pos // 3),
tops AS (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos FROM tree WHERE n = 1),
above AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3
  FROM above WHERE n > 1 GROUP BY lvl, pos // 3),
sides AS (
  SELECT a.grp, a.lvl, a.pos,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM tree a JOIN tree b ON a.grp = b.grp AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.grp, a.lvl, a.pos),
over_sides AS (
  SELECT a.lvl, a.pos,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM above a JOIN above b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.lvl, a.pos),
way AS (
  SELECT doc_id, grp, leaf, 0 AS lvl, pos, changed AS h, '' AS proof, 0 AS part FROM numbered
  UNION ALL
  SELECT w.doc_id, w.grp, w.leaf, w.lvl + 1, w.pos // 3, sha256(s.l || w.h || s.r),
         w.proof || s.l || s.r, 0
  FROM way w JOIN sides s ON w.grp = s.grp AND w.lvl = s.lvl AND w.pos = s.pos),
half AS (
  SELECT w.doc_id, w.grp, w.leaf, w.h, w.proof, t.pos, t.subroot
  FROM way w JOIN tree x ON w.grp = x.grp AND w.lvl = x.lvl AND x.n = 1
  JOIN tops t ON t.grp = w.grp),
over_way AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, pos, h, proof FROM half
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.pos // 3, sha256(s.l || w.h || s.r),
         w.proof || s.l || s.r
  FROM over_way w JOIN over_sides s ON w.lvl = s.lvl AND w.pos = s.pos)
SELECT w.doc_id, w.leaf, w.subroot, x.h AS root, sha256(w.proof) AS proof_sha256,
       w.h AS folded_root, w.h = x.h AS verified
FROM over_way w JOIN above x ON x.n = 1 AND w.lvl = x.lvl""")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.coalesce(remainder("doc_id", 2) == 0, F.lit(False)),
                  F.expr("replace(text, '\\n', '')")).otherwise(F.col("text"))
    return merkle.tamper_check(docs, text)



@query("op11_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM g""")
def op11(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


@query("op12_importance_resampling", f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS f FROM documents),
dw AS (SELECT r, unnest(f) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
known AS (SELECT w, {crc32_sql("hex(encode(w))")} % 10000 AS bucket
          FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN known USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN known USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(
    (coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
mean AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM dw JOIN known USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(f) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' ||
           doc_id::VARCHAR), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN mean USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked""")
def op12(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
