"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gzframe.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.ngram_join import join_components

    return join_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents")).drop("spans")


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.vector_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gzframe.llm.token_files import read_token_files, write_token_files

    folder, _ = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, folder)


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.katz import score

    return score(_table(spark, sf_dir, "documents"), order=2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.decontamination import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gzframe.llm.mixing import Mix

    return Mix(_table(spark, sf_dir, "documents")).documents()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_toxicity, op3_license_scan, op4_vector_dedup, op5_token_files, op6_katz_backoff, op7_decontamination, op8_language_id, op9_pii_surrogates, op10_source_mixing)}


#: Lower-cases A-Z only, as the contracts say.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN_SQL = f"""WITH RECURSIVE
  w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  lists AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) END AS s FROM w),
  sizes AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM lists),
  posts AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM lists),
  links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM posts a JOIN posts b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY 1, 2
    HAVING 100 * count(*) >= 85 * (any_value((SELECT n FROM sizes WHERE doc_id = a.doc_id)) + any_value((SELECT n FROM sizes WHERE doc_id = b.doc_id)) - count(*))),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sizes"""


def _license_sql() -> str:
    from gzframe.llm.licenses import BAND, BASE, COVER, TEMPLATES, VOTES, K

    rows = [(i, t, label, t in BASE) for i, (t, label) in enumerate([*BASE.items(), *TEMPLATES.items()])]
    values = ", ".join(f"({i}, '{t}', '{label}', {str(base).lower()})" for i, t, label, base in rows)
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(K))
    return f"""WITH t AS (SELECT id, label, base, string_split(phrase, ' ') AS w FROM (VALUES {values}) v(id, phrase, label, base)),
  tg AS (SELECT id, label, base, len(w) - {K - 1} AS grams, i - 1 AS tpos, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM t)),
  d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  dg AS (SELECT doc_id, i - 1 AS pos, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM d)),
  hit AS MATERIALIZED (SELECT doc_id, id, label, base, grams, pos, tpos, pos - tpos AS diagonal FROM dg JOIN tg USING (g)),
  exact AS (SELECT doc_id, id, label, base, diagonal AS start, min(pos) AS first, max(pos) + {K - 1} AS last, CAST(1 AS DOUBLE) AS cover FROM hit WHERE base GROUP BY doc_id, id, label, base, diagonal, grams HAVING count(*) = grams),
  anchors AS (SELECT DISTINCT doc_id, id, diagonal AS anchor FROM hit WHERE NOT base),
  -- each template word under a matching position, once
  near AS (SELECT a.doc_id, a.id, a.anchor, h.label, h.grams, h.pos, h.tpos, unnest(range(h.tpos, h.tpos + {K})) AS word
    FROM anchors a JOIN hit h ON h.doc_id = a.doc_id AND h.id = a.id AND h.diagonal BETWEEN a.anchor AND a.anchor + {BAND}),
  close AS (SELECT doc_id, id, label, anchor, min(pos) AS first, max(pos) + {K - 1} AS last,
      CASE WHEN count(DISTINCT tpos) >= {VOTES} * grams THEN count(DISTINCT word) / (grams + {K - 1}) ELSE 0 END AS cover FROM near GROUP BY doc_id, id, label, anchor, grams),
  best AS (SELECT * FROM close x WHERE cover >= {COVER} AND NOT EXISTS (SELECT 1 FROM close y WHERE y.doc_id = x.doc_id AND y.id = x.id AND abs(y.anchor - x.anchor) <= {BAND}
      AND (y.cover > x.cover OR y.cover = x.cover AND y.anchor < x.anchor))),
  v AS (SELECT doc_id, id, label, base, start, first, last, cover FROM exact UNION ALL SELECT doc_id, id, label, false, anchor, first, last, cover FROM best),
  k AS (SELECT doc_id, label FROM v x WHERE base OR NOT EXISTS (SELECT 1 FROM v y WHERE y.doc_id = x.doc_id AND NOT y.base AND y.cover > x.cover AND y.first <= x.last AND x.first <= y.last)),
  a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, max(cover) AS score FROM v GROUP BY doc_id),
  l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)"""


VECTOR_SQL = """WITH RECURSIVE
  v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings),
  links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
  reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id,
  vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept
FROM v"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN_SQL, "op3_license_scan": _license_sql(), "op4_vector_dedup": VECTOR_SQL}
