"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.llm.conversation_repair import repaired_report
from purlin.llm.conversation_sql import CRC_TABLE, crc32, repair_sql
from purlin.llm.common import id_crc
from purlin.llm.exact_dedup import exact_dedup
from purlin.llm.html_extract import extract_main_text
from purlin.llm.language_id import identify_languages
from purlin.llm.license_scan import license_scan
from purlin.llm.lm_scoring import score_texts
from purlin.llm.minhash_dedup import near_duplicates
from purlin.llm.mixing import mix
from purlin.llm.packing import pack
from purlin.llm.quality_classifier import classify_quality
from purlin.llm.quality_rules import measures, quality_rules
from purlin.llm.spelling_variants import variants_of
from purlin.llm.toxicity import classify_toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file that the packing contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"), carry=["doc_id", "source", "lang"])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))[0]


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def llm_license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_license_scan that plain SQL can express."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def llm_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_quality_rules that plain SQL can express."""
    found = measures(_read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select(F.col("__id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_of(_read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_report(_read(spark, sf_dir, "conversations"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"), held_out=id_crc(F.col("id")) % 7 == 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_html_extract": op7_html_extract,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lm_scoring": op13_lm_scoring,
    "llm_license_base": llm_license_base,
    "llm_quality_counts": llm_quality_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               CAST(count(*) OVER same AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_spelling_variants": rf"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
        hashed AS (SELECT run, k, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run", latin=True)} AS h FROM runs, crc),
        words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        gaps AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
        added AS (SELECT DISTINCT g.word AS longer, g.n AS longer_n, w.word AS shorter, w.n AS shorter_n FROM gaps g JOIN words w ON g.less = w.word),
        pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.hole = b.hole AND a.word <> b.word UNION ALL SELECT longer, shorter, shorter_n FROM added UNION ALL SELECT shorter, longer, longer_n FROM added),
        near AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'best': other}}) AS top FROM pairs GROUP BY word),
        variants AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * n THEN top.best END AS form, CASE WHEN -top.less >= 10 * n THEN -top.less END AS form_n FROM words w LEFT JOIN near r ON w.word = r.word),
        followed AS (SELECT word, word AS root, 0 AS steps FROM variants UNION ALL SELECT f.word, v.form, steps + 1 FROM followed f JOIN variants v ON f.root = v.word WHERE v.form IS NOT NULL)
        SELECT v.word, form, r.root, n, n_near, form_n FROM variants v JOIN (SELECT word, arg_max(root, steps) AS root FROM followed GROUP BY word) r ON v.word = r.word
    """,
    "op12_conversation_repair": repair_sql(),
    "op13_lm_scoring": rf"""
        WITH {CRC_TABLE},
        split AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') || [' '] AS w FROM documents, crc),
        places AS (SELECT r, held_out, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS w2, CASE WHEN i > 2 THEN w[i - 2] WHEN i = 2 THEN '' END AS w1 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM split)),
        learned AS (SELECT * FROM places WHERE NOT held_out),
        total AS (SELECT count(*) AS n, count(DISTINCT w3) AS v FROM learned),
        one AS (SELECT w3, count(*) AS c FROM learned GROUP BY ALL),
        two AS (SELECT w2, w3, count(*) AS c FROM learned GROUP BY ALL),
        three AS (SELECT w1, w2, w3, count(*) AS c FROM learned WHERE w1 IS NOT NULL GROUP BY ALL),
        after_one AS (SELECT w2, sum(c) AS c FROM two GROUP BY ALL),
        after_two AS (SELECT w1, w2, sum(c) AS c FROM three GROUP BY ALL),
        p1 AS (SELECT p.*, n, v, coalesce(a.c, 0) AS c1, (coalesce(a.c, 0) + 1) / (n + v + 1) AS q FROM places p CROSS JOIN total LEFT JOIN one a USING (w3)),
        p2 AS (SELECT p.* REPLACE ((coalesce(b.c, 0) + 1000 * q) / (coalesce(h.c, 0) + 1000) AS q), q AS q1 FROM p1 p LEFT JOIN two b USING (w2, w3) LEFT JOIN after_one h USING (w2)),
        p3 AS (SELECT p.* REPLACE ((coalesce(t.c, 0) + 4 * q) / (coalesce(h.c, 0) + 4) AS q) FROM p2 p LEFT JOIN three t USING (w1, w2, w3) LEFT JOIN after_two h USING (w1, w2)),
        scored AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, any_value(n) AS train_tokens, sum(log10(q1)) AS base_score, sum(log10(q)) AS score FROM p3 GROUP BY r)
        SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM split JOIN scored USING (r)
    """,
    "llm_license_base": r"""
        WITH phrases(words, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
        split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        places AS (SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(words)] = words)) AS pos, label FROM split, phrases),
        found AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM split s LEFT JOIN found f ON s.doc_id = f.doc_id
    """,
    "llm_quality_counts": r"""
        WITH split AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        runs AS (SELECT doc_id, unnest(range(greatest(len(w) - 4, 0))) AS pos, w FROM split),
        marked AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w[pos + 1 : pos + 5]) AS n FROM runs),
        covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM marked, range(5) r(k) WHERE n > 1 GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM split),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        counts AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM split s LEFT JOIN dup d ON s.doc_id = d.doc_id LEFT JOIN covered c ON s.doc_id = c.doc_id)
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
    """,
}
