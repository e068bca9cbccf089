"""Registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradus.llm import audit, byte_bpe, dac, fill_middle, hamming, html_blocks, importance, jaccard, lm_score, packing, pii, secret_scan, topk

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids with offsets and back: counts, and digests of ids, bytes and offsets."""
    ids = byte_bpe.encode(_read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, RANKS, public_tokenizers.PATTERN, digests=True)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), WORDS)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of every document under the target's and the background's model."""
    return lm_score.cross_entropy_difference(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), stable=True)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    return topk.threshold_search(_read(spark, sf_dir, "embeddings"))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws."""
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(_read(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op8_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as directly addressable codes and read back."""
    return dac.stream(_read(spark, sf_dir, "documents"), WORDS)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by nine tenths of their three-word shingles."""
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op10_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found of every twentieth vector."""
    return hamming.hamming_search(_read(spark, sf_dir, "embeddings"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.scan(_read(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as prefix, suffix and middle, or plain, and the text rebuilt from it, as digests."""
    return fill_middle.transform(_read(spark, sf_dir, "documents"), digests=True)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and repeat in every order, for each source."""
    return audit.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_packing, op3_lm_score, op4_topk, op5_importance, op6_html, op7_secrets, op8_dac, op9_jaccard, op10_hamming, op11_pii, op12_fill_middle, op13_audit)}
ORACLES: dict[str, str] = {
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_fill_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, CASE WHEN text = '' THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS units FROM t),
        d AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
                     ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS s FROM u),
        f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain'
                             WHEN s < 80 THEN 'spm' ELSE 'psm' END AS form,
                     array_to_string(units[1 : least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') AS middle,
                     array_to_string(units[greatest(a, b) + 1 :], '') AS suffix FROM d)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM f""",
    "op13_audit": r"""
        WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, text,
                     min(d.doc_id) OVER (PARTITION BY text) AS least FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
        g AS (SELECT part, good, toxic, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
                     100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                     coalesce(doc_id > least, false) AS e FROM f),
        p AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS x, a::INT + b::INT + c::INT + d::INT + e::INT AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY ALL),
        k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        q AS (SELECT part, unnest([{'f': 'A', 'y': x.A}, {'f': 'B', 'y': x.B}, {'f': 'C', 'y': x.C}, {'f': 'D', 'y': x.D}, {'f': 'E', 'y': x.E}]) AS z, x, fails, n, good, toxic FROM p),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM k a JOIN k b ON b.f <> a.f JOIN k c ON c.f NOT IN (a.f, b.f) JOIN k d ON d.f NOT IN (a.f, b.f, c.f)
              JOIN k e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
        r AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
        s AS (SELECT filter_order, step, filter_order[step] AS f FROM r),
        w AS (SELECT q.part, s.filter_order, s.step, s.f, q.z.y AS fail, q.n, q.good, q.toxic, q.fails,
                     list_bool_or([CASE i WHEN 'A' THEN q.x.A WHEN 'B' THEN q.x.B WHEN 'C' THEN q.x.C WHEN 'D' THEN q.x.D ELSE q.x.E END FOR i IN string_split(filter_order[1 : step - 1], '') IF i <> '']) AS gone
              FROM s JOIN q ON q.z.f = s.f),
        v AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT coalesce(gone, false) AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept,
                     sum(CASE WHEN NOT coalesce(gone, false) AND fail THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::BIGINT AS redundant,
                     sum(CASE WHEN fail AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                     sum(CASE WHEN NOT coalesce(gone, false) AND fail THEN good ELSE 0 END)::BIGINT AS good_lost,
                     sum(CASE WHEN NOT coalesce(gone, false) AND fail THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM w GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM v""",
}
