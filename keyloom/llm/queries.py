"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_byte_bpe
from .chat import op6_chat_formatting
from .license_scan import op1_license_scan
from .ngram_join import op10_ngram_jaccard_join
from .packing import op3_best_fit_packing
from .quality import op8_quality_rules
from .simhash import op2_document_fingerprints
from .token_output import op4_token_output
from .toxicity import op5_toxicity
from .warc import op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_license_scan, op2_document_fingerprints, op3_best_fit_packing, op4_token_output, op5_toxicity, op6_chat_formatting, op7_warc, op8_quality_rules, op9_byte_bpe, op10_ngram_jaccard_join)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_SAID = "<|im_end|><|im_start|>assistant ok"
_WORD = r"[^\x20\x09-\x0D]+"

_SQL = {
    "op6_chat_formatting": rf"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
        f AS (SELECT *, 24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars FROM c),
        p AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars,
            count(*) FILTER (role = 'assistant') AS n_examples,
            CAST(coalesce(sum(before) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars
        FROM p GROUP BY conv_id""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_page FROM pages),
        d AS (SELECT *, sha1(html) AS h FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
        FROM d""",
    "op10_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
        e AS (SELECT doc_id, unnest(g) AS x FROM s),
        n AS (SELECT doc_id, len(g) AS n FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(v, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, c FROM r JOIN both_ways ON a = v)
        SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """Fingerprints, packing, codes, models, sketches and tokenizers aren't SQL; tests hold them against plain versions."""
    import corpus_pipeline

    return _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
