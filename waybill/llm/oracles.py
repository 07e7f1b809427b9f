"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

import re

from .chat_format import CONTROLS

_WORDS = r"'[^\x20\x09-\x0D]+'"
_REST = "|".join(sorted((re.escape(c[1:]).replace("/", r"\/") for c in CONTROLS), key=len, reverse=True))

SQL: dict[str, str] = {
    "op2_chat_format": rf"""
    WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
    t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END alone, turn, coalesce(role, '') role, coalesce(text, '') text FROM c)
    SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) loss_sha256,
        (7 + sum(16 + length(role) + length(regexp_replace(text, '([<\[])(\\*(?:{_REST}))', '\1\\\2', 'g'))))::BIGINT formatted_chars
    FROM t GROUP BY conv_id, alone""",
    "op8_window_dedup": f"""
    WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) w FROM documents),
    win AS (SELECT doc_id, i, w[i:i + 12] k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM n)),
    least AS (SELECT k, min(doc_id) m FROM win GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, i + r j FROM (SELECT doc_id, i FROM win JOIN least USING (k) WHERE m < doc_id) CROSS JOIN range(13) t(r)),
    words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) j, unnest(w) word FROM n),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone.j IS NULL) kept, count(gone.j) n_removed FROM words LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_removed, 0)::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM n LEFT JOIN kept USING (doc_id)""",
    "op10_threshold_top_k": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) q FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
    SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT rank FROM s) WHERE rank <= 5""",
    # The exponent by forty halvings; the cut of a last pass by a running sum over its permutation.
    "op9_temperature_mixing": f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END k, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT tok FROM documents),
    s AS (SELECT k, sum(tok)::DOUBLE t FROM d GROUP BY 1), p AS (SELECT k, t, t / (SELECT sum(t) FROM s) x FROM s WHERE t > 0),
    r AS (SELECT count(*) n, max(t) / min(t) ratio, max(t) top, ln(count(*)) most, -sum(x * ln(x)) plain FROM p),
    b(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN h >= 0.96 * (SELECT most FROM r) THEN mid ELSE lo END, CASE WHEN h >= 0.96 * (SELECT most FROM r) THEN hi ELSE mid END
        FROM (SELECT any_value(i) i, any_value(lo) lo, any_value(hi) hi, mid, ln(sum(x ** mid)) - sum(x ** mid * mid * ln(x)) / sum(x ** mid) h FROM (SELECT i, lo, hi, (lo + hi) / 2 mid FROM b WHERE i < 40) CROSS JOIN p GROUP BY mid)),
    e AS (SELECT CASE WHEN n = 1 OR ratio = 1 THEN 1.0 ELSE greatest(CASE WHEN plain >= 0.96 * most THEN 1.0 ELSE (SELECT max(lo) FROM b) END, 1 - ln(4.0) / ln(ratio)) END t FROM r),
    w AS (SELECT s.k, s.t, CASE WHEN s.t > 0 THEN ((SELECT top FROM r) / s.t) ** (1 - (SELECT t FROM e)) ELSE 1.0 END reps FROM s),
    g AS (SELECT k, floor(reps)::BIGINT whole, CASE WHEN t > 0 THEN (reps - floor(reps)) * t ELSE 0 END part FROM w),
    a AS (SELECT d.*, whole, part, unnest(range(0, whole + 1)) block FROM d JOIN g USING (k)),
    o AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '7', k, block::VARCHAR, coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT place FROM a),
    u AS (SELECT *, sum(tok) OVER (PARTITION BY k, block ORDER BY place, doc_id) upto FROM o)
    SELECT source, block, place, doc_id, tok n_tokens FROM u WHERE block < whole OR (part > 0 AND upto <= part)""",
}
