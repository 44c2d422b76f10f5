"""Queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, filter_audit, html_main, jaccard, line_dedup, lm_score, packing, quality, repeats, replay, tiff, token_output, toxicity

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_quality": quality.op2_quality,
    "op3_media_tiff": tiff.op3_media_tiff,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_line_templates": line_dedup.op6_line_templates,
    "op7_suffix_array": repeats.op7_suffix_array,
    "op8_html_main": html_main.op8_html_main,
    "op9_packing": packing.op9_packing,
    "op10_token_output": token_output.op10_token_output,
    "op11_undo_intervals": replay.op11_undo_intervals,
    "op12_attention_scores": lm_score.op12_attention_scores,
    "op13_filter_orders": filter_audit.op13_filter_orders,
}

ORACLE = {
    "op1_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e0 AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), cc AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT cc.a, e.b FROM cc JOIN e ON cc.b = e.a),
k AS (SELECT a, min(b) AS root FROM cc GROUP BY 1) SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id FROM s JOIN k ON k.a = s.doc_id""",
    "op13_filter_orders": r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, part, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
  (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x))::INT AS c, regexp_matches(x, '[#$%&*|]')::INT AS d, coalesce((w.doc_id > min(w.doc_id) OVER (PARTITION BY x))::INT, 0) AS e FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY ALL),
o AS (SELECT '' AS o, 0 AS used UNION ALL SELECT o || chr(65 + i::INT), used | (1 << i)::INT FROM o, range(5) r(i) WHERE used & (1 << i)::INT = 0),
s AS (SELECT o AS filter_order, k::INT AS step, ascii(substr(o, k::INT, 1)) - 65 AS bit, coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(substr(o, j::INT, 1)) - 65))), 0)::INT AS before FROM o, range(1, 6) q(k) WHERE length(o) = 5),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (before | (1 << bit)) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND (fails >> bit) & 1 = 1), 0) AS removed,
  coalesce(sum(n) FILTER (fails & before > 0 AND (fails >> bit) & 1 = 1), 0) AS redundant, coalesce(sum(n) FILTER (fails = 1 << bit), 0) AS unique_fails,
  coalesce(sum(g) FILTER (fails & before = 0 AND (fails >> bit) & 1 = 1), 0) AS good_lost, coalesce(sum(x) FILTER (fails & before = 0 AND (fails >> bit) & 1 = 1), 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
}
