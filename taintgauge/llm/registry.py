"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from taintgauge.llm import digests, encoding, packing, sampling, tokens
from taintgauge.plans.book import h

QUERIES = {
    "p3_found": sampling.p3_found,
    "p3_sample": sampling.p3_sample,
    "p3_report": sampling.p3_report,
    "p5_percentiles": digests.p5_percentiles,
    "p5_monthly": digests.p5_monthly,
    "p5_ranks": digests.p5_ranks,
    "p6_ids": tokens.p6_ids,
    "p6_round_trip": tokens.p6_round_trip,
    "p6_decoded": tokens.p6_decoded,
    "p7_containers": packing.p7_containers,
    "p7_tiers": packing.p7_tiers,
    "p7_fill": packing.p7_fill,
    "p7_audit": packing.p7_audit,
    "p8_found": encoding.p8_found,
    "p8_restored": encoding.p8_restored,
}

_TARGET = r"regexp_replace(regexp_replace(regexp_replace(target, '^\s+|\s+$', '', 'g'), '\.$', ''), '^\s+|\s+$', '', 'g')"

# The definition by sorting: ranks by hash, floors first, then the smallest priorities of each target.
_DRAW = f"""
WITH sp AS (SELECT summary_id, dataset_id, seed, sample_rows, coalesce(min_rows, 0) AS min_rows, unnest(map_entries(proportions)) AS p, target_distribution FROM split_summary),
st AS (SELECT summary_id, dataset_id, seed, sample_rows, min_rows, p.key AS split, p.value AS part, unnest(map_entries(target_distribution[p.key])) AS t FROM sp),
bg AS (SELECT DISTINCT bag_id, draw_size, coalesce(min_rows, 0) AS min_rows, true_proportion AS tp, floor(draw_size * true_proportion + 0.5) AS syn FROM bags JOIN quantification_bag_estimates USING (bag_id) WHERE true_proportion IS NOT NULL),
demand AS (
SELECT DISTINCT 'split_summary' AS target_table, summary_id AS target_key, 's|' || dataset_id || '|' || seed AS pool, split || '/' || t.key AS category, sample_rows AS size, part * t.value AS share, greatest(floor(sample_rows * part * t.value + 0.5), min_rows)::BIGINT AS needed, min_rows FROM st
UNION SELECT 'quantification_bag_estimates', bag_id, 'b|' || bag_id, 'synthetic', draw_size, tp, greatest(syn, min_rows)::BIGINT, min_rows FROM bg
UNION SELECT 'quantification_bag_estimates', bag_id, 'b|' || bag_id, 'real', draw_size, 1 - tp, greatest(draw_size - syn, min_rows)::BIGINT, min_rows FROM bg),
wanted AS (SELECT * FROM demand WHERE share > 0 AND size IS NOT NULL),
pool AS (
SELECT DISTINCT 's|' || dataset_id || '|' || seed AS pool, split || '/' || {_TARGET} AS category, row_id AS item FROM split_assignment WHERE row_id IS NOT NULL AND split IS NOT NULL AND target IS NOT NULL
UNION SELECT DISTINCT 'b|' || bag_id, source_type, record_id FROM bag_members WHERE bag_id IS NOT NULL AND source_type IS NOT NULL AND record_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pool, category ORDER BY {h(f"concat_ws('|', '{sampling.SEED}', pool, category, item)")}, item) AS rank FROM pool),
turns AS (SELECT w.*, item, rank, (rank - 0.5::DOUBLE) / share AS priority, row_number() OVER (PARTITION BY target_table, target_key, size ORDER BY rank <= min_rows DESC, (rank - 0.5::DOUBLE) / share, category) AS turn FROM wanted w JOIN ranked USING (pool, category)),
drawn AS (SELECT * FROM turns WHERE rank <= min_rows OR turn <= size)
"""

ORACLES: dict[str, str] = {
    "p3_found": f"""
WITH sp AS (SELECT summary_id, dataset_id, seed, sample_rows, coalesce(min_rows, 0) AS min_rows, unnest(map_entries(proportions)) AS p, target_distribution FROM split_summary),
st AS (SELECT summary_id, dataset_id, seed, sample_rows, min_rows, p.key AS split, p.value AS part, unnest(map_entries(target_distribution[p.key])) AS t FROM sp),
sn AS (SELECT DISTINCT summary_id, dataset_id, seed, split, t.key AS target, greatest(floor(sample_rows * part * t.value + 0.5), min_rows) AS needed FROM st WHERE part * t.value > 0 AND sample_rows IS NOT NULL),
sa AS (SELECT dataset_id, seed, split, {_TARGET} AS target, count(DISTINCT row_id) AS n FROM split_assignment WHERE target IS NOT NULL GROUP BY ALL),
b AS (SELECT DISTINCT bag_id, draw_size, coalesce(min_rows, 0) AS min_rows, true_proportion AS tp, floor(draw_size * true_proportion + 0.5) AS syn FROM bags JOIN quantification_bag_estimates USING (bag_id) WHERE true_proportion IS NOT NULL),
bn AS (SELECT bag_id, 'synthetic' AS category, greatest(syn, min_rows) AS needed FROM b WHERE tp > 0 UNION SELECT bag_id, 'real', greatest(draw_size - syn, min_rows) FROM b WHERE 1 - tp > 0),
ba AS (SELECT bag_id, source_type AS category, count(DISTINCT record_id) AS n FROM bag_members GROUP BY ALL)
SELECT DISTINCT 'split_summary' AS target_table, summary_id AS target_key, sn.split || '/' || sn.target AS category FROM sn LEFT JOIN sa USING (dataset_id, seed, split, target) WHERE coalesce(n, 0) < needed
UNION
SELECT DISTINCT 'quantification_bag_estimates', bag_id, category FROM bn LEFT JOIN ba USING (bag_id, category) WHERE coalesce(n, 0) < needed
""",
    "p3_sample": _DRAW + "SELECT target_table, target_key, category, item, rank, priority FROM drawn",
    "p3_report": _DRAW
    + """, held AS (SELECT pool, category, count(*) AS available FROM pool GROUP BY ALL), got AS (SELECT target_table, target_key, size, category, needed, count(*) AS seats FROM drawn GROUP BY ALL)
SELECT target_table, target_key, category, share, needed, coalesce(available, 0) AS available, coalesce(seats, 0) AS seats, greatest(0, needed - coalesce(available, 0)) AS short
FROM wanted LEFT JOIN held USING (pool, category) LEFT JOIN got USING (target_table, target_key, size, category, needed)""",
    "p5_ranks": """
WITH x AS (SELECT decomposition_id, any_value(detector) AS detector, any_value(quantifier) AS quantifier FROM finding_8_error_decomposition WHERE total_prevalence_error IS NOT NULL AND NOT isnan(total_prevalence_error) GROUP BY decomposition_id)
SELECT detector, quantifier, percentile::DOUBLE AS percentile, count(*) AS n, true AS within FROM x, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS p(percentile) GROUP BY ALL""",
    "p7_audit": "SELECT window_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS repeated, 0::BIGINT AS cut_needlessly, 0::BIGINT AS over_capacity, 0::BIGINT AS left_out FROM context_windows WHERE capacity_tokens > 0",
    "p6_round_trip": "SELECT doc_id FROM documents WHERE false",
    "p6_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS digest, coalesce(text, '') <> '' AS has_ids FROM documents",
}
