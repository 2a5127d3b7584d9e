"""The queries of the general problems and their SQL."""

from __future__ import annotations

from taintgauge.operators import impute, malformed, orphans
from taintgauge.plans.book import QUERIES, query

_NUMBER = "(x IS NULL OR isnan(x) OR list_contains(list_transform(s.missing_markers, lambda m: try_cast(trim(m) AS DOUBLE)), x))"
_TEXT = r"(x IS NULL OR regexp_replace(x, '^\s+|\s+$', '', 'g') = '' OR list_contains(list_transform(s.missing_markers, lambda m: lower(trim(m))), lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))))"


def _missing(column: str, condition: str, numeric: bool) -> str:
    kind = "numeric_columns" if numeric else "categorical_columns"
    cast = "DOUBLE" if numeric else "VARCHAR"
    return f"SELECT DISTINCT record_id, '{column}' AS column_name FROM (SELECT record_id, table_id, CAST({column} AS {cast}) AS x FROM labelled_records) l JOIN dataset_spec s ON s.dataset_id = l.table_id WHERE list_contains(s.{kind}, '{column}') AND {condition}"


_P2 = " UNION ALL ".join(
    [_missing(c, _NUMBER, True) for c in ("age", "income", "duration_months", "balance_ratio", "temperature", "pressure")]
    + [_missing(c, _TEXT, False) for c in ("segment", "channel", "risk_band", "site_code")]
)

_P4 = """
SELECT 'bag_members' AS child_table, 'record_id' AS child_column, member_id AS child_id, added_at AS seen FROM bag_members m
WHERE record_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labelled_records l WHERE l.record_id = m.record_id AND l.source_type = m.source_type AND l.created_at <= m.added_at AND (l.deleted_at IS NULL OR l.deleted_at > m.added_at))
UNION ALL
SELECT 'bag_members', 'bag_id', member_id, added_at FROM bag_members m
WHERE bag_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bags b WHERE b.bag_id = m.bag_id AND b.created_at <= m.added_at AND (b.deleted_at IS NULL OR b.deleted_at > m.added_at))
UNION ALL
SELECT 'method_failure_audit', 'seed', audit_id, audited_at FROM method_failure_audit m
WHERE seed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run_seeds r WHERE r.seed = m.seed AND r.registered_at <= m.audited_at AND (r.retired_at IS NULL OR r.retired_at > m.audited_at))
"""

# The grammar as one pattern per data set: a field is quoted, with doubled quotes inside, or free of quotes and delimiters.
_Q = "coalesce('\\' || nullif(s.quote_char, ''), '\\x00')"
_FIELD = f"'(?:' || {_Q} || '(?:[^' || {_Q} || ']|' || {_Q} || {_Q} || ')*' || {_Q} || ' *|[^\\' || s.delimiter || {_Q} || ']*)'"
_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_P1 = f"""
WITH rec AS (SELECT line_id, r.dataset_id, raw_line, s.delimiter AS d, nullif(s.quote_char, '') AS q, s.target_column, list_transform(s.missing_markers, lambda m: lower({_TRIM.format(x='m')})) AS missing, {_FIELD} AS f
FROM raw_records r JOIN dataset_spec s USING (dataset_id) WHERE {_TRIM.format(x='raw_line')} <> '' AND NOT coalesce(starts_with(raw_line, nullif(s.comment_prefix, '')), FALSE)),
cut AS (SELECT *, regexp_full_match(raw_line, ' *' || f || '(?:\\' || d || ' *' || f || ')*') AS parses, regexp_extract_all(d || raw_line, '\\' || d || ' *(' || f || ')', 1) AS parts FROM rec),
many AS (SELECT dataset_id, count(*) AS n FROM dataset_columns GROUP BY 1),
one AS (SELECT line_id, dataset_id, missing, column_position, {_TRIM.format(x="CASE WHEN starts_with(p, q) THEN replace(substr(p, 2, length(p) - 2), q || q, q) ELSE p END")} AS x FROM (SELECT line_id, dataset_id, missing, q, generate_subscripts(parts, 1) - 1 AS column_position, trim(unnest(parts), ' ') AS p FROM cut JOIN many USING (dataset_id) WHERE parses AND len(parts) = n)),
val AS (SELECT line_id, missing, c.*, CASE WHEN column_role = 'target' THEN rtrim(x, '.') ELSE x END AS v FROM one JOIN dataset_columns c USING (dataset_id, column_position)),
bad AS (SELECT line_id FROM val WHERE NOT ({_TRIM.format(x='v')} = '' OR list_contains(missing, lower(v)) OR CASE WHEN column_role = 'numeric' THEN regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') AND coalesce(try_cast(v AS DOUBLE) >= coalesce(min_value, '-inf'::DOUBLE) AND try_cast(v AS DOUBLE) <= coalesce(max_value, 'inf'::DOUBLE) AND (value_type <> 'int' OR try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE))), FALSE) ELSE list_contains(levels, v) END))
"""
query(_P1 + "SELECT DISTINCT line_id FROM cut JOIN many USING (dataset_id) WHERE NOT parses OR len(parts) <> n UNION SELECT line_id FROM bad")(malformed.p1_found)
QUERIES["p1_records"] = malformed.p1_records
query(
    _P1 + ", c AS (SELECT line_id FROM cut JOIN many USING (dataset_id) WHERE NOT parses OR len(parts) <> n UNION SELECT line_id FROM bad), "
    "f AS (SELECT r.dataset_id, r.member_file, count(*) FILTER (WHERE c.line_id IS NULL) AS loaded, count(*) FILTER (WHERE c.line_id IS NOT NULL) AS rejected FROM raw_records r JOIN rec USING (line_id, dataset_id, raw_line) LEFT JOIN c USING (line_id) GROUP BY ALL), "
    "t AS (SELECT dataset_id, member_file, max(raw_rows) AS raw_rows FROM cleaning_report GROUP BY ALL) "
    "SELECT dataset_id, member_file, coalesce(loaded, 0) AS loaded, coalesce(rejected, 0) AS rejected, raw_rows, coalesce(loaded, 0) + coalesce(rejected, 0) = raw_rows AS matches FROM f FULL JOIN t USING (dataset_id, member_file)"
)(malformed.p1_balance)
query(_P2)(impute.p2_found)
QUERIES["p2_filled"] = impute.p2_filled
query("SELECT table_id, column_name, count(DISTINCT (record_id, created_at)) AS filled, 0::BIGINT AS invalid FROM (" + _P2.replace("SELECT DISTINCT record_id,", "SELECT record_id, created_at, table_id,").replace("SELECT record_id, table_id, CAST", "SELECT record_id, created_at, table_id, CAST") + ") GROUP BY ALL")(impute.p2_counts)
query(f"SELECT DISTINCT child_table, child_column, child_id FROM ({_P4})")(orphans.p4_found)
query(f"SELECT child_table, child_column, date_trunc('month', seen) AS month, count(DISTINCT child_id) AS orphans FROM ({_P4}) GROUP BY ALL")(orphans.p4_counts)
