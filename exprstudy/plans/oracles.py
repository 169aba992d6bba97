"""The same results as plain SQL over the given tables, written independently of the Spark plans."""

from __future__ import annotations

from exprstudy.constants import CLASSICAL_MODELS, DEFAULT_SEED, GENE_BUDGETS, RNA_PLATFORM

K = 5
TOP = 20
LINE_PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)

# --- shared common table expressions --------------------------------------

SAMPLES = """
samples AS (
  SELECT vec_id AS cache_index, 'P' || lpad(vec_id::VARCHAR, 9, '0') AS pid, 'C' || label AS cls FROM embeddings
)"""


def holdout_of(source: str, out: str, seed: int = DEFAULT_SEED) -> str:
    return f"""
{out}_key AS (
  SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('{seed}:' || pid)) AS rk,
         count(*) OVER (PARTITION BY cls) AS n FROM {source}
),
{out}_share AS (
  SELECT cls, n, floor(n * 0.2::DOUBLE) AS base, n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE) AS rest
  FROM (SELECT DISTINCT cls, n FROM {out}_key)
),
{out}_quota AS (
  SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, cls)
                     <= ceil((sum(n) OVER ())::DOUBLE * 0.2::DOUBLE) - sum(base) OVER () THEN 1 ELSE 0 END AS quota
  FROM {out}_share
),
{out} AS (
  SELECT k.cache_index, k.pid, k.cls, CASE WHEN k.rk <= q.quota THEN 'holdout' ELSE 'development' END AS split
  FROM {out}_key k JOIN {out}_quota q USING (cls)
)"""


SPLIT = SAMPLES + "," + holdout_of("samples", "sp")


def folds_of(source: str, out: str, k: int = K, seed: int = DEFAULT_SEED) -> str:
    return f"""
{out}_key AS (
  SELECT cache_index, pid, cls, row_number() OVER (PARTITION BY cls ORDER BY md5('{seed}:' || pid)) - 1 AS r,
         count(*) OVER (PARTITION BY cls) AS n FROM {source}
),
{out}_class AS (
  SELECT cls, n, sum(n) OVER (ORDER BY cls) - n AS first FROM (SELECT DISTINCT cls, n FROM {out}_key)
),
{out}_slot AS (
  SELECT c.cls, i % {k} AS fold, count(*) AS size
  FROM {out}_class c, LATERAL (SELECT unnest(range(c.first::BIGINT, (c.first + c.n)::BIGINT)) AS i) s GROUP BY 1, 2
),
{out}_cut AS (
  SELECT cls, fold, size, sum(size) OVER (PARTITION BY cls ORDER BY fold) AS upto FROM {out}_slot
),
{out} AS (
  SELECT k.cache_index, k.pid, k.cls, c.fold::INT AS fold
  FROM {out}_key k JOIN {out}_cut c ON k.cls = c.cls AND k.r < c.upto AND k.r >= c.upto - c.size
)"""


DEV = SPLIT + ", dev AS (SELECT cache_index, pid, cls FROM sp WHERE split = 'development')"
FOLDED = DEV + "," + folds_of("dev", "fd")


def cells(missing: bool, value: str = "v") -> str:
    raw = "CASE WHEN (vec_id * 7 + pos) % 13 = 0 THEN NULL ELSE v END" if missing else "v"
    return f"""
raw AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings
),
cell AS (SELECT vec_id AS cache_index, 'C' || label AS cls, pos::INT AS gene, {raw} AS v FROM raw),
logged AS (
  SELECT cache_index, cls, gene,
         log2(((CASE WHEN {value} < 0 THEN 0::FLOAT ELSE {value} END) + 1::FLOAT)::DOUBLE)::FLOAT::DOUBLE AS x FROM cell
)"""


def training(missing: bool, value: str = "v") -> str:
    """Per experiment the imputed training values, their statistics and the ANOVA F."""
    return (
        FOLDED
        + ","
        + cells(missing, value)
        + f"""
, fcell AS (SELECT f.fold, f.cls, l.cache_index, l.gene, l.x FROM logged l JOIN fd f USING (cache_index)),
train AS (
  SELECT e.e::INT AS eval_fold, c.* FROM fcell c JOIN (SELECT unnest(range({K})) AS e) e ON c.fold <> e.e
),
med AS (
  SELECT eval_fold, gene, CASE WHEN gene IN (SELECT gene FROM fcell WHERE x IS NULL) THEN quantile_cont(x, 0.5) END AS median
  FROM train GROUP BY eval_fold, gene
),
filled AS (
  SELECT t.eval_fold, t.cls, t.gene, coalesce(t.x, m.median) AS x FROM train t JOIN med m USING (eval_fold, gene)
),
per_class AS (
  SELECT eval_fold, gene, cls, count(x) AS n, avg(x) AS mean, var_pop(x) * count(x) AS m2 FROM filled GROUP BY 1, 2, 3
),
stat AS (
  SELECT eval_fold, gene, avg(x) AS mean, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3
  FROM filled GROUP BY 1, 2
),
anova AS (
  SELECT p.eval_fold, p.gene,
         (sum(p.n * (p.mean - s.mean) * (p.mean - s.mean)) / (count(*) - 1)) / (sum(p.m2) / (sum(p.n) - count(*))) AS f
  FROM per_class p JOIN stat s USING (eval_fold, gene) GROUP BY 1, 2
),
best AS (
  SELECT eval_fold, gene, f, row_number() OVER (PARTITION BY eval_fold ORDER BY f DESC, gene DESC) AS rk
  FROM anova JOIN stat USING (eval_fold, gene) WHERE hi > lo
),
top AS (SELECT * FROM best WHERE rk <= {TOP})"""
    )


COEFFICIENTS = (
    training(False)
    + """
, coef AS (
  SELECT p.eval_fold AS fold, p.cls AS class, p.gene, p.mean - s.mean AS c
  FROM per_class p JOIN stat s USING (eval_fold, gene) JOIN top t USING (eval_fold, gene)
)"""
)

PREDICTIONS = """
pr AS (
  SELECT vec_id AS cache_index, 'P' || lpad(vec_id::VARCHAR, 9, '0') AS pid, (vec_id % 5)::INT AS fold,
         'C' || label AS t, 'C' || (list_position(embedding[1:10], list_max(embedding[1:10])) - 1) AS p,
         list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS e,
         embedding[1]::DOUBLE - embedding[2]::DOUBLE AS margin
  FROM embeddings
)"""


def prf(groups: str) -> str:
    """Per group and class: hits, support and calls."""
    g = groups + ", " if groups else ""
    return (
        PREDICTIONS
        + f"""
, side AS (
  SELECT {g}t AS class, 1 AS support, 0 AS called, (t = p)::INT AS hit FROM pr
  UNION ALL SELECT {g}p AS class, 0, 1, 0 FROM pr
),
pc AS (
  SELECT {g}class, sum(support)::BIGINT AS support, sum(called)::BIGINT AS called, sum(hit)::BIGINT AS hits,
         CASE WHEN sum(called) = 0 THEN 0 ELSE sum(hit) / sum(called)::DOUBLE END AS precision,
         CASE WHEN sum(support) = 0 THEN 0 ELSE sum(hit) / sum(support)::DOUBLE END AS recall,
         2 * sum(hit) / (sum(support) + sum(called))::DOUBLE AS f1
  FROM side GROUP BY {g}class
)"""
    )


def overall_of(groups: str) -> str:
    g = groups + ", " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""
SELECT {g}round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
       round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy,
       round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy, sum(support)::BIGINT AS n_samples,
       (sum(support) - sum(hits))::BIGINT AS n_errors FROM pc {by}"""


PART = "'TCGA-' || upper(substr(md5(o_custkey::VARCHAR), 1, 2)) || '-' || upper(substr(md5(o_custkey::VARCHAR), 3, 4))"
CODE = "CASE o_orderkey % 10 WHEN 0 THEN '11' WHEN 1 THEN '06' ELSE '01' END"
VIAL = "chr((65 + o_orderkey % 3)::INT)"
TAIL = "'-A' || lpad(o_orderkey::VARCHAR, 9, '0') || '-07'"
PORTION = "lpad((o_orderkey % 100)::VARCHAR, 2, '0')"
BARCODE = f"({PART}) || '-' || ({CODE}) || {VIAL} || '-' || {PORTION} || 'R' || {TAIL}"
KIND = "upper(substr(o_orderpriority, 3))"

ALIQUOTS = f"""
al AS (
  SELECT o_orderkey AS matrix_index, {BARCODE} AS barcode, {PART} AS participant, {CODE} AS code,
         {KIND} AS cls, o_orderstatus, o_totalprice FROM orders
),
cascade AS (
  SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'unmatched_quality'
                 WHEN o_totalprice > 400000 THEN 'do_not_use'
                 WHEN code <> '01' THEN 'non_primary'
                 WHEN cls NOT IN ('URGENT', 'HIGH', 'MEDIUM', 'LOW') THEN 'non_target_cancer' END AS reason
  FROM al
)"""

MESSY = f"""
messy AS (
  SELECT o_orderkey, CASE
    WHEN o_orderpriority = '5-LOW' THEN '  ' || lower({BARCODE}) || ' '
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN {PART}
    WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN substr({BARCODE}, 1, 7)
    WHEN o_orderstatus = 'P' THEN 'X' || {BARCODE}
    WHEN o_totalprice > 450000 THEN {PART} || '-0X-01R'
    ELSE {BARCODE} END AS text FROM orders
),
cleaned AS (SELECT o_orderkey, upper(trim(text)) AS raw FROM messy),
parts AS (
  SELECT *, string_split(raw, '-') AS f FROM cleaned
),
judged AS (
  SELECT *, array_to_string(f[1:3], '-') AS who,
    CASE WHEN len(f) < 3 THEN 'too_few_fields'
         WHEN NOT regexp_full_match(array_to_string(f[1:3], '-'), 'TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}') THEN 'bad_participant'
         WHEN len(f) > 3 AND NOT regexp_full_match(f[4], '[0-9]{{2}}[A-Z]?') THEN 'bad_sample_field' END AS error
  FROM parts
)"""

FOLD_METRICS = """
fm AS (
  SELECT event_type, json_extract_string(props, '$.k')::INT AS k, (event_id % 5)::INT AS fold,
         avg(value) AS value, sum(value) AS seconds FROM events GROUP BY 1, 2, 3
),
cand AS (
  SELECT event_type, k, avg(value) AS mean, stddev_pop(value) AS std, sum(seconds) AS seconds FROM fm GROUP BY 1, 2
),
listed AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'feature-budget:elastic_net:' || k
                 WHEN event_type = 'purchase' THEN 'xgboost:cpu:' || k ELSE 'classical:k' || k END AS candidate_id,
         CASE WHEN event_type = 'purchase' THEN 'purchase-' || k || '.json' ELSE event_type || '.json' END AS evidence_file
  FROM cand
)"""

WORDS = "CASE WHEN (vec_id * 7 + pos) % 13 = 0 THEN NULL ELSE v END"
WIDE = f"""
raw AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings),
wide AS (SELECT vec_id, label, pos::INT AS pos, {WORDS} AS v FROM raw),
melted AS (
  SELECT (pos - (pos + 1) // 4)::BIGINT AS cache_index, vec_id::INT AS gene_index, v::DOUBLE AS v FROM wide WHERE pos % 4 <> 3
)"""

DIGEST_OF = """
{name}_row AS (SELECT sha256({line}) AS h, count(*) AS n FROM {source} GROUP BY 1),
{name}_leaf AS (
  SELECT substr(h, 1, 6) AS b, sum(n) AS n, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS d
  FROM {name}_row GROUP BY 1
),
{name}_branch AS (
  SELECT substr(l.b, 1, 3) AS b, sum(n) AS n, sha256(string_agg(l.b || ':' || d, chr(10) ORDER BY l.b || ':' || d)) AS d
  FROM {name}_leaf l GROUP BY 1
),
{name} AS (
  SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b || ':' || d)) AS sha256 FROM {name}_branch
)"""

FEATURE_TEXT = "array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',')"
MATRIX_LINE = f"vec_id || chr(9) || {FEATURE_TEXT}"

AUC = (
    PREDICTIONS
    + """
, sc AS (SELECT t, unnest(range(10)) AS i, unnest(e) AS x, list_sum(e) AS total FROM pr),
oc AS (SELECT 'C' || i AS class, x / total AS s, t = 'C' || i AS pos FROM sc),
rk AS (
  SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2.0::DOUBLE AS r
  FROM oc
),
auc AS (
  SELECT class, (sum(CASE WHEN pos THEN r END) - count_if(pos) * (count_if(pos) + 1) / 2.0::DOUBLE)
                / (count_if(pos)::DOUBLE * count_if(NOT pos)) AS auc FROM rk GROUP BY class
)"""
)

AUDIT_VALUES = """
raw AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings),
cell AS (SELECT vec_id, pos, CASE WHEN (vec_id * 7 + pos) % 13 = 0 THEN NULL ELSE v::DOUBLE END AS v FROM raw)"""

AUDIT_QUANTILES = """
       round(quantile_cont(v, 0.0), 6) AS q0, round(quantile_cont(v, 0.01), 6) AS q01, round(quantile_cont(v, 0.25), 6) AS q25,
       round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.99), 6) AS q99,
       round(quantile_cont(v, 1.0), 6) AS q100"""


def counters_of(cells_sql: str, digits: int) -> str:
    return f"""
SELECT count(*) AS n_values, count(v) AS n_finite, count(*) - count(v) AS n_nonfinite,
       count_if(v < 0)::BIGINT AS n_negative, count_if(v = 0)::BIGINT AS n_zero,
       round(count_if(v < 0) / greatest(count(v), 1)::DOUBLE, {digits}) AS negative_fraction,
       round(count_if(v = 0) / greatest(count(v), 1)::DOUBLE, {digits}) AS zero_fraction,
       round(min(v), {digits}) AS minimum, round(max(v), {digits}) AS maximum FROM ({cells_sql})"""


LINE_CELLS = """
SELECT x::FLOAT::DOUBLE AS v FROM (
  SELECT unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem)"""

SPLIT_NAMES = "SELECT cache_index, pid AS participant_barcode, cls AS cancer_type, split FROM sp"


def pick(columns: str) -> str:
    return f"SELECT eval_fold, gene AS gene_index, {columns}"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources
    sql["header_barcodes"] = """
SELECT i::BIGINT AS matrix_index,
       'TCGA-AA-' || lpad(i::VARCHAR, 4, '0') || CASE WHEN i % 4 = 3 THEN '-11A' ELSE '-01A' END || '-01R-A001-07' AS barcode
FROM (SELECT unnest(range(max(len(embedding)))) AS i FROM embeddings)"""
    sql["header_checks"] = f"""
WITH {MESSY}
SELECT 'duplicate_barcode' AS "check", count(*) AS n_violations FROM (SELECT raw FROM judged GROUP BY raw HAVING count(*) > 1)
UNION ALL SELECT 'bad_barcode', count(*) FROM judged WHERE error IS NOT NULL"""
    sql["scan_stats"] = "SELECT max(len(embedding))::BIGINT AS n_samples, count(*) AS n_genes FROM embeddings"
    sql["melt_matrix"] = f"WITH {WIDE} SELECT cache_index, gene_index, round(v, 6) AS value FROM melted"
    sql["built_matrix"] = f"""
WITH {WIDE}
SELECT cache_index, 'TCGA-AA-' || lpad((cache_index + cache_index // 3)::VARCHAR, 4, '0') || '-01A-01R-A001-07' AS participant_barcode,
       'C' || cache_index % 3 AS cancer_type, count(*)::INT AS n_features, count_if(v IS NULL)::INT AS n_missing, round(coalesce(sum(v), 0), 3) AS total
FROM melted GROUP BY cache_index"""
    sql["matrix_blocks"] = f"""
WITH {WIDE},
ends AS (SELECT *, (gene_index // 256)::INT AS block,
                row_number() OVER (PARTITION BY cache_index, gene_index // 256 ORDER BY gene_index DESC) AS back FROM melted)
SELECT cache_index, block, count(*)::INT AS n_values, round(coalesce(sum(v), 0), 4) AS total,
       round(max(CASE WHEN back = 1 THEN v END), 6) AS last_value
FROM ends GROUP BY 1, 2"""
    sql["bad_rows"] = """
SELECT vec_id::INT AS gene_index,
       (len(embedding) + CASE label WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)::INT AS n_values,
       CASE label WHEN 2 THEN 1 ELSE 0 END::INT AS n_unreadable
FROM embeddings WHERE label IN (0, 1, 2)"""
    sql["gene_ids"] = """
SELECT vec_id::INT AS gene_index, 'SYM' || vec_id || '|' || (vec_id + 1000) AS source_gene_id,
       'SYM' || vec_id AS symbol, (vec_id + 1000)::VARCHAR AS entrez_id FROM embeddings"""
    sql["quality_scan"] = f"""
SELECT {BARCODE} AS aliquot_barcode, ({PART}) || '-' || ({CODE}) AS sample_barcode, {PART} AS participant_barcode,
       {KIND} AS cancer_type, CASE WHEN o_orderstatus = 'P' THEN 'OtherPlatform' ELSE '{RNA_PLATFORM}' END AS platform,
       o_totalprice > 400000 AS do_not_use FROM orders"""
    sql["manifest_checks"] = f"""
WITH p AS (SELECT o_orderkey AS i, {PART} AS w FROM orders)
SELECT 'empty' AS "check", (count(*) = 0)::BIGINT AS n_violations FROM p
UNION ALL SELECT 'duplicate_matrix_index', count(*) FROM (SELECT i FROM p GROUP BY i HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_participant', count(*) FROM (SELECT w FROM p GROUP BY w HAVING count(*) > 1)"""
    sql["split_domain_check"] = """
SELECT lang AS split, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang"""
    sql["gene_table_check"] = """
SELECT max(len(embedding))::BIGINT AS n_genes, true AS contiguous,
       min(len(embedding)) = max(len(embedding)) AS matches_matrix FROM embeddings"""
    sql["cache_metadata"] = f"""
WITH {AUDIT_VALUES}
SELECT count(DISTINCT vec_id) AS n_samples, (max(pos) + 1)::BIGINT AS n_genes, count_if(v IS NULL)::BIGINT AS n_nonfinite_values FROM cell"""

    # a tree of digests with 1024 entries a node, up to 1024 ** 3 lines
    sql["text_fingerprint"] = """
WITH line AS (SELECT l_orderkey, l_linenumber, concat_ws(chr(9), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS t FROM lineitem),
leaf AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, t) - 1 AS i, sha256(t) AS h, strlen(t) + 1 AS n FROM line),
one AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY leaf.i)) AS h, sum(n) AS n, count(*) AS m FROM leaf GROUP BY i // 1024),
two AS (SELECT i // 1024 AS i, CASE WHEN (SELECT count(*) FROM one) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY one.i)) END AS h,
               sum(n) AS n, sum(m) AS m FROM one GROUP BY i // 1024),
three AS (SELECT CASE WHEN (SELECT count(*) FROM two) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY two.i)) END AS h,
                 sum(n) AS n, sum(m) AS m FROM two)
SELECT coalesce(m, 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(h, sha256('')) AS sha256 FROM three"""

    # scalar expressions
    sql["barcode_parse"] = f"""
WITH {MESSY}
SELECT o_orderkey AS matrix_index, raw, CASE WHEN error IS NULL THEN who END AS participant,
       CASE WHEN error IS NULL AND len(f) > 3 THEN who || '-' || substr(f[4], 1, 2) END AS sample,
       CASE WHEN error IS NULL AND len(f) > 3 THEN substr(f[4], 1, 2) END AS sample_type_code,
       CASE WHEN error IS NULL AND len(f) > 3 AND len(f[4]) = 3 THEN substr(f[4], 3, 1) END AS vial,
       coalesce(error IS NULL AND len(f) > 3 AND substr(f[4], 1, 2) = '01', false) AS is_primary, error
FROM judged"""
    sql["barcode_compact"] = f"""
SELECT o_orderkey AS matrix_index,
       ({PART}) || '-' || ({CODE}) || {VIAL} || '-' || {PORTION} || CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'R' END || {TAIL} AS barcode
FROM orders"""
    sql["bool_parse"] = """
SELECT doc_id, CASE WHEN quality = 1 OR toxic = 1 THEN true WHEN doc_id % 2 = 0 THEN NULL ELSE false END AS flag FROM labels"""
    sql["gene_id_parse"] = """
SELECT p_partkey, CASE WHEN p_size < 10 THEN '?' WHEN p_size < 20 THEN trim(p_brand) ELSE trim(p_name) END AS symbol,
       CASE WHEN p_size < 10 THEN p_partkey::VARCHAR WHEN p_size < 20 THEN '' ELSE p_partkey || '|x' END AS entrez_id FROM part"""
    sql["numeric_parse"] = f"""
WITH {WIDE}, width AS (SELECT vec_id, len(embedding) AS w FROM embeddings),
cellwise AS (
  SELECT vec_id, label, pos, CASE WHEN label = 2 AND pos = w - 1 THEN 'junk' WHEN v IS NULL THEN 'missing' ELSE 'number' END AS state,
         CASE WHEN label = 2 AND pos = w - 1 THEN NULL ELSE v::DOUBLE END AS v
  FROM wide JOIN width USING (vec_id) WHERE NOT (label = 1 AND pos = w - 1)
  UNION ALL SELECT vec_id, label, 999, 'number', 1.5 FROM embeddings WHERE label = 0
)
SELECT vec_id::INT AS gene_index, state, count(*) AS n, round(sum(v), 4) AS total FROM cellwise GROUP BY 1, 2"""
    sql["log2p1_clip"] = f"WITH {cells(True)} SELECT cache_index, gene AS gene_index, round(x, 5) AS value FROM logged"
    sql["negative_policy_report"] = """
WITH raw AS (SELECT unnest(embedding) AS v FROM embeddings)
SELECT count_if(v < 0)::BIGINT AS n_negative, round(min(CASE WHEN v < 0 THEN v::DOUBLE END), 6) AS minimum_negative FROM raw"""
    sql["budget_parse"] = """
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'all' WHEN p_size IN (2, 3) THEN 'invalid' ELSE 'count' END AS kind,
       CASE WHEN p_size > 3 THEN p_size END AS k FROM part"""
    sql["error_flags"] = f"""
WITH {PREDICTIONS} SELECT cache_index, t AS true_label, p AS predicted_label, t = p AS correct,
       round(margin, 6) AS margin, round(abs(margin), 6) AS absolute_margin FROM pr"""
    sql["signed_margin"] = """
SELECT vec_id, round(CASE WHEN label < 4 THEN embedding[1]::DOUBLE - embedding[2]::DOUBLE
                          WHEN label < 8 THEN -embedding[1]::DOUBLE END, 6) AS margin FROM embeddings"""
    sql["coef_expand"] = """
WITH raw AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id AS fold, pos::INT AS gene_index, 'C0' AS class, round(-v, 6) AS coefficient FROM raw
UNION ALL SELECT vec_id, pos::INT, 'C1', round(v, 6) FROM raw"""

    # cohort
    sql["cohort_exclusions"] = f"""
WITH {ALIQUOTS},
reasons AS (SELECT unnest(['unmatched_quality', 'do_not_use', 'non_primary', 'non_target_cancer']) AS reason)
SELECT r.reason, count(c.reason) AS n FROM reasons r LEFT JOIN cascade c ON r.reason = c.reason GROUP BY r.reason
UNION ALL SELECT 'duplicate_participant', count(*) - count(DISTINCT participant) FROM cascade WHERE reason IS NULL"""
    sql["cohort_dedup"] = f"""
WITH {ALIQUOTS},
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY participant ORDER BY barcode, matrix_index) AS rn,
         count(*) OVER (PARTITION BY participant) AS choices FROM cascade WHERE reason IS NULL
)
SELECT matrix_index, barcode AS expression_barcode, participant || '-' || code AS sample_barcode,
       participant AS participant_barcode, code AS sample_type_code, cls AS cancer_type, choices,
       row_number() OVER (ORDER BY matrix_index) - 1 AS cache_index FROM chosen WHERE rn = 1"""
    sql["cohort_summary"] = f"""
WITH {ALIQUOTS}
SELECT count(*) AS n_expression_samples, count(DISTINCT CASE WHEN reason IS NULL THEN participant END) AS n_selected,
       count_if(reason = 'unmatched_quality')::BIGINT AS unmatched_quality, count_if(reason = 'do_not_use')::BIGINT AS do_not_use,
       count_if(reason = 'non_primary')::BIGINT AS non_primary, count_if(reason = 'non_target_cancer')::BIGINT AS non_target_cancer,
       count_if(reason IS NULL)::BIGINT - count(DISTINCT CASE WHEN reason IS NULL THEN participant END) AS duplicate_participant
FROM cascade"""
    sql["unmatched_samples"] = """
SELECT doc_id AS matrix_index, doc_id::VARCHAR AS barcode FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)"""
    sql["quality_conflicts"] = f"""
SELECT ({PART}) || '-01A' AS aliquot_barcode FROM orders WHERE o_orderstatus = 'P'
GROUP BY 1 HAVING count(DISTINCT {KIND} || (o_totalprice > 400000)::VARCHAR) > 1"""
    sql["manifest_header_mismatch"] = f"""
WITH h AS (SELECT o_orderkey AS i, {BARCODE} AS b FROM orders),
m AS (SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1 ELSE o_orderkey END AS i, {BARCODE} AS b FROM orders)
SELECT m.i AS matrix_index, m.b AS expression_barcode, h.b AS header_barcode,
       CASE WHEN h.b IS NULL THEN 'out_of_range' ELSE 'barcode_mismatch' END AS problem
FROM m LEFT JOIN h USING (i) WHERE h.b IS NULL OR h.b <> m.b"""

    # audit
    sql["audit_counters"] = f"WITH {AUDIT_VALUES} " + counters_of("SELECT v FROM cell", 6)
    sql["audit_counters_lines"] = counters_of(LINE_CELLS, 4)
    sql["audit_quantiles"] = f"WITH {AUDIT_VALUES} SELECT {AUDIT_QUANTILES}, true AS quantiles_exact FROM cell"
    sql["audit_profile"] = f"""
SELECT * FROM (SELECT count(*) AS n_rows, max(len(embedding))::INT AS n_columns FROM embeddings),
  ({sql["audit_counters"]}), ({sql["audit_quantiles"]})"""
    sql["audit_quantiles_strided"] = f"""
WITH {AUDIT_VALUES},
width AS (SELECT count(*) AS n, max(pos) + 1 AS g FROM cell),
stride AS (SELECT g, greatest(1, ceil(n / 10000.0))::BIGINT AS s FROM width)
SELECT {AUDIT_QUANTILES}, max(s) = 1 AS quantiles_exact FROM cell, stride WHERE (vec_id * g + pos) % s = 0"""

    # split
    sql["stratified_holdout"] = f"WITH {SPLIT} {SPLIT_NAMES}"
    sql["stratified_folds"] = f"""
WITH {FOLDED} SELECT cache_index, pid AS participant_barcode, cls AS cancer_type, fold FROM fd"""
    sql["split_refusals"] = """
SELECT 'repeated_participant' AS violation, o_custkey::VARCHAR AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL
SELECT 'repeated_index', (o_orderkey % 1000)::VARCHAR, count(*) FROM orders GROUP BY o_orderkey % 1000 HAVING count(*) > 1"""
    sql["stratified_holdout_orders"] = (
        "WITH ord AS (SELECT o_orderkey AS cache_index, o_orderkey::VARCHAR AS pid, o_orderpriority AS cls FROM orders),"
        + holdout_of("ord", "sp")
        + SPLIT_NAMES
    )
    sql["split_class_counts"] = f"""
WITH {SPLIT} SELECT cls AS cancer_type, count_if(split = 'development')::BIGINT AS development,
       count_if(split = 'holdout')::BIGINT AS holdout FROM sp GROUP BY 1"""
    sql["split_summary"] = f"""
WITH {SPLIT} SELECT count(*) AS n_samples, count_if(split = 'development')::BIGINT AS n_development,
       count_if(split = 'holdout')::BIGINT AS n_holdout FROM sp"""
    sql["split_overlap"] = f"""
WITH {SPLIT} SELECT count(*) AS n_overlap FROM
  (SELECT pid FROM sp WHERE split = 'development' INTERSECT SELECT pid FROM sp WHERE split = 'holdout')"""
    sql["class_set_diff"] = """
WITH s AS (SELECT o_orderpriority || '/' || year(o_orderdate) || '/' || month(o_orderdate) AS cls, o_orderstatus = 'P' AS h FROM orders)
SELECT cls AS cancer_type, CASE WHEN bool_or(h) THEN 'holdout' ELSE 'development' END AS only_in
FROM s GROUP BY 1 HAVING bool_or(h) <> bool_or(NOT h) OR (bool_and(h) OR bool_and(NOT h))"""
    sql["split_constraints"] = """
WITH m AS (SELECT doc_id AS i, source AS w, lang AS c,
                  CASE lang WHEN 'en' THEN 'development' WHEN 'fr' THEN 'holdout' ELSE 'unknown' END AS s FROM documents)
SELECT 'duplicate_cache_index' AS "check", count(*) AS n_violations FROM (SELECT i FROM m GROUP BY i HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_participant', count(*) FROM (SELECT w FROM m GROUP BY w HAVING count(*) > 1)
UNION ALL SELECT 'index_out_of_range', count(*) FROM m WHERE i NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'unknown_split', count(*) FROM m WHERE s = 'unknown'
UNION ALL SELECT 'class_on_one_side', count(*) FROM (
  SELECT c FROM m GROUP BY c HAVING (count_if(s = 'development') = 0) <> (count_if(s = 'holdout') = 0))
UNION ALL SELECT 'empty_side', (count_if(s = 'development') = 0)::BIGINT + (count_if(s = 'holdout') = 0)::BIGINT FROM m"""
    sql["development_matrix"] = f"""
WITH {DEV}, raw AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT cache_index, pid AS participant_barcode, cls AS cancer_type, count(*)::INT AS n_features, round(sum(v), 5) AS total
FROM dev JOIN raw ON vec_id = cache_index GROUP BY 1, 2, 3"""
    sql["pair_filter"] = f"""
WITH {DEV} SELECT cache_index, pid AS participant_barcode, cls AS cancer_type FROM dev WHERE cls IN ('C3', 'C9')"""

    # integrity
    line = "cache_index || chr(9) || pid || chr(9) || cls || chr(9) || split"
    sql["split_digest"] = f"WITH {SPLIT}, " + DIGEST_OF.format(name="d", line=line, source="sp") + " SELECT * FROM d"
    sql["matrix_digest"] = "WITH " + DIGEST_OF.format(name="d", line=MATRIX_LINE, source="embeddings") + " SELECT * FROM d"
    scaled = [f"round({c} * 100)::BIGINT" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    line = " || chr(9) || ".join([*keys, *scaled, "l_returnflag", "l_linestatus", "epoch(l_shipdate)::BIGINT"])
    sql["lines_digest"] = "WITH " + DIGEST_OF.format(name="d", line=line, source="lineitem") + " SELECT * FROM d"
    sql["lock_verify"] = (
        f"WITH {SPLIT}, "
        + holdout_of("samples", "other", DEFAULT_SEED + 1)
        + """
, same AS (SELECT count(*) AS differing FROM ((SELECT * FROM sp EXCEPT SELECT * FROM other) UNION ALL (SELECT * FROM other EXCEPT SELECT * FROM sp)))
SELECT 'matrix' AS artifact, 'match' AS status
UNION ALL SELECT 'split_manifest', CASE WHEN differing = 0 THEN 'match' ELSE 'digest_mismatch' END FROM same
UNION ALL SELECT 'gene_table', 'missing' UNION ALL SELECT 'documents', 'not_locked'"""
    )

    # preprocessing
    sql["class_weights"] = f"""
WITH {FOLDED}, g AS (SELECT fold, cls, count(*) AS n FROM fd GROUP BY 1, 2)
SELECT fold, cls AS cancer_type, n,
       round(sum(n) OVER (PARTITION BY fold)::DOUBLE / (count(*) OVER (PARTITION BY fold) * n), 6) AS weight FROM g"""
    sql["class_weights_lines"] = """
WITH g AS (SELECT l_returnflag AS cls, count(*) AS n FROM lineitem GROUP BY 1)
SELECT cls AS cancer_type, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 6) AS weight FROM g"""
    sql["prior_model"] = f"""
WITH {DEV}, g AS (SELECT cls, count(*) AS n FROM dev GROUP BY 1)
SELECT cls AS cancer_type, n, round(n / (sum(n) OVER ())::DOUBLE, 6) AS prior,
       row_number() OVER (ORDER BY n DESC, cls) = 1 AS majority FROM g"""
    sql["impute_median"] = f"WITH {training(True)} {pick('round(median, 6) AS median')} FROM med"
    sql["standardize_fold"] = f"""
WITH {training(True)} {pick('round(mean, 6) AS center, round(CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS scale')} FROM stat"""
    sql["robust_scale_fold"] = f"""
WITH {training(True)} {pick('round(q2, 6) AS center, round(CASE WHEN q3 > q1 THEN q3 - q1 ELSE 1 END, 6) AS scale')} FROM stat"""
    sql["variance_filter"] = f"""
WITH {training(False, '(CASE WHEN gene % 8 = 0 THEN -abs(v) ELSE v END)')} {pick('hi > lo AS eligible')} FROM stat"""
    sql["anova_f"] = f"WITH {training(False)} {pick('round(f, 6) AS f_score')} FROM anova"
    sql["anova_f_lines"] = f"""
WITH raw AS (SELECT l_returnflag AS cls, unnest(range(4)) AS gene,
                    unnest([l_quantity, l_extendedprice, l_discount, l_tax])::FLOAT AS v FROM lineitem),
x AS (SELECT cls, gene, log2((v + 1::FLOAT)::DOUBLE)::FLOAT::DOUBLE AS x FROM raw),
p AS (SELECT gene, cls, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS m2 FROM x GROUP BY 1, 2),
s AS (SELECT gene, avg(x) AS mean, stddev_pop(x) AS sd FROM x GROUP BY 1)
SELECT gene::INT AS gene_index, round(any_value(s.mean), 4) AS center, round(any_value(s.sd), 4) AS scale,
       round((sum(p.n * (p.mean - s.mean) * (p.mean - s.mean)) / (count(*) - 1)) / (sum(p.m2) / (sum(p.n) - count(*))), 4) AS f_score
FROM p JOIN s USING (gene) GROUP BY gene"""
    lines = ", ".join(f"round(quantile_cont(v, {p}), 6) AS q{round(100 * p)}" for p in LINE_PROBABILITIES)
    sql["lines_quantiles"] = f"""
WITH raw AS (SELECT (l_orderkey * 8 + l_linenumber) % 3 AS fold, unnest(range(4)) AS gene,
                    unnest([l_quantity, l_extendedprice, l_discount, l_tax])::FLOAT::DOUBLE AS v FROM lineitem)
SELECT e::INT AS eval_fold, gene::INT AS gene_index, {lines} FROM raw, range(3) f(e) WHERE fold <> e GROUP BY e, gene"""
    sql["select_k_best"] = f"WITH {training(False)} {pick('rk::INT AS rank, round(f, 6) AS f_score')} FROM top"
    sql["selected_matrix"] = f"""
WITH {training(False)}
SELECT t.eval_fold, c.cache_index, t.gene AS gene_index, round(c.v::DOUBLE, 6) AS value
FROM cell c JOIN fd USING (cache_index) JOIN top t USING (gene)"""
    sql["budget_features"] = f"""
WITH {training(True)},
z AS (
  SELECT t.eval_fold, c.cache_index, c.fold, (coalesce(c.x, m.median) - s.mean) / s.sd AS z
  FROM fcell c JOIN top t USING (gene) JOIN stat s USING (eval_fold, gene) JOIN med m USING (eval_fold, gene)
)
SELECT eval_fold, cache_index, CASE WHEN fold = eval_fold THEN 'test' ELSE 'train' END AS role, count(*)::INT AS n_features,
       round(sum(z), 4) AS total, round(sum(z * z), 4) AS square FROM z GROUP BY 1, 2, 3"""

    # evaluation
    sql["confusion_grid"] = f"""
WITH {PREDICTIONS}, l AS (SELECT t AS c FROM pr UNION SELECT p FROM pr),
n AS (SELECT t, p, count(*) AS n FROM pr GROUP BY 1, 2),
g AS (SELECT a.c AS t, b.c AS p, coalesce(n.n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN n ON n.t = a.c AND n.p = b.c)
SELECT t AS true_label, p AS predicted_label, n,
       round(CASE WHEN sum(n) OVER (PARTITION BY t) = 0 THEN 0 ELSE n / (sum(n) OVER (PARTITION BY t))::DOUBLE END, 6) AS row_fraction
FROM g"""
    sql["per_class_prf"] = f"""
WITH {prf('fold')} SELECT fold, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc"""
    sql["overall_metrics"] = f"WITH {prf('fold')} {overall_of('fold')}"
    sql["cv_metric_summary"] = f"""
WITH {prf('fold')}, o AS (
  SELECT fold, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
         avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, sum(hits) / sum(support)::DOUBLE AS accuracy
  FROM pc GROUP BY fold),
u AS (UNPIVOT o ON macro_f1, weighted_f1, balanced_accuracy, accuracy INTO NAME metric VALUE value)
SELECT 'softmax' AS model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       string_agg(printf('%.5f', value), ',' ORDER BY fold) AS fold_values FROM u GROUP BY metric"""
    sql["log_loss"] = f"""
WITH {PREDICTIONS} SELECT fold, round(avg(-ln(e[substr(t, 2)::INT + 1] / list_sum(e))), 6) AS multiclass_log_loss FROM pr GROUP BY fold"""
    sql["ovr_auc"] = f"WITH {AUC} SELECT class, round(auc, 6) AS auc FROM auc"
    sql["macro_auc"] = f"WITH {AUC} SELECT round(avg(auc), 6) AS ovr_roc_auc_macro, NULL::VARCHAR AS note FROM auc"
    sql["ranked_errors"] = f"""
WITH {PREDICTIONS} SELECT pid AS participant_barcode, t AS true_label, p AS predicted_label, round(abs(margin), 6) AS absolute_margin
FROM pr WHERE t <> p"""
    sql["error_pattern"] = f"""
WITH {PREDICTIONS} SELECT t AS true_label, p AS predicted_label, count(*) AS n,
       round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM pr WHERE t <> p GROUP BY 1, 2"""
    sql["oof_coverage"] = f"""
WITH {PREDICTIONS} SELECT CASE WHEN t = 'C9' THEN 'never' WHEN fold = 0 THEN 'repeated' ELSE 'once' END AS coverage, count(*) AS n
FROM pr GROUP BY 1"""

    # interpretation
    stability = """
per_fold AS (SELECT gene, fold, avg(abs(c)) AS s FROM coef GROUP BY 1, 2),
st AS (SELECT gene, count(*) AS folds, avg(s) AS s FROM per_fold GROUP BY 1)"""
    sql["feature_stability"] = f"""
WITH {COEFFICIENTS}, {stability}
SELECT gene AS gene_index, folds AS selected_folds, round(folds / 5.0::DOUBLE, 6) AS selection_frequency, round(s, 6) AS mean_abs_coefficient FROM st"""
    sql["stability_annotated"] = f"""
WITH {COEFFICIENTS}, {stability}
SELECT gene AS gene_index, folds AS selected_folds, round(folds / 5.0::DOUBLE, 6) AS selection_frequency,
       'G' || gene || '|' || (gene + 1000) AS source_gene_id, 'G' || gene AS symbol, (gene + 1000)::VARCHAR AS entrez_id FROM st"""
    sql["pair_gene_interpretation"] = f"""
WITH {COEFFICIENTS},
p AS (
  SELECT gene, count(*) FILTER (class = 'C9') AS folds, avg(c) FILTER (class = 'C3') AS a, avg(c) FILTER (class = 'C9') AS b,
         count(*) FILTER (class = 'C9' AND c > 0) AS up, count(*) FILTER (class = 'C9' AND c < 0) AS down
  FROM coef GROUP BY gene)
SELECT gene AS gene_index, folds AS selected_folds, round(folds / 5.0::DOUBLE, 6) AS selection_frequency,
       round(a, 6) AS mean_coefficient_a, round(b, 6) AS mean_coefficient_b, round((abs(a) + abs(b)) / 2, 6) AS mean_abs_coefficient,
       CASE WHEN b > 0 THEN 'C9' WHEN b < 0 THEN 'C3' ELSE 'neutral' END AS direction,
       round(CASE WHEN up + down = 0 THEN 0 ELSE greatest(up, down) / (up + down)::DOUBLE END, 6) AS sign_consistency FROM p"""
    sql["importance_aggregate"] = f"""
WITH {training(False)}
SELECT gene AS gene_index, count(*) AS selected_folds, round(count(*) / 5.0::DOUBLE, 6) AS selection_frequency,
       round(avg(f), 6) AS mean_gain_importance FROM top GROUP BY gene"""
    sql["stability_histogram"] = f"""
WITH {training(False)}, g AS (SELECT gene, count(*) AS k FROM top GROUP BY gene),
h AS (SELECT k, count(*) AS n FROM g GROUP BY k), s AS (SELECT unnest(range(1, 6)) AS k)
SELECT s.k AS selected_folds, coalesce(h.n, 0) AS n_genes,
       round(coalesce(h.n, 0) / (SELECT count(*) FROM g)::DOUBLE, 6) AS share_of_union FROM s LEFT JOIN h USING (k)"""

    # comparison
    sql["evidence_union"] = f"""
WITH {FOLD_METRICS}
SELECT candidate_id, CASE event_type WHEN 'error' THEN 'elastic_net' WHEN 'purchase' THEN 'boosted' ELSE 'k' || k END AS model,
       CASE WHEN event_type IN ('error', 'purchase') THEN k::VARCHAR END AS gene_budget, round(mean, 9) AS macro_f1_mean,
       round(std, 9) AS macro_f1_std, round(mean / 2, 9) AS balanced_accuracy_mean, round(seconds, 9) AS wall_seconds, evidence_file
FROM listed"""
    sql["evidence_gate"] = """
SELECT DISTINCT event_type || '.json' AS evidence_file,
       CASE event_type WHEN 'view' THEN 'not_development_only' ELSE 'holdout_used' END AS problem
FROM events WHERE event_type IN ('view', 'signup')"""
    sql["candidate_ranking"] = f"""
WITH {FOLD_METRICS}
SELECT row_number() OVER (ORDER BY mean DESC, candidate_id, event_type)::INT AS rank_by_macro_f1, candidate_id,
       round(mean, 9) AS macro_f1_mean FROM listed"""
    # values are added up as whole billionths and folds in their order, so no digit is left to chance
    sql["candidate_tradeoff"] = """
WITH whole AS (
  SELECT event_type, json_extract_string(props, '$.k')::INT AS k, (event_id % 5)::INT AS fold,
         sum(round(value * 1e9::DOUBLE)::HUGEINT)::HUGEINT::DOUBLE AS total, count(value) AS n FROM events GROUP BY 1, 2, 3
),
c AS (SELECT event_type || ':' || lpad(k::VARCHAR, 3, '0') AS id, fold, total / n / 1e9::DOUBLE AS value, total / 1e9::DOUBLE AS seconds FROM whole),
m AS (SELECT id, avg(value ORDER BY fold) AS mean, sum(seconds ORDER BY fold) AS wall FROM c GROUP BY id),
b AS (SELECT id, mean, wall FROM m ORDER BY mean DESC, id LIMIT 1),
l AS (SELECT fold, value FROM c WHERE id = (SELECT id FROM b))
SELECT c.id AS candidate_id, round(avg(c.value ORDER BY fold), 9) AS mean,
       round(avg(c.value ORDER BY fold) - avg(l.value ORDER BY fold), 9) AS gap_to_best,
       count_if(c.value > l.value)::BIGINT AS folds_won, round(any_value(m.wall) / (SELECT wall FROM b), 9) AS cost_ratio
FROM c JOIN l USING (fold) JOIN m USING (id) GROUP BY c.id"""
    sql["hardest_first"] = f"""
WITH {PREDICTIONS}, g AS (
  SELECT t || '_' || p AS pair, CASE WHEN t = p THEN 1.0 ELSE 0.0 END::DOUBLE AS macro_f1,
         sum((t <> p)::INT)::BIGINT AS n_errors FROM pr GROUP BY t, p)
SELECT pair, 'softmax' AS model, macro_f1, n_errors, row_number() OVER (ORDER BY macro_f1, pair)::INT AS position FROM g"""
    sql["run_speedup"] = """
WITH r AS (SELECT event_id AS run, CASE WHEN event_type = 'purchase' THEN 'cuda' ELSE 'cpu' END AS device,
                  CASE WHEN event_type = 'error' THEN 0 ELSE value END AS w FROM events),
b AS (SELECT w FROM r WHERE device = 'cpu' ORDER BY run LIMIT 1)
SELECT run, device, w AS wall_seconds, round(CASE WHEN w > 0 THEN (SELECT w FROM b) / w END, 4) AS speedup_vs_first_cpu FROM r"""

    # models: what every fitted model must deliver
    shape = f"""
WITH {FOLDED} SELECT fold, cls AS true_label, count(*) AS n_rows, count(DISTINCT cache_index) AS n_samples,
       count(*) AS n_known_labels, count(*) AS n_full_scores FROM fd GROUP BY 1, 2"""
    for name in ("logistic_l2", "elastic_net", "linear_svm", "pca_logistic", "boosted_trees"):
        sql[f"cv_{name}_shape"] = shape
    sql["cv_prior"] = f"""
WITH {FOLDED}, e AS (SELECT unnest(range(5))::INT AS fold),
tr AS (SELECT e.fold, f.cls, count(*) AS n FROM fd f JOIN e ON f.fold <> e.fold GROUP BY 1, 2),
maj AS (SELECT fold, cls AS p FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, cls) AS r FROM tr) WHERE r = 1),
pr AS (SELECT f.fold, f.cls AS t, m.p FROM fd f JOIN maj m USING (fold)),
side AS (SELECT fold, t AS class, 1 AS support, 0 AS called, (t = p)::INT AS hit FROM pr UNION ALL SELECT fold, p, 0, 1, 0 FROM pr),
pc AS (
  SELECT fold, class, sum(support)::BIGINT AS support, sum(hit)::BIGINT AS hits,
         CASE WHEN sum(support) = 0 THEN 0 ELSE sum(hit) / sum(support)::DOUBLE END AS recall,
         2 * sum(hit) / (sum(support) + sum(called))::DOUBLE AS f1 FROM side GROUP BY fold, class)
{overall_of('fold')}"""
    # every parameter of every fold (a weight for each usable gene and class, and the intercepts) is optimal
    for name in ("logistic_l2", "elastic_net", "linear_svm"):
        sql[f"cv_{name}_kkt"] = f"""
WITH {training(False)}, c AS (SELECT eval_fold, count(DISTINCT cls) AS n FROM per_class GROUP BY 1)
SELECT eval_fold AS fold, any_value(c.n) * (count(*) + 1) AS n_parameters, count(*) AS n_genes, 0::BIGINT AS n_not_optimal
FROM best JOIN c USING (eval_fold) GROUP BY 1"""
    # all margins are zero in the first round, so a row of weight w has g = w (1/k - hit) and h = 2 w (1/k) (1 - 1/k)
    sql["tree_first_splits"] = f"""
WITH {training(False)},
size AS (SELECT eval_fold, cls, count(DISTINCT cache_index) AS n FROM train GROUP BY 1, 2),
own AS (SELECT eval_fold, cls, sum(n) OVER e / (count(*) OVER e * n::DOUBLE) AS w FROM size WINDOW e AS (PARTITION BY eval_fold)),
k AS (SELECT count(DISTINCT cls)::DOUBLE AS k FROM fd),
val AS (SELECT t.eval_fold, t.gene, t.x, t.cls, sum(o.w) AS w FROM train t JOIN own o USING (eval_fold, cls) GROUP BY 1, 2, 3, 4),
every AS (SELECT eval_fold, gene, x, sum(w) AS w FROM val GROUP BY 1, 2, 3),
grid AS (SELECT y.*, c.cls FROM every y JOIN (SELECT DISTINCT cls FROM fd) c ON true),
running AS (
  SELECT g.eval_fold, g.cls, g.gene, g.x, sum(g.w) OVER up AS lw, sum(coalesce(v.w, 0)) OVER up AS lc,
         sum(g.w) OVER whole AS tw, sum(coalesce(v.w, 0)) OVER whole AS tc
  FROM grid g LEFT JOIN val v USING (eval_fold, gene, x, cls)
  WINDOW up AS (PARTITION BY g.eval_fold, g.cls, g.gene ORDER BY g.x), whole AS (PARTITION BY g.eval_fold, g.cls, g.gene)
),
sums AS (
  SELECT r.*, lw / k - lc AS gl, (tw - lw) / k - (tc - lc) AS gr, 2 * lw / k * (1 - 1 / k) AS hl, 2 * (tw - lw) / k * (1 - 1 / k) AS hr
  FROM running r, k
),
gains AS (
  SELECT *, gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1) AS gain FROM sums WHERE hl >= 1 AND hr >= 1
),
first AS (SELECT *, row_number() OVER (PARTITION BY eval_fold, cls ORDER BY round(gain, 9) DESC, gene, x) AS r FROM gains)
SELECT eval_fold AS fold, cls AS class, gene AS gene_index, round(x, 6) AS cut, round(gain, 6) AS gain,
       round(-0.05 * gl / (hl + 1), 6) AS left_score, round(-0.05 * gr / (hr + 1), 6) AS right_score
FROM first WHERE r = 1"""
    sql["cv_benchmark_shape"] = f"""
WITH {FOLDED}, m AS (SELECT unnest({list(CLASSICAL_MODELS)}) AS model),
q AS (SELECT unnest(['macro_f1', 'weighted_f1', 'balanced_accuracy', 'accuracy']) AS metric)
SELECT model, metric, count(DISTINCT fold) AS n_folds FROM fd, m, q GROUP BY 1, 2"""
    budgets = [(str(b), 1_000_000_000 if b == "all" else b) for b in GENE_BUDGETS]
    sql["budget_study_shape"] = f"""
WITH {training(False)},
b AS (SELECT unnest({[name for name, _ in budgets]}) AS budget, unnest({[most for _, most in budgets]}) AS most)
SELECT b.budget AS gene_budget, t.gene AS gene_index, 'G' || t.gene AS symbol, count(*) AS selected_folds
FROM best t JOIN b ON t.rk <= b.most GROUP BY 1, 2, 3"""
    pair = [("c3_c9", "pa", "'C3', 'C9'"), ("c1_c2", "pb", "'C1', 'C2'")]
    parts = ", ".join(f"{t} AS (SELECT * FROM dev WHERE cls IN ({names})), {folds_of(t, t + 'f')}" for _, t, names in pair)
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS pair, cache_index, pid AS participant_barcode, cls AS true_label, fold FROM {t}f" for name, t, _ in pair
    )
    sql["pair_study_shape"] = f"WITH {DEV}, {parts} {rows}"
    sql["final_reload_agrees"] = f"""
WITH {SPLIT} SELECT cls AS true_label, count(*) AS n_rows, 0::BIGINT AS n_differ FROM sp WHERE split = 'holdout' GROUP BY 1"""
    sql["final_trees_reload_agrees"] = sql["final_reload_agrees"]
    sql["final_holdout_metrics_shape"] = f"""
WITH {SPLIT} SELECT cache_index, pid AS participant_barcode, cls AS true_label FROM sp WHERE split = 'holdout'"""
    return sql
