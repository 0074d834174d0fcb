"""DuckDB SQL twins of the registered queries, over the same whole tables."""

from __future__ import annotations

from .views import DRIFT_COLUMNS, NUMERIC, OVERLAP_COLUMNS

# --- derived tables --------------------------------------------------------------------------------

HASH = "('0x' || substr(md5({k}::VARCHAR), {p}, 8))::BIGINT"
SPLIT = f"CASE WHEN {HASH.format(k='o_orderkey', p=1)} % 5 = 0 THEN 'test' ELSE 'train' END"

VIEWS = {
    "orders_dirty": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority, c_name,
               CASE WHEN o_orderkey % 11 <> 0 THEN c_mktsegment END AS segment,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
               CASE WHEN NOT (o_totalprice > 400000 AND o_orderkey % 2 = 0) THEN o_totalprice END AS price_info,
               1::BIGINT AS const_col,
               CASE WHEN o_orderkey % 500 = 0 THEN 1 ELSE 0 END::BIGINT AS near_const,
               CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END::BIGINT AS y,
               (CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END * 10 + (o_orderkey % 10) / 1000.0::DOUBLE)::DOUBLE AS leak,
               o_totalprice * 2 + o_orderkey % 13 AS price_correlated,
               CASE WHEN o_totalprice > 420000 THEN 1 ELSE 0 END::BIGINT AS y_rare,
               CASE WHEN o_orderkey % 50 = 0 THEN 1000.0::DOUBLE ELSE (o_orderkey % 20)::DOUBLE END AS heavy
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "orders_dup": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0",
    "orders_split": f"SELECT *, {SPLIT} AS split FROM orders_dirty",
    "orders_drift": f"""
        SELECT o_orderkey, split,
               CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN split = 'test' THEN o_totalprice * 0.5::DOUBLE
                                                  ELSE o_totalprice END END AS half,
               CASE WHEN split = 'test' THEN o_totalprice * o_totalprice / 500000.0::DOUBLE ELSE o_totalprice END AS curved,
               o_totalprice AS same, 1::BIGINT AS flat,
               CASE WHEN split = 'test' THEN o_totalprice + 10000000.0::DOUBLE ELSE o_totalprice END AS away,
               o_orderkey % 10 AS digit
        FROM (SELECT *, {SPLIT} AS split FROM orders)""",
    "overlap_pair": f"""
        SELECT o_orderkey, {SPLIT} AS split, o_orderstatus,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority,
               o_orderkey % 500 = 0 AS near_const, floor(o_totalprice / 2000.0::DOUBLE)::BIGINT AS price_band,
               year(o_orderdate)::BIGINT AS year
        FROM orders""",
    "preds": """
        SELECT CASE WHEN l_discount >= 0.05::DOUBLE THEN 1 ELSE 0 END::BIGINT AS y_true,
               CASE WHEN l_tax >= 0.04::DOUBLE THEN 1 ELSE 0 END::BIGINT AS y_pred,
               l_discount * 10 AS p, l_returnflag AS flag,
               CASE WHEN l_linestatus = 'O' THEN l_returnflag WHEN l_returnflag = 'A' THEN 'N'
                    WHEN l_returnflag = 'N' THEN 'R' ELSE 'A' END AS flag_pred,
               l_extendedprice AS amount, l_quantity * 1000 AS amount_pred
        FROM lineitem""",
    "candidates": """
        SELECT run_id, (max(d) * 45 + 550) / 1000.0::DOUBLE AS train_score,
               ((sum(d)::BIGINT * 45) // count(*) + 500) / 1000.0::DOUBLE AS test_score,
               ((sum(t)::BIGINT * 50) // count(*) + 500) / 1000.0::DOUBLE AS cv_mean,
               (max(t) - min(t)) / 50.0::DOUBLE AS cv_std,
               count(*) FILTER (q > 45) AS n_critical_vif, count(*) FILTER (q BETWEEN 35 AND 45) AS n_high_vif,
               count(*) FILTER (d >= 6) AS n_severe_drift, count(*) FILTER (t = 8) AS n_critical,
               count(*) FILTER (t >= 2) AS n_high,
               ((sum(d)::BIGINT * 45) // count(*) + 500) / 1000.0::DOUBLE AS performance
        FROM (SELECT l_orderkey AS run_id, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t,
                     l_quantity::BIGINT AS q FROM lineitem)
        GROUP BY run_id""",
    "judged": """
        SELECT *, train_score - test_score > 0.15::DOUBLE AS overfit,
               train_score - test_score > 0.08::DOUBLE AND NOT train_score - test_score > 0.15::DOUBLE AS mild,
               CASE WHEN cv_mean <= 0 THEN true ELSE cv_std / (cv_mean + 1e-8::DOUBLE) > 0.10::DOUBLE END AS unstable,
               cv_mean - test_score > 0.10::DOUBLE AS decay
        FROM candidates""",
    "run_metrics": """
        SELECT run_id, 'train' AS split, name AS metric, train_score AS value FROM named
        UNION ALL SELECT run_id, 'holdout', name, test_score FROM named
        UNION ALL SELECT run_id, 'holdout', 'mae', cv_mean FROM named""",
    "named": """
        SELECT *, CASE run_id % 5 WHEN 0 THEN 'f1' WHEN 1 THEN 'accuracy' WHEN 2 THEN 'rmse' WHEN 3 THEN 'zeta'
                  ELSE 'r2' END AS name FROM candidates""",
    "issues_raw": """
        SELECT event_id AS issue_id, user_id AS run_id,
               CASE event_id % 7 WHEN 0 THEN 'Feature Drift' WHEN 1 THEN ' split-overlap ' WHEN 2 THEN 'missing/values'
                    WHEN 3 THEN 'multicollinearity' WHEN 4 THEN 'Target Leakage' WHEN 5 THEN NULL
                    ELSE 'high_cardinality' END AS type,
               CASE WHEN event_id % 13 <> 0 THEN 'col_' || (user_id % 40)::VARCHAR END AS "column",
               CASE event_id % 9 WHEN 0 THEN 'warn' WHEN 1 THEN 'SEVERE' WHEN 2 THEN 'danger' WHEN 3 THEN NULL
                    WHEN 4 THEN 'bogus' WHEN 5 THEN 'High' WHEN 6 THEN ' critical ' WHEN 7 THEN 'low'
                    ELSE 'info' END AS severity,
               CASE WHEN event_id % 4 <> 0 THEN event_type END AS description
        FROM events""",
    "issues_clean": """
        SELECT issue_id, run_id,
               replace(replace(replace(lower(trim(coalesce(type, 'unknown_issue'))), ' ', '_'), '-', '_'), '/', '_') AS type,
               coalesce("column", 'unknown') AS "column",
               CASE lower(trim(severity)) WHEN 'critical' THEN 'critical' WHEN 'severe' THEN 'critical'
                    WHEN 'danger' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'low' THEN 'low'
                    WHEN 'info' THEN 'info' ELSE 'medium' END AS severity,
               CASE lower(trim(severity)) WHEN 'critical' THEN 'critical' WHEN 'severe' THEN 'critical'
                    WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' WHEN 'info' THEN 'info' ELSE 'medium' END AS score_severity,
               coalesce(description, 'No description provided.') AS description
        FROM issues_raw""",
    "vif_rows": """
        SELECT l_quantity, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS l_extendedprice, l_discount
        FROM lineitem""",
    "one_hot_rows": """
        SELECT o_orderkey, split, segment,
               CASE WHEN split = 'test' AND o_orderkey % 3 = 0 THEN 'unseen' WHEN o_orderkey % 300 = 0 THEN 'rare_a'
                    WHEN o_orderkey % 301 = 0 THEN 'rare_b' ELSE o_orderstatus END AS status
        FROM orders_split""",
}

NEEDS = {
    "orders_split": ["orders_dirty"], "judged": ["candidates"], "named": ["candidates"],
    "run_metrics": ["named"], "issues_clean": ["issues_raw"], "one_hot_rows": ["orders_split"],
}

DIRTY_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "c_name", "segment", *NUMERIC]
DIRTY_TEXT = ["o_orderstatus", "o_orderpriority", "c_name", "segment"]


def sql(body: str, *views: str, **ctes: str) -> str:
    """A query with the derived tables it needs, in order, and then its own ones."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        need(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


ORACLES: dict[str, str] = {}

# --- sources ---------------------------------------------------------------------------------------

ORACLES["csv_scan"] = sql(f"""
    SELECT segment, count(*) AS n, count(price) AS n_price, {r6('avg(price)')} AS avg_price, sum(y)::BIGINT AS sum_y,
           max(o_orderkey) AS max_key, count(DISTINCT c_name) AS n_names FROM orders_dirty GROUP BY segment""",
                          "orders_dirty")
ORACLES["header_normalize"] = """SELECT o_orderkey, o_totalprice AS price, o_custkey AS price__duplicate_1,
    o_orderstatus AS price__duplicate_2 FROM orders"""
ORACLES["normalize_strings"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 2 THEN o_orderpriority END AS priority,
    o_orderstatus AS status, o_totalprice FROM orders"""
ORACLES["infer_types"] = sql(union([f"""
    SELECT '{c}' AS feature, CASE
        WHEN count({c}) = count(try_cast({c}::VARCHAR AS BIGINT)) FILTER (NOT contains({c}::VARCHAR, '.'))
             THEN CASE WHEN count({c}) = count(*) THEN 'bigint' ELSE 'double' END
        WHEN count({c}) = count(try_cast({c}::VARCHAR AS DOUBLE)) THEN 'double' ELSE 'string' END AS dtype
    FROM orders_dirty""" for c in DIRTY_COLUMNS]), "orders_dirty")
ORACLES["dev_sample"] = """SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey LIMIT 5000"""

# --- profile ---------------------------------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _missing(cols: list[str], view: str) -> str:
    return union([f"SELECT '{c}' AS feature, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_pct FROM {view}"
                  for c in cols])


def _duplicates(cols: list[str], view: str) -> str:
    keys = ", ".join(cols)
    return (f"SELECT coalesce(sum(cnt - 1), 0)::BIGINT AS total_duplicates, sum(cnt)::BIGINT AS n "
            f"FROM (SELECT count(*) AS cnt FROM {view} GROUP BY {keys})")


ORACLES["basic_info"] = sql(f"""
    SELECT 'num_rows' AS metric, count(*) AS value FROM orders_dup
    UNION ALL SELECT 'num_columns', 6 UNION ALL SELECT 'duplicate_rows', total_duplicates FROM dup
    UNION ALL SELECT 'missing_cells', ({' + '.join(f'(count(*) - count({c}))' for c in ORDER_COLUMNS)})::BIGINT
    FROM orders_dup""", "orders_dup", dup=_duplicates(ORDER_COLUMNS, "orders_dup"))
_KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}
ORACLES["feature_audit"] = sql("""
    SELECT *, row_number() OVER (ORDER BY missing_pct DESC, feature) AS position FROM rows_""", "orders_dirty",
    rows_=union([f"""SELECT '{c}' AS feature, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
        count(DISTINCT {c}) AS unique_values, {str(c not in DIRTY_TEXT).lower()} AS is_numeric,
        {str(c in DIRTY_TEXT).lower()} AS is_categorical,
        CASE any_value(typeof({c})) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items())} END AS dtype
        FROM orders_dirty""" for c in DIRTY_COLUMNS]))
ORACLES["preview"] = sql(f"SELECT {', '.join(DIRTY_COLUMNS).replace('leak', r6('leak') + ' AS leak')} "
                         "FROM orders_dirty ORDER BY o_orderkey LIMIT 5", "orders_dirty")

ORACLES["data_types"] = sql(union([f"""
    SELECT '{c}' AS feature, CASE any_value(typeof({c})) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items())} END AS dtype,
      '{'categorical' if c in DIRTY_TEXT else 'numeric'}' AS kind, count({c}) AS present FROM orders_dirty"""
    for c in DIRTY_COLUMNS]), "orders_dirty")

# --- checks ----------------------------------------------------------------------------------------

ORACLES["missing_values"] = sql(f"SELECT feature, {r6('missing_pct')} AS missing_pct FROM m WHERE missing_pct > 0",
                                "orders_dirty", m=_missing(DIRTY_COLUMNS, "orders_dirty"))
ORACLES["constant_features"] = sql(
    "SELECT feature, n = 0 AS all_missing FROM u WHERE n <= 1", "orders_dirty",
    u=union([f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n FROM orders_dirty" for c in DIRTY_COLUMNS]
            + ["SELECT 'void' AS feature, 0 AS n"]))


def _near_constant(cols: list[str], view: str) -> str:
    return union([f"""SELECT '{c}' AS feature, max(cnt)::DOUBLE / sum(cnt) AS top_share, count(*) AS n
        FROM (SELECT {c}, count(*) AS cnt FROM {view} WHERE {c} IS NOT NULL GROUP BY {c})""" for c in cols])


def _unique(cols: list[str], view: str) -> str:
    return union([f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique FROM {view}" for c in cols])


ORACLES["near_constant"] = sql(f"SELECT feature, {r6('top_share')} AS top_share FROM t WHERE n > 1 AND top_share > 0.99",
                               "orders_dirty", t=_near_constant(DIRTY_COLUMNS, "orders_dirty"))
ORACLES["high_cardinality"] = sql("SELECT * FROM u WHERE n_unique > 100", "orders_dirty",
                                  u=_unique(DIRTY_TEXT, "orders_dirty"))
ORACLES["high_cardinality_adv"] = sql("""
    SELECT feature, n_unique, CASE WHEN n_unique > 150 THEN 'high' ELSE 'medium' END AS severity FROM u
    WHERE n_unique > 50""", "orders_dirty",
    t="SELECT c_name, segment, 'k' || (o_orderkey % 100)::VARCHAR AS code FROM orders_dirty",
    u=_unique(["c_name", "segment", "code"], "t"))
ORACLES["duplicates"] = sql(f"""
    SELECT total_duplicates, {r6('total_duplicates * 100.0::DOUBLE / n')} AS duplicate_percentage,
           total_duplicates > 0 AS has_duplicates FROM dup""", "orders_dup",
    dup=_duplicates(ORDER_COLUMNS, "orders_dup"))


def _skew(cols: list[str], view: str) -> str:
    return union([f"SELECT '{c}' AS feature, skewness({c}) AS skew FROM {view} HAVING count(DISTINCT {c}) > 1"
                  for c in cols])


ORACLES["skewness"] = sql(f"SELECT feature, {r6('skew')} AS skew FROM s WHERE abs(skew) > 2", "orders_dirty",
                          s=_skew([c for c in NUMERIC if c != "y"], "orders_dirty"))


def _imbalance(target: str, view: str) -> str:
    return f"""SELECT min(cnt) * 100.0::DOUBLE / sum(cnt) AS pct, count(*) AS n
        FROM (SELECT {target}, count(*) AS cnt FROM {view} WHERE {target} IS NOT NULL GROUP BY {target})"""


ORACLES["class_imbalance"] = sql(f"SELECT {r6('pct')} AS minority_class_percentage, pct < 20 AS is_imbalanced, "
                                 "n AS num_classes FROM c", "orders_dirty", c=_imbalance("y_rare", "orders_dirty"))
ORACLES["class_distribution"] = sql(f"""
    SELECT segment AS class, count(*) AS cnt, {r6('count(*)::DOUBLE / (SELECT count(segment) FROM orders_dirty)')} AS share
    FROM orders_dirty WHERE segment IS NOT NULL GROUP BY segment""", "orders_dirty")


def _corr(cols: list[str], view: str) -> str:
    return union([f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM {view}
        HAVING count(DISTINCT {a}) > 1 AND count(DISTINCT {b}) > 1"""
                  for i, a in enumerate(cols) for b in cols[i + 1:]])


_HIGH_CORR = """SELECT 'price' AS feature_a, 'price_correlated' AS feature_b, 1.0::DOUBLE AS corr, 'name_suffix' AS rule
    UNION ALL SELECT feature_a, feature_b, abs(corr), 'pearson' FROM c WHERE abs(corr) >= 0.9 AND NOT isnan(corr)"""
ORACLES["high_correlation"] = sql(f"SELECT feature_a, feature_b, {r6('corr')} AS corr, rule FROM h", "orders_dirty",
                                  c=_corr([c for c in NUMERIC if c != "y"], "orders_dirty"), h=_HIGH_CORR)


def _leakage(target: str, view: str) -> str:
    return union([f"SELECT '{c}' AS feature, abs(corr({c}, {target})) AS corr FROM {view} HAVING count(DISTINCT {c}) > 1"
                  for c in NUMERIC if c != target])


ORACLES["target_leakage"] = sql(f"SELECT feature, {r6('corr')} AS corr FROM c WHERE corr > 0.95", "orders_dirty",
                                c=_leakage("y", "orders_dirty"))


def _iqr(cols: list[str], view: str) -> str:
    stats = union([f"""SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
        count(DISTINCT {c}) AS n FROM {view}""" for c in cols])
    rows = union([f"SELECT '{c}' AS feature, {c}::DOUBLE AS x FROM {view}" for c in cols])
    return f"""SELECT feature, q1::DOUBLE AS q1, q3::DOUBLE AS q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lower,
        q3 + 1.5::DOUBLE * (q3 - q1) AS upper,
        count(*) FILTER (x < q1 - 1.5::DOUBLE * (q3 - q1) OR x > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers
        FROM ({stats}) JOIN ({rows}) USING (feature) WHERE n > 2 AND q3 > q1 GROUP BY feature, q1, q3"""


_COMPLETE = f"SELECT * FROM orders_dirty WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUMERIC)}"
_IQR_OUT = (f"SELECT feature, {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('lower')} AS lower, {r6('upper')} AS upper, outliers "
            "FROM i WHERE outliers > 0")
ORACLES["iqr_outliers_wide"] = """
    WITH complete AS (SELECT * FROM orders WHERE o_orderkey % 12 NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11))
    SELECT 'c0' AS feature, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, outliers FROM (
      SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, count(*) AS outliers FROM complete) WHERE outliers > 0"""
ORACLES["iqr_outliers"] = sql(_IQR_OUT, "orders_dirty", complete=_COMPLETE,
                              i=_iqr([c for c in NUMERIC if c != "y"], "complete"))
ORACLES["iqr_outliers_lineitem"] = sql(
    _IQR_OUT, li="SELECT l_quantity, l_discount, l_extendedprice / (l_discount + 0.01::DOUBLE) AS ratio FROM lineitem",
    i=_iqr(["l_quantity", "l_discount", "ratio"], "li"))
ORACLES["outlier_contamination"] = sql(f"""
    SELECT count(*) AS complete_rows, {r6('least(0.05, greatest(0.01, 100.0::DOUBLE / count(*)))')} AS contamination
    FROM complete HAVING count(*) >= 50""", "orders_dirty", complete=_COMPLETE)

_BY_PCT = "CASE WHEN missing_pct > 50 THEN 'critical' WHEN missing_pct > 30 THEN 'high' WHEN missing_pct > 10 THEN 'medium' ELSE 'low' END"
_NO_KEY = [c for c in DIRTY_COLUMNS if c != "o_orderkey"]
ORACLES["issue_summary"] = sql(f"""
    SELECT type, "column", severity, {r6('metric')} AS metric FROM (
    SELECT 'missing_values' AS type, feature AS "column", {_BY_PCT} AS severity, missing_pct AS metric FROM m WHERE missing_pct > 0
    UNION ALL SELECT 'constant_feature', feature, 'high', 1.0 FROM u WHERE n_unique <= 1
    UNION ALL SELECT 'near_constant_feature', feature, 'medium', top_share FROM t WHERE n > 1 AND top_share > 0.99
    UNION ALL SELECT 'high_cardinality', feature, 'high', n_unique FROM u WHERE n_unique > 100 AND feature IN ({', '.join(repr(c) for c in DIRTY_TEXT)})
    UNION ALL SELECT 'high_skewness', feature, 'medium', skew FROM s WHERE abs(skew) > 2
    UNION ALL SELECT 'duplicate_rows', 'dataset_wide', CASE WHEN total_duplicates * 100.0 / n > 5 THEN 'high' ELSE 'medium' END,
        total_duplicates * 100.0::DOUBLE / n FROM d WHERE total_duplicates > 0
    UNION ALL SELECT 'class_imbalance', 'y_rare', CASE WHEN pct < 5 THEN 'critical' WHEN pct < 10 THEN 'high' ELSE 'medium' END, pct
        FROM b WHERE pct < 20
    UNION ALL SELECT 'high_correlation', feature_a || ' ↔ ' || feature_b, CASE WHEN corr > 0.95 THEN 'high' ELSE 'medium' END, corr FROM h
    UNION ALL SELECT 'target_leakage', feature, 'critical', corr FROM l WHERE corr > 0.95
    UNION ALL SELECT 'outliers', feature, CASE WHEN pct > 10 THEN 'high' WHEN pct > 5 THEN 'medium' ELSE 'low' END, pct
        FROM (SELECT feature, outliers * 100.0::DOUBLE / (SELECT count(*) FROM orders_dirty) AS pct FROM i
              WHERE outliers > 0 ORDER BY outliers DESC, feature LIMIT 5))""", "orders_dirty",
    complete=_COMPLETE, m=_missing(_NO_KEY, "orders_dirty"), u=_unique(_NO_KEY, "orders_dirty"),
    t=_near_constant(_NO_KEY, "orders_dirty"), s=_skew([c for c in NUMERIC if c != "y_rare"], "orders_dirty"),
    d=_duplicates(_NO_KEY, "orders_dirty"), b=_imbalance("y_rare", "orders_dirty"),
    c=_corr(NUMERIC, "orders_dirty"), h=_HIGH_CORR, l=_leakage("y_rare", "orders_dirty"),
    i=_iqr([c for c in NUMERIC if c != "y_rare"], "complete"))

# --- split, overlap, drift -------------------------------------------------------------------------

ORACLES["split_hash"] = f"SELECT o_orderkey, o_orderstatus, {SPLIT} AS split FROM orders"
ORACLES["split_stratified"] = sql("""
    SELECT o_orderkey, segment, CASE WHEN row_number() OVER (PARTITION BY segment ORDER BY md5(o_orderkey::VARCHAR), o_orderkey)
        <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY segment)) THEN 'test' ELSE 'train' END AS split
    FROM orders_dirty""", "orders_dirty")
ORACLES["stratify_rule"] = sql(union([
    f"""SELECT '{c}' AS target, (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::BIGINT AS n_classes,
    {str(c != 'leak').lower()} AND count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) < 20 AS stratify
    FROM orders_dirty""" for c in ("segment", "y_rare", "c_name", "leak")]), "orders_dirty")

_OVERLAP = f"""SELECT count(*) FILTER (EXISTS (SELECT 1 FROM overlap_pair a WHERE a.split = 'train' AND {' AND '.join(
    f'a.{c} IS NOT DISTINCT FROM b.{c}' for c in OVERLAP_COLUMNS)})) AS overlap_count, count(*) AS test_rows
    FROM overlap_pair b WHERE split = 'test'"""
_OVERLAP_PCT = "overlap_count * 100.0::DOUBLE / test_rows"
ORACLES["row_overlap"] = sql(f"SELECT overlap_count, test_rows, {r6(_OVERLAP_PCT)} AS overlap_pct FROM o",
                             "overlap_pair", o=_OVERLAP)
ORACLES["leakage_risk"] = sql(f"""
    SELECT CASE WHEN pct > 0.1 THEN 'row_overlap' END AS signal_id,
           CASE WHEN pct > 1 THEN 'critical' WHEN pct > 0.1 THEN 'high' END AS severity,
           {r6('pct')} AS row_overlap_pct, pct > 1 AS is_high_leakage_risk FROM (SELECT {_OVERLAP_PCT} AS pct FROM o)""",
    "overlap_pair", o=_OVERLAP)


def _bin(bins: int) -> str:
    return " + ".join(f"(x >= lo + {i} * step)::INT" for i in range(1, bins))


def _binned(bins: int, range_filter: str) -> dict[str, str]:
    """CTEs for smoothed shares per (feature, bin)."""
    return {
        "long": union([f"SELECT split, '{c}' AS feature, {c}::DOUBLE AS x FROM orders_drift WHERE {c} IS NOT NULL"
                       for c in DRIFT_COLUMNS]),
        "rng": f"""SELECT feature, CASE WHEN a = b THEN a - 0.5::DOUBLE ELSE a END AS lo,
            CASE WHEN a = b THEN b + 0.5::DOUBLE ELSE b END AS hi
            FROM (SELECT feature, min(x) AS a, max(x) AS b FROM long {range_filter} GROUP BY feature)""",
        "edges": f"SELECT *, (hi - lo) / {bins} AS step FROM rng",
        "counts": f"""SELECT feature, bin, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b
            FROM (SELECT feature, split, {_bin(bins)} AS bin FROM long JOIN edges USING (feature) WHERE x BETWEEN lo AND hi)
            GROUP BY feature, bin""",
        "shares": f"""SELECT feature, (coalesce(a, 0) + 1e-8::DOUBLE) / (sum(coalesce(a, 0)) OVER w + 1e-8::DOUBLE) AS p,
            (coalesce(b, 0) + 1e-8::DOUBLE) / (sum(coalesce(b, 0)) OVER w + 1e-8::DOUBLE) AS q
            FROM (SELECT feature, bin FROM edges CROSS JOIN (SELECT unnest(range({bins})) AS bin)) LEFT JOIN counts USING (feature, bin)
            WINDOW w AS (PARTITION BY feature)""",
    }


_PSI = {**_binned(10, "WHERE split = 'train'"),
        "psi": "SELECT feature, sum((p - q) * ln(p / q)) AS psi FROM shares GROUP BY feature",
        "psi_rows": """SELECT feature, round(psi, 4) AS psi_score,
            CASE WHEN psi >= 0.5 THEN 'HIGH' WHEN psi >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS drift_severity FROM psi"""}
ORACLES["psi"] = sql(f"""
    SELECT feature, {r6('psi')} AS psi, {r6("count(*) FILTER (x < lo OR x > hi) * 100.0::DOUBLE / count(*)")} AS out_of_range_pct
    FROM psi JOIN edges USING (feature) JOIN long USING (feature) WHERE split = 'test' GROUP BY feature, psi""",
    "orders_drift", **_PSI)
ORACLES["psi_table"] = sql("SELECT *, row_number() OVER (ORDER BY psi_score DESC, feature) AS rank FROM psi_rows",
                           "orders_drift", **_PSI)
ORACLES["drift_bands"] = sql("""
    SELECT band, string_agg(feature, ',' ORDER BY feature) AS features, count(*) AS n_features FROM (
        SELECT feature, CASE WHEN psi < 0.1 THEN 'low' WHEN psi < 0.25 THEN 'medium' WHEN psi < 0.5 THEN 'high'
                        ELSE 'critical' END AS band FROM psi) GROUP BY band""", "orders_drift", **_PSI)
ORACLES["drift_impact"] = sql("""
    SELECT n AS severe_features, CASE WHEN n > 5 THEN 'critical' WHEN n > 2 THEN 'high' ELSE 'medium' END AS severity,
      CASE WHEN n > 5 THEN 'Extensive distribution shift detected.' WHEN n > 2 THEN 'Significant feature drift detected.'
           ELSE 'Moderate drift detected.' END AS message,
      CASE WHEN n > 5 THEN 'Model trained on significantly different distribution.' WHEN n > 2 THEN 'Prediction quality may degrade.'
           ELSE 'Monitor feature stability in production.' END AS implication,
      CASE WHEN n > 5 THEN 'Hold deployment immediately.' WHEN n > 2 THEN 'Deploy only with enhanced monitoring.'
           ELSE 'Track PSI during inference.' END AS action
    FROM (SELECT count(*) FILTER (psi >= 0.25) AS n FROM psi)""", "orders_drift", **_PSI)
_RATIO = union([f"""SELECT '{c}' AS feature, var_pop({c}) FILTER (split = 'train') AS a, var_pop({c}) FILTER (split = 'test') AS b
    FROM orders_drift""" for c in DRIFT_COLUMNS])
_RATIO2 = """SELECT feature, ratio, CASE WHEN ratio > 10 THEN 'critical' WHEN ratio > 3 THEN 'high' END AS severity
    FROM (SELECT feature, greatest(a, b) / (least(a, b) + 1e-8::DOUBLE) AS ratio FROM v)"""
ORACLES["variance_ratio"] = sql(f"SELECT feature, {r6('ratio')} AS ratio, severity FROM r", "orders_drift",
                                v=_RATIO, r=_RATIO2)
ORACLES["feature_stability"] = sql(f"""
    SELECT feature, {r6('kl')} AS kl_divergence, {r6('exp(-kl)')} AS stability_score,
           row_number() OVER (ORDER BY exp(-kl) DESC, feature) AS rank
    FROM (SELECT feature, (sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2 AS kl FROM shares GROUP BY feature)""",
    "orders_drift", **_binned(30, ""))
_MISSINGNESS = union([f"""SELECT '{c}' AS feature, abs(avg(y) FILTER ({c} IS NULL) - avg(y) FILTER ({c} IS NOT NULL)) AS delta
    FROM orders_dirty""" for c in DIRTY_COLUMNS if c != "y"])
ORACLES["informative_missingness"] = sql(f"""
    SELECT feature, {r6('delta')} AS delta, CASE WHEN delta > 0.3 THEN 'high' ELSE 'medium' END AS severity
    FROM g WHERE delta > 0.15""", "orders_dirty", g=_MISSINGNESS)

_VIF = {
    "f": """SELECT l_quantity AS a, coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM vif_rows)) AS b,
        l_discount AS c FROM vif_rows""",
    "g": "SELECT sum(a*a) aa, sum(b*b) bb, sum(c*c) cc, sum(a*b) ab, sum(a*c) ac, sum(b*c) bc FROM f",
    "k": "SELECT *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) AS det FROM g",
    "vifs": """SELECT 'l_quantity' AS feature, round(aa*(bb*cc - bc*bc)/det, 4) AS vif FROM k
        UNION ALL SELECT 'l_extendedprice', round(bb*(aa*cc - ac*ac)/det, 4) FROM k
        UNION ALL SELECT 'l_discount', round(cc*(aa*bb - ab*ab)/det, 4) FROM k""",
}
ORACLES["vif"] = sql("SELECT * FROM vifs", "vif_rows", **_VIF)
ORACLES["vif_table"] = sql("""SELECT *, row_number() OVER (ORDER BY vif_score DESC, feature) AS rank
    FROM (SELECT feature, round(vif, 2) AS vif_score FROM vifs WHERE vif > 2)""", "vif_rows", **_VIF)
ORACLES["vif_bands"] = sql("""
    SELECT band, string_agg(feature, ',' ORDER BY feature) AS features, count(*) AS n_features FROM (
        SELECT feature, CASE WHEN vif > 10 THEN 'critical' WHEN vif > 5 THEN 'high' ELSE 'moderate' END AS band
        FROM vifs WHERE vif > 2) GROUP BY band""", "vif_rows", **_VIF)
ORACLES["integrity_issues"] = sql(f"""
    SELECT type, "column", severity, {r6('metric')} AS metric FROM (
    SELECT 'informative_missingness' AS type, feature AS "column", CASE WHEN delta > 0.3 THEN 'high' ELSE 'medium' END AS severity,
           delta AS metric FROM miss WHERE delta > 0.15
    UNION ALL SELECT 'variance_instability', feature, severity, ratio FROM r WHERE severity IS NOT NULL
    UNION ALL SELECT 'split_overlap', 'dataset_wide', CASE WHEN pct > 5 THEN 'critical' ELSE 'high' END, pct
        FROM (SELECT {_OVERLAP_PCT} AS pct FROM o) WHERE pct > 0
    UNION ALL SELECT 'feature_drift', feature, lower(drift_severity), psi_score FROM psi_rows WHERE drift_severity <> 'LOW'
    UNION ALL SELECT 'multicollinearity', feature, CASE WHEN vif > 10 THEN 'critical' ELSE 'high' END, vif FROM vifs WHERE vif > 5)""",
    "overlap_pair", "orders_drift", "orders_dirty", "vif_rows", o=_OVERLAP, **_PSI, **_VIF, v=_RATIO, r=_RATIO2,
    miss=_MISSINGNESS)

# --- preparation -----------------------------------------------------------------------------------


def _mode(c: str, view: str, where: str = "true") -> str:
    return (f"(SELECT {c} FROM {view} WHERE {c} IS NOT NULL AND {where} GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


ORACLES["impute"] = sql(f"""
    SELECT o_orderkey, coalesce(segment, {_mode('segment', 'orders_dirty')}) AS segment,
      {r6('coalesce(price, (SELECT median(price) FROM orders_dirty))')} AS price,
      {r6('coalesce(price_info, (SELECT median(price_info) FROM orders_dirty))')} AS price_info, 'missing' AS void
    FROM orders_dirty""", "orders_dirty")
_TRAIN = "split = 'train'"
ORACLES["impute_train_fit"] = sql(f"""
    SELECT o_orderkey, split, coalesce(segment, {_mode('segment', 'orders_split', _TRAIN)}) AS segment,
      {r6(f'coalesce(price, (SELECT median(price) FROM orders_split WHERE {_TRAIN}))')} AS price,
      {r6(f'coalesce(price_info, (SELECT median(price_info) FROM orders_split WHERE {_TRAIN}))')} AS price_info
    FROM orders_split""", "orders_split")
ORACLES["missing_indicator"] = sql("""
    SELECT o_orderkey, (price IS NULL)::INT AS price__missing_indicator,
           (price_info IS NULL)::INT AS price_info__missing_indicator FROM orders_split""", "orders_split")
ORACLES["robust_scale"] = sql(f"""
    SELECT o_orderkey, split, {', '.join(r6(f'({c} - {c}_m) / CASE WHEN {c}_h = {c}_l THEN 1 ELSE {c}_h - {c}_l END') + f' AS {c}'
                                         for c in ('price', 'heavy', 'near_const'))}
    FROM orders_split CROSS JOIN s""", "orders_split",
    s="SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_l, quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_h"
                            for c in ("price", "heavy", "near_const")) + f" FROM orders_split WHERE {_TRAIN}")
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _flags(c: str, values: list[str]) -> str:
    return ", ".join(f"coalesce(({c} = '{v}')::INT, 0) AS \"{c}_{v}\"" for v in values)


ORACLES["one_hot"] = sql(f"""SELECT o_orderkey, split, {_flags('segment', _SEGMENTS)},
    {_flags('status', ['F', 'O', 'P', 'rare_a', 'rare_b'])} FROM one_hot_rows""", "one_hot_rows")
ORACLES["one_hot_min_freq"] = sql(f"""SELECT o_orderkey, split, {_flags('segment', _SEGMENTS)},
    {_flags('status', ['F', 'O', 'P'])}, (status IN ('rare_a', 'rare_b'))::INT AS status_infrequent_sklearn
    FROM one_hot_rows""", "one_hot_rows")

ORACLES["one_hot_long"] = sql(union([f"""
    SELECT o_orderkey AS key, '{c}_' || {c} AS feature, index FROM orders_split JOIN (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS index
      FROM (SELECT DISTINCT {c} FROM orders_split WHERE {_TRAIN} AND {c} IS NOT NULL)) USING ({c})"""
    for c in ("c_name", "segment", "o_orderstatus")]), "orders_split")

_PREP_NUMERIC = sorted(set(NUMERIC) - {"y_rare"})
_PREP_TEXT = ["c_name", "o_orderpriority", "o_orderstatus", "segment"]
# Filled train values with their share: those of a hundredth of the rows are features of their own.
_SHARES = {c: f"""SELECT v, count(*) >= 0.01 * (SELECT count(*) FROM orders_split WHERE {_TRAIN}) AS own
    FROM (SELECT coalesce({c}, {_mode(c, 'orders_split', _TRAIN)}) AS v FROM orders_split WHERE {_TRAIN}) GROUP BY v""" for c in _PREP_TEXT}
ORACLES["feature_names"] = sql("""
    SELECT row_number() OVER (ORDER BY part, origin, late, feature) AS position, feature, origin FROM n""", "orders_split",
    n=union([f"SELECT 1 AS part, 0 AS late, '{c}' AS feature, '{c}' AS origin" for c in _PREP_NUMERIC]
            + [f"SELECT 2, 0, '{c}__missing_indicator', '{c}' FROM orders_split WHERE {_TRAIN} HAVING count({c}) < count(*)"
               for c in _PREP_NUMERIC]
            + [f"SELECT 3, 0, '{c}_' || v, '{c}' FROM ({_SHARES[c]}) WHERE own" for c in _PREP_TEXT]
            + [f"SELECT 3, 1, '{c}_infrequent_sklearn', '{c}' FROM ({_SHARES[c]}) WHERE NOT own HAVING count(*) > 0" for c in _PREP_TEXT]))
ORACLES["preprocess"] = sql("SELECT o_orderkey, split, y_rare, feature, round(value, 6) AS value FROM p WHERE round(value, 6) <> 0", "orders_split",
    med="SELECT " + ", ".join(f"median({c}) AS {c}_m" for c in _PREP_NUMERIC) + f" FROM orders_split WHERE {_TRAIN}",
    q="SELECT " + ", ".join(
        f"quantile_cont(coalesce({c}, {c}_m), 0.25) AS {c}_l, quantile_cont(coalesce({c}, {c}_m), 0.5) AS {c}_c, "
        f"quantile_cont(coalesce({c}, {c}_m), 0.75) AS {c}_h" for c in _PREP_NUMERIC)
    + f" FROM orders_split CROSS JOIN med WHERE {_TRAIN}",
    p=union([f"""SELECT o_orderkey, split, y_rare, '{c}' AS feature,
                ((coalesce({c}, {c}_m) - {c}_c) / CASE WHEN {c}_h = {c}_l THEN 1 ELSE {c}_h - {c}_l END)::DOUBLE AS value
                FROM orders_split CROSS JOIN med CROSS JOIN q""" for c in _PREP_NUMERIC]
            + [f"SELECT o_orderkey, split, y_rare, '{c}__missing_indicator', 1.0::DOUBLE FROM orders_split WHERE {c} IS NULL" for c in ("price", "price_info")]
            + [f"""SELECT o_orderkey, split, y_rare, CASE WHEN own THEN '{c}_' || v ELSE '{c}_infrequent_sklearn' END, 1.0::DOUBLE
                FROM orders_split JOIN ({_SHARES[c]}) ON v = coalesce({c}, {_mode(c, 'orders_split', _TRAIN)})""" for c in _PREP_TEXT]))

# --- metrics ---------------------------------------------------------------------------------------


def _class_metrics(view: str, actual: str, predicted: str) -> str:
    return f"""
        SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric,
               unnest([sum(hit) / sum(support), sum(p * support) / sum(support), sum(r * support) / sum(support),
                       sum(f * support) / sum(support)]) AS value FROM (
          SELECT support::DOUBLE AS support, hit::DOUBLE AS hit, CASE WHEN called > 0 THEN hit::DOUBLE / called ELSE 0 END AS p,
                 CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS r,
                 CASE WHEN called + support > 0 THEN 2.0::DOUBLE * hit / (called + support) ELSE 0 END AS f FROM (
            SELECT label, sum(s) AS support, sum(c) AS called, sum(h) AS hit FROM (
              SELECT {actual} AS label, 1 AS s, 0 AS c, ({actual} = {predicted})::INT AS h FROM {view}
              UNION ALL SELECT {predicted}, 0, 1, 0 FROM {view}) GROUP BY label))"""


ORACLES["classification_metrics"] = sql(f"""
    SELECT 'binary' AS run, metric, {r6('value')} AS value FROM a UNION ALL SELECT 'flags', metric, {r6('value')} FROM b""",
    "preds", a=_class_metrics("preds", "y_true", "y_pred"), b=_class_metrics("preds", "flag", "flag_pred"))
ORACLES["confusion_matrix"] = sql("""SELECT flag AS actual, flag_pred AS predicted, count(*) AS cnt FROM preds
    GROUP BY flag, flag_pred""", "preds")
ORACLES["label_metrics"] = sql(f"SELECT metric, {r6('value')} AS value FROM a",
                               a=_class_metrics("labels", "quality", "toxic"))


def _auc(label: str, score: str) -> str:
    """Rank-sum form with average ranks for ties."""
    return f"""SELECT sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives,
        (sum(y * r) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)) AS auc
        FROM (SELECT {label} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r
              FROM preds)"""


ORACLES["roc_auc"] = sql(f"""
    SELECT 'ties' AS run, positives, negatives, {r6('auc')} AS roc_auc FROM a
    UNION ALL SELECT 'continuous', positives, negatives, {r6('auc')} FROM b""", "preds",
    a=_auc("y_pred", "p"), b=_auc("(flag = 'R')::INT", "amount"))
ORACLES["regression_metrics"] = sql(f"""
    SELECT unnest(['rmse', 'mae', 'r2']) AS metric, unnest([{r6('sqrt(avg(e * e))')}, {r6('avg(abs(e))')},
        {r6('1 - avg(e * e) / var_pop(amount)')}]) AS value FROM (SELECT amount, amount - amount_pred AS e FROM preds)""",
    "preds")
ORACLES["permutation_pairs"] = sql("""
    SELECT a.o_orderkey AS key, b.r AS repeat, b.o_orderkey AS donor FROM
      (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS n FROM orders_dirty) a
      JOIN (SELECT o_orderkey, r, row_number() OVER (PARTITION BY r ORDER BY md5(o_orderkey::VARCHAR || '|' || r), o_orderkey) AS n
            FROM orders_dirty, (SELECT unnest([1, 2, 3]) AS r)) b USING (n)""", "orders_dirty")
ORACLES["cv_folds"] = sql(f"""
    SELECT {HASH.format(k='o_orderkey', p=9)} % 5 AS fold, y_rare::VARCHAR AS class, count(*) AS n FROM orders_dirty
    GROUP BY 1, 2""", "orders_dirty")
ORACLES["cv_folds_stratified"] = sql("""
    SELECT fold, class, count(*) AS n FROM (SELECT y_rare::VARCHAR AS class, (row_number() OVER (
        PARTITION BY y_rare ORDER BY md5(o_orderkey::VARCHAR || ':fold'), o_orderkey) - 1) % 5 AS fold FROM orders_dirty) GROUP BY 1, 2""", "orders_dirty")
_CURVE = """SELECT bin, coalesce(n, 0) AS n, coalesce(sp, 0) / (coalesce(n, 0) + 1e-8::DOUBLE) AS predicted,
    coalesce(sy, 0) / (coalesce(n, 0) + 1e-8::DOUBLE) AS actual FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN (
      SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, sum(p) AS sp, sum(y)::DOUBLE AS sy
      FROM (SELECT least(greatest(p, 0), 1) AS p, y_pred AS y FROM preds) GROUP BY 1) USING (bin)"""
ORACLES["calibration_curve"] = sql(f"SELECT bin, n, {r6('predicted')} AS predicted, {r6('actual')} AS actual FROM c",
                                   "preds", c=_CURVE)
ORACLES["calibration_ece"] = sql(f"""
    SELECT {r6('avg(abs(predicted - actual)) FILTER (n > 0)')} AS expected_calibration_error,
           avg(abs(predicted - actual)) FILTER (n > 0) < 0.05 AS is_well_calibrated FROM c""", "preds", c=_CURVE)
ORACLES["confidence_spread"] = sql(f"""
    SELECT {r6('avg((p > 0.8::DOUBLE)::INT) * 100')} AS high_confidence_pct,
           {r6('avg((p >= 0.5::DOUBLE AND p <= 0.8::DOUBLE)::INT) * 100')} AS medium_confidence_pct,
           {r6('avg((p < 0.5::DOUBLE)::INT) * 100')} AS low_confidence_pct, {r6('avg(p)')} AS mean_confidence,
           {r6('stddev_pop(p)')} AS confidence_std FROM preds""", "preds")

# --- observability ---------------------------------------------------------------------------------

ORACLES["generalization_flags"] = sql("""
    SELECT run_id, 'high_overfit_risk' AS flag_id, 'high' AS severity FROM judged WHERE overfit
    UNION ALL SELECT run_id, 'mild_overfit', 'medium' FROM judged WHERE mild
    UNION ALL SELECT run_id, 'high_fold_variance', 'high' FROM judged WHERE unstable
    UNION ALL SELECT run_id, 'generalization_decay', 'high' FROM judged WHERE decay""", "judged")
ORACLES["runner_flags"] = sql("""
    SELECT run_id, 'High Overfit Risk' AS flag FROM judged WHERE overfit
    UNION ALL SELECT run_id, 'Fold Instability' FROM judged WHERE cv_std > 0.08::DOUBLE
    UNION ALL SELECT run_id, 'Generalization Decay' FROM judged WHERE decay""", "judged")
ORACLES["deployment_readiness"] = sql("""
    SELECT run_id, score AS readiness_score, score >= 75 AND blocking_issues = '' AS can_deploy,
      CASE WHEN score >= 85 THEN 'green' WHEN score >= 70 THEN 'yellow' ELSE 'red' END AS recommendation,
      blocking_issues, warnings,
      CASE WHEN blocking_issues <> '' THEN 'DEPLOYMENT BLOCKED: ' || replace(blocking_issues, '.,', '., ')
           WHEN warnings <> '' THEN 'Conditional deployment approved. Enhanced monitoring recommended.'
           WHEN score >= 85 THEN 'Model passed deployment readiness audit.'
           ELSE 'Model satisfies minimum deployment criteria.' END AS approval_rationale
    FROM s""", "judged", s="""
    SELECT run_id,
      greatest(0, least(100, 100 - CASE WHEN risky THEN 25 WHEN mild THEN 10 ELSE 0 END
        - CASE WHEN n_critical_vif > 0 THEN 30 WHEN n_high_vif > 0 THEN 15 ELSE 0 END
        - CASE WHEN n_severe_drift > 5 THEN 40 WHEN n_severe_drift > 2 THEN 20 ELSE 0 END
        - CASE WHEN performance < 0.65::DOUBLE THEN 30 WHEN performance < 0.75::DOUBLE THEN 15 ELSE 0 END
        - least(30, n_critical * 10) - CASE WHEN n_high > 3 THEN (n_high - 3) * 5 ELSE 0 END))::DOUBLE AS score,
      concat_ws(',', CASE WHEN risky THEN 'High generalization risk detected.' END,
        CASE WHEN n_critical_vif > 0 THEN 'Critical multicollinearity detected.' END,
        CASE WHEN n_severe_drift > 5 THEN 'Critical feature drift detected.' END,
        CASE WHEN performance < 0.65::DOUBLE THEN 'Performance below acceptable threshold.' END) AS blocking_issues,
      concat_ws(',', CASE WHEN mild AND NOT risky THEN 'Moderate generalization concerns.' END,
        CASE WHEN n_critical_vif = 0 AND n_high_vif > 0 THEN 'High multicollinearity detected.' END,
        CASE WHEN n_severe_drift BETWEEN 3 AND 5 THEN 'Significant feature drift detected.' END,
        CASE WHEN performance >= 0.65::DOUBLE AND performance < 0.75::DOUBLE THEN 'Model performance is modest.' END) AS warnings
    FROM (SELECT *, overfit OR unstable OR decay AS risky FROM judged)""")
ORACLES["deployability_score"] = sql("""
    SELECT run_id, integrity, stability, feature_quality, performance, round_even(s, 1)::DOUBLE AS overall_score,
      CASE WHEN s >= 85 THEN 'DEPLOYMENT READY' WHEN s >= 70 THEN 'CONDITIONAL DEPLOYMENT' WHEN s >= 50 THEN 'DEPLOYMENT BLOCKED'
           ELSE 'SEVERE ISSUES DETECTED' END AS status,
      CASE WHEN s >= 85 THEN 'Pipeline passed reliability audit.' WHEN s >= 70 THEN 'Pipeline has moderate concerns.'
           WHEN s >= 50 THEN 'Critical reliability gaps detected.' ELSE 'Pipeline exhibits severe failures.' END AS message,
      CASE WHEN s >= 85 THEN 'Deploy with standard monitoring.' WHEN s >= 70 THEN 'Resolve high-severity issues.'
           WHEN s >= 50 THEN 'Investigate critical issues.' ELSE 'Rebuild validation workflow.' END AS action
    FROM (SELECT *, integrity * 0.35::DOUBLE + stability * 0.35::DOUBLE + feature_quality * 0.2::DOUBLE
                 + performance * 0.1::DOUBLE AS s FROM parts)""", "issues_clean",
    i="""SELECT run_id, count(*) FILTER (severity_c AND contains(type, 'leakage')) AS leak,
        count(*) FILTER (severity_c AND contains(type, 'overlap')) AS overlap,
        count(*) FILTER (severity_c AND contains(type, 'drift')) AS drift, count(*) FILTER (severity_h) AS high,
        count(*) FILTER (type = 'multicollinearity') AS vif, count(*) FILTER (type = 'high_cardinality') AS card
        FROM (SELECT *, severity = 'critical' AS severity_c, severity = 'high' AS severity_h FROM issues_clean) GROUP BY run_id""",
    f="""SELECT user_id AS run_id, count(*) FILTER (event_id % 40 = 0) AS overfit, count(*) FILTER (event_id % 40 = 1) AS fold,
        count(*) FILTER (event_id % 40 = 2) AS decay FROM events GROUP BY user_id""",
    m="""SELECT user_id AS run_id, user_id % 3 = 0 AS error_style,
        ((count(*) FILTER (event_id % 3 = 0) * 1000) // count(*) + 350) / 1000.0::DOUBLE AS v FROM events GROUP BY user_id""",
    parts="""SELECT run_id, greatest(0, 100 - CASE WHEN leak > 0 THEN 40 ELSE 0 END - CASE WHEN overlap > 0 THEN 35 ELSE 0 END
          - CASE WHEN drift > 2 THEN 25 ELSE 0 END - CASE WHEN high > 5 THEN 15 ELSE 0 END)::DOUBLE AS integrity,
        (100 - CASE WHEN overfit > 0 THEN 20 ELSE 0 END - CASE WHEN fold > 0 THEN 15 ELSE 0 END
          - CASE WHEN decay > 0 THEN 25 ELSE 0 END)::DOUBLE AS stability,
        (100 - CASE WHEN vif > 3 THEN 20 WHEN vif > 0 THEN 10 ELSE 0 END - CASE WHEN card > 2 THEN 15 ELSE 0 END)::DOUBLE AS feature_quality,
        (CASE WHEN error_style THEN CASE WHEN v > 1 THEN 50 WHEN v > 0.5 THEN 75 ELSE 95 END
              WHEN v < 0.65::DOUBLE THEN 50 WHEN v < 0.75::DOUBLE THEN 75 ELSE 95 END)::DOUBLE AS performance
        FROM i JOIN f USING (run_id) JOIN m USING (run_id)""")
ORACLES["primary_metric"] = sql(f"""
    SELECT run_id, metric, {r6('value')} AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE metric WHEN 'f1' THEN 0 WHEN 'accuracy' THEN 1
        WHEN 'r2' THEN 4 WHEN 'rmse' THEN 5 WHEN 'mae' THEN 6 ELSE 7 END, metric) AS r
      FROM run_metrics WHERE split = 'holdout') WHERE r = 1""", "run_metrics")
ORACLES["metric_gap"] = sql(f"""
    SELECT run_id, metric, train, holdout, {r6('abs(train - holdout)')} AS gap,
           CASE WHEN abs(train - holdout) < 0.1::DOUBLE THEN 'OK' ELSE 'WARNING' END AS status FROM (
      SELECT run_id, metric, coalesce(max(value) FILTER (split = 'train'), 0) AS train,
             max(value) FILTER (split = 'holdout') AS holdout FROM run_metrics GROUP BY run_id, metric)
    WHERE holdout IS NOT NULL""", "run_metrics")
ORACLES["report_normalize"] = f"""
    SELECT event_id, 'success' AS pipeline_status, event_id::DOUBLE AS rows,
      CASE WHEN event_id % 6 = 1 THEN 0 ELSE (event_id % 100)::DOUBLE END AS overlap_pct,
      CASE WHEN event_id % 6 = 3 THEN 0 ELSE {r6("('0.' || event_id::VARCHAR)::DOUBLE")} END::DOUBLE AS holdout_f1,
      CASE WHEN event_id % 6 = 2 THEN 2 ELSE 0 END::BIGINT AS n_flags,
      CASE WHEN event_id % 6 IN (4, 5) THEN 0 ELSE 2 END::BIGINT AS n_issues, 0::BIGINT AS n_recommendations,
      3::BIGINT AS n_psi, 0::BIGINT AS n_vif, 0::BIGINT AS n_audited,
      CASE WHEN event_id % 6 = 0 THEN 0 ELSE 2 END::BIGINT AS n_importances, 0::BIGINT AS n_timings
    FROM events"""

# --- issues and recommendations --------------------------------------------------------------------

ORACLES["issue_normalize"] = sql('SELECT issue_id, run_id, type, "column", severity, description FROM issues_clean',
                                 "issues_clean")
ORACLES["severity_normalize"] = sql("SELECT issue_id, severity, score_severity FROM issues_clean", "issues_clean")
_PRIORITY = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"
_NAME = "CASE p WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END"


def _grouped(keys: str) -> str:
    return f"""SELECT {keys} type, max({_PRIORITY}) AS p, count(*) AS issue_count,
        list_sort(list(DISTINCT "column")) AS cols FROM issues_clean GROUP BY {keys} type"""


ORACLES["recommendations"] = sql(f"""
    SELECT 'rec_' || type AS recommendation_id, {_NAME} AS severity, array_to_string(cols, ',') AS affected_columns, issue_count,
      CASE WHEN p = 5 THEN 'Immediate attention recommended. ' ELSE '' END || CASE type
        WHEN 'missing_values' THEN 'Investigate missing-value patterns and consider imputation improvements for: ' || few || '.'
        WHEN 'feature_drift' THEN 'Detected train/test distribution drift. Review feature stability and data collection for: ' || few || '.'
        WHEN 'multicollinearity' THEN 'High multicollinearity detected. Consider feature selection or dimensionality reduction for: ' || few || '.'
        WHEN 'split_overlap' THEN 'Potential train/test leakage detected. Review dataset splitting strategy and deduplication safeguards.'
        WHEN 'high_cardinality' THEN 'High-cardinality categorical features detected. Review encoding strategy and memory impact.'
        ELSE 'Review detected issues and validate data quality, preprocessing stability, and model robustness.' END AS recommendation,
      row_number() OVER (ORDER BY p DESC, issue_count DESC, 'rec_' || type) AS rank
    FROM (SELECT *, array_to_string(cols[1:5], ', ') AS few FROM g)""", "issues_clean", g=_grouped(""))
ORACLES["recommendations_by_run"] = sql(f"""
    SELECT run_id, 'rec_' || type AS recommendation_id, {_NAME} AS severity, array_to_string(cols, ',') AS affected_columns,
      issue_count, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, issue_count DESC, 'rec_' || type) AS rank
    FROM g""", "issues_clean", g=_grouped("run_id,"))
ORACLES["critical_issues"] = sql("SELECT count(*) FILTER (severity = 'critical') AS critical_issues FROM issues_clean",
                                 "issues_clean")
ORACLES["severity_distribution"] = sql("SELECT severity, count(*) AS cnt FROM issues_clean GROUP BY severity",
                                       "issues_clean")
ORACLES["severity_filter"] = sql("""SELECT issue_id, r.severity FROM issues_clean JOIN issues_raw r USING (issue_id)
    WHERE score_severity = 'critical'""", "issues_clean")
ORACLES["issues_by_type"] = sql("""SELECT issue_id, type, row_number() OVER (PARTITION BY type ORDER BY issue_id) AS number
    FROM issues_clean""", "issues_clean")

# --- chart tables ----------------------------------------------------------------------------------

ORACLES["correlation_matrix"] = sql(f"""
    SELECT feature_a, feature_b, CASE WHEN isfinite(corr) THEN {r6('corr')} END AS corr FROM c""", "orders_dirty",
    c=union([f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN var_samp({a}) > 0 AND var_samp({b}) > 0
        THEN {'1.0::DOUBLE' if a == b else f'corr({a}, {b})'} END AS corr FROM orders_dirty""" for a in NUMERIC for b in NUMERIC]))
ORACLES["missing_top10"] = sql(f"""SELECT feature, {r6('missing_pct')} AS missing_pct FROM m WHERE missing_pct >= 0.05
    ORDER BY missing_pct DESC, feature LIMIT 10""", "orders_dirty", m=_missing(DIRTY_COLUMNS, "orders_dirty"))
