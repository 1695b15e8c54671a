"""Schema-repair queries over projections of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from matfold.operators.schema import (auto_coerce, drop_all_null_columns, merge_duplicate_numeric,
                                      normalize_columns, sql_safe_columns, trim_strings)
from matfold.plans.registry import query
from matfold.sources.tables import spark_sql

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

# Duplicated numeric columns ('X', 'X.1') with nulls on either side, and a
# lone suffixed column that only needs its suffix removed.
_DUP = f"""
SELECT {_KEYS},
  l_quantity AS qty,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / 1000 END AS `qty.1`,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_tax END AS tax,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS `tax.1`,
  l_discount AS `disc.0`,
  l_returnflag AS flag
FROM {{lineitem}}
"""


@query("merge_dup_numeric", oracle=f"""
WITH t AS (SELECT {_KEYS}, l_quantity AS qty,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / 1000 END AS qty1,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_tax END AS tax,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS tax1,
  l_discount AS disc, l_returnflag AS flag FROM lineitem)
SELECT {_KEYS},
  round((coalesce(qty, 0) + coalesce(qty1, 0)) / nullif((qty IS NOT NULL)::INT + (qty1 IS NOT NULL)::INT, 0), 6) AS qty,
  round((coalesce(tax, 0) + coalesce(tax1, 0)) / nullif((tax IS NOT NULL)::INT + (tax1 IS NOT NULL)::INT, 0), 6) AS tax,
  disc, flag
FROM t
""")
def q_merge_dup_numeric(spark, sf_dir):
    df = merge_duplicate_numeric(spark_sql(spark, sf_dir, _DUP.replace("`", "`")))
    keys = [k.strip() for k in _KEYS.split(",")]
    return df.select(*keys, F.round("qty", 6).alias("qty"), F.round("tax", 6).alias("tax"), "disc", "flag")


_MIXED = f"""
SELECT {_KEYS},
  CAST(CAST(l_quantity AS DECIMAL(18,1)) AS STRING) AS qty_text,
  l_returnflag AS flag_text,
  CASE WHEN l_linenumber = 1 THEN CAST(CAST(l_tax AS DECIMAL(18,2)) AS STRING) ELSE l_linestatus END AS mixed_text,
  CASE WHEN l_linenumber = 2 THEN ' 12 ' ELSE NULL END AS sparse_text
FROM {{lineitem}}
"""


@query("auto_coerce", oracle=f"""
SELECT {_KEYS}, CAST(CAST(l_quantity AS DECIMAL(18,1)) AS DOUBLE) AS qty_text, l_returnflag AS flag_text,
  CASE WHEN l_linenumber = 1 THEN CAST(CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) END AS mixed_text,
  CASE WHEN l_linenumber = 2 THEN 12.0 END AS sparse_text
FROM lineitem
""")
def q_auto_coerce(spark, sf_dir):
    return auto_coerce(spark_sql(spark, sf_dir, _MIXED))


@query("drop_null_columns", oracle=f"""
SELECT {_KEYS}, CASE WHEN l_linenumber = 7 THEN l_tax END AS sometimes FROM lineitem
""")
def q_drop_null_columns(spark, sf_dir):
    df = spark_sql(spark, sf_dir, f"""
      SELECT {_KEYS}, CAST(NULL AS DOUBLE) AS never,
             CASE WHEN l_linenumber = 7 THEN l_tax END AS sometimes,
             CASE WHEN l_linenumber > 100 THEN l_returnflag END AS never_text
      FROM {{lineitem}}""")
    return drop_all_null_columns(df)


@query("normalize_columns", oracle="""
SELECT c_custkey AS Cust_Key, c_name AS Customer_Name, c_acctbal AS Balance_pct,
       c_mktsegment AS Segment_Type, c_nationkey AS Nation_C FROM customer
""")
def q_normalize_columns(spark, sf_dir):
    df = spark_sql(spark, sf_dir, """
      SELECT c_custkey AS ` Cust\nKey `, concat('  ', c_name, '\t') AS `Customer   Name`,
             c_acctbal AS `Balance %`, c_mktsegment AS `Segment/Type`, c_nationkey AS `Nation °`
      FROM {customer}""")
    return trim_strings(sql_safe_columns(normalize_columns(df)))
