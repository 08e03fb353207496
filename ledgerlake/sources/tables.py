"""The driver's TPC-H-like tables seen as a ledger, and a dirty raw ledger.

Both mappings are single portable SQL texts with ``{table}`` placeholders:
Spark runs them through ``spark.sql(text, table=DataFrame)`` and the DuckDB
oracle runs the very same text over its views, so both engines start from
identical rows. Every row of the source tables is used; the ``%`` in the
dirty projection only picks *which kind* of dirt a row gets.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# lineitem -> orders -> customer -> nation -> region; region is the entity
# type, nation the sub type, customer the entity; one measure per line.
LEDGER_SQL = """
SELECT
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS txn_date,
  r_name AS entity_type,
  n_name AS entity_sub_type,
  c_name AS entity_name,
  CASE l_returnflag WHEN 'A' THEN 'Receipt' WHEN 'N' THEN 'Payment' ELSE 'Journal' END AS vch_type,
  o_orderpriority AS particulars,
  CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN l_extendedprice ELSE 0.0E0 END AS cash_dr,
  CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 1 THEN l_extendedprice ELSE 0.0E0 END AS cash_cr,
  CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN l_extendedprice ELSE 0.0E0 END AS bank_dr,
  CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 1 THEN l_extendedprice ELSE 0.0E0 END AS bank_cr,
  CAST(l_shipdate AS DATE) AS txn_day
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""

_JOINS = "JOIN {orders} ON l_orderkey = o_orderkey\nJOIN {customer} ON o_custkey = c_custkey"
# The same joins for Spark, which keeps their order: the orders get their
# customer before the lines, four to an order, get their order. Where
# customers are too many to broadcast, only orders are shuffled by customer.
ORDERS_FIRST_SQL = LEDGER_SQL.replace(
    _JOINS, "JOIN (SELECT * FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS bought ON l_orderkey = o_orderkey"
)

_ISO = "CAST(CAST(ts AS DATE) AS STRING)"
_P2 = "lpad(CAST({f}(ts) AS STRING), 2, '0')"
_TIME = " || ':' || ".join(_P2.format(f=f) for f in ("hour", "minute", "second"))
_MONTH = (
    "split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',', month(ts))"
)
_BASE = "CAST(CAST(value AS DECIMAL(12,2)) AS STRING)"

# A raw, all-string ledger with every kind of dirt the cleaning rules
# handle: mixed date layouts, padded and missing-token text, and numbers
# in accepted and rejected shapes. Column 11 is an extra column that the
# positional reader must drop.
DIRTY_SQL = f"""
SELECT
  event_id,
  CASE event_id % 19
    WHEN 0 THEN {_ISO}
    WHEN 1 THEN {_ISO} || ' ' || {_P2.format(f='hour')} || ':' || {_P2.format(f='minute')}
    WHEN 2 THEN {_P2.format(f='month')} || '/' || {_P2.format(f='day')} || '/' || CAST(year(ts) AS STRING)
    WHEN 3 THEN {_P2.format(f='day')} || '/' || {_P2.format(f='month')} || '/' || CAST(year(ts) AS STRING)
    WHEN 4 THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(ts) * 3 - 2, 3)
                || ' ' || CAST(day(ts) AS STRING) || ' ' || CAST(year(ts) AS STRING)
    WHEN 5 THEN '  ' || {_ISO} || chr(9)
    WHEN 6 THEN 'x'
    WHEN 7 THEN NULL
    WHEN 9 THEN {_ISO} || 'T' || {_TIME}
    WHEN 10 THEN {_ISO} || ' ' || {_TIME} || '.123'
    WHEN 11 THEN {_P2.format(f='day')} || '-' || {_P2.format(f='month')} || '-' || CAST(year(ts) AS STRING)
    WHEN 12 THEN CAST(day(ts) AS STRING) || '-' || substr({_MONTH}, 1, 3) || '-' || CAST(year(ts) AS STRING)
    WHEN 13 THEN CAST(day(ts) AS STRING) || ' ' || {_MONTH} || ' ' || CAST(year(ts) AS STRING)
    WHEN 14 THEN CAST(year(ts) AS STRING) || '/' || {_P2.format(f='month')} || '/' || {_P2.format(f='day')}
    WHEN 15 THEN {_MONTH} || ' ' || CAST(day(ts) AS STRING) || ', ' || CAST(year(ts) AS STRING)
    WHEN 16 THEN substr({_MONTH}, 1, 3) || ' ' || CAST(day(ts) AS STRING) || ', ' || CAST(year(ts) AS STRING)
    WHEN 17 THEN {_P2.format(f='month')} || '/' || {_P2.format(f='day')} || '/' || substr(CAST(year(ts) AS STRING), 3, 2)
    WHEN 18 THEN CAST(month(ts) AS STRING) || '/' || CAST(day(ts) AS STRING) || '/' || CAST(year(ts) AS STRING)
                 || ' ' || CAST(hour(ts) AS STRING) || ':' || {_P2.format(f='minute')}
    ELSE CAST(event_id AS STRING)
  END AS raw_date,
  CASE event_id % 7
    WHEN 0 THEN event_type
    WHEN 1 THEN '  ' || event_type || ' '
    WHEN 2 THEN chr(9) || event_type
    WHEN 3 THEN 'nan'
    WHEN 4 THEN NULL
    WHEN 5 THEN ''
    ELSE 'None'
  END AS raw_type,
  CASE event_id % 8
    WHEN 0 THEN 'NA'
    WHEN 1 THEN 'N/A'
    WHEN 2 THEN 'null'
    WHEN 3 THEN 'NULL'
    WHEN 4 THEN 'NaN'
    WHEN 5 THEN '   '
    ELSE 'seg_' || CAST(user_id % 10 AS STRING)
  END AS raw_sub_type,
  CASE event_id % 11
    WHEN 0 THEN 'Nan Corp'
    WHEN 1 THEN ' user ' || CAST(user_id AS STRING) || ' '
    ELSE 'user ' || CAST(user_id AS STRING)
  END AS raw_name,
  upper(event_type) AS raw_vch,
  props AS raw_particulars,
  CASE event_id % 13
    WHEN 0 THEN {_BASE}
    WHEN 1 THEN ' ' || {_BASE} || ' '
    WHEN 2 THEN '+' || {_BASE}
    WHEN 3 THEN '-' || {_BASE}
    WHEN 4 THEN CAST(CAST(round(value * 100) AS BIGINT) AS STRING) || 'e-2'
    WHEN 5 THEN '1,234'
    WHEN 6 THEN '(' || {_BASE} || ')'
    WHEN 7 THEN {_BASE} || 'd'
    WHEN 8 THEN NULL
    WHEN 9 THEN ''
    WHEN 10 THEN 'nan'
    WHEN 11 THEN 'inf'
    ELSE '1e999'
  END AS raw_cash_dr,
  CASE event_id % 6
    WHEN 0 THEN {_BASE}
    WHEN 1 THEN '0x10'
    WHEN 2 THEN '1_0'
    WHEN 3 THEN '.5'
    WHEN 4 THEN NULL
    ELSE '0'
  END AS raw_cash_cr,
  CASE WHEN event_id % 3 = 0 THEN {_BASE} ELSE '0' END AS raw_bank_dr,
  CASE WHEN event_id % 5 = 0 THEN '1e3' ELSE '' END AS raw_bank_cr,
  CAST(event_id AS STRING) AS extra_col
FROM {{events}}
"""

RAW_COLUMNS = [
    "raw_date",
    "raw_type",
    "raw_sub_type",
    "raw_name",
    "raw_vch",
    "raw_particulars",
    "raw_cash_dr",
    "raw_cash_cr",
    "raw_bank_dr",
    "raw_bank_cr",
]



def _quoted(x: str) -> str:
    """A CSV field: quoted, with quotes inside doubled."""
    return f"chr(34) || replace(coalesce({x}, ''), chr(34), chr(34) || chr(34)) || chr(34)"


_NINE = " || ',' || ".join(_quoted(c) for c in RAW_COLUMNS[:9])
_TEN = f"{_NINE} || ',' || {_quoted(RAW_COLUMNS[9])}"

# The dirty ledger as CSV lines in three folders, whose headers have 10, 11
# and 9 columns; in each some lines have 9 or 11 fields or an open quote.
LINES_SQL = f"""
SELECT
  event_id,
  CAST(event_id % 3 AS INTEGER) AS folder,
  CASE event_id % 7 WHEN 1 THEN 9 WHEN 2 THEN 11 WHEN 3 THEN NULL ELSE 10 END AS found,
  CASE event_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 11 ELSE 9 END AS expected,
  CASE event_id % 7
    WHEN 1 THEN {_NINE}
    WHEN 2 THEN {_TEN} || ',' || {_quoted("extra_col")}
    WHEN 3 THEN {_NINE} || ',' || chr(34) || 'never closed'
    ELSE {_TEN}
  END AS line
FROM {{dirty}}
"""

LEDGER_TABLES = ["lineitem", "orders", "customer", "nation", "region"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ledger_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean ledger (10 columns + ``txn_day``) derived from the driver tables.

    Join strategy is left to Catalyst + AQE: nation/region are broadcast by
    their measured file size, lineitem x orders stays a shuffle join, the
    only one that shuffles lines.
    """
    tables = {t: read_table(spark, sf_dir, t) for t in LEDGER_TABLES}
    return spark.sql(ORDERS_FIRST_SQL, **tables)


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` + 10 raw string columns + one extra column."""
    return spark.sql(DIRTY_SQL, events=read_table(spark, sf_dir, "events"))


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id``, ``folder``, ``found``, ``expected``, ``line``."""
    return spark.sql(LINES_SQL, dirty=dirty_events(spark, sf_dir))


def ledger_sql_for_duckdb() -> str:
    return LEDGER_SQL.format(**{t: t for t in LEDGER_TABLES})


def dirty_sql_for_duckdb() -> str:
    return DIRTY_SQL.format(events="events")
