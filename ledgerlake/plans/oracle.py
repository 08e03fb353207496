"""DuckDB SQL for every registered query, written independently of the
Spark code from the same contract. Used by the driver's correctness gate
and by ``tests/test_oracle.py``."""

from __future__ import annotations

from ledgerlake.plans import params as P
from ledgerlake.sources.tables import LINES_SQL, dirty_sql_for_duckdb, ledger_sql_for_duckdb

COLS = "txn_date, entity_type, entity_sub_type, entity_name, vch_type, particulars, cash_dr, cash_cr, bank_dr, bank_cr"
DIMS = "txn_date, entity_type, entity_sub_type, entity_name"
MEAS = ["cash_dr", "cash_cr", "bank_dr", "bank_cr"]


def _with() -> str:
    return f"WITH ledger AS ({ledger_sql_for_duckdb()})\n"


def _dec(m: str) -> str:
    # Through text: a direct cast of a large double rounds twice.
    return f"CAST(CAST({m} AS VARCHAR) AS DECIMAL(28,4))"


def _sum(m: str, alias: str | None = None) -> str:
    return f"CAST(COALESCE(SUM({_dec(m)}), 0) AS DOUBLE) AS {alias or m}"


def _net(dr: str, cr: str, alias: str) -> str:
    return f"CAST(COALESCE(SUM({_dec(dr)} - {_dec(cr)}), 0) AS DOUBLE) AS {alias}"


SUMS = ", ".join(_sum(m) for m in MEAS)
GROSS = (
    "CAST(COALESCE(SUM(" + " + ".join(_dec(m) for m in MEAS) + "), 0) AS DOUBLE) AS gross_total"
)
AGGS = f"COUNT(*) AS row_count, {SUMS}, {GROSS}"
TOTALS = f"COUNT(*) AS row_count, {SUMS}"


def _path(level_expr: str, dims: list[str]) -> str:
    parts = [f"CASE WHEN {level_expr} >= {i} THEN '/{i}/' || {d} ELSE '' END" for i, d in enumerate(dims)]
    return "(" + " || ".join(parts) + ")"


LABELS = {"txn_date": "Date", "entity_type": "Entity Type", "entity_sub_type": "Entity Sub Type", "entity_name": "Entity Name"}
D4 = ["txn_date", "entity_type", "entity_sub_type", "entity_name"]


def _node_select(src: str, level_expr: str = "level") -> str:
    col = "CASE " + " ".join(f"WHEN {level_expr} = {i} THEN '{LABELS[d]}'" for i, d in enumerate(D4)) + " END"
    lab = "CASE " + " ".join(f"WHEN {level_expr} = {i} THEN {d}" for i, d in enumerate(D4)) + " END"
    dims = ", ".join(f"CASE WHEN {level_expr} >= {i} THEN {d} END AS {d}" for i, d in enumerate(D4))
    return (
        f"SELECT {_path(level_expr, D4)} AS node_id, "
        f"CASE WHEN {level_expr} > 0 THEN {_path(level_expr + ' - 1', D4)} END AS parent_id, "
        f"'group' AS node_type, CAST({level_expr} AS INTEGER) AS level, {col} AS \"column\", {lab} AS label, "
        f"{dims}, row_count, {', '.join(MEAS)}, gross_total, TRUE AS has_children, FALSE AS is_leaf FROM {src}"
    )


def _level_nodes(where: str, level: int) -> str:
    keys = ", ".join(D4[: level + 1])
    nulls = "".join(f", NULL AS {d}" for d in D4[level + 1 :])
    src = f"(SELECT {keys}{nulls}, {level} AS level, {AGGS} FROM ledger WHERE {where} GROUP BY {keys})"
    return _with() + _node_select(src)


def _rollup(dims: list[str], where: str = "TRUE") -> str:
    g = " + ".join(f"GROUPING({d})" for d in dims)
    return (
        f"SELECT CAST({len(dims) - 1} - ({g}) AS INTEGER) AS level, {', '.join(dims)}, {AGGS} "
        f"FROM ledger WHERE {where} GROUP BY ROLLUP({', '.join(dims)})"
    )


ORDER = COLS


def _tx_select(levels: list[str], where: str, cap: int | None) -> str:
    path = _path(str(len(levels) - 1), levels)
    keep = f"WHERE n < {cap}" if cap else ""
    return (
        f"SELECT {path} || '/tx/' || CAST(n AS VARCHAR) AS node_id, {path} AS parent_id, 'transaction' AS node_type, "
        f"{len(levels)} AS level, CAST(n AS BIGINT) AS tx_index, {COLS} FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {', '.join(levels)} ORDER BY {ORDER}) - 1 AS n "
        f"FROM ledger WHERE {where}) {keep}"
    )


def _tx(levels: list[str], where: str, cap: int | None) -> str:
    return _with() + _tx_select(levels, where, cap)


def _overflow_select(levels: list[str], cap: int) -> str:
    path = _path(str(len(levels) - 1), levels)
    return (
        f"SELECT {path} || '/more' AS node_id, {path} AS parent_id, 'info' AS node_type, {len(levels)} AS level, "
        f"{', '.join(levels)}, printf('... and %d more transactions', c - {cap}) AS label, "
        f"CAST(c - {cap} AS BIGINT) AS remaining FROM (SELECT {', '.join(levels)}, COUNT(*) AS c FROM ledger "
        f"GROUP BY {', '.join(levels)}) WHERE c > {cap}"
    )


def _overflow(levels: list[str], cap: int) -> str:
    return _with() + _overflow_select(levels, cap)


def _hierarchy(cap: int) -> str:
    nulls = {"s": "CAST(NULL AS VARCHAR)", "d": "CAST(NULL AS DOUBLE)", "b": "CAST(NULL AS BIGINT)",
             "i": "CAST(NULL AS BIGINT)"}
    meas = ", ".join(MEAS)
    groups = (
        f"SELECT node_id, parent_id, node_type, level, \"column\", label, {DIMS}, {nulls['s']} AS vch_type, "
        f"{nulls['s']} AS particulars, row_count, {meas}, gross_total, has_children, is_leaf, "
        f"{nulls['i']} AS tx_index, {nulls['b']} AS remaining FROM ({_node_select(f'({_rollup(D4)}) WHERE level >= 0')})"
    )
    tx = (
        f"SELECT node_id, parent_id, node_type, level, {nulls['s']}, {nulls['s']}, {DIMS}, vch_type, particulars, "
        f"{nulls['b']}, {meas}, {nulls['d']}, FALSE, TRUE, tx_index, {nulls['b']} FROM ({_tx_select(D4, 'TRUE', cap)})"
    )
    more = (
        f"SELECT node_id, parent_id, node_type, level, {nulls['s']}, label, {DIMS}, {nulls['s']}, {nulls['s']}, "
        f"{nulls['b']}, {', '.join([nulls['d']] * 4)}, {nulls['d']}, FALSE, TRUE, {nulls['i']}, remaining "
        f"FROM ({_overflow_select(D4, cap)})"
    )
    return _with() + f"{groups} UNION ALL {tx} UNION ALL {more}"


# --- cleaning rules, re-stated in DuckDB SQL -------------------------------

_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_FMT = [
    "%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%g", "%m/%d/%y", "%d/%m/%y",
    "%m/%d/%Y", "%d/%m/%Y", "%m/%d/%Y %H:%M", "%m-%d-%Y", "%d-%m-%Y", "%d-%b-%Y", "%d %B %Y", "%Y/%m/%d", "%B %d, %Y",
    "%b %d, %Y", "%b %d %Y",
]
_TOKENS = "('nan', 'NaN', 'None', 'NA', 'N/A', 'null', 'NULL', '')"
_NUM = "'[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?'"


def _day(x: str) -> str:
    t = _TRIM.format(x=x)
    return "CAST(COALESCE(" + ", ".join(f"try_strptime({t}, '{f}')" for f in _FMT) + ") AS DATE)"


def _date_text(x: str) -> str:
    return f"COALESCE(strftime({_day(x)}, '%Y-%m-%d'), 'Unknown')"


def _text(x: str) -> str:
    t = _TRIM.format(x=x)
    return f"CASE WHEN {t} IS NULL OR {t} IN {_TOKENS} THEN 'Unknown' ELSE {t} END"


def _num_or_null(x: str) -> str:
    t = _TRIM.format(x=x)
    v = f"CASE WHEN regexp_full_match({t}, {_NUM}) THEN TRY_CAST({t} AS DOUBLE) END"
    return f"CASE WHEN abs({v}) < 1e24 THEN {v} END"


def _num(x: str) -> str:
    return f"COALESCE({_num_or_null(x)}, 0.0)"


def _rej(x: str) -> str:
    t = _TRIM.format(x=x)
    return f"CASE WHEN {t} IS NOT NULL AND {t} <> '' AND {_num_or_null(x)} IS NULL THEN 1 ELSE 0 END"


RAW = ["raw_date", "raw_type", "raw_sub_type", "raw_name", "raw_vch", "raw_particulars",
       "raw_cash_dr", "raw_cash_cr", "raw_bank_dr", "raw_bank_cr"]


def _clean_select() -> str:
    return (
        f"{_date_text('raw_date')} AS txn_date, {_text('raw_type')} AS entity_type, "
        f"{_text('raw_sub_type')} AS entity_sub_type, {_text('raw_name')} AS entity_name, "
        f"{_text('raw_vch')} AS vch_type, {_text('raw_particulars')} AS particulars, "
        + ", ".join(f"{_num(r)} AS {m}" for r, m in zip(RAW[6:], MEAS))
        + f", {_day('raw_date')} AS txn_day, "
        + " + ".join(_rej(r) for r in RAW[6:])
        + f" AS numeric_rejects, CASE WHEN {_text('raw_date')} <> 'Unknown' AND {_day('raw_date')} IS NULL "
        "THEN 1 ELSE 0 END AS date_rejects"
    )


def _dirty() -> str:
    return f"WITH dirty AS ({dirty_sql_for_duckdb()}), clean AS (SELECT event_id, {_clean_select()} FROM dirty)\n"


def _inr(x: str) -> str:
    s = f"printf('%.2f', abs({x}))"
    ip = f"split_part({s}, '.', 1)"
    dp = f"split_part({s}, '.', 2)"
    head = f"reverse(rtrim(regexp_replace(reverse(left({ip}, length({ip}) - 3)), '(\\d\\d)', '\\1,', 'g'), ','))"
    grouped = f"CASE WHEN length({ip}) <= 3 THEN {ip} ELSE {head} || ',' || right({ip}, 3) END"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {grouped} || '.' || {dp})"


def _generator() -> str:
    from ledgerlake.sources import generator as G

    def lst(vals):
        return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in vals) + "]"

    m, a0 = G._M, G._A0
    draws = ", ".join(
        f"xor((y * {a}) % {m}, ((y * {a}) % {m}) >> 11) AS d{i}" for i, a in enumerate(G._DRAW_MULT, start=1)
    )
    by_type = lambda mapping, d: "CASE entity_type " + " ".join(
        f"WHEN '{t}' THEN {lst(v)}[{d} % {len(v)} + 1]" for t, v in mapping.items()
    ) + " END"
    span = int((G.MAX_AMOUNT - G.MIN_AMOUNT) * 100) + 1
    meas = ", ".join(f"CASE WHEN which = {i} THEN amount ELSE 0.0 END AS {c}" for i, c in enumerate(MEAS))
    return (
        f"WITH k AS (SELECT {P.GEN_KEY} AS key FROM lineitem), "
        f"x AS (SELECT ((key % {m}) * {a0} + {P.GEN_SEED % m}) % {m} AS x FROM k), "
        "y AS (SELECT xor(x, x >> 13) AS y FROM x), "
        f"d AS (SELECT {draws} FROM y), "
        f"t AS (SELECT *, {lst(G.ENTITY_TYPES)}[d1 % {len(G.ENTITY_TYPES)} + 1] AS entity_type, "
        f"DATE '{P.GEN_END}' - {G.DAYS_BACK} + CAST(d5 % {G.DAYS_BACK + 1} AS INTEGER) AS day, "
        f"CAST(d6 % {span} + {int(G.MIN_AMOUNT * 100)} AS DOUBLE) / CAST(100 AS DOUBLE) AS amount, "
        f"d7 % 4 AS which FROM d) "
        f"SELECT strftime(day, '%Y-%m-%d') AS txn_date, entity_type, {by_type(G.SUB_TYPES, 'd2')} AS entity_sub_type, "
        f"{by_type(G.NAMES, 'd3')} AS entity_name, {lst(G.VCH_TYPES)}[d4 % {len(G.VCH_TYPES)} + 1] AS vch_type, "
        f"{lst(G.PARTICULARS)}[d8 % {len(G.PARTICULARS)} + 1] AS particulars, {meas} FROM t"
    )


def _amounts() -> str:
    return " || ',' || ".join(f"'\"{m}\":' || {_dec(m)}::VARCHAR" for m in MEAS)


def _nested(limit: int) -> str:
    """The nested tree, a level at a time from the transactions up."""
    path = "'/0/' || txn_date || '/1/' || entity_type || '/2/' || entity_sub_type || '/3/' || entity_name"
    parts = [
        f"""c4 AS (
  SELECT {DIMS}, n AS ord, 1 AS size, '{{"id":' || to_json({path} || '/tx/' || n::VARCHAR)::VARCHAR || ',"type":"transaction","level":4,"vch_type":'
         || to_json(vch_type)::VARCHAR || ',"particulars":' || to_json(particulars)::VARCHAR || ',"amounts":{{' || {_amounts()} || '}}}}' AS json
  FROM (SELECT *, row_number() OVER (PARTITION BY {DIMS} ORDER BY {ORDER}) - 1 AS n FROM ledger)
)"""
    ]
    out = []
    for level in range(3, -2, -1):
        dims = D4[: level + 1]
        by, using = (", ".join(dims), f"USING ({', '.join(dims)})") if dims else ("one", "USING (one)")
        keys = by if dims else "1 AS one"
        parts.append(
            f"""p{level + 1} AS (
  SELECT {by}, before // {limit} AS part, sum(size)::BIGINT AS nodes, '[' || string_agg(json, ',' ORDER BY before) || ']' AS json
  FROM (SELECT *, {keys if not dims else '0 AS zero'}, sum(size) OVER ({'PARTITION BY ' + by if dims else ''} ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM c{level + 1})
  GROUP BY {by}, part
), k{level + 1} AS (
  SELECT {by}, max(part) + 1 AS parts, sum(nodes)::BIGINT AS below, max(json) FILTER (part = 0) AS first FROM p{level + 1} GROUP BY {by}
)"""
        )
        node = " || ".join(f"'/{i}/' || {d}" for i, d in enumerate(dims)) or "''"
        out.append(f"SELECT {node} AS path, part, nodes, json FROM p{level + 1} JOIN k{level + 1} {using}" + (f" WHERE below > {limit}" if dims else ""))
        if dims:
            parts.append(
                f"""c{level} AS (
  SELECT {', '.join([*dims[:-1], f'{dims[-1]} AS ord'])}, CASE WHEN below <= {limit} THEN below + 1 ELSE 1 END AS size,
         '{{"id":' || to_json({node})::VARCHAR || ',"type":"group","level":{level},"label":' || to_json({dims[-1]})::VARCHAR
         || ',"column":"{LABELS[dims[-1]]}","count":' || row_count::VARCHAR || ',"aggregates":{{' || {_amounts()} || '}},"parts":' || CASE WHEN below <= {limit} THEN 0 ELSE parts END::VARCHAR
         || ',"children":' || CASE WHEN below <= {limit} THEN first ELSE '[]' END || '}}' AS json
  FROM (SELECT {by}, {AGGS} FROM ledger GROUP BY {by}) JOIN k{level + 1} {using}
)"""
            )
    return f"WITH ledger AS ({ledger_sql_for_duckdb()}), {', '.join(parts)}\n" + " UNION ALL ".join(out)


def oracle_sql() -> dict[str, str]:
    W = _with()
    day, busy, ty, sub, name = P.DAY, P.BUSY_DAY, P.TYPE, P.SUB_TYPE, P.NAME
    q: dict[str, str] = {}
    q["totals"] = W + f"SELECT {TOTALS} FROM ledger"
    q["totals_filtered"] = W + f"SELECT {TOTALS} FROM ledger WHERE txn_date = '{busy}'"
    q["totals_empty"] = W + f"SELECT {TOTALS} FROM ledger WHERE entity_type = '{P.MISSING}'"
    q["filter_date"] = W + f"SELECT {COLS} FROM ledger WHERE txn_date = '{day}'"
    q["filter_entity_type"] = W + f"SELECT {COLS} FROM ledger WHERE entity_type = '{ty}'"
    q["filter_multi"] = W + (
        f"SELECT {COLS} FROM ledger WHERE entity_type = '{ty}' AND entity_sub_type = '{sub}' AND entity_name = '{name}'"
    )
    q["filter_none"] = W + f"SELECT {COLS} FROM ledger"
    q["text_filter"] = W + (
        f"SELECT {COLS} FROM ledger WHERE contains(lower(particulars), 'urgent') "
        "AND starts_with(lower(entity_name), 'customer#0000001') AND lower(vch_type) <> 'journal'"
    )
    q["number_filter"] = W + f"SELECT {COLS} FROM ledger WHERE cash_dr BETWEEN 10000.0 AND 30000.0 AND bank_cr = 0.0"
    q["text_filter_more"] = W + (
        f"SELECT {COLS} FROM ledger WHERE lower(vch_type) = 'receipt' AND NOT contains(lower(particulars), 'low') "
        "AND ends_with(entity_name, '7') AND entity_type <> ''"
    )
    q["number_filter_more"] = W + (
        f"SELECT {COLS} FROM ledger WHERE cash_dr < 20000.0 AND cash_cr <= 30000.0 AND bank_dr >= 0.0 "
        "AND bank_cr <> 0.0 AND bank_cr > 15000.0"
    )
    large = ", ".join(f"{m} * {P.LARGE_FACTOR!r}::DOUBLE AS {m}" for m in MEAS)
    WL = f"WITH small AS ({ledger_sql_for_duckdb()}), ledger AS (SELECT * REPLACE ({large}) FROM small)\n"
    q["totals_large"] = WL + f"SELECT {TOTALS} FROM ledger"
    q["rollup_large"] = WL + _rollup(D4)
    q["saved_rollup_lookup"] = W + f"SELECT 1 AS level, {AGGS} FROM ledger WHERE txn_date = '{busy}'"
    q["saved_rollup_children"] = _level_nodes(
        f"txn_date = '{P.EXPAND_PATH[0]}' AND entity_type = '{P.EXPAND_PATH[1]}'", len(P.EXPAND_PATH)
    )
    q["sort_by_date"] = W + f"SELECT {COLS} FROM ledger ORDER BY txn_date DESC"
    dup = ", ".join(P.DUP_KEYS)
    q["seek_page_dup"] = W + (
        f"SELECT {dup} FROM ledger WHERE ({dup}) >= {P.DUP_AFTER!r} ORDER BY {dup} "
        f"LIMIT {P.SEEK_LIMIT} OFFSET {P.DUP_SEEN}"
    )
    q["level_summary"] = W + (
        f"SELECT 1 AS level, 'Entity Type' AS \"column\", entity_type AS value, {AGGS} FROM ledger GROUP BY entity_type"
    )
    q["gross_total"] = W + (
        f"SELECT 0 AS level, 'Date' AS \"column\", txn_date AS value, {AGGS} FROM ledger GROUP BY txn_date"
    )
    q["rollup_report"] = W + _rollup(D4)
    q["group_lookup"] = W + (
        f"SELECT 2 AS level, {AGGS} FROM ledger WHERE entity_type = '{ty}' AND entity_sub_type = '{sub}'"
    )
    q["group_lookup_missing"] = W + f"SELECT 1 AS level, {AGGS} FROM ledger WHERE entity_name = '{P.MISSING}'"
    q["profile"] = W + (
        "SELECT COUNT(*) AS row_count, 10 AS column_count, strftime(MIN(txn_day), '%Y-%m-%d') AS start_date, "
        "strftime(MAX(txn_day), '%Y-%m-%d') AS end_date, COUNT(CASE WHEN txn_date = 'Unknown' THEN 1 END) AS unknown_dates, "
        "COUNT(DISTINCT entity_type) AS entity_types, COUNT(DISTINCT entity_sub_type) AS entity_sub_types, "
        "COUNT(DISTINCT entity_name) AS entity_names FROM ledger"
    )
    q["filter_options"] = W + (
        "SELECT DISTINCT dimension, value FROM ("
        + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value FROM ledger" for d in D4)
        + ") ORDER BY dimension, value"
    )
    q["saved_rollup_options"] = q["filter_options"]
    q["flat_hierarchy"] = W + (
        f"SELECT concat_ws('/', {DIMS}) AS id, 3 AS level, {DIMS}, {AGGS} FROM ledger GROUP BY {DIMS}"
    )
    tx_fields = ", ".join(f"'{c}': {c}" for c in ["vch_type", "particulars", *MEAS])
    q["flat_hierarchy_nested"] = W + (
        f"SELECT concat_ws('/', {DIMS}) AS id, 3 AS level, g.txn_date, g.entity_type, g.entity_sub_type, "
        f"g.entity_name, row_count, {', '.join(MEAS)}, gross_total, chunk, transactions FROM "
        f"(SELECT {DIMS}, {AGGS} FROM ledger GROUP BY {DIMS}) g JOIN "
        f"(SELECT {DIMS}, CAST(n // {P.NESTED_CHUNK_ROWS} AS BIGINT) AS chunk, "
        f"to_json(list({{'tx_index': n, {tx_fields}}} ORDER BY n)) AS transactions FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {DIMS} ORDER BY {ORDER}) - 1 AS n FROM ledger) "
        f"GROUP BY {DIMS}, chunk) c USING ({DIMS})"
    )
    q["node_table"] = W + _node_select(f"({_rollup(D4)}) WHERE level >= 0")
    q["browse_start_level"] = _level_nodes(f"txn_date = '{busy}'", 1)
    q["browse_by_type"] = _level_nodes(f"entity_type = '{P.BROWSE_TYPE}'", 0)
    q["expand_node"] = _level_nodes(
        f"txn_date = '{P.EXPAND_PATH[0]}' AND entity_type = '{P.EXPAND_PATH[1]}'", len(P.EXPAND_PATH)
    )
    q["transactions_of"] = _tx(D4, f"entity_name = '{name}'", None)
    q["leaf_cap"] = _tx(D4, "TRUE", P.LEAF_CAP)
    q["leaf_overflow"] = _overflow(D4, P.LEAF_CAP)
    q["leaf_cap_coarse"] = _tx(list(P.COARSE_LEVELS), "TRUE", P.COARSE_CAP)
    q["leaf_overflow_coarse"] = _overflow(list(P.COARSE_LEVELS), P.COARSE_CAP)
    q["leaf_cap_large"] = _tx(list(P.LARGE_LEVELS), "TRUE", P.LARGE_CAP)
    q["hierarchy"] = _hierarchy(P.LEAF_CAP)
    q["sorted_ledger"] = W + f"SELECT {COLS} FROM ledger ORDER BY {ORDER}"
    rest = ", ".join(c for c in COLS.split(", ") if c != "cash_dr")
    q["user_sort"] = W + f"SELECT {COLS} FROM ledger ORDER BY cash_dr DESC, {rest} LIMIT {P.USER_SORT_LIMIT}"
    q["data_page"] = W + f"SELECT {COLS} FROM ledger ORDER BY {ORDER} LIMIT {P.PAGE_LIMIT} OFFSET {P.PAGE_OFFSET}"
    q["numbered_page"] = q["data_page"]
    record = "to_json({" + ", ".join(f"'{c}': {c}" for c in COLS.split(", ")) + "})"
    q["page_json"] = W + (
        f"SELECT {record} AS record FROM (SELECT {COLS} FROM ledger ORDER BY {ORDER} "
        f"LIMIT {P.PAGE_LIMIT} OFFSET {P.PAGE_OFFSET})"
    )
    q["page_meta"] = W + (
        f"SELECT COUNT(*) AS total_count, CAST(LEAST({P.PAGE_LIMIT}, GREATEST(COUNT(*) - {P.PAGE_OFFSET}, 0)) AS BIGINT) "
        f"AS returned, CAST({P.PAGE_OFFSET} AS BIGINT) AS page_offset, {SUMS} FROM ledger"
    )
    q["seek_page"] = W + (
        f"SELECT {COLS} FROM ledger WHERE txn_date > '{P.SEEK_AFTER[0]}' ORDER BY {ORDER} LIMIT {P.SEEK_LIMIT}"
    )
    q["export_report"] = W + (
        f"SELECT {COLS}, FALSE AS is_total FROM ledger WHERE txn_date = '{day}' UNION ALL "
        f"SELECT '', '', '', '', '', 'TOTAL', {SUMS}, TRUE FROM ledger WHERE txn_date = '{day}'"
    )
    q["monthly_reconciliation"] = W + (
        "SELECT COALESCE(strftime(txn_day, '%Y-%m'), 'Unknown') AS month, entity_type, entity_sub_type, entity_name, "
        f"COUNT(*) AS row_count, {SUMS}, {_net('cash_dr', 'cash_cr', 'cash_net')}, {_net('bank_dr', 'bank_cr', 'bank_net')} "
        "FROM ledger GROUP BY ALL"
    )
    q["entity_rollup"] = W + _rollup(["entity_type", "entity_sub_type", "entity_name"])
    q["cash_vs_bank"] = W + (
        f"SELECT entity_type, 'cash' AS channel, {_sum('cash_dr', 'dr')}, {_sum('cash_cr', 'cr')}, "
        f"{_net('cash_dr', 'cash_cr', 'net')} FROM ledger GROUP BY entity_type UNION ALL "
        f"SELECT entity_type, 'bank', {_sum('bank_dr', 'dr')}, {_sum('bank_cr', 'cr')}, "
        f"{_net('bank_dr', 'bank_cr', 'net')} FROM ledger GROUP BY entity_type"
    )
    q["date_range"] = W + (
        f"SELECT {COLS} FROM ledger WHERE txn_day BETWEEN DATE '{P.RANGE_START}' AND DATE '{P.RANGE_END}'"
    )
    q["range_totals"] = W + (
        f"SELECT {TOTALS} FROM ledger WHERE txn_day BETWEEN DATE '{P.RANGE_START}' AND DATE '{P.RANGE_END}'"
    )
    q["audit_trail"] = W + f"SELECT {COLS} FROM ledger WHERE entity_name = '{name}' ORDER BY {ORDER}"
    q["format_inr"] = W + (
        f"SELECT {COLS}, " + ", ".join(f"{_inr(m)} AS {m}_inr" for m in MEAS) + " FROM ledger"
    )
    q["format_amount"] = W + (
        f"SELECT {COLS}, " + ", ".join(f"format('{{:,.2f}}', {m}) AS {m}_text" for m in MEAS) + " FROM ledger"
    )
    q["generate_ledger"] = _generator()
    D = _dirty()
    q["normalize_date"] = D + "SELECT event_id, raw_date, txn_date FROM dirty JOIN clean USING (event_id)"
    q["normalize_text"] = D + (
        "SELECT event_id, entity_type, entity_sub_type, entity_name, vch_type, particulars FROM clean"
    )
    q["normalize_numeric"] = D + "SELECT event_id, cash_dr, cash_cr, bank_dr, bank_cr, numeric_rejects FROM clean"
    q["normalize_ledger"] = D + f"SELECT {COLS} FROM clean"
    q["drop_zero_rows"] = D + (
        f"SELECT {COLS} FROM clean WHERE cash_dr <> 0 OR cash_cr <> 0 OR bank_dr <> 0 OR bank_cr <> 0"
    )
    q["ingest_ledger"] = D + (
        "SELECT COUNT(*) AS row_count, 10 AS column_count, strftime(MIN(txn_day), '%Y-%m-%d') AS start_date, "
        "strftime(MAX(txn_day), '%Y-%m-%d') AS end_date, COUNT(CASE WHEN txn_date = 'Unknown' THEN 1 END) AS unknown_dates, "
        "COUNT(DISTINCT entity_type) AS entity_types, COUNT(DISTINCT entity_sub_type) AS entity_sub_types, "
        "COUNT(DISTINCT entity_name) AS entity_names, CAST(SUM(numeric_rejects) AS BIGINT) AS numeric_rejects, "
        "CAST(SUM(date_rejects) AS BIGINT) AS date_rejects FROM clean"
    )
    q["read_ledger"] = q["ingest_ledger"]
    q["ingest_rejects"] = (
        f"WITH dirty AS ({dirty_sql_for_duckdb()}), lines AS ({LINES_SQL.format(dirty='dirty')})\n"
        "SELECT line, found, expected, CASE WHEN expected < 10 THEN 'header has too few columns' WHEN found IS NULL THEN 'open quote' "
        "WHEN found < expected THEN 'too few fields' ELSE 'too many fields' END AS reason "
        "FROM lines WHERE expected < 10 OR found IS NULL OR found <> expected"
    )
    q["ingest_checked"] = D + (
        f"SELECT {COLS} FROM clean WHERE event_id % 3 = 0 AND event_id % 7 NOT IN (1, 2, 3) OR event_id % 3 = 1 AND event_id % 7 = 2"
    )
    q["rollup_incremental"] = q["rollup_report"]
    plain = f"SELECT {COLS}, row_number() OVER (ORDER BY {ORDER}) - 1 AS i, count(*) OVER () AS n FROM ledger"
    by_cash = f"SELECT {COLS}, row_number() OVER (ORDER BY cash_dr DESC, {rest}) - 1 AS i FROM ledger"
    first = P.SEEK_AFTER[0]
    q["indexed_page"] = W + (
        f", plain AS ({plain}), by_cash AS ({by_cash})\n"
        f"SELECT 'shallow' AS page, {COLS} FROM plain WHERE i >= {P.PAGE_OFFSET} AND i < {P.PAGE_OFFSET + P.PAGE_LIMIT} UNION ALL "
        f"SELECT 'deep', {COLS} FROM plain WHERE i >= n - {P.DEEP_FROM_END} AND i < n - {P.DEEP_FROM_END} + {P.DEEP_LIMIT} UNION ALL "
        f"(SELECT 'key', {COLS} FROM plain WHERE txn_date >= '{first}' ORDER BY i LIMIT {P.SEEK_LIMIT}) UNION ALL "
        f"SELECT 'sorted', {COLS} FROM by_cash WHERE i >= {P.SORTED_OFFSET} AND i < {P.SORTED_OFFSET + P.USER_SORT_LIMIT}"
    )
    q["nested_tree"] = _nested(P.TREE_NODES)
    return q
