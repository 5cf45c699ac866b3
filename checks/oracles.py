"""The same results as plain SQL over the same tables."""

from __future__ import annotations

from .queries import TABLES, TEMPLATE

# Schemas of the test tables: i integer, f double, t text, d timestamp, x unsupported.
COLUMNS = {
    "region": "r_regionkey:i r_name:t",
    "nation": "n_nationkey:i n_name:t n_regionkey:i",
    "customer": "c_custkey:i c_name:t c_nationkey:i c_acctbal:f c_mktsegment:t",
    "supplier": "s_suppkey:i s_name:t s_nationkey:i s_acctbal:f",
    "part": "p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:f",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:f o_orderdate:d o_orderpriority:t",
    "lineitem": (
        "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f "
        "l_tax:f l_returnflag:t l_linestatus:t l_shipdate:d"
    ),
    "events": "event_id:i ts:d user_id:i event_type:t value:f props:t",
    "documents": "doc_id:i text:t lang:t source:t n_chars:i",
    "embeddings": "vec_id:i embedding:x label:i",
    "pages": "page_id:i url:t html:t",
    "benchmark": "item_id:i text:t",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:t text:t",
}
LABELS = {
    "i": "numeric (integer)",
    "f": "numeric (float)",
    "t": "categorical / text",
    "d": "datetime",
}


def schema(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[table].split()]


def union(parts) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def exact(x: str) -> str:
    return f"coalesce(fsum(CAST({x} AS DOUBLE)), CAST(0 AS DOUBLE))"


def four(x: str) -> str:
    """Four digits, rounded by the exact value of the double."""
    return f"CAST(format('{{:.4f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def avg(x: str) -> str:
    return f"({exact(x)} / nullif(count({x}), 0))"


def whole(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def two(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


def single(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN format('{{:,.0f}}', {x}) ELSE format('{{:,.1f}}', {x}) END"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def stamp(x: str, separator: str = " ") -> str:
    base = f"%Y-%m-%d{separator}%H:%M:%S"
    return (
        f"CASE WHEN date_part('microseconds', {x}) % 1000000 <> 0 THEN strftime({x}, '{base}.%f') "
        f"ELSE strftime({x}, '{base}') END"
    )


def iso(x: str) -> str:
    return stamp(x, "T")


def ratio_ok(x: str) -> str:
    return f"(count({x}) >= 10 AND count(DISTINCT {x}) / count({x}) >= 0.9)"


def missing_pct(x: str) -> str:
    return f"round_even((count(*) - count({x})) * 100.0::DOUBLE / count(*), 1)"


# ---- profiles --------------------------------------------------------------------


def numeric(table: str, column: str, kind: str, name: str | None = None) -> str:
    total = f"CAST(sum({column}) AS DOUBLE)" if kind == "i" else f"{four(exact(column))}"
    mean = f"CAST(sum({column}) AS DOUBLE) / count({column})" if kind == "i" else avg(column)
    return f"""SELECT '{name or column}' AS "column", count(*) AS count, count({column}) AS non_null,
      {missing_pct(column)} AS missing_pct, {total} AS sum, {four(mean)} AS mean,
      {four(f'median({column})')} AS median, CAST(min({column}) AS DOUBLE) AS min,
      CAST(max({column}) AS DOUBLE) AS max, {four(f'stddev_samp({column})')} AS std_dev FROM {table}"""


def categorical(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS count, count({column}) AS non_null,
      {missing_pct(column)} AS missing_pct, count(DISTINCT {column}) AS unique_values,
      {ratio_ok(column)} AS identifier_like,
      CASE WHEN {ratio_ok(column)} THEN 'identifier-like column, top values suppressed' END AS note FROM {table}"""


def dates(table: str, column: str, name: str | None = None) -> str:
    return f"""SELECT '{name or column}' AS "column", count(*) AS count, count({column}) AS non_null,
      {missing_pct(column)} AS missing_pct, {iso(f'min({column})')} AS min_date, {iso(f'max({column})')} AS max_date,
      datesub('day', min({column}), max({column})) AS date_range_days FROM {table}"""


def boolean(table: str, column: str, name: str) -> str:
    return f"""SELECT '{name}' AS "column", count(*) AS count, count({column}) AS non_null,
      {missing_pct(column)} AS missing_pct, count(*) FILTER (WHERE {column}) AS true_count,
      count(*) FILTER (WHERE NOT {column}) AS false_count,
      round_even(count(*) FILTER (WHERE {column}) * 100.0::DOUBLE / count({column}), 1) AS true_pct FROM {table}"""


def top(table: str, column: str, n: int, value: str = "value") -> str:
    return f"""SELECT '{column}' AS "column", CAST(rank AS INTEGER) AS rank, {value}, count FROM (
      SELECT {column} AS value, count(*) AS count, row_number() OVER (
        ORDER BY count(*) DESC, left({column}, 128), CASE WHEN length({column}) > 128 THEN sha256({column}) END NULLS FIRST) AS rank
      FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}) WHERE rank <= {n}"""


def table_profile(table: str) -> str:
    parts = []
    n = len(schema(table))
    for column, kind in schema(table):
        fields = {
            "sum": "DOUBLE", "mean": "DOUBLE", "median": "DOUBLE", "min": "DOUBLE", "max": "DOUBLE",
            "std_dev": "DOUBLE", "min_date": "VARCHAR", "max_date": "VARCHAR", "date_range_days": "BIGINT",
            "unique_values": "BIGINT", "identifier_like": "BOOLEAN",
        }
        source = {"i": numeric, "f": numeric}.get(kind)
        inner = source(table, column, kind) if source else (categorical if kind == "t" else dates)(table, column)
        have = {
            "i": ("sum", "mean", "median", "min", "max", "std_dev"),
            "f": ("sum", "mean", "median", "min", "max", "std_dev"),
            "t": ("unique_values", "identifier_like"),
            "d": ("min_date", "max_date", "date_range_days"),
        }[kind]
        columns = ", ".join(f"{f} AS {f}" if f in have else f"CAST(NULL AS {t}) AS {f}" for f, t in fields.items())
        parts.append(
            f"""SELECT '{table}' AS "table", "column", '{LABELS[kind]}' AS label, count AS row_count,
            CAST({n} AS INTEGER) AS column_count, count, non_null, missing_pct, {columns} FROM ({inner})"""
        )
    return union(parts)


def workspace_profile() -> str:
    parts = []
    for table in TABLES:
        for column, kind in schema(table):
            known = kind != "x"
            label = f"'{LABELS[kind]}'" if known else "NULL"
            count, values = ("count(*)", f"count({column})") if known else ("CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)")
            unique = f"count(DISTINCT {column})" if kind == "t" else "CAST(NULL AS BIGINT)"
            flag = ratio_ok(column) if kind == "t" else "CAST(NULL AS BOOLEAN)"
            parts.append(
                f"""SELECT '{table}' AS "table", '{column}' AS "column", {label} AS label, count(*) AS row_count,
                CAST({len(schema(table))} AS INTEGER) AS column_count, {count} AS count, {values} AS non_null,
                {unique} AS unique_values, {flag} AS identifier_like FROM {table}"""
            )
    return union(parts)


def condensed(table: str) -> str:
    parts = []
    for column, kind in schema(table):
        null = {"sum": "DOUBLE", "mean": "DOUBLE", "min_date": "VARCHAR", "max_date": "VARCHAR", "unique_values": "BIGINT", "top_values": "VARCHAR"}
        have = {}
        if kind == "i":
            have = {"sum": f"CAST(sum({column}) AS DOUBLE)", "mean": four(f"CAST(sum({column}) AS DOUBLE) / count({column})")}
        elif kind == "f":
            have = {"sum": four(exact(column)), "mean": four(avg(column))}
        elif kind == "d":
            have = {"min_date": iso(f"min({column})"), "max_date": iso(f"max({column})")}
        else:
            tops = f"""(SELECT string_agg(value || '=' || count, ',' ORDER BY rank) FROM ({top(table, column, 3)}))"""
            have = {"unique_values": f"count(DISTINCT {column})", "top_values": tops}
        columns = ", ".join(f"{have[f]} AS {f}" if f in have else f"CAST(NULL AS {t}) AS {f}" for f, t in null.items())
        parts.append(
            f"""SELECT '{table}' AS "table", count(*) AS row_count, '{column}' AS "column", '{LABELS[kind]}' AS type,
            {columns}, CAST(NULL AS BOOLEAN) AS identifier_like FROM {table}"""
        )
    return union(parts)


# ---- KPIs ------------------------------------------------------------------------


def extreme(label, table, by, agg, key, text, which="max", number="v"):
    order = "v" if which == "min" else "v DESC"
    return f"""SELECT '{label}' AS label, 'extreme_category' AS type, {key} AS key,
      CAST({number} AS DOUBLE) AS value, {key} || ' (' || {text} || ')' AS formatted, 'ok' AS status FROM (
      SELECT * FROM (SELECT {by} AS k, {agg} AS v FROM {table} WHERE {by} IS NOT NULL GROUP BY {by})
      WHERE v IS NOT NULL ORDER BY {order}, k LIMIT 1)"""


def average(label, table, by, agg):
    return f"""SELECT '{label}' AS label, 'avg_per_group' AS type, CAST(NULL AS VARCHAR) AS key, v AS value,
      {single('v')} AS formatted, 'ok' AS status FROM (SELECT {avg_of_groups('v')} AS v FROM (
      SELECT {agg} AS v FROM {table} WHERE {by} IS NOT NULL GROUP BY {by}))"""


def avg_of_groups(x):
    return f"fsum(CAST({x} AS DOUBLE)) / count({x})"


def scalar(label, kind, table, value, text):
    return f"""SELECT '{label}' AS label, '{kind}' AS type, CAST(NULL AS VARCHAR) AS key, v AS value,
      {text} AS formatted, 'ok' AS status FROM (SELECT {value} AS v FROM {table})"""


def rate(label, table, column, pattern):
    hits = f"count(*) FILTER (WHERE regexp_matches({column}, '{pattern}', 'i'))"
    return scalar(label, "filtered_rate", table, f"{hits}::DOUBLE / count(*) * 100", f"{single('v')} || '%'")


def matching_sum(label, table, column, pattern, value, whole_number=False):
    x = f"CASE WHEN regexp_matches({column}, '{pattern}', 'i') THEN {value} END"
    text = whole("v") if whole_number else single("v")
    amount = f"coalesce(CAST(sum({x}) AS DOUBLE), CAST(0 AS DOUBLE))" if whole_number else exact(x)
    return scalar(label, "filtered_sum", table, amount, text)


def peak(label, table, x, value, key, text, number="v"):
    return f"""SELECT '{label}' AS label, 'peak_point' AS type, {key} AS key, CAST({number} AS DOUBLE) AS value,
      {key} || ' (' || {text} || ')' AS formatted, 'ok' AS status FROM (
      SELECT {x} AS k, {value} AS v FROM {table} WHERE {value} IS NOT NULL ORDER BY v DESC, k LIMIT 1)"""


def skipped(label, kind, reason):
    return f"""SELECT '{label}' AS label, {kind} AS type, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS DOUBLE) AS value,
      CAST(NULL AS VARCHAR) AS formatted, 'skipped: {reason}' AS status"""


# ---- facts and series ------------------------------------------------------------


def ranked(table, category, agg, total):
    return f"""WITH g AS (SELECT {category} AS k, {agg} AS v FROM {table} WHERE {category} IS NOT NULL GROUP BY {category}),
      r AS (SELECT k, v, row_number() OVER (ORDER BY v DESC, k) AS rn, (SELECT count(*) FROM g) AS n,
            (SELECT {total} FROM g) AS tot FROM g)"""


def facts(table, category, agg, total, key, value):
    def at(rank, expr):
        return f"max(CASE WHEN rn = {rank} THEN {expr} END)"

    pct = "format('{:.1f}%', v / tot * 100)"
    text = value("v")
    return f"""{ranked(table, category, agg, total)}
      SELECT {at(1, key('k'))} AS top_category, {at(1, text)} AS top_value, {at(1, pct)} AS top_pct,
      coalesce({at(2, key('k'))}, 'N/A') AS second_category, coalesce({at(2, text)}, '0') AS second_value,
      coalesce({at(2, pct)}, '0.0%') AS second_pct, {at('n', key('k'))} AS bottom_category, {at('n', text)} AS bottom_value,
      {value('max(tot)')} AS total_value, {two('CAST(max(tot) AS DOUBLE) / max(n)')} AS mean_value,
      {whole('max(n)')} AS count FROM r"""


def plain(x):
    return f"CAST({x} AS VARCHAR)"


EXACT_TOTAL = exact("v")
ORDERS_FACTS = facts("orders", "o_orderpriority", exact("o_totalprice"), EXACT_TOTAL, plain, two)


def series(table, category, key, measures):
    return union(
        f"""SELECT {key(category)} AS category, '{name}' AS series, CAST({agg} AS DOUBLE) AS value
        FROM {table} WHERE {category} IS NOT NULL GROUP BY {category}"""
        for name, agg in measures
    )


def template() -> str:
    text = "'{{COUNT}}: ' || o_orderstatus || ' " + TEMPLATE + "'"
    names = (
        "top_category top_value top_pct second_category second_value second_pct bottom_category bottom_value "
        "total_value mean_value count"
    ).split()
    filled = text
    for n in names:
        filled = f"replace({filled}, '{{{{{n.upper()}}}}}', f.{n})"
    return f"""SELECT o_orderkey, o_orderpriority AS spec_id,
      CASE WHEN o_orderpriority = '1-URGENT' THEN {filled} ELSE {text} END AS insight_text
      FROM orders, ({ORDERS_FACTS}) f"""


SEGMENT_GRID = """
  SELECT c_mktsegment AS source, c_custkey + 3 AS row_idx,
    [c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR)] AS cells FROM customer
  UNION ALL SELECT DISTINCT c_mktsegment, 0, [NULL, NULL, NULL]::VARCHAR[] FROM customer
  UNION ALL SELECT DISTINCT c_mktsegment, 1, [c_mktsegment, NULL, NULL]::VARCHAR[] FROM customer
  UNION ALL SELECT DISTINCT c_mktsegment, 2, ['Name', 'Nation', 'Balance'] FROM customer"""

NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def detected(scan: int) -> str:
    texts = f"list_filter(cells, lambda c: c IS NOT NULL AND trim(c) <> '' AND NOT regexp_matches(c, {NUMBER}))"
    numbers = f"list_filter(cells, lambda c: c IS NOT NULL AND regexp_matches(c, {NUMBER}))"
    return f"""WITH grid AS ({SEGMENT_GRID}),
      numbered AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY row_idx) - 1 AS i, cells FROM grid),
      scored AS (SELECT source, i, cells, len(list_distinct({texts})) - len({numbers}) AS s
                 FROM numbered WHERE i < {scan}),
      best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, i) AS place FROM scored)
      SELECT source, CASE WHEN s > 0 THEN i ELSE 0 END AS header_row,
        CAST(CASE WHEN s > 0 THEN s ELSE 0 END AS BIGINT) AS score,
        CASE WHEN s > 0 THEN array_to_string(cells, '|') ELSE '' END AS header FROM best WHERE place = 1"""


DATED = """(SELECT *, strftime(o_orderdate, '%m/%d/%Y') AS us_date,
  CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'open' END AS mixed,
  CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'none' END AS rarely FROM orders)"""


def parsed(column: str) -> str:
    return f"try_strptime({column}, '%m/%d/%Y')"


def date_label(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", CASE WHEN count({parsed(column)}) >= 0.5 * count({column}) "
        f"AND count({parsed(column)}) > 0 THEN 'datetime (inferred)' ELSE 'categorical / text' END AS label FROM {DATED}"
    )


def type_labels() -> str:
    typed = [f"SELECT '{c}' AS \"column\", '{LABELS[k]}' AS label" for c, k in schema("orders")]
    return union([*typed, *[date_label(c) for c in ("us_date", "mixed", "rarely")], "SELECT 'urgent', 'boolean'"])


def datetime_share() -> str:
    return union(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count({parsed(c)}) AS parsed,
        count({parsed(c)}) / count({c}) AS ratio,
        count({parsed(c)}) >= 0.5 * count({c}) AND count({parsed(c)}) > 0 AS is_datetime FROM {DATED}"""
        for c in ("us_date", "mixed", "rarely", "o_orderstatus")
    )


def inferred_profile() -> str:
    parts = []
    for c in ("us_date", "mixed", "rarely"):
        d = parsed(c)
        yes = f"(count({d}) >= 0.5 * count({c}) AND count({d}) > 0)"
        parts.append(
            f"""SELECT '{c}' AS "column", CASE WHEN {yes} THEN 'datetime (inferred)' ELSE 'categorical / text' END AS label,
            count(*) AS count, CASE WHEN {yes} THEN count({d}) ELSE count({c}) END AS non_null,
            CASE WHEN {yes} THEN {missing_pct(d)} ELSE {missing_pct(c)} END AS missing_pct,
            CASE WHEN {yes} THEN {iso(f'min({d})')} END AS min_date, CASE WHEN {yes} THEN {iso(f'max({d})')} END AS max_date,
            CASE WHEN {yes} THEN datesub('day', min({d}), max({d})) END AS date_range_days,
            CASE WHEN NOT {yes} THEN count(DISTINCT {c}) END AS unique_values FROM {DATED}"""
        )
    return union(parts)


CHART = "CASE WHEN value > 20 THEN 'bar' WHEN value > 5 THEN 'line' ELSE 'radar' END"
CHART_STATUS = "CASE WHEN value > 5 THEN 'ok' ELSE 'error: unknown chart type' END"


def parsed_plans(strict: bool = False) -> str:
    def row(kinds, idx, status, title, chart, columns, n, x):
        return f"""SELECT event_id AS plan_id, CAST({idx} AS BIGINT) AS spec_idx, {status} AS status, {title} AS title,
          {chart} AS chart_type, {columns} AS data_columns, CAST({n} AS BIGINT) AS n_kpis, {x} AS x_col
          FROM events WHERE event_type IN ({kinds})"""

    title, columns = "'E' || event_id", "'event_type,' || event_type"
    nothing = "CAST(NULL AS VARCHAR)"
    rejected = "'error: another spec of the plan is invalid'"
    first = f"CASE WHEN event_type <> 'click' AND value > 5 THEN {rejected} ELSE {CHART_STATUS} END" if strict else CHART_STATUS
    return union(
        [
            row("'click', 'view', 'signup'", 0, first, title, CHART, columns, 1, "event_type"),
            row("'view'", 1, "'error: missing keys: data_columns, insight_text, source_sheet'", title, "'text'", nothing, 0, nothing),
            row("'signup'", 1, "'error: not an object'", nothing, nothing, nothing, 0, nothing),
            row("'error'", "NULL", "'error: not JSON'", nothing, nothing, nothing, "NULL", nothing),
            row("'purchase'", "NULL", "'error: no list of specs'", nothing, nothing, nothing, "NULL", nothing),
        ]
    )


def run_facts(parts) -> str:
    return union(
        f"SELECT '{i}' AS spec_id, top_category, top_value, total_value, count FROM ({sql})" for i, sql in parts
    )


STATUS_FACTS = facts("orders", "o_orderstatus", "count(*)", "sum(v)", plain, whole)
DAY_FACTS = facts("orders", "o_orderdate", "sum(o_custkey)", "sum(v)", stamp, whole)
SUPPLIER_FACTS = facts("supplier", "s_name", exact("s_acctbal"), EXACT_TOTAL, plain, two)
BRAND_FACTS = facts("part", "p_brand", "sum(p_size)", "sum(v)", plain, whole)


def run_status() -> str:
    def row(i, rendered, status, text, source=""):
        return f"SELECT '{i}' AS spec_id, '{rendered}' AS rendered_as, '{status}' AS status, {text} AS insight_text {source}"

    return union(
        [
            row(0, "text", "ok", "'All orders.'"),
            row(1, "bar", "ok", "top_category || ' leads with ' || top_value || ' (' || top_pct || ').'", f"FROM ({ORDERS_FACTS})"),
            row(2, "pie", "ok", "count || ' states, ' || total_value || ' orders.'", f"FROM ({STATUS_FACTS})"),
            row(3, "line", "ok", "count || ' days.'", f"FROM ({DAY_FACTS})"),
            row(4, "table", "ok", "count || ' suppliers.'", f"FROM ({SUPPLIER_FACTS})"),
            row(5, "text", "fallback: no such table", "'Nothing.'"),
            row(6, "text", "unfilled", "'{{COUNT}}'"),
            row(7, "bar", "ok", "bottom_category || ' is last.'", f"FROM ({BRAND_FACTS})"),
        ]
    )


def run_kpis() -> str:
    parts = [
        (1, extreme("Top", "orders", "o_orderpriority", exact("o_totalprice"), "k", single("v"))),
        (1, average("Mean", "orders", "o_orderpriority", exact("o_totalprice"))),
        (1, matching_sum("All", "orders", "o_orderpriority", "", "o_totalprice")),
        (3, peak("Peak", "orders", "o_orderdate", "o_totalprice", day("k"), single("v"))),
        (3, rate("Urgent", "orders", "o_orderpriority", "urgent")),
    ]
    return union(f"SELECT '{i}' AS spec_id, label, formatted, status FROM ({sql})" for i, sql in parts)


def run_series() -> str:
    parts = [
        (1, series("orders", "o_orderpriority", plain, [("o_totalprice", exact("o_totalprice"))])),
        (2, series("orders", "o_orderstatus", plain, [("Count", "count(*)")])),
        (3, series("orders", "o_orderdate", stamp, [("o_custkey", "CAST(sum(o_custkey) AS DOUBLE) / count(o_custkey)")])),
        (7, series("part", "p_brand", plain, [("p_size", "sum(p_size)"), ("p_name", "count(p_name)")])),
    ]
    return union(f"SELECT '{i}' AS spec_id, category, series, value FROM ({sql})" for i, sql in parts)


def spec_kpis() -> str:
    n = "CASE p_type WHEN 'ECONOMY' THEN 2 WHEN 'LARGE' THEN 1 ELSE 0 END"
    return f"SELECT p_partkey AS plan_id, 'ok' AS status, CAST({n} AS BIGINT) AS n_kpis FROM part"


MISSING_EVENTS = """(SELECT CASE WHEN event_type <> 'click' THEN event_type END AS kind,
  CASE WHEN event_type <> 'view' THEN value END AS value, ts FROM events)"""
NAN_EVENTS = "CASE WHEN value <= 20 THEN value END"
QUANTITY = "CASE WHEN l_linestatus = 'O' THEN l_quantity > 40 END"


def orders_rate(label, pattern):
    return rate(label, "orders", "o_orderpriority", pattern)


ORACLES = {
    "load_tables": union(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, CAST({len(schema(t))} AS INTEGER) AS columns FROM {t}" for t in TABLES
    ),
    "load_text_grid": "SELECT CAST(5 AS INTEGER) AS width, c_name AS name, c_mktsegment AS segment FROM customer",
    "load_text_table": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
      strftime(o_orderdate, '%m/%d/%Y') AS o_orderdate, o_orderpriority FROM orders""",
    "load_titled_files": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "load_multiline_cells": """SELECT doc_id, md5('"' || source || '",' || chr(10) || replace(text, chr(13), ' ')
      || chr(10) || 'end') AS digest FROM documents""",
    "load_compressed": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
    "load_long_ids": """SELECT CAST(1234567890123456789000000 AS DECIMAL(38,0)) + c_custkey AS id, c_name FROM customer""",
    "load_json_table": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
    "missing_values": f"""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'error') THEN event_type END AS kind,
      {NAN_EVENTS} AS value FROM events""",
    "empty_tables": union(
        f"SELECT '{t}{suffix}' AS \"table\", count({expr}) = 0 AS is_empty FROM {t}"
        for t in TABLES
        for suffix, expr in (("", schema(t)[0][0]), (" blanked", f"nullif({schema(t)[0][0]}, {schema(t)[0][0]})"))
    ),
    "header_detect": detected(10),
    "header_detect_off": f"SELECT source, header_row, score FROM ({detected(1)})",
    "header_promote": """SELECT c_name AS "Name", CAST(c_nationkey AS VARCHAR) AS "Nation",
      CAST(c_acctbal AS VARCHAR) AS "Balance" FROM customer""",
    "grid_table": """SELECT c_name AS "Name", CAST(c_nationkey AS BIGINT) AS "Nation", c_acctbal AS "Balance",
      c_mktsegment AS "Column_4", c_acctbal >= 0 AS "Name_2" FROM customer""",
    "empty_rows": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'",
    "empty_columns": "SELECT o_orderkey, o_orderstatus FROM orders",
    "column_names": """SELECT s_suppkey AS "Key", s_name AS "Column_2", s_nationkey AS "key_2", s_acctbal AS "Balance" FROM supplier""",
    "clean_all": """SELECT p_partkey AS p_partkey, p_type AS "Column_2", p_retailprice AS p_retailprice
      FROM part WHERE p_type <> 'PROMO'""",
    "workspace_gate": f"""SELECT CAST(sum(full_) AS BIGINT) AS tables, CAST(sum(full_ * columns) AS BIGINT) AS columns,
      sum(full_ * columns) > 0 AS usable, CASE WHEN sum(full_) = 0 THEN 'no table has rows'
      WHEN sum(full_ * columns) = 0 THEN 'no table has columns' ELSE 'ok' END AS reason FROM (
      {union(f"SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS full_, {len(schema(t))} AS columns FROM {t}" for t in TABLES)})""",
    "type_labels": type_labels(),
    "datetime_share": datetime_share(),
    "numeric_profile": union(numeric("lineitem", c, k) for c, k in schema("lineitem") if k in "if"),
    "medians": union(
        [
            f"""SELECT 'l_extendedprice' AS "column", count(l_extendedprice) AS non_null,
            {four('median(l_extendedprice)')} AS median FROM lineitem""",
            f"""SELECT 'returned' AS "column", count(l_quantity) AS non_null, {four('median(l_quantity)')} AS median
            FROM lineitem WHERE l_returnflag = 'R'""",
        ]
    ),
    "missing_share": union(
        f"SELECT \"column\", count, non_null, missing_pct, sum, mean FROM ({sql})"
        for sql in (numeric("events", "event_id", "i"), numeric(f"(SELECT {NAN_EVENTS} AS value FROM events)", "value", "f"))
    ),
    "categorical_profile": union(categorical("orders", c) for c in ("o_orderstatus", "o_orderpriority")),
    "long_text_profile": union(
        [*[categorical("documents", c) for c in ("text", "lang", "source")], *[categorical("pages", c) for c in ("url", "html")]]
    ),
    "frequent_values": union(top("part", c, 5) for c in ("p_name", "p_brand", "p_type")),
    "frequent_values_of_long_text": top("documents", "text", 10, "md5(value) AS digest"),
    "identifiers": union(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(DISTINCT {c}) AS unique_values,
        {ratio_ok(c)} AS identifier_like FROM {t}"""
        for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_brand"))
    ),
    "suppressed_values": union(
        [
            """SELECT 'c_name' AS "column", true AS identifier_like, CAST(NULL AS INTEGER) AS position,
            CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS count""",
            f"""SELECT "column", false AS identifier_like, CAST(rank - 1 AS INTEGER) AS position, value, count
            FROM ({top('customer', 'c_mktsegment', 5)})""",
        ]
    ),
    "datetime_profile": union([dates("lineitem", "l_shipdate"), dates("events", "ts")]),
    "inferred_datetime_profile": inferred_profile(),
    "boolean_profile": union(
        [
            boolean("(SELECT l_returnflag = 'R' AS b FROM lineitem)", "b", "returned"),
            boolean(f"(SELECT {QUANTITY} AS b FROM lineitem)", "b", "large_open"),
        ]
    ),
    "all_missing_profile": union(
        f"""SELECT '{c}' AS "column", '{label}' AS label, count(*) AS row_count, count(nullif({x}, {x})) AS count,
        count(nullif({x}, {x})) AS non_null, CAST(NULL AS DOUBLE) AS missing_pct, 'all values missing' AS note FROM orders"""
        for c, x, label in (
            ("o_custkey", "o_custkey", LABELS["i"]), ("o_totalprice", "o_totalprice", LABELS["f"]),
            ("o_orderdate", "o_orderdate", LABELS["d"]), ("o_orderstatus", "o_orderstatus", LABELS["t"]),
            ("flag", "(o_custkey > 5)", "boolean"),
        )
    ),
    "table_profile": table_profile("orders"),
    "empty_table_profile": """SELECT 'nothing' AS "table", count(*) AS row_count, CAST(0 AS INTEGER) AS column_count,
      CAST(NULL AS VARCHAR) AS "column", 'table is empty or has no data rows' AS note FROM orders WHERE o_totalprice < 0""",
    "workspace_profile": workspace_profile(),
    "refreshed_profile": table_profile("orders"),
    "value_texts": f"SELECT event_id, {four('value / 7')} AS seventh, {iso('ts')} AS ts FROM events",
    "condensed_profile": condensed("orders"),
    "json_profile": f"""SELECT 'customer' AS "table", CAST(count(*) AS VARCHAR) AS rows, '5' AS columns,
      CAST(sum(c_custkey) AS VARCHAR) AS key_sum, CASE WHEN {ratio_ok('c_name')} THEN 'true' ELSE 'false' END AS name_flag,
      CAST(NULL AS VARCHAR) AS name_values, CAST(NULL AS VARCHAR) AS promo, CAST(NULL AS VARCHAR) AS size_type FROM customer
      UNION ALL SELECT 'part', CAST(count(*) AS VARCHAR), '6', NULL, NULL, NULL, (
        SELECT CAST(count AS VARCHAR) FROM ({top('part', 'p_type', 5)}) WHERE value = 'PROMO'), 'numeric (integer)' FROM part""",
    "identifier_guard": f"""SELECT c_custkey AS spec_id, CASE WHEN c_acctbal >= 0
      AND (SELECT {ratio_ok('c_name')} FROM customer) THEN '' ELSE 'C_Name ,' END
      || c_mktsegment || ',c_mktsegment' AS data_columns FROM customer""",
    "fence_strip": "SELECT doc_id, md5('[' || text || ']') AS digest FROM documents",
    "spec_parse": parsed_plans(),
    "spec_parse_strict": f"SELECT plan_id, spec_idx, status FROM ({parsed_plans(strict=True)})",
    "spec_required_keys": """SELECT p_partkey AS plan_id, CASE WHEN p_size > 30 THEN 'ok'
      WHEN p_size > 20 THEN 'error: missing keys: data_columns'
      WHEN p_size > 10 THEN 'error: missing keys: chart_type, data_columns'
      ELSE 'error: missing keys: chart_type, data_columns, source_sheet' END AS status FROM part""",
    "spec_kpis": spec_kpis(),
    "spec_chart_type": """SELECT plan_id, CASE WHEN chart_type IN ('bar', 'pie', 'table') THEN 'ok'
      ELSE 'error: unknown chart type' END AS status, chart_type FROM (SELECT p_partkey AS plan_id,
      CASE p_type WHEN 'ECONOMY' THEN 'bar' WHEN 'STANDARD' THEN 'pie' WHEN 'PROMO' THEN 'table' ELSE lower(p_type) END
      AS chart_type FROM part)""",
    "spec_data_columns": """SELECT p_partkey AS plan_id,
      CASE WHEN p_size > 25 THEN p_brand ELSE p_brand || ',p_size' END AS data_columns FROM part""",
    "column_resolution": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' O_TotalPrice'
      WHEN '2-HIGH' THEN 'o_order' || chr(9) || 'date ' WHEN '3-MEDIUM' THEN 'o order key' ELSE o_orderpriority END AS requested,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'o_totalprice' WHEN '2-HIGH' THEN 'o_orderdate' END AS matched FROM orders""",
    "kpi_extreme_max": union(
        [
            extreme("Top", "part", "p_brand", exact("p_retailprice"), "k", single("v")),
            extreme("Rows", "part", "p_brand", "count(p_name)", "k", whole("v")),
            extreme("Largest", "part", "p_brand", "max(p_size)", "k", whole("v")),
        ]
    ),
    "kpi_extreme_min": union(
        [
            extreme("Least", "part", "p_brand", exact("p_retailprice"), "k", single("v"), "min"),
            extreme("Mean", "part", "p_type", "CAST(sum(p_size) AS DOUBLE) / count(p_size)", "k", single("v"), "min"),
            extreme("Small", "part", "p_name", "min(p_retailprice)", "k", single("v"), "min"),
        ]
    ),
    "kpi_extreme_date": union(
        [
            extreme("Last day", "orders", "o_custkey", "max(o_orderdate)", plain("k"), day("v"), "max", "NULL"),
            extreme("First day", "orders", "o_custkey", "min(o_orderdate)", plain("k"), day("v"), "min", "NULL"),
            extreme("Whole", "orders", "o_orderstatus", "sum(o_custkey)", "k", whole("v")),
        ]
    ),
    "kpi_extreme_text": union(
        [
            extreme("Text", "orders", "o_custkey", "max(o_orderpriority)", plain("k"), "v", "max", "NULL"),
            extreme("Day", "orders", "o_orderdate", exact("o_totalprice"), day("k"), single("v")),
        ]
    ),
    "kpi_avg_per_group": union(
        [
            average("Balance", "customer", "c_mktsegment", exact("c_acctbal")),
            average("Mean", "customer", "c_nationkey", avg("c_acctbal")),
            average("Rows", "customer", "c_mktsegment", "count(c_name)"),
        ]
    ),
    "kpi_filtered_rate": union(
        [orders_rate("Urgent or high", "urgent|high"), orders_rate("Nothing", "^x"), orders_rate("All", "")]
    ),
    "kpi_filtered_sum": union(
        [
            matching_sum("Urgent or high", "orders", "o_orderpriority", "urgent|high", "o_totalprice"),
            matching_sum("Keys", "orders", "o_orderstatus", "[fo]", "o_custkey", True),
            matching_sum("None", "orders", "o_orderstatus", "x", "o_totalprice"),
        ]
    ),
    "kpi_filtered_text": union(
        [
            rate("Words", "documents", "text", "the [a-z]+ing"),
            matching_sum("Characters", "documents", "text", "license", "n_chars", True),
        ]
    ),
    "kpi_peak_point": union(
        [
            peak("Peak", "orders", "o_orderdate", "o_totalprice", day("k"), single("v")),
            peak("Key", "orders", "o_orderpriority", "o_orderkey", "k", whole("v")),
            peak("Last day", "orders", "o_orderkey", "o_orderdate", plain("k"), day("v"), "NULL"),
        ]
    ),
    "kpi_rules": union(
        [
            matching_sum("Urgent", "orders", "o_orderpriority", "urgent", "o_totalprice"),
            skipped("Broken", "'extreme_category'", "unknown column in value_col"),
            skipped("Fourth", "'filtered_rate'", "beyond the first 3"),
        ]
    ),
    "kpi_failures": union(
        [
            skipped("Unknown", "'median_per_group'", "unknown type"),
            skipped("Pattern", "'filtered_rate'", "bad pattern"),
            skipped("Not text", "'filtered_rate'", "not text"),
        ]
    ),
    "kpi_missing": f"""SELECT label, key, value, formatted, status FROM ({union([
        extreme("Least", MISSING_EVENTS, "kind", exact("value"), "k", single("v"), "min"),
        extreme("Least mean", MISSING_EVENTS, "kind", avg("value"), "k", single("v"), "min"),
        average("Mean of sums", MISSING_EVENTS, "kind", exact("value")),
    ])})""",
    "value_formats": f"""SELECT l_orderkey, l_linenumber, {single('l_extendedprice')} AS kpi_l_extendedprice,
      {two('l_extendedprice')} AS fact_l_extendedprice, {single('l_quantity')} AS kpi_l_quantity,
      {two('l_quantity')} AS fact_l_quantity, {whole('l_partkey')} AS kpi_l_partkey, {whole('l_partkey')} AS fact_l_partkey,
      {day('l_shipdate')} AS kpi_l_shipdate, CAST(l_extendedprice AS VARCHAR) AS plain FROM lineitem""",
    "facts_sum": ORDERS_FACTS,
    "facts_whole": facts("lineitem", "l_shipdate", "sum(l_partkey)", "sum(v)", stamp, whole),
    "facts_count": facts("events", "event_type", "count(props)", "sum(v)", plain, whole),
    "facts_rows": facts("events", "event_type", "count(*)", "sum(v)", plain, whole),
    "facts_numbers": f"""{ranked("orders", "o_custkey", exact("o_totalprice"), EXACT_TOTAL)}
      SELECT max(CASE WHEN rn = 1 THEN CAST(k AS VARCHAR) END) AS top_category, max(CASE WHEN rn = 1 THEN v END) AS top_number,
      max(CASE WHEN rn = 2 THEN CAST(k AS VARCHAR) END) AS second_category, max(CASE WHEN rn = 2 THEN v END) AS second_number,
      max(CASE WHEN rn = n THEN CAST(k AS VARCHAR) END) AS bottom_category, max(CASE WHEN rn = n THEN v END) AS bottom_number,
      max(tot) AS total_number, max(n) AS count_number FROM r""",
    "column_roles": f"SELECT l_returnflag AS category, {exact('l_quantity')} AS value FROM lineitem GROUP BY l_returnflag",
    "category_totals": f"SELECT o_custkey AS category, {exact('o_totalprice')} AS value FROM orders GROUP BY o_custkey",
    "template_fill": template(),
    "template_leftovers": """SELECT conv_id, turn, md5(t) AS digest FROM (
      SELECT conv_id, turn, CASE WHEN role = 'user' THEN text || ' {{COUNT}}' ELSE text END AS t FROM conversations)
      WHERE contains(t, '{{')""",
    "series_bar": series(
        "lineitem", "l_returnflag", plain,
        [("l_quantity", exact("l_quantity")), ("l_extendedprice", exact("l_extendedprice")), ("l_linestatus", "count(l_linestatus)")],
    ),
    "series_pie": series("orders", "o_orderpriority", plain, [("o_totalprice", exact("o_totalprice"))]),
    "series_counts": series("part", "p_type", plain, [("Count", "count(*)")]),
    "series_dates": series("orders", "o_orderdate", stamp, [("o_custkey", "sum(o_custkey)")]),
    "series_line_mean": series(
        "(SELECT o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)", "o_orderdate", stamp,
        [("cents", "CAST(sum(cents) AS DOUBLE) / count(cents)")],
    ),
    "series_line_rows": """WITH s AS (SELECT o_orderpriority AS category, count(*) AS orders, max(o_totalprice) AS largest
      FROM orders GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY category) - 1 AS ord FROM s)
      SELECT ord, category, 'orders' AS series, CAST(orders AS DOUBLE) AS value FROM n
      UNION ALL SELECT ord, category, 'largest', largest FROM n""",
    "series_line_gaps": f"""SELECT p_brand AS category, 'price' AS series, coalesce({avg("CASE WHEN p_brand <> 'Brand#7' THEN p_retailprice END")},
      CAST(0 AS DOUBLE)) AS value FROM part GROUP BY p_brand""",
    "series_booleans": """SELECT CASE WHEN large THEN 'True' ELSE 'False' END AS category, series, CAST(value AS DOUBLE) AS value FROM (
      SELECT l_quantity > 25 AS large, 'returned' AS series, count(*) FILTER (WHERE l_returnflag = 'R') AS value FROM lineitem GROUP BY 1
      UNION ALL SELECT l_quantity > 25, 'l_shipdate', count(l_shipdate) FROM lineitem GROUP BY 1)""",
    "datetime_any_order": """SELECT s.sorted, 'datetime (inferred)' AS label, count(*) FILTER (o_orderkey % 10 > 0) AS non_null,
      strftime(min(date_trunc('day', o_orderdate)) FILTER (o_orderkey % 10 > 0), '%Y-%m-%dT%H:%M:%S') AS min_date
      FROM orders, (VALUES ('up'), ('down')) s(sorted) GROUP BY s.sorted""",
    "datetime_zones": """SELECT 'datetime (inferred)' AS label, count(*) AS non_null,
      strftime(max(date_trunc('second', ts)), '%Y-%m-%dT%H:%M:%S') AS max_date FROM events""",
    "series_positions": "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR) AS category, 'o_totalprice' AS series, o_totalprice AS value FROM orders",
    "table_extract": "SELECT s_name, s_acctbal, s_nationkey FROM supplier",
    "table_cells": f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {stamp('ts')} AS ts,
      CASE WHEN value <= 20 THEN {two('value')} ELSE '—' END AS value,
      CASE WHEN event_type <> 'click' THEN event_type ELSE '—' END AS kind,
      CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS high FROM events""",
    "run_status": run_status(),
    "run_kpis": run_kpis(),
    "run_facts": run_facts([(1, ORDERS_FACTS), (2, STATUS_FACTS), (3, DAY_FACTS), (4, SUPPLIER_FACTS), (7, BRAND_FACTS)]),
    "run_series": run_series(),
    "run_tables": f"""SELECT '4' AS spec_id, 's_name|s_acctbal' AS names, s_name || '|' || {two('s_acctbal')} AS cells FROM supplier""",
}

ROUNDED = [n for n in ORACLES if n.startswith(("kpi_", "series_")) and n not in ("series_line_rows", "series_positions", "series_booleans", "series_line_mean")]
for _name in [*ROUNDED, "run_series", "column_roles", "category_totals"]:
    ORACLES[_name] = f"SELECT * REPLACE ({four('value')} AS value) FROM ({ORACLES[_name]})"
_numbers = ", ".join(f"{four(n)} AS {n}" for n in ("top_number", "second_number", "bottom_number", "total_number"))
ORACLES["facts_numbers"] = f"SELECT * REPLACE ({_numbers}) FROM ({ORACLES['facts_numbers']})"
