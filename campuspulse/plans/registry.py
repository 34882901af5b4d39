"""Query registry and the SQL fragments the check queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from campuspulse.functions.exprs import round_doubles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_RECURSIVE: set[str] = set()

_SCORE = "(CAST(round((c_acctbal + 1000) * 100) AS BIGINT) * 2 + 110) // 220 / 100.0"

# Common table expressions over the raw tables, in dependency order.
CTES = {
    "enr": f"""
        SELECT n_regionkey AS course_id, c_custkey AS user_id, n_nationkey AS account_id, c_mktsegment AS program,
               {_SCORE} AS final_score,
               CASE WHEN c_mktsegment <> 'FURNITURE' THEN {_SCORE} END AS current_score
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "act": """
        SELECT e.course_id, event_id, events.user_id, ts, event_type AS kind,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS resource_id, value AS seconds
        FROM events JOIN enr e ON e.user_id = events.user_id""",
    "hourly": """
        SELECT course_id, user_id, date_trunc('hour', ts) AS hour, min(ts) AS first_ts, max(ts) AS last_ts,
               count(*) AS cnt FROM act GROUP BY ALL""",
    "gaps": """
        SELECT course_id, user_id, event_id, ts,
               date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 3600000000.0 AS gap
        FROM act""",
    "sess": """
        SELECT course_id, user_id, count(*) AS n,
               count(*) FILTER (gap >= 1) AS inter,
               min(gap) FILTER (gap >= 1) AS gmin, max(gap) FILTER (gap >= 1) AS gmax,
               coalesce(avg(gap) FILTER (gap >= 1), 0) AS gmean,
               coalesce(stddev_pop(gap) FILTER (gap >= 1), 0) AS gstd
        FROM gaps GROUP BY ALL""",
    "weekly": """
        SELECT course_id, user_id, week(ts) AS week, count(*) AS cnt FROM act GROUP BY ALL""",
    "series": """
        SELECT *, row_number() OVER w - 1 AS x, count(*) OVER (PARTITION BY user_id) AS n,
               avg(cnt) OVER (PARTITION BY user_id) AS mean_cnt, cnt - lag(cnt) OVER w AS diff
        FROM weekly WINDOW w AS (PARTITION BY user_id ORDER BY week)""",
    "series2": """
        SELECT *, lag(diff) OVER (PARTITION BY user_id ORDER BY week) AS prev_diff FROM series""",
    "tods": """
        SELECT course_id, user_id,
               count(*) FILTER (hour(ts) BETWEEN 6 AND 11) AS morning_activity,
               count(*) FILTER (hour(ts) BETWEEN 12 AND 17) AS afternoon_activity,
               count(*) FILTER (hour(ts) BETWEEN 18 AND 21) AS evening_activity,
               count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) AS night_activity,
               count(DISTINCT date_trunc('hour', ts)) AS unique_active_hours
        FROM act GROUP BY ALL""",
    "tod": """
        SELECT *, greatest(morning_activity, afternoon_activity, evening_activity, night_activity) AS best,
               CASE WHEN morning_activity >= greatest(afternoon_activity, evening_activity, night_activity) THEN 'morning'
                    WHEN afternoon_activity >= greatest(evening_activity, night_activity) THEN 'afternoon'
                    WHEN evening_activity >= night_activity THEN 'evening' ELSE 'night' END AS dominant_time
        FROM tods""",
    "sub": """
        SELECT e.course_id, e.user_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS assignment_id, o_orderkey AS submission_id,
               CASE WHEN o_orderstatus = 'F' THEN least(100.0, (CAST(round(o_totalprice * 100) AS BIGINT) * 2 + 5000) // 10000 / 100.0) END AS score,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS submitted_at,
               CASE WHEN substr(o_orderpriority, 1, 1) <> '5' THEN date_trunc('month', o_orderdate) + INTERVAL 19 DAY END AS due_at,
               CASE o_orderstatus WHEN 'F' THEN 'graded' WHEN 'O' THEN 'submitted' ELSE 'unsubmitted' END AS workflow_state
        FROM orders JOIN enr e ON o_custkey = e.user_id""",
    "tard": """
        SELECT o_custkey AS user_id, count(*) FILTER (l_returnflag = 'N') AS on_time,
               count(*) FILTER (l_returnflag = 'R') AS late, count(*) FILTER (l_returnflag = 'A') AS missing
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "prog": """
        SELECT e.course_id, e.user_id, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS module_id,
               CASE WHEN max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'completed' ELSE 'started' END AS state,
               min(CASE WHEN l_linestatus = 'F' OR l_returnflag <> 'N' THEN l_shipdate END) AS completed_at,
               count(*) AS items_count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN enr e ON o_custkey = e.user_id GROUP BY 1, 2, 3""",
    "ranked": """
        SELECT *, CASE WHEN completers > 1 THEN (rk - 1) / (completers - 1.0) ELSE 0.5 END AS norm_rank
        FROM (SELECT *, CASE WHEN completed_at IS NOT NULL THEN
                          rank() OVER (PARTITION BY course_id, module_id ORDER BY completed_at NULLS LAST) END AS rk,
                     count(*) FILTER (state = 'completed') OVER (PARTITION BY course_id, module_id) AS completers
              FROM prog)""",
    "modt": """
        SELECT course_id, user_id, count(*) FILTER (state = 'completed') AS modules_completed, count(*) AS modules_total,
               min(completed_at) FILTER (state = 'completed') AS first_done, max(completed_at) FILTER (state = 'completed') AS last_done,
               coalesce(avg(norm_rank) FILTER (state = 'completed'), 0.5) AS avg_completion_rank
        FROM ranked GROUP BY ALL""",
    "totals": """
        SELECT course_id, user_id, count(*) AS page_views, count(*) FILTER (kind IN ('purchase', 'signup')) AS participations,
               sum(seconds) AS total_activity_time FROM act GROUP BY ALL""",
    "rawgap": """
        SELECT course_id, user_id, coalesce(avg(g) FILTER (g > 0.5), 0) AS avg_gap_hours,
               coalesce(stddev_pop(g) FILTER (g > 0.5), 0) AS gap_std_hours,
               date_diff('hour', min(hour), max(hour)) // 24 AS activity_span_days, count(*) AS unique_active_hours
        FROM (SELECT *, date_diff('hour', lag(hour) OVER (PARTITION BY user_id ORDER BY hour), hour) AS g FROM hourly)
        GROUP BY ALL""",
    "res": """
        SELECT section_id, coalesce(students, 0) AS students, modules, assignments, quizzes, pages, files, discussions,
               modules + assignments + quizzes + pages + files + discussions AS total_resources
        FROM (SELECT CAST(p_size AS BIGINT) AS section_id,
                     count(*) FILTER (p_type = 'ECONOMY') AS modules, count(*) FILTER (p_type = 'STANDARD') AS assignments,
                     count(*) FILTER (p_type = 'SMALL') AS quizzes, count(*) FILTER (p_type = 'MEDIUM') AS pages,
                     count(*) FILTER (p_type = 'LARGE') AS files, count(*) FILTER (p_type = 'PROMO') AS discussions
              FROM part GROUP BY 1)
        LEFT JOIN (SELECT c_custkey % 50 + 1 AS section_id, count(*) AS students FROM customer GROUP BY 1) USING (section_id)""",
}
_NEEDS = {
    "act": ["enr"], "hourly": ["act"], "gaps": ["act"], "sess": ["gaps"], "weekly": ["act"], "series": ["weekly"],
    "series2": ["series"], "tods": ["act"], "tod": ["tods"], "sub": ["enr"], "prog": ["enr"], "ranked": ["prog"],
    "modt": ["ranked"], "totals": ["act"], "rawgap": ["hourly"],
}


def add_cte(name: str, sql: str, needs: list[str], recursive: bool = False) -> None:
    CTES[name] = sql
    _NEEDS[name] = needs
    if recursive:
        _RECURSIVE.add(name)


def sql_with(needs: str, body: str) -> str:
    """``body`` preceded by the named table expressions and what they build on."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for parent in _NEEDS.get(name, []):
                visit(parent)

    for name in needs.split():
        visit(name)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in wanted]
    head = "WITH RECURSIVE" if wanted & _RECURSIVE else "WITH"
    return f"{head} {', '.join(parts)} {body}" if parts else body


def rnd(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def _simpson(f: str, upper: str, steps: int = 2000) -> str:
    """Simpson's rule for ``f`` of ``u`` from 0 to ``upper`` as a correlated subquery."""
    u = f"(({upper}) * i / {steps}.0)"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"((SELECT sum({weight} * {f.replace('$u', u)}) FROM range({steps + 1}) r(i)) * ({upper}) / {steps * 3}.0)"


def sql_t_p(t: str, df: str) -> str:
    """Two-sided t tail by integrating the density: SQL has no t distribution."""
    front = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    return f"(1 - 2 * {front} * {_simpson(f'pow(1 + $u * $u / ({df}), -(({df}) + 1) / 2.0)', f'abs({t})')})"


def sql_chi2_p(x: str, df: str) -> str:
    """Upper chi-square tail; x = u * u keeps the integrand smooth at zero."""
    front = f"exp(-lgamma(({df}) / 2.0) - (({df}) / 2.0 - 1) * ln(2.0))"
    return f"(1 - {front} * {_simpson(f'pow($u, ({df}) - 1.0) * exp(-$u * $u / 2)', f'sqrt({x})')})"


def sql_z_p(z: str) -> str:
    return f"(1 - 2 / sqrt(2 * pi()) * {_simpson('exp(-$u * $u / 2)', z)})"


def query(name: str, needs: str = "", sql: str | None = None, digits: int = 6):
    """Register a query; its doubles are rounded as the SQL twin rounds them."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql_with(needs, sql)
        return fn

    return register
