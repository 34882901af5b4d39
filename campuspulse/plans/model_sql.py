"""SQL twins of the closed-form models: frames, normal equations and Newton steps as list arithmetic.

A linear system is a list of rows with the right-hand side last; ``solved`` nests one SELECT per pivot. Pivots need no search: all systems are
positive definite.
"""

from __future__ import annotations

from campuspulse.plans.registry import add_cte

STEPS = 9
SEED = 42

add_cte("csfr", """
    SELECT csf.*, min_score, max_score, coalesce(num_graded, 0) AS num_graded, CASE WHEN final_score < 57 THEN 1 ELSE 0 END AS failed, on_time + late + missing AS due,
           CASE WHEN due > 0 THEN on_time / due ELSE 0 END AS on_time_rate, CASE WHEN due > 0 THEN late / due ELSE 0 END AS late_rate,
           CASE WHEN due > 0 THEN missing / due ELSE 0 END AS missing_rate
    FROM csf LEFT JOIN (SELECT user_id, min_score, max_score, num_graded FROM subst) USING (user_id) WHERE final_score IS NOT NULL""", ["csf", "subst"])

_SHUFFLED = f"CAST((row_number() OVER (PARTITION BY failed ORDER BY md5('{SEED}:' || course_id || ':' || user_id)) - 1) % 5 AS INTEGER)"
_CONTIGUOUS = """CASE WHEN least(5, n // 3) < 2 THEN NULL WHEN i < n % least(5, n // 3) * (n // least(5, n // 3) + 1) THEN i // (n // least(5, n // 3) + 1)
    ELSE n % least(5, n // 3) + (i - n % least(5, n // 3) * (n // least(5, n // 3) + 1)) // (n // least(5, n // 3)) END"""


def add_frame(name: str, features: list[str], within: bool = False, complete: bool = False) -> None:
    """(course_id, user_id, final_score, failed, x, fold): x is 1 and the features, imputed by medians (of the course if ``within``)
    and standardised within the course; folds are shuffled and stratified, or contiguous in each course if ``within``."""
    median = "quantile_cont(CAST({f} AS DOUBLE), 0.5) OVER (PARTITION BY course_id)" if within else "(SELECT quantile_cont(CAST({f} AS DOUBLE), 0.5) FROM csfr)"
    filled = ", ".join(f"coalesce(CAST({f} AS DOUBLE), {median.format(f=f)}, 0) AS {f}" for f in features)
    keep = "WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in features) if complete else ""
    add_cte(f"{name}_i", f"SELECT course_id, user_id, final_score, failed, {filled} FROM csfr {keep}", ["csfr"])
    scaled = ", ".join(f"CASE WHEN stddev_pop({f}) OVER c > 0 THEN ({f} - avg({f}) OVER c) / stddev_pop({f}) OVER c ELSE 0 END" for f in features)
    fold = f"CAST({_CONTIGUOUS} AS INTEGER)" if within else _SHUFFLED
    add_cte(name, f"""SELECT course_id, user_id, final_score, failed, x, {fold} AS fold FROM (
        SELECT *, [1.0::DOUBLE, {scaled}] AS x, count(*) OVER c AS n, row_number() OVER (PARTITION BY course_id ORDER BY user_id) - 1 AS i
        FROM {name}_i WINDOW c AS (PARTITION BY course_id))""", [f"{name}_i"])


def solved(sql: str, size: int) -> str:
    """``sql`` with its column ``m``, a list of ``size`` rows, brought to the unit matrix; the last column is the solution."""
    for k in range(1, size + 1):
        sql = f"""SELECT * REPLACE (list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / m[{k}][{k}])
            ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m) FROM ({sql})"""
    return sql


def add_logistic(name: str, frame: str, p: int) -> None:
    """(m, t, w): weights after ``STEPS`` Newton steps of the model without fold m, and of all rows for m = -1."""
    size = p + 1
    sums = f"""
        SELECT m, t, w, i, j, CASE WHEN j = {size + 1} THEN sum(cw * (failed - pr) * x[i]) - CASE WHEN i > 1 THEN w[i] ELSE 0 END
               ELSE sum(cw * pr * (1 - pr) * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END END AS s
        FROM (SELECT l.m, l.t, l.w, f.x, f.failed, 1 / (1 + exp(-list_dot_product(f.x, l.w))) AS pr, c.cw
              FROM {name} l JOIN {frame} f ON f.fold <> l.m JOIN {name}_cw c ON c.m = l.m AND c.failed = f.failed WHERE l.t < {STEPS}),
             range(1, {size + 1}) a(i), range(1, {size + 2}) b(j) GROUP BY m, t, w, i, j"""
    rows = f"SELECT m, t, w, i, list(s ORDER BY j) AS r FROM ({sums}) GROUP BY m, t, w, i"
    system = f"SELECT m AS model, t, w, list(r ORDER BY i) AS m FROM ({rows}) GROUP BY model, t, w"
    add_cte(f"{name}_cw", f"""SELECT m, failed, sum(count(*)) OVER (PARTITION BY m) / (2.0 * count(*)) AS cw
        FROM {frame}, range(-1, 5) q(m) WHERE fold <> m GROUP BY m, failed""", [frame])
    add_cte(name, f"""SELECT m, 0 AS t, list_transform(range({size}), lambda i: CAST(0 AS DOUBLE)) AS w FROM range(-1, 5) q(m)
        UNION ALL SELECT model, t + 1, list_transform(w, lambda v, i: v + m[i][{size + 1}]) FROM ({solved(system, size)})""", [f"{name}_cw", frame], recursive=True)
    add_cte(f"{name}_oof", f"""SELECT f.course_id, f.user_id, f.final_score, f.failed, f.fold, round(1 / (1 + exp(-list_dot_product(f.x, l.w))), 10) AS probability,
        CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction FROM {frame} f JOIN {name} l ON l.m = f.fold AND l.t = {STEPS}""", [name])


def add_ridge(name: str, frame: str, p: int, by: str = "", alpha: float = 1.0, pick: list[int] | None = None) -> None:
    """(by, fold, c, g): the model without each fold (fold -1: of all rows) as c = (-intercept, -coefficients, 1), and the fold's own sums g.

    ``pick`` chooses features by place (from 1).
    """
    pick = pick or list(range(1, p + 1))
    z = f"list_concat(list_transform([{', '.join(map(str, [1, *(i + 1 for i in pick)]))}], lambda k: x[k]), [final_score])"
    size = len(pick) + 1
    lead, keys = (f"{by}, ", f"{by}, fold") if by else ("", "fold")
    same = f"AND a.{by} = b.{by}" if by else ""
    add_cte(f"{name}_g", f"""SELECT {keys}, list(r ORDER BY i) AS g FROM (SELECT {keys}, i, list(s ORDER BY j) AS r FROM (
        SELECT {keys}, i, j, sum(z[i] * z[j]) AS s FROM (SELECT {keys}, {z} AS z FROM {frame}), range(1, {size + 2}) a(i), range(1, {size + 2}) b(j) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""", [frame])
    total = f"""SELECT {lead}fold, g, list(r ORDER BY i) AS m FROM (SELECT {lead}fold, g, i, list(s ORDER BY j) AS r FROM (
        SELECT {'a.' + lead if by else ''}a.fold, a.g, i, j, sum(b.g[i][j]) + CASE WHEN i = j AND i > 1 AND j < {size + 1} THEN {alpha} ELSE 0 END AS s
        FROM (SELECT {keys}, g FROM {name}_g UNION ALL SELECT DISTINCT {lead}-1, NULL FROM {name}_g) a JOIN {name}_g b ON b.fold IS DISTINCT FROM a.fold {same},
             range(1, {size + 1}) c(i), range(1, {size + 2}) d(j) GROUP BY {'a.' + lead if by else ''}a.fold, a.g, i, j) GROUP BY ALL) GROUP BY ALL"""
    add_cte(name, f"SELECT {lead}fold, g, list_concat(list_transform(m, lambda r: -r[{size + 1}]), [1.0]) AS c FROM ({solved(total, size)})", [f"{name}_g"])
    fits = f"""(SELECT {lead}fold, 1 - list_sum(list_transform(c, lambda v, i: v * list_dot_product(g[i], c))) / (g[{size + 1}][{size + 1}] - g[1][{size + 1}] ** 2 / g[1][1]) AS r2
        FROM {name} WHERE fold >= 0)"""
    add_cte(f"{name}_r2", f"SELECT {lead}avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, CAST(count(*) AS INTEGER) AS folds FROM {fits} GROUP BY ALL", [name])
