"""SQL that fits the same models by another road: elimination in recursive queries.

Cross products are kept as (i, j, v) rows.  A recursive query sweeps one
predictor per step, and the variance ratio is found by repeated grid search, so
the oracle shares neither code nor method with the library.
"""

from __future__ import annotations

from collections.abc import Sequence

STAGES = 5
# Spacing of the second and third grid, in powers of ten.
STEPS = (0.005, 0.0001)
# Spacing of the points of the last, differencing step.
STENCIL = 0.001


def _cells(columns: Sequence[str]) -> str:
    m = len(columns)
    cells = [
        f"{{'i': {i}, 'j': {j}, 'v': sum(CAST(({columns[i]}) * ({columns[j]}) AS DOUBLE))}}"
        for i in range(m)
        for j in range(m)
    ]
    return "[" + ", ".join(cells) + "]"


def _sweep(name: str, gram: str, keys: str, predictors: int, mask: str | None = None) -> str:
    """Recursive sweep of ``gram(keys, i, j, v)``; ``mask`` says which steps a model takes."""
    skip = f"WHEN NOT ({mask}) THEN v " if mask else ""
    log_step = f"CASE WHEN {mask} THEN ln(pv) ELSE 0 END" if mask else "ln(pv)"
    return f"""{name} AS (
  SELECT 0 AS step, {keys}, i, j, v, CAST(0 AS DOUBLE) AS logdet FROM {gram}
  UNION ALL
  SELECT step + 1, {keys}, i, j,
    CASE {skip}WHEN i = step AND j = step THEN -1 / pv WHEN i = step OR j = step THEN v / pv
         ELSE v - rv * cv / pv END,
    logdet + {log_step}
  FROM (SELECT *, max(CASE WHEN i = step AND j = step THEN v END) OVER (PARTITION BY {keys}) AS pv,
               max(CASE WHEN i = step THEN v END) OVER (PARTITION BY {keys}, j) AS rv,
               max(CASE WHEN j = step THEN v END) OVER (PARTITION BY {keys}, i) AS cv
        FROM {name} WHERE step < {predictors}))"""


def linear_ctes(frame: str, xs: Sequence[str], ys: Sequence[str]) -> str:
    """``gram``, ``swept`` (all steps) and ``dims(n, p)`` of a linear model."""
    columns = ["1.0", *xs, *ys]
    p = len(xs) + 1
    return f"""gram AS (SELECT 0 AS model, unnest({_cells(columns)}, recursive := true) FROM {frame}),
{_sweep('swept', 'gram', 'model', p)},
dims AS (SELECT v AS n, {p} AS p FROM gram WHERE i = 0 AND j = 0)"""


def names_cte(names: Sequence[str], label: str = "names") -> str:
    values = ", ".join(f"({k}, '{n}')" for k, n in enumerate(names))
    return f"{label}(k, term) AS (VALUES {values})"


def t_tail(t: str, df: str) -> str:
    """Two-sided t tail by Simpson's rule in the angle."""
    a = f"atan(abs({t}) / sqrt({df}))"
    weight = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    integral = (
        f"list_sum(list_transform(range(0, 2001), lambda k: ({weight}) * pow(cos(k * {a} / 2000), {df} - 1)))"
        f" * {a} / 6000"
    )
    return f"greatest(0.0, 1 - {integral} * 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()))"


def f_tail(f: str, df1: str, df2: str) -> str:
    """Upper F tail by Simpson's rule in the angle whose squared tangent is f * df1 / df2."""
    a = f"atan(sqrt({f} * {df1} / {df2}))"
    weight = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    integral = (
        f"list_sum(list_transform(range(0, 2001), lambda k: ({weight}) * pow(sin(k * {a} / 2000), {df1} - 1)"
        f" * pow(cos(k * {a} / 2000), {df2} - 1))) * {a} / 6000"
    )
    return (
        f"greatest(0.0, 1 - {integral} * 2 * exp(lgamma(({df1} + {df2}) / 2.0) - lgamma({df1} / 2.0) - lgamma({df2} / 2.0)))"
    )


def t_quantile_cte(df: str, source: str, level: float = 0.95, label: str = "quantiles") -> str:
    """``label(df, t)``: two-sided t quantiles of the distinct ``df`` of ``source``, by Newton steps on the tail."""
    density = f"exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi() * df) * pow(1 + t * t / df, -(df + 1) / 2.0)"
    return f"""newton_{label} AS (
  SELECT 0 AS turn, df, CAST(1 AS DOUBLE) AS t FROM (SELECT DISTINCT CAST({df} AS DOUBLE) AS df FROM {source}) WHERE df >= 1
  UNION ALL
  SELECT turn + 1, df, t + ({t_tail('t', 'df')} - {1 - level!r}) / (2 * {density}) FROM newton_{label} WHERE turn < 12),
{label} AS (SELECT df, t FROM newton_{label} WHERE turn = 12)"""


def mixed_ctes(
    frame: str, site: str, xs: Sequence[str], y: str, reml: bool, prefix: str = "", subsets: str | None = None
) -> str:
    """CTEs of a random-intercept fit of every listed subset of the predictors.

    ``subsets`` is SQL that gives a ``subset`` column of bit sets; by default
    only the full model.  Ends with ``best(subset, theta, ll)``, ``final(subset,
    theta, i, j, v)`` (swept cross products at the best theta), ``sm`` (site moments)
    and ``dims(n, g)``.
    """
    P = prefix
    columns = ["1.0", *xs, y]
    p = len(xs) + 1
    subsets = subsets or f"SELECT {2 ** len(xs) - 1} AS subset"
    mask = "step = 0 OR (subset >> (step - 1)) & 1 = 1"
    rank = "(1 + bit_count(subset))"
    d = f"(n - {rank})" if reml else "n"
    parts = [
        f"{P}sm AS (SELECT site, i, j, v FROM (SELECT {site} AS site, "
        f"unnest({_cells(columns)}, recursive := true) FROM {frame} GROUP BY {site}))",
        f"{P}s0 AS (SELECT site, j AS k, v FROM {P}sm WHERE i = 0)",
        f"{P}sizes AS (SELECT v AS n, count(*) AS sites FROM {P}s0 WHERE k = 0 GROUP BY v)",
        f"{P}dims AS (SELECT sum(n * sites) AS n, sum(sites) AS g FROM {P}sizes)",
        f"""{P}pool AS (SELECT c.v AS n, m.i, m.j, sum(a.v * b.v) AS b, sum(m.v) AS s
  FROM {P}sm m JOIN {P}s0 a ON a.site = m.site AND a.k = m.i JOIN {P}s0 b ON b.site = m.site AND b.k = m.j
  JOIN {P}s0 c ON c.site = m.site AND c.k = 0 GROUP BY c.v, m.i, m.j)""",
        f"""{P}th0 AS (SELECT subset, theta FROM ({subsets}),
  (SELECT CAST(0 AS DOUBLE) AS theta UNION ALL SELECT pow(10.0, -6 + k * 0.25) FROM range(0, 49) t(k)))""",
    ]
    for stage in range(STAGES):
        parts += [
            f"""{P}g{stage} AS (SELECT subset, theta, i, j, sum(s - theta / (1 + n * theta) * b) AS v
  FROM {P}pool, {P}th{stage} GROUP BY subset, theta, i, j)""",
            _sweep(f"{P}w{stage}", f"{P}g{stage}", "subset, theta", p, mask),
            f"""{P}l{stage} AS (SELECT subset, theta, -0.5 * ({d} * ln(2 * pi() * v / {d})
      + (SELECT sum(sites * ln(1 + n * theta)) FROM {P}sizes) + {d}) {"- 0.5 * logdet" if reml else ""} AS ll
  FROM {P}w{stage}, {P}dims WHERE step = {p} AND i = {p} AND j = {p})""",
            f"{P}b{stage} AS (SELECT subset, arg_max(theta, ll) AS theta, max(ll) AS ll FROM {P}l{stage} GROUP BY subset)",
        ]
        if stage < 2:
            parts.append(
                f"""{P}th{stage + 1} AS (SELECT subset, theta FROM {P}b{stage} WHERE theta = 0
  UNION ALL SELECT subset, pow(10.0, log10(theta) + (k - 50) * {STEPS[stage]!r})
  FROM {P}b{stage}, range(0, 101) t(k) WHERE theta > 0)"""
            )
        elif stage == 2:
            # top of the parabola through the best point and its neighbours, then five points around it
            parts.append(
                f"""{P}th3 AS (
  SELECT v.subset, CASE WHEN v.theta = 0 THEN 0 ELSE pow(10.0, log10(v.theta)
    + {STEPS[1]!r} * coalesce((below - above) / (2 * (below - 2 * v.ll + above)), 0) + k * {STENCIL!r}) END AS theta
  FROM (SELECT *, lag(ll) OVER (PARTITION BY subset ORDER BY theta) AS below,
               lead(ll) OVER (PARTITION BY subset ORDER BY theta) AS above FROM {P}l2) v
  JOIN {P}b2 b ON b.subset = v.subset AND b.theta = v.theta, (VALUES (-2), (-1), (0), (1), (2)) t(k)
  WHERE v.theta > 0 OR k = 0)"""
            )
        elif stage == 3:
            # one Newton step with fourth-order differences
            parts.append(
                f"""{P}th4 AS (
  SELECT subset, CASE WHEN theta = 0 THEN 0 ELSE pow(10.0, log10(theta) - {STENCIL!r}
    * (l2 - 8 * l1 + 8 * u1 - u2) / (-l2 + 16 * l1 - 30 * ll + 16 * u1 - u2)) END AS theta
  FROM (SELECT *, lag(ll) OVER w AS l1, lag(ll, 2) OVER w AS l2, lead(ll) OVER w AS u1, lead(ll, 2) OVER w AS u2
        FROM {P}l3 WINDOW w AS (PARTITION BY subset ORDER BY theta))
  WHERE theta = 0 OR (l2 IS NOT NULL AND u2 IS NOT NULL))"""
            )
    last = STAGES - 1
    parts += [
        f"{P}best AS (SELECT * FROM {P}b{last})",
        f"""{P}final AS (SELECT w.subset, w.theta, i, j, v FROM {P}w{last} w JOIN {P}best b
  ON w.subset = b.subset AND w.theta = b.theta WHERE step = {p})""",
        f"""{P}vars AS (SELECT f.subset, f.theta, b.ll, d.n, d.g, {rank.replace('subset', 'f.subset')} AS p,
    f.v / {d.replace('subset', 'f.subset').replace('n -', 'd.n -') if reml else 'd.n'} AS s2
  FROM {P}final f JOIN {P}best b ON f.subset = b.subset, {P}dims d WHERE i = {p} AND j = {p})""",
        f"""{P}coef AS (SELECT a.subset, a.i AS k, a.v AS b, sqrt(-c.v * s.s2) AS se
  FROM {P}final a JOIN {P}final c ON a.subset = c.subset AND a.i = c.i AND c.j = c.i
  JOIN {P}vars s ON s.subset = a.subset
  WHERE a.j = {p} AND a.i < {p} AND (a.i = 0 OR (a.subset >> (a.i - 1)) & 1 = 1))""",
        f"""{P}effects AS (SELECT site, max(CASE WHEN k = 0 THEN v END) AS rows,
    max(theta) / (1 + max(CASE WHEN k = 0 THEN v END) * max(theta))
      * (max(CASE WHEN k = {p} THEN v END) - sum(CASE WHEN k < {p} THEN v * b END)) AS u
  FROM (SELECT s.site, s.k, s.v, c.b, x.theta FROM {P}s0 s LEFT JOIN {P}coef c ON s.k = c.k, {P}best x) GROUP BY site)""",
    ]
    return ",\n".join(parts)


def _list_sweep(size: int, k: str) -> str:
    """SQL that sweeps column ``k`` of ``a``, a matrix as a list of its rows one after the other."""
    i, j, v = f"(x // {size})", f"(x % {size})", "a[x + 1]"
    pivot = f"a[({k}) * {size} + ({k}) + 1]"
    return f"""list_transform(range(0, {size * size}), lambda x: CASE WHEN {i} = ({k}) AND {j} = ({k}) THEN -1 / {pivot}
      WHEN {i} = ({k}) OR {j} = ({k}) THEN {v} / {pivot}
      ELSE {v} - a[{i} * {size} + ({k}) + 1] * a[({k}) * {size} + {j} + 1] / {pivot} END)"""


def tree_ctes(frame: str, site: str, xs: Sequence[str], y: str, needs: Sequence[int]) -> str:
    """Maximum-likelihood fits of all allowed subsets, for searches too wide for ``mixed_ctes``.

    ``needs`` gives each term's factors as bits.  On the common grid of variance
    ratios a subset is swept once from its parent; its own ratio is then refined
    around the best grid point.  Ends with ``vars(subset, theta, ll, n, g, p)``.
    """
    size, p = len(xs) + 2, len(xs) + 1
    needed = "[" + ", ".join(map(str, needs)) + "]"
    ll = "-0.5 * (n * ln(2 * pi() * a[-1] / n) + (SELECT sum(sites * ln(1 + n * theta)) FROM sizes) + n)"

    def cross(name: str, ratios: str) -> str:
        return f"""{name} AS (SELECT theta, list(v ORDER BY i, j) AS a FROM (
  SELECT theta, i, j, sum(s - theta / (1 + n * theta) * b) AS v
  FROM pool, (SELECT DISTINCT theta FROM {ratios}) GROUP BY theta, i, j) GROUP BY theta)"""

    parts = [
        f"sm AS (SELECT site, i, j, v FROM (SELECT {site} AS site, "
        f"unnest({_cells(['1.0', *xs, y])}, recursive := true) FROM {frame} GROUP BY {site}))",
        "s0 AS (SELECT site, j AS k, v FROM sm WHERE i = 0)",
        "sizes AS (SELECT v AS n, count(*) AS sites FROM s0 WHERE k = 0 GROUP BY v)",
        "dims AS (SELECT sum(n * sites) AS n, sum(sites) AS g FROM sizes)",
        """pool AS (SELECT c.v AS n, m.i, m.j, sum(a.v * b.v) AS b, sum(m.v) AS s
  FROM sm m JOIN s0 a ON a.site = m.site AND a.k = m.i JOIN s0 b ON b.site = m.site AND b.k = m.j
  JOIN s0 c ON c.site = m.site AND c.k = 0 GROUP BY c.v, m.i, m.j)""",
        "grid AS (SELECT CAST(0 AS DOUBLE) AS theta UNION ALL SELECT pow(10.0, -6 + k * 0.25) FROM range(0, 49) t(k))",
        cross("gram", "grid"),
        f"""tree AS (
  SELECT 0 AS subset, 1 AS step, theta, {_list_sweep(size, '0')} AS a FROM gram
  UNION ALL
  SELECT subset + take * (1 << (step - 1)), step + 1, theta, CASE WHEN take = 1 THEN {_list_sweep(size, 'step')} ELSE a END
  FROM tree, (VALUES (0), (1)) t(take)
  WHERE step < {p} AND (take = 0 OR subset & {needed}[step] = {needed}[step]))""",
        f"""at0 AS (SELECT subset, arg_max(theta, ll) AS theta FROM (
  SELECT subset, theta, {ll} AS ll FROM tree, dims WHERE step = {p}) GROUP BY subset)""",
        """th1 AS (SELECT subset, theta FROM at0 WHERE theta = 0 UNION ALL
  SELECT subset, pow(10.0, log10(theta) + (k - 12) * 0.025) FROM at0, range(0, 25) t(k) WHERE theta > 0)""",
    ]
    for stage in (1, 2, 3):
        parts += [
            cross(f"g{stage}", f"th{stage}"),
            f"""w{stage} AS (
  SELECT subset, 1 AS step, theta, {_list_sweep(size, '0')} AS a FROM th{stage} JOIN g{stage} USING (theta)
  UNION ALL
  SELECT subset, step + 1, theta, CASE WHEN (subset >> (step - 1)) & 1 = 1 THEN {_list_sweep(size, 'step')} ELSE a END
  FROM w{stage} WHERE step < {p})""",
            f"l{stage} AS (SELECT subset, theta, {ll} AS ll FROM w{stage}, dims WHERE step = {p})",
        ]
        if stage == 1:
            # top of the parabola through the best point and its neighbours, then five points around it
            parts.append(
                """th2 AS (SELECT subset, CASE WHEN theta = 0 THEN 0 ELSE pow(10.0, log10(theta)
    + 0.025 * coalesce((below - above) / (2 * (below - 2 * ll + above)), 0) + k * 0.01) END AS theta
  FROM (SELECT *, lag(ll) OVER w AS below, lead(ll) OVER w AS above FROM l1 WINDOW w AS (PARTITION BY subset ORDER BY theta)
        QUALIFY row_number() OVER (PARTITION BY subset ORDER BY ll DESC) = 1), (VALUES (-2), (-1), (0), (1), (2)) t(k)
  WHERE theta > 0 OR k = 0)"""
            )
        if stage == 2:
            parts.append(
                """th3 AS (SELECT subset, CASE WHEN theta = 0 THEN 0 ELSE pow(10.0, log10(theta) - 0.01
    * (l2 - 8 * l1 + 8 * u1 - u2) / (-l2 + 16 * l1 - 30 * ll + 16 * u1 - u2)) END AS theta
  FROM (SELECT *, lag(ll) OVER w AS l1, lag(ll, 2) OVER w AS l2, lead(ll) OVER w AS u1, lead(ll, 2) OVER w AS u2
        FROM l2 WINDOW w AS (PARTITION BY subset ORDER BY theta))
  WHERE theta = 0 OR (l2 IS NOT NULL AND u2 IS NOT NULL))"""
            )
    parts.append("vars AS (SELECT subset, theta, ll, n, g, 1 + bit_count(subset) AS p FROM l3, dims)")
    return ",\n".join(parts)


def fixed_part(xs: Sequence[str], prefix: str = "") -> str:
    """Scalar SQL for the prediction without the site effect."""
    terms = [f"(SELECT b FROM {prefix}coef WHERE k = 0)"]
    terms += [f"(SELECT b FROM {prefix}coef WHERE k = {k}) * ({x})" for k, x in enumerate(xs, start=1)]
    return " + ".join(terms)
