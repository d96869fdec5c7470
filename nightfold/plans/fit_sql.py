"""SQL of a whole logistic fit, for comparison with the distributed one: date folds, imputation, standardisation, Newton
steps as a recursive query, choice of C, the final model. Two inputs at most: a value with gaps and its missing
flag, or two values without gaps, so that each step is a system of three equations.
"""

from __future__ import annotations

from collections.abc import Sequence

from nightfold.operators.models import C_GRID, P_CLIP, TIE

STEPS = 30

ALL = "SELECT DISTINCT {k}, 'all' AS split, CAST(NULL AS VARCHAR) AS exclude, CAST(NULL AS DATE) AS before FROM {src}"
EACH_GROUP = "SELECT DISTINCT a.*, b.grp AS split, b.grp AS exclude, CAST(NULL AS DATE) AS before FROM (SELECT DISTINCT {k} FROM {src}) a, (SELECT DISTINCT grp FROM {src}) b"
EACH_MONTH = "SELECT DISTINCT a.*, strftime(b.m, '%Y-%m') AS split, CAST(NULL AS VARCHAR) AS exclude, b.m AS before FROM (SELECT DISTINCT {k} FROM {src}) a, (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS m FROM {src} WHERE date_trunc('month', day) >= DATE '{start}') b"


def fit_ctes(src: str, keys: Sequence[str], outer: str = ALL, folds: int = 4, tag: str = "", second: bool = False, **names: str) -> list[str]:
    """CTEs (others begin with `f_`) that end in `{tag}model`, one row per key and split, and `{tag}fold`, the validation folds' models.

    src: a relation (keys, day, grp, x, y), with x2 if `second`, which then takes the place of x's missing flag.
    """
    t, k = f"f_{tag}", ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    grid = ", ".join(f"{c!r}::DOUBLE" for c in C_GRID)
    x2 = "x2" if second else "CAST(NULL AS DOUBLE) AS x2"
    z0 = "(coalesce(x, med) - m0) / s0"
    z1 = "(x2 - m1) / s1" if second else "CASE WHEN gaps > 0 THEN ((CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) - m1) / s1 ELSE 0.0 END"
    prob = "1 / (1 + exp(-(b0 * z0 + b1 * z1 + b2)))"
    clip = f"greatest({P_CLIP}, least({1 - P_CLIP}, p))"
    minors = {"d": "h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02)",
              "e0": "g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)",
              "e1": "h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)",
              "e2": "h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)"}
    return [
        f"{t}r AS MATERIALIZED (SELECT {k}, day, grp, x, {x2}, CAST(y AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w FROM {src} WHERE y IS NOT NULL GROUP BY ALL)",
        f"{t}o AS MATERIALIZED ({outer.format(k=k, src=f'{t}r', **names)})",
        f"{t}v AS MATERIALIZED (SELECT o.split, o.before, r.* FROM {t}o o JOIN {t}r r ON {on('o', 'r')} WHERE (o.before IS NULL OR r.day < o.before) AND (o.exclude IS NULL OR r.grp <> o.exclude))",
        f"{t}dd AS MATERIALIZED (SELECT {k}, split, day, row_number() OVER (PARTITION BY {k}, split ORDER BY day) - 1 AS r, count(*) OVER (PARTITION BY {k}, split) AS n FROM (SELECT DISTINCT {k}, split, day FROM {t}v))",
        f"{t}fb AS (SELECT DISTINCT {k}, split, fold, n - ({folds} - fold) * (n // {folds + 1}) AS a, n // {folds + 1} AS size FROM {t}dd, (SELECT unnest(range({folds})) AS fold))",
        f"""{t}p AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM (SELECT {k}, split, -1 AS fold, CAST(NULL AS DATE) AS val_from, CAST(NULL AS DATE) AS val_before FROM {t}o
  UNION ALL SELECT {', '.join(f'f.{c}' for c in keys)}, f.split, f.fold, a.day, b.day FROM {t}fb f JOIN {t}dd a ON {on('f', 'a')} AND a.split = f.split AND a.r = f.a LEFT JOIN {t}dd b ON {on('f', 'b')} AND b.split = f.split AND b.r = f.a + f.size))""",
        f"{t}tr AS MATERIALIZED (SELECT pid, x, x2, y, sum(w) AS w FROM {t}p p JOIN {t}v v ON {on('p', 'v')} AND p.split = v.split WHERE p.fold < 0 OR v.day < p.val_from GROUP BY ALL)",
        f"{t}md AS (SELECT pid, quantile_cont(x, 0.5) AS med FROM (SELECT pid, x, unnest(range(CAST(w AS BIGINT))) FROM {t}tr WHERE x IS NOT NULL) GROUP BY pid)",
        f"{t}s0 AS (SELECT pid, any_value(coalesce(med, 0)) AS med, sum(w) AS n, sum(w * y) AS pos, sum(CASE WHEN x IS NULL THEN w ELSE 0 END) AS gaps, sum(w * coalesce(x, med)) / sum(w) AS m0, {'sum(w * x2) / sum(w)' if second else 'sum(CASE WHEN x IS NULL THEN w ELSE 0 END) / sum(w)'} AS m1 FROM {t}tr LEFT JOIN {t}md USING (pid) GROUP BY pid)",
        f"""{t}st AS MATERIALIZED (SELECT pid, any_value(COLUMNS(s.* EXCLUDE (pid))), CASE WHEN sum(w * pow(coalesce(x, med) - m0, 2)) / sum(w) > 1e-28 * any_value(m0 * m0) THEN sqrt(sum(w * pow(coalesce(x, med) - m0, 2)) / sum(w)) ELSE 1.0 END AS s0,
  {'CASE WHEN sum(w * pow(x2 - m1, 2)) / sum(w) > 1e-28 * any_value(m1 * m1) THEN sqrt(sum(w * pow(x2 - m1, 2)) / sum(w)) ELSE 1.0 END' if second else 'CASE WHEN any_value(m1 * (1 - m1)) > 0 THEN sqrt(any_value(m1 * (1 - m1))) ELSE 1.0 END'} AS s1
  FROM {t}tr JOIN {t}s0 s USING (pid) GROUP BY pid HAVING any_value(pos) > 0 AND any_value(pos) < any_value(n))""",
        f"{t}z AS MATERIALIZED (SELECT pid, {z0} AS z0, {z1} AS z1, y, sum(w) AS w FROM {t}tr JOIN {t}st USING (pid) GROUP BY ALL)",
        f"""{t}nw(it, pid, c, b0, b1, b2) AS (SELECT 0, pid, c, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM {t}st, (SELECT unnest([{grid}]) AS c) UNION ALL
  SELECT it + 1, pid, c, b0 - e0 / d, b1 - e1 / d, b2 - e2 / d FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in minors.items())} FROM
    (SELECT it, pid, c, b0, b1, b2, c * sum(w * z0 * (p - y)) + b0 AS g0, c * sum(w * z1 * (p - y)) + b1 AS g1, c * sum(w * (p - y)) AS g2, c * sum(w * p * (1 - p) * z0 * z0) + 1 AS h00, c * sum(w * p * (1 - p) * z1 * z1) + 1 AS h11,
      c * sum(w * p * (1 - p)) AS h22, c * sum(w * p * (1 - p) * z0 * z1) AS h01, c * sum(w * p * (1 - p) * z0) AS h02, c * sum(w * p * (1 - p) * z1) AS h12
      FROM (SELECT f.*, z.z0, z.z1, z.y, z.w, {prob} AS p FROM {t}nw f JOIN {t}z z USING (pid) WHERE f.it < {STEPS}) GROUP BY it, pid, c, b0, b1, b2)))""",
        f"{t}fit AS MATERIALIZED (SELECT p.*, s.* EXCLUDE (pid), f.c, f.b0, f.b1, f.b2 FROM {t}nw f JOIN {t}p p USING (pid) JOIN {t}st s USING (pid) WHERE f.it = {STEPS})",
        f"""{t}loss AS (SELECT pid, c, sum(w * -(y * ln({clip}) + (1 - y) * ln(1 - {clip}))) / sum(w) AS loss FROM
  (SELECT pid, c, y, w, {prob} AS p FROM (SELECT f.pid, f.c, f.b0, f.b1, f.b2, v.y, v.w, {z0} AS z0, {z1} AS z1 FROM {t}fit f JOIN {t}v v ON {on('f', 'v')} AND f.split = v.split WHERE f.fold >= 0 AND v.day >= f.val_from AND (f.val_before IS NULL OR v.day < f.val_before))) GROUP BY pid, c)""",
        f"{t}cv AS MATERIALIZED (SELECT {k}, split, c, avg(loss) AS loss FROM {t}loss JOIN {t}fit USING (pid, c) GROUP BY ALL)",
        f"{t}ch AS (SELECT {k}, split, min(c) AS c, arg_min(loss, c) AS cv_log_loss FROM (SELECT *, min(loss) OVER (PARTITION BY {k}, split) AS best FROM {t}cv) WHERE loss <= best + {TIE} GROUP BY ALL)",
        f"{tag}model AS MATERIALIZED (SELECT f.* EXCLUDE (pid, fold, val_from, val_before), h.cv_log_loss FROM {t}fit f LEFT JOIN {t}ch h ON {on('f', 'h')} AND f.split = h.split WHERE f.fold < 0 AND f.c = coalesce(h.c, {C_GRID[0]!r}::DOUBLE))",
        f"{tag}fold AS (SELECT f.* FROM {t}fit f JOIN {tag}model m ON {on('f', 'm')} AND f.split = m.split AND f.c = m.c WHERE f.fold >= 0)",
    ]


def model_p(row: str, model: str, x: str = "x", x2: str | None = None) -> str:
    """The probability of a model's row for a row with value `x` (and `x2`)."""
    m = f"{model}."
    z1 = f"({row}.{x2} - {m}m1) / {m}s1" if x2 else f"CASE WHEN {m}gaps > 0 THEN ((CASE WHEN {row}.{x} IS NULL THEN 1.0 ELSE 0.0 END) - {m}m1) / {m}s1 ELSE 0.0 END"
    return f"(1 / (1 + exp(-({m}b0 * (coalesce({row}.{x}, {m}med) - {m}m0) / {m}s0 + {m}b1 * {z1} + {m}b2))))"


def isotonic_ctes(src: str, keys: Sequence[str], tag: str = "") -> list[str]:
    """`{tag}iso`: (keys, p, v), the isotonic regression of y on p: the largest over lower starts of the smallest mean up to
    a higher end, for every distinct p."""
    t, k = f"i_{tag}", ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return [
        f"{t}pt AS MATERIALIZED (SELECT {k}, p, sum(y) AS sy, count(*) AS w, row_number() OVER (PARTITION BY {k} ORDER BY p) AS i FROM {src} GROUP BY {k}, p)",
        f"{t}cs AS MATERIALIZED (SELECT *, sum(sy) OVER (PARTITION BY {k} ORDER BY i) AS cy, sum(w) OVER (PARTITION BY {k} ORDER BY i) AS cw FROM {t}pt)",
        f"{t}mean AS MATERIALIZED (SELECT {', '.join(f'a.{c}' for c in keys)}, a.i, b.i AS j, (b.cy - a.cy + a.sy) / (b.cw - a.cw + a.w) AS m FROM {t}cs a JOIN {t}cs b ON {on} AND b.i >= a.i)",
        f"{t}low AS (SELECT {k}, i, j, min(m) OVER (PARTITION BY {k}, i ORDER BY j DESC) AS m FROM {t}mean)",
        f"{tag}iso AS MATERIALIZED (SELECT {', '.join(f'b.{c}' for c in keys)}, b.p, max(a.m) AS v FROM {t}low a JOIN {t}cs b ON {on} AND a.j = b.i GROUP BY ALL)",
    ]


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
