"""Logistic regression in SQL, for oracles."""

from __future__ import annotations


def newton_sql(rows: str, out: str, steps: int = 9) -> str:
    """CTEs that fit y on z1, z2 (and an intercept) per ``g``; ``rows`` has
    g, z1, z2, y, w and the ridge terms r1, r2. ``out``: (g, a, b1, b2)."""
    ctes = [f"{out}_0 AS MATERIALIZED (SELECT g, 0e0 AS a, 0e0 AS b1, 0e0 AS b2 FROM {rows} GROUP BY g)"]
    for i in range(steps):
        ctes.append(f"""{out}_s{i} AS MATERIALIZED (SELECT g, any_value(a) AS a, any_value(b1) AS b1, any_value(b2) AS b2,
  sum(w * (p - y)) AS g0, sum(w * (p - y) * z1) + any_value(r1 * b1) AS g1, sum(w * (p - y) * z2) + any_value(r2 * b2) AS g2,
  sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * z1) AS h01, sum(w * p * (1 - p) * z2) AS h02,
  sum(w * p * (1 - p) * z1 * z1) + any_value(r1) AS h11, sum(w * p * (1 - p) * z1 * z2) AS h12,
  sum(w * p * (1 - p) * z2 * z2) + any_value(r2) AS h22
  FROM (SELECT r.*, a, b1, b2, 1 / (1 + exp(-(a + b1 * z1 + b2 * z2))) AS p FROM {rows} r JOIN {out}_{i} t ON r.g = t.g) GROUP BY g)""")
        ctes.append(f"""{out}_{i + 1} AS MATERIALIZED (SELECT g,
  a - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d AS a,
  b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d AS b1,
  b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d AS b2
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d FROM {out}_s{i}))""")
    return ",\n".join(ctes) + f",\n{out} AS (SELECT * FROM {out}_{steps})"
