"""DuckDB SQL that states, apart from the engine, what each query returns."""

from __future__ import annotations

#: The smallest even lattice, its longest side at most five times the shortest, that holds all events; cells without one are 0.
LAT = """
least AS (SELECT (max(event_id) + 8) // 8 AS m, CAST(ceil(cbrt((max(event_id) + 8) // 8)) AS BIGINT) AS s FROM events),
tried AS (SELECT unnest(range(m, m + s * s + 1)) AS m, s FROM least), first AS (SELECT m, s, unnest(range(1, s + 1)) AS a FROM tried),
second AS (SELECT m, a, unnest(range(a, 5 * a + 1)) AS b FROM first WHERE m % a = 0),
size AS (SELECT CAST(2 * a AS INT) AS ni, CAST(2 * b AS INT) AS nj, CAST(2 * (m // (a * b)) AS INT) AS nk FROM second
  WHERE m % (a * b) = 0 AND b <= m // (a * b) AND m // (a * b) <= 5 * a ORDER BY m, m // (a * b) - a, a DESC, b LIMIT 1),
lat AS (
  SELECT CAST(c // (nj * nk) AS INT) AS i, CAST(c // nk % nj AS INT) AS j, CAST(c % nk AS INT) AS k,
         coalesce(CAST(round(value * 100) AS BIGINT), 0) AS f, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS g, ni, nj, nk
  FROM (SELECT unnest(range(ni::BIGINT * nj * nk)) AS c, ni, nj, nk FROM size) LEFT JOIN events ON event_id = c)"""
EMB = """
emb AS (
  SELECT vec_id, CAST((p - 1) // 16 AS INT) AS i, CAST((p - 1) // 4 % 4 AS INT) AS j, CAST((p - 1) % 4 AS INT) AS k, CAST(embedding[p] AS DOUBLE) AS e
  FROM embeddings, range(1, 65) AS r(p)
)"""


def _near(terms: str, value: str, table: str = "lat") -> str:
    """Joins a cell ``c`` with its neighbours ``x`` by a list of (di, dj, dk, w)."""
    return f"""FROM {table} c CROSS JOIN (VALUES {terms}) AS t(di, dj, dk, w)
  JOIN {table} x ON x.i = (c.i + t.di + c.ni) % c.ni AND x.j = (c.j + t.dj + c.nj) % c.nj AND x.k = (c.k + t.dk + c.nk) % c.nk {value}"""


_AXES = (("{0}", "0", "0"), ("0", "{0}", "0"), ("0", "0", "{0}"))


def _along(axis: int, s: int) -> str:
    return ", ".join(p.format(s) for p in _AXES[axis])


# Numerators of centred differences and what they are divided by.
_FIRST = {1: ({1: 1}, 2), 2: ({1: 8, 2: -1}, 12), 3: ({1: 45, 2: -9, 3: 1}, 60), 4: ({1: 672, 2: -168, 3: 32, 4: -3}, 840)}
_SECOND = {1: ({0: -2, 1: 1}, 1), 2: ({0: -30, 1: 16, 2: -1}, 12), 3: ({0: -490, 1: 270, 2: -27, 3: 2}, 180), 4: ({0: -14350, 1: 8064, 2: -1008, 3: 128, 4: -9}, 5040)}


def _first(h: int, axis: int) -> str:
    return ", ".join(f"({_along(axis, sign * s)}, {sign * w})" for s, w in _FIRST[h][0].items() for sign in (1, -1))


def _second(h: int) -> str:
    middle = 3 * _SECOND[h][0][0]
    return f"(0, 0, 0, {middle}), " + ", ".join(f"({_along(a, sign * s)}, {w})" for a in range(3) for s, w in _SECOND[h][0].items() if s for sign in (1, -1))


def _lap_cte(h: int = 1, name: str = "lap", value: str = "x.f", table: str = "lat") -> str:
    return f"{name} AS (SELECT c.i, c.j, c.k, sum(t.w * {value}) AS v {_near(_second(h), '', table)} GROUP BY ALL)"


def _grad_cte(h: int, axis: int, name: str, value: str = "x.f") -> str:
    return f"{name} AS (SELECT c.i, c.j, c.k, sum(t.w * {value}) AS v {_near(_first(h, axis), '')} GROUP BY ALL)"


SQL: dict[str, str] = {
    "laplacian_h1": f"WITH {LAT}, {_lap_cte()} SELECT i, j, k, CAST(v AS BIGINT) AS lap FROM lap",
    "lap_summary": f"WITH {LAT}, {_lap_cte()} SELECT CAST(sum(v) AS BIGINT) AS total, CAST(min(v) AS BIGINT) AS least, CAST(max(v) AS BIGINT) AS most, CAST(sum(abs(v)) AS BIGINT) AS size FROM lap",
    "streaming_stencil": f"""WITH {LAT} SELECT c.i, c.j, c.k, CAST(sum(t.w * CASE WHEN t.w = 3 THEN x.g ELSE x.f END) AS BIGINT) AS y
      {_near("(1, 0, 0, 1), (0, -1, 0, 2), (0, 0, 2, 3)", "")} GROUP BY ALL""",
    "stencil_nonlinear": f"""WITH {LAT} SELECT c.i, c.j, c.k, CAST(a.f * b.g + d.g * c.f AS BIGINT) AS y FROM lat c
      JOIN lat a ON a.i = (c.i + 1) % c.ni AND a.j = c.j AND a.k = c.k
      JOIN lat b ON b.i = (c.i + c.ni - 1) % c.ni AND b.j = c.j AND b.k = c.k
      JOIN lat d ON d.i = c.i AND d.j = (c.j + 1) % c.nj AND d.k = (c.k + 1) % c.nk""",
    "divergence": f"""WITH {LAT}, {_grad_cte(1, 0, "a")}, {_grad_cte(1, 1, "b", "x.g")}, {_grad_cte(1, 2, "c", "(x.f - x.g)")}
      SELECT i, j, k, round((a.v + b.v + c.v) / 2.0, 4) + 0.0 AS div FROM a JOIN b USING (i, j, k) JOIN c USING (i, j, k)""",
    "lap_outer": f"""WITH {EMB} SELECT c.vec_id, c.i, c.j, c.k, round(sum(t.w * x.e), 6) + 0.0 AS lap
      FROM emb c CROSS JOIN (VALUES {_second(1)}) AS t(di, dj, dk, w)
      JOIN emb x ON x.vec_id = c.vec_id AND x.i = (c.i + t.di + 4) % 4 AND x.j = (c.j + t.dj + 4) % 4 AND x.k = (c.k + t.dk + 4) % 4 GROUP BY ALL""",
    "map_tmp": f"""WITH {LAT}, m AS (SELECT i, j, k, f, g, f * g + 1 AS t FROM lat), s AS (SELECT *, f + t AS f2 FROM m)
      SELECT i, j, k, f2 AS f, f2 * 2 + g - t AS g FROM s""",
    "map_if": f"WITH {LAT} SELECT i, j, k, CASE WHEN g > 20 AND g <= 60 THEN f * g ELSE -f END AS y FROM lat",
    "map_single": f"WITH {LAT} SELECT i, j, k, CAST(3 * f - g * g + 7 AS BIGINT) AS y FROM lat",
    "map_functions": f"""WITH {LAT}, m AS (SELECT *, g / 100.0::DOUBLE AS x FROM lat) SELECT i, j, k,
      round(sqrt(x) + exp(x) - ln(x + 1), 9) + 0.0 AS a, round(sin(x) * cos(x) + (exp(x) - exp(-x)) / (exp(x) + exp(-x)), 9) + 0.0 AS b,
      CAST(least(g, 50) + greatest(g, 50) * 3 AS DOUBLE) AS c, CAST(g // 7 + round(g / 7.0::DOUBLE) + g % 7 + g // 7 AS DOUBLE) AS d,
      CAST(abs(g - 50) + (CASE WHEN g < 50 THEN -1 ELSE 1 END) + abs(g - 10) AS DOUBLE) AS e FROM m""",
    "potential_diff": f"""WITH {LAT} SELECT i, j, k, CAST(g * g * g::BIGINT - 10 * g::BIGINT * f AS DOUBLE) AS dg, CAST(f - 5 * g * g AS DOUBLE) AS df,
      CAST(-10 * g AS DOUBLE) AS dgf FROM lat""",
    "expr_rewrite": f"WITH {LAT} SELECT i, j, k, CAST((g - f) * 2 + 5 AS BIGINT) AS y, 'f[q, i + 1, j, k + -1]' AS spelt FROM lat",
    "reduce_avg": f"WITH {LAT} SELECT round(sum(f * g) / count(*), 6) AS f_0, round(sum(g) / count(*), 6) AS g_0 FROM lat",
    "reduce_sum": f"WITH {LAT} SELECT CAST(sum(f * g) AS DOUBLE) AS f_0, CAST(sum(g) AS DOUBLE) AS g_0 FROM lat",
    "reduce_max": f"WITH {LAT} SELECT CAST(max(f - g) AS DOUBLE) AS f_0, CAST(max(g) AS DOUBLE) AS g_0 FROM lat",
    "reduce_min": f"WITH {LAT} SELECT CAST(min(f - g) AS DOUBLE) AS f_0, CAST(min(g) AS DOUBLE) AS g_0 FROM lat",
    "reduce_prod": f"""WITH {LAT}, p AS (SELECT i, j, product(1 + g / 100.0::DOUBLE) AS v FROM lat GROUP BY i, j)
      SELECT i, j, round(v / pow(10.0, floor(log10(v))), 8) AS p_0 FROM p""",
    "reduce_lineitem": """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_0, round(max(l_extendedprice), 2) AS net_1,
      round(min(l_extendedprice), 2) AS net_2, round(sum(l_quantity), 2) AS q_0 FROM lineitem GROUP BY ALL""",
    "field_stats": f"""WITH {LAT}, s AS (SELECT sum(f)::DOUBLE / count(*) AS m, sum(f * f)::DOUBLE / count(*) AS q, max(f) AS a, min(f) AS b, max(abs(f)) AS c, min(abs(f)) AS d FROM lat),
      v AS (SELECT *, q - m * m AS v FROM s)
      SELECT round(m, 6) AS mean, round(v / pow(10.0, floor(log10(v))), 8) AS variance, CAST(a AS DOUBLE) AS max, CAST(b AS DOUBLE) AS min, CAST(c AS DOUBLE) AS abs_max, CAST(d AS DOUBLE) AS abs_min FROM v""",
    "field_stats_outer": f"""WITH {EMB}, s AS (SELECT vec_id, sum(e) / 64 AS m, sum(e * e) / 64 AS q, max(e) AS a, min(e) AS b, max(abs(e)) AS c, min(abs(e)) AS d FROM emb GROUP BY vec_id)
      SELECT vec_id, round(m, 9) + 0.0 AS mean, round(q - m * m, 9) AS variance, round(a, 6) AS max, round(b, 6) AS min, round(c, 6) AS abs_max, round(d, 6) AS abs_min FROM s""",
    "rho_and_p": f"""WITH {LAT}, s AS (SELECT count(*) AS c, sum(f * f) / 2.0::DOUBLE + sum(g * g) / 2.0::DOUBLE AS kin, sum(f * g)::DOUBLE AS pot, sum(-f * g) / 2.0::DOUBLE AS grad FROM lat)
      SELECT round((kin + pot + grad) / c, 3) AS total, round((kin - pot - grad / 3) / c, 3) AS pressure FROM s""",
    "hist_count": f"""WITH {LAT}, b AS (SELECT CAST(r AS INT) AS bin FROM range(12) t(r))
      SELECT bin, CAST((SELECT count(*) FROM lat WHERE g // 10 = bin) AS DOUBLE) AS n, CAST((SELECT count(*) FROM lat WHERE f % 7 = bin) AS DOUBLE) AS m FROM b""",
    "hist_weighted": f"""WITH {LAT}, s AS (SELECT g, sum(f) AS w FROM lat GROUP BY g)
      SELECT CAST(r AS INT) AS bin, CAST(coalesce(w, 0) AS DOUBLE) AS w FROM range(123) t(r) LEFT JOIN s ON s.g = r""",
    "hist_linear": f"""WITH {LAT}, m AS (SELECT min(f)::DOUBLE AS a, max(f)::DOUBLE AS b FROM lat),
      s AS (SELECT greatest(0, least(63, floor((f - a) / (b - a) * 64))) AS bin, count(*) AS c FROM lat, m GROUP BY 1)
      SELECT CAST(r AS INT) AS bin, CAST(coalesce(c, 0) AS DOUBLE) AS linear, round(a + (b - a) * r / 64, 4) + 0.0 AS linear_edge FROM range(64) t(r) CROSS JOIN m LEFT JOIN s ON s.bin = r""",
    "hist_log": f"""WITH {LAT}, m AS (SELECT ln(min(abs(f))) AS a, ln(max(abs(f))) AS b FROM lat WHERE f <> 0),
      s AS (SELECT greatest(0, least(31, floor((ln(abs(f)) - a) / (b - a) * 32))) AS bin, count(*) AS c FROM lat, m WHERE f <> 0 GROUP BY 1)
      SELECT CAST(r AS INT) AS bin, CAST(coalesce(c, 0) AS DOUBLE) AS log, round(exp(a + (b - a) * r / 32), 3) + 0.0 AS log_edge FROM range(32) t(r) CROSS JOIN m LEFT JOIN s ON s.bin = r""",
    "hist_outer": f"""WITH {EMB}, m AS (SELECT vec_id, min(e) AS a, max(e) AS b FROM emb GROUP BY vec_id),
      s AS (SELECT vec_id, greatest(0, least(7, floor((e - a) / (b - a) * 8))) AS bin, count(*) AS c FROM emb JOIN m USING (vec_id) GROUP BY 1, 2)
      SELECT m.vec_id, CAST(r AS INT) AS bin, CAST(coalesce(c, 0) AS DOUBLE) AS linear FROM m CROSS JOIN range(8) t(r) LEFT JOIN s ON s.vec_id = m.vec_id AND s.bin = r""",
    "halo_remove": f"WITH {LAT} SELECT i, j, k, f, g FROM lat",
    "gather_roundtrip": f"WITH {LAT} SELECT i, j, k, f FROM lat",
    "block_shape": f"""WITH {LAT}, cut AS (SELECT ni // 3 AS q, ni % 3 AS r FROM size), b AS (
        SELECT lat.f, CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END * 2 + j // (lat.nj // 2) AS block FROM lat, cut)
      SELECT CAST(block AS INT) AS block, count(*) AS cells, CAST(sum(f) AS BIGINT) AS f FROM b GROUP BY block""",
    "halo_pad": f"""WITH {LAT}, b AS (SELECT bi, bj, ni, nj, nk FROM size, range(2) a(bi), range(2) c(bj)), x AS (SELECT *, unnest(range(-1, ni // 2 + 1)) AS i FROM b),
      y AS (SELECT *, unnest(range(0, nj // 2)) AS j FROM x), p AS (SELECT *, unnest(range(-2, nk + 2)) AS k FROM y)
      SELECT CAST(bi * 2 + bj AS INT) AS block, CAST(p.i AS INT) AS i, CAST(p.j AS INT) AS j, CAST(p.k AS INT) AS k, f FROM p
      JOIN lat ON lat.i = (bi * (p.ni // 2) + p.i + p.ni) % p.ni AND lat.j = bj * (p.nj // 2) + p.j AND lat.k = (p.k + p.nk) % p.nk""",
    "inject": f"WITH {LAT} SELECT i // 2 AS i, j // 2 AS j, k // 2 AS k, CAST(f AS DOUBLE) AS f FROM lat WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0",
}

for _h in (1, 2, 3, 4):
    _d = _FIRST[_h][1]
    SQL[f"grad_h{_h}"] = f"""WITH {LAT}, {_grad_cte(_h, 0, "a")}, {_grad_cte(_h, 1, "b")}, {_grad_cte(_h, 2, "c")}
      SELECT i, j, k, round(a.v / {_d}.0::DOUBLE, 4) + 0.0 AS dx, round(b.v / {_d}.0::DOUBLE, 4) + 0.0 AS dy, round(c.v / {_d}.0::DOUBLE, 4) + 0.0 AS dz FROM a JOIN b USING (i, j, k) JOIN c USING (i, j, k)"""
    if _h > 1:
        SQL[f"lap_h{_h}"] = f"WITH {LAT}, {_lap_cte(_h)} SELECT i, j, k, round(v / {_SECOND[_h][1]}.0::DOUBLE, 4) + 0.0 AS lap FROM lap"
SQL["gradlap"] = f"""WITH {LAT}, {_lap_cte(2)}, {_grad_cte(2, 0, "a")}, {_grad_cte(2, 1, "b")}, {_grad_cte(2, 2, "c")}
  SELECT i, j, k, round(lap.v / 12.0::DOUBLE, 4) + 0.0 AS lap, round(a.v / 12.0::DOUBLE, 4) + 0.0 AS dx, round(b.v / 12.0::DOUBLE, 4) + 0.0 AS dy, round(c.v / 12.0::DOUBLE, 4) + 0.0 AS dz
  FROM lap JOIN a USING (i, j, k) JOIN b USING (i, j, k) JOIN c USING (i, j, k)"""


# --- Fourier space: a sum over each axis in turn


def _dft(name: str, re: str, im: str = "0", half: bool = True) -> str:
    """CTEs ending in ``{name}`` (mi, mj, mk, re, im): mi to mk from 0 to n - 1, or mk to n / 2."""
    turn = "cos(2 * pi() * ((m * {0}) % n{0}) / n{0}) AS c, -sin(2 * pi() * ((m * {0}) % n{0}) / n{0}) AS s"
    last = "nk // 2 + 1" if half else "nk"
    one = lambda at: f"SELECT *, {turn.format(at)}"
    m = "(SELECT unnest(range(greatest(ni, nj, nk))) AS m FROM size) t"
    return f"""
{name}1 AS (SELECT i, j, m AS mk, ni, nj, nk, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM (
  {one("k")} FROM (SELECT i, j, k, ni, nj, nk, ({re})::DOUBLE AS re, ({im})::DOUBLE AS im FROM lat) l JOIN {m} ON m < {last}) GROUP BY i, j, m, ni, nj, nk),
{name}2 AS (SELECT i, m AS mj, mk, ni, nj, nk, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM ({one("j")} FROM {name}1 JOIN {m} ON m < nj) GROUP BY i, m, mk, ni, nj, nk),
{name} AS (SELECT m AS mi, mj, mk, ni, nj, nk, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM ({one("i")} FROM {name}2 JOIN {m} ON m < ni) GROUP BY m, mj, mk, ni, nj, nk)"""


_K = "CAST(CASE WHEN m{0} <= n{0} // 2 THEN m{0} ELSE m{0} - n{0} END AS INT) AS k{1}"
KEYS = ", ".join(_K.format(a, b) for a, b in (("i", "x"), ("j", "y"), ("k", "z")))

SQL["dft_r2c"] = f"WITH {LAT}, {_dft('d', 'f')} SELECT {KEYS}, round(re) + 0.0 AS f_re, round(im) + 0.0 AS f_im FROM d"
SQL["dft_c2c"] = f"WITH {LAT}, {_dft('d', 'f', 'g * 100', half=False)} SELECT {KEYS}, round(re) + 0.0 AS z_re, round(im) + 0.0 AS z_im FROM d"
SQL["idft_roundtrip"] = f"WITH {LAT} SELECT i, j, k, f::DOUBLE AS f, g::DOUBLE AS g FROM lat"
_CORNER = "mi % (ni // 2) = 0 AND mj % (nj // 2) = 0 AND mk % (nk // 2) = 0"
SQL["zero_corner"] = f"""WITH {LAT}, {_dft("d", "f")} SELECT {KEYS}, CASE WHEN {_CORNER} THEN 0 ELSE round(re) + 0.0 END AS f_re,
  CASE WHEN {_CORNER} THEN 0 ELSE round(im) + 0.0 END AS f_im FROM d"""
# Of two modes at opposite wavenumbers in the planes kz = 0 and n / 2 the smaller decides; a mode that is its own opposite is real.
SQL["hermitian"] = f"""WITH {LAT}, {_dft("d", "f")}, q AS (SELECT {KEYS}, mi, mj, mk, ni, nj, nk, re, im FROM d), h AS (SELECT *, re + 1000 * kx AS r, im + 70 * ky + 3 AS s FROM q),
  o AS (SELECT a.kx, a.ky, a.kz, a.r, a.s, b.r AS r2, b.s AS s2, a.kz IN (0, a.nk // 2) AS tied, a.kx > b.kx OR (a.kx = b.kx AND a.ky > b.ky) AS later, a.kx = b.kx AND a.ky = b.ky AS own
    FROM h a JOIN h b ON b.mi = (a.ni - a.mi) % a.ni AND b.mj = (a.nj - a.mj) % a.nj AND b.mk = a.mk)
  SELECT kx, ky, kz, round(CASE WHEN tied AND later THEN r2 ELSE r END) + 0.0 AS f_re, round(CASE WHEN tied AND own THEN 0 WHEN tied AND later THEN -s2 ELSE s END) + 0.0 AS f_im FROM o"""

_DK = "(2 * pi() / greatest(ni, nj, nk))"
_K2 = "(pow(kx * 2 * pi() / ni, 2) + pow(ky * 2 * pi() / nj, 2) + pow(kz * 2 * pi() / nk, 2))"


def _binned(modes: str, **powers: str) -> str:
    """CTE b (bin, modes, and averages of the powers times k^3, not normalised) of a table with kx, ky, kz, ni, nj, nk."""
    sums = ", ".join(f"sum(w * pow(k, 3) * ({x})) / sum(w) / (2 * pi() * pi() * ni * nj * nk) AS {n}" for n, x in powers.items())
    return f"""kk AS (SELECT *, sqrt({_K2}) AS k, CASE WHEN kz > 0 AND kz < nk // 2 THEN 2.0 ELSE 1.0 END AS w FROM {modes}),
  b AS (SELECT CAST(floor(k / {_DK} + 0.5 + 1e-9) AS INT) AS bin, sum(w)::DOUBLE AS modes, {sums} FROM kk GROUP BY 1, ni, nj, nk)"""


def _leading(*names: str, digits: int = 6, scale: str = "1") -> str:
    return ", ".join(f"CASE WHEN {n} / {scale} > 1e-300 THEN round({n} / {scale} / pow(10.0, floor(log10({n} / {scale}))), {digits}) ELSE 0 END AS {n}" for n in names)


SQL["power_spectrum"] = f"""WITH {LAT}, {_dft("d", "f")}, q AS (SELECT {KEYS}, ni, nj, nk, re, im FROM d), {_binned("q", f="re * re + im * im")}
  SELECT bin, modes, {_leading("f", digits=8)} FROM b"""
SQL["mode_counts"] = f"""WITH {LAT}, q AS (SELECT i AS mi, j AS mj, k AS mk, ni, nj, nk FROM lat WHERE k <= nk // 2), s AS (SELECT {KEYS}, ni, nj, nk FROM q), {_binned("s", u="1")}
  SELECT bin, modes, 1.0::DOUBLE AS u FROM b"""

# Effective momenta, 0 at wavenumbers 0 and n / 2: of the continuum, and of first differences over one and two cells.
_WAVE = {0: "{a}", 1: "sin({a})", 2: "(8 * sin({a}) - sin(2 * ({a}))) / 6"}


def _momenta(h: int) -> str:
    """Columns ei, ej, ek, k2, no_k, kmag, kappa, and the polarisation vector a1 + i b1, a2 + i b2, a3."""
    out = []
    for x in "ijk":
        angle = f"(CASE WHEN m{x} < n{x} // 2 THEN m{x} ELSE m{x} - n{x} END * 2 * pi() / n{x})"
        out.append(f"CASE WHEN m{x} IN (0, n{x} // 2) THEN 0 ELSE {_WAVE[h].format(a=angle)} END AS e{x}")
    return ", ".join(out)


_EPS = """SELECT *, CASE WHEN kappa > 0 THEN ei * ek / kmag / kappa / sqrt(2) WHEN kmag > 0 THEN 1 / sqrt(2) ELSE 0 END AS a1, CASE WHEN kappa > 0 THEN -ej / kappa / sqrt(2) ELSE 0 END AS b1,
  CASE WHEN kappa > 0 THEN ej * ek / kmag / kappa / sqrt(2) ELSE 0 END AS a2, CASE WHEN kappa > 0 THEN ei / kappa / sqrt(2) WHEN kmag > 0 THEN 1 / sqrt(2) ELSE 0 END AS b2,
  CASE WHEN kappa > 0 THEN -kappa / kmag / sqrt(2) ELSE 0 END AS a3, 0.0::DOUBLE AS b3"""


def _modes_of(h: int, *fields: str) -> str:
    """CTE q: modes r1, i1, r2, ... of the fields with momenta and polarisation vectors."""
    names = ("da", "db", "dc")[: len(fields)]
    values = ", ".join(f"{n}.re AS r{x}, {n}.im AS i{x}" for x, n in enumerate(names, 1))
    joined = " ".join(["da", *(f"JOIN {n} USING (mi, mj, mk)" for n in names[1:])])
    return f"""{", ".join(_dft(n, f) for n, f in zip(names, fields, strict=True))},
  v AS (SELECT mi, mj, mk, da.ni, da.nj, da.nk, {values} FROM {joined}), w AS (SELECT *, {_momenta(h)}, {KEYS} FROM v),
  u AS (SELECT *, sqrt(ei * ei + ej * ej + ek * ek) AS kmag, sqrt(ei * ei + ej * ej) AS kappa FROM w), q AS ({_EPS} FROM u)"""


def _vector_parts(scale: str = "kmag * kmag") -> str:
    """CTE p: plus, minus and lng of the vector r1 + i i1, ..."""
    plus = " + ".join(f"r{x} * a{x} + i{x} * b{x}" for x in (1, 2, 3)), " + ".join(f"i{x} * a{x} - r{x} * b{x}" for x in (1, 2, 3))
    minus = " + ".join(f"r{x} * a{x} - i{x} * b{x}" for x in (1, 2, 3)), " + ".join(f"i{x} * a{x} + r{x} * b{x}" for x in (1, 2, 3))
    return f"""dv AS (SELECT *, ei * r1 + ej * r2 + ek * r3 AS dr, ei * i1 + ej * i2 + ek * i3 AS di FROM q),
  p AS (SELECT *, {plus[0]} AS plus_re, {plus[1]} AS plus_im, {minus[0]} AS minus_re, {minus[1]} AS minus_im,
    CASE WHEN kmag > 0 THEN di / ({scale}) ELSE 0 END AS lng_re, CASE WHEN kmag > 0 THEN -dr / ({scale}) ELSE 0 END AS lng_im FROM dv)"""


def _rounded(x: str, name: str) -> str:
    return f"round({x} + 0.00037, 2) + 0.0 AS {name}"


_VECTOR = ("f", "g", "f - g")
_NAMED = (("f", 1, "i"), ("g", 2, "j"), ("u", 3, "k"))
_ACROSS = ", ".join(_rounded(f"(CASE WHEN kmag > 0 THEN {p}{x} - e{e} * d{p} / (kmag * kmag) ELSE 0 END)", f"{n}_{'re' if p == 'r' else 'im'}") for n, x, e in _NAMED for p in "ri")
_WHOLE = ", ".join(_rounded(f"(CASE WHEN kmag > 0 THEN {p}{x} ELSE 0 END)", f"{n}_{'re' if p == 'r' else 'im'}") for n, x, _ in _NAMED for p in "ri")
_POLES = ", ".join(_rounded(f"{n}_{p}", f"{n}_{p}") for n in ("plus", "minus") for p in ("re", "im"))
SQL["transversify"] = f"WITH {LAT}, {_modes_of(0, *_VECTOR)}, {_vector_parts()} SELECT kx, ky, kz, {_ACROSS.replace('0.00037, 2', '0.037')} FROM p"
SQL["vec_pol"] = f"WITH {LAT}, {_modes_of(2, *_VECTOR)}, {_vector_parts()} SELECT kx, ky, kz, {_POLES}, {_ACROSS} FROM p"
SQL["decompose_vector"] = f"WITH {LAT}, {_modes_of(1, *_VECTOR)}, {_vector_parts()} SELECT kx, ky, kz, {_POLES}, {_rounded('lng_re', 'lng_re')}, {_rounded('lng_im', 'lng_im')}, {_WHOLE} FROM p"
_ABS2 = {n: f"{n}_re * {n}_re + {n}_im * {n}_im" for n in ("plus", "minus", "lng")}
SQL["pol_spectra"] = f"WITH {LAT}, {_modes_of(0, *_VECTOR)}, {_vector_parts()}, {_binned('p', plus=_ABS2['plus'], minus=_ABS2['minus'])} SELECT bin, modes, {_leading('plus', 'minus')} FROM b"
SQL["vector_decomposition"] = f"WITH {LAT}, {_modes_of(0, *_VECTOR)}, {_vector_parts('kmag')}, {_binned('p', **_ABS2)} SELECT bin, modes, {_leading('plus', 'minus', 'lng')} FROM b"

# The tensor f, g, f - g, 2 g, f + g, 2 f of the components 11, 12, 13, 22, 23, 33, by the modes r1 of f and r2 of g.
_PLACE = {(a, b): n for n, (a, b) in enumerate(((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)))}
_TENSOR = ("{p}1", "{p}2", "({p}1 - {p}2)", "2 * {p}2", "({p}1 + {p}2)", "2 * {p}1")


def _h(a: int, b: int, part: str) -> str:
    return _TENSOR[_PLACE[min(a, b), max(a, b)]].format(p=part)


_HAT = {1: "ei", 2: "ej", 3: "ek"}
_P = ", ".join(f"CASE WHEN kmag > 0 THEN {int(a == b)} - {_HAT[a]} * {_HAT[b]} / (kmag * kmag) ELSE 0 END AS p{a}{b}" for a in (1, 2, 3) for b in (1, 2, 3))


def _tt(a: int, b: int, part: str) -> str:
    return " + ".join(f"(p{a}{c} * p{d}{b} - p{a}{b} * p{c}{d} / 2) * {_h(c, d, part)}" for c in (1, 2, 3) for d in (1, 2, 3))


_FLAT = f"pp AS (SELECT *, {_P} FROM q), tt AS (SELECT *, " + ", ".join(f"{_tt(a, b, p)} AS h_{n}_{'re' if p == 'r' else 'im'}" for (a, b), n in _PLACE.items() for p in "ri") + " FROM pp)"
_SIX = ", ".join(_rounded(f"h_{n}_{p}", f"h_{n}_{p}") for n in range(6) for p in ("re", "im"))
SQL["tt_project"] = f"WITH {LAT}, {_modes_of(0, 'f', 'g')}, {_FLAT} SELECT kx, ky, kz, {_SIX} FROM tt"


def _poles(sign: int) -> tuple[str, str]:
    """Real and imaginary part of h contracted twice with the polarisation vector (sign 1) or its conjugate (-1)."""
    re, im = [], []
    for c in (1, 2, 3):
        for d in (1, 2, 3):
            x, y = f"(a{c} * a{d} - b{c} * b{d})", f"({sign} * (a{c} * b{d} + b{c} * a{d}))"
            re.append(f"{_h(c, d, 'r')} * {x} - {_h(c, d, 'i')} * {y}")
            im.append(f"{_h(c, d, 'r')} * {y} + {_h(c, d, 'i')} * {x}")
    return " + ".join(re), " + ".join(im)


_TPOL = f"tp AS (SELECT *, {_poles(-1)[0]} AS plus_re, {_poles(-1)[1]} AS plus_im, {_poles(1)[0]} AS minus_re, {_poles(1)[1]} AS minus_im FROM tt)"
SQL["tensor_pol"] = f"WITH {LAT}, {_modes_of(0, 'f', 'g')}, {_FLAT}, {_TPOL} SELECT kx, ky, kz, {_POLES}, {_SIX} FROM tp"
_ALL9 = " + ".join(f"h_{_PLACE[min(a, b), max(a, b)]}_{p} * h_{_PLACE[min(a, b), max(a, b)]}_{p}" for a in (1, 2, 3) for b in (1, 2, 3) for p in ("re", "im"))
SQL["gw"] = f"WITH {LAT}, {_modes_of(0, 'f', 'g')}, {_FLAT}, {_binned('tt', gw=_ALL9)} SELECT bin, modes, {_leading('gw', scale='27.0')} FROM b"
SQL["gw_polarization"] = f"WITH {LAT}, {_modes_of(0, 'f', 'g')}, {_FLAT}, {_TPOL}, {_binned('tp', plus=_ABS2['plus'], minus=_ABS2['minus'])} SELECT bin, modes, {_leading('plus', 'minus', scale='27.0')} FROM b"


def _spectral(axis: str, name: str, value: str, order: int) -> str:
    """CTE (i, j, k, v): the derivative along an axis as a sum over its line, with the weights that the modes below n / 2 add up to."""
    n = f"n{axis}"
    q = f"unnest(range(1, {n} // 2)) AS q"
    if order == 1:
        weight, extra = "sum(-2.0 / {n} * (2 * pi() * q / {n}) * sin(2 * pi() * ((q * d) % {n}) / {n}))", "0"
    else:
        weight, extra = "sum(-2.0 / {n} * pow(2 * pi() * q / {n}, 2) * cos(2 * pi() * ((q * d) % {n}) / {n}))", "- pi() * pi() / {n} * cos(pi() * d)"
    rest = [x for x in "ijk" if x != axis]
    return f"""{name}w AS (SELECT d, {weight.format(n=n)} {extra.format(n=n) if order == 2 else ""} AS w FROM (SELECT {n}, d, {q} FROM (SELECT {n}, unnest(range({n})) AS d FROM size)) GROUP BY d, {n}),
  {name} AS (SELECT c.i, c.j, c.k, sum(w * ({value})) AS v FROM lat c JOIN lat x ON x.{rest[0]} = c.{rest[0]} AND x.{rest[1]} = c.{rest[1]} JOIN {name}w ON d = (c.{axis} - x.{axis} + c.{n}) % c.{n} GROUP BY c.i, c.j, c.k)"""


_FIRSTS = ", ".join(_spectral(x, f"d{x}", "x.f", 1) for x in "ijk")
_SECONDS = ", ".join(_spectral(x, f"s{x}", "x.f", 2) for x in "ijk")
SQL["spectral_derivs"] = f"""WITH {LAT}, {_FIRSTS}, {_SECONDS} SELECT i, j, k, round(si.v + sj.v + sk.v, 2) + 0.0 AS lap, round(di.v, 2) + 0.0 AS dx, round(dj.v, 2) + 0.0 AS dy, round(dk.v, 2) + 0.0 AS dz
  FROM di JOIN dj USING (i, j, k) JOIN dk USING (i, j, k) JOIN si USING (i, j, k) JOIN sj USING (i, j, k) JOIN sk USING (i, j, k)"""
SQL["spectral_divergence"] = f"""WITH {LAT}, {_spectral("i", "di", "x.f", 1)}, {_spectral("j", "dj", "x.g", 1)}, {_spectral("k", "dk", "x.f - x.g", 1)}
  SELECT i, j, k, round(di.v + dj.v + dk.v, 2) + 0.0 AS div FROM di JOIN dj USING (i, j, k) JOIN dk USING (i, j, k)"""


# Spark's 64-bit hash of 32-bit integers; each step's products are taken modulo 2^64.
_P1, _P2, _P3, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def _times(x: str, y: str, plus: int = 0) -> str:
    return f"((({x})::UHUGEINT * ({y})::UHUGEINT + {plus}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _hashed(table: str, out: str, names: list[str], column: str) -> str:
    """CTEs ending in ``out``: the columns ``names`` hold hashes, and each is taken on to that hash of ``column``."""
    word = f"(({column} + 4294967296) % 4294967296)"
    turned = "(({0}::UHUGEINT * 8388608) % 18446744073709551616::UHUGEINT + {0}::UHUGEINT // 2199023255552)"
    steps = [
        lambda h: f"xor((({h}::UHUGEINT + {_P5 + 4}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT, {_times(word, str(_P1))})",
        lambda h: _times(turned.format(h), str(_P2), _P3),
        lambda h: _times(f"xor({h}, {h} // 8589934592::UBIGINT)", str(_P2)),
        lambda h: _times(f"xor({h}, {h} // 536870912::UBIGINT)", str(_P3)),
        lambda h: f"xor({h}, {h} // 4294967296::UBIGINT)",
    ]
    tables = [table, *[f"{out}_{n}" for n in range(len(steps) - 1)], out]
    return ", ".join(f"{to} AS (SELECT * REPLACE ({', '.join(f'{step(h)} AS {h}' for h in names)}) FROM {at})" for step, at, to in zip(steps, tables[:-1], tables[1:], strict=True))


def _drawn(seed: int, draws: list[int]) -> str:
    """CTE u: all modes with kx, ky, kz, their momentum k, flip (0 where a mode is its own opposite, -1 for the later of two), and draws u0, u1, ... in (0, 1)."""
    names = [f"u{n}" for n in draws]
    seeded = f"r4 AS (SELECT *, {seed} AS seed, {', '.join(f'42::UBIGINT AS {x}' for x in names)} FROM r3), " + _hashed("r4", "h0", names, "seed")
    numbered = []
    for n, x in zip(draws, names, strict=True):
        numbered.append(_hashed(f"h{n}" if n == draws[0] else f"g{n - 1}", f"g{n}", [x], str(n)))
    chain = ", ".join([seeded, *numbered, _hashed(f"g{draws[-1]}", "hx", names, "rx"), _hashed("hx", "hy", names, "ry"), _hashed("hy", "hz", names, "rz")])
    return f"""r0 AS (SELECT i AS mi, j AS mj, k AS mk, ni, nj, nk FROM lat WHERE k <= nk // 2), r1 AS (SELECT *, {KEYS} FROM r0),
  r2 AS (SELECT *, CASE WHEN kx = ni // 2 THEN kx ELSE -kx END AS ox, CASE WHEN ky = nj // 2 THEN ky ELSE -ky END AS oy, kz IN (0, nk // 2) AS tied, sqrt({_K2}) AS k FROM r1),
  r3 AS (SELECT * EXCLUDE (ox, oy, tied), CASE WHEN tied AND (kx > ox OR kx = ox AND ky > oy) THEN ox ELSE kx END::BIGINT AS rx, CASE WHEN tied AND (kx > ox OR kx = ox AND ky > oy) THEN oy ELSE ky END::BIGINT AS ry,
    kz::BIGINT AS rz, CASE WHEN tied AND kx = ox AND ky = oy THEN 0.0::DOUBLE WHEN tied AND (kx > ox OR kx = ox AND ky > oy) THEN -1 ELSE 1 END AS flip FROM r2),
  {chain}, u AS (SELECT * REPLACE ({', '.join(f'(({x} // 2048)::DOUBLE + 0.5) / 9007199254740992 AS {x}' for x in names)}) FROM hz)"""


_SIZE = "CASE WHEN k > 0 THEN sqrt(-ln(u{0})) * sqrt({1} / (ni * nj * nk)) ELSE 0 END"
SQL["random_field_spectrum"] = f"""WITH {LAT}, {_drawn(5123, [0, 1])}, s AS (SELECT kx, ky, kz, ni, nj, nk, {_SIZE.format(0, "pow(k, -2)")} * ni * nj * nk AS size, cos(2 * pi() * u1) AS c, flip * sin(2 * pi() * u1) AS s FROM u),
  {_binned("s", r="size * size * (c * c + s * s)")} SELECT bin, modes, {_leading("r")} FROM b"""


def _back(name: str, at: str, re: str, im: str) -> str:
    """CTEs ending in ``{name}`` (i, j, k, v): the real field of modes (mi, mj, mk), an axis at a time."""
    turn = "cos(2 * pi() * ((m * {0}) % {1}) / {1}) AS c, sin(2 * pi() * ((m * {0}) % {1}) / {1}) AS s"
    m = "(SELECT unnest(range(greatest(ni, nj, nk))) AS m FROM size) t"
    return f"""{name}1 AS (SELECT m AS i, mj, mk, ni, nj, nk, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM (
    SELECT *, {turn.format("mi", "ni")} FROM (SELECT mi, mj, mk, ni, nj, nk, {re} AS re, {im} AS im FROM {at}) JOIN {m} ON m < ni) GROUP BY m, mj, mk, ni, nj, nk),
  {name}2 AS (SELECT i, m AS j, mk, ni, nj, nk, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM (SELECT *, {turn.format("mj", "nj")} FROM {name}1 JOIN {m} ON m < nj) GROUP BY i, m, mk, ni, nj, nk),
  {name} AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(m AS INT) AS k, sum(CASE WHEN mk IN (0, nk // 2) THEN 1 ELSE 2 END * (re * c - im * s)) AS v
    FROM (SELECT *, {turn.format("mk", "nk")} FROM {name}2 JOIN {m} ON m < nk) GROUP BY i, j, m)"""


# Left and right movers l and r: the field is (l + r) / sqrt 2, its rate i k (l - r) / sqrt 2 less the field times the Hubble rate; i changes sign with the conjugate.
_MOVERS = ", ".join(f"{_SIZE.format(n, '0.5 / k')} * {part} AS {name}" for name, n, part in (
    ("lr", 0, "cos(2 * pi() * u1)"), ("li", 0, "flip * sin(2 * pi() * u1)"), ("rr", 2, "cos(2 * pi() * u3)"), ("ri", 2, "flip * sin(2 * pi() * u3)")))
SQL["random_wkb"] = f"""WITH {LAT}, {_drawn(13298, [0, 1, 2, 3])}, lr AS (SELECT *, {_MOVERS} FROM u), w AS (SELECT *, (lr + rr) / sqrt(2) AS fr, (li + ri) / sqrt(2) AS fi, flip * k / sqrt(2) AS turn FROM lr),
  x AS (SELECT *, -turn * (li - ri) - fr * 0.5 AS dr, turn * (lr - rr) - fi * 0.5 AS di FROM w), {_back("a", "x", "fr", "fi")}, {_back("b", "x", "dr", "di")}
  SELECT i, j, k, round(a.v, 6) + 0.0 AS r, round(b.v, 6) + 0.0 AS drdt FROM a JOIN b USING (i, j, k)"""
SQL["poisson"] = f"WITH {LAT}, a AS (SELECT round(avg(f), 3) AS mean FROM lat) SELECT i, j, k, mean FROM lat, a"
_GRID = f"g AS (SELECT i AS mi, j AS mj, k AS mk, ni, nj, nk FROM lat WHERE k <= nk // 2), w AS (SELECT *, {KEYS}, {_momenta(0)} FROM g)"
SQL["random_amplitudes"] = f"WITH {LAT}, {_GRID} SELECT kx, ky, kz, CASE WHEN {_CORNER} THEN 0.0 ELSE round(1e6 / (ni * nj * nk) / {_K2}, 6) END::DOUBLE AS power FROM w"
SQL["random_vector_pol"] = f"""WITH {LAT}, {_GRID} SELECT kx, ky, kz, CASE WHEN ({_CORNER}) OR (ei = 0 AND ej = 0 AND ek = 0) THEN 0.0 ELSE round(3e6 / (ni * nj * nk) / sqrt({_K2}), 5) END::DOUBLE AS power FROM w"""
SQL["random_vector"] = f"WITH {LAT} SELECT i, j, k, 0.0::DOUBLE AS div, true AS lives FROM lat"


# --- time steps of f' = g, g' = -f - g / 10 by dt = 0.1: each stage is a CTE


def _classical(stages: list[list[tuple[int, dict[int, str], str]]], copies: int) -> str:
    """Stages of (copy written, weights of copies, weight of the right-hand side); the latter reads copy 0, then copy 1."""
    start = ", ".join(f"{'x' if q == 0 else 'NULL::DOUBLE'} AS f{q}, {'y' if q == 0 else 'NULL::DOUBLE'} AS g{q}" for q in range(copies))
    ctes = [f"s0 AS (SELECT i, j, k, {start} FROM (SELECT i, j, k, f / 1000.0::DOUBLE AS x, g / 10.0::DOUBLE AS y FROM lat))"]
    n = 0
    for stage, steps in enumerate(stages):
        read = 0 if stage == 0 else 1
        columns = ", ".join(f"f{q}, g{q}" for q in range(copies))
        ctes.append(f"r{stage} AS (SELECT i, j, k, {columns}, g{read} AS rf, -f{read} - g{read} / 10 AS rg FROM s{n})")
        last = f"r{stage}"
        for to, weights, w in steps:
            n += 1
            new = {x: " + ".join([f"{c} * {x}{q}" for q, c in weights.items()] + [f"0.1::DOUBLE * {w} * r{x}"]) for x in "fg"}
            columns = ", ".join(f"{new[x] if q == to else f'{x}{q}'} AS {x}{q}" for q in range(copies) for x in "fg")
            ctes.append(f"s{n} AS (SELECT i, j, k, {columns}, rf, rg FROM {last})")
            last = f"s{n}"
    return f"WITH {LAT}, {', '.join(ctes)} SELECT i, j, k, round(f0 + 3.7e-9, 7) + 0.0 AS f, round(g0 + 3.7e-9, 7) + 0.0 AS g FROM s{n}"


def _low_storage(a: list[str], b: list[str]) -> str:
    ctes = ["s0 AS (SELECT i, j, k, f / 1000.0::DOUBLE AS f, g / 10.0::DOUBLE AS g, 0.0::DOUBLE AS kf, 0.0::DOUBLE AS kg FROM lat)"]
    for n, (x, y) in enumerate(zip(a, b, strict=True), 1):
        ctes.append(f"k{n} AS (SELECT i, j, k, f, g, ({x})::DOUBLE * kf + 0.1::DOUBLE * g AS kf, ({x})::DOUBLE * kg + 0.1::DOUBLE * (-f - g / 10) AS kg FROM s{n - 1})")
        ctes.append(f"s{n} AS (SELECT i, j, k, f + ({y})::DOUBLE * kf AS f, g + ({y})::DOUBLE * kg AS g, kf, kg FROM k{n})")
    return f"WITH {LAT}, {', '.join(ctes)} SELECT i, j, k, round(f + 3.7e-9, 7) + 0.0 AS f, round(g + 3.7e-9, 7) + 0.0 AS g FROM s{len(a)}"


_D = "::DOUBLE"
_half, _third, _sixth = "(1 / 2.0::DOUBLE)", "(1 / 3.0::DOUBLE)", "(1 / 6.0::DOUBLE)"
SQL["step_RungeKutta4"] = _classical([[(1, {0: 1}, _half), (2, {0: 1}, _sixth)], [(1, {0: 1}, _half), (2, {2: 1}, _third)], [(1, {0: 1}, "1"), (2, {2: 1}, _third)], [(0, {2: 1}, _sixth)]], 3)
SQL["step_RungeKutta3Heun"] = _classical([[(1, {0: 1}, _third), (2, {0: 1}, "0.25::DOUBLE")], [(1, {0: 1}, "(2 / 3.0::DOUBLE)")], [(0, {2: 1}, "0.75::DOUBLE")]], 3)
SQL["step_RungeKutta3Nystrom"] = _classical([[(1, {0: 1}, "(2 / 3.0::DOUBLE)"), (2, {0: 1}, "0.25::DOUBLE")], [(1, {0: 1}, "(2 / 3.0::DOUBLE)"), (2, {2: 1}, "0.375::DOUBLE")], [(0, {2: 1}, "0.375::DOUBLE")]], 3)
SQL["step_RungeKutta3Ralston"] = _classical([[(1, {0: 1}, _half), (2, {0: 1}, "(2 / 9.0::DOUBLE)")], [(1, {0: 1}, "0.75::DOUBLE"), (2, {2: 1}, _third)], [(0, {2: 1}, "(4 / 9.0::DOUBLE)")]], 3)
SQL["step_RungeKutta3SSP"] = _classical([[(1, {0: 1}, "1")], [(1, {0: "0.75::DOUBLE", 1: "0.25::DOUBLE"}, "0.25::DOUBLE")], [(0, {0: _third, 1: "(2 / 3.0::DOUBLE)"}, "(2 / 3.0::DOUBLE)")]], 2)
SQL["step_RungeKutta2Midpoint"] = _classical([[(1, {0: 1}, _half)], [(0, {0: 1}, "1")]], 2)
SQL["step_RungeKutta2Heun"] = _classical([[(1, {0: 1}, "1"), (0, {0: 1}, _half)], [(0, {0: 1}, _half)]], 2)
SQL["step_RungeKutta2Ralston"] = _classical([[(1, {0: 1}, "(2 / 3.0::DOUBLE)"), (0, {0: 1}, "0.25::DOUBLE")], [(0, {0: 1}, "0.75::DOUBLE")]], 2)
SQL["step_LowStorageRK3Williamson"] = _low_storage(["0", "-5 / 9.0::DOUBLE", "-153 / 128.0::DOUBLE"], ["1 / 3.0::DOUBLE", "15 / 16.0::DOUBLE", "8 / 15.0::DOUBLE"])
SQL["step_LowStorageRK3Inhomogeneous"] = _low_storage(["0", "-17 / 32.0::DOUBLE", "-32 / 27.0::DOUBLE"], ["0.25", "8 / 9.0::DOUBLE", "0.75"])
SQL["step_LowStorageRK3Symmetric"] = _low_storage(["0", "-2 / 3.0::DOUBLE", "-1"], ["1 / 3.0::DOUBLE", "1", "0.5"])
SQL["step_LowStorageRK3PredictorCorrector"] = _low_storage(["0", "-0.25", "-4 / 3.0::DOUBLE"], ["0.5", "2 / 3.0::DOUBLE", "0.5"])
SQL["step_LowStorageRK54"] = _low_storage(
    ["0", "-567301805773 / 1357537059087::DOUBLE", "-2404267990393 / 2016746695238::DOUBLE", "-3550918686646 / 2091501179385::DOUBLE", "-1275806237668 / 842570457699::DOUBLE"],
    ["1432997174477 / 9575080441755::DOUBLE", "5161836677717 / 13612068292357::DOUBLE", "1720146321549 / 2090206949498::DOUBLE", "3134564353537 / 4481467310338::DOUBLE", "2277821191437 / 14882151754819::DOUBLE"],
)
# The published coefficients of the longer methods, and those of the strong-stability preserving one.
SQL["step_LowStorageRK144"] = _low_storage(
    ["0", "-0.718801210867241", "-0.778533117342157", "-0.0053282796654044", "-0.8552979934029281", "-3.956413824577456", "-1.578057538058738", "-2.083709455257405", "-0.748333418276161", "-0.7032861106563359", "0.0013917096117681", "-0.09320753696374599", "-0.9514200470875948", "-7.115157169392255"],
    ["0.0367762454319673", "0.3136296607553959", "0.1531848691869027", "0.0030097086818182", "0.332629379064611", "0.2440251405350864", "0.3718879239592277", "0.6204126221582444", "0.1524043173028741", "0.0760894927419266", "0.0077604214040978", "0.0024647284755382", "0.0780348340049386", "5.505977727026963"],
)
SQL["step_LowStorageRK134"] = _low_storage(
    ["0", "-0.6160178650170565", "-0.4449487060774118", "-1.095203334527618", "-1.225603078595919", "-0.2740182222332805", "-0.0411952089052647", "-0.179708489915356", "-1.177153065206429", "-0.4078831463120878", "-0.8295636426191777", "-4.789597058425229", "-0.6606671432964504"],
    ["0.0271990297818803", "0.1772488819905108", "0.0378528418949694", "0.6086431830142991", "0.21543139743161", "0.2066152563885843", "0.0415864076069797", "0.0219891884310925", "0.9893081222650993", "0.0063199019859826", "0.3749640721105318", "1.608023515100319", "0.0961209123818189"],
)
SQL["step_LowStorageRK124"] = _low_storage(
    ["0", "-0.0923311242368072", "-0.9441056581158819", "-4.327127324757639", "-2.155777132902607", "-0.9770727190189062", "-0.7581835342571139", "-1.79775254708255", "-2.691566797270077", "-4.646679896026814", "-0.1539613783825189", "-0.5943293901830616"],
    ["0.0650008435125904", "0.0161459902249842", "0.5758627178358159", "0.1649758848361671", "0.3934619494248182", "0.0443509641602719", "0.2074504268408778", "0.6914247433015102", "0.3766646883450449", "0.0757190350155483", "0.2027862031054088", "0.2167029365631842"],
)
SQL["step_LowStorageRK3SSP"] = _low_storage(
    ["0", "-2.915492524638904", "-9.354196991098471e-08"],
    ["0.924574", "0.2877130631867484", "0.6265381095127404"],
)
SQL["wave_step"] = f"""WITH {LAT}, s AS (SELECT i, j, k, ni, nj, nk, f / 1000.0::DOUBLE AS f, g / 10.0::DOUBLE AS g FROM lat), {_lap_cte(table="s", name="l0")},
  h AS (SELECT s.i, s.j, s.k, s.ni, s.nj, s.nk, s.f AS f0, s.g AS g0, s.f + 0.05 * s.g AS f, s.g + 0.05 * v AS g FROM s JOIN l0 USING (i, j, k)), {_lap_cte(table="h", name="l1")}
  SELECT h.i, h.j, h.k, round(f0 + 0.1 * g, 6) + 0.0 AS f, round(g0 + 0.1 * v, 6) + 0.0 AS g FROM h JOIN l1 USING (i, j, k)"""

# --- multigrid

_WEIGHTS = ", ".join(f"({a}, {b}, {c}, {2.0 ** -(3 + abs(a) + abs(b) + abs(c))})" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))
_COARSE = f"coarse AS (SELECT c.i // 2 AS i, c.j // 2 AS j, c.k // 2 AS k, sum(t.w * x.f)::DOUBLE AS f {_near(_WEIGHTS, 'WHERE c.i % 2 = 0 AND c.j % 2 = 0 AND c.k % 2 = 0')} GROUP BY c.i, c.j, c.k)"
SQL["full_weighting"] = f"WITH {LAT}, {_COARSE} SELECT i, j, k, round(f, 6) + 0.0 AS f FROM coarse"
SQL["restrict_correct"] = f"WITH {LAT}, {_COARSE} SELECT c.i, c.j, c.k, round(lat.f - c.f, 6) + 0.0 AS f FROM coarse c JOIN lat ON lat.i = 2 * c.i AND lat.j = 2 * c.j AND lat.k = 2 * c.k"


def _axis(table: str, out: str, axis: str, weights: dict[int, str]) -> str:
    """Odd cells along one axis from even ones."""
    n = f"n{axis}"
    taps = ", ".join(f"({d}, {w})" for d, w in weights.items())
    place = ", ".join("y.at" if a == axis else f"x.{a}" for a in "ijk")
    odd = f"SELECT {place}, x.ni, x.nj, x.nk, sum(w * x.f) AS f FROM {table} x CROSS JOIN (VALUES {taps}) t(d, w) JOIN (SELECT CAST(unnest(range(1, {n}, 2)) AS INT) AS at, {n} FROM size) y ON x.{axis} = (y.at + d + 2 * y.{n}) % y.{n} GROUP BY {place}, x.ni, x.nj, x.nk"
    return f"{out} AS (SELECT i, j, k, ni, nj, nk, f FROM {table} UNION ALL {odd})"


def _interpolated(weights: dict[int, str]) -> str:
    start = "p0 AS (SELECT i, j, k, ni, nj, nk, f::DOUBLE AS f FROM lat WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0)"
    return ", ".join([start, _axis("p0", "p1", "i", weights), _axis("p1", "p2", "j", weights), _axis("p2", "p3", "k", weights)])


_LINEAR, _CUBIC = {-1: "0.5::DOUBLE", 1: "0.5::DOUBLE"}, {-3: "-0.0625::DOUBLE", -1: "0.5625::DOUBLE", 1: "0.5625::DOUBLE", 3: "-0.0625::DOUBLE"}
SQL["interp_linear"] = f"WITH {LAT}, {_interpolated(_LINEAR)} SELECT i, j, k, round(f, 6) + 0.0 AS f FROM p3"
SQL["interp_cubic"] = f"WITH {LAT}, {_interpolated(_CUBIC)} SELECT i, j, k, round(f, 6) + 0.0 AS f FROM p3"
SQL["interp_correct"] = f"WITH {LAT}, {_interpolated(_LINEAR)} SELECT p3.i, p3.j, p3.k, round(p3.f + lat.f, 6) + 0.0 AS f FROM p3 JOIN lat USING (i, j, k)"
SQL["jacobi_sweep"] = f"""WITH {LAT}, {_lap_cte()} SELECT lat.i, lat.j, lat.k, round(0.5 * f + 0.5 * (g - (v - f + 7 * f)) / -7.0::DOUBLE, 6) + 0.0 AS f FROM lat JOIN lap USING (i, j, k)"""
SQL["newton_sweep"] = f"""WITH {LAT}, s AS (SELECT i, j, k, ni, nj, nk, f / 10000.0::DOUBLE AS f, g / 100.0::DOUBLE AS g FROM lat), {_lap_cte(table="s")}
  SELECT s.i, s.j, s.k, round(f - 0.5 * (v - f * f * f - f - g) / (-6 - 3 * f * f - 1), 8) + 0.0 AS f FROM s JOIN lap USING (i, j, k)"""
SQL["residual_norms"] = f"""WITH {LAT}, {_lap_cte()}, r AS (SELECT (g - (v - f))::DOUBLE AS r FROM lat JOIN lap USING (i, j, k))
  SELECT round(max(abs(r)), 3) AS max_f, round(sqrt(sum(r * r) / count(*)), 3) AS rms_f FROM r"""
SQL["lhs_correction"] = f"WITH {LAT}, {_lap_cte()} SELECT lat.i, lat.j, lat.k, round((2 + v - f)::DOUBLE, 3) + 0.0 AS g FROM lat JOIN lap USING (i, j, k)"



_SIX_NEAR = ", ".join(f"({_along(a, sign)})" for a in range(3) for sign in (1, -1))


def _sum_cte(name: str, table: str, column: str = "f") -> str:
    """CTE of the sum over a cell's six neighbours."""
    return f"""{name} AS MATERIALIZED (SELECT c.i, c.j, c.k, sum(x.{column}) AS v FROM {table} c CROSS JOIN (VALUES {_SIX_NEAR}) AS t(di, dj, dk)
  JOIN {table} x ON x.i = (c.i + t.di + c.ni) % c.ni AND x.j = (c.j + t.dj + c.nj) % c.nj AND x.k = (c.k + t.dk + c.nk) % c.nk GROUP BY ALL)"""


def _relaxed(name: str, table: str, sweeps: int, dx: int) -> list[str]:
    """CTEs ending in ``name``: damped Jacobi sweeps, by 3 / 4, of (sum of neighbours - 6 f) / dx^2 - f = g."""
    out, at = [], table
    for n in range(sweeps):
        to = name if n == sweeps - 1 else f"{name}_{n}"
        out.append(_sum_cte(f"{to}_s", at))
        out.append(f"{to} AS MATERIALIZED (SELECT i, j, k, ni, nj, nk, g, 0.25 * f + 0.75 * (g - v / {dx * dx}) / (-6 / {dx * dx}.0::DOUBLE - 1) AS f FROM {at} JOIN {to}_s USING (i, j, k))")
        at = to
    return out


def _coarser(name: str, table: str, column: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT c.i // 2 AS i, c.j // 2 AS j, c.k // 2 AS k, c.ni // 2 AS ni, c.nj // 2 AS nj, c.nk // 2 AS nk, sum(t.w * x.{column})::DOUBLE AS {column}
  {_near(_WEIGHTS, 'WHERE c.i % 2 = 0 AND c.j % 2 = 0 AND c.k % 2 = 0', table)} GROUP BY c.i, c.j, c.k, c.ni, c.nj, c.nk)"""


def _two_levels(full: bool) -> str:
    """Two sweeps, four on the coarser lattice, two again. ``full`` moves the solution, else only its error moves."""
    steps = ["s AS MATERIALIZED (SELECT i, j, k, ni, nj, nk, 0.0::DOUBLE AS f, g - 49.5::DOUBLE AS g FROM lat)", *_relaxed("a", "s", 2, 1)]
    steps += [_sum_cte("an", "a"), "ar AS MATERIALIZED (SELECT i, j, k, ni, nj, nk, g - (v - 7 * f) AS r FROM a JOIN an USING (i, j, k))", _coarser("cr", "ar", "r")]
    if full:
        steps += [_coarser("cf", "a", "f"), _sum_cte("cn", "cf"), "c AS MATERIALIZED (SELECT i, j, k, cf.ni, cf.nj, cf.nk, f, r + (v / 4 - 2.5 * f) AS g FROM cf JOIN cn USING (i, j, k) JOIN cr USING (i, j, k))"]
    else:
        steps += ["c AS MATERIALIZED (SELECT i, j, k, ni, nj, nk, 0.0::DOUBLE AS f, r AS g FROM cr)"]
    steps += _relaxed("d", "c", 4, 2)
    change = "d.f - cf.f AS f FROM d JOIN cf USING (i, j, k)" if full else "d.f AS f FROM d"
    steps += [f"p0 AS MATERIALIZED (SELECT CAST(2 * d.i AS INT) AS i, CAST(2 * d.j AS INT) AS j, CAST(2 * d.k AS INT) AS k, 2 * d.ni AS ni, 2 * d.nj AS nj, 2 * d.nk AS nk, {change})"]
    steps += [_axis(f"p{n}", f"p{n + 1}", x, _LINEAR) for n, x in enumerate("ijk")]
    steps += ["e AS MATERIALIZED (SELECT a.i, a.j, a.k, a.ni, a.nj, a.nk, a.g, a.f + p3.f AS f FROM a JOIN p3 ON p3.i = a.i AND p3.j = a.j AND p3.k = a.k)", *_relaxed("z", "e", 2, 1)]
    return f"WITH {LAT}, {', '.join(steps)} SELECT i, j, k, round(f, 6) + 0.0 AS f FROM z"


SQL["fas_vcycle"], SQL["linear_vcycle"] = _two_levels(True), _two_levels(False)
_CYCLES = {
    ("v_cycle", 1): "0 10, 1 20, 0 20",
    ("v_cycle", 2): "0 10, 1 10, 2 20, 1 20, 0 20",
    ("v_cycle", 3): "0 10, 1 10, 2 10, 3 20, 2 20, 1 20, 0 20",
    ("w_cycle", 1): "0 10, 1 20, 0 20",
    ("w_cycle", 2): "0 10, 1 10, 2 20, 1 20, 2 20, 1 20, 0 20",
    ("w_cycle", 3): "0 10, 1 10, 2 10, 3 20, 2 20, 3 20, 2 20, 1 20, 2 10, 3 20, 2 20, 3 20, 2 20, 1 20, 0 20",
    ("f_cycle", 1): "0 10, 1 20, 0 20",
    ("f_cycle", 2): "0 10, 1 10, 2 20, 1 20, 2 20, 1 20, 0 20",
    ("f_cycle", 3): "0 10, 1 10, 2 10, 3 20, 2 20, 3 20, 2 20, 1 20, 2 10, 3 20, 2 20, 1 20, 0 20",
}
_LEVELS = ", ".join(f"('{kind}', {depth}, {n}, {', '.join(visit.split())})" for (kind, depth), text in _CYCLES.items() for n, visit in enumerate(text.split(", ")))
SQL["cycles"] = f"SELECT * FROM (VALUES {_LEVELS}) t(kind, depth, place, level, sweeps)"

# --- models

_STATE = """st AS (SELECT i, j, k, f / 10000.0::DOUBLE AS f0, g / 100.0::DOUBLE AS f1, g / 50.0::DOUBLE AS d0, f / 20000.0::DOUBLE AS d1, (f - g) / 10000.0::DOUBLE AS l0, g / 200.0::DOUBLE AS l1 FROM lat)"""
SQL["scalar_energy"] = f"""WITH {LAT}, {_STATE} SELECT round(avg(d0 * d0) / 4.5, 9) + 0.0 AS kinetic_0, round(avg(d1 * d1) / 4.5, 9) + 0.0 AS kinetic_1, round(avg(f0 * f0 / 2 + f0 * f0 * f1 * f1), 9) + 0.0 AS potential_0,
  round(avg(-f0 * l0) / 4.5, 9) + 0.0 AS gradient_0, round(avg(-f1 * l1) / 4.5, 9) + 0.0 AS gradient_1 FROM st"""
SQL["scalar_rhs"] = f"""WITH {LAT}, {_STATE} SELECT i, j, k, round(d0 + 3.7e-10, 8) + 0.0 AS rhs_f_0, round(l0 - 0.6 * d0 - 2.25 * (f0 + 2 * f0 * f1 * f1) + 3.7e-10, 8) + 0.0 AS rhs_dfdt_0,
  round(d1 + 3.7e-10, 8) + 0.0 AS rhs_f_1, round(l1 - 0.6 * d1 - 2.25 * 2 * f0 * f0 * f1 + 3.7e-10, 8) + 0.0 AS rhs_dfdt_1 FROM st"""
_WAVES = ", ".join(
    f"round({0.25 * n} + 3.7e-9, 7) + 0.0 AS rhs_hij_{n}, round({0.5 + n} - 0.6 * {0.25 * n} + 16 * pi() * {a * b} * (f0 * f0 + f1 * f1) + 3.7e-9, 7) + 0.0 AS rhs_dhijdt_{n}"
    for n, (a, b) in enumerate(((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)))
)
SQL["stress_tensor"] = f"""WITH {LAT}, {_STATE}, q AS (SELECT *, (d0 * d0 + d1 * d1 - 14 * (f0 * f0 + f1 * f1)) / 4.5 - (f0 * f0 / 2 + f0 * f0 * f1 * f1) AS lag FROM st)
  SELECT i, j, k, round(d0 * d0 + d1 * d1 - 2.25 * lag + 3.7e-9, 7) + 0.0 AS t00, round(d0 * f0 + d1 * f1 + 3.7e-9, 7) + 0.0 AS t01, round(4 * (f0 * f0 + f1 * f1) + 2.25 * lag + 3.7e-9, 7) + 0.0 AS t22,
  round(2 * (f0 * f0 + f1 * f1) + 3.7e-9, 7) + 0.0 AS s12, {_WAVES} FROM q"""
SQL["field_layout"] = """SELECT *, '0 <= i < Ni, 0 <= j < Nj, 0 <= k < Nk' AS domain FROM (VALUES ('f', '(q, Nx, Ny, Nz)'), ('h', '(q, 3, a, Nx+2, Ny+2, Nz+2)'), ('line', '(q, Nz)'),
  ('m', '(q)'), ('w', '(Nx, Ny, Nz)'), ('y', '(q, Nx+2*p, Ny+2*p, Nz+2*p)')) t(name, shape)"""
SQL["expr_simplify"] = f"WITH {LAT} SELECT i, j, k, g + f + 6 * f + 1 + abs(f) AS y, '((((g[i, j, k] + f[i, j, k]) + (6 * f[i, j, k])) + 1) + abs(f[i, j, k]))' AS spelt FROM lat"
SQL["reduce_callback"] = f"WITH {LAT} SELECT round(stddev_pop(g), 9) AS spread FROM lat"
SQL["allreduce"] = f"WITH {LAT} SELECT 'sum' AS op, sum(g - 50)::DOUBLE AS value FROM lat UNION ALL SELECT 'max', max(g - 50) FROM lat UNION ALL SELECT 'min', min(g - 50) FROM lat"
SQL["halo_restore"] = f"""WITH {LAT}, b AS (SELECT bi, bj, ni, nj, nk FROM size, range(2) a(bi), range(2) c(bj)), x AS (SELECT *, unnest(range(-1, ni // 2 + 1)) AS i FROM b),
  y AS (SELECT *, unnest(range(0, nj // 2)) AS j FROM x), p AS (SELECT *, unnest(range(-2, nk + 2)) AS k FROM y)
  SELECT CAST(bi * 2 + bj AS INT) AS block, CAST(p.i AS INT) AS i, CAST(p.j AS INT) AS j, CAST(p.k AS INT) AS k, f FROM p
  LEFT JOIN lat ON lat.i = bi * (p.ni // 2) + p.i AND lat.j = bj * (p.nj // 2) + p.j AND lat.k = p.k AND p.i BETWEEN 0 AND p.ni // 2 - 1"""
SQL["block_numbers"] = f"""WITH {LAT}, cut AS (SELECT ni // 4 AS q, ni % 4 AS r FROM size),
  b AS (SELECT CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END AS bi, j // (nj // 2) AS bj FROM lat, cut)
  SELECT CAST(bi * 2 + bj AS INT) AS block, CAST(bi AS INT) AS bi, CAST(bj AS INT) AS bj, CAST((bi + 3) % 4 * 2 + bj AS INT) AS before, CAST((bi + 1) % 4 * 2 + bj AS INT) AS behind,
    CAST(bi * 2 + (bj + 1) % 2 AS INT) AS beside, count(*) AS cells FROM b GROUP BY bi, bj"""
SQL["output_append"] = f"WITH {LAT} SELECT t::BIGINT AS t, round(avg(g + t), 9) AS mean FROM lat, range(2) r(t) GROUP BY t"
SQL["expansion"] = """WITH t AS (SELECT event_type, 1 + avg(value) / 100 AS rho, (row_number() OVER (ORDER BY event_type) - 1) % 5 AS n FROM events GROUP BY event_type),
  w AS (SELECT *, 1 + 3 * CASE n WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1 / 3.0::DOUBLE WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 ELSE -0.25 END AS p FROM t), x AS (SELECT *, 1 + p / 2 * sqrt(rho / 3) AS y FROM w)
  SELECT event_type, round(pow(y, 2 / p), 6) AS a, round(sqrt(rho / 3) / y, 6) AS hubble FROM x"""
