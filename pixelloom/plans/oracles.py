"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

from pixelloom.sources.fixtures import pixels_sql

SMALL = ["gradient128", "flat128", "alpha128"]
P = "CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b"
Y8 = "((r * 16839 + g * 33059 + b * 6420 + 32768 + 1048576) >> 16)"
MOD = lambda e: f"((({e}) % 256 + 256) % 256)"
CLIP = lambda e: f"least(greatest({e}, 0), 255)"
INDEX = "WITH d AS (SELECT *, sha256(text) AS h FROM documents), s AS (SELECT *, CASE WHEN CAST('0x' || substr(h, 1, 4) AS BIGINT) * 100 < {p} * 65536 THEN 'holdout' ELSE 'train' END AS split FROM d) "


def _mode_residuals() -> tuple[str, dict[str, str]]:
    """CTEs px, n, m and, per channel, the wrapped residual of a row of n and mode of m."""
    lags = ", ".join(f"lag({c}, {n}) OVER w AS {k}_{c}" for c in "rgba" for k, n in (("l", 1), ("t", 128), ("tr", 127), ("tl", 129)))
    apart = lambda k: " + ".join(f"abs(l_{c} + t_{c} - tl_{c} - {k}_{c})" for c in "rgba")
    avg = lambda x, y: f"(({x} + {y}) // 2)"
    parts = {}
    for c in "rgba":
        one, t, tr, tl = (f"{k}_{c}" for k in ("l", "t", "tr", "tl"))
        zero = 255 if c == "a" else 0
        half = avg(one, t)
        forms = [str(zero), one, t, tr, tl, avg(avg(one, tr), t), avg(one, tl), half, avg(tl, t), avg(t, tr), avg(avg(one, tl), avg(t, tr)), f"CASE WHEN {apart('l')} < {apart('t')} THEN {one} ELSE {t} END", CLIP(f"{one} + {t} - {tl}"), CLIP(f"{half} + CAST(trunc(({half} - {tl}) / 2.0) AS INTEGER)")]
        by = "CASE mode " + " ".join(f"WHEN {m} THEN {e}" for m, e in enumerate(forms)) + " END"
        parts[c] = MOD(f"{c} - CASE WHEN x = 0 AND y = 0 THEN {zero} WHEN y = 0 THEN {one} WHEN x = 0 THEN {t} ELSE {by} END")
    return f"px AS ({pixels_sql(SMALL)}), n AS (SELECT *, {lags} FROM px WINDOW w AS (PARTITION BY img ORDER BY pos)), m AS (SELECT CAST(range AS INTEGER) AS mode FROM range(14))", parts


def _predictors() -> str:
    ctes, parts = _mode_residuals()
    return f"WITH {ctes} SELECT img, mode, {', '.join(f'sum({e}) AS {c}' for c, e in parts.items())} FROM n, m GROUP BY img, mode"


ENTROPY = "CASE WHEN sum(n) < 2 THEN 0.0 ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END"


def _block_predictors() -> str:
    ctes, parts = _mode_residuals()
    long = " UNION ALL ".join(f"SELECT img, tx, ty, mode, '{c}' AS c, {c} AS s FROM r" for c in "rgba")
    return f"""WITH {ctes}, r AS (SELECT img, x >> 5 AS tx, y >> 5 AS ty, mode, {', '.join(f'{e} AS {c}' for c, e in parts.items())} FROM n, m), l AS (SELECT img, tx, ty, mode, c, s, count(*) AS n FROM ({long}) GROUP BY ALL),
e AS (SELECT img, tx, ty, mode, c, {ENTROPY} AS e FROM l GROUP BY img, tx, ty, mode, c), k AS (SELECT img, tx, ty, mode, round(sum(e), 4) AS cost FROM e GROUP BY img, tx, ty, mode)
SELECT img, tx, ty, mode, cost FROM k QUALIFY row_number() OVER (PARTITION BY img, tx, ty ORDER BY cost, mode) = 1"""


def _profiles() -> str:
    far = lambda n: " + ".join(f"abs({c} - lead({c}, {n}) OVER w)" for c in "rgba")
    return f"""WITH px AS ({pixels_sql(SMALL)}), j AS (SELECT *, CASE WHEN x + 1 < 128 THEN {far(1)} END AS d1, {far(128)} AS d2 FROM px WINDOW w AS (PARTITION BY img ORDER BY pos)),
s AS (SELECT img, count(*) AS samples, least(count(DISTINCT {P}), 257) AS colours, count(*) FILTER (WHERE a <> 255) AS translucent, CAST(coalesce(sum(d1), 0) + coalesce(sum(d2), 0) AS BIGINT) AS delta, count(d1) + count(d2) AS pairs FROM j WHERE pos % 8 = 0 GROUP BY img)
SELECT *, CASE WHEN samples = 0 THEN 'balanced' WHEN translucent * 2 >= samples THEN 'alpha' WHEN colours <= 1 THEN 'flat' WHEN pairs > 0 AND delta <= pairs * 48 THEN 'gradient' WHEN colours >= 128 THEN 'photo' ELSE 'balanced' END AS kind FROM s"""


def _repeats() -> str:
    product = lambda v, k: f"CAST((CAST({v} AS HUGEINT) * {k}) % 4294967296 AS BIGINT)"
    h = f"xor(xor({product('p', 0x1E35A7BD)}, {product('p1', 0x85EBCA6B)}), {product('p2', 0xC2B2AE35)})"
    return f"""WITH px AS ({pixels_sql(['ui256', 'palette256', 'alpha128'])}), q AS (SELECT img, pos, {P} AS p FROM px), t AS (SELECT img, pos, p, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2 FROM q WINDOW w AS (PARTITION BY img ORDER BY pos)),
u AS (SELECT *, {h} AS g FROM t WHERE p2 IS NOT NULL), v AS (SELECT *, xor(g, g >> 16) >> 16 AS h FROM u),
z AS (SELECT img, lag(p) OVER k = p AND lag(p1) OVER k = p1 AND lag(p2) OVER k = p2 AS same, pos - lag(pos) OVER k AS d FROM v WINDOW k AS (PARTITION BY img, h ORDER BY pos))
SELECT img, count(*) AS hashed, count(*) FILTER (WHERE same) AS repeats, count(*) FILTER (WHERE same AND d <= 1024) AS near FROM z GROUP BY img"""


def _alpha() -> str:
    guess = {"none": "0", "horizontal": "CASE WHEN x > 0 THEN l WHEN y > 0 THEN t ELSE 0 END", "vertical": "CASE WHEN y > 0 THEN t WHEN x > 0 THEN l ELSE 0 END", "gradient": f"CASE WHEN x = 0 AND y = 0 THEN 0 WHEN x = 0 THEN t WHEN y = 0 THEN l ELSE {CLIP('l + t - tl')} END"}
    long = " UNION ALL ".join(f"SELECT img, '{k}' AS filter, {MOD(f'a - {e}')} AS v FROM n" for k, e in guess.items())
    return f"""WITH px AS ({pixels_sql(['alpha128'])}), n AS (SELECT *, lag(a, 1) OVER w AS l, lag(a, 128) OVER w AS t, lag(a, 129) OVER w AS tl FROM px WINDOW w AS (PARTITION BY img ORDER BY pos)),
c AS (SELECT img, filter, v, count(*) AS n FROM ({long}) GROUP BY ALL) SELECT img, filter, count(*) AS symbols, round({ENTROPY}, 4) AS entropy FROM c GROUP BY img, filter"""


def _near(bits: int, name: str = "px") -> str:
    """CTEs n<bits>..n1: the passes of near-lossless smoothing."""
    out, source = [], name
    for b in range(bits, 0, -1):
        smooth = " AND ".join(f"coalesce(abs({c} - {f}({c}, {n}) OVER w) < {1 << b}, false)" for c in "rgb" for f in ("lag", "lead") for n in (1, 128))
        half = ((1 << b) - 1) // 2
        value = lambda c: f"CASE WHEN x > 0 AND x < 127 AND y > 0 AND y < 127 AND NOT s THEN CASE WHEN {c} + {half} + ({c} >> {b}) % 2 > 255 THEN 255 ELSE (({c} + {half} + ({c} >> {b}) % 2) >> {b}) << {b} END ELSE {c} END AS {c}"  # noqa: B023, E731
        out.append(f"s{b} AS (SELECT *, {smooth} AS s FROM {source} WINDOW w AS (PARTITION BY img ORDER BY pos)), n{b} AS (SELECT img, width, height, pos, x, y, {', '.join(value(c) for c in 'rgb')}, a FROM s{b})")
        source = f"n{b}"
    return ", ".join(out)


def _full(k: str) -> tuple[str, str, str]:
    r, g, b = (f"{k}_{c}" for c in "rgb")
    return f"(({r} * 19595 + {g} * 38470 + {b} * 7471 + 32768) >> 16)", CLIP(f"floor((-11056 * {r} - 21712 * {g} + 32768 * {b} + 8421376) / 65536.0)"), CLIP(f"floor((32768 * {r} - 27440 * {g} - 5328 * {b} + 8421376) / 65536.0)")


def _distortion() -> str:
    pair = ", ".join(f"s.{c} AS s_{c}, d.{c} AS d_{c}" for c in "rgba")
    comp = lambda bg: " + ".join(f"((d_{c} * d_a + {bg} * (255 - d_a) + 127) // 255 - (s_{c} * s_a + {bg} * (255 - s_a) + 127) // 255) ** 2" for c in "rgb")
    ys, yd = _full("s"), _full("d")
    sq = " + ".join(f"(d_{c} - s_{c}) ** 2" for c in "rgb")
    sums = {"sq": (sq, 3, "rgb"), "ysq": (f"({yd[0]} - {ys[0]}) ** 2", 1, "y"), "uvsq": (f"({yd[1]} - {ys[1]}) ** 2 + ({yd[2]} - {ys[2]}) ** 2", 2, "uv"), "black": (comp(0), 3, "black"), "white": (comp(255), 3, "white"), "checker": (comp("(CASE WHEN ((x >> 3) + (y >> 3)) % 2 <> 0 THEN 255 ELSE 0 END)"), 3, "checker")}
    agg = ", ".join(f"sum({e}) AS {k}" for k, (e, _, _) in sums.items())
    out = ", ".join(f"round({k} / (n * {d}), 6) AS {name}_mse, CASE WHEN {k} > 0 THEN round(10 * log10(65025.0 / ({k} / (n * {d}))), 6) END AS {name}_psnr" for k, (_, d, name) in sums.items())
    return f"""WITH px AS ({pixels_sql(SMALL)}), {_near(3)}, p AS (SELECT s.img, s.pos, s.x, s.y, {pair} FROM px s JOIN n1 d ON s.img = d.img AND s.pos = d.pos),
m AS (SELECT img, CAST(count(*) AS DOUBLE) AS n, sum(abs(d_r - s_r) + abs(d_g - s_g) + abs(d_b - s_b)) AS ab, sum(abs(d_a - s_a)) AS aab, bool_and(d_r = s_r AND d_g = s_g AND d_b = s_b) AS rgb_exact, bool_and(d_a = s_a) AS alpha_exact, {agg} FROM p GROUP BY img)
SELECT img, round(ab / (n * 3), 6) AS rgb_mae, round(aab / n, 6) AS alpha_mae, rgb_exact, alpha_exact, {out} FROM m"""


def _ssim() -> str:
    ys, yd = _full("s")[0], _full("d")[0]
    pair = ", ".join(f"s.{c} AS s_{c}, d.{c} AS d_{c}" for c in "rgb")
    return f"""WITH px AS ({pixels_sql(SMALL)}), {_near(4)}, p AS (SELECT s.img, s.pos, s.x, s.y, {pair} FROM px s JOIN n1 d ON s.img = d.img AND s.pos = d.pos),
v AS (SELECT img, x, y, {ys} AS s, {yd} AS t FROM p), k AS (SELECT range - 3 AS o, 4 - abs(range - 3) AS w FROM range(7)),
m AS (SELECT v.img, v.x + kx.o AS cx, v.y + ky.o AS cy, sum(kx.w * ky.w) AS w, sum(kx.w * ky.w * s) AS s, sum(kx.w * ky.w * t) AS t, sum(kx.w * ky.w * s * s) AS ss, sum(kx.w * ky.w * s * t) AS st, sum(kx.w * ky.w * t * t) AS tt
      FROM v, k kx, k ky WHERE v.x + kx.o BETWEEN 0 AND 127 AND v.y + ky.o BETWEEN 0 AND 127 GROUP BY ALL),
z AS (SELECT img, CASE WHEN s * s + t * t < w * w * 64 THEN 1.0 ELSE least(greatest(CAST(2 * s * t + w * w * 20 AS DOUBLE) * CAST((greatest(st * w - s * t, 0) * 2 + w * w * 60) // 256 AS DOUBLE)
      / (CAST(s * s + t * t + w * w * 20 AS DOUBLE) * CAST((ss * w - s * s + tt * w - t * t + w * w * 60) // 256 AS DOUBLE)), 0.0), 1.0) END AS q FROM m)
SELECT img, round(avg(q), 6) AS ssim FROM z GROUP BY img"""


def _colour() -> str:
    s = lambda c: f"CAST(({c} + 128) % 256 - 128 AS DOUBLE)"
    byte = lambda e: f"CAST(least(greatest(round({e}), -128), 127) AS INTEGER)"
    delta = lambda t, c: f"CAST(floor((({t} + 128) % 256 - 128) * (({c} + 128) % 256 - 128) / 32.0) AS INTEGER)"
    return f"""WITH px AS ({pixels_sql(SMALL)}), m AS (SELECT img, {', '.join(f'sum({s(a)} * {s(b)}) AS {a}{b}' for a, b in ('gg', 'rr', 'gr', 'gb', 'rb'))} FROM px GROUP BY img),
e AS (SELECT img, {byte('gr * 32 / CASE WHEN gg = 0 THEN 1 ELSE gg END')} AS green_to_red,
  CASE WHEN abs(gg * rr - gr * gr) > 1e-9 THEN {byte('(gb * rr - rb * gr) * 32 / (gg * rr - gr * gr)')} WHEN gg >= rr AND gg > 0 THEN {byte('gb * 32 / gg')} ELSE 0 END AS green_to_blue,
  CASE WHEN abs(gg * rr - gr * gr) > 1e-9 THEN {byte('(rb * gg - gb * gr) * 32 / (gg * rr - gr * gr)')} WHEN gg >= rr AND gg > 0 THEN 0 WHEN rr > 0 THEN {byte('rb * 32 / rr')} ELSE 0 END AS red_to_blue FROM m)
SELECT px.img, sum({MOD('r - ' + delta('green_to_red', 'g'))}) AS r, sum({MOD('b - ' + delta('green_to_blue', 'g') + ' - ' + delta('red_to_blue', 'r'))}) AS b, any_value(green_to_red) AS green_to_red, any_value(green_to_blue) AS green_to_blue, any_value(red_to_blue) AS red_to_blue
FROM px JOIN e ON px.img = e.img GROUP BY px.img"""


def _chroma() -> str:
    cb = CLIP("CAST(floor((-9719 * r - 19081 * g + 28800 * b + 32768 + 8388608) / 65536.0) AS INTEGER)")
    cr = CLIP("CAST(floor((28800 * r - 24116 * g - 4684 * b + 32768 + 8388608) / 65536.0) AS INTEGER)")
    pick = lambda k: f"CASE WHEN max({k}) FILTER (WHERE inn) - min({k}) FILTER (WHERE inn) <= 16 THEN (sum({k}) FILTER (WHERE inn) + 2) // 4 ELSE (sum({k} * w) + 18) // 36 END AS {k}"
    return f"""WITH px AS ({pixels_sql(SMALL)}), c AS (SELECT img, x, y, {cb} AS cb, {cr} AS cr FROM px), g AS (SELECT range AS c FROM range(64)), o AS (SELECT range - 1 AS o FROM range(4)),
f AS (SELECT cx.c AS cx, cy.c AS cy, least(greatest(cx.c * 2 + ox.o, 0), 127) AS x, least(greatest(cy.c * 2 + oy.o, 0), 127) AS y, (CASE WHEN ox.o IN (0, 1) THEN 2 ELSE 1 END) * (CASE WHEN oy.o IN (0, 1) THEN 2 ELSE 1 END) AS w, ox.o IN (0, 1) AND oy.o IN (0, 1) AS inn FROM g cx, g cy, o ox, o oy),
z AS (SELECT img, cx, cy, {pick('cb')}, {pick('cr')} FROM c JOIN f ON c.x = f.x AND c.y = f.y GROUP BY img, cx, cy)
SELECT img, count(*) AS n, sum(cb) AS cb, sum(cr) AS cr FROM z GROUP BY img"""


def _yuv() -> str:
    cb = CLIP("CAST(floor((-9719 * r - 19081 * g + 28800 * b + 32768 + 8388608) / 65536.0) AS INTEGER)")
    cr = CLIP("CAST(floor((28800 * r - 24116 * g - 4684 * b + 32768 + 8388608) / 65536.0) AS INTEGER)")
    s = lambda c, k: f"(({c} * {k}) // 256)"
    six = lambda e: CLIP(f"CAST(floor(({e}) / 64.0) AS INTEGER)")
    y = s("y8", 19077)
    return f"""WITH px AS ({pixels_sql()}), v AS (SELECT img, {Y8} AS y8, {cb} AS cb, {cr} AS cr FROM px),
z AS (SELECT *, {six(y + ' + ' + s('cr', 26149) + ' - 14234')} AS r2, {six(y + ' - ' + s('cb', 6419) + ' - ' + s('cr', 13320) + ' + 8708')} AS g2, {six(y + ' + ' + s('cb', 33050) + ' - 17685')} AS b2 FROM v)
SELECT img, sum(y8) AS y8, sum(cb) AS cb, sum(cr) AS cr, sum(r2) AS r2, sum(g2) AS g2, sum(b2) AS b2 FROM z GROUP BY img"""


def _activity() -> str:
    return f"""px AS ({pixels_sql()}), s AS (SELECT img, x // 16 AS mbx, y // 16 AS mby, x, y, {Y8} AS v FROM px WHERE x % 2 = 0 AND y % 2 = 0),
g AS (SELECT img, mbx, mby, sum(v) AS t, sum(v * v) AS q, sum(d1 + d2) AS gr FROM (SELECT *, CASE WHEN x % 16 > 0 THEN abs(v - lag(v) OVER (PARTITION BY img, mbx, mby, y ORDER BY x)) ELSE 0 END AS d1, CASE WHEN y % 16 > 0 THEN abs(v - lag(v) OVER (PARTITION BY img, mbx, mby, x ORDER BY y)) ELSE 0 END AS d2 FROM s) GROUP BY ALL),
act AS (SELECT img, mbx, mby, (q * 64 - t * t + 2048) // 4096 + ((gr + 63) // 112) * ((gr + 63) // 112) * 4 AS activity FROM g)"""


def _segments() -> str:
    return f"""WITH {_activity()}, l AS (SELECT img, list(activity ORDER BY activity) AS a, count(*) AS n FROM act GROUP BY img),
h AS (SELECT *, a[n // 8 + 1] AS lo, a[n * 7 // 8 + 1] AS hi, CASE WHEN n >= 192 THEN 4 WHEN n >= 48 THEN 3 ELSE 2 END AS t FROM l),
c AS (SELECT img, CASE WHEN hi > lo + greatest(16, lo // 3) AND n >= 16 THEN list_distinct(list_filter([a[greatest(n // t, 1)], CASE WHEN t > 2 THEN a[greatest(n * 2 // t, 1)] END, CASE WHEN t > 3 THEN a[greatest(n * 3 // t, 1)] END], lambda v: v IS NOT NULL AND v < a[n])) ELSE [] END AS cuts FROM h),
z AS (SELECT act.img, activity, CAST(len(list_filter(cuts, lambda v: activity > v)) AS INTEGER) AS segment FROM act JOIN c ON act.img = c.img)
SELECT img, segment, count(*) AS n, min(activity) AS low, max(activity) AS high FROM z GROUP BY img, segment"""


def _palette(names: list[str]) -> str:
    return f"px AS ({pixels_sql(names)}), q AS (SELECT *, {P} AS p FROM px), d AS (SELECT DISTINCT img, p FROM q), t AS (SELECT img, p, row_number() OVER (PARTITION BY img ORDER BY p) - 1 AS idx, count(*) OVER (PARTITION BY img) AS n FROM d QUALIFY n <= 256)"


def _offsets() -> str:
    parts = [f"SELECT img, CAST({d} AS BIGINT) AS distance, count(*) AS n FROM (SELECT img, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY img ORDER BY pos) AS i, same FROM (SELECT img, pos, coalesce(lag(p, {d}) OVER (PARTITION BY img ORDER BY pos) = p, false) AS same FROM q)) WHERE same GROUP BY img, i" for d in (1, 255, 256, 257)]
    return f"WITH px AS ({pixels_sql(['ui256', 'palette256'])}), q AS (SELECT img, pos, {P} AS p FROM px), u AS ({' UNION ALL '.join(parts)}) SELECT img, distance, CAST(sum(n) AS BIGINT) AS matches, max(n) AS longest FROM u GROUP BY img, distance"


def _hits() -> str:
    parts = [f"SELECT img, {n} AS bits, CAST(count(*) FILTER (WHERE h) AS BIGINT) AS hits FROM (SELECT img, lag(p) OVER (PARTITION BY img, ((p * 506832829) & 4294967295) >> {32 - n} ORDER BY pos) = p AS h FROM q) GROUP BY img" for n in (1, 4, 8, 11)]
    return f"WITH px AS ({pixels_sql(['ui256', 'palette256', 'alpha128'])}), q AS (SELECT img, pos, {P} AS p FROM px) {' UNION ALL '.join(parts)}"


_UNPACK = {"a": "(p >> 24) & 255", "r": "(p >> 16) & 255", "g": "(p >> 8) & 255", "b": "p & 255"}

ORACLES = {
    "corpus_split_summary": INDEX.format(p=20) + "SELECT count(*) AS files, count(DISTINCT h) AS distinct_files, count(*) - count(DISTINCT h) AS duplicates, count(*) FILTER (WHERE split = 'holdout') AS holdout, count(*) FILTER (WHERE split = 'train') AS train, CAST(sum(n_chars) AS BIGINT) AS total FROM s",
    "corpus_index": INDEX.format(p=25) + "SELECT doc_id, substr(h, 1, 16) AS id, split FROM s",
    "corpus_digest": "WITH a AS (SELECT sha256(text) AS k, sha256(text) AS d FROM documents), " + ", ".join(f"{to} AS (SELECT substr(k, 1, {n}) AS k, sha256(string_agg(d, ',' ORDER BY k, d)) AS d FROM {of} GROUP BY substr(k, 1, {n}))" for of, to, n in (("a", "b", 6), ("b", "c", 4), ("c", "e", 2))) + " SELECT sha256(string_agg(d, ',' ORDER BY k)) AS digest FROM e",
    "corpus_distribution": "WITH l AS (SELECT lang, list(n_chars ORDER BY n_chars) AS a, count(*) AS n FROM documents GROUP BY lang) SELECT lang, a[1] AS min, a[(n - 1) * 50 // 100 + 1] AS p50, a[(n - 1) * 90 // 100 + 1] AS p90, a[n] AS max FROM l",
    "corpus_grouping_sets": "SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS total, grouping_id(lang, source) AS grouping FROM documents GROUP BY GROUPING SETS ((), (lang), (source))",
    "timing_statistics": "WITH t AS (SELECT l_suppkey, list(CAST(floor(l_extendedprice) AS BIGINT) ORDER BY l_extendedprice) AS v, count(*) AS runs, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1) SELECT l_suppkey, runs, v[(runs + 1) // 2] + (v[runs // 2 + 1] - v[(runs + 1) // 2]) // 2 AS median_ns, total // runs AS mean_ns FROM t",
    "image_sums": f"WITH px AS ({pixels_sql()}) SELECT img, count(*) AS pixels, CAST(sum({P}) AS BIGINT) AS total, count(DISTINCT {P}) AS colours, bool_and(a = 255) AS opaque, min({P}) = max({P}) AS uniform FROM px GROUP BY img",
    "image_entropy": f"WITH px AS ({pixels_sql()}), l AS (" + " UNION ALL ".join(f"SELECT img, '{c}' AS channel, {e} AS symbol FROM px" for c, e in (("r", MOD("r - g")), ("g", "g"), ("b", MOD("b - g")), ("a", "a"))) + "), n AS (SELECT img, channel, symbol, count(*) AS n FROM l GROUP BY ALL) SELECT img, channel, CAST(sum(n) AS BIGINT) AS pixels, count(*) AS symbols, round(CASE WHEN sum(n) < 2 THEN 0 ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END, 4) AS entropy FROM n GROUP BY img, channel",
    "image_hidden_rgb": "WITH px AS (SELECT 'hidden16' AS img, (x * 17 + 3) % 256 AS r, (y * 13 + 5) % 256 AS g, (x * y + 7) % 256 AS b, CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE 255 END AS a FROM (SELECT range % 16 AS x, range // 16 AS y FROM range(256))), l AS (" + " UNION ALL ".join(f"SELECT img, '{c}' AS channel, CAST({c} AS INTEGER) AS symbol FROM px" for c in "rgba") + ") SELECT img, channel, symbol, count(*) AS n FROM l GROUP BY ALL",
    "image_yuv": _yuv(),
    "image_predictors": _predictors(),
    "image_colour_transform": _colour(),
    "image_near_lossless": f"WITH px AS ({pixels_sql(SMALL)}), {_near(3)} SELECT img, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM n1 GROUP BY img",
    "image_distortion": _distortion(),
    "image_ssim": _ssim(),
    "image_chroma_planes": _chroma(),
    "image_palette": f"WITH {_palette(['ui256', 'flat128', 'palette256', 'gradient128'])}, j AS (SELECT q.img, y, x, idx, CASE WHEN n <= 2 THEN 3 WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 1 ELSE 0 END AS k FROM q JOIN t ON q.img = t.img AND q.p = t.p), z AS (SELECT img, y, x >> k AS px, sum(idx << CAST((x - ((x >> k) << k)) * (8 >> k) AS INTEGER)) AS packed FROM j GROUP BY ALL) SELECT img, count(*) AS n, CAST(sum(packed) AS BIGINT) AS packed FROM z GROUP BY img",
    "image_palette_deltas": f"WITH {_palette(['ui256', 'palette256'])}, c AS (SELECT img, idx, {', '.join(f'{e} AS {k}' for k, e in _UNPACK.items())} FROM t) SELECT img, CAST(idx AS INTEGER) AS idx, {', '.join('CAST(' + MOD(f'{k} - coalesce(lag({k}) OVER (PARTITION BY img ORDER BY idx), 0)') + f' AS INTEGER) AS d{k}' for k in 'rgba')} FROM c",
    "image_cache_hits": _hits(),
    "image_runs": f"WITH px AS ({pixels_sql(['ui256', 'flat128'])}), q AS (SELECT img, pos, {P} AS p FROM px), i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY img ORDER BY pos) AS run FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY img ORDER BY pos) = p, false) AS same FROM q)) SELECT img, min(pos) AS start, count(*) AS length, min(p) AS p FROM i GROUP BY img, run HAVING count(*) >= 4",
    "image_offset_matches": _offsets(),
    "image_activity": f"WITH {_activity()} SELECT img, mbx, mby, CAST(activity AS BIGINT) AS activity FROM act",
    "image_segments": _segments(),
    "image_lossless": f"WITH px AS ({pixels_sql(SMALL)}) SELECT img, count(*) AS pixels, CAST(sum({P}) AS BIGINT) AS total FROM px GROUP BY img",
    "image_profiles": _profiles(),
    "image_tile_entropy": f"WITH px AS ({pixels_sql(['ui256', 'alpha128'])}), l AS (" + " UNION ALL ".join(f"SELECT img, x >> 5 AS tx, y >> 5 AS ty, '{c}' AS channel, {c} AS s FROM px" for c in "rgba") + f"), c AS (SELECT img, tx, ty, channel, s, count(*) AS n FROM l GROUP BY ALL) SELECT img, tx, ty, channel, count(*) AS symbols, round({ENTROPY}, 4) AS entropy FROM c GROUP BY img, tx, ty, channel",
    "image_block_predictors": _block_predictors(),
    "image_hash_repeats": _repeats(),
    "image_alpha_filters": _alpha(),
    "codes_distance": "WITH p AS (SELECT x, y FROM (SELECT range - 7 AS x FROM range(16)), (SELECT range AS y FROM range(8)) WHERE y > 0 OR x > 0), n AS (SELECT x + y * 100 AS distance, row_number() OVER (ORDER BY x * x + y * y, abs(x), x < 0) AS i FROM p), k AS (SELECT distance, min(i) AS i FROM n GROUP BY 1) SELECT d.range AS distance, coalesce(k.i, d.range + 120) AS code FROM range(1, 4000) d LEFT JOIN k ON k.distance = d.range",
    "codes_prefix": "WITH v AS (SELECT range AS v, range - 1 AS d FROM range(1, 5000)), t AS (SELECT v, d, CASE WHEN v <= 4 THEN 0 ELSE len(bin(d)) - 1 END AS top FROM v) SELECT v, CAST(CASE WHEN v <= 4 THEN v - 1 ELSE top * 2 + ((d >> (top - 1)) & 1) END AS INTEGER) AS symbol, CAST(CASE WHEN v <= 4 THEN 0 ELSE top - 1 END AS INTEGER) AS bits, CAST(CASE WHEN v <= 4 THEN 0 ELSE d % (1 << (top - 1)) END AS BIGINT) AS extra FROM t",
    "tables_quality": "WITH v AS (SELECT CAST(range AS INTEGER) AS v, least(range, 100) / 100.0 AS c FROM range(1, 257)) SELECT v, CAST(trunc(127 * (1 - cbrt(CASE WHEN c >= 0.75 THEN c * 2 - 1 ELSE c * (2.0 / 3.0) END))) AS INTEGER) AS q, CAST(greatest(v * v // 8, 1) AS BIGINT) AS lambda, CAST(trunc(log2(256.0 / v) * 256) AS BIGINT) AS cost, CAST(list_sum(list_transform(range(9), lambda i: ((v >> CAST(i AS INTEGER)) & 1) << CAST(8 - i AS INTEGER))) AS BIGINT) AS reversed, CAST(CASE WHEN least(v, 255) + 3 + (least(v, 255) >> 3) % 2 > 255 THEN 255 ELSE ((least(v, 255) + 3 + (least(v, 255) >> 3) % 2) >> 3) << 3 END AS INTEGER) AS near FROM v",
}


def on_samples(samples: str) -> dict[str, str]:
    psnr = lambda e: f"CASE WHEN {e} > 0 THEN round(10 * log10(65025.0 / ({e})), 6) END"
    return {
        "quality_aggregate": f"WITH {samples} SELECT l.quality, count(*) AS fixtures, CAST(sum(l.pixels) AS BIGINT) AS pixels, CAST(sum(l.bytes) AS BIGINT) AS l_bytes, CAST(sum(r.bytes) AS BIGINT) AS r_bytes, count(*) FILTER (WHERE l.bytes < r.bytes) AS l_smaller, count(*) FILTER (WHERE l.bytes > r.bytes) AS r_smaller, count(*) FILTER (WHERE l.bytes = r.bytes) AS equal, {psnr('avg(l.mse)')} AS l_psnr, {psnr('avg(r.mse)')} AS r_psnr, {psnr('sum(l.mse * l.pixels) / sum(l.pixels)')} AS l_psnr_weighted, {psnr('sum(r.mse * l.pixels) / sum(l.pixels)')} AS r_psnr_weighted FROM samples l JOIN samples r ON l.fixture = r.fixture AND l.quality = r.quality WHERE l.encoder = 'a' AND r.encoder = 'b' GROUP BY l.quality",
        "pareto_front": f"WITH {samples}, b AS (SELECT fixture, encoder, bytes AS rate, max(ssim_db) AS quality FROM samples WHERE ssim_db IS NOT NULL GROUP BY ALL), w AS (SELECT *, max(quality) OVER (PARTITION BY fixture, encoder ORDER BY rate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) SELECT fixture, encoder, rate, quality FROM w WHERE before IS NULL OR quality > before",
    }


def _integers(sql: str, *columns: str) -> str:
    """The same rows with DuckDB's wide sums as 64-bit integers."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({sql})"


for _name, _columns in {
    "image_yuv": ("y8", "cb", "cr", "r2", "g2", "b2"), "image_predictors": ("r", "g", "b", "a"), "image_colour_transform": ("r", "b"), "image_near_lossless": ("r", "g", "b"),
    "image_chroma_planes": ("cb", "cr"), "image_segments": ("low", "high"),
}.items():
    ORACLES[_name] = _integers(ORACLES[_name], *_columns)
