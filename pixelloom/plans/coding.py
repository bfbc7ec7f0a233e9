"""Queries of quantizers, options and candidate search, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import pixel as P
from pixelloom.functions import transforms, vp8l
from pixelloom.operators import blocks, options, planning, quantizers, search, stencils, tiles
from pixelloom.plans import oracles
from pixelloom.sources.fixtures import image, pixels, pixels_sql

SMALL = ["gradient128", "flat128", "alpha128"]
ARGB = "CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b"
CLIP = lambda e, lo, hi: f"least(greatest({e}, {lo}), {hi})"
#: log2 extra bits of a prefix-coded number v from 1 on.
EXTRA = lambda v: f"CASE WHEN {v} <= 4 THEN 0 ELSE CAST(floor(log2(CAST({v} - 1 AS DOUBLE))) AS INTEGER) - 1 END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def tables_quantizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantizers.indexes(spark)
    s, b, f, p = quantizers.steps(F.col("q"), uv_dc=-2), quantizers.biases(F.col("q"), "mild"), quantizers.loop_filter(F.col("q")), quantizers.quality_profile(F.col("q"))
    return q.select("q", *[c.cast("int").alias(k) for k, c in s.items()], b["y1_dc"].alias("luma_bias"), b["uv_ac"].alias("chroma_bias"), *[c.alias(k) for k, c in f.items()], *[p[k].alias(k) for k in ("luma_lambda", "chroma_lambda", "texture")])


def _quantizers_sql() -> str:
    at = lambda t, i, most=127: f"{t}[{CLIP(i, 0, most)} + 1]"
    dc, ac = (str(x) for x in (quantizers.DC_STEPS, quantizers.AC_STEPS))
    return f"""WITH q AS (SELECT CAST(range AS INTEGER) AS q, {dc} AS dc, {ac} AS ac FROM range(128))
SELECT q, {at('dc', 'q')} AS y1_dc, {at('ac', 'q')} AS y1_ac, greatest({at('dc', 'q')} * 2, 8) AS y2_dc, greatest({at('ac', 'q')} * 155 // 100, 8) AS y2_ac, {at('dc', 'q - 2', 117)} AS uv_dc, {at('ac', 'q')} AS uv_ac,
116 AS luma_bias, CASE WHEN q < 26 THEN {CLIP('130 - q // 4', 124, 128)} ELSE {CLIP('150 - q', 96, 124)} END AS chroma_bias, CASE WHEN q <= 8 THEN 2 + q // 6 ELSE least(4 + q // 6, 24) END AS level, least(q // 32, 3) AS sharpness, TRUE AS deltas,
CASE WHEN q <= 9 THEN 32 ELSE 64 END AS luma_lambda, 96 AS chroma_lambda, CASE WHEN q BETWEEN 15 AND 30 THEN 200 ELSE 0 END AS texture FROM q"""


def tables_efforts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizers.effort_profiles(quantizers.indexes(spark)).groupBy("mode", "keep_source", "sharp").agg(F.count("*").alias("indexes"), F.max("segments").alias("segments"), F.max("passes").alias("passes"), F.max("beam").alias("beam"))


EFFORTS_SQL = """WITH q AS (SELECT range AS q FROM range(128)), m AS (SELECT * FROM (VALUES ('default', 4, 1, 0), ('best', 4, 2, 2), ('fast', 1, 1, 0), ('low-memory', 1, 1, 0)) v(mode, segments, passes, beam)),
e AS (SELECT *, CASE WHEN mode = 'best' THEN TRUE WHEN mode = 'default' THEN q <= 9 ELSE FALSE END AS keep_source, mode = 'best' OR q <= 9 AS sharp FROM q, m)
SELECT mode, keep_source, sharp, count(*) AS indexes, max(segments) AS segments, max(passes) AS passes, max(beam) AS beam FROM e GROUP BY ALL"""


def tables_candidate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mb = spark.range(16).select((F.col("id") % 4).alias("mbx"), P.div(F.col("id"), 4).alias("mby"))
    return mb.select("mbx", "mby", F.array_join(quantizers.candidate_modes(F.col("mbx"), F.col("mby")), ",").alias("modes"))


MODES_SQL = "SELECT range % 4 AS mbx, range // 4 AS mby, 'dc' || CASE WHEN range >= 4 THEN ',vertical' ELSE '' END || CASE WHEN range % 4 > 0 THEN ',horizontal' ELSE '' END || CASE WHEN range >= 4 AND range % 4 > 0 THEN ',true-motion' ELSE '' END AS modes FROM range(16)"


def tables_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.range(11, 2048).select(F.col("id").alias("v"))
    c, first = quantizers.coefficient_category(F.col("v"))
    return v.select("v", c.alias("category"), first.alias("first"))


CATEGORIES_SQL = "SELECT range AS v, CASE WHEN range < 19 THEN 0 WHEN range < 35 THEN 1 WHEN range < 67 THEN 2 ELSE 3 END AS category, CASE WHEN range < 19 THEN 11 WHEN range < 35 THEN 19 WHEN range < 67 THEN 35 ELSE 67 END AS first FROM range(11, 2048)"


def image_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture of every 4 x 4 luma block, and its distance to that of a block of its mean."""
    b = blocks.luma_blocks(image(spark, "alpha128"))
    mean = P.div(F.aggregate("v", F.lit(0), lambda t, v: t + v), 16).cast("int")
    b = b.select(quantizers.texture(F.col("v")).alias("t"), quantizers.texture_distortion(F.col("v"), F.array_repeat(mean, 16)).alias("d"))
    return b.agg(F.count("*").alias("blocks"), F.sum("t").alias("texture"), F.min("t").alias("least"), F.max("t").alias("most"), F.sum("d").alias("distance"))


def _texture_sql() -> str:
    # a transform is a sum of all 16 values with signs: rows and columns of a 4 x 4 Hadamard matrix in the order that butterflies give
    signs = [[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]]
    term = lambda u, v: " ".join(f"{'+' if signs[u][y] * signs[v][x] > 0 else '-'} p{4 * y + x}" for y in range(4) for x in range(4))
    total = " + ".join(f"{quantizers.TEXTURE_WEIGHTS[4 * u + v]} * abs({term(u, v)})" for u in range(4) for v in range(4))
    luma = "((r * 16839 + g * 33059 + b * 6420 + 32768 + 1048576) >> 16)"
    take = ", ".join(f"sum(CASE WHEN (y % 4) * 4 + x % 4 = {i} THEN {luma} END) AS p{i}" for i in range(16))
    whole = " + ".join(f"p{i}" for i in range(16))
    return f"""WITH px AS ({pixels_sql(['alpha128'])}), b AS (SELECT x // 4 AS bx, y // 4 AS by, {take} FROM px GROUP BY ALL), t AS (SELECT CAST({total} AS BIGINT) AS t, CAST(38 * 16 * (({whole}) // 16) AS BIGINT) AS m FROM b)
SELECT count(*) AS blocks, CAST(sum(t) AS BIGINT) AS texture, min(t) AS least, max(t) AS most, CAST(sum(abs(t - m) // 32) AS BIGINT) AS distance FROM t"""


def segment_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _lines(spark, sf_dir).select("l_suppkey", (F.col("l_linenumber") % 5).alias("segment"))
    return quantizers.segment_probabilities(b, "l_suppkey")


_BRANCH = lambda z, n: f"CASE WHEN {n} <= 0 OR {z} >= {n} THEN 255 WHEN {z} <= 0 THEN 0 ELSE ({z} * 255 + {n} // 2) // {n} END"
SEGMENTS_SQL = f"""WITH c AS (SELECT l_suppkey, {', '.join(f'count(*) FILTER (WHERE l_linenumber % 5 = {s}) AS n{s}' for s in range(4))} FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, {_BRANCH('n0 + n1', '(n0 + n1 + n2 + n3)').replace('n0 + n1 *', '(n0 + n1) *')} AS p0, {_BRANCH('n0', '(n0 + n1)')} AS p1, {_BRANCH('n2', '(n2 + n3)')} AS p2 FROM c"""


def skip_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizers.skip_probability(_lines(spark, sf_dir).select("l_suppkey", (F.col("l_returnflag") == "R").alias("skipped")), "l_suppkey")


SKIP_SQL = "SELECT l_suppkey, count(*) AS blocks, CAST(least(greatest((count(*) FILTER (WHERE l_returnflag <> 'R') * 255 + count(*) // 2) // count(*), 1), 255) AS INTEGER) AS skip FROM lineitem GROUP BY l_suppkey"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _lines(spark, sf_dir).groupBy((F.col("l_partkey") % 1056).alias("node")).agg(F.count_if(F.col("l_linenumber") <= 2).alias("zero"), F.count_if(F.col("l_linenumber") > 2).alias("one"))
    return n.withColumns({"current": (F.col("node") % 255 + 1).cast("int"), "update": (F.lit(255) - F.col("node") % 50).cast("int")})


def token_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of 1,056 nodes get a new probability."""
    return quantizers.chosen_probabilities(_stats(spark, sf_dir)).select("node", "zero", "one", "sent", F.col("probability").cast("int").alias("probability"))


_COST = lambda p: f"CASE WHEN {p} <= 0 THEN 1073741824 ELSE CAST(floor(log2(256.0 / greatest({p}, 1)) * 256) AS BIGINT) END"
TOKENS_SQL = f"""WITH n AS (SELECT l_partkey % 1056 AS node, count(*) FILTER (WHERE l_linenumber <= 2) AS zero, count(*) FILTER (WHERE l_linenumber > 2) AS one FROM lineitem GROUP BY ALL),
s AS (SELECT *, node % 255 + 1 AS cur, 255 - node % 50 AS upd, least(greatest((zero * 256 + (zero + one) // 2) // (zero + one), 1), 255) AS est FROM n),
c AS (SELECT *, {_COST('upd')} + zero * ({_COST('cur')}) + one * ({_COST('256 - cur')}) AS keep, {_COST('256 - upd')} + 2048 + zero * ({_COST('est')}) + one * ({_COST('256 - est')}) AS change FROM s)
SELECT node, zero, one, est <> cur AND change < keep AS sent, CAST(CASE WHEN est <> cur AND change < keep THEN est ELSE cur END AS INTEGER) AS probability FROM c"""


def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of the tokens of each block that is not skipped."""
    t = _lines(spark, sf_dir).groupBy((F.col("l_orderkey") % 500).alias("block"), (F.col("l_partkey") % 1056).alias("node"), (F.col("l_linenumber") > 2).alias("bit")).agg(F.count("*").alias("n"))
    p = _stats(spark, sf_dir).select("node", F.col("current").alias("probability"))
    return search.token_cost(t.withColumn("skipped", F.col("block") % 7 == 0), p, "node")


TOKEN_COSTS_SQL = f"""WITH t AS (SELECT l_orderkey % 500 AS block, l_partkey % 1056 AS node, l_linenumber > 2 AS bit, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, node % 255 + 1 AS p FROM t WHERE block % 7 <> 0)
SELECT block, CAST(sum(n * CASE WHEN bit THEN {_COST('256 - p')} ELSE {_COST('p')} END) AS BIGINT) AS cost FROM c GROUP BY block"""


def options_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit(" "), F.upper(F.element_at(F.array(*[F.lit(m) for m in [*options.MODES, "none"]]), (F.col("o_orderkey") % 9 + 1).cast("int")))).alias("name"), (F.col("o_orderkey") % 130 - 10).cast("int").alias("quality"),
        F.concat_ws(",", F.col("o_custkey") % 110, F.lit(" 7 "), F.col("o_orderkey") % 104, F.lit("7")).alias("list"))
    return o.select("o_orderkey", options.mode(F.col("name")).alias("mode"), options.quality(F.col("quality")).alias("quality"), F.array_join(options.qualities(F.col("list")), ",").alias("qualities"))


OPTIONS_SQL = """WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS m, CAST(o_orderkey % 130 - 10 AS INTEGER) AS q, o_custkey % 110 AS a, o_orderkey % 104 AS b FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN 'default' WHEN 1 THEN 'fast' WHEN 2 THEN 'balanced' WHEN 3 THEN 'best' WHEN 4 THEN 'best' WHEN 5 THEN 'low-memory' WHEN 6 THEN 'lossy-quality' WHEN 7 THEN 'auto' END AS mode,
CASE WHEN q <= 0 THEN 100 ELSE least(q, 100) END AS quality, CASE WHEN a BETWEEN 1 AND 100 AND b BETWEEN 1 AND 100 THEN array_to_string(list_sort(list_distinct([a, 7, b])), ',') END AS qualities FROM o"""


def memory_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.floor("o_totalprice").cast("long") * 40).alias("px"), (F.col("o_custkey") % 5).alias("edges"), (F.col("o_orderkey") % 6).alias("finalists"))
    px, e = F.col("px"), F.col("edges")
    return o.select("o_orderkey", options.search_bytes(px, e).alias("bytes"), options.workers(px, F.col("finalists"), e, 4, 1 << 30).alias("workers"), options.fits(px).alias("fits"), options.auto_mode(px, F.col("edges") * 8, px * 8, px * F.col("finalists")).alias("mode"))


MEMORY_SQL = """WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 40 AS px, o_custkey % 5 AS e, o_orderkey % 6 AS f FROM orders), w AS (SELECT *, px * (44 + 8 * e) + 1048576 AS each FROM o)
SELECT o_orderkey, px * 16 + each AS bytes, CAST(CASE WHEN f < 2 OR px < 65536 OR each > 1073741824 THEN 1 ELSE greatest(1, least(f, 4, 1073741824 // each)) END AS INTEGER) AS workers, px * 4 <= 33554432 AS fits,
CASE WHEN px >= 16777216 THEN 'low-memory' WHEN px >= 65536 AND e * 8 <= 16 AND px * f * 4 <= px * 8 THEN 'fast' ELSE 'balanced' END AS mode FROM w"""


def container_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").cast("long").alias("n"))
    extra = lambda k: F.when(F.col("doc_id") % k == 0, F.col("n") % 1000).otherwise(0)
    header = options.extended_header(F.col("n") + 1, F.col("n") % 77 + 1, F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0)
    return d.select("doc_id", options.container_size(F.col("n") * 31, extra(3), extra(2), extra(5), extra(7)).alias("size"), F.lower(F.hex(header)).alias("header"))


def _containers_sql() -> str:
    e = lambda k: f"CASE WHEN doc_id % {k} = 0 THEN n % 1000 ELSE 0 END"
    chunk = lambda v: f"CASE WHEN {v} > 0 THEN {v} + {v} % 2 + 8 ELSE 0 END"
    byte = lambda v: f"printf('%02x', CAST(({v}) AS INTEGER))"
    three = lambda v: " || ".join(byte(f"(({v}) >> {8 * k}) & 255") for k in range(3))
    flags = "CASE WHEN doc_id % 2 = 0 THEN 32 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 16 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 0 END"
    return f"""WITH d AS (SELECT doc_id, CAST(n_chars AS BIGINT) AS n FROM documents), c AS (SELECT *, {e(3)} AS al, {e(2)} AS ic, {e(5)} AS ex, {e(7)} AS xm FROM d)
SELECT doc_id, 12 + CASE WHEN al > 0 OR ic > 0 OR ex > 0 OR xm > 0 THEN 18 ELSE 0 END + {' + '.join(chunk(v) for v in ('ic', 'al', '(n * 31)', 'ex', 'xm'))} AS size, '565038580a000000' || {byte(flags)} || '000000' || {three('n')} || {three('n % 77')} AS header FROM c"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lines(spark, sf_dir).groupBy((F.col("l_orderkey") % 300).alias("img"), F.col("l_partkey").alias("ord")).agg(F.min(F.floor("l_extendedprice").cast("long")).alias("literal_bits"), F.max(F.floor("l_quantity").cast("long")).alias("zeros"))
    return search.with_ranks(t.select("img", "ord", (F.col("ord") * 7 % 6).alias("family"), "literal_bits", (F.col("ord") % 900).alias("local_potential"), (F.col("ord") * 37 % 1100).alias("distant_potential"), "zeros"))


_CAND = """t AS (SELECT l_orderkey % 300 AS img, l_partkey AS ord, l_partkey * 7 % 6 AS family, min(CAST(floor(l_extendedprice) AS BIGINT)) AS lit, l_partkey % 900 AS lp, l_partkey * 37 % 1100 AS dp, max(CAST(floor(l_quantity) AS BIGINT)) AS z FROM lineitem GROUP BY ALL),
c AS (SELECT *, greatest(lit - lp * 8 - z, 0) AS local, greatest(lit - dp * 8 - z, 0) AS distant FROM t), k AS (SELECT *, least(local, distant) AS rank FROM c)"""


def candidate_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.frontier(_candidates(spark, sf_dir), "img").select("img", "family", "ord", "local", "distant", "rank")


FRONTIER_SQL = f"""WITH {_CAND}, a AS (SELECT *, row_number() OVER (PARTITION BY img, family ORDER BY local, ord) AS n FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY img, family, n = 1 ORDER BY distant, ord) AS m FROM a)
SELECT img, family, ord, local, distant, rank FROM b WHERE n = 1 OR m = 1"""


def candidate_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.reservoir(_candidates(spark, sf_dir), 8, "img").select("img", "family", "ord", "rank")


RESERVOIR_SQL = f"""WITH {_CAND}, a AS (SELECT *, row_number() OVER (PARTITION BY img, family ORDER BY rank, ord) > 1 AS spare FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY spare, family <> 0, rank, ord) AS n FROM a)
SELECT img, family, ord, rank FROM b WHERE n <= 8"""


def candidate_finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).select("img", "ord", F.col("rank").alias("bits"), (F.col("family") == 3).alias("predictor"), F.col("distant").alias("screened_bits"))
    return search.exact_finalists(c, 3, "img").select("img", "ord", "bits", "force_cache")


FINALISTS_SQL = f"""WITH {_CAND}, a AS (SELECT img, ord, rank AS bits, distant AS screened, family = 3 AS p, row_number() OVER (PARTITION BY img ORDER BY rank, ord) AS n, row_number() OVER (PARTITION BY img, family = 3 ORDER BY rank, ord) AS m FROM k),
b AS (SELECT *, max(bits) FILTER (WHERE n <= 3) OVER (PARTITION BY img) AS last FROM a) SELECT img, ord, bits, p AND m = 1 AS force_cache FROM b WHERE n <= 3 OR (p AND m = 1 AND screened < last)"""


def candidate_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose family was not scored yet, and which of them are refined."""
    c = search.first_of_each(_candidates(spark, sf_dir), ["img", "local_potential"])
    left = search.unscored(c, c.where("rank < 2000"), "img", "family")
    return search.refined_first(left.select("img", "family", "ord", F.col("rank").alias("bits")), 2, "img")


STAGES_SQL = f"""WITH {_CAND}, d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY img, lp ORDER BY ord) = 1), l AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.img = d.img AND o.family = d.family AND o.rank < 2000))
SELECT img, family, ord, rank AS bits, row_number() OVER (PARTITION BY img ORDER BY rank, ord) <= 2 AS refine FROM l"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select((F.col("l_orderkey") % 1000).alias("pos"), (F.col("l_partkey") % 500 + 1).alias("code"), (F.col("l_suppkey") * 13 % 4000 + 3).alias("length"))


def match_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_matches(_matches(spark, sf_dir), 4, "pos").select("pos", "code", "length", F.col("score").cast("long").alias("score"), F.col("place").cast("int").alias("place"))


_MATCH = "m AS (SELECT l_orderkey % 1000 AS pos, l_partkey % 500 + 1 AS code, l_suppkey * 13 % 4000 + 3 AS length FROM lineitem)"
MATCH_SQL = f"""WITH {_MATCH}, u AS (SELECT pos, code, max(length) AS length FROM m GROUP BY ALL), s AS (SELECT *, CAST(length * 8 - ({EXTRA('length')}) - ({EXTRA('code')}) AS BIGINT) AS score FROM u)
SELECT pos, code, length, score, CAST(row_number() OVER (PARTITION BY pos ORDER BY score DESC, length DESC, code) AS INTEGER) AS place FROM s QUALIFY place <= 4"""


def match_undominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir).select("pos", "length", (F.col("code") % 40).alias("cost")).distinct()
    return search.undominated(m, "pos")


UNDOMINATED_SQL = f"""WITH {_MATCH}, u AS (SELECT DISTINCT pos, length, code % 40 AS cost FROM m)
SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.pos = u.pos AND ((o.cost < u.cost AND o.length >= u.length) OR (o.cost = u.cost AND o.length > u.length)))"""


def match_extra_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.extra_bits(_matches(spark, sf_dir), "pos")


EXTRA_SQL = f"WITH {_MATCH} SELECT pos, count(*) AS copies, CAST(sum({EXTRA('length')} + {EXTRA('code')}) AS BIGINT) AS extra FROM m GROUP BY pos"


def image_row_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of alpha rows with the row above, by code."""
    m = search.row_matches(image(spark, "alpha128").withColumn("a", (F.col("a") / 16).cast("int")))
    return m.groupBy("img", "code").agg(F.count("*").alias("n"), F.sum("length").alias("pixels"), F.max("length").alias("longest"))


def _row_matches_sql() -> str:
    codes = ", ".join(f"({x}, {i + 1})" for i, (x, y) in enumerate(vp8l.NEAR) if y == 1 and -7 <= x <= 8)
    return f"""WITH px AS ({pixels_sql(['alpha128'])}), p AS (SELECT img, pos, x, y, a // 16 AS v FROM px), o AS (SELECT * FROM (VALUES {codes}) t(back, code)),
j AS (SELECT p.img, p.pos, p.x, p.y, o.back, o.code, p.v IS NOT DISTINCT FROM q.v AS same FROM p CROSS JOIN o LEFT JOIN p q ON q.img = p.img AND q.y = p.y - 1 AND q.x = p.x - o.back),
l AS (SELECT *, coalesce(min(CASE WHEN NOT same THEN x END) OVER (PARTITION BY img, y, back ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 128) - x AS length FROM j),
b AS (SELECT img, code, length FROM l WHERE length > 0 QUALIFY row_number() OVER (PARTITION BY img, pos ORDER BY length DESC, code) = 1)
SELECT img, code, count(*) AS n, CAST(sum(length) AS BIGINT) AS pixels, max(length) AS longest FROM b GROUP BY ALL"""


def image_cache_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.useful_caches(search.cache_costs(pixels(spark, ["ui256", "palette256", "alpha128"]), list(range(1, 12))))


CACHES_SQL = f"""WITH px AS ({pixels_sql(['ui256', 'palette256', 'alpha128'])}), p AS (SELECT img, pos, {ARGB} AS p FROM px), b AS (SELECT range + 1 AS bits FROM range(11)),
s AS (SELECT *, ((CAST(p AS HUGEINT) * 506832829) % 4294967296) >> (32 - bits) AS slot FROM p, b), h AS (SELECT *, lag(p) OVER (PARTITION BY img, bits, slot ORDER BY pos) = p AS hit FROM s),
c AS (SELECT img, CAST(bits AS INTEGER) AS bits, count(*) FILTER (WHERE hit) AS hits, count(*) AS n FROM h GROUP BY ALL) SELECT img, bits, hits, n - hits AS literals, hits * bits + (n - hits) * 32 AS cost FROM c WHERE hits >= 8"""


def image_sampled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.sampled_counts(pixels(spark, SMALL), 5, 256, P.wrap(F.col("r") - F.col("g")))
    return s.groupBy("img", "tx", "ty").agg(F.count("*").alias("symbols"), F.sum("n").alias("samples"), F.sum(F.col("value") * F.col("n")).alias("total"))


SAMPLED_SQL = f"""WITH px AS ({pixels_sql(SMALL)}), s AS (SELECT img, x >> 5 AS tx, y >> 5 AS ty, (r - g + 256) % 256 AS v FROM px WHERE ((y % 32) * 32 + x % 32) % 4 = 0)
SELECT img, tx, ty, count(DISTINCT v) AS symbols, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY ALL"""


def image_palette_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.palette(pixels(spark))
    return p.groupBy("img").agg(F.count("*").alias("colours"), F.sum(F.col("p") * (F.col("ord") + 1)).alias("seen"), F.sum(F.col("p") * (F.col("sorted") + 1)).alias("by_value"))


PALETTES_SQL = f"""WITH px AS ({pixels_sql()}), f AS (SELECT img, {ARGB} AS p, min(pos) AS first FROM px GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY img) AS n, row_number() OVER (PARTITION BY img ORDER BY first) AS a, row_number() OVER (PARTITION BY img ORDER BY p) AS b FROM f)
SELECT img, count(*) AS colours, CAST(sum(p * a) AS BIGINT) AS seen, CAST(sum(p * b) AS BIGINT) AS by_value FROM n WHERE n <= 256 GROUP BY img"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy((F.col("l_suppkey") % 20).alias("img"), (F.col("l_orderkey") % 64).alias("tile")).agg(F.max(F.when(F.col("l_linenumber") > 5, F.col("l_partkey") % 12)).alias("grp"))


def tile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.renumbered(search.forward_filled(_tiles(spark, sf_dir), "img"), "img").select("img", "tile", "grp")


TILES_SQL = """WITH t AS (SELECT l_suppkey % 20 AS img, l_orderkey % 64 AS tile, max(CASE WHEN l_linenumber > 5 THEN l_partkey % 12 END) AS grp FROM lineitem GROUP BY ALL),
f AS (SELECT img, tile, coalesce(last_value(grp IGNORE NULLS) OVER (PARTITION BY img ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS g FROM t), m AS (SELECT *, min(tile) OVER (PARTITION BY img, g) AS first FROM f)
SELECT img, tile, CAST(dense_rank() OVER (PARTITION BY img ORDER BY first) - 1 AS INTEGER) AS grp FROM m"""


def tile_regrouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _lines(spark, sf_dir).groupBy((F.col("l_suppkey") % 20).alias("img"), (F.col("l_orderkey") % 64).alias("tile"), (F.col("l_partkey") % 30).alias("symbol")).agg(F.count("*").alias("n"))
    costs = spark.range(20 * 4 * 30).select((F.col("id") % 20).alias("img"), (F.floor(F.col("id") / 20) % 4).alias("grp"), F.floor(F.col("id") / 80).alias("symbol"), (F.col("id") * 7 % 13 + 1).alias("bits")).where("(img + grp + symbol) % 5 > 0")
    return search.regrouped(h, costs, 16, "img")


REGROUP_SQL = """WITH h AS (SELECT l_suppkey % 20 AS img, l_orderkey % 64 AS tile, l_partkey % 30 AS symbol, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT range % 20 AS img, range // 20 % 4 AS grp, range // 80 AS symbol, range * 7 % 13 + 1 AS bits FROM range(2400)), k AS (SELECT * FROM c WHERE (img + grp + symbol) % 5 > 0), g AS (SELECT DISTINCT img, grp FROM k),
t AS (SELECT h.img, tile, g.grp, sum(n * coalesce(bits, 16)) AS cost FROM h JOIN g ON h.img = g.img LEFT JOIN k ON k.img = h.img AND k.grp = g.grp AND k.symbol = h.symbol GROUP BY ALL)
SELECT img, tile, grp, CAST(cost AS BIGINT) AS cost FROM t QUALIFY row_number() OVER (PARTITION BY img, tile ORDER BY cost, grp) = 1"""


def symbol_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _lines(spark, sf_dir).groupBy((F.col("l_suppkey") % 20).alias("img"), (F.col("l_partkey") % 40).alias("symbol")).agg(F.count("*").alias("n"))
    lengths = spark.range(20 * 30).select((F.col("id") % 20).alias("img"), F.floor(F.col("id") / 20).alias("symbol"), (F.col("id") % 9 + 1).alias("length"))
    return search.coded_bits(h, lengths, 16, "img")


SYMBOLS_SQL = """WITH h AS (SELECT l_suppkey % 20 AS img, l_partkey % 40 AS symbol, count(*) AS n FROM lineitem GROUP BY ALL), l AS (SELECT range % 20 AS img, range // 20 AS symbol, range % 9 + 1 AS length FROM range(600))
SELECT h.img, CAST(sum(n * coalesce(length, 16)) AS BIGINT) AS bits FROM h LEFT JOIN l ON h.img = l.img AND h.symbol = l.symbol GROUP BY h.img"""


def image_sharp_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = image(spark, "alpha128")
    s = search.sharp_chroma(px, stencils.chroma_planes(px, 128, 128))
    return s.groupBy("img").agg(F.count("*").alias("n"), F.sum("cb").alias("cb"), F.sum("cr").alias("cr"), F.sum("error").alias("error"))


def _sharp_sql() -> str:
    base = oracles._chroma().rsplit("SELECT", 1)[0].rstrip()  # up to the filtered samples z
    luma = "((r * 16839 + g * 33059 + b * 6420 + 32768 + 1048576) >> 16)"
    low = lambda e, n: f"CAST(floor(({e}) / {n}.0) AS INTEGER)"
    y = "((l * 19077) >> 8)"
    rgb = {"r": f"{y} + ((tcr * 26149) >> 8) - 14234", "g": f"{y} - ((tcb * 6419) >> 8) - ((tcr * 13320) >> 8) + 8708", "b": f"{y} + ((tcb * 33050) >> 8) - 17685"}
    error = " + ".join(f"({CLIP(low(e, 64), 0, 255)} - {k}) ** 2" for k, e in rgb.items())
    return f"""{base}, w AS (SELECT img, x // 2 AS cx, y // 2 AS cy, r, g, b, {luma} AS l FROM px WHERE img = 'alpha128'), m AS (SELECT img, x // 2 AS cx, y // 2 AS cy, CAST((sum(cb) + 2) // 4 AS INTEGER) AS mb, CAST((sum(cr) + 2) // 4 AS INTEGER) AS mr FROM c GROUP BY ALL),
d AS (SELECT CAST(range - 2 AS INTEGER) AS d FROM range(5)), zz AS (SELECT img, cx, cy, CAST(cb AS INTEGER) AS cb, CAST(cr AS INTEGER) AS cr FROM z WHERE img = 'alpha128'),
t AS (SELECT *, 0 AS n, cb AS tcb, cr AS tcr FROM zz UNION ALL SELECT zz.*, 1, cb + i.d, cr + j.d FROM zz, d i, d j UNION ALL SELECT zz.*, 2, mb + i.d, mr + j.d FROM zz JOIN m ON zz.img = m.img AND zz.cx = m.cx AND zz.cy = m.cy CROSS JOIN d i CROSS JOIN d j),
k AS (SELECT t.img, t.cx, t.cy, n, tcb, tcr, CAST(sum({error}) AS BIGINT) AS e FROM t JOIN w ON t.img = w.img AND t.cx = w.cx AND t.cy = w.cy WHERE tcb BETWEEN 0 AND 255 AND tcr BETWEEN 0 AND 255 GROUP BY ALL),
a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY img, cx, cy ORDER BY e, n, tcb, tcr) = 1) SELECT img, count(*) AS n, CAST(sum(tcb) AS BIGINT) AS cb, CAST(sum(tcr) AS BIGINT) AS cr, CAST(sum(e) AS BIGINT) AS error FROM a GROUP BY img"""


def fixture_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("fixture"))
    return options.product(f, [90, 50, 75, 50], ["ours", "theirs"])


PRODUCT_SQL = "SELECT s_suppkey AS fixture, q AS quality, e AS encoder FROM supplier, (VALUES (50), (75), (90)) a(q), (VALUES ('ours'), ('theirs')) b(e)"


def variant_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("fixture"), F.col("l_returnflag").alias("variant")).agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("bytes"))
    return search.ablation(r, "N")


ABLATION_SQL = """WITH r AS (SELECT l_partkey AS fixture, l_returnflag AS variant, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL), t AS (SELECT r.variant, count(*) AS fixtures, CAST(sum(r.bytes) AS BIGINT) AS bytes, CAST(sum(b.bytes) AS BIGINT) AS baseline_bytes FROM r JOIN r b ON b.variant = 'N' AND b.fixture = r.fixture GROUP BY r.variant)
SELECT *, round((bytes - baseline_bytes) * 100.0 / baseline_bytes, 6) AS percent FROM t"""


def plane_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-range samples in limited range, similarity in decibels, and near-lossless smoothing by quality."""
    v = spark.range(256).select(F.col("id").cast("int").alias("v"))
    s = F.col("v") / 256.0
    return v.select("v", P.full_to_limited_luma(F.col("v")).cast("int").alias("y"), P.full_to_limited_chroma(F.col("v")).cast("int").alias("c"), F.round(P.ssim_db(s), 6).alias("db"), P.near_lossless_bits(F.col("v")).cast("int").alias("bits"), F.array_join(planning_kinds(F.col("v")), ",").alias("kinds"), search.may_add_block_colour(planning_kinds(F.col("v"))).alias("colour"), search.partition_fits(F.col("v") * 4096).alias("fits"))


def planning_kinds(v):
    """One of four transform chains."""
    chain = lambda *k: F.array(*[F.lit(x) for x in k]).cast("array<string>")
    return F.when(v % 4 == 0, chain()).when(v % 4 == 1, chain("predictor")).when(v % 4 == 2, chain("subtract-green", "predictor")).otherwise(chain("palette"))


SCALARS_SQL = """SELECT CAST(range AS INTEGER) AS v, CAST((range * 219 + 127) // 255 + 16 AS INTEGER) AS y, CAST(CASE WHEN range < 128 THEN 128 - (abs(range - 128) * 224 + 127) // 255 ELSE (abs(range - 128) * 224 + 127) // 255 + 128 END AS INTEGER) AS c,
round(-10 * log10(1 - range / 256.0), 6) AS db, CAST(CASE WHEN range >= 100 THEN 0 ELSE 5 - range // 20 END AS INTEGER) AS bits, CASE range % 4 WHEN 0 THEN '' WHEN 1 THEN 'predictor' WHEN 2 THEN 'subtract-green,predictor' ELSE 'palette' END AS kinds, range % 4 < 3 AS colour, range * 4096 <= 524287 AS fits FROM range(256)"""


def finalists_by_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.ranked(_candidates(spark, sf_dir).select("img", "family", "rank", "ord"), 5).select("img", "family", "rank", "ord", F.col("place").cast("int").alias("place"))


TURNS_SQL = f"""WITH {_CAND}, a AS (SELECT *, row_number() OVER (PARTITION BY img, family ORDER BY rank, ord) AS turn FROM k)
SELECT img, family, rank, ord, CAST(row_number() OVER (PARTITION BY img ORDER BY turn, rank, ord) AS INTEGER) AS place FROM a QUALIFY place <= 5"""


def fixtures_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked for by name: what there is, and what there is not."""
    have = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("img"))
    found, missing = planning.chosen(have, ["FRANCE", "NOWHERE", "JAPAN", "FRANCE", "ATLANTIS"])
    return found.select("img", "ord", F.lit(True).alias("found")).union(missing.select("img", "ord", F.lit(False).alias("found")))


MISSING_SQL = "SELECT w.img, w.ord, n.n_name IS NOT NULL AS found FROM (VALUES ('FRANCE', 0), ('NOWHERE', 1), ('JAPAN', 2), ('ATLANTIS', 3)) w(img, ord) LEFT JOIN nation n ON n.n_name = w.img"


def _block_transforms_sql() -> str:
    """Forward transform, quantization and the inverse, each on 16 columns."""
    luma = "((r * 16839 + g * 33059 + b * 6420 + 32768 + 1048576) >> 16)"
    names = lambda k: [f"{k}{i}" for i in range(16)]
    listed = lambda k, e: ", ".join(f"{x} AS {k}{i}" for i, x in enumerate(e))
    take = ", ".join(f"sum(CASE WHEN (y % 4) * 4 + x % 4 = {i} THEN {luma} END) AS v{i}" for i in range(16))
    down = lambda k, m: ["(" + " + ".join(f"CAST({m[i // 4][y]!r} AS DOUBLE) * {k}{4 * y + i % 4}" for y in range(4)) + ")" for i in range(16)]
    across = lambda k, m: ["(" + " + ".join(f"CAST({m[i % 4][x]!r} AS DOUBLE) * {k}{4 * (i // 4) + x}" for x in range(4)) + ")" for i in range(16)]
    level = lambda c: f"CAST(sign({c}) * least((abs({c}) * 256 + q * 128) // (q * 256), 2047) * q AS BIGINT)"
    shift = lambda e, n: f"CAST(floor(({e}) / {1 << n}.0) AS BIGINT)"

    def one(c: list[str]) -> list[str]:
        odd = [f"({shift(f'{c[1]} * 85627', 16)} + {shift(f'{c[3]} * 35468', 16)})", f"({shift(f'{c[1]} * 35468', 16)} - {shift(f'{c[3]} * 85627', 16)})"]
        return [f"{c[0]} + {c[2]} + {odd[0]}", f"{c[0]} - {c[2]} + {odd[1]}", f"{c[0]} - {c[2]} - {odd[1]}", f"{c[0]} + {c[2]} - {odd[0]}"]

    columns = [one([f"l{4 * y + i}" for y in range(4)]) for i in range(4)]
    rows = [one([f"m{4 * y + i}" for i in range(4)]) for y in range(4)]
    error = " + ".join(f"(v{i} - least(greatest(128 + {shift(f'{rows[i // 4][i % 4]} + 4', 3)}, 0), 255)) ** 2" for i in range(16))
    return f"""WITH px AS ({pixels_sql(['alpha128'])}), b AS (SELECT x // 4 AS bx, y // 4 AS by, {take} FROM px GROUP BY ALL), r AS (SELECT *, {listed('r', [f'v{i} - 128' for i in range(16)])} FROM b),
d AS (SELECT *, {listed('d', down('r', transforms.COSINE))} FROM r), c AS (SELECT *, {listed('c', [f'CAST(floor({e} * 0.5 + 0.5) AS BIGINT)' for e in across('d', transforms.COSINE)])} FROM d),
k AS (SELECT * FROM c, (VALUES (4), (16), (64)) t(q)), l AS (SELECT q, {', '.join(names('v'))}, {listed('l', [level(x) for x in names('c')])} FROM k),
m AS (SELECT *, {listed('m', [columns[i % 4][i // 4] for i in range(16)])} FROM l) SELECT q, count(*) AS blocks, CAST(sum({error}) AS BIGINT) AS squared FROM m GROUP BY q"""


IDENTITY_SQL = f"""WITH px AS ({pixels_sql(SMALL)}) SELECT img, sha256(unhex('8000000080000000' || string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY pos))) AS sha256, bool_or(a < 255) AS has_alpha FROM px GROUP BY img"""
#: SQL of queries that stand in the registry.
ORACLES = {"image_block_transforms": _block_transforms_sql(), "image_identity": IDENTITY_SQL}


def image_alpha_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an alpha plane is stored raw or coded, and under which filter."""
    px = pixels(spark, ["alpha128"])
    costs = planning.alpha_filter_costs(px, 128).withColumn("ord", F.array_position(F.array(*[F.lit(f) for f in ("none", "horizontal", "vertical", "gradient")]), F.col("filter")))
    coded = costs.withColumn("bytes", search.stream_bytes(F.col("symbols") * 4 + 60, F.ceil("entropy"), F.lit(0)))
    return search.alpha_choice(coded, px.groupBy("img").agg(F.count("*").alias("pixels")))


ALPHA_SQL = f"""WITH f AS ({oracles._alpha()}), c AS (SELECT img, CASE filter WHEN 'none' THEN 1 WHEN 'horizontal' THEN 2 WHEN 'vertical' THEN 3 ELSE 4 END AS ord, filter, TRUE AS packed, CAST(symbols * 4 + 60 + ceil(entropy) + 7 AS BIGINT) // 8 AS bytes FROM f
UNION ALL SELECT 'alpha128', -1, 'none', FALSE, 16384) SELECT img, filter, packed, bytes FROM c QUALIFY row_number() OVER (PARTITION BY img ORDER BY bytes, ord) = 1"""


def image_limited_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_lossless_planes(pixels(spark)).groupBy("img").agg(F.sum("y").alias("y"), F.sum("cb").alias("cb"), F.sum("cr").alias("cr"))


def _limited_sql() -> str:
    y, cb, cr = oracles._full("s")
    small = lambda c: f"CASE WHEN {c} < 128 THEN 128 - (abs({c} - 128) * 224 + 127) // 255 ELSE (abs({c} - 128) * 224 + 127) // 255 + 128 END"
    return f"""WITH px AS ({pixels_sql()}), s AS (SELECT img, r AS s_r, g AS s_g, b AS s_b FROM px), f AS (SELECT img, CAST({y} AS BIGINT) AS y, CAST({cb} AS BIGINT) AS cb, CAST({cr} AS BIGINT) AS cr FROM s)
SELECT img, CAST(sum((y * 219 + 127) // 255 + 16) AS BIGINT) AS y, CAST(sum({small('cb')}) AS BIGINT) AS cb, CAST(sum({small('cr')}) AS BIGINT) AS cr FROM f GROUP BY img"""


def image_tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile size and groups that code an image's channels in the fewest bits."""
    return tiles.entropy_plan(pixels(spark, ["alpha128", "flat128"]), [5, 6], [1, 4])


def image_colour_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.colour_elements(pixels(spark, ["gradient128", "alpha128"]), 6)


def tables_mode_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizers.mode_costs(spark)


_PATH = lambda path: " + ".join(_COST(str(256 - p if b else p)) for p, b in path)
MODE_COSTS_SQL = " UNION ALL ".join(f"SELECT '{plane}' AS plane, '{mode}' AS mode, CAST({_PATH(path)} AS BIGINT) AS cost" for plane, paths in (("luma", quantizers.LUMA_PATHS), ("chroma", quantizers.CHROMA_PATHS)) for mode, path in paths.items())


def segment_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantizer steps of macroblocks by their segment; some segments have no index of their own."""
    b = _lines(spark, sf_dir).select((F.col("l_suppkey") % 9).alias("img"), (F.col("l_linenumber") % 4).alias("segment"))
    s = spark.range(27).select((F.col("id") % 9).alias("img"), F.floor(F.col("id") / 9).cast("int").alias("segment"), (F.col("id") * 5 % 128).cast("int").alias("q"))
    return quantizers.segment_steps(b, s, 60).groupBy("img", "segment", "q", "y1_dc", "y1_ac", "uv_ac").agg(F.count("*").alias("blocks"))


def _segment_steps_sql() -> str:
    dc, ac = (str(x) for x in (quantizers.DC_STEPS, quantizers.AC_STEPS))
    return f"""WITH b AS (SELECT l_suppkey % 9 AS img, l_linenumber % 4 AS segment, count(*) AS blocks FROM lineitem GROUP BY ALL), s AS (SELECT range % 9 AS img, range // 9 AS segment, range * 5 % 128 AS q FROM range(27)),
j AS (SELECT b.img, b.segment, coalesce(q, 60) AS q, blocks FROM b LEFT JOIN s ON b.img = s.img AND b.segment = s.segment) SELECT img, segment, q, {dc}[q + 1] AS y1_dc, {ac}[q + 1] AS y1_ac, {ac}[q + 1] AS uv_ac, blocks FROM j"""


QUERIES = {
    tables_mode_costs: MODE_COSTS_SQL, segment_steps: _segment_steps_sql(), image_limited_planes: _limited_sql(), image_tile_plan: None, image_colour_elements: None, image_alpha_choice: ALPHA_SQL, tables_quantizers: _quantizers_sql(), tables_efforts: EFFORTS_SQL, tables_candidate_modes: MODES_SQL, tables_categories: CATEGORIES_SQL, image_texture: _texture_sql(), segment_probabilities: SEGMENTS_SQL,
    skip_probabilities: SKIP_SQL, token_probabilities: TOKENS_SQL, token_costs: TOKEN_COSTS_SQL, options_resolved: OPTIONS_SQL, memory_gates: MEMORY_SQL, container_sizes: _containers_sql(), candidate_frontier: FRONTIER_SQL,
    candidate_reservoir: RESERVOIR_SQL, candidate_finalists: FINALISTS_SQL, candidate_stages: STAGES_SQL, match_top: MATCH_SQL, match_undominated: UNDOMINATED_SQL, match_extra_bits: EXTRA_SQL, image_row_matches: _row_matches_sql(),
    image_cache_costs: CACHES_SQL, image_sampled_counts: SAMPLED_SQL, image_palette_orders: PALETTES_SQL, tile_groups: TILES_SQL, tile_regrouping: REGROUP_SQL, symbol_bits: SYMBOLS_SQL, image_sharp_chroma: _sharp_sql(),
    fixture_product: PRODUCT_SQL, variant_ablation: ABLATION_SQL, plane_scalars: SCALARS_SQL, finalists_by_turn: TURNS_SQL, fixtures_missing: MISSING_SQL,
}
