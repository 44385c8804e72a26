"""The registered queries of the page operators, over the views of the test tables, each with DuckDB SQL where SQL
can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docraster.functions import geometry as G
from docraster.functions import names as N
from docraster.functions import pixels as P
from docraster.operators import fallback, presets, session
from docraster.operators import raster as R
from docraster.plans.ordering import dealt, numbered
from docraster.sources import views as V
from docraster.sources.views import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = duck(oracle)
        return f

    return register


#: DuckDB's natural key, and the supported extensions.
_KEY = r"list_transform(list_filter(regexp_extract_all(name, '(\D*)(\d*)'), lambda t: t <> ''), lambda t: {'s': lower(regexp_extract(t, '^(\D*)', 1)), 'd': coalesce(try_cast(nullif(regexp_extract(t, '(\d*)$', 1), '') AS decimal(38,0)), -1)})"
_OK = r"lower(regexp_extract(name, '[^/](\.[^./]+)$', 1)) IN ('.jpg','.jpeg','.png','.tif','.tiff','.webp','.bmp','.pdf')"
_PRESETS = "(VALUES ('Custom',1.0::double,0,0,170,false),('Document',1.25,10,4,170,false),('Whiteboard',1.35,20,5,185,false),('Photo',1.05,0,2,170,false),('B/W High Contrast',1.45,8,4,165,true)) AS s(preset,contrast,brightness,denoise,threshold,apply_threshold)"
_MODES = "(VALUES ('Document','Document','Grayscale'),('Whiteboard','Whiteboard','Grayscale'),('Photo','Photo','None'),('B/W','B/W High Contrast','Black and White')) AS m(lens_mode,preset,post)"

# --- sources --------------------------------------------------------------------------------------------------


@query(f"SELECT file_id, name, row_number() OVER (ORDER BY {_KEY}, name, file_id)::bigint AS page_seq FROM v_files WHERE {_OK}")
def scan_supported_natural(spark, d):
    f = V.files(spark, d).where(N.supported("name"))
    return numbered(f, "page_seq", N.natural_key("name"), "name", "file_id")


@query("SELECT file_id, i AS page_no, printf('%s [p%04d]', name, i) AS page_name FROM (SELECT file_id, name, unnest(range(1, n_pages+1))::int AS i FROM v_pdf)")
def pdf_page_expand(spark, d):
    p = V.pdfs(spark, d).select("file_id", "name", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page_no"))
    return p.select("file_id", "page_no", N.page_name("name", "page_no").alias("page_name"))


@query("SELECT file_id, pos, idx, CASE WHEN idx < n_pages THEN printf('%s [p%04d]', name, idx+1) END AS page_name, CASE WHEN idx >= n_pages THEN concat('PDF page index out of range: ', idx::varchar) END AS error FROM v_pdf, (VALUES (0,1),(1,0),(2,0),(3,2)) AS k(pos, idx)")
def pdf_page_select(spark, d):
    from docraster.sources.files import selected_pages

    return selected_pages(V.pdfs(spark, d), [1, 0, 0, 2]).select("file_id", "pos", "idx", "page_name", "error")


@query("SELECT file_id, CASE WHEN w_pt <= 0 OR h_pt <= 0 OR (w_pt/72*300)*(h_pt/72*300) <= 150000000 THEN 300 ELSE greatest(1, floor(300*sqrt(150000000/((w_pt/72*300)*(h_pt/72*300))))::int) END AS dpi FROM v_pdf")
def safe_render_dpi(spark, d):
    return V.pdfs(spark, d).select("file_id", G.safe_dpi(F.col("w_pt"), F.col("h_pt"), 300).alias("dpi"))


@query(f"WITH f AS (SELECT 0 AS g, file_id, 0 AS page_no, name FROM v_files WHERE {_OK} AND lower(name) NOT LIKE '%.pdf' UNION ALL SELECT 1, file_id, i, printf('%s [p%04d]', name, i) FROM (SELECT file_id, name, unnest(range(1, n_pages+1))::int AS i FROM v_pdf)) SELECT row_number() OVER (ORDER BY g, file_id, page_no)::bigint AS page_seq, name FROM f")
def mixed_load_order(spark, d):
    images = V.files(spark, d).where(N.supported("name") & (N.extension("name") != ".pdf")).select(F.lit(0).alias("g"), "file_id", F.lit(0).alias("page_no"), "name")
    pages = V.pdfs(spark, d).select(F.lit(1).alias("g"), "file_id", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page_no"), "name")
    both = images.unionByName(pages.withColumn("name", N.page_name("name", "page_no")))
    return numbered(both, "page_seq", "g", "file_id", "page_no").select("page_seq", "name")


@query("SELECT file_id, name FROM v_files WHERE name NOT IN (SELECT name FROM v_files WHERE name LIKE '%\\_1_.pdf' ESCAPE '\\')")
def reserved_output_antijoin(spark, d):
    """Files but for those that an earlier run wrote; here, some names stand for them."""
    from docraster.sources.files import without_outputs

    f = V.files(spark, d)
    return without_outputs(f, f.where(F.col("name").rlike(r"_1.\.pdf$")).select("name")).select("file_id", "name")


@query("WITH r AS (SELECT file_id % 50 AS list_id, string_agg(concat(' \"', name, '\" '), ';' ORDER BY file_id) || ';; ' AS raw FROM v_files GROUP BY 1), t AS (SELECT list_id, pos, trim(trim(trim(p), '\"')) AS path FROM (SELECT list_id, generate_subscripts(string_split_regex(raw, '[;\\n\\r]+'), 1) AS pos, unnest(string_split_regex(raw, '[;\\n\\r]+')) AS p FROM r)) SELECT list_id, path, row_number() OVER (PARTITION BY list_id ORDER BY min(pos))::bigint AS pos FROM t WHERE path <> '' GROUP BY list_id, path")
def parse_file_list(spark, d):
    """Typed lists of quoted names, each path once in its first place."""
    quoted = F.concat(F.lit(' "'), "name", F.lit('" '))
    lists = V.files(spark, d).groupBy((F.col("file_id") % 50).alias("list_id")).agg(F.array_sort(F.collect_list(F.struct("file_id", quoted.alias("q")))).alias("own"))
    raw = lists.select("list_id", F.concat(F.array_join(F.transform("own", lambda s: s["q"]), ";"), F.lit(";; ")).alias("raw"))
    out = raw.select("list_id", F.posexplode(F.array_distinct(N.file_list("raw"))).alias("pos", "path"))
    return out.select("list_id", "path", (F.col("pos") + 1).cast("long").alias("pos"))


@query(r"SELECT id, string_agg(n, ',' ORDER BY pos) AS pages FROM (SELECT id, k, n, min(pos) AS pos FROM (SELECT id, k, generate_subscripts(l,1) AS pos, unnest(l) AS n FROM (SELECT id, row_number() OVER () AS k, list_filter(string_split_regex(raw, '[\s,;]+'), lambda t: t <> '') AS l FROM v_pagetext)) GROUP BY id, k, n) GROUP BY id, k")
def parse_page_numbers(spark, d):
    pages = N.page_numbers(F.col("raw"))
    return V.page_texts(spark, d).select("id", F.array_join(F.transform(pages, lambda n: n.cast("string")), ",").alias("pages"))


# --- pixels ---------------------------------------------------------------------------------------------------


@query("SELECT page, y, x, (b*1868 + g*9617 + r*4899 + 8192) >> 14 AS p FROM v_bgr")
def grayscale(spark, d):
    return V.colours(spark, d).select("page", "y", "x", P.gray(F.col("b"), F.col("g"), F.col("r")).alias("p"))


@query(f"SELECT page, y, x, preset, least(255, round_even(abs(contrast*p + brightness - 80), 0)::int) AS p FROM v_pixels, {_PRESETS}")
def gain_bias(spark, d):
    """All presets on all pages, 80 darker, so that the absolute value shows."""
    px = V.pixels(spark, d).crossJoin(F.broadcast(presets.presets(spark)))  # five rows
    return px.select("page", "y", "x", "preset", P.gain_bias(F.col("p"), F.col("contrast"), F.col("brightness") - 80).alias("p"))


@query("SELECT page, y, x, CASE WHEN p > 127 THEN 255 ELSE 0 END AS p FROM v_pixels")
def binary_threshold(spark, d):
    return V.pixels(spark, d).select("page", "y", "x", P.threshold(F.col("p"), F.lit(127)).alias("p"))


@query(f"WITH e AS (SELECT page, y, x, preset, threshold, apply_threshold OR post = 'Black and White' AS bw, least(255, round_even(abs(contrast*p + brightness), 0)::int) AS v FROM v_pixels, v_modes JOIN {_PRESETS} USING (preset) WHERE v_modes.id = page) SELECT page, y, x, CASE WHEN bw THEN CASE WHEN v > threshold THEN 255 ELSE 0 END ELSE v END AS p FROM e")
def enhance_chain(spark, d):
    """Gain, bias and threshold by each page's own preset and post-processing."""
    px = V.pixels(spark, d).join(presets.with_settings(V.modes(spark, d)), F.col("page") == F.col("id"))
    v = P.gain_bias(F.col("p"), F.col("contrast"), F.col("brightness"))
    return px.select("page", "y", "x", F.when(F.col("apply_threshold"), P.threshold(v, F.col("threshold"))).otherwise(v).alias("p"))


@query("SELECT page, CASE WHEN x >= 4 THEN 1 ELSE 0 END AS half, y, CASE WHEN x >= 4 THEN x-4 ELSE x END AS x, p FROM v_pixels")
def split_spread(spark, d):
    return P.split_spread(V.pixels(spark, d), 8)


@query("SELECT page, 7 - x AS y, y AS x, p FROM v_pixels")
def rotate90(spark, d):
    return P.rotated(V.pixels(spark, d), 8, 8)


@query("SELECT page, round(stddev_pop(q), 6) AS std, stddev_pop(q) < 5 AS rejected FROM (SELECT page, CASE WHEN page % 2 = 0 THEN floor(p/8) ELSE p END AS q FROM v_pixels) GROUP BY page")
def low_variance(spark, d):
    """Half of the pages are made even on purpose."""
    px = V.pixels(spark, d).withColumn("p", F.when(F.col("page") % 2 == 0, F.floor(F.col("p") / 8)).otherwise(F.col("p")))
    return P.low_variance(px).select("page", F.round("std", 6).alias("std"), "rejected")


@query("WITH h AS (SELECT page, p, count(*) AS n FROM v_pixels GROUP BY page, p), c AS (SELECT page, p, sum(n) OVER (PARTITION BY page ORDER BY p) AS w0, sum(n*p) OVER (PARTITION BY page ORDER BY p) AS s0, sum(n) OVER (PARTITION BY page) AS w, sum(n*p) OVER (PARTITION BY page) AS s FROM h), v AS (SELECT page, p, CASE WHEN w0 < w THEN ((s0*w - s*w0)::double * (s0*w - s*w0)::double) / (w0::double * (w - w0)::double) ELSE 0 END AS b FROM c) SELECT page, threshold FROM (SELECT page, p AS threshold, row_number() OVER (PARTITION BY page ORDER BY b DESC, p) AS k FROM v) WHERE k = 1")
def otsu(spark, d):
    return P.otsu(V.pixels(spark, d))


@query("SELECT a.page, a.y, a.x, sum(b.p)::bigint AS total FROM v_pixels a, (VALUES (-1),(0),(1)) AS i(dy), (VALUES (-1),(0),(1)) AS j(dx), v_pixels b WHERE b.page = a.page AND b.y = least(7, greatest(0, a.y+dy)) AND b.x = least(7, greatest(0, a.x+dx)) GROUP BY a.page, a.y, a.x")
def box_blur(spark, d):
    return P.box_blur(V.pixels(spark, d), 8, 8)


# --- neighbourhoods, lines, skew and perspective as plans --------------------------------------------------------


def _side(k: str, border: str) -> str:
    return f"least(7, greatest(0, {k}))" if border == "edge" else f"(CASE WHEN (({k}) % 14 + 14) % 14 < 8 THEN (({k}) % 14 + 14) % 14 ELSE 14 - (({k}) % 14 + 14) % 14 END)"


def _correlated(name: str, source: str, taps: list[int], border: str = "reflect") -> str:
    """SQL of the two passes: each pixel joins those that its taps meet."""
    t = ", ".join(f"({i - len(taps) // 2}, {v})" for i, v in enumerate(taps))
    return (
        f"{name}_h AS MATERIALIZED (SELECT a.page, a.y, a.x, sum(b.p * t.w)::bigint AS h FROM {source} a, (VALUES {t}) AS t(k, w), {source} b WHERE b.page = a.page AND b.y = a.y AND b.x = {_side('a.x + t.k', border)} GROUP BY ALL), "
        f"{name} AS MATERIALIZED (SELECT a.page, a.y, a.x, sum(b.h * t.w)::bigint AS total FROM {name}_h a, (VALUES {t}) AS t(k, w), {name}_h b WHERE b.page = a.page AND b.x = a.x AND b.y = {_side('a.y + t.k', border)} GROUP BY ALL)"
    )


_BLUR5 = _correlated("c5", "v_pixels", R.whole_taps(5, 1.1)) + ", blur5 AS MATERIALIZED (SELECT page, y, x, round_even(total / 16777216.0::double, 0)::int AS p FROM c5)"
_SHARP = _correlated("c19", "v_pixels", R.whole_taps(19, 3.0)) + ", sharp AS MATERIALIZED (SELECT page, y, x, greatest(0, least(255, round_even((p * 50331648::bigint - total) / 33554432.0::double, 0)))::int AS p FROM v_pixels JOIN c19 USING (page, y, x))"


@query(f"WITH {_BLUR5} SELECT page, y, x, p FROM blur5")
def gaussian_blur(spark, d):
    return R.blurred(V.pixels(spark, d))


@query(f"WITH {_SHARP} SELECT page, y, x, p FROM sharp")
def sharpen_pages(spark, d):
    return R.sharpened(V.pixels(spark, d))


@query(f"WITH {_SHARP}, {_correlated('c21', 'sharp', R.whole_taps(21, 3.5), 'edge')} SELECT page, y, x, CASE WHEN p > round_even(total / 16777216.0::double, 0) - 15 THEN 255 ELSE 0 END AS p FROM sharp JOIN c21 USING (page, y, x)")
def black_and_white_pages(spark, d):
    """Sharpened, then against the Gaussian mean of each pixel's block."""
    return R.black_and_white(V.pixels(spark, d))


#: Sizes that differ from page to page.
_SMALL = "(3 + page % 5)::int AS th, (2 + page % 7)::int AS tw"


def _small(spark, d) -> DataFrame:
    e = V.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("page"), F.lit(8).alias("height"), F.lit(8).alias("width"), (F.col("vec_id") % 5 + 3).cast("int").alias("to_height"), (F.col("vec_id") % 7 + 2).cast("int").alias("to_width"))


@query(f"WITH s AS (SELECT *, {_SMALL} FROM v_pixels), t AS (SELECT page, ty, tx, p * (least((y+1)*th, (ty+1)*8) - greatest(y*th, ty*8)) * (least((x+1)*tw, (tx+1)*8) - greatest(x*tw, tx*8)) AS v FROM s, range(8) AS a(ty), range(8) AS b(tx) WHERE ty < th AND tx < tw AND least((y+1)*th, (ty+1)*8) > greatest(y*th, ty*8) AND least((x+1)*tw, (tx+1)*8) > greatest(x*tw, tx*8)) SELECT page, ty::int AS y, tx::int AS x, round_even(sum(v) / 64.0::double, 0)::int AS p FROM t GROUP BY ALL")
def area_downscale(spark, d):
    """Pages made smaller, each to a size of its own."""
    return R.downscaled(V.pixels(spark, d), _small(spark, d))


@query("WITH a AS (SELECT page, asset, n AS to_n, CASE WHEN n = 8 THEN 8 ELSE n END AS th FROM (SELECT DISTINCT page FROM v_pixels), (VALUES ('original', 8), ('current', 8), ('preview_original', 6), ('preview_current', 6), ('thumb', 3)) AS k(asset, n)), px AS (SELECT page, y, x, p, 'o' AS kind FROM v_pixels UNION ALL SELECT page, y, x, CASE WHEN p > 127 THEN 255 ELSE 0 END, 'c' FROM v_pixels), t AS (SELECT a.page, asset, th, ty, tx, p * (least((y+1)*th, (ty+1)*8) - greatest(y*th, ty*8)) * (least((x+1)*th, (tx+1)*8) - greatest(x*th, tx*8)) AS v FROM a JOIN px ON px.page = a.page AND kind = CASE WHEN asset LIKE '%original' THEN 'o' ELSE 'c' END, range(8) AS f(ty), range(8) AS g(tx) WHERE ty < th AND tx < th AND least((y+1)*th, (ty+1)*8) > greatest(y*th, ty*8) AND least((x+1)*th, (tx+1)*8) > greatest(x*th, tx*8)), m AS (SELECT page, asset, th, ty, tx, round_even(sum(v) / 64.0::double, 0)::int AS p FROM t GROUP BY ALL) SELECT page, asset, th AS height, th AS width, sum(p)::bigint AS total FROM m GROUP BY ALL")
def page_assets_shrunk(spark, d):
    """The five assets of each page with limits that really shrink it: 6 x 6 previews and a 3 x 3 thumbnail."""
    px, sizes = V.pixels(spark, d), V.table(spark, d, "embeddings").select(F.col("vec_id").alias("page"))
    current = px.withColumn("p", P.threshold(F.col("p"), F.lit(127)))
    fit = lambda most: sizes.select("page", F.lit(8).alias("height"), F.lit(8).alias("width"), G.fitted(F.lit(8), F.lit(8), most, most).alias("f")).select("page", "height", "width", F.col("f.height").alias("to_height"), F.col("f.width").alias("to_width"))
    out = None
    for asset, own, most in (("original", px, 1920), ("current", current, 1920), ("preview_original", px, 6), ("preview_current", current, 6), ("thumb", current, 3)):
        made = own if most > 8 else R.downscaled(own, fit(most))
        part = made.groupBy("page").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.sum("p").alias("total")).withColumn("asset", F.lit(asset))
        out = part if out is None else out.unionByName(part)
    return out


_TRIG = "g AS (SELECT a::int AS angle, round(cos(radians(a)) * 65536)::bigint AS c, round(sin(radians(a)) * 65536)::bigint AS s FROM range(180) AS r(a))"
_VOTES = f"{_TRIG}, votes AS MATERIALIZED (SELECT page, angle, ((x * c + y * s + 32768) >> 16)::int AS rho, count(*) AS n FROM v_pixels, g WHERE p > 150 GROUP BY ALL)"
_PEAKS = f"{_VOTES}, peaks AS MATERIALIZED (SELECT v.page, v.angle, v.rho, v.n FROM votes v LEFT JOIN votes a ON a.page = v.page AND a.angle = v.angle AND a.rho = v.rho - 1 LEFT JOIN votes b ON b.page = v.page AND b.angle = v.angle AND b.rho = v.rho + 1 LEFT JOIN votes c ON c.page = v.page AND c.rho = v.rho AND c.angle = v.angle - 1 LEFT JOIN votes e ON e.page = v.page AND e.rho = v.rho AND e.angle = v.angle + 1 WHERE v.n > coalesce(a.n, 0) AND v.n >= coalesce(b.n, 0) AND v.n > coalesce(c.n, 0) AND v.n >= coalesce(e.n, 0))"
#: A ladder for pages of 8 x 8.
_LADDER = ((5, 0.7), (4, 0.5), (2, 0.3))
_LINES = f"{_PEAKS}, st AS (SELECT page, CASE WHEN count(*) FILTER (n > 5) >= 4 THEN 0 WHEN count(*) FILTER (n > 4) >= 4 THEN 1 WHEN count(*) FILTER (n > 2) >= 4 THEN 2 END AS step FROM peaks GROUP BY page), ln AS (SELECT page, step, angle, rho, n FROM peaks JOIN st USING (page) WHERE n > CASE step WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 2 END)"


def _edges(spark, d) -> DataFrame:
    return V.pixels(spark, d).where("p > 150").select("page", "y", "x")


@query(f"WITH {_VOTES} SELECT page, angle, rho, n FROM votes")
def hough_votes(spark, d):
    return R.hough_votes(_edges(spark, d))


@query(f"WITH {_LINES} SELECT page, step, angle, rho, n FROM ln")
def hough_lines(spark, d):
    """Peaks of votes, at the first step of a ladder that leaves a page four lines."""
    sizes = _small(spark, d)
    return R.hough_lines(R.hough_peaks(R.hough_votes(_edges(spark, d))), sizes, _LADDER).select("page", "step", "angle", "rho", "n")


@query(f"""WITH {_LINES},
k AS (SELECT *, radians(angle::double) AS t, CASE WHEN angle < 30 OR angle > 150 THEN 'v' WHEN angle > 60 AND angle < 120 THEN 'h' END AS kind FROM ln),
e AS (SELECT *, CASE WHEN kind = 'v' THEN round((rho - 4 * sin(t)) / cos(t), 6) ELSE round((rho - 4 * cos(t)) / sin(t), 6) END AS pos FROM k WHERE kind IS NOT NULL),
c AS (SELECT page FROM e GROUP BY page HAVING count(*) FILTER (kind = 'v') >= 2 AND count(*) FILTER (kind = 'h') >= 2),
o AS (SELECT page, kind, row_number() OVER (PARTITION BY page, kind ORDER BY pos, -n, angle, rho) AS lo, row_number() OVER (PARTITION BY page, kind ORDER BY -pos, -n, angle, rho) AS hi, rho, t FROM e JOIN c USING (page)),
m AS (SELECT a.page, round((a.rho * sin(b.t) - b.rho * sin(a.t)) / d, 6) AS x, round((b.rho * cos(a.t) - a.rho * cos(b.t)) / d, 6) AS y, d
      FROM o a JOIN o b ON a.page = b.page AND a.kind = 'h' AND b.kind = 'v', LATERAL (SELECT cos(a.t) * sin(b.t) - sin(a.t) * cos(b.t) AS d) WHERE (a.lo = 1 OR a.hi = 1) AND (b.lo = 1 OR b.hi = 1)),
z AS (SELECT page, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(x + y) AS tl, max(x + y) AS br, min(y - x) AS tr, max(y - x) AS bl FROM m GROUP BY page HAVING count(*) = 4 AND min(abs(d)) >= 1e-6)
SELECT page, round(tl, 3) AS tl, round(br, 3) AS br, round(tr, 3) AS tr, round(bl, 3) AS bl FROM z WHERE x0 >= -0.15 * 8 AND x1 <= 1.15 * 8 AND y0 >= -0.15 * 8 AND y1 <= 1.15 * 8""")
def hough_quads(spark, d):
    """Sums and differences of the corners between outermost lines; of any area, as pages of 8 x 8 are small."""
    lines = R.hough_lines(R.hough_peaks(R.hough_votes(_edges(spark, d))), _small(spark, d), _LADDER)
    q = R.line_quads(lines, least_area=-1.0)
    at = lambda i, c: F.round(F.get("quad", F.lit(i))[c], 6)
    return q.select("page", F.round(at(0, "x") + at(0, "y"), 3).alias("tl"), F.round(at(2, "x") + at(2, "y"), 3).alias("br"), F.round(at(1, "y") - at(1, "x"), 3).alias("tr"), F.round(at(3, "y") - at(3, "x"), 3).alias("bl"))


#: Pages turned by shearing; hull sides are the pairs of points that have all others on one side.
_DARK = f"""{_BLUR5}, hist AS (SELECT page, p, count(*) AS n FROM blur5 GROUP BY page, p), cum AS (SELECT page, p, sum(n) OVER (PARTITION BY page ORDER BY p) AS w0, sum(n*p) OVER (PARTITION BY page ORDER BY p) AS s0, sum(n) OVER (PARTITION BY page) AS w, sum(n*p) OVER (PARTITION BY page) AS s FROM hist),
lv AS (SELECT page, arg_min(p, ROW(-v, p)) AS level, count(*) AS colours FROM (SELECT page, p, CASE WHEN w0 < w THEN ((s0*w - s*w0)::double * (s0*w - s*w0)::double) / (w0::double * (w - w0)::double) ELSE 0 END AS v FROM cum) GROUP BY page),
pts AS MATERIALIZED (SELECT DISTINCT page, x::bigint AS x, y::bigint AS y FROM (SELECT page, y, unnest([min(x), max(x)]) AS x FROM blur5 JOIN lv USING (page) WHERE p <= level AND colours > 1 GROUP BY page, y)),
sides AS (SELECT a.page, b.x - a.x AS dx, b.y - a.y AS dy FROM pts a JOIN pts b ON a.page = b.page AND (a.x <> b.x OR a.y <> b.y) JOIN pts c ON c.page = a.page GROUP BY a.page, a.x, a.y, b.x, b.y HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0),
box AS (SELECT s.page, dx, dy, (max(x*dy - y*dx) - min(x*dy - y*dx))::double * (max(x*dx + y*dy) - min(x*dx + y*dy))::double / (dx*dx + dy*dy)::double AS size, degrees(atan2(dy::double, dx::double)) AS deg FROM sides s JOIN pts USING (page) GROUP BY s.page, dx, dy),
turned AS (SELECT page, round(size, 6) AS size, round(deg - 90 * ceil((deg - 45) / 90), 6) AS angle FROM box),
ang AS (SELECT p.page, coalesce(t.angle, 0.0::double) AS angle FROM (SELECT DISTINCT page FROM v_pixels) p LEFT JOIN (SELECT page, arg_min(angle, ROW(size, abs(angle), angle)) AS angle FROM turned GROUP BY page) t USING (page))"""


@query(f"WITH {_DARK} SELECT page, round(angle, 3) AS angle FROM ang")
def skew_angles(spark, d):
    """How far the smallest box around each page's dark pixels is turned."""
    return R.page_angles(V.pixels(spark, d)).select("page", F.round("angle", 3).alias("angle"))


#: Components by what each pixel reaches: set pixels by all eight neighbours, the ground by four.
_PARTS = """WITH RECURSIVE m AS MATERIALIZED (SELECT page, y, x, y * 8 + x AS i, p > 140 AS s FROM v_pixels),
reach(page, s, i, j) AS (SELECT page, s, i, i FROM m UNION SELECT r.page, r.s, r.i, b.i FROM reach r JOIN m a ON a.page = r.page AND a.i = r.j JOIN m b ON b.page = a.page AND b.s = a.s AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (a.s OR abs(b.y - a.y) + abs(b.x - a.x) = 1)),
root AS (SELECT page, s, i, min(j) AS root FROM reach GROUP BY page, s, i),
part AS (SELECT page, CASE WHEN s THEN 'outer' ELSE 'hole' END AS kind, root, i // 8 AS y, i % 8 AS x, min(least(i // 8, 7 - i // 8, i % 8, 7 - i % 8)) OVER (PARTITION BY page, s, root) AS rim, s FROM root),
own AS MATERIALIZED (SELECT page, kind, root, y, x FROM part WHERE s OR rim > 0)"""


def _mask(spark, d) -> tuple[DataFrame, DataFrame]:
    return V.pixels(spark, d).where("p > 140").select("page", "y", "x"), _small(spark, d).select("page", "height", "width")


@query(f"{_PARTS} SELECT page, kind, root::bigint AS root, count(*) AS n, min(x)::int AS x0, max(x)::int AS x1, min(y)::int AS y0, max(y)::int AS y1 FROM own GROUP BY page, kind, root")
def page_outlines(spark, d):
    """What each page's outlines enclose, those around holes too."""
    about = R.outline_bounds(*_mask(spark, d))
    first = (F.shiftright("root", 32) * 8 + F.col("root").bitwiseAND(0xFFFFFFFF)).alias("root")
    return about.select("page", "kind", first, "n", "x0", "x1", "y0", "y1")


@query(f"""{_PARTS},
pts AS MATERIALIZED (SELECT DISTINCT page, kind, root, y::bigint AS y, x::bigint AS x FROM own WHERE kind = 'outer' UNION SELECT DISTINCT page, kind, root, y + dy, x + dx FROM own, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS k(dy, dx) WHERE kind = 'hole'),
sides AS (SELECT a.page, a.kind, a.root, b.x - a.x AS dx, b.y - a.y AS dy FROM pts a JOIN pts b ON a.page = b.page AND a.kind = b.kind AND a.root = b.root AND (a.x <> b.x OR a.y <> b.y) JOIN pts c ON c.page = a.page AND c.kind = a.kind AND c.root = a.root GROUP BY a.page, a.kind, a.root, a.x, a.y, b.x, b.y HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0),
box AS (SELECT page, kind, root, round((max(x*dy - y*dx) - min(x*dy - y*dx))::double * (max(x*dx + y*dy) - min(x*dx + y*dy))::double / (dx*dx + dy*dy)::double, 6) AS size, degrees(atan2(dy::double, dx::double)) AS deg FROM sides JOIN pts USING (page, kind, root) GROUP BY page, kind, root, dx, dy),
turned AS (SELECT page, kind, root, size, round(deg - 90 * ceil((deg - 45) / 90), 6) AS angle FROM box)
SELECT page, kind, root::bigint AS root, coalesce(min(size), 0) AS size, coalesce(arg_min(angle, ROW(size, abs(angle), angle)), 0) AS angle FROM (SELECT DISTINCT page, kind, root FROM pts) LEFT JOIN turned USING (page, kind, root) GROUP BY page, kind, root""")
def outline_boxes(spark, d):
    """The smallest box around each outline."""
    _, points = R.outlines(*_mask(spark, d))
    first = (F.shiftright("root", 32) * 8 + F.col("root").bitwiseAND(0xFFFFFFFF)).alias("root")
    return R.smallest_boxes(points, ("page", "kind", "root")).select("page", "kind", first, "size", "angle")


#: Corners within pages of 8 x 8, ordered and never degenerate.
_QUAD8 = "q8 AS (SELECT DISTINCT page, (page % 3)::double AS x0, (page % 2)::double AS y0, (6 + page % 2)::double AS x1, (page % 4) / 2.0::double AS y1, (5 + page % 3)::double AS x2, (6 + page % 3)::double AS y2, (page % 2)::double AS x3, (5 + page % 2)::double AS y3 FROM v_pixels)"


@query(f"""WITH {_QUAD8},
k AS (SELECT *, greatest(1, trunc(greatest(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)), sqrt((x2-x3)*(x2-x3)+(y2-y3)*(y2-y3)))))::int AS tw, greatest(1, trunc(greatest(sqrt((x3-x0)*(x3-x0)+(y3-y0)*(y3-y0)), sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))))::int AS th,
      x0-x1+x2-x3 AS sx, y0-y1+y2-y3 AS sy, x1-x2 AS dx1, x3-x2 AS dx2, y1-y2 AS dy1, y3-y2 AS dy2 FROM q8),
m AS (SELECT *, (sx*dy2 - dx2*sy) / (dx1*dy2 - dx2*dy1) AS g, (dx1*sy - sx*dy1) / (dx1*dy2 - dx2*dy1) AS h FROM k),
t AS (SELECT m.*, ty, tx, tx / greatest(1, tw - 1)::double AS u, ty / greatest(1, th - 1)::double AS v FROM m, range(20) AS a(ty), range(20) AS b(tx) WHERE ty < th AND tx < tw),
s AS (SELECT page, ty, tx, floor(((x1-x0+g*x1)*u + (x3-x0+h*x3)*v + x0) / (g*u + h*v + 1) * 32 + 0.5 + 1e-9)::bigint AS sx, floor(((y1-y0+g*y1)*u + (y3-y0+h*y3)*v + y0) / (g*u + h*v + 1) * 32 + 0.5 + 1e-9)::bigint AS sy FROM t),
f AS (SELECT page, ty, tx, floor(sy / 32.0::double)::int + i AS y, floor(sx / 32.0::double)::int + j AS x, (CASE i WHEN 0 THEN 32 - ((sy % 32) + 32) % 32 ELSE ((sy % 32) + 32) % 32 END) * (CASE j WHEN 0 THEN 32 - ((sx % 32) + 32) % 32 ELSE ((sx % 32) + 32) % 32 END) AS w FROM s, (VALUES (0), (1)) AS c(i), (VALUES (0), (1)) AS e(j))
SELECT f.page, ty::int AS y, tx::int AS x, round_even(sum(coalesce(p, 0) * w) / 1024.0::double, 0)::int AS p FROM f LEFT JOIN v_pixels b ON b.page = f.page AND b.y = f.y AND b.x = f.x GROUP BY f.page, ty, tx""")
def warp_pages(spark, d):
    """Each page inside four corners of its own, straightened."""
    k = F.col("vec_id")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    quad = F.array(pt(k % 3, k % 2), pt(k % 2 + 6, (k % 4) / 2), pt(k % 3 + 5, k % 3 + 6), pt(k % 2, k % 2 + 5))
    return R.straightened(V.pixels(spark, d), V.table(spark, d, "embeddings").select(k.alias("page"), quad.alias("quad")))


# --- geometry -------------------------------------------------------------------------------------------------

_ORDERED = "o AS (SELECT page, arg_min(x, (x+y)*10+i) AS tlx, arg_min(y, (x+y)*10+i) AS tly, arg_min(x, (y-x)*10+i) AS trx, arg_min(y, (y-x)*10+i) AS try_, arg_min(x, -(x+y)*10+i) AS brx, arg_min(y, -(x+y)*10+i) AS bry, arg_min(x, -(y-x)*10+i) AS blx, arg_min(y, -(y-x)*10+i) AS bly FROM v_quads GROUP BY page)"


@query(f"WITH {_ORDERED} SELECT page, tlx, tly, trx, try_, brx, bry, blx, bly FROM o")
def order_quad(spark, d):
    q = V.quads(spark, d).select("page", G.order_quad(F.col("pts")).alias("q"))
    names = ("tl", "tr", "br", "bl")
    cols = [F.get("q", F.lit(i))[c].alias("try_" if (n, c) == ("tr", "y") else n + c) for i, n in enumerate(names) for c in "xy"]
    return q.select("page", *cols)


@query(f"WITH {_ORDERED} SELECT page, greatest(1, trunc(greatest(sqrt(((trx-tlx)*(trx-tlx)+(try_-tly)*(try_-tly))::double), sqrt(((brx-blx)*(brx-blx)+(bry-bly)*(bry-bly))::double)))::int) AS width, greatest(1, trunc(greatest(sqrt(((blx-tlx)*(blx-tlx)+(bly-tly)*(bly-tly))::double), sqrt(((brx-trx)*(brx-trx)+(bry-try_)*(bry-try_))::double)))::int) AS height FROM o")
def warp_size(spark, d):
    return V.quads(spark, d).select("page", G.warp_size(G.order_quad(F.col("pts"))).alias("s")).select("page", "s.width", "s.height")


_SCORE = "sc AS (SELECT page, abs((x0*y1-x1*y0)+(x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y0-x0*y3))/2 AS a, greatest(x0,x1,x2,x3)-least(x0,x1,x2,x3)+1 AS w, greatest(y0,y1,y2,y3)-least(y0,y1,y2,y3)+1 AS h FROM (SELECT page, max(x) FILTER (i=0)::double AS x0, max(y) FILTER (i=0)::double AS y0, max(x) FILTER (i=1)::double AS x1, max(y) FILTER (i=1)::double AS y1, max(x) FILTER (i=2)::double AS x2, max(y) FILTER (i=2)::double AS y2, max(x) FILTER (i=3)::double AS x3, max(y) FILTER (i=3)::double AS y3 FROM v_quads GROUP BY page)), r AS (SELECT page, CASE WHEN a <= 0 THEN -1 ELSE 10*a/4000000 + a/greatest(1, w*h) END AS score FROM sc)"


@query(f"WITH {_SCORE} SELECT page, round(score, 6) AS score FROM r")
def contour_score(spark, d):
    return V.quads(spark, d).select("page", F.round(G.contour_score(F.col("pts"), 2000.0 * 2000), 6).alias("score"))


@query(f"WITH {_SCORE} SELECT floor(page/5)::bigint AS image, arg_max(page, round(score*1000000)::bigint*1000000 - page) AS page, round(max(score), 6) AS score FROM r GROUP BY 1")
def best_contour(spark, d):
    """Each image's best candidate of five; the first, if tied."""
    s = V.quads(spark, d).select(F.floor(F.col("page") / 5).alias("image"), "page", G.contour_score(F.col("pts"), 2000.0 * 2000).alias("score"))
    return fallback.best(s, "image", "score", "page").select("image", "page", F.round("score", 6).alias("score"))


@query("SELECT page, min(CASE WHEN detected THEN backend_ord END) AS backend_ord, arg_min(backend, backend_ord) FILTER (detected) AS backend, bool_or(detected) AS detected FROM v_detect GROUP BY page")
def fallback_chain(spark, d):
    return fallback.first_success(V.detections(spark, d), "page", "backend_ord", "backend")


@query("WITH l AS (SELECT page, max(CASE WHEN i=0 THEN x END)::double AS r1, max(CASE WHEN i=0 THEN y END) * pi() / 2000 AS t1, max(CASE WHEN i=1 THEN x END)::double AS r2, max(CASE WHEN i=1 THEN y END) * pi() / 2000 AS t2 FROM v_quads GROUP BY page), k AS (SELECT *, cos(t1)*sin(t2)-sin(t1)*cos(t2) AS det, degrees(t1) AS deg FROM l) SELECT page, CASE WHEN deg < 30 OR deg > 150 THEN 'vertical' WHEN deg > 60 AND deg < 120 THEN 'horizontal' END AS kind, CASE WHEN abs(det) >= 1e-6 THEN round((r1*sin(t2)-r2*sin(t1))/det, 3) END AS x, CASE WHEN abs(det) >= 1e-6 THEN round((r2*cos(t1)-r1*cos(t2))/det, 3) END AS y, CASE WHEN abs(cos(t1)) > 1e-6 THEN round((r1-100*sin(t1))/cos(t1), 3) END AS x_at_100, CASE WHEN abs(sin(t1)) > 1e-6 THEN round((r1-100*cos(t1))/sin(t1), 3) END AS y_at_100 FROM k")
def line_intersection(spark, d):
    import math

    at = lambda i, c: G.point(F.col("pts"), i)[c].cast("double")
    l = V.quads(spark, d).select("page", at(0, "x").alias("r1"), (at(0, "y") * math.pi / 2000).alias("t1"), at(1, "x").alias("r2"), (at(1, "y") * math.pi / 2000).alias("t2"))  # noqa: E741
    r1, t1, r2, t2 = (F.col(c) for c in ("r1", "t1", "r2", "t2"))
    l = l.select("page", G.line_kind(t1).alias("kind"), G.intersection(r1, t1, r2, t2).alias("m"), G.line_x_at(r1, t1, F.lit(100)).alias("xa"), G.line_y_at(r1, t1, F.lit(100)).alias("ya"))  # noqa: E741
    return l.select("page", "kind", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.round("xa", 3).alias("x_at_100"), F.round("ya", 3).alias("y_at_100"))


@query("WITH s AS (SELECT file_id, w_pt, h_pt, least(1600/w_pt, 1600/h_pt, 1.0) AS a, least(320/w_pt, 320/h_pt, 1.0) AS b FROM v_pdf WHERE h_pt > 0) SELECT file_id, greatest(1, floor(w_pt*a)::int) AS width, greatest(1, floor(h_pt*a)::int) AS height, greatest(1, floor(w_pt*b)::int) AS thumb_width, greatest(1, floor(h_pt*b)::int) AS thumb_height, round(10*w_pt/greatest(1, floor(w_pt*a)::int), 6) AS source_x FROM s")
def resize_dims(spark, d):
    w, h = F.col("w_pt"), F.col("h_pt")
    s = V.pdfs(spark, d).where("h_pt > 0").select("file_id", "w_pt", "h_pt", G.fitted(w, h, 1600, 1600).alias("a"), G.fitted(w, h, 320, 320).alias("b"))
    back = G.to_source(F.array(F.struct(F.lit(10.0).alias("x"), F.lit(10.0).alias("y"))), w, h, F.col("a.width"), F.col("a.height"))
    return s.select("file_id", "a.width", "a.height", F.col("b.width").alias("thumb_width"), F.col("b.height").alias("thumb_height"), F.round(F.get(back, F.lit(0))["x"], 6).alias("source_x"))


@query("WITH q AS (SELECT page, i, x, y FROM v_quads) SELECT page, i, greatest(0, least(999, x)) AS x, greatest(0, least(899, y)) AS y, max(CASE WHEN (x-1000)*(x-1000)+(y-1000)*(y-1000) <= 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY page) = 1 AS reachable FROM q")
def corner_clamp(spark, d):
    """Corners pushed back into a frame of 1000 x 900, and whether a handle is within reach of its middle."""
    q = V.quads(spark, d).select("page", F.posexplode(G.clamped(F.col("pts"), F.lit(1000), F.lit(900))).alias("i", "p"), G.nearest_handle(F.col("pts"), F.lit(1000), F.lit(1000), 100.0).isNotNull().alias("reachable"))
    return q.select("page", "i", "p.x", "p.y", "reachable")


# --- lookups --------------------------------------------------------------------------------------------------


@query(f"WITH q AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Document' WHEN 1 THEN 'Whiteboard' WHEN 2 THEN 'Photo' WHEN 3 THEN 'B/W' ELSE 'Custom' END AS lens_mode FROM v_modes) SELECT q.id, q.lens_mode, m.preset, m.post FROM q LEFT JOIN {_MODES} USING (lens_mode)")
def lens_mode_resolve(spark, d):
    k = F.col("id") % 5
    mode = F.when(k == 0, "Document").when(k == 1, "Whiteboard").when(k == 2, "Photo").when(k == 3, "B/W").otherwise("Custom")
    return presets.resolve_lens_mode(V.modes(spark, d).select("id", mode.alias("lens_mode"))).select("id", "lens_mode", "preset", "post")


@query(f"SELECT v.id, v.preset, v.post, coalesce(m.lens_mode, 'Custom') AS lens_mode, CASE WHEN v.preset = 'B/W High Contrast' THEN 'Black and White' WHEN v.preset IN ('Document','Whiteboard') AND v.post = 'None' THEN 'Grayscale' WHEN v.preset = 'Photo' AND v.post = 'Black and White' THEN 'None' ELSE v.post END AS coupled FROM v_modes v LEFT JOIN {_MODES} ON m.preset = v.preset AND m.post = v.post")
def lens_mode_infer(spark, d):
    out = presets.infer_lens_mode(V.modes(spark, d))
    return out.select("id", "preset", "post", "lens_mode", presets.coupled_post(F.col("preset"), F.col("post")).alias("coupled"))


@query(f"SELECT v.id, s.contrast, s.brightness, s.denoise, s.threshold, s.apply_threshold OR v.post = 'Black and White' AS apply_threshold FROM v_modes v JOIN {_PRESETS} USING (preset)")
def preset_settings(spark, d):
    return presets.with_settings(V.modes(spark, d)).select("id", "contrast", "brightness", "denoise", "threshold", "apply_threshold")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'Error' WHEN event_type = 'click' THEN 'Previewing' WHEN event_type = 'view' THEN 'Open' ELSE 'Closed' END AS label FROM events")
def camera_health(spark, d):
    from docraster.streaming.camera import health

    e = V.table(spark, d, "events")
    kind = F.col("event_type")
    said = health(kind.isin("view", "click"), kind == "click", F.when(kind == "error", "gone"))
    return e.select("event_id", said["label"].alias("label"))


@query("SELECT cam, event_id, (frame_no // 5)::bigint AS shot FROM v_frames WHERE frame_no % 5 = 4 AND frame_no < 15")
def burst_frames(spark, d):
    from docraster.streaming.camera import burst

    return burst(V.frames(spark, d), shots=3, warmup_reads=4).select("cam", "event_id", "shot")


@query("""WITH RECURSIVE f AS (SELECT user_id AS cam, event_id, event_type <> 'error' AS ok, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b(cam, shot, n, us, ok) AS (
  SELECT cam, 1, n, us, ok FROM f WHERE n = 2
  UNION ALL
  SELECT g.cam, g.shot, f.n, f.us, f.ok FROM (SELECT b.cam, b.shot + 1 AS shot, min(f.n) + 1 AS n FROM b JOIN f ON f.cam = b.cam AND f.n > b.n AND f.us >= b.us + 86400000000 WHERE b.ok AND b.shot < 4 GROUP BY b.cam, b.shot) AS g JOIN f ON f.cam = g.cam AND f.n = g.n)
SELECT b.cam, event_id AS frame_no, shot, CASE WHEN NOT b.ok THEN printf('Failed to capture frame %d/4.', shot) END AS error FROM b JOIN f USING (cam, n)""")
def burst_by_time(spark, d):
    """Four shots a day apart, one frame discarded before each; a failed read ends a burst."""
    from docraster.streaming import camera

    e = V.table(spark, d, "events")
    return camera.burst_by_time(e.select(F.col("user_id").alias("cam"), F.col("event_id").alias("frame_no"), "ts", (F.col("event_type") != "error").alias("ok")), 4, 86_400, 1)


@query("SELECT event_id, concat('cam_', strftime(ts, '%Y%m%d_%H%M%S_'), printf('%06d', microsecond(ts)%1000000)) AS name, concat('retake_', strftime(ts, '%Y%m%d_%H%M%S')) AS retake, concat(strftime(ts, '%Y%m%d_%H%M%S'), '_', lpad((1 + event_id % 3)::varchar, 3, '0')) AS burst FROM events")
def capture_names(spark, d):
    from docraster.streaming.camera import capture_name

    e = V.table(spark, d, "events")
    return e.select("event_id", F.concat(F.lit("cam_"), capture_name("ts", micros=True)).alias("name"), F.concat(F.lit("retake_"), capture_name("ts")).alias("retake"), F.concat(capture_name("ts"), F.lit("_"), F.lpad((1 + F.col("event_id") % 3).cast("string"), 3, "0")).alias("burst"))


@query("SELECT event_id, greatest(0, least(100, trunc(value)::int)) AS percent, concat_ws(' | ', event_type, CASE WHEN event_id % 2 = 0 THEN concat(greatest(0, least(100, trunc(value)::int))::varchar, '%') END) AS status FROM events")
def percent_status(spark, d):
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.col("value").cast("int")))
    e = V.table(spark, d, "events")
    return e.select("event_id", percent.alias("percent"), F.concat_ws(" | ", "event_type", F.when(F.col("event_id") % 2 == 0, F.concat(percent.cast("string"), F.lit("%")))).alias("status"))


# --- aggregates -----------------------------------------------------------------------------------------------


@query("SELECT backend_ord, backend, CASE WHEN count(*) > 0 THEN concat('scans_', backend, '.pdf') END AS output_pdf, count(*) AS total_pages, count(*) FILTER (detected) AS detected_pages, NULL::varchar AS error, concat(backend, ': scans_', backend, '.pdf (detected ', count(*) FILTER (detected), '/', count(*), ')') AS summary FROM v_detect GROUP BY backend_ord, backend")
def benchmark_summary(spark, d):
    from docraster.plans.benchmark import report, summary_line

    return report(V.detections(spark, d), "scans").withColumn("summary", summary_line())


@query("SELECT bool_or(n > 0) AS ok, CASE WHEN bool_or(n > 0) THEN 0 ELSE 1 END AS exit_code FROM (SELECT backend, count(*) AS n FROM v_detect GROUP BY backend)")
def exit_status(spark, d):
    from docraster.plans.benchmark import report

    ok = report(V.detections(spark, d), "scans").agg(F.bool_or(F.col("output_pdf").isNotNull()).alias("ok"))
    return ok.select("ok", F.when(F.col("ok"), 0).otherwise(1).alias("exit_code"))


@query(f"WITH {_DARK} SELECT page % 10 AS session_id, round(avg(angle), 3) AS mean_angle, printf('%.1f', round(avg(angle), 3)) AS shown FROM ang GROUP BY 1")
def mean_deskew(spark, d):
    """The mean of the pages' skew angles."""
    a = R.page_angles(V.pixels(spark, d)).groupBy((F.col("page") % 10).alias("session_id")).agg(F.round(F.avg("angle"), 3).alias("mean_angle"))
    return a.withColumn("shown", F.format_string("%.1f", "mean_angle"))


@query("SELECT count(DISTINCT file_id) AS files, sum(n_pages)::bigint AS pages FROM v_pdf")
def import_stats(spark, d):
    return V.pdfs(spark, d).agg(F.countDistinct("file_id").alias("files"), F.sum("n_pages").alias("pages"))


# --- exports and sessions -------------------------------------------------------------------------------------


@query(f"SELECT file_id, printf('page_%05d.png', row_number() OVER (ORDER BY {_KEY}, name, file_id)) AS out_name FROM v_files WHERE {_OK}")
def export_names(spark, d):
    f = numbered(V.files(spark, d).where(N.supported("name")), "pos", N.natural_key("name"), "name", "file_id")
    return f.select("file_id", N.export_name("pos").alias("out_name"))


@query(f"SELECT file_id, lower(regexp_extract(name, '[^/](\\.[^./]+)$', 1)) <> '.jpg' AS reencode FROM v_files WHERE {_OK}")
def export_reencode_flag(spark, d):
    from docraster.sources.sinks import needs_encoding

    return V.files(spark, d).where(N.supported("name")).select("file_id", needs_encoding(F.col("name"), "jpg").alias("reencode"))


@query("SELECT session_id, op_seq, arg FROM v_oplog WHERE op = 'select' AND arg % 2 = 0")
def export_scope(spark, d):
    log = V.operations(spark, d).where("op = 'select'").withColumn("selected", F.col("arg") % 2 == 0)
    return session.in_scope(log, True).select("session_id", "op_seq", "arg")


@query("WITH s AS (SELECT session_id, op_seq, row_number() OVER (PARTITION BY session_id ORDER BY op_seq) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM v_oplog) SELECT session_id, op_seq, (CASE WHEN n > 3 AND pos = 1 THEN 3 WHEN n > 3 AND pos = 3 THEN 1 ELSE pos END)::bigint AS pos FROM s")
def session_swap(spark, d):
    """Each session's second page changes places with the page two further on."""
    pos = (F.row_number().over(W.partitionBy("session_id").orderBy("op_seq")) - 1).cast("long")
    pages = V.operations(spark, d).select("session_id", "op_seq", pos.alias("pos"))
    second = pages.withColumn("entry_id", F.when(F.col("pos") == 1, "second").otherwise(F.concat(F.lit("page"), "pos")))
    return session.move(second, "second", 2).select("session_id", "op_seq", "pos")


@query("SELECT session_id, op_seq, (row_number() OVER (PARTITION BY session_id ORDER BY op_seq) - 1)::bigint AS pos FROM v_oplog WHERE arg % 3 <> 0")
def session_remove_selected(spark, d):
    log = V.operations(spark, d).select("session_id", "op_seq", F.col("op_seq").alias("pos"), (F.col("arg") % 3 == 0).alias("selected"))
    return session.remove_selected(log).select("session_id", "op_seq", "pos")


@query("SELECT session_id, op_seq, CASE WHEN op = 'replace' THEN concat('new ', op_seq::varchar) ELSE op END AS name, CASE WHEN op = 'replace' THEN arg ELSE arg + 1 END AS current FROM v_oplog")
def session_replace(spark, d):
    """Pages whose operation is a replacement get a new image and name; the others keep theirs."""
    log = V.operations(spark, d)
    pages = log.select("session_id", "op_seq", F.col("op_seq").cast("string").alias("entry_id"), F.col("op").alias("name"), F.col("arg").alias("original"), (F.col("arg") + 1).alias("current"))
    new = log.where("op = 'replace'").select(F.col("op_seq").cast("string").alias("entry_id"), F.col("arg").alias("original"), F.concat(F.lit(" new "), F.col("op_seq").cast("string"), F.lit(" ")).alias("name"))
    return session.replace(pages, new).select("session_id", "op_seq", "name", "current")


#: One operation of each session at a time; modulo as of never negative numbers.
_FOLD = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY op_seq) AS k FROM v_oplog),
f(session_id, k, pages) AS (
  SELECT DISTINCT session_id, 0::bigint, CAST([] AS STRUCT(e VARCHAR, n VARCHAR, s BOOLEAN)[]) FROM o
  UNION ALL
  SELECT f.session_id, o.k, CASE
    WHEN op = 'add' THEN list_append(pages, {'e': concat(f.session_id, '-', op_seq), 'n': concat('page ', op_seq), 's': false})
    WHEN len(pages) = 0 THEN pages
    WHEN op = 'select' THEN list_transform(pages, lambda r, i: CASE WHEN i - 1 = (arg % len(pages) + len(pages)) % len(pages) THEN {'e': r.e, 'n': r.n, 's': NOT r.s} ELSE r END)
    WHEN op = 'replace' THEN list_transform(pages, lambda r, i: CASE WHEN i - 1 = (arg % len(pages) + len(pages)) % len(pages) THEN {'e': r.e, 'n': concat('page ', op_seq), 's': r.s} ELSE r END)
    WHEN op = 'remove_selected' THEN list_filter(pages, lambda r: NOT r.s)
    WHEN op_seq % len(pages) + (arg % 5 + 5) % 5 - 2 BETWEEN 0 AND len(pages) - 1 THEN list_transform(pages, lambda r, i: CASE
      WHEN i - 1 = op_seq % len(pages) THEN pages[(op_seq % len(pages) + (arg % 5 + 5) % 5 - 1)::bigint]
      WHEN i + 1 = op_seq % len(pages) + (arg % 5 + 5) % 5 THEN pages[(op_seq % len(pages) + 1)::bigint] ELSE r END)
    ELSE pages END
  FROM f JOIN o ON o.session_id = f.session_id AND o.k = f.k + 1),
last AS (SELECT session_id, arg_max(pages, k) AS pages FROM f GROUP BY session_id)
SELECT session_id, p.e AS entry_id, pos::bigint AS pos, p.n AS name, p.s AS selected FROM (SELECT session_id, unnest(pages) AS p, unnest(range(len(pages))) AS pos FROM last)"""


@query(_FOLD)
def session_fold(spark, d):
    """What the whole operation log leaves of each session."""
    return session.folded(V.operations(spark, d))


@query("SELECT session_id, op_seq, CASE WHEN arg % 2 = 0 THEN 2 * arg ELSE arg + 1 END AS current, CASE WHEN arg % 2 = 0 THEN 'before ' ELSE 'kept ' END || arg AS said FROM v_oplog")
def session_review(spark, d):
    """The selected pages' current images are made anew from their originals."""
    pages = V.operations(spark, d).select("session_id", "op_seq", F.col("arg").alias("original"), (F.col("arg") + 1).alias("current"), (F.col("arg") % 2 == 0).alias("selected"))
    out = session.before_and_after(session.reviewed(pages, F.col("original") * 2), F.col("original") * 2)
    return out.select("session_id", "op_seq", "current", F.concat(F.when(F.col("selected"), "before ").otherwise("kept "), "before").alias("said"))


@query("SELECT session_id, count(*) FILTER (arg % 3 = 0) AS removed FROM v_oplog WHERE session_id % 4 <> 0 GROUP BY session_id")
def session_clear(spark, d):
    """Some sessions are cleared; of the others, how many pages removing the selected ones takes."""
    log = V.operations(spark, d)
    left = session.cleared(log, log.where("session_id % 4 = 0").select("session_id"))
    return session.removed_counts(left.withColumn("selected", F.col("arg") % 3 == 0))


@query("SELECT p_partkey AS id, width, height FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 100 + p_size END AS width, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS height FROM part)")
def camera_resolution(spark, d):
    """Resolutions as text, some of them no resolution."""
    from docraster.streaming.camera import resolution

    p = V.table(spark, d, "part")
    text = F.concat(F.lit(" "), (F.col("p_size") + 100).cast("string"), F.when(F.col("p_partkey") % 5 == 0, " x ").otherwise("x"), F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), resolution(text).alias("r")).select("id", F.col("r.width").alias("width"), F.col("r.height").alias("height"))


@query(f"SELECT id, CASE WHEN m.preset IS NULL THEN v.preset ELSE m.preset END AS preset, CASE WHEN m.preset IS NULL THEN v.post ELSE m.post END AS post FROM (SELECT *, CASE id % 6 WHEN 0 THEN 'Custom' WHEN 1 THEN 'B/W' WHEN 2 THEN 'Photo' WHEN 3 THEN 'Document' WHEN 4 THEN 'Whiteboard' ELSE 'none such' END AS lens FROM v_modes) AS v LEFT JOIN {_MODES} ON lens = m.lens_mode")
def lens_mode_change(spark, d):
    k = F.col("id") % 6
    lens = F.when(k == 0, "Custom").when(k == 1, "B/W").when(k == 2, "Photo").when(k == 3, "Document").when(k == 4, "Whiteboard").otherwise("none such")
    return presets.on_lens_mode_change(V.modes(spark, d).withColumn("lens_mode", lens)).select("id", "preset", "post")


@query("SELECT p_partkey AS id, greatest(0.7, least(2.0, p_size / 20.0::double)) AS contrast, greatest(-80, least(80, 5 * p_size - 150)) AS brightness, greatest(0, least(20, p_size - 5)) AS denoise, greatest(80, least(240, 6 * p_size)) AS threshold FROM part")
def settings_in_range(spark, d):
    p, n = V.table(spark, d, "part"), F.col("p_size")
    asked = {"contrast": n / 20.0, "brightness": 5 * n - 150, "denoise": n - 5, "threshold": 6 * n}
    return p.select(F.col("p_partkey").alias("id"), *(presets.in_range(k, v).alias(k) for k, v in asked.items()))


# --- files that are really written and read again ------------------------------------------------------------------


def _totals(rows: DataFrame, image: str = "image") -> DataFrame:
    """height, width and the sum of the pixels of gray images, from their bytes as hexadecimal digits."""
    digits = F.hex(f"{image}.data")
    values = F.transform(F.sequence(F.lit(1), F.col(f"{image}.height") * F.col(f"{image}.width")), lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.withColumns({"height": F.col(f"{image}.height"), "width": F.col(f"{image}.width"), "total": F.when(F.col(image).isNotNull(), total)})


@query(f"SELECT printf('sheet_%05d.png', row_number() OVER (ORDER BY {_KEY}, name) + 6) AS file, 3 AS height, 4 AS width, total FROM v_sheets")
def exported_files(spark, d):
    """Sheets through the sink of numbered files, and what the files hold when they are read again."""
    from docraster.plans.ordering import removed, settled, shared_folder
    from docraster.sources import files, sinks

    folder = shared_folder(spark, "sheets")
    pages = numbered(V.sheets(spark, d), "page_seq", N.natural_key("name"), "name")
    sinks.export_files(pages.select("page_seq", "image"), folder, "png", "sheet", 7)
    out = settled(_totals(files.images(spark, folder, ["png"])).select(F.col("name").alias("file"), "height", "width", "total"))
    removed(spark, folder)
    return out


@query("WITH s AS (SELECT total, row_number() OVER (ORDER BY page) AS n, count(*) OVER () AS pages FROM v_sheets), k AS (SELECT unnest([2, 0, 0, 1000000000, -1, 7]) AS idx, unnest(range(6)) AS pos) SELECT pos::int AS pos, idx, CASE WHEN total IS NOT NULL THEN printf('sheets.pdf [p%04d]', idx + 1) END AS page_name, total, CASE WHEN total IS NULL THEN concat('PDF page index out of range: ', idx) END AS error FROM k LEFT JOIN s ON n = idx + 1")
def selected_pages_read(spark, d):
    """A document of all sheets, of which the reader inflates the chosen pages alone."""
    from docraster.plans.ordering import removed, settled, shared_folder
    from docraster.sources import documents, sinks

    folder = shared_folder(spark, "document")
    sinks.export_pdf(numbered(V.sheets(spark, d), "page_seq", "page"), f"{folder}/sheets.pdf", 72)
    chosen = documents.read_selected(spark, folder, [2, 0, 0, 1_000_000_000, -1, 7])
    out = settled(_totals(chosen).select("pos", "idx", "page_name", "total", "error"))
    removed(spark, folder)
    return out


@query("SELECT file_id, printf('%04d  %s', row_number() OVER (ORDER BY file_id), name) AS label, printf('%05d.tif', row_number() OVER (ORDER BY file_id)) AS file FROM v_files")
def list_labels(spark, d):
    """Lines of a list of pages, and names without a base."""
    f = numbered(V.files(spark, d), "pos", "file_id")
    return f.select("file_id", N.list_label("pos", "name").alias("label"), N.export_name("pos", "", "tif").alias("file"))


# --- rasters (rows only: their pixels are tested on synthetic pages) --------------------------------------------


def small_pages(spark: SparkSession, d: str) -> DataFrame:
    """page_seq, name, image: the 8 x 8 gray pages as images, drawn by column expressions; what is no number is black."""

    def level(v):
        v = v.cast("double")
        p = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v + 1) * 127.5)))
        return F.lpad(F.hex(F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(p)), 2, "0")

    data, k = F.unhex(F.array_join(F.transform("embedding", level), "")), F.col("vec_id")
    return V.table(spark, d, "embeddings").select(k.alias("page_seq"), F.concat(k.cast("string"), F.lit(".png")).alias("name"), P.image(8, 8, 1, data).alias("image"))


@query()
def process_spreads(spark, d):
    """Sharpened, made black and white, enhanced, and split in two, in one pass."""
    from docraster.plans.pipeline import Options, Settings, processed

    out = processed(small_pages(spark, d), Options(detect_document=False, two_page_mode=True, postprocess="Black and White", settings=Settings(1.25, 10)))
    return out.select("page_seq", "image.height", "image.width", F.crc32("image.data").alias("pixels_crc32"))


@query("SELECT row_number() OVER (ORDER BY vec_id, half)::bigint AS page_seq, 8::int AS height, 4::int AS width, 1::int AS channels, false AS detected FROM embeddings, (VALUES (0), (1)) AS k(half)")
def process_spread_sizes(spark, d):
    """The plain columns of the same run."""
    from docraster.plans.pipeline import Options, Settings, processed

    out = processed(small_pages(spark, d), Options(detect_document=False, two_page_mode=True, postprocess="Black and White", settings=Settings(1.25, 10)))
    return out.select("page_seq", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "detected")


@query()
def deskew_pages(spark, d):
    from docraster.plans.pipeline import deskewed

    return deskewed(small_pages(spark, d)).select("page_seq", F.round("angle", 3).alias("angle"), F.crc32("image.data").alias("pixels_crc32"))


def drawn_pages(spark: SparkSession, d: str) -> DataFrame:
    """page_seq, name, image: a bright box on a dark page of 180 x 240 for each row of embeddings, drawn by column
    expressions after the rows are dealt out: their table is small, and what is made of them is not."""
    k = F.col("vec_id")
    at = lambda first, n: (first + F.pmod(k, F.lit(n))).cast("int")
    y0, y1, x0, x1 = at(20, 7), at(150, 11), at(30, 13), at(200, 17)
    dark, bright = (lambda n: F.repeat(F.lit("1E1E1E"), n)), (lambda n: F.repeat(F.lit("EBEBEB"), n))
    data = F.concat(dark(y0 * 240), F.repeat(F.concat(dark(x0), bright(x1 - x0), dark(240 - x1)), y1 - y0), dark((180 - y1) * 240))
    return dealt(V.table(spark, d, "embeddings").select("vec_id")).select(k.alias("page_seq"), F.concat(k.cast("string"), F.lit(".png")).alias("name"), P.image(180, 240, 3, F.unhex(data)).alias("image"))


@query()
def detect_pages(spark, d):
    """A drawn page per row of embeddings, through a chain whose first backend has no model."""
    from docraster.operators.detect import scanned

    out = scanned(drawn_pages(spark, d), ("paddleocr_uvdoc", "opencv_hough", "opencv_minrect"), with_image=False)
    return out.select("page_seq", "name", "scan.backend", "scan.detected", F.col("scan.warped.width").alias("width"), F.col("scan.warped.height").alias("height"), F.array_join("scan.errors", "; ").alias("errors"))


@query("SELECT concat(vec_id::varchar, '.png') AS entry_id, asset, 8::int AS height, 8::int AS width FROM embeddings, (VALUES ('original'), ('current'), ('preview_original'), ('preview_current'), ('thumb')) AS k(asset)")
def page_assets(spark, d):
    from docraster.sources.sinks import assets

    out = assets(small_pages(spark, d).select(F.col("name").alias("entry_id"), "image"))
    return out.select("entry_id", "asset", "image.height", "image.width")


@query("SELECT concat(vec_id::varchar, '.png') AS entry_id, asset, CASE WHEN vec_id % 4 = 1 AND asset IN ('current', 'preview_current', 'thumb') THEN 4 ELSE 8 END::int AS height FROM embeddings, (VALUES ('original'), ('current'), ('preview_original'), ('preview_current'), ('thumb')) AS k(asset) WHERE vec_id % 4 <> 0")
def asset_lifecycle(spark, d):
    """A store after some entries were removed and others got a new current image."""
    from docraster.plans.pipeline import transformed
    from docraster.sources.sinks import assets, renewed, without_assets

    pages, k = small_pages(spark, d), F.col("page_seq") % 4
    entries = pages.select(F.col("name").alias("entry_id"), "image")
    changed = transformed(pages.where(k == 1), lambda img: img[:4]).select(F.col("name").alias("entry_id"), "image")
    store = without_assets(assets(entries), pages.where(k == 0).select(F.col("name").alias("entry_id")))
    return renewed(store, changed, "current").select("entry_id", "asset", "image.height")
