"""Page-like views of the plain test tables, which hold no images: as Spark DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, y, x, p: 8 x 8 gray pages."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("pos", "v"))
    p = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v").cast("double") + 1) * 127.5))).cast("int")
    return e.select("page", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), p.alias("p"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pts: four points each."""
    e = F.col("embedding")
    c = lambda i: F.floor((F.get(e, F.lit(i)).cast("double") + 1) * 1000).cast("int")
    pts = F.array(*(F.struct(c(2 * i).alias("x"), c(2 * i + 1).alias("y")) for i in range(4)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), pts.alias("pts"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, name."""
    ends = {0: ".jpg", 1: ".jpeg", 2: ".PNG", 3: ".tif", 4: ".tiff", 5: ".webp", 6: ".bmp", 7: ".pdf", 8: ".txt"}
    end = F.lit("")
    for k, v in ends.items():
        end = F.when(F.col("p_partkey") % 10 == k, v).otherwise(end)
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), end)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), name.alias("name"))


def pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, name, n_pages, w_pt, h_pt."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("file_id"),
        F.concat(F.lit("doc_"), k.cast("string"), F.lit(".pdf")).alias("name"),
        (1 + F.floor(F.col("n_chars") / 3000)).cast("int").alias("n_pages"),
        F.when(k % 7 == 0, 7200.0).otherwise(595.0).alias("w_pt"),
        F.when(k % 7 == 0, 14400.0).when(k % 11 == 0, 0.0).otherwise(842.0).alias("h_pt"),
    )


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, y, x, b, g, r: 4 x 4 pages, from one row per page without a shuffle."""
    e = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + 1) * 127.5))).cast("int"))
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), e.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("px"))
    c = lambda i: F.get("p", F.col("px") * 3 + i)
    return px.select("page", F.floor(F.col("px") / 4).cast("int").alias("y"), (F.col("px") % 4).alias("x"), c(0).alias("b"), c(1).alias("g"), c(2).alias("r"))


BACKENDS = ((0, "opencv_quad"), (1, "opencv_hough"), (2, "opencv_minrect"), (3, "cv_hybrid"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, backend_ord, backend, detected: what four detectors are taken to find."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quad, hough, rect = F.coalesce("quality", F.lit(0)) == 1, F.col("doc_id") % 3 == 0, F.col("n_chars") > 2000
    flags = (quad, hough, rect, quad | hough | rect)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(b).alias("name"), f.alias("hit")) for (k, b), f in zip(BACKENDS, flags))))
    return d.select(F.col("doc_id").alias("page"), each.alias("s")).select("page", F.col("s.ord").alias("backend_ord"), F.col("s.name").alias("backend"), F.col("s.hit").alias("detected"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, op_seq, op, arg: an operation log."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "add").when(kind == "view", "select").when(kind == "click", "move").when(kind == "error", "remove_selected").otherwise("replace")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("op_seq"), op.alias("op"), F.floor("value").cast("int").alias("arg"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, raw."""
    n = F.col("l_linenumber").cast("string")
    raw = F.concat(F.lit(" "), n, F.lit(", "), F.col("l_quantity").cast("int").cast("string"), F.lit(";"), n, F.lit(" "))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), raw.alias("raw"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cam, frame_no, event_id."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cam"), n.cast("long").alias("frame_no"), "event_id")


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, preset, post."""
    k = F.col("c_custkey")
    preset = F.when(k % 5 == 0, "Custom").when(k % 5 == 1, "Document").when(k % 5 == 2, "Whiteboard").when(k % 5 == 3, "Photo").otherwise("B/W High Contrast")
    post = F.when(k % 4 == 0, "None").when(k % 4 == 1, "Sharpen").when(k % 4 == 2, "Grayscale").otherwise("Black and White")
    return table(spark, sf_dir, "customer").select(k.alias("id"), preset.alias("preset"), post.alias("post"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, name and image: a gray sheet of 3 x 4 pixels for each supplier, drawn by column expressions."""
    p = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.lpad(F.hex(F.pmod(F.col("s_suppkey") * 7 + i * 5, F.lit(256))), 2, "0"))
    image = F.struct(F.lit("").alias("origin"), F.lit(3).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.unhex(F.array_join(p, "")).alias("data"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("page"), F.col("s_name").alias("name"), image.alias("image"))


#: The same views for DuckDB, as common table expressions.
DUCK = {
    "v_pixels": "SELECT vec_id AS page, cast(floor(pos/8) AS int) AS y, cast(pos % 8 AS int) AS x, cast(floor(greatest(0.0::double,least(255.0::double,(v::double+1)*127.5))) AS int) AS p FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS pos, unnest(embedding) AS v FROM embeddings)",
    "v_quads": "SELECT vec_id AS page, i, cast(floor((embedding[2*i+1]::double+1)*1000) AS int) AS x, cast(floor((embedding[2*i+2]::double+1)*1000) AS int) AS y FROM embeddings, (VALUES (0),(1),(2),(3)) AS k(i)",
    "v_files": "SELECT p_partkey AS file_id, concat(replace(p_name,' ','_'),'_',p_size::varchar, CASE p_partkey % 10 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.PNG' WHEN 3 THEN '.tif' WHEN 4 THEN '.tiff' WHEN 5 THEN '.webp' WHEN 6 THEN '.bmp' WHEN 7 THEN '.pdf' WHEN 8 THEN '.txt' ELSE '' END) AS name FROM part",
    "v_pdf": "SELECT doc_id AS file_id, concat('doc_',doc_id::varchar,'.pdf') AS name, cast(1 + floor(n_chars/3000) AS int) AS n_pages, (CASE WHEN doc_id % 7 = 0 THEN 7200 ELSE 595 END)::double AS w_pt, (CASE WHEN doc_id % 7 = 0 THEN 14400 WHEN doc_id % 11 = 0 THEN 0 ELSE 842 END)::double AS h_pt FROM documents",
    "v_bgr": "SELECT page, cast(floor(px/4) AS int) AS y, cast(px % 4 AS int) AS x, max(CASE WHEN c=0 THEN p END) AS b, max(CASE WHEN c=1 THEN p END) AS g, max(CASE WHEN c=2 THEN p END) AS r FROM (SELECT page, cast(floor((y*8+x)/3) AS int) AS px, (y*8+x) % 3 AS c, p FROM v_pixels WHERE y*8+x < 48) GROUP BY page, px",
    "v_detect": "SELECT d.doc_id AS page, b.ord AS backend_ord, b.name AS backend, CASE b.ord WHEN 0 THEN coalesce(l.quality,0)=1 WHEN 1 THEN d.doc_id % 3 = 0 WHEN 2 THEN d.n_chars > 2000 ELSE coalesce(l.quality,0)=1 OR d.doc_id % 3 = 0 OR d.n_chars > 2000 END AS detected FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (VALUES (0,'opencv_quad'),(1,'opencv_hough'),(2,'opencv_minrect'),(3,'cv_hybrid')) AS b(ord,name)",
    "v_oplog": "SELECT user_id AS session_id, event_id AS op_seq, CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'select' WHEN 'click' THEN 'move' WHEN 'error' THEN 'remove_selected' ELSE 'replace' END AS op, cast(floor(value) AS int) AS arg FROM events",
    "v_pagetext": "SELECT l_orderkey AS id, concat(' ',l_linenumber::varchar,', ',cast(trunc(l_quantity) AS int)::varchar,';',l_linenumber::varchar,' ') AS raw FROM lineitem",
    "v_frames": "SELECT user_id AS cam, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, event_id FROM events",
    "v_sheets": "SELECT s_suppkey::bigint AS page, s_name AS name, list_sum(list_transform(range(12), lambda i: (s_suppkey * 7 + i * 5) % 256))::bigint AS total FROM supplier",
    "v_modes": "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Custom' WHEN 1 THEN 'Document' WHEN 2 THEN 'Whiteboard' WHEN 3 THEN 'Photo' ELSE 'B/W High Contrast' END AS preset, CASE c_custkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Sharpen' WHEN 2 THEN 'Grayscale' ELSE 'Black and White' END AS post FROM customer",
}


def duck(query: str) -> str:
    """DuckDB text of a query, preceded by the views that it names."""
    used = [v for v in DUCK if v in query]
    if "v_bgr" in used and "v_pixels" not in used:
        used.insert(0, "v_pixels")
    head = ", ".join(f"{v} AS ({DUCK[v]})" for v in used)
    body = query.strip()
    if not used:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {head}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"WITH {head} {body}"
