"""JOIN, and the sources' lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..registry import query, table
from . import inputs

_CAT = f"({inputs.CATALOGUE_SQL})"


@query("join01_skip", f"SELECT d.doc_id, c.path FROM documents d JOIN {_CAT} c ON d.doc_id = c.doc_id")
def join01(spark, sf_dir):
    return J.lookup(table(spark, sf_dir, "documents").select("doc_id"), inputs.catalogue(spark, sf_dir).select("doc_id", "path"), ["doc_id"])


@query("join02_abort", "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey")
def join02(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return J.lookup(rows, orders, ["l_orderkey"], "abort")


@query("join03_questions_answers", "SELECT q.conv_id, q.turn AS question_turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def join03(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    q = t.where("role = 'user'").select("conv_id", F.col("turn").alias("question_turn"), F.col("text").alias("question"), (F.col("turn") + 1).alias("turn"))
    a = t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return J.lookup(q, a, ["conv_id", "turn"]).drop("turn")


@query("join04_nested_annotation", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS start_sec, b.l_quantity + 5 AS end_sec FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join04(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    database = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.array(F.col("l_quantity"), F.col("l_quantity") + 5).alias("segment"))).alias("annotations"))
    flat = database.select("l_orderkey", F.inline("annotations")).select("l_orderkey", F.col("id").alias("l_linenumber"), F.col("segment")[0].alias("start_sec"), F.col("segment")[1].alias("end_sec"))
    return J.lookup(rows.select("l_orderkey", "l_linenumber"), flat, ["l_orderkey", "l_linenumber"], "abort")


@query("join05_existing", f"SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM {_CAT})")
def join05(spark, sf_dir):
    return J.existing(table(spark, sf_dir, "documents").select("doc_id", "source"), inputs.catalogue(spark, sf_dir), ["doc_id"])


@query("join06_remaining", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join06(spark, sf_dir):
    return J.remaining(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("join07_aligned_index", f"SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) - 1 AS idx FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM {_CAT})")
def join07(spark, sf_dir):
    from ..operators.convert import numbered

    return numbered(J.existing(table(spark, sf_dir, "documents").select("doc_id"), inputs.catalogue(spark, sf_dir), ["doc_id"]), "idx", "doc_id")


@query("join08_contained_name", "SELECT c.c_name AS clip, max(s.s_name) AS file FROM (SELECT DISTINCT substring(c_name, 10, 9) AS c_name FROM customer) c JOIN supplier s ON contains(s.s_name, c.c_name) GROUP BY c.c_name")
def join08(spark, sf_dir):
    clips = table(spark, sf_dir, "customer").select(F.substring("c_name", 10, 9).alias("clip")).distinct()
    return J.contained_name(clips, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("file")), "clip", "file")


@query("join09_priority_suffix", "SELECT doc_id, stem || suffix AS path FROM (SELECT doc_id, 'v_' || doc_id AS stem, CASE WHEN doc_id % 2 = 0 THEN '.mkv' WHEN doc_id % 3 = 0 THEN '.mp4' END AS suffix FROM documents) WHERE suffix IS NOT NULL")
def join09(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("v_"), F.col("doc_id").cast("string")).alias("stem"))
    kinds = F.expr("filter(array(if(doc_id % 3 = 0, '.mp4', NULL), if(doc_id % 2 = 0, '.mkv', NULL)), x -> x IS NOT NULL)")
    files = rows.select("stem", F.explode(kinds).alias("suffix"))
    return J.by_priority(rows, files, "stem", "suffix", [".mkv", ".mp4"]).select("doc_id", F.concat("stem", "suffix").alias("path"))


@query(
    "join10_range_member",
    """WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f FROM events)
       SELECT user_id, event_id, f // 10 AS bound FROM f""",
)
def join10(spark, sf_dir):
    from ..operators.convert import numbered

    points = numbered(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "f", "ts", "event_id", by=("user_id",))
    last = points.groupBy("user_id").agg(F.max("f").alias("last"))
    ranges = last.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("last div 10"))).alias("bound")).withColumns({"low": F.col("bound") * 10, "high": F.col("bound") * 10 + 10})
    return J.in_ranges(points, ranges, "user_id", "f", "low", "high", 10).select("user_id", "event_id", "bound")


_RES = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]
_SIZES = "SELECT p_partkey, p_size * 40 + 10 AS width, CAST(p_partkey % 37 AS INT) * 50 + 15 AS height FROM part"


@query(
    "join11_best_resolution",
    f"""WITH p AS ({_SIZES}), o AS (SELECT p.*, v.i, v.w, v.h, least(CAST(floor(width * least(v.w / width, v.h / height)) AS BIGINT) * CAST(floor(height * least(v.w / width, v.h / height)) AS BIGINT), CAST(width AS BIGINT) * height) AS eff
            FROM p, (VALUES {', '.join(f'({i}, {w}, {h})' for i, (w, h) in enumerate(_RES))}) v(i, w, h))
        SELECT p_partkey, best_w, best_h FROM (SELECT p_partkey, w AS best_w, h AS best_h, row_number() OVER (PARTITION BY p_partkey ORDER BY eff DESC, w * h - eff, i) AS r FROM o) WHERE r = 1""",
)
def join11(spark, sf_dir):
    from ..functions.spatial import effective_area

    rows = spark.sql(_SIZES.replace("FROM part", "FROM {p}"), p=table(spark, sf_dir, "part"))
    area = lambda o: effective_area(F.col("width"), F.col("height"), o["best_w"], o["best_h"])
    worth = lambda o: F.struct(area(o), area(o) - o["best_w"] * o["best_h"])
    return J.best_of(rows, _RES, ["best_w", "best_h"], worth).select("p_partkey", "best_w", "best_h")


@query("join12_stored_or_decoded", f"SELECT d.doc_id, coalesce(c.path, 'decoded/' || d.doc_id) AS frames FROM documents d LEFT JOIN {_CAT} c ON d.doc_id = c.doc_id")
def join12(spark, sf_dir):
    found = J.lookup(table(spark, sf_dir, "documents").select("doc_id"), inputs.catalogue(spark, sf_dir).select("doc_id", "path"), ["doc_id"], "keep")
    return found.select("doc_id", F.coalesce("path", F.concat(F.lit("decoded/"), F.col("doc_id").cast("string"))).alias("frames"))


@query("src05_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def src05(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01'").select("o_orderkey", "o_totalprice")


@query("src10b_offset_index", "SELECT doc_id, CAST(sum(strlen(text) + 1) OVER (ORDER BY doc_id) - strlen(text) - 1 AS BIGINT) AS byte_offset, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents")
def src10b(spark, sf_dir):
    from ..sources.blobs import line_index

    return line_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "byte_offset", "line")


@query("src13_name_before_dot", f"SELECT doc_id, split_part(split_part(path, '/', -1), '.', 1) AS key FROM {_CAT}")
def src13(spark, sf_dir):
    return inputs.catalogue(spark, sf_dir).select("doc_id", F.substring_index(F.substring_index("path", "/", -1), ".", 1).alias("key"))


@query(
    "src20_task_union",
    "SELECT task, key, row_number() OVER (ORDER BY k, key) - 1 AS id FROM (SELECT 0 AS k, 'region' AS task, CAST(r_regionkey AS BIGINT) AS key FROM region UNION ALL SELECT 1, 'nation', n_nationkey FROM nation UNION ALL SELECT 2, 'benchmark', item_id FROM benchmark)",
)
def src20(spark, sf_dir):
    from ..operators.convert import numbered
    from ..sources.readers import union_tasks

    parts = [("region", table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"))), ("nation", table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"))), ("benchmark", table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key")))]
    return numbered(union_tasks(parts), "id", "task_order", "key").select("task", "key", "id")


@query("set01_bag_union", "SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents WHERE doc_id % 2 = 0) GROUP BY source")
def set01(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.unionByName(d.where("doc_id % 2 = 0").drop("doc_id"), allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


@query("set02_keyed_last_wins", "SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def set02(spark, sf_dir):
    return J.keep_last(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], F.col("doc_id"))


@query("set03_distinct_sorted", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber % 3))), ',') AS idx FROM lineitem GROUP BY l_orderkey")
def set03(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber") % 3)), ",").alias("idx"))


@query("snk03_upsert", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM documents")
def snk03(spark, sf_dir):
    from ..sources.writers import upserted

    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("version"))
    return upserted(old, old.where("doc_id % 2 = 0").withColumn("version", F.lit("new")), ["doc_id"])
