"""FLT and PRJ: validity of samples, rewriting and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert as C
from ..operators import hygiene as H
from ..registry import query, table
from . import inputs

_D = f"({inputs.DIALOGUES})"


@query("flt02_valid_roles", f"SELECT conv_id, len(list_filter(conversations, lambda t: t['from'] IN ('human', 'gpt') AND t['value'] <> '')) = len(conversations) AS valid FROM {_D}")
def flt02(spark, sf_dir):
    return inputs.dialogues(spark, sf_dir).select("conv_id", H.valid_roles(F.col("conversations")).alias("valid"))


_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"


@query("flt03_valid_length", f"SELECT doc_id, {_WORDS.format('text')} * 1.5 >= 1 AND {_WORDS.format('text')} * 1.5 + (doc_id % 60) * 320 BETWEEN 1 AND 16384 AS valid FROM documents")
def flt03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.valid_length(F.array("text"), F.col("doc_id") % 60).alias("valid"))


@query("flt04_has_modality", "SELECT d.doc_id, coalesce(l.quality, l.toxic) IS NOT NULL AS has_modality FROM documents d LEFT JOIN labels l USING (doc_id)")
def flt04(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", H.has_modality(F.col("quality"), F.col("toxic")).alias("has_modality"))


@query("flt05_placeholder", f"SELECT conv_id, len(list_filter(conversations, lambda t: contains(t['value'], 'tion'))) > 0 AS found FROM {_D}")
def flt05(spark, sf_dir):
    return inputs.dialogues(spark, sf_dir).select("conv_id", H.has_placeholder(F.col("conversations"), "tion").alias("found"))


def _imaged(spark, sf_dir):
    """Each vector as an image of one row of grey samples: PNG or BMP, one in seven damaged in one of five ways."""
    import pyarrow as pa

    from ..sources import images

    def run(batches):
        for batch in batches:
            made = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grey = bytes(int(abs(v or 0) * 255) % 256 for v in x or [0.0])
                data = (images.png if i % 2 == 0 else images.bmp)(len(grey), 1, grey)
                if i % 7 == 3:
                    data = (lambda d: d[: len(d) - 9], lambda d: b"", lambda d: b"x" + d[1:], lambda d: d[:18] + b"\0\0\0\0" + d[22:], lambda d: d[:4] + d[: len(d) // 2])[i // 7 % 5](data)
                made.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["vec_id", "data"])

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>"))
    suffix = F.expr("CASE vec_id % 11 WHEN 0 THEN '.txt' WHEN 1 THEN '.PNG' ELSE '.bmp' END")
    return rows.mapInArrow(run, "vec_id long, data binary").withColumn("path", F.concat(F.lit("i/"), "vec_id", suffix))


@query("flt06_valid_image", "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 3 AND vec_id % 11 <> 0")
def flt06(spark, sf_dir):
    """Images by name whose bytes decode to samples of eight bits."""
    from ..sources.images import valid_images

    return valid_images(_imaged(spark, sf_dir), "path", "data").select("vec_id")


@query(
    "flt06_image_facts",
    """SELECT vec_id, CASE WHEN vec_id % 7 = 3 AND vec_id // 7 % 5 IN (1, 2, 4) THEN NULL WHEN vec_id % 2 = 0 THEN 'png' ELSE 'bmp' END AS format,
        CASE WHEN vec_id % 7 <> 3 THEN len(embedding) END AS width,
        CASE WHEN vec_id % 7 <> 3 THEN NULL ELSE CASE vec_id // 7 % 5 WHEN 0 THEN 'truncated' WHEN 1 THEN 'empty' WHEN 2 THEN 'signature' WHEN 3 THEN CASE WHEN vec_id % 2 = 0 THEN 'checksum' ELSE 'header' END
            ELSE 'odd' END END AS error FROM embeddings WHERE NOT (vec_id % 7 = 3 AND vec_id // 7 % 5 = 4)""",
)
def flt06_facts(spark, sf_dir):
    """What each image is, or what is wrong with it; those whose beginning is doubled are left to the test."""
    from ..sources.images import with_image_facts

    facts = with_image_facts(_imaged(spark, sf_dir), "data")
    return facts.where("NOT (vec_id % 7 = 3 AND vec_id div 7 % 5 = 4)").select("vec_id", "format", F.col("width").cast("long").alias("width"), "error")


@query("flt07_valid_frames", "SELECT user_id, count(*) AS n, count(*) >= 60 AND count(*) <= 70 AS valid, count(*) >= 60 AS valid_open FROM events GROUP BY user_id")
def flt07(spark, sf_dir):
    n = F.col("n")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", H.valid_frames(n, 60, 70).alias("valid"), H.valid_frames(n, 60).alias("valid_open"))


@query("flt08_composed", f"SELECT conv_id, len(conversations) AS n_turns FROM {_D} WHERE len(list_filter(conversations, lambda t: t['from'] IN ('human', 'gpt') AND t['value'] <> '')) = len(conversations) AND len(list_filter(conversations, lambda t: contains(t['value'], 'tion'))) > 0")
def flt08(spark, sf_dir):
    c = F.col("conversations")
    return H.filter_samples(inputs.dialogues(spark, sf_dir), H.valid_roles(c), H.has_placeholder(c, "tion")).select("conv_id", F.size(c).cast("long").alias("n_turns"))


@query("flt09_all_images_valid", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity >= 10)")
def flt09(spark, sf_dir):
    return H.all_valid(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity") >= 10)


def _slots(spark, sf_dir):
    """Turns as interleaved slots: text of assistants, images of users."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return t.select("conv_id", F.expr("transform(t, x -> if(x.role = 'user', NULL, x.text))").alias("caption"), F.expr("transform(t, x -> if(x.role = 'user', concat('img_', x.turn), NULL))").alias("image"))


_SLOTS = "(SELECT conv_id, list(CASE WHEN role = 'user' THEN NULL ELSE text END ORDER BY turn) AS caption, list(CASE WHEN role = 'user' THEN 'img_' || turn END ORDER BY turn) AS image FROM conversations GROUP BY conv_id)"


@query("flt10_interleaved_admission", f"SELECT conv_id, CASE WHEN image[-1] IS NOT NULL THEN len(image) - 1 ELSE len(image) END AS n_slots FROM {_SLOTS} WHERE len(image) >= 2 AND image[1] IS NOT NULL")
def flt10(spark, sf_dir):
    c, i = F.col("caption"), F.col("image")
    return _slots(spark, sf_dir).where(H.admitted(c, i)).select("conv_id", F.size(H.without_last_image(c, i)).cast("long").alias("n_slots"))


@query("flt11_two_frames", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def flt11(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where(H.valid_frames(F.col("n"), 2))


@query("flt12_long_scenes", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity + l_tax * 100) - l_quantity >= 5")
def flt12(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("end_sec", F.expr("l_quantity + l_tax * 100")).where("end_sec - l_quantity >= 5").select("l_orderkey", "l_linenumber")


@query("flt13_file_selection", f"SELECT doc_id, path FROM ({inputs.CATALOGUE_SQL}) WHERE contains(path, 'src1') AND NOT contains(path, '.mkv')")
def flt13(spark, sf_dir):
    return inputs.catalogue(spark, sf_dir).where(F.col("path").contains("src1") & ~F.col("path").contains(".mkv")).select("doc_id", "path")


@query("flt14_whole_caption", "SELECT conv_id, first(text ORDER BY turn) AS caption FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def flt14(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.expr("if(role = 'assistant', '-1', turn)").alias("idx"), F.col("text").alias("content")))).alias("c"))
    return t.select("conv_id", H.first_whole_caption(F.col("c")).alias("caption")).where("caption IS NOT NULL")


@query("prj01_path_rewrite", f"SELECT doc_id, regexp_replace(path, '^videos/(src\\d+)/', 'data/\\1_new/') AS path FROM ({inputs.CATALOGUE_SQL})")
def prj01(spark, sf_dir):
    return H.rewrite_paths(inputs.catalogue(spark, sf_dir), "path", r"^videos/(src\d+)/", "data/$1_new/").select("doc_id", "path")


@query("prj02_uid", "SELECT doc_id, 'set_' || source || '_' || (row_number() OVER (ORDER BY doc_id) - 1) AS uid FROM documents")
def prj02(spark, sf_dir):
    rows = C.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "i", "doc_id")
    return rows.select("doc_id", C.uid("set", F.col("source"), F.col("i")).alias("uid"))


def _qa(spark, sf_dir):
    """Each order's lines as questions and answers."""
    qa = F.struct("l_linenumber", F.concat(F.lit("Look at "), F.col("l_returnflag")).alias("i"), F.concat(F.lit("What is part "), F.col("l_partkey").cast("string")).alias("q"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("a"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(qa)).alias("QA"))


@query(
    "prj03_qa_to_dialogue",
    "SELECT l_orderkey, '<video>' || chr(10) || 'Look at ' || l_returnflag || ' What is part ' || l_partkey AS human, 'supplier ' || l_suppkey AS gpt FROM lineitem",
)
def prj03(spark, sf_dir):
    out = C.qa_to_dialogues(_qa(spark, sf_dir), "QA", "iq")
    return out.select("l_orderkey", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query(
    "prj04_qa_to_one_dialogue",
    """SELECT l_orderkey, 2 * count(*) AS n_turns, '<video>' || chr(10) || string_agg('Look at ' || l_returnflag || '|supplier ' || l_suppkey, '|' ORDER BY l_linenumber, 'Look at ' || l_returnflag, 'What is part ' || l_partkey, 'supplier ' || l_suppkey) AS joined FROM lineitem GROUP BY l_orderkey""",
)
def prj04(spark, sf_dir):
    d = _qa(spark, sf_dir).select("l_orderkey", C.qa_to_one_dialogue(F.col("QA")).alias("c"))
    return d.select("l_orderkey", F.size("c").cast("long").alias("n_turns"), F.array_join(F.transform("c", lambda t: t["value"]), "|").alias("joined"))


@query("prj05_sentence_merge", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS caption FROM conversations GROUP BY conv_id")
def prj05(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return t.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("caption"))


@query(
    "prj06_caption_and_qa",
    "SELECT l_orderkey, 0 AS k, 'Describe.' AS q, 'order ' || l_orderkey AS a FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, 'What is part ' || l_partkey, 'supplier ' || l_suppkey), 'What is part ' || l_partkey, 'supplier ' || l_suppkey FROM lineitem",
)
def prj06(spark, sf_dir):
    rows = _qa(spark, sf_dir).select("l_orderkey", F.transform("QA", lambda x: F.struct(x["q"].alias("question"), x["a"].alias("answer"))).alias("g"))
    each = C.caption_and_qa(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), F.col("g"), "Describe.")
    return rows.select("l_orderkey", F.posexplode(each).alias("k", "p")).select("l_orderkey", F.col("k").cast("long").alias("k"), "p.q", "p.a")


@query("prj09_category", "SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'QA' WHEN contains(source, 'src1') THEN 'Caption' ELSE 'Storyline' END AS category FROM documents")
def prj09(spark, sf_dir):
    s = F.col("source")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(s.rlike("^src[0-4]$"), "QA").when(s.contains("src1"), "Caption").otherwise("Storyline").alias("category"))


@query("prj10_relative_times", "SELECT l_orderkey, l_linenumber, greatest(0.0, l_quantity - 20) AS t0, greatest(0.0, l_quantity + 1.25 - 20) AS t1 FROM lineitem")
def prj10(spark, sf_dir):
    times = C.relative_times(F.array(F.col("l_quantity"), F.col("l_quantity") + 1.25), F.lit(20.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.alias("t")).select("l_orderkey", "l_linenumber", F.col("t")[0].alias("t0"), F.col("t")[1].alias("t1"))


@query("prj12_path_prefix", f"SELECT doc_id, '/data/' || path AS path FROM ({inputs.CATALOGUE_SQL}) c WHERE doc_id IN (SELECT doc_id FROM labels)")
def prj12(spark, sf_dir):
    return inputs.catalogue(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.concat(F.lit("/data/"), "path").alias("path"))


@query("prj13_single_image", "SELECT doc_id, source || '/' || doc_id || '.jpg' AS image, '<image>' || chr(10) || 'Describe.' AS human, text AS gpt FROM documents")
def prj13(spark, sf_dir):
    c = F.array(C.turn("human", F.lit("<image>\nDescribe.")), C.turn("gpt", F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"), c.alias("conversations"))
    return rows.select("doc_id", "image", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query("prj14_row_range", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 10 AND i < 60")
def prj14(spark, sf_dir):
    return C.slice_rows(C.numbered(table(spark, sf_dir, "documents").select("doc_id"), "i", "doc_id"), "i", 10, 60).select("doc_id")


@query("prj15_modality", f"SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'image' WHEN c.path IS NOT NULL THEN CASE WHEN d.doc_id % 7 <= 1 THEN 'image' ELSE 'video' END ELSE 'text' END AS modality FROM documents d LEFT JOIN ({inputs.CATALOGUE_SQL}) c USING (doc_id)")
def prj15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(inputs.catalogue(spark, sf_dir), "doc_id", "left")
    image = F.expr("CASE WHEN doc_id % 5 = 0 THEN 'x.jpg' END")
    return d.select("doc_id", C.modality(image, F.col("path"), F.col("doc_id") % 7).alias("modality"))


@query("prj16_fallback_row", f"SELECT d.doc_id, coalesce(c.path, 'none') AS path, CASE WHEN c.path IS NULL THEN CASE WHEN d.doc_id % 2 = 0 THEN 8 ELSE 2 END ELSE 16 END AS n_frames FROM documents d LEFT JOIN ({inputs.CATALOGUE_SQL}) c USING (doc_id)")
def prj16(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(inputs.catalogue(spark, sf_dir), "doc_id", "left")
    return d.select("doc_id", F.coalesce("path", F.lit("none")).alias("path"), F.expr("if(path IS NULL, if(doc_id % 2 = 0, 8, 2), 16)").alias("n_frames"))


@query("snk06_routing", "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'caption' WHEN source IN ('src2', 'src3') THEN 'qa' ELSE 'other' END AS bucket FROM documents) GROUP BY bucket")
def snk06(spark, sf_dir):
    bucket = H.routed(F.col("source"), {"caption": ("src0", "src1"), "qa": ("src2", "src3")}, "other")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("snk07_fan_out", "SELECT gt, count(*) AS n FROM (SELECT conv_id, count(*) AS c FROM conversations GROUP BY conv_id) JOIN (VALUES (2), (3), (4)) v(gt) ON c >= 2 * gt GROUP BY gt")
def snk07(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("c"))
    return H.fan_out(n, F.col("c")).groupBy("gt").agg(F.count("*").alias("n"))
