"""Every annotation source converted: annotations and media made of the tables, decoders that stand for a codec."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hygiene import fan_out
from ..registry import query, table
from ..sources import catalogue as C
from ..sources import external

_VIDEO = "concat('c', l_orderkey % 4, '/d', l_orderkey % 3, '/v', l_orderkey, '.webm')"
#: The same values as SPEC's, in SQL: category, key, prompt.
_PROMPT = {"i": "'Look at ' || l_returnflag", "q": "'What is part ' || l_partkey", "iq": "'Look at ' || l_returnflag || ' What is part ' || l_partkey"}


def _duck(expression: str) -> str:
    """Spark's split()[n] and element_at(.., -1), as DuckDB has them; its lists begin at 1."""
    return expression.replace("split(video, '/')[0]", "split_part(video, '/', 1)").replace("split(video, '/')[1]", "split_part(video, '/', 2)").replace("element_at(split(video, '/'), -1)", "split_part(video, '/', -1)")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("video", F.expr(_VIDEO))


def _qa(spark, sf_dir):
    qa = F.struct(F.concat(F.lit("Look at "), "l_returnflag").alias("i"), F.concat(F.lit("What is part "), F.col("l_partkey").cast("string")).alias("q"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("a"))
    return _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("i"), "video").agg(F.collect_list(F.struct("l_linenumber", qa.alias("qa"))).alias("_s")).select("i", "video", F.transform(F.array_sort("_s"), lambda x: x["qa"]).alias("QA"))


def _videos(spark, sf_dir, miss):
    """Videos of all orders, or of two in three."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")).where("true" if miss == "abort" else "l_orderkey % 3 <> 0")
    return rows.withColumn("video", F.expr(_VIDEO))


def _dialogue(df, *columns):
    return df.select("uid", "video", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"), "data_type", *columns)


def _qa_query(spec):
    where = "" if spec.miss == "abort" else "WHERE l_orderkey % 3 <> 0"
    sql = f"""SELECT '{spec.prefix}_' || {_duck(spec.category)} || '_' || l_orderkey AS uid, 'media/' || {_duck(spec.key)} AS video, {_PROMPT[spec.form]} AS human, 'supplier ' || l_suppkey AS gpt, 'conversations' AS data_type
        FROM (SELECT *, {_VIDEO} AS video FROM lineitem) {where}"""

    def run(spark, sf_dir):
        files = _videos(spark, sf_dir, spec.miss).select(F.expr(spec.key).alias("key")).distinct().withColumn("path", F.concat(F.lit("media/"), "key"))
        return _dialogue(C.qa_source(spec, _qa(spark, sf_dir), files))

    query(f"cat_{spec.name}", sql)(run)


# NextQA's videos have one folder only, so that its second part is the name; the others' keys are as made here.
for _spec in C.QA_SOURCES.values():
    _qa_query(_spec)


def _stub(path: str, start: float = 0.0, stop: float = 0.0) -> tuple[list[str], list[float]]:
    """Stands for a codec: the digits of a path's name give the number of frames, one a second; every seventh can't be read."""
    number = int("".join(c for c in path.split("/")[-1] if c.isdigit()))
    if number % 7 == 0:
        raise ValueError("unreadable")
    return [f"{path}#{k}" for k in range(number % 5)], [start + k for k in range(number % 5)]


@query(
    "cat_videochatgpt",
    f"""SELECT 'VideoChat2IT_VideoChatGPT_train_v' || l_orderkey || '.webm_' || l_orderkey AS uid, 'media/v' || l_orderkey || CASE WHEN l_orderkey % 2 = 0 THEN '.mkv' ELSE '.mp4' END AS video, {_PROMPT["q"]} AS human, 'supplier ' || l_suppkey AS gpt, 'conversations' AS data_type
        FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 = 0""",
)
def videochatgpt(spark, sf_dir):
    suffix = F.explode(F.expr("filter(array(if(l_orderkey % 3 = 0, '.mp4', NULL), if(l_orderkey % 2 = 0, '.mkv', NULL)), x -> x IS NOT NULL)"))
    files = _videos(spark, sf_dir, "abort").select(F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("stem"), suffix.alias("suffix"))
    return _dialogue(C.videochatgpt(_qa(spark, sf_dir), files.withColumn("path", F.concat(F.lit("media/"), "stem", "suffix"))))


@query(
    "cat_youcook2",
    """SELECT 'VideoChat2IT_YouCook2_training_' || l_orderkey % 4 || '_n' || l_orderkey || 'z_split_' || l_linenumber || '.mp4_' || l_orderkey AS uid,
            'training/' || l_orderkey % 4 || '/' || 'n' || l_orderkey || 'z_' || l_linenumber * 10 + 5 || ':' || l_linenumber * 10 + 5 || 'x.mkv' AS video,
            'Look at ' || l_returnflag AS human, 'supplier ' || l_suppkey AS gpt, 'conversations' AS data_type, l_orderkey % 5 AS n_images,
            array_to_string(list_transform(range(l_orderkey % 5), lambda k: CAST(k AS VARCHAR) || '.0'), ',') AS times
        FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey % 7 <> 0""",
)
def youcook2(spark, sf_dir):
    qa = F.array(F.struct(F.concat(F.lit("Look at "), "l_returnflag").alias("i"), F.lit("").alias("q"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("a")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), "l_linenumber", F.expr("concat('training/', l_orderkey % 4, '/n', l_orderkey, 'z/split_', l_linenumber, '.mp4')").alias("video"), qa.alias("QA"))
    # Dealt out first: lines of an order are far apart, so that what a task could leave out isn't worth its spilling.
    segments = rows.select(F.concat(F.lit("n"), F.col("i").cast("string"), F.lit("z")).alias("name"), F.col("l_linenumber").cast("int").alias("id")).repartition("name", "id").distinct()
    segments = segments.withColumns({"start": F.col("id") * 10.0, "stop": F.col("id") * 10 + 5})
    listing = _videos(spark, sf_dir, "skip").select(F.expr("concat('training/', l_orderkey % 4)").alias("folder"), F.expr("explode(array(concat('n', l_orderkey, 'zx.mkv'), concat('n', l_orderkey, 'z.avi')))").alias("file"))
    clips = C.youcook2(rows.drop("l_linenumber"), listing, segments, _stub)
    return _dialogue(clips, F.size("images").cast("long").alias("n_images"), F.array_join(F.transform("timestamps", lambda t: t.cast("string")), ",").alias("times"))


@query(
    "cat_webvid",
    f"""SELECT 'WebVid400K_' || l_orderkey AS uid, 'media/' || video AS video, n_turns, first_prompt, last_answer, n_images, 'conversations' AS data_type FROM (
            SELECT l_orderkey, {_VIDEO} AS video, 2 * count(*) AS n_turns, first('Look at ' || l_returnflag ORDER BY l_linenumber, l_returnflag, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS first_prompt,
                last('supplier ' || l_suppkey ORDER BY l_linenumber, l_returnflag, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS last_answer, l_orderkey % 5 AS n_images
            FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey % 7 <> 0 AND l_orderkey % 5 >= 2 GROUP BY ALL)""",
)
def webvid(spark, sf_dir):
    files = _videos(spark, sf_dir, "skip").select("video", F.concat(F.lit("media/"), "video").alias("path"))
    out = C.webvid(_qa(spark, sf_dir), files, _stub)
    c = F.col("conversations")
    return out.select("uid", "video", F.size(c).cast("long").alias("n_turns"), c[0]["value"].alias("first_prompt"), F.element_at(c, -1)["value"].alias("last_answer"), F.size("images").cast("long").alias("n_images"), "data_type")


@query("cat_anet_captions", """SELECT 'ANetCaptions_v' || conv_id AS uid, 'media/v' || conv_id || '.mp4' AS video, string_agg(text, ' ' ORDER BY turn) AS caption, conv_id % 5 AS n_images, 'caption' AS data_type
    FROM conversations WHERE conv_id % 3 <> 0 AND (conv_id * 10 + 4) % 7 <> 0 GROUP BY conv_id""")
def anet_captions(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_s"))
    rows = told.select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video"), F.transform("_s", lambda x: x["text"]).alias("sentences"))
    files = told.where("conv_id % 3 <> 0").select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video"), F.concat(F.lit("media/v"), F.col("conv_id").cast("string"), F.lit(".mp4")).alias("path"))
    return C.anet_captions(rows, files, _of_clip).select("uid", "video", "caption", F.size("images").cast("long").alias("n_images"), "data_type")


def _of_clip(path: str) -> tuple[list[str], list[float]]:
    """As _stub, by the name with the 4 of .mp4 behind it; as many frames as the name itself says."""
    _stub(path)
    number = int("".join(c for c in path.split("/")[-1].split(".")[0] if c.isdigit()))
    return [path] * (number % 5), [float(k) for k in range(number % 5)]


@query("cat_sharegpt4video", """SELECT 'ShareGPT4Video_' || source || '_' || doc_id AS uid, 'media/v' || doc_id || '.mp4' AS video, text AS caption, doc_id % 5 AS n_images, 'caption' AS data_type
    FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND (doc_id * 10 + 4) % 7 <> 0 AND text IS NOT NULL""")
def sharegpt4video(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    entry = lambda idx, content: F.struct(idx.alias("idx"), content.alias("content"))
    captions = F.array(entry(F.lit("0"), F.lit("a clip")), entry(F.when(F.col("doc_id") % 2 == 0, "-1").otherwise("1"), F.col("text")), entry(F.lit("2"), F.lit("another")))
    rows = d.select(F.col("doc_id").alias("i"), name.alias("video"), F.concat(F.lit("zips/"), "source", F.lit(".zip")).alias("zip_folder"), captions.alias("captions"))
    files = d.where("doc_id % 3 <> 0").select(name.alias("video"), F.concat(F.lit("media/"), name).alias("path")).distinct()
    return C.sharegpt4video(rows, files, _of_clip).select("uid", "video", "caption", F.size("images").cast("long").alias("n_images"), "data_type")


_PROMPTS = ["Please locate the timestamp of the climax", "Please provide a general outline of the storyline of it", "Describe it"]


@query(
    "cat_finevideo",
    f"""SELECT uid, category, CASE WHEN category IN ('Caption', 'Storyline') THEN 'caption_storyline' ELSE 'qa_climax' END AS route, doc_id % 5 AS n_images FROM (
        SELECT doc_id, uid, CASE WHEN contains(uid, 'qAndA') THEN 'QA' WHEN doc_id % 3 = 0 THEN 'Climax' WHEN doc_id % 3 = 1 THEN 'Storyline' ELSE 'Caption' END AS category
        FROM (SELECT doc_id, 'f_' || CASE WHEN doc_id % 4 = 0 THEN 'qAndA' ELSE 'x' END || doc_id AS uid FROM documents WHERE doc_id % 5 <> 0 AND (doc_id * 10 + 4) % 7 <> 0))""",
)
def finevideo(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    prompt = F.element_at(F.array(*[F.lit(p) for p in _PROMPTS]), (F.col("doc_id") % 3 + 1).cast("int"))
    said = F.array(F.struct(F.lit("human").alias("from"), prompt.alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("text").alias("value")))
    rows = d.select(F.expr("concat('f_', if(doc_id % 4 = 0, 'qAndA', 'x'), doc_id)").alias("uid"), F.concat(F.lit("old/"), name).alias("video"), said.alias("conversations"))
    files = d.where("doc_id % 5 <> 0").select(name.alias("name"), F.concat(F.lit("media/"), name).alias("path")).distinct()
    return C.finevideo(rows, files, _of_clip).select("uid", "category", "route", F.size("images").cast("long").alias("n_images"))


_TEMPLATES = ["Describe it.", "What happens?", "Tell it in detail."]


def _choice(key: str) -> str:
    """hash_choice with seed 0, in DuckDB."""
    return f"list_extract([{', '.join(repr(t) for t in _TEMPLATES)}], CAST(CAST('0x' || md5('0-' || {key})[1:8] AS BIGINT) % 3 AS INT) + 1)"


@query(
    "cat_moviechat",
    f"""SELECT 'MovieChat_m' || conv_id || '_caption_' || conv_id AS uid, 'films/m' || conv_id || '.mp4' AS video, {_choice("'m' || conv_id")} AS human, arg_min(text, turn) AS gpt, 'conversations' AS data_type FROM conversations GROUP BY conv_id
        UNION ALL SELECT 'MovieChat_m' || conv_id || '_qa_' || conv_id, 'films/m' || conv_id || '.mp4', 'turn ' || turn, text, 'conversations' FROM conversations""",
)
def moviechat(spark, sf_dir):
    qa = F.struct("turn", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("question"), F.col("text").alias("answer"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("i")).agg(F.array_sort(F.collect_list(qa)).alias("QA"))
    rows = rows.select("i", F.concat(F.lit("m"), F.col("i").cast("string")).alias("name"), F.col("QA")[0]["answer"].alias("caption"), "QA")
    return _dialogue(C.moviechat(rows, "films/", _TEMPLATES))


@query(
    "cat_longvila",
    """SELECT 'LongVilaSFT_y' || doc_id || '_' || doc_id AS uid, 'media/y' || doc_id || '.mp4' AS video, 'Tell me <video>' AS human, text AS gpt, 'conversations' AS data_type
        FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 >= 2""",
)
def longvila(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    id_ = F.concat(F.lit("y"), F.col("doc_id").cast("string"))
    asked = F.when(F.col("doc_id") % 2 == 0, "Tell<video> me <video>").otherwise("Tell \n <video> me <video>")
    said = F.array(C.turn_of(F.lit("human"), asked), C.turn_of(F.lit("gpt"), F.col("text")))
    rows = d.select(F.col("doc_id").alias("i"), id_.alias("id"), said.alias("conversations"))
    files = d.where("doc_id % 3 <> 0").select(id_.alias("id"), F.concat(F.lit("media/"), id_, F.lit(".mp4")).alias("path"), (F.col("doc_id") % 5).alias("frames")).distinct()
    return _dialogue(C.longvila(rows, files))


def _image_samples(spark, sf_dir, name):
    said = F.array(C.turn_of(F.lit("human"), F.lit("<image>\nDescribe.")), C.turn_of(F.lit("gpt"), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("image"), said.alias("conversations"))


def _listed(spark, sf_dir):
    """Images of the documents that have labels."""
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image")).distinct()


@query("cat_llava_pretrain", "SELECT 'img/' || doc_id || '.jpg' AS image, '<image>' || chr(10) || 'Describe.' AS human, text AS gpt, 'conversations' AS data_type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def llava_pretrain(spark, sf_dir):
    rows = _image_samples(spark, sf_dir, F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
    out = C.llava_pretrain(rows, "img/", _listed(spark, sf_dir))
    return out.select("image", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"), "data_type")


@query("cat_llava_ov_single", "SELECT CAST(doc_id AS VARCHAR) AS uid, CASE WHEN doc_id % 4 > 0 THEN 'img/' || doc_id || '.jpg' END AS image, text AS gpt, 'conversations' AS data_type FROM documents")
def llava_ov_single(spark, sf_dir):
    rows = _image_samples(spark, sf_dir, F.expr("if(doc_id % 4 > 0, cast('bytes' AS binary), NULL)")).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    return C.llava_ov_single(rows, "img/").select("uid", "image", F.col("conversations")[1]["value"].alias("gpt"), "data_type")


@query(
    "cat_llava_ov_multi",
    """WITH s AS (SELECT doc_id, list_transform(range(1 + doc_id % 3), lambda k: doc_id + k) AS ids FROM documents)
        SELECT doc_id AS uid, array_to_string(list_transform(ids, lambda x: 'img/' || x || '.jpg'), ',') AS images, 'conversations' AS data_type
        FROM s WHERE len(list_filter(ids, lambda x: x % 7 = 0)) = 0""",
)
def llava_ov_multi(spark, sf_dir):
    names = F.expr("transform(sequence(0L, doc_id % 3), k -> concat(doc_id + k, '.jpg'))")
    rows = _image_samples(spark, sf_dir, names).withColumnRenamed("doc_id", "uid")
    valid = table(spark, sf_dir, "documents").select(F.explode(F.expr("array(doc_id, doc_id + 1, doc_id + 2)")).alias("n")).where("n % 7 <> 0").select(F.concat(F.lit("img/"), F.col("n").cast("string"), F.lit(".jpg")).alias("image")).distinct()
    return C.llava_ov_multi(rows, "img/", valid).select("uid", F.array_join("image", ",").alias("images"), "data_type")


@query("cat_llava_recap", f"SELECT CAST(doc_id AS VARCHAR) AS uid, 'img/' || doc_id || '.jpg' AS image, '<image>' || chr(10) || {_choice('doc_id')} AS human, text AS gpt, 'conversations' AS data_type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def llava_recap(spark, sf_dir):
    rows = _image_samples(spark, sf_dir, F.lit(None)).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id", "image")
    out = C.llava_recap(rows, "img/", _listed(spark, sf_dir), _TEMPLATES)
    return out.select("uid", "image", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"), "data_type")


@query(
    "cat_obelics",
    """WITH s AS (SELECT conv_id, turn, text, turn % 3 = 0 AS img FROM conversations),
        d AS (SELECT conv_id, count(*) AS n, arg_min(img, turn) AS first, arg_max(img, turn) AS last FROM s GROUP BY conv_id),
        k AS (SELECT conv_id, n - CASE WHEN last THEN 1 ELSE 0 END AS slots FROM d WHERE n >= 2 AND first AND conv_id % 11 <> 0)
        SELECT conv_id, slots, gt, 'interleave' AS data_type FROM k JOIN (VALUES (2), (3), (4)) v(gt) ON slots >= 2 * gt""",
)
def obelics(spark, sf_dir):
    slot = F.struct("turn", F.expr("if(turn % 3 = 0, NULL, text)").alias("caption"), F.expr("if(turn % 3 = 0, concat(turn, '.jpg'), NULL)").alias("image"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(slot)).alias("_s"))
    docs = docs.select("conv_id", F.transform("_s", lambda x: x["caption"]).alias("caption"), F.transform("_s", lambda x: x["image"]).alias("image"), (F.col("conv_id") % 11 == 0).alias("failed"))
    return fan_out(C.obelics(docs), F.size("image")).select("conv_id", F.size("image").cast("long").alias("slots"), "gt", "data_type")


def _judge(prompt: str) -> str:
    """Stands for a judge model: refuses every fifth, scores by the prompt's length."""
    if len(prompt) % 5 == 0:
        raise TimeoutError("no answer")
    return f"{{'pred': 'yes', 'score': {len(prompt) % 6}}}"


@query("ext_judge", """SELECT doc_id, CASE WHEN length(p) % 5 <> 0 THEN CAST(length(p) % 6 AS INT) END AS score, CASE WHEN length(p) % 5 = 0 THEN 'TimeoutError: no answer' END AS error
    FROM (SELECT doc_id, 'Judge: ' || coalesce(text, '') AS p FROM documents)""")
def ext_judge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Judge: "), F.coalesce("text", F.lit(""))).alias("prompt"))
    score = lambda r: F.regexp_extract(r, r"'score': (\d+)", 1).cast("int")
    return external.judged(rows, F.col("prompt"), _judge, score, attempts=3).select("doc_id", "score", "error")


@query("ext_decode", "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 END AS n_images, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: unreadable' END AS error FROM documents")
def ext_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    out = external.called(rows, _stub, [F.concat(F.lit("v/"), F.col("doc_id").cast("string"))], external.FRAMES, attempts=2)
    return out.select("doc_id", F.when(F.col("error").isNull(), F.size("images")).cast("long").alias("n_images"), "error")


def _clips(name: str, n: int):
    for k in range(n):
        yield k, f"{name}-{k}"


@query("ext_generator", "SELECT n_nationkey, CAST(k AS BIGINT) AS k, n_name || '-' || k AS clip FROM (SELECT *, unnest(range(n_nationkey % 5)) AS k FROM nation)")
def ext_generator(spark, sf_dir):
    spark.udtf.register("cubeloom_clips", external.table_function(_clips, "k long, clip string"))
    return spark.sql("SELECT n_nationkey, c.k, c.clip FROM {nation} n, LATERAL cubeloom_clips(n.n_name, CAST(n.n_nationkey % 5 AS INT)) c", nation=table(spark, sf_dir, "nation"))
