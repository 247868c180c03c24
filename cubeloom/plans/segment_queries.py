"""WIN and AGG: order-dependent operators and aggregations over frames and tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import segments as S
from ..registry import query, table
from . import inputs

_ORDER = ["ts", "event_id"]
_N = "(SELECT user_id, event_id, ts, value AS x, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_M = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT * FROM {_N}),
    d AS MATERIALIZED (SELECT a.user_id, a.i, a.x - b.x AS d FROM f a JOIN f b ON a.user_id = b.user_id AND a.i = b.i + 1),
    m AS (SELECT user_id, i, d AS m FROM d WHERE i = 1 UNION ALL SELECT d.user_id, d.i, 0.8 * d.d + (1 - 0.8) * m.m FROM m JOIN d ON d.user_id = m.user_id AND d.i = m.i + 1)"""


@query("win01_key_ordinal", "SELECT event_id, user_id || '_' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS key FROM events")
def win01(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("_", F.col("user_id").cast("string"), (F.row_number().over(w) - 1).cast("string")).alias("key"))


@query(
    "win02_flag_segments",
    f"""SELECT user_id, CAST(seg - 1 AS BIGINT) AS segment, min(i) AS start, max(i) + 1 AS stop FROM (
        SELECT *, sum(CASE WHEN i = 0 OR event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS seg FROM {_N}) GROUP BY user_id, seg""",
)
def win02(spark, sf_dir):
    f = inputs.frames(spark, sf_dir).withColumn("flag", (F.col("event_type") == "purchase").cast("int"))
    return S.flags_to_segments(f, "user_id", _ORDER, "flag")


@query(
    "win03_label_runs",
    f"""SELECT user_id, min(i) AS start, max(i) + 1 AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM {_N} WHERE event_type = 'click') GROUP BY user_id, g""",
)
def win03(spark, sf_dir):
    return S.label_runs(inputs.frames(spark, sf_dir), "user_id", _ORDER, F.col("event_type") == "click")


@query("win04_momentum", f"{_M} SELECT f.user_id, f.event_id, round(m.m, 6) AS m FROM f LEFT JOIN m ON f.user_id = m.user_id AND f.i = m.i")
def win04(spark, sf_dir):
    return S.momentum(inputs.frames(spark, sf_dir), "user_id", _ORDER, "x").select("user_id", "event_id", F.round("m", 6).alias("m"))


@query("win04_momentum_window", f"{_M} SELECT f.user_id, f.event_id, round(m.m, 6) AS m FROM f LEFT JOIN m ON f.user_id = m.user_id AND f.i = m.i")
def win04_window(spark, sf_dir):
    return S.momentum_closed(inputs.frames(spark, sf_dir), "user_id", _ORDER, "x").select("user_id", "event_id", F.round("m", 6).alias("m"))


_FLAGS = """, s AS (SELECT f.*, round(m.m, 9) AS score FROM f LEFT JOIN m ON f.user_id = m.user_id AND f.i = m.i),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, i) AS r FROM s),
    b AS (SELECT *, CASE WHEN i = 0 OR (r <= greatest(round_even(n / 5.0, 0) - 1, 1) AND score IS NOT NULL) THEN 1 ELSE 0 END AS flag FROM r)"""


def _flagged(spark, sf_dir):
    scored = S.momentum(inputs.frames(spark, sf_dir), "user_id", _ORDER, "x", "score").withColumn("score", F.round("score", 9))
    return S.top_boundaries(scored, "user_id", _ORDER, "score")


@query("win05_top_boundaries", f"{_M}{_FLAGS} SELECT user_id, event_id, flag FROM b")
def win05(spark, sf_dir):
    return _flagged(spark, sf_dir).select("user_id", "event_id", "flag")


@query(
    "win04_05_02_cubes",
    f"""{_M}{_FLAGS}, g AS (SELECT *, CAST(sum(flag) OVER (PARTITION BY user_id ORDER BY i) - 1 AS BIGINT) AS segment FROM b)
        SELECT user_id, segment, min(i) AS start, max(i) + 1 AS stop, count(*) AS n_frames, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us, round(avg(x), 6) AS mean_x FROM g GROUP BY user_id, segment""",
)
def cubes(spark, sf_dir):
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return S.flags_to_segments(_flagged(spark, sf_dir), "user_id", _ORDER, "flag", F.count("*").alias("n_frames"), span.alias("span_us"), F.round(F.avg("x"), 6).alias("mean_x"))


def _gumbel_sql(kind: int) -> str:
    return f"-ln(-ln((CAST(('0x' || md5('11-' || user_id || '-' || i || '-{kind}')[1:13]) AS BIGINT) + 0.5) / 4503599627370496.0))"


_WEIGHT = "(0.01 + (0.5 - 0.01) * 0.5 * (1 + cos(least(i / 60.0, 1.0) * pi())))"
_SOFT = f"(SELECT user_id, event_id, i, round(1 / (1 + exp(-(m / 50 + ({_gumbel_sql(1)} - ({_gumbel_sql(0)})) * {_WEIGHT}) / 0.5)), 9) AS p FROM m JOIN f USING (user_id, i))"


@query(
    "win06_gumbel_boundary",
    f"""{_M} SELECT user_id, i, round(p, 6) AS p, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY p DESC, i) <= greatest(round_even(count(*) OVER (PARTITION BY user_id) / 5.0, 0) - 1, 1) THEN 1 ELSE 0 END AS hard
        FROM {_SOFT}""",
)
def win06(spark, sf_dir):
    """Soft boundaries with noise whose weight falls along a video, and the hard ones, its k highest."""
    m = S.momentum(inputs.frames(spark, sf_dir), "user_id", _ORDER, "x")
    at = S.running(m, "user_id", _ORDER, i=F.lit(1)).withColumn("i", F.col("i") - 1).where("m IS NOT NULL")
    noise = S.gumbel(11, F.col("user_id"), F.col("i"), F.lit(1)) - S.gumbel(11, F.col("user_id"), F.col("i"), F.lit(0))
    soft = S.gumbel_soft(F.col("m") / 50, S.cosine_anneal(F.col("i"), 60, 0.5, 0.01), 0.5, noise)
    hard = S.top_boundaries(at.select("user_id", "i", F.round(soft, 9).alias("p")), "user_id", ["i"], "p", out="hard", first=False)
    return hard.select("user_id", "i", F.round("p", 6).alias("p"), "hard")


@query(
    "win07_merge_turns",
    """SELECT conv_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM (
        SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM (
            SELECT *, CASE WHEN (turn % 3 = 0) <> lag(turn % 3 = 0) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS c FROM conversations)) GROUP BY conv_id, grp""",
)
def win07(spark, sf_dir):
    g = S.change_groups(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("turn") % 3 == 0)
    merged = g.groupBy("conv_id", "grp").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return merged.select("conv_id", "grp", "n", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


@query(
    "win08_context_turns",
    """SELECT conv_id, turn, CAST(sum(o) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM (
        SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND NOT coalesce(lag(turn % 4 = 0) OVER (PARTITION BY conv_id ORDER BY turn), true) THEN 1 ELSE 0 END AS o FROM conversations)""",
)
def win08(spark, sf_dir):
    return S.context_turns(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("turn") % 4 == 0, "turn_no").select("conv_id", "turn", "turn_no")


_KIND = "CASE WHEN (turn + conv_id) % 3 = 0 THEN 'gpt' WHEN (turn + conv_id) % 7 = 1 THEN 'none' ELSE 'human' END"


@query(
    "win07_interleaved_turns",
    f"""WITH s AS (SELECT conv_id, turn, text, {_KIND} AS k FROM conversations),
        c AS (SELECT *, CASE WHEN k <> lag(k) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS c FROM s),
        g AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM c),
        r AS (SELECT conv_id, g, k, CASE WHEN k = 'gpt' THEN string_agg(text, ' ' ORDER BY turn) ELSE repeat('<image>', CAST(count(*) AS INT)) END AS value FROM g WHERE k <> 'none' GROUP BY conv_id, g, k),
        l AS (SELECT conv_id, list({{'k': k, 'v': value}} ORDER BY g) AS t FROM r GROUP BY conv_id),
        a AS (SELECT conv_id, CASE WHEN t[1]['k'] <> 'gpt' THEN t WHEN len(t) > 2 THEN t[2:] ELSE list_reverse(t) END AS t FROM l),
        z AS (SELECT conv_id, CASE WHEN t[-1]['k'] = 'human' AND len(t) > 2 THEN t[:len(t) - 1] ELSE t END AS t FROM a)
        SELECT conv_id, unnest(range(len(t))) AS turn, unnest(list_transform(t, lambda x: x['k'])) AS "from", unnest(list_transform(t, lambda x: x['v'])) AS value FROM z""",
)
def win07_interleaved(spark, sf_dir):
    slots = table(spark, sf_dir, "conversations").withColumn("k", F.expr(_KIND)).select("conv_id", F.col("turn").alias("slot"), F.expr("if(k = 'gpt', text, NULL)").alias("caption"), F.expr("if(k = 'human', 'x.jpg', NULL)").alias("image"))
    return S.interleaved_turns(slots, "conv_id", "slot", "caption", "image")


@query(
    "win08_dialogue_rounds",
    """WITH m AS (SELECT conv_id, turn AS pos, text, turn % 4 = 0 AS media FROM conversations),
        o AS (SELECT *, CASE WHEN media AND NOT coalesce(lag(media) OVER (PARTITION BY conv_id ORDER BY pos), true) THEN 1 ELSE 0 END AS o FROM m),
        r AS (SELECT *, CAST(sum(o) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS turn FROM o),
        k AS (SELECT *, greatest(count(*) FILTER (WHERE NOT media) OVER (PARTITION BY conv_id, turn ORDER BY pos), 1) AS message FROM r)
        SELECT conv_id, turn, message, CASE WHEN message % 2 = 1 THEN 'human' ELSE 'gpt' END AS "from", string_agg(text, '|' ORDER BY pos) AS joined FROM k GROUP BY conv_id, turn, message""",
)
def win08_rounds(spark, sf_dir):
    flat = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")
    out = S.dialogue_rounds(flat, "conv_id", ["pos"], F.col("pos") % 4 == 0, "text")
    return out.select("conv_id", "turn", "message", "from", F.array_join("values", "|").alias("joined"))


@query("win09_sample_lengths", "SELECT l_orderkey, sample, CAST(len AS BIGINT) AS length FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS sample, l_quantity AS len FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))")
def win09(spark, sf_dir):
    """Position ids of packed samples (a sample of l_quantity tokens for each line), and back."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("int").alias("n"))
    ids = rows.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "pos")
    return S.sample_lengths(ids.withColumn("at", F.row_number().over(w)), "l_orderkey", ["at"], "pos")


@query("win10_cosine_anneal", "SELECT event_id, round(CASE WHEN event_id % 200 < 20 THEN 1.0 * (event_id % 200) / 20.0 ELSE 0.1 + (1.0 - 0.1) * 0.5 * (1 + cos(least((event_id % 200 - 20) / 80.0, 1.0) * 3.141592653589793)) END, 6) AS w FROM events")
def win10(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(S.cosine_anneal(F.col("event_id") % 200, 100, 1.0, 0.1, 20), 6).alias("w"))


@query("win11_running_id", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS id FROM benchmark")
def win11(spark, sf_dir):
    from ..operators.convert import numbered

    return numbered(table(spark, sf_dir, "benchmark").select("item_id"), "id", "item_id")


@query(
    "win12_shifted_bounds",
    """WITH v AS (SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_linenumber AS low, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS high, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
       SELECT l_orderkey, i, CAST(low + i AS BIGINT) AS low, CAST(high + i + 1 AS BIGINT) AS high FROM v""",
)
def win12(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n = F.sum("l_linenumber").over(w)
    i = (F.row_number().over(w) - 1).cast("long")
    return v.select("l_orderkey", i.alias("i"), (n - F.col("l_linenumber") + i).alias("low"), (n + i + 1).alias("high"))


_P = f"({inputs.PREDICTIONS})"
_LETTER_OF = "regexp_extract(answer, '^\\(([A-Z])\\)', 1)"


@query(
    "agg01_accuracy_by_duration",
    f"""SELECT coalesce(duration, 'overall') AS duration, count(*) AS n, count(*) FILTER (WHERE upper(pred) = upper({_LETTER_OF})) AS n_right, round(count(*) FILTER (WHERE upper(pred) = upper({_LETTER_OF})) / count(*), 6) AS accuracy
        FROM {_P} GROUP BY GROUPING SETS ((), (duration))""",
)
def agg01(spark, sf_dir):
    p = inputs.predictions(spark, sf_dir)
    out = E.accuracy_by(p, "duration", E.same_letter(F.col("pred"), E.bare_answer(F.col("answer"))))
    return out.withColumn("accuracy", F.round("accuracy", 6))


from .text_queries import _STRIP  # noqa: E402

_L = f"regexp_extract({_STRIP}, '[A-J]', 0)"


@query(
    "agg02_accuracy_by_task",
    f"""SELECT coalesce(task_type, 'overall') AS task_type, count(*) AS n, count(*) FILTER (WHERE {_L} = {_LETTER_OF}) AS n_right, round(count(*) FILTER (WHERE {_L} = {_LETTER_OF}) / count(*), 6) AS accuracy
        FROM {_P} WHERE {_L} <> '' GROUP BY GROUPING SETS ((), (task_type))""",
)
def agg02(spark, sf_dir):
    from ..functions.text import option_letter

    p = inputs.predictions(spark, sf_dir).withColumn("letter", option_letter(F.col("pred")))
    out = E.accuracy_by(p, "task_type", F.col("letter") == E.bare_answer(F.col("answer")), F.col("letter") != "")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("agg03_overall_accuracy", f"SELECT count(*) AS n, count(*) FILTER (WHERE {_L} = {_LETTER_OF}) AS n_right FROM {_P}")
def agg03(spark, sf_dir):
    from ..functions.text import option_letter

    right = option_letter(F.col("pred")) == E.bare_answer(F.col("answer"))
    return inputs.predictions(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))


_JUDGE = ("CASE WHEN doc_id % 5 = 0 THEN 'Yes, and no' WHEN doc_id % 5 < 3 THEN 'no' ELSE '' END AS pred", "doc_id % 6 + 0.5 AS score")


@query(
    "agg04_judge_summary",
    f"""SELECT source, round(avg(trunc(score)), 6) AS mean_score, count(*) FILTER (WHERE lower(pred) LIKE '%yes%') AS n_yes, count(*) FILTER (WHERE lower(pred) LIKE '%no%' AND lower(pred) NOT LIKE '%yes%') AS n_no,
        round(count(*) FILTER (WHERE lower(pred) LIKE '%yes%') / nullif(count(*) FILTER (WHERE lower(pred) LIKE '%yes%' OR lower(pred) LIKE '%no%'), 0), 6) AS accuracy FROM (SELECT source, {', '.join(_JUDGE)} FROM documents) GROUP BY source""",
)
def agg04(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("source", *_JUDGE)
    out = E.judge_summary(rows, "pred", "score", "source")
    return out.withColumns({"mean_score": F.round("mean_score", 6), "accuracy": F.round("accuracy", 6)})


@query("agg05_mean_score", "SELECT source, round(avg(doc_id % 6), 6) AS mean_score FROM documents GROUP BY source")
def agg05(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg(F.col("doc_id") % 6), 6).alias("mean_score"))


@query(
    "agg06_frames_per_video",
    """SELECT name, n_frames FROM (SELECT source || '/' || doc_id // 4 AS name, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS n_frames, row_number() OVER (PARTITION BY source || '/' || doc_id // 4 ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1""",
)
def agg06(spark, sf_dir):
    """Frames (here lines) of each name; of rows with one name the last one counts."""
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 4).cast("string")).alias("name"), F.filter(F.split("text", "\n", -1), lambda x: x != "").alias("frames"), "doc_id")
    return E.frames_per_video(rows, "name", "frames", "doc_id")


@query("agg07_batch_threshold", "SELECT round(avg(s), 6) AS mean_length, round(avg(s) + 1000, 6) AS threshold FROM (SELECT sum(n_chars) AS s FROM documents GROUP BY doc_id // 16)")
def agg07(spark, sf_dir):
    batches = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 16)).agg(F.sum("n_chars").alias("s"))
    return batches.agg(F.round(F.avg("s"), 6).alias("mean_length"), F.round(F.avg("s") + 1000, 6).alias("threshold"))


_E = "(SELECT vec_id, label, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _tokens(spark, sf_dir):
    """embeddings as frames (rows) of 64 tokens."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))


@query("agg08_token_mean", f"SELECT vec_id, round(avg(v), 6) AS mean FROM {_E} GROUP BY vec_id")
def agg08(spark, sf_dir):
    e = F.col("embedding")
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total / F.size(e), 6).alias("mean"))


@query("agg09_boundary_mean", f"SELECT label, k, round(sum(v * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1), 6) AS mean FROM {_E} GROUP BY label, k")
def agg09(spark, sf_dir):
    w = F.col("vec_id") % 5 + 1
    return _tokens(spark, sf_dir).groupBy("label", F.col("k").cast("long").alias("k")).agg(F.round(F.sum(F.col("v") * w) / F.sum(w), 6).alias("mean"))


@query("agg10_spatial_pool", f"SELECT vec_id, k // 8 // 2 AS row, k % 8 // 2 AS col, round(avg(v), 6) AS mean, round(max(v), 6) AS most FROM {_E} GROUP BY ALL")
def agg10(spark, sf_dir):
    row, col = F.floor(F.floor(F.col("k") / 8) / 2), F.floor(F.col("k") % 8 / 2)
    return _tokens(spark, sf_dir).groupBy("vec_id", row.alias("row"), col.alias("col")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"))


@query("agg11_pool_nine", f"SELECT vec_id, k // 9 AS part, round(avg(v), 6) AS mean FROM {_E} WHERE k < 63 GROUP BY ALL")
def agg11(spark, sf_dir):
    e = F.col("embedding")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(e) / 9).cast("int") - 1), lambda p: F.aggregate(F.slice(e, p * 9 + 1, F.lit(9)), F.lit(0.0), lambda acc, x: acc + x.cast("double")) / 9)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(parts).alias("part", "m")).select("vec_id", F.col("part").cast("long").alias("part"), F.round("m", 6).alias("mean"))


@query("agg12_active_share", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS n_active, round(sum(l_linenumber) * 8 / sum(sum(l_linenumber)) OVER (), 6) AS share FROM lineitem GROUP BY l_returnflag")
def agg12(spark, sf_dir):
    return E.active_share(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", 8).withColumn("share", F.round("share", 6))


@query(
    "agg13_online_softmax",
    f"""SELECT label, round(sum(exp(v - m) * k) / sum(exp(v - m)), 6) AS out, round(max(m) + ln(sum(exp(v - m))), 6) AS lse FROM (SELECT *, max(v) OVER (PARTITION BY label) AS m FROM {_E}) GROUP BY label""",
)
def agg13(spark, sf_dir):
    out = S.online_softmax(_tokens(spark, sf_dir), ["label"], "v", "k")
    return out.select("label", F.round("out", 6).alias("out"), F.round("lse", 6).alias("lse"))


@query("agg14_mean_norm", f"SELECT label, round(avg(n), 6) AS mean_norm FROM (SELECT vec_id, label, sqrt(sum(v * v)) AS n FROM {_E} GROUP BY vec_id, label) GROUP BY label")
def agg14(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(norm), 6).alias("mean_norm"))


@query("agg15_batch_max", "SELECT doc_id // 32 AS batch, max(n_chars) AS longest FROM documents GROUP BY ALL")
def agg15(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 32).alias("batch")).agg(F.max("n_chars").alias("longest"))


_LINES = "(SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("n"))


@query("agg16_cumulative_lengths", f"SELECT l_orderkey, '0,' || string_agg(CAST(c AS VARCHAR), ',' ORDER BY l_linenumber) AS bounds FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS c FROM {_LINES}) GROUP BY l_orderkey")
def agg16(spark, sf_dir):
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n"))).alias("s"))
    bounds = F.aggregate("s", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["n"])))
    return rows.select("l_orderkey", F.array_join(bounds, ",").alias("bounds"))


@query("agg17_collect", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey")
def agg17(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("l_linenumber")), ",").alias("lines"))


@query("agg18_exclusive_prefix", f"SELECT l_orderkey, l_linenumber, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - n AS BIGINT) AS start, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS stop FROM {_LINES}")
def agg18(spark, sf_dir):
    end = F.sum("n").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (end - F.col("n")).alias("start"), end.alias("stop"))
