"""FRM, SPC and TOK: frames, geometry and token sequences."""

from __future__ import annotations

import re
from hashlib import md5

from pyspark.sql import functions as F

from ..functions import frames as FR
from ..functions import labels as L
from ..functions import spatial as SP
from ..functions import tokens as TK
from ..functions.chat import TEMPLATES, render
from ..registry import query, table

_RATE = "[24.0, 25.0, 29.97, 30.0][p_partkey % 4 + 1]"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("rate", F.expr("element_at(array(24.0D, 25.0D, 29.97D, 30.0D), cast(p_partkey % 4 + 1 as int))"))


@query("frm01_timestamps", f"SELECT p_partkey, array_to_string(list_transform([10, 77, 150], lambda i: CAST(round_even(i / CAST({_RATE} AS DOUBLE), 1) AS VARCHAR)), ',') AS ts FROM part")
def frm01(spark, sf_dir):
    t = FR.timestamps(F.array(F.lit(10), F.lit(77), F.lit(150)), F.col("rate"))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(t, lambda x: x.cast("string")), ",").alias("ts"))


@query(
    "frm02_frame_grid",
    f"""SELECT p_partkey, array_to_string(flatten(list_transform(range(0, p_size * 20, CAST(round_even(r, 0) AS BIGINT)), lambda i: list_transform(range(2), lambda k: CAST(floor(i + k * r / 2.0 + r / 2.0 / 2) AS BIGINT)))), ',') AS idx
        FROM (SELECT *, CAST({_RATE} AS DOUBLE) AS r FROM part)""",
)
def frm02(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(FR.frame_grid(F.col("rate"), F.col("p_size") * 20, 2.0), ",").alias("idx"))


@query("frm03_pick_timestamps", "SELECT p_partkey, array_to_string(list_transform(list_filter(range(p_size), lambda i: i % 3 = 0), lambda i: i * 2), ',') AS ts FROM part")
def frm03(spark, sf_dir):
    ts = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: i * 2)
    idx = F.filter(F.sequence(F.lit(0).cast("long"), F.col("p_size").cast("long") - 1), lambda i: i % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(FR.pick(ts, idx), ",").alias("ts"))


@query("frm04_default_timestamps", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(6), lambda i: CAST(floor(i * (p_size / 6.0) + p_size / 6.0 / 2) AS BIGINT)))), ',') AS ts FROM part")
def frm04(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(FR.default_timestamps(F.lit(3.0), F.col("p_size") + 3.0, F.lit(6)), ",").alias("ts"))


@query(
    "frm05_bounded_indices",
    """SELECT p_partkey, array_to_string(list_transform(range(8), lambda i: CAST(floor(lo + (hi - lo) / 8.0 / 2 + round_even((hi - lo) / 8.0 * i, 0)) AS BIGINT)), ',') AS idx
       FROM (SELECT p_partkey, CAST(greatest(1, round_even(p_size % 5 * 3.0, 0)) AS INT) AS lo, CAST(least(round_even((p_size + 5) * 3.0, 0), p_size * 3 + 10) AS INT) AS hi FROM part)""",
)
def frm05(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(FR.bounded_indices(s * 3 + 10, 8, F.lit(3.0), (s % 5).cast("double"), (s + 5).cast("double")), ",").alias("idx"))


@query("frm06_resample_rate", "SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN 2 ELSE 1 END AS fps FROM part")
def frm06(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", FR.resample_rate(F.col("p_size") % 4, F.lit(1)).alias("fps"))


@query("frm07_timecode", "SELECT p_partkey, CAST(p_size % 3 * 3600.0 + p_size % 60 * 60.0 + p_size * 0.5 AS DOUBLE) AS seconds FROM part")
def frm07(spark, sf_dir):
    code = F.format_string("%d:%d:%.3f", F.col("p_size") % 3, F.col("p_size") % 60, F.col("p_size") * 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", FR.timecode_seconds(code).alias("seconds"))


_WH = "(SELECT p_partkey, CAST(p_size * 40 + 10 AS BIGINT) AS w, CAST(p_partkey % 37 * 50 + 15 AS BIGINT) AS h FROM part)"


def _images(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 10).cast("long").alias("w"), (F.col("p_partkey") % 37 * 50 + 15).cast("long").alias("h"))


def _geometry(name, make, sql):
    def run(spark, sf_dir):
        return _images(spark, sf_dir).select("p_partkey", make().alias("g")).select("p_partkey", "g.*")

    query(name, sql)(run)


W, H = "w", "h"
_geometry("spc02_patch_grid", lambda: SP.patch_grid(F.col(W), F.col(H), 336), f"SELECT p_partkey, CAST(ceil(w / 336) AS BIGINT) AS columns, CAST(ceil(h / 336) AS BIGINT) AS rows FROM {_WH}")
_geometry(
    "spc05_letterbox",
    lambda: SP.letterbox(F.col(W), F.col(H), F.lit(672), F.lit(336)),
    f"""SELECT p_partkey, nw AS new_width, nh AS new_height, (672 - nw) // 2 AS paste_x, (336 - nh) // 2 AS paste_y FROM (
        SELECT p_partkey, CAST(CASE WHEN 672 / w < 336 / h THEN 672 ELSE least(ceil(w * (336 / h)), 672) END AS BIGINT) AS nw, CAST(CASE WHEN 672 / w < 336 / h THEN least(ceil(h * (672 / w)), 336) ELSE 336 END AS BIGINT) AS nh FROM {_WH})""",
)
_geometry(
    "spc06_centre_crop",
    lambda: SP.centre_crop(F.col(W), F.col(H), 336),
    f"""SELECT p_partkey, nw AS new_width, nh AS new_height, (nw - 336) / 2 AS left, (nh - 336) / 2 AS top FROM (
        SELECT p_partkey, CAST(CASE WHEN w / h > 1 THEN floor(336 * (w / h)) ELSE 336 END AS BIGINT) AS nw, CAST(CASE WHEN w / h > 1 THEN 336 ELSE floor(336 / (w / h)) END AS BIGINT) AS nh FROM {_WH})""",
)
_geometry("spc07_square", lambda: SP.square(F.col(W), F.col(H)), f"SELECT p_partkey, greatest(w, h) AS side, (greatest(w, h) - w) // 2 AS paste_x, (greatest(w, h) - h) // 2 AS paste_y FROM {_WH}")
_geometry(
    "spc08_unpad",
    lambda: SP.unpad(F.lit(24), F.lit(24), F.col(W), F.col(H)),
    f"""SELECT p_partkey, CASE WHEN w / h > 1 THEN CAST(24 - floor(h * (24 / w)) AS BIGINT) // 2 ELSE 0 END AS cut_rows, CASE WHEN w / h > 1 THEN 0 ELSE CAST(24 - floor(w * (24 / h)) AS BIGINT) // 2 END AS cut_columns FROM {_WH}""",
)
_geometry(
    "spc14_display_size",
    lambda: SP.display_size(F.col(W), F.col(H)),
    f"""SELECT p_partkey, CASE WHEN w > h THEN l ELSE s END AS new_width, CASE WHEN w > h THEN s ELSE l END AS new_height FROM (
        SELECT *, CAST(floor(s * (greatest(w, h) / least(w, h))) AS BIGINT) AS l FROM (SELECT *, CAST(floor(least(800 / (greatest(w, h) / least(w, h)), 400, least(w, h))) AS BIGINT) AS s FROM {_WH}))""",
)


def _boxes(make):
    def run(spark, sf_dir):
        return _images(spark, sf_dir).select("p_partkey", F.inline(make(F.col("w"), F.col("h"))))

    return run


_SLIDE = "range(0, CASE WHEN {0} >= 336 THEN ({0} - 336) // 168 + 1 ELSE 0 END)"
query(
    "spc03_sliding_patches",
    f"""SELECT p_partkey, x AS left, y AS top, x + 336 AS right, y + 336 AS bottom FROM (
        SELECT p_partkey, (w - (w - 336) // 168 * 168 - 336) // 2 + i * 168 AS x, (h - (h - 336) // 168 * 168 - 336) // 2 + j * 168 AS y
        FROM (SELECT *, unnest({_SLIDE.format('w')}) AS i FROM (SELECT *, unnest({_SLIDE.format('h')}) AS j FROM {_WH})))""",
)(_boxes(lambda w, h: SP.sliding_patches(w, h, 336, 0.5)))
query(
    "spc04_tiled_patches",
    f"SELECT p_partkey, x AS left, y AS top, x + 448 AS right, y + 448 AS bottom FROM (SELECT *, unnest(range(0, w, 448)) AS x FROM (SELECT *, unnest(range(0, h, 448)) AS y FROM {_WH}))",
)(_boxes(lambda w, h: SP.tiled_patches(w, h, 448)))


@query("spc01_effective_area", f"SELECT p_partkey, least(CAST(floor(w * least(672 / w, 336 / h)) AS BIGINT) * CAST(floor(h * least(672 / w, 336 / h)) AS BIGINT), w * h) AS area FROM {_WH}")
def spc01(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", SP.effective_area(F.col("w"), F.col("h"), F.lit(672), F.lit(336)).alias("area"))


@query("spc09_grid_side", "SELECT p_partkey, 1344 AS compat_side, CASE WHEN p_size * 30 <= 448 THEN 448 WHEN p_size * 30 <= 896 THEN 896 ELSE 1344 END AS fit_side FROM part")
def spc09(spark, sf_dir):
    sides = F.array(F.lit(448), F.lit(896), F.lit(1344))
    return table(spark, sf_dir, "part").select("p_partkey", SP.grid_side(sides).alias("compat_side"), SP.grid_side(sides, False, F.col("p_size") * 30).alias("fit_side"))


@query("spc10_aspect_mode", f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN greatest(w, h) WHEN 1 THEN CAST(ceil(w / 336) * ceil(h / 336) AS BIGINT) ELSE 336 END AS size FROM {_WH}")
def spc10(spark, sf_dir):
    grid = SP.patch_grid(F.col("w"), F.col("h"), 336)
    mode = F.col("p_partkey") % 3
    size = F.when(mode == 0, SP.square(F.col("w"), F.col("h"))["side"]).when(mode == 1, grid["columns"] * grid["rows"]).otherwise(F.lit(336).cast("long"))
    return _images(spark, sf_dir).select("p_partkey", size.alias("size"))


_NEAR = "CAST(embedding[CAST({r} * 8 + {c} + 1 AS INT)] AS DOUBLE)"


@query(
    "spc11_bilinear_resample",
    f"""SELECT vec_id, p, round({_NEAR.format(r='y0', c='x0')} * 0.25 + {_NEAR.format(r='y0', c='(x0 + 1)')} * 0.25 + {_NEAR.format(r='(y0 + 1)', c='x0')} * 0.25 + {_NEAR.format(r='(y0 + 1)', c='(x0 + 1)')} * 0.25, 6) AS v
        FROM (SELECT *, p // 4 * 2 AS y0, p % 4 * 2 AS x0 FROM (SELECT vec_id, embedding, unnest(range(16)) AS p FROM embeddings))""",
)
def spc11(spark, sf_dir):
    """8 x 8 token grids resampled to 4 x 4: each new point from its four neighbours."""
    v = lambda r, c: F.element_at("embedding", (r * 8 + c + 1).cast("int")).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    y, x = (F.floor(F.col("p") / 4) + 0.5) * 2 - 0.5, (F.col("p") % 4 + 0.5) * 2 - 0.5
    y0, x0 = F.floor(y), F.floor(x)
    dy, dx = y - y0, x - x0
    out = v(y0, x0) * (1 - dy) * (1 - dx) + v(y0, x0 + 1) * (1 - dy) * dx + v(y0 + 1, x0) * dy * (1 - dx) + v(y0 + 1, x0 + 1) * dy * dx
    return rows.select("vec_id", F.col("p").cast("long").alias("p"), F.round(out, 6).alias("v"))


@query(
    "spc12_position_code",
    """SELECT t, y, x, d, round(CASE WHEN d < 2 THEN sin(t * pow(10000.0, -(d / 2.0))) WHEN d < 4 THEN cos(t * pow(10000.0, -((d - 2) / 2.0))) WHEN d < 7 THEN sin(y * pow(10000.0, -((d - 4) / 3.0))) WHEN d < 10 THEN cos(y * pow(10000.0, -((d - 7) / 3.0)))
        WHEN d < 13 THEN sin(x * pow(10000.0, -((d - 10) / 3.0))) ELSE cos(x * pow(10000.0, -((d - 13) / 3.0))) END, 6) AS v FROM range(3) a(t), range(4) b(y), range(5) c(x), range(16) e(d)""",
)
def spc12(spark, sf_dir):
    at = spark.range(60).select((F.col("id") % 3).alias("t"), (F.floor(F.col("id") / 3) % 4).alias("y"), F.floor(F.col("id") / 12).alias("x"))
    code = SP.position_code(F.col("t"), F.col("y"), F.col("x"), 16)
    return at.select("t", "y", "x", F.posexplode(code).alias("d", "v")).select("t", "y", "x", F.col("d").cast("long").alias("d"), F.round("v", 6).alias("v"))


@query("spc13_normalise", "SELECT vec_id, len(embedding) * 3 AS n, round((CAST(embedding[1] AS DOUBLE) - 0.5) / 0.25, 6) AS first, round((CAST(embedding[64] AS DOUBLE) - 0.5) / 0.25, 6) AS last FROM embeddings")
def spc13(spark, sf_dir):
    p = SP.three_channels(SP.normalise(F.transform("embedding", lambda x: x.cast("double")), 0.5, 0.25))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(p).cast("long").alias("n"), F.round(p[0], 6).alias("first"), F.round(F.element_at(p, -1), 6).alias("last"))


# Tokens: a word's length stands for its id, so that the oracle can tokenise too.
_TOK = "list_transform(regexp_extract_all({0}, '<\\|[a-z_]+\\|>|\\n| ?[A-Za-z0-9]+| |[^A-Za-z0-9 \\n]'), lambda w: CAST(CAST('0x' || md5(w)[1:7] AS BIGINT) % 30000 + 1 AS BIGINT))"
_MERGED = f"[1] || {_TOK.format(repr('one '))} || [-200] || {_TOK.format("' ' || text || ' '")} || [-200]"


@query("tok01_image_ids", f"SELECT conv_id, turn, array_to_string({_MERGED}, ',') AS ids FROM conversations")
def tok01(spark, sf_dir):
    text = F.concat(F.lit("one <image> "), "text", F.lit(" <image>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(TK.with_image_ids(text, bos=1), ",").alias("ids"))


@query("tok02_expand_images", "SELECT conv_id, turn, 'one <s>' || repeat('<image>', CAST(turn % 3 + 1 AS INT)) || '</s> ' || trim(text) || ' <image>' AS text FROM conversations")
def tok02(spark, sf_dir):
    text = F.concat(F.lit(" one <image> "), F.trim("text"), F.lit(" <image>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", TK.expand_images(text, F.array(F.col("turn") % 3 + 1), start="<s>", end="</s>").alias("text"))


@query(
    "tok02_expand_dialogue",
    """SELECT conv_id, string_agg(text || CASE WHEN turn % 2 = 0 THEN ' ' || CASE WHEN turn // 2 < 2 THEN repeat('<image>', CAST(turn // 2 + 2 AS INT)) ELSE '<image>' END ELSE '' END, '|' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id""",
)
def tok02_dialogue(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("value", F.expr("if(turn % 2 = 0, concat(text, ' <image>'), text)"))
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), "value"))).alias("t"))
    out = TK.expand_dialogue(F.col("t"), F.array(F.lit(2), F.lit(3)))
    return turns.select("conv_id", F.array_join(F.transform(out, lambda x: x["value"]), "|").alias("joined"))


@query("tok03_expand_video", "SELECT conv_id, turn, '<v><image>0.0<image>' || CAST(turn AS VARCHAR) || '.5<image></v>' || chr(10) || rtrim(text) AS text FROM conversations")
def tok03(spark, sf_dir):
    labels = F.array(F.lit(0.0).cast("double"), F.col("turn") + F.lit(0.5).cast("double"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", TK.expand_video(F.concat(F.lit("<image>\n"), "text"), labels, thumbnail=True, start="<v>", end="</v>").alias("text"))


_IDS = _TOK


def _alternating(spark, sf_dir):
    """Dialogues without their system turns in which user and assistant take turns. In every fifth a text holds a separator."""
    said = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("value", F.expr("if(conv_id % 5 = 0 AND turn = 2, concat(text, '<|im_end|>\\n<|eot_id|>'), text)"))
    role = F.expr("CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END")
    turns = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("from"), "value"))).alias("t"))
    turns = turns.select("conv_id", L.answerable(F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value")))).alias("turns"))
    return turns.where(L.alternating(F.col("turns")) & (F.size("turns") > 0))


_TURNS = """WITH t0 AS (SELECT conv_id, role = 'user' AS asks, CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN text || '<|im_end|>' || chr(10) || '<|eot_id|>' ELSE text END AS value, conv_id % 5 = 0 AND turn = 2 AS odd,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' AS cut FROM conversations WHERE role <> 'system'),
        t1 AS (SELECT conv_id, asks, value, odd, i - CAST(cut AS INT) AS i FROM t0 WHERE NOT (cut AND i = 1)),
        t2 AS (SELECT *, bool_and(asks = (i % 2 = 1)) OVER (PARTITION BY conv_id) AS good, count(*) OVER (PARTITION BY conv_id) % 2 = 0 AND NOT bool_or(odd) OVER (PARTITION BY conv_id) AS fits FROM t1),
        t AS (SELECT * FROM t2 WHERE good)"""
_LISTED = "array_to_string({0}, ',')"


def _labels_sql(heads: tuple[str, str], end: str, bos: str = "[]") -> str:
    """A round's head and question are ignored, its answer and what follows learned."""
    return f"""{_TURNS},
        p AS (SELECT conv_id, i, fits, {_IDS.format(f"CASE WHEN asks THEN {heads[0]} || value || {end} ELSE {heads[1]} END")} AS a, CASE WHEN asks THEN [] ELSE {_IDS.format(f"value || {end}")} END AS b FROM t),
        g AS (SELECT conv_id, {bos} || flatten(list(a || b ORDER BY i)) AS ids, list_transform({bos}, lambda x: -100) || flatten(list(list_transform(a, lambda x: -100) || CASE WHEN fits THEN b ELSE list_transform(b, lambda x: -100) END ORDER BY i)) AS labels FROM p GROUP BY conv_id)
        SELECT conv_id, {_LISTED.format("ids")} AS ids, {_LISTED.format("labels")} AS labels FROM g"""


_CHATML = ("'<|im_start|>user' || chr(10)", "'<|im_start|>assistant' || chr(10)")
_HEADERS = tuple(f"'<|start_header_id|>{r}<|end_header_id|>' || chr(10) || chr(10)" for r in ("user", "system"))


def _listed(df):
    return df.select("conv_id", F.array_join("ids", ",").alias("ids"), F.array_join("labels", ",").alias("labels"))


@query("tok04_round_labels", _labels_sql(_CHATML, "'<|im_end|>' || chr(10)"))
def tok04(spark, sf_dir):
    return _listed(_alternating(spark, sf_dir).select("conv_id", L.round_labels(F.col("turns"), TEMPLATES["qwen2"]).alias("x")).select("conv_id", "x.*"))


@query("tok05_header_labels", _labels_sql(_HEADERS, "'<|eot_id|>'", "[1]"))
def tok05(spark, sf_dir):
    return _listed(_alternating(spark, sf_dir).select("conv_id", L.header_labels(F.col("turns"), TEMPLATES["llama_3_chat"]).alias("x")).select("conv_id", "x.*"))


@query(
    "tok06_role_labels",
    f"""{_TURNS},
        p AS (SELECT conv_id, i, asks, {_IDS.format("'### ' || CASE WHEN asks THEN 'Human' ELSE 'Assistant' END || ': ' || value || chr(10)")} AS a FROM t),
        g AS (SELECT conv_id, flatten(list(a ORDER BY i)) AS ids, flatten(list(CASE WHEN asks THEN list_transform(a, lambda x, k: CASE WHEN k <= 2 THEN x ELSE -100 END) ELSE a END ORDER BY i)) AS labels FROM p GROUP BY conv_id),
        w AS (SELECT conv_id, ids, labels, {_IDS.format("'A chat.' || chr(10) || chr(10)")} AS h, {_IDS.format("'### '")} AS e FROM g)
        SELECT conv_id, {_LISTED.format("h || ids || e")} AS ids, {_LISTED.format("list_transform(h, lambda x: -100) || labels || e")} AS labels FROM w""",
)
def tok06(spark, sf_dir):
    return _listed(_alternating(spark, sf_dir).select("conv_id", L.role_labels(F.col("turns"), "A chat.", ("Human", "Assistant")).alias("x")).select("conv_id", "x.*"))


def _piece_offsets(text):
    """A tokenizer that gives offsets, with the ids of piece_ids."""
    found = [(m[0], m.start(), m.end()) for m in re.finditer(TK.PIECES, text)]
    return [int(md5(w.encode()).hexdigest()[:7], 16) % 30_000 + 1 for w, _, _ in found], [s for _, s, _ in found], [e for _, _, e in found]


@query("tok04_offset_labels", _labels_sql(_CHATML, "'<|im_end|>' || chr(10)").replace("% 2 = 0 AND NOT bool_or(odd) OVER (PARTITION BY conv_id) AS fits", "> 0 AS fits"))
def tok04_offsets(spark, sf_dir):
    """The same labels by spans of characters: every answer is learned, also in dialogues that end with a question or whose texts hold a separator."""
    rows = _alternating(spark, sf_dir).select("conv_id", render(TEMPLATES["qwen2"], F.col("turns"), system="").alias("text"), L.answer_spans(F.col("turns"), TEMPLATES["qwen2"]).alias("spans"))
    return _listed(L.offset_labels(rows, "conv_id", "text", "spans", _piece_offsets))


_SEQ = "(SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type = 'click' AS img FROM events)"


@query(
    "tok07_merge_placeholders",
    f"""WITH o AS (SELECT *, count(*) FILTER (WHERE img) OVER (PARTITION BY user_id ORDER BY i) - 1 AS g FROM {_SEQ}),
        k AS (SELECT *, CASE WHEN img THEN g // 3 ELSE greatest(g, 0) // 3 END AS cube FROM o),
        m AS (SELECT *, (img AND g % 3 = 0) OR (NOT img AND (g = -1 OR g % 3 = 2)) AS kept FROM k)
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS position FROM m WHERE kept""",
)
def tok07(spark, sf_dir):
    from ..operators.tokens import merge_placeholders

    seq = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "click").alias("img"))
    return merge_placeholders(seq, "user_id", ["ts", "event_id"], F.col("img"), 3).select("user_id", "event_id", "position")


def _id_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    return rows.withColumn("ids", F.transform("ids", lambda x: F.when(x % 3 == 0, -200).otherwise(x)))


_IDROWS = "(SELECT l_orderkey, list(CASE WHEN l_linenumber % 3 = 0 THEN -200 ELSE l_linenumber END ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey)"


@query("tok08_expand_slots", f"SELECT l_orderkey, array_to_string(flatten(list_transform(ids, lambda x: CASE WHEN x = -200 THEN [-100, -100] ELSE [x] END)), ',') AS labels FROM {_IDROWS}")
def tok08(spark, sf_dir):
    return _id_rows(spark, sf_dir).select("l_orderkey", F.array_join(TK.expand_slots(F.col("ids"), 2, TK.IGNORE), ",").alias("labels"))


@query("tok09_pad_and_mask", f"SELECT l_orderkey, array_to_string(list_concat(list_transform(range(greatest(9 - len(ids), 0)), lambda x: 0), ids), ',') AS left_padded, len(list_filter(ids, lambda x: x <> 0)) AS n_attended FROM {_IDROWS}")
def tok09(spark, sf_dir):
    p = TK.padded(F.col("ids"), 9, 0, left=True)
    n = F.size(F.filter(TK.attention(p, 0), lambda x: x)).cast("long")
    return _id_rows(spark, sf_dir).select("l_orderkey", F.array_join(p, ",").alias("left_padded"), n.alias("n_attended"))


@query("tok11_enough_tags", "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '<image> ' || text ELSE repeat('<image>', CAST(turn % 3 AS INT)) || chr(10) || '<image> ' || text END AS text FROM conversations")
def tok11(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", TK.with_enough_tags(F.concat(F.lit("<image> "), "text"), F.col("turn") % 3).alias("text"))


@query("tok12_video_tag", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<image> ' || text ELSE '<image>' || chr(10) || text END AS text FROM conversations")
def tok12(spark, sf_dir):
    text = F.expr("if(turn % 2 = 0, concat('<video> ', text), text)")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", TK.video_tag_as_image(text).alias("text"))


@query("tok13_dummy_image", f"SELECT l_orderkey, array_to_string(CASE WHEN list_contains(ids, -200) THEN ids ELSE list_append(ids, -200) END, ',') AS ids FROM {_IDROWS}")
def tok13(spark, sf_dir):
    return _id_rows(spark, sf_dir).select("l_orderkey", F.array_join(TK.with_dummy_image(F.col("ids")), ",").alias("ids"))
