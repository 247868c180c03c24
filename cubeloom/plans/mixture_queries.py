"""MIX, SMP, LEN, SRT, LIM, PCK, BKT and PAR: assembling, batching, packing and sharding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import frames as FR
from ..functions import text as T
from ..functions import tokens as TK
from ..operators import mixture as M
from ..operators import packing as P
from ..operators import partition as PA
from ..operators.convert import hash_choice, numbered
from ..registry import query, table
from .inputs import choice_sql

_DOCS = "(SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)"


def _numbered_docs(spark, sf_dir, *columns):
    d = table(spark, sf_dir, "documents").select("doc_id", *columns)
    return numbered(d, "i", "doc_id"), d.count()


@query(
    "mix01_repeat_slice",
    f"SELECT doc_id, r * n + i AS position FROM {_DOCS}, range(3) t(r) WHERE r * n + i >= n // 2 AND r * n + i < 2 * n + n // 3",
)
def mix01(spark, sf_dir):
    """A slice from the middle of the first repeat to a third of the last."""
    d, n = _numbered_docs(spark, sf_dir)
    (s,) = M.parse_mixture(f"documents.jsonl#{n // 2}_{2 * n + n // 3}*3")
    return M.repeated_slice(d, "i", n, s).select("doc_id", F.col("position").cast("long").alias("position"))


@query(
    "mix01_spec_grammar",
    """SELECT * FROM (VALUES ('data/image_sft.jsonl', 0, 100, 2), ('data/video_sft.jsonl', 0, 100, 2), ('extra.jsonl', 0, -1, 1), ('ego4d/a.jsonl', 0, -1, 3)) t(path, first, last, repeat)""",
)
def mix01_grammar(spark, sf_dir):
    spec = "data/{image,video}_sft.jsonl#0_100*2;extra.jsonl;ego4d/a.jsonl*3"
    return spark.createDataFrame([(s.path, s.first, s.last, s.repeat) for s in M.parse_mixture(spec)], "path string, first int, last int, repeat int")


#: Paths of sources made of the documents' sources: image and video ones, letters as they are.
_PATH = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('stage/ego4d_1fps512frames_', source, '/part/rows.jsonl') WHEN 1 THEN concat('video_data/', source, '.jsonl') WHEN 2 THEN concat('tsv_data/', source, '.json') WHEN 3 THEN concat('Video_Data/', source, '.jsonl') ELSE concat('image/', source, '.jsonl') END"


@query(
    "mix02_routing",
    f"""WITH p AS (SELECT doc_id, {_PATH} AS path, CASE WHEN doc_id % 7 <> 0 THEN 'v_' || doc_id || '.mp4' END AS video FROM documents)
        SELECT doc_id, CASE WHEN contains(path, 'ego4d_1fps512frames_') OR contains(path, 'video_data') OR contains(path, 'tsv_data') THEN 'video' ELSE 'image' END AS side,
            CASE WHEN contains(path, 'ego4d_1fps512frames_') THEN string_split(path, '/')[-2] || '/' || video ELSE video END AS video FROM p""",
)
def mix02(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"), F.expr("if(doc_id % 7 <> 0, concat('v_', doc_id, '.mp4'), null)").alias("video"))
    return rows.select("doc_id", M.route(F.col("path")).alias("side"), M.routed_video(F.col("video"), F.col("path")).alias("video"))


def permuted_sql(rows: str, seed: int) -> str:
    """rows (a query with i and n, a number and its total) with position, the number's place in a shuffle."""
    mixed = "s[2] + k[1]"
    for multiplier, shift in zip(M.MULTIPLIERS, M.SHIFTS):
        mixed = f"((({mixed}) * {multiplier}) >> {shift} & 2147483647)"
    side = "CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT)"
    keys = ", ".join(f"[CAST({k} AS BIGINT), 0]" for k in M.round_keys(seed))
    out = lambda x: f"list_reduce([[{x} % {side}, {x} // {side}], {keys}], lambda s, k: [s[2], (s[1] + {mixed}) % {side}])"
    number = lambda x: f"list_sum(list_transform([{out(x)}], lambda s: s[2] * {side} + s[1]))"
    return f"""(WITH RECURSIVE _w AS (SELECT *, CAST({number("i")} AS BIGINT) AS _at FROM {rows} UNION ALL SELECT * EXCLUDE (_at), CAST({number("_at")} AS BIGINT) FROM _w WHERE _at >= n)
        SELECT * EXCLUDE (_at), _at AS position FROM _w WHERE _at < n)"""


_SIDES = "(SELECT doc_id AS id, CAST(doc_id % 3 <> 0 AS INT) AS side, row_number() OVER (PARTITION BY doc_id % 3 <> 0 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id % 3 <> 0) AS n FROM documents)"


@query(
    "mix03_interleave",
    f"""WITH u AS (SELECT id, side, n, position AS i FROM {permuted_sql(f"(SELECT * FROM {_SIDES} WHERE side = 0)", 71)} UNION ALL SELECT id, side, n, position FROM {permuted_sql(f"(SELECT * FROM {_SIDES} WHERE side = 1)", 72)}),
        k AS (SELECT min(n) AS m FROM u),
        p AS (SELECT u.*, CASE WHEN i < (n % m) * (n // m + 1) THEN i // (n // m + 1) ELSE n % m + (i - (n % m) * (n // m + 1)) // (n // m) END AS bucket FROM u, k)
        SELECT id, row_number() OVER (ORDER BY bucket, side, i) - 1 AS position FROM p""",
)
def mix03(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return M.shuffled_interleave(d.where("id % 3 = 0"), d.where("id % 3 <> 0"), "id", 71).select("id", "position")


@query("mix04_shuffle", f"SELECT doc_id, position FROM {permuted_sql(_DOCS, 7)}")
def mix04(spark, sf_dir):
    return M.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("mix04_shuffle_words", f"SELECT source, doc_id, position FROM {permuted_sql("(SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)", 9)}")
def mix04_words(spark, sf_dir):
    """A shuffle inside each source, by a key of letters."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("word"))
    return M.shuffled(d, "word", 9, by=("source",)).select("source", "doc_id", "position")


@query("smp01_uniform_sample", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(range(8), lambda i: CAST(floor(i * (n_chars / 8.0) + (n_chars / 8.0) / 2) AS BIGINT)))), ',') AS idx FROM documents WHERE n_chars > 0")
def smp01(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.array_join(FR.uniform_indices(F.col("n_chars"), 8), ",").alias("idx"))


_TEMPLATES = ["Describe the clip.", "What happens?", "Summarise the video.", "Tell the story."]


@query("smp02_template_choice", f"SELECT doc_id, {choice_sql(_TEMPLATES, 'doc_id', 1)} AS prompt FROM documents")
def smp02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hash_choice(_TEMPLATES, F.col("doc_id"), 1).alias("prompt"))


_W = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("len01_rough_length", f"SELECT doc_id, CAST({_W} * 1.5 + CASE WHEN doc_id % 3 = 0 THEN 64 + (doc_id % 420) * 0.5 * 64 WHEN doc_id % 3 = 1 THEN 256 ELSE 0 END + 42 AS DOUBLE) AS length FROM documents")
def len01(spark, sf_dir):
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", M.rough_length(F.lit("caption"), F.col("text"), k == 1, k == 0, F.col("doc_id") % 420).alias("length"))


@query("len02_frame_count", "SELECT doc_id, least(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 4 * 150 WHEN s = 'finevideo' THEN 420 WHEN s = 'activitynet' THEN 180 WHEN s = 'sharegpt4video' THEN 60 ELSE 30 END, 420) AS n FROM (SELECT doc_id, ['finevideo', 'activitynet', 'sharegpt4video', 'x'][doc_id // 4 % 4 + 1] AS s FROM documents)")
def len02(spark, sf_dir):
    s = F.expr("element_at(array('finevideo', 'activitynet', 'sharegpt4video', 'x'), cast(doc_id div 4 % 4 + 1 as int))")
    return table(spark, sf_dir, "documents").select("doc_id", M.frame_count(s, F.col("doc_id") % 4 * 150).alias("n"))


@query("len03_signed_length", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_W} ELSE -{_W} END AS length FROM documents")
def len03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.signed_length(T.word_count(F.col("text")), F.col("doc_id") % 2 == 0).alias("length"))


@query("srt01_packing_order", f"SELECT doc_id, row_number() OVER (ORDER BY n_chars + doc_id % 5 * 63 DESC, doc_id) - 1 AS position FROM documents")
def srt01(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (-P.packing_length(F.col("n_chars"), F.col("doc_id") % 5)).alias("neg"))
    return numbered(d, "position", "neg", "doc_id").select("doc_id", "position")


@query("srt02_megabatch_order", "SELECT doc_id, doc_id // 64 AS megabatch, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents")
def srt02(spark, sf_dir):
    m = F.floor(F.col("doc_id") / 64)
    w = Window.partitionBy("megabatch").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", m.alias("megabatch")).select("doc_id", "megabatch", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("lim01_slice", f"SELECT doc_id FROM {_DOCS} WHERE i >= 100 AND i < 150")
def lim01(spark, sf_dir):
    d, _ = _numbered_docs(spark, sf_dir)
    return d.where("i >= 100 AND i < 150").select("doc_id")


@query("lim02_truncate", "SELECT vec_id, len(embedding[1:10]) AS n, round(CAST(embedding[10] AS DOUBLE), 6) AS last FROM embeddings")
def lim02(spark, sf_dir):
    e = TK.truncated(F.col("embedding"), 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.round(F.element_at(e, -1).cast("double"), 6).alias("last"))


def _pack_sql(capacity: int) -> str:
    return f"""WITH RECURSIVE s AS MATERIALIZED (
            SELECT doc_id, doc_id // 64 AS grp, CASE WHEN n_chars + doc_id % 5 * 63 > {capacity} THEN 64 ELSE n_chars + doc_id % 5 * 63 END AS size,
                row_number() OVER (PARTITION BY doc_id // 64 ORDER BY n_chars + doc_id % 5 * 63 DESC, doc_id) AS r FROM documents),
        p AS (SELECT doc_id, grp, r, size, CAST(0 AS BIGINT) AS bin, CAST(0 AS BIGINT) AS start FROM s WHERE r = 1
            UNION ALL SELECT s.doc_id, s.grp, s.r, s.size, CASE WHEN p.start + p.size + s.size <= {capacity} THEN p.bin ELSE p.bin + 1 END, CASE WHEN p.start + p.size + s.size <= {capacity} THEN p.start + p.size ELSE 0 END
            FROM p JOIN s ON s.grp = p.grp AND s.r = p.r + 1)
        SELECT grp, doc_id, bin, start, size AS length FROM p"""


def _pack(capacity):
    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("grp"), P.packing_length(F.col("n_chars"), F.col("doc_id") % 5).alias("size"))
        return P.next_fit(d, "grp", "size", "doc_id", capacity)

    return run


query("pck01_next_fit_16k", _pack_sql(16_384))(_pack(16_384))
query("pck01_next_fit_32k", _pack_sql(32_768))(_pack(32_768))
query("pck03_repack_8k", _pack_sql(8_192))(_pack(8_192))


def _parallel(ring):
    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("grp"), F.col("n_chars").alias("tokens"), (F.col("doc_id") % 5).alias("images"), (F.col("doc_id") % 7 == 0).alias("is_video"))
        return P.pack_for_parallel(d, "grp", "doc_id", 4, 16_384, ring)

    return run


def _parallel_sql(multiple: int) -> str:
    """State by state: a row joins the open bin (fits), or closes it with d dummies (dropped if still short of 4 images)."""
    fits = "p.used + s.size <= 16384 AND NOT (p.video AND s.is_video) AND (p.images < 4 OR (p.images + s.images <= s.most AND p.used + s.size <= p.longest))"
    full = lambda t: f"({t}.images + (16384 - {t}.used + 63) // 64 >= 4)"
    filled = lambda t: f"{t}.used + 64 * greatest(4 - {t}.images, 0)"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, doc_id // 64 AS grp, n_chars + doc_id % 5 * 63 AS raw, doc_id % 5 AS images, doc_id % 7 = 0 AS is_video FROM documents),
        e AS (SELECT *, (raw + {multiple - 1}) // {multiple} * {multiple} AS size, max(images) OVER (PARTITION BY grp) AS most, coalesce(max(raw) FILTER (WHERE raw <= 16384) OVER (PARTITION BY grp), 0) AS longest FROM d),
        s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY raw DESC, doc_id) AS r FROM e WHERE size <= 16384),
        p AS (SELECT doc_id, grp, r, size, CAST(0 AS BIGINT) AS bin, CAST(0 AS BIGINT) AS start, images, size AS used, is_video AND images > 0 AS video, longest FROM s WHERE r = 1
            UNION ALL SELECT s.doc_id, s.grp, s.r, s.size, CASE WHEN {fits} THEN p.bin ELSE p.bin + 1 END, CASE WHEN {fits} THEN p.used ELSE 0 END,
                CASE WHEN {fits} THEN p.images ELSE 0 END + s.images, CASE WHEN {fits} THEN p.used ELSE 0 END + s.size, ({fits} AND p.video) OR (s.is_video AND s.images > 0),
                CASE WHEN {fits} OR NOT {full("p")} THEN p.longest ELSE greatest(p.longest, {filled("p")}) END
            FROM p JOIN s ON s.grp = p.grp AND s.r = p.r + 1),
        b AS (SELECT grp, bin, max(images) AS images, max(used) AS used FROM p GROUP BY grp, bin),
        k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY bin) - 1 AS number FROM b WHERE {full("b")}),
        x AS (SELECT grp, number, used, unnest(range(greatest(4 - images, 0))) AS i FROM k)
        SELECT p.grp, p.doc_id, k.number AS bin, p.start, p.size AS length FROM p JOIN k ON k.grp = p.grp AND k.bin = p.bin
        UNION ALL SELECT grp, NULL, number, used + 64 * i, 64 FROM x"""


query("pck02_parallel_packing", _parallel_sql(1))(_parallel(None))
query("pck02_parallel_packing_zigzag", _parallel_sql(8))(_parallel("zigzag"))


@query("pck04_divisible_padding", "SELECT doc_id, (8 - n_chars % 8) % 8 AS ring, (16 - n_chars % 16) % 16 AS zigzag FROM documents")
def pck04(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", TK.divisible_padding(n, 8).alias("ring"), TK.divisible_padding(n, 8, True).alias("zigzag"))


def _ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    return rows.withColumn("batch", F.floor(F.col("l_orderkey") / 32))


_IDS = "(SELECT l_orderkey, l_orderkey // 32 AS batch, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey)"


@query("pck05_pad_to_batch", f"SELECT l_orderkey, array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda x: -100)), ',') AS labels FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM {_IDS})")
def pck05(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    longest = ids.groupBy("batch").agg(F.max(F.size("ids")).alias("m"))
    return ids.join(longest, "batch").select("l_orderkey", F.array_join(TK.padded(F.col("ids"), F.col("m"), TK.IGNORE), ",").alias("labels"))


@query("pck06_restarting_positions", f"SELECT l_orderkey, array_to_string(flatten(list_transform(ids, lambda n: range(n))), ',') AS positions FROM {_IDS}")
def pck06(spark, sf_dir):
    return _ids(spark, sf_dir).select("l_orderkey", F.array_join(TK.restarting_positions(F.col("ids")), ",").alias("positions"))


@query(
    "pck07_balanced_batches",
    """WITH r AS (SELECT doc_id, doc_id // 256 AS grp, n_chars, (row_number() OVER (PARTITION BY doc_id // 256 ORDER BY doc_id) - 1) // 8 AS slot FROM documents),
        t AS (SELECT *, sum(n_chars) OVER (PARTITION BY grp) / (max(slot) OVER (PARTITION BY grp) + 1) + 1000 AS bound, sum(n_chars) OVER (PARTITION BY grp, slot) AS total,
            sum(n_chars) OVER (PARTITION BY grp, slot ORDER BY doc_id) - n_chars AS before FROM r)
        SELECT grp, doc_id, dense_rank() OVER (PARTITION BY grp ORDER BY slot, CASE WHEN total >= bound THEN floor(before / bound) ELSE 0 END) - 1 AS batch FROM t""",
)
def pck07(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 256).alias("grp"))
    return P.balanced_batches(d, "grp", "doc_id", "n_chars", 8)


_ZEROS = ", ".join(["0.0"] * 8)


def _dealt_sql(rows: str) -> str:
    """Greedy chunks: rows has modality, doc_id, len and g, the place in its modality's shuffle."""
    return f"""WITH RECURSIVE r AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY modality, megabatch ORDER BY len DESC, doc_id) - 1 AS place, count(*) OVER (PARTITION BY modality, megabatch) AS n FROM (SELECT *, g // 64 AS megabatch FROM {rows})),
        f AS (SELECT DISTINCT modality, megabatch, CAST(-1 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS chunk, CAST([{_ZEROS}] AS DOUBLE[]) AS loads, CAST([{_ZEROS}] AS DOUBLE[]) AS counts FROM r
            UNION ALL SELECT r.modality, r.megabatch, r.place, r.doc_id, CASE WHEN r.n % 8 = 0 THEN k - 1 ELSE r.place % 8 END,
                list_transform(loads, lambda x, i: CASE WHEN i <> k THEN x WHEN counts[k] + 1 >= r.n / 8 THEN CAST('infinity' AS DOUBLE) ELSE x + r.len END), list_transform(counts, lambda x, i: CASE WHEN i = k THEN x + 1 ELSE x END)
            FROM (SELECT *, CAST(list_position(loads, list_min(loads)) AS BIGINT) AS k FROM f) f JOIN r ON r.modality = f.modality AND r.megabatch = f.megabatch AND r.place = f.place + 1)"""


def _grouped_sql(modality: str, where: str) -> str:
    rows = f"(SELECT {modality} AS modality, doc_id, n_chars AS len, row_number() OVER (PARTITION BY {modality} ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY {modality}) AS n FROM documents WHERE {where})"
    return f"(SELECT modality, doc_id, len, position AS g FROM {permuted_sql(rows, 5)})"


@query("bkt01_02_length_grouped", _dealt_sql(_grouped_sql("1", "true")) + " SELECT megabatch, doc_id, place, chunk FROM f WHERE place >= 0")
def bkt02(spark, sf_dir):
    return M.megabatches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 64, 8, 5)


_MODALITY = "CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE -1 END"
_FULL = """(SELECT modality, megabatch, row_number() OVER (ORDER BY modality, megabatch) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT modality, megabatch FROM t WHERE NOT tail))"""


@query(
    "bkt03_modality_grouped",
    _dealt_sql(_grouped_sql(_MODALITY, "n_chars > 0"))
    + f""", t AS (SELECT modality, megabatch, doc_id, place, chunk, megabatch = max(megabatch) OVER (PARTITION BY modality) AS tail FROM f WHERE place >= 0)
        SELECT t.*, s.position AS slot FROM t LEFT JOIN {permuted_sql(_FULL, 5)} s ON s.modality = t.modality AND s.megabatch = t.megabatch AND NOT t.tail""",
)
def bkt03(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", M.signed_length(F.col("n_chars"), F.col("doc_id") % 3 != 0).alias("signed"))
    return M.modality_megabatches(d, "signed", "doc_id", 64, 8, 5)


def _part_sql(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS shard FROM {_DOCS}"


def _even(i: str, n: str, p: int) -> str:
    return f"(CASE WHEN {i} < ({n} % {p}) * ({n} // {p} + 1) THEN {i} // ({n} // {p} + 1) ELSE {n} % {p} + ({i} - ({n} % {p}) * ({n} // {p} + 1)) // greatest({n} // {p}, 1) END)"


def _shard(f):
    def run(spark, sf_dir):
        d, n = _numbered_docs(spark, sf_dir)
        return d.select("doc_id", f(F.col("i"), F.lit(n)).alias("shard"))

    return run


query("par01_even_shards", "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS shard FROM documents")(_shard(lambda i, n: PA.even_shard(i, n, 7)))
_VIDEOS = "(SELECT *, min(i) FILTER (WHERE n_chars >= 2000) OVER () AS lo, max(i) FILTER (WHERE n_chars >= 2000) OVER () + 1 AS hi FROM " + _DOCS + ")"


@query("par02_video_range", f"SELECT doc_id, CASE WHEN i < lo THEN 0 WHEN i >= hi THEN 6 ELSE {_even('(i - lo)', '(hi - lo)', 7)} END AS shard FROM {_VIDEOS}")
def par02(spark, sf_dir):
    """The long documents stand for videos: from the first to the last of them rows are dealt, others go to the ends."""
    d, _ = _numbered_docs(spark, sf_dir, "n_chars")
    low, high = d.where("n_chars >= 2000").agg(F.min("i"), F.max("i") + 1).first()
    return d.select("doc_id", PA.video_shard(F.col("i"), F.lit(low), F.lit(high), 7).alias("shard"))


query("par03_zigzag_even", _part_sql(f"least({_even('i', 'n', 8)}, 7 - {_even('i', 'n', 8)})"))(_shard(lambda i, n: PA.zigzag_shard(i, n, 4)))
query("par03_zigzag_ceil", _part_sql("least(i // CAST(ceil(n / 8.0) AS BIGINT), 7 - i // CAST(ceil(n / 8.0) AS BIGINT))"))(_shard(lambda i, n: PA.zigzag_shard(i, n, 4, even=False)))
query("par05_ceil_chunks", _part_sql("i // CAST(ceil(n / 7.0) AS BIGINT)"))(_shard(lambda i, n: PA.ceil_shard(i, n, 7)))
query("par06_rank_offset", _part_sql("i // CAST(ceil(n / 16.0) AS BIGINT)"))(_shard(lambda i, n: PA.ceil_shard(i, n, 16)))


@query(
    "par04_token_shards",
    f"""WITH t AS (SELECT user_id, event_id, event_type = 'click' AS img, row_number() OVER w AS i, count(*) FILTER (WHERE event_type = 'click') OVER w AS seen, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, {_even('greatest(seen - 1, 0)', 'n', 4)} AS shard FROM t WHERE n > 0""",
)
def par04(spark, sf_dir):
    w = Window.partitionBy("user_id")
    img = (F.col("event_type") == "click").cast("int")
    t = table(spark, sf_dir, "events").withColumns({"n": F.sum(img).over(w), "seen": F.sum(img).over(w.orderBy("ts", "event_id")), "img": img}).where("n > 0")
    return t.select("user_id", "event_id", PA.token_shard(F.col("seen") - F.col("img"), F.col("img") == 1, F.col("n"), 4).alias("shard"))


@query("par08_halves", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < floor((2 + l_quantity) / 2) THEN 'front' ELSE 'back' END AS half FROM lineitem")
def par08(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", PA.half(F.col("l_linenumber"), F.lit(2), F.col("l_quantity")).alias("half"))


@query("par09_padded_exchange", f"SELECT l_orderkey, array_to_string(ids, ',') AS ids FROM {_IDS}")
def par09(spark, sf_dir):
    """Shards padded to the longest of their batch for an exchange of equal sizes, then trimmed again."""
    ids = _ids(spark, sf_dir)
    longest = ids.groupBy("batch").agg(F.max(F.size("ids")).alias("m"))
    sent = ids.join(longest, "batch").select("l_orderkey", TK.padded(F.col("ids"), F.col("m"), -1).alias("p"), F.size("ids").alias("n"))
    return sent.select("l_orderkey", F.array_join(F.slice("p", F.lit(1), F.col("n")), ",").alias("ids"))
