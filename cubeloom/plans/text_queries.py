"""TXT: answers, prompts, templates; FLT01 and path functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat
from ..functions import text as T
from ..operators.convert import hash_choice
from ..registry import query, table
from . import inputs

_STRIP = "regexp_replace(pred, '^\\s+|\\s+$', '', 'g')"
for _p in T.ANSWER_PREFIXES:
    _STRIP = f"replace({_STRIP}, '{_p}', '')"


@query("txt01_word_count", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM documents")
def txt01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("txt02_option_letter", f"SELECT conv_id, turn, regexp_extract({_STRIP}, '[A-J]', 0) AS letter FROM ({inputs.PREDICTIONS})")
def txt02(spark, sf_dir):
    return inputs.predictions(spark, sf_dir).select("conv_id", "turn", T.option_letter(F.col("pred")).alias("letter"))


@query("txt03_first_integer", "SELECT item_id, CAST(nullif(regexp_extract(text || ' frame ' || (item_id * 7), '\\d+', 0), '') AS BIGINT) AS number FROM benchmark")
def txt03(spark, sf_dir):
    text = F.concat("text", F.lit(" frame "), (F.col("item_id") * 7).cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.first_integer(text).alias("number"))


_OPTIONS = "[split_part(text, ' ', 1), split_part(text, ' ', 2), split_part(text, ' ', 3), source]"


def _options():
    part = F.split("text", " ")
    return F.array(*[F.coalesce(F.get(part, F.lit(i)), F.lit("")) for i in range(3)], F.col("source"))


_ANSWER = "CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE source END"


@query(
    "txt04_choice_prompt",
    f"""SELECT doc_id, rtrim('Question: ' || lang || chr(10) || 'Options:' || chr(10) || '(A) ' || o[1] || chr(10) || '(B) ' || o[2] || chr(10) || '(C) ' || o[3] || chr(10) || '(D) ' || o[4]) AS prompt,
        '(' || CASE WHEN doc_id % 3 = 0 THEN '@' ELSE 'D' END || ')' AS answer, CASE WHEN doc_id % 3 = 0 THEN '@' ELSE 'D' END AS letter
    FROM (SELECT *, {_OPTIONS} AS o FROM documents)""",
)
def txt04(spark, sf_dir):
    o, answer = _options(), F.expr(_ANSWER)
    return table(spark, sf_dir, "documents").select("doc_id", T.question_prompt(F.col("lang"), o).alias("prompt"), T.answer_choice(answer, o).alias("answer"), T.answer_choice(answer, o, bare=True).alias("letter"))


@query(
    "txt05_option_list",
    f"SELECT doc_id, 'Options:' || chr(10) || array_to_string({_OPTIONS}, chr(10)) AS options, 'Options:' || chr(10) || array_to_string(list_transform({_OPTIONS}, lambda c, i: ' ' || chr(CAST(64 + i AS INT)) || '. ' || c), chr(10)) AS lettered FROM documents",
)
def txt05(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.option_list(_options()).alias("options"), T.option_list(_options(), lettered=True).alias("lettered"))


@query("txt06_wide_to_long", "SELECT p_partkey, unnest(range(4)) AS idx, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS choice FROM part")
def txt06(spark, sf_dir):
    a = F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(a).alias("idx", "choice")).withColumn("idx", F.col("idx").cast("long"))


@query(
    "txt07_judge_prompt",
    f"""SELECT conv_id, turn, 'Question: ' || duration || chr(10) || 'Correct Answer: ' || answer || chr(10) || 'Predicted Answer: ' || pred || chr(10) AS prompt FROM ({inputs.PREDICTIONS})""",
)
def txt07(spark, sf_dir):
    return inputs.predictions(spark, sf_dir).select("conv_id", "turn", F.format_string("Question: %s\nCorrect Answer: %s\nPredicted Answer: %s\n", "duration", "answer", "pred").alias("prompt"))


_SAID = "CASE doc_id % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'it''s no' WHEN 3 THEN 'a \"pred\": ''no''' WHEN 4 THEN lang || ' ' || source ELSE substr(coalesce(text, ''), 1, 40) END"
_SCORE = "CASE doc_id % 6 WHEN 0 THEN doc_id % 11 WHEN 1 THEN -(doc_id % 13) WHEN 2 THEN (doc_id % 9) / 2.0 ELSE doc_id % 5 END"


@query(
    "txt08_judge_dict",
    f"""SELECT doc_id, CASE WHEN doc_id % 10 IN (8, 9) THEN NULL ELSE {_SAID} END AS pred, CASE WHEN doc_id % 10 IN (7, 8, 9) THEN NULL ELSE CAST({_SCORE} AS DOUBLE) END AS score FROM documents""",
)
def txt08(spark, sf_dir):
    """Answers in several forms of literal: other quotes, escapes, nesting, entries before and after, signs; some without a score, some cut off, some no dictionary."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 7
    said = F.when(k == 0, "yes").when(k == 1, "No").when(k == 2, "it's no").when(k == 3, "a \"pred\": 'no'").when(k == 4, F.concat("lang", F.lit(" "), "source")).otherwise(F.substring(F.coalesce("text", F.lit("")), 1, 40))
    k = F.col("doc_id") % 6
    score = F.when(k == 0, (F.col("doc_id") % 11).cast("string")).when(k == 1, F.concat(F.lit("-"), F.col("doc_id") % 13)).when(k == 2, (F.col("doc_id") % 9 / 2).cast("string")).otherwise(F.concat(F.lit("'"), F.col("doc_id") % 5, F.lit("'")))

    def quoted(sign):
        out = F.replace(said, F.lit("\\"), F.lit("\\\\"))
        for plain, escape in ((sign, "\\" + sign), ("\n", "\\n"), ("\r", "\\r")):
            out = F.replace(out, F.lit(plain), F.lit(escape))
        return F.concat(F.lit(sign), out, F.lit(sign))

    single, double = quoted("'"), quoted('"')
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k = F.col("doc_id") % 10
    text = (
        F.when(k < 3, form("{'pred': ", single, ", 'score': ", score, "}")).when(k < 5, form('{"score": ', score, ', "pred": ', double, "}"))
        .when(k == 5, form(" {'note': \"'pred': 'no'\", 'pred': ", double, ", 'more': {'pred': [1, (2,)], 'score': 9}, 'score':", score, ",}\n"))
        .when(k == 6, form("{'pred': 'first', 'pred': ", single, ", 'score': ", score, "}")).when(k == 7, form("{'pred': ", single, "}"))
        .when(k == 8, form("{'pred': ", single, ", 'score': ", score)).otherwise(form("The answer: {'pred': ", single, "}"))
    )
    return T.judged(d.select("doc_id", text.alias("answer")), "answer").select("doc_id", "pred", "score")


def _rendered(pieces: str, head: str = "") -> str:
    return f"""SELECT conv_id, {head} array_to_string(list_transform(conversations, lambda t, i: {pieces}), '') AS prompt FROM ({inputs.DIALOGUES})"""


_NAME = "CASE WHEN t['from'] = 'human' THEN '{0}' ELSE '{1}' END"
_ROLE = _NAME.format("user", "assistant")
_SAYS = "'A chat between a curious {0} and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the {0}''s questions."
_text = lambda x: "'" + x.replace("'", "''") + "'"
_EXAMPLES = " || ".join(f"'{who}: ' || {_text(said)} || '###'" for who, said in zip(("Human", "Assistant"), chat.TEMPLATES["v0"].examples))
_SYSTEM = f"'<<SYS>>' || chr(10) || {_text(chat.TEMPLATES['llama_2'].system)} || chr(10) || '<</SYS>>' || chr(10) || chr(10)"
_RENDER = {
    "v0": _rendered(f"{_NAME.format('Human', 'Assistant')} || ': ' || t['value'] || '###'", f"{_SAYS.format('human')}###' || {_EXAMPLES} ||"),
    "llava_v0": _rendered(f"{_NAME.format('Human', 'Assistant')} || ': ' || t['value'] || '###'", f"{_SAYS.format('human')}###' ||"),
    "v1": _rendered(f"{_NAME.format('USER', 'ASSISTANT')} || ': ' || t['value'] || CASE WHEN i % 2 = 1 THEN ' ' ELSE '</s>' END", f"{_SAYS.format('user')} ' ||"),
    "mpt": _rendered(f"'<|im_start|>' || {_ROLE} || chr(10) || t['value'] || '<|im_end|>'", "'<|im_start|>system' || chr(10) || 'A conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers.<|im_end|>' ||"),
    "llama_2": _rendered(f"CASE WHEN i = 1 THEN '[INST] ' || {_SYSTEM} || t['value'] || ' [/INST]' WHEN i % 2 = 1 THEN '<s>[INST] ' || t['value'] || ' [/INST]' ELSE ' ' || t['value'] || ' </s>' END"),
    "llama_3_chat": _rendered(f"'<|start_header_id|>' || {_NAME.format('user', 'system')} || '<|end_header_id|>' || chr(10) || chr(10) || t['value'] || '<|eot_id|>'"),
    "qwen2": _rendered(f"'<|im_start|>' || {_ROLE} || chr(10) || t['value'] || '<|im_end|>' || chr(10)"),
    "plain": _rendered("t['value'] || CASE WHEN i % 2 = 1 THEN chr(10) ELSE '' END"),
}


def _chat(name):
    def run(spark, sf_dir):
        return inputs.dialogues(spark, sf_dir).select("conv_id", chat.render(chat.TEMPLATES[name], F.col("conversations")).alias("prompt"))

    return run


for _name, _sql in _RENDER.items():
    query(f"txt09_chat_{_name}", _sql)(_chat(_name))


@query("txt10_model_name", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '_checkpoint-' || doc_id ELSE source END AS name FROM documents")
def txt10(spark, sf_dir):
    path = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('/models/', source, '/checkpoint-', doc_id, '/') ELSE concat('models/', source) END")
    return table(spark, sf_dir, "documents").select("doc_id", T.name_from_path(path).alias("name"))


_REGISTRY = [(name, t.style, *t.roles, t.sep, t.sep2, t.system, "".join(t.examples)) for name, t in sorted(chat.TEMPLATES.items())]


@query("txt12_template_registry", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in _REGISTRY)}) v(template, style, human, gpt, sep, sep2, system, examples)")
def txt12(spark, sf_dir):
    return spark.createDataFrame(_REGISTRY, "template string, style string, human string, gpt string, sep string, sep2 string, system string, examples string")


@query("txt13_base64", "SELECT doc_id, base64(encode(text)) AS encoded, text AS decoded FROM documents")
def txt13(spark, sf_dir):
    enc = F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "")  # Spark may break long values into lines
    return table(spark, sf_dir, "documents").select("doc_id", enc.alias("encoded"), F.unbase64(enc).cast("string").alias("decoded"))


@query("txt14_json", """SELECT conv_id, len(conversations) AS n_turns, conversations[1]['value'] AS first_value FROM (%s)""" % inputs.DIALOGUES)
def txt14(spark, sf_dir):
    d = inputs.dialogues(spark, sf_dir).select("conv_id", F.to_json("conversations").alias("j"))
    parsed = F.from_json("j", "array<struct<from:string,value:string>>")
    return d.select("conv_id", F.size(parsed).cast("long").alias("n_turns"), parsed[0]["value"].alias("first_value"))


@query(
    "txt15_consistency_qa",
    "SELECT conv_id, unnest(range(CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END)) AS k, unnest(CASE WHEN conv_id % 2 = 0 THEN [text, text || '?'] ELSE [text] END) AS question FROM conversations WHERE turn = 0",
)
def txt15(spark, sf_dir):
    q = F.expr("CASE WHEN conv_id % 2 = 0 THEN array(text, concat(text, '?')) ELSE array(text) END")
    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.posexplode(q).alias("k", "question")).withColumn("k", F.col("k").cast("long"))


_NAMES = "concat('Clip_', CAST(doc_id AS STRING), CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.MP4' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.webm' WHEN 3 THEN '.txt' ELSE '.Mjpeg' END)"


@query(
    "flt01_media_suffix",
    f"""SELECT doc_id, regexp_matches(lower(n), '\\.(mp4|avi|mov|mkv|wmv|flv|webm|m4v)$') AS video, regexp_matches(lower(n), '\\.(jpg|png|jpeg|bmp|tiff|webp)$') AS image,
        lower(split_part(n, '.', -1)) IN ('mp4', 'mkv', 'avi', 'mov', 'wmv', 'flv', 'mjpeg') AS listed FROM (SELECT doc_id, {_NAMES} AS n FROM documents)""",
)
def flt01(spark, sf_dir):
    n = F.col("n")
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_NAMES} AS n").select("doc_id", T.is_video(n).alias("video"), T.is_image(n).alias("image"), T.listed_video(n).alias("listed"))


@query("prj07_first_tag_removed", "SELECT conv_id, turn, regexp_replace(text || chr(10) || ' <video> and <video>', '\\s*<video>', '') AS text FROM conversations")
def prj07(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_first_tag(F.concat("text", F.lit("\n <video> and <video>"))).alias("text"))


@query("prj11_path_parts", f"SELECT doc_id, name AS stem, CASE WHEN doc_id % 2 = 0 THEN '.mp4' ELSE '.mkv' END AS suffix FROM ({inputs.CATALOGUE_SQL})")
def prj11(spark, sf_dir):
    return inputs.catalogue(spark, sf_dir).select("doc_id", T.path_stem(F.col("path")).alias("stem"), T.path_suffix(F.col("path")).alias("suffix"))


@query("tok10_stop_keyword", "SELECT conv_id, turn, contains(text, 'the') AS stopped FROM conversations")
def tok10(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ends_or_contains(F.col("text"), "the").alias("stopped"))


_MARK = "CASE style WHEN '1' THEN CAST(i AS VARCHAR) WHEN '(1)' THEN '(' || i || ')' WHEN '(a)' THEN '(' || chr(CAST(96 + i AS INT)) || ')' WHEN '(A)' THEN '(' || chr(CAST(64 + i AS INT)) || ')' ELSE 'Option ' || i || ':' END"


@query(
    "txt11_option_styles",
    f"""SELECT doc_id, style, 'Options:' || chr(10) || array_to_string(list_transform(o, lambda c, i: {_MARK} || '. ' || c), chr(10)) AS options
        FROM (SELECT doc_id, {inputs.choice_sql(list(T.OPTION_STYLES), 'doc_id')} AS style, {_OPTIONS} AS o FROM documents)""",
)
def txt11(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", hash_choice(list(T.OPTION_STYLES), F.col("doc_id")).alias("style"), _options().alias("o"))
    return rows.select("doc_id", "style", T.styled_options(F.col("o"), F.col("style")).alias("options"))


_PROMPTS = ["Describe the image.", "What is shown here?", "Give a short caption."]


@query("prj08_prompt_override", f"SELECT doc_id, {inputs.choice_sql(_PROMPTS, 'doc_id', 3)} AS prompt FROM documents")
def prj08(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hash_choice(_PROMPTS, F.col("doc_id"), 3).alias("prompt"))
