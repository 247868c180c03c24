"""Views of the driver's tables in the roles of the reference's inputs, for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table

#: A model's answers made of the assistant's turns; the text is the same for both engines.
_LETTER = "chr(CAST(65 + turn % 5 AS INT))"
PREDICTION_COLUMNS = f"""
    conv_id, turn,
    CASE CAST(conv_id % 7 AS INT) WHEN 0 THEN concat('The answer is ', {_LETTER}) WHEN 1 THEN concat('(', {_LETTER}, ')') WHEN 2 THEN concat('Best answer: ', {_LETTER})
        WHEN 3 THEN lower({_LETTER}) WHEN 4 THEN '' WHEN 5 THEN concat(' ', {_LETTER}, '. ', text) ELSE text END AS pred,
    concat('(', chr(CAST(65 + (conv_id + turn) % 5 AS INT)), ') ', text) AS answer,
    CASE CAST(conv_id % 3 AS INT) WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS duration,
    concat('task', CAST(conv_id % 4 AS STRING)) AS task_type"""
PREDICTIONS = f"SELECT {PREDICTION_COLUMNS} FROM conversations WHERE role = 'assistant'"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return spark.sql(f"SELECT {PREDICTION_COLUMNS} FROM {{rows}}", rows=rows)


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and conversations: turns of from (human, gpt, or the role itself) and value."""
    role = F.expr("CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("from"), F.col("text").alias("value")))).alias("t"))
    return turns.select("conv_id", F.expr("transform(t, x -> struct(x.`from`, x.value))").alias("conversations"))


#: DuckDB's form of dialogues.
DIALOGUES = """SELECT conv_id, list({'from': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'value': text} ORDER BY turn) AS conversations FROM conversations GROUP BY conv_id"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames of a video for each user: user_id, ts, event_id, x."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("x"), "event_type")


#: Media catalogue: files for two documents in three.
CATALOGUE = "SELECT doc_id, concat('videos/', source, '/v_', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.mp4' ELSE '.mkv' END) AS path, concat('v_', CAST(doc_id AS STRING)) AS name FROM {documents} WHERE doc_id % 3 <> 0"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOGUE, documents=table(spark, sf_dir, "documents"))


CATALOGUE_SQL = CATALOGUE.replace("{documents}", "documents")


def choice_sql(options: list[str], key: str, seed: int = 0) -> str:
    """DuckDB's form of operators.convert.hash_choice."""
    listed = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"[{listed}][CAST('0x' || md5('{seed}-' || {key})[1:8] AS BIGINT) % {len(options)} + 1]"
