"""The registered queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, linededup, neardup, packing, repair, repetition, secrets, sharding, simhash, vptree, warc
from .common import spread, table

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
ALIGNED_VOCABULARIES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = {f"shard-{i:02d}": 1 for i in range(64)}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts, for the operators that run in Python."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.col("ordinal").cast("long"), "kind", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), "score", "is_secret")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary(WORD_VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "segment", "n_turns", "text_start", "text", spans.alias("mask"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_decode(documents(spark, sf_dir), vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_structure(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), *map(vocabulary, ALIGNED_VOCABULARIES))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_warc, op3_packing, op4_minhash, op5_vptree, op6_sharding, op7_perspectives, op8_line_dedup, op9_repetition, op10_byte_bpe, op11_structure_repair, op12_simhash, op13_alignment)}

_ESCAPED = "replace(replace({}, '<|', '<\\|'), '|>', '|\\>')"
_PIECE = f"CASE WHEN t.role = c.perspective THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>' ELSE '<|user name=' || coalesce(translate({_ESCAPED.format('t.role')}, chr(10) || chr(13), '  '), 'unknown') || '|>' END || chr(10)"
#: The lookup table as text, shards in the order of slots; the table is the operator's parameter as much as the shards' names.
_SLOTS = ",".join(s[6:] for s in sharding.lookup_table(SHARDS))
#: CRC-32 of a string of ASCII letters: its table by the polynomial's rule, and the fold over the letters.
def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


_CRC = f"xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(k, '.'), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, ([{', '.join(str(_crc_entry(i)) for i in range(256))}])[xor(c, x) & 255 + 1])))"
_CRC = _CRC.replace("[xor(c, x) & 255 + 1]", "[(xor(c, x) & 255) + 1]")
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The state that a row's own role leads to from state s, and the state that a made turn leads to.
_KEPT = "CASE WHEN c = 's' AND s = 0 THEN 1 WHEN c = 'u' AND s IN (0, 1, 3) THEN 2 WHEN c = 'a' AND s = 2 THEN 3 END"
_MADE = "CASE WHEN {} = 2 THEN 3 ELSE 2 END"
_MADE_ROLE = "CASE WHEN {} = 2 THEN 'user' ELSE 'assistant' END"
ORACLE = {
    "op11_structure_repair": f"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        f AS (SELECT *, {_CRC} % 20 AS fault FROM raw),
        d AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM f WHERE fault <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        m AS (
            SELECT *, substr(role, 1, 1) AS c, trim(text, {_WHITE}) = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                right(rtrim(text, {_WHITE}), 1) NOT IN ('.', '!', '?') AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        n AS (SELECT conv_id, i, role, text, c, blank OR again AS must, NOT blank AND NOT again AND cut AS cut FROM m),
        best(conv_id, i, s, b) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} FROM conversations
            UNION ALL
            SELECT conv_id, i, s, min(b) FROM (
                WITH one AS (SELECT * FROM best UNION ALL SELECT conv_id, i, {_MADE.format("s")}, {{'cost': b.cost + 5, 'audit': b.audit || 'I', 'lines': b.lines || [{_MADE_ROLE.format(_MADE.format("s"))} || ':']}} FROM best),
                two AS (SELECT * FROM one UNION ALL SELECT conv_id, i, {_MADE.format("s")}, {{'cost': b.cost + 5, 'audit': b.audit || 'I', 'lines': b.lines || [{_MADE_ROLE.format(_MADE.format("s"))} || ':']}} FROM one),
                nxt AS (SELECT two.conv_id, n.i, s, b, role, text, c, must, cut, CASE WHEN cut THEN 5 ELSE 0 END AS more, {_KEPT} AS kept FROM two JOIN n ON n.conv_id IS NOT DISTINCT FROM two.conv_id AND n.i = two.i + 1)
                SELECT conv_id, i, s, {{'cost': b.cost + 2, 'audit': b.audit || 'D', 'lines': b.lines}} AS b FROM nxt
                UNION ALL SELECT conv_id, i, kept, {{'cost': b.cost + more, 'audit': b.audit || 'K', 'lines': b.lines || [role || ':' || text]}} FROM nxt WHERE NOT must AND kept IS NOT NULL
                UNION ALL SELECT conv_id, i, {_MADE.format("s")}, {{'cost': b.cost + more + 1, 'audit': b.audit || 'R', 'lines': b.lines || [{_MADE_ROLE.format(_MADE.format("s"))} || ':' || text]}} FROM nxt WHERE NOT must)
            GROUP BY conv_id, i, s),
        size AS (
            SELECT r.conv_id, coalesce(max(o.i), 0) AS n, CASE WHEN max(o.turn) IS NULL THEN 0 ELSE max(o.turn) - min(o.turn) + 1 - count(DISTINCT o.turn) END AS gaps
            FROM (SELECT DISTINCT conv_id FROM conversations) r LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY r.conv_id),
        ended AS (
            SELECT size.conv_id, gaps, min({{'cost': b.cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': b.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'lines': b.lines || CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END}}) AS e
            FROM size JOIN best ON best.conv_id IS NOT DISTINCT FROM size.conv_id AND best.i = size.n GROUP BY ALL),
        faults AS (
            SELECT conv_id, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE NOT blank AND NOT again AND cut) AS truncated,
                count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
        SELECT ended.conv_id, CAST(gaps AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            e.cost AS cost, e.audit AS audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
        FROM ended LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM ended.conv_id""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op6_sharding": f"""
        WITH s AS (SELECT doc_id, CAST(('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:8]) AS BIGINT) % {sharding.TABLE} AS slot FROM documents),
        t AS (SELECT 'shard-' || unnest(l) AS shard, unnest(range(len(l))) AS slot FROM (SELECT string_split('{_SLOTS}', ',') AS l))
        SELECT doc_id, CAST(slot AS INTEGER) AS slot, shard FROM s JOIN t USING (slot)""",
    "op7_perspectives": f"""
        WITH t AS (
            SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS FIRST) - 1 AS rank FROM conversations),
        c AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
        p AS (
            SELECT t.conv_id, c.perspective, t.rank // {chat.SEGMENT} AS segment, t.rank, {_PIECE} AS head, {_ESCAPED.format('t.text')} || '<|end|>' || chr(10) AS body, t.role IS NOT DISTINCT FROM c.perspective AS own
            FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
        s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY rank) - length(body) AS low FROM p)
        SELECT conv_id, perspective, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns, CAST(min(low - length(head)) AS BIGINT) AS text_start, string_agg(head || body, '' ORDER BY rank) AS text,
            coalesce(string_agg(CASE WHEN own THEN CAST(low AS BIGINT) || '-' || CAST(low + length(body) AS BIGINT) END, ',' ORDER BY rank), '') AS mask
        FROM s GROUP BY ALL""",
    "op8_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        d AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
}
