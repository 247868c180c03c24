"""SRC and SNK: each writer's files read back by a reader, from a folder of the query's own."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import functions as F

from ..operators import mixture as M
from ..registry import query, table
from ..sources import blobs, catalogue, compact, readers, tsvstore, writers
from ..sources.tsvstore import _opened as fs_of
from ..workspace import Scratch
from . import inputs

_DOCS = "SELECT doc_id, text, source FROM documents"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


@query("src01_json_lines", _DOCS)
def src01(spark, sf_dir):
    path = Scratch(spark, "src01").path("lines")
    writers.write_json_lines(_docs(spark, sf_dir), path)
    return readers.json_lines(spark, path, "doc_id long, text string, source string")


#: Rows of a part that one task sorts and writes, about.
_PART_ROWS = 200_000
_BLOCK = 1 << 22


def _one_file(rows, path, opening, closing):
    """Rows (id, text) as one file in order of id: each range's lines are written by its own task and the parts put together by the file system, a closing bracket for the last comma."""
    parts = max(4, rows.count() // _PART_ROWS)
    rows.repartitionByRange(parts, "id").sortWithinPartitions("id").select(F.concat("text", F.lit(",")).alias("value")).write.text(path + ".parts")
    fs, base = fs_of(path)
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base + ".parts")) if f.base_name.startswith("part-"))
    with fs.open_output_stream(base) as out:
        held = opening.encode()
        for part in found:
            with fs.open_input_stream(part) as f:
                while block := f.read(_BLOCK):
                    block = held + block
                    out.write(block[:-2])
                    held = block[-2:]  # the last comma and line end, however blocks fall
        out.write(held.removesuffix(b",\n") + closing.encode() + b"\n")


_HARD = "n_name || '{[\"\\}]' || chr(10) || repeat('}', CAST(n_nationkey % 4 AS INT))"


@query("src02_json_array", f"SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN {_HARD} ELSE n_name END AS note FROM orders JOIN nation ON n_nationkey = o_orderkey % 25")
def src02(spark, sf_dir):
    """All orders as one array in one file, whose texts hold brackets, quotes and escapes, read in ranges of 64 KB or more."""
    path = Scratch(spark, "src02").path("array.json")
    rows = _noted_orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.to_json(F.struct("o_orderkey", "o_custkey", "o_totalprice", "note")).alias("text"))
    _one_file(rows, path, "[", "]")
    with _small_ranges(spark, path):
        return readers.json_array(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, note string")


def _noted_orders(spark, sf_dir):
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    hard = F.concat("n_name", F.lit('{["\\}]\n'), F.repeat(F.lit("}"), (F.col("n_nationkey") % 4).cast("int")))
    return table(spark, sf_dir, "orders").join(nation, F.col("n_nationkey") == F.col("o_orderkey") % 25).withColumn("note", F.when(F.col("o_orderkey") % 3 == 0, hard).otherwise(F.col("n_name")))


#: Bytes of the smallest range, and how many ranges a file has before they grow.
_LEAST_RANGE, _RANGES = 64 << 10, 256


def _range_bytes(file_bytes, most):
    """Small files in several ranges; of larger ones the ranges grow, since each costs a task and an entry of the fold, up to the session's own size."""
    return max(_LEAST_RANGE, min(most, -(-file_bytes // _RANGES)))


@contextmanager
def _small_ranges(spark, path):
    """Ranges by the file's size, while a plan is made and its first pass runs."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    fs, base = fs_of(path)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(name, str(_range_bytes(fs.get_file_info(base).size, most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query("src03_json_object", f"SELECT 'order ' || o_orderkey AS key, o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN {_HARD} ELSE n_name END AS note FROM orders JOIN nation ON n_nationkey = o_orderkey % 25")
def src03(spark, sf_dir):
    """All orders as one object keyed by order in one file."""
    path = Scratch(spark, "src03").path("object.json")
    value = F.to_json(F.struct("o_custkey", "o_totalprice", F.struct("note").alias("inner")))
    _one_file(_noted_orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.concat(F.lit('"order '), "o_orderkey", F.lit('": '), value).alias("text")), path, "{", "}")
    with _small_ranges(spark, path):
        return readers.json_object(spark, path, "struct<o_custkey: bigint, o_totalprice: double, inner: struct<note: string>>").select("key", "value.o_custkey", "value.o_totalprice", "value.inner.note")


@query("src03_json_numbers", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS value FROM orders")
def src03_numbers(spark, sf_dir):
    """An object of numbers, as a store's file of names and lines is one."""
    path = Scratch(spark, "src03n").path("object.json")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('"'), "o_orderkey", F.lit('": '), "o_custkey").alias("text"))
    _one_file(rows, path, "{", "}")
    with _small_ranges(spark, path):
        return readers.json_object(spark, path, "bigint")


@query("src06_parquet_tolerant", "SELECT o_orderkey, o_custkey FROM orders")
def src06(spark, sf_dir):
    return readers.parquet_tolerant(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")


@query("src08_bounded_batches", "SELECT doc_id, length(text) AS n FROM documents")
def src08(spark, sf_dir):
    def size(batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        return pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_length(batch.column(1)).cast(pa.int64())], ["doc_id", "n"])

    return readers.in_batches(_docs(spark, sf_dir).select("doc_id", "text"), size, "doc_id long, n long", 32)


@query("src09_csv", "SELECT p_partkey, p_name, p_size FROM part")
def src09(spark, sf_dir):
    path = Scratch(spark, "src09").path("csv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).csv(path)
    return readers.csv_header(spark, path, "p_partkey long, p_name string, p_size int")


def _framed(spark, sf_dir):
    """Documents as frames by name: the text's words in two frames, in two stores by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    frames = F.array(F.substring("text", F.lit(1), half).cast("binary"), F.substring("text", half + 1, F.length("text")).cast("binary"))
    return d.select("doc_id", F.concat(F.when(F.col("lang") == "en", "sharegpt4video/").otherwise("YouCook2/"), "source", F.lit("/"), "doc_id").alias("name"), frames.alias("frames"))


_NAMED = "(SELECT doc_id, CASE WHEN lang = 'en' THEN 'sharegpt4video/' ELSE 'YouCook2/' END || source || '/' || doc_id AS name, lang = 'en' AS first, coalesce(text, '') AS text FROM documents)"


def _two_stores(spark, sf_dir, label):
    """Each store written by documents of even ids, then appended to by the others, in order of ids."""
    scratch, rows = Scratch(spark, label), _framed(spark, sf_dir)
    stores = {"sharegpt4video": scratch.path("a"), "YouCook2": scratch.path("b")}
    for word, path in stores.items():
        for k in (0, 1):
            part = rows.where(F.col("name").startswith(word) & (F.col("doc_id") % 2 == k)).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
            tsvstore.write_store(part, path, append=k == 1)
    return stores


_LINE = "row_number() OVER (PARTITION BY first ORDER BY doc_id % 2, doc_id) - 1"


@query("src10_line_access", f"""WITH s AS (SELECT *, {_LINE} AS line, count(*) OVER (PARTITION BY first) AS n FROM {_NAMED})
    SELECT a.doc_id AS asked, s.line, s.name, sha256(s.text) AS text_sha256 FROM s a JOIN s ON s.first AND s.line = a.doc_id * 7 % s.n WHERE a.doc_id % 100 = 0""")
def src10(spark, sf_dir):
    """A line of the first store for each document whose id is divisible by 100, by its number; only those lines' bytes are read."""
    path = _two_stores(spark, sf_dir, "src10")["sharegpt4video"]
    listed = tsvstore.names(spark, path)
    n = sum(s.lines for s in tsvstore.segments(path))
    asked = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("asked"), (F.col("doc_id") * 7 % n).alias("line"))
    found = tsvstore.fetched(asked.join(listed, "line").withColumn("path", F.lit(path)), ["asked", "line", "name"])
    return found.select("asked", "line", "name", _joined_sha("frames").alias("text_sha256"))


def _joined_sha(frames):
    """SHA-256 of all frames' bytes, in hexadecimal digits."""
    return F.sha2(F.aggregate(frames, F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x)), 256)


@query("src11_store_lookup", f"""WITH s AS (SELECT *, {_LINE} AS line FROM {_NAMED}), a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(name, 'o', '0') WHEN doc_id % 7 = 1 THEN name || 'x' ELSE name END AS name FROM s)
    SELECT a.doc_id, CASE WHEN s.name IS NULL THEN NULL WHEN s.first THEN 'sharegpt4video' ELSE 'YouCook2' END AS store, s.line, sha256(coalesce(s.text, 'decoded ' || a.doc_id)) AS text_sha256 FROM a LEFT JOIN s ON s.name = a.name""")
def src11(spark, sf_dir):
    """Every document's frames by name from the store that the name leads to, or decoded where the store has none or no store is meant."""
    name = F.expr("CASE WHEN doc_id % 7 = 0 THEN replace(name, 'o', '0') WHEN doc_id % 7 = 1 THEN concat(name, 'x') ELSE name END")
    asked = _framed(spark, sf_dir).select("doc_id", name.alias("name"), F.array(F.concat(F.lit("decoded "), "doc_id").cast("binary")).alias("decoded"))
    found = blobs.stored_or(tsvstore.looked_up(asked, _two_stores(spark, sf_dir, "src11"), "name"), "decoded")
    return found.select("doc_id", "store", "line", _joined_sha("frames").alias("text_sha256"))


@query("src10_given_lines", f"SELECT name, {_LINE} AS line, sha256(text) AS text_sha256 FROM {_NAMED} WHERE first QUALIFY line IN (3, 5, 8)")
def src10_given(spark, sf_dir):
    """Lines given by number, which the source reads alone."""
    store = tsvstore.read_store(spark, _two_stores(spark, sf_dir, "src10g")["sharegpt4video"], lines=[3, 5, 8])
    return store.select("name", "line", _joined_sha("frames").alias("text_sha256"))


@query("src12_media_listing")
def src12(spark, sf_dir):
    return readers.media_listing(spark, sf_dir, suffixes=("parquet",)).select("name", "stem", "length")


@query(
    "src18_numbered_frames",
    "SELECT p_partkey, array_to_string(list_filter(range(0, p_size, 3), lambda i: i % 4 <> 0), ',') AS frames FROM part WHERE len(list_filter(range(0, p_size, 3), lambda i: i % 4 <> 0)) > 0",
)
def src18(spark, sf_dir):
    clips = table(spark, sf_dir, "part").select("p_partkey", F.sequence(F.lit(0), F.col("p_size") - 1, F.lit(3)).alias("wanted"))
    listing = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(F.sequence(F.lit(0), F.lit(60)), lambda i: i % 4 != 0)).alias("frame"))
    return blobs.existing_frames(clips, listing, "p_partkey").select("p_partkey", F.array_join("frames", ",").alias("frames"))


@query(
    "src21_mixture_load",
    """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS m FROM documents WHERE source IN ('src0', 'src1'))
       SELECT source, r * n + i AS position, doc_id FROM d, range(2) t(r) WHERE r * n + i >= m // 8 AND r * n + i < m // 2 + m // 8""",
)
def src21(spark, sf_dir):
    """Two sources of four files each, repeated, then cut from the first repeat into the second."""
    scratch, docs = Scratch(spark, "src21"), _docs(spark, sf_dir).where("source IN ('src0', 'src1')").select("doc_id", "source")
    for s in ("src0", "src1"):
        docs.where(F.col("source") == s).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.json(scratch.path(s))
    n = docs.count()
    spec = scratch.path("src{0,1}") + f"#{n // 8}_{n // 2 + n // 8}*2"
    return M.load_mixture(spark, spec, "doc_id long, source string").select("source", F.col("position").cast("long").alias("position"), "doc_id")


@query("src22_result_shards", "SELECT conv_id, turn, pred FROM (%s)" % inputs.PREDICTIONS)
def src22(spark, sf_dir):
    scratch = Scratch(spark, "src22")
    rows = inputs.predictions(spark, sf_dir).select("conv_id", "turn", "pred")
    for k in range(2):
        writers.write_once(rows.where(F.col("conv_id") % 2 == k), scratch.path(f"shard_{k}"))
    return readers.result_shards(spark, scratch.path("shard_*"), "conv_id long, turn long, pred string", lines=True)


@query("snk02_append", "SELECT doc_id, text, source FROM documents UNION ALL SELECT doc_id, text, source FROM documents WHERE doc_id % 5 = 0")
def snk02(spark, sf_dir):
    path, d = Scratch(spark, "snk02").path("out"), _docs(spark, sf_dir)
    writers.write_json_lines(d, path)
    writers.write_json_lines(d.where("doc_id % 5 = 0"), path, append=True, partitions=1)
    return readers.json_lines(spark, path, "doc_id long, text string, source string")


@query("snk04_tsv_store", f"SELECT name, first, {_LINE} AS line, sha256(text) AS text_sha256 FROM {_NAMED}")
def snk04(spark, sf_dir):
    """Two stores written, appended to and read whole."""
    first, second = (tsvstore.read_store(spark, path).withColumn("first", F.lit(k == 0)) for k, path in enumerate(_two_stores(spark, sf_dir, "snk04").values()))
    return first.unionByName(second).select("name", "first", "line", _joined_sha("frames").alias("text_sha256"))


@query("snk04_offsets", f"""WITH s AS (SELECT *, {_LINE} AS line, strlen(text) AS b, length(text) // 2 AS h FROM {_NAMED} WHERE first),
    e AS (SELECT *, strlen(name) + 1 + 2 + 2 + 4 + 4 * ((strlen(substr(text, 1, h)) + 2) // 3) + 4 * ((b - strlen(substr(text, 1, h)) + 2) // 3) + 1 AS size FROM s)
    SELECT name, line, CAST(sum(size) OVER (ORDER BY line) - size AS BIGINT) AS byte_offset, 2 AS n_frames FROM e""")
def snk04_offsets(spark, sf_dir):
    """Where each line begins, over all writes."""
    return tsvstore.names(spark, _two_stores(spark, sf_dir, "snk04o")["sharegpt4video"]).select("name", "line", "byte_offset", F.col("n_frames").cast("int").alias("n_frames"))


@query(
    "snk05_dataset_store",
    """WITH k AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'v/' || doc_id // 2 || '.mp4' END, CASE WHEN doc_id % 3 = 1 THEN 'i/' || doc_id || '.jpg' END, source || '-' || doc_id) AS name, doc_id % 4 AS n FROM documents WHERE doc_id % 4 > 0),
        l AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS line, row_number() OVER (PARTITION BY name ORDER BY doc_id DESC) AS back FROM k)
        SELECT c.doc_id, l.name, l.line, CAST(l.n AS INT) AS n_frames FROM l c JOIN l ON l.name = c.name AND l.back = 1""",
)
def snk05(spark, sf_dir):
    """Rows with images as a store by name and rows without them; of a repeated name the last line counts, for all its rows."""
    path = Scratch(spark, "snk05").path("set")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    images = F.slice(F.array(*[F.concat("source", F.lit(f" {i}")).cast("binary") for i in range(3)]), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    key = {"video": "if(doc_id % 3 = 0, concat('v/', doc_id div 2, '.mp4'), null)", "image": "if(doc_id % 3 = 1, concat('i/', doc_id, '.jpg'), null)", "filename": "concat(source, '-', doc_id)"}
    rows = d.withColumns({k: F.expr(v) for k, v in key.items()} | {"images": images})
    tsvstore.write_dataset(rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), path)
    chat = readers.json_lines(spark, f"{path}/chat", "doc_id long, video string, image string, filename string")
    named = chat.select("doc_id", F.coalesce("video", "image", "filename").alias("name"))
    return named.join(tsvstore.names(spark, f"{path}/imgs"), "name").select("doc_id", "name", "line", "n_frames")


@query("snk10_resume_missing", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM documents")
def snk10(spark, sf_dir):
    path, d = Scratch(spark, "snk10").path("out"), _docs(spark, sf_dir).select("doc_id")
    writers.write_json_lines(d.where("doc_id % 2 = 0").withColumn("run", F.lit(1)), path)
    done = readers.json_lines(spark, path, "doc_id long, run int")
    writers.write_missing(d.withColumn("run", F.lit(2)), done.select("doc_id"), ["doc_id"], path)
    return readers.json_lines(spark, path, "doc_id long, run int")


@query("snk14_write_once", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def snk14(spark, sf_dir):
    path, d = Scratch(spark, "snk14").path("out"), _docs(spark, sf_dir).select("doc_id")
    writers.write_once(d.where("doc_id % 2 = 0"), path)
    writers.write_once(d, path)
    return readers.json_lines(spark, path, "doc_id long")


@query("snk09_metrics_file", "SELECT count(*) AS n, count(DISTINCT source) AS n_sources FROM documents")
def snk09(spark, sf_dir):
    path = Scratch(spark, "snk09").path("out")
    writers.write_metrics(_docs(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources")), path)
    return readers.json_lines(spark, path, "n long, n_sources long")


@query(
    "cat_source_specs",
    "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (s.name, s.prefix, s.category, s.key, s.miss, s.form)) + ")" for s in catalogue.QA_SOURCES.values()) + ") v(name, prefix, category, key, miss, form)",
)
def cat_specs(spark, sf_dir):
    return spark.createDataFrame([(s.name, s.prefix, s.category, s.key, s.miss, s.form) for s in catalogue.QA_SOURCES.values()], "name string, prefix string, category string, key string, miss string, form string")


def _as_files(rows, name, payload, folder):
    """Writes a file for each row, and gives the folder."""
    blobs.write_media(rows.select(name.alias("name"), payload.cast("binary").alias("payload")), folder, "name", "payload").agg(F.count("*")).collect()
    return folder


@query("src04_json_folder", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS caption FROM nation WHERE n_nationkey % 5 <> 0")
def src04(spark, sf_dir):
    """Every fifth file is broken, and left out."""
    rows = table(spark, sf_dir, "nation")
    text = F.when(F.col("n_nationkey") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("n_name").alias("caption"))))
    folder = _as_files(rows, F.concat(F.col("n_nationkey").cast("string"), F.lit(".json")), text, Scratch(spark, "src04").path("files"))
    return readers.json_folder(spark, folder, "caption string").select("key", "caption")


@query("src07_parquet_columns", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def src07(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang")


@query("src14_sidecar_ids", "SELECT n_name AS id FROM nation WHERE n_nationkey % 4 <> 0")
def src14(spark, sf_dir):
    """Every fourth file has an empty id."""
    found = F.when(F.col("n_nationkey") % 4 == 0, F.lit("")).otherwise(F.col("n_name"))
    text = F.to_json(F.struct(F.struct(F.struct(found.alias("id")).alias("info")).alias("yt_meta_dict")))
    folder = _as_files(table(spark, sf_dir, "nation"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".json")), text, Scratch(spark, "src14").path("files"))
    return readers.sidecar_catalogue(spark, folder).select("id")


@query("snk01_overwrite", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1")
def snk01(spark, sf_dir):
    path, d = Scratch(spark, "snk01").path("out"), _docs(spark, sf_dir).select("doc_id")
    writers.write_json_lines(d, path)
    writers.write_json_lines(d.where("doc_id % 2 = 1"), path)
    return readers.json_lines(spark, path, "doc_id long")


@query("snk08_media_if_absent", "SELECT CAST(n_nationkey AS VARCHAR) || '.bin' AS name, strlen(n_name) AS length FROM nation")
def snk08(spark, sf_dir):
    folder, rows = Scratch(spark, "snk08").path("media"), table(spark, sf_dir, "nation")
    name = F.concat(F.col("n_nationkey").cast("string"), F.lit(".bin"))
    _as_files(rows, name, F.col("n_name"), folder)
    _as_files(rows, name, F.lit("another payload"), folder)  # all are there: nothing changes
    return readers.media_listing(spark, folder, suffixes=("bin",)).select("name", "length")


def _small_files(spark, sf_dir, folder):
    """A file of lines for each ten documents, its name in the order of ids."""
    group = F.lpad(F.floor(F.col("doc_id") / 10).cast("string"), 8, "0")
    lines = table(spark, sf_dir, "documents").select(group.alias("g"), "doc_id", F.concat_ws(",", "doc_id", "source", F.repeat(F.lit("x"), (F.col("doc_id") % 37).cast("int"))).alias("line"))
    files = lines.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    ended = F.when(F.col("g").cast("int") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    _as_files(files, F.concat("g", F.lit(".csv")), ended, folder)


@query(
    "snk11_compaction",
    """WITH l AS (SELECT doc_id // 10 AS g, doc_id || ',' || source || ',' || repeat('x', CAST(doc_id % 37 AS INT)) AS line FROM documents),
        f AS (SELECT g, CAST(sum(strlen(line) + 1) - CASE WHEN g % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size FROM l GROUP BY g),
        b AS (SELECT *, CAST(sum(size) OVER (ORDER BY g) - size AS BIGINT) // 4000 AS bin FROM f)
        SELECT bin, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM b GROUP BY bin""",
)
def snk11(spark, sf_dir):
    """Small files put together to files of about 4,000 bytes."""
    folder = Scratch(spark, "snk11").path("lines")
    _small_files(spark, sf_dir, folder)
    return compact.compact(spark, folder, 4000, ".csv")


@query("snk11_compacted_rows", "SELECT doc_id, source, doc_id % 37 AS n FROM documents")
def snk11_rows(spark, sf_dir):
    """The rows are the same afterwards, also those of files without a line break at their end."""
    folder = Scratch(spark, "snk11r").path("lines")
    _small_files(spark, sf_dir, folder)
    compact.compact(spark, folder, 4000, ".csv")
    read = spark.read.schema("doc_id long, source string, x string").csv(folder)
    return read.select("doc_id", "source", F.length(F.coalesce("x", F.lit(""))).cast("long").alias("n"))
