"""Big JSON files: ranges of a few bytes against the json module."""

import json
import random
import sys

import pyarrow as pa
import pytest

from cubeloom.sources import bigjson


@pytest.fixture(params=["20", "64", "100000"])
def ranges(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


TEXTS = ["plain", "", 'quote " here', "back\\slash\\", "} { ] [", '"}', "\\\"}{", "é日🙂", "a,b,,c", "x" * 90, "\n\t", '{"a": [1, {"b": "}"}]}']


def record(r, i):
    return {"id": i, "text": r.choice(TEXTS), "inner": {"list": [r.choice(TEXTS) for _ in range(r.randrange(3))], "deep": {"n": r.random()}}}


SCHEMA = "id long, text string, inner struct<list: array<string>, deep: struct<n: double>>"


@pytest.mark.parametrize("indent, separators", [(None, (",", ":")), (2, None), (None, (" , ", " : "))])
def test_arrays(spark, tmp_path, ranges, indent, separators):
    r = random.Random(1)
    want = [record(r, i) for i in range(25)]
    (tmp_path / "a.json").write_text(" \n" + json.dumps(want, indent=indent, separators=separators, ensure_ascii=False) + "\n")
    got = [x.asDict(recursive=True) for x in bigjson.array_rows(spark, str(tmp_path / "a.json"), SCHEMA).collect()]
    assert sorted(got, key=lambda x: x["id"]) == want


@pytest.mark.parametrize("indent", [None, 1])
def test_objects(spark, tmp_path, ranges, indent):
    r = random.Random(2)
    want = {f"{r.choice(TEXTS)}{i}": record(r, i) for i in range(20)}
    (tmp_path / "o.json").write_text(json.dumps(want, indent=indent))
    got = {x.key: x.value.asDict(recursive=True) for x in bigjson.object_rows(spark, str(tmp_path / "o.json"), f"struct<{SCHEMA.replace('id long', 'id: bigint').replace('text string', 'text: string').replace('inner struct', 'inner: struct')}>").collect()}
    assert got == want


@pytest.mark.parametrize("kind, make", [("bigint", lambda r, i: i), ("string", lambda r, i: r.choice(TEXTS)), ("array<string>", lambda r, i: [r.choice(TEXTS) for _ in range(r.randrange(4))])])
def test_objects_of_other_values(spark, tmp_path, ranges, kind, make):
    r = random.Random(3)
    want = {f"k{i}": make(r, i) for i in range(20)}
    (tmp_path / "o.json").write_text(json.dumps(want))
    assert {x.key: x.value for x in bigjson.object_rows(spark, str(tmp_path / "o.json"), kind).collect()} == want


def test_nothing_and_broken_files(spark, tmp_path, ranges):
    for name, text in {"a": "[]", "b": "[ ]\n", "c": "{}"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert bigjson.array_rows(spark, str(tmp_path / "[ab].json"), SCHEMA).count() == 0
    assert bigjson.object_rows(spark, str(tmp_path / "c.json"), "struct<id: bigint>").count() == 0
    assert bigjson.object_rows(spark, str(tmp_path / "c.json"), "bigint").count() == 0
    (tmp_path / "d.json").write_text('[{"id": 1}, {"id": 2, "text": "cut o')
    with pytest.raises(Exception, match="ends inside"):
        bigjson.array_rows(spark, str(tmp_path / "d.json"), SCHEMA).collect()


def test_several_files(spark, tmp_path, ranges):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"id": 10 * k + i, "text": "}"} for i in range(4)]))
    assert sorted(r.id for r in bigjson.array_rows(spark, str(tmp_path), SCHEMA).collect()) == [10 * k + i for k in range(3) for i in range(4)]


def test_ranges_grow_with_the_file():
    """Small files have several ranges; a large one's number of ranges is bounded, until they are as large as the session's."""
    from cubeloom.plans.source_queries import _range_bytes

    most = 128 << 20
    assert _range_bytes(1_000_000, most) == 64 << 10
    assert all(-(-n // _range_bytes(n, most)) <= 256 for n in (10**7, 10**9, 6 * 10**9))
    assert _range_bytes(10**12, most) == most


def test_ranges_are_summed_up_once(spark, tmp_path, monkeypatch):
    """What the fold sorts is written before: a sort samples its rows, and would read the file once more."""
    plans, fold = [], bigjson.beginnings
    monkeypatch.setattr(bigjson, "beginnings", lambda r: plans.append(r._jdf.queryExecution().optimizedPlan().toString()) or fold(r))
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    assert bigjson.array_rows(spark, str(tmp_path / "a.json"), "id long").count() == 2
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_texts_of_marks(spark, tmp_path, ranges):
    """Runs of backslashes, quotes and brackets at the ends of pieces, ranges and batches."""
    r = random.Random(4)
    want = [{"id": i, "text": "".join(r.choice('\\"{}[],: é') for _ in range(r.randrange(40)))} for i in range(10)]
    (tmp_path / "a.json").write_text(json.dumps(want, ensure_ascii=False))
    (tmp_path / "o.json").write_text(json.dumps({x["text"] + str(x["id"]): x["text"] for x in want}, ensure_ascii=False))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = bigjson.array_rows(spark, str(tmp_path / "a.json"), "id long, text string").collect()
        named = bigjson.object_rows(spark, str(tmp_path / "o.json"), "string").collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(({"id": x.id, "text": x.text} for x in got), key=lambda x: x["id"]) == want
    assert {x.key: x.value for x in named} == {x["text"] + str(x["id"]): x["text"] for x in want}


@pytest.mark.parametrize("mark", [bigjson.BRACE, bigjson.COMMA])
def test_work_is_by_batch(mark):
    """A range's pieces are not stepped through in Python: calls don't grow with them."""
    pieces = json.dumps([{"id": i, "text": 'a "b" }'} for i in range(5000)]).split(mark)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(pieces)), pa.array([0] * len(pieces), pa.int64()), pa.array(pieces)], ["file", "start", "piece"])
    calls, found = [], []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        for run in (bigjson._summed(mark), bigjson._cut({("f", 0): (False, 0)}, mark)):
            found.append(list(run(iter([batch]))))
    finally:
        sys.setprofile(None)
    assert sum(x.num_rows for x in found[1]) >= 5000
    assert len(calls) < 2000


@pytest.mark.parametrize("block", [1, 2, 3, 1 << 22])
def test_one_file(spark, tmp_path, monkeypatch, block):
    """Rows in order of id, commas between them alone, however the blocks fall; without rows, an empty array."""
    from cubeloom.plans import source_queries

    monkeypatch.setattr(source_queries, "_BLOCK", block, raising=False)
    for n in (0, 1, 9):
        path = tmp_path / f"{n}.json"
        source_queries._one_file(spark.range(n).selectExpr("(id * 7) % 9 AS id", "to_json(struct((id * 7) % 9 AS a)) AS text"), f"file://{path}", "[", "]")
        assert json.loads(path.read_text()) == [{"a": x} for x in sorted(i * 7 % 9 for i in range(n))]
