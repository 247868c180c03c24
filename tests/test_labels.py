"""Label arrays against the rules written as loops over token lists."""

import random
import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.functions import labels as L
from cubeloom.functions import tokens as TK
from cubeloom.functions.chat import TEMPLATES, render
from cubeloom.plans.frame_queries import _piece_offsets

DIALOGUE = "id int, turns array<struct<`from`: string, value: string>>"


def ids(text):
    return [int(md5(w.encode()).hexdigest()[:7], 16) % 30_000 + 1 for w in re.findall(TK.PIECES, text)]


def prompt(template, turns):
    return "".join(template.roles[who != "human"] + (value + template.sep if value else "") for who, value in turns)


def by_rounds(template, turns, bos, limit, header):
    text = prompt(template, turns)
    first = [bos] if bos is not None else []
    whole = (first + ids(text))[:limit]
    labels, at = list(whole), 0
    parts = text.split(template.sep)
    rounds = [template.sep.join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    mark = template.sep + template.roles[1]
    for i, one in enumerate(rounds):
        if one == "" or len(one.split(mark)) != 2:
            break
        extra = len(first) if i == 0 else 0
        asked = len(ids(one.split(mark)[0] + mark)) + extra
        labels[at : at + asked] = [L.IGNORE] * len(labels[at : at + asked])
        at += len(ids(one)) + extra + ((len(rounds) > 1) if header else len(ids(template.sep)))
    labels[at:] = [L.IGNORE] * len(labels[at:])
    if (limit is None or at < limit) and at != len(whole):
        labels = [L.IGNORE] * len(labels)
    return whole, labels


def by_role(turns, system, names, bos):
    first = [bos] if bos is not None else []
    said = [f"### {dict(human=names[0], gpt=names[1]).get(who, 'unknown')}: {value}\n" for who, value in turns]
    whole = first + ids(system + "\n\n" + "".join(said) + "### ")
    labels, at = list(whole), len(first) + len(ids(system + "\n\n"))
    labels[:at] = [L.IGNORE] * at
    for (who, _), text in zip(turns, said):
        n = len(first) + len(ids(text))
        if who == "human":
            labels[at + 2 : at + n] = [L.IGNORE] * len(labels[at + 2 : at + n])
        at += n
    return whole, labels


def dialogues(seed=1, n=60):
    r = random.Random(seed)
    texts = ["Yes.", "two words", "", "ends <", "\n\nlines\n", "a<|im_end|>\nb", "é ü", "x" * 40, "<|im_start|>assistant\n", " spaced "]
    return [(i, [("human" if k % 2 == 0 else "gpt", r.choice(texts[: r.choice([3, 10])])) for k in range(r.randrange(1, 8))]) for i in range(n)]


@pytest.mark.parametrize("limit", [None, 40])
@pytest.mark.parametrize("name", ["qwen2", "llama_3_chat"])
def test_rounds_and_headers(spark, name, limit):
    rows, template, header = dialogues(), TEMPLATES[name], name != "qwen2"
    made = L.header_labels(F.col("turns"), template, limit=limit) if header else L.round_labels(F.col("turns"), template, limit=limit)
    got = {r.id: (r.x.ids, r.x.labels) for r in spark.createDataFrame(rows, DIALOGUE).select("id", made.alias("x")).collect()}
    want = {i: by_rounds(template, turns, 1 if header else None, limit, header) for i, turns in rows}
    assert got == want
    assert any(set(labels) - {L.IGNORE} for _, labels in want.values()) and any(set(labels) == {L.IGNORE} for _, labels in want.values())


@pytest.mark.parametrize("name", ["qwen2", "llama_3_chat"])
def test_long_dialogues_are_tokenized_by_rounds(spark, name):
    """The tokenizer stands in the plan once for the prompt, a round, its head and the separator, and a round's work is its own."""
    template, header = TEMPLATES[name], name != "qwen2"
    rows = [(0, [("human" if k % 2 == 0 else "gpt", f"turn {k} says so") for k in range(600)])]
    made = L.header_labels(F.col("turns"), template) if header else L.round_labels(F.col("turns"), template)
    out = spark.createDataFrame(rows, DIALOGUE).select("id", made.alias("x"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 4
    assert {r.id: (r.x.ids, r.x.labels) for r in out.collect()} == {i: by_rounds(template, turns, 1 if header else None, None, header) for i, turns in rows}


@pytest.mark.parametrize("name", ["qwen2", "llama_3_chat"])
def test_only_the_prompt_is_hashed(spark, name):
    """Rounds and their heads are counted, not made into ids once more; another tokenizer's tokens are counted by its own ids."""
    template, header = TEMPLATES[name], name != "qwen2"
    rows, made = dialogues(4), L.header_labels if header else L.round_labels
    own = lambda text: TK.piece_ids(text)
    df = spark.createDataFrame(rows, DIALOGUE).select("id", made(F.col("turns"), template).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    other = spark.createDataFrame(rows, DIALOGUE).select("id", made(F.col("turns"), template, own).alias("x"))
    assert {r.id: r.x for r in df.collect()} == {r.id: r.x for r in other.collect()}


@pytest.mark.parametrize("bos", [None, 7])
def test_roles(spark, bos):
    rows = dialogues(2) + [(900, [("system", "rules"), ("human", "a"), ("gpt", "b")])]
    got = {r.id: (r.x.ids, r.x.labels) for r in spark.createDataFrame(rows, DIALOGUE).select("id", L.role_labels(F.col("turns"), "A chat.", ("Human", "Assistant"), bos=bos).alias("x")).collect()}
    assert got == {i: by_role(turns, "A chat.", ("Human", "Assistant"), bos) for i, turns in rows}


def test_offsets_agree_with_counts(spark):
    """Where every part's tokens stand alone, spans of characters give the labels that counts give; a token over a boundary ignores the row."""
    rows = [(i, t) for i, t in dialogues(3) if len(t) % 2 == 0 and not any("<" in v or not v for _, v in t)]
    qwen = TEMPLATES["qwen2"]
    df = spark.createDataFrame(rows, DIALOGUE).select("id", "turns", render(qwen, F.col("turns"), system="").alias("text"), L.answer_spans(F.col("turns"), qwen).alias("spans"))
    got = {r.id: (r.ids, r.labels) for r in L.offset_labels(df, "id", "text", "spans", _piece_offsets).collect()}
    assert got == {i: by_rounds(qwen, t, None, None, False) for i, t in rows} and got
    whole = L.offset_labels(df, "id", "text", "spans", lambda text: ([5], [0], [len(text)])).collect()
    assert all(r.labels == [L.IGNORE] for r in whole)


def test_merge_of_spans():
    flags = np.array([False, True, False])
    at = lambda *x: np.array(x, np.int64)
    assert L.merged(at(0, 2, 5), at(2, 5, 9), at(2, 5, 9), flags).tolist() == [False, True, False]
    assert L.merged(at(0, 1), at(1, 4), at(2, 5, 9), flags) is None
    assert L.merged(at(0, 9), at(1, 10), at(2, 5, 9), flags) is None
    assert L.merged(at(), at(), at(2, 5, 9), flags).tolist() == []


def test_first_turn_of_the_wrong_side(spark):
    rows = [(1, [("gpt", "x"), ("human", "a"), ("gpt", "b")]), (2, [("human", "a"), ("human", "b")]), (3, [("gpt", "x")])]
    got = {r.id: ([tuple(t) for t in r.t], r.ok) for r in spark.createDataFrame(rows, DIALOGUE).select("id", L.answerable(F.col("turns")).alias("t"), L.alternating(L.answerable(F.col("turns"))).alias("ok")).collect()}
    assert got == {1: ([("human", "a"), ("gpt", "b")], True), 2: ([("human", "a"), ("human", "b")], False), 3: ([], True)}
