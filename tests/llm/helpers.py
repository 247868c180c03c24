"""Fixtures with the cases that every operator must handle: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random
import re

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "rd", "st", "ve", "x", "la", "mo")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", ".", ","]) for _ in range(n))


def edited(text, n, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
    return " ".join(w)


def edge_texts():
    base = prose(120, 1)
    return [
        None, "", " ", "\n\n", "one", "One", "two words", base, base, base.upper(), edited(base, 3, 2), edited(base, 9, 3), edited(base, 40, 4),
        prose(30_000, 5), "é" * 50, "a\xa0b \x1c c\x85d", "x " * 60, ("shared line of words\n" * 3) + prose(60, 6), prose(60, 7) + "\nSHARED line of words \n",
    ]


def edge_rows():
    rows = [(i * 3 + 1, t, "en", "src0", len(t or "")) for i, t in enumerate(edge_texts())]
    return rows + [rows[7], (None, "no id but text of some length", "en", None, 3), (None, None, None, None, None)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)
