"""Packing, byte-level BPE, repetition rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from helpers import DOCS, edge_docs, edge_rows, prose, words_of
from pyspark.sql import functions as F

from cubeloom.llm import bpe, packing, queries, repetition, wordbpe

WORD_FILE, BYTE_FILE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def plain_ids(texts, literals=True):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_FILE)
    t.encode_special_tokens = not literals
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_ids_equal_the_tokenizer():
    r = random.Random(4)
    texts = [prose(50, i) for i in range(20)] + ["<|endoftext|> it's ΑΣ Σ İ ǅ 10½ 中文 \U0001f600", "x" * 5000, "'LL 'll don't", "hello <|startoftext|> there", "a<|endoftext|>b<|startoftext|>", "<|StartOfText|> é<|endoftext|>", "<|endoftext|"]
    texts += ["".join(r.choice([chr(r.randrange(32, 127)), chr(r.randrange(0xA0, 0x250)), chr(r.choice([0x1C, 0x85, 0x3000, 0x301, 0x212B, 0x4E2D])), "a", " "]) for _ in range(40)) for _ in range(500)]
    for literals in (True, False):
        own = wordbpe.load(WORD_FILE, literals)
        assert own.fast
        for t, ids in zip(texts, plain_ids(texts, literals)):
            assert own.encode(t) == np.array(ids, "<u4").tobytes(), t
    assert np.frombuffer(wordbpe.load(WORD_FILE).encode("hello <|startoftext|> there"), "<u4").tolist() == [3306, 49406, 997]


def test_packing_pieces(spark):
    docs = edge_docs(spark).repartition(3)
    rows = packing.pack(docs, WORD_FILE, length=256).collect()
    want = sorted(((r[0], [*ids, 1]) for r, ids in zip(edge_rows(), plain_ids([r[1] for r in edge_rows()]))), key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, pieces in sequences.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0 and len(p.ids) == 4 * p.length
            at += p.length
        assert at == 256 or k == len(sequences) - 1
    stream = b"".join(bytes(p.ids) for k in sorted(sequences) for p in sorted(sequences[k], key=lambda p: p.offset))
    got, begin = [], 0
    ids = np.frombuffer(stream, "<u4").tolist()
    firsts = [p for k in sorted(sequences) for p in sorted(sequences[k], key=lambda p: p.offset) if p.start == 0]
    for p in firsts:
        got.append((p.doc_id, ids[begin : begin + p.doc_tokens]))
        begin += p.doc_tokens
    assert sorted(got, key=str) == want


def test_packing_query_and_empty(spark, sf_dir):
    rows = queries.op3_packing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = dict(zip(texts, ([*x, 1] for x in plain_ids(texts.values()))))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids[r.doc_id])
    assert packing.pack(spark.createDataFrame([], DOCS), WORD_FILE).count() == 0


def plain_tiktoken():
    return bpe.encoding(BYTE_FILE, P.PATTERN)


@pytest.mark.parametrize("text", ["", "a", prose(3000, 1), "x" * 30_000, "ab \n\n  c" * 2000, " " * 5000 + "x", "日本語 テキスト　です" * 500, "a\x1cb\x85 c" * 900])
def test_bpe_cuts_change_nothing(text):
    assert bpe.encode(text, BYTE_FILE, P.PATTERN, size=100) == plain_tiktoken().encode_ordinary(text)


def test_bpe_long_white_space():
    run = bpe.RUN * 12
    text = "word" + " " * run + "x" + "\n" * run
    ids = bpe.encode(text, BYTE_FILE, P.PATTERN)
    assert plain_tiktoken().decode_bytes(ids) == text.encode()
    # A shorter run, which the library can take, gives the same kind of cut.
    short = "word" + " " * bpe.RUN + "x" + "\n" * bpe.RUN
    assert bpe.encode(short, BYTE_FILE, P.PATTERN, size=10) == plain_tiktoken().encode_ordinary(short)


def test_bpe_round_trip(spark):
    rows = bpe.encode_decode(edge_docs(spark), BYTE_FILE, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((r[1] or "").encode() for r in edge_rows())
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), BYTE_FILE, P.PATTERN).count() == 0


def test_bpe_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_byte_bpe(spark, sf_dir).collect():
        ids = plain_tiktoken().encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def shared_words(words, i, j):
    return next((k for k in range(len(words)) if max(i, j) + k >= len(words) or words[i + k] != words[j + k]), len(words))


@pytest.mark.parametrize("least", [1, 4])
def test_suffix_arrays_against_brute_force(least):
    r = random.Random(8)
    depths = {d: (2, 3) for d in (1, 2, 3, 5, 8, 13)}
    for _ in range(150):
        texts = [[r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 30))] for _ in range(r.randint(1, 5))]
        of = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = repetition.Repeats(np.array([ord(c) for t in texts for c in t], np.int64), of, depths, least)
        for times in (2, 3):
            want = [[sorted([0, 0, *(shared_words(t, i, j) for j in range(len(t)) if j != i)])[1 - times] for i in range(len(t))] for t in texts]
            for d in depths:
                assert got.places(d, times).tolist() == [x >= d for w in want for x in w], (texts, d)
            assert got.longest[times].tolist() == [m if (m := max(w, default=0)) >= least else 0 for w in want]


def test_a_very_long_text_takes_memory_in_proportion():
    import tracemalloc

    r = np.random.default_rng(4)
    words = np.array([f"w{i:05d}" for i in range(50_000)])
    for text in (" ".join(words[r.integers(len(words), size=1_000_000)]), "same words again " * 400_000):
        data = np.frombuffer(text.encode(), np.uint8)
        tracemalloc.start()
        found = repetition.measure(data, np.array([0, len(data)]))
        assert tracemalloc.get_traced_memory()[1] < 30 * len(data) + 60_000_000
        tracemalloc.stop()
        assert found["longest_repeat"][0] == (1_199_997 if text[0] == "s" else 0)


def test_span_hashes_piece_by_piece(monkeypatch):
    from cubeloom.llm import textvec

    r = np.random.default_rng(1)
    data = r.integers(0, 256, 3000).astype(np.uint8)
    cuts = np.unique(np.concatenate([[0, 700, 3000], r.integers(0, 3000, 40)]))
    cuts = cuts[(cuts <= 300) | (cuts >= 700)]
    whole = textvec.span_hashes(data, cuts[:-1], cuts[1:])
    monkeypatch.setattr(textvec, "PIECE", 64)
    assert textvec.span_hashes(data, cuts[:-1], cuts[1:]).tolist() == whole.tolist()


def base_rules(text):
    words, seen, dup, windows = words_of(text), set(), 0, {}
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in repetition.SYMBOLS), dup, len(repeated)


def test_rules_on_edges(spark):
    rows = repetition.rules(edge_docs(spark).withColumn("kept", F.lit("clash")), ["doc_id", "text", "kept"]).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        base = base_rules(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.kept and r.base_failed)
    assert repetition.rules(spark.createDataFrame([], DOCS)).count() == 0


def test_rules_verdict(spark):
    clean, passage = prose(400, 9), prose(200, 10)
    texts = [clean, " ".join([prose(20, 11)] * 20), clean + " " + passage + " " + prose(50, 13) + " " + passage, clean + " " + prose(15, 14) + " " + prose(50, 15) + " " + prose(15, 14)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.kept for r in repetition.rules(df).collect()} == {0: True, 1: False, 2: False, 3: True}


def test_rules_judge_short_repeats(spark):
    line, lines = prose(19, 20), [prose(15, 40 + i) for i in range(10)]
    texts = [
        " ".join(f"{line} {prose(21, 60 + i)}" for i in range(10)),  # 19 words ten times in 400
        " ".join(f"{x} {prose(30, 80 + i)}" for i, x in enumerate(lines + lines)),  # ten pairs
        f"{prose(17, 21)} {prose(60, 22)} {prose(17, 21)}",  # the first line is the last
        " ".join(f"{prose(7, 23)} {prose(33, 24 + i)}" for i in range(10)),
    ]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in repetition.rules(df).collect()}
    assert {i: r.kept for i, r in got.items()} == {0: False, 1: False, 2: True, 3: True} and not any(r.base_failed for r in got.values())
    assert got[0].covered_words >= 190 and got[0].longest_repeat >= 19 and got[1].covered_words >= 300 and got[2].covered_words == 34 and got[3].covered_words == 72


def repeated_windows(words, n):
    """Words in n-word windows that occur twice, the union of all repeats of n words or more."""
    at = {}
    for i in range(len(words) - n + 1):
        at.setdefault(tuple(words[i : i + n]), []).append(i)
    return {i + k for places in at.values() if len(places) > 1 for i in places for k in range(n)}


def test_rules_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9_repetition(spark, sf_dir).collect():
        base = base_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        words = words_of(texts[r.doc_id])
        assert r.covered_words == len(repeated_windows(words, repetition.MIN_REPEAT))
        if r.longest_repeat:
            assert r.longest_repeat >= repetition.MIN_REPEAT and repeated_windows(words, r.longest_repeat)
        assert not repeated_windows(words, max(r.longest_repeat, repetition.MIN_REPEAT - 1) + 1)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert r.kept == (not failed and r.covered_words <= 40 + 0.25 * base[0] and r.longest_repeat <= 100)


def thue_morse(n, letters="ab"):
    """A word of 2**n letters and its complement, which sums of powers of an odd number take for one another."""
    bits = [i.bit_count() % 2 for i in range(2**n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [10, 11, 12])
def test_words_and_lines_that_hashes_confuse(spark, n):
    a, b = thue_morse(n)
    c, d = thue_morse(n, "a ")
    texts = [f"{a}\n{b}", f"{a} {b} {a} {b} x", f"{c}\n{d}", f"{a} {a} {a} {b} {b} {b}"]
    rows = {r.doc_id: r for r in repetition.rules(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == base_rules(t)
