"""Structure repair, SimHash and cross-tokenizer alignment against brute force."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from compare import assert_same
from helpers import DOCS, edge_docs, edge_rows, edited, lower, prose, words_of
from tokenizers import Tokenizer

from cubeloom.llm import alignment, queries, repair, simhash

TURNS = "conv_id long, turn long, role string, text string"


# --- repair ---------------------------------------------------------------------------------------


def solve(rows):
    """Cheapest edits of rows (role, text, must, cut) by plain recursion: cost, audit and lines."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    made = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}

    @functools.cache
    def best(i, s, inserted=0):
        out = []
        if i == len(rows):
            if s in (0, 3):
                out.append((0, "", ()))
        else:
            role, text, must, cut = rows[i]
            if x := best(i + 1, s):
                out.append((x[0] + 2, "D" + x[1], x[2]))
            to = step.get((role[:1], s))
            if not must and to is not None and (x := best(i + 1, to)):
                out.append((x[0] + 5 * cut, "K" + x[1], (f"{role}:{text}", *x[2])))
            if not must and (x := best(i + 1, made[s])):
                out.append((x[0] + 1 + 5 * cut, "R" + x[1], (f"{name[made[s]]}:{text}", *x[2])))
        if inserted < 3 and (x := best(i, made[s], inserted + 1)):
            out.append((x[0] + 5, "I" + x[1], (f"{name[made[s]]}:", *x[2])))
        return min(out) if out else None

    return best(0, 0)


def repaired_by_force(rows):
    """rows: (conv_id, turn, role, text) before damage."""
    out, by = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            by[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, listed in by.items():
        listed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], xxhash_signed(r[2])))
        seen, marked, faults = set(), [], Counter()
        for _, role, text in listed:
            kind = "blank" if not words_of(text) else "duplicate" if (role, text) in seen else "truncated" if words_of(text)[-1][-1] not in ".!?" else ""
            seen.add((role, text))
            faults[kind] += 1
            marked.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        turns = {t for t, _, _ in listed if t is not None}
        wrong = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = solve(tuple(marked))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def xxhash_signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def dialogues(seed, n, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "cut off ", " ", "", "\t\n", None, "What? ", "a\xa0", "Fine.\n", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ursa", "S"]
    rows = []
    for conv in range(n):
        rows += [(conv if conv else None, r.choice([t, t, t, t + 1, None]), r.choice(roles[: r.choice([4, 5, 10])]), r.choice(texts)) for t in range(r.randrange(longest))]
    return rows


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c.split()[0]] for c in repair.RESULT.split(", ")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block", [repair.BLOCK_ROWS, 3])
def test_repair_is_the_cheapest(spark, block):
    rows = dialogues(1, 60, 14) + dialogues(2, 3, 60)[::-1]
    df = repair.repair_structure(repair.damaged(spark.createDataFrame(rows, TURNS)), block_rows=block)
    assert got(df) == repaired_by_force(rows)


def test_repair_of_one_dialogue_over_all_partitions(spark):
    rows = dialogues(5, 2, 900) + [(7, t, "user" if t % 2 else "assistant", f"Answer {t % 50}.") for t in range(700)]
    df = repair.repair_structure(repair.damaged(spark.createDataFrame(rows, TURNS).repartition(5)), block_rows=40)
    assert got(df) == repaired_by_force(rows)


def test_repair_of_nothing_and_of_dropped_rows(spark):
    assert repair.repair_structure(repair.damaged(spark.createDataFrame([], TURNS))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "x")], TURNS + ", gone string").drop("gone")
    assert got(repair.repair_structure(repair.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_leaves_compose(monkeypatch):
    r = random.Random(3)
    for _ in range(400):
        codes = bytes(r.choice([0, 1, 2, 3, 1, 2, 5, 6, 9, 10]) for _ in range(r.randrange(30)))
        monkeypatch.setattr(repair, "LEAF", 64)
        whole = repair.solved(codes, 0, repair.TAIL)
        for leaf in (1, 2, 7):
            monkeypatch.setattr(repair, "LEAF", leaf)
            assert repair.solved(codes, 0, repair.TAIL) == whole
            assert repair.led(repair.summary(codes), repair.TAIL)[1][0] == whole[1]


def test_op11_sql(spark, sf_dir, duck):
    assert_same(queries.op11_structure_repair(spark, sf_dir), duck, queries.ORACLE["op11_structure_repair"])


# --- SimHash --------------------------------------------------------------------------------------


def fingerprint(text):
    words = words_of(lower(text or ""))
    found = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(len(words) - 2, min(len(words), 1)))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def linked(values, radius=2):
    """Smallest place reachable over links of values in at most radius bits."""
    low = list(range(len(values)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return [root(i) for i in range(len(values))]


def simhash_by_force(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [fingerprint(t) for _, t in rows]
    with_id = [i for i, r in enumerate(rows) if r[0] is not None]
    comp = linked([prints[i] for i in with_id])
    named = {i: rows[with_id[c]][0] for i, c in zip(with_id, comp)}
    return sorted((str(r[0]), f"{p:016x}", named.get(i)) for i, (r, p) in enumerate(zip(rows, prints)))


def test_simhash(spark):
    rows = edge_rows() + [(1000 + i, edited(prose(600, 3), i % 4, i), "en", "", 0) for i in range(60)]
    df = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect()) == simhash_by_force([r[:2] for r in rows])


def test_simhash_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = queries.op12_simhash(spark, sf_dir)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect()) == simhash_by_force(rows)


def near_values(seed, n, centres, flips):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(centres)]
    return [functools.reduce(lambda v, _: v ^ 1 << r.randrange(64), range(r.randrange(flips)), r.choice(base)) for _ in range(n)]


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_links_of_crowded_buckets(spark, block):
    """Clusters whose members share buckets, in one block and in many."""
    values = sorted(set(near_values(4, 700, 9, 7)) | {0, 2**64 - 1, 1, 2**63})
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fingerprint long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_pairs(nodes, block=block).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    place, low = {v: i for i, v in enumerate(values)}, list(range(len(values)))
    for _ in range(len(values)):
        now = list(low)
        for a, b in links:
            now[place[a]] = now[place[b]] = min(now[place[a]], now[place[b]])
        if now == low:
            break
        low = now
    assert low == linked(values)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_bit_slices_give_the_distances(radius, n):
    values = np.array(near_values(n, n, 3, 6), np.uint64)
    asked = np.array(near_values(n + 1, 70, 3, 6) + [0], np.uint64)
    x, y = simhash.within(asked, simhash.planes(values), radius)
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(values) if int(a ^ b).bit_count() <= radius}


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


# --- alignment ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    a, b = map(queries.vocabulary, queries.ALIGNED_VOCABULARIES)
    own = Tokenizer.from_file(a)
    own.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    return own, sentencepiece.SentencePieceProcessor(model_file=b), letter


def align_by_force(texts, tokenizers):
    own, pieces, letter = tokenizers
    out, held = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = own.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        bytes_a = [bytes(letter[c] for c in own.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        links, groups = Counter(), []
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append([0, 0, 0, 0, ""])
            held.append(links)
            continue
        ends_a, ends_b = np.cumsum([*map(len, bytes_a)]), np.cumsum([*map(len, bytes_b)])
        i = j = 0
        for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            k, m = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.update((x, y) for x in a[i:k] for y in b[j:m])
            i, j = k, m
        out.append([len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        held.append(links)
    count = Counter(p for links in held for p in links)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return [(*o[:4], sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()), o[4]) for o, links in zip(out, held)]


HARD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "▁", "  two  spaces ", "\n\nlines\n \n", "tab\tand\r\nreturn ", "don't they'll I'VE", "é́ ü ß", "日本語のテキスト と 漢字", "🙂🙂👨‍👩‍👧", "\x00\x01 \x1c\x1d x", "a b\xa0c \xa0 d",
    "x" * 3000, " " * 500 + "end", "1234567 89.0e-3 $5", "mixed 한국어 and русский текст", "word　wide", "﻿bom", "a" + " ​ b", "ﬁ ligature Ⅷ ½",
]


def fields(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


@pytest.mark.parametrize("split", [alignment.SPLIT, 1_000])
def test_alignment(spark, tokenizers, split, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 7)
    texts = [r[1] for r in edge_rows()] + HARD + [prose(80, i) for i in range(25)]
    docs = spark.createDataFrame([(i, t, "en", "", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    df = alignment.align(docs, *map(queries.vocabulary, queries.ALIGNED_VOCABULARIES), split=split)
    assert fields(df.orderBy("doc_id")) == align_by_force(texts, tokenizers)


def test_alignment_query(spark, sf_dir, tokenizers):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    assert fields(queries.op13_alignment(spark, sf_dir).orderBy("doc_id")) == align_by_force([r.text for r in docs], tokenizers)


def test_parts_are_the_text(tokenizers):
    """Parts of a few characters give the whole's ids, and tiktoken's core those of the tokenizer's own library."""
    own = alignment.load(*map(queries.vocabulary, queries.ALIGNED_VOCABULARIES))
    assert own.apart and own.fast is not None
    r = random.Random(8)
    letters = ["a", "b ", " ", "\n", "▁", "\xa0", "é", "'s", "1", ".", "日", "\t", "\x1c", "\x85", "\u2028", "я", "ʼ", "½", "'ll", "A", "한", "\u200b", "\ufeff"]
    for _ in range(6000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 25)))
        parts = own.parts(text, 3)
        assert "".join(parts) == " " + text
        whole = own.whole.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in own.ids_a(p)] == whole and own.ids_a(" " + text) == whole
        assert [i for p in parts for i in own.pieces.encode(p[1:])] == own.pieces.encode(text)


def test_large_groups(tokenizers, monkeypatch):
    """Groups beyond the bound, and links expanded piece by piece."""
    own = alignment.load(*map(queries.vocabulary, queries.ALIGNED_VOCABULARIES))
    texts = ["  " * 40 + "end", "日本語" * 30, prose(50, 1), "", "x▁y", " " * 33, prose(20, 2)]
    want = alignment.aligned(texts, own)
    for bound in (64, 640):
        monkeypatch.setattr(alignment, "EXPANDED", bound)
        got = alignment.aligned(texts, own)
        assert got[0] == want[0] and all((x == y).all() for x, y in zip(got[1], want[1]))


def test_alignment_of_nothing(spark):
    paths = [*map(queries.vocabulary, queries.ALIGNED_VOCABULARIES)]
    assert alignment.align(spark.createDataFrame([], DOCS), *paths).count() == 0
    empty = alignment.align(spark.createDataFrame([(None, None, None, None, None)], DOCS), *paths).collect()
    assert [tuple(r) for r in empty] == [(None, 0, 0, 0, 0, 0, 0, "")]
    assert edge_docs(spark).count() == len(edge_rows())
