"""Repair of a dialogue's structure: the cheapest edits that give an optional system turn, then pairs of user and assistant.

Edits of a row: keep it (0), give it the role user or assistant (1), delete it (2; blank rows and
repeated ones must go). An empty user or assistant turn may be inserted anywhere (5), and a truncated
row that stays costs 5 more. Of the cheapest repairs that with the ASCII-least audit is taken: the
edits' initials D, I, K, R in order.

Method: cost layers in the manner of Wu and Manber. The grammar has four states; for each cost c and
each row, a bitset holds the states from which the rest can be finished at cost c or less. A layer
follows from those below it by table lookups, and the first one that holds the start gives the cost.
The audit is read off the bits from the front: the least edit after which the bit is still set.

Long dialogues are cut in leaves. Inserts stand before a row, so that a leaf's audit is never the
beginning of another's; a leaf is then known by the cost of each pair of states at its ends and by
the order of the audits of the pairs with an equal beginning, and such summaries are composed.

Tables are sorted by range partitions of (conversation, turn). A dialogue that begins and ends inside
a partition is repaired there. The others, two for each partition at most, and those longer than a
block, are repaired in blocks: repeated rows by a grouping on hashed rows, summaries of all blocks in
parallel, one stream of summaries from each dialogue's end for what each block should lead to, one
from its beginning for the state that each block starts in, then the blocks' edits in parallel. The
repaired text's hash is a chain by its definition: blocks pass through one task, one at a time.

Defined results: rows are ordered by turn, nulls first; equal turns by role, then by the text's XXH64.
Null roles and texts are one space, which makes a role without a place in the grammar, as an empty
role is; other roles count by their first letter. Rows with a null conv_id form one dialogue. Equal
rows are rows of their own, of which the later ones are duplicates. A dialogue without rows left has
zeros, an empty audit and the hash of the empty text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows in a leaf, rows and characters in a block of a long dialogue.
LEAF, BLOCK_ROWS, BLOCK_CHARS = 64, 16_384, 16_000_000
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SOLID = r"[^\x20\x09-\x0D]"
_solid = re.compile(SOLID)
SPACE = " \t\n\v\f\r"
#: A row's code: its role's class in the lower two bits, then 0, MUST_GO or CUT.
CLASSES, OTHER, MUST_GO, CUT = "sua", 3, 4, 8
#: States: nothing yet, after the system turn, after a user, after an assistant (the first and last accept); what a class leads to.
STEP = [[1, None, None, None], [2, 2, None, 2], [None, None, 3, None], [None] * 4]
#: The state after a user or assistant turn that is made, and the cost of inserts from each state to the end.
NEXT, TAIL = [2, 2, 3, 2], [0, 2 * INSERT, INSERT, 0]
#: For each bitset of states, the states that lead into it by a row that is kept (by class) or made.
_INTO = [[sum(1 << s for s in range(4) if STEP[k][s] is not None and bits >> STEP[k][s] & 1) for bits in range(16)] for k in range(4)]
_MADE = [sum(1 << s for s in range(4) if bits >> NEXT[s] & 1) for bits in range(16)]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Layers = list[list[int]]


def layers(codes: bytes, ends: list[int | None], wanted: int) -> Layers:
    """For each cost and row, the states from which ``ends`` is reached; ends has each last state's own cost. Goes on until all wanted states start."""
    n, out = len(codes), []
    none = [0] * (n + 1)
    while not out or out[-1][0] & wanted != wanted:
        c = len(out)
        one, two, five, six = (out[c - w] if c >= w else none for w in (RENAME, DELETE, INSERT, RENAME + TRUNCATED))
        bits = sum(1 << s for s, cost in enumerate(ends) if cost is not None and cost <= c)
        layer = [bits] * (n + 1)
        for i in range(n - 1, -1, -1):
            code = codes[i]
            if code < MUST_GO:
                bits = _INTO[code][bits] | _MADE[one[i + 1]] | two[i + 1] | _MADE[five[i]]
            elif code < CUT:
                bits = two[i + 1] | _MADE[five[i]]
            else:
                bits = two[i + 1] | _MADE[five[i]] | _INTO[code - CUT][five[i + 1]] | _MADE[six[i + 1]]
            layer[i] = bits
        out.append(layer)
    return out


def cost_of(found: Layers, state: int) -> int | None:
    return next((c for c, layer in enumerate(found) if layer[0] >> state & 1), None)


def traced(codes: bytes, found: Layers, state: int) -> tuple[str, int]:
    """The least audit from ``state`` over all rows, and the state that it ends in."""
    left, i, audit = cost_of(found, state), 0, []
    holds = lambda cost, row, s: cost >= 0 and s is not None and found[cost][row] >> s & 1
    while i < len(codes):
        code = codes[i]
        stay = TRUNCATED if code >= CUT else 0
        kept = None if MUST_GO <= code < CUT else STEP[code % 4][state]
        if holds(left - DELETE, i + 1, state):
            edit, left, to = "D", left - DELETE, state
        elif holds(left - INSERT, i, NEXT[state]):
            edit, left, to = "I", left - INSERT, NEXT[state]
        elif holds(left - stay, i + 1, kept):
            edit, left, to = "K", left - stay, kept
        else:
            edit, left, to = "R", left - stay - RENAME, NEXT[state]
        audit.append(edit)
        i, state = i + (edit != "I"), to
    return "".join(audit), state


#: Costs from each state to each, None where there is no way, and the order of the ways' audits among those with the same beginning.
Summary = tuple[list[list[int | None]], list[list[int]]]
EMPTY: Summary = ([[0 if s == t else None for t in range(4)] for s in range(4)], [[0] * 4 for _ in range(4)])


def _ordered(ways: list[list]) -> list[list[int]]:
    return [[sorted(set(w for w in row if w is not None)).index(w) if w is not None else 0 for w in row] for row in ways]


def reaches(codes: bytes) -> list[int]:
    """For each last state, the first states that some edits lead to it from."""
    return [1, 2 | any(c % 4 == 0 and not MUST_GO <= c < CUT for c in codes), 15, 15]


def leaf(codes: bytes) -> Summary:
    ends = [[0 if s == t else None for s in range(4)] for t in range(4)]
    found = [layers(codes, ends[t], wanted) for t, wanted in enumerate(reaches(codes))]
    cost = [[cost_of(found[t], s) for t in range(4)] for s in range(4)]
    return cost, _ordered([[None if cost[s][t] is None else traced(codes, found[t], s)[0] for t in range(4)] for s in range(4)])


def composed(a: Summary, b: Summary) -> Summary:
    cost, ways = [[None] * 4 for _ in range(4)], [[None] * 4 for _ in range(4)]
    for s in range(4):
        for t in range(4):
            options = [(a[0][s][m] + b[0][m][t], a[1][s][m], b[1][m][t]) for m in range(4) if a[0][s][m] is not None and b[0][m][t] is not None]
            if options:
                cost[s][t], *ways[s][t] = min(options)
    return cost, _ordered([[None if w is None else tuple(w) for w in row] for row in ways])


def led(one: Summary, after: list[int | None]) -> tuple[list[int | None], list[int]]:
    """Costs to the end from each first state, and the last state that it should lead to, if ``after`` is what the last states cost."""
    costs, to = [None] * 4, [0] * 4
    for s in range(4):
        options = [(one[0][s][t] + after[t], one[1][s][t], t) for t in range(4) if one[0][s][t] is not None and after[t] is not None]
        if options:
            costs[s], _, to[s] = min(options)
    return costs, to


def summary(codes: bytes) -> Summary:
    out = EMPTY
    for lo in range(0, len(codes), LEAF):
        out = composed(out, leaf(codes[lo : lo + LEAF]))
    return out


def solved(codes: bytes, state: int, ends: list[int | None]) -> tuple[str, int]:
    """The audit of the cheapest edits from ``state``, without inserts behind the last row, and the state that they end in."""
    parts = [codes[lo : lo + LEAF] for lo in range(0, len(codes), LEAF)]
    after = [ends]
    for part in reversed(parts[1:]):
        costs = led(leaf(part), after[-1])[0]
        low = min(c for c in costs if c is not None)
        after.append([None if c is None else c - low for c in costs])
    audit = ""
    for part, end in zip(parts, reversed(after)):
        # The least audit to the whole end is the least one of this leaf first.
        piece, state = traced(part, layers(part, end, 1 << state), state)
        audit += piece
    return audit, state


def coded(roles: list[str], texts: list[str], seen) -> tuple[bytes, list[int]]:
    """Codes of rows, and how many are blank, duplicate and truncated. seen(role, text) says whether the row was there before."""
    codes, faults = bytearray(), [0, 0, 0]
    for role, text in zip(roles, texts):
        code = CLASSES.find(role[0]) if role else OTHER
        code = OTHER if code < 0 else code
        if not _solid.search(text):
            fault, code = 0, code | MUST_GO
        elif seen(role, text):
            fault, code = 1, code | MUST_GO
        elif text.rstrip(SPACE)[-1] not in ".!?":
            fault, code = 2, code | CUT
        else:
            fault = None
        if fault is not None:
            faults[fault] += 1
        codes.append(code)
    return bytes(codes), faults


def illegal(codes: bytes) -> int:
    return sum((a % 4, b % 4) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """role:text of each turn of the repaired dialogue."""
    made = {2: "user", 3: "assistant"}
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(f"{made[state]}:")
            continue
        if edit == "K":
            state = STEP[CLASSES.index(roles[i][0])][state]
            out.append(f"{roles[i]}:{texts[i]}")
        elif edit == "R":
            state = NEXT[state]
            out.append(f"{made[state]}:{texts[i]}")
        i += 1
    return out


def audit_cost(audit: str, codes: bytes) -> int:
    stays = sum(c >= CUT and e != "D" for c, e in zip(codes, audit.replace("I", "")))
    return INSERT * audit.count("I") + DELETE * audit.count("D") + RENAME * audit.count("R") + TRUNCATED * stays


def _memory():
    before: set[tuple[str, str]] = set()

    def seen(role: str, text: str) -> bool:
        n = len(before)
        before.add((role, text))
        return len(before) == n

    return seen


def repair(turns: list[int | None], roles: list[str], texts: list[str]) -> list:
    """The values of RESULT for one dialogue's rows in order."""
    codes, faults = coded(roles, texts, _memory())
    audit, state = solved(codes, 0, TAIL)
    lines = repaired(audit, 0, roles, texts)
    for _ in range(TAIL[state] // INSERT):
        audit, state = audit + "I", NEXT[state]
        lines += repaired("I", {2: 0, 3: 2}[state], [], [])
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return [gaps, *faults, illegal(codes), audit_cost(audit, codes), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults put in by crc32 of conv_id:turn modulo 20: gone (dropped) is a column, the others change or repeat the row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = turns.withColumn("_fault", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20)
    body = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    out = out.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(F.col("_fault") == 4, "user").otherwise(text("role")).alias("role"), body.alias("text"), (F.col("_fault") == 0).alias("gone"), "_fault")
    return out.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fault", "_copy")


class _Block:
    """Rows of one dialogue in the order of the stream."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.chars = [], [], [], 0

    def add(self, turn, role, text, gone) -> None:
        if not gone:
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)

    def full(self, rows: int, chars: int) -> bool:
        return len(self.turns) >= rows or self.chars >= chars


_FIRST = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
                   + [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")])


def _first_pass(rows: int, chars: int):
    """Sorted rows in; dialogues that lie inside the partition repaired, the others' blocks as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        block, at, now, number, edge = _Block(), None, None, 0, True

        def close(last: bool) -> None:
            nonlocal block, number
            if edge or last:
                done.append([now, (at << 40) + number, block.turns, block.roles, block.texts, *[None] * 8])
            else:
                done.append([now, None, None, None, None, *repair(block.turns, block.roles, block.texts)])
            block, number = _Block(), number + 1

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _FIRST)], schema=_FIRST)
            done.clear()
            return out

        for batch in batches:
            for part, conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None:
                    at, now = part, conv
                elif conv != now:
                    close(False)
                    now, edge = conv, False
                elif block.full(rows, chars):
                    edge = True
                    close(False)
                block.add(turn, role, text, gone)
                if done and (len(done) >= 2000 or done[-1][1] is not None):
                    yield flushed()
        if at is not None:
            close(True)
        if done:
            yield flushed()

    return run


_KEYS = ["cid", "block"]


def _row_key(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _streamed(df: DataFrame, function, schema: str, descending: bool = False) -> DataFrame:
    """function over df's rows, each dialogue's blocks in order in one task, one at a time in memory."""
    by = F.col("block").desc() if descending else F.col("block")
    return df.repartition("cid").sortWithinPartitions("cid", by).mapInArrow(function, schema)


def _lists(flat: list[int | None], n: int = 4) -> list[list[int | None]]:
    return [flat[i : i + n] for i in range(0, len(flat), n)]


def _coded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cid, block, roles, texts, before in zip(*(c.to_pylist() for c in batch.columns)):
            known, own = set(before or ()), _memory()
            codes, faults = coded(roles, texts, lambda role, text: own(role, text) or (bool(known) and _row_key(role, text) in known))  # noqa: B023
            cost, order = summary(codes)
            yield pa.RecordBatch.from_pydict({"cid": [cid], "block": [block], "codes": [codes], "faults": [faults], "cost": pa.array([sum(cost, [])], pa.list_(pa.int64())), "ways": pa.array([sum(order, [])], pa.list_(pa.int64()))})


def _toward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each dialogue's last block to its first: what the block should lead to."""
    now, after = None, TAIL
    for batch in batches:
        out = []
        cids = batch.column(0).to_pylist()
        for cid, cost, ways in zip(cids, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if cid != now:
                now, after = cid, TAIL
            after, to = led((_lists(cost), _lists(ways)), after)
            out.append(to)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["cid", "block", "to"])


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each dialogue's first block to its last: the states that the block begins and ends in."""
    now, state = None, 0
    for batch in batches:
        starts, ends = [], []
        for cid, to in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if cid != now:
                now, state = cid, 0
            starts.append(state)
            state = to[state]
            ends.append(state)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["cid", "block", "start", "end"])


def _edited_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cid, block, conv, turns, roles, texts, codes, faults, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            audit, _ = solved(codes, start, [0 if s == end else None for s in range(4)])
            lines = repaired(audit, start, roles, texts)
            known = [t for t in turns if t is not None]
            said = "\n".join(lines).encode() if lines else None
            low, high = (known[0], known[-1]) if known else (None, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([cid]), pa.array([block]), pa.array([conv], pa.int64()), pa.array([said], pa.binary()), pa.array([audit]), pa.array([audit_cost(audit, codes)]), pa.array([faults], pa.list_(pa.int64())),
                 pa.array([illegal(codes)]), pa.array([codes[:1] + codes[-1:]], pa.binary()), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([len(set(known))]), pa.array([end])],
                ["cid", "block", "conv_id", "said", "audit", "cost", "faults", "illegal", "edges", "low", "high", "turns", "end"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each dialogue's blocks in order to its result."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    now = None

    def result() -> pa.RecordBatch:
        audit = now["audit"]
        state = now["end"]
        for _ in range(TAIL[state] // INSERT):
            state = NEXT[state]
            now["hash"].update((b"\n" if now["any"] else b"") + (b"user:" if state == 2 else b"assistant:"))
            now["any"], now["cost"] = True, now["cost"] + INSERT
            audit.append("I")
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
        values = [gaps, *now["faults"], now["illegal"], now["cost"], "".join(audit), now["hash"].hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([now["conv_id"]], pa.int64()), *(pa.array([v]) for v in values)], ["conv_id", *names])

    for batch in batches:
        for cid, _, conv, said, audit, cost, faults, wrong, edges, low, high, turns, end in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now["cid"] != cid:
                if now is not None:
                    yield result()
                now = {"cid": cid, "conv_id": conv, "hash": hashlib.sha256(), "any": False, "audit": [], "cost": 0, "faults": [0, 0, 0], "illegal": 0, "last": b"", "low": None, "high": None, "turns": 0}
            if said is not None:
                now["hash"].update(b"\n" + said if now["any"] else said)
                now["any"] = True
            now["audit"].append(audit)
            now["cost"] += cost
            now["faults"] = [a + b for a, b in zip(now["faults"], faults)]
            now["illegal"] += wrong + illegal(now["last"] + edges[:1])
            now["last"] = edges[-1:] or now["last"]
            if low is not None:
                now["turns"] += turns - (low == now["high"])
                now["low"], now["high"] = low if now["low"] is None else now["low"], high
            now["end"] = end
    if now is not None:
        yield result()


def repair_structure(turns: DataFrame, scratch: Scratch | None = None, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """conv_id and the columns of RESULT for every dialogue of turns: conv_id, turn, role, text and, if there, gone (rows that only say that the dialogue exists)."""
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark, "repair")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    space: Column = F.lit(" ")
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), gone.alias("gone"))
    rows = rows.select("*", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_i"))
    by = ["conv_id", "turn", "role", "_h", "_i"]  # equal rows may be dealt to several partitions
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "turn", "role", "text", "gone")
    first = "conv_id long, block long, turns array<long>, roles array<string>, texts array<string>, " + RESULT
    first = scratch.save(placed.mapInArrow(_first_pass(block_rows, block_chars), first), "first")
    names = [c.split()[0] for c in RESULT.split(", ")]
    blocks = first.where("block IS NOT NULL").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("cid"), "block", "conv_id", "turns", "roles", "texts")
    each = blocks.select("cid", "block", F.explode(F.arrays_zip("roles", "texts")).alias("t")).where(F.col("t.texts").rlike(SOLID))
    key = F.unhex(F.sha2(F.concat(F.length("t.roles").cast("string"), F.lit(":"), "t.roles", "t.texts"), 256)).alias("key")
    keys = each.select("cid", "block", key).distinct()
    firsts = keys.groupBy("cid", "key").agg(F.min("block").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = keys.join(firsts, ["cid", "key"]).where("block > first").groupBy(*_KEYS).agg(F.collect_list("key").alias("before"))
    summaries = blocks.join(later, _KEYS, "left").select("cid", "block", "roles", "texts", "before").mapInArrow(_coded_blocks, "cid string, block long, codes binary, faults array<long>, cost array<long>, ways array<long>")
    summaries = scratch.save(summaries, "summaries")
    toward = _streamed(summaries.select("cid", "block", "cost", "ways"), _toward, "cid string, block long, to array<long>", descending=True)
    states = _streamed(toward, _entered, "cid string, block long, start long, end long")
    edited = blocks.join(summaries.select("cid", "block", "codes", "faults"), _KEYS).join(states, _KEYS)
    edited = edited.select("cid", "block", "conv_id", "turns", "roles", "texts", "codes", "faults", "start", "end").mapInArrow(
        _edited_blocks, "cid string, block long, conv_id long, said binary, audit string, cost long, faults array<long>, illegal long, edges binary, low long, high long, turns long, end long"
    )
    return first.where("block IS NULL").select("conv_id", *names).unionByName(_streamed(edited, _joined, f"conv_id long, {RESULT}"))
