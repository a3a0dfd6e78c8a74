"""Repair of conversation structure by shortest paths.

A conversation's rows are edited so that its roles read `(s?(ua)+)?` (initials of
system, user, assistant): keep (0), rerole to user or assistant (2), delete (3, a
must for blank and duplicate rows), insert an empty user or assistant turn (2);
a truncated row that stays adds 1. Nodes are (rows consumed, state of the
pattern's automaton). Costs are small integers, so distances to the end are found
by Dial's queue: a bucket for each distance, emptied in turn. They are recorded,
and the audit is walked from the start over tight arcs (cost = difference of
distances), always by the least letter: D, I, K, R. From a node each letter leads
to one place, so this is the least audit of the cheapest.

Rows are range-partitioned and sorted by conversation and turn, and each partition
is one pass over its conversations. One that crosses partitions is solved in pieces: a
piece tells the distances between its 4 entry and 4 exit states, the few
pieces' graph is solved like the conversation itself, and with the distances at
its exit each piece is walked alone. So no conversation need fit one task; two
pieces a partition at most go to the driver, whatever the data.

Defined cases: a null role or text is one space; a null turn sorts first; equal
turns sort by the first 64 code points of role and text, then by all of them;
a null conv_id is a conversation of its own; repeated rows count each (all but the
first are duplicates), held as one row with a count until they are listed; roles and texts of any length
are whole; an empty table gives no rows; other columns are not read.
The operator's steps are rows, a repaired conversation's digest (in the query) is
one sequential hash, for which its texts are put together in one row."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Sorted rows of one partition, counted before they are dealt.
PART_ROWS = 100_000
PREFIX = 64

#: States: nothing yet, after system, after user, after assistant. What each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTING = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: A row's kind in one byte: must go, or initial (s, u, a, other) and whether truncated.
MUST_GO, LETTERS = 0, "sua"
FAR = 1 << 60


def _arcs(kind: int) -> list[list[tuple[str, int, int]]]:
    """(letter, next state, cost) over one row of this kind, by state and in order of letters."""
    out = []
    for state in range(4):
        arcs = [("D", state, DELETE)]
        if kind != MUST_GO:
            which, more = divmod(kind - 1, 2)
            letter = LETTERS[which] if which < 3 else None
            if letter in NEXT[state]:
                arcs.append(("K", NEXT[state][letter], KEEP + more * TRUNCATED))
            arcs += [("R", to, REROLE + more * TRUNCATED) for x, to in NEXT[state].items() if x in NAMES]
        out.append(arcs)
    return out


ARCS = [_arcs(kind) for kind in range(9)]
INSERTS = [[("I", to, INSERT) for x, to in NEXT[state].items() if x in NAMES] for state in range(4)]


def _reversed(arcs: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int]]]:
    back: list[list[tuple[int, int]]] = [[] for _ in range(4)]
    for state, out in enumerate(arcs):
        for _, to, cost in out:
            back[to].append((state, cost))
    return back


BACK, BACK_INSERTS = [_reversed(a) for a in ARCS], _reversed(INSERTS)


def distances(kinds: bytes, ends: tuple[int, ...], last: bool = True) -> np.ndarray:
    """[rows + 1, 4] least costs to the end, where the states' own distances are `ends`.
    If more rows follow, inserts after the last row are left to the next piece."""
    n = len(kinds)
    known = np.full((n + 1) * 4, FAR, np.int64)
    flat = memoryview(known)
    buckets: dict[int, list[int]] = defaultdict(list)
    for state, d in enumerate(ends):
        if d < FAR:
            buckets[d].append(n * 4 + state)
    at = min(buckets, default=0)
    while buckets:
        bucket = buckets.get(at)
        if bucket is None:
            at = min(buckets)  # a gap only between the given distances, of which there are four
            continue
        for node in bucket:  # grows while arcs without cost are followed
            if flat[node] <= at:
                continue
            flat[node] = at
            row, state = divmod(node, 4)
            if row < n or last:
                for before, cost in BACK_INSERTS[state]:
                    if flat[row * 4 + before] > at + cost:
                        buckets[at + cost].append(row * 4 + before)
            if row:
                for before, cost in BACK[kinds[row - 1]][state]:
                    if flat[row * 4 - 4 + before] > at + cost:
                        buckets[at + cost].append(row * 4 - 4 + before)
        del buckets[at]
        at += 1
    return known.reshape(n + 1, 4)


def walk(kinds: bytes, known: np.ndarray, state: int, last: bool = True) -> tuple[str, int]:
    """The least audit along tight arcs from a state, and the state at the end."""
    n, row, audit = len(kinds), 0, []
    left = known.tolist()
    while True:
        options = [(x, row, to, c) for x, to, c in INSERTS[state]] if row < n or last else []
        if row < n:
            options += [(x, row + 1, to, c) for x, to, c in ARCS[kinds[row]][state]]
        for letter, to_row, to, cost in sorted(options):
            if left[to_row][to] + cost == left[row][state]:
                audit.append(letter)
                row, state = to_row, to
                break
        else:
            return "".join(audit), state


GOAL = tuple(0 if s in ACCEPTING else FAR for s in range(4))


@lru_cache(maxsize=100_000)
def _short(kinds: bytes) -> str:
    return walk(kinds, distances(kinds, GOAL), START)[0]


def solve(kinds: bytes) -> str:
    """The audit of a whole conversation; those of few rows are often alike, so they are remembered."""
    return _short(kinds) if len(kinds) <= 64 else walk(kinds, distances(kinds, GOAL), START)[0]


def crossing(kinds: bytes) -> list[list[int]]:
    """Costs between a piece's entry and exit states, for a piece that isn't the last."""
    columns = [distances(kinds, tuple(0 if s == end else FAR for s in range(4)), False)[0] for end in range(4)]
    return [[int(columns[end][state]) for end in range(4)] for state in range(4)]


def damage(turns: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of `conv_id:turn` deals them."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), dealt.alias("__dealt"))
    text = F.when(F.col("__dealt") == 1, "").when(F.col("__dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__dealt") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("__dealt") == 0, 0).when(F.col("__dealt") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number (copies) and whether the first is blank, seen at an earlier turn, or truncated."""
    clean = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), clean("role"), clean("text"))
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("key", key)
    order = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    first = each.groupBy(F.col("conv_id").alias("__conv"), F.col("key").alias("__key")).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    met = each.join(first, each["conv_id"].eqNullSafe(F.col("__conv")) & (F.col("key") == F.col("__key")), "left")
    bare = F.rtrim("text", F.lit(BLANKS))
    return met.select(
        "conv_id", "turn", "role", "text", "copies",
        (bare == "").alias("blank"),
        F.coalesce(order != F.col("__first"), F.lit(False)).alias("seen"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


def sorted_rows(faults: DataFrame) -> DataFrame:
    """Range-partitioned by conversation and turn, in order within each partition, and kept."""
    faults = cut(faults)
    parts = max(1, -(-faults.count() // PART_ROWS))
    keys = ["conv_id", "turn", F.left("role", F.lit(PREFIX)), F.left("text", F.lit(PREFIX))]
    return cut(faults.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "role", "text"))


def _lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _kinds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and faults (0 none, 1 blank, 2 duplicate, 3 truncated), a row for each copy."""
    role, copies, blank, seen, truncated = (batch.column(batch.schema.get_field_index(n)) for n in ("role", "copies", "blank", "seen", "truncated"))
    initial = np.array([LETTERS.find(r[0]) % 4 if r else 3 for r in role.to_pylist()], np.int64)
    blank, seen, truncated = (c.to_numpy(zero_copy_only=False) for c in (blank, seen, truncated))
    copies = copies.to_numpy()
    row = np.repeat(np.arange(len(copies)), copies)
    again = np.arange(len(row)) != np.repeat(np.cumsum(copies) - copies, copies)
    fault = np.where(blank[row], 1, np.where(seen[row] | again, 2, np.where(truncated[row], 3, 0)))
    kind = np.where((fault == 1) | (fault == 2), MUST_GO, 1 + 2 * initial[row] + (fault == 3))
    return kind.astype(np.uint8), fault.astype(np.uint8)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[pa.RecordBatch]]]:
    """The sorted rows of each conversation of a partition."""
    now, held = None, []
    for batch in batches:
        ids = batch.column(0).to_pylist()
        start = 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or ids[k] != ids[start]:
                if held and now != ids[start]:
                    yield now, held
                    held = []
                now = ids[start]
                held.append(batch.slice(start, k - start))
                start = k
    if held:
        yield now, held


def _signature(pieces: list[pa.RecordBatch]) -> tuple[bytes, np.ndarray]:
    """A batch border may stand between no two copies of a row: copies are one row until here."""
    both = [_kinds(p) for p in pieces]
    return np.concatenate([k for k, _ in both]).tobytes(), np.concatenate([f for _, f in both])


def _ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last conversation of a partition, which its neighbours may share."""
    part, first, last = TaskContext.get().partitionId(), None, None
    for conv, pieces in _conversations(batches):
        if first is None:
            first = conv, pieces
        else:
            last = conv, pieces
    out = []
    for k, found in enumerate((first, last)):
        if found:
            matrix = crossing(_signature(found[1])[0])
            out.append({"part": part, "which": k, "conv_id": found[0], "costs": [min(x, FAR) for row in matrix for x in row]})
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("which", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def _exits(pieces: list[list[int]]) -> list[tuple[int, ...]]:
    """Distances to the end at the exit of each piece of one conversation. The last
    piece is solved with its own goal, so its exit distances are the goal's."""
    out = [GOAL]
    after = pieces[-1]
    for costs in reversed(pieces[:-1]):
        out.append(tuple(after))
        after = [min(costs[s * 4 + e] + after[e] for e in range(4)) for s in range(4)]
    return out[::-1]


_STEPS = "conv_id long, part int, place long, step string, turn long, role string, text string, fault byte"


def _entries(exits: dict, schema: pa.Schema):
    """State after each shared piece, for each of the four states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        for conv, pieces in _conversations(batches):
            if (part, conv) in exits:
                ends, last = exits[part, conv]
                kinds = _signature(pieces)[0]
                known = distances(kinds, ends, last)
                leads = [walk(kinds, known, s, last)[1] if known[0][s] < FAR else -1 for s in range(4)]
                out.append({"part": part, "conv_id": conv, "first": known[0].tolist(), "leads": leads})
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _steps(shared: dict):
    """The edits of each conversation as rows, in order of place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [f.split()[0] for f in _STEPS.split(", ")]
        kinds_of = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int8()]
        out: list[tuple] = []
        size = 0
        for conv, pieces in _conversations(batches):
            kinds, faults = _signature(pieces)
            if (part, conv) in shared:
                entry, ends, last = shared[part, conv]
                audit = walk(kinds, distances(kinds, ends, last), entry, last)[0]
            else:
                entry, audit = START, solve(kinds)
            rows = (r for p in pieces for *r, n in zip(*_lists(p, "turn", "role", "text", "copies")) for _ in range(n))
            state, at = entry, 0
            for place, step in enumerate(audit):
                turn = role = text = fault = None
                if step != "I":
                    turn, role, text = next(rows)
                    fault, at = int(faults[at]), at + 1
                if step == "D":
                    role = text = None
                else:
                    if step != "K":
                        letter = "u" if "u" in NEXT[state] else "a"
                        role, text = NAMES[letter], text or ""
                    state = NEXT[state][role[0]]
                    size += len(text)
                out.append((conv, part, place, step, turn, role, text, fault))
                if len(out) >= 20_000 or size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_of)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_of)], names=names)

    return run


def _shared_pieces(ranged: DataFrame) -> dict:
    """(part, conv_id) to (entry state, exit distances, last?) of conversations that cross partitions."""
    ranged = ranged.drop("text")
    ends = ranged.mapInArrow(_ends_of, "part int, which int, conv_id long, costs array<long>").collect()
    pieces = defaultdict(list)
    for r in sorted(ends, key=lambda r: (r.part, r.which)):
        pieces[r.conv_id].append(r)
    pieces = {c: rs for c, rs in pieces.items() if len(rs) > 1}
    if not pieces:
        return {}
    schema = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("first", pa.list_(pa.int64())), ("leads", pa.list_(pa.int32()))])
    kind = "part int, conv_id long, first array<long>, leads array<int>"
    # the last pieces know their goal already; what they cost from each state completes the pieces' graph
    lasts = {(rs[-1].part, c): (GOAL, True) for c, rs in pieces.items()}
    tails = {r.conv_id: r for r in ranged.mapInArrow(_entries(lasts, schema), kind).collect()}
    exits = {}
    for c, rs in pieces.items():
        found = _exits([list(r.costs) for r in rs[:-1]] + [list(tails[c].first)])
        exits |= {(r.part, c): (e, k == len(rs) - 1) for k, (r, e) in enumerate(zip(rs, found))}
    leads = {(r.part, r.conv_id): r.leads for r in ranged.mapInArrow(_entries(exits, schema), kind).collect()}
    shared = {}
    for c, rs in pieces.items():
        state = START
        for r in rs:
            shared[r.part, c] = state, *exits[r.part, c]
            state = leads[r.part, c][state]
    return shared


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, rows in order). Steps: (conv_id, part, place, step K R D I, turn, role, text, fault);
    by part and place they are the audit, role and text the repaired turns."""
    ranged = sorted_rows(with_faults(rows))
    return ranged.mapInArrow(_steps(_shared_pieces(ranged)), _STEPS), ranged


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Illegal neighbours within a partition's part of each conversation, and what its borders show."""
    part, out = TaskContext.get().partitionId(), []
    names = ["conv_id", "part", "illegal", "head", "tail", "least", "most", "turns"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for conv, pieces in _conversations(batches):
        illegal, tail, head, turns, seen = 0, None, None, 0, None
        least = most = None
        for p in pieces:
            for turn, role, n in zip(*_lists(p, "turn", "role", "copies")):
                initial = role[:1]
                if tail is not None:
                    illegal += tail + initial not in LEGAL
                illegal += (n - 1) * (initial + initial not in LEGAL)
                head = initial if head is None else head
                tail = initial
                if turn is not None:
                    least = turn if least is None else least
                    turns += turn != most
                    most = turn
        out.append((conv, part, illegal, head, tail, least, most, turns))
        if len(out) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


LEGAL = ("su", "ua", "au")


def structure(ranged: DataFrame) -> DataFrame:
    """(conv_id, illegal, gaps) of the rows that repair() returns second."""
    parts = ranged.drop("text").mapInArrow(_counts, "conv_id long, part int, illegal long, head string, tail string, least long, most long, turns long")
    # a conversation has as many of these rows as it has partitions
    by = F.sort_array(F.collect_list(F.struct("part", "illegal", "head", "tail", "least", "most", "turns")))
    known = parts.groupBy("conv_id").agg(by.alias("p"))
    joint = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.when(F.concat(F.get("p", k - 1)["tail"], F.get("p", k)["head"]).isin(*LEGAL), 0).otherwise(1))
    both = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.when(F.get("p", k - 1)["most"] == F.get("p", k)["least"], 1).otherwise(0))
    several = F.size("p") > 1
    add = lambda column, start: F.aggregate(column, start, lambda a, x: a + x)
    zero = F.lit(0).cast("long")
    illegal = add(F.transform("p", lambda x: x["illegal"]), zero) + F.when(several, add(joint, zero)).otherwise(0)
    turns = add(F.transform("p", lambda x: x["turns"]), zero) - F.when(several, add(both, zero)).otherwise(0)
    span = F.array_max(F.transform("p", lambda x: x["most"])) - F.array_min(F.transform("p", lambda x: x["least"])) + 1
    return known.select("conv_id", illegal.alias("illegal"), F.coalesce(span - turns, F.lit(0)).cast("long").alias("gaps"))


def _line(role: Column | str, text: Column | str) -> Column:
    return F.concat_ws(":", role, text)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    steps, ranged = repair(damage(turns))
    fault = lambda k: F.count_if(F.col("fault") == k)
    cost = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    price = F.when(F.col("step").isin("K", "R") & (F.col("fault") == 3), TRUNCATED).otherwise(0)
    for letter, c in cost.items():
        price += F.when(F.col("step") == letter, c).otherwise(0)
    in_order = F.sort_array(F.collect_list(F.struct("part", "place", "step", F.when(F.col("step") != "D", _line("role", "text")).alias("line"))))
    done = steps.groupBy("conv_id").agg(
        fault(1).alias("blank"), fault(2).alias("duplicate"), fault(3).alias("truncated"), F.sum(price).cast("long").alias("cost"), in_order.alias("s")
    )
    kept = F.transform(F.filter("s", lambda x: x["step"] != "D"), lambda x: x["line"])
    done = done.select("conv_id", "blank", "duplicate", "truncated", "cost", F.array_join(F.transform("s", lambda x: x["step"]), "").alias("audit"), F.array_join(kept, "\n").alias("repaired"))
    known = structure(ranged).withColumnRenamed("conv_id", "__c")
    named = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = named.join(done.withColumnRenamed("conv_id", "__d"), named["conv_id"].eqNullSafe(F.col("__d")), "left").join(known, named["conv_id"].eqNullSafe(F.col("__c")), "left")
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return out.select(
        "conv_id", *(count(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"),
    )


def _insert(p: str, letter: str) -> str:
    line = f"{NAMES[letter]}:"
    return f"{{'c': {p}.c + {INSERT}, 'a': {p}.a || 'I', 'r': CASE WHEN {p}.r = '' THEN '{line}' ELSE {p}.r || chr(10) || '{line}' END}}"


def _edit(p: str, step: str, cost: str, line: str | None, when: str = "true") -> str:
    r = f"CASE WHEN {p}.r = '' THEN {line} ELSE {p}.r || chr(10) || {line} END" if line else f"{p}.r"
    return f"{{'c': CASE WHEN {when} THEN {p}.c + {cost} ELSE 1000000000 END, 'a': {p}.a || '{step}', 'r': {r}}}"


def _best(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _sql() -> str:
    keep, line = f"t * {TRUNCATED}", "role || ':' || text"
    moves = {q: [_edit(f"p{q}", "D", str(DELETE), None)] for q in range(4)}
    for q in range(4):
        for letter, to in NEXT[q].items():
            moves[to].append(_edit(f"p{q}", "K", keep, line, f"NOT must AND left(role, 1) = '{letter}'"))
            if letter in NAMES:
                moves[to].append(_edit(f"p{q}", "R", f"{REROLE} + {keep}", f"'{NAMES[letter]}:' || text", "NOT must"))
    rows = ", ".join(f"{_best(*moves[q])} AS p{q}" for q in range(4))
    user = _best("p2", *(_insert(f"p{q}", "u") for q in (0, 1, 3)))
    start = "{'c': 0::BIGINT, 'a': '', 'r': ''}"
    far = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS h FROM src),
rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows_),
faults AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
kinds AS (SELECT conv_id, i, role, text, blank OR again AS must, CASE WHEN NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS t FROM faults),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
cut AS (SELECT conv_id, sum(t) AS truncated FROM kinds GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {start} AS p0, {far} AS p1, {_insert('z', 'u')} AS p2, {_insert(f"({_insert('z', 'u')})", 'a')} AS p3 FROM (SELECT DISTINCT conv_id, {start} AS z FROM kinds)
  UNION ALL
  SELECT conv_id, i, p0, p1, {user} AS p2, {_best("p3", _insert("p2", "a"), *(_insert(f"({_insert(f'p{q}', 'u')})", "a") for q in (0, 1)))} AS p3
  FROM (SELECT d.conv_id, k.i, {rows} FROM dp d JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM d.conv_id AND k.i = d.i + 1)),
best AS (SELECT d.conv_id, list_sort([p0, p3])[1] AS b FROM dp d JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.i)
SELECT c.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, CAST(coalesce(x.truncated, 0) AS BIGINT) AS truncated,
  coalesce(f.illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(b.b.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN cut x ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _sql()
