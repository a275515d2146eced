"""Conversation structure repair by divide and conquer over four-state cost vectors.

A conversation's rows, taken by turn, are edited at least cost into one whose role initials
read ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank rows and repeats),
Insert an empty user or assistant row 3; a truncated row that is not deleted adds 3.  Of the cheapest edit
sequences the one whose initials are least in ASCII order is taken.

The automaton has four states: nothing kept, after s, after u, after a.  Two prefixes of edits
over the same rows that end in different states differ as strings, so next to its cost every state carries
only its place in the order of the strings.  The forward vector (cost, place) of the first half and
the backward vector of the second half meet in the middle; the crossing of least cost and, among those, of least
place is kept and both halves are solved alike: linear space, no table of rows by states.

In Spark the rows are sorted once by range of (conversation, turn), so a long conversation
is many partitions, and numbered.  Its rows form segments of at most ``SEGMENT``; of a conversation with several, each
segment gives a 4 x 4 matrix of costs and places, and the same divide and conquer over the
matrices fixes the states between segments (1/SEGMENT of the rows).  Segments are then solved apart.
Only the last step, the repaired text in order, reads a conversation in one task, as a
stream: a digest of it is sequential by nature; texts are not gathered.

Edge cases: a null role or text is one space; null turns come first; a null conversation id is a
conversation; rows of one turn are taken by role, then a hash of the text; conversations of which ``damage``
leaves nothing keep a row with an empty audit; empty tables give no rows; very long texts pass one
at a time; repeated rows are duplicates; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import store, texts_of
from lowdata.operators.ranking import with_position

SEGMENT = 1024
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, S, U, A = range(4)
ROLE_AFTER = {START: "user", S: "user", U: "assistant", A: "user"}  # of an inserted or reroled row
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
END = "$"  # the end of a conversation as one more step
SPACE = r"\x20\x09-\x0D"
INF = float("inf")


def _options(code: str, state: int) -> list[tuple[int, int, str]]:
    """(next state, cost, edits) of one row; at most one, the best, for each next state.

    Codes: b blank, d duplicate, else the role's initial (s, u, a, or o), as a capital if truncated.
    """
    best: dict[int, tuple[int, str]] = {}

    def offer(to, cost, edits):
        if to not in best or (cost, edits) < best[to]:
            best[to] = (cost, edits)

    for k in range(3):  # more inserts in a row only repeat a state
        cost, edits = INSERT * k, "I" * k
        if code == END:
            if state in (START, A):
                offer(START, cost, edits)
        else:
            offer(state, cost + DELETE, edits + "D")
            if code not in "bd":
                cost += TRUNCATED * code.isupper()
                kept = NEXT.get((state, code.lower()))
                if kept is not None:
                    offer(kept, cost, edits + "K")
                offer(NEXT[state, ROLE_AFTER[state][0]], cost + REROLE, edits + "R")
        state = NEXT[state, ROLE_AFTER[state][0]]
    return [(to, cost, edits) for to, (cost, edits) in sorted(best.items())]


STEPS = {code: [_options(code, p) for p in range(4)] for code in "bdsuaoSUAO" + END}


def forward(steps: list, entry: int) -> tuple[list, list]:
    """(costs, places) of the four states after ``steps``; a place ranks the least edit strings of equal states' costs."""
    cost, place = [INF] * 4, [0] * 4
    cost[entry] = 0
    for step in steps:
        best: list = [None] * 4
        for p in range(4):
            if cost[p] < INF:
                for to, c, key in step[p]:
                    way = (cost[p] + c, place[p], key)
                    if best[to] is None or way < best[to]:
                        best[to] = way
        order = sorted((w[1:], q) for q, w in enumerate(best) if w)
        cost = [w[0] if w else INF for w in best]
        place = [0] * 4
        for i, (_, q) in enumerate(order):
            place[q] = i
    return cost, place


def backward(steps: list, leave: int) -> list:
    """Least costs from each state before ``steps`` to the state ``leave``."""
    cost = [INF] * 4
    cost[leave] = 0
    for step in reversed(steps):
        cost = [min((c + cost[to] for to, c, _ in step[p]), default=INF) for p in range(4)]
    return cost


def solve(steps: list, entry: int, leave: int) -> list:
    """The (next state, cost, key) taken at every step of the least way from ``entry`` to ``leave``."""
    if len(steps) == 1:
        return [next(o for o in steps[0][entry] if o[0] == leave)]
    mid = len(steps) // 2
    cost, place = forward(steps[:mid], entry)
    rest = backward(steps[mid:], leave)
    _, _, at = min((cost[q] + rest[q], place[q], q) for q in range(4))
    return solve(steps[:mid], entry, at) + solve(steps[mid:], at, leave)


@lru_cache(maxsize=1 << 14)
def _short(codes: str, entry: int, leave: int) -> tuple[str, ...]:
    return tuple(o[2] for o in solve([STEPS[c] for c in codes], entry, leave))


def edits_of(codes: str, entry: int = START, leave: int = START) -> list[str]:
    """Edits of every step of ``codes`` (with END for a whole conversation): inserts, then the row's own."""
    if not codes:
        return []
    if len(codes) <= 32:
        return list(_short(codes, entry, leave))
    return [o[2] for o in solve([STEPS[c] for c in codes], entry, leave)]


def matrix(codes: str) -> list[int]:
    """Costs (-1: no way) and places from every entry state to every exit state, as 32 numbers."""
    ways = [forward([STEPS[c] for c in codes], p) for p in range(4)]
    return [-1 if c == INF else int(c) for cost, _ in ways for c in cost] + [r for _, place in ways for r in place]


def crossings(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, exit) state of every segment of a conversation from the segments' matrices."""
    steps = [[[(q, m[4 * p + q], m[16 + 4 * p + q]) for q in range(4) if m[4 * p + q] >= 0] for p in range(4)] for m in matrices]
    out, at = [], START
    for to, _, _ in solve(steps, START, START):
        out.append((at, to))
        at = to
    return out


def damage(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): faults chosen by crc32('conv_id:turn') % 20; nulls are one space there.

    0 drops the row (``gone``: kept only to name its conversation), 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes its role user.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("old", "[.!?]", "")).otherwise(F.col("old"))
    return (convs.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), fault.alias("fault"),
                         told(role_col).alias("old_role"), told(text_col).alias("old"))
            .withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("old_role")).alias("role"), text.alias("text"),
                    (F.col("fault") == 0).alias("gone")))


def _edited(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered rows (conv_id, at, turn, role, text), and (conv_id, at, codes, edits) of their segments."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", F.xxhash64("text")]
    rows = with_position(convs.select("conv_id", "turn", "role", "text").orderBy(*order), "at")
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    seen = store(rows.select("conv_id", "at", "role", last.alias("last"), F.sha2("text", 256).alias("said")), "conv-rows")
    first = seen.where("last <> ''").groupBy("conv_id", "role", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = (F.when(F.col("last") == "", "b").when(F.col("first").isNull(), "d")
            .when(F.col("last").isin(".", "!", "?"), plain).otherwise(F.upper(plain)))
    block = F.floor(F.col("at") / SEGMENT)
    in_order = F.array_sort(F.collect_list(F.struct("at", "code")))
    segments = (seen.join(first, "at", "left").select("conv_id", "at", block.alias("block"), code.alias("code"))
                .groupBy("conv_id", "block").agg(F.min("at").alias("at"), F.array_join(F.transform(in_order, lambda x: x["code"]), "").alias("codes")))
    whole = segments.groupBy("conv_id").agg(F.count("*").alias("parts"), F.max("at").alias("final"))
    conv = whole.select(F.col("conv_id").alias("c"), "parts", "final")
    segments = store(segments.join(conv, F.col("conv_id").eqNullSafe(F.col("c")))
                     .select("conv_id", "at", "codes", "parts", F.concat("codes", F.when(F.col("at") == F.col("final"), END).otherwise("")).alias("steps")),
                     "conv-segments")
    kind = segments.schema["conv_id"].dataType.simpleString()

    def matrices(batches):
        for b in texts_of(batches):
            m = pa.array([matrix(s) for s in b.column("steps").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), m], names=["conv_id", "at", "m"])

    def states(pdf):
        import pandas as pd
        pdf = pdf.sort_values("at")
        cross = crossings([list(m) for m in pdf["m"]])
        return pd.DataFrame({"at": pdf["at"].values, "entry": [c[0] for c in cross], "leave": [c[1] for c in cross]})

    def edits(batches):
        for b in texts_of(batches):
            cols = [b.column(c).to_pylist() for c in ("steps", "entry", "leave")]
            e = [" ".join(edits_of(*x)) for x in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), b.column("codes"), pa.array(e, pa.string())],
                                             names=["conv_id", "at", "codes", "edits"])

    between = (segments.where("parts > 1").mapInArrow(matrices, f"conv_id {kind}, at bigint, m array<int>")
               .groupBy("conv_id").applyInPandas(states, "at bigint, entry int, leave int"))
    begin = segments.where("parts = 1").select("conv_id", "at", "codes", "steps", F.lit(START).alias("entry"), F.lit(START).alias("leave"))
    joined = segments.where("parts > 1").join(between, "at").select("conv_id", "at", "codes", "steps", "entry", "leave")
    return rows, begin.unionByName(joined).mapInArrow(edits, f"conv_id {kind}, at bigint, codes string, edits string")


class _Walk:
    """One conversation as its rows come in order: faults counted, edits applied."""

    def __init__(self):
        self.state, self.codes, self.edits, self.i = START, "", [], 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before, self.low, self.high, self.turns = None, None, None, 0

    def segment(self, codes: str, edits: str) -> None:
        self.codes, self.edits, self.i = codes, edits.split(" "), 0

    def _new(self, edit: str, turn, text: str):
        role = ROLE_AFTER[self.state]
        self.state = NEXT[self.state, role[0]]
        return edit, turn, role, text

    def tail(self) -> list:
        """Inserts after the last row."""
        return [self._new("I", None, "") for _ in "".join(self.edits[self.i:])]

    def row(self, turn, role: str, text: str) -> list:
        """(edit, turn, role, text) of what becomes of the next row; deleted rows have no role."""
        code, edits = self.codes[self.i], self.edits[self.i]
        self.i += 1
        f = self.faults
        f["blank"] += code == "b"
        f["duplicate"] += code == "d"
        f["truncated"] += code.isupper()
        initial = role[:1]
        f["illegal"] += self.before is not None and (self.before + initial) not in ("su", "ua", "au")
        self.before = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        out = []
        for e in edits:
            if e == "I":
                out.append(self._new("I", None, ""))
            elif e == "R":
                out.append(self._new("R", turn, text))
            elif e == "K":
                self.state = NEXT[self.state, initial]
                out.append(("K", turn, role, text))
            else:
                out.append(("D", turn, None, text))
        return out

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _streams(batches):
    """(conv_id, walk, pieces, ended) for every row and every end of a conversation in the sorted union of segments, rows and names."""
    none = object()
    now, walk = none, None
    for b in texts_of(batches):
        for conv, kind, codes, edits, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "codes", "edits", "turn", "role", "text"))):
            if now is none or conv != now:
                if now is not none:
                    yield now, walk, walk.tail(), True
                now, walk = conv, _Walk()
            if kind == 1:
                walk.segment(codes, edits)
            elif kind == 2:
                yield now, walk, walk.row(turn, role, text), False
    if now is not none:
        yield now, walk, walk.tail(), True


def _walked(convs: DataFrame, fn, schema: str) -> DataFrame:
    gone = F.col("gone") if "gone" in convs.columns else F.lit(False)
    rows, segments = _edited(convs.where(~gone))
    kind = convs.schema["conv_id"].dataType.simpleString()
    names = convs.where(gone).select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"))
    both = (rows.withColumn("kind", F.lit(2)).unionByName(segments.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .unionByName(names, allowMissingColumns=True))
    return (both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("at"), "kind")
            .mapInArrow(fn, f"conv_id {kind}, {schema}"))


def _as_rows(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return convs.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"))


def _batches(fn, names: list[str], types: list[pa.DataType]):
    """A ``mapInArrow`` function from ``fn(streams) -> rows``, whose first column is the conversation id."""
    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field("conv_id").type, *types]
        out = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        for row in fn(_streams(chain([first], batches))):
            out.append(row)
            if len(out) >= 512:
                yield flush()
                out.clear()
        if out:
            yield flush()
    return run


def repair(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired rows in order; inserted rows have no turn."""
    def rows(streams):
        at, place = None, 0
        for conv, walk, pieces, _ in streams:
            if walk is not at:
                at, place = walk, 0
            for edit, turn, role, text in pieces:
                if edit != "D":
                    yield conv, place, edit, turn, role, text
                    place += 1
    run = _batches(rows, ["conv_id", "place", "edit", "turn", "role", "text"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()])
    return _walked(_as_rows(convs, conv_col, turn_col, role_col, text_col), run, "place bigint, edit string, turn bigint, role string, text string")


def digest(convs: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text[, gone]): faults, cost, audit and the digest of the repaired rows."""
    costs = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def rows(streams):
        at = None
        for conv, walk, pieces, ended in streams:
            if walk is not at:
                at, sha, some, cost, audit = walk, hashlib.sha256(), False, 0, []
            for edit, _, role, text in pieces:
                audit.append(edit)
                cost += costs[edit]
                if edit != "D":
                    sha.update(("\n" if some else "").encode() + f"{role}:{text}".encode())
                    some = True
                    cost += TRUNCATED * (edit != "I" and walk.codes[walk.i - 1].isupper())
            if ended:
                f = walk.faults
                yield conv, walk.gaps, f["blank"], f["duplicate"], f["truncated"], f["illegal"], cost, "".join(audit), sha.hexdigest()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    run = _batches(rows, names, [*[pa.int64()] * 6, pa.string(), pa.string()])
    return _walked(convs, run, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
