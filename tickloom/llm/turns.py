"""Repair of conversation structure by a survivor-coalescence Viterbi search.

A legal conversation's role initials read ``(s?(ua)+)?``. Rows are kept, reroled or deleted and
empty turns inserted so that the result is legal and the edits cost least; of equally cheap
edits those with the least string of initials win.

The search keeps one survivor per grammar state. Survivors share a tree of backpointers with
reference counts; as soon as all of them descend from one node, the edits up to it are certain and
leave the tree. A tie is decided by the whole unresolved edits of both paths, back to the node
they share. Survivors that cost more than another one could ever lose are dropped, which
brings the others together soon.

A conversation of any length is cut into parts of ``part_rows`` rows. A part is summed up by the
cheapest path between each two states, with the paths' order among one another; these sums are
the units of the same search one level up. The states chosen there at the parts' ends fix each
part's edits, so no task sees more than one part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import staged
from tickloom.llm.ranks import ranked

NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing kept yet, or the last kept initial
BLANK = r"\A[\x20\x09-\x0D]*\z"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"
INITIALS = "sua"
ROLES = {USER: "user", ASSISTANT: "assistant"}


@dataclass(frozen=True)
class Costs:
    """``rerole`` of at least 1, so that keeping a right role is always cheaper."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # of a truncated row that stays

    def after(self, state: int) -> int:
        """What ends a conversation legally from a state: insertions."""
        return {NOTHING: 0, SYSTEM: 2 * self.insert, USER: self.insert, ASSISTANT: 0}[state]

    def imitation(self) -> dict[tuple[int, int], int]:
        """(y, x): how much more than from x any continuation can cost from y, with what differs inserted or deleted."""
        d, i = self.delete, self.insert
        return {
            (NOTHING, SYSTEM): 0, (NOTHING, USER): i, (NOTHING, ASSISTANT): 0, (SYSTEM, NOTHING): max(d, 2 * i), (SYSTEM, USER): i, (SYSTEM, ASSISTANT): 2 * i,
            (USER, NOTHING): i + d, (USER, SYSTEM): i, (USER, ASSISTANT): i, (ASSISTANT, NOTHING): d, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): i,
        }


def _next(state: int, initial: str) -> int | None:
    """The state after an initial, None where it is not legal there."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


@lru_cache(maxsize=None)
def row_options(initial: str, lost: bool, truncated: bool, costs: Costs) -> tuple:
    """What can become of a row: ``(from, to, cost, ((letter, state after), ...))``, insertions before the row included."""
    out = []
    for start in range(4):
        for inserted in ("", "a" if start == USER else "u"):
            state, cost, before = start, 0, ()
            if inserted:
                state, cost = _next(start, inserted), costs.insert
                before = (("I", state),)
            out.append((start, state, cost + costs.delete, (*before, ("D", state))))
            if lost:
                continue
            stays = cost + (costs.truncated if truncated else 0)
            if (to := _next(state, initial)) is not None:
                out.append((start, to, stays, (*before, ("K", to))))
            for role in "ua":
                if role != initial and (to := _next(state, role)) is not None:
                    out.append((start, to, stays + costs.rerole, (*before, ("R", to))))
    return tuple(out)


class _Node:
    __slots__ = ("parent", "unit", "letter", "state", "depth", "refs")

    def __init__(self, parent, unit, letter, state):
        self.parent, self.unit, self.letter, self.state, self.refs = parent, unit, letter, state, 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.refs += 1


class Survivors:
    """The tree of unresolved edits and, for each state, cost and last edit of its survivor.

    ``emit(unit, letter, state)`` gets each edit once it is certain.
    """

    def __init__(self, entry: int, costs: Costs, emit):
        self.emit, self.imitation, self.unit = emit, costs.imitation(), 0
        self.root = _Node(None, -1, None, entry)
        self.root.refs = 1  # a survivor ends here
        self.heads: dict[int, tuple[int, _Node]] = {entry: (0, self.root)}

    @staticmethod
    def before(x: _Node, x_more: tuple, y: _Node, y_more: tuple) -> bool:
        """Whether the edits up to ``x`` with ``x_more`` sort before those of ``y``: compared from the node they share."""
        a, b = [e[0] for e in reversed(x_more)], [e[0] for e in reversed(y_more)]
        while x is not y:
            if x.depth >= y.depth:
                a.append(x.letter)
                x = x.parent
            else:
                b.append(y.letter)
                y = y.parent
        return a[::-1] < b[::-1]

    def _free(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node = node.parent
            node.refs -= 1

    def step(self, options) -> None:
        best: dict[int, tuple] = {}
        for start, to, cost, edits in options:
            head = self.heads.get(start)
            if head is None:
                continue
            cost += head[0]
            known = best.get(to)
            if known is None or cost < known[0] or (cost == known[0] and self.before(head[1], edits, known[1], known[2])):
                best[to] = (cost, head[1], edits)
        stay = [x for x, (cost, _, _) in best.items() if not any(y != x and other + self.imitation[y, x] < cost for y, (other, _, _) in best.items())]
        heads = {}
        for state in stay:
            cost, node, edits = best[state]
            for letter, after in edits:
                node = _Node(node, self.unit, letter, after)
            node.refs += 1
            heads[state] = (cost, node)
        for _, node in self.heads.values():
            self._free(node)
        self.heads = heads
        self.unit += 1
        self._resolve()

    def _resolve(self) -> None:
        if self.root.refs != 1 or any(node is self.root for _, node in self.heads.values()):
            return
        path, node = [], next(iter(self.heads.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        ends = {id(node) for _, node in self.heads.values()}
        while path:
            node = path.pop()
            self.emit(node.unit, node.letter, node.state)
            node.parent = None
            self.root = node
            if node.refs != 1 or id(node) in ends:
                return

    def finish(self, state: int) -> None:
        """Emits what is open of one state's survivor."""
        path, node = [], self.heads[state][1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.unit, node.letter, node.state)

    def paths(self) -> dict[int, tuple[int, list]]:
        """Cost and unresolved letters of every survivor."""
        out = {}
        for state, (cost, node) in self.heads.items():
            letters = []
            while node is not self.root:
                letters.append(node.letter)
                node = node.parent
            out[state] = (cost, letters[::-1])
        return out


def summed_up(units: list, costs: Costs) -> list[int]:
    """A part as one unit: for each pair of states cost (-1: never needed) and order of its cheapest path."""
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for entry in range(4):
        sure: list = []
        walk = Survivors(entry, costs, lambda unit, letter, state: sure.append(letter))
        for options in units:
            walk.step(options)
        for state, (cost, letters) in walk.paths().items():
            found[entry, state] = (cost, sure + letters)
    order = sorted({tuple(letters) for _, letters in found.values()})
    rank = {letters: i for i, letters in enumerate(order)}
    cells = [found.get((p, q)) for p in range(4) for q in range(4)]
    return [x for c in cells for x in ((-1, 0) if c is None else (c[0], rank[tuple(c[1])]))]


def _unit_options(cells: list[int]) -> list:
    """The options of a summed-up part; its letters are the ranks of its paths."""
    return [(p, q, cells[8 * p + 2 * q], ((cells[8 * p + 2 * q + 1], q),)) for p in range(4) for q in range(4) if cells[8 * p + 2 * q] >= 0]


def solved(units: list, costs: Costs, entry: int | None = None, end: int | None = None) -> list[tuple]:
    """The edits ``(unit, letter, state after)`` of a part with given states at its ends, or of a whole conversation."""
    out: list[tuple] = []
    walk = Survivors(NOTHING if entry is None else entry, costs, lambda *edit: out.append(edit))
    for options in units:
        walk.step(options)
    if end is None:
        end = min((cost + costs.after(state), letters + ["I"] * (costs.after(state) // costs.insert if costs.insert else 0), state) for state, (cost, letters) in walk.paths().items())[2]
    walk.finish(end)
    return out


def _parts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list, list[list]]]:
    """First row and all rows of one part of a conversation at a time; rows come sorted."""
    held: list[list] = []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if held and row[:2] != held[0][:2]:
                yield held[0], held
                held = []
            held.append(row)
    if held:
        yield held[0], held


UNIT = ["conv", "part", "idx", "size", "unit", "entry", "end"]


def _options(level: int, unit: list[int], costs: Costs):
    if level:
        return _unit_options(unit)
    code = unit[0]
    return row_options((INITIALS + "?")[code >> 2], bool(code & 2), bool(code & 1), costs)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _summer(level: int, costs: Costs, part_rows: int):
    schema = pa.schema([("conv", pa.string()), ("idx", pa.int64()), ("size", pa.int64()), ("unit", pa.list_(pa.int64()))])

    def rows(batches):
        for first, part in _parts(batches, UNIT):
            yield first[0], first[1], -(-first[3] // part_rows), summed_up([_options(level, r[4], costs) for r in part], costs)

    return lambda batches: _batches(rows(batches), schema)


def _solver(level: int, costs: Costs, part_rows: int):
    ints = pa.int64()
    schema = pa.schema([("conv", pa.string()), ("idx", ints), ("seq", ints), ("edit", pa.string()), ("role", pa.string()), ("cost", ints), ("entry", ints), ("end", ints)])

    def rows(batches):
        for first, part in _parts(batches, UNIT):
            conv, entry, end = first[0], None, None
            if first[2] < 0:
                entry, end, part = first[5], first[6], part[1:]
            state = NOTHING if entry is None else entry
            edits = solved([_options(level, r[4], costs) for r in part], costs, entry, end)
            for unit, letter, after in edits:
                row = part[unit]
                if level:
                    yield conv, row[2], 0, None, None, None, state, after
                else:
                    stays = costs.truncated if row[4][0] & 1 else 0
                    cost = {"K": stays, "R": stays + costs.rerole, "D": costs.delete, "I": costs.insert}[letter]
                    yield conv, row[2], 0 if letter == "I" else 1, letter, ROLES[after] if letter in "RI" else None, cost, None, None
                state = after
            if not level and part[-1][2] == part[-1][3] - 1:  # the conversation's end
                for seq, role in enumerate({SYSTEM: ("user", "assistant"), USER: ("assistant",)}.get(state, ()), 2):
                    yield conv, part[-1][2], seq, "I", role, costs.insert, None, None

    return lambda batches: _batches(rows(batches), schema)


def edits_of(units: DataFrame, costs: Costs = Costs(), part_rows: int = 1024) -> DataFrame:
    """The cheapest edits of every conversation: ``conv, idx, seq, edit, role, cost``.

    ``units`` has a row per turn: ``conv, idx, size`` (see ``ranked``) and ``code``: the initial's place in
    ``sua`` (3: none of them) times 4, plus 2 for a row that must go, plus 1 for a truncated one. ``seq`` orders
    the edits at a row: 0 inserted before it, 1 the row's own, 2 and 3 inserted at the conversation's end.
    """
    levels = [units.select("conv", "idx", "size", F.array(F.col("code").cast("long")).alias("unit"))]
    most = units.agg(F.max("size")).first()[0] or 0
    part = F.floor(F.col("idx") / part_rows).cast("long").alias("part")
    none = F.lit(None).cast("long")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "idx")

    def laid(k: int) -> DataFrame:
        return levels[k].select("conv", part, "idx", "size", "unit", none.alias("entry"), none.alias("end"))

    while most > part_rows:
        k = len(levels) - 1
        up = dealt(laid(k).filter(F.col("size") > part_rows)).mapInArrow(_summer(k, costs, part_rows), "conv string, idx long, size long, unit array<long>")
        levels.append(staged(up, "turn-parts"))
        most = -(-most // part_rows)
    fixed = None
    for k in range(len(levels) - 1, -1, -1):
        rows = laid(k) if fixed is None else laid(k).unionByName(fixed)
        out = dealt(rows).mapInArrow(_solver(k, costs, part_rows), "conv string, idx long, seq long, edit string, role string, cost long, entry long, end long")
        fixed = out.select("conv", F.col("idx").alias("part"), F.lit(-1).cast("long").alias("idx"), none.alias("size"), F.lit(None).cast("array<long>").alias("unit"), "entry", "end")
    return out.drop("entry", "end")


@dataclass(frozen=True)
class Repair:
    """``turns``: the rows with ``conv, idx, size, turn, role, text`` and their ``fault`` (blank, duplicate, truncated or null)
    and ``illegal`` (no legal successor of the row before). ``edits``: see ``edits_of``."""

    turns: DataFrame
    edits: DataFrame


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs = Costs(), part_rows: int = 1024) -> Repair:
    """Finds the faults of all conversations and the cheapest edits that make each legal.

    Rows are ordered by turn (null first), role and text; repeated rows stand side by side. A row is
    ``blank`` where its text has nothing but ASCII white space, else ``duplicate`` where its role and text
    stood earlier in the conversation, else ``truncated`` where its last visible character is none of
    ``.!?``. Blank and duplicate rows must go. A role other than one with initial s, u or a can't be kept.

    A null role or text counts as one space, null conversation ids are one conversation. Texts and
    conversations may have any length; an empty table has no edits. Other columns are not read.
    """
    rows = turns.select(
        conv_key(F.col(conversation)).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
    )
    rows = ranked(rows, "conv", ["turn", "role", "text"], "turns")
    blank, whole = F.col("text").rlike(BLANK), F.col("text").rlike(WHOLE)
    same = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("turn"), "text", "role").alias("h2")]
    slim = rows.select("conv", "idx", "size", F.instr(F.lit(INITIALS), F.substring("role", 1, 1)).alias("at"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), whole.alias("whole"), *same)
    slim = staged(slim, "turn-flags")
    seen = slim.groupBy("conv", "h1", "h2").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    slim = slim.join(seen, ["conv", "h1", "h2"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("idx"), "duplicate").when(~F.col("whole"), "truncated")
    # a part's last row also stands before the next part, so that every row sees the one before it
    part = F.floor(F.col("idx") / part_rows)
    shown = F.when((F.col("idx") % part_rows == part_rows - 1) & (F.col("idx") < F.col("size") - 1), F.array(part, part + 1)).otherwise(F.array(part))
    seen_by = slim.withColumn("fault", fault).withColumn("part", F.explode(shown))
    pair = F.concat(F.lag("initial").over(W.partitionBy("conv", "part").orderBy("idx")), "initial")
    flagged = seen_by.withColumn("pair", pair).filter(F.col("part") == part)
    known = (F.col("initial") != "") & (F.col("at") > 0)
    code = F.when(known, F.col("at") - 1).otherwise(3) * 4 + F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    flagged = flagged.select("conv", "idx", "size", "fault", F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False)).alias("illegal"), code.alias("code"))
    flagged = staged(flagged, "turn-faults")
    edits = staged(edits_of(flagged.select("conv", "idx", "size", "code"), costs, part_rows), "turn-edits")
    faults = flagged.select(F.col("conv").alias("c"), F.col("idx").alias("i"), "fault", "illegal")
    shown = rows.join(faults, (F.col("conv") == F.col("c")) & (F.col("idx") == F.col("i"))).drop("c", "i")
    return Repair(shown, edits)


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows: an edit, then the text it is for; one digest per conversation, whatever its length."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])

    def rows():
        conv, digest, began, own = None, None, False, None

        def put(role, text):
            nonlocal began
            digest.update(f"{chr(10) if began else ''}{role}:{text}".encode())
            began = True

        for batch in batches:
            for c, seq, edit, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "seq", "edit", "role", "text"))):
                if c != conv:
                    if digest is not None:
                        yield conv, digest.hexdigest()
                    conv, digest, began = c, hashlib.sha256(), False
                if edit == "I":
                    put(role, "")
                elif edit is not None:
                    own = (edit, role)
                elif own[0] != "D":
                    put(own[1] or role, text)
        if digest is not None:
            yield conv, digest.hexdigest()

    return _batches(rows(), schema)


def repaired_digests(found: Repair) -> DataFrame:
    """``conv, repaired_sha256``: of the repaired ``role:text`` lines. Rows of a conversation stream through one
    task in order, because the digest of a text can't be made in parts; only the digest's state is held."""
    steps = found.edits.select("conv", "idx", "seq", F.lit(0).alias("own"), "edit", "role", F.lit(None).cast("string").alias("text"))
    texts = found.turns.select("conv", "idx", F.lit(1).cast("long").alias("seq"), F.lit(1).alias("own"), F.lit(None).cast("string").alias("edit"), "role", "text")
    both = steps.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "idx", "seq", "own")
    return both.mapInArrow(_hasher, "conv string, repaired_sha256 string")


def repaired_turns(found: Repair) -> DataFrame:
    """The repaired conversations as rows ``conv, idx, seq, role, text``."""
    own = found.edits.filter("seq = 1 AND edit <> 'D'").select(F.col("conv").alias("c"), F.col("idx").alias("i"), F.col("role").alias("new_role"))
    kept = found.turns.join(own, (F.col("conv") == F.col("c")) & (F.col("idx") == F.col("i"))).select("conv", "idx", F.lit(1).cast("long").alias("seq"), F.coalesce("new_role", "role").alias("role"), "text")
    return kept.unionByName(found.edits.filter("edit = 'I'").select("conv", "idx", "seq", "role", F.lit("").alias("text")))


def audits(edits: DataFrame, part_rows: int = 1024) -> DataFrame:
    """``conv, audit, cost``: the initials of a conversation's edits in order, joined part by part, and their cost."""
    parts = edits.groupBy("conv", F.floor(F.col("idx") / part_rows).alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", "seq", "edit"))).alias("steps"), F.sum("cost").alias("cost"))
    parts = parts.select("conv", "part", F.array_join(F.col("steps.edit"), "").alias("letters"), "cost")
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "letters"))).alias("parts"), F.sum("cost").alias("cost"))
    return whole.select("conv", F.array_join(F.col("parts.letters"), "").alias("audit"), "cost")


def conv_key(conversation: Column) -> Column:
    """How ``repair`` names a conversation."""
    return F.coalesce(F.concat(F.lit("="), conversation.cast("string")), F.lit(""))
