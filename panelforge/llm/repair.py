"""Repair of the order of roles in conversations, by weighted CYK over spans.

A repaired conversation is nothing, or user and assistant in turn from user to assistant, after
at most one system row. The grammar's nonterminals are pairs of places in that order: `(p, q)`
is a span of rows that, edited, leads from place p to place q, and in Chomsky normal form each
is `(p, r) (r, q)` or one row. A cell holds, for each nonterminal, the least (cost, audit), closed
under insertions at both ends. Cells of longer spans are made of those of all shorter ones.

Every nonterminal can be cut at any row, so a long conversation needs no chart over all of its
rows: rows meet in charts of `A_CHART` leaves, whose cells are the leaves of the next chart. A
conversation of any length is so parsed in parts, wherever its rows lie, and its parts are put
together at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import partitions

#: Blank, tab, newline, vertical tab, form feed, return.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Places: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; what each initial leads to.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
WRITTEN = {"u": "user", "a": "assistant"}
#: Places at which a conversation may end.
ENDS = (0, 3)
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q > 1 or (p, q) == (0, 1)]
AT = {pair: k for k, pair in enumerate(PAIRS)}
#: Chomsky normal form: nonterminal, its left and its right part.
RULES = [(AT[p, q], AT[p, r], AT[r, q]) for p, q in PAIRS for r in range(4) if (p, r) in AT and (r, q) in AT]
A_CHART = 16

Cell = list[tuple[int, str] | None]


def _better(cell: Cell, at: int, cost: int, audit: str) -> bool:
    held = cell[at]
    if held is None or (cost, audit) < held:
        cell[at] = (cost, audit)
        return True
    return False


def joined(left: Cell, right: Cell, cell: Cell) -> None:
    """Lower `cell` to what the rules make of two neighbours."""
    for made, a, b in RULES:
        if (x := left[a]) is not None and (y := right[b]) is not None:
            cost, held = x[0] + y[0], cell[made]
            if held is None or cost <= held[0]:
                _better(cell, made, cost, x[1] + y[1])


@lru_cache(maxsize=1)
def _inserted() -> Cell:
    """The cell of no rows: insertions, closed under their succession."""
    cell: Cell = [(0, "") if p == q else None for p, q in PAIRS]
    for c in WRITTEN:
        for p, q in STEPS[c].items():
            _better(cell, AT[p, q], INSERT, "I")
    before: Cell = []
    while before != cell:
        before = list(cell)
        joined(before, before, cell)
    return cell


@lru_cache(maxsize=64)
def _row(initial: str, gone: bool, truncated: bool) -> Cell:
    """The cell of one row; `gone` rows can only be deleted."""
    cell: Cell = [(DELETE, "D") if p == q else None for p, q in PAIRS]
    if not gone:
        for c, steps in STEPS.items():
            for p, q in steps.items():
                if c == initial:
                    _better(cell, AT[p, q], KEEP + TRUNCATED * truncated, "K")
                if c in WRITTEN:
                    _better(cell, AT[p, q], REROLE + TRUNCATED * truncated, "R")
    before: Cell = [None] * len(PAIRS)
    closed: Cell = [None] * len(PAIRS)
    joined(_inserted(), cell, before)
    joined(before, _inserted(), closed)
    return closed


def row_cell(initial: str, gone: bool, truncated: bool) -> Cell:
    return _row(initial if initial in STEPS else "", gone, truncated)


def parse(leaves: list[Cell]) -> Cell:
    """The chart over neighbouring leaves, by span length and over all splits; the cell of all of them."""
    n = len(leaves)
    if not n:
        return _inserted()
    chart = [{i + 1: leaf} for i, leaf in enumerate(leaves)]
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = [None] * len(PAIRS)
            for k in range(i + 1, i + length):
                joined(chart[i][k], chart[k][i + length], cell)
            chart[i][i + length] = cell
    return chart[0][n]


class Spans:
    """Leaves in their order, as charts of at most A_CHART leaves, level by level."""

    def __init__(self) -> None:
        self.levels: list[list[Cell]] = [[]]

    def add(self, cell: Cell, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(cell)
        if len(self.levels[level]) == A_CHART:
            self.add(parse(self.levels[level]), level + 1)
            self.levels[level] = []

    def cell(self) -> Cell:
        """Later leaves lie in lower levels."""
        rest: list[Cell] = []
        for held in self.levels:
            if held or rest:
                rest = [parse(held + rest)]
        return parse(rest)


def least(cell: Cell) -> tuple[int, str]:
    """Cheapest edits of a whole conversation, of equal ones the ASCII-least."""
    return min(c for q in ENDS if (c := cell[AT[0, q]]) is not None)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone) after the damage that crc32(`conv:turn`) % 20 decides.

    0 drops a row (it stays, marked gone, so that its conversation is known), 1 empties its
    text, 2 takes away `.!?`, 3 repeats it with the same turn, 4 makes its role user; a null
    counts as one space, but a null turn stays null.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    hit = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    told = rows.select(
        "conv", "turn", F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (hit == 0).alias("gone"), F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return told.drop("copy")


def as_given(rows: DataFrame) -> DataFrame:
    """Rows without damage, as `damaged` returns them."""
    return rows.select("conv", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("gone"))


def _told() -> Column:
    """A digest of role and text together."""
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def _in_order(df: DataFrame, *first: str) -> DataFrame:
    """Partitions sorted by conversation and turn, nulls first; rows of one turn by role, then by digest."""
    return df.sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "digest")


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_PIECE = "part int, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, lo bigint, hi bigint, first string, last string, costs array<bigint>, audits array<string>"


def _fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


class _Piece:
    """What is known of neighbouring rows of one conversation."""

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = self.before = None
        self.first, self.last = None, None
        self.spans = Spans()

    def row(self, turn: int | None, initial: str, told: bytes, blank: bool, truncated: bool, later: bool) -> None:
        same = self.before == (turn, told)
        self.before = (turn, told)
        fault = "blank" if blank else "duplicate" if later or same else "truncated" if truncated else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if turn is not None:
            self.turns += turn != self.hi
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        self._meet(initial, initial)
        self.n += 1
        self.spans.add(row_cell(initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def _meet(self, first: str, last: str) -> None:
        if self.n:
            self.illegal += self.last + first not in ("su", "ua", "au")
        else:
            self.first = first
        self.last = last

    def piece(self, told: dict) -> None:
        """Add the piece that follows; a turn never lies in two pieces."""
        if not told["n"]:
            return
        self._meet(told["first"], told["last"])
        for c in ("n", *_COUNTS):
            setattr(self, c, getattr(self, c) + told[c])
        if told["lo"] is not None:
            self.lo, self.hi = told["lo"] if self.lo is None else self.lo, told["hi"]
        self.spans.add([None if c is None else (c, a) for c, a in zip(told["costs"], told["audits"], strict=True)])

    def out(self) -> dict:
        cell = self.spans.cell()
        held = {c: getattr(self, c) for c in ("n", *_COUNTS, "lo", "hi", "first", "last")}
        return held | {"costs": [c and c[0] for c in cell], "audits": [c and c[1] for c in cell]}


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[bool, object, tuple]]:
    """(begins a conversation, conversation, values) of sorted rows."""
    current, begun = None, False
    for b in batches:
        columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ["conv", *names]]
        for conv, *values in zip(*columns, strict=True):
            fresh = not begun or conv != current
            current, begun = conv, True
            yield fresh, conv, tuple(values)


def _pieces(schema: pa.Schema):
    """Sorted rows as one piece for each conversation of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out, conv = TaskContext.get().partitionId(), None, [], None
        for fresh, c, (turn, gone, initial, told, blank, truncated, later) in _groups(batches, ["turn", "gone", "initial", "digest", "blank", "truncated", "later"]):
            if fresh:
                if held:
                    out.append({"conv": conv, "part": part} | held.out())
                held, conv = _Piece(), c
                if len(out) >= 1000:
                    yield _arrow(out, schema)
                    out = []
            if not gone:
                held.row(turn, initial, told, blank, truncated, later)
        if held:
            out.append({"conv": conv, "part": part} | held.out())
        yield _arrow(out, schema)

    return run


_PARSED = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _whole(schema: pa.Schema):
    """Sorted pieces as whole conversations."""

    def of(conv, held: _Piece) -> dict:
        cost, audit = least(held.spans.cell())
        gaps = 0 if held.lo is None else held.hi - held.lo + 1 - held.turns
        return {"conv": conv, "gaps": gaps, "cost": cost, "audit": audit} | {c: getattr(held, c) for c in ("blank", "duplicate", "truncated", "illegal")}

    names = [f.name for f in _fields(_PIECE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, out = None, None, []
        for fresh, c, values in _groups(batches, names):
            if fresh:
                if held:
                    out.append(of(conv, held))
                held, conv = _Piece(), c
                if len(out) >= 1000:
                    yield _arrow(out, schema)
                    out = []
            held.piece(dict(zip(names, values, strict=True)))
        if held:
            out.append(of(conv, held))
        yield _arrow(out, schema)

    return run


class Writer:
    """Applies an audit to rows as they come and hashes what is written."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.digest, self.begun = hashlib.sha256(), False

    def _write(self, role: str, text: str, place: int) -> None:
        self.digest.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun, self.place = True, place

    def _next(self, text: str) -> None:
        """A written role: assistant after user, else user."""
        c = "a" if self.place == 2 else "u"
        self._write(WRITTEN[c], text, STEPS[c][self.place])

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._next("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._write(role, text, STEPS[role[0]][self.place])
        elif edit == "R":
            self._next(text)

    def end(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def _hashed(schema: pa.Schema):
    """Each conversation's parse, then its rows in order, as one row with the hash of what is repaired."""
    names = [f.name for f in _fields(_PARSED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed, writer, out = None, None, []
        for fresh, conv, (role, text, told) in _groups(batches, ["role", "text", "parsed"]):
            if fresh:
                if parsed is not None:
                    out.append(parsed | {"repaired_sha256": writer.end()})
                parsed, writer = {"conv": conv} | {c: told[c] for c in names}, Writer(told["audit"])
                if len(out) >= 1000:
                    yield _arrow(out, schema)
                    out = []
            else:
                writer.row(role, text)
        if parsed is not None:
            out.append(parsed | {"repaired_sha256": writer.end()})
        yield _arrow(out, schema)

    return run


def _arrow_schema(fields: list[StructField]) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType(fields)
    return kind, to_arrow_schema(kind)


def repair_conversations(rows: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    With `damage`, rows are first damaged as `damaged` says. Rows are taken by turn, nulls first;
    of one turn by role, then by the digest of role and text, so that equal rows stand side by
    side. A null role or text counts as one space; a null conversation is one of its own. Turns
    are whole numbers. A conversation without rows has zeros, an empty audit and the hash of the
    empty string; an empty table gives no rows; other columns are not read.

    Rows are dealt by ranges of (conversation, turn), so a conversation with a third of all rows
    is parsed by many tasks. Only its hash, which no one can take in parts, reads the repaired
    rows one after the other, a batch at a time.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    given = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    told = (damaged(given) if damage else as_given(given)).withColumn("digest", _told())
    bare = F.rtrim("text", F.lit(SPACE))
    known = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).alias("t"))
    light = told.select(
        "conv", "turn", "role", "gone", "digest", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), known.alias("known"),
    )
    # rows told again at a later turn: only role and text that recur over turns are met
    recur = light.filter("not gone").groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("known").alias("since"), F.max("known").alias("until"))
    recur = recur.filter("since <> until").select("c", "d", "since")
    marked = light.join(recur, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    marked = marked.select("conv", "turn", "role", "gone", "digest", "initial", "blank", "truncated", F.coalesce(F.col("known") > F.col("since"), F.lit(False)).alias("later"))
    conv = StructField("conv", told.schema["conv"].dataType)
    kind, arrow = _arrow_schema([conv, *_fields(_PIECE)])
    pieces = _in_order(marked.repartitionByRange(n, "conv", F.col("turn").asc_nulls_first())).mapInArrow(_pieces(arrow), kind)
    kind, arrow = _arrow_schema([conv, *_fields(_PARSED)])
    parsed = pieces.repartition(n, "conv").sortWithinPartitions("conv", "part").mapInArrow(_whole(arrow), kind)
    # a parse comes before its rows, and meets them where they are written
    first = parsed.select("conv", F.lit(0).alias("after"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("digest", "binary"), ("text", "string"))), F.struct(*[f.name for f in _fields(_PARSED)]).alias("parsed"))
    then = told.filter("not gone").select("conv", F.lit(1).alias("after"), "turn", "role", "digest", "text", F.lit(None).cast(first.schema["parsed"].dataType).alias("parsed"))
    kind, arrow = _arrow_schema([conv, *_fields(_PARSED), *_fields("repaired_sha256 string")])
    done = _in_order(first.unionByName(then).repartition(n, "conv"), "after").mapInArrow(_hashed(arrow), kind)
    return done.withColumnRenamed("conv", "conv_id")
