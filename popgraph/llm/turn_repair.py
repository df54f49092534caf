"""Repair of conversation structure by a Viterbi search whose chunks run in parallel (rank convergence).

A repaired conversation's roles are nothing, or user and assistant in turn after a system row at most. Each row is kept, given
another role or deleted, and empty rows are inserted, at least cost. What is still to pay from a row on depends on one of
four states (nothing yet, after a system, user or assistant row): a vector of four costs, worked out from the last row back.

Rows are ordered by ranges and cut into chunks, so a long conversation is many pieces in many tasks. A piece that is
followed by another one starts from speculative vectors: one for each state, that between them make every vector that can come there.
Mostly its vectors differ only by constants at its first row, and then what follows the piece doesn't matter. Where they still
differ, a fix-up pass from the conversation's end reruns the piece on the vector that did come, as a minimum over its four runs.
Then every piece knows its vector, and how it leads from state to state; a pass forward tells each where it begins, and all pieces
trace their cheapest edits, of equal ones the least in ASCII order, in parallel again.

Rows that must go (blank ones, repeats) cost the same from each state and leave it, so they wait for nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
#: Characters of a text that order rows of equal turn and role; further ones by a hash.
_HEAD = 64
_FORCED = -1
#: A state's next one by a user (0, 1, 3) or an assistant row (2); from state 0 a system row leads to 1.
_NEXT = (2, 2, 3, 2)
_NEW_ROLE = ("user", "user", "assistant", "user")
_END = (0, 2 * INSERT, INSERT, 0)
#: Column j bounds, for any rows that may follow, what a state costs more than state j: its rows s say from where.
_MORE = ((0, 0, INSERT, 2 * INSERT), (2 * INSERT, 0, INSERT, 2 * INSERT), (INSERT + DELETE, INSERT, 0, INSERT), (DELETE, 0, INSERT, 0))
_SPECULATIVE = tuple(tuple(_MORE[s][j] for s in range(4)) for j in range(4))

Vector = tuple[int, int, int, int]


@cache
def _before(kind: int, v: Vector) -> Vector:
    """Costs before a row, from those after it. kind: 2 * (0 other, 1 system, 2 user, 3 assistant) + truncated."""
    role, extra = kind >> 1, (kind & 1) * TRUNCATED
    w = []
    for s in range(4):
        keeps = 1 if role == 1 and s == 0 else _NEXT[s] if role == _NEXT[s] else None
        w.append(min(DELETE + v[s], REROLE + extra + v[_NEXT[s]], *([] if keeps is None else [extra + v[keeps]])))
    for _ in range(2):
        w = [min(w[s], INSERT + w[_NEXT[s]]) for s in range(4)]
    return tuple(w)


@cache
def _back(kind: int, v: Vector) -> tuple[int, Vector]:
    """As _before(), less the least cost, which comes first."""
    w = _before(kind, v)
    least = min(w)
    return least, tuple(x - least for x in w)


@cache
def _act(kind: int, v: Vector, s: int) -> tuple[str, int]:
    """The least letters among the cheapest edits from state s through a row, whose costs after are v; and the state then."""
    if kind == _FORCED:
        return "D", s
    w, letters, role, extra = _before(kind, v), "", kind >> 1, (kind & 1) * TRUNCATED
    while True:
        if DELETE + v[s] == w[s]:
            return letters + "D", s
        if INSERT + w[_NEXT[s]] == w[s]:
            letters, s = letters + "I", _NEXT[s]
            continue
        keeps = 1 if role == 1 and s == 0 else _NEXT[s] if role == _NEXT[s] else None
        if keeps is not None and extra + v[keeps] == w[s]:
            return letters + "K", keeps
        return letters + "R", _NEXT[s]


def _norm(v) -> Vector:
    least = min(v)
    return tuple(x - least for x in v)


def _run_back(kinds: list[int], v: Vector) -> tuple[int, Vector]:
    cost = 0
    for kind in reversed(kinds):
        if kind == _FORCED:
            cost += DELETE
        else:
            more, v = _back(kind, v)
            cost += more
    return cost, v


def _vectors(kinds: list[int], v: Vector) -> list[Vector]:
    """The costs after each row."""
    out = [v] * len(kinds)
    for i in range(len(kinds) - 1, -1, -1):
        out[i] = v
        if kinds[i] != _FORCED:
            v = _back(kinds[i], v)[1]
    return out


def _through(runs: list[tuple[int, Vector]], v: Vector) -> Vector:
    """Costs before a piece whose runs from the speculative vectors are given, where those after it are v."""
    if all(r[1] == runs[0][1] for r in runs):
        return runs[0][1]
    return _norm([min(v[j] + cost + w[s] for j, (cost, w) in enumerate(runs)) for s in range(4)])


def _pieces(convs: list) -> Iterator[tuple[int, int]]:
    a = 0
    for b in range(1, len(convs) + 1):
        if b == len(convs) or convs[b] != convs[a]:
            yield a, b
            a = b


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds at, the row's place over all partitions, chunk, and for a piece's first row its runs from the speculative vectors."""
    part, at = TaskContext.get().partitionId() << 33, 0
    for chunk, batch in enumerate(batches):
        kinds = batch.column("kind").to_pylist()
        runs: list = [None] * len(kinds)
        for a, b in _pieces(batch.column("conv_id").to_pylist()):
            runs[a] = [x for v in _SPECULATIVE for cost, w in [_run_back(kinds[a:b], v)] for x in (cost, *w)]
        n = len(kinds)
        own = [pa.array(range(part + at, part + at + n), pa.int64()), pa.array([part + chunk] * n, pa.int64()), pa.array(runs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "at", "chunk", "runs"])
        at += n


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: pieces of whole conversations, from the last back. Adds the costs after each, and whether it is the last."""
    before, v = (), _END
    for batch in batches:
        after, last = [], []
        for conv, runs in zip(batch.column("conv_id").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            last.append((conv,) != before)
            v = _END if last[-1] else v
            after.append(list(v))
            before, v = (conv,), _through([(runs[k], tuple(runs[k + 1 : k + 5])) for k in range(0, 20, 5)], v)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(after, pa.list_(pa.int64())), pa.array(last)], ["conv_id", "chunk", "after", "last"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: whole pieces' rows in order, with the costs after the piece. A row a piece: where each state leads to."""
    for chunk in _chunks(batches):
        kinds, convs, after, last = (chunk.column(c).to_pylist() for c in ("kind", "conv_id", "after", "last"))
        rows = []
        for a, b in _pieces(convs):
            vectors, leads = _vectors(kinds[a:b], tuple(after[a])), []
            for s in range(4):
                for kind, v in zip(kinds[a:b], vectors, strict=True):
                    s = _act(kind, v, s)[1]
                leads.append(s)
            rows.append((a, leads))
        firsts = chunk.take(pa.array([a for a, _ in rows]))
        yield from pa.table({**{c: firsts.column(c) for c in ("conv_id", "chunk", "after", "last")}, "leads": pa.array([x for _, x in rows], pa.list_(pa.int64()))}).combine_chunks().to_batches()


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: pieces of whole conversations in order. The state in which each is entered takes the place of leads."""
    before, s = (), 0
    for batch in batches:
        enter = []
        for conv, leads in zip(batch.column("conv_id").to_pylist(), batch.column("leads").to_pylist(), strict=True):
            s = s if (conv,) == before else 0
            enter.append(s)
            before, s = (conv,), leads[s]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "chunk", "after", "last")), pa.array(enter, pa.int64())], ["conv_id", "chunk", "after", "last", "enter"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole chunks of rows that come in order of chunk."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for a, b in _pieces(batch.column("chunk").to_pylist()):
            if held and held[-1].column("chunk")[0] != batch.column("chunk")[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_EDIT_COLUMNS = "at long, nth int, edit string, times long, turn long, was string, role string, text string, fault string"


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches):
        kinds, convs, after, last, enter, times, ats, was, faults = (chunk.column(c).to_pylist() for c in ("kind", "conv_id", "after", "last", "enter", "times", "at", "role", "fault"))
        source: list[int] = []  # the row that conv_id comes from
        own: list[int | None] = []  # the row that turn and text come from, if any
        rows: list[tuple] = []

        def put(i: int, nth: int, edit: str, role: str | None, n: int = 1, fault: str | None = None) -> None:
            source.append(i)
            own.append(None if edit == "I" else i)
            rows.append((ats[i], nth, edit, n, None if edit == "I" else was[i], role, fault))

        for a, b in _pieces(convs):
            s, vectors = enter[a] or 0, _vectors(kinds[a:b], _END if after[a] is None else tuple(after[a]))
            for i in range(a, b):
                letters, to = _act(kinds[i], vectors[i - a], s)
                for k in range(len(letters) - 1):
                    put(i, k, "I", _NEW_ROLE[s])
                    s = _NEXT[s]
                put(i, 2, letters[-1], None if letters[-1] == "D" else _NEW_ROLE[s] if letters[-1] == "R" else was[i], fault=faults[i])
                if times[i] > 1:
                    put(i, 3, "D", None, times[i] - 1, "blank" if faults[i] == "blank" else "duplicate")
                s = to
            if last[a] is not False:
                for k in range(_END[s] // INSERT):
                    put(b - 1, 4 + k, "I", _NEW_ROLE[s])
                    s = _NEXT[s]
        cols = list(zip(*rows, strict=True))
        place = pa.array(own, pa.int64())
        text = chunk.column("text").take(place).combine_chunks()
        out = {"conv_id": chunk.column("conv_id").take(pa.array(source))}
        kinds_of = (("at", pa.int64()), ("nth", pa.int32()), ("edit", pa.string()), ("times", pa.int64()))
        out |= {c: pa.array(cols[k], t) for k, (c, t) in enumerate(kinds_of)}
        out |= {"turn": chunk.column("turn").take(place), "was": pa.array(cols[4], pa.string()), "role": pa.array(cols[5], pa.string())}
        out |= {"text": text.fill_null(""), "fault": pa.array(cols[6], pa.string())}
        yield from pa.table(out).combine_chunks().to_batches()


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with times, fault and kind, in order, with at and chunk, as a written table."""
    same = ["conv_id", "turn", "role", "text"]
    distinct = rows.groupBy(*same).agg(F.count("*").alias("times"))
    distinct = C.materialise(distinct.withColumn("order", F.struct(F.col("turn").isNotNull().alias("known"), "turn")), "turns")
    first = distinct.groupBy(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "text")]).agg(F.min("order").alias("first"))
    joined = distinct.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("text") == F.col("f_text")))
    stripped = F.rtrim("text", F.lit(_SPACE))
    blank, truncated = stripped == "", ~F.right(stripped, F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(~F.col("order").eqNullSafe(F.col("first")), "duplicate").when(truncated, "truncated")
    joined = joined.withColumn("fault", fault)
    initial = F.substr("role", F.lit(1), F.lit(1))
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    must_go = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    joined = joined.withColumn("kind", F.when(must_go, _FORCED).otherwise(2 * role + F.col("fault").isNotNull().cast("int")))
    order = [*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")), F.substr("text", F.lit(1), F.lit(_HEAD)).asc(), F.xxhash64("text").asc()]
    kept = C.materialise(joined.select(*same, "times", "fault", "kind"), "judged-turns")
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*kept.schema, T.StructField("at", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType()))])
    return C.materialise(ranged.mapInArrow(_number, schema), "ordered-turns")


def _stitched(ordered: DataFrame, conv: T.DataType) -> DataFrame:
    """(conv_id, chunk, after, last, enter) of the pieces of conversations that have several."""

    def schema(*more: T.StructField) -> T.StructType:
        return T.StructType([T.StructField("conv_id", conv), T.StructField("chunk", T.LongType()), T.StructField("after", T.ArrayType(T.LongType())), T.StructField("last", T.BooleanType()), *more])

    pieces = ordered.where("runs is not null").select("conv_id", "chunk", "runs")
    several = pieces.groupBy(F.col("conv_id").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    pieces = pieces.join(several, F.col("conv_id").eqNullSafe(F.col("k")), "left_semi")
    fixed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(_fix_up, schema())
    fixed = C.materialise(fixed, "fixed-up")
    rows = ordered.select("conv_id", "chunk", "at", "kind")
    led = _attached(rows, fixed).where("last is not null").repartition("chunk").sortWithinPartitions("chunk", "at")
    led = C.materialise(led.mapInArrow(_leads, schema(T.StructField("leads", T.ArrayType(T.LongType())))), "led")
    return C.materialise(led.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_enter, schema(T.StructField("enter", T.LongType()))), "entered")


def _attached(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    pieces = pieces.withColumnsRenamed({"conv_id": "p_conv", "chunk": "p_chunk"})
    return rows.join(pieces, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("chunk") == F.col("p_chunk")), "left").drop("p_conv", "p_chunk")


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits of each conversation: (conv_id, at, nth, edit, times, turn, was, role, text, fault).

    In order of (at, nth) within a conversation: K(eep), R(erole), D(elete) of a row of turns, or I(nsert). times says how many equal rows
    beside each other that is; was is the role before, role and text are those after (role null if deleted, text of deleted
    rows as it was). fault is blank (no word), duplicate (role and text occur earlier), truncated (the last character that is no white space is none
    of .!?) or null. Keeping costs 0, rerole 3, delete 4, insert 3; truncated rows that stay cost 3 more, blank and
    duplicate ones must go. The roles' initials left are those of (s?(ua)+)? and of equal costs the edits are the least in ASCII order.

    Rows are ordered by turn, nulls first, then role, then the text's first 64 characters, then a hash of the text.
    A null role or text is empty, a null conv_id a conversation like others, equal rows are repeats. Roles count by their first letter. An empty table
    gives no rows; further columns are not passed on.
    """
    spark = turns.sparkSession
    C.small_batches(spark)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = _ordered(rows)
    conv = rows.schema["conv_id"].dataType
    whole = _attached(ordered.drop("runs"), _stitched(ordered, conv))
    traced = whole.repartition("chunk").sortWithinPartitions("chunk", "at")
    ddl = T.StructType([T.StructField("conv_id", conv), *T.DataType.fromDDL(_EDIT_COLUMNS)])
    return traced.mapInArrow(_trace, ddl)


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DIGEST_NAMES = ["conv_id", *(x.split()[0] for x in _DIGEST.split(", "))]
_FAULTS = ("blank", "duplicate", "truncated")


class _Digest:
    """Of one conversation, from its edits in order."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(_FAULTS, 0)
        self.illegal = self.cost = self.turns = 0
        self.first = self.latest = self.initial = None
        self.audit: list[str] = []
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, edit: str, times: int, turn: int | None, was: str | None, role: str | None, text: str, fault: str | None) -> None:
        self.audit.append(edit * times)
        self.cost += times * {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.faults[fault] += times
        if edit != "I":
            initial = was[:1]
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.illegal += times - 1  # copies of one row beside each other
            self.initial = initial
            if turn is not None and turn != self.latest:
                self.turns += 1
                self.first = turn if self.first is None else self.first
                self.latest = turn
        if edit != "D":
            self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = self.latest - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *(self.faults[f] for f in _FAULTS), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, key, out, kinds = None, None, [], None

    def done() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], _DIGEST_NAMES)
        out.clear()
        return found

    for batch in batches:
        kinds = [batch.column("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        for conv, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "times", "turn", "was", "role", "text", "fault")), strict=True):
            if now is None or conv != key:
                if now is not None:
                    out.append((key, *now.row()))
                key, now = conv, _Digest()
            now.add(*rest)
        if out:
            yield done()
    if now is not None:
        out.append((key, *now.row()))
        yield done()


def digest(edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of what repair() gives, a row a conversation.

    A hash of a whole conversation needs it in order: its rows stream through one task, which holds one batch and the
    letters of the edits. Conversations without rows are not there.
    """
    C.small_batches(edits.sparkSession)
    ddl = T.StructType([T.StructField("conv_id", edits.schema["conv_id"].dataType), *T.DataType.fromDDL(_DIGEST)])
    return edits.repartition("conv_id").sortWithinPartitions("conv_id", "at", "nth").mapInArrow(_digests, ddl)
