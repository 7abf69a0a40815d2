"""Conversation structure repair by weighted CYK interval parsing.

A conversation should read as an optional system turn and pairs of user and assistant turns, or be empty.
Its rows may be kept, given the other role, deleted, or turns may be inserted, each at a cost; the cheapest
edits win, and among these the ones whose initials are least in ASCII.

Grammar. A nonterminal [p q] covers a span of rows whose edits lead the dialogue from stage p to stage q;
stages are ``0`` (nothing yet), ``s``, ``u`` and ``a`` after the last turn's role. In Chomsky normal form there
are the rules [p q] -> [p r] [r q] and, for a single row, [p q] -> row by one of its edits. Insertions give
[p q] -> nothing, and their closure is put around every row once. A cell holds the least (cost, audit); a
span of n rows has n letters that are not ``I`` in any audit, so no audit of equal cost is the beginning of
another and joining least parts gives least wholes. Whatever place a span is split at, some stage holds
there, so every split gives the same cells: spans of one row are joined to spans of 2, 4, 8, .. rows, each
once, and a whole conversation costs time in proportion to its rows instead of their cube.

Spark. Rows without their texts are dealt by range over (conv_id, turn, role, text digest), so a conversation
of any size is cut over many tasks; each joins its spans and gives one table of cells per conversation, and
these are joined in order. Rows equal in all four count as one row with a number. Which rows come first
with their role and text is one aggregation. Texts are only touched by rows that may stay.

Nulls: a null role or text, and a null id or turn in the key that damages, is one space; null ids are one
conversation. Rows come by turn, nulls first, then by role and by SHA-256 of the text. An empty text is
blank. Repeated rows are duplicates. Gaps beyond a long count as 0. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import map_batches, saved

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLE = {"s": "system", "u": "user", "a": "assistant"}
#: What may follow a stage; a dialogue ends in 0 or a.
NEXT = {"0": "su", "s": "u", "u": "a", "a": "u"}
FINAL = "0a"
#: Output batches hold about so many characters.
CHUNK = 4 << 20

Cells = dict[str, tuple[int, str]]


# --- the grammar -----------------------------------------------------------------------------


def _least(cells: Cells, name: str, cost: int, audit: str) -> None:
    old = cells.get(name)
    if old is None or (cost, audit) < old:
        cells[name] = (cost, audit)


def join(left: Cells, right: Cells) -> Cells:
    """[p q] from every [p r] of the left and [r q] of the right span."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                _least(out, p + q, cost + more, audit + rest)
    return out


def _nothing() -> Cells:
    """The empty span, by insertions only."""
    out: Cells = {p + p: (0, "") for p in NEXT}
    for _ in NEXT:
        for (p, r), (cost, audit) in list(out.items()):
            for q in NEXT[r].replace("s", ""):
                _least(out, p + q, cost + INSERT, audit + "I")
    return out


NOTHING = _nothing()


def row_cells(initial: str, fault: str) -> Cells:
    """One row with any insertions around it. ``fault``: b(lank), d(uplicate), t(runcated) or nothing."""
    out: Cells = {p + p: (DELETE, "D") for p in NEXT}
    if fault not in ("b", "d"):
        extra = TRUNCATED if fault == "t" else 0
        for p, follow in NEXT.items():
            for q in follow:
                if q == initial:
                    _least(out, p + q, KEEP + extra, "K")
                if q != "s":
                    _least(out, p + q, REROLE + extra, "R")
    return join(join(NOTHING, out), NOTHING)


_ROWS = {(i, f): row_cells(i, f) for i in ("s", "u", "a", "") for f in ("", "b", "d", "t")}


def parse(spans: Sequence[Cells]) -> Cells:
    """Neighbouring spans joined two by two until one is left."""
    spans = list(spans) or [NOTHING]
    while len(spans) > 1:
        spans = [join(spans[i], spans[i + 1]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def deleted_run(n: int) -> Cells:
    """n rows that must go, by doubling."""
    whole, power = None, _ROWS["", "d"]
    while n:
        if n & 1:
            whole = power if whole is None else join(whole, power)
        n >>= 1
        power = join(power, power) if n else power
    return whole


def best_repair(cells: Cells) -> tuple[int, str]:
    return min(cells["0" + q] for q in FINAL if "0" + q in cells)


# --- rows ------------------------------------------------------------------------------------


def space_if_null(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """conv_id, turn, role, text and times: rows dropped, emptied, left without ends, repeated or given to the user.

    What happens hangs on crc32 of ``conv_id:turn`` only.
    """
    kind = F.crc32(F.concat_ws(":", space_if_null("conv_id"), space_if_null("turn"))) % kinds
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space_if_null("text"), ".!?", "")).otherwise(space_if_null("text"))
    return rows.filter(kind != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space_if_null("role")).alias("role"), text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def as_given(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the form ``repair`` takes."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space_if_null("role").alias("role"), space_if_null("text").alias("text"), F.lit(1).cast("long").alias("times"))


_ORDER = ["conv_id", "turn", "role", "digest"]


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(light rows in no order, rows that may stay with their texts)."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = F.when(trimmed == "", "b").when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    full = rows.select("conv_id", "turn", "role", "text", "times", F.sha2("text", 256).alias("digest"), fault.alias("fault"))
    # Rows that are first with their role and text: the least turn, a null turn before all.
    first = F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn"))
    stay = saved(
        full.filter("fault <> 'b'").groupBy("conv_id", "role", "text").agg(first.alias("at"), F.first("digest").alias("digest"), F.first("fault").alias("fault"))
        .select("conv_id", F.col("at.turn").alias("turn"), "role", "text", "digest", "fault"),
        "repair-stay",
    )
    both = full.select(*_ORDER, "fault", "times", F.lit(0).alias("first")).unionByName(stay.select(*_ORDER, "fault", F.lit(0).cast("long").alias("times"), F.lit(1).alias("first")))
    light = both.groupBy(*_ORDER).agg(F.max("fault").alias("fault"), F.sum("times").alias("times"), F.max("first").alias("first"))
    return saved(light.select(*_ORDER, F.substring("role", 1, 1).alias("initial"), "fault", "times", "first"), "repair-light"), stay


_PAIRS = ("su", "ua", "au")
_CELL = "array<struct<name: string, cost: bigint, audit: string>>"
_SPANS = f"conv_id bigint, part int, illegal bigint, first string, last string, cells {_CELL}"


class _Span:
    """The rows of one conversation in one task, joined as they come.

    Finished spans are kept by length, longest first, as a binary counter does, so a row is joined into
    spans of 1, 2, 4, .. rows and few spans are held.
    """

    def __init__(self):
        self.spans: list[tuple[int, Cells]] = []
        self.first = self.last = None
        self.illegal = 0

    def add(self, cells: Cells, rows: int) -> None:
        self.spans.append((rows, cells))
        while len(self.spans) > 1 and self.spans[-2][0] <= self.spans[-1][0]:
            n, right = self.spans.pop()
            m, left = self.spans.pop()
            self.spans.append((m + n, join(left, right)))

    def row(self, initial: str, fault: str, times: int, first: int) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in _PAIRS:
            self.illegal += 1
        self.last = initial
        self.illegal += times - 1  # A role never follows itself.
        known = initial if initial in ("s", "u", "a") else ""
        if fault == "b" or not first:
            self.add(deleted_run(times), times)
            return
        self.add(_ROWS[known, fault], 1)
        if times > 1:
            self.add(deleted_run(times - 1), times - 1)

    def cells(self) -> Cells:
        out = self.spans[-1][1]
        for _, left in reversed(self.spans[:-1]):
            out = join(left, out)
        return out


def _spans(light: DataFrame) -> DataFrame:
    """One table of cells per conversation and task, over rows dealt by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[dict] = []
        size = 0
        conv, span = None, None

        def put() -> None:
            nonlocal size
            cells = span.cells()
            out.append({
                "conv_id": conv, "part": part, "illegal": span.illegal, "first": span.first, "last": span.last,
                "cells": [{"name": n, "cost": c, "audit": a} for n, (c, a) in sorted(cells.items())],
            })
            size += sum(64 + len(a) for _, a in cells.values())

        schema = pa.schema([
            ("conv_id", pa.int64()), ("part", pa.int32()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
            ("cells", pa.list_(pa.struct([("name", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))),
        ])
        for b in batches:
            for c, *row in zip(*(b.column(n).to_pylist() for n in ("conv_id", "initial", "fault", "times", "first"))):
                if span is None or c != conv:
                    if span is not None:
                        put()
                    conv, span = c, _Span()
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                span.row(*row)
        if span is not None:
            put()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    # Few rows need few tasks; a range is cut wherever it falls, also inside a conversation.
    dealt = light.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return dealt.select("conv_id", "initial", "fault", "times", "first").transform(map_batches, run, _SPANS)


def _joined(spans: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit): the spans of a conversation joined in order; they are as many as tasks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, cells, illegal, last, out, size = None, None, 0, None, [], 0
        schema = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

        def put() -> None:
            nonlocal size
            cost, audit = best_repair(cells)
            out.append({"conv_id": conv, "illegal": illegal, "cost": cost, "audit": audit})
            size += 64 + len(audit)

        for b in batches:
            for r in b.to_pylist():
                mine = {c["name"]: (c["cost"], c["audit"]) for c in r["cells"]}
                if cells is None or r["conv_id"] != conv:
                    if cells is not None:
                        put()
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                    conv, cells, illegal = r["conv_id"], mine, r["illegal"]
                else:
                    cells = join(cells, mine)
                    illegal += r["illegal"] + (last + r["first"] not in _PAIRS)
                last = r["last"]
        if cells is not None:
            put()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    ordered = spans.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.transform(map_batches, run, "conv_id bigint, illegal bigint, cost bigint, audit string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, turns) of conversations given by ``as_given`` or ``damaged``.

    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv_id, place (from 0),
    edit (K, R or I), role, text of every turn of the repaired dialogues; a conversation's turns stand
    together and in order in one partition.
    """
    light, stay = _prepared(rows)
    cells = saved(_spans(light), "repair-spans")
    parsed = saved(_joined(cells), "repair-parsed")
    span = F.col("last").cast("decimal(20,0)") - F.col("first").cast("decimal(20,0)") + 1 - F.col("turns")
    deleted = F.when(F.col("fault") != "b", F.col("times") - F.col("first")).otherwise(0)
    per_turn = light.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("fault") == "b", F.col("times")).otherwise(0)).alias("blank"), F.sum(deleted).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "t", F.col("first")).otherwise(0)).alias("truncated"),
    )
    counts = per_turn.groupBy("conv_id").agg(
        F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("turn").alias("turns"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
    ).select("conv_id", F.coalesce(span.try_cast("long"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated")
    same = F.col("c.conv_id").eqNullSafe(F.col("p.conv_id"))
    summary = counts.alias("c").join(parsed.alias("p"), same).select("c.*", "p.illegal", "p.cost", "p.audit")
    return summary, _turns(parsed, light, stay)


def _turns(parsed: DataFrame, light: DataFrame, stay: DataFrame) -> DataFrame:
    """The audit of a conversation comes first, then its rows in order, those that may stay with their texts."""
    none = F.lit(None).cast("string")
    audits = parsed.select("conv_id", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("digest"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("times"))
    # Every row has its letter in the audit; those that must go have no text to send.
    gone = light.select("conv_id", F.lit(1).alias("tag"), "turn", "role", "digest", none.alias("text"), (F.col("times") - F.col("first")).alias("times")).filter("times > 0")
    able = stay.select("conv_id", F.lit(1).alias("tag"), "turn", "role", "digest", "text", F.lit(1).cast("long").alias("times"))
    # A row that may stay comes before its own repeats.
    met = audits.unionByName(gone).unionByName(able).withColumn("repeat", F.col("text").isNull())
    ordered = met.repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "digest", "repeat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        conv, audit, at, place, stage, out, size = None, "", 0, 0, "0", [], 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, stage, size
            out.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
            place, stage, size = place + 1, role[0], size + 64 + len(text)

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", ROLE[NEXT[stage][-1]], "")
                at += 1

        for b in batches:
            for c, tag, role, text, times in zip(*(b.column(n).to_pylist() for n in ("conv_id", "tag", "role", "text", "times"))):
                if tag == 0:
                    conv, audit, at, place, stage = c, text, 0, 0, "0"
                    inserted()
                    continue
                for _ in range(times):
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        put(edit, role if edit == "K" else ROLE[NEXT[stage][-1]], text)
                    inserted()
                if size > CHUNK:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.select("conv_id", "tag", "role", "text", "times").transform(
        map_batches, run, "conv_id bigint, place bigint, edit string, role string, text string"
    )


def dialogue_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines; ``turns`` as ``repair`` gives them, in order.

    A digest is sequential, so a conversation's turns pass one task, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, out = None, None, []
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        for b in batches:
            for c, place, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if state is not None:
                        out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state is not None:
            out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return turns.transform(map_batches, run, "conv_id bigint, repaired_sha256 string")


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    summary, turns = repair(damaged(given))
    every = given.select("conv_id").distinct()
    none = F.sha2(F.lit("").cast("binary"), 256)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = every.alias("e").join(summary.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")), "left").select(
        "e.conv_id", *["s." + c for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")]
    )
    return out.alias("o").join(dialogue_digests(turns).alias("d"), F.col("o.conv_id").eqNullSafe(F.col("d.conv_id")), "left").select(
        "o.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )


#: The same by a walk over the rows that keeps the cheapest audit of every stage. crc32 is taken bit by bit.
OP13_SQL = """
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
marked AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(name, ''),
             lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
             lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END)) % 20 AS kind FROM given),
times AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, kind, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
    FROM marked WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS pos,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, left(role, 1) AS i FROM times),
faulty AS (
    SELECT *, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                   WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
           lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(fault = 'b') AS BIGINT) AS blank, CAST(count_if(fault = 'd') AS BIGINT) AS duplicate,
           CAST(count_if(fault = 't') AS BIGINT) AS truncated, CAST(count_if(before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal, count(*) AS n
    FROM faulty GROUP BY conv_id),
follows(p, q) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
inserts(p, q, cost, audit, said) AS (
    VALUES ('0','0',0,'',''), ('s','s',0,'',''), ('u','u',0,'',''), ('a','a',0,'',''), ('0','u',5,'I',chr(10)||'user:'), ('s','u',5,'I',chr(10)||'user:'),
           ('u','a',5,'I',chr(10)||'assistant:'), ('a','u',5,'I',chr(10)||'user:'), ('0','a',10,'II',chr(10)||'user:'||chr(10)||'assistant:'),
           ('s','a',10,'II',chr(10)||'user:'||chr(10)||'assistant:')),
edits AS (
    SELECT conv_id, pos, p, p AS q, 2 AS cost, 'D' AS audit, '' AS said FROM faulty, (VALUES ('0'), ('s'), ('u'), ('a')) v(p)
    UNION ALL SELECT conv_id, pos, p, q, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM faulty, follows WHERE fault IN ('', 't') AND i = q
    UNION ALL SELECT conv_id, pos, p, q, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R', chr(10) || CASE q WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text
    FROM faulty, follows WHERE fault IN ('', 't') AND q <> 's'),
moves AS (
    SELECT conv_id, pos, e.p, x.q, e.cost + x.cost AS cost, e.audit || x.audit AS audit, e.said || x.said AS said FROM edits e JOIN inserts x ON e.q = x.p),
walk AS (
    SELECT f.conv_id, CAST(0 AS BIGINT) AS pos, x.q, CAST(x.cost AS BIGINT) AS cost, x.audit, x.said FROM facts f, inserts x WHERE x.p = '0'
    UNION ALL
    SELECT conv_id, pos, q, m.cost, m.audit, m.said FROM (
        SELECT w.conv_id, m.pos, m.q, min({'cost': w.cost + m.cost, 'audit': w.audit || m.audit, 'said': w.said || m.said}) AS m
        FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1 AND m.p = w.q GROUP BY w.conv_id, m.pos, m.q)),
best AS (
    SELECT f.conv_id, min({'cost': w.cost, 'audit': w.audit, 'said': w.said}) AS b FROM facts f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.n
    WHERE w.q IN ('0', 'a') GROUP BY f.conv_id)
SELECT e.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
       coalesce(f.illegal, 0) AS illegal, coalesce(b.b.cost, 0) AS cost, coalesce(b.b.audit, '') AS audit, sha256(coalesce(substr(b.b.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
"""
