"""Repair of a conversation's structure at least cost, on a bidirectional tight-arc graph.

A conversation's rows are layers, the states of the role pattern (nothing yet, after system, after user,
after assistant) its nodes; keeping, changing the role of or deleting a row leads to the next layer, inserting a
turn stays in it. Forward least costs F from the start and backward least costs B to the end show all
arcs of cheapest repairs: those with F + cost + B = least. A walk over these tight arcs takes the least
edit letter at each step, with all nodes that this leaves as its frontier.

Rows are dealt by ranges of (conversation, turn), so one conversation may lie in many tasks. A task cuts
its rows into segments and sums a segment up as a matrix of least costs between states; these matrices,
one for a thousand rows, are chained per conversation; then every segment is repaired by itself, for
each state that a cheapest repair can enter it in, and the pieces are joined in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups, in_arrow, partitions, stash

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant; a repaired conversation ends in 0 or 3.
START, LAST = 0, (0, 3)
#: The state that a kept row leads to, by its role's initial.
_KEPT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The state that a row with a new role and an inserted turn lead to, and the role they get.
_PUT = [2, 2, 3, 2]
_ROLE = ["", "", "user", "assistant"]
FAR = 1 << 60
#: Rows and characters of a segment at most (or one row).
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 20
BLANK, DUPLICATE, CUT = 1, 2, 3

_GAP = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. The rows with faults planted by a checksum of `conv_id:turn`, nulls
    being one space: 0 of 20 drops the row, 1 empties it, 2 removes its sentence ends, 3 repeats it, 4
    makes its role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


def _fault(first: Column, text: Column) -> Column:
    bare = F.btrim(text, F.lit(_GAP))
    return F.when(bare == "", BLANK).when(~first, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(0).cast("int")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their first fault: (conv_id, turn, role, text, digest, times, first, fault). Rows equal in
    all are one row, `times` of them; first: whether the first of them has a role and text not seen before.
    fault is that of this first one; the others are duplicates, or blank like it."""
    keys = ["no_conv", "conv", "has_turn", "at", "role", "digest"]  # nulls as values, so that equality is plain
    base = rows.select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).cast("long").alias("at"), "role", F.sha2("text", 256).alias("digest"), "text")
    same = stash(base.groupBy(*keys).agg(F.first("text").alias("text"), F.count("*").alias("times")))
    seen = same.groupBy("no_conv", "conv", "role", "digest").agg(F.min(F.struct("has_turn", "at")).alias("when")).select("no_conv", "conv", "when.has_turn", "when.at", "role", "digest", F.lit(True).alias("first"))
    out = same.join(seen, keys, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return out.withColumn("fault", _fault(F.col("first"), F.col("text")))


def _options(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """Arcs from a state over a row: (letter, cost, next state)."""
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        out.append(("R", REROLE + more, _PUT[state]))
        if initial in _KEPT[state]:
            out.append(("K", KEEP + more, _KEPT[state][initial]))
    return out


_ARCS = {(s, i, f): _options(s, i, f) for s in range(4) for i in ("s", "u", "a", "") for f in range(4)}


def _inserted(cost: list[int]) -> list[int]:
    """Least costs to go once turns may be inserted first; twice around the states is enough."""
    cost = list(cost)
    for _ in range(3):
        cost = [min(c, INSERT + cost[_PUT[s]]) for s, c in enumerate(cost)]
    return cost


#: Costs to go after the last row.
END = _inserted([0 if s in LAST else FAR for s in range(4)])


#: A row as the repair sees it: its role's initial, its fault, and how many copies follow it. Copies can
#: only be deleted, and D comes before I, so they stand right after their first row.
Layer = tuple[str, int, int]


def _back(layers: list[Layer], end: list[int]) -> list[list[int]]:
    """Costs to go before each row, and at the end: out[i][state]."""
    out = [end]
    for initial, fault, copies in reversed(layers):
        after = out[-1]
        out.append(_inserted([min(c + after[t] for _, c, t in _ARCS[s, initial, fault]) + DELETE * copies for s in range(4)]))
    return out[::-1]


def _ahead(layers: list[Layer], begin: list[int]) -> list[list[int]]:
    """Costs so far before each row, insertions before it included, and at the end."""
    def spread(cost: list[int]) -> list[int]:
        cost = list(cost)
        for _ in range(3):
            for s in range(4):
                cost[_PUT[s]] = min(cost[_PUT[s]], cost[s] + INSERT)
        return cost

    out = []
    for initial, fault, copies in layers:
        begin = spread(begin)
        out.append(begin)
        after = [FAR] * 4
        for s in range(4):
            for _, c, t in _ARCS[s, initial, fault]:
                after[t] = min(after[t], begin[s] + c + DELETE * copies)
        begin = after
    out.append(begin)
    return out


def _walk(layers: list[Layer], state: int, ahead: list[list[int]], back: list[list[int]], least: int) -> tuple[str, list[tuple[int, int]], int]:
    """From a state before the first row, over tight arcs, least letter first: the letters, what is
    written (row, or -1 for an inserted turn; the state it leads to), and the state after the last row.
    A frontier's nodes are of one state each here, since a letter leads to one state from each."""
    said, written, frontier = [], [], {state: None}
    for i, (initial, fault, copies) in enumerate(layers):
        while True:
            found: dict[str, dict[int, int]] = {}
            for s in frontier:
                for letter, c, t in _ARCS[s, initial, fault]:
                    if ahead[i][s] + c + DELETE * copies + back[i + 1][t] == least:
                        found.setdefault(letter, {})[t] = s
                if ahead[i][s] + INSERT + back[i][_PUT[s]] == least:
                    found.setdefault("I", {})[_PUT[s]] = s
            letter = min(found)
            said.append(letter)
            frontier = found[letter]
            if letter == "I":
                written.append((-1, next(iter(frontier))))
                continue
            if letter != "D":
                written.append((i, next(iter(frontier)) if letter == "R" else 0))
            said.append("D" * copies)
            break
    return "".join(said), written, next(iter(frontier))


_SEGMENT = "no_conv boolean, conv long, part int, seq int, rows array<struct<role:string,text:string,fault:int,times:bigint>>, low long, high long, turns long, first_at struct<has_turn:boolean,at:bigint>, last_at struct<has_turn:boolean,at:bigint>, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, matrix array<bigint>"


def _layers(rows: list[dict]) -> list[Layer]:
    return [(x if (x := r["role"][:1]) in ("s", "u", "a") else "", r["fault"], r["times"] - 1) for r in rows]


_LEGAL = {"su", "ua", "au"}


def _summed(held: list[dict]) -> dict:
    """A segment of one conversation."""
    layers = _layers(held)
    matrix = []
    for end in range(4):
        matrix += _back(layers, [0 if s == end else FAR for s in range(4)])[0]
    at = sorted({r["at"] for r in held if r["has_turn"]})
    said = [r["role"][:1] for r in held]
    illegal = sum(r["times"] - 1 for r in held) + sum(a + b not in _LEGAL for a, b in zip(said, said[1:]))
    kinds = [sum(r["fault"] == k for r in held) for k in (BLANK, DUPLICATE, CUT)]
    more = [sum(r["times"] - 1 for r in held if (r["fault"] == BLANK) == (k == BLANK)) for k in (BLANK, DUPLICATE)]
    edge = lambda r: {"has_turn": r["has_turn"], "at": r["at"]}
    return {
        "no_conv": held[0]["no_conv"], "conv": held[0]["conv"], "rows": [{k: r[k] for k in ("role", "text", "fault", "times")} for r in held], "low": at[0] if at else None, "high": at[-1] if at else None, "turns": len(at), "first_at": edge(held[0]), "last_at": edge(held[-1]),
        "first_role": said[0], "last_role": said[-1], "blank": kinds[0] + more[0], "duplicate": kinds[1] + more[1], "truncated": kinds[2], "illegal": illegal, "matrix": matrix,
    }


def _segment(schema: pa.Schema, most_rows: int):
    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        ready: list[dict] = []

        def close():
            nonlocal seq, held, size
            ready.append(_summed(held) | {"part": part, "seq": seq})
            seq, held, size = seq + 1, [], 0

        weight = 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and (held[0]["conv"] != r["conv"] or held[0]["no_conv"] != r["no_conv"] or len(held) >= most_rows or size + len(r["text"]) > SEGMENT_CHARS):
                    weight += size
                    close()
                    if len(ready) >= 512 or weight > SEGMENT_CHARS:
                        yield pa.RecordBatch.from_pylist(ready, schema=schema)
                        ready.clear()
                        weight = 0
                held.append(r)
                size += len(r["text"])
        if held:
            close()
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)

    return run


_CHAINED = "no_conv boolean, conv long, part int, seq int, ahead array<bigint>, back array<bigint>, least long, illegal_between long, turns_between long"


def _chain(schema: pa.Schema):
    """A conversation's segments in order: the costs at each one's ends, from their matrices alone."""

    def run(batches):
        for _, table in groups(batches, "key"):
            n = table.num_rows
            m = table.column("matrix").combine_chunks().flatten().to_numpy().reshape(n, 4, 4)  # [end, start]
            ahead, back = np.full((n, 4), FAR, np.int64), np.full((n, 4), FAR, np.int64)
            at = np.array([0, FAR, FAR, FAR], np.int64)
            for i in range(n):
                ahead[i] = at
                at = np.minimum((m[i] + at).min(1), FAR)
            at = np.array(END, np.int64)
            for i in range(n - 1, -1, -1):
                back[i] = at
                at = np.minimum((m[i] + at[:, None]).min(0), FAR)
            first, last, one, two = (table.column(c).to_pylist() for c in ("first_role", "last_role", "first_at", "last_at"))
            illegal = [0] + [int(a + b not in _LEGAL) for a, b in zip(last, first[1:])]
            again = [0] + [int(a == b and a["has_turn"]) for a, b in zip(two, one[1:])]
            columns = [table.column(c).combine_chunks() for c in ("no_conv", "conv", "part", "seq")]
            yield from pa.Table.from_arrays([*columns, pa.array(ahead.tolist()), pa.array(back.tolist()), pa.array([int(at[START])] * n), pa.array(illegal), pa.array(again)], schema=schema).to_batches(max_chunksize=1 << 14)

    return run


_PIECES = "no_conv boolean, conv long, part int, seq int, ways array<struct<state:int,to:int,audit:string,lines:bigint,text:string>>"


def _pieces(schema: pa.Schema):
    """Each segment repaired, for each state that a cheapest repair can enter it in."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                layers = _layers(r["rows"])
                ahead, back = _ahead(layers, r["ahead"]), _back(layers, r["back"])
                ways = []
                for s in range(4):
                    if r["ahead"][s] + back[0][s] != r["least"]:
                        continue
                    audit, written, to = _walk(layers, s, ahead, back, r["least"])
                    lines = []
                    for i, state in written:
                        x = r["rows"][i] if i >= 0 else None
                        lines.append(f"{_ROLE[state] if state else x['role']}:{x['text'] if x else ''}")
                    ways.append({"state": s, "to": to, "audit": audit, "lines": len(lines), "text": "\n".join(lines)})
                out.append({k: r[k] for k in ("no_conv", "conv", "part", "seq")} | {"ways": ways})
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[a : a + 64], schema=schema)

    return run


def _joined(schema: pa.Schema, texts: bool):
    """A conversation's pieces in order: its letters, and the digest of its text as it streams by."""

    def ended(now: dict) -> dict:
        state = now.pop("state")
        while END[state]:  # what is left to insert after the last row
            state = _PUT[state]
            put(now, "I", f"{_ROLE[state]}:", 1)
        now["audit"] = "".join(now["audit"])
        now["repaired_sha256"] = now.pop("sha").hexdigest()
        return now | {"repaired": "\n".join(now.pop("kept")) if texts else None}

    def put(now: dict, audit: str, text: str, lines: int) -> None:
        now["audit"].append(audit)
        if lines:
            if now["n_repaired"]:
                now["sha"].update(b"\n")
            now["sha"].update(text.encode())
            now["n_repaired"] += lines
            if texts:
                now["kept"].append(text)

    def run(batches):
        now, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or (now["no_conv"], now["conv"]) != (r["no_conv"], r["conv"]):
                    if now:
                        out.append(ended(now))
                        if len(out) >= 256:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
                    now = {"no_conv": r["no_conv"], "conv": r["conv"], "state": START, "sha": hashlib.sha256(), "audit": [], "n_repaired": 0, "kept": []}
                way = next(w for w in r["ways"] if w["state"] == now["state"])
                put(now, way["audit"], way["text"], way["lines"])
                now["state"] = way["to"]
        if now:
            out.append(ended(now))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


_REPAIRED = "no_conv boolean, conv long, audit string, n_repaired long, repaired_sha256 string, repaired string"


def _arrow(spark, text: str) -> pa.Schema:
    """An Arrow schema from Spark's DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per conversation that has rows: (id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    n_repaired, repaired_sha256, repaired): its faults, the least cost of edits that make its roles'
    initials `(s?(ua)+)?`, the letters of the first such edits by their letters (K keep, R change role, D
    delete, I insert), and the repaired conversation as lines `role:text` (null with texts=False).

    Rows go by turn (nulls first), then role, then the text's sha256, so ties and repeated rows have one
    order; further rows of the same role and text are duplicates. Null roles and texts are one space: such a
    text is blank, such a role no known one. Rows without an id make one conversation. Very long texts are
    read whole: a segment is one row then. An empty table gives no rows; further columns, whatever their
    names, are ignored. One conversation may hold most rows: they are dealt by ranges of turns, and equal
    rows are counted first. What meets in one task is its segments' matrices (128 bytes for 1,024 rows) and
    its repaired text, which streams through its digest; with texts=True it is a row of the result.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    given = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    order = ["no_conv", "conv", "has_turn", "at", "role", "digest"]
    ranged = stash(faults(given)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    segments = stash(ranged.select("no_conv", "conv", "has_turn", "at", "role", "text", "times", "fault").transform(in_arrow, _segment(_arrow(spark, _SEGMENT), SEGMENT_ROWS), _SEGMENT))
    conv, place = ["no_conv", "conv"], ["no_conv", "conv", "part", "seq"]
    light = segments.select(F.concat_ws(":", *[F.col(c).cast("string") for c in conv]).alias("key"), *place, "matrix", "first_role", "last_role", "first_at", "last_at")
    chained = stash(light.repartition(n, *conv).sortWithinPartitions("key", "part", "seq").transform(in_arrow, _chain(_arrow(spark, _CHAINED)), _CHAINED))
    pieces = segments.select(*place, "rows").join(chained.select(*place, "ahead", "back", "least"), place).transform(in_arrow, _pieces(_arrow(spark, _PIECES)), _PIECES)
    repaired = pieces.repartition(n, *conv).sortWithinPartitions(*place).transform(in_arrow, _joined(_arrow(spark, _REPAIRED), texts), _REPAIRED)
    counts = segments.drop("rows", "matrix").join(chained.drop("ahead", "back"), place).groupBy(*conv).agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.sum("turns_between")), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("illegal_between")).alias("illegal"), F.max("least").alias("cost"))
    out = counts.join(repaired, conv)
    return out.select(F.when(~F.col("no_conv"), F.col("conv")).alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "n_repaired", "repaired_sha256", "repaired")


def all_conversations(rows: DataFrame, repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """repaired, with a row of zeros for each conversation of rows that has lost all of its rows."""
    every = rows.select(F.col(id_col).cast("long").alias("_id")).distinct()
    out = every.join(repaired, F.col("_id").eqNullSafe(F.col(id_col)), "left").drop(id_col).withColumnRenamed("_id", id_col)
    none = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_repaired")}
    return out.na.fill(none | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def repair_sql() -> str:
    """The query's rows for DuckDB: least costs to go by recursion from the last row, then a walk from the first."""
    polynomial = "3988292384"
    shift = f"lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, {polynomial}::bigint) ELSE x >> 1 END"
    table = "list_transform(range(256), lambda b: list_reduce(range(8), " + shift + ", b::bigint))"
    fresh = lambda s: f"least(b[{s + 1}] + 2, CASE WHEN f IN (1, 2) THEN {FAR} ELSE b[{_PUT[s] + 1}] + 1 + c END, CASE WHEN f IN (1, 2) THEN {FAR} " + " ".join(f"WHEN ini = '{k}' THEN b[{t + 1}] + c" for k, t in _KEPT[s].items()) + f" ELSE {FAR} END)"
    put = "CASE WHEN st = 2 THEN 3 ELSE 2 END"
    kept = "CASE WHEN ini = 's' AND st = 0 THEN 1 WHEN ini = 'u' AND st <> 2 THEN 2 WHEN ini = 'a' AND st = 2 THEN 3 END"
    return rf"""
WITH RECURSIVE tab AS (SELECT {table} AS t),
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations),
sums AS (SELECT said.*, xor(list_reduce(list_transform(string_split(k, ''), lambda ch: ascii(ch)::bigint), lambda x, ch: xor(t[(xor(x, ch) & 255) + 1], x >> 8), 4294967295::bigint), 4294967295::bigint) % 20 AS kind FROM said, tab),
damage AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM sums),
placed AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damage WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, left(role, 1) AS ini FROM placed),
layers AS (SELECT conv_id, i, f, ini, role, text, CASE WHEN f = 3 THEN 5 ELSE 0 END AS c FROM faulty),
ends AS (SELECT conv_id, max(i) AS n FROM layers GROUP BY ALL),
fresh AS (SELECT conv_id, n AS i, [0, 10, 5, 0]::bigint[] AS b FROM ends
  UNION ALL
  SELECT conv_id, i - 1, [least(x[1], 5 + x[3], 10 + x[4]), least(x[2], 5 + x[3], 10 + x[4]), least(x[3], 5 + x[4]), least(x[4], 5 + x[3])] FROM (
    SELECT r.conv_id, r.i, [{", ".join(fresh(s) for s in range(4))}]::bigint[] AS x FROM fresh r JOIN layers l ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i)),
walk AS (SELECT conv_id, 0::bigint AS i, 0 AS st, '' AS audit, []::varchar[] AS lines FROM ends
  UNION ALL
  SELECT conv_id, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN st WHEN 'K' THEN kst ELSE pst END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'I' THEN list_append(lines, CASE pst WHEN 2 THEN 'user:' ELSE 'assistant:' END) ELSE list_append(lines, CASE pst WHEN 2 THEN 'user:' ELSE 'assistant:' END || text) END
  FROM (SELECT w.conv_id, w.i, w.st, w.audit, w.lines, l.role, l.text, {put} AS pst, {kept} AS kst,
      CASE WHEN l.i IS NOT NULL AND t.b[st + 1] + 2 = h.b[st + 1] THEN 'D' WHEN 5 + h.b[{put} + 1] = h.b[st + 1] THEN 'I' WHEN {kept} IS NOT NULL AND f NOT IN (1, 2) AND t.b[{kept} + 1] + c = h.b[st + 1] THEN 'K' ELSE 'R' END AS letter
    FROM walk w JOIN fresh h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i LEFT JOIN layers l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1
      LEFT JOIN fresh t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
    WHERE l.i IS NOT NULL OR st IN (1, 2))),
done AS (SELECT w.* FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = e.n WHERE st IN (0, 3)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (i > 1 AND left(before, 1) || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY ALL)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal,
  coalesce(h.b[1], 0)::bigint AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fresh h ON h.conv_id IS NOT DISTINCT FROM o.conv_id AND h.i = 0"""
