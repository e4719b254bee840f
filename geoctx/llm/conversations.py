"""Conversation structure repair: the cheapest edits that make roles alternate, found by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from geoctx.catalog.base import Catalog
from geoctx.llm.common import pa_schema
from geoctx.session import cut_lineage

CATALOG = Catalog()

#: What the roles of the rows taken so far allow next: nothing yet, a system row, a user row last, an assistant row last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A conversation may end without rows or behind an assistant.
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60
#: Rows of a conversation that one search takes; longer conversations are searched piece by piece and joined.
SEGMENT = 2_000


def _next(state: int, role: str) -> int | None:
    """The state behind a row whose role begins with ``role``, or None where it may not stand."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def _turn(state: int) -> tuple[str, int]:
    """The only role of user and assistant that may follow, and the state behind it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def _moves(code: str | None, state: int) -> list[tuple[str, int, int]]:
    """``(edit, cost, state behind it)`` of every edit before the end (``code`` None) or at a row.

    A row's code is the initial of its role (``-`` where it is none of s, u, a), in upper case if truncated (``+``
    for ``-``), or ``.`` for a row that has to go. Every edit but an insert takes the row.
    """
    role, behind = _turn(state)
    out = [("I", INSERT, behind)]
    if code is None:
        return out
    out.append(("D", DELETE, state))
    if code != ".":
        own, extra = code.lower(), TRUNCATED if code.isupper() or code == "+" else 0
        kept = _next(state, own)
        if kept is not None:
            out.append(("K", KEEP + extra, kept))
        if own != role:
            out.append(("R", REROLE + extra, behind))
    return out


def _bounds(codes: str, ends: tuple[int, ...]) -> list[list[int]]:
    """For each row and state, a lower bound of what the rest costs: its cheapest edits, whatever their audit."""
    bound = [[NEVER] * 4 for _ in range(len(codes) + 1)]
    for i in range(len(codes), -1, -1):
        here, code = bound[i], codes[i] if i < len(codes) else None
        for state in range(4):
            least = 0 if code is None and state in ends else NEVER
            for edit, cost, behind in _moves(code, state):
                if edit != "I":
                    least = min(least, cost + bound[i + 1][behind])
            here[state] = least
        for _ in range(3):  # rows put in before row i: three in a row reach every state that any number reaches
            for state in range(4):
                here[state] = min(here[state], INSERT + here[_turn(state)[1]])
    return bound


def search(codes: str, start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """The least ``(cost, audit)`` of edits that lead the rows ``codes`` from ``start`` to one of ``ends``, None if none does.

    Depth-first branch-and-bound with an explicit stack. A prefix is dropped if its cost and the lower bound of the
    rest exceed the incumbent's cost, if they equal it and its audit already comes after the incumbent's, or if the
    dominance table of its node (row, state) holds a prefix as cheap with an audit as small. Two prefixes of equal
    cost at one node are never one the beginning of the other, so the smaller stays smaller whatever follows. The
    stack is empty only when nothing better can exist.
    """
    bound = _bounds(codes, ends)
    if bound[0][start] >= NEVER:
        return None
    best: tuple[int, str] = (NEVER, "")
    seen: list[dict[int, tuple[int, str]]] = [{} for _ in range(len(codes) + 1)]
    stack: list[tuple[int, int, int, tuple | None, int]] = [(0, start, 0, None, 0)]  # row, state, cost, path, length

    def spelled(path: tuple | None) -> str:
        out = []
        while path:
            path, edit = path
            out.append(edit)
        return "".join(reversed(out))

    while stack:
        i, state, cost, path, length = stack.pop()
        least = cost + bound[i][state]
        if least > best[0]:
            continue
        known = seen[i].get(state)
        if known and known[0] < cost:
            continue
        if (known and known[0] == cost) or least == best[0]:
            audit = spelled(path)
            if (known and known[0] == cost and spelled(known[1]) <= audit) or (least == best[0] and audit > best[1][:length]):
                continue
        seen[i][state] = (cost, path)
        if i == len(codes) and state in ends:
            best = min(best, (cost, spelled(path)))
        code = codes[i] if i < len(codes) else None
        after = []
        for edit, price, behind in _moves(code, state):
            row = i if edit == "I" else i + 1
            if cost + price + bound[row][behind] <= best[0]:
                after.append((cost + price + bound[row][behind], edit, (row, behind, cost + price, (path, edit), length + 1)))
        # the most promising edit comes off the stack first
        stack.extend(node for _, _, node in sorted(after, key=lambda a: (a[0], a[1]), reverse=True))
    return best


@lru_cache(maxsize=50_000)
def _whole(codes: str) -> tuple[int, str]:
    return search(codes)


def _between(codes: str) -> list[str]:
    """Cost and audit from each state to each state, as ``cost:audit`` (empty: no way)."""
    found = [search(codes, a, (b,)) for a in range(4) for b in range(4)]
    return [f"{f[0]}:{f[1]}" if f else "" for f in found]


def _joined(pieces: list[list[str]]) -> tuple[int, str]:
    """The least (cost, audit) through consecutive pieces of a conversation."""
    here: dict[int, tuple[int, str]] = {START: (0, "")}
    for ways in pieces:
        after: dict[int, tuple[int, str]] = {}
        for a, (cost, audit) in here.items():
            for b in range(4):
                if ways[4 * a + b]:
                    more, _, edits = ways[4 * a + b].partition(":")
                    after[b] = min(after.get(b, (NEVER, "")), (cost + int(more), audit + edits))
        here = after
    return min(here[e] for e in ENDS if e in here)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of ``rows`` after the fixed damage by ``crc32(conv_id:turn) % 20``.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's. A NULL reads as one
    blank, in the key too; ``conv_id`` and ``turn`` themselves stay NULL.
    """
    kind = F.crc32(F.concat(_text(rows["conv_id"]), F.lit(":"), _text(rows["turn"])).cast("binary")) % 20
    plain = rows.select(rows["conv_id"], rows["turn"].cast("long").alias("turn"), _text(rows["role"]).alias("role"), _text(rows["text"]).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return plain.where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


_LAST = r"(?s)^.*[^\x20\x09-\x0D]"


def _light(rows: DataFrame) -> DataFrame:
    """Rows without texts: one per different row, with its number of copies, its faults and the first turn of such a row."""
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    bare = F.translate("text", " \t\n\x0b\x0c\r", "")
    one = rows.select(
        "conv_id", "turn", "role", digest.alias("digest"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
    ).groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.any_value("blank").alias("blank"), F.any_value("truncated").alias("truncated"))
    one = cut_lineage(one)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = one.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    later = one.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    again = F.coalesce(place != F.col("first"), F.lit(False))
    return later.select("conv_id", "turn", "role", "digest", "copies", "blank", "truncated", again.alias("again"))


_SUMMARY = "n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


class _Piece:
    """Counts and codes of consecutive rows of one conversation."""

    def __init__(self, whole: bool) -> None:
        self.codes: list[str] = []
        self.whole, self.n, self.turns, self.blank, self.duplicate, self.truncated, self.illegal = whole, 0, 0, 0, 0, 0, 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, copies: int, blank: bool, truncated: bool, again: bool) -> None:
        initial = role[:1]
        if self.n:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.illegal += copies - 1  # a copy follows its like
        self.last = initial
        self.n += copies
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        code = initial if initial in ("s", "u", "a") else "-"
        if blank:
            self.blank += copies
            self.codes.extend("." * copies)
            return
        goes = copies if again else copies - 1
        self.duplicate += goes
        if not again:
            self.truncated += truncated
            self.codes.append(("+" if code == "-" else code.upper()) if truncated else code)
        self.codes.extend("." * goes)

    def row(self, conv, no: int, ends: bool) -> dict:
        codes, whole = "".join(self.codes), self.whole and ends
        cost, audit = _whole(codes) if whole else (None, None)
        return {
            "conv_id": conv, "no": no, "whole": whole, "first": self.first, "last": self.last, "codes": None if whole else codes, "n": self.n, "low": self.low, "high": self.high,
            "turns": self.turns, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit,
        }


def _summaries(light: DataFrame, conv: str, segment: int) -> DataFrame:
    """``conv_id`` and its counts, cost and audit, from a sort over the whole table in which one conversation may span many tasks.

    A conversation that lies within one task and one piece is searched at once. Of others each piece is searched from
    every state to every state, in parallel; only the results meet in one place.
    """
    order = ["conv_id", "turn", "role", "digest"]
    rows = light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "copies", "blank", "truncated", "again")
    ddl = f"conv_id {conv}, no long, whole boolean, first string, last string, codes string, {_SUMMARY}"
    schema = pa_schema(light.sparkSession, ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 40
        piece, current, opened, out = None, None, False, []
        for batch in batches:
            for conv_id, turn, role, copies, *faults in zip(*(c.to_pylist() for c in batch.columns)):
                # copies of one row are cut too: the first as it is, the others have to go
                while copies:
                    if piece is None or conv_id != current or piece.n >= segment:
                        if piece is not None:
                            out.append(piece.row(current, no, conv_id != current))
                        no += 1
                        # a task's first conversation may have begun in the task before
                        piece = _Piece(opened and conv_id != current)
                        current, opened = conv_id, True
                    some = min(copies, max(segment - piece.n, 1))
                    piece.add(turn, role, some, *faults)
                    faults = [faults[0], faults[1], True]
                    copies -= some
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if piece is not None:
            out.append(piece.row(current, no, False))  # it may go on in the next task
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    cuts = cut_lineage(rows.mapInArrow(cut, ddl))
    names = ["conv_id", "n", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    # the pieces' own order, for Arrow takes no ways along where a conversation is whole
    ways_ddl = f"conv_id {conv}, no long, first string, last string, ways array<string>, {_SUMMARY}"
    ways_schema = pa_schema(light.sparkSession, ways_ddl)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{k: row.get(k) for k in ways_schema.names} | {"ways": _between(row["codes"])}], schema=ways_schema)

    out_ddl = f"conv_id {conv}, {_SUMMARY}"
    out_schema = pa_schema(light.sparkSession, out_ddl)

    def join(group: pa.Table) -> pa.Table:
        parts = group.sort_by("no").to_pylist()
        out = {"conv_id": parts[0]["conv_id"], "low": None, "high": None, **{k: sum(p[k] for p in parts) for k in ("n", "turns", "blank", "duplicate", "truncated", "illegal")}}
        for before, after in zip(parts, parts[1:]):
            out["illegal"] += before["last"] + after["first"] not in _LEGAL
        for p in parts:
            if p["low"] is not None:
                out["turns"] -= out["high"] == p["low"]
                out["low"], out["high"] = p["low"] if out["low"] is None else out["low"], p["high"]
        cost, audit = _joined([p["ways"] for p in parts])
        return pa.Table.from_pylist([out | {"cost": cost, "audit": audit}], schema=out_schema)

    pieces = cuts.where("NOT whole").mapInArrow(solve, ways_ddl)
    return cuts.where("whole").select(names).unionByName(pieces.groupBy("conv_id").applyInArrow(join, out_ddl))


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The conversation that the edits of ``audit`` make of ``rows (role, text)``."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K":
            state = _next(state, role[:1])
            yield role, text
        elif edit != "D":
            initial, state = _turn(state)
            yield {"u": "user", "a": "assistant"}[initial], text


def repair(rows: DataFrame, all_ids: DataFrame | None = None, segment: int = SEGMENT, texts: bool = False) -> DataFrame:
    """The cheapest repair of every conversation of ``rows (conv_id, turn, role, text)``: counts of faults, cost, audit and the result.

    Rows stand by turn (NULL first); rows of one turn by role, then by a hash of the text, so that equal rows are
    neighbours. ``repaired_sha256`` is the hash of the result's ``role:text`` lines; with ``texts`` the lines follow as
    ``repaired array<struct<role, text>>``. ``all_ids (conv_id)`` adds conversations without rows (zeros, empty audit,
    hash of the empty string). A NULL role or text reads as one blank; NULL ``conv_id`` is one conversation. No rows and
    no ids give no rows; other columns are not looked at. A conversation's texts pass one by one through the task that
    hashes them and are never held together (but for ``texts``).
    """
    spark = rows.sparkSession
    # one name for the id whatever the input calls its other columns
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _text(rows["role"]).alias("role"), _text(rows["text"]).alias("text"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    summary = _summaries(_light(rows), conv, segment)
    ids = (rows if all_ids is None else all_ids).select("conv_id").distinct()
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    parts = ids.select("conv_id", F.lit(0).alias("part")).unionByName(summary.withColumn("part", F.lit(1)), allowMissingColumns=True)
    parts = parts.unionByName(rows.select("conv_id", "turn", "role", "text", digest.alias("digest"), F.lit(2).alias("part")), allowMissingColumns=True)
    order = ["conv_id", "part", "turn", "role", "digest"]
    parts = parts.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "part", "role", "text", "n", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    ddl = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    full = ddl + ", repaired array<struct<role: string, text: string>>"
    schema = pa_schema(spark, full)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out, held = [], 0
        found, here = stream(), None

        def one() -> dict:
            """The conversation whose first row is ``here``; leaves the next one's first row there."""
            nonlocal here
            conv_id, row = here[0], here
            here = next(found, None)
            if row[1] == 0:
                if here is None or here[0] != conv_id or here[1] != 1:
                    return {"conv_id": conv_id, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest(), "repaired": []}
                row, here = here, next(found, None)
            low, high, turns, blank, duplicate, truncated, illegal, cost, audit = row[5:]

            def own() -> Iterator[tuple[str, str]]:
                nonlocal here
                while here is not None and here[0] == conv_id and here[1] == 2:
                    yield here[2], here[3]
                    here = next(found, None)

            lines, sha, kept = own(), hashlib.sha256(), []
            for k, (role, text) in enumerate(repaired_rows(audit, lines)):
                sha.update(("\n" if k else "").encode() + f"{role}:{text}".encode())
                if texts:
                    kept.append({"role": role, "text": text})
            for _ in lines:  # deleted rows at the end
                pass
            return {
                "conv_id": conv_id, "gaps": 0 if low is None else high - low + 1 - turns, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
                "cost": cost, "audit": audit, "repaired_sha256": sha.hexdigest(), "repaired": kept,
            }

        here = next(found, None)
        while here is not None:
            out.append(one())
            held += 1 + sum(len(r["text"]) for r in out[-1]["repaired"])
            if held >= 1 << 20 or len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    done = parts.mapInArrow(finish, full)
    return done if texts else done.drop("repaired")


def _sql_add(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """State strings hold the cost in twelve digits and the audit; lines of the result follow apart."""
    grown = f"{state}.r" if line is None else f"list_append({state}.r, {line})"
    return f"CASE WHEN {state} IS NULL THEN NULL ELSE {{'k': lpad((substr({state}.k, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}.k, 13) || '{letter}', 'r': {grown}}} END"


def _sql_least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _oracle() -> str:
    """The same repair as a walk over all states at once, row by row."""
    crc_table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"
    u = _sql_least("w.u", *(_sql_add(f"w.{q}", "3", "I", "'user:'") for q in ("o", "s", "a")))
    a = _sql_least("v.a", _sql_add("v.u", "3", "I", "'assistant:'"))
    own, extra = "x.role || ':' || x.text", "x.late"
    to_u = [f"CASE WHEN x.initial = 'u' THEN {_sql_add(f'x.{q}', extra, 'K', own)} ELSE {_sql_add(f'x.{q}', f'3 + {extra}', 'R', chr(39) + 'user:' + chr(39) + ' || x.text')} END" for q in ("o", "s", "a")]
    to_a = f"CASE WHEN x.initial = 'a' THEN {_sql_add('x.u', extra, 'K', own)} ELSE {_sql_add('x.u', f'3 + {extra}', 'R', chr(39) + 'assistant:' + chr(39) + ' || x.text')} END"
    kept = lambda state: f"CASE WHEN NOT x.goes THEN {state} END"
    return f"""
WITH RECURSIVE crc AS (SELECT {crc_table} AS tab),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) AS seen, translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare FROM hurt),
marked AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND seen > 1 AS again,
  bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'k': '000000000000', 'r': []::VARCHAR[]}} AS o, NULL::STRUCT(k VARCHAR, r VARCHAR[]) AS s, NULL::STRUCT(k VARCHAR, r VARCHAR[]) AS u, NULL::STRUCT(k VARCHAR, r VARCHAR[]) AS a FROM counts
  UNION ALL
  SELECT x.conv_id, x.i, {_sql_add('x.o', '4', 'D')}, {_sql_least(_sql_add('x.s', '4', 'D'), kept(f"CASE WHEN x.initial = 's' THEN {_sql_add('x.o', extra, 'K', own)} END"))},
    {_sql_least(_sql_add('x.u', '4', 'D'), *(kept(t) for t in to_u))}, {_sql_least(_sql_add('x.a', '4', 'D'), kept(to_a))}
  FROM (SELECT m.conv_id, m.i, m.role, m.text, m.initial, m.blank OR m.again AS goes, CASE WHEN m.cut THEN 3 ELSE 0 END AS late, v.o, v.s, v.u, {a} AS a
    FROM (SELECT w.conv_id, w.i, w.o, w.s, w.a, {u} AS u FROM walk w) v JOIN marked m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND m.i = v.i + 1) x),
done AS (SELECT v.conv_id, {_sql_least('v.o', a)} AS best FROM (SELECT w.conv_id, w.o, w.a, {u} AS u FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i) v)
SELECT ids.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(substr(d.best.k, 1, 12)::BIGINT, 0) AS cost, coalesce(substr(d.best.k, 13), '') AS audit, sha256(coalesce(array_to_string(d.best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM ids.conv_id"""


@CATALOG.add("op12_conversations", _oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(cut_lineage(damaged(rows)), rows)
