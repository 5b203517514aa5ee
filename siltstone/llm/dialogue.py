"""Conversation structure repair by Dijkstra on the implicit edit lattice.

A node is (rows consumed, grammar state); the grammar takes role initials ``(s?(ua)+)?``.  Edits are Keep (0),
Rerole to user or assistant (2), Delete (3) and Insert of an empty user or assistant row (2); a truncated row that is not
deleted costs 1 more, and blank or duplicate rows can only be deleted.  Nodes are popped by (cost, audit), the audit being
the initials of the edits so far; the first accepting end node that is popped gives the cheapest edits and, among these,
the audit that is least in ASCII.

In every state one letter can be inserted or reroled to, so an audit says the path, and equal beginnings of two
audits are the same nodes of the search tree.  Two audits of equal cost are therefore compared below the last common
ancestor, found with jump pointers in logarithmic time; audits are never built while searching.

Rows are dealt by conversation, sorted by turn and read as a stream; a task holds one conversation, about a kilobyte a
row while it is searched.  A conversation is the unit of work, since its audit and its digest are one cell each and
the digest runs over its texts in order.

Defined results: nulls in role and text are one space, so such a role can not be kept; a row whose role
is empty has no initial and can not be kept either; null conversation ids are one conversation; null turns come first, rows
of one turn in the order of role and text, and gaps ignore nulls; a row counts as duplicate if role and text both stood in any
earlier row of the conversation; a conversation all of whose rows are dropped gives zeros, an empty audit and the
digest of the empty string; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from siltstone.llm.common import slices

_BLANK = " \t\n\x0b\x0c\r"
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits (fixed values).
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
LEGAL = {"su", "ua", "au"}

#: Grammar states, and per state the letter that may be inserted or reroled to and where letters lead.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT_LETTER = ("u", "u", "a", "u")
_STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_ACCEPTING = (START, ASSISTANT)
_ROLES = {"u": "user", "a": "assistant"}


class _Node:
    """A node of the search tree: one path of edits, its cost, and a jump pointer to an ancestor."""

    __slots__ = ("cost", "parent", "jump", "depth", "edit", "at", "state")

    def __init__(self, cost: int, parent: _Node | None, edit: str, at: int, state: int) -> None:
        self.cost, self.parent, self.edit, self.at, self.state = cost, parent, edit, at, state
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = parent.depth + 1, parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def __lt__(self, other: _Node) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = self, other
        while a.depth > b.depth:
            a = a.jump if a.jump.depth >= b.depth else a.parent
        while b.depth > a.depth:
            b = b.jump if b.jump.depth >= a.depth else b.parent
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.edit < b.edit


def cheapest_edits(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows with these role initials and faults."""
    n = len(initials)
    heap = [_Node(0, None, "", 0, START)]
    best, done = {0: 0}, set()
    while True:
        node = heapq.heappop(heap)
        at, state = node.at, node.state
        if at == n and state in _ACCEPTING:
            break
        place = at * 4 + state
        if place in done:
            continue
        done.add(place)
        letter = _NEXT_LETTER[state]
        moves = [("I", COSTS["I"], at, _STEPS[state][letter])]
        if at < n:
            moves.append(("D", COSTS["D"], at + 1, state))
            if faults[at] not in (BLANK, DUPLICATE):
                more = faults[at] == TRUNCATED
                to = _STEPS[state].get(initials[at])
                if to is not None:
                    moves.append(("K", COSTS["K"] + more, at + 1, to))
                if initials[at] != letter:  # else keeping it is cheaper
                    moves.append(("R", COSTS["R"] + more, at + 1, _STEPS[state][letter]))
        for edit, cost, to_at, to_state in moves:
            total, to_place = node.cost + cost, to_at * 4 + to_state
            if to_place not in done and total <= best.get(to_place, total):
                best[to_place] = total
                heapq.heappush(heap, _Node(total, node, edit, to_at, to_state))
    edits = []
    cost = node.cost
    while node.parent is not None:
        edits.append(node.edit)
        node = node.parent
    return cost, "".join(reversed(edits))


def faults_of(rows: list[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for row in rows:
        text = row[1].rstrip(_BLANK)
        if not _SOLID.search(text):
            out.append(BLANK)
        elif row in seen:
            out.append(DUPLICATE)
        else:
            out.append(NONE if text[-1] in ".!?" else TRUNCATED)
        seen.add(row)
    return out


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits of ``audit``."""
    out, state, rest = [], START, iter(rows)
    for edit in audit:
        role, text = next(rest) if edit != "I" else ("", "")
        if edit == "D":
            continue
        letter = role[:1] if edit == "K" else _NEXT_LETTER[state]
        out.append((role if edit == "K" else _ROLES[letter], text))
        state = _STEPS[state][letter]
    return out


def _report(turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    faults, initials = faults_of(rows), [role[:1] for role, _ in rows]
    cost, audit = cheapest_edits(initials, faults)
    known = {t for t in turns if t is not None}
    fixed = repaired(rows, audit)
    digest = hashlib.sha256()
    for i, (role, text) in enumerate(fixed):
        digest.update(("\n" if i else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest(), "repaired": [{"role": r, "text": t} for r, t in fixed],
    }


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with the faults that CRC-32 of ``conv:turn`` deals out; ``copies`` says how often a row stands there (0: dropped)."""
    plain = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv_col), F.lit(":"), plain(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(conv_col), F.col(turn_col), plain(role_col).alias(role_col), plain(text_col).alias(text_col), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text_col, ".!?", "")).otherwise(F.col(text_col))
    return rows.select(
        conv_col, turn_col, F.when(F.col("kind") == 4, "user").otherwise(F.col(role_col)).alias(role_col), text.alias(text_col),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies: Column | None = None, messages: bool = True,
) -> DataFrame:
    """One row per conversation: faults found, cost, audit, digest of the repaired rows, and the rows themselves unless ``messages`` is off.

    ``copies`` says how often a row stands in its conversation; 0 is a row that is not there, though its conversation is.
    """
    kind = StructField(conv_col, df.schema[conv_col].dataType)
    ddl = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    ddl += ", repaired array<struct<role:string,text:string>>" if messages else ""
    out = StructType([kind, *_parse_datatype_string(ddl).fields])
    schema = to_arrow_schema(out)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv = False, None
        turns: list[int | None] = []
        rows: list[tuple[str, str]] = []
        made: list[dict] = []
        size = 0

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[f.name] for m in made], f.type) for f in schema], schema=schema)

        for batch in batches:
            for part in slices(batch, "text"):
                columns = [part.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies")]
                for own, turn, role, text, many in zip(*columns, strict=True):
                    if open_ and own != conv:
                        made.append({conv_col: conv} | _report(turns, rows))
                        turns, rows = [], []
                    open_, conv = True, own
                    turns += [turn] * many
                    rows += [(role, text)] * many
                    size += len(text)
                if len(made) > 1024 or size > 4 << 20:
                    if made:
                        yield written()
                    made, size = [], 0
        if open_:
            made.append({conv_col: conv} | _report(turns, rows))
            yield written()

    plain = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(fold, out)
