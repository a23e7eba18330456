"""Cheapest repair of conversations by weighted interval parsing.

Repaired role initials must spell ``(s?(ua)+)?``. Edits: Keep costs 0, Rerole to user
or assistant 2, Delete 3 (the only one for a blank or duplicate row), Insert an
empty-text user or assistant row 2; a truncated row that stays adds 1. Of the cheapest
lists of edits the one whose initials are least in ASCII order is taken.

Grammar: a nonterminal X(p, q) derives the rows that lead from state p to state q of
that pattern, in Chomsky normal form: X(p, q) -> X(p, r) X(r, q), or X(p, q) -> a row.
A cell holds, for a span of rows, the least (cost, initials) of each nonterminal.
Insertions come in by closure: the cell of an empty span, closed under inserting, is
put before each row and behind the last. Every split of a span gives the same cell,
as all ways through the split are nonterminals; so spans are combined bottom-up by
length 1, 2, 4, ... with one split each. Initials of a span end with those of its last
row, so of two different ones neither begins the other, and the least of a whole is
the least of its parts.

A conversation may hold a third of all rows. Rows without their texts are sorted by
range, so it lies in many tasks; each task parses blocks of up to ``BLOCK`` rows. What
is passed on from a block is its costs and the order of its initials: going back over
a conversation's blocks gives the cost from each state to the end, going forth picks
each block's nonterminal. Only conversations at the rims of a task's rows or of more
than one block take this way. Texts are shuffled once: rows and the edits of blocks are
streamed in the order of their conversation, which a digest of a whole conversation
needs in any case, with no more in memory than a batch and a few blocks' edits.

Order of rows: conv_id, turn (null first), then the digest of role and text. Faults, of
each row the first that holds: blank (nothing but white space), duplicate (role and text
seen earlier in the conversation), truncated (last character, white space aside, not
one of ``.!?``).

Defined results: a null role or text is one space; rows with a null conv_id form one
conversation; repeated rows are duplicates; an initial other than s, u, a is never kept;
a conversation whose rows are all deleted is empty; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, read, stored

SPACE = " \t\n\x0b\x0c\r"
#: States: 0 start, 1 after s, 2 after u, 3 after a; the end may follow 0 and 3.
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of one block.
BLOCK = 4096
SHORT = 16


def _pairs() -> list[tuple[int, int]]:
    pairs = {(p, p) for p in range(4)} | {(p, q) for (_, p), q in STEP.items()}
    while (more := pairs | {(p, s) for p, q in pairs for r, s in pairs if q == r}) != pairs:
        pairs = more
    return sorted(pairs)


PAIRS = _pairs()
AT = {pair: i for i, pair in enumerate(PAIRS)}
RULES = [(AT[p, q], AT[p, r], AT[r, q]) for p, q in PAIRS for r in range(4) if (p, r) in AT and (r, q) in AT]


def least(*found):
    return min((x for x in found if x is not None), default=None)


def combine(a: tuple, b: tuple) -> tuple:
    """The cell of two spans side by side."""
    out = [None] * len(PAIRS)
    for x, y, z in RULES:
        if a[y] is not None and b[z] is not None:
            made = (a[y][0] + b[z][0], a[y][1] + b[z][1])
            if out[x] is None or made < out[x]:
                out[x] = made
    return tuple(out)


def _closure() -> tuple:
    cell = tuple((0, "") if p == q else (INSERT, "I") if any(STEP.get((x, p)) == q for x in "ua") else None for p, q in PAIRS)
    while (more := tuple(map(least, cell, combine(cell, cell)))) != cell:
        cell = more
    return cell


#: The empty span: what inserting alone can do.
CLOSED = _closure()
#: From each state to an end by inserting alone.
TAIL = [least(*(CLOSED[AT[q, e]] for e in ENDS if (q, e) in AT)) for q in range(4)]


def row_cell(kind: str) -> tuple:
    """The cell of a row: 's', 'u', 'a', 'o' (other), in capitals if truncated, 'x' (blank) or 'y' (duplicate)."""
    cell = {(p, p): (DELETE, "D") for p in range(4)}
    extra, initial = TRUNCATED * kind.isupper(), kind.lower()
    for (role, p), q in STEP.items() if kind not in "xy" else ():
        kept = (KEEP + extra, "K") if role == initial else None
        changed = (REROLE + extra, "R") if role != "s" else None
        cell[p, q] = least(cell.get((p, q)), kept, changed)
    return tuple(cell.get(pair) for pair in PAIRS)


def _doubled(cells: list[tuple]) -> tuple:
    while len(cells) > 1:
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


@lru_cache(1 << 14)
def _short(kinds: str) -> tuple:
    return _doubled([combine(CLOSED, row_cell(k)) for k in kinds])


def parse(kinds: str) -> tuple:
    """The cell of a span of at least one row."""
    return _doubled([_short(kinds[i:i + SHORT]) for i in range(0, len(kinds), SHORT)])


def onward(cell: tuple, after: list) -> list:
    """For each state before the span, the cheapest (cost, order of the initials, nonterminal) up to the end."""
    out = []
    for p in range(4):
        ways = [(cell[i][0] + after[q], cell[i][1], i) for i, (s, q) in enumerate(PAIRS)
                if s == p and cell[i] is not None and after[q] is not None]
        out.append(min(ways, default=None))
    return out


def whole(kinds: str) -> str:
    """The edits of a whole conversation."""
    cost, edits, i = onward(parse(kinds), [t[0] for t in TAIL])[0]
    return edits + TAIL[PAIRS[i][1]][1]


# --- rows ------------------------------------------------------------------------------------

def _role(name: str = "role") -> Column:
    return F.coalesce(name, F.lit(" "))


def _tie(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def prepared(turns: DataFrame) -> DataFrame:
    """conv_id, turn, tie, role, text."""
    role, text = _role(), _role("text")
    return columns(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), _tie(role, text).alias("tie"), role.alias("role"), text.alias("text"))


def kinds(rows: DataFrame) -> DataFrame:
    """conv_id, turn, tie and kind of each row; of equal rows of one turn only those behind the first are still to be marked."""
    end = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(end == "", "x").when(F.right(end, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    keys = rows.select("conv_id", "turn", "tie", kind.alias("kind"))
    again = keys.where("kind != 'x'").groupBy("conv_id", "tie").agg(
        F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unnumbered")).where("n > 1")
    again = again.select(F.col("conv_id").alias("a_conv"), F.col("tie").alias("a_tie"), "first", "unnumbered")
    later = F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    return keys.join(again, keys["conv_id"].eqNullSafe(again["a_conv"]) & (keys["tie"] == again["a_tie"]), "left").select(
        "conv_id", "turn", "tie", F.when(later & (F.col("kind") != "x"), "y").otherwise(F.col("kind")).alias("kind"))


BLOCKS = ("conv_id long, turn long, tie string, part long, block long, kinds string, edits string, "
          "costs array<long>, orders array<long>, audits array<string>")


def _blocks(batches, size: int):
    """Parsed blocks of this task's sorted rows: with edits if the conversation is surely whole and one block,
    else with the cells' costs, the order of their initials, and the initials."""
    part, number, run, held, previous, cut = TaskContext.get().partitionId(), 0, 0, [], None, False
    made: list[tuple] = []

    def close(last: bool) -> None:
        nonlocal number
        spelt = "".join(k for *_, k in held)
        conv, turn, tie, _ = held[0]
        if run > 1 and not last and not cut:
            made.append((conv, turn, tie, part, number, spelt, whole(spelt), None, None, None))
        else:
            cell = parse(spelt)
            order = {a: i for i, a in enumerate(sorted({c[1] for c in cell if c}))}
            made.append((conv, turn, tie, part, number, spelt, None, [c and c[0] for c in cell], [c and order[c[1]] for c in cell], [c and c[1] for c in cell]))
        number += 1
        held.clear()

    def out():
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made), TYPES)], NAMES)

    for b in batches:
        for conv, turn, tie, kind in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "tie", "kind"))):
            if previous is None or previous[0] != conv:
                if held:
                    close(False)
                run, cut = run + 1, False
            elif len(held) == size:
                cut = True
                close(False)
            if previous == (conv, turn, tie) and kind != "x":
                kind = "y"
            previous = (conv, turn, tie)
            held.append((conv, turn, tie, kind))
        if made:
            yield out()
            made = []
    if held:
        close(True)
        yield out()


NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
         pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]


def choose(blocks: list[tuple[list, list]]) -> list[tuple[int, str]]:
    """The nonterminal of each block of a conversation, from (costs, orders), and what is inserted behind it."""
    ways, after = [], [t[0] for t in TAIL]
    for costs, orders in reversed(blocks):
        ways.append(onward([None if c is None else (c, o) for c, o in zip(costs, orders)], after))
        after = [w and w[0] for w in ways[-1]]
    out, state = [], 0
    for way in reversed(ways):
        out.append((way[state][2], ""))
        state = PAIRS[way[state][2]][1]
    out[-1] = (out[-1][0], TAIL[state][1])
    return out


def _chosen(batches):
    conv, held = None, []

    def out():
        picks = choose([(c, o) for _, _, c, o in held])
        return [(part, block, pick, tail) for (part, block, _, _), (pick, tail) in zip(held, picks)]
    for b in batches:
        made = []
        for c, *block in zip(*(b.column(n).to_pylist() for n in ("conv_id", "part", "block", "costs", "orders"))):
            if held and c != conv:
                made += out()
                held = []
            conv = c
            held.append(block)
        if made:
            yield pa.record_batch([pa.array(x) for x in zip(*made)], ["part", "block", "pick", "tail"])
    if held:
        yield pa.record_batch([pa.array(x) for x in zip(*out())], ["part", "block", "pick", "tail"])


def edit_lists(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, turn and tie of each block's first row, part, block, kinds of its rows and its edits."""
    order = ["conv_id", "turn", "tie"]
    blocks = stored(kinds(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda batches: _blocks(batches, size), BLOCKS), "repair-blocks")
    names = ["conv_id", "turn", "tie", "part", "block", "kinds", "edits"]
    open_ = blocks.where("edits IS NULL")
    picks = open_.select("conv_id", "part", "block", "costs", "orders").repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", "block").mapInArrow(_chosen, "part long, block long, pick long, tail string")
    picked = open_.drop("edits").join(picks, ["part", "block"]).withColumn(
        "edits", F.concat(F.get("audits", F.col("pick")), "tail"))
    return blocks.where("edits IS NOT NULL").select(*names).union(picked.select(*names))


EDITED = "conv_id long, place long, edit string, fault string, turn long, was string, role string, text string"
FAULTS = {"x": "blank", "y": "duplicate"}


def _edited(batches):
    """Applies the edits of blocks to the rows behind them, one conversation after the other."""
    conv, state, place, edits, marks = (), 0, 0, deque(), deque()
    made: list[tuple] = []

    def inserted() -> None:
        nonlocal state, place
        while edits and edits[0] == "I":
            role = "assistant" if state == 2 else "user"
            made.append((conv[0], place, edits.popleft(), None, None, None, role, ""))
            state, place = STEP[role[0], state], place + 1

    def out():
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made), EDITED_TYPES)], EDITED_NAMES)

    for b in batches:
        for c, turn, head, spelt, list_, was, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "head", "kinds", "edits", "role", "text"))):
            if conv != (c,):
                inserted()
                conv, state, place = (c,), 0, 0
            if head:
                edits.extend(list_)
                marks.extend(spelt)
                continue
            inserted()
            edit, kind = edits.popleft(), marks.popleft()
            role = was if edit != "R" else "assistant" if state == 2 else "user"
            made.append((c, place, edit, FAULTS.get(kind) or ("truncated" if kind.isupper() else None), turn, was, role, text))
            state, place = state if edit == "D" else STEP[role[0], state], place + 1
        if made:
            yield out()
            made = []
    inserted()
    if made:
        yield out()


EDITED_NAMES = [c.split()[0] for c in EDITED.split(", ")]
EDITED_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in EDITED.split(", ")]


def repaired(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of ``turns`` (conv_id, turn, role, text) and the inserted ones: conv_id, place (of the edit), edit
    (K, R, D, I; rows with D are not in the repaired conversation), fault, turn, was (the role before), role, text.
    A conversation's rows come one after the other, in order, in one partition."""
    rows = prepared(turns)
    none = F.lit(None)
    heads = edit_lists(rows, size).select("conv_id", "turn", "tie", F.lit(True).alias("head"), "part", "block", "kinds", "edits",
                                    none.cast("string").alias("role"), none.cast("string").alias("text"))
    rows = rows.select("conv_id", "turn", "tie", F.lit(False).alias("head"), none.cast("long").alias("part"), none.cast("long").alias("block"),
                       none.cast("string").alias("kinds"), none.cast("string").alias("edits"), "role", "text")
    return heads.union(rows).repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "tie", F.desc("head"), "part", "block").mapInArrow(_edited, EDITED)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PRICES = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
LEGAL = {"su", "ua", "au"}


class _Summary:
    """Counts, edits and digest of one conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.audit, self.sha, self.any, self.cost, self.before = conv, [], hashlib.sha256(), False, 0, None
        self.faults, self.illegal, self.turns, self.first, self.last = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, None, None

    def add(self, edit, fault, turn, was, role, text) -> None:
        self.audit.append(edit)
        self.cost += PRICES[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.faults[fault] += 1
        if edit != "D":
            self.sha.update((b"\n" if self.any else b"") + f"{role}:{text}".encode())
            self.any = True
        if edit != "I":
            self.illegal += self.before is not None and self.before + was[:1] not in LEGAL
            self.before = was[:1]
            if turn is not None and turn != self.last:
                self.turns, self.last = self.turns + 1, turn
                self.first = turn if self.first is None else self.first

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _summed(batches):
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in SUMMARY.split(", ")]
    now = None
    for b in batches:
        made = []
        for conv, *rest in zip(*(b.column(n).to_pylist() for n in ("conv_id", "edit", "fault", "turn", "was", "role", "text"))):
            if now is None or now.conv != conv:
                if now is not None:
                    made.append(now.row())
                now = _Summary(conv)
            now.add(*rest)
        if made:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made), types)], names)
    if now is not None:
        yield pa.record_batch([pa.array([x], t) for x, t in zip(now.row(), types)], names)


def summaries(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row per conversation with rows: faults, gaps in the turn numbers, illegal neighbours, cost, edits, digest of the repaired rows."""
    return repaired(turns, size).mapInArrow(_summed, SUMMARY)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of ``conv_id:turn`` decides."""
    rows = columns(conversations, "conv_id", "turn", "role", "text")
    key = F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")])
    what = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.select("conv_id", "turn", F.when(what == 4, "user").otherwise(_role()).alias("role"), text.alias("text"), what.alias("what"))
    return rows.where("what != 0").select(
        "conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1)))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, edits and digest of every damaged conversation."""
    rows = read(spark, sf_dir, "conversations")
    every = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = summaries(damaged(rows))
    zero = F.lit(0).cast("long")
    return every.join(found, every["id"].eqNullSafe(found["conv_id"]), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(n, zero).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """DuckDB SQL: crc32 bit by bit, then a recursion from a conversation's last row to its first that keeps, for each
    state, the least text of cost (nine digits) and initials."""
    def plus(state: str, cost: str, letter: str) -> str:
        return f"printf('%09d', CAST(substr({state}, 1, 9) AS INTEGER) + {cost}) || '{letter}' || substr({state}, 10)"

    def ways(p: int) -> str:
        steps = {(r, q) for (r, s), q in STEP.items() if s == p}
        found = [plus(f"b.s{p}", "3", "D")]
        found += [f"CASE WHEN r.alive AND r.initial = '{r}' THEN {plus(f'b.s{q}', 'r.cut', 'K')} END" for r, q in sorted(steps)]
        found += [f"CASE WHEN r.alive THEN {plus(f'b.s{q}', '2 + r.cut', 'R')} END" for r, q in sorted(steps) if r != "s"]
        return f"least({', '.join(found)}) AS r{p}"

    two, three = f"least(r2, {plus('r3', '2', 'I')})", f"least(r3, {plus('r2', '2', 'I')})"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, role, text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(s) + 1), lambda i:
      list_transform(range(0, 8), lambda j: ((ascii(s[i]) >> j) & 1)::UBIGINT)))),
    lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) % 20 AS what FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE what WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS initial FROM hurt),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
rows AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS alive, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM faults),
convs AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
back(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n + 1, '000000000', '000000004II', '000000002I', '000000000' FROM convs
  UNION ALL
  SELECT conv_id, i, least(r0, {plus(two, '2', 'I')}), least(r1, {plus(two, '2', 'I')}), {two}, {three} FROM (
    SELECT b.conv_id, r.i, {', '.join(map(ways, range(4)))}
    FROM back b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1) w),
told AS (SELECT conv_id, CAST(substr(s0, 1, 9) AS BIGINT) AS cost, substr(s0, 10) AS audit FROM back WHERE i = 1),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM told),
edits AS (
  SELECT conv_id, j, audit[j] AS edit, length(replace(audit[:j], 'I', '')) AS i, length(replace(audit[:j - 1], 'D', '')) AS place FROM letters),
kept AS (
  SELECT e.*, r.role, r.text, bool_or(e.edit = 'K' AND place = 0 AND r.initial = 's') OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
joined AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS lines FROM kept GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(t.cost, 0) AS cost, coalesce(t.audit, '') AS audit,
  sha256(coalesce(l.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN convs c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN joined l ON l.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE = _oracle()
