"""Conversations whose turns went wrong, mended by the cheapest edits.

Spark finds the faults of every row and lays the rows of a conversation out in order; a task then walks over them with a
Viterbi search that keeps one survivor per state of the role sequence. Survivors share their past in a tree of
back-pointers that counts who refers to a node. As soon as all survivors pass through one node, the edits up to it are
certain and are emitted, so a task holds the unresolved end of one conversation, whatever its length. Rows that must go
lengthen a run of deletions instead of the tree. Survivors of equal cost are compared by their whole unresolved edits:
both have consumed the same rows, so neither is the beginning of the other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: costs of the edits, and of a truncated row that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What the roles so far spell: nothing, s, an open u, or s?(ua)+.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
NEVER = float("inf")
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FLUSH_ROWS, FLUSH_CHARS = 2000, 1 << 22
_SPACE = r"\x20\x09-\x0D"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): every row as the check sum of its key has it damaged; null roles and texts are
    one space, and so are nulls inside the key. Dropped rows stay as ``gone``, without role and text."""
    fate = F.expr("crc32(concat(coalesce(cast(conv_id AS string), ' '), ':', coalesce(cast(turn AS string), ' '))) % 20")
    fated = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fate.alias("fate"))
    return fated.withColumn("copy", F.expr("explode(if(fate = 3, array(0, 1), array(0)))")).selectExpr(
        "conv_id", "turn", "CASE fate WHEN 0 THEN NULL WHEN 4 THEN 'user' ELSE role END AS role",
        "CASE fate WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text", "fate = 0 AS gone")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``key``, the digest of role and text, and ``fault``, the first fault a row has of its own or through a row of
    an earlier turn. A copy in the same turn is told when the rows are walked, as it comes right behind its original.

    First appearances are counts per (conversation, digest): a text that a third of all rows share is one small row by
    the time it is shuffled, and the join back is on keys that Spark splits when one is hot."""
    marked = rows.select("conv_id", "turn", "role", "text", "gone").withColumn("key", F.expr("unhex(md5(concat(length(role), ':', role, text)))")).withColumn("own", F.expr(
        rf"CASE WHEN gone THEN NULL WHEN NOT text RLIKE r'[^{_SPACE}]' THEN '{BLANK}' WHEN NOT text RLIKE r'[.!?][{_SPACE}]*\z' THEN '{CUT}' END"))
    seen = marked.filter("NOT gone").groupBy(F.col("conv_id").alias("seen_conv"), F.col("key").alias("seen_key")).agg(
        F.count("*").alias("n"), F.min("turn").alias("first"), F.count_if(F.col("turn").isNull()).alias("untold"))
    joined = marked.join(seen.filter("n > 1"), F.expr("conv_id <=> seen_conv AND key = seen_key"), "left")
    return joined.selectExpr(
        "conv_id", "turn", "role", "text", "gone", "key",
        f"CASE WHEN own = '{BLANK}' THEN own WHEN turn > first OR (untold > 0 AND turn IS NOT NULL) THEN '{DUPLICATE}' ELSE own END AS fault")


class Node:
    """A stretch of equal edits behind another; ``refs`` counts the nodes and survivors that point here."""

    __slots__ = ("edit", "times", "turn", "role", "text", "above", "refs")

    def __init__(self, edit: str, above: Node | None, turn: int | None = None, role: str | None = None, text: str | None = None) -> None:
        self.edit, self.times, self.turn, self.role, self.text, self.above, self.refs = edit, 1, turn, role, text, above, 0
        if above is not None:
            above.refs += 1


def _runs(tip: Node, root: Node, last: str) -> list[list]:
    """Edits from ``root`` to ``tip`` and one more, as stretches of equal letters."""
    runs: list[list] = [[last, 1]] if last else []
    while tip is not root:
        if runs and runs[-1][0] == tip.edit:
            runs[-1][1] += tip.times
        else:
            runs.append([tip.edit, tip.times])
        tip = tip.above
    return runs[::-1]


def _before(a: list[list], b: list[list]) -> bool:
    """Whether the letters of ``a`` come before those of ``b``; neither begins the other."""
    for at, ((x, m), (y, n)) in enumerate(zip(a, b)):
        if x != y:
            return x < y
        if m != n:
            # the shorter stretch goes on with its next letter against this one
            longer, rest = (b, a) if m < n else (a, b)
            follows = rest[at + 1][0] if at + 1 < len(rest) else ""
            return (follows < longer[at][0]) == (rest is a)
    return len(a) < len(b)


class Search:
    """The survivors of one conversation. ``step`` takes a row and ``finish`` ends it; both return the edits that became
    certain as (edit, times, turn, role, text)."""

    def __init__(self) -> None:
        self.root = Node("", None)
        self.root.refs = 1
        self.tips: list[Node | None] = [self.root, None, None, None]
        self.costs: list[float] = [0, NEVER, NEVER, NEVER]

    def _wins(self, cost: float, tip: Node, edit: str, held: tuple | None) -> bool:
        if held is None or cost != held[0]:
            return held is None or cost < held[0]
        return _before(_runs(tip, self.root, edit), _runs(held[1], self.root, held[2]))

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            node = node.above

    def _insert(self) -> None:
        """Turns put in: an open user turn from any other state, then an answer to it."""
        for state, role, sources in ((USER, "user", (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, "assistant", (USER,))):
            held = None if self.tips[state] is None else (self.costs[state], self.tips[state], "")
            best = held
            for source in sources:
                tip, cost = self.tips[source], self.costs[source] + INSERT
                if tip is not None and self._wins(cost, tip, "I", best):
                    best = (cost, tip, "I")
            if best is not held:
                node = Node("I", best[1], role=role, text="")
                node.refs = 1
                old, self.tips[state], self.costs[state] = self.tips[state], node, best[0]
                self._release(old)

    def step(self, turn: int | None, role: str, text: str, fault: str | None) -> list[tuple]:
        forced = fault in (BLANK, DUPLICATE)
        if not forced:
            self._insert()
        best: list[tuple | None] = [None] * 4

        def offer(state: int, source: int, cost: float, edit: str, new_role: str | None) -> None:
            tip = self.tips[source]
            if tip is not None and self._wins(self.costs[source] + cost, tip, edit, best[state]):
                best[state] = (self.costs[source] + cost, tip, edit, new_role)

        for state in range(4):
            offer(state, state, DELETE, "D", None)
        if not forced:
            stays, initial = TRUNCATED if fault == CUT else 0, role[:1]
            if initial == "s":
                offer(SYSTEM, EMPTY, KEEP + stays, "K", role)
            cost, edit, name = (KEEP, "K", role) if initial == "u" else (REROLE, "R", "user")
            for source in (EMPTY, SYSTEM, ASSISTANT):
                offer(USER, source, cost + stays, edit, name)
            cost, edit, name = (KEEP, "K", role) if initial == "a" else (REROLE, "R", "assistant")
            offer(ASSISTANT, USER, cost + stays, edit, name)
            self._drop_hopeless(best)
        uses: dict[int, int] = {}
        for won in best:
            if won is not None:
                uses[id(won[1])] = uses.get(id(won[1]), 0) + 1
        old, fresh = self.tips, [None] * 4
        for state, won in enumerate(best):
            if won is None:
                continue
            _, tip, edit, new_role = won
            if edit == "D" and tip.edit == "D" and tip is not self.root and tip.refs == 1 and uses[id(tip)] == 1:
                tip.times += 1
                tip.refs += 1
                fresh[state] = tip
            else:
                fresh[state] = Node(edit, tip, turn, new_role, None if edit == "D" else text)
                fresh[state].refs = 1
        self.tips, self.costs = fresh, [NEVER if won is None else won[0] for won in best]
        for tip in old:
            self._release(tip)
        return self._resolve()

    @staticmethod
    def _drop_hopeless(best: list[tuple | None]) -> None:
        """Survivors that a whole sequence beats, whatever follows: behind one, a system row can be deleted, and all that may follow an s may follow it too."""
        if best[ASSISTANT] is None:
            return
        for state, allowance in ((EMPTY, DELETE), (SYSTEM, 0)):
            if best[state] is not None and best[state][0] > best[ASSISTANT][0] + allowance:
                best[state] = None

    def _path(self, tip: Node) -> list[Node]:
        nodes = []
        while tip is not self.root:
            nodes.append(tip)
            tip = tip.above
        return nodes[::-1]

    def _resolve(self) -> list[tuple]:
        """The edits up to the last node that all survivors share."""
        if self.root.refs != 1:
            return []
        done = []
        for node in self._path(next(tip for tip in self.tips if tip is not None)):
            if self.root.refs != 1:
                break
            done.append((node.edit, node.times, node.turn, node.role, node.text))
            node.above, self.root = None, node
        return done

    def finish(self) -> tuple[float, list[tuple]]:
        """The cost, and the rest of the cheapest edits that end in a whole sequence."""
        self._insert()
        best = None
        for state in ENDS:
            tip = self.tips[state]
            if tip is not None and self._wins(self.costs[state], tip, "", best):
                best = (self.costs[state], tip, "")
        return best[0], [(n.edit, n.times, n.turn, n.role, n.text) for n in self._path(best[1])]


class _Facts:
    """Counts over the rows of one conversation, in order."""

    def __init__(self) -> None:
        self.turns, self.least, self.most, self.faults, self.illegal, self.last = 0, None, None, dict.fromkeys((BLANK, DUPLICATE, CUT), 0), 0, None

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if fault:
            self.faults[fault] += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]

    def row(self, cost: float) -> dict[str, int]:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return dict(zip(FACTS, (gaps, *self.faults.values(), self.illegal, int(cost))))


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edits of the conversations whose rows arrive in order."""
    out: list[tuple] = []
    chars = 0
    conv: Any = None
    search = facts = None
    before: tuple | None = None
    step = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, chars
        batch = pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*out), schema)], schema=schema)
        out, chars = [], 0
        return batch

    def emit(edits: list[tuple]) -> None:
        nonlocal step, chars
        for edit in edits:
            out.append((conv, step, *edit, None))
            chars += len(edit[4] or "")
            step += 1

    def close() -> None:
        cost, rest = search.finish()
        emit(rest)
        out.append((conv, step, None, None, None, None, None, facts.row(cost)))

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "gone", "key", "fault")]
        for this, turn, role, text, gone, key, fault in zip(*columns):
            if search is None or this != conv:
                if search is not None:
                    close()
                conv, search, facts, before, step = this, Search(), _Facts(), None, 0
            if not gone:
                if fault != BLANK and before == (turn, key):
                    fault = DUPLICATE
                before = (turn, key)
                facts.add(turn, role, fault)
                emit(search.step(turn, role, text, fault))
            if len(out) >= FLUSH_ROWS or chars >= FLUSH_CHARS:
                yield flush()
    if search is not None:
        close()
    if out:
        yield flush()


def repair_edits(rows: DataFrame) -> DataFrame:
    """(conv_id, step, edit, times, turn, role, text, facts): the cheapest edits K, R, D, I that make the roles of every
    conversation spell ``(s?(ua)+)?`` by their initials, in order, the ASCII-least of equal cost.

    ``rows`` are (conv_id, turn, role, text, gone) as of :func:`damage`; ``gone`` rows only name their conversation. Role
    and text are those after the edit. A D stands for ``times`` deletions in a row, from ``turn`` on. The last row of a
    conversation has no edit but ``facts``: gaps, blank, duplicate, truncated and illegal as found, and the cost. Rows
    go by turn (null first), then role and text; a null ``conv_id`` is a conversation of its own; a repeated row is a
    duplicate; an empty table gives no rows; other columns are ignored. The rows of a conversation stay in order in one
    task, which streams them: their digests and their audit are defined from first to last."""
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    schema = T.StructType([
        conv, T.StructField("step", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("times", T.LongType()),
        T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("facts", T.StructType([T.StructField(name, T.LongType()) for name in FACTS]))])
    ordered = with_faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _walk(batches, to_arrow_schema(schema))

    return ordered.mapInArrow(walk, schema)


DIGEST_SCHEMA = "conv_id {conv}, " + ", ".join(f"{name} bigint" for name in FACTS) + ", audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, sha, empty = [], hashlib.sha256(), True
    for batch in batches:
        rows = []
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "edit", "times", "role", "text", "facts")]
        for conv, edit, times, role, text, facts in zip(*columns):
            if edit is None:
                rows.append({"conv_id": conv, **facts, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                audit, sha, empty = [], hashlib.sha256(), True
                continue
            audit.append(edit * times)
            if edit != "D":
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                batch.schema.field("conv_id"), *((name, pa.int64()) for name in FACTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]))


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): they are damaged, then mended by
    :func:`repair_edits`, whose edits are folded in their tasks as they come."""
    edits = repair_edits(damage(rows))
    return edits.mapInArrow(_digests, DIGEST_SCHEMA.format(conv=edits.schema["conv_id"].dataType.simpleString()))
