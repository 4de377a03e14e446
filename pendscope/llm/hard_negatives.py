"""Hard negatives by vertical scans: the dimensions of a block of rows are read one stretch after another, in the order of
an anchor's magnitudes, and what the unread ones can add at least and at most rules rows out.

Rows and anchors are dealt into a grid of blocks whose cells Spark co-groups, so a task holds one block of each. In a
cell the rows lie by dimension (``columns[d]`` is dimension d of all rows). For one anchor the rows' partial scores grow
with every stretch; with the remaining contributions between ``low`` and ``high``, a row's score lies in
[partial + low, partial + high], and a row stays a candidate while that meets what is sought:

* positives: the score may still reach the fifth best lower bound among rows of the anchor's label;
* negatives: it may still lie in the window of some positive, and reach the third best lower bound of those surely in it.

What is left after the last stretch has exact scores. Every cell gives its best rows, which Spark ranks over all cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.llm.common import stored

SCALE = 256  # fixed value
LABELS = 10  # fixed value
POSITIVES, NEGATIVES = 5, 3
#: Per cent of a positive's score that a negative's may come to, at least and at most.
LEAST_PERCENT, MOST_PERCENT = 50, 95
STRETCH = 16  # dimensions read between two looks at the bounds
#: Rows and anchors of a block: a share of the table, so that blocks are many, and no more than a task holds easily.
ROWS_LEAST, ROWS_MOST, ROW_BLOCKS = 2048, 65_536, 32
ANCHORS_LEAST, ANCHORS_MOST, ANCHOR_BLOCKS = 512, 16_384, 4


def eligible(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows with a label and finite numbers only; ``v`` is whole numbers. Others take no part, nor do rows without an id."""
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return rows.filter(sound).select(
        "vec_id", F.expr(f"IF(vec_id % 7 = 0, (label + 1) % {LABELS}, label)").cast("long").alias("label"),
        F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double")).alias("v"))


@dataclass(frozen=True)
class Grid:
    """Numbers of blocks, the dimensions, and whether sums need whole numbers of 64 bits."""

    row_blocks: int
    anchor_blocks: int
    dims: int
    whole: bool

    @staticmethod
    def of(rows: DataFrame, anchors: DataFrame) -> Grid:
        size = F.greatest(F.lit(0.0), F.array_max(F.transform("v", F.abs)))
        n, dims, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(size)).first()
        m = anchors.count()
        bound = (dims or 0) * float(largest or 0) ** 2
        if bound >= 2.0**62:
            raise ValueError("scores of these vectors would not fit in 64 bits")
        per_row_block = min(ROWS_MOST, max(ROWS_LEAST, n // ROW_BLOCKS))
        per_anchor_block = min(ANCHORS_MOST, max(ANCHORS_LEAST, m // ANCHOR_BLOCKS))
        return Grid(max(1, -(-n // per_row_block)), max(1, -(-m // per_anchor_block)), max(1, dims or 1), bound >= 2.0**53)


def _matrix(table: pa.Table, grid: Grid) -> np.ndarray:
    """(rows, dimensions); a shorter vector has zeros behind it."""
    vectors = table.column("v").combine_chunks()
    kind = np.int64 if grid.whole else np.float64
    out = np.zeros((len(vectors), grid.dims), dtype=kind)
    sizes = np.diff(vectors.offsets.to_numpy())
    out[np.arange(grid.dims) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return out


class Block:
    """The rows of a cell by dimension, those of a label next to each other."""

    def __init__(self, table: pa.Table, grid: Grid) -> None:
        labels = table.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")
        self.labels, self.ids = labels[order], table.column("vec_id").to_numpy()[order]
        self.columns = np.ascontiguousarray(_matrix(table, grid)[order].T)
        self.ends = np.stack((self.columns.min(axis=1), self.columns.max(axis=1)))
        self.ends_of = {label: np.stack((part.min(axis=1), part.max(axis=1))) for label in np.unique(self.labels)
                        for part in (self.columns[:, self.labels == label],)}
        # ids on several rows would fill a list of the best with one id, so bounds look as many places further
        self.spare = len(self.ids) - len(np.unique(self.ids))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, ends: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows that ``keep(partial, low, high)`` leaves, and their exact scores; ``alive`` are the places to
        begin with and ``ends`` the least and largest value of every dimension among them."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        reached = anchor * ends
        low, high = reached.min(axis=0)[order], reached.max(axis=0)[order]
        lows, highs = low.sum() - np.cumsum(low), high.sum() - np.cumsum(high)
        partial = np.zeros(len(alive), dtype=self.columns.dtype)
        for start in range(0, len(order), STRETCH):
            dims = order[start:start + STRETCH]
            read = self.columns[dims] if len(alive) == self.columns.shape[1] else self.columns[np.ix_(dims, alive)]
            partial = partial + anchor[dims] @ read
            last = min(start + STRETCH, len(order)) - 1
            kept = keep(partial, lows[last], highs[last])
            if not kept.all():
                alive, partial = alive[kept], partial[kept]
            if not len(alive):
                break
        return alive, partial


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first ``k`` ids by falling score, then id; an id counts once."""
    found: dict[int, int] = {}
    for at in np.lexsort((ids, -scores)):
        found.setdefault(int(ids[at]), int(scores[at]))
        if len(found) == k:
            break
    return list(found.items())


def _reach(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest of ``values``; nothing is out of reach of fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def block_positives(block: Block, anchor_id: int, label: int, anchor: np.ndarray) -> list[tuple[int, int]]:
    """The block's best rows of the anchor's label."""
    start, stop = np.searchsorted(block.labels, (label, label + 1))
    alive = np.arange(start, stop)
    alive = alive[block.ids[start:stop] != anchor_id]
    if not len(alive):
        return []
    k = POSITIVES + block.spare
    places, scores = block.scan(
        anchor, alive, block.ends_of[label], lambda partial, low, high: partial + high >= _reach(partial, k) + low)
    return _first(block.ids[places], scores, POSITIVES)


def window(positive: int) -> tuple[int, int]:
    """Scores s with 50 * positive <= 100 * s <= 95 * positive."""
    return -(-LEAST_PERCENT * positive // 100), MOST_PERCENT * positive // 100


def block_negatives(block: Block, label: int, anchor: np.ndarray, positives: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For every score of a positive the block's first rows of other labels in its window."""
    windows = [(p, *window(p)) for p in sorted(set(positives))]
    windows = [w for w in windows if w[1] <= w[2]]
    alive = np.flatnonzero(block.labels != label)
    if not windows or not len(alive):
        return {}
    k = NEGATIVES + block.spare

    # both ends of the windows rise with the positive, and so does what a row has to reach in them: the lowest window
    # says what is too low for all, the highest what is too high
    _, lowest, lowest_top = windows[0]
    highest = windows[-1][2]

    def keep(partial: np.ndarray, low: float, high: float) -> np.ndarray:
        inside = partial[(partial >= lowest - low) & (partial <= lowest_top - high)]
        return (partial >= max(lowest, _reach(inside, k) + low) - high) & (partial <= highest - low)

    places, scores = block.scan(anchor, alive, block.ends, keep)
    ids, found = block.ids[places], {}
    for positive, least, most in windows:
        inside = (scores >= least) & (scores <= most)
        if inside.any():
            found[positive] = _first(ids[inside], scores[inside], NEGATIVES)
    return found


CELL = ("row_block", "anchor_block")
POSITIVE_SCHEMA = "anchor_id bigint, positive_id bigint, positive_score bigint"
NEGATIVE_SCHEMA = "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _cells(rows: DataFrame, anchors: DataFrame, grid: Grid):
    """Rows and anchors co-grouped by cell: a row goes to every block of anchors and an anchor to every block of rows."""
    dealt = rows.withColumn("row_block", F.expr(f"int(pmod(monotonically_increasing_id(), {grid.row_blocks}))"))
    dealt = dealt.withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(grid.anchor_blocks - 1))))
    asked = anchors.withColumn("anchor_block", F.expr(f"int(pmod(xxhash64(anchor_id), {grid.anchor_blocks}))"))
    asked = asked.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(grid.row_blocks - 1))))
    return dealt.groupBy(*CELL).cogroup(asked.groupBy(*CELL))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({name: pa.array([row[at] for row in rows], pa.int64()) for at, name in enumerate(names)})


def positives(rows: DataFrame, anchors: DataFrame, grid: Grid) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the best other rows of the anchor's label."""
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block = Block(left, grid)
            for anchor_id, label, v in zip(right.column("anchor_id").to_pylist(), right.column("label").to_pylist(), _matrix(right, grid)):
                found += ((anchor_id, *row) for row in block_positives(block, anchor_id, label, v))
        return _table(found, ("anchor_id", "positive_id", "positive_score"))

    found = _cells(rows, anchors, grid).applyInArrow(cell, POSITIVE_SCHEMA)
    once = found.groupBy("anchor_id", "positive_id").agg(F.max("positive_score").alias("positive_score"))
    return _leading(once, ("anchor_id",), "positive_score", "positive_id", POSITIVES).drop("rank")


def _leading(rows: DataFrame, group: tuple[str, ...], score: str, key: str, k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {', '.join(group)} ORDER BY {score} DESC, {key})"))
    return ranked.filter(F.col("rank") <= k)


def negatives(rows: DataFrame, anchors: DataFrame, found: DataFrame, grid: Grid) -> DataFrame:
    """(anchor_id, positive_score, negative_id, negative_score, rank) for every score among the positives ``found``."""
    scores = found.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("positives"))  # five at most
    asked = anchors.join(scores, "anchor_id")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = Block(left, grid)
            columns = (right.column(name).to_pylist() for name in ("anchor_id", "label", "positives"))
            for anchor_id, label, wanted, v in zip(*columns, _matrix(right, grid)):
                for score, best in block_negatives(block, label, v, wanted).items():
                    out += ((anchor_id, score, *row) for row in best)
        return _table(out, ("anchor_id", "positive_score", "negative_id", "negative_score"))

    mined = _cells(rows, asked, grid).applyInArrow(cell, NEGATIVE_SCHEMA)
    once = mined.groupBy("anchor_id", "positive_score", "negative_id").agg(F.max("negative_score").alias("negative_score"))
    return _leading(once, ("anchor_id", "positive_score"), "negative_score", "negative_id", NEGATIVES)


def hard_negatives(table: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor (rows whose id is
    divisible by 50) and each of its first 5 other rows of the same label, the first 3 rows of another label whose score
    is 50 to 95 per cent of the positive's.

    ``table`` is (vec_id, embedding, label); other columns are ignored. Rows without id, label or vector, or with a null
    or infinite component or NaN, take no part. Scores are inner products of whole numbers; higher ones come first, ties
    by the smaller id. A shorter vector counts as if zeros followed. An id on several rows is listed once, at its best
    score; as an anchor it is the least of its rows. An empty table, or one label, gives no rows."""
    rows = eligible(table)
    anchors = rows.filter("vec_id % 50 = 0").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select(F.col("vec_id").alias("anchor_id"), "a.label", "a.v")
    grid = Grid.of(rows, anchors)
    best = stored(positives(rows, anchors, grid), "positives")  # read twice: by the second scan, and joined to what it finds
    return best.join(negatives(rows, anchors, best, grid), ["anchor_id", "positive_score"]).selectExpr(
        "anchor_id", "positive_id", "int(rank) AS rank", "negative_id", "positive_score", "negative_score")
