"""Page layout: reading order, captions of tables and figures, and paragraphs that pages or columns break.

Items are rows (doc_id, page, at, type, text, x0, y0, x1, y1): `at` is an item's place in the
main text, boxes have their origin at the bottom left.

Reading order is found page by page, so the pages of a document are spread over the tasks.  A
box hangs below those that it meets in x and that are right above it; boxes of one line that
follow each other in the main text make a chain, and what hangs below one of a chain hangs below its right end.
Narrow boxes with a single neighbour above or below are widened to it where that meets no other box, and the
boxes are hung again.  The order goes down depth first, from the heads on, and visits what stands above a box before it.
Relations are found by a sweep over a page's boxes with a vector step for each box, so
a page of n boxes takes memory in proportion to n; those of a page of few boxes are found by tables of all pairs.
Pages come to a task in order, many to a batch.

Captions and broken paragraphs are windows over a document's pages.

Cases: items without a whole box (null or NaN), and those that no head leads to, follow at the end of their
page in the order of the main text; a page of one item has place 0; null page is a page of its own; of items with
equal `at` the order is that of their boxes; texts may be null (no caption, never broken); other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# The slack of above and left, and the least share of height that boxes of one line have in common.
SLACK, LINE = 1.0, 0.8
BOX = ("x0", "y0", "x1", "y1")
# Types of items that stay in the main text; captions become paragraphs.
TEXT_TYPES = ("title", "subtitle-level-1", "subtitle-level-2", "subtitle-level-3", "paragraph", "text", "formula", "equation")


def _within(p, lo, hi):
    return (lo <= p) & (p < hi)


#: Fixed value: boxes of a page whose pairs are put in tables.
FEW = 128


def _met(axis: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether boxes meet those of another table in x (0) or y (1)."""
    lo, hi, los, his = one[:, axis, None], one[:, axis + 2, None], two[None, :, axis], two[None, :, axis + 2]
    return _within(los, lo, hi) | _within(his, lo, hi) | _within(lo, los, his) | _within(hi, los, his)


class Page:
    """The boxes of a page in the order of the main text, and which hangs below which."""

    def __init__(self, at: np.ndarray, boxes: np.ndarray):
        self.n, self.box = len(at), boxes
        self.rows: list[list[float]] = boxes.tolist()
        self.right: dict[int, int] = {}
        following = np.maximum(np.searchsorted(at, at + 1), np.arange(1, self.n + 1)).tolist() if self.n else []
        for i, j in enumerate(following):
            # the next in the main text, on one line and to the right
            if j < self.n and at[j] == at[i] + 1:
                a, b = self.rows[i], self.rows[j]
                if not a[2] < b[0] + SLACK:
                    continue
                shared = (min(a[3], b[3]) - max(a[1], b[1])) / max(max(a[3], b[3]) - min(a[1], b[1]), 1e-12)
                if shared > LINE and self._pair_meets(1, a, b):
                    self.right[i] = j
        self.left = {j: i for i, j in self.right.items()}
        up, down = self.hung(boxes)
        wide = self.widened(up, down)
        self.up, self.down = (up, down) if np.array_equal(wide, boxes) else self.hung(wide)

    @staticmethod
    def _pair_meets(axis: int, a: list[float], b: list[float]) -> bool:
        lo, hi, los, his = a[axis], a[axis + 2], b[axis], b[axis + 2]
        return lo <= los < hi or lo <= his < hi or los <= lo < his or los <= hi < his

    @staticmethod
    def meets(axis: int, one: np.ndarray, all_: np.ndarray) -> np.ndarray:
        """Whether a box meets others in x (0) or y (1): an end of one lies within the other."""
        lo, hi, los, his = one[axis], one[axis + 2], all_[:, axis], all_[:, axis + 2]
        return _within(los, lo, hi) | _within(his, lo, hi) | _within(lo, los, his) | _within(hi, los, his)

    def hung(self, box: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """What is right above each box, and what hangs below it."""
        bottom, top = box[:, 1] + SLACK, box[:, 3]
        if self.n <= FEW:
            return self._hung(bottom, top, _met(0, box, box))
        # the highest bottom of what a box meets in x and stands above: what this is above has it in between
        below = np.full(self.n, -np.inf)
        for i in range(self.n):
            under = self.meets(0, box[i], box) & (bottom[i] > top)
            below[i] = bottom[under].max(initial=-np.inf)
        up: list[list[int]] = [[] for _ in range(self.n)]
        down: list[list[int]] = [[] for _ in range(self.n)]
        for j in range(self.n):
            if j in self.left:
                i = self.left[j]
                down[i], up[j] = [j], [i]
                continue
            meets, above = self.meets(0, box[j], box), bottom > top[j]
            above_and_met = np.flatnonzero(meets & above)
            nearest = top[above_and_met].min(initial=np.inf)
            hit = above_and_met[~(bottom[above_and_met] > nearest) & ~(below[above_and_met] > top[j])]
            seen = -1
            for i in hit[hit != j].tolist():
                if i <= seen:
                    continue
                while i in self.right:
                    i = self.right[i]
                seen = i
                down[i].append(j)
                up[j].append(i)
        return up, down

    def _hung(self, bottom: np.ndarray, top: np.ndarray, meets: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """The same by tables of all pairs."""
        over = meets & (bottom[:, None] > top[None, :])
        below = np.where(over, bottom[None, :], -np.inf).max(1, initial=-np.inf)
        nearest = np.where(over, top[:, None], np.inf).min(0, initial=np.inf)
        hit = over & ~(bottom[:, None] > nearest[None, :]) & ~(below[:, None] > top[None, :])
        np.fill_diagonal(hit, False)
        up: list[list[int]] = [[] for _ in range(self.n)]
        down: list[list[int]] = [[] for _ in range(self.n)]
        js, is_ = (x.tolist() for x in np.nonzero(hit.T))
        hits: list[list[int]] = [[] for _ in range(self.n)]
        for j, i in zip(js, is_, strict=True):
            hits[j].append(i)
        for j, own in enumerate(hits):
            if j in self.left:
                i = self.left[j]
                down[i], up[j] = [j], [i]
                continue
            seen = -1
            for i in own:
                if i <= seen:
                    continue
                while i in self.right:
                    i = self.right[i]
                seen = i
                down[i].append(j)
                up[j].append(i)
        return up, down

    def widened(self, up: list[list[int]], down: list[list[int]]) -> np.ndarray:
        wide = []
        for i, row in enumerate(self.rows):
            x0, y0, x1, y1 = row
            for near in (up[i], down[i]):
                if len(near) == 1:
                    x0, x1 = min(x0, self.rows[near[0]][0]), max(x1, self.rows[near[0]][2])
            wide.append((x0, y0, x1, y1))
        made = np.array(wide, float).reshape(self.n, 4)
        if self.n <= FEW:
            met = _met(0, made, self.box) & _met(1, made, self.box)
            np.fill_diagonal(met, False)
            return np.where(met.any(1)[:, None], self.box, made)
        out = self.box.copy()
        for i, box in enumerate(made):
            met = self.meets(0, box, self.box) & self.meets(1, box, self.box)
            met[i] = False
            if not met.any():
                out[i] = box
        return out

    def _before(self, i: int, j: int) -> int:
        """The order of boxes apart from the graph: from the top if they meet in x, else from the left."""
        a, b = self.rows[i], self.rows[j]
        x = (b[1] - a[1]) if self._pair_meets(0, a, b) else (a[0] - b[0])
        return (x > 0) - (x < 0)

    def order(self) -> list[int]:
        sort = cmp_to_key(self._before)
        heads = sorted((i for i in range(self.n) if not self.up[i]), key=sort)
        below = [sorted(d, key=sort) if len(d) > 1 else d for d in self.down]
        out: list[int] = []
        done = [False] * self.n

        def visit(k: int) -> None:
            done[k] = True
            out.append(k)
            stack.append(iter(below[k]))

        for head in heads:
            if done[head]:
                continue
            stack: list = []
            visit(head)
            while stack:
                i = next(stack[-1], None)
                if i is None:
                    stack.pop()
                    continue
                # up to the topmost box that isn't read yet
                way = {i}
                while (free := next((u for u in self.up[i] if not done[u] and u not in way), None)) is not None:
                    i = free
                    way.add(i)
                if not done[i]:
                    visit(i)
        return out + [i for i in range(self.n) if not done[i]]


def places(at: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The place of each item of a page, whose items are in order of `at` and boxes."""
    whole = ~(np.isnan(at) | np.isnan(boxes).any(axis=1))
    known, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
    place = np.empty(len(at), np.int64)
    place[np.r_[known[Page(at[known], boxes[known]).order()], rest]] = np.arange(len(at))
    return place


def reading_order(items: DataFrame) -> DataFrame:
    """items with `place`, their place on the page in reading order (from 0)."""
    schema = StructType([*items.schema.fields, StructField("place", LongType())])

    def ordered(rows: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        """Whole pages; ends: of each page."""
        columns = [rows.column(rows.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("at", *BOX)]
        at, boxes = columns[0], np.column_stack(columns[1:])
        found = [places(at[s:e], boxes[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(found))], [*rows.schema.names, "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the page that has begun
        key = None
        for batch in batches:
            if not len(batch):
                continue
            # a NaN is itself
            keys = [*zip(*(["NaN" if x != x else x for x in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in ("doc_id", "page")), strict=True)]
            new = [k for k, x in enumerate(keys) if x != (keys[k - 1] if k else key)]
            if rest and new:
                own = pa.Table.from_batches([*rest, batch.slice(0, new[0])]).combine_chunks().to_batches()[0]
                yield ordered(own, [len(own)])
                rest = []
            if not new:
                rest.append(batch)
                continue
            if len(new) > 1:
                yield ordered(batch.slice(new[0], new[-1] - new[0]), [x - new[0] for x in new[1:]])
            rest, key = [batch.slice(new[-1])], keys[-1]
        if rest:
            own = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            yield ordered(own, [len(own)])

    dealt = items.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", *(F.asc_nulls_last(c) for c in ("at", *BOX)))
    return dealt.mapInArrow(run, schema)


def _starts(kind: str) -> Column:
    return F.startswith(F.trim(F.lower(F.coalesce("text", F.lit("")))), F.lit(kind))


def captions(items: DataFrame) -> DataFrame:
    """doc_id, page, place, type of tables and figures, and caption: the place of a caption of theirs.

    A caption right before an object is its own, or right behind it if no object stands before the caption; an object may
    have both.  Of the rest, the first table (figure) of a page without one gets the last text that begins with `tab` (`fig`)
    and is nobody's caption.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("place")
    is_object, is_caption = F.col("type").isin("table", "figure"), F.col("type") == "caption"
    near = items.select("doc_id", "page", "place", "type", "text", *(f("type", 1).over(page).alias(n) for f, n in ((F.lag, "b"), (F.lead, "a"))))
    beside = lambda c: F.coalesce(F.col(c).isin("table", "figure"), F.lit(False))
    own = near.where(is_caption & (beside("b") | beside("a")))
    of = F.when(beside("b"), F.col("place") - 1).otherwise(F.col("place") + 1)
    claimed = own.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), of.alias("o"), F.col("place").alias("caption"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("page").eqNullSafe(F.col("p"))
    objects = near.where(is_object).select("doc_id", "page", "place", "type").join(claimed, same & (F.col("place") == F.col("o")), "left").select("doc_id", "page", "place", "type", "caption")
    # what begins like a caption and isn't claimed, the last of each page and kind
    kind = F.when(_starts("tab"), "table").when(_starts("fig"), "figure")
    loose = near.where(~is_object & ~(is_caption & (beside("b") | beside("a")))).withColumn("kind", kind).where("kind is not null")
    last = loose.groupBy(F.col("doc_id").alias("d"), F.col("page").alias("p"), "kind").agg(F.max("place").alias("last"))
    bare = objects.where("caption is null")
    first = bare.groupBy("doc_id", "page", "type").agg(F.min("place").alias("place"))
    given = first.join(last, same & (F.col("type") == F.col("kind"))).select("doc_id", "page", "place", "type", F.col("last").alias("caption"))
    return objects.where("caption is not null").unionByName(given)


def paragraphs(items: DataFrame) -> DataFrame:
    """doc_id, n (of the paragraph in its document, from 0), page, place, type, text, parts: the main text, broken paragraphs joined.

    A paragraph that ends in a hyphen goes on in the next if that begins with a small letter and stands to the right on the same
    page or on the next page.  Items (with place) that aren't text are left out; captions are paragraphs.
    """
    document = Window.partitionBy("doc_id").orderBy("page", "place")
    kept = items.where(F.col("type").isin(*TEXT_TYPES, "caption")).withColumn("type", F.when(F.col("type") == "caption", "paragraph").otherwise(F.col("type")))
    before = lambda c: F.lag(c).over(document)
    right = (before("page") == F.col("page")) & (before("x1") < F.col("x0") + SLACK)
    joins = (before("type") == "paragraph") & (F.col("type") == "paragraph") & F.endswith(before("text"), F.lit("-")) & F.col("text").rlike("^[a-z]") & (right | (before("page") + 1 == F.col("page")))
    runs = kept.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("n", F.sum((~F.col("joins")).cast("long")).over(document) - 1)
    parts = F.array_sort(F.collect_list(F.struct("page", "place", "type", "text")))
    rows = runs.groupBy("doc_id", "n").agg(parts.alias("p"))
    head = F.col("p")[0]
    return rows.select("doc_id", "n", head["page"].alias("page"), head["place"].alias("place"), head["type"].alias("type"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.size("p").cast("long").alias("parts"))
