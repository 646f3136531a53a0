import itertools
import random

import duckdb

from lexigraph import queries
from lexigraph.operators import layout

ITEMS = "doc_id long, page long, at long, type string, text string, x0 double, y0 double, x1 double, y1 double"


def item(at, x0, y0, x1, y1, type="paragraph", text="t", page=1, doc=1):
    return (doc, page, at, type, text, float(x0), float(y0), float(x1), float(y1))


def order_of(spark, rows):
    got = layout.reading_order(spark.createDataFrame(rows, ITEMS)).collect()
    return [r["at"] for r in sorted(got, key=lambda r: (r.page, r.place))]


def test_two_columns_with_a_title(spark):
    """The main text goes across the columns; reading goes down the left one, then the right one, then on below both."""
    rows = [item(0, 50, 750, 550, 780), item(1, 310, 490, 550, 700), item(2, 50, 500, 290, 700), item(3, 310, 200, 550, 470), item(4, 50, 200, 290, 480), item(5, 50, 50, 550, 150)]
    assert order_of(spark, rows) == [0, 2, 4, 1, 3, 5]


def test_a_line_is_read_to_its_right_end(spark):
    """A number beside a heading: neighbours on one line, the text hangs below the right end."""
    rows = [item(0, 50, 700, 70, 720), item(1, 80, 700, 300, 720), item(2, 50, 600, 300, 690), item(3, 50, 500, 300, 590)]
    assert order_of(spark, rows) == [0, 1, 2, 3]


def meets(a, b, k):
    return any(lo <= p < hi for p, lo, hi in ((b[k], a[k], a[k + 2]), (b[k + 2], a[k], a[k + 2]), (a[k], b[k], b[k + 2]), (a[k + 2], b[k], b[k + 2])))


def plain_hung(boxes, right, left):
    """By definition: j hangs below i if they meet in x, i is above, and nothing that meets either in x lies in between."""
    n = len(boxes)
    above = lambda a, b: a[1] + 1 > b[3]
    up, down = [[] for _ in range(n)], [[] for _ in range(n)]
    for j in range(n):
        if j in left:
            down[left[j]], up[j] = [j], [left[j]]
            continue
        i = 0
        while i < n:
            a, b = boxes[i], boxes[j]
            if i != j and meets(a, b, 0) and above(a, b) and not any((meets(a, w, 0) or meets(b, w, 0)) and above(a, w) and above(w, b) for w in boxes):
                while i in right:
                    i = right[i]
                down[i].append(j)
                up[j].append(i)
            i += 1
    return up, down


def test_sweep_equals_definition():
    import numpy as np

    r = random.Random(2)
    for n in (2, 3, 7, 15, 25):
        for _ in range(12):
            boxes = np.array([(x, y, x + r.choice([0, 10, 100, 250]), y + r.choice([0, 0.5, 10, 40])) for x, y in ((r.randint(0, 5) * 50, r.randint(0, 20) * 20) for _ in range(n))], float)
            at = np.arange(n)
            page = layout.Page(at, boxes)
            assert (page.up, page.down) == plain_hung(page.widened(*plain_hung(boxes, page.right, page.left)).tolist(), page.right, page.left)
            assert page.hung(boxes) == plain_hung(boxes.tolist(), page.right, page.left)
            assert sorted(page.order()) == list(range(n))


def test_layout_edge_cases(spark):
    rows = [item(k, 50, 700 - 30 * k, 300, 720 - 30 * k, page=p) for k, p in itertools.product(range(4), (1, 2, None))]
    rows += [(1, 1, 9, "paragraph", None, None, 1.0, 2.0, 3.0), (1, 1, 8, "paragraph", None, float("nan"), 1.0, 2.0, 3.0), (2, 1, 5, "table", "", 1.0, 1.0, 2.0, 2.0), (None, 1, 5, "table", "", 1.0, 1.0, 2.0, 2.0)]
    table = spark.createDataFrame(rows, ITEMS).selectExpr("*", "at AS place_before")
    got = {(r.doc_id, r.page, r["at"]): r.place for r in layout.reading_order(table).collect()}
    assert len(got) == len(rows) and [got[1, 2, k] for k in range(4)] == [0, 1, 2, 3] == [got[1, None, k] for k in range(4)] and (got[1, 1, 8], got[1, 1, 9]) == (4, 5)
    assert layout.reading_order(table.where("false")).count() == 0
    wide = [item(k, r.random() * 500, r.random() * 700, 600, 800) for k, r in enumerate(map(random.Random, range(3000)))]
    assert sorted(order_of(spark, wide)) == list(range(3000))


def test_captions_and_broken_paragraphs(spark):
    kinds = [("caption", "c0"), ("table", ""), ("caption", "c2"), ("figure", ""), ("paragraph", "Table 3 says"), ("paragraph", " table 4 says"), ("table", ""), ("table", ""), ("figure", "")]
    rows = spark.createDataFrame([(1, 1, k, t, x, 0.0, 0.0, 1.0, 1.0, k) for k, (t, x) in enumerate(kinds)], ITEMS + ", place long")
    got = {(r.place, r.caption) for r in layout.captions(rows).collect()}
    assert got == {(1, 0), (1, 2), (6, 5)}
    text = [(1, 1, 0, "paragraph", "a bro-", 0.0, 0.0, 9.0, 1.0, 0), (1, 1, 1, "paragraph", "ken wo-", 10.0, 0.0, 19.0, 1.0, 1), (1, 2, 2, "caption", "rd", 0.0, 0.0, 1.0, 1.0, 0), (1, 2, 3, "paragraph", "End-", 0.0, 0.0, 1.0, 1.0, 1), (1, 2, 4, "picture", "x", 0.0, 0.0, 1.0, 1.0, 2), (1, 2, 5, "paragraph", "Not", 5.0, 0.0, 6.0, 1.0, 3), (2, 1, 0, "paragraph", None, 0.0, 0.0, 1.0, 1.0, 0)]
    got = [(r.doc_id, r.n, r.text, r.parts) for r in layout.paragraphs(spark.createDataFrame(text, ITEMS + ", place long")).orderBy("doc_id", "n").collect()]
    assert got == [(1, 0, "a bro-ken wo-rd", 3), (1, 1, "End-", 1), (1, 2, "Not", 1), (2, 0, "", 1)]


def test_layout_queries_match_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    for name in ("caption_links", "broken_paragraphs"):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        cols = sorted(rows.columns)
        got = sorted(tuple(str(r[c]) for c in cols) for r in rows.collect())
        want = sorted(tuple(str(x) for x in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall())
        assert got == want and len(got) > 100, name
    order = queries.QUERIES["reading_order"](spark, "/root/testdata/sf0.001").collect()
    assert len(order) == con.execute("SELECT count(*) FROM lineitem").fetchone()[0] and any(r["at"] % 30 != r.place for r in order)


def test_tables_of_pairs_equal_sweeps(monkeypatch):
    """Pages of few boxes, whose relations are found by tables, and the same by a vector step for each box."""
    import numpy as np

    r = random.Random(4)
    for n in (1, 2, 5, 15, 30):
        for _ in range(30):
            boxes = np.array([(x, y, x + r.choice([0, 10, 100, 250]), y + r.choice([0, 0.5, 10, 40])) for x, y in ((r.randint(0, 5) * 50, r.randint(0, 20) * 20) for _ in range(n))], float)
            at = np.sort(np.array([r.randint(0, n) for _ in range(n)], float))
            monkeypatch.setattr(layout, "FEW", 128)
            one = layout.Page(at, boxes)
            monkeypatch.setattr(layout, "FEW", 0)
            two = layout.Page(at, boxes)
            assert (one.up, one.down, one.right, one.order()) == (two.up, two.down, two.right, two.order())


def test_pages_come_in_batches(spark):
    """No call for each page: a task reads its pages in order, and a page may end in a later batch."""
    rows = [item(k, 50 + 250 * (k % 2), 700 - 20 * (k // 2), 290 + 250 * (k % 2), 715 - 20 * (k // 2), page=p, doc=d) for d in (1, 2, None) for p in (1, 2, None) for k in range(40)]
    table = spark.createDataFrame(rows, ITEMS)
    assert "FlatMapGroups" not in layout.reading_order(table)._jdf.queryExecution().optimizedPlan().toString()
    whole = sorted(map(str, layout.reading_order(table).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, layout.reading_order(table).collect())) == whole and len(whole) == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = {}
    for r in layout.reading_order(table).collect():
        pages.setdefault((r.doc_id, r.page), []).append(r.place)
    assert len(pages) == 9 and all(sorted(x) == list(range(40)) for x in pages.values())
