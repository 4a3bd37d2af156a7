"""Quadtrees against plain insertion, joins and label placement against all pairs."""

import random

from fieldloom.operators import labels, quadtree

BOX = "x1 double, y1 double, x2 double, y2 double"
meet = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


class Plain:
    """One item after the other."""

    def __init__(self, box):
        self.box, self.items, self.big, self.children, self.given = box, [], [], [], 0

    def insert(self, item):
        self.given += 1
        self.items.append(item)
        if len(self.items) > 10:
            if not self.children:
                (a, b, c, d), = [self.box]
                x, y = (a + c) / 2, (b + d) / 2
                self.children = [Plain(q) for q in ((a, b, x, y), (x, b, c, y), (a, y, x, d), (x, y, c, d))]
            for i in self.items:
                r = i[1:]
                inner = next((k for k in self.children if r[0] > k.box[0] and r[2] < k.box[2] and r[1] > k.box[1] and r[3] < k.box[3]), None)
                self.big.append(i) if inner is None else inner.insert(i)
            self.items = []

    def walk(self, name=""):
        yield name, self
        for k, child in enumerate(self.children):
            yield from child.walk(name + str(k))

    def candidates(self, q):
        return len(self.items) + len(self.big) + sum(c.candidates(q) for c in self.children if meet(c.box, q))


def rects(rng, n, spread=990.0):
    out = []
    for k in range(n):
        x, y = rng.uniform(0, spread), rng.uniform(0, spread)
        out.append((k, x, y, x + rng.uniform(0, 9), y + rng.uniform(0, 9)))
    return out


def test_tree_is_the_inserted_one(spark):
    rng = random.Random(2)
    items = rects(rng, 400) + [(400 + k, 3.0, 3.0, 4.0, 4.0) for k in range(30)] + [(500, 1.0, 1.0, 999.0, 999.0), (501, -50.0, 0.0, 5.0, 5.0)]
    bounds = (0.0, 0.0, 1000.0, 1000.0)
    plain = Plain(bounds)
    for i in items:
        plain.insert(i)
    df = spark.createDataFrame(items, f"id int, {BOX}").repartition(5)
    nodes, placed = quadtree.build(df, bounds, ["id"])
    want = {name: (n.given, bool(n.children), len(n.items) + len(n.big)) for name, n in plain.walk() if n.given}
    assert {r.node: (r.n, r.split, r.held) for r in nodes.collect()} == want
    assert {(r.id, r.node, r.big) for r in placed.collect()} == {(i[0], name, big) for name, n in plain.walk() for big in (False, True) for i in (n.big if big else n.items)}
    assert tuple(quadtree.statistics(nodes).first()) == (sum(1 for _ in plain.walk()) - 1, len(items))
    queries = [(0, 10.0, 10.0, 50.0, 50.0), (1, 3.5, 3.5, 3.5, 3.5), (2, 2000.0, 2000.0, 2001.0, 2001.0), (3, -9.0, -9.0, 2000.0, 2000.0)]
    got = {r.query_id: (r.candidates, r.hits) for r in quadtree.candidates(nodes, placed, spark.createDataFrame(queries, f"id int, {BOX}"), bounds).collect()}
    assert got == {q[0]: (plain.candidates(q[1:]), sum(meet(i[1:], q[1:]) for i in items)) for q in queries}
    assert quadtree.build(df.limit(0), bounds, ["id"])[0].collect() == []


def test_points_on_one_spot_end(spark):
    df = spark.createDataFrame([(k, 1.0, 1.0, 1.0, 1.0) for k in range(50)], f"id int, {BOX}")
    nodes, placed = quadtree.build(df, (0.0, 0.0, 3.0, 3.0), ["id"], deepest=6)
    assert placed.count() == 50 and nodes.filter("split").count() == 6


def test_adaptive_join(spark):
    """A hot spot, huge rectangles, equal ones, and bounds on tile borders."""
    rng = random.Random(3)
    a = rects(rng, 150) + [(200 + k, -1.0, -1.0, 1200.0, 1200.0) for k in range(3)] + [(300, 512.0, 512.0, 512.0, 512.0)]
    b = rects(rng, 150, 40.0) + rects(rng, 100) + [(k, 512.0, 512.0, 512.0, 512.0) for k in range(5)]
    b = [(k, *r[1:]) for k, r in enumerate(b)]
    left, right = spark.createDataFrame(a, f"id int, {BOX}"), spark.createDataFrame(b, f"id int, {BOX}")
    want = sorted((p[0], q[0]) for p in a for q in b if meet(p[1:], q[1:]))
    for most in (5, 40, 10_000):
        got = sorted((r.a_id, r.b_id) for r in quadtree.adaptive_rect_join(left, right, most).select("a_id", "b_id").collect())
        assert got == want
    assert quadtree.adaptive_rect_join(left, right.limit(0)).count() == 0


def test_labels_are_placed_as_one_after_the_other(spark):
    rng = random.Random(4)
    rows = []
    for k, (_, *r) in enumerate(rects(rng, 260, 120.0)):
        rows.append((rng.choice(["a", "b", None]), k % 97, rng.choice([1, 5, 99, 100, 130, None]), *r))
    rows += [("c", k, k, 0.0, 0.0, 5.0, 5.0) for k in range(40)] + [rows[0], rows[0]]
    rows += [("c", 90, 1, 9.0, 9.0, 300.0, 300.0), ("c", 91, 2, 250.0, 250.0, 251.0, 251.0), ("c", 92, 3, None, 1.0, 2.0, 2.0), ("c", 93, 3, float("nan"), 1.0, 2.0, 2.0), ("c", 94, 3, float("inf"), 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, f"view string, id int, z int, {BOX}").coalesce(1)
    order = lambda r: ((r[2] or 0) >= 100, r[2] is not None, r[2] or 0, r[1])
    held, want = {}, []
    for r in sorted(rows, key=order):
        fine = all(v is not None and abs(v) < float("inf") for v in r[3:])
        free = fine and not any(meet(r[3:], o) for o in held.get(r[0], []))
        if free:
            held.setdefault(r[0], []).append(r[3:])
        want.append((*r, free))
    show = lambda rs: sorted(map(repr, rs))
    assert show(tuple(r) for r in labels.place_labels(df, tile=7.0).collect()) == show(want)
    assert labels.place_labels(df.limit(0)).collect() == []


def test_rounds_follow_items_and_not_depth(spark, monkeypatch):
    """Eighty points on one spot go down forty levels; that takes no round a level. Large nodes are split in rounds, to the same tree."""
    rng = random.Random(3)
    items = rects(rng, 300) + [(300 + k, 3.0, 3.0, 3.0, 3.0) for k in range(80)] + [(400, 1.0, 1.0, 999.0, 999.0), (401, None, 1.0, 2.0, 2.0)]
    bounds = (0.0, 0.0, 1000.0, 1000.0)
    df = spark.createDataFrame(items, f"id int, {BOX}").repartition(3)
    stores = []
    monkeypatch.setattr(quadtree, "store", lambda d, label, real=quadtree.store: (stores.append(label), real(d, label))[1])
    grown = [quadtree.build(df, bounds, ["id"], most=most) for most in (1000, 100)]
    assert len(stores) < 40
    nodes, placed = ([{tuple(r) for r in g[k].collect()} for g in grown] for k in (0, 1))
    assert nodes[0] == nodes[1] and placed[0] == placed[1]
    assert len(placed[0]) == len(items) and max(r[1] for r in nodes[0]) == 40
