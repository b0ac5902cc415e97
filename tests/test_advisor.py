import pytest

from tidemark.operators.predicates import Atom, Between
from tidemark.plans.advisor import Advisor, Costs, Edge, PageCosts, explain, grouped, most_selective_first, rows, selectivity
from tidemark.sources.catalog import Catalog, Column, Index, Table


@pytest.fixture
def catalog():
    c = Catalog()
    c.add_table(Table("big", [Column("k", "bigint", distinct=1000, low=0, high=1000), Column("f", "bigint", distinct=50), Column("s", "string")], 100_000, 2000))
    c.add_table(Table("mid", [Column("k", "bigint", distinct=1000), Column("g", "bigint", distinct=10)], 1000, 20))
    c.add_table(Table("tiny", [Column("f", "bigint", distinct=50), Column("g", "bigint", distinct=10)], 50, 1))
    c.add_table(Table("alone", [Column("x", "int", distinct=5)], 5, 1))
    return c


def test_selectivity(catalog):
    t = catalog.table("big")
    assert selectivity(t, Atom("k", "=", 3)) == 0.001 and selectivity(t, Atom("k", "<>", 3)) == 0.999
    assert selectivity(t, Atom("k", "<", 250)) == 0.25 and selectivity(t, Between("k", 900, 5000)) == 0.1
    assert selectivity(t, Atom("s", ">", "x")) == pytest.approx(1 / 3) and selectivity(t, Atom("s", "=", "x")) == 0.1
    assert selectivity(t, Atom("k", "<", 500) & Atom("k", ">=", 500)) == 0.25 and selectivity(t, Atom("k", "<", 500) | Atom("k", ">=", 500)) == 0.75
    assert rows(t, Atom("k", "<", -5)) == 1 and grouped(t, ["k", "f"], 7000) == 7000 and grouped(t, ["f"], 7000) == 50 and grouped(t, [], 9) == 1


def test_costs(catalog):
    c = Costs()
    assert c.scan(catalog.table("tiny")) == 5040 and c.scan(catalog.table("big")) == 85000
    assert c.sort(1000, 4096) == 90000 and c.nested_loop(2440, 780) == 1903200
    big = catalog.table("big")
    assert c.fetch(big, 100, True) < c.fetch(big, 100, False) and c.fetch(big, 10**6, True) < 2 * c.scan(big)


def test_join_order(catalog):
    relations = {"b": ("big", (Atom("k", "<", 500),)), "m": ("mid", ()), "t": ("tiny", (Atom("g", "=", 1),))}
    edges = [Edge("b", "k", "m", "k"), Edge("b", "f", "t", "f"), Edge("m", "g", "t", "g")]
    tree = Advisor(catalog, relations, edges).order()
    assert tree.names == {"b", "m", "t"} and tree.right.names | tree.left.names == tree.names
    first = tree.left if tree.left.left else tree.right
    assert first.names == {"m", "t"}  # the small ones before the large one
    assert "join on" in tree.text()
    assert Advisor(catalog, relations, edges).hints(100_000) == {"b": "merge", "m": "broadcast", "t": "broadcast"}
    twins = edges + [Edge("m", "k", "b", "k"), Edge("b", "k", "m", "k", "<")]
    assert len(Advisor(catalog, relations, twins).edges) == 4


def test_parts_without_edges(catalog):
    tree = Advisor(catalog, {"a": ("alone", ()), "m": ("mid", ()), "t": ("tiny", ())}, [Edge("m", "g", "t", "g")]).order()
    assert tree.names == {"a", "m", "t"} and tree.edges == [] and tree.left.names == {"a"}


def test_explain(spark):
    assert "sizeInBytes" in explain(spark.range(5).selectExpr("id + 1 AS x"))


@pytest.mark.parametrize("n, cost", [(120515, 24800), (115694, 24000), (96412, 20840), (78334, 17880), (62667, 15280), (43385, 12120)])
def test_published_index_costs(n, cost):
    assert PageCosts().index(Table("lineitem", [], 120515, 1), Index("l_part", "lineitem", "l_partkey", leaves=494), n) == cost


@pytest.mark.parametrize("n, width, cost", [(15360, 32, 33320), (5760, 24, 12552), (12640, 16, 16328)])
def test_published_sort_costs(n, width, cost):
    assert PageCosts().sort(n, width) == cost


@pytest.mark.parametrize(
    "pages, n, in_order, cost",
    [(251, 3000, True, 170500), (251, 1709, True, 170500), (251, 1290, True, 174051), (251, 2400, False, 4158343), (251, 1560, False, 2988487), (251, 930, False, 1986012),
     (1148, 10560, True, 766196), (1148, 6400, True, 781812), (1148, 7840, True, 770112), (1148, 12640, False, 21226959), (1148, 8800, False, 15912144), (2, 12, True, 2852), (2, 13, False, 28495), (2, 10, False, 24832)],
)
def test_published_fetch_costs(pages, n, in_order, cost):
    assert PageCosts().fetch(Table("t", [], 10**6, pages), n, in_order) == cost


@pytest.mark.parametrize("pages, cost", [(1, 5040), (2, 5080), (15, 5600), (271, 15840), (1148, 50920), (1473, 63920)])
def test_published_scan_costs(pages, cost):
    assert PageCosts().scan(Table("t", [], 1, pages)) == cost and PageCosts().nested_loop(2440, 780) == 1903200


def star():
    """The tables of the published join-order cases, by their keys and cardinalities."""
    c = Catalog()
    sizes = {
        "region": (5, {"rk": 5, "name": 5}), "nation": (25, {"nk": 25, "rk": 5}), "supplier": (200, {"sk": 200, "nk": 25}), "customer": (3000, {"ck": 3000, "nk": 25}), "part": (4000, {"pk": 4000, "brand": 25, "price": 2500}),
        "partsupplier": (16000, {"pk": 4000, "sk": 200}), "orders": (30000, {"ok": 30000, "ck": 2000}), "lineitem": (120515, {"ok": 30000, "pk": 4000, "sk": 200}),
    }
    for name, (n, columns) in sizes.items():
        c.add_table(Table(name, [Column(k, "int", distinct=d, low=0, high=d) for k, d in columns.items()], n, max(1, n // 14)))
    c.add_table(Table("lowest", [Column("price", "float", distinct=120), Column("brand", "char(10)", distinct=25), Column("name", "char(25)", distinct=5)], 125))
    return c


ALIASES = {"r": "region", "n": "nation", "s": "supplier", "c": "customer", "p": "part", "ps": "partsupplier", "o": "orders", "l": "lineitem", "m": "lowest"}


def best(aliases, edges, **predicates):
    edges = [Edge(*a.split("."), *b.split(".")) for a, b in (e.split("=") for e in edges.split())]
    return Advisor(star(), {a: (ALIASES[a], predicates.get(a, ())) for a in aliases.split()}, edges).order()


def leaves(t):
    return [next(iter(t.names))] if t.left is None else leaves(t.left) + leaves(t.right)


def connected(t):
    return t.left is None or (bool(t.edges) and connected(t.left) and connected(t.right))


def test_join_of_four_with_predicates():
    tree = best("s ps n r", "r.rk=n.rk n.nk=s.nk ps.sk=s.sk", ps=(Between("pk", 1000, 1005),), r=(Atom("name", "=", 3),))
    assert {tree.left.names, tree.right.names} == {frozenset("rn"), frozenset(["ps", "s"])} and [e.left for e in tree.edges] == ["n"]


def test_join_of_four_and_eight():
    four = best("o l s ps", "o.ok=l.ok ps.sk=l.sk ps.pk=l.pk s.sk=l.sk ps.sk=s.sk")
    assert sorted(leaves(four)) == ["l", "o", "ps", "s"] and connected(four)
    eight = best("r n c o l ps s p", "r.rk=n.rk c.nk=n.nk c.ck=o.ck o.ok=l.ok s.sk=l.sk p.pk=l.pk ps.sk=l.sk ps.pk=l.pk ps.pk=p.pk ps.sk=s.sk")
    assert sorted(leaves(eight)) == sorted("r n c o l ps s p".split()) and connected(eight)
    small = [eight]
    while small:  # the chain from the smallest tables on is joined before the largest comes in
        t = small.pop()
        if t.left and {"r", "n", "c"} <= t.names and "l" not in t.names:
            assert t.rows <= 30000
        small += [x for x in (t.left, t.right) if x]


def test_join_with_subquery():
    tree = best("s n r ps p m", "r.rk=n.rk n.nk=s.nk s.sk=ps.sk ps.pk=p.pk m.price=p.price m.brand=p.brand m.name=r.name")
    assert sorted(leaves(tree)) == sorted("s n r ps p m".split()) and connected(tree)


def test_implied_equalities(catalog):
    """a = b and b = c also join a and c, and one comparison of a class is counted once."""
    tree = best("ps l s", "ps.sk=s.sk s.sk=l.sk")
    assert connected(tree) and all(len(t.edges) == 1 for t in (tree, tree.left if tree.left.left else tree.right))


def test_conjuncts_in_order(catalog):
    t = catalog.table("big")
    few, some, many = Atom("k", "=", 3), Atom("k", "<", 250), Atom("k", "<>", 3)
    assert most_selective_first(t, [many, some, few]) == [few, some, many]
