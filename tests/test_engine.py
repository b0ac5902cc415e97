import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.console import show
from tidemark.functions.types import no_nan, parse_field, render_field, spark_type, time_instant
from tidemark.operators import relational as R
from tidemark.operators.bulk import BulkGroupBy, BulkScan, CountTuples, ForwardLeft, MapReduce, TableInput, from_spec, materialise
from tidemark.operators.dml import LostUpdate, UniqueViolation, VersionedTable
from tidemark.operators.predicates import Atom, Between, JoinAtom, Junction, Truth, from_json, merge_ranges, to_json, truth
from tidemark.plans import sql as S
from tidemark.plans.sql import Code, ParseError, parse
from tidemark.queries import QUERIES
from tidemark.sources.catalog import Catalog, Column, Index, Table, analyse, register, unique_violations
from tidemark.sources.tables import table, write_table
from tidemark.streaming.files import running_group_by, stream_table

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- SQL subset


@pytest.mark.parametrize(
    "text, code",
    [
        ("", Code.UNEXPECTED_END), ("SELECT", Code.UNEXPECTED_END), ("DROP TABLE t", Code.NOT_A_STATEMENT), ("SELECT t.a FROM t WHERE t.a ! 3", Code.BAD_CHARACTER), ('SELECT t.a FROM t WHERE t.a = "x', Code.OPEN_STRING),
        ("SELECT t.a FROM t WHERE t.a = 3x", Code.BAD_NUMBER), ("SELECT t.a + 1 FROM t", Code.ALIAS_NEEDED), ("SELECT t.a, t.a FROM t", Code.DUPLICATE_ALIAS), ("SELECT u.a FROM t", Code.UNKNOWN_ALIAS),
        ("SELECT t.a FROM t ORDER BY b", Code.UNKNOWN_ALIAS), ("SELECT t.a, COUNT(*) AS n FROM t GROUP BY t.b", Code.UNGROUPED_COLUMN), ("SELECT t2.a FROM t t2 t3", Code.TRAILING_INPUT), ("SELECT t.a FROM t WHERE t.a OR 3", Code.UNEXPECTED_TOKEN),
        ("SELECT t.a FROM t t LIMIT 3", Code.TRAILING_INPUT), ("INSERT INTO t VALUES (a)", Code.UNEXPECTED_TOKEN), ("SELECT t.a FROM t, t", Code.DUPLICATE_ALIAS),
    ],
)
def test_parse_errors(text, code):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.code == code


def test_parse_forms():
    q = parse('select T.A as x, sum(t.b * -2) as s from T where t.c <> "a\\"b" and t.d >= 1.5 group by t.a having s > 3 order by s descending, x ascending')
    assert q.order == [("s", False), ("x", True)] and q.where[0].right.value == 'a"b' and q.having[0].op == ">"
    assert "\\'" in parse("SELECT t.a FROM t WHERE t.b = \"it's\"").sql()
    assert [len(r) for r in parse("INSERT INTO t VALUES (1, NULL, \"x\"), (-2, 2.5, \"\")").rows] == [3, 3]
    assert S.fold(parse("SELECT 2 * 3 + t.a * (4 - 1) AS x FROM t").outputs[0].expr).sql() == "(6 + (`t`.`a` * 3))"
    a, b = (parse(f"SELECT {e} AS x FROM t").outputs[0].expr for e in ("t.a + 2 * t.b", "t.b * 2 + t.a"))
    assert S.same_expression(a, b) and not S.same_expression(a, parse("SELECT t.a - 2 * t.b AS x FROM t").outputs[0].expr)


def test_statements(spark, tmp_path):
    path = str(tmp_path / "t")
    t = VersionedTable(spark, path, unique=("k",))
    t.replace(spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "k int, s string, x double"))
    tables = {"t": t}
    assert S.execute(spark, 'INSERT INTO t VALUES (3, "c", 3.5), (4, NULL, NULL)', tables) == 2
    assert S.execute(spark, "INSERT INTO t SELECT u.k + 10 AS k, u.s, u.x FROM t u WHERE u.k < 2", tables) == 1
    with pytest.raises(UniqueViolation):
        S.execute(spark, 'INSERT INTO t VALUES (3, "again", 0.5)', tables)
    with pytest.raises(UniqueViolation):
        t.insert(spark.createDataFrame([(8, "", 0.0), (8, "", 0.0)], "k int, s string, x double"))
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(8,)], "k int"))
    assert S.execute(spark, 'UPDATE t SET s = "new", x = t.x * 2 WHERE t.x >= 2.5', tables) == 2
    assert S.execute(spark, "DELETE FROM t WHERE t.k = 1", tables) == 1
    assert S.execute(spark, "DELETE FROM t WHERE t.k = 99", tables) == 0
    assert sorted(rows(t.read()), key=str) == sorted([(2, "new", 5.0), (3, "new", 7.0), (4, None, None), (11, "a", 1.5)], key=str)
    assert rows(S.execute(spark, "SELECT COUNT(*) AS n, SUM(t.x) AS x FROM t", tables)) == [(4, 13.5)]
    t.truncate()
    assert t.read().count() == 0
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, str(tmp_path / "none")).read()
    with pytest.raises(ParseError):
        S.query(spark, "DELETE FROM t")


def test_append_and_versions(spark, tmp_path):
    """INSERT leaves the files that are there alone, DELETE those without a row to go; old versions can be cleaned up."""
    path = tmp_path / "t"
    t = VersionedTable(spark, str(path))
    t.replace(spark.range(100).selectExpr("id AS k", "id % 3 AS g"))
    before = {f: f.stat().st_mtime_ns for f in (path / "data").rglob("*.parquet")}
    assert t.insert(spark.range(100, 110).selectExpr("id AS k", "9L AS g")) == 10
    assert len(list((path / "data").iterdir())) == 2 and all(f.stat().st_mtime_ns == m for f, m in before.items())
    assert t.delete(F.col("k") >= 105) == 5 and t.delete(F.col("k") > 500) == 0
    assert len(list((path / "data").iterdir())) == 3 and len(list((path / "log").glob("[0-9]*.json"))) == 3
    assert t.read().count() == 105
    assert t.vacuum() == 1 and t.read().count() == 105 and len(list((path / "log").glob("[0-9]*.json"))) == 1
    assert t.update({"g": F.lit(7)}, F.col("k") < 0) == 0 and t.update({"g": F.lit(7)}, F.col("k") < 2) == 2
    t.truncate()
    assert t.read().schema.simpleString() == "struct<k:bigint,g:bigint>" and t.read().count() == 0
    t.drop()
    assert not path.exists()


def test_two_writers(spark, tmp_path):
    """Of two changes to one version the second is refused; two inserts both stay, unless they repeat a key."""
    a = VersionedTable(spark, str(tmp_path / "t"), unique=("k",))
    a.replace(spark.range(10).selectExpr("id AS k"))
    b = VersionedTable(spark, str(tmp_path / "t"), unique=("k",))
    seen = a._latest()
    b.insert(spark.range(20, 22).selectExpr("id AS k"))
    a._latest = lambda: seen  # a has read before b wrote
    with pytest.raises(LostUpdate):
        a.delete(F.col("k") < 5)
    assert b.read().count() == 12

    def late(rows, after):
        """a's insert, with b's in between its reading and its commit."""
        answers = iter([seen_now := b._latest(), seen_now])

        def latest():
            out = next(answers, None)
            return out if out else VersionedTable._latest(a)

        a._latest = latest
        b.insert(after)
        return a.insert(rows)

    assert late(spark.range(30, 33).selectExpr("id AS k"), spark.range(40, 41).selectExpr("id AS k")) == 3
    assert b.read().count() == 16
    with pytest.raises(UniqueViolation):
        late(spark.range(50, 52).selectExpr("id AS k"), spark.range(51, 52).selectExpr("id AS k"))
    assert sorted(r[0] for r in b.read().collect()) == [*range(10), 20, 21, 30, 31, 32, 40, 51]


# ---- predicates and plans


def test_predicates_travel(spark):
    p = (Atom("a", "<", 10) & Atom("b", ">=", "Hello")) | Between("c", 1.5, None, False) | Junction("and", ()) | JoinAtom("a", "=", "b")
    assert from_json(to_json(p)) == p
    assert Atom("a", "<", 1).inverted() == Atom("a", ">=", 1) and JoinAtom("a", "<=", "b").swapped() == JoinAtom("b", ">=", "a")
    merged = merge_ranges([Atom("a", ">", 1), Atom("a", ">=", 3), Atom("a", "<", 9), Atom("b", "=", 2), Atom("a", "<>", 5)])
    assert merged == [Between("a", 3, 9, True, False), Atom("a", "<>", 5), Atom("b", "=", 2)]
    df = spark.createDataFrame([(i if i % 3 else None,) for i in range(10)], "a int")
    assert rows(R.filter_(df, Between("a", 2, 7, False, True))) == [(4,), (5,), (7,)]
    assert R.filter_(df, Atom("a", "<>", 4)).count() == 5 and R.filter_(df, Junction("or", ())).count() == 0


def test_truth(spark):
    a, never, always = Atom("a", "<", 10), Between("a", 5, 5, False), Between("a")
    assert [truth(x) for x in (a, never, always, Junction("and", ()), Junction("or", ()))] == [Truth.UNKNOWN, Truth.ALWAYS_FALSE, Truth.ALWAYS_TRUE, Truth.ALWAYS_TRUE, Truth.ALWAYS_FALSE]
    assert truth(a & never) is Truth.ALWAYS_FALSE and truth(a | always) is Truth.ALWAYS_TRUE and truth(a | never) is Truth.UNKNOWN and truth(always & always) is Truth.ALWAYS_TRUE
    assert truth(Atom("a", "=", 1) & Atom("a", "=", 2)) is Truth.ALWAYS_FALSE and truth(Atom("a", "=", 1) & Atom("b", "=", 2)) is Truth.UNKNOWN
    assert truth(Atom("a", ">", 9) & Atom("a", "<=", 3)) is Truth.ALWAYS_FALSE and truth(Atom("a", "=", 7) & Atom("a", "<", 7)) is Truth.ALWAYS_FALSE
    plan = R.scan(table(spark, SF, "orders"), ["o_orderkey"], Atom("o_custkey", ">", 9), Atom("o_custkey", "<", 3))
    assert plan.count() == 0 and "LocalTableScan" in plan._jdf.queryExecution().toString()


def test_external_sort(tmp_path):
    """A sort under memory pressure spills and keeps its order; in a process of its own, as the memory is set at its start."""
    import subprocess
    import sys

    code = f"""
from tidemark.session import get_session
from tidemark.operators import relational as R
from pyspark.sql import functions as F
s = get_session(2, "1g", **{{"spark.testing.reservedMemory": "1", "spark.testing.memory": str(40 << 20), "spark.shuffle.spill.numElementsForceSpillThreshold": "5000", "spark.local.dir": {str(tmp_path)!r}}})
df = s.range(0, 60000, 1, 4).selectExpr("CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 7919) % 60013 END AS a", "id AS b")
found = [tuple(r) for r in R.sort(df, ("a", True), ("b", False)).toLocalIterator()]
assert found == sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, -r[1])) and len(found) == 60000
stages = s.sparkContext._jsc.sc().statusStore().stageList(None, False, False, s.sparkContext._gateway.new_array(s._jvm.double, 0), None)
print("spilled", sum(stages.apply(i).memoryBytesSpilled() for i in range(stages.size())))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split("spilled")[1]) > 0


def test_scan_pushes_down(spark):
    plan = R.scan(table(spark, SF, "lineitem"), ["l_orderkey"], Atom("l_quantity", ">", 49))._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,49" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_merge_join_keeps_residual(spark):
    o, li = table(spark, SF, "orders"), table(spark, SF, "lineitem")
    plan = R.merge_join(o, li, [("o_orderkey", "l_orderkey")], JoinAtom("l_extendedprice", "<", "o_totalprice"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    with pytest.raises(ValueError):
        R.merge_join(o, li, [])


def test_aggregates_skip_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 4), (None, 6), (None, None)], "k int, x int")
    found = sorted(rows(R.group_by(df, ["k"], [("count", "*", "n"), ("count", "x", "m"), ("sum", "x", "s"), ("avg", "x", "a"), ("min", "x", "l")])), key=str)
    assert found == [(1, 2, 1, 4, 4.0, 4), (None, 2, 1, 6, 6.0, 6)]
    assert rows(R.sort(df, ("x", False), ("k", True))) == [(None, 6), (1, 4), (None, None), (1, None)]


# ---- types


def test_types(spark):
    df = spark.createDataFrame([("12", "1.5", " ab ", "ab", "2024-2-3", "2024-02-03 4:05:06.700", "1:02:03 (UTC +1:30)"), ("null", "NaN", "NULL", "Null", None, "NULL", "NULL")], "i string, f string, v string, c string, d string, t string, h string")
    kinds = {"i": "INT", "f": "FLOAT", "v": "VARCHAR(5)", "c": "CHAR(4)", "d": "DATE", "t": "TIMESTAMP", "h": "TIME"}
    typed = df.select(*[parse_field(F.col(c), k).alias(c) for c, k in kinds.items()], time_instant(parse_field(F.col("h"), "TIME")).alias("at"))
    first, second = typed.collect()
    assert (first["i"], first["f"], first["v"], first["c"], str(first["d"])) == (12, 1.5, "ab", "ab  ", "2024-02-03") and first["at"] == -1677000
    assert all(x is None for x in second)
    shown = typed.select(*[render_field(F.col(c), k).alias(c) for c, k in kinds.items()]).collect()
    assert tuple(shown[0]) == ("12", "1.5", "ab", "ab  ", "2024-02-03", "2024-02-03 04:05:06.700", "1:02:03 (UTC +1:30)") and set(shown[1]) == {"NULL"}
    assert spark_type("CHAR(3)") == "char(3)" and spark_type("BIGINT") == "bigint"
    with pytest.raises(ValueError):
        spark_type("BLOB")
    for text, kind in (("abcd", "CHAR(3)"), ("abcd", "VARCHAR(3)"), ("2024-02-31", "DATE"), ("25:00:00", "TIME"), ("x", "INT")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(text,)], "x string").select(parse_field(F.col("x"), kind)).collect()
    assert rows(spark.createDataFrame([(float("nan"),), (1.0,)], "x double").select(no_nan(F.col("x")))) == [(None,), (1.0,)]


# ---- catalogue, bulk operators, sinks, streams


def test_catalog(spark, tmp_path):
    c = Catalog()
    t = c.add_table(analyse("Orders", table(spark, SF, "orders")))
    assert t.rows == table(spark, SF, "orders").count() and c.table("ORDERS").column("o_orderkey").low == 0
    c.add_index(Index("o_pk", "orders", "o_orderkey", True))
    with pytest.raises(ValueError):
        c.add_table(Table("orders", []))
    c.add_table(Table("v", [Column("name", "varchar(5)")]))
    with pytest.raises(ValueError):
        c.add_index(Index("v_ix", "v", "name"))
    c.save(str(tmp_path / "c.json"))
    assert Catalog.load(str(tmp_path / "c.json")) == c
    c.drop_table("orders")
    assert c.indexes_on("orders") == []
    register(spark, "again", spark.range(3).toDF("a"), c)
    assert c.table("again").rows == 3 and spark.table("again").count() == 3
    assert rows(unique_violations(spark.createDataFrame([(1,), (1,), (None,), (None,)], "a int"), ["a"])) == [(1, 2)]


def test_bulk(spark, tmp_path):
    spark.createDataFrame([(i % 3, i) for i in range(9)], "k int, x int").createOrReplaceTempView("bulk_in")
    tree = BulkGroupBy([BulkScan([TableInput(name="bulk_in")], Atom("x", ">", 2))], ["k"], [("sum", "x", "s")])
    assert sorted(rows(from_spec(tree.to_json()).run(spark))) == sorted(rows(tree.run(spark))) == [(0, 9), (1, 11), (2, 13)]
    assert json.loads(tree.to_json())["op"] == "BulkGroupBy"
    assert rows(CountTuples([ForwardLeft([TableInput(name="bulk_in"), BulkScan([TableInput(name="bulk_in")])])]).run(spark)) == [(9,)]
    own = MapReduce([TableInput(name="bulk_in")], lambda it: (p.assign(x=p.x * 2) for p in it), "k int, x int", ["k"], lambda p: p.head(1).assign(x=p.x.sum()), "k int, x int")
    assert sorted(rows(own.run(spark))) == [(0, 18), (1, 24), (2, 30)]
    assert materialise(spark, tree.run(spark), str(tmp_path / "m")).count() == 3


def test_sinks_and_streams(spark, tmp_path, capsys):
    path = str(tmp_path / "s")
    write_table(spark.range(5).select((F.col("id") % 2).alias("k"), "id"), path)
    assert show(spark.read.parquet(path).where("id < 2").orderBy("id").select("k", F.lit(None).alias("none"))) == 2
    out = capsys.readouterr().out
    assert "NULL" in out and out.rstrip().endswith("2 rows returned.")
    running_group_by(stream_table(spark, path), ["k"], [("count", "*", "n"), ("sum", "id", "s")], "totals", str(tmp_path / "cp")).awaitTermination()
    assert sorted(rows(spark.table("totals"))) == [(0, 3, 6), (1, 2, 4)]
    own = str(tmp_path / "own")
    running_group_by(stream_table(spark, path), ["k"], [("count", "*", "n")], "more", str(tmp_path / "cp2"), lambda df, n: df.write.mode("overwrite").parquet(f"{own}/{n}")).awaitTermination()
    assert sorted(rows(spark.read.parquet(f"{own}/0"))) == [(0, 3), (1, 2)]


def test_order(spark):
    """Sorted queries come in order, NULLs lowest, over several partitions."""
    df = spark.range(5000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 37) % 101 END AS a", "(id * 91) % 997 AS b").repartition(6)
    found = rows(R.sort(df, ("a", True), ("b", False)))
    assert found == sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    q = QUERIES["join_order_by"](spark, SF).collect()
    assert len(q) > 1 and [(r["s_name"], -r["p_partkey"]) for r in q] == sorted((r["s_name"], -r["p_partkey"]) for r in q)
    q = [(r["segment"], r["nation"]) for r in QUERIES["flagship"](spark, "/root/testdata/sf0.01").collect()]
    assert len(q) > 1 and q == sorted(sorted(q, key=lambda x: x[1], reverse=True), key=lambda x: x[0])


def test_views_as_named(spark, monkeypatch):
    """SQL text opens the tables that it names and no other."""
    opened = []
    monkeypatch.setattr("tidemark.sources.tables.table", lambda s, d, n: opened.append(n) or table(s, d, n))
    QUERIES["point_lookup"](spark, SF)
    assert opened == ["lineitem"]
    opened.clear()
    QUERIES["join_3way_range"](spark, SF)
    assert sorted(opened) == ["lineitem", "part", "supplier"]


def test_row_ids(spark):
    ids = R.with_row_id(spark.createDataFrame([(1, None), (None, 1), (1, 2), (1, 2)], "a int, b int"), ["a", "b"])
    assert ids.select("_rid").distinct().count() == 3 and ids.schema["_rid"].dataType.simpleString() == "binary"
