"""The registered queries: each with its Spark form and the SQL that another engine runs for comparison."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators.bulk import BulkGroupBy, BulkScan, CountTuples, ForwardLeft, Identity, TableInput
from tidemark.functions.types import parse_field
from tidemark.operators.dml import VersionedTable, deleted, inserted, updated
from tidemark.operators.predicates import Atom, Between, JoinAtom, Junction
from tidemark.plans import sql as S
from tidemark.sources.files import shared_dir
from tidemark.sources.tables import PARTSUPPLIER_SQL, partsupplier, register_views, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_PS = f"WITH partsupplier AS ({PARTSUPPLIER_SQL}) "


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return keep


def _t(*names: str):
    """The named tables as arguments of the query; ps is partsupplier."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[partsupplier(table(spark, sf_dir, "lineitem")) if n == "ps" else table(spark, sf_dir, n) for n in names])

        run.__name__ = f.__name__
        return run

    return wrap


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the engine's own SQL subset."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, S.tables_of(S.parse(text)))
        return S.query(spark, text)

    QUERIES[name], ORACLE[name] = run, oracle or _PS + text.replace('"', "'")


money = lambda c: F.round(c, 2)

# ---- scans, filters and lookups


@query("scan_project", "SELECT c_custkey, c_acctbal, c_nationkey, c_custkey AS key_again FROM customer")
@_t("customer")
def scan_project(c):
    return R.project(c, ["c_custkey", "c_acctbal", "c_nationkey", F.col("c_custkey").alias("key_again")])


@query("scan_filter_conj", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' AND l_discount <> 0")
@_t("lineitem")
def scan_filter_conj(li):
    return R.scan(li, ["l_orderkey", "l_partkey", "l_quantity"], Between("l_quantity", 10, 20, True, False), Atom("l_returnflag", "=", "R"), Atom("l_discount", "<>", 0))


_sql("point_lookup", "SELECT l.l_orderkey, l.l_partkey, l.l_quantity FROM lineitem l WHERE l.l_partkey = 42")

for _name, _lo, _hi in (("oo", False, False), ("oc", False, True), ("co", True, False), ("cc", True, True)):
    query(f"range_lookup_{_name}", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {'>=' if _lo else '>'} 10 AND o_custkey {'<=' if _hi else '<'} 25")(
        _t("orders")(lambda o, lo=_lo, hi=_hi: R.lookup_range(o, "o_custkey", 10, 25, lo, hi, ["o_orderkey", "o_custkey"]))
    )


@query("range_lookup_empty", "SELECT o_orderkey FROM orders WHERE o_custkey > 10 AND o_custkey < 10")
@_t("orders")
def range_lookup_empty(o):
    return R.lookup_range(o, "o_custkey", 10, 10, False, False, ["o_orderkey"])


@query("index_key_scan", "SELECT l_suppkey FROM lineitem WHERE l_suppkey >= 3 AND l_suppkey < 6 ORDER BY l_suppkey")
@_t("lineitem")
def index_key_scan(li):
    return R.index_scan(li, "l_suppkey", 3, 6, True, False)


@query("index_lookup_keys", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (1, 5, 7, 11, 13, 17, 19, 23, 29, 31)")
@_t("orders")
def index_lookup_keys(o):
    return R.scan(o, ["o_orderkey", "o_custkey", "o_totalprice"], Junction("or", tuple(Atom("o_custkey", "=", k) for k in (1, 5, 7, 11, 13, 17, 19, 23, 29, 31))))


@query("fetch_by_row_id", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey = 7")
@_t("orders")
def fetch_by_row_id(o):
    rows = R.with_row_id(o, ["o_orderkey"])
    return R.fetch(rows.where("o_custkey = 7").select("_rid"), rows, "_rid", ["o_orderkey", "o_orderpriority"])


@query("filter_or", "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size = 50 OR p_retailprice > 1900")
@_t("part")
def filter_or(p):
    return R.filter_(p, Atom("p_size", "<", 5) | Atom("p_size", "=", 50) | Atom("p_retailprice", ">", 1900)).select("p_partkey", "p_size")


@query("filter_nested", "SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size < 10 AND p_brand >= 'Brand#3') OR (p_size > 40 AND p_retailprice <> 1000)")
@_t("part")
def filter_nested(p):
    tree = (Atom("p_size", "<", 10) & Atom("p_brand", ">=", "Brand#3")) | (Atom("p_size", ">", 40) & Atom("p_retailprice", "<>", 1000))
    return R.filter_(p, tree).select("p_partkey", "p_brand", "p_size")


@query("filter_correlated", "SELECT s_suppkey, s_nationkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9900)")
@_t("supplier", "customer")
def filter_correlated(s, c):
    return R.correlated_filter(s, c.where("c_acctbal > 9900"), JoinAtom("s_nationkey", "=", "c_nationkey")).select("s_suppkey", "s_nationkey")


_sql("range_filter_supplier", "SELECT l.l_orderkey, l.l_suppkey FROM lineitem l WHERE l.l_suppkey > 10 AND l.l_suppkey < 90")

# ---- joins


@query("join_equi", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
@_t("orders", "customer")
def join_equi(o, c):
    return R.nl_join(o, c, JoinAtom("o_custkey", "=", "c_custkey")).select("o_orderkey", "c_name")


@query("join_multi_key", _PS + "SELECT l_orderkey, ps_partkey, ps_suppkey, ps_availqty FROM lineitem, partsupplier WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_quantity > 45")
@_t("lineitem", "ps")
def join_multi_key(li, ps):
    return R.merge_join(li.where("l_quantity > 45"), ps, [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")]).select("l_orderkey", "ps_partkey", "ps_suppkey", "ps_availqty")


@query("join_theta", "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_regionkey < r_regionkey")
@_t("nation", "region")
def join_theta(n, r):
    return R.nl_join(n, r, JoinAtom("n_regionkey", "<", "r_regionkey")).select("n_nationkey", "r_regionkey")


@query("join_or", "SELECT n_nationkey, r_regionkey FROM nation, region WHERE (n_regionkey < r_regionkey AND n_nationkey > r_regionkey) OR n_regionkey = r_regionkey")
@_t("nation", "region")
def join_or(n, r):
    return R.nl_join(n, r, (JoinAtom("n_regionkey", "<", "r_regionkey") & JoinAtom("n_nationkey", ">", "r_regionkey")) | JoinAtom("n_regionkey", "=", "r_regionkey")).select("n_nationkey", "r_regionkey")


_sql(
    "join_mixed",
    "SELECT o.o_orderkey AS o_orderkey, c.c_custkey AS c_custkey, l.l_extendedprice AS l_extendedprice, s.s_name AS s_name FROM orders o, customer c, lineitem l, supplier s "
    "WHERE o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND l.l_extendedprice < o.o_totalprice AND l.l_quantity > 40",
)


@query("join_cross", "SELECT n_nationkey, r_name FROM nation, region")
@_t("nation", "region")
def join_cross(n, r):
    return R.nl_join(n, r).select("n_nationkey", "r_name")


@query("join_merge", "SELECT o_orderkey, l_partkey, l_extendedprice FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_extendedprice * 2 > o_totalprice")
@_t("orders", "lineitem")
def join_merge(o, li):
    return R.merge_join(o, li, [("o_orderkey", "l_orderkey")], F.col("l_extendedprice") * 2 > F.col("o_totalprice")).select("o_orderkey", "l_partkey", "l_extendedprice")


@query("join_index_nl", "SELECT c_custkey, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND c_acctbal > 9000")
@_t("customer", "orders")
def join_index_nl(c, o):
    return R.index_nl_join(c.where("c_acctbal > 9000"), o, JoinAtom("o_custkey", "=", "c_custkey")).select("c_custkey", "o_orderkey")


_sql(
    "join_correlated_5way",
    "SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey, l.l_partkey AS l_partkey, p.p_brand AS p_brand, s.s_name AS s_name FROM customer c, orders o, lineitem l, part p, supplier s "
    "WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND c.c_acctbal > 9500",
)
_sql(
    "join_derived_min",
    "SELECT p.p_partkey AS p_partkey, p.p_brand AS p_brand, p.p_retailprice AS p_retailprice FROM part p, "
    "(SELECT q.p_brand AS brand, MIN(q.p_retailprice) AS low FROM part q GROUP BY q.p_brand) m WHERE p.p_brand = m.brand AND p.p_retailprice = m.low",
    "SELECT p_partkey, p.p_brand, p_retailprice FROM part p, (SELECT p_brand AS brand, MIN(p_retailprice) AS low FROM part GROUP BY p_brand) m WHERE p.p_brand = brand AND p_retailprice = low",
)
_sql(
    "join_3way_range",
    "SELECT p.p_name AS p_name, s.s_name AS s_name, ps.ps_supplycost AS ps_supplycost FROM part p, supplier s, partsupplier ps "
    "WHERE p.p_partkey = ps.ps_partkey AND s.s_suppkey = ps.ps_suppkey AND p.p_partkey >= 100 AND p.p_partkey <= 200",
)
for _name, _hi in (("join_3way_composite", 110), ("join_3way_composite_wide", 130)):
    _sql(
        _name,
        "SELECT o.o_orderkey AS o_orderkey, l.l_partkey AS l_partkey, l.l_suppkey AS l_suppkey, ps.ps_availqty AS ps_availqty FROM orders o, lineitem l, partsupplier ps "
        f"WHERE o.o_orderkey = l.l_orderkey AND l.l_partkey = ps.ps_partkey AND l.l_suppkey = ps.ps_suppkey AND l.l_partkey > 100 AND l.l_partkey < {_hi}",
    )
_sql(
    "join_order_by",
    "SELECT p.p_partkey AS p_partkey, s.s_name AS s_name, ps.ps_availqty AS ps_availqty FROM part p, partsupplier ps, supplier s "
    "WHERE p.p_partkey = ps.ps_partkey AND s.s_suppkey = ps.ps_suppkey AND ps.ps_availqty >= 1 AND ps.ps_availqty <= 20 AND p.p_size > 5 ORDER BY s_name, p_partkey DESCENDING",
)

# ---- aggregation


@query("agg_all_five", "SELECT count(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total, ROUND(AVG(l_quantity), 2) AS mean, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last FROM lineitem")
@_t("lineitem")
def agg_all_five(li):
    out = R.group_by(li, [], [("count", "*", "n"), ("sum", "l_extendedprice", "total"), ("avg", "l_quantity", "mean"), ("min", "l_shipdate", "first"), ("max", "l_shipdate", "last")])
    return out.withColumns({"total": money("total"), "mean": money("mean")})


@query("agg_group_one", "SELECT c_nationkey, count(*) AS n, ROUND(AVG(c_acctbal), 2) AS mean FROM customer GROUP BY c_nationkey")
@_t("customer")
def agg_group_one(c):
    return R.group_by(c, ["c_nationkey"], [("count", "*", "n"), ("avg", "c_acctbal", "mean")]).withColumn("mean", money("mean"))


@query("agg_group_two", "SELECT l_returnflag, l_linestatus, count(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, MIN(l_discount) AS low, MAX(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus")
@_t("lineitem")
def agg_group_two(li):
    return R.group_by(li, ["l_returnflag", "l_linestatus"], [("count", "*", "n"), ("sum", "l_quantity", "qty"), ("min", "l_discount", "low"), ("max", "l_tax", "high")]).withColumn("qty", money("qty"))


@query("agg_empty_global", "SELECT count(*) AS n, CAST(SUM(p_size) AS BIGINT) AS total, MIN(p_size) AS low FROM part WHERE p_size < 0")
@_t("part")
def agg_empty_global(p):
    return R.group_by(p.where("p_size < 0"), [], [("count", "*", "n"), ("sum", "p_size", "total"), ("min", "p_size", "low")])


@query("agg_empty_global_zero", "SELECT count(*) AS n, CAST(COALESCE(SUM(p_size), 0) AS BIGINT) AS total, AVG(p_size) AS mean FROM part WHERE p_size < 0")
@_t("part")
def agg_empty_global_zero(p):
    return R.group_by(p.where("p_size < 0"), [], [("count", "*", "n"), ("sum", "p_size", "total"), ("avg", "p_size", "mean")], empty_sum_is_zero=True)


@query("agg_empty_grouped", "SELECT p_brand, count(*) AS n FROM part WHERE p_size < 0 GROUP BY p_brand")
@_t("part")
def agg_empty_grouped(p):
    return R.group_by(p.where("p_size < 0"), ["p_brand"], [("count", "*", "n")])


_sql(
    "sum_by_key",
    "SELECT l.l_partkey AS l_partkey, COUNT(*) AS n, MIN(l.l_extendedprice) AS low, SUM(l.l_linenumber) AS lines FROM lineitem l GROUP BY l.l_partkey",
    "SELECT l_partkey, COUNT(*) AS n, MIN(l_extendedprice) AS low, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_partkey",
)


@query(
    "agg_having",
    "SELECT * FROM (SELECT n_name, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey "
    "GROUP BY n_name) WHERE qty > 60000",
)
@_t("lineitem", "orders", "customer", "nation")
def agg_having(li, o, c, n):
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return R.having(R.group_by(joined, ["n_name"], [("sum", "l_quantity", "qty")]).withColumn("qty", money("qty")), Atom("qty", ">", 60000))


_FLAGSHIP_FROM = (
    "FROM customer c, orders o, lineitem l, supplier s, nation n WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey "
    "AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = n.n_nationkey AND l.l_quantity < 40 GROUP BY n.n_name, c.c_mktsegment"
)
_FLAGSHIP_SQL = f"SELECT nation, segment, ROUND(revenue, 2) AS revenue, n FROM (SELECT n.n_name AS nation, c.c_mktsegment AS segment, SUM(l.l_extendedprice) AS revenue, COUNT(*) AS n {_FLAGSHIP_FROM}) WHERE n > 100"


def _flagship(order: str):
    text = f"SELECT n.n_name AS nation, c.c_mktsegment AS segment, SUM(l.l_extendedprice) AS revenue, COUNT(*) AS n {_FLAGSHIP_FROM} HAVING n > 100 ORDER BY {order}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, S.tables_of(S.parse(text)))
        out = S.query(spark, text)
        return out.withColumn("revenue", money("revenue"))

    return run


QUERIES["flagship"], ORACLE["flagship"] = _flagship("segment ASC, nation DESC"), _FLAGSHIP_SQL
QUERIES["flagship_order_agg"], ORACLE["flagship_order_agg"] = _flagship("segment ASC, revenue DESC, nation"), _FLAGSHIP_SQL

# ---- sort, NULLs, expressions


@query("sort_multi_dir", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey ASC NULLS FIRST, o_totalprice DESC NULLS LAST")
@_t("orders")
def sort_multi_dir(o):
    return R.sort(o.select("o_custkey", "o_orderkey", "o_totalprice"), ("o_custkey", True), ("o_totalprice", False))


_N = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END"


def _nulls(c: DataFrame) -> DataFrame:
    return c.select("c_custkey", "c_acctbal", F.expr(_N).alias("k"))


@query("null_predicates", f"SELECT c_custkey FROM (SELECT c_custkey, {_N} AS k FROM customer) WHERE k <> 3 AND (k < 10 OR k >= 20)")
@_t("customer")
def null_predicates(c):
    return R.filter_(_nulls(c), Atom("k", "<>", 3), Atom("k", "<", 10) | Atom("k", ">=", 20)).select("c_custkey")


@query("null_group", f"SELECT k, count(*) AS n, count(k) AS known, ROUND(SUM(c_acctbal), 2) AS total FROM (SELECT c_acctbal, {_N} AS k FROM customer) GROUP BY k")
@_t("customer")
def null_group(c):
    return R.group_by(_nulls(c), ["k"], [("count", "*", "n"), ("count", "k", "known"), ("sum", "c_acctbal", "total")]).withColumn("total", money("total"))


@query("null_join", f"SELECT c_custkey, n_name FROM (SELECT c_custkey, {_N} AS k FROM customer), (SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS nk FROM nation) WHERE k = nk")
@_t("customer", "nation")
def null_join(c, n):
    return R.merge_join(_nulls(c), n.select("n_name", F.expr("CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END").alias("nk")), [("k", "nk")]).select("c_custkey", "n_name")


_sql(
    "expr_arith",
    "SELECT l.l_orderkey AS l_orderkey, l.l_linenumber * 2 + 1 AS odd, l.l_quantity - 1.5 AS less, (l.l_linenumber + 3) / 2 AS half FROM lineitem l WHERE l.l_linenumber < 3",
)


@query("expr_int_div", "SELECT l_orderkey, l_linenumber // 2 AS half FROM lineitem WHERE l_linenumber < 3")
@_t("lineitem")
def expr_int_div(li):
    return li.where("l_linenumber < 3").select("l_orderkey", F.expr("CAST(l_linenumber DIV 2 AS INT)").alias("half"))


# ---- bulk operators


def _bulk(spark: SparkSession, sf_dir: str, name: str) -> TableInput:
    table(spark, sf_dir, name).createOrReplaceTempView(name)
    return TableInput(name=name)


@query("bulk_scan", "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_nationkey = 3")
def bulk_scan(spark, sf_dir):
    return BulkScan([_bulk(spark, sf_dir, "customer")], Atom("c_acctbal", ">", 5000) & Atom("c_nationkey", "=", 3)).run(spark)


@query("bulk_group", "SELECT o_custkey, count(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def bulk_group(spark, sf_dir):
    return BulkGroupBy([_bulk(spark, sf_dir, "orders")], ["o_custkey"], [("count", "*", "n"), ("max", "o_totalprice", "top")]).run(spark)


@query("bulk_count", "SELECT count(*) AS count FROM lineitem")
def bulk_count(spark, sf_dir):
    return CountTuples([_bulk(spark, sf_dir, "lineitem")]).run(spark)


@query("bulk_identity", "SELECT * FROM nation")
def bulk_identity(spark, sf_dir):
    return Identity([_bulk(spark, sf_dir, "nation")]).run(spark)


@query("bulk_forward_left", "SELECT * FROM nation")
def bulk_forward_left(spark, sf_dir):
    return ForwardLeft([_bulk(spark, sf_dir, "nation"), _bulk(spark, sf_dir, "region")]).run(spark)


# ---- changed tables


@query("dml_insert_select", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
@_t("region", "nation")
def dml_insert_select(r, n):
    return inserted(r, n.where("n_regionkey = 1").select(F.col("n_nationkey") + 100, "n_name"))


@query("dml_delete", "SELECT * FROM supplier WHERE NOT (s_nationkey = 3 OR s_acctbal < 0)")
@_t("supplier")
def dml_delete(s):
    return deleted(s, (F.col("s_nationkey") == 3) | (F.col("s_acctbal") < 0))


@query("dml_update", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '!' ELSE p_brand END AS p_brand, CASE WHEN p_size > 25 THEN p_size - 25 ELSE p_size END AS p_size FROM part")
@_t("part")
def dml_update(p):
    return updated(p.select("p_partkey", "p_brand", "p_size"), {"p_brand": F.concat("p_brand", F.lit("!")), "p_size": F.col("p_size") - 25}, F.col("p_size") > 25)


def _statements(name: str, columns: str, source: str, statements: list[str], oracle: str) -> None:
    """A query that makes a table of some columns of another, runs statements on it, and reads it back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = VersionedTable(spark, f"{shared_dir(spark)}/tidemark/tables/{uuid.uuid4().hex}")
        t.replace(table(spark, sf_dir, source).selectExpr(*columns.split(", ")))
        for text in statements:
            register_views(spark, sf_dir, S.tables_of(S.parse(text)) - {"t"})
            S.execute(spark, text, {"t": t})
        return t.read()

    QUERIES[name], ORACLE[name] = run, oracle


_statements(
    "dml_sql_insert_values", "r_regionkey, r_name", "region", ['INSERT INTO t VALUES (100, "NEW"), (-1, "it\'s"), (NULL, NULL)', 'INSERT INTO t VALUES (101, "")'],
    "SELECT * FROM region UNION ALL (VALUES (100, 'NEW'), (-1, 'it''s'), (NULL, NULL), (101, ''))",
)
_statements(
    "dml_sql_insert_select", "s_suppkey, s_name, s_acctbal", "supplier", ["INSERT INTO t SELECT s.s_suppkey + 100000 AS k, s.s_name, s.s_acctbal * -1 AS b FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = 2"],
    "SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 100000, s_name, s_acctbal * -1 FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 2",
)
_statements(
    "dml_sql_update", "p_partkey, p_brand, p_size", "part", ['UPDATE t SET p_brand = "none", p_size = t.p_size * 2 + 1 WHERE t.p_size > 25 AND t.p_brand < "Brand#4"'],
    "SELECT p_partkey, CASE WHEN p_size > 25 AND p_brand < 'Brand#4' THEN 'none' ELSE p_brand END AS p_brand, CASE WHEN p_size > 25 AND p_brand < 'Brand#4' THEN p_size * 2 + 1 ELSE p_size END AS p_size FROM part",
)
_statements("dml_sql_delete", "c_custkey, c_nationkey, c_acctbal", "customer", ["DELETE FROM t WHERE t.c_acctbal < -100 AND t.c_nationkey <> 3", "DELETE FROM t WHERE t.c_custkey = 1"],
    "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE NOT (c_acctbal < -100 AND c_nationkey <> 3) AND c_custkey <> 1",
)
_statements(
    "dml_sql_all", "n_nationkey, n_name, n_regionkey", "nation",
    ['INSERT INTO t VALUES (50, "X", 9), (51, "Y", 9)', "UPDATE t SET n_regionkey = t.n_regionkey - 10 WHERE t.n_nationkey >= 50", "DELETE FROM t WHERE t.n_nationkey = 51", "INSERT INTO t SELECT u.n_nationkey, u.n_name, u.n_regionkey FROM t u WHERE u.n_nationkey = 50"],
    "SELECT * FROM nation UNION ALL (VALUES (50, 'X', -1), (50, 'X', -1))",
)

# ---- literals and typed text

_sql(
    "literal_signed",
    "SELECT c.c_custkey AS c_custkey, c.c_custkey - -3 AS up, c.c_custkey * -2 + 1 AS down, -c.c_nationkey AS neg FROM customer c WHERE c.c_acctbal > -500.5 AND c.c_custkey-3 > -1",
    "SELECT c_custkey, c_custkey - -3 AS up, c_custkey * -2 + 1 AS down, -c_nationkey AS neg FROM customer WHERE c_acctbal > -500.5 AND c_custkey - 3 > -1",
)
_sql(
    "literal_string",
    'SELECT c.c_custkey AS c_custkey, "it\'s" AS word FROM customer c WHERE c.c_mktsegment >= "BUILDING" AND c.c_mktsegment <> "MACHINERY"',
    "SELECT c_custkey, 'it''s' AS word FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment <> 'MACHINERY'",
)


@query(
    "typed_fields",
    "SELECT o_orderkey AS k, CAST(o_totalprice AS FLOAT) AS price, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE rpad(o_orderstatus, 3, ' ') END AS status, CAST(o_orderdate AS DATE) AS day, "
    "o_orderpriority AS priority FROM orders",
)
@_t("orders")
def typed_fields(o):
    status = F.when(F.col("o_custkey") % 7 == 0, F.lit("NULL")).otherwise(F.col("o_orderstatus"))
    text = {"k": (F.col("o_orderkey").cast("string"), "BIGINT"), "price": (F.col("o_totalprice").cast("string"), "FLOAT"), "status": (status, "CHAR(3)"),
            "day": (F.date_format("o_orderdate", "yyyy-M-d"), "DATE"), "priority": (F.col("o_orderpriority"), "VARCHAR(20)")}
    return o.select(*[parse_field(c, kind).alias(n) for n, (c, kind) in text.items()])


_BAD = (
    "", "DROP TABLE t", "SELECT t.a FROM t WHERE t.a ! 3", 'SELECT t.a FROM t WHERE t.a = "x', "SELECT t.a + 1 FROM t", "SELECT u.a FROM t", "SELECT t.a, COUNT(*) AS n FROM t GROUP BY t.b", "SELECT t.a FROM t t LIMIT 3",
)


@query(
    "parse_errors",
    "SELECT * FROM (VALUES (0, 'UNEXPECTED_END', 0), (1, 'NOT_A_STATEMENT', 0), (2, 'BAD_CHARACTER', 28), (3, 'OPEN_STRING', 30), (4, 'ALIAS_NEEDED', 7), (5, 'UNKNOWN_ALIAS', 16), (6, 'UNGROUPED_COLUMN', 44), "
    "(7, 'TRAILING_INPUT', 20)) v(n, code, place)",
)
def parse_errors(spark, sf_dir):
    rows = []
    for n, text in enumerate(_BAD):
        try:
            S.parse(text)
        except S.ParseError as e:
            rows.append((n, e.code.name, e.position))
    return spark.createDataFrame(rows, "n int, code string, place int")
