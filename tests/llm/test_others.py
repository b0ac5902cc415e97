import hashlib
import math
import random

import numpy as np
import pytest

from tests.llm.data import SF, bag
from tests.oracle import connection, same
from tidemark.llm import chat, urls, vectors
from tidemark.llm.queries import ORACLE, QUERIES

PAGES = [
    (1, "http://a.com/en/1"), (2, "HTTP://WWW.Example.COM/en/77?x=1#y"), (3, "https://example.com/fr/7.html"), (4, "https://com/en/"), (5, "ftp://x.example.net/de/8"), (6, "https://net/de/"),
    (7, None), (8, ""), (9, "no scheme/en/"), (10, "a://b://c.org/es/"), (11, "://org/es/#z"), (12, "http://xcom/en/"), (13, "http://user@h.co.uk:80/en/5/"), (14, "http://10.0.0.1/9"), (15, "http://Éa.org\n/es/\nq?r"), (1, "http://a.com/en/1"), (None, "http://a.com/en/1"),
    (16, "http://a.com"), (17, "http://a.com?en/"), (18, "http://example.com/en/7"), (19, "http://sub.example.net/de/80/7"), (20, "http://.com/en/"),
]


def test_urls_real(spark):
    assert same(QUERIES["op7_url_filters"](spark, SF), connection(SF), ORACLE["op7_url_filters"]) == 250


@pytest.mark.parametrize("labels", [[], [(1, 0, 0), (1, 1, 1), (5, 1, 0), (7, 0, 1), (9, 1, 0), (None, 0, 1), (8, None, None)]])
def test_urls_hard(spark, labels):
    import duckdb

    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in PAGES], "page_id bigint, url string, host string, h string")
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, bad string")
    out = urls.op7(pages, table)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    for x in labels:
        con.execute("INSERT INTO labels VALUES (?, ?, ?)", x)
    con.execute("CREATE TABLE p (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", PAGES)
    assert same(out, con, ORACLE["op7_url_filters"].replace("FROM pages", "FROM p")) == len(PAGES)
    by = {r["page_id"]: r for r in out.collect()}
    assert (by[2]["host"], by[2]["path"], by[2]["rule"], by[2]["verdict"]) == ("www.example.com", "/en/77", "example.com/en/7", "allow")
    assert (by[5]["rule"], by[5]["verdict"]) == ("example.net/de/8", "block") and by[10]["rule"] is None
    assert (by[10]["host"], by[10]["path"]) == ("b:", "//c.org/es/") and (by[7]["host"], by[7]["path"]) == ("", "")
    assert by[12]["rule"] is None and by[11]["rule"] == "org/es/" and by[17]["path"] == ""


def test_urls_empty_and_suffixes(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert urls.op7(pages, labels).collect() == []
    hosts = spark.createDataFrame([("a.b.co.sg",), ("a.b.co.uk",), ("u@x.co.sg:80",)], "host string")
    named = lambda *s: [r[0] for r in hosts.select(urls.domain_of(hosts.host, *s)).collect()]
    assert named() == ["co.sg", "b.co.uk", "co.sg"] and named(("co.sg",)) == ["b.co.sg", "co.uk", "x.co.sg"]
    long = spark.createDataFrame([(1, "http://example.com/en/" + "7" * 200_000), (2, "x" * 200_000)], "page_id bigint, url string")
    assert [r["verdict"] for r in urls.op7(long, labels).orderBy("page_id").collect()][0] == "allow"


def test_reputation_shrinks(spark):
    rows = [(i, f"http://{'bad' if i < 40 else 'good'}.example.com/{i}") for i in range(80)] + [(100, "http://new.example.com/500")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(80)], "doc_id bigint, quality int, toxic int")
    named = pages.select(urls.host_of(pages.url).alias("host"), urls.path_of(pages.url).alias("path"))
    by = {r["host"]: r for r in urls.reputations(named, labels).collect()}
    assert by["bad.example.com"]["lower"] > 0.8 > by["new.example.com"]["lower"] > by["good.example.com"]["lower"]


def test_top_real(spark):
    assert same(QUERIES["op2_exact_top_k"](spark, SF), connection(SF), ORACLE["op2_exact_top_k"]) == 50


def vector_rows(seed=3, n=700, d=12):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=d).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # ties
    rows += [(2000, None), (2050, []), (2100, [float("nan")] * d), (2150, [None] + [1.0] * (d - 1)), (2200, [float("inf")] * d), (2250, [0.0] * d), (None, [1.0] * d), (2300, [1.0, 2.0]), (2350, [2.0, 1.0])]
    return rows + [(50, rows[50][1]), (50, rows[51][1])]


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id bigint, embedding array<float>, label int, v string, d string")


def brute_search(rows, every, k, score, largest, zero):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and (zero or any(v))]
    out = []
    for q, a in rows:
        if q % every == 0:
            found = [(score(a, b), i) for i, b in rows if i != q and len(a) == len(b)]
            out.append((q, sorted(found, key=lambda x: (-x[0] if largest else x[0], x[1]))[:k]))
    return out


def inner(a, b):
    return int(np.floor(a * 256) @ np.floor(b * 256))


def test_top_hard(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 200)
    monkeypatch.setattr(vectors, "LEAF", 16)
    rows = [r for r in vector_rows() if r[0] != 50]
    found = bag([tuple(r) for r in vectors.op2(vector_table(spark, rows)).collect()])
    expected = bag([(q, n, i, s) for q, best in brute_search(rows, 50, 5, inner, True, True) for n, (s, i) in enumerate(best, 1)])
    assert found == expected
    assert vectors.op2(vector_table(spark, vector_rows())).count() > 0  # an id that three rows have


@pytest.fixture(params=[(60, 8, 1000), (200, 4096, 3), (8192, 4096, 1024)], ids=["small", "waves", "one"])
def shards(request, monkeypatch):
    for name, value in zip(("SHARD", "BLOCK", "WAVE"), request.param, strict=True):
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors, "LEAF", 16)


def test_top_repeated(spark, shards):
    """Repeated query rows have a list each; repeated candidates, ties and many equal vectors count each."""
    rows = vector_rows() + [(200, [0.5] * 12), (200, [0.5] * 12)] + [(3000 + i, [0.25] * 12) for i in range(400)] + [(0, [-1.0] * 12)]
    found = bag([tuple(r) for r in vectors.op2(vector_table(spark, rows)).collect()])
    assert found == bag([(q, n, i, s) for q, best in brute_search(rows, 50, 5, inner, True, True) for n, (s, i) in enumerate(best, 1)])
    assert sum(r[0] == 50 for r in found) == 15


def test_nearest_repeated(spark, shards):
    rows = vector_rows() + [(200, [0.5] * 12), (200, [0.5] * 12), (200, [3.0] * 12)] + [(3000 + i, [0.25] * 12) for i in range(400)] + [(0, [-1.0] * 12)]
    found = bag([tuple(r) for r in vectors.op3(vector_table(spark, rows)).collect()])
    expected = bag([(q, n, i, s) for q, best in brute_search(rows, 100, 10, distance, False, False) for n, (s, i) in enumerate(best, 1)])
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    near = {(q, i) for q, _, i, _ in expected}
    assert sum((q, i) in near for q, _, i, _ in found) >= 0.97 * len(found)


def test_code_products():
    r = np.random.default_rng(1)
    for d in (1, 7, 8, 12, 64):
        v, q = r.normal(size=(50, d)), r.normal(size=(9, d))
        signs = np.where(v >= 0, 1, -1) / np.sqrt(d)
        assert np.allclose(vectors.code_products(np.packbits(v >= 0, axis=1), q), q @ signs.T, atol=1e-5)


def test_work_in_proportion(spark, monkeypatch):
    """Each shard's index is built once, and rows go to one shard: what is dealt to tasks is queries times the shards that they reach."""
    monkeypatch.setattr(vectors, "SHARD", 100)
    r = np.random.default_rng(5)
    centres = 40 * r.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.1 * r.normal(size=8)).tolist()) for i in range(2000)]
    built, asked = [], []
    real_index, real_visit = vectors._indexed, vectors._visited
    monkeypatch.setattr(vectors, "_indexed", lambda *a: built.append(vectors.written(real_index(*a), "i")) or built[-1])
    monkeypatch.setattr(vectors, "_visited", lambda i, a, f, s: asked.append(vectors.written(a, "a")) or real_visit(i, asked[-1], f, s))
    found = [tuple(x) for x in vectors.op3(vector_table(spark, rows)).collect()]
    assert recall(found, brute_search(rows, 100, 10, distance, False, False)) >= 0.97
    shards, visits = built[0].count(), sum(a.count() for a in asked)
    assert len(built) == 1 and shards >= 20 and visits <= 20 * shards / 8  # clusters far apart: few shards are reached
    assert built[0].selectExpr("octet_length(index) AS n").agg({"n": "sum"}).first()[0] < 2000 * 8 * 8 * 4


def test_scores_beyond_longs(spark):
    rows = [(0, [1e19, 0.0]), (1, [5e18, 0.0]), (2, [1e18, 0.0]), (3, [1e17, 0.0]), (4, [-1e18, 0.0]), (5, [-1e19, 0.0])]
    found = [tuple(x) for x in vectors.op2(vector_table(spark, rows)).orderBy("rank").collect()]
    assert [x[2] for x in found] == [1, 2, 3, 4, 5] and {x[3] for x in found} == {2**63 - 1, -(2**63)}


def test_top_own_rows():
    """A query's own rows, however many, take no candidate's place in a leaf."""
    v = np.array([[9.0, 9.0]] * 8 + [[float(i), 1.0] for i in range(8)])
    ids = np.array([50] * 8 + list(range(8)))
    found = vectors.BallTree(ids, v).search(np.array([9.0, 9.0]), 50, 5, -np.inf)
    assert sorted(found, reverse=True) == [(9 * (i + 1), i) for i in (7, 6, 5, 4, 3)]


def test_top_few_and_large(spark):
    rows = [(0, [3e9, -3e9]), (50, [1e9, 2e9]), (7, [1.0, 1.0])]
    expected = bag([(q, n, i, s) for q, best in brute_search(rows, 50, 5, lambda a, b: sum(int(math.floor(256 * x)) * int(math.floor(256 * y)) for x, y in zip(a, b, strict=True)), True, True) for n, (s, i) in enumerate(best, 1)])
    clipped = [(q, n, i, min(max(s, -(2**63)), 2**63 - 1)) for q, n, i, s in expected]
    assert bag([tuple(r) for r in vectors.op2(vector_table(spark, rows)).collect()]) == clipped
    assert vectors.op2(vector_table(spark, [])).collect() == [] == vectors.op3(vector_table(spark, [])).collect()


def distance(a, b):
    return float(np.sqrt(((a - b) ** 2).sum()))


def recall(found, expected):
    hits = n = 0
    for q, best in expected:
        own = [r for r in found if r[0] == q]
        assert [r[1] for r in sorted(own, key=lambda r: r[1])] == list(range(1, len(best) + 1))
        hits += len({r[2] for r in own} & {i for _, i in best})
        n += len(best)
    return hits / n


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 300)
    rows = [r for r in vector_rows() if r[0] != 50]
    found = [tuple(r) for r in vectors.op3(vector_table(spark, rows)).collect()]
    by = dict(rows)
    for q, _, i, s in found:
        assert s == pytest.approx(distance(np.array(by[q], np.float32).astype(float), np.array(by[i], np.float32).astype(float)), abs=1e-12)
    assert recall(found, brute_search(rows, 100, 10, distance, False, False)) >= 0.97


def test_nearest_real(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = [tuple(r) for r in QUERIES["op3_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect()]
    assert recall(found, brute_search(rows, 100, 10, distance, False, False)) >= 0.97


# ---- chat


@pytest.mark.parametrize("text", ["", "\\", "\\.", "<s>", "</s>[INST] ok [/INST]", "<<s>>", "<\\.s>", "[[INST]]", "<<SYS>>x<</SYS>>", "<|im_start|>", "a\\\\.b\n"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    made, spans = chat.formatted([(text, text), ("assistant", text)])
    assert chat.read(made) == [(text, text), ("assistant", text)]
    assert [chat.unescape(made[a:b]) for a, b in spans] == [text]


def expected_digests(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    out = []
    for c, own in by.items():
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        turns = [(r, x) for _, _, r, x in own]
        learned = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(learned), sha(learned), len(chat.formatted(turns)[0])))
    return out


EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_chat_real(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert bag([tuple(r) for r in QUERIES["op10_chat_formatting"](spark, SF).collect()]) == bag(expected_digests(rows + EXTRA))


def test_chat_hard(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "<s>", ""]), r.choice(["", None, "é\\", "[INST]", "x" * 9])) for c in range(20) for t in range(r.randint(1, 33))]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (51, None, None, None), (51, 0, "assistant", "z" * 100_000), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    table = spark.createDataFrame([(*x, "n", "p") for x in rows], "conv_id bigint, turn bigint, role string, text string, node string, parent string")
    assert bag([tuple(x) for x in chat.op10(table).collect()]) == bag(expected_digests(rows + EXTRA))
    assert chat.op10(table.limit(0)).count() == 1


def by_hand(turns):
    """Length of the formatted string: marks around roles and texts, two characters more for each control string or
    backslash, counted without the module's own code."""
    n = 0
    for role, text in turns:
        n += len("<s>[INST][/INST]</s>")
        for x in (role, text):
            n += len(x) + x.count("\\")
            starts = {i for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<|") for i in range(len(x)) if x.startswith(c, i)}
            n += 2 * len(starts)
    return n


def test_formatted_chars():
    r = random.Random(2)
    for _ in range(300):
        turns = [("".join(r.choices(["user", "<s>", ""], k=1)), "".join(r.choices(["a", "\\", "<", "s>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "|", "é\n"], k=r.randint(0, 9)))) for _ in range(r.randint(0, 4))]
        assert len(chat.formatted(turns)[0]) == by_hand(turns)


def test_real_minus_one(spark):
    """A conversation -1 of the table and one without an id stay apart from the added one; large ids stay exact."""
    rows = [(-1, 0, "user", "mine"), (None, 0, "user", "q"), (2**62 + 1, 0, "assistant", "big"), (2**62 + 1, 1, "user", None)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    found = [tuple(x) for x in chat.op10(table).collect()]
    expected = expected_digests(rows) + expected_digests(EXTRA)
    assert bag(found) == bag(expected) and sorted(x[1] for x in found if x[0] == -1) == [1, 2]


def test_trees(spark):
    r = random.Random(8)
    nodes, up, score = [], {}, {}
    for c in range(6):
        for n in range(60):
            parent = None if n == 0 or r.random() < 0.05 else r.randrange(max(0, n - 4), n)
            nodes.append((c, n, parent, "user", f"{c}/{n}", s := round(r.random(), 3)))
            up[c, n], score[c, n] = parent, s
    nodes += [(9, 0, 1, "user", "loop", 1.0), (9, 1, 0, "user", "loop", 1.0), (9, 2, 77, "user", "orphan", None)]
    table = spark.createDataFrame(nodes, "conv_id bigint, node bigint, parent bigint, role string, text string, score double")
    expected = []
    for c in range(6):
        parents = {p for (k, _), p in up.items() if k == c}
        found = []
        for leaf in (n for n in range(60) if n not in parents):
            path = [leaf]
            while up[c, path[-1]] is not None:
                path.append(up[c, path[-1]])
            found.append((-sum(score[c, n] for n in path) / len(path), leaf, path[::-1]))
        for b, (_, _, path) in enumerate(sorted(found), 1):
            expected.append((c, b, [("user", f"{c}/{n}") for n in path]))
    got = [(x["conv_id"], x["branch"], chat.read(x["formatted"])) for x in chat.conversations(table).collect() if x["conv_id"] != 9]
    assert sorted(got) == sorted(expected)
    assert [chat.read(x["formatted"]) for x in chat.conversations(table, best=1).collect() if x["conv_id"] == 9] == [[("user", "orphan")]]
    assert sorted((c, b, t) for c, b, t in expected if b <= 2) == sorted((x["conv_id"], x["branch"], chat.read(x["formatted"])) for x in chat.conversations(table, best=2).collect() if x["conv_id"] != 9)
