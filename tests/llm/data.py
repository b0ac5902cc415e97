"""Small hard tables: nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""

import random

SF = "/root/testdata/sf0.01"
EXTRA = "h string, _id string, cls string, i int, line string, words string, label string, _text string"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def docs_rows(seed=0, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeéß", k=r.randint(2, 7))) for _ in range(60)]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k)).capitalize() + r.choice(".!?")
    passage = " ".join(sentence(9) for _ in range(8))
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 and rows:
            words = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, max(1, len(words) // 12))):
                words[r.randrange(len(words))] = r.choice(vocab)
            text = " ".join(words)
        else:
            text = "\n".join(" ".join(sentence(r.randint(1, 9)) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 9)))
            if kind > 0.8:
                cut = r.randrange(len(text))
                text = text[:cut] + " " + passage + " " + text[cut:]
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, " \t\n \n"), (503, "Ein Wort"), (504, "Ein Wort"), (505, "one two THREE"), (506, "one two three"), (507, "12 ... 34")]
    rows += [(508, "again and again. " * 3000), (509, "x" * 50_000), (None, "A text without an id, but with words enough to have shingles."), (None, None)]
    rows += [(510, rows[3][1]), (510, rows[3][1]), (510, rows[4][1]), (2, rows[2][1])]
    rows += [(511, "a\nb\nc\nd\na\nb\nc\nd\na\nb\nc"), (512, "z\n\na\nb\n  c \nq"), (513, "b\nc\nd")]
    return rows


def docs(spark, rows=None):
    rows = docs_rows() if rows is None else rows
    return spark.createDataFrame([(i, t, "xx" if t and len(t) % 2 else None, "s", None if t is None else len(t), "h", "_id", "cls", 1, "line", "w", "l", "t") for i, t in rows], DOCS)


def bag(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, dict | list) else (False, "", str(x)) for x in r))
