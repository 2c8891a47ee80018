import re

from tablerecon.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A = "one two three four five six seven eight nine ten eleven twelve"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lower)


def brute(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(len(v) - width, 0) + 1 if v else 0):
            window = v[k : k + width]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    found.add(item)
                    hit.update(range(i, i + len(window)))
    return len(w), len(hit), found


def test_matches_brute_force(spark, docs):
    items = [(1, A), (2, "short Item"), (3, None), (4, ""), (5, "!!"), (6, A.upper() + " thirteen"), (10, "short item"), (None, "é ñ")]
    texts = [
        f"x {A} y",
        A.replace(" ", "--\n"),
        "two three four five six seven eight nine ten eleven",
        "short, ITEM! a short item",
        "shortitem short",
        None,
        "",
        "...",
        "É é Ñ é ñ",
        "one two " * 3000 + A,
        f"{A} thirteen {A}",
        f"x {A} y",
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (1 << 20, 8):
        got = decontaminate(docs(texts, "n_hit int, other string"), bench, part_bytes=part).collect()
        assert len(got) == len(texts)
        for row in got:
            n, hit, found = brute(row.text, items)
            assert (row.n_words, row.n_hit, row.n_items) == (n, hit, len(found))
            assert row.item_ids == sorted(str(i) for i in found if i is not None)
            inside = [w for s in row.hit_spans for w in words(row.text[s.start : s.end])]
            assert len(inside) == hit


def test_no_items_and_no_documents(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs(["a"]), empty).first().n_hit == 0
    assert decontaminate(docs([]), empty).count() == 0
