import random
import re

from tablerecon.llm.substring_dedup import Automaton, remove_repeats


def brute(rows, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    seen, out = set(), []
    for i in order:
        w, gone = split[i], set()
        for k in range(len(w) - width + 1):
            window = tuple(w[k : k + width])
            if window in seen:
                gone.update(range(k, k + width))
            seen.add(window)
        out.append((rows[i][0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(frame, **options):
    rows = remove_repeats(frame, **options).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in rows), key=str)


def test_matches_brute_force(docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    shared = [rng.choices(vocabulary, k=rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(-500, 500), 150):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choices(vocabulary, k=rng.randint(0, 30))
            w += rng.choice(shared) if rng.random() < 0.7 else []
        if w and rng.random() < 0.2:
            w[rng.randrange(len(w))] = "Edit"
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(600, None), (601, ""), (602, " \x0b "), (603, "same " * 3000), (604, "a b c " * 40), (None, rows[0][1]), (605, " ".join(shared[0] * 3))]
    for parts, anchor in ((None, 5), (3, 5), (2, 20), (4, 1)):
        assert run(docs(rows, "kept string, n_words int"), parts=parts, anchor=anchor) == brute(rows, 20), (parts, anchor)
    for hot in (0, 2, 40):  # all, many and a few anchors are hot
        assert run(docs(rows), parts=3, hot=hot) == brute(rows, 20), hot


def test_shared_passages_of_many_documents(docs):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} head {passage} tail own{i}") for i in range(300)]
    got = run(docs(rows))
    assert got == brute(rows, 20) and sum(n for _, _, n, _ in got) == 299 * 62  # "head" and "tail" are shared too


def test_repeated_rows_are_one_document(docs):
    text = " ".join(f"x{i}" for i in range(40))
    assert [n for _, _, n, _ in run(docs([(1, text), (1, text)]))] == [0, 0]
    assert sorted(n for _, _, n, _ in run(docs([(1, text), (1, text + " y")]))) == [0, 40]
    assert run(docs([])) == []


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(50):
        old = [rng.choices(range(3), k=rng.randint(1, 12)) for _ in range(3)]
        new = rng.choices(range(4), k=15)
        automaton = Automaton()
        for words in old:
            automaton.add(words)
        parts = {tuple(w[a:b]) for w in old for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        expected = [max((n for n in range(e + 2) if n == 0 or tuple(new[e + 1 - n : e + 1]) in parts)) for e in range(15)]
        assert automaton.statistics(new) == expected
