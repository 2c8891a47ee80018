import random
import re

import pyarrow as pa

from tablerecon.llm import jaccard_join as jj
from tablerecon.llm.components import components
from tablerecon.llm.wordhash import words_of


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(n // 4)]
    while len(texts) < n:
        base = words(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base).upper() if rng.random() < 0.2 else "\n".join(base))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts))


def test_matches_brute_force(docs):
    rows = corpus(1) + [(-5, None), (-4, ""), (-3, " \n"), (-2, "one two"), (-1, "One\ttwo"), (-6, "two one"), (None, "alone " * 9)]
    rows += [rows[0], (None, rows[0][1])]
    for block, parts in ((256, None), (2, 3)):
        got = [tuple(r) for r in jj.near_duplicates(docs(rows, "component_id string, key int"), block=block, parts=parts).collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_one_large_group_in_small_blocks(docs):
    """Members of one group that mostly do not link with its smallest class."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = [tuple(r) for r in jj.near_duplicates(docs(rows), block=8, parts=4).collect()]
    assert sorted(got) == sorted(brute(rows))
    sets = jj.shared_grams(docs(rows), 4, 85, 4)
    links = jj.class_links(sets, 85, block=8).count()
    assert 0 < links < 2000  # far from the 7,140 pairs


def test_no_documents_and_only_unlike_ones(docs):
    assert jj.near_duplicates(docs([])).count() == 0
    got = jj.near_duplicates(docs(["a b c d e", "f g h i j", "x " * 40_000])).collect()
    assert [r.component_id for r in sorted(got)] == [0, 1, 2]


def test_word_hashes_are_those_of_words():
    texts = ["A b c  d", None, "", "é x\x0bA", "b"]
    for lower in (False, True):
        ((_, w),) = words_of(pa.array(texts), lower)
        seen = {}
        for d, text in enumerate(texts):
            own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            own = [x.replace("A", "a") if lower else x for x in own]
            assert w.at[d + 1] - w.at[d] == len(own)
            for word, h in zip(own, w.hashes[w.at[d] : w.at[d + 1]].tolist()):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
