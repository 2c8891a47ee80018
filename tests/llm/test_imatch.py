"""Fingerprints against a plain computation with Python sets, integers and one sorted list."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest

from tablerecon.llm import imatch
from tablerecon.llm.wordhash import words_of

MASK = (1 << 64) - 1
SPACE = "\t\n\x0b\x0c\r "


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def terms_of(text):
    for s in SPACE:
        text = text.replace(s, " ")
    return {w for w in lower(text).split(" ") if w}


def word_hash(word):
    (_, words), = words_of(pa.array([word]))
    return int(words.hashes[0])


def mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def brute_fingerprint(text, lexicon):
    terms = terms_of(text)
    chosen = sorted(word_hash(w) for w in (terms & lexicon or terms))
    if not chosen:
        return ""
    level = 0
    while len(chosen) >= 2 * 4 ** (level + 1) and level < imatch.LAST_LEVEL:
        level += 1
    digits = ""
    for at in (level, level + 1):
        for subset in range(imatch.SUBSETS):
            seed = int(imatch._SEEDS[subset // 4])
            held = [t for t in chosen if (mix(t ^ seed) >> 16 * (subset % 4)) % 65536 < 65536 >> 2 * at]
            total = sum(mix(t ^ int(imatch._SEEDS[-1])) for t in held) & MASK
            digits += f"{mix(total) % 0xFFFFFF + 1 if held else 0:06x}"
    return f"{level}:{digits}"


def brute(rows, least, most):
    texts = [t or "" for _, t in rows]
    counts = {}
    for t in texts:
        for w in terms_of(t):
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w for w, n in counts.items() if least * len(texts) <= n <= most * len(texts)}
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    out = []
    for at, (known, i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][2]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        out.append((i if known else None, len(text), edited, brute_fingerprint(text, lexicon), brute_fingerprint(edited, lexicon), brute_fingerprint(following, lexicon)))
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)

    def levels(shown):
        level, digits = shown.split(":")
        half = 6 * imatch.SUBSETS
        return {int(level): digits[:half], int(level) + 1: digits[half:]}

    a, b = levels(a), levels(b)
    if not a.keys() & b.keys():
        return 0.0
    level = max(a.keys() & b.keys())
    pairs = [(a[level][i : i + 6], b[level][i : i + 6]) for i in range(0, 6 * imatch.SUBSETS, 6)]
    told = [x == y for x, y in pairs if (x, y) != ("000000", "000000")]
    return sum(told) / len(told) if told else float(a == b)


def found_rows(spark, rows, schema="doc_id long, text string", **options):
    made = imatch.fingerprint_with_next(spark.createDataFrame(rows, schema), **options)
    return [tuple(r) for r in made.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], str(r[2:])))


def texts(rng, n):
    vocabulary = [f"{a}{b}" for a in "ABcdéf漢" for b in range(40)]
    return [rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 10, 60, 400]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_rows_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = list(zip(rng.sample(range(-(10**15), 10**15), 150), texts(rng, 150)))
    rows[5] = (rows[5][0], None)
    rows[7] = (rows[7][0], rows[9][1])
    rng.shuffle(rows)
    found = by_id(found_rows(spark, rows, least_share=0.02, most_share=0.3))
    expected = by_id(brute(rows, 0.02, 0.3))
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected):
        assert f[5] == pytest.approx(plain_likeness(f[3], f[4]))
        assert f[6] == pytest.approx(plain_likeness(f[3], e[5]))
    same = {t: set() for t in terms_of("")}
    for f, (_, text) in zip(found, sorted(rows)):
        same.setdefault(text or "", set()).add(f[3])
    assert all(len(prints) == 1 for prints in same.values())


def test_null_ids_hot_ids_and_repeated_rows(spark):
    rng = random.Random(3)
    made = texts(rng, 300)
    rows = [(None, t) for t in made[:100]] + [(7, t) for t in made[100:200]] + [(i, t) for i, t in enumerate(made[200:])] + [(50, "same again")] * 40
    found = found_rows(spark, rows)
    assert len(found) == len(rows)
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in found) == sorted((i is None, i or 0, len(t)) for i, t in rows)
    # Each document's head ends exactly one other one: the order is one cycle through all rows.
    plain = [r for r in found if r[0] is not None and r[0] not in (7, 50)]
    ordered = {i: t for i, t in rows if i not in (None, 7, 50)}
    for r in plain:
        if r[0] + 1 in ordered:
            text, cut = ordered[r[0]], len(ordered[r[0]]) // 4
            assert r[2] == text[: len(text) - cut] + ordered[r[0] + 1][:cut]
    repeated = [r for r in found if r[0] == 50 and r[1] == 10 and r[2] == "same agasa"]
    assert len(repeated) == 39 + (made[200 + 50][:2] == "sa")


def test_small_tables_and_clashing_names(spark):
    assert found_rows(spark, []) == []
    (only,) = found_rows(spark, [(4, "one two three four")])
    assert only[:3] == (4, 18, "one two three onone "[:14] + "one ") and only[6] == 1.0
    both = by_id(found_rows(spark, [(1, ""), (2, None)]))
    assert [r[1:] for r in both] == [(0, "", "", "", 1.0, 1.0)] * 2
    rows = [(i, f"word{i} shared") for i in range(20)]
    names = "range int, ghost int, tie long, place long, term long, n long, edited string"
    wide = found_rows(spark, [r + (1, 2, 3, 4, 5, 6, "x") for r in rows], "doc_id long, text string, " + names)
    assert by_id(wide) == by_id(found_rows(spark, rows))


def test_lexicon_is_cut_by_a_hash_beyond_its_bound(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i % 7, 500))) for i in range(20)], "doc_id long, text string")
    whole = imatch.lexicon(docs, 0.1, 1.0, 1000)
    small = imatch.lexicon(docs, 0.1, 1.0, 100)
    assert len(whole) == 500 and 30 < len(small) < 110 and set(small.tolist()) < set(whole.tolist())
    assert (np.diff(whole.view(np.uint64).astype(object)) > 0).all()


def test_edited_texts_are_near_and_other_texts_are_not(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([40, 200, 2000])))) for i in range(200)]
    found = found_rows(spark, rows)
    edited, following = [r[5] for r in found], [r[6] for r in found]
    assert statistics.mean(edited) > 0.35 and min(edited) > 0.05
    assert statistics.mean(following) < 0.1 and sum(e > n for e, n in zip(edited, following)) > 195
