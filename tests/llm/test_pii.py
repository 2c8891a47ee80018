import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tablerecon.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        s += n // 10 + n % 10
    return s % 10 == 0


def brute(text):
    digits = lambda m: re.sub(r"\D", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


FIXED = [
    "mail a.b@c.de, x@y@z.org a@b.c_d@e.f @q.r a@b",
    "1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111",
    "+1 (555) 010-9999. +12 +1+1+123456789 +49 30 1234567 8",
    "é😀 a@b.co 😀 4242424242424242 +4930123456789",
    "9" * 3000 + " " + "a" * 5000 + "@",
    "0" * 5000 + ".1.1.1",
]


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    texts = FIXED[:5] + ["".join(rng.choices("a.@1 -+()é2", k=60)) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans(FIXED[5]) == [] and pii.base_spans(FIXED[6]) == [(1, 0, 5006)]


def names_of(text, spans):
    """Entities of a text and their groups."""
    out = set()
    for k, s, e in spans:
        v = text[s:e].lower() if k == 0 else text[s:e] if k == 1 else re.sub(r"\D", "", text[s:e])
        shared = v.split("@")[-1] if k == 0 else tuple(v.split(".")[:2]) if k == 1 else v[: 6 if k == 2 else 4]
        out |= {(k, "value", v), (k, "group", shared)}
    return out


def wilson(hits, trials, z=1.96):
    if not trials:
        return 0.0
    p, q = hits / trials, z * z / trials
    return (p + q / 2 - z * math.sqrt(p * (1 - p) / trials + q / (4 * trials))) / (1 + q)


def brute_terms(rows, disclosure=0.9):
    """Base spans and further spans of each row, by the rule as stated, over sets of distinct texts."""
    words = re.compile(r"[^\W\d_]{2,}")
    texts = sorted({t or "" for _, t in rows})
    bases = {t: brute(t) for t in texts}
    free = {t: [m for m in words.finditer(t) if not any(m.start() < e and s < m.end() for _, s, e in bases[t])] for t in texts}
    holding = defaultdict(set)
    for t in texts:
        for name in names_of(t, bases[t]):
            holding[name].add(t)
    with_entity = {t for t in texts if bases[t]}
    copies = Counter(t or "" for _, t in rows)
    kinds = {}
    for term in {m[0].lower() for t in with_entity for m in free[t]}:
        near = {t for t in with_entity if any(m[0].lower() == term for m in free[t])}
        # Copies count once where an entity stands, which is where evidence comes from.
        held = sum(copies[t] for t in texts if any(w.lower() == term for w in words.findall(t))) - sum(copies[t] - 1 for t in near)
        for (k, level, v), there in holding.items():
            both, share = len(near & there), len(there) / len(texts)
            if both < 2 or share >= 1:
                continue
            bound = wilson(both - 1, held - 1)
            if bound >= 0.5 and math.log2(bound / share) >= -disclosure * math.log2(share):
                kinds[term] = 4 if level == "value" or kinds.get(term) == 4 else 5
    out = []
    for _, text in rows:
        text = text or ""
        out.append((bases[text], sorted((kinds[m[0].lower()], *m.span()) for m in free[text] if m[0].lower() in kinds)))
    return out, kinds


def planted(seed):
    """Rows with terms that always, mostly, once, or by chance stand with an entity or its group."""
    rng = random.Random(seed)
    common = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]
    rows = []
    for i in range(480):
        words = rng.choices(common, k=25)
        if i % 4 == 0:
            who = i % 3
            words[5:5] = ["Zelda", ["anna", "bert", "carl"][who], f"user{who}@ex{who}.org", "fitzgerald", f"only{chr(97 + i % 26)}{chr(97 + i // 26)}"]
        if i % 9 == 0:
            words[1:1] = ["dial", f"+49 30 12345{i:03d}"]
        if i % 10 == 1:
            words[1:1] = ["host", f"10.7.{i % 250}.1", "router"]
        if i % 30 == 2:
            words.insert(3, "anna")
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (902, "x@y.zz"), (903, rows[13][1])]
    return rows


def test_terms_match_brute_force(docs):
    for seed in (1, 2):
        rows = planted(seed)
        got = pii.detect(docs(rows, "base string, terms int")).collect()
        made = sorted(((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.terms]) for r in got), key=str)
        lines, kinds = brute_terms(rows)
        assert made == sorted(((doc, base, terms) for (doc, _), (base, terms) in zip(rows, lines)), key=str)
        assert {"bert", "carl"} <= {t for t, k in kinds.items() if k == 4}, kinds
        assert {"router", "dial"} <= {t for t, k in kinds.items() if k == 5}, kinds
        assert not any(t.startswith(("only", "word")) or t in ("zelda", "fitzgerald") for t in kinds), kinds


def test_query_counts_each_kind_by_itself(spark, docs, tmp_path):
    """Against the patterns, with duplicate rows, null ids and null texts."""
    rng = random.Random(7)
    given = [" ".join(FIXED[:5]), "a@b.co 1.2.3.4 c@d.ef", "1.2.3.4", "4242424242424242", "+4930123456789", None, "", "none"]
    given += [" ".join(rng.choices(["a@b.co", "1.2.3.4", "4242424242424242", "+49 30 1234567", "é😀"], k=rng.randint(0, 6))) for _ in range(60)]
    rows = [*enumerate(given), (0, given[0]), (0, given[1]), (None, given[1])]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        spans = brute(text or "")
        shown = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        want.append((doc, *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(shown.encode()).hexdigest()))
    found = queries.op4(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert [t for _, t in found.dtypes] == ["bigint"] * 5 + ["string"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_sanitised_rows(docs):
    rows = planted(1)
    names = "row int, _spans string, _row string, _clean int, own_row int, hit_row string, held_spans int, clean_text string, base int"
    given = docs(rows, names)
    clean = pii.sanitise(given)
    assert clean.schema == given.schema
    out = clean.collect()
    assert len(out) == len(rows) and not any("@" in (r.text or "") for r in out)
    assert {r.text for r in out if r.doc_id == 900} == {None}
    one = next(r.text for r in out if r.doc_id == 4).split()
    assert "[EMAIL]" in one and "bert" not in one and "Zelda" in one
    assert "[HINT]" in next(r.text for r in out if r.doc_id == 1)
    assert pii.detect(docs([])).count() == 0 and pii.sanitise(docs([])).count() == 0


def test_redaction_of_overlapping_spans():
    assert pii.redact("ab +1 2 cd", [(3, 3, 7), (2, 4, 8), (4, 0, 2)]) == " [PHONE]cd"


def test_one_joint_occurrence_and_copies_are_no_evidence(docs):
    rows = [f"common words stand here{' Zelda wrote from z@ex.org' if i == 7 else ''} and there" for i in range(40)]
    rows += [rows[7]] * 30
    assert not any(r.terms for r in pii.detect(docs(rows)).collect())


def test_few_words_go_from_documents_without_copies(spark, sf_dir):
    """Personal data of these documents stands among unrelated words, so hardly any may go."""
    large = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")
    docs = spark.read.parquet(f"{large}/documents.parquet").dropDuplicates(["text"]).cache()
    found = pii.detect(docs).where("size(base) > 0").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = sum(len(texts[r.doc_id].split()) for r in found)
    assert len(found) > 300 and sum(len(r.terms) for r in found) < words / 200


def test_terms_are_found_among_real_documents(spark, sf_dir):
    """A name that stands with an address is found wherever it is planted, and words around it stay."""
    large = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")
    docs = spark.read.parquet(f"{large}/documents.parquet").dropDuplicates(["text"])
    name = F.when(F.col("doc_id") % 500 == 3, F.lit(" Quillfeather q.f@planted.org")).when(F.col("doc_id") == 17, F.lit(" quillfeather"))
    given = docs.withColumn("text", F.concat("text", F.coalesce(name, F.lit("")))).cache()
    found = pii.detect(given).collect()
    planted_ids = {r.doc_id for r in given.where("text like '%Quillfeather%'").select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in given.collect()}
    hits = {(r.doc_id, texts[r.doc_id][s:e].lower()) for r in found for k, s, e in r.terms if k == 4}
    assert len(planted_ids) > 15 and {(i, "quillfeather") for i in planted_ids} | {(17, "quillfeather")} <= hits
    assert len({t for _, t in hits}) < 30


def test_terms_far_from_the_entity_and_without_it(docs):
    filler = " ".join(["common words stand here and there"] * 4)
    rows = [f"{filler} now Quill {filler} q@ex.org and {filler} quill {chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
    rows += [f"{filler} now quill"] + [f"{filler} now {chr(97 + i // 26)}{chr(97 + i % 26)}y" for i in range(239)]
    got = {r.doc_id: [rows[r.doc_id][s:e] for _, s, e in r.terms] for r in pii.detect(docs(rows)).collect()}
    assert got == {i: ["Quill", "quill"] if i < 60 else ["quill"] if i == 60 else [] for i in range(300)}
    assert "quill" not in "".join(r.text.lower() for r in pii.sanitise(docs(rows)).collect())

def shuffled(spark):
    """Bytes of each shuffle file that this session now has on disk."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_terms_cross_the_network_in_one_piece(spark, docs, monkeypatch):
    """Shuffles for documents with an entity each, but no terms that give it away, take little more disk than two copies of the texts."""
    rng = random.Random(11)
    common = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)]
    rows = [f"{' '.join(rng.sample(common, 300))} u@ex{i % 40}.org" for i in range(600)]
    given = docs(rows).cache()
    made, cut = {}, pii.cut

    def measured(df):
        """While the plan is held, so that none of its files is removed meanwhile."""
        before, out = shuffled(spark), cut(df)
        made.update({name: n for name, n in shuffled(spark).items() if name not in before})
        return out

    monkeypatch.setattr(pii, "cut", measured)
    # As at size, where no side of a join is small.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pii.detect(given).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == len(rows) and sum(made.values()) < 2.5 * sum(map(len, rows))


def test_entities_of_many_documents_are_counted_in_groups(docs, monkeypatch):
    """Into however many groups the documents of an entity are dealt, the same terms are found."""
    monkeypatch.setattr(pii, "BESIDE", 3)
    rows = planted(3)
    got = pii.detect(docs(rows)).collect()
    made = sorted(((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.terms]) for r in got), key=str)
    lines, kinds = brute_terms(rows)
    assert made == sorted(((doc, base, terms) for (doc, _), (base, terms) in zip(rows, lines)), key=str) and kinds
