from pyspark.sql import types as T

import corpus_pipeline
from tablerecon.llm import decontaminate, jaccard_join, pii


def test_stages(spark, sf_dir):
    """Each stage's decisions are those of its operator, on what it is given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    done = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == columns, name
        done.append((docs, after))
        docs = after
    ids = [({r.doc_id for r in a.collect()}, {r.doc_id for r in b.collect()}) for a, b in done]
    assert all(b <= a for a, b in ids) and ids[3][0] == ids[3][1]
    groups = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(done[1][0], width=5, percent=80).collect()}
    assert ids[1][1] == set(groups.values())
    hits = decontaminate.decontaminate(done[2][0], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    assert ids[2][0] - ids[2][1] == {r.doc_id for r in hits.collect()}
    before = {r.doc_id: r.text for r in done[3][0].collect()}
    for r in done[3][1].collect():
        spans = pii.base_spans(before[r.doc_id])
        assert (r.text == before[r.doc_id]) or spans
        assert r.n_chars == len(r.text) and not any(before[r.doc_id][s:e] in r.text for k, s, e in spans if k == 0)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = [labels[i] for i in ids[0][1] if i in labels]
    assert sum(kept) / len(kept) > 0.94  # of few labels
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[3][1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", row int, _spans string, _kept int, _n_hit int, _quality double, key long, h long, label long, found_n_hit int, row_mark string, component long, mark string, picked long, quality_score string, held_spans int"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def texts_of(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.lang or "") for r in frame.collect())


def rows_of(spark, rows, more=""):
    width = len(T.StructType.fromDDL(SCHEMA + more)) - 3
    return spark.createDataFrame([(i, t, lang, *[None] * width) for i, t, lang in rows], SCHEMA + more)


LONG = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
EDGES = [(1, LONG, "a"), (1, OTHER, "a"), (2, LONG + " end", "a"), (None, OTHER, "b"), (None, None, "c"), (3, "", "d"), (3, "", "d"), (4, " \n", "e"), (5, "A@b.co " * 3000, "f"), (5, "A@b.co " * 3000, "f")]


def test_one_row_of_a_group_of_texts_stays(spark, sf_dir):
    near = stage("near duplicates")
    kept = near(spark, rows_of(spark, EDGES, CLASHING), sf_dir)
    assert kept.columns == rows_of(spark, [], CLASHING).columns
    assert texts_of(kept) == texts_of(rows_of(spark, [EDGES[i] for i in (0, 1, 4, 5, 6, 7, 8)]))
    # Null ids come last, equal rows count as one, whatever their number.
    rows = [(None, LONG, "x")] * 3 + [(None, OTHER, "y"), (9, OTHER + " end", "z"), (9, OTHER + " end", "zz")]
    found = texts_of(near(spark, rows_of(spark, rows), sf_dir))
    assert len(found) == 2 and found[0][1:3] == (9, OTHER + " end") and found[1] == (True, 0, LONG, "x")


def test_stages_on_edge_cases(spark, sf_dir):
    for name, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, rows_of(spark, []), sf_dir).count() == 0, name
        given = rows_of(spark, EDGES, CLASHING)
        after = run(spark, given, sf_dir)
        assert after.columns == given.columns, name
        left = texts_of(after)
        if name in ("decontamination", "personal data"):
            assert len(left) == len(EDGES)
            for one in {e[1] for e in EDGES}:
                assert len({r[2] for r in left if r[2] == (one or "")}) <= 1
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = rows_of(spark, [*EDGES, (7, f"before {item.upper()} after", "x"), (7, "clean", "x")], CLASHING)
    assert texts_of(stage("decontamination")(spark, rows, sf_dir)) == texts_of(rows_of(spark, [*EDGES, (7, "clean", "x")]))
    clean = stage("personal data")(spark, rows_of(spark, EDGES, CLASHING), sf_dir).collect()
    assert all((r.n_chars is None and r.text is None) or r.n_chars == len(r.text) for r in clean)
    assert {r.text for r in clean if r.doc_id == 5} == {"[EMAIL] " * 3000}
    packed = stage("packing")
    assert packed(spark, rows_of(spark, []), sf_dir).count() == 0
    ends = packed(spark, rows_of(spark, EDGES, CLASHING), sf_dir).where("start + length = doc_tokens").count()
    assert ends == len(EDGES)
