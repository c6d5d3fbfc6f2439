"""The pipeline against brute-force versions of its stages."""

import corpus_pipeline
from tests.llm.test_operators import LONG, brute_components
from tidewire.llm.common import keep


def test_stages(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(1, base), (2, base), (3, base + " more"), (4, None), (5, "12 34 !"), (6, "other text of its own here"), (7, LONG), (8, "other text of its own here"), (8, "other text of its own here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = sorted(r.doc_id for r in docs.collect())
    assert seen["language"] == [1, 2, 3, 6, 7, 8, 8]
    assert seen["exact_dedup"] == [2, 3, 7, 8]
    label = brute_components([(i, t) for i, t in dict((i, t) for i, t in rows).items() if i in seen["exact_dedup"]], 5, 80)
    assert seen["near_dedup"] == sorted(i for i, (_, c) in label.items() if i == c)
    assert set(seen["mixing"]) == set(seen["near_dedup"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(seen["mixing"]) and all(r.round_trip for r in out)


def test_clashing_names_and_hard_rows(spark, tmp_path):
    """Extra columns of any name pass every stage untouched; null ids, null texts, repeats and empty tables have their results."""
    extra = ["_id", "_sha", "_lang", "_score", "_copies", "_each", "_dup", "_one", "kept", "kept_", "_t", "sample", "n"]
    texts = [(1, "some words of a text here"), (2, "some words of a text here"), (2, "some words of a text here"), (None, "some words of a text here"), (None, "a text of no id"), (3, None), (4, ""), (5, LONG)]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(texts)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in extra)
    made = spark.createDataFrame(rows, kind)
    spark.createDataFrame([(5, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = {r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = keep(stage(spark, made, str(tmp_path)))
        assert got.columns == made.columns and {tuple(r)[5:] for r in got.collect()} <= own, name
        ids = sorted(str(r.doc_id) for r in got.collect())
        if name == "language":
            assert ids == ["1", "2", "2", "5", "None", "None"]
        if name == "exact_dedup":
            assert ids == ["2", "4", "5", "None"]  # the empty text of 3 and 4 stays once
        if name == "near_dedup":
            assert ids == ["1", "3", "4", "5", "None", "None"]
        if name == "mixing":
            assert set(ids) == {"1", "2", "3", "4", "5", "None"} and len(ids) >= 8
        assert stage(spark, made.where("doc_id = 99"), str(tmp_path)).count() == 0
    assert corpus_pipeline.pieces(spark, made.where("doc_id = 99"), str(tmp_path)).count() == 0
    assert corpus_pipeline.pieces(spark, made, str(tmp_path)).where("not round_trip").count() == 0
