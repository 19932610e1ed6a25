"""Registered queries, their SQL, and the pipeline's stages by brute force."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import language_id
from tests.llm.test_text_operators import DOCS, brute_repeats, components, corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with labels: documents 0 to 5 of ten copies hold a slur."""
    path = tmp_path_factory.mktemp("sf")
    rows = [r if r[0] is None or r[0] % 7 else (*r[:1], ("idiot " + (r[1] or "")), *r[2:]) for r in corpus()]
    rows = [(r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    extra = [(1000 + i, f"{w} plain text number {i} about the cat and the dog {'idiot' if bad else 'friend'}", "en", "s", 9) for i in range(60) for w, bad in [(f"word{i}", i % 3 == 0)]]
    spark.createDataFrame([*rows, *extra], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


def test_stages_in_turn(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_join", "substring_dedup", "best_fit_packing"]
    columns = docs.columns
    before = [tuple(r) for r in docs.collect()]
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "best_fit_packing":
            assert out.columns == columns
        rows = [tuple(r) for r in out.collect()]
        if name == "toxicity":
            assert not any("idiot" in (r[1] or "") for r in rows)
            assert len(rows) == sum("idiot" not in (r[1] or "") for r in before)
        if name == "language_id":
            table = spark.createDataFrame(before, docs.schema)
            scored = {(r.doc_id, r.text): r.bits_per_byte for r in language_id.predict(table, language_id.fit(table)).collect()}
            assert sorted(map(str, rows)) == sorted(str(r) for r in before if any(c.isalpha() for c in r[1] or "") and scored[r[0], r[1]] <= 8)
            assert len(rows) > 100
        if name == "ngram_join":
            firsts = {c for _, _, c in components(before, 5, 8, 10)}
            assert sorted(r[0] for r in rows if r[0] is not None) == sorted({r[0] for r in before if r[0] is not None} & firsts)
        if name == "substring_dedup":
            left = [w for w in brute_repeats(before, 50) if w[1] > w[2]]
            assert sorted((len((r[1] or "").encode().split())) for r in rows) == sorted(n - g for _, n, g, _ in left)
        if name == "best_fit_packing":
            assert out.groupBy().sum("piece_length").first()[0] == sum(len((r[1] or "").encode().split()) for r in before)
        kept = spark.createDataFrame(rows, out.schema)
        docs, before = kept, rows
    assert kept.count()


def test_near_duplicates_are_removed_by_row(spark):
    """Rows that share a null or repeated doc_id, but not a text, are decided on their own."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"}
    near = {c: f"{t} more" for c, t in text.items()}
    rows = [
        (1, text["a"]), (None, near["a"]), (None, text["b"]),  # a null copy of a named row, and a null row of its own
        (2, text["c"]), (5, near["c"]), (5, text["d"]),  # 5 is a copy of 2 and also a text of its own
        (None, text["e"]), (None, text["e"]), (None, near["e"]),  # copies without any name: one stays
        (7, text["f"]), (7, text["f"]), (7, near["f"]),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (None, "b"), (2, "c"), (5, "d"), (None, "e"), (7, "f")], key=str)


def test_run_is_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.count() > 0 and "bin_id" in got.columns


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op2_ngram_join", "op5_substring_dedup", "op11_divergence_audit", "op13_filter_audit"])
def test_sql_agrees(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{sf_dir}/{t}')")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, sf_dir).toPandas()[want.columns.tolist()]
    key = want.columns.tolist()
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))
