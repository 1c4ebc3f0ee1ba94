"""Operators that pass columns through take any names: case variants of their own, dots, digits, backticks."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, fingerprints, line_dedup, near_copies, packing, quality_rules, simhash, spelling
from millrace.llm.common import written

NAMES = ["Kept", "N_Lines", "N_Words", "Spans", "ROW", "Key", "col_0", "a.b", "0", "x`y", "Judged", "n_chars.x", "Component", "site", "Items"]
PROSE = [f"{w} said plainly that number {i} of the many reports was read in full by all of them, every word of it, on a quiet day in the house by the {w} river." for i, w in enumerate("green blue red white black".split())]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, p, "s") for i, p in enumerate(PROSE)] + [(7, None, None), (None, "", "s")]
    return spark.createDataFrame([(*r, *NAMES) for r in rows]).toDF("doc_id", "text", "source", *NAMES)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(PROSE[0].split()[:15]))], "item_id long, text string")


def quoted(name):
    return F.col("`" + name.replace("`", "``") + "`")


SAME = {
    "passed": lambda d, b: quality_rules.passed(d),
    "lines": lambda d, b: line_dedup.without_boilerplate(d),
    "lines, joined": lambda d, b: line_dedup.without_boilerplate(d, max_broadcast_lines=0),
    "near copies": lambda d, b: near_copies.keep_one(d),
    "decontaminated": lambda d, b: decontaminate.decontaminate(d, b),
    "decontaminated, joined": lambda d, b: decontaminate.decontaminate(d, b, max_table_bytes=0),
}
ADDED = {
    "clean": (lambda d, b: quality_rules.clean(d), quality_rules.ADDED, "text"),
    "dropped": (lambda d, b: line_dedup.drop_boilerplate(d), ["n_lines", "n_dropped"], "text"),
    "hits": (lambda d, b: decontaminate.hits(d, b), list(decontaminate.RESULT), None),
    "hits, joined": (lambda d, b: decontaminate.hits(d, b, max_table_bytes=0), list(decontaminate.RESULT), None),
}


@pytest.mark.parametrize("name", SAME)
def test_same_columns(spark, docs, bench, name):
    out = written(SAME[name](docs, bench), "columns")
    assert out.columns == docs.columns and out.count() > 1
    for n in NAMES:
        assert [r[0] for r in out.select(quoted(n)).distinct().collect()] == [n]
    assert SAME[name](docs.limit(0), bench).columns == docs.columns


@pytest.mark.parametrize("name", ADDED)
def test_added_columns(spark, docs, bench, name):
    run, added, text = ADDED[name]
    out = written(run(docs, bench), "columns")
    gone = {a.lower() for a in added}
    own = [c for c in docs.columns if c.lower() not in gone and (c != "text" or text)]
    assert out.columns == [*own, *added] and out.count() == docs.count()
    for n in (n for n in NAMES if n.lower() not in gone):
        assert [r[0] for r in out.select(quoted(n)).distinct().collect()] == [n]


def test_other_names_for_text_and_id(spark, bench):
    d = spark.createDataFrame([(1, PROSE[0], "x"), (2, PROSE[0], "x"), (3, PROSE[1], "x")], ["the.id", "body`s", "text"])
    kept = near_copies.keep_one(d, "the.id", "body`s")
    assert sorted(r[0] for r in kept.collect()) == [1, 3] and kept.columns == d.columns
    assert quality_rules.passed(d, "body`s").count() == 3
    left = decontaminate.decontaminate(d, bench, "body`s")
    assert left.columns == d.columns and left.count() < 3


def test_pipeline_stages(spark, small, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, small), name)
        assert now.columns == docs.columns, name
    assert now.count() == 5 and corpus_pipeline.STAGES[-1][1](spark, now, small).count() == 5


def test_operators_that_leave_other_columns_out(spark, docs):
    assert simhash.near_duplicates(docs).count() == 7
    assert fingerprints.compared(docs).count() == 7
    assert spelling.runs(docs).count() > 50
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count() >= 7


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """0 and 255 are apart; 15, whose row has no id, links both."""
    prints = spark.createDataFrame([(5, 0), (None, 15), (3, 255), (None, 1 << 40 | 1 << 50 | 0xABCDEF), (9, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: prints)
    got = sorted([(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(prints.withColumn("text", F.lit(""))).collect()], key=repr)
    assert got == sorted([(5, 0, 3), (None, 15, 3), (3, 255, 3), (None, 1 << 40 | 1 << 50 | 0xABCDEF, None), (9, -1, 9)], key=repr)
