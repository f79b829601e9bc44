"""Registered queries on the given tables, and the pipeline on planted cases."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline
from waveline.llm import catalog
from waveline.sources.store import stored

SF = "/root/testdata/sf0.001"
NAMES = [f"op{n}_" for n in range(1, 14)]

catalog.load()


def rows_of(table):
    columns = sorted(table.column_names)
    return sorted(map(str, ({c: r[c] for c in columns} for r in table.to_pylist())))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    found = catalog.QUERIES[name](spark, SF).toArrow()
    assert found.num_rows
    if name not in catalog.ORACLES:
        return
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as duck:
        for file in Path(SF).glob("*.parquet"):
            duck.execute(f"create view {file.stem} as select * from '{file}'")
        theirs = duck.execute(catalog.ORACLES[name]).to_arrow_table()
    assert rows_of(found) == rows_of(theirs)


def test_every_operator_has_one_query():
    assert [sum(q.startswith(n) for q in catalog.QUERIES) for n in NAMES] == [1] * 13


def test_pipeline_on_planted_cases(spark, tmp_path):
    rng = random.Random(12)

    def prose(n):
        return " ".join("".join(rng.choice(["the", "tion", "er", "ing", "an", "wh"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."

    passage, item = prose(60), prose(30)
    texts = {i: prose(80) for i in range(30)}
    texts[30] = texts[3]  # an exact copy
    texts[31] = prose(50) + "\n" + passage
    texts[32] = prose(70) + "\n" + passage
    texts[33] = prose(40) + " " + item + " " + prose(40)
    texts[34] = "123 456"
    texts[35] = None
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "xx", "s", len(t or ""), i) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long, fp int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)))
        seen.append({r.doc_id: r for r in now.collect()})
    named, single, cut, clean, coded = seen
    assert set(named) == set(range(34))
    assert set(single) == set(named) - {30}
    assert passage in cut[31].text
    assert passage not in cut[32].text
    assert cut[0].text == texts[0]
    assert set(clean) == set(cut) - {33}
    assert all(coded[i].text == clean[i].text for i in clean)
    assert clean[0].asDict().keys() == set(docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(coded)
