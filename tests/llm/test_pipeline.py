import importlib

import pytest

import __spark_entry__ as entry_module
from opinara.llm import queries
from tests.llm import cases
from tests.llm.test_dedup import bits_of, groups, without_repeats
from tests.llm.test_scores import counted
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, key):
    ok, note, _ = compare(spark, connect(SF), SF, key, queries.QUERIES[key], queries.ORACLE_SQL[key])
    assert ok, note


def test_all_are_registered():
    names = entry_module.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names


def test_stages_against_brute_force(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mix", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    stages = dict(pipeline.STAGES)
    key = lambda rows: sorted(map(repr, rows))

    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    before, kept_rows = docs.collect(), kept.collect()
    failed = {r.doc_id for r in before if (c := counted(r.text))[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert not failed & {r.doc_id for r in kept_rows}
    assert len(kept_rows) >= 0.95 * (len(before) - len(failed))

    single = stages["simhash_near_dedup"](spark, docs, SF)
    roots = groups([bits_of(r.text) for r in before], 3)
    least = {}
    for r, g in zip(before, roots):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert single.columns == docs.columns
    assert key(single.collect()) == key(r for r, g in zip(before, roots) if r.doc_id == least[g])

    cut = stages["substring_dedup"](spark, docs, SF)
    assert cut.columns == docs.columns
    want = without_repeats([r.text for r in before])
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert got == {r.doc_id: (w[0], len(w[0])) if w[2] else (r.text, r.n_chars) for r, w in zip(before, want)}

    mixed = stages["source_mix"](spark, docs, SF)
    assert mixed.columns == docs.columns and all(r.n_chars == len(r.text) for r in mixed.collect())
    assert stages["packing"](spark, docs, SF).count() >= len(before)


def test_stages_stand_awkward_and_empty_tables(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    for docs in (cases.table(spark), cases.empty(spark)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


def test_run_applies_the_stages(spark):
    rows = importlib.import_module("corpus_pipeline").run(spark, SF)
    assert rows.count() > 0 and "sequence_id" in rows.columns
