"""Corpus queries against their SQL, and the whole pipeline against brute force, on the small tables."""

from __future__ import annotations

import pytest

from tessera.llm import registry
from tests.conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SMALL).toPandas()
    assert len(found) == duck.execute(f"select count(*) from {'pages' if name.startswith('op8') else 'documents'}").fetchone()[0]
    if name in registry.ORACLES:
        same(found, duck.execute(registry.ORACLES[name]).df())


def test_pipeline(spark, duck):
    import corpus_pipeline
    from tests.llm import brute

    docs = duck.execute("select doc_id, text from documents").fetchall()
    kept = {r[0] for r in duck.execute(f"select doc_id from ({registry.ORACLES['op10_quality_rules']}) where kept").fetchall()}
    left = [d for d in docs if d[0] in kept]
    groups = brute.components(left)
    left = {d for d, t in left if groups[d, t][1] == d}
    clean = {r[0] for r in duck.execute(f"select doc_id from ({registry.ORACLES['op6_decontaminate']}) where not contaminated").fetchall()}
    left &= clean
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in found} <= left
    good = {r[0] for r in duck.execute("select doc_id from labels where quality = 1 and toxic = 0").fetchall()}
    assert len(good & left - {r["doc_id"] for r in found}) <= 1
    assert sorted(r["start"] for r in found)[0] == 0 and sum(r["n_tokens"] for r in found) == max(r["start"] + r["n_tokens"] for r in found)
