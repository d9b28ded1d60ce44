"""The corpus pipeline's stages."""

from __future__ import annotations

import corpus_pipeline
from paneloom.llm.common import staged, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= before and docs.count() == len(kept)
        if name == "classifier":
            gone = [labels[i] for i in before - kept if i in labels]
            assert gone and sum(gone) <= 0.02 * len(labels)
        sizes.append(len(kept))
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
