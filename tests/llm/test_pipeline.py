"""The stages on the smallest tables: what each keeps follows from its operator on its own input."""

import corpus_pipeline
from spanloom.llm import exact_dedup, near_dedup, quality
from spanloom.llm.queries import table

SF = "/root/testdata/sf0.001"


def ids(df, condition="true"):
    return sorted(r.doc_id for r in df.filter(condition).collect())


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "near dedup", "secret scan", "packing"]
    graded = stages["quality classifier"](spark, docs, SF)
    assert graded.columns == docs.columns
    assert ids(graded) == ids(quality.grade_documents(docs, table(spark, SF, "labels")), "kept")
    first = stages["exact dedup"](spark, graded, SF)
    assert ids(first) == ids(exact_dedup.dedup_map(graded), "kept")
    one = stages["near dedup"](spark, first, SF)
    assert ids(one) == ids(near_dedup.near_duplicates(first), "kept")
    clean = stages["secret scan"](spark, one, SF)
    assert clean.columns == docs.columns and ids(clean) == ids(one)
    packed = stages["packing"](spark, clean, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids(clean))
