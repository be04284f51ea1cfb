import pathlib

import corpus_pipeline
from factorweave.llm import decontaminate, jaccard

SF = "/root/testdata/sf0.001"


def test_pipeline_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = spark.createDataFrame(stage(spark, kept, SF).toPandas())
        names.append(name)
        if name == "ngram_jaccard":
            assert jaccard.jaccard_components(kept).where("doc_id <> component_id").count() == 0
        if name == "decontamination":
            assert decontaminate.contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        if name == "sharding":
            assert kept.count() == before.count()
        else:
            assert kept.columns == docs.columns
    assert len(names) == 5


def test_no_other_module_imports_the_subpackage():
    root = pathlib.Path(corpus_pipeline.__file__).parent / "factorweave"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
