"""The pipeline's stages take effect on all that they are given, and a missing package leaves the other queries alone."""

from __future__ import annotations

import subprocess
import sys

import corpus_pipeline
from conftest import ROOT, SMALL
from test_links import brute
from test_mixing import wanted, words


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumnRenamed("n_chars", "size")
    columns, seen = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        seen[name] = docs
        assert docs.columns[: len(columns)] == columns and (name == "tokens") == (len(docs.columns) > len(columns))
    counts = {name: df.count() for name, df in seen.items()}
    assert counts[""] > counts["quality"] > counts["toxicity"] > counts["near_copies"] > 0.5 * counts[""]
    before, after = ([(r.doc_id, r.text) for r in seen[n].collect()] for n in ("toxicity", "near_copies"))
    assert sorted(i for i, _ in after) == sorted(i for i, _, _, _, kept in brute(before).values() if kept)
    size: dict = {}
    for r in seen["near_copies"].collect():
        size[r.source] = size.get(r.source, 0) + words(r.text)
    taken = {s: sum(words(r.text) for r in seen["mixing"].filter(seen["mixing"].source == s).collect()) for s in size}
    assert abs(sum(taken.values()) - sum(wanted(size).values())) < 0.15 * sum(taken.values())
    assert counts["tokens"] == counts["mixing"] and seen["tokens"].filter("not lossless or n_tokens = 0").count() == 0


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_other_queries_without_the_package():
    code = "import sys\nsys.modules['eventlens.llm'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 150 and not [k for k in e.queries() if k.startswith('op1')]"
    code = code.replace("sys.modules['eventlens.llm'] = None", "import importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('eventlens.llm'):\n            raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, Gone())")
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
