import numpy as np
from fixtures import document_rows, documents

from tabwright.llm import quality_model, toxicity


def sizes_of_fits(monkeypatch, module):
    seen, fit = [], module.fit_linear

    def spy(index, value, row, target, *args, **kwargs):
        seen.append(len(target))
        return fit(index, value, row, target, *args, **kwargs)

    monkeypatch.setattr(module, "fit_linear", spy)
    return seen


def crowded():
    rows = document_rows()
    nulls = [(None, None, "en", "s", 0, 0.0, True, "")] * 3000
    return rows + nulls + [(10_000 + i, *rows[1][1:]) for i in range(3000)]


def test_quality_sample_holds_each_text_once(spark, monkeypatch):
    seen = sizes_of_fits(monkeypatch, quality_model)
    rows = crowded()
    got = quality_model.classify_quality(documents(spark, rows), train_rows=20_000).collect()
    assert seen == [len({r[1] for r in rows} - {None})] and len(got) == len(rows)
    assert np.mean([r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60]) > 0.95


def test_toxicity_sample_holds_equal_rows_once(spark, monkeypatch):
    seen = sizes_of_fits(monkeypatch, toxicity)
    rows = document_rows() + [(None, None, "en", "s", 0, 0.0, True, "")] * 3000
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    scored, _ = toxicity.score_toxicity(documents(spark, rows), labels)
    assert scored.count() == len(rows) and seen[0] <= len(document_rows())
