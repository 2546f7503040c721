import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from fixtures import document_rows, documents, sentence
from test_decontamination import slow as slow_contamination
from test_line_dedup import slow as slow_lines
from test_packing import TOKENIZER, check
from test_simhash import slow_components, slow_fingerprint

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near dedup", "benchmark decontamination", "packing"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage reads and returns on the given tables."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "stage")
        out.append((before, [r.asDict() for r in docs.collect()], docs.columns))
    return out


def test_quality_keeps_good_documents(spark, stages):
    before, after, columns = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    share = [np.mean([k in kept for k, q in labels.items() if q == v]) for v in (0, 1)]
    assert columns == COLUMNS and share[1] > 0.97 and share[0] < 0.15


def test_lines_match_brute_force(stages):
    before, after, columns = stages[1]
    want = {k: text for k, text, _, _ in slow_lines([(r[0], r[1], r[3]) for r in before], 0.05, 5)}
    assert columns == COLUMNS and {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after) and any(len(r["text"]) < len(b[1]) for r, b in zip(sorted(after, key=lambda r: r["doc_id"]), sorted(before)))


def test_one_document_of_each_group_stays(stages):
    before, after, columns = stages[2]
    keyed = [(r[0], slow_fingerprint(r[1])) for r in before]
    want = {c for c in slow_components(keyed)}
    assert columns == COLUMNS and sorted(r["doc_id"] for r in after) == sorted(want) and len(after) < len(before)


def test_contaminated_documents_go(spark, stages):
    before, after, columns = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {k for k, _, n_hit, _ in slow_contamination(before, items) if not n_hit}
    assert columns == COLUMNS and sorted(r["doc_id"] for r in after) == sorted(clean) and len(after) < len(before)


def test_packs_what_is_left(spark, stages):
    before, after, _ = stages[4]
    padding = check(before, after, lambda t: TOKENIZER.encode(t or "", add_special_tokens=False).ids)
    assert padding < 0.01


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, blanks, repeated rows and extra columns go through; extra columns come out as they were."""
    rows = document_rows()
    bench = str(tmp_path)
    spark.createDataFrame([(1, " ".join((rows[10][1]).split()[:12])), (2, None)], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")
    docs = documents(spark, rows).withColumnsRenamed({"score": "n_lines", "kept": "quality", "words": "host"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, bench), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "quality", "host"]
        assert docs.where("n_lines is not null and n_lines <> 0.5").count() == 0 and docs.count() > 20
    ids = [r["doc_id"] for r in docs.collect()]
    assert 10 not in ids and len(ids) == len(set(ids))
    packed = corpus_pipeline.packing_stage(spark, docs, bench)
    assert {r["doc_id"] for r in packed.collect()} == set(ids)
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, bench).count() == 0


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() == len(stages[4][1]) and set(got.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert public_tokenizers.path(corpus_pipeline.VOCABULARY)


def test_columns_of_the_stages_own_names_come_out_unchanged(spark, tmp_path):
    rows = document_rows()
    spark.createDataFrame([(1, " ".join((rows[10][1]).split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, rows).withColumnsRenamed({"score": "__row", "kept": "__name", "words": "doc"}).withColumn("key", docs_note())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__row", "__name", "doc", "key"]
        assert docs.where("doc_id IS NOT NULL AND (__row <> 0.5 OR NOT __name OR doc <> 'w' OR key <> 'mine')").count() == 0 and docs.count() > 20


def docs_note():
    from pyspark.sql import functions as F
    return F.lit("mine")


def test_near_duplicates_of_a_stage_are_joined_without_broadcasts(spark, monkeypatch):
    from tabwright.llm import simhash

    plans, link = [], simhash.linked_pairs

    def seen(classes, max_bits):
        out = link(classes, max_bits)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "linked_pairs", seen)
    rows = [(1, "one two three four five"), (2, "one two three four five"), (3, "six seven eight nine ten eleven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.duplicate_stage(spark, docs, "").collect()) == [1, 3]
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
