import hashlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import line_dedup
from tests.llm import test_decontamination, test_ngram_join, test_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's documents, written and read again: the input first."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{k}")
        docs.append(spark.read.parquet(f"{folder}/{k}"))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.schema == stages[0].schema and all(r.n_chars == len(r.text) for r in df.collect())


def test_rejected_documents_go(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert 0 < len(after) <= len(before) and all(before[i] == t for i, t in after.items())
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic}
    assert len(toxic & set(after)) <= 0.5 * len(toxic & set(before))


def test_repeated_lines_go(stages):
    with duckdb.connect() as db:
        documents = stages[1].toPandas()  # noqa: F841
        want = {r[0]: r[2:] for r in db.execute(line_dedup.SQL).fetchall()}
    after = texts(stages[2])
    for i, (removed, digest) in want.items():
        if i in after:
            assert hashlib.sha256(after[i].encode()).hexdigest() == digest
        else:
            assert removed


def test_one_document_of_each_class_stays(stages):
    rows = list(texts(stages[2]).items())
    want = {i for i, _, component in test_ngram_join.brute(rows) if i == component}
    assert set(texts(stages[3])) == want


def test_benchmark_passages_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    for i, n_words, n_hit, *_ in test_decontamination.brute(list(before.items()), items):
        if not n_hit:
            assert after[i] == before[i]
        elif 2 * n_hit > n_words:
            assert i not in after
        else:
            assert len(after[i]) < len(before[i])


def test_packed_ids(stages):
    want = sorted((str(i), x.tobytes()) for i, x in test_packing.expected(list(texts(stages[4]).items())))
    whole = {}
    for p in sorted(stages[5].collect(), key=lambda p: (p.sequence_id, p.offset)):
        whole.setdefault(p.doc_id, []).append(bytes(p.ids))
    assert sorted((str(i), b"".join(x)) for i, x in whole.items()) == want
    assert np.unique([(p.sequence_id, p.offset) for p in stages[5].collect()], axis=0).shape[0] == stages[5].count()


def test_copies_leave_no_stub(spark):
    long = "a line that is long enough to count"
    rows = [(1, f"Title\n{long}\n\nEnd"), (2, f"Title\n{long}\n\nEnd"), (3, f"Other\n{long}\nEnd"), (4, "Title\nEnd"), (5, f"{long}\nMore\nMore"), (6, long), (None, f"End\n{long}")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    assert texts(corpus_pipeline.drop_repeated_lines(spark, docs, SF)) == {1: rows[0][1], 3: "Other\nEnd", 4: "Title\nEnd", 5: "More\nMore"}


def test_copies_of_texts_are_written_small(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = docs.filter("doc_id < 40")
    written, cut = [], corpus_pipeline.cut_lineage
    monkeypatch.setattr(corpus_pipeline, "cut_lineage", lambda *a: written.append(cut(*a)) or written[-1])
    corpus_pipeline.drop_repeated_lines(spark, small, SF).count()
    assert written and all(f.endswith(".zstd.parquet") for f in written[0].inputFiles())


def test_learning_sends_few_texts_at_once(spark, monkeypatch):
    sizes, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    fit = corpus_pipeline.toxicity.fit
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *a: sizes.append(spark.conf.get(key)) or fit(*a))
    corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(50), SF)
    assert sizes == [str(corpus_pipeline.BATCH_ROWS)] and spark.conf.get(key) == before
