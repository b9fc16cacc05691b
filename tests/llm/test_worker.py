import gc

import pyarrow as pa
from helpers import frame

from siltstone.llm import token_files, toxicity


def test_a_task_drops_what_another_operator_kept(spark, monkeypatch):
    count = lambda: sum(type(x).__name__ == "WordEncoder" for x in gc.get_objects())
    gc.collect()
    before = count() - len(getattr(token_files, "_ready", {}))
    token_files.encoder(token_files.tokenizer_path())
    assert token_files.encoder(token_files.tokenizer_path()) is token_files.encoder(token_files.tokenizer_path())
    docs, tasks = frame(spark, [(1, "a b")]), []
    f = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a: tasks.append(run) or f(self, run, *a))
    toxicity.with_features(docs.select("doc_id", "text"), {})
    assert [x.num_rows for x in tasks[0](iter([pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "a b"}])]))] == [1]
    gc.collect()
    assert count() <= before


def test_token_files_are_read_without_further_workers(spark, tmp_path):
    docs = frame(spark, [(1, "a b"), (2, None), (3, "c")])
    token_files.write_tokens(token_files.token_rows(docs, [docs.doc_id], token_files.tokenizer_path()), str(tmp_path / "t"))
    got = token_files.read_tokens(spark, str(tmp_path / "t"))
    assert "ExistingRDD" not in got._jdf.queryExecution().sparkPlan().toString()  # rows from Python
    assert sorted(r.start for r in got.collect())[0] == 0 and got.count() == 3
