import zlib

import corpus_pipeline as P
import numpy as np
from helpers import DOCS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import decontamination, minhash_dedup, mixing, token_files
from siltstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for i, (_, f) in enumerate(P.STAGES[:-1]):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == P.COLUMNS
        n.append(docs.count())
    assert n[0] > n[1] > n[2] > n[3] == n[4] > 0.3 * n[0]
    kept = spark.read.parquet(str(tmp_path / "2"))
    assert minhash_dedup.near_duplicates(kept).where("not kept").count() == 0
    assert decontamination.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    order = [r.doc_id for r in mixing.mix_sources(kept).orderBy("slot", "source", "offset", "doc_id").collect()]
    assert order == [r.doc_id for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    got = P.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert [r.doc_id for r in got] == order
    tok, texts, start = Tokenizer.from_file(token_files.tokenizer_path()), {r.doc_id: r.text for r in docs.collect()}, 0
    for r in got:
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.ids_crc32) == (start, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_near_duplicate_stage_keeps_one_row_and_rows_without_id(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1)] * 2 + [(2, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g", None, None, None), (3, None, None, None, None)]
    got = sorted((r.doc_id for r in P.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)), SF).collect()), key=str)
    assert got == [1, 3, None]


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
