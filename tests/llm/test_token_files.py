import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from helpers import edge_rows, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import token_files as T

ODD = ["Don't I'M it's, x.", "İstanbul ŁÓDŹ Straße.", "<|endoftext|> a<|startoftext|>.b", "a\x0bb\x1cc\x85d", "ΣΑΣ ①½ ﬁ", "é. naïve,, (ok)."]


def test_encoder_equals_the_library():
    tok = Tokenizer.from_file(T.tokenizer_path())
    enc = T.WordEncoder(T.tokenizer_path())
    texts = [*ODD, "", "plain words and more words.", None]
    ids, off = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library_on_random_texts(monkeypatch):
    monkeypatch.setattr(T, "CACHED_WORDS", 500)  # so that words are forgotten and learned again
    rng, tok, enc = random.Random(1), Tokenizer.from_file(T.tokenizer_path()), T.WordEncoder(T.tokenizer_path())
    bits = ["a", "B", "é", "É", "ß", "×", "÷", "İ", "Ł", "1", ".", ",", "'", "'s", "'T", " ", "\n", "\x1c", "\x85", "\u00a0", "<|endoftext|>", "<|", "e\u0301", "\u0301", "日", "ΣΑΣ", "ﬁ", "½", "-", "ŉ", "ſ", "’", "\u212a"]
    for _ in range(30):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(100)] + [None]
        ids, off = enc.encode(pa.array(texts), 7)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [[*tok.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_a_filter_on_doc_id_skips_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "ROW_GROUP", 1 << 16)
    path = str(tmp_path / "t")
    rng = random.Random(2)
    docs = frame(spark, [(i, " ".join(str(rng.random()) for _ in range(60))) for i in range(4000)])
    T.write_tokens(T.token_rows(docs, [F.col("doc_id")], T.tokenizer_path()).coalesce(1), path)
    (file,) = spark.read.parquet(path).inputFiles()
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    column = [i for i in range(meta.num_columns) if meta.schema.column(i).name == "doc_id"][0]
    holds = [g for g in range(meta.num_row_groups) for s in [meta.row_group(g).column(column).statistics] if s.min <= 1234 <= s.max]
    assert meta.num_row_groups > 4 and len(holds) == 1
    one = T.read_tokens(spark, path).where("doc_id = 1234")
    assert "EqualTo(doc_id,1234)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1


def test_round_trip(spark, tmp_path):
    rows = edge_rows("word " * 3000) + [(i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    docs = frame(spark, rows).withColumn("ids", F.lit(1)).withColumn("part", F.lit("clash"))
    path = str(tmp_path / "t")
    T.write_tokens(T.token_rows(docs, [F.col("doc_id")], T.tokenizer_path()), path)
    got = T.ids_checksum(T.read_tokens(spark, path)).orderBy("start").collect()
    tok, start = Tokenizer.from_file(T.tokenizer_path()), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    for r, row in zip(got, ordered):
        ids = [*tok.encode(row[1] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_are_encoded_and_indexed(spark, tmp_path):
    path = str(tmp_path / "t")
    T.write_tokens(T.token_rows(frame(spark, [(i, "a few words again and again") for i in range(50)]), [F.col("doc_id")], T.tokenizer_path()), path)
    meta = pq.ParquetFile(spark.read.parquet(path).inputFiles()[0].removeprefix("file://")).metadata
    ids = [meta.row_group(0).column(i) for i in range(meta.num_columns) if "ids" in meta.row_group(0).column(i).path_in_schema][0]
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
    assert ids.has_offset_index and ids.has_column_index
    plan = T.read_tokens(spark, path, ["doc_id", "n_tokens"])._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    T.write_tokens(T.token_rows(frame(spark, []), [F.col("doc_id")], T.tokenizer_path()), path)
    assert T.ids_checksum(T.read_tokens(spark, path)).count() == 0
