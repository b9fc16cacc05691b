"""Token-ID output: Parquet files of token lists, written in document order and read selectively.

A file set is a folder of Parquet files. Row: doc_id, ids (list of int), n_tokens (int), at (long: ids of the same file
part before the row), part (int: place of the part in the order). Ids are dictionary encoded and fall back to delta
packing (Parquet format 2), row groups and pages have fixed sizes, and each page has its entry in the column and offset
index, so that a reader of doc_id or n_tokens touches no id page, and a filter on doc_id skips row groups and pages.
"""

from __future__ import annotations

import codecs
import os
import zlib
from collections.abc import Iterator
from itertools import compress
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fresh_path
from .tokens import _IS_WHITE, slices, span_hashes, spans, text_buffer
from .worker import kept, task

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words whose ids a Python worker keeps; beyond it the half that was used last stays, so its memory is bounded.
CACHED_WORDS = 500_000
#: Bytes of a row group and of a page in memory.
ROW_GROUP = 32 << 20
PAGE = 1 << 20
#: Bytes of text that are encoded together.
ENCODED_AT_ONCE = 2 << 20
#: Letters below this one are lower-cased alike by Python and by the tokenizer.
LATIN_END = "\u0180"
#: The one letter below LATIN_END that becomes two.
DOTTED = "\u0130"

_IS_ALNUM = np.array([i < 0x80 and chr(i).isalnum() for i in range(256)])


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; what it has learned of words serves later tasks of these files too."""
    return kept("token_files", path, lambda: WordEncoder(path))


class WordEncoder:
    """Ids of texts by a tokenizer whose pieces never cross white space and whose model knows no context beyond a piece.

    Texts are cut at ASCII white space, and a full stop or comma is cut off behind a letter or digit, where the tokenizer
    always cuts; the ids of a text are those of its parts in turn. Parts are found by their hashes, straight in the Arrow
    bytes, among those that the library has encoded before. New ones go to it: lower-case Latin letters many at a time to
    its model, in the byte alphabet that the pre-tokenizer would use; any other part takes the whole way alone.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        byte_level, alphabet = ByteLevel(add_prefix_space=False, use_regex=False), list(map(chr, range(256)))
        for c in map(chr, range(0x80, ord(LATIN_END))):
            for b, x in zip(c.encode(), byte_level.pre_tokenize_str(c)[0][0]):
                alphabet[b] = x
        self.alphabet = "".join(alphabet)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        #: Ids that end a word; without such a mark words are encoded one by one.
        self.last = np.array([bool(suffix) and x.endswith(suffix) for x in names])
        self.stops = [np.array(self._part(c), np.int32) for c in ".,"]
        self.hash = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.turn = 0

    def _part(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def _new(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each part's begin and how many it has."""
        easy = [p.isalpha() and (p.isascii() or (max(p) < LATIN_END and DOTTED not in p and is_normalized("NFC", p))) for p in parts]
        first, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        got, hard = np.zeros(0, np.int32), range(len(parts))
        if self.last.any() and any(easy):
            low = " ".join(compress(parts, easy)).lower().encode()
            ids = np.array(self.model.encode_batch_fast([codecs.charmap_decode(low, "strict", self.alphabet)[0]], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            mine = np.flatnonzero(easy)
            if len(ends) == len(mine):
                first[mine] = np.concatenate(([0], ends[:-1]))
                size[mine] = ends - first[mine]
                got, hard = ids, np.flatnonzero(~np.array(easy)).tolist()
        rest, n = [got], len(got)
        for i in hard:
            x = self._part(parts[i])
            first[i], size[i], n = n, len(x), n + len(x)
            rest.append(np.array(x, np.int32))
        return np.concatenate(rest), first, size

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        """Add parts with rising hashes."""
        whole = raw.tobytes()
        ids, first, size = self._new([whole[s:e].decode("utf-8", "surrogatepass") for s, e in zip(start.tolist(), end.tolist())])
        if len(self.hash) + len(h) > CACHED_WORDS:  # the half that was used last stays
            keep = np.flatnonzero(self.used >= np.sort(self.used)[len(self.used) // 2]) if len(self.used) else np.zeros(0, np.int64)
            keep = keep[np.argsort(-self.used[keep], kind="stable")[: CACHED_WORDS // 2]]
            keep.sort()
            self.ids = self.ids[ranges(self.first[keep], self.size[keep])]
            self.hash, self.check, self.used, self.size = self.hash[keep], self.check[keep], self.used[keep], self.size[keep]
            self.first = np.cumsum(self.size) - self.size
        at = np.searchsorted(self.hash, h)
        first += len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.hash, self.check, self.first, self.size = (np.insert(old, at, new) for old, new in ((self.hash, h), (self.check, check), (self.first, first), (self.size, size)))
        self.used = np.insert(self.used, at, self.turn)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n+1 offsets of the texts; ``end_id`` follows each text. Null texts are empty."""
        raw, offsets = text_buffer(texts)
        n = len(texts)
        self.turn += 1
        if len(raw):
            start, end = spans(_IS_WHITE[raw], offsets)
        else:
            start = end = np.zeros(0, np.int64)
        h, size, first, stop = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(start):
            final = raw[end - 1]
            before, lead = raw[np.maximum(end - 2, start)], raw[np.maximum(end - 3, start)]
            letter = _IS_ALNUM[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (end - start > 2))
            stop = np.where(letter & (end - start > 1), (final == 0x2E) + 2 * (final == 0x2C), 0)
            body = end - (stop > 0)
            h = span_hashes(raw, start, body)
            total = np.concatenate(([0], np.cumsum(raw, dtype=np.int64)))
            check = (total[body] - total[start]) * 4096 + np.minimum(body - start, 4095)
            distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
            if (check[where][inverse] != check).any():
                raise ArithmeticError("two words have one hash")  # never seen; a wrong id would go unnoticed
            for _ in range(2):
                k = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
                known = self.hash[k] == distinct if len(self.hash) else np.zeros(len(distinct), bool)
                self.used[k[known]] = self.turn
                new = np.flatnonzero(~known)
                if not len(new):
                    break
                self._learn(raw, start[where[new]], body[where[new]], distinct[new], check[where[new]])
            if (self.check[k] != check[where]).any():
                raise ArithmeticError("two words have one hash")
            size, first = self.size[k][inverse], self.first[k][inverse]
        # a part's ids, then its full stop's or comma's; a text's end id after its last part
        tail = np.array([0, len(self.stops[0]), len(self.stops[1])])[stop]
        table = np.concatenate([self.ids, *self.stops, np.array([] if end_id is None else [end_id], np.int32)])
        at = np.searchsorted(start, offsets)
        ends = np.zeros((n,), np.int64) + (end_id is not None)
        piece_first = np.empty(2 * len(start), np.int64)
        piece_size = np.empty(2 * len(start), np.int64)
        piece_first[0::2], piece_size[0::2] = first, size
        piece_first[1::2] = np.array([0, len(self.ids), len(self.ids) + len(self.stops[0])])[stop]
        piece_size[1::2] = tail
        slot = 2 * at[1:]
        piece_first = np.insert(piece_first, slot, len(table) - 1)
        piece_size = np.insert(piece_size, slot, ends)
        out = table[ranges(piece_first, piece_size)]
        count = np.concatenate(([0], np.cumsum(piece_size)))
        return out, np.concatenate(([0], count[slot + np.arange(1, n + 1)])).astype(np.int64)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] places, then those of first[1], and so on."""
    done = np.cumsum(size)
    return np.arange(int(done[-1]) if len(done) else 0) + np.repeat(first - (done - size), size)


def token_rows(docs: DataFrame, order: list, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Documents in the stated order as rows of the file format; parts are ranges of that order.

    Null texts are empty and have the end id alone. Ties in the order are broken by doc_id and text; rows that are equal
    throughout are interchangeable. Null doc_ids come first.
    """
    names = [f"_o{i}" for i in range(len(order))]
    ranged = docs.select(*(o.alias(n) for o, n in zip(order, names)), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = [*names, "doc_id"]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    @task("token_files")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = encoder(tokenizer_path), 0
        for batch in batches:
            for x in slices(batch, "text", ENCODED_AT_ONCE):
                ids, offsets = own.encode(x.column("text"), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [x.column("part"), x.column("doc_id"), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets).astype(np.int32)), lists],
                    names=["part", "doc_id", "at", "n_tokens", "ids"],
                )
                at += int(offsets[-1])

    return ranged.mapInArrow(run, "part int, doc_id long, at long, n_tokens int, ids array<int>")


def write_tokens(rows: DataFrame, path: str) -> None:
    """Write rows of ``token_rows`` as a file set: dictionary or delta pages, bounded row groups, page indexes."""
    rows.write.options(
        **{
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "true",
            "parquet.block.size": str(ROW_GROUP),
            "parquet.page.size": str(PAGE),
            "parquet.page.row.count.limit": "2000",
            "compression": "zstd",
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The file set at ``path`` with ``start``, the ids of all documents before a row's; only the columns asked for are read.

    The parts' totals are summed over metadata columns; there is one row for each written part, so the running total over
    them is bounded by the number of write tasks.
    """
    schema = "part int, doc_id long, at long, n_tokens int, ids array<int>"
    rows = spark.read.schema(schema).parquet(path)
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, parts = 0, []
    for part, n in totals:
        parts.append((part, before))
        before += n
    table = pa.table([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int64())], names=["part", "before"])
    offsets = F.broadcast(spark.createDataFrame(table))  # from Arrow: rows would start further Python workers
    out = rows.join(offsets, "part").withColumn("start", F.col("before") + F.col("at"))
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def ids_checksum(df: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that ``read_tokens`` returns."""

    @task("token_files")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64)
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[s:e].data) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("start"), x.column("n_tokens").cast(pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(token_rows(documents(spark, sf_dir), [F.col("doc_id")], tokenizer_path()), path)
    return ids_checksum(read_tokens(spark, path))
