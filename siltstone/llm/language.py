"""Language ID by compression: the language whose raw-content dictionary lets zstandard write a text in the fewest bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, documents

#: The dictionary of a language is fit on at most so many labelled texts, the smallest by a hash of doc_id.
SAMPLED_TEXTS = 200
#: Bytes of a dictionary and the most that one text gives to it.
DICTIONARY_BYTES = 96 << 10
SLICE_BYTES = 1 << 10
LEVEL = 6
#: What stands between letters; it is one space in texts and dictionaries, so that tables and noise weigh little.
_BETWEEN = re.compile(r"[\W\d_]+")
#: A prediction whose relative gain over the second language is below this is rejected.
MIN_MARGIN = 0.02
UNKNOWN = "und"
#: Bytes saved by the best language, for each unit of the score's logit.
BYTES_PER_LOGIT = 8.0


def letters(text: str) -> bytes:
    """Lower-cased words of letters with a space between."""
    return _BETWEEN.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def learn_dictionaries(rows: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, bytes]:
    """Per-language raw-content dictionaries from a bounded sample of labelled rows.

    Rows with a null language or an empty text are not learned from. Every language is learned, however rare; what a worker
    holds is DICTIONARY_BYTES for each. The sample is chosen from key and language alone, so
    texts are read for its rows only; a language with a third of all rows is cut down before the shuffle.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    labelled = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    order = Window.partitionBy("_lang").orderBy("_h", "_key")
    keys = labelled.select(F.col(lang).alias("_lang"), F.col(key).alias("_key"), F.xxhash64(key).alias("_h"))
    chosen = keys.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLED_TEXTS).select("_key").distinct()
    picked = labelled.join(F.broadcast(chosen), labelled[key].eqNullSafe(chosen["_key"]))
    n = F.length(text)
    at = F.pmod(F.xxhash64(key, F.lit(7)), F.greatest(n - SLICE_BYTES, F.lit(1))).cast("int") + 1
    got = (
        picked.select(F.col(lang).alias("lang"), F.xxhash64(key).alias("h"), F.col(text).substr(at, F.lit(SLICE_BYTES)).alias("t"))
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t")))
        .where(F.col("r") <= SAMPLED_TEXTS).collect()
    )
    out: dict[str, bytes] = {}
    for r in sorted(got, key=lambda r: (r.lang, -r.r)):  # the first of the sample come last, where offsets are short
        out[r.lang] = out.get(r.lang, b"") + letters(r.t) + b"\n"
    return {k: v[-DICTIONARY_BYTES:] for k, v in sorted(out.items())}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.languages = list(dictionaries)
        self.compressors = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        raw = letters(text)
        return [len(c.compress(raw)) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, relative margin, and whether the margin is wide enough. Ties go to the first language by name."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, False
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        least = sizes[best]
        rest = min((x for i, x in enumerate(sizes) if i != best), default=least)
        share = 1.0 / sum(float(np.exp(min(0.0, (least - x) / BYTES_PER_LOGIT))) for x in sizes)
        margin = (rest - least) / max(rest, 1)
        return self.languages[best], share, margin, len(sizes) == 1 or margin >= MIN_MARGIN


_ready: dict[int, Classifier] = {}


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, margin and accepted.

    lang_pred is the best language even where accepted is false (narrow margin), so that a caller chooses what to do with
    rejected rows. Null, empty and letterless texts are ``und`` with score 0. Columns of ``docs`` with these names are
    replaced. A row is judged by itself: ties, repeats and other columns change nothing.
    """
    new = ["lang_pred", "score", "margin", "accepted"]
    keep = [c for c in docs.columns if c not in new]
    rest = [c for c in keep if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value)
        c = _ready.get(key)
        if c is None:
            _ready.clear()
            c = _ready[key] = Classifier(shared.value)
        for x in batches:
            got = [c.predict(t) for t in x.column(text).to_pylist()]
            cols = [x.column(n) for n in rest] + [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, names=rest + new)

    return docs.select(*keep).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    learned = learn_dictionaries(docs.where(crc_mod("doc_id", 3) != 1))
    out = identify_language(docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")), learned)
    return out.select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")
