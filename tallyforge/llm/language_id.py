"""Language identification by compression.

For every language a raw-content zstandard dictionary is made of labelled sample texts. A text, reduced to its letters in
lower case with one space between runs of them, is compressed block by block, once with each dictionary; the language
whose dictionary gives the smallest total wins. The margin is the share by
which the best total is below the second best; a narrow margin rejects the guess.

The sample is bounded: SAMPLE_DOCS distinct texts of each language, those of the smallest hashes, and EXCERPT bytes of each,
from a place in the text that its hash gives. Its choice only moves hashes and labels; the chosen texts are read in a second
pass. Only the MAX_LANGUAGES languages with most documents are learned; their dictionaries are broadcast. Every text is
classified whole, row by row, without a shuffle.

Defined results: a null text, or one without a letter, is `und` with score 0 and not accepted; so is every text where
nothing was learned. Dictionaries that tie
go to the language with more training documents. Repeated rows get the same prediction; an
empty table gives an empty result. Columns of the input are kept; those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import own

SAMPLE_DOCS = 64
EXCERPT = 2048
MAX_LANGUAGES = 256
BLOCK = 4096
LEVEL = 6
MIN_MARGIN = 0.01
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Runs of letters in lower case, one space for whatever stands between them, as UTF-8."""
    return F.lower(F.regexp_replace(text, "[^\\p{L}]+", " ")).cast("binary")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def fit(
    training: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, excerpt: int = EXCERPT
) -> dict[str, bytes]:
    """The dictionary of each language of `training`, the most frequent first; rows without text or language teach
    nothing."""
    body, label = F.col(f"`{text}`"), F.col(f"`{lang}`")
    usable = training.filter(label.isNotNull() & body.rlike("\\p{L}")).select(
        label.cast("string").alias("lang"), body.alias("text"), F.xxhash64(body).alias("hash")
    )
    often = {
        row["lang"]: row["n"]
        for row in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    }
    order = Window.partitionBy("lang").orderBy("hash")
    chosen = (
        usable.select("lang", "hash").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_docs)
    )
    pairs = chosen.filter(F.col("lang").isin(*often)).select("lang", "hash").collect()  # sample_docs rows a language
    if not pairs:
        return {}
    listed = F.broadcast(training.sparkSession.createDataFrame(pairs, "lang string, hash long"))
    first = F.pmod(F.col("hash"), F.greatest(F.octet_length("bytes") - excerpt, F.lit(0)) + 1) + 1
    cut = (
        usable.join(listed, ["lang", "hash"])
        .withColumn("bytes", letters(F.col("text")))
        .select("lang", "hash", F.substr("bytes", first.cast("int"), F.lit(excerpt)).alias("bytes"))
        .distinct()
    )
    held = defaultdict(list)
    for row in sorted(cut.collect(), key=lambda r: (r["lang"], r["hash"], bytes(r["bytes"]))):
        held[row["lang"]].append(bytes(row["bytes"]))
    return {name: b" ".join(held[name]) for name in sorted(held, key=lambda n: (-often[n], n))}


class Classifier:
    """Compressors of all languages, made once for each worker process."""

    _known: dict[str, "Classifier"] = {}

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = list(dictionaries)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            level, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.compressors = []
        for name in self.names:
            known = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, compression_params=parameters))

    @classmethod
    def of(cls, dictionaries: dict[str, bytes]) -> "Classifier":
        digest = hashlib.sha256(repr(dictionaries).encode()).hexdigest()
        if digest not in cls._known:
            cls._known = {digest: cls(dictionaries)}
        return cls._known[digest]

    def sizes(self, text: bytes, block: int = BLOCK) -> list[int]:
        """Compressed size with each dictionary, summed over the blocks of the text."""
        blocks = [text[at : at + block] for at in range(0, len(text), block)]
        return [sum([len(c.compress(b)) for b in blocks]) for c in self.compressors]

    def classify(self, text: bytes) -> tuple[str, float]:
        """The language and its margin over the second."""
        if not self.names:
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best, second = (sorted(sizes) + [2 * sizes[0]])[:2]
        return self.names[sizes.index(best)], min(1.0, (second - best) / max(1, second))


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds lang_pred, score (the margin) and accepted to every row."""
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)
    made = ["lang_pred", "score", "accepted"]
    kept = [f for f in docs.schema.fields if f.name not in made]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier.of(model.value)
        for batch in batches:
            found = [
                (UNKNOWN, 0.0) if not has_letter.as_py() else classifier.classify(value.as_py())
                for value, has_letter in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*[f.name for f in kept], "lang_pred", "score"],
            )

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{f.name}`") for f in kept], letters(body).alias(own("letters")), body.rlike("\\p{L}").alias(own("has"))
    )
    sure = (F.col("score") >= min_margin) & (F.col("lang_pred") != UNKNOWN)
    return rows.mapInArrow(predicted, schema).withColumn("accepted", sure)
