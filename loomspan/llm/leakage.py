"""Passages of evaluation items inside training documents, by winnowed fingerprints."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.session import materialize

#: Words of a passage that counts.
SPAN = 12
#: Words of a fingerprinted gram; the window follows, so that every shared span holds a shared fingerprint.
GRAM = 8
#: Fingerprints of the evaluation side that are broadcast (8 bytes each); beyond, they are broadcast in slices.
BROADCAST_FINGERPRINTS = 4_000_000

_HIDDEN = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = regex.compile(r"[a-z0-9]+")


class _Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case, accents and invisible format characters."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    bare = _HIDDEN.sub("", unicodedata.normalize("NFKD", text)).casefold()
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKD", bare)))


def winnow(hashes: np.ndarray, lengths: np.ndarray, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the fingerprints of texts laid end to end.

    ``hashes``: of all their words, ``lengths``: words of each. In every window
    of span - gram + 1 grams the least is kept, the last of equals.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    window, n = span - gram + 1, len(hashes) - span + 1
    if n <= 0:
        return none
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, window):
        later = grams[k : k + n] <= best
        best[later], at[later] = grams[k : k + n][later], np.arange(k, k + n)[later]
    text = np.repeat(np.arange(len(lengths)), lengths)
    whole = text[:n] == text[span - 1 :]
    at = np.unique(at[whole])
    return at, grams[at]


def _fingerprint(only, gram: int, span: int, outside: int):
    """A row for each fingerprint: id, fp, pos, and the hashes of the gram's words and of span - gram words on either side.

    ``only``: broadcast sorted fingerprints to keep, or null; ``outside``: stands for words beyond the text's ends.
    """
    around = np.arange(gram - span, span)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        keep = None if only is None else np.frombuffer(only.value, np.uint64)
        for pdf in batches:
            hashed = [np.fromiter((known[w] for w in words(t)), np.uint64) for t in pdf["text"]]
            lengths = np.array([len(h) for h in hashed], np.int64)
            if not lengths.sum():
                continue
            every = np.concatenate(hashed)
            at, value = winnow(every, lengths, gram, span)
            if keep is not None:
                found = np.isin(value, keep)
                at, value = at[found], value[found]
            start = np.cumsum(lengths) - lengths
            for some in range(0, len(at), 20_000):
                here, fp = at[some : some + 20_000], value[some : some + 20_000]
                owner = np.searchsorted(start, here, side="right") - 1
                places = here[:, None] + around
                inside = (places >= start[owner][:, None]) & (places < (start + lengths)[owner][:, None])
                context = np.where(inside, every[np.clip(places, 0, len(every) - 1)], np.uint64(outside))
                yield pd.DataFrame(
                    {"id": pdf["id"].to_numpy()[owner], "fp": fp.view(np.int64), "pos": (here - start[owner]).astype(np.int32), "context": [c.tobytes() for c in context]}
                )

    return run


def _extension(gram: int, span: int):
    """Equal words left of, in and right of a gram, from both contexts."""

    @F.pandas_udf("left int, right int")
    def extend(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        shape = (-1, gram + 2 * (span - gram))
        equal = np.frombuffer(b"".join(a), np.uint64).reshape(shape) == np.frombuffer(b"".join(b), np.uint64).reshape(shape)
        edge = span - gram
        left = np.cumprod(equal[:, :edge][:, ::-1], axis=1).sum(axis=1)
        right = np.cumprod(equal[:, edge:], axis=1).sum(axis=1)
        return pd.DataFrame({"left": left.astype(np.int32), "right": right.astype(np.int32)})

    return extend


def leaked_spans(documents: DataFrame, items: DataFrame, *, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Every run of ``span`` or more words that a document shares with an evaluation item.

    ``documents``: doc_id, text; ``items``: item_id, text (ids are bigints).
    Returns doc_id, item_id, doc_word, item_word (where the run starts, in
    words) and n_words, one row for each maximal run that holds a fingerprint.

    Winnowing keeps the least gram hash of each window of span - gram + 1
    grams, on both sides, so a shared run of ``span`` words shares a
    fingerprint, and so does each window within it. A hit carries the words
    around its gram and is extended over them; extended hits of ``span`` words
    that overlap on one diagonal make up the run.
    Null ids or texts, empty texts and texts of fewer words give nothing;
    repeated documents are each reported; other columns are ignored.

    The corpus is only scanned, never shuffled, and only hits leave the scan. For
    that the evaluation side's fingerprints are broadcast; if they are more than
    BROADCAST_FINGERPRINTS, in slices of about half as many, with a scan for each.
    """
    spark = documents.sparkSession
    schema = "id long, fp long, pos int, context binary"

    def prints(df: DataFrame, key: str, only, outside: int) -> DataFrame:
        texts = df.filter(F.col(key).isNotNull() & (F.length("text") > 0)).select(F.col(key).cast("long").alias("id"), "text")
        return texts.mapInPandas(_fingerprint(only, gram, span, outside), schema)

    test = prints(items, "item_id", None, 1).select(F.col("id").alias("item_id"), "fp", F.col("pos").alias("i_pos"), F.col("context").alias("i_context"))
    different = test.select("fp").distinct()
    some = different.limit(BROADCAST_FINGERPRINTS + 1).toPandas()["fp"].to_numpy(np.int64)
    if len(some) <= BROADCAST_FINGERPRINTS:
        hits = prints(documents, "doc_id", spark.sparkContext.broadcast(np.sort(some.view(np.uint64)).tobytes()), 2)
    else:
        test = materialize(test)
        different = materialize(test.select("fp").distinct())
        slices, found = -(-2 * different.count() // max(BROADCAST_FINGERPRINTS, 256)), []
        for k in range(slices):
            some = different.filter(F.pmod("fp", F.lit(slices)) == k).toPandas()["fp"].to_numpy(np.int64)
            only = spark.sparkContext.broadcast(np.sort(some.view(np.uint64)).tobytes())
            found.append(materialize(prints(documents, "doc_id", only, 2)))
            only.destroy()
        hits = reduce(DataFrame.unionByName, found)
    hits = hits.withColumnRenamed("id", "doc_id").join(test, "fp")
    hits = hits.withColumn("e", _extension(gram, span)("context", "i_context")).filter(F.col("e.left") + F.col("e.right") >= span)
    ends = hits.select(
        "doc_id", "item_id", (F.col("pos") - F.col("i_pos")).alias("shift"), (F.col("pos") - F.col("e.left")).alias("begin"), (F.col("pos") + F.col("e.right")).alias("end")
    )
    line = Window.partitionBy("doc_id", "item_id", "shift").orderBy("begin", "end")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") < F.col("reached"), 0).otherwise(1)).over(line)
    runs = ends.withColumn("reached", reached).withColumn("island", island).groupBy("doc_id", "item_id", "shift", "island")
    found = runs.agg(F.min("begin").alias("doc_word"), F.max("end").alias("end"))
    return found.select("doc_id", "item_id", "doc_word", (F.col("doc_word") - F.col("shift")).alias("item_word"), (F.col("end") - F.col("doc_word")).alias("n_words"))
