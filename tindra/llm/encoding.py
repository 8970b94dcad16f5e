"""Token ids of a whole corpus by a public tokenizer, through a table of distinct words.

Texts are split into words in the JVM by the tokenizer's own pattern.  Merges never
cross words, so each distinct word is encoded once and its ids are joined back by
position.

* Words are counted batch by batch: what is shuffled for the word table are the
  distinct words of each batch, not the words of the corpus.
* The most frequent words are broadcast: those with a share of at least ``hot_share`` of all
  words, and of words of more than 32 characters in proportion more, so that all of
  them together have at most ``32 / hot_share`` characters.  They cover nearly all
  positions, are put in place by array gathers without a shuffle, and are just the
  words that would skew a join.  All other words take the shuffled join by row and
  position; no word is left out.
* Texts are split once; the words are kept as a compressed table in the shared folder.

Defined results: null and empty texts give an empty list.  Every row gives a row, also
those with a null or repeated key: rows are told apart by a number of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.session import release, stored

TOKENIZERS = "/opt/tokenizers"
#: The split pattern of the byte-level vocabularies, with white space spelt out as Unicode has it.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
PYTHON_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The byte-level tokenizer of a rank file; once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PYTHON_SPLIT, mergeable_ranks=ranks, special_tokens={})


def _resplit(text: str) -> list[str]:
    import regex

    return regex.findall(PYTHON_SPLIT, text)


def words_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words) with the text split into words, in order.

    The JVM's character tables may be older than the tokenizer's.  Texts with
    characters that the JVM does not know are split in Python by the same pattern;
    of the others nothing but a null goes there.
    """

    @F.pandas_udf("array<string>")
    def resplit(texts: pd.Series) -> pd.Series:
        return pd.Series([_resplit(t) if isinstance(t, str) else None for t in texts], dtype=object)

    rows = documents.select(F.col(key), F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{Cn}"), F.lit(False)).alias("_odd"))
    known = F.when(~F.col("_odd"), F.regexp_extract_all("_text", F.lit(SPLIT), F.lit(0)))
    return rows.select(F.col(key), F.coalesce(known, resplit(F.when(F.col("_odd"), F.col("_text")))).alias("words"))


def _flat(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The words of a column end to end, and the number of words of each row."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return words.flatten(), lengths.astype(np.int64)


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of each distinct word of a frame with an array column ``words``.

    Words are counted within each Arrow batch, so a task passes its distinct words on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            counted = pc.value_counts(_flat(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts")], names=["word", "n"])

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(path)
        for frame in frames:
            yield frame.assign(ids=encoder.encode_ordinary_batch(frame["word"].tolist(), num_threads=1))

    counted = words.select("words").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInPandas(encode, "word string, n bigint, ids array<int>")


def place_ids(flat: pa.Array, lengths: np.ndarray, known: dict[str, list[int]]) -> tuple[pa.ListArray, pa.ListArray]:
    """(ids, others) of rows of words: the ids of known words in their places, and -k in the place of the k-th other word."""
    coded = flat.dictionary_encode()
    uniques = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    found = [known.get(w) for w in uniques]
    width = np.array([1 if ids is None else len(ids) for ids in found], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(width)))
    pool = np.array([x for ids in found for x in (ids if ids is not None else (-1,))], dtype=np.int64)
    other = np.array([ids is None for ids in found], dtype=bool)
    each = width[codes] if len(codes) else np.zeros(0, dtype=np.int64)
    ends = np.concatenate(([0], np.cumsum(each)))
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1], each)
    ids = pool[np.repeat(start[codes], each) + inside] if len(codes) else np.zeros(0, dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(lengths)))
    at = np.flatnonzero(other[codes]) if len(codes) else np.zeros(0, dtype=np.int64)
    before = np.searchsorted(at, rows)
    row = np.searchsorted(rows, at, side="right") - 1
    ids[ends[at]] = -(np.arange(len(at)) - before[row] + 1)
    return (
        pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(ids, pa.int32())),
        pa.ListArray.from_arrays(pa.array(before, pa.int32()), flat.take(pa.array(at, pa.int64())).cast(pa.string())),
    )


def encode(documents: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, hot_share: float = 5e-6) -> DataFrame:
    """(key, ids) of every row, without special tokens.  Stores the words, the word table and what the frequent words give."""
    path = f"{folder}/{vocabulary}.tiktoken"
    words = stored(words_of(documents.select(F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")).alias("_at"), F.col(text).alias("_text")), "_at", "_text"))
    table = stored(word_table(words, path))
    total = table.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") >= F.lit(hot_share * total) * F.greatest(F.length("word") / 32, F.lit(1.0))
    known = {r.word: list(r.ids) for r in table.where(is_hot).select("word", "ids").collect()}  # at most 32 / hot_share characters
    shared = documents.sparkSession.sparkContext.broadcast(known)
    schema = words.select("_at", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("array<string>").alias("others")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others = place_ids(*_flat(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, others], names=["_at", "ids", "others"])

    placed = stored(words.mapInArrow(place, schema))
    release(words)
    rare = placed.select(F.col("_at.row").alias("row"), F.posexplode("others").alias("pos", "word")).join(table.where(~is_hot).select("word", F.col("ids").alias("w")), "word")
    far = rare.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("_far"))
    filled = F.flatten(F.transform("ids", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.element_at("_far", -x))))
    whole = placed.where(F.size("others") == 0).select(F.col("_at.key").alias(key), "ids")
    rest = placed.where(F.size("others") > 0).withColumn("row", F.col("_at.row")).join(far, "row").select(F.col("_at.key").alias(key), filled.alias("ids"))
    return whole.unionByName(rest)


def decode(encoded: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of every row through a join of its ids with the vocabulary's pieces; an empty list gives the empty text.

    The vocabulary is a fixed table of some 50,000 short pieces: it is broadcast, and an
    id is met with its piece by an array gather within its row, so nothing is shuffled.
    """
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    each = [pieces.get(k, b"") for k in range(max(pieces, default=-1) + 1)]
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(each), dtype=np.uint8), np.array([len(x) for x in each], dtype=np.int64)))
    rows = encoded.select(F.col(key), F.col(ids).alias("ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, width = shared.value
        start = np.concatenate(([0], np.cumsum(width)))
        for batch in batches:
            flat, lengths = _flat(batch.column(1))
            flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
            size = width[flat]
            ends = np.concatenate(([0], np.cumsum(size)))
            data = pool[np.repeat(start[flat] - ends[:-1], size) + np.arange(ends[-1])]
            offsets = ends[np.concatenate(([0], np.cumsum(lengths)))]
            texts = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], names=[key, "text"])

    return rows.mapInArrow(join, rows.select(F.col(key), F.lit("").alias("text")).schema)
