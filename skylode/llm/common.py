"""Helpers that the operators of this folder share."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.sources.manifest import delete_at_exit, file_system
from skylode.sources.scan import spread

#: Bytes of text that one step of a Python operator holds at a time. A longer
#: text makes a step of its own.
SLICE_BYTES = 2 << 20

#: Separates words: space and the controls 9 to 13. bytes.split() does the same.
WORD_BREAK = r"[\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, for tables that cut a lineage.

    It is the session's ``spark.checkpoint.dir``. Only where all runs on one machine
    may that be unset; a temporary folder of the session then takes its place.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='skylode-')}"
    return _own_dirs[app]


_own_dirs: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors.

    The folder goes when the driver's JVM ends, or before by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skylode-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skylode_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``written`` gave and no result reads any more."""
    for df in tables:
        fs, where = file_system(df.sparkSession, df._skylode_path)
        fs.delete(where, True)


#: Rows of one key that a join may bring to one task, keys of more rows that are
#: broadcast, and salts that the rows of more such keys are dealt by.
HUB, MANY_HUBS, SALTS = 10_000, 100_000, 64


def hub_join(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one line for each key and in ``n`` its
    number of rows.

    Keys of many rows are few: their lines go to the rows, which stay in their tasks. If
    there are many even so, these rows are dealt by salt to copies of the lines. All
    other keys are joined as ever. So no task gathers the rows of a key.
    """
    hubs = keyed.filter(F.col("n") > HUB).drop("n")
    n_hubs = hubs.count()
    if not n_hubs:
        return rows.join(keyed.drop("n"), key)
    few = keyed.filter(F.col("n") <= HUB).drop("n")
    if n_hubs <= MANY_HUBS:
        hot = rows.join(F.broadcast(hubs), key)
        rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti")
    else:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
        dealt = rows.withColumn("_salt", salt)
        copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        hot = dealt.join(hubs.withColumn("_salt", copies), [key, "_salt"]).drop("_salt")
        rest = dealt.join(hubs.select(key).withColumn("_salt", copies), [key, "_salt"], "left_anti").drop("_salt")
    return hot.unionByName(rest.join(few, key))


def crc32_mod(column: Column, modulus: int) -> Column:
    """crc32 of the column's text form, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def split_long(text: bytes, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """A long text in parts of about ``limit`` bytes, cut at white space alone (a
    longer word stays whole): word by word, the parts read as the text does."""
    at = 0
    while len(text) - at > limit:
        cut = _SPACE.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word of all texts, words of each text, the different words).

    Words are what white space (space, controls 9 to 13) separates, as bytes.split()
    does. Nothing is made for each word in Python.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # A blank text splits into one empty word.
    blank = pc.equal(pc.binary_length(lists.values), 0).to_numpy(zero_copy_only=False)
    coded = lists.values.dictionary_encode()
    codes = coded.indices.to_numpy()
    if blank.any():
        counts[np.repeat(np.arange(len(counts)), counts)[blank]] = 0
        codes = codes[~blank]
    return codes, counts, coded.dictionary


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in column(batch, name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    col = column(batch, name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [t or b"" for t in col.cast(kind).to_pylist()]


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``values``, of ``counts`` members each (0 allowed)."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class _Codes(dict):
    """Numbers keys as they come; ``new`` lists those not seen before."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = code = len(self)
        return code


class SequenceCache:
    """Id sequences of pieces, resolved once and gathered for many.

    ``resolve`` gives the ids of each of a list of new pieces. The cache is
    emptied when it holds over ``limit`` pieces, which bounds its memory and
    changes no result.
    """

    def __init__(self, resolve: Callable[[list], list[Sequence[int]]], limit: int = 500_000):
        self.resolve, self.limit = resolve, limit
        self.clear()

    def clear(self) -> None:
        self.codes = _Codes()
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def gather(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        codes = self.codes_of(pieces)
        lengths = self.lengths[codes]
        return self.flat[runs(self.starts[codes], lengths)], lengths

    def codes_of(self, pieces: list) -> np.ndarray:
        """Each piece's place in ``starts`` and ``lengths``, for as long as no other
        pieces are asked for."""
        if len(self.codes) > self.limit:
            self.clear()
        codes = np.array(list(map(self.codes.__getitem__, pieces)), np.int64)
        if new := self.codes.new:
            found = self.resolve(new)
            lengths = np.array(list(map(len, found)), np.int64)
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum()))))
            self.codes.new = []
        return codes
