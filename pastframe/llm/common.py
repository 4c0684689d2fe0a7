"""Session, storage and Arrow helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
#: Text bytes that a Python task turns over at a time.
SLICE_BYTES = 4 << 20


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever their working folder is."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_scopes: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: a cut of the lineage that outlives lost executors.

    It goes when the scratch() around it ends; without one it stays, as what is read from it may be read at any time.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            _delete(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make() as a written table; the tables that it wrote on its way are deleted."""
    with scratch(spark):
        df = make()
        path = new_folder(spark, name)
        df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table made by written() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def row_key(*cols: str):
    """A row's identity by these columns, in 128 bits: repeated rows share it; rows with one id but different texts don't."""
    own = [F.col(f"`{c}`") for c in cols]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("second"), *own).alias("b"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


#: A key with more than this share of a join's rows is dealt to SALTS tasks; fewer than 1 / HOT_SHARE keys can be.
HOT_SHARE, SALTS = 1 / 500, 64


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold more than HOT_SHARE of the rows, judged by a sample of about 200,000 of them: fewer than 1 / HOT_SHARE rows."""
    n = df.count()
    some = df.select(*keys).sample(min(1.0, 200_000 / max(n, 1)), seed=7)
    counts = some.groupBy(*keys).agg(F.count("*").alias("__c"))
    return counts.join(F.broadcast(counts.agg(F.sum("__c").alias("__all"))), F.col("__c") > F.greatest(F.col("__all") * HOT_SHARE, F.lit(20))).select(*keys)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """big joined with small (few rows a key) where few keys may hold most of big: these are dealt to SALTS tasks.

    Only the hot keys' rows of small are repeated. The sample decides where rows go, never which: all rows are joined.
    """
    hot = written(hot_keys(big, keys), "hot-keys")
    if not hot.take(1):
        return big.join(small, keys, how)
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))  # under 1 / HOT_SHARE rows
    rest = [c for c, kind in big.dtypes if c not in keys and "map<" not in kind and "array<" not in kind]
    mark = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rest) if rest else F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    left = big.join(hot, keys, "left").withColumn("__salt", mark).drop("__hot")
    spread = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    right = small.join(hot, keys, "left").withColumn("__salt", spread).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def hash_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All rows of df if there are no more than `most`, else about that many, always the same: those of small key hash.

    The bound is met by a threshold on the hash, not by a sort: no task gathers the sample.
    """
    n = df.count()
    if n <= most:
        return df
    span = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(span)) < int(span * 0.97 * most / n))


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text each, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def with_text_columns(df: DataFrame, text_col: str, outputs: list[tuple[str, str, pa.DataType]], fn: Callable[[list], list], setup: Callable[[], object] | None = None, keep_text: bool = True) -> DataFrame:
    """Add columns that fn makes of whole texts, in Arrow batches; other columns pass through, ones of the same name are replaced, and the texts go without keep_text.

    outputs: (name, Spark type, Arrow type) of each. fn(texts, state) takes a list of texts (null as "") and returns one
    list or array for each output; state is what setup() returned once in the task.
    """
    let_workers_import(df.sparkSession)
    names = {n for n, _, _ in outputs} | (set() if keep_text else {text_col})
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text"), *(f"`{n}` {t}" for n, t, _ in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for whole in batches:
            for batch in sliced(whole, "__text"):
                k = batch.schema.get_field_index("__text")
                made = fn([t or "" for t in batch.column(k).to_pylist()], state)
                cols = [c for i, c in enumerate(batch.columns) if i != k]
                keys = [n for i, n in enumerate(batch.schema.names) if i != k]
                for (n, _, kind), values in zip(outputs, made, strict=True):
                    cols.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
                    keys.append(n)
                yield pa.RecordBatch.from_arrays(cols, names=keys)

    return base.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room; hash_of decides what a word counts as."""

    def __init__(self, hash_of: Callable[[str], int], most: int = 400_000):
        super().__init__()
        self.hash_of, self.most = hash_of, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.hash_of(word)
        return h


class WordTable(dict):
    """Facts of words, whole numbers of 64 bits each, kept while there is room: words of bytes to rows of a table."""

    def __init__(self, facts: Callable[[bytes], tuple[int, ...]], columns: int, most: int = 400_000):
        super().__init__()
        self.facts, self.most, self.table = facts, most, np.empty((1024, columns), np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[k] = self.facts(word)
        self[word] = k
        return k

    def rows(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and facts of the words of a text, split at \\x20 and \\x09-\\x0D."""
        if len(self) > self.most:
            self.clear()
        words = data.split()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return at, self.table[at]
