"""What the training-data operators share: tables in the cluster's shared folder, word rules, batches of bounded size."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that end a word: space and U+0009 to U+000D. ``bytes.split()`` parts at the same ones.
SPACES = " \t\n\x0b\x0c\r"
#: UTF-8 bytes of text that one step inside a Python task works on at a time (a longer single text is a step of its own).
STEP_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all is one process (tests), a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: tables must go to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ampliq-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: the lineage ends there, and any executor may be lost."""
    path = f"{shared_folder(spark)}/ampliq/{name}-{uuid.uuid4().hex}"
    for paths in _SCRATCH[-1:]:
        paths.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the table if ``df`` is one that ``written`` gave. For when what comes of it is stored."""
    if df in _PATHS:
        _delete(df.sparkSession, _PATHS.pop(df))


#: Where the tables lie that ``written`` gave and that are still known.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Paths of the tables written within the ``scratch`` blocks that are open.
_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the tables that ``written`` made within the block; for blocks that store what comes of them."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def forget(spark: SparkSession) -> None:
    """Deletes all tables that ``written`` left in the shared folder. For after the results that come from them are stored."""
    _delete(spark, f"{shared_folder(spark)}/ampliq")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each changed as far as needed for none of the columns to have it (whatever its capitals)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its own columns of these names under names that nothing else has, and what each is called now."""
    wanted = {n.lower() for n in names}
    own = [c for c in df.columns if c.lower() in wanted]
    called = dict(zip(own, fresh([*df.columns, *names], *[f"_own_{c}" for c in own]), strict=True))
    return df.withColumnsRenamed(called), called


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text each, with their texts as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        lengths = [0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()]
        start, held = 0, 0
        for i, n in enumerate(lengths):
            held += n
            if held >= most or i == len(lengths) - 1:
                yield batch.slice(start, i + 1 - start), [x or b"" for x in column.slice(start, i + 1 - start).to_pylist()]
                start, held = i + 1, 0


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The library's tokenizer of a .json file, on one thread and with no truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found
