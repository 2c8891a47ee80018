"""What several corpus operators need: shared folders, Arrow maps, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.llm import wordhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none, as in tests, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the copy lies in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parts_for(texts: DataFrame, text_col: str, part_bytes: int) -> int:
    """Into how many parts work on texts is dealt, so that a part's share of them has about ``part_bytes``.

    At least as many as shuffle partitions, and 64.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long")), F.lit(0))).first()[0]
    return max(64, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column's name begins so, in any case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def fold_case(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; a null is an empty text."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


_made: dict = {}


def once(key: str, make: Callable[[], object], kept: int = 4) -> object:
    """``make()``, or what it gave this worker before for ``key``; the last few are kept."""
    if key not in _made:
        while len(_made) >= kept:
            _made.pop(next(iter(_made)))
        _made[key] = make()
    return _made[key]


def forget(*kept: str) -> None:
    """Drop what operators before this one keep in the worker, but for the keys named, and hand free memory back.

    Spark reuses Python workers from one operator to the next, so every map
    starts with this: what it finds in memory is its own.
    """
    for key in [k for k in _made if k not in kept]:
        del _made[key]
    wordhash.forget_powers()
    pa.default_memory_pool().release_unused()


def arrow_type(field: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field)


def add_columns(
    df: DataFrame,
    inputs: list[str],
    added: str,
    fn: Callable[..., list],
    keep: list[str] | None = None,
    uses: Sequence[str] = (),
) -> DataFrame:
    """Append columns that Python computes from whole Arrow batches.

    ``fn`` gets the Arrow arrays of ``inputs`` and returns one array or list
    for each field of ``added``.  ``keep`` names the columns carried over (all
    by default); a carried column that bears an added name gives way to it.
    ``uses`` names what ``fn`` keeps in the worker by ``once``.
    """
    new = T.StructType.fromDDL(added)
    names = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    carried = T.StructType([df.schema[c] for c in names])
    slots = [f"_in{i}" for i in range(len(inputs))]
    kept = [f"_keep{i}" for i in range(len(names))]
    types = [arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(*uses)
        for batch in batches:
            made = fn(*[batch.column(s) for s in slots])
            arrays = [batch.column(k) for k in kept]
            arrays += [a if isinstance(a, pa.Array) and a.type == t else pa.array(a, t) for a, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + new.names)

    source = df.select(
        *[F.col(f"`{c}`").alias(s) for c, s in zip(inputs, slots)], *[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)]
    )
    return source.mapInArrow(run, T.StructType(list(carried) + list(new)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again: several readers, pruned columns, no lineage."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
