"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; a new one where that is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="tidewire_")
    return _FALLBACK[app]


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Delete what keep() wrote for these tables; nothing may read them afterwards."""
    for t in tables:
        path = getattr(t, "_kept_at", None)
        if isinstance(path, str):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: as a zip on a cluster, by the driver's own path in local runs."""
    root, env = Path(__file__).resolve().parents[2], spark.sparkContext.environment
    if _local(spark):
        if str(root) not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (str(root), env.get("PYTHONPATH", "")) if x)
        return
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        file = Path(tempfile.mkdtemp(prefix="tidewire_")) / "tidewire.zip"
        with zipfile.ZipFile(file, "w") as z:
            for f in sorted((root / "tidewire").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(file))  # executors fetch it from the driver
        _SHIPPED.add(app)


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers are used again by later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(frames, text_col: str, most_chars: int = 4_000_000):
    """Cut pandas frames into pieces of about `most_chars` of text (a longer row is a piece of its own)."""
    for frame in frames:
        sizes = frame[text_col].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most_chars:
                yield frame.iloc[begin:i]
                begin, held = i, 0
            held += n
        if begin < len(frame):
            yield frame.iloc[begin:]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that body may use it often while it is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket4(id_col: str) -> Column:
    """crc32(id as text) mod 4: remainder 2 is the held-out quarter."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], rows: int, train_only: bool, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` labelled documents, those with the smallest hash of the id.

    The ids are chosen on the narrow label table (top-k, no text); the chosen ids are at most `rows` longs, so they
    are broadcast and the documents are not shuffled.
    """
    lab = labels.select(F.col(id_col).alias("_id"), *[F.col(c) for c in label_cols]).where(F.col("_id").isNotNull())
    for c in label_cols:
        lab = lab.where(F.col(c).isNotNull())
    if train_only:
        lab = lab.where(bucket4("_id") != 2)
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(lab), docs[id_col] == lab["_id"]).drop("_id")


def annotate(df: DataFrame, text_col: str, make, fields: list[tuple[str, str]], most_chars: int = 4_000_000) -> DataFrame:
    """df with more columns that a Python function derives from text_col alone; df's own columns pass untouched.

    make() is called once a task and gives f(texts) -> one list for each of fields (name, Arrow type as in DDL).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    added = _parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields))
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    place = df.columns.index(text_col)

    def run(batches):
        f = make()
        for batch in batches:
            texts, begin = batch.column(place).to_pylist(), 0
            while begin < len(texts):
                end, held = begin, 0
                while end < len(texts) and (end == begin or held + len(texts[end] or "") <= most_chars):
                    held += len(texts[end] or "")
                    end += 1
                got = f(texts[begin:end])
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, k) for x, k in zip(got, kinds, strict=True)]], names=[*part.schema.names, *[n for n, _ in fields]])
                begin = end
        release()

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))
