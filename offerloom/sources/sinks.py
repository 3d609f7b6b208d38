"""Tables that are written together: nobody sees one without the others, and a retried writer writes once."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _local(path: str) -> str | None:
    """The path on this machine of a file: URI or a plain path."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file, whole or not at all, unless there is one already. Of several writers one gets True."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if (at := _local(path)) is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(_local(part), "x") as out:
            out.write(text)
        try:
            os.link(_local(part), at)  # fails if the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(_local(part))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, final = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    out = fs.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:  # a rename that doesn't overwrite
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(
            new,
            final,
            spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        )
        return True
    except Exception:
        if fs.exists(final):
            return False
        raise
    finally:
        fs.delete(new, False)


def batches(spark: SparkSession, folder: str) -> dict[str, dict[str, str]]:
    """What each written batch lists: its tables' folders. One small row a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    listed = [json.loads(r["value"]) for r in spark.read.text(f"{folder}/_manifest", wholetext=True).collect()]
    return {x["batch"]: x["tables"] for x in listed}


def write_together(folder: str, *, key: str | None = None, **tables: DataFrame) -> str:
    """Appends one batch of several tables and returns its name.

    Every attempt writes its tables to folders of its own; then one file names them, put where no other attempt of the same key can put
    its own. So a batch with a key is written once, however often and from wherever it is retried, and a half-written one is
    never seen. Without a key
    every call is a new batch.
    """
    batch = hashlib.sha256((key or uuid.uuid4().hex).encode()).hexdigest()[:32]
    spark = next(iter(tables.values())).sparkSession
    if key is not None and batch in batches(spark, folder):
        return batch
    attempt = uuid.uuid4().hex
    folders = {name: f"{name}/{batch}-{attempt}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{folders[name]}")
    if not put_if_absent(spark, f"{folder}/_manifest/{batch}.json", json.dumps({"batch": batch, "tables": folders})):
        for own in folders.values():  # another attempt was first
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{own}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return batch


def read_together(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of all listed batches, with each row's batch. Only listed folders are opened."""
    paths = sorted(f"{folder}/{tables[name]}" for tables in batches(spark, folder).values() if name in tables)
    if not paths:
        raise ValueError(f"no batch of {folder} has a table {name}")
    return spark.read.parquet(*paths).withColumn(
        "batch",
        F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})-[0-9a-f]{32}/", 1)
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; without that setting, one of this machine if
    the session runs here alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new shared folder and read back, so that several readers don't each make it anew."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
