"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.llm.textbytes import Chunk, chunks
from backtrail.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, by modulus."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def with_doubles(df: DataFrame, text: str, names: Sequence[str],
                 compute: Callable[[Chunk], np.ndarray]) -> DataFrame:
    """`df` and one double column per name: `compute` gives a row of values per document.

    Texts are whole; a null text counts as empty. Nothing is shuffled.
    """
    at, width, columns = df.columns.index(text), len(names), [*df.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.asarray(compute(c), np.float64).reshape(c.n, width)
                     for c in chunks(batch.column(at))]
            values = np.concatenate(parts) if parts else np.empty((0, width))
            extra = [pa.array(np.ascontiguousarray(values[:, j])) for j in range(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], columns)

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                    wanted: Column, name: str) -> DataFrame:
    """(text, label, weight): at most about `per_class` labelled documents of each class.

    The choice is by a hash of the id, so it is the same in every run. `weight` is how many
    labelled documents a chosen one stands for. Labels other than 0 and 1 are left out.
    The chosen ids are bounded, so they are broadcast to the documents. Of documents with
    the same text and label one is kept.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & wanted).distinct()
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    part = F.lit(0.0)
    weight = F.lit(1.0)
    for k, v in share.items():
        part = F.when(F.col("label") == k, v).otherwise(part)
        weight = F.when(F.col("label") == k, 1.0 / v).otherwise(weight)
    chosen = rows.withColumn("weight", weight).withColumn("__at", place)
    chosen = chosen.filter(F.col("__at") < part).orderBy("__at", "doc_id").limit(3 * per_class)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen.drop("__at")), "doc_id")
    one = joined.groupBy(F.md5("text").alias("__key"), "label").agg(
        F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"),
        F.sum("weight").alias("weight"))
    return stored(one.drop("__key"), name)


def distinct_docs(docs: DataFrame, fp: str) -> DataFrame:
    """`docs` with the column `fp` (a hash of the text), one row per doc_id and text.

    Only rows that repeat are grouped; the others are not shuffled for it when few repeat.
    """
    marked = docs.withColumn(fp, F.xxhash64("text"))
    count, own_doc, own_fp = fresh(marked, "rows", "__doc", "__fp")
    repeats = stored(marked.groupBy("doc_id", fp).agg(F.count(F.lit(1)).alias(count)).filter(
        F.col(count) > 1).select(F.col("doc_id").alias(own_doc), F.col(fp).alias(own_fp)), "repeats")
    if repeats.isEmpty():
        return marked
    same = F.col("doc_id").eqNullSafe(F.col(own_doc)) & (F.col(fp) == F.col(own_fp))
    once = marked.join(repeats, same, "left_anti")
    return once.unionByName(marked.join(repeats, same, "left_semi").dropDuplicates(["doc_id", fp]))
