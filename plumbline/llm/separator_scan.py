"""Token counts from flat token files that hold nothing but ids, with a separator after each document.

A file is a run of blocks of equal size, cut without regard to documents.  Each
block is searched for separators as one array; a block's summary (tokens,
separators, place of its last separator) is all that a prefix scan needs to say how
many documents and tokens lie before a block and where its first document began.
The scan goes over groups of blocks and then inside them, so that no file, however long, is gathered
in one task.

Edge cases: an empty document is counted with no tokens; tokens behind a file's
last separator are a document that is not ``closed``; empty files and tables give
no documents.  The writer takes null texts as empty and carries null and repeated ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.byte_bpe import encoder
from plumbline.session import materialise, new_folder

BLOCK, GROUP = 1 << 16, 1024
SEPARATOR = 50256
_KINDS = {2: "<u2", 4: "<u4"}


def write_token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", *, separator: int = SEPARATOR,
                      width: int = 2, block: int = BLOCK) -> DataFrame:
    """Writes the ids of all documents to the shared folder, one file per partition: rows ``file``, ``block``, ``tokens``.

    Beside the tokens stand, as ``ids``, the ids of the documents whose separators lie in the block, to
    name them later; the scan does not read them.
    """
    own = docs.select(docs[id_col].cast("string").alias("id"), docs[text].alias("text"))
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("block", T.LongType()),
                           T.StructField("tokens", T.BinaryType()), T.StructField("ids", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, at, size = TaskContext.get().partitionId(), 0, block * width
        end = np.array([separator], dtype=_KINDS[width]).tobytes()
        held, names = bytearray(), []
        for batch in batches:
            for key, body in zip(batch["id"], batch["text"]):
                held += np.frombuffer(encoder(vocabulary, False).packed_ids(body or ""), "<u4").astype(_KINDS[width]).tobytes() + end
                while len(held) > size:
                    yield pd.DataFrame({"file": [file], "block": [at], "tokens": [bytes(held[:size])], "ids": [names]})
                    del held[:size]
                    at, names = at + 1, []
                names.append(key)
        if held:
            yield pd.DataFrame({"file": [file], "block": [at], "tokens": [bytes(held)], "ids": [names]})

    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    own.mapInPandas(run, schema).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    return written.withColumn("ids", written["ids"].cast(T.ArrayType(docs.schema[id_col].dataType)))


def read_token_files(spark: SparkSession, path: str, *, width: int = 2, block: int = BLOCK) -> DataFrame:
    """The blocks (``file``, ``block``, ``tokens``) of plain binary files below ``path``; each file is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = block * width
    return files.filter("length > 0").select(
        F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"),
    ).select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("tokens"))


def _separators(separator: int, width: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(blocks: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(np.frombuffer(b or b"", dtype=_KINDS[width]) == separator).astype(np.int32) for b in blocks], dtype=object)
    return run


def _before(summaries: DataFrame) -> DataFrame:
    """``summaries`` with the tokens and documents before each block and the place behind the last separator before it."""
    grouped = summaries.withColumn("group", F.floor(F.col("block") / GROUP))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(c).over(inside), zero).alias(f"own_{c}") for c in ("n", "found")]
    placed = grouped.select("*", *sums).withColumn("own_from", F.max(F.col("own_n") + F.col("last") + 1).over(inside))
    totals = placed.groupBy("file", "group").agg(
        F.sum("n").alias("n"), F.sum("found").alias("found"), F.max(F.col("own_n") + F.col("last") + 1).alias("end"), F.max("block").alias("top"))
    totals = totals.select("file", "group", "end", *[F.coalesce(F.sum(c).over(across), zero).alias(f"all_{c}") for c in ("n", "found")])
    totals = totals.withColumn("all_from", F.max(F.col("all_n") + F.col("end")).over(across)).drop("end")
    return placed.join(totals, ["file", "group"]).select(
        "file", "block", (F.col("all_n") + F.col("own_n")).alias("tokens_before"), (F.col("all_found") + F.col("own_found")).alias("docs_before"),
        F.coalesce(F.col("all_n") + F.col("own_from"), "all_from", zero).alias("open_from"))


def token_counts(blocks: DataFrame, *, separator: int = SEPARATOR, width: int = 2, names: str | None = None) -> DataFrame:
    """One row per document: ``file``, ``ordinal`` in it, ``start`` in tokens, ``n_tokens``, ``closed``, and its ``id`` if ``names`` is the column that has them."""
    found = materialise(blocks.select("file", "block", (F.octet_length("tokens") / width).cast("long").alias("n"), _separators(separator, width)("tokens").alias("at"),
                          *([F.col(names).alias("ids")] if names else [])), "separators")
    summaries = found.select("file", "block", "n", F.size("at").cast("long").alias("found"), F.array_max("at").alias("last"))
    placed = found.join(_before(summaries), ["file", "block"])
    ends = placed.select("file", "tokens_before", "docs_before", "open_from", F.col("at").alias("ats"), *(["ids"] if names else []), F.posexplode("at").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open_from")).otherwise(F.col("tokens_before") + F.get("ats", F.col("i") - 1) + 1)
    closed = ends.select("file", (F.col("docs_before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("tokens_before") + F.col("end") - start).alias("n_tokens"),
                         F.lit(True).alias("closed"), *([F.get("ids", F.col("i")).alias("id")] if names else []))
    files = placed.groupBy("file").agg(
        F.max(F.col("tokens_before") + F.col("n")).alias("total"), F.max(F.col("docs_before") + F.size("at")).alias("ordinal"),
        F.coalesce(F.max(F.col("tokens_before") + F.array_max("at") + 1), F.lit(0)).alias("start"))
    unclosed = files.filter("total > start").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(unclosed, allowMissingColumns=True)


def count_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The token count of every document, found again in the files that its ids are written to."""
    counts = token_counts(write_token_files(docs, vocabulary, id_col, text), names="ids")
    return counts.select(F.col("id").alias(id_col), "file", "ordinal", "start", "n_tokens")
