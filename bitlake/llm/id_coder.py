"""Token ids in compressed files: an adaptive context-mixing range coder over independent blocks.

The coder is IdCoder.java beside this file: orders 2 and 1 guess an id, whether a guess is right is decided by a
logistic mix of estimates of orders 0 to 2, and what neither guesses goes by its order-0 rank. It is a function of
Spark SQL from binary to binary. The compiler that Spark itself brings for generated code compiles it once per
session; the class goes to the executors as a jar in the shared folder. That takes a driver in the same JVM as the
session (not a remote one).

File format. A file is a Parquet file with one segment a row: ``shard`` and ``segment`` order the segments,
``tokens`` counts their ids, ``documents`` lists its documents in order (doc_id, ``at``: the segment's ids before it,
n_tokens), ``body`` holds the blocks. Each block has its number of ids, the crc32 of the ids as little-endian unsigned 32-bit
numbers, the bits per id and its number of bytes (four little-endian 32-bit numbers), then its code, and knows nothing
of any other. Readers check every block's checksum.

Defined cases: null and empty texts have the end id alone; null doc_ids come first and rows that share a
doc_id come in the order of their texts; an empty table gives no segments and an empty result; ids may have 32 bits;
a text of any length is in one segment, so that a task holds its ids at once.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlake.llm.common import fresh_path, let, released
from bitlake.llm.tokens import slices, store, vocabulary_path

BLOCK = 1 << 16
#: Ids of a segment; the document that reaches it ends it.
SEGMENT = 1 << 18
END_ID = 2
#: Bytes of text that a worker encodes at once.
BYTES = 8 << 20
_SOURCE = Path(__file__).with_name("IdCoder.java")
_CLASS = "bitlake.IdCoder"


def _functions(spark: SparkSession, block: int) -> tuple[str, str]:
    """The names of the session's functions that encode and decode."""
    encode, decode = f"bitlake_encode_ids_{block}", "bitlake_decode_ids"
    if spark.catalog.functionExists(encode):
        return encode, decode
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(_SOURCE.read_text())
    jar = io.BytesIO()
    with zipfile.ZipFile(jar, "w") as z:
        for name, code in dict(compiler.getBytecodes()).items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    path = fresh_path(spark, "id-coder") + ".jar"
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(jar.getvalue()))
    out.close()
    spark.sql(f"ADD JAR '{path}'")
    make = compiler.getClassLoader().loadClass(_CLASS).getConstructors()[0]
    for name, encodes in ((encode, True), (decode, False)):
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 2)
        given[0], given[1] = encodes, block
        spark._jsparkSession.udf().register(name, make.newInstance(given), jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return encode, decode


def encoded(ids: Column, spark: SparkSession, block: int = BLOCK) -> Column:
    """Blocks (binary) of ids (binary, little-endian unsigned 32-bit); null for null."""
    return F.call_function(_functions(spark, block)[0], ids)


def decoded(body: Column, spark: SparkSession) -> Column:
    """The ids of blocks; an error where a checksum does not match."""
    return F.call_function(_functions(spark, BLOCK)[1], body)


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Encode all texts of docs (doc_id, text) and write their ids to path in ascending doc_id order."""
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    index_type = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType())])
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("documents", T.ArrayType(index_type)), T.StructField("ids", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        shard, number, chunks = TaskContext.get().partitionId(), 0, store(vocabulary)
        index, held, size = [], [], 0

        def flush():
            doc_id, n = pa.concat_arrays([x for x, _ in index]), np.concatenate([x for _, x in index])
            documents = pa.StructArray.from_arrays([doc_id, pa.array(np.cumsum(n) - n), pa.array(n)], names=index_type.names)
            raw = np.concatenate(held).astype("<u4", copy=False)
            body = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, raw.nbytes], np.int32)), pa.py_buffer(raw)])
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), documents), body]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in (part for b in batches for part in slices(b, 1, BYTES)):
            ids, ends = chunks.encoded(batch.column(1), end_id)
            n, first, done = np.diff(ends, prepend=0), 0, 0
            while first < len(ends):
                # The document that fills the segment is its last.
                last = min(len(ends), int(np.searchsorted(ends, done + segment - size)) + 1)
                index.append((batch.column(0).slice(first, last - first), n[first:last]))
                held.append(ids[done : ends[last - 1]])
                size += int(ends[last - 1]) - done
                first, done = last, int(ends[last - 1])
                if size >= segment:
                    yield flush()
                    number, index, held, size = number + 1, [], [], 0
        if index:
            yield flush()

    shards = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    # Ranges by the id and the head of the text, so that rows that share an id spread and no whole text goes into a sample.
    ordered = docs.select("doc_id", "text", F.left("text", F.lit(32)).alias("head")).repartitionByRange(shards, "doc_id", "head").sortWithinPartitions("doc_id", "text").drop("head")
    made = ordered.mapInArrow(lambda batches: released(run(batches)), schema)
    made.select("shard", "segment", "tokens", "documents", encoded(F.col("ids"), docs.sparkSession, block).alias("body")).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, doc_type: T.DataType, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at path; with ids also its ids (little-endian 32-bit binary)."""
    segments = spark.read.parquet(path)
    sizes = segments.select("shard", "segment", "tokens")
    shards = sizes.groupBy("shard").agg(F.sum("tokens").alias("t"))  # a row per file
    before = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    starts = sizes.withColumnRenamed("tokens", "t").select("shard", "segment", before(Window.partitionBy("shard").orderBy("segment")).alias("segment_start"))
    starts = starts.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))

    def parts(found: Column) -> Column:
        part = lambda d: F.substring(found, (4 * d["at"] + 1).cast("int"), (4 * d["n_tokens"]).cast("int"))
        rows = F.transform("documents", lambda d: F.struct(d["doc_id"].cast(doc_type).alias("doc_id"), d["at"].alias("at"), d["n_tokens"].alias("n_tokens"), F.crc32(part(d)).alias("ids_crc32"), *[part(d).alias("ids")] * ids))
        last = F.element_at("documents", -1)
        return F.when(F.octet_length(found) == 4 * (last["at"] + last["n_tokens"]), rows).otherwise(F.raise_error(F.lit("a segment's documents and ids differ in number")))

    # The ids of a segment are found once, and do not go along with its documents.
    docs = segments.select("shard", "segment", F.inline(let(decoded(F.col("body"), spark), parts)))
    return docs.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of docs and return what the files hold."""
    spark = docs.sparkSession
    path = fresh_path(spark, "ids")
    write_ids(docs, path, vocabulary, end_id)
    return read_ids(spark, path, docs.schema["doc_id"].dataType)
