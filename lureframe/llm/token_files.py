"""Token-id files: documents in ascending id order, written by tasks as Simple-8b shards and read back."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import simple8b
from .tokens import encoder, slices_of

#: A shard file is closed when it has this many ids (its last document may pass that).
SHARD_IDS = 1 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``path``/part-P-N.ls8b (ten digits each) and a manifest table: documents ascend by id inside a file and over the files by (P, N).

    Rows are dealt by ranges of the id and a hash of the text, so that rows which share an id or have none spread over tasks, and a
    task encodes its range as it writes it.  A file appears under its name when it is whole,
    and a task that runs again writes the same bytes to the same names, so lost executors do no harm.  A null id comes first; rows that
    share an id stand in a row, ordered by that hash and the text.  Null text: the end id alone.  ``path`` is a folder that all executors share.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        files.create_dir(folder, recursive=True)
        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        keys, sizes, ids, held, made, part = [], [], [], 0, 0, 0

        def close():
            nonlocal held, made
            data = simple8b.pack_shard([k or 0 for k in keys], [k is not None for k in keys], sizes, np.frombuffer(b"".join(ids), "<u4"))
            name = f"part-{part:010d}-{made:010d}.ls8b"
            aside = f"{folder}/_{name}-{uuid.uuid4().hex[:8]}"
            with files.open_output_stream(aside) as out:
                out.write(data)
            files.move(aside, f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "docs": [len(keys)], "ids": [held], "bytes": [len(data)]})
            for x in (keys, sizes, ids):
                x.clear()
            held, made = 0, made + 1
            return row

        for batch in batches:
            for b in slices_of(batch):
                part = b.column("part")[0].as_py()
                for d, raw in zip(b.column("doc_id").to_pylist(), code.encode(b.column("text").to_pylist())):
                    keys.append(d)
                    sizes.append(len(raw) // 4 + 1)
                    ids.append(raw + end)
                    held += sizes[-1]
                    if held >= SHARD_IDS:
                        yield close()
        if keys:
            yield close()

    ordered.mapInArrow(run, "file string, docs long, ids long, bytes long").write.parquet(f"{path}/_manifest")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """file, at (document's place in the file), doc_id, n_tokens, ids_crc32 and, on request, ids (unsigned 32-bit), from the files alone."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                docs, known, lengths, ids = simple8b.unpack_shard(b.column("content")[k].as_py())
                flat = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                cut = [flat[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                out = {"file": pa.array([b.column("path")[k].as_py().rsplit("/", 1)[-1]] * len(docs)), "at": pa.array(np.arange(len(docs))),
                       "doc_id": pa.array(docs, mask=~known), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(map(zlib.crc32, cut), pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(map(bytes, cut), pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "file string, at long, doc_id long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ls8b").load(path).select("path", "content")
    return found.mapInArrow(run, schema)


def token_ranges(rows: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of rows read back.

    Sums go from documents to files to parts, and back: a window adds up the parts (a row each), one per part its files, one
    per file its documents.
    """
    from pyspark.sql import Window

    def before(what: str, window) -> Column:
        return F.coalesce(F.sum(what).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    number = [F.regexp_extract("file", r"part-(\d+)-(\d+)", k).cast("long").alias(c) for k, c in ((1, "part"), (2, "number"))]
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids")).select("file", "ids", *number)
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before("ids", Window.orderBy("part")).alias("base"))
    starts = files.join(parts, "part").select("file", (F.col("base") + before("ids", Window.partitionBy("part").orderBy("number"))).alias("before"))
    inside = before("n_tokens", Window.partitionBy("file").orderBy("at"))
    return rows.join(starts, "file").select("doc_id", (F.col("before") + inside).alias("start"), "n_tokens", "ids_crc32")
