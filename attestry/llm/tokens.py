"""Token counts of flat token files by a vectorised scan for separators, stitched across blocks with a prefix scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binaries, column, shared_dir, ship
from .tokenizer import default_path, word_ids

#: The end-of-document id of the default tokenizer; no text has it, as special tokens in a text are ordinary text.
SEPARATOR = 49407
#: Tokens of a block, and bytes of a file that write_flat begins a new file after.
BLOCK, FILE_BYTES = 1 << 18, 16 << 20
#: Texts that are held as objects at a time.
ROWS = 256


def token_width(tokenizer: str | None = None, separator: int = SEPARATOR) -> int:
    """Bytes of an id: two where every id of the tokenizer and the separator fit, else four."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer or default_path()).get_vocab_size(with_added_tokens=True) - 1, separator)
    return 2 if most < 1 << 16 else 4


def write_flat(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, separator: int = SEPARATOR, file_bytes: int = FILE_BYTES) -> None:
    """Flat files of little-endian unsigned ids of token_width() bytes, the ids of each text and then the separator, under
    path/kind=flat/chunk=n/, and beside each the doc_ids of its documents, under path/kind=ids/chunk=n/ by the same name.

    One task writes both in one commit, so a task that runs again, in whatever order its rows then come, writes ids that go with
    its tokens. The text writer puts the bytes of each row and of its line separator into a file, whatever they are. A file
    ends with the batch of rows that takes it over file_bytes.
    """
    ship(docs.sparkSession)
    where, width = tokenizer or default_path(), token_width(tokenizer, separator)
    end = separator.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(where)
        chunk = size = ordinal = n = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i in range(0, batch.num_rows, ROWS):
                flat = [np.frombuffer(ids.text(x), "<u4").astype(f"<u{width}").tobytes() for x in binaries(batch.slice(i, ROWS), 1)]
                if size >= file_bytes:
                    chunk, size, ordinal = chunk + 1, 0, 0
                told = f"{ordinal}:" + ",".join("" if k is None else str(k) for k in keys[i : i + ROWS])
                value = [end.join(flat), told.encode()]
                yield pa.RecordBatch.from_arrays([pa.array(value, pa.binary()), pa.array(["flat", "ids"]), pa.array([chunk] * 2, pa.int32()), pa.array([n] * 2, pa.int64())], names=["value", "kind", "chunk", "n"])
                n, ordinal, size = n + 1, ordinal + len(flat), size + len(value[0])

    own = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text")).mapInArrow(run, "value binary, kind string, chunk int, n long")
    ordered = own.select(F.col("value").cast("string").alias("value"), "kind", "chunk", "n").sortWithinPartitions("kind", "chunk", "n").select("value", "kind", "chunk")
    ordered.write.partitionBy("kind", "chunk").option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("maxRecordsPerFile", 0).text(path)


def token_counts(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Documents of flat token files: file, ordinal, start (tokens before it), n_tokens (without the separator).

    Each file is cut into blocks, and each block is scanned on its own for separators: its tokens before the first, between
    two, and after the last. A prefix scan over a file's blocks carries the open document on, over blocks without a
    separator too. A last document that no separator ends counts if it has a token; a document without tokens counts
    as 0. Empty files and folders without files give no rows. Bytes at the end that make no whole token are not one. A file
    is read by one task, so it may have up to 2 GB; write_flat keeps its own far below.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content").where(F.length("content") > 1)
    cut = F.transform(F.sequence(F.lit(0), F.length("content") - 1, F.lit(width * block)), lambda at: F.struct((at / (width * block)).cast("int").alias("block"), F.substring("content", at + 1, F.lit(width * block)).alias("bytes")))
    blocks = files.select("path", F.explode(cut).alias("b")).select("path", "b.block", "b.bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, head, tail, begin, inner = [], [], [], [], []
            for x in batch.column(2).to_pylist():
                a = np.frombuffer(x, f"<u{width}", len(x) // width)
                at = np.flatnonzero(a == separator)
                size.append(len(a))
                head.append(int(at[0]) if len(at) else None)
                tail.append(len(a) - 1 - int(at[-1]) if len(at) else len(a))
                begin.append(at[:-1] + 1)
                inner.append(np.diff(at) - 1)
            wide = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(begin, wide), pa.array(inner, wide)], names=["path", "block", "size", "head", "tail", "begin", "inner"])

    seen = blocks.mapInArrow(run, "path string, block int, size long, head long, tail long, begin array<long>, inner array<long>")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    scan = seen.withColumns({
        "opened": F.coalesce(F.count("head").over(before), zero),
        "ended": F.coalesce(F.sum(F.when(F.col("head").isNotNull(), F.size("inner") + 1)).over(before), zero),
        "offset": F.coalesce(F.sum("size").over(before), zero),
        "final": F.lead("block").over(order).isNull(),
    })
    same = Window.partitionBy("path", "opened").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the block that opened the document has one separator less before it than those it runs through
    carried = scan.withColumn("passed", F.coalesce(F.sum(F.when(F.col("head").isNull(), F.col("size"))).over(same), zero))
    last_tail = F.last(F.when(F.col("head").isNotNull(), F.col("tail")), ignorenulls=True).over(before)
    carried = carried.withColumn("carry", F.coalesce(last_tail, zero) + F.col("passed"))
    pair = lambda start, n: F.struct(start.alias("start"), n.alias("n_tokens"))
    none = F.array().cast("array<struct<start:bigint,n_tokens:bigint>>")
    headed = F.col("head").isNotNull()
    first = F.array(pair(F.col("offset") - F.col("carry"), F.col("head") + F.col("carry")))
    middle = F.zip_with("begin", "inner", lambda b, n: pair(F.col("offset") + b, n))
    rest = F.when(F.col("final") & ~headed & (F.col("carry") + F.col("size") > 0), F.array(pair(F.col("offset") - F.col("carry"), F.col("carry") + F.col("size"))))
    rest = rest.when(F.col("final") & headed & (F.col("tail") > 0), F.array(pair(F.col("offset") + F.col("size") - F.col("tail"), F.col("tail")))).otherwise(none)
    rows = carried.select(F.col("path").alias("file"), "ended", F.posexplode(F.concat(F.when(headed, F.concat(first, middle)).otherwise(none), rest)).alias("k", "d"))
    return rows.select("file", (F.col("ended") + F.col("k")).alias("ordinal"), "d.start", "d.n_tokens")


def document_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, separator: int = SEPARATOR, file_bytes: int = FILE_BYTES) -> DataFrame:
    """doc_id, n_tokens, file, chunk, ordinal, start: every document's tokens, counted in flat files that are written first.

    Null and empty texts have no tokens; very long texts are tokenised whole. The files' own lists of doc_ids tell whose tokens
    are whose; repeated rows and rows without doc_id count for themselves. Ids are integers. Other columns are not read. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    write_flat(docs, path, text, doc_id, tokenizer, separator, file_bytes)
    width = token_width(tokenizer, separator)
    place = lambda name: (F.regexp_extract(name, r"part-(\d+)", 1).cast("int").alias("file"), F.regexp_extract(name, r"chunk=(\d+)", 1).cast("int").alias("chunk"))
    if not docs.limit(1).count():
        return spark.createDataFrame([], "doc_id long, n_tokens long, file int, chunk int, ordinal long, start long")
    counts = token_counts(spark, f"{path}/kind=flat/chunk=*/part-*", separator, width=width).select(*place(F.col("file")), "ordinal", "start", "n_tokens")
    lines = spark.read.option("lineSep", separator.to_bytes(width, "little").decode("latin-1")).option("encoding", "ISO-8859-1").text(f"{path}/kind=ids/chunk=*/part-*")
    told = lines.select("value", *place(F.col("_metadata.file_path")))
    head = F.split("value", ":")
    own = told.select("file", "chunk", head[0].cast("long").alias("first"), F.posexplode(F.split(head[1], ",", -1)).alias("k", "id"))
    own = own.select("file", "chunk", (F.col("first") + F.col("k")).alias("ordinal"), F.nullif("id", F.lit("")).cast("long").alias("doc_id"))
    return own.join(counts, ["file", "chunk", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "file", "chunk", "ordinal", "start")
