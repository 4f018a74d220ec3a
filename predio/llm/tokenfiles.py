"""Token ids of all documents as raw binary files, with keyed access through perfect hashing.

``ids/`` holds files of ids in ascending key order: eight bytes of header (``TOKIDS``, the
width of an id in bytes, 0) and then nothing but little-endian ids, each document ended by
the end id.  ``index/`` is a table with one row per bucket of keys: a minimal perfect hash
of the keys in it and, by number, a fingerprint of the key, the file, the place of the first
id, the count of ids and of records of that key.  ``files/`` lists the files.

Files are written by tasks under names of their own through ``pyarrow.fs``; only files of
tasks that ended well are listed, so a lost executor leaves no trace but an unused file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from predio.llm.bpe import encoder
from predio.llm.perfect_hash import PerfectHash
from predio.llm.words import row_blocks, text_buffers
from predio.scale import settle

MAGIC = b"TOKIDS"
HEADER = 8
#: Expected keys per bucket of the index, which is read as a whole.
BUCKET = 4096
_DOCS = "_key string, _file string, _offset bigint, _n bigint, _copies int, _copy int"
_PLACES = "_key string, _copy int, _copies int, _file string, _offset bigint, _n bigint"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def key_text(key: str) -> Column:
    """A key as text; a missing key is a text that no key gives."""
    return F.coalesce(F.col(key).cast("string"), F.lit("\x00"))


def _hashes() -> list[Column]:
    """Hash and fingerprint of the record named by ``_key`` and ``_copy``."""
    return [
        F.xxhash64("_key", "_copy").alias("_hash"),
        F.xxhash64(F.lit("fingerprint"), "_key", "_copy").alias("_print"),
    ]


def write(
    df: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = 2
) -> None:
    """Encode every whole text with the tokenizers library's model and write files and index under ``path``.

    Documents stand in ascending key order, those without a key first; documents that share a key
    are each kept, in the order of a hash of their texts.  A null or empty text is the end id alone.
    An empty table gives an index without rows.  Other columns are not looked at.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_order"), key_text(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.repartitionByRange("_order").sortWithinPartitions("_order", F.xxhash64("_text")).drop("_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, True)
        width = 2 if len(own.tokens) <= 1 << 16 and end < 1 << 16 else 4
        store, folder = _open(f"{path}/ids")
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.ids"
        out, offset, last, copy = None, 0, None, 0
        for batch in batches:
            column = batch.column(1)
            if column.null_count:
                column = column.fill_null("")
            data, at = text_buffers(column)
            keys = batch.column(0).to_pylist()
            for a, b in row_blocks(at, 1 << 21):
                ids, row = own.encode(data, at, a, b)
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                    out.write(MAGIC + bytes([width, 0]))
                length = np.diff(row) + 1
                out.write(np.insert(ids, row[1:], end).astype(f"<u{width}").tobytes())
                begin = offset + np.cumsum(length) - length
                copies = []
                for k in keys[a:b]:
                    copy = copy + 1 if k == last else 0
                    last = k
                    copies.append(copy)
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[a:b], pa.string()), pa.array([name] * n, pa.string()), pa.array(begin),
                        pa.array(length), pa.array(np.ones(n, np.int32)), pa.array(copies, pa.int32()),
                    ],
                    names=["_key", "_file", "_offset", "_n", "_copies", "_copy"],
                )
                offset += int(length.sum())
        if out is not None:
            out.close()

    docs = settle(rows.mapInArrow(run, _DOCS), "token_docs")
    # One row per file: the ids in all files before it.
    sizes = docs.groupBy("_file").agg(F.sum("_n").alias("n"), F.count("*").alias("docs")).orderBy("_file").collect()
    ends = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    files = [(r["_file"], r["n"], start) for r, start in zip(sizes, ends)]
    spark.createDataFrame(files, "file string, n bigint, start bigint").coalesce(1).write.parquet(f"{path}/files")
    # The first record of a key tells how many there are.
    repeated = docs.filter("_copy > 0").groupBy("_key").agg((F.max("_copy") + 1).alias("_all"))
    docs = docs.join(repeated, "_key", "left").withColumn("_copies", F.coalesce("_all", F.lit(1)).cast("int"))
    buckets = max(1, -(-sum(r["docs"] for r in sizes) // BUCKET))
    located = docs.select("_file", "_offset", "_n", "_copies", *_hashes())
    located = located.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    index = located.groupBy("_bucket").applyInArrow(
        _build, "bucket bigint, buckets bigint, n bigint, sizes binary, bits binary, before binary, names string,"
        " file binary, offset binary, length binary, copies binary, print binary"
    ).withColumn("buckets", F.lit(buckets).cast("bigint"))
    index.write.parquet(f"{path}/index")


def _build(rows: pa.Table) -> pa.Table:
    """One bucket's row of the index."""
    hashes = rows.column("_hash").to_numpy().view(np.uint64)
    perfect = PerfectHash.build(hashes)
    place = np.empty(len(hashes), np.int64)
    place[perfect.numbers(hashes)] = np.arange(len(hashes))
    names, file = np.unique(np.array(rows.column("_file").to_pylist()), return_inverse=True)
    column = lambda name, kind: rows.column(name).to_numpy()[place].astype(kind).tobytes()
    return pa.table(
        {
            "bucket": [rows.column("_bucket")[0].as_py()], "buckets": pa.array([0], pa.int64()), "n": [len(hashes)],
            "sizes": [perfect.sizes.tobytes()], "bits": [perfect.bits.tobytes()], "before": [perfect.before.tobytes()],
            "names": ["\n".join(names.tolist())], "file": [file[place].astype("<u4").tobytes()],
            "offset": [column("_offset", "<i8")], "length": [column("_n", "<i8")], "copies": [column("_copies", "<i4")],
            "print": [column("_print", "<i8")],
        }
    )


def _probe(wanted: pa.Table, index: pa.Table) -> pa.Table:
    """Places of the wanted records of one bucket; unknown keys give no row."""
    none = pa.schema([("_key", pa.string()), ("_copy", pa.int32()), ("_copies", pa.int32()), ("_file", pa.string()), ("_offset", pa.int64()), ("_n", pa.int64())]).empty_table()
    if not index.num_rows or not wanted.num_rows:
        return none
    entry = index.to_pylist()[0]
    read = lambda name, kind: np.frombuffer(entry[name], kind)
    perfect = PerfectHash(read("sizes", np.int64), read("bits", np.uint8), read("before", np.int64))
    number = perfect.numbers(wanted.column("_hash").to_numpy().view(np.uint64))
    found = (number >= 0) & (read("print", "<i8")[number] == wanted.column("_print").to_numpy())
    number, rows = number[found], np.flatnonzero(found)
    names = entry["names"].split("\n")
    return pa.table(
        {
            "_key": wanted.column("_key").take(rows), "_copy": wanted.column("_copy").take(rows),
            "_copies": pa.array(read("copies", "<i4")[number]),
            "_file": pa.array([names[i] for i in read("file", "<u4")[number].tolist()], pa.string()),
            "_offset": pa.array(read("offset", "<i8")[number]), "_n": pa.array(read("length", "<i8")[number]),
        }
    )


def locate(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``file``, ``offset`` (in ids) and ``n`` of every record of the given keys, by the index alone.

    Keys that were not written give no row; a key given twice counts once; a missing key finds the
    documents written without one.
    """
    spark = keys.sparkSession
    index = spark.read.parquet(f"{path}/index")
    head = index.select("buckets").head()
    wanted = keys.select(F.col(key), key_text(key).alias("_key")).distinct()
    if head is None:
        return wanted.filter("false").select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("offset", "bigint"), ("n", "bigint"))])

    def probe(records: DataFrame) -> DataFrame:
        hashed = records.select("_key", "_copy", *_hashes()).withColumn("_bucket", F.pmod("_hash", F.lit(head["buckets"])))
        by = index.withColumnRenamed("bucket", "_bucket").groupBy("_bucket")
        return hashed.groupBy("_bucket").cogroup(by).applyInArrow(_probe, _PLACES)

    first = settle(probe(wanted.select("_key", F.lit(0).alias("_copy"))), "places")
    more = first.filter("_copies > 1").select("_key", F.explode(F.sequence(F.lit(1), F.col("_copies") - 1)).alias("_copy"))
    places = first if first.filter("_copies > 1").isEmpty() else first.unionByName(probe(more))
    return places.join(wanted, "_key").select(key, F.col("_file").alias("file"), F.col("_offset").alias("offset"), F.col("_n").alias("n"))


def read(places: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Ids (little-endian unsigned 32-bit, the end id included) of located records, read from the files.

    Neighbouring records of a file are read in one request of about 4 MB.
    """
    files = places.sparkSession.read.parquet(f"{path}/files").select("file", F.col("start").alias("_start"))
    rows = places.join(files, "file").select(
        F.col(key).alias("_k"), (F.col("_start") + F.col("offset")).alias("start"), "n", "file", "offset"
    )
    # Stretches of a file go to tasks whole; a stretch holds some MB whatever the file's size.
    stretch = F.floor(F.col("offset") / (1 << 21))
    rows = rows.repartition("file", stretch).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(f"{path}/ids")
        name, source, width = None, None, 0
        for batch in batches:
            file, offset, n = batch.column(3).to_pylist(), batch.column(4).to_numpy(), batch.column(2).to_numpy()
            first = 0
            while first < len(file):
                if file[first] != name:
                    if source:
                        source.close()
                    name = file[first]
                    source = store.open_input_file(f"{folder}/{name}")
                    head = source.read(HEADER)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"{name} is not a file of token ids")
                    width = head[len(MAGIC)]
                last = first + 1
                while last < len(file) and file[last] == name and offset[last] + n[last] - offset[first] < 1 << 21:
                    last += 1
                stop = int((offset[first:last] + n[first:last]).max())
                source.seek(HEADER + width * int(offset[first]))
                block = np.frombuffer(source.read(width * (stop - int(offset[first]))), f"<u{width}").astype("<u4")
                at = (offset[first:last] - offset[first]).tolist()
                found = [block[a : a + k].tobytes() for a, k in zip(at, n[first:last].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, last - first) for c in batch.columns[:2]], pa.array(found, pa.binary())],
                    names=["_k", "start", "ids"],
                )
                first = last
        if source:
            source.close()

    kind = places.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"_k {kind}, start bigint, ids binary").select(
        F.col("_k").alias(key), "start", F.col("ids").alias(ids)
    )
