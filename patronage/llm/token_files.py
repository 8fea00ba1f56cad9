"""Token ids as files: each document compressed by itself with a shared zstandard dictionary.

A store is a folder of three Parquet tables in a file system that all executors share:

* `dictionary`: one row with the dictionary's bytes, its hash, the tokenizer and the id width;
* `blocks`: rows in ascending doc_id order, each some documents' compressed ids one after the other
  (`frames`), with their doc_ids, token counts and byte offsets, the dictionary's hash, the block's
  place (`part`, `block`) and how many ids its part holds before it (`start`);
* `parts`: how many ids the store holds before each part.

A document is read by its block's index and one slice of `frames`. Spark's writers commit the
tables, so a lost task leaves nothing half written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronage.llm.pieces import byte_level_ids, id_type, slices
from patronage.llm.work import lean

END_ID = 0
# The dictionary is trained on SAMPLE_RUNS runs of ids, taken by hash from all places in the texts
# of about SAMPLE_DOCS documents, also taken by hash.
SAMPLE_DOCS = 4_000
SAMPLE_RUNS = 4_000
RUN_IDS = 1_024
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4_096

BLOCKS = (
    "part int, block int, start bigint, n_ids bigint, first_doc bigint, last_doc bigint, "
    "dictionary string, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, "
    "frames binary"
)


def _ids(path: str, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text, with the end id."""
    ids, at = byte_level_ids(path, texts)
    end = np.array([end_id], ids.dtype)
    for low, high in zip(at[:-1], at[1:]):
        yield np.concatenate([ids[low:high], end])


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """One row (`hash`, `dictionary`, `tokenizer`, `width`); an empty dictionary for empty input."""
    kind = id_type(tokenizer)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = []
            for ids in _ids(tokenizer, batch.column("text"), end_id):
                found += [ids[a : a + RUN_IDS].tobytes() for a in range(0, len(ids), RUN_IDS)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["run"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [s for batch in batches for s in batch.column("run").to_pylist()]
        size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
        try:
            data = zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little to learn from
            data = b""
        row = [[hashlib.sha256(data).hexdigest()], [data], [tokenizer], [kind.itemsize]]
        kinds = [pa.string(), pa.binary(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds)],
            names=["hash", "dictionary", "tokenizer", "width"],
        )

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = docs.select("doc_id", "text").where(place < int(share * (1 << 30)))
    cut = some.mapInArrow(runs, "run binary").orderBy(F.xxhash64("run"), "run").limit(SAMPLE_RUNS)
    return cut.coalesce(1).mapInArrow(
        train, "hash string, dictionary binary, tokenizer string, width int"
    )


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    block_bytes: int = BLOCK_BYTES,
) -> None:
    """Write the store at `path`, documents in ascending doc_id order, each ending with `end_id`.

    Null texts are empty. Rows that repeat a doc_id stand side by side, in the order of their
    texts' hashes; null doc_ids come first. Other columns are not stored.
    """
    spark = docs.sparkSession
    train_dictionary(docs, tokenizer, end_id).write.parquet(f"{path}/dictionary")
    row = spark.read.parquet(f"{path}/dictionary").first()  # one row, bounded bytes
    digest, shared = row["hash"], row["dictionary"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        with_dict = zstandard.ZstdCompressionDict(bytes(shared)) if shared else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=with_dict, write_content_size=True)
        block, start, held, ids, counts, frames = 0, 0, 0, [], [], []

        def out() -> pa.RecordBatch:
            sizes = np.cumsum([0, *map(len, frames)])
            known = [i for i in ids if i is not None]
            values = [
                part,
                block,
                start,
                sum(counts),
                min(known, default=None),
                max(known, default=None),
                digest,
                ids,
                counts,
                sizes.tolist(),
                b"".join(frames),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, _BLOCKS)], schema=_BLOCKS
            )

        for batch in (part for whole in batches for part in slices(whole)):
            found = _ids(tokenizer, batch.column("text"), end_id)
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), found):
                ids.append(doc_id)
                counts.append(len(got))
                frames.append(pack.compress(got.tobytes()))
                held += len(frames[-1])
                if held >= block_bytes or len(ids) >= BLOCK_DOCS:
                    yield out()
                    block, start = block + 1, start + sum(counts)
                    ids, counts, frames, held = [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    placed.mapInArrow(lean(blocks), BLOCKS).write.parquet(f"{path}/blocks")
    sums = (
        spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select(
        "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint").alias("first_id")
    ).write.parquet(f"{path}/parts")  # one row per range partition


_BLOCKS = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("start", pa.int64()),
        ("n_ids", pa.int64()),
        ("first_doc", pa.int64()),
        ("last_doc", pa.int64()),
        ("dictionary", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("frames", pa.binary()),
    ]
)


def _dictionaries(spark: SparkSession, path: str) -> tuple[bytes, int, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()  # one row, bounded bytes
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["hash"]:
        raise ValueError("the dictionary does not match its hash")
    return data, row["width"], row["hash"]


def read_tokens(
    spark: SparkSession, path: str, doc_ids: list[int] | None = None, ids: bool = True
) -> DataFrame:
    """The documents of a store: `doc_id`, `start`, `n_tokens`, `ids_crc32` and, if wanted, `ids`.

    With `doc_ids`, only their blocks are read (first and last id are in the files' statistics) and
    only their slices decompressed. `ids_crc32` is over little-endian 32-bit ids.
    """
    shared, width, digest = _dictionaries(spark, path)
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_dict = zstandard.ZstdCompressionDict(shared) if shared else None
        unpack = zstandard.ZstdDecompressor(dict_data=with_dict)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError("a block was packed with another dictionary")
                got: list[list] = [[], [], [], [], []]
                start, offsets = row["first_id"] + row["start"], row["offsets"]
                for k, (doc_id, n) in enumerate(zip(row["doc_ids"], row["n_tokens"])):
                    if wanted is None or doc_id in wanted:
                        frame = row["frames"][offsets[k] : offsets[k + 1]]
                        data = np.frombuffer(unpack.decompress(frame), f"<u{width}")
                        if len(data) != n:
                            raise ValueError("a document's ids do not match the index")
                        data = data.astype("<u4")
                        for column, v in zip(got, (doc_id, start, n, zlib.crc32(data))):
                            column.append(v)
                        got[4].append(data if ids else None)
                    start += n
                arrays = [pa.array(c, pa.int64()) for c in got[:4]]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    arrays.append(pa.array(got[4], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    blocks = spark.read.parquet(f"{path}/blocks")
    if wanted is not None:
        asked = sorted(wanted)
        if asked:  # what is pushed down to the files first
            blocks = blocks.where((F.col("first_doc") <= asked[-1]) & (F.col("last_doc") >= asked[0]))
        listed = F.lit(np.array(asked, np.int64))
        blocks = blocks.where(
            F.exists(listed, lambda i: (F.col("first_doc") <= i) & (F.col("last_doc") >= i))
        )
    parts = spark.read.parquet(f"{path}/parts")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return blocks.join(parts, "part").mapInArrow(
        documents, schema + (", ids array<bigint>" if ids else "")
    )
