"""Token ids of a corpus in compressed files, by ascending doc_id, and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store
from . import rangecoder, tokens
from .memory import returned

#: Id after each document.
END = 2
#: Documents that are tokenized at once.
BATCH = 4096
#: Ids of a file, about: the file that reaches it is closed after the document. The coder takes least time an id for full files.
IDS = 3 << 22

MANIFEST = "part int, seq int, name string, n_docs long, n_ids long, n_bytes long"


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END, rows: int = tokens.ROWS, most: int = IDS) -> DataFrame:
    """Write the ids of every text and return the manifest: (part, seq, name, n_docs, n_ids, n_bytes) by file.

    Texts are tokenized whole, without special tokens added; ``end`` follows each. A null text is
    empty. A part holds about ``rows`` documents in files of about ``most`` ids, so that long texts
    make more files and not larger ones; parts, files and documents ascend by doc_id, null first.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokens.pieces(tokenizer)
        ids, lengths, doc_ids, held, seq = [], [], [], 0, 0

        def close(part: int) -> pa.RecordBatch:
            nonlocal ids, lengths, doc_ids, held, seq
            flat, ids = np.concatenate(ids), []
            data = rangecoder.pack(flat, doc_ids, np.concatenate(lengths))
            tokens.write_file(folder, name := f"part-{part:06d}-{seq:04d}.lxcm", data)
            row = {"part": part, "seq": seq, "name": name, "n_docs": len(doc_ids), "n_ids": len(flat), "n_bytes": len(data)}
            lengths, doc_ids, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        part = None
        for batch in batches:
            for some in tokens.slices(batch, BATCH):
                part = some.column("part")[0].as_py()
                own, n = tokens.ended(*memo.encode(some.column("text")), end)
                ids.append(own)
                lengths.append(n)
                doc_ids += some.column("doc_id").to_pylist()
                held += len(own)
                if held >= most:
                    yield close(part)
        if doc_ids:
            yield close(part)

    placed = tokens.in_order(docs, rows).withColumn("part", F.spark_partition_id())
    return store.materialise(placed.mapInArrow(returned(encode), MANIFEST), "token-manifest", records=BATCH)


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files of a manifest.

    ``start`` counts the ids of all documents before; the checksum is over the document's ids as
    little-endian unsigned 32-bit integers, the end id included.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, name in zip(batch["part"], batch["seq"], batch["name"], strict=True):
                ids, doc_ids, lengths = rangecoder.unpack(tokens.read_range(folder, name))
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.array(doc_ids, "Int64"), "offset": ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    base = store.materialise(manifest.select("part", "seq", F.coalesce(before, F.lit(0)).alias("base")), "token-base")
    files = max(1, manifest.count())
    rows = manifest.select("part", "seq", "name").repartition(files, "part", "seq").mapInPandas(returned(decode), "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Write the files to a new folder of the shared directory and read the documents back from them.

    ``docs``: doc_id, text; more columns are ignored. Rows of one doc_id are documents of their own, by a
    hash of their text. Null and empty texts hold the end id alone; long texts are taken whole. An empty
    table gives an empty result. The files go once they have been read.
    """
    with store.scratch(docs.sparkSession):
        folder = store.new_path(docs.sparkSession, "token-files")
        return store.kept(read(write(docs, folder, tokenizer or tokens.default_tokenizer(), end), folder), "token-rows")
