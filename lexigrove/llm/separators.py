"""Token counts of the documents in flat, unindexed token files, by a scan for the end-of-document id.

A file is nothing but ids of two or four bytes, little-endian. It is read in blocks of equal size, which any
executor can read by their offsets, and each block's separators are found by one vector comparison. A
document can begin many blocks before it ends: what a block needs from those before it, the number
of separators and the place of the last one, comes from an exclusive prefix scan over (count, last
place) of the blocks, within files first and then over the files' totals.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store
from . import tokens

#: Ids of a block.
BLOCK = 1 << 21
#: End-of-document id of the queries' vocabulary, which no text can spell when special tokens are off.
EOD = 49407


def write_flat(docs: DataFrame, folder: str, tokenizer: str, eod: int = EOD, width: int = 2) -> DataFrame:
    """Flat files of the documents' ids, each document followed by ``eod``: (part, name, n_ids, k, doc_ids).

    A part is a partition of ``docs`` as it is read, so that nothing is shuffled; a null text is empty. A
    file is written batch by batch, and every batch has a row: its ids, the file's documents before it and
    ``doc_ids``, the writer's own note of what it wrote; the files hold ids alone. An id that ``width`` bytes
    cannot hold is an error.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokens.pieces(tokenizer, literal=True)
        with contextlib.ExitStack() as files:
            f, k = None, 0
            for batch in batches:
                for some in tokens.slices(batch, 2048):
                    ids, _ = tokens.ended(*memo.encode(some.column("text")), eod)
                    if int(ids.max()) >> (8 * width):
                        raise ValueError(f"an id does not fit {width} bytes")
                    part = some.column("part")[0].as_py()
                    name = f"part-{part:06d}.tokens"
                    f = f or files.enter_context(tokens.writing(folder, name))
                    f.write(ids.astype(f"<u{width}").tobytes())
                    row = {"part": part, "name": name, "n_ids": len(ids), "k": k, "doc_ids": some.column("doc_id").to_pylist()}
                    yield pa.RecordBatch.from_pylist([row], schema=_NOTED)
                    k += some.num_rows

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = source.withColumn("part", F.spark_partition_id())
    return store.materialise(placed.mapInArrow(encode, "part int, name string, n_ids long, k long, doc_ids array<long>"), "flat-manifest", records=2048)


_NOTED = pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_ids", pa.int64()), ("k", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])


def scan(files: DataFrame, folder: str, eod: int = EOD, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(part, k, doc_no, start, n_tokens, ended): every document of the files, in their order.

    ``files``: (part, name, n_ids), parts in corpus order. ``k`` counts in the file and ``doc_no`` in the
    corpus, from 0; ``start`` is the corpus position of the first id; ``n_tokens`` leaves the
    separator out. Ids after the last separator of a file are a document that is not ``ended``. Files
    without ids have no documents.
    """
    blocks = files.where("n_ids > 0").select("part", "name", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {block}"))).alias("block"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(tokens.read_range(folder, row.name, row.block * block * width, block * width), f"<u{width}")
                at = np.flatnonzero(ids == eod) + row.block * block
                yield pd.DataFrame({"part": [row.part], "block": [row.block], "n_ids": [row.n_ids], "at": [at], "n": [len(at)], "last": [int(at[-1]) if len(at) else -1]})

    n_blocks = max(1, blocks.count())
    found = blocks.repartition(n_blocks, "part", "block").mapInPandas(find, "part int, block long, n_ids long, at array<long>, n long, last long")
    found = store.materialise(found, "separator-blocks")
    # The prefix scan, within files and over files.
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("part", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("k0"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("prev"))
    totals = found.groupBy("part").agg(F.first("n_ids").alias("n_ids"), F.sum("n").alias("n"), F.max("last").alias("last"))
    tail = F.col("n_ids") - 1 - F.col("last")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    based = totals.select(
        "part", "n", "last", tail.alias("tail"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum(F.col("n") + F.when(tail > 0, 1).otherwise(0)).over(before), F.lit(0)).alias("doc0"),
    )
    based = store.materialise(based, "separator-files")
    stitched = found.join(store.materialise(scanned, "separator-scan"), ["part", "block"]).join(based.select("part", "base", "doc0"), "part")
    ends = F.concat(F.array("prev"), F.col("at"))
    entry = F.transform("at", lambda x, i: F.struct((F.col("k0") + i).alias("k"), (F.get(ends, i) + 1).alias("first"), x.alias("stop")))
    rows = stitched.select("part", "base", "doc0", F.explode(entry).alias("e"))
    closed = rows.select("part", "e.k", (F.col("doc0") + F.col("e.k")).alias("doc_no"), (F.col("base") + F.col("e.first")).alias("start"), (F.col("e.stop") - F.col("e.first")).alias("n_tokens"), F.lit(True).alias("ended"))
    open_ = based.where("tail > 0").select("part", F.col("n").alias("k"), (F.col("doc0") + F.col("n")).alias("doc_no"), (F.col("base") + F.col("last") + 1).alias("start"), F.col("tail").alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.unionByName(open_)


def token_counts(docs: DataFrame, tokenizer: str | None = None, eod: int = EOD, width: int = 2) -> DataFrame:
    """(doc_id, doc_no, start, n_tokens): the documents' token counts as the scan of flat files finds them.

    ``docs``: doc_id, text; more columns are ignored. Null and empty texts count 0; long texts are taken
    whole. Rows of one doc_id, equal ones too, are documents of their own. An empty table gives an empty
    result. The files go once they have been counted.
    """
    with store.scratch(docs.sparkSession):
        folder = store.new_path(docs.sparkSession, "flat-files")
        written = write_flat(docs, folder, tokenizer or tokens.default_tokenizer(), eod, width)
        files = store.materialise(written.groupBy("part", "name").agg(F.sum("n_ids").alias("n_ids")), "flat-files-sizes")
        noted = written.select("part", F.col("k").alias("k0"), F.posexplode("doc_ids").alias("at", "doc_id")).select("part", (F.col("k0") + F.col("at")).alias("k"), "doc_id")
        # A row a document on both sides: shuffled, never broadcast.
        counted = scan(files, folder, eod, width).hint("merge").join(noted.hint("merge"), ["part", "k"])
        return store.kept(counted.select("doc_id", "doc_no", "start", "n_tokens"), "token-counts")
