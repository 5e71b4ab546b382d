"""CSV records with line breaks in quoted fields, cut out by many tasks.

A file is read as lines, block by block.  Whether a block begins inside quotes is not known
to its task, so:

1. every block counts its quotes, and the records that begin in it under both
   assumptions; one row a block;
2. prefix sums over these rows tell each block its state at the start and the number of
   its first record;
3. every task cuts its blocks into records.  A record that crosses a block's end leaves one
   piece in each block it touches; only these pieces (at most two a block) are shuffled and joined.

No text but theirs moves, and a file of any size is read by as many tasks as it has
blocks.  Quotes inside a quoted field are doubled (``""``), so they do not change the state; a
single quote character inside an unquoted field is not legal CSV and not recognised as such.
Lines end with LF or CR LF; empty lines between records are no records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parindex.functions.sizing import per_partition

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"))


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, quotes, records begun if the block begins outside quotes, inside quotes)."""
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        path, block, line = batch.columns
        quotes = pc.count_substring(line, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
        filled = ~pc.is_in(line, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        for key, at in _runs(list(zip(path.to_pylist(), block.to_pylist()))):
            got = found.setdefault(key, [0, 0, 0])
            inside = (got[0] + np.cumsum(quotes[at]) - quotes[at]) % 2
            got[0] += int(quotes[at].sum())
            got[1] += int((filled[at] & (inside == 0)).sum())
            got[2] += int((filled[at] & (inside == 1)).sum())
    rows = [(*key, *got) for key, got in found.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(("path", "block", "quotes", "outside", "inside"), r)) for r in rows],
                                     schema=pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in (
                                         "block", "quotes", "outside", "inside")]]))


def _runs(keys: list) -> Iterator[tuple]:
    """Stretches of equal keys as (key, slice)."""
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], slice(start, i)
            start = i


def block_states(lines: DataFrame, skip_first: bool) -> DataFrame:
    """``(path, block, number, opens, closes, first)``: whether the block begins and ends inside quotes, and the id
    of the first record that begins in it (below zero: the skipped first record of a file)."""
    blocks = lines.mapInArrow(_count_blocks, "path string, block long, quotes long, outside long, inside long")
    file = Window.partitionBy("path").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("opens", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("begun", F.when(F.col("opens") == 0, F.col("outside")).otherwise(F.col("inside")))
    blocks = blocks.withColumn("earlier", F.coalesce(F.sum("begun").over(before), F.lit(0)))
    skip = 1 if skip_first else 0
    files = blocks.groupBy("path").agg(F.greatest(F.sum("begun") - skip, F.lit(0)).alias("records"))
    ahead = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("records").over(ahead), F.lit(0)).alias("ahead"))
    return blocks.join(files, "path").select(
        "path", "block", F.row_number().over(Window.orderBy("path", "block")).cast("long").alias("number"),
        (F.col("opens") == 1).alias("opens"), ((F.col("opens") + F.col("quotes")) % 2 == 1).alias("closes"),
        F.col("ahead").alias("ahead"), (F.col("earlier") - skip).alias("index"))


_RECORDS = "rec long, part long, text string"


def _cut(pieces: bool) -> Callable:
    """Records that lie in one block, or (``pieces``) the parts of the others with their block's number."""
    def run(batches):
        state = None  # block number, inside quotes, id of the open record, its lines, whether it began here
        for batch in batches:
            out: list[tuple] = []
            number, opens, ahead, index, line = batch.columns
            quotes = pc.count_substring(line, QUOTE).to_pylist()
            texts = line.to_pylist()
            opens, ahead, index = opens.to_pylist(), ahead.to_pylist(), index.to_pylist()
            for block, at in _runs(number.to_pylist()):
                if state is None or state[0] != block:
                    if state is not None:
                        _leave(state, out, pieces)
                    i = at.start
                    # the record that is open at a block's start is the one before its first
                    state = [block, opens[i], index[i], [], False, ahead[i]]
                    if opens[i]:
                        state[2] -= 1
                for text, n in zip(texts[at], quotes[at]):
                    if not state[1]:
                        if text == "" or text == "\r":
                            continue
                        state[3], state[4] = [], True
                    state[3].append(text)
                    if n % 2:
                        state[1] = not state[1]
                    if not state[1]:
                        _done(state, out, pieces)
            yield _batch(out)
        if state is not None:
            out = []
            _leave(state, out, pieces)
            yield _batch(out)

    return run


def _done(state: list, out: list, pieces: bool) -> None:
    """The open record ends here."""
    if pieces != state[4] and state[2] >= 0:  # a record that did not begin here is the end of another block's
        out.append((state[5] + state[2], state[0] if pieces else None, "\n".join(state[3])))
    state[2] += 1
    state[3], state[4] = [], False


def _leave(state: list, out: list, pieces: bool) -> None:
    """The block ends inside a record."""
    if state[1] and state[3] and pieces and state[2] >= 0:
        out.append((state[5] + state[2], state[0], "\n".join(state[3])))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
        columns, (pa.int64(), pa.int64(), pa.string()))], names=["rec", "part", "text"])


def csv_records(spark: SparkSession, path: str, skip_first: bool = False) -> DataFrame:
    """``(rec, text)``: every record of the files under ``path``, numbered from 0 in the order of file
    names; ``skip_first`` leaves out each file's first record."""
    lines = _lines(spark, path)
    states = block_states(lines, skip_first)
    # one row a block of a file: the states grow with the number of tasks, not with the records
    told = lines.join(per_partition(states), ["path", "block"])
    columns = ["number", "opens", "ahead", "index", "line"]
    whole = told.select(*columns).mapInArrow(_cut(False), _RECORDS).select("rec", "text")
    pieces = told.filter(F.col("opens") | F.col("closes")).select(*columns).mapInArrow(_cut(True), _RECORDS)
    crossing = pieces.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p")) \
        .select("rec", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(crossing).select("rec", F.regexp_replace("text", "\r$", "").alias("text"))
