"""Labelled corpora in three text formats, each as ``text, label``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from broadsheet.functions.core import is_blank, ws_trim
from broadsheet.session import kept

SEPARATOR = "_!_"


_CSV_SCHEMA = "category string, title string"
_CSV_OPTIONS = {"quote": '"', "escape": '"'}
# Splits of a corpus whose quote state is broadcast, a few bytes each; 100 TB have fewer.
_MOST_SPLITS = 2_000_000


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """``Category,Title`` CSV with a header and optional quotes; blank or short rows drop out.

    Quoted titles may span lines, and large files are read by many tasks all the same
    (``csv_records``).
    """
    parsed = csv_records(spark, path).select(
        F.from_csv(F.col("record"), F.lit(_CSV_SCHEMA), {**_CSV_OPTIONS, "mode": "PERMISSIVE"}).alias("row")
    ).select("row.*")
    return parsed.select(
        ws_trim(F.col("title")).alias("text"), ws_trim(F.col("category")).alias("label")
    ).filter(~is_blank(F.col("text")) & ~is_blank(F.col("label")))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the records of quoted CSV files without their headers, line breaks included.

    A line break inside quotes ends no record, and where a file is split nobody knows whether a
    quote is open. So every split first says how it would end if it began inside quotes and if it
    did not: the same, turned over, or one way whatever it began with. Window functions over the
    splits of a file put these together; then every task tells its own records. Records within a
    split stay where they are; only those that cross splits, at most two pieces a split, are
    shuffled together.

    A quote opens a field only where the field begins. One that is never closed runs to the end of
    its file. Lines end with a line feed, or with a carriage return before it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
    )
    quoted = lines.withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")))
    ends = quoted.mapInArrow(_split_ends, "file string, start long, if_out int, if_in int")
    begun = kept(_split_begins(ends))
    if begun.count() > _MOST_SPLITS:
        raise ValueError(f"more than {_MOST_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    pieces = lines.join(F.broadcast(begun), ["file", "start"]).mapInArrow(
        _pieces, "file string, start long, line long, opens boolean, closes boolean, value string"
    )
    # The header is the first record of a file.
    pieces = pieces.filter(~((F.col("start") == 0) & (F.col("line") == 0)))
    whole = pieces.filter(F.col("opens") & F.col("closes")).select(F.col("value").alias("record"))
    parts = pieces.filter(~(F.col("opens") & F.col("closes")))
    # A record that crosses splits: its first piece opens it, those behind carry on.
    order = Window.partitionBy("file").orderBy("start", "line")
    numbered = parts.withColumn("number", F.sum(F.col("opens").cast("int")).over(order)).filter("number > 0")
    values = F.transform(F.array_sort(F.collect_list(F.struct("start", "line", "value"))), lambda p: p["value"])
    crossing = numbered.groupBy("file", "number").agg(F.array_join(values, "\n").alias("record"))
    return whole.unionByName(crossing.select("record"))


def _split_begins(ends: DataFrame) -> DataFrame:
    """``file, start, open``: whether each split begins inside quotes."""
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = ends.withColumn("turns", F.sum(((F.col("if_out") == 1) & (F.col("if_in") == 0)).cast("int")).over(upto))
    # A split that ends one way in any case makes what was before it irrelevant.
    fixed = F.when(F.col("if_out") == F.col("if_in"), F.struct(F.col("if_out").alias("state"), F.col("turns").alias("turns")))
    based = turned.withColumn("base", F.last(fixed, ignorenulls=True).over(upto))
    state = F.coalesce("base.state", F.lit(0)) + F.col("turns") - F.coalesce("base.turns", F.lit(0))
    before = Window.partitionBy("file").orderBy("start")
    return based.withColumn("state", (state % 2).cast("int")).select(
        "file", "start", (F.lag("state", 1, 0).over(before) == 1).alias("open")
    )


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind a line, given whether one was before it."""
    at = 0
    while True:
        if not inside and line[at : at + 1] == '"':
            inside, at = True, at + 1
        if inside:
            close = line.find('"', at)
            if close < 0:
                return True
            if line[close + 1 : close + 2] == '"':
                at = close + 2
                continue
            inside, at = False, close + 1
        at = line.find(",", at) + 1
        if not at:
            return False


def _split_ends(batches):
    """Per split how it ends, begun outside quotes and begun inside."""
    split, out, within = None, False, True

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([split[0]], pa.string()), pa.array([split[1]], pa.int64()), pa.array([out], pa.int32()), pa.array([within], pa.int32())],
            ["file", "start", "if_out", "if_in"],
        )

    for batch in batches:
        for file, start, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
            if (file, start) != split:
                if split is not None:
                    yield row()
                split, out, within = (file, start), 0, 1
            if value is not None:
                out, within = int(ends_inside(value, bool(out))), int(ends_inside(value, bool(within)))
    if split is not None:
        yield row()


def _pieces(batches):
    """Lines of one record within one split, joined, in order.

    A piece ``opens`` if a record begins with it and ``closes`` if one ends with it.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    names = ["file", "start", "line", "opens", "closes", "value"]
    split, line, lines, opens, inside, done = None, 0, [], True, False, []

    def piece(closes: bool) -> None:
        done.append((*split, line, opens, closes, "\n".join(lines)))

    def table() -> pa.RecordBatch:
        rows, done[:] = list(done), []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for file, start, begun, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "open", "value"))):
            if (file, start) != split:
                if lines:
                    piece(False)
                split, line, lines, opens, inside = (file, start), 0, [], not begun, begun
            lines.append(value.removesuffix("\r"))
            if inside or '"' in value:
                inside = ends_inside(value, inside)
            if not inside:
                piece(True)
                line, lines, opens = line + 1, [], True
        if done:
            yield table()
    if lines:
        piece(False)
        yield table()


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """``_!_`` lines: the third field is the label, the fourth the title.

    Short lines keep their row with nulls; ``corpus_rejects`` counts them and ``corpus_rows``
    drops them.
    """
    parts = F.split("value", SEPARATOR)
    return spark.read.text(path).select(
        F.get(parts, F.lit(3)).alias("text"), F.get(parts, F.lit(2)).alias("label")
    )


def read_plain_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma lines without quoting, one header line per file.

    The second field is the text, the third the label; short lines keep their row with nulls.
    """
    # Read as whole lines: the separator is a code point that no text may hold. The CSV reader
    # is wanted for the headers it skips, wherever a file is split.
    lines = spark.read.csv(path, schema="line string", header=True, sep="\uffff", quote="")
    parts = F.split("line", ",")
    return lines.select(F.get(parts, F.lit(1)).alias("text"), F.get(parts, F.lit(2)).alias("label"))


def corpus_rows(lines: DataFrame) -> DataFrame:
    """The complete rows of a line source."""
    return lines.filter(F.col("text").isNotNull() & F.col("label").isNotNull()).select(
        "text", "label"
    )


def corpus_rejects(lines: DataFrame) -> DataFrame:
    """How many lines had too few fields."""
    short = F.col("text").isNull() | F.col("label").isNull()
    return lines.agg(F.count_if(short).alias("rejected"), F.count("*").alias("lines"))
