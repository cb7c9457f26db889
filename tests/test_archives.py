"""The archive as a data source and sink, and batches that show all their tables or none."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from tallyforge.shared import shared_folder
from tallyforge.sources import batches
from tallyforge.sources.archive_source import ARROW, Archive, ArchiveReader, ArchiveStreamWriter, register

SCHEMA = "source string, external string, ts timestamp, payload string"
DAY = [datetime(2024, 1, d) for d in range(1, 10)]


def rows(*ids, source="a"):
    return [(source, str(i), DAY[i % 9], f"payload {i}") for i in ids]


def append(spark, folder, found):
    spark.createDataFrame(found, SCHEMA).coalesce(1).write.format("tallyforge_archive").mode("append").save(folder)


def archived(spark, folder):
    return spark.read.format("tallyforge_archive").load(folder)


def ids(df):
    return sorted(int(r.external) for r in df.collect())


def test_round_trip_and_filters(spark):
    register(spark)
    folder = shared_folder(spark, "archive")
    append(spark, folder, [*rows(1, 2), (None, "3", None, None)])
    append(spark, folder, rows(4, 5, source="b"))
    append(spark, folder, rows(6, 7, source="c"))
    append(spark, folder, [])
    every = archived(spark, folder)
    assert every.schema.simpleString() == "struct<source:string,external:string,ts:timestamp,payload:string>" and ids(every) == list(range(1, 8))
    assert {(r.external, r.payload, r.ts) for r in every.filter("external in ('3', '4')").collect()} == {("3", None, None), ("4", "payload 4", DAY[4])}
    assert ids(every.filter("source = 'b'")) == [4, 5] and ids(every.filter("source in ('a', 'c') and external <> '1'")) == [2, 6, 7]
    assert ids(every.filter("source is null")) == [3] and ids(every.filter("source = 'b' and source = 'c'")) == []
    assert ids(every.filter(F.col("ts") > F.lit(DAY[5]))) == [6, 7]


def test_filters_leave_out_files(spark):
    register(spark)
    folder = shared_folder(spark, "archive")
    for i, source in enumerate("abc"):
        append(spark, folder, rows(2 * i, 2 * i + 1, source=source))

    def files(*filters):
        reader = ArchiveReader(folder)
        left = list(reader.pushFilters(list(filters)))
        return [p for part in reader.partitions() for p in part.paths], left

    assert len(files()[0]) == 3
    assert [len(x) for x in files(EqualTo(("source",), "b"))] == [1, 0]
    assert len(files(In(("source",), ("a", "c")))[0]) == 2 and files(EqualTo(("source",), "zz"))[0] == []
    later = GreaterThan(("ts",), DAY[4])
    assert [len(x) for x in files(later)] == [1, 1] and len(files(later, LessThan(("ts",), DAY[1]))[0]) == 0


def test_stream_restarts_from_its_checkpoint(spark):
    register(spark)
    first, second, checkpoint = (shared_folder(spark, x) for x in ("archive", "archive", "stream"))

    def run():
        stream = spark.readStream.format("tallyforge_archive").load(first)
        stream.writeStream.format("tallyforge_archive").option("path", second).option("stream", "s").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return ids(archived(spark, second))

    append(spark, first, rows(1, 2))
    assert run() == [1, 2]
    assert run() == [1, 2]
    append(spark, first, rows(3))
    append(spark, first, rows(4, 4))
    assert run() == [1, 2, 3, 4, 4]


def test_a_stream_batch_counts_once_and_an_aborted_one_never(spark):
    register(spark)
    folder = shared_folder(spark, "archive")
    batch = lambda *n: iter([pa.Table.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in rows(*n)], schema=ARROW).to_batches()[0]])
    writer = ArchiveStreamWriter(folder, "s")
    for number, n in ((0, 1), (0, 1), (1, 2)):
        writer.commit([writer.write(batch(n)), None], number)
    lost = writer.write(batch(9))
    assert ids(archived(spark, folder)) == [1, 2]
    writer.abort([lost], 2)
    assert not Archive(folder).files.get_file_info(f"{Archive(folder).root}/{lost.files[0]['path']}").is_file
    ArchiveStreamWriter(folder, "t").commit([writer.write(batch(3))], 0)
    assert ids(archived(spark, folder)) == [1, 2, 3]
    with pytest.raises(Exception, match="appended"):
        spark.createDataFrame(rows(1), SCHEMA).write.format("tallyforge_archive").mode("overwrite").save(folder)


# -- batches of several tables


def parse(df):
    return {"facts": df.select("external", "payload"), "notes": df.filter("payload is null").select("external")}


def new_sources(tables):
    facts, known = tables("facts").select("external").distinct(), tables("entities")
    return {"entities": facts if known is None else facts.join(known, "external", "left_anti")}


def state(spark, folder):
    of = lambda name: None if (t := batches.read_table(spark, folder, name)) is None else sorted((r.external, r.batch) for r in t.collect())
    return of("facts"), of("entities"), sorted((r.batch, r.table, r.n_rows) for r in batches.account(spark, folder).collect())


def test_a_batch_is_seen_as_a_whole_or_not_at_all(spark):
    folder = shared_folder(spark, "batches")
    df = lambda *n: spark.createDataFrame(rows(*n), SCHEMA)

    def fails(tables):
        return {"late": tables("facts").select(F.raise_error(F.lit("lost")).alias("x"))}

    with pytest.raises(Exception, match="lost"):
        batches.commit_batch(spark, folder, 0, parse(df(1, 2)), [new_sources, fails])
    assert state(spark, folder) == (None, None, [])
    assert batches.commit_batch(spark, folder, 0, parse(df(1, 2)), [new_sources])
    first = state(spark, folder)
    assert first == ([("1", 0), ("2", 0)], [("1", 0), ("2", 0)], [(0, "entities", 2), (0, "facts", 2), (0, "notes", 0)])
    assert not batches.commit_batch(spark, folder, 0, parse(df(7)), [new_sources])
    assert state(spark, folder) == first
    with pytest.raises(Exception, match="lost"):
        batches.commit_batch(spark, folder, 1, parse(df(2, 3)), [fails])
    assert state(spark, folder) == first
    assert batches.commit_batch(spark, folder, 1, parse(df(2, 3)), [new_sources])
    facts, entities, _ = state(spark, folder)
    assert facts == [("1", 0), ("2", 0), ("2", 1), ("3", 1)] and entities == [("1", 0), ("2", 0), ("3", 1)]
    assert sorted((r.external, r.batch) for r in batches.newest(batches.read_table(spark, folder, "facts"), ["external"]).collect()) == [("1", 0), ("2", 1), ("3", 1)]


def test_stream_batches_go_on_after_a_failure(spark):
    register(spark)
    source, folder, checkpoint = (shared_folder(spark, x) for x in ("archive", "batches", "stream"))
    append(spark, source, rows(1))
    failing = [True]

    def once(tables):
        if failing.pop() if failing else False:
            raise RuntimeError("lost")
        return new_sources(tables)

    run = lambda: batches.stream_batches(spark.readStream.format("tallyforge_archive").load(source), folder, checkpoint, parse, [once])
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    assert state(spark, folder) == (None, None, [])
    run().awaitTermination()
    append(spark, source, rows(1, 2))
    run().awaitTermination()
    facts, entities, log = state(spark, folder)
    assert facts == [("1", 0), ("1", 1), ("2", 1)] and entities == [("1", 0), ("2", 1)]
