"""Polled feeds as a streaming source with an offset for each feed.

At each trigger every feed is asked once. An answer that differs from the feed's last one is put to a spool folder under the next number before the offset that counts it
is given out, so a batch that is tried again, also after a restart, reads the same answers. A feed that fails keeps its offset and is asked again at the
next trigger; the others go on. Answers that a batch has used up are deleted when the stream says so. The spool folder has to be one that driver and executors share, and belongs to one stream.
"""

import csv
import hashlib
import io
import json

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cindergrid.sources.grids import opened, put


def answer(address):
    """The text at an address that pyarrow can open."""
    store, where = opened(address)
    with store.open_input_stream(where) as f:
        return f.read().decode()


class Answers(InputPartition):
    def __init__(self, feed, number):
        self.feed, self.number = feed, number


class FeedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.feeds, self.spool = json.loads(options["feeds"]), options["path"]
        self.columns = [c.strip() for c in options["columns"].split(",")]

    def place(self, feed, number):
        return f"{self.spool}/{feed}/{number:012d}.csv"

    def stored(self, feed):
        """The numbers of a feed's answers in the spool, and the mark of its last one."""
        store, where = opened(f"{self.spool}/{feed}")
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(where, allow_not_found=True)) if f.is_file]
        mark = f"{self.spool}/{feed}/LAST"
        return max((int(n[:-4]) for n in names if n.endswith(".csv")), default=0), json.loads(answer(mark)) if "LAST" in names else {"number": 0, "mark": None}

    def initialOffset(self):
        return {feed: 0 for feed in self.feeds}

    def latestOffset(self):
        out, errors = {}, {}
        for feed, address in self.feeds.items():
            most, last = self.stored(feed)
            number = max(most, last["number"])
            try:
                text = answer(address)
                mark = hashlib.sha256(text.encode()).hexdigest()
                if text.strip() and mark != last["mark"]:
                    # The answer comes before its mark: after a failure between the two it is at worst stored twice, under two numbers that both count.
                    put(self.place(feed, number + 1), text.encode())
                    put(f"{self.spool}/{feed}/LAST", json.dumps({"number": number + 1, "mark": mark}).encode())
                    number += 1
            except Exception as e:  # a feed's failure is its own
                errors[feed] = type(e).__name__
            out[feed] = number
        put(f"{self.spool}/STATUS", json.dumps({feed: errors.get(feed) for feed in self.feeds}).encode())
        return out

    def partitions(self, start, end):
        return [Answers(feed, n) for feed in self.feeds for n in range(start.get(feed, 0) + 1, end.get(feed, 0) + 1)] or [Answers("", 0)]

    def read(self, part):
        if part.number:
            rows = list(csv.DictReader(io.StringIO(answer(self.place(part.feed, part.number)).strip())))
            n = len(rows)
            yield pa.record_batch([pa.array([part.feed] * n), pa.array([part.number] * n, pa.int64()), *[pa.array([r.get(c) for r in rows], pa.string()) for c in self.columns]], names=["feed", "answer", *self.columns])

    def commit(self, end):
        for feed, n in end.items():
            store, where = opened(f"{self.spool}/{feed}")
            for f in store.get_file_info(fs.FileSelector(where, allow_not_found=True)):
                if f.base_name.endswith(".csv") and int(f.base_name[:-4]) <= n:
                    store.delete_file(f.path)


class Feeds(DataSource):
    """feed, answer (its number) and the named columns of CSV answers as strings, null where an answer lacks them. Options: path (the spool), feeds (JSON: name -> address), columns."""

    @classmethod
    def name(cls):
        return "polled_feeds"

    def schema(self):
        return ", ".join(["feed string", "answer long", *[f"`{c.strip()}` string" for c in self.options["columns"].split(",")]])

    def streamReader(self, schema):
        return FeedReader(self.options)


def polled(spark, feeds, columns, spool):
    """A stream of the rows of all feeds' new answers. feeds: name -> address. How often they are asked is the stream's trigger."""
    spark.dataSource.register(Feeds)
    return spark.readStream.format("polled_feeds").option("feeds", json.dumps(feeds)).option("columns", ",".join(columns)).load(spool)
