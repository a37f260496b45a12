"""XML elements from splits of bytes, in batches and streams, and the sink that shows whole batches only."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.sources import elements as E
from shelfwise.sources import io


@pytest.fixture(scope="module")
def session(spark):
    return E.registered(spark)


def test_every_split_and_window_gives_the_same():
    rnd = random.Random(4)
    pieces = ["<item>", "</item>", "<item", ' a="1">', "<g:item>x</g:item>", "<item/>", "<items>", "</items>", "text", "\n", "<g:it", "é", "<item >y</item >", "</channel>", "<"]
    for _ in range(60):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(30))).encode()
        # Without elements in elements of the same name
        plain = re.sub(rb"<(?:\w+:)?item(?=[\s>/])[^>]*(?<!/)>(?:(?!</(?:\w+:)?item\s*>).)*<(?:\w+:)?item(?=[\s>/])", b"", text, flags=re.S)
        if plain != text or not text:
            continue
        read = lambda size, window: [x for at in range(0, len(text), size) for x in E.elements_of(pa.BufferReader(text), "item", at, min(at + size, len(text)), window)]  # noqa: E731, B023
        whole = read(len(text), 1 << 20)
        assert all(text[at : at + len(e)] == e for at, e in whole)
        for size in (1, 3, 17, 64):
            for window in (1, 5, 300):
                assert read(size, window) == whole


def test_elements_by_hand():
    text = b'<rss>\n<item>a</item><x:item id="1">b</x:item>\n<item/><items>no</items><item a="/" />c<item>never closed'
    got = [e for _, e in E.elements_of(pa.BufferReader(text), "item", 0, len(text), 7)]
    assert got == [b"<item>a</item>", b'<x:item id="1">b</x:item>', b"<item/>", b'<item a="/" />']
    large = b"<item>" + b"z" * 5_000_000 + b"</item><item>q</item>"
    assert [len(e) for _, e in E.elements_of(pa.BufferReader(large), "item", 0, len(large))] == [5_000_013, 14]


def _feed(folder, name, ids, at):
    item = "<item><g:id>{0}</g:id><g:title>Frame &amp; x 10</g:title><g:link>https://a/f-{0}</g:link><g:price>{1}.50 GBP</g:price></item>"
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write('<rss xmlns:g="http://base.google.com/ns/1.0">' + "\n".join(item.format(f"S{i}", i + 1) for i in ids) + "</rss>")
    os.utime(path, ns=(at, at))


def _set(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batch_and_stream_agree(session, tmp_path):
    folder, out, check = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "check")
    batch = lambda size: session.read.format("elements").option("splitBytes", size).load(folder)

    def run():
        stream = session.readStream.format("elements").option("splitBytes", 333).load(folder)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        return session.read.schema(stream.schema).parquet(out)

    _feed(folder, "b.xml", range(40), 1_700_000_000_000_000_000)
    _feed(folder, ".hidden.xml", range(3), 1_700_000_000_000_000_000)
    (tmp_path / "feed" / "empty.xml").write_text("")
    assert run().count() == 40
    # Another of the same time with a later name, and one of a later time with an earlier name
    _feed(folder, "c.xml", range(40, 60), 1_700_000_000_000_000_000)
    _feed(folder, "a.xml", range(60, 75), 1_700_000_000_000_000_001)
    os.utime(tmp_path / "feed" / "empty.xml", ns=(1, 1))
    whole = batch(1 << 26)
    assert whole.count() == 75 and batch(333).rdd.getNumPartitions() > 20
    assert _set(batch(333)) == _set(whole)
    feed = E.feed_elements(whole)
    assert _set(feed) == _set(io.read_feed(session, folder)) and feed.where("full_title = 'Frame & x 10'").count() == 75
    assert _set(E.sitemap_elements(whole)) == []


def test_a_stream_goes_on_where_it_was(session, tmp_path):
    reader = E.ElementStreamReader({"path": str(tmp_path / "feed"), "splitBytes": "100"})
    t = 1_700_000_000_000_000_000
    _feed(str(tmp_path / "feed"), "b.xml", range(4), t)
    first = reader.latestOffset()
    _feed(str(tmp_path / "feed"), "c.xml", range(4, 6), t)
    _feed(str(tmp_path / "feed"), "a.xml", range(6, 9), t + 1)
    second = reader.latestOffset()
    names = lambda a, b: {os.path.basename(s.path) for s in reader.partitions(a, b)}
    assert names(reader.initialOffset(), first) == {"b.xml"} and names(first, second) == {"c.xml", "a.xml"} and names(second, second) == set()
    rows = sum(batch.num_rows for s in reader.partitions(first, second) for batch in reader.read(s))
    assert rows == 5
    assert E.ElementStreamReader({"path": str(tmp_path / "feed"), "settle": "1e12"}).latestOffset() == reader.initialOffset()


def test_a_failed_write_leaves_nothing(session, tmp_path):
    path = str(tmp_path / "out")
    rows = session.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 3 != 0, 'x "y", z').alias("b"))
    failing = rows.withColumn("b", F.when(F.col("a") == "990", F.raise_error(F.lit("no more"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="no more"):
        failing.write.format("whole_csv").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    for n in (1, 2):
        rows.write.format("whole_csv").mode("append").save(path)
        assert len(os.listdir(path)) == n
        back = session.read.option("header", True).option("escape", '"').csv(f"{path}/job-*")
        assert _set(back.distinct()) == _set(rows) and back.count() == 1000 * n
    with pytest.raises(Exception, match="cast id"):
        session.range(3).write.format("whole_csv").mode("append").save(path)
    rows.limit(0).write.format("whole_csv").mode("append").save(str(tmp_path / "none"))
    assert [f for _, _, fs in os.walk(tmp_path / "none") for f in fs] == []


def test_a_batch_of_a_stream_is_written_once(session, tmp_path):
    path = str(tmp_path / "out")

    def rows(*values):
        return iter([pa.RecordBatch.from_pydict({"a": list(values)})])

    def write(number, value):
        to, name = E.WholeCsvStreamWriter(path, ["a"]), f"batch-{number:09d}"
        messages = [to.fill(name, rows(value, None, "")), to.fill(name, iter([]))]
        to.fill(name, rows("of a task that ran twice"))
        E.WholeCsvStreamWriter(path, ["a"]).commit(messages, number)

    write(0, "x")
    write(1, "y")
    write(1, "again")
    texts = sorted(f.read_text() for f in (tmp_path / "out").glob("batch-*/*.csv"))
    assert texts == ['"a"\n"x"\n\n""\n', '"a"\n"y"\n\n""\n'] and len(os.listdir(path)) == 2
    E.WholeCsvStreamWriter(path, ["a"]).fill("batch-000000002", rows("z"))
    assert len(os.listdir(path)) == 3
    E.WholeCsvStreamWriter(path, ["a"]).abort([None], 2)
    assert len(os.listdir(path)) == 2


def test_stream_into_the_sink(session, tmp_path):
    _feed(str(tmp_path / "feed"), "a.xml", range(30), 1_700_000_000_000_000_000)
    stream = E.feed_elements(session.readStream.format("elements").load(str(tmp_path / "feed"))).select("sku_id", F.col("price_ex_vat").cast("string").alias("price"))
    q = stream.writeStream.format("whole_csv").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert _set(session.read.option("header", True).csv(str(tmp_path / "out" / "batch-*"))) == sorted((f"S{i}", f"{i + 1}.5") for i in range(30))
