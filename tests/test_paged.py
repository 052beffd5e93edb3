"""Stored pages in batch and as a stream."""

import json

from siltwork.sources.paged import arriving_pages, stored_pages


def put(folder, node, page, posts):
    path = folder / f"node={node}" / f"page={page}"
    path.mkdir(parents=True)
    (path / "part-0.json").write_text("\n".join(json.dumps(p) for p in posts))


def post(i):
    return {"id": f"p{i}", "author": None if i % 3 else "ann", "body": f"line\nbreak {i} ä"}


def row(node, page, i):
    return (node, page, f"p{i}", None if i % 3 else "ann", None, f"line\nbreak {i} ä")


def test_reading_stops_at_a_short_page(spark, tmp_path):
    put(tmp_path, "a%20b", 0, [post(0), post(1)])
    put(tmp_path, "a%20b", 1, [post(2)])
    put(tmp_path, "a%20b", 2, [post(3)])  # behind a short page: never asked for
    put(tmp_path, "c", 0, [])
    put(tmp_path, "d", 1, [post(9)])  # the first page is missing
    got = stored_pages(spark, str(tmp_path), 2)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect())) == [row("a b", 0, 0), row("a b", 0, 1), row("a b", 1, 2)]
    assert stored_pages(spark, str(tmp_path / "nothing"), 2).collect() == []


def test_stream_goes_on(spark, tmp_path):
    put(tmp_path / "in", "a", 0, [post(0), post(1)])

    def run():
        stream = arriving_pages(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [row("a", 0, 0), row("a", 0, 1)]
    put(tmp_path / "in", "a", 1, [post(2)])
    put(tmp_path / "in", "b", 0, [post(3)])
    want = [row("a", 0, 0), row("a", 0, 1), row("a", 1, 2), row("b", 0, 3)]
    assert run() == want
    assert run() == want
    assert sorted(tuple(r) for r in stored_pages(spark, str(tmp_path / "in"), 2).collect()) == want
