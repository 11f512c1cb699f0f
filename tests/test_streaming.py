import time

from tessera.streaming.watch import LISTING, FolderReader, Looks, differences, latency_windows, listed, snapshot, watch


def test_watch_sees_new_changed_and_removed_files(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("1")
    seen: list[tuple[str, str]] = []

    def on_change(changes):
        seen.extend((r.path.rsplit("/", 1)[-1], r.change) for r in changes.collect())
        if len(seen) == 2:
            raise RuntimeError("a failed scan doesn't end the watch")

    query = watch(spark, str(root), on_change, str(tmp_path / "checkpoint"), every_ms=100)

    def until(n):
        end = time.time() + 60
        while len(seen) < n and time.time() < end:
            time.sleep(0.1)

    try:
        until(1)
        (root / "b.md").write_text("2")
        until(2)
        (root / "a.md").write_text("longer")
        until(3)
        (root / "b.md").unlink()
        until(4)
    finally:
        query.stop()
    assert seen == [("a.md", "added"), ("b.md", "added"), ("a.md", "updated"), ("b.md", "removed")]
    assert snapshot(str(root)).keys() == {str(root / "a.md")}


def test_offsets_stay_small_and_parts_share_the_files(tmp_path):
    for i in range(50):
        (tmp_path / f"{i}.md").write_text("x")
    reader = FolderReader(str(tmp_path), 3)
    assert len(str(reader.latestOffset())) < 40 and len(reader.partitions({}, {})) == 3
    parts = [dict(reader.read(p)) for p in reader.partitions({}, {})]
    assert all(parts) and sum(map(len, parts)) == 50 and {k: v for p in parts for k, v in p.items()} == snapshot(str(tmp_path)) == dict(listed(str(tmp_path)))


def test_two_looks_and_what_was_handled(spark, tmp_path):
    looks, frame = Looks(spark, str(tmp_path)), lambda **files: spark.createDataFrame(list(files.items()), LISTING)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(differences(frame(a="1", b="1"), frame(b="2", c="1"))) == [("a", "removed"), ("b", "updated"), ("c", "added")]
    assert looks.changes(frame(a="1"), 0) is None and looks.changes(frame(a="2"), 1) is None  # not quiet yet
    changes, now = looks.changes(frame(a="2"), 2)
    assert rows(changes) == [("a", "added")]
    looks.handle(now, 2)
    assert looks.changes(frame(a="2"), 3)[0].isEmpty() and looks.changes(frame(), 4) is None
    changes, now = looks.changes(frame(), 5)
    assert rows(changes) == [("a", "removed")]
    looks.handle(now, 5)
    again = Looks(spark, str(tmp_path))
    assert again.handled().isEmpty() and again.changes(frame(), 6)[0].isEmpty()


def test_latency_windows_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    query = latency_windows(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("latency_stream").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    batch = {r.window.start: r.samples for r in latency_windows(events, "1 day").collect()}
    assert {r.window.start: r.samples for r in spark.table("latency_stream").collect()} == batch
