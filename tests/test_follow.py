"""Growing files: appends, rotation, cuts and restarts lose and double no line."""

import os
import random
import shutil

import pytest

from logweave.sources.follow import follow_lines, follow_log_files


class Run:
    """A stream that is restarted for every step, so that all it knows is its checkpoint."""

    def __init__(self, spark, path, cp, **options):
        self.spark, self.path, self.cp, self.options, self.got = spark, path, cp, options, []

    def step(self):
        def take(df, _):
            self.got += [(r.file, r.offset, r.line) for r in df.collect()]
        query = (follow_lines(self.spark, self.path, **self.options).writeStream.foreachBatch(take)
                 .option("checkpointLocation", self.cp).trigger(availableNow=True).start())
        query.awaitTermination()
        return [x[2] for x in self.got]


def write(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text.encode())


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    return Run(spark, str(tmp_path / "in" / "app.log*"), str(tmp_path / "cp"), split_bytes=40), tmp_path / "in"


def test_appends_and_partial_lines(run):
    stream, folder = run
    assert stream.step() == []
    write(folder / "app.log", "one\ntwo\nthr")
    assert stream.step() == ["one", "two"]
    write(folder / "app.log", "ee\r\n\nfo")
    write(folder / "other.txt", "no\n")
    assert stream.step() == ["one", "two", "three", ""]
    assert stream.step() == ["one", "two", "three", ""]
    write(folder / "app.log", "ur\n")
    stream.step()
    assert stream.got == [("app.log", 0, "one"), ("app.log", 4, "two"), ("app.log", 8, "three"), ("app.log", 15, ""), ("app.log", 16, "four")]


def test_rename_copy_and_cut(run):
    stream, folder = run
    log = folder / "app.log"
    write(log, "a1\na2\n")
    stream.step()
    write(log, "a3\n")  # not read before the file is renamed
    os.rename(log, folder / "app.log.1")
    write(log, "b1\n")
    assert sorted(stream.step()) == ["a1", "a2", "a3", "b1"]
    write(folder / "app.log.1", "a4\n")  # the old writer still holds it
    os.rename(folder / "app.log.1", folder / "app.log.2")
    os.rename(log, folder / "app.log.1")
    write(folder / "app.log.1", "b2\n")
    write(log, "c1\nc2\n")
    assert sorted(stream.step()) == ["a1", "a2", "a3", "a4", "b1", "b2", "c1", "c2"]
    write(log, "c3\n")
    shutil.copy(log, folder / "app.log.0")  # seen between copy and cut
    assert sorted(stream.step())[-3:] == ["c1", "c2", "c3"]
    write(log, "", "wb")
    write(log, "d1\n")
    assert sorted(stream.step())[-4:] == ["c1", "c2", "c3", "d1"]
    write(log, "d2\nd3\n")
    shutil.copy(log, folder / "app.log.00")  # copied and cut between two looks
    write(log, "e1, a line longer than all that was there before\n", "wb")
    assert sorted(stream.step())[-5:] == ["c3", "d1", "d2", "d3", "e1, a line longer than all that was there before"]
    write(log, "f1\n", "wb")  # cut without a copy
    assert sorted(stream.step())[-2:] == ["e1, a line longer than all that was there before", "f1"]
    assert len(stream.got) == len(set(x[2] for x in stream.got))


def test_equal_files_of_different_writers(run):
    stream, folder = run
    for name in ("app.log-a", "app.log-b"):
        write(folder / name, "started\n")
    assert stream.step() == ["started"] * 2
    write(folder / "app.log-b", "more\n")
    assert stream.step() == ["started", "started", "more"]


def test_random_life(run):
    stream, folder = run
    rng = random.Random(4)
    want, n, pending = [], 0, ""
    for _ in range(12):
        for _ in range(rng.randrange(1, 5)):
            lines = [f"line {n + i} " + "x" * rng.randrange(60) for i in range(rng.randrange(4))]
            n += len(lines)
            text = pending + "".join(x + "\n" for x in lines)
            cut = rng.randrange(len(text) + 1) if rng.random() < 0.5 else len(text)
            write(folder / "app.log", text[:cut])
            pending = text[cut:]
            want += lines
        if rng.random() < 0.4:
            write(folder / "app.log", pending)
            pending = ""
            for k in range(8, 0, -1):
                if (folder / f"app.log.{k}").exists():
                    os.rename(folder / f"app.log.{k}", folder / f"app.log.{k + 1}")
            os.rename(folder / "app.log", folder / "app.log.1")
            write(folder / "app.log", "")
        stream.step()
    write(folder / "app.log", pending)
    assert sorted(stream.step()) == sorted(want)


def test_batch_that_runs_again_after_rotation(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "x.log", "one\ntwo\n")
    got, fail = [], [True]

    def take(df, _):
        got.extend(r.line for r in df.collect())
        if fail[0]:
            raise OSError("down")

    def start():
        return (follow_lines(spark, str(folder / "x.log*")).writeStream.foreachBatch(take)
                .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    with pytest.raises(Exception):
        start().awaitTermination()
    os.rename(folder / "x.log", folder / "x.log.1")
    write(folder / "x.log", "three, a longer line\n")
    fail[0] = False
    got.clear()
    start().awaitTermination()
    start().awaitTermination()
    assert sorted(got) == ["one", "three, a longer line", "two"]


def test_lost_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "x.log", "one\n")
    cp = str(tmp_path / "cp")
    assert Run(spark, str(folder), cp).step() == ["one"]

    from logweave.sources.follow import FollowReader
    reader = FollowReader({"path": str(folder)})
    start = reader.latestOffset()
    write(folder / "x.log", "two\n")
    end = reader.latestOffset()
    write(folder / "x.log", "gone\n", "wb")
    with pytest.raises(FileNotFoundError, match="x.log"):
        reader.partitions(start, end)
    assert FollowReader({"path": str(folder), "failondataloss": "false"}).partitions(start, end) == []


def test_idle_files_end_their_line(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "x.log", "one\nunfinished")
    os.utime(folder / "x.log", (1, 1))
    assert Run(spark, str(folder), str(tmp_path / "cp"), idle_seconds=60).step() == ["one", "unfinished"]


def test_long_lines_and_stretches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ["x" * 3_000_000, "", "é" * 10, *[f"short {i}" for i in range(25_000)]]
    write(folder / "x.log", "\n".join(lines) + "\n")
    for split in (1 << 30, 5000, 1_000_003):
        got = Run(spark, str(folder), str(tmp_path / f"cp{split}"), split_bytes=split)
        got.step()
        assert [x[2] for x in sorted(got.got, key=lambda x: x[1])] == lines


def test_raw_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "x.log", "<3>boom\n")
    got = []
    query = (follow_log_files(spark, str(folder), "prog").writeStream.foreachBatch(
        lambda df, _: got.extend(df.select("line", "pri", "trusted").collect()))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert [tuple(r) for r in got] == [("prog:boom", 3, True)]
