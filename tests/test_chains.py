"""Chains with keys in the state store: the digests of the batch form, over restarts."""

import pytest

from conftest import rows
from logweave.operators import integrity
from logweave.streaming import chains

LINES = "log_id string, line_no bigint, line string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def key_table(spark, logs, method="sha1"):
    seeds = spark.createDataFrame([(x, method, f"seed {x}") for x in logs], "log_id string, method string, seed string")
    return seeds.selectExpr("log_id", "method", "sha1(seed) AS k").selectExpr(
        "log_id", "method", "unhex(k) AS key0", "unhex(k) AS last_key")


def run(spark, base):
    lines = spark.readStream.schema(LINES).json(f"{base}/lines")
    keys = spark.readStream.schema("log_id string, method string, key0 binary, last_key binary").parquet(f"{base}/keys")
    query = (chains.chain_stream(lines, keys).writeStream.format("parquet").option("path", f"{base}/macs")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return [op for p in query.recentProgress for op in p["stateOperators"]]


def test_equals_batch_over_restarts(spark, rocks, tmp_path):
    base = str(tmp_path)
    logs = [f"log{k}" for k in range(20)]
    key_table(spark, logs[:19]).write.parquet(f"{base}/keys")
    made = [(x, n, f"{x} line {n}" if n % 3 else None) for x in logs for n in range(8)]
    steps = [[r for r in made if r[0] != "log19" and r[1] < 3], [r for r in made if r[0] == "log4" and 3 <= r[1] < 8],
             [r for r in made if r[0] == "log19" or (r[0] == "log5" and 3 <= r[1] < 5)]]
    updated = []
    for k, part in enumerate(steps):
        if k == 2:  # a new log brings its key along, an old one brings another, which is not taken
            key_table(spark, ["log19", "log4"]).write.mode("append").parquet(f"{base}/keys")
        spark.createDataFrame(part[::-1], LINES).write.mode("append").json(f"{base}/lines")
        updated.append(sum(op["numRowsUpdated"] for op in run(spark, base)))
    # a batch touches the keys of its own logs only
    assert updated == [19, 1, 3]
    lines = spark.createDataFrame([r for part in steps for r in part], LINES)
    keys = key_table(spark, logs)
    want = integrity.protect(lines, keys)
    written = spark.read.parquet(f"{base}/macs")
    assert rows(written.select("log_id", "line_no", "mac")) == rows(want.select("log_id", "line_no", "mac"))
    last = chains.latest_keys(written, keys)
    assert rows(last) == rows(integrity.last_keys(want, keys))
    verdicts = integrity.verify(lines, last, written.select("log_id", "line_no", "mac"))
    assert {r.status for r in verdicts.collect()} == {0}


@pytest.mark.parametrize("part,error", [([("new", 1, "x")], "no first key"), ([("a", 2, "x")], "comes after")])
def test_what_a_chain_cannot_take(spark, rocks, tmp_path, part, error):
    base = str(tmp_path)
    key_table(spark, ["a"]).write.parquet(f"{base}/keys")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], LINES).write.json(f"{base}/lines")
    run(spark, base)
    spark.createDataFrame(part, LINES).write.mode("append").json(f"{base}/lines")
    with pytest.raises(Exception, match=error):
        run(spark, base)
