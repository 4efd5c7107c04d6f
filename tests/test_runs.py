"""Analyses in batches: asked once, cached, relabelled, and the same when a batch comes again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import runs

LEASE, RULES = "The deposit shall be refunded within 30 days.", "Pets are allowed only with written consent."


class Recorder:
    """Answers by the analysis' name and notes every prompt in a file."""

    def __init__(self, folder):
        self.folder = folder

    def generate_json(self, name, prompts):
        for p in prompts:
            with open(os.path.join(self.folder, f"{len(os.listdir(self.folder))}-{os.getpid()}"), "w") as f:
                f.write(p)
        empty = {f.split(" ")[0]: ([] if "array" in f else 5 if " int" in f else "x") for f in split(runs.SCHEMAS[name])}
        if name == "simplify":
            empty["key_points"] = [{"point": "p", "quote": "refunded within 30 days", "location": ""}, {"point": "q", "quote": "tenant forfeits everything", "location": ""}]
        if name == "compare":
            empty["differences"] = [{"topic": "t", "quote_a": "refunded within 30 days", "quote_b": "refunded within 30 days"}]
        return [None if "FAIL" in p else "{}" if "SHORT" in p else json.dumps(empty) for p in prompts]


def split(ddl):
    depth, part, out = 0, "", []
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


@pytest.fixture
def sink(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    docs = [("d1", "Lease", LEASE), ("d2", "House", RULES), ("d3", "Copy of lease", LEASE)]
    df = spark.createDataFrame(docs, "doc_id string, name string, text string")
    df = df.select("doc_id", "name", F.sha2("text", 256).alias("sha"), F.array(F.struct(F.lit("Page 1").alias("location"), "text")).alias("segments"))
    folder = str(tmp_path / "calls")
    return runs.AnalysisSink(str(tmp_path / "store"), df, lambda: Recorder(folder)), folder


def answers(spark, sink, batch):
    return {r.request_id: r for r in spark.read.parquet(f"{sink.path}/answers/batch={batch}").collect()}


def test_runs(spark, sink):
    sink, calls = sink
    said = [
        ("r1", "simplify", ["d1"], None, None), ("r2", "simplify", ["d3"], " ", ""), ("r3", "simplify", ["d1"], None, "plain"), ("r4", "compare", ["d1", "d2"], "", None),
        ("r5", "action_plan", [], "my landlord keeps it", None), ("r6", "risks", ["d9"], None, None), ("r7", "compare", ["d1", "d1"], None, None), ("r8", "lawyer_brief", None, None, None),
        ("r9", "poem", ["d1"], None, None), ("s1", "lawyer_brief", ["d2"], "FAIL", None), ("s2", "action_plan", ["d2"], "SHORT", None), ("s3", "simplify", ["d1", "d2"], None, None),
    ]
    requests = spark.createDataFrame(said, runs.REQUEST)
    sink(requests, 0)
    got = answers(spark, sink, 0)
    assert {i: r.status for i, r in got.items()} == {
        "r1": "ok", "r2": "ok", "r3": "ok", "r4": "ok", "r5": "ok", "r6": "unknown_document", "r7": "two_documents", "r8": "nothing_given", "r9": "unknown_analysis", "s1": "failed", "s2": "failed", "s3": "one_document",
    }
    assert (got["r1"].verified, got["r1"].unverified) == (1, 1) and json.loads(got["r1"].result)["key_points"][0]["quote_status"] == "verified"
    assert got["r1"].result == got["r2"].result and got["r1"].documents[0].name == "Lease" and got["r2"].documents[0].name == "Copy of lease"
    assert (got["r4"].verified, got["r4"].unverified) == (1, 1)  # what is in A is not in B
    prompts = [open(os.path.join(calls, f)).read() for f in os.listdir(calls)]
    assert len(prompts) == 6  # r1 and r2 are one
    both = next(p for p in prompts if p.startswith("compare"))
    assert both.index('label="A"') < both.index(LEASE) < both.index('label="B"') < both.index(RULES) and "[Page 1]" in both

    sink(requests, 0)  # the same batch again, as after a failure: nothing is asked, the same is written
    again = answers(spark, sink, 0)
    assert len(os.listdir(calls)) == 6 and {i: (r.status, r.cached, r.result) for i, r in again.items()} == {i: (r.status, r.cached, r.result) for i, r in got.items()}

    renamed = sink.documents.withColumn("name", F.concat(F.lit("My "), "name"))
    later = runs.AnalysisSink(sink.path, renamed, sink.start)
    later(requests.where("request_id IN ('r1', 'r2', 'r4', 'r5')"), 1)
    hits = answers(spark, sink, 1)
    assert len(os.listdir(calls)) == 6 and all(r.cached and r.status == "ok" for r in hits.values())
    assert hits["r2"].documents[0].name == "My Copy of lease" and hits["r2"].result == got["r2"].result and hits["r5"].documents == []


def test_stream(spark, sink, tmp_path):
    """Through a stream: a later batch finds what an earlier one cached, failures are asked again."""
    sink, calls = sink
    for i, some in enumerate([[("a", "simplify", ["d1"], None, None), ("b", "lawyer_brief", ["d2"], "FAIL", None)], [("c", "simplify", ["d3"], None, None), ("d", "lawyer_brief", ["d2"], "FAIL", None)]]):
        spark.createDataFrame(some, runs.REQUEST).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(runs.REQUEST).json(str(tmp_path / "in" / "*"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = answers(spark, sink, 1)
    assert got["c"].cached and got["c"].status == "ok" and got["d"].status == "failed" and len(os.listdir(calls)) == 3


def test_cut_to_a_share(spark, sink):
    sink, _ = sink
    long = sink.documents.withColumn("segments", F.array(F.struct(F.lit("P").alias("location"), F.repeat(F.lit("word "), F.lit(200)).alias("text"))))
    rows = runs.keyed(runs.accepted(spark.createDataFrame([("a", "compare", ["d1", "d2"], None, None), ("b", "simplify", ["d1"], None, None)], runs.REQUEST)), long, "m")
    got = {r.name: r for r in runs.prompted(rows, long, 1500).collect()}
    assert got["compare"].truncated and not got["simplify"].truncated and got["compare"].prompt.count("word") < 400
