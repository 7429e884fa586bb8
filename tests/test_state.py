"""Streams with state give what the batch operators give, in any order of rows."""

import random
from datetime import datetime, timedelta

from procurelake.operators.evidence import dedup_requirements
from procurelake.streaming import state

START = datetime(2025, 1, 1)  # noqa: DTZ001


def run(spark, tmp_path, batches, schema, made, mode):
    """The rows that a stream over files, one a batch, writes."""
    source, out = str(tmp_path / "in"), []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{i:03}")
    stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source))
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_first_requirements(spark, tmp_path):
    rng = random.Random(4)
    schema = "tender_id long, chunk_no long, item_no long, content string, ts timestamp"
    rows = [(rng.randint(1, 3), c, i, rng.choice(["要求 甲", "要求甲", "要求 乙", "x" * 60 + str(c)]), START + timedelta(minutes=rng.randint(0, 50))) for c in range(12) for i in range(3)]
    rows += [(None, 1, 1, "a", START), (1, 0, 0, None, START), (2, 0, 0, "no time", None)]
    want = {(r.tender_id, r.chunk_no, r.item_no) for r in dedup_requirements(spark.createDataFrame([r for r in rows if r[0] and r[3] and r[4]], schema)).collect()}
    late = [(1, 0, -1, "要求 甲", START + timedelta(hours=5)), (9, 0, 0, "later", START + timedelta(hours=5))]
    rng.shuffle(rows)
    batches = [rows[:15], rows[15:30], rows[30:], [(9, 0, 1, "later", START + timedelta(hours=4))], late, [(9, 5, 5, "end", START + timedelta(hours=30))]]
    got = run(spark, tmp_path, batches, schema, state.first_requirements, "append")
    assert {(r.tender_id, r.chunk_no, r.item_no) for r in got if r.tender_id < 9} == want
    assert len([r for r in got if r.tender_id < 9]) == len(want) and [(r.chunk_no, r.item_no) for r in got if r.content == "later"] == [(0, 0)]


def test_merged_facts(spark, tmp_path):
    schema = "project_id long, facts map<string,string>, ts timestamp"
    rows = [(p, {rng_key: f"{p}{rng_key}{m}"}, START + timedelta(minutes=m)) for p in (1, 2) for m, rng_key in enumerate("abcabca")]
    rows += [(1, {"a": "tie-low"}, START + timedelta(minutes=6)), (1, None, START), (None, {"a": "x"}, START), (2, {"z": "no time"}, None), (2, {"n": None}, START)]
    want = {}
    for p, facts, ts in sorted((r for r in rows if r[0] and r[1] and r[2]), key=lambda r: (r[2], str(r[1]))):
        for k, v in facts.items():
            old = want.setdefault(p, {}).get(k)
            want[p][k] = max((ts, v or ""), old) if old else (ts, v or "")
    random.Random(2).shuffle(rows)
    got = run(spark, tmp_path, [rows[:6], rows[6:12], rows[12:], rows[:6]], schema, state.merged_facts, "update")
    last = {}
    for r in got:
        last[r.project_id] = r.facts
    assert last == {p: {k: v for k, (_, v) in f.items()} for p, f in want.items()}
    assert len(got) <= 6  # a batch that changes nothing says nothing
