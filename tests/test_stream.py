"""The stream of histories against the batch form, after every batch and restart."""

import random

from corpusloom.operators import chat
from corpusloom.streaming.chat import start_history

SCHEMA = "conv_id long, turn long, role string, text string"


def test_stream_is_the_batch_form_after_each_restart(spark, tmp_path):
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "tool", None], [" hello ", "", "  ", None, "x" * 5000, "é😀"]
    turns = [(c, t, rng.choice(roles), rng.choice(texts)) for c in (1, 2, 3, None) for t in range(40)]
    rng.shuffle(turns)
    turns += [(4, None, "user", "without a number"), (4, 7, "user", "with one")]
    seen = []
    for number, part in enumerate((turns[:50], turns[50:53], turns[53:])):
        seen += part
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = start_history(source, str(tmp_path / "out"), str(tmp_path / "mark"))
        assert query.awaitTermination(120) and query.lastProgress["numInputRows"] == len(part)
        touched = {r[0] for r in part}
        want = [tuple(r) for r in chat.clean_history(spark.createDataFrame(seen, SCHEMA)).collect() if r["conv_id"] in touched]
        got = [tuple(r) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / f"out/clean/batch={number}")).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    state = spark.read.format("statestore").load(str(tmp_path / "mark")).selectExpr("size(value.groupState.turns) AS n").collect()
    assert sorted(r["n"] for r in state) == [2, 12, 12, 12, 12]
