"""Keyed state against batch folds, over several micro-batches and a restart."""

import random
from collections import defaultdict

from papyrion.streaming import events, keyed

KINDS = "paper string, stage string, ts timestamp, event_id long"


def write(spark, rows, folder, parts, kinds=KINDS):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], kinds).coalesce(1).write.mode("append").parquet(folder)


def made(seed, n, start=0):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    return [(f"p{rng.randrange(12)}", rng.choice(["processing", "complete", "failed"]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(2000)), start + k) for k in range(n)]


def fold(rows):
    out = defaultdict(lambda: [None, 0, None, 0])
    for paper, stage, ts, i in rows:
        s = out[paper]
        s[1] += stage == "processing"
        s[3] += 1
        if s[2] is None or (ts, i) >= s[2]:
            s[0], s[2] = stage, (ts, i)
    return {p: (s[0], s[1], s[2][1], s[3]) for p, s in out.items()}


def seen(spark, target):
    return {r.paper: (r.stage, r.attempts, r.event_id, r.n_events) for r in keyed.present(spark, target, keyed.STAGES, "paper", "n_events").collect()}


def test_stages_over_batches_and_a_restart(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first, second = made(1, 120), made(2, 90, 1000)
    write(spark, first, source, 3)
    stream = events.file_stream(spark, source, KINDS)
    keyed.run_to_end(keyed.stages(stream), target, check)
    assert seen(spark, target) == fold(first)
    write(spark, second, source, 2)
    keyed.run_to_end(keyed.stages(events.file_stream(spark, source, KINDS)), target, check)  # from the checkpoint
    assert seen(spark, target) == fold(first + second)
    keyed.run_to_end(keyed.stages(events.file_stream(spark, source, KINDS)), target, check)  # nothing new
    assert seen(spark, target) == fold(first + second)


def test_stalled_papers_fail(spark, tmp_path):
    from datetime import datetime

    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = lambda h: datetime(2024, 1, 1, h)
    for rows in [[("a", "processing", at(1), 1), ("b", "processing", at(1), 2)], [("b", "complete", at(2), 3)], [("c", "complete", at(20), 4)], [("c", "complete", at(21), 5)]]:
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(source)
        keyed.run_to_end(keyed.stages(events.file_stream(spark, source, KINDS), limit=3_600_000), target, check)
    got = {r.paper: (r.stage, r.reason) for r in keyed.present(spark, target, keyed.STAGES, "paper", "n_events").collect()}
    assert got == {"a": ("failed", "stalled"), "b": ("complete", None), "c": ("complete", None)}


def test_usage_counts_each_call_once_while_it_is_remembered(spark, tmp_path):
    from datetime import datetime

    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    kinds = "model string, call string, tokens long, ts timestamp"
    at = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    for rows in ([("m", f"c{k % 20}", 3, at(1)) for k in range(50)] + [("n", "d0", None, at(1)), ("n", "d1", 5, at(2))], [("n", "d1", 5, at(3)), ("m", "c0", 3, at(3))], [("z", "late", 1, at(40))], [("z", "later", 1, at(41))], [("n", "d1", 5, at(41))]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
        keyed.run_to_end(keyed.usage(events.file_stream(spark, source, kinds)), target, check)
    got = {r.model: (r.calls, r.tokens, r.repeated) for r in keyed.present(spark, target, keyed.USAGE, "model", "calls").collect()}
    assert got["m"][:2] == (20, 60) and got["z"][:2] == (2, 2)
    assert got["n"] == (3, 10, 1)  # its second use came when the first one was forgotten
