"""Running scores over files that arrive, with resets and a restart from the checkpoint."""

import json
from statistics import median

from quire.functions.text import edit_distance
from quire.streaming import scores

SCHEMA = "run string, seq long, predicted string, target string, loss double, reset boolean"


def plain(batches, window):
    out, state = [], {}
    for batch in batches:
        for run in sorted({r["run"] for r in batch if r["run"]}):
            n, hit, far, losses = state.get(run, (0, 0, 0.0, []))
            rows = sorted((r for r in batch if r["run"] == run), key=lambda r: r["seq"])
            for k, r in enumerate(rows):
                a, b = r["predicted"] or "", r["target"] or ""
                n, hit, far = n + 1, hit + (a == b), far + edit_distance(a, b) / max(len(a), len(b), 1)
                losses = (losses + [r["loss"]] * (r["loss"] is not None))[-window:]
                if r["reset"] or k == len(rows) - 1:
                    out.append((run, r["seq"], bool(r["reset"]), n, round(hit / (n + 1e-5), 9), round(1 - far / (n + 1e-5), 9), round(median(losses), 9) if losses else None))
                if r["reset"]:
                    n, hit, far = 0, 0, 0.0
            state[run] = (n, hit, far, losses)
    return sorted(map(str, out))


def test_scores_survive_a_restart(spark, tmp_path):
    row = lambda run, seq, a, b, loss=None, reset=None: {"run": run, "seq": seq, "predicted": a, "target": b, "loss": loss, "reset": reset}
    batches = [
        [row("x", 2, "abc", "abd", 0.5), row("x", 1, "é", "é", 0.9), row("y", 1, None, "", None), row(None, 1, "a", "a")],
        [row("x", 3, "q", "q", 0.1, True), row("x", 4, "", "ab", 0.2), row("x", 5, "k", "k", 0.3)],
        [row("y", 2, "a", "b", 1.0, True), row("x", 6, "k", "K", 0.4)],
    ]
    source, sink, checkpoint = (tmp_path / n for n in ("in", "out", "checkpoint"))
    source.mkdir()
    for k, batch in enumerate(batches):  # a new query each time, from the same checkpoint
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, batch)))
        stream = scores.recognition_scores(spark.readStream.schema(SCHEMA).json(str(source)), "run", "seq", "predicted", "target", "loss", "reset", window=3)
        query = stream.writeStream.outputMode("append").format("parquet").option("path", str(sink)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = [(r.run, r.seq, r.final, r.n, round(r.acc, 9), round(r.similarity, 9), None if r.smooth is None or r.smooth != r.smooth else round(r.smooth, 9)) for r in spark.read.parquet(str(sink)).collect()]
    assert sorted(map(str, got)) == plain(batches, 3)
