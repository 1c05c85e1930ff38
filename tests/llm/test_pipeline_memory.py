"""What a reused Python worker keeps from stage to stage, and what it gets at a time."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ONE_WORKER = """
import corpus_pipeline
from shardloom.llm import common
from shardloom.session import local_session

spark = local_session(1, "1g")
docs = spark.createDataFrame([(i, "some words of a text " * 5000, "en", "s", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
stage = dict(corpus_pipeline.STAGES)


def held(batches):
    import pyarrow as pa

    sizes = [b.nbytes for b in batches]
    yield pa.RecordBatch.from_pydict({"held": [str(k)[:6] for k in common._slot], "most": [max(sizes)] * len(common._slot)})


def now():
    return docs.mapInArrow(held, "held string, most long").collect()


assert stage["tokens"](spark, docs, "").count() == 60
row = now()[0]
print("TOKENS", row.held, row.most)
assert stage["language"](spark, docs, "").count() == 60
print("LANGUAGE", *[r.held for r in now()])
"""


def test_a_worker_keeps_no_codec_for_other_stages_and_gets_short_batches():
    repo = str(Path(__file__).resolve().parents[2])
    got = subprocess.run([sys.executable, "-c", ONE_WORKER], cwd=repo, env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=240)
    said = {line.split()[0]: line.split()[1:] for line in got.stdout.splitlines() if line.startswith(("TOKENS", "LANGUAGE"))}
    assert set(said) == {"TOKENS", "LANGUAGE"}, got.stderr[-2000:]
    assert said["TOKENS"][0] == "('bpe'" and int(said["TOKENS"][1]) < 2 << 20
    assert said["LANGUAGE"] == ["langid"]
