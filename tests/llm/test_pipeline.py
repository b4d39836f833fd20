"""The pipeline stage by stage against its operators' rules."""

import collections
import re

import corpus_pipeline as C

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in C.STAGES:
        frames.append(stage(spark, frames[-1], FOLDER).cache())
        assert name == "shards" or frames[-1].columns == columns
    raw, good, unique, clean, mixed, shards = ([r for r in f.collect()] for f in frames)
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(raw) >= ids(good) >= ids(unique) >= ids(clean) >= ids(mixed) and len(unique) == len(ids(unique))

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [words(r["text"])] for i in range(max(1, len(w) - 4))} for r in good}
    for a in unique:
        for b in unique:
            if a["doc_id"] < b["doc_id"]:
                both = len(sets[a["doc_id"]] & sets[b["doc_id"]])
                assert 100 * both < 80 * (len(sets[a["doc_id"]]) + len(sets[b["doc_id"]]) - both)
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() for w in [plain(r["text"])] for i in range(max(1, len(w) - 9))}
    leaks = {r["doc_id"] for r in unique for w in [plain(r["text"])] if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))}
    assert ids(clean) == ids(unique) - leaks
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 2 and len(shards) == len(mixed) and {r["shard"] for r in shards} <= set(range(40))


def test_run_writes_every_stage(spark):
    assert C.run(spark, FOLDER).count() > 0
