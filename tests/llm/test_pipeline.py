"""The pipeline's stages, one after another, each against brute force on what it left."""

import itertools
import re

import numpy as np

import corpus_pipeline
from citeweave.llm import decontaminate, line_dedup, quality_classifier
from citeweave.llm.common import held_out, shingle_hashes, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        left[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(left[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]

    # quality: what is labelled good stays, what is labelled bad goes, on rows that were not learned from
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").where(held_out("doc_id")).collect()}
    assert np.mean([(d in left["quality"]) == (q == 1) for d, q in labels.items()]) > 0.9

    # lines: no line of five words is alike to one before it, and nothing else went
    s = line_dedup.Settings()
    seen, whole = {}, left["quality"]
    for d in sorted(whole):
        kept = []
        for line in (whole[d] or "").split("\n"):
            w = word_hashes(line)[0]
            key = tuple(w.tolist())
            if len(w) >= s.min_words:
                if key in seen:
                    continue
                seen[key] = w
            kept.append(line)
        exact = "\n".join(kept)
        assert left["line_dedup"][d] is None or set(left["line_dedup"][d].split("\n")) <= set(exact.split("\n"))
    of = sorted((len(w), k, w) for k, w in ((tuple(word_hashes(x)[0].tolist()), word_hashes(x)[0]) for t in left["line_dedup"].values() for x in (t or "").split("\n")) if len(w) >= 10)
    for (n, _, a), (m, _, b) in itertools.combinations(of, 2):
        d = int(s.distance(np.array([n]))[0])
        if m - n <= d and len(np.intersect1d(a, b)) >= 0.5 * n:
            assert not line_dedup.within(a, b, d)

    # near copies: no two are alike, and each that went is alike to one of its class
    sets = {d: set(shingle_hashes(word_hashes(t)[0]).tolist()) for d, t in left["line_dedup"].items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stay = [d for d in sets if d in left["near_dedup"]]
    assert not any(sets[a] and alike(a, b) for a, b in itertools.combinations(stay, 2))
    assert all(any(x != d and alike(d, x) for x in sets) for d in sets if d not in left["near_dedup"])

    # benchmark passages: who holds one goes, nobody else
    t = decontaminate.Settings()
    items = [word_hashes(r.text)[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, text in left["near_dedup"].items():
        w = word_hashes(text)[0]
        found = [decontaminate.holds(i, w, at, t) for i in items if len(i) and np.isin(i, w).mean() >= 0.5 for at in range(0, len(w), t.block)]
        assert (d in left["decontaminate"]) != any(share >= t.sure or share >= t.maybe and answer for share, answer in found)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 50
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source, r.target, r.source_size), []).append(r)
    assert len({k[0] for k in by}) == len(by)
    for (_, target, size), rows in by.items():
        assert sum(r.size for r in rows) == size and abs(sum(r.taken for r in rows) - target) <= 0.5


def test_quality_stage_is_the_classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    model = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out("doc_id")))
    assert kept == {r.doc_id for r in docs.collect() if model.score(r.text) >= 0.5}
