"""The corpus pipeline stage by stage on the smallest tables."""

import corpus_pipeline
from codeweave.llm import neardup, toxicity
from codeweave.llm.common import work_dir, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, n = docs.columns, docs.count()
    base = work_dir(spark, "pipeline-test")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), f"{base}/{name}")
        outs[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == cols
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    before, after = outs["near_duplicates"]
    groups = neardup.near_duplicates(
        before, percent=corpus_pipeline.SIMILAR_PERCENT).select("component_id").distinct().count()
    assert after.count() == groups and after.select("doc_id").distinct().count() == groups
    assert outs["toxicity"][1].count() < n
    assert docs.count() == outs["mixing"][1].count()


def test_toxic_rows_go(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(d, spark.read.parquet(f"{SF}/labels.parquet"),
                           train_rows=lambda c: ~toxicity.held_out(c))
    kept = corpus_pipeline.drop_toxic(spark, d, SF)
    low = toxicity.scores(d, model).filter(f"score < {toxicity.THRESHOLD}").count()
    assert kept.count() == low


def test_pairs_from_080_to_085_are_dropped(spark, docs):
    rows, want = [], set()
    for i, n in enumerate((49, 53, 57, 61, 65, 110, 150)):
        base = [f"d{i}w{j}" for j in range(n)]
        edit = list(base)
        for at in range(20, n - 10, 40):         # shingles of its own: 5 a changed word
            edit[at] = "changed"
        a, b = ({tuple(t[j:j + 5]) for j in range(n - 4)} for t in (base, edit))
        assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
        rows += [(2 * i, " ".join(base), "a"), (2 * i + 1, " ".join(edit), "a")]
        want.add(2 * i)
    far = [f"far{j}" for j in range(48)]         # 39 of 49: below 0.80
    rows += [(90, " ".join(far), "a"), (91, " ".join([*far[:24], "changed", *far[25:]]), "a")]
    got = corpus_pipeline.drop_near_duplicates(spark, docs(rows), SF)
    assert {r.doc_id for r in got.collect()} == want | {90, 91}


def test_bands_suit_the_threshold():
    for percent in (85, 80, 70, 50):
        band = neardup.band_size(percent)
        assert neardup.BINS % band == 0
        assert (1 - (percent / 100) ** band) ** (neardup.BINS // band) < 1e-6
    assert neardup.band_size(85) == 6            # op2 as it was


def test_tokens_stage_holds_little_at_once(spark, docs, monkeypatch):
    """Few texts a batch while the files are written, small coding pieces."""
    import tracemalloc
    import numpy as np
    from codeweave.llm import tokenpack
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, seen = spark.conf.get(key), []

    def spied(df, path):
        seen.append(int(spark.conf.get(key)))
        return written(df, path)
    monkeypatch.setattr(tokenpack, "written", spied)
    out = tokenpack.tokens_report(docs([(i, "some words here", "a") for i in range(5)]))
    assert out.count() == 5
    assert seen and max(seen) <= 1000 and spark.conf.get(key) == was
    ids = np.random.default_rng(1).integers(0, 50_000, 1 << 20).astype(np.uint32)
    tracemalloc.start()
    words, counts = tokenpack.encode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
    assert (tokenpack.decode(words, counts, len(ids)) == ids).all()
