"""Each stage against a plain version on its own input, and the whole."""

import brute
import test_llm_operators as ops
from pyspark.sql import functions as F

import corpus_pipeline
from pagefold.llm import decontaminate, lines, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, odd, odd_rows, none, tmp_path):
    _, docs, labels = ops.labelled(spark, 200)
    own = docs.unionByName(odd.select(COLUMNS).withColumn("doc_id", F.col("doc_id") + 5000))
    items = spark.createDataFrame([(1, " ".join(odd_rows[7][1].split()[:30]))], "item_id long, text string")
    own.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    kept = quality.quality_stage(spark, own, d)
    assert kept.columns == COLUMNS and 0 < kept.count() < own.count()
    assert kept.where("text like '%idiot%'").count() == 0

    rows = [(r["doc_id"], r["text"]) for r in own.collect() if r["doc_id"] is not None]
    gone = brute.dropped_lines(rows)
    out = {r["doc_id"]: r for r in lines.line_stage(spark, own, d).collect()}
    for i, t in rows:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if i != 5008:
            assert (i in out) == (not gone[i] or bool(left.strip(" "))), i
        if i in out and t is not None and i != 5008:
            assert out[i]["text"] == left and out[i]["n_chars"] == len(left)

    prints = [(i, brute.simhash(t, 5)) for i, t in rows]
    groups = brute.components([i for i, _ in prints], lambda a, b: (prints[a][1] ^ prints[b][1]).bit_count() <= 2)
    want = {i for (i, _), g in zip(prints, groups, strict=True) if i == g}
    assert {r["doc_id"] for r in simhash.simhash_stage(spark, own, d).collect() if r["doc_id"] is not None} == want

    left = {r["doc_id"] for r in decontaminate.decontamination_stage(spark, own, d).collect()}
    assert left == {r["doc_id"] for r in own.collect()} - {5008}

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(COLUMNS), d).count() == 0
    whole = corpus_pipeline.run(spark, d).collect()
    assert whole and {r["doc_id"] for r in whole} <= {i for i, _ in rows} | {None}


def test_near_copies_go(spark):
    """One to four changed words of 200 leave a similarity of 0.8 or more, whatever bits their fingerprints differ in."""
    rows = []
    for k in range(20):
        text = brute.words(200, 900 + k).split()
        for n in (0, 1, 2, 4, 6):
            rows.append((10 * k + n, " ".join(f"new{n}" if i % 30 == 15 and i // 30 < n else w for i, w in enumerate(text)), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t, *_ in rows]
    groups = brute.components([r[0] for r in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = {r["doc_id"] for r in simhash.simhash_stage(spark, docs, "").collect()}
    assert kept == {r[0] for r, g in zip(rows, groups, strict=True) if r[0] == g}
    assert not kept & {10 * k + n for k in range(20) for n in (1, 2, 4)}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
