"""Executors without the package on their path run every operator."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import public_tokenizers
from pagefold.llm import audio, decontaminate, html, lines, lm, packing, passages, quality, secrets, simhash
rows = [(i, "one two three four five " * 12 + str(i % 7), "en", "s", 60 + i) for i in range(30)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(20)], "doc_id long, quality int, toxic int")
items = spark.createDataFrame([(1, "one two three four five one two three four five")], "item_id long, text string")
media = spark.createDataFrame([(i, [float((i * k) % 5) for k in range(40)]) for i in range(6)], "id long, audio array<double>")
pages = spark.createDataFrame([(1, "<p>a, b</p>")], "page_id long, html string")
for frame in (
    secrets.scan_secrets(docs), html.extract_main_text(pages), lines.dedup_lines(docs), quality.classify(docs, labels), packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
    audio.recording_classes(media, "id", "audio", load=audio.render), passages.passage_classes(docs), simhash.near_duplicates(docs), simhash.similar_documents(docs),
    decontaminate.contaminated_spans(docs, items), lm.score_texts(docs, held_out=F.col("doc_id") == 1),
):
    assert frame.count() > 0
print("all ran")
"""


def test_bare_executors(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
