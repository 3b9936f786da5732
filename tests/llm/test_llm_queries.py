"""The registered queries themselves, over whole tables, against plain versions."""

import html as entities
import math
import re
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest


import __spark_entry__ as entry
import test_llm_operators as ops
from pagefold.llm import audio, passages, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    c = duckdb.connect()
    return lambda sql: c.execute(sql.replace("{", f"'{SF}/").replace("}", ".parquet'")).fetchall()


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_op1(spark, table):
    docs = table("select doc_id, text from {documents}")
    found = {r["doc_id"]: r for r in run(spark, "op1_secret_scan")}
    assert len(found) == len(docs)
    for i, text in docs:
        counts, digest = brute.secrets(text)
        r = found[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == [*counts, digest]
        assert all(text[int(s) : int(e)] for _, s, e in (x.split(":") for x in r["spans"].split(",") if x))


def test_own_rules(spark):
    """Rules beyond Latin letters, and more trigrams than a byte can number."""
    rules = (secrets.Rule("key", "clé[0-9]+"), secrets.Rule("many", "|".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}{k:03d}" for k in range(300))), secrets.Rule("any", "(?i)ÉTÉ"))
    rows = [(1, "une clé42 ici"), (2, "wordda003"), (3, "nothing"), (4, "l'ÉtÉ")]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), rules=rules).collect()}
    assert found == {1: [("key", 4, 9)], 2: [("many", 0, 9)], 3: [], 4: [("any", 2, 5)]}


def test_op2(spark, table):
    """These pages have their text in one article of headings and paragraphs, where a br is a space."""
    pages = table("select page_id, html from {pages}")
    found = {r["page_id"]: r for r in run(spark, "op2_html_extraction")}
    for i, page in pages:
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li|div)[^>]*>", article.replace("<br>", " "))
        want = [" ".join(entities.unescape(re.sub(r"<!--.*?-->|<[^>]*>", "", b, flags=re.S)).split()) for b in blocks]
        assert found[i]["text"] == "\n".join(x for x in want if x) and found[i]["n_chars"] == len(found[i]["text"])


def test_op5(spark, table):
    ops.check_packed(run(spark, "op5_best_fit_packing"), table("select doc_id, text from {documents}"), 2048)


def test_op6(spark, table):
    rows = sorted(table("select vec_id, embedding from {embeddings}"))
    prints = [audio.fingerprint(audio.decode_wave(audio.render(v))) for _, v in rows]
    want = brute.components([i for i, _ in rows], lambda a, b: audio.matches(prints[a], prints[b]))
    found = {r["vec_id"]: r for r in run(spark, "op6_audio_fingerprints")}
    assert [found[i]["class_id"] for i, _ in rows] == want
    assert all(np.array_equal(np.array(found[i]["fingerprint"], dtype=np.int32).view(np.uint32), p) for (i, _), p in zip(rows, prints, strict=True))


def test_op7(spark, table):
    docs = sorted(table("select doc_id, text from {documents}"))
    texts = [passages.passage_shingles(t, 46)[0] for _, t in docs]
    sets = [set(x.tolist()) for x in texts]
    same = lambda a, b: docs[a][1] == docs[b][1] and len(brute.words9(docs[a][1])) >= 50 or len(sets[a] & sets[b]) >= passages.least_run() and bool(passages.matching_spans(texts[a], texts[b]))
    want = brute.components([i for i, _ in docs], same)
    found = {r["doc_id"]: r["class_id"] for r in run(spark, "op7_substring_dedup")}
    assert [found[i] for i, _ in docs] == want and len(set(want)) < len(want)


def test_op8(spark, table):
    docs = sorted(table("select doc_id, text from {documents}"))
    prints = [brute.simhash(t, 3) for _, t in docs]
    want = brute.components([i for i, _ in docs], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op8_simhash_near_dedup")}
    assert [found[i] for i, _ in docs] == [(f"{p:016x}", w) for p, w in zip(prints, want, strict=True)]


def test_op10(spark, table):
    docs = table("select doc_id, text from {documents}")
    tokens = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [" "] for i, t in docs}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, own in tokens.items() if not held(i) for w in own)
    n, v = sum(c.values()), len(c)
    rows = run(spark, "op10_lm_scoring")
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    # the model knows more than counts do of texts that it hasn't seen
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_op4_and_pipeline(spark, table):
    """Labels, of which this small table has 87, are mostly given back; the pipeline only has documents that the classifier keeps."""
    labels = {i: (q, t) for i, q, t in table("select doc_id, quality, toxic from {labels} where quality is not null and toxic is not null")}
    rows = {r["doc_id"]: r for r in run(spark, "op4_quality_classifier")}
    for k, name in enumerate(("p_quality", "p_toxic")):
        assert np.mean([(rows[i][name] > 0.5) == own[k] for i, own in labels.items() if i in rows]) > 0.85
    kept = {i for i, r in rows.items() if r["keep"]}
    pieces = Counter(r["doc_id"] for r in run(spark, "pipeline"))
    assert pieces and set(pieces) <= kept
