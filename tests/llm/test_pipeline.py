"""The pipeline over a small corpus: what each stage decides shows in its result."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from waybill.llm.common import stage_table
from waybill.llm.simhash_cover import fingerprint


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeinorstlm"), rng.integers(3, 8)))
    docs, labels = [], []
    for i in range(300):
        words = [word() for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[10] = words[30] = "blorgon"
        if i % 50 == 1:
            words[5] = "password=abcdef0123456789"
        docs.append((i, " ".join(words), "en", "big" if i % 4 else "small", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "big", 1) for i in range(1, 40)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages(spark, corpus):
    path, docs = corpus
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage_table(stage(spark, now, path), name)
        seen[name] = now
        if name != "packing":
            assert now.columns == names
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    clean = [d for d, t, *_ in docs if "blorgon" not in t]
    assert ids["toxicity"] == clean
    prints = [fingerprint(t) for d, t, *_ in docs if d in set(clean)]
    kept = [d for i, d in enumerate(clean) if not any((prints[i] ^ p).bit_count() <= 3 for p in prints[:i])]
    assert ids["near_duplicates"] == kept == ids["secrets"]
    texts = {r.doc_id: r for r in seen["secrets"].collect()}
    assert all("password" not in r.text for r in texts.values()) and texts[1].text.count("[REDACTED]") == 1 and texts[1].n_chars == len(texts[1].text)
    assert set(ids["mixing"]) == set(kept)
    copies = collections.Counter(ids["mixing"])
    by = {r.doc_id: r.source for r in texts.values()}
    assert {copies[d] for d in kept if by[d] == "big"} == {1} and {copies[d] for d in kept if by[d] == "small"} <= {1, 2}
    firsts = collections.Counter(r.doc_id for r in seen["packing"].collect() if r.piece == 0)
    assert firsts == copies
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, seen["packing"].select("doc_id", "piece", "start", "length", "ids_crc32").collect()))



@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "one word token=abcdefghijklmno", "en", "s", 5), (None, "one word", None, "s", 2), (3, "x" * 300_000, "en", "s", 300_000)]])
def test_odd_documents(spark, tmp_path, rows):
    """An empty table, null ids and texts, repeated rows, a long text, columns with clashing and dotted names."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as mix_block", "2 as `a.b`", "'k' as key", "3 as row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage_table(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows} - ({3} if not rows else set())
