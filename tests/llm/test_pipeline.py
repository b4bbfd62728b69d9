"""The pipeline's stages, each against a plain version of its decision."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from furrow.llm import bpe, queries, secretscan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, small).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "bpe_encoding"]
    for name, (_, after) in stages.items():
        if name != "bpe_encoding":
            assert after.columns == COLUMNS


def test_language_stage_keeps_texts(stages):
    before, after = stages["language_id"]
    assert after.count() >= 0.97 * before.count()
    assert after.exceptAll(before).count() == 0


def plain_groups(rows, width=5, percent=80):
    """doc_id -> least doc_id of its group, over all pairs."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def test_dedup_stage(stages):
    before, after = stages["near_dedup"]
    want = {d for d, r in plain_groups(before.collect()).items() if d == r}
    assert {r["doc_id"] for r in after.collect()} == want
    assert all(d == r for d, r in plain_groups(after.collect()).items())


def test_stages_on_odd_rows(spark, small):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with names used inside."""
    words = "where the river bends the old mill stands and turns its wheel through the night".split()
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " ".join(words), "en", "a", 70),
        (4, " ".join(words), "en", None, 70),
        (5, "wort und satz oder nicht mehr und weniger als alle worte", "de", "b", 50),
        (5, "wort und satz oder nicht mehr und weniger als alle worte", "de", "b", 50),
        (6, " ".join(f"{w}{i}" for i in range(6000) for w in words[:3]), None, "b", None),
        (None, "no id but some words here and there", "en", "c", 30),
        (7, 'secret_key = "q8WwEe77rrTt00" and other words of the text', "en", "c", 55),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["_lang_pred", "_score", "_gone", "_again", "_place", "_d", "_copies", "_k", "size", "rank", "pattern"]
    odd = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    docs, kept = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), stage(spark, docs, small).schema)
        kept[name] = docs
        if name != "bpe_encoding":
            assert docs.columns == odd.columns
    ids = lambda n: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept[n].select("doc_id").collect())
    assert ids("language_id") == [(False, 3), (False, 4), (False, 5), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert ids("near_dedup") == [(False, 3), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert ids("secret_scan") == ids("near_dedup")
    assert "[SECRET]" in kept["secret_scan"].filter("doc_id = 7").head()["text"]
    assert set(ids("mixing")) <= set(ids("near_dedup"))
    assert kept["bpe_encoding"].count() == kept["mixing"].count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), small).count() == 0, name


def test_secret_stage(stages):
    before, after = stages["secret_scan"]
    assert before.count() == after.count()
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert secretscan.scan(r["text"]) == [] or r["text"] != old[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == old[r["doc_id"]]) == (not secretscan.scan(old[r["doc_id"]]))


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    assert after.groupBy("doc_id").count().filter("count > 2").count() == 0
    assert after.exceptAll(before.union(before)).count() == 0


def test_encoding_stage(stages):
    before, after = stages["bpe_encoding"]
    assert after.count() == before.count()
    assert after.filter(F.col("n_tokens") != F.size("ids")).count() == 0
    digests = before.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
    assert after.select("doc_id", "decoded_sha256").exceptAll(digests).count() == 0
    back = bpe.decode(after.select("doc_id", "ids"))
    assert back.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0


def test_registered():
    assert sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])) == ["op1_quality", "op2_secrets", "op3_language", "op4_bpe", "op5_sharding", "op6_urls", "op7_nearest", "op8_near_duplicates", "op9_token_files", "op10_mixing"]


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert out.count() > 0
