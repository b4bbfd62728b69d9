"""Quality, sharding, URL filters, neighbours, near duplicates and mixing against plain versions."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import ann, mixing, neardup, quality, queries, sharding, urlfilter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, None, None, None, None, "x", "y"),
        (2, "", "en", "a", 0, None, None),
        (3, " \t\n ", "en", None, 4, "x", "y"),
        (4, "one two three", "en", "a", 13, "x", "y"),
        (5, "one two three", "de", "b", 13, "x", "y"),
        (5, "one two three", "de", "b", 13, "x", "y"),
        (6, "w " * 30_000, "de", "b", 60_000, "x", "y"),
        (7, "the same line\nthe same line\nanother line here and more words to come", None, "c", 60, "x", "y"),
        (None, "a row without an id", "en", "a", 19, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def base_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_base_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    made = ["a b c d e a b c d e a b c d e", "x x x x x x x", "a b c d e f a b c d e", "p q r s t\np q r s t\n\n \n", "é ü|#\x0b# z"]
    more = docs.unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source")).unionByName(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(made)], docs.schema))
    got = Counter(tuple(r) for r in quality.text_statistics(more).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r["doc_id"], *base_counts(r["text"])) for r in more.collect())


def plain_mcd(x, floors, keep, rounds):
    """Concentration steps as in the operator, with arrays."""
    p = x.shape[1]
    steps = quality.STEPS

    def distance(m, cov):
        d = x - m
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    floor = np.diag([(f * steps) ** 2 for f in floors])
    lower_median = lambda v: np.sort(v, axis=0)[int(np.ceil(len(v) * 0.5)) - 1]
    med = lower_median(x)
    mad = lower_median(np.abs(x - med))
    starts = [(med.astype(float), np.diag((1.4826 * mad) ** 2) + floor), (x.mean(axis=0), np.cov(x.T, bias=True) + floor)]
    state, out = starts, None
    for k in range(rounds):
        before, out = out, []
        for m, cov in state:
            bins = np.floor(np.log2(distance(m, cov) + 1e-3) * quality.DIST_BINS_PER_OCTAVE)
            values, counts = np.unique(bins, return_counts=True)
            first = np.cumsum(counts) - counts
            near = x[bins <= values[first < len(x) * keep].max()]
            m, cov = near.mean(axis=0), np.cov(near.T, bias=True) * quality.consistency(keep, p) + floor
            out.append((np.linalg.slogdet(cov)[1], m, cov))
        state = [(m, cov) for _, m, cov in out]
        if k and max(abs(a[0] - b[0]) for a, b in zip(before, out, strict=True)) < quality.SETTLED:
            break
    _, m, cov = min(out, key=lambda o: o[0])
    near = x[distance(m, cov) <= quality.chi2_quantile(0.975, p)]
    m, cov = near.mean(axis=0), np.cov(near.T, bias=True) * quality.consistency(0.975, p) + floor
    return distance(m, cov)


def test_mcd_against_arrays(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        n = int(rng.integers(50, 400))
        bad = i % 10 == 0
        rows.append((i, "en", "s", n, int(n * rng.uniform(4, 6)), n * 2 if bad else int(rng.integers(0, 2)), int(rng.integers(0, 3)), 0))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r["doc_id"]: r for r in quality.judge(stats).collect()}
    z = {r["doc_id"]: [r[s] for s in quality.STATS] for r in quality._vector(stats).collect()}
    want = plain_mcd(np.array([z[i] for i in range(400)], float), list(quality.FLOORS.values()), quality.KEEP, 7)
    for i in range(400):
        assert got[i]["distance2"] == pytest.approx(want[i], rel=1e-4, abs=1e-4)
        assert got[i]["kept"] == (i % 10 != 0)


def test_concentration_reaches_the_least_determinant(spark):
    """No other start of many, drawn at random, ends with a smaller determinant of the kept part's scatter."""
    rng = np.random.default_rng(7)
    n = 300
    x = np.round(rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) * 40).astype(int)
    x[:60] += np.array([500, -400, 0, 300, 0])
    rows = [(i, "en", "s", 100, 500, 0, 0, 0, *map(int, r)) for i, r in enumerate(x)]
    floor = np.diag([(f * quality.STEPS) ** 2 for f in quality.FLOORS.values()])
    keep = int(n * quality.KEEP)

    def concentrated(chosen):
        for _ in range(50):
            part = x[chosen]
            d = x - part.mean(axis=0)
            far = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(part.T, bias=True) + floor), d)
            again = np.argsort(far, kind="stable")[:keep]
            if set(again) == set(chosen):
                break
            chosen = again
        return np.linalg.slogdet(np.cov(x[chosen].T, bias=True) + floor)[1], set(chosen.tolist())

    best = min((concentrated(rng.choice(n, 6, replace=False)) for _ in range(200)), key=lambda c: c[0])
    stats = spark.createDataFrame([r[:8] for r in rows], "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    made = spark.createDataFrame([(r[0], *r[8:]) for r in rows], "d long, " + ", ".join(f"{s} long" for s in quality.STATS))
    old = quality._vector
    quality._vector = lambda df: df.join(made, df["doc_id"] == made["d"]).drop("d")
    try:
        got = {r["doc_id"]: r["distance2"] for r in quality.judge(stats).collect()}
    finally:
        quality._vector = old
    nearest = set(sorted(got, key=got.get)[:keep])
    assert np.linalg.slogdet(np.cov(x[sorted(nearest)].T, bias=True) + floor)[1] <= best[0] + 0.1
    assert all(got[i] > quality.chi2_quantile(1 - quality.TAIL, 5) for i in range(60))


def test_chi_square():
    assert quality.chi2_cdf(quality.chi2_quantile(0.975, 5), 5) == pytest.approx(0.975)
    assert quality.chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def test_quality_edges(spark):
    docs = odd_docs(spark)
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count()
    assert all(not r["kept"] and r["base_failed"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 5))
    assert quality.quality(docs.limit(0)).count() == 0


def test_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(odd_docs(spark).select("doc_id", "text")).unionByName(spark.range(10_000, 10_090).select(F.col("id").alias("doc_id"), F.lit("a hot text").alias("text")))
    rows = sharding.shard_documents(more).collect()
    again = sharding.shard_documents(more.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    n = more.count()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n
    assert max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_text = defaultdict(list)
    for r in rows:
        by_text[r["text_crc32"], r["size"]].append(r["shard"])
    cap = n // 24
    for key, members in by_text.items():
        if 1 < len(members) <= cap and key != (0, 8):
            assert len(set(members)) <= 2, (key, members)
    hot = max(by_text.values(), key=len)
    assert len(set(hot)) <= -(-len(hot) // cap) + 3


@pytest.mark.parametrize("copies", [2, 5, 20])
def test_shards_where_all_rows_have_copies(spark, copies):
    n = 4800
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % (n // copies)).cast("string")).alias("text"))
    rows = sharding.shard_documents(docs).collect()
    assert set(Counter(r["shard"] for r in rows).values()) == {n // 24}
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["doc_id"] % (n // copies)].add(r["shard"])
    whole = sum(len(v) == 1 for v in by_text.values())
    assert whole >= len(by_text) - 72  # keys at the ends of shards and of free places


def plain_propagation(groups, shards, capacity, rounds):
    """Groups move whole, one after the other, to where most of their members are, while there is room; the cut at the end."""
    at = {n: hash((n, 1)) % shards for members in groups for n in members}
    load = Counter(at.values())
    for _ in range(rounds):
        for members in groups:
            votes = Counter(at[n] for n in members)
            to = max(votes, key=lambda s: (votes[s], -s))
            for n in members:
                if at[n] != to and load[to] < capacity * 1.5:
                    load[at[n]] -= 1
                    load[to] += 1
                    at[n] = to
    return sum(len(set(at[n] for n in members)) - 1 for members in groups)


def test_cut_against_plain_propagation(spark):
    """Groups of 2 to 60 among documents of their own: no more cuts than propagation one by one, but for ends of shards."""
    rng = np.random.default_rng(3)
    groups, n = [], 0
    for size in rng.integers(2, 60, 60).tolist():
        groups.append(list(range(n, n + size)))
        n += size
    rows = [(d, f"group {i}") for i, members in enumerate(groups) for d in members] + [(d, f"own {d}") for d in range(n, 2 * n)]
    out = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = sum(len({out[d] for d in members}) - 1 for members in groups)
    begun = sum(len({hash((d, 2)) % 24 for d in members}) - 1 for members in groups)
    assert cut <= plain_propagation(groups, 24, 2 * n / 24, 3) + 24
    assert cut < 0.1 * begun


def test_shards_of_few(spark):
    docs = odd_docs(spark)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    rows = sharding.shard_documents(docs).collect()
    assert sorted(r["size"] for r in rows if r["doc_id"] in (1, 2)) == [8, 8]
    assert len({r["shard"] for r in rows}) == 9


def test_propagation_joins_a_chain(spark):
    """Nodes with several keys: a chain of overlapping pairs drifts together."""
    nodes = spark.range(12).select(F.col("id").cast("string").alias("node"))
    links = spark.createDataFrame([(str(i), f"k{i // 6}") for i in range(12)] + [("0", "solo")], "node string, key string")
    out = {r["node"]: r["shard"] for r in sharding.propagate(nodes, links, 3, [12, 12, 12], 3).collect()}
    assert len({out[str(i)] for i in range(6)}) == 1
    assert len({out[str(i)] for i in range(6, 12)}) == 1


def test_url_filter(spark):
    from datetime import datetime as t

    entries = [
        ("l", "Example.com", "block", "add", t(2024, 1, 10)), ("l", "example.com", "block", "add", t(2024, 1, 12)), ("l", "example.com", "block", "remove", t(2024, 2, 1)),
        ("l", "example.com", "block", "add", t(2024, 3, 1)), ("l", "example.com", "block", "remove", t(2024, 3, 1)), ("m", "www.example.com", "allow", "add", t(2024, 1, 20)),
        ("m", "www.example.com/x", "block", "add", t(2024, 1, 25)), ("n", "other.org", "block", "remove", t(2024, 1, 1)), (None, "q.org", "block", "add", t(2024, 1, 1)), ("n", None, "block", "add", t(2024, 1, 1)), ("n", "q.org", "block", "add", None),
    ]
    e = spark.createDataFrame(entries, "list string, key string, verdict string, action string, at timestamp")
    spans = {(r["key"], r["valid_from"].month, r["valid_to"] and r["valid_to"].month) for r in urlfilter.validity_intervals(e).collect()}
    assert spans == {("example.com", 1, 2), ("example.com", 3, None), ("www.example.com", 1, None), ("www.example.com/x", 1, None)}
    captures = [
        (1, "http://example.com/a", t(2024, 1, 9)), (2, "http://example.com/a", t(2024, 1, 10)), (3, "http://example.com/a", t(2024, 2, 1)), (4, "https://u:p@WWW.Example.com:80/y?z", t(2024, 1, 21)), (5, "http://www.example.com/x/y", t(2024, 1, 26)),
        (6, None, t(2024, 1, 26)), (7, "not a url", t(2024, 1, 26)), (8, "http://example.com", None), (9, "http://a.b.example.com/", t(2024, 3, 5)), (9, "http://a.b.example.com/", t(2024, 3, 5)), (10, "http://localhost/x", t(2024, 3, 5)), (11, "http://badexample.com/", t(2024, 3, 5)),
    ]
    c = spark.createDataFrame(captures, "page_id long, url string, fetch_time timestamp").withColumn("verdict", F.lit("old"))
    got = [(r["page_id"], r["n_active"], r["verdict"], r["entry"]) for r in urlfilter.filter_captures(c, e).orderBy("page_id").collect()]
    assert got == [(1, 0, "none", None), (2, 1, "block", "l:example.com"), (3, 0, "none", None), (4, 2, "allow", "m:www.example.com"), (5, 3, "block", "m:www.example.com/x"), (6, 0, "none", None), (7, 0, "none", None), (8, 0, "none", None), (9, 1, "block", "l:example.com"), (9, 1, "block", "l:example.com"), (10, 0, "none", None), (11, 0, "none", None)]
    # many questions of one key fall into pieces; working names may clash
    clash = c.withColumns({n: F.lit(1) for n in ("_host", "_segment", "_at", "_best", "key", "list", "span", "piece")})
    dealt = urlfilter.filter_captures(clash, e, piece=1)
    assert [(r["page_id"], r["n_active"], r["verdict"], r["entry"]) for r in dealt.orderBy("page_id").collect()] == got
    assert set(clash.columns) <= set(dealt.columns)
    assert urlfilter.filter_captures(c.limit(0), e).count() == 0
    assert urlfilter.filter_captures(c, e.limit(0)).filter("verdict <> 'none'").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, small, name):
    db = duckdb.connect()
    for t in ("pages", "documents"):
        db.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == Counter(db.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())


def test_multi_index_retrieves_all_within_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, ann.PARTS)).astype(np.uint8)
    codes[:200] = codes[0] ^ (rng.random((200, ann.PARTS)) < 0.3).astype(np.uint8)
    block = ann.Block(np.arange(500), np.zeros((500, 2)), codes)
    for radius in (0, 5, 31, 32, 40, 100, 130):
        for q in (0, 3, 300):
            assert block.within(codes[q], radius).tolist() == np.flatnonzero(ann.distances(codes[q], codes) <= radius).tolist()


def exact_neighbours(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
            out[q] = d[:k]
    return out


def test_recall(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    got = defaultdict(list)
    for r in ann.search(v, v.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = exact_neighbours([(r["vec_id"], r["embedding"]) for r in v.collect()], 10)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in got:
        assert len(got[q]) == 10
        assert got[q] == sorted(got[q])


def test_recall_of_many_queries(spark):
    """Clusters of vectors, as embeddings have them: 120 queries against brute force, ties and copies included."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 50, axis=0) + 0.25 * rng.normal(size=(3000, 16))
    x[2990:] = x[:10]
    v = spark.createDataFrame([(i * 4, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(v, v.filter("vec_id % 100 = 0"), sample=1000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 120
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q // 4]) ** 2).sum(axis=1))
        d[q // 4] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10] * 4
        hits += len(set(found) & set(want.tolist()))
    assert hits >= 0.9 * 1200


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, None]), (200, None), (10, [2.0, 0.0]), (None, [1.0, 1.0]), (11, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(v, v.filter("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 2, 0.0), (100, 3, 3, 0.0)]
    assert ann.search(v.limit(0), v.limit(0)).count() == 0
    few = v.filter("vec_id in (0, 10)")
    assert [tuple(r) for r in ann.search(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 10, 1.0)]


def shingles(text, width):
    words = [w.encode().lower() for w in WORDS.findall(text or "")]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(docs, width, percent):
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_docs():
    """A chain of edits, a star of edits, exact copies in other letters, short texts and a common passage."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    base = [word() for _ in range(200)]
    docs, text = [], list(base)
    for i in range(12):
        docs.append((50 - i, " ".join(text)))
        text = list(text)
        for _ in range(3):
            text[int(rng.integers(0, 200))] = word()
    star = [word() for _ in range(120)]
    for i in range(40):
        t = list(star)
        for j in rng.integers(0, 120, int(rng.integers(0, 5))):
            t[j] = word()
        docs.append((100 + i, " ".join(t)))
    docs += [(200 + i, " ".join(base).upper() if i % 2 else "\n".join(base)) for i in range(20)]
    passage = " ".join(word() for _ in range(60))
    docs += [(300 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(30)]
    docs += [(400, "a b"), (401, "A  b"), (402, "a b c"), (403, ""), (404, None), (405, " \n"), (406, "a b c d"), (407, "a b c d")]
    return docs


@pytest.mark.parametrize(("width", "block"), [(4, neardup.BLOCK), (5, 7)])
def test_near_duplicates(spark, monkeypatch, width, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = near_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, width, 80).collect()}
    want = components(docs, width, 80)
    for d, (n, root) in want.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, root, root == d), d


def test_near_duplicate_edges(spark):
    df = odd_docs(spark)
    rows = neardup.near_duplicates(df, 4).collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert {r["component_id"] for r in by[5]} == {4}
    assert by[None][0]["component_id"] is None
    assert by[1][0]["kept"]
    assert neardup.near_duplicates(df.limit(0), 4).count() == 0
    kept = neardup.drop_near_duplicates(df.filter("doc_id is not null"))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
    for shared in (200, 600, 900):
        own = (1000 - shared) // 2
        a, b = np.sort(pool[: shared + own]), np.sort(np.concatenate([pool[:shared], pool[shared + own : shared + 2 * own]]))
        sk = neardup.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert (sk[0] == sk[1]).mean() == pytest.approx(shared / (shared + 2 * own), abs=0.12)
    tiny = neardup.sketches(np.array([5], np.uint64), np.array([1, 0]))
    assert (tiny[0] > 0).all()
    assert (tiny[1] == 0).all()


def test_components_by_joins(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["root"] for r in neardup.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert neardup.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_targets():
    sizes = {"a": 100, "b": 100, "c": 1000, None: 0}
    t = mixing.targets_of(sizes, {"a": 3, "b": 1, "c": 2, None: 3})
    assert t["a"] == 200
    assert t["b"] == 200 or t["b"] < 200
    assert t[None] == 0
    assert sum(t.values()) == pytest.approx(1800)
    assert all(t[k] <= 2 * sizes[k] + 1e-9 for k in sizes)


def test_flow_uses_overlap():
    f = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 10, "b": 11}, 2)
    assert f.placed == pytest.approx(21)
    assert f.cost == pytest.approx(0)
    assert f.amounts[("a", "b"), "b"] + f.amounts[("b",), "b"] == pytest.approx(11)
    more = mixing.min_cost_flow({("a",): 10}, {"a": 15}, 2)
    assert (more.placed, more.cost) == (pytest.approx(15), pytest.approx(5))
    assert mixing.min_cost_flow({}, {}, 2).placed == 0


def test_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    texts = {r["doc_id"]: r for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORDS.findall(texts[r["doc_id"]]["text"]))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    order = sorted(sizes)
    want = mixing.targets_of(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for s, v in by.items():
        assert v[0]["source_size"] == sizes[s]
        assert v[0]["target"] == pytest.approx(want[s])
        most = max(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - want[s]) <= most / 2
    assert mixing.take_mix(docs).columns == docs.columns
    assert mixing.take_mix(docs).count() == sum(r["copies"] for r in rows)


def test_words_before_line_ends(spark):
    """Characters that end a line for some pattern engines but are no white space here are words of their own."""
    texts = ["foo \u0085", "foo \u2028", "foo \u2029 \n", " \u0085", "a\u0085\n", "foo \r\n", "\u00a0", ""]
    docs = spark.createDataFrame([(i, t, "en", "abc"[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}
    assert got == {i: len(WORDS.findall(t)) for i, t in enumerate(texts)}
    db = duckdb.connect()
    table = docs.toPandas()
    db.register("documents", table)
    assert {r[0]: r[1] for r in db.sql(f"select doc_id, size from ({queries.oracle_sql()['op10_mixing']})").fetchall()} == got


def test_mix_edges(spark):
    docs = odd_docs(spark).drop("size")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.take_mix(docs).groupBy("doc_id").count().filter("count > 4").count() == 0
    several = spark.createDataFrame([(i, "a b c d", ["x", "y"] if i % 2 else ["x"]) for i in range(40)], "doc_id long, text string, source array<string>")
    taken = mixing.mix(several).agg(F.sum("taken")).collect()[0][0]
    assert taken == pytest.approx(1.5 * 160, abs=8)
