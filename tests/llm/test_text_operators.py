"""BPE, token files, language ID and secret scans against plain versions."""

import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow.llm import bpe, langid, secretscan, tokenstore

tokenizers = pytest.importorskip("tokenizers")
BYTE = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
WORD = f"{bpe.TOKENIZERS}/word_bpe_49k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE), reason="no vocabularies")

ODD = [
    "", " ", "  a  b", "\n\n x \n y", "don't we'll I'VE 's", "a b c", "x<|endoftext|>y<|endoftext|>", "a" * 700, "====----" * 40, "日本語 テスト",
    "²³½ ⅷ 12ab", "\x1c\x1d a\x1cb \x85x", "🙂👍🏽 é é", "\t\tfoo\r\nbar  ", "def f(x):\n    return  x\n", "١٢٣ שלום", "ſt ﬁ ªº İx ΑΣ σς", "Été., ABC.. a.b", "<|STARTOFTEXT|> <|startoftext|>é",
]


def library(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.compile_merges(bpe.read_vocabulary(BYTE)))


def check_codec(codec, t, texts):
    ids, counts = codec.encode([x.encode() for x in texts])
    back, at = codec.decode(ids, counts), 0
    for x, n, b, d in zip(texts, counts.tolist(), back, codec.decimal(ids, counts), strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want, x
        assert b.decode() == t.decode(want, skip_special_tokens=False)
        assert d.decode() == ",".join(map(str, want))
        at += n


def test_bpe_matches_the_library(codec, spark, small):
    t = library(BYTE)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_codec(codec, t, ODD + texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeinrst h\n\t'sé日1²-_  .,"), max_size=60), max_size=5))
def test_bpe_on_any_text(texts):
    check_codec(CODEC, LIBRARY, texts)


LIBRARY = library(BYTE) if os.path.exists(BYTE) else None
CODEC = bpe.Codec(bpe.compile_merges(bpe.read_vocabulary(BYTE))) if os.path.exists(BYTE) else None


def test_automaton_is_exact_on_a_small_vocabulary():
    """Every string over two letters, against merging by rank; merges of equal tokens included."""
    a = bpe.MergeAutomaton({b"a": 0, b"b": 1})
    merges = [(0, 0), (0, 1), (2, 2), (3, 0), (1, 3), (2, 3)]
    for i, (x, y) in enumerate(merges):
        a.add_gadget(x, y, 2 + i)

    def by_rank(word):
        ids = [0 if c == 97 else 1 for c in word]
        for i, (x, y) in enumerate(merges):
            out = []
            while ids:
                if len(ids) > 1 and (ids[0], ids[1]) == (x, y):
                    out.append(2 + i)
                    ids = ids[2:]
                else:
                    out.append(ids.pop(0))
            ids = out
        return ids

    machine = a.compiled()
    words = [bytes(97 + (k >> j & 1) for j in range(n)) for n in range(1, 11) for k in range(2**n)]
    ids, counts = machine.paths(words)
    ends = np.cumsum(counts)
    for word, i, j in zip(words, (ends - counts).tolist(), ends.tolist(), strict=True):
        assert ids[i:j].tolist() == machine._long(word, 3) == by_rank(word), word
    assert len(machine.paths([])[0]) == 0
    with pytest.raises(ValueError, match="lacks a byte"):
        machine.paths([b"abc"])
    with pytest.raises(ValueError, match="two merges"):
        a.add_gadget(0, 1, 3)


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (2, "", None), (None, "a퟿", "z")], "doc_id long, text string, n_tokens string")
    coded = bpe.encode(df)
    assert [f.name for f in coded.schema] == ["doc_id", "n_tokens", "ids"]
    back = {r["n_tokens"]: r["text"] for r in bpe.decode(coded).collect()}
    assert back == {"x": "hello world", "y": "", None: "", "z": "a퟿"}
    assert bpe.encode(df.limit(0)).count() == 0


def test_digests(spark):
    row = bpe.round_trip_digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]
    nothing = hashlib.sha256(b"").hexdigest()
    assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (0, nothing, nothing)


class Source:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**32])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(top)
    for n_docs in (0, 1, 40, 700):
        counts = rng.integers(0, 40, n_docs)
        ids = rng.integers(0, top, int(counts.sum()))
        ids[rng.random(len(ids)) < 0.02] = top - 1
        out = io.BytesIO()
        w = tokenstore.FileWriter(out)
        ends = np.cumsum(counts)
        for a in range(0, n_docs, 33):
            b = min(n_docs, a + 33)
            w.add(np.arange(a, b), counts[a:b], ids[ends[a] - counts[a] : ends[b - 1]], np.arange(a, b) % 5 == 0)
        w.close()
        data = out.getvalue()
        parts = list(tokenstore.read_parts(Source(data), len(data), 500))
        assert np.array_equal(np.concatenate([np.zeros(0, int), *(p[2] for p in parts)]), ids)
        assert np.array_equal(np.concatenate([np.zeros(0, int), *(p[1] for p in parts)]), counts)
        assert np.array_equal(np.concatenate([np.zeros(0, bool), *(p[3] for p in parts)]), np.arange(n_docs) % 5 == 0)
        if n_docs:
            with pytest.raises(ValueError, match="cut short"):
                list(tokenstore.read_parts(Source(data[:-7]), len(data) - 7))


def test_outliers_are_exceptions():
    ids = np.full(tokenstore.BLOCK, 7)
    ids[5] = 40_000
    (block,) = tokenstore.encode_blocks(ids)
    assert tokenstore.HEAD.unpack_from(block) == (7, 0, 1)
    assert np.array_equal(tokenstore.decode_blocks(block, np.array([0]), len(ids)), ids)


def test_token_files(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit("x").alias("start"))
    more = docs.unionByName(spark.createDataFrame([(9_000_000 + i, t, "y") for i, t in enumerate([*ODD, None])], docs.schema))
    rows = tokenstore.store_round_trip(more.repartition(3)).orderBy("doc_id").collect()
    t, at = library(WORD), 0
    for r, d in zip(rows, more.orderBy("doc_id").collect(), strict=True):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenstore.store_round_trip(more.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "x y", "z"), (None, None, "z"), (None, "x y", "z"), (7, "a", "z")], docs.schema)
    rows = tokenstore.store_round_trip(none.repartition(2)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [7, None, None, None]
    assert sum(r["n_tokens"] for r in rows[:-1]) == rows[-1]["start"]
    twice = tokenstore.store_round_trip(docs.limit(5).union(docs.limit(5)))
    assert twice.count() == 10
    assert twice.select("start").distinct().count() == 10


PIECES = ["▁", "▁h", "he", "hel", "l", "lo", "o", "e", "▁hello", "x", "é"]


def test_forward_sums_all_segmentations():
    table = langid.PieceTable(PIECES)
    p = np.random.default_rng(0).random((2, len(PIECES) + 1))

    def all_ways(word, q):
        if not word:
            return 1.0
        total = 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in PIECES:
                total += q[PIECES.index(word[:k])] * all_ways(word[k:], q)
            elif k == 1:
                total += q[-1] * all_ways(word[k:], q)
        return total

    words = ["▁hello", "▁", "▁hellohellox", "zz", "▁hé", "lolo"]
    got = langid.forward(words, table, p)
    assert np.allclose(np.exp(got), [[all_ways(w, q) for q in p] for w in words])
    long = langid.forward(["▁" + "lo" * 4000], table, p)
    assert np.isfinite(long).all()


def test_expectation_maximisation_gains():
    table = langid.PieceTable(PIECES)
    words, counts = ["▁hello", "▁helo", "▁loxo"], np.array([5.0, 2.0, 1.0])
    likelihood = [float((langid.forward(words, table, langid.fit_pieces(words, counts, table, r, 1e-9)[None])[:, 0] * counts).sum()) for r in (1, 2, 4)]
    assert likelihood == sorted(likelihood)


def test_language_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path).select("doc_id", "text", "lang")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    model = langid.train(docs.filter(~held))
    assert model.languages == ["de", "en", "es", "fr"]
    told = langid.identify(docs.filter(held), model).filter(F.length("text") > 40)
    right = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).collect()[0]["a"]
    assert right > 0.97


def test_language_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 --- ²", "c"), (4, "hello there hello", "d"), (5, "x" * 5000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = langid.train(spark.createDataFrame([("hello there", "en"), ("bonjour ici", "fr"), (None, "de"), ("?", None)], "text string, lang string"))
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    assert got[1][1] == 0.0
    assert 0 <= got[5][1] <= 1
    empty = langid.train(df.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}


def test_languages_without_spaces(spark):
    """Every run between white space is far longer than a word; ideographic spaces part words as well."""
    rng = random.Random(5)
    thai, kana = ["ภาษาไทย", "ประเทศ", "การศึกษา", "วันนี้", "อาหาร", "น้ำตก", "ที่", "และ"], ["ことば", "にほん", "です", "これは", "あります", "ところ", "から", "みなさん"]
    run = lambda words: "".join(rng.choices(words, k=200))
    english = "the quick brown fox and the lazy dog went to the river in the morning"
    made = lambda: [(run(thai), "th"), ("\u3000".join([run(kana), run(kana)]), "ja"), (english, "en")]
    model = langid.train(spark.createDataFrame([r for _ in range(5) for r in made()], "text string, lang string"))
    assert model.languages == ["en", "ja", "th"]
    told = langid.identify(spark.createDataFrame([r for _ in range(5) for r in made()], "text string, lang string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in told)
    table = langid.PieceTable(model.pieces)
    long = langid.fit_pieces([langid.MARK + "ab" * 4000], np.array([1.0]), table, smooth=1e-9)
    assert np.isfinite(long).all() and long[[i for i, p in enumerate(model.pieces) if set(p) <= {"a", "b"}]].sum() > 0.9


def test_copies_are_learned_once(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(words) for _ in range(12)), lang) for lang, words in (("en", ["the", "house", "stands", "there"]), ("fr", ["la", "maison", "est", "grande"])) for _ in range(30)]
    rows = list(dict.fromkeys(rows))
    copies = [r for i, r in enumerate(rows) for _ in range(1 + 7 * (i % 5))]
    models = [langid.train(spark.createDataFrame(r, "text string, lang string"), docs_per_language=6) for r in (rows, copies)]
    assert models[0].languages == models[1].languages == ["en", "fr"]
    assert np.array_equal(models[0].probabilities, models[1].probabilities)


def test_all_pieces_of_the_vocabulary():
    pieces = set(langid.vocabulary_pieces(f"{langid.TOKENIZERS}/piece_bpe_32k.model"))
    assert langid.MARK in pieces
    assert any(len(p) > 12 for p in pieces)


def plain_base(text):
    """The base patterns as they are written."""
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    out = []
    for k, (_, pattern, keep) in enumerate(kinds):
        flags = re.IGNORECASE | re.ASCII if k == 0 else 0
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if keep(m)]
    return sorted(out)


def test_base_spans(spark, small):
    rng = random.Random(3)
    parts = ["password=", "TOKEN: ", 'api_key" = "', "apikey:", "secret", "AKIA", "ABCDEFGH1234567890", "abc", "0123456789abcdef" * 2, " ", "\n", "=", "hunter2x", "short", "ſecret=abcdefg", "é🙂", "passwd='", "_token = xxxxxxx"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in texts:
        spans = secretscan.scan(t)
        assert [s for s in spans if s[1] < 3] == plain_base(t)
        assert spans == sorted(spans)


def test_lexer_propagates_constants():
    text = 'A = "q8WwEe77rrTt00"\nB = A\ndb_password = B\nprice = "q8WwEe77rrTt00"\nclientSecret = "Zx9" + "Yw8Vu7Ts6"\nauth_token: ${TOKEN}\napi_secret = changeme\n"private_key": "pK1234567890abc"\n'
    found = [text[s:e] for s, e in secretscan.lexed_spans(text)]
    assert found == ["q8WwEe77rrTt00", "Yw8Vu7Ts6", "pK1234567890abc"]
    assert text.index("q8WwEe77rrTt00") == secretscan.lexed_spans(text)[0][0]
    assert secretscan.lexed_spans("The secret of the town: nobody knows; keys = many.") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('signing_key = "aB3dE" + "xY9zK" + "q7LmP"', ["aB3dE", "xY9zK", "q7LmP"]),
        ('PREFIX = "aB3dE"\npwd = PREFIX + "xY9zKq7LmP"', ["aB3dE", "xY9zKq7LmP"]),
        ('TAIL = "xY9zKq7LmP"\npwd = "aB3dE" + TAIL', ["xY9zKq7LmP", "aB3dE"]),
        ('A = "aB3dE9"\nB = "xY9zKq"\npwd = A+B', ["aB3dE9", "xY9zKq"]),
        ('A = B + "x"\nB = A + "y"\npwd = A + B', []),
        ('app.secret_key = b"q8WwEe77rrTt00"', ["q8WwEe77rrTt00"]),
        ("secret_key = rb'q8WwEe77rrTt00'", ["q8WwEe77rrTt00"]),
        ('secret_key = f"{settings.token}"', []),
        ('secret_key = """q8WwEe77rrTt00"""', ["q8WwEe77rrTt00"]),
        ("secret_key = \\\n    'q8WwEe77rrTt00'", ["q8WwEe77rrTt00"]),
        ("secret_key" + " " * 60 + "=" + " " * 60 + '"q8WwEe77rrTt00"', ["q8WwEe77rrTt00"]),
        ('secret_key = "q8WwEe7" +\n  "7rrTt00"', ["q8WwEe7", "7rrTt00"]),
        ('base = "abcd1234Qx"; secret_key = base + "Zz99Yy88"', ["abcd1234Qx", "Zz99Yy88"]),
        ('my_secret = "ab1C" + "d2E" + "f3G9"', ["ab1C", "d2E", "f3G9"]),
        ('api_secret = LATER\nLATER = "q8WwEe77rrTt00"', []),
        ('X = "plain words"\nX = "q8WwEe77rrTt00"\ndb_password = X\nX = "Other99Value00"', ["q8WwEe77rrTt00"]),
        ('secret_key = prefix_of_some_kind + "ab"', []),
        ("private_key: |\n  q8WwEe77rrTt00\n  pK1234567890abc\nnext: 1", ["q8WwEe77rrTt00", "pK1234567890abc"]),
        ('# auth_token = "q8WwEe77rrTt00"', ["q8WwEe77rrTt00"]),
    ],
)
def test_lexer_joins_values(text, want):
    assert [text[s:e] for s, e in secretscan.lexed_spans(text)] == want


def plain_score(value):
    """Length, entropy and kinds of a value that is at hand as a whole."""
    n = len(value)
    if n < 6 or re.match(r"(?i)^(?:x{3,}|\*+|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|change.?me|your.*|example.*|todo|none|null|true|false|undefined|redacted)$", value):
        return 0.0
    shares = [value.count(c) / n for c in set(value)]
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, n / 16) * min(1.0, -sum(p * np.log2(p) for p in shares) / 3.0) * (0.4 + 0.2 * min(3, kinds))


def test_scores_of_joined_values_against_whole_texts():
    rng = random.Random(4)
    parts = ["xxx", "X", "***", "...", "<a", ">", "${", "}", "{{", "}}", "%(", ")s", "changeme", "your", "example", "todo", "\n", "Abc1", "9", "-", "aB3dE5fG7", "q" * 40, "x" * 40, "." * 40]
    for _ in range(5000):
        pieces = [rng.choice(parts) for _ in range(rng.randint(1, 10))]
        want = plain_score("".join(pieces))
        assert secretscan.literal_score("".join(pieces)) == pytest.approx(want, abs=1e-12), pieces
        assert secretscan.Value.join([secretscan.Value.of(p) for p in pieces]).score() == pytest.approx(want, abs=1e-12), pieces


def test_whole_values_are_scored():
    late = "".join(chr(97 + i % 26) + str(i % 10) + chr(65 + i % 26) for i in range(1000))
    text = f'my_secret = "{"a" * 1100}" + "{late}"'
    assert late in [text[s:e] for s, e in secretscan.lexed_spans(text)]
    many = "my_secret = " + " + ".join(['"aa"'] * 1100 + [f'"{late[i : i + 3]}"' for i in range(0, 3000, 3)])
    assert len(secretscan.lexed_spans(many)) == 2100
    # doubled again and again, a value is far longer than any text could be
    doubled = 'a = "Zx9Yw8Vu7"\n' + "a = a + a\n" * 5000 + 'secret_key = a + "tS6Rq5Po4"\n'
    assert [doubled[s:e] for s, e in secretscan.lexed_spans(doubled)] == ["Zx9Yw8Vu7", "tS6Rq5Po4"]


def plain_environment(lines, weights):
    """Values that a sensitive name takes, line by line, with an environment that only knows what stands above."""
    known, told = {}, set()
    for name, parts in lines:
        values = [known.get(p, ("", [])) if p.isidentifier() else (p.strip('"'), [p.strip('"')]) for p in parts]
        if len(parts) == 1 and parts[0].isidentifier() and parts[0] not in known:
            values = [(parts[0], [parts[0]])]
        text, pieces = "".join(v for v, _ in values), [q for _, ps in values for q in ps]
        known[name] = (text, pieces)
        if weights[name] * secretscan.literal_score(text) >= secretscan.THRESHOLD:
            told.update(pieces)
    return told


def test_constants_against_an_environment():
    rng = random.Random(8)
    names = ["alpha", "beta", "gamma", "my_secret", "auth_token", "db_password"]
    weights = {n: secretscan.name_score(n) for n in names}
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(1, 9)):
            literal = lambda: '"' + "".join(rng.choice("aB3dE7gH9kL1mN") for _ in range(rng.choice([4, 5, 14]))) + '"'
            lines.append((rng.choice(names), [literal() if rng.random() < 0.6 else rng.choice(names[:3]) for _ in range(rng.randint(1, 3))]))
        text = "\n".join(f"{n} = {' + '.join(p)}" for n, p in lines)
        got = {text[s:e] for s, e in secretscan.lexed_spans(text)}
        want = plain_environment(lines, weights)
        # values of one literal each agree; joined ones may leave out a name's own text where it stands for nothing
        assert got >= {w for w in want if len(w) >= 14}, text
        assert got <= want | {p.strip('"') for _, ps in lines for p in ps if weights[_] and secretscan.literal_score(p.strip('"')) >= secretscan.THRESHOLD}, text


def test_secret_frames(spark):
    df = spark.createDataFrame([(1, None, 0, "a"), (2, "", 0, "b"), (3, "x password=hunter2xx y", 22, "c"), (3, "🙂 token: abcdef1", 16, None)], "doc_id long, text string, n_chars long, spans string")
    rows = {r["doc_id"]: r for r in secretscan.secret_digests(df).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (rows[1]["n_assign"], rows[1]["base_sha256"], rows[1]["spans"]) == (0, nothing, "")
    spans = {tuple((s["kind"], s["start"], s["end"]) for s in r["spans"]) for r in secretscan.find_secrets(df).collect()}
    assert (("assign", 2, 16),) in spans
    red = {r["n_chars"]: r["text"] for r in secretscan.redact_secrets(df).collect() if r["text"]}
    assert all("hunter2" not in t and len(t) == n for n, t in red.items())
    assert secretscan.redact_secrets(df).columns == df.columns
    assert secretscan.secret_digests(df.limit(0)).count() == 0
