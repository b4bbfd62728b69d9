"""Language identification by segmentation-marginalised unigrams (operator 3).

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm; that of a text is the product over its words. Piece
probabilities are fitted by expectation maximisation (forward and backward) on words of a bounded sample of labelled
documents. Words are lower-cased, parted at white space and headed by the vocabulary's word mark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .bpe import TOKENIZERS

MARK = "▁"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: The white space at which ``str.split`` parts words, as a pattern for Spark.
_GAP = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def vocabulary_pieces(path: str) -> list[str]:
    """All pieces of a sentencepiece file, put in lower case, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return list(dict.fromkeys(p.lower() for p in found))


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One more character for a hash of a stretch of characters."""
    h = (h ^ c) * _MIX
    return h ^ (h >> np.uint64(29))


class PieceTable:
    """Finds, for many words at once, all pieces at all places, by hashes of prefixes of pieces."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        value = {}
        for i, p in enumerate(pieces):
            for k in range(1, len(p) + 1):
                value.setdefault(p[:k], -1)
            value[p] = i
        keys = list(value)
        hashes = np.zeros(len(keys), np.uint64)
        for length in range(1, self.longest + 1):
            which = [j for j, k in enumerate(keys) if len(k) == length]
            if which:
                codes = np.array([[ord(c) for c in keys[j]] for j in which], np.uint64)
                h = np.zeros(len(which), np.uint64)
                for c in range(length):
                    h = _step(h, codes[:, c])
                hashes[which] = h
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.keys, self.values = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -2, np.int32)
        for h, k in zip(hashes.tolist(), keys, strict=True):
            at = (h >> 20) & self.mask
            while self.values[at] != -2:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = h, value[k]

    def find(self, h: np.ndarray) -> np.ndarray:
        """A piece's number, -1 for the beginning of a piece, -2 for neither."""
        at = ((h >> np.uint64(20)) & np.uint64(self.mask)).astype(np.int64)
        out = np.full(len(h), -2, np.int32)
        open_ = np.arange(len(h))
        while len(open_):
            v = self.values[at]
            hit = (self.keys[at] == h[open_]) & (v != -2)
            out[open_[hit]] = v[hit]
            going = ~hit & (v != -2)
            open_, at = open_[going], (at[going] + 1) & self.mask
        return out

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in words: begin and end as places in a row of all words' nodes, the piece, and each word's first node.

        A word of n characters has n + 1 nodes. A character that is no piece gets an arc of the number len(pieces).
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(sizes + 1) - sizes - 1
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        node = np.arange(len(codes)) + np.repeat(np.arange(len(words)), sizes)
        live, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        begins, ends, ids = [], [], []
        for k in range(1, self.longest + 1):
            stay = room[live] >= k
            live, h = live[stay], h[stay]
            if not len(live):
                break
            h = _step(h, codes[live + k - 1])
            v = self.find(h)
            if k == 1:
                v_arc = np.where(v < 0, len(self.pieces), v)
                begins.append(node[live]), ends.append(node[live] + 1), ids.append(v_arc)
            else:
                hit = v >= 0
                begins.append(node[live[hit]]), ends.append(node[live[hit]] + k), ids.append(v[hit])
            live, h = live[v != -2], h[v != -2]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(begins), join(ends), join(ids).astype(np.int64), first


def _levels(words: list[str], table: PieceTable) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Arcs by the place of their end in the word; the words' first and last nodes."""
    begins, ends, ids, first = table.arcs(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word = np.searchsorted(first, ends, "right") - 1
    depth = ends - first[word]
    order = np.lexsort((ends, depth))
    cuts = np.searchsorted(depth[order], np.arange(1, (int(sizes.max()) if len(sizes) else 0) + 2))
    return [(begins[o], ends[o], ids[o]) for o in (order[i:j] for i, j in zip(cuts, cuts[1:], strict=False))], first, first + sizes


def forward(words: list[str], table: PieceTable, probabilities: np.ndarray) -> np.ndarray:
    """Log probabilities of words, one row each, one column for every row of ``probabilities``.

    Works on scaled sums: where a node's sum gets small, the word's scale is taken out, so words of any length have one.
    """
    if not words:
        return np.zeros((0, len(probabilities)))
    levels, first, last = _levels(words, table)
    p = np.ascontiguousarray(probabilities.T)
    n_langs = p.shape[1]
    alpha, scale = np.zeros((int(last[-1]) + 1, n_langs)), np.zeros((len(words), n_langs))
    alpha[first] = 1
    word_of = np.repeat(np.arange(len(words)), last - first + 1)
    for depth, (begins, ends, ids) in enumerate(levels, 1):
        made = alpha[begins] * p[ids]
        starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
        if len(starts):
            alpha[ends[starts]] = np.add.reduceat(made, starts, axis=0)
        if depth % 16 == 0:  # the nodes still needed lie at most the longest piece behind
            at = np.flatnonzero(last - first > depth)
            top = alpha[first[at] + depth]
            top = np.where(top > 0, top, 1)
            scale[at] += np.log(top)
            for back in range(min(table.longest, depth + 1)):
                alpha[first[at] + depth - back] /= top
    assert len(word_of) == len(alpha)
    with np.errstate(divide="ignore"):
        return np.log(alpha[last]) + scale


def _parts(words: list[str], most_chars: int = 1 << 20) -> Iterator[slice]:
    """Stretches of a list of words with a bounded number of characters; a longer word stands alone."""
    start = total = 0
    for i, w in enumerate(words):
        if i > start and total + len(w) > most_chars:
            yield slice(start, i)
            start, total = i, 0
        total += len(w)
    if words:
        yield slice(start, len(words))


def fit_pieces(words: list[str], counts: np.ndarray, table: PieceTable, rounds: int = 3, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities from counted words by expectation maximisation; the last one is for unknown characters.

    Sums are kept as logarithms, so words may have any length.
    """
    size = len(table.pieces) + 1
    p = np.full(size, 1.0 / size)
    for _ in range(rounds):
        log_p, total = np.log(p), np.zeros(size)
        for part in _parts(words):
            levels, first, last = _levels(words[part], table)
            alpha = np.full(int(last[-1]) + 1, -np.inf)
            beta = alpha.copy()
            alpha[first], beta[last] = 0, 0
            for begins, ends, ids in levels:
                starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
                if len(starts):
                    alpha[ends[starts]] = np.logaddexp.reduceat(alpha[begins] + log_p[ids], starts)
            for begins, ends, ids in reversed(levels):  # a level has one arc at most from each node
                beta[begins] = np.logaddexp(beta[begins], log_p[ids] + beta[ends])
            begins, ends, ids = (np.concatenate(x) for x in zip(*levels, strict=True))
            word = np.searchsorted(first, ends, "right") - 1
            total += np.bincount(ids, np.exp(alpha[begins] + log_p[ids] + beta[ends] - alpha[last][word]) * counts[part][word], size)
        p = (total + smooth) / (total + smooth).sum()
    return p


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray


def train(labelled: DataFrame, docs_per_language: int = 150, path: str = f"{TOKENIZERS}/piece_bpe_32k.model", seed: int = 7) -> LanguageModel:
    """Fit a model on ``text`` and ``lang`` of at most ``docs_per_language`` documents of every language.

    The documents are those of smallest hash of text and seed, taken whole, copies once; Spark counts their words, of any
    length, and the counts are all that reaches the driver. Rows with a null or empty text or a null
    lang are not learned from; without any row the model has no language. The least hashes are found without the
    texts: what is shuffled is a label and a hash of each different text, never the texts of every input split.
    """
    known = labelled.select("lang", "text", F.xxhash64("text", F.lit(seed)).alias("h")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    # copies are summed in the map tasks, so that a text repeated very often takes one place and sends one row a task
    least = known.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies")).select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= docs_per_language)
    chosen = least.select(F.col("lang").alias("l"), F.col("h").alias("k")).distinct()
    # at most docs_per_language pairs of 8 bytes and a label for each language
    sample = known.join(F.broadcast(chosen), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k")), "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    words = sample.select("lang", F.explode(F.split(F.lower("text"), _GAP)).alias("word")).filter(F.length("word") > 0)
    rows = words.groupBy("lang", "word").count().collect()
    pieces = vocabulary_pieces(path)
    table = PieceTable(pieces)
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["word"])):
        by.setdefault(r["lang"], []).append((MARK + r["word"], r["count"]))
    languages = sorted(by)
    fitted = [fit_pieces([w for w, _ in by[k]], np.array([c for _, c in by[k]], float), table) for k in languages]
    return LanguageModel(languages, pieces, np.stack(fitted) if fitted else np.zeros((0, len(pieces) + 1)))


class Scorer:
    """Scores texts in bulk; keeps the log probabilities of words that it has met, up to a number of words."""

    def __init__(self, model: LanguageModel, most_words: int = 300_000) -> None:
        self.model, self.table, self.most_words = model, PieceTable(model.pieces), most_words
        self._clear()

    def _clear(self) -> None:
        from .chunks import _Index

        self.index = _Index()
        self.known = np.zeros((1 << 12, len(self.model.languages)), np.float32)

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        while len(self.index) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        at = len(self.index) - len(fresh)
        for i in range(0, len(fresh), 20_000):
            part = [MARK + w for w in fresh[i : i + 20_000]]
            self.known[at + i : at + i + len(part)] = forward(part, self.table, self.model.probabilities)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(self.model.languages)
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        judged = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if n else []
        if not judged:
            return best, score
        split = [texts[i].lower().split() for i in judged]
        rows = [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in split]
        self._learn()
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        total = np.add.reduceat(self.known[np.concatenate(rows)].astype(np.float64), starts, axis=0)
        total -= total.max(axis=1, keepdims=True)
        posterior = np.exp(total)
        posterior /= posterior.sum(axis=1, keepdims=True)
        for i, k, s in zip(judged, posterior.argmax(axis=1).tolist(), posterior.max(axis=1).tolist(), strict=True):
            best[i], score[i] = self.model.languages[k], s
        if len(self.index) > self.most_words:
            self._clear()
        return best, score


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability under equal priors.

    ``und`` and 0 where the text is null or has no letter, or the model has no language. Ties go to the language that
    sorts first. Other columns pass unchanged; columns with the names of the new ones are replaced. Nothing is shuffled.
    """
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in (prediction, score)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(prediction, T.StringType(), False), T.StructField(score, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = common.held("langid", key, lambda: Scorer(shared.value))
        for batch in batches:
            for part in common.slices(batch, text):
                best, posterior = s.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(best), pa.array(posterior, pa.float64())], names=[*names, prediction, score])

    return common.map_arrow(docs.select(*names), run, schema, holds="langid")
