"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, materialize

# Common insults, and second-person words, in a few languages.
INSULTS = """
idiot idiots stupid moron morons imbecile dumb dumbass loser losers scum trash garbage worthless pathetic disgusting
vile filthy clown fool jerk bastard bitch asshole shit fuck fucking crap damn hate kill die ugly pig vermin freak
idiota estupido estupida imbecil basura asqueroso patetico inutil tonto mierda
idiote stupide imbecile ordure degoutant pathetique connard debile merde nul
dumm dummkopf trottel abschaum widerlich erbarmlich wertlos arschloch scheisse
""".split()
SECOND_PERSON = "you your yours yourself u ur tu te ti tus usted ustedes vous votre vos toi ton du dich dir dein deine ihr euch".split()
_LEET = bytes.maketrans(b"0134578@$!", b"oieastbasi")

#: Labelled rows that a fit reads at most: those with the smallest hash of their id. Words of the learned lexicon at most, and beginnings of words.
SAMPLE, LEXICON = 20_000, 2_000
#: Bytes of the word beginnings that are learned like words, and mark them: invented and inflected forms share those.
STEMS, STEM = (3, 4, 5, 6, 7, 8, 10), b"^"
#: Least documents of a word in the lexicon, and least log-odds of it.
MIN_DOCS, MIN_ODDS = 3, 1.5
FOLDS = 4
FEATURES = [
    "log_words", "insults", "insults_per_word", "learned", "learned_per_word", "learned_sum", "learned_max", "near_you", "you_per_word",
    "capitals", "shouted_words", "exclaims", "punctuation", "obfuscated_per_word", "obfuscated_hits", "stems", "stems_sum", "stems_per_word",
]
NEAR = 5  # words between a lexicon word and a second-person word, at most

_BARE, _ODD, _LETTER = re.compile(rb"[^a-z0-9\x80-\xff]+"), re.compile(rb"[\x00-\x60\x7b-\x7f]"), re.compile(rb"[a-z]")
_NO_CAPITALS = bytes(c for c in range(256) if not 65 <= c < 91)
_EDGE = bytes(c for c in range(128) if not chr(c).isalnum() and c not in b"@$")


def _stems(low: bytes) -> list[bytes]:
    """The word's beginnings, short of the whole."""
    return [STEM + low[:k] for k in STEMS if k < len(low)]


class Reader:
    """Turns texts into features, looking each distinct word up once. Memory: MOST words, then it starts anew."""

    MOST = 400_000

    def __init__(self, learned: dict[bytes, float]):
        self.learned = {w: o for w, o in learned.items() if not w.startswith(STEM)}
        self.stems = {w[len(STEM) :]: o for w, o in learned.items() if w.startswith(STEM)}
        self.lengths = sorted({len(w) for w in self.stems})
        self.insults = {w.encode() for w in INSULTS}
        self.you = {w.encode() for w in SECOND_PERSON}
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, 7), np.float32)  # grows by doubling

    def look(self, word: bytes) -> tuple:
        low = word.lower().strip(_EDGE)
        insult, odds, odd = low in self.insults, self.learned.get(low, 0.0), False
        if _ODD.search(low):  # most words have letters alone
            plain = _BARE.sub(b"", low.translate(_LEET))
            odd = plain != low and len(plain) >= 3 and _LETTER.search(low) is not None
            insult, odds = insult or plain in self.insults, max(odds, self.learned.get(plain, 0.0))
        stem, n = 0.0, len(low)
        for k in self.lengths:
            if k >= n:
                break
            if (o := self.stems.get(low[:k], 0.0)) > stem:
                stem = o
        shouted = word.isupper() and len(word.translate(None, _NO_CAPITALS)) >= 3
        return insult, odds, low in self.you, shouted, odd, odd and (insult or odds > 0), stem

    def features(self, text: bytes) -> list[float]:
        words = text.split()
        n = len(words)
        if len(self.number) > self.MOST:
            self.reset()
        number = self.number
        try:
            ids = list(map(number.__getitem__, words))
        except KeyError:
            new = [w for w in set(words) if w not in number]
            at = len(number)
            while at + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[at : at + len(new)] = [self.look(w) for w in new]
            number.update(zip(new, range(at, at + len(new)), strict=True))
            ids = list(map(number.__getitem__, words))
        if not n:
            return [0.0] * len(FEATURES)
        f = self.table[np.array(ids)]
        total = f.sum(0, dtype=np.float64)
        bad = np.flatnonzero((f[:, 0] > 0) | (f[:, 1] > 0))
        you = np.flatnonzero(f[:, 2] > 0)
        near = 0
        if len(bad) and len(you):
            at = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - bad), np.abs(you[np.maximum(at - 1, 0)] - bad))
            near = int((gap <= NEAR).sum())
        data = np.frombuffer(text, np.uint8)
        upper = int(((data >= 65) & (data < 91)).sum())
        lower = int(((data >= 97) & (data < 123)).sum())
        marks = int(((data > 32) & (data < 127)).sum()) - upper - lower
        return [
            np.log1p(n), total[0], total[0] / n, float((f[:, 1] > 0).sum()), float((f[:, 1] > 0).sum()) / n, total[1], float(f[:, 1].max()), near, total[2] / n,
            upper / (upper + lower + 1), total[3] / n, text.count(b"!") / n, marks / len(data), total[4] / n, total[5], float((f[:, 6] > 0).sum()), total[6], total[6] / n,
        ]


class Trees:
    """Boosted regression trees for the logistic loss, on features cut into at most 32 bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        margin, nodes = np.full(len(y), self.start), 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes * 2 + 1)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                mine = np.flatnonzero(at == node)
                if not len(mine) or h[mine].sum() < 2 * self.least / 4:
                    continue
                best = (1e-6, -1, 0)
                total_g, total_h = g[mine].sum(), h[mine].sum()
                for k in range(x.shape[1]):
                    if not len(self.cuts[k]):
                        continue
                    gs = np.cumsum(np.bincount(binned[mine, k], g[mine], self.bins + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[mine, k], h[mine], self.bins + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    gain[(hs < self.least / 4) | (total_h - hs < self.least / 4)] = 0
                    j = int(gain.argmax())
                    if gain[j] > best[0] and j < len(self.cuts[k]):
                        best = (gain[j], k, j)
                if best[1] < 0:
                    continue
                feature[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
                at[mine] = 2 * node + 1 + (binned[mine, best[1]] > best[2])
            for leaf in np.unique(at):
                mine = at == leaf
                value[leaf] = self.rate * g[mine].sum() / (h[mine].sum() + 1)
            margin += value[at]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = np.where(at < len(feature), feature[np.minimum(at, len(feature) - 1)], -1)
                c = cut[np.minimum(at, len(cut) - 1)]
                at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > c), at)
            out += value[at]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing step function (pool adjacent violators), one at each block's mean margin."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, w2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + w2, blocks[-1][2] + m2]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


class Model:
    """Lexicon, trees and calibration: a few hundred kB at most, whatever the input."""

    def __init__(self, learned: dict[bytes, float], trees: Trees | None, points: tuple[np.ndarray, np.ndarray], base: float):
        self.learned, self.trees, self.points, self.base = learned, trees, points, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        m = self.trees.margin(x)
        # within a step of the calibration the margin still ranks: a hundredth of the score is its logistic
        return 0.99 * np.interp(m, *self.points) + 0.01 / (1 + np.exp(-m))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each batch with a word or a beginning, by label and fold."""
    for b in batches:
        counts: Counter[tuple[bytes, int, int]] = Counter()
        for text, toxic, fold in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            words = {w.lower().strip(_EDGE) for w in set((text or b"").split())}
            words = {w for w in words if 2 < len(w) <= 40}
            counts.update((w, toxic, fold) for w in words.union(*map(_stems, words)))
        if counts:
            words, toxic, fold = zip(*counts, strict=True)
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(counts.values(), pa.int64())], ["word", "toxic", "fold", "n"])


def _featurizer(readers: Callable[[], list[Reader]]):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = readers()
        for b in batches:
            texts, toxic, folds = (b.column(k).to_pylist() for k in (1, 2, 3))
            rows = [made[f].features(t or b"") for t, f in zip(texts, folds, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(toxic, pa.int32()), pa.array(folds, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["id", "toxic", "fold", "x"])

    return features


def _lexicon(counts: dict[bytes, list[float]], docs: list[float]) -> dict[bytes, float]:
    """Words by smoothed log-odds of a document with the word being toxic against one without label knowledge."""
    scored = []
    for word, (clean, toxic) in counts.items():
        odds = float(np.log((toxic + 0.5) / (docs[1] + 1.0)) - np.log((clean + 0.5) / (docs[0] + 1.0)))
        if toxic >= MIN_DOCS and odds >= MIN_ODDS:
            scored.append((-odds * np.sqrt(toxic), word, odds))
    scored.sort()
    both = [[x for x in scored if x[1].startswith(STEM) == stem][:LEXICON] for stem in (False, True)]
    return {w: o for part in both for _, w, o in part}


def held_out_column(c):
    """crc32 of the id's text, modulo 3, is 1: such rows are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from the labelled rows that are not held out, at most ``sample`` of them.

    Features of a row come from a lexicon that was learned without the row's fold, and so do the margins on
    which the calibration is fitted. Without both labels among the rows, the model is their share of ones.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out_column(F.col(id_col)))
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample)
    chosen = materialize(chosen.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(8)), F.lit(FOLDS)).cast("int")), "chosen")
    kind = chosen.schema["id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    # of several texts of one id the one with the smallest hash, so that reruns learn the same
    rows = rows.groupBy("id", "toxic", "fold").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "t.text", "toxic", "fold")
    rows = materialize(rows, "sample")
    sizes = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    ones, n = sum(v for k, v in sizes.items() if k[1]), sum(sizes.values())
    if not ones or ones == n:
        return Model({}, None, (np.zeros(1), np.zeros(1)), ones / n if n else 0.5)

    words = rows.select("id", "text", "toxic", "fold").mapInArrow(_distinct_words, "word binary, toxic int, fold int, n bigint")
    per_fold = [F.coalesce(F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n"))), F.lit(0)).alias(f"c{t}_{f}") for t in (0, 1) for f in range(FOLDS)]
    counts = words.groupBy("word").agg(*per_fold)
    toxic, clean = (sum((F.col(f"c{t}_{f}") for f in range(FOLDS)), F.lit(0)) for t in (1, 0))
    # words that could pass in all data or without one fold, the most telling first: a bounded list
    odds = F.log((toxic + 0.5) / (ones + 1.0)) - F.log((clean + 0.5) / (n - ones + 1.0))
    telling = counts.where((toxic >= MIN_DOCS) & (odds >= MIN_ODDS / 2)).orderBy(F.desc(odds * F.sqrt(toxic)), "word")
    stem = F.substring("word", 1, 1) == F.lit(STEM)
    telling = [r for part in (telling.where(~stem), telling.where(stem)) for r in part.limit(2 * LEXICON).collect()]
    lexicons = []
    for left_out in [*range(FOLDS), None]:
        kept = [f for f in range(FOLDS) if f != left_out]
        of = [float(sum(sizes.get((f, t), 0) for f in kept)) for t in (0, 1)]
        lexicons.append(_lexicon({bytes(r.word): [float(sum(r[f"c{t}_{f}"] for f in kept)) for t in (0, 1)] for r in telling}, of))
    found = rows.select("id", "text", "toxic", "fold").mapInArrow(_featurizer(lambda: [Reader(x) for x in lexicons[:-1]]), f"id {kind}, toxic int, fold int, x array<double>")
    found = found.orderBy("id").collect()  # at most `sample` rows of a few numbers
    x, y, fold = np.array([r.x for r in found]), np.array([r.toxic for r in found], float), np.array([r.fold for r in found])
    out = np.zeros(len(y))
    for f in range(FOLDS):
        rest = fold != f
        if rest.any() and (~rest).any():
            out[~rest] = Trees().fit(x[rest], y[rest]).margin(x[~rest])
    return Model(lexicons[-1], Trees().fit(x, y), isotonic(out, y), ones / n)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``(row, score, predicted)`` for each row of ``docs``, ``row`` being its columns or those to ``keep``; one pass without a shuffle."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.learned)
        for b in batches:
            x = np.array([reader.features(t or b"") for t in b.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            s = np.clip(model.scores(x), 0.0, 1.0)
            yield pa.record_batch([b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    packed = docs.select(F.col(text_col).cast("binary").alias("bytes"), F.struct(*(keep or docs.columns)).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return packed.mapInArrow(scores, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more."""
    model = fit(docs, labels, id_col, text_col, label_col)
    return score(docs, model, text_col, threshold).where("predicted = 0").select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """``(id, held_out, score, predicted)``, a row for each row of ``docs``.

    The score needs the text alone: densities of a fixed and of a learned lexicon, their nearness to
    second-person words, capitals, punctuation and obfuscated spellings go through boosted trees and an isotonic
    calibration. Null and empty texts get the score of a text without words. Null ids are scored, not learned
    from. Labels other than 0 and 1 are ignored; of contradicting labels 1 counts. Repeated rows stay.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    s = score(docs, model, text_col, threshold, [id_col]).select(F.col("row")[id_col].alias(id_col), "score", "predicted")
    return s.select(id_col, held_out_column(F.col(id_col)).alias("held_out"), "score", "predicted")


by_value(__name__)
