"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of lexicon words and of their stems, written plainly or in disguise; how near these stand to a second
person; capitals; punctuation; obfuscation; length. The lexicon is learned from labelled texts: words, and beginnings of words, that
toxic texts hold far more often. Trees are grown on a bounded sample of labelled rows (`sample_rows`, the smallest hashes); a fifth of it,
which neither the lexicon nor the trees see, is kept back to calibrate the scores. Labels are learned only from rows that are not held out: crc32 of the id as text, mod
5, is not 0. The model is a few hundred kilobytes whatever the table's size.

Defined results. A null text counts as empty; an empty text has a score like any other. A null id is not held out and never learned from. Without
labels to learn from, or with one label only, every score is the share of toxic labels (0 without labels). Repeated rows fare alike.
An empty table gives an empty table. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

SAMPLE_ROWS, LEXICON, STEMS = 20_000, 3000, (3, 4, 5, 6)
TREES, DEPTH, RATE, BINS = 120, 4, 0.1, 48

# Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch ti tú usted ustedes tuyo vosotros os".split())
# Characters that stand in for letters.
DISGUISE = str.maketrans("013457@$!|€", "oieastasiie")

WORD = re.compile(r"\w[\w'’*@$!|-]*\w|\w")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
HIT, STEM, YOU, CAPS, ODD, HIDDEN = 1, 2, 4, 8, 16, 32
FEATURES = ("hits", "log_hits", "stems", "log_stems", "hidden", "near_you", "log_near_you", "you", "capitals", "caps_words", "exclaims", "questions", "marks", "mark_runs", "odd", "spaced", "log_words", "word_length", "hit_weight", "top_weight")
MARK_RUN, SPACED = re.compile(r"[!?*#$%&]{2,}"), re.compile(r"(?<!\w)(?:\w[ .*_-]){3,}\w(?!\w)")

SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


#: Of each code point of the first plane: 1 for a capital, 2 for a letter.
_KIND = np.array([chr(c).isupper() | chr(c).isalpha() << 1 for c in range(0x10000)], np.uint8)


def letters(text: str) -> tuple[int, int]:
    """The number of capitals, and of letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = codes > 0xFFFF
    if far.any():
        rest = [chr(c) for c in codes[far].tolist()]
        codes = codes[~far]
    else:
        rest = []
    count = np.bincount(_KIND[codes], minlength=4)
    return int(count[1] + count[3]) + sum(c.isupper() for c in rest), int(count[2] + count[3]) + sum(c.isalpha() for c in rest)


def plain(word: str) -> str:
    """A word without disguises: look-alike characters replaced, marks left out, runs of a letter cut to one."""
    return REPEATED.sub(r"\1", re.sub(r"[\W_]", "", word.translate(DISGUISE)))


def forms(word: str) -> list[str]:
    """What of a word may be in the lexicon: the word, and its beginnings, marked as such."""
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]


class Codes(dict):
    """word as written -> (flags, weight); emptied when it has grown to 100,000 words."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def _weight(self, word: str) -> tuple[float, float]:
        got = [self.lexicon.get(f, 0.0) for f in forms(word)]
        return got[0], max(got[1:], default=0.0)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= 100_000:
            self.clear()
        low = word.lower()
        whole, stem = self._weight(low)
        code = HIT * (whole > 0) | STEM * (stem > 0) | YOU * (low in SECOND_PERSON) | CAPS * (len(word) > 1 and word.isupper())
        bare = plain(low)
        if bare != low:
            code |= ODD
            if not whole and (w := self._weight(bare))[0]:
                whole, code = w[0], code | HIT | HIDDEN
        self[word] = out = (code, max(whole, stem))
        return out


def features(text: str, codes: Codes) -> list[float]:
    pairs = np.array([codes[w] for w in WORD.findall(text)], np.float64).reshape(-1, 2)
    n, length = max(1, len(pairs)), max(1, len(text))
    code, weight = pairs[:, 0].astype(np.int64), pairs[:, 1]
    hit, you = np.flatnonzero(code & (HIT | STEM)), np.flatnonzero(code & YOU)
    near = 0
    if len(hit) and len(you):
        k = np.searchsorted(you, hit)
        near = int((np.minimum(np.abs(hit - you[np.maximum(k - 1, 0)]), np.abs(hit - you[np.minimum(k, len(you) - 1)])) <= 5).sum())
    count = [int(np.count_nonzero(code & f)) for f in (HIT, STEM, HIDDEN, YOU, CAPS, ODD)]
    upper, alpha = letters(text)
    alpha = max(1, alpha)
    marks = len(MARK_RUN.findall(text)) if any(c in text for c in "!?*#$%&") else 0
    other = length - alpha - text.count(" ") - text.count("\n")
    return [
        count[0] / n, np.log1p(count[0]), count[1] / n, np.log1p(count[1]), count[2] / n, near / n, np.log1p(near), count[3] / n, upper / alpha, count[4] / n,
        text.count("!") / length, text.count("?") / length, other / length, marks / n, count[5] / n, len(SPACED.findall(text)) / n, np.log1p(len(pairs)), alpha / n, weight.sum() / n, np.sort(weight)[-3:].sum() if len(weight) else 0.0,
    ]


class Trees:
    """Boosted trees of fixed depth for logistic loss, over features cut at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-out))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            out += self._leaf(binned, tree)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)

    @staticmethod
    def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and highest left bin of each inner node (in heap order), values of the leaves."""
        feature, cut, node = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS), np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for f in range(binned.shape[1]):
                at = (node - first) * (BINS + 1) + binned[:, f]
                sg, sh = (np.bincount(at, v, many * (BINS + 1)).reshape(many, -1).cumsum(1) for v in (g, h))
                left, right = sg**2 / (sh + 1), (sg[:, -1:] - sg) ** 2 / (sh[:, -1:] - sh + 1)
                gain = left + right - sg[:, -1:] ** 2 / (sh[:, -1:] + 1)
                gain[(sh < 1) | (sh[:, -1:] - sh < 1)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(many), k] > best
                best = np.where(better, gain[np.arange(many), k], best)
                feature[first : first + many][better], cut[first : first + many][better] = f, k[better]
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        return feature, cut, RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)

    @staticmethod
    def _leaf(binned: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - (2**DEPTH - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum(self._leaf(binned, t) for t in self.trees)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to y, as points between which to interpolate; pooled by adjacent violators. One of each label is
    added at the ends, so that no score is quite 0 or 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in [(score.min() - 1, 0.0), *zip(score[order], y[order], strict=True), (score.max() + 1, 1.0)]:
        blocks.append([s, s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, total, n = blocks.pop()
            blocks[-1][1:] = hi, blocks[-1][2] + total, blocks[-1][3] + n
    at = np.array([p for b in blocks for p in b[:2]])
    value = np.repeat([b[2] / b[3] for b in blocks], 2)
    return at, np.clip(value, 1e-4, 1 - 1e-4)


class Model:
    """Lexicon, trees and calibration; without trees, a constant score."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray | None, y: np.ndarray, kept_back: np.ndarray | None):
        self.lexicon, self.rate, self.trees = lexicon, float(y.mean()) if len(y) else 0.0, None
        if x is not None and len(set(y)) > 1 and len(set(y[~kept_back])) > 1:
            self.trees = Trees(x[~kept_back], y[~kept_back])
            use = kept_back if len(set(y[kept_back])) > 1 else ~kept_back
            self.points = isotonic(self.trees.margin(x[use]), y[use])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.rate)
        margin = self.trees.margin(x)
        # A little of the uncalibrated score keeps the order within a step.
        return 0.98 * np.interp(margin, *self.points) + 0.02 / (1 + np.exp(-margin))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) -> (form, toxic texts, other texts) of each task."""
    count: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for form in {f for w in {x.lower() for x in WORD.findall(text)} for f in forms(w)}:
                count.setdefault(form, [0, 0])[not toxic] += 1
    rows = list(count.items())
    for k in range(0, len(rows), 20_000):
        part = rows[k : k + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1][0] for r in part], pa.int64()), pa.array([r[1][1] for r in part], pa.int64())], names=["form", "toxic", "other"])


def _featured(lexicon: dict[str, float]) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lexicon)
        for batch in batches:
            x = [features(t, codes) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    return f


def _scored(model: Model) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model.lexicon)
        for batch in batches:
            x = np.array([features(t, codes) for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=SCORE)

    return f


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most sample_rows labelled rows that are not held out."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("label_id", F.lit(3)), "label_id").limit(sample_rows))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(chosen, F.col("id") == chosen["label_id"]).groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("text", "toxic", (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(5)) == 0).alias("fold")), "labelled")
    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return Model({}, None, np.full(n or 0, float(bool(toxic))), None)
    # The lexicon is counted on the rows that the trees are grown on; those kept back for calibration aren't seen.
    seen = rows.filter("NOT fold")
    n, toxic = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # Both labels in proportion: how much likelier a form is in a toxic text.
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (n - toxic + 1))
    counted = arrow_map(seen.select("text", "toxic"), _forms, "form string, toxic bigint, other bigint").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # Less one standard error, so that forms met a few times by chance stay out.
    sure = odds - F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    least = max(3, round(toxic * 0.004))
    lexicon = {r[0]: r[1] for r in counted.filter(F.col("toxic") >= least).select("form", sure.alias("sure")).filter("sure > 2").orderBy(F.desc("sure"), "form").limit(LEXICON).collect()}
    got = arrow_map(rows, _featured(lexicon), "toxic int, fold boolean, x array<double>").toPandas()
    return Model(lexicon, np.array(got["x"].tolist()), got["toxic"].to_numpy(float), got["fold"].to_numpy(bool))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return arrow_map(rows, _scored(model), "doc_id bigint, held_out boolean, score double, predicted int")

