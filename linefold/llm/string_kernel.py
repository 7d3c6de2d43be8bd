"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums, over all subsequences of ORDER letters that both hold within a span of SPAN,
the decay to the power of both spans; so gaps and inserted letters cost a factor, not the match. Strings are
windows of WINDOW letters of a text's letter stream: lower case, accents, full-width and other compatible forms,
and common look-alike signs and letters folded, everything but letters left out, so that `i.d-i o t` is `idiot`.
Letters of other scripts are dealt over the same LETTERS symbols by their code point: words in them are strings
like others, learned from the labelled texts in which they stand.

Training, on a bounded sample of labelled texts (FIT_ROWS of each label): a toxic text has some toxic
window, not every one. Rounds pick each toxic text's most toxic windows, as far as they
stand out from those of clean texts, and the most toxic windows of the clean ones, choose LANDMARKS of them, map windows to kernel values with the landmarks times the inverse root
of the landmarks' own kernel matrix, and fit a linear support vector machine there. The machine is linear in
the kernel, so it folds into one weight per subsequence of the landmarks; scoring a text is then a lookup
per letter and gap pattern and a sliding sum, in time linear in its length. A text's margin is that of its
most toxic window; a logistic curve fitted to margins gives the score.

Any text gets a score, equal texts get equal ones; one that is null, empty or without enough letters gets the score of a text without
features. With labels of one kind only all scores are close to 0 or to 1, with none to 0. Rows with
a null label teach nothing. An empty table gives no rows. Other columns pass; columns of the names made here are replaced.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linefold.llm.common import add_columns

ORDER, SPAN, DECAY, WINDOW = 4, 6, 0.6, 9
LETTERS = 27  # 26 and none
#: Texts of each label brought to the driver, and windows that serve as landmarks.
FIT_ROWS, LANDMARKS = 1_500, 384
#: Rounds, and windows taken from each toxic and each clean text.
ROUNDS, GUILTY, HARD = 4, 5, 2
THRESHOLD = 0.3
COLUMNS = {"score": "double", "predicted": "int"}

#: Signs written for letters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: Places of the letters of a subsequence that starts at 0, and its weight.
PATTERNS = [
    ((0, *rest), DECAY ** (rest[-1] + 1)) for rest in itertools.combinations(range(1, SPAN), ORDER - 1)
]
CODES = LETTERS**ORDER


#: Letters of other scripts that look like a Latin one.
LOOK_ALIKE_LETTERS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ν": "v",
}


@functools.lru_cache(maxsize=1 << 16)
def _fold(c: int) -> int:
    """Letter number of a character; 0 for what is left out."""
    sign = LOOK_ALIKES.get(chr(c)) or unicodedata.normalize("NFKD", chr(c).lower())[:1].lower()
    letter = LOOK_ALIKE_LETTERS.get(sign, sign)
    if "a" <= letter <= "z":
        return ord(letter) - 96
    # An odd factor keeps neighbours in an alphabet apart.
    return 1 + (ord(letter) * 0x9E3779B1 >> 8) % (LETTERS - 1) if letter.isalpha() else 0


FOLDS = np.array([_fold(c) for c in range(0x250)], dtype=np.uint8)


def letters(text: str | None) -> np.ndarray:
    # Lone surrogates can't be encoded otherwise; they are no letters.
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = FOLDS[np.minimum(codes, len(FOLDS) - 1)]
    other = codes >= len(FOLDS)
    if other.any():
        signs, place = np.unique(codes[other], return_inverse=True)
        out[other] = np.array([_fold(int(c)) for c in signs], dtype=np.uint8)[place]
    return out[out > 0].astype(np.int32)


def codes(stream: np.ndarray) -> list[tuple[np.ndarray, int, float]]:
    """For each pattern: the subsequence at every place, its span less one, its weight."""
    found = []
    for places, weight in PATTERNS:
        n = len(stream) - places[-1]
        if n > 0:
            code = stream[places[0] : places[0] + n]
            for p in places[1:]:
                code = code * LETTERS + stream[p : p + n]
            found.append((code, places[-1], weight))
    return found


def features(window: np.ndarray) -> dict[int, float]:
    """Weights of the subsequences of a short string, scaled to length one."""
    out: dict[int, float] = {}
    for code, _, weight in codes(window):
        for c in code.tolist():
            out[c] = out.get(c, 0.0) + weight
    norm = sum(v * v for v in out.values()) ** 0.5
    return {c: v / norm for c, v in out.items()} if norm else out


def window_sums(stream: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weights over each window of the stream; one window if it is shorter."""
    size = max(1, len(stream) - WINDOW + 1)
    out = np.zeros(size)
    width = min(WINDOW, len(stream))
    for code, reach, weight in codes(stream):
        sums = np.concatenate([[0.0], np.cumsum(weights[code] * weight, dtype=np.float64)])
        inside = max(width - reach, 0)
        if inside:
            out += sums[inside : inside + size] - sums[:size]
    return out


@dataclass
class Model:
    weights: np.ndarray  # one per subsequence
    slope: float = 0.0
    offset: float = 0.0

    def margin(self, text: str | None) -> float:
        stream = letters(text)
        return float(window_sums(stream, self.weights).max()) if len(stream) else 0.0

    def score(self, texts: list[str | None]) -> list[list]:
        margins = np.array([self.margin(t) for t in texts])
        scores = 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))
        return [scores, (scores >= THRESHOLD).astype(np.int32)]


def _log_odds(toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
    """First weights: how much more often toxic texts hold a subsequence, where that is beyond chance."""
    def held(streams: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(CODES)
        for s in streams:
            if len(s):
                out[np.unique(np.concatenate([c for c, _, _ in codes(s)] or [np.empty(0, np.int32)]))] += 1
        return out

    a, b = held(toxic), held(clean)
    p, q = (a + 0.5) / (len(toxic) + 1), (b + 0.5) / (len(clean) + 1)
    spread = np.sqrt(p * (1 - p) / len(toxic) + q * (1 - q) / len(clean))
    return np.where((p - q) / spread > 3.5, np.log(p / q), 0.0)


def _best(stream: np.ndarray, weights: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
    """The n windows of greatest sum, apart from each other."""
    sums, out = window_sums(stream, weights), []
    for _ in range(n):
        at = int(np.argmax(sums))
        if not np.isfinite(sums[at]):
            break
        out.append((float(sums[at]), stream[at : at + WINDOW]))
        sums[max(0, at - WINDOW + 1) : at + WINDOW] = -np.inf
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate ascent; the bias is a constant feature."""
    x = np.hstack([x, np.ones((len(x), 1))])
    alpha, w, square = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(axis=1)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            step = np.clip(alpha[i] + (1 - y[i] * (x[i] @ w)) / square[i], 0, cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w[:-1], float(w[-1])


def fit(toxic: list[str], clean: list[str]) -> Model:
    """A model from texts of both kinds."""
    bad, good = [letters(t) for t in toxic], [letters(t) for t in clean]
    bad, good = [s for s in bad if len(s) >= ORDER], [s for s in good if len(s) >= ORDER]
    if not bad or not good:
        return Model(np.zeros(CODES, dtype=np.float32))
    weights, draw = _log_odds(bad, good), np.random.default_rng(3)
    for _ in range(ROUNDS):
        tops = [_best(s, weights, GUILTY) for s in bad]
        usual = [_best(s, weights, HARD) for s in good]
        # Windows that clean texts have as well teach nothing this round: most of a toxic text isn't toxic.
        least = float(np.quantile([top[0][0] for top in usual], 0.8))
        positive = [w for top in tops for v, w in top if v > least]
        if not positive:
            break
        negative = [w for top in usual for _, w in top]
        for s in good:
            at = int(draw.integers(0, max(1, len(s) - WINDOW + 1)))
            negative.append(s[at : at + WINDOW])
        strings = [features(w) for w in positive + negative]
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        chosen = [
            *draw.choice(len(positive), min(len(positive), 3 * LANDMARKS // 4), replace=False),
            *(len(positive) + draw.choice(len(negative), min(len(negative), LANDMARKS // 4), replace=False)),
        ]
        # Kernel values: dense over the landmarks' subsequences only.
        support = sorted({c for i in chosen for c in strings[i]})
        column = {c: k for k, c in enumerate(support)}

        def dense(some: list[int]) -> np.ndarray:
            out = np.zeros((len(some), len(support)), dtype=np.float32)
            for r, i in enumerate(some):
                for c, v in strings[i].items():
                    if c in column:
                        out[r, column[c]] = v
            return out

        marks = dense(chosen)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-3 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        # A thousand windows at a time bound the memory.
        kernel = [dense(list(range(a, min(a + 1000, len(strings))))) @ marks.T for a in range(0, len(strings), 1000)]
        x = np.concatenate(kernel) @ root
        cost = np.where(y > 0, 2.0, 2.0 * len(positive) / len(negative))
        w, _ = _machine(x, y, cost)
        weights = np.zeros(CODES)
        # Windows all have about the same length; sums of plain weights stand for the scaled kernel.
        weights[support] = marks.T.astype(np.float64) @ (root @ w)
    model = Model(weights.astype(np.float32))
    margins = np.array([model.margin(t) for t in toxic + clean])
    labels = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    model.slope, model.offset = _logistic(margins, labels)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, slightly regularised."""
    a, b, scale = 0.0, 0.0, float(x.std()) or 1.0
    z = x / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, w = p - y, p * (1 - p)
        h = np.array([[w @ (z * z) + 1e-2, w @ z], [w @ z, w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([g @ z + 1e-2 * a, g.sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return a / scale, b


def train(labelled: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows; FIT_ROWS of each label are drawn by a hash of the text."""
    rows = labelled.select(F.col(text).cast("string").alias("body"), F.col(label).cast("int").alias("label"))
    rows = rows.where("label is not null and body is not null")
    counts = {r.label: r["count"] for r in rows.groupBy((F.col("label") == 1).alias("label")).count().collect()}
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not clean:
        share = 0.0 if not toxic else 1.0
        return Model(np.zeros(CODES, dtype=np.float32), 0.0, 500.0 if share else -500.0)
    drawn = []
    for kind, n in ((F.col("label") == 1, toxic), (F.col("label") != 1, clean)):
        part = F.pmod(F.xxhash64("body", F.lit(9)), F.lit(1 << 30)) < int(min(1.0, 1.5 * FIT_ROWS / n) * (1 << 30))
        one = rows.where(kind & part).groupBy(F.xxhash64("body").alias("order")).agg(F.first("body").alias("body"))
        drawn.append([r.body for r in one.orderBy("order").limit(FIT_ROWS).collect()])
    return fit(*drawn)


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted. The model goes out once per executor; its size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, text, COLUMNS, lambda: shared.value.score)
