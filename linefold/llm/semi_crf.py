"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, payment cards and telephone numbers; those spans always
stand. The field looks at candidate regions (numbers with separators, addresses with a spelt-out or spaced
`at` and `dot`) that the patterns left free. A region is a sequence of tokens (digit runs, words, single
signs); a segment of one token may be nothing, a segment of up to MAX_TOKENS may be one of the four kinds.
Features are of the whole segment (digits, groups, separators, check digit, what stands around), so a dynamic
programme over segment ends finds the boundaries and kinds that score best together, and a forward and a
backward pass give the gradient of their log likelihood.

Training needs no hand labels: spans that the patterns find in a bounded sample (FIT_ROWS texts) are
rewritten in forms they don't cover (no plus sign, other separators, spelt-out signs), put back into their
surroundings as positive examples, and set against look-alikes (dates, amounts, versions, keys, numbers that
fail the check digit). If the sample has too few spans, made-up ones take their place, so training works on
any table.

A span gives kind, start and end in code points, end exclusive. A null or empty text has none. Very long texts
take linear time: a region is bounded by MAX_REGION tokens, a longer one is cut into overlapping parts. Other
columns pass; columns of the names made here are replaced.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linefold.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone")
NONE = "none"
MAX_TOKENS, MAX_REGION = 24, 96
#: Characters of a run of numbers, and of what a pattern span leaves of a region.
MIN_PIECE = 7
#: Texts brought to the driver for training, and examples made from them.
FIT_ROWS, EXAMPLES = 400, 900
EPOCHS, RATE, DECAY = 4, 0.3, 1e-3

COLUMNS = {
    "n_email": "long",
    "n_ip": "long",
    "n_card": "long",
    "n_phone": "long",
    "base_sha256": "string",
    "spans": "string",
}

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: what follows the run decides, wherever it starts.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S|\s")
_NUMBERS = re.compile(r"[+(\[]?[0-9](?:[0-9]|[ ().\-/\[\]]{1,3}(?=[0-9(\[]))*")
_SPELT = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:[@＠]|[(\[{] ?at ?[)\]}]| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|[(\[{] ?dot ?[)\]}]| dot ) ?[A-Za-z0-9-]{1,63})+",
    re.IGNORECASE,
)
#: What every match of _SPELT has.
_SPELT_HINT = re.compile(r"[@＠]|[(\[{] ?at ?[)\]}]| at ", re.IGNORECASE)
#: Words before a span that tell its kind.
CUES = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "address", "server", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "amex"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telephone"),
}
_CUE = {w: k for k, words in CUES.items() for w in words}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """What the patterns find, kind by kind; matches that fail a condition are dropped."""
    spans: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            spans.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


@dataclass
class Region:
    """Tokens of a candidate region with their places, and the words before it."""

    text: str
    bounds: list[tuple[int, int]]
    tokens: list[str] = field(init=False)

    def __post_init__(self):
        self.tokens = [self.text[a:b] for a, b in self.bounds]

    def cue(self) -> str:
        before = self.text[max(0, self.bounds[0][0] - 40) : self.bounds[0][0]].lower()
        return next((_CUE[w] for w in reversed(re.findall(r"[a-z]+", before)[-4:]) if w in _CUE), "-")


def regions(text: str, taken: list[Span]) -> list[Region]:
    """Candidate regions without the spans already taken; what is left on both sides of a span is kept."""
    found = [(m.start(), m.end()) for m in _NUMBERS.finditer(text) if m.end() - m.start() >= MIN_PIECE] if _DIGIT.search(text) else []
    if _SPELT_HINT.search(text):
        found += [(m.start(), m.end()) for m in _SPELT.finditer(text)]
    blocked = sorted((a, b) for _, a, b in taken)
    out, end, k = [], 0, 0
    for a, b in sorted(found):
        pieces, a, cut = [], max(a, end), False
        while k < len(blocked) and blocked[k][1] <= a:
            k += 1
        at = k
        while a < b and at < len(blocked) and blocked[at][0] < b:
            pieces.append((a, blocked[at][0]))
            a, at, cut = max(a, blocked[at][1]), at + 1, True
        pieces.append((a, b))
        for start, stop in pieces:
            if stop - start < (MIN_PIECE if cut else 1):
                continue
            end = stop
            bounds = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, stop)]
            for i in range(0, len(bounds), MAX_REGION - MAX_TOKENS):
                out.append(Region(text, bounds[i : i + MAX_REGION]))
                if i + MAX_REGION >= len(bounds):
                    break
    return out


def _edge(token: str, first: bool) -> bool:
    return token[0].isalnum() or (first and token in "+([")


def segment_features(region: Region, i: int, j: int, kind: str, cue: str) -> list[str]:
    """Features of tokens i to j - 1 taken together as one span of a kind."""
    if kind == NONE:
        t = region.tokens[i]
        return [f"none|{'d' if t[0].isdigit() else 'a' if t[0].isalpha() else 's'}"]
    tokens = region.tokens[i:j]
    a, b = region.bounds[i][0], region.bounds[j - 1][1]
    groups = [t for t in tokens if t[0].isdigit()]
    words = [t.lower() for t in tokens if t[0].isalpha()]
    digits = "".join(groups)
    signs = "".join(sorted({t for t in tokens if not t[0].isalnum()}))
    shape = "-".join(str(min(len(g), 9)) for g in groups[:6])
    left = region.text[a - 1 : a] if a else ""
    right = region.text[b : b + 1]
    out = [
        "bias",
        f"digits={min(len(digits), 24)}",
        f"groups={min(len(groups), 6)}",
        f"shape={shape if not words else 'w'}",
        f"signs={signs}",
        f"words={min(len(words), 4)}",
        f"first={tokens[0] if not tokens[0][0].isalnum() else 'x'}",
        f"touch={int(left.isalnum())}{int(right.isalnum())}",
        f"cut={int(i > 0 and region.tokens[i - 1][0].isalnum())}{int(j < len(region.tokens) and region.tokens[j][0].isalnum())}",
        f"rest={int(any(t[0].isdigit() for t in region.tokens[:i]))}{int(any(t[0].isdigit() for t in region.tokens[j:]))}",
        f"cue={int(cue == kind)}{int(cue != '-')}",
    ]
    if len(digits) >= 16 and not words:
        out.append(f"luhn={int(luhn(digits))}")
    if len(groups) == 4 and not words:
        out.append(f"octets={int(all(len(g) <= 3 and int(g) <= 255 for g in groups))}")
    if words:
        out.append(f"at={int('at' in words[1:] or '@' in signs or '＠' in signs)}")
        out.append(f"dot={int('dot' in words[2:])}{int('.' in signs)}")
        out.append(f"last={min(len(words[-1]), 7)}")
        # A full stop before a blank ends a sentence.
        out.append(f"stop={int(any(t == '.' and n.isspace() for t, n in zip(tokens, tokens[1:])))}{int('at' in words[1:])}")
    if "(" in signs or ")" in signs:
        out.append(f"paren={int(signs.count('(') == signs.count(')'))}{int('[' in signs)}")
    return [f"{kind}|{f}" for f in out]


class Field:
    """Weights by feature; decoding and likelihood over segmentations of a region."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights: dict[str, float] = weights or {}

    def segments(self, region: Region) -> list[list[tuple[int, str, list[str], float]]]:
        """For every end: start, kind, features and score of the segments that end there."""
        n, cue, get = len(region.tokens), region.cue(), self.weights.get
        out: list[list] = [[] for _ in range(n + 1)]
        starts = [k for k, t in enumerate(region.tokens) if _edge(t, True)]
        for j in range(1, n + 1):
            f = segment_features(region, j - 1, j, NONE, cue)
            out[j].append((j - 1, NONE, f, sum(get(x, 0.0) for x in f)))
            if not _edge(region.tokens[j - 1], False):
                continue
            for i in starts:
                if i >= j:
                    break
                if j - i <= MAX_TOKENS:
                    for kind in KINDS:
                        f = segment_features(region, i, j, kind, cue)
                        out[j].append((i, kind, f, sum(get(x, 0.0) for x in f)))
        return out

    def decode(self, region: Region) -> list[Span]:
        """Boundaries and kinds of the best segmentation."""
        by_end = self.segments(region)
        n = len(region.tokens)
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            for i, kind, _, s in by_end[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        spans, j = [], n
        while j:
            i, kind = back[j]
            if kind != NONE:
                spans.append((kind, region.bounds[i][0], region.bounds[j - 1][1]))
            j = i
        return spans[::-1]

    def gradient(self, region: Region, gold: list[Span]) -> dict[str, float]:
        """Of the log likelihood: features of the labelled segmentation less their expectation."""
        by_end, n = self.segments(region), len(region.tokens)
        forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            forward[j] = _log_sum([forward[i] + s for i, _, _, s in by_end[j]])
        for j in range(n, 0, -1):
            for i, _, _, s in by_end[j]:
                backward[i] = _log_sum([backward[i], s + backward[j]])
        out: dict[str, float] = defaultdict(float)
        for j in range(1, n + 1):
            for i, _, f, s in by_end[j]:
                p = math.exp(forward[i] + s + backward[j] - forward[n])
                if p > 1e-6:
                    for x in f:
                        out[x] -= p
        want, cue = {(a, b): k for k, a, b in gold}, region.cue()
        starts = {a: i for i, (a, _) in enumerate(region.bounds)}
        ends = {b: i + 1 for i, (_, b) in enumerate(region.bounds)}
        covered = set()
        for (a, b), kind in want.items():
            if a in starts and b in ends:
                covered.update(range(starts[a], ends[b]))
                for x in segment_features(region, starts[a], ends[b], kind, cue):
                    out[x] += 1
        for i in range(n):
            if i not in covered:
                for x in segment_features(region, i, i + 1, NONE, cue):
                    out[x] += 1
        return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _rewritten(kind: str, body: str, draw: random.Random) -> str:
    """A form of a span that the patterns don't cover."""
    digits = _digits(body)
    if kind == "email":
        at = draw.choice([" at ", "(at)", " (at) ", "[at]", " [at] ", " @ "])
        dot = "." if "@" not in at and draw.random() < 0.3 else draw.choice([" dot ", "(dot)", "[dot]", " [dot] "])
        local, _, domain = body.partition("@")
        return f"{local}{at}{domain.replace('.', dot)}"
    if kind == "ip":
        return draw.choice(["[.]", "(.)", " . "]).join(body.split("."))
    if kind == "card":
        digits = (digits * 2)[:15]
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        return draw.choice([".", "/", " - "]).join(digits[k : k + 4] for k in range(0, 16, 4))
    local = (digits * 2)[-10:]
    a, b, c = local[:3], local[3:6], local[6:]
    return draw.choice(
        [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"00{digits[:1] or 1} {a} {b} {c}"]
    )


def _look_alike(draw: random.Random) -> str:
    """Numbers and words near the four kinds that are none of them."""
    r = draw.randint
    wrong = "".join(str(r(0, 9)) for _ in range(15))
    wrong += next(str(d) for d in range(10) if not luhn(wrong + str(d)))
    return draw.choice(
        [
            f"{r(1900, 2099)}-{r(10, 12)}-{r(10, 28)}", f"{r(10, 28)}.{r(10, 12)}.{r(1900, 2099)}", f"{r(10, 28)}/{r(10, 12)}/{r(1900, 2099)}",
            f"{r(1, 999)}.{r(100, 999)}.{r(100, 999)}", f"{r(1900, 2020)}-{r(1900, 2020)}", f"{r(1, 9)}.{r(0, 20)}.{r(0, 99)}-{r(1, 9)}",
            f"{r(10**6, 10**8)}", f"{r(10**10, 10**14)}", wrong, "-".join(wrong[k : k + 4] for k in range(0, 16, 4)),
            f"{r(300, 999)}.{r(300, 999)}.{r(1, 99)}.{r(1, 99)}", f"{r(100, 999)} {r(100, 999)} {r(100, 999)} {r(100, 999)} {r(100, 999)}",
            f"{r(10000, 99999)}-{r(1000, 9999)}", f"look at the dot product", f"at dot {r(10, 99)}", f"{r(1, 99)} - {r(100, 999)} - {r(1, 99)}",
            f"{draw.choice(['look', 'stay', 'Is', 'met', 'arrive', 'for'])} at {draw.choice(['home', 'noon', 'and', 'school', 'once'])}. {draw.choice(['The', 'Then', 'We', 'See'])}",
            f"978-{r(0, 9)}-{r(100, 999)}-{r(10000, 99999)}-{r(0, 9)}", f"{r(1, 9)} ({r(1900, 2020)}) {r(10, 99)}-{r(100, 999)}",
        ]
    )


def _made_up(kind: str, draw: random.Random) -> str:
    r = draw.randint
    return {
        "email": f"{''.join(draw.choices('abcdefghinorst', k=r(3, 9)))}.{r(1, 99)}@mail{r(0, 9)}.example.com",
        "ip": ".".join(str(r(1, 255)) for _ in range(4)),
        "card": str(r(4 * 10**15, 6 * 10**15)),
        "phone": f"+{r(1, 99)} ({r(200, 999)}) {r(200, 999)}-{r(1000, 9999)}",
    }[kind]


def fit(texts: list[str]) -> Field:
    """A field trained on spans of the texts in other forms, and on look-alikes."""
    draw, found = random.Random(17), defaultdict(list)
    around = []
    for text in sorted(texts):
        for kind, a, b in base_spans(text):
            found[kind].append(text[a:b])
            around.append((text[max(0, a - 60) : a], text[b : b + 40]))
    around = around or [("we saw ", " there. "), ("", "")]
    examples = []
    for k in range(EXAMPLES):
        left, right = draw.choice(around)
        if k % 2:
            kind = KINDS[k // 2 % 4]
            if draw.random() < 0.3:
                left += draw.choice(CUES[kind]) + draw.choice([": ", " "])
            pool = found[kind] if len(found[kind]) >= 20 else [_made_up(kind, draw)]
            body = _rewritten(kind, draw.choice(pool), draw)
        else:
            kind, body = None, _look_alike(draw)
        text = left + body + right
        gold = [(kind, len(left), len(left) + len(body))] if kind else []
        inside = [r for r in regions(text, [s for s in base_spans(text) if s[1] < len(left) or s[2] > len(left) + len(body)])]
        for region in inside:
            own = [g for g in gold if region.bounds[0][0] <= g[1] and g[2] <= region.bounds[-1][1]]
            overlaps = any(region.bounds[0][0] < g[2] and g[1] < region.bounds[-1][1] for g in gold)
            if own or not overlaps:
                examples.append((region, own))
    model, sums, steps = Field(), defaultdict(float), 0
    for epoch in range(EPOCHS):
        draw.shuffle(examples)
        rate = RATE / (1 + epoch)
        for region, gold in examples:
            for x, g in model.gradient(region, gold).items():
                w = model.weights.get(x, 0.0)
                model.weights[x] = w + rate * (g - DECAY * w)
        steps += 1
        for x, w in model.weights.items():
            sums[x] += w
    return Field({x: s / steps for x, s in sums.items()})


def find(text: str | None, model: Field) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and those that the field adds."""
    text = text or ""
    base = base_spans(text)
    added: list[Span] = []
    for region in regions(text, base):
        for span in model.decode(region):
            if all(span[1] >= b or span[2] <= a for _, a, b in added):
                added.append(span)
    return base, added


def told(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def train(docs: DataFrame, text: str = "text") -> Field:
    """A field from FIT_ROWS texts in which a digit or an @ stands, drawn by a hash of the text."""
    rows = docs.select(F.col(text).cast("string").alias("body")).where(F.col("body").rlike("@|[0-9]{7}"))
    n = rows.count()
    if not n:
        return fit([])
    order = F.xxhash64("body", F.lit(1))
    # About twice the wanted rows pass; equal texts are taken once.
    near = rows.where(F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 2 * FIT_ROWS / n) * (1 << 30)))
    picked = near.groupBy(order.alias("order")).agg(F.first("body").alias("body")).orderBy("order").limit(FIT_ROWS)
    return fit([r.body for r in picked.select("body").collect()])


def mark(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """docs with the columns above. The model goes out once per executor; its size is bounded by its features."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def make():
        field_ = Field(shared.value)

        def compute(texts: list[str | None]) -> list[list]:
            columns: list[list] = [[] for _ in COLUMNS]
            for body in texts:
                base, added = find(body, field_)
                for k, kind in enumerate(KINDS):
                    columns[k].append(sum(s[0] == kind for s in base))
                columns[4].append(hashlib.sha256(told(base).encode()).hexdigest())
                columns[5].append(told(base + added))
            return columns

        return compute

    return add_columns(docs, text, COLUMNS, make)


def redact(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """docs whose texts have `<kind>` in place of every span; overlapping spans become one, named by the first."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def make():
        field_ = Field(shared.value)

        def clean(body: str | None) -> str | None:
            base, added = find(body, field_)
            if not base and not added:
                return body
            out, end = [], 0
            for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                if a >= end:
                    out += [body[end:a], f"<{kind}>"]
                end = max(end, b)
            return "".join([*out, body[end:]])

        return lambda texts: [[clean(t) for t in texts]]

    made = "redacted"
    while made in docs.columns:
        made += "_"
    names = docs.columns
    marked = add_columns(docs, text, {made: "string"}, make)
    return marked.withColumn(text, F.col(made)).select(*[F.col(f"`{n}`") for n in names])
