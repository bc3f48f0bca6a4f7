"""A line model that tells running sentences from lists, tables, code, logs and junk.

The model is a logistic regression over the words and the shape of a line, fitted on the lines of
a bounded sample of labelled documents, around prior weights that express what holds for any text:
markers of lists and tables, operators and digits speak against sentences; several words in a row,
frequent words of a language and final punctuation speak for them.  With few or no labels the prior
decides alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]|_")
_QUOTE = re.compile(r"(?:(?:>|//+!?)\s?)+")
_BULLET = re.compile(r"(?:[-*+•–—‣◦]|\(?\d{1,4}(?:\.\d+)*[.)]|\(?[a-zA-Z][.)]|\[[ xX]\])\s+")
_HEADING = re.compile(r"#{1,6}\s|={2,}\s|\*\*|@@|[|{}<\[+]")
_INNER_CASE = re.compile(r"[^\W\d_][a-z]+[A-Z]|[A-Z]{2,}[a-z]")
_END = re.compile(r"[.!?…;:][\"'”’»)\]]*\s*$")

#: What the prior says of a line's shape (weights on the logit scale).
PRIOR = {
    "bias": -0.5, "words:3": -0.5, "words:5": 0.3, "words:9": 1.0, "words:16": 1.5,
    "common:0": -1.5, "common:1": 0.2, "common:2": 1.0, "common:3": 1.3, "symbols:1": -0.5, "symbols:2": -2.0, "symbols:3": -3.5,
    "ends": 0.5, "digits": -1.0, "wide": -1.0, "comma list": -2.0, "repeats": -2.0,
}


def lines_of(text: str) -> list[str]:
    return [s for s in map(str.strip, text.splitlines()) if s]


#: Counts of tokens, packed into one integer that still fits a machine word for PACKED tokens.
WORD, FREQUENT, SYMBOL, NUMBER = 1, 1 << 15, 1 << 30, 1 << 45
PACKED = (1 << 15) - 1


class _Lazy(dict):
    """Values worked out at a key's first sight; ``bound`` keeps a worker's table from growing with
    the corpus."""

    bound = 200_000

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token):
        if len(self) > self.bound:
            self.clear()
        self[token] = value = self.make(token)
        return value


class TokenTable:
    """What a raw token counts for: its packed counts, its weight and its name."""

    def __init__(self, common, weights=None):
        self.common, weights = common, weights or {}
        self.frequent: set[str] = set()  # the spellings of frequent words seen so far
        self.counts = _Lazy(self._count)
        self.weights = _Lazy(lambda token: weights.get("w:" + token_name(token), 0.0))
        self.names = _Lazy(token_name)

    def _count(self, token: str) -> int:
        if token[0].isalpha():
            if token.lower() not in self.common:
                return WORD
            self.frequent.add(token)
            return WORD + FREQUENT
        return NUMBER if token[0].isdigit() else SYMBOL * (token not in ",.'’\"-")

    def count(self, tokens: list[str]) -> tuple[int, int, int, int]:
        """(words, frequent words, symbols, numbers)."""
        if len(tokens) <= PACKED:
            c = sum(map(self.counts.__getitem__, tokens))
            return c & PACKED, c >> 15 & PACKED, c >> 30 & PACKED, c >> 45
        total = [0, 0, 0, 0]
        for k in range(0, len(tokens), PACKED):
            c = sum(map(self.counts.__getitem__, tokens[k : k + PACKED]))
            total[0] += c & PACKED
            total[1] += c >> 15 & PACKED
            total[2] += c >> 30 & PACKED
            total[3] += c >> 45
        return tuple(total)


def token_name(token: str) -> str:
    """The token as the model knows it: words in lower case, identifiers and numbers each as one."""
    if token[0].isalpha():
        return "§id" if _INNER_CASE.search(token) else token.lower()
    return "§9" if token[0].isdigit() else token


def read_line(line: str) -> tuple[list[str], str]:
    """Tokens of a line without quotation marks, and the body they were read from."""
    quoted = _QUOTE.match(line)
    body = line[quoted.end() :] if quoted else line
    return TOKEN.findall(body), body


#: Names of the features of a line's words, frequent words and symbols, by their classes.
CLASSES = (("words:3", "words:5", "words:9", "words:16"), ("common:0", "common:1", "common:2", "common:3"), ("symbols:0", "symbols:1", "symbols:2", "symbols:3"))


def shape_class(counts, n: int) -> int:
    """The classes of a line's words, share of frequent words and share of symbols, as one number."""
    words, frequent, symbols, _ = counts
    share, marks = frequent / max(1, words), symbols / n
    return (
        (0 if words < 5 else 1 if words < 9 else 2 if words < 16 else 3) * 16
        + (0 if share < 0.05 else 1 if share < 0.2 else 2 if share < 0.4 else 3) * 4
        + (0 if marks < 0.05 else 1 if marks < 0.15 else 2 if marks < 0.35 else 3)
    )


def class_features(k: int) -> list[str]:
    return ["bias", CLASSES[0][k // 16], CLASSES[1][k // 4 % 4], CLASSES[2][k % 4]]


def other_features(tokens: list[str], counts, body: str, table: TokenTable) -> list[str]:
    """Names of the features of a line's shape that are there or not."""
    words, _, _, numbers = counts
    n, out = max(1, len(tokens)), []
    if _END.search(body[-8:]):
        out.append("ends")
    if numbers > 0.3 * n:
        out.append("digits")
    if len(body) > 12 * n:
        out.append("wide")
    if body.count(",") > 0.3 * max(1, words):
        out.append("comma list")
    if n >= 12 and len(set(map(table.names.__getitem__, set(tokens)))) < 0.25 * n:
        out.append("repeats")
    return out


def is_no_sentence(counts, body: str) -> bool:
    """Lines that are none whatever they say: list items, headings, fragments of one or two words."""
    return counts[0] < 3 or _BULLET.match(body) is not None or _HEADING.match(body) is not None


class LineModel:
    """Logistic regression: the sum of the token weights over the square root of their number, plus
    the weights of the line's shape."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = dict(PRIOR) if weights is None else weights
        self.classes = [sum(self.weights.get(f, 0.0) for f in class_features(k)) for k in range(64)]

    def table(self, common) -> TokenTable:
        return TokenTable(common, self.weights)

    def is_sentence(self, tokens: list[str], counts, body: str, table: TokenTable) -> bool:
        if is_no_sentence(counts, body):
            return False
        shape = self.classes[shape_class(counts, len(tokens))]
        for f in other_features(tokens, counts, body, table):
            shape += self.weights.get(f, 0.0)
        return shape + sum(map(table.weights.__getitem__, tokens)) / len(tokens) ** 0.5 > 0


def text_statistics(text: str, model: LineModel, table: TokenTable) -> tuple:
    """(words, mean word length, symbol share, punctuated lines' share, frequent words' share,
    sentence share, frequent words) of a text that isn't blank.  Words are runs without white space; symbols are
    characters that are no letter, digit or white space, as a share of those other than white
    space; the last two are shares of the letters' words and of characters other than white space."""
    pieces = text.split()
    solid = sum(map(len, pieces))
    lines = lines_of(text)
    ends = good = letters = frequent = symbols = 0
    seen: set[str] = set()
    for line in lines:
        tokens, body = read_line(line)
        counts = table.count(tokens)
        seen.update(tokens)
        letters += counts[0]
        frequent += counts[1]
        symbols += len(tokens) - counts[0] - counts[3]
        if line[-1] in ".!?:;…":
            ends += 1
        if model.is_sentence(tokens, counts, body, table):
            good += len(line) - line.count(" ") if line.isprintable() else sum(map(len, line.split()))
    symbols += sum(len(x) - len(y) for x, y in ((line, _QUOTE.sub("", line, count=1)) for line in lines if line[0] == ">"))
    return len(pieces), solid / len(pieces), symbols / solid, ends / len(lines), frequent / max(1, letters), min(1.0, good / solid), {token.lower() for token in seen & table.frequent}


def fit_lines(labelled: list[tuple[str, str]], common, rounds: int = 2, steps: int = 80, decay: float = 0.1) -> LineModel:
    """Fit on (text, label) pairs, label 'prose' or 'other'.  Lines take their document's label at
    first; the later round drops the lines of mixed documents that the first contradicts clearly.
    Each document counts alike, however many lines it has."""
    table = TokenTable(common)
    rows, tokens, labels, weights = [], [], [], []
    for text, label in labelled:
        lines = list(dict.fromkeys(lines_of(text or "")))
        for line in lines:
            read, body = read_line(line)
            line_counts = table.count(read)
            if is_no_sentence(line_counts, body):
                continue
            rows.append(class_features(shape_class(line_counts, max(1, len(read)))) + other_features(read, line_counts, body, table))
            tokens.append(["w:" + token_name(token) for token in read])
            labels.append(label == "prose")
            weights.append(1 / len(lines))
    if len({*labels}) < 2:
        return LineModel()
    counts = Counter(f for t in tokens for f in set(t))
    names = sorted({*PRIOR, *(f for f, n in counts.items() if n >= 2)})
    at = {f: k for k, f in enumerate(names)}
    flat, owner, value = [], [], []
    for k, (shape, words) in enumerate(zip(rows, tokens)):
        for f in shape:
            if f in at:
                flat.append(at[f])
                owner.append(k)
                value.append(1.0)
        for f, n in Counter(words).items():
            if f in at:
                flat.append(at[f])
                owner.append(k)
                value.append(n / len(words) ** 0.5)
    flat, owner, value = np.array(flat), np.array(owner), np.array(value)
    y, weight = np.array(labels, float), np.array(weights)
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    theta = prior.copy()
    for turn in range(rounds):
        use = weight.copy()
        if turn:
            z = np.bincount(owner, value * theta[flat], len(rows))
            use[(z > 0.5) & (y == 0) | (z < -0.5) & (y == 1)] = 0
        use /= max(use.sum(), 1e-9)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):  # Adam
            z = np.bincount(owner, value * theta[flat], len(rows))
            slope = use * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            g = np.bincount(flat, value * slope[owner], len(names)) + decay / len(labelled) * (theta - prior)
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return LineModel({f: float(w) for f, w in zip(names, theta) if abs(w) > 1e-4})
