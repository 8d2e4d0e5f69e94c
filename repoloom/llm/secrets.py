"""Secrets in texts: fixed patterns, and credential values that are dear to guess.

A value in a credential context is cut into words, dates, repeats, sequences, keyboard
walks and brute-force spans so that the guesses needed, multiplied over the parts, are
fewest (a shortest path over its characters).  Values that stay dear are secrets;
`password: changeme` is not.  Words are guessed in the order of a list: common passwords
first, then the words of the corpus itself by the number of documents that hold them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import common

# The base patterns and their kinds, in their order.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

# Credential contexts beyond the base patterns: a name that begins as a word, and what is set to it.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|passwd|pwd|secret|token|credentials?|auth|login"""
    r"""|(?:api|access|private|secret|signing|encryption)[ _-]?key)["']?\s{0,8}"""
    r"""(?::=|=>|[:=]|\bis\b)\s{0,8}["'`]?([^\s"'`,;<>(){}\[\]]+)""",
    re.IGNORECASE | re.ASCII,
)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "auth", "login", "key")
LEAST_VALUE = 6
#: Decimal logarithm of the guesses from which a value counts as secret.
LEAST_GUESSES = 8.0
#: A value that reads as a word, listed or not, takes this many at most: prose has any word.
WORD_GUESSES = 6.0
_WORD = re.compile(r"[^\W\d_]?(?:[^\W\d_A-Z]){2,23}").fullmatch
#: Words of the corpus that guessing knows at most, and the documents that must hold one.
CORPUS_WORDS = 50_000
LEAST_DOCUMENTS = 2
#: Tasks that send the driver their commonest words.
MERGED = 4

# Words that guessing starts with, commonest first.
COMMON_WORDS = (
    "password qwerty admin welcome login letmein monkey dragon master hello secret change me "
    "changeme test user root guest default example sample your my the token key value none null "
    "here pass word insert todo placeholder dummy foo bar baz abc love god baby summer winter "
    "spring autumn monday friday january december football baseball sunshine princess shadow "
    "superman batman michael jordan charlie daniel ashley jessica london america computer internet "
    "server database public private system access account temp demo local host service company"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("4@310$5!7", "aaeiossit")
_DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d"
)


def _neighbours() -> frozenset[tuple[str, str]]:
    """Keys that touch on a keyboard whose rows are each shifted by half a key."""
    at = {c: (x + y / 2, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
    return frozenset(
        (a, b)
        for a, (x, y) in at.items()
        for b, (u, v) in at.items()
        if a != b and abs(y - v) <= 1 and abs(x - u) <= 1
    )


_TOUCH = _neighbours()


def _runs(value: str, joins) -> Iterator[tuple[int, int]]:
    """Maximal stretches of three and more characters whose neighbours `joins` accepts."""
    start = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not joins(value[i - 1], value[i]):
            if i - start >= 3:
                yield start, i
            start = i


def _each_run(value: str) -> list[tuple[list[int], float]]:
    """For keyboard walks, sequences and repeats: where the run of each character starts (-1: in
    none), and the price of a part's first character."""
    kinds = (
        (lambda a, b: (a, b) in _TOUCH, math.log10(47 * 4)),
        (lambda a, b: abs(ord(a) - ord(b)) == 1, math.log10(26 * 2)),
        (lambda a, b: a == b, math.log10(64)),
    )
    found = []
    for joins, price in kinds:
        starts = [-1] * len(value)
        for lo, hi in _runs(value, joins):
            starts[lo:hi] = [lo] * (hi - lo)
        found.append((starts, price))
    return found


class Guesses:
    """The guesses that values take, given the words in the order of guessing.

    best[j] = min over parts [i, j) of best[i] + cost of the part.  Parts from words have
    their rank, doubled where letters are capital, and where they are replaced; dates 36,500 guesses;
    keyboard walks, sequences and repeats a start, and a tenth of a digit for each further character;
    a copy of the block before it the block's size; any character ten.  Any stretch of a walk,
    sequence or repeat may be a part: its first and its continued characters are priced apart, so one
    pass over the characters suffices.
    """

    def __init__(self, words: Sequence[str]) -> None:
        self.ranks: dict[str, float] = {}
        for k, word in enumerate(words):
            if len(word) >= 3:
                self.ranks.setdefault(word, math.log10(k + 2))
        self.longest = max(map(len, self.ranks), default=0)

    def cost(self, value: str) -> float:
        """Decimal logarithm of the fewest guesses over all segmentations."""
        n, low = len(value), value.lower()
        if len(low) != n:  # a letter whose small form is longer
            low = value
        plain = low.translate(_LEET)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for at in range(n):
            if match := _DATE.match(value, at):
                ends[match.end()].append((at, math.log10(36_500)))
        for size in range(2, min(n // 2, 16) + 1):
            for at in range(size, n - size + 1):
                if low[at - size : at] == low[at : at + size]:
                    ends[at + size].append((at, math.log10(2 + size)))
        runs = _each_run(low)
        best = [0.0] + [math.inf] * n
        going = [math.inf] * len(runs)
        for j in range(1, n + 1):
            cost = best[j - 1] + 1.0
            for k, (starts, price) in enumerate(runs):
                at = starts[j - 1]
                on = going[k] + 0.1 if 0 <= at < j - 1 else math.inf
                going[k] = min(best[j - 1] + price, on) if at >= 0 else math.inf
                cost = min(cost, going[k])
            for i, price in ends[j]:
                cost = min(cost, best[i] + price)
            for i in range(max(0, j - self.longest), j - 2):
                rank = self.ranks.get(low[i:j])
                if rank is None and (rank := self.ranks.get(plain[i:j])) is not None:
                    rank += math.log10(2)
                if rank is not None:
                    if value[i:j] != low[i:j]:
                        rank += math.log10(2)
                    cost = min(cost, best[i] + rank)
            best[j] = cost
        return best[n]


def guess_cost(value: str, words: Sequence[str] = COMMON_WORDS) -> float:
    return Guesses(words).cost(value)


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """COMMON_WORDS, then the words of all texts by the number of documents that hold them.

    A word is what stands between blanks, without the punctuation around it, if that is 3 to 24 letters;
    a stretch of letters inside a key is none.  At most `most` words held by LEAST_DOCUMENTS
    documents or more, ties by the word.
    """
    bare = F.regexp_extract("token", r"^[^\p{L}\p{N}]*(\p{L}{3,24})[^\p{L}\p{N}]*$", 1)
    held = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("token"))
    counted = (
        held.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(bare.alias("word"), "n")
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= LEAST_DOCUMENTS)
    )
    counted = common.stored(counted, "words")
    # How many words are about how common tells from which count on there are enough, so that
    # tasks don't each send the driver as many.
    size = F.floor(F.log2("n") * 8).alias("size")
    enough, least = 0, LEAST_DOCUMENTS
    for r in counted.groupBy(size).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("size")).collect():
        enough, least = enough + r.words, r.n
        if enough >= most:
            break
    common_ones = counted.filter(F.col("n") >= least).repartition(MERGED, "word")
    rows = common_ones.orderBy(F.desc("n"), "word").limit(most).collect()
    return [*COMMON_WORDS, *(r.word for r in rows)]


def find_spans(text: str, guesses: Guesses) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then in the order of KINDS."""
    low = text.lower()
    found, values = [], {}
    if any(x in low for x in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                found.append((*m.span(), "assign"))
                values[m.start(2)] = m.end(2)
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    if any(x in low for x in _CONTEXT_WORDS):
        for m in _CONTEXT.finditer(text):
            end = m.start(1) + len(m[1].rstrip(".!?"))
            values[m.start(1)] = max(end, values.get(m.start(1), 0))
    last = 0
    for start, end in sorted(values.items()):
        value = text[max(start, last) : end]
        if len(value) < LEAST_VALUE:
            continue
        cost = guesses.cost(value)
        if _WORD(value):
            cost = min(cost, WORD_GUESSES)
        if cost >= LEAST_GUESSES:
            found.append((end - len(value), end, "guess"))
            last = end
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """The text with each secret, or stretch of overlapping ones, replaced by `[kind]`."""
    pieces, at, last = [], 0, -1
    for start, end, kind in spans:
        if start >= last:
            pieces += [text[at:start], f"[{kind}]"]
        at = last = max(last, end)
    return "".join([*pieces, text[at:]])


_FOUND = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, redacted string"


def scan(docs: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
    """Adds counts by kind, base_sha256, spans and redacted to each row.

    In: text string and any columns; those named like the new ones are replaced.  spans
    lists kind:start:end in code points, end exclusive, by start, comma-joined, those of
    the base patterns among them; base_sha256 is the digest of the base ones.  A null text
    is empty and stays null in redacted.  Kinds may overlap each other: every credential value is
    scored, those of base spans included, and `guess` marks the value alone.  `words` is the
    order of guessing; without it, that of `corpus_words` of these rows.
    """
    order = corpus_words(docs) if words is None else list(words)
    new = [x.split()[0] for x in _FOUND.split(", ")]
    names = [c for c in docs.columns if c not in new]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = Guesses(order)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, lists, texts = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                spans = find_spans(text or "", guesses)
                named = [f"{kind}:{start}:{end}" for start, end, kind in spans]
                base = ",".join(x for x in named if not x.startswith("guess"))
                for own, kind in zip(counts, KINDS, strict=True):
                    own.append(sum(x[2] == kind for x in spans))
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                lists.append(",".join(named))
                texts.append(redact(text, spans) if text is not None else None)
            made = [*(pa.array(x, pa.int64()) for x in counts)]
            made += [pa.array(x, pa.string()) for x in (digests, lists, texts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *made], [*names, *new]
            )

    rows = docs.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(find, f"{kinds}, {_FOUND}")
