"""Secret scan: fixed patterns, and probabilistic automata learned from what they find.

The patterns give the base spans and, with them, labelled credentials. For each kind a prefix tree is built over
the character classes of at most ``labelled`` distinct credentials, and its states are merged where their
statistics are compatible (red-blue order, Hoeffding bound), which leaves a small probabilistic automaton. Every
other token of every text that is written in the labelled credentials' alphabet and as long as the shortest of them
is scored by all automata with its mean log-probability a symbol, and becomes a span if it is as likely as the
labelled ones are and far likelier than by the classes that follow one another in all texts: words, numbers, names and
dates are what these foresee, credentials are not.

One pass over the texts extracts the spans and counts the pairs of classes, a second one scores the tokens. The labelled
sample, bounded by the parameter ``labelled``, and a row per pair of classes are all that reaches the driver.

Defined results: null and empty texts have no spans; repeated rows are scanned each; positions count code
points; a kind without labelled credentials gets no automaton; an empty table gives an empty table; other
columns pass through ``redact`` untouched whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist, median

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Kind, pattern, group that holds the credential, least length; and what a text must hold for the pattern to be tried.
KINDS = ("assign", "access", "hex")
PATTERNS = (
    (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6, ("passw", "secret", "token", "api")),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20, ("akia",)),
    (re.compile(r"[0-9a-f]{24,}"), 0, 24, ()),
)
#: What tokens are written in, by class.
SIGNS = "+/_.=-"
ALPHABET = {"0": "0-9", "a": "a-f", "z": "g-z", "A": "A-F", "Z": "G-Z"} | {c: re.escape(c) for c in SIGNS}
#: Tokens of this length are scored even if every labelled credential is longer.
LONG = 12
#: Bits below which the spread of labelled credentials is not taken at its word.
LEAST_SPREAD = 0.1
LEARNED = tuple(f"like_{k}" for k in KINDS)
FOUND = "array<struct<kind:int,start:int,stop:int,value:string>>"


@dataclass(frozen=True)
class Grammar:
    #: Distinct labelled credentials a kind that the automaton is fitted on (the smallest hashes).
    labelled: int = 300
    #: Confidence of the merge test: smaller merges more.
    alpha: float = 0.01
    #: Share of credentials that may score below the threshold.
    miss: float = 0.02
    #: Bits a symbol by which the automaton must beat the pairs of classes of all texts.
    gain: float = 0.6


def classes(value: str) -> str:
    """One symbol per character: digits 0, hex letters a and A, others z and Z, signs themselves."""
    return "".join("0" if c.isdigit() else ("a" if c in "abcdef" else "z") if c.islower() else ("A" if c in "ABCDEF" else "Z") if c.isupper() else c for c in value)


#: Class number of every byte of UTF-8; 0 is what stands between tokens.
SYMBOLS = " " + "".join(ALPHABET)
_NUMBER = np.array([SYMBOLS.index(classes(chr(i))) if i < 128 and (chr(i).isalnum() or chr(i) in SIGNS) else 0 for i in range(256)], np.int64)
_PIECE = 1 << 20


def pair_counts(text: str) -> np.ndarray:
    """How often each class follows each other in a text, its ends counted as gaps; by number."""
    n, total = len(SYMBOLS), np.zeros(len(SYMBOLS) ** 2, np.int64)
    codes = text.encode("utf-8", "replace") + b" "
    last = 0
    for at in range(0, len(codes), _PIECE):
        some = _NUMBER[np.frombuffer(codes[at : at + _PIECE], np.uint8)]
        total += np.bincount(np.concatenate(([last], some[:-1])) * n + some, minlength=n * n)
        last = some[-1]
    total[0] = 0
    return total


def follow_bits(counts: dict[str, int]) -> dict[str, float]:
    """log2 of the probability of a pair's second class after its first."""
    after = {a: sum(counts.get(a + b, 0) + 1 for b in SYMBOLS) for a in SYMBOLS}
    return {a + b: math.log2((counts.get(a + b, 0) + 1) / after[a]) for a in SYMBOLS for b in SYMBOLS if a + b != "  "}


class Automaton:
    """A probabilistic automaton: per state the visits, the endings, and per symbol the target and its count."""

    def __init__(self) -> None:
        self.visits, self.ends, self.moves = [0], [0], [{}]

    @classmethod
    def fit(cls, words: list[str], alpha: float) -> Automaton:
        tree = cls()
        for word in words:
            at = 0
            tree.visits[0] += 1
            for symbol in word:
                if symbol not in tree.moves[at]:
                    tree.moves[at][symbol] = [len(tree.visits), 0]
                    tree.visits.append(0)
                    tree.ends.append(0)
                    tree.moves.append({})
                tree.moves[at][symbol][1] += 1
                at = tree.moves[at][symbol][0]
                tree.visits[at] += 1
            tree.ends[at] += 1
        tree._merge_all(alpha)
        return tree

    def _differ(self, n1: int, f1: int, n2: int, f2: int, alpha: float) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def _compatible(self, p: int, q: int, alpha: float) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            if not n or not m:
                continue
            if self._differ(n, self.ends[p], m, self.ends[q], alpha):
                return False
            for symbol in self.moves[p].keys() | self.moves[q].keys():
                a, b = self.moves[p].get(symbol), self.moves[q].get(symbol)
                if self._differ(n, a[1] if a else 0, m, b[1] if b else 0, alpha):
                    return False
                if a and b:
                    todo.append((a[0], b[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for symbol, (to, n) in self.moves[q].items():
                if symbol in self.moves[p]:
                    self.moves[p][symbol][1] += n
                    todo.append((self.moves[p][symbol][0], to))
                else:
                    self.moves[p][symbol] = [to, n]

    def _merge_all(self, alpha: float) -> None:
        red = [0]
        while True:
            inside = set(red)
            edge = next(((r, s, m[0]) for r in red for s, m in sorted(self.moves[r].items()) if m[0] not in inside), None)
            if edge is None:
                break
            source, symbol, blue = edge
            for state in red:
                if self._compatible(state, blue, alpha):
                    self.moves[source][symbol][0] = state
                    self._fold(state, blue)
                    break
            else:
                red.append(blue)
        self.states = len(red)

    def score(self, word: str, floor: float = 1e-3) -> float:
        """Mean log2-probability a symbol; from a symbol never seen in its place on, and where no credential ends, it is that of ``floor``."""
        at, total = 0, 0.0
        for k, symbol in enumerate(word):
            move = self.moves[at].get(symbol)
            if move is None:
                return (total + (len(word) - k) * math.log2(floor)) / len(word)
            total += math.log2(move[1] / self.visits[at])
            at = move[0]
        return total / len(word) if self.ends[at] else math.log2(floor)


@dataclass(frozen=True)
class Format:
    """An automaton with its labelled credentials' middle score and that score's spread for one symbol, both by medians."""

    automaton: Automaton
    middle: float
    spread: float

    @classmethod
    def fit(cls, words: list[str], alpha: float) -> Format:
        automaton = Automaton.fit(words, alpha)
        scores = [automaton.score(w) for w in words]
        middle = median(scores)
        # The median of a normal spread is 0.6745 standard deviations.
        spread = median(abs(x - middle) * math.sqrt(len(w)) for x, w in zip(scores, words, strict=True)) / 0.6745
        return cls(automaton, middle, max(spread, LEAST_SPREAD))

    def least(self, length: int, miss: float) -> float:
        """The score that all but a share ``miss`` of credentials of this length reach."""
        return self.middle - NormalDist().inv_cdf(1 - miss) * self.spread / math.sqrt(length)


@dataclass
class Model:
    automata: dict[int, Format]
    background: dict[str, float]
    how: Grammar
    #: Tokens that can be credentials by alphabet and length.
    token: re.Pattern
    least: int

    def __post_init__(self) -> None:
        self._known: dict[str, int | None] = {}

    def kind(self, value: str) -> int | None:
        """The kind whose format the token has most likely, if any."""
        if value not in self._known:
            if len(self._known) >= 200_000:
                self._known.clear()
            self._known[value] = self._kind(classes(value))
        return self._known[value]

    def _kind(self, word: str) -> int | None:
        plain = sum(self.background[a + b] for a, b in zip(" " + word, word, strict=False)) / len(word)
        scored = [(f.automaton.score(word), k, f.least(len(word), self.how.miss)) for k, f in self.automata.items()]
        return max(((s, k) for s, k, least in scored if s >= max(least, plain + self.how.gain)), default=(0, None))[1]

    def spans(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
        """Learned spans outside the base spans: whole tokens, else without outer dots, else the parts between dots."""
        out = []
        if not self.automata:
            return out
        for m in self.token.finditer(text):
            start, value = m.start(), m[0]
            for at, part in _pieces(value) if "." in value else ((0, value),):
                a, b = start + at, start + at + len(part)
                if len(part) < self.least or (out and a < out[-1][2]):
                    continue
                if (kind := self.kind(part)) is not None and not any(x < b and a < y for _, x, y, _ in base):
                    out.append((kind, a, b, part))
        return out


def _pieces(value: str) -> list[tuple[int, str]]:
    """A token with dots, the token without outer dots, and its parts, with their places; none twice."""
    inner = value.strip(".")
    found = [(0, value), (len(value) - len(value.lstrip(".")), inner)] + [(m.start(), m[0]) for m in re.finditer(r"[^.]+", value)]
    return list(dict.fromkeys(found))


def learn(labelled: dict[int, list[str]], how: Grammar, overall: dict[str, int] | None = None) -> Model:
    """``labelled``: credentials by the number of their kind; ``overall``: pairs of classes in all texts (if missing, any class may follow any other)."""
    automata = {kind: Format.fit([classes(v) for v in sorted(values)], how.alpha) for kind, values in labelled.items()}
    seen = Counter(c for values in labelled.values() for v in values for c in classes(v))
    alphabet = "".join(ALPHABET[c] for c in sorted(seen)) or "0-9"
    least = min([LONG, *(len(v) for values in labelled.values() for v in values)])
    return Model(automata, follow_bits(overall or {}), how, re.compile(f"[{alphabet}]{{{least},}}"), least)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Kind, start, end and credential of every pattern's matches."""
    low, out = text.lower(), []
    for kind, (pattern, group, least, needs) in enumerate(PATTERNS):
        if not needs or any(n in low for n in needs):
            for m in pattern.finditer(text):
                if len(m[group]) >= least:
                    out.append((kind, m.start(), m.end(), m[group]))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _structs(rows: list[list[tuple]]) -> pa.Array:
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())])
    names = [f.name for f in kind]
    return pa.array([[dict(zip(names, s, strict=True)) for s in r] for r in rows], pa.list_(kind))


def statistics(docs: DataFrame, how: Grammar, text_col: str) -> DataFrame:
    """What the automata are learned from, in one pass: ``kind`` and ``value`` of labelled credentials, and counts ``n`` of each ``pair`` of classes.

    A task keeps the ``labelled`` credentials of a kind with the smallest hashes, so that what it hands on is bounded; the smallest
    of all tasks are the smallest of all texts. Nothing is written down.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, int]] = [{} for _ in KINDS]
        counts = np.zeros(len(SYMBOLS) ** 2, np.int64)
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                counts += pair_counts(text)
                for kind, _, _, secret in base_spans(text):
                    kept[kind][secret] = _order(secret)
            for kind, some in enumerate(kept):
                if len(some) > how.labelled:
                    kept[kind] = dict(sorted(some.items(), key=lambda x: (x[1], x[0]))[: how.labelled])
        rows = [(kind, v, h, None, 0) for kind, some in enumerate(kept) for v, h in some.items()]
        rows += [(None, None, None, SYMBOLS[k // len(SYMBOLS)] + SYMBOLS[k % len(SYMBOLS)], int(counts[k])) for k in np.flatnonzero(counts).tolist()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "value", "h", "pair", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind int, value string, h long, pair string, n long")
    return found.groupBy("kind", "value", "h", "pair").agg(F.sum("n").alias("n"))


def _order(secret: str) -> int:
    return xxhash.xxh64_intdigest(secret.encode("utf-8", "surrogatepass"), 42) - (1 << 63)


def train(docs: DataFrame, how: Grammar, text_col: str) -> Model:
    """Automata from at most ``how.labelled`` distinct base credentials a kind, held against the pairs of classes in all texts.

    The driver gets these credentials and a count for each pair of classes.
    """
    place = F.row_number().over(W.partitionBy("kind").orderBy("h", "value"))
    found = statistics(docs, how, text_col).withColumn("place", place).filter(F.col("kind").isNull() | (F.col("place") <= how.labelled)).collect()
    labelled: dict[int, list[str]] = {}
    for r in sorted((r for r in found if r["kind"] is not None), key=lambda r: (r["kind"], r["place"])):
        labelled.setdefault(r["kind"], []).append(r["value"])
    return learn(labelled, how, {r["pair"]: r["n"] for r in found if r["kind"] is None})


def scan(docs: DataFrame, how: Grammar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``base`` spans and ``learned`` spans of every row; kinds are numbers of ``KINDS``."""
    model = train(docs, how or Grammar(), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            base = [base_spans(t) for t in texts]
            learned = [model.spans(t, b) for t, b in zip(texts, base, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _structs(base), _structs(learned)], ["doc_id", "base", "learned"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {FOUND}, learned {FOUND}")


def redact(docs: DataFrame, how: Grammar | None = None, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span's text replaced by ``mask``; ``n_chars`` follows the text."""
    model = train(docs, how or Grammar(), text_col)
    names = docs.columns
    at, chars = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        spans = base_spans(text)
        spans = sorted((a, b) for _, a, b, _ in spans + model.spans(text, spans))
        out, done = [], 0
        for a, b in spans:
            if b > done:
                out += [text[done:a], mask] if a >= done else []
                done = b
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t.as_py()) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
