"""Secret scans: fixed patterns, and probabilistic automata inferred from what those patterns label."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm.common import lean, save, small_batches

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "grammar")

#: What may be a credential that no base rule knows: a run of its characters, also beside '.' and '@' (parts of a dotted
#: token), and the password of user:password@host with whatever marks it has.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LOGIN = re.compile(r"(?<=[A-Za-z0-9._%+-]:)[^\s:@/]{16,}+(?=@)")
LEARNT = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Symbols of a sampled token that its tree has, so that a tree is bounded; candidates are scored whole.
DEPTH = 256
END = "$"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the base rules, by start and kind; matches that are too short are used up and dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# Class of a character: hexadecimal or other letters by case, digits; marks stand for themselves.
_CLASS = str.maketrans({**{c: "x" for c in "abcdef"}, **{c: "X" for c in "ABCDEF"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}, **{c: "d" for c in "0123456789"}})
ALPHABET = "xXlUd+/_.=-"


def shape(token: str) -> str:
    return token.translate(_CLASS)


@dataclass
class Automaton:
    """Probabilistic automaton: of each state the visits, the ends, and by symbol the uses and the next state."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    uses: list[dict[str, int]] = field(default_factory=lambda: [{}])
    next: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def add(self, word: str) -> None:
        q = 0
        self.visits[0] += 1
        for c in word:
            self.uses[q][c] = self.uses[q].get(c, 0) + 1
            if c not in self.next[q]:
                self.next[q][c] = len(self.visits)
                self.visits.append(0)
                self.ends.append(0)
                self.uses.append({})
                self.next.append({})
            q = self.next[q][c]
            self.visits[q] += 1
        self.ends[q] += 1

    def _differ(self, f: int, n: int, g: int, m: int, bound: float) -> bool:
        return abs(f / n - g / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Hoeffding's test on ends and symbols of two states, and of all that follow both."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            if not n or not m:
                continue
            if self._differ(self.ends[p], n, self.ends[q], m, bound):
                return False
            for c in {*self.uses[p], *self.uses[q]}:
                if self._differ(self.uses[p].get(c, 0), n, self.uses[q].get(c, 0), m, bound):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add a state of the tree and all below it to another state."""
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for c, n in self.uses[q].items():
                self.uses[p][c] = self.uses[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm of the word's probability, a little of each state's mass spread over the alphabet."""
        q, total, share = 0, 0.0, 0.5
        for c in word:
            total += math.log((self.uses[q].get(c, 0) + share) / (self.visits[q] + share * (len(ALPHABET) + 1)))
            q = self.next[q].get(c, q)
        return total + math.log((self.ends[q] + share) / (self.visits[q] + share * (len(ALPHABET) + 1)))


def infer(words: list[str], alpha: float = 0.05) -> Automaton:
    """Merge statistically compatible states of the words' prefix tree, in the order of their discovery."""
    tree = Automaton()
    for w in words:
        tree.add(w)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, blue = [0], [(0, c) for c in sorted(tree.next[0])]
    seen = {0}
    while blue:
        p, c = blue.pop(0)
        q = tree.next[p][c]
        if q in seen:
            continue
        for r in red:
            if tree.compatible(r, q, bound):
                tree.next[p][c] = r
                tree.fold(r, q)
                blue = [(s, x) for s in red for x in sorted(tree.next[s]) if tree.next[s][x] not in seen]
                break
        else:
            red.append(q)
            seen.add(q)
            blue += [(q, x) for x in sorted(tree.next[q])]
    order = {s: i for i, s in enumerate(red)}
    out = Automaton([], [], [], [])
    for s in red:
        out.visits.append(tree.visits[s])
        out.ends.append(tree.ends[s])
        out.uses.append(tree.uses[s])
        out.next.append({x: order[t] for x, t in tree.next[s].items()})
    return out


@dataclass
class Grammar:
    """Automata of credentials and of other tokens, and the ratio a symbol above which a candidate is a credential."""

    credential: Automaton
    other: Automaton
    limit: float

    def ratio(self, token: str) -> float:
        s = shape(token)
        return (self.credential.log_likelihood(s) - self.other.log_likelihood(s)) / (len(s) + 1)


def _picked(words: set[str], most: int) -> list[str]:
    return sorted(words, key=lambda w: hashlib.md5(w.encode()).digest())[:most]


def fit(credentials: set[str], others: set[str], most: int = 600, least: int = 5) -> Grammar | None:
    """A grammar from labelled tokens, or None with fewer than `least` of either kind.

    A bounded sample builds the trees: `most` distinct tokens of each kind,
    DEPTH symbols of each. The limit is over the ratios of all given other
    tokens, so none of them would be found.
    """
    if len(credentials) < least or len(others) < least:
        return None
    made = [infer([shape(w)[:DEPTH] for w in _picked(kind, most)]) for kind in (credentials, others)]
    grammar = Grammar(*made, 0.0)
    return Grammar(*made, max(0.25, max(grammar.ratio(w) for w in others if len(w) >= 16 or len(others) < 50) + 0.05) if any(len(w) >= 16 for w in others) else 0.25)


class _Smallest:
    """The `most` distinct words with the smallest hashes of all that were added."""

    def __init__(self, most: int) -> None:
        self.most, self.words, self.bound = most, {}, None

    def add(self, word: str) -> None:
        h = hashlib.md5(word.encode()).digest()
        if self.bound is None or h < self.bound:
            self.words[word] = h
            if len(self.words) >= 2 * self.most:
                self.cut()

    def cut(self) -> None:
        if len(self.words) > self.most:
            self.words = dict(sorted(self.words.items(), key=lambda x: x[1])[: self.most])
            self.bound = max(self.words.values())


def learn(docs: DataFrame, credentials: int = 5000, others: int = 20000) -> Grammar | None:
    """Fit on tokens of all documents: of each kind the distinct ones with the smallest hashes, so many at most.

    Credentials are what the base rules find; other tokens are runs of
    credential characters that have letters only and overlap no finding. Each
    task gives its smallest, which hold the smallest of all; counts by hash
    prefix say which prefixes the driver needs.
    """

    small_batches(docs.sparkSession)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = kept = _Smallest(others), _Smallest(credentials)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for w in {(ASSIGN.match(text, s)[2] if k == 0 else text[s:e]) for s, k, e in spans}:
                    good.add(w)
                for w in {m[0] for m in LEARNT.finditer(text) if m[0].isalpha() and not any(s < m.end() and m.start() < e for s, _, e in spans)}:
                    bad.add(w)
        for kind, k in enumerate(kept):
            k.cut()
            h = [int.from_bytes(x[:2]) >> 4 for x in k.words.values()]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(h), pa.int32()), pa.array(h, pa.int32()), pa.array(list(k.words), pa.string())], ["kind", "prefix", "word"])

    found = save(docs.select("text").mapInArrow(lean(tokens), "kind int, prefix int, word string").distinct())
    counts = sorted(map(tuple, found.groupBy("kind", "prefix").count().collect()))
    sets = []
    for kind, most in ((1, credentials), (0, others)):
        last, n = -1, 0
        for k, prefix, m in counts:
            if k == kind and n < most:
                last, n = prefix, n + m
        sets.append(set(_picked({r.word for r in found.where((F.col("kind") == kind) & (F.col("prefix") <= last)).select("word").collect()}, most)))
    return fit(*sets)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of what the grammar scores: passwords of logins first, then runs."""
    return [m.span() for m in LOGIN.finditer(text)] + [m.span() for m in CANDIDATE.finditer(text)]


def find(text: str, grammar: Grammar | None) -> list[tuple[int, int, int]]:
    """All spans of a text: those of the base rules, and candidates beside them that the grammar takes for credentials."""
    spans = base_spans(text)
    if grammar is not None:
        for start, end in candidates(text):
            if not any(s < end and start < e for s, _, e in spans) and grammar.ratio(text[start:end]) > grammar.limit:
                spans.append((start, 3, end))
        spans.sort()
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with a mark in place of each run of overlapping spans."""
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            out += [text[at:s], mark]
        at = end = max(end, e)
    return "".join(out) + text[at:]


SPANS, REDACTED = "__secret_spans", "__secret_redacted"


def scan(docs: DataFrame, grammar: Grammar | None, rewrite: bool = False) -> DataFrame:
    """docs with the column of joined spans and, if asked for, one of redacted texts (null where the text is).

    A null text has no spans. Every row keeps its columns; repeated rows have
    equal spans; an empty table gives no rows.
    """
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(at).to_pylist():
                found = find(text or "", grammar)
                spans.append(joined(found))
                texts.append(redact(text, found) if rewrite and text is not None else None)
            more = [pa.array(spans, pa.string())] + [pa.array(texts, pa.string())] * rewrite
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, SPANS, *[REDACTED] * rewrite])

    added = [T.StructField(SPANS, T.StringType())] + [T.StructField(REDACTED, T.StringType())] * rewrite
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *added]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_grammar, base_sha256, spans for docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    out = scan(docs, learn(docs))
    all_spans = F.filter(F.split(SPANS, ","), lambda x: x != "")
    n = lambda kind: F.size(F.filter(all_spans, lambda x: x.startswith(kind))).cast("long")
    base = F.array_join(F.filter(all_spans, lambda x: ~x.startswith("grammar")), ",")
    return out.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.col(SPANS).alias("spans"))
