"""Secret scans: fixed patterns, and format grammars inferred from labelled credentials.

Fixed patterns give the base spans.  Their values, labelled by kind, are sampled
up to a bound and each kind's format is inferred: values become strings of
character classes, a prefix tree counts them, and states whose frequencies are
compatible under the Hoeffding bound are merged in red-blue order into a
probabilistic automaton.  Every other run of the values' alphabet, and what base
spans leave of one, is scored by its likelihood per character under each
automaton against the same for ordinary tokens; a run that no format accepts is
scored again without its outer dots, and then by its parts between dots.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.operators.storage import materialize

# The base patterns, and the least length of what they must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "grammar")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
#: Runs of the alphabet of labelled values, from their least length on.
LEAST_TOKEN = min(LEAST.values())
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_TOKEN},}}")
_PART = re.compile(rf"[^.]{{{LEAST_TOKEN},}}")
#: No base pattern can match ``access`` or ``hex`` outside a run of this many of their characters.
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Labelled credentials of a kind, and ordinary tokens, that the automata are fitted on.
SAMPLE = 2000
#: Confidence of the merge test, and the least frequency at which states are compared.
ALPHA = 0.05
LEAST_SEEN = 8
#: Tokens, of this length at most, whose verdict a task holds.
KNOWN = 200_000
KNOWN_LENGTH = 64
#: Gain in nats per character over ordinary tokens that a credential must have.
MARGIN = 0.5
#: Share of the ordinary tokens that a kind may accept and still be left out of them.
MIXED = 0.1
_UNSEEN = math.log(1e-4)


def _class_of(ch: str) -> str:
    if ch.isdigit():
        return "d"
    if "a" <= ch <= "f":
        return "h"
    if "g" <= ch <= "z":
        return "l"
    if "A" <= ch <= "F":
        return "H"
    if "G" <= ch <= "Z":
        return "U"
    return "-"


_TABLE = {i: _class_of(chr(i)) for i in range(128)}


def shape(token: str) -> str:
    """A token's character classes: digit, a-f, g-z, A-F, G-Z, or other."""
    return token.translate(_TABLE)


@dataclass
class Automaton:
    """A probabilistic deterministic automaton: per state, visits, ends and counted moves."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    floor: float = 0.0
    lengths: list[int] = field(default_factory=list)

    @classmethod
    def infer(cls, words: list[str], alpha: float = ALPHA) -> Automaton:
        """Prefix tree of ``words``, states merged where compatible (ALERGIA)."""
        tree = cls()
        for w in words:
            at = 0
            tree.visits[0] += 1
            for ch in w:
                step = tree.moves[at].get(ch)
                if step is None:
                    tree.visits.append(0)
                    tree.ends.append(0)
                    tree.moves.append({})
                    step = tree.moves[at][ch] = [len(tree.visits) - 1, 0]
                step[1] += 1
                at = step[0]
                tree.visits[at] += 1
            tree.ends[at] += 1
        tree._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        if words:
            tree.lengths = sorted(map(len, words))
            tree.calibrate(words)
        return tree

    def calibrate(self, words: list[str]) -> None:
        """Sets the floor so that 49 in 50 of ``words`` are accepted."""
        scores = sorted(self.score(w) for w in words)
        self.floor = scores[len(scores) // 50]

    def _differ(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.visits[x], self.visits[y]
            if n < LEAST_SEEN or m < LEAST_SEEN:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[x] / n - self.ends[y] / m) > limit:
                return True
            for ch in self.moves[x].keys() | self.moves[y].keys():
                p, q = self.moves[x].get(ch), self.moves[y].get(ch)
                if abs((p[1] if p else 0) / n - (q[1] if q else 0) / m) > limit:
                    return True
                if p and q:
                    todo.append((p[0], q[0]))
        return False

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.visits[x] += self.visits[y]
            self.ends[x] += self.ends[y]
            for ch, (z, n) in self.moves[y].items():
                if ch in self.moves[x]:
                    self.moves[x][ch][1] += n
                    todo.append((self.moves[x][ch][0], z))
                else:
                    self.moves[x][ch] = [z, n]

    def _merge(self, bound: float) -> None:
        red = [0]
        while True:
            blue = sorted({(s[0], r, ch) for r in red for ch, s in self.moves[r].items() if s[0] not in red}, key=lambda x: (-self.visits[x[0]], x[0]))
            if not blue:
                return
            state, parent, ch = blue[0]
            for r in red:
                if not self._differ(r, state, bound):
                    self.moves[parent][ch][0] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)

    def _length(self, n: int) -> float:
        """Log-likelihood of a length, spread over a tenth of it to both sides, as merged states forget lengths."""
        if not self.lengths:
            return 0.0
        w = n // 10
        near = bisect_right(self.lengths, n + w) - bisect_left(self.lengths, n - w)
        return math.log(max(1e-4, near / (len(self.lengths) * (2 * w + 1))))

    def score(self, word: str, least: float = -math.inf) -> float:
        """Log-likelihood per character, end and length included; unseen moves and lengths cost as one in ten thousand.

        All terms are losses, so a word that falls under ``least`` on the way is
        given up: its score is then minus infinity.
        """
        at, total = 0, self._length(len(word))
        bound = least * (len(word) + 1)
        for i, ch in enumerate(word):
            step = self.moves[at].get(ch)
            if step is None:
                total += _UNSEEN * (len(word) - i + 1)
                return total / (len(word) + 1) if total >= bound else -math.inf
            total += math.log(step[1] / self.visits[at])
            if total < bound:
                return -math.inf
            at = step[0]
        total += math.log(max(1e-4, self.ends[at] / self.visits[at]))
        return total / (len(word) + 1)


@dataclass
class Grammars:
    """One automaton for each kind of credential and one for ordinary tokens."""

    kinds: dict[str, Automaton]
    plain: Automaton

    def secret(self, token: str) -> float | None:
        """The likelihood per character of the best accepting format, or None."""
        form = shape(token)
        found = [p for a in self.kinds.values() if (p := a.score(form, a.floor)) >= a.floor]
        return max(found) if found and max(found) - self.plain.score(form) >= MARGIN else None

    def accepted(self, token: str) -> list[tuple[int, str, float]]:
        """(offset, value, score) of the token; else of it without outer dots; else of its parts between dots."""
        if (p := self.secret(token)) is not None:
            return [(0, token, p)]
        if "." not in token:
            return []
        bare = token.strip(".")
        if len(bare) >= LEAST_TOKEN and len(bare) < len(token) and (p := self.secret(bare)) is not None:
            return [(token.index(bare), bare, p)]
        parts = [(m.start(), m[0]) for m in _PART.finditer(token) if m[0] != bare]
        return [(at, v, p) for at, v in parts if (p := self.secret(v)) is not None]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, code points, end exclusive, by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out


def scan(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, str]]]:
    """Base spans of a text, and as candidates what they leave of its tokens."""
    spans, tokens = base_spans(text), []
    for m in _CANDIDATE.finditer(text):
        token = m[0]
        # a run of 24 hexadecimal characters lies in one token, as those are token characters
        if len(token) >= LEAST["hex"]:
            spans += [("hex", m.start() + h.start(), m.start() + h.end(), h[0]) for h in _HEX.finditer(token)]
        tokens.append((m.start(), token))
    if not spans:
        return spans, tokens
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    free, next_, reach = [], 0, 0
    for start, token in tokens:
        at, end = max(start, reach), start + len(token)
        while next_ < len(spans) and spans[next_][1] < end:
            if spans[next_][1] - at >= LEAST_TOKEN:
                free.append((at, text[at : spans[next_][1]]))
            reach = max(reach, spans[next_][2])
            at = max(at, reach)
            next_ += 1
        if end - at >= LEAST_TOKEN:
            free.append((at, text[at:end]))
    return spans, free


def _tokens(text: str) -> list[str] | None:
    """The tokens of a text in which no base pattern can match, as a whole; None where one may."""
    low = text.lower()
    if "AKIA" in text or any(w in low for w in _WORDS):
        return None
    tokens = _CANDIDATE.findall(text)
    return None if tokens and len(max(tokens, key=len)) >= LEAST["hex"] and _HEX.search(text) else tokens


class _Seen:
    """Short tokens that a task has dealt with, forgotten when they get too many."""

    def __init__(self) -> None:
        self.held: set[str] = set()

    def new(self, tokens: list[str]) -> set[str]:
        return set(tokens) - self.held

    def add(self, tokens: set[str]) -> None:
        if len(self.held) >= KNOWN:
            self.held.clear()
        self.held.update(t for t in tokens if len(t) <= KNOWN_LENGTH)


def _values(sample: int):
    """(kind, value) of the base spans, and of the other tokens the ``sample`` of least hash of each task as ``plain``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)], names=["kind", "value"])
        least: list[tuple[int, str]] = []
        seen = _Seen()
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                tokens = _tokens(text)
                if tokens is None:
                    spans, rest = scan(text)
                    found += [(s[0], s[3]) for s in spans]
                    tokens = [v for _, v in rest]
                fresh = seen.new(tokens)
                seen.add(fresh)
                least += [(zlib.crc32(w.encode()), w) for w in fresh]
                if len(least) > 50 * sample:
                    least = sorted(set(least))[:sample]
            yield to_batch(found)
        yield to_batch([("plain", w) for _, w in sorted(set(least))[:sample]])

    return run


def _sample(values: DataFrame, size: int) -> list[str]:
    """At most ``size`` distinct values, those of least hash, so that the sample does not hang on order."""
    return sorted(r["value"] for r in values.distinct().orderBy(F.crc32("value"), "value").limit(size).collect())


def learn(values: dict[str, list[str]], plain: list[str]) -> Grammars:
    """Automata from labelled values by kind and from ordinary tokens.

    A kind with enough values sets its floor on every fifth, which its automaton
    has not seen.  Ordinary tokens hold some unlabelled credentials: those that a
    kind accepts are left out of theirs, unless that is more than ``MIXED`` of
    them, as then the kind's format does not tell credentials from words.
    """
    kinds = {}
    for kind, held in values.items():
        shapes = [shape(v) for v in held]
        if len(shapes) < 5 * LEAST_SEEN:
            kinds[kind] = Automaton.infer(shapes)
        else:
            kinds[kind] = Automaton.infer([v for i, v in enumerate(shapes) if i % 5])
            kinds[kind].calibrate(shapes[::5])
    kinds = {k: a for k, a in kinds.items() if a.visits[0]}
    words = [shape(v) for v in plain]
    for a in kinds.values():
        left = [w for w in words if a.score(w, a.floor) < a.floor]
        if len(words) - len(left) <= MIXED * len(words):
            words = left
    return Grammars(kinds, Automaton.infer(words))


def fit(texts: DataFrame, sample: int = SAMPLE) -> Grammars:
    """Automata from at most ``sample`` labelled values of each kind in ``texts``, and as many of its other tokens."""
    values = materialize(texts.mapInArrow(_values(sample), "kind string, value string"), "labelled")
    held = {k: _sample(values.where(F.col("kind") == k).select("value"), sample) for k in (*KINDS[:3], "plain")}
    plain = held.pop("plain")
    return learn(held, plain)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, grammars: Grammars | None = None) -> DataFrame:
    """``(doc_id, spans)`` for every row; spans are ``(kind, start, end, value, score)`` by start, then kind.

    Kinds are assign, access, hex and grammar (a token whose format a grammar
    accepts, with its likelihood per character as score; null on base spans).
    Positions are code points, the end exclusive.  Null and empty texts have no
    spans; whole texts are read, however long.  Repeated rows and ids keep their
    rows; other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dtype = docs.schema["doc_id"].dataType.simpleString()
    if grammars is None:
        grammars = fit(docs.select("text"), sample)
    full = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refused = _Seen()

        def hits(token: str) -> list[tuple[int, str, float]]:
            if token in refused.held:
                return []
            if not (found := grammars.accepted(token)):
                refused.add({token})
            return found

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                tokens = _tokens(text) if text else []
                # most texts: no base span, and only tokens that every grammar refuses
                if tokens is not None and not any([hits(t) for t in refused.new(tokens)]):
                    out.append([])
                    continue
                spans, rest = scan(text)
                rows = [{"kind": k, "start": a, "end": b, "value": v, "score": None} for k, a, b, v in spans]
                for start, token in rest:
                    rows += [{"kind": "grammar", "start": start + at, "end": start + at + len(v), "value": v, "score": p} for at, v, p in hits(token)]
                out.append(sorted(rows, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, full)], names=["doc_id", "spans"])

    return docs.mapInArrow(score, f"doc_id {dtype}, spans array<struct<kind:string,start:int,end:int,value:string,score:double>>")
