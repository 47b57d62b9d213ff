"""Secret scans: fixed rules, and formats inferred from labelled credentials.

Grammar inference: the labelled examples of a format form a prefix tree with counts; states whose endings and
transitions are statistically compatible (Hoeffding bounds, applied to all that follows) are merged into a
probabilistic automaton. Every candidate string of a text is scored by the likelihood of its best format against
that of an automaton of ordinary words. What a candidate is follows from the examples alone: their letters (and all ASCII
letters and digits) make up runs; any other sign among them is a joint; candidates of a format are the stretches of a run that begin at its start or
after a joint and end at its end or before one, of the format's shortest example's length at least, with a last sign as examples have it, with a digit and a
letter if all examples have one, with a beginning that examples have if they have few, and without a joint that the format
never writes. A piece between joints that is far likelier an ordinary word ends a candidate, so that a path with a random id in it
is none. Of candidates that overlap, such are taken as together save most bits.
Ordinary words are those of the documents themselves, every distinct one. There are too many for a prefix tree, so of their
automaton's states those are merged that share the last ORDER symbols: its counts are bounded, whatever the corpus.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, map_batches, slices, without

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
#: Access keys (20 and more) and hex strings (24 and more) lie within one run each.
_RUN = re.compile(r"[A-Za-z0-9]{20,}")
#: Letters of runs and of ordinary words whatever the formats are.
_ALNUM, _WORDLY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), frozenset("+/_=-")
#: Examples of each format, merging's confidence, bits by which a candidate must be likelier than ordinary words.
EXAMPLES, ALPHA, MARGIN = 150, 0.05, 20.0
#: Beginnings that a format's exact first letters may have at most (a tenth of the examples, if fewer); bits by which a piece
#: between joints must be likelier an ordinary word to end a candidate.
BEGINNINGS, PIECE = 8, 6.0
#: Labelled examples of a format at most; symbols that tell an ordinary word's state; words a task remembers, to send each once.
MOST_EXAMPLES, ORDER, REMEMBERED = 2000, 4, 100_000
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

_CLASSES = {"h": "abcdef", "g": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}
_CLASS = {c: k for k, own in _CLASSES.items() for c in own}


def beginning(examples: list[str]) -> int:
    """How many first letters are taken exactly: as long as the examples have few different beginnings."""
    few = max(1, min(BEGINNINGS, len(examples) // 10))
    out, shortest = 0, min(map(len, examples), default=0)
    while out < shortest and len({x[: out + 1] for x in examples}) <= few:
        out += 1
    return out


class Shape:
    """What candidates of a format must keep to, from its examples: least letters, exact first letters, joints, classes."""

    def __init__(self, examples: list[str]):
        self.least, self.literal, self.letters = min(map(len, examples)), beginning(examples), set().union(*examples)
        self.joints = {(c, i < self.literal) for x in examples for i, c in enumerate(x) if c not in _ALNUM}
        self.last = {x[-1] for x in examples} | _ALNUM  # a mark after a credential isn't part of it
        self.digit, self.letter = (all(pattern.search(x) for x in examples) for pattern in (_DIGIT, _LETTER))

    def may(self, text: str) -> bool:
        """Whether a whole string has the length, classes and joints of the format."""
        return len(text) >= self.least and text[-1] in self.last and (not self.digit or bool(_DIGIT.search(text))) and (not self.letter or bool(_LETTER.search(text))) and all(c in _ALNUM or (c, i < self.literal) in self.joints for i, c in enumerate(text))


def shapes(labelled: dict[str, list[str]]) -> dict[str, Shape]:
    return {k: Shape(v) for k, v in labelled.items() if k and v}


class Automaton:
    """A probabilistic automaton learned by merging prefix-tree states (red and blue states in breadth order)."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.literal = beginning(examples)
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.total = [0], [0]
        for text in sorted(examples):
            s = 0
            self.total[0] += 1
            for k, c in enumerate(text):
                a = c if k < self.literal else _CLASS.get(c, c)
                if a not in self.next[s]:
                    self.next[s][a] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.total.append(0)
                self.count[s][a] = self.count[s].get(a, 0) + 1
                s = self.next[s][a]
                self.total[s] += 1
            self.ends[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], sorted(self.next[0].items())
        blue = [(0, a, s) for a, s in blue]
        while blue:
            parent, a, s = blue.pop(0)
            for r in red:
                if self._compatible(r, s):
                    self.next[parent][a] = r
                    self._fold(r, s)
                    break
            else:
                red.append(s)
            blue = [(r, x, t) for r in red for x, t in sorted(self.next[r].items()) if t not in red]
        self.red = red
        self.steps: dict[tuple[int, str, bool], tuple[float, int]] = {}

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, r: int, s: int) -> bool:
        todo = [(r, s)]
        while todo:
            r, s = todo.pop()
            n, m = self.total[r], self.total[s]
            if not n or not m:
                continue
            if self._differ(self.ends[r], n, self.ends[s], m):
                return False
            for a in self.count[r].keys() | self.count[s].keys():
                if self._differ(self.count[r].get(a, 0), n, self.count[s].get(a, 0), m):
                    return False
                if a in self.next[r] and a in self.next[s] and self.next[r][a] != r:
                    todo.append((self.next[r][a], self.next[s][a]))
        return True

    def _fold(self, r: int, s: int) -> None:
        """Add the tree below s to r; a subtree that r lacks is hung on as it is."""
        todo = [(r, s)]
        while todo:
            r, s = todo.pop()
            self.total[r] += self.total[s]
            self.ends[r] += self.ends[s]
            for a, t in self.next[s].items():
                self.count[r][a] = self.count[r].get(a, 0) + self.count[s][a]
                if a in self.next[r]:
                    todo.append((self.next[r][a], t))
                else:
                    self.next[r][a] = t

    def step(self, s: int, c: str, start: bool) -> tuple[float, int]:
        """Bits of letter c in state s (start: among the exact first letters), and the next state."""
        got = self.steps.get((s, c, start))
        if got is None:
            a = c if start else _CLASS.get(c, c)
            within = 0.0 if start else math.log2(len(_CLASSES.get(a, "1")))
            n = self.count[s].get(a, 0)
            got = self.steps[s, c, start] = (within + (math.log2(self.total[s] / n) if n else 16.0), self.next[s][a] if n else s)
        return got

    def bits(self, text: str) -> float:
        """Bits a letter to write the text; a step never seen costs 16 and stays where it is."""
        s, out = 0, 0.0
        for k, c in enumerate(text):
            more, s = self.step(s, c, k < self.literal)
            out += more
        return out / max(1, len(text))


class Words:
    """A probabilistic automaton of ordinary words, whose states that share the last ORDER symbols are merged; symbols are
    classes throughout. counts: (state, symbol, words), as word_steps() has them; a symbol of "" is a word's end."""

    def __init__(self, examples: list[str], counts: Iterable[tuple[str, str, int]] = ()):
        self.literal = 0
        every = word_steps(examples)
        for state, a, n in counts:
            every[state, a] += n
        self.names = {name: k for k, name in enumerate(sorted({"^"} | {state for state, _ in every}, key=lambda x: (x != "^", x)))}
        self.count, self.total = [{} for _ in self.names], [0] * len(self.names)
        for (state, a), n in sorted(every.items()):
            self.count[self.names[state]][a] = n
            self.total[self.names[state]] += n
        self.states = list(self.names)
        self.steps: dict[tuple[int, str], tuple[float, int]] = {}

    def step(self, s: int, c: str, start: bool) -> tuple[float, int]:
        """Bits of letter c in state s, and the next state."""
        got = self.steps.get((s, c))
        if got is None:
            a = _CLASS.get(c, c)
            n = self.count[s].get(a, 0)
            bits = math.log2(len(_CLASSES.get(a, "1"))) + (math.log2(self.total[s] / n) if n else 16.0)
            got = self.steps[s, c] = (bits, self.names[(self.states[s] + a)[-ORDER:]] if n else s)
        return got

    bits = Automaton.bits


def word_steps(words: Iterable[str]) -> Counter:
    """Of words' automaton how often each (state, symbol) is taken; a state is the last ORDER symbols, from ^ at the start."""
    out: Counter = Counter()
    for word in words:
        state = "^"
        for c in word:
            a = _CLASS.get(c, c)
            out[state, a] += 1
            state = (state + a)[-ORDER:]
        out[state, ""] += 1
    return out


def labelled_credentials(seed: int = 5, examples: int = EXAMPLES) -> dict[str, list[str]]:
    """Labelled examples: strings in widely documented credential formats, and ordinary words."""
    rng = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "ti", "st", "en", "at", "or", "qu", "sch", "que", "ge")) for _ in range(rng.randint(6, 14)))
    made = {
        "access": lambda: "AKIA" + some(up + dig, 16),
        "hex": lambda: some("abcdef" + dig, rng.choice((32, 40, 64))),
        "base64": lambda: some(low + up + dig + "+/", 40),
        "prefixed": lambda: rng.choice(("ghp_", "gho_")) + some(low + up + dig, 36),
        "live": lambda: "sk_live_" + some(low + up + dig, 24),
        "web": lambda: "eyJ" + some(low + up + dig + "_-", rng.randint(30, 60)),
        "": lambda: rng.choice((str.lower, str.upper, str.capitalize, lambda w: w + rng.choice("-_/") + word(), lambda w: w + some(dig, rng.randint(1, 4))))(word()),
    }
    return {k: [f() for _ in range(examples * (1 if k else 4))] for k, f in made.items()}


class Formats:
    """Automata of all formats and of ordinary words; a format's limit is what nearly all its examples keep to."""

    def __init__(self, labelled: dict[str, list[str]], counts: Iterable[tuple[str, str, int]] = ()):
        self.words = Words(labelled[""], counts)
        self.shape = shapes(labelled)
        self.own = {k: Automaton(labelled[k]) for k in self.shape}
        self.limit = {k: max(self.own[k].bits(x) for x in labelled[k]) + 0.25 for k in self.shape}
        self.least = min((x.least for x in self.shape.values()), default=1)
        self.run = re.compile("[" + "".join(map(re.escape, sorted(_ALNUM.union(*(x.letters for x in self.shape.values()))))) + f"]{{{self.least},}}")

    def best(self, text: str) -> str | None:
        """The format that explains a whole string, if any does much better than ordinary words."""
        plain = self.words.bits(text)
        fits = [(bits, k) for k, a in self.own.items() if self.shape[k].may(text) and (bits := a.bits(text)) <= min(self.limit[k], plain - MARGIN / len(text))]
        return min(fits)[1] if fits else None

    def spans(self, run: str, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
        """Candidates of a run, between two places, that a format explains: (start, end), none overlapping.

        Those that together save most bits over plain bytes, found in one pass. Candidates in the same states fare alike
        from there on, so of these only such go on as no other beats in what is saved, what is left under both of the
        format's limits, and what its present piece between joints has over ordinary words.
        """
        high = len(run) if high is None else high
        if high - low < self.least:
            return []
        some = bool(_DIGIT.search(run, low, high)), bool(_LETTER.search(run, low, high))
        formats = [f for f, x in self.shape.items() if high - low >= x.least and (some[0] or not x.digit) and (some[1] or not x.letter)]
        if not formats:
            return []
        # Where a candidate from each place has a digit, and a letter.
        digits, letters = [high + 1] * (high - low + 1), [high + 1] * (high - low + 1)
        for i in range(high - 1, low - 1, -1):
            digits[i - low] = i + 1 if _DIGIT.match(run, i) else digits[i - low + 1]
            letters[i - low] = i + 1 if _LETTER.match(run, i) else letters[i - low + 1]

        def full(f: str, at: int) -> int:
            x = self.shape[f]
            return max(at + x.least, digits[at - low] if x.digit else 0, letters[at - low] if x.letter else 0)

        saved, chosen = [0.0] * (high - low + 1), [-1] * (high - low + 1)  # up to each place, and the start of what ends there
        # What a row would have saved by place i, with all that was saved before its start.
        save = lambda f, a, at, i: a + (8 - self.limit[f]) * (i - at) + saved[at - low]
        live: dict[tuple[str, int, int, int], list[tuple[float, float, float, int]]] = {}
        v = 0  # the state of the words' automaton for the piece since the last joint
        for i in range(low, high):
            c = run[i]
            joint = c not in _ALNUM
            if i == 0 or run[i - 1] not in _ALNUM:
                for f in formats:
                    if full(f, i) <= high:
                        live.setdefault((f, 0, 0, 0), []).append((0.0, 0.0, 0.0, i))
            word, v = (0.0, 0) if joint else self.words.step(v, c, False)
            moved: dict[tuple[str, int, int, int], list[tuple[float, float, float, int]]] = {}
            for (f, s, w, k), rows in live.items():
                start = k < self.shape[f].literal
                if joint and (c, start) not in self.shape[f].joints or start and c not in self.own[f].count[s]:
                    continue
                bits, s = self.own[f].step(s, c, start)
                plain, w = self.words.step(w, c, False)
                under, gain = self.limit[f] - bits, plain - bits
                lost = -self.limit[f] * (high - i - 1)  # too many bits to make good even if all other letters cost none
                own = moved.setdefault((f, s, w, min(k + 1, self.shape[f].literal)), [])
                own += [(a + under, b + gain, 0.0 if joint else p + word - bits, at) for a, b, p, at in rows if a + under >= lost and (not joint or min(b, p) >= -PIECE)]
            end = i + 1 == len(run) or run[i + 1] not in _ALNUM
            live, best = {}, saved[i - low]
            for key, rows in moved.items():
                if len(rows) > 1:
                    kept: list[tuple[float, float, float, int]] = []
                    for row in sorted(rows, key=lambda x: (-x[0], -x[1], -x[2], x[3])):
                        mine = save(key[0], row[0], row[3], i)
                        if not any(a >= row[0] and b >= row[1] and p >= row[2] and save(key[0], a, at, i) >= mine and (at <= row[3] or full(key[0], at) <= i + 1) for a, b, p, at in kept):
                            kept.append(row)
                    rows = kept
                if rows:
                    live[key] = rows
                if end and c in self.shape[key[0]].last:
                    for a, b, p, at in rows:
                        if a >= 0 and b >= MARGIN and p >= -PIECE and full(key[0], at) <= i + 1 and (now := save(key[0], a, at, i + 1)) > best:
                            best, chosen[i + 1 - low] = now, at
            saved[i + 1 - low] = best
        out, i = [], high
        while i > low:
            if (at := chosen[i - low]) >= 0:
                out.append((at, i))
                i = at
            else:
                i -= 1
        return out[::-1]


def scan_text(text: str, formats: Formats | None = None) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of a text in code points: all base kinds, then formats that overlap none of these."""
    low, out = text.encode("utf-8", "surrogatepass").lower(), []
    if any(x in low for x in _NAMES):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    solid = [(m.start(), m[0]) for m in _RUN.finditer(text)]
    for kind, pattern, least in ((1, _ACCESS, 20), (2, _HEX, 24)):
        out += [(kind, a + m.start(), a + m.end()) for a, run in solid for m in pattern.finditer(run) if m.end() - m.start() >= least]
    if formats:
        base = list(out)
        for a, run in ((m.start(), m[0]) for m in formats.run.finditer(text)):
            # What base spans leave of the run.
            inside = sorted((max(s - a, 0), min(e - a, len(run))) for _, s, e in base if s < a + len(run) and a < e)
            low, own = 0, []
            for s, e in [*inside, (len(run), len(run))]:
                own += formats.spans(run, low, max(s, low))
                low = max(low, e)
            out += [(3, a + x, a + z) for x, z in own]
    return sorted(out, key=lambda x: (x[1], x[0]))


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def labelled_of(table: DataFrame, most: int = MOST_EXAMPLES) -> dict[str, list[str]]:
    """Labelled examples from a table (format, example; format "" for ordinary words): of each format at most `most`, those
    of the smallest hashes. Null and empty examples are none; repeated ones count once."""
    rows = table.filter("format is not null and example <> ''").select("format", "example").distinct()
    by = Window.partitionBy("format").orderBy(F.xxhash64("example"), "example")
    out: dict[str, list[str]] = {}
    for r in rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= most).orderBy("format", "n").collect():
        out.setdefault(r["format"], []).append(r["example"])
    return out


def plain_words(text: str, formats: dict[str, Shape]) -> set[str]:
    """The distinct words of a text, without marks around them and without what could be a credential of the formats."""
    letters = _ALNUM.union(_WORDLY, *(x.letters for x in formats.values()))
    words = (w.strip(".,;:!?()[]'\"") for w in set(text.split()))
    return {w for w in words if w and letters.issuperset(w) and not any(x.may(w) for x in formats.values())}


def corpus_words(docs: DataFrame, formats: dict[str, Shape] | None = None) -> list[tuple[str, str, int]]:
    """Of all distinct plain words of all texts how many take each (state, symbol) of their automaton: rows of bounded number."""
    formats = shapes(labelled_credentials()) if formats is None else formats

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, sent = set(), set()
        for batch in slices(batches):
            every = {w for t in as_text(batch.column("text")) for w in t.split()}
            new = plain_words(" ".join(every - raw), formats) - sent
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], ["w"])
            if len(raw) > REMEMBERED:
                raw, sent = set(), set()
            raw |= every
            sent |= new

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            out.update(word_steps(batch.column("w").to_pylist()))
        rows = [(s, a, n) for (s, a), n in out.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["state", "symbol", "n"])

    distinct = docs.select("text").mapInArrow(words, "w string").distinct()
    got = distinct.mapInArrow(steps, "state string, symbol string, n long").groupBy("state", "symbol").agg(F.sum("n").alias("n")).orderBy("state", "symbol")
    return [tuple(r) for r in got.collect()]


def find_secrets(docs: DataFrame, labelled: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_spans and spans (kind:start:end by start, comma-joined) to `docs`.

    `labelled`: formats' examples, "" ordinary words, as a mapping or a table (format, example); default:
    labelled_credentials(). All distinct words of the documents are learnt from besides. A null or empty text has no
    spans. Rows are kept as they are, repeated ones alike, and so are other columns, whatever their names; columns of the
    added names are replaced. One scan counts the words, one finds the spans; an empty table gives an empty result.
    """
    labelled = dict(labelled_of(labelled) if isinstance(labelled, DataFrame) else labelled or labelled_credentials())
    labelled[""] = labelled.get("") or labelled_credentials()[""]
    formats = Formats(labelled, corpus_words(docs, shapes(labelled)))
    docs = without(docs, "n_assign", "n_access", "n_hex", "base_spans", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan_text(t, formats) for t in as_text(batch.column("text"))]
            counts = np.array([[sum(x[0] == k for x in own) for k in range(3)] for own in found], np.int64).reshape(-1, 3)
            columns = [*batch.columns, *(pa.array(counts[:, k]) for k in range(3)), pa.array([join_spans([x for x in own if x[0] < 3]) for own in found], pa.string()), pa.array([join_spans(own) for own in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return map_batches(docs, run, "n_assign long, n_access long, n_hex long, base_spans string, spans string")
