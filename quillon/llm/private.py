"""Personal data: e-mail addresses, network addresses, card and phone numbers.

Four patterns give the base spans. A linear-chain conditional random field adds what they miss:
addresses written around the patterns (``anna (at) post (dot) org``), numbers that a pattern has
swallowed together with their neighbours, national phone numbers. It sees tokens by their shape
and by a few cue words, never by what they say, and is trained by gradient steps on the
exact likelihood, from a small labelled table. Tokens are decoded by Viterbi in numpy, all
sequences of an Arrow batch at once. An added span must also look like its kind (``fits``).

A sequence is a stretch of tokens in which each is within ``REACH`` tokens of a mark: a digit, an
at sign, or the words "at" in brackets or "dot". All four kinds contain one, so what is farther
away is outside by definition. Whole texts are read, of any length.

Defined results: null and empty texts have no spans; ids may be null or repeated, each row is
judged alone; an empty table gives no rows; other columns don't take part. Spans of a kind never
overlap; where an added one would touch a base span of its kind, the base span stays alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- base ----------------------------------------------------------------------------------------
# The patterns, each tried only where a run of its characters begins and without giving
# characters back, so that they are linear in the text; results are those of the plain ones.

NAME = r"[A-Za-z0-9._%+-]"
HOST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_HERE = re.compile(rf"{NAME}++@{HOST}")
EMAIL = re.compile(rf"(?<!{NAME}){EMAIL_HERE.pattern}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_DIGIT = re.compile("[0-9]")


def digits_of(text: str) -> str:
    return "".join(ANY_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) << (at & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def byte_part(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or "0") <= 255


def card_number(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern; those that fail their test are dropped."""
    found: list[Span] = []
    if "@" in text:
        at = EMAIL.search(text)
        while at:
            found.append(("email", *at.span()))
            # A name may begin right where a match ends.
            at = EMAIL_HERE.match(text, at.end()) or EMAIL.search(text, at.end())
    if ANY_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(byte_part, m[0].split("."))):
                found.append(("ip", *m.span()))
        found += (("card", *m.span()) for m in CARD.finditer(text) if card_number(digits_of(m[0])))
        if "+" in text:
            found += (("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15)
    return found


# --- tokens and their shapes ---------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
MARK = re.compile(r"[0-9@]|[\[({]\s?at\b|\bdot\b", re.IGNORECASE)
REACH = 8
CUES = {
    "tel": "call", "phone": "call", "call": "call", "fax": "call", "mobile": "call",
    "card": "pay", "visa": "pay", "credit": "pay",
    "mail": "mail", "email": "mail",
    "ip": "net", "host": "net", "address": "net", "server": "net",
    "at": "at", "dot": "dot",
    "version": "number", "license": "number", "no": "number", "order": "number", "isbn": "number",
}
PUNCTUATION = ".,()[]{}@+-_/:%#*=\"'$&|!?;<>"
SHAPES = (
    "edge", "word", "Title", "UPPER", "mixed", "other",
    "call", "pay", "mail", "net", "at", "dot", "number",
    "byte1", "byte2", "byte3", "three", *(f"digits{n}" for n in range(4, 13)), "card", "long",
    *PUNCTUATION,
)
SHAPE = {name: i for i, name in enumerate(SHAPES)}
EDGE = 0
# Each shape twice: with a space before the token or without.
WIDTH = 2 * len(SHAPES)


@lru_cache(maxsize=1 << 16)
def shape(token: str) -> int:
    if token[0] in "0123456789":
        n = len(token)
        if n <= 3:
            name = ("byte1", "byte2", "byte3" if byte_part(token) else "three")[n - 1]
        elif n <= 12:
            name = f"digits{n}"
        else:
            name = "card" if card_number(token) else "long"
    elif token.lower() in CUES:
        name = CUES[token.lower()]
    elif token.isalpha():
        name = "word" if token.islower() else "UPPER" if token.isupper() else "Title" if token.istitle() else "mixed"
    else:
        name = token if token in SHAPE else "other"
    return SHAPE[name]


@dataclass
class Sequence:
    """Tokens near marks: shapes, and where each token starts and ends in the text."""

    shapes: list[int]
    starts: list[int]
    ends: list[int]


def sequences(text: str) -> list[Sequence]:
    if not MARK.search(text):
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    near = np.zeros(len(tokens) + 1, dtype=np.int32)
    starts = np.array([s for s, _ in tokens])
    for m in MARK.finditer(text):
        i = int(np.searchsorted(starts, m.start(), "right")) - 1
        near[max(0, i - REACH)] += 1
        near[min(len(tokens), i + REACH + 1)] -= 1
    inside = np.cumsum(near[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    found = []
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        part = tokens[first:last]
        shapes, end = [], tokens[first - 1][1] if first else -1
        for a, b in part:
            word = text[a:b] if b - a <= 64 else text[a : a + 64] + text[b - 1]
            shapes.append(2 * shape(word) + (a == end))
            end = b
        found.append(Sequence(shapes, [a for a, _ in part], [b for _, b in part]))
    return found


# --- the field -----------------------------------------------------------------------------------

TAGS = ("O", *(f"{b}-{kind}" for kind in KINDS for b in "BI"))
N_TAGS = len(TAGS)
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
NEVER = -1e4
# Places of a batch whose scores are held at a time.
SCORED = 1 << 16


def barred() -> np.ndarray:
    """An inside tag follows only a tag of its kind."""
    bar = np.zeros((N_TAGS, N_TAGS))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            for i, before in enumerate(TAGS):
                if before[2:] != tag[2:]:
                    bar[i, j] = NEVER
    return bar


FIRST = np.array([NEVER if tag[0] == "I" else 0.0 for tag in TAGS])


@dataclass
class Field:
    """Weights: of a shape at each offset, of a shape and the one before it, of tags in a row."""

    single: np.ndarray  # offset, shape, tag
    pair: np.ndarray  # shape before, shape, tag
    step: np.ndarray  # tag before, tag

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        """Sequence, position, tag; ``shapes`` has three columns of edges on either side."""
        n = shapes.shape[1] - 6
        out = sum(self.single[k][shapes[:, 3 + o : 3 + o + n]] for k, o in enumerate(OFFSETS))
        return out + self.pair[shapes[:, 2 : 2 + n], shapes[:, 3 : 3 + n]]


def padded(rows: list[list[int]]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows)) + 6), 2 * EDGE, dtype=np.int32)
    for i, row in enumerate(rows):
        out[i, 3 : 3 + len(row)] = row
    return out


def fit(rows: list[list[int]], tags: list[list[int]], *, rounds: int = 60, rate: float = 0.2, ridge: float = 2e-3) -> Field:
    """Adam on the exact negative log-likelihood, all sequences at once."""
    shapes, n = padded(rows), len(rows)
    lengths = np.array([len(r) for r in rows])
    longest = int(lengths.max())
    gold = np.zeros((n, longest), dtype=np.int64)
    for i, row in enumerate(tags):
        gold[i, : len(row)] = row
    live = np.arange(longest) < lengths[:, None]
    bar = barred()
    field = Field(
        np.zeros((len(OFFSETS), WIDTH, N_TAGS)), np.zeros((WIDTH, WIDTH, N_TAGS)), np.zeros((N_TAGS, N_TAGS))
    )
    weights = (field.single, field.pair, field.step)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    one = np.eye(N_TAGS)
    for turn in range(1, rounds + 1):
        scores = field.scores(shapes)
        scores[:, 0] += FIRST
        pull = np.exp(scores - scores.max(axis=2, keepdims=True))
        step = np.exp(field.step + bar)
        # Scaled forward and backward passes: each position's forward row sums to one.
        ahead, size = np.empty_like(pull), np.ones((n, longest, 1))
        for t in range(longest):
            row = pull[:, t] * (ahead[:, t - 1] @ step) if t else pull[:, 0]
            size[:, t] = row.sum(axis=1, keepdims=True)
            ahead[:, t] = row / size[:, t]
        behind = np.ones_like(pull)
        for t in range(longest - 2, -1, -1):
            come = (pull[:, t + 1] * behind[:, t + 1] / size[:, t + 1]) @ step.T
            behind[:, t] = np.where(live[:, t + 1, None], come, 1.0)
        wrong = np.where(live[:, :, None], ahead * behind - one[gold], 0.0) / n
        single, pair, between = (np.zeros_like(w) for w in weights)
        for k, o in enumerate(OFFSETS):
            np.add.at(single[k], shapes[:, 3 + o : 3 + o + longest], wrong)
        np.add.at(pair, (shapes[:, 2 : 2 + longest], shapes[:, 3 : 3 + longest]), wrong)
        for t in range(1, longest):
            on = live[:, t]
            right = pull[on, t] * behind[on, t] / size[on, t]
            between += (ahead[on, t - 1].T @ right) * step / n
            np.add.at(between, (gold[on, t - 1], gold[on, t]), -1.0 / n)
        for weight, slope, (m, v) in zip(weights, (single, pair, between), moments, strict=True):
            slope = slope + ridge * weight / n
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            weight -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    field.step += bar
    return field


def decode(field: Field, rows: list[list[int]], step_rows: int = 4096) -> list[np.ndarray]:
    """The best tags of each sequence: Viterbi over sequences sorted by length, a step for all."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    found: list[np.ndarray] = [None] * len(rows)
    for at in range(0, len(order), step_rows):
        some = order[at : at + step_rows]
        lengths = np.array([len(rows[i]) for i in some])
        shapes = padded([rows[i] for i in some])
        longest = int(lengths[0])
        back = np.zeros((longest, len(some), N_TAGS), dtype=np.int8)
        best = np.zeros((len(some), N_TAGS))
        ahead = max(1, SCORED // len(some))
        for t in range(longest):
            on = int(np.searchsorted(-lengths, -t, "left"))
            if t % ahead == 0:
                scores = field.scores(shapes[:on, t : t + ahead + 6])
            score = scores[:on, t % ahead]
            if t == 0:
                best[:on] = score + FIRST
            else:
                ways = best[:on, :, None] + field.step
                came = ways.argmax(axis=1)
                back[t, :on] = came
                best[:on] = np.take_along_axis(ways, came[:, None], 1)[:, 0] + score
        tag = best.argmax(axis=1)
        tags = np.zeros((len(some), longest), dtype=np.int8)
        for t in range(longest - 1, -1, -1):
            on = int(np.searchsorted(-lengths, -t, "left"))
            tags[:on, t] = tag[:on]
            tag[:on] = back[t, np.arange(on), tag[:on]]
        for k, i in enumerate(some):
            found[i] = tags[k, : lengths[k]]
    return found


# --- what an added span must look like -----------------------------------------------------------

AT = r"\s?(?:@|[\[({]\s?(?:at|@)\s?[\])}])\s?"
DOT = r"\s?(?:\.|[\[({]\s?(?:dot|\.)\s?[\])}])\s?|\s+dot\s+"
WRITTEN_EMAIL = re.compile(rf"{NAME}+(?:{AT}[A-Za-z0-9-]+(?:(?:{DOT})[A-Za-z0-9-]+)+|\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+)", re.IGNORECASE)
WRITTEN_IP = re.compile(rf"[0-9]+(?:(?:{DOT})[0-9]+){{3}}", re.IGNORECASE)
WRITTEN_CARD = re.compile(r"[0-9](?:\s?[./_–-]?\s?[0-9])+")
WRITTEN_PHONE = re.compile(r"(?:\+|00|\(|0)?[ ().0-9/–-]*[0-9]")


def fits(kind: str, text: str) -> bool:
    digits = digits_of(text)
    if kind == "email":
        return bool(WRITTEN_EMAIL.fullmatch(text))
    if kind == "ip":
        return bool(WRITTEN_IP.fullmatch(text)) and all(map(byte_part, re.findall("[0-9]+", text)))
    if kind == "card":
        return bool(WRITTEN_CARD.fullmatch(text)) and card_number(digits)
    # A bare run of digits is no phone number without a sign that it is one.
    return (
        bool(WRITTEN_PHONE.fullmatch(text)) and 9 <= len(digits) <= 15 and not text.isdigit()
        and text.count("(") == text.count(")")
    )


def spans_of_tags(sequence: Sequence, tags: np.ndarray) -> Iterator[Span]:
    start = None
    for i, tag in enumerate([*tags.tolist(), 0]):
        name = TAGS[tag]
        if start is not None and name[0] != "I":
            yield TAGS[tags[start]][2:], sequence.starts[start], sequence.ends[i - 1]
            start = None
        if name[0] == "B":
            start = i


def all_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text; added ones are decoded together."""
    found = [(base_spans(t), []) for t in texts]
    cut = [(i, s) for i, t in enumerate(texts) for s in sequences(t)]
    for (i, sequence), tags in zip(cut, decode(field, [s.shapes for _, s in cut]), strict=True):
        base, added = found[i]
        for kind, start, end in spans_of_tags(sequence, tags):
            apart = all(k != kind or end <= s or e <= start for k, s, e in base)
            if apart and fits(kind, texts[i][start:end]):
                added.append((kind, start, end))
    return found


# --- the labelled table --------------------------------------------------------------------------
# Sentences with one or two values each; values and surrounding words are drawn by a seed. Fixed
# values: the forms in which values are written, and sentences around them.

FORMS = {
    "email": (
        "{u}@{h}.{t}", "{u}.{n}@{h}.example.{t}", "{u} (at) {h} (dot) {t}", "{u} [at] {h}.{t}",
        "{u}(at){h}.{t}", "{u} at {h} dot {t}", "{u} @ {h} . {t}", "{u} [at] {h} [dot] {t}", "{u}.{u} (at) {h}.{t}",
    ),
    "ip": ("{b}.{b}.{b}.{b}", "{b}.{b}.{b}.{b}", "{b}[.]{b}[.]{b}[.]{b}", "{b} . {b} . {b} . {b}", "{b}(dot){b}(dot){b}(dot){b}"),
    "card": ("{c}", "{c}", "{c4: }", "{c4:-}", "{c4:.}", "{c4:/}"),
    "phone": (
        "+1 ({3}) {3}-{4}", "+1 ({3}) {3}-{4}", "+{2} {2} {4} {4}", "+{2}-{3}-{3}-{3}", "({3}) {3}-{4}", "({3}) {3} {4}",
        "{3}-{3}-{4}", "{3}.{3}.{4}", "0{2}/{4}{3}", "00{2} {3} {3} {4}",
    ),
}
AROUND = (
    "{w} {w} {w} {v} {w} {w} {w}", "{w} {w}, {W}. {v} {w}, {w}", "{w} {w}.\n{v}\n{W} {w}", "{W} | {w} | {v} | {w} {w}",
    "{w}!! {w}!! {v}!! {w}!!", "{w}*** {w}### {v}%%% {w}$$$ {w}", "mail {v} or call {v}", "{w} tel: {v}, {w}",
    "{w} card {v} {w}", "{w} host {v} {w}", "{w} {w} {v} {v} {w} {w}", "{w} {v}, {v} {w}",
    "{W} {v} {v}", "{w} {w} {v} {v} {v} {w}", "{v} {v} {w}", "{w} {v} {v}. {W}", "{w}\n{v} {v}\n{w}", "{w} {l} {v} {w}", "{w} {v} {l} {w}", "{w} {w} {v}.", "({v}) {w} {w}",
    '{W} {w} {w} token = "{x}" {v} {w}', "{v} {w} {w} {W}",
)
NOTHING = (
    "{w}.\nLicensed under CC BY-NC 4.0.", "{W} the Apache License, Version 2.0.", "the GNU General Public License, version 3.",
    '{w} token = "{x}" {w}', "{w} {l} {w} {w}", "{w} {l} {l} {w}", "{w} {w} {4}-{2}-{2} {w}", "{w} {2}.{2}.{4} {w}", "{w} {2}:{2} {w} {W}",
    "{w} $ {3}.{2} {w}", "{w} {1},{3},{3} {w}", "order no {4}{3} {w}", "chapter {1}.{1}.{1} {w} {w}", "v{1}.{2}.{1} {w}",
    "isbn {3}-{1}-{2}-{4}{2}-{1} {w}", "{w} at {w} {w} dot {W}. {w}", "{W} at {w}. {w} {2} {w}", "{w} @ {w} {w} {w}", "{w} {2} {w} {3} {w} {1}",
    "{w} (at {w}) {w}", "{w} {3} {3} {w}", "{w} {4}-{4} {w}", "{w} #{4} ({2}) {w}", "{w} {1}.{1} {w} {4}.", "@{w} {w} {w}",
)


class Drawn:
    """Values and words by a seed."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        plain = lambda: self.word().replace("é", "e").replace("ü", "u")
        self.values = {
            "w": self.word,
            "W": lambda: self.word().title(),
            "u": plain,
            "h": lambda: self.rng.choice([plain(), f"mail{self.number(1)}"]),
            "n": lambda: self.number(2),
            "t": lambda: self.rng.choice(["com", "org", "net", "de"]),
            "b": lambda: str(self.rng.randint(0, 255)),
            "c": lambda: self.card(True),
            "l": lambda: self.card(False),
            "x": lambda: "".join(self.rng.choice("0123456789abcdef") for _ in range(40)),
        }

    def word(self) -> str:
        pick = self.rng.choice
        return "".join(pick("bcdfghlmnprstvz") + pick("aeiouéü") for _ in range(self.rng.randint(1, 4))) + pick(["", "n", "r", "s", "th"])

    def number(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def card(self, good: bool) -> str:
        start = self.rng.choice("23456789") + self.number(14)
        check = next(d for d in range(10) if luhn(f"{start}{d}"))
        return start + str(check if good else (check + self.rng.randint(1, 9)) % 10)

    def filled(self, form: str) -> str:
        def one(m: re.Match) -> str:
            code = m[1]
            if code.isdigit():
                return self.number(int(code))
            if code.startswith("c4"):
                number = self.card(True)
                return code[3].join(number[i : i + 4] for i in range(0, 16, 4))
            return self.values[code]()

        return re.sub(r"\{([^{}]+)\}", one, form)


def examples(seed: int = 13, times: int = 24) -> list[tuple[str, list[Span]]]:
    """The labelled table: (text, spans), ``times`` rows for each sentence."""
    drawn, rows = Drawn(seed), []
    for around in (*AROUND, *NOTHING):
        for _ in range(times if around in AROUND else max(1, times // 2)):
            text, spans = "", []
            for part in re.split(r"(\{v\})", around):
                if part == "{v}":
                    kind = drawn.rng.choice(KINDS)
                    value = drawn.filled(drawn.rng.choice(FORMS[kind]))
                    spans.append((kind, len(text), len(text) + len(value)))
                    text += value
                else:
                    text += drawn.filled(part)
            rows.append((text, spans))
    return rows


def train(labelled: list[tuple[str, list[Span]]], **how) -> Field:
    """``labelled`` is a small table: at most some thousand short texts with their spans."""
    rows, tags = [], []
    for text, spans in labelled:
        for sequence in sequences(text):
            row = [0] * len(sequence.shapes)
            for kind, start, end in spans:
                inside = [i for i, at in enumerate(sequence.starts) if start <= at < end]
                for k, i in enumerate(inside):
                    row[i] = TAGS.index(("I-" if k else "B-") + kind)
            rows.append(sequence.shapes)
            tags.append(row)
    return fit(rows, tags, **how)


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(examples())


# --- the operator --------------------------------------------------------------------------------


def ordered(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


FOUND = (
    "doc_id {}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string, n_added bigint"
)


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Per row: base counts, a digest of the base spans, all spans, and how many were added."""
    model = field or trained()
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    declared = FOUND.format(rows.schema[0].dataType.simpleString())

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [t or "" for t in some.column(1).to_pylist()]
                made = []
                for base, added in all_spans(model, texts):
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    digest = hashlib.sha256(ordered(base).encode()).hexdigest()
                    made.append((*counts, digest, ordered(base + added), len(added)))
                columns = [pa.array(c) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *columns], names=[f.split()[0] for f in FOUND.split(", ")]
                )

    return rows.mapInArrow(body, declared)
