"""Personal data in texts: patterns, and a linear-chain conditional random field for what they miss.

The patterns find emails, addresses of machines, payment cards and phone numbers in their standard forms.  The random field
reads the words around digits, at signs and bracketed stand-ins for them, as a sequence of word shapes with the labels
begin, inside and outside of each kind.  It is trained on the labelled lines below, decoded by Viterbi for many sequences
at a time, and adds what passes the same checks (number of digits, parts, check digit) and overlaps no pattern's match.

A sequence is a stretch of text in which no more than ``2 * AROUND`` words lie between two that hold a digit, an at sign or an opening
bracket; elsewhere nothing can be labelled, because every kind needs one of these.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
AROUND = 3
#: Sequences decoded at once, and tokens of each whose scores are held at once; longer sequences go on from the scores before.
_LANES = 512
_LONGEST = 2048

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number is tried from its first digit only, and never given back in part: both change no match and keep long ones linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@\[({]\S*")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")

#: Lines to train on: ``<kind text>`` marks a span, ``#`` stands for any digit.  Written for this purpose.
LABELLED = (
    "call <phone (###) ###-####> after six", "her number is <phone ###-###-####>, ask for her", "tel. <phone ### ### ####>",
    "phone: <phone (###) ###-####>", "reach me on <phone ###.###.####> today", "mobile <phone 0#### ######> or office",
    "fax <phone +# (###) ###-####> <ip ##.###.##.##> seen", "by phone <phone +# (###) ###-####> <ip ###.###.###.##> at night",
    "ring <phone +## ## #### ####> <card ################> please", "my cell <phone ### ###-####>.", "<phone (###) ###-####>",
    "contact <phone +# (###) ###-####> <card ################>", "number <phone +#-###-###-####> <ip ###.##.##.###> end",
    "write to <email anna.lee [at] example [dot] org> soon", "mail <email bob(at)example(dot)com> now", "<email info [at] mail#.example.com>",
    "ask <email j.doe##(at)example.net> for it", "e-mail: <email sam_k {at} example {dot} org>", "send it to <email max [at] example.com>, thanks",
    "from <email eve @ example.com> yesterday", "<email lou## @ mail#.example.org> wrote", "at <email tim(at)mail.example(dot)com>.",
    "host <ip ### . ## . ### . #> went down", "server <ip ##.##.###.##>:8080 answered", "from <ip ###.###.##.###> to <ip ##.#.#.###>",
    "ip <ip ###-##-##-###> blocked", "seen at <ip ##[.]###[.]##[.]###> twice", "<ip ###[.]##[.]#[.]##>",
    "card <card ####.####.####.####> was charged", "paid with <card ####/####/####/####> online", "visa <card ####_####_####_####>",
    "amex <card ####.######.#####> expired", "the card <card ####.####.####.####>, the last one",
    "on ##.##.#### we met", "since ####-##-## it rained", "at ##:##:## on ##/##/####", "from #### to ####", "pages ###-### and ###",
    "version #.## was late", "Version #.#.#, of ####", "CC BY-NC #.#.", "token = \"##be##cd####ef##ab####cd##ef##ab##cd##\"", "chapter #, part ##",
    "it cost $#,###.## in all", "### people and #### more", "about ##.#% of ###", "the year ####, or so", "order ######## was sent", "id ##########, row ##",
    "isbn ###-#-##-######-#", "ratio #:# or #.#", "section #.#.#.# [#] of the manual", "(see [##], p. ###)", "[##] and [#], (a) or (b)", "room ###, floor ##",
    "x{n} = (####)", "#### - ####", "##### ####", "list: #. one #. two #. three", "error 0x##af at line ###", "###,###,### bytes in ##.## s",
    "follow @ann on the site", "cost @ ## each", "f(x) = # (at least)", "he said [at length] it was ####", "key: ab##cd##-##ef-##ab-##cd-##ef##ab##cd##",
    "<phone ###-####> is short", "temperature -##.# at ####", "score ##-## ( ##-## )", "see http://example.com/##/####", "#" * 24 + " is a serial", "no. ############",
)
_COPIES = 4
_CUES = frozenset("at dot phone tel call fax mobile cell number mail email ip host server card visa amex version isbn id order page pages".split())
_MARKS = frozenset("@.-()[]{}+/_:,#$%=\"'")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches that pass their checks, by start and kind."""
    found: list[tuple[int, int, int]] = []
    at, low = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > low and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        low = domain.end() if domain else at + 1
        if domain:
            found.append((begin, 0, low))
        at = text.find("@", low)
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


@functools.lru_cache(1 << 16)
def _shape(token: str, spaced: bool) -> str:
    lead = "_" if spaced else ""
    if "0" <= token[0] <= "9":
        n = len(token)
        return f"{lead}d{n if n < 5 else '5' if n < 7 else '7' if n < 10 else '10' if n < 13 else '13' if n < 20 else '20'}"
    if token[0].isalpha():
        if token.lower() in _CUES:
            return lead + "w:" + token.lower()
        return f"{lead}{'A' if token[0].isupper() else 'a'}{min(len(token), 3)}"
    return lead + (token if token in _MARKS else "?")


def _tokens(text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
    """``(start, end, shape)`` of the tokens."""
    return [
        (m.start(), m.end(), _shape(m.group(), m.start() == 0 or text[m.start() - 1].isspace()))
        for m in _TOKEN.finditer(text, begin, end)]


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where to look: hot words with ``AROUND`` words on either side, joined where they meet."""
    begin = end = -1
    for m in _HOT.finditer(text):
        left = m.start()
        for _ in range(AROUND + 1):  # the first step reaches the start of the word itself
            cut = _space_before(text, left)
            left = cut + 1
            if cut < 0 or left <= end:
                break
            left = cut
        left = max(left, 0)
        right = m.end()
        for _ in range(AROUND):
            while right < len(text) and text[right].isspace():
                right += 1
            while right < len(text) and not text[right].isspace():
                right += 1
        if begin < 0:
            begin, end = left, right
        elif left <= end:
            end = max(end, right)
        else:
            yield begin, end
            begin, end = left, right
    if begin >= 0:
        yield begin, end


def _space_before(text: str, at: int) -> int:
    """The last white space before ``at`` that ends a word, or -1."""
    at -= 1
    while at >= 0 and text[at].isspace():
        at -= 1
    while at >= 0 and not text[at].isspace():
        at -= 1
    return at


_LABELS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


@dataclass
class Field:
    """Weights: ``near[k]`` for the shape ``k - 2`` places on, ``left`` and ``right`` for pairs, ``step`` between labels."""

    shapes: dict[str, int]
    near: np.ndarray
    left: np.ndarray
    right: np.ndarray
    step: np.ndarray

    def numbers(self, sequences: list[list[str]]) -> np.ndarray:
        """Shapes as numbers, with two empty places on either side; 0 is empty or never seen."""
        long = max(map(len, sequences))
        out = np.zeros((len(sequences), long + 4), dtype=np.int64)
        for i, s in enumerate(sequences):
            out[i, 2:2 + len(s)] = [self.shapes.get(x, 0) for x in s]
        return out

    def emissions(self, n: np.ndarray) -> np.ndarray:
        t = n.shape[1] - 4
        out = self.left[n[:, 1:1 + t], n[:, 2:2 + t]] + self.right[n[:, 2:2 + t], n[:, 3:3 + t]]
        for k in range(5):
            out = out + self.near[k, n[:, k:k + t]]
        return out

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sequence."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if sequences[i]), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < min(len(order), at + _LANES) and (stop + 1 - at) * len(sequences[order[stop]]) <= _LANES * _LONGEST:
                stop += 1
            lanes, at = order[at:stop], stop
            size = np.array([len(sequences[i]) for i in lanes])
            n, long = self.numbers([sequences[i] for i in lanes]), int(size.max())
            back = np.zeros((len(lanes), long, self.step.shape[0]), dtype=np.int8)
            for begin in range(0, long, _LONGEST):
                score = self.emissions(n[:, begin:begin + _LONGEST + 4])
                for t in range(begin, begin + score.shape[1]):
                    if not t:
                        best = score[:, 0].copy()
                        best[:, 2::2] = -1e9  # nothing starts inside a span
                        continue
                    ways = best[:, :, None] + self.step[None]
                    back[:, t] = ways.argmax(axis=1)
                    after = ways.max(axis=1) + score[:, t - begin]
                    best = np.where((t < size)[:, None], after, best)
            label = np.zeros((len(lanes), long), dtype=np.int64)
            now = best.argmax(axis=1)
            rows = np.arange(len(lanes))
            for t in range(long - 1, -1, -1):
                inside = t < size
                label[:, t] = np.where(inside, now, 0)
                now = np.where(inside & (t > 0), back[rows, t, now], now)
            for k, i in enumerate(lanes):
                out[i] = label[k, :size[k]]
        return out


def _examples(seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The labelled lines with random digits: shapes and labels."""
    rng = np.random.default_rng(seed)
    out = []
    for line in LABELLED * _COPIES:
        parts = re.split(r"(<\w+ [^>]*>)", line)
        text, spans = "", []
        for part in parts:
            kind, mark = 0, re.fullmatch(r"<(\w+) ([^>]*)>", part)
            if mark:
                kind, part = KINDS.index(mark[1]) + 1, mark[2]
            part = "".join(str(rng.integers(0, 10)) if c == "#" else c for c in part)
            if kind:
                spans.append((len(text), len(text) + len(part), kind))
            text += part
        tokens, labels = _tokens(text, 0, len(text)), []
        for begin, end, _ in tokens:
            kind = next((k for a, b, k in spans if a <= begin and end <= b), 0)
            first = any(a == begin for a, _, _ in spans)
            labels.append(0 if not kind else 2 * kind - 1 if first else 2 * kind)
        out.append(([t[2] for t in tokens], labels))
    return out


@functools.cache
def train(rounds: int = 80, rate: float = 0.1, penalty: float = 2e-3) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam on all labelled lines at once."""
    examples = _examples()
    shapes = {s: i + 1 for i, s in enumerate(sorted({x for e, _ in examples for x in e}))}
    n, y = len(shapes) + 1, _LABELS
    weights = {"near": np.zeros((5, n, y)), "left": np.zeros((n, n, y)), "right": np.zeros((n, n, y)), "step": np.zeros((y, y))}
    forbidden = np.zeros((y, y))
    for b in range(2, y, 2):  # inside follows begin or inside of its kind only
        forbidden[:, b] = -1e9
        forbidden[b - 1, b] = forbidden[b, b] = 0
    field = Field(shapes, *(weights[k] for k in ("near", "left", "right", "step")))
    ids = field.numbers([e for e, _ in examples])
    long = ids.shape[1] - 4
    size = np.array([len(e) for e, _ in examples])
    gold = np.zeros((len(examples), long), dtype=np.int64)
    for i, (_, labels) in enumerate(examples):
        gold[i, :len(labels)] = labels
    real = np.arange(long)[None] < size[:, None]
    first = {k: np.zeros_like(w) for k, w in weights.items()}
    second = {k: np.zeros_like(w) for k, w in weights.items()}
    rows = np.arange(len(examples))

    def spread(score: np.ndarray, axis: int) -> np.ndarray:
        top = score.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(score - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for turn in range(1, rounds + 1):
        score = field.emissions(ids)
        step = weights["step"] + forbidden
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        ahead[:, 0, 2::2] = -1e9
        for t in range(1, long):
            ahead[:, t] = spread(ahead[:, t - 1, :, None] + step, 1) + score[:, t]
        for t in range(long - 2, -1, -1):
            after = spread(step[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t + 1 < size)[:, None], after, 0)
        whole = spread(ahead[rows, size - 1], 1)
        chance = np.exp(np.minimum(ahead + behind - whole[:, None, None], 0)) * real[:, :, None]
        miss = -chance
        miss[rows[:, None], np.arange(long)[None], gold] += real
        grad = {k: np.zeros_like(w) for k, w in weights.items()}
        for k in range(5):
            np.add.at(grad["near"][k], ids[:, k:k + long], miss)
        np.add.at(grad["left"], (ids[:, 1:1 + long], ids[:, 2:2 + long]), miss)
        np.add.at(grad["right"], (ids[:, 2:2 + long], ids[:, 3:3 + long]), miss)
        for t in range(1, long):
            both = ahead[:, t - 1, :, None] + step + (score[:, t] + behind[:, t])[:, None, :] - whole[:, None, None]
            grad["step"] -= (np.exp(np.minimum(both, 0)) * (t < size)[:, None, None]).sum(axis=0)
            inside = t < size
            np.add.at(grad["step"], (gold[inside, t - 1], gold[inside, t]), 1)
        for k, w in weights.items():
            g = grad[k] / len(examples) - penalty * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w += rate * (first[k] / (1 - 0.9 ** turn)) / (np.sqrt(second[k] / (1 - 0.999 ** turn)) + 1e-8)
    field.step = weights["step"] + forbidden
    return field


def _holds(kind: int, text: str) -> bool:
    """The checks that a span of the random field has to pass."""
    digits = re.sub("[^0-9]", "", text)
    if kind == 0:
        return len(text) >= 6 and ("@" in text or re.search(r"[\[({]\s?at\s?[\])}]", text) is not None) and (
            "." in text or re.search(r"[\[({]\s?dot\s?[\])}]", text) is not None)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(map(_small, parts))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """What the random field finds in each text beside its base spans."""
    owner, tokens = [], []
    for i, text in enumerate(texts):
        for begin, end in stretches(text):
            owner.append(i)
            tokens.append(_tokens(text, begin, end))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, found, labels in zip(owner, tokens, field.decode([[t[2] for t in f] for f in tokens])):
        at = 0
        while at < len(found):
            if labels[at] % 2 == 0:
                at += 1
                continue
            stop = at + 1
            while stop < len(found) and labels[stop] == labels[at] + 1:
                stop += 1
            span = found[at][0], (int(labels[at]) - 1) // 2, found[stop - 1][1]
            if _holds(span[1], texts[i][span[0]:span[2]]):
                out[i].append(span)
            at = stop
    for i, spans in enumerate(out):
        if spans and base[i]:
            starts = [b[0] for b in base[i]]
            ends = list(accumulate((b[2] for b in base[i]), max))  # the furthest end so far
            out[i] = [s for s in spans if not (n := bisect_left(starts, s[2])) or ends[n - 1] <= s[0]]
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    The counts and the hash are of the patterns' spans; ``spans`` has those of the random field as well.  Offsets are code
    points, ends are exclusive; order is by start, then kind.  A null text is empty.  Texts are read one by one, whole, so that repeated rows
    give equal rows; extra columns are ignored; an empty table gives no rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, box.value)
            out = {"doc_id": batch["doc_id"]}
            for k, name in enumerate(KINDS):
                out[f"n_{name}"] = [sum(s[1] == k for s in b) for b in base]
            out["base_sha256"] = [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]
            out["spans"] = [_listed(sorted(b + a)) for b, a in zip(base, added)]
            out["n_added"] = [len(a) for a in added]
            yield pd.DataFrame(out)

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
