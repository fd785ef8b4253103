"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Around every sign that personal data needs (a digit,
`@` or `=`), the tokens of a text make a region; a semi-Markov CRF segments it. Features belong to whole candidate segments
(shape, digits, length, checks such as Luhn or octets, key words before or inside), segments of an entity have at most
MAX_TOKENS tokens, and dynamic programming chooses boundaries and types of all segments of the region together. Spans of the
field that overlap no base span are added, of kinds email, ip, card, phone and secret (passwords, keys, tokens).

The field is trained here, by gradient steps on the exact log likelihood, on sentences made from a rule with a fixed seed.

Text without any such sign has no region; otherwise every region of the whole text is segmented, however long the text.
All patterns are matched in time linear in the text. Offsets are code points, ends exclusive.

Defined cases: null is empty text: no spans, the hash of the empty string. Repeated rows give repeated results; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .support import fields, id_type, map_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_TOKENS = 5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HEX = re.compile(r"[0-9a-fA-F]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str) -> Iterator[Span]:
    """Every match holds one `@`: the longest local part before it, not before the last match's end, and a dotted domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, 0, found.end()
            last = found.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))


def ips(text: str) -> Iterator[Span]:
    """Runs of digits joined by single dots, four at a time."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, 1, at + size
            at += size + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), 2, m.end()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
            yield m.start(), 3, m.end()


def base_spans(text: str) -> list[Span]:
    out = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [*ips(text), *cards(text), *(phones(text) if "+" in text else ())]
    return sorted(out)


# --- the field


_SIGN = re.compile(r"[0-9@=]")
_SPACE = re.compile(r"\s")
_TOKEN = re.compile(r"\S+")
_TRIM_LEFT, _TRIM_RIGHT = "\"'`([{<,;:.", "\"'`)]}>,;:.!?"


def regions(text: str, room: int = 3) -> Iterator[list[tuple[int, int]]]:
    """Tokens (start, end) of the stretches around signs, with `room` tokens before and 2 after, merged where they meet."""
    spots: list[tuple[int, int]] = []  # tokens with a sign
    end = -1
    for m in _SIGN.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and start > 0 and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.start())
        end = stop.start() if stop else len(text)
        spots.append((start, end))
    group: list[tuple[int, int]] = []
    done = 0
    for k, (start, end) in enumerate(spots):
        if not group:
            group = _before(text, start, room, done)
        group.append((start, end))
        after = _after(text, end, room + 2, spots[k + 1][0] if k + 1 < len(spots) else len(text))
        if k + 1 < len(spots) and not text[after[-1][1] if after else end : spots[k + 1][0]].strip():
            group += after
            continue
        group += after[:2]
        done = group[-1][1]
        yield group
        group = []


def _before(text: str, at: int, n: int, least: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    while len(out) < n:
        end = at
        while end > least and text[end - 1].isspace():
            end -= 1
        start = end
        while start > least and not text[start - 1].isspace():
            start -= 1
        if start == end:
            break
        out.append((start, end))
        at = start
    return out[::-1]


def _after(text: str, at: int, n: int, most: int) -> list[tuple[int, int]]:
    out = []
    for m in _TOKEN.finditer(text, at, most):
        out.append(m.span())
        if len(out) == n:
            break
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _TRIM_LEFT:
        start += 1
    while end > start and text[end - 1] in _TRIM_RIGHT:
        end -= 1
    return start, end


def _class(c: str) -> str:
    return "0" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if c.isalpha() else c


_RUNS = re.compile(r"([0-9]+)|([A-Z]+)|([^\W\d_A-Z]+)|(.)\4*", re.DOTALL)


def shape(span: str) -> str:
    """The kinds of a span's runs of equal kind, all of it; of a span of more than 20 runs, which kinds there are."""
    runs = ["0" if m.group(1) else "A" if m.group(2) else "a" if m.group(3) else m.group(4) for m in _RUNS.finditer(span)]
    return "".join(runs) if len(runs) <= 20 else f"many {''.join(sorted(set(runs)))[:8]}"


def segment_features(text: str, tokens: list[tuple[int, int]], a: int, b: int) -> list[str]:
    """Names of the features of the segment of tokens a to b (exclusive) as a whole."""
    start, end = trimmed(text, tokens[a][0], tokens[b - 1][1])
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    key, sign, value = span.partition("=")
    before = text[slice(*tokens[a - 1])].lower().strip(_TRIM_LEFT + _TRIM_RIGHT) if a else "^"
    out = [f"n={b - a}", f"shape={shape(span)}", f"digits={min(len(digits), 20)}", f"long={min(6, (end - start) // 8)}", f"before={before if before in _CUES else _class(before[:1]) if before else '-'}"]
    if digits and len(digits) == len(span.replace(" ", "").replace("-", "")):
        out.append(f"number;luhn={luhn(digits)};n={13 < len(digits) < 20}")
    if span.count(".") == 3 and all(p.isdigit() and p.isascii() and _octet(p) for p in span.split(".")):
        out.append("octets")
    if "@" in span and _DOMAIN.fullmatch(span.rpartition("@")[2]):
        out.append("address")
    if span.startswith("+") and 10 <= len(digits) <= 15:
        out.append("dialled")
    if sign:
        out.append(f"key={key.lower() if key.lower() in _CUES else '?'};value={len(value) >= 6}")
    core = value if sign else span
    if len(core) >= 12 and core.isascii() and core.isalnum() and digits and len(digits) < len(core):
        out.append(f"mixed;hex={_HEX.fullmatch(core) is not None};upper={core.isupper()};len={min(5, len(core) // 8)}")
    return out


_CUES = frozenset("password passwd pwd secret token key api_key apikey access_key auth bearer = : card phone tel ip host mail email pin version page chapter year".split())
_OTHER = len(KINDS)  # the type of a single token that belongs to no entity


class Field:
    """Semi-Markov CRF: weights of (type, segment feature) and of (type, next type)."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.follow = np.zeros((_OTHER + 2, _OTHER + 1))  # the last row: at the start

    def _score(self, text: str, tokens: list[tuple[int, int]], a: int, b: int) -> tuple[list[str], np.ndarray]:
        names = segment_features(text, tokens, a, b)
        score = np.zeros(_OTHER + 1)
        for n in names:
            if (w := self.weights.get(n)) is not None:
                score += w
        if b - a > 1:
            score[_OTHER] = -1e9
        return names, score

    def _lattice(self, text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[list[str], np.ndarray]]:
        n = len(tokens)
        return {(a, b): self._score(text, tokens, a, b) for a in range(n) for b in range(a + 1, min(n, a + MAX_TOKENS) + 1)}

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, last + 1, type) of the entities."""
        n = len(tokens)
        best = np.full((n + 1, _OTHER + 2), -1e18)
        best[0, _OTHER + 1] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for b in range(1, n + 1):
            for a in range(max(0, b - MAX_TOKENS), b):
                arrive = best[a][:, None] + self.follow
                source = arrive.argmax(axis=0)
                value = arrive[source, np.arange(_OTHER + 1)] + self._score(text, tokens, a, b)[1]
                for t in np.flatnonzero(value > best[b, : _OTHER + 1]).tolist():
                    best[b, t] = value[t]
                    back[b, t] = a, int(source[t])
        out = []
        b, t = n, int(best[n, : _OTHER + 1].argmax())
        while b > 0:
            a, before = back[b, t]
            if t != _OTHER:
                out.append((a, b, t))
            b, t = a, before
        return out[::-1]

    def step(self, text: str, tokens: list[tuple[int, int]], gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log likelihood of gold (segments that cover all tokens)."""
        n = len(tokens)
        lattice = self._lattice(text, tokens)
        alpha = np.full((n + 1, _OTHER + 2), -np.inf)
        alpha[0, _OTHER + 1] = 0.0
        for b in range(1, n + 1):
            parts = [np.logaddexp.reduce(alpha[a][:, None] + self.follow, axis=0) + lattice[a, b][1] for a in range(max(0, b - MAX_TOKENS), b)]
            alpha[b, : _OTHER + 1] = np.logaddexp.reduce(parts, axis=0)
        beta = np.full((n + 1, _OTHER + 2), -np.inf)
        beta[n, : _OTHER + 1] = 0.0
        for a in range(n - 1, -1, -1):
            parts = [np.logaddexp.reduce(self.follow + (lattice[a, b][1] + beta[b, : _OTHER + 1])[None, :], axis=1) for b in range(a + 1, min(n, a + MAX_TOKENS) + 1)]
            beta[a] = np.logaddexp.reduce(parts, axis=0)
        total = beta[0, _OTHER + 1]
        truth = {(a, b): t for a, b, t in gold}
        gradient: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(_OTHER + 1))
        follow = np.zeros_like(self.follow)
        for (a, b), (names, score) in lattice.items():
            joint = alpha[a][:, None] + self.follow + (score + beta[b, : _OTHER + 1])[None, :] - total
            joint = np.exp(np.minimum(joint, 0.0))
            follow -= joint
            expected = joint.sum(axis=0)
            if (a, b) in truth:
                expected[truth[a, b]] -= 1.0
            if np.abs(expected).max() > 1e-4:
                for name in names:
                    gradient[name] -= expected
        before = _OTHER + 1
        for _, _, t in gold:
            follow[before, t] += 1
            before = t
        for name, g in gradient.items():
            self.weights[name] = self.weights.get(name, 0.0) + rate * g
        self.follow += rate * follow


def training_sentences(count: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]]:
    """(text, tokens, segments) made from a rule: invented words around entities and around numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ter", "en", "sou", "is", "a")) for _ in range(rng.randint(1, 3))) + rng.choice(("", "", "", ",", "."))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(3, 8)))

    def card(good: bool) -> str:
        head = rng.choice("3456") + digits(rng.choice((13, 14, 14, 14)))
        own = head + next(d for d in "0123456789" if luhn(head + d) == good)
        return own if rng.random() < 0.5 or len(own) != 16 else rng.choice(" -").join(own[k : k + 4] for k in (0, 4, 8, 12))

    def secret() -> str:
        h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
        kind = rng.randrange(5)
        if kind == 0:
            return f"{rng.choice(('password', 'passwd', 'pwd', 'secret', 'token', 'api_key'))}={h(rng.randint(8, 24))}"
        if kind == 1:
            return rng.choice(("AKIA", "ASIA")) + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(15)) + rng.choice("0123456789")
        if kind == 2:
            return f'"{h(rng.choice((32, 40, 64)))}"'
        if kind == 3:
            return f"{rng.choice(('sk', 'ghp', 'pk'))}_" + "".join(rng.choice("abcdefghABCDEFGH0123456789") for _ in range(rng.randint(20, 36))) + "7"
        return "password=" + name() + digits(3)

    entity = {
        0: lambda: f"{name()}{rng.choice(('.', '_', ''))}{digits(2)}@{name()}{rng.choice(('', digits(1)))}.{rng.choice(('com', 'org', 'example.com', 'net'))}",
        1: lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        2: lambda: card(True),
        3: lambda: rng.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{rng.choice((33, 44, 49, 34))} {digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}")),
        4: secret,
    }
    plain = (
        lambda: digits(rng.randint(1, 6)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1990, 2030)}",
        lambda: f"2{digits(3)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: card(False), lambda: f"{name()}={digits(1)}", lambda: "=", lambda: f"@{name()}",
        lambda: f"http://{name()}.org/{digits(3)}", lambda: f"{digits(3)}.{digits(3)},{digits(2)}", lambda: name() + digits(2), lambda: f"{digits(1)}.{digits(1)}.",
    )
    for _ in range(count):
        pieces: list[tuple[str, int]] = []
        for _ in range(rng.randint(1, 2)):
            pieces += [(word(), _OTHER) for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.6:
                kind = rng.randrange(5)
                if kind == 4 and rng.random() < 0.4:
                    pieces += [("token", _OTHER), ("=", _OTHER)]
                pieces.append((entity[kind](), kind))
            else:
                pieces.append((rng.choice(plain)(), _OTHER))
        pieces += [(word(), _OTHER) for _ in range(rng.randint(0, 2))]
        text, tokens, gold = "", [], []
        for own, kind in pieces:
            first = len(tokens)
            for part in own.split(" "):
                text += " " * bool(text)
                tokens.append((len(text), len(text) + len(part)))
                text += part
            if kind == _OTHER:
                gold += [(k, k + 1, _OTHER) for k in range(first, len(tokens))]
            else:
                gold.append((first, len(tokens), kind))
        yield text, tokens, gold


@lru_cache(2)
def trained(count: int = 260, passes: int = 3, seed: int = 5) -> Field:
    field = Field()
    sentences = list(training_sentences(count, seed))
    for p in range(passes):
        for text, tokens, gold in sentences:
            field.step(text, tokens, gold, 0.4 / (1 + p))
    return field


def field_spans(text: str, field: Field) -> list[Span]:
    out = []
    for tokens in regions(text):
        for a, b, t in field.decode(text, tokens):
            start, end = trimmed(text, tokens[a][0], tokens[b - 1][1])
            if start < end:
                out.append((start, t, end))
    return out


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with what the field adds."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    more = []
    for start, t, end in field_spans(text, field):
        k = bisect_left(starts, end)
        if not k or reach[k - 1] <= start:
            more.append((start, t, end))
    return base, sorted(base + more)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[t]}:{s}:{e}" for s, t, e in spans)


_SIGNS = K.byte_table([*range(0x30, 0x3A), ord("@"), ord("="), ord("+")])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text), found (array of kind, start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    schema = fields(
        ("doc_id", id_type(docs)), *[(f"n_{k}", "long") for k in BASE], ("base_sha256", "string"), ("spans", "string"),
        ("found", "array<struct<kind:string,start:long,end:long>>"),
    )
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", [])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = K.buffers(batch.column(1))
        signs = np.concatenate([[0], np.cumsum(_SIGNS[data[offsets[0] : offsets[-1]]], dtype=np.int64)])[offsets - offsets[0]]
        some = (np.diff(signs) > 0).tolist()
        rows = []
        for text, any_sign in zip(batch.column(1), some, strict=True):
            if not any_sign:
                rows.append(nothing)
                continue
            base, spans = all_spans(text.as_py(), sent.value)
            counts = [sum(t == k for _, t, _ in base) for k in range(4)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), [{"kind": KINDS[t], "start": s, "end": e} for s, t, e in spans]))
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=schema.names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)
