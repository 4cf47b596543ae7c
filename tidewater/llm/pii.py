"""Personal data: base patterns, and a skip-chain conditional random field that makes a document's labels consistent.

The patterns find emails, IP addresses, card numbers and phone numbers. The field labels the tokens that could be
personal data (those with a digit or an @): each token has a potential from its own features and context, neighbouring
tokens share one, and distant tokens of the same document that repeat or resemble each other share a skip potential.
Loopy belief propagation spreads what is certain (the patterns' finds) to the places where the same thing stands without
its context. Documents are labelled whole, each on its own, inside Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.textkit import pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPOT = re.compile(r"[0-9@]")
_EDGE = " \t\n\v\f\r"
_TRIM = "\"'`()[]{}<>,.;:!?#$%&*|=~"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each @ with what precedes it: the same finds as a search from every place, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans (kind, start, end) in code points, by start and then kind in the order of KINDS."""
    spans = list(_emails(text)) if "@" in text else []
    if _SPOT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], LABELS.index(s[0]), s[2]))


@dataclass
class Token:
    start: int
    end: int
    text: str
    before: str
    base: int


def _words_before(text: str, start: int, count: int = 2) -> str:
    """The last ``count`` words before ``start``, whole, in lower case, with one space between them."""
    words, end = [], start
    while len(words) < count:
        while end > 0 and text[end - 1] in _EDGE:
            end -= 1
        begin = end
        while begin > 0 and text[begin - 1] not in _EDGE:
            begin -= 1
        if begin == end:
            break
        words.append(text[begin:end].lower())
        end = begin
    return " ".join(reversed(words))


def tokens(text: str, base: list[Span]) -> list[Token]:
    """The tokens, cut at white space and trimmed of marks, that have a digit or an @, with the two words before them.

    A word is read at most once as a token and twice as what stands before one, so the time is in proportion to the text.
    """
    found, reach, k = [], 0, 0
    for m in _SPOT.finditer(text):
        if m.start() < reach:
            continue
        start, end = m.start(), m.end()
        while start > reach and text[start - 1] not in _EDGE:
            start -= 1
        while end < len(text) and text[end] not in _EDGE:
            end += 1
        reach, before = end, start
        a, b = start, end
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if a == b:
            continue
        while k < len(base) and base[k][2] <= a:
            k += 1
        label = LABELS.index(base[k][0]) if k < len(base) and base[k][1] < b else 0
        found.append(Token(a, b, text[a:b], _words_before(text, before), label))
    return found


FEATURES = ("bias", "at", "dotted", "plus", "digits", "hex", "long", "mixed", "capitals", "luhn", "quad", "short", "dashed", "in_word", *(f"base {k}" for k in LABELS), "cue", "assigned")
_HEX = re.compile(r"[0-9a-fA-F]+")
_KEY = re.compile(r"[A-Z]{4}[0-9A-Z]{12,}")
_CUE = re.compile(r"token|secret|passw|pwd|key|credential|auth")


@lru_cache(maxsize=1 << 16)
def _own_features(body: str, base: int) -> tuple[float, ...]:
    digits = sum("0" <= c <= "9" for c in body)
    solid = re.sub(r"[ .()-]", "", body)
    number = solid.isascii() and solid.lstrip("+").isdigit()
    parts = body.split(".")
    return (
        1.0,
        "@" in body,
        "." in body,
        body.startswith("+"),
        number,
        len(body) >= 16 and _HEX.fullmatch(body) is not None,
        len(body) >= 16,
        len(body) >= 12 and digits >= 2 and not number and solid.isalnum(),
        _KEY.fullmatch(body) is not None,
        number and 12 <= digits <= 19 and luhn(re.sub(r"\D", "", body)),
        len(parts) == 4 and all(p.isdigit() for p in parts),
        len(body) < 6,
        "-" in body,
        not number and "@" not in body and digits < 3,
        *(base == k for k in range(len(LABELS))),
    )


def token_features(t: Token) -> tuple[float, ...]:
    """The features by FEATURES: those of the token itself, then whether a cue word or an assignment stands before it."""
    own = _own_features(t.text, t.base) if len(t.text) <= 64 else _own_features.__wrapped__(t.text, t.base)
    return (*own, _CUE.search(t.before) is not None, t.before.endswith(("=", ":")))


@dataclass(frozen=True)
class Field:
    """Weights of the random field: features by label, neighbour and skip potentials by label pair (all logarithms)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _lessons(seed: int = 11, rows: int = 900) -> list[tuple[list[Token], list[int]]]:
    """Generated documents with known labels: each kind with and without its context, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda s, n: "".join(rng.choice(list(s), n))
    word = lambda: pick("abcdefghijklmnopqrstuvwxyz", int(rng.integers(2, 9)))

    def card() -> str:
        head = pick("0123456789", 15)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    def phone() -> list[str]:
        return [f"+{rng.integers(1, 99)}", f"({pick('123456789', 3)})", f"{pick('123456789', 3)}-{pick('0123456789', 4)}"]

    makers = {
        "email": lambda: [f"{word()}.{rng.integers(1, 99)}@{word()}{rng.integers(1, 9)}.example.com"],
        "ip": lambda: [".".join(str(rng.integers(1, 255)) for _ in range(4))],
        "card": lambda: [card()],
        "phone": phone,
        "secret": lambda: [pick("0123456789abcdef", 40)] if rng.random() < 0.6 else ["AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)],
    }
    nothing = [lambda: str(rng.integers(0, 3000)), lambda: f"{rng.integers(0, 20)}.{rng.integers(0, 20)}", lambda: pick("123456789", 16), lambda: f"v{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 30)}", lambda: f"{word()}{rng.integers(0, 9)}", lambda: f"20{pick('0123456789', 2)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", lambda: f"{rng.integers(300, 999)}.{rng.integers(300, 999)}.7.1", lambda: pick("0123456789abcdef", 8)]
    lessons = []
    for _ in range(rows):
        words, marks = [word() for _ in range(3)], []
        shown = {k: make() for k, make in makers.items()}
        for kind in rng.choice([*makers, "none", "none", "none"], int(rng.integers(1, 6))):
            if kind == "none":
                words.append(nothing[rng.integers(len(nothing))]())
            else:
                if kind == "secret":
                    words += [("token", "key", "secret")[rng.integers(3)], "="] if rng.random() < 0.8 else []
                said = shown[kind] if rng.random() < 0.6 else makers[kind]()
                if kind == "phone" and rng.random() < 0.3:
                    said = said[1:]
                marks += [(len(words) + i, kind) for i in range(len(said))]
                words += said
            words += [word() for _ in range(int(rng.integers(0, 3)))]
        text = " ".join(words)
        places = dict(marks)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        found = tokens(text, base_spans(text))
        lessons.append((found, [LABELS.index(places.get(int(np.searchsorted(starts, t.start, "right")) - 1, "none")) for t in found]))
    return lessons


def _form(t: Token) -> str:
    """What repeated or similar tokens have in common: their digits where they have seven or more, else their letters."""
    digits = "".join(c for c in t.text if "0" <= c <= "9")
    return digits[-10:] if len(digits) >= 7 and len(digits) * 2 > len(t.text) else t.text.lower()


def edges(found: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Neighbours (at most three code points apart); by form, each occurrence with the next one; and each occurrence with
    the form's hub, its first one that a pattern or a cue word marks, so that evidence is one step from every repeat."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= 3]
    last: dict[str, int] = {}
    hub: dict[str, int] = {}
    forms = [_form(t) for t in found]
    for i, t in enumerate(found):
        if len(forms[i]) >= 6 and forms[i] not in hub and (t.base or _CUE.search(t.before)):
            hub[forms[i]] = i
    skip = set()
    for i, form in enumerate(forms):
        if len(form) >= 6:
            for other in (last.get(form), hub.get(form)):
                if other is not None and other != i:
                    skip.add((min(other, i), max(other, i)))
            last[form] = i
    return chain, sorted(skip)


@lru_cache(maxsize=2)
def trained(seed: int = 11) -> Field:
    """Piecewise training on generated documents: a softmax for the features; counts for the pair potentials."""
    lessons = _lessons(seed)
    x = np.array([token_features(t) for found, _ in lessons for t in found], float)
    y = np.array([k for _, labels in lessons for k in labels])
    n = len(LABELS)
    pairs = {"chain": np.full((n, n), 0.5), "skip": np.full((n, n), 0.05)}
    for found, labels in lessons:
        chain, skip = edges(found)
        for name, list_ in (("chain", chain), ("skip", skip)):
            for i, j in list_:
                pairs[name][labels[i], labels[j]] += 1
    # Half of the tokens are shown without the patterns' word, so that the other features and the skips matter.
    blind, first = x.copy(), FEATURES.index(f"base {LABELS[0]}")
    blind[:, first : first + n] = 0
    blind[:, first] = 1
    x, y = np.concatenate((x, blind)), np.concatenate((y, y))
    w = np.zeros((x.shape[1], n))
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w -= 1.5 * (x.T @ p / len(y) + 1e-4 * w)
    tables = []
    for name in ("chain", "skip"):
        joint = pairs[name] / pairs[name].sum()
        tables.append(np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))), -3, 3))
    return Field(w, tables[0], _balanced(tables[1]))


def _balanced(table: np.ndarray) -> np.ndarray:
    """The potentials scaled so that the exponentials of each row and each column sum to 1: a repeat without evidence of
    its own then says nothing, and a hundred of them nothing either."""
    p = np.exp((table + table.T) / 2)
    for _ in range(200):
        p /= p.sum(1, keepdims=True)
        p = (p + p.T) / 2
    return np.log(p)


def propagate(unary: np.ndarray, pairs: np.ndarray, kinds: np.ndarray, field: Field, *, tolerance: float = 1e-3, most: int = 1000) -> np.ndarray:
    """Marginals by damped loopy sum-product; ``pairs`` are (i, j) of all documents together, ``kinds`` 0 chain, 1 skip.

    Messages are sent until none changes by more than ``tolerance``; those that have settled are sent again when one that
    they depend on moves. ``most`` rounds are a stop for graphs whose messages never settle.
    """
    n = unary.shape[1]
    if not len(pairs):
        return _normal(unary)
    tables = np.exp(np.stack([field.chain, field.chain.T, field.skip, field.skip.T]))
    source, target = np.concatenate((pairs[:, 0], pairs[:, 1])), np.concatenate((pairs[:, 1], pairs[:, 0]))
    which = np.concatenate((2 * kinds, 2 * kinds + 1))
    back = np.concatenate((np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))))
    sent, belief = np.zeros((len(source), n)), unary.copy()
    live = np.arange(len(source))
    for _ in range(most):
        out = belief[source[live]] - sent[back[live]]
        out = np.exp(np.maximum(out - out.max(1, keepdims=True), -600))
        for k in range(4):
            own = which[live] == k
            out[own] = np.log(out[own] @ tables[k])
        change = 0.5 * (out - out.max(1, keepdims=True) - sent[live])
        sent[live] += change
        np.add.at(belief, target[live], change)
        moved = np.abs(change).max(1) > tolerance
        if not moved.any():
            break
        touched = np.zeros(len(unary), bool)
        touched[target[live[moved]]] = True
        again = touched[source]
        again[live[moved]] = True
        live = np.flatnonzero(again)
    return _normal(belief)


def _normal(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


#: Features of where a token stands; the others are of the token itself, the same for all that repeat it.
_OF_PLACE = np.isin(FEATURES, ("cue", "assigned"))


def potentials(found: list[Token], field: Field) -> np.ndarray:
    """Each token's potential. What repeated tokens say by their form is one piece of evidence, so they share it; what
    the places say counts for each. Without that a hundred bare repeats would outvote the one with a cue."""
    x = np.array([token_features(t) for t in found], float)
    forms = [_form(t) for t in found]
    times = Counter(f for f in forms if len(f) >= 6)
    share = np.array([1 / times.get(f, 1) for f in forms])
    return x[:, _OF_PLACE] @ field.unary[_OF_PLACE] + (x[:, ~_OF_PLACE] @ field.unary[~_OF_PLACE]) * share[:, None]


def find(texts: list[str], field: Field, *, sure: float = 0.8) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and the spans that the field adds: those of tokens outside base spans whose label is
    not none with at least ``sure``; neighbours with one label and only white space between them make one span."""
    bases = [base_spans(t) for t in texts]
    founds = [tokens(t, b) for t, b in zip(texts, bases, strict=True)]
    unary, pairs, kinds, at = [], [], [], 0
    for found in founds:
        if found:
            unary.append(potentials(found, field))
        for kind, list_ in enumerate(edges(found)):
            if list_:
                pairs.append(np.array(list_, np.int64) + at)
                kinds.append(np.full(len(list_), kind))
        at += len(found)
    added: list[list[Span]] = [[] for _ in texts]
    if unary:
        joined = (np.concatenate(pairs), np.concatenate(kinds)) if pairs else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        p = propagate(np.concatenate(unary), *joined, field)
        best, strength, at = p.argmax(1), p.max(1), 0
        for k, found in enumerate(founds):
            for i, t in enumerate(found):
                if t.base == 0 and best[at + i] and strength[at + i] >= sure:
                    kind, own = LABELS[best[at + i]], added[k]
                    if own and own[-1][0] == kind and not texts[k][own[-1][2] : t.start].strip(_EDGE) and t.start > own[-1][2]:
                        own[-1] = (kind, own[-1][1], t.end)
                    else:
                        own.append((kind, t.start, t.end))
            at += len(found)
    return list(zip(bases, added, strict=True))


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], LABELS.index(s[0]), s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in angle brackets."""
    out, reach, pending = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if pending and a < pending[2]:
            pending = (pending[0], pending[1], max(b, pending[2]))
            continue
        if pending:
            out += [text[reach : pending[1]], f"<{pending[0].upper()}>"]
            reach = pending[2]
        pending = (kind, a, b)
    if pending:
        out += [text[reach : pending[1]], f"<{pending[0].upper()}>"]
        reach = pending[2]
    return "".join([*out, text[reach:]])


def detect(docs: DataFrame, *, field: Field | None = None, with_redacted: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), and ``redacted`` text if asked for.

    ``docs`` needs doc_id and text; other columns are not read. Null counts as empty; a text without finds has no spans
    and the digest of an empty string. Equal texts get equal results, repeated rows too; an empty table gives no rows.
    """
    field = field or trained()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] + ["redacted"] * with_redacted
    types = [pa.int64()] * 4 + [pa.string()] * (2 + with_redacted)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts, rows = [t or "" for t in part.column("text").to_pylist()], []
                for text, (base, more) in zip(texts, find(texts, field), strict=True):
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    row = [*counts, hashlib.sha256(told(base).encode()).hexdigest(), told(base + more)]
                    rows.append(row + [redact(text, base + more)] * with_redacted)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *names])

    schema = f"doc_id {kind}, " + ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, types, strict=True))
    return docs.select("doc_id", "text").mapInArrow(label, schema)


def redacted(docs: DataFrame, *, field: Field | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; ``n_chars``, where there is one, is
    the new text's. Other columns and null texts stay as they are."""
    field = field or trained()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                given = part.column("text").to_pylist()
                found = find([t or "" for t in given], field)
                texts = [t if t is None else redact(t, base + more) for t, (base, more) in zip(given, found, strict=True)]
                new = {"text": pa.array(texts, part.schema.field("text").type)}
                if "n_chars" in part.schema.names:
                    new["n_chars"] = pa.array([t if t is None else len(t) for t in texts]).cast(part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(part.schema.names, part.columns, strict=True)], schema=part.schema)

    return docs.mapInArrow(clean, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's personal data."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
