"""Personal data: set patterns, and a linear-chain conditional random field for other spellings.

The patterns (email, ip, card, phone) are found leftmost and without overlap, each kind by itself.
The random field then labels the tokens around every hint by B and I tags of each kind, from
word-shape features of the token and its neighbours. A hint is a token with a digit, an at sign, a
bracketed ``at`` or ``dot``, or the word ``dot``: every spelling that the field is trained on holds
one. (An address with a plain ``at`` and full stops, "anna at example.org", is not told from prose.)
The field is trained by gradient on the labelled sentences of ``labelled`` (a small table written
from a rule) and decoded by Viterbi over all sequences of an Arrow batch at once. A decoded span must
hold a plausible number of digits or an address, and is dropped if it overlaps a span of the patterns.

Every stretch of tokens near hints is decoded to its end. One of over ``PART`` tokens is decoded in
parts that overlap by ``OVERLAP`` tokens on both sides, more than any plausible span has; a span
counts in the part that holds its start outside the overlap, so no span is lost at a cut.

One pass over the texts, without a shuffle; the weights go to every task (a few thousand numbers).

Edge cases: a null or empty text has no spans (the digest of an empty string). Positions count code
points, ends are exclusive. Tokens and texts are read whole, in linear time. Repeated rows are
scanned alike; an empty table gives an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CONTEXT = 3  # tokens on either side of a token with a digit or an at sign
SENTENCES = 400
STEPS = 100
RATE = 0.15
PENALTY = 1e-3

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:(\.[0-9]+)(\.[0-9]+)(\.[0-9]+))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
HINT = re.compile(r"[0-9@]|[(\[{<](?:at|dot)[)\]}>]|(?<![^\W_])dot(?![^\W_])", re.IGNORECASE)
SPELLED = re.compile(r"[(\[{<](?:at|dot)[)\]}>]")
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,base:boolean>>"

FEATURES = 17  # of each token

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > done:  # back over the local part, a stretch at a time
            stretch = text[max(done, start - step) : start]
            left = len(stretch.rstrip(LOCAL))
            start -= len(stretch) - left
            if left:
                break
            step *= 2
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start."""
    out = list(emails(text)) if "@" in text else []
    for m in NUMBERS.finditer(text):
        if m[1] and all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def shape(token: str) -> str:
    s = re.sub(r"[0-9]", "9", token)
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "x", s)
    return re.sub(r"9+", lambda m: "9" * min(len(m[0]), 5), s)


def features(tokens: list[str]) -> list[list[str]]:
    """Names of the features of each token."""
    shapes = ["<", "<", *map(shape, tokens), ">", ">"]
    low = ["<", *(t.lower().strip(".,;:()[]\"'") for t in tokens), ">"]
    out = []
    for i, t in enumerate(tokens):
        digits = sum("0" <= c <= "9" for c in t)
        out.append([
            "bias", f"s={shapes[i + 2]}", f"s-={shapes[i + 1]}", f"s+={shapes[i + 3]}", f"s--={shapes[i]}", f"s++={shapes[i + 4]}",
            f"w-={low[i]}" if low[i].isalpha() else "w-", f"w+={low[i + 2]}" if low[i + 2].isalpha() else "w+", f"w={low[i + 1]}" if low[i + 1].isalpha() else "w",
            f"d={min(digits, 20)}", f"dots={min(t.count('.'), 4)}", f"dash={min(t.count('-'), 4)}", f"at={'@' in t}", f"plus={t[:1] == '+'}", f"paren={t[:1] == '('}",
            f"spelled={SPELLED.sub('*', t.lower()).count('*')}", f"inner={bool(SPELLED.search(t[1:-5]))}",
        ])
    return out


def labelled(count: int = SENTENCES, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The training table: tokens and tags of sentences written from a rule."""
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    syllables = ["an", "the", "er", "on", "ti", "re", "st", "un", "de", "la", "que", "sch", "en", "ou", "as", "os", "ver", "ion", "ée", "ö"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    end = lambda: rng.choice(["", "", ".", ","])

    def phone() -> str:
        return rng.choice([f"+{rng.randint(1, 99)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"+{rng.randint(1, 99)}{n(10)}", f"0{n(3)} {n(3)} {n(4)}", f"({n(3)}){n(3)}-{n(4)}"])

    def email() -> str:
        name, host = rng.choice([word(), word() + "." + n(2), word() + "_" + word()]), rng.choice(["mail", "post", "web", word()]) + rng.choice(["", str(rng.randint(0, 9))])
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("(at)", "dot"), ("[at]", "dot"), ("(at)", ".")])
        end = rng.choice(["com", "org", "net"])
        return rng.choice([f"{name}@{host}.example.com", f"{name} @ {host}.example.org", f"{name}{at}{host}.example.{end}", f"{name} {at} {host} {dot} {end}" if dot != "." else f"{name} {at} {host}.{end}", f"{name}{at}{host}{dot if dot != 'dot' else '.'}{end}", f"{name}@{host} dot {end}", f"{name} at {host} dot {end}"])

    def card() -> str:
        return rng.choice([n(16), f"{n(4)} {n(4)} {n(4)} {n(4)}", f"{n(4)}-{n(4)}-{n(4)}-{n(4)}", f"{n(4)}.{n(4)}.{n(4)}.{n(4)}", f"{n(4)} {n(6)} {n(5)}"])

    def ip() -> str:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([".".join(parts), ".".join(parts), "[.]".join(parts), ".".join(parts) + f":{rng.randint(80, 9999)}"])

    def other() -> str:
        return rng.choice([f"version {n(1)}.", f"{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(2)}", f"in {rng.randint(1900, 2030)}", f"page {n(2)} of {n(3)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"${n(2)}.{n(2)}", f"{n(3)},{n(3)}", "AKIA" + word().upper() + n(3) + word().upper(), f'token = "{n(6)}ab{n(5)}cd{n(9)}"', f"password={n(4)}af{n(3)}c{n(4)}", f"#{n(5)}", f"id {n(7)}", f"{n(5)}", f"x{n(2)}", f"@{word()}", f"{n(12)}", f"{n(24)}", f"({n(1)})", f"{n(3)} {n(3)}", f"CC BY-NC {n(1)}.0.", "the dot", f"a {word()} (at) the", f"{word()} dot {word()}"])

    cues = {"email": ["mail", "email", "write", "contact"], "ip": ["from", "host", "server", "ip"], "card": ["card", "visa", "pay", "account"], "phone": ["call", "phone", "tel", "fax"]}
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        tokens, tags = [], []

        def say(text: str, kind: str | None, tokens: list[str] = tokens, tags: list[str] = tags) -> None:
            for k, t in enumerate(text.split()):
                tokens.append(t)
                tags.append("O" if kind is None else f"{'I' if k else 'B'}-{kind}")

        for _ in range(rng.randint(1, 3)):
            say(" ".join(word() for _ in range(rng.randint(0, 4))), None)
            if rng.random() < 0.45:
                say(other() + end(), None)
            else:
                kind = rng.choice(KINDS)
                cue, made = rng.random(), makers[kind]()
                if cue < 0.1:
                    made = f"{rng.choice(cues[kind])}:{made}"
                elif cue < 0.45:
                    say(rng.choice(cues[kind]), None)
                say(made + end(), kind)
        say(" ".join(word() for _ in range(rng.randint(0, 3))), None)
        out.append((tokens, tags))
    return out


class Field:
    """Weights: one row of tag scores for each feature, and tag-to-tag scores."""

    def __init__(self, rows: list[tuple[list[str], list[str]]], steps: int = STEPS):
        seen: dict[str, int] = {}
        for tokens, _ in rows:
            for names in features(tokens):
                for f in names:
                    seen[f] = seen.get(f, 0) + 1
        self.names = {f: k for k, f in enumerate(f for f, c in seen.items() if c > 1)}
        k = len(TAGS)
        self.weights, self.moves = np.zeros((len(self.names) + 1, k)), np.zeros((k, k))  # the last row is for unknown features
        # I follows B or I of its kind only
        self.allowed = np.array([[not b.startswith("I") or a[2:] == b[2:] != "" for b in TAGS] for a in TAGS])
        self.first = np.array([not t.startswith("I") for t in TAGS])
        ids, mask = self.encoded([t for t, _ in rows])
        gold = np.zeros(mask.shape, int)
        for r, (_, tags) in enumerate(rows):
            gold[r, : len(tags)] = [TAGS.index(t) for t in tags]
        one = np.eye(k)[gold] * mask[:, :, None]
        both = mask[:, 1:, None, None] * one[:, :-1, :, None] * one[:, 1:, None, :]
        gold_moves = both.sum(axis=(0, 1))
        state = [np.zeros_like(p) for p in (self.weights, self.moves) for _ in range(2)]
        for step in range(1, steps + 1):
            marginal, moves = self.marginals(ids, mask)
            push = np.zeros_like(self.weights)
            error = (marginal - one)[mask]
            flat = ids[mask]
            for j in range(flat.shape[1]):
                np.add.at(push, flat[:, j], error)
            push[-1] = 0
            for p, g, m, v in ((self.weights, push / len(rows) + PENALTY * self.weights, *state[:2]), (self.moves, (moves - gold_moves) / len(rows) + PENALTY * self.moves, *state[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def encoded(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        longest, none = max(map(len, sequences)), len(self.names)
        ids = np.full((len(sequences), longest, FEATURES), none)
        mask = np.zeros((len(sequences), longest), bool)
        for r, tokens in enumerate(sequences):
            mask[r, : len(tokens)] = True
            for i, names in enumerate(features(tokens)):
                ids[r, i] = [self.names.get(f, none) for f in names]
        return ids, mask

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return sum(self.weights[ids[:, :, j]] for j in range(ids.shape[2]))

    def marginals(self, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities of each token, and expected counts of tag pairs (forward-backward)."""
        emit, move = self.scores(ids), np.where(self.allowed, self.moves, -1e9)
        top = lambda x, axis: np.log(np.exp(x - (h := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + h.squeeze(axis)
        n, longest, k = emit.shape
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + np.where(self.first, 0, -1e9)
        for i in range(1, longest):
            now = top(ahead[:, i - 1, :, None] + move, 1) + emit[:, i]
            ahead[:, i] = np.where(mask[:, i, None], now, ahead[:, i - 1])
        for i in range(longest - 2, -1, -1):
            now = top(move + (emit[:, i + 1] + back[:, i + 1])[:, None, :], 2)
            back[:, i] = np.where(mask[:, i + 1, None], now, 0)
        whole = top(ahead[:, -1], 1)
        marginal = np.exp(ahead + back - whole[:, None, None]) * mask[:, :, None]
        pairs = ahead[:, :-1, :, None] + move + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        return marginal, (np.exp(pairs) * mask[:, 1:, None, None]).sum(axis=(0, 1))

    def decoded(self, sequences: list[list[str]], tokens: int = 1 << 15) -> list[list[str]]:
        """Most likely tags of each sequence (Viterbi), like lengths side by side, ``tokens`` at once."""
        out: list[list[str]] = [[] for _ in sequences]
        order = sorted(range(len(sequences)), key=lambda r: len(sequences[r]))
        move = np.where(self.allowed, self.moves, -1e9)
        at = 0
        while at < len(order):
            more = at + 1
            while more < len(order) and (more + 1 - at) * len(sequences[order[more]]) <= tokens:
                more += 1
            some, at = order[at:more], more
            ids, mask = self.encoded([sequences[r] for r in some])
            emit = self.scores(ids)
            best, came = emit[:, 0] + np.where(self.first, 0, -1e9), []
            for i in range(1, emit.shape[1]):
                step = best[:, :, None] + move
                origin = step.argmax(axis=1)
                now = np.take_along_axis(step, origin[:, None, :], 1)[:, 0] + emit[:, i]
                live = mask[:, i, None]
                came.append(np.where(live, origin, np.arange(emit.shape[2])))
                best = np.where(live, now, best)
            tag = best.argmax(axis=1)
            path = [tag]
            for origin in reversed(came):
                tag = np.take_along_axis(origin, tag[:, None], 1)[:, 0]
                path.append(tag)
            path = np.array(path[::-1]).T
            for r, tags in zip(some, path, strict=True):
                out[r] = [TAGS[t] for t in tags[: len(sequences[r])]]
        return out


@functools.cache
def default_field() -> Field:
    return Field(labelled())


PART = 2000  # tokens of a stretch that are decoded at once
OVERLAP = 64


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token positions of each stretch around hints."""
    if not HINT.search(text):
        return
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    starts = np.array([s for s, _ in tokens])
    hints = np.unique(np.searchsorted(starts, [m.start() for m in HINT.finditer(text)], "right") - 1)
    new = np.flatnonzero(np.insert(np.diff(hints) > 2 * CONTEXT + 1, 0, True))
    for a, b in zip(new, np.append(new[1:], len(hints)), strict=True):
        yield tokens[max(0, hints[a] - CONTEXT) : hints[b - 1] + CONTEXT + 1]


def parts(count: int) -> Iterator[tuple[int, int, int, int]]:
    """From, to, and the core within, of the parts in which ``count`` tokens are decoded."""
    for core in range(0, count, PART):
        yield max(0, core - OVERLAP), min(count, core + PART + OVERLAP), core, min(count, core + PART)


def plausible(kind: str, text: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return ("@" in text or "at" in text.lower()) and ("." in text or "dot" in text.lower())
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) in (4, 5) and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4]) and text.count(".") >= 3
    if kind == "card":
        d = "".join(c for c in text if "0" <= c <= "9")
        return 13 <= digits <= 19 and luhn(d)
    return 7 <= digits <= 15 and text.lstrip("(+")[:1].isdigit()


def _trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    end -= len(piece) - len(piece.rstrip(".,;:!?\"'"))
    piece = text[start:end]
    start += len(piece) - len(piece.lstrip("\"',;:"))
    # a word that stands before without a space is no part of it
    before = re.match(r"[^\W\d_]+:(?=.)" if kind == "email" else r"[^0-9(+\[]+(?=[0-9(+\[])", text[start:end])
    return start + (before.end() if before else 0), end


def added_spans(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans the field finds beside the patterns', for each text."""
    where, sequences = [], []
    for k, text in enumerate(texts):
        starts = np.array(sorted(b for _, b, _ in bases[k]))
        ends = np.maximum.accumulate([e for _, _, e in sorted(bases[k], key=lambda s: s[1])]) if len(starts) else starts
        for run in stretches(text):
            for low, high, first, last in parts(len(run)):
                tokens = run[low:high]
                s, e = np.array(tokens).T
                # a part whose hints all lie within spans of the patterns has nothing to add
                known = np.searchsorted(starts, s, "right")
                inside = (known > 0) & (ends[np.maximum(known - 1, 0)] >= e) if len(starts) else np.zeros(len(s), bool)
                if any(HINT.search(text, *tokens[i]) for i in np.flatnonzero(~inside)):
                    where.append((k, tokens, first - low, last - low))
                    sequences.append([text[a:b] for a, b in tokens])
    by_kind = [[sorted((b, e) for kind, b, e in base if kind == one) for one in KINDS] for base in bases]

    def overlaps(k: int, start: int, end: int) -> bool:
        # spans of one kind do not overlap: the last that starts before ``end`` reaches furthest
        last = ((spans, bisect.bisect_left(spans, (end,))) for spans in by_kind[k])
        return any(at and spans[at - 1][1] > start for spans, at in last)

    out: list[list[Span]] = [[] for _ in texts]
    for (k, run, first, last), tags in zip(where, field.decoded(sequences) if sequences else [], strict=True):
        i = first
        while i < last:
            if tags[i][0] != "B":
                i += 1
                continue
            j, kind = i + 1, tags[i][2:]
            while j < len(tags) and tags[j] == f"I-{kind}":
                j += 1
            start, end = _trimmed(kind, texts[k], run[i][0], run[j - 1][1])
            if start < end and plausible(kind, texts[k][start:end]) and not overlaps(k, start, end):
                out[k].append((kind, start, end))
            i = j
    return [sorted(set(s), key=lambda x: (KINDS.index(x[0]), x[1])) for s in out]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, a count of each kind's pattern spans, base_sha256, spans, and found (every span,
    with whether a pattern found it)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, shared.value)
            counts = [pa.array([sum(s[0] == kind for s in b) for b in bases], pa.int64()) for kind in KINDS]
            digests = [hashlib.sha256(listed(b).encode()).hexdigest() for b in bases]
            every = [sorted([(*s, True) for s in b] + [(*s, False) for s in m], key=lambda x: (KINDS.index(x[0]), x[1])) for b, m in zip(bases, more, strict=True)]
            rows = [[{"kind": k, "start": a, "end": e, "base": own} for k, a, e, own in s] for s in every]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([listed([s[:3] for s in e]) for e in every], pa.string()), pa.array(rows, kind)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, FOUND)
