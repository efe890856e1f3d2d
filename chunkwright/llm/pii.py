"""Personal data in texts: fixed patterns, and a span classifier that is trained without hand labels.

Fixed patterns (e-mail addresses, IP addresses, card and phone numbers) always count. Beyond them, candidates of looser forms (numbers inside
runs that no pattern takes, national phone numbers, spelled-out addresses, secrets) are voted on, and so are the fixed spans, by labelers: the
strict pattern, check digits or ranges, gazetteers of prefixes, top-level domains and key words, cue words nearby, and what a span borders on.
A labeler says yes, no or nothing. Expectation-maximisation over the counts of vote patterns (of all spans in all documents) estimates how
reliable each labeler is for each kind, and so how likely each span is. A logistic classifier over the other labelers' votes, the span's
form and neighbouring words is trained on these likelihoods for at most SAMPLE spans of each kind, and decides on those without a fixed pattern.

Every pattern runs in time in proportion to the text. Spans count code points, ends are exclusive. A null text is empty; other columns don't matter, and
repeated rows each have their result. Without any candidate only the fixed patterns count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from chunkwright.llm.common import materialise, slices

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "check", "gazetteer", "context", "border")
#: Spans of each kind that the classifier is trained on, those of the least hash.
SAMPLE = 4000
#: Characters that labelers see before and after a span.
BEFORE, AFTER = 32, 8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SPELLED_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
SPELLED_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)+", re.I)
CARD_BLOCKS = re.compile(r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+")
DIGIT = re.compile(r"[0-9]")

#: What the gazetteers know.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk pl pt".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|35|6011|64|65|62")
CALLING = re.compile(r"\+ ?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
KEY_WORDS = re.compile(r"token|secret|passw|api.?key|access.?key|private.?key|bearer|credential|auth", re.I)
CUES = {
    "email": re.compile(r"mail|contact|write to|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|ping|subnet", re.I),
    "card": re.compile(r"card|visa|credit|debit|payment|amex", re.I),
    "phone": re.compile(r"phone|call|\btel\b|fax|mobile|\bcell\b", re.I),
    "secret": re.compile(r"[=:] ?[\"']?$"),
}

Span = tuple[str, int, int]


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether a number's check digit is right."""
    values = [int(d) for d in reversed(number)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses, found from their @: the pattern's name part can't hold one, so a text is read once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def fixed(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15] if "+" in text else []
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, known: list[Span]) -> list[Span]:
    """Looser spans that the fixed patterns don't have; of one kind none lies inside a fixed one."""
    out: list[Span] = []
    if "@" not in text and not DIGIT.search(text) and not SPELLED_AT.search(text):
        return out
    for m in SPELLED_AT.finditer(text):
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        first = start
        while first > 0 and text[first - 1] in LOCAL:
            first -= 1
        right = SPELLED_DOMAIN.match(text, m.end())
        if first < start and right:
            out.append(("email", first, right.end()))
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP6), ("card", CARD_BLOCKS), ("phone", NATIONAL)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
        out += [("secret", *m.span()) for m in TOKEN.finditer(text) if DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0])]
    own = {k: [(a, b) for kind, a, b in known if kind == k] for k in KINDS}
    for k in KINDS:
        mine = own[k]
        if not mine:
            continue
        starts = [a for a, _ in mine]
        out = [s for s in out if s[0] != k or not _covered(s, mine, starts)]
    return in_order(out)


def _covered(span: Span, mine: list[tuple[int, int]], starts: list[int]) -> bool:
    """Whether the last fixed span that starts no later reaches over this one (fixed spans of a kind don't overlap)."""
    at = int(np.searchsorted(starts, span[1], side="right")) - 1
    return at >= 0 and mine[at][1] >= span[2]


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """What each labeler says of a span: 1 yes, -1 no, 0 nothing."""
    number, letters = digits(span), sum(c.isalpha() for c in span)
    sign = lambda x: 1 if x else -1
    # what stands alone as the pattern's match, though it may not in its place; other forms are none of the pattern's business
    own = 1 if (kind, 0, len(span)) in fixed(span) else -1 if kind == "card" else 0
    edge = sign(not (before[-1:].isalnum() or after[:1].isalnum()))
    wrong = any(CUES[k].search(before) for k in KINDS[:4] if k != kind)
    context = 1 if CUES[kind].search(before) else -1 if wrong else 0
    if kind == "email":
        domain = re.split(r"[\])]", span, maxsplit=1)[-1]
        top = re.split(r"[^A-Za-z0-9-]+", domain)[-1].lower()
        return own, sign(top.isalpha() and len(top) >= 2 and letters >= 4), sign(top in TOP_LEVEL), context, edge
    if kind == "ip":
        return own, sign(len(set(span)) > 3), -1 if re.match(r"0+[.:]|127[.]|255[.]", span) else 1, context, edge
    if kind == "card":
        return own, sign(luhn(number)), sign(ISSUERS.match(number)), context, edge
    if kind == "phone":
        return own, sign(span.count("(") == span.count(")") and len(number) >= 9), 1 if CALLING.match(span) or CALLING.search(before[-4:]) else 0, context, edge
    share = len(number) / len(span)
    form = sign(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) and len(span) in (32, 40, 48, 56, 64, 96, 128) or 0.1 <= share <= 0.6 and len(set(span)) >= 12)
    return form, sign(len(set(span)) >= 8 and share <= 0.9), 1 if KEY_WORDS.search(before) else 0, context, edge


def code(given: tuple[int, ...]) -> int:
    """Votes as one number, in base 3."""
    out = 0
    for v in given:
        out = out * 3 + v + 1
    return out


def decode(number: int) -> list[int]:
    out = []
    for _ in LABELERS:
        number, v = divmod(number, 3)
        out.append(v - 1)
    return out[::-1]


def estimate(counts: dict[tuple[str, int], int], rounds: int = 60) -> tuple[dict[str, np.ndarray], dict[tuple[str, int], float]]:
    """Expectation-maximisation over counts of vote patterns by kind.

    Gives for each kind the chance of a no and a yes, of those that vote, as [class, labeler, yes], and for each pattern the chance that it's
    personal data. Saying nothing is no evidence. Starts from the sum of votes, even at two yeses more than noes; a vote is never impossible.
    """
    tables, chances = {}, {}
    for kind in KINDS:
        own = sorted((c, n) for (k, c), n in counts.items() if k == kind)
        if not own:
            continue
        v = np.array([decode(c) for c, _ in own])
        n = np.array([m for _, m in own], float)
        p = 1 / (1 + np.exp(-1.5 * (v.sum(1) - 2)))
        hit = np.stack([v == -1, v == 1], axis=2).astype(float)
        for _ in range(rounds):
            prior = np.array([((1 - p) * n).sum() + 2, (p * n).sum() + 2])
            prior /= prior.sum()
            table = np.zeros((2, len(LABELERS), 2))
            for y, q in enumerate((1 - p, p)):
                # pseudo-counts lean to labelers that are right more often than wrong
                table[y] = ((q * n)[:, None, None] * hit).sum(0) + np.array([1, 3] if y else [3, 1])
                table[y] /= table[y].sum(1, keepdims=True)
            logs = [np.log(prior[y]) + (hit * np.log(table[y])).sum((1, 2)) for y in (0, 1)]
            p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        tables[kind] = table
        chances |= {(kind, c): float(x) for (c, _), x in zip(own, p, strict=True)}
    return tables, chances


SHAPES, WORDS = 128, 64
#: Inputs of the classifier: one for each kind, labeler and vote; lengths and shares by kind; hashed forms and neighbours.
WIDTH = len(KINDS) * (1 + len(LABELERS) * 3 + 3) + SHAPES + 2 * WORDS


def features(kind: str, given: tuple[int, ...], span: str, before: str, after: str) -> np.ndarray:
    x = np.zeros(WIDTH)
    k = KINDS.index(kind)
    x[k] = 1
    base = len(KINDS)
    for j, v in enumerate(given[1:], 1):  # the pattern isn't what decides on other forms
        x[base + (k * len(LABELERS) + j) * 3 + v + 1] = 1
    base += len(KINDS) * len(LABELERS) * 3
    x[base + 3 * k : base + 3 * k + 3] = log(1 + len(span)) / 5, len(digits(span)) / len(span), len(set(span)) / len(span)
    base += 3 * len(KINDS)
    form = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", span))))[:24]
    x[base + zlib.crc32(f"{kind}{form}".encode()) % SHAPES] = 1
    base += SHAPES
    for words, at in ((re.findall(r"\w+", before)[-1:], base), (re.findall(r"\w+", after)[:1], base + WORDS)):
        for w in words:
            x[at + zlib.crc32(w.lower().encode()) % WORDS] = 0.5
    return x


@dataclass
class Model:
    """Labelers' tables by kind, and the classifier's weights (None: there was nothing to learn from)."""

    tables: dict[str, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def reliability(self, kind: str, labeler: str) -> float:
        """The chance that a labeler's vote, where it has one, is right: both classes count the same."""
        no, yes = self.tables[kind][:, LABELERS.index(labeler)]
        return float((yes[1] + no[0]) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def added(self, text: str, known: list[Span], threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
        """Candidates that the classifier takes, with their scores."""
        found = candidates(text, known) if self.weights is not None else []
        if not found:
            return []
        score = self.score(np.stack([features(*_seen(text, s)) for s in found]))
        return [(*s, float(p)) for s, p in zip(found, score, strict=True) if p >= threshold]


def _seen(text: str, span: Span) -> tuple[str, tuple[int, ...], str, str, str]:
    """Kind, votes, the span and what stands around it."""
    kind, a, b = span
    parts = text[a:b], text[max(0, a - BEFORE) : a], text[b : b + AFTER]
    return kind, votes(kind, *parts), *parts


def train(x: np.ndarray, p: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Logistic weights (the last is the bias) for probabilities as labels, by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 4 / max((x * x).sum(1).max(), 1)
    for k in range(rounds):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -60, 60))) - p) / len(x) + decay * ahead
        new = ahead - rate * slope
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Vote patterns are counted over all documents; the classifier sees up to `sample` candidates of each kind."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for text in part.column(0).to_pylist():
                if text:
                    known = fixed(text)
                    for kind, given, *parts in (_seen(text, s) for s in known + candidates(text, known)):
                        rows.append((kind, code(given), *parts))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]], ["kind", "votes", "span", "before", "after"])

    seen = materialise(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(look, "kind string, votes int, span string, before string, after string"), "candidates")
    counts = {(r["kind"], r["votes"]): r["n"] for r in seen.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # kinds times 3 ^ labelers at most
    if not counts:
        return Model()
    tables, chances = estimate(counts)
    order = Window.partitionBy("kind").orderBy(F.xxhash64("kind", "span", "before", "after"), "span", "before", "after")
    rows = seen.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).drop("_r").collect()  # `sample` of each kind
    rows.sort()
    x = np.stack([features(r["kind"], tuple(decode(r["votes"])), r["span"], r["before"], r["after"]) for r in rows])
    return Model(tables, train(x, np.array([chances[r["kind"], r["votes"]] for r in rows])))


#: The text as it travels beside the columns that are kept.
SEEN = "_text_seen"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """The rows (of these columns; all by default) with `fixed` and `added`: arrays of (kind, begin, end, score), by start and then kind; fixed ones score 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    rest = [f for f in docs.schema.fields if f.name not in ("fixed", "added") and (columns is None or f.name in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SEEN):
            own, more = [], []
            for text in part.column(len(rest)).to_pylist():
                known = fixed(text) if text else []
                own.append([{"kind": k, "begin": a, "end": b, "score": 1.0} for k, a, b in known])
                more.append([{"kind": k, "begin": a, "end": b, "score": p} for k, a, b, p in held.value.added(text, known)] if text else [])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(own, SPANS), pa.array(more, SPANS)], [*part.schema.names[: len(rest)], "fixed", "added"])

    spans = StructType().add("kind", "string").add("begin", "long").add("end", "long").add("score", "double")
    schema = StructType([*rest, StructField("fixed", ArrayType(spans)), StructField("added", ArrayType(spans))])
    return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col("text").cast("string").alias(SEEN)).mapInArrow(run, schema)


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with each span in their text replaced by <kind>; of overlapping ones the first that starts, then the longest."""

    @F.udf("string")
    def blank(text: str | None, spans) -> str | None:  # noqa: ANN001
        if text is None:
            return None
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["begin"], -s["end"])):
            if s["begin"] >= at:
                out += [text[at : s["begin"]], f"<{s['kind']}>"]
            elif s["end"] <= at:
                continue
            at = max(at, s["end"])
        return "".join(out) + text[at:]

    found = find(docs, model)
    return found.withColumn("text", blank("text", F.concat("fixed", "added"))).drop("fixed", "added")
