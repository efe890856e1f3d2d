"""Fixed patterns against the patterns as they are stated, labelers and their estimation, and whole results on planted rows."""

import hashlib
import random
import re
import time

from chunkwright.llm import pii, queries

#: The patterns as stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stated(text):
    out = []
    for k, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(number)))
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(number) <= 19 and total % 10 == 0, "phone": 9 <= len(number) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def card(rng):
    number = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(number + d for d in "0123456789" if pii.luhn(number + d))


def test_fixed_patterns_as_stated():
    rng = random.Random(2)
    bits = ["a@b.c", "@", "x", ".", "-", " ", "+1", "(", ")", "1.2.3.4", "255", "256", "7", "00", "4111111111111111", "é", "٣", "\n", "a.b+c@d-e.f.g", "@@", "..", "+", "12-34 56", "4111 1111-1111 1111"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))
        assert pii.fixed(text) == stated(text), text


def test_long_texts_take_time_in_proportion():
    began = time.perf_counter()
    for text in ("a" * 500_000, "1" * 500_000, "a@" * 200_000, "1." * 200_000, "+1 " * 200_000, "1-" * 200_000, "(at)" * 100_000, "+1" + "(" * 300_000, "ab1=" * 100_000, "a.b@" + "c" * 500_000, "1:" * 200_000):
        known = pii.fixed(text)
        for s in pii.candidates(text, known):
            pii._seen(text, s)
    assert time.perf_counter() - began < 60


def test_estimation_tells_good_labelers_from_bad():
    rng = random.Random(4)
    truth, right = {}, (0.98, 0.95, 0.9, 0.6, 0.52)
    counts = {}
    for _ in range(6000):
        y = rng.random() < 0.4
        given = tuple((1 if y == (rng.random() < r) else -1) if rng.random() < 0.8 else 0 for r in right)
        counts[("card", pii.code(given))] = counts.get(("card", pii.code(given)), 0) + 1
        truth.setdefault(given, []).append(y)
    tables, chances = pii.estimate(counts)
    model = pii.Model(tables)
    for name, r in zip(pii.LABELERS, right, strict=True):
        assert abs(model.reliability("card", name) - r) < 0.05
    wrong = sum(abs((chances["card", pii.code(g)] >= 0.5) - t) for g, ys in truth.items() for t in ys)
    assert wrong / 6000 < 0.05


def planted(rng):
    """(text, spans that no fixed pattern has)."""
    fill = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "so"]) for _ in range(rng.randrange(1, 12)))
    text, spans = fill(), []
    for _ in range(rng.randrange(0, 4)):
        kind = rng.choice(["pair", "secret", "spelled", "email", "card", "number", "ip", "phone"])
        text += " "
        if kind == "pair":
            numbers = card(rng), card(rng)
            spans += [("card", len(text), len(text) + 16), ("card", len(text) + 17, len(text) + 33)]
            text += " ".join(numbers)
        elif kind == "secret":
            text += 'token = "'
            spans.append(("secret", len(text), len(text) + 40))
            text += hashlib.sha1(str(rng.random()).encode()).hexdigest() + '"'
        elif kind == "spelled":
            found = f"{rng.choice(['ann', 'bob'])}{rng.randrange(99)} (at) mail{rng.randrange(9)} (dot) com"
            text += "write to "
            spans.append(("email", len(text), len(text) + len(found)))
            text += found
        elif kind == "number":
            number = card(rng)
            text += number[:-1] + str((int(number[-1]) + 5) % 10)  # a wrong check digit
        else:
            text += {"email": f"ann.{rng.randrange(99)}@mail.example.com", "card": card(rng), "ip": f"{rng.randrange(1, 255)}.7.8.9", "phone": f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"}[kind]
        text += " " + fill()
    return text, spans


def test_planted_spans(spark, docs_of):
    rng = random.Random(9)
    made = [planted(rng) for _ in range(900)]
    docs = docs_of([(i, t) for i, (t, _) in enumerate(made)] + [(-1, None), (-2, ""), (None, "a@b.cd"), (None, "a@b.cd")])
    model = pii.fit(docs)
    got = pii.find(docs, model).collect()
    assert len(got) == len(made) + 4 and "cls" in got[0].asDict()
    hits = extra = wanted = 0
    for r in got:
        assert [(s["kind"], s["begin"], s["end"]) for s in r["fixed"]] == stated(r["text"] or "")
        if r["doc_id"] is not None and r["doc_id"] >= 0:
            added, planned = {(s["kind"], s["begin"], s["end"]) for s in r["added"]}, set(made[r["doc_id"]][1])
            # a pair whose digits together pass no check has no fixed span
            planned = {s for s in planned if not any(f["kind"] == s[0] and f["begin"] <= s[1] and s[2] <= f["end"] for f in r["fixed"])}
            hits, extra, wanted = hits + len(added & planned), extra + len(added - planned), wanted + len(planned)
    assert hits >= 0.95 * wanted and extra <= 0.02 * wanted and wanted > 300
    clean = pii.redacted(docs.where("doc_id is null"), model).collect()
    assert [r["text"] for r in clean] == ["<email>"] * 2


def test_nothing_to_find(spark, docs_of):
    for rows in ([], [(1, None), (2, "plain words")]):
        docs = docs_of(rows)
        model = pii.fit(docs)
        assert model.weights is None and all(r["fixed"] == r["added"] == [] for r in pii.find(docs, model).collect())


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    n = 0
    for r in queries.op13_pii(spark, sf).collect():
        want = stated(texts[r["doc_id"]] or "")
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert [r[f"n_{k}"] for k in STATED] == [sum(s[0] == k for s in want) for k in STATED]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r["spans"].split(",")) | {""}
        places = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert places == sorted(places)
        n += len(places)
    assert n > 10
