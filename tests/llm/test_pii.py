import hashlib
import itertools
import math
import random
import re
import time

from pyspark.sql import functions as F

from siltstone.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TEXTS = [
    None, "", "plain words", "a@b.c_d@e.f x.y+z@mail.example.com.", "@@a@b..c a@-.-", "🎉é me@x.org 🎉 1.2.3.4 256.1.1.1 001.02.3.4",
    "1.2.3.4.5.6.7.8 1.2.3 12345.6.7.8", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004",
    "+1 (706) 555-3138, +49 30 1234567 +1 2 +123456789012345678", "9" * 400 + " 4" + "1" * 15, "+" * 50 + "1" + " " * 3000 + "2",
    "x" * 20000 + "@", "call me@x.de at +44 20 7946 0958 from 10.0.0.1", "a@b.c\nd@e.f\r\n1.1.1.1", "4929 4929 4929 4929 4929 4929",
    "0 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "%a@b.co1@c.d",
]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS spans", "'x' AS found")
    for r in pii.find_pii(df).collect():
        want = brute(TEXTS[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.spans.startswith(joined), (TEXTS[r.doc_id], r.spans, joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r["values"][: len(want)] == [TEXTS[r.doc_id][a:b] for _, a, b in want]


def test_wider_spans_need_evidence(spark):
    rows = [(1, "please call (030) 1234 5678 today, my phone"), (2, "order number 123-45-6789"), (3, "ssn 123-45-6789"), (4, "iban DE89 3704 0044 0532 0130 00")]
    rows += [(10 + n, f"mail u{n}@mail{n}.example.com or call +1 (706) 555-31{n:02d}") for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert got[2] == "" and got[3] == "ident:4:15" and got[4].startswith("iban:5:")


def test_masking(spark):
    rows = [(1, "write me@x.org or +1 (706) 555-3138!", 5), (2, None, 6), (3, "é 4111 1111 1111 1111", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `extra.col` int")
    got = pii.mask_pii(df)
    assert got.columns == df.columns
    assert [r.text for r in sorted(got.collect())] == ["write <EMAIL> or <PHONE>!", None, "é <CARD>"]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_reliabilities_follow_agreement():
    good, bad = (1, 1, 1, 0, 1), (-1, -1, 0, -1, -1)
    belief = pii.estimate([("email", good, 500), ("ident", bad, 300), ("tel", good, 20)])
    assert belief["email", good] > 0.95 and belief["ident", bad] < 0.05 and belief["tel", good] > 0.9


def test_overlapping_spans_are_masked_as_one(spark):
    rows = [(1, "+14155550123@sms.example.com now"), (2, "10.0.0.1@host.example.com."), (3, "a@b.c" + " x" * 600 + " é d@e.f" * 300 + "!"), (4, ""), (5, None)]
    got = {r.doc_id: r.text for r in pii.mask_pii(spark.createDataFrame(rows, "doc_id long, text string"), {k: 0.0 for k in WEIGHTS}).collect()}
    assert got[1] == "<EMAIL> now" and got[2] == "<EMAIL>." and got[3] == "<EMAIL>" + " x" * 600 + " é <EMAIL>" * 300 + "!"
    assert got[4] == "" and got[5] is None


WEIGHTS = [*pii.KINDS, *pii.LABELERS, *(f"{f}{n}" for f, levels in pii.FEATURES.items() for n in range(levels))]


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(n, [rng.randint(-50, 50) for _ in range(size)]) for n, size in enumerate((0, 1, 2, 63, 64, 65, 128, 129, 4096, 4097, 20_000))]
    df = spark.createDataFrame(rows, "n int, v array<int>")
    add = pii.running(F.col("v"), F.lit(0), lambda a, b: a + b)
    top = pii.running(F.col("v"), F.lit(-99), F.greatest)
    for r in df.select("v", add.alias("add"), top.alias("top")).collect():
        assert r["add"] == list(itertools.accumulate(r.v)) and r.top == list(itertools.accumulate(r.v, max))


def test_very_long_text_of_addresses(spark):
    n = 160_000
    text = "".join(f"u{i}@mail.org " for i in range(n))
    df = spark.createDataFrame([(1, text + "(030) 1234 5678 phone")], "doc_id long, text string").cache()
    df.count()
    began = time.perf_counter()
    row = pii.find_pii(df, {k: 0.0 for k in WEIGHTS}).first()
    assert row.n_email == n and row.spans.startswith("email:0:11,email:12:23")
    assert pii.mask_pii(df, {k: 0.0 for k in WEIGHTS}).first().text == "<EMAIL> " * n + "(030) 1234 5678 phone"
    assert time.perf_counter() - began < 60


TEXT_VOTES = [
    "ring (030) 1234 5678 or 0171 5551 234", "please call 0171/5551234 today", "order no. 0171/5551234", "ssn 123-45-6789", "ticket 123-45-6789x",
    "id 000-12-3456", "iban DE89 3704 0044 0532 0130 00", "bank: GB29 NWBK 6016 1331 9268 19", "part XX12 3456 7890 1234", "write jo.doe [at] mail [dot] org",
    "see a-b (at) c-d", "mail me@x.org", "phone +1 (706) 555-3138", "mail 10.0.0.1 host", "4111 1111 1111 1111 visa",
]


def wide(text):
    """Wider candidates by Python's regular expressions: those that pass their check and touch no base span."""
    base, out = brute(text), []
    for kind, (_, pattern) in pii.WIDER.items():
        for m in re.finditer(pattern, text):
            if kind == "tel" and not 9 <= len(re.sub("[^0-9]", "", m[0])) <= 12:
                continue
            if not any(a < m.end() and m.start() < b for _, a, b in base):
                out.append((kind, m.start(), m.end()))
    return out


def ballot(text, kind, a, b):
    """The labelers' votes on a wider candidate, in plain Python."""
    value, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 12]
    tld = re.search(r"([A-Za-z0-9-]+)$", value)
    tld = tld[1].lower() if tld else ""
    shape = {
        "mail": 1, "tel": int(bool(re.search(r"^\(|^0[0-9]{2,4}[ /-]", value))), "ident": -1 if re.search("-00-|-0000$", value) else 1,
        "iban": int(15 <= len(value.replace(" ", "")) <= 34),
    }[kind]
    list_ = {
        "mail": 1 if tld in pii._TLDS else -1, "tel": 0, "ident": -1 if re.search("^(?:000|666|9)", value) else 0,
        "iban": 1 if value[:2] in pii._IBAN_LANDS else -1,
    }[kind]
    glued = re.search(r"[A-Za-z0-9_./=-]$", before) or re.search(r"^[A-Za-z0-9_/=-]|^\.[A-Za-z0-9]", after)
    return shape, list_, int(bool(re.search(f"(?i){pii._CUES[kind]}", before))), -int(bool(re.search(pii._CONTRARY, before))), -1 if glued else 1


def test_added_spans_match_an_independent_version(spark):
    texts = TEXT_VOTES * 3 + [t for t in TEXTS if t]
    weights = {k: 0.0 for k in WEIGHTS} | {"format": 1.0, "gazetteer": 0.7, "context": 1.1, "contrary": 1.5, "boundary": 0.9, "tel": -0.4, "length1": 0.3, "digits2": 0.2, "separators3": -0.2}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = 0
    for r in pii.find_pii(df, weights, 0.85).collect():
        text, want = texts[r.doc_id], []
        for kind, a, b in wide(text):
            value = text[a:b]
            levels = (min(len(value) // 8, 4), 3 * sum(c in "0123456789" for c in value) // len(value), min(sum(c in " ./()[]-" for c in value), 3), int(bool(re.search("[A-Z]", value))))
            margin = weights[kind] + sum(weights[n] * v for n, v in zip(pii.LABELERS, ballot(text, kind, a, b)))
            margin += sum(weights[f"{f}{n}"] for f, n in zip(pii.FEATURES, levels))
            if margin >= math.log(0.85 / 0.15):
                want.append((kind, a, b))
        added += len(want)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in [*brute(text), *want]), text
    assert added > 10
