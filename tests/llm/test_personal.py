import random
import re

from vigil.llm import personal


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


def brute(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def odd_texts():
    rng = random.Random(11)
    pieces = ["@", ".", "a", "b1", "-", "_", "%", " ", "+", "1", "22", "255", "256", "(", ")", "é", "4539578763621486", "00", "\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(3000)]
    return texts + [
        "", "a@b.c@d.e a@b.c_d@e.f", "x" * 20_000, "1" * 3000, "1.2.3.4.5.6.7.8", "+1 (437) 555-0689",
        "4539 5787 6362 1486", "9" * 6000 + ".1.1.1", "1-" * 500, "a." * 5000 + "@x.y", "\U0001f600 me@x.org",
    ]


def test_base_spans_equal_the_patterns():
    for text in odd_texts():
        if re.search("[0-9]{4301}", text):
            continue  # int() in the brute force has a limit
        assert personal.base_spans(text) == brute(text), text[:80]
    assert personal.base_spans("9" * 6000 + ".1.1.1") == []


def test_detect_on_the_sample(spark, documents, sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    rows += [(None, None), (900, ""), (901, "mail me@x.org"), (901, "mail me@x.org"), (902, "z" * 100_000 + " a@b.cd")]
    got = personal.detect(documents(rows, "1 as base;2 as added;3 as _id;4 as kind;5 as spans")).collect()
    found = sorted((-1 if r._id is None else r._id, tuple(tuple(s) for s in r.base)) for r in got)
    assert found == sorted((d if d is not None else -1, tuple(brute(t or ""))) for d, t in rows)


def test_contexts_lead_to_unseen_identifiers(spark, documents):
    rows = [(i, f"the clerk wrote reach me at user{i}@mail.org today, thanks") for i in range(12)]
    rows += [(200, "the clerk wrote reach me at user99887[at]mail today, thanks"), (201, "reach me at user99887[at]mail today")]
    rows += [(300 + i, f"it was built in 18{i:03d} or so") for i in range(20)]
    got = {r._id: r for r in personal.detect(documents(rows)).collect()}
    text = dict(rows)[200]
    assert [(s.kind, text[s.start : s.end]) for s in got[200].added] == [(4, "user99887[at]mail")]
    assert [s.kind for s in got[201].added] == [4]
    assert not any(r.added for i, r in got.items() if i >= 300 or i < 100)


def test_contexts_lead_to_spaced_phones_and_cards(spark, documents):
    cards = [f"4539 5787 6362 {i:03d}" for i in range(20)]
    cards = [c + next(d for d in "0123456789" if luhn(c.replace(" ", "") + d)) for c in cards]
    rows = [(i, f"you can call me at +1 (437) 555-06{i:02d} today, and charge my card {c} instead") for i, c in enumerate(cards)]
    unseen = ["(030) 1234 5678", "555 123 4567", "0171 2345678", "030\xa01234-5678"]
    rows += [(100 + i, f"you can call me at {x} today") for i, x in enumerate(unseen)]
    wrong = next(f"4539 5787 6362 999{d}" for d in "0123456789" if not luhn("453957876362999" + d))
    rows += [(200, f"and charge my card {wrong} instead"), (201, "call me at (555 123 4567) today")]
    rows += [(300 + i, f"between 18{i:02d} and 1 234 5{i:02d} of them") for i in range(20)]
    texts, got = dict(rows), {r._id: r for r in personal.detect(documents(rows)).collect()}
    found = {i: [(personal.KINDS[s.kind], texts[i][s.start : s.end]) for s in r.added] for i, r in got.items()}
    assert [found[100 + i] for i in range(len(unseen))] == [[("context_phone", x)] for x in unseen]
    assert found[200] == [("context_card", wrong)] and found[201] == [("context_phone", "555 123 4567")]
    assert not any(found[i] for i in found if i >= 300 or i < 100)
    left = {r.doc_id: r.text for r in personal.redact(documents(rows)).collect()}
    assert left[100] == "you can call me at [PHONE] today" and left[200] == "and charge my card [CARD] instead"


def test_runs_of_digit_groups():
    def found(text):
        return [text[a:b] for a, b in personal.runs(text, sorted((a, b) for _, a, b in personal.base_spans(text)))]

    assert found("tel. (030) 1234 5678, or 12 34") == ["(030) 1234 5678"]
    assert found("10.1.2.3 555 123 4567 x@y.org 030 12 345") == ["555 123 4567", "030 12 345"]
    assert found("1 2 3 4 " * 20) == [] and found("a1 2345 678b 12 345c") == []
    assert found("9" * 100_000 + "x 12 3456 " + "1 " * 100_000) == []
    kept = [m[1:3] for m in personal.mentions("12345 " + "67890 " * 9, []) if m[0] < 0]
    assert len(kept) == 10  # more digits than one number has: each token by itself


def test_redact(spark, documents):
    rows = [(i, f"reach me at user{i}@mail.org today, or +1 (437) 555-068{i % 10}") for i in range(6)]
    rows += [(50, "nothing here"), (51, None), (52, ""), (None, "from 10.1.2.3 on"), (None, "from 10.1.2.3 on")]
    got = personal.redact(documents(rows, "'x' as redacted;7 as _key;8 as _own")).collect()
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got)
    assert texts[:2] == [(-1, "from [IP] on")] * 2
    assert (0, "reach me at [EMAIL] today, or [PHONE]") in texts and (50, "nothing here") in texts
    assert len(got) == len(rows) and not any(brute(t) for _, t in texts)
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "redacted", "_key", "_own"}


def test_empty_table(spark, documents):
    assert personal.detect(documents([])).collect() == []
    assert personal.redact(documents([])).collect() == []
