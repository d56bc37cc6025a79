import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tabulon.llm import pii, queries


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        t += x // 10 + x % 10
    return t % 10 == 0


def plain(text):
    """The fixed forms read straight from their definition."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_query_holds_the_fixed_forms(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(k == kind for k, *_ in want)


def test_forms_on_awkward_texts():
    for t in ("a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.3.4 0000000001.1.1.1", "4111 1111 1111 1111 +1 (555) 123-4567",
              "+1 4111-1111-1111-1111", "@@..++", "9" * 40, "4111111111111111@x.io", "\U0001f600 a@b.co", "+49 (0) 30 1234567 "):
        assert [(k, a, b) for a, b, k in pii.base_spans(t)] == plain(t), t


def spans(docs):
    return pii.find(docs).select("doc.*", "base", "found")


def planted(spark):
    phones = [f"+1 (555) {i:03d}-4567" for i in range(100, 112)]
    rows = [(i, f"for orders dial {p} today, please {i}") for i, p in enumerate(phones)]
    rows += [(100, "for orders dial 555-867-5309 today, thanks"), (101, "for orders dial 555 222 1234 today")]
    rows += [(200 + i, f"build number {1000000 + i} passed") for i in range(12)]  # never a seed there
    rows += [(300 + i, f"for orders dial {phones[0]} today, please 0") for i in range(40)]  # copies give no support
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_patterns_find_unseen_identifiers_only_in_their_context(spark):
    got = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.found] for r in spans(planted(spark)).collect()}
    assert got[100] == [("phone", "555-867-5309")] and got[101] == [("phone", "555 222 1234")]
    assert not any(v for k, v in got.items() if k not in (100, 101))


def test_copies_give_a_pattern_no_support(spark):
    rows = [(i, "write to ann dial +1 (555) 123-4567 now") for i in range(50)] + [(99, "write to ann dial 555-867-5309 now")]
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("found") > 0).count() == 0


def test_mask(spark):
    docs = planted(spark).withColumn("n_chars", F.lit(1))
    got = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert got[0] == "for orders dial [PHONE] today, please 0" and got[100] == "for orders dial [PHONE] today, thanks"
    assert got[200] == "build number 1000000 passed" and pii.mask(docs).columns == docs.columns


def test_odd_rows(odd, empty):
    assert pii.find(odd).count() == 10 and pii.find(empty).count() == 0 and pii.mask(empty).count() == 0
    assert sorted(map(str, pii.mask(odd).collect())) == sorted(map(str, odd.collect()))


def test_long_runs_take_linear_time():
    n = 300_000
    for t in ("x" * n + " @ at 1", "1" * n + ". @", "1a" * n + " .@", "+1" * n + "@", "+1" + "-" * n + "@", "a@" + "b" * n):
        start = time.perf_counter()
        pii.instances(t, pii.base_spans(t))
        assert time.perf_counter() - start < 10, t[:9]


def test_forms_on_random_strings():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice(rng.choice(("ab1@@..-_%+2 ", "123.. a", "+1 (2)-.3"))) for _ in range(rng.randint(1, 40)))
        assert [(k, a, b) for a, b, k in pii.base_spans(t)] == plain(t), t


def test_discovered_identifiers_support_further_patterns(spark):
    local = [f"555 {i} 1234" for i in range(200, 212)]
    rows = [f"for orders dial +1 (555) {i:03d}-4567 today, please" for i in range(100, 300)]
    rows += [f"for orders dial {p} today, please" for p in local]
    rows += [f"our own hotline {p} is open" for p in local]  # no seed stands in this context
    unseen = "our own hotline 555 999 4321 is open"
    rows += [unseen] + [f"build number {1000000 + i} passed" for i in range(12)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.text: [(s.kind, r.text[s.start : s.end]) for s in r.found] for r in spans(table).collect()}
    assert got[unseen] == [("phone", "555 999 4321")]
    assert not any(v for t, v in got.items() if t.startswith("build"))


def test_hidden_seeds_are_found_with_precision(spark):
    """Half of the phone numbers lack the plus sign of the fixed form, so only their contexts tell them."""
    r = random.Random(8)
    leads = ["call our hotline", "please phone", "dial now", "fax number is"]
    decoys = ["invoice no", "order ref", "part code", "batch"]
    words = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(26) for j in range(26)]
    rows, hidden = [], set()
    for i in range(600):
        digits = "".join(r.choice("0123456789") for _ in range(10))
        around = lambda: " ".join(r.choice(words) for _ in range(r.randint(3, 9)))
        kind = i % 3
        shown = f"+{digits}1" if kind == 0 else digits
        lead = r.choice(leads if kind < 2 else decoys)
        if kind == 1:
            hidden.add((i, shown))
        rows.append((i, f"{around()} {lead} {shown} {around()}"))
    got = {(x.doc_id, x.text[s.start : s.end]) for x in spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in x.found}
    assert len(got & hidden) / len(hidden) > 0.95 and len(got & hidden) / len(got) > 0.95


def test_clashing_names(spark):
    t = spark.createDataFrame([(1, "call +49 30 1234567890", 1, 2, 3, "x")], "doc_id long, text string, base int, row int, doc int, `a.b` string")
    assert pii.mask(t).collect()[0] == (1, "call [PHONE]", 1, 2, 3, "x") and pii.mask(t).columns == t.columns
