"""Personal data: base spans against Python's patterns, the model on held-out sentences, awkward rows."""

import hashlib
import random
import re

import pytest

from papyrion.llm.pii import KINDS, Model, find_pii, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def base(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": name != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def texts():
    rng = random.Random(7)
    out = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 1.2.3.444 01.002.3.255 256.1.1.1.1", "+1 (743) 555-3824 éà 😀 +49-30-1234567 +1 2", "4111 1111 1111 1111 and 4111111111111111 4111111111111112"]
    for _ in range(400):
        alphabet = rng.choice(["ab@.-_ 1", "0123456789. ", "0123456789 -", "+0123456789 ().-", "é😀a@b.c 12", "4111 -", "a.@"])
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))))
    out += [" ".join(f"u{k}@h{k}.org" for k in range(700)), "7" * 60000, "a" * 100000 + "@", "+" + "1 " * 40000, ". " * 1000 + "x@y.zz 10.0.0.1"]
    return out


@pytest.fixture(scope="module")
def model(spark):
    return Model(spark)


def test_base_spans(spark, model):
    data = [(k, t, "x", 1) for k, t in enumerate(texts())] + [(None, "a@b.cc", None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, spans string, __text int").repartition(4)
    got = {r.doc_id: r for r in find_pii(df, model=model).collect()}
    assert len(got) == len(data)
    for i, t, *_ in data:
        want = base(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[1] == k for w in want) for k in range(4)), t[:80]
        joined = ",".join(f"{n}:{a}:{b}" for a, _, b, n in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t[:80]
        spans = [s for s in r.spans.split(",") if s]
        assert set(joined.split(",") if joined else []) <= set(spans)
        keys = [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert keys == sorted(keys)
    assert find_pii(df.limit(0), model=model).count() == 0


def test_model_on_held_out_sentences(model):
    score, y, kind = model.held_out
    chosen = score >= [model.thresholds[int(k)] for k in kind]
    assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.9


def test_added_spans_and_redaction(spark, model):
    rows = [
        (1, 'ab token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" cd', "secret"),
        (2, "please call (743) 555-3824 today", "phone"),
        (3, "write to anna (at) example (dot) com soon", "email"),
        (4, "her SSN is 123-45-6789.", "ssn"),
        (5, "in 1999 and 2004 the order no. 12345678 came", None),
        (6, "Er 😀 mail: x@y.org, 10.0.0.1!", None),
        (7, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = {r.doc_id: r.spans for r in find_pii(df, model=model).collect()}
    for i, _, kind in rows[:4]:
        assert got[i].split(":")[0] == kind, (i, got[i])
    assert got[5] == ""
    clean = redact(df, model=model)
    assert clean.columns == df.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[1] == 'ab token = "[SECRET]" cd' and text[6] == "Er 😀 mail: [EMAIL], [IP]!" and text[7] is None and text[5] == rows[4][1]


def test_the_trees_as_an_expression(spark, model):
    from papyrion.llm.pii import candidates
    from pyspark.sql import functions as F

    texts = ["call (743) 555-3824 or 12345 67890", "password=24be64439e3e49cf46b2d7c9 x", "id 123-45-6789 at 4111.1111.1111.1111", "IBAN DE12 3456 7890 1234 5678 90"]
    rows = candidates(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select(F.explode("__more").alias("m"))
    found = rows.select("m.f", model.trees.column(lambda f: F.col("m.f")[f]).alias("score"), model.selects(F.col("m")).alias("chosen")).collect()
    assert len(found) >= 5
    for r in found:
        score = float(model.trees.score(__import__("numpy").array([r.f]))[0])
        assert abs(score - r.score) < 1e-9 and r.chosen == (score >= model.thresholds[int(r.f[0])])


def test_recall_counts_what_was_never_proposed(model):
    assert set(model.recall) == {"phone", "card", "ssn", "iban", "email", "ip", "secret"}
    assert min(model.recall.values()) >= 0.8 and sum(model.recall.values()) / len(model.recall) >= 0.9


def test_sentences_from_elsewhere(spark, model):
    rows = [
        ("password=24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "secret"), ("export API_KEY=Zk39fj2LqPx81mNvbT5sYw7e", "secret"), ("token: " + "0123456789abcdef" * 15, "secret"),
        ("Authorization: Bearer abcDEF0123456789abcDEF0123456789", "secret"), ("My number is (415) 555-0132, call me after six.", "phone"), ("His social security number: 078-05-1120", "ssn"),
        ("Please transfer the rent to IBAN DE89 3704 0044 0532 0130 00", "iban"), ("contact jane.roe [at] mail [dot] org", "email"), ("the host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 answered", "ip"),
    ]
    clean = ["Chapter 12 covers 1914 to 1918 in 320 pages.", "The password policy requires eight characters.", "Order 2024-0017 shipped on 2024-05-06.", "See section 4.12.7 of version 10.2.3", "a key ingredient of the recipe"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([r[0] for r in rows] + clean)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in find_pii(df, model=model).collect()}
    caught = [kind in {s.split(":")[0] for s in got[k].split(",")} for k, (_, kind) in enumerate(rows)]
    assert sum(caught) >= 8 and all(caught[:3]), (caught, got)
    assert sum(got[len(rows) + k] == "" for k in range(len(clean))) >= 4


def test_redaction_keeps_columns_of_any_name(spark, model):
    df = spark.createDataFrame([(1, "mail a@b.cc", "keep", "me", 3)], "doc_id long, text string, __text string, spans string, `x.y` int")
    assert [tuple(r) for r in redact(df, model=model).collect()] == [(1, "mail [EMAIL]", "keep", "me", 3)]
