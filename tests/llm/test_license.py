"""License scans: held-out accuracy, planted paragraphs, n-grams and awkward rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.llm.license_scan import TEMPLATES, Model, ngrams, scan_licenses


@pytest.fixture(scope="module")
def model(spark):
    return Model(spark)


def test_held_out(model):
    best, p, y = model.held_out
    last = len(model.names) - 1
    given = np.where(p >= model.threshold, best, last)
    assert (given == y).mean() > 0.97 and (given[y == last] == last).mean() > 0.97


def test_ngrams(spark):
    for text in ("One, two  three-four", "x", "", "é ", "a b"):
        words = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
        want = [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(max(1, len(words) - n + 1))]
        got = spark.range(1).select(ngrams(F.lit(text)).alias("g")).first().g
        assert got == list(dict.fromkeys(want))


def test_scan(spark, model):
    rows = [(k, f"Some words here.\n\n{t}.\n\nMore words.", f) for k, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    rows += [(100, "he renewed the fishing license at the lake", None), (101, None, None), (102, "", None), (None, "x\nReleased under the MIT License.", "MIT"), (103, "no topic\nhere", None), (104, "w " * 50000 + "\nAll rights reserved.", "proprietary"), (104, "w " * 50000 + "\nAll rights reserved.", "proprietary")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = scan_licenses(df, model=model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    wrong = [(i, by.get(i)) for i, _, f in rows if f and not any(r.family == f and r.confirmed for r in by.get(i, []))]
    assert not wrong
    assert [r.family for r in by[100]] == ["unknown"] and not by[100][0].confirmed
    assert len(by[104]) == 2 and by[104][0].paragraph == 1 and not {101, 102, 103} & set(by)
    assert scan_licenses(df.limit(0), model=model).count() == 0


def test_notices_without_the_word_licence(spark, model):
    notices = ["Released under CC BY-SA 4.0", "Released under GPL v3", "Available under MIT", "Code: Apache-2.0", "Creative Commons Attribution 4.0 International", "SPDX: BSD-3-Clause", "CC0 1.0 Universal", "LGPLv2.1 or later", "AGPL-3.0", "MPL 2.0", "ISC", "Dual MIT/Apache", "Made available under CC-BY-NC 4.0"]
    rows = [(k, f"Some words here.\n\n{t}\n\nMore words.") for k, t in enumerate(notices)] + [(100, "Er kommt mit dem Bus, sie limit the account")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()
    assert sorted((r.doc_id, r.paragraph) for r in got) == [(k, 1) for k in range(len(notices))]
    family = {notices[r.doc_id]: r.family for r in got}
    assert family["Released under CC BY-SA 4.0"] == "CC-BY-SA" and family["Made available under CC-BY-NC 4.0"] == "CC-BY-NC"


def by_hand(model, text):
    """Plain Python: (paragraph, family, probability, similarity, confirmed) of every paragraph, gate or not."""
    from papyrion.llm.license_scan import TOPIC, softmax

    parts = re.split(r"\n(?:[\x20\t\r]*\n)+", text) if re.search(r"\n[\x20\t\r]*\n", text) else text.split("\n")
    for k, part in enumerate(parts):
        words = re.sub("[^a-z0-9]+", " ", part.lower()).strip(" ").split(" ")
        grams = set(words)
        for n in (2, 3):
            grams |= {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
        x = np.array([g in grams for g in model.grams], float)
        p = softmax((x @ model.weights.round(6) + model.bias)[None])[0]
        best = int(p.argmax())
        family = model.names[best] if best < len(model.names) - 1 and p[best] >= model.threshold else "unknown"
        near = max((sum(g in grams for g in shape) / len(shape) for f, shape in model.shapes if f == family), default=0.0)
        topic = re.search(TOPIC.replace("(?-i:", "(?-i:"), part) is not None
        if topic or family != "unknown":
            yield k, family, p[best], near, near >= model.contained


def test_scores_and_gate_by_hand(spark, model):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    every = [t for ts in TEMPLATES.values() for t in ts]
    docs += [(10_000 + k, f"First line of words\n{t}\nthe of and software") for k, t in enumerate(every)]
    docs += [(20_000, "\n\n".join(every)), (20_000, "\n\n".join(every)), (20_001, " \n \t\n"), (20_002, "mit " * 3000 + "\n" + "w " * 200_000 + every[0]), (20_003, "GNU\r\n\r\nMIT"), (20_004, "é GPL ß\nund mit dem Bus")]
    docs += [(30_000 + k, " ".join(g for g in model.grams[k :: 7])) for k in range(7)]
    got = {}
    for r in scan_licenses(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, p string"), model=model).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.probability, r.similarity, r.confirmed))
    for i, text in docs:
        want = [w for j, t in docs if j == i for w in by_hand(model, t)]
        mine = sorted(got.get(i, []))
        assert [(m[0], m[1], m[4]) for m in mine] == [(w[0], w[1], bool(w[4])) for w in sorted(want)], i
        assert np.allclose([m[2:4] for m in mine], [w[2:4] for w in sorted(want)], atol=1e-6) if mine else True
    assert 0 < len(model.gate) < len(model.grams)


def test_templates_that_were_never_seen(spark):
    out = ("Licensed under the BSD license", "Released under the GPL v3 license", "Licensed under CC BY 4.0", "All rights reserved", "Licensed under the Mozilla Public License 2.0", "Released under the MIT License")
    model = Model(spark, without=out)
    rows = [(k, f"Some words here.\n\n{t}.\n\nMore words.") for k, t in enumerate(out)]
    got = {r.doc_id: r.family for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    family = {t: f for f, ts in TEMPLATES.items() for t in ts}
    named = [k for k, t in enumerate(out) if got[k] != "unknown"]
    assert sum(got[k] == family[out[k]] for k in named) >= 0.75 * len(named)
