"""Personal data by candidate gradient boosting, in Spark expressions only.

Four base kinds (email, ip, card, phone) are found by fixed patterns and checks and always
stay.  High-recall generators propose further, overlapping spans: loose numbers, national ids,
account numbers, written-out addresses and secrets after a key word.  Boosted trees over format
and context features score each proposal; the model is fitted on synthetic labelled sentences
that go through the same generators and feature expressions, and one half of them calibrates
a threshold for each kind.  A proposal above its threshold that doesn't overlap a base span is
a span too.

All work on a document is array expressions on its row: no shuffle, no Python.  Patterns are
possessive or bounded, so no text makes them recurse or backtrack without limit, and positions
come from the lengths of the pieces between matches.

Null texts count as empty and have no spans.  Repeated rows, null ids and empty tables keep
their rows; other columns are ignored by ``find_pii`` and kept by ``redact``.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm.boosting import Boosted, calibrate
from papyrion.llm.rows import quoted, whole

#: Kinds in the order of spans with the same start.
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
BASE = KINDS[:4]

# Base patterns, without backtracking.  A look-behind keeps a match from being
# tried again inside a run that failed as a whole; \G lets it follow the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Generators of further spans.
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,5})(?:[\x20.-]{0,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])"
LOOSE_CARD = r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9A-Za-z])"
SSN = r"(?<![0-9-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
WRITTEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,5}"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
SECRET = r"(?i)(?<=(?:token|api.?key|access.?key|secret|password|passwd|bearer)[\"']?\x20{0,3}[:=]?\x20{0,3}[\"']?)(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-][A-Za-z0-9_+/=-]{7,}+"

# Context words before a span.
CONTEXT = {
    "phone": r"(?i)phone|tel\b|tel[.:]|call|mobile|cell|fax|dial|whatsapp|ring",
    "card": r"(?i)card|visa|mastercard|amex|credit|debit|payment",
    "ssn": r"(?i)ssn|social|national id|tax id|insurance",
    "bank": r"(?i)iban|bank|account|transfer|swift",
    "mail": r"(?i)mail|contact|write|reach|address",
    "secret": r"(?i)token|key|secret|passw|bearer|auth",
    "other": r"(?i)version|isbn|order|invoice|serial|build|page|figure|table|section|year|id\b|#|total|ratio|score|part|tracking",
}


def _guard(text: Column, needs: str, spans: Column) -> Column:
    """The spans where the text has what any match needs; the pattern isn't tried elsewhere."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,v:string,l:string,r:string>>)")
    return F.when(text.rlike(needs), spans).otherwise(empty)


def matches(text: Column, pattern: str, needs: str, around: int = 32, chunk: int = 256) -> Column:
    """array<start, end, v, l, r> of the leftmost non-overlapping matches, with text beside them.

    Starts are running sums of lengths, by chunks: for n matches n * chunk / 2 + (n / chunk) ** 2 / 2 additions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def build(m: Column, p: Column) -> Column:
        steps = F.transform(m, lambda x, i: (F.length(F.element_at(p, i + 1)) + F.length(x)).cast("bigint"))

        def placed(s: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / chunk).cast("int")), lambda c: F.aggregate(F.slice(s, c * chunk + 1, F.lit(chunk)), F.lit(0).cast("bigint"), lambda a, x: a + x))

            def start(totals: Column) -> Column:
                return F.flatten(
                    F.transform(
                        F.transform(totals, lambda t, c: F.aggregate(F.slice(totals, F.lit(1), c), F.lit(0).cast("bigint"), lambda a, x: a + x)),
                        lambda base, c: F.transform(
                            F.slice(m, c * chunk + 1, F.lit(chunk)),
                            lambda x, i: F.struct(
                                (base + F.aggregate(F.slice(s, c * chunk + 1, i), F.lit(0).cast("bigint"), lambda a, y: a + y) + F.length(F.element_at(p, c * chunk + i + 1))).alias("start"),
                                x.alias("v"),
                                F.substring(F.element_at(p, c * chunk + i + 1), -around, around).alias("l"),
                                F.substring(F.element_at(p, c * chunk + i + 2), 1, 8).alias("r"),
                            ),
                        ),
                    )
                )

            return _let(chunks, start)

        spans = _let(steps, placed)
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["v"])).alias("end"), x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r")))

    both = F.struct(found.alias("m"), F.split(text, pattern, -1).alias("p"))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,v:string,l:string,r:string>>)")
    return _guard(text, needs, _let(both, lambda b: F.when(F.size(b["m"]) == 0, empty).otherwise(build(b["m"], b["p"]))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _base(name: str, text: Column) -> Column:
    if name == "email":
        return matches(text, EMAIL, "@")
    if name == "ip":
        return F.filter(matches(text, IP, r"[0-9]\.[0-9]"), lambda x: x["v"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
    if name == "card":
        return F.filter(matches(text, CARD, r"[0-9](?:[\x20-]?[0-9]){11}"), lambda x: F.length(_digits(x["v"])).between(12, 19) & F.call_function("luhn_check", _digits(x["v"])))
    return F.filter(matches(text, PHONE, r"\+[0-9]"), lambda x: F.length(_digits(x["v"])).between(9, 15))


def _proposals(text: Column) -> list[tuple[str, Column]]:
    return [
        ("phone", matches(text, LOOSE_PHONE, r"[0-9]{2}")),
        ("card", matches(text, LOOSE_CARD, r"[0-9]{4}[\x20.-]?[0-9]{4}")),
        ("ssn", matches(text, SSN, r"[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}")),
        ("iban", matches(text, IBAN, r"[A-Z]{2}[0-9]{2}")),
        ("email", matches(text, WRITTEN_EMAIL, r"[\[(]at[\])]|\x20dot\x20|[\[(]dot[\])]|\x20at\x20[A-Za-z0-9-]+\.[A-Za-z]")),
        ("ip", matches(text, IPV6, r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")),
        ("secret", matches(text, SECRET, r"(?i)token|key|secret|passw|bearer")),
    ]


def _features(kind: int, x: Column) -> Column:
    """Format and context features of a candidate, all doubles."""
    v, left, right = x["v"], x["l"], x["r"]
    digits = _digits(v)
    n = F.length(v)
    known = [
        F.lit(kind), n, F.length(digits), F.length(F.regexp_replace(v, "[^A-Za-z]", "")), F.length(F.regexp_replace(v, "[^A-Z]", "")),
        F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")), F.when(F.length(digits) > 11, F.call_function("luhn_check", digits)).otherwise(F.lit(False)).cast("int"),
        v.rlike(r"^\(").cast("int"), v.rlike(r"[\[(]at[\])]").cast("int"), v.rlike(r"dot").cast("int"), v.rlike("^[0-9a-fA-F]+$").cast("int"),
        left.rlike(r"[A-Za-z0-9./]\x20?$").cast("int"), right.rlike(r"^\x20?[.:,/]?[0-9]").cast("int"), left.rlike("[=:]").cast("int"),
        *[left.rlike(words).cast("int") for words in CONTEXT.values()],
    ]
    return F.array(*[f.cast("double") for f in known])


def _of_kind(kind: int, scored: bool):
    """Spans as (start, kind, end), with features if they are to be scored."""

    def made(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), *([_features(kind, x).alias("f")] if scored else []))

    return made


def candidates(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with __base (array of kind, start, end) and __more (proposals with features)."""
    t = F.col(text)
    found = rows.withColumns({f"__b{k}": _base(name, t) for k, name in enumerate(BASE)} | {f"__p{k}": spans for k, (_, spans) in enumerate(_proposals(t))})
    base = F.flatten(F.array(*[F.transform(f"__b{k}", _of_kind(k, False)) for k in range(len(BASE))]))
    more = F.flatten(F.array(*[F.transform(f"__p{k}", _of_kind(KINDS.index(name), True)) for k, (name, _) in enumerate(_proposals(t))]))
    return found.select(*rows.columns, base.alias("__base"), more.alias("__more"))


def training_sentences(n: int = 1600, seed: int = 11) -> list[tuple[str, str]]:
    """Synthetic (kind, sentence): proposals of that kind are right, others (all of them if the kind is empty) wrong."""
    rng = random.Random(seed)

    def d(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def pick(*options: str) -> str:
        return rng.choice(options)

    def name() -> str:
        return pick("anna", "j.doe", "max", "info", "maria.lopez", "tom_b") + pick("", d(2))

    def luhn() -> str:
        body = pick("4", "5", "37") + d(13)
        body = body[:15]
        total = sum(int(c) if k % 2 else (2 * int(c) if int(c) < 5 else 2 * int(c) - 9) for k, c in enumerate(body))
        return body + str(-total % 10)

    def yes() -> tuple[str, str]:
        return rng.choice(
            [
                ("phone", f"{pick('Call me at', 'please call', 'phone:', 'Tel.', 'mobile', 'fax', 'reach us by phone')} {pick(f'({d(3)}) {d(3)}-{d(4)}', f'{d(3)}-{d(3)}-{d(4)}', f'{d(3)}.{d(3)}.{d(4)}', f'0{d(2)} {d(4)} {d(4)}')}"),
                ("card", f"{pick('card number', 'my visa is', 'credit card', 'paid by card')} {pick(luhn(), '.'.join([luhn()[k : k + 4] for k in (0, 4, 8, 12)]))}"),
                ("ssn", f"{pick('SSN', 'SSN is', 'social security number', 'tax id')} {d(3)}-{d(2)}-{d(4)}"),
                ("iban", f"{pick('IBAN', 'bank account', 'transfer to')} {pick('DE', 'FR', 'ES', 'GB')}{d(2)}{pick('', ' ')}{d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"),
                ("email", f"{pick('mail', 'write to', 'contact', 'reach me')} {name()} {pick('(at)', '[at]')} example{pick(' (dot) ', ' [dot] ', '.')}{pick('com', 'org')}"),
                ("email", f"{pick('email', 'contact')} {name()} at example dot {pick('com', 'net')}"),
                ("ip", f"{pick('from', 'client', 'host')} {':'.join(pick('2001', 'db8', 'fe80', d(4), 'a1b2') for _ in range(8))}"),
                ("secret", f"{pick('token', 'api_key', 'secret', 'password', 'access_key')}{pick(' = ', ': ', '=')}{pick('', chr(34))}{pick(''.join(rng.choice('0123456789abcdef') for _ in range(40)), ''.join(rng.choice('ABCDEFabcdefghijkXYZ0123456789') for _ in range(24)))}{pick('', chr(34))}"),
            ]
        )

    def no() -> str:
        return pick(
            f"{pick('order', 'invoice', 'tracking', 'serial', 'part', 'build')} {pick('', 'no. ', '#')}{pick(d(10), d(4) + '-' + d(4), d(3) + '-' + d(5), d(12))}",
            f"in {pick('19', '20')}{d(2)}-{d(2)}-{d(2)} and {pick('19', '20')}{d(2)}",
            f"{pick('version', 'section', 'figure', 'table')} {d(2)}.{d(2)}.{d(2)}",
            f"{pick('ISBN', 'score', 'total', 'ratio')} {pick('978-' + d(1) + '-' + d(4) + '-' + d(4) + '-' + d(1), d(5) + '.' + d(4), d(3) + ' ' + d(3))}",
            f"{pick('digits', 'values', 'the series', 'pages', 'rows')} {' '.join(d(rng.randrange(2, 5)) for _ in range(rng.randrange(2, 6)))} {pick('follow', 'end', 'were seen')}",
            f"{pick('number', 'id', 'total', 'sum')} {d(16)}",
            f"{pick('code', 'part')} {pick('AB', 'XQ', 'ZZ')}{d(2)} {pick('KEYS', 'PART', 'UNIT')} {pick('MORE', 'THIS')} {pick('THAT', 'DATA')}",
            f"we {pick('looked', 'met', 'stayed', 'arrived')} at {pick('home', 'noon', 'once', 'last')}.{pick('Then', 'We', 'It')} {pick('left', 'went')}",
            f"the {pick('token', 'key', 'secret', 'password')} {pick('distribution', 'management', 'ingredient', 'requirements', 'generation')} {pick('of', 'for')} everyone",
            f"{pick('a', 'the')} {d(3)}-{d(2)}-{d(4)} {pick('code', 'part', 'offset')} of the {pick('section', 'build')}",
        )

    return [yes() if k % 2 else ("", no()) for k in range(n)]


class Model:
    """Trees and a threshold for each kind, fitted through the same expressions as the data."""

    def __init__(self, spark: SparkSession, precision: float = 0.97, n: int = 1600):
        joined = "\x1e".join(f"{kind}\x1f{text}" for kind, text in training_sentences(n))
        rows = spark.range(1).select(F.explode(F.split(F.lit(joined), "\x1e")).alias("s"))
        rows = rows.select(F.substring_index("s", "\x1f", 1).alias("kind"), F.substring_index("s", "\x1f", -1).alias("__text"), F.pmod(F.xxhash64("s"), F.lit(2)).alias("fold"))
        sentences = candidates(rows, "__text").select("kind", "fold", F.col("__more.f").alias("fs")).collect()
        at = np.array([k for k, r in enumerate(sentences) for _ in r.fs])
        x = np.array([f for r in sentences for f in r.fs])
        fold = np.array([r.fold for r in sentences])[at]
        y = np.array([sentences[k].kind == KINDS[int(f[0])] for k, f in zip(at, x, strict=True)], float)
        self.trees = Boosted(x[fold == 0], y[fold == 0])
        held = fold == 1
        score = self.trees.score(x)
        self.thresholds = [calibrate(score[held & (x[:, 0] == k)], y[held & (x[:, 0] == k)], precision) for k in range(len(KINDS))]
        self.held_out = score[held], y[held], x[held, 0]
        hit = {int(k) for k in at[(score >= np.array(self.thresholds)[x[:, 0].astype(int)]) & (y == 1)]}
        #: Share of the held-out sentences of a kind in which it is found; sentences without a proposal count as missed.
        self.recall = {kind: float(np.mean([k in hit for k, r in enumerate(sentences) if r.fold == 1 and r.kind == kind])) for kind in sorted({r.kind for r in sentences} - {""})}

    def selects(self, more: Column) -> Column:
        """Whether a proposal passes the threshold of its kind."""
        limit = F.element_at(F.array(*[F.lit(t) for t in self.thresholds]), more["kind"] + 1)
        return self.trees.column(lambda f: more["f"][f]) >= limit


def find_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row: the document's columns as a struct, text, base, spans: sorted arrays of (start, kind, end)); code points, end exclusive."""
    rows = candidates(docs.select(whole(docs).alias("__row"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("__text")), "__text")
    chosen = F.filter("__more", lambda m: model.selects(m) & ~F.exists(F.col("__base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    added = F.array_distinct(F.transform(chosen, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))))
    return rows.withColumn("__added", added).select(F.col("__row").alias("row"), F.col("__text").alias("text"), F.array_sort("__base").alias("base"), F.array_sort(F.concat("__base", "__added")).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per document."""
    model = model or Model(docs.sparkSession)
    found = find_spans(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t")), model, "t")
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select(F.col("row.id").alias(id_col), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans once, null stays null.

    Other columns stay, whatever their names.  Pieces are appended in a fold, so the work grows with the square of a document's spans.
    """
    model = model or Model(docs.sparkSession)
    names = F.array(*map(F.lit, KINDS))
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        ahead = s["start"] >= a["at"]
        piece = F.concat(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(F.element_at(names, s["kind"] + 1)), F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(ahead, F.array_append(a["parts"], piece)).otherwise(a["parts"]).alias("parts"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    done = F.aggregate("spans", begin, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    found = find_spans(docs, model, text_col)
    return found.select(*[(F.when(F.col("row")[c].isNotNull(), done) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
