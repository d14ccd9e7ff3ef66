"""Language identification by Bayesian fusion of evidence.

The posterior of a document's language multiplies four kinds of evidence:

* its text: letter trigrams under a model per language, and under a flat model that stands for
  any other language (``und``); the log-likelihood is tempered, as trigrams aren't independent;
* the declared language (``lang`` of the markup, or a metadata column), believed with ``trust``;
* the country suffix of its address, believed with ``suffix_trust``;
* the prior of its host: expected language counts of the host's documents, from a grouped
  aggregation of the text posteriors, smoothed towards the parent domain's and those towards
  the corpus's.  A document's own share is taken out of its prior.

The trigram models are fitted on about ``sample`` labelled rows (chosen by a hash of the
row), besides a few function words of each known language.  Rows fall into two folds by the same
hash and each fold is scored by the model of the other one, so a row's own declaration never
speaks through its text's likelihood as well.

Each text is scored once: its log-likelihoods are written beside the evidence that is no text,
and the host's prior, the fusion and the choice read only that small table.

A document is accepted if its best language isn't ``und`` and has a posterior of at least
``least``.  Texts without letters (null and empty ones too) get ``und`` and aren't accepted.
Null hosts share one prior; null or unknown declarations and suffixes say nothing.  Repeated
rows are separate documents; an empty table gives an empty result; other columns stay, whatever
their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.llm.rows import columns, fresh, quoted
from papyrion.llm.vocabulary import forget
from papyrion.workspace import materialize

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")

# Common function words by language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu den im für auf dem sich des auch es an werden aus er hat dass sie nach wird bei",
    "en": "the of and to in is that it was for on are as with his they be at one have this from or had by not but what all were we when your can said",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son nous vous mais ou leur cette être",
}
# Languages that a country suffix suggests.
SUFFIXES = {"at": "de", "de": "de", "ch": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "fr": "fr", "be": "fr"}


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        made = pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "gram": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([counts[k] for k in keys], pa.int64())})
        counts.clear()
        return made

    for batch in batches:
        for label, text in zip(batch.column(0), batch.column(1), strict=True):
            words = Counter(LETTERS.findall((text.as_py() or "").lower()))
            for word, n in words.items():
                for gram in trigrams(word):
                    counts[label.as_py(), gram] += n
            if len(counts) > 200_000:
                yield flush()
    yield flush()


class TextModel:
    """Trigram log-probabilities: ``names`` with ``und`` last, ``grams`` -> row, and the rows."""

    def __init__(self, counts: dict[tuple[str, str], int], smoothing: float = 0.5, names: list[str] | None = None):
        self.names = sorted({k[0] for k in counts} | set(names or []))
        grams = sorted({k[1] for k in counts})
        self.grams = {g: i for i, g in enumerate(grams)}
        table = np.zeros((len(grams) + 1, len(self.names)))  # the last row is for unseen trigrams
        for (lang, gram), n in counts.items():
            table[self.grams[gram], self.names.index(lang)] += n
        seen = table.sum(axis=0)
        seen[seen == 0] = 100  # a language without rows: as if it had been seen in other trigrams only
        table = np.log((table + smoothing) / (seen + smoothing * len(table)))
        flat = np.full((len(table), 1), -np.log(len(table)))
        self.logs = np.concatenate([table, flat], axis=1)
        self.names.append(UNKNOWN)

        self._letters = sorted({c for g in grams for c in g if c != " "})

    def tables(self) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """(class of each code point, classes, sorted trigram codes, row of each code): 0 is no letter, 1 an unknown one."""
        classes = np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), np.uint16, 0x110000)
        for k, letter in enumerate(self._letters):
            classes[ord(letter)] = k + 2
        size = len(self._letters) + 2
        place = {" ": 0} | {c: k + 2 for k, c in enumerate(self._letters)}
        codes = np.array([(place[g[0]] * size + place[g[1]]) * size + place[g[2]] for g in self.grams], np.int64)
        order = np.argsort(codes)
        return classes, size, codes[order], np.array(list(self.grams.values()), np.int64)[order]


def spot(rows: DataFrame) -> Column:
    """A number of 31 bits from a hash of the row."""
    return F.pmod(F.xxhash64(*hashable(rows)), F.lit(1 << 31))


def hashable(rows: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]


def fit_text_models(rows: DataFrame, text_col: str, label_col: str, sample: int = 2000, per_language: int = 200, folds: int = 1, spot_col: str | None = None) -> list[TextModel]:
    """For each fold a model of the other folds' rows (of all rows, if there is one fold), with the same languages.

    Labels are counted over all rows, and each language gives its part of the sample, but about
    ``per_language`` rows at least (all, if it has fewer), so no declared language is without a
    model.  The rows whose hash (of all columns) is below their language's limit are taken where
    they lie; the limit is above the language's smallest hash.  Repeated rows share their hash and
    count once, so the sample is about ``sample`` rows however often one is repeated.  The pattern
    bounds the number of labels.  A language that only one fold has gets, for that fold, a model that knows none of the trigrams.
    """
    lang = F.regexp_extract(F.lower(F.trim(F.col(label_col))), r"^([a-z]{2,3})(?:[-_]|$)", 1)
    labelled = rows.select(lang.alias("lang"), F.col(text_col).alias("t"), (F.col(spot_col) if spot_col else spot(rows)).alias("spot")).where((F.col("lang") != "") & (F.col("lang") != UNKNOWN))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("spot").alias("first")).collect()
    total = sum(r.n for r in sizes)
    limits = [(r.lang, max(int(min(1.0, max(sample / total, per_language / r.n)) * (1 << 31)), r.first + 1)) for r in sizes]
    limits = rows.sparkSession.createDataFrame(limits, "lang string, bound long")
    chosen = labelled.join(F.broadcast(limits), "lang").where("spot < bound").groupBy("lang", "spot").agg(F.first("t").alias("t"))
    fold = F.pmod(F.col("spot"), F.lit(folds)).cast("string")
    counts = chosen.select(F.concat_ws(" ", fold, "lang").alias("lang"), "t").mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    by_fold: list[Counter] = [Counter() for _ in range(folds)]
    for r in counts:
        at, label = r.lang.split(" ")
        for k in range(folds):
            if folds == 1 or int(at) != k:
                by_fold[k][label, r.gram] += r.n
    names = [r.lang for r in sizes]
    for found in by_fold:
        for name, words in FUNCTION_WORDS.items():
            for word in words.split():
                for gram in trigrams(word):
                    found[name, gram] += 1
    return [TextModel(found, names=names) for found in by_fold]


def fit_text_model(rows: DataFrame, text_col: str, label_col: str, sample: int = 2000, per_language: int = 200) -> TextModel:
    """One model of all sampled rows, for texts that aren't among them."""
    return fit_text_models(rows, text_col, label_col, sample, per_language)[0]


class Scorer:
    """Tempered text log-likelihoods: each letter adds the log-probability of it and its neighbours.

    Texts are taken in blocks, so besides the text itself the memory is constant.
    """

    def __init__(self, model: TextModel, temper: float, block: int = 1 << 16):
        self.temper, self.block = temper, block
        self.classes, self.size, self.codes, self.rows = model.tables()
        self.logs = model.logs
        self.unseen = len(model.grams)
        self.dense = None
        if self.size <= 128:
            self.dense = np.full(self.size**3, self.unseen, np.int32)
            self.dense[self.codes] = self.rows

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.rows[at], self.unseen)

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """(log-likelihood by language, number of letters)."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        total, letters = np.zeros(self.logs.shape[1]), 0
        for at in range(0, len(points), self.block):
            part = self.classes[points[max(0, at - 1) : at + self.block + 1]].astype(np.int64)
            part = np.concatenate([[0] * (at == 0), part, [0] * (at + self.block >= len(points))]).astype(np.int64)
            centre = np.flatnonzero(part[1:-1]) + 1
            codes = (part[centre - 1] * self.size + part[centre]) * self.size + part[centre + 1]
            total += np.bincount(self._rows(codes), minlength=len(self.logs)) @ self.logs
            letters += len(centre)
        return self.temper * total, letters


@lru_cache(maxsize=2)
def _scorer(key: str, data: bytes, temper: float) -> Scorer:
    return Scorer(pickle.loads(data), temper)


def shared_scorer(model: bytes, temper: float) -> Scorer:
    """This process's scorer of a pickled model, kept from task to task."""
    return _scorer(hashlib.sha256(model).hexdigest(), model, temper)


def normalised(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max())
    return p / p.sum()


def declared_logs(names: list[str], said: str | None, trust: float) -> np.ndarray:
    """Log-likelihood of a declaration that is right with probability ``trust``."""
    code = (said or "").strip().lower().replace("_", "-").split("-")[0]
    if code not in names:
        return np.zeros(len(names))
    return np.log(np.where(np.array(names) == code, trust, (1 - trust) / max(1, len(names) - 1)))


def _scored(models: list[TextModel], temper: float):
    """mapInArrow function that replaces (text, spot) by the log-likelihoods and the number of letters."""
    data = [pickle.dumps(m) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorers = [shared_scorer(d, temper) for d in data]
        for batch in batches:
            found = [scorers[at % len(scorers)].score(text.as_py() or "") for text, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
            logs = pa.array([x.tolist() for x, _ in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], logs, pa.array([n for _, n in found], pa.int64())], names=[*batch.schema.names[2:], "logs", "letters"])

    return run


def host_priors(scored: DataFrame, size: int, strength: float) -> DataFrame:
    """Written table (host, parent, mass array, base array): the host's expected counts and its smoothed parent distribution.

    scored (host, parent, logs, letters).  Sums are combined map-side, so a hot host costs nothing.
    """
    own = posterior(F.col("logs"))
    soft = scored.where("letters > 0").select("host", "parent", own.alias("p"))
    hosts = materialize(soft.groupBy("host", "parent").agg(*[F.sum(F.col("p")[k]).alias(f"m{k}") for k in range(size)]), "hosts")
    parts = [f"m{k}" for k in range(size)]
    top = hosts.agg(F.array(*[F.coalesce(F.sum(m), F.lit(0.0)) for m in parts]).alias("top"))
    parents = hosts.groupBy("parent").agg(F.array(*[F.sum(m) for m in parts]).alias("up"))

    def smooth(mass: str, base: Column) -> Column:
        total = F.aggregate(mass, F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.arrays_zip(F.col(mass).alias("m"), base.alias("b")), lambda x: (x["m"] + strength * x["b"]) / (total + strength))

    even = F.array(*[F.lit(1.0 / size)] * size)
    parents = parents.join(F.broadcast(top)).withColumn("base", smooth("up", smooth("top", even))).select(F.col("parent").alias("__p"), "base")
    joined = hosts.join(parents, F.col("parent").eqNullSafe(F.col("__p")))
    return materialize(joined.select("host", "parent", F.array(*parts).alias("mass"), "base"), "priors")


def posterior(logs: Column) -> Column:
    """An array of log-likelihoods as probabilities."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _fused(names: list[str], trust: float, suffix_trust: float, strength: float, least: float):
    """mapInArrow function from (logs, letters, said, suffix, mass, base) and other columns to the decision and those columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for logs, letters, said, suffix, mass, base in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                if not letters:
                    out.append((UNKNOWN, 0.0, UNKNOWN, False))
                    continue
                logs = np.array(logs)
                own = normalised(logs)
                prior = np.zeros(len(names))
                if base is not None:
                    counts = np.maximum(np.array(mass) - own, 0)
                    prior = np.log((counts + strength * np.array(base)) / (counts.sum() + strength))
                p = normalised(logs + prior + declared_logs(names, said, trust) + declared_logs(names, SUFFIXES.get(suffix or ""), suffix_trust))
                best = int(p.argmax())
                out.append((names[best], float(p[best]), names[int(own.argmax())], names[best] != UNKNOWN and bool(p[best] >= least)))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            made = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.string(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[6:]], names=["lang", "probability", "text_lang", "accepted", *batch.schema.names[6:]])

    return run


def _decided(rows: DataFrame, text: Column, declared: Column, host: Column, parent: Column | None, suffix: Column | None, carry: Column, sample: int, temper: float, trust: float, suffix_trust: float, strength: float, least: float) -> DataFrame:
    """(lang, probability, text_lang, accepted, row: ``carry``), one row per row."""
    nothing = F.lit(None).cast("string")
    named = rows.select(
        text.cast("string").alias("text"), spot(rows).alias("spot"), declared.cast("string").alias("said"), (suffix if suffix is not None else nothing).alias("suffix"),
        host.cast("string").alias("host"), (parent if parent is not None else nothing).cast("string").alias("parent"), carry.alias("row"),
    )
    models = fit_text_models(named, "text", "said", sample, folds=2, spot_col="spot")
    names = models[0].names
    kept = named.drop("text", "spot").schema.fields
    added = [T.StructField("logs", T.ArrayType(T.DoubleType())), T.StructField("letters", T.LongType())]
    scored = materialize(named.mapInArrow(_scored(models, temper), T.StructType([*kept, *added])), "scored")
    priors = host_priors(scored, len(names), strength).select(F.col("host").alias("h"), F.col("parent").alias("q"), "mass", "base")
    joined = scored.join(priors, F.col("host").eqNullSafe(F.col("h")) & F.col("parent").eqNullSafe(F.col("q")), "left")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("text_lang", T.StringType()), T.StructField("accepted", T.BooleanType()), kept[-1]])
    return joined.select("logs", "letters", "said", "suffix", "mass", "base", "row").mapInArrow(_fused(names, trust, suffix_trust, strength, least), schema)


def identify(rows: DataFrame, text: Column, declared: Column, host: Column, parent: Column | None = None, suffix: Column | None = None, keep: list[str] | None = None, sample: int = 2000, temper: float = 0.1, trust: float = 0.9, suffix_trust: float = 0.7, strength: float = 10.0, least: float = 0.5) -> DataFrame:
    """The columns ``keep`` (all by default) with __lang, __probability, __text_lang and __accepted; kept columns of these names give way."""
    own = ["lang", "probability", "text_lang", "accepted"]
    keep = [c for c in (rows.columns if keep is None else keep) if c not in {f"__{x}" for x in own}]
    carry = F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    found = _decided(rows, text, declared, host, parent, suffix, carry, sample, temper, trust, suffix_trust, strength, least)
    return found.select(*[F.col("row")[c].alias(c) for c in keep], *[F.col(x).alias(f"__{x}") for x in own])


def identify_documents(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", keep: list[str] | None = None, **options) -> DataFrame:
    """``identify`` with a metadata column as the declaration and the source as the host."""
    return identify(docs, F.col(text_col), F.col(declared_col), F.col(host_col), keep=keep, **options)


def identify_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, **options) -> DataFrame:
    """``identify`` for web pages: visible text, the markup's language, the address's host, domain and suffix."""
    host = F.lower(F.regexp_extract(url_col, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    bare = F.regexp_replace(F.col(html_col), r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(bare, r"<[^>]*+>", " "), r"&#?\w{1,31};", " ")
    said = F.regexp_extract(html_col, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return identify(pages, text, said, host, parent, F.regexp_extract(host, r"\.([a-z]{2})$", 1), keep=keep, **options)


def language_id(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, lang, probability, text_lang, accepted), one row per document."""
    found = identify_documents(docs, keep=[id_col], **options)
    return found.select(id_col, F.col("__lang").alias("lang"), F.col("__probability").alias("probability"), F.col("__text_lang").alias("text_lang"), F.col("__accepted").alias("accepted"))


def accepted_documents(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", sample: int = 2000, temper: float = 0.1, trust: float = 0.9, suffix_trust: float = 0.7, strength: float = 10.0, least: float = 0.5) -> DataFrame:
    """The accepted documents with their columns, whatever their names.

    Rows that agree in all columns are decided alike, so the decision goes by two hashes of the
    whole row; the rejected ones, usually few, are written and anti-joined.
    """
    key = F.struct(F.xxhash64(*hashable(docs)).alias("a"), F.xxhash64(F.lit(1), *hashable(docs)).alias("b"))
    found = _decided(docs, F.col(quoted(text_col)), F.col(quoted(declared_col)), F.col(quoted(host_col)), None, None, key, sample, temper, trust, suffix_trust, strength, least)
    a, b = fresh(docs, "a", "b")
    gone = materialize(found.where(~F.col("accepted")).select("row.a", "row.b").distinct(), "rejected").toDF(a, b)
    return docs.withColumns({a: F.xxhash64(*hashable(docs)), b: F.xxhash64(F.lit(1), *hashable(docs))}).join(gone, [a, b], "left_anti").select(*columns(docs))
