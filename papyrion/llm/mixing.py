"""Mix sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised; the exponent is found by
bisection so that the weights meet a target entropy or so that no source is repeated more than
``max_repeats`` times.  The weights become token quotas: a source gives as many whole passes as
fit its quota and then a part of a pass.  Its documents lie in blocks (by a hash), each pass is
a permutation of the blocks, and the partial pass takes blocks in that order while they fit,
so a decision about a source is one threshold on the permutation's key and no document moves.
A block has about ``block_tokens`` tokens and at most about ``1 / parts`` of the partial pass
(or is a single document), and the source falls short by less than the first block that no
longer fits.

Without a budget the source with the lowest rate is used exactly once and the others are
repeated, so no document is lost.  A source that is null is a source of its own; null and
empty texts have no tokens and go with their block; an empty table gives an empty result; a
corpus without tokens is passed once.  Repeated rows count each time.  Tied blocks share
their fate.

Sources of the same size are weighed alike, so the driver sees only the histogram of source
sizes (n tokens have at most sqrt(2 n) different sizes of sources, usually far fewer); the
sources themselves stay a written table, which is broadcast only while it is small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.prefix import running_sums
from papyrion.llm.rows import columns, fresh, id_key, quoted, text_key
from papyrion.llm.token_counts import document_lengths
from papyrion.llm.vocabulary import CACHE
from papyrion.workspace import materialize

PLAN = "tokens long, weight double, quota double, passes long, blocks long"


def weights(shares: list[float], exponent: float, counts: list[int] | None = None) -> list[float]:
    """Normalised shares to the power of the exponent; a zero share stays zero.  ``counts`` says how many sources have each share."""
    logs = [exponent * math.log(p) if p > 0 else -math.inf for p in shares]
    most = max(logs)
    raised = [math.exp(x - most) for x in logs]
    whole = math.fsum(x * c for x, c in zip(raised, counts or [1] * len(raised), strict=True))
    return [x / whole for x in raised]


def entropy(w: list[float], counts: list[int] | None = None) -> float:
    return -math.fsum(c * x * math.log(x) for x, c in zip(w, counts or [1] * len(w), strict=True) if x > 0)


def _shares(tokens: list[int], counts: list[int] | None) -> list[float]:
    whole = sum(t * c for t, c in zip(tokens, counts or [1] * len(tokens), strict=True))
    return [t / whole for t in tokens]


def rates(tokens: list[int], exponent: float, budget: float | None, counts: list[int] | None = None) -> tuple[list[float], list[float]]:
    """(weights, passes as a fraction) under a token budget, or with the lowest rate at one."""
    w = weights(_shares(tokens, counts), exponent, counts)
    r = [x / t if t else math.inf for x, t in zip(w, tokens, strict=True)]
    scale = budget if budget is not None else 1 / min(x for x in r if x < math.inf)
    return w, [x * scale if x < math.inf else 1.0 for x in r]


def solve_exponent(tokens: list[int], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, steps: int = 100, counts: list[int] | None = None) -> float:
    """The exponent in [0, 1]: for the target entropy, or the flattest mix within the repetition limit.

    A target beyond what the shares allow gives the end of the interval that is nearest.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a repetition limit")

    def too_flat(a: float) -> bool:
        if target_entropy is not None:
            return entropy(weights(_shares(tokens, counts), a, counts), counts) > target_entropy
        return max(rates(tokens, a, budget, counts)[1]) > max_repeats

    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def block_count(tokens: int, quota: float, block_tokens: int, parts: int) -> int:
    """Blocks of a source whose partial pass has ``quota`` tokens; more blocks than tokens are of no use."""
    fine = math.ceil(parts * tokens / quota) if quota >= 1 else 1
    return max(1, math.ceil(tokens / block_tokens), min(tokens, fine))


def _order(seed: int, source: Column, block: Column, turn: Column) -> Column:
    """The key of a block in the permutation of a pass."""
    return F.xxhash64(source, block, turn, F.lit(seed))


def mixing_plan(docs: DataFrame, path: str, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, block_tokens: int = 1 << 20, parts: int = 256, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cache: int = CACHE) -> DataFrame:
    """A written row per source: source, tokens, weight, quota, passes, blocks, threshold (null: no block of the last pass)."""
    spark = docs.sparkSession
    spot = F.xxhash64(id_key(F.col(quoted(id_col))), text_key(F.col(quoted(text_col))), F.lit(seed)).alias("spot")
    rows = materialize(document_lengths(docs, path, text_col, [F.col(quoted(source_col)).cast("string").alias("source"), spot], cache), "lengths")
    sources = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    sizes = sorted((r.tokens, r.n) for r in sources.groupBy("tokens").agg(F.count("*").alias("n")).collect())
    tokens, counts = [t for t, _ in sizes], [n for _, n in sizes]
    if sum(tokens):
        exponent = solve_exponent(tokens, target_entropy, max_repeats, budget, counts=counts)
        w, r = rates(tokens, exponent, budget, counts)
    else:
        w, r = [0.0] * len(tokens), [1.0] * len(tokens)
    plan = []
    for size, weight, rate in zip(tokens, w, r, strict=True):
        whole = math.floor(rate + 1e-9)
        quota = max(0.0, rate - whole) * size
        plan.append((size, weight, quota, whole, block_count(size, quota, block_tokens, parts)))
    plan = materialize(sources.join(spark.createDataFrame(plan, PLAN), "tokens").select("source", "tokens", "weight", "quota", "passes", "blocks"), "plan")
    blocks = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    key = _order(seed, F.col("p.source"), F.pmod("spot", "blocks"), F.col("passes"))
    blocks = materialize(blocks.groupBy(F.col("p.source").alias("source"), "quota", key.alias("key")).agg(F.sum("n_tokens").alias("t")), "blocks")
    summed = running_sums(blocks, ["source"], "key", F.shiftright("key", 54), ["t"])
    last = summed.where("t_to <= quota and quota > 0").groupBy("source").agg(F.max("key").alias("threshold"))
    joined = plan.alias("p").join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
    return materialize(joined.select("p.*", "threshold"), "decided")


def mixed(docs: DataFrame, plan: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, str, str, str]:
    """``docs`` with three columns, and their names: weight, block, copies (how often the document is used)."""
    of, place, *names = fresh(docs, "of", "spot", *[c if c != "source" else "its" for c in plan.columns], "block", "copies")
    chosen, (block, copies) = plan.toDF(*names[:-2]), names[-2:]
    its, weight, passes, blocks, threshold = (names[plan.columns.index(c)] for c in ("source", "weight", "passes", "blocks", "threshold"))
    spot = F.xxhash64(id_key(F.col(quoted(id_col))), text_key(F.col(quoted(text_col))), F.lit(seed))
    rows = docs.withColumns({of: F.col(quoted(source_col)).cast("string"), place: spot}).join(chosen, F.col(of).eqNullSafe(F.col(its)))
    rows = rows.withColumn(block, F.pmod(place, blocks))
    extra = _order(seed, F.col(its), F.col(block), F.col(passes)) <= F.col(threshold)
    rows = rows.withColumn(copies, F.col(passes) + F.when(extra, 1).otherwise(0))
    return rows.select(*columns(docs), weight, block, copies), weight, block, copies


def mix_sources(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, source, weight, block, copies), one row per document."""
    plan = mixing_plan(docs, path, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    rows, weight, block, copies = mixed(docs, plan, options.get("seed", 0), id_col, text_col, source_col)
    return rows.select(F.col(quoted(id_col)), F.col(quoted(source_col)), F.col(weight).alias("weight"), F.col(block).alias("block"), F.col(copies).alias("copies"))


def mixed_corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The columns of ``docs``, whatever their names, each document as often as it is used."""
    plan = mixing_plan(docs, path, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    rows, _, _, copies = mixed(docs, plan, options.get("seed", 0), id_col, text_col, source_col)
    (turn,) = fresh(rows, "turn")
    return rows.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns(docs))
