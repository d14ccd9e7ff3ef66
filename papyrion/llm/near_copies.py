"""Near copies by SimHash: bit-sliced comparison proposes, exact similarity of word shingles decides.

A text's words (ASCII white space apart, A-Z lower-cased) give its set of five-word shingles; two
documents are near copies if the Jaccard similarity of their sets is ``least`` or more.  The
fingerprint of a set (64 majority bits over its shingles' hashes) differs by about 10 bits at 0.8,
so close fingerprints are searched within ``RADIUS`` bits, too far for a table of bit blocks.
Instead the sets are filed under their ``KEYS`` least shingles by as many hash functions: at 0.8
all of them differ in 0.2 ** KEYS (0.0003) of the pairs, and no other pair is lost before the
radius.  Within a key's unit the fingerprints are compared bit-sliced (``bitslice``), large keys in
pairs of blocks; a pair counts under the first key that it shares.  Of the close fingerprints only
pairs that agree in ``AGREE`` of ``SKETCH`` further least shingles (one byte of each) are followed up: at 0.8 one
in a million agrees in fewer, while most pairs that share no more than a passage do, so
their sets, as large as the texts, needn't move.

Documents with a partner in a unit, usually few, are read again; a filter of bounded size tells
them from the others, whose texts stay where they lie.  Their sets meet by unit, and the pairs
of a unit's candidates are tested exactly, except where they are already joined.  Units return spanning forests, never all pairs; the components are those of all links.

A key with more than ``CUT`` blocks of documents is first cut into parts that are compared in themselves;
then one document of each component so far stands for it; and only where a key still holds
several components its blocks all meet in pairs, for the pairs of different components.  So a large group of copies
costs about as many comparisons as it has documents, and no pair is left out.

Equal sets are one class before anything is compared.  Fewer words than a shingle: the whole
sequence is the only shingle; no words (null, empty or blank texts): the empty set, equal to other empty ones and
similar to nothing else.  Rows without an id link with nothing.  Repeated rows each have a row.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.bitslice import near, union
from papyrion.llm.buckets import each_unit, units
from papyrion.llm.rows import keep_rows, sieved, text_key
from papyrion.llm.simhash import _first_of_each
from papyrion.llm.vocabulary import forget
from papyrion.operators.components import connected_components
from papyrion.workspace import materialize

WORDS, LEAST = 5, 0.8
#: Hash functions whose least shingles are keys, and bits that fingerprints of a unit may differ in.
KEYS, RADIUS = 5, 24
#: Further hash functions of which a byte is kept, and how many of these bytes a pair must share.
SKETCH, AGREE = 32, 15
#: Blocks of a key that meet in pairs; a key with more documents is cut into parts of so many blocks first.
CUT = 8
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes with all bits stirred."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(one) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(one))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
    return np.unique(mixed(out))


def signature(found: np.ndarray, keys: int = KEYS) -> tuple[int, np.ndarray]:
    """(fingerprint, least shingles) of a set."""
    if not len(found):
        return 0, np.zeros(keys, np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(found), 8192):
        votes += np.unpackbits(found[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    code = int(np.packbits(2 * votes > len(found), bitorder="little").view(np.uint64)[0])
    return code, np.array([(found * f).min() for f in _FACTORS[:keys]])


def sketch(found: np.ndarray) -> bytes:
    """A byte of each of ``SKETCH`` least shingles of a set, by hash functions that the keys don't use."""
    if not len(found):
        return bytes(SKETCH)
    least = np.array([(found * f).min() for f in _FACTORS[-SKETCH:]])
    return (mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k2, text) -> (id, k2, s1, s2, n, fp, keys, sketch): s1 and s2 name the set."""
    forget()
    for batch in batches:
        names, sizes, codes, keys, bytes_ = [], [], [], [], []
        for x in batch.column(2):
            found = shingles(x.as_py())
            code, least = signature(found)
            data = found.tobytes()
            names.append((xxhash.xxh64_intdigest(data), xxhash.xxh64_intdigest(data, 1)))
            sizes.append(len(found))
            codes.append(code)
            keys.append(least.view(np.int64))
            bytes_.append(sketch(found))
        s = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
        made = [pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(sizes, pa.int32()), pa.array(np.array(codes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "k2", "s1", "s2", "n", "fp", "keys", "sketch"])


def _proposed(least: float):
    """Unit -> (t, key, __i, __j, label, rep) of rows that have a partner: label is the least row of the candidates that hang together."""

    def work(table: pa.Table, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes, rep, n, t, comp = (table.column(c).to_numpy() for c in ("fp", "rep", "n", "t", "comp"))
        keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(len(rep), -1)
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(rep), SKETCH)
        before = np.arange(keys.shape[1])[None, :] < t[:, None]
        labels, linked = np.arange(len(rep)), np.zeros(len(rep), bool)
        for i, j in near(codes.view(np.uint64), low, high, RADIUS, tile=1 << 14):
            for at in range(0, len(i), 1 << 18):
                a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                other = comp[a] != comp[b]
                a, b = a[other], b[other]
                good = ~((keys[a] == keys[b]) & before[a]).any(axis=1) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
                a, b = a[good], b[good]
                alike = (sketches[a] == sketches[b]).sum(axis=1) >= AGREE
                union(labels, a[alike], b[alike])
                linked[a[alike]] = linked[b[alike]] = True
        some = np.flatnonzero(linked)
        if len(some):
            i, j = table.column("__i").to_numpy(), table.column("__j").to_numpy()
            if "c" in table.column_names:  # blocks of one cut
                i, j = (x + 1024 * table.column("c").to_numpy() for x in (i, j))
            found = [t, table.column("key").to_numpy(), i, j, rep[labels], rep]
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in found], names=["t", "key", "i", "j", "label", "rep"])

    return work


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, groups, text) -> (rep, groups, s)."""
    forget()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingles(x.as_py()).tobytes() for x in batch.column(2)], pa.binary())], names=["rep", "groups", "s"])


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is ``least`` or more.

    Sets are taken by size and each is compared with one member of every tree first, so a group of
    copies costs a comparison each; the others of a tree are tried only if sizes allow the similarity.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    trees: list[list[int]] = []
    out = []
    for k in order:
        mine, joined = sets[k], []
        for tree in trees:
            for other in reversed(tree):  # sizes rise along a tree, so the nearest come first
                theirs = sets[other]
                if len(theirs) < least * len(mine):
                    break
                at = np.searchsorted(mine, theirs)
                at[at == len(mine)] = 0
                both = int((mine[at] == theirs).sum()) if len(mine) else 0
                if both >= least * (len(mine) + len(theirs) - both):
                    out.append((other, k))
                    joined.append(tree)
                    break
        if joined:
            whole = sorted((m for tree in joined for m in tree), key=lambda m: len(sets[m])) + [k]
            trees = [t for t in trees if not any(t is x for x in joined)] + [whole]
        else:
            trees.append([k])
    return out


def _verified(least: float):
    """Rows (t, key, i, j, label, rep, s) sorted by group -> (src, dst)."""

    def links(reps: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        found = similar_forest([np.frombuffer(s, np.uint64) for s in sets], least)
        return [(reps[a], reps[b]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, sets, out = None, [], [], []
        for batch in batches:
            groups = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for group, rep, s in zip(groups, batch.column(5).to_pylist(), batch.column(6), strict=True):
                if group != now:
                    out += links(reps, sets) if len(reps) > 1 else []
                    now, reps, sets = group, [], []
                reps.append(rep)
                sets.append(s.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["src", "dst"])
            out = []
        out = links(reps, sets) if len(reps) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["src", "dst"])

    return run


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block: int = 512) -> DataFrame:
    """(id, k2, component) of every row: component is the smallest id that near copies lead to."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("k2"), F.col(text_col).cast("string").alias("text"))
    marks = materialize(named.mapInArrow(_signatures, "id long, k2 long, s1 long, s2 long, n int, fp long, keys array<long>, sketch binary"), "marks")
    classes = marks.where("id is not null").groupBy("s1", "s2").agg(F.min(F.struct("id", "k2")).alias("x"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"))
    classes = materialize(classes.select("s1", "s2", F.col("x.id").alias("rep"), F.col("x.k2").alias("k2"), "n", "fp", "keys", "sketch"), "classes")
    filed = classes.where("n > 0").select("rep", "n", "fp", "keys", "sketch", F.posexplode("keys").alias("t", "key"))
    hot = materialize(filed.groupBy("t", "key").agg(F.count("*").alias("many")).where(F.col("many") > CUT * block), "hot")

    def forest(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
        """Links of the units of ``rows`` (t, key, ..., rep, n, fp, keys, sketch, comp), between different components."""
        compared = units(rows, keys, "rep", most).select(*keys, "__i", "__j", "__side", "rep", "n", "fp", "keys", "sketch", "comp")
        proposed = materialize(compared.mapInArrow(each_unit(keys, _proposed(least), least=1 << 12), "t int, key long, i int, j int, label long, rep long"), "proposed")
        order = ["t", "key", "i", "j", "label"]
        groups = proposed.groupBy(F.col("rep").alias("id")).agg(F.collect_list(F.struct(*order)).alias("groups"))
        wanted = materialize(groups.join(classes.select(F.col("rep").alias("id"), "k2"), "id"), "wanted")
        texts = sieved(named, wanted, ["id", "k2"])[0].join(wanted, ["id", "k2"]).dropDuplicates(["id", "k2"]).select(F.col("id").alias("rep"), "groups", "text")
        sets = texts.mapInArrow(_sets, f"rep long, groups {wanted.schema['groups'].dataType.simpleString()}, s binary")
        met = sets.select("rep", "s", F.inline("groups")).select(*order, "rep", "s").repartition(*order).sortWithinPartitions(*order)
        return materialize(met.mapInArrow(_verified(least), "src long, dst long"), "forest")

    def grown(rows: DataFrame, joined: DataFrame) -> DataFrame:
        """``rows`` with the component that each is in so far."""
        found = rows.join(joined, rows.rep == joined.vertex, "left").withColumn("comp", F.coalesce("component", "rep"))
        return found.select(*rows.columns, "comp")

    cut = F.pmod(F.xxhash64("rep", F.lit(3)), F.ceil(F.coalesce("many", F.lit(1)) / (CUT * block))).cast("int")
    blocks = filed.join(hot, ["t", "key"], "left").withColumns({"c": cut, "comp": F.col("rep")}).drop("many")
    links = forest(blocks, ["t", "key", "c"], block)
    joined = connected_components(links)
    if not hot.isEmpty():
        large = materialize(filed.join(hot.select("t", "key"), ["t", "key"], "left_semi"), "large")
        joined = materialize(joined, "joined")
        heads = grown(large, joined).groupBy("t", "key", "comp").agg(F.min_by(F.struct("rep", "n", "fp", "keys", "sketch"), "rep").alias("x")).select("t", "key", "comp", "x.*")
        links = links.unionByName(forest(heads, ["t", "key"], block))
        joined = materialize(connected_components(links), "joined")
        rest = materialize(grown(large, joined), "rest")
        mixed_ = materialize(rest.groupBy("t", "key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("t", "key"), "mixed")
        links = links.unionByName(forest(rest.join(mixed_, ["t", "key"], "left_semi"), ["t", "key"], block))
        joined = connected_components(links)
    named = classes.join(joined, classes.rep == joined.vertex, "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    named = materialize(named, "named")
    return marks.join(named, ["s1", "s2"], "left").select("id", "k2", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One document of each component of near copies, with all its columns: the one with the smallest id.

    Rows without an id stay (repeated ones once).  Of rows that share the component's id one stays.
    """
    return keep_rows(docs, *_first_of_each(near_components(docs, id_col, text_col, least)), id_col, text_col)
