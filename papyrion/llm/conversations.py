"""Repair of a conversation's structure by a lazily determinised weighted automaton.

Kept roles must spell ``(s?(ua)+)?`` in their initials (system, user, assistant), at least cost:
Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert
an empty user or assistant row 3, and 3 more for each truncated row that stays.

The edit automaton has four states.  Rows are read from the last to the first; the vector of the
four costs to go, less its least entry, is a state of the determinised automaton, and a
transition table is filled as symbols are met.  The differences within a vector are bounded, so
the automaton is finite.  A scan of the table gives the costs; a trace against the scan's
direction then takes, from the first row on, the ASCII-least tight arc.

Conversations may be of any length.  Rows lie in one global order (Spark's range sort) and are
cut into pieces of at most ``PIECE`` rows.  Pieces of a conversation that has several are first
summarised: from each vector at their end to the vector at their start, then from each automaton
state at their start to the one at their end.  Only these summaries of a conversation meet in a
task; its rows don't.  The digest of a conversation's text is a single hash by contract, so one
task streams that conversation's rows through it with constant memory.

Order: by turn, null turns first; rows of one turn by role, then by a digest of the text.  Null
roles and texts are one space (so the role is illegal and the text blank), a null conversation
is one of its own.  Repeated rows are duplicates of the first.  Conversations without rows after
the damage have zeros and an empty audit.  Empty tables give empty results, very long texts are
read whole, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.workspace import Table, materialize

#: Rows of a piece: what one task holds of a conversation.
PIECE = 1 << 16
#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States of ``(s?(ua)+)?``: at the start, after s, after u, after a; where a kept initial leads.
START, AFTER_A = 0, 3
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state behind the only row that may be inserted or reroled in a state, and that row's initial.
NEXT = (2, 2, 3, 2)
MADE = ("u", "u", "a", "u")
FAR = 1 << 20
ROLES = "sua"
WHITE = " \t\n\x0b\x0c\r"
#: Symbols: 4 * fault + role; fault 0 none, 1 truncated, 2 blank, 3 duplicate; role s, u, a, other.
FIRST = "a"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with a fault in about a quarter of the rows, chosen by crc32(``conv:turn``) % 20."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    return out.select(
        "conv", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


class Automaton:
    """The determinised automaton: vectors of costs to go, and a table of (vector, symbol) -> (vector, cost), filled as needed."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self._names: dict[tuple[int, ...], int] = {}
        self._table: dict[tuple[int, str], tuple[int, int]] = {}
        self._arcs: dict[tuple[int, str, int], tuple[str, str, str, int]] = {}
        self.end = self.name((0, FAR, FAR, 0))[0]

    def name(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """(vector, least cost) of costs before inserts are considered."""
        costs = list(costs)
        for _ in range(3):
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self._names:
            self._names[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self._names[vector], least

    @staticmethod
    def edits(symbol: str, q: int) -> Iterator[tuple[str, str, int, int]]:
        """(letter, new role, cost, state behind) of the edits of a row."""
        fault, role = divmod(ord(symbol) - ord(FIRST), 4)
        yield "D", "", DELETE, q
        if fault < 2:
            more = TRUNCATED * fault
            if (role := ROLES[role : role + 1]) and (q, role) in MOVES:
                yield "K", "", more, MOVES[q, role]
            yield "R", MADE[q], REROLE + more, NEXT[q]

    def step(self, vector: int, symbol: str) -> tuple[int, int]:
        """The vector before a row and what the least cost gains, from the vector behind it."""
        found = self._table.get((vector, symbol))
        if found is None:
            w = self.vectors[vector]
            found = self._table[vector, symbol] = self.name(tuple(min(cost + w[to] for _, _, cost, to in self.edits(symbol, q)) for q in range(4)))
        return found

    def scan(self, symbols: str, vector: int) -> tuple[list[int], int]:
        """Vectors before each row and behind the last, and the cost gained, for rows with ``vector`` behind them."""
        out, total = [vector], 0
        for symbol in reversed(symbols):
            vector, cost = self.step(vector, symbol)
            out.append(vector)
            total += cost
        out.reverse()
        return out, total

    def arc(self, behind: int, symbol: str, q: int) -> tuple[str, str, str, int]:
        """(initials inserted before the row, letter, new role, state behind): the ASCII-least tight arcs."""
        found = self._arcs.get((behind, symbol, q))
        if found is None:
            vector, least = self.step(behind, symbol)
            before, w, at = "", [c + least for c in self.vectors[vector]], q
            while True:
                tight = [(letter, role, to) for letter, role, cost, to in self.edits(symbol, at) if cost + self.vectors[behind][to] == w[at]]
                if w[at] == INSERT + w[NEXT[at]]:
                    tight.append(("I", MADE[at], NEXT[at]))
                letter, role, to = min(tight)
                if letter != "I":
                    break
                before, at = before + role, to
            found = self._arcs[behind, symbol, q] = (before, letter, role, to)
        return found

    def trace(self, symbols: str, vectors: list[int], q: int) -> tuple[list[tuple[str, str, str]], int]:
        """Edits by row from state ``q`` on, and the state behind the last row."""
        out = []
        for k, symbol in enumerate(symbols):
            before, letter, role, q = self.arc(vectors[k + 1], symbol, q)
            out.append((before, letter, role))
        return out, q

    def tail(self, q: int) -> str:
        """Initials of the rows inserted behind the last one."""
        out = ""
        while q not in (START, AFTER_A):
            out, q = out + MADE[q], NEXT[q]
        return out

    def all_vectors(self) -> int:
        """Fill the whole table; the number of vectors."""
        at = 0
        while at < len(self.vectors):
            for fault in range(3):
                for role in range(4):
                    self.step(at, chr(ord(FIRST) + 4 * fault + role))
            at += 1
        return at


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, piece, symbols) -> and, for each vector behind the piece, the vector before it: three arrays."""
    own = Automaton()
    count = own.all_vectors()  # the same names in every worker: the table is filled in one order
    for batch in batches:
        after = []
        for symbols in batch.column(2).to_pylist():
            at = {v: [v] for v in range(count)}  # vectors that have met go on as one
            for symbol in reversed(symbols):
                met: dict[int, list[int]] = {}
                for v, origins in at.items():
                    met.setdefault(own.step(v, symbol)[0], []).extend(origins)
                at = met
            row = [0] * count
            for v, origins in at.items():
                for o in origins:
                    row[o] = v
            after.append(row)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(after, pa.list_(pa.int32()))], names=["c", "piece", "before"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, piece, symbols, vector behind) -> for each state before the piece, the state behind it."""
    own = Automaton()
    own.all_vectors()
    for batch in batches:
        out = []
        for symbols, vector in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            vectors, _ = own.scan(symbols, vector)
            out.append([own.trace(symbols, vectors, q)[1] for q in range(4)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int32()))], names=["c", "piece", "behind"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, piece, start, symbols, vector behind, state before, last) -> (c, piece, start, moves, cost, illegal, audit)."""
    own = Automaton()
    own.all_vectors()
    legal = {"su", "ua", "au"}
    move = pa.struct([("before", pa.string()), ("edit", pa.string()), ("role", pa.string()), ("after", pa.string())])
    for batch in batches:
        moves, costs, wrong, audits = [], [], [], []
        for symbols, vector, q, last in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
            vectors, cost = own.scan(symbols, vector)
            found, to = own.trace(symbols, vectors, q)
            tail = own.tail(to) if last else ""
            moves.append([(before, edit, role, tail if k + 1 == len(found) else "") for k, (before, edit, role) in enumerate(found)])
            costs.append(cost + own.vectors[vectors[0]][q] - (0 if last else own.vectors[vector][to]))
            initials = [f"{ROLES}?"[(ord(s) - ord(FIRST)) % 4] for s in symbols]
            wrong.append(sum(a + b not in legal for a, b in pairwise(initials)))
            audits.append("".join("I" * len(before) + edit for before, edit, _ in found) + "I" * len(tail))
        dicts = [[dict(zip(("before", "edit", "role", "after"), m, strict=True)) for m in row] for row in moves]
        made = [pa.array(dicts, pa.list_(move)), pa.array(costs, pa.int64()), pa.array(wrong, pa.int64()), pa.array(audits, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["c", "piece", "start", "moves", "cost", "illegal", "audit"])


def conversation_key(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


class Repair:
    """The repair of rows (conv, turn, role, text).

    ``rows`` (c, place, edit, role, text, before, after) has each row with its edit (K, R, D) and new
    role, and the initials of the rows inserted around it; ``conversations`` (c, gaps, blank,
    duplicate, truncated, illegal, cost, audit) has one row for each conversation with rows.  c is
    ``conversation_key`` of its id.
    """

    def __init__(self, rows: DataFrame, piece: int = PIECE):
        digest = F.sha2("text", 256)
        named = rows.select(conversation_key(F.col("conv")).alias("c"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
        order = ["c", "turn", "role", "digest"]  # Spark's ascending order has nulls first
        placed = named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
        self._turns = Table(placed, "turns")
        turns = self._turns.df
        self.pieces = self._pieces(turns, piece)
        edits = Table(self._entered(self.pieces).mapInArrow(_edits, "c string, piece long, start long, moves array<struct<before: string, edit: string, role: string, after: string>>, cost long, illegal long, audit string"), "edits")
        moved = edits.df.select(F.col("start"), F.posexplode("moves").alias("k", "m")).select((F.col("start") + F.col("k")).alias("place"), "m.*")
        kept = turns.select("place", "c", F.col("role").alias("old"), "text").join(moved, "place")
        renamed = F.when(F.col("role") == "u", "user").when(F.col("role") == "a", "assistant").otherwise(F.col("old"))
        self.rows = kept.select("c", "place", "edit", renamed.alias("role"), "text", "before", "after")
        self.conversations = self._report(turns, edits.df)

    @staticmethod
    def _pieces(turns: DataFrame, piece: int) -> DataFrame:
        """(c, piece, start, symbols): the symbols of up to ``piece`` rows in order."""
        firsts = materialize(turns.groupBy("c", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("c", "role", "digest", "first"), "firsts")
        bare = F.rtrim(F.col("text"), F.lit(WHITE))
        fault = F.when(bare == "", 2).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
        initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1))
        role = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
        narrow = turns.select("c", "role", "digest", "place", fault.alias("fault"), role.alias("kind")).join(firsts, ["c", "role", "digest"], "left")
        fault = F.when((F.col("fault") != 2) & (F.col("place") > F.col("first")), 3).otherwise(F.col("fault"))
        marked = materialize(narrow.select("c", "place", F.char(F.lit(ord(FIRST)) + 4 * fault + F.col("kind")).alias("symbol")), "symbols")
        partition = F.shiftright("place", 33)
        cut = (partition * F.lit((1 << 33) // piece + 1) + F.floor((F.col("place") - F.shiftleft(partition, 33)) / piece)).alias("piece")
        gathered = marked.groupBy("c", cut).agg(F.min("place").alias("start"), F.sort_array(F.collect_list(F.struct("place", "symbol"))).alias("s"))
        return materialize(gathered.select("c", "piece", "start", F.array_join(F.transform("s", lambda x: x.symbol), "").alias("symbols")), "pieces")

    @staticmethod
    def _entered(pieces: DataFrame) -> DataFrame:
        """Pieces with the vector behind them, the state before them and whether they are a conversation's last."""
        end = Automaton().end
        many = materialize(pieces.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "many")
        alone = pieces.join(many, "c", "left_anti").select("c", "piece", "start", "symbols", F.lit(end).alias("vector"), F.lit(START).alias("state"), F.lit(True).alias("last"))
        parts = pieces.join(many, "c", "left_semi")
        ends = parts.select("c", "piece", "symbols").mapInArrow(_ends, "c string, piece long, before array<int>")
        # the summaries of a conversation, a few numbers for each piece, are composed from its last piece on
        listed = F.reverse(F.sort_array(F.collect_list(F.struct("piece", "before"))))
        grown = F.aggregate("s", F.array(F.struct(F.lit(0).cast("long").alias("piece"), F.lit(end).alias("vector"))).cast("array<struct<piece: bigint, vector: int>>"), lambda acc, x: F.concat(acc, F.array(F.struct(x.piece.alias("piece"), F.element_at(x.before, F.element_at(acc, -1).vector + 1).alias("vector")))))
        chain = ends.groupBy("c").agg(listed.alias("s")).select("c", grown.alias("g"), "s")
        behind = materialize(chain.select("c", F.posexplode("s").alias("k", "x"), "g").select("c", F.col("x.piece").alias("piece"), F.element_at("g", F.col("k") + 1).vector.alias("vector")), "behind")
        known = parts.join(behind, ["c", "piece"])
        passed = known.select("c", "piece", "symbols", "vector").mapInArrow(_states, "c string, piece long, behind array<int>")
        listed = F.sort_array(F.collect_list(F.struct("piece", "behind")))
        grown = F.aggregate("s", F.array(F.lit(START)), lambda acc, x: F.concat(acc, F.array(F.element_at(x.behind, F.element_at(acc, -1) + 1))))
        chain = passed.groupBy("c").agg(listed.alias("s")).select("c", grown.alias("g"), F.posexplode("s").alias("k", "x"), F.size("s").alias("n"))
        before = chain.select("c", F.col("x.piece").alias("piece"), F.element_at("g", F.col("k") + 1).alias("state"), (F.col("k") + 1 == F.col("n")).alias("last"))
        return alone.unionByName(known.join(before, ["c", "piece"]).select("c", "piece", "start", "symbols", "vector", "state", "last"))

    def _report(self, turns: DataFrame, edits: DataFrame) -> DataFrame:
        def faulty(fault: int) -> Column:
            those = "".join(chr(ord(FIRST) + 4 * fault + r) for r in range(4))
            return F.sum(F.length("symbols") - F.length(F.translate("symbols", those, "")))

        counts = self.pieces.groupBy("c").agg(faulty(2).alias("blank"), faulty(3).alias("duplicate"), faulty(1).alias("truncated"))
        role = lambda x: F.substring(F.lit(f"{ROLES}?"), (F.ascii(x) - ord(FIRST)) % 4 + 1, F.lit(1))
        borders = self.pieces.select("c", "piece", role(F.left("symbols", F.lit(1))).alias("head"), role(F.right("symbols", F.lit(1))).alias("foot"))
        borders = borders.withColumn("met", F.concat(F.lag("foot").over(Window.partitionBy("c").orderBy("piece")), "head"))  # a row per piece
        crossed = borders.groupBy("c").agg(F.sum(F.when(F.col("met").isNotNull() & ~F.col("met").isin("su", "ua", "au"), 1).otherwise(0)).alias("crossed"))
        gaps = turns.groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
        done = edits.groupBy("c").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda x: x.audit), "").alias("audit"))
        out = gaps.join(counts, "c").join(crossed, "c").join(done, "c")
        return out.select("c", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("crossed")).alias("illegal"), "cost", "audit")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (c, lines) -> (c, sha256 of all its lines joined by newlines); holds one row at a time."""
    now, digest, begun = None, None, False
    for batch in batches:
        names, hashes = [], []
        for c, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if c != now:
                if now is not None:
                    names.append(now)
                    hashes.append(digest.hexdigest())
                now, digest, begun = c, hashlib.sha256(), False
            for line in lines:
                digest.update((("\n" if begun else "") + line).encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hashes, pa.string())], names=["c", "sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["c", "sha256"])


def text_digests(rows: DataFrame) -> DataFrame:
    """(c, sha256) of the repaired ``role:text`` lines of ``Repair.rows``: one task streams a conversation, in order."""
    made = lambda initials: F.transform(F.filter(F.split(initials, ""), lambda x: x != ""), lambda x: F.when(x == "u", "user:").otherwise("assistant:"))
    own = F.when(F.col("edit") == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat("role", F.lit(":"), "text")))
    lines = rows.select("c", "place", F.concat(made(F.col("before")), own, made(F.col("after"))).alias("lines"))
    return lines.repartition("c").sortWithinPartitions("c", "place").select("c", "lines").mapInArrow(_hashes, "c string, sha256 string")


def repaired_conversations(rows: DataFrame, piece: int = PIECE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after ``damage``."""
    repair = Repair(damage(rows, conv_col, turn_col, role_col, text_col), piece)
    found = repair.conversations.join(text_digests(repair.rows), "c")
    names = rows.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("c", conversation_key(F.col("conv_id")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return names.join(found, "c", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
