"""Conversation structure repair by the auction shortest-path algorithm.

A conversation's rows, in order, and the automaton of the wanted role initials
``(s?(ua)+)?`` span a lattice: a node is (rows read, state). Its arcs are the edits:

====== ======================================================= ====
letter edit                                                    cost
====== ======================================================= ====
D      delete the row (the only edit of blank and repeated     3
       rows that reads them)
I      insert a row without text, of the role that is due      2
K      keep the row, if its initial is allowed here            0
R      give the row the role that is due                       2
====== ======================================================= ====

A row that ends without ``.``, ``!`` or ``?`` costs 1 more unless deleted.

Every node has a price, at first 0. A path grows from the start: at its last node, if
the cheapest arc (cost and price of the next node) is above the node's price, the price
rises to it and the path contracts by a node; otherwise the path extends along that
arc, the ASCII-least letter first. It ends at the goal. No price ever exceeds an arc's
cost and the next price, so the converged prices expose the tight arcs (those
without slack), of which all cheapest repairs consist, and the trace along the
ASCII-least tight arc of each node spells the least audit. (An earlier letter that was
not tight when the path passed a node never becomes tight: prices only rise.)

A long conversation's lattice is solved in blocks of ``BLOCK`` rows from its end: the
prices at a block's edge are those that the block behind it has converged to.

On Spark: faults are found by SQL functions and grouped joins on hashes (rows that
are equal in all columns are one row with a count), lattices are solved from one byte
a row, and the edits then meet the rows' texts in one sorted stream. No step
holds the texts of a conversation together. A conversation of any length costs its
tasks one byte a row; its digest and audit are one value, so one task streams its rows.

Defined results: nulls are one space (a null text is blank, a null role has an initial
that is never allowed); a null conv_id is a conversation of its own; rows go by turn,
null first, ties by role, then by hashes of the text; other columns are ignored; an
empty table gives an empty table; a conversation without any row left has zeros, an
empty audit and the digest of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import slices, width

BLOCK = 64
SEGMENT = 4096

INITIALS = "suao"
#: A row's code: its initial (o: any other) as a letter, capital where the row is truncated, or as
#: a digit where it has to go (0 to 3 blank, 4 to 7 repeated). $ is the end of the rows.
SOUND, TRUNCATED, BLANK, REPEATED = "suao", "SUAO", "0123", "4567"
END = "$"
#: State after the role that is due: 0 nothing yet, 1 after s, 2 after u, 3 after a.
DUE = (2, 2, 3, 2)
ALLOWED = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def _arcs(code: str, state: int) -> tuple:
    """(letter, cost, state after, rows read) of a node's arcs, in ASCII order."""
    insert = ("I", 2, DUE[state], 0)
    if code == END:
        return (("", 0, state, 1), insert) if state in (0, 3) else (insert,)
    out = [("D", 3, state, 1), insert]
    if code.isalpha():
        extra = int(code.isupper())
        kept = ALLOWED.get((code.lower(), state))
        if kept is not None:
            out.append(("K", extra, kept, 1))
        out.append(("R", 2 + extra, DUE[state], 1))
    return tuple(out)


ARCS = {code: tuple(_arcs(code, state) for state in range(4)) for code in SOUND + TRUNCATED + BLANK + REPEATED + END}


def converge(codes: str, exits: tuple, entries: tuple) -> list[int]:
    """Prices of the nodes (4 i + state) of a block whose last nodes' prices are ``exits``, by an
    auction from each of the ``entries``: the entries' prices are their least costs to the goal."""
    goal = 4 * len(codes)
    price = [0] * goal + list(exits)
    for entry in entries:
        path = [entry]
        while path[-1] < goal:
            node = path[-1]
            i, state = divmod(node, 4)
            least = to = -1
            for _, cost, after, read in ARCS[codes[i]][state]:
                j = 4 * (i + read) + after
                if least < 0 or cost + price[j] < least:
                    least, to = cost + price[j], j
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


def trace(codes: str, price: list[int], entry: int) -> tuple[str, int]:
    """Letters along the ASCII-least tight arcs from an entry, and the state reached."""
    node, letters, goal = entry, [], 4 * len(codes)
    while node < goal:
        i, state = divmod(node, 4)
        for letter, cost, after, read in ARCS[codes[i]][state]:
            j = 4 * (i + read) + after
            if cost + price[j] == price[node]:
                letters.append(letter)
                node = j
                break
    return "".join(letters), node - goal


KNOWN_BLOCKS = 20_000


def solve(codes: str, known: dict | None = None) -> tuple[int, list[str]]:
    """Least cost, and the letters of each block of ``BLOCK`` rows (the last has the end's).
    ``known`` keeps up to ``KNOWN_BLOCKS`` solved blocks between calls."""
    known = {} if known is None else known
    if len(known) > KNOWN_BLOCKS:
        known.clear()

    def block(codes: str, exits: tuple, entries: tuple) -> list:
        """For each entry: its price, its letters and the state it leaves in."""
        key = codes, exits, entries
        if key not in known:
            price = converge(codes, exits, entries)
            known[key] = [(price[e], *trace(codes, price, e)) for e in entries]
        return known[key]
    cuts = [codes[i:i + BLOCK] for i in range(0, len(codes), BLOCK)] or [""]
    exits, base, solved = (0, 0, 0, 0), 0, []
    for n in range(len(cuts) - 1, -1, -1):
        part = cuts[n] + END if n == len(cuts) - 1 else cuts[n]
        found = block(part, exits, (0, 1, 2, 3) if n else (0,))
        solved.append(found)
        if n:
            low = min(x[0] for x in found)
            base += low
            exits = tuple(x[0] - low for x in found)
    letters, state = [], 0
    for found in reversed(solved):
        letters.append(found[state][1])
        state = found[state][2]
    return base + solved[-1][0][0], letters


# ----------------------------------------------------------------------- rows
def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of conversations after damage by crc32 of "conv_id:turn"
    modulo 20: 0 drops the row (copies 0), 1 empties its text, 2 removes its ``.!?``, 3 repeats it
    (copies 2), 4 sets its role to user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.when(kind == 4, F.lit("user")).otherwise(text_of("role")).alias("role"), text.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


ORDER = ("conv_id", "turn", "role", "h1", "h2")


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (copies: default 1) without nulls in role and text, with two hashes of the text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       space("role").alias("role"), space("text").alias("text"), copies.alias("copies"))
    return rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64("text", F.lit(1)))


def coded(rows: DataFrame) -> DataFrame:
    """``ORDER``, initial, fault (0 none, 1 truncated, 2 blank, 3 repeated), n: one row for the
    rows of ``keyed`` that are equal in all columns, without their texts."""
    initial = F.substring("role", 1, 1)
    has = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.filter("copies > 0").select(*ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
                                             F.when(~has, 2).when(~ends, 1).otherwise(0).alias("fault"), "copies")
    light = light.groupBy(*ORDER, "initial", "fault").agg(F.sum("copies").alias("n"))
    # texts that a conversation's role has in several turns: all but the first turn repeat them
    again = light.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
    again = again.filter("turns > 1").select(*(F.col(c).alias(f"of_{c}") for c in ("conv_id", "role", "h1", "h2")), "first")
    same = light["conv_id"].eqNullSafe(again["of_conv_id"])
    for c in ("role", "h1", "h2"):
        same = same & (light[c] == again[f"of_{c}"])
    found = light.join(again, same, "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return found.select(*ORDER, "initial", F.when(later & (F.col("fault") < 2), 3).otherwise(F.col("fault")).alias("fault"), "n")


CODES = {0: SOUND, 1: TRUNCATED, 2: BLANK, 3: REPEATED}
LEGAL = ("su", "ua", "au")
EDITS = "conv_id long, turn long, role string, h1 long, h2 long, seq int, letters string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def edits(light: DataFrame) -> DataFrame:
    """The letters of each conversation, in segments of about ``SEGMENT`` rows under the key of the
    segment's first row (``ORDER`` and seq); the first segment also has the conversation's counts."""
    rows = light.repartition(width(light.sparkSession), "conv_id").sortWithinPartitions(*ORDER)

    class Conversation:
        def __init__(self, conv_id):
            self.conv_id, self.codes, self.size, self.first = conv_id, [], 0, []
            self.low = self.high = self.last = None
            self.turns = 0

        def add(self, key, initial, fault, n):
            turn = key[0]
            if turn is not None and turn != self.last:
                self.low = turn if self.low is None else self.low
                self.high = self.last = turn
                self.turns += 1
            k = INITIALS.index(initial)
            codes = CODES[fault][k] + (BLANK if fault == 2 else REPEATED)[k] * (n - 1)
            # a segment begins with a row of its own; the rows that repeat it may go on in the next
            while SEGMENT * len(self.first) < self.size + len(codes):
                self.first.append(key)
            self.codes.append(codes)
            self.size += len(codes)

        def done(self, known):
            codes = "".join(self.codes)
            cost, letters = solve(codes, known)
            initials = codes.translate(TO_INITIAL)
            pairs = [initials.count(p) for p in LEGAL]  # no pair overlaps itself
            counts = (0 if self.turns == 0 else self.high - self.low + 1 - self.turns, sum(map(codes.count, BLANK)), sum(map(codes.count, REPEATED)),
                      sum(map(codes.count, TRUNCATED)), max(0, len(codes) - 1) - sum(pairs), cost)
            step = SEGMENT // BLOCK
            for seq, key in enumerate(self.first):
                own = "".join(letters[seq * step:(seq + 1) * step])
                yield (self.conv_id, *key, seq, own, *(counts if seq == 0 else (None,) * 6))

    schema = _schema(EDITS)

    def run(batches):
        now, out, known = None, [], {}
        for batch in batches:
            for conv_id, turn, role, h1, h2, initial, fault, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    out += now.done(known) if now else ()
                    now = Conversation(conv_id)
                now.add((turn, role, h1, h2), initial, fault, n)
                if len(out) >= 1000:
                    yield _batch(out, schema)
                    out = []
        out += now.done(known) if now else ()
        if out:
            yield _batch(out, schema)
    return rows.mapInArrow(run, EDITS)


TO_INITIAL = str.maketrans(TRUNCATED + BLANK + REPEATED, INITIALS * 3)


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# -------------------------------------------------------------------- replays
class Replay:
    """A conversation's edits applied to its rows as they come."""

    ROLES = {2: "user", 3: "assistant"}

    def __init__(self):
        self.letters, self.at, self.state = "", 0, 0

    def more(self, letters: str) -> None:
        self.letters, self.at = self.letters[self.at:] + letters, 0

    def inserted(self):
        """The rows inserted before the next row, or after the last."""
        while self.letters[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = DUE[self.state]
            yield "I", self.ROLES[self.state], ""

    def row(self, role: str, text: str):
        """(edit, role, text) of the rows inserted before a row, and of the row."""
        yield from self.inserted()
        edit = self.letters[self.at]
        self.at += 1
        if edit == "K":
            self.state = ALLOWED[role[:1], self.state]
        elif edit == "R":
            self.state = DUE[self.state]
            role = self.ROLES[self.state]
        yield edit, role, text


def _stream(rows: DataFrame) -> DataFrame:
    """Rows and edits of each conversation in one order, its edits before the rows they are for."""
    found = edits(coded(rows))
    none = lambda kind: F.lit(None).cast(kind)
    counts = [c.split()[0] for c in EDITS.split(", ")[7:]]
    left = found.select(*ORDER, F.lit(0).alias("side"), "seq", "letters", *counts, none("string").alias("text"), none("long").alias("copies"))
    right = rows.select(*ORDER, F.lit(1).alias("side"), none("int").alias("seq"), none("string").alias("letters"),
                        *(none("long").alias(c) for c in counts), "text", "copies")
    both = left.unionByName(right).repartition(width(rows.sparkSession), "conv_id").sortWithinPartitions(*ORDER, "side", "seq")
    return both.select("conv_id", "turn", "role", "side", "letters", *counts, F.col("text").cast("binary").alias("text"), "copies")


class Digest:
    """The report's row of a conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.audit, self.sha, self.any = conv_id, [0] * 6, [], hashlib.sha256(), False

    def step(self, turn, edit, role, text):
        self.audit.append(edit)
        if edit != "D":
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True
        return ()

    def end(self):
        return [(self.conv_id, *self.counts, "".join(self.audit), self.sha.hexdigest())]


class Rows:
    """The repaired rows of a conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.position = conv_id, None, 0

    def step(self, turn, edit, role, text):
        if edit == "D":
            return ()
        self.position += 1
        return [(self.conv_id, self.position - 1, turn, edit, role, text)]

    def end(self):
        return ()


def _played(rows: DataFrame, result: Callable, schema_text: str) -> DataFrame:
    """The rows that ``result`` (an object for each conversation) gives for its rows and at its end."""
    schema = _schema(schema_text)

    def run(batches):
        now = replay = None
        out: list[tuple] = []

        def finish():
            for x in replay.inserted():
                out.extend(now.step(None, *x))
            out.extend(now.end())
        for batch in slices(batches):
            for conv_id, turn, role, side, letters, *counts, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        finish()
                    now, replay = result(conv_id), Replay()
                if side == 0:
                    replay.more(letters)
                    if counts[0] is not None:
                        now.counts = counts
                    continue
                for _ in range(copies):
                    for edit, role_, text_ in replay.row(role, text.decode("utf-8", "replace")):
                        out.extend(now.step(None if edit == "I" else turn, edit, role_, text_))
            if out:
                yield _batch(out, schema)
                out.clear()
        if now is not None:
            finish()
        if out:
            yield _batch(out, schema)
    return _stream(keyed(rows)).mapInArrow(run, schema_text)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, position long, turn long, edit string, role string, text string"


def report(rows: DataFrame) -> DataFrame:
    """Faults, least cost, audit and digest of the repaired rows of every conversation in ``rows``
    (conv_id, turn, role, text, copies: default 1; 0 only names the conversation)."""
    return _played(rows, Digest, REPORT)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), turn (null where inserted), edit, role, text."""
    return _played(rows, Rows, REPAIRED)
