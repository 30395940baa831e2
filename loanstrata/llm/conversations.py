"""Conversation structure repair: the cheapest audit of keep, rerole, delete and insert that gives well-formed turns.

Well-formed role initials are nothing, or an optional `s` and one or more `ua`. Four states (nothing yet, after `s`, after
`u`, after `ua`) decide which role may follow, so an audit, the string of its edits' initials, fixes the repaired turns. A
dynamic program keeps the cheapest audit per state, the ASCII-least among equals. Audits are linked nodes that share their
prefixes; a node has its binary-lifting ancestors and the rolling hash of its string, so two audits are compared by a search
for their longest common prefix, and prefixes with equal hashes are verified.

Rows are range-partitioned by conversation and turn, so a conversation of any length is cut into pieces of like size. The
program of a piece is run from every state; pieces are chained by what they cost from state to state. A conversation inside
one partition is finished where it lies. For the first and the last of a partition the pieces meet, and their rows are read
once more, in order and one at a time, for the digest of the repaired text (SHA-256 cannot be split).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanstrata.session import pin

PART_ROWS, PART_BYTES = 20_000, 32 << 20
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The state after a kept initial, and after the role that may be made.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
MAKE = (2, 2, 3, 2)
MADE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
MOD, BASE = (1 << 61) - 1, 1_000_003
EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Node:
    """The last edit of an audit; `up[k]` is the node 2^k edits earlier."""
    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, parent: "Node | None", letter: str):
        self.letter = letter
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, []
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * BASE + ord(letter)) % MOD
        up, k = [parent], 0
        while len(up[k].up) > k:
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def ancestor(self, depth: int) -> "Node":
        node, k = self, 0
        skip = self.depth - depth
        while skip:
            if skip & 1:
                node = node.up[k]
            skip >>= 1
            k += 1
        return node

    def spell(self) -> str:
        letters, node = [], self
        while node.up:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def same_prefix(a: Node, b: Node) -> bool:
    """Whether two nodes of one depth spell the same; equal hashes are verified back to the node they share."""
    if a.hash != b.hash:
        return False
    while a is not b and a.up:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether a's audit is the ASCII-lesser one; a proper prefix is less than what it begins."""
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if same_prefix(x, y):
        return a.depth < b.depth
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and not same_prefix(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return x.letter < y.letter


Best = tuple[int, Node]


def better(a: Best | None, b: Best | None) -> Best | None:
    """The cheaper of two audits, the lesser among equals."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if less(a[1], b[1]) else b


def insert(best: list[Best | None]) -> list[Best | None]:
    """Adds the turns that may be inserted before the next row: a user turn, an assistant turn, or both."""
    for origin, goal in ((0, 2), (1, 2), (3, 2), (2, 3)):
        if best[origin] is not None:
            cost, node = best[origin]
            if best[goal] is None or cost + INSERT <= best[goal][0]:
                best[goal] = better(best[goal], (cost + INSERT, Node(node, "I")))
    return best


def start(state: int) -> list[Best | None]:
    best: list[Best | None] = [None] * 4
    best[state] = (0, Node(None, ""))
    return insert(best)


def step(best: list[Best | None], initial: str, must: bool, extra: int) -> list[Best | None]:
    """The best audits after one more row; `must` asks for its deletion, `extra` is the price of not deleting it."""
    out: list[Best | None] = [None] * 4

    def offer(goal: int, cost: int, node: Node, letter: str) -> None:
        held = out[goal]
        if held is None or cost <= held[0]:
            out[goal] = better(held, (cost, Node(node, letter)))

    for state, held in enumerate(best):
        if held is None:
            continue
        cost, node = held
        offer(state, cost + DELETE, node, "D")
        if not must:
            kept = KEEP.get((state, initial))
            if kept is not None:
                offer(kept, cost + extra, node, "K")
            made = MAKE[state]
            if MADE[made][0] != initial:
                offer(made, cost + REROLE + extra, node, "R")
    return insert(out)


class Piece:
    """What a run of rows of one conversation adds up to."""

    def __init__(self, conversation, starts: tuple[int, ...], hold: bool):
        self.conversation = conversation
        self.rows: list[tuple[str, str]] | None = [] if hold else None
        self.best = {s: start(s) for s in starts}
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = self.final = None
        self.marked = self.previous = None

    def add(self, turn, role: str, text: str | None, digest: bytes) -> None:
        key = (turn, role, digest)
        if text is None:
            self.marked = key
            return
        said = text.strip(SPACE)
        blank = not said
        duplicate = not blank and key in (self.marked, self.previous)
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        initial = role[:1]
        if self.initial is None:
            self.initial = initial
        elif self.final + initial not in LEGAL:
            self.illegal += 1
        self.final, self.previous = initial, key
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        for s, best in self.best.items():
            self.best[s] = step(best, initial, blank or duplicate, TRUNCATED if truncated else 0)
        if self.rows is not None:
            self.rows.append((role, text))

    def row(self, part: int, whole: bool) -> dict:
        out = {"conv_id": self.conversation, "part": part, "whole": whole, "first_turn": self.first_turn, "last_turn": self.last_turn,
               "turns": self.turns, "initial": self.initial, "final": self.final, "blank": self.blank, "duplicate": self.duplicate,
               "truncated": self.truncated, "illegal": self.illegal, "paths": None, "cost": None, "audit": None, "repaired_sha256": None}
        if whole:
            best = None
            for s in ENDS:
                best = better(best, self.best[0][s])
            out["cost"], out["audit"] = best[0], best[1].spell()
            digest = Digest()
            replay = Replay(out["audit"])
            for role, text in self.rows:
                digest.add(replay.feed(role, text))
            digest.add(replay.finish())
            out["repaired_sha256"] = digest.hex()
        else:
            out["paths"] = [{"origin": s, "goal": t, "cost": held[0], "audit": held[1].spell()}
                            for s, best in self.best.items() for t, held in enumerate(best) if held is not None]
        return out


class Replay:
    """Applies an audit to rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _made(self) -> str:
        self.state = MAKE[self.state]
        return MADE[self.state]

    def finish(self) -> list[tuple[str, str]]:
        """The turns inserted before the next row, or at the end."""
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            out.append((self._made(), ""))
            self.at += 1
        return out

    def feed(self, role: str, text: str) -> list[tuple[str, str]]:
        out = self.finish()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[self.state, role[:1]]
            out.append((role, text))
        elif letter == "R":
            out.append((self._made(), text))
        return out


class Digest:
    """SHA-256 of turns as `role:text`, joined by line feeds."""

    def __init__(self):
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, turns: list[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def hex(self) -> str:
        return self.sha.hexdigest()


def records(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names])


def audit_pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation of an ordered partition; the first and the last may go on elsewhere and stay pieces."""
    part = TaskContext.get().partitionId()
    piece, first, ready = None, True, []
    for batch in batches:
        for conversation, turn, role, text, digest in records(batch, ["conv_id", "turn", "role", "text", "digest"]):
            if piece is None:
                piece = Piece(conversation, (0, 1, 2, 3), False)
            elif conversation != piece.conversation:
                ready.append(piece.row(part, not first))
                piece, first = Piece(conversation, (0,), True), False
            piece.add(turn, role, text, digest)
        if len(ready) >= 500:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready = []
    if piece is not None:
        ready.append(piece.row(part, False))
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


class Chain:
    """Audits of pieces, linked; chains of one conversation that are compared have the same number of pieces."""
    __slots__ = ("parent", "text")

    def __init__(self, parent: "Chain | None", text: str):
        self.parent, self.text = parent, text

    def less(self, other: "Chain") -> bool:
        mine, others, a, b = [], [], self, other
        while a is not b:
            mine.append(a.text)
            others.append(b.text)
            a, b = a.parent, b.parent
        return "".join(reversed(mine)) < "".join(reversed(others))

    def spell(self) -> str:
        parts, node = [], self
        while node is not None:
            parts.append(node.text)
            node = node.parent
        return "".join(reversed(parts))


def chained(table: pa.Table) -> pa.Table:
    """One conversation from its pieces, in the order of their partitions."""
    pieces = sorted(table.to_pylist(), key=lambda p: p["part"])
    out = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    best: dict[int, tuple[int, Chain]] = {0: (0, Chain(None, ""))}
    first = last = final = None
    for p in pieces:
        if final is not None and final + p["initial"] not in LEGAL:
            out["illegal"] += 1
        final = p["final"]
        if p["first_turn"] is not None:
            out["turns"] -= p["first_turn"] == last
            first, last = p["first_turn"] if first is None else first, p["last_turn"]
        new: dict[int, tuple[int, Chain]] = {}
        for path in p["paths"]:
            if path["origin"] not in best:
                continue
            cost, chain = best[path["origin"]]
            made, held = (cost + path["cost"], Chain(chain, path["audit"])), new.get(path["goal"])
            if held is None or made[0] < held[0] or made[0] == held[0] and made[1].less(held[1]):
                new[path["goal"]] = made
        best = new
    found = min((best[s] for s in ENDS if s in best), key=lambda b: (b[0], b[1].spell()))
    out |= {"first_turn": first, "last_turn": last, "cost": found[0], "audit": found[1].spell()}
    columns = ["conv_id", *[f"c{i}" for i in range(9)]]
    values = [pieces[0]["conv_id"], *[out[c] for c in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost")], out["audit"]]
    types = [table.schema.field("conv_id").type, *[pa.int64()] * 8, pa.string()]
    return pa.table({n: pa.array([v], t) for n, v, t in zip(columns, values, types)})


def replay_rows(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    """Streams ordered rows after the audit of their conversation: the digest, or the repaired turns."""
    conversation, replay, digest, place, ready, kind, schema = None, None, None, 0, [], None, None

    def put(turns: list[tuple[str, str]]) -> None:
        nonlocal place
        if digests:
            digest.add(turns)
            return
        for role, text in turns:
            ready.append((conversation, place, role, text))
            place += 1

    def close() -> None:
        put(replay.finish())
        if digests:
            ready.append((conversation, digest.hex()))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*ready))
        types = [kind, pa.string()] if digests else [kind, pa.int64(), pa.string(), pa.string()]
        names = ["conv_id", "repaired_sha256"] if digests else ["conv_id", "place", "role", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for key, step_, role, text in records(batch, ["conv_id", "step", "role", "text"]):
            if step_ == 0:
                if replay is not None:
                    close()
                conversation, replay, digest, place = key, Replay(text), Digest(), 0
            else:
                put(replay.feed(role, text))
        if ready:
            yield flush()
            ready = []
    if replay is not None:
        close()
    if ready:
        yield flush()


def prepared(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                       text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def in_order(audits: DataFrame, keyed: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows by turn, all in one partition and sorted."""
    lead = audits.select("conv_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    rows = keyed.select("conv_id", F.lit(1).alias("step"), "turn", "role", "text", "digest")
    return lead.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "digest")


def repeated_later(keyed: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, digest)` whose role and text already occur at an earlier turn of the conversation."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    spots = keyed.select("conv_id", "turn", "role", "digest").distinct()
    first = spots.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return spots.join(first, same).where(place > F.col("first")).select("conv_id", "turn", "role", "digest")


def audit(rows: DataFrame) -> DataFrame:
    """`(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)` of each conversation.

    `rows` holds conv_id, turn, role and text. Rows go by turn, nulls first; rows of one turn by role and digest of the
    text. A null role or text is one space, a null conv_id is a conversation of its own kind, other columns are not
    read. No rows give no conversations. Each row has at most one fault, the first of: blank (only white space), duplicate
    (role and text seen earlier in the conversation), truncated (the last character that is not white space is none of
    `.!?`). Texts are read whole; a role other than the known ones counts by its first letter.
    """
    spark = rows.sparkSession
    keyed = prepared(rows)
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size["n"] // PART_ROWS), -(-size["b"] // PART_BYTES))
    marks = pin(repeated_later(keyed)).withColumn("text", F.lit(None).cast("string"))
    dealt = keyed.unionByName(marks).repartitionByRange(parts, "conv_id", "turn", "role", "digest").sortWithinPartitions(
        "conv_id", "turn", "role", "digest", F.col("text").isNotNull())
    kind = keyed.schema["conv_id"].dataType
    layout = (f"conv_id {kind.simpleString()}, part int, whole boolean, first_turn long, last_turn long, turns long, initial string, final string, "
              "blank long, duplicate long, truncated long, illegal long, paths array<struct<origin:int,goal:int,cost:long,audit:string>>, "
              "cost long, audit string, repaired_sha256 string")
    from pyspark.sql.pandas.types import to_arrow_type
    path = pa.struct([("origin", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    longs = lambda *names: [(n, pa.int64()) for n in names]
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("part", pa.int32()), ("whole", pa.bool_()), *longs("first_turn", "last_turn", "turns"),
                        ("initial", pa.string()), ("final", pa.string()), *longs("blank", "duplicate", "truncated", "illegal"),
                        ("paths", pa.list_(path)), *longs("cost"), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    found = pin(dealt.mapInArrow(lambda batches: audit_pieces(batches, schema), layout))

    # At most two pieces a partition: a short list, whatever the size of the table.
    pieces = found.where("NOT whole").groupBy("conv_id").applyInArrow(
        chained, f"conv_id {kind.simpleString()}, " + ", ".join(f"c{i} long" for i in range(8)) + ", c8 string")
    names = ["first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    pieces = pin(pieces.select("conv_id", *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]))
    met = F.broadcast(pieces.select(F.col("conv_id").alias("_c")))
    again = keyed.join(met, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    digests = in_order(pieces, again).mapInArrow(lambda b: replay_rows(b, True), f"conv_id {kind.simpleString()}, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv_id", "_c")
    joined = pieces.join(digests, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    every = found.where("whole").select(*joined.columns).unionByName(joined)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """`(conv_id, place, role, text)`: the turns that the audits of `audit(rows)` leave, counted from 0."""
    keyed = prepared(rows)
    kind = keyed.schema["conv_id"].dataType.simpleString()
    return in_order(audits, keyed).mapInArrow(lambda b: replay_rows(b, False), f"conv_id {kind}, place long, role string, text string")


def damage(rows: DataFrame) -> DataFrame:
    """Drops, empties, cuts, repeats or reassigns one row in twenty each, by crc32 of `conv_id:turn`; nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    hit = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    return hit.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      F.explode(copies).alias("copy")).drop("copy")


def audit_damaged(rows: DataFrame) -> DataFrame:
    """The audit of every conversation of `rows` after `damage`; one that lost all its rows has zeros and an empty audit."""
    found = audit(damage(rows)).withColumnRenamed("conv_id", "_c")
    all_ids = rows.select("conv_id").distinct()
    out = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    return out.fillna(0, COUNTS).fillna({"audit": "", "repaired_sha256": EMPTY})
