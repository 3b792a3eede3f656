"""Conversation structure repair by a streamed dynamic programme.

The rows of a conversation become a sequence of role initials that fits
``(s?(ua)+)?`` by the cheapest edits: keep a row (0), give it the role ``user`` or
``assistant`` (1), delete it (2), insert an empty turn of one of these roles (5). A
blank or duplicate row must go; a truncated one costs 5 more where it stays. Among
equally cheap repairs the one with the least string of edit initials is taken.

Method (secondary sort): rows are dealt by conversation, sorted by turn within the
partitions, and streamed through ``mapInPandas``, which carries the state of the
programme across Arrow batches. Four states suffice: nothing yet, after ``s``, after
``u``, after ``a``. For each the state holds the least cost, the order of its string
of edits among the others, the running hash of the repaired conversation and, per
row, one byte of back pointer. The pointers of a giant conversation are spilled to a
nameless file of the task, which the operating system removes with the task; texts
are never kept. A conversation with a third of all rows is one task's stream, but
never in memory: the sorts spill, and what grows with it is four bytes of spilled
pointers a row and its audit string.

Faults are marked before the stream, by one window over (conversation, role, text)
that the same exchange serves.

Defined cases: a null role or text counts as one space, so a row without a text is
blank; a null turn sorts first; rows of one turn stand by role, then text. Rows
without a conversation id are one conversation. A conversation whose rows are all
gone has zeros, an empty audit and the hash of nothing. Role initials other than s,
u and a fit nowhere: such rows are given a role or deleted. Other columns take no
part, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = "\\x20\\x09-\\x0D"
#: Bytes of back pointers that stay in memory.
SPILL_BYTES = 1 << 20
#: Conversations of one result batch, at most.
OUT_ROWS = 10_000

FINE, BLANK, DUPLICATE, CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role initial, where it may follow.
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
EDITS = "DIKR"


# --- the programme -----------------------------------------------------------------------

def _inserts(state: int) -> list[tuple[int, str]]:
    """States that none, one or two inserted turns lead to, with their initials.
    Two lead back to the place in the pattern, so more are never cheapest."""
    out = [(state, "")]
    for _ in range(2):
        at, names = out[-1]
        c = "a" if at == USER else "u"
        out.append((FOLLOWS[at, c], names + c))
    return out


@lru_cache(maxsize=None)
def steps(initial: str, fault: int) -> tuple:
    """All ways through one row: (state before, state after, cost, edits, inserted
    initials, initial under which the row stays or '')."""
    stays = 0 if fault == FINE else TRUNCATED
    out = []
    for before in range(4):
        for at, inserted in _inserts(before):
            cost, edits = INSERT * len(inserted), "I" * len(inserted)
            out.append((before, at, cost + DELETE, edits + "D", inserted, ""))
            if fault in (BLANK, DUPLICATE):
                continue
            if (at, initial) in FOLLOWS:
                out.append((before, FOLLOWS[at, initial], cost + stays, edits + "K", inserted, "="))
            for c in ROLE:
                if (at, c) in FOLLOWS:
                    out.append((before, FOLLOWS[at, c], cost + REROLE + stays, edits + "R", inserted, c))
    return tuple(out)


#: Ways to end in an accepted state.
ENDS = tuple((s, INSERT * len(names), "I" * len(names), names)
             for s in range(4) for at, names in _inserts(s) if at == ASSISTANT or (at == START and not names))


@lru_cache(maxsize=65_536)
def advance(costs: tuple, order: tuple, initial: str, fault: int) -> tuple:
    """One row's step of the programme. ``costs``: least cost per state less the
    least of all (None where out of reach); ``order``: place of each state's string
    of edits among the others. Strings of different states differ before this row,
    each ending in an edit of the row before, so their order decides, and the edits
    of this row only between ways out of one state.

    Returns costs, order, the least cost taken off, and per state the way taken."""
    best: list = [None] * 4
    for way in steps(initial, fault):
        before, after, cost, edits, _, _ = way
        if costs[before] is not None:
            rank = (costs[before] + cost, order[before], edits)
            if best[after] is None or rank < best[after][0]:
                best[after] = (rank, way)
    least = min(b[0][0] for b in best if b)
    strings = sorted(b[0][1:] for b in best if b)
    return (tuple(b and b[0][0] - least for b in best),
            tuple(strings.index(b[0][1:]) if b else 0 for b in best), least, tuple(b and b[1] for b in best))


class Pointers:
    """Back pointers, four bytes a row, on disk beyond ``SPILL_BYTES``: state
    before (2 bits), inserted turns (2), edit (2)."""

    def __init__(self):
        self.tail, self.file, self.rows = bytearray(), None, 0

    def add(self, row: bytes) -> None:
        self.tail += row
        self.rows += 1
        if len(self.tail) >= SPILL_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.tail)
            self.tail = bytearray()

    def backwards(self) -> Iterator[bytes]:
        """Blocks of pointers, the last first."""
        yield bytes(self.tail)
        end = self.file.tell() if self.file else 0
        while end:
            start = max(0, end - SPILL_BYTES)
            self.file.seek(start)
            yield self.file.read(end - start)
            end = start

    def edits(self, state: int) -> str:
        out = bytearray()
        for block in self.backwards():
            for at in range(len(block) - 4, -1, -4):
                p = block[at + state]
                out.append(ord(EDITS[p >> 4]))
                out += b"I" * (p >> 2 & 3)
                state = p & 3
        return out[::-1].decode()

    def close(self) -> None:
        if self.file:
            self.file.close()


@lru_cache(maxsize=65_536)
def _packed(ways: tuple) -> bytes:
    return bytes(w[0] | len(w[4]) << 2 | EDITS.index(w[3][-1]) << 4 if w else 0 for w in ways)


def _turns(digest, empty: bool, names: str, kept: bytes | None):
    """``digest`` with the inserted turns, and the kept row, appended."""
    parts = [f"{ROLE[c]}:".encode() for c in names] + ([kept] if kept is not None else [])
    if not parts:
        return digest
    digest = digest.copy()
    digest.update((b"" if empty else b"\n") + b"\n".join(parts))
    return digest


class Conversation:
    """One conversation as its rows come in."""

    def __init__(self, key):
        self.key, self.cost = key, 0
        self.costs, self.order = (0, None, None, None), (0, 0, 0, 0)
        self.digests: list = [hashlib.sha256(), None, None, None]
        self.pointers = Pointers()
        self.seen = [0, 0, 0, 0]
        self.illegal, self.last = 0, None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, role: str, text: str, fault: int, turn: int | None) -> None:
        initial = role[:1]
        self.seen[fault] += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.last_turn:  # turns ascend
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        kind = initial if initial in ("s", "u", "a") else "x"
        self.costs, self.order, least, ways = advance(self.costs, self.order, kind, fault)
        self.cost += least
        digests: list = [None] * 4
        for state, way in enumerate(ways):
            if way:
                before, _, _, _, names, stays = way
                kept = f"{ROLE.get(stays, role)}:{text}".encode("utf-8", "surrogatepass") if stays else None
                digests[state] = _turns(self.digests[before], before == START, names, kept)
        self.digests = digests
        self.pointers.add(_packed(ways))

    def result(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        ends = [((self.costs[s] + cost, self.order[s], edits), s, names) for s, cost, edits, names in ENDS if self.costs[s] is not None]
        (cost, _, edits), state, names = min(ends)
        audit = self.pointers.edits(state) + edits
        repaired = _turns(self.digests[state], state == START, names, None).hexdigest()
        self.pointers.close()
        return (self.key, gaps, self.seen[BLANK], self.seen[DUPLICATE], self.seen[CUT], self.illegal, self.cost + cost, audit, repaired)


RESULT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT_SCHEMA = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
NO_ID = object()


def repair_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation and turn -> a row per conversation."""
    current, done = None, []
    for batch in batches:
        for conv, gone, role, text, fault, turn in zip(*[batch[c].tolist() for c in ("conv", "gone", "role", "text", "fault", "turn")]):
            if current is None or current.key != conv:
                if current is not None:
                    done.append(current.result())
                current = Conversation(conv)
            if not gone:
                current.add(role, text, fault, None if turn is None or turn == "" else int(turn))
            if len(done) >= OUT_ROWS:
                yield pd.DataFrame(done, columns=RESULT)
                done = []
    if current is not None:
        done.append(current.result())
    if done:
        yield pd.DataFrame(done, columns=RESULT)


# --- the operator -------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the damage of the test: by the checksum of
    ``conv_id:turn`` modulo 20 a row is dropped (marked ``gone``), emptied, stripped
    of its sentence ends, repeated, or given the role user."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    hurt = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                       (F.crc32(name) % 20).alias("hurt"))
    text = F.when(F.col("hurt") <= 1, F.lit("")).when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = hurt.withColumns({"text": text, "role": F.when(F.col("hurt") == 4, F.lit("user")).otherwise(F.col("role"))})
    copies = F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", "role", "text", (F.col("hurt") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def _fault(text: Column, seen: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    return F.when(last == "", F.lit(BLANK)).when(seen, F.lit(DUPLICATE)).when(~last.isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(FINE))


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost and repair of every conversation of ``conv_id, turn, role,
    text`` and, if there, ``gone`` (a row that only names its conversation):
    ``conv_id`` and the columns of ``RESULT``."""
    kind = rows.schema["conv_id"].dataType
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    conv = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    clean = rows.select(conv.alias("conv"), F.col("turn").alias("at"), F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    dealt = clean.repartition("conv")
    earlier = F.row_number().over(Window.partitionBy("conv", "role", "text", "gone").orderBy("at")) > 1
    marked = dealt.withColumn("seen", earlier).withColumn("fault", _fault(F.col("text"), F.col("seen")))
    # among rows of one turn, role and text, the one that was seen first stands first
    stream = marked.sortWithinPartitions("conv", "at", "role", "text", "seen").select("conv", "gone", "role", "text", "fault", "turn")
    out = stream.mapInPandas(repair_stream, RESULT_SCHEMA)
    conv_id = F.when(F.col("conv") == "", F.lit(None)).otherwise(F.expr("substring(conv, 2)")).cast(kind)
    return out.select(conv_id.alias("conv_id"), *RESULT[1:])


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Repair of every conversation after the test's damage."""
    return repair(damaged(table(spark, sf_dir, "conversations")))
