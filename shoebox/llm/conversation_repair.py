"""Conversation structure repair (operator 11): secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn; mapInPandas then walks each conversation once, across Arrow batches. What it
carries is the state of a small dynamic program: for each of the four places in the grammar ``(s?(ua)+)?`` the least cost
so far, the order of the edit strings that lead there, and the running digest of the repaired rows. Costs are kept relative to the
least one, and a place that is too dear to win is forgotten, so only a few program states occur and each step is one
lookup. A step leaves four bytes behind, the number of its transition; beyond ``spill_rows`` of them these backpointers go to an anonymous file of the task
(it has no name, no other task reads it, and the system removes it with the task), and the edits are read back from its end.
A conversation of any length so needs bounded memory, apart from its audit, which is part of the result.

Which rows repeat an earlier one is found before, by an aggregation over (conversation, role, text), so that no set of seen rows grows in a task.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .kernels import release

#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places in the grammar: nothing yet, after s, after u, after a; and where a role's initial leads from each.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
#: From any place, what another place can still do costs at most 10 more: a place that is dearer by more can't win.
HOPELESS = 12
START = ((0, 0), None, None, None)

REPAIRED = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@cache
def _inserts(place: int) -> tuple[tuple[int, str], ...]:
    """(place after, initials inserted) by at most two insertions."""
    out, at, roles = [(place, "")], place, ""
    for _ in range(2):
        role = next(r for r in "ua" if r in NEXT[at])
        at, roles = NEXT[at][role], roles + role
        out.append((at, roles))
    return tuple(out)


@cache
def _moves(place: int, initial: str, must_go: bool, truncated: bool) -> tuple[tuple, ...]:
    """(place after, cost, edits, roles inserted, role kept: None deletes, "" keeps) for one row."""
    out = []
    for at, roles in _inserts(place):
        dear = INSERT * len(roles)
        out.append((at, dear + DELETE, "I" * len(roles) + "D", roles, None))
        if must_go:
            continue
        dear += TRUNCATED * truncated
        if initial in NEXT[at]:
            out.append((NEXT[at][initial], dear, "I" * len(roles) + "K", roles, ""))
        out += [(to, dear + REROLE, "I" * len(roles) + "R", roles, role) for role, to in NEXT[at].items() if role in ROLE]
    return tuple(out)


class Program:
    """Transitions of the dynamic program, each computed once. A state is, for each place, None or (cost above the least, rank of its
    edits): no two edit strings are equal or begin one another, as the edits determine the roles, so ranks are strict, and what is
    appended decides only between strings from one place."""

    def __init__(self):
        self.known, self.steps = {}, []

    def step(self, state: tuple, initial: str, must_go: bool, truncated: bool) -> int:
        key = (state, initial if initial in ("s", "u", "a") else "", must_go, truncated and not must_go)
        number = self.known.get(key)
        if number is None:
            number = self.known[key] = len(self.steps)
            self.steps.append(self._step(*key))
        return number

    @staticmethod
    def _step(state: tuple, initial: str, must_go: bool, truncated: bool) -> tuple:
        """(state after, least cost added, for each place (place before, edits, roles inserted, role kept))."""
        best: list = [None] * 4
        for place, have in enumerate(state):
            if have is None:
                continue
            for to, dear, edits, roles, role in _moves(place, initial, must_go, truncated):
                found = (have[0] + dear, have[1], edits, place, roles, role)
                if best[to] is None or found[:3] < best[to][:3]:
                    best[to] = found
        least = min(b[0] for b in best if b)
        best = [b if b and b[0] - least <= HOPELESS else None for b in best]
        order = sorted((b[1], b[2]) for b in best if b)
        after = tuple(b and (b[0] - least, order.index((b[1], b[2]))) for b in best)
        return after, least, tuple(b and (b[3], b[2], b[4], b[5]) for b in best)

    @staticmethod
    def end(state: tuple) -> tuple[int, int, str]:
        """(cost, place, roles inserted last) of the best way to end."""
        every = [(have[0] + INSERT * len(roles), have[1], "I" * len(roles), place, roles) for place, have in enumerate(state) if have for at, roles in _inserts(place) if at in ENDS]
        cost, _, _, place, roles = min(every)
        return cost, place, roles


class Trail:
    """Four-byte numbers, written forward and read backward; beyond ``keep`` of them in an anonymous file."""

    def __init__(self, keep: int):
        self.keep, self.last, self.file, self.spilled = keep, array("I"), None, 0

    def add(self, number: int) -> None:
        self.last.append(number)
        if len(self.last) >= self.keep:
            self.file = self.file or tempfile.TemporaryFile()
            self.last.tofile(self.file)
            self.spilled += len(self.last)
            self.last = array("I")

    def backward(self):
        yield from reversed(self.last)
        size = array("I").itemsize
        for at in range(self.spilled - self.keep, -1, -self.keep):
            part = array("I")
            self.file.seek(at * size)
            part.fromfile(self.file, self.keep)
            yield from reversed(part)

    def close(self) -> None:
        if self.file:
            self.file.close()


class Conversation:
    """One conversation on its way through the rows, in order."""

    def __init__(self, conv_id, program: Program, keep: int):
        self.conv_id, self.program, self.trail = conv_id, program, Trail(keep)
        self.state, self.cost = START, 0
        self.texts = (hashlib.sha256(), None, None, None)  # never changed once another place may share them
        self.empty = (True,) * 4
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = self.row = None

    def add(self, turn, role: str, text: str, first_turn, known: bool) -> None:
        """``known``: first_turn (may be null) is the first turn with this role and text."""
        body = text.rstrip(" \t\n\x0b\x0c\r")
        again = known and (turn != first_turn or self.row == (turn, role, text))
        self.row = (turn, role, text) if known else None
        blank, duplicate = not body, bool(body) and again
        truncated = bool(body) and not duplicate and body[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        number = self.program.step(self.state, initial, blank or duplicate, truncated)
        self.trail.add(number)
        self.state, more, ways = self.program.steps[number]
        self.cost += more
        texts, empty = [None] * 4, [True] * 4
        line = None
        for to, way in enumerate(ways):
            if way is None:
                continue
            place, _, roles, kept = way
            digest, nothing = self.texts[place], self.empty[place]
            if roles or kept is not None:
                digest = digest.copy()
                for r in roles:
                    digest.update(f"{'' if nothing else chr(10)}{ROLE[r]}:".encode())
                    nothing = False
                if kept is not None:
                    line = line if line is not None else text.encode()
                    digest.update(f"{'' if nothing else chr(10)}{ROLE.get(kept, role)}:".encode())
                    digest.update(line)
                    nothing = False
            texts[to], empty[to] = digest, nothing
        self.texts, self.empty = tuple(texts), tuple(empty)

    def result(self) -> tuple:
        cost, place, roles = self.program.end(self.state)
        digest, nothing = self.texts[place].copy(), self.empty[place]
        for r in roles:
            digest.update(f"{'' if nothing else chr(10)}{ROLE[r]}:".encode())
            nothing = False
        edits = bytearray(b"I" * len(roles))
        for number in self.trail.backward():
            place, letters, _, _ = self.program.steps[number][2][place]
            edits += letters[::-1].encode()
        edits.reverse()
        self.trail.close()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost, edits.decode(), digest.hexdigest())


def repair(rows: DataFrame, spill_rows: int = 1 << 18) -> DataFrame:
    """(conv_id, turn, role, text, present) -> one row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows come in order of turn (null first); rows of one turn by role, then text, so that repeated rows are adjacent. Rows that
    are not present only make their conversation known: one without any other has zeros, an empty audit and the empty string's digest.
    Null roles and texts count as one space, which no grammar has as a role and which is blank; an empty role has no initial and can't be kept.
    Null conv_ids are one conversation. Other columns are ignored. An empty table gives no rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = rows.schema["conv_id"].dataType
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.coalesce("present", F.lit(False)).alias("present"))
    own = own.withColumn("fact", F.when(F.col("present"), F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))))
    # only what occurs more than once; a frequent row is combined in every task, and the unique side of the join has one row of it
    twice = own.where("present").groupBy(F.col("conv_id").alias("c"), F.col("fact").alias("f")).agg(F.count("*").alias("n"), F.count("turn").alias("turns"), F.min("turn").alias("turn")).where("n > 1")
    twice = twice.select("c", "f", F.when(F.col("turns") == F.col("n"), F.col("turn")).alias("first_turn"), F.lit(True).alias("known"))
    judged = own.join(twice, own["conv_id"].eqNullSafe(twice["c"]) & (own["fact"] == twice["f"]), "left")
    judged = judged.select("conv_id", "turn", "role", "text", "present", "first_turn", F.coalesce("known", F.lit(False)).alias("known"))
    dealt = judged.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "present")
    # numbers travel as text: pandas would turn those of a column with nulls into floating ones
    dealt = dealt.select(*[F.col(c).cast("string").alias(c) for c in ("conv_id", "turn", "first_turn")], "role", "text", "present", "known")

    def run(batches):
        program, now, done = Program(), None, []
        columns = [c.split()[0] for c in REPAIRED.split(", ")]
        try:
            for batch in batches:
                for key, turn, first, role, text, present, known in batch.itertuples(index=False, name=None):
                    if now is None or now.conv_id != key:
                        done += [now.result()] if now is not None else []
                        now = Conversation(key, program, spill_rows)
                    if present:
                        now.add(None if turn is None else int(turn), role, text, None if first is None else int(first), known)
                if done:
                    yield pd.DataFrame(done, columns=columns)
                    done = []
            if now is not None:
                yield pd.DataFrame([now.result()], columns=columns)
        finally:
            release()

    return dealt.mapInPandas(run, REPAIRED).withColumn("conv_id", F.col("conv_id").cast(kind))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(conv_id:turn) % 20, nulls as one space: 0 drops the row (present is false), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4
    makes its role user; all others stay. (conv_id, turn, role, text, present); other columns are left out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") < 2, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), "fate")
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE = {"op11_conversation_repair": """with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k from conversations),
f as (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(0, 8 * strlen(k)), lambda i: (ascii(substr(k, i // 8 + 1, 1)) >> (i % 8)::integer) & 1)), lambda x, b: xor(x >> 1, 3988292384 * (xor(x, b) & 1))), 4294967295) % 20 fate from c),
d as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end as text from f, range(2) r(copy) where fate <> 0 and (copy = 0 or fate = 3)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) body from d),
q as (select *, row_number() over (partition by conv_id, role, text order by i) seen from o),
r as (select *, body = '' as blank, body <> '' and seen > 1 as dup, body <> '' and seen = 1 and right(body, 1) not in ('.', '!', '?') as trunc, left(role, 1) initial, lag(left(role, 1)) over (partition by conv_id order by i) before from q),
nxt(place, initial, dest) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(place, pos, edits) as (select place, place, '' from (values (0), (1), (2), (3)) p(place) union all select place, dest, 'I' from nxt where initial <> 's' union all select a.place, b.dest, 'II' from nxt a join nxt b on a.dest = b.place where a.initial <> 's'),
mv(place, initial, dest, cost, edits, kind) as (select place, null, pos, 3 * strlen(edits) + 4, edits || 'D', 'D' from ins union all select ins.place, initial, dest, 3 * strlen(edits), edits || 'K', 'K' from ins join nxt on pos = nxt.place union all select ins.place, null, dest, 3 * strlen(edits) + 3, edits || 'R', 'R' from ins join nxt on pos = nxt.place where initial <> 's'),
dp as (select conv_id, 0::bigint i, 0 place, 0::bigint as cost, '' audit from (select distinct conv_id from r)
union all select conv_id, i, dest, best.c, best.a from (select dp.conv_id, r.i, mv.dest, min({'c': dp.cost + mv.cost + case when trunc and kind <> 'D' then 3 else 0 end, 'a': dp.audit || mv.edits}) best from dp join r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1 join mv on mv.place = dp.place and (kind = 'D' or not blank and not dup and (kind = 'R' or mv.initial = r.initial)) group by 1, 2, 3)),
n as (select conv_id, max(i) n, count(*) filter (blank) blank, count(*) filter (dup) as duplicate, count(*) filter (trunc) truncated, count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps from r group by 1),
e as (select dp.conv_id, min({'c': dp.cost + 3 * strlen(ins.edits), 'a': dp.audit || ins.edits}) best from dp join n on n.conv_id is not distinct from dp.conv_id and dp.i = n.n join ins on ins.place = dp.place and ins.pos in (0, 3) group by 1),
l as (select conv_id, best.a audit, unnest(range(1, strlen(best.a) + 1)) j from e), w as (select *, substr(audit, j, 1) edit, strlen(replace(audit, 'D', '')) kept, strlen(replace(substr(audit, 1, j), 'D', '')) nth, strlen(replace(substr(audit, 1, j), 'I', '')) i from l),
lines as (select w.conv_id, j, case when edit = 'K' then role || ':' || text else case when (nth - kept % 2) % 2 = 1 then 'user:' else 'assistant:' end || case when edit = 'R' then text else '' end end line from w left join r on r.conv_id is not distinct from w.conv_id and r.i = w.i and edit <> 'I' where edit <> 'D'),
t as (select conv_id, string_agg(line, chr(10) order by j) whole from lines group by 1)
select a.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') audit, sha256(coalesce(whole, '')) repaired_sha256
from (select distinct conv_id from conversations) a left join n on n.conv_id is not distinct from a.conv_id left join e on e.conv_id is not distinct from a.conv_id left join t on t.conv_id is not distinct from a.conv_id"""}
