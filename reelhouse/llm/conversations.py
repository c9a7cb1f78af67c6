"""Repair of conversations whose turns are missing, empty, repeated, cut off or said by the wrong role.

A repair keeps, reroles or deletes each turn, and may insert empty turns, so that the roles' initials
read ``(s?(ua)+)?``. It is a shortest path through a graph without cycles: a node is the number of turns read,
the number of turns inserted and what was said last; an edge is an edit. The weight of a path is one
integer. Its high digits are the cost. Its low digits, of a fixed width of three bits each, are the
initials of the edits, the first one highest: the edit that writes letter k weighs its cost times
8 ** width plus its letter times 8 ** (width - 1 - k), and places without a letter at the end are
zeros. So of two paths the smaller integer costs less, or costs the same and comes first as a string, and
the ordinary minimum of integers decides everything.

Long conversations: without inserted turns all paths to a row have the same number of letters, so the weights
can be renewed every ``BLOCK`` letters: the cost stays, and the letters so far, written down, give way to their
rank among the nodes. Integers stay short and the work linear. With them, the width is that of the whole
conversation.

How many turns a cheapest repair inserts (``most_inserts``): an inserted turn and any user's or assistant's turn
beside it can both go, and what is left still alternates; only a system's turn may have to go as well. If
inserting costs more than two deletions, that is always cheaper, so nothing is inserted.

Rows are dealt by conversation and sorted; a conversation is read turn by turn. Every node carries the hash of what
its path has written, so texts are neither kept nor read twice. What is kept for a turn is a letter for each node and
a digest of its role and text. One conversation's turns are read by one task, however many, since a hash of
all of them is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: Letters of the audit in ASCII order, from the digit 1 on.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(1, 5)
#: Letters after which weights are renewed.
BLOCK = 64
#: What was said last: nothing, or a turn of the system, a user or an assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NODES, ENDS = 4, (NOTHING, ASSISTANT)
#: Where a turn with an initial leads from each node, and the initials that may be said there.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def most_inserts(turns: int, costs: Costs) -> int:
    """A number of inserted turns that no cheapest repair of so many turns exceeds; see above."""
    return 0 if costs.insert > 2 * costs.delete else turns + 2


class _Writer:
    """The hash of the turns that a path has written, one a line."""

    __slots__ = ("digest", "any")

    def __init__(self, digest=None, some: bool = False) -> None:
        self.digest, self.any = digest or hashlib.sha256(), some

    def after(self, role: str, text: bytes) -> _Writer:
        new = self.digest.copy()
        new.update((b"\n" if self.any else b"") + role.encode() + b":")
        new.update(text)
        return _Writer(new, True)


class Repair:
    """Reads turns one by one and keeps a cheapest way to each node.

    ``turns``: their number, if turns may be inserted, which the width of weights then depends on.
    """

    def __init__(self, costs: Costs = Costs(), turns: int = 0) -> None:
        self.costs = costs
        self.inserts = most_inserts(turns, costs)
        self.width = turns + self.inserts if self.inserts else BLOCK
        self.letters = 0  # of the present block
        #: (inserted, node): (weight, letters of earlier blocks, hash of what is written).
        self.best: dict[tuple[int, int], tuple[int, tuple | None, _Writer]] = {(0, NOTHING): (0, None, _Writer())}
        self._insert()

    def _weight(self, cost: int, letter: int, place: int) -> int:
        return (cost << 3 * self.width) + (letter << 3 * (self.width - 1 - place))

    @staticmethod
    def _offer(best: dict, node: tuple[int, int], weight: int, told, writer, role: str | None = None, text: bytes = b"") -> None:
        """The smaller weight stays; what it writes is hashed only when it is known to stay."""
        known = best.get(node)
        if known is None or weight < known[0]:
            best[node] = (weight, told, writer, role, text)

    @staticmethod
    def _written(best: dict) -> dict:
        return {k: v if len(v) == 3 else (v[0], v[1], v[2] if v[3] is None else v[2].after(v[3], v[4])) for k, v in best.items()}

    def _insert(self) -> None:
        """Edges that insert a turn, by the number of turns inserted, so each leads to a node not yet left."""
        for j in range(self.inserts):
            for (i, node), (weight, told, writer) in [x for x in self.best.items() if x[0][0] == j]:
                for initial, after in NEXT[node].items():
                    if initial in ROLES:
                        offered = weight + self._weight(self.costs.insert, INSERT, self.letters + i)
                        self._offer(self.best, (i + 1, after), offered, told, writer, ROLES[initial])
            self.best = self._written(self.best)

    def read(self, role: str, text: bytes, fault: str | None) -> None:
        """One more turn, with its first fault."""
        new: dict = {}
        initial = role[:1]
        extra = self.costs.truncated if fault == TRUNCATED else 0
        for (j, node), (weight, told, writer) in self.best.items():
            place = self.letters + j
            self._offer(new, (j, node), weight + self._weight(self.costs.delete, DELETE, place), told, writer)
            if fault in (BLANK, DUPLICATE):
                continue
            for allowed, after in NEXT[node].items():
                if allowed == initial:
                    self._offer(new, (j, after), weight + self._weight(extra, KEEP, place), told, writer, role, text)
                if allowed in ROLES:
                    weighed = weight + self._weight(self.costs.rerole + extra, REROLE, place)
                    self._offer(new, (j, after), weighed, told, writer, ROLES[allowed], text)
        self.best = self._written(new)
        self.letters += 1
        self._insert()
        if not self.inserts and self.letters == self.width:
            self._renew()

    def _audit(self, weight: int) -> str:
        digits = weight & ((1 << 3 * self.width) - 1)
        found = (digits >> 3 * (self.width - 1 - k) & 7 for k in range(self.width))
        return "".join(LETTERS[d - 1] for d in found if d)

    def _block(self, weight: int, told: tuple | None) -> str:
        """The letters of the present block; in all but the first, a rank is the first digit."""
        rank = 0 if told is None else 7 << 3 * (self.width - 1)
        return self._audit(weight & ~rank)

    def _renew(self) -> None:
        """Letters so far give way to their rank, the first digit of the next block; equal ranks are equal letters."""
        low = (1 << 3 * self.width) - 1
        ranks = {a: k for k, a in enumerate(sorted({w & low for w, _, _ in self.best.values()}))}
        top = 3 * (self.width - 1)
        self.best = {
            node: (weight - (weight & low) + (ranks[weight & low] << top), (told, self._block(weight, told)), writer)
            for node, (weight, told, writer) in self.best.items()
        }
        self.letters = 1

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, hash of what is written) of the cheapest repair."""
        weight, told, writer = min((v for (_, node), v in self.best.items() if node in ENDS), key=lambda v: v[0])
        blocks = [self._block(weight, told)]
        while told is not None:
            told, block = told
            blocks.append(block)
        return weight >> 3 * self.width, "".join(reversed(blocks)), writer.digest.hexdigest()


def damage(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text, gone) as a test of repair: of 20 values of a checksum five each do a kind of damage.

    0: the turn goes, and stays as a row that is ``gone``. 1: its text becomes empty. 2: it loses ``.``, ``!`` and ``?``.
    3: it comes twice. 4: a user says it. A null is one space, in the key of the checksum as in a role or text.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = rows.select(
        F.col(id_col).alias("conv"),
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


REPAIRED = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
#: Pairs of initials that may follow each other.
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    def __init__(self, costs: Costs, turns: int) -> None:
        self.repair = Repair(costs, turns)
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.seen: set[bytes] = set()
        self.first = self.last = self.initial = None
        self.distinct = self.illegal = 0

    def read(self, turn: int | None, role: str, text: bytes, blank: bool, whole: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in _LEGAL
        self.initial = role[:1]
        # The role's length tells it from the text, so equal digests are equal turns.
        said = hashlib.blake2b(b"%d:" % len(role.encode()) + role.encode() + text, digest_size=16).digest()
        fault = BLANK if blank else DUPLICATE if said in self.seen else None if whole else TRUNCATED
        self.seen.add(said)
        if fault is not None:
            self.counts[fault] += 1
        self.repair.read(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, *self.repair.result()


def repaired(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row of ``REPAIRED`` for each conversation of ``rows`` (conv, turn, role, text, gone).

    Rows that are gone don't count; a conversation of which none is left has zeros, an empty audit and the hash of
    nothing. Turns come in order, nulls first; rows of the same turn by role, then text. A null conversation is one
    like any other. No rows give no rows.
    """
    common.importable_on_workers(rows.sparkSession)
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    # The number of turns is only needed where turns may be inserted.
    inserts = most_inserts(1, costs) > 0
    told = rows.select(
        "conv",
        "turn",
        "role",
        F.col("text").cast("binary").alias("text"),
        "gone",
        (trimmed == "").alias("blank"),
        F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("whole"),
    )
    if inserts:
        counts = told.groupBy(F.col("conv").alias("_conv")).agg(F.count_if(~F.col("gone")).cast("int").alias("turns"))
        told = told.join(counts, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    else:
        told = told.withColumn("turns", F.lit(0))
    order = (F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    told = told.repartition("conv").sortWithinPartitions(*order)

    schema = f"conv {dict(rows.dtypes)['conv']}, {REPAIRED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns_read, out = None, None, []
        kinds: pa.Schema | None = None

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], schema=kinds)

        for batch in batches:
            if kinds is None:
                names = [c.split() for c in REPAIRED.split(", ")]
                own = [(n, pa.int64() if k == "bigint" else pa.string()) for n, k in names]
                kinds = pa.schema([("conv", batch.schema.field("conv").type), *own])
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for c, turn, role, text, gone, blank, whole, turns in zip(*columns):
                if turns_read is None or c != conv:
                    if turns_read is not None:
                        out.append((conv, *turns_read.row()))
                    conv, turns_read = c, _Conversation(costs, turns)
                if not gone:
                    turns_read.read(turn, role, text, blank, whole)
            if len(out) >= 4096:
                yield listed()
                out = []
        if turns_read is not None:
            out.append((conv, *turns_read.row()))
            yield listed()

    return told.mapInArrow(run, schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damage(common.read(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def _sql_nodes() -> str:
    """A list expression for each node: the best of what leads there from the nodes of ``z`` by the turn ``x``."""
    names, never, fields = "nsua", 1_000_000_000, []
    barred = f"CASE x.fault WHEN 'blank' THEN {never} WHEN 'duplicate' THEN {never} WHEN 'truncated' THEN 5 ELSE 0 END"
    for after, name in enumerate(names):
        edges = [f"{{'c': z.{name}.c + 2, 't': z.{name}.t || 'D', 'w': z.{name}.w}}"]
        for node, following in zip(names, NEXT):
            for initial in (i for i, to in following.items() if to == after):
                kept = f"z.{node}.c + {barred} + CASE WHEN x.who[1] = '{initial}' THEN 0 ELSE {never} END"
                edges.append(f"{{'c': {kept}, 't': z.{node}.t || 'K', 'w': list_append(z.{node}.w, x.who || ':' || x.body)}}")
                if initial in ROLES:
                    written = f"list_append(z.{node}.w, '{ROLES[initial]}:' || x.body)"
                    edges.append(f"{{'c': z.{node}.c + {barred} + 1, 't': z.{node}.t || 'R', 'w': {written}}}")
        fields.append(f"'{name}': list_sort([{', '.join(edges)}])[1]")
    return ", ".join(fields)


def _sql_start(cost: int) -> str:
    return f"{{'c': {cost}::BIGINT, 't': '', 'w': []::VARCHAR[]}}"


_SQL_FIRST = ", ".join(f"'{n}': {_sql_start(0 if n == 'n' else 1_000_000_000)}" for n in "nsua")
#: DuckDB has no CRC-32, so it is spelled out: a table of 256, then a step a byte. Turns are read by ``list_reduce``. Nothing
#: is inserted, see ``most_inserts``.
OP11_SQL = f"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS steps
  FROM range(256) r(n)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda k: ascii(k)::BIGINT) AS bytes
  FROM conversations
), summed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(bytes, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS who,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS body,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, body) AS place,
    rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged
), faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, who, body ORDER BY place) > 1 THEN 'duplicate'
      WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(who[1]) OVER (PARTITION BY conv_id ORDER BY place) || who[1] AS pair FROM placed
), read AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list({{{_SQL_FIRST}, 'who': who, 'body': body, 'fault': fault}} ORDER BY place),
      lambda z, x: {{{_sql_nodes()}, 'who': '', 'body': '', 'fault': ''}}, {{{_SQL_FIRST}, 'who': '', 'body': '', 'fault': ''}}) AS z
  FROM faulty GROUP BY conv_id
), best AS (SELECT *, list_sort([z.n, z.a])[1] AS b FROM read)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.t, '') AS audit,
  sha256(coalesce(array_to_string(b.w, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""
