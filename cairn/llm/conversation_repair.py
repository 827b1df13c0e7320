"""Repair of conversations' structure: the cheapest edits that make roles read (system?)(user assistant)+, or nothing.

A Viterbi search goes through the rows of a conversation with a state for what was said last. Backpointers
form a tree of edits whose nodes count their children; where all surviving paths share the next edit, the tree's root hands it on and moves up,
so only what is still open is held (edits in memory, long texts in a temporary file of the task), however long the conversation. Survivors are held in the order of their complete open
suffixes: no path of as many rows is the beginning of another, so that order decides every tie. A survivor from which nothing can win any more goes.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one of blank and duplicate rows), Insert a row without text 2;
a truncated row that stays adds 1. Ties go to the ASCII-least string of edits' initials.

Rows are shuffled by conversation and streamed in order of turns. One conversation is one stream, as the digest of its repaired text
is; the task holds a batch of rows and the open suffix. What was said before is found by an aggregate
over conversation, role and digest of the text, combined before its shuffle; only texts said again at another turn are joined back.

Edge cases: null roles and texts are one space; rows of one turn are ordered by role, then text; null turns come first and have no
part in gaps; rows without conv_id are one conversation; roles with another initial than s, u, a can't be kept; an empty table gives an empty
result; repeated rows are duplicates; other columns of the input are not looked at. gaps ends at the largest long.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from os import SEEK_END
from tempfile import TemporaryFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tables import stored, table

#: States: nothing yet, a system row, a user row, an assistant row last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
RENAME, DROP, ADD, CUT = 2, 3, 2, 1
#: Characters of open rows' texts in memory.
HELD = 1 << 25
#: State -> (inserted rows, state they lead to); more rows come back to a state at a cost.
INSERTS = {NONE: ((0, NONE), (1, USER), (2, ASSISTANT)), SYSTEM: ((0, SYSTEM), (1, USER), (2, ASSISTANT)), USER: ((0, USER), (1, ASSISTANT)), ASSISTANT: ((0, ASSISTANT), (1, USER))}
#: (a, b): what it costs at most to go on from a instead of b, whatever follows: the same edits, with rows inserted before or a system row deleted.
INSTEAD = {
    (ASSISTANT, SYSTEM): 0, (NONE, SYSTEM): 0, (NONE, ASSISTANT): 0, (ASSISTANT, NONE): DROP, (USER, SYSTEM): ADD, (USER, ASSISTANT): ADD, (ASSISTANT, USER): ADD,
    (NONE, USER): ADD, (SYSTEM, USER): ADD, (SYSTEM, ASSISTANT): 2 * ADD, (USER, NONE): ADD + DROP, (SYSTEM, NONE): 2 * ADD + DROP,
}
NEXT = {NONE: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


class Node:
    """Edits of one row: inserts, then what becomes of the row itself; row is its role and the place of its text where it stays."""

    __slots__ = ("parent", "edits", "row", "children")

    def __init__(self, parent: Node | None, edits: str, row: tuple | None):
        self.parent, self.edits, self.row, self.children = parent, edits, row, 0
        if parent is not None:
            parent.children += 1


class Texts:
    """Texts of the rows still open, in order; beyond ``most`` characters the later ones lie in a file that goes with the task."""

    def __init__(self, most: int):
        self.most, self.held, self.sizes, self.file = most, 0, deque(), None

    def put(self, text: str) -> str | tuple[int, int]:
        """Where the text is."""
        if self.held + len(text) <= self.most:
            self.held += len(text)
            self.sizes.append(len(text))
            return text
        self.file = self.file or TemporaryFile()
        data = text.encode()
        self.sizes.append(0)
        at = self.file.seek(0, SEEK_END)
        self.file.write(data)
        return at, len(data)

    def get(self, place: str | tuple[int, int]) -> str:
        if isinstance(place, str):
            return place
        self.file.seek(place[0])
        return self.file.read(place[1]).decode()

    def settled(self) -> None:
        """The first row is no longer open."""
        self.held -= self.sizes.popleft()
        if not self.sizes and self.file:
            self.file.truncate(0)


class Search:
    """Edits of one conversation, row by row; emit(edit, role, text) is called for each edit once it is certain."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None], most: int = HELD):
        self.emit, self.root, self.said, self.texts = emit, Node(None, "", None), NONE, Texts(most)
        #: state -> (cost, place in the order of open suffixes, last node)
        self.paths: dict[int, tuple[int, int, Node]] = {NONE: (0, 0, self.root)}

    def _steps(self, role: str, removed: bool, cut: bool) -> Iterator[tuple[int, int, int, str, int, Node]]:
        """(state, cost, place of the path so far, edits, what the row costs by itself, last node) of every way on."""
        initial = role[:1]
        for state, (cost, place, node) in self.paths.items():
            for n, at in INSERTS[state]:
                here = cost + n * ADD
                yield at, here + DROP, place, "I" * n + "D", 0, node
                if removed:
                    continue
                if initial == "s" and at == NONE:
                    yield SYSTEM, here + cut, place, "I" * n + "K", 1, node
                to = NEXT[at]
                if initial == to[0]:
                    yield AFTER[initial], here + cut, place, "I" * n + "K", 1, node
                else:
                    yield AFTER[to[0]], here + RENAME + cut, place, "I" * n + "R", 1, node

    def row(self, role: str, text: str, removed: bool, cut: bool) -> None:
        """removed: the row may only be deleted; cut: it is truncated."""
        best: dict[int, tuple[int, int, str, int, Node]] = {}
        for state, *way in self._steps(role, removed, CUT if cut else 0):
            if state not in best or way[:3] < best[state][:3]:
                best[state] = way
        for state, way in list(best.items()):
            if any(way[0] > other[0] + INSTEAD[s, state] for s, other in best.items() if s != state):
                del best[state]
        # edits of one row are no beginning of each other, so places of parents, then edits, order whole suffixes
        order = {state: i for i, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        before = [node for _, _, node in self.paths.values()]
        text = self.texts.put("" if removed else text)
        self.paths = {state: (way[0], order[state], Node(way[4], way[2], (role, text) if way[3] else None)) for state, way in best.items()}
        for node in before:
            self._forget(node)
        self._settle()

    def _forget(self, node: Node) -> None:
        """Paths that nothing leads on from leave the tree."""
        while not node.children and node is not self.root:
            node.parent.children -= 1
            node = node.parent

    def _settle(self) -> None:
        """Hand on the edits that all survivors share."""
        if self.root.children != 1:
            return
        node, chain = next(iter(self.paths.values()))[2], []
        while node is not self.root:
            chain.append(node)
            node = node.parent
        for node in reversed(chain):
            if self.root.children != 1:
                break
            self._hand_on(node)
            self.texts.settled()
            node.parent, self.root = None, node

    def _hand_on(self, node: Node) -> None:
        for edit in node.edits:
            if edit == "D":
                self.emit(edit, None, None)
                continue
            role, text = (NEXT[self.said], "") if edit == "I" else node.row
            text = self.texts.get(text)
            if edit == "R":
                role = NEXT[self.said]
            self.said = AFTER[role[0]]
            self.emit(edit, role, text)

    def end(self) -> int:
        """The cost of all edits; the open ones are handed on."""
        add = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        cost, _, state = min((cost + ADD * add[state], place, state) for state, (cost, place, _) in self.paths.items())
        node, chain = self.paths[state][2], []
        while node is not self.root:
            chain.append(node)
            node = node.parent
        for node in reversed(chain):
            self._hand_on(node)
        self._hand_on(Node(None, "I" * add[state], None))
        return cost

    def open_rows(self) -> int:
        """Rows of the longest path that isn't settled yet."""
        node, n = next(iter(self.paths.values()))[2], 0
        while node is not self.root:
            node, n = node.parent, n + 1
        return n


LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Conversation:
    """Counts and edits of the rows of one conversation in order."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None]):
        self.search, self.counts = Search(emit), dict.fromkeys(COUNTS, 0)
        self.first = self.turn = self.before = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, blank: bool, said: bool, cut: bool) -> None:
        """blank, said (at an earlier turn), cut (no end mark): each by itself; the first of them counts."""
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        fault = "blank" if blank else "duplicate" if said or (turn, role, text) == self.before else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        self.before = turn, role, text
        self.search.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def end(self) -> dict[str, int]:
        if self.turns:
            self.counts["gaps"] = min(self.turn - self.first + 1 - self.turns, 2**63 - 1)
        self.counts["cost"] = self.search.end()
        return self.counts


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with their faults, all of a conversation together, in order.

    gone (where the input has it): the row isn't there, but its conversation has a result.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    keyed = rows.withColumn("digest", F.sha2("text", 256)).withColumn("at", F.struct(F.isnotnull("turn").alias("has"), "turn"))
    key = "conv_id", "role", "digest"
    again = keyed.where("NOT gone").groupBy(*key).agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    again = stored(again.select(*[F.col(c).alias(f"_{c}") for c in key], "first"), "said-again")
    same = keyed["conv_id"].eqNullSafe(again["_conv_id"]) & (keyed["role"] == again["_role"]) & (keyed["digest"] == again["_digest"])
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    faults = keyed.join(again, same, "left").select(
        "conv_id", "turn", "role", "text", "gone", (last == "").alias("blank"), F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("said"), (~last.isin(".", "!", "?")).alias("cut")
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return faults.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches: Iterable[pa.RecordBatch], start: Callable, done: Callable) -> Iterator[object]:
    """start() makes a conversation, done(conv_id, it) its result; what it has so far is looked at after each batch."""
    now, key, some = None, None, False
    for b in batches:
        for conv, *row, gone, blank, said, cut in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "blank", "said", "cut")], strict=True):
            if not some or conv != key:
                if some:
                    yield done(key, now)
                now, key, some = start(conv), conv, True
            if not gone:
                now.row(*row, blank, said, cut)
        yield None
    if some:
        yield done(key, now)


SUMMARY = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}

    def start(conv):
        audit, text = bytearray(), hashlib.sha256()

        def emit(edit, role, said):
            if role is not None:
                text.update(f"{chr(10) * sums['any']}{role}:{said}".encode())
                sums["any"] = True
            audit.extend(edit.encode())

        sums.update(audit=audit, text=text, any=False)
        return Conversation(emit)

    def done(conv, c):
        return {"conv_id": conv, **c.end(), "audit": sums["audit"].decode(), "repaired_sha256": sums["text"].hexdigest()}

    out: list[dict] = []
    for found in _conversations(batches, start, done):
        if found is not None:
            out.append(found)
        elif out:
            yield pa.RecordBatch.from_pylist(out, SUMMARY)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, SUMMARY)


def summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, the cost of its edits, their initials and the SHA-256 of the repaired text."""
    return prepared(rows).mapInArrow(_summaries, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


EDITS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _edits(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    place = [0]

    def start(conv):
        place[0] = 0

        def emit(edit, role, text):
            out.append((conv, place[0], edit, role, text))
            place[0] += 1

        return Conversation(emit)

    for found in _conversations(batches, start, lambda _, c: c.end()):
        while out and (found is None or len(out) >= size):
            part = [pa.array(c, f.type) for c, f in zip(zip(*out[:size], strict=True), EDITS, strict=True)]
            del out[:size]
            yield pa.RecordBatch.from_arrays(part, schema=EDITS)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), EDITS, strict=True)], schema=EDITS)


def edits(rows: DataFrame) -> DataFrame:
    """One row per edit in order: conv_id, place, edit (K, R, D, I), role and text of the row it leaves (null: deleted)."""
    return prepared(rows).mapInArrow(partial(_edits, size=10_000), "conv_id long, place long, edit string, role string, text string")


#: What the query does to a row, by the CRC-32 of conv_id:turn modulo this.
DAMAGES = 20
LOSE, EMPTY, UNEND, REPEAT, MISNAME = range(5)


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations of the query: by the CRC-32 of ``conv_id:turn`` rows are lost (gone), emptied, left without end marks, repeated or said by user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key) % DAMAGES).alias("way"))
    text = F.when(F.col("way") == EMPTY, "").when(F.col("way") == UNEND, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == MISNAME, "user").otherwise(F.col("role"))
    gone = F.col("way") == LOSE
    copies = F.explode(F.when(F.col("way") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), gone.alias("gone"), copies.alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, one row each."""
    return summaries(damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def _sql() -> str:
    """DuckDB SQL of the query: the same search with whole strings of edits and texts in each state."""
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295)"
    white = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def way(of: str, cost: str, edits: str, *rows: str) -> str:
        """A path of the state ``of`` with more cost, edits and rows."""
        text = f"{of}.t" + "".join(f" || CASE WHEN {of}.t = '' AND {i} = 0 THEN '' ELSE chr(10) END || {r}" for i, r in enumerate(rows))
        return f"{{'c': {of}.c + {cost}, 'e': {of}.e || {edits}, 't': {text}}}"

    user, assistant, none = "'user:'", "'assistant:'", "{'c': 1000000000::BIGINT, 'e': '', 't': ''}"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    own = "r.role || ':' || r.text"
    put = lambda of, role: f"CASE WHEN r.removed THEN {none} WHEN left(r.role, 1) = '{role[0]}' THEN {way(of, 'r.cut', repr('K'), own)} ELSE {way(of, '2 + r.cut', repr('R'), f'{role!r} || {chr(39)}:{chr(39)} || r.text')} END"
    gone = lambda of: way(of, "3", "'D'")
    add_user = [way(x, "2", "'I'", user) for x in ("n", "s", "a")]
    add_both = [way(x, "4", "'II'", user, assistant) for x in ("n", "s")]
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), dealt AS (
  SELECT *, {crc} % {DAMAGES} AS way FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN way = {MISNAME} THEN 'user' ELSE role END AS role,
    CASE WHEN way = {EMPTY} THEN '' WHEN way = {UNEND} THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN way = {REPEAT} THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE way <> {LOSE}
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, right(rtrim(text, {white}), 1) AS last FROM hurt
), seen AS (
  SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), judged AS (
  SELECT *, blank OR duplicate AS removed, (NOT blank AND NOT duplicate AND last NOT IN ('.', '!', '?'))::INT AS cut,
    (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'))::INT AS wrong
  FROM seen
), search AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS n, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {least(gone("n"))}, {least(gone("s"), f"CASE WHEN left(role, 1) = 's' AND NOT removed THEN {way('n', 'r.cut', repr('K'), own)} ELSE {none} END")},
    {least(gone("u2"), *[put(x, "user") for x in ("n", "s", "a2")])}, {least(gone("a2"), put("u2", "assistant"))}
  FROM (
    SELECT r.conv_id, r.i, r.role, r.text, r.removed, r.cut, r, n, s, {least("u", *add_user)} AS u2, {least("a", way("u", "2", "'I'", assistant), *add_both)} AS a2
    FROM search JOIN judged r ON r.conv_id IS NOT DISTINCT FROM search.conv_id AND r.i = search.i + 1
  )
), ended AS (
  SELECT conv_id, {least("n", way("s", "4", "'II'", user, assistant), way("u", "2", "'I'", assistant), "a")} AS best FROM search QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum(duplicate::INT)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated, sum(wrong)::BIGINT AS illegal
  FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.e AS audit, sha256(best.t) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE = _sql()
