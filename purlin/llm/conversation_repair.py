"""Repair of conversation structure: the cheapest edits after which roles alternate, found by A* on the edit lattice.

A conversation's rows, in the order of their turns, are edited until the initials of their roles read ``(s?(ua)+)?``. A
lattice node is (rows passed, last role); edges keep, re-role, delete or insert. A* expands nodes by (cost plus heuristic,
audit), the audit being the edits' initials so far; the heuristic sums, over the rows ahead, what no edit can avoid:
the deletion of blank and repeated rows, and the charge of each truncated one. It is consistent, so the first
goal expanded is the cheapest repair and, of equal ones, the one whose audit is least in ASCII.

How it runs: texts are replaced by digests at once. Equal rows are counted with map-side combining; the first turn of each
(role, text) comes from one more such aggregation, and is joined on the whole row, so no common text or conversation is
a hot key. Range partitioning by (conversation, turn, role, digest) and sorting lay the rows out; each sorted run is cut
into blocks of ``BLOCK`` rows. A block that doesn't start its conversation is solved once for every role that may stand before
it, and a conversation's blocks are chained by those few costs, so a conversation of any length is spread over many tasks.
Texts come back only for rows that stay. Only the closing SHA-256 of a conversation, sequential by definition, runs through one
task, as a stream.

Defined results: null roles and texts count as one space; null conversation ids are one conversation; null turns come
first; rows of one turn are ordered by role, then by the digest of their text; a role that is empty has no initial and may
stand anywhere; roles other than system, user and assistant must be re-roled or deleted; very long texts are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.llm.common import freeze, partitions, quoted, ship

BLOCK = 4096  # rows solved at a time
BLOCK_CHARS = 4_000_000  # characters of text of a block's rows; a longer row is a block of its own

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # what the rows before end with
STEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ENDS = (START, ASSISTANT)
SPACES = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}

Row = tuple[str, bool, bool]  # initial of the role, must go, is truncated


def wanted(state: int) -> str:
    """The one initial of u and a that may follow."""
    return "a" if state == USER else "u"


def cheapest(rows: list[Row], entry: int = START, goals: tuple[int, ...] = ENDS, every: bool = False) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)} of the cheapest repair, or with ``every`` of the cheapest one into each goal."""
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        _, gone, short = rows[i]
        ahead[i] = ahead[i + 1] + (DELETE if gone else TRUNCATED if short else 0)
    open_, closed, found = [(ahead[0], "", 0, entry)], set(), {}
    while open_:
        total, audit, i, state = heapq.heappop(open_)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = total - ahead[i]
        if i == len(rows) and state in goals:
            found[state] = (cost, audit)
            if not every or len(found) == len(goals):
                break
        filler = STEP[wanted(state), state]
        if (i, filler) not in closed:
            heapq.heappush(open_, (total + INSERT, audit + "I", i, filler))
        if i == len(rows):
            continue
        initial, gone, short = rows[i]
        heapq.heappush(open_, (cost + DELETE + ahead[i + 1], audit + "D", i + 1, state))
        if gone:
            continue
        charge = cost + TRUNCATED * short + ahead[i + 1]
        kept = STEP.get((initial, state)) if initial else state
        if kept is not None:
            heapq.heappush(open_, (charge, audit + "K", i + 1, kept))
        heapq.heappush(open_, (charge + REROLE, audit + "R", i + 1, filler))
    return found


def edited(rows: list[Row], audit: str, entry: int) -> Iterator[tuple[str, int]]:
    """(edit, row) of every row that the repair holds; the row is -1 for an inserted one. The edit is K, u or a."""
    state, i = entry, 0
    for edit in audit:
        if edit == "D":
            i += 1
        elif edit == "K":
            yield "K", i
            state = STEP[rows[i][0], state] if rows[i][0] else state
            i += 1
        else:
            role = wanted(state)
            yield role, (i if edit == "R" else -1)
            state = STEP[role, state]
            i += edit == "R"


class _Block:
    """Rows of one conversation gathered for one block. A row: turn, role, digest, n, first, blank, short."""

    def __init__(self, conv, opens: bool):
        self.conv, self.opens, self.held, self.size, self.chars = conv, opens, [], 0, 0

    def rows(self) -> list[Row]:
        return [(role[:1], blank or not first or j > 0, short) for _, role, _, n, first, blank, short in self.held for j in range(n)]

    def closed(self, part: int, seq: int, last: bool) -> dict:
        """The block's row; ``last``: the conversation is known to end here."""
        rows = self.rows()
        entries = (START,) if self.opens else (START, SYSTEM, USER, ASSISTANT)
        goals = ENDS if last else (START, SYSTEM, USER, ASSISTANT)
        ways = [
            {"entry": e, "exit": x, "cost": cost, "audit": audit}
            for e in entries
            for x, (cost, audit) in cheapest(rows, e, goals, every=not (last and self.opens)).items()
        ]
        letters = [r[0] for r in rows]
        turns = [t for t, *_ in self.held if t is not None]
        blank = sum(n for *_, n, _, b, _ in self.held if b)
        duplicate = sum(n - first for *_, n, first, b, _ in self.held if not b)
        truncated = sum(1 for *_, first, b, s in self.held if first and s and not b)
        return {
            "part": part, "seq": seq, "conv": self.conv, "ways": ways, "blank": blank, "duplicate": duplicate, "truncated": truncated,
            "illegal": sum(map(illegal, letters, letters[1:])), "left": letters[0], "right": letters[-1],
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
            "rows": [dict(zip(("turn", "role", "digest", "n", "first", "blank", "short"), h, strict=True)) for h in self.held],
        }


def illegal(left: str, right: str) -> bool:
    return left + right not in ("su", "ua", "au")


def _blocks(schema: pa.Schema, block: int, block_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, at, out, weight = TaskContext.get().partitionId(), 0, None, [], 0
        opened = False  # whether another conversation came before in this range
        for batch in batches:
            for r in batch.to_pylist():
                left = r["n"]
                while left:
                    if at is None:
                        at = _Block(r["conv"], opened)
                    elif at.conv != r["conv"]:
                        out.append(at.closed(part, seq, last=True))
                        seq, opened, at = seq + 1, True, _Block(r["conv"], True)
                    elif at.size >= block or at.chars >= block_chars:
                        out.append(at.closed(part, seq, last=False))
                        seq, at = seq + 1, _Block(r["conv"], False)
                    take = min(left, block - at.size)
                    at.held.append((r["turn"], r["role"], r["digest"], take, r["first"] and left == r["n"], r["blank"], r["short"]))
                    at.size, at.chars, left, weight = at.size + take, at.chars + r["chars"], left - take, weight + take
                if weight >= 4 * block:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, weight = [], 0
        if at is not None:
            out.append(at.closed(part, seq, last=False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


class _Chain:
    """Blocks of one conversation joined one by one: for each state the cheapest (cost, audit) so far and the way there."""

    def __init__(self, first: dict):
        self.conv, self.best, self.trail, self.keys = first["conv"], {START: (0, "")}, [], []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.right = None

    def add(self, b: dict) -> None:
        best, back = {}, {}
        for w in b["ways"]:
            if w["entry"] in self.best:
                cost, audit = self.best[w["entry"]]
                new = (cost + w["cost"], audit + w["audit"])
                if w["exit"] not in best or new < best[w["exit"]]:
                    best[w["exit"]], back[w["exit"]] = new, (w["entry"], len(w["audit"]))
        self.best = best
        self.trail.append(back)
        self.keys.append((b["part"], b["seq"]))
        for k in self.sums:
            self.sums[k] += b[k]
        if self.right is not None:
            self.sums["illegal"] += illegal(self.right, b["left"])
        if b["low"] is not None:
            self.sums["turns"] -= self.high == b["low"]  # one turn on both sides of a cut
            self.low, self.high = b["low"] if self.low is None else self.low, b["high"]
        self.right = b["right"]

    def closed(self) -> dict:
        (cost, audit), state = min((self.best[s], s) for s in ENDS if s in self.best)
        plan, end = [], len(audit)
        for key, back in zip(reversed(self.keys), reversed(self.trail), strict=True):
            state, n = back[state]
            plan.append({"part": key[0], "seq": key[1], "entry": state, "edits": audit[end - n : end]})
            end -= n
        turns = self.sums.pop("turns")
        gaps = 0 if self.low is None else self.high - self.low + 1 - turns
        return {"conv": self.conv, "gaps": gaps, **self.sums, "cost": cost, "audit": audit, "plan": plan[::-1]}


def _by_conversation(schema: pa.Schema, start: Callable, batch_rows: int = 2000) -> Callable:
    """Rows sorted by conversation, folded one conversation at a time by ``start(row)``, ``.add(row)``, ``.closed()``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # few rows at a time become Python objects
                for r in batch.slice(k, 256).to_pylist():
                    if at is None or at.conv != r["conv"]:
                        if at is not None:
                            out.append(at.closed())
                        at = start(r)
                    at.add(r)
                if len(out) >= batch_rows:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if at is not None:
            out.append(at.closed())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


class _Hash:
    """SHA-256 of a conversation's blocks of text, joined by new lines."""

    def __init__(self, first: dict):
        self.conv, self.sha, self.any = first["conv"], hashlib.sha256(), False

    def add(self, b: dict) -> None:
        self.sha.update((b"\n" if self.any else b"") + b["text"].encode("utf-8", "surrogatepass"))
        self.any = True

    def closed(self) -> dict:
        return {"conv": self.conv, "sha": self.sha.hexdigest()}


def _edited_rows(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time
                (b,) = batch.slice(k, 1).to_pylist()
                held = [(r, (r["role"][:1], r["blank"] or not r["first"] or j > 0, r["short"])) for r in b["rows"] for j in range(r["n"])]
                out = []
                for place, (edit, i) in enumerate(edited([x for _, x in held], b["edits"], b["entry"])):
                    r = held[i][0] if i >= 0 else {"turn": None, "role": NAMES.get(edit), "digest": None}
                    role = r["role"] if edit == "K" else NAMES[edit]
                    out.append({"part": b["part"], "seq": b["seq"], "place": place, "conv": b["conv"], "made": role, "turn": r["turn"], "role": r["role"], "digest": r["digest"]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def same(columns: list[str], a: str, b: str) -> Column:
    """Null-safe equality of columns of the same names."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


class Repair:
    """The repair of a table of conversations.

    ``report``: a row for each conversation with rows: id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. ``turns``: the repaired rows: id, place (part, seq, place: its order), role, text; inserted ones are empty.
    """

    def __init__(
        self,
        rows: DataFrame,
        id_col: str = "conv_id",
        turn_col: str = "turn",
        role_col: str = "role",
        text_col: str = "text",
        block: int = BLOCK,
        block_chars: int = BLOCK_CHARS,
    ):
        spark = rows.sparkSession
        ship(spark)
        space = F.lit(" ")
        rows = rows.select(
            quoted(id_col).alias("conv"),
            quoted(turn_col).cast("long").alias("turn"),
            F.coalesce(quoted(role_col), space).alias("role"),
            F.coalesce(quoted(text_col), space).alias("text"),
        ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        whole = ["conv", "turn", "role", "digest"]
        stripped = F.rtrim("text", F.lit(SPACES))
        light = rows.select(*whole, (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("short"), F.length("text").alias("chars"))
        light = freeze(light.groupBy(*whole).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("blank", "short", "chars")]), "turns")
        first = light.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("at"))
        first = first.select("conv", F.col("at.turn").alias("turn"), "role", "digest")
        flagged = light.alias("l").join(first.alias("f"), same(whole, "l", "f"), "left").select("l.*", F.col("f.digest").isNotNull().alias("first"))
        flagged = freeze(flagged, "faults")
        order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
        laid = flagged.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        id_type = rows.schema["conv"].dataType.simpleString()
        held = "turn: bigint, role: string, digest: binary, n: bigint, first: boolean, blank: boolean, short: boolean"
        kind = T._parse_datatype_string(
            f"part: int, seq: bigint, conv: {id_type}, ways: array<struct<entry: int, exit: int, cost: bigint, audit: string>>, blank: bigint, duplicate: bigint, truncated: bigint,"
            f"illegal: bigint, left: string, right: string, low: bigint, high: bigint, turns: bigint, rows: array<struct<{held}>>"
        )
        blocks = freeze(laid.mapInArrow(_blocks(_arrow(kind), block, block_chars), kind), "blocks")

        kind = T._parse_datatype_string(
            f"conv: {id_type}, gaps: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string,"
            "plan: array<struct<part: int, seq: bigint, entry: int, edits: string>>"
        )
        chained = blocks.drop("rows").repartition("conv").sortWithinPartitions("conv", "part", "seq")
        solved = freeze(chained.mapInArrow(_by_conversation(_arrow(kind), _Chain), kind), "repairs")

        plan = solved.select(F.explode("plan").alias("p")).select("p.*")
        kind = T._parse_datatype_string(f"part: int, seq: bigint, place: bigint, conv: {id_type}, made: string, turn: bigint, role: string, digest: binary")
        made = blocks.select("part", "seq", "conv", "rows").join(plan, ["part", "seq"]).mapInArrow(_edited_rows(_arrow(kind)), kind)
        texts = rows.dropDuplicates(whole)
        turns = made.alias("m").join(texts.alias("t"), same(whole, "m", "t"), "left")
        self.turns = turns.select(F.col("m.conv").alias(id_col), "part", "seq", "place", F.col("made").alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))

        line = F.struct("place", F.concat("role", F.lit(":"), "text").alias("line"))
        pieces = self.turns.groupBy(F.col(id_col).alias("conv"), "part", "seq").agg(F.array_sort(F.collect_list(line)).alias("lines"))
        pieces = pieces.select("conv", "part", "seq", F.array_join("lines.line", "\n").alias("text"))
        kind = T._parse_datatype_string(f"conv: {id_type}, sha: string")
        hashed = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(_by_conversation(_arrow(kind), _Hash), kind)
        report = solved.alias("s").join(hashed.alias("h"), same(["conv"], "s", "h"), "left")
        self.report = report.select(
            F.col("s.conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
            F.coalesce("h.sha", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
        )


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that ``crc32("conv_id:turn") % 20`` deals out (nulls: one space)."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fault.alias("fault"),
    ).where("fault != 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def repaired_report(rows: DataFrame) -> DataFrame:
    """The damaged conversations' repair, a row for every conversation of ``rows``."""
    report = Repair(damaged(rows)).report
    every = rows.select("conv_id").distinct()
    out = every.alias("e").join(report.alias("r"), same(["conv_id"], "e", "r"), "left")
    zero = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.sha2(F.lit(b""), 256)
    return out.select("e.conv_id", *zero, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", none).alias("repaired_sha256"))
