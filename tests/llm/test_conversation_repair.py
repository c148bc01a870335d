import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from purlin.llm import conversation_repair as cr
from purlin.llm.queries import op12_conversation_repair

LEGAL = re.compile(r"(s?(ua)+)?")


def all_repairs(rows, inserts):
    """Every edit sequence with at most ``inserts`` insertions: (cost, audit, roles and texts)."""

    def go(i, left):
        if left:
            for role in ("user", "assistant"):
                for cost, audit, made in go(i, left - 1):
                    yield cost + 3, "I" + audit, [(role, "")] + made
        if i == len(rows):
            yield 0, "", []
            return
        role, text, fault = rows[i]
        for cost, audit, made in go(i + 1, left):
            yield cost + 4, "D" + audit, made
            if fault not in ("blank", "duplicate"):
                charge = cost + 3 * (fault == "truncated")
                yield charge, "K" + audit, [(role, text)] + made
                for new in ("user", "assistant"):
                    yield charge + 3, "R" + audit, [(new, text)] + made

    return go(0, inserts)


def brute(rows, inserts=3):
    """The report of one conversation's rows (turn, role, text), by trying everything."""
    none = lambda x: " " if x is None else x
    rows = [(t, none(r), none(x)) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    found = ((c, a, m) for c, a, m in all_repairs([(r, t, f) for (_, r, t), f in zip(rows, faults)], inserts) if LEGAL.fullmatch("".join(r[:1] for r, _ in m)))
    cost, audit, made = min(found, key=lambda x: x[:2])
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    }


TEXTS = ["Yes.", "No", "Is it?", "", " \t\n", "Well!\n ", "so it is \x0b", None, "é…"]
ROLES = ["system", "user", "assistant", "assistant", "user", "tool", None, ""]


def made_up(seed, n, most=5):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            out.append((conv if conv else None, rng.choice([turn, turn, turn + 2, None]), rng.choice(ROLES), rng.choice(TEXTS)))
    return out


def frame(spark, rows):
    kind = "conv_id long, turn long, role string, text string, cost string, part int, place long"
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], kind).repartition(3)


def by_conv(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_equals_trying_every_repair(spark, block):
    rows = made_up(5, 60)
    got = {r.conv_id: r.asDict() for r in cr.Repair(frame(spark, rows), block=block).report.collect()}
    for conv, own in by_conv(rows).items():
        want = brute(own)
        assert {k: got[conv][k] for k in want} == want, own


def test_block_by_block_equals_at_once(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(ROLES[:5]), f"{rng.choice(['a', 'b', 'c'])}{rng.randint(0, 60)}{rng.choice(['.', '!', ''])}") for t in range(300)]
    rows += [(7, 3, "user", "again.")] * 40 + [(8, None, "user", "x.")] * 30
    reports = [sorted(map(tuple, cr.Repair(frame(spark, rows), block=b).report.collect())) for b in (4096, 16, 7)]
    assert reports[0] == reports[1] == reports[2]
    initials = [(r, bool(f), s) for r, f, s in (("u", 0, 0), ("u", 0, 1), ("s", 1, 0), ("a", 0, 0))] * 20
    (cost, audit), = cr.cheapest(initials).values()
    assert cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + 3 * sum(s for (_, i), (_, _, s) in zip([x for x in cr.edited(initials, audit, 0) if x[1] >= 0], [initials[i] for e, i in cr.edited(initials, audit, 0) if i >= 0]))


def test_turns_are_legal_and_hash_to_the_report(spark):
    repair = cr.Repair(frame(spark, made_up(6, 30)), block=3)
    turns = by_conv((r.conv_id, (r.part, r.seq, r.place), r.role, r.text) for r in repair.turns.collect())
    for r in repair.report.collect():
        own = sorted(turns.get(r.conv_id, []))
        assert LEGAL.fullmatch("".join(x[1][:1] for x in own))
        assert hashlib.sha256("\n".join(f"{x[1]}:{x[2]}" for x in own).encode()).hexdigest() == r.repaired_sha256


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rows = made_up(11, 150, most=4) + [(900 + i, i, "user", "Hi.") for i in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    harmed = by_conv(damage(rows))
    assert set(got) == {r[0] for r in rows} and any(c not in harmed for c in got)
    for conv in got:
        if conv in harmed:
            want = brute(harmed[conv])
        else:
            want = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        assert {k: got[conv][k] for k in want} == want, harmed.get(conv)


def test_empty_table_and_long_text(spark):
    assert cr.Repair(frame(spark, [])).report.collect() == []
    assert cr.repaired_report(frame(spark, [])).collect() == []
    long = "word " * 200_000 + "end."
    (r,) = cr.Repair(frame(spark, [(1, 0, "user", long), (1, 1, "assistant", "Yes.")])).report.collect()
    assert r.audit == "KK" and r.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest()


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds nearly all rows is laid out in many ranges."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(4000)] + [(2, 0, "user", "a.")]
    repair = cr.Repair(frame(spark, rows), block=100)
    assert {r.conv_id: (r.cost, len(r.audit)) for r in repair.report.collect()} == {1: (0, 4000), 2: (3, 2)}
    spread = repair.turns.where("conv_id = 1").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(spread) >= 3 and max(r.n for r in spread) < 3000
