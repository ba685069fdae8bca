"""Conversation repair against a plain dynamic program, in one chunk and in very small ones."""

import hashlib
import random
import re
import zlib

import pytest

from caseloom.llm import conversation_queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired turns) of the rows of one conversation in order."""
    faults, seen = [], set()
    for role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(2):
            for s, (cost, audit, said) in list(best.items()):
                t = NEXT[s]
                best[t] = min(best.get(t, (1 << 60, "", ())), (cost + 5, audit + "I", said + ((NAMES[t], ""),)))
        return best

    for (role, text), fault in zip(rows, faults):
        then = {}
        for s, (cost, audit, said) in inserted(dict(best)).items():
            ways = [(s, cost + 2, "D", said)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                ways.append((NEXT[s], cost + 1 + more, "R", said + ((NAMES[NEXT[s]], text),)))
                if role[:1] == NEXT[s] or (s == "" and role[:1] == "s"):
                    ways.append((role[0], cost + more, "K", said + ((role, text),)))
            for t, c, e, w in ways:
                then[t] = min(then.get(t, (1 << 60, "", ())), (c, audit + e, w))
        best = then
    best = inserted(dict(best))
    cost, audit, said = min(best[s] for s in ("", "a") if s in best)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (*counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, said)


def ordered(rows):
    space = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(space, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def some_rows(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Fine.", "so what", "Yes!", " \t", "", None, "why? ", "é.\n", "end"]
    rows = []
    for conv in [*range(40), None]:
        for k in range(rng.choice([0, 1, 2, 5, 9, 30])):
            fresh = rng.random() < 0.6
            turn = rng.choice([None, k, k, k, k // 2])
            rows.append((conv, turn, rng.choice(roles), f"{k} {rng.choice(['ok.', 'cut'])}" if fresh else rng.choice(texts)))
    rows += [(100, k, "assistant", f"{k} never ends") for k in range(60)]
    rows += [(101, k // 3, "user", "Same.") for k in range(60)] + [(101, 99, "assistant", "Last.")]
    rows += [(102, k, "user" if k % 2 else "assistant", f"{k} x" if k < 50 else f"{k}.") for k in range(64)]
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_repair_equals_plain_program(spark, chunk_rows):
    rows = some_rows(chunk_rows)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, digest string").repartition(4)
    got = {}
    found = turn_repair.repair(table, chunk_rows)
    for c in sorted(found.collect(), key=lambda c: (c["part"], c["seq"])):
        got.setdefault(c["conv_id"], []).append(c)
    whole = {r["conv_id"]: r for r in conversation_queries.digests(found).collect()}
    assert set(got) == set(whole) == {r[0] for r in rows}
    for conv, pieces in got.items():
        mine = ordered([r for r in rows if r[0] == conv])
        *counts, illegal, cost, audit, said = plain_repair([r[2:] for r in mine])
        assert [sum(c[n] for c in pieces) for n in ("blank", "duplicate", "truncated", "cost")] == [*counts, cost]
        assert "".join(c["audit"] for c in pieces) == audit
        assert tuple((t["role"], t["text"]) for c in pieces for t in c["turns"]) == said
        turns = [r[1] for r in mine if r[1] is not None]
        w = whole[conv]
        assert w["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert (w["illegal"], w["cost"], w["audit"]) == (illegal, cost, audit)
        assert w["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def test_registered_repair(spark, tmp_path):
    rows = some_rows(5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in conversation_queries.op13_turn_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and len(got) == len({r[0] for r in rows})
    after = {}
    for conv, turn, role, text in rows:
        role, text = [" " if v is None else v for v in (role, text)]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        after.setdefault(conv, []).extend([(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    for conv, mine in after.items():
        *counts, audit, said = plain_repair([r[2:] for r in ordered(mine)])
        r = got[conv]
        assert [r[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")] == counts and r["audit"] == audit
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversation_queries.op13_turn_repair(spark, str(tmp_path)).collect() == []


def test_vectors_of_chunks_compose():
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.randrange(9) for _ in range(rng.randrange(12)))
        assert turn_repair.speculate(codes) == [turn_repair.behind(codes, v)[0] for v in range(len(turn_repair.vectors()[0]))]
