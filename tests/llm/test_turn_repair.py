"""op13 against a plain search over (state, cost, audit), on given and odd conversations."""
import hashlib
import random
import zlib

import pytest

from tessera.llm import turn_repair as tr

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, piece string, copies int"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    """(turn, role, text) of one conversation after the damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(name.encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        out += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def brute(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text of one conversation."""
    rows = damage(rows)
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    # best (cost, audit, turns) by what has been given: nothing, s, ...a, ...u
    grow = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def spread(at):
        for _ in range(3):
            for state, (c, audit, given) in list(at.items()):
                for x in "ua":
                    to = grow.get((state, x))
                    if to:
                        new = (c + 2, audit + "I", (*given, full[x] + ":"))
                        if to not in at or new[:2] < at[to][:2]:
                            at[to] = new
        return at
    for (_, role, text), fault in zip(rows, faults, strict=True):
        nxt = {}

        def put(to, new, nxt=nxt):
            if to not in nxt or new[:2] < nxt[to][:2]:
                nxt[to] = new
        for state, (c, audit, given) in spread(best).items():
            put(state, (c + 3, audit + "D", given))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if state == "" and role[:1] == "s":
                put("s", (c + late, audit + "K", (*given, f"{role}:{text}")))
            for x in "ua":
                to = grow.get((state, x))
                if to and role[:1] == x:
                    put(to, (c + late, audit + "K", (*given, f"{role}:{text}")))
                if to:
                    put(to, (c + 2 + late, audit + "R", (*given, f"{full[x]}:{text}")))
        best = nxt
    cost, audit, given = min((v for k, v in spread(best).items() if k in ("", "a")), key=lambda v: v[:2])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(given).encode()).hexdigest())


def check(df):
    groups = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        groups.setdefault(r[0], []).append(tuple(r))
    got = [tuple(r) for r in tr.repair(df).collect()]
    assert len(got) == len(groups)
    for r in got:
        assert r[1:] == brute(groups[r[0]]), r


def talk(rng, conv, n, gap=0.0):
    say = lambda: rng.choice(["Yes.", "No", "", "  ", "Why?\n", "word " * 9 + "!", "é…", f"t{rng.randrange(9)}."])
    roles = ["user", "assistant"] * 4 + ["system", "u", "tool", "", "Assistant", None]
    return [(conv, None if rng.random() < gap else i, roles[i % 2] if rng.random() < 0.7 else rng.choice(roles),
             None if rng.random() < 0.05 else say() + str(rng.randrange(3 * n)) * (rng.random() < 0.8) + rng.choice([".", ".", ""]),
             "k", "p", 7) for i in range(n)]


def test_given_conversations(spark):
    check(spark.read.parquet(f"{SF}/conversations.parquet"))


def test_odd_conversations(spark):
    rng = random.Random(3)
    rows = [r for c in range(150) for r in talk(rng, c, rng.randrange(1, 14), 0.1 * (c % 3))]
    rows += talk(rng, None, 30, 0.2) + rows[:20] + [(900, 2**40, "user", "x." * 50000, "", "", 1), (901, None, None, None, None, None, None)]
    rows += [(1000 + c, c, "system", "Only this.", "", "", 0) for c in range(40)]  # some are dropped as a whole
    check(spark.createDataFrame(rows, SCHEMA))


def test_a_conversation_over_many_pieces(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(tr, "CELL_BITS", 4)
    rows = talk(rng, 5, 700, 0.05) + talk(rng, 6, 90) + [r for c in range(10, 40) for r in talk(rng, c, rng.randrange(1, 9))]
    rows += [(7, i, "user", "same.", "", "", 1) for i in range(200)] + [(8, i, "system", f"s{i}.", "", "", 1) for i in range(60)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_empty(spark):
    assert tr.repair(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_pieces_agree_with_the_whole(seed):
    rng = random.Random(seed)
    for _ in range(150):
        codes = "".join(tr.code(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 40)))
        whole, _ = tr.Alignment(codes).audit(tr.START, tr.END, end=True)
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(3))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        after, tables = [tr.END], [tr.Alignment(p) for p in parts]
        for t in reversed(tables):
            c = t.costs()
            after.append([min(c[4 * e + x] + after[-1][x] for x in range(4)) for e in range(4)])
        state, joined = tr.START, ""
        for t, rest in zip(tables, after[-2::-1], strict=True):
            audit, state = t.audit(state, rest)
            joined += audit
        assert joined + "I" * (tr.END[state] // 2) == whole
