import hashlib
import itertools
import random
import re
import zlib

import pytest

from souk.llm import queries, repair

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """(cost, audit) of rows (initial, must go, truncated) by relaxing (cost, audit) until nothing
    changes: independent of prices and paths."""
    n = len(rows)
    best = {(n, 0): (0, ""), (n, 3): (0, "")}
    for i in range(n, -1, -1):
        for q in range(4):
            found = [best[i, q]] if (i, q) in best else []
            if i < n:
                initial, go, cut = rows[i]
                found.append((best[i + 1, q][0] + 3, "D" + best[i + 1, q][1]))
                if not go:
                    if (q, initial) in KEEP:
                        c, s = best[i + 1, KEEP[q, initial]]
                        found.append((c + cut, "K" + s))
                    c, s = best[i + 1, NEXT[q]]
                    found.append((c + 2 + cut, "R" + s))
            if found:
                best[i, q] = min(found)
        for _ in range(4):
            for q in range(4):
                if (i, NEXT[q]) in best:
                    c, s = best[i, NEXT[q]]
                    best[i, q] = min(best.get((i, q), (10**9, "")), (c + 2, "I" + s))
    return best[0, 0]


def code_of(initial, go, cut):
    k = "suao".index(initial)
    return (repair.REPEATED if go else repair.TRUNCATED if cut else repair.SOUND)[k]


def test_auction_on_all_short_conversations():
    kinds = [("s", 0, 0), ("u", 0, 0), ("a", 0, 0), ("o", 0, 1), ("u", 1, 0), ("a", 0, 1)]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            cost, letters = repair.solve("".join(code_of(*r) for r in rows))
            assert (cost, "".join(letters)) == cheapest(rows)


def test_auction_across_blocks():
    rnd = random.Random(1)
    for n in (63, 64, 65, 128, 129, 400):
        for weights in ((1, 4, 4, 1), (3, 1, 1, 3), (0, 1, 0, 0)):
            rows = [(rnd.choices("suao", weights)[0], int(rnd.random() < 0.2), int(rnd.random() < 0.3)) for _ in range(n)]
            cost, letters = repair.solve("".join(code_of(*r) for r in rows))
            assert (cost, "".join(letters)) == cheapest(rows)
            assert len(letters) == -(-n // repair.BLOCK)


def test_prices_are_dual_feasible_and_exact():
    codes = "uasUo0a4ua" + repair.END
    price = repair.converge(codes, (0, 0, 0, 0), (0, 1, 2, 3))
    for i, code in enumerate(codes):
        for q in range(4):
            for _, cost, after, read in repair.ARCS[code][q]:
                assert price[4 * i + q] <= cost + price[4 * (i + read) + after]
    rows = [("suao".index(c.lower()) if c.isalpha() else int(c) % 4, c.isdigit(), c.isupper()) for c in codes[:-1]]
    assert price[0] == cheapest([("suao"[k], int(g), int(t)) for k, g, t in rows])[0]


def brute_report(rows, damage=True):
    """The contract in plain Python over (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        # ties by role here; the tests' ties have different roles or equal rows
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, lattice, faults = set(), [], [0, 0, 0]
        for turn, role, text in mine:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            lattice.append((role[:1] if role[:1] in ("s", "u", "a") else "o", int(fault in (0, 1)), int(fault == 2)))
        cost, audit = cheapest(lattice)
        state, left, kept = 0, iter(mine), []
        for edit in audit:
            row = next(left) if edit != "I" else (None, "", "")
            if edit == "K":
                state = KEEP[state, row[1][0]]
                kept.append(f"{row[1]}:{row[2]}")
            elif edit in "IR":
                state = NEXT[state]
                kept.append(f"{'user' if state == 2 else 'assistant'}:{row[2]}")
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_brute_force(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op11_repair(spark, path)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert as_dict(df) == brute_report(rows)


SCHEMA = "conv_id long, turn long, role string, text string, h1 string, side int, letters int, copies_of long"


def odd_conversations():
    rnd = random.Random(5)
    rows = [(None, 1, "user", "Hi."), (None, None, None, "x"), (None, None, "user", None), (1, None, None, None), (2, 5, "unicorn", "Yes!"), (2, 5, "unicorn", "Yes!"),
            (2, 9, "", "no end"), (3, -4, "assistant", " \x0b\n"), (3, 2**40, "system", "é日本. \t"), (4, 1, "tool", "a\x00b?")]
    for c in range(10, 150):
        for turn in range(rnd.randint(1, 9)):
            rows.append((c, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", "system", "tool", None, "usher"]),
                         rnd.choice(["Yes.", "No", "", None, " ", "Long words! ", "a b c", "x" * 5000 + "."])))
    rows += [(7, t, "user" if t % 2 else "assistant", f"Row {t}.") for t in range(9000)]
    return rows


def test_nulls_ties_repeated_rows_and_long_conversations(spark):
    rows = odd_conversations()
    # ties with one role but different texts have their order from a hash: one row of each stays here
    rows = list({(c, t, r): (c, t, r, x) for c, t, r, x in rows}.values()) + [(2, 5, "unicorn", "Yes!"), (7, 8, "assistant", "Row 8.")]
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA)
    assert as_dict(repair.report(repair.damaged(df))) == brute_report(rows)
    assert as_dict(repair.report(df)) == brute_report(rows, damage=False)


def test_copies_beyond_a_segment(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.", 10_000), (1, 2, "assistant", "Yes.", 1), (2, 1, "user", "Gone.", 0)], "conv_id long, turn long, role string, text string, copies long")
    got = as_dict(repair.report(df))
    assert got[1][:7] == (0, 0, 9999, 0, 9999, 29997, "K" + "D" * 9999 + "K")
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_have_the_wanted_roles(spark):
    rows = [r for r in odd_conversations() if r[0] is None or r[0] < 100]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report = as_dict(repair.report(df))
    by_conv = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: r["position"]):
        by_conv.setdefault(r["conv_id"], []).append(r)
    assert set(by_conv) <= set(report)
    for conv, got in report.items():
        mine = by_conv.get(conv, [])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == got[-1]
        assert [r["edit"] for r in mine] == [e for e in got[-2] if e != "D"]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damaged(df)).collect() == [] and repair.repaired(df).collect() == []
