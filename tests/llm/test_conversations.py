import hashlib
import itertools
import random
import zlib

import pytest

from panelweave.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Brute force: the least (cost, audit) of all ways, by the rules alone."""
    rows, by = [tuple(" " if v is None and i > 1 else v for i, v in enumerate(r)) for r in rows], {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    out = []
    for conv, given in by.items():
        seq = []
        for turn, role, text in given:
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fate = zlib.crc32(name.encode()) % 20
            text = "" if fate == 1 else text.translate({46: None, 33: None, 63: None}) if fate == 2 else text
            seq += [(turn, "user" if fate == 4 else role, text, k) for k in range((1, 2)[fate == 3])] if fate else []
        seq.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text, _ in seq:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        best = {0: (0, "", ())}  # state: cost, audit, said
        def inserted(best):
            for _ in range(3):
                for q, (w, a, t) in list(best.items()):
                    to, said = {0: (2, "user:"), 1: (2, "user:"), 2: (3, "assistant:"), 3: (2, "user:")}[q]
                    best[to] = min(best.get(to, (w + 3, a + "I", (*t, said))), (w + 3, a + "I", (*t, said)))
            return best
        for (_, role, text, _), fault in zip(seq, faults, strict=True):
            new = {}
            for q, (w, a, t) in inserted(best).items():
                ways = [(q, w + 4, a + "D", t)]
                if fault not in ("blank", "duplicate"):
                    w += 3 * (fault == "truncated")
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                    ways += [(to, w, a + "K", (*t, f"{role}:{text}"))] if to else []
                    ways.append((3, w + 3, a + "R", (*t, f"assistant:{text}")) if q == 2 else (2, w + 3, a + "R", (*t, f"user:{text}")))
                for to, *way in ways:
                    new[to] = min(new.get(to, tuple(way)), tuple(way))
            best = new
        cost, audit, said = min(v for q, v in inserted(best).items() if q in (0, 3))
        turns = {r[0] for r in seq} - {None}
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(seq)), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def got(df):
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in c.repair_conversations(df).select(*cols).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    for conv in [*range(60), None]:
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            turn += rng.choice((1, 1, 3))
            text = rng.choice(("One. Two!", "cut off", "Fine?", "", " \t", "same.", None, "x" * 30000 + "."))
            out.append((conv, turn, rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)), text))
    out += [(70, None, "user", "Hi."), (70, 0, "assistant", "Ho."), (71, None, None, None)]
    out += [(80, t, rng.choice(("user", "assistant")), rng.choice(("a.", f"b{t}.", f"c{t}"))) for t in range(700)]  # most of all rows
    return out


def test_repair(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS kind", "'x' AS key", "1 AS piece", "'x' AS fate", "1 AS part").repartition(5)
    assert got(df) == plain(rows)


def test_repeated_rows_and_empty(spark):
    rows = [(1, 4, "user", "Hm."), (1, 4, "user", "Hm."), (1, 4, "user", "Hm."), (1, 5, "assistant", "Ok.")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_crossings():
    rng = random.Random(1)
    for _ in range(300):
        kinds = "".join(rng.choice("sSuUaAxX1234") for _ in range(rng.randrange(1, 40)))
        best = {0: (0, "")}
        for k in kinds:
            new = {}
            for p, (w, a) in best.items():
                for audit, cost, q in c.STEPS[k][p]:
                    new[q] = min(new.get(q, (c.NEVER, "")), (w + cost, a + audit))
            best = new
        assert c.hirschberg(kinds, 0, c.END)[0] + c.TAIL[c.hirschberg(kinds, 0, c.END)[1]] == min((w + c.END[q], a + c.TAIL[q]) for q, (w, a) in best.items())[1]
