"""Template decontamination against a plain version: all items with all texts, window by window."""
import random
import re
from collections import Counter

from panelweave.llm import templates as t


def parts(text):
    """(token, symbol, is slot) of the words of a text; a symbol is the kind for slots, the token else."""
    out, before = [], "mark"
    for x in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]", text or ""):
        low = x.lower()
        kind = "mark" if x in ".!?\n" else "number" if x[0].isnumeric() or low in t.NUMBERS else "unit" if low in t.UNITS else "name" if x[0].isupper() else "word"
        if kind != "mark":
            slot = kind == "number" or kind == "unit" and before == "number" or kind == "name" and before != "mark"
            out.append((low, kind if slot else low + "=", slot))
        before = kind
    return out


def holds(item, text, size=8, least=0.8):
    """None, or whether a slot's value differs."""
    a, d = parts(item), parts(text)
    size = min(size, len(a))
    if not size:
        return None
    usable = [s for s in range(len(a) - size + 1) if 2 * sum(x[2] for x in a[s:s + size]) <= size]
    bare = set(range(len(a))) - {s + k for s in usable for k in range(size)}
    hits = []
    for s in range(len(a) - size + 1):
        for at in range(len(d) - size + 1):
            mine, theirs = a[s:s + size], d[at:at + size]
            if s in usable and [x[1] for x in mine] == [x[1] for x in theirs]:
                hits.append((at - s, s, [x[0] for x in mine if x[2]], [x[0] for x in theirs if x[2]]))
            if bare & set(range(s, s + size)) and [x[0] for x in mine] == [x[0] for x in theirs]:
                hits.append((at - s, s, [], []))
    covered, other = set(), False
    for offset in {h[0] for h in hits}:
        here = [h for h in hits if h[0] == offset]
        stands = {}
        for m in {m for h in here for m in h[2]}:
            votes = Counter(y for h in here for x, y in zip(h[2], h[3], strict=True) if x == m)
            stands[m] = min(votes, key=lambda v: (-votes[v], v))
        for _, s, mine, theirs in here:
            if all(stands[m] == y for m, y in zip(mine, theirs, strict=True)):
                covered |= set(range(s, s + size))
                other |= mine != theirs
    return other if len(covered) >= least * len(a) else None


def test_against_all_pairs(spark):
    rng = random.Random(21)
    word = lambda: rng.choice(("alpha", "beta", "gamma", "delta", "walks", "buys", "from", "the", "7", "12", "3.5", "km", "kg", "hours", "Anna", "Tom", "Paris", "two", ".", "?", "\n"))
    items = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(40)] + ["", ". ? .", "1 2 3 4 5 6 7 8 9 10 11 12", "Anna Tom Paris Anna Tom Paris Rome Oslo Bern"]

    def changed(text):
        values = {}
        swap = {"7": ("7", "9"), "12": ("40",), "Anna": ("Maria", "Anna"), "Tom": ("Ben",), "km": ("miles", "km")}
        return " ".join(values.setdefault(x, rng.choice(swap[x])) if x in swap and rng.random() < 0.95 else x for x in text.split(" "))

    docs = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(30)]
    docs += [f"{' '.join(word() for _ in range(rng.randrange(9)))} {rng.choice((str, changed))(x)} {' '.join(word() for _ in range(rng.randrange(9)))}" for x in items for _ in range(3)]
    docs += [None, "", " ".join(word() for _ in range(3000)) + " . " + items[5]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.items, r.reparameterised) for r in t.decontaminate(df, bench).collect()}
    want = {}
    for i, d in enumerate(docs):
        found = {k: h for k, x in enumerate(items) if (h := holds(x, d)) is not None}
        want[i] = (",".join(map(str, found)), any(found.values()))
    assert got == want and sum(bool(v[0]) for v in want.values()) > 60 and any(v[1] for v in want.values())
