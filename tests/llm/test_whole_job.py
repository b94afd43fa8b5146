"""The whole job where a shorter one gave results too."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panelweave.llm import lines, quality, sharding, simhash, templates, token_output
from panelweave.llm.common import Stages, slices


def plain_similar(texts, least=0.8):
    """Smallest index of each text's component, all pairs compared by their 5-word shingles."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    return [a for a in range(len(texts)) if parent[a] == a]


def near_copies(seed, groups=40, size=5):
    """Texts with 0 to 8 words of 60 to 400 changed: similarities from about 0.5 to 1."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(60, 400))]
        for _ in range(size):
            new = base[:]
            for _ in range(rng.randrange(9)):
                new[rng.randrange(len(new))] = word()
            out.append(" ".join(new))
    return [*out, *(x.upper() for x in out[:3]), "", "  ", "two words", "TWO  words", "two other words"]


def test_near_duplicates_by_similarity(spark):
    texts = near_copies(1)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = plain_similar(texts)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(texts) - 60
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").collect() == []
    odd = spark.createDataFrame([(None, texts[0]), (7, texts[0]), (7, texts[0]), (9, None), (8, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first_similar(odd).collect()) == [7, 8]


def test_recall_of_wide_candidates():
    rng = np.random.default_rng(0)
    for n in (50, 300):
        common = round(n * 1.6 / 1.8)  # of n and n hashes: similarity 0.8
        pairs = [(h[:n], h[n - common:]) for h in rng.integers(0, 2**64, (1500, 2 * n - common), dtype=np.uint64)]
        a, b = (simhash.wide_prints(list(x)) for x in zip(*pairs, strict=True))
        met = (simhash.table_keys(a) == simhash.table_keys(b)).any(1) & (np.bitwise_count(a ^ b).sum(1) <= simhash.WIDE_RADIUS)
        assert met.mean() >= 0.98


def test_large_buckets_of_wide_candidates_are_dealt_out(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 2)
    prints = [(k, *(int(x) ^ (1 << int(rng.integers(60))) for x in base), k % 3) for k in range(80)]
    df = spark.createDataFrame(prints, "node long, p long, q long, root long")
    all_pairs = {(a, b) for a in range(80) for b in range(a + 1, 80)}
    assert {tuple(r) for r in simhash.wide_pairs(df, True, Stages(spark), limit=16).collect()} == {(a, b) for a, b in all_pairs if a % 3 != b % 3}
    one = {tuple(r) for r in simhash.wide_pairs(df, False, Stages(spark), limit=16).collect()}
    reach, grown = {0}, None
    while grown != reach:
        grown, reach = reach, reach | {x for p in one if set(p) & reach for x in p}
    assert one <= all_pairs and reach == set(range(80))


def test_shards_offset_heavy_groups(spark):
    rng = random.Random(3)
    light = [(i, f"{i} " + "x" * rng.randrange(20, 400)) for i in range(20_000)]
    total = sum(len(t) + 1 for _, t in light)
    copies = int(0.9 * total / 15 / 101)  # about 0.9 of a mean shard
    docs = [*light, *((10**6 + i, "y" * 100) for i in range(copies)), (2 * 10**6, "z" * (total // 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sharding.shard_by_bytes(df, 16).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, heavy = np.zeros(16, np.int64), set()
    for r in got:
        sums[r.shard] += r.size
        heavy |= {r.shard} if 10**6 <= r.doc_id < 2 * 10**6 else set()
    assert len(got) == len(docs) and len(heavy) == 1 and sums.max() - sums.min() < 0.001 * sums.mean()


def test_verbatim_runs_of_numbers_and_names(spark):
    items = ["Compute the sum of the following list of numbers: 3 4 5 6 7 8 9 10 11 12 13 14 15",
             "Which of these cities lies farthest north when seen from the equator: Oslo, Rome, Paris, Madrid, Berlin, Vienna, Athens, Lisbon, Dublin or Prague",
             "12 13 14 15 16 17 18 19 20 21 say which of the numbers before this is even and why you think so",
             "Berlin 1 2 3", "one plain question about how many apples are left in the basket"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some words before. {t} and some after") for i, t in enumerate(items)] + [(9, items[0].replace("8 9", "80 90"))], "doc_id long, text string")
    got = {r.doc_id: (r.items, r.reparameterised) for r in templates.decontaminate(docs, bench).collect()}
    assert got == {**{i: (str(i), False) for i in range(len(items))}, 9: ("", False)}
    assert [r.doc_id for r in templates.keep_clean(docs, bench).collect()] == [9]


def test_frequent_lines_leave_the_text(spark):
    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    docs = [(i, f"Home  About\n{(a := own(60))}\n\nHOME about \n{(b := own(9))}", "a", f"{a}\n\n{b}") for i in range(30)]
    docs += [(100, f"home about\n{(a := own(70))}", "b", f"home about\n{a}"), (101, docs[0][1], "a", docs[0][3]), (102, a, None, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, want string").selectExpr("want", "text", "source", "doc_id", "1 AS gone", "2 AS enough")
    kept = quality.keep_documents(df)
    assert kept.columns == df.columns and kept.count() == len(docs) and all(r.text == r.want for r in kept.collect())
    got = quality.quality_rules(df, with_text=True)
    assert got.columns == [*quality.quality_rules(df).columns, "text"] and {(r.doc_id, r.text) for r in got.collect()} == {(i, w) for i, _, _, w in docs}
    assert {(r.doc_id, r.text) for r in quality.quality_rules(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").selectExpr("*", "'a' AS source"), with_text=True).collect()} == {(1, None), (2, "")}


def test_wide_fingerprints_are_compared_by_bit_planes():
    rng = np.random.default_rng(8)
    sizes = [1, 2, 63, 64, 65, 1, 200, 3, 130]
    group = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(0, 1 << 62, (len(sizes), 2)).astype(np.uint64)[group]
    noise = np.packbits(rng.random((len(group), 128)) < rng.choice([0.05, 0.14, 0.2, 0.5], (len(group), 1)), axis=1).view(np.uint64)
    prints, stop = base ^ noise, np.cumsum(sizes)[group]
    apart = np.bitwise_count(prints[:, None] ^ prints).sum(2, dtype=int)
    for radius in (0, simhash.WIDE_RADIUS, 128):
        want = {(i, j, apart[i, j]) for i in range(len(group)) for j in range(i + 1, stop[i]) if apart[i, j] <= radius}
        for at_once in (1, 1 << 13):
            got = [tuple(x) for part in simhash.near_pairs(prints, stop, radius, at_once) for x in zip(*part, strict=True)]
            assert len(got) == len(set(got)) and set(got) == want
    assert 0 < sum(apart[i, j] <= simhash.WIDE_RADIUS for i in range(len(group)) for j in range(i + 1, stop[i])) < sum(s * (s - 1) // 2 for s in sizes)


def test_quality_stage_does_not_shuffle_texts(spark, monkeypatch, capsys):
    word = lambda i, k: f"w{i * 97 % 31}x{k * 7 + i}"
    footer = "\n".join(" ".join(f"f{j}y{k}" for k in range(30)) for j in range(9))
    rows = [(i, " ".join(word(i, k) for k in range(60)) + ("\n  Common   FOOTER\n\nlast" if i % 3 else f"\n{footer}" if i % 2 else ""), "abc"[i % 3] if i % 4 else None) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None, "a")], "doc_id long, text string, source string")
    kept = quality.keep_documents(docs, least=3, share=0.1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        quality.keep_documents(docs, least=3, share=0.1).explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    monkeypatch.setattr(quality, "FREQUENT_ROWS", 0)  # many frequent lines: the join
    joined = quality.keep_documents(docs, least=3, share=0.1)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, joined.collect()))
    was = {r.doc_id: r.text for r in docs.collect()}
    assert any(was[r.doc_id] != r.text for r in kept.collect())


def test_text_batches_are_worked_off_in_slices():
    batch = pa.RecordBatch.from_pydict({"n": list(range(1300))})
    parts = list(slices(iter([batch, batch.slice(0, 0), batch.slice(7, 1)])))
    assert max(p.num_rows for p in parts) <= 512
    assert [v for p in parts for v in p.column(0).to_pylist()] == [*range(1300), 7]


def test_encoder_remembers_a_word_once_and_no_more_than_asked():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, kind, _ = token_output.encoder(path, 3)
    text = "some plain words, repeated words. caf\u00e9s caf\u00e9s, 12,5 and x.y more"
    assert np.frombuffer(encode(text), kind).tolist() == np.frombuffer(encode(text), kind).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    memos = [c.cell_contents.__self__ for c in encode.__closure__ if isinstance(getattr(c.cell_contents, "__self__", None), dict)]
    assert sorted(len(m) for m in memos if " some" not in m)[0] <= 3
    assert not any(" plain" in m for m in memos)


def test_lines_with_one_long_passage_are_not_all_compared(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(20))
    family = [passage + " " + " ".join(word() for _ in range(14)) for _ in range(120)]
    near = [t[:-3] + "xyz" for t in family[:10]]  # similar to one line of the family each
    norms = family + near
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(norms)], "line long, norm string, n long")
    cut = [{t[i:i + 9] for i in range(len(t) - 8)} for t in norms]
    links = {(a, b) for b in range(len(norms)) for a in range(b) if len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b])}
    sketch = lines.sketches(table, 9)
    x, y = sketch.alias("x"), sketch.alias("y")
    possible = {(r.a, r.b) for r in x.join(y, (F.col("x.line") < F.col("y.line")) & lines.possible("x", "y", 0.8)).select(F.col("x.line").alias("a"), F.col("y.line").alias("b")).collect()}
    assert links <= possible and len(possible) < 40  # of 8,385 pairs
    stages = Stages(spark)
    found = {(min(r), max(r)) for r in lines.line_links(table, stages, 9, 8, 3, 0.8).collect()}
    assert found == links and len(found) >= 10


def test_repeated_words_do_not_make_lines_possible(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(20))
    norms = [" ".join([" ".join(word() for _ in range(8))] * 12) + " " + passage for _ in range(60)]
    norms += [t.replace(t[:6], "xyzxyz", 1) for t in norms[:5]]  # similar to one line each
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(norms)], "line long, norm string, n long")
    cut = [{t[i:i + 9] for i in range(len(t) - 8)} for t in norms]
    links = {(a, b) for b in range(len(norms)) for a in range(b) if len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b])}
    sketch = lines.sketches(table, 9)
    x, y = sketch.alias("x"), sketch.alias("y")
    possible = {(r.a, r.b) for r in x.join(y, (F.col("x.line") < F.col("y.line")) & lines.possible("x", "y", 0.8)).select(F.col("x.line").alias("a"), F.col("y.line").alias("b")).collect()}
    assert links <= possible and len(links) == 5 and len(possible) < 20  # of 2,080 pairs
    assert {(min(r), max(r)) for r in lines.line_links(table, Stages(spark), 9, 8, 3, 0.8).collect()} == links


def test_signatures_by_cells_are_those_of_all_hashes(spark, monkeypatch):
    rng = random.Random(12)
    norms = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (1, 5, 9, 10, 30, 127, 128, 129, 200, 300, 500, 900, 3000)] + ["x" * 400, "for " * 200, "\u65e5\u672c" * 90, "\U0001f600 a" * 60]
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(norms)], "line long, norm string, n long")
    for bands, rows in ((8, 3), (5, 4), (12, 3), (1, 1)):
        got = sorted(map(tuple, lines.signatures(table, Stages(spark), 9, bands, rows).collect()))
        with monkeypatch.context() as m:
            m.setattr(lines, "LONG", 1 << 30)
            assert got == sorted(map(tuple, lines.signatures(table, Stages(spark), 9, bands, rows).collect())) and len(got) == bands * len(norms)


def test_recall_of_line_bands():
    rng, fixed = np.random.default_rng(0), np.array(lines.numbers(8, 3), np.uint64)
    for n in (12, 24, 50, 300):
        common, met = round(n * 1.6 / 1.8), 0  # of n and n hashes: similarity 0.8
        for _ in range(600):
            h = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            a, b = ((x[:, None] ^ fixed).min(0).reshape(8, 3) for x in (h[:n], h[n - common:]))
            met += (a == b).all(1).any()
        assert met >= 0.985 * 600
