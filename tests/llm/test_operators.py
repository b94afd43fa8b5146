"""Each operator against a plain version, on messy, repeated and empty inputs."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from panelweave.llm import anchors, lines, mixing, quality, repair, sharding, simhash, substrings, templates, token_counts, token_output, warc
from panelweave.llm.common import Stages, filesystem
from panelweave.llm.components import components
from panelweave.llm.pretokens import Splitter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
none_last = lambda x: (x is None, x or 0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is None, str(x)) for x in t])


# ---------------------------------------------------------------- 1

def plain_lines(corpus):
    """Numbers of removed lines by (id, text), all pairs compared."""
    spots = collections.defaultdict(list)
    for i, t in {(i, t) for i, t, *_ in corpus}:
        for k, x in enumerate((t or "").split("\n")):
            if norm := " ".join(WORD.findall(x.lower())):
                spots[norm].append((none_last(i), xxhash.xxh64_intdigest(t.encode(), 42) if t else 0, k, i, t))
    norms = list(spots)
    sets, parent = [{x[k:k + 9] for k in range(max(1, len(x) - 8))} for x in norms], list(range(len(norms)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for a in range(len(norms)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                parent[find(a)] = find(b)
    groups, gone = collections.defaultdict(list), collections.defaultdict(set)
    for a, n in enumerate(norms):
        groups[find(a)] += spots[n]
    for g in groups.values():
        for *_, k, i, t in sorted(g, key=lambda s: s[0])[1:]:
            gone[i, t].add(k)
    return gone


def test_line_dedup(messy, corpus, empty):
    gone = plain_lines(corpus)
    got = {(r.doc_id, r.n_lines, r.removed) for r in lines.dedup_lines(messy).collect()}
    assert got == {(i, sum(bool(WORD.search(x)) for x in (t or "").split("\n")), ",".join(map(str, sorted(gone[i, t])))) for i, t, *_ in corpus}
    assert rows(lines.dedup_lines(empty)) == []


def test_line_dedup_text(spark):
    long = "the quick brown fox jumps over the lazy dog and then runs away from the large brown bear that lives in the deep dark forest"
    df = spark.createDataFrame([(1, f"{long}\nkeep me"), (2, f"start\n{long.replace('lazy', 'hazy')}\n\nend"), (2, f"start\n{long.replace('lazy', 'hazy')}\n\nend")], "doc_id long, text string")
    assert rows(lines.dedup_lines(df, with_text=True)) == [(1, 2, 0, "", f"{long}\nkeep me"), (2, 3, 1, "1", "start\n\nend"), (2, 3, 1, "1", "start\n\nend")]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000), (None, 5)]
    got = rows(components(spark.createDataFrame(links, "a long, b long"), Stages(spark)))
    label = {n: n for a, b in links if a not in (None, b) for n in (a, b)}
    for _ in range(400):
        for a, b in links:
            if a not in (None, b):
                label[a] = label[b] = min(label[a], label[b])
    assert got == sorted(label.items(), key=lambda t: [(False, str(x)) for x in t])


# ---------------------------------------------------------------- 2 and 6

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_library_ids(name):
    split = Splitter(public_tokenizers.path(name))
    encode, kind, _ = token_output.encoder(public_tokenizers.path(name))
    for c in map(chr, range(256)):
        for t in (c, f"a{c}b", f"a {c} b{c}", c * 3 + " x", f"x'{c} 'S 'll 12{c} \n ", f"{c}  b", f"A{c}. B,{c}", f"<|endoftext|>{c}"):
            assert np.frombuffer(encode(t), kind).tolist() == split.whole(t), repr(t)


def test_whole_tokens_encode_alone():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, known = Tokenizer.from_file(path), token_counts.whole_tokens(path)
    assert len(known) > 30_000 and all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in known)


def test_token_counts(messy, corpus, empty):
    tok = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in corpus]
    key = lambda t: [(x is None, str(x)) for x in t]
    assert rows(token_counts.token_counts(messy, path, 2048)) == sorted(want, key=key)
    assert rows(token_counts.token_counts(empty, path, 2048)) == []


def test_token_files(spark, messy, corpus, empty):
    tok = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in token_output.token_round_trip(messy.unionByName(messy.limit(3)), path).collect()), key=lambda r: r[1])
    assert [none_last(r[0])[::-1] for r in got] == sorted((none_last(r[0])[::-1] for r in got), key=lambda x: (not x[1], x[0]))  # nulls first, then ascending
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))] and len(got) == len(corpus) + 3
    one = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]
    want = {(i, len(x := one(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, *_ in corpus}
    assert {(r[0], r[2], r[3]) for r in got} == want
    assert rows(token_output.token_round_trip(empty, path)) == []


def test_random_access(spark, messy, corpus):
    tok = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    stages = Stages(spark)
    blocks = stages.table(token_output.write_token_files(messy, path, stages.folder("t"), block_tokens=500), "blocks").collect()
    seen = 0
    for uri in {b.path for b in blocks}:
        fs, place = filesystem(uri)
        with fs.open_input_file(place) as f:
            for b in sorted((b for b in blocks if b.path == uri), key=lambda b: b.block):
                f.seek(b.offset)
                ids, counts, _ = token_output.read_block(f.read(b.size))
                before = sum(x.n_docs for x in blocks if x.path == uri and x.block < b.block)
                for k, doc_id in enumerate(ids):
                    got = token_output.read_document(uri, before + k).tolist()
                    assert len(got) == counts[k] and got in [tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in corpus if i == doc_id]
                    seen += 1
    assert seen == len(corpus)


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.empty(0, int), np.array([3]), np.full(1000, 7), np.full(999, 0), np.tile([1, 2, 1, 2, 3, 0], 500), rng.integers(0, 12, 5000), rng.integers(1, 3, 3000), rng.zipf(1.5, 4000) % 900):
        g = repair.compress(ids, 1000, 0)
        assert (g.decode() == ids).all() and not (g.right == 0).any() and g.sizes.sum() == len(g.right)
        for a, b in rng.integers(0, len(ids) + 1, (20, 2)):
            assert (g.decode(a, b) == ids[a:b]).all()
        _, counts, read = token_output.read_block(token_output.block_bytes(ids, [5], [len(ids)], 1 << 24, 0))
        assert counts.tolist() == [len(ids)] and (read.decode() == ids).all()


def plain_repair(ids, end, first):
    """Length of the sequence and number of rules of Re-Pair, one most frequent pair at a time."""
    seq, rules = list(ids), 0
    while True:
        counts, last = collections.Counter(), {}
        for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
            if end not in pair and not (pair[0] == pair[1] and last.get(pair) == i - 1):
                counts[pair] += 1
                last[pair] = i
        pair, n = max(counts.items(), key=lambda x: (x[1], x[0]), default=(None, 0))
        if n < 2:
            return len(seq), rules
        out, i = [], 0
        while i < len(seq):
            hit = tuple(seq[i:i + 2]) == pair
            out.append(first + rules if hit else seq[i])
            i += 1 + hit
        seq, rules = out, rules + 1


def test_grammar_size():
    size = lambda g: len(g.symbols) + len(g.right) + repair.RULE_COST * len(g.sizes)
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 900, 2000), 0)
    for times in (2, 20):
        assert size(repair.compress(np.tile(text, times), 1000, 0)) <= len(text) + 3 * times
    words = [rng.integers(1, 900, rng.integers(1, 6)) for _ in range(300)]
    for ids in (rng.zipf(1.3, 3000) % 500 + 1, np.concatenate([words[w] for w in rng.zipf(1.2, 1500) % 300]), np.tile(text[:100], 30)):
        whole = repair.Sequence(ids, 0, 2)
        rules, used, share = 0, 0, 8
        while used != 2 or len(pairs):
            pairs, used = whole.round(1000 + rules, share)
            rules, share = rules + len(pairs), share if len(pairs) else share * 4
        length, plain_rules = plain_repair(ids.tolist(), 0, 1000)
        assert len(whole.symbols) + 2 * rules <= 1.05 * (length + 2 * plain_rules)
        assert size(repair.compress(ids, 1000, 0)) <= 1.05 * (length + (2 + repair.RULE_COST) * plain_rules)


# ---------------------------------------------------------------- 3

def test_warc_round_trip(spark):
    rng = random.Random(2)
    html = ["<p>é" + "".join(rng.choice("ab <>") for _ in range(rng.randrange(0, 4000))) for _ in range(12)]
    pages = [(i, f"http://x/{i}", html[i * i % 12]) for i in range(60)] + [(100, None, None), (101, "http://y\r\nWARC-Type: no", ""), (None, "u", html[0]), (None, "u", "alone"), (102, "z", "WARC/1.1\r\n\x1f\x8b\x08 no member"), (5, "again", html[25 % 12])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first", "3 AS n").repartition(3)
    for least in (0, 50):
        want = []
        for i, _, h in pages:
            body = (h or "").encode()
            same = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
            again = len(body) >= least and len(same) + (i is None) > 1 and i != min(same, default=i)
            want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", min(same) if again else None))
        key = lambda t: [(x is None, str(x)) for x in t]
        assert rows(warc.warc_round_trip(df, least)) == sorted(want, key=key)
    stages = Stages(spark)
    folder = stages.folder("w")
    stages.table(warc.write_warc(df, stages, folder, 0, file_bytes=3000), "files")
    for split in (97, 1000, 1 << 20):
        read = warc.read_warc(spark, folder, split).collect()
        assert len(read) == len(pages) and all(r.payload is None or hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest) for r in read)
    assert rows(warc.read_warc(spark, stages.folder("nothing"))) == []
    assert rows(warc.warc_round_trip(df.limit(0))) == []


# ---------------------------------------------------------------- 4

def test_differencing_is_tight():
    sizes = np.random.default_rng(0).lognormal(7, 1, 3000).astype(int)
    bins = [b[0] for b in sharding.differencing([[s] for s in sizes.tolist()], 16)]
    sums = np.bincount(bins, sizes, 16)
    assert sums.max() - sums.min() <= 8
    assert sharding.differencing([], 4) == [] and sharding.differencing([[5]], 4) == [[0]]
    assert all(sorted(b) == [0, 1, 2] for b in sharding.differencing([[5, 1, 9], [4, 4, 4], [7, 0, 2]], 3))


def test_shards(messy, corpus, empty):
    got = sharding.shard_by_bytes(messy.unionByName(messy.limit(2)), 4).collect()
    assert len(got) == len(corpus) + 2
    by = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): t or "" for i, t, *_ in corpus}
    place, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        place[by[r.doc_id, r.size, r.text_crc32]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in place.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rows(sharding.shard_by_bytes(empty, 4)) == []


# ---------------------------------------------------------------- 5

def plain_repeats(docs, length):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: none_last(d[0])):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                cover[s:s + length] = True
            seen.add(b[s:s + length])
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((i, len(b), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda t: [(x is None, str(x)) for x in t])


def passages(seed, n):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcd é") for _ in range(2000))
    part = lambda: base[(p := rng.randrange(1900)):p + rng.randrange(20, 400)] if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(1, 150)))
    docs = [(i, "".join(part() for _ in range(rng.randrange(0, 10)))) for i in range(n)]
    return docs + [(n + 1, "a" * 500), (n + 2, "ab" * 300 + "a" * 150), (n + 3, None), (n + 4, ""), (n + 5, docs[3][1]), (None, docs[5][1] + "q" * 120)]


@pytest.mark.parametrize("limit", [4096, 5])
def test_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(substrings.later_rounds, "__defaults__", (limit,))  # 5: every larger rank is dealt out anew
    docs = passages(5, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS tie", "3 AS run", "'x' AS kept")
    assert rows(substrings.remove_repeats(df)) == plain_repeats(docs, 100)


def test_repeats_of_shared_ids_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "x" * 50 + "y" * 60), (1, "x" * 50 + "y" * 60), (1, "other"), (2, "x" * 50 + "y" * 60)], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed, r.n_spans) for r in substrings.remove_repeats(df).collect()]
    assert sorted(got) == [(1, 0, 0), (1, 0, 0), (1, 0, 0), (2, 110, 1)]
    assert rows(substrings.remove_repeats(empty)) == []


def test_pieces_of_long_documents(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 300)
    text = bytes(random.Random(1).choices(b"abc", k=2000))
    found = np.concatenate([substrings.anchor_rows(p, 100, 32) for p in substrings.pieces(iter([(1, 0, text), (2, 0, b"short")]), 100)])
    starts = sorted(s for r in found for s in range(r["at"] - r["hi"], r["at"] - r["lo"] + 1))
    assert starts == list(range(len(text) - 99))  # every window once


def test_anchor_is_the_leftmost_minimum():
    values = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 7, 69):
        assert anchors.window_argmin(values, w).tolist() == [i + int(np.argmin(values[i:i + w])) for i in range(200 - w + 1)]


# ---------------------------------------------------------------- 7

def test_templates(spark):
    bench = spark.createDataFrame([(1, "Yesterday Tom bought 5 apples for 12 dollars and gave Mary 3 of them, so how many does Tom have left now?"), (2, "two words"), (3, None), (4, "A B C 1 2 3"), (5, "")],
                                  "item_id long, text string").selectExpr("*", "1 AS item", "2 AS h")
    docs = spark.createDataFrame([
        (1, "Intro here. Yesterday Anna bought 7 apples for 30 euros and gave Peter 2 of them, so how many does Anna have left now? Bye"),
        (2, "Yesterday Tom bought 5 apples for 12 dollars and gave Mary 3 of them, so how many does Tom have left now?"),
        (2, "Yesterday Tom bought 5 apples for 12 dollars and gave Mary 3 of them, so how many does Tom have left now?"),
        (3, None), (4, ""), (None, "these are two words here"), (6, "nothing here at all"), (7, "x. a B C 1 2 3"), (8, "q. Z Y C 4 2 3"),
        (9, "Yesterday Anna bought 7 apples for 30 euros"), (None, None)], "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS tie", "3 AS items", "4 AS at")
    got = {(r.doc_id, r.contaminated, r.reparameterised, r.items) for r in templates.decontaminate(docs, bench).collect()}
    assert got == {(1, True, True, "1"), (2, True, False, "1"), (3, False, False, ""), (4, False, False, ""), (None, True, False, "2"), (6, False, False, ""), (7, True, False, "4"), (8, False, False, ""), (9, False, False, ""), (None, False, False, "")}
    assert sorted((r.doc_id or 0) for r in templates.keep_clean(docs, bench).collect()) == [0, 3, 4, 6, 8, 9]
    assert templates.keep_clean(docs, bench).columns == docs.columns
    assert all(not r.contaminated for r in templates.decontaminate(docs, bench.limit(0)).collect())
    assert rows(templates.decontaminate(docs.limit(0), bench)) == []


def test_slots_must_agree():
    hit = lambda start, mine, theirs: {"at": start + 10, "start": start, "size": 8, "slots": mine, "doc_slots": theirs}
    same = [hit(k, ["tom", "5"], ["anna", "7"]) for k in range(13)]
    assert templates.consistent(same, 20) == (1.0, True)
    assert templates.consistent([hit(k, ["tom", "5"], ["anna", "7"] if k < 3 else [f"n{k}", "7"]) for k in range(13)], 20)[0] == 0.5


# ---------------------------------------------------------------- 8

def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(messy, corpus, empty):
    doubled = messy.unionByName(messy.limit(4))
    got = [tuple(r) for r in simhash.near_duplicates(doubled).collect()]
    prints = [plain_fingerprint(t) for _, t, *_ in corpus]
    group = list(range(len(corpus)))
    for _ in corpus:
        group = [min(group[j] for j in range(len(corpus)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(corpus))]
    least = {g: min((corpus[i][0] for i in range(len(corpus)) if group[i] == g and corpus[i][0] is not None), default=None) for g in group}
    want = {(c[0], f"{p:016x}", least[g]) for c, p, g in zip(corpus, prints, group, strict=True)}
    assert len(got) == len(corpus) + 4 and set(got) == want
    assert rows(simhash.near_duplicates(empty)) == []
    kept = simhash.keep_first(doubled)
    assert kept.columns == messy.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(least.values())


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    for n in (2, 63, 64, 65, 300):
        fp = rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, n)]
        for i in range(n):
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                fp[i] ^= np.uint64(1) << np.uint64(b)
        group = np.sort(rng.integers(0, 4, n))
        near = (np.bitwise_count(fp[:, None] ^ fp[None]) <= radius) & (group[:, None] == group[None])
        want = np.arange(n)
        for _ in range(n):
            want = np.array([want[near[i]].min() for i in range(n)])
        assert (simhash.linked(fp, group, radius, pairs_at_once=100) == want).all()


def test_large_buckets_are_dealt_out(spark):
    rng = random.Random(4)
    fp = list({rng.getrandbits(8) | rng.getrandbits(8) << 40 for _ in range(300)})
    df = spark.createDataFrame([(x,) for x in fp], "fp long")
    got = {r.node: r.root for r in components(simhash.candidate_links(df, 2, limit=16), Stages(spark)).collect()}
    root = {x: x for x in fp}
    for _ in range(12):
        root = {x: min(root[y] for y in fp if (x ^ y).bit_count() <= 2) for x in fp}
    assert {x: got.get(x, x) for x in fp} == root


# ---------------------------------------------------------------- 9 and 10

def plain_quality(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + o for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[g] > 1 for o in range(3)}
    with_word = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(with_word) - len(set(with_word)), len(again), failed


def test_quality(messy, corpus, empty):
    got = {(r.doc_id, *tuple(r)[1:7]) for r in quality.quality_rules(messy).collect()}
    assert got == {(i, *plain_quality(t)) for i, t, *_ in corpus}
    assert rows(quality.quality_rules(empty)) == [] and rows(quality.keep_documents(empty)) == []


def test_frequent_lines_deplete(spark):
    rng = random.Random(9)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menu = "Home   About us Contact " + own(60)
    docs = [(i, f"{menu}\n{own(200)}", "a") for i in range(40)] + [(100, f"{menu.upper()}\n{own(5)}", "a"), (101, f"{menu}\n{own(5)}", "b"), (102, own(80), None)]
    docs += [(200 + i, docs[0][1], "a") for i in range(30)] + [(300 + i, own(90), "a") for i in range(0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS total", "2 AS figures")
    got = {r.doc_id: (r.kept, r.n_frequent_words) for r in quality.quality_rules(df).collect()}
    n = len(menu.split())
    assert got[100] == (False, n) and got[101] == (True, 0) and got[102] == (True, 0) and all(got[i] == (True, n) for i in [*range(40), *range(200, 230)])
    kept = quality.keep_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (k, _) in got.items() if k}
    alone = spark.createDataFrame([(i, docs[0][1], "a") for i in range(60)], "doc_id long, text string, source string")
    assert quality.keep_documents(alone).count() == 60  # copies are one document


def plain_poisson(u, mean):
    p = c = np.exp(-mean)
    n = 0
    while c < u and n < mean + 12 * mean**0.5 + 30:
        n += 1
        p *= mean / n
        c += p
    return n


def test_mixing(messy, corpus, empty):
    size = collections.Counter()
    for _, t, _, s, _ in corpus:
        size[s or ""] += len((t or "").encode()) + 1
    weights = {"hot": 1.0, "s1": 2.0, "s2": 1.0}
    number = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:13], 16)
    for w, factor in ((None, 1.0), (weights, 3.0)):
        target = {s: (n**0.5 if w is None else w.get(s, 0)) for s, n in size.items()}
        want = collections.Counter()
        for i, t, _, s, _ in corpus:
            rate, ident = factor * sum(size.values()) * target[s or ""] / sum(target.values()) / size[s or ""], "null" if i is None else i
            parts = max(1, int(np.ceil(rate / 500)))
            n = sum(plain_poisson((number(17, j, ident) + 0.5) / 2**52, rate / parts) for j in range(1, parts + 1)) if rate else 0
            want.update((i, t, c, number(17, "order", c, ident)) for c in range(1, n + 1))
        got = mixing.mix_sources(messy, w, factor=factor)
        assert collections.Counter((r.doc.doc_id, r.doc.text, r.copy, r.order_key) for r in got.collect()) == want
        assert got.select("doc.*").columns == messy.columns
    keys = [r.order_key for r in mixing.mix_sources(messy).collect()]
    assert keys == sorted(keys) and rows(mixing.mix_sources(empty)) == []


def test_poisson_mean(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'abc' AS text", "'s' AS source")
    counts = np.array([r["count"] for r in mixing.mix_sources(df, factor=2.5).groupBy("doc.doc_id").count().collect()])
    assert abs(counts.sum() / 20_000 - 2.5) < 0.05 and abs((20_000 - len(counts)) / 20_000 - np.exp(-2.5)) < 0.01
