"""Every training-data operator against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosemill.llm import blocks, bpe, chat, class_lm, components, decontaminate, quality_knn, quality_rules, sharding, simhash, substring_dedup, toxicity_fm

RNG = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(60)] + ["été", "ÉTÉ", "naïve,", "the", "of", "İx", "Σας", "a_b", "don't", "x.y", "日本"]
SCHEMA = "doc_id long, text string, lang string, chunk long, bucket string, c0 int, fp string, words int, h int, at int, score string, kept string, key string"


def _words(n):
    return [VOCABULARY[i] for i in RNG.integers(0, len(VOCABULARY), n)]


@pytest.fixture(scope="module")
def texts():
    passage, block = " ".join(_words(70)), " ".join(_words(40))
    out = [None, "", " \t\n", "one", "two words", "a a a a a a", "\n".join(["same line here"] * 9)]
    out += [" ".join(_words(int(n))) for n in RNG.integers(1, 200, 30)]
    out += [" ".join([*_words(20), passage, *_words(20)]) for _ in range(6)]
    out += [f"{passage} {passage}", block, block, block.upper(), f"  {block}\n\n tail", " ".join(_words(6000)), "x " * 3000]
    base = _words(150)
    for k in range(8):
        near = list(base)
        near[k] = "changed"
        out.append(" ".join(near))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1, "b", 2, "f", 3, 4, 5, "s", "k", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[10], (None, "an id is missing here", *rows[0][2:])], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def table(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i % 5 != 1), int(i % 7 == 3)) for i in range(len(texts))] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def same(df, expected, *cols):
    got = Counter(tuple(r[c] for c in cols) for r in (df if isinstance(df, list) else df.collect()))
    assert got == Counter(expected)


def test_substring_dedup(docs, table):
    times = Counter(tuple(w[k : k + 35]) for w in (split(t) for _, t in table) for k in range(len(w) - 34))
    out = []
    for i, t in table:
        w = split(t)
        gone = {p for k in range(len(w) - 34) if times[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sum(o[2] for o in out) > 500
    found = substring_dedup.remove_repeats(docs)
    same(found, out, "doc_id", "n_words", "n_removed", "kept_sha256")
    clean = {i: t for i, t in table}
    for r in found.collect():
        assert r["c0"] == 2 and hashlib.sha256(" ".join(split(r["text"])).encode()).hexdigest() == r["kept_sha256"]
        if not r["n_removed"]:
            assert r["text"] == clean[r["doc_id"]]


@pytest.mark.parametrize("window", [3, 4, 7])
def test_other_windows(docs, table, window):
    times = Counter(tuple(w[k : k + window]) for w in (split(t) for _, t in table) for k in range(len(w) - window + 1))
    out = []
    for i, t in table:
        w = split(t)
        out.append((i, len({p for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for p in range(k, k + window)})))
    same(substring_dedup.remove_repeats(docs, window, with_text=False), out, "doc_id", "n_removed")


def test_kept_text_keeps_other_spaces():
    assert substring_dedup.kept_text(b"  a b\n\nc  d ", np.array([False, True, False, True])) == b"  a c  "


def test_sharding(docs, table):
    found = sharding.assign(docs, shards=5, lanes=3).collect()
    same(found, [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for i, t in table], "doc_id", "size", "text_crc32", "law", "grown_shard")
    slots, where = defaultdict(list), defaultdict(set)
    text = {i: t for i, t in table}
    for r in found:
        slots[r["shard"]].append(r["slot"])
        where[text[r["doc_id"]] or ""].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize(("fine", "shards"), [(1, 4), (50, 7), (200_000, 24)])
def test_smallest_capacity(spark, fine, shards):
    sizes = RNG.integers(1, 100, 400)
    keys = RNG.integers(-(2**63), 2**63 - 1, 400)
    groups = spark.createDataFrame([(int(k), int(b)) for k, b in zip(keys, sizes)], "key long, bytes long").cache()
    starts = sharding.boundaries(groups, int(sizes.sum()), int(sizes.max()), shards, fine)
    ordered = sizes[np.argsort(keys)]
    parts = np.searchsorted(np.array(starts), np.sort(keys), "right")
    edges = np.concatenate([[0], np.cumsum(ordered)])
    best = next(c for c in range(int(max(sizes.max(), -(-sizes.sum() // shards))), int(sizes.sum()) + 1) if sharding.greedy(edges, c, shards) is not None)
    assert np.bincount(parts, ordered).max() == best and parts.max() < shards


def test_large_group_stands_alone(spark):
    d = spark.createDataFrame([(i, "hot text " * 9) for i in range(200)] + [(1000 + i, f"text {i}") for i in range(300)], "doc_id long, text string")
    sums = sorted(r["s"] for r in sharding.assign(d, shards=6).groupBy("shard").agg(F.sum("size").alias("s")).collect())
    assert len(sums) == 6 and sums[4] - sums[0] < 60


def test_decontamination(spark, docs, table):
    texts = [t for _, t in table if t]
    long = next(t for t in texts if len(split(t)) > 30)
    items = [(1, " ".join(split(long)[3:20])), (2, "TWO, words"), (3, None), (4, "!!"), (5, "w1"), (6, "nothing like this ever stands anywhere at all in here"), (7, " ".join(split(long)[5:18])), (7, " ".join(split(long)[5:18])), (None, "an id")]
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in table:
        w, hit, ids = low(t), set(), set()
        for item, text in items:
            x = low(text)
            n = min(10, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert sum(o[5] for o in out) > 3
    b = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(decontaminate.contamination(docs, b), out, *cols)
    old, decontaminate.SENT = decontaminate.SENT, 0  # the way without a broadcast
    try:
        same(decontaminate.contamination(docs, b), out, *cols)
    finally:
        decontaminate.SENT = old
    assert not decontaminate.contamination(docs, b.filter("false")).filter("contaminated").count()


def test_one_window_named_by_very_many_items(spark, monkeypatch):
    """Ids are counted with the windows that name them: this benchmark isn't sent."""
    b = spark.createDataFrame([(f"i{k:04}", "one two three") for k in range(300)], "item_id string, text string")
    d = spark.createDataFrame([(1, "zero One two, three"), (2, "one two")], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "SENT", 100)
    ids = ",".join(f"i{k:04}" for k in range(300))
    same(decontaminate.contamination(d, b), [(1, 3, 300, hashlib.sha256(ids.encode()).hexdigest()), (2, 0, 0, hashlib.sha256(b"").hexdigest())], "doc_id", "n_hit", "n_items", "items_sha256")


def test_bpe(docs, table):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = []
    for i, x in table:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)))
    found = bpe.encode(docs, path).rdd.map(lambda r: (r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]))).collect()
    assert Counter(found) == Counter(out)


def test_bpe_on_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    v = bpe.Vocabulary(open(path, encoding="utf-8").read())
    alphabet = list("abcdefgh  LLLl'sStTre0123.,!?") + ["é", "é", "Σ", "İ", "ß", " ", "　", "\x85", "\x1c", "日", "😀", "́", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "ﬁ", "Å", "\n", "\t", "ll", "hello", "world"]
    texts = ["".join(RNG.choice(alphabet, int(n))) for n in RNG.integers(0, 80, 400)]
    words = sorted({w for x in texts for w in x.encode().split()})
    encoder = bpe.Encoder(v)
    encoder.learn(words)
    at = encoder.words
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        own = [at[w] for w in x.encode().split() if at[w][0]]
        assert b" ".join(o[1] for o in own).decode() == " ".join(map(str, ids)), x
        assert b" ".join(o[2] for o in own).decode() == t.decode(ids, skip_special_tokens=False) == bpe.decode(v, ids)


def _class_model(texts, learned, frequent, classes, sweeps):
    """The class model word by word: (log10 probability of each text, what the base counts need)."""
    low = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    train = [w for w, own in zip(low, learned) if own]
    counts, ends = Counter(x for w in train for x in w), len(train)
    raw = {x: np.frombuffer(x.encode(), np.uint8) for x in counts}
    h = {x: int(blocks.hashed(d, np.array([0, len(d)]))[0][0]) for x, d in raw.items()}
    none, end, signed = classes, classes + 1, lambda v: v - 2**64 if v >> 63 else v
    top = sorted(counts, key=lambda x: (-counts[x], signed(h[x])))[:frequent]
    number = {x: i for i, x in enumerate(top)}
    between = np.zeros((len(top) + 2,) * 2)
    for w in train:
        s = [len(top) + 1, *(number.get(x, len(top)) for x in w), len(top) + 1]
        for a, b in zip(s, s[1:]):
            between[a, b] += 1
    core = class_lm.exchange(between, classes + 2, alone=2)
    label = {x: int(core[number[x]]) if x in number else none for x in counts}

    def model():
        m = np.zeros((classes + 2,) * 2)
        for w in train:
            s = [end, *(label[x] for x in w), end]
            for a, b in zip(s, s[1:]):
                m[a, b] += 1
        row, col = m.sum(1), m.sum(0)
        share = lambda x: (x + 0.1) / (x.sum() + 0.1 * len(x))
        t = class_lm.TRANSITION
        return m, (m + t * share(col)[None]) / (row[:, None] + t), (m + t * share(row)[:, None]) / (col[None] + t), col

    for k in range(sweeps):
        _, forward, backward, _ = model()
        around = {x: ([0] * (classes + 2), [0] * (classes + 2)) for x in counts}
        for w in train:
            s = [end, *(label[x] for x in w), end]
            for i, x in enumerate(w):
                around[x][0][s[i]] += 1
                around[x][1][s[i + 2]] += 1
        new = {}
        for x, (before, behind) in around.items():
            gain = [sum(n * math.log(backward[c, d]) for c, n in enumerate(before) if n) + sum(n * math.log(forward[d, c]) for c, n in enumerate(behind) if n) for d in range(classes)]
            new[x] = label[x] if k == 0 and x in number else int(np.argmax(np.round(gain, 9)))
        label = new
    _, forward, _, size = model()
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    below, out = n + 0.1 * (v + 1), []
    for w in low:
        total, before = 0.0, end
        for x in [*w, None]:
            c, own = (ends, end) if x is None else (counts[x], label.get(x, none))
            by_class = 0 if own == none or not size[own] else forward[before, own] * c / size[own]
            total += math.log10((1 - class_lm.BASE) * by_class + class_lm.BASE * (c + 0.1) / below)
            before = own
        out.append(total)
    return out, (low, counts, ends, n, below)


@pytest.mark.parametrize(("frequent", "classes", "sweeps"), [(20, 6, 1), (30, 5, 3)])
def test_class_lm(docs, table, frequent, classes, sweeps):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in table]
    scores, (low, counts, ends, n, below) = _class_model([t for _, t in table], [not x for x in held], frequent, classes, sweeps)
    found = class_lm.score(docs, frequent=frequent, classes=classes, sweeps=sweeps).collect()
    log = lambda c: math.log10((c + 0.1) / below)
    out = Counter((i, x, len(w) + 1, sum(counts[y] > 0 for y in w) + 1, n, round(sum(log(counts[y]) for y in w) + log(ends), 4), round(s, 4)) for (i, _), x, w, s in zip(table, held, low, scores))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in found) == out


def test_class_lm_gains_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = class_lm.score(d).filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.25  # log10 a token


def test_exchange_finds_classes():
    counts = np.zeros((21, 21))
    counts[:10, 10:20] = 9  # words of one kind are followed by the other
    counts[10:20, :10] = 7
    counts[20, :10] = counts[10:20, 20] = 3
    label = class_lm.exchange(counts, 3)
    assert len(set(label[:10])) == 1 and len(set(label[10:20])) == 1 and label[0] != label[10] and label[20] == 2


def _fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhashes_in_parts(monkeypatch):
    raw = bytes(RNG.integers(0, 256, 3000).astype(np.uint8))
    begin = RNG.integers(0, 2000, 1500)
    end = begin + RNG.integers(0, 600, 1500)
    data = np.frombuffer(raw, np.uint8)
    assert (simhash.xxh64(data, begin, end) == np.array([xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(begin, end)], np.uint64)).all()
    gaps = [" ", "\n", "  ", " \t"]
    texts = ["", "a", " a b", "a  b\n\nc d ", " \t", "x" * 500, "y" * 90 + " z"] + ["".join(VOCABULARY[i] + gaps[RNG.integers(0, 4)] for i in RNG.integers(0, len(VOCABULARY), int(n))) for n in RNG.integers(0, 300, 80)]
    column = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = np.array([_fingerprint(t) for t in texts], np.uint64)
    for size, at_once in ((1 << 18, 1 << 16), (64, 1 << 16), (1000, 7)):
        monkeypatch.setattr(blocks, "SLICE", size)
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        assert (simhash.simhashes(*column) == want).all()


def _components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    return find


def test_simhash(docs, table):
    fps = [_fingerprint(t) for _, t in table]
    find = _components(set(fps))
    least = {}
    for (i, _), f in zip(table, fps):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    out = [(i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(table, fps)]
    assert len({o[2] for o in out}) < len({o[1] for o in out})
    found = simhash.near_duplicates(docs)
    same(found, out, "doc_id", "fingerprint", "component_id")
    heads = found.filter("representative").select("component_id", "doc_id").distinct()
    assert heads.count() == len({o[2] for o in out})


def test_links_at_the_radius(spark):
    base = [int(x) for x in RNG.integers(0, 2**63, 40)]
    fps = set(base)
    for x in base[:25]:
        for _ in range(12):
            bits = RNG.choice(64, int(RNG.integers(1, 5)), replace=False)
            fps.add(x ^ sum(1 << int(b) for b in bits))
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    d = spark.createDataFrame(signed, "fp long").cache()
    find = _components(fps)
    for tile, rows in ((4096, 60_000), (8, 100)):
        labels = {r["node"] % 2**64: r["label"] for r in components.components(simhash.links(d, tile, rows)).collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[find(f)].add(labels.get(f, f if f < 2**63 else f - 2**64))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_one_bucket_in_blocks():
    x = np.array(sorted({int(v) for v in RNG.integers(0, 2**14, 700)}), np.uint64)
    for link in (lambda: simhash.link_bucket(x, 16), lambda: simhash.link_runs(x, np.zeros(len(x), np.int64))):
        a, b = link()
        label = simhash._merge(len(x), a, b)
        find = _components({int(v) for v in x})
        assert len(set(label)) == len({find(int(v)) for v in x})
        assert all((int(x[i]) ^ int(x[j])).bit_count() <= 3 for i, j in zip(a, b))


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "ok"), (3, 0, "user", "hi"), (4, 0, "user", "bye"), (5, 0, "user", "bye"), (6, 3, "user", "hi"), (6, 9, "bot", "yo"), (6, 9, "bot", "yo"), (6, 10, None, None), (None, 0, "user", "lost")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("h", F.lit("x"))
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in chat.render(d).collect()}
    hi = "<|user|>\nhi\n<|bot|>\nyo\n"
    assert got == {2: (3, 1, hi + "<|user|>\nok\n"), 4: (1, 2, "<|user|>\nbye\n"), 6: (3, 1, hi + "<||>\n\n"), None: (1, 1, "<|user|>\nlost\n")}
    assert not chat.render(d.filter("false")).count()


def test_chat_equals_its_sql(spark):
    import duckdb

    from prosemill.llm.queries import oracle_sql

    rows = [(1, 0, None, ""), (2, 0, "", None), (3, 0, None, None), (4, 0, "", ""), (5, 0, "a", "x"), (5, 1, None, "y"), (6, 0, "a", "x"), (6, 1, "", "y"), (7, 0, "a", "x"), (None, 0, "a", "x"), (None, 1, "b", "z"), (None, 1, "b", "z"), (None, 2, "b", "z"), (8, None, "a", "x"), (9, 3, "a", "x " * 50_000), (9, 4, "a", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    db = duckdb.connect()
    db.register("conversations", d.toArrow())
    expected = db.execute(oracle_sql()["op8_chat_format"]).fetchall()
    same(chat.render(d), expected, "conv_id", "n_turns", "n_copies", "text")
    assert (1, 1, 4, "<||>\n\n") in expected and (None, 1, 2, "<|b|>\nz\n") in expected


def test_quality_counts_and_ratio(docs, labels, table):
    found = quality_rules.judge(docs, labels).collect()
    out = []
    for i, t in table:
        t = t or ""
        w = split(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(tri)
        rep = len({k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)})
        seen, dup = set(), 0
        for x in t.split("\n"):
            if split(x):
                dup += x in seen
                seen.add(x)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    same(found, out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    # the ratio, by the formula, over the hashes that Spark gives
    every = sorted({x for _, t in table for a, b in zip(split(t), [*split(t)[1:], None]) for x in ((1, a, ""), *([(2, a, b), (3, a[-2:], b[-2:])] if b else []))})
    rows = docs.sparkSession.createDataFrame(every, "k int, a string, b string").select("*", F.when(F.col("k") == 1, F.xxhash64("k", "a")).otherwise(F.xxhash64("k", "a", "b")).alias("x")).collect()
    at = {(r["k"], r["a"], r["b"]): r["x"] for r in rows}
    size = quality_rules.BUCKETS
    pairs = lambda t: list(zip(split(t), split(t)[1:]))
    grams = lambda t: [at[g] % size for g in [*((1, x, "") for x in split(t)), *((2, a, b) for a, b in pairs(t)), *((3, a[-2:], b[-2:]) for a, b in pairs(t))]]
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for i, t in table:
        raw.update(grams(t))
        if i in good and i is not None:
            target.update(grams(t))
    n, g, lean = sum(raw.values()), sum(target.values()), quality_rules.LEAN
    p = lambda b: (raw[b] + 1) / (n + size)
    weight = lambda b: math.log((target[b] + lean * p(b)) / (g + lean) / p(b))
    llr = sorted(round(sum(map(weight, grams(t))) / max(1, len(grams(t))), 6) for _, t in table)
    assert np.allclose(llr, sorted(r["llr"] for r in found), atol=2e-6)
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD) for r in found)


@pytest.fixture(scope="module")
def corpus(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    return d, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


@pytest.mark.parametrize(("classify", "name", "least"), [(quality_knn.classify, "quality", 0.97), (toxicity_fm.classify, "toxic", 0.97)])
def test_held_out_accuracy(corpus, classify, name, least):
    d, labels = corpus
    rows = classify(d, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", F.col(name).alias("y")).toPandas()
    assert len(rows) > 500 and (rows.predicted == rows.y).mean() >= least
    assert rows.score[rows.y == 1].mean() - rows.score[rows.y == 0].mean() > 0.6


@pytest.mark.parametrize("classify", [quality_knn.classify, toxicity_fm.classify])
def test_classifiers_on_odd_tables(docs, labels, table, classify):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    found = classify(docs, labels)
    same(found, [(i, held(i)) for i, _ in table], "doc_id", "held_out")
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert all(0 <= r["score"] <= 1 for r in classify(docs, labels.filter("false")).collect())


def test_factors_learn_pairs():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        has = [k for k in range(6) if rng.random() < 0.5]
        rows.append(np.array(has, np.int32))
        y.append(float(0 in has and 1 in has))  # neither term is enough alone
    model = toxicity_fm.train(rows, np.array(y, np.float32), 6, steps=400)
    x = np.zeros((1500, 6), np.float32)
    for i, h in enumerate(rows):
        x[i, h] = 1
    assert ((toxicity_fm.margin(x, *model) > 0) == np.array(y)).mean() > 0.97


def test_vote():
    rng = np.random.default_rng(1)
    known = quality_knn.unit(rng.normal(size=(60, 5)).astype(np.float32))
    known[40:50] = known[3]  # ties
    label = rng.integers(0, 2, 60).astype(float)
    z = np.concatenate([quality_knn.unit(rng.normal(size=(30, 5)).astype(np.float32)), np.zeros((1, 5), np.float32)])
    out = []
    for q in z:
        cosines = [max(0.0, float(np.dot(q, k))) for k in known]
        last = sorted(cosines)[-quality_knn.NEIGHBOURS]
        votes = [(c**quality_knn.SHARPNESS, y) for c, y in zip(cosines, label) if c >= last - 1e-7]
        total = sum(v for v, _ in votes)
        out.append(sum(v * y for v, y in votes) / total if total else 0.3)
    assert np.allclose(quality_knn.vote(z, known, label, 0.3), out, atol=1e-5)
    assert quality_knn.vote(z, known[:1], label[:1], 0.3).shape == (31,)


def test_knn_scores_by_the_formula(docs, labels, table):
    """All of it but the singular vectors, which are checked for what they span."""
    m = quality_knn.fit(docs, labels)
    text = {i: t for i, t in table}
    y = defaultdict(int)
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            y[r["doc_id"]] = max(y[r["doc_id"]], r["quality"])
    assert list(m["label"]) == [y[i] for i in sorted(y)]

    def counts(t):
        raw, out = (t or "").encode(), np.zeros(quality_knn.TERMS)
        for a, b in zip(raw, raw[1:]):
            out[(((a * 0x9E3779B1 + b * 0x85EBCA77) % 2**32) >> 8) % (quality_knn.TERMS - quality_knn.ECHOES)] += 1
        w = split(t)
        out[quality_knn.TERMS - quality_knn.ECHOES :] = sum(a == b for a, b in zip(w, w[1:]))
        return out

    sample = np.array([counts(text[i]) for i in sorted(y)])
    idf = np.log((1 + len(sample)) / (1 + (sample > 0).sum(0))) + 1
    assert np.allclose(idf, m["idf"], atol=1e-4)
    place = lambda c: quality_knn.unit(quality_knn.weigh(c[None], idf) @ m["base"])[0]
    assert np.allclose([place(c) for c in sample], m["known"], atol=1e-3)
    assert np.allclose(m["base"].T @ m["base"], np.eye(m["base"].shape[1]), atol=1e-3)
    want = quality_knn.vote(np.array([place(counts(t)) for _, t in table], np.float32), m["known"], m["label"], m["prior"])
    got = sorted((r["score"], r["predicted"]) for r in quality_knn.classify(docs, labels).collect())
    assert np.allclose([g for g, _ in got], sorted(want), atol=2e-3) and all(p == (g >= 0.3) for g, p in got)


def test_machine_selects_and_scores(spark):
    """Terms by their chi-squared, scores by all pairs, on texts where only the pair is toxic."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for i in range(1500):
        w = [f"n{k}" for k in rng.integers(0, 300, 20)] + [x for x in ("Alpha", "omega") if rng.random() < 0.5]
        y.append(int("Alpha" in w and "omega" in w))
        rows.append((f"id{i}", " ".join(rng.permutation(w))))
    d = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    labels = spark.createDataFrame([(f"id{i}", v) for i, v in enumerate(y)] + [("absent", 1)], "doc_id string, toxic int")
    got = {r["doc_id"]: r for r in toxicity_fm.classify(d, labels).collect()}
    held = [i for i in range(1500) if zlib.crc32(f"id{i}".encode()) % 5 == 0]
    assert np.mean([got[f"id{i}"]["predicted"] == y[i] for i in held]) > 0.97
    m = toxicity_fm.fit(d, labels)

    def buckets(t):
        out = set()
        for w in re.findall("[0-9a-z\x80-\xff]+", t.lower().encode().decode("latin1")):
            raw = np.frombuffer(w.encode("latin1"), np.uint8)
            for tag, size in ((0, len(raw)), (1, 4), (2, 5)):
                h = blocks.mix(blocks.word_hashes(raw, np.array([0]), np.array([min(size, len(raw))])) + np.uint64(tag))
                out.add(int(h[0]) % toxicity_fm.BUCKETS)
        return out

    own = [buckets(t) for _, t in rows]
    learn = [i for i in range(1500) if i not in set(held)]
    n, n1 = len(learn), sum(y[i] for i in learn)
    a, b = Counter(x for i in learn if not y[i] for x in own[i]), Counter(x for i in learn if y[i] for x in own[i])
    chi = {x: n * (a[x] * n1 - b[x] * (n - n1)) ** 2 / ((a[x] + b[x]) * (n - a[x] - b[x]) * n1 * (n - n1)) for x in a.keys() | b.keys() if 2 <= a[x] + b[x] <= n - 2}
    assert set(m["chosen"].tolist()) == {x for x, c in chi.items() if c > 2 * math.log(len(chi))}
    at = {int(x): i for i, x in enumerate(m["chosen"])}
    for i in range(60):
        has = [at[x] for x in own[i] if x in at]
        z = m["bias"] + sum(float(m["weight"][j]) for j in has) + sum(float(m["factor"][j] @ m["factor"][k]) for j, k in combinations(has, 2))
        assert abs(got[f"id{i}"]["score"] - 1 / (1 + math.exp(-z))) < 1e-3


@pytest.mark.parametrize("classify", [quality_knn.classify, toxicity_fm.classify])
def test_any_ids_repeated_ids_and_absent_labels(spark, docs, labels, classify):
    """Ids as text, one id with several texts: the same scores however rows are dealt out."""
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    d = d.union(d.filter("doc_id % 4 = 2").withColumn("text", F.concat(F.lit("more of it "), F.reverse("text"))))
    named = labels.select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic").union(spark.createDataFrame([("no such", 1, 1)], "doc_id string, quality int, toxic int"))
    runs = [Counter((r["doc_id"], round(r["score"], 3), r["predicted"]) for r in classify(d.repartition(n), named).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    one = d.filter("doc_id = '9'")
    assert classify(one, named).count() == one.count()


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.filter("false"), labels.filter("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (substring_dedup.remove_repeats(none), sharding.assign(none), decontaminate.contamination(none, bench), bpe.encode(none, public_tokenizers.path("word_bpe_49k.json")), class_lm.score(none), simhash.near_duplicates(none), quality_rules.judge(none, no_labels), quality_knn.classify(none, no_labels), toxicity_fm.classify(none, no_labels)):
        assert df.count() == 0


def _thue_morse(n):
    one = bytes(97 + (i.bit_count() & 1) for i in range(n))
    return one.decode(), bytes(195 - c for c in one).decode()


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_in_the_order_of_thue_and_morse(spark, n):
    """No polynomial modulo 2**64 tells such words apart."""
    a, b = _thue_morse(n)
    filler = [f"v{i}" for i in range(34)]
    d = spark.createDataFrame([(1, " ".join([*filler, a])), (2, " ".join([*filler, b])), (3, f"{a} {b} {a}")], "doc_id long, text string")
    assert not substring_dedup.remove_repeats(d).filter("n_removed > 0").count()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r["doc_id"]: r["ids"] for r in bpe.encode(d, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert found == {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids for r in d.collect()}
    # windows of words in that order: 64 of them
    x, y = ([f"w{c}" for c in s[:64]] for s in (a, b))
    d = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y))], "doc_id long, text string")
    assert not substring_dedup.remove_repeats(d, 64).filter("n_removed > 0").count()


def test_equal_hashes_do_not_join_words():
    words = [b"ab", b"cd", b"ab", b"x" * 100, b"y" * 100, b"ab", b"x" * 100, b"cdcdcdcdcd", b"cdcdcdcdce"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    begin, end, _ = blocks.words(data, np.array([0, len(data)]))
    for h in (np.zeros(len(words), np.uint64), np.array([len(w) for w in words], np.uint64), blocks.word_hashes(data, begin, end)):
        first, of = bpe.distinct_words(data, begin, end, h)
        assert [words[first[k]] for k in of] == words and len(first) == len(set(words))


def test_rows_repeated_without_end(spark, monkeypatch):
    """One id and text in most rows: dealt by place, results the same."""
    passage = " ".join(f"p{i}" for i in range(50))
    d = spark.createDataFrame([(7, passage)] * 60 + [(8, f"own {passage} tail"), (9, "a b c"), (None, ""), (None, "")], "doc_id long, text string").repartition(6)
    monkeypatch.setattr("prosemill.llm.shared.REPEATED", 10)
    same(substring_dedup.remove_repeats(d), [(7, 50, 50)] * 60 + [(8, 52, 50), (9, 3, 0), (None, 0, 0), (None, 0, 0)], "doc_id", "n_words", "n_removed")
    many = {round(r["score"], 6) for r in class_lm.score(d).filter("doc_id = 7").collect()}
    monkeypatch.undo()
    assert many == {round(r["score"], 6) for r in class_lm.score(d).filter("doc_id = 7").collect()} and len(many) == 1


def test_hashes_of_slices():
    text = "ab cd  ab\tcd".encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    h, p = blocks.hashed(data, at)
    assert len(h) == 4 and h[0] == h[2] and h[1] == h[3] != h[0] and list(p) == [0, 4]
    r = blocks.rolling(h, 2)
    assert r[0] == r[2] != r[1]
    values = np.sort(RNG.integers(0, 2**63, 1000).astype(np.uint64))
    assert (blocks.unpack(blocks.pack(values)) == values).all()
    numbers = np.concatenate([[0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**35 - 1], RNG.integers(0, 300, 500)])
    assert (blocks.expand(blocks.squeeze(numbers)) == numbers).all() and not len(blocks.expand(blocks.squeeze(numbers[:0])))


def test_long_texts_are_cut_between_words():
    texts = ["", "abc " * 50, "x" * 300, "tail", " \n", "y" * 90 + " z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = blocks.hashed(data, at)
    old, blocks.SLICE = blocks.SLICE, 64
    try:
        parts = list(blocks.pieces(data, at, limit=64))
        assert parts[0][2] == 0 and parts[-1][3] == len(data) and all(a[3] == b[2] for a, b in zip(parts, parts[1:]))
        assert max(b - a for _, _, a, b in parts) <= 364
        got = [np.concatenate(x) for x in zip(*[(blocks.hashed(data[at[i] : at[i + 1]], at[i : i + 2] - at[i])[0],) for i in range(len(texts))])][0]
    finally:
        blocks.SLICE = old
    assert (got == whole[0]).all() and list(whole[1]) == [0, 0, 50, 51, 52, 52, 54]
