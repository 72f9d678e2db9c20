"""LM scoring with a Brown class-based bigram model.

Words are put into classes by exchange clustering, all words of the training
texts: the ``FREQUENT`` most frequent by exact exchange (each moves to the class
that raises the likelihood of the class bigrams most, in sweeps, until none
moves), then the whole vocabulary in ``SWEEPS`` sweeps of parallel exchange: the
classes beside each word are counted over the whole corpus, and each word moves
to the class with the highest gain, taken to first order at the class bigram
counts of that sweep. Of equal gains the least class wins.

    P(word | class before) = (1 - BASE) * P(class | class before) * n(word) / n(class) + BASE * base(word)

Transitions are class bigram counts over all training words, smoothed by the
classes' own shares. A word without a training count has no class: only the base
model gives it weight, and the word after it sees the shares of the classes. The
end of a text is a class of its own.

1. Texts are read once, some megabytes at a time: such a chunk becomes the hashes
   of its distinct words and the number of each token's word, and is written down
   by chunk. Everything below reads that; texts are not shuffled.
2. Each chunk sends its words with their training counts to hash buckets, which
   name the frequent ones.
3. The bigrams of frequent words are counted; the driver gets at most
   (FREQUENT + 2) ** 2 sums and clusters them.
4. In each sweep chunks send, for each word, how often each class stands before
   and behind it; buckets sum these, choose, and answer with the classes.
5. Class bigrams are counted, and chunks score their documents.

A chunk names a word once, so a word that a third of the text consists of costs
each chunk one entry. Words are told apart by 64 bits of their hash: with n
distinct words two fall together with a chance of about n * n / 2 ** 65.

Null, empty and blank texts are one token, the end. Repeated rows count each. A
text longer than a chunk makes a chunk of its length.
Ties of frequency go to the lesser hash. Extra columns are carried or left out,
whatever their names. An empty table gives an empty result; without training text
all counts are 0 and the base model alone is left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.llm import blocks as B
from prosemill.llm.shared import crc_mod, cut, cut_by, power_of_two, text_bytes
from prosemill.session import ship

FREQUENT, CLASSES, SWEEPS = 1000, 48, 2
#: Added to counts, as in the base score; pseudo-counts of transitions; weight of the base model.
ADD, TRANSITION, BASE = 0.1, 5.0, 0.2
CHUNK, BUCKET, BLOCK = 4 << 20, 500_000, 20_000
#: Chunks of a partition, about.
TOGETHER = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(table, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, and where documents begin."""
    data, at = B.column(table, name)
    return B.hashed(_LOWER[data[at[0] : at[-1]]], at - at[0])


def _schema(text: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in text.split(", ")])


_ROW = "chunk long, words binary, tokens binary, sizes binary, learn binary, carried binary"
_ASK = "chunk long, bucket int, words binary, counts binary"
_TOLD = "top binary, n long, v long"
_BESIDE = "chunk long, bucket int, words binary, kinds binary, ids binary, counts binary"
_ANSWER = "chunk long, bucket int, labels binary, counts binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    B.trim()
    fields = _schema(schema)
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), fields)] if rows else [pa.array([], f.type) for f in fields], schema=fields)


def _fold(names: list[str]):
    """Documents to chunks. The carried columns travel as a block of Arrow bytes."""

    def folded(table: pa.Table, chunk: int) -> pa.RecordBatch:
        h, pointers = _words(table)
        distinct, of, times = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get short numbers
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.select(names).schema) as out:
            out.write_table(table.select(names))
        learn = ~table["held"].combine_chunks().to_numpy(zero_copy_only=False)
        row = (chunk, distinct[order].astype("<u8").tobytes(), B.squeeze(number[of]), np.diff(pointers).astype("<i8").tobytes(), learn.tobytes(), sink.getvalue().to_pybytes())
        return _table(_ROW, [row]).to_batches()[0]

    def run(batches):
        first, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            _, at = B.column(batch, "text")
            for lo, hi in B.slices(at, CHUNK):
                held.append(batch.slice(lo, hi - lo))
                size += int(at[hi] - at[lo])
                if size >= CHUNK:
                    yield folded(pa.Table.from_batches(held), first)
                    first, held, size = first + 1, [], 0
        if held:
            yield folded(pa.Table.from_batches(held), first)

    return run


class _Chunk:
    """The distinct words of a chunk, which of them each token is, and which tokens are learned from."""

    def __init__(self, table: pa.Table, exponent: int):
        row = {c: table[c][0].as_py() for c in ("words", "tokens", "sizes", "learn")}
        words = np.frombuffer(row["words"], "<u8")
        order = np.argsort(words)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.distinct, self.of = words[order], number[B.expand(row["tokens"])]
        self.size, self.learn = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["learn"], bool)
        self.pointers = np.concatenate([[0], np.cumsum(self.size)])
        self.buckets, self.edges = B.bucket_edges(self.distinct, 64, exponent)
        self.base = 64 - exponent

    def slices(self):
        return zip(self.buckets.tolist(), self.edges[:-1].tolist(), self.edges[1:].tolist())

    def packed(self, bucket: int, lo: int, hi: int) -> bytes:
        return B.pack(self.distinct[lo:hi], bucket << self.base)

    def sequence(self, label: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all learned texts, an end before each and behind the last; the tokens' words and places in it."""
        token = np.repeat(self.learn, self.size)
        of, size = self.of[token], self.size[self.learn]
        ends = np.concatenate([[0], np.cumsum(size)])
        return np.insert(label[of], ends, end), of, np.arange(len(of)) + 1 + np.repeat(np.arange(len(size)), size)

    def answered(self, answers: pa.Table, name: str, default: int) -> np.ndarray:
        out = np.full(len(self.distinct), default, np.int64)
        found = dict(zip(answers["bucket"].to_pylist(), answers[name]))
        for b, lo, hi in self.slices():
            if b in found and (raw := found[b].as_py()) is not None:
                out[lo:hi] = np.frombuffer(raw, f"<u{len(raw) // (hi - lo)}")
        return out


def _ask(exponent: int):
    def ask(key, table):
        c = _Chunk(table, exponent)
        counts = np.bincount(c.of[np.repeat(c.learn, c.size)], minlength=len(c.distinct))
        return _table(_ASK, [(key[0].as_py(), b, c.packed(b, lo, hi), B.squeeze(counts[lo:hi])) for b, lo, hi in c.slices()])

    return ask


def _count(exponent: int, frequent: int):
    def count(key, table):
        base = key[0].as_py() << (64 - exponent)
        distinct, of = np.unique(np.concatenate([B.unpack(x.as_py(), base) for x in table["words"]]), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, of, np.concatenate([B.expand(x.as_py()) for x in table["counts"]]))
        best = np.lexsort((distinct, -total))[:frequent]
        best = best[total[best] > 0]
        top = np.stack([distinct[best].astype("<u8"), total[best].astype("<u8")]).tobytes()
        return _table(_TOLD, [(top, int(total.sum()), int((total > 0).sum()))])

    return count


class Symbols:
    """Words to numbers: frequent words first, all others together, then the end."""

    def __init__(self, frequent: np.ndarray):
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]
        self.other = len(frequent)
        self.end = self.other + 1

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.other, np.int64)
        if self.other and len(h):
            at = np.minimum(np.searchsorted(self.sorted, h), self.other - 1)
            known = self.sorted[at] == h
            out[known] = self.order[at[known]]
        return out


def _pairs(s: np.ndarray, size: int) -> pa.Table:
    pair, n = np.unique(s[:-1] * size + s[1:], return_counts=True)
    return pa.table({"pair": pa.array(pair, pa.int64()), "n": pa.array(n, pa.int64())})


def _bigrams(symbols: Symbols):
    def bigrams(key, table):
        c = _Chunk(table, 0)
        s, _, _ = c.sequence(symbols.of(c.distinct), symbols.end)
        return _pairs(s, symbols.end + 1)

    return bigrams


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int, sweeps: int = 100, alone: int = 1) -> np.ndarray:
    """A class for each symbol of a bigram count matrix, the last ``alone`` symbols each alone in the last classes.

    Sweeps go on until no symbol moves, ``sweeps`` at most; of equal gains the least class wins, and staying before moving.
    """
    n, free = len(counts), classes - alone
    weight = counts.sum(0) + counts.sum(1)
    label = np.arange(n) - n + classes
    order = np.argsort(-weight[: n - alone], kind="stable")
    label[order] = np.arange(n - alone) % free
    member = np.zeros((n, classes))
    member[np.arange(n), label] = 1.0
    into, out = counts.T @ member, counts @ member  # by class before, by class after
    m = member.T @ out
    for _ in range(sweeps):
        moved = 0
        for s in order:
            was, self_count = label[s], counts[s, s]
            o, i = out[s].copy(), into[s].copy()
            o[was] -= self_count
            i[was] -= self_count
            m[was] -= o
            m[:, was] -= i
            m[was, was] -= self_count
            rows, columns = m.sum(1) + i, m.sum(0) + o  # what the symbol adds to them wherever it goes
            diagonal = np.diag(m)
            gain = (_entropy(m + o[None, :]) - _entropy(m)).sum(1) + (_entropy(m + i[:, None]) - _entropy(m)).sum(0)
            gain += _entropy(diagonal + o + i + self_count) + _entropy(diagonal) - _entropy(diagonal + o) - _entropy(diagonal + i)
            gain -= _entropy(rows + o.sum() + self_count) - _entropy(rows) + _entropy(columns + i.sum() + self_count) - _entropy(columns)
            gain[free:] = -np.inf
            to = int(np.argmax(gain))
            if gain[to] <= gain[was] + 1e-9:
                to = was
            m[to] += o
            m[:, to] += i
            m[to, to] += self_count
            if to != was:
                moved += 1
                label[s] = to
                out[:, was] -= counts[:, s]
                out[:, to] += counts[:, s]
                into[:, was] -= counts[s]
                into[:, to] += counts[s]
        if not moved:
            break
    return label


class Model:
    """Class bigram counts (classes, then no class, then the end) and what follows from them."""

    def __init__(self, bigrams: np.ndarray, tokens: int, types: int, ends: int):
        self.bigrams, self.ends = bigrams, ends
        self.none, self.end = len(bigrams) - 2, len(bigrams) - 1
        rows, columns = bigrams.sum(1), bigrams.sum(0)
        share = lambda x: (x + ADD) / (x.sum() + ADD * len(x))
        self.forward = (bigrams + TRANSITION * share(columns)[None, :]) / (rows[:, None] + TRANSITION)
        self.backward = (bigrams + TRANSITION * share(rows)[:, None]) / (columns[None, :] + TRANSITION)
        self.size, self.below = np.maximum(columns, 1), tokens + ADD * (types + 1)

    def gains(self) -> np.ndarray:
        """What each class before and behind a word adds, for each class that the word could be in."""
        return np.log(np.concatenate([self.backward[:, : self.none], self.forward[: self.none].T]))

    def step(self, before: np.ndarray, own: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P of tokens by the class before, their own class and their training counts."""
        by_class = self.forward[before, own] * (count / self.size[own]) * (own != self.none)
        return np.log10((1 - BASE) * by_class + BASE * (count + ADD) / self.below)


def _beside(symbols: Symbols, core: np.ndarray, exponent: int, classes: int, first: bool):
    """What stands beside each word of a chunk. Labels come from answers or, in the first sweep, from the frequent words."""
    none, end, size = classes, classes + 1, classes + 2

    def beside(key, table, answers):
        c = _Chunk(table, exponent)
        label = c.answered(answers, "labels", none) if answers is not None else core[symbols.of(c.distinct)]
        s, of, place = c.sequence(label, end)
        pairs, n = np.unique(np.concatenate([of * (2 * size) + s[place - 1], of * (2 * size) + size + s[place + 1]]), return_counts=True)
        kinds = np.bincount(pairs // (2 * size), minlength=len(c.distinct))
        ids, at = (pairs % (2 * size)).astype(np.uint8), np.concatenate([[0], np.cumsum(kinds)])
        kinds = kinds.astype(np.uint8)
        return _table(_BESIDE, [(key[0].as_py(), b, c.packed(b, lo, hi), kinds[lo:hi].tobytes(), ids[at[lo] : at[hi]].tobytes(), B.squeeze(n[at[lo] : at[hi]])) for b, lo, hi in c.slices()])

    return (lambda key, table: beside(key, table, None)) if first else beside


def _choose(model: Model, symbols: Symbols, core: np.ndarray | None, exponent: int, with_counts: bool):
    """Buckets choose classes: by the highest gain, but for frequent words in the first sweep, which have theirs."""
    gains, none = model.gains(), model.none
    width = len(gains)

    def choose(key, table):
        b = key[0].as_py()
        asked = [B.unpack(x.as_py(), b << (64 - exponent)) for x in table["words"]]
        distinct, of = np.unique(np.concatenate(asked), return_inverse=True)
        entry, ids, counts, lo = [], [], [], 0
        for x, kinds, own, n in zip(asked, table["kinds"], table["ids"], table["counts"]):
            entry.append(np.repeat(of[lo : lo + len(x)], np.frombuffer(kinds.as_py(), np.uint8)).astype(np.int32))
            ids.append(np.frombuffer(own.as_py(), np.uint8))
            counts.append(B.expand(n.as_py()))
            lo += len(x)
        entry, ids, counts = (np.concatenate(x) for x in (entry, ids, counts))
        order = np.argsort(entry, kind="stable")
        entry, ids, counts = entry[order], ids[order], counts[order]
        label, total = np.full(len(distinct), none, np.uint8), np.zeros(len(distinct), np.int64)
        for lo in range(0, len(distinct), BLOCK):
            hi = min(len(distinct), lo + BLOCK)
            x, y = np.searchsorted(entry, [lo, hi])
            sums = np.bincount((entry[x:y] - lo).astype(np.int64) * width + ids[x:y], counts[x:y], (hi - lo) * width).reshape(-1, width)
            total[lo:hi] = sums[:, : width // 2].sum(1)
            some = total[lo:hi] > 0
            label[lo:hi][some] = np.argmax(np.round(sums[some] @ gains, 9), axis=1)
        if core is not None:
            s = symbols.of(distinct)
            label[s < symbols.other] = core[s[s < symbols.other]]
        kind, out, lo = "<u4" if total.max(initial=0) < 2**32 else "<u8", [], 0
        for chunk, x in zip(table["chunk"].to_pylist(), asked):
            own = of[lo : lo + len(x)]
            out.append((chunk, b, label[own].tobytes(), total[own].astype(kind).tobytes() if with_counts else None))
            lo += len(x)
        return _table(_ANSWER, out)

    return choose


def _recount(exponent: int, classes: int):
    def recount(key, table, answers):
        c = _Chunk(table, exponent)
        s, _, _ = c.sequence(c.answered(answers, "labels", classes), classes + 1)
        return _pairs(s, classes + 2)

    return recount


def _score(model: Model, exponent: int):
    names = ["n_tokens", "n_known", "logs", "score"]

    def score(key, table, answers):
        c = _Chunk(table, exponent)
        known, label = c.answered(answers, "counts", 0), c.answered(answers, "labels", model.none)
        ends = c.pointers[1:]
        own, count = np.insert(label[c.of], ends, model.end), np.insert(known[c.of], ends, model.ends)
        at = c.pointers[:-1] + np.arange(len(c.size))
        before = np.concatenate([[model.end], own[:-1]])  # an end stands before each text too
        step = model.step(before, own, count)
        total = [np.add.reduceat(x, at) if len(at) else x for x in ((count > 0).astype(np.int64), np.log10(count + ADD), step)]
        carried = pa.ipc.open_stream(table["carried"][0].as_py()).read_all()
        return pa.table([*carried.columns, pa.array(~c.learn), pa.array(c.size + 1, pa.int64()), *map(pa.array, total)], names=[*carried.column_names, "held", *names])

    return score


def _unfold(batches):
    for batch in batches:
        both = np.concatenate([np.zeros((2, 0), np.uint64), *(np.frombuffer(x.as_py(), "<u8").reshape(2, -1) for x in batch.column("top"))], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.uint64).view(np.int64)), pa.array(both[1].astype(np.int64))], ["h", "n"])


def _summed(pairs: DataFrame, size: int) -> np.ndarray:
    """A count matrix from rows (pair, n); its size is fixed."""
    out = np.zeros(size * size)
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def score(docs: DataFrame, held_out: int = 10, carry: list[str] | None = None, frequent: int = FREQUENT, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """The carried columns (``doc_id`` if None), ``held_out``, token counts, ``base_score``, ``score`` and ``perplexity``.

    Documents whose crc32(doc_id as text) modulo ``held_out`` is 0 are scored and not learned from.
    ``classes`` is 126 at most, ``sweeps`` 1 at least.
    """
    carry = ["doc_id"] if carry is None else carry
    ship(docs.sparkSession)
    inner = [f"c{i}" for i in range(len(carry))]
    held = crc_mod("doc_id", held_out) == 0
    text, size = F.col("text").cast("string"), text_bytes(docs)
    exponent = max(3, power_of_two(size / 24 / BUCKET))
    own = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], held.alias("held"), text.alias("text"))
    # the order of chunks stays known, so no pass below shuffles them again
    rows = cut_by(own.mapInArrow(_fold(inner), _ROW), "chunk", size // CHUNK // TOGETHER)
    plain = rows.drop("carried").groupBy("chunk")
    told = cut(plain.applyInArrow(_ask(exponent), _ASK).groupBy("bucket").applyInArrow(_count(exponent, frequent), _TOLD))
    n_words, kinds = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = docs.filter(~held).count()
    tokens, vocabulary = n_words + ends, kinds + (ends > 0)
    best = told.select("top").mapInArrow(_unfold, "h long, n long").orderBy(F.desc("n"), "h").limit(frequent).collect()
    symbols = Symbols(np.array([r["h"] for r in best], np.int64).view(np.uint64))
    between = _summed(plain.applyInArrow(_bigrams(symbols), "pair long, n long"), symbols.end + 1)
    core = exchange(between, classes + 2, alone=2)
    member = np.zeros((len(core), classes + 2))
    member[np.arange(len(core)), core] = 1.0
    model = Model(member.T @ between @ member, tokens, vocabulary, ends)
    beside = plain.applyInArrow(_beside(symbols, core, exponent, classes, True), _BESIDE)
    for k in range(sweeps):
        answers = cut(beside.groupBy("bucket").applyInArrow(_choose(model, symbols, None if k else core, exponent, k == sweeps - 1), _ANSWER))
        told = answers.groupBy("chunk")
        model = Model(_summed(plain.cogroup(told).applyInArrow(_recount(exponent, classes), "pair long, n long"), classes + 2), tokens, vocabulary, ends)
        beside = plain.cogroup(told).applyInArrow(_beside(symbols, core, exponent, classes, False), _BESIDE)
    names = {f.name: f.dataType for f in own.schema}
    schema = T.StructType([*(T.StructField(x, names[x]) for x in inner), T.StructField("held", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("logs", T.DoubleType()), T.StructField("score", T.DoubleType())])
    done = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(model, exponent), schema)
    below = math.log10(model.below)
    return done.select(
        *[F.col(x).alias(c) for c, x in zip(carry, inner)],
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
