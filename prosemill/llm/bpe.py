"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a partition's texts that the process has not met yet are laid
out, some megabytes of text at a time, as one array of symbols.
An index maps each adjacent pair that has a merge rank to all its positions;
ranks are applied in ascending order, each to all its positions at once, and
the lists of the pairs that a merge creates are extended. Merges of a trained
table only create pairs of a later rank, so one ascending sweep is what a
word-by-word encoder does.

The vocabulary file (its path is a parameter) is read on the driver and sent to
the executors: 49 thousand merges, whatever the input. Texts pass through one
narrow scan; nothing is shuffled.

Null, empty and blank texts have no tokens. Texts that hold the strings of special
tokens give their ids, as the tokenizer does. A very long text is split and
encoded by itself, its words in parts. Repeated rows each get their result. Extra
columns are carried or left out, whatever their names. Ranks are distinct, so no
two merges tie; of overlapping pairs the leftmost is taken. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.llm import blocks as B
from prosemill.session import ship

#: Text bytes whose new words are merged together, and words remembered between such steps.
STEP, REMEMBERED = 2 << 20, 300_000
#: White_Space of Unicode.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What the sweep needs of a tokenizer file with word-end symbols."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left, self.right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = (self.left << 20) | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, -1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (ids | self.special).items()}
        self.token = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.number = [str(i).encode() for i in range(max(names) + 1)]
        core = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _BLANK)
        self.pieces = regex.compile(core + "|\n")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.markers = [s.encode() for s in self.special]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of pairs; -1 without one."""
        key = (a << 20) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def normalized(text: str) -> str:
    """NFC, then each character lower-cased on its own (a final sigma has no special form)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def merge_all(v: Vocabulary, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words (their bytes in a row, ``ends`` of each) and where each word's ids end."""
    n = len(data)
    symbol = v.inner[data]
    symbol[ends - 1] = v.final[data[ends - 1]]
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends - 1] = -1
    before[np.concatenate([[0], ends[:-1]])] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        r = v.rank(symbol[at], symbol[following[at]])
        at, r = at[r >= 0], r[r >= 0]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            parts = zip(r[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts))
        else:
            parts = ((int(r[0]), at),)
        for rank, part in parts:
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(active, rank)

    note(np.flatnonzero(following >= 0))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        a, b, made = v.left[rank], v.right[rank], v.made[rank]
        at = at[(symbol[at] == a) & (following[at] >= 0)]
        to = following[at]
        fits = symbol[to] == b
        at, to = at[fits], to[fits]
        if a == b and len(at) > 1:  # of overlapping pairs, the first, third, ... from the left
            joined = np.concatenate([[False], to[:-1] == at[1:]])
            head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            fits = (np.arange(len(at)) - head) % 2 == 0
            at, to = at[fits], to[fits]
        if not len(at):
            continue
        after = following[to]
        symbol[at], symbol[to], following[at] = made, -1, after
        more = after >= 0
        before[after[more]] = at[more]
        prior = before[at]
        note(np.unique(np.concatenate([prior[prior >= 0], at[more]])))
    alive = symbol >= 0
    return symbol[alive], np.cumsum(alive)[ends - 1]


def distinct_words(part: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct word first stands, and each word's number among those.

    Words are grouped by their hash and then compared with the first of their group, eight bytes at a time.
    """
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    at, model = B.lanes(part), first[of]
    size = end - begin
    same = size == size[model]
    rows, done, raw = np.flatnonzero(same & (size <= B.LONG)), 0, part.tobytes()
    for i in np.flatnonzero(same & (size > B.LONG)).tolist():
        k = model[i]
        same[i] = i == k or raw[begin[i] : end[i]] == raw[begin[k] : end[k]]
    while len(rows):
        equal = (at[begin[rows] + done] ^ at[begin[model[rows]] + done]) & B.KEEP[np.minimum(size[rows] - done, 8)] == 0
        same[rows[~equal]] = False
        done += 8
        rows = rows[equal]
        rows = rows[size[rows] > done]
    if same.all():
        return first, of
    seen, first, of = {}, [], np.zeros(len(begin), np.int64)
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
        of[i] = k = seen.setdefault(raw[a:b], len(seen))
        if k == len(first):
            first.append(i)
    return np.array(first, np.int64), of


class Encoder:
    """Remembers words and the pieces that they are split into, with the text of their ids and tokens."""

    def __init__(self, v: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.remembered = v, remembered
        self.words: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.pieces: dict[str, tuple[int, bytes, bytes]] = {"": (0, b"", b"")}
        for text, i in v.special.items():
            self.pieces[f"\n{text}"] = (1, v.number[i], v.token[i])  # no piece of a text holds a line end

    def split(self, words: list[bytes]) -> list[list[str]]:
        """The pieces of each of some words without white space."""
        v, joined = self.v, b"\n".join(words)
        if not any(m in joined for m in v.markers):
            out: list[list[str]] = []
            own: list[str] = []
            for t in v.pieces.findall(normalized(joined.decode("utf-8", "replace"))):
                if t == "\n":
                    out.append(own)
                    own = []
                else:
                    own.append(t)
            out.append(own)
            return out
        parts = [v.split.split(w.decode("utf-8", "replace")) for w in words]
        return [[x for i, p in enumerate(ps) for x in ([f"\n{p}"] if i % 2 else v.pieces.findall(normalized(p)))] for ps in parts]

    def forget(self) -> None:
        """Starts anew once too much is remembered."""
        if len(self.words) > self.remembered:
            self.words.clear()
            self.pieces = {k: x for k, x in self.pieces.items() if k == "" or k[0] == "\n"}

    def learn(self, words: list[bytes]) -> None:
        """Encodes words that are not remembered yet."""
        v, pieces = self.v, self.pieces
        split = self.split(words) if words else []
        new = [p for p in dict.fromkeys(x for own in split for x in own) if p not in pieces]
        if new:
            raw = [p.encode() for p in new]
            ids, ends = merge_all(v, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(p) for p in raw]))
            ids, lo = ids.tolist(), 0
            for p, hi in zip(new, ends.tolist()):
                own = ids[lo:hi]
                lo = hi
                pieces[p] = (len(own), b" ".join([v.number[x] for x in own]), b" ".join([v.token[x] for x in own]))
        for k, own in zip(words, split):
            if len(own) == 1:
                self.words[k] = pieces[own[0]]
            else:
                of = [pieces[x] for x in own]
                self.words[k] = (sum(x[0] for x in of), b" ".join([x[1] for x in of]), b" ".join([x[2] for x in of]))


_encoders: dict[str, Encoder] = {}


def encoder_of(text: str) -> Encoder:
    """The encoder of a tokenizer file's text: one in a process, so that a worker's next partition finds the words that it has met."""
    if text not in _encoders:
        _encoders.clear()
        _encoders[text] = Encoder(Vocabulary(text))
    return _encoders[text]


def _run(spec, names: list[str], with_ids: bool):
    def run(batches):
        encoder = encoder_of(spec.value)
        for batch in batches:
            data, at = B.column(batch, "text")
            for lo, hi in B.slices(at, STEP):
                part, offsets = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                hashes, begin, end, pointers = B.located(part, offsets)
                first, of = distinct_words(part, begin, end, hashes)
                raw = part.tobytes()
                keys = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
                del raw
                encoder.forget()
                encoder.learn([k for k in keys if k not in encoder.words])
                known = [encoder.words[k] for k in keys]
                numbers, tokens = [x[1] for x in known], [x[2] for x in known]
                per_word = np.array([x[0] for x in known], np.int64)[of] if len(of) else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(per_word)])
                n, ids_digest, text_digest, ids_rows = [], [], [], []
                for i in range(hi - lo):
                    a, b = pointers[i], pointers[i + 1]
                    own = of[a:b]
                    own = own[per_word[a:b] > 0].tolist()
                    ids = b" ".join([numbers[x] for x in own])
                    n.append(int(total[b] - total[a]))
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    text_digest.append(hashlib.sha256(b" ".join([tokens[x] for x in own])).hexdigest())
                    if with_ids:
                        ids_rows.append(np.fromstring(ids.decode(), np.int32, sep=" ") if own else np.zeros(0, np.int32))
                columns = [*(batch.column(x).slice(lo, hi - lo) for x in names), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids_rows))))
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])
                B.trim()

    return run


def encode(docs: DataFrame, vocabulary: str, carry: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """The carried columns (``doc_id`` if None), ``n_tokens``, the digests of ids and of the decoded text, and ``ids``."""
    spark: SparkSession = docs.sparkSession
    ship(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    carry = ["doc_id"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(carry))]
    own = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, inner)], F.col("text").cast("string").alias("text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*(f for f in own.schema if f.name != "text"), *fields])
    done = own.mapInArrow(_run(spec, inner, with_ids), schema)
    return done.select(*[F.col(x).alias(c) for c, x in zip(carry, inner)], *[f.name for f in fields])


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: their tokens joined by spaces, as a tokenizer without a decoder gives them."""
    return b" ".join(v.token[i] for i in ids).decode()
