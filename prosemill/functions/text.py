"""Tokenizers, offsets and scalar text functions as Column expressions.

Everything works inside the row: no shuffle, no Python. Offsets are UTF-8 bytes.
Patterns are compiled Unicode-aware. Sums over the parts of a text are folds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = r"(?:#|- |\* |[0-9](?:[0-9]|[^\S\n])*[.)])"
LEAD = r"(?:#|- |\* |[0-9][0-9\s]*[.)])"
WORDY = r"\p{L}\p{N}_'\-"
EMOJI = "[\U0001f300-\U0001faff☀-➿]"


#: The sum (or greatest) up to each element of a short array of longs, itself included. The fold writes into a string,
#: which grows by plain copies of bytes; an array would be copied element by element.
_RUN = "transform(filter(aggregate({0}, named_struct('t', 0L, 's', ''), (a, x) -> named_struct('t', {1}, 's', concat(a.s, cast({1} AS string), ',')), a -> split(trim(TRAILING ',' FROM a.s), ',')), x -> x <> ''), x -> cast(x AS bigint))"
#: Elements of such a short array: longer ones are folded in blocks, so the work grows with their length alone.
RUN_BLOCK = 512


def add_running(df: DataFrame, arrays: dict[str, str], most: bool = False) -> DataFrame:
    """For each name the sum (``most``: the greatest) up to each element of an array of longs, itself included."""
    op = (lambda a, b: f"greatest({a}, {b})") if most else (lambda a, b: f"{a} + {b}")
    run = lambda x: _RUN.format(x, op("a.t", "x"))
    df = df.withColumns({f"_w_{n}": F.expr(x) for n, x in arrays.items()})
    df = df.withColumns({f"_k_{n}": F.expr(f"transform(sequence(0, greatest(size(`_w_{n}`) - 1, 0), {RUN_BLOCK}), b -> " + run(f"slice(`_w_{n}`, b + 1, {RUN_BLOCK})") + ")") for n in arrays})
    df = df.withColumns({f"_o_{n}": F.expr(run(f"transform(`_k_{n}`, b -> coalesce(get(b, size(b) - 1), 0L))")) for n in arrays})
    # named a second time outside the lambda: a column used once would be inlined and computed for every element
    df = df.withColumns({n: F.expr(f"if(size(`_o_{n}`) >= 0, flatten(transform(`_k_{n}`, (b, j) -> transform(b, x -> {op('x', f'coalesce(get(`_o_{n}`, j - 1), 0L)')}))), null)") for n in arrays})
    return df.drop(*[f"_{x}_{n}" for n in arrays for x in "wko"])


def add_hops(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``hops``, the strides by which ``last_before`` finds a place among the parts of a text: halves of its length."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    return pin(df.withColumn("hops", F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda p: p <= size + 1)), "hops")


def last_before(starts: str, at: Column) -> Column:
    """The index of the last of some ascending longs that is ``at`` at most, -1 without one: a binary search by ``hops``."""
    return F.aggregate("hops", F.lit(-1), lambda i, p: F.when(F.get(starts, i + p) <= at, i + p).otherwise(i))


def bytes_of(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def add_parts(df: DataFrame, name: str, pieces: Column) -> DataFrame:
    """Adds ``name``, an array of (at, s): the pieces of a text in a row with the byte where each begins."""
    df = add_running(df.withColumn("_pieces", pieces), {"_ends": "transform(_pieces, s -> cast(octet_length(s) AS bigint))"})
    parts = F.when(F.size("_ends") >= 0, F.transform("_pieces", lambda s, i: F.struct((F.get("_ends", i) - bytes_of(s)).alias("at"), s.alias("s"))))
    return df.withColumn(name, parts).drop("_pieces", "_ends")


def pin(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with some columns computed here and now: a generator of one row, into which no later expression is inlined."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.explode_outer(F.array(F.struct(*names))).alias("_pinned")).select(*rest, *[F.col(f"_pinned.{n}").alias(n) for n in names])


def add_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sents``: (i, at, s) with trimmed texts and the untrimmed starts."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), rf"(?U)(?<=[.!?])(?=\s)|(?<=\n)(?=\s*\n|\s*\z|\s*{MARK})")
    # a piece led by a marker ends at its line; what follows is judged again
    lines = F.flatten(F.transform(split, lambda p: F.when(p.rlike(rf"(?sU)^\s*{LEAD}[^\n]*\n."), F.regexp_extract_all(p, F.lit(rf"(?sU)\G(?:\s*{LEAD}[^\n]*\n(?=.)|.+)"), 0)).otherwise(F.array(p))))
    df = add_parts(df, "sents", lines)
    kept = F.filter(F.transform("sents", lambda x: F.struct(x["at"].alias("at"), trim(x["s"]).alias("s"))), lambda x: x["s"] != "")
    df = df.withColumn("sents", kept)
    return df.withColumn("sents", F.transform("sents", lambda x, i: F.struct(i.alias("i"), x["at"].alias("at"), x["s"].alias("s"))))


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n\n", -1)


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", ""), r"\r?\n", -1)


def blank_paragraphs(text: Column) -> Column:
    """Runs of lines between lines of white space alone."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)(?:\A|(?<=\n))[^\S\n]*(?:\n|\z)", -1), lambda p: p.rlike(r"(?U)\S"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def word_count(text: Column) -> Column:
    """White-space tokens with a letter."""
    return F.size(F.filter(tokens(text), lambda w: w.rlike(r"\p{L}")))


def naive_sentences(text: Column) -> Column:
    """Pieces between sentence marks with three words or more (calibration)."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]"), token_count), lambda n: n >= 3)


def normalized(sentence: Column) -> Column:
    """Letters and digits, A-Z lower-cased, white space as single spaces."""
    bare = F.regexp_replace(F.regexp_replace(sentence, r"(?U)[^\p{L}\p{N}\s]", ""), r"(?U)\s+", " ")
    return F.trim(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def numbered(line: Column) -> Column:
    return line.rlike(r"^[0-9][0-9\s]*[.)]")


def title_case(heading: Column) -> Column:
    """Two words or more, two of them with a capital first letter alone."""
    words = tokens(heading)
    return (F.size(words) >= 2) & (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}[^\p{Lu}]*$"))) >= 2)


def prefix(text: Column, at: Column) -> Column:
    """The text before a byte offset."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), at.cast("int")), "UTF-8")


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a byte offset."""
    return F.size(F.split(prefix(text, at), "\n", -1))


def column_of(text: Column, at: Column) -> Column:
    """1-based column, in characters."""
    return F.length(F.substring_index(prefix(text, at), "\n", -1)) + 1


def utf16_column_of(text: Column, at: Column) -> Column:
    """0-based column, in UTF-16 units."""
    return (F.octet_length(F.encode(F.substring_index(prefix(text, at), "\n", -1), "UTF-16BE")) / 2).cast("int")


def density(n: Column, words: Column) -> Column:
    """Findings per 100 words; their number where there are no words."""
    return F.when(words == 0, n.cast("double")).otherwise(n * 100.0 / words)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def kebab(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical_stem(stem: Column) -> Column:
    """A file stem without version words: cut at the last of each in turn, without a trailing (n), lower-case and hyphenated."""
    s = F.translate(stem, "-_", "  ")
    for word in (" copy", " backup", " old", " new", " final", " final final", " final2", " draft"):
        s = F.regexp_replace(s, f"(?s)^(.*){word}.*$", "$1")
    return F.replace(F.lower(F.trim(F.regexp_replace(s, r"\s*\(\d+\)$", ""))), F.lit(" "), F.lit("-"))


def phrase_pattern(phrases) -> str:
    """One alternation, shorter phrases first, as an automaton that reports the earliest end does. ASCII case-insensitive."""
    return "(?i)" + "|".join(re.sub(r"([\\.+*?^$()|\[\]{}])", r"\\\1", p) for p in sorted(dict.fromkeys(phrases), key=lambda p: (len(p), p)))


def add_spans(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """For each name an array of (at, to, m, before, after): every match with its bytes and neighbours."""
    c = F.coalesce(F.col(text), F.lit(""))
    hit = {n: c.rlike(p) for n, p in patterns.items()}
    df = df.withColumns({f"_b_{n}": F.when(hit[n], F.split(c, p, -1)).otherwise(F.array(F.lit(""))) for n, p in patterns.items()} | {f"_m_{n}": F.when(hit[n], F.regexp_extract_all(c, F.lit(p), 0)).otherwise(F.array().cast("array<string>")) for n, p in patterns.items()})
    df = add_running(df, {f"_at_{n}": _STEPS.format(n) for n in patterns})
    df = df.withColumns({n: F.expr(_SPANS.format(n)) for n in patterns})
    return df.drop(*[f"_{x}_{n}" for n in patterns for x in ("b", "m", "at")])


# As text, these reach the parser in one call each: a configuration can hold a hundred patterns.
#: From each match to the next: the match before it and the text between.
_STEPS = "transform(`_m_{0}`, (m, k) -> cast(octet_length(get(`_b_{0}`, k)) AS bigint) + coalesce(cast(octet_length(get(`_m_{0}`, k - 1)) AS bigint), 0L))"
_SPANS = "transform(`_m_{0}`, (m, k) -> named_struct('at', get(`_at_{0}`, k), 'to', get(`_at_{0}`, k) + cast(octet_length(m) AS bigint), 'm', m, 'before', concat(coalesce(get(`_m_{0}`, k - 1), ''), get(`_b_{0}`, k)), 'after', concat(get(`_b_{0}`, k + 1), coalesce(get(`_m_{0}`, k + 1), ''))))"


def bounded(span: Column) -> Column:
    """Whether no word goes on at either side; a plain suffix may follow, in either case as phrases are (ASCII)."""
    return ~span["before"].rlike(rf"[{WORDY}]\z") & span["after"].rlike(rf"^(?i:s|es|ed|ing|ly|d)?(?![{WORDY}])")


def first_bounded(text: Column, term: str) -> Column:
    """1-based place of the first whole-word occurrence of a term, 0 without one."""
    return F.regexp_instr(text, F.lit(rf"(?<![{WORDY}])" + phrase_pattern([term])[4:] + rf"(?=(?:s|es|ed|ing|ly|d)?(?![{WORDY}]))"))


def snippet(text: Column, at: Column, to: Column) -> Column:
    """The text between two byte offsets, trimmed."""
    return trim(F.decode(F.substring(F.encode(text, "UTF-8"), (at + 1).cast("int"), (to - at).cast("int")), "UTF-8"))


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.regexp_replace(c, r"(?s)^.", ""))


def yaml_quoted(c: Column) -> Column:
    """A double-quoted YAML scalar."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def heading_slugs(headings: DataFrame) -> DataFrame:
    """(doc_id, at, slug): kebab-case titles; a slug that a document has had gets -1, -2, ..."""
    own = headings.withColumn("base", kebab(F.col("title")))
    k = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("at")) - 1
    return own.withColumn("k", k).select("doc_id", "at", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))).alias("slug"))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based, held within the text."""
    own = lines(text)
    lo = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(own, lo.cast("int"), F.greatest(F.least(end, F.size(own)) - lo + 1, F.lit(0)).cast("int")), "\n")


def contains_text(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns holds the needle, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False))
    return df.filter(hit)
