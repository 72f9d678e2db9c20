"""Prose operators over ``documents``.

The corpus holds few phrases of the default lexicons, and lexicons are
configuration, so some queries pass lexicons and limits that fit its words.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill import config as C
from prosemill.functions import text as X
from prosemill.functions.masks import add_masks
from prosemill.operators.prose import findings
from prosemill.plans import lint as L
from prosemill.plans.catalog import query, table
from prosemill.session import spread

#: Sentences in DuckDB: marks instead of look-arounds, then marker-led pieces cut at their lines. (doc_id, i, s)
SENTENCES = r"""
p0 AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), '\n(\s*\n|\s*$|\s*(?:#|- |\* |[0-9](?:[0-9]|[^\S\n])*[.)]))', chr(10) || chr(1) || '\1', 'g') AS t FROM documents),
p1 AS (SELECT doc_id, u.i AS k, u.p AS p FROM (SELECT doc_id, unnest(list_transform(string_split(t, chr(1)), lambda x, j: {'p': x, 'i': j})) AS u FROM p0)),
rec AS (
  WITH RECURSIVE r(doc_id, k, j, piece, rest) AS (
    SELECT doc_id, k, 0, CAST(NULL AS VARCHAR), p FROM p1
    UNION ALL
    SELECT doc_id, k, j + 1,
      CASE WHEN regexp_matches(rest, '^\s*(?:#|- |\* |[0-9][0-9\s]*[.)])[^\n]*\n[\s\S]') THEN regexp_extract(rest, '^(\s*(?:#|- |\* |[0-9][0-9\s]*[.)])[^\n]*\n)', 1) ELSE rest END,
      CASE WHEN regexp_matches(rest, '^\s*(?:#|- |\* |[0-9][0-9\s]*[.)])[^\n]*\n[\s\S]') THEN regexp_replace(rest, '^\s*(?:#|- |\* |[0-9][0-9\s]*[.)])[^\n]*\n', '') ELSE NULL END
    FROM r WHERE rest IS NOT NULL)
  SELECT doc_id, k, j, regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '') AS s FROM r WHERE piece IS NOT NULL),
sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INTEGER) AS i, s FROM rec WHERE s <> '')
"""
WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"
NORMAL = r"trim(translate(regexp_replace(regexp_replace({0}, '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tuned() -> C.Config:
    """Lexicons and limits that fit the corpus."""
    rules = replace(C.DEFAULT_RULES, broad_terms=("there", "that"), confidence=("was",), calls_to_action=("are",), cadence_starts=("the", "of", "de", "die"), cadence_limit=1, required_patterns=("the",), forbidden_patterns=(r"\d{3}",), min_code_blocks=1)
    return C.Config(buzzwords=("with", "this"), transitions=("for",), puffery=("from",), weasel=("that",), marketing=("and",), templates=(r"\bto the\b", "^de"), em_dashes=0, uniform_below=0.9, passive_above=0.02, rules=rules)


@query(f"WITH {SENTENCES} SELECT doc_id, i, s AS sentence FROM sent")
def sentences(spark, sf_dir):
    df = X.pin(X.add_sentences(docs(spark, sf_dir)), "sents")
    return df.select("doc_id", F.explode("sents").alias("x")).select("doc_id", "x.i", F.col("x.s").alias("sentence"))


@query("SELECT doc_id, u.i AS i, u.p AS paragraph FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x, j: {'i': CAST(j - 1 AS INTEGER), 'p': x})) AS u FROM documents)")
def paragraphs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("i", "paragraph"))


@query(r"WITH l AS (SELECT doc_id, unnest(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '\r?\n$', ''), '\r?\n'), lambda x, j: {'i': j, 'p': x})) AS u FROM documents) SELECT doc_id, CAST(u.i AS INTEGER) AS line, u.p AS text, CAST(sum(strlen(u.p) + 1) OVER (PARTITION BY doc_id ORDER BY u.i) - strlen(u.p) - 1 AS BIGINT) AS start_byte FROM l")
def line_offsets(spark, sf_dir):
    df = docs(spark, sf_dir).withColumn("l", X.lines(F.col("text")))
    df = X.add_running(df, {"ends": "transform(l, s -> cast(octet_length(s) + 1 AS bigint))"})
    out = df.select("doc_id", "ends", F.posexplode("l").alias("i", "t"))
    return out.select("doc_id", (F.col("i") + 1).alias("line"), F.col("t").alias("text"), (F.get("ends", "i") - F.octet_length("t") - 1).cast("long").alias("start_byte"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: regexp_matches(w, '\p{L}'))) AS BIGINT) AS words, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM documents")
def word_counts(spark, sf_dir):
    c = F.col("text")
    return docs(spark, sf_dir).select("doc_id", X.word_count(c).cast("long").alias("words"), X.token_count(c).cast("long").alias("tokens"))


@query(r"WITH s AS (SELECT doc_id, len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[.!?]')) AS x FROM documents)) SELECT doc_id, count(*) AS sentences, sum(n)::BIGINT AS words FROM s WHERE n >= 3 GROUP BY doc_id")
def naive_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(X.naive_sentences(F.col("text"))).alias("n")).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("n").cast("long").alias("words"))


@query(f"WITH {SENTENCES}, w AS (SELECT doc_id, {WORDS.format('s')} AS n FROM sent) SELECT doc_id, count(*) AS n, CAST(max(n) AS INTEGER) AS longest FROM w WHERE n > 28 GROUP BY doc_id")
def long_sentences(spark, sf_dir):
    found = findings(docs(spark, sf_dir), detectors=["D9"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.regexp_extract("message", r"^(\d+)", 1).cast("int")).alias("longest"))


def _tuned(spark, sf_dir, *detectors: str, cfg: C.Config | None = None) -> DataFrame:
    return findings(docs(spark, sf_dir), cfg or tuned(), list(detectors))


def _phrase_sql(word: str, category: str, severity: str) -> str:
    # separators are doubled, so neighbouring hits do not share one
    edge = r"[^\p{L}\p{N}_''-]"
    return rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '({edge})', '\1\1', 'g') AS t FROM documents),
h AS (SELECT doc_id, len(regexp_extract_all(t, '(?i)(?:^|{edge}){word}(?:s|es|ed|ing|ly|d)?(?:{edge}|$)')) AS n FROM t)
SELECT doc_id, '{category}' AS category, '{severity}' AS severity, CAST(n AS BIGINT) AS n FROM h WHERE n > 0"""


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "category", "severity").agg(F.count("*").alias("n"))


@query(_phrase_sql("from", "puffery", "error"))
def puffery(spark, sf_dir):
    return _by_document(_tuned(spark, sf_dir, "D1"))


@query(_phrase_sql("and", "marketing", "error"))
def marketing(spark, sf_dir):
    return _by_document(_tuned(spark, sf_dir, "D5"))


@query(_phrase_sql("are", "call-to-action", "warning"))
def call_to_action(spark, sf_dir):
    return _by_document(_tuned(spark, sf_dir, "D23"))


def _sentence_phrase_sql(words: str, drop: str, category: str, severity: str) -> str:
    edge = r"[^\p{L}\p{N}_''-]"
    return rf"""WITH {SENTENCES}, t AS (SELECT doc_id, i, s, regexp_replace(s, '({edge})', '\1\1', 'g') AS t FROM sent),
h AS (SELECT doc_id, s, len(regexp_extract_all(t, '(?i)(?:^|{edge})(?:{words})(?:s|es|ed|ing|ly|d)?(?:{edge}|$)')) AS n FROM t)
SELECT doc_id, '{category}' AS category, {severity} AS severity, CAST(sum(n) AS BIGINT) AS n FROM h WHERE n > 0 AND NOT ({drop}) GROUP BY ALL"""


_CITED = r"regexp_matches(s, '(?i)\[[0-9]{1,3}\]|\[[^\]]+\]\([^)]+\)|\([A-Z][A-Za-z]+(?:\s+et\s+al\.)?,?\s+\d{4}\)|\bdoi:\S+')"
_SPECIFIC = r"regexp_matches(s, '\bv\d+(?:\.\d+)*\b|\b\d+\.\d+(?:\.\d+)+\b|#\d{2,}\b|\b[A-Z]{2,}-\d+\b|\b[a-z]{2,}[A-Z][A-Za-z0-9]{2,}\b|\b[a-z]{2,}_[a-z0-9_]{2,}\b|\b[A-Z]{2}[A-Z0-9_]{2,}\b|/[\w./-]+|(?i:\b(?:Figure|Fig|Table|Tbl|Listing|Example|Appendix)\s+\d+)|(?i:\b(?:RFC|ISO|IEEE)\s*\d+)|\bport\s+\d{2,5}\b|\$[A-Z][A-Z0-9_]+|\b[a-zA-Z_]\w*\(\)|\b\w+::\w+|\b\d+\s*(?i:ms|sec|min|hours?|KB|MB|GB|TB|bytes?)\b|\b\d{2,}%\s+of\b')"


@query(_sentence_phrase_sql("that", _CITED, "weasel", "'warning'"))
def weasel(spark, sf_dir):
    return _by_document(_tuned(spark, sf_dir, "D2"))


@query(_sentence_phrase_sql("with|this", f"n = 1 AND {_SPECIFIC}", "buzzword", "CASE WHEN n > 1 THEN 'warning' ELSE 'hint' END"))
def buzzwords(spark, sf_dir):
    return _by_document(_tuned(spark, sf_dir, "D3"))


@query(_sentence_phrase_sql("for", f"n = 1 AND {_SPECIFIC}", "transition", "CASE WHEN n > 1 THEN 'warning' ELSE 'hint' END"))
def transitions(spark, sf_dir):
    return _by_document(_tuned(spark, sf_dir, "D4"))


@query(_sentence_phrase_sql("was", _CITED, "confidence", "'warning'"))
def confidence_phrases(spark, sf_dir):
    return _by_document(_tuned(spark, sf_dir, "D24a"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\bto the\b')) + CASE WHEN regexp_matches(text, '(?i)^de') THEN 1 ELSE 0 END AS BIGINT) AS n FROM documents WHERE (regexp_matches(text, '(?i)\bto the\b') OR regexp_matches(text, '(?i)^de'))")
def templates(spark, sf_dir):
    return _tuned(spark, sf_dir, "D6").groupBy("doc_id").agg(F.count("*").alias("n"))


_CONNECTED = " + ".join(f"(length(lower(s)) - length(replace(lower(s), '{t}', ''))) // {len(t)}" for t in C.CONNECTORS)


@query(f"WITH {SENTENCES.replace("coalesce(text, '')", "replace(replace(coalesce(text, ''), ' the ', ' thus '), ' and ', ' therefore ')")} SELECT doc_id, count(*) AS n FROM sent WHERE ({_CONNECTED}) > 1 GROUP BY doc_id")
def connectors(spark, sf_dir):
    """Common words stand in for connectors, of which the corpus has none."""
    d = docs(spark, sf_dir).withColumn("text", F.replace(F.replace("text", F.lit(" the "), F.lit(" thus ")), F.lit(" and "), F.lit(" therefore ")))
    return findings(d, tuned(), ["D8"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"""WITH {SENTENCES}, n AS (SELECT doc_id, i, {NORMAL.replace("{0}", "s")} AS t FROM sent),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS k FROM n WHERE strlen(t) >= 12) SELECT doc_id, count(*) AS n FROM r WHERE k > 1 GROUP BY doc_id""")
def repetition(spark, sf_dir):
    return _tuned(spark, sf_dir, "D14").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"""WITH {SENTENCES}, f AS (SELECT doc_id, i, CASE WHEN regexp_matches(s, '^[#*-]') THEN NULL ELSE lower(regexp_replace(regexp_replace(regexp_extract(s, '^\s*(\S+)', 1), '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')) END AS w FROM sent),
g AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f) SELECT doc_id, count(*) AS n FROM g WHERE w = p AND w IN ('the', 'of', 'de', 'die') GROUP BY doc_id""")
def cadence(spark, sf_dir):
    return _tuned(spark, sf_dir, "D12").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"WITH p AS (SELECT doc_id, length(p) - length(replace(p, '!', '')) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) AS p FROM documents)) SELECT doc_id, count(*) AS paragraphs FROM p WHERE n > 1 GROUP BY doc_id")
def exclamations(spark, sf_dir):
    return _tuned(spark, sf_dir, "D15").groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(?:[\p{{L}}\p{{N}}_-]+),\s+[\p{{L}}\p{{N}}_-]+,\s+(?:and|&)\s+[\p{{L}}\p{{N}}_-]+')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '(?i)(?:[\p{{L}}\p{{N}}_-]+),\s+[\p{{L}}\p{{N}}_-]+,\s+(?:and|&)\s+[\p{{L}}\p{{N}}_-]+')")
def rule_of_three(spark, sf_dir):
    return _tuned(spark, sf_dir, "D16").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"WITH p AS (SELECT doc_id, len(regexp_extract_all(p, '(?s)\*\*[^*]+\*\*|__[^_]+__')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents)) SELECT doc_id, count(*) AS paragraphs FROM p WHERE n > 3 GROUP BY doc_id")
def bold_spans(spark, sf_dir):
    return _tuned(spark, sf_dir, "D18").groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query(rf"""WITH {SENTENCES}, n AS (SELECT doc_id, {WORDS.format('s')} AS n FROM sent WHERE NOT starts_with(s, '#')), a AS (SELECT doc_id, count(*) AS c FROM sent GROUP BY doc_id)
SELECT doc_id FROM n JOIN a USING (doc_id) WHERE n >= 3 AND c >= 5 GROUP BY doc_id HAVING count(*) >= 8 AND stddev_pop(n) / avg(n) < 0.9""")
def uniform_lengths(spark, sf_dir):
    return _tuned(spark, sf_dir, "D31").select("doc_id")


_EDGE = r"[^\p{L}\p{N}_]"
_PASSIVE = rf"(?i)(?:^|{_EDGE})(?:is|are|was|were|be|been|being)\s+(?:[\p{{L}}\p{{N}}_]+ed|[\p{{L}}\p{{N}}_]+en|made|done|said|seen|known|shown|built|sent|left|found|told|thought|used|called|considered|designed|intended)(?:{_EDGE}|$)"


@query(rf"WITH {SENTENCES} SELECT doc_id FROM sent GROUP BY doc_id HAVING count(*) >= 6 AND count(*) FILTER (regexp_matches(s, '{_PASSIVE}')) > 0.02 * count(*)")
def passive_density(spark, sf_dir):
    return _tuned(spark, sf_dir, "D32").select("doc_id")


@query(rf"""WITH {SENTENCES}, t AS (SELECT doc_id, list_filter(string_split_regex(s, '\s+'), lambda w: w <> '') AS w FROM sent WHERE NOT regexp_matches(s, '^[#*-]')),
o AS (SELECT doc_id, lower(w[1] || ' ' || w[2]) AS o FROM t WHERE len(w) >= 2), c AS (SELECT doc_id, o, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM o GROUP BY doc_id, o)
SELECT doc_id, arg_min(o, (-n, o)) AS opening FROM c WHERE n >= 4 AND n > 0.4 * total GROUP BY doc_id""")
def repeated_openings(spark, sf_dir):
    return _tuned(spark, sf_dir, "D33").select("doc_id", F.regexp_replace("message", "^opening: ", "").alias("opening"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b\d{{2,}}%')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '\b\d{{2,}}%')")
def percent_claims(spark, sf_dir):
    return _tuned(spark, sf_dir, "D24b").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"WITH {SENTENCES} SELECT doc_id, count(*) AS n FROM sent WHERE NOT starts_with(s, '#') AND NOT {_SPECIFIC} AND regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_''-])(?:there|that)(?:s|es|ed|ing|ly|d)?(?:[^\p{{L}}\p{{N}}_''-]|$)') GROUP BY doc_id")
def broad_terms(spark, sf_dir):
    return _tuned(spark, sf_dir, "D13").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE WHEN NOT regexp_matches(text, 'the') THEN 1 ELSE 0 END AS missing, CAST(len(regexp_extract_all(text, '[0-9]{{3}}')) AS BIGINT) AS forbidden FROM documents WHERE (NOT regexp_matches(text, 'the') OR regexp_matches(text, '[0-9]{{3}}'))")
def required_and_forbidden(spark, sf_dir):
    found = _tuned(spark, sf_dir, "D28", "D29")
    return found.groupBy("doc_id").agg(F.count(F.when(F.col("detector") == "D28", 1)).cast("int").alias("missing"), F.count(F.when(F.col("detector") == "D29", 1)).alias("forbidden"))


@query(f"SELECT doc_id, 1 AS missing FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*```'))) < 1")
def min_code_blocks(spark, sf_dir):
    return _tuned(spark, sf_dir, "D27").select("doc_id", F.lit(1).alias("missing"))


@query(rf"""WITH {SENTENCES}, w AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {WORDS.format('s')} AS n FROM sent) WHERE n > 28 GROUP BY doc_id),
d AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: regexp_matches(x, '\p{{L}}'))) AS words, coalesce(n, 0) AS n FROM documents LEFT JOIN w USING (doc_id))
SELECT doc_id, CAST(words AS BIGINT) AS word_count, CAST(n AS BIGINT) AS n_findings, round(CASE WHEN words = 0 THEN n ELSE n * 100.0::DOUBLE / words END, 6) AS density FROM d""")
def density_report(spark, sf_dir):
    own = docs(spark, sf_dir)
    return L.document_reports(own, _tuned(spark, sf_dir, "D9")).select("doc_id", "word_count", "n_findings", "density")


@query(rf"WITH {SENTENCES}, w AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {WORDS.format('s')} AS n FROM sent) WHERE n > 28 GROUP BY doc_id) SELECT doc_id, n AS n_findings FROM w ORDER BY n DESC, doc_id LIMIT 8")
def most_findings(spark, sf_dir):
    own = docs(spark, sf_dir)
    return L.ranked_files(L.document_reports(own, _tuned(spark, sf_dir, "D9"))).select("doc_id", "n_findings")


_MD = r"""'# ' || source || chr(10) || chr(10) || text || chr(10) || chr(10) || '## ' || lang || '?' || chr(10) || '```' || chr(10) || 'with this' || chr(10) || '```' || chr(10) || '- **a** b' || chr(10) || '- **c** d' || chr(10) || '- **e** f' || chr(10) || '- g' || chr(10)"""


def markdown(spark, sf_dir) -> DataFrame:
    """Documents with headings, a fence and a list about them."""
    d = table(spark, sf_dir, "documents")
    parts = F.concat(F.lit("# "), "source", F.lit("\n\n"), "text", F.lit("\n\n## "), "lang", F.lit("?\n```\nwith this\n```\n- **a** b\n- **c** d\n- **e** f\n- g\n"))
    return d.select("doc_id", parts.alias("text"))


@query(f"SELECT doc_id, CAST(strlen(t) - strlen(regexp_extract(t, '```\\nwith this\\n```\\n[\\s\\S]*$')) AS BIGINT) AS fence_at, CAST(18 AS BIGINT) AS fence_bytes FROM (SELECT doc_id, {_MD} AS t, text FROM documents)")
def fence_masks(spark, sf_dir):
    d = markdown(spark, sf_dir)
    m = add_masks(d).select("doc_id", F.explode("masks").alias("m"), "text").filter(F.substring(F.encode("text", "UTF-8"), (F.col("m.at") + 1).cast("int"), F.lit(3)) == F.lit(b"```"))
    return m.select("doc_id", F.col("m.at").alias("fence_at"), (F.col("m.to") - F.col("m.at")).alias("fence_bytes"))


@query("SELECT doc_id, 1 AS rhetorical, 1 AS bold_lists FROM documents WHERE text IS NOT NULL")
def markdown_structure(spark, sf_dir):
    found = findings(markdown(spark, sf_dir), detectors=["D19b", "D22"])
    return found.groupBy("doc_id").agg(F.max(F.when(F.col("detector") == "D19b", 1)).alias("rhetorical"), F.max(F.when(F.col("detector") == "D22", 1)).alias("bold_lists"))


@query("SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'first' WHEN lang = 'de' THEN 'german' ELSE 'default' END AS profile FROM documents")
def profile_routing(spark, sf_dir):
    cfg = C.Config(profiles=(C.Profile("first", ("src1*/**",)), C.Profile("german", ("**/de/*.md",))))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    return L.routed(d, cfg).select("doc_id", "profile")


@query(rf"""WITH s AS (SELECT len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) AS n FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[.!?]')) AS x FROM documents)) SELECT round(avg(n), 4) AS avg_sentence_length FROM s WHERE n >= 3""")
def calibration_sentences(spark, sf_dir):
    return L.calibration(docs(spark, sf_dir), _tuned(spark, sf_dir, "D1"))["sentences"].select(F.round("avg_sentence_length", 4).alias("avg_sentence_length"))


@query()
def lint_report(spark, sf_dir):
    """All detectors at default configuration, one report row for each document."""
    own = docs(spark, sf_dir)
    return L.document_reports(own, findings(own))


@query()
def lint_findings(spark, sf_dir):
    """All detectors with the tuned configuration, one row for each finding."""
    return findings(docs(spark, sf_dir), tuned())


@query("SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents")
def text_scalars(spark, sf_dir):
    c = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.octet_length(c).cast("long").alias("bytes"), F.length(c).cast("long").alias("chars"), X.kebab(c).alias("slug"))


# Derived corpora: what the raw text lacks is written around or into it, the same way on both sides.
def _derived(spark, sf_dir, text, *detectors: str, cfg: C.Config | None = None) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return findings(d, cfg or C.Config(), list(detectors))




@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS paragraphs FROM (SELECT doc_id, unnest(string_split(replace(text, ', ', ' — '), chr(10) || chr(10))) AS p FROM documents) WHERE length(p) - length(replace(p, '—', '')) > 1 GROUP BY doc_id")
def em_dashes(spark, sf_dir):
    return _derived(spark, sf_dir, F.replace(F.col("text"), F.lit(", "), F.lit(" — ")), "D17").groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query(f"SELECT doc_id, 'from ' || lang || ' to ' || source || ' to ' || doc_id AS snippet FROM documents")
def exaggerated_ranges(spark, sf_dir):
    """One range written before each document, whose own are disarmed in any case: the detector finds those too."""
    text = F.concat(F.lit("We go from "), "lang", F.lit(" to "), "source", F.lit(" to "), "doc_id", F.lit(".\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)from", "for"))
    return _derived(spark, sf_dir, text, "D7").select("doc_id", "snippet")


@query(f"SELECT doc_id, 'Why?' AS snippet FROM documents WHERE NOT regexp_matches(text, '^\\s*$')")
def question_leads(spark, sf_dir):
    return _derived(spark, sf_dir, F.concat(F.lit("Why? How? "), F.col("text")), "D10").select("doc_id", "snippet")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(replace(text, ', ', '? '), '\\?\\s+[a-z]')) AS BIGINT) AS n FROM documents WHERE regexp_matches(replace(text, ', ', '? '), '\\?\\s+[a-z]')")
def mid_sentence_questions(spark, sf_dir):
    return _derived(spark, sf_dir, F.replace(F.col("text"), F.lit(", "), F.lit("? ")), "D11").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(length(t) - length(regexp_replace(t, '[“”‘’]', '', 'g')) AS BIGINT) AS n FROM (SELECT doc_id, replace(text, ' the ', ' “the” ') AS t FROM documents) WHERE regexp_matches(t, '[“”‘’]')")
def curly_quotes(spark, sf_dir):
    return _derived(spark, sf_dir, F.replace(F.col("text"), F.lit(" the "), F.lit(" “the” ")), "D30").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS items FROM documents WHERE len(string_split(text, chr(10))) > 7")
def long_lists(spark, sf_dir):
    found = _derived(spark, sf_dir, F.concat(F.lit("- "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n- "))), "D20")
    return found.select("doc_id", F.regexp_extract("message", r"^(\d+)", 1).cast("int").alias("items"))


@query(f"SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents")
def emoji_bullets(spark, sf_dir):
    found = _derived(spark, sf_dir, F.concat(F.lit("- ✅ "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n- ✅ "))), "D21")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT d AS detector, count(*) AS n FROM documents, (SELECT unnest(['D19a', 'D19b', 'D19c', 'D19e', 'D19f', 'D19g', 'D19h', 'D26']) AS d) GROUP BY d")
def heading_rules(spark, sf_dir):
    """Every rule on headings, on documents between headings that break each of them."""
    head = "#### deep one\n\n# Why so?\n\n# \U0001f680 go\n\n# Two Capital Words\n\n# misc\n\n# summary\n\n# conclusion\n\n"
    rules = replace(C.DEFAULT_RULES, max_headings=3, required_headings=("goal",), banned_headings=("^misc$",))
    d = docs(spark, sf_dir).select("doc_id", F.concat(F.lit(head), F.coalesce("text", F.lit(""))).alias("text"))
    found = findings(d, C.Config(rules=rules), ["D19a", "D19b", "D19c", "D19e", "D19f", "D19g", "D19h", "D26"])
    return found.groupBy("detector").agg(F.count("*").alias("n"))


@query(f"WITH {SENTENCES}, f AS (SELECT doc_id, count(*) FILTER (NOT regexp_matches(s, '^(?:#|[-*+]\\s|[0-9][0-9\\s]*[.)]\\s)')) AS n FROM sent GROUP BY doc_id) SELECT doc_id, 1::BIGINT AS thin FROM documents LEFT JOIN f USING (doc_id) WHERE coalesce(n, 0) < 20")
def thin_sections(spark, sf_dir):
    """Sections of fewer than 20 sentences, of documents below one heading."""
    d = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# head\n"), F.coalesce("text", F.lit(""))).alias("text"))
    found = findings(d, C.Config(rules=replace(C.DEFAULT_RULES, min_section_sentences=20)), ["D25"])
    return found.groupBy("doc_id").agg(F.count("*").alias("thin"))


@query(f"SELECT doc_id, CAST(strlen('<!-- x:off -->' || source || '<!-- x:on -->') AS BIGINT) AS off_bytes, CAST(strlen('https://a.b/' || source) AS BIGINT) AS url_bytes, CAST(strlen(source) + 2 AS BIGINT) AS code_bytes FROM documents")
def off_url_and_code_masks(spark, sf_dir):
    text = F.concat(F.lit("<!-- x:off -->"), "source", F.lit("<!-- x:on -->\n`"), "source", F.lit("` https://a.b/"), "source", F.lit("\n"), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    size = lambda k: (F.get("masks", k)["to"] - F.get("masks", k)["at"])
    return add_masks(d).select("doc_id", size(0).alias("off_bytes"), size(2).alias("url_bytes"), size(1).alias("code_bytes"))


@query(f"WITH {SENTENCES}, w AS (SELECT doc_id, {WORDS.format('s')} AS n FROM sent) SELECT 'sentence-length' AS category, count(*) AS n FROM w WHERE n > 28")
def category_filter(spark, sf_dir):
    found = L.selected(_tuned(spark, sf_dir, "D9", "D14"), only=["sentence_length"])
    return found.groupBy("category").agg(F.count("*").alias("n"))
