"""Prose detectors: each is an array of findings built inside the document's row.

``findings`` lays down what the asked detectors need (sentences, masks, matches),
then explodes their arrays once, so a report of all detectors reads and splits a
document one time and shuffles nothing. A finding is (detector, category,
severity, at, to, snippet, message); ``at`` and ``to`` are UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill import config as C
from prosemill.functions import text as X
from prosemill.functions.masks import add_masks, anchor, visible

FINDING = "struct<detector:string,category:string,severity:string,at:bigint,to:bigint,snippet:string,message:string>"
_EMPTY = f"array<{FINDING}>"
#: Columns that a detector reads again and again, laid down first, step by step.
STAGES: dict[str, list[Callable[[C.Config], dict[str, Column]]]] = {}


def _finding(detector: str, category: str, severity: str | Column, at: Column, to: Column, snippet: Column, message: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(detector).alias("detector"), F.lit(category).alias("category"), as_column(severity).alias("severity"), at.cast("bigint").alias("at"), to.cast("bigint").alias("to"), snippet.alias("snippet"), as_column(message).alias("message"))


def _none() -> Column:
    return F.array().cast(_EMPTY)


def _sentence_of(at: Column) -> Column:
    """The sentence that a byte stands in, or null."""
    last = F.get("sents", X.last_before("sent_at", at))
    return F.when(at < _whole(last), last)


def _whole(s: Column) -> Column:
    return s["at"] + F.octet_length(s["s"])


def _open_sentences(category: str) -> Column:
    return F.filter("sents", lambda s: visible(s["at"], category))


def _allowed(cfg: C.Config, m: Column) -> Column:
    return F.lower(m).isin([p.lower() for p in cfg.allowed_phrases]) if cfg.allowed_phrases else F.lit(False)


def _lexicon(detector, category, severity, name, phrases, whitelist=True, cited=False):
    def build(cfg: C.Config) -> Column:
        def ok(x):
            keep = visible(x["at"], category) & X.bounded(x)
            if whitelist:
                keep = keep & ~_allowed(cfg, x["m"])
            if cited:
                keep = keep & ~F.coalesce(_sentence_of(x["at"])["s"].rlike(C.CITATION), F.lit(False))
            return keep

        return F.transform(F.filter(name, ok), lambda x: _finding(detector, category, severity, x["at"], x["to"], x["m"], F.concat(F.lit("phrase: "), x["m"])))

    return build, lambda cfg: {name: X.phrase_pattern(phrases(cfg))} if phrases(cfg) else {}


def _throttled(detector, category, name, phrases):
    """A hint alone in its sentence, none there if the sentence is specific; warnings from two on."""

    def stage(cfg: C.Config) -> dict[str, Column]:
        seen = F.filter(name, lambda x: visible(x["at"], category) & X.bounded(x) & ~_allowed(cfg, x["m"]))
        return {f"{name}_in": F.transform(seen, lambda x: F.struct(x["at"].alias("at"), x["to"].alias("to"), x["m"].alias("m"), _sentence_of(x["at"]).alias("s")))}

    def build(cfg: C.Config) -> Column:
        at = lambda k: F.coalesce(F.get(f"{name}_in", k)["s"]["i"], F.lit(-1))
        there = lambda k: F.get(f"{name}_in", k).isNotNull()
        # findings of one sentence are neighbours, so what matters is whether a neighbour shares it
        joined = F.transform(f"{name}_in", lambda x, k: F.struct(x.alias("x"), ((there(k - 1) & (at(k - 1) == at(k))) | (there(k + 1) & (at(k + 1) == at(k)))).alias("several")))
        kept = F.filter(joined, lambda j: j["several"] | ~F.coalesce(j["x"]["s"]["s"].rlike(C.SPECIFIC), F.lit(False)))
        return F.transform(kept, lambda j: _finding(detector, category, F.when(j["several"], "warning").otherwise("hint"), j["x"]["at"], j["x"]["to"], j["x"]["m"], F.concat(F.lit("phrase: "), j["x"]["m"])))

    STAGES[detector] = [stage]
    return build, lambda cfg: {name: X.phrase_pattern(phrases(cfg))} if phrases(cfg) else {}


def _matches(detector, category, severity, name, pattern, condition=None):
    def build(cfg: C.Config) -> Column:
        keep = lambda x: visible(x["at"], category) & (condition(x) if condition else F.lit(True))
        return F.transform(F.filter(name, keep), lambda x: _finding(detector, category, severity, x["at"], x["to"], X.trim(x["m"]), F.concat(F.lit("match: "), X.trim(x["m"]))))

    return build, lambda cfg: {name: pattern}


def _template_stage(cfg: C.Config) -> dict[str, Column]:
    """The matches of all patterns in one array: patterns may match the same words."""
    names = [f"_tpl{i}" for i in range(len(cfg.templates) + len(cfg.rules.templates))]
    return {"tpl": F.concat(*names)} if names else {}


def _templates(cfg: C.Config) -> Column:
    if not cfg.templates and not cfg.rules.templates:
        return _none()
    kind = lambda x: F.when(F.lower(x["m"]).contains("not"), "negative-parallel").otherwise("template")
    seen = F.filter("tpl", lambda x: visible(x["at"], "template") & ~_allowed(cfg, x["m"]))
    return F.transform(seen, lambda x: F.struct(F.lit("D6").alias("detector"), kind(x).alias("category"), F.lit("error").alias("severity"), x["at"].alias("at"), x["to"].alias("to"), X.trim(x["m"]).alias("snippet"), F.lit("template phrase").alias("message")))


def _connectors(cfg: C.Config) -> Column:
    lower = lambda s: F.lower(s["s"])
    count = lambda s: sum(((F.length(lower(s)) - F.length(F.replace(lower(s), F.lit(t), F.lit("")))) / len(t) for t in C.CONNECTORS), F.lit(0))
    return F.transform(F.filter(_open_sentences("connector-glut"), lambda s: count(s) > cfg.connectors), lambda s: _finding("D8", "connector-glut", "warning", s["at"], _whole(s), s["s"], "connectors"))


def _long_sentences(cfg: C.Config) -> Column:
    if cfg.rules.max_sentence_length is None:
        return _none()
    return F.transform(F.filter(_open_sentences("sentence-length"), lambda s: X.token_count(s["s"]) > cfg.rules.max_sentence_length), lambda s: _finding("D9", "sentence-length", "hint", s["at"], _whole(s), s["s"], F.concat(X.token_count(s["s"]).cast("string"), F.lit(" words"))))


def _question_lead(cfg: C.Config) -> Column:
    if cfg.rules.question_lead_limit is None:
        return _none()
    plain = F.filter(_open_sentences("tone"), lambda s: ~s["s"].rlike(r"^[#*-]") & (F.octet_length(s["s"]) >= 2))
    # sentences before the first that is no question
    first = F.array_position(F.transform(plain, lambda s: s["s"].endswith("?")), False)
    lead = F.when(first == 0, plain).otherwise(F.slice(plain, F.lit(1), (first - 1).cast("int")))
    one = F.transform(F.slice(lead, 1, 1), lambda s: _finding("D10", "tone", "hint", s["at"], _whole(s), s["s"], "question lead"))
    return F.when(F.size(lead) > cfg.rules.question_lead_limit, one).otherwise(_none())


def _first_word(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(s, r"(?U)^\s*(\S+)", 1), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _cadence_stages():
    starts = lambda cfg: list(dict.fromkeys(s.lower() for s in cfg.rules.cadence_starts))
    own = lambda cfg: {"cad": F.transform(_open_sentences("cadence"), lambda s: F.struct(s["at"].alias("at"), s["s"].alias("s"), F.when(~s["s"].rlike(r"^[#*-]"), _first_word(s["s"])).alias("w")))}
    return [own, lambda cfg: {"cad": F.transform("cad", lambda x: F.struct(x["at"].alias("at"), x["s"].alias("s"), F.when(x["w"].isin(starts(cfg) or [""]), x["w"]).alias("w")))}]


def _cadence(cfg: C.Config) -> Column:
    limit = cfg.rules.cadence_limit
    if not cfg.rules.cadence_starts or not limit:
        return _none()

    def late(x, k):
        out = x["w"].isNotNull()
        for j in range(1, limit + 1):
            out = out & F.coalesce(F.get("cad", k - j)["w"] == x["w"], F.lit(False))
        return out

    return F.transform(F.filter("cad", late), lambda s: _finding("D12", "cadence", "hint", s["at"], _whole(s), s["s"], "same opening"))


def _broad_terms(cfg: C.Config) -> Column:
    terms = list(dict.fromkeys(t.lower() for t in cfg.rules.broad_terms))
    if not terms:
        return _none()
    edge = lambda ts: rf"(?i)(?<![{X.WORDY}])(?:" + X.phrase_pattern(ts)[4:] + rf")(?=(?:s|es|ed|ing|ly|d)?(?![{X.WORDY}]))"
    pick = lambda s: F.coalesce(*[F.when(s["s"].rlike(edge([t])), F.lit(t)) for t in terms])
    plain = F.filter(_open_sentences("broad-term"), lambda s: ~s["s"].startswith("#") & s["s"].rlike(edge(terms)) & ~s["s"].rlike(C.SPECIFIC))
    return F.transform(plain, lambda s: _finding("D13", "broad-term", "hint", s["at"], _whole(s), pick(s), "broad term"))


def _repetition_stages():
    own = lambda cfg: F.transform(_open_sentences("repetition"), lambda s: F.struct(X.normalized(s["s"]).alias("n"), s["i"].alias("i"), s["at"].alias("at"), s["s"].alias("s")))
    return [lambda cfg: {"rep": F.sort_array(F.filter(own(cfg), lambda x: F.octet_length(x["n"]) >= 12))}]


def _repetition(cfg: C.Config) -> Column:
    limit = cfg.rules.max_duplicate_sentences
    if not limit:
        return _none()
    # sorted by text, then place: a sentence repeats if the one ``limit`` before it has its text
    again = F.filter("rep", lambda x, k: F.coalesce(F.get("rep", k - limit)["n"] == x["n"], F.lit(False)))
    return F.transform(again, lambda x: _finding("D14", "repetition", "warning", x["at"], x["at"] + F.octet_length(x["s"]), x["s"], "repeated sentence"))


def _per_paragraph(detector, category, severity, count, limit, blank=False):
    """One finding for each paragraph that counts more than the limit."""

    def build(cfg: C.Config) -> Column:
        top = limit(cfg)
        if top is None:
            return _none()
        name = "blank_paras" if blank else "paras"
        return F.transform(F.filter(name, lambda p: visible(p["at"], category) & (count(p["s"]) > top)), lambda p: _finding(detector, category, severity, p["at"], p["at"] + F.octet_length(p["s"]), X.trim(p["s"]), F.concat(count(p["s"]).cast("string"), F.lit(" in paragraph"))))

    return build, lambda cfg: {}


def _rule_of_three(cfg: C.Config) -> Column:
    over = F.transform("paras", lambda p: F.slice(F.regexp_extract_all(p["s"], F.lit(C.RULE_OF_THREE), 0), cfg.rule_of_three + 1, (1 << 31) - 1))
    return F.flatten(F.transform("paras", lambda p, i: F.when(visible(p["at"], "rule-of-three"), F.transform(F.get(over, i), lambda m: _finding("D16", "rule-of-three", "warning", p["at"], p["at"] + F.octet_length(p["s"]), m, "three in a row"))).otherwise(_none())))


def _heading(detector, category, severity, condition, message):
    def build(cfg: C.Config) -> Column:
        if condition(cfg) is None:
            return _none()
        return F.transform(F.filter("heads", lambda h: visible(h["at"], category) & condition(cfg)(h)), lambda h: _finding(detector, category, severity, h["at"], h["at"] + F.octet_length(h["s"]), X.trim(h["s"]), message))

    return build, lambda cfg: {}


def title(h: Column) -> Column:
    return X.trim(F.regexp_replace(X.trim(h["s"]), r"^#+", ""))


def _headings_over(cfg: C.Config) -> Column:
    top = cfg.rules.max_headings
    if top is None:
        return _none()
    own = F.filter("heads", lambda h: visible(h["at"], "structure"))
    return F.transform(F.slice(own, top + 1, 1), lambda h: _finding("D19f", "structure", "warning", h["at"], h["at"] + F.octet_length(h["s"]), X.trim(h["s"]), "too many headings"))


def _document(detector, category, severity, message):
    """A finding for the document as a whole, at its anchor."""
    c = F.coalesce(F.col("text"), F.lit(""))
    return _finding(detector, category, severity, anchor(c), F.least(anchor(c) + 100, F.octet_length(c)), F.lit("Document-level analysis"), message)


def _headings_missing(cfg: C.Config) -> Column:
    found = F.transform(F.filter("heads", lambda h: visible(h["at"], "structure")), lambda h: F.lower(title(h)))
    parts = [F.when(~F.array_contains(found, name.lower()), F.array(_document("D19g", "structure", "warning", f"missing heading: {name}"))).otherwise(_none()) for name in cfg.rules.required_headings]
    return F.concat(*parts) if parts else _none()


def _headings_banned(cfg: C.Config) -> Column:
    banned = lambda p: lambda h: visible(h["at"], "structure") & title(h).rlike(f"(?iU){p}")
    parts = [F.transform(F.filter("heads", banned(p)), lambda h: _finding("D19h", "structure", "warning", h["at"], h["at"] + F.octet_length(h["s"]), X.trim(h["s"]), "banned heading")) for p in cfg.rules.banned_headings]
    return F.concat(*parts) if parts else _none()


def _runs(keep: Callable[[Column], Column], ends: Callable[[Column], Column]) -> Column:
    """Runs of lines: arrays of the kept lines between lines that end a run."""
    zero = F.struct(F.array().cast("array<array<struct<at:bigint,s:string>>>").alias("done"), F.array().cast("array<struct<at:bigint,s:string>>").alias("open"))
    step = lambda a, x: F.when(keep(x), F.struct(a["done"].alias("done"), F.array_append(a["open"], x).alias("open"))).when(ends(x) & (F.size(a["open"]) > 0), F.struct(F.array_append(a["done"], a["open"]).alias("done"), F.array().cast("array<struct<at:bigint,s:string>>").alias("open"))).otherwise(a)
    return F.aggregate("rows", zero, step, lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"]))


BULLET = r"(?U)^\s*(?:[-*+]\s|[0-9][0-9\s]*[.)]\s)"


def _long_lists(cfg: C.Config) -> Column:
    top = cfg.rules.max_bullets
    if top is None:
        return _none()
    lists = _runs(lambda x: x["s"].rlike(BULLET) & visible(x["at"], "structure"), lambda x: visible(x["at"], "structure"))
    return F.transform(F.filter(lists, lambda r: F.size(r) > top), lambda r: _finding("D20", "structure", "hint", F.get(r, 0)["at"], F.get(r, 0)["at"] + F.octet_length(F.get(r, 0)["s"]), F.trim(F.get(r, 0)["s"]), F.concat(F.size(r).cast("string"), F.lit(" items"))))


def _emoji_bullets(cfg: C.Config) -> Column:
    own = F.filter("rows", lambda x: x["s"].rlike(rf"(?U)^\s*(?:[-*+]|[0-9]+[.)])\s+{X.EMOJI}") & visible(x["at"], "formatting"))
    return F.transform(own, lambda x: _finding("D21", "formatting", "hint", x["at"], x["at"] + F.octet_length(x["s"]), X.trim(x["s"]), "emoji bullet"))


def _bold_bullets(cfg: C.Config) -> Column:
    top = cfg.bold_lead_bullets
    if not top:
        return _none()
    lists = _runs(lambda x: x["s"].rlike(BULLET) & visible(x["at"], "formatting"), lambda x: ~x["s"].rlike(r"^\s*<!--\s*[a-z]+:"))
    led = lambda r: F.filter(r, lambda x: x["s"].rlike(r"(?U)^\s*(?:[-*+]|[0-9]+[.)])\s+(?:\*\*|__)"))
    return F.transform(F.filter(lists, lambda r: F.size(led(r)) >= top), lambda r: _finding("D22", "formatting", "hint", F.get(led(r), 0)["at"], F.get(r, F.size(r) - 1)["at"] + F.octet_length(F.get(r, F.size(r) - 1)["s"]), F.array_join(F.transform(F.slice(r, 1, 8), lambda x: F.rtrim(x["s"])), "\n"), "bold-led bullets"))


def _thin_sections(cfg: C.Config) -> Column:
    least = cfg.rules.min_section_sentences
    if not least:
        return _none()
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint")
    # sentences that begin behind the heading's text and before the next heading
    inside = lambda h, i: X.last_before("sec_prose", F.coalesce(F.get("sec", i + 1)["at"], size) - 1) - X.last_before("sec_prose", h["at"] + F.octet_length(h["s"]) - 2)
    return F.transform(F.filter("sec", lambda h, i: inside(h, i) < least), lambda h: _finding("D25", "structure", "hint", h["at"], h["at"] + F.octet_length(h["s"]), X.trim(h["s"]), "thin section"))


def _section_stages():
    return [lambda cfg: {"sec": F.filter("heads", lambda h: visible(h["at"], "structure")), "sec_prose": F.transform(F.filter(_open_sentences("structure"), lambda s: ~s["s"].rlike(r"(?U)^(?:#|[-*+]\s|[0-9][0-9\s]*[.)]\s)")), lambda s: s["at"])}]


def _triad(cfg: C.Config) -> Column:
    if not cfg.rules.triad:
        return _none()
    own = F.filter("heads", lambda h: visible(h["at"], "structure") & F.lower(title(h)).isin(C.TRIAD_TITLES))
    return F.when(F.size(own) >= 2, F.transform(F.slice(own, 1, 1), lambda h: _finding("D26", "structure", "warning", h["at"], h["at"] + F.octet_length(h["s"]), X.trim(h["s"]), "summary and conclusion"))).otherwise(_none())


def _code_blocks(cfg: C.Config) -> Column:
    least = cfg.rules.min_code_blocks
    if not least:
        return _none()
    n = F.size(F.filter("rows", lambda x: x["s"].rlike(r"(?U)^\s*```")))
    return F.when(n < least, F.array(_document("D27", "structure", "warning", "too few code blocks"))).otherwise(_none())


def _required(cfg: C.Config) -> Column:
    c = F.coalesce(F.col("text"), F.lit(""))
    parts = [F.when(~c.rlike(f"(?U){p}"), F.array(_document("D28", "structure", "warning", f"missing pattern: {p}"))).otherwise(_none()) for p in cfg.rules.required_patterns]
    return F.concat(*parts) if parts else _none()


def _forbidden(cfg: C.Config) -> Column:
    parts = [F.transform(F.filter(f"_forb{i}", lambda x: visible(x["at"], "structure")), lambda x: _finding("D29", "structure", "warning", x["at"], x["to"], X.trim(x["m"]), "forbidden pattern")) for i in range(len(cfg.rules.forbidden_patterns))]
    return F.concat(*parts) if parts else _none()


def _uniform(cfg: C.Config) -> Column:
    own = F.filter(F.transform(F.filter(_open_sentences("tone"), lambda s: ~s["s"].startswith("#")), lambda s: X.token_count(s["s"])), lambda n: n >= 3)
    n = F.size(own)
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x)
    mean = F.try_divide(total, n)
    cv = F.try_divide(F.sqrt(F.greatest(F.try_divide(square, n) - mean * mean, F.lit(0.0))), mean)
    return F.when((F.size("sents") >= 5) & (n >= 8) & (cv < cfg.uniform_below), F.array(_document("D31", "tone", "warning", "uniform sentence lengths"))).otherwise(_none())


def _passive(cfg: C.Config) -> Column:
    own = _open_sentences("tone")
    n = F.size(own)
    share = F.try_divide(F.size(F.filter(own, lambda s: s["s"].rlike(C.PASSIVE))), n)
    return F.when((F.size("sents") >= 5) & (n >= 6) & (share > cfg.passive_above), F.array(_document("D32", "tone", "hint", "passive voice"))).otherwise(_none())


def _opening_stages():
    def two(cfg):
        plain = F.filter(_open_sentences("cadence"), lambda s: ~s["s"].rlike(r"^[#*-]"))
        return {"open": F.sort_array(F.filter(F.transform(plain, lambda s: F.lower(F.array_join(F.slice(X.tokens(s["s"]), 1, 2), " "))), lambda o: o.contains(" ")))}

    def candidates(cfg):
        # a value with over 0.4 of a sorted array stands at one of its fifths
        n = F.size("open")
        return {"probe": F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.get("open", F.least((n * k / 5).cast("int"), n - 1))))}

    def counted(cfg):
        count = lambda o: F.size(F.filter("open", lambda y: y == o))
        return {"probe": F.sort_array(F.transform(F.filter("probe", lambda o: o.isNotNull()), lambda o: F.struct((-count(o)).alias("n"), o.alias("o"))))}

    return [two, candidates, counted]


def _openings(cfg: C.Config) -> Column:
    most = F.get("probe", 0)
    enough = (F.size("sents") >= 5) & (most["n"] <= -4) & (-most["n"] > 0.4 * F.size("open"))
    return F.when(enough, F.array(_document("D33", "cadence", "hint", F.concat(F.lit("opening: "), most["o"])))).otherwise(_none())


_PLAIN = lambda cfg: {}
_count = lambda p: lambda s: F.regexp_count(s, F.lit(p))
_on = lambda n: n or None  # noqa: E731  a limit of 0 switches these off
_cited = lambda x: ~F.coalesce(_sentence_of(x["at"])["s"].rlike(C.CITATION), F.lit(False)) & ~F.coalesce(_sentence_of(x["at"])["s"].rlike(C.PERCENT_CONTEXT), F.lit(False))

#: Detector -> (array of findings, match patterns that it needs), each by configuration.
DETECTORS: dict[str, tuple[Callable, Callable]] = {
    "D1": _lexicon("D1", "puffery", "error", "_puffery", lambda c: c.puffery),
    "D2": _lexicon("D2", "weasel", "warning", "_weasel", lambda c: c.weasel, cited=True),
    "D3": _throttled("D3", "buzzword", "_buzz", lambda c: c.buzzwords),
    "D4": _throttled("D4", "transition", "_trans", lambda c: c.transitions),
    "D5": _lexicon("D5", "marketing", "error", "_market", lambda c: c.marketing),
    "D6": (_templates, lambda cfg: {f"_tpl{i}": f"(?iU){p}" for i, p in enumerate([*cfg.templates, *cfg.rules.templates])}),
    "D7": _matches("D7", "weasel", "warning", "_range", C.RANGE),
    "D8": (_connectors, _PLAIN),
    "D9": (_long_sentences, _PLAIN),
    "D10": (_question_lead, _PLAIN),
    "D11": _matches("D11", "tone", "hint", "_midq", C.MID_QUESTION),
    "D12": (_cadence, _PLAIN),
    "D13": (_broad_terms, _PLAIN),
    "D14": (_repetition, _PLAIN),
    "D15": _per_paragraph("D15", "tone", "hint", _count("!"), lambda c: _on(c.rules.max_exclamations), blank=True),
    "D16": (_rule_of_three, _PLAIN),
    "D17": _per_paragraph("D17", "em-dash", "hint", _count("—"), lambda c: c.em_dashes),
    "D18": _per_paragraph("D18", "formatting", "hint", _count(C.BOLD), lambda c: _on(c.bold_spans)),
    "D19a": _heading("D19a", "structure", "hint", lambda c: None if c.rules.max_heading_depth is None else lambda h: F.length(F.regexp_extract(h["s"], "^(#+)", 1)) > c.rules.max_heading_depth, "deep heading"),
    "D19b": _heading("D19b", "structure", "hint", lambda c: (lambda h: title(h).endswith("?")) if c.rules.forbid_rhetorical_headings else None, "rhetorical heading"),
    "D19c": _heading("D19c", "formatting", "hint", lambda c: lambda h: h["s"].rlike(X.EMOJI), "emoji heading"),
    "D19e": _heading("D19e", "formatting", "hint", lambda c: (lambda h: X.title_case(title(h))) if c.sentence_case_headings else None, "title-case heading"),
    "D19f": (_headings_over, _PLAIN),
    "D19g": (_headings_missing, _PLAIN),
    "D19h": (_headings_banned, _PLAIN),
    "D20": (_long_lists, _PLAIN),
    "D21": (_emoji_bullets, _PLAIN),
    "D22": (_bold_bullets, _PLAIN),
    "D23": _lexicon("D23", "call-to-action", "warning", "_cta", lambda c: c.rules.calls_to_action, whitelist=False),
    "D24a": _lexicon("D24a", "confidence", "warning", "_conf", lambda c: c.rules.confidence, whitelist=False, cited=True),
    "D24b": _matches("D24b", "confidence", "warning", "_percent", C.PERCENT, _cited),
    "D25": (_thin_sections, _PLAIN),
    "D26": (_triad, _PLAIN),
    "D27": (_code_blocks, _PLAIN),
    "D28": (_required, _PLAIN),
    "D29": (_forbidden, lambda cfg: {f"_forb{i}": f"(?U){p}" for i, p in enumerate(cfg.rules.forbidden_patterns)}),
    "D30": _matches("D30", "quote-style", "hint", "_quotes", "[“”‘’]"),
    "D31": (_uniform, _PLAIN),
    "D32": (_passive, _PLAIN),
    "D33": (_openings, _PLAIN),
}

STAGES |= {"D6": [_template_stage], "D12": _cadence_stages(), "D14": _repetition_stages(), "D25": _section_stages(), "D33": _opening_stages()}


#: What detectors read besides their matches, lines and masks.
SENTENCES = {"D2", "D3", "D4", "D8", "D9", "D10", "D12", "D13", "D14", "D24a", "D24b", "D25", "D31", "D32", "D33"}
PARAGRAPHS, BLANK_PARAGRAPHS = {"D16", "D17", "D18"}, {"D15"}
HEADINGS = {"D19a", "D19b", "D19c", "D19e", "D19f", "D19g", "D19h", "D25", "D26"}


def prepared(docs: DataFrame, patterns: dict[str, str], detectors: set[str]) -> DataFrame:
    """Documents with masks, lines and matches and, as far as detectors read them, sentences, paragraphs and headings."""
    df = add_masks(X.add_sentences(docs) if detectors & SENTENCES else docs)
    df = X.pin(df, *(["sents"] if detectors & SENTENCES else []), "masks", "ignored", "mask_at", "mask_to", "named_masks")
    if detectors & SENTENCES:
        df = df.withColumn("sent_at", F.transform("sents", lambda s: s["at"]))
    c = F.coalesce(F.col("text"), F.lit(""))
    df = X.add_parts(df, "rows", F.split(c, r"(?<=\n)"))
    df = df.withColumn("row_at", F.transform("rows", lambda r: r["at"]))
    if detectors & PARAGRAPHS:
        df = X.add_parts(df, "_cut", F.split(c, r"(?<=\n\n)(?!\z)|(?=\n\n)"))
        df = df.withColumn("paras", F.filter("_cut", lambda p: p["s"] != "\n\n")).drop("_cut")
    if detectors & BLANK_PARAGRAPHS:
        df = X.add_parts(df, "_cut", F.split(c, r"(?U)(?<=\n)(?=[^\S\n]*(?:\n|\z))|(?<=\n[^\S\n]{0,40}\n)(?=[^\n]*\S)"))
        df = df.withColumn("blank_paras", F.filter("_cut", lambda p: p["s"].rlike(r"(?U)\S"))).drop("_cut")
    if detectors & HEADINGS:
        df = df.withColumn("heads", F.filter("rows", lambda x: x["s"].rlike(r"(?U)^\s*#")))
    return X.add_spans(df, patterns) if patterns else df


def findings(docs: DataFrame, cfg: C.Config | None = None, detectors: list[str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each finding of the detectors (all if None): ``keep``, the finding, ``line`` and ``column``."""
    cfg = cfg or C.Config()
    chosen = list(DETECTORS) if detectors is None else detectors
    patterns = {k: v for d in chosen for k, v in DETECTORS[d][1](cfg).items()}
    df = prepared(docs.select(*keep, "text"), patterns, set(chosen))
    steps = [STAGES.get(d, []) for d in chosen if DETECTORS[d][1] is _PLAIN or DETECTORS[d][1](cfg)]
    for k in range(max(map(len, steps), default=0)):
        df = df.withColumns({n: c for own in steps if k < len(own) for n, c in own[k](cfg).items()})
    arrays = [DETECTORS[d][0](cfg).cast(_EMPTY) for d in chosen if DETECTORS[d][1] is _PLAIN or DETECTORS[d][1](cfg) or d in ("D15", "D16", "D17", "D18") or d.startswith("D19")]
    # one array, one generator; a finding's line is looked up among the lines' starts
    rows = df.select(*keep, "rows", "row_at", "hops", "ignored", F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("f"))
    rows = rows.withColumn("k", X.last_before("row_at", F.col("f.at")))
    row = F.get("rows", F.col("k"))
    out = rows.select(*keep, "ignored", "f.*", (F.col("k") + 1).alias("line"), (F.length(X.prefix(row["s"], F.col("f.at") - row["at"])) + 1).alias("column"))
    whole = F.col("snippet") == "Document-level analysis"
    return out.filter(whole | ~F.array_contains("ignored", F.col("line"))).drop("ignored")


def with_suggestions(found: DataFrame) -> DataFrame:
    """Findings with ``suggestion``: a plainer word for the phrase, or null."""
    plain = F.create_map(*[F.lit(x) for pair in C.REPLACEMENTS.items() for x in pair])
    return found.withColumn("suggestion", F.try_element_at(plain, F.lower("snippet")))


