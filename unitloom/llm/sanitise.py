r"""Information-theoretic sanitisation of personal data.

Four kinds of protected entities are found by pattern and check: e-mail and IP addresses, card and
phone numbers.  Then the corpus says which terms reveal an entity: of the distinct texts that hold a
term, how many hold the entity, anywhere.  A term is a disclosure if it makes the entity at least so
likely, raises its likelihood by at least so many bits, and does so in more texts than chance explains:
of all pairs of an entity and a term, fewer than one would be so surprising.  In each document that holds
the entity every occurrence of the term is generalised, or removed where it nearly names the entity.  A
document that does not hold the entity keeps the term.

Terms are runs of two or more letters, digits, marks and underscores; the words of an entity itself count
as terms, too.  Copies of a text count once.

Everything is column functions; no Python runs on the executors.  Each text is searched once, and only
spans and, of texts with entities, distinct terms go on.  The patterns start a run of characters once: a run that fails
from its start fails from within, so long runs cost no more than their length.  Repeated groups are matched as runs of characters in a
masked text of the same length.

A null text counts as empty.  Rows that repeat an id are documents of their own.  Positions count code
points.  A match that fails its check is dropped, without a second try inside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from unitloom.llm.common import ROW, free_name, join_by_row, sha256_hex, table, with_row_key
from unitloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: A disclosure: so many distinct texts with both, such a likelihood of the entity, so many bits gained.  One
#: text alone says nothing of what its terms reveal elsewhere.
LEAST_SURROUNDINGS, LEAST_LIKELIHOOD, LEAST_BITS = 2, 0.5, 3
#: Terms that make the entity at least so likely are removed, others generalised.
REMOVE_LIKELIHOOD = 0.9

#: Stands for a character that may be part of a run but ends a repeated group; the text's own are put aside.
_MASK, _ASIDE = "\ue000", "\ue001"
_LOCAL, _DIGIT = f"[A-Za-z0-9._%+{_MASK}-]", "[0-9]"
#: Patterns for masked texts: repeated groups are runs of one class there, which take no stack however long.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": rf"(?:(?<!{_DIGIT})|\G)[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9][0-9\x20-]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP = r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$"
_WORD = r"[\p{L}\p{M}\p{N}_]{2,}"
_SPAN = "array<struct<start:int,stop:int,value:string>>"


def _masked(kind: str, text: Column) -> Column:
    """The text with one character in place of each that cannot be inside a match's repeated group.

    A domain's dot has to stand before a label, a card's separator between digits.
    """
    if kind == "email":
        return F.regexp_replace(F.translate(text, _MASK, _ASIDE), r"\.(?![A-Za-z0-9-])", _MASK)
    if kind == "card":
        return F.regexp_replace(F.translate(text, _MASK, _ASIDE), r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", _MASK)
    return text


#: Matches whose places are summed up in one array; arrays of this size are then joined.
RUN = 256


def _seen(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once: a list of one, whose function sees it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their places: array of (start, stop, value).

    Places are sums of all lengths before.  They are taken in runs of ``RUN`` matches, since an array that grows is
    copied at every step: a text of many matches costs their number times a run, not its square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    none = F.expr(f"cast(array() AS {_SPAN})")

    def size(step):
        return step["gap"] + F.coalesce(F.length(step["value"]), F.lit(0))

    def add(state, step):
        start = state["at"] + step["gap"]
        stop = start + F.length(step["value"])
        span = F.struct(start.alias("start"), stop.alias("stop"), step["value"].alias("value"))
        return F.when(step["value"].isNull(), state).otherwise(
            F.struct(stop.alias("at"), F.array_append(state["spans"], span).alias("spans")))

    def placed(run, at):
        return F.aggregate(run, F.struct(at.alias("at"), none.alias("spans")), add, lambda state: state["spans"])

    def joined(runs):
        sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda total, step: total + size(step)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda at, more: F.array_append(at, F.element_at(at, -1) + more))
        return F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), placed))

    def in_runs(all_steps):
        last = ((F.size(all_steps) - 1) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_steps, k * RUN + 1, F.lit(RUN)))

    return _seen(_seen(steps, in_runs), joined)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _kept(kind: str, number: int, found: Column) -> Column:
    held = F.filter(found, lambda m: _valid(kind, m["value"]))
    return F.transform(held, lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"), m["stop"].alias("stop"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Spans of protected entities: array of (start, kind number, stop, value), by start, then kind."""
    may_hold = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    lists = []
    for number, kind in enumerate(KINDS):
        spans = _kept(kind, number, matches(_masked(kind, text), PATTERNS[kind]))
        lists.append(F.when(may_hold.get(kind, text.rlike("[0-9]")), spans).otherwise(F.expr(
            "cast(array() AS array<struct<start:int,kind:int,stop:int,value:string>>)")))
    return F.array_sort(F.concat(*lists))


def entity_of(span: Column) -> Column:
    """A number for the entity a span names; spelling by case or separators does not count."""
    plain = F.when(span["kind"] == 0, F.lower(F.translate(span["value"], _MASK, "."))).when(span["kind"] == 1, span["value"]).otherwise(
        F.regexp_replace(span["value"], "[^0-9]", ""))
    return F.xxhash64(span["kind"], plain)


def terms_of(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda word: F.lower(word)))


def found_entities(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, spans, copy, entities, terms): what the text search found, texts left out."""
    texts = with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = texts.withColumn("spans", base_spans(F.col("text")))
    held = F.size("spans") > 0
    return spans.select(
        ROW, "doc_id", "spans", F.unhex(sha256_hex(F.col("text"))).alias("copy"),
        F.when(held, F.array_distinct(F.transform("spans", entity_of))).alias("entities"), F.when(held, terms_of(F.col("text"))).alias("terms"))


def disclosures(docs: DataFrame, found: DataFrame, text: str, least_surroundings: int = LEAST_SURROUNDINGS,
                likelihood: float = LEAST_LIKELIHOOD, bits: float = LEAST_BITS) -> DataFrame | None:
    """(entity, term, removed): terms that reveal an entity; None if there are none."""
    own = cut_lineage(found.groupBy("copy").agg(F.min(ROW).alias(ROW)).select(ROW), "own")
    total = own.count()
    met = found.where("entities IS NOT NULL").join(own, ROW, "left_semi").select(ROW, "entities", "terms")
    counted = cut_lineage(met.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("holders")), "holders")
    often = cut_lineage(counted.where(F.col("holders") >= least_surroundings), "often")
    if often.isEmpty():
        return None
    # merged at every size, so that small tables behave as large ones do
    texts = with_row_key(docs, F.coalesce(F.col(text), F.lit("")).alias("text")).hint("merge").join(own, ROW, "left_semi")
    # terms are counted before any pair is made, so a frequent term is one row
    spread = cut_lineage(texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("held")), "spread")
    tests = math.log2(max(2.0, float(counted.count()) * float(max(1, spread.count()))))
    most = float(often.agg(F.max("holders")).first()[0])
    # bounds, not a choice: together <= holders and together >= likelihood * held, so a term in more texts than this makes no
    # entity so likely, and what it can surprise by is at most held * log2(total / holders)
    held = F.col("held")
    rare = cut_lineage(spread.where(
        (held >= least_surroundings) & (held * likelihood <= most + 1e-6)
        & (held * F.log2(F.lit(float(total)) / (held * likelihood)) >= tests - 1e-6)), "rare")
    sought = met.select(ROW, F.explode("entities").alias("entity")).join(often, "entity").groupBy(ROW).agg(
        F.collect_list(F.struct("entity", "holders")).alias("sought"), F.max("holders").alias("most"))
    sought = cut_lineage(sought.join(met.select(ROW, "terms"), ROW), "sought")
    terms = sought.select(ROW, "most", F.explode("terms").alias("term")).join(rare, "term").where(held * likelihood <= F.col("most") + 1e-6)
    terms = cut_lineage(terms.select(ROW, "term", "held"), "terms")
    both = terms.join(sought.select(ROW, F.explode("sought").alias("e")), ROW).where(held * likelihood <= F.col("e.holders") + 1e-6)
    known = both.groupBy(F.col("e.entity").alias("entity"), "term").agg(
        F.count(F.lit(1)).alias("together"), F.max("held").alias("held"), F.max("e.holders").alias("holders")).where(F.col("together") >= least_surroundings)
    given, base = F.col("together") / held, F.col("holders") / F.lit(float(total))
    gain = F.log2(given / base)
    # bits by which chance falls short of so many texts with both (Chernoff's bound)
    other = F.when(given < 1, (1 - given) * F.log2((1 - given) / (1 - base))).otherwise(0.0)
    surprise = held * (given * gain + other)
    reveal = cut_lineage(known.where((given >= likelihood) & (gain >= bits) & (surprise >= tests)).select(
        "entity", "term", (given >= REMOVE_LIKELIHOOD).alias("removed")), "disclosures")
    return None if reveal.isEmpty() else reveal


def _occurrences(docs: DataFrame, text: str, hits: DataFrame) -> DataFrame:
    """(row, start, stop, removed) of every occurrence of the terms ``hits`` (row, term, removed) in their documents."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = with_row_key(docs, body.alias("text")).join(hits.select(ROW).distinct(), ROW, "left_semi")
    steps = F.zip_with(F.split("text", _WORD, -1), F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)),
                       lambda gap, word: F.struct(F.length(gap).alias("gap"), word.alias("word")))
    placed = texts.select(ROW, F.posexplode(steps).alias("pos", "step")).where("step.word IS NOT NULL")
    # a window over the words of one text, which is a row
    upto = Window.partitionBy(ROW).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("step.word")
    stop = F.sum(F.col("step.gap") + size).over(upto).cast("int")
    words = placed.select(ROW, F.lower("step.word").alias("term"), (stop - size).alias("start"), stop.alias("stop"))
    return words.join(hits, [ROW, "term"]).select(ROW, "start", "stop", "removed")


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """(row key, doc_id, base, terms) of each row of a stored table.

    ``base`` is an array of (start, kind number, stop, value), ``terms`` of (start, stop, removed).
    """
    found = cut_lineage(found_entities(docs, doc_id, text), "entities")
    reveal = disclosures(docs, found, text, **thresholds)
    none = F.expr("cast(array() as array<struct<start:int,stop:int,removed:boolean>>)")
    if reveal is None:
        return found.select(ROW, "doc_id", F.col("spans").alias("base"), none.alias("terms"))
    known = found.select(ROW, "terms", F.explode("entities").alias("entity")).join(reveal.select("entity").distinct(), "entity", "left_semi")
    hits = known.select(ROW, "entity", F.explode("terms").alias("term")).join(reveal, ["entity", "term"])
    hits = cut_lineage(hits.groupBy(ROW, "term").agg(F.max("removed").alias("removed")), "hits")
    marked = _occurrences(docs, text, hits).groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "removed"))).alias("terms"))
    met = found.select(ROW, "doc_id", "spans").join(marked, ROW, "left")
    # what an entity's span covers goes with the entity
    free = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (t["start"] < s["stop"]) & (t["stop"] > s["start"])))
    return met.select(ROW, "doc_id", F.col("spans").alias("base"), F.coalesce(free, none).alias("terms"))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """``docs`` with entities replaced by their kind in brackets and revealing terms generalised or removed.

    Where spans overlap, the first one's replacement stands for all they cover.
    """
    spans = personal_spans(docs, doc_id, text, **thresholds).select(ROW, "base", "terms")
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])
    base = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), F.element_at(names, s["kind"] + 1).alias("put")))
    terms = F.transform("terms", lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), F.when(s["removed"], "").otherwise("[TERM]").alias("put")))
    name = free_name("_cuts", docs.columns)
    cuts = spans.select(ROW, F.array_sort(F.concat(base, terms)).alias(name)).where(F.size(name) > 0)
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<string>)").alias("parts"))

    def cut(state, s):
        gap = F.substring(body, state["at"] + 1, s["start"] - state["at"])
        parts = F.array_append(F.array_append(state["parts"], gap), s["put"])
        return F.when(s["start"] < state["at"], F.struct(F.greatest(state["at"], s["stop"]).alias("at"), state["parts"].alias("parts"))).otherwise(
            F.struct(s["stop"].alias("at"), parts.alias("parts")))
    rewritten = F.aggregate(name, start, cut, lambda state: F.concat(
        F.array_join(state["parts"], ""), F.substring(body, state["at"] + 1, F.length(body))))
    met = join_by_row(docs, cuts, "left")
    return met.withColumn(text, F.when(F.col(name).isNull(), F.col(text)).otherwise(rewritten)).select(*docs.columns)


def op5_pii(spark, folder: str) -> DataFrame:
    spans = personal_spans(table(spark, folder, "documents"))
    names = F.array(*[F.lit(kind) for kind in (*KINDS, TERM)])

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def placed(column, number=None):
        return F.transform(column, lambda s: F.struct(
            s["start"].alias("start"), (s["kind"] if number is None else F.lit(number)).alias("kind"), s["stop"].alias("stop")))
    base = placed("base")
    every = F.array_sort(F.concat(base, placed("terms", len(KINDS))))

    def count(number):
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{KINDS[number]}")
    counts = [count(number) for number in range(len(KINDS))]
    return spans.select("doc_id", *counts, sha256_hex(joined(base)).alias("base_sha256"), joined(every).alias("spans"))
