"""Secret scans with a trigram index, with DataFrame functions alone.

From the regular expression of each rule a Boolean query over trigrams is derived: what every match must contain. The
index holds a posting (trigram, document) for each trigram that some rule asks for. Postings of a document are brought
together and the queries evaluated on them; what passes is verified with the expression itself on the whole text. A rule
without mandatory trigrams (hex) scans every text. Texts stay where they are: up to MOST_CANDIDATES the candidates are
broadcast; of more, the texts that have what a rule asks for go to the candidates, and all others are scanned in place.

What is defined for odd input:
- A null text counts as empty. Repeated rows give a row each. Rows with a null id have no postings, so that all rules
  scan them; rows with the same id share their postings, which can only add candidates.
- Positions count code points, and ends are exclusive. Whole texts are scanned. Matches of one rule that begin at one place
  can't tie; of different rules, the one that stands first in the list comes first.
- Other columns are not read, whatever their names; redacted() passes them on. An empty table gives an empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, written


#: Candidates that are broadcast, at most; about 100 bytes each.
MOST_CANDIDATES = 500_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  #: for Java and Python alike
    group: int = 0  #: what must be long enough
    least: int = 1  #: its least length


_KEYS = r"password|passwd|secret|token|api_?key"
BASE = (
    Rule("assign", rf"((?i:{_KEYS}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run of 24 or more is what a run of any length is that has 24: no match can begin within a shorter one
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Forms of keys that their issuers have published.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

ANY = ("any",)


def _and(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def trigram_query(pattern: str) -> tuple:
    """What each match contains, in lower case: ("any",), ("trigram", t), ("and", ...) or ("or", ...)."""

    def of(items) -> tuple:
        parts, runs = [], [""]  # runs: the strings that the literals just before may spell

        def close():
            nonlocal runs
            if all(len(run) > 2 for run in runs):
                ways = [_and([("trigram", run[i : i + 3].lower()) for i in range(len(run) - 2)]) for run in runs]
                parts.append(ways[0] if len(ways) == 1 else ("or", *dict.fromkeys(ways)))
            runs = [""]

        for op, value in items:
            if op is sre.LITERAL and value < 128:
                runs = [run + chr(value) for run in runs]
            elif op is sre.IN and len(value) * len(runs) <= 16 and all(o is sre.LITERAL and v < 128 for o, v in value):
                runs = [run + chr(v) for run in runs for _, v in value]
            else:
                close()
                if op is sre.SUBPATTERN:
                    parts.append(of(value[3]))
                elif op is sre.MAX_REPEAT and value[0] > 0:
                    parts.append(of(value[2]))
                elif op is sre.BRANCH:
                    ways = [of(way) for way in value[1]]
                    parts.append(ANY if ANY in ways else ("or", *dict.fromkeys(ways)))
        close()
        return _and(parts)

    return of(re._parser.parse(pattern))


def _trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "trigram" else set().union(*(_trigrams(q) for q in query[1:]))


def _holds(query: tuple, found: Column) -> Column:
    if query[0] == "trigram":
        return F.array_contains(found, query[1])
    each = [_holds(q, found) for q in query[1:]]
    out = each[0]
    for more in each[1:]:
        out = out & more if query[0] == "and" else out | more
    return out


def _queries(rules: tuple[Rule, ...]) -> dict[str, tuple]:
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    return {k: q for k, q in queries.items() if q != ANY}


def _found(queries: dict[str, tuple]) -> Column:
    """Those of the queries' trigrams that the column low has."""
    trigrams = sorted(set().union(*map(_trigrams, queries.values())))
    return F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))


def postings(docs: DataFrame, queries: dict[str, tuple]) -> DataFrame:
    """(trigram, doc_id): the index, for the trigrams that the rules ask for."""
    low = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    # outer, as Spark puts a filter before an inner explode, in which all of it would be evaluated twice
    return low.select(F.explode_outer(_found(queries)).alias("trigram"), "doc_id").where("trigram is not null")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules array<string>): the rules whose query the document's postings fulfil."""
    queries = _queries(rules)
    met = postings(docs, queries).groupBy("doc_id").agg(F.collect_set("trigram").alias("found"))  # a set is bounded by the rules
    passed = F.array_compact(F.array(*(F.when(_holds(q, F.col("found")), F.lit(k)) for k, q in queries.items())))
    return met.select("doc_id", passed.alias("rules")).where(F.size("rules") > 0)


_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(rule: Rule, kind: int) -> Column:
    """The rule's spans in the column text: what stands between matches gives their places."""
    rx = F.lit(rule.pattern)
    hits, values = F.regexp_extract_all("text", rx, 0), F.regexp_extract_all("text", rx, rule.group)
    gaps = F.slice(F.split("text", rule.pattern, -1), 1, F.size(hits))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        spans = F.when(F.length(x["value"]) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    found = F.aggregate(zipped, start, step, lambda state: state["spans"])
    return F.when(F.regexp_like("text", rx), found).otherwise(F.array().cast(_SPAN))


def _text(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text, row, base_spans, spans), with the whole input row as a struct."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*quoted(docs.columns)).alias("row"))
    passed = written(candidates(docs, rules), "candidates")
    if passed.count() <= MOST_CANDIDATES:
        rows = docs.join(F.broadcast(passed), "doc_id", "left")
    else:
        queries = _queries(rules)
        rows = docs.withColumn("low", F.lower("text")).withColumn("found", _found(queries)).drop("low")
        wanted = F.lit(False)
        for query in queries.values():
            wanted = wanted | _holds(query, F.col("found"))
        rows = rows.withColumn("wanted", wanted & F.col("doc_id").isNotNull()).drop("found")
        there = rows.where("wanted").drop("wanted").join(passed, "doc_id", "left")
        rows = rows.where("not wanted").drop("wanted").withColumn("rules", F.lit(None).cast("array<string>")).unionByName(there)
    empty = F.array().cast(_SPAN)
    each = []
    for kind, rule in enumerate(rules):
        spans = _spans(rule, kind)
        if trigram_query(rule.pattern) != ANY:
            wanted = F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
            spans = F.when(wanted, spans).otherwise(empty)
        each.append(spans)
    n = len(BASE)
    rows = rows.select("doc_id", "text", "row", F.sort_array(F.concat(*each[:n])).alias("base_spans"), F.concat(*each[n:], empty).alias("more"))
    return rows.select("doc_id", "text", "row", "base_spans", F.sort_array(F.concat("base_spans", "more")).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, text, base_spans, spans): of the base rules, and of all; arrays of (start, kind, end) by start, then kind,
    where kind counts the base rules and then the others."""
    return _scanned(docs, BASE + tuple(rules)).drop("row")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    kinds = [r.kind for r in BASE + tuple(rules)]
    rows = scan(docs, rules)

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE[kind].kind}")

    counts = map(count, range(len(BASE)))
    return rows.select("doc_id", *counts, F.sha2(_text(F.col("base_spans"), kinds), 256).alias("base_sha256"), _text(F.col("spans"), kinds).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """All rows of docs with all columns; in text each span, or run of spans that overlap, is replaced by [secret], and
    n_chars, if docs has it, follows. A null text stays null."""
    rows = _scanned(docs, BASE + tuple(rules))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    part = lambda begin, end: F.substring("text", begin.cast("int") + 1, (end - begin).cast("int"))

    def step(state: Column, s: Column) -> Column:
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], part(state["at"], s["start"]), F.lit("[secret]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    text = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], part(s["at"], F.length("text").cast("long"))))
    rows = rows.select("row", F.when(F.size("spans") > 0, text).alias("new"))  # null where nothing is found
    own = {c: F.col("row").getField(c) for c in docs.columns}
    changed = {"text": F.coalesce("new", own["text"].cast("string"))}
    if "n_chars" in own:
        changed["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), own["n_chars"])
    return rows.select(*(changed.get(c, own[c]).alias(c) for c in docs.columns))
