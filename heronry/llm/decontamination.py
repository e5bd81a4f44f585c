"""Benchmark decontamination on templates, with DataFrame functions alone.

A text becomes a sequence of tokens in lower case: runs of letters and digits, where a point or comma between digits belongs
to the number. In templates a value is one token, however many words it has: a run of capitalised words (`Mary Smith`), a
run of number words (`twenty five`), a number, a unit after a number. Such tokens are replaced by typed placeholders; what
stood there is kept. Every window of five tokens of a document is looked up among those of the benchmark, so a question
with other numbers or names is found as well. A window has up to four forms, as capitals tell names and a copy may have
other capitals; those of documents meet those of items in any form:
- plain: as it stands in lower case, word by word, without placeholders;
- cased: with placeholders of numbers and units alone;
- full: with those, and those of capitalised words within a sentence;
- open: like full, and with capitalised words that open a sentence, unless they are among OPENERS; of items only windows
  with another placeholder have it.
Template windows on one line (the same distance between the places in document and item, counted in values) are one copy of
the item. Over all of them, in whatever form, one value of the item must stand for one value of the document; a line where
it doesn't is left to the plain windows. Windows with fewer literal tokens than half their length fit too much to count by
themselves: they count on lines that reach the coverage (and are consistent), so that short questions full of slots are
found. Plain windows count by themselves. An item counts as contained once a given share of its plain windows is covered,
each counted once. So an exact copy of an item, in any capitals, is always found.

What is defined for odd input:
- Null or empty texts have no tokens and are never contaminated; items without tokens are never found. Texts of any length
  are looked up whole, window by window.
- Items of fewer than five tokens are looked up whole. Forms without any literal token are not looked up, as they would fit
  any list of numbers or names; such windows are found in another form, at least the plain one.
- `one` is a number word after another one only, as it mostly is a pronoun. An item that names one number twice is found where the document has
  one number in both places.
- Rows with the same doc_id are judged together. Rows with a null doc_id give no rows, and the filter keeps them. Of
  benchmark rows with the same item_id each text is looked up by itself, and the item has the best coverage of its texts;
  null ids are left out. Repeated rows, and ties in coverage, change nothing.
- Other columns are not read. With an empty table on either side the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without_ids, written

#: Of an item of n tokens, one that is changed spoils at most WINDOW of its n - WINDOW + 1 windows.
WINDOW, LEAST_COVERAGE = 5, 0.5
#: Benchmark windows, in all their forms, that may be broadcast (about 100 bytes each and what their slots hold); beyond it
#: the join shuffles a hash for each window of the documents, and the five tokens of those with slots.
MOST_BROADCAST = 500_000
# Units that are told from other words after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs day days week weeks month months year years second seconds "
    "minute minutes hour hours meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros usd eur "
    "percent degrees kmh mph v w kw a hz khz mhz ghz kb mb gb tb"
).split()
# Words that open a sentence without being a name.
OPENERS = (
    "a all an and are as at but by can could did do does each every find for from give given had has have he her his how if in is it its "
    "let many most my no not of on one or our she should so some that the their then there these they this those to two was we were what "
    "when where which while who whom whose why will with would you your"
).split()
# Number words.
NUMBERS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
_NAME, _NUMBER, _UNIT, _OPENING, _JOIN, _POINT = "\x02", "\x03", "\x04", "\x05", "\x06", "\x07"
_SLOTS = (_NAME, _NUMBER, _UNIT)
TEMPLATES = ("full", "cased", "open")


def _marked(text: Column) -> Column:
    """Values and other tokens in one string, apart by single spaces; slots begin with the mark of their type, the words of
    one value are apart by _JOIN. The expressions begin with what is rare and look back from there, which is faster than to
    look back from everywhere."""
    letters, gap = r"[\p{L}\p{N}]", r"[ \x09-\x0D]"
    of = "|".join
    capital = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\p{{Lu}}(?=\p{{Ll}})(?<!{letters}\p{{Lu}})", _OPENING + "$0")
    named = F.regexp_replace(capital, rf"{_OPENING}(?<=[\p{{L}}\p{{N}},]{gap}{_OPENING})", _NAME)
    opening = F.regexp_replace(named, rf"{_OPENING}(?=(?i:{of(OPENERS)}|{of(NUMBERS)})(?!{letters}))", "")
    runs = F.regexp_replace(opening, rf"([{_NAME}{_OPENING}]\p{{L}}++){gap}{_NAME}(?=\p{{L}})", "$1" + _JOIN)
    runs = F.regexp_replace(runs, rf"({_JOIN}\p{{L}}++){gap}{_NAME}(?=\p{{L}})", "$1" + _JOIN)  # the second gap of three words, the fourth of five
    points = F.regexp_replace(runs, r"[.,](?<=\p{N}[.,])(?=\p{N})", _POINT)
    bare = F.lower(F.regexp_replace(points, rf"[^\p{{L}}\p{{N}}{_NAME}{_OPENING}{_JOIN}{_POINT}]+", " "))
    follows = rf"(?=(?:{of(NUMBERS)}|one)(?![^ ]))"
    spelled = F.regexp_replace(F.concat(F.lit(" "), bare), rf"( (?=[befhmnst])(?:{of(NUMBERS)})) {follows}", "$1" + _JOIN)
    spelled = F.regexp_replace(spelled, rf"({_JOIN}(?:{of(NUMBERS)})) {follows}", "$1" + _JOIN)  # as above
    spelled = F.regexp_replace(spelled, rf" (?=[befhmnst])(?=(?:{of(NUMBERS)})(?![^ {_JOIN}]))", " " + _NUMBER)
    numbered = F.regexp_replace(spelled, rf"\p{{N}}(?<![\p{{L}}\p{{N}}{_NAME}{_OPENING}{_JOIN}{_POINT}]\p{{N}})", _NUMBER + "$0")
    with_unit = F.regexp_replace(numbered, rf"({_NUMBER}[^ ]++ )(?=(?:{of(UNITS)})(?!{letters}))", "$1" + _UNIT)
    return F.trim(F.when(F.contains(numbered, F.lit(_NUMBER)), with_unit).otherwise(numbered))


def _forms(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, plain, values, full, cased, open): the tokens of df's text word by word, the values as they stand (with their
    marks), and the values in each form, apart by single spaces. A form is null where it can't differ from those before it;
    all are where there are no tokens."""
    rows = df.select(*keys, _marked(F.col("text")).alias("marked"))
    name, number, opening = (F.contains("marked", F.lit(m)) for m in (_NAME, _NUMBER, _OPENING))
    marked, every = F.col("marked"), "".join(_SLOTS)

    def form(text: Column, slots: str) -> Column:
        """Tokens that begin with one of `slots` are that mark alone."""
        return F.regexp_replace(text, f"([{slots}])[^ ]++", "$1")

    closed = F.replace("marked", F.lit(_OPENING), F.lit(""))
    forms = {
        "plain": F.when(marked != "", F.translate(closed, _JOIN + every, " ")),
        "values": F.when(name | number, marked),
        "full": F.when(name | number, form(closed, every)),
        "cased": F.when(name & number, F.translate(form(closed, _NUMBER + _UNIT), _NAME, "")),
        "open": F.when((name | number) & opening, form(F.translate(marked, _OPENING, _NAME), every)),
    }
    return rows.select(*keys, *(text.alias(name) for name, text in forms.items()))


def _bare(value: Column) -> Column:
    """A value without marks."""
    return F.translate(value, "".join((*_SLOTS, _OPENING)), "")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(template, item_id, variant, size, n_windows, first, last, line_place, slots, poor): a row for each form of a window.
    It covers the item's plain windows `first` to `last`. line_place (its place among the values) and slots are null where
    it is plain; slots have null for each literal. Each distinct text of an item is a variant."""
    items = benchmark.where("item_id is not null").distinct().withColumn("variant", F.xxhash64("text"))
    texts = _forms(items, ["item_id", "variant"]).where("plain is not null")
    texts = texts.withColumns({name: F.split(name, " ") for name in ("plain", "values", *TEMPLATES)})
    n = F.size("plain")
    texts = texts.withColumns({"plain_size": F.least(n, F.lit(WINDOW)), "n_windows": n - F.least(n, F.lit(WINDOW)) + 1})
    keys = ["item_id", "variant", "plain_size", "n_windows"]

    def windows(rows: DataFrame, columns: list[str], size: Column) -> DataFrame:
        """Each token with the next four of each column; rows where a window of `size` begins."""
        order = Window.partitionBy("item_id", "variant").orderBy("pos")
        rows = rows.select(*rows.columns, *(F.lead(c, k).over(order).alias(f"{c}{k}") for c in columns for k in range(WINDOW)), F.count("*").over(Window.partitionBy("item_id", "variant")).alias("n"))
        return rows.withColumn("size", F.least("n", size).cast("int")).where("pos <= n - size")

    plain = windows(texts.select(*keys, F.posexplode("plain").alias("pos", "word")), ["word"], F.lit(WINDOW))
    none = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    out = plain.select(F.xxhash64(*(f"word{k}" for k in range(WINDOW))).alias("template"), "item_id", "variant", "size", "n_windows", F.col("pos").alias("first"), F.col("pos").alias("last"), none[0].alias("line_place"), none[1].alias("slots"), F.lit(False).alias("poor"))

    rows = texts.where("values is not null").select(*keys, *TEMPLATES, F.posexplode("values").alias("pos", "values"))
    rows = rows.select(*keys, "pos", "values", *(F.get(name, F.col("pos")).alias(name) for name in TEMPLATES))
    rows = rows.withColumn("words", 1 + F.length("values") - F.length(F.replace("values", F.lit(_JOIN), F.lit(""))))
    before = F.sum("words").over(Window.partitionBy("item_id", "variant").orderBy("pos")) - F.col("words")
    rows = windows(rows.withColumn("place", before), ["values", "words", *TEMPLATES], F.lit(WINDOW))
    span = sum(F.coalesce(f"words{k}", F.lit(0)) for k in range(WINDOW))  # a window's columns are null beyond the item's end

    windows_of = {name: F.array(*(f"{name}{k}" for k in range(WINDOW))).alias(name) for name in ("values", *TEMPLATES)}
    rows = rows.select(*keys, "size", "pos", F.col("place").cast("int").alias("first"), (F.col("place") + span - F.col("plain_size")).cast("int").alias("last"), *windows_of.values())
    is_slot = lambda t: t.isin(*_SLOTS)
    rows = rows.withColumns({f"{name}_filled": F.size(F.filter(name, is_slot)) for name in TEMPLATES})
    wanted = {"full": F.col("full_filled") > 0, "cased": F.col("cased_filled") > 0, "open": (F.col("full_filled") > 0) & (F.col("open_filled") > F.col("full_filled"))}
    forms = F.array(*(F.when(wanted[name], F.struct(F.col(name).alias("tokens"), F.col(f"{name}_filled").alias("filled"))) for name in TEMPLATES))
    rows = rows.select(*keys, "size", "pos", "first", "last", "values", F.explode(F.array_distinct(F.array_compact(forms))).alias("form")).where("form.filled < size")
    slots = F.zip_with("form.tokens", "values", lambda t, v: F.when(is_slot(t), F.concat(t, _bare(v)))).alias("slots")
    template = F.xxhash64(*(F.get("form.tokens", F.lit(k)) for k in range(WINDOW))).alias("template")
    rows = rows.select(*keys, "size", "pos", "first", "last", F.struct(template, slots, "form.filled").alias("as"))
    poor = 2 * (F.col("size") - F.col("as.filled")) < F.col("size")
    return out.unionByName(rows.select("as.template", "item_id", "variant", "size", "n_windows", "first", "last", F.col("pos").alias("line_place"), F.slice("as.slots", F.lit(1), F.col("size")).alias("slots"), poor.alias("poor")))


def _met(docs: DataFrame, items: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """The items' windows that a document has: their columns with doc_id, the window's place (in values, if it has slots)
    and, if so, its values."""
    rows = _forms(docs, ["doc_id"]).withColumn("values", F.split("values", " "))
    forms = F.array(F.struct(F.col("plain").alias("text"), F.lit(False).alias("slotted")), *(F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("text"), F.lit(True).alias("slotted"))) for name in TEMPLATES))
    # outer, as Spark puts a filter before an inner explode, in which all of it would be evaluated again; one form is cut into
    # tokens at a time, as those of a long text take ten times its bytes
    rows = rows.select("doc_id", "values", F.explode_outer(F.array_compact(forms)).alias("form")).select("doc_id", "values", F.split("form.text", " ").alias("tokens"), "form.slotted")
    n = F.size("tokens")
    rows = rows.withColumn("place", F.explode_outer(F.when(n >= sizes[0], F.sequence(F.lit(0), n - sizes[0]))))

    rows = rows.withColumn("size", F.explode_outer(F.array(*map(F.lit, sizes))) if len(sizes) > 1 else F.lit(sizes[0]))
    tokens = [F.get("tokens", F.col("place") + k) for k in range(WINDOW)]  # null beyond the end, which leaves hashes as they are
    tokens = [t if k < sizes[0] else F.when(F.col("size") > k, t) for k, t in enumerate(tokens)]
    slotted = ~F.col("slotted")  # a form with slots is looked up where the window has one
    for t in tokens:
        slotted = slotted | F.coalesce(t < _OPENING, F.lit(False))  # a placeholder; other tokens begin with letters or digits
    template = F.when((F.col("place") + F.col("size") <= n) & slotted, F.xxhash64(*tokens)).alias("template")
    rows = rows.select("doc_id", "values", "slotted", "place", template)
    # taken before either join: what meets is held until its document is through, and mustn't hold all of its values each time
    own = F.when(F.col("slotted"), F.slice("values", F.col("place") + 1, WINDOW)).alias("own")
    rows = rows.where("template is not null").select("doc_id", "place", own, "template")
    return rows.join(F.broadcast(items) if few else items, "template").drop("template")


def contained_items(docs: DataFrame, benchmark: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, coverage) for each document and item that it contains.

    The documents are read once and never shuffled: their windows stream past the benchmark's, and only rows that met go
    on. The benchmark's side is counted first; beyond MOST_BROADCAST windows each window of the documents goes through a
    shuffle as a hash and a place, with its own five tokens at most, so the rows grow with the text and not with its square.
    """
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    items = written(item_windows(benchmark), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [WINDOW]  # at most WINDOW numbers
    met = _met(docs, items, sizes, items.count() <= MOST_BROADCAST)
    pairs = F.arrays_zip(F.col("slots").alias("item"), F.slice("own", F.lit(1), F.size("slots")).alias("doc"))
    pairs = F.transform(F.filter(pairs, lambda p: p["item"].isNotNull()), lambda p: F.struct(p["item"].alias("item"), _bare(p["doc"]).alias("doc")))
    met = met.select("doc_id", "item_id", "variant", "n_windows", "first", "last", "poor", (F.col("place") - F.col("line_place")).alias("line"), F.when(F.col("line_place").isNotNull(), pairs).alias("pairs"))
    lines = met.groupBy("doc_id", "item_id", "variant", "line").agg(  # a line has at most a few rows for each of the item's windows
        F.collect_set(F.struct("first", "last", "poor")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.first("n_windows").alias("n_windows")
    )

    def covered(spans: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"]))))

    values = F.array_distinct(F.transform("pairs", lambda p: p["item"]))
    lines = lines.where(F.size(values) == F.size("pairs"))  # each value of the item stands for one of the document
    lines = lines.withColumn("places", covered(F.col("spans")))
    enough = F.size("places") >= least_coverage * F.col("n_windows")
    rich = covered(F.filter("spans", lambda s: ~s["poor"]))
    found = lines.select("doc_id", "item_id", "variant", "n_windows", F.explode(F.when(enough, F.col("places")).otherwise(rich)).alias("place"))
    found = found.groupBy("doc_id", "item_id", "variant").agg(F.count_distinct("place").alias("matched_windows"), F.max("n_windows").cast("long").alias("item_windows"))
    found = found.withColumn("coverage", F.col("matched_windows") / F.col("item_windows")).where(F.col("coverage") >= least_coverage)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "matched_windows", "item_windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched_windows", "best.item_windows", "best.coverage")


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """The rows of docs, all columns, that contain no item. Rows with a null doc_id stay."""
    return without_ids(docs, contained_items(docs, benchmark, least_coverage).select("doc_id"))
