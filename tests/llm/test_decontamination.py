import os
import random
import subprocess
import sys
import time
from collections import defaultdict
from pathlib import Path

import pytest
import regex

from heronry.llm import decontamination
from heronry.llm.decontamination import NUMBERS, OPENERS, UNITS, WINDOW, contained_items, decontaminated

from .helpers import clashing, docs_of, odd_texts, words

ITEMS = [
    (1, "A train leaves Paris at 9 and travels 120 km to reach the town of Lyon before the 11 o'clock bell rings twice"),
    (2, "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from a wall"),
    (3, "item of four words"),
    (4, None),
    (None, "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from a wall"),
    (5, "1 2 3 4 5 6 7 8 9 10"),
]


def benchmark(spark, rows=ITEMS):
    return clashing(spark.createDataFrame(rows, "item_id long, text string"))


def values_of(text):
    """(kind, words) of each value or other token: name, opening (a name that opens a sentence), number, unit, or none."""
    out = []
    for m in regex.finditer(r"[\p{L}\p{N}]+(?:(?<=\p{N})[.,](?=\p{N})[\p{L}\p{N}]+)*", text or ""):
        w, before = m.group(), text[max(0, m.start() - 2) : m.start()]
        low, kind = w.lower().replace(",", "."), ""
        capital = regex.match(r"\p{Lu}\p{Ll}", w)
        within = regex.fullmatch(r"[\p{L}\p{N},][ \t\n\x0b\f\r]", before)
        if regex.match(r"\p{N}", w):
            kind = "number"
        elif capital and within:
            kind = "name"
        elif low in NUMBERS or (low == "one" and out and out[-1][0] == "spelled" and out[-1][1].split()[-1] in NUMBERS):
            kind = "spelled"
        elif capital and low not in OPENERS:
            kind = "opening"
        last = out[-1] if out else ("", "", 0)
        if kind == "name" and last[0] in ("name", "opening") and before[0] != "," and m.start() - 1 == last[2] and regex.fullmatch(r"\p{L}+", last[1].split()[-1]) and regex.match(r"\p{L}", w):
            out[-1] = (last[0], f"{last[1]} {low}", m.end())
        elif kind == "spelled" and last[0] == "spelled":
            out[-1] = ("spelled", f"{last[1]} {low}", m.end())
        elif not kind and last[0] in ("number", "spelled") and low in UNITS:
            out.append(("unit", low, m.end()))
        else:
            out.append((kind, low, m.end()))
    return [("number" if kind == "spelled" else kind, w) for kind, w, _ in out]


SLOTS = {"cased": {"number": "number", "unit": "unit"}, "full": {"number": "number", "unit": "unit", "name": "name"}}
SLOTS["open"] = SLOTS["full"] | {"opening": "name"}


def form_of(window, form):
    return [SLOTS[form].get(kind) or "=" + w for kind, w in window]


def slots(form):
    return sum(x[0] != "=" for x in form)


def brute(docs, items, least=0.5):
    """(doc_id, item_id, matched, windows) of all documents and items: each copy is a line of values, judged as a whole."""
    out = {}
    own = [(i, values_of(item), " ".join(w for _, w in values_of(item)).split()) for i, item in items if i is not None]
    for d, text in docs:
        mine = values_of(text)
        flat = " ".join(w for _, w in mine).split()
        at = {size: [[f for form in SLOTS if slots(f := form_of(mine[b : b + size], form))] for b in range(len(mine) - size + 1)] for size in range(1, WINDOW + 1)}
        for i, values, words in own:
            size = min(WINDOW, len(words))
            if not size:
                continue
            n = len(words) - size + 1
            places = {a for a in range(n) for b in range(len(flat) - size + 1) if words[a : a + size] == flat[b : b + size]}
            start = [sum(len(w.split()) for _, w in values[:k]) for k in range(len(values) + 1)]
            width, lines = min(WINDOW, len(values)), defaultdict(list)
            for a in range(len(values) - width + 1):
                window = values[a : a + width]
                for form in SLOTS:
                    t = form_of(window, form)
                    if not slots(t) or slots(t) == width or (form == "open" and not 0 < slots(form_of(window, "full")) < slots(t)):
                        continue
                    for b, forms in enumerate(at[width]):
                        if t in forms:
                            pairs = {((x, values[a + k][1]), mine[b + k][1]) for k, x in enumerate(t) if x[0] != "="}
                            lines[b - a].append((set(range(start[a], start[a + width] - size + 1)), 2 * (width - slots(t)) < width, pairs))
            for found in lines.values():
                pairs = set().union(*(p for *_, p in found))
                if len({x for x, _ in pairs}) == len(pairs):
                    whole = set().union(*(covered for covered, *_ in found))
                    places |= whole if len(whole) >= least * n else set().union(*(covered for covered, poor, _ in found if not poor))
            if len(places) / n >= least:
                out[d, i] = max(out.get((d, i), (0, 0)), (len(places), n))
    return {(*key, *value) for key, value in out.items()}


def generated(rng):
    """Items of 1 to 40 tokens with 0 to 100 % slots, some of which begin with a name, and documents with their copies: in
    order (document, item that must be found in it or None, text)."""
    names, nouns = ["Anna", "Bert", "Carla", "Dora Lind", "Emil", "Maria Anna Stein", "Peter"], [f"noun{chr(97 + k)}" for k in range(26)]
    kinds = [lambda: rng.choice(names), lambda: str(rng.randrange(1000)), lambda: f"{rng.randrange(100)} km", lambda: rng.choice(["twelve", "Twenty five", "forty one", "3.5", "1,250.75", "seven miles"])]
    items, docs = [], []
    for k in range(24):
        share, n = rng.choice([0, 0.2, 0.5, 0.8, 1]), rng.choice([1, 3, 4, 5, 6, 9, 15, 40])
        parts = [rng.choice(kinds)() if rng.random() < share else rng.choice(nouns) for _ in range(n)]
        if rng.random() < 0.5:
            parts[0] = rng.choice([*names, "What", "The"])
        items.append((k, " ".join(parts)))
        changed = [rng.choice(names) if p in names else str(int(p) + 7) if p.isdigit() else p for p in parts]
        around = lambda: " ".join(rng.choice(nouns) + "x" for _ in range(12))
        for copy, must in ((" ".join(parts), k), (" ".join(parts).upper(), k), (", ".join(parts).lower(), k), (" ".join(changed), None)):
            for before in rng.sample([". ", " ", " 7 ", " Otto "], 2):
                docs.append((len(docs), must, around() + before + copy + rng.choice([". ", " km ", "? Who? "]) + around()))
    return items, docs


@pytest.mark.parametrize("bound", [500_000, 0])  # broadcast, and by a shuffle of windows
def test_equals_all_documents_by_all_items(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", bound)
    items, docs = generated(random.Random(8))
    df = docs_of(spark, [t for *_, t in docs], [d for d, *_ in docs])
    rows = contained_items(df, benchmark(spark, items)).collect()
    found = {(r["doc_id"], r["item_id"], r["matched_windows"], r["item_windows"]) for r in rows}
    assert found == brute([(d, t) for d, _, t in docs], items)
    assert {(d, i) for d, i, _ in docs if i is not None} <= {(d, i) for d, i, *_ in found}  # every exact copy


def test_copies_full_of_slots_and_other_openings(spark):
    items = ["What is 12 + 15 and 33 + 4 and 7 + 9 and 8 + 2 equal to", "Solve: 14 + 27 = 41; 9 * 8 = 72; 100 / 4 = 25", "the price rose 3 percent in May to 12 dollars", "Maria bought 12 red apples", "Who was born in 1912?"]
    texts = [*items[:4], "Peter bought 15 red apples", "and so on. Peter bought 15 red apples. They were sour", "then Peter bought 9 red apples", "Maria sold 12 red apples", "Peter was born in 1915"]
    rows = contained_items(docs_of(spark, texts), benchmark(spark, list(enumerate(items)))).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (6, 3)}


def coverage(spark, pairs):
    rows = contained_items(docs_of(spark, [d for _, d in pairs]), benchmark(spark, [(k, t) for k, (t, _) in enumerate(pairs)])).collect()
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in rows}
    return [found.get((k, k), 0.0) for k in range(len(pairs))]


def test_re_parameterised_questions_are_judged_over_the_whole_item(spark):
    tom = "Tom has 12 apples and gives 4 to Anna. How many apples does Tom have left?"
    pairs = [
        (tom, "Ben has 30 apples and gives 7 to Carla. How many apples does Ben have left?"),
        (tom, "so: Ben has 30 apples and gives 7 to Carla. How many apples does Jim have left?"),  # one value, two others
        ("Alice drove 120 km in 2 hours", "Then Bob drove 300 miles in 5 days."),
        ("A train travels 3.5 km in total before it stops", "A train travels 80 km in total before it stops"),
        ("In 1999 Mary Smith paid 1,250 dollars for a house in New York", "In 2005 Peter paid 900 euros for a house in Paris"),
        ("a farmer has twelve sheep and sells twenty five of them", "a farmer has 30 sheep and sells 7 of them"),
        ("12 sheep stand on a hill and wait", "twenty one sheep stand on a hill and wait"),
    ]
    got = coverage(spark, pairs)
    assert [got[k] for k in (0, 2, 3, 4, 5, 6)] == [1.0] * 6
    assert got[1] < 0.5
    # values on other lines, or windows that fit any list, don't add up to a short question
    apart = "Bob drove 300 miles in 5 days."
    assert coverage(spark, [("Alice drove 120 km in 2 hours", "it took 300 miles in 5 days, and 12 km in 3 hours of rain"), ("Calculate 12 + 7 * 3 - 45", "Calculate nothing: 1 2 3 4 5 6 7 8 9")]) == [0.0, 0.0], apart


def test_windows_beyond_the_bound_take_time_in_proportion(spark, monkeypatch):
    rng = random.Random(2)
    texts = [f"{words(rng, n)} {ITEMS[0][1]} {words(rng, n)}" for n in (500, 1000, 4000, 8000) for _ in range(2)]
    texts = [t if k % 2 else t.replace("120 km", "77 miles").replace("Paris", "Old Rome") for k, t in enumerate(texts)]
    rows, took = {}, {}
    for bound in (500_000, 0):
        monkeypatch.setattr(decontamination, "MOST_BROADCAST", bound)
        rows[bound] = sorted(map(tuple, contained_items(docs_of(spark, texts), benchmark(spark)).collect()))
    assert rows[0] == rows[500_000] and {r[0] for r in rows[0]} == set(range(8))
    for n in (2, 16):
        df = docs_of(spark, [words(rng, 1000 * n) + " 7 km in Old Rome" for _ in range(16)]).repartition(4).cache()
        df.count()
        began = time.time()
        contained_items(df, benchmark(spark)).collect()
        took[n] = time.time() - began
    assert took[16] < 8 * took[2] + 5  # in proportion it's 8 at most, by the square 64
    plan = contained_items(docs_of(spark, texts), benchmark(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan


@pytest.mark.parametrize("few", [True, False])  # broadcast, and by a shuffle of windows
def test_windows_meet_items_without_the_whole_document(spark, few):
    docs, items = docs_of(spark, [ITEMS[0][1]]).select("doc_id", "text"), decontamination.item_windows(benchmark(spark).select("item_id", "text"))
    left, joins = [decontamination._met(docs, items, [WINDOW], few)._jdf.queryExecution().optimizedPlan()], []
    while left:
        node = left.pop()
        left += [node.children().apply(k) for k in range(node.children().size())]
        if node.getClass().getSimpleName() == "Join":
            output = node.left().output()
            joins.append({output.apply(k).name() for k in range(output.size())})
    assert joins == [{"doc_id", "place", "own", "template"}]


LONG = """
import random, sys
from heronry.llm.decontamination import contained_items
from heronry.session import local_session

rng, items = random.Random(4), ITEMS
spark = local_session(1, 2, spark__driver__memory="600m")
parts = [" ".join(f"w{rng.randrange(5000)}x" for _ in range(1000)) + " Otto has 7 km. " + items[k % 2][1] + ". " for k in range(400)]
docs = spark.createDataFrame([(1, "".join(parts))], "doc_id long, text string")
print(sorted((r["item_id"], r["coverage"]) for r in contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()))
"""


def test_a_long_text_with_many_copies_needs_memory_in_proportion():
    """2.7 MB that meet 400 copies, on a heap of 600 MB."""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", LONG.replace("ITEMS", repr(ITEMS[:2]))], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.splitlines()[-1:] == ["[(1, 1.0), (2, 1.0)]"], done.stderr[-2000:]


def test_finds_copies_and_other_numbers(spark):
    rng = random.Random(1)
    fill = lambda: words(rng, 50)
    texts = [
        f"{fill()}. {ITEMS[0][1]}. {fill()}",
        f"{fill()}. A train leaves Berlin at 7 and travels 450 miles to reach the town of Hamburg before the 10 o'clock bell rings twice.",
        f"{fill()} THE QUICK, brown fox -- jumps over the lazy dog;\n\nwhile seven sleepy cats watch from a wall!",
        f"{fill()} the quick brown fox jumps over nothing {fill()}",  # too little of it
        fill(),
        f"{fill()} item of four words {fill()}",
        f"{fill()} the quick brown fox jumps over the big dog while seven sleepy cats watch from a wall",  # one word changed
        "9 8 7 6 5 4 3 2 1 0 11 12",  # numbers alone are no question
    ]
    rows = contained_items(clashing(docs_of(spark, texts)), benchmark(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 1), (1, 1), (2, 2), (5, 3), (6, 2)}
    assert all(r["coverage"] >= 0.5 and r["matched_windows"] <= r["item_windows"] for r in rows)


def test_slots_must_be_consistent(spark):
    item = [(1, "if Anna has 5 apples and gives Bert 2 of them then Anna has left how many when 5 were hers")]
    good = "we ask: if Carl has 8 apples and gives Dora 3 of them then Carl has left how many when 8 were hers"
    bad = "we ask: if Carl has 8 apples and gives Dora 3 of them then Emil has left how many when 9 were hers"
    found = contained_items(docs_of(spark, [good, bad]), benchmark(spark, item)).collect()
    assert [r["doc_id"] for r in found] == [0]


def test_windows_full_of_slots_are_found_as_they_stand(spark):
    items = [(1, "Calculate 12 + 7 * 3 - 45 / 9 + 2"), (2, "1 2 3 4 5 6 7 8 9 10"), (3, "der Rat der Stadt Bonn und Kanzler Otto Graf Lang trafen Abt Hugo Maria Stein")]
    texts = [f"so it goes: {t} and on" for _, t in items] + ["so it goes: Calculate 13 + 8 * 4 - 46 / 8 + 3 and on", "9 8 7 6 5 4 3 2 1 0 11 12"]
    found = contained_items(docs_of(spark, texts), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in found} == {(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)}


def test_other_capitals_are_no_other_words(spark):
    items = [(1, "when did Anna and her friend Bert meet the old Carl near a Danube town of 900 people"), (2, "What is gravity?")]
    texts = [items[0][1].lower(), items[0][1].upper(), items[0][1].lower().replace("900", "750"), "Question 12\nWhat is gravity?", "they ask What is gravity?", "what was gravity"]
    found = contained_items(docs_of(spark, texts), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in found} == {(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 2, 1.0)}


def test_each_text_of_an_item_is_looked_up(spark):
    items = [(1, ITEMS[1][1]), (1, "a passage that stands under the same id as another one does"), (1, "three more words"), (1, None)]
    texts = [items[0][1], items[1][1], items[2][1], items[0][1] + ". " + items[1][1], "neither of them"]
    found = contained_items(docs_of(spark, texts), benchmark(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in found) == [(k, 1, 1.0) for k in range(4)]


def test_filter_keeps_clean_rows(spark):
    texts = [*odd_texts(), ITEMS[1][1], ITEMS[1][1], ITEMS[1][1]]
    df = clashing(docs_of(spark, texts, [*range(len(texts) - 2), 3, None]))
    out = decontaminated(df, benchmark(spark))
    assert out.columns == df.columns
    gone = {3, len(texts) - 3}  # rows with the same id are judged together; a null id stays
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted((i for i in [*range(len(texts) - 2), 3, None] if i not in gone), key=str)


def test_no_rows(spark):
    assert contained_items(docs_of(spark, []), benchmark(spark)).count() == 0
    assert contained_items(docs_of(spark, odd_texts()), benchmark(spark, [])).count() == 0
