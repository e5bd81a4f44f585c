"""Chat transcripts parsed into turns: a hidden Markov model over speaker markers and features of lines.

A state is a role at the first line of a turn or within one. Each line shows what kind of speaker marker it begins with,
how long it is, and how it ends; these are taken as independent in a state. Transitions and emissions are counted, with
smoothing, on conversations whose roles are known. The most likely states of a transcript are found by Viterbi, and its
turns rendered in one form.

Long transcripts are no single task: lines are dealt in blocks. Each block gives the best score from every state before it
to every state at its end (a max-plus product, six by six); the blocks of a conversation are put together by these small
matrices; then each block is decoded between the states found for its ends.

What is defined for odd input:
- A null text is an empty line. Lines of a conversation are taken in order of line_no, then of their text; a null line_no
  comes first. Rows with a null conv_id are one conversation. Repeated rows are lines of their own.
- conv_id may be of any type that Spark gives to Arrow. In formatted() turns are numbered up to 2^31; a turn may have as many
  lines as a text can. A task holds a block of 256 turns, or PIECE lines of it if it has more; so rows with null or repeated
  turn numbers, which share a block, are no exception.
- For learning, rows with roles other than those known are left out. Without any, all counts are those of smoothing.
- Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import crc_mod, written

ROLES = ("system", "user", "assistant")
N = 2 * len(ROLES)  # state: 2 * role, one more within a turn
# Words that name a speaker in front of a line.
NAMES = {"system": "system|instructions?|context", "user": "user|human|me|you|question|q|customer|client", "assistant": "assistant|ai|bot|answer|a|agent|model|gpt"}
_MARKER = re.compile(rf"^[\s#*<|\[(]*(?:{'|'.join(f'(?P<{role}>{names})' for role, names in NAMES.items())})(?:[\s*|>\])]*[:>\])|](?:[\s*|>:]+|$)|\s*$)", re.IGNORECASE)
LENGTHS = (0, 20, 50, 100, 200, 400, 800)
ENDS = "?:.!,"
N_CODES = (len(ROLES) + 1) * (len(LENGTHS) + 1) * (len(ENDS) + 1)
#: Lines in a block, where line_no counts lines.
BLOCK = 4096
#: Lines of a block that are held together; pieces of a block that are told apart.
PIECE, MOST_PIECES = 8192, 1 << 20
SMOOTHING = 0.5


def seen(line: str) -> tuple[int, int, int, str]:
    """Of a line: the role its marker names (counted from 1; 0 without one), its length's and its end's class, and the rest
    of it after the marker."""
    m = _MARKER.match(line)
    rest = line[m.end() :] if m else line
    bare = rest.rstrip()
    return 1 + ROLES.index(m.lastgroup) if m else 0, int(np.searchsorted(LENGTHS, len(bare))), ENDS.find(bare[-1:]) + 1 if bare else 0, rest


class Model:
    """Logarithms: start (N), step (N, N), and three emission tables (N, classes)."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        step, start = np.full((N, N), SMOOTHING), np.full(N, SMOOTHING)
        shows = [np.full((N, n), SMOOTHING) for n in (len(ROLES) + 1, len(LENGTHS) + 1, len(ENDS) + 1)]
        for (kind, a, b), n in counts.items():
            if kind == "step":
                step[a, b] += n
            elif kind == "start":
                start[b] += n
            else:
                shows[int(kind)][a, b] += n
        for a in range(N):
            for b in range(1, N, 2):
                if b // 2 != a // 2:
                    step[a, b] = 1e-9  # within a turn the role stays
        start[1::2] = 1e-9
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))
        self.shows = [np.log(s / s.sum(axis=1, keepdims=True)) for s in shows]

    def emission(self, marker: int, length: int, end: int) -> np.ndarray:
        return self.shows[0][:, marker] + self.shows[1][:, length] + self.shows[2][:, end]


def _ordered(lines: DataFrame, block: int) -> DataFrame:
    rows = lines.select("conv_id", F.coalesce(F.col("line_no").cast("long"), F.lit(-1)).alias("line_no"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("line_no") / block).cast("long"))
    # the lines of a block are counted by Spark, which sorts on disk if it must; equal lines may change places
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("line_no", "text"))
    return rows.withColumn("block", F.col("block") * MOST_PIECES + F.floor((place - 1) / PIECE))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal first columns, over the ends of batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:n_keys] != key:
                yield key, rows
                rows = []
            key = row[:n_keys]
            rows.append(row)
    if rows:
        yield key, rows


def fit(turns: DataFrame, block: int = BLOCK) -> Model:
    """A model from (conv_id, line_no, text, role, first): lines whose role is known, first where a turn begins; `block` as
    in parse()."""

    def shown(batches):
        for batch in batches:
            marks = [seen(t or "") for t in batch.column("text").to_pylist()]
            roles = [ROLES.index(r) for r in batch.column("role").to_pylist()]
            states = [2 * r + (not f) for r, f in zip(roles, batch.column("first").to_pylist(), strict=True)]
            columns = [batch.column("conv_id"), batch.column("line_no"), pa.array(states, pa.int32()), *(pa.array([m[k] for m in marks], pa.int32()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "line_no", "state", "m0", "m1", "m2"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    known = turns.where(F.col("role").isin(*ROLES)).select("conv_id", F.col("line_no").cast("long").alias("line_no"), "text", "role", "first")
    rows = written(known.mapInArrow(shown, f"conv_id {kind}, line_no long, state int, m0 int, m1 int, m2 int"), "line-features")
    # within a block by a window, over its beginning by a table with a row a block, so that no conversation is one task
    rows = rows.withColumn("block", F.floor(F.col("line_no") / block).cast("long"))
    ends = rows.groupBy("conv_id", "block").agg(F.max_by("state", "line_no").alias("last"))
    ends = ends.withColumn("carried", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")))
    ends = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "carried")
    within = F.lag("state").over(Window.partitionBy("conv_id", "block").orderBy("line_no"))
    steps = rows.withColumn("within", within).join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    steps = steps.select(F.coalesce("within", "carried").alias("a"), F.col("state").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    counts = {("step" if r["a"] is not None else "start", r["a"] or 0, r["b"]): r["n"] for r in steps.collect()}  # at most N * N + N rows
    for k in range(3):
        for r in rows.groupBy("state", f"m{k}").agg(F.count("*").alias("n")).collect():  # at most N times the classes
            counts[str(k), r["state"], r[f"m{k}"]] = r["n"]
    return Model(counts)


def _decoded(emissions: list[np.ndarray], model: Model, before: int, last: int) -> list[int]:
    """The best states of a block between the state before it (-1: a conversation begins) and the state at its end."""
    score, back = (model.start if before < 0 else model.step[before]) + emissions[0], []
    for e in emissions[1:]:
        ways = score[:, None] + model.step
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    states = [last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def parse(lines: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """(conv_id, line_no, n_lines, role, continues, text, rendered): a row for each recovered turn, by its first line.

    A turn that goes on over the end of a block has another row with continues, so no row grows without bound.
    """
    conv = lines.schema["conv_id"].dataType.simpleString()
    known = lines.sparkSession.sparkContext.broadcast(model)  # of fixed size
    ordered = written(_ordered(lines, block).select("conv_id", "block", "line_no", "text"), "lines")
    ordered = ordered.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "line_no", "text")

    def products(batches):
        model, out = known.value, []
        for (conv_id, number), rows in _runs(batches, 2):
            total = np.concatenate([model.step, model.start[None]]) + model.emission(*seen(rows[0][3])[:3])  # last row: a start
            for row in rows[1:]:
                total = (total[:, :, None] + model.step[None]).max(axis=1) + model.emission(*seen(row[3])[:3])
            out.append((conv_id, number, total[:N].ravel(), total[N]))
            if len(out) >= 2000:
                yield product_rows(out)
                out = []
        yield product_rows(out)

    def product_rows(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        doubles = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (kinds[0], pa.int64(), doubles, doubles), strict=True)], ["conv_id", "block", "total", "first"])

    kinds = [to_arrow_type(lines.schema["conv_id"].dataType)]

    def ends(batches):
        out = []
        for (conv_id,), rows in _runs(batches, 1):
            scores = [np.array(rows[0][3])]
            back = []
            for row in rows[1:]:
                ways = scores[-1][:, None] + np.array(row[2]).reshape(N, N)
                back.append(ways.argmax(axis=0))
                scores.append(ways.max(axis=0))
            states = [int(scores[-1].argmax())]
            for b in reversed(back):
                states.append(int(b[states[-1]]))
            states.reverse()
            out += zip([conv_id] * len(rows), [r[1] for r in rows], [-1, *states[:-1]], states, strict=True)
            if len(out) >= 2000:
                yield end_rows(out)
                out = []
        yield end_rows(out)

    def end_rows(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (kinds[0], pa.int64(), pa.int32(), pa.int32()), strict=True)], ["conv_id", "block", "before", "last"])

    blocks = ordered.mapInArrow(products, f"conv_id {conv}, block long, total array<double>, first array<double>")
    blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(ends, f"conv_id {conv}, block long, before int, last int")
    placed = ordered.join(blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before", "last"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    placed = placed.select("conv_id", "block", "before", "last", "line_no", "text").repartition("conv_id", "block")
    placed = placed.sortWithinPartitions("conv_id", "block", "line_no", "text")
    names = ["conv_id", "line_no", "n_lines", "role", "continues", "text", "rendered"]

    def turns(batches):
        model, out = known.value, []

        def made():
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = (kinds[0], pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

        for (conv_id, _), rows in _runs(batches, 2):
            marks = [seen(r[5]) for r in rows]
            states = _decoded([model.emission(*m[:3]) for m in marks], model, rows[0][2], rows[0][3])
            begins = [k for k, s in enumerate(states) if k == 0 or s % 2 == 0] + [len(rows)]
            for a, b in zip(begins, begins[1:], strict=False):
                role, text = ROLES[states[a] // 2], "\n".join(m[3] if k == 0 else r[5] for k, (m, r) in enumerate(zip(marks[a:b], rows[a:b], strict=True)))
                out.append((conv_id, rows[a][4], b - a, role, states[a] % 2 == 1, text, f"<|{role}|>\n{text}\n<|end|>\n"))
                if len(out) >= 2000:
                    yield made()
                    out.clear()
        yield made()

    return placed.mapInArrow(turns, f"conv_id {conv}, line_no long, n_lines long, role string, continues boolean, text string, rendered string")


# How transcripts found in the wild mark speakers; {} stands for the text.
STYLES = (
    {"system": "System: {}", "user": "User: {}", "assistant": "Assistant: {}"},
    {"system": "### Instruction\n{}", "user": "Human: {}", "assistant": "AI: {}"},
    {"system": "Context: {}", "user": "Q: {}", "assistant": "A: {}"},
    {"system": "[system] {}", "user": "[user] {}", "assistant": "[assistant] {}"},
    {"system": "<|system|>\n{}", "user": "<|user|>\n{}", "assistant": "<|assistant|>\n{}"},
)
#: Line numbers of a turn begin at its number times this, which is more than the lines that a text can have.
TURN = 1 << 32


def transcript_lines(conversations: DataFrame, unmarked_percent: int = 15) -> DataFrame:
    """(conv_id, line_no, text, role, first): the conversations as raw transcripts, each in one of STYLES, some turns
    without their marker. Both choices follow from the hash of the ids."""
    style = F.pmod(F.xxhash64(F.col("conv_id")), F.lit(len(STYLES)))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100)) < unmarked_percent
    text = F.coalesce("text", F.lit(""))

    def marked() -> Column:
        out = F.when(F.lit(False), text)
        for k, forms in enumerate(STYLES):
            for role, form in forms.items():
                head, _, tail = form.partition("{}")
                out = out.when((style == k) & (F.col("role") == role), F.concat(F.lit(head), text, F.lit(tail)))
        return out.otherwise(text)

    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", F.when(bare, text).otherwise(marked()).alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return rows.select("conv_id", (F.col("turn") * TURN + F.col("at")).alias("line_no"), "text", "role", (F.col("at") == 0).alias("first"))


def formatted(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """The turns recovered from the conversations' transcripts, as parse() gives them. Unless given, the model is fitted
    on the conversations whose crc32(conv_id as text) mod 5 is not 0."""
    lines = transcript_lines(conversations)
    if model is None:
        model = fit(lines.where(crc_mod(F.col("conv_id"), 5) != 0), 256 * TURN)
    return parse(lines, model, 256 * TURN)
