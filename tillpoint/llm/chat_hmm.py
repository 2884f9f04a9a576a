"""Chat formatting: who says what in a plain transcript, by a hidden Markov model.

Every line of a transcript is observed as one symbol made of its speaker
marker (if any), whether it opens a paragraph, its length and whether it ends
with a question mark.  The hidden states are the speaker's role and whether
the line begins a turn.  The model is counted from labelled transcripts;
Viterbi recovers the states, and the lines are rendered as canonical turns.

A transcript may be of any length: its rows are sorted into range partitions,
each piece of a transcript in a partition is summed up as one max-plus matrix,
and the pieces that cross partition borders get their best entry and exit
scores from their neighbours (at most two rows per partition)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import as_frame, materialize
from tillpoint.llm.jaccard_join import whole_groups

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)                       # role * 2 + (0 begins a turn, 1 goes on)
NAMES = {
    "system": ("system", "context", "instructions"),
    "user": ("user", "human", "q", "question", "prompter", "customer", "instruction"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "response", "agent"),
}
_ROLE_OF = {n: i for i, r in enumerate(ROLES) for n in NAMES[r]}
_MARKER = re.compile(r"^\s*(?:#+\s*|\*\*|<\|?|\[)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\|?>|\]|\*\*)?\s*(?::|\n|$)\s*", re.I)
MARKERS = len(ROLES) + 1
SYMBOLS = MARKERS * 2 * 3 * 2
START, END = "<|im_start|>", "<|im_end|>"


def observe(line: str, opens: bool) -> int:
    """The symbol of a line."""
    m = _MARKER.match(line)
    marker = _ROLE_OF[m.group(1).lower()] + 1 if m else 0
    length = 0 if len(line) < 80 else 1 if len(line) < 300 else 2
    return ((marker * 2 + opens) * 3 + length) * 2 + line.rstrip().endswith("?")


def lines_of(text: str | None) -> list[str]:
    """The lines of a row's text that are not blank."""
    return [x for x in (text or "").split("\n") if x.strip()]


def symbols(text: str | None) -> list[int]:
    return [observe(x, i == 0) for i, x in enumerate(lines_of(text))]


class Model:
    """Log probabilities with one added to every count."""

    def __init__(self, begin: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.begin = np.log((begin + 1) / (begin + 1).sum())
        self.move = np.log((move + 1) / (move + 1).sum(axis=1, keepdims=True))
        self.emit = np.log((emit + 1) / (emit + 1).sum(axis=1, keepdims=True))


def fit(labelled: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role",
        text_col: str = "raw") -> Model:
    """Count starts, moves and emissions over all labelled rows; a row is one
    turn.  Roles not in ROLES are left out.  Only the table of counts, of
    fixed size, and two rows per partition reach the driver.

    Moves between rows are counted by a running pair inside range partitions,
    so a long transcript needs no window of its own; where one goes on in the
    next partition, its false start there becomes a move, by the first and last
    transcript and state of each partition."""
    rows = as_frame(labelled, conv=conv_col, at=order_col, role=role_col, raw=text_col).filter(F.col("role").isin(*ROLES))
    kind = rows.schema["conv"].dataType.simpleString()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        conv, last, first = object(), None, None
        for batch in batches:
            conv_type = batch.column("conv").type
            for c, role, raw in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "raw"))):
                for i, symbol in enumerate(symbols(raw)):
                    state = ROLES.index(role) * 2 + (i > 0)
                    emit[state, symbol] += 1
                    if c == conv:
                        move[last, state] += 1
                    else:
                        begin[state] += 1
                    conv, last = c, state
                    first = first or (c, state)
        cells = [(k, int(i), float(x)) for k, t in (("begin", begin), ("move", move), ("emit", emit))
                 for i, x in enumerate(t.ravel()) if x]
        if first is None:
            return
        cells = [(*c, None) for c in cells] + [("first", first[1], 1.0, first[0]), ("last", last, 1.0, conv)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(cells), pa.int32()), pa.array([c[0] for c in cells], pa.string()),
                                          pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.float64()),
                                          pa.array([c[3] for c in cells], conv_type)], names=["part", "kind", "cell", "n", "conv"])

    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are sampled by the texts' hashes, as whole texts would go to the driver.
    order = ["conv", "at", F.xxhash64("raw"), "raw"]
    ordered = rows.repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    tallied = materialize(ordered.mapInArrow(tally, f"part int, kind string, cell int, n double, conv {kind}"), "tallied")
    is_end = F.col("kind").isin("first", "last")
    counted = tallied.filter(~is_end).groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()
    ends = {(r["part"], r["kind"]): r for r in tallied.filter(is_end).collect()}
    tables = {"begin": np.zeros(STATES), "move": np.zeros(STATES * STATES), "emit": np.zeros(STATES * SYMBOLS)}
    for r in counted:
        tables[r["kind"]][r["cell"]] = r["n"]
    found = sorted({part for part, _ in ends})
    for before, here in zip(found, found[1:]):
        left, right = ends[before, "last"], ends[here, "first"]
        if left["conv"] == right["conv"]:
            tables["begin"][right["cell"]] -= 1
            tables["move"][left["cell"] * STATES + right["cell"]] += 1
    return Model(tables["begin"], tables["move"].reshape(STATES, STATES), tables["emit"].reshape(STATES, SYMBOLS))


def _pieces(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Row ranges of equal (part, conv)."""
    part, conv = table.column("part").to_pylist(), table.column("conv").to_pylist()
    at = 0
    for i in range(1, len(part) + 1):
        if i == len(part) or part[i] != part[at] or conv[i] != conv[at]:
            yield at, i
            at = i


def matrix(obs: list[int], m: tuple) -> np.ndarray:
    """Best score to each state at the piece's end from each state before it,
    and (last row) from the beginning of a transcript."""
    begin, move, emit = m
    total = np.vstack([move, begin]) + emit[:, obs[0]]
    for o in obs[1:]:
        total = (total[:, :, None] + move[None]).max(axis=1) + emit[:, o]
    return total


def viterbi(obs: list[int], m: tuple, entry: np.ndarray | None, leave: np.ndarray | None) -> list[int]:
    """The best states of a piece; ``entry``: best score of each state just
    before it (None: it begins the transcript), ``leave``: from each state at
    its end to the end of the transcript (None: it ends there)."""
    begin, move, emit = m
    back = np.zeros((len(obs), STATES), np.int64)
    score = entry
    for i, o in enumerate(obs):
        if score is None:
            score = begin + emit[:, o]
            continue
        ways = score[:, None] + move
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emit[:, o]
    state = int((score if leave is None else score + leave).argmax())
    path = []
    for i in range(len(obs) - 1, -1, -1):
        path.append(state)
        state = int(back[i, state])
    return path[::-1]


def borders(totals: list[np.ndarray]) -> list[tuple]:
    """(entry, leave) of each piece of one transcript, from the pieces' matrices."""
    ins, outs, score = [], [], None
    for total in totals:
        ins.append(score)
        score = total[STATES] if score is None else (score[:, None] + total[:STATES]).max(axis=0)
    score = None
    for total in reversed(totals):
        outs.append(score)
        score = (total[:STATES] if score is None else total[:STATES] + score).max(axis=1)
    return list(zip(ins, reversed(outs)))


def decode(transcripts: DataFrame, model: Model, conv_col: str = "conv_id", order_col: str = "turn",
           text_col: str = "raw") -> DataFrame:
    """Rows of transcripts -> ``key, states, first, last``: the states of a
    row's lines that are not blank, and whether the row begins or ends its
    transcript.  ``key`` is a hash of transcript, order and text; rows that
    agree in all three are one row.  Rows without a line are left out; rows tie
    in their order by the hash; null transcript ids are one transcript."""
    spark = transcripts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = as_frame(transcripts, conv=conv_col, at=order_col, raw=text_col)
    kind, order_kind = (rows.schema[c].dataType.simpleString() for c in ("conv", "at"))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [symbols(t) for t in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("at"), b.column("key"), pa.array(seen, pa.list_(pa.int16()))],
                                             names=["conv", "at", "key", "seen"])

    seen = rows.withColumn("key", F.xxhash64("conv", "at", "raw")).mapInArrow(see, f"conv {kind}, at {order_kind}, key long, seen array<short>")
    seen = seen.filter("size(seen) > 0").dropDuplicates(["key"])
    order = ["conv", "at", "key"]
    placed = materialize(seen.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "placed")
    # Only the first and the last transcript of a partition can go on elsewhere.
    ends = placed.groupBy("part").agg(F.min(F.struct("conv")).alias("a"), F.max(F.struct("conv")).alias("b"))
    ends = materialize(ends.select("part", F.explode(F.array("a.conv", "b.conv")).alias("conv")).distinct(), "ends")
    crossing = ends.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("c"))
    ends = ends.join(crossing, F.col("conv").eqNullSafe(F.col("c")), "left_semi").select(F.col("part").alias("p"), F.col("conv").alias("c"))
    shared = spark.sparkContext.broadcast((model.begin, model.move, model.emit))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            for a, b in _pieces(table):
                obs = [o for row in table.column("seen").slice(a, b - a).to_pylist() for o in row]
                yield pa.RecordBatch.from_arrays(
                    [table.column("part").slice(a, 1).combine_chunks(), table.column("conv").slice(a, 1).combine_chunks(),
                     pa.array([matrix(obs, shared.value).ravel().tolist()], pa.list_(pa.float64()))], names=["part", "conv", "total"])

    # At most two transcripts per partition.
    touched = placed.join(F.broadcast(ends), (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    touched = touched.select("part", *order, "seen").repartition(parts, "part").sortWithinPartitions("part", *order)
    found = touched.mapInArrow(summed, f"part int, conv {kind}, total array<double>").collect()
    pieces: dict = {}
    for r in sorted(found, key=lambda r: r["part"]):
        pieces.setdefault(r["conv"], []).append((r["part"], np.array(r["total"]).reshape(STATES + 1, STATES)))
    around = spark.sparkContext.broadcast({(part, conv): b for conv, run in pieces.items()
                                           for (part, _), b in zip(run, borders([t for _, t in run]))})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            states, first, last = [], [], []
            for a, b in _pieces(table):
                seen = table.column("seen").slice(a, b - a).to_pylist()
                entry, leave = around.value.get((table.column("part")[a].as_py(), table.column("conv")[a].as_py()), (None, None))
                path = viterbi([o for row in seen for o in row], shared.value, entry, leave)
                at = 0
                for i, row in enumerate(seen):
                    states.append(path[at:at + len(row)])
                    first.append(i == 0 and entry is None)
                    last.append(i == len(seen) - 1 and leave is None)
                    at += len(row)
            yield pa.RecordBatch.from_arrays(
                [table.column("key").combine_chunks(), pa.array(states, pa.list_(pa.int16())), pa.array(first, pa.bool_()), pa.array(last, pa.bool_())],
                names=["key", "states", "first", "last"])

    ordered = placed.select("part", *order, "seen").repartition(parts, "part").sortWithinPartitions("part", *order)
    return materialize(ordered.mapInArrow(solve, "key long, states array<short>, first boolean, last boolean"), "states")


def render(text: str | None, states: list[int] | None, first: bool, last: bool) -> str:
    """The canonical form of a row's lines: the fragments of a transcript's
    rows, put together in order, are its turns."""
    out = []
    for i, (line, state) in enumerate(zip(lines_of(text), states or ())):
        m = _MARKER.match(line)
        begins = state % 2 == 0 or (first and i == 0)
        if begins:
            out.append(("" if first and i == 0 else END + "\n") + START + ROLES[state // 2] + "\n")
        body = (line[m.end():] if m and begins else line).strip()
        if body:
            out.append(body + "\n")
    return "".join(out) + (END + "\n" if last else "")


def format_chats(transcripts: DataFrame, model: Model, conv_col: str = "conv_id", order_col: str = "turn",
                 text_col: str = "raw") -> DataFrame:
    """``transcripts`` rows -> ``conv_id, turn, key, roles, rendered``: the
    recovered role of each line and the row's part of the canonical text, one
    row per input row; null roles and an empty part for a row without lines.

    Null texts count as empty, null ids are one transcript and null orders come
    first; repeated rows get equal results; an empty table gives an empty one."""
    states = decode(transcripts, model, conv_col, order_col, text_col)
    rows = as_frame(transcripts, conv_id=conv_col, turn=order_col, raw=text_col).withColumn("key", F.xxhash64("conv_id", "turn", "raw"))
    both = rows.join(states, "key", "left")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, states, first, last = (b.column(c).to_pylist() for c in ("raw", "states", "first", "last"))
            roles = [[ROLES[x // 2] for x in s] if s else None for s in states]
            text = [render(*row) for row in zip(raw, states, first, last)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("key"),
                                              pa.array(roles, pa.list_(pa.string())), pa.array(text, pa.string())],
                                             names=["conv_id", "turn", "key", "roles", "rendered"])

    return both.select("conv_id", "turn", "key", "raw", "states", "first", "last").mapInArrow(
        write, f"conv_id {kinds[0]}, turn {kinds[1]}, key long, roles array<string>, rendered string")


def held_out(conv_col: str = "conv_id"):
    return F.coalesce(F.crc32(F.col(conv_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


# Speaker markers of the transcripts made from the table of conversations.
STYLES = ({"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
          {"system": "Context: ", "user": "Human: ", "assistant": "AI: "},
          {"system": "Instructions: ", "user": "Q: ", "assistant": "A: "},
          {"system": "### System:\n", "user": "### Instruction:\n", "assistant": "### Response:\n"})


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """Plain transcripts made from labelled turns: each conversation has one
    style of markers, and about a quarter of the turns lost theirs."""
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    style = F.pmod(number(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(len(STYLES)))
    marked = number(F.concat_ws(":", "conv_id", "turn")) % 4 > 0
    marker = F.lit("")
    for i, s in enumerate(STYLES):
        for role, text in s.items():
            marker = F.when(marked & (style == i) & (F.col("role") == role), F.lit(text)).otherwise(marker)
    return conversations.select("conv_id", "turn", "role", F.concat(marker, F.coalesce("text", F.lit(""))).alias("raw"))
