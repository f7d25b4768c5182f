"""Chat formatting in budgeted windows (operator 4).

Turns get token counts; prefix sums of them (in the order turn, role, text)
place every turn in its conversation. Sections of ``section_tokens`` follow from
the prefix sums alone, so a conversation of any length is dealt to many tasks;
inside a section turn-aligned spans are packed into windows of ``budget`` tokens.
A window holds the conversation's system turn (its first turn, if a system one),
up to ``history_tokens`` of whole turns before the span, and the span. Loss is
taken on the assistant texts of the span alone: what a window repeats is masked.
A turn that is too long for the budget has a window of its own (``over_budget``).

The system turn is repeated whole in every window that can hold it. Where it is over
the budget by itself, or the span's first turn keeps the budget only without it, a
system turn that says ``MARKER`` stands instead (``system_marked``), or none if the
marker takes more than a quarter of the budget; a system turn of up to that quarter
always stays. A window has at most the budget or one turn besides the system turn, so
all windows together stay linear in the input. A given ``system_tokens`` is a limit:
a longer system turn is never repeated, a shorter one always.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. In roles and
texts a backslash is doubled, ``<|`` becomes ``<\\|``, and a newline in a role
becomes ``\\n``; so control strings only ever come from the template, and
``parse`` gives roles and texts back exactly.

Defined results: null text and null role are empty; a null turn comes before
others; rows with a null conv_id are one conversation; repeated rows are turns
of their own; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, partitions, written
from .tokenizers import VOCABULARY, encode, load

BUDGET, HISTORY_TOKENS, SECTION_TOKENS = 1024, 256, 1 << 16
START, END = "<|im_start|>", "<|im_end|>"
#: Share of the budget up to which a system turn is repeated beside any span, unless ``system_tokens`` is given.
SYSTEM_SHARE = 0.25
#: What stands for a system turn in a window that cannot hold it.
MARKER = "[The system turn at the start of this conversation applies.]"
#: Tokens that the template adds to a turn: start, newline, end, newline.
FRAME_TOKENS = 4

WINDOW = ("conv_id long, first_turn long, n_turns int, n_system int, n_history int, n_tokens long, "
          "over_budget boolean, system_marked boolean, formatted string, loss array<struct<start:long,stop:long>>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of the text in it)."""
    head = f"{START}{escape(role)}".replace("\n", "\\n") + "\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.partition("\n")
        out.append((unescape(role), unescape(text[:-len(END) - 1])))
    return out


def _count(path: str):
    """Tokens of each turn, and running sums inside this partition for each conversation.
    The partition is sorted, so one conversation is open at a time."""
    def run(batches):
        from pyspark import TaskContext

        encoding, _ = load(path)
        part, now, tokens, index = TaskContext.get().partitionId(), object(), 0, 0
        for batch in batches:
            cost, start, at = [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    now, tokens, index = conv, 0, 0
                n = len(encode(encoding, escape(role))) + len(encode(encoding, escape(text))) + FRAME_TOKENS
                cost.append(n)
                start.append(tokens)
                at.append(index)
                tokens, index = tokens + n, index + 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "role", "text")),
                 *(pa.array(x, pa.int64()) for x in (cost, start, at, [part] * n))],
                names=["conv_id", "role", "text", "tokens", "start", "idx", "part"])
    return run


def placed_turns(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every turn with its tokens, its number ``idx`` and the tokens before it ``start``."""
    n = partitions(turns.sparkSession)
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = ["conv_id", "turn", "role", "text"]
    ranged = src.repartitionByRange(n, "conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    local = written(arrow_map(ranged, _count(vocabulary), "conv_id long, role string, text string, tokens long, "
                              "start long, idx long, part long"), "chat-turns")
    # a conversation that runs over several partitions: what stands before each of its later ones. A
    # partition continues one conversation at most, so this table has fewer rows than there are partitions.
    sums = local.groupBy("conv_id", "part").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("conv_id").alias("of"), F.col("part").alias("p"), F.sum("t").over(w).alias("t"),
                       F.sum("c").over(w).alias("c")).where("t IS NOT NULL")
    out = local.join(F.broadcast(base), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")),
                     "left")
    return out.select("conv_id", "role", "text", "tokens", (F.col("start") + F.coalesce("t", F.lit(0))).alias("start"),
                      (F.col("idx") + F.coalesce("c", F.lit(0))).alias("idx"))


def _windows(budget: int, history_tokens: int, system_tokens: int, always_tokens: int, path: str):
    """Rows come by section in turn order: a copy of the system turn (kind 0), copies of
    the turns before the section (1), its own turns (2)."""
    def pack(rows):
        system = [r for r in rows if r[0] == 0] or [r for r in rows if r[1] == 0 and r[2] == "system"]
        system, marker = system[:1], []
        if system and system[0][4] > always_tokens:
            encoding, _ = load(path)
            cost = len(encode(encoding, "system")) + len(encode(encoding, MARKER)) + FRAME_TOKENS
            marker = [(0, 0, "system", MARKER, cost)] if cost <= always_tokens else []

        def whole(turn, first):
            """Whether the system turn is repeated before a span with this first turn."""
            return turn <= always_tokens or turn <= system_tokens and (turn + first <= budget or first > budget)

        own = [r for r in rows if r[0] == 2]
        before = [r for r in rows if r[0] == 1]
        at = 0
        while at < len(own):
            top = [r for r in system if r[1] != own[at][1]]
            marked = bool(top) and not whole(top[0][4], own[at][4])
            if marked:
                top = marker
            used = sum(r[4] for r in top)
            past, room = [], min(history_tokens, budget - used - own[at][4])
            for r in reversed(before):
                if r[4] > room or (top and r[1] == 0):
                    break
                past.insert(0, r)
                room -= r[4]
            used += sum(r[4] for r in past)
            span = [own[at]]
            used += own[at][4]
            while at + len(span) < len(own) and used + own[at + len(span)][4] <= budget:
                used += own[at + len(span)][4]
                span.append(own[at + len(span)])
            texts, loss, place = [], [], 0
            for k, r in enumerate([*top, *past, *span]):
                turn, lo, hi = format_turn(r[2], r[3])
                if k >= len(top) + len(past) and r[2] == "assistant":
                    loss.append({"start": place + lo, "stop": place + hi})
                texts.append(turn)
                place += len(turn)
            yield (span[0][1], len(span), len(top), len(past), used, used > budget, marked and bool(top),
                   "".join(texts), loss)
            before, at = [*before, *span], at + len(span)
            keep, total = [], 0  # no longer history than can be repeated
            for r in reversed(before):
                total += r[4]
                if total > history_tokens:
                    break
                keep.insert(0, r)
            before = keep

    def run(batches):
        now, rows, last = None, [], None
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(),
                 pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        names = ["conv_id", "first_turn", "n_turns", "n_system", "n_history", "n_tokens", "over_budget",
                 "system_marked", "formatted", "loss"]

        def give(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)],
                                              names=names)
        for batch in batches:
            found = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "section", "kind", "idx", "role", "text",
                                                                 "tokens"))):
                if now is not None and r[:2] != now:
                    found += [(last, *x) for x in pack(rows)]
                    rows = []
                now, last = r[:2], r[0]
                rows.append(r[2:])
            if found:
                yield give(found)
        if rows:
            yield give([(last, *x) for x in pack(rows)])
    return run


def chat_windows(turns: DataFrame, *, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
                 section_tokens: int = SECTION_TOKENS, system_tokens: int | None = None,
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per window: conv_id, first_turn (number of the span's first turn), n_turns of the
    span, n_system and n_history (repeated turns at the top), n_tokens, over_budget, system_marked
    (the repeated system turn is the marker), formatted, loss (code point spans)."""
    always_tokens = int(budget * SYSTEM_SHARE) if system_tokens is None else system_tokens
    if system_tokens is None:
        system_tokens = budget
    rows = placed_turns(turns, vocabulary).withColumn("section", F.floor(F.col("start") / section_tokens))
    # a turn is also history for the sections after its own that begin close enough behind its end; one that
    # is longer than any history is not copied: it only ends the history there
    last = rows.groupBy("conv_id").agg(F.max("section").alias("sections")).where("sections > 0")
    later = rows.withColumnRenamed("conv_id", "of").join(
        last, F.col("of").eqNullSafe(F.col("conv_id"))).drop("conv_id").withColumnRenamed("of", "conv_id")
    end = F.col("start") + F.col("tokens")
    past = later.withColumn("first", F.greatest(F.col("section") + 1, F.floor(end / section_tokens))).withColumn(
        "reach", F.floor((end + history_tokens) / section_tokens)).where("first <= reach AND first <= sections")
    past = past.withColumn("text", F.when(F.col("tokens") <= history_tokens, F.col("text"))).withColumn(
        "section", F.explode(F.sequence("first", F.least("reach", "sections"))))
    # a system turn over the limit is not copied: its sections only need to know of it
    top = later.where("idx = 0 AND role = 'system'").withColumn(
        "text", F.when(F.col("tokens") <= system_tokens, F.col("text"))).withColumn(
        "section", F.explode(F.sequence(F.lit(1).cast("long"), F.col("sections"))))
    cols = ["conv_id", "section", "kind", "idx", "role", "text", "tokens"]
    every = (rows.withColumn("kind", F.lit(2)).select(cols)
             .unionByName(past.withColumn("kind", F.lit(1)).select(cols))
             .unionByName(top.withColumn("kind", F.lit(0)).select(cols)))
    every = every.repartition(partitions(turns.sparkSession), "conv_id", "section").sortWithinPartitions(
        "conv_id", "section", "idx", "kind")
    return arrow_map(every, _windows(budget, history_tokens, system_tokens, always_tokens, vocabulary), WINDOW)


def _digest():
    """Rows come by conversation in window order; the digests run along, so a
    conversation of any length needs a window's memory."""
    def run(batches):
        state = None

        def row():
            return (state["id"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(),
                    state["formatted"])

        def give(found):
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)],
                                              names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                                     "formatted_chars"])
        for batch in batches:
            found = []
            for conv, repeated, formatted, loss in zip(
                    batch.column("conv_id").to_pylist(), batch.column("repeated").to_pylist(),
                    batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                if state is None or conv != state["id"]:
                    if state is not None:
                        found.append(row())
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(),
                             "formatted": 0}
                for role, text in parse(formatted)[repeated:]:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"]:span["stop"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["formatted"] += len(formatted)
            if found:
                yield give(found)
        if state is not None:
            yield give([row()])
    return run


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its windows."""
    rows = windows.select("conv_id", "first_turn", (F.col("n_system") + F.col("n_history")).alias("repeated"),
                          "formatted", "loss")
    rows = rows.repartition(partitions(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "first_turn")
    return arrow_map(rows, _digest(), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                     "loss_sha256 string, formatted_chars long")
