"""Chat formatting with minimum-cost role repair.

A conversation is legal when an automaton accepts its roles: an optional system turn, then user and assistant turns in
alternation, ending with the assistant's. Dynamic programming over the automaton's states picks the cheapest repair:
turns are kept, merged into the turn before, relabelled, or empty turns are inserted. Turns are never dropped and stay
in order. Between equal costs the path whose choices come first in the table of moves wins, so results are definite.

Costs of a turn are a small matrix (state before, state after) for each role, and matrices compose by (min, +), so a
conversation of any length is split into blocks of TURNS turns: each block gives one matrix, the blocks of a conversation
are chained to find the state at every border, and blocks are then repaired on their own.

Turns are range-sorted by conversation and number, so that a hot conversation spreads over tasks. A conversation that
lies within one task and one block is repaired there; turns of the others are counted through, dealt by block, and meet
again. Text is kept but for one thing: "<|" in it gets a zero-width space in the middle, so that it can't pass for a
marker of the format.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import batches_by_key, partitions, small_batches, stored, table, tidy

#: Names of roles and the states after them; state 0 is the start.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: state -> roles that may follow; states in which a conversation may end
NEXT = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user",)}
FINAL = (0, 3)
MERGE, INSERT, RELABEL = 1, 2, 3
#: Turns of a block, the text of one row of the result.
TURNS = 1 << 12
_FAR = 1 << 40


def role_of(role: str | None) -> str | None:
    """The automaton's name of a role; None for one that it doesn't know."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def _moves() -> tuple[dict, dict, dict]:
    """(cost, choice) of reading a turn of each role from state to state, and (cost, inserted roles) of each end.

    A choice is (inserted roles, "new" or "merge", role of the turn).
    """
    reach = {s: [((), s, 0)] for s in range(4)}
    for s in range(4):
        for depth in (1, 2):
            for path in product(ROLES, repeat=depth):
                at = s
                for r in path:
                    at = ROLES.index(r) + 1 if at is not None and r in NEXT[at] else None
                if at is not None:
                    reach[s].append((path, at, INSERT * depth))
    cost, choice = {}, {}
    for role in (*ROLES, None):
        c, pick = np.full((4, 4), _FAR, dtype=np.int64), {}
        for s in range(4):
            for path, at, paid in reach[s]:
                for new in NEXT[at]:
                    options = [(paid + (0 if new == role else RELABEL), ROLES.index(new) + 1, (path, "new", new))]
                    for total, to, how in options:
                        if total < c[s, to]:
                            c[s, to], pick[s, to] = total, how
                if at and not path:
                    total = MERGE + (0 if ROLES[at - 1] == role else RELABEL)
                    if total < c[s, at]:
                        c[s, at], pick[s, at] = total, (path, "merge", ROLES[at - 1])
        cost[role], choice[role] = c, pick
    ends = {s: min(((paid, path) for path, at, paid in reach[s] if at in FINAL), key=lambda x: x[0]) for s in range(4)}
    return cost, choice, ends


COST, CHOICE, ENDS = _moves()


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def block_matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost of a block's turns from each state to each."""
    out = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int64)
    for r in roles:
        out = chained(out, COST[r])
    return out


def best_states(matrices: list[np.ndarray]) -> tuple[int, list[int]]:
    """(cost of the conversation, state before the first block and after each)."""
    costs = [np.array([0, _FAR, _FAR, _FAR], dtype=np.int64)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _FAR))
    total = costs[-1] + np.array([ENDS[s][0] for s in range(4)])
    state = int(total.argmin())
    states = [state]
    for m, c in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        state = int((c + m[:, state]).argmin())
        states.append(state)
    return int(total.min()), states[::-1]


def repaired(roles: list[str | None], texts: list[str], start: int, end: int, last: bool) -> tuple[list[tuple[str, str]], bool]:
    """(turns after repair from state start to end, whether the first goes on with the turn before the block)."""
    costs = [np.where(np.arange(4) == start, 0, _FAR).astype(np.int64)]
    for r in roles:
        costs.append(np.minimum((costs[-1][:, None] + COST[r]).min(axis=0), _FAR))
    state, how = end, []
    for r, c in zip(reversed(roles), reversed(costs[:-1]), strict=True):
        before = int((c + COST[r][:, state]).argmin())
        how.append(CHOICE[r][before, state])
        state = before
    out: list[list] = []
    goes_on = False
    for (path, kind, role), text in zip(reversed(how), texts, strict=True):
        out += [[p, []] for p in path]
        if kind == "new":
            out.append([role, [text]])
        elif out:
            out[-1][1].append(text)
        else:
            goes_on = True
            out.append([role, [text]])
    if last:
        out += [[p, []] for p in ENDS[end][1]]
    return [(role, "\n".join(t for t in parts if t)) for role, parts in out], goes_on


def rendered(turns: list[tuple[str, str]], goes_on: bool = False) -> str:
    """Turns in one text: <|role|> and its text, each closed by <|end|>; a turn that goes on has no opening."""
    out = []
    for k, (role, text) in enumerate(turns):
        out.append(("\n" if goes_on and k == 0 else f"<|{role}|>\n") + text.replace("<|", "<​|"))
    return "\n<|end|>\n".join(out)


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def _whole(conv: int | None, roles: list[str | None], texts: list[str]) -> tuple:
    """(conv_id, cost, n_turns, n_out, roles, text) of a conversation in one block."""
    known = [role_of(r) for r in roles]
    cost, states = best_states([block_matrix(known)])
    turns, _ = repaired(known, texts, states[0], states[1], True)
    return conv, cost, len(roles), len(turns), [r for r, _ in turns], rendered(turns) + "\n<|end|>\n"


def formatted(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, part, parts, cost, n_turns, n_out, roles, text) of each block of each conversation.

    A conversation of up to TURNS turns is one row, whatever their numbers. A longer one has a row for each TURNS turns:
    parts of them, whose texts, joined in order of part, are its rendering; cost is the whole conversation's. Turns
    follow by number, then by role and by a hash of the text; null numbers come first. A null text is empty; a null or unknown role is
    relabelled. Rows without conv_id are one conversation of id null. Repeated rows are turns of their own. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), c["role"].cast("string").alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    # turns of one number follow by role and by a hash of their text, then by the text within a task: bounds of ranges are
    # numbers and roles, never texts; equal turns may be told apart in any way
    order = ["conv_id", "turn", "role", "hashed"]
    parts = partitions(spark, conversations)
    tied = rows.withColumns({"hashed": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    ranged = tied.repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order, "text").drop("turn", "tie", "hashed")
    kinds = {"conv_id": pa.int64(), "cost": pa.int64(), "n_turns": pa.int64(), "n_out": pa.int64(), "roles": pa.list_(pa.string()), "text": pa.string(), "place": pa.int32(), "at": pa.int64(), "role": pa.string()}

    def first(batches):
        """Whole conversations, repaired, and the turns of those that may go on in another task or block."""
        place = TaskContext.get().partitionId()
        held, n, size, conv, is_open = [], 0, 0, None, True  # turns of the current conversation; the first may have begun before

        def left():
            return [(conv, None, None, None, None, text, place, n - len(held) + k, role) for k, (role, text) in enumerate(held)]

        out, begun = [], False
        for batch in batches:
            for at, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if begun and at != conv:
                    out += left() if is_open else [(*_whole(conv, *zip(*held, strict=True)), None, None, None)]
                    held, n, is_open = [], 0, False
                begun, conv = True, at
                held.append((role, text))
                n, size = n + 1, size + len(text)
                if len(held) > turns or is_open and len(held) >= 1000:
                    out, is_open = out + left(), True
                    held = []
                if len(out) >= 1000 or size > 4 << 20:
                    if out:
                        yield _rows(out, kinds)
                    out, size = [], 0
        out += left()
        if out:
            yield _rows(out, kinds)

    known = "conv_id long, cost long, n_turns long, n_out long, roles array<string>, text string"
    taken = stored(ranged.mapInArrow(tidy(first), known + ", place int, at long, role string"))
    done = taken.where("place IS NULL").select("conv_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), "cost", "n_turns", "n_out", "roles", "text")
    # the turns of open conversations, numbered through: places of one conversation follow each other
    mine = F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("place").cast("string"))
    left = taken.where("place IS NOT NULL").select("conv_id", "place", "at", "role", "text", mine.alias("piece"))
    earlier = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = left.groupBy("conv_id", "place", "piece").agg(F.count("*").alias("n")).select("piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    dense = left.join(starts, "piece").withColumn("turn", F.col("start") + F.col("at")).withColumn("block", F.floor(F.col("turn") / turns).cast("long"))
    blocks = dense.select("conv_id", "block", "turn", "role", "text", F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("block").cast("string")).alias("group"))

    def matrices(batches):
        for g in batches_by_key(batches, "group"):
            m = block_matrix([role_of(r) for r in g.column("role").to_pylist()])
            yield _rows([(g.column("conv_id")[0].as_py(), g.column("block")[0].as_py(), m.ravel().tolist())], {"conv_id": pa.int64(), "block": pa.int64(), "costs": pa.list_(pa.int64())})

    costs = blocks.drop("text").repartition(parts, "group").sortWithinPartitions("group", "turn").mapInArrow(tidy(matrices), "conv_id long, block long, costs array<long>")
    chains = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("chain"))
    border = {"group": pa.string(), "part": pa.int32(), "parts": pa.int32(), "cost": pa.int64(), "start": pa.int32(), "stop": pa.int32()}

    def borders(batches):
        for batch in batches:
            out = []
            for conv, chain in zip(batch.column("conv_id").to_pylist(), batch.column("chain").to_pylist(), strict=True):
                total, states = best_states([np.array(x["costs"], dtype=np.int64).reshape(4, 4) for x in chain])
                out += [(f"{'' if conv is None else conv}/{x['block']}", k, len(chain), total, states[k], states[k + 1]) for k, x in enumerate(chain)]
            yield _rows(out, border)

    met = stored(chains.mapInArrow(tidy(borders), "group string, part int, parts int, cost long, start int, stop int"))
    result = {"conv_id": pa.int64(), "part": pa.int32(), "parts": pa.int32(), "cost": pa.int64(), "n_turns": pa.int64(), "n_out": pa.int64(), "roles": pa.list_(pa.string()), "text": pa.string()}

    def repair(batches):
        for g in batches_by_key(batches, "group"):
            conv, part, parts, cost, start, stop = (g.column(k)[0].as_py() for k in ("conv_id", "part", "parts", "cost", "start", "stop"))
            last = part == parts - 1
            turns_, goes_on = repaired([role_of(r) for r in g.column("role").to_pylist()], g.column("text").to_pylist(), start, stop, last)
            text = rendered(turns_, goes_on) + "\n<|end|>\n" * last
            text = "\n<|end|>\n" + text if part and not goes_on else text
            yield _rows([(conv, part, parts, cost, g.num_rows, len(turns_) - goes_on, [r for r, _ in turns_][goes_on:], text)], result)

    long = blocks.join(met, "group").repartition(parts, "group").sortWithinPartitions("group", "turn").mapInArrow(tidy(repair), "conv_id long, part int, parts int, cost long, n_turns long, n_out long, roles array<string>, text string")
    return done.unionByName(long)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))
