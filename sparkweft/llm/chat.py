"""Chat formatting: repair the roles of a conversation at minimum cost, then render it.

Legal turns: at most one system turn, first; then user and assistant in turn, user
first, assistant last. Each turn keeps its role or is relabelled; where two turns of
one role meet they merge; where a turn is missing an empty one goes in. The cheapest
repair is a shortest path over the automaton's states (start, system, user,
assistant). Costs depend on roles only, and a stretch of turns is a 4 x 4 matrix under
(min, +), so a long conversation is cut into blocks of turns: blocks are reduced to
matrices in parallel, a conversation's matrices give every block its first and last
state, and each block then finds its own path. No task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parts

#: Turns of a block, by turn number; turns of one block above which it is split, by turn and by the hash of role and text.
BLOCK, MOST = 256, 1024
_KEY = "struct<b:bigint,t:bigint,s:bigint>"
_KEY_PA = pa.struct([("b", pa.int64()), ("t", pa.int64()), ("s", pa.int64())])
ROLES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, ADAPT, MERGE, INSERT = 3, 1, 1, 2
INF = 10**9
#: Roles in other words (fixed values).
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
OPEN, CLOSE, GLUE = "<|im_start|>", "<|im_end|>\n", "\n\n"

#: What goes in empty before role ``to`` after state ``at``; None: not legal. A system turn comes first only.
GAPS: dict[tuple[int, int], list[int] | None] = {
    (START, SYSTEM): [], (SYSTEM, SYSTEM): [], (USER, SYSTEM): None, (ASSISTANT, SYSTEM): None,
    (START, USER): [], (SYSTEM, USER): [], (USER, USER): [], (ASSISTANT, USER): [],
    (START, ASSISTANT): [USER], (SYSTEM, ASSISTANT): [USER], (USER, ASSISTANT): [], (ASSISTANT, ASSISTANT): [],
}
#: What closes a conversation after a state.
ENDS = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def role_code(role: str | None) -> int:
    """The role's number; 0 for a role that is missing or unknown, which any label suits at a small cost."""
    return ALIASES.get((role or "").strip().lower(), 0)


def step_cost(role: int, at: int, to: int) -> int:
    """Cost of giving the label ``to`` to a turn of ``role`` after state ``at``."""
    gap = GAPS[at, to]
    if gap is None:
        return INF
    label = 0 if role == to else ADAPT if role == 0 else RELABEL
    return label + INSERT * len(gap) + MERGE * (at == to)


def turn_matrix(role: int) -> list[int]:
    """The matrix of one turn: 16 costs from state to state, then the order of the ways on from each state, which is that of the labels."""
    return [step_cost(role, at, to) if to else INF for at in range(4) for to in range(4)] + [0, 1, 2, 3] * 4


TURNS = [turn_matrix(r) for r in range(4)]


def onward(cost: list[int], order: list[int], m: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Costs of the states after a turn or a block, the order of the labels on the way to each, and the state before.

    Of equally cheap ways to a state that of the smallest labels, compared from the front, is
    taken: the ways up to here have an order, and those that go on from one state have one
    within the matrix. So the outcome doesn't depend on where a conversation is cut.
    """
    way = [min(range(4), key=lambda k, j=j: (min(INF, cost[k] + m[4 * k + j]), order[k])) for j in range(4)]
    ranked = sorted(range(4), key=lambda j: (order[way[j]], m[16 + 4 * way[j] + j]))
    return [min(INF, cost[way[j]] + m[4 * way[j] + j]) for j in range(4)], [ranked.index(j) for j in range(4)], way


def _from(state: int) -> tuple[list[int], list[int]]:
    return [0 if i == state else INF for i in range(4)], [0, 1, 2, 3]


def block_matrix(roles: list[int]) -> list[int]:
    """Cheapest cost from each state to each after all turns of the block, row by row, then the order of these ways from each state."""
    costs, orders = [], []
    for first in range(4):
        cost, order = _from(first)
        for r in roles:
            cost, order, _ = onward(cost, order, TURNS[r])
        costs += cost
        orders += order
    return costs + orders


def _back(ways: list[list[int]], at: int) -> list[int]:
    """The states after each step on the way that ends at ``at``, and the one before the first."""
    out = [at]
    for way in reversed(ways):
        out.append(at := way[at])
    return out[::-1]


def borders(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """First and last state of every block on the cheapest way through all of them; of equal ones that of the smallest labels from the front."""
    (cost, order), ways = _from(START), []
    for m in matrices:
        cost, order, way = onward(cost, order, m)
        ways.append(way)
    states = _back(ways, min(range(4), key=lambda j: (cost[j] + INSERT * len(ENDS[j]), order[j])))
    return list(zip(states, states[1:], strict=False))


def block_labels(roles: list[int], first: int, last: int) -> list[int]:
    """Labels of the block's turns on its cheapest path from state ``first`` to ``last``; of equal ones the smallest labels from the front."""
    (cost, order), ways = _from(first), []
    for r in roles:
        cost, order, way = onward(cost, order, TURNS[r])
        ways.append(way)
    return _back(ways, last)[1:]


def safe(text: str | None) -> str:
    """The text without marks of its own."""
    return (text or "").replace("<|im_", "< |im_")


def empty_turns(roles: list[int]) -> str:
    return "".join(f"{OPEN}{ROLES[r]}\n{CLOSE}" for r in roles)


def streamed(rows: DataFrame, order: list[Column | str], make: Callable[[list[dict]], list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows of one (conv_id, block) at a time, in order: partitions are sorted and read as streams."""
    spread = rows.repartition(parts(rows), "conv_id", "block").sortWithinPartitions("conv_id", "block", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["conv_id"], r["block"]) != key:
                    if group:
                        out += make(group)
                    key, group = (r["conv_id"], r["block"]), []
                group.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if group:
            yield pa.RecordBatch.from_pylist(make(group), schema)

    return spread.mapInArrow(run, ddl)


def with_blocks(plain: DataFrame) -> DataFrame:
    """Adds ``h``, the order of turns of one number, and ``block``, a key that sorts like the turns.

    A block is BLOCK turn numbers. Where more than MOST rows share them (many rows of one
    number, or of none), each number is a block, cut further by the hash ``h``.
    """
    number = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40)))
    zero = F.lit(0).cast("long")
    rows = cut(plain.withColumn("h", F.xxhash64("role", "text")).withColumn("b", number))
    heavy = cut(rows.groupBy("conv_id", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).select(F.col("conv_id").alias("c"), F.col("b").alias("k")))
    if heavy.isEmpty():
        return rows.withColumn("block", F.struct("b", zero.alias("t"), zero.alias("s"))).drop("b")
    at = F.coalesce("turn", F.lit(-(1 << 62)))
    inside = rows.join(heavy, rows["conv_id"].eqNullSafe(F.col("c")) & (rows["b"] == F.col("k")), "left_semi")
    shares = inside.groupBy(F.col("conv_id").alias("c"), at.alias("at")).agg(F.ceil(F.count(F.lit(1)) / MOST).alias("shares"))
    joined = rows.join(shares, rows["conv_id"].eqNullSafe(F.col("c")) & (at == F.col("at")), "left")
    share = F.least(F.col("shares") - 1, F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("shares")))
    split = F.col("shares").isNotNull()
    block = F.struct("b", F.when(split, at).otherwise(zero).alias("t"), F.when(split, share).otherwise(zero).alias("s"))
    return cut(joined.withColumn("block", block).select("conv_id", "turn", "role", "text", "h", "block"))


def repair(turns: DataFrame) -> DataFrame:
    """Repair and render conversations: conv_id, turn, order, role, action, new_role, inserted, rendered.

    One row per distinct (conv_id, turn, role, text): exact repeats are one turn. Turns
    of one number go by a hash of role and text; a null number comes first, a null conv_id
    is a conversation of its own. ``action`` is keep, relabel or merge (a merged turn goes on
    with the one before, relabelled or not); ``inserted`` names the empty turns put in
    before it. A conversation's ``rendered`` pieces, joined in the order of turn and
    ``order`` (the hash), are the repaired conversation; its last row also closes it. Null and empty
    texts are turns with no text; marks within texts are broken up. Unknown roles cost
    less to relabel than known ones. Of equally cheap repairs that of the smallest labels (in
    the order of ROLES), compared turn by turn from the front, is taken. A long conversation, or many rows of one turn number,
    are cut into blocks; a very long text is one row of its task. An empty table gives an empty result. Other
    columns are left out, whatever their names.
    """
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    rows = with_blocks(plain)
    order: list[Column | str] = [F.col("turn").asc_nulls_first(), "h", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    conv = dict((f.name, f) for f in rows.schema)["conv_id"].dataType
    conv_pa = pa.int64() if conv.typeName() == "long" else pa.int32() if conv.typeName() == "integer" else pa.string()

    def matrix(group: list[dict]) -> list[dict]:
        return [{"conv_id": group[0]["conv_id"], "block": group[0]["block"], "m": block_matrix([role_code(r["role"]) for r in group])}]

    blocks = streamed(
        rows, order, matrix, pa.schema([("conv_id", conv_pa), ("block", _KEY_PA), ("m", pa.list_(pa.int64()))]), f"conv_id {conv.simpleString()}, block {_KEY}, m array<bigint>",
    )

    @F.arrow_udf("array<array<int>>")
    def ways(m: pa.Array) -> pa.Array:
        return pa.array([[list(x) for x in borders(one)] for one in m.to_pylist()], pa.list_(pa.list_(pa.int32())))

    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("b"))
    ends = whole.withColumn("way", ways(F.col("b.m"))).select(
        F.col("conv_id").alias("c"), F.explode(F.arrays_zip(F.col("b.block").alias("block"), F.col("way").alias("way"))).alias("x"), F.element_at("b.block", -1).alias("end")
    )
    ends = ends.select("c", F.col("x.block").alias("k"), F.col("x.way")[0].alias("first"), F.col("x.way")[1].alias("last"), (F.col("end") == F.col("x.block")).alias("closes"))
    joined = rows.join(ends, rows["conv_id"].eqNullSafe(F.col("c")) & (rows["block"] == F.col("k"))).drop("c", "k")

    def render(group: list[dict]) -> list[dict]:
        roles, at, out = [role_code(r["role"]) for r in group], group[0]["first"], []
        for r, code, to in zip(group, roles, block_labels(roles, at, group[0]["last"]), strict=True):
            gap, merge = GAPS[at, to] or [], at == to
            start = GLUE if merge else (CLOSE if at != START else "") + empty_turns(gap) + f"{OPEN}{ROLES[to]}\n"
            action = "merge" if merge else "keep" if code == to else "relabel"
            out.append({"conv_id": r["conv_id"], "turn": r["turn"], "order": r["h"], "role": r["role"], "action": action, "new_role": ROLES[to], "inserted": [ROLES[g] for g in gap], "rendered": start + safe(r["text"])})
            at = to
        if group[0]["closes"]:
            out[-1]["rendered"] += CLOSE + empty_turns(ENDS[at])
        return out

    schema = pa.schema([("conv_id", conv_pa), ("turn", pa.int64()), ("order", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("new_role", pa.string()), ("inserted", pa.list_(pa.string())), ("rendered", pa.string())])
    return streamed(joined, order, render, schema, f"conv_id {conv.simpleString()}, turn bigint, order bigint, role string, action string, new_role string, inserted array<string>, rendered string")

