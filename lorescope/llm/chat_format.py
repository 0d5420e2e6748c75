"""Operator 3: chat formatting by minimum-cost role repair.

A conversation must read: at most one system turn, first; then user and assistant in
turns, user first, assistant last.  A dynamic program over the automaton of these rules
gives each turn a role, and decides whether it is merged with the turn before it and
whether empty turns are inserted before it, at the least total cost; among equal ones it
takes, from the end backwards, the first state in the order start, system, user,
assistant.  A short turn is merged with one of its role before it (MERGE); a turn of more
than LONG_TURN characters stands by itself (MERGE_LONG is more than INSERT), so an empty
turn of the other role goes between them.  The repaired sequence is then rendered.

A role marker inside a text is escaped: "<|" gets a backslash between its two signs, and
one more where there are some already, so that texts can't forge turns and `unescape`
gives them back exactly.

Turns are ranged and sorted by (conv_id, turn), so a conversation that holds a third of
all rows is cut into fragments, each in one partition.  Conversations inside a partition
are settled there.  Of the fragments at partition edges (two a partition) the 4 x 4
least-cost matrices come to the driver, which composes them; every fragment then knows
the costs before it, says which state each of its end states comes from, and is settled
once the chain of states is known.  The result doesn't depend on the partitions.

Defined results: one row per input row; `rendered` of a conversation's rows, in order,
make up its text.  Rows of one turn number are ordered by a hash of role and text; null
turns come first; rows with a null conv_id are one conversation; a null or unknown role
may become any role at a low cost; a null text is empty; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROLES = ("system", "user", "assistant")
RELABEL, RELABEL_UNKNOWN, MERGE, MERGE_LONG, INSERT = 3, 1, 2, 6, 4
#: Characters beyond which a turn isn't merged if that can be helped.
LONG_TURN = 600
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 40


def moves(merge: int) -> dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]]:
    """(state before, state after): the cheapest way there, as (cost, merged, inserted roles), where a merge costs so much."""
    same = lambda other: min((merge, True, ()), (INSERT, False, (other,)))
    return {
        (START, SYSTEM): (0, False, ()),
        (START, USER): (0, False, ()),
        (START, ASSISTANT): (INSERT, False, (USER,)),
        (SYSTEM, SYSTEM): (merge, True, ()),
        (SYSTEM, USER): (0, False, ()),
        (SYSTEM, ASSISTANT): (INSERT, False, (USER,)),
        (USER, USER): same(ASSISTANT),
        (USER, ASSISTANT): (0, False, ()),
        (ASSISTANT, USER): (0, False, ()),
        (ASSISTANT, ASSISTANT): same(USER),
    }


STEP = {False: moves(MERGE), True: moves(MERGE_LONG)}
#: Cost of ending in a state, and the empty turns inserted there.
END = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def relabel_cost(role: str | None, to: int) -> int:
    if role not in ROLES:
        return RELABEL_UNKNOWN
    return 0 if ROLES[to - 1] == role else RELABEL


Turn = tuple[str | None, bool]


def turns_of(roles: list[str | None], texts: list[str | None]) -> list[Turn]:
    """Role, and whether the text is long."""
    return [(r, len(t or "") > LONG_TURN) for r, t in zip(roles, texts)]


def forward(turns: list[Turn], before: list[int]) -> list[list[int]]:
    """Least cost of each state before every turn and at the end, from the costs before the first."""
    rows = [before]
    for role, long_ in turns:
        last, now = rows[-1], [INF] * 4
        for (q, r), (cost, _, _) in STEP[long_].items():
            c = last[q] + cost + relabel_cost(role, r)
            if c < now[r]:
                now[r] = c
        rows.append(now)
    return rows


def backward(turns: list[Turn], rows: list[list[int]], end: int) -> list[int]:
    """The states of a least-cost path that ends in `end`; the first is the one before the first turn."""
    path = [end]
    for t in range(len(turns) - 1, -1, -1):
        r, step = path[-1], STEP[turns[t][1]]
        path.append(min((rows[t][q] + step[q, r][0], q) for q in range(4) if (q, r) in step)[1])
    return path[::-1]


def best_end(costs: list[int]) -> int:
    return min((costs[q] + END[q][0], q) for q in range(4))[1]


def head(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def repaired(roles: list[str | None], texts: list[str | None], path: list[int], last: bool) -> list[tuple]:
    """(new role, action, inserted before, inserted after, cost, rendered) of each turn."""
    out = []
    for t, (role, text) in enumerate(zip(roles, texts)):
        q, r = path[t], path[t + 1]
        cost, merged, inserted = STEP[len(text or "") > LONG_TURN][q, r]
        cost += relabel_cost(role, r)
        action = "merge" if merged else "keep" if role == ROLES[r - 1] else "relabel"
        segment = "".join(head(x) + "\n" for x in inserted) + ("" if merged else head(r)) + escape(text or "") + "\n"
        after = ()
        if last and t == len(roles) - 1:
            more, after = END[r]
            cost += more
            segment += "".join(head(x) + "\n" for x in after)
        names = lambda xs: ",".join(ROLES[x - 1] for x in xs)
        out.append((ROLES[r - 1], action, names(inserted), names(after), cost, segment))
    return out


def repair(roles: list[str | None], texts: list[str | None]) -> list[tuple]:
    """A whole conversation."""
    turns = turns_of(roles, texts)
    rows = forward(turns, [0, INF, INF, INF])
    return repaired(roles, texts, backward(turns, rows, best_end(rows[-1])), True)


_TURN = "conv_id long, turn long, role string"
_DONE = f"{_TURN}, new_role string, action string, inserted string, closing string, cost long, rendered string"
_FIRST = f"{_DONE}, text string, part int, seq long, edge int, matrix array<long>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("closing", pa.string()), ("cost", pa.int64()), ("rendered", pa.string())])
_ARROW_FIRST = pa.schema([*_ARROW, ("text", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("edge", pa.int32()), ("matrix", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _unit(q: int) -> list[int]:
    return [0 if i == q else INF for i in range(4)]


@C.tidy
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle conversations that neither open nor close the partition; hand on the others' turns, and a matrix for each."""
    part = TaskContext.get().partitionId()

    def fragment(conv, edge):
        ids, turns, roles, texts = conv
        if edge is None:
            return [(ids, t, r, *done, None, part, None, None, None) for t, r, done in zip(turns, roles, repair(roles, texts))]
        none = (None,) * 6
        matrix = [c for q in range(4) for c in forward(turns_of(roles, texts), _unit(q))[-1]]
        rows = [(ids, t, r, *none, x, part, i, edge, None) for i, (t, r, x) in enumerate(zip(turns, roles, texts))]
        return [*rows, (ids, None, None, *none, None, part, len(turns), edge, matrix)]

    conv, n, out = None, 0, []
    for b in batches:
        for c, t, r, x in zip(*(b.column(i).to_pylist() for i in range(4))):
            if conv is None or conv[0] != c:
                if conv is not None:
                    out += fragment(conv, 0 if n == 1 else None)
                conv, n = (c, [], [], []), n + 1
                if len(out) >= 5000:
                    yield _batch(out, _ARROW_FIRST)
                    out = []
            conv[1].append(t)
            conv[2].append(r)
            conv[3].append(x)
    if conv is not None:
        out += fragment(conv, n)
    if out:
        yield _batch(out, _ARROW_FIRST)


def _comes_from(costs):
    """For an edge fragment whose costs before it are known: the state that each end state comes from."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        turns, key = turns_of(table.column("role").to_pylist(), table.column("text").to_pylist()), (table.column("part")[0].as_py(), table.column("edge")[0].as_py())
        rows = forward(turns, costs.value[key])
        return pa.table({"part": pa.array([key[0]], pa.int32()), "edge": pa.array([key[1]], pa.int32()), "origin": pa.array([[backward(turns, rows, r)[0] if rows[-1][r] < INF else -1 for r in range(4)]], pa.list_(pa.int32()))})

    return run


def _finish(known):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        roles, texts = table.column("role").to_pylist(), table.column("text").to_pylist()
        before, end, last = known.value[table.column("part")[0].as_py(), table.column("edge")[0].as_py()]
        turns = turns_of(roles, texts)
        done = repaired(roles, texts, backward(turns, forward(turns, before), end), last)
        rows = [(c, t, r, *d) for c, t, r, d in zip(table.column("conv_id").to_pylist(), table.column("turn").to_pylist(), roles, done)]
        return pa.Table.from_batches([_batch(rows, _ARROW)])

    return run


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action (keep, relabel, merge), inserted and closing (roles of the empty turns before and after), cost, rendered."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = turns.select(turns["conv_id"].cast("long"), turns["turn"].cast("long"), turns["role"], turns["text"]).withColumn("tie", F.xxhash64("role", "text"))
    order = [F.col("conv_id").asc(), F.col("turn").asc(), F.col("tie").asc()]
    first = C.stored(plain.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_settle, _FIRST))
    names = [c.split()[0] for c in _DONE.split(", ")]
    done = first.filter(F.col("edge").isNull()).select(*names)
    edges = first.filter(F.col("matrix").isNotNull()).select("conv_id", "part", "edge", "matrix").collect()  # two for each partition at most
    if not edges:
        return done
    chains: dict = {}
    for e in sorted(edges, key=lambda e: (e.part, e.edge)):
        chains.setdefault(e.conv_id, []).append(e)
    costs, at_end = {}, {}
    for conv, chain in chains.items():
        v = [0, INF, INF, INF]
        for e in chain:
            costs[e.part, e.edge] = v
            v = [min(INF, min(v[q] + e.matrix[4 * q + r] for q in range(4))) for r in range(4)]
        at_end[conv] = best_end(v)
    open_ = first.filter(F.col("edge").isNotNull() & F.col("matrix").isNull())
    groups = open_.groupBy("part", "edge")
    origin = {(r.part, r.edge): r.origin for r in groups.applyInArrow(_comes_from(spark.sparkContext.broadcast(costs)), "part int, edge int, origin array<int>").collect()}
    known = {}
    for conv, chain in chains.items():
        state = at_end[conv]
        for k in range(len(chain) - 1, -1, -1):
            key = chain[k].part, chain[k].edge
            known[key] = costs[key], state, k == len(chain) - 1
            state = origin[key][state]
    return done.unionByName(groups.applyInArrow(_finish(spark.sparkContext.broadcast(known)), _DONE))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
