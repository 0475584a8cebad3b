"""Conversation structure repair: the cheapest edits that give each conversation a legal order of roles.

Initials of a repaired conversation's roles read `(s?(ua)+)?`. Keep costs 0, Rerole to user or
assistant 2, Delete 3, Insert of an empty turn of user or assistant 2; a truncated turn that is not
deleted adds 1; blank and duplicate turns must be deleted. Of the cheapest edits those win whose
initials, in order, come first in ASCII.

The search is a depth-first branch and bound with an explicit stack. A node is a number of turns
done and the role state reached (nothing, after s, after u, after a). A suffix lower bound adds the
least each turn costs whatever its neighbours, and 2 for each of disjoint pairs of turns in a row
that cannot stand together. The incumbent of each final state is a (cost, audit); a node whose bound
cannot beat them is cut, and so is one that its node's dominance table has reached no worse before.
When the stack is empty the incumbents are proved optimal. Of two prefixes that reach a node at one
cost neither begins with the other, so the lesser audit stays the lesser with any suffix.

On Spark: turns alike in turn, role and text collapse to a counted run before they are shuffled (all
but the first of a run are duplicates). Runs are range-partitioned and sorted, which numbers them,
and each 256 numbers make a block. The part of a conversation in a block is solved a few runs at a time, from
every entry state to every exit state, so a conversation of any length is many small searches.
Pieces, and parts in a row, are joined by taking the best (cost, audit) over the state between them. The chosen states give each block its edits, which join the runs by number. Only the digest
of a repaired conversation reads it in one task, as a stream.

Defined results: NULL roles and texts are one space; a NULL conversation is a conversation; turns
come in order of turn (NULL first), role and text; repeated rows are duplicates. An empty role never
fits. `gaps` beyond 64 bits is NULL. Other columns of the input are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pairkit.session import materialize

BLOCK_BITS = 8
JOINED = 64
PIECE = 12
PREFIX = 200
MEMO = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
# class of a turn's initial: 0 s, 1 u, 2 a, 3 other; the state that keeping it leads to
AFTER = {(0, START): SYSTEM, (1, START): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}
LEGAL = {(0, 1), (1, 2), (2, 1)}
TRUNCATED, DOOMED = 4, 8


# ---- the search --------------------------------------------------------------

def suffix_bounds(runs: Sequence[tuple[int, int]]) -> list[int]:
    """bounds[i]: no edits of the runs from i on cost less. runs: (class and faults, copies)."""
    n = len(runs)
    alone, pairs = [0] * (n + 1), [0] * (n + 1)
    following = None  # the next turn that need not go: (class, its index), where it can be kept
    for i in range(n - 1, -1, -1):
        code, copies = runs[i]
        kind, cut = code & 3, 1 if code & TRUNCATED else 0
        pairs[i] = pairs[i + 1]
        if code & DOOMED:
            alone[i] = alone[i + 1] + 3 * copies
            continue
        alone[i] = alone[i + 1] + 3 * (copies - 1) + min(3, (2 if kind == 3 else 0) + cut)
        if kind == 3:
            following = None
            continue
        if following is not None and (kind, following[0]) not in LEGAL:
            pairs[i] = max(pairs[i], 2 + pairs[following[1] + 1])
        following = kind, i
    return [a + p for a, p in zip(alone, pairs)]


def search(runs: Sequence[tuple[int, int]], entry: int, exits: Sequence[int]) -> dict[int, tuple[int, str, tuple]]:
    """The best (cost, audit, steps) from `entry` to each of `exits` that can be reached.

    steps: per edit (run, initial, role given: u, a or -); deleted copies of a run are one step.
    """
    n, bounds = len(runs), suffix_bounds(runs)
    # only s leads to the state after s, and nothing leads back to the start
    apart = {START: entry == START, SYSTEM: entry == SYSTEM or entry == START and any(not code & (3 | DOOMED) for code, _ in runs)}
    exits = [x for x in exits if apart.get(x, True)]
    known: dict[tuple[int, int], tuple[int, str]] = {}
    best: dict[int, tuple[int, str, tuple]] = {}
    stack = [(0, entry, 0, "", None)]

    def hopeless(cost: int, audit: str) -> bool:
        if len(best) < len(exits):
            return False
        for c, a, _ in best.values():
            if cost < c or (cost == c and audit <= a[:len(audit)]):
                return False
        return True

    while stack:
        i, state, cost, audit, path = stack.pop()
        seen = known.get((i, state))
        if (seen is not None and seen <= (cost, audit)) or hopeless(cost + bounds[i], audit):
            continue
        known[i, state] = cost, audit
        given = "a" if state == USER else "u"
        after = ASSISTANT if state == USER else USER
        children = [(i, after, cost + 2, audit + "I", (path, (i, "I", given)))]
        if i == n:
            if state in exits and (state not in best or (cost, audit) < best[state][:2]):
                best[state] = cost, audit, path
        else:
            code, copies = runs[i]
            children.append((i + 1, state, cost + 3 * copies, audit + "D" * copies, (path, (i, "D" * copies, "-"))))
            if not code & DOOMED:
                rest, cut = "D" * (copies - 1), 3 * (copies - 1) + (1 if code & TRUNCATED else 0)
                kept = AFTER.get((code & 3, state))
                if kept is not None:
                    children.append((i + 1, kept, cost + cut, audit + "K" + rest, (path, (i, "K" + rest, "-"))))
                children.append((i + 1, after, cost + 2 + cut, audit + "R" + rest, (path, (i, "R" + rest, given))))
        # the most promising child is taken first
        children.sort(key=lambda c: (c[2] + bounds[c[0]], c[3]), reverse=True)
        stack += children
    out = {}
    for state, (cost, audit, path) in best.items():
        steps = []
        while path is not None:
            path, step = path
            steps.append(step)
        out[state] = cost, audit, tuple(reversed(steps))
    return out


def edits_by_run(n: int, steps: Sequence[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """Per run its edits and, for each, the role given; inserts after the last run go with it."""
    edits, roles = [""] * n, [""] * n
    for i, initials, role in steps:
        at = min(i, n - 1)
        edits[at] += initials
        roles[at] += role + "-" * (len(initials) - 1)
    return list(zip(edits, roles))


def illegal_pairs(runs: Sequence[tuple[int, int]]) -> int:
    """Neighbours whose initials are not su, ua or au; copies never are."""
    return (sum((a[0] & 3, b[0] & 3) not in LEGAL for a, b in zip(runs, runs[1:])) + sum(copies - 1 for _, copies in runs))


Path = tuple[int, int, int, str, str]  # entry, exit, cost, audit, states between the parts


def joined(parts: Sequence[Sequence[Path]]) -> list[Path]:
    """Best paths over parts in a row."""
    found = {(e, x): (cost, audit, via) for e, x, cost, audit, via in parts[0]}
    for part in parts[1:]:
        longer: dict[tuple[int, int], tuple[int, str, str]] = {}
        for (e, m), (cost, audit, via) in found.items():
            for entry, x, more, further, onward in part:
                if entry == m:
                    new = cost + more, audit + further, f"{via}{m}{onward}"
                    if (e, x) not in longer or new[:2] < longer[e, x][:2]:
                        longer[e, x] = new
        found = longer
    return [(e, x, *rest) for (e, x), rest in sorted(found.items())]


def solved(runs: Sequence[tuple[int, int]], entries: Sequence[int], exits: Sequence[int]) -> list[tuple[int, int, int, str, list]]:
    """(entry, exit, cost, audit, edits by run) of the best path between each two states.

    The search's work grows steeply with the number of runs, so it is made over a few at a time.
    """
    pieces = [runs[lo:lo + PIECE] for lo in range(0, len(runs), PIECE)]
    found = []
    for i, piece in enumerate(pieces):
        first, last = i == 0, i == len(pieces) - 1
        found.append({(e, x): (cost, audit, edits_by_run(len(piece), steps)) for e in (entries if first else range(4))
                      for x, (cost, audit, steps) in search(piece, e, exits if last else range(4)).items()})
    whole = joined([[(e, x, cost, audit, "") for (e, x), (cost, audit, _) in part.items()] for part in found])
    out = []
    for e, x, cost, audit, via in whole:
        states = [e, *map(int, via), x]
        out.append((e, x, cost, audit, [step for part, a, b in zip(found, states, states[1:]) for step in part[a, b][2]]))
    return out


# ---- on Spark ----------------------------------------------------------------

PATHS = "array<struct<entry:int,exit:int,cost:bigint,audit:string,via:string>>"
PATHS_ARROW = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("via", pa.string())]))
EDITS_ARROW = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("edits", pa.list_(pa.struct([
    ("row_id", pa.int64()), ("edits", pa.string()), ("roles", pa.string())])))]))


def solve(parts: DataFrame) -> DataFrame:
    """conv, block, first, last, illegal, paths, edits of parts (conv, block, is_first, is_last, runs)."""
    names = ["conv", "block", "first", "last", "illegal", "paths", "edits"]
    schema = ("conv string, block bigint, first int, last int, illegal bigint, paths " + PATHS
              + ", edits array<struct<entry:int,exit:int,edits:array<struct<row_id:bigint,edits:string,roles:string>>>>")
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), PATHS_ARROW, EDITS_ARROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}

        def known(*key):
            if key not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                is_first, is_last, runs = key
                memo[key] = illegal_pairs(runs), solved(runs, (START,) if is_first else range(4), FINAL if is_last else range(4))
            return memo[key]

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                runs = tuple((x["code"], x["copies"]) for x in r["runs"])
                illegal, found = known(r["is_first"], r["is_last"], runs)
                rows.append((r["conv"], r["block"], runs[0][0] & 3, runs[-1][0] & 3, illegal,
                             [dict(zip(("entry", "exit", "cost", "audit", "via"), (e, x, c, a, ""))) for e, x, c, a, _ in found],
                             [{"entry": e, "exit": x, "edits": [{"row_id": o["row_id"], "edits": d, "roles": g} for o, (d, g) in zip(r["runs"], edits)]}
                              for e, x, _, _, edits in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names)

    return parts.select("conv", "block", "is_first", "is_last", "runs").mapInArrow(run, schema)


def join_parts(parts: DataFrame) -> DataFrame:
    """Each group's parts as one. parts: conv, seq, members (block, first, last, illegal, paths, blocks; in order)."""
    names = ["conv", "seq", "first", "last", "illegal", "paths", "blocks"]
    schema = "conv string, seq bigint, first int, last int, illegal bigint, paths " + PATHS + ", blocks array<bigint>"
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), PATHS_ARROW, pa.list_(pa.int64())]
    fields = ("entry", "exit", "cost", "audit", "via")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                m = r["members"]
                paths = joined([[tuple(p[f] for f in fields) for p in x["paths"]] for x in m])
                illegal = sum(x["illegal"] for x in m) + sum((a["last"], b["first"]) not in LEGAL for a, b in zip(m, m[1:]))
                rows.append((r["conv"], r["seq"], m[0]["first"], m[-1]["last"], illegal, [dict(zip(fields, p)) for p in paths],
                             [b for x in m for b in x["blocks"]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names)

    return parts.mapInArrow(run, schema)


def hashed_lines(lines: DataFrame) -> DataFrame:
    """conv, sha256 of its lines joined by newlines. lines: conv, row_id, k, line; read as a stream, in order."""
    order = ["conv", "row_id", "k"]
    rows = lines.select(*order, "line").repartition("conv").sortWithinPartitions(*order).select("conv", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != conv:
                    if conv is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = name, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*done)) or [[], []]], ["conv", "sha256"])
            done = []
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "sha256"])

    return rows.mapInArrow(run, "conv string, sha256 string")


def conversation_key(column: str | Column) -> Column:
    """The conversation as a string that is never NULL."""
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(" "))


class TurnRepair:
    """Repair of all conversations of `rows`.

    `summary`: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, one row per conversation.
    `turns`: conv, row_id, k, role, text, edit (I, K or R), the repaired turns in order of row_id and k.
    `digests()`: conv, sha256 of the repaired `role:text` lines, for conversations with turns left.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        turns = rows.select(conversation_key(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
                            F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
        runs = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
        keys = [F.xxhash64(F.lit(seed), "role", "text").alias(f"key{seed}") for seed in (1, 2)]
        runs = materialize(runs.select("*", *keys), "repair-runs")
        self.order = materialize(self._numbered(runs), "repair-order")
        parts = materialize(solve(self._parts()), "repair-parts")
        whole = materialize(self._joined(parts), "repair-paths")
        self.summary = self._counts().join(whole.select("conv", "illegal", "cost", "audit"), "conv")
        self.turns = self._turns(parts, whole)

    def _numbered(self, runs: DataFrame) -> DataFrame:
        """Runs with their faults, numbered in order."""
        place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        again = (runs.groupBy("conv", "key1", "key2").agg(F.min(place).alias("earliest"), F.count("*").alias("times"))
                 .filter("times > 1").drop("times"))
        trimmed = F.rtrim("text", F.lit(BLANKS))
        initial = F.substring("role", 1, 1)
        kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        marked = runs.join(again, ["conv", "key1", "key2"], "left").select(
            "conv", "turn", "role", "text", "copies", kind.alias("kind"), (trimmed == "").alias("blank"),
            F.coalesce(place == F.col("earliest"), F.lit(True)).alias("first"),
            (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
        code = (F.col("kind") + F.when(F.col("blank") | ~F.col("first"), DOOMED).otherwise(0)
                + F.when(F.col("cut"), TRUNCATED).otherwise(0)).cast("int")
        # whole texts do not serve as range bounds, which pass the driver; a prefix orders alike
        ranged = marked.withColumn("code", code).repartitionByRange("conv", "turn", F.left("role", F.lit(PREFIX)), F.left("text", F.lit(PREFIX)))
        return ranged.sortWithinPartitions("conv", "turn", "role", "text").withColumn("row_id", F.monotonically_increasing_id())

    def _counts(self) -> DataFrame:
        once = F.col("first").cast("int")
        spread = (F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + F.lit(1)
                  - F.count_distinct("turn").cast("decimal(38,0)"))
        return self.order.groupBy("conv").agg(
            F.when(F.max("turn").isNull(), F.lit(0).cast("bigint")).otherwise(spread.try_cast("bigint")).alias("gaps"),
            F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).cast("bigint").alias("blank"),
            F.sum(F.when(~F.col("blank"), F.col("copies") - once).otherwise(0)).cast("bigint").alias("duplicate"),
            F.sum(F.when(~F.col("blank") & F.col("cut"), once).otherwise(0)).cast("bigint").alias("truncated"))

    def _parts(self) -> DataFrame:
        """The runs of each conversation in each block."""
        block = F.shiftright("row_id", BLOCK_BITS)
        parts = self.order.groupBy("conv", block.alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("row_id", "code", "copies"))).alias("runs"))
        ends = self.order.groupBy("conv").agg(F.min(block).alias("lowest"), F.max(block).alias("highest"))
        return parts.join(ends, "conv").select("conv", "block", (F.col("block") == F.col("lowest")).alias("is_first"),
                                               (F.col("block") == F.col("highest")).alias("is_last"), "runs")

    def _joined(self, parts: DataFrame) -> DataFrame:
        """conv, illegal, cost, audit, via, blocks: each conversation's best path, its parts joined in rounds."""
        place = F.row_number().over(Window.partitionBy("conv").orderBy("block")) - 1  # of a 256th of the turns, numbers alone
        level = parts.join(parts.select("conv", "block", place.cast("bigint").alias("seq")), ["conv", "block"]).select(
            "conv", "seq", "first", "last", "illegal", "paths", F.array("block").alias("blocks"))
        while level.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] > 0:
            groups = level.groupBy("conv", F.floor(F.col("seq") / JOINED).alias("group")).agg(
                F.sort_array(F.collect_list(F.struct("seq", "first", "last", "illegal", "paths", "blocks"))).alias("members"))
            level = materialize(join_parts(groups.select("conv", F.col("group").alias("seq"), "members")), "repair-joined")
        fits = F.filter("paths", lambda p: (p.entry == START) & p.exit.isin(*FINAL))
        least = F.array_min(F.transform(fits, lambda p: F.struct(p.cost.alias("cost"), p.audit.alias("audit"), p.exit.alias("exit"), p.via.alias("via"))))
        return level.withColumn("p", least).select("conv", "illegal", "p.cost", "p.audit", "p.exit", "p.via", "blocks")

    def _turns(self, parts: DataFrame, whole: DataFrame) -> DataFrame:
        """The repaired turns."""
        states = F.concat(F.array(F.lit(START)), F.transform(F.filter(F.split("via", ""), lambda x: x != ""), lambda x: x.cast("int")),
                          F.array(F.col("exit")))
        chosen = whole.withColumn("states", states).select("conv", "states", F.posexplode("blocks").alias("at", "block")).select(
            "conv", "block", F.element_at("states", F.col("at") + 1).alias("entry"), F.element_at("states", F.col("at") + 2).alias("exit"))
        each = parts.select("conv", "block", F.inline("edits")).join(chosen, ["conv", "block", "entry", "exit"]).select(F.inline("edits"))
        kept = F.filter(F.transform(F.split("edits", ""), lambda e, k: F.struct(k.alias("k"), e.alias("edit"), F.substring(
            F.col("roles"), k + 1, F.lit(1)).alias("given"))), lambda x: x.edit.isin("I", "K", "R"))
        steps = each.withColumn("kept", kept).select("row_id", "kept").filter(F.size("kept") > 0)
        rows = self.order.select("conv", "row_id", "role", "text").join(steps, "row_id").select("conv", "row_id", "role", "text", F.inline("kept"))
        role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("given") == "u", "user").otherwise("assistant")
        return rows.select("conv", "row_id", "k", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")

    def digests(self) -> DataFrame:
        return hashed_lines(self.turns.withColumn("line", F.concat("role", F.lit(":"), "text")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn; NULLs are one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(conversation_key("conv_id"), F.lit(":"), turn)) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).filter("fate <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repair = TurnRepair(damaged(rows))
    all_ = rows.select("conv_id").distinct().withColumn("conv", conversation_key("conv_id"))
    found = all_.join(repair.summary, "conv", "left").join(repair.digests(), "conv", "left")
    count = lambda c: F.when(F.col("audit").isNull(), F.lit(0).cast("bigint")).otherwise(F.col(c)).alias(c)
    return found.select("conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
