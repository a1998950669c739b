"""Repair of the order of roles in conversations by Wagner-Fischer alignment with targets.

A conversation should read `(s?(ua)+)?`: turns of user and assistant in pairs, after a system turn or none. Its rows are aligned
with each feasible length of that string; only cells that can lie on a path as cheap as the cheapest one so far (Ukkonen's band) are
filled. Each alignment is traced back to its ASCII-least audit, and the cheapest audits are compared.
Keep (K) costs 0, Rerole (R) to user or assistant 3, Insert (I) of an empty user or assistant turn 3, Delete (D) 4;
a truncated row that is not deleted costs 3 more, and a blank or duplicate row must be deleted.

Spark gathers the rows of a conversation and writes what matters of each as one letter; only these letters go to
Python, whose alignments of equal letters are kept. Conversations of more than LONG rows are cut into pieces of PIECE rows: a piece is
aligned from every role that may come before it to every role it may end with, pieces are folded FOLD at a time, level by level, until the cheapest way
through all of them is known, and each piece then gets its part of it. Inserts belong to the row after them, so pieces can be told apart
by what they end with alone, and the result is that of the whole.

Rows come in the order of turn (nulls first), then of role and text. Null role and text are one space. Null conversations are one conversation.
Repeated rows are duplicates. Empty tables give empty results. Texts may have any length; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import maybe_broadcast, saved

REROLE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
LONG, PIECE, FOLD = 64, 32, 1024
#: Where a conversation may stand: at its beginning, after the system turn, after a user's or an assistant's.
START, SYSTEM, USER, ASSISTANT = "0sua"
STATES = START + SYSTEM + USER + ASSISTANT
#: What ends a conversation from each of them, and where one may end.
ENDINGS = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
SPACE = r"\x20\x09-\x0D"


# --- one alignment ---------------------------------------------------------------------------------------------------


def target(state: str, length: int, system: bool) -> str:
    """The roles that follow a state: so many, the first of them the system's or not."""
    first = "s" if system else ""
    return (first + ("au" if state == USER else "ua") * length)[:length]


def _cost(row: str, role: str) -> int | None:
    """Of a row's letter (in upper case if it is truncated) as a turn of that role, or None."""
    cost = TRUNCATED if row.isupper() else 0
    return cost if row.lower() == role else None if role == "s" else cost + REROLE


def align(rows: str, roles: str, most: int | None) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of the cheapest alignment of rows with roles, without inserts after the last row; None if it costs more than `most`."""
    n, m = len(rows), len(roles)
    drift = m - n
    far = 1 << 60

    def away(d: int) -> int:
        return INSERT * d if d > 0 else -DELETE * d

    table = []
    below: dict[int, int] = {}
    for i in range(n, -1, -1):
        here: dict[int, int] = {}
        # a path through (i, j) leaves its diagonal by j - i before and drift - (j - i) after
        low, high = (0, m) if most is None else _band(i, m, drift, most)
        for j in range(high, low - 1, -1):
            if most is not None and away(j - i) + away(drift - j + i) > most:
                continue
            if i == n:
                best = 0 if j == m else far
            else:
                best = below.get(j, far) + DELETE
                if j < m:
                    best = min(best, here.get(j + 1, far) + INSERT)
                    c = _cost(rows[i], roles[j])
                    if c is not None:
                        best = min(best, below.get(j + 1, far) + c)
            if best < far:
                here[j] = best
        table.append(here)
        below = here
    table.reverse()
    total = table[0].get(0, far)
    if total >= far or (most is not None and total > most):
        return None
    i = j = 0
    audit = []
    while i < n:
        left = table[i][j]
        if table[i + 1].get(j, far) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and table[i].get(j + 1, far) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[i].lower() == roles[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def _band(i: int, m: int, drift: int, most: int) -> tuple[int, int]:
    return max(0, i + min(0, drift) - most // DELETE), min(m, i + max(0, drift) + most // INSERT)


def lengths(n: int, state: str, end: str) -> Iterator[tuple[int, str]]:
    """The least cost of their length, and the roles, of all strings that lead from state to end over n rows: the cheapest lengths first."""
    if not n or end in (START, SYSTEM):
        if end == state:
            yield DELETE * n, ""
        elif n and (state, end) == (START, SYSTEM):
            yield DELETE * (n - 1), "s"
        return
    up, down = n, n - 1
    while True:
        more, less = INSERT * (up - n), DELETE * (n - down)
        if more <= less or down < 0:
            least, m, up = more, up, up + 1
        else:
            least, m, down = less, down, down - 1
        for system in (False, True) if state == START and m else (False,):
            roles = target(state, m, system)
            if (roles[-1:] or state) == end:
                yield least, roles


def _with_forced(rows: str, audit: str) -> str:
    """The audit of all rows from that of the rows without '-': each of those is deleted as soon as it is reached, for D is least."""
    out, at = [], 0
    for edit in audit:
        while at < len(rows) and rows[at] == "-":
            out.append("D")
            at += 1
        out.append(edit)
        at += edit != "I"
    return "".join(out) + "D" * (len(rows) - at)


@lru_cache(maxsize=1 << 15)
def ways(rows: str, state: str) -> dict[str, tuple[int, str]]:
    """The cheapest way (cost, audit) from a state over all rows to each state that can be reached; '-' is a row that must be deleted."""
    free = rows.replace("-", "")
    out = {}
    for end in STATES:
        best: tuple[int, str] | None = None
        for least, roles in lengths(len(free), state, end):
            if best is not None and least > best[0]:
                break
            found = align(free, roles, None if best is None else best[0])
            if found is not None and (best is None or found < best):
                best = found
        if best is not None:
            out[end] = (best[0] + DELETE * rows.count("-"), _with_forced(rows, best[1]))
    return out


@lru_cache(maxsize=1 << 15)
def repair(rows: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min((cost + INSERT * len(ENDINGS[end]), audit + "I" * len(ENDINGS[end])) for end, (cost, audit) in ways(rows, START).items())


@lru_cache(maxsize=1 << 15)
def laid_out(rows: str, audit: str, state: str) -> tuple[list[int], str]:
    """For each edit: the number of its row (-1 for an insert), and the role that it gives ('-' for a deleted one)."""
    numbers, roles, at = [], [], 0
    for edit in audit:
        numbers.append(-1 if edit == "I" else at)
        if edit == "D":
            roles.append("-")
        else:
            state = rows[at].lower() if edit == "K" else USER if state != USER else ASSISTANT
            roles.append(state)
        at += edit != "I"
    return numbers, "".join(roles)


# --- pieces of a long conversation -----------------------------------------------------------------------------------

#: A piece or a fold of them as 32 numbers: the cost from each state (four in a row) to each, -1 if there is no way; then, for each
#: state it begins with, the places of the states it ends with in the order of their audits.
N = len(STATES)


def matrix(rows: str) -> tuple[list[int], list[str]]:
    """A piece's numbers, and its audit from each state to each."""
    costs, ranks, audits = [-1] * (N * N), [0] * (N * N), [""] * (N * N)
    for p, state in enumerate(STATES):
        found = ways(rows, state)
        for rank, (audit, end) in enumerate(sorted((audit, end) for end, (_, audit) in found.items())):
            at = p * N + STATES.index(end)
            costs[at], ranks[at], audits[at] = found[end][0], rank, audit
    return costs + ranks, audits


def _through(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """a and then b as one, and the state between them on each cheapest way; of equal ones the ASCII-least."""
    costs, ranks, between = [-1] * (N * N), [0] * (N * N), [-1] * (N * N)
    for p in range(N):
        order = []
        for q in range(N):
            found = [(a[p * N + r] + b[r * N + q], a[N * N + p * N + r], r) for r in range(N) if a[p * N + r] >= 0 and b[r * N + q] >= 0]
            if found:
                cost, rank, r = min(found)
                costs[p * N + q], between[p * N + q] = cost, r
                order.append((rank, b[N * N + r * N + q], q))
        for rank, (_, _, q) in enumerate(sorted(order)):
            ranks[p * N + q] = rank
    return costs + ranks, between


def folded(parts: list[list[int]]) -> list[int]:
    total = parts[0]
    for part in parts[1:]:
        total = _through(total, part)[0]
    return total


def parted(parts: list[list[int]], state: int, end: int) -> list[tuple[int, int]]:
    """The states before and after each part on the cheapest way from state to end."""
    total, steps = parts[0], []
    for part in parts[1:]:
        total, between = _through(total, part)
        steps.append(between)
    ends = [end]
    for between in reversed(steps):
        ends.append(between[state * N + ends[-1]])
    ends = ends[::-1]
    return list(zip([state, *ends[:-1]], ends, strict=True))


def _last(numbers: list[int]) -> int:
    """The state that the cheapest way through a conversation ends with, before the inserts at its end."""
    return min((numbers[q] + INSERT * len(ENDINGS[end]), numbers[N * N + q], q) for q, end in enumerate(STATES) if numbers[q] >= 0)[2]


LONGS = T.ArrayType(T.LongType())
LAID = T.StructType().add("audit", T.StringType()).add("numbers", T.ArrayType(T.IntegerType())).add("roles", T.StringType())


@F.pandas_udf(T.StructType([T.StructField("cost", T.LongType()), *LAID]))
def _repaired(rows: pd.Series) -> pd.DataFrame:
    found = [(cost, audit, *laid_out(x, audit, START)) for x in rows for cost, audit in (repair(x),)]
    return pd.DataFrame(found, columns=["cost", "audit", "numbers", "roles"])


@F.pandas_udf(T.StructType().add("numbers", LONGS).add("audits", T.ArrayType(T.StringType())))
def _matrix(rows: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([matrix(x) for x in rows], columns=["numbers", "audits"])


@F.pandas_udf(LONGS)
def _folded(parts: pd.Series) -> pd.Series:
    return pd.Series([folded([list(map(int, x)) for x in each]) for each in parts], dtype=object)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _parted(parts: pd.Series, state: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([[list(x) for x in parted([list(map(int, y)) for y in each], p, q)] for each, p, q in zip(parts, state, end, strict=True)], dtype=object)


@F.pandas_udf(T.StructType().add("cost", T.LongType()).add("last", T.IntegerType()))
def _decided(numbers: pd.Series) -> pd.DataFrame:
    out = []
    for x in numbers:
        q = _last(x)
        out.append((int(x[q]) + INSERT * len(ENDINGS[STATES[q]]), q))
    return pd.DataFrame(out, columns=["cost", "last"])


@F.pandas_udf(LAID)
def _laid_out(rows: pd.Series, audit: pd.Series, state: pd.Series) -> pd.DataFrame:
    found = [(a, *laid_out(x, a, STATES[p])) for x, a, p in zip(rows, audit, state, strict=True)]
    return pd.DataFrame(found, columns=["audit", "numbers", "roles"])


# --- rows ------------------------------------------------------------------------------------------------------------


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _marked(rows: Column, again) -> Column:
    """rows with the first fault of each (blank, duplicate, truncated, or empty) and its letter. again(row, number): an earlier one is the same."""

    def mark(row: Column, i: Column) -> Column:
        fault = F.when(~row["text"].rlike(f"[^{SPACE}]"), "blank").when(again(row, i), "duplicate").when(~row["text"].rlike(rf"[.!?][{SPACE}]*\z"), "truncated").otherwise("")
        letter = F.when(_initial(row["role"]).isin("u", "a", "s"), _initial(row["role"])).otherwise("x")
        return F.struct(row["turn"].alias("turn"), row["role"].alias("role"), row["text"].alias("text"), fault.alias("fault"), F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(letter)).otherwise(letter).alias("letter"))

    return F.transform(rows, mark)


def _counted(rows: Column) -> list[Column]:
    """blank, duplicate, truncated, illegal of marked rows."""
    pair = lambda i: F.concat(_initial(rows[i - 1]["role"]), _initial(rows[i]["role"]))
    size = lambda x: F.size(x).cast("long")
    broken = F.filter(F.sequence(F.lit(1), F.size(rows) - 1), lambda i: ~pair(i).isin("su", "ua", "au"))
    of = lambda kind: size(F.filter(rows, lambda r: r["fault"] == kind)).alias(kind)
    return [of("blank"), of("duplicate"), of("truncated"), F.when(F.size(rows) > 1, size(broken)).otherwise(0).alias("illegal")]


def _edits(rows: Column, laid: Column) -> Column:
    """edit, turn, role, text of each edit; a deleted row keeps its own."""

    def one(i: Column, k: Column) -> Column:
        edit, row = F.substring(laid["audit"], k + 1, F.lit(1)), F.get(rows, i)
        role = F.when(edit.isin("K", "D"), row["role"]).when(F.substring(laid["roles"], k + 1, F.lit(1)) == "u", "user").otherwise("assistant")
        return F.struct(edit.alias("edit"), row["turn"].alias("turn"), role.alias("role"), F.coalesce(row["text"], F.lit("")).alias("text"))

    return F.transform(laid["numbers"], one)


def _letters(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: r["letter"]), "")


def _gaps(least: Column, most: Column, kinds: Column) -> Column:
    return F.coalesce(most - least + 1 - kinds, F.lit(0)).cast("long")


ROW = ("turn", "role", "text")
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _short(rows: DataFrame) -> DataFrame:
    """conv, facts, piece, edits: a row for each conversation."""
    listed = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("there"), F.struct(*ROW)))).alias("rows"))
    same = F.transform("rows", lambda r: F.struct(r["role"], r["text"]))
    marked = listed.withColumn("same", same).withColumn("rows", _marked(F.col("rows"), lambda r, i: F.array_position(F.col("same"), F.get("same", i)) <= i))
    laid = marked.withColumn("laid", _repaired(_letters(F.col("rows"))))
    turns = F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull()))
    return laid.select("conv", _gaps(F.array_min(turns), F.array_max(turns), F.size(turns)).alias("gaps"), *_counted(F.col("rows")), "laid.cost", F.lit(0).cast("long").alias("piece"), _edits(F.col("rows"), F.col("laid")).alias("edits"))


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of each conversation (conv, FACTS), and its pieces (conv, piece, edits)."""
    order = ("conv", *ROW)
    ranged = rows.filter("there").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    numbered = saved(ranged, "turns").withColumn("part", F.shiftright("at", 33))
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    offsets = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, before long")
    placed = numbered.join(F.broadcast(offsets), "part").select(*order, (F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("place"), F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))
    placed = saved(placed, "placed")
    first = saved(placed.groupBy("conv", "same").agg(F.min("place").alias("first")), "first")
    flagged = placed.alias("a").join(first.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.same") == F.col("b.same"))).select("a.conv", "place", *(f"a.{c}" for c in ROW), (F.col("place") > F.col("first")).alias("again"))
    listed = flagged.groupBy("conv", F.floor(F.col("place") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("place", *ROW, "again"))).alias("rows"))
    marked = listed.withColumn("rows", _marked(F.col("rows"), lambda r, i: r["again"])).withColumn("letters", _letters(F.col("rows")))
    pieces = saved(marked.withColumn("found", _matrix("letters")).select("conv", "piece", "rows", "letters", "found.numbers", "found.audits"), "pieces")

    levels = [pieces.select("conv", F.col("piece").alias("unit"), "numbers")]
    above = (total - 1) // PIECE
    while above > 0:
        grouped = levels[-1].groupBy("conv", F.floor(F.col("unit") / FOLD).alias("unit")).agg(F.sort_array(F.collect_list(F.struct(F.col("unit").alias("part"), "numbers"))).alias("parts"))
        levels.append(saved(grouped.withColumn("numbers", _folded(F.transform("parts", lambda x: x["numbers"]))), "folded"))
        above //= FOLD
    decided = saved(levels[-1].withColumn("made", _decided("numbers")).select("conv", "unit", "made.cost", F.col("made.last").alias("last")), "decided")
    way = decided.select("conv", "unit", F.lit(0).alias("state"), F.col("last").alias("end"))
    for level in reversed(levels[1:]):
        with_way = level.alias("a").join(way.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.unit") == F.col("b.unit"))).select("a.conv", "parts", _parted(F.transform("parts", lambda x: x["numbers"]), F.col("state"), F.col("end")).alias("ways"))
        each = with_way.select("conv", F.inline(F.arrays_zip(F.transform("parts", lambda x: x["part"]).alias("unit"), F.col("ways"))))
        way = saved(each.select("conv", "unit", F.col("ways")[0].alias("state"), F.col("ways")[1].alias("end")), "ways")

    closing = F.element_at(F.create_map(*(F.lit(x) for q, s in enumerate(STATES) for x in (q, "I" * len(ENDINGS[s])))), F.col("end"))
    lasts = pieces.groupBy("conv").agg(F.max("piece").alias("last_piece"))
    known = way.alias("w").join(maybe_broadcast(lasts).alias("l"), F.col("w.conv").eqNullSafe(F.col("l.conv"))).select("w.conv", "unit", "state", "end", F.when(F.col("unit") == F.col("last_piece"), closing).otherwise("").alias("closing"))
    chosen = pieces.alias("a").join(known.alias("w"), F.col("a.conv").eqNullSafe(F.col("w.conv")) & (F.col("piece") == F.col("unit")))
    audit = F.concat(F.element_at("audits", F.col("state") * N + F.col("end") + 1), "closing")
    out = chosen.select("a.conv", "piece", "rows", _laid_out("letters", audit, "state").alias("laid")).select("conv", "piece", _edits(F.col("rows"), F.col("laid")).alias("edits"))

    parts = saved(pieces.select("conv", "piece", *_counted(F.col("rows")), _initial(F.get("rows", F.lit(0))["role"]).alias("first"), _initial(F.element_at("rows", -1)["role"]).alias("last")), "counts")
    joints = parts.alias("a").join(parts.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("b.piece") == F.col("a.piece") + 1)).filter(~F.concat("a.last", "b.first").isin("su", "ua", "au")).select("a.conv", F.lit(0).cast("long").alias("blank"), F.lit(0).cast("long").alias("duplicate"), F.lit(0).cast("long").alias("truncated"), F.lit(1).cast("long").alias("illegal"))
    sums = parts.select(*joints.columns).unionByName(joints).groupBy("conv").agg(*(F.sum(c).alias(c) for c in joints.columns[1:]))
    spans = placed.groupBy("conv").agg(_gaps(F.min("turn"), F.max("turn"), F.countDistinct("turn")).alias("gaps"))
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    facts = sums.alias("s").join(spans.alias("g"), same("s", "g")).join(decided.alias("d"), same("s", "d")).select("s.conv", *FACTS)
    return facts, out


def _sides(turns: DataFrame, conv: str, turn: str, role: str, text: str, there: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations of up to LONG rows, and those of the others, if there are any."""
    kept = F.coalesce(F.col(there), F.lit(True)) if there else F.lit(True)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), kept.alias("there"))
    many = saved(rows.groupBy("conv").agg(F.count_if("there").alias("n")).filter(F.col("n") > LONG).select("conv"), "long")
    if many.isEmpty():
        return rows, None
    split = lambda how: rows.alias("a").join(maybe_broadcast(many).alias("m"), F.col("a.conv").eqNullSafe(F.col("m.conv")), how)
    return split("left_anti"), split("left_semi")


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """conv, piece, place, edit, turn, role, text: the edits of each conversation in order; without the deleted rows (D), those are the turns
    after repair. Rows in which `there` is false only name their conversation."""
    few, many = _sides(turns, conv, turn, role, text, there)
    edits = _short(few).select("conv", "piece", "edits")
    if many is not None:
        edits = edits.unionByName(_long(many)[1])
    return edits.select(F.col("conv").alias(conv), "piece", F.posexplode("edits").alias("place", "e")).select(conv, "piece", "place", "e.edit", F.col("e.turn").alias(turn), F.col("e.role").alias(role), F.col("e.text").alias(text))


def _audit(edits: Column) -> Column:
    return F.array_join(F.transform(edits, lambda e: e["edit"]), "")


def _body(edits: Column) -> Column:
    """Repaired role:text lines; null if there are none."""
    left = F.filter(edits, lambda e: e["edit"] != "D")
    return F.when(F.size(left) > 0, F.array_join(F.transform(left, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n"))


def repair_digest(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """conv, FACTS, audit, repaired_sha256: a row for each conversation. The hash of a long conversation is taken over its pieces as they
    come from the shuffle; no task holds them at once."""
    few, many = _sides(turns, conv, turn, role, text, there)
    short = _short(few).select("conv", *FACTS, _audit(F.col("edits")).alias("audit"), F.sha2(F.coalesce(_body(F.col("edits")), F.lit("")), 256).alias("repaired_sha256"))
    if many is not None:
        facts, pieces = _long(many)
        lines = pieces.select("conv", "piece", _audit(F.col("edits")).alias("audit"), _body(F.col("edits")).alias("body"))

        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, audits, digest, lines_before = None, [], None, False
            done = lambda: pd.DataFrame([(now[0], "".join(audits), digest.hexdigest())], columns=["conv", "audit", "repaired_sha256"])
            for batch in batches:
                for key, audit, body in zip(batch["conv"].astype(object), batch["audit"], batch["body"], strict=True):
                    key = None if pd.isna(key) else key
                    if now is None or now[0] != key:
                        if now is not None:
                            yield done()
                        now, audits, digest, lines_before = (key,), [], hashlib.sha256(), False
                    audits.append(audit)
                    if body is not None:
                        digest.update((("\n" if lines_before else "") + body).encode())
                        lines_before = True
            if now is not None:
                yield done()

        kind = turns.schema[conv].dataType.simpleString()
        digests = lines.repartition("conv").sortWithinPartitions("conv", "piece").mapInPandas(hashed, f"conv {kind}, audit string, repaired_sha256 string")
        whole = facts.alias("f").join(digests.alias("d"), F.col("f.conv").eqNullSafe(F.col("d.conv"))).select("f.conv", *FACTS, "audit", "repaired_sha256")
        short = short.unionByName(whole)
    return short.withColumnRenamed("conv", conv)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with the faults of the query: by crc32 of `conv_id:turn`, a row is dropped (it stays as one that is not there), emptied,
    stripped of its stops, repeated, or given to the user. Nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), F.when(F.col("kind") != 0, text).otherwise("").alias("text"), (F.col("kind") != 0).alias("there"), copies.alias("copy")).drop("copy")
