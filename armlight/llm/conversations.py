"""Conversation structure repair by iterative-deepening A*.

A conversation's rows become one letter each (role and fault). The search goes depth-first through the edits in ASCII
order under a cost bound and raises the bound to the least cost that exceeded it; states that failed with some budget
are kept in a table and not entered again with as little. The first accepting path is hence the cheapest, and of equal
ones the least. The cost still to come is bounded from below by two for every faulty row ahead.

Rows are range-sorted by (conversation, turn, role, text), so a conversation that holds a third of all rows is spread
over many tasks; identical rows are counted before they are shuffled. Only the letters of a conversation come together,
one byte a row like the audit that comes out, and are searched in blocks of ``BLOCK`` rows, last block first: the costs
from the block's end on are the goal costs of its search, so the blocks' paths join to the least path. Texts never come
together: repaired rows are made by a join of the sorted rows with their edits, and hashed as a sorted stream.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.sources.files import stage

# fixed: costs of the edits, of a truncated row that stays, the share of rows that is damaged, and its kinds
COST = {"D": 2, "I": 5, "K": 0, "R": 1}
KEPT_TRUNCATED = 5
PERIOD = 20
DROP, EMPTY, UNEND, REPEAT, USER = range(5)
VISIBLE = r"[^ \t-\r]"
ENDED = r"[.!?][ \t-\r]*+\z"
ROLES = ("s", "u", "a", "")
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
BLOCK = 32
SEGMENT_BITS = 7  # 128 sorted rows share a segment of edits

# states: nothing yet, after the system row, after a user row, after an assistant row
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_WANTED = "uuau"  # the role that an inserted or changed row gets in a state
_AFTER = (2, 2, 3, 2)
_NEVER = 1 << 60


def letter(role: str, fault: int) -> str:
    """The letter of a row: its role's initial and its first fault."""
    return chr(65 + 4 * ROLES.index(role if role in ROLES else "") + fault)


@lru_cache(maxsize=50_000)
def search(block: str, entry: int, goal: tuple, last: bool):
    """(cost, edits, state) of the least cheapest way through ``block`` from ``entry``, by iterative-deepening A*.

    ``goal`` has the cost from the block's end on for each state; rows are only inserted at the end of the last block,
    as elsewhere that is the start of the next one.
    """
    rows = [divmod(ord(c) - 65, 4) for c in block]
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (2 if rows[i][1] else 0)
    rest = min(goal)
    failed = {}  # (row, state) -> the largest budget that did not do

    def enter(i, state, budget):
        """(edits, last state) of a way that costs at most ``budget``, or the least budget known to be worth a try."""
        if i == len(rows) and goal[state] <= budget:
            return "", state
        if ahead[i] + rest > budget:
            return ahead[i] + rest
        if failed.get((i, state), (-1, 0))[0] >= budget:
            return failed[i, state][1]
        least = _NEVER
        for edit, spent, at, to in moves(i, state):
            found = enter(at, to, budget - spent)
            if isinstance(found, tuple):
                return edit + found[0], found[1]
            least = min(least, found + spent)
        if i == len(rows):
            least = min(least, goal[state])
        failed[i, state] = budget, least
        return least

    def moves(i, state):
        if i < len(rows):
            role, fault = rows[i]
            kept = KEPT_TRUNCATED if fault == TRUNCATED else 0
            yield "D", COST["D"], i + 1, state
        if i < len(rows) or last:
            yield "I", COST["I"], i, _AFTER[state]
        if i < len(rows) and fault < BLANK:
            if ROLES[role] in _KEEP[state]:
                yield "K", COST["K"] + kept, i + 1, _KEEP[state][ROLES[role]]
            yield "R", COST["R"] + kept, i + 1, _AFTER[state]

    bound = ahead[0] + rest
    while True:
        found = enter(0, entry, bound)
        if isinstance(found, tuple):
            return bound, found[0], found[1]
        bound = found


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of the rows of a conversation, given by their letters."""
    # blank and repeated rows are alike here
    plain = codes.translate({ord(letter(r, DUPLICATE)): letter(r, BLANK) for r in ROLES})
    blocks = [plain[k : k + BLOCK] for k in range(0, len(plain), BLOCK)]
    goal, base, goals = (0, _NEVER, _NEVER, 0), 0, []
    for k in range(len(blocks) - 1, 0, -1):
        goals.append((goal, base))
        costs = [search(blocks[k], state, goal, k == len(blocks) - 1)[0] for state in range(4)]
        # goals are kept relative to the least, so that like blocks are searched once
        goal, base = tuple(c - min(costs) for c in costs), base + min(costs)
    goals.append((goal, base))
    state, edits, total = 0, [], 0
    for k, block in enumerate(blocks):
        goal, base = goals[len(blocks) - 1 - k]
        cost, path, state = search(block, state, goal, k == len(blocks) - 1)
        total = total if k else cost + base
        edits.append(path)
    return total, "".join(edits)


def row_edits(codes: str, audit: str) -> list[str]:
    """What becomes of each row: inserted roles in front, then K, D, or the new role as U or A; the last row's may end
    with inserted roles."""
    found, state, pending, i = [], 0, "", 0
    for edit in audit:
        if edit == "I":
            pending, state = pending + _WANTED[state], _AFTER[state]
            continue
        made = edit
        if edit == "K":
            state = _KEEP[state][ROLES[(ord(codes[i]) - 65) // 4]]
        elif edit == "R":
            made, state = _WANTED[state].upper(), _AFTER[state]
        found.append(pending + made)
        pending, i = "", i + 1
    if pending:
        found[-1] += pending
    return found


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after the fixed damage, identical ones once with their number."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.col("kind"), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(key) % PERIOD).alias("kind")).where(kind != DROP)
    rows = rows.select(
        "conv_id", "turn",
        F.when(kind == USER, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == EMPTY, "").when(kind == UNEND, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == REPEAT, 2).otherwise(1).cast("bigint").alias("n"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def sorted_rows(rows: DataFrame) -> DataFrame:
    """The rows of ``damaged`` with ``code``, the letter of the first of the n copies, and ``place``, which ascends with
    conversation, turn (null first), role and text; written once."""
    rows = stage(rows.withColumn("digest", F.sha2("text", 256)), "conversation-rows")
    again = rows.where(F.col("text").rlike(VISIBLE)).groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")
    ).where("turns > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(~F.col("text").rlike(VISIBLE), BLANK).when(later, DUPLICATE).when(~F.col("text").rlike(ENDED), TRUNCATED).otherwise(FINE)
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES[:3])), F.left("role", F.lit(1))), F.lit(0))
    role = F.when(role > 0, role - 1).otherwise(len(ROLES) - 1)
    coded = rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "n", F.char(65 + 4 * role + fault).alias("code"))
    keys = ["conv_id", "turn", "role"]
    ordered = coded.repartitionByRange(*keys, F.left("text", F.lit(32))).sortWithinPartitions(*keys, "text")
    return stage(ordered.withColumn("place", F.monotonically_increasing_id()), "conversation-order")


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: blank, duplicate, truncated, illegal, cost, audit, and the edits of each segment of its rows."""
    fault = F.ascii("code") % 4 - 65 % 4
    copy = F.when(F.pmod(fault, F.lit(4)) == BLANK, F.col("code")).otherwise(F.char(F.ascii("code") - F.pmod(fault, F.lit(4)) + DUPLICATE))
    letters = F.concat("code", F.repeat(copy, (F.col("n") - 1).cast("int")))
    segment = F.shiftright("place", SEGMENT_BITS)
    segments = rows.select("conv_id", segment.alias("segment"), "place", letters.alias("codes")).groupBy("conv_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("place", "codes"))).alias("held")
    ).select("conv_id", F.struct("segment", F.col("held")[0]["place"].alias("first"), F.transform("held", lambda h: h["codes"]).alias("codes")).alias("held"))
    whole = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list("held")).alias("held")).select(
        "conv_id", F.transform("held", lambda h: h["segment"]).alias("segments"), F.transform("held", lambda h: h["first"]).alias("firsts"),
        F.transform("held", lambda h: F.transform(h["codes"], lambda c: F.length(c))).alias("copies"),
        F.array_join(F.transform("held", lambda h: F.array_join(h["codes"], "")), "").alias("codes"),
    )
    legal = {"su", "ua", "au"}

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits")}
            for codes, copies in zip(batch["codes"].to_pylist(), batch["copies"].to_pylist()):
                cost, audit = cheapest(codes)
                edits, at, by_segment = row_edits(codes, audit), 0, []
                roles = [ROLES[(ord(c) - 65) // 4] for c in codes]
                for sizes in copies:
                    mine = []
                    for size in sizes:
                        # copies after the first are deleted; only the last one of all can have rows behind it
                        mine.append(edits[at] + (edits[at + size - 1][1:] if size > 1 else ""))
                        at += size
                    by_segment.append(" ".join(mine))
                out["cost"].append(cost)
                out["audit"].append(audit)
                out["edits"].append(by_segment)
                out["illegal"].append(sum(x + y not in legal for x, y in zip(roles, roles[1:])))
                for name, kind in (("truncated", TRUNCATED), ("blank", BLANK), ("duplicate", DUPLICATE)):
                    out[name].append(sum((ord(c) - 65) % 4 == kind for c in codes))
            types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.string())]
            made = [pa.array(v, t) for v, t in zip(out.values(), types)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "segments", "firsts")), *made], ["conv_id", "segments", "firsts", *out])

    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, segments array<bigint>, firsts array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, edits array<string>"
    return whole.mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, nth, role, text): the repaired conversations, in order of place and nth."""
    edits = found.select("conv_id", F.inline(F.arrays_zip("segments", "firsts", "edits"))).select(
        F.col("conv_id").alias("_conv"), "segments", "firsts", F.split("edits", " ").alias("edits")
    )
    here = (F.shiftright("place", SEGMENT_BITS) == F.col("segments")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    row_edit = F.get("edits", (F.col("place") - F.col("firsts")).cast("int"))
    made = rows.join(edits, here).select("conv_id", "place", "role", "text", F.posexplode(F.split(row_edit, "")).alias("nth", "edit"))
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.lower("edit") == "u", "user").otherwise("assistant")
    text = F.when(F.col("edit").isin("K", "U", "A"), F.col("text")).otherwise("")
    return made.where(F.col("edit").isin("K", "U", "A", "u", "a")).select("conv_id", "place", "nth", role.alias("role"), text.alias("text"))


def text_hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text``; a sorted stream, so no conversation has to fit into memory."""
    lines = repaired.select("conv_id", "place", "nth", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches):
        held, state = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist()):
                if state is None or conv != held:
                    if state is not None:
                        yield out()
                    held, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
        if state is not None:
            yield out()

    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth")
    return ordered.mapInArrow(run, f"conv_id {dict(repaired.dtypes)['conv_id']}, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of ``conversations`` (conv_id, turn, role, text) after the fixed damage.

    The report has each conv_id once: gaps, blank, duplicate, truncated, illegal, cost, audit. Rows of one turn stand in
    order of role and text; a null turn comes first, a null role or text is one space, rows without a conv_id are one
    conversation. A role counts by its first letter; one that isn't s, u or a is never legal. An empty table gives an
    empty report. Texts may be of any length; other columns don't matter, whatever their names.
    """
    given = conversations.select("conv_id", "turn", "role", "text")
    rows = sorted_rows(damaged(given))
    found = stage(audits(rows), "conversation-audits")
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))

    def beside(df):
        return df.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))

    report = given.select("conv_id").distinct()
    report = report.join(*beside(turns), "left").drop("_conv")
    report = report.join(*beside(found.drop("segments", "firsts", "edits")), "left").drop("_conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = report.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"))
    return report, repaired_rows(rows, found)


def with_hashes(report: DataFrame, repaired: DataFrame) -> DataFrame:
    """The report with the hash of each repaired conversation, without rows that of the empty text."""
    hashes = text_hashes(repaired).withColumnRenamed("conv_id", "_conv")
    joined = report.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(*report.columns, F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
