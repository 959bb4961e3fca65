"""Conversation structure repair: the cheapest edits that bring roles into order, by DuckDB recursion in hash-partitioned batches.

Rows of a conversation are numbered by one range sort and cut into segments of
SEGMENT rows, so that no conversation, however long, meets in one task. A
batch of segments goes through one recursive query, each recursion advancing
one row in all of them; it keeps the least (cost, audit) for every grammar
state that a segment may be entered and left in. Segments are then steps of
the same query one level up, with the rank of an audit in place of its text,
until one is left a conversation; what was chosen there is followed back down.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from storyline.operators.durable import durable

#: Rows of a segment, and segments that one step of a level up takes together.
SEGMENT, FAN = 256, 64
#: Rows that one recursive query takes at a time.
BATCH_ROWS = 20_000
#: White space that a blank text may hold, and that is not looked at before a text's end.
BLANK = " \t\n\x0b\x0c\r"
#: What role a state asks for next; the states are the initials of the last kept role, "." before any.
NEXT = {".": "u", "s": "u", "u": "a", "a": "u"}
#: Cost and edits that end a conversation from a state.
TAILS = {".": (0, ""), "a": (0, ""), "u": (2, "Ia"), "s": (4, "IuIa")}


def _edges() -> pa.Table:
    """Every way past one row: kind, truncated, state before, state after, cost, edits (each with the state it leads to).

    An insertion stands right before a row that stays: before a deletion it costs the same and sorts later.
    """
    found = []
    for kind in "suao":
        for truncated in (0, 1):
            for entry in NEXT:
                state, cost, edits = entry, 0, ""
                found.append((kind, truncated, entry, entry, 3, "D" + entry))
                for _ in range(3):
                    if kind == NEXT[state] or kind == "s" and state == ".":
                        found.append((kind, truncated, entry, kind, cost + truncated, f"{edits}K{kind}"))
                    if kind != NEXT[state]:
                        found.append((kind, truncated, entry, NEXT[state], cost + 2 + truncated, f"{edits}R{NEXT[state]}"))
                    state = NEXT[state]
                    cost, edits = cost + 2, f"{edits}I{state}"
    return pa.table(dict(zip(("kind", "truncated", "p", "q", "cost", "piece"), map(list, zip(*found, strict=True)), strict=True)))


_WALK = """
WITH RECURSIVE keyed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST, part) AS g FROM rows),
{moves},
sizes AS (SELECT g, any_value(conv_id) AS conv_id, any_value(part) AS part, max(pos) + 1 AS n FROM placed GROUP BY g),
walk AS (
  SELECT g, 0::BIGINT AS pos, entry, entry AS state, 0::HUGEINT AS cost, '' AS audit FROM sizes, (VALUES ('.'), ('s'), ('u'), ('a')) t(entry)
  UNION ALL
  SELECT w.g, w.pos + 1, w.entry, m.q, min(w.cost + m.cost), arg_min(w.audit || m.piece, (w.cost + m.cost, w.audit || m.piece))
  FROM walk w JOIN moves m ON m.g = w.g AND m.pos = w.pos AND m.p = w.state GROUP BY w.g, w.pos, w.entry, m.q)
SELECT conv_id, part AS block, entry, state AS "exit", CAST(cost AS BIGINT) AS cost, audit,
  CAST(row_number() OVER (PARTITION BY g, entry ORDER BY audit) - 1 AS INTEGER) AS rank
FROM walk JOIN sizes USING (g) WHERE pos = n"""
_BY_ROW = _WALK.format(moves="""placed AS (SELECT g, conv_id, part, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS pos, kind, truncated FROM keyed),
moves AS (SELECT g, pos, e.p, e.q, e.cost, e.piece FROM placed JOIN edges e USING (kind, truncated))""")
_BY_SEGMENT = _WALK.format(moves="""placed AS (SELECT g, conv_id, part, dense_rank() OVER (PARTITION BY g ORDER BY id) - 1 AS pos, entry, "exit", cost, rank FROM keyed),
moves AS (SELECT g, pos, entry AS p, "exit" AS q, cost, rank || "exit" AS piece FROM placed)""")
_LEVEL = "block long, entry string, exit string, cost long, audit string, rank int"

_ASSEMBLE = """
WITH r AS (SELECT *, sum(normal) OVER (PARTITION BY conv_id, part ORDER BY id) AS nth,
             lag(initial) OVER (PARTITION BY conv_id, part ORDER BY id) || initial AS met,
             row_number() OVER (PARTITION BY conv_id, part ORDER BY id) AS nr
           FROM rows WHERE id >= 0 AND copies > 0),
steps AS (SELECT conv_id, part, audit, unnest(range(1, strlen(audit) // 2 + 1)) AS j FROM rows WHERE id < 0),
told AS (SELECT conv_id, part, j, audit[2 * j - 1] AS op, CASE audit[2 * j] WHEN 'u' THEN 'user' ELSE 'assistant' END AS role FROM steps),
ops AS (SELECT *, sum(CAST(op <> 'I' AS INTEGER)) OVER (PARTITION BY conv_id, part ORDER BY j) + CAST(op = 'I' AS INTEGER) AS nth FROM told),
items AS (
  SELECT r.conv_id, r.part, r.id, coalesce(o.j, 0) AS j, CASE WHEN r.normal = 1 THEN o.op || repeat('D', r.copies - 1) ELSE repeat('D', r.copies) END AS edits,
    CASE o.op WHEN 'K' THEN {'role': r.role, 'text': r.text} WHEN 'R' THEN {'role': o.role, 'text': r.text} END AS turn
  FROM r LEFT JOIN ops o ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.part = r.part AND o.nth = r.nth AND o.op <> 'I' AND r.normal = 1
  UNION ALL
  SELECT o.conv_id, o.part, r.id, o.j, 'I', {'role': o.role, 'text': ''}
  FROM ops o JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.part = r.part AND o.nth = r.nth AND r.normal = 1 WHERE o.op = 'I'),
text AS (SELECT conv_id, part, string_agg(edits, '' ORDER BY id, j) AS audit, list(turn ORDER BY id, j) FILTER (WHERE turn IS NOT NULL) AS turns FROM items GROUP BY ALL),
counts AS (
  SELECT conv_id, part, CAST(coalesce(sum(CASE fault WHEN 'blank' THEN copies END), 0) AS BIGINT) AS blank,
    CAST(coalesce(sum(CASE WHEN fault = 'duplicate' THEN copies WHEN fault IN ('truncated', '') THEN copies - 1 END), 0) AS BIGINT) AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    CAST(sum(copies - 1 + CAST(nr > 1 AND met NOT IN ('su', 'ua', 'au') AS INTEGER)) AS BIGINT) AS illegal,
    arg_min(initial, id) AS first_initial, arg_max(initial, id) AS last_initial, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT turn) AS n_turns
  FROM r GROUP BY ALL)
SELECT k.conv_id, k.part AS block, coalesce(audit, '') AS audit, coalesce(turns, []) AS turns, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, first_initial, last_initial, first_turn, last_turn, coalesce(n_turns, 0) AS n_turns
FROM (SELECT DISTINCT conv_id, part FROM rows) k
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND c.part = k.part LEFT JOIN text t ON t.conv_id IS NOT DISTINCT FROM k.conv_id AND t.part = k.part"""
_SEGMENTS = (
    "block long, audit string, turns array<struct<role:string,text:string>>, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, first_turn long, last_turn long, n_turns long"
)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (conv_id, part) in tables of about BATCH_ROWS that no group is cut by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < BATCH_ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        n = rows.num_rows
        differs = pc.fill_null(pc.not_equal(rows["part"].slice(1), rows["part"].slice(0, n - 1)), True)
        left, right = rows["conv_id"].slice(0, n - 1), rows["conv_id"].slice(1)
        differs = pc.or_(differs, pc.or_(pc.not_equal(pc.is_null(left), pc.is_null(right)), pc.fill_null(pc.not_equal(left, right), False)))
        cuts = pc.indices_nonzero(differs.combine_chunks() if isinstance(differs, pa.ChunkedArray) else differs)
        if len(cuts):
            cut = cuts[-1].as_py() + 1
            yield rows.slice(0, cut)
            rows = rows.slice(cut)
        held = rows.to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _by_duckdb(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """``sql`` over ``rows``, dealt by hash of (conv_id, part) and taken in batches of whole groups."""
    edges = _edges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as db:
            db.register("edges", edges)
            for table in _whole(batches):
                db.register("given", table)
                db.execute("CREATE OR REPLACE TEMP TABLE rows AS FROM given")  # read from Arrow, each recursion would convert it anew
                db.unregister("given")
                yield from db.sql(sql).to_arrow_table().to_batches()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part").mapInArrow(run, f"conv_id {kind}, {schema}")


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with ``id`` rising in order of keys, written down; equal keys of a long conversation may fall to several tasks."""
    return durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()))


def _ordered(turns: DataFrame, copies: Column | None) -> DataFrame:
    """Distinct rows of each conversation with their copies, faults and place in its order."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced, (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    end = F.rtrim("text", F.lit(BLANK))
    rows = rows.withColumn("end", F.right(end, F.lit(1))).withColumn("said", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.where("copies > 0 AND end != ''").groupBy(F.col("conv_id").alias("conv"), F.col("said").alias("heard")).agg(F.min(order)["turn"].alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("heard")), "left")
    fault = F.when(F.col("end") == "", "blank").when(~F.col("turn").eqNullSafe(F.col("first")), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", F.coalesce(fault, F.lit(""))).withColumn("initial", F.left("role", F.lit(1)))
    normal = (F.col("copies") > 0) & F.col("fault").isin("truncated", "")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", "fault", "initial", normal.cast("int").alias("normal"))
    return _numbered(rows, "conv_id", "turn", "role", "text").withColumn("part", F.shiftright("id", SEGMENT.bit_length() - 1))


def _chosen(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each segment's cheapest edits ``(conv_id, block, audit)``, and each conversation's ``(conv_id, cost, tail)``."""
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    steps = rows.where("normal = 1").select("conv_id", "part", "id", kind.alias("kind"), (F.col("fault") == "truncated").cast("int").alias("truncated"))
    level, below = durable(_by_duckdb(steps, _BY_ROW, _LEVEL)), []
    while True:
        segments = level.where("entry = '.' AND exit = '.'").select("conv_id", "block")
        last = (segments.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) <= FAN
        if last:
            level = level.withColumn("part", F.lit(0).cast("long"))
        else:
            parts = _numbered(segments, "conv_id", "block").select(
                F.col("conv_id").alias("conv"), F.col("block").alias("segment"), F.shiftright("id", FAN.bit_length() - 1).alias("part")
            )
            level = level.join(parts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("segment"))).drop("conv", "segment")
        below.append(level)
        level = durable(_by_duckdb(level.select("conv_id", "part", F.col("block").alias("id"), "entry", "exit", "cost", "rank"), _BY_SEGMENT, _LEVEL))
        if last:
            break

    tail = F.create_map(*(F.lit(x) for state, (_, edits) in TAILS.items() for x in (state, edits)))[F.col("exit")]
    extra = F.create_map(*(F.lit(x) for state, (cost, _) in TAILS.items() for x in (state, cost)))[F.col("exit")]
    top = level.where("entry = '.'").withColumn("cost", F.col("cost") + extra).withColumn("tail", tail)
    top = top.groupBy("conv_id").agg(F.min_by(F.struct("cost", "tail", "audit"), F.struct("cost", "rank")).alias("best")).select("conv_id", "best.*")
    chosen = top.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(".").alias("entry"), "audit")
    for level in reversed(below):
        order = F.dense_rank().over(_window("conv_id", "part", by="block")) - 1
        children = level.select(F.col("conv_id").alias("conv"), "part", "block", order.alias("pos"), F.col("entry").alias("entered"), "rank", F.col("audit").alias("edits"))
        told = chosen.select("conv_id", F.col("block").alias("above"), "entry", "audit", F.explode(F.expr("sequence(0, length(audit) div 2 - 1)")).alias("at"))
        told = told.select(
            "conv_id", "above", "at", F.when(F.col("at") == 0, F.col("entry")).otherwise(F.expr("substring(audit, cast(2 * at as int), 1)")).alias("entry"),
            F.expr("cast(substring(audit, cast(2 * at + 1 as int), 1) as int)").alias("nth"),
        )
        same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("above") == F.col("part")) & (F.col("at") == F.col("pos"))
        chosen = told.join(children, same & (F.col("entry") == F.col("entered")) & (F.col("nth") == F.col("rank")))
        chosen = chosen.select("conv_id", "block", "entry", F.col("edits").alias("audit"))
    return chosen.select("conv_id", "block", "audit"), top.select("conv_id", "cost", "tail")


def _window(*keys: str, by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(by)


def repair(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """Segments of repaired conversations in order of ``block``: edits, repaired turns and counts of faults.

    ``turns`` has conv_id, turn, role, text; ``copies`` says how often a row
    stands there (0: it is known but gone; default 1). Rows are ordered by
    turn, nulls first, then role and text; null roles and texts are one space.
    Keep costs 0, rerole 2, delete 3 (a must for blank and repeated rows),
    insert 2, a truncated row that stays 1 more; of the cheapest the least
    audit in ASCII holds. The last block of a conversation has ``tail``
    set: the insertions that end it; ``cost`` is there too. Null ids are a
    conversation of their own; extra columns are passed by; an empty table
    gives an empty one. Texts of any length are handled whole.
    """
    rows = _ordered(turns, copies)
    chosen, tops = _chosen(rows)
    told = chosen.select("conv_id", F.col("block").alias("part"), F.lit(-1).cast("long").alias("id"), "audit")
    segments = _by_duckdb(rows.withColumn("audit", F.lit(None).cast("string")).unionByName(told, allowMissingColumns=True), _ASSEMBLE, _SEGMENTS)
    ends = tops.select("conv_id", F.lit((1 << 63) - 1).alias("block"), "cost", "tail")
    return segments.unionByName(ends, allowMissingColumns=True)


def digest(segments: DataFrame) -> DataFrame:
    """One row a conversation from its segments, which stream by in order; nothing of a conversation is held but its audit."""

    def told(conv, total: dict, sha) -> list:
        return [conv, total["gaps"], total["blank"], total["duplicate"], total["truncated"], total["illegal"], total["cost"], "".join(total["audit"]), sha.hexdigest()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        out, now, total, sha, begun = [], None, None, None, False

        def write(role: str, text: str) -> None:
            nonlocal begun
            sha.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True

        for batch in batches:
            for row in batch.to_pylist():
                if total is None or row["conv_id"] != now:
                    if total is not None:
                        out.append(told(now, total, sha))
                    now, sha, begun = row["conv_id"], hashlib.sha256(), False
                    total = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0) | {"audit": [], "least": None, "most": None, "initial": None}
                if row["tail"] is not None:
                    total["cost"] += row["cost"]
                    for state in row["tail"][1::2]:
                        total["audit"].append("I")
                        write("user" if state == "u" else "assistant", "")
                    continue
                for count in ("blank", "duplicate", "truncated", "illegal"):
                    total[count] += row[count]
                total["cost"] += 3 * (row["blank"] + row["duplicate"])
                if row["first_initial"] is not None:
                    if total["initial"] is not None and total["initial"] + row["first_initial"] not in ("su", "ua", "au"):
                        total["illegal"] += 1
                    total["initial"] = row["last_initial"]
                if row["n_turns"]:
                    total["turns"] += row["n_turns"] - (total["most"] == row["first_turn"])
                    total["least"] = row["first_turn"] if total["least"] is None else total["least"]
                    total["most"] = row["last_turn"]
                    total["gaps"] = total["most"] - total["least"] + 1 - total["turns"]
                total["audit"].append(row["audit"])
                for turn in row["turns"]:
                    write(turn["role"], turn["text"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(told(now, total, sha), kinds, strict=True)], names=names)

    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with faults planted by crc32 of ``conv_id:turn`` (nulls: one space), and how often each stands there."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", spaced["conv_id"], spaced["turn"]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    role = F.when(kind == 4, "user").otherwise(spaced["role"])
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows, F.col("copies")
