"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame operations only.

The ring has POINTS places. Each shard has NODES virtual nodes at places that hashes choose, and a row starts at the place
its id hashes to. Clockwise from there lie the shards in the order of their first nodes: the row's path. A shard's load
is bytes (a text's UTF-8 length plus one), and no shard takes more than (1 + SLACK) times an equal share.

All rows ask the first shard of their path, then those turned away ask the second, and so on. A shard takes rows by
their turn, large ones first and otherwise by a hash, as long as its bound allows, and passes over rows that are larger than all
the room it had left when the round began. What it took in an earlier round it never gives up, so rows leave their
first shard only where that shard is full; only they move when loads change. Where a round ends is one number a shard,
so the plan is a list of a few numbers a round, and a row's shard follows from its path, its turn and the plan. If a lap of
the ring leaves rows over (texts larger than what is left anywhere), the bounds grow by SLACK, 4 SLACK, 16 SLACK... of a
share until all are placed.

The law that holds is `bytes`: shards' sizes are at most (1 + SLACK) times an equal share unless single texts don't fit,
and at least 1 - 15 SLACK of it. Numbers of rows are not balanced, and a row's shard depends on the other rows' sizes,
so grown_shard is null.

Rows are counted by (id, size, crc32) on the map side before anything is sorted, so a key with a third of the rows is
one row until it is dealt out again in STRIDE copies a piece; each copy has its own turn, so even one id fills several shards.

Defined cases: a null text has no bytes (size 1, crc 0); a null id hashes as the empty text; rows that repeat get a slot each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small, table

SHARDS, NODES, SLACK = 16, 64, 0.001
#: Places on the ring; turns of one size class; parts of a shard whose slots are numbered apart; copies of a key in a piece.
POINTS, TURNS, PARTS, STRIDE = 1 << 16, 1 << 12, 1 << 10, 4096


@dataclass
class Plan:
    """Bounded loads: each step is (round, last turn and room by shard)."""

    bound: float
    steps: list[tuple[int, list[int], list[int]]] = field(default_factory=list)


def place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:4], 16) % POINTS


def ring(shards: int = SHARDS, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, clockwise; a place that is taken already goes to the next free one."""
    if not 0 < shards * nodes <= POINTS:
        raise ValueError(f"a ring of {POINTS} places can't hold {shards} x {nodes} nodes")
    taken: dict[int, int] = {}
    for node in range(nodes):
        for shard in range(shards):
            at = place(f"{shard}/{node}")
            while at in taken:
                at = (at + 1) % POINTS
            taken[at] = shard
    return sorted(taken.items())


def paths(nodes: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """For each node, the shards in the order in which they come clockwise from it."""
    order = [s for _, s in nodes]
    path, out = [], []
    for shard in reversed(order + order):
        path = [shard, *(s for s in path if s != shard)]
        out.append(tuple(path))
    return out[::-1][: len(order)]


def hexed(col: Column, digits: int) -> Column:
    """The first hex digits of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(col), 1, digits), 16, 10).cast("int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """doc_id, size and text_crc32 of a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")]


def text_id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def turned(rows: DataFrame) -> DataFrame:
    """Adds place and turn to rows (doc_id, size, text_crc32, nth): a smaller turn is served first."""
    large_first = F.lit(64) - F.length(F.bin("size"))
    mixed = F.concat_ws("/", text_id(), F.col("size").cast("string"), F.col("text_crc32").cast("string"), F.col("nth").cast("string"))
    return rows.withColumns({"place": hexed(text_id(), 4) % POINTS, "turn": large_first * TURNS + hexed(mixed, 3) % TURNS})


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, size, text_crc32, nth) for each row of docs, nth counting the rows that are alike in the rest."""
    keys = ["doc_id", "size", "text_crc32"]
    groups = cut(docs.select(*measured(docs, id_col, text_col)).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))
    few = groups.filter(F.col("copies") <= STRIDE).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth"))
    many = groups.filter(F.col("copies") > STRIDE)
    if many.isEmpty():
        return few
    pieces = many.select(*keys, "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STRIDE))).alias("piece"))
    dealt = pieces.repartition(*keys, "piece")
    last = F.least(F.col("copies"), (F.col("piece") + 1) * STRIDE) - 1
    return few.unionByName(dealt.select(*keys, F.explode(F.sequence(F.col("piece") * STRIDE, last)).alias("nth")))


def stretches(nodes: list[tuple[int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(first place, last place, path) of the places that lead to each node."""
    ways, low, out = paths(nodes), 0, []
    for (at, _), path in [*zip(nodes, ways), ((POINTS - 1, 0), ways[0])]:  # past the last node comes the first
        if low <= at:
            out.append((low, at, path))
        low = at + 1
    return out


def on_ring(spark: SparkSession, nodes: list[tuple[int, int]]) -> DataFrame:
    """place and path for every place of the ring: a bounded table, made from a row a node."""
    rows = ", ".join(f"({low}, {high}, '{' '.join(map(str, path))}')" for low, high, path in stretches(nodes))
    table_of = spark.sql(f"SELECT * FROM VALUES {rows} AS nodes(low, high, path)")
    return table_of.select(F.explode(F.sequence("low", "high")).alias("place"), F.split("path", " ").cast("array<int>").alias("path"))


def by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def takes(step: tuple[int, list[int], list[int]]) -> Column:
    """Whether a row's shard of that round takes it."""
    turn, last, room = step
    asked = F.get("path", F.lit(turn))
    return (F.col("turn") <= by_shard(last, asked)) & (F.col("size") <= by_shard(room, asked))


def planned(rows: DataFrame, shards: int, slack: float) -> Plan:
    """The rounds for rows (size, turn, path)."""
    total, rest = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    plan = Plan((total or 0) * (1 + slack) / shards)
    loads, grown, asking = [0] * shards, 1.0, rows
    while rest:
        for turn in range(shards):
            room = [max(0, int(plan.bound - x)) for x in loads]
            asked = F.get("path", F.lit(turn)).alias("shard")
            fits = asking.select(asked, "turn", "size").filter(F.col("size") <= by_shard(room, F.col("shard")))
            sums = fits.groupBy("shard", "turn").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
            upto = Window.partitionBy("shard").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)  # a row a turn: bounded
            sums = sums.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= by_shard(room, F.col("shard")))
            taken = sums.groupBy("shard").agg(F.max("turn"), F.max("upto"), F.sum("n")).collect()  # a row a shard
            if not taken:
                continue
            last = [-1] * shards
            for shard, to, load, n in taken:
                last[shard] = to
                loads[shard] += load
                rest -= n
            plan.steps.append((turn, last, room))
            asking = asking.filter(~takes(plan.steps[-1]))
            if len(plan.steps) == 1:
                asking = cut(asking)
            if not rest:
                break
        plan.bound += grown * max(1.0, slack * (total or 0) / shards)
        grown *= 4
    return plan


def shard_of(plan: Plan) -> Column:
    """The shard of a row (size, turn, path)."""
    found = [F.when(takes(step), F.get("path", F.lit(step[0]))) for step in plan.steps]
    return F.coalesce(*found, F.lit(None).cast("int"))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, nth, turn, shard: a row for each row of docs."""
    around = on_ring(docs.sparkSession, ring(shards, nodes))
    rows = turned(copies(docs, id_col, text_col))
    rows = cut(rows.join(F.broadcast(around), "place"))  # POINTS rows at most
    plan = planned(rows, shards, slack)
    return rows.withColumn("shard", shard_of(plan)).drop("place", "path")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a row for each row of docs; slots count from 0 in each shard."""
    order = ["turn", "doc_id", "size", "text_crc32", "nth"]
    rows = placed(docs, id_col, text_col, shards, nodes, slack).withColumn("part", F.col("turn") % PARTS)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a shard
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)).cast("long")
    numbered = rows.withColumn("row", nth).join(F.broadcast(starts), ["shard", "part"])  # SHARDS x PARTS rows at most
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("row") - 1).alias("slot"))


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK, name: str = "shard") -> DataFrame:
    """The rows of docs with all their columns and their shard in the column name, for writing.

    Rows that repeat in id, size and crc32 are alike for the plan; which of them goes where is not fixed."""
    keys = ["doc_id", "size", "text_crc32"]
    told = cut(placed(docs, id_col, text_col, shards, nodes, slack).groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("n")))
    ways = told.groupBy(*keys).agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("shards"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(f"_{k}") for c, k in zip(measured(docs, id_col, text_col), keys)])
    met = F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_size") == F.col("size")) & (F.col("_text_crc32") == F.col("text_crc32"))
    one = whole.join(small(ways.filter("shards = 1").drop("shards")), met).select("_row.*", F.col("shard").alias(name))
    several = told.withColumn("shards", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("shards > 1")
    if several.isEmpty():
        return one
    ranges = several.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("shard")))
    nth = F.row_number().over(Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(F.lit(0)))
    alike = whole.join(small(ways.filter("shards > 1").select(*keys)), met, "left_semi").withColumn("_nth", nth)
    within = (F.col("_nth") <= F.col("upto")) & (F.col("_nth") > F.col("upto") - F.col("n"))
    return one.unionByName(alike.join(ranges, met & within).select("_row.*", F.col("shard").alias(name)))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Laps of the ring that the SQL spells out; one more than the small tables need does no harm.
SQL_LAPS = 6


def spelled(shards: int = SHARDS, slack: float = SLACK, laps: int = SQL_LAPS) -> str:
    """The rounds as SQL, one after another; the CRC-32 is computed byte by byte with the table of its polynomial."""
    nodes = ", ".join(f"({low}, {high}, {list(path)})" for low, high, path in stretches(ring(shards)))
    parts = [
        """crc_table AS MATERIALIZED (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
            FROM range(256) r(i))""",
        """measured AS MATERIALIZED (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                       lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc
            FROM documents, crc_table)""",
        "counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, crc) - 1 AS nth FROM measured)",
        f"""turned AS (
            SELECT *, row_number() OVER () AS rid, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT AS place,
                   (64 - length(bin(size))) * {TURNS} + ('0x' || substr(md5(concat_ws('/', coalesce(doc_id::VARCHAR, ''), size, crc, nth)), 1, 3))::INT AS turn
            FROM counted)""",
        f"nodes(low, high, path) AS (VALUES {nodes})",
        "rest_0 AS MATERIALIZED (SELECT turned.*, path FROM turned JOIN nodes ON place BETWEEN low AND high)",
        f"load_0 AS MATERIALIZED (SELECT s AS shard, 0::BIGINT AS load, coalesce((SELECT sum(size) FROM turned), 0)::DOUBLE AS total FROM range({shards}) r(s))",
    ]
    k = 0
    for lap in range(laps):
        more = f" + {(4**lap - 1) // 3}.0e0 * greatest(1.0e0, {slack!r}::DOUBLE * total / {shards})" if lap else ""
        for turn in range(1, shards + 1):
            k += 1
            parts += [
                f"room_{k} AS MATERIALIZED (SELECT shard, greatest(0, trunc(total * {1 + slack!r}::DOUBLE / {shards}{more} - load)::BIGINT) AS room FROM load_{k - 1})",
                f"""last_{k} AS MATERIALIZED (SELECT shard, max(turn) AS last, max(upto) AS took FROM (
                    SELECT shard, room, turn, sum(sum(size)) OVER (PARTITION BY shard ORDER BY turn) AS upto
                    FROM rest_{k - 1} JOIN room_{k} ON shard = path[{turn}] WHERE size <= room GROUP BY shard, room, turn) WHERE upto <= room GROUP BY shard)""",
                f"""got_{k} AS MATERIALIZED (SELECT rid, shard FROM rest_{k - 1} JOIN room_{k} ON shard = path[{turn}] JOIN last_{k} USING (shard)
                    WHERE turn <= last AND size <= room)""",
                f"rest_{k} AS MATERIALIZED (SELECT * FROM rest_{k - 1} ANTI JOIN got_{k} USING (rid))",
                f"load_{k} AS MATERIALIZED (SELECT l.shard, load + coalesce(took, 0)::BIGINT AS load, total FROM load_{k - 1} l LEFT JOIN last_{k} USING (shard))",
            ]
    got = " UNION ALL ".join(f"SELECT * FROM got_{j}" for j in range(1, k + 1))
    return "WITH " + ", ".join(parts) + f"""
        SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY turn % {PARTS}, turn, doc_id NULLS FIRST, size, crc, nth) - 1 AS slot, NULL::INT AS grown_shard
        FROM turned LEFT JOIN ({got}) USING (rid)"""


SQL = {"op13_sharding": spelled()}
