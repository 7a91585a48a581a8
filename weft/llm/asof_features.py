"""Point-in-time features: as-of joins of questions with cumulative tables of known and of expired rows, by client-time shards."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.scans import carried, sliced
from weft.llm.texts import give_back
from weft.session import materialise, release

DAY, MINUTE = 86_400_000_000, 60_000_000
KNOWN, EXPIRED, ASKED = 0, 1, 2
CLICK, SALE, LINE, ITEM, AHEAD = range(5)
#: Feature, kind of its rows, their column that it adds up.
FEATURES = [
    ("n_clicks", CLICK, "n"), ("n_purchases", CLICK, "m"), ("click_cents", CLICK, "cents"), ("n_sales", SALE, "n"), ("sale_cents", SALE, "cents"),
    ("n_lines", LINE, "n"), ("n_items", ITEM, "n"), ("line_cents", LINE, "cents"),
]
START = NO_ID = -(2**63) + 1
COLUMNS = ["client", "at", "side", "kind", "mask", "n", "m", "cents", "ts", "id"]


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp's own digits, whatever the session's zone."""
    seconds = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECONDS"), at) * 1_000_000).cast("long")


def cents(x: Column) -> Column:
    """floor(100 x + 0.5); null and what isn't finite give 0."""
    sound = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 9e16)
    return F.when(sound, F.floor(x * 100 + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def _rows(df: DataFrame, kind: int, **given: Column) -> DataFrame:
    """`df`, which has client, at, side and mask, in the columns of all rows."""
    zero = F.lit(0).cast("long")
    known = {"kind": F.lit(kind), "n": zero, "m": zero, "cents": zero, "ts": F.lit(None).cast("long"), "id": F.lit(None).cast("long")} | given
    return df.select(*[known[c].alias(c) if c in known else F.col(c) for c in COLUMNS])


def _in_and_out(df: DataFrame, spans: list[int]) -> DataFrame:
    """A row at `known` and one at `ts` plus each span, without spans that end before the row is known. mask: the spans of a row as bits."""
    open_ = [F.col("known") < F.col("ts") + s for s in spans]
    mask = sum((F.when(o, 1 << i).otherwise(0) for i, o in enumerate(open_)), F.lit(0))
    edge = lambda at, side, mask: F.struct(at.alias("at"), F.lit(side).alias("side"), mask.alias("mask"))
    edges = [F.when(mask > 0, edge(F.col("known"), KNOWN, mask)), *[F.when(o, edge(F.col("ts") + s, EXPIRED, F.lit(1 << i))) for i, (o, s) in enumerate(zip(open_, spans, strict=True))]]
    return df.withColumn("edge", F.explode(F.filter(F.array(*edges), lambda e: e.isNotNull()))).select("*", "edge.*").drop("edge")


def _covered(lines: DataFrame, spans: list[int], slice_rows: int) -> DataFrame:
    """Edges of the unions of each client's and item's spans, so that a sum counts distinct items.

    A span opens a union if all earlier spans of the pair end before it; then
    what they end with closes one, as does the pair's last end. The running
    maximum of ends is taken by slices of a hot pair, with carried maxima.
    """
    ends = [f"end{i}" for i in range(len(spans))]
    firsts = lines.where("item is not null").groupBy("client", "item", "ts").agg(F.min("known").alias("known"))
    firsts = firsts.select("client", "item", "known", *[F.when(F.col("known") < F.col("ts") + s, F.col("ts") + s).alias(e) for s, e in zip(spans, ends, strict=True)])
    rows, _ = sliced(firsts, ["client", "item"], "known", slice_rows)
    key = ["client", "item", "slice"]
    hot = rows.where("hot").groupBy(*key).agg(*[F.max(e).alias(e) for e in ends])
    carry = carried(hot, ["client", "item"], "slice", maxes=ends)
    before = Window.partitionBy(*key).orderBy("known").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.select(*key, "known", *ends, *[F.max(e).over(before).alias(f"own_{e}") for e in ends]).join(carry.select(*key, *[F.col(e).alias(f"carry_{e}") for e in ends]), key, "left")
    earlier = [F.greatest(f"own_{e}", f"carry_{e}") for e in ends]
    opens = [F.coalesce(F.col(e) > F.coalesce(p, F.lit(START)), F.lit(False)) & F.coalesce(p < F.col("known"), F.lit(True)) for e, p in zip(ends, earlier, strict=True)]
    edge = lambda at, side, mask: F.struct(at.alias("at"), F.lit(side).alias("side"), mask.alias("mask"))
    mask = sum((F.when(o, 1 << i).otherwise(0) for i, o in enumerate(opens)), F.lit(0))
    edges = [F.when(mask > 0, edge(F.col("known"), KNOWN, mask)), *[F.when(o & p.isNotNull(), edge(p, EXPIRED, F.lit(1 << i))) for i, (o, p) in enumerate(zip(opens, earlier, strict=True))]]
    inner = seen.select("client", F.explode(F.filter(F.array(*edges), lambda e: e.isNotNull())).alias("edge")).select("client", "edge.*")
    last = firsts.groupBy("client", "item").agg(*[F.max(e).alias(e) for e in ends])
    closing = [F.when(F.col(e).isNotNull(), edge(F.col(e), EXPIRED, F.lit(1 << i))) for i, e in enumerate(ends)]
    outer = last.select("client", F.explode(F.filter(F.array(*closing), lambda e: e.isNotNull())).alias("edge")).select("client", "edge.*")
    return inner.unionByName(outer)


def _baselines(rows: DataFrame, heavy: DataFrame, bits: list[int]) -> DataFrame:
    """What earlier shards of a client carry into each of its shards, as rows at the shard's very start."""
    kinds = [(side, kind, bit) for side in (KNOWN, EXPIRED) for kind in (CLICK, SALE, LINE, ITEM) for bit in bits] + [(side, AHEAD, 1) for side in (KNOWN, EXPIRED)]
    key = ["client", "side", "kind", "bit"]
    grid = heavy.select("client", F.explode(F.sequence(F.lit(0).cast("long"), F.col("key_parts") - 1)).alias("slice"))
    cell = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).alias("kind"), F.lit(b).alias("bit")) for s, k, b in kinds])
    grid = grid.withColumn("cell", F.explode(cell)).select("client", "slice", "cell.*")
    last = F.max(F.when((F.col("kind") == CLICK) & (F.col("side") == KNOWN), F.struct("ts", "id"))).alias("last")
    sums = [F.sum(c).alias(c) for c in ("n", "m", "cents")]
    # added up by mask first: what is dealt to its bits are totals, not a hot client's rows
    by_mask = rows.where(F.col("hot") & (F.col("side") < ASKED)).groupBy("client", "side", "kind", "mask", "slice").agg(*sums, last)
    by_bit = by_mask.withColumn("bit", F.explode(F.filter(F.array(*map(F.lit, bits)), lambda b: F.col("mask").bitwiseAND(b) != 0)))
    totals = by_bit.groupBy(*key, "slice").agg(*sums, F.max("last").alias("last"))
    before = carried(grid.join(totals, [*key, "slice"], "left"), key, "slice", sums=["n", "m", "cents"], maxes=["last"])
    used = before.where("n <> 0 or m <> 0 or cents <> 0 or last is not null")
    return used.select("client", F.lit(START).alias("at"), "side", "kind", F.col("bit").alias("mask"), "n", "m", "cents", F.col("last.ts").alias("ts"), F.col("last.id").alias("id"), "slice")


def _sql(days: list[int]) -> str:
    """The as-of joins of one task's shards: cumulative tables by kind of row, each question asked of every kind."""
    sums = [(f"{c}_{i}", f"sum({c}) FILTER (mask & {1 << i} <> 0)") for i in range(len(days)) for c in ("n", "m", "cents")]

    def cumulative(side: int) -> str:
        columns = ", ".join(f"coalesce({what}, 0)::BIGINT AS {name}" for name, what in sums)
        running = ", ".join(f"(sum({name}) OVER w)::BIGINT AS {name}" for name, _ in sums)
        last = f", max(CASE WHEN ts IS NOT NULL THEN {{'ts': ts, 'id': id}} END) AS last" if side == KNOWN else ""
        ever = ", max(last) OVER w AS last" if side == KNOWN else ""
        return f"""SELECT client, slice, kind, moment, {running}{ever} FROM (
  SELECT client, slice, kind, "at" AS moment, {columns}{last} FROM given WHERE side = {side} GROUP BY ALL)
  WINDOW w AS (PARTITION BY client, slice, kind ORDER BY moment)"""

    left = ", ".join(f"coalesce(k.{name}, 0) - coalesce(e.{name}, 0) AS {name}" for name, _ in sums)
    on = "a.client = {0}.client AND a.slice = {0}.slice AND a.kind = {0}.kind AND a.moment >= {0}.moment"
    of = lambda column, kind: f"max(CASE WHEN kind = {kind} THEN {column} END)"
    wide = ", ".join(f"{of(f'{column}_{i}', kind)} AS {name}_{i}" for i in range(len(days)) for name, kind, column in FEATURES)
    each = " UNION ALL ".join(
        f"SELECT id AS sale_id, {d}::INTEGER AS d, moment AS t_us, ahead > 0 AS label, {', '.join(f'{name}_{i} AS {name}' for name, *_ in FEATURES[:3])}, "
        f"CASE WHEN last.ts > moment - {d * DAY} THEN nullif(last.id, {NO_ID}::BIGINT) END AS last_click_id, {', '.join(f'{name}_{i} AS {name}' for name, *_ in FEATURES[3:])} FROM found"
        for i, d in enumerate(days)
    )
    return f"""WITH known AS MATERIALIZED ({cumulative(KNOWN)}), expired AS MATERIALIZED ({cumulative(EXPIRED)}),
asked AS (SELECT row_number() OVER () AS nth, id, client, slice, "at" AS moment FROM given WHERE side = {ASKED}),
by_kind AS (SELECT a.nth, a.id, a.moment, a.kind, {left}, k.last FROM (SELECT *, unnest([{CLICK}, {SALE}, {LINE}, {ITEM}, {AHEAD}])::INTEGER AS kind FROM asked) a
  ASOF LEFT JOIN known k ON {on.format("k")} ASOF LEFT JOIN expired e ON {on.format("e")}),
found AS MATERIALIZED (SELECT id, moment, {wide}, {of("n_0", AHEAD)} AS ahead, {of("last", CLICK)} AS last FROM by_kind GROUP BY nth, id, moment)
{each}"""


RESULT = pa.schema(
    [("sale_id", pa.int64()), ("d", pa.int32()), ("t_us", pa.int64()), ("label", pa.bool_())]
    + [(c, pa.int64()) for c in ("n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")]
)


def point_in_time(
    asks: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame, days: tuple[int, ...] = (2, 14), lag_minutes: int = 240,
    ahead_days: int = 7, slice_rows: int = 50_000, task_rows: int = 250_000,
) -> DataFrame:
    """Features of each question (id, client_id, t in microseconds) for each window of `days`, as they were known at t.

    A click or sale counts in (t - d, t] if it had arrived `lag_minutes` before
    t; a line if its sale counts and it was shipped by t. label: a sale of the
    client in (t, t + ahead_days], whenever it arrived. Every row enters the
    client's cumulative table of known rows when it is known and that of expired
    rows when a window ends; what a question has is the difference of the two
    rows that precede t. Distinct items enter and leave by the unions of their
    spans; the last click is a running maximum.

    Clients over `slice_rows` rows are cut into slices of time, and each shard
    (client, slice) starts with what earlier ones carry, from a scan of their
    totals in two levels. Shards are dealt over tasks of about `task_rows` rows,
    where the database joins them. Rows of one client and instant are added up
    before (lines) or stay under the slice's length, so no shard holds a client.

    Questions with a null client or t give no row; repeated ones give one each.
    Clicks equal in all columns count once. Rows without client, time or arrival
    count nowhere (a sale without arrival still labels); null values are 0
    cents; null items count as lines, not as items; lines without a sale or
    shipping time don't count. Sales of one id each have its lines. A null click
    id is below all others. Empty tables give no rows or zeros. Other columns
    are ignored but for telling clicks apart.
    """
    spans, bits = [d * DAY for d in days], [1 << i for i in range(len(days))]
    lag = lag_minutes * MINUTE
    seen = clicks.where("client_id is not null and ts is not null and arrived_at is not null").distinct()
    seen = seen.select(F.col("client_id").alias("client"), micros(F.col("ts")).alias("ts"), F.greatest(micros(F.col("ts")), micros(F.col("arrived_at")) + lag).alias("known"), "kind", "value", F.coalesce("click_id", F.lit(NO_ID)).alias("click"))
    seen = _in_and_out(seen.withColumnRenamed("kind", "what"), spans)
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    entered = F.col("side") == KNOWN
    parts = [_rows(seen, CLICK, n=one, m=F.coalesce((F.col("what") == "purchase").cast("long"), F.lit(0)), cents=cents(F.col("value")), ts=F.when(entered, F.col("ts")).otherwise(none), id=F.when(entered, F.col("click")).otherwise(none))]
    sold = sales.where("client_id is not null and sold_at is not null").select("sale_id", F.col("client_id").alias("client"), micros(F.col("sold_at")).alias("ts"), (micros(F.col("arrived_at")) + lag).alias("arrived"), F.col("total"))
    known = sold.where("arrived is not null").withColumn("known", F.greatest("ts", "arrived"))
    parts.append(_rows(_in_and_out(known, spans), SALE, n=one, cents=cents(F.col("total"))))
    both = F.array(F.struct((F.col("ts") - ahead_days * DAY).alias("at"), F.lit(KNOWN).alias("side")), F.struct(F.col("ts").alias("at"), F.lit(EXPIRED).alias("side")))
    parts.append(_rows(sold.select("client", F.explode(both).alias("edge")).select("client", "edge.*", F.lit(1).alias("mask")), AHEAD, n=one))
    shipped = lines.where("sale_id is not null and shipped_at is not null").select("sale_id", F.col("item_id").alias("item"), micros(F.col("shipped_at")).alias("shipped"), cents(F.col("amount")).alias("cents"))
    bought = shipped.join(known.select("sale_id", "client", "ts", "known"), "sale_id").withColumn("known", F.greatest("known", "shipped")).where(F.col("known") < F.col("ts") + max(spans))
    bought = materialise(bought.groupBy("client", "ts", "known", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")))
    at_once = bought.groupBy("client", "ts", "known").agg(F.sum("n").alias("lines"), F.sum("cents").alias("amount"))
    parts.append(_rows(_in_and_out(at_once, spans), LINE, n=F.col("lines"), cents=F.col("amount")))
    parts.append(_rows(_covered(bought, spans, slice_rows), ITEM, n=one))
    wanted = asks.where("client_id is not null and t is not null").select(F.col("client_id").alias("client"), F.col("t").alias("at"), F.lit(ASKED).alias("side"), F.lit(0).alias("mask"), "id")
    parts.append(_rows(wanted, CLICK, id=F.col("id")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = materialise(rows)
    release(bought)
    shards, heavy = sliced(rows, ["client"], "at", slice_rows)
    tasks = max(1, math.ceil(rows.count() / task_rows))
    given = shards.drop("hot").unionByName(_baselines(shards, heavy, bits)).repartition(tasks, "client", "slice")
    sql = _sql(list(days))

    def joined(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            with duckdb.connect(config={"threads": 1, "memory_limit": "1GB"}) as db:
                db.register("given", pa.Table.from_batches(held))
                found = db.sql(sql).to_arrow_table().cast(RESULT)
            del held
            yield from found.to_batches(max_chunksize=20_000)
            del found
        give_back()

    return given.mapInArrow(joined, "sale_id long, d int, t_us long, label boolean, n_clicks long, n_purchases long, click_cents long, last_click_id long, n_sales long, sale_cents long, n_lines long, n_items long, line_cents long")


def op12_point_in_time(spark, sf_dir: str) -> DataFrame:
    """All sales, each at up to three days after it was made, with windows of 2 and 14 days."""
    clicks, sales, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sales", "sale_lines"))
    delay = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 259_200, F.lit(0)) * 1_000_000
    asks = sales.select(F.col("sale_id").alias("id"), "client_id", (micros(F.col("sold_at")) + delay).alias("t"))
    return point_in_time(asks, clicks, sales, lines)


ORACLE = """
WITH s AS (
  SELECT sale_id, client_id, sold_at, arrived_at, total,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 259200 AS delay
  FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
q AS (SELECT row_number() OVER () AS q, sale_id, client_id, epoch_us(sold_at) + coalesce(delay, 0) * 1000000 AS t FROM s),
w AS (SELECT q.*, d FROM q, (VALUES (2), (14)) AS v(d)),
c AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL),
cc AS (SELECT client_id, epoch_us(ts) AS ts, epoch_us(arrived_at) + 14400000000 AS k, click_id, kind, CAST(floor(100 * coalesce(value, 0) + 0.5) AS BIGINT) AS cents FROM c),
ss AS (SELECT sale_id, client_id, epoch_us(sold_at) AS ts, epoch_us(arrived_at) + 14400000000 AS k, CAST(floor(100 * coalesce(total, 0) + 0.5) AS BIGINT) AS cents FROM s),
f1 AS (SELECT q, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(cents) AS click_cents, nullif(arg_max(coalesce(click_id, -9223372036854775807), (ts, coalesce(click_id, -9223372036854775807))), -9223372036854775807) AS last_click_id
       FROM w JOIN cc USING (client_id) WHERE ts > t - d * 86400000000 AND ts <= t AND k <= t GROUP BY q, d),
ws AS (SELECT q, d, t, ss.sale_id, cents FROM w JOIN ss USING (client_id) WHERE ts > t - d * 86400000000 AND ts <= t AND k <= t),
f2 AS (SELECT q, d, count(*) AS n_sales, sum(cents) AS sale_cents FROM ws GROUP BY q, d),
f3 AS (SELECT q, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(CAST(floor(100 * coalesce(amount, 0) + 0.5) AS BIGINT)) AS line_cents
       FROM ws JOIN sale_lines USING (sale_id) WHERE epoch_us(shipped_at) <= t GROUP BY q, d),
lab AS (SELECT DISTINCT q FROM q JOIN ss USING (client_id) WHERE ts > t AND ts <= t + 604800000000)
SELECT w.sale_id, CAST(d AS INTEGER) AS d, t AS t_us, lab.q IS NOT NULL AS label,
       coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id,
       coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM w LEFT JOIN f1 USING (q, d) LEFT JOIN f2 USING (q, d) LEFT JOIN f3 USING (q, d) LEFT JOIN lab ON lab.q = w.q"""
