"""Sequenced change applier: two chained transformWithState stages over batches fed in order.

The first stage lets only the first arrival of a client's number through; its keys are pieces of the
numbers, so repeats of a hot client are rejected all over the cluster. The second stage is keyed by
slices of clients, a hot client being a slice of its own, and holds what it got until its number is
next. A call and a read and write of state cost about as much as dozens of rows, so a key has some
thousand rows; there are as many keys as the table needs. Event time is the day of a row, so the
watermark of a batch is the largest day of all earlier ones, and a timer three days after a slice's
earliest held row wakes slices without new rows.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillsieve.llm.base import dropped, shared_dir, stored, table

#: Batches, the epoch day that the first one begins with, days of all of them.
BATCHES, FIRST_DAY, DAYS = 12, 19723, 160
#: Days that a held row waits for those before it.
PATIENCE = 3
#: Rows of a slice or piece, on average; a client with more numbers than this is a slice of its own.
SLICE = 4096
#: New rows of such a client kept in memory until they are held; held rows that stand beside its position, in one read with it.
BUFFER, BESIDE = 10_000, 16
DAY_MS = 86_400_000
#: Successive numbers of a client that lie in one piece, a bit each.
WORD = 64


def ranked(rows: DataFrame) -> DataFrame:
    """rows(client_id, seq) with n, the dense rank of seq within client_id, nulls first, and the client's largest n as numbers.

    The different pairs are range-partitioned, so a client with most of them lies in many
    partitions: a pair's rank is its place in its own partition after those of earlier ones.
    """
    keys = rows.select("client_id", "seq").distinct().repartitionByRange("client_id", "seq")
    placed = stored(keys.withColumn("piece", F.spark_partition_id()))
    earlier = Window.partitionBy("client_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("client_id", "piece").agg(F.count("*").alias("size")).select(
        F.col("client_id").alias("_client"), F.col("piece").alias("_piece"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("ahead"), F.sum("size").over(Window.partitionBy("client_id")).alias("numbers"))
    inside = F.row_number().over(Window.partitionBy("client_id", "piece").orderBy(F.col("seq").asc_nulls_first()))
    numbered = placed.withColumn("inside", inside).join(offsets, F.col("client_id").eqNullSafe(F.col("_client")) & (F.col("piece") == F.col("_piece")))
    numbered = numbered.select(F.col("client_id").alias("_client"), F.col("seq").alias("_seq"), (F.col("ahead") + F.col("inside")).cast("long").alias("n"), "numbers")
    return rows.join(numbered, F.col("client_id").eqNullSafe(F.col("_client")) & F.col("seq").eqNullSafe(F.col("_seq"))).drop("_client", "_seq")


def prepared(changes: DataFrame) -> DataFrame:
    """The rows to be fed: change_id, client_id, n, day, at (the day as event time), batch, op, city, balance, and where they go.

    piece is the first stage's key, slice and owner are the second one's: clients with more than SLICE
    numbers have slice -1 and own it, owner being null for the others.
    """
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    day = (F.unix_date(F.to_date("valid_at")) + 9 * (h % 4)).cast("int")
    rows = ranked(changes.distinct()).where(F.col("valid_at").isNotNull() & (h % 11 != 0))
    batch = F.least(F.lit(BATCHES), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / DAYS)).cast("int")
    dated = rows.withColumn("day", day).withColumn("batch", batch).withColumn("at", F.timestamp_seconds(F.col("day") * F.lit(86400)))
    slices = F.lit(1 + changes.count() // SLICE)
    hot = F.col("numbers") > SLICE
    return dated.select(
        "change_id", "client_id", "n", "day", "at", "batch", "op", "city", F.col("balance").cast("double").alias("balance"),
        F.pmod(F.xxhash64("client_id", F.expr(f"n div {WORD}")), slices).alias("piece"), F.when(hot, -1).otherwise(F.pmod(F.xxhash64("client_id"), slices)).alias("slice"), F.when(hot, F.col("client_id")).alias("owner"),
    )


class FirstArrival(StatefulProcessor):
    """Marks each row of a piece: lane 0 for the first one of a client's number by day and change_id, lane 1 for those to be rejected."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.seen.get()
        seen = pickle.loads(known[0]) if known else {}
        first: dict = {}
        for row in rows:
            if row.change_id is None:
                continue  # a tick
            client, n = row.client_id, row.n
            if seen.get((client, n // WORD), 0) >> n % WORD & 1:
                yield self._out(row, 1)
                continue
            other = first.setdefault((client, n), row)
            if other is not row:
                early, late = (row, other) if self._order(row) < self._order(other) else (other, row)
                first[client, n] = early
                yield self._out(late, 1)
        for (client, n), row in first.items():
            seen[client, n // WORD] = seen.get((client, n // WORD), 0) | 1 << n % WORD
            yield self._out(row, 0)
        if first:
            self.seen.update((pickle.dumps(seen),))

    @staticmethod
    def _order(row: Row) -> tuple:
        """Day and change_id; rows equal in both by what they say."""
        return (row.day, row.change_id, *[(x is not None, x) for x in (row.op, row.city, row.balance)])

    @staticmethod
    def _out(row: Row, lane: int) -> Row:
        """Rejected rows pass the second stage under the piece's number."""
        where = (row.piece, None) if lane else (row.slice, row.owner)
        return _PASSED(row.change_id, row.client_id, row.n, row.day, row.at, row.op, row.city, row.balance, *where, lane)

    def close(self) -> None:
        pass


_PASSED = Row("change_id", "client_id", "n", "day", "at", "op", "city", "balance", "slice", "owner", "lane")
_STEP = Row("change_id", "client_id", "n", "op", "status", "batch", "missed", "city", "balance")


class _Position:
    """Where a client stands: its next number, what is known of it, and the rows held in memory; waiting more are in the map state."""

    __slots__ = ("next", "city", "balance", "waiting", "earliest", "beside")

    def __init__(self, next: int = 1, city: str | None = None, balance: float | None = None, waiting: int = 0, earliest: int | None = None, beside: dict | None = None) -> None:
        self.next, self.city, self.balance, self.waiting, self.earliest = next, city, balance, waiting, earliest
        self.beside = {} if beside is None else beside

    def values(self) -> tuple:
        return self.next, self.city, self.balance, self.waiting, self.earliest, self.beside

    def holds(self) -> bool:
        return bool(self.waiting or self.beside)


class Sequencer(StatefulProcessor):
    """Applies the rows of each client of a slice in the order of their numbers; rows of other lanes are rejected ones passing through.

    Numbers that come here are different, so within a batch their order decides nothing, and rows
    need no sorting: what can't be applied yet is held as state. The watermark is the largest day of
    earlier batches; a slice with new rows jumps before it takes them, the others by their timers.
    From the day `end` on every held row has waited long enough, and what is applied then counts as
    the batch after this one. A client that is a slice of its own keeps most held rows in a map state.
    """

    def __init__(self, batch: int, end: int) -> None:
        self.batch, self.end = batch, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "timer long, clients binary")
        self.held = handle.getMapState("held", "n long", "change_id long, day int, op string, city string, balance double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number, _, lane = key
        if lane:
            for row in rows:
                yield self._rejected(row)
            return
        alone = number < 0
        self._load()
        yield from self._wake(timerValues)
        for row in rows:
            at = self.clients.get(row.client_id)
            if at is None:
                at = self.clients[row.client_id] = _Position()
            if row.n < at.next:
                yield self._rejected(row)
                continue
            at.beside[row.n] = (row.change_id, row.day, row.op, row.city, row.balance)
            at.earliest = row.day if at.earliest is None else min(at.earliest, row.day)
            yield from self._drain(row.client_id, at, self.batch)
            if alone and len(at.beside) >= BUFFER:
                self._set_aside(at)
        if alone:
            for at in self.clients.values():
                self._set_aside(at)
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        if self.timer == expiredTimerInfo.getExpiryTimeInMs():
            self.timer = None  # gone with this call
        yield from self._wake(timerValues)
        self._save()

    def _load(self) -> None:
        self.timer, clients = self.now.get() or (None, None)
        self.clients = {client: _Position(*values) for client, values in pickle.loads(clients).items()} if clients else {}

    def _save(self) -> None:
        """Writes the slice, and has one timer, for what it holds earliest."""
        due = min(((at.earliest + PATIENCE) * DAY_MS - 1 for at in self.clients.values() if at.holds()), default=None)
        if due != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.now.update((due, pickle.dumps({client: at.values() for client, at in self.clients.items()})))

    def _wake(self, timerValues) -> Iterator[Row]:
        """Lets each client jump to what has waited long enough."""
        day = timerValues.getCurrentWatermarkInMs() // DAY_MS
        for client, at in self.clients.items():
            if at.holds() and at.earliest <= day - PATIENCE:
                yield from self._jump(client, at, day)

    def _jump(self, client, at: _Position, day: int) -> Iterator[Row]:
        """Applies what has waited long enough, skipping the numbers before it."""
        days = [(n, value[1]) for n, value in at.beside.items()]
        if at.waiting:
            days += [(tuple(k)[0], tuple(v)[1]) for k, v in self.held.iterator()]
        days.sort()
        earliest = [0] * len(days)  # of each and all later numbers
        for k in range(len(days) - 1, -1, -1):
            earliest[k] = min(days[k][1], earliest[k + 1] if k + 1 < len(days) else days[k][1])
        for k, (n, _) in enumerate(days):
            if n < at.next:
                continue  # applied since
            at.earliest = earliest[k]
            if earliest[k] > day - PATIENCE:
                break
            missed, at.next = n - at.next, n
            yield from self._drain(client, at, self.batch + (day >= self.end), missed)

    def _set_aside(self, at: _Position) -> None:
        """Moves rows held in memory to the map state, if they are many."""
        if len(at.beside) > BESIDE:
            for n, value in at.beside.items():
                self.held.updateValue((n,), value)
            at.waiting += len(at.beside)
            at.beside = {}

    def _drain(self, client, at: _Position, batch: int, missed: int = 0) -> Iterator[Row]:
        """Applies what is next as long as it is there."""
        while True:
            value = at.beside.pop(at.next, None)
            if value is None and at.waiting:
                value = self.held.getValue((at.next,))
                if value is not None:
                    self.held.removeKey((at.next,))
                    at.waiting -= 1
            if value is None:
                break
            change_id, _, op, city, balance = value
            if op == "D":
                at.city = at.balance = None
            elif op == "I":
                at.city, at.balance = city, balance
            else:
                at.city = at.city if city is None else city
                at.balance = at.balance if balance is None else balance
            yield _STEP(change_id, client, at.next, op, "applied", batch, missed, at.city, at.balance)
            at.next, missed = at.next + 1, 0
        if not at.holds():
            at.earliest = None

    def _rejected(self, row: Row) -> Row:
        return _STEP(row.change_id, row.client_id, row.n, row.op, "rejected", self.batch, 0, None, None)

    def close(self) -> None:
        pass


def _session(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream's settings, with the given one's partitions and time zone."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Each start opens its stores anew: they don't reserve disk ahead and are closed as soon as a task has committed.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    own.conf.set("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own


def applied(changes: DataFrame) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, cents, current of each row that takes part.

    Different rows of changes(change_id, client_id, seq, op, valid_at, city, balance, ...) are
    numbered by seq within a client; then rows without valid_at or change_id, and those whose digest
    is divisible by 11, vanish. The rest goes in batches by day through a streaming query that is
    started anew for each batch on one checkpoint. A number is applied once all before it are, or
    once the watermark has passed the days of patience of a held row and next jumps; the rest is
    applied after the last batch. Repeats of a number and numbers already passed are rejected.

    I sets city and balance, D nulls both, any other op (null too) sets those that aren't null. Rows
    without client_id are those of one client; a null seq comes before all others; rows equal in day
    and change_id arrive in the order of op, city and balance. Days before the first batch make
    batches of 0 and less, fed first. Texts may be of any length; an empty table gives no rows.
    """
    spark = changes.sparkSession
    root = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    rows = prepared(changes)
    lanes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows.repartition("batch", F.pmod(F.xxhash64("change_id"), F.lit(lanes))).write.partitionBy("batch").parquet(f"{root}/batches")
    batches = spark.read.schema(rows.schema).parquet(f"{root}/batches")
    found = batches.groupBy("batch").agg(F.max("day").alias("day")).collect()  # a row a batch
    if not found:
        return _result(spark.createDataFrame([], _out_schema(rows)))
    last = max(r["day"] for r in found)
    numbers = sorted({*range(1, BATCHES + 1), *(r["batch"] for r in found)})
    fields = [c for c in rows.columns]

    def tick(day: int) -> DataFrame:
        """A row without change_id, which only carries its day."""
        values = {c: F.lit(None).cast(kind) for c, kind in rows.dtypes} | {"n": F.lit(0).cast("long"), "day": F.lit(day), "at": F.timestamp_seconds(F.lit(day * 86400)), "batch": F.lit(BATCHES), "piece": F.lit(0).cast("long"), "slice": F.lit(0).cast("long")}
        return spark.range(1).select(*[values[c].alias(c) for c in fields])

    own = _session(spark)
    seen = {r["batch"]: r["day"] for r in found}
    for number in numbers:
        batches.where(F.col("batch") == number).select(fields).write.mode("append").parquet(f"{root}/feed")
        if number == numbers[-1]:
            # A row that moves the watermark past all days; the stream then goes on without data once.
            tick(last + PATIENCE).write.mode("append").parquet(f"{root}/feed")
            own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
        elif number not in seen:
            # An empty batch is a batch, too: what has waited long enough moves at its start.
            tick(max((d for b, d in seen.items() if b < number), default=0)).write.mode("append").parquet(f"{root}/feed")
        feed = own.readStream.schema(rows.schema).parquet(f"{root}/feed").withWatermark("at", "0 seconds")
        unique = feed.groupBy("piece").transformWithState(FirstArrival(), _lane_schema(rows), "Append", "None", eventTimeColumnName="at")
        steps = unique.groupBy("slice", "owner", "lane").transformWithState(Sequencer(number, last + PATIENCE), _out_schema(rows), "Append", "EventTime")
        run = steps.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").start()
        run.awaitTermination()
    return _result(spark.read.schema(_out_schema(rows)).parquet(f"{root}/out"))


def _lane_schema(rows: DataFrame) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in [*[x for x in rows.dtypes if x[0] not in ("batch", "piece")], ("lane", "bigint")])


def _out_schema(rows: DataFrame) -> str:
    kinds = dict(rows.dtypes)
    return f"change_id {kinds['change_id']}, client_id {kinds['client_id']}, n bigint, op string, status string, batch int, missed bigint, city string, balance double"


def _result(steps: DataFrame) -> DataFrame:
    """What the stream wrote, with the last applied row of each client marked."""
    final = steps.where("status = 'applied'").groupBy("client_id").agg(F.max("n").alias("_n")).withColumnRenamed("client_id", "_client")
    joined = steps.join(final, F.col("client_id").eqNullSafe(F.col("_client")), "left")
    current = (F.col("status") == "applied") & (F.col("n") == F.col("_n")) & (F.coalesce("op", F.lit("")) != "D")
    return joined.select(
        "change_id", "client_id", "status", "batch", "missed", "city", F.floor(100 * F.col("balance") + 0.5).cast("long").alias("cents"), F.coalesce(current, F.lit(False)).alias("current")
    )


def op12(spark, sf_dir) -> DataFrame:
    """All changes applied in sequence."""
    return applied(table(spark, sf_dir, "client_changes"))
