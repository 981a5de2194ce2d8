"""References to records that do not exist, as keyed state that moves on with the events of every key, in their order.

Parent rows are events (a lifetime begins, a lifetime ends) and so are references. Per key the state is how many lifetimes are
open, whether the key was ever seen and how many references it has. A reference whose key has no open lifetime becomes an
orphan: it waits if the key was never seen (`missing`), else it is `deleted`. The first arrival of a key resolves the waiting
ones, which become `late`. Beginning lifetimes close the open references of their key, and the end of the last one reopens
all of them: every such change is logged with its time, and snapshots add these changes up.

A delivery is any part of the events in the order of their times, from one micro-batch to the whole tables. Everything the state
holds is a log: a delivery reads the state of the keys it touches and appends rows, it rewrites nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .skew import heavy_keys, salt, salt_count

#: After so many deliveries the log of keys is reduced to its newest rows.
COMPACT = 20
#: The order of events of one time: what was carried over, then parents, then references.
_CARRIED, _PARENT, _REFERENCE = 0, 1, 2
_ORPHAN = ["ref_field", "ref_id", "key", "at", "kind"]


@dataclass(frozen=True)
class Reference:
    """One referring column: field names it in results; child rows have id and key, parents have the key and lifetimes."""

    field: str
    id: str
    key: str
    arrived: str = "loaded_at"
    parent_key: str | None = None
    parent_from: str = "loaded_at"
    parent_until: str = "deleted_at"


def not_blank(column: str) -> Column:
    """True for values that refer to something: not null and not made of white space alone."""
    return F.col(column).isNotNull() & ~F.col(column).rlike(r"\A\s*\z")


def references(child: DataFrame, ref: Reference) -> DataFrame:
    """(ref_id, key, at): the references of a child table; null and blank keys are none. Repeated rows stay."""
    return child.where(not_blank(ref.key)).select(F.col(ref.id).alias("ref_id"), F.col(ref.key).alias("key"), F.col(ref.arrived).alias("at"))


def lifetimes(parent: DataFrame, ref: Reference) -> DataFrame:
    """(key, f, u): the different lifetimes of a parent table's non-null keys; u is null while they last."""
    rows = parent.where(F.col(ref.parent_key or ref.key).isNotNull())
    return rows.select(F.col(ref.parent_key or ref.key).alias("key"), F.col(ref.parent_from).alias("f"), F.col(ref.parent_until).alias("u")).distinct()


#: Where a lifetime of a delivery comes from: it begins now; it began before and now gets its end; its end, known before, is reached.
_NEW, _CLOSED, _DUE = 0, 1, 2


def _real() -> Column:
    """A lifetime that ends before it begins, or has no beginning, makes its key known and nothing else."""
    return F.col("f").isNotNull() & (F.col("u").isNull() | (F.col("f") < F.col("u")))


def _ended(until: datetime | None) -> Column:
    """Whether the end of a lifetime lies within the deliveries so far."""
    return F.col("u").isNotNull() if until is None else F.coalesce(F.col("u") <= F.lit(until), F.lit(False))


def _events(refs: DataFrame, lives: DataFrame, carried: DataFrame | None, until: datetime | None) -> DataFrame:
    """(key, at, place, delta, seen, n, ref_id) of references, lifetimes (with ``source``) and carried keys."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    begin = F.when(F.col("source") == _NEW, F.struct(F.col("f").alias("at"), F.when(_real(), one).otherwise(zero).alias("delta"), F.lit(True).alias("seen")))
    end = F.when(_real() & _ended(until), F.struct(F.col("u").alias("at"), (-one).alias("delta"), F.lit(True).alias("seen")))
    parents = lives.select("key", F.explode(F.array_compact(F.array(begin, end))).alias("e"))
    empty = F.lit(None).cast(refs.schema["ref_id"].dataType).alias("ref_id")
    parents = parents.select("key", "e.at", F.lit(_PARENT).alias("place"), "e.delta", "e.seen", zero.alias("n"), empty)
    # a reference without time is judged, but counted in no snapshot
    asked = refs.select("key", "at", F.lit(_REFERENCE).alias("place"), zero.alias("delta"), F.lit(False).alias("seen"), F.col("at").isNotNull().cast("bigint").alias("n"), "ref_id")
    found = asked.unionByName(parents)
    if carried is not None:
        before = carried.select("key", F.lit(None).cast(refs.schema["at"].dataType).alias("at"), F.lit(_CARRIED).alias("place"), F.col("live").alias("delta"), "seen", "n", empty)
        found = found.unionByName(before)
    return found


def _in_order(events: DataFrame, heavy: list, salts: int) -> DataFrame:
    """events with the state of their key after each (live, known, sofar) and at the end of the delivery (ever).

    One shuffle by key and one sort. The references of heavy keys are spread over ``salts`` parts, each of which sees all parent events of its keys; what
    a key brings along counts in its first part only. The window runs through a part row by row and spills, whatever its length.
    """
    if heavy:
        every = F.when(F.col("key").isin(heavy) & (F.col("place") != _REFERENCE), F.sequence(F.lit(0), F.lit(salts - 1)))
        own = salt("key", ["ref_id", "at"], heavy, salts)
        events = events.withColumn("_salt", F.explode(F.coalesce(every, F.array(own)))).withColumn("n", F.when((F.col("place") == _CARRIED) & (F.col("_salt") > 0), 0).otherwise(F.col("n")))
    else:
        events = events.withColumn("_salt", F.lit(0))
    order = Window.partitionBy("key", "_salt").orderBy(F.col("at").asc_nulls_first(), "place")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return events.withColumns({"live": F.sum("delta").over(upto), "known": F.max("seen").over(upto), "ever": F.max("seen").over(whole), "sofar": F.sum("n").over(upto)})


def _orphaned(ordered: DataFrame, ref: Reference) -> DataFrame:
    """The references that met no open lifetime, by what their key was like. Without a time of arrival they count as earlier than everything."""
    waits = F.col("at").isNull() | ~F.col("known")
    kind = F.when(waits & ~F.col("ever"), "missing").when(waits, "late").otherwise("deleted")
    rows = ordered.where((F.col("place") == _REFERENCE) & (F.col("at").isNull() | (F.col("live") == 0)))
    return rows.select(F.lit(ref.field).alias("ref_field"), "ref_id", "key", "at", kind.alias("kind"))


def _changed(ordered: DataFrame, ref: Reference) -> DataFrame:
    """(ref_field, at, delta, n): by how much the number of open references changes at a time, and how many references arrive."""
    after = F.when(F.col("live") == 0, F.col("sofar")).otherwise(0)
    before = F.when(F.col("live") - F.col("delta") == 0, F.col("sofar") - F.col("n")).otherwise(0)
    rows = ordered.where((F.col("place") != _CARRIED) & F.col("at").isNotNull()).select("at", (after - before).alias("delta"), "n").where("delta <> 0 OR n > 0")
    month = F.trunc("at", "month").cast(ordered.schema["at"].dataType)  # what changes nothing is only counted
    return rows.groupBy(F.lit(ref.field).alias("ref_field"), F.when(F.col("delta") != 0, F.col("at")).otherwise(month).alias("at")).agg(F.sum("delta").alias("delta"), F.sum("n").alias("n"))


#: The logs of the state, in the order of their making.
LOGS = ("keys", "open", "found", "resolved", "changes")


@dataclass
class OrphanState:
    """Keyed state of one reference after some deliveries, as logs that only grow.

    keys (key, live, seen, n, version): the state of each touched key after a delivery; the newest version holds. open (key, f, u, n): lifetimes
    that last beyond a delivery, -1 where they got their end or reached it. found: orphans with their kind when found. resolved: waiting orphans
    whose key came in a later delivery. changes: see snapshots().
    """

    keys: DataFrame | None = None
    open: DataFrame | None = None
    found: DataFrame | None = None
    resolved: DataFrame | None = None
    changes: DataFrame | None = None
    version: int = 0

    def known_keys(self, touched: DataFrame | None = None) -> DataFrame:
        """(key, live, seen, n): the newest row of each key, or of the keys ``touched``."""
        rows = self.keys if touched is None else self.keys.join(touched, "key", "left_semi")
        newest = rows.groupBy("key").agg(F.max(F.struct("version", "live", "seen", "n")).alias("k"))
        return newest.select("key", "k.live", "k.seen", "k.n")

    def _lives(self, parent: DataFrame, ref: Reference, until: datetime | None) -> DataFrame:
        """(key, f, u, source): the lifetimes that a delivery begins or ends."""
        rows = lifetimes(parent, ref)
        if self.keys is None:
            return rows.withColumn("source", F.lit(_NEW))
        lasting = lambda rows: rows.groupBy("key", "f", "u").agg(F.sum("n").alias("_n")).where("_n > 0")
        last = lasting(self.open.join(rows.select("key").distinct(), "key", "left_semi"))
        standing = last.select(F.col("key").alias("_k"), F.col("f").alias("_f"), F.col("u").alias("_u"))
        same = (F.col("key") == F.col("_k")) & (F.col("f") == F.col("_f"))
        fresh = rows.join(standing, same & F.col("u").eqNullSafe(F.col("_u")), "left_anti")
        fresh = fresh.join(standing.where("_u IS NULL"), same, "left")
        fresh = fresh.select("key", "f", "u", F.when(F.col("_k").isNotNull() & F.col("u").isNotNull(), _CLOSED).otherwise(_NEW).alias("source"))
        due = lasting(self.open.where(_ended(until))).select("key", "f", "u", F.lit(_DUE).alias("source"))
        return cut(fresh.unionByName(due))

    def step(self, ref: Reference, child: DataFrame, parent: DataFrame, until: datetime | None = None) -> dict[str, DataFrame]:
        """The rows that one more delivery (of child and parent rows; either may be empty) appends to each log.

        Deliveries come in the order of their times; ``until`` is the time they reach by now, and lifetimes that end later wait for their end. Without it all ends
        that are known are events of this delivery. A parent row that comes again with an end closes the lifetime that began with it.
        """
        refs, lives = references(child, ref), self._lives(parent, ref, until)
        first, carried = self.keys is None, None
        if not first:
            touched = refs.select("key").unionByName(lives.select("key")).distinct()
            carried = cut(self.known_keys(touched))
        events = _events(refs, lives, carried, until)
        ordered = _in_order(events, heavy_keys(refs, "key"), salt_count(refs))
        keys = events.groupBy("key").agg(F.sum("delta").alias("live"), F.max("seen").alias("seen"), F.sum("n").alias("n")).withColumn("version", F.lit(self.version + 1))
        never = F.lit(None).cast(lives.schema["u"].dataType)
        stays = lives.where((F.col("source") != _DUE) & _real() & ~_ended(until)).select("key", "f", "u", F.lit(1).alias("n"))
        gone = lives.where(F.col("source") != _NEW).select("key", "f", F.when(F.col("source") == _DUE, F.col("u")).otherwise(never).alias("u"), F.lit(-1).alias("n")).distinct()
        found = _orphaned(ordered, ref)
        resolved = found.where("false")
        if not first:
            came = lives.select("key").distinct().join(carried.where("seen"), "key", "left_anti")
            resolved = self.found.where("kind = 'missing'").join(came, "key", "left_semi").select(*_ORPHAN[:-1], F.lit("late").alias("kind"))
        return {"keys": keys, "open": stays.unionByName(gone), "found": found, "resolved": resolved, "changes": _changed(ordered, ref)}

    def advance(self, ref: Reference, child: DataFrame, parent: DataFrame, until: datetime | None = None) -> OrphanState:
        """The state after one more delivery. From the second one on, what it appends goes to the checkpoint folder."""
        rows = self.step(ref, child, parent, until)
        if self.keys is None:
            return OrphanState(**rows, version=1)
        grown = {name: getattr(self, name).unionByName(cut(rows[name])) for name in LOGS}
        after = OrphanState(**grown, version=self.version + 1)
        if after.version % COMPACT == 0:
            after.keys = cut(after.known_keys().withColumn("version", F.lit(after.version)))
            after.open = cut(after.open.groupBy("key", "f", "u").agg(F.sum("n").cast("int").alias("n")).where("n > 0"))
        return after

    @property
    def orphans(self) -> DataFrame:
        """(ref_field, ref_id, key, at, kind) as far as is known by now."""
        if self.version <= 1:
            return self.found
        waiting = self.found.where("kind = 'missing'").join(self.resolved.select("key").distinct(), "key", "left_anti").select(*_ORPHAN)
        return self.found.where("kind <> 'missing'").unionByName(waiting).unionByName(self.resolved)

    def open_at(self, at: datetime) -> DataFrame:
        """(ref_field, n_open): references so far whose parent is not present after the events of a time (as far as deliveries reach); those whose parent was deleted are open again."""
        return self.changes.where(F.col("at") <= F.lit(at)).groupBy("ref_field").agg(F.sum("delta").alias("n_open")).where("n_open <> 0")

    def snapshots(self) -> DataFrame:
        """(ref_field, period, n_open): references arrived by the end of each month whose parent is not present at that end.

        The months run from the first to the last arrival of a reference; those with nothing open have no row, and no references give no rows.
        """
        month = F.trunc("at", "month")
        monthly = self.changes.groupBy("ref_field", month.alias("month")).agg(F.sum("delta").alias("delta"), F.max(F.when(F.col("n") > 0, month)).alias("arrived"))  # a row per field and month
        field = Window.partitionBy("ref_field").orderBy("month")
        rows = monthly.withColumns({"n_open": F.sum("delta").over(field), "next": F.lead("month").over(field), "last": F.max("arrived").over(Window.partitionBy("ref_field"))})
        until = F.least(F.coalesce(F.add_months("next", -1), F.col("last")), F.col("last"))
        rows = rows.where((F.col("n_open") > 0) & (F.col("month") <= F.col("last"))).withColumn("month", F.explode(F.sequence("month", until, F.expr("interval 1 month"))))
        return rows.select("ref_field", F.date_format("month", "yyyy-MM").alias("period"), "n_open")


def orphans(ref: Reference, child: DataFrame, parent: DataFrame) -> DataFrame:
    """(ref_field, ref_id, key, at, kind) over whole tables, whose events are one delivery."""
    return OrphanState().advance(ref, child, parent).orphans


def per_period(found: DataFrame, period: str = "yyyy-MM") -> DataFrame:
    """(ref_field, period, kind, n_refs): orphans per table field and period of arrival; no time of arrival gives a null period."""
    return found.groupBy("ref_field", F.date_format("at", period).alias("period"), "kind").agg(F.count("*").alias("n_refs"))


def snapshots(ref: Reference, child: DataFrame, parent: DataFrame) -> DataFrame:
    """(ref_field, period, n_open) over whole tables: see OrphanState.snapshots()."""
    return OrphanState().advance(ref, child, parent).snapshots()
