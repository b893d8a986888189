"""Interaction behaviours over event tables, as scans, aggregates and joins.

Every one is by a key, in the order of time and event id. Scans cut a key with very many events into blocks of time (``scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import LINKED_LEVEL, LINKED_WINDOW, RECENT, VIEWS
from . import saved, scan


def debounce(events: DataFrame, key: list[str], gap_seconds: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The events after which nothing comes for ``gap_seconds``: what a restartable single-shot timer lets through."""
    rows = scan.scanned(events, key, [ts, tie], {"_later": scan.after(F.col(ts))})
    quiet = F.unix_micros(F.col("_later.v").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) >= int(gap_seconds * 1_000_000)
    return rows.where(F.coalesce(quiet, F.lit(True))).drop("_later")


def committed(events: DataFrame, kind: str = "commit", column: str = "kind") -> DataFrame:
    """Ends of edits, which aren't debounced."""
    return events.where(F.col(column) == kind)


def dedupe_consecutive(events: DataFrame, key: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Events whose values differ from those of the event before (the first is kept). A-B-A stays three events."""
    rows = scan.scanned(events, key, order, {"_before": scan.before(F.struct(*values))})
    return rows.where(F.col("_before").isNull() | ~F.struct(*values).eqNullSafe(F.col("_before.v"))).drop("_before")


def user_only(events: DataFrame) -> DataFrame:
    """Events that a user made, not those that propagation raised."""
    return events.where(F.col("origin") == "user")


def fanout_except_source(events: DataFrame, view: Column, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Each event once for every other view, as ``target``. The views are a fixed list, so this is an explode and no join."""
    return events.withColumn("target", F.explode(F.filter(F.array(*map(F.lit, views)), lambda v: v != view)))


def broadcast_peers(events: DataFrame, frames: DataFrame, key: str = "image_id", frame: str = "frame", mode: str = "link_mode") -> DataFrame:
    """Each event once for every other frame of its image, unless either's link mode is Disabled."""
    left = events.where(F.col(mode) != "Disabled")
    peers = frames.where(F.col(mode) != "Disabled").select(key, F.col(frame).alias("peer"))
    return left.join(peers, key).where(F.col(frame) != F.col("peer"))


def baseline_retained(events: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Each event with its image's first value as ``baseline``."""
    return scan.scanned(events, key, order, {"baseline": scan.first(F.col(value))})


def reset_to_baseline(events: DataFrame, value: str, baseline: str = "baseline", kind: str = "kind") -> DataFrame:
    """Reset events take the baseline's value."""
    return events.withColumn(value, F.when(F.col(kind) == "reset", F.col(baseline)).otherwise(F.col(value)))


def combine_latest(events: DataFrame, key: list[str], kinds: dict[str, str], value: str, order: list[str], kind: str = "kind") -> DataFrame:
    """Each event with the latest value of every kind so far, in the columns ``kinds`` names."""
    return scan.scanned(events, key, order, {name: scan.last(F.when(F.col(kind) == k, F.col(value))) for k, name in kinds.items()})


def exclusive_selection(events: DataFrame, key: list[str], view: str, order: list[str]) -> DataFrame:
    """The view that was selected last, by key: an aggregate, with no sort of the events."""
    return events.groupBy(*key).agg(F.max_by(view, F.struct(*order)).alias("selected"))


def gated(events: DataFrame, enabled: Column) -> DataFrame:
    """Events while a gate is open; null is closed."""
    return events.where(F.coalesce(enabled, F.lit(False)))


def last_of_batch(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One event of each bulk update: the last."""
    row = F.max_by(F.struct("*"), F.struct(*order)).alias("row")
    return events.groupBy(*key).agg(row).select("row.*")


def toggled(events: DataFrame, key: list[str], press: Column, order: list[str]) -> DataFrame:
    """A switch that every press turns over, off at first."""
    return scan.scanned(events, key, order, {"on": scan.total(press.cast("int"))}).withColumn("on", F.col("on") % 2 == 1)


def key_command(key: Column, modified: Column) -> Column:
    """What a key does: 'shading' for s, 'reset' for r unless Shift or Ctrl is held (then the camera is reset, which isn't a command here), else null."""
    low = F.lower(key)
    return F.when(low == "s", "shading").when((low == "r") & ~modified, "reset")


def echoed(events: DataFrame, view: str = "view") -> DataFrame:
    """Changes that the volume view made, as the controller shows them: propagated ones, which propagate no further."""
    return events.where(F.col(view) == "VOLUME").withColumns({"target": F.lit("CONTROLLER"), "origin": F.lit("propagated")})


def to_all_views(images: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Each image once for every view, as ``view``: an explode over the fixed list."""
    return images.withColumn("view", F.explode(F.array(*map(F.lit, views))))


def linked(events: DataFrame, key: list[str], order: list[str], view: str = "view", kind: str = "kind", window: str = "window", level: str = "level") -> DataFrame:
    """Each event once for every slice view (``target``), with that view's window and level after it (``shown_window``, ``shown_level``; null before any).

    An edit is its own view's. From a 'link' to the next 'unlink' the views share one setting, which begins at ``LINKED_WINDOW`` and ``LINKED_LEVEL`` and
    follows the edits of any of them; at 'unlink' each goes on from it. Linking what is linked changes nothing. Edits of other views are of no account.
    """
    slices = [v for v in VIEWS if v != "VOLUME"]
    blocks = scan.blocks_of(events, key, order)
    state = scan.last(F.when(F.col(kind).isin("link", "unlink"), F.col(kind) == "link"), inclusive=False)
    e = scan.scanned(events, key, order, {"_linked": state}, blocks).withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    e = e.withColumn("target", F.explode(F.array(*map(F.lit, slices))))
    own = F.col(view).isin(*slices) & (F.col("_linked") | (F.col(view) == F.col("target")))
    setting = F.when((F.col(kind) == "link") & ~F.col("_linked"), F.struct(F.lit(LINKED_WINDOW).alias("w"), F.lit(LINKED_LEVEL).alias("l")))
    setting = setting.when((F.col(kind) == "edit") & own, F.struct(F.col(window).cast("double").alias("w"), F.col(level).cast("double").alias("l")))
    shown = scan.scanned(e, [*key, "target"], order, {"_shown": scan.last(setting)}, blocks)
    return shown.withColumns({"shown_window": F.col("_shown.w"), "shown_level": F.col("_shown.l")}).drop("_linked", "_shown")


def positions(events: DataFrame, key: list[str], order: list[str], lo: str, hi: str, bounds: tuple[int, int], tracking: Column, start: tuple[int, int]) -> DataFrame:
    """The events that move a range's positions (``position_lo``, ``position_hi``: in order and inside the bounds), and the range's values after each (``value_lo``, ``value_hi``).

    An event that leaves both positions as they were is none. Values follow positions while ``tracking``, and stay otherwise.
    """
    blocks = scan.blocks_of(events, key, order)
    a, b = (F.least(F.greatest(F.col(c), F.lit(bounds[0])), F.lit(bounds[1])) for c in (lo, hi))
    now, first = F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")), F.struct(F.lit(start[0]).alias("lo"), F.lit(start[1]).alias("hi"))
    e = scan.scanned(events.withColumn("_now", now), key, order, {"_before": scan.before(F.col("_now"))}, blocks)
    e = e.withColumn("_moved", ~F.coalesce("_before.v", first).eqNullSafe(F.col("_now")))
    values = scan.scanned(e, key, order, {"_values": scan.last(F.when(F.col("_moved") & tracking, F.col("_now")))}, blocks)
    out = values.withColumn("_values", F.coalesce("_values", first)).where("_moved")
    return out.withColumns({f"{n}_{end}": F.col(f"_{c}.{end}") for n, c in (("position", "now"), ("value", "values")) for end in ("lo", "hi")}).drop("_now", "_before", "_moved", "_values")


def mru_topk(opened: DataFrame, key: list[str], item: str, order: list[str], k: int = RECENT) -> DataFrame:
    """The k most recently used items, each once, with their rank. Items are aggregated before they are ranked."""
    last = opened.groupBy(*key, item).agg(F.max(F.struct(*order)).alias("_last"))
    by = Window.partitionBy(*key).orderBy(F.desc("_last")) if key else Window.orderBy(F.desc("_last"))
    if not key:
        last = last.orderBy(F.desc("_last")).limit(k)
    return last.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(*key, item, "rank")


def save_recent(spark, items: DataFrame, path: str) -> None:
    """Keep a recent list (a few rows), which may come from the one kept there (see ``saved``)."""
    saved.save(items, path)


def restore_recent(spark, path: str) -> DataFrame:
    return saved.restore(spark, path)


def clear_recent(spark, path: str) -> None:
    """Keep an empty list, with the columns it has."""
    saved.cleared(spark, path)
