"""Price changes as observations arrive, in whatever order they come.

Each pair keeps its observations within the watermark's delay, and the last one before them. An observation that arrives
between two others changes what was said of its neighbours, so the output is a log of signed events: +1 says that a change
happened, -1 takes back one that was said before. ``net_changes`` adds the log up; the sum equals ``price_changes`` over all
that has arrived, at any time and for any order of arrival within the delay.

Pairs are many and each has few observations, so they are dealt to ``SLOTS`` slots by a hash: a slot is one group and one state,
and its pairs are worked out together over arrays. ``_events`` and ``_pruned`` say the same for one pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfwise.operators.snapshots import PAIR

#: Groups that the pairs are dealt to. A batch reads and writes the state of the slots that it touches. A running query keeps the
#: number that it was started with: another one needs a new checkpoint.
SLOTS = 4096
_SEEN = [*PAIR, "at", "run_id", "seq", "competitor_price"]
_LOG = ["op", "run_id", "seq", *PAIR, "alert_type", "price_before", "competitor_price"]


def _events(seen: list[tuple]) -> dict[tuple, tuple]:
    """What observations (time, run_id, seq, price) in order say: (run_id, seq) to (kind, price before, price)."""
    out = {}
    for (_, _, _, before), (_, run, seq, price) in zip(seen, seen[1:], strict=False):
        if price != before:
            out[run, seq] = ("price_drop_them" if price < before else "price_rise_them", before, price)
    return out


def _pruned(seen: list[tuple], watermark_us: int) -> list[tuple]:
    """Nothing older than the watermark can arrive: of what is older only the last is needed."""
    old = sum(t <= watermark_us for t, *_ in seen)
    return seen[max(0, old - 1) :]


def _packed(seen: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(seen, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_all().to_pandas(integer_object_nulls=True)


def _ordered(seen: pd.DataFrame, old: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Observations by pair and time, each once, with the number of the pair, and which of them were known before."""
    pair = np.zeros(len(seen), np.int64)
    for c in PAIR:
        codes, values = pd.factorize(seen[c], use_na_sentinel=False)
        pair = pd.factorize(pair * max(1, len(values)) + codes)[0]
    by = [seen[c].to_numpy() for c in _SEEN[2:]]
    order = np.lexsort((~old, *reversed(by), pair))
    by = [pair[order], *(c[order] for c in by)]
    again = np.zeros(len(seen), bool)
    again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in by])
    order = order[~again]
    return seen.iloc[order], pair[order], old[order]


def _before(pair: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each observation: does it change the price, and the price before."""
    changed, last = np.zeros(len(pair), bool), np.full(len(pair), np.nan)
    last[1:] = price[:-1]
    changed[1:] = (pair[1:] == pair[:-1]) & (price[1:] != price[:-1])
    return changed, last


def _slot(state: bytes | None, frames, watermark_us: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """What new observations of a slot make known: the log, and what stays with the number of its pair."""
    known = [_unpacked(state)] if state is not None else []
    n = sum(map(len, known))
    for f in frames:
        f = f[f["competitor_price"].notna()]
        known.append(f[_SEEN])
    filled = [f for f in known if len(f)]
    seen = pd.concat(filled, ignore_index=True) if filled else pd.DataFrame(columns=_SEEN)
    seen, pair, old = _ordered(seen, np.arange(len(seen)) < n)
    price = seen["competitor_price"].to_numpy(dtype=float)
    now, last = _before(pair, price)
    said, said_last = np.zeros(len(seen), bool), np.full(len(seen), np.nan)
    said[old], said_last[old] = _before(pair[old], price[old])
    same = now & said & (last == said_last)
    parts = []
    for op, at, before in ((-1, said & ~same, said_last), (1, now & ~same, last)):
        kind = np.where(price[at] < before[at], "price_drop_them", "price_rise_them")
        parts.append(seen[at].assign(op=op, alert_type=kind, price_before=before[at]))
    log = pd.concat(parts, ignore_index=True)[_LOG]
    # Nothing older than the watermark can arrive: of what is older only a pair's last is needed
    past = seen["at"].to_numpy(dtype="int64") <= watermark_us
    needed = np.ones(len(seen), bool)
    needed[:-1] = ~(past[:-1] & past[1:] & (pair[:-1] == pair[1:]))
    return log, seen[needed], pair[needed]


def _step(key: tuple, frames, state: GroupState):
    watermark = state.getCurrentWatermarkMs()
    log, seen, pair = _slot(state.get[0] if state.exists else None, () if state.hasTimedOut else frames, watermark * 1000)
    if len(seen):
        state.update((_packed(seen),))
        several = np.zeros(len(seen), bool)
        several[1:] = pair[1:] == pair[:-1]
        if several.any():  # all of them are past what may still arrive when the last is
            state.setTimeoutTimestamp(max(int(seen["at"].to_numpy()[several].max()) // 1000, watermark) + 1)
    if len(log):
        yield log


def stream_price_changes(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """stream (sku_id, competitor_id, scraped_at, run_id, seq, competitor_price) to the log of events: op, run_id, seq, sku_id,
    competitor_id, alert_type, price_before, competitor_price. Observations without a price, and deliveries that come again,
    say nothing. State: the observations of a pair within ``delay``; a pair that is quiet for so long keeps one."""
    kinds = dict(stream.dtypes)
    timed = stream.select(*PAIR, F.col("scraped_at").cast("timestamp").alias("scraped_at"), F.col("run_id").cast("long").alias("run_id"), F.col("seq").cast("long").alias("seq"), F.col("competitor_price").cast("double").alias("competitor_price"))
    never = -(2**63) // 1000  # comes before all times
    timed = timed.withColumns({"at": F.coalesce(F.unix_micros("scraped_at"), F.lit(never)), "slot": F.pmod(F.xxhash64(*PAIR), F.lit(SLOTS))})
    return timed.withWatermark("scraped_at", delay).groupBy("slot").applyInPandasWithState(
        _step,
        f"op int, run_id long, seq long, sku_id {kinds['sku_id']}, competitor_id {kinds['competitor_id']}, alert_type string, price_before double, competitor_price double",
        "seen binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def net_changes(log: DataFrame) -> DataFrame:
    """What stands after all that was taken back."""
    return log.groupBy(*_LOG[1:]).agg(F.sum("op").alias("op")).where("op > 0").drop("op")
