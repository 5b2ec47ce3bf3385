"""Per-host state over a stream of responses: block detection, classification, baselines, pacing.

One core, `Host`, is fed a host's responses in order with the time in the row, so batch and stream give
the same events. Batch: `replay` (applyInPandas by host, fed in chunks). Stream: `track`
(applyInPandasWithState), whose state is the core as JSON and whose timer clears gates.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import BLOCK_PHRASES

# Windows, thresholds and times (ms).
WINDOW, TRIP, RUN = 15, 10, 5
TITLE_REPEAT, TITLES, SMALL_BODY = 3, 512, 15_000
COOLDOWNS = (60_000, 120_000, 240_000)
SAMPLES, RATE_WINDOW, CLOAK = 20, 100, 0.05
FLOOR_MS, CEIL_MS, UP, STEP_MS = 250, 15_000, 1.6, 100
CLEAN, QUIET_MS = 200, 60_000
BURST, BURST_MS, SATURATED_MS, SATURATED_RATE, REPROBE_MS, EMIT_MS = 10, 60_000, 300_000, 0.2, 300_000, 1000
_PHRASE = re.compile(BLOCK_PHRASES, re.I)
BLOCKED = {"blocked-status:403", "blocked-status:429", "blocked-status:503", "blocked-status:5xx", "blocked-content", "cloaked"}

EVENT_SCHEMA = "host string, seq long, ts_ms long, type string, classification string, action string, delay_ms long, multiplier double, block_rate double, reason string, url string, blocked long, in_window long, cooldown_ms long, attempt long"
EVENT_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]


def _median(values: list[float]) -> float:
    v = sorted(values)
    mid = len(v) // 2
    return v[mid] if len(v) % 2 else (v[mid - 1] + v[mid]) / 2


class Host:
    """The state of one host. All of it is bounded: windows, title table, samples."""

    def __init__(self, delay_ms: int = 1000, cooldowns: tuple[int, ...] = COOLDOWNS):
        self.s = {
            "window": [], "titles": {}, "gated": False, "clear_at": None, "attempts": 0, "bodies": [], "links": [], "classes": [], "clean": 0, "run403": 0, "last_block": None,
            "mult": 1.0, "ceiling": None, "start403": None, "reprobe": None, "emitted": None, "delay": delay_ms, "cooldowns": list(cooldowns), "parked": 0,
        }

    def dump(self) -> str:
        return json.dumps(self.s)

    @classmethod
    def load(cls, text: str) -> Host:
        host = cls()
        host.s = json.loads(text)
        return host

    # -- block detection

    def reason(self, status: int, title: str, body: int | None) -> str | None:
        """Why a response counts as blocked, given the titles seen so far."""
        if status in (403, 429):
            return f"status_{status}"
        if 500 <= status < 600:
            return "status_5xx"
        if title and _PHRASE.search(title):
            return "soft_title_phrase"
        if status == 200 and title and body is not None and body <= SMALL_BODY and len(self.s["titles"].get(title, ())) >= TITLE_REPEAT:
            return "soft_title_repeat"
        return None

    def record(self, url: str, status: int, title: str, body: int | None, now: int) -> dict | None:
        """Takes a response in; the trip it causes, if it does."""
        s = self.s
        if title and status == 200 and body is not None and body <= SMALL_BODY:
            if title not in s["titles"] and len(s["titles"]) >= TITLES:
                del s["titles"][next(iter(s["titles"]))]
            urls = s["titles"].setdefault(title, [])
            if len(urls) < TITLE_REPEAT and url not in urls:
                urls.append(url)
        s["window"] = [*s["window"], [self.reason(status, title, body), url]][-WINDOW:]
        if s["gated"]:
            return None
        hits = [w for w in s["window"] if w[0]]
        run = 0
        while run < len(s["window"]) and s["window"][-1 - run][0]:
            run += 1
        if len(hits) < TRIP and run < RUN:
            return None
        s["gated"], wait = True, None
        if s["attempts"] < len(s["cooldowns"]):
            wait = s["cooldowns"][s["attempts"]]
            s["attempts"] += 1
            s["clear_at"] = now + wait
        reasons: dict[str, int] = {}
        for why, _ in hits:
            reasons[why] = reasons.get(why, 0) + 1
        return {"type": "block-detected", "reason": ",".join(f"{k}={v}" for k, v in sorted(reasons.items())), "url": hits[-1][1], "blocked": len(hits), "in_window": len(s["window"]), "cooldown_ms": wait, "attempt": s["attempts"]}

    def expire(self, now: int) -> dict | None:
        """Clears the gate if its time has come; attempts stay, so the next wait is longer."""
        s = self.s
        if s["clear_at"] is None or now < s["clear_at"]:
            return None
        waiting = s["parked"]
        at, s["clear_at"], s["gated"], s["window"], s["titles"], s["parked"] = s["clear_at"], None, False, [], {}, 0
        return {"type": "block-cooldown-cleared", "ts_ms": at, "blocked": waiting}

    def clear(self) -> None:
        """A user's reset: the ladder starts anew."""
        self.s |= {"gated": False, "window": [], "titles": {}, "attempts": 0, "clear_at": None}

    # -- classification and pacing

    def baseline(self) -> tuple[float, float] | None:
        s = self.s
        return (_median(s["bodies"]), _median(s["links"])) if len(s["bodies"]) >= SAMPLES else None

    def classify(self, status: int, title: str, body: int, links: int) -> str:
        if status in (403, 429, 503):
            return f"blocked-status:{status}"
        why = self.reason(status, title, body)
        if why:
            return "blocked-status:5xx" if why == "status_5xx" else "blocked-content"
        if not 200 <= status < 300:
            return "other"
        base = self.baseline()
        return "cloaked" if base and body < base[0] * CLOAK and links < base[1] * CLOAK else "ok"

    def block_rate(self) -> float:
        c = self.s["classes"]
        return sum(x in BLOCKED for x in c) / len(c) if c else 0.0

    def tick(self, kind: str, url: str, now: int) -> list[dict]:
        """Pacing after a response: multiplies the delay on a block, lowers it after a long clean run."""
        s, out, action = self.s, [], "hold"
        low, high = FLOOR_MS / s["delay"], CEIL_MS / s["delay"]
        if kind in BLOCKED:
            s["mult"], action = min(high, s["mult"] * UP), "step-up"
        elif kind == "ok" and s["clean"] >= CLEAN and (s["last_block"] is None or now - s["last_block"] >= QUIET_MS):
            new = max(low, s["mult"] - STEP_MS / s["delay"])
            if new != s["mult"]:
                s["mult"], s["clean"], action = new, 0, "step-down"
        why = self._reprobe(kind, high, now)
        if why:
            s["reprobe"] = now
            out.append({"type": "re-probe-requested", "reason": why, "url": url})
        if action != "hold" or s["emitted"] is None or now - s["emitted"] >= EMIT_MS:
            s["emitted"] = now
            out.append({"type": "controller-state", "classification": kind, "action": action, "delay_ms": int(s["delay"] * s["mult"] + 0.5), "multiplier": s["mult"], "block_rate": self.block_rate()})
        return out

    def _reprobe(self, kind: str, high: float, now: int) -> str | None:
        s = self.s
        if s["reprobe"] is not None and now - s["reprobe"] < REPROBE_MS:
            return None
        if kind == "blocked-status:403":
            s["start403"] = now if s["start403"] is None else s["start403"]
            if s["run403"] >= BURST and now - s["start403"] <= BURST_MS:
                return "403-burst"
        else:
            s["start403"] = None
        if s["mult"] < high - 1e-9:
            s["ceiling"] = None
            return None
        s["ceiling"] = now if s["ceiling"] is None else s["ceiling"]
        return "ceiling-saturated" if now - s["ceiling"] >= SATURATED_MS and self.block_rate() > SATURATED_RATE else None

    def feed(self, seq: int, now: int, url: str, status: int, title: str, body: int | None, links: int) -> list[dict]:
        """One response: judged by the state before it, then taken into baseline, window, pacing and detector, in that order."""
        out = []
        if (cleared := self.expire(now)) is not None:
            out.append(cleared)
        if self.s["gated"]:
            self.s["parked"] += 1
            out.append({"type": "parked", "reason": "host_blocked_by_detector", "url": url})
            return [{"seq": seq, "ts_ms": now} | e for e in out]
        kind, s = self.classify(status, title, body or 0, links), self.s
        if kind == "ok" and len(s["bodies"]) < SAMPLES:
            s["bodies"].append(body or 0)
            s["links"].append(links)
        s["classes"] = [*s["classes"], kind][-RATE_WINDOW:]
        if kind in BLOCKED:
            s["clean"], s["last_block"] = 0, now
        elif kind == "ok":
            s["clean"] += 1
        s["run403"] = s["run403"] + 1 if kind == "blocked-status:403" else 0
        out += self.tick(kind, url, now)
        trip = self.record(url, status, title, body, now)
        if trip:
            out.append(trip)
        return [{"seq": seq, "ts_ms": now} | e for e in out]

    def command(self, seq: int, now: int, name: str) -> list[dict]:
        """resume-host: clears the gate; stop-host: gates it until resumed."""
        if name == "resume-host":
            n = self.s["parked"]
            self.clear()
            self.s["parked"] = 0
            return [{"seq": seq, "ts_ms": now, "type": "host-resumed", "blocked": n}]
        if name == "stop-host":
            self.s |= {"gated": True, "clear_at": None}
            return [{"seq": seq, "ts_ms": now, "type": "host-stopped"}]
        return []


_INTEGERS = {"seq", "ts_ms", "delay_ms", "blocked", "in_window", "cooldown_ms", "attempt"}


def _frame(events: list[dict]) -> pd.DataFrame:
    """Columns are made one by one, each as a plain array of one type."""
    return pd.DataFrame({c: pd.array([e.get(c) for e in events], "Int64" if c in _INTEGERS else "Float64" if c in ("multiplier", "block_rate") else object) for c in EVENT_COLUMNS})


def _fed(state: Host, pdf: pd.DataFrame) -> list[dict]:
    out = []
    for r in pdf.sort_values("seq").itertuples(index=False):
        command = getattr(r, "command", None)
        if isinstance(command, str) and command:
            out += state.command(int(r.seq), int(r.ts_ms), command)
        else:
            body = None if pd.isna(r.body_bytes) else int(r.body_bytes)
            out += state.feed(int(r.seq), int(r.ts_ms), r.url or "", int(r.status), r.title or "", body, int(r.internal_links))
    return out


def replay(responses: DataFrame, delay_ms: int = 1000) -> DataFrame:
    """Events of each host's responses (host, seq, ts_ms, url, status, title, body_bytes, internal_links).

    Rows are dealt by host and sorted by (host, seq) on disk, then streamed through the state, so a
    host's rows never stand in memory together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for pdf in batches:
            out = []
            for host, rows in pdf.groupby("host", sort=False, dropna=False):
                if host != name:
                    name, state = host, Host(delay_ms)
                out += [{"host": host} | e for e in _fed(state, rows)]
            if out:
                yield _frame(out)

    return responses.repartition("host").sortWithinPartitions("host", "seq").mapInPandas(run, EVENT_SCHEMA)


def track(stream: DataFrame, delay_ms: int = 1000) -> DataFrame:
    """The same over a stream; a gate is cleared by a processing-time timer or by the next response after its time.
    Start it with a processing-time trigger (or once): with timers pending, an available-now run does not end."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        host = Host.load(state.get[0]) if state.exists else Host(delay_ms)
        if state.hasTimedOut:
            cleared = host.expire(host.s["clear_at"] or 0)
            events = [cleared] if cleared else []
        else:
            events = _fed(host, pd.concat(list(frames)))
        state.update((host.dump(),))
        if host.s["gated"] and host.s["clear_at"] is not None:
            state.setTimeoutDuration(max(1, host.s["cooldowns"][max(0, host.s["attempts"] - 1)]))
        if events:
            yield _frame([{"host": key[0]} | e for e in events])

    return stream.groupBy("host").applyInPandasWithState(run, EVENT_SCHEMA, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def pacing_latest(events: DataFrame) -> DataFrame:
    """The newest pacing state of each host."""
    rows = events.where("type = 'controller-state'")
    return rows.groupBy("host").agg(F.max_by(F.struct("delay_ms", "multiplier", "block_rate", "action"), "seq").alias("s")).select("host", "s.*").orderBy("host")


def reprobe_gate(events: DataFrame, every_ms: int = REPROBE_MS) -> DataFrame:
    """Re-probe requests with `fires`: at most one in every_ms fires (all are forwarded). A host's rows are streamed in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, last = object(), None
        for pdf in batches:
            fires = []
            for host, t in zip(pdf["host"], pdf["ts_ms"], strict=True):
                if host != name:
                    name, last = host, None
                fires.append(last is None or t - last >= every_ms)
                last = t if fires[-1] else last
            yield pdf.assign(fires=fires)

    asked = events.where("type = 're-probe-requested'").select("host", "seq", "ts_ms", "reason")
    return asked.repartition("host").sortWithinPartitions("host", "ts_ms", "seq").mapInPandas(run, "host string, seq long, ts_ms long, reason string, fires boolean")


def probe_policy(results: DataFrame, identical: int = 3) -> DataFrame:
    """Of a matrix of probes (run, position, headed, blocked, reason) which rows run and which wins: the first
    unblocked one wins and ends it; after three equal hard blocks in a row rows without a window are skipped.
    A run's rows are streamed in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, same, last, won = object(), 0, None, False
        for pdf in batches:
            verdicts = []
            for r in pdf.itertuples(index=False):
                key = None if pd.isna(r.run) else r.run
                if key != name:
                    name, same, last, won = key, 0, None, False
                if won or same >= identical and not r.headed:
                    verdicts.append("skipped")
                    continue
                won = not r.blocked
                same = same + 1 if r.blocked and r.reason == last else 1 if r.blocked else 0
                last = r.reason if r.blocked else None
                verdicts.append("won" if won else "blocked")
            yield pdf.assign(verdict=verdicts)[["run", "position", "verdict"]]

    rows = results.select("run", "position", "headed", "blocked", "reason")
    return rows.repartition("run").sortWithinPartitions("run", "position").mapInPandas(run, "run long, position long, verdict string")
