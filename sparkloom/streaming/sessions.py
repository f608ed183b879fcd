"""What the events of a session do, as state in a stream and as a replay over a table.

Both take a feed (``prepared``, optionally ``with_hits``) and give the same actions
(project, session_id, event_id, action, key, value):

====================  =======================================================
``is-off``            a session started while its project was switched off
``off``, ``on``       a prompt switched the project
``start``             a session started; the session pack is due
``user``, ``assistant``  a turn to keep: key is the prompt's id, value the text
``guard``             a prompt repeats the guarded record ``key``
``file``              first edit of a file since the session's last end
``handoff``           key 'compact' or 'auto', value the text
``span``              the turns that a compaction summed up: key first-last, value their number
``end``               the session ended, key the reason
====================  =======================================================

``stream`` keeps a value for each project (switched off or not) and a map entry for
each session and each kept turn (``transformWithState``, RocksDB).  ``replay`` is built from
windows over sessions; only the few switching prompts of a project are ordered as a
whole, so a project with most of the events is no single task.

Defined results: events are taken in the order of (ts, event_id), in a stream within
each micro-batch; null or blank prompts, replies and summaries, prompts of the surrounding
program and edits without a path do nothing; a repeated turn (session, role,
prompt id, text) is kept once; a null session_id is a session of its own in each project.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..storage import store
from .handlers import FILES_LISTED, FILES_KEPT, RECORDS_LISTED, from_harness, toggle

EVENT = "project string, session_id string, event_id long, ts timestamp, event string, text string, prompt_id string, path string, reason string, kind string"
ACTION = "project string, session_id string, event_id long, action string, key string, value string"
EVENTS = ["session-start", "prompt", "stop", "edit", "post-compact", "session-end", "record"]
GUARDED, MIN_SHARED, MIN_RATIO, LAST_REQUEST = 3, 2, 0.5, 200
_SESSION = ["project", "session_id"]
_AT = ["ts", "event_id"]


# ----------------------------------------------------------------------- feed
def facts(text: Column, name: str, prefixes: list[str] = (), clean: Callable[[Column], Column] = T.redact, verdict: Column | None = None) -> dict[str, Column]:
    """What ``known`` takes of a text: cleaned, its hash, what it switches, and whether the surrounding program wrote it."""
    text = F.coalesce(text, F.lit(""))
    cleaned = F.regexp_replace(clean(text), r"^\s+|\s+$", "")
    found = toggle(text, name) if verdict is None else verdict
    return {"text": cleaned, "hash": F.sha1(cleaned), "verdict": found, "outside": from_harness(text, list(prefixes)) if prefixes else F.lit(False)}


def known(events: DataFrame, capture_replies: bool = True) -> DataFrame:
    """The events that do something, of events whose ``facts`` are there; where many events share a text, these are found once a text, before the join."""
    said = F.col("event") == "prompt"
    rows = events.where(F.col("event").isin(EVENTS)).where(~said | ~F.coalesce("outside", F.lit(False)))
    if not capture_replies:
        rows = rows.where("event <> 'stop'")
    rows = rows.select(*[c.split()[0] for c in EVENT.split(", ") if not c.startswith("text")], F.coalesce("text", F.lit("")).alias("text"), F.when(said, F.col("verdict")).alias("verdict"), "hash")
    rows = rows.where(~F.col("event").isin("prompt", "stop", "post-compact") | (F.col("text") != "")).where((F.col("event") != "edit") | (F.trim(F.coalesce("path", F.lit(""))) != ""))
    return rows.select("*", F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("size"))


def prepared(events: DataFrame, name: str, prefixes: list[str] = (), clean: Callable[[Column], Column] = T.redact, capture_replies: bool = True, verdict: Column | None = None) -> DataFrame:
    """The events that do something, with cleaned texts and what they switch; no state is needed, so it runs on a stream."""
    return known(events.withColumns(facts(F.col("text"), name, prefixes, clean, verdict)), capture_replies)


def with_hits(feed: DataFrame, guarded: DataFrame) -> DataFrame:
    """The feed and, before each prompt, a row ``hit`` for each term that it shares with a guarded record (id, text); a stream-static join on terms."""
    own = guarded.select(F.col("id").alias("item"), T.terms(F.col("text")).alias("_t")).select("item", F.size("_t").cast("long").alias("size"), F.explode("_t").alias("_term"))
    said = feed.where("event = 'prompt'").drop("item", "size").withColumn("_term", F.explode(T.terms(F.col("text"))))
    hits = said.join(own, "_term").drop("_term").withColumn("event", F.lit("hit")).withColumn("text", F.lit(None).cast("string"))
    return feed.unionByName(hits)


# --------------------------------------------------------------------- stream
def handoff_text(reason: str | None, prompts: int, last: str, files: list[str], labels: list[str]) -> str:
    """T8 as text of a stream; ``last`` is cut already."""
    files = files[-FILES_KEPT:]
    # fixed output: the sentences of an automatic handoff
    out = f'Auto-handoff (session ended: {reason or "unknown"}; no handoff was written). {prompts} prompt(s). Last request: "{last}".'
    if files:
        out += " Files edited: " + ", ".join(files[:FILES_LISTED]) + (f" (+{len(files) - FILES_LISTED} more)." if len(files) > FILES_LISTED else ".")
    if labels:
        out += " Recorded: " + ", ".join(labels[:RECORDS_LISTED]) + "."
    return out


_VALUE = "prompt_id string, prompts long, last string, handoff boolean, first long, latest long, turns long, files array<string>, guarded array<long>, labels array<string>"
_NEW = {"prompt_id": None, "prompts": 0, "last": "", "handoff": False, "first": None, "latest": None, "turns": 0, "files": [], "guarded": [], "labels": []}


class Sessions(StatefulProcessor):
    """The state of a project: whether it is off, its sessions, and the turns that it holds."""

    def __init__(self, ttl: timedelta | None = None) -> None:
        self.ttl = int(ttl.total_seconds() * 1000) if ttl else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.switch = handle.getValueState("switch", "off boolean")
        self.sessions = handle.getMapState("sessions", "session_id string", _VALUE, self.ttl)
        self.kept = handle.getMapState("turns", "session_id string, role string, prompt_id string, hash string", "event_id long", self.ttl)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        off = bool(self.switch.get()[0]) if self.switch.exists() else False
        was, states, shared = off, {}, {}
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id, r.event != "hit")):
            if r.event == "hit":
                own = shared.setdefault(r.event_id, {})
                own[r.item] = (own.get(r.item, (0, 0))[0] + 1, r.size)
                continue
            sid = r.session_id or ""
            if sid not in states:
                states[sid] = dict(zip(_NEW, self.sessions.getValue((sid,)), strict=True)) if self.sessions.containsKey((sid,)) else dict(_NEW)
                for c in ("files", "guarded", "labels"):
                    states[sid][c] = list(states[sid][c] or [])
            if r.event == "prompt" and (r.verdict == "off" or r.verdict == "on" and off):
                off = r.verdict == "off"
                found = [(r.verdict, None, None)]
            else:
                found = self.act(r, sid, states[sid], off, shared.get(r.event_id, {}))
            for action, k, value in found:
                yield Row(project=key[0], session_id=r.session_id, event_id=r.event_id, action=action, key=k, value=value)
        if off != was:
            self.switch.update((off,))
        for sid, s in states.items():
            self.sessions.updateValue((sid,), tuple(s.values()))

    def keep(self, sid: str, role: str, prompt_id: str | None, r: Row, s: dict) -> list[tuple]:
        """A turn, if it is not there yet."""
        at = (sid, role, prompt_id or "", r.hash)
        if self.kept.containsKey(at):
            return []
        self.kept.updateValue(at, (r.event_id,))
        s.update(turns=s["turns"] + 1, first=s["first"] if s["turns"] else r.event_id, latest=r.event_id)
        return [(role, prompt_id, r.text)]

    def act(self, r: Row, sid: str, s: dict, off: bool, shared: dict) -> list[tuple]:
        """What an event that switches nothing does to the session's state and gives out."""
        if r.event == "record":
            if r.kind == "handoff":
                s["handoff"] = True
            elif len(s["labels"]) < RECORDS_LISTED:
                s["labels"].append(r.text)
            return []
        if off:
            return [("is-off", None, None)] if r.event == "session-start" else []
        if r.event == "session-start":
            return [("start", None, None)]
        if r.event == "prompt":
            out = self.keep(sid, "user", r.prompt_id, r, s)
            if out:
                s.update(prompts=s["prompts"] + 1, last=r.last)
            s["prompt_id"] = r.prompt_id or s["prompt_id"]
            hits = [(-n, -item) for item, (n, size) in shared.items() if n >= MIN_SHARED and n >= MIN_RATIO * max(1, size) and item not in s["guarded"]]
            for _, item in sorted(hits)[:GUARDED]:
                s["guarded"].append(-item)
                out.append(("guard", str(-item), None))
            return out
        if r.event == "stop":
            return self.keep(sid, "assistant", r.prompt_id or s["prompt_id"], r, s)
        if r.event == "edit":
            if r.path in s["files"]:
                return []
            s["files"].append(r.path)
            return [("file", None, r.path)]
        if r.event == "post-compact":
            s["handoff"] = True
            out = [("handoff", "compact", r.text)]
            if s["turns"]:
                out.append(("span", f"{s['first']}-{s['latest']}", str(s["turns"])))
                s["turns"] = 0
            return out
        out = [("end", r.reason, None)]
        if s["prompts"] and not s["handoff"]:
            out.append(("handoff", "auto", handoff_text(r.reason, s["prompts"], s["last"], s["files"], s["labels"])))
            s["handoff"] = True
        s.update(files=[], guarded=[])
        return out


def stream(feed: DataFrame, ttl: timedelta | None = None) -> DataFrame:
    """The actions of a streaming feed, in append mode.

    With ``ttl``, sessions and turns that nothing touches for so long go; this takes processing
    time, for queries that run on (one that stops when all is read never ends with it).
    """
    spark = feed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = feed.withColumn("last", T.truncate(F.col("text"), LAST_REQUEST))
    return rows.groupBy("project").transformWithState(Sessions(ttl), ACTION, "append", "processingTime" if ttl else "none")


# --------------------------------------------------------------------- replay
def switched(base: DataFrame) -> DataFrame:
    """The events with ``off``: whether their project was switched off before them.

    A project's events are ordered by minutes; what a minute finds comes from the last switching
    prompt before it, over one row a minute.  So no task sorts or scans a whole project, and no event
    meets more than one row, however often a project is switched.
    """
    at = F.struct(*_AT)
    rows = base.withColumns({"_minute": F.date_trunc("minute", "ts"), "_said": F.when(F.col("ts").isNotNull(), F.col("verdict"))})
    last = rows.where(F.col("ts").isNotNull()).groupBy("project", "_minute").agg(F.max_by("_said", F.when(F.col("_said").isNotNull(), at)).alias("_last"))
    before = Window.partitionBy("project").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    found = last.select("project", "_minute", F.last("_last", True).over(before).alias("_said")).where(F.col("_said").isNotNull())
    both = rows.withColumn("_event", F.lit(1)).unionByName(found.withColumn("_event", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("project", "_minute").orderBy("_event", *_AT).rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.last("_said", True).over(so_far) == "off", F.lit(False))
    return both.withColumn("off", off).where("_event = 1").select(*base.columns, "off")


def _guards(hits: DataFrame, prompts: DataFrame) -> DataFrame:
    """The guarded records that each prompt names, once a session until its end, three a prompt; only hits reach Python."""
    counted = hits.groupBy("project", "session_id", "event_id", "ts", "item").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    counted = counted.where((F.col("n") >= MIN_SHARED) & (F.col("n") >= MIN_RATIO * F.greatest(F.col("size"), F.lit(1))))
    own = counted.join(prompts.select(F.col("event_id"), F.col("project").alias("_p"), "epoch"), "event_id").where(F.col("project").eqNullSafe(F.col("_p"))).drop("_p")

    def choose(rows):
        import pandas as pd

        seen, out = set(), []
        for (_, event_id), own in rows.sort_values(["ts", "event_id"]).groupby(["ts", "event_id"], sort=True):
            new = [i for i in own.sort_values(["n", "item"], ascending=False)["item"] if i not in seen][:GUARDED]
            seen.update(new)
            out += [(event_id, str(i)) for i in new]
        first = rows.iloc[0]
        return pd.DataFrame({"project": first["project"], "session_id": first["session_id"], "event_id": [e for e, _ in out], "action": "guard", "key": [k for _, k in out], "value": None}, columns=["project", "session_id", "event_id", "action", "key", "value"])

    return own.groupBy("project", "session_id", "epoch").applyInPandas(choose, ACTION)


def replay(feed: DataFrame) -> DataFrame:
    """The actions of a feed that is a table."""
    base = switched(feed.where("event <> 'hit'"))
    event, live = F.col("event"), ~F.col("off")
    flips = (F.col("verdict") == "off") | ((F.col("verdict") == "on") & F.col("off"))
    base = base.withColumn("flips", F.coalesce(flips, F.lit(False)))
    w = Window.partitionBy(*_SESSION).orderBy(*_AT)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = live & ~F.col("flips")
    base = base.withColumns({
        "said": (event == "prompt") & plain,
        "epoch": F.coalesce(F.count_if((event == "session-end") & live).over(before), F.lit(0)),
    })
    base = base.withColumn("pid", F.when(event == "stop", F.coalesce("prompt_id", F.last(F.when(F.col("said"), F.col("prompt_id")), True).over(so_far))).otherwise(F.col("prompt_id")))
    turn = F.col("said") | ((event == "stop") & live)
    nth = F.row_number().over(Window.partitionBy(*_SESSION, "event", F.coalesce("pid", F.lit("")), "hash", turn).orderBy(*_AT))
    base = base.withColumn("turn", turn & (nth == 1))
    compact, end = (event == "post-compact") & live, (event == "session-end") & live
    user = F.col("turn") & (event == "prompt")
    base = base.withColumns({
        "span": F.coalesce(F.count_if(compact).over(before), F.lit(0)),
        "users": F.coalesce(F.count_if(user).over(before), F.lit(0)),
        "handoffs": F.coalesce(F.count_if(compact | ((event == "record") & (F.col("kind") == "handoff"))).over(before), F.lit(0)),
        "request": F.last(F.when(user, F.col("text")), True).over(before),
    })
    base = store(base, "sessions")  # every action below reads it

    def of(rows: DataFrame, action: Column | str, key: Column | str | None = None, value: Column | str | None = None) -> DataFrame:
        name = F.lit(action) if isinstance(action, str) else action
        each = [F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c for c in (key, value)]
        return rows.select(*_SESSION, "event_id", name.alias("action"), each[0].cast("string").alias("key"), each[1].cast("string").alias("value"))

    started = of(base.where("event = 'session-start'"), F.when(F.col("off"), "is-off").otherwise("start"))
    flipped = of(base.where("flips"), F.col("verdict"))
    turns = of(base.where("turn"), F.when(event == "prompt", "user").otherwise("assistant"), "pid", "text")
    first = Window.partitionBy(*_SESSION, "epoch", "path").orderBy(*_AT)
    files = base.where(live & (event == "edit")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    compacts = base.where(compact)
    same = F.col("a.project").eqNullSafe(F.col("b.project")) & F.col("a.session_id").eqNullSafe(F.col("b.session_id"))
    held = base.where("turn").groupBy(*_SESSION, "span").agg(F.min_by("event_id", F.struct(*_AT)).alias("lo"), F.max_by("event_id", F.struct(*_AT)).alias("hi"), F.count("*").alias("n"))
    # the k-th compaction sums up the turns since the one before; its own ``span`` counts those before it
    spans = of(compacts.alias("a").join(held.alias("b"), same & (F.col("a.span") == F.col("b.span"))).select("a.project", "a.session_id", "a.event_id", "lo", "hi", "n"), "span", F.concat("lo", F.lit("-"), "hi"), "n")
    ends = base.where(end)
    due = ends.where("users > 0 and handoffs = 0").groupBy(*_SESSION).agg(F.min_by(F.struct(*_AT, "reason", "users", "request", "epoch"), F.struct(*_AT)).alias("d")).select(*_SESSION, "d.*")
    autos = of(_auto(due, files, base.where("event = 'record' and coalesce(kind, '') <> 'handoff'")), "handoff", F.lit("auto"), "text")
    out = [started, flipped, turns, of(files, "file", None, "path"), of(compacts, "handoff", F.lit("compact"), "text"), spans, of(ends, "end", "reason"), autos, _guards(feed.where("event = 'hit'"), base.where("said"))]
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every


def _auto(due: DataFrame, files: DataFrame, records: DataFrame) -> DataFrame:
    """Due (project, session_id, ts, event_id, reason, users, request, epoch) with the handoff's text."""
    same = F.col("d.project").eqNullSafe(F.col("x.project")) & F.col("d.session_id").eqNullSafe(F.col("x.session_id")) & (F.struct("x.ts", "x.event_id") < F.struct("d.ts", "d.event_id"))

    def listed(rows: DataFrame, on: Column, value: str, kept: int | None, most: int, name: str) -> DataFrame:
        """The first ``most`` of the last ``kept`` values before the end, and how many of these there are."""
        found = due.alias("d").join(rows.alias("x"), on).select(F.col("d.project").alias("project"), F.col("d.session_id").alias("session_id"), F.struct("x.ts", "x.event_id", f"x.{value}").alias("_v"))
        own = Window.partitionBy(*_SESSION)
        if kept:
            found = found.withColumn("_k", F.row_number().over(own.orderBy(F.desc("_v")))).where(F.col("_k") <= kept)
        ranked = found.withColumn("_k", F.row_number().over(own.orderBy("_v")))
        names = F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col("_v")))), lambda v: v[value])
        return ranked.groupBy(*_SESSION).agg(F.count("*").alias(f"n_{name}"), F.array_join(names, ", ").alias(name))

    touched = listed(files, same & (F.col("d.epoch") == F.col("x.epoch")), "path", FILES_KEPT, FILES_LISTED, "files")
    noted = listed(records, same, "text", None, RECORDS_LISTED, "labels")
    out = due
    for more in (touched, noted):
        m = more.select(F.col("project").alias("_p"), F.col("session_id").alias("_s"), *[c for c in more.columns if c not in _SESSION])
        out = out.join(m, F.col("project").eqNullSafe(F.col("_p")) & F.col("session_id").eqNullSafe(F.col("_s")), "left").drop("_p", "_s")
    more = F.when(F.col("n_files") > FILES_LISTED, F.concat(F.lit(" (+"), F.col("n_files") - FILES_LISTED, F.lit(" more)."))).otherwise(".")
    text = F.concat_ws(  # fixed output, as handoff_text
        " ",
        F.concat(F.lit("Auto-handoff (session ended: "), F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")), F.lit("; no handoff was written). "), F.col("users"), F.lit(' prompt(s). Last request: "'), T.truncate(F.col("request"), LAST_REQUEST), F.lit('".')),
        F.concat(F.lit("Files edited: "), F.col("files"), more),
        F.concat(F.lit("Recorded: "), F.col("labels"), F.lit(".")),
    )
    return out.select(*_SESSION, "event_id", text.alias("text"))
