"""All queries of the library by name, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import budget, folding, graph, history, legacy, lifecycle, names, pack, reports, resolve, retrieval, routing
from ..sources import tables as S
from ..streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

ITEMS = """items AS (SELECT *, CASE WHEN status = 'superseded' THEN doc_id + 6 END AS superseded_by FROM (
  SELECT doc_id, text, source, kind, own[(doc_id // 6) % 4 % len(own) + 1] AS status, doc_id % 12 = 0 AS priority, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at FROM (
    SELECT *, ['pin','decision','task','error','note','handoff'][doc_id % 6 + 1] AS kind,
      [['active','retired','superseded'],['accepted','rejected','superseded','retracted'],['open','done','dropped','superseded'],['open','fixed','dropped','superseded'],['active','retired','superseded'],['active','superseded']][doc_id % 6 + 1] AS own FROM documents)))"""
LIVE = "((kind IN ('pin','note','handoff') AND status = 'active') OR (kind = 'decision' AND status IN ('accepted','rejected')) OR (kind IN ('task','error') AND status = 'open'))"
TURNS = """turns AS (SELECT conv_id * 1000 + turn AS id, 's' || conv_id AS session_id, conv_id, turn, role, text, sha1(text) AS hash,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt_id, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS created_at FROM conversations)"""
FILES = """files AS (SELECT l_orderkey AS sha, l_partkey AS path, CAST(sum(l_quantity) AS BIGINT) AS added, CAST(sum(l_linenumber) AS BIGINT) AS deleted FROM lineitem GROUP BY ALL)"""
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
STOP = "['" + "','".join(T.STOP_WORDS) + "']"
TERMS = (
    "list_distinct(flatten(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN CASE WHEN length(w) >= 2 THEN [w] ELSE [] END "
    f"WHEN length(w) >= 3 AND NOT list_contains({STOP}, lower(w)) THEN list_concat([lower(w)], list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda s: lower(s)), lambda s: length(s) >= 3 AND NOT list_contains({STOP}, s))) ELSE [] END)))"
)
EDGES = """edges AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst, 'depends' AS kind FROM lineitem)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return S.items(S.table(spark, sf, "documents"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return S.turns(S.table(spark, sf, "conversations"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


FIRST_LINE = r"trim(regexp_replace(string_split(trim(text, chr(32)), chr(10))[1], '[ \t\r\f\v]+', ' ', 'g')) AS line"
TITLE = r"CASE WHEN length(line) <= 80 THEN line ELSE regexp_replace(CASE WHEN instr(substr(line, 1, 79), ' ') > 0 AND 79 - instr(reverse(substr(line, 1, 79)), ' ') >= 48 THEN substr(line, 1, 79 - instr(reverse(substr(line, 1, 79)), ' ')) ELSE substr(line, 1, 79) END, '[ ,;:\-]+$', '') || '…' END AS title"


def _title(text):
    return T.truncate(F.element_at(F.split(F.trim(text), "\n"), 1), 80)


ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def _bm25_sql(docs: str, id_col: str) -> str:
    return f"""w AS (SELECT {id_col} AS id, {WORDS.format("text")} AS w FROM {docs}), st AS (SELECT count(*) n, avg(len(w)) a FROM w),
  q AS (SELECT query_id, unnest(list_distinct({WORDS.format("query")})) AS term FROM asked),
  post AS (SELECT id, term, count(*) tf, any_value(dl) dl FROM (SELECT id, len(w) dl, unnest(w) term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
  d AS (SELECT term, count(*) df FROM post GROUP BY term),
  hits AS (SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, count(*) AS matched
    FROM post JOIN d USING (term) JOIN q USING (term), st GROUP BY query_id, id)"""


@query(f"WITH {ASKED}, {_bm25_sql('documents', 'doc_id')} SELECT query_id, id AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= 10")
def bm25_search(spark, sf):
    """Flagship: the ten best documents of each query."""
    hits = retrieval.bm25(S.table(spark, sf, "documents"), _asked(spark, sf), "doc_id", "text")
    return retrieval.top(hits, 10, F.desc("score"), F.col("id")).select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {ASKED}, {_bm25_sql('documents', 'doc_id')}, z AS (SELECT query_id, count(*) n FROM q GROUP BY 1)
SELECT query_id, id, score, pass, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pass, score DESC, id) rank FROM (SELECT query_id, id, score, CASE WHEN matched = n THEN 0::BIGINT ELSE 1::BIGINT END pass FROM hits JOIN z USING (query_id))) WHERE rank <= 12""")
def and_or_ranked(spark, sf):
    asked = _asked(spark, sf)
    return retrieval.and_then_or(retrieval.bm25(S.table(spark, sf, "documents"), asked, "doc_id", "text"), asked, 12)


@query(f"""WITH {TURNS}, {ASKED} SELECT query_id, id, count(*) AS shared FROM (SELECT id, unnest({TERMS.format('text')}) term FROM turns) JOIN (SELECT query_id, unnest({TERMS.format('query')}) term FROM asked) USING (term) GROUP BY ALL""")
def fallback_overlap(spark, sf):
    return retrieval.overlap(_turns(spark, sf), _asked(spark, sf), "id", "text")


@query(f"""WITH {ASKED}, a AS (WITH {_bm25_sql('documents', 'doc_id')} SELECT query_id, 'item' source, id, 0 o, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r, 1.0 wt FROM hits),
b AS (WITH {TURNS}, {_bm25_sql('turns', 'id')} SELECT query_id, 'turn' source, id, 1 o, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r, 0.6 wt FROM hits),
u AS (SELECT query_id, source, id, o, round(CAST(wt AS DOUBLE) / (20 + r), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE r <= 24)
SELECT query_id, source, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, id) rank FROM u) WHERE rank <= 12""")
def rrf_fusion(spark, sf):
    asked = _asked(spark, sf)

    def ranked(df, key):
        return retrieval.top(retrieval.bm25(df, asked, key, "text"), 24, F.desc("score"), F.col("id"))

    return retrieval.fuse({"item": ranked(S.table(spark, sf, "documents"), "doc_id"), "turn": ranked(_turns(spark, sf), "id")}, 12)


@query(f"""WITH {ASKED}, t AS (SELECT doc_id AS id, {TERMS.format('text')} t FROM documents), q AS (SELECT query_id, {TERMS.format('query')} q FROM asked)
SELECT query_id, id, count(*) AS shared, any_value(n_q)::BIGINT AS base FROM (SELECT id, unnest(t) term FROM t) JOIN (SELECT query_id, len(q) n_q, unnest(q) term FROM q WHERE len(q) >= 2) USING (term) GROUP BY query_id, id HAVING count(*) >= 2 AND count(*) >= 0.34 * any_value(n_q)""")
def similar_items(spark, sf):
    return retrieval.similar(S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), _asked(spark, sf))


@query(f"""WITH {ITEMS}, {TURNS}, g AS (SELECT doc_id AS id, {TERMS.format("title")} t FROM (SELECT *, {TITLE} FROM (SELECT *, {FIRST_LINE} FROM items)) WHERE (kind = 'decision' AND status = 'rejected') OR (kind = 'pin' AND status = 'active' AND priority)),
q AS (SELECT id AS query_id, session_id, created_at AS ts, {TERMS.format('text')} q FROM turns WHERE role = 'user'),
h AS (SELECT query_id, session_id, ts, id, count(*) shared FROM (SELECT id, len(t) n, unnest(t) term FROM g) JOIN (SELECT query_id, session_id, ts, unnest(q) term FROM q WHERE len(q) >= 2) USING (term) GROUP BY ALL HAVING true),
k AS (SELECT h.*, len(t) n FROM h JOIN g USING (id) WHERE shared >= 2 AND shared >= 0.5 * greatest(1, len(t))),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY ts, query_id) r FROM k) WHERE r = 1)
SELECT query_id, session_id, id, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) rank FROM f) WHERE rank <= 3""")
def rejection_guard(spark, sf):
    items = _items(spark, sf).select(F.col("doc_id").alias("id"), "kind", "status", "priority", _title(F.col("text")).alias("text"))
    prompts = _turns(spark, sf).where("role = 'user'").select(F.col("id").alias("query_id"), "session_id", F.col("created_at").alias("ts"), F.col("text").alias("query"))
    return retrieval.guard(items, prompts)


@query(f"SELECT doc_id, list_sort({TERMS.format('text')}) AS terms_list, len({TERMS.format('text')}) AS n FROM documents".replace(f"list_sort({TERMS.format('text')}) AS terms_list", f"array_to_string(list_sort({TERMS.format('text')}), ' ') AS terms"))
def term_extract(spark, sf):
    return S.table(spark, sf, "documents").withColumn("t", T.terms(F.col("text"))).select("doc_id", F.array_join(F.array_sort("t"), " ").alias("terms"), F.size("t").cast("long").alias("n"))


@query(r"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(p_brand || p_type, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Za-z0-9]+'), lambda s: lower(s)), ' ') AS words FROM part")
def identifier_split(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", F.array_join(T.split_identifier(F.concat("p_brand", "p_type")), " ").alias("words"))


@query(r"SELECT doc_id, sha1(text) AS hash, CAST(floor(length(text) / 3.5) + 1 AS BIGINT) AS tokens, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def hash_text(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("hash"), T.est_tokens(F.col("text")).alias("tokens"), F.octet_length("text").cast("long").alias("bytes"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, 'token = "[0-9a-f]{40}"', '[redacted]', 'g'), '[A-Za-z0-9.]+@[A-Za-z0-9.]+', '[redacted]', 'g') AS text FROM documents""")
def redact_secrets(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.redact(F.col("text"), ['token = "[0-9a-f]{40}"', "[A-Za-z0-9.]+@[A-Za-z0-9.]+"]).alias("text"))


@query(f"SELECT doc_id, {TITLE} FROM (SELECT doc_id, {FIRST_LINE} FROM documents)")
def title_truncate(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", _title(F.col("text")).alias("title"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path, regexp_matches(lower(url), '(^|/)(tests?|__tests__|spec|specs|e2e|testing)(/|$)') AS in_tests FROM pages")
def path_predicates(spark, sf):
    pages = S.table(spark, sf, "pages")
    return S.pages_files(pages).join(pages.select("page_id", F.lower("url").rlike(r"(^|/)(tests?|__tests__|spec|specs|e2e|testing)(/|$)").alias("in_tests")), "page_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars BETWEEN 1000 AND 3000 AND lang IN ('en', 'de')")
def scan_filter_project(spark, sf):
    return S.table(spark, sf, "documents").where(F.col("n_chars").between(1000, 3000) & F.col("lang").isin("en", "de")).select("doc_id", "lang", "source", "n_chars")


@query(f"WITH {ITEMS} SELECT kind, count(*) FILTER ({LIVE}) AS live, count(*) FILTER (NOT {LIVE} AND status = 'superseded') AS superseded, count(*) FILTER (NOT {LIVE} AND status <> 'superseded') AS closed FROM items GROUP BY kind")
def live_items_matrix(spark, sf):
    return lifecycle.matrix(_items(spark, sf), S.live())


@query("""WITH k AS (SELECT DISTINCT event_type AS kind FROM events), d AS (SELECT unnest(generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day),
c AS (SELECT ts::DATE AS day, event_type AS kind, count(*) n FROM events GROUP BY ALL) SELECT day, kind, coalesce(n, 0)::BIGINT AS n FROM k CROSS JOIN d LEFT JOIN c USING (day, kind)""")
def daily_activity_calendar(spark, sf):
    return lifecycle.calendar(S.table(spark, sf, "events"), "ts", "event_type", 14, F.lit("2024-01-30").cast("date"))


@query(f"""WITH {ITEMS} SELECT kind, status = 'rejected' AS rejected, count(*) AS added FROM items WHERE created_at >= (SELECT max(created_at) FROM items) - INTERVAL 7 DAY GROUP BY ALL""")
def weekly_counters(spark, sf):
    items = _items(spark, sf)
    last = items.agg(F.max("created_at").alias("last"))
    recent = items.crossJoin(F.broadcast(last)).where(F.col("created_at") >= F.col("last") - F.expr("interval 7 days"))  # one row
    return recent.groupBy("kind", (F.col("status") == "rejected").alias("rejected")).agg(F.count("*").alias("added"))


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def store_stats(spark, sf):
    return S.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").cast("long").alias("chars"), F.countDistinct("lang").alias("langs"))


@query(f"""WITH {ITEMS}, r AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'drop' ELSE 'done' END AS verb FROM documents)
SELECT id, kind, verb, CASE WHEN {LIVE} AND n IS NOT NULL THEN n ELSE status END AS status, CASE WHEN NOT {LIVE} THEN 'already closed' WHEN n IS NULL THEN 'not possible for this kind' END AS error FROM (
SELECT r.id, kind, verb, status, CASE kind || ' ' || verb WHEN 'task done' THEN 'done' WHEN 'error done' THEN 'fixed' WHEN 'task drop' THEN 'dropped' WHEN 'error drop' THEN 'dropped' WHEN 'pin drop' THEN 'retired' WHEN 'note drop' THEN 'retired' WHEN 'decision drop' THEN 'retracted' WHEN 'handoff drop' THEN 'superseded' END n FROM r JOIN items ON doc_id = r.id)""")
def close_items(spark, sf):
    items = _items(spark, sf).withColumnRenamed("doc_id", "id")
    requests = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "drop").otherwise("done").alias("verb"))
    return lifecycle.close(items, requests, S.live())


@query(f"""WITH {ITEMS}, g AS (SELECT DISTINCT doc_id AS gone FROM labels WHERE toxic = 1) SELECT doc_id AS id, kind, CASE WHEN gone IS NOT NULL AND {LIVE} THEN CASE kind WHEN 'pin' THEN 'retired' WHEN 'decision' THEN 'retracted' WHEN 'task' THEN 'dropped' WHEN 'error' THEN 'dropped' WHEN 'note' THEN 'retired' ELSE 'superseded' END ELSE status END AS status, CASE WHEN gone IS NOT NULL THEN '[forgotten]' ELSE text END AS text FROM items LEFT JOIN g ON gone = doc_id""")
def forget_items(spark, sf):
    items = _items(spark, sf).withColumnRenamed("doc_id", "id")
    gone = S.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    return lifecycle.forget(items, gone).select("id", "kind", "status", "text")


@query(f"""WITH {ITEMS}, p AS (SELECT superseded_by r, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS replaces FROM items WHERE superseded_by IS NOT NULL GROUP BY 1)
SELECT a.doc_id AS id, a.kind, a.status, a.superseded_by, b.status AS by_status, coalesce(replaces, '') AS replaces FROM items a LEFT JOIN items b ON a.superseded_by = b.doc_id LEFT JOIN p ON a.doc_id = r""")
def supersession_chain(spark, sf):
    return lifecycle.supersession(_items(spark, sf).withColumnRenamed("doc_id", "id"))


@query(f"WITH {ITEMS} SELECT source, max(doc_id) AS id, max(created_at) AS created_at FROM items WHERE kind = 'handoff' AND status = 'active' GROUP BY source")
def latest_handoff(spark, sf):
    return lifecycle.latest_handoff(_items(spark, sf).withColumnRenamed("doc_id", "id"))


@query(f"WITH {TURNS} SELECT session_id, min(created_at) AS started_at, max(created_at) AS last_seen_at, count(*) FILTER (role = 'user') AS prompts, count(*) AS turns FROM turns GROUP BY session_id")
def session_rollup(spark, sf):
    return lifecycle.sessions(_turns(spark, sf))


@query("SELECT DISTINCT 's' || event_id AS session_id FROM events WHERE event_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user')")
def silent_sessions_anti(spark, sf):
    opened = S.table(spark, sf, "events").select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_id")).distinct()
    return lifecycle.silent(opened, _turns(spark, sf))


@query(f"WITH {TURNS} SELECT session_id, role, hash, min(id) AS id FROM turns WHERE trim(text) <> '' GROUP BY session_id, role, prompt_id, hash")
def turn_dedupe(spark, sf):
    turns = _turns(spark, sf)
    return lifecycle.dedupe_turns(turns.unionByName(turns), ["id"]).select("session_id", "role", "hash", "id")


@query(f"""WITH {TURNS}, p AS (SELECT id, session_id, role, row_number() OVER (PARTITION BY session_id ORDER BY id) n FROM turns)
SELECT c.id AS centre, o.id, o.n - c.n AS distance FROM p c JOIN p o USING (session_id) WHERE c.role = 'user' AND abs(o.n - c.n) <= 2""")
def turn_neighbourhood(spark, sf):
    turns = _turns(spark, sf)
    return lifecycle.neighbours(turns, turns.where("role = 'user'").select("id"), 2)


LOGS = "logs AS (SELECT user_id AS id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || event_id, chr(10) ORDER BY ts, event_id) AS text FROM events GROUP BY user_id)"
LINES = "lines AS (SELECT id, unnest(generate_series(1, len(l))) AS line_no, unnest(l) AS line, len(l) AS total FROM (SELECT id, string_split(text, chr(10)) l FROM logs))"


def _lines(spark, sf):
    events = S.table(spark, sf, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", F.col("event_id").cast("string"))
    logs = events.groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return folding.numbered(logs, "id", "text")


@query(f"""WITH {LOGS}, {LINES}, c AS (SELECT *, length(line) + 1 AS cost FROM lines),
r AS (SELECT *, sum(cost) OVER (PARTITION BY id ORDER BY line_no) ft, sum(cost) OVER (PARTITION BY id ORDER BY line_no DESC) fe FROM c),
p AS (SELECT *, CASE WHEN line_no <= 10 AND (ft <= 450 OR line_no = 1) THEN 'head' WHEN total - line_no + 1 <= 5 AND (fe <= 250 OR line_no = total) THEN 'tail' WHEN regexp_matches(line, '(?i)\\b(error|fail)') THEN 'salient' ELSE 'hidden' END part FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY line_no) pn, sum(cost) OVER (PARTITION BY id, part ORDER BY line_no) pc FROM p)
SELECT id, line_no, part, line FROM q WHERE part <> 'hidden' AND (part <> 'salient' OR (pn <= 30 AND pc <= 300))""")
def fold_preview(spark, sf):
    return folding.preview(_lines(spark, sf), 10, 5, 1000)


@query(f"WITH {LOGS}, {LINES} SELECT id, count(*) AS salient FROM lines WHERE line LIKE '% error %' GROUP BY id")
def fold_salient_lines(spark, sf):
    return _lines(spark, sf).where(T.is_salient(F.col("line"))).groupBy("id").agg(F.count("*").alias("salient"))


@query(f"WITH {LOGS}, {LINES} SELECT id, line_no, line FROM lines WHERE line_no BETWEEN 5 AND 9")
def unfold_range(spark, sf):
    return folding.unfold(_lines(spark, sf), 9, 5)


@query(f"""WITH {LOGS}, {LINES}, h AS (SELECT *, line LIKE '%purchase%' AS hit FROM lines) SELECT id, line_no, hit, line FROM (SELECT *, max(hit) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) near FROM h) WHERE near""")
def unfold_grep_context(spark, sf):
    return folding.grep(_lines(spark, sf), ["PURCHASE"], 1)


@query(f"WITH {TURNS} SELECT session_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY id) AS body FROM turns WHERE turn BETWEEN 1 AND 4 GROUP BY session_id")
def span_reconstruct(spark, sf):
    return folding.span_text(_turns(spark, sf), F.lit(1), F.lit(4))


@query(f"""WITH RECURSIVE {TURNS}, o AS (SELECT session_id, id, length(text) + 1 AS cost, row_number() OVER (PARTITION BY session_id ORDER BY id) k FROM turns),
g AS (SELECT session_id, 0::BIGINT k, 0::BIGINT used, 0::BIGINT kept FROM (SELECT DISTINCT session_id FROM turns) UNION ALL
SELECT g.session_id, o.k, CASE WHEN used + cost <= 400 THEN used + cost ELSE used END, CASE WHEN used + cost <= 400 THEN kept + 1 ELSE kept END FROM g JOIN o ON o.session_id = g.session_id AND o.k = g.k + 1)
SELECT session_id, max(k) AS n, max(kept) AS kept, max(used) AS used FROM g GROUP BY session_id""")
def budget_pack_skip(spark, sf):
    return budget.greedy(_turns(spark, sf), "session_id", ["id"], F.length("text") + 1, 400)


@query(f"WITH {TURNS} SELECT session_id, id, running::BIGINT AS running FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY session_id ORDER BY id) running FROM turns) WHERE running <= 600")
def budget_prefix(spark, sf):
    return budget.prefix(_turns(spark, sf), "session_id", [F.col("id")], F.length("text") + 1, 600).select("session_id", "id", "running")


CO = """s AS (SELECT * FROM files WHERE sha IN (SELECT sha FROM files GROUP BY sha HAVING count(*) <= 30)), n AS (SELECT path, count(*) n FROM s GROUP BY path),
p AS (SELECT a.path a, b.path b, count(*) n FROM s a JOIN s b ON a.sha = b.sha AND a.path < b.path GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT a, b, p.n, p.n / sqrt(x.n * y.n) AS score FROM p JOIN n x ON x.path = a JOIN n y ON y.path = b WHERE p.n / sqrt(x.n * y.n) >= 0.05),
t AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, other DESC, n DESC) r FROM (SELECT *, a own, b other FROM c UNION ALL SELECT *, b, a FROM c))"""


@query(f"WITH {FILES}, {CO} SELECT a, b, max(n) AS n, round(max(score), 3) AS score FROM t WHERE r <= 5 GROUP BY a, b")
def co_change(spark, sf):
    _, files = S.commits(S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem"))
    return history.co_change(files, 0.05)


@query(f"""WITH {FILES}, u AS (SELECT path, count(*) commits, CAST(sum(added + deleted) AS BIGINT) churn FROM files WHERE sha IN (SELECT o_orderkey FROM orders) GROUP BY path HAVING count(*) >= 2)
SELECT path, commits, churn, round(ln(1 + commits) * ln(1 + churn) * (0.3 + p_retailprice / (SELECT max(p_retailprice) FROM part)), 6) AS score FROM u JOIN part ON p_partkey = path ORDER BY score DESC, path LIMIT 50""")
def hotspots(spark, sf):
    commits, files = S.commits(S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem"))
    ranks = S.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("rank"))
    return history.hotspots(commits, files, ranks, 50)


def _edges(spark, sf):
    return S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"), F.lit("depends").alias("kind")).distinct()


@query("SELECT l_suppkey AS supplier, p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def edge_rollup(spark, sf):
    """Edges of members rolled up to their owners."""
    part = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return S.table(spark, sf, "lineitem").join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("supplier"), "brand").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT src, dst, round(sum(w), 6) AS weight FROM (SELECT src, dst, 0.3 * 2.0 AS w FROM edges UNION ALL SELECT dst, src, 0.08 * 0.3 * 2.0 FROM edges) GROUP BY ALL".replace("round(sum(w), 6)", "round(CAST(sum(w) AS DOUBLE), 6)"))
def structural_edges(spark, sf):
    return graph.structural(_edges(spark, sf).withColumn("weight", F.lit(2.0))).withColumn("weight", F.round("weight", 6))


@query("""WITH a AS (SELECT l_partkey src, l_suppkey dst, 'depends' kind, max(l_quantity) AS old FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_partkey <> l_suppkey GROUP BY 1, 2),
d AS (SELECT l_partkey src, l_suppkey dst, 'depends' kind, max(l_quantity) AS new FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_partkey <> l_suppkey GROUP BY 1, 2)
SELECT src, dst, kind, old, new, CASE WHEN old IS NULL THEN 'open' WHEN new IS NULL THEN 'close' ELSE 'reweigh' END AS action FROM a FULL JOIN d USING (src, dst, kind) WHERE old IS NULL OR new IS NULL OR abs(new - old) > 1e-6""")
def edge_diff_merge(spark, sf):
    line = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("depends").alias("kind"), F.col("l_quantity").alias("weight"), "l_shipdate")
    mid = F.lit("1998-01-01").cast("timestamp_ntz")
    return graph.diff(graph.strongest(line.where(F.col("l_shipdate") < mid)), graph.strongest(line.where(F.col("l_shipdate") >= mid)))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-01' AND (l_returnflag <> 'R' OR l_shipdate + INTERVAL 90 DAY > TIMESTAMP '1998-06-01') GROUP BY ALL""")
def as_of_edges(spark, sf):
    edges = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("valid_from"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("interval 90 days")).alias("valid_to"))
    return graph.as_of(edges, F.lit("1998-06-01").cast("timestamp_ntz")).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


GRAPH = """e AS (SELECT DISTINCT n_regionkey + 0 AS src, n_nationkey + 100 AS dst FROM nation UNION SELECT c_nationkey + 100, c_custkey + 1000 FROM customer UNION SELECT c_custkey + 1000, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def _graph(spark, sf):
    nation, customer = S.table(spark, sf, "nation"), S.table(spark, sf, "customer")
    e = nation.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    e = e.union(customer.select((F.col("c_nationkey") + 100).cast("long"), F.col("c_custkey") + 1000))
    e = e.union(customer.where("c_acctbal < 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey") + 1000, F.col("n_regionkey").cast("long"))).distinct()
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e.withColumn("weight", F.lit(1.0))


def _pagerank_sql(p: str, rounds: int) -> str:
    steps = ", ".join(
        f"r{k} AS (SELECT id, 0.15 * p + 0.85 * (coalesce((SELECT sum(r.r / deg) FROM e JOIN o USING (src) JOIN r{k - 1} r ON r.id = e.src WHERE e.dst = v0.id), 0) + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM e)) * p) AS r FROM v0)" for k in range(1, rounds + 1)
    )
    return f"WITH {GRAPH}, o AS (SELECT src, count(*) deg FROM e GROUP BY src), w AS (SELECT id, {p} AS p FROM v), v0 AS (SELECT id, CAST(p AS DOUBLE) / (SELECT sum(p) FROM w) AS p FROM w), r0 AS (SELECT id, p AS r FROM v0), {steps} SELECT CAST(id AS BIGINT) AS id, round(r, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql("1", 4))
def pagerank_fixed(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.pagerank(nodes, edges, 4).withColumn("rank", F.round("rank", 9))


@query(_pagerank_sql("CASE WHEN id < 100 THEN 1 ELSE 0 END", 3))
def personalized_pagerank(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.pagerank(nodes, edges, 3, nodes.where("id < 100").withColumn("p", F.lit(1.0))).withColumn("rank", F.round("rank", 9))


@query(f"WITH RECURSIVE {GRAPH}, b AS (SELECT 1105::BIGINT id, 0::BIGINT l UNION SELECT e.src, l + 1 FROM b JOIN e ON e.dst = b.id WHERE l < 3) SELECT id, min(l) AS level FROM b GROUP BY id")
def impact_levels(spark, sf):
    _, edges = _graph(spark, sf)
    return graph.impact(edges, spark.createDataFrame([(1105,)], "id long"))


@query(f"WITH RECURSIVE {GRAPH}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), b AS (SELECT 3::BIGINT id, 0::BIGINT l UNION SELECT u.dst, l + 1 FROM b JOIN u ON u.src = b.id WHERE l < 2) SELECT id, min(l) AS level FROM b GROUP BY id")
def neighborhood(spark, sf):
    _, edges = _graph(spark, sf)
    return graph.levels(graph.undirected(edges), spark.createDataFrame([(3,)], "id long"), 2)


@query(f"WITH RECURSIVE {GRAPH}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), b AS (SELECT 100::BIGINT id, 0::BIGINT l UNION SELECT u.dst, l + 1 FROM b JOIN u ON u.src = b.id WHERE l < 6) SELECT 100::BIGINT AS a, 1105::BIGINT AS b, min(l) AS steps FROM b WHERE id = 1105")
def shortest_path_len(spark, sf):
    _, edges = _graph(spark, sf)
    path = graph.shortest_path(edges, 100, 1105)
    return spark.createDataFrame([(100, 1105, len(path) - 1 if path else None)], "a long, b long, steps long")


@query()
def communities(spark, sf):
    _, files = S.commits(S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem"))
    return graph.communities(history.co_change(files, 0.05).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("score").alias("weight")))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def import_extract(spark, sf):
    return S.imports(S.table(spark, sf, "pages"))


PAGES = "f AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages), pp AS (SELECT path, string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/') l FROM f)"


@query(f"""WITH {PAGES}, sx AS (SELECT suffix, min(path) by_suffix FROM (SELECT path, array_to_string(l[i:], '/') suffix FROM (SELECT path, l, unnest(generate_series(1, len(l))) i FROM pp)) GROUP BY suffix),
i AS (SELECT page_id, href, regexp_replace(href, '[?#].*$', '') AS key FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages))
SELECT page_id, href, coalesce(f.path, by_suffix) AS target, CASE WHEN f.path IS NOT NULL THEN 'path' WHEN by_suffix IS NOT NULL THEN 'suffix' ELSE 'external' END AS how FROM i LEFT JOIN f ON f.path = key LEFT JOIN sx ON suffix = regexp_replace(key, '^/+|/+$', '', 'g')""")
def import_resolve(spark, sf):
    pages = S.table(spark, sf, "pages")
    return resolve.links(S.imports(pages), S.pages_files(pages))


@query(f"WITH {PAGES} SELECT DISTINCT array_to_string(l[1:i - 1], '/') AS src, array_to_string(l[1:i], '/') AS dst FROM (SELECT l, unnest(generate_series(1, len(l))) i FROM pp)")
def dir_hierarchy(spark, sf):
    return resolve.directories(S.pages_files(S.table(spark, sf, "pages")))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type IN ('signup', 'purchase') AS known, event_id % 3 AS v FROM events),
w AS (SELECT *, last_value(CASE WHEN known THEN {'t': ts, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b,
first_value(CASE WHEN known THEN {'t': ts, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) a FROM e),
x AS (SELECT *, CASE WHEN date_diff('second', date_trunc('second', b.t), date_trunc('second', ts)) <= 43200 THEN b.v END bv, CASE WHEN date_diff('second', date_trunc('second', ts), date_trunc('second', a.t)) <= 43200 THEN a.v END av FROM w)
SELECT event_id, CASE WHEN known THEN v WHEN bv IS NULL OR av IS NULL OR bv = av THEN coalesce(bv, av) END AS routed FROM x""")
def near_in_time_asof(spark, sf):
    events = S.table(spark, sf, "events")
    return routing.nearest(events, "user_id", "ts", "event_id", F.col("event_type").isin("signup", "purchase"), F.col("event_id") % 3).select("event_id", "routed")


@query("""WITH s AS (SELECT user_id, min(ts) AS start FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT event_id, user_id FROM events JOIN s USING (user_id) WHERE abs(date_diff('second', date_trunc('second', start), date_trunc('second', ts))) <= 43200""")
def interval_match(spark, sf):
    events = S.table(spark, sf, "events")
    return routing.within(events, events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("start")), "user_id", "ts", 43200).select("event_id", "user_id")


@query(f"""WITH {TURNS}, o AS (SELECT source AS project, term, count(*) n FROM (SELECT source, unnest({TERMS.format('text')}) term FROM documents) GROUP BY ALL), d AS (SELECT term, count(*) df FROM o GROUP BY term),
s AS (SELECT id, project, round(sum(CASE WHEN n = 1 THEN 0.4::DOUBLE WHEN n = 2 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END / df), 6) AS score FROM (SELECT id, unnest({TERMS.format('text')}) term FROM turns) JOIN o USING (term) JOIN d USING (term) GROUP BY id, project),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, project) k, lead(score) OVER (PARTITION BY id ORDER BY score DESC, project) nx FROM s)
SELECT id, project, score, score >= 2.0 AND score >= 1.5 * coalesce(nx, 0) AS confident FROM r WHERE k = 1""")
def route_best_match(spark, sf):
    docs = S.table(spark, sf, "documents").select(F.col("source").alias("project"), "text")
    return routing.scores(_turns(spark, sf).select("id", "text"), docs)


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(complete|completed|done|finished|shipped|resolved)\b') AS done, regexp_matches(text, '(?i)^\s*(?:dummy|lorem ipsum|asdf|foobar|foo bar)\b') AS junk FROM documents""")
def classify_records(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.looks_done(F.col("text")).alias("done"), F.col("text").rlike(r"(?i)^\s*(?:dummy|lorem ipsum|asdf|foobar|foo bar)\b").alias("junk"))


@query("""SELECT user_id AS session_id, min(ts) AS started_at, max(ts) AS last_seen_at, count(*) FILTER (event_type = 'view') AS prompts, count(*) FILTER (event_type = 'click') AS edits, count(*) FILTER (event_type = 'error') AS folds, count(*) AS events FROM events GROUP BY user_id""")
def session_state_replay(spark, sf):
    return E.session_state(S.table(spark, sf, "events"))


@query("""SELECT event_id, user_id AS session_id, prompt_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt_id FROM events) WHERE event_type = 'purchase'""")
def reply_prompts(spark, sf):
    return E.replies(S.table(spark, sf, "events"))


@query("SELECT user_id AS session_id, max(ts) AS changed_at, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 2 SECOND GROUP BY user_id")
def change_feed(spark, sf):
    return E.changes(S.table(spark, sf, "events"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@query("""SELECT p_brand AS brand, p_partkey AS id, tier FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) k, CASE WHEN b <= 10 THEN 10 WHEN b <= 50 THEN 6 ELSE 3 END::BIGINT AS tier FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY total DESC, p_brand) b FROM (SELECT p_brand, max(p_retailprice) total FROM part GROUP BY 1)) USING (p_brand)) WHERE k <= tier""")
def repo_map_tiers(spark, sf):
    """More members of the owners that rank first; owners are few."""
    from pyspark.sql import Window

    part = S.table(spark, sf, "part")
    owners = part.groupBy("p_brand").agg(F.max("p_retailprice").alias("total"))
    b = F.row_number().over(Window.orderBy(F.desc("total"), "p_brand"))
    tiers = owners.select("p_brand", F.when(b <= 10, 10).when(b <= 50, 6).otherwise(3).cast("long").alias("tier"))
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return part.join(tiers, "p_brand").withColumn("k", k).where("k <= tier").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "tier")


def _records(spark, sf):
    return _items(spark, sf).withColumnRenamed("doc_id", "id").withColumn("title", T.derive_title(F.col("text")))


NOW = "2024-01-10 00:00:00"


@query()
def session_pack(spark, sf):
    """No SQL: an ordered scan that carries a text; tested against a plain scan."""
    return pack.build(_records(spark, sf), F.lit(NOW).cast("timestamp_ntz"))


@query()
def pack_reach(spark, sf):
    items = _records(spark, sf)
    return pack.reach(pack.build(items, F.lit(NOW).cast("timestamp_ntz")), items)


SQUEEZED = "lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


@query(f"""WITH {ITEMS}, r AS (SELECT doc_id AS id, source AS project, status <> 'superseded' AS accept, kind, kind || '|' || {SQUEEZED} AS k FROM items),
h AS (SELECT DISTINCT 'src0' AS project, 'pin|' || {SQUEEZED} AS k FROM conversations), f AS (SELECT project, k, min(id) AS first FROM r WHERE accept GROUP BY ALL)
SELECT r.id, r.project, r.kind, CASE WHEN NOT accept THEN 'skipped' WHEN h.k IS NOT NULL OR first <> r.id THEN 'duplicate' ELSE 'imported' END AS outcome FROM r LEFT JOIN f USING (project, k) LEFT JOIN h USING (project, k)""")
def idempotent_import(spark, sf):
    routes = _records(spark, sf).select("id", F.col("source").alias("project"), (F.col("status") != "superseded").alias("accept"), "kind", "text")
    return legacy.apply_routes(routes, S.table(spark, sf, "conversations").select(F.lit("src0").alias("project"), F.lit("pin").alias("kind"), "text"))


@query(f"""WITH {ITEMS} SELECT doc_id AS id, source, CASE WHEN kind <> 'handoff' THEN status WHEN nx IS NULL THEN 'active' ELSE 'superseded' END AS status, nx AS replaced_by FROM (
SELECT *, CASE WHEN kind = 'handoff' THEN lead(doc_id) OVER (PARTITION BY source, kind ORDER BY created_at, doc_id) END AS nx FROM items)""")
def handoff_chain(spark, sf):
    old = _records(spark, sf).select(F.col("id").alias("row"), "source", "kind", "status", "created_at", F.lit(0).alias("ord"))
    return legacy.chain(old, "source").select(F.col("row").alias("id"), "source", "status", F.col("superseded_by").alias("replaced_by"))


@query(f"""WITH {ITEMS}, t AS (SELECT kind, kind || '|' || {SQUEEZED} AS k, doc_id, lang, status FROM (SELECT items.*, lang FROM items JOIN documents USING (doc_id))), root AS (SELECT * FROM t WHERE lang = 'en'),
n AS (SELECT kind, arg_min(status, doc_id) AS status FROM t WHERE lang <> 'en' AND kind <> 'handoff' AND k NOT IN (SELECT k FROM root) GROUP BY kind, k)
SELECT kind, status, count(*) AS n FROM (SELECT kind, status FROM root UNION ALL SELECT kind, status FROM n UNION ALL SELECT kind, status FROM t WHERE lang <> 'en' AND kind = 'handoff') GROUP BY ALL""")
def merge_stores(spark, sf):
    """The English records as the root's store, the others as nested ones."""
    langs = S.table(spark, sf, "documents").select("doc_id", "lang")
    old = _items(spark, sf).join(langs, "doc_id").select("kind", "status", "text", F.lit("x").alias("origin"), "created_at", F.lit(None).cast("string").alias("session_id"), F.lit(0).alias("ord"), F.col("doc_id").alias("row"), "lang")
    return legacy.tally(legacy.merge(old.where("lang = 'en'").drop("lang"), old.where("lang <> 'en'").drop("lang")))


AGE = f"date_diff('second', created_at, TIMESTAMP '{NOW}')"


@query(f"""WITH {ITEMS}, {TURNS}, i AS (SELECT *, {LIVE} AS live, {AGE} AS age FROM items), u AS (SELECT *, {AGE} AS age FROM turns),
a AS (SELECT count(*) FILTER (kind = 'pin' AND status = 'active') AS pins, count(*) FILTER (kind = 'pin' AND status = 'active' AND priority) AS critical_pins FROM i)
SELECT 'memory' AS part, 'pins' AS name, pins AS value FROM a UNION ALL SELECT 'memory', 'critical_pins', critical_pins FROM a
UNION ALL SELECT 'memory', 'decisions', count(*) FROM i WHERE kind = 'decision' AND status = 'accepted' UNION ALL SELECT 'memory', 'rejected', count(*) FROM i WHERE kind = 'decision' AND status = 'rejected'
UNION ALL SELECT 'memory', 'tasks_open', count(*) FROM i WHERE kind = 'task' AND status = 'open' UNION ALL SELECT 'memory', 'errors_open', count(*) FROM i WHERE kind = 'error' AND status = 'open'
UNION ALL SELECT 'memory', 'notes', count(*) FROM i WHERE kind = 'note' AND status = 'active' UNION ALL SELECT 'memory', 'closed', count(*) FROM i WHERE NOT live AND kind <> 'handoff'
UNION ALL SELECT 'week', 'added', count(*) FROM i WHERE age <= 604800 AND kind <> 'handoff' UNION ALL SELECT 'week', 'rejected', count(*) FROM i WHERE age <= 604800 AND kind = 'decision' AND status = 'rejected'
UNION ALL SELECT 'week', 'turns', count(*) FROM u WHERE age <= 604800 UNION ALL SELECT 'week', 'prompts', count(*) FROM u WHERE age <= 604800 AND role = 'user'
UNION ALL SELECT 'attention', 'stale_tasks', count(*) FROM i WHERE kind = 'task' AND status = 'open' AND age > 1814400 UNION ALL SELECT 'attention', 'old_errors', count(*) FROM i WHERE kind = 'error' AND status = 'open' AND age > 604800
UNION ALL SELECT 'attention', 'no_critical_pins', CASE WHEN pins > 0 AND critical_pins = 0 THEN 1 ELSE 0 END FROM a""")
def status_report(spark, sf):
    return reports.status(_records(spark, sf), _turns(spark, sf), F.lit(NOW).cast("timestamp_ntz"))


@query(f"""WITH {ITEMS} SELECT 'records' AS panel, kind || ' ' || CASE WHEN {LIVE} THEN 'live' WHEN status = 'superseded' THEN 'superseded' ELSE 'closed' END AS label, count(*) AS value FROM items GROUP BY ALL
UNION ALL SELECT 'turns', role || ' turns', count(*) FROM conversations GROUP BY role UNION ALL SELECT 'turns', role || ' characters', sum(length(text))::BIGINT FROM conversations GROUP BY role
UNION ALL SELECT * FROM (SELECT 'languages', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY 3 DESC, 2 LIMIT 6)""")
def dashboard(spark, sf):
    return reports.dashboard(_records(spark, sf), _turns(spark, sf), S.table(spark, sf, "documents"))


@query("""WITH b AS (SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 400), c AS (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem WHERE l_partkey IN (SELECT id FROM b))
SELECT x.p AS src, y.p AS dst, 'together' AS kind, count(*) AS weight FROM c x JOIN c y ON x.o = y.o AND x.p < y.p GROUP BY ALL""")
def graph_view_edges(spark, sf):
    """Parts that stand in one order, among the 400 dearest parts; an order has few lines, so its pairs are few."""
    return reports.graph_view(*_view(spark, sf))[1]


@query("""WITH b AS (SELECT p_partkey AS id, p_retailprice AS rank, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) k FROM part ORDER BY k LIMIT 400), c AS (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem WHERE l_partkey IN (SELECT id FROM b)),
e AS (SELECT x.p AS id FROM c x JOIN c y ON x.o = y.o AND x.p <> y.p) SELECT id, rank FROM b WHERE k <= 40 OR id IN (SELECT id FROM e)""")
def graph_view_nodes(spark, sf):
    return reports.graph_view(*_view(spark, sf))[0]


def _view(spark, sf):
    nodes = S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("rank"))
    lines = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    pairs = lines.withColumnRenamed("p", "src").join(lines.withColumnRenamed("p", "dst"), "o").where("src < dst")
    return nodes, pairs.select("src", "dst", F.lit("together").alias("kind"))


@query("""WITH s AS (SELECT p_brand AS path, p_partkey AS line, p_name || ' ' || p_type AS sig, p_retailprice AS rank FROM part), f AS (SELECT path, row_number() OVER (ORDER BY max(rank) DESC, path) AS pos FROM s GROUP BY path),
k AS (SELECT s.*, pos, row_number() OVER (PARTITION BY path ORDER BY rank DESC, line) AS k FROM s JOIN f USING (path)),
l AS (SELECT pos, path, line, '  ' || CASE WHEN length(sig) > 100 THEN substr(sig, 1, 99) || '…' ELSE sig END AS text FROM k WHERE k <= CASE WHEN pos <= 10 THEN 10 WHEN pos <= 50 THEN 6 ELSE 3 END UNION ALL SELECT pos, path, -1, path || ':' FROM f),
r AS (SELECT *, sum(length(text) + 1) OVER (ORDER BY pos, line ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY path ORDER BY line) AS line_no FROM l) SELECT pos, path, line_no, text FROM r WHERE used <= 3584""")
def repo_map(spark, sf):
    """Brands as files, parts as their symbols."""
    symbols = S.table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").cast("string").alias("qualname"), F.concat_ws(" ", "p_name", "p_type").alias("sig"), F.col("p_partkey").cast("int").alias("line"), F.col("p_retailprice").alias("rank"))
    return reports.repo_map(symbols.groupBy("path").agg(F.max("rank").alias("score")), symbols)


@query(f"""WITH {ITEMS}, {TURNS} SELECT 'items:' || (SELECT count(*) FROM items) || ':' || (SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM items) || '|turns:' || (SELECT count(*) FROM turns) || ':' || (SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM turns) AS fingerprint""")
def change_fingerprint(spark, sf):
    return reports.fingerprint(items=(_records(spark, sf), "created_at"), turns=(_turns(spark, sf), "created_at"))


@query("""WITH sy AS (SELECT 's' || s_suppkey % 7 AS path, s_name AS qualname, 'Supplier' || s_nationkey AS name FROM supplier), a AS (SELECT DISTINCT c_custkey AS id, 'Supplier' || c_nationkey AS name FROM customer),
n AS (SELECT name, count(*) n FROM sy GROUP BY name HAVING count(*) <= 3) SELECT 'c' || id AS path, 'main' AS owner, name AS raw, sy.path AS to_path, qualname AS to_name, round(0.6::DOUBLE / n, 6) AS weight FROM a JOIN n USING (name) JOIN sy USING (name)""")
def call_resolution(spark, sf):
    """Customers call suppliers of their nation; a nation with more than three is no answer."""
    supplier = S.table(spark, sf, "supplier")
    symbols = supplier.select(F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")).alias("path"), F.col("s_name").alias("qualname"), F.concat(F.lit("Supplier"), F.col("s_nationkey").cast("string")).alias("name"), F.lit("function").alias("kind"))
    calls = S.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.lit("main").alias("owner"), F.concat(F.lit("Supplier"), F.col("c_nationkey").cast("string")).alias("raw"))
    none = symbols.where(F.lit(False))
    bases = none.select("path", "qualname", F.col("name").alias("base"))
    aliases = none.select("path", F.col("name").alias("alias"), F.col("path").alias("to_path"), F.col("name").alias("symbol"))
    return names.calls(calls, symbols, bases, aliases).withColumn("weight", F.round("weight", 6))


def queries() -> dict[str, Query]:
    from . import project, upkeep  # noqa: F401  they add their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
