"""Queries over code, folds, ranks and reports of a project, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import codegraph, evaluation, folding, imports, louvain, names, panels, ranks, resolve, retrieval, toolfolds
from ..operators.graph import KIND_WEIGHT
from ..sources import tables as S
from ..storage import store
from .catalogue import ASKED, ITEMS, TERMS, _asked, _bm25_sql, _items, query

# ------------------------------------------------------------------ code facts
OLD, NEW = "lang <> 'es'", "lang <> 'de'"


@query(f"""WITH a AS (SELECT source AS path, 'd' || doc_id AS qualname, sha1(text) AS hash, doc_id AS line FROM documents WHERE {OLD}), b AS (SELECT source AS path, 'd' || doc_id AS qualname, sha1(CASE WHEN lang = 'fr' AND doc_id % 3 = 0 THEN upper(source) ELSE text END) AS hash, doc_id AS line FROM documents WHERE {NEW}),
j AS (SELECT path, qualname, coalesce(b.line, a.line) AS line, CASE WHEN a.line IS NULL THEN 'added' WHEN b.line IS NULL THEN 'removed' WHEN a.hash IS DISTINCT FROM b.hash THEN 'changed' END AS sort FROM a FULL JOIN b USING (path, qualname)),
k AS (SELECT *, row_number() OVER (PARTITION BY path, sort ORDER BY line, qualname) AS n FROM j WHERE sort IS NOT NULL)
SELECT path, coalesce(string_agg(qualname, ' ' ORDER BY n) FILTER (sort = 'added' AND n <= 25), '') AS added, coalesce(string_agg(qualname, ' ' ORDER BY n) FILTER (sort = 'changed' AND n <= 25), '') AS changed, coalesce(string_agg(qualname, ' ' ORDER BY n) FILTER (sort = 'removed' AND n <= 25), '') AS removed FROM k GROUP BY path""")
def symbol_diff(spark, sf):
    """What changed in each file; documents are its symbols."""
    docs = S.table(spark, sf, "documents").withColumn("qualname", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    other = F.when((F.col("lang") == "fr") & (F.col("doc_id") % 3 == 0), F.upper("source")).otherwise(F.col("text"))
    old, new = (docs.where(w).select(F.col("source").alias("path"), "qualname", F.sha1(t).alias("hash"), F.col("doc_id").alias("line")) for w, t in ((OLD, F.col("text")), (NEW, other)))
    return codegraph.symbol_diff(old, new).select("path", *[F.array_join(c, " ").alias(c) for c in ("added", "changed", "removed")])


@query("""WITH f AS (SELECT 'd' || doc_id AS path, n_chars AS size, doc_id % 11 AS mtime, sha1(text) AS hash FROM documents WHERE source <> 'src1'), k AS (SELECT 'd' || doc_id AS path, n_chars AS size, CASE WHEN lang = 'fr' THEN 99 ELSE doc_id % 11 END AS mtime, sha1(CASE WHEN doc_id % 2 = 0 THEN text ELSE source END) AS hash FROM documents WHERE lang <> 'de')
SELECT path, CASE WHEN k.hash IS NULL THEN 'new' WHEN f.hash IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM f FULL JOIN k USING (path) WHERE k.hash IS NULL OR f.hash IS NULL OR ((f.size <> k.size OR f.mtime <> k.mtime) AND f.hash <> k.hash)""")
def file_diff(spark, sf):
    """Files that are new, gone or changed since they were listed."""
    docs = S.table(spark, sf, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    found = docs.where("source <> 'src1'").select("path", F.col("n_chars").alias("size"), (F.col("doc_id") % 11).alias("mtime"), F.sha1("text").alias("hash"))
    known = docs.where("lang <> 'de'").select("path", F.col("n_chars").alias("size"), F.when(F.col("lang") == "fr", 99).otherwise(F.col("doc_id") % 11).alias("mtime"), F.sha1(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("source"))).alias("hash"))
    return resolve.file_diff(found, known)


PLACES = "lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/m' || p_partkey % 50 || CASE WHEN p_partkey % 4 = 0 THEN '.php' ELSE '.rb' END"


@query(f"""WITH f AS (SELECT DISTINCT {PLACES} AS path FROM part), i AS (SELECT DISTINCT {PLACES} AS path, CASE p_partkey % 3 WHEN 0 THEN 'm' || p_partkey * 7 % 50 WHEN 1 THEN lower(replace(p_brand, '#', '')) || '/m' || p_partkey * 3 % 50 ELSE '../' || lower(replace(p_brand, '#', '')) || '/m' || p_partkey % 53 END AS raw, CASE WHEN p_partkey % 3 = 2 THEN 'ruby-rel' ELSE 'ruby' END AS rule FROM part),
c AS (SELECT i.path, i.raw, f.path AS target, list_sum(list_transform(generate_series(1, 2), lambda n: CASE WHEN list_slice(string_split(i.path, '/'), 1, n) = list_slice(string_split(f.path, '/'), 1, n) THEN 1 ELSE 0 END)) AS shared
  FROM i JOIN f ON rule = 'ruby' AND f.path <> i.path AND ends_with('/' || regexp_replace(f.path, '\\.[a-z]+$', ''), '/' || raw)),
n AS (SELECT path, raw, arg_min(target, (-shared, target)) AS target FROM c GROUP BY path, raw),
r AS (SELECT path, raw, string_split(path, '/')[1] || substr(raw, 3) AS base FROM i WHERE rule = 'ruby-rel'),
x AS (SELECT path, raw, CASE WHEN base || '.rb' IN (SELECT path FROM f) THEN base || '.rb' WHEN base || '.php' IN (SELECT path FROM f) THEN base || '.php' END AS target FROM r)
SELECT i.path, i.raw, i.rule, CASE WHEN coalesce(n.target, x.target) IS NOT NULL THEN 'file' WHEN i.rule = 'ruby' THEN 'package' ELSE 'none' END AS how, coalesce(n.target, x.target, CASE WHEN i.rule = 'ruby' THEN string_split(i.raw, '/')[1] END) AS target
FROM i LEFT JOIN n ON n.path = i.path AND n.raw = i.raw AND i.rule = 'ruby' LEFT JOIN x ON x.path = i.path AND x.raw = i.raw AND i.rule = 'ruby-rel'""")
def import_rules(spark, sf):
    """Imports by relative paths and by endings of paths, the nearest file first; parts are files."""
    part = S.table(spark, sf, "part")
    key = F.col("p_partkey")
    brand = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    path = F.concat(F.lower("p_type"), F.lit("/"), brand, F.lit("/m"), (key % 50).cast("string"), F.when(key % 4 == 0, ".php").otherwise(".rb"))
    raw = F.when(key % 3 == 0, F.concat(F.lit("m"), (key * 7 % 50).cast("string"))).when(key % 3 == 1, F.concat(brand, F.lit("/m"), (key * 3 % 50).cast("string"))).otherwise(F.concat(F.lit("../"), brand, F.lit("/m"), (key % 53).cast("string")))
    rows = part.select(path.alias("path"), raw.alias("raw"), F.when(key % 3 == 2, "ruby-rel").otherwise("ruby").alias("rule"), F.lit(1).alias("line"), F.array().cast("array<struct<name:string,alias:string>>").alias("names")).distinct()
    return imports.resolve(rows, rows.select("path").distinct()).select("path", "raw", "rule", "how", "target")


@query("""WITH sy AS (SELECT 's' || s_suppkey % 7 AS path, 'Supplier' || s_nationkey AS name, s_name AS qualname FROM supplier), i AS (SELECT DISTINCT 'c' || c_custkey AS path, 's' || c_custkey % 7 AS to_path FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT DISTINCT 'c' || c_custkey AS path, 'Supplier' || c_nationkey AS name FROM customer),
near AS (SELECT a.path, a.name, i.to_path, sy.qualname AS to_name, count(*) OVER (PARTITION BY a.path, a.name) AS n FROM a JOIN i USING (path) JOIN sy ON sy.path = i.to_path AND sy.name = a.name),
far AS (SELECT a.path, a.name, sy.path AS to_path, sy.qualname AS to_name FROM a JOIN sy USING (name) WHERE (SELECT count(*) FROM sy s WHERE s.name = a.name) = 1 AND NOT EXISTS (SELECT 1 FROM near x WHERE x.path = a.path AND x.name = a.name))
SELECT path, name, to_path, to_name, round(0.6::DOUBLE / n, 6) AS weight FROM near WHERE n <= 3 UNION ALL SELECT path, name, to_path, to_name, 0.3::DOUBLE FROM far""")
def name_references(spark, sf):
    """Names that files use, in what they import or where they mean one thing only."""
    supplier, customer = S.table(spark, sf, "supplier"), S.table(spark, sf, "customer")
    symbols = supplier.select(F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")).alias("path"), F.concat(F.lit("Supplier"), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_name").alias("qualname"), F.lit("function").alias("kind"))
    path = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    aliases = customer.where("c_custkey % 2 = 0").select(path.alias("path"), F.lit("x").alias("alias"), F.concat(F.lit("s"), (F.col("c_custkey") % 7).cast("string")).alias("to_path"), F.lit(None).cast("string").alias("symbol"))
    asked = customer.select(path.alias("path"), F.concat(F.lit("Supplier"), F.col("c_nationkey").cast("string")).alias("name"))
    return names.references(asked, symbols, aliases).withColumn("weight", F.round("weight", 6))


def _project(spark, sf):
    """Suppliers as files that hold parts, parts as symbols that call each other where an order has both."""
    lines = S.table(spark, sf, "lineitem")
    held = lines.groupBy(F.col("l_partkey").alias("p")).agg(F.min("l_suppkey").alias("s"))
    part, supplier = F.concat(F.lit("p"), F.col("p").cast("string")), F.concat(F.lit("s"), F.col("s").cast("string"))
    nodes = held.select(part.alias("id"), F.lit("function").alias("kind")).unionByName(held.select(supplier.alias("id"), F.lit("file").alias("kind")).distinct())
    contains = held.select(supplier.alias("src"), part.alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))
    first = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("a"))
    calls = lines.where("l_linenumber > 1").join(first, "l_orderkey").select(F.concat(F.lit("p"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.when(F.col("l_linenumber") == 2, "inherits").otherwise("calls").alias("kind"), (F.col("l_linenumber") / 2).alias("weight"))
    return nodes, contains.unionByName(calls)


@query(f"""WITH h AS (SELECT l_partkey AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1), c AS (SELECT x.l_partkey AS a, y.l_partkey AS b, y.l_linenumber AS n FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_linenumber = 1 AND y.l_linenumber > 1),
e AS (SELECT u.s AS x, v.s AS y, n / 2 * CASE WHEN n = 2 THEN {KIND_WEIGHT["inherits"]}::DOUBLE ELSE {KIND_WEIGHT["calls"]}::DOUBLE END AS w FROM c JOIN h u ON u.p = a JOIN h v ON v.p = b WHERE u.s <> v.s)
SELECT least('s' || x, 's' || y) AS src, greatest('s' || x, 's' || y) AS dst, round(sum(w), 6) AS weight FROM e GROUP BY 1, 2""")
def file_coupling(spark, sf):
    """How strongly files are tied by what they hold."""
    return louvain.coupling(*_project(spark, sf)).withColumn("weight", F.round("weight", 6))


@query()
def file_communities(spark, sf):
    """Communities of files by Louvain, and what they hold. No SQL: local moves in an order; tested against a plain walk."""
    return louvain.file_communities(*_project(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 45 AND l_partkey <> l_suppkey), b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
r(id, seen) AS (SELECT DISTINCT x, x FROM b UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.seen) SELECT id, min(seen) AS component FROM r GROUP BY id""")
def connected_parts(spark, sf):
    """Connected components of a sparse graph."""
    lines = S.table(spark, sf, "lineitem").where("l_discount > 0.09 and l_quantity > 45 and l_partkey <> l_suppkey")
    from ..operators import graph

    return graph.components(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


# ----------------------------------------------------------------------- folds
@query(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS line, generate_subscripts(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), 1) AS n FROM documents WHERE text <> ''),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^The ') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS section FROM l)
SELECT id, CAST(section AS BIGINT) AS section, max(CASE WHEN regexp_matches(line, '^The ') THEN regexp_replace(line, '^The ', '') END) AS title, count(*) AS lines, CAST(sum(length(line) + 1) AS BIGINT) AS chars FROM s GROUP BY id, section""")
def section_sizes(spark, sf):
    """Lines and characters of each section of a text."""
    return toolfolds.section_chars(folding.numbered(S.table(spark, sf, "documents"), "doc_id", "text"), "^The ")


@query(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS line, generate_subscripts(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), 1) AS n FROM documents WHERE text <> ''),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n) AS used FROM l WHERE n <= 20)
SELECT id, n AS line_no, CASE WHEN used <= 1500 THEN line ELSE substr(line, 1, 1500) || ' …[line cut at 1500 chars of ' || length(line) || ']' END AS line FROM u WHERE used <= 1500 OR n = 1""")
def bounded_lines(spark, sf):
    """What is shown of each text within a budget; the first line always."""
    return toolfolds.bounded(folding.numbered(S.table(spark, sf, "documents"), "doc_id", "text"), 20, 1500)


@query(r"""WITH p AS (SELECT doc_id AS event_id, text, lang, doc_id % 5 = 0 AS interrupted, doc_id % 7 AS c FROM documents), t AS (SELECT * FROM p WHERE lang <> 'es' AND NOT interrupted AND c <> 3 AND length(text) > 3000)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, event_id * 2 + event_id % 2 AS fold_id, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines, length(text) AS chars, sha1(text) AS body, 'Bash ' || CASE WHEN event_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END || ': make ' || c AS title FROM t""")
def tool_folds(spark, sf):
    """Payloads of tools; long outputs are folded, those of interrupted calls, other tools and the tool itself are not."""
    docs = S.table(spark, sf, "documents")
    k = F.col("doc_id")
    command = F.when(k % 7 == 3, "cd x; loom unfold F3").otherwise(F.concat(F.lit("make "), (k % 7).cast("string")))
    response = F.struct(F.when(k % 2 == 0, F.col("text")).otherwise("").alias("stdout"), F.when(k % 2 == 1, F.col("text")).alias("stderr"), (k % 5 == 0).alias("interrupted"))
    payload = F.to_json(F.struct(F.when(F.col("lang") == "es", "Read").otherwise("Bash").alias("tool_name"), F.struct(command.alias("command")).alias("tool_input"), response.alias("tool_response")))
    found = toolfolds.tool_folds(docs.select(k.alias("event_id"), F.col("source").alias("session_id"), payload.alias("payload")), over=3000)
    return found.select("event_id", "stream", "fold_id", "lines", "chars", F.sha1("body").alias("body"), "title")


@query("""WITH f AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'tool' WHEN doc_id % 3 = 1 THEN 'span' ELSE 'agent' END AS kind, n_chars AS created_at, text FROM documents)
SELECT id, kind, rank FROM (SELECT id, kind, row_number() OVER (ORDER BY kind = 'tool', created_at DESC, id DESC) AS rank FROM f) WHERE rank <= 8""")
def recent_folds(spark, sf):
    """The newest folds, those of tools last."""
    from pyspark.sql import Window

    k = F.col("doc_id")
    folds = S.table(spark, sf, "documents").select(k.alias("id"), F.when(k % 3 == 0, "tool").when(k % 3 == 1, "span").otherwise("agent").alias("kind"), F.col("n_chars").alias("created_at"))
    eight = toolfolds.recent(folds, 8)
    place = F.row_number().over(Window.orderBy(F.col("kind") == "tool", F.desc("created_at"), F.desc("id"))).cast("long")  # of eight rows
    return eight.select("id", "kind", place.alias("rank"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'tool' ELSE lang END AS kind, count(*) AS n, CAST(coalesce(sum(length(text)) FILTER (doc_id % 3 = 0), 0) AS BIGINT) AS chars FROM documents GROUP BY 1")
def fold_stats(spark, sf):
    """A7."""
    return panels.fold_stats(S.table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, "tool").otherwise(F.col("lang")).alias("kind"), F.col("text").alias("body")))


# ----------------------------------------------------------------------- ranks
@query("""SELECT event_type, value AS p FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = round_even(0.95 * (n - 1), 0)""")
def eval_metrics(spark, sf):
    """The 95th percentile of each kind of event, by nearest rank, without a task for a whole kind."""
    return ranks.nearest_rank(S.table(spark, sf, "events"), "event_type", "value", 0.95)


@query("SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def median_price(spark, sf):
    """A19."""
    return ranks.median(S.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("WITH d AS (SELECT l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY 1) SELECT id, degree, (SELECT count(*) FROM d x WHERE x.degree < d.degree) / (SELECT count(*) FROM d) AS below FROM d")
def degree_rank(spark, sf):
    """How many edges a node has, and the share of nodes with fewer."""
    edges = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))
    found = ranks.degrees(edges.select(F.col("src").alias("id")), edges)
    return found.join(ranks.share_below(found, "id", "degree"), "id")


@query(f"""WITH {ASKED}, r AS (SELECT query_id, id FROM (SELECT doc_id AS id, {TERMS.format('text')} AS t FROM documents) d, (SELECT query_id, {TERMS.format('query')} AS q FROM asked) a WHERE len(q) >= 2 AND len(list_intersect(q, t)) >= 2 AND len(list_intersect(q, t)) >= 0.8 * len(q)),
b AS (WITH {_bm25_sql('documents', 'doc_id')} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits),
q AS (SELECT DISTINCT query_id FROM r), best AS (SELECT query_id, min(rank) AS rank FROM b JOIN r USING (query_id, id) GROUP BY 1)
SELECT 'recall_at_3' AS metric, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS value FROM q LEFT JOIN best USING (query_id)
UNION ALL SELECT 'mean_reciprocal_rank', round(avg(coalesce(1.0 / rank, 0.0)), 6) FROM q LEFT JOIN best USING (query_id)
UNION ALL SELECT 'abstain_rate', round(avg(CASE WHEN query_id IN (SELECT query_id FROM b) THEN 0.0 ELSE 1.0 END), 6) FROM asked""")
def retrieval_metrics(spark, sf):
    """How well ranked search finds the documents that share most terms with a query."""
    docs, asked = S.table(spark, sf, "documents"), _asked(spark, sf)
    hits = retrieval.bm25(docs, asked, "doc_id", "text")
    expected = store(retrieval.similar(docs.select(F.col("doc_id").alias("id"), "text"), asked, 2, 0.8).select("query_id", "id"), "expected")
    placed = store(evaluation.best_place(hits, expected), "placed")
    ranked = placed.where("rank is not null")
    each = {"recall_at_3": evaluation.recall_at(ranked, expected), "mean_reciprocal_rank": evaluation.reciprocal_rank(ranked, expected), "abstain_rate": evaluation.abstained(placed, asked)}
    rows = None
    for name, value in each.items():
        one = value.select(F.lit(name).alias("metric"), F.round("value", 6).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


# --------------------------------------------------------------------- reports
@query(f"""WITH {ITEMS}, s AS (SELECT user_id AS session_id, max(ts) AS last_seen_at FROM events GROUP BY 1), i AS (SELECT doc_id % 150 AS session_id, kind, CASE WHEN doc_id % 4 = 0 THEN 'auto' ELSE 'agent' END AS source FROM items), f AS (SELECT * FROM s ORDER BY last_seen_at DESC, session_id LIMIT 8)
SELECT f.session_id, count(i.kind) FILTER (i.kind <> 'handoff') AS items, coalesce(bool_or(i.kind = 'handoff' AND i.source <> 'auto'), false) AS handoff FROM f LEFT JOIN i USING (session_id) GROUP BY f.session_id""")
def session_panel(spark, sf):
    """The sessions last seen with their records."""
    sessions = S.table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_seen_at"))
    items = _items(spark, sf).select((F.col("doc_id") % 150).alias("session_id"), "kind", F.when(F.col("doc_id") % 4 == 0, "auto").otherwise("agent").alias("source"))
    return panels.session_panel(sessions, items).select("session_id", "items", "handoff")


@query("""WITH s AS (SELECT user_id AS session_id, user_id % 7 AS project, max(ts) AS seen FROM events GROUP BY 1, 2) SELECT project, arg_max(session_id, (seen, session_id)) AS session_id FROM s WHERE seen >= TIMESTAMP '2024-01-30' - INTERVAL 12 HOUR GROUP BY 1""")
def present_sessions(spark, sf):
    """The session of each project that was seen last, if that is not long ago."""
    sessions = S.table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id"), (F.col("user_id") % 7).alias("project")).agg(F.max("ts").alias("last_seen_at"))
    return panels.newest_session(sessions, F.lit("2024-01-30").cast(sessions.schema["last_seen_at"].dataType), ["project"])


@query(f"""WITH {ITEMS} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM part WHERE p_size <= 40) AS symbols, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS edges,
(SELECT count(*) FROM items WHERE kind <> 'handoff' AND {"((kind IN ('pin','note','handoff') AND status = 'active') OR (kind = 'decision' AND status IN ('accepted','rejected')) OR (kind IN ('task','error') AND status = 'open'))"}) AS items, (SELECT count(*) FROM pages) AS folds""")
def graph_counts(spark, sf):
    """A22."""
    nodes = S.table(spark, sf, "part").select(F.when(F.col("p_size") > 40, 1).alias("deleted_at"), F.lit("function").alias("kind"))
    edges = S.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).alias("valid_to"))
    return panels.graph_counts(S.table(spark, sf, "documents"), nodes, edges, _items(spark, sf), S.table(spark, sf, "pages"))


@query(f"""WITH {ITEMS}, h AS (SELECT *, doc_id % 5 = 0 AS auto FROM items WHERE kind = 'handoff' AND status = 'active') SELECT source AS project, arg_max(doc_id, (NOT auto, created_at, doc_id)) AS id FROM h GROUP BY 1""")
def present_handoffs(spark, sf):
    """The newest written handoff of each project, an automatic one where there is no other."""
    items = _items(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("project"), "kind", "status", "created_at", F.when(F.col("doc_id") % 5 == 0, "auto").otherwise("agent").alias("source"))
    return panels.present_handoff(items, "project").select("project", "id")


@query(r"""WITH n AS (SELECT p_partkey, [p_type, replace(p_brand, '#', '_'), 'x' || p_size] AS w, p_partkey % 6 AS k FROM part), t AS (SELECT p_partkey, CASE k WHEN 0 THEN w[1] || '::' || w[2] WHEN 1 THEN w[1] || '->' || w[2] || '?.' || w[3] WHEN 2 THEN w[1] || ' . ' || w[2] WHEN 3 THEN 'f(' || w[1] || ').' || w[2] WHEN 4 THEN '...' || w[1] ELSE repeat(w[1], 12) END AS raw FROM n),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(raw, '::|->|\?\.|\\', '.', 'g'), '\s+', '', 'g') AS t FROM t)
SELECT p_partkey, CASE WHEN length(t) > 80 THEN NULL WHEN contains(t, '(') THEN '.' || regexp_replace(string_split(t, '.')[-1], '[^\p{L}\p{N}_$]', '', 'g') WHEN starts_with(t, '...') THEN ltrim(t, '.') ELSE t END AS callee FROM c""")
def callee_names(spark, sf):
    """F26."""
    w, k = (F.col("p_type"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.concat(F.lit("x"), F.col("p_size").cast("string"))), F.col("p_partkey") % 6
    raw = F.when(k == 0, F.concat(w[0], F.lit("::"), w[1])).when(k == 1, F.concat(w[0], F.lit("->"), w[1], F.lit("?."), w[2])).when(k == 2, F.concat(w[0], F.lit(" . "), w[1])).when(k == 3, F.concat(F.lit("f("), w[0], F.lit(")."), w[1])).when(k == 4, F.concat(F.lit("..."), w[0])).otherwise(F.repeat(w[0], 12))
    return S.table(spark, sf, "part").select("p_partkey", T.callee_name(raw).alias("callee"))


@query("""SELECT doc_id, len(string_split(substr(text, 1, CAST(n_chars // 2 AS INTEGER)), chr(10))) AS line, CASE WHEN n_chars >= 1000000 THEN format('{:,.1f}', n_chars / 1000000.0) || ' MB' ELSE format('{:,.0f}', n_chars / 1000.0) || ' KB' END AS size, format('{:,}', n_chars) || CASE WHEN n_chars = 1 THEN ' char' ELSE ' chars' END AS said  FROM documents""")
def places_and_sizes(spark, sf):
    """The line in the middle of a text, and its size in words."""
    docs = S.table(spark, sf, "documents")
    return docs.select("doc_id", T.line_of(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).cast("long").alias("line"), T.size_text(F.col("n_chars")).alias("size"), T.counted(F.col("n_chars"), "char").alias("said"))
