"""Bases, files, models and agents read from the given trade tables.

A customer is a knowledge base, its orders are files in one folder per priority, a part is a
registered model, a supplier is an agent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.bindings.tables import documents, load
from tidemark.bindings import sql
from tidemark.operators import catalog, chunking

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def register(run):
        Q[name] = run
        if oracle:
            O[name] = oracle
        return run

    return register


_NODES = """kbs AS (SELECT c_custkey AS kb_id, c_name AS name, c_mktsegment AS config FROM customer),
nodes AS (
  SELECT 'f' || o_orderkey AS node_id, o_custkey AS kb_id, 'd' || o_custkey || '-' || left(o_orderpriority, 1) AS parent_id,
    'Order ' || o_orderkey AS name, 'file' AS type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'out_of_sync' ELSE 'failed' END AS status,
    CASE WHEN o_orderstatus = 'P' THEN 'broken' END AS error, 'old' AS config,
    CASE o_orderpriority WHEN '1-URGENT' THEN ' Text/Plain; charset=utf-8' WHEN '2-HIGH' THEN 'application/pdf' WHEN '3-MEDIUM' THEN 'IMAGE/PNG' WHEN '5-LOW' THEN 'video/mp4' END AS mime_type FROM orders
  UNION ALL
  SELECT DISTINCT 'd' || o_custkey || '-' || left(o_orderpriority, 1), o_custkey, NULL::VARCHAR, 'Folder ' || o_orderpriority, 'folder', NULL, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'd' || c_custkey || '-x', c_custkey, NULL, 'archive', 'folder', NULL, NULL, NULL, NULL FROM customer)"""


def kbs(spark, sf):
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("config")
    )


def nodes(spark, sf):
    orders = load(spark, sf, "orders")
    folder = F.concat(F.lit("d"), "o_custkey", F.lit("-"), F.left("o_orderpriority", F.lit(1)))
    none = F.lit(None).cast("string")
    mime = {"1-URGENT": " Text/Plain; charset=utf-8", "2-HIGH": "application/pdf", "3-MEDIUM": "IMAGE/PNG", "5-LOW": "video/mp4"}
    kind = F.lit(None).cast("string")
    for priority, name in mime.items():
        kind = F.when(F.col("o_orderpriority") == priority, name).otherwise(kind)
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "out_of_sync").otherwise("failed")
    files = orders.select(
        F.concat(F.lit("f"), "o_orderkey").alias("node_id"), F.col("o_custkey").alias("kb_id"), folder.alias("parent_id"),
        F.concat(F.lit("Order "), "o_orderkey").alias("name"), F.lit("file").alias("type"), status.alias("status"),
        F.when(F.col("o_orderstatus") == "P", "broken").alias("error"), F.lit("old").alias("config"), kind.alias("mime_type"),
    )

    def folders(df, node_id, kb_id, name):
        return df.select(
            node_id.alias("node_id"), kb_id.alias("kb_id"), none.alias("parent_id"), name.alias("name"),
            F.lit("folder").alias("type"), none.alias("status"), none.alias("error"), none.alias("config"), none.alias("mime_type"),
        )

    used = folders(orders.select("o_custkey", "o_orderpriority").distinct(), folder, F.col("o_custkey"), F.concat(F.lit("Folder "), "o_orderpriority"))
    spare = folders(load(spark, sf, "customer"), F.concat(F.lit("d"), "c_custkey", F.lit("-x")), F.col("c_custkey"), F.lit("archive"))
    return files.unionByName(used).unionByName(spare)


_JUNK = """entries AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name || '/' WHEN 1 THEN '__MACOSX/' || p_name
  WHEN 2 THEN p_type || '/.' || p_name WHEN 3 THEN p_name || '/Thumbs.DB' ELSE p_brand || '/' || p_name || '.txt' END AS name FROM part)"""


@query("junk_path_filter", f"""WITH {_JUNK} SELECT p_partkey, name FROM entries WHERE NOT (ends_with(name, '/')
  OR len(list_filter(string_split(name, '/'), lambda x: starts_with(x, '.') OR starts_with(x, '__MACOSX'))) > 0
  OR lower(string_split(name, '/')[-1]) IN ('thumbs.db', 'desktop.ini'))""")
def junk_path_filter(spark, sf):
    from tidemark.sources.files import is_junk_path

    size, name = F.col("p_size") % 6, F.col("p_name")
    path = (
        F.when(size == 0, F.concat(name, F.lit("/"))).when(size == 1, F.concat(F.lit("__MACOSX/"), name))
        .when(size == 2, F.concat("p_type", F.lit("/."), name)).when(size == 3, F.concat(name, F.lit("/Thumbs.DB")))
        .otherwise(F.concat("p_brand", F.lit("/"), name, F.lit(".txt")))
    )
    return load(spark, sf, "part").select("p_partkey", path.alias("name")).where(~is_junk_path(F.col("name")))


@query("mime_routing", f"""WITH {_NODES}, plain AS (SELECT *, lower(trim(string_split(mime_type, ';')[1])) AS m FROM nodes WHERE type = 'file'),
kinds AS (SELECT *, CASE WHEN m LIKE 'text/%' THEN 'text' WHEN m = 'application/pdf' THEN 'pdf' WHEN m = 'image/png' THEN 'image' END AS kind FROM plain)
SELECT node_id, kind, CASE WHEN kind IS NULL THEN 'failed' ELSE status END AS status,
  CASE WHEN kind IS NULL THEN 'Unsupported file type: ' || coalesce(mime_type, 'None') END AS error FROM kinds""")
def mime_routing(spark, sf):
    return catalog.route_files(nodes(spark, sf).where("type = 'file'")).select("node_id", "kind", "status", "error")


@query("page_text_merge", """SELECT doc_id, i - 1 AS page_index, CASE WHEN length(line) < 60 THEN o.text ELSE line END AS markdown
FROM (SELECT doc_id, i, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) LEFT JOIN (
    SELECT conv_id, turn, text FROM conversations) o ON o.conv_id = doc_id AND o.turn = i - 1""")
def page_text_merge(spark, sf):
    """Short lines stand for scanned pages; a conversation's turns for what was read from them."""
    from tidemark.bindings.tables import pages
    from tidemark.sources.files import merge_page_text

    lines = pages(spark, sf).withColumn("markdown", F.when(F.length("markdown") >= 60, F.col("markdown")).otherwise("  "))
    read = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), F.col("text").alias("ocr_text")
    )
    return merge_page_text(lines, read).select("doc_id", F.col("page_index").cast("long"), "markdown")


@query("paged_listing", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def paged_listing(spark, sf):
    rows = load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return catalog.page_of(rows, (F.desc("o_totalprice"), F.asc("o_orderkey")), page=3, size=50)


@query("listing_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def listing_total(spark, sf):
    return catalog.total_of(load(spark, sf, "orders").where("o_orderstatus = 'F'"))


@query("kb_file_counts", f"WITH {_NODES} SELECT kb_id, kbs.name, count(n.kb_id) AS file_count FROM kbs LEFT JOIN (SELECT kb_id FROM nodes WHERE type = 'file') n USING (kb_id) GROUP BY kb_id, kbs.name")
def kb_file_counts(spark, sf):
    return catalog.file_counts(kbs(spark, sf), nodes(spark, sf)).select("kb_id", "name", "file_count")


@query("node_listing", f"WITH {_NODES} SELECT kb_id, parent_id, node_id, name, type FROM nodes")
def node_listing(spark, sf):
    return catalog.list_all_folders(nodes(spark, sf)).select("kb_id", "parent_id", "node_id", "name", "type")


@query("deletable_folders", f"WITH {_NODES} SELECT node_id FROM nodes f WHERE type = 'folder' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = f.node_id)")
def deletable_folders(spark, sf):
    return catalog.deletable_folders(nodes(spark, sf)).select("node_id")


@query("out_of_sync_nodes", f"""WITH {_NODES} SELECT node_id, CASE WHEN status = 'completed' AND config_changed THEN 'out_of_sync' ELSE status END AS status
FROM nodes JOIN (SELECT kb_id, kbs.config = 'BUILDING' AS config_changed FROM kbs) USING (kb_id)""")
def out_of_sync_nodes(spark, sf):
    changed = kbs(spark, sf).where("config = 'BUILDING'")
    return catalog.mark_out_of_sync(nodes(spark, sf), changed).select("node_id", "status")


@query("resync_worklist", f"WITH {_NODES} SELECT node_id, kbs.config, 'processing' AS status, NULL::VARCHAR AS error FROM nodes JOIN kbs USING (kb_id) WHERE type = 'file' AND status = 'out_of_sync'")
def resync_worklist(spark, sf):
    return catalog.resync(nodes(spark, sf), kbs(spark, sf)).select("node_id", "config", "status", "error")


@query("cascade_delete", f"""WITH {_NODES}, gone AS (SELECT c_custkey AS kb_id FROM customer WHERE c_acctbal < 0)
SELECT 'nodes' AS kept_in, node_id AS id FROM nodes WHERE kb_id NOT IN (SELECT kb_id FROM gone)
UNION ALL SELECT 'kbs', kb_id::VARCHAR FROM kbs WHERE kb_id NOT IN (SELECT kb_id FROM gone)""")
def cascade_delete(spark, sf):
    gone = load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("kb_id"))
    kept = catalog.cascade_delete({"nodes": nodes(spark, sf), "kbs": kbs(spark, sf)}, gone, "kb_id")
    return kept["nodes"].select(F.lit("nodes").alias("kept_in"), F.col("node_id").alias("id")).unionByName(
        kept["kbs"].select(F.lit("kbs").alias("kept_in"), F.col("kb_id").cast("string").alias("id"))
    )


_MODELS = """models AS (SELECT p_partkey AS model_id, p_brand AS provider, p_name AS name,
  (['openai', 'tei', 'cohere', 'google_genai', 'other'])[p_size % 5 + 1] AS schema,
  CASE p_type WHEN 'STANDARD' THEN 'decoder' WHEN 'ECONOMY' THEN 'bi-encoder' WHEN 'MEDIUM' THEN 'cross-encoder' ELSE 'late-interaction' END AS capability FROM part)"""


def models(spark, sf):
    schema = F.element_at(F.array(*map(F.lit, (*catalog.SERVED, "other"))), (F.col("p_size") % 5 + 1).cast("int"))
    kind = (
        F.when(F.col("p_type") == "STANDARD", "decoder").when(F.col("p_type") == "ECONOMY", "bi-encoder")
        .when(F.col("p_type") == "MEDIUM", "cross-encoder").otherwise("late-interaction")
    )
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("provider"), F.col("p_name").alias("name"),
        schema.alias("schema"), kind.alias("capability"),
    )


@query("invalid_models", f"""WITH {_MODELS} SELECT model_id, schema, capability FROM models WHERE (schema, capability) NOT IN (
  ('openai', 'bi-encoder'), ('openai', 'decoder'), ('tei', 'bi-encoder'), ('tei', 'cross-encoder'), ('tei', 'late-interaction'),
  ('cohere', 'cross-encoder'), ('google_genai', 'bi-encoder'), ('google_genai', 'decoder'))""")
def invalid_models(spark, sf):
    return catalog.invalid_models(models(spark, sf)).select("model_id", "schema", "capability")


@query("duplicate_keys", f"WITH {_MODELS} SELECT provider, name, capability, count(*) AS rows FROM models GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return catalog.duplicate_keys(models(spark, sf), ["provider", "name", "capability"])


@query("dataset_with_model", f"""WITH {_MODELS} SELECT l_orderkey, l_linenumber, l_partkey AS model_id, m.name AS model_name
FROM lineitem LEFT JOIN (SELECT * FROM models WHERE capability <> 'decoder') m ON m.model_id = l_partkey""")
def dataset_with_model(spark, sf):
    """Decoders are taken as deleted, so their datasets keep no name."""
    sets = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("model_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("dataset_id"),
    )
    named = catalog.with_model_name(sets, models(spark, sf).where("capability <> 'decoder'"))
    return named.select("l_orderkey", "l_linenumber", "model_id", "model_name")


@query("dangling_refs", """WITH there AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000), owners AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT l_orderkey, l_linenumber, t.s_suppkey::VARCHAR AS l_suppkey FROM lineitem LEFT JOIN there t ON t.s_suppkey = l_suppkey
WHERE l_orderkey IN (SELECT o_orderkey FROM owners)""")
def dangling_refs(spark, sf):
    """Lines keep no supplier that is gone, and go with an order that is gone."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    there = load(spark, sf, "supplier").where("s_acctbal >= 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    owners = load(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = catalog.drop_dangling(catalog.null_dangling(lines, "l_suppkey", there), "l_orderkey", owners)
    return kept.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string"))


@query("file_chunks", f"""WITH {sql.PARENTS} SELECT seq, content FROM parents WHERE doc_id = (SELECT min(doc_id) FROM labels WHERE toxic = 1)""")
def file_chunks(spark, sf):
    opened = load(spark, sf, "labels").where("toxic = 1").agg(F.min("doc_id")).head()[0]
    return catalog.file_chunks(chunking.chunk_fixed(documents(spark, sf)), opened).select(F.col("seq").cast("long"), "content")


_AGENTS = """tools AS (SELECT l_suppkey, list({'name': 'tool-' || l_linenumber, 'enabled': on_} ORDER BY l_linenumber) AS tools
  FROM (SELECT l_suppkey, l_linenumber, count(*) % 2 = 0 AS on_ FROM lineitem GROUP BY 1, 2) GROUP BY 1),
agents AS (SELECT s_suppkey AS agent_id, s_name AS name, 'about ' || s_name AS description,
  (['none', 'auto', 'manual'])[s_nationkey % 3 + 1] AS mode, coalesce(tools, []) AS tools,
  [{'target_id': s_suppkey + 1, 'description': ''}, {'target_id': s_suppkey, 'description': 'me'}, {'target_id': s_suppkey * 2, 'description': 'twice'}] AS targets
  FROM supplier LEFT JOIN tools ON l_suppkey = s_suppkey)"""


def agents(spark, sf):
    """An agent's tools are the up to seven line numbers its deliveries have."""
    per_line = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg((F.count("*") % 2 == 0).alias("enabled"))
    tool = F.struct(F.concat(F.lit("tool-"), "l_linenumber").alias("name"), "enabled")
    tools = per_line.groupBy(F.col("l_suppkey").alias("agent_id")).agg(F.array_sort(F.collect_list(tool)).alias("tools"))
    key = F.col("s_suppkey")
    target = lambda k, d: F.struct(k.alias("target_id"), F.lit(d).alias("description"))
    mode = F.element_at(F.array(*map(F.lit, ("none", "auto", "manual"))), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return (
        load(spark, sf, "supplier").select(
            key.alias("agent_id"), F.col("s_name").alias("name"), F.concat(F.lit("about "), "s_name").alias("description"),
            mode.alias("mode"), F.array(target(key + 1, ""), target(key, "me"), target(key * 2, "twice")).alias("targets"),
        )
        .join(tools, "agent_id", "left")
        .withColumn("tools", F.coalesce("tools", F.array().cast("array<struct<name:string,enabled:boolean>>")))
    )


@query("agent_summary", f"""WITH {_AGENTS} SELECT agent_id, name, mode AS handoff_mode, len(list_filter(tools, lambda t: t.enabled)) AS enabled_tool_count, len(targets) AS handoff_count FROM agents""")
def agent_summary(spark, sf):
    made = catalog.agent_summary(agents(spark, sf))
    return made.withColumns({c: F.col(c).cast("long") for c in ("enabled_tool_count", "handoff_count")})


_EDGES = f"""WITH {_AGENTS}, listed AS (SELECT agent_id, t.target_id, t.description AS own FROM (SELECT agent_id, unnest(targets) AS t FROM agents WHERE mode = 'manual')),
manual AS (SELECT l.agent_id, l.target_id, CASE WHEN l.own = '' THEN a.description ELSE l.own END AS description
  FROM listed l JOIN agents a ON a.agent_id = l.target_id WHERE l.target_id <> l.agent_id)"""


@query("handoff_edges", f"{_EDGES} SELECT agent_id, target_id::VARCHAR AS target_id, description FROM manual UNION ALL SELECT agent_id, NULL, NULL FROM agents WHERE mode = 'auto'")
def handoff_edges(spark, sf):
    return catalog.handoff_edges(agents(spark, sf)).withColumn("target_id", F.col("target_id").cast("string"))


@query("allowed_transfers", f"""{_EDGES}, asked AS (SELECT l_orderkey, l_linenumber, l_suppkey AS agent_id, l_suppkey + l_linenumber - 1 AS target_id FROM lineitem)
SELECT l_orderkey, l_linenumber, x.agent_id, x.target_id, t.description FROM asked x JOIN agents a USING (agent_id) JOIN agents t ON t.agent_id = x.target_id
WHERE a.mode = 'auto' AND x.agent_id <> x.target_id
UNION ALL SELECT l_orderkey, l_linenumber, x.agent_id, x.target_id, m.description FROM asked x JOIN manual m USING (agent_id, target_id)""")
def allowed_transfers(spark, sf):
    asked = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("agent_id"),
        (F.col("l_suppkey") + F.col("l_linenumber") - 1).alias("target_id"),
    )
    return catalog.allowed_transfers(asked, agents(spark, sf)).select("l_orderkey", "l_linenumber", "agent_id", "target_id", "description")


@query("keyed_merge", """WITH stored AS (SELECT l_suppkey AS agent_id, 'tool-' || l_linenumber AS name, max(l_orderkey)::VARCHAR AS token FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
incoming AS (SELECT l_suppkey AS agent_id, 'tool-' || l_linenumber AS name, max(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN l_orderkey END)::VARCHAR AS token, count(*) % 3 > 0 AS needs FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT i.agent_id, i.name, CASE WHEN i.needs THEN coalesce(i.token, s.token) END AS token FROM incoming i LEFT JOIN stored s USING (agent_id, name)""")
def keyed_merge(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("name", F.concat(F.lit("tool-"), "l_linenumber")).withColumnRenamed("l_suppkey", "agent_id")
    stored = lines.where("l_returnflag = 'R'").groupBy("agent_id", "name").agg(F.max("l_orderkey").cast("string").alias("token"))
    sent = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), F.col("l_orderkey"))
    incoming = lines.where("l_returnflag <> 'N'").groupBy("agent_id", "name").agg(
        F.max(sent).cast("string").alias("token"), (F.count("*") % 3 > 0).alias("needs_secret")
    )
    return catalog.keyed_merge(incoming, stored, "agent_id", "name", "token").select("agent_id", "name", "token")


@query("exclusive_flag", "SELECT s_suppkey AS agent_id, s_suppkey = (SELECT max(s_suppkey) FROM supplier) AS is_entrypoint FROM supplier")
def exclusive_flag(spark, sf):
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("agent_id"))
    chosen = rows.agg(F.max("agent_id")).head()[0]
    return catalog.exclusive_flag(rows, "agent_id", chosen, "is_entrypoint")


@query("table_fingerprint", """SELECT 'orders' AS "table", count(*) AS rows, epoch_us(max(o_orderdate)) AS updated_us FROM orders
UNION ALL SELECT 'lineitem', count(*), epoch_us(max(l_shipdate)) FROM lineitem""")
def table_fingerprint(spark, sf):
    parts = [
        catalog.fingerprint(load(spark, sf, name).select(F.col(column).cast("timestamp").alias("updated_at")), name)
        for name, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    ]
    return parts[0].unionByName(parts[1]).select("table", "rows", F.unix_micros("updated_at").alias("updated_us"))
