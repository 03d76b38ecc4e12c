"""Register tables derived from the given tables, in SQL both engines run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "decision_ids": """
SELECT * FROM (VALUES (0,'Q1'),(1,'Q2'),(2,'Q3'),(3,'Q4'),(4,'S1'),(5,'S2'),(6,'S3'),(7,'S4'),(8,'S5'),(9,'S6'),(10,'D1'),(11,'D2'),(12,'D3'),(13,'D4'),(14,'G1'),(15,'G2'),(16,'G3'),(17,'G4'),(18,'G5'),(19,'R1'),(20,'R2'),(21,'R3'),(22,'R4'),(23,'M1'),(24,'M2'),(25,'M3'),(26,'M4')) AS t(idx, did)
""",
    "fx_decisions": """
SELECT 'p' || CAST(o_custkey % 16 AS STRING) AS project_id, 'r' || CAST(o_orderkey % 4 AS STRING) AS run_id, o_orderkey AS row_no, d.did AS decision_id,
 CASE WHEN d.idx % 3 = 0 THEN ' option A ' WHEN o_orderkey % 11 = 0 THEN 'TBD' WHEN o_orderkey % 13 = 0 THEN '!!!' ELSE o_orderpriority END AS chosen,
 CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'wider|narrower' WHEN 2 THEN 'wider|!!!' WHEN 3 THEN '||' ELSE 'TBD|n/a' END AS alternatives,
 CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'because ' || o_orderstatus END AS rationale,
 CASE WHEN o_orderkey % 17 = 0 THEN 'last week' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS decided_date,
 CASE WHEN o_orderkey % 19 = 0 THEN 'role=runner' ELSE 'model=M-' || CAST(o_custkey % 3 AS STRING) || '; harness=cli; run=r' || CAST(o_orderkey % 4 AS STRING) END AS decided_by
 FROM orders JOIN decision_ids d ON o_orderkey % 27 = d.idx
 WHERE NOT (o_custkey % 16 = 3 AND d.idx IN (9, 20))
""",
    "fx_sources": """
SELECT 'p' || CAST(s_suppkey % 16 AS STRING) AS project_id, s_suppkey AS row_no, 's' || CAST(s_suppkey AS STRING) AS source_id,
 s_name AS title, CASE WHEN s_suppkey % 10 = 0 THEN '***' ELSE 'pub' || CAST(s_nationkey AS STRING) END AS publisher,
 CAST(s_suppkey % 6 AS STRING) AS motive_tier,
 CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'registered_not_retrieved' WHEN 1 THEN 'cited_not_held' ELSE 'retrieved' END AS retrieval_status,
 CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'http://:80' WHEN 1 THEN 'https://h.example:99999/x' WHEN 2 THEN 'https://%GG/' ELSE 'https://h' || CAST(s_suppkey AS STRING) || '.example/a' END AS url,
 CASE WHEN s_suppkey = 1 THEN 's2' WHEN s_suppkey = 2 THEN 's1' WHEN s_suppkey % 3 = 0 THEN 's' || CAST(CAST(floor(s_suppkey / 3.0) AS BIGINT) AS STRING) WHEN s_suppkey % 29 = 0 THEN 's999999' ELSE '' END AS derived_from,
 's' || CAST(CAST(floor(s_suppkey / 9.0) AS BIGINT) + 1 AS STRING) AS second_source_id,
 CASE WHEN s_suppkey % 8 = 0 THEN 'sometime' ELSE CAST(1994 + s_suppkey % 8 AS STRING) || '-06-15' END AS accessed_date, CASE WHEN s_suppkey % 12 = 0 THEN '' ELSE 'tried three routes' END AS notes FROM supplier
""",
    "fx_evidence": """
SELECT o_orderkey AS draft_id, CAST(1 AS INT) AS source_ord, CAST(o_custkey % 5 + 1 AS INT) AS tier, 'Filing for ' || c_name || ': total ' || CAST(CAST(floor(o_totalprice) AS BIGINT) + (CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS STRING) || ' dollars' || (CASE WHEN o_orderkey % 3 = 0 THEN '. There is no evidence that Acme Power Grid agreed.' ELSE '.' END) AS text FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT o_orderkey, CAST(2 AS INT), CAST(5 AS INT), 'Promotional note: ' || CAST(o_orderkey % 500 AS STRING) || ' MW planned.' FROM orders
""",
    "fx_claims": """
SELECT 'c' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS claim_id, l_orderkey AS row_no,
 'Order ' || CAST(l_orderkey AS STRING) || ' ships ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' units.' AS claim_text,
 CASE WHEN l_suppkey % 23 = 0 THEN 'sX' ELSE 's' || CAST(l_suppkey AS STRING) END AS source_id,
 CASE l_linestatus WHEN 'O' THEN 'reported' ELSE 'guessed' END AS claim_basis,
 CASE l_returnflag WHEN 'R' THEN 'yes' ELSE 'no' END AS material_to_conclusion,
 CASE WHEN l_partkey % 9 = 0 THEN 'n/a' ELSE 'as filed' END AS uncertainty,
 CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 's' || CAST(l_partkey % 120 AS STRING) END AS corroborating_source_id FROM lineitem
""",
    "fx_probes": """
SELECT 'p' || CAST(user_id % 16 AS STRING) AS project_id, event_id AS row_no, 'F' || CAST(event_id AS STRING) AS probe_id,
 CASE event_type WHEN 'view' THEN 'source_exists' WHEN 'click' THEN 'bytes_retrievable' WHEN 'purchase' THEN 'period_and_retention' WHEN 'signup' THEN 'derivation_independence' ELSE 'population_coverage' END AS question,
 CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'unavailable' WHEN 1 THEN 'restricted' WHEN 2 THEN 'unknown' WHEN 3 THEN '37 outages' ELSE 'available' END AS result,
 CAST(CAST(ts AS DATE) AS STRING) AS access_date, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'tried 3 routes, saw 1,204' END AS notes FROM events
""",
    "fx_drafts": """
SELECT o_orderkey AS draft_id, o_orderkey AS doc_no, 'Customer ' || c_name || ' reported ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' dollars. Likely Acme Power Grid may reach ' || CAST(o_orderkey % 500 AS STRING) || ' MW in ' || substr(CAST(o_orderdate AS STRING),1,4) || '.' AS text FROM orders JOIN customer ON o_custkey=c_custkey
""",
}


# Drafts that attribute, and evidence that agrees, denies, is silent or cuts a denial at its edge.
VIEWS["fx_said"] = """
SELECT o_orderkey AS draft_id, 'Acme Power Grid announced ' || CAST(o_orderkey % 500 AS STRING) || ' MW. The plan was covered by Promotional Desk, per Filing Office. Later ' || c_mktsegment || ' Board''s report agreed. Acme Power Grid said it again.' AS text FROM orders JOIN customer ON o_custkey = c_custkey
"""
VIEWS["fx_heard"] = """
SELECT o_orderkey AS draft_id, CAST(1 AS INT) AS source_ord, 'Filing for ' || c_name || (CASE WHEN o_orderkey % 3 = 0 THEN '. There is no evidence that Acme Power Grid agreed.' WHEN o_orderkey % 3 = 1 THEN '. The customer did not' ELSE '.' END) AS text FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT o_orderkey, CAST(2 AS INT), CASE WHEN o_orderkey % 4 = 0 THEN 'acme power grid wrote ' || o_orderstatus ELSE 'Promotional desk: ' || CAST(o_orderkey % 500 AS STRING) || ' MW planned.' END FROM orders
 UNION ALL SELECT o_orderkey, CAST(3 AS INT), CASE WHEN o_orderkey % 5 = 0 THEN 'The filing office and the promotional desk rest here for a long while, with nothing said against either of them at all. ' || c_mktsegment || ' BOARD' ELSE 'isn''t known' END FROM orders JOIN customer ON o_custkey = c_custkey
"""
VIEWS["fx_wide_decisions"] = """
SELECT 'c' || CAST(o_custkey AS STRING) AS project_id, o_orderkey AS row_no, d.did AS decision_id,
 CASE WHEN d.idx % 3 = 0 THEN ' option A ' ELSE o_orderpriority END AS chosen, 'wider|narrower' AS alternatives,
 'because ' || o_orderstatus AS rationale, CAST(CAST(o_orderdate AS DATE) AS STRING) AS decided_date,
 'model=M-' || CAST(o_custkey % 3 AS STRING) || '; harness=cli; run=r' || CAST(o_orderkey % 4 AS STRING) AS decided_by
 FROM orders JOIN decision_ids d ON o_orderkey % 27 = d.idx
"""
VIEWS["fx_reports"] = """
SELECT 'p' || CAST(o_custkey % 16 AS STRING) AS project_id, 'r' || CAST(o_orderkey AS STRING) || '.md' AS name,
 '# Order ' || CAST(o_orderkey AS STRING) || chr(10) || chr(10) || 'Total ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' in `9999`, see https://x.example/8888.' || chr(10)
 || (CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '## Falsifier' WHEN 1 THEN 'A low total would prove it all wrong' WHEN 2 THEN 'that KILLED the claim' ELSE 'nothing' END) || chr(10)
 || (CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '## 3.1 Verification of it' WHEN 1 THEN '  **Verification: traced' WHEN 2 THEN 'see verification' WHEN 3 THEN '#Verifications' ELSE '### VERIFICATION' END) || chr(10)
 || (CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'COI: none' WHEN 1 THEN 'coins' ELSE 'Conflict of Interest' END) || chr(10)
 || (CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '## Negative and null results' WHEN 1 THEN 'Limitations :' WHEN 2 THEN '# Retained limits' WHEN 3 THEN '**negative result:' WHEN 4 THEN '# Unlimitations' WHEN 5 THEN 'caveats' ELSE '## Caveats' END) || chr(10)
 || (CASE WHEN o_orderkey % 2 = 0 THEN 'No baseline. ' ELSE '' END) || (CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'Some dropped off.' WHEN 1 THEN 'Survivors, censored' WHEN 2 THEN 'delisted' WHEN 3 THEN 'departing' ELSE 'churn and selection bias' END) AS text FROM orders
"""
VIEWS["fx_project_claims"] = """
SELECT 'p' || CAST(o_custkey % 16 AS STRING) AS project_id, 'Order ' || CAST(l_orderkey AS STRING) || ' ships ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' units' AS claim_text,
 CASE WHEN l_linenumber % 3 = 0 THEN 'near ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.5,' ELSE '' END AS uncertainty FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
VIEWS["fx_bindings"] = """
SELECT 'c' || CAST(c_custkey AS STRING) AS project_id, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'v0.1' WHEN 1 THEN ' V0.2 ' WHEN 2 THEN 'v0.3' WHEN 3 THEN 'v8' END AS requested,
 CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '{bad' WHEN 2 THEN '[1]' WHEN 3 THEN '{"manifest_type": "other", "contract": "v0.2"}'
 ELSE '{"manifest_type": "project_binding", "schema_version": "1.' || CAST(c_custkey % 2 AS STRING) || '", "bound_date": "' || (CASE WHEN c_custkey % 9 = 0 THEN 'soon' ELSE '2026-08-14' END) || '", "contract": "'
 || (CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'v0.1' WHEN 1 THEN 'v9.9' WHEN 2 THEN ' V0.3' ELSE 'v0.2' END) || '", "instruments": {"gate": {"file": "' || (CASE WHEN c_custkey % 8 = 0 THEN 'other' ELSE 'gate.bin' END)
 || '", "version": "' || (CASE WHEN c_custkey % 10 = 0 THEN 'v7' WHEN c_custkey % 5 = 0 THEN 'v0' WHEN c_custkey % 5 = 2 THEN 'v0.3' ELSE 'v0.2' END) || '", "sha256": "' || (CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN repeat('ab', 32) WHEN 1 THEN repeat('cd', 32) WHEN 2 THEN repeat('AB', 32) ELSE repeat('ef', 32) END)
 || '"}' || (CASE WHEN c_custkey % 11 = 0 THEN ', "notes": 3' ELSE ', "notes": {"file": "notes.md", "version": "v0.2", "sha256": 5}' END) || '}}' END AS value FROM customer
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived register (or a given table) as a DataFrame over the Parquet files of ``sf_dir``."""
    for table in TABLES:
        if table == name or (name in VIEWS and table in VIEWS[name]):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            rows.createOrReplaceTempView(table)
    if name not in VIEWS:
        return spark.table(name)
    if "decision_ids" in VIEWS[name] and name != "decision_ids":
        spark.sql(VIEWS["decision_ids"]).createOrReplaceTempView("decision_ids")
    return spark.sql(VIEWS[name])


def with_views(names: list[str], body: str) -> str:
    """SQL text: the named derived registers as WITH entries in front of ``body``."""
    wanted = [n for n in VIEWS if n in names or (n == "decision_ids" and any("decisions" in x for x in names))]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + body
