"""Portable SQL that gives every operator an input of the right shape from the base tables.

Each text runs unchanged on Spark and on DuckDB; ``Tables`` turns them into DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lumenlog.session import widen

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

ADAPTERS: dict[str, str] = {}

# Views only the SQL twins use (the Spark side computes the same with the operators).
ORACLE_VIEWS: dict[str, str] = {}

ADAPTERS["logs"] = r"""
SELECT CAST(event_id AS STRING) AS log_id,
       'ins-' || CAST(CASE WHEN event_id % 50 = 1 THEN event_id - 1 ELSE event_id END AS STRING) AS insert_id,
       CASE WHEN event_id % 211 = 0 THEN NULL ELSE ts END AS event_timestamp,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + (user_id % 7) * INTERVAL '1' SECOND END AS receive_timestamp,
       ts + INTERVAL '2' MINUTE AS etl_timestamp,
       CAST(ts AS DATE) AS log_date,
       CASE WHEN event_id % 307 = 0 THEN 'WARN'
            WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL'
            WHEN event_type = 'error' THEN 'ERROR'
            WHEN event_type = 'purchase' AND value >= 100 THEN 'WARNING'
            WHEN event_type = 'signup' THEN 'NOTICE'
            WHEN event_type = 'view' THEN 'DEBUG'
            ELSE 'INFO' END AS severity,
       CASE event_type WHEN 'click' THEN 'run_googleapis_com_requests'
            WHEN 'view' THEN 'run_googleapis_com_stdout'
            WHEN 'error' THEN 'run_googleapis_com_stderr'
            WHEN 'purchase' THEN 'cloudaudit_googleapis_com_activity'
            ELSE 'cloudbuild' END AS source_table,
       'logs_v1.' || event_type AS stream_id,
       CASE WHEN event_id % 101 = 0 THEN NULL
            ELSE 'svc-' || CAST(user_id % 5 AS STRING) ||
                 CASE user_id % 4 WHEN 0 THEN '-dev' WHEN 1 THEN '-staging' WHEN 2 THEN '-test' ELSE '' END
            END AS service_name,
       CASE WHEN event_id % 2 = 0 THEN 'cloud_run_revision' ELSE 'audited_resource' END AS resource_type,
       CASE WHEN event_id % 3 = 0 THEN NULL
            ELSE 'projects/p1/traces/' || md5(CAST(user_id AS STRING) || '-' || CAST(date_trunc('HOUR', ts) AS STRING))
            END AS trace_id,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE substr(md5(CAST(event_id AS STRING)), 1, 16) END AS span_id,
       CASE WHEN event_type = 'error' AND value < 50 THEN 'ValueError: bad value ' || CAST(CAST(floor(value) AS INT) AS STRING)
            WHEN event_type = 'error' THEN 'connection failed: host 10.0.' || CAST(user_id % 9 AS STRING) || '.' || CAST(event_id % 200 AS STRING)
            WHEN event_type = 'signup' THEN 'login user' || CAST(user_id AS STRING) || '@example.org token=' || substr(md5(CAST(event_id AS STRING)), 1, 8)
            WHEN event_type = 'purchase' THEN 'update config user_id=' || CAST(user_id AS STRING)
            WHEN event_type = 'view' THEN 'debug counter value ' || CAST(CAST(floor(value) AS INT) AS STRING)
            ELSE 'served request ' || CAST(event_id AS STRING) END AS message,
       CASE WHEN event_id % 97 = 0 THEN '{bad' WHEN event_id % 10 = 0 THEN '{}' ELSE props END AS json_payload
FROM events
"""

ADAPTERS["logs_rich"] = r"""
SELECT CAST(event_id AS STRING) AS log_id, ts AS event_timestamp, CAST(ts AS DATE) AS log_date,
       ts + INTERVAL '2' MINUTE AS etl_timestamp, event_type, user_id,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'NOTICE' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS severity,
       event_type = 'error' AS is_error, event_type = 'purchase' AS is_audit, event_type = 'click' AS is_request,
       'svc-' || CAST(user_id % 5 AS STRING) AS service_name,
       CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END END AS http_method,
       CASE WHEN event_type = 'click' THEN '/api/sessions/' || CAST(user_id % 7 AS STRING) END AS http_url,
       CASE WHEN event_type = 'click' THEN CASE WHEN value > 150 THEN 503 WHEN value > 100 THEN 404 ELSE 200 END END AS http_status,
       CASE WHEN event_type = 'click' THEN CAST(CAST(floor(value * 10) AS INT) AS STRING) || 's' END AS http_latency_text,
       CASE WHEN event_type = 'click' THEN CAST(floor(value * 10) AS DOUBLE) END AS http_latency_ms,
       '{"env":"' || CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN '' ELSE 'prod' END ||
         '","tenant_id":"t' || CAST(user_id % 4 AS STRING) || '","request_id":"r-' || CAST(event_id % 500 AS STRING) || '"}' AS labels,
       '{"tag":"g' || CAST(user_id % 3 AS STRING) || '","team":"core"}' AS user_labels,
       '{"project_id":"proj-' || CAST(user_id % 6 AS STRING) || '","region":"r' || CAST(user_id % 2 AS STRING) ||
         '","service_name":"' || CASE WHEN user_id % 8 = 0 THEN '' ELSE 'svc-' || CAST(user_id % 5 AS STRING) END || '"}' AS resource_labels,
       '{"message":"m' || CAST(event_id AS STRING) || '","level":"' || CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'nope' ELSE 'info' END ||
         '","session_id":"s' || CAST(user_id AS STRING) || '"}' AS json_payload,
       '{"serviceName":"store","methodName":"m.' || event_type || '","status":{"code":7,"message":"PERMISSION_DENIED"}}' AS audit_payload,
       md5(CAST(user_id AS STRING) || '-' || CAST(date_trunc('HOUR', ts) AS STRING)) AS trace_id,
       substr(md5(CAST(event_id AS STRING)), 1, 16) AS span_id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE substr(md5(CAST(event_id - 1 AS STRING)), 1, 16) END AS parent_span_id
FROM events
"""

ADAPTERS["billing"] = r"""
SELECT 'acct-' || CAST(l.l_suppkey % 3 AS STRING) AS billing_account_id,
       'id-' || CAST(l.l_partkey % 5 AS STRING) AS service_id,
       CASE l.l_partkey % 5 WHEN 0 THEN 'BigQuery' WHEN 1 THEN 'Compute Engine' WHEN 2 THEN 'Cloud Storage'
            WHEN 3 THEN 'Cloud Run' ELSE 'Cloud Functions' END AS service_name,
       'sku-' || CAST(l.l_partkey % 40 AS STRING) AS sku_id,
       CASE l.l_partkey % 5
            WHEN 1 THEN CASE l.l_partkey % 4 WHEN 0 THEN 'Preemptible n1-standard Core running in eu'
                 WHEN 1 THEN 'Spot e2-small Ram running in us' WHEN 2 THEN 'Disk n2-highmem running in asia' ELSE 'GPU hour' END
            WHEN 2 THEN CASE l.l_partkey % 4 WHEN 0 THEN 'Standard Storage' WHEN 1 THEN 'Nearline Operations'
                 WHEN 2 THEN 'Coldline Download' ELSE 'Archive Egress' END
            ELSE 'Usage ' || CAST(l.l_partkey % 40 AS STRING) END AS sku_description,
       'proj-' || CAST(l.l_suppkey % 8 AS STRING) AS project_id,
       CAST(l.l_shipdate AS DATE) AS usage_date, l.l_shipdate AS usage_start_time, l.l_shipdate + INTERVAL '1' HOUR AS usage_end_time,
       l.l_extendedprice * (1 - l.l_discount) / 1000 AS cost, 'USD' AS currency,
       l.l_quantity AS usage_amount, CASE WHEN l.l_partkey % 5 = 2 THEN 'byte-seconds' ELSE 'requests' END AS usage_unit,
       lower(n.n_name) AS location, r.r_name AS country, lower(n.n_name) || '-1' AS region,
       l.l_orderkey, l.l_linenumber
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

ADAPTERS["jobs"] = r"""
SELECT CAST(o_orderdate AS DATE) AS dt, 'job-' || CAST(o_orderkey AS STRING) AS job_id,
       'proj-' || CAST(o_custkey % 8 AS STRING) AS project_id, 'user-' || CAST(o_custkey % 20 AS STRING) AS user_name,
       CASE o_orderstatus WHEN 'F' THEN 'QUERY' WHEN 'O' THEN 'LOAD' ELSE 'COPY' END AS job_type,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS statement_type,
       CASE WHEN o_orderkey % 13 = 0 THEN 'RUNNING' ELSE 'DONE' END AS state,
       o_orderkey % 4 = 0 AS cache_hit,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) * 1000000 END AS total_bytes_billed,
       CAST(floor(o_totalprice) AS BIGINT) * 900000 AS total_bytes_processed,
       CAST(floor(o_totalprice) AS BIGINT) AS total_slot_ms,
       o_orderdate AS creation_time
FROM orders
"""

ADAPTERS["pricing"] = r"""
SELECT 'id-' || CAST(p_partkey % 5 AS STRING) AS service_id, 'sku-' || CAST(p_partkey % 40 AS STRING) AS sku_id,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'nation_' || CAST(p_partkey % 25 AS STRING) END AS pricing_location,
       'USD' AS currency_code, CAST(p_size AS STRING) AS units, CAST(p_partkey % 1000 AS BIGINT) * 1000000 AS nanos,
       TIMESTAMP '2001-01-01 00:00:00' + (p_partkey % 300) * INTERVAL '1' DAY AS effective_time,
       TIMESTAMP '2001-11-01 00:00:00' AS export_time, p_partkey
FROM part
"""

ADAPTERS["cud"] = r"""
SELECT 'acct-' || CAST(l_suppkey % 3 AS STRING) AS billing_account_id, 'proj-' || CAST(l_suppkey % 8 AS STRING) AS project_id,
       'id-' || CAST(l_partkey % 5 AS STRING) AS service_id, 'sku-' || CAST(l_partkey % 40 AS STRING) AS sku_id,
       'com-' || CAST(l_suppkey % 6 AS STRING) AS commitment_id,
       CASE WHEN l_orderkey % 5 = 0 THEN 'EXPIRED' ELSE 'ACTIVE' END AS commitment_status,
       CAST(l_shipdate AS DATE) AS usage_date, l_extendedprice / 1000 AS list_cost,
       l_extendedprice * l_discount / 1000 AS discount_amount, l_extendedprice * (1 - l_discount) / 1000 AS net_cost,
       l_quantity AS usage_amount, CAST((l_orderkey * 7) % 101 AS DOUBLE) AS coverage_percentage,
       CAST((l_partkey * 3) % 101 AS DOUBLE) AS commitment_utilization_percentage,
       DATE '2000-01-01' AS commitment_start_date, DATE '2002-12-31' AS commitment_end_date
FROM lineitem WHERE l_linenumber = 1
"""

ADAPTERS["workforce"] = r"""
SELECT CAST(o_orderdate AS DATE) AS attribution_date, 'mem-' || CAST(o_custkey % 30 AS STRING) AS member_id,
       'proj-' || CAST(o_custkey % 8 AS STRING) AS project_id, o_totalprice / 10000 AS total_attributed_cost
FROM orders
"""

ADAPTERS["dim_stage"] = r"""
SELECT CAST(c_custkey AS STRING) AS member_id, 1 AS snapshot, c_name AS display_name,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS manager_id, DATE '2024-01-01' AS fetched
FROM customer WHERE c_custkey % 7 <> 0
UNION ALL
SELECT CAST(c_custkey AS STRING), 2, CASE WHEN c_custkey % 10 = 0 THEN c_name || ' B' ELSE c_name END,
       CAST(c_nationkey AS STRING), DATE '2024-01-02'
FROM customer
"""

ADAPTERS["assets"] = r"""
SELECT TIMESTAMP '2024-01-30 00:00:00' AS fetched_at,
       CASE s_suppkey % 5 WHEN 0 THEN 'compute/Instance' WHEN 1 THEN 'storage/Bucket' WHEN 2 THEN 'run/Service'
            WHEN 3 THEN 'bigquery/Dataset' ELSE 'unknown' END AS asset_type,
       '{"name":"' || s_name || '","project":"proj-' || CAST(s_suppkey % 8 AS STRING) || '","state":"' ||
         CASE WHEN s_suppkey % 3 = 0 THEN 'RUNNING' ELSE 'STOPPED' END ||
         '","iamPolicy":{"bindings":[{"role":"viewer","members":["m' || CAST(s_nationkey AS STRING) ||
         '"]},{"role":"owner","members":["a","b"]}]},"labels":[{"key":"env","value":"prod"},{"key":"team","value":"t"}]}' AS payload
FROM supplier
"""

ADAPTERS["tool_inv"] = r"""
SELECT 'inv-' || CAST(event_id AS STRING) AS invocation_id, 's-' || CAST(user_id AS STRING) AS session_id,
       'u-' || CAST(user_id AS STRING) AS user_id,
       CASE event_type WHEN 'click' THEN 'search_logs_tool' WHEN 'view' THEN 'bq_query_tool' WHEN 'error' THEN 'trace_lookup_tool'
            WHEN 'purchase' THEN 'analyze_logs' ELSE 'runbook_search_tool' END AS tool_name,
       ts AS started_at, CAST(floor(value) AS BIGINT) AS duration_ms,
       CASE WHEN event_id % 9 = 0 THEN 'failure' WHEN event_id % 31 = 0 THEN 'running' ELSE 'success' END AS status,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) * 1000 END AS bytes_billed,
       CAST(event_id % 40 AS INT) AS limit_arg,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE md5(CAST(user_id AS STRING) || '-' || CAST(date_trunc('HOUR', ts) AS STRING)) END AS trace_id
FROM events
"""

ADAPTERS["etl_jobs"] = r"""
SELECT 'etl-' || CAST(event_id AS STRING) AS job_id, 'logs_v1.' || event_type AS stream_id, ts AS started_at,
       CASE WHEN event_id % 7 = 0 THEN 'FAILED' WHEN event_id % 11 = 0 THEN 'RUNNING' WHEN event_id % 13 = 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
       CAST(floor(value) AS BIGINT) AS total_loaded, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS error_count,
       CAST(event_id % 4 AS INT) AS retry_count, event_id % 5 = 0 AS priority, event_id AS seq
FROM events
"""

ADAPTERS["bench"] = r"""
SELECT 'run-' || CAST(event_id % 2 AS STRING) AS run_id, event_type AS scenario, value AS latency_ms,
       CASE WHEN event_id % 17 = 0 THEN 'timeout' ELSE NULL END AS error, ts AS started_at
FROM events
"""

ADAPTERS["chat"] = r"""
SELECT 'e-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS event_id, 's-' || CAST(conv_id AS STRING) AS session_id,
       'u-' || CAST(conv_id % 10 AS STRING) AS user_id, TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 100 + turn) * INTERVAL '1' MINUTE AS event_timestamp,
       CASE WHEN role = 'system' THEN 'tool_start' ELSE 'message_sent' END AS event_type, role, text AS content,
       CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) END AS total_tokens
FROM conversations
"""

ADAPTERS["embeddings_meta"] = r"""
SELECT doc_id, 'tenant-' || CAST(doc_id % 3 AS STRING) AS project_id, source AS source_type, md5(text) AS text_hash,
       TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 30) * INTERVAL '1' DAY AS created_at,
       CASE WHEN doc_id % 10 = 0 THEN 'failure' WHEN doc_id % 7 = 0 THEN 'duplicate' ELSE 'success' END AS status,
       CAST(n_chars % 400 AS BIGINT) AS processing_time_ms, 64 AS embedding_dim
FROM documents
"""

ADAPTERS["vec"] = r"""
SELECT vec_id, embedding, 'tenant-' || CAST(label % 3 AS STRING) AS project_id,
       CASE label % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity,
       'svc-' || CAST(label AS STRING) AS service_name, 'trace-' || CAST(vec_id % 25 AS STRING) AS trace_id,
       TIMESTAMP '2024-01-01 00:00:00' + (vec_id % 720) * INTERVAL '1' HOUR AS ts
FROM embeddings
"""
ADAPTERS["requests"] = r"""
SELECT log_id, event_timestamp, service_name, severity, http_method, http_url AS request_url,
       http_status AS status, http_latency_ms / 1000 AS latency_s, trace_id, span_id
FROM logs_rich WHERE is_request
"""

ADAPTERS["audit"] = r"""
SELECT log_id, event_timestamp, service_name, audit_payload,
       CASE WHEN CAST(log_id AS BIGINT) % 3 = 0 THEN 'PERMISSION_DENIED' ELSE 'OK' END AS status
FROM logs_rich WHERE is_audit
"""

# Flat image of the raw sink tables; `sink_kind` says which sinks a row belongs to.
ADAPTERS["raw_flat"] = r"""
SELECT event_type AS sink_kind, event_id,
       CASE WHEN event_id % 211 = 0 THEN NULL ELSE ts END AS ts,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + (user_id % 7) * INTERVAL '1' SECOND END AS receive_ts,
       CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 307 = 0 THEN 'WARN' WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL'
            WHEN event_type = 'view' THEN 'DEBUG' WHEN event_type = 'purchase' THEN 'NOTICE' ELSE 'INFO' END AS severity,
       CASE WHEN event_id % 59 = 0 THEN NULL
            ELSE 'ins-' || CAST(CASE WHEN event_id % 50 = 1 THEN event_id - 1 ELSE event_id END AS STRING) END AS insert_id,
       CASE WHEN event_id % 61 = 0 THEN NULL ELSE 'projects/p1/logs/' || event_type END AS log_name,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'projects/p1/traces/' || md5(CAST(user_id AS STRING)) END AS trace,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE substr(md5(CAST(event_id AS STRING)), 1, 16) END AS span_id,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 2 = 0 END AS trace_sampled,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'cloud_run_revision' END AS resource_type,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE 'svc-' || CAST(user_id % 5 AS STRING) END AS svc,
       CASE WHEN event_id % 2 = 0 THEN 'proj-' || CAST(user_id % 6 AS STRING) END AS project_id,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'build-' || CAST(user_id % 9 AS STRING) END AS build_id,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'job-' || CAST(user_id % 4 AS STRING) END AS job_id,
       CASE WHEN event_id % 19 = 0 THEN '' ELSE event_type || ' number ' || CAST(event_id AS STRING) END AS text_payload,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'msg ' || CAST(event_id AS STRING) END AS json_message,
       CASE WHEN event_id % 2 = 0 THEN 'GET' END AS http_method,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE '/api/items/' || CAST(user_id % 7 AS STRING) END AS http_url,
       CASE WHEN event_id % 31 = 0 THEN NULL ELSE 'm.' || event_type END AS method_name,
       CASE WHEN event_id % 37 = 0 THEN NULL ELSE 'store' END AS audit_service,
       event_id % 6 AS phase
FROM events
"""

ADAPTERS["messages"] = r"""
SELECT event_id, ts, event_type, user_id, value,
       '{"event_id":"e-' || CAST(event_id AS STRING) || '","event_type":"' ||
         CASE WHEN event_type = 'error' THEN 'tool_invocation' ELSE 'message_sent' END ||
         '","session_id":"s-' || CAST(user_id AS STRING) || '","severity":"' ||
         CASE WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END ||
         '","role":"user","content":"note ' || CAST(event_id AS STRING) || '"}' AS payload,
       CASE WHEN event_id % 5 = 0 THEN 'tool_invocation' END AS attribute_event_type
FROM events
"""

# Raw log records with their payloads as JSON texts.
ADAPTERS["records"] = r"""
SELECT CAST(event_id AS STRING) AS log_id, 'ins-' || CAST(event_id AS STRING) AS insert_id,
       ts AS event_timestamp, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + (user_id % 7) * INTERVAL '1' SECOND END AS receive_timestamp,
       ts + INTERVAL '2' MINUTE AS etl_timestamp, 'v1' AS etl_version,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'NOTICE' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS severity,
       'central' AS source_dataset,
       CASE event_type WHEN 'click' THEN 'run_googleapis_com_requests' WHEN 'view' THEN 'run_googleapis_com_stdout'
            WHEN 'error' THEN 'run_googleapis_com_stderr' WHEN 'purchase' THEN 'cloudaudit_googleapis_com_activity' ELSE 'cloudbuild' END AS source_table,
       'projects/p1/logs/' || event_type AS source_log_name,
       'logs_v1.' || event_type AS stream_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'cloud_run_revision' END AS resource_type,
       '{"project_id":"proj-' || CAST(user_id % 6 AS STRING) || '","region":"' || CASE WHEN user_id % 2 = 0 THEN '' ELSE 'r1' END || '","zone":"z' || CAST(user_id % 3 AS STRING) ||
         '","service_name":"' || CASE WHEN user_id % 8 = 0 THEN '' ELSE 'svc-' || CAST(user_id % 5 AS STRING) || CASE user_id % 4 WHEN 0 THEN '-dev' WHEN 1 THEN '_staging' WHEN 2 THEN '-test' ELSE '' END END ||
         '","job_name":"' || CASE WHEN user_id % 16 = 0 THEN 'job-7' ELSE '' END || '","revision_name":"rev-' || CAST(user_id % 3 AS STRING) || '"}' AS resource_labels,
       CASE WHEN event_id % 41 = 0 THEN '{bad' WHEN event_id % 43 = 0 THEN NULL
            ELSE '{"env":"' || CASE user_id % 3 WHEN 0 THEN 'dev' ELSE '' END || '","tenant_id":"t' || CAST(user_id % 4 AS STRING) ||
                 '","request_id":"' || CASE WHEN event_id % 6 = 0 THEN '' ELSE 'r-' || CAST(event_id % 500 AS STRING) END || '"}' END AS labels,
       '{"tag":"g' || CAST(user_id % 3 AS STRING) || '","team":"core"}' AS user_labels,
       CASE WHEN event_type = 'error' AND value < 50 THEN 'ValueError: bad value ' || CAST(CAST(floor(value) AS INT) AS STRING) || chr(10) || 'at line 3'
            WHEN event_type = 'error' THEN 'request failed: host 10.0.' || CAST(user_id % 9 AS STRING) || '.' || CAST(event_id % 200 AS STRING)
            WHEN event_type = 'signup' THEN 'login user' || CAST(user_id AS STRING) || '@example.org token=' || substr(md5(CAST(event_id AS STRING)), 1, 8)
            WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'debug counter ' || CAST(CAST(floor(value) AS INT) AS STRING)
            WHEN event_type = 'view' THEN '' END AS text_payload,
       CASE WHEN event_id % 10 = 0 THEN '{}' WHEN event_id % 9 = 0 THEN NULL
            WHEN event_type = 'view' THEN '{"message":"m' || CAST(event_id AS STRING) || ' user_id=' || CAST(user_id AS STRING) || '","level":"' || CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'nope' ELSE 'info' END || '"}'
            WHEN event_type = 'click' THEN '{"error":"E' || CAST(event_id % 7 AS STRING) || '","session_id":"s' || CAST(user_id AS STRING) || '","chat_id":"c' || CAST(user_id % 9 AS STRING) || '"}'
            END AS json_payload,
       CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN '{"methodName":"m.build","serviceName":"builder","status":{"code":3,"message":"BAD_ARGUMENT"}}' END AS proto_payload,
       CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN '{"serviceName":"store","methodName":"m.buy","status":{"code":7,"message":"PERMISSION_DENIED"},"requestMetadata":{"callerIp":"10.1.2.' || CAST(user_id % 200 AS STRING) || '","callerNetwork":"n1"},"authenticationInfo":{"principalEmail":"u' || CAST(user_id AS STRING) || '@example.org","principalSubject":"user"}}'
            WHEN event_type = 'purchase' THEN '{"methodName":"m.read"}' END AS audit_payload,
       CASE WHEN event_type = 'click' THEN '{"requestMethod":"' || CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END || '","requestUrl":"/api/sessions/' || CAST(user_id % 7 AS STRING) ||
            '","status":' || CASE WHEN value > 150 THEN '503' WHEN value > 100 THEN '404' ELSE '200' END || ',"userAgent":"ua-' || CAST(user_id % 3 AS STRING) || '","remoteIp":"192.168.0.' || CAST(user_id % 100 AS STRING) ||
            '","latency":' || CASE WHEN event_id % 5 = 0 THEN CAST(CAST(floor(value * 10) AS INT) AS STRING) WHEN event_id % 7 = 0 THEN '"xs"'
                 ELSE '"' || CAST(CAST(floor(value * 10) AS INT) AS STRING) || 's"' END || ',"requestSize":' || CAST(event_id % 900 AS STRING) || ',"responseSize":' || CAST(event_id % 5000 AS STRING) || '}' END AS http_request,
       CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'projects/p1/traces/' || md5(CAST(user_id AS STRING) || '-' || CAST(date_trunc('HOUR', ts) AS STRING)) ELSE md5(CAST(user_id AS STRING)) END AS trace,
       substr(md5(CAST(event_id AS STRING)), 1, 16) AS span_id, event_id % 2 = 0 AS trace_sampled,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE substr(md5(CAST(event_id - 1 AS STRING)), 1, 16) END AS parent_span_id,
       CASE WHEN event_id % 6 = 0 THEN '{"id":"op-' || CAST(event_id % 50 AS STRING) || '","producer":"p","first":true,"last":false}' END AS operation,
       CASE WHEN event_type = 'error' THEN '{"file":"app.py","line":' || CAST(event_id % 400 AS STRING) || ',"function":"run"}' END AS source_location
FROM events
"""

_FROM = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)", re.I)


def _referenced(sql: str) -> list[str]:
    """Adapters a text reads, innermost first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in _FROM.findall(text):
            text_of = ADAPTERS.get(name) or ORACLE_VIEWS.get(name)
            if text_of and name not in found:
                visit(text_of)
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_adapters(sql: str, extra: str = "") -> str:
    """Prefix ``sql`` with the adapter texts it reads, as common table expressions."""
    parts = [f"{name} AS ({(ADAPTERS.get(name) or ORACLE_VIEWS[name]).strip()})" for name in _referenced(sql)]
    if extra:
        parts.insert(0, extra)
    if not parts:
        return sql.strip()
    body = sql.strip()
    head = "WITH " + ",\n".join(parts)
    return f"{head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"


class Tables:
    """Base tables and adapter views of one data folder as lazy DataFrames; each is resolved once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def base(self, table: str) -> DataFrame:
        if table not in self._frames:
            self._frames[table] = self.spark.read.parquet(self.path(table))
        return self._frames[table]

    def replaced(self, **frames: DataFrame) -> Tables:
        """The same tables with some base tables laid out otherwise."""
        other = Tables(self.spark, self.sf_dir)
        other._frames = dict(frames)
        return other

    def spread(self, piece_bytes: int | None = None, **keys: str) -> Tables:
        """The same tables with some base tables widened by a key column, for work that is heavy per row."""
        return self.replaced(**{table: widen(self.base(table), key, piece_bytes=piece_bytes) for table, key in keys.items()})

    def sql(self, text: str) -> DataFrame:
        """Run a portable text over the adapters and base tables it names."""
        used = sorted({name for name in _FROM.findall(with_adapters(text)) if name in BASE_TABLES})
        for name in used:
            self.base(name).createOrReplaceTempView(f"lumenlog_{name}")
        tables = ",\n".join(f"{name} AS (SELECT * FROM lumenlog_{name})" for name in used)
        return self.spark.sql(with_adapters(text, extra=tables))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in BASE_TABLES:
            return self.base(name)
        if name in ADAPTERS:
            if name not in self._frames:
                self._frames[name] = self.sql(f"SELECT * FROM {name}")
            return self._frames[name]
        raise AttributeError(name)
