"""The code graph that the star-schema tables stand for: the same SQL text for Spark and DuckDB."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.pack import Pack
from codeloom.sources.shared import shared_dir

SYMBOLS = """
SELECT id,'repo' AS repository_id,project,file_path,name,qualified_name,kind,start_line,start_column,end_line,80 AS end_column,signature,language,module_id,CAST(NULL AS STRING) AS structural_identity FROM (
SELECT 'reg:'||lpad(CAST(r_regionkey AS STRING),3,'0') AS id, CAST(NULL AS STRING) AS project, 'geo/regions.ts' AS file_path, r_name AS name, 'World.'||r_name AS qualified_name, 'namespace' AS kind, CAST(r_regionkey+1 AS INT) AS start_line, 1 AS start_column, CAST(r_regionkey+1 AS INT) AS end_line, 'namespace '||r_name AS signature, 'typescript' AS language, 'typescript-syntax' AS module_id FROM region
  UNION ALL SELECT 'nat:'||lpad(CAST(n_nationkey AS STRING),3,'0'), r_name, 'geo/'||replace(lower(r_name),' ','_')||'.ts', n_name, r_name||'.'||n_name, 'class', CAST(n_nationkey+1 AS INT), 1, CAST(n_nationkey+9 AS INT), 'class '||n_name, 'typescript','typescript-syntax' FROM nation JOIN region ON n_regionkey=r_regionkey
  UNION ALL SELECT 'sup:'||lpad(CAST(s_suppkey AS STRING),9,'0'), n_name, 'generated/suppliers/n'||CAST(s_nationkey AS STRING)||'.g.cs', s_name, n_name||'.'||s_name, 'NamedType', CAST(s_suppkey+1 AS INT), 5, CAST(s_suppkey+1 AS INT), s_name, 'csharp','csharp-roslyn' FROM supplier JOIN nation ON s_nationkey=n_nationkey
  UNION ALL SELECT 'cus:'||lpad(CAST(c_custkey AS STRING),9,'0'), n_name, 'src/customers/'||lower(c_mktsegment)||'.cs', c_name, c_mktsegment||'.'||c_name, 'NamedType', CAST(c_custkey+1 AS INT), 5, CAST(c_custkey+4 AS INT), c_name, 'csharp','csharp-roslyn' FROM customer JOIN nation ON c_nationkey=n_nationkey
  UNION ALL SELECT 'prt:'||lpad(CAST(p_partkey AS STRING),9,'0'), p_brand, 'src/parts/'||lower(p_type)||'/'||replace(lower(p_brand),'#','')||'.cs', replace(p_name,' ','_'), p_brand||'.'||replace(p_name,' ','_'), 'Method', CAST(p_partkey+1 AS INT), 9, CAST(p_partkey+1+p_size AS INT), 'void '||replace(p_name,' ','_')||'(int size)', 'csharp','csharp-roslyn' FROM part
  UNION ALL SELECT 'ord:'||lpad(CAST(o_orderkey AS STRING),9,'0'), CAST(NULL AS STRING), 'src/orders/'||replace(lower(o_orderpriority),' ','_')||'.cs', 'Order'||lpad(CAST(o_orderkey AS STRING),9,'0'), 'Orders.Order'||lpad(CAST(o_orderkey AS STRING),9,'0'), 'Method', CAST(o_orderkey+1 AS INT), 9, CAST(o_orderkey+3 AS INT), 'Order'||lpad(CAST(o_orderkey AS STRING),9,'0')||'('||o_orderstatus||')', 'csharp','csharp-roslyn' FROM orders
  UNION ALL SELECT 'evt:'||lpad(CAST(event_id AS STRING),9,'0'), CAST(NULL AS STRING), 'src/events/u'||CAST(user_id % 50 AS STRING)||'.cs', event_type, event_type, 'textual-evidence', CAST(event_id+1 AS INT), 1, CAST(event_id+1 AS INT), event_type, 'csharp','csharp-roslyn' FROM events
) s
"""

RELATIONSHIPS = """
SELECT id,'repo' AS repository_id,source_id,target_id,kind,file_path,line,col,CASE WHEN kind='calls' THEN 'semantic' ELSE 'syntax' END AS confidence,CASE WHEN substring(file_path,1,4)='geo/' THEN 'typescript' ELSE 'csharp' END AS language,CASE WHEN substring(file_path,1,4)='geo/' THEN 'typescript-syntax' ELSE 'csharp-roslyn' END AS module_id,CAST(NULL AS STRING) AS structural_identity FROM (
SELECT DISTINCT * FROM (
SELECT 'e:nat:'||lpad(CAST(n_nationkey AS STRING),3,'0') AS id, 'reg:'||lpad(CAST(n_regionkey AS STRING),3,'0') AS source_id, 'nat:'||lpad(CAST(n_nationkey AS STRING),3,'0') AS target_id, 'contains' AS kind, 'geo/regions.ts' AS file_path, CAST(n_nationkey+1 AS INT) AS line, 1 AS col FROM nation
UNION ALL SELECT 'e:sup:'||lpad(CAST(s_suppkey AS STRING),9,'0'), 'nat:'||lpad(CAST(s_nationkey AS STRING),3,'0'), 'sup:'||lpad(CAST(s_suppkey AS STRING),9,'0'), 'contains', 'generated/suppliers/n'||CAST(s_nationkey AS STRING)||'.g.cs', CAST(s_suppkey+1 AS INT), 5 FROM supplier
UNION ALL SELECT 'e:cus:'||lpad(CAST(c_custkey AS STRING),9,'0'), 'nat:'||lpad(CAST(c_nationkey AS STRING),3,'0'), 'cus:'||lpad(CAST(c_custkey AS STRING),9,'0'), 'contains', 'src/customers/'||lower(c_mktsegment)||'.cs', CAST(c_custkey+1 AS INT), 5 FROM customer
UNION ALL SELECT 'e:ord:'||lpad(CAST(o_orderkey AS STRING),9,'0'), 'ord:'||lpad(CAST(o_orderkey AS STRING),9,'0'), 'cus:'||lpad(CAST(o_custkey AS STRING),9,'0'), 'references', 'src/orders/'||replace(lower(o_orderpriority),' ','_')||'.cs', CAST(o_orderkey+2 AS INT), 13 FROM orders
UNION ALL SELECT 'e:call:'||lpad(CAST(l_orderkey AS STRING),9,'0')||':'||lpad(CAST(l_partkey AS STRING),9,'0')||':'||CAST(l_linenumber AS STRING)||':'||CAST(CAST(l_quantity AS INT) AS STRING), 'ord:'||lpad(CAST(l_orderkey AS STRING),9,'0'), 'prt:'||lpad(CAST(l_partkey AS STRING),9,'0'), 'calls', 'src/orders/'||replace(lower(o_orderpriority),' ','_')||'.cs', CAST(l_linenumber AS INT), CAST(l_quantity AS INT) FROM lineitem JOIN orders ON l_orderkey=o_orderkey
UNION ALL SELECT 'e:new:'||lpad(CAST(l_orderkey AS STRING),9,'0')||':'||lpad(CAST(l_suppkey AS STRING),9,'0')||':'||CAST(l_linenumber AS STRING)||':'||CAST(CAST(l_quantity AS INT) AS STRING), 'ord:'||lpad(CAST(l_orderkey AS STRING),9,'0'), 'sup:'||lpad(CAST(l_suppkey AS STRING),9,'0'), 'constructs', 'src/orders/'||replace(lower(o_orderpriority),' ','_')||'.cs', CAST(l_linenumber AS INT), CAST(l_quantity AS INT) FROM lineitem JOIN orders ON l_orderkey=o_orderkey
UNION ALL SELECT 'e:evt:'||lpad(CAST(event_id AS STRING),9,'0'), 'evt:'||lpad(CAST(event_id AS STRING),9,'0'), 'ext:user:'||CAST(user_id AS STRING), 'references', 'src/events/u'||CAST(user_id % 50 AS STRING)||'.cs', CAST(event_id+1 AS INT), 1 FROM events
) x
) r
"""

_TABLE = re.compile(r"\b(FROM|JOIN) (region|nation|supplier|customer|part|orders|lineitem|events|documents)\b")


def star_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL over the tables in ``sf_dir`` without registering views."""
    used = sorted({table for _, table in _TABLE.findall(sql)})
    frames = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in used}
    return spark.sql(_TABLE.sub(r"\1 {\2}", sql), **frames)


_PACKS: dict[tuple, Pack] = {}


def pack(spark: SparkSession, sf_dir: str) -> Pack:
    """The graph of the tables in ``sf_dir`` as a pack in the shared folder: one for a session and a
    state of the files, as a store has one for a generation."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir.rstrip("/"))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), state)
    if key not in _PACKS:
        # Star tables are a graph's raw form: DISTINCT and joins over all of them are paid once.
        root = f"{shared_dir(spark)}/codeloom-pack-{uuid.uuid4().hex}"
        _PACKS[key] = Pack(spark, root, lambda: star_tables(spark, sf_dir, SYMBOLS), lambda: star_tables(spark, sf_dir, RELATIONSHIPS))
    return _PACKS[key]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, sf_dir).table("base")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, sf_dir).table("relationships")


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_path``, ``line_no`` from 1 and ``line`` of every document."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    path = "concat(source, '/', lang, '/doc', doc_id, '.txt') as file_path"
    lines = docs.selectExpr(path, "posexplode(split(text, '\r\n|\n|\r')) as (pos, line)")
    return lines.selectExpr("file_path", "pos + 1 as line_no", "line")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts`` and ``path`` of every event: a stream of file changes."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return events.selectExpr("ts", "concat('src/events/u', cast(user_id % 50 as string), '.cs') as path")
