"""Deterministic derivations of the domain's tables from the star schema.

The star-schema tables hold no chemistry; each carrier is a projection of one of them, written in expressions that Spark SQL and
DuckDB read alike, so that a query and its SQL twin begin from the same rows. No double is turned into text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import domain


def cas_sql(number: str, wrong: str = "0") -> str:
    """A registry number from a non-negative integer: 1000 + number, two digits, and the check digit (plus wrong)."""
    k, d = f"(1000 + {number})", f"({number} % 100)"
    digit = lambda x, ten: f"CAST(floor({x} / {ten}) AS BIGINT) % 10"
    total = " + ".join(
        [f"1 * ({d} % 10)", f"2 * ({digit(d, 10)})", *(f"{i + 3} * ({digit(k, 10**i)})" for i in range(6))]
    )
    return f"concat(CAST({k} AS STRING), '-', lpad(CAST({d} AS STRING), 2, '0'), '-', CAST((({total}) + {wrong}) % 10 AS STRING))"


_Q = "CAST(floor(l_quantity) AS BIGINT)"
_QS = f"CAST({_Q} AS STRING)"
_PART = "(p_partkey - CASE WHEN p_partkey % 7 = 5 THEN 1 WHEN p_partkey % 7 = 6 THEN 2 ELSE 0 END)"
_CONTENT = f"""CASE (l_orderkey + l_partkey) % 14
 WHEN 0 THEN concat({_QS}, ' - ', CAST({_Q} + 10 AS STRING), ' %') WHEN 1 THEN concat('<', {_QS}) WHEN 2 THEN concat({_QS}, ' 미만')
 WHEN 3 THEN 'Rem.' WHEN 4 THEN '' WHEN 5 THEN concat(CAST({_Q} + 20 AS STRING), ' ~ ', {_QS}) WHEN 6 THEN concat({_QS}, '.5<')
 WHEN 7 THEN '0.1~1미만' WHEN 8 THEN concat('>= ', {_QS}, '%') WHEN 9 THEN '미기재%' WHEN 10 THEN concat({_QS}, ' 이상')
 WHEN 11 THEN concat({_QS}, '% (wt)') WHEN 12 THEN concat(CAST({_Q} * 3 AS STRING), '%') ELSE concat({_QS}, '~', CAST({_Q} + 5 AS STRING), '%') END"""

#: name: (table, {column: expression})
CARRIERS: dict[str, tuple[str, dict[str, str]]] = {
    "component": ("lineitem", {
        "doc_id": "l_orderkey",
        "seq": "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000",
        "cas": cas_sql("l_partkey", "CASE WHEN (l_orderkey + l_partkey) % 11 = 0 THEN 1 ELSE 0 END"),
        "name": "concat('Substance ', CAST(l_partkey AS STRING))",
        "content": _CONTENT,
        "quantity": _Q,
        "page": "1 + l_linenumber % 3",
        "engine": "CASE WHEN l_linestatus = 'O' THEN 'table' ELSE 'density' END",
    }),
    "master": ("part", {
        "ord": "p_partkey",
        "sort_code": "concat(CAST(1 + p_partkey % 3 AS STRING), CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END, '-', lpad(CAST(p_size AS STRING), 2, '0'), '-', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'))",
        "name": "concat(p_name, ' (', p_type, ') ', CAST(p_partkey AS STRING))",
        "cas": cas_sql(_PART),
        "twa": "CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) % 97 AS STRING) END",
        "method": "concat('M', CAST(p_size % 9 AS STRING))",
        "measured": "p_size % 2 = 0", "special": "p_size % 5 = 0", "permit": "p_size % 7 = 0", "exam": "p_size % 3 = 0",
        "mark": "CASE p_size % 6 WHEN 0 THEN '○' WHEN 1 THEN 'Y' WHEN 2 THEN '예' WHEN 3 THEN '' WHEN 4 THEN 'N' ELSE '1' END",
        "decision": "CASE p_size % 5 WHEN 0 THEN '승인' WHEN 1 THEN '수정' WHEN 2 THEN '보류' WHEN 3 THEN '제외' ELSE '추가검토' END",
        "parent": "p_partkey % 7 = 4",
        "active": "p_size % 10 <> 0",
    }),
    "document": ("orders", {
        "doc_id": "o_orderkey",
        "doc_type": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'text' WHEN o_orderpriority = '3-MEDIUM' THEN 'mixed' ELSE 'image' END",
        "product": "concat(CASE WHEN o_custkey % 5 = 0 THEN 'Product-' ELSE 'product ' END, CAST(o_custkey AS STRING))",
        "product_seen": "CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 = 1 THEN concat('PRODUCT ', CAST(o_custkey AS STRING)) WHEN o_custkey % 4 = 2 THEN concat('Product ', CAST(o_custkey AS STRING), ' X') ELSE 'other' END",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'timeout' END",
        "file_name": "concat(CAST(o_custkey % 200 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '_' ELSE '. ' END, 'Sheet', CAST(o_orderkey % 1000 AS STRING), '.pdf')",
        "chars": "CAST(floor(o_totalprice) AS BIGINT) % 1500",
        "images": "o_custkey % 3", "large_images": "o_custkey % 2",
        "process": "concat('process ', CAST(o_custkey % 25 AS STRING))",
        "file_hash": "concat('h', CAST(o_custkey AS STRING))",
        "eligible": "o_orderkey % 13 <> 0",
        "day": "CAST(o_orderdate AS DATE)",
    }),
    "journal": ("events", {
        "run_id": "user_id % 10", "trace_id": "user_id", "seq": "event_id", "ts": "ts",
        "event": "CASE event_type WHEN 'view' THEN 'candidate_created' WHEN 'click' THEN 'candidate_transformed' WHEN 'signup' THEN 'candidate_merged' WHEN 'purchase' THEN 'candidate_selected' ELSE CASE WHEN event_id % 2 = 0 THEN 'candidate_rejected' ELSE 'failure' END END",
        "candidate": "concat('candidate-', lpad(CAST(event_id % 40 AS STRING), 3, '0'))",
        "parent": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('candidate-', lpad(CAST((event_id + 7) % 40 AS STRING), 3, '0')) END",
        "cents": "CAST(floor(value * 100) AS BIGINT)",
        "details": "props",
        "status": "CASE WHEN event_id % 17 = 0 THEN 'timeout' WHEN event_id % 19 = 0 THEN 'odd' ELSE 'completed' END",
        "stage": "concat('stage-', CAST(event_id % 6 AS STRING))",
        "size": "event_id % 9000",
    }),
    "chemical": ("lineitem", {
        "doc_id": "l_orderkey",
        "seq": "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000",
        "cas": domain.choose_sql("l_partkey", tuple(c for c, _ in domain.SUBSTANCES)),
        "name": domain.choose_sql("l_partkey", tuple(n for _, n in domain.SUBSTANCES)),
        "content": _CONTENT,
        "quantity": _Q,
        "flags": domain.choose_sql("l_suppkey + l_linenumber", (
            "작업환경측정대상물질, 특수건강진단대상물질", "관리대상유해물질; 특별관리물질", "허가대상물질", "금지물질, 유독물질", "광물성분진 제한물질", "관찰물질 / 사고대비물질", "해당없음", "")),
    }),
    "roster": ("nation", {
        "ord": "CAST(n_nationkey AS BIGINT)",
        "cas": domain.choose_sql("n_nationkey", tuple(c for c, _ in domain.SUBSTANCES)),
        "name": domain.choose_sql("n_nationkey", tuple(n for _, n in domain.SUBSTANCES)),
        "sort_code": "CASE WHEN n_nationkey = 22 THEN '2D-10-010' ELSE concat('1A-10-', lpad(CAST(n_nationkey AS STRING), 3, '0')) END",
        "method": domain.choose_sql("n_nationkey * 5 + n_regionkey", (*domain.METHODS, "GC법", "")),
    }),
    "goods": ("orders", {
        "doc_id": "o_orderkey",
        "product": domain.choose_sql("o_orderkey", (
            "용접봉 K-308", "Welding wire CR 13", "welding rod", "연강용 피복아크 용접봉 CS-200 / CR-13", "limestone putty", "Cleaner 5", "ＷＥＬＤＩＮＧ　wire", "Product-7", "석고보드", "paint (red)", "Primer 2.0")),
        "seen": domain.choose_sql("o_custkey", ("Welding Wire CR-13", "welding rod", "", "limestone putty X", "CLEANER·5", "Welding wire", "Ｐｒｏｄｕｃｔ７", "석고 보드", "paint red", "other")),
        "status": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'timeout' END",
        "doc_type": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'text' WHEN o_orderpriority = '3-MEDIUM' THEN 'mixed' ELSE 'image' END",
        "env": "CASE o_custkey % 6 WHEN 0 THEN '30' WHEN 1 THEN '-5' WHEN 2 THEN 'soon' WHEN 3 THEN '0' WHEN 4 THEN '12.5' END",
        "old_env": "CASE o_orderkey % 5 WHEN 0 THEN '90' WHEN 1 THEN 'x' WHEN 2 THEN '-1' END",
        "ord": "o_custkey",
    }),
    "word": ("lineitem", {
        "doc_id": "l_orderkey % 500", "page": "1 + l_linenumber % 2",
        "x0": "CAST(l_suppkey % 100 * 6 AS BIGINT)", "y0": "CAST(l_partkey % 60 * 4 AS BIGINT)",
        "width": "12 + CAST(floor(l_quantity) AS BIGINT) % 30", "height": "8 + l_partkey % 5",
        "id": "l_orderkey * 1000000 + CAST(l_linenumber AS BIGINT) * 100000 + l_partkey * 3 + l_suppkey % 3",
        "text": domain.choose_sql("l_partkey + l_linenumber", domain.VOCABULARY),
    }),
}
#: Carriers may be named after raw tables no more than once: the rest of the names are the raw tables.


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in CARRIERS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, columns = CARRIERS[name]
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def with_carriers(sql: str) -> str:
    """sql with the carriers that it names put before it."""
    used = [n for n in CARRIERS if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in CARRIERS[n][1].items())} FROM {CARRIERS[n][0]})" for n in used]
    if not parts:
        return sql
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE\b", body, re.I) else ""
    body = re.sub(r"^WITH (RECURSIVE )?", "", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else None
    return f"WITH {recursive}" + ", ".join(parts) + (", " + body if body else " " + sql.strip())
