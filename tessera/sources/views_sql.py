"""SQL text of the derived views (runs unchanged in Spark SQL and DuckDB).

The oracle queries inline these as CTEs; Spark users can register them with
``spark.sql(f"CREATE TEMP VIEW sales AS {SALES}")`` after ``register_tables``.
"""

SALES = """
SELECT CAST(l_shipdate AS DATE) AS date, r_name AS store, p_type AS product,
       CAST(l_quantity AS INT) AS sales_qty,
       CAST((month(CAST(l_shipdate AS DATE))*7 + length(r_name) + length(p_type)) % 5 = 0 AS INT) AS promotion,
       p_retailprice AS price
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

REVIEWS = """
SELECT doc_id,
       text || CASE doc_id % 6 WHEN 0 THEN ' Great quality, highly recommend.' WHEN 1 THEN ' Terrible. Broke, waste of money!'
                               WHEN 2 THEN ' Partly bad and partly great.' WHEN 3 THEN ' Excellent and reliable, but slow.'
                               WHEN 4 THEN ' Nothing to add.' ELSE '' END AS review_text,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 5 + 1 AS INT) END AS rating,
       source AS category, CAST(n_chars % 10 AS INT) AS helpful_votes
FROM documents
"""

ENTITIES_RAW = """
SELECT p_name AS entity, p_type AS department, CAST(50 + p_size AS INT) AS overall_score,
       CAST(50 + p_partkey*7 % 51 AS INT) AS research_score, CAST(50 + p_partkey*13 % 51 AS INT) AS teaching_score,
       CAST(50 + p_partkey*29 % 51 AS INT) AS hec_score, CAST(1 + p_partkey*17 % 70 AS INT) AS hec_rank,
       CAST(1900 + p_partkey % 120 AS INT) AS year_founded
FROM part
"""

REQUESTS = """
SELECT c_custkey AS request_id, 2.0E0 + (c_custkey % 21)/10.0E0 AS gpa,
       CASE c_custkey % 3 WHEN 0 THEN 'Balanced' WHEN 1 THEN 'Public' ELSE 'Private' END AS preference,
       CASE c_nationkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM'
                            WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END AS department
FROM customer
"""

REQUESTS_ANY = """
SELECT c_custkey AS request_id, 2.0E0 + (c_custkey % 97)/48.0E0 AS gpa,
       CASE c_custkey % 5 WHEN 0 THEN 'Balanced' WHEN 1 THEN 'Public' WHEN 2 THEN 'Private' WHEN 3 THEN 'Any' END AS preference,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'NONE' ELSE
         CASE c_nationkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM'
                              WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END END AS department
FROM customer
"""

VECTOR_SETS = """
SELECT label AS grp, vec_id AS ord, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
"""

SHORT_VECTOR_SETS = """
SELECT CASE WHEN vec_id % 40 <> 0 THEN label END AS grp, vec_id AS ord, CAST(embedding AS DOUBLE[])[1:8] AS vec FROM embeddings
"""

VIEWS = {"sales": SALES, "reviews": REVIEWS, "entities_raw": ENTITIES_RAW,
         "requests": REQUESTS, "requests_any": REQUESTS_ANY}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with ``WITH name AS (...)`` CTEs for the given views.

    ``extra`` adds more CTEs (in order) after the views, so a query can build
    on intermediate relations.
    """
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v.strip()})")
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
