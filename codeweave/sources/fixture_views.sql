-- Fixture mapping: projects the driver's star-schema tables onto the
-- code-entity tables (module, function, call site, import, type, ...).
-- One text for both engines: Spark runs it over parquet-backed CTEs,
-- the DuckDB oracle over its pre-registered views. Table sizes enter
-- as uncorrelated scalar subqueries (computed once, inlined as a
-- literal), so no view needs a cross join.
dims AS (SELECT (SELECT count(*) FROM supplier) AS nm,
    (SELECT count(*) FROM part) AS nf,
    (SELECT count(*) FROM customer) AS nt,
    (SELECT count(*) FROM documents) AS nd),
cg_module AS (SELECT s_suppkey AS id,
    concat(n_name, '.', replace(s_name, '#', '_')) AS name,
    concat('src/', n_name, '/', replace(s_name, '#', '_'), '.hs') AS path
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cg_type AS (SELECT x.id, x.type_name, x.module_id, x.type_of_type,
    concat('data ', x.type_name, ' = Mk', x.type_name) AS raw_code,
    m.path AS src_file, x.line_start, x.line_start + 3 AS line_end
  FROM (SELECT c_custkey AS id, c_custkey % (SELECT nm FROM dims) AS module_id,
      concat(c_mktsegment, '_', cast(c_custkey % 50 AS string)) AS type_name,
      CASE c_nationkey % 7 WHEN 0 THEN 'DATA' WHEN 1 THEN 'SUMTYPE' WHEN 2 THEN 'TYPE'
        WHEN 3 THEN 'NEWTYPE' WHEN 4 THEN 'CLASS' WHEN 5 THEN 'INSTANCE' END AS type_of_type,
      cast(5 + floor(c_custkey / (SELECT nm FROM dims)) * 40 AS bigint) AS line_start
    FROM customer) x JOIN cg_module m ON x.module_id = m.id),
cg_function AS (SELECT x.id, x.name, x.module_id, m.name AS module_name, x.type_enum,
    CASE WHEN x.p_size % 7 = 0 THEN NULL WHEN x.p_size % 11 = 0 THEN ''
      ELSE concat(repeat(concat(x.type_enum, ' -> '), x.p_size % 6), t.type_name) END AS function_signature,
    m.path AS src_file, x.line_start, x.line_start + 10 + x.p_size % 30 AS line_end
  FROM (SELECT p_partkey AS id, p_name AS name, p_partkey % (SELECT nm FROM dims) AS module_id,
      p_type AS type_enum, p_size, (p_partkey * 3) % (SELECT nt FROM dims) AS tk,
      cast(1 + floor(p_partkey / (SELECT nm FROM dims)) * 50 AS bigint) AS line_start
    FROM part) x
  JOIN cg_module m ON x.module_id = m.id JOIN cg_type t ON x.tk = t.id),
cg_function_body AS (SELECT x.id, d.text AS raw_string
  FROM (SELECT p_partkey AS id, p_partkey % (SELECT nd FROM dims) AS dk FROM part) x
  JOIN documents d ON x.dk = d.doc_id),
cg_where_function AS (SELECT l_partkey AS parent_function_id,
    concat('go', cast(l_suppkey AS string)) AS name
  FROM lineitem),
cg_function_called AS (SELECT x.function_id, f.id AS callee_id, f.name,
    CASE WHEN x.site = 7 THEN NULL ELSE f.module_name END AS module_name, x.site,
    CASE WHEN x.site = 5 THEN NULL
      ELSE concat(m.path, ':', cast(x.function_id % 50 + x.site AS string)) END AS src_loc
  FROM (SELECT l_partkey AS function_id, l_linenumber AS site,
      l_partkey % (SELECT nm FROM dims) AS module_id,
      (l_orderkey * 7 + l_linenumber * 13 + l_suppkey) % (SELECT nf FROM dims) AS k
    FROM lineitem) x JOIN cg_function f ON x.k = f.id
  LEFT JOIN cg_module m ON x.module_id = m.id),
cg_function_dependency AS (SELECT DISTINCT x.caller_id, x.callee_id
  FROM (SELECT l_partkey AS caller_id,
      (l_orderkey * 7 + l_linenumber * 13 + l_suppkey) % (SELECT nf FROM dims) AS callee_id
    FROM lineitem) x),
cg_import AS (SELECT x.o_orderkey AS id, x.module_id, m.name AS module_name,
    CASE WHEN x.o_orderstatus = 'F' THEN NULL
      WHEN x.o_orderkey % 4 = 0 THEN concat('Test-', lower(x.o_orderpriority))
      ELSE concat('pkg-', lower(x.o_orderpriority)) END AS package_name,
    x.o_orderkey % 3 = 0 AS qualified_style,
    CASE WHEN x.o_orderkey % 6 = 0 THEN 'M' END AS as_module_name,
    x.o_orderkey % 5 = 0 AS is_hiding,
    CASE WHEN x.o_orderkey % 10 = 0 THEN '[lookup]' END AS hiding_specs,
    1 + x.o_orderkey % 30 AS line,
    CASE WHEN x.o_orderkey % 8 <> 0
      THEN concat('lib/', cast(x.o_orderkey % 97 AS string), '.hs:1') END AS src_loc
  FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority,
      o_custkey % (SELECT nm FROM dims) AS module_id,
      (o_orderkey * 3 + 1) % (SELECT nm FROM dims) AS k FROM orders) x
  JOIN cg_module m ON x.k = m.id),
cg_constructor AS (SELECT o_orderkey AS id, o_custkey AS type_id,
    concat('Mk', cast(o_orderkey AS string)) AS name FROM orders),
cg_field AS (SELECT x.constructor_id, x.field_name, t.type_name AS field_type_raw
  FROM (SELECT l_orderkey AS constructor_id,
      CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('f', cast(l_linenumber AS string)) END AS field_name,
      l_suppkey AS tk FROM lineitem) x JOIN cg_type t ON x.tk = t.id),
cg_type_dependency AS (SELECT DISTINCT x.dependent_id, x.dependency_id
  FROM (SELECT o_custkey AS dependent_id,
      (o_orderkey * 11 + o_custkey) % ((SELECT nt FROM dims) + 50) AS dependency_id
    FROM orders) x
  WHERE x.dependent_id <> x.dependency_id),
cg_class AS (SELECT x.id, x.class_name, x.module_id,
    concat('class ', x.class_name, ' a where') AS class_definition, m.path AS src_file,
    30 AS line_start, 34 AS line_end
  FROM (SELECT cast(n_nationkey AS bigint) AS id, n_name AS class_name,
      n_nationkey % (SELECT nm FROM dims) AS module_id
    FROM nation) x JOIN cg_module m ON x.module_id = m.id),
cg_instance AS (SELECT s_suppkey AS id, s_suppkey AS module_id,
    concat('instance ', n_name, ' ', replace(s_name, '#', '_')) AS instance_definition,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat(n_name, ' a') END AS instance_signature,
    CASE WHEN s_suppkey % 3 <> 0
      THEN concat('src/', n_name, '.hs:', cast(s_suppkey AS string)) END AS src_loc
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cg_probe AS (SELECT x.event_id AS probe_id, m.path AS src_file, x.line
  FROM (SELECT event_id, user_id % (SELECT nm FROM dims) AS module_id,
      1 + event_id % 1200 AS line
    FROM events) x JOIN cg_module m ON x.module_id = m.id)
