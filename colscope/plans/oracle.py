"""DuckDB text of the registered queries, for the cross-engine check.

Each builder returns one SQL string over the driver's views (region, nation,
... conversations). Spark value-to-text rules are reproduced in DuckDB:
Java's float/double text (scientific below 1e-3 and from 1e7), arrays as
``[a, b]``, booleans and timestamps as cast.
"""

from __future__ import annotations

from colscope.plans.fixtures import FOREIGN_KEYS, PRIMARY_KEYS, SHAPES, TABLE_COMMENTS

# ---- fixed values: the given tables, their columns and Spark types ----
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}
# ---- end of fixed values ----

LINEITEM_NULLS_SQL = ("(SELECT * REPLACE (nullif(l_tax, 0.0) AS l_tax, nullif(l_returnflag, 'A') AS l_returnflag), "
                      "CAST(NULL AS VARCHAR) AS l_void FROM lineitem)")
PROFILE_SCHEMAS = {**SCHEMAS, "lineitem_nulls": SCHEMAS["lineitem"] + [("l_void", "string")]}
DB = "testdata"


def source(t: str) -> str:
    return LINEITEM_NULLS_SQL if t == "lineitem_nulls" else t


def sorted_tables(schemas=PROFILE_SCHEMAS) -> list[str]:
    return sorted(schemas)


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def jfloat(x: str) -> str:
    """Java Float/Double.toString of a DuckDB float/double expression."""
    s = f"CAST({x} AS VARCHAR)"
    frac = f"split_part(ltrim({s}, '-'), '.', 2)"
    sig = f"ltrim({frac}, '0')"
    sci = (f"(CASE WHEN contains({s}, 'e') THEN "
           f"(CASE WHEN contains(split_part({s}, 'e', 1), '.') THEN split_part({s}, 'e', 1) "
           f"ELSE split_part({s}, 'e', 1) || '.0' END)"
           f" || 'E' || CAST(CAST(split_part({s}, 'e', 2) AS INTEGER) AS VARCHAR) "
           f"ELSE (CASE WHEN {x} < 0 THEN '-' ELSE '' END) || substr({sig}, 1, 1) || '.' || "
           f"coalesce(nullif(substr({sig}, 2), ''), '0') || 'E-' || "
           f"CAST(length({frac}) - length({sig}) + 1 AS VARCHAR) END)")
    return (f"(CASE WHEN {x} = 0 THEN '0.0' WHEN abs({x}) >= 0.001 AND abs({x}) < 10000000 THEN "
            f"(CASE WHEN contains({s}, '.') THEN {s} ELSE {s} || '.0' END) ELSE {sci} END)")


def canon(col: str, typ: str) -> str:
    c = q(col)
    if typ == "string":
        return c
    if typ in ("double", "float"):
        return jfloat(c)
    if typ == "array<float>":
        return f"('[' || array_to_string(list_transform({c}, lambda v: {jfloat('v')}), ', ') || ']')"
    return f"CAST({c} AS VARCHAR)"


def family(typ: str) -> str | None:
    if typ in ("int", "bigint", "smallint", "tinyint"):
        return "integral"
    if typ == "string":
        return "string"
    if typ in ("timestamp_ntz", "timestamp"):
        return "timestamp"
    if typ == "date":
        return "date"
    return None


def keyval(col: str, typ: str) -> str:
    return f"CAST(CAST({q(col)} AS BIGINT) AS VARCHAR)" if family(typ) == "integral" else f"CAST({q(col)} AS VARCHAR)"


# ------------------------------------------------------------------ profile
def row_counts_sql(schemas=PROFILE_SCHEMAS) -> str:
    return " UNION ALL ".join(f"SELECT {lit(t)} AS {q('table')}, count(*) AS row_count FROM {source(t)}"
                              for t in sorted_tables(schemas))


def col_stats_sql(schemas=PROFILE_SCHEMAS) -> str:
    """(table, position, column, data_type, row_count, nulls, null_ratio, unique_count, is_key)"""
    parts = []
    for t in sorted_tables(schemas):
        for pos, (c, typ) in enumerate(schemas[t], start=1):
            parts.append(
                f"SELECT {lit(t)} AS {q('table')}, {pos} AS position, {lit(c)} AS {q('column')}, {lit(typ)} AS data_type, "
                f"count(*) AS row_count, count(*) - count({q(c)}) AS nulls, "
                f"CASE WHEN count(*) > 0 THEN round((count(*) - count({q(c)})) / count(*), 4) END AS null_ratio, "
                f"nullif(count(DISTINCT {q(c)}), 0) AS unique_count, "
                f"(count(*) > 0 AND count({q(c)}) = count(*) AND count(DISTINCT {q(c)}) = count(*)) AS is_key "
                f"FROM {source(t)}")
    return " UNION ALL ".join(parts)


def samples_sql(schemas=PROFILE_SCHEMAS, limit: int = 10) -> str:
    """(table, column, position, rank, value)"""
    parts = []
    for t in sorted_tables(schemas):
        cols = schemas[t]
        order = ", ".join(f"{q(c)} ASC NULLS FIRST" for c, _ in cols)
        head = f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS __rn FROM {source(t)}) WHERE __rn <= {limit * 10})"
        long = " UNION ALL ".join(
            f"SELECT {lit(c)} AS c, {pos} AS position, {canon(c, typ)} AS v, __rn FROM {head}"
            for pos, (c, typ) in enumerate(cols, start=1))
        parts.append(
            f"SELECT {lit(t)} AS {q('table')}, c AS {q('column')}, position, rank, v AS value FROM ("
            f"SELECT c, position, v, row_number() OVER (PARTITION BY c ORDER BY first_rn) AS rank FROM ("
            f"SELECT c, position, v, min(__rn) AS first_rn FROM ({long}) WHERE v IS NOT NULL GROUP BY c, position, v)"
            f") WHERE rank <= {limit}")
    return " UNION ALL ".join(parts)


def enum_sql(schemas=PROFILE_SCHEMAS, limit: int = 10) -> str:
    parts = []
    for t in sorted_tables(schemas):
        for c, typ in schemas[t]:
            parts.append(
                f"SELECT {lit(t)} AS {q('table')}, {lit(c)} AS {q('column')}, value, frequency FROM ("
                f"SELECT {canon(c, typ)} AS value, count(*) AS frequency, count(*) OVER () AS nv FROM {source(t)} "
                f"WHERE {q(c)} IS NOT NULL GROUP BY 1) WHERE nv <= {limit}")
    return " UNION ALL ".join(parts)


def composite_keys_sql(schemas=SCHEMAS, max_columns: int = 3) -> str:
    """Minimal unique sets of two to three columns without nulls, of value families other than text."""
    from itertools import combinations

    parts = []
    for t in sorted_tables(schemas):
        cols = [c for c, typ in schemas[t] if family(typ) in ("integral", "date", "timestamp")]
        flag = {}
        for size in range(1, max_columns + 1):
            for some in combinations(cols, size):
                flag[some] = f"u{len(flag)}"
        if len(cols) < 2:
            continue
        unique = ", ".join(
            f"count(DISTINCT ({', '.join(q(c) for c in some)})) = count(*) AS {name}" if len(some) > 1 else
            f"count(DISTINCT {q(some[0])}) = count(*) AS {name}" for some, name in flag.items())
        nulls = ", ".join(f"count({q(c)}) = count(*) AS {q('full_' + c)}" for c in cols)
        for some, name in flag.items():
            if len(some) > 1:
                smaller = [flag[x] for n in range(1, len(some)) for x in combinations(some, n)]
                test = " AND ".join([name, "n > 0", *(f"NOT {x}" for x in smaller), *(q("full_" + c) for c in some)])
                parts.append(f"SELECT {lit(t)} AS {q('table')}, {lit(', '.join(some))} AS columns FROM "
                             f"(SELECT count(*) AS n, {unique}, {nulls} FROM {t}) WHERE {test}")
    return " UNION ALL ".join(parts)


def inclusion_sql(schemas=SCHEMAS) -> str:
    vals = []
    for t in sorted_tables(schemas):
        for c, typ in schemas[t]:
            fam = family(typ)
            if fam is None:
                continue
            vals.append(f"SELECT DISTINCT {lit(t)} AS t, {lit(c)} AS c, {lit(fam)} AS fam, {keyval(c, typ)} AS v "
                        f"FROM {source(t)} WHERE {q(c)} IS NOT NULL")
    return (f"WITH vals AS ({' UNION ALL '.join(vals)}), "
            f"st AS (SELECT t, c, fam, count(*) AS nd FROM vals GROUP BY ALL), "
            f"ks AS (SELECT s.{q('table')} AS t, s.{q('column')} AS c FROM ({col_stats_sql(schemas)}) s WHERE is_key), "
            f"keys AS (SELECT st.* FROM st JOIN ks USING (t, c)), "
            f"pairs AS (SELECT a.t AS ft, a.c AS fc, k.t AS kt, k.c AS kc, a.nd FROM st a JOIN keys k "
            f"ON a.fam = k.fam AND NOT (a.t = k.t AND a.c = k.c)), "
            f"m AS (SELECT p.ft, p.fc, p.kt, p.kc, p.nd, count(*) AS matched FROM pairs p "
            f"JOIN vals a ON a.t = p.ft AND a.c = p.fc JOIN vals b ON b.t = p.kt AND b.c = p.kc AND b.v = a.v "
            f"GROUP BY ALL) "
            f"SELECT ft AS fk_table, fc AS fk_column, kt AS key_table, kc AS key_column, nd AS fk_distinct "
            f"FROM m WHERE matched = nd")


# ------------------------------------------------------------------ catalogue
def declared_sql(s: str) -> str:
    """Key flags from the declared keys of the star schema."""
    name = f"{s}.{q('table')} || '.' || {s}.{q('column')}"
    pk = ", ".join(lit(f"{t}.{c}") for t, cs in PRIMARY_KEYS.items() for c in cs)
    fk = " ".join(f"WHEN {lit(f'{t}.{c}')} THEN {lit(f'{rt}.{rc}')}" for t, c, rt, rc in FOREIGN_KEYS)
    ref = f"(CASE {name} {fk} END)"
    return f"{name} IN ({pk}) AS is_primary_key, {ref} IS NOT NULL AS is_foreign_key, {ref} AS foreign_key_ref"


def catalog_columns_sql(annotated: bool = True) -> str:
    """catalog_columns of the 14 given tables as a subquery with
    database, table, position, column, data_type, nullable, is_primary_key,
    is_foreign_key, foreign_key_ref, comment, sample_values (list), null_ratio,
    unique_count, business_name, description, keywords (list)."""
    base = (f"SELECT {lit(DB)} AS database, s.{q('table')}, s.position, s.{q('column')}, s.data_type, true AS nullable, "
            f"{declared_sql('s')}, "
            f"CAST(NULL AS VARCHAR) AS comment, coalesce(sm.sv, CAST([] AS VARCHAR[])) AS sample_values, "
            f"s.null_ratio, s.unique_count FROM ({col_stats_sql(SCHEMAS)}) s LEFT JOIN "
            f"(SELECT {q('table')}, {q('column')}, list(value ORDER BY rank) AS sv FROM ({samples_sql(SCHEMAS)}) "
            f"GROUP BY ALL) sm USING ({q('table')}, {q('column')})")
    if not annotated:
        return (f"(SELECT *, CAST(NULL AS VARCHAR) AS business_name, CAST(NULL AS VARCHAR) AS description, "
                f"CAST([] AS VARCHAR[]) AS keywords FROM ({base}))")
    r = f"(SELECT *, {column_reply_sql('b')} AS reply FROM ({base}) b)"
    p = parse_sql(r, "reply")
    return (f"(SELECT database, {q('table')}, position, {q('column')}, data_type, nullable, is_primary_key, "
            f"is_foreign_key, foreign_key_ref, comment, sample_values, null_ratio, unique_count, "
            f"CASE WHEN state <> 'not_object' THEN coalesce(p_business_name, {q('column')}) END AS business_name, "
            f"CASE WHEN state <> 'not_object' THEN coalesce(p_description, '') END AS description, "
            f"CASE WHEN state <> 'not_object' THEN coalesce(p_keywords, CAST([] AS VARCHAR[])) "
            f"ELSE CAST([] AS VARCHAR[]) END AS keywords FROM {p})")


def catalog_tables_sql(annotated: bool = True) -> str:
    comments = " ".join(f"WHEN {lit(t)} THEN {lit(c)}" for t, c in TABLE_COMMENTS.items())
    base = (f"SELECT {lit(DB)} AS database, {q('table')}, CAST(NULL AS VARCHAR) AS schema, row_count, "
            f"CASE {q('table')} {comments} END AS comment FROM ({row_counts_sql(SCHEMAS)})")
    if not annotated:
        return f"(SELECT *, CAST(NULL AS VARCHAR) AS business_name, CAST(NULL AS VARCHAR) AS description FROM ({base}))"
    return (f"(SELECT database, {q('table')}, schema, row_count, comment, "
            f"upper(substr({q('table')}, 1, 1)) || lower(substr({q('table')}, 2)) AS business_name, "
            f"'rows of ' || {q('table')} AS description FROM ({base}))")


def column_reply_sql(a: str) -> str:
    col, tab = f"{a}.{q('column')}", f"{a}.{q('table')}"
    plain = (f"'{{\"business_name\": \"' || upper({col}) || '\", \"description\": \"' || {col} || ' of ' || {tab} || "
             f"'\", \"keywords\": [\"' || {tab} || '\", \"' || {a}.data_type || '\"]}}'")
    return (f"(CASE {a}.position % 5 WHEN 0 THEN {plain} WHEN 1 THEN '```json' || chr(10) || {plain} || chr(10) || '```' "
            f"WHEN 2 THEN '{{\"business_name\": ' WHEN 3 THEN '{{\"description\": \"values of ' || {col} || '\"}}' "
            f"ELSE '[1, 2]' END)")


def strip_fence_sql(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    lines = f"string_split({t}, chr(10))"
    return (f"(CASE WHEN starts_with({t}, '```') THEN "
            f"(CASE WHEN len({lines}) > 2 THEN array_to_string({lines}[2:len({lines}) - 1], chr(10)) ELSE '' END) "
            f"ELSE {t} END)")


def parse_sql(src: str, col: str) -> str:
    """Adds state, p_business_name, p_description, p_keywords to ``src``."""
    b = strip_fence_sql(f"coalesce({col}, '')")
    obj = "json_type(__j) = 'OBJECT'"
    return (f"(SELECT * EXCLUDE (__b, __j), CASE WHEN __j IS NULL THEN 'invalid' "
            f"WHEN {obj} THEN 'ok' ELSE 'not_object' END AS state, "
            f"CASE WHEN {obj} THEN json_extract_string(__j, '$.business_name') END AS p_business_name, "
            f"CASE WHEN {obj} THEN json_extract_string(__j, '$.description') END AS p_description, "
            f"CASE WHEN {obj} THEN CAST(json_extract(__j, '$.keywords') AS VARCHAR[]) END AS p_keywords "
            f"FROM (SELECT *, CASE WHEN __b <> '' AND coalesce(json_valid(__b), false) THEN __b END AS __j "
            f"FROM (SELECT *, {b} AS __b FROM {src})))")


# ------------------------------------------------------------------ shared pieces
NL = "chr(10)"
TOK_SPLIT = r"[^\p{L}\p{N}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def trunc_sql(x: str, n: int) -> str:
    t = strip_sql(f"replace({x}, chr(10), ' ')")
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE substr({t}, 1, {n - 3}) || '...' END)"


def term_vectors_sql(src: str, id_col: str, text_col: str, buckets: int = 4096) -> str:
    """(id, bucket, weight) unit-length term-frequency vectors."""
    toks = (f"SELECT {id_col} AS id, unnest(list_filter(regexp_split_to_array(lower({text_col}), '{TOK_SPLIT}'), "
            f"lambda x: x <> '')) AS tok FROM {src}")
    tf = (f"SELECT id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {buckets} AS bucket, "
          f"CAST(count(*) AS DOUBLE) AS tf FROM ({toks}) GROUP BY ALL")
    return f"(SELECT id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS weight FROM ({tf}))"


def sparse_topk_sql(items: str, queries: str, k: int) -> str:
    """items/queries: (id, bucket, weight); (query_id, id, score, rank)."""
    s = (f"SELECT q.id AS query_id, d.id AS id, sum(q.weight * d.weight) AS score FROM {queries} q "
         f"JOIN {items} d ON q.bucket = d.bucket GROUP BY ALL")
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) "
            f"AS rank FROM ({s})) WHERE rank <= {k})")


VEC_ITEMS = ("(SELECT CASE WHEN vec_id = low THEN 'vec.t' || label ELSE 'vec.t' || label || '.c' || vec_id END AS id, "
             "CASE WHEN vec_id = low THEN 'table' ELSE 'column' END AS type, 'vec' AS database, "
             "'t' || label AS \"table\", CASE WHEN vec_id <> low THEN 'c' || vec_id END AS \"column\", "
             "CASE WHEN vec_id <> low THEN 'float' END AS data_type, "
             "CASE WHEN vec_id = low THEN 'label ' || label ELSE 'vector ' || vec_id END AS business_name, "
             "CAST(embedding AS DOUBLE[]) AS vector FROM embeddings JOIN "
             "(SELECT label, min(vec_id) AS low FROM embeddings GROUP BY label) USING (label))")


def vec_candidates_sql(n: int) -> str:
    s = (f"SELECT q.vec_id AS query_id, i.id, i.type, i.database, i.\"table\", i.\"column\", i.data_type, "
         f"i.business_name, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), i.vector) AS score "
         f"FROM embeddings q JOIN {VEC_ITEMS} i ON true")
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) "
            f"AS cand_rank FROM ({s})) WHERE cand_rank <= {n})")


def fused_sql(top_k: int, filter_type: str | None = None, filter_table: str | None = None) -> str:
    c = vec_candidates_sql(40)
    f = (f"SELECT c.*, greatest(c.score, 0.0) AS original_score, "
         f"CASE WHEN c.type = 'column' THEN coalesce(t.ts, 0.0) ELSE 0.0 END AS table_boost FROM {c} c "
         f"LEFT JOIN (SELECT query_id, database, \"table\", greatest(score, 0.0) AS ts FROM {c} WHERE type = 'table') t "
         f"USING (query_id, database, \"table\")")
    where = f"WHERE type = {lit(filter_type)}" if filter_type else ""
    where = f"WHERE \"table\" = {lit(filter_table)}" if filter_table else where
    return (f"(SELECT * FROM (SELECT *, original_score + table_boost AS fscore, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY original_score + table_boost DESC, cand_rank) AS rank FROM ({f}) {where}) WHERE rank <= {top_k})")


def fused_out(top_k: int, filter_type: str | None = None, filter_table: str | None = None) -> str:
    return (f"SELECT query_id, rank, id, type, round(original_score, 6) AS original_score, "
            f"round(table_boost, 6) AS table_boost, round(fscore, 6) AS score FROM {fused_sql(top_k, filter_type, filter_table)}")


SQL_LOG = (
    f"(SELECT o_orderkey AS query_id, CASE o_orderkey % {SHAPES} "
    "WHEN 0 THEN 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey "
    "WHEN 1 THEN 'WITH t AS (SELECT o_custkey FROM orders WHERE o_orderkey = ' || o_orderkey || ') SELECT * FROM t' "
    "WHEN 2 THEN 'DROP TABLE orders_' || o_orderkey "
    "WHEN 3 THEN 'SELECT 1; DELETE FROM orders WHERE o_orderkey = ' || o_orderkey "
    "WHEN 4 THEN 'SELECT * FROM orders WHERE o_custkey = ' || o_custkey || ' --' "
    "WHEN 5 THEN 'SELECT /* hint ' || o_orderkey || ' */ o_totalprice FROM orders' "
    "WHEN 6 THEN '' "
    "WHEN 7 THEN '   ' || chr(10) || '  ' "
    "WHEN 8 THEN 'SELECT ''grant ' || o_orderkey || ''' AS note FROM orders' "
    "WHEN 9 THEN 'select o_orderstatus, count(*) from orders where o_custkey = ' || o_custkey || ' group by o_orderstatus' "
    "WHEN 10 THEN 'INSERT INTO orders_copy SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey "
    "WHEN 11 THEN 'SELECT ' || o_orderkey || '; SELECT ' || o_custkey "
    "WHEN 12 THEN 'UPDATE orders SET o_totalprice = 0 WHERE o_orderkey = ' || o_orderkey "
    "WHEN 13 THEN 'SELECT * FROM orders WHERE o_orderpriority = '''' OR ''1''=''1'' AND o_custkey = ' || o_custkey "
    "WHEN 14 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || o_custkey || ' UNION SELECT NULL' "
    "WHEN 15 THEN 'SHOW TABLES' "
    "WHEN 16 THEN 'SELECT ''a;b ' || o_orderkey || ''' AS x FROM orders' "
    "WHEN 17 THEN '-- daily report ' || o_orderkey || chr(10) || 'SELECT 1 AS one' "
    "WHEN 18 THEN '/* report' || chr(10) || o_orderkey || ' */ SELECT o_orderkey FROM orders' "
    "WHEN 19 THEN 'WITH t AS (SELECT 1 AS a)' || chr(10) || '-- main part' || chr(10) || 'SELECT a + ' || o_orderkey || ' FROM t' "
    "WHEN 20 THEN 'WITH t AS (SELECT 1 AS \"a) DELETE ' || o_orderkey || '\") SELECT * FROM t' "
    "WHEN 21 THEN 'SELECT ''it''''s -- no; comment'' AS note, ' || o_orderkey || ' AS n' "
    "WHEN 22 THEN 'SELECT o_orderkey FROM orders WHERE o_orderpriority = ''p ' || o_orderkey || '''' "
    "WHEN 23 THEN 'SELECT * FROM orders WHERE o_custkey IN (7, 1' || o_custkey || ') AND o_orderpriority IN (''a'', ''b' || o_orderkey "
    "|| ''') LIMIT 2' || o_orderkey "
    "WHEN 24 THEN 'SELECT o_custkey, count(*) FROM orders WHERE o_custkey BETWEEN 3 AND 1' || o_custkey || ' AND o_orderstatus <> ''x' "
    "|| o_orderkey || ''' GROUP BY o_custkey' "
    "ELSE 'SELECT o_orderkey FROM orders WHERE no_such = ''p ' || o_orderkey || '''' END AS sql FROM orders)")

# what each shape must give, stated by hand: statement types, error, rule
VERDICTS = [
    ("SELECT", None, None),
    ("SELECT", None, None),
    ("DROP", "dangerous_operation", r"\bDROP\s+(TABLE|DATABASE|INDEX)\b"),
    ("SELECT,DELETE", "injection_detected", r";\s*(DROP|DELETE|UPDATE|INSERT)"),
    ("SELECT", "injection_detected", r"--\s*$"),
    ("SELECT", "injection_detected", r"/\*.*\*/"),
    ("", "syntax_error", "empty"),
    ("", "syntax_error", "empty"),
    ("SELECT", "dangerous_operation", r"\bGRANT\b"),
    ("SELECT", None, None),
    ("INSERT", "dangerous_operation", "statement:INSERT"),
    ("SELECT,SELECT", None, None),
    ("UPDATE", "dangerous_operation", "statement:UPDATE"),
    ("SELECT", "injection_detected", r"'\s*OR\s+'1'\s*=\s*'1"),
    ("SELECT", "injection_detected", r"UNION\s+SELECT\s+NULL"),
    ("SHOW", "dangerous_operation", "statement:SHOW"),
    *[("SELECT", None, None)] * 10,
]


# accepted by the rules but refused by Spark's parser or analysis: two statements; a
# double-quoted text, which is a string and not a name in Spark; a column that is not there
DRY_RUN_ERRORS = [11, 20, 25]


def by_shape_sql(field: int) -> str:
    """The stated value of a shape: 0 types, 1 error, 2 rule."""
    text = lambda v: "NULL" if v is None else lit(v)
    return f"CASE query_id % {SHAPES} " + " ".join(f"WHEN {i} THEN {text(v[field])}" for i, v in enumerate(VERDICTS)) + " END"


def first_hit_sql(x: str, patterns: list[str]) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {lit('(?i)' + p.replace('.*', '[^' + chr(10) + ']*'))}) THEN {i}"
                     for i, p in enumerate(patterns))
    return f"(CASE {whens} END)"


def audit_sql() -> str:
    return (f"(SELECT *, error_type IS NULL AS is_valid FROM (SELECT query_id, sql, {by_shape_sql(1)} AS error_type, "
            f"{by_shape_sql(2)} AS rule FROM {SQL_LOG}))")


EXAMPLE_PAIRS = (
    "(SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS log_id, u.text AS question, "
    "a.text AS sql, CASE u.turn % 3 WHEN 0 THEN '[\"text\", \"role\"]' WHEN 1 THEN '[broken' END AS selected_columns, "
    "u.conv_id * 60 + u.turn AS added_at FROM conversations u JOIN conversations a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')")
ALL_TURN_PAIRS = (
    "(SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS log_id, a.text AS question, "
    "b.text AS sql FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)")
DELETE_IDS = ("(SELECT DISTINCT unnest([CAST(conv_id AS VARCHAR) || '-0', CAST(conv_id AS VARCHAR) || '-99']) AS log_id "
              "FROM conversations)")


def example_hits_sql() -> str:
    ex_v = term_vectors_sql(EXAMPLE_PAIRS, "log_id", "question")
    q_v = term_vectors_sql("benchmark", "item_id", "text")
    top = sparse_topk_sql(ex_v, q_v, 5)
    return (f"(SELECT t.query_id, t.rank, t.id AS log_id, t.score, e.question, e.sql, e.selected_columns "
            f"FROM {top} t JOIN {EXAMPLE_PAIRS} e ON e.log_id = t.id)")


def catalog_rows_sql(cols: str, tabs: str) -> str:
    return (f"SELECT database, \"table\", \"column\", position, data_type, business_name, description, "
            f"array_to_string(keywords, ', ') AS keywords_text, array_to_string(sample_values, ' | ') AS samples_text, "
            f"null_ratio, unique_count FROM {cols} UNION ALL "
            f"SELECT database, \"table\", NULL, 0, NULL, business_name, description, NULL, NULL, NULL, row_count "
            f"FROM {tabs}")


EDITS = (
    "(SELECT CAST(position AS BIGINT) AS seq, database, \"table\", CAST(NULL AS VARCHAR) AS business_name, "
    "CAST(NULL AS VARCHAR) AS description, \"column\", CAST(NULL AS VARCHAR) AS column_business_name, "
    "'edited ' || \"column\" AS column_description FROM {cc} "
    "UNION ALL SELECT 100, database, \"table\", 'Table ' || \"table\", NULL, NULL, NULL, NULL FROM "
    "(SELECT DISTINCT database, \"table\" FROM {cc} WHERE contains(\"column\", 'key')) "
    "UNION ALL SELECT * FROM (VALUES (200, 'testdata', 'no_such_table', 'x', NULL, NULL, NULL, NULL), "
    "(201, 'testdata', 'orders', NULL, 'orders edited', 'no_such_column', 'y', NULL), "
    "(202, 'testdata', 'orders', NULL, NULL, NULL, NULL, NULL)))")


def edits_sql(cc: str) -> str:
    e = EDITS.format(cc=cc)
    given = " OR ".join(f"coalesce({c} <> '', false)" for c in
                        ["business_name", "description", "column_business_name", "column_description"])
    return f"(SELECT *, NOT ({given}) AS refused FROM {e})"


def edited_sql() -> tuple[str, str]:
    cc, ct = catalog_columns_sql(), catalog_tables_sql()
    e = edits_sql(cc)
    live = f"(SELECT * FROM {e} WHERE NOT refused)"
    tnew = (f"(SELECT database, \"table\", arg_max(business_name, seq) FILTER (WHERE business_name IS NOT NULL) AS _bn, "
            f"arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS _desc FROM {live} GROUP BY ALL)")
    cnew = (f"(SELECT database, \"table\", \"column\", "
            f"arg_max(column_business_name, seq) FILTER (WHERE column_business_name IS NOT NULL) AS _bn, "
            f"arg_max(column_description, seq) FILTER (WHERE column_description IS NOT NULL) AS _desc "
            f"FROM {live} WHERE \"column\" IS NOT NULL GROUP BY ALL)")
    t = (f"(SELECT t.* REPLACE (coalesce(n._bn, t.business_name) AS business_name, "
         f"coalesce(n._desc, t.description) AS description) FROM {ct} t LEFT JOIN {tnew} n USING (database, \"table\"))")
    c = (f"(SELECT c.* REPLACE (coalesce(n._bn, c.business_name) AS business_name, "
         f"coalesce(n._desc, c.description) AS description) FROM {cc} c "
         f"LEFT JOIN {cnew} n USING (database, \"table\", \"column\"))")
    return t, c


def flags_raw() -> str:
    return ("concat_ws(', ', CASE WHEN is_primary_key THEN 'PK' END, "
            "CASE WHEN is_foreign_key THEN 'FK->' || foreign_key_ref END, CASE WHEN NOT nullable THEN 'NOT NULL' END)")


def column_line_sql(full: bool) -> str:
    facts = ["\"column\" || ' ' || data_type", "CASE WHEN is_primary_key THEN 'key' END",
             "CASE WHEN is_foreign_key THEN 'references ' || foreign_key_ref END", "CASE WHEN NOT nullable THEN 'required' END"]
    if full:
        distinct = "list_filter(sample_values, lambda v, i: list_position(sample_values, v) = i)[1:5]"
        facts += ["CASE WHEN business_name IS NOT NULL AND business_name <> '' THEN 'means ' || business_name END",
                  f"CASE WHEN len(sample_values) > 0 THEN 'values ' || array_to_string({distinct}, ' / ') END"]
    return f"'  ' || concat_ws('; ', {', '.join(facts)})"


def schema_text_sql(variant: str) -> str:
    cc, ct = catalog_columns_sql(), catalog_tables_sql()
    head = "'TABLE ' || \"table\""
    if variant in ("full", "tables"):
        head = f"concat_ws(': ', {head}, CASE WHEN business_name <> '' THEN business_name END)"
    if variant == "tables":
        return f"SELECT database, \"table\", {head} AS text FROM {ct}"
    if variant == "full":
        head = f"concat_ws(chr(10), {head}, CASE WHEN description <> '' THEN description END)"
    lines = (f"(SELECT database, \"table\", string_agg({column_line_sql(variant == 'full')}, chr(10) "
             f"ORDER BY position) AS lines FROM {cc} GROUP BY ALL)")
    return (f"SELECT database, \"table\", {head} || chr(10) || coalesce(lines, '') AS text "
            f"FROM {ct} LEFT JOIN {lines} USING (database, \"table\")")


def name_variants_sql(c: str) -> str:
    allv = (f"list_concat(list_concat(list_concat([{c}, replace({c}, '_', ''), replace({c}, '_', ' ')], "
            f"string_split({c}, '_')), regexp_extract_all({c}, '[가-힣]{{2,}}')), "
            f"list_transform(regexp_extract_all({c}, '[a-zA-Z]{{2,}}'), lambda w: lower(w)))")
    return f"list_sort(list_distinct(list_filter({allv}, lambda x: x <> '')))"


def column_doc_sql() -> str:
    v = name_variants_sql('"column"')
    return ("concat_ws(' | ', 'table: ' || \"table\", 'column: ' || \"column\", 'type: ' || data_type, "
            "'business name: ' || coalesce(business_name, ''), 'description: ' || coalesce(description, ''), "
            f"CASE WHEN len({v}) > 0 THEN 'name variants: ' || array_to_string({v}, ', ') END, "
            "CASE WHEN len(keywords) > 0 THEN 'keywords: ' || array_to_string(keywords, ', ') END, "
            "CASE WHEN len(sample_values) > 0 THEN 'samples: ' || array_to_string(sample_values[1:5], ', ') END)")


def table_docs_sql() -> str:
    cc, ct = catalog_columns_sql(), catalog_tables_sql()
    cols = f"(SELECT database, \"table\", string_agg(\"column\", ', ' ORDER BY position) AS _cols FROM {cc} GROUP BY ALL)"
    return (f"(SELECT t.database, t.\"table\", t.business_name, concat_ws(' | ', 'table: ' || t.\"table\", "
            f"'business name: ' || coalesce(t.business_name, ''), 'description: ' || coalesce(t.description, ''), "
            f"'columns: ' || coalesce(c._cols, ''), CASE WHEN t.comment IS NOT NULL AND t.comment <> '' "
            f"THEN 'comment: ' || t.comment END) AS document FROM {ct} t LEFT JOIN {cols} c USING (database, \"table\"))")


# DuckDB spellings where the dialects differ (same result, Spark's result types)
PASS_SQL = {
    "pass_dates": (
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n, "
        "CAST(min(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS INTEGER) AS first_day "
        "FROM orders GROUP BY 1, 2"),
    "pass_window": (
        "SELECT o_orderkey, o_custkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, "
        "o_orderkey) AS INTEGER) AS rnk, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, "
        "o_orderkey) AS prev_order, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3 FROM orders"),
}


def oracle_queries() -> dict[str, str]:
    from colscope.plans.registry import GOOD_SQL
    cc, ct = catalog_columns_sql(), catalog_tables_sql()
    cc0, ct0 = catalog_columns_sql(False), catalog_tables_sql(False)
    stats = f"({col_stats_sql()})"
    smp = f"({samples_sql()})"
    out: dict[str, str] = {}
    out["load_counts"] = " UNION ALL ".join(
        f"SELECT {lit(t)} AS \"table\", {len(SCHEMAS[t])} AS column_count, count(*) AS row_count FROM {t}"
        for t in sorted(SCHEMAS))
    vals = ", ".join(f"({lit(DB)}, {lit(t)}, {i}, {lit(c)}, {lit(ty)}, true)"
                     for t in sorted(SCHEMAS) for i, (c, ty) in enumerate(SCHEMAS[t], start=1))
    out["schema_columns"] = (f"SELECT * FROM (VALUES {vals}) v(database, \"table\", position, \"column\", data_type, "
                             f"nullable)")
    out["row_counts"] = row_counts_sql()
    out["sample_values"] = f"SELECT \"table\", \"column\", position, rank, value FROM {smp}"
    out["null_ratio"] = f"SELECT \"table\", \"column\", row_count, nulls, null_ratio FROM {stats}"
    out["distinct_count"] = f"SELECT \"table\", \"column\", unique_count FROM {stats}"
    out["canonical_text"] = (
        f"SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, "
        f"{jfloat('l_extendedprice')} AS l_extendedprice, "
        f"CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR) AS t_decimal, "
        f"CAST(l_shipdate AS VARCHAR) AS l_shipdate, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS t_date, "
        f"CAST(l_returnflag = 'R' AS VARCHAR) AS t_bool, "
        f"'<bytes:' || CAST(octet_length(encode(l_returnflag || l_linestatus)) AS VARCHAR) || '>' AS t_bytes, "
        f"l_linestatus FROM lineitem")
    out["candidate_keys"] = f"SELECT \"table\", \"column\" FROM ({col_stats_sql(SCHEMAS)}) WHERE is_key"
    out["candidate_keys_composite"] = composite_keys_sql()
    out["inclusion_keys"] = inclusion_sql()
    out["distinct_count_approx_within"] = " UNION ALL ".join(
        f"SELECT {lit(t)} AS \"table\", {lit(c)} AS \"column\", true AS within FROM (SELECT count(*) FROM {t})"
        for t, cols in SCHEMAS.items() for c, _ in cols)
    out["distinct_count_merged"] = out["distinct_count_approx_within"]
    out["annotation_strict"] = (
        f"SELECT 'all' AS replies, 'merged' AS state, count(*) AS tables FROM {ct} UNION ALL "
        f"SELECT 'one missing', 'table annotation failed for: [''orders'']', 0 UNION ALL "
        f"SELECT 'one no object', 'table annotation failed for: [''part'']', 0")
    out["inclusion_keys_decimal"] = (
        "SELECT 'sold' AS fk_table, 'price' AS fk_column, 'prices' AS key_table, 'listed' AS key_column, "
        "count(DISTINCT CAST(l_extendedprice AS DECIMAL(12, 2))) AS fk_distinct FROM lineitem")
    out["profile_partial"] = f"SELECT \"table\", \"column\", unique_count FROM ({col_stats_sql(SCHEMAS)})"
    out["catalog_status"] = (f"SELECT {lit(DB)} AS database, (SELECT count(*) FROM {ct}) AS table_count, 'today' AS age_text, "
                             f"(SELECT count(*) FROM {EXAMPLE_PAIRS}) AS example_count")
    items = f"(SELECT count(*) FROM {ct}) + (SELECT count(*) FROM {cc})"
    out["store_cleared"] = (f"SELECT 'columns' AS store, (SELECT count(*) FROM {cc}) AS before, 0 AS after UNION ALL "
                            f"SELECT 'index', {items}, 0 UNION ALL SELECT 'examples', (SELECT count(*) FROM {EXAMPLE_PAIRS}), 0")
    out["index_rebuild"] = f"SELECT 'full' AS rebuild, {items} AS items UNION ALL SELECT 'empty', 0"
    out["declared_keys"] = f"SELECT \"table\", \"column\", is_primary_key, is_foreign_key, foreign_key_ref FROM {cc0}"
    out["table_header"] = (f"SELECT database, \"table\", coalesce(business_name, '-') AS business_name, "
                           f"coalesce(description, '') AS description, row_count FROM {ct}")
    out["schema_text_database"] = (f"SELECT database, string_agg(text, chr(10) || chr(10) ORDER BY \"table\") AS text "
                                   f"FROM ({schema_text_sql('full')}) GROUP BY ALL")
    out["score_fusion_table_filter"] = fused_out(10, filter_table="t3")
    dry = [m for m, (_, e, _) in enumerate(VERDICTS) if e is None and m not in DRY_RUN_ERRORS]
    out["dry_run_audit"] = (
        f"SELECT query_id % {SHAPES} AS shape, min(query_id) AS query_id, query_id % {SHAPES} IN ({', '.join(map(str, dry))}) AS is_valid, "
        f"CASE WHEN query_id % {SHAPES} IN ({', '.join(map(str, DRY_RUN_ERRORS))}) THEN 'execution_error' ELSE {by_shape_sql(1)} END AS error_type "
        f"FROM {SQL_LOG} GROUP BY ALL")
    out["dry_run_log"] = (
        f"SELECT query_id, query_id % {SHAPES} IN ({', '.join(map(str, dry))}) AS is_valid, "
        f"CASE WHEN query_id % {SHAPES} IN ({', '.join(map(str, DRY_RUN_ERRORS))}) THEN 'execution_error' ELSE {by_shape_sql(1)} END AS error_type "
        f"FROM {SQL_LOG}")
    amount = "sum(CAST(l_extendedprice AS DECIMAL(18, 2)))"
    out["reconcile_claims"] = (
        f"SELECT level, l_returnflag, CAST(actual + wrong AS DOUBLE) AS claimed, CAST(actual AS DOUBLE) AS actual, "
        f"CAST(wrong AS DOUBLE) AS diff, wrong = 0 AS ok FROM (SELECT 1 AS level, l_returnflag, {amount} AS actual, "
        f"CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS wrong FROM lineitem GROUP BY l_returnflag "
        f"UNION ALL SELECT 0, NULL, {amount}, 0 FROM lineitem) UNION ALL "
        f"SELECT 1, '?', CAST({amount} AS DOUBLE), NULL, NULL, false FROM lineitem")
    out["enum_values"] = enum_sql()
    out["profile_all"] = (
        f"SELECT {lit(DB)} AS database, s.\"table\", s.position, s.\"column\", s.data_type, true AS nullable, "
        f"false AS is_primary_key, false AS is_foreign_key, s.null_ratio, s.unique_count, "
        f"coalesce(sm.t, '') AS samples_text FROM {stats} s LEFT JOIN (SELECT \"table\", \"column\", "
        f"string_agg(value, ' | ' ORDER BY rank) AS t FROM {smp} GROUP BY ALL) sm USING (\"table\", \"column\")")
    out["catalog_roundtrip"] = catalog_rows_sql(cc, ct)
    out["catalog_list"] = f"SELECT {lit(DB)} AS database UNION ALL SELECT {lit(DB + '_copy')}"
    et, ec = edited_sql()
    out["catalog_edit"] = (f"SELECT database, \"table\", \"column\", business_name, description FROM "
                           f"({catalog_rows_sql(ec, et)})")
    e = edits_sql(cc)
    out["catalog_edit_report"] = (
        f"SELECT e.seq, e.database, e.\"table\", e.\"column\", e.refused, (t.\"table\" IS NOT NULL) AS table_found, "
        f"CASE WHEN e.\"column\" IS NULL THEN NULL ELSE (c.\"column\" IS NOT NULL) END AS column_found, "
        f"(NOT e.refused AND t.\"table\" IS NOT NULL) AS applied FROM {e} e "
        f"LEFT JOIN (SELECT database, \"table\" FROM {ct}) t ON t.database = e.database AND t.\"table\" = e.\"table\" "
        f"LEFT JOIN (SELECT database, \"table\", \"column\" FROM {cc}) c ON c.database = e.database "
        f"AND c.\"table\" = e.\"table\" AND c.\"column\" = e.\"column\"")
    out["catalog_overview"] = (
        f"SELECT t.database, t.\"table\", coalesce(t.business_name, '-') AS business_name, "
        f"coalesce(n.column_count, 0) AS column_count, CASE WHEN t.row_count > 0 THEN format('{{:,}}', t.row_count) "
        f"ELSE '-' END AS row_count_text FROM {ct} t LEFT JOIN (SELECT database, \"table\", count(*) AS column_count "
        f"FROM {cc} GROUP BY ALL) n USING (database, \"table\")")
    out["table_detail"] = (
        f"SELECT database, \"table\", position, \"column\", data_type, "
        f"concat_ws(', ', CASE WHEN is_primary_key THEN 'PK' END, CASE WHEN is_foreign_key THEN 'FK' END) AS flags, "
        f"coalesce(business_name, '-') AS business_name, coalesce(description, '') AS description, "
        f"array_to_string(keywords[1:6], ', ') AS keywords_text, "
        f"array_to_string(list_transform(sample_values[1:5], lambda v: {trunc_sql('v', 30)}), ', ') AS samples_text "
        f"FROM {cc}")
    out["schema_text_raw"] = schema_text_sql("raw")
    out["schema_text_full"] = schema_text_sql("full")
    out["schema_text_tables"] = schema_text_sql("tables")
    out["schema_summary"] = (
        f"SELECT database, \"table\", coalesce(t.business_name, '-') AS label, coalesce(c.n, 0) AS column_count, "
        f"coalesce(c.cols, '') AS columns FROM {ct} t LEFT JOIN (SELECT database, \"table\", count(*) AS n, "
        f"string_agg(\"column\" || CASE WHEN coalesce(business_name, '') <> '' THEN '=' || business_name ELSE '' END, ' | ' "
        f"ORDER BY position) AS cols FROM {cc} GROUP BY ALL) c USING (database, \"table\")")
    creq = (
        "CAST(to_json({'item': c.\"table\" || '.' || c.\"column\", 'values': {'type': c.data_type, 'optional': c.nullable, "
        "'examples': c.sample_values[1:10], 'distinct': coalesce(c.unique_count, -1)}, "
        "'keys': {'primary': c.is_primary_key, 'references': coalesce(c.foreign_key_ref, '')}, "
        "'notes': [coalesce(c.comment, ''), coalesce(t.comment, '')]}) AS VARCHAR)")
    facts = ("{'name': \"column\", 'type': data_type, 'key': is_primary_key, 'references': coalesce(foreign_key_ref, '')}")
    treq = ("CAST(to_json({'table': t.\"table\", 'comment': coalesce(t.comment, ''), 'rows': coalesce(t.row_count, 0), "
            "'columns': l.facts}) AS VARCHAR)")
    out["annotation_requests"] = (
        f"SELECT c.database, c.\"table\", c.\"column\", {creq} AS request FROM {cc0} c "
        f"LEFT JOIN {ct0} t USING (database, \"table\") UNION ALL "
        f"SELECT t.database, t.\"table\", NULL, {treq} FROM {ct0} t LEFT JOIN (SELECT database, \"table\", "
        f"list({facts} ORDER BY position) AS facts FROM {cc0} GROUP BY ALL) l USING (database, \"table\")")
    plain = ("'{\"business_name\": \"' || p_name || '\", \"description\": \"part of ' || p_brand || "
             "'\", \"keywords\": [\"' || p_type || '\", \"' || p_brand || '\"]}'")
    replies = (f"(SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN {plain} "
               f"WHEN 1 THEN '```json' || chr(10) || {plain} || chr(10) || '```' "
               f"WHEN 2 THEN '{{\"business_name\": \"' || p_name || '\", \"description\": ' "
               f"WHEN 3 THEN '{{\"description\": \"size ' || CAST(p_size AS VARCHAR) || '\"}}' ELSE '' END AS reply "
               f"FROM part)")
    out["annotation_parse"] = (
        f"SELECT key, state, p_business_name AS business_name, p_description AS description, "
        f"array_to_string(coalesce(p_keywords, CAST([] AS VARCHAR[])), ', ') AS keywords_text FROM {parse_sql(replies, 'reply')}")
    out["annotation_merge"] = (f"SELECT database, \"table\", \"column\", business_name, description, "
                               f"keywords_text FROM ({catalog_rows_sql(cc, ct)})")
    cols_v = ", ".join(f"({lit(t)}, {lit(c)})" for t in sorted(SCHEMAS) for c, _ in SCHEMAS[t])
    out["name_variants"] = (f"SELECT \"table\", \"column\", array_to_string({name_variants_sql(chr(34) + 'column' + chr(34))}, ', ') "
                            f"AS variants FROM (VALUES {cols_v}) v(\"table\", \"column\")")
    out["table_documents"] = f"SELECT database, \"table\", document FROM {table_docs_sql()}"
    out["column_documents"] = f"SELECT database, \"table\", \"column\", {column_doc_sql()} AS document FROM {cc}"
    out["index_items"] = (
        f"SELECT database || '.' || \"table\" AS id, 'table' AS type, database, \"table\", NULL AS \"column\", "
        f"NULL AS data_type, coalesce(business_name, \"table\") AS business_name, document FROM {table_docs_sql()} "
        f"UNION ALL SELECT database || '.' || \"table\" || '.' || \"column\", 'column', database, \"table\", \"column\", "
        f"data_type, coalesce(business_name, \"column\"), {column_doc_sql()} FROM {cc}")
    tv_docs = term_vectors_sql("documents", "doc_id", "text")
    tv_bench = term_vectors_sql("benchmark", "item_id", "text")
    out["term_vectors"] = f"SELECT id, bucket, round(weight, 9) AS weight FROM {tv_docs}"
    out["cosine_topk"] = f"SELECT query_id, id, cand_rank AS rank, round(score, 6) AS score FROM {vec_candidates_sql(40)}"
    out["cosine_topk_sparse"] = (f"SELECT query_id, id, rank, round(score, 6) AS score FROM "
                                 f"{sparse_topk_sql(tv_docs, tv_bench, 5)}")
    out["score_fusion"] = fused_out(10)
    out["score_fusion_filtered"] = fused_out(10, "column")
    f5 = fused_sql(5)
    line = ("CASE WHEN type = 'table' THEN (CASE WHEN NOT seen THEN '[table] ' || \"table\" || ' (' || "
            "coalesce(business_name, '') || ')' END) ELSE (CASE WHEN seen THEN '  - ' ELSE '[column] ' || \"table\" || "
            "'.' END) || \"column\" || ' (' || data_type || '): ' || coalesce(business_name, '') END")
    ctx = (f"(SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS context FROM (SELECT query_id, rank, {line} "
           f"AS line FROM (SELECT *, rank > min(rank) OVER (PARTITION BY query_id, database, \"table\") AS seen "
           f"FROM {f5})) WHERE line IS NOT NULL GROUP BY query_id)")
    out["context_text"] = (f"SELECT e.vec_id AS query_id, coalesce(c.context, 'No matching tables or columns.') "
                           f"AS context FROM embeddings e LEFT JOIN {ctx} c ON c.query_id = e.vec_id")
    c20 = vec_candidates_sql(20)
    amb = (
        f"WITH c AS (SELECT *, greatest(score, 0.0) AS s FROM {c20} WHERE type = 'column'), "
        f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, \"table\", \"column\" "
        f"ORDER BY s DESC, cand_rank) AS r FROM c) WHERE r = 1), "
        f"t AS (SELECT * FROM (SELECT *, min(cand_rank) OVER (PARTITION BY query_id, \"table\") AS first, "
        f"row_number() OVER (PARTITION BY query_id, \"table\" ORDER BY s DESC, cand_rank) AS r2 FROM b) "
        f"WHERE r2 = 1 AND s >= 0.25), "
        f"k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first) AS rank FROM t), "
        f"g AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN s END) AS s1, "
        f"max(CASE WHEN rank = 2 THEN s END) AS s2 FROM k GROUP BY query_id) "
        f"SELECT k.query_id, k.rank, k.\"table\", k.\"column\", round(k.s, 6) AS score FROM k JOIN g USING (query_id) "
        f"WHERE g.n >= 2 AND g.s1 - g.s2 <= 0.05")
    out["ambiguity"] = amb
    out["examples_add"] = (f"SELECT log_id, question, sql FROM {EXAMPLE_PAIRS} UNION ALL SELECT log_id, question, sql "
                           f"FROM {ALL_TURN_PAIRS} WHERE log_id NOT IN (SELECT log_id FROM {EXAMPLE_PAIRS})")
    hits = example_hits_sql()
    out["examples_search"] = (
        f"SELECT query_id, rank, log_id, round(score, 6) AS score, CASE WHEN coalesce(json_valid(selected_columns), false) "
        f"THEN array_to_string(CAST(CAST(selected_columns AS JSON) AS VARCHAR[]), ', ') ELSE '' END AS selected_columns "
        f"FROM {hits}")
    out["examples_delete"] = (f"SELECT d.log_id, d.log_id IN (SELECT log_id FROM {EXAMPLE_PAIRS}) AS found "
                              f"FROM {DELETE_IDS} d")
    out["examples_remaining"] = (f"SELECT log_id, question, sql FROM {EXAMPLE_PAIRS} "
                                 f"WHERE log_id NOT IN (SELECT log_id FROM {DELETE_IDS})")
    out["examples_list"] = f"SELECT log_id, question, sql FROM {EXAMPLE_PAIRS} ORDER BY added_at, log_id LIMIT 50"
    pre = ("(SELECT DISTINCT unnest([k, k || '-', k || '-1']) AS prefix FROM "
           "(SELECT DISTINCT CAST(conv_id AS VARCHAR) AS k FROM conversations))")
    out["examples_prefix"] = (
        f"SELECT prefix, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS state, "
        f"CASE WHEN n = 1 THEN id END AS log_id, n AS matches FROM (SELECT p.prefix, count(e.log_id) AS n, "
        f"min(e.log_id) AS id FROM {pre} p LEFT JOIN {EXAMPLE_PAIRS} e ON starts_with(e.log_id, p.prefix) GROUP BY p.prefix)")
    block = ("'Example ' || CAST(rank AS VARCHAR) || ':' || chr(10) || 'Question: ' || question || chr(10) || "
             "'SQL: ```sql' || chr(10) || sql || chr(10) || '```'")
    out["fewshot_text"] = (f"SELECT query_id, string_agg({block}, chr(10) || chr(10) ORDER BY rank) AS fewshot "
                           f"FROM {hits} GROUP BY query_id")
    from colscope.operators.guard import DANGEROUS_PATTERNS, INJECTION_PATTERNS
    out["guard_injection"] = f"SELECT query_id, {first_hit_sql('sql', INJECTION_PATTERNS)} AS rule_index FROM {SQL_LOG}"
    out["guard_dangerous"] = f"SELECT query_id, {first_hit_sql('sql', DANGEROUS_PATTERNS)} AS rule_index FROM {SQL_LOG}"
    out["guard_statement_type"] = f"SELECT query_id, {by_shape_sql(0)} AS statement_type FROM {SQL_LOG}"
    aud = audit_sql()
    out["guard_verdict"] = f"SELECT query_id, is_valid, error_type, rule FROM {aud}"
    out["guard_summary"] = f"SELECT is_valid, error_type, rule, count(*) AS n FROM {aud} GROUP BY ALL"
    out["guarded_query"] = GOOD_SQL["guarded_query"]
    out["preview"] = (
        f"SELECT {trunc_sql('CAST(o_orderkey AS VARCHAR)', 80)} AS o_orderkey, "
        f"{trunc_sql('o_orderpriority', 80)} AS o_orderpriority, {trunc_sql(jfloat('o_totalprice'), 80)} AS o_totalprice, "
        f"{trunc_sql('CAST(o_orderdate AS VARCHAR)', 80)} AS o_orderdate FROM "
        f"(SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
    amt = "CAST(l_extendedprice AS DECIMAL(18, 2))"
    out["reconcile_totals"] = (
        f"WITH a AS (SELECT l_returnflag, l_linestatus, sum({amt}) AS total FROM lineitem GROUP BY ALL), "
        f"r AS (SELECT l_returnflag, sum({amt}) AS total FROM lineitem GROUP BY ALL), "
        f"rp AS (SELECT l_returnflag, sum(total) AS parts FROM a GROUP BY ALL), "
        f"g AS (SELECT sum({amt}) AS total FROM lineitem), gp AS (SELECT sum(total) AS parts FROM r), "
        f"x AS (SELECT 0 AS level, CAST(NULL AS VARCHAR) AS l_returnflag, CAST(NULL AS VARCHAR) AS l_linestatus, "
        f"g.total, gp.parts FROM g, gp "
        f"UNION ALL SELECT 1, r.l_returnflag, NULL, r.total, rp.parts FROM r LEFT JOIN rp USING (l_returnflag)) "
        f"SELECT level, l_returnflag, l_linestatus, CAST(total AS DOUBLE) AS total, CAST(parts AS DOUBLE) AS parts_sum, "
        f"CAST(total - coalesce(parts, 0) AS DOUBLE) AS diff, abs(total - coalesce(parts, 0)) <= 0 AS ok FROM x")
    for k, v in GOOD_SQL.items():
        if k.startswith("pass_"):
            out[k] = PASS_SQL.get(k, v)
    return out
