"""Queries of the text functions and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import align, distance
from veriframe.functions import text as T
from veriframe.plans import sql as S
from veriframe.plans.fixtures import lines, names, table

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_NORMED = f"SELECT label, name, reading, {S.norm('name')} AS a, {S.norm('reading')} AS b FROM ({S.NAMES})"


def _normed(spark, d):
    return names(spark, d).withColumn("a", T.normalize("name")).withColumn("b", T.normalize("reading"))


@query(f"SELECT doc_id, CAST(length({S.norm('text')}) AS BIGINT) AS n, md5({S.norm('text')}) AS digest FROM documents")
def text_normalize(spark, d):
    n = T.normalize("text")
    return table(spark, d, "documents").select("doc_id", F.length(n).cast("long").alias("n"), F.md5(n.cast("binary")).alias("digest"))


@query(
    f"SELECT item_id, array_to_string(list_append(list_filter(range(0, length(text)), lambda i: {S.norm('substr(text, CAST(i AS INT) + 1, 1)')} <> '' OR (i > 0 AND regexp_matches(substr(text, CAST(i AS INT), 3), '^\\p{{Nd}}[.,]\\p{{Nd}}$'))), length(text)), ',') AS places FROM benchmark"
)
def text_offsets(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.offsets("text").cast("array<string>"), ",").alias("places"))


@query(f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n, array_to_string(x, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all({S.norm('text')}, '[0-9.]+') AS x FROM documents)")
def text_numbers(spark, d):
    x = T.numbers(T.normalize("text"))
    return table(spark, d, "documents").select("doc_id", F.size(x).cast("long").alias("n"), F.array_join(x, " ").alias("numbers"))


@query(f"SELECT doc_id, array_to_string({S.histogram('t')}, ',') AS counts FROM (SELECT doc_id, {S.norm('text')} AS t FROM documents)")
def text_histogram(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.normalize("text").alias("t"))
    return t.select("doc_id", F.array_join(T.histogram("t").cast("array<string>"), ",").alias("counts"))


_SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"WITH s AS (SELECT unnest(string_split('{_SYMBOLS}', '')) AS c) SELECT x.c AS a, y.c AS b, CAST({S.cost('x.c', 'y.c')} AS INT) AS cost FROM s x, s y")
def text_substitution_costs(spark, d):
    rows = [(a, b, align.substitution(a, b, 1)) for a in _SYMBOLS for b in _SYMBOLS]
    return spark.createDataFrame(rows, "a string, b string, cost int")


@query(f"SELECT label, CAST({S.half_edits('a', 'b')} AS INT) AS cost, round({S.half_edits('a', 'b')} / (2.0 * length(a)), 6) AS dist FROM ({_NORMED})")
def text_half_edits(spark, d):
    cost = distance.half_edits(F.col("a"), F.col("b"))
    return _normed(spark, d).withColumn("cost", cost).select("label", "cost", F.round(F.col("cost") / (2.0 * F.length("a")), 6).alias("dist"))


@query(f"SELECT label, list_sum(list_transform(list_zip({S.histogram('a')}, {S.histogram('b')}), lambda z: greatest(z[1] - z[2], 0)))::INT AS deficit FROM ({_NORMED})")
def text_deficit(spark, d):
    return _normed(spark, d).select("label", T.deficit(T.histogram("a"), T.histogram("b")).cast("int").alias("deficit"))


@query(
    "SELECT label, CAST(v // 1000000000000 AS INT) AS cost, CAST(v % 1000000 AS INT) AS start, CAST(v // 1000000 % 1000000 AS INT) AS stop "
    f"FROM (SELECT label, {S.infix_span('a', 'b')} AS v FROM ({_NORMED}))"
)
def text_infix(spark, d):
    """The best stretch of each reading: what it costs, where it starts and where it stops."""
    m = _normed(spark, d).withColumn("m", distance.infix(F.col("a"), F.col("b")))
    return m.select("label", "m.cost", "m.start", "m.stop")


@query(f"SELECT label, round({S.common('b', 'a')} / CAST(length(b) AS DOUBLE), 6) AS agreement, round({S.common('b', 'a')} / CAST(length(a) AS DOUBLE), 6) AS coverage FROM ({_NORMED})")
def text_agreement(spark, d):
    m = _normed(spark, d).withColumn("m", distance.agreement("b", "a"))
    return m.select("label", F.round("m.agreement", 6).alias("agreement"), F.round("m.coverage", 6).alias("coverage"))


@query(f"SELECT label, round({S.half_edits('r', 'w')} / (2.0 * length(r)), 6) AS dist FROM (SELECT label, substr(b, 1, length(a)) AS r, substr(a, 1, length(substr(b, 1, length(a))) + 8) AS w FROM ({_NORMED}))")
def text_prefix_distance(spark, d):
    return _normed(spark, d).select("label", F.round(distance.prefix_distance("b", "a"), 6).alias("dist"))


_MEET = f"{S.cost('left(a, 1)', 'left(b, 1)')} < 2 AND {S.cost('right(a, 1)', 'right(b, 1)')} < 2"


@query(f"SELECT label, ({_MEET}) AS meet FROM ({_NORMED})")
def text_ends_meet(spark, d):
    return _normed(spark, d).select("label", distance.ends_meet(F.col("a"), F.col("b")).alias("meet"))


@query(rf"SELECT label, det_idx, regexp_matches(text, '\p{{L}}') AND NOT regexp_matches(text, '\p{{Ll}}') AS capitals FROM ({S.lines()})")
def text_is_upper(spark, d):
    return lines(spark, d).select("label", "det_idx", T.is_upper("text").alias("capitals"))


@query(
    f"SELECT item_id, s AS span, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(s, ' ' || chr(9) || chr(10)), '\\s+'), lambda w: {S.norm('w')}), lambda w: w <> ''), ' ') AS words FROM (SELECT item_id, CASE WHEN length(text) >= 19 THEN substr(text, 1, 19) ELSE '' END AS s FROM benchmark)"
)
def text_header_words(spark, d):
    s = T.span_text("text", F.lit(0), F.lit(19))
    return table(spark, d, "benchmark").select("item_id", s.alias("span"), F.array_join(T.header_words(s), " ").alias("words"))


@query(f"SELECT label, substr(reading, CAST(instr(upper(reading), upper(name)) AS INT), length(name)) || CASE WHEN contains(reading, ',') THEN ',' ELSE '' END AS quoted FROM ({S.NAMES}) WHERE contains(upper(reading), upper(name))")
def text_quote(spark, d):
    m = _normed(spark, d).withColumn("at", T.offsets("reading")).withColumn("i", (F.position(F.col("a"), F.col("b")) - 1).cast("int")).filter("i >= 0")
    return m.select("label", T.quote("reading", "at", F.col("i"), (F.col("i") + F.length("a")).cast("int"), F.lit("")).alias("quoted"))


_DESIGNATION = "CASE p_partkey % 4 WHEN 0 THEN 'Bourbon Whiskey' WHEN 1 THEN 'SCOTCH WHISKY' WHEN 2 THEN 'rye whisky and whiskey' ELSE p_type END"


@query(
    f"SELECT label, array_to_string(list_filter([CASE WHEN contains(t, 'whiskey') THEN replace(t, 'whiskey', 'whisky') END, CASE WHEN contains(t, 'WHISKEY') THEN replace(t, 'WHISKEY', 'WHISKY') END, CASE WHEN contains(t, 'Whiskey') THEN replace(t, 'Whiskey', 'Whisky') END, "
    f"CASE WHEN contains(t, 'whisky') THEN replace(t, 'whisky', 'whiskey') END, CASE WHEN contains(t, 'WHISKY') THEN replace(t, 'WHISKY', 'WHISKEY') END, CASE WHEN contains(t, 'Whisky') THEN replace(t, 'Whisky', 'Whiskey') END], lambda x: x IS NOT NULL), '|') AS spellings FROM (SELECT p_partkey AS label, {_DESIGNATION} AS t FROM part)"
)
def text_spellings(spark, d):
    t = F.expr(_DESIGNATION)
    return table(spark, d, "part").select(F.col("p_partkey").alias("label"), t.alias("t")).select("label", F.array_join(T.other_spellings("t"), "|").alias("spellings"))


_NUMBER = "CASE p_partkey % 3 WHEN 0 THEN p_size / 2.0 WHEN 1 THEN (p_size * 50) / 29.5735 ELSE p_retailprice END"
_P = ["s", "printf('%.1f', v)", S.trimmed("printf('%.1f', v)"), "printf('%.2f', v)", S.trimmed("printf('%.2f', v)")]


@query(
    f"SELECT label, array_to_string(list_filter([{', '.join(_P)}], lambda x, i: list_position([{', '.join(_P)}], x) = i), '|') AS printed FROM (SELECT label, v, {S.shortest('v')} AS s FROM (SELECT p_partkey AS label, CAST({_NUMBER} AS DOUBLE) AS v FROM part))"
)
def text_printings(spark, d):
    v = F.expr(f"cast({_NUMBER.replace('29.5735', '29.5735D').replace('2.0', '2.0D')} as double)")
    return table(spark, d, "part").select(F.col("p_partkey").alias("label"), v.alias("v")).select("label", F.array_join(T.printings("v"), "|").alias("printed"))


@query(
    f"SELECT p_partkey AS label, {S.shortest('v')} || '% Alc./Vol.' AS abv, {S.shortest('(2 * v)')} || ' Proof' AS proof, CASE WHEN ml >= 1000 THEN {S.shortest('(ml / 1000)')} || ' L' ELSE {S.shortest('ml')} || ' mL' END AS net FROM (SELECT p_partkey, p_size / CAST(2 AS DOUBLE) AS v, CAST(p_size * 50 AS DOUBLE) AS ml FROM part)"
)
def text_display(spark, d):
    v, ml = F.col("p_size") / 2.0, (F.col("p_size") * 50).cast("double")
    return table(spark, d, "part").select(F.col("p_partkey").alias("label"), T.abv_text(v).alias("abv"), T.proof_text(v).alias("proof"), T.net_text(ml).alias("net"))


@query("SELECT page_id, lower(list_last(string_split(url, '/'))) AS key FROM pages")
def text_basename(spark, d):
    return table(spark, d, "pages").select("page_id", T.basename("url").alias("key"))


@query("SELECT s_suppkey, 'Supplier Of ' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS title FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def text_title(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    return s.select("s_suppkey", T.title_words(F.concat(F.lit("SUPPLIER OF "), "n_name")).alias("title"))


@query(
    "SELECT item_id, CAST(k - 1 AS INT) AS k, w AS word, s - length(w) - 1 >= 5 AND s - 1 <= 40 AS heavy FROM (SELECT item_id, k, w, sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY k) AS s FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM benchmark))"
)
def text_heavy_words(spark, d):
    """Words that lie wholly within characters 5 to 40."""
    from pyspark.sql.window import Window

    w = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("k", "word"))
    s = F.sum(F.length("word") + 1).over(Window.partitionBy("item_id").orderBy("k"))
    return w.withColumn("s", s).select("item_id", "k", "word", ((F.col("s") - F.length("word") - 1 >= 5) & (F.col("s") - 1 <= 40)).alias("heavy"))


@query("SELECT item_id, sha256(text) AS pin FROM benchmark")
def text_pin(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("pin"))


_FNV = "list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split({x}, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query(f"SELECT s_suppkey, CAST(h AS BIGINT) AS hash, round((h % 16777216) / CAST(16777216 AS DOUBLE), 9) AS share, (h % 16777216) / CAST(16777216 AS DOUBLE) < 0.25 AS evaluation FROM (SELECT s_suppkey, {_FNV.format(x='s_name')} AS h FROM supplier)")
def hash_partition(spark, d):
    share = T.unit_share("s_name")
    return table(spark, d, "supplier").select("s_suppkey", T.fnv1a32("s_name").alias("hash"), F.round(share, 9).alias("share"), (share < 0.25).alias("evaluation"))


@query("SELECT p_partkey, substr(sha256('v' || p_size || chr(0) || p_brand || chr(0) || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || chr(0) || 'det=' || p_type || chr(0) || 'rec=' || p_name), 1, 12) AS fingerprint FROM part")
def hash_fingerprint(spark, d):
    models = F.create_map(F.lit("rec"), F.col("p_name"), F.lit("det"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", T.fingerprint(F.concat(F.lit("v"), F.col("p_size").cast("string")), "p_brand", F.col("p_size") % 2 == 0, models).alias("fingerprint"))
