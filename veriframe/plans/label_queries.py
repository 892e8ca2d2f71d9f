"""Queries of geometry, claims, decisions, passages, evaluation, guards and recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe import sinks
from veriframe.functions import registered
from veriframe.functions import text as T
from veriframe.operators import claims as C
from veriframe.operators import decide, diagnose, evaluate, geometry, guards, ocrpost, reference
from veriframe.plans import sql as S
from veriframe.plans.fixtures import lines, names, one_box, table, uneven, words
from veriframe.staging import dealt

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Geometry.

_KEPT = f"SELECT * FROM ({S.lines()}) WHERE confidence >= 0.5 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"


@query(f"SELECT label, det_idx, text, confidence FROM ({_KEPT})")
def geometry_kept(spark, d):
    return geometry.kept(lines(spark, d)).select("label", "det_idx", "text", "confidence")


@query(S.in_reading_order(S.uneven()))
def geometry_reading_order(spark, d):
    return geometry.reading_order(uneven(spark, d)).select("label", "det_idx", "pos")


@query(
    f"WITH o AS ({S.in_reading_order(S.uneven())}), w AS (SELECT u.*, o.pos FROM ({S.uneven()}) u JOIN o ON o.label = u.label AND o.det_idx = u.det_idx) SELECT label, a, b FROM "
    f"(SELECT a.label, a.pos AS a, b.pos AS b, row_number() OVER (PARTITION BY a.label, a.pos ORDER BY b.pos) AS k FROM w a JOIN w b ON a.label = b.label AND a.pos <> b.pos AND {S.FOLLOWS}) WHERE k <= 4"
)
def geometry_successors_uneven(spark, d):
    """Successors among lines that run into each other."""
    return geometry.successors(geometry.reading_order(uneven(spark, d)))


_EDGES = (
    "SELECT label, a, b FROM (SELECT a.label, a.det_idx AS a, b.det_idx AS b, row_number() OVER (PARTITION BY a.label, a.det_idx ORDER BY b.det_idx) AS k "
    f"FROM w a JOIN w b ON a.label = b.label AND a.det_idx <> b.det_idx AND {S.FOLLOWS}) WHERE k <= 4"
)


@query(f"WITH w AS ({S.words()}) {_EDGES}")
def geometry_successors(spark, d):
    return geometry.successors(geometry.reading_order(words(spark, d)))


_WIDTH = f"length({S.norm('text')})"
_PATHS = (
    f"w AS ({S.words()}), n AS (SELECT *, {_WIDTH} AS nw FROM w), e AS ({_EDGES}), "
    "p1 AS (SELECT label, [det_idx] AS path, x0, y0, x1, y1, text, confidence, 1 AS parts, nw AS widest, det_idx AS last FROM n)"
)
for _k in (2, 3, 4):
    _PATHS += (
        f", p{_k} AS (SELECT p.label, list_append(p.path, n.det_idx) AS path, least(p.x0, n.x0) AS x0, least(p.y0, n.y0) AS y0, greatest(p.x1, n.x1) AS x1, greatest(p.y1, n.y1) AS y1, "
        f"p.text || ' ' || n.text AS text, least(p.confidence, n.confidence) AS confidence, {_k} AS parts, greatest(p.widest, n.nw) AS widest, n.det_idx AS last FROM p{_k - 1} p JOIN e ON e.label = p.label AND e.a = p.last JOIN n ON n.label = p.label AND n.det_idx = e.b)"
    )
_PATHS += ", paths AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)"
_PATH_COLUMNS = "label, array_to_string(path, '-') AS path, text, x0, y0, x1, y1, CAST(parts AS INT) AS parts, CAST(widest AS INT) AS widest"


@query(f"WITH {_PATHS} SELECT {_PATH_COLUMNS} FROM paths")
def geometry_chains(spark, d):
    ordered = geometry.reading_order(words(spark, d))
    found = geometry.chains(ordered, geometry.successors(ordered))
    return found.select("label", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "text", "box.*", "parts", "widest")


@query(
    f"WITH {_PATHS} SELECT {_PATH_COLUMNS}, norm FROM (SELECT *, row_number() OVER (PARTITION BY label, norm ORDER BY parts <> 1, (x1 - x0) * (y1 - y0), path) AS k FROM (SELECT *, {S.norm('text')} AS norm FROM paths)) WHERE k = 1"
)
def geometry_one_for_each_reading(spark, d):
    ordered = geometry.reading_order(words(spark, d))
    found = geometry.one_for_each_reading(geometry.chains(ordered, geometry.successors(ordered)))
    return found.select("label", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "text", "box.*", "parts", "widest", "norm")


@query(f"SELECT label, bool_or(y1 - y0 > x1 - x0) AS side_on FROM ({S.words()}) GROUP BY label")
def geometry_side_on(spark, d):
    return geometry.side_on(words(spark, d))


@query(f"SELECT label, det_idx, y0 AS x0, 4000 - x1 AS y0, y1 AS x1, 4000 - x0 AS y1 FROM ({S.words()})")
def geometry_turned_back(spark, d):
    w = words(spark, d)
    return w.select("label", "det_idx", geometry.turned_back(F.lit(4000), F.struct("x0", "y0", "x1", "y1")).alias("b")).select("label", "det_idx", "b.*")


@query(
    f"WITH w AS ({S.words()}), t AS (SELECT label, det_idx, x0 + 9 AS x0, y0 + det_idx % 8 AS y0, x1 + 9 AS x1, y1 + det_idx % 8 AS y1 FROM w), o AS (SELECT label, x0 + 100000 * (det_idx % 2) AS x0, y0, x1 + 100000 * (det_idx % 2) AS x1, y1 FROM w) SELECT label, det_idx, (x1 - x0) * (y1 - y0) <= 0 OR EXISTS (SELECT 1 FROM o WHERE o.label = t.label AND "
    "2 * greatest(least(t.x1, o.x1) - greatest(t.x0, o.x0), 0) * greatest(least(t.y1, o.y1) - greatest(t.y0, o.y0), 0) > (t.x1 - t.x0) * (t.y1 - t.y0)) AS covered FROM t"
)
def geometry_covered(spark, d):
    """Words moved a little, against all words, of which those of odd numbers are moved far aside."""
    w = words(spark, d)
    down = F.col("det_idx") % 8
    moved = w.select("label", "det_idx", (F.col("x0") + 9).alias("x0"), (F.col("y0") + down).alias("y0"), (F.col("x1") + 9).alias("x1"), (F.col("y1") + down).alias("y1"))
    aside = 100_000 * (F.col("det_idx") % 2)
    return geometry.covered_by_any(moved, w.withColumns({c: (F.col(c) + aside).cast("int") for c in ("x0", "x1")}))


_AREA = "(e[1].x1 - e[1].x0) * (e[1].y1 - e[1].y0)"


_UNCOVERED = (
    f"WITH w AS ({S.words()}), u AS (SELECT label, list(struct_pack(det_idx := -1, x0 := x0 + 100000 * (det_idx % 2), y0 := y0, x1 := x1 + 100000 * (det_idx % 2), y1 := y1)) AS seen FROM w GROUP BY label), "
    "t AS (SELECT label, list([struct_pack(det_idx := det_idx, x0 := x0 + 4, y0 := y0, x1 := x1 + 4, y1 := y1)] ORDER BY det_idx) AS boxes FROM w GROUP BY label), "
    f"f AS (SELECT label, unnest(list_reduce(list_prepend(seen, boxes), lambda acc, e: CASE WHEN {_AREA} <= 0 OR len(list_filter(acc, lambda o: 2 * greatest(least(e[1].x1, o.x1) - greatest(e[1].x0, o.x0), 0) * greatest(least(e[1].y1, o.y1) - greatest(e[1].y0, o.y0), 0) > {_AREA})) > 0 "
    "THEN acc ELSE list_concat(acc, e) END)) AS b FROM t JOIN u USING (label)) SELECT label, CAST(b.det_idx AS INT) AS det_idx, CAST(b.x0 AS INT) AS x0, CAST(b.y0 AS INT) AS y0, CAST(b.x1 AS INT) AS x1, CAST(b.y1 AS INT) AS y1 FROM f WHERE b.det_idx >= 0"
)


@query(_UNCOVERED)
def geometry_uncovered(spark, d):
    """All words, moved a little, as turned boxes against all words, of which those of odd numbers are moved far aside."""
    w = words(spark, d)
    shift = w.select("label", "det_idx", (F.col("x0") + 4).alias("x0"), "y0", (F.col("x1") + 4).alias("x1"), "y1")
    aside = 100_000 * (F.col("det_idx") % 2)
    return geometry.uncovered(shift, w.withColumns({c: (F.col(c) + aside).cast("int") for c in ("x0", "x1")}))


@query(
    f"WITH t AS ({_UNCOVERED}), b AS (SELECT label, det_idx, x0 + 100000 * (det_idx % 2) AS x0, y0, x1 + 100000 * (det_idx % 2) AS x1, y1, text, false AS rotated FROM ({S.words()}) UNION ALL SELECT t.label, t.det_idx, t.x0, t.y0, t.x1, t.y1, w.text, true FROM t JOIN ({S.words()}) w ON w.label = t.label AND w.det_idx = t.det_idx) "
    "SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY y0, x0, rotated, det_idx) - 1 AS INT) AS det_idx, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, text, rotated FROM b"
)
def geometry_with_turned(spark, d):
    """The words of ``geometry_uncovered`` read on an image turned by a quarter, added to the upright ones."""
    w = words(spark, d)
    aside = 100_000 * (F.col("det_idx") % 2)
    upright = w.withColumns({c: (F.col(c) + aside).cast("int") for c in ("x0", "x1")})
    turned = w.select("label", "det_idx", (4000 - F.col("y1")).alias("x0"), (F.col("x0") + 4).alias("y0"), (4000 - F.col("y0")).alias("x1"), (F.col("x1") + 4).alias("y1"), "text", "confidence")
    return geometry.with_turned(upright, turned, F.lit(4000)).drop("confidence")


@query(
    f"SELECT label, {S.norm('reading')} AS norm, round({S.half_edits('a', 'b')} / (2.0 * length(a)), 6) AS distance, round({S.infix_cost('a', 'b')} / (2.0 * length(a)), 6) AS infix FROM (SELECT label, reading, {S.norm('name')} AS a, {S.norm('reading')} AS b FROM ({S.NAMES}))"
)
def registered_functions(spark, d):
    """The functions by name, in SQL."""
    registered.register(spark)
    names(spark, d).createOrReplaceTempView("veriframe_names")
    return spark.sql(
        "SELECT label, b AS norm, round(claim_distance(a, b), 6) AS distance, round(claim_infix(a, b), 6) AS infix FROM (SELECT label, claim_normalize(name) AS a, claim_normalize(reading) AS b FROM veriframe_names)"
    )


@query(f"WITH {_PATHS} SELECT {_PATH_COLUMNS} FROM paths".replace(", CAST(widest AS INT) AS widest", ""))
def registered_chains(spark, d):
    """Chains by the table function."""
    registered.register(spark)
    words(spark, d).createOrReplaceTempView("veriframe_words")
    return spark.sql(
        "SELECT CAST(label AS BIGINT) AS label, array_join(CAST(path AS ARRAY<STRING>), '-') AS path, text, x0, y0, x1, y1, parts FROM claim_chains(TABLE(SELECT * FROM veriframe_words) PARTITION BY label)"
    )


# Claims.

_APPLICATION = (
    "SELECT p_partkey AS label, CASE p_partkey % 4 WHEN 0 THEN 'spirits' WHEN 1 THEN 'wine' WHEN 2 THEN 'beer' ELSE '' END AS beverage, p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS class, p_name AS producer, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'Unit 4, Old Mill Road, ' || p_type ELSE '' END AS address, CASE WHEN p_partkey % 7 = 0 THEN 'Product of ' || p_brand ELSE '' END AS origin, p_size / 2.0 AS abv, CASE WHEN p_partkey % 2 = 0 THEN p_size * 50.0 ELSE 0.0 END AS net_ml FROM part"
)


def applications(spark, d):
    table(spark, d, "part").createOrReplaceTempView("veriframe_part")
    a = spark.sql(_APPLICATION.replace("2.0", "2.0D").replace("50.0", "50.0D").replace("0.0 END", "0.0D END").replace("FROM part", "FROM veriframe_part"))
    producer = F.when(F.col("address") == "", F.array("producer")).otherwise(F.array("producer", "address"))
    return a.withColumn("producer", producer).withColumn("aliases", F.lit(None).cast("map<string,array<string>>"))


_BEER = "coalesce(beverage = 'beer', false)"


@query(
    f"WITH a AS ({_APPLICATION}), c AS (SELECT label, 'brand' AS claim, brand AS expected, true AS required, 0 AS k FROM a WHERE brand <> '' UNION ALL SELECT label, 'class', class, true, 1 FROM a WHERE class <> '' UNION ALL SELECT label, 'producer_1', producer, true, 2 FROM a "
    f"UNION ALL SELECT label, 'producer_2', address, true, 3 FROM a WHERE address <> '' UNION ALL SELECT label, 'origin', origin, false, 4 FROM a WHERE origin <> '' UNION ALL SELECT label, 'abv', {S.shortest('abv')}, NOT {_BEER}, 5 FROM a WHERE abv > 0 UNION ALL SELECT label, 'net', {S.shortest('net_ml')}, true, 6 FROM a WHERE net_ml > 0) "
    "SELECT label, claim, expected, required, CAST(row_number() OVER (PARTITION BY label ORDER BY k) - 1 AS INT) AS claim_pos FROM c"
)
def claims_filed(spark, d):
    return C.claims(applications(spark, d)).select("label", "claim", "expected", "required", "claim_pos")


@query(f"WITH a AS ({_APPLICATION}) SELECT label, CASE WHEN beverage = '' THEN 'claims without a beverage' END AS refusal FROM a")
def claims_refusal(spark, d):
    return applications(spark, d).select("label", C.why_not_verifiable(F.col("beverage"), F.lit(True)).alias("refusal"))


_PHRASES = ", ".join(f"'{p} '" for p in C.PHRASES)


@query(
    f"WITH s AS (SELECT s_suppkey, s_name AS n, 'Lot ' || s_nationkey || ' Long Harbour Road ' || n_name AS a FROM supplier JOIN nation ON n_nationkey = s_nationkey), w AS (SELECT *, string_split(a, ' ') AS ws FROM s), "
    f"t AS (SELECT s_suppkey, n, unnest(list_concat([''], list_transform(range(len(ws) - 3, len(ws) + 1), lambda k: ' ' || array_to_string(ws[k:], ' ')))) AS tail FROM w), p AS (SELECT unnest(['', {_PHRASES}]) AS phrase) SELECT s_suppkey, phrase || n || tail AS form FROM t, p"
)
def claims_responsibility(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    address = F.concat(F.lit("Lot "), F.col("s_nationkey").cast("string"), F.lit(" Long Harbour Road "), "n_name")
    return s.select("s_suppkey", F.explode(C.responsibility_forms(F.col("s_name"), address)).alias("form"))


def _vocabulary_sql(fields: list[tuple[str, list, str]]) -> str:
    parts = []
    for name, formats, valid in fields:
        forms = ", ".join(f"('{t}', CAST({s} AS DOUBLE), {i})" for i, (t, s) in enumerate(formats))
        parts.append(f"SELECT '{name}' AS vocabulary, v, vi, template, CASE WHEN scale <> 0 THEN v / scale ELSE v END AS x, form FROM ({valid}), (VALUES {forms}) AS f(template, scale, form)")
    p = ["s", "printf('%.1f', x)", S.trimmed("printf('%.1f', x)"), "printf('%.2f', x)", S.trimmed("printf('%.2f', x)")]
    return (
        f"WITH f AS ({' UNION ALL '.join(parts)}), g AS (SELECT *, {S.shortest('x')} AS s FROM f), h AS (SELECT *, unnest([{', '.join(p)}]) AS printed, generate_subscripts([{', '.join(p)}], 1) AS pi FROM g), n AS (SELECT *, {S.norm("replace(template, '{n}', printed)")} AS norm FROM h) "
        f"SELECT vocabulary, norm, value, form, num FROM (SELECT vocabulary, norm, v AS value, CAST(form AS INT) AS form, {S.norm('printed')} AS num, row_number() OVER (PARTITION BY vocabulary, norm ORDER BY vi, form, pi) AS k FROM n) WHERE k = 1"
    )


_FIELDS = [
    ("abv", C.ABV_FORMATS, "SELECT round(i * 0.5, 2)::DOUBLE AS v, i AS vi FROM range(1, 191) t(i)"),
    ("abv_beer", C.ABV_FORMATS, "SELECT round(i::DOUBLE * 0.1::DOUBLE, 2) AS v, i AS vi FROM range(1, 951) t(i)"),
    ("net", C.NET_FORMATS, f"SELECT unnest({list(map(float, C.FILLS))}::DOUBLE[]) AS v, generate_subscripts({list(C.FILLS)}, 1) AS vi"),
    ("net_beer", C.NET_FORMATS, f"SELECT unnest({list(map(float, C.BEER_FILLS))}::DOUBLE[]) AS v, generate_subscripts({list(C.BEER_FILLS)}, 1) AS vi"),
]


@query(_vocabulary_sql(_FIELDS))
def claims_vocabulary(spark, d):
    out = None
    for name, *_ in _FIELDS:
        v = C.field_vocabulary(spark, name).select("vocabulary", "norm", "value", "form", "num")
        out = v if out is None else out.unionByName(v)
    return out


@query(
    f"WITH a AS ({_APPLICATION}), v AS (SELECT label, abv, {_BEER} AS beer FROM a WHERE abv > 0) SELECT label, CAST(n + CASE WHEN least(abs(abv - floor(abv / step) * step), abs(abv - ceil(abv / step) * step)) <= 0.05 AND abv >= step - 0.05 AND abv <= 95.05 THEN 0 ELSE 1 END AS INT) AS n FROM (SELECT *, CASE WHEN beer THEN 0.1 ELSE 0.5 END::DOUBLE AS step, CASE WHEN beer THEN 950 ELSE 190 END AS n FROM v)"
)
def claims_admitted(spark, d):
    c = C.claims(applications(spark, d)).filter("claim = 'abv'")
    return c.select("label", F.size("numeric.valid").alias("n"))


# Decisions.


def _text_claims(spark, d):
    n = names(spark, d)
    none = F.lit(None).cast("struct<formats:array<struct<template:string,scale:double>>,valid:array<double>,tolerance:double>")
    filed = n.select("label", F.lit("producer_1").alias("claim"), F.col("name").alias("expected"), (F.col("label") % 10 != 9).alias("required"), F.array("name").alias("texts"), none.alias("numeric"))
    return filed, one_box(n, "reading")


_DELIMITED = r"regexp_matches(lower(reading), '(^|[0-9]|[^\p{L}\p{Nd}\s]\s*)' || lower(name) || '($|[0-9]|\s*[^\p{L}\p{Nd}\s])')"
_BRAND = (
    f"SELECT label, name, reading, required, CASE WHEN h / (2.0 * length(a)) <= 0.14 OR (contains(b, a) AND delimited) THEN 'VERIFIED' WHEN required THEN 'NOT_FOUND' ELSE 'SKIPPED' END AS status, CASE WHEN contains(b, a) AND delimited THEN 0.0 ELSE h / (2.0 * length(a)) END AS dist "
    f"FROM (SELECT *, label % 10 <> 9 AS required, {S.half_edits('a', 'b')} AS h, length(b) > length(a) AND {_DELIMITED} AS delimited FROM (SELECT label, name, reading, {S.norm('name')} AS a, {S.norm('reading')} AS b FROM ({S.NAMES})))"
)


def _brand_verdicts(spark, d):
    filed, det = _text_claims(spark, d)
    return decide.verify(det, filed)


@query(f"SELECT label, status, CASE WHEN status = 'VERIFIED' THEN '' ELSE 'not_found' END AS reason, CASE WHEN status = 'VERIFIED' THEN name ELSE '' END AS observed, CASE WHEN status = 'VERIFIED' THEN round(dist, 6) END AS dist FROM ({_BRAND})")
def verify_brand(spark, d):
    v = _brand_verdicts(spark, d)
    return v.select("label", "status", "reason", "observed", F.when(F.col("status") == "VERIFIED", F.round("evidence.distance", 6)).alias("dist"))


_TALLY = (
    "CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE status = 'VERIFIED' AND want = 'correct') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE (status = 'VERIFIED' AND want <> 'correct') OR (status = 'MISMATCH' AND want = 'correct')) AS BIGINT) AS fp, "
    "CAST(count(*) FILTER (WHERE status NOT IN ('VERIFIED', 'MISMATCH') AND want = 'correct') AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE status = 'REVIEW') AS BIGINT) AS review, CAST(count(*) FILTER (WHERE status = 'MISMATCH' AND want = 'wrong') AS BIGINT) AS mismatch_hit, "
    "CAST(count(*) FILTER (WHERE status <> 'MISMATCH' AND want = 'wrong') AS BIGINT) AS mismatch_miss, CAST(count(*) FILTER (WHERE status IN ('NOT_FOUND', 'SKIPPED') AND want = 'missing') AS BIGINT) AS absent_hit"
)
_RATES = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall"
_WANT_READING = "CASE label % 6 WHEN 5 THEN 'missing' WHEN 3 THEN 'wrong' ELSE 'correct' END"


@query(f"SELECT kind, n, tp, fp, fn, review, mismatch_hit, mismatch_miss, absent_hit, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (SELECT *, {_RATES} FROM (SELECT CAST(label % 6 AS BIGINT) AS kind, {_TALLY} FROM (SELECT label, status, {_WANT_READING} AS want FROM ({_BRAND})) GROUP BY 1))")
def verify_brand_tally(spark, d):
    """The flagship: names of parts verified against damaged readings, and scored by kind of damage."""
    v = _brand_verdicts(spark, d).withColumn("want", F.expr(_WANT_READING))
    t = evaluate.with_rates(evaluate.tally(v, (F.col("label") % 6).alias("kind")))
    return t.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


_READ_NUMBER = "CASE p_partkey % 8 WHEN 0 THEN p_size || ' ML' WHEN 1 THEN 'NET ' || p_size || ' FL. OZ.' WHEN 2 THEN ((p_size + 6) % 50 + 1) || ' ML' WHEN 3 THEN p_size || '1 ML' WHEN 4 THEN substr(CAST(p_size AS VARCHAR), 2) || ' ML' WHEN 5 THEN 'NO FIGURE' WHEN 6 THEN p_size || '.5 ML' ELSE p_size || ' ML OR ' || ((p_size + 9) % 50 + 1) || ' ML' END"
_NUMERIC = (
    f"WITH r AS (SELECT p_partkey AS label, CAST(p_size AS DOUBLE) AS want, CAST(p_size AS VARCHAR) AS expected, {S.norm(_READ_NUMBER)} AS b FROM part), n AS (SELECT *, regexp_extract_all(b, '[0-9.]+') AS nums FROM r), "
    "forms AS (SELECT * FROM (VALUES ('ML', 0), ('FLOZ', 1)) f(unit, form)), v AS (SELECT i AS value, i || unit AS c, CAST(i AS VARCHAR) AS num, form, (i - 1) * 10000 + form * 100 AS idx FROM range(1, 51) t(i), forms), "
    "pairs AS (SELECT n.label, n.b, v.*, abs(value - want) <= 0.5 AS claimed, list_contains(nums, num) AS holds FROM n JOIN v ON abs(value - want) <= 0.5 OR list_contains(nums, num)), "
    f"dp AS (SELECT b, c, {S.infix_cost('c', 'b')} AS h FROM (SELECT DISTINCT b, c FROM pairs)), m AS (SELECT pairs.*, h / (2.0 * length(pairs.c)) AS dist FROM pairs JOIN dp ON dp.b = pairs.b AND dp.c = pairs.c), "
    "e AS (SELECT label, min(dist) AS d FROM m WHERE claimed AND holds AND dist <= 0.12 GROUP BY label), o AS (SELECT label, min(dist) AS d FROM m WHERE claimed AND dist <= 0.12 + 0.15 GROUP BY label), "
    "x AS (SELECT label, dist AS d, num, form, value, len FROM (SELECT *, length(c) AS len, row_number() OVER (PARTITION BY label ORDER BY dist, -length(c), idx) AS k FROM m WHERE NOT claimed AND holds AND dist <= 0.12) WHERE k = 1), "
    "j AS (SELECT r.label, r.expected, r.b, e.d AS e, o.d AS o, x.d AS x, x.num, x.form, x.value, e.d IS NOT NULL AND (x.d IS NULL OR e.d <= x.d + 0.15) AS verified FROM r LEFT JOIN e ON e.label = r.label LEFT JOIN o ON o.label = r.label LEFT JOIN x ON x.label = r.label), "
    "q AS (SELECT *, NOT verified AND x IS NOT NULL AND (o IS NULL OR x + 0.15 < o) AS mismatch, contains(expected, num) OR contains(num, expected) AS dropped, length(expected) + CASE WHEN form = 0 THEN 2 ELSE 4 END > length(num) + CASE WHEN form = 0 THEN 2 ELSE 4 END AND o IS NOT NULL AS short FROM j) "
)


@query(
    _NUMERIC + "SELECT label, CASE WHEN verified THEN 'VERIFIED' WHEN x IS NULL THEN 'NOT_FOUND' WHEN mismatch AND (dropped OR short) THEN 'REVIEW' WHEN mismatch THEN 'MISMATCH' ELSE 'REVIEW' END AS status, "
    "CASE WHEN verified THEN '' WHEN x IS NULL THEN 'not_found' WHEN mismatch AND dropped THEN 'figure_incomplete' WHEN mismatch AND short THEN 'reading_short' WHEN mismatch THEN 'read ' || num ELSE 'between:' || expected || ',' || num END AS reason FROM q"
)
def verify_numeric(spark, d):
    """Whole numbers from 1 to 50, in two forms, against readings that are right, changed, longer, shorter, or none."""
    table(spark, d, "part").createOrReplaceTempView("veriframe_part")
    rows = spark.sql(f"SELECT p_partkey AS label, CAST(p_size AS DOUBLE) AS want, {_READ_NUMBER.replace('VARCHAR', 'STRING')} AS reading FROM veriframe_part")
    forms = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(1.0).alias("scale")) for t in ("{n} ML", "{n} FL OZ")])
    valid = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: k.cast("double"))
    numeric = F.struct(forms.alias("formats"), C.admit(valid, F.col("want"), F.lit(0.5)).alias("valid"), F.lit(0.5).alias("tolerance"))
    filed = rows.select("label", F.lit("net").alias("claim"), T.shortest("want").alias("expected"), F.lit(True).alias("required"), F.array().cast("array<string>").alias("texts"), numeric.alias("numeric"))
    return decide.verify(one_box(rows, "reading"), filed).select("label", "status", "reason")


@query(f"SELECT p_partkey AS label, value FROM (SELECT p_partkey, regexp_extract_all({S.norm(_READ_NUMBER)}, '[0-9.]+') AS nums FROM part) JOIN (SELECT i AS value, CAST(i AS VARCHAR) AS num FROM range(1, 51) t(i)) ON list_contains(nums, num)")
def verify_figure_join(spark, d):
    """Values whose figure a reading holds: an equi-join on the figure."""
    table(spark, d, "part").createOrReplaceTempView("veriframe_part")
    rows = spark.sql(f"SELECT p_partkey AS label, {_READ_NUMBER.replace('VARCHAR', 'STRING')} AS reading FROM veriframe_part")
    figures = rows.select("label", F.explode(F.array_distinct(T.numbers(T.normalize("reading")))).alias("num"))
    return figures.join(F.broadcast(spark.range(1, 51).select(F.col("id").alias("value"), F.col("id").cast("string").alias("num"))), "num").select("label", "value")


@query()
def verify_applications(spark, d):
    """All claims of the applications against the readings of their brand, class, name and figures on one label."""
    a = dealt(applications(spark, d), "label")
    t = F.concat_ws("\n", F.col("brand"), F.col("class"), F.concat(F.lit("Bottled by "), F.get("producer", F.lit(0))), F.concat(T.abv_text("abv")), F.when(F.col("net_ml") > 0, T.net_text("net_ml")))
    det = a.select("label", F.posexplode(F.split(t, "\n")).alias("det_idx", "text"))
    det = det.select("label", "det_idx", F.lit(10).alias("x0"), (40 * F.col("det_idx")).alias("y0"), (10 + 8 * F.length("text")).alias("x1"), (40 * F.col("det_idx") + 12).alias("y1"), "text", F.lit(0.9).alias("confidence"))
    filed = C.claims(a)
    v = decide.verify(det, filed)
    return v.select("label", "claim", "status", "reason", "observed", F.round("evidence.distance", 6).alias("distance"))


@query(f"SELECT count(*)::BIGINT AS boxes FROM (SELECT label FROM ({_BRAND}) WHERE status <> 'VERIFIED' AND dist > 0.14 AND dist <= 0.28)")
def verify_near_misses(spark, d):
    return decide.near_misses(_brand_verdicts(spark, d)).agg(F.count("*").alias("boxes"))


# Labels of some 50 boxes, a word each: what a supplier files, in lines among words of other text. By its number modulo 5 a
# label prints it as filed, or with confused characters, or without some of it, or with other figures, or with both.
_CROWDED = (
    "SELECT s_suppkey AS label, 'spirits' AS beverage, n_name AS brand, 'Malt of ' || n_name AS class, 'House of Alder' AS producer, 'Lot 7, Harbour Road' AS address, '' AS origin, 40.0 + s_suppkey % 25 AS abv, 750.0 AS net_ml FROM supplier JOIN nation ON n_nationkey = s_nationkey"
)


def crowded(spark, d):
    """(applications, detections)."""
    table(spark, d, "nation").createOrReplaceTempView("veriframe_nation")
    table(spark, d, "supplier").createOrReplaceTempView("veriframe_supplier")
    a = spark.sql(_CROWDED.replace("40.0", "40.0D").replace("750.0", "750.0D").replace("FROM supplier JOIN nation", "FROM veriframe_supplier JOIN veriframe_nation"))
    a = dealt(a, "label").withColumn("producer", F.array("producer", "address")).withColumn("aliases", F.lit(None).cast("map<string,array<string>>"))
    other = [F.translate(F.substring(F.md5(F.concat_ws("/", F.col("label").cast("string"), F.lit(str(k)))), 1, 3 + k % 6), "0123456789", "ghijklmnop") for k in range(36)]
    line = lambda k: F.concat_ws(" ", *other[6 * k : 6 * k + 6])
    kind, missing = F.col("label") % 5, F.lit("zz")
    name = F.when(kind == 1, F.translate("brand", "OIS", "015")).otherwise(F.col("brand"))
    unless = lambda c: F.when(kind == 2, missing).otherwise(c)
    strength = F.when(kind == 3, T.abv_text(F.col("abv") - 35)).when(kind == 4, F.concat_ws(" ", T.abv_text(F.col("abv") - 35), T.abv_text("abv"))).otherwise(T.abv_text("abv"))
    net = unless(F.when(kind == 3, T.net_text(F.lit(375.0))).otherwise(T.net_text("net_ml")))
    house = unless(F.concat(F.lit("Bottled by "), F.get("producer", F.lit(0))))
    printed = [unless(name), line(0), unless(F.concat(F.lit("Malt of "), name)), line(1), house, F.col("address"), line(2), strength, line(3), net, line(4), line(5)]
    lines = a.select("label", F.posexplode(F.array(*printed)).alias("l", "t"))
    words = lines.select("label", "l", F.posexplode(F.split("t", " ")).alias("k", "text"), F.transform(F.split("t", " "), F.length).alias("n"))
    before = F.aggregate(F.slice("n", F.lit(1), F.col("k")), F.lit(0), lambda s, n: s + n + 1)
    box = words.select(
        "label", (100 * F.col("l") + F.col("k")).cast("int").alias("det_idx"), (10 + 8 * before).cast("int").alias("x0"), (30 * F.col("l")).cast("int").alias("y0"),
        (10 + 8 * (before + F.length("text"))).cast("int").alias("x1"), (30 * F.col("l") + 12).cast("int").alias("y1"), "text", F.lit(0.9).alias("confidence"),
    )
    return a, box


# Confused characters cost half an edit each, as a share of the claim's own length; another figure contradicts if its
# distance beats the filed one's by the margin, unless it has fewer digits, which a clipped reading also has.
_DAMAGE = "length(brand) - length(regexp_replace(brand, '[OIS]', '', 'g'))"
_CROWDED_VERDICTS = (
    f"SELECT label, claim, CASE WHEN kind = 2 AND claim IN ('brand', 'class', 'producer_1', 'net') THEN 'NOT_FOUND' WHEN dist > 0.14 THEN 'NOT_FOUND' WHEN kind = 3 AND claim = 'net' THEN 'MISMATCH' "
    "WHEN kind = 3 AND claim = 'abv' THEN CASE WHEN abv - 35 < 10 THEN 'REVIEW' ELSE 'MISMATCH' END ELSE 'VERIFIED' END AS status, "
    "CASE WHEN kind = 2 AND claim IN ('brand', 'class', 'producer_1', 'net') THEN 'not_found' WHEN dist > 0.14 THEN 'not_found' WHEN kind = 3 AND claim = 'net' THEN 'read 375' "
    "WHEN kind = 3 AND claim = 'abv' THEN CASE WHEN abv - 35 < 10 THEN 'reading_short' ELSE 'read ' || CAST(CAST(abv - 35 AS INT) AS VARCHAR) END ELSE '' END AS reason, dist FROM "
    f"(SELECT label, claim, label % 5 AS kind, abv, CASE WHEN label % 5 = 1 AND claim = 'brand' THEN ({_DAMAGE}) / (2.0 * length({S.norm('brand')})) WHEN label % 5 = 1 AND claim = 'class' THEN ({_DAMAGE}) / (2.0 * (6 + length({S.norm('brand')}))) ELSE 0.0 END AS dist "
    f"FROM ({_CROWDED}), (SELECT unnest(['brand', 'class', 'producer_1', 'producer_2', 'abv', 'net']) AS claim))"
)


@query(f"SELECT label, claim, status, reason, CASE WHEN status = 'VERIFIED' THEN round(CAST(dist AS DOUBLE), 6) END AS distance FROM ({_CROWDED_VERDICTS})")
def verify_crowded(spark, d):
    """All claims on labels of many boxes: printed as filed, damaged, missing, contradicted, and beside a competing figure."""
    a, det = crowded(spark, d)
    filed = C.claims(a)
    v = decide.verify(det, filed)
    return v.select("label", "claim", "status", "reason", F.when(F.col("status") == "VERIFIED", F.round("evidence.distance", 6)).alias("distance"))


# Passages.


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, {S.norm('text')} AS norm FROM documents) JOIN (SELECT item_id, {S.norm('text')} AS want FROM benchmark) ON contains(norm, want) AND want <> ''")
def reference_exact(spark, d):
    refs = table(spark, d, "benchmark").select(F.col("item_id").alias("ref_idx"), "text")
    return reference.held_exactly(table(spark, d, "documents"), refs).select("doc_id", F.col("ref_idx").alias("item_id"))


@query()
def reference_passages(spark, d):
    """Each benchmark item against the words of every item, as passages with a heading of 19 characters."""
    refs = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("ref_idx"), "text", F.array(F.lit(0), F.lit(19)).alias("emphasis"))
    v = reference.verify_references(lines_of_items(spark, d), refs)
    return v.select("label", "reference", "status", "reason", F.round("distance", 6).alias("distance"), F.round("coverage", 6).alias("coverage"), "parts", "heading_status", "heading_reason")


def lines_of_items(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("label"), F.posexplode(F.split("text", "\n")).alias("det_idx", "text"))
    return t.select("label", "det_idx", F.lit(10).alias("x0"), (13 * F.col("det_idx")).alias("y0"), (10 + 8 * F.length("text")).alias("x1"), (13 * F.col("det_idx") + 12).alias("y1"), "text", F.lit(0.9).alias("confidence"))


_CAPITALS = r"regexp_matches(text, '\p{L}') AND NOT regexp_matches(text, '\p{Ll}')"
_RATIO = "CASE WHEN det_idx % 3 = 0 THEN NULL ELSE 1.0 + (det_idx % 7) / CAST(20 AS DOUBLE) END"


@query(f"SELECT label, det_idx, CASE WHEN NOT ({_CAPITALS}) THEN 'MISMATCH' WHEN ratio >= 1.15 THEN 'VERIFIED' ELSE 'REVIEW' END AS status, CASE WHEN NOT ({_CAPITALS}) THEN 'header_not_capitals' WHEN ratio IS NULL THEN 'weight_not_measurable' WHEN ratio >= 1.15 THEN '' ELSE 'header_weight_uncertain' END AS reason FROM (SELECT *, {_RATIO} AS ratio FROM ({S.lines()}))")
def reference_heading(spark, d):
    ratio = F.when(F.col("det_idx") % 3 != 0, 1.0 + (F.col("det_idx") % 7) / 20.0)
    return lines(spark, d).select("label", "det_idx", reference.heading_status(F.col("text"), ratio).alias("status"), reference.heading_reason(F.col("text"), ratio).alias("reason"))


# A passage in three boxes on each supplier's label: the heading, and two lines of the body. The
# heading is set in capitals or not, and its strokes are 2 to 5 pixels thick, the body's 2 to 4.
_PASSAGE = ("STORE COLD.", "Keep in a dry place", "out of the sun.")
_STROKES = "s_suppkey AS label, CAST(2 + s_suppkey % 4 AS INT) AS th, CAST(2 + s_nationkey % 3 AS INT) AS tb, s_suppkey % 5 = 2 AS low"


def stroked_labels(spark, d):
    s = table(spark, d, "supplier").selectExpr(*_STROKES.split(", "))
    head = F.when(F.col("low"), F.initcap(F.lower(F.lit(_PASSAGE[0])))).otherwise(_PASSAGE[0])
    det = s.select("label", "th", "tb", F.posexplode(F.array(head, *map(F.lit, _PASSAGE[1:]))).alias("det_idx", "text"))
    det = det.select("label", "det_idx", F.lit(10).alias("x0"), (13 * F.col("det_idx")).alias("y0"), (10 + 8 * F.length("text")).alias("x1"), (13 * F.col("det_idx") + 12).alias("y1"), "text", F.lit(0.9).alias("confidence"))
    width, grey = 180, lambda n, hexes: F.repeat(F.lit(hexes), n)
    blank = grey(F.lit(width), "FFFFFF")
    rows = []
    for text, thick in zip(_PASSAGE, ("th", "tb", "tb"), strict=True):
        bar = F.concat(grey(F.lit(12), "FFFFFF"), grey(F.lit(8 * len(text) - 4), "000000"), grey(F.lit(width - 8 - 8 * len(text)), "FFFFFF"))
        rows += [F.repeat(blank, F.lit(4)), F.repeat(bar, F.col(thick)), F.repeat(blank, 9 - F.col(thick))]
    return det, s.select("label", F.lit(width).alias("width"), F.lit(39).alias("height"), F.unhex(F.concat(*rows)).alias("rgb"))


_WIDTHS = (
    f"SELECT label, low, (2 * CAST({8 * len(_PASSAGE[0]) - 4} * th AS DOUBLE) / ({2 * (8 * len(_PASSAGE[0]) - 4)} + 2 * (th - 2)) / 12) AS head, "
    f"(2 * (CAST({8 * len(_PASSAGE[1]) - 4} * tb AS DOUBLE) + {8 * len(_PASSAGE[2]) - 4} * tb) / ({2 * (8 * len(_PASSAGE[1]) - 4)} + {2 * (8 * len(_PASSAGE[2]) - 4)} + 4 * (tb - 2)) / 12) AS body FROM (SELECT {_STROKES} FROM supplier)"
)


@query(
    "SELECT label, 'VERIFIED' AS status, CASE WHEN low THEN 'MISMATCH' WHEN head / body >= 1.15 THEN 'VERIFIED' ELSE 'REVIEW' END AS heading_status, "
    f"CASE WHEN low THEN 'header_not_capitals' WHEN head / body >= 1.15 THEN '' ELSE 'header_weight_uncertain' END AS heading_reason, CASE WHEN low THEN NULL ELSE round(head / body, 6) END AS heading_ratio FROM ({_WIDTHS})"
)
def reference_emphasis(spark, d):
    """A heading's capitals and measured weight, from detections and pixels."""
    det, images = stroked_labels(spark, d)
    refs = spark.createDataFrame([(0, " ".join(_PASSAGE), [0, len(_PASSAGE[0])])], "ref_idx int, text string, emphasis array<int>")
    v = reference.verify_references(det, refs, images=images)
    return v.select("label", "status", "heading_status", "heading_reason", F.round("heading_ratio", 6).alias("heading_ratio"))


# Evaluation.

_EVAL = (
    "SELECT doc_id AS label, CASE doc_id % 4 WHEN 0 THEN 'abv' WHEN 1 THEN 'net' WHEN 2 THEN 'class' ELSE 'brand' END AS claim, CASE (doc_id // 4) % 5 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'NOT_FOUND' ELSE 'SKIPPED' END AS status, "
    "CASE WHEN quality = 0 THEN '' WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN '=' END AS carried, CASE WHEN toxic = 1 THEN 'wrong_abv' WHEN doc_id % 11 = 3 THEN 'wrong_brand' ELSE '' END AS error, CAST(doc_id % 9 AS DOUBLE) AS abv, CAST(doc_id % 13 AS DOUBLE) AS net_ml, CASE WHEN doc_id % 17 = 2 THEN '' ELSE lang END AS class, lang, n_chars FROM documents LEFT JOIN labels USING (doc_id)"
)
_WANT = "CASE WHEN carried IS NOT NULL AND carried <> '=' THEN 'missing' WHEN (claim = 'abv' AND abv = 0) OR (claim = 'net' AND net_ml = 0) OR (claim = 'class' AND class = '') THEN 'missing' WHEN error = 'wrong_' || claim THEN 'wrong' ELSE 'correct' END"


def scored(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("veriframe_documents")
    table(spark, d, "labels").createOrReplaceTempView("veriframe_labels")
    s = spark.sql(_EVAL.replace("//", "div").replace("FROM documents LEFT JOIN labels", "FROM veriframe_documents LEFT JOIN veriframe_labels"))
    carried = F.when(F.col("carried").isNotNull(), F.create_map(F.col("claim"), F.col("carried")))
    return s.withColumn("want", evaluate.want(F.col("claim"), carried, F.col("error"), F.col("abv"), F.col("net_ml"), F.col("class")))


_SCORED = f"SELECT *, {_WANT} AS want FROM ({_EVAL})"


@query(f"SELECT label, claim, status, want FROM ({_SCORED})")
def evaluate_want(spark, d):
    return scored(spark, d).select("label", "claim", "status", "want")


@query(f"SELECT claim, n, tp, fp, fn, review, mismatch_hit, mismatch_miss, absent_hit, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (SELECT *, {_RATES} FROM (SELECT claim, {_TALLY} FROM ({_SCORED}) GROUP BY claim))")
def evaluate_tally(spark, d):
    t = evaluate.with_rates(evaluate.tally(scored(spark, d), "claim"))
    return t.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(f"SELECT CAST(count(*) AS BIGINT) AS labels, CAST(count(*) FILTER (WHERE m) AS BIGINT) AS with_mismatch, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS all_verified FROM (SELECT label // 10 AS l, bool_or(status = 'MISMATCH') AS m, bool_and(status = 'VERIFIED') AS v FROM ({_SCORED}) GROUP BY 1)")
def evaluate_by_label(spark, d):
    return evaluate.by_label(scored(spark, d).withColumn("label", F.expr("label div 10")))


@query(
    f"SELECT convention, {_TALLY} FROM (SELECT *, unnest(CASE WHEN len(g) > 0 THEN g ELSE ['none of these'] END) AS convention FROM (SELECT *, list_filter([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN label % 7 = 0 THEN 'seventh' END], lambda x: x IS NOT NULL) AS g FROM ({_SCORED}))) GROUP BY convention"
)
def evaluate_by_convention(spark, d):
    return evaluate.by_convention(scored(spark, d), {"long": F.col("n_chars") > 2000, "english": F.col("lang") == "en", "seventh": F.col("label") % 7 == 0})


@query(f"SELECT CASE WHEN claim = 'brand' AND string_split(a, ' ')[1] <> string_split(b, ' ')[1] THEN 'brand (display)' ELSE claim END AS grp, CAST(count(*) AS BIGINT) AS n FROM (SELECT claim, lang || ' Bold' AS a, CASE WHEN label % 2 = 0 THEN 'en Regular' ELSE 'de Thin' END AS b FROM ({_SCORED})) GROUP BY 1")
def evaluate_brand_group(spark, d):
    other = F.when(F.col("label") % 2 == 0, "en Regular").otherwise("de Thin")
    g = evaluate.brand_group(F.col("claim"), F.concat("lang", F.lit(" Bold")), other)
    return scored(spark, d).groupBy(g.alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_extendedprice AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE k = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1")
def evaluate_quantile(spark, d):
    return evaluate.quantile(table(spark, d, "lineitem"), "l_extendedprice", 0.95, "l_returnflag")


@query("SELECT l_extendedprice AS quantile FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem) WHERE k = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) + 1")
def evaluate_median(spark, d):
    """The median of all rows, without a group."""
    return evaluate.quantile(table(spark, d, "lineitem"), "l_extendedprice", 0.5)


@query("SELECT l_orderkey, list_sort(list(l_quantity))[2] AS median FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey HAVING count(*) = 3")
def evaluate_median_of_three(spark, d):
    three = table(spark, d, "lineitem").filter("l_linenumber <= 3")
    full = three.groupBy("l_orderkey").agg(F.count("*").alias("c")).filter("c = 3").select("l_orderkey")
    return evaluate.median_of_three(three.join(full, "l_orderkey", "left_semi"), "l_quantity", "l_orderkey")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS half, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def evaluate_half(spark, d):
    h = F.when(evaluate.half(F.col("o_orderkey"), "A"), "A").otherwise("B")
    return table(spark, d, "orders").groupBy(h.alias("half")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT DISTINCT n_name AS family FROM nation WHERE n_regionkey > 2 OR n_nationkey % 3 = 0 ORDER BY family")
def evaluate_leaked(spark, d):
    n = table(spark, d, "nation")
    return evaluate.leaked(n.select(F.col("n_name").alias("family")), n.filter("n_regionkey <= 2 and n_nationkey % 3 <> 0").select(F.col("n_name").alias("family")))


@query("SELECT source, round(avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END), 6) AS english, round(avg(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END), 6) AS long FROM documents GROUP BY source")
def evaluate_rates(spark, d):
    rate = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return table(spark, d, "documents").groupBy("source").agg(rate(F.col("lang") == "en", "english"), rate(F.col("n_chars") > 1000, "long"))


# Guards.


def request_log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("ts"), F.col("event_id").alias("request"), (F.abs("value") / 100).alias("cost"))


_LOG = "SELECT user_id AS key, ts, event_id AS request, abs(value) / 100 AS cost FROM events"


@query(
    f"WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, request) AS k, epoch_us(ts) / 1e6 AS t FROM ({_LOG})), w AS (SELECT key, k, request, t, CAST(1.0 AS DOUBLE) AS after, true AS admitted FROM l WHERE k = 1 UNION ALL SELECT l.key, l.k, l.request, l.t, least(2.0, w.after + (l.t - w.t) * 0.0001) - CASE WHEN least(2.0, w.after + (l.t - w.t) * 0.0001) >= 1 THEN 1 ELSE 0 END, least(2.0, w.after + (l.t - w.t) * 0.0001) >= 1 FROM w JOIN l ON l.key = w.key AND l.k = w.k + 1) SELECT key, request, admitted FROM w"
)
def guard_token_bucket(spark, d):
    return guards.token_bucket(request_log(spark, d), rate=0.0001, burst=2.0)


@query(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS key, request, coalesce(sum(CAST(round(cost * 1000000000) AS BIGINT)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60000000000 AS admitted "
    f"FROM ({_LOG})"
)
def guard_daily_budget(spark, d):
    return guards.daily_budget(request_log(spark, d), limit=60.0).withColumn("key", F.col("key").cast("string"))


# Recognition.

_CHARS = ["", *"ABCDEF", " "]


def frames(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("crop"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))).alias("t", "probs"))


@query(
    "WITH f AS (SELECT vec_id AS crop, t, list_slice(embedding, CAST(t * 8 + 1 AS INT), CAST(t * 8 + 8 AS INT)) AS p FROM embeddings, range(0, 8) r(t)), b AS (SELECT crop, t, list_position(p, list_max(p)) - 1 AS c, CAST(list_max(p) AS DOUBLE) AS m FROM f), e AS (SELECT *, c <> 0 AND coalesce(lag(c) OVER (PARTITION BY crop ORDER BY t), -1) <> c AS emit FROM b) "
    f"SELECT crop, trim(coalesce(string_agg({_CHARS}[c + 1], '' ORDER BY t) FILTER (WHERE emit), '')) AS text, round(coalesce(avg(m) FILTER (WHERE emit), 0.0), 6) AS confidence FROM e GROUP BY crop"
)
def recognition_ctc(spark, d):
    return ocrpost.ctc_decode(frames(spark, d), _CHARS).withColumn("confidence", F.round("confidence", 6))


@query("SELECT l_orderkey AS crop, l_returnflag AS text, l_discount AS confidence, l_linenumber AS turn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_discount, l_linenumber, l_returnflag) AS k FROM lineitem) WHERE k = 1")
def recognition_best(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("crop"), F.col("l_linenumber").alias("turn"), F.col("l_returnflag").alias("text"), F.col("l_discount").alias("confidence"))
    return ocrpost.best_reading(r)


@query()
def recognition_boxes(spark, d):
    """Boxes of 8 by 8 probability maps."""
    e = table(spark, d, "embeddings")
    maps = e.select(F.col("vec_id").alias("map"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v * 3 + 0.4))).alias("prob"), F.lit(64).alias("width"), F.lit(64).alias("height"))
    found = ocrpost.boxes(maps)
    return found.select("map", F.posexplode_outer("boxes").alias("k", "b")).select("map", "k", "b.*")


# Sinks and diagnoses.


@query(
    "WITH v AS (SELECT *, [r, s] AS x FROM (SELECT s_suppkey AS label, 10 AS r, 20 AS s, s_nationkey * 3 AS h FROM supplier)) SELECT label, greatest(10 - h // 3, 0)::INT AS x0, greatest(20 - h // 3, 0)::INT AS y0, least(60 + h // 3, 100)::INT AS x1, least(20 + h + h // 3, 70)::INT AS y1, h > 0 AS has_crop FROM v"
)
def sink_crop(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("label"), F.struct(F.lit(10).alias("x0"), F.lit(20).alias("y0"), F.lit(60).alias("x1"), (20 + F.col("s_nationkey") * 3).alias("y1")).alias("region"))
    box = sinks.crop_box(F.col("region"), F.lit(100), F.lit(70))
    plain = F.struct(F.lit(10).alias("x0"), F.lit(20).alias("y0"), F.lit(60).alias("x1"), F.lit(20).alias("y1"))
    return s.select("label", F.coalesce(box, plain).alias("b"), sinks.has_crop(F.col("region")).alias("has_crop")).select("label", "b.*", "has_crop")


@query()
def sink_results(spark, d):
    return sinks.results(_brand_verdicts(spark, d))


@query(
    f"SELECT label, 'producer_1' AS claim, round(h / (2.0 * length(a)), 6) AS distance FROM (SELECT label, a, {S.infix_cost('a', 'b', 2)} AS h FROM (SELECT label, {S.norm('name')} AS a, {S.norm('reading')} AS b FROM ({S.NAMES})))"
)
def diagnose_reach(spark, d):
    filed, det = _text_claims(spark, d)
    return diagnose.reach(det, C.candidates(filed)).select("label", "claim", F.round("distance", 6).alias("distance"))


_PROBE = f"SELECT label, a, {S.infix_cost('a', 'b', 2)} AS h, list_sum(list_transform(list_zip({S.histogram('a')}, {S.histogram('b')}), lambda x: greatest(x[1] - x[2], 0))) AS lacking FROM (SELECT label, {S.norm('name')} AS a, {S.norm('reading')} AS b FROM ({S.NAMES}))"


@query(
    f"SELECT label, 'producer_1' AS claim, d AS run_distance, d AS box_distance, CAST(NULL AS DOUBLE) AS pair_distance, d AS sequence_distance FROM (SELECT label, CASE WHEN 2 * lacking <= 2 * length(a) - 1 THEN round(h / (2.0 * length(a)), 6) END AS d FROM ({_PROBE}))"
)
def diagnose_probes(spark, d):
    filed, det = _text_claims(spark, d)
    p = diagnose.probes(det, C.candidates(filed))
    return p.select("label", "claim", *[F.round(f"{k}_distance", 6).alias(f"{k}_distance") for k in ("run", "box", "pair", "sequence")])


@query(
    f"WITH l AS (SELECT item_id AS label, i - 1 AS k, length(t) AS n, {S.norm('t')} AS a FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM benchmark)), "
    # In eight branches, which run side by side.
    + "p AS (" + " UNION ALL ".join(f"SELECT label, k, n, CASE WHEN contains(b, a) THEN 0 ELSE {S.infix_cost('a', 'b', 2)} END AS h, length(a) AS m FROM l, (SELECT {S.norm('text')} AS b FROM benchmark) WHERE length(a) >= 8 AND b <> '' AND label % 8 = {r}" for r in range(8)) + ") "
    "SELECT label, count(*) AS n, CAST(10 AS INT) AS x0, CAST(13 * min(k) AS INT) AS y0, CAST(10 + 8 * max(n) AS INT) AS x1, CAST(13 * max(k) + 12 AS INT) AS y1 FROM p WHERE h <= 0.25 * 2 * m GROUP BY label"
)
def diagnose_blocks(spark, d):
    return diagnose.block_boxes(lines_of_items(spark, d), table(spark, d, "benchmark").select("text")).select("label", "n", "region.*")
