"""SQL fragments of the oracles, independent of the engine's own expressions."""

from __future__ import annotations

from veriframe.functions.align import ALIKE
from veriframe.functions.text import CLASS_FROM, CLASS_TO, CLASSES, MARKED, PLAIN


def norm(x: str) -> str:
    """Normalized text; RE2 has no lookaround, so two passes keep separators between digits."""
    s = f"translate(upper(replace({x}, 'ß', 'S')), '{MARKED}', '{PLAIN}')"
    for _ in range(2):
        s = rf"regexp_replace({s}, '(\p{{Nd}})[.,](\p{{Nd}})', '\1' || chr(1) || '\2', 'g')"
    return rf"replace(regexp_replace({s}, '[^\p{{L}}\p{{Nd}}\x01]', '', 'g'), chr(1), '.')"


def fold(x: str) -> str:
    return f"translate({x}, '{CLASS_FROM}', '{CLASS_TO}')"


def histogram(x: str) -> str:
    return "[" + ", ".join(f"length({fold(x)}) - length(replace({fold(x)}, '{c}', ''))" for c in CLASSES) + "]"


def cost(a: str, b: str, cc: int = 1) -> str:
    pairs = ", ".join(f"'{p}'" for p in sorted(ALIKE))
    return f"CASE WHEN {a} = {b} THEN 0 WHEN list_contains([{pairs}], {a} || {b}) THEN {cc} ELSE 2 END"


def table(claim: str, read: str, first: str, cell: str, left: str = "2 * e[1]") -> str:
    """The last row of an alignment table, by a fold over the claim's characters within which a fold over the reading's grows a row."""
    return (
        f"list_reduce(list_concat([list_transform(range(0, length({read}) + 1), lambda j: ({first})::BIGINT)], list_transform(range(1, length({claim}) + 1), lambda i: [i::BIGINT])), "
        f"lambda prev, e: list_reduce(list_concat([[({left})::BIGINT]], list_transform(range(1, length({read}) + 1), lambda j: [j::BIGINT])), "
        f"lambda cur, f: list_append(cur, ({cell})::BIGINT)))"
    )


def half_edits(claim: str, read: str, cc: int = 1) -> str:
    sub = cost(f"substr({claim}, e[1], 1)", f"substr({read}, f[1], 1)", cc)
    return f"list_last({table(claim, read, '2 * j', f'least(prev[f[1]] + {sub}, prev[f[1] + 1] + 2, cur[f[1]] + 2)')})"


def infix_cost(claim: str, read: str, cc: int = 1) -> str:
    sub = cost(f"substr({claim}, e[1], 1)", f"substr({read}, f[1], 1)", cc)
    return f"list_min({table(claim, read, '0', f'least(prev[f[1]] + {sub}, prev[f[1] + 1] + 2, cur[f[1]] + 2)')})"


def infix_span(claim: str, read: str, cc: int = 1) -> str:
    """Cost, start and stop of the best stretch: a cell is a cost in millions and where its path began; of equal costs the diagonal, then the claim's character skipped."""
    sub = cost(f"substr({claim}, e[1], 1)", f"substr({read}, f[1], 1)", cc)
    d, u, left = f"(prev[f[1]] + 1000000 * {sub})", "(prev[f[1] + 1] + 2000000)", "(cur[f[1]] + 2000000)"
    cell = f"CASE WHEN {d} // 1000000 <= {u} // 1000000 AND {d} // 1000000 <= {left} // 1000000 THEN {d} WHEN {u} // 1000000 <= {left} // 1000000 THEN {u} ELSE {left} END"
    row = table(claim, read, "j", cell, "2000000 * e[1]")
    return f"list_min(list_transform({row}, lambda x, j: (x // 1000000) * 1000000000000 + (j - 1) * 1000000 + x % 1000000))"


def common(a: str, b: str) -> str:
    sub = cost(f"substr({a}, e[1], 1)", f"substr({b}, f[1], 1)")
    return f"list_last({table(a, b, '0', f'CASE WHEN {sub} < 2 THEN prev[f[1]] + 1 ELSE greatest(prev[f[1] + 1], cur[f[1]]) END', '0')})"


def trimmed(s: str) -> str:
    return f"CASE WHEN contains({s}, '.') THEN regexp_replace({s}, '\\.?0+$', '') ELSE {s} END"


def shortest(v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


def lines() -> str:
    """Detections from documents: one line, one box."""
    return (
        "SELECT doc_id AS label, CAST(i - 1 AS INT) AS det_idx, 10 AS x0, CAST(13 * (i - 1) AS INT) AS y0, CAST(10 + 8 * length(t) AS INT) AS x1, CAST(13 * (i - 1) + 12 AS INT) AS y1, t AS text, "
        "CAST(((doc_id * 7 + (i - 1) * 13) % 10) AS DOUBLE) / 10.0 AS confidence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"
    )


def words() -> str:
    """Detections from benchmark items: one word, one box, 8 to a character."""
    return (
        "SELECT item_id AS label, CAST(row_number() OVER (PARTITION BY item_id ORDER BY l, k) - 1 AS INT) AS det_idx, CAST(8 * (s - length(w) - 1) AS INT) AS x0, CAST(13 * l AS INT) AS y0, CAST(8 * (s - 1) AS INT) AS x1, CAST(13 * l + 12 AS INT) AS y1, w AS text, CAST(0.9 AS DOUBLE) AS confidence "
        "FROM (SELECT *, sum(length(w) + 1) OVER (PARTITION BY item_id, l ORDER BY k) AS s FROM (SELECT item_id, l, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS k "
        "FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM benchmark))) WHERE w <> ''"
    )


def uneven() -> str:
    """The words, each a little lower or higher than its neighbours, some taller."""
    return f"SELECT label, det_idx, x0, CAST(y0 + det_idx * 5 % 9 AS INT) AS y0, x1, CAST(y1 + det_idx * 5 % 9 + det_idx % 4 * 3 AS INT) AS y1, text, confidence FROM ({words()})"


def in_reading_order(boxes: str) -> str:
    """label, det_idx and pos by a fold: what is placed so far, of which each line's last box is marked."""
    e, h = "e[1]", "least(o.y1 - o.y0, e[1].y1 - e[1].y0)"
    met = f"list_min(list_transform(list_filter(acc, lambda o: o.last AND {h} > 0 AND least(o.y1, {e}.y1) - greatest(o.y0, {e}.y0) > {h} // 2), lambda o: o.line))"
    line = f"coalesce({met}, list_max(list_transform(acc, lambda o: o.line)) + 1)"
    pack = lambda o, line, k, last: f"struct_pack(det_idx := {o}.det_idx, x0 := {o}.x0, y0 := {o}.y0, y1 := {o}.y1, line := {line}, k := {k}, last := {last})"
    return (
        f"SELECT label, det_idx, CAST(row_number() OVER (PARTITION BY label ORDER BY line, x0, k) - 1 AS INT) AS pos FROM (SELECT label, unnest(placed, recursive := true) FROM (SELECT label, list_reduce(boxes, "
        f"lambda acc, e: list_append(list_transform(acc, lambda o: {pack('o', 'o.line', 'o.k', f'o.last AND o.line <> {line}')}), {pack(e, line, 'len(acc)', 'true')})) AS placed "
        f"FROM (SELECT label, list([struct_pack(det_idx := det_idx, x0 := x0, y0 := y0, y1 := y1, line := 0::BIGINT, k := 0::BIGINT, last := true)] ORDER BY y0, x0, det_idx) AS boxes FROM ({boxes}) GROUP BY label)))"
    )


FOLLOWS = (
    "least(a.y1 - a.y0, b.y1 - b.y0) > 0 AND CASE WHEN least(a.y1, b.y1) - greatest(a.y0, b.y0) > least(a.y1 - a.y0, b.y1 - b.y0) // 2 THEN b.x0 >= a.x0 AND b.x0 - a.x1 <= least(a.y1 - a.y0, b.y1 - b.y0) "
    "ELSE 2 * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) >= least(a.x1 - a.x0, b.x1 - b.x0) AND b.y0 - a.y1 >= -(least(a.y1 - a.y0, b.y1 - b.y0) // 2) AND b.y0 - a.y1 <= least(a.y1 - a.y0, b.y1 - b.y0) END"
)

# Names of parts and what is read of them: as filed, confused, a character lost, inside a longer name, before a comma, something else.
NAMES = (
    "SELECT p_partkey AS label, p_name AS name, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN translate(upper(p_name), 'OISB', '0158') WHEN 2 THEN substr(p_name, 1, 2) || substr(p_name, 4) "
    "WHEN 3 THEN 'THE ' || p_name WHEN 4 THEN p_name || ', ' || p_brand ELSE p_type END AS reading FROM part"
)
