"""The fixtures and every query's answer again, as plain SQL for comparison."""

from __future__ import annotations

from terraquilt.model import DEFAULT_LON0, EARTH_RADIUS_M, ECC, ECC2

A = repr(EARTH_RADIUS_M)


def q(y: str) -> str:
    s = f"sin(radians({y}))"
    return (
        f"({1 - ECC2!r}::DOUBLE * ({s} / (1 - {ECC2!r}::DOUBLE * {s} * {s})"
        f" - ln((1 - {ECC!r}::DOUBLE * {s}) / (1 + {ECC!r}::DOUBLE * {s})) / (2 * {ECC!r}::DOUBLE)))"
    )


def hectares(xa: str, xb: str, ya: str, yb: str) -> str:
    return f"({A}::DOUBLE * radians({xb} - {xa}) * {A}::DOUBLE * ({q(yb)} - {q(ya)}) / 2 / 10000)"


def overlap(a: str, b: str, strict: bool = False) -> str:
    op = "<" if strict else "<="
    return (
        f"greatest({a}.x0, {b}.x0) {op} least({a}.x1, {b}.x1)"
        f" AND greatest({a}.y0, {b}.y0) {op} least({a}.y1, {b}.y1)"
    )


def clipped(a: str, b: str) -> str:
    return hectares(
        f"greatest({a}.x0, {b}.x0)",
        f"least({a}.x1, {b}.x1)",
        f"greatest({a}.y0, {b}.y0)",
        f"least({a}.y1, {b}.y1)",
    )


def rect(inner: str, x0: str, y0: str, w: str, h: str) -> str:
    return (
        f"SELECT *, x0 + {w} AS x1, y0 + {h} AS y1 FROM"
        f" (SELECT *, ({x0})::DOUBLE AS x0, ({y0})::DOUBLE AS y0 FROM ({inner}) i) j"
    )


SEASON_START = "(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END)"

CTES = {
    "lga": rect(
        "SELECT n_nationkey AS lga_id, 'LGA ' || n_nationkey AS LGA_NAME19,"
        " 10000 + 10 * n_nationkey AS LGA_CODE_2019, n_regionkey AS STE_CODE16 FROM nation",
        "148 + lga_id % 5", "-36 + lga_id // 5", "1.0::DOUBLE", "1.0::DOUBLE",
    ),
    "fires": "SELECT *, CASE WHEN Label IS NULL THEN NULL ELSE split_part(Label, ' ', 1) END AS FireSeason,"
    " CASE WHEN strpos(Label, ' ') > 0 THEN substr(Label, strpos(Label, ' ') + 1) END AS FireType FROM ("
    + rect(
        "SELECT o_orderkey AS fire_id, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS FireNo,"
        " CASE WHEN o_orderkey % 33 <> 0 THEN 'Fire ' || o_orderkey END AS FireName,"
        " CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'Unknown'"
        f" ELSE {SEASON_START} || '-' || lpad((({SEASON_START} + 1) % 100)::VARCHAR, 2, '0')"
        " || ' ' || o_orderpriority END AS Label, o_totalprice / 100 AS AreaHa,"
        " o_orderdate AS StartDate, o_orderdate AS od FROM orders",
        "147.5 + ((37 * fire_id) % 384) / 64.0",
        "-36.5 + ((53 * fire_id + 7 * (fire_id // 384)) % 384) / 64.0",
        "((1 + fire_id % 16) / 64.0)::DOUBLE",
        "((1 + fire_id % 11) / 64.0)::DOUBLE",
    )
    + ") f",
    "crowded": rect(
        "SELECT o_orderkey AS fire_id FROM orders", "148.9375 + (fire_id % 4) / 64.0", "-35.0625 + (fire_id % 16 // 4) / 64.0",
        "((8 + fire_id % 5) / 64.0)::DOUBLE", "((8 + fire_id % 5) / 64.0)::DOUBLE",
    ),
    "squares": "SELECT DISTINCT FireSeason, cx.c AS cx, cy.c AS cy FROM fires, unnest(range(floor(x0 * 16)::BIGINT,"
    " floor(x1 * 16)::BIGINT + 1)) AS cx(c), unnest(range(floor(y0 * 16)::BIGINT, floor(y1 * 16)::BIGINT + 1)) AS cy(c)"
    " WHERE FireSeason IS NOT NULL",
    "landuse": rect(
        "SELECT p_partkey AS landuse_id, CASE WHEN p_partkey % 71 <> 0 THEN p_type END AS Secondary FROM part",
        "147.75 + ((29 * landuse_id) % 320) / 64.0",
        "-36.25 + ((41 * landuse_id + 5 * (landuse_id // 320)) % 320) / 64.0",
        "((4 + landuse_id % 32) / 64.0)::DOUBLE",
        "((4 + landuse_id % 23) / 64.0)::DOUBLE",
    ),
    "towers": "SELECT CASE k % 5 WHEN 0 THEN 'GSM' WHEN 1 THEN 'UMTS' WHEN 2 THEN 'LTE' WHEN 3 THEN 'CDMA'"
    " ELSE 'NR' END AS radio, 500 + k % 5 AS mcc, k % 30 AS net, k AS cell,"
    " (148 + ((37 * k) % 320) / 64.0)::DOUBLE AS lon, (-36 + ((53 * k) % 320) / 64.0)::DOUBLE AS lat,"
    " CASE WHEN k % 101 <> 0 THEN od END AS created, od + to_days((k % 1000)::INTEGER) AS updated"
    " FROM (SELECT o_orderkey AS k, date_trunc('day', o_orderdate)::TIMESTAMP AS od FROM orders) o",
    "codes": "SELECT (500 + n_regionkey)::BIGINT AS MCC, n_nationkey::BIGINT AS MNC,"
    " CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 'Op ' || n_name END AS Description FROM nation"
    " UNION ALL SELECT (500 + r_regionkey)::BIGINT, r_regionkey::BIGINT, 'Op ' || r_name FROM region"
    " UNION ALL SELECT (600 + s_nationkey)::BIGINT, s_suppkey,"
    " CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE 'Op ' || s_name END FROM supplier",
    "codes_numbered": "SELECT *, (dense_rank() OVER (ORDER BY Description) - 1)::INTEGER AS Description_code FROM codes",
    "towers_prepared": "SELECT *, radians(lon) * 6378137.0::DOUBLE AS x_3857,"
    " ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0::DOUBLE AS y_3857,"
    " (dense_rank() OVER (ORDER BY radio) - 1)::INTEGER AS radio_code"
    " FROM towers WHERE created >= TIMESTAMP '1998-01-01'",
    "spots": "SELECT event_id AS row_id, event_type, (148 + ((37 * event_id) % 320) / 64.0 + 1 / 128.0)::DOUBLE AS x,"
    " (-36 + ((53 * event_id) % 320) / 64.0 + 1 / 128.0)::DOUBLE AS y FROM events",
    "occurrences": "SELECT event_id AS row_id, (-36 + ((53 * event_id) % 320) / 64.0 + 1 / 128.0)::DOUBLE AS Latitude,"
    " (148 + ((37 * event_id) % 320) / 64.0 + 1 / 128.0)::DOUBLE AS Longitude,"
    ' event_type AS "Scientific Name - original", \'LGA \' || (user_id % 25) AS "Local Government Areas 2011",'
    " CASE WHEN event_id % 40 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS \"Event Date - parsed\" FROM events",
    "selection": "SELECT 2 * event_id + again AS pos, event_id AS row_id FROM events, (VALUES (0), (1)) t(again)"
    " WHERE event_id % 7 = 3",
    "indicators": 'SELECT n_name AS "Country Name", o_orderpriority AS "Indicator Name",'
    " year(o_orderdate)::INTEGER AS Year, round(sum(o_totalprice), 2) AS Value"
    " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3",
    "managed_land": rect(
        "SELECT s_suppkey AS land_id, s_name AS NAME_SHORT, 'TYPE ' || (s_nationkey % 4) AS TYPE FROM supplier",
        "148 + ((29 * land_id) % 320) / 64.0", "-36 + ((41 * land_id) % 320) / 64.0",
        "0.25::DOUBLE", "0.25::DOUBLE",
    ),
    "segments": "SELECT * FROM (VALUES (0, 0, 1, 0), (1, 0, 1, 0.25), (0.375, 0.25, 1, 0.25), (0.375, 0.25, 0.375, 1),"
    " (0, 1, 0.375, 1), (0, 0, 0, 1), (0.125, 0.5, 0.125, 0.75), (0.125, 0.75, 0.25, 0.75), (0.25, 0.5, 0.25, 0.75),"
    " (0.125, 0.5, 0.25, 0.5)) s(x0, y0, x1, y1)",
    "corners": "SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(pos, rx, ry)",
    "lga_fire_pairs": "SELECT l.*, f.* EXCLUDE (x0, y0, x1, y1), "
    + clipped("l", "f") + " AS ha FROM lga l JOIN fires f ON " + overlap("l", "f"),
    "lga_landuse": "SELECT landuse_id, Secondary, LGA_NAME19, LGA_CODE_2019, greatest(l.x0, u.x0) AS x0,"
    " greatest(l.y0, u.y0) AS y0, least(l.x1, u.x1) AS x1, least(l.y1, u.y1) AS y1, "
    + clipped("l", "u") + " AS ha FROM lga l JOIN landuse u ON " + overlap("l", "u"),
}
NEEDS = {
    "lga_fire_pairs": ["lga", "fires"],
    "lga_landuse": ["lga", "landuse"],
    "squares": ["fires"],
    "codes_numbered": ["codes"],
    "towers_prepared": ["towers"],
}


def sql(names: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {parts}\n{body}" if parts else body


FIRE_GROUPS = (
    "SELECT LGA_NAME19, LGA_CODE_2019, FireSeason AS FIRESEASON, FireType AS FIRETYPE,"
    " count(*) AS FIRECOUNT, round(sum(ha), 2) AS AREAHA FROM lga_fire_pairs"
    " WHERE FireSeason IS NOT NULL AND FireType IS NOT NULL {} GROUP BY 1, 2, 3, 4"
)
LANDUSE_GROUPS = (
    "SELECT LGA_NAME19, LGA_CODE_2019, Secondary AS LANDUSETYPE, round(sum(ha), 2) AS AREAHA"
    " FROM lga_landuse WHERE Secondary IS NOT NULL GROUP BY 1, 2, 3"
)


def in_places(x0: str, y0: str, x1: str, y1: str) -> str:
    """Whether a closed rectangle, or a line or point in that form, meets the place of a tile `p`: one leg of its
    L, or the other one but not only the open hole in it."""
    return (
        f"(({x1} >= p.x0 AND {x0} <= p.x0 + 1 AND {y1} >= p.y0 AND {y0} <= p.y0 + 0.25)"
        f" OR ({x1} >= p.x0 AND {x0} <= p.x0 + 0.375 AND {y1} >= p.y0 AND {y0} <= p.y0 + 1 AND NOT ("
        f"greatest({x0}, p.x0) > p.x0 + 0.125 AND least({x1}, p.x0 + 0.375) < p.x0 + 0.25"
        f" AND greatest({y0}, p.y0) > p.y0 + 0.5 AND least({y1}, p.y0 + 1) < p.y0 + 0.75)))"
    )


#: The boundary of a tile's place as horizontal and vertical segments, and its tile cut into 1/32 cells.
COVER = """
SELECT place_id, cx, cy, bool_and(NOT border) AS inside FROM (
  SELECT p.lga_id AS place_id, cx, cy, x0, y0,
    EXISTS (SELECT 1 FROM segments s WHERE cx BETWEEN floor((p.x0 + s.x0) * 32) AND floor((p.x0 + s.x1) * 32)
      AND cy BETWEEN floor((p.y0 + s.y0) * 32) AND floor((p.y0 + s.y1) * 32)) AS border
  FROM lga p, (SELECT unnest(range(0, 33)) AS dx) a, (SELECT unnest(range(0, 33)) AS dy) b,
    LATERAL (SELECT (floor(p.x0 * 32) + dx)::BIGINT AS cx, (floor(p.y0 * 32) + dy)::BIGINT AS cy) c
) t WHERE border OR (
  (cy + 0.5) / 32 - y0 BETWEEN 0 AND 1 AND (cx + 0.5) / 32 - x0 BETWEEN 0 AND 1
  AND ((cy + 0.5) / 32 - y0 < 0.25 OR (cx + 0.5) / 32 - x0 < 0.375)
  AND NOT ((cx + 0.5) / 32 - x0 BETWEEN 0.125 AND 0.25 AND (cy + 0.5) / 32 - y0 BETWEEN 0.5 AND 0.75))
GROUP BY place_id, cx, cy
"""
VERTICES = (
    "SELECT {id}, 0 AS ring, 0 AS part, false AS hole, pos, CASE WHEN rx = 1 THEN x1 ELSE x0 END AS x,"
    " CASE WHEN ry = 1 THEN y1 ELSE y0 END AS y FROM {t} CROSS JOIN corners"
)
OCC = "occurrences"
PLAIN_LAND = 'SELECT land_id, NAME_SHORT, TYPE, x0, y0, x1, y1 FROM managed_land'
TOWER_OUT = (
    "radio, mcc, net, cell, lon, lat, created, updated, round(x_3857, 3) AS x_3857,"
    " round(y_3857, 3) AS y_3857, radio_code"
)


def _transposed() -> str:
    """The first three rows of towers_enriched on their side, all columns as text."""
    cols = ["radio", "mcc", "net", "cell", "lon", "lat", "created", "updated", "x_3857", "y_3857", "radio_code"]
    cols += ["code_mcc", "code_mnc", "Description", "Description_code"]
    pick = ", ".join(f"max(CASE WHEN r = {i} THEN v END) AS \"row_{i}\"" for i in (1, 2, 3))
    text = {"x_3857": "x_3857::DECIMAL(18,3)", "y_3857": "y_3857::DECIMAL(18,3)"}
    rows = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", r, {text.get(c, c)}::VARCHAR AS v FROM few" for c in cols)
    return (
        f"SELECT \"column\", {pick} FROM (WITH few AS (SELECT *, row_number() OVER (ORDER BY cell, Description NULLS FIRST) AS r FROM ("
        + ENRICHED + f") e ORDER BY r LIMIT 3) {rows}) u GROUP BY 1"
    )


def hectares_or_0(a: str, b: tuple[str, str, str, str]) -> str:
    """Hectares of a rectangle table's row clipped to another rectangle, 0 where they don't meet."""
    x0, y0, x1, y1 = (f"{f}({a}.{c}, {v})" for f, c, v in zip(("greatest", "greatest", "least", "least"), ("x0", "y0", "x1", "y1"), b))
    return f"CASE WHEN {x0} < {x1} AND {y0} < {y1} THEN {hectares(x0, x1, y0, y1)} ELSE 0 END"


def _place_hectares() -> str:
    """A fire clipped to a tile's place: both legs of the L, less where they overlap and the hole."""
    parts = [(1, (0, 0, 1, 0.25)), (1, (0, 0, 0.375, 1)), (-1, (0, 0, 0.375, 0.25)), (-1, (0.125, 0.5, 0.25, 0.75))]
    return " + ".join(
        f"{sign} * ({hectares_or_0('f', tuple(f'p.{c} + {v}' for c, v in zip(('x0', 'y0', 'x0', 'y0'), own)))})" for sign, own in parts
    )


ENRICHED = (
    f"SELECT {TOWER_OUT}, code_mcc, code_mnc, Description, Description_code FROM towers_prepared LEFT JOIN"
    " (SELECT MCC AS code_mcc, MNC AS code_mnc, Description, Description_code FROM codes_numbered) c"
    " ON mcc IS NOT DISTINCT FROM code_mcc AND net IS NOT DISTINCT FROM code_mnc"
)
ORACLE = {
    "lga_fire_stats": sql("lga_fire_pairs", FIRE_GROUPS.format("")),
    "lga_fire_stats_state": sql("lga_fire_pairs", FIRE_GROUPS.format("AND STE_CODE16 = 1")),
    "lga_fire_stats_polygon_only": sql("lga_fire_pairs", FIRE_GROUPS.format("AND ha > 0")),
    "lga_fire_stats_shuffled": sql("lga_fire_pairs", FIRE_GROUPS.format("")),
    "lga_fire_grouped": sql(
        "lga_fire_pairs",
        "SELECT LGA_NAME19 AS LGA_NAME, LGA_CODE_2019::VARCHAR AS LGA_CODE, FIRESEASON, FIRETYPE, FIRECOUNT, AREAHA"
        " FROM (" + FIRE_GROUPS.format("") + ") g",
    ),
    "intersection_by_lga": sql(
        "lga_fire_pairs",
        "SELECT LGA_NAME19, count(*) AS PAIRS, round(sum(ha), 2) AS AREAHA FROM lga_fire_pairs GROUP BY 1",
    ),
    "lga_landuse_stats": sql("lga_landuse", LANDUSE_GROUPS),
    "landuse_burnt": sql(
        "lga_landuse fires",
        "SELECT t.LANDUSETYPE, FIRESEASON, round(coalesce(BURNTHA, 0), 2) AS BURNTHA, round(TOTALHA, 2) AS TOTALHA,"
        " round(100 * coalesce(BURNTHA, 0) / TOTALHA, 4) AS BURNTPCT FROM (SELECT Secondary AS LANDUSETYPE,"
        " FireSeason AS FIRESEASON, sum(" + clipped("u", "f") + ") AS BURNTHA FROM lga_landuse u JOIN fires f ON "
        + overlap("u", "f", True) + " WHERE u.ha > 0 AND Secondary IS NOT NULL AND FireSeason IS NOT NULL"
        " GROUP BY 1, 2) b RIGHT JOIN (SELECT Secondary AS LANDUSETYPE, sum(ha) AS TOTALHA FROM lga_landuse"
        " WHERE ha > 0 AND Secondary IS NOT NULL GROUP BY 1) t ON b.LANDUSETYPE = t.LANDUSETYPE",
    ),
    "landuse_compare": sql(
        "lga_landuse",
        "SELECT LGA_CODE_2019, LANDUSETYPE, round(AREAHA, 2) AS AREAHA, OTHERHA,"
        " round(coalesce(AREAHA, 0) - coalesce(OTHERHA, 0), 2) AS DIFFHA FROM"
        " (SELECT LGA_CODE_2019, Secondary AS LANDUSETYPE, sum(ha) AS AREAHA FROM lga_landuse"
        " WHERE Secondary IS NOT NULL GROUP BY 1, 2) a FULL JOIN (SELECT (10000 + 10 * (p_partkey % 30))::INTEGER"
        " AS LGA_CODE_2019, p_type AS LANDUSETYPE, sum(p_size)::DOUBLE AS OTHERHA FROM part GROUP BY 1, 2) b"
        " USING (LGA_CODE_2019, LANDUSETYPE)",
    ),
    "season_type_area": sql(
        "fires",
        "SELECT FireSeason, FireType, round(sum(AreaHa), 4) AS AreaHa FROM fires"
        " WHERE FireSeason IS NOT NULL AND FireType IS NOT NULL GROUP BY 1, 2",
    ),
    "fire_count_per_lga": sql(
        "lga_fire_pairs",
        "SELECT l.LGA_NAME19, l.LGA_CODE_2019, count(p.fire_id) AS FIRECOUNT FROM lga l LEFT JOIN lga_fire_pairs p"
        " ON l.LGA_CODE_2019 = p.LGA_CODE_2019 GROUP BY 1, 2",
    ),
    "area_blowout": sql(
        "lga_fire_pairs",
        "SELECT fire_id, count(*) AS LGAS, round(sum(AreaHa), 4) AS STATEDHA, round(sum(ha), 2) AS CLIPPEDHA"
        " FROM lga_fire_pairs GROUP BY 1",
    ),
    "landuse_area": sql(
        "landuse", "SELECT landuse_id, round(" + hectares("x0", "x1", "y0", "y1") + ", 2) AS AREAHA FROM landuse"
    ),
    "polygon_area": sql(
        "fires", "SELECT fire_id, round(" + hectares("x0", "x1", "y0", "y1") + ", 2) AS AREAHA FROM fires"
    ),
    "clipped_fires": sql(
        "lga_fire_pairs",
        "SELECT LGA_CODE_2019, fire_id, round(ha, 2) AS AREAHA, 5 AS POINTS FROM lga_fire_pairs WHERE ha > 0",
    ),
    "planar_conservation": sql(
        "fires",
        "SELECT fire_id, round((x1 - x0) * (y1 - y0) / 2, 13) AS DEG2 FROM fires",
    ),
    "overlay_bowtie": sql(
        "fires",
        "SELECT fire_id, round((x1 - x0) * (y1 - y0) / 2, 13) AS DEG2 FROM fires",
    ),
    "overlay_holes": sql(
        "lga fires",
        "SELECT place_id, count(*) AS PAIRS, round(sum(ha), 2) AS AREAHA FROM (SELECT p.lga_id AS place_id, "
        + _place_hectares() + " AS ha FROM lga p JOIN fires f ON " + overlap("p", "f", True) + ") t WHERE ha > 1e-6 GROUP BY 1",
    ),
    "overlay_cut": sql("lga_fire_pairs", "SELECT lga_id, count(*) AS PAIRS, round(sum(ha), 2) AS AREAHA FROM lga_fire_pairs GROUP BY 1"),
    "overlay_hot": sql(
        "lga crowded",
        "SELECT lga_id, count(*) AS PAIRS, round(sum(" + clipped("l", "f") + "), 2) AS AREAHA FROM lga l JOIN crowded f ON "
        + overlap("l", "f") + " GROUP BY 1",
    ),
    "group_outline": sql(
        "squares",
        "SELECT FireSeason, round(count(*) / 256, 9) AS AREA, round((4 * count(*) - 2 * sum(beside)) / 16, 9) AS LENGTH FROM ("
        "SELECT s.FireSeason, (SELECT count(*) FROM squares t WHERE t.FireSeason = s.FireSeason AND"
        " ((t.cx = s.cx + 1 AND t.cy = s.cy) OR (t.cx = s.cx AND t.cy = s.cy + 1))) AS beside FROM squares s) u GROUP BY 1",
    ),
    "lga_projected": sql(
        "lga corners",
        f"SELECT lga_id, pos, round({A}::DOUBLE * radians(x - {DEFAULT_LON0}::DOUBLE), 3) AS x, round({A}::DOUBLE * " + q("y")
        + " / 2, 3) AS y FROM (SELECT lga_id, pos, CASE WHEN rx = 1 THEN x1 ELSE x0 END AS x, CASE WHEN ry = 1 THEN y1 ELSE y0 END AS y"
        " FROM lga CROSS JOIN corners) v",
    ),
    "towers_heavy": sql(
        "towers codes",
        "SELECT cell, t.mcc, t.net, Description FROM (SELECT cell, CASE WHEN cell % 2 = 0 THEN 500 ELSE mcc END AS mcc,"
        " CASE WHEN cell % 2 = 0 THEN 0 ELSE net END AS net FROM towers) t LEFT JOIN codes c ON t.mcc = c.MCC AND t.net = c.MNC",
    ),
    "table_pages": sql(
        OCC,
        'SELECT row_id, Latitude, Longitude, "Scientific Name - original", "Local Government Areas 2011", r // 10 AS page FROM ('
        'SELECT *, row_number() OVER (ORDER BY "Scientific Name - original", "Local Government Areas 2011" DESC, row_id) - 1 AS r,'
        " (count(*) OVER () - 1) // 10 AS last FROM occurrences) t WHERE r // 10 IN (0, last // 2, last)",
    ),
    "positions": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, event_id, user_id FROM events",
    "sink_seasons": sql(
        "fires",
        "SELECT fire_id, FireSeason, FireType, round(CASE WHEN FireSeason = '1997-98' THEN 2 ELSE 1 END * AreaHa, 4) AS AreaHa"
        " FROM fires WHERE FireSeason IS DISTINCT FROM '1997-98' OR fire_id % 2 = 0",
    ),
    "label_split": sql("fires", "SELECT fire_id, Label, FireSeason, FireType FROM fires"),
    "fires_filtered": sql(
        "fires",
        "SELECT fire_id, FireSeason, FireType, date_trunc('day', StartDate)::TIMESTAMP AS StartDate,"
        " CASE WHEN fire_id % 40 <> 0 THEN date_trunc('day', StartDate)::TIMESTAMP + to_days((fire_id % 20)::INTEGER)"
        " END AS EndDate, '2020-02-03' AS DateUpdated FROM fires"
        " WHERE FireSeason = '1997-98' AND FireType = '1-URGENT'",
    ),
    "fire_popups": sql(
        "fires",
        "SELECT fire_id, 'Fire name: ' || coalesce(FireName, 'None') || ' <br>Burnt Area (ha): ' ||"
        " coalesce(AreaHa::VARCHAR, 'None') AS popup FROM fires",
    ),
    "towers_prepared": sql("towers_prepared", f"SELECT {TOWER_OUT} FROM towers_prepared"),
    "towers_projected": sql(
        "towers",
        "SELECT cell, round(radians(lon) * 6378137.0::DOUBLE, 3) AS x_3857,"
        " round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0::DOUBLE, 3) AS y_3857 FROM towers",
    ),
    "network_codes": sql("codes_numbered", "SELECT MCC, MNC, Description, Description_code FROM codes_numbered"),
    "towers_enriched": sql(
        "towers_prepared codes_numbered",
        ENRICHED,
    ),
    "towers_preview": sql("towers_prepared codes_numbered", _transposed()),
    "towers_head": sql("towers", "SELECT radio, mcc, net, cell, lon, lat FROM towers ORDER BY cell LIMIT 5"),
    "table_info": sql(
        OCC,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{t}' AS type, count(\"{c}\") AS non_null FROM occurrences"
            for c, t in (
                ("row_id", "bigint"),
                ("Latitude", "double"),
                ("Longitude", "double"),
                ("Scientific Name - original", "string"),
                ("Local Government Areas 2011", "string"),
                ("Event Date - parsed", "string"),
            )
        ),
    ),
    "selected_rows": sql(
        "occurrences selection",
        'SELECT pos, o.row_id, Latitude, Longitude, "Scientific Name - original", "Local Government Areas 2011"'
        " FROM occurrences o JOIN selection s ON o.row_id = s.row_id",
    ),
    "selection_count": sql("selection", "SELECT count(*) AS n FROM selection"),
    "table_page": sql(
        OCC,
        'SELECT row_id, Latitude, Longitude, "Scientific Name - original", "Local Government Areas 2011"'
        ' FROM occurrences ORDER BY "Scientific Name - original", "Local Government Areas 2011" DESC, row_id'
        " LIMIT 10 OFFSET 20",
    ),
    "distinct_lga": sql(
        OCC,
        'SELECT "Local Government Areas 2011" AS value, min(row_id) AS first_row FROM occurrences GROUP BY 1',
    ),
    "year_range": sql("indicators", "SELECT min(Year) AS min_value, max(Year) AS max_value FROM indicators"),
    "indicator_pairs": sql(
        "indicators",
        'SELECT a."Country Name", a.Value AS x, b.Value AS y FROM indicators a JOIN indicators b'
        ' ON a."Country Name" = b."Country Name" AND a.Year = b.Year WHERE a.Year = 1997'
        " AND a.\"Indicator Name\" = '1-URGENT' AND b.\"Indicator Name\" = '5-LOW'",
    ),
    "indicator_series": sql(
        "indicators",
        "SELECT Year, Value, round(log10(Value), 9) AS axis_value, '<b>' || \"Country Name\" || '</b><br>' ||"
        " \"Indicator Name\" AS title FROM indicators WHERE \"Country Name\" = 'NATION_7'"
        " AND \"Indicator Name\" = '2-HIGH'",
    ),
    "point_layer": sql(
        OCC,
        "SELECT row_id, Longitude AS x, Latitude AS y, 'Collection Date:' || \"Event Date - parsed\" AS hover"
        " FROM occurrences",
    ),
    "points_reprojected": sql(
        OCC,
        "SELECT row_id, round(radians(Longitude) * 6378137.0::DOUBLE, 3) AS mx,"
        " round(ln(tan(radians(Latitude) / 2 + pi() / 4)) * 6378137.0::DOUBLE, 3) AS my,"
        f" round(radians(Longitude - {DEFAULT_LON0}::DOUBLE) * 6378137.0::DOUBLE, 3) AS ex,"
        f" round({A}::DOUBLE * " + q("Latitude") + " / 2, 3) AS ey, Longitude AS dx, Latitude AS dy FROM occurrences",
    ),
    "cell_cover": sql(
        "fires",
        "SELECT fire_id, cx.c AS cx, cy.c AS cy FROM fires, unnest(range(floor(x0 / 0.25)::BIGINT,"
        " floor(x1 / 0.25)::BIGINT + 1)) AS cx(c), unnest(range(floor(y0 / 0.25)::BIGINT,"
        " floor(y1 / 0.25)::BIGINT + 1)) AS cy(c)",
    ),
    "choropleth_layer": sql(
        "managed_land",
        "SELECT NAME_SHORT AS id, TYPE AS value, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM managed_land",
    ),
    "choropleth_values": sql(
        "managed_land",
        "SELECT m.NAME_SHORT, m.TYPE, v.spend FROM managed_land m JOIN (SELECT l_suppkey, sum(l_quantity) AS spend"
        " FROM lineitem GROUP BY 1) v ON v.l_suppkey = m.land_id",
    ),
    "polygon_cover": sql("lga segments", COVER),
    "osm_in_place": sql(
        "lga spots",
        "SELECT DISTINCT row_id, x, y FROM spots s JOIN lga p ON " + in_places("x", "y", "x", "y") + " WHERE event_type = 'click'",
    ),
    "osm_land_in_place": sql(
        "lga managed_land",
        "SELECT DISTINCT land_id, NAME_SHORT FROM managed_land m JOIN lga p ON " + in_places("m.x0", "m.y0", "m.x1", "m.y1"),
    ),
    "osm_mixed": sql(
        "lga spots fires landuse",
        "SELECT DISTINCT 'node' AS element, row_id AS osmid, 'point' AS kind FROM spots s JOIN lga p ON "
        + in_places("x", "y", "x", "y") + " WHERE event_type = 'click'"
        " UNION ALL SELECT DISTINCT 'way', fire_id, 'line' FROM fires f JOIN lga p ON (" + in_places("f.x0", "f.y0", "f.x1", "f.y0")
        + " OR " + in_places("f.x1", "f.y0", "f.x1", "f.y1") + ") WHERE fire_id % 3 = 0"
        " UNION ALL SELECT DISTINCT 'relation', landuse_id, 'polygon' FROM landuse u JOIN lga p ON "
        + in_places("u.x0", "u.y0", "u.x1", "u.y1") + " WHERE landuse_id % 2 = 0",
    ),
    "feature_property": "SELECT s_suppkey AS doc_id, i AS pos, 'Unit ' || ((s_suppkey + i) % 7) AS MapUnitNa"
    " FROM supplier CROSS JOIN (VALUES (0), (1), (2)) v(i)",
    "wkt_roundtrip": sql("landuse corners", VERTICES.format(id="landuse_id", t="landuse")),
    "wkb_roundtrip": sql("landuse corners", VERTICES.format(id="landuse_id", t="landuse")),
    "geojson_roundtrip": sql("landuse corners", VERTICES.format(id="landuse_id", t="landuse")),
    "simplified_layer": sql(
        "fires",
        "SELECT fire_id, 9 AS before, 5 AS after, round(" + hectares("x0", "x1", "y0", "y1")
        + ", 2) AS AREAHA FROM fires",
    ),
    "fire_season_map": sql(
        "fires",
        "SELECT fire_id, 'Fire name: ' || coalesce(FireName, 'None') AS name, x0 AS xmin, y1 AS ymax FROM fires"
        " WHERE Label = '1997-98 1-URGENT'",
    ),
    "layer_center": sql(
        "fires",
        "SELECT round(sum((x1 - x0) * (y1 - y0) * (x0 + x1) / 2) / sum((x1 - x0) * (y1 - y0)), 6) AS lon0,"
        " round(sum((x1 - x0) * (y1 - y0) * (y0 + y1) / 2) / sum((x1 - x0) * (y1 - y0)), 6) AS lat0 FROM fires",
    ),
    "fires_by_union": sql(
        "fires",
        "SELECT FireType, count(*) AS n FROM fires WHERE FireType IS NOT NULL GROUP BY 1",
    ),
    "sink_table": sql("managed_land", PLAIN_LAND),
    "sink_external": sql("managed_land", PLAIN_LAND),
    "sink_parquet": sql("towers_prepared", f"SELECT {TOWER_OUT} FROM towers_prepared"),
    "sink_csv": sql("managed_land", PLAIN_LAND),
    "sink_geojson": sql("managed_land", PLAIN_LAND),
    "collection_layer": sql("managed_land", PLAIN_LAND),
}
