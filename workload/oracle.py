"""The same questions in plain SQL over the given tables, written apart from the
DataFrame code: literal anti-joins, UNION ALL and null-safe joins."""

EV = ("2024-01-20 00:00:00", "2024-01-22 00:00:00")
ST = ("2000-06-30 23:59:59.999999", "2000-07-03 00:00:00")
EARLY = ("1998-06-30 23:59:59.999999", "1998-07-31 00:00:00")

_EVENTS = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id AS seq, 'user:' || user_id AS subject,
         event_type AS slot,
         CASE WHEN event_type = 'error' AND value < 20 THEN NULL
              ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS value,
         ts AS valid_from,
         ts + to_hours(CAST(regexp_extract(props, '[0-9]+') AS INTEGER)) AS recorded_at,
         CASE WHEN event_type = 'error' AND event_id > 0
              THEN CAST(event_id - 1 AS VARCHAR) END AS revokes,
         'act:' || event_id AS intent_id
  FROM events),
act AS (
  SELECT 'act:' || event_id AS id, ts AS occurred_at,
         'clerk' || regexp_extract(props, '[0-9]+') AS actor_id,
         'submit_' || event_type AS action_name,
         CASE WHEN event_type = 'error' THEN 'withdrawn' END AS note
  FROM events)"""


def _claim(src, subject, slot, value, ordinal, kind="'base'", vf="vf", ra="ra", where="TRUE",
           revokes="NULL"):
    rev = f"md5({subject} || '|{slot}|base')" if revokes == "base" else "NULL"
    return (f"SELECT md5({subject} || '|{slot}|' || {kind}) AS id, base + {ordinal} AS seq, "
            f"{subject} AS subject, '{slot}' AS slot, CAST({value} AS VARCHAR) AS value, "
            f"{vf} AS valid_from, {ra} AS recorded_at, {rev} AS revokes "
            f"FROM {src} WHERE ({where}) AND (({value}) IS NOT NULL OR {rev} IS NOT NULL)")


_T0 = "TIMESTAMP '1995-01-01 00:00:00'"
_DAY10 = "ra + INTERVAL 10 DAY"

_STOCK = f"""
mv AS (
  SELECT l.*, c_nationkey, l_shipdate AS vf, l_shipdate + to_days(l_linenumber) AS ra,
         l_orderkey * 1000 + l_linenumber * 100 AS base,
         'line:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
           || '-' || CAST(l_quantity AS INTEGER) || '-' || strftime(l_shipdate, '%Y%m%d') AS line,
         'count:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
           || '-' || CAST(l_quantity AS INTEGER) || '-' || strftime(l_shipdate, '%Y%m%d') AS cnt,
         'part:' || l_partkey AS part, 'nation:' || c_nationkey AS nation,
         'supplier:' || l_suppkey AS supp, 'container:' || l_returnflag AS held,
         CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey),
pt AS (SELECT *, 'part:' || p_partkey AS uri, p_partkey * 1000 AS base, {_T0} AS vf, {_T0} AS ra,
              CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part),
na AS (SELECT *, 'nation:' || n_nationkey AS uri, CAST(n_nationkey AS BIGINT) * 1000 AS base,
              {_T0} AS vf, {_T0} AS ra FROM nation),
su AS (SELECT *, 'supplier:' || s_suppkey AS uri, s_suppkey * 1000 AS base,
              {_T0} AS vf, {_T0} AS ra FROM supplier),
un AS (SELECT DISTINCT 'container:' || l_returnflag AS uri, 'Flag ' || l_returnflag AS name,
              CAST(ascii(l_returnflag) AS BIGINT) * 1000 AS base, {_T0} AS vf, {_T0} AS ra
       FROM lineitem),
st AS MATERIALIZED (
""" + "\nUNION ALL\n".join([
    *[_claim("mv", "line", slot, value, n, kind, ra=ra, revokes=revokes,
             where=f"(l_returnflag = 'R') = {back} AND {cond}")
      for back, name, prefix, to, by in [("FALSE", "Delivery", "delivered", ("to", "nation"), ("by", "supp")),
                                         ("TRUE", "Return", "returned", ("to", "supp"), ("from", "nation"))]
      for slot, value, n, kind, ra, revokes, cond in [
          ("kind_of_thing", f"'{name}'", 1, "'base'", "ra", "NULL", "TRUE"),
          (f"{prefix}_part", "part", 2, "'base'", "ra", "NULL", "TRUE"),
          (f"{prefix}_{to[0]}", to[1], 3, "'base'", "ra", "NULL", "l_quantity <> 13"),
          (f"{prefix}_{by[0]}", by[1], 4, "'base'", "ra", "NULL", "TRUE"),
          (f"{prefix}_pieces", "qty", 5, "'base'", "ra", "NULL", "TRUE"),
          (f"{prefix}_in", "held", 6, "'base'", "ra", "NULL", "TRUE"),
          (f"{prefix}_pieces", "qty + 1", 21, "'fix'", _DAY10, "base", "l_tax = 0.08"),
          (f"{prefix}_pieces", "NULL", 22, "'drop'", _DAY10, "base",
           "l_tax = 0 AND l_discount = 0")]],
    _claim("mv", "cnt", "kind_of_thing", "'Inventory'", 11, where="l_linestatus = 'F'"),
    _claim("mv", "cnt", "counted_part", "part", 12, where="l_linestatus = 'F'"),
    _claim("mv", "cnt", "counted_at", "nation", 13, where="l_linestatus = 'F'"),
    _claim("mv", "cnt", "counted_pieces", "qty", 14, where="l_linestatus = 'F'"),
    _claim("mv", "cnt", "counted_in", "held", 15, where="l_linestatus = 'F'"),
    _claim("pt", "uri", "kind_of_thing",
           "CASE WHEN p_size > 10 THEN 'Part' ELSE 'PromoPart' END", 1),
    _claim("pt", "uri", "part_name", "p_name", 2),
    _claim("pt", "uri", "part_brand", "'brand:' || p_brand", 3),
    _claim("pt", "uri", "part_container",
           "CASE WHEN p_type IN ('SMALL','MEDIUM') THEN 'container:A' ELSE 'container:R' END", 4),
    _claim("pt", "uri", "list_price", "price", 5),
    _claim("pt", "uri", "floor_stock", "CASE WHEN p_size >= 20 THEN p_size * 10 END", 6),
    _claim("pt", "uri", "list_price", "price + 5", 7, "'change'",
           vf="TIMESTAMP '1999-06-08 00:00:00'", ra="TIMESTAMP '1999-06-08 00:00:00'",
           where="p_type = 'ECONOMY'"),
    _claim("pt", "uri", "kind_of_thing", "'PromoPart'", 8, "'change'",
           vf="TIMESTAMP '1997-01-01 00:00:00'", ra="TIMESTAMP '1997-01-01 00:00:00'",
           where="p_type = 'PROMO'"),
    *[_claim("pt", f"('packing:' || p_partkey || '-{flag}')", slot, value, n + 10 * i)
      for i, flag in enumerate("AR")
      for n, slot, value in [(11, "kind_of_thing", "'Packing'"),
                             (12, "packed_part", "uri"),
                             (13, "packed_in", f"'container:{flag}'"),
                             (14, "pieces_each", "1 + p_size % 5")]],
    _claim("na", "uri", "kind_of_thing",
           "CASE WHEN n_regionkey < 3 THEN 'HomeNation' ELSE 'Place' END", 1),
    _claim("na", "uri", "place_name", "n_name", 2),
    _claim("su", "uri", "kind_of_thing", "'Supplier'", 1),
    _claim("su", "uri", "place_name", "s_name", 2),
    _claim("un", "uri", "kind_of_thing", "'Container'", 1),
    _claim("un", "uri", "container_label", "name", 2),
]) + ")"

_REFS = ("'part_brand','part_container','packed_part','packed_in','delivered_part','delivered_to',"
         "'delivered_by','delivered_in','returned_part','returned_from','returned_to',"
         "'returned_in','counted_part','counted_at','counted_in'")

_REGISTERED = f"""
uris AS MATERIALIZED (SELECT subject AS uri FROM st UNION SELECT value FROM st WHERE slot IN ({_REFS})
         UNION SELECT slot FROM st UNION SELECT 'sys:uri'),
asr AS MATERIALIZED (
  SELECT id, seq + 1000 AS seq, md5(subject) AS subject_id, md5(slot) AS predicate_id,
         CASE WHEN slot NOT IN ({_REFS}) THEN value END AS value_literal,
         CASE WHEN slot IN ({_REFS}) THEN md5(value) END AS value_ref,
         valid_from, recorded_at, revokes FROM st
  UNION ALL
  SELECT md5(uri || '|registered'), 1, md5(uri), md5('sys:uri'), uri, NULL, {_T0}, {_T0}, NULL
  FROM uris
  UNION ALL
  SELECT md5(uri || '|again'), 2, md5(uri), md5('sys:uri'), 'again-' || uri, NULL, {_T0}, {_T0},
         NULL FROM uris WHERE uri LIKE 'supplier:%')"""


def _standing(name, src, clocks, where="TRUE", keys="subject, slot", value="value IS NOT NULL"):
    """The winner of each pair at the clocks, as a CTE."""
    va, ao = (f"TIMESTAMP '{c}'" for c in clocks)
    return f"""
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (
    SELECT a.*, row_number() OVER (PARTITION BY {keys}
             ORDER BY valid_from DESC, recorded_at DESC, seq DESC) AS rn
    FROM {src} a
    WHERE ({where}) AND {value} AND valid_from <= {va} AND recorded_at <= {ao}
      AND NOT EXISTS (SELECT 1 FROM {src} r WHERE r.revokes = a.id AND r.recorded_at <= {ao}))
  WHERE rn = 1)"""


def _with(*ctes):
    return "WITH " + ",".join(ctes) + "\n"


_COLS = "id, seq, subject, slot, value, valid_from, recorded_at, revokes"
_SP = f"""
big_purchase AS (SELECT DISTINCT 'user:' || user_id AS subject FROM events
                 WHERE event_type = 'purchase' AND value > 200),
big_signup AS (SELECT DISTINCT 'user:' || user_id AS subject FROM events
               WHERE event_type = 'signup' AND value > 200)"""

_GRID = [("2024-01-10 00:00:00", "2024-01-12 00:00:00"), EV,
         (EV[0], "2024-02-03 00:00:00"), ("2024-02-01 00:00:00", "2024-02-05 00:00:00")]

_WIDE_SLOTS = {
    "dlw": ["delivered_part", "delivered_to", "delivered_pieces", "delivered_in"],
    "rtw": ["returned_part", "returned_from", "returned_to", "returned_pieces", "returned_in"],
    "cnw": ["counted_part", "counted_at", "counted_pieces",
            "counted_in"],
    "cvw": ["packed_part", "packed_in", "pieces_each"],
    "ing": ["part_name", "part_brand", "part_container", "list_price",
            "floor_stock"],
    "loc": ["place_name"], "unt": ["container_label"],
}
_CLASSES = {"dlw": "'Delivery'", "rtw": "'Return'", "cnw": "'Inventory'", "cvw": "'Packing'",
            "ing": "'Part','PromoPart'",
            "loc": "'Place','HomeNation','Supplier'", "unt": "'Container'"}


def _wide(name, sd="sd"):
    """One LEFT JOIN per slot on the subjects of a class."""
    slots = _WIDE_SLOTS[name]
    selects = ", ".join(f"{s}.value AS {s}" for s in slots)
    joins = " ".join(f"LEFT JOIN {sd} {s} ON {s}.subject = r.subject AND {s}.slot = '{s}'"
                     for s in slots)
    return f"""
{name} AS (SELECT r.subject, r.value AS kind_of_thing, {selects} FROM {sd} r {joins}
  WHERE r.slot = 'kind_of_thing' AND r.value IN ({_CLASSES[name]}))"""


def _total(name, src, ing, place, qty, unit, scoped=True, third=None, converted=True):
    scope = f"""
  JOIN sd wp ON wp.subject = r.{place} AND wp.slot = 'kind_of_thing'
       AND wp.value = 'HomeNation'
  JOIN sd wi ON wi.subject = r.{ing} AND wi.slot = 'kind_of_thing'
       AND wi.value IN ('Part','PromoPart')""" if scoped else ""
    conv = f"""
  LEFT JOIN cvw cv ON cv.packed_part = r.{ing} AND cv.packed_in = r.{unit}
       AND cv.pieces_each IS NOT NULL""" if converted else ""
    factor = "coalesce(CAST(cv.pieces_each AS DECIMAL(12,6)), 1)" if converted else "1"
    extra = f", r.{third} AS container" if third else ""
    return f"""
{name} AS (SELECT r.{ing} AS part, r.{place} AS place{extra},
    sum(CAST(r.{qty} AS DECIMAL(18,6)) * {factor}) AS q, count(r.{qty}) AS n
  FROM {src} r {scope} {conv} GROUP BY ALL)"""


_DELIVERED = ("dlw", "delivered_part", "delivered_to", "delivered_pieces", "delivered_in")
_SENT_BACK = ("rtw", "returned_part", "returned_from", "returned_pieces", "returned_in")
_TAKEN_BACK = ("rtw", "returned_part", "returned_to", "returned_pieces", "returned_in")
_COUNTED = ("cnw", "counted_part", "counted_at", "counted_pieces", "counted_in")


def _recon_ctes(clocks):
    """Each total with the others' columns at 0, all under one another, then added up."""
    return [_EVENTS, _STOCK, _standing("sd", "st", clocks), _wide("dlw"), _wide("rtw"),
            _wide("cnw"), _wide("cvw"), _total("tin", *_DELIVERED), _total("tout", *_SENT_BACK),
            _total("tcnt", *_COUNTED), """
stacked AS (SELECT part, place, coalesce(q, 0) AS delivered, 0 AS sent_back, 0 AS counted FROM tin
            UNION ALL SELECT part, place, 0, coalesce(q, 0), 0 FROM tout
            UNION ALL SELECT part, place, 0, 0, coalesce(q, 0) FROM tcnt),
added AS (SELECT part, place, sum(delivered) AS delivered, sum(sent_back) AS sent_back,
                 sum(counted) AS counted FROM stacked GROUP BY part, place),
facts AS (SELECT subject, max(value) FILTER (slot = 'part_brand') AS brand,
                 CAST(max(value) FILTER (slot = 'list_price') AS DOUBLE) AS list_price,
                 CAST(max(value) FILTER (slot = 'floor_stock') AS DOUBLE) AS floor_stock
          FROM sd GROUP BY subject),
rec AS (
  SELECT part, place, brand, list_price, floor_stock, CAST(delivered AS DOUBLE) AS delivered,
         CAST(sent_back AS DOUBLE) AS sent_back, CAST(counted AS DOUBLE) AS counted,
         CAST(delivered - sent_back AS DOUBLE) AS remaining,
         CAST(counted AS DOUBLE) * list_price AS counted_value,
         CAST(counted - delivered + sent_back AS DOUBLE) AS gap,
         CAST(counted - delivered + sent_back AS DOUBLE) * list_price AS gap_value
  FROM added LEFT JOIN facts ON subject = part)"""]


def _round(*columns, digits=2):
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in columns)


_REC_SELECT = "SELECT part, place, brand, " + _round(
    "list_price", "floor_stock", "delivered", "sent_back", "remaining", "counted",
    "counted_value", "gap", "gap_value") + " FROM rec"

_META = """
meta AS (SELECT i.subject AS entity_uri, i.part_name, i.part_container,
    CAST(i.floor_stock AS DOUBLE) AS floor_stock,
    CAST(i.list_price AS DOUBLE) AS list_price,
    CAST(coalesce(CAST(c.pieces_each AS DOUBLE), 1) AS DOUBLE) AS factor, u.container_label
  FROM ing i LEFT JOIN unt u ON u.subject = i.part_container
  LEFT JOIN cvw c ON c.packed_part = i.subject
       AND c.packed_in = i.part_container)"""

_ITEMS = """
items AS (
  SELECT r.part, r.place, coalesce(m.part_name, r.part) AS name,
         coalesce(l.place_name, r.place) AS location,
         coalesce(m.container_label, 'pieces')
           AS pack_unit,
         coalesce(m.factor, 1.0) AS pack_factor,
         m.floor_stock * coalesce(m.factor, 1.0) AS reorder_base,
         coalesce(r.list_price, 0) AS list_price, r.remaining, r.counted, r.gap,
         round(r.counted / coalesce(m.factor, 1.0), 1) AS counted_packs,
         coalesce(r.counted_value, 0) AS counted_value,
         coalesce(r.gap_value, 0) AS gap_value,
         coalesce(r.gap_value, 0) <= -50 AS is_anomaly,
         coalesce(r.counted < m.floor_stock * coalesce(m.factor, 1.0)
                  AND r.remaining > 0, FALSE) AS is_reorder
  FROM rec r LEFT JOIN meta m ON m.entity_uri = r.part
  LEFT JOIN loc l ON l.subject = r.place AND l.kind_of_thing = 'HomeNation')"""


def _items(select):
    return _with(*_recon_ctes(ST), _wide("ing"), _wide("loc"), _wide("unt"), _META,
                 _ITEMS) + select


def _entities(name, columns):
    return _with(_STOCK, _standing("sd", "st", ST), _wide(name)) + \
        f"SELECT subject AS entity_uri, {columns} FROM {name}"


_LEDGER = ("e.id, e.subject, e.slot, e.value, e.valid_from, e.recorded_at, e.revokes, "
           "rb.id AS revoked_by, a.actor_id, a.action_name, a.note")


def _recent(where, k, offset=0):
    return _with(_EVENTS) + f"""
SELECT e.seq, {_LEDGER} FROM ev e JOIN act a ON a.id = e.intent_id
LEFT JOIN ev rb ON rb.revokes = e.id
WHERE {where} ORDER BY e.seq DESC LIMIT {k} OFFSET {offset}"""


_STATED = [_STOCK, _REGISTERED, _standing("sa", "asr", ST, keys="subject_id, predicate_id",
                                      value="(value_literal IS NULL) <> (value_ref IS NULL)"),
           """
reg AS (SELECT subject_id AS entity_id, arg_min(value_literal, seq) AS uri FROM asr
        WHERE predicate_id = md5('sys:uri') GROUP BY 1),
spelt AS (
  SELECT subject_id, (SELECT uri FROM reg WHERE entity_id = sa.subject_id) AS subject,
         (SELECT uri FROM reg WHERE entity_id = sa.predicate_id) AS slot,
         CASE WHEN value_ref IS NULL THEN value_literal
              ELSE (SELECT uri FROM reg WHERE entity_id = sa.value_ref) END AS value
  FROM sa),
named_facts AS (SELECT * FROM spelt WHERE slot IS NOT NULL)"""]

_LIVE = """
gone AS (SELECT DISTINCT revokes AS id FROM st WHERE revokes IS NOT NULL),
live AS (SELECT * FROM st WHERE id NOT IN (SELECT id FROM gone) AND value IS NOT NULL)"""


def _live_pivot(name, slots):
    cells = ", ".join(f"max(CASE WHEN slot = '{s}' THEN value END) AS {s}" for s in slots)
    names = ", ".join(f"'{s}'" for s in slots)
    return f"""
{name} AS (SELECT subject, {cells} FROM live WHERE slot IN ({names}) GROUP BY 1)"""


_BALANCE = _with(_STOCK, _LIVE,
                 _live_pivot("dl", ["delivered_part", "delivered_to", "delivered_in",
                                    "delivered_pieces"]),
                 _live_pivot("rt", ["returned_part", "returned_from", "returned_in",
                                    "returned_pieces"]),
                 _live_pivot("pk", ["packed_part", "packed_in", "pieces_each"]), """
lines AS (
  SELECT delivered_part AS part, delivered_to AS place, delivered_in AS held,
         CAST(delivered_pieces AS DECIMAL(18,2)) AS n FROM dl
  UNION ALL
  SELECT returned_part, returned_from, returned_in, -CAST(returned_pieces AS DECIMAL(18,2)) FROM rt)
""") + """
SELECT part, place,
       round(CAST(sum(n * coalesce(CAST(pieces_each AS DECIMAL(12,2)), 1)) AS DOUBLE), 2) AS remaining
FROM lines LEFT JOIN pk ON (packed_part, packed_in) = (part, held)
WHERE place IN (SELECT subject FROM live WHERE slot = 'kind_of_thing' AND value = 'HomeNation')
GROUP BY part, place HAVING sum(n * coalesce(CAST(pieces_each AS DECIMAL(12,2)), 1)) > 0"""

_SPACE = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
          r"\x{205f}\x{3000}")


def _words(text):
    """Camel case is parted first, then runs of letters are taken."""
    return (f"list_transform(list_filter(regexp_extract_all(regexp_replace({text}, "
            f"'([A-Z][a-z])', ' \\1', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+'), "
            f"lambda w: length(w) > 3), lambda w: lower(w))")


_TRIPLES = """
tp AS (
  SELECT CASE WHEN p_size < 5 THEN '_:c' || p_partkey ELSE 'cls:' || p_type || '-' || p_size END AS klass,
         '_:r' || p_partkey AS node,
         'prop:' || p_brand || '-' || split_part(p_name, ' ', 1) AS prop,
         'cls:' || split_part(p_name, ' ', 2) AS target, p_type, p_size FROM part),
props AS (SELECT prop AS property, TRUE AS is_object FROM tp
          UNION SELECT 'prop:' || c_mktsegment, FALSE FROM customer),
dom AS (SELECT prop AS property, list_sort(list_distinct(list(klass))) AS m FROM tp
        WHERE klass NOT LIKE '\\_:%' ESCAPE '\\' GROUP BY 1),
rng AS (SELECT prop AS property, list_sort(list_distinct(list(target))) AS m FROM tp
        WHERE p_type <> 'SMALL' GROUP BY 1),
said AS (SELECT DISTINCT prop AS property FROM tp WHERE p_type = 'PROMO' AND p_size > 40),
inf AS (
  SELECT property, 'domain' AS side,
         CASE WHEN m IS NULL THEN 'none' WHEN len(m) = 1 THEN 'single' ELSE 'union' END AS outcome,
         array_to_string(m, '|') AS members
  FROM props LEFT JOIN dom USING (property)
  UNION ALL
  SELECT p.property, 'range',
         CASE WHEN s.property IS NOT NULL THEN 'kept' WHEN m IS NULL THEN 'none' ELSE 'added' END,
         CASE WHEN s.property IS NULL THEN array_to_string(m, '|') END
  FROM props p LEFT JOIN said s USING (property) LEFT JOIN rng r USING (property))"""

_PHRASES = ["all rights reserved", "licen[cs]e", "copyright", "api[_ ]key", "password"]

_TILL = """
w AS (SELECT l_orderkey AS key, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS worked
      FROM lineitem GROUP BY 1),
till AS (SELECT o_orderkey AS key, CAST(o_totalprice AS DECIMAL(14,2)) AS total, worked
         FROM orders JOIN w ON key = o_orderkey
         WHERE abs(worked - CAST(o_totalprice AS DECIMAL(14,2))) > 0.005
           AND o_orderstatus <> 'P')"""
_LINES = """
lines AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS body,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
ph AS (""" + " UNION ALL ".join(
    f"SELECT key, CAST(line AS BIGINT) AS line, '{p}' AS phrase FROM lines "
    f"WHERE regexp_matches(body, '(?i){p}')" for p in _PHRASES) + ")"
_ORPHANS = """
orph AS (SELECT doc_id AS key, source FROM documents
         WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels))"""
_WEEK = """
wk AS (SELECT id, CAST(valid_from AS DATE) AS day, strftime(recorded_at, '%A') AS written
       FROM ev WHERE dayofweek(valid_from) <> dayofweek(recorded_at))"""
_DUP = """
dup AS (SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
        GROUP BY 1, 2 HAVING count(*) > 1)"""


def _check(name, counted, failed):
    return (f"SELECT '{name}' AS \"check\", (SELECT count(*) FROM {counted}) AS counted, "
            f"(SELECT count(*) FROM {failed}) AS failed, "
            f"(SELECT count(*) FROM {failed}) = 0 AS ok")


def _version_case():
    rows = [("v6", "2000-01-01", "2000-01-01"), ("v5", "1998-01-01", "1998-06-01"),
            ("v4", "1999-01-01", "1998-06-01"), ("v3", "1995-06-01", "1997-03-01"),
            ("v2", "1996-01-01", "1996-02-01"), ("v1", "1995-01-01", "1995-01-01")]
    # Written newest seal first; of two sealed together the later in file order wins.
    values = ", ".join(f"('{v}', TIMESTAMP '{f} 00:00:00', TIMESTAMP '{s} 09:00:00', {n})"
                       for n, (v, f, s) in enumerate(rows))
    return f"""
WITH ver(version, vf, sealed, place) AS (VALUES {values}),
o AS (SELECT o_orderkey, o_orderdate AS valid_at, o_orderdate + INTERVAL 90 DAY AS as_of
      FROM orders)
SELECT o.*, (SELECT arg_min(version, place) FROM ver
             WHERE sealed <= o.as_of AND vf <= o.valid_at) AS version FROM o"""


def build():
    out = {}
    out["standing"] = _with(_EVENTS, _standing("s", "ev", EV)) + f"SELECT {_COLS} FROM s"
    out["standing_stream"] = out["standing"]
    out["standing_stock"] = _with(_STOCK, _standing("s", "st", ST)) + """
SELECT slot, count(*) AS pairs, count(DISTINCT value) AS different_values,
       max(valid_from) AS latest_valid_from, CAST(sum(seq) AS BIGINT) AS seq_total
FROM s GROUP BY slot"""
    out["standing_subset"] = _with(_EVENTS, _SP, _standing("s", "ev", EV)) + \
        f"SELECT {_COLS} FROM s WHERE subject IN (SELECT subject FROM big_purchase)"
    out["resolve_point"] = _with(_EVENTS, _standing("s", "ev", EV)) + \
        f"SELECT {_COLS} FROM s WHERE subject = 'user:7' AND slot = 'purchase'"
    out["clock_grid"] = _with(_EVENTS, *[_standing(f"s{i}", "ev", c)
                                         for i, c in enumerate(_GRID)]) + " UNION ALL ".join(
        f"SELECT TIMESTAMP '{va}' AS valid_at, TIMESTAMP '{ao}' AS as_of, {_COLS} FROM s{i}"
        for i, (va, ao) in enumerate(_GRID))
    out["replay_labels"] = _with(*_STATED) + """,
lab AS MATERIALIZED (SELECT subject_id, value_literal AS label FROM sa WHERE predicate_id = md5('sys:uri'))
SELECT coalesce(a.label, '<' || s.subject_id || '>') AS subject,
       coalesce(b.label, '<' || s.predicate_id || '>') AS predicate,
       CASE WHEN s.value_ref IS NOT NULL
            THEN '-> ' || coalesce(c.label, '<' || s.value_ref || '>')
            ELSE s.value_literal END AS value,
       strftime(s.valid_from, '%Y-%m-%d') AS valid_from,
       strftime(s.recorded_at, '%Y-%m-%d') AS recorded_at, s.seq
FROM sa s LEFT JOIN lab a ON a.subject_id = s.subject_id
LEFT JOIN lab b ON b.subject_id = s.predicate_id LEFT JOIN lab c ON c.subject_id = s.value_ref"""
    out["registry"] = _with(*_STATED) + "SELECT entity_id, uri FROM reg"
    out["stated"] = _with(*_STATED) + "SELECT subject_id, subject, slot, value FROM named_facts"
    out["stated_slots"] = out["stated"] + \
        " WHERE slot IN ('list_price', 'packed_part')"
    out["latest_class"] = _with(_STOCK) + """
SELECT subject, arg_max(value, seq) AS class FROM st
WHERE slot = 'kind_of_thing' AND revokes IS NULL GROUP BY 1"""
    out["version_asof"] = _version_case()
    out["revocation_index"] = "WITH " + _EVENTS + "," + _STOCK + "".join(f""",
{src}_gone AS (SELECT revokes AS id, min(recorded_at) AS revoked_at FROM {src}
               WHERE revokes IS NOT NULL GROUP BY revokes)""" for src in ("ev", "st")) + " UNION ALL ".join(
        f"""
SELECT '{name}' AS log, subject, slot, g.id, revoked_at
FROM {src}_gone g LEFT JOIN {src} c ON c.id = g.id""" for name, src in (("events", "ev"), ("stock", "st")))
    text = "concat_ws('|', " + ", ".join(
        f"coalesce('=' || {c}, '')" for c in (
            "id", "strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f')", "revokes", "seq", "slot",
            "subject", "strftime(valid_from, '%Y-%m-%d %H:%M:%S.%f')", "value")) + ")"
    out["append_ledger"] = _with(_STOCK) + "SELECT slot, count(*) AS rows, " + ", ".join(
        f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT)) AS VARCHAR) AS part{k}"
        for k in range(4)) + f" FROM (SELECT slot, sha256({text}) AS h FROM st) GROUP BY slot"
    out["version_of_lines"] = """
WITH ver AS MATERIALIZED (SELECT 'list:' || c_custkey AS version, c_custkey,
       TIMESTAMP '1992-01-01 00:00:00' + to_days(CAST(c_custkey * 7919 % 2400 AS INT)) AS vf,
       TIMESTAMP '1992-01-01 00:00:00' + to_days(CAST(c_custkey * 104729 % 2500 AS INT)) AS sealed
       FROM customer),
line AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS valid_at,
       o_orderdate AS as_of FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
clock AS MATERIALIZED (SELECT DISTINCT valid_at, as_of FROM line),
chosen AS (SELECT valid_at, as_of, arg_max(version, (sealed, c_custkey)) AS version
       FROM clock JOIN ver ON sealed <= as_of AND vf <= valid_at GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, valid_at, as_of, version
FROM line LEFT JOIN chosen USING (valid_at, as_of)"""
    out["version_or_newest"] = (f"SELECT * REPLACE (coalesce(version, 'v6') AS version) "
                                f"FROM ({_version_case()})")
    out["ever_typed"] = _with(_STOCK, _standing("s", "st", ST)) + \
        "SELECT subject FROM s WHERE slot = 'kind_of_thing' AND value = 'PromoPart'"
    out["class_members"] = _with(_STOCK, _standing("s", "st", ST)) + """
SELECT subject FROM s WHERE slot = 'kind_of_thing' AND value IN ('Part', 'PromoPart')"""

    # ---- ingest
    order_cells = [("'order_customer'", "NULL", "'customer:' || o_custkey", "TRUE"),
                   ("'order_status'", "o_orderstatus", "NULL", "o_orderstatus <> ''"),
                   ("'order_priority'", "o_orderpriority", "NULL",
                    "o_orderpriority <> '4-NOT SPECIFIED' AND o_orderpriority <> ''"),
                   ("'order_total'",
                    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", "NULL",
                    "o_totalprice IS NOT NULL"),
                   ("'kind_of_thing'", "'Order'", "NULL", "TRUE")]
    out["melt_claims"] = " UNION ALL ".join(
        f"SELECT 'order:' || o_orderkey AS subject, o_orderdate AS valid_from, {slot} AS slot, "
        f"CAST({lit} AS VARCHAR) AS value_literal, CAST({ref} AS VARCHAR) AS value_ref "
        f"FROM orders WHERE {cond}" for slot, lit, ref, cond in order_cells)
    out["corrections"] = _with(_STOCK, _standing("s", "st", ST)) + """,
f AS (SELECT 'part:' || p_partkey AS subject, 'list_price' AS slot,
             CASE WHEN p_type = 'SMALL' THEN
               CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 1 AS VARCHAR) END AS value
      FROM part WHERE p_type IN ('SMALL', 'LARGE'))
SELECT f.subject, f.slot, f.value, s.id AS revokes,
       md5(s.id || '|' || coalesce(f.value, '') || '|correction') AS id
FROM f JOIN s ON s.subject = f.subject AND s.slot = f.slot"""
    out["correction_rejects"] = """
SELECT 'supplier:' || s_suppkey AS subject, 'list_price' AS slot, '1' AS value FROM supplier"""
    fixes = """
WITH f AS (SELECT CAST(event_id AS VARCHAR) AS claim_id, value AS v, ts FROM events
           WHERE event_type = 'error'
           UNION ALL SELECT 'none-' || user_id, 1, NULL FROM events GROUP BY user_id)"""
    out["correct_by_id"] = fixes + """
SELECT md5(claim_id || '|' || CASE WHEN v >= 50 THEN '0.00' ELSE '' END || '|correction') AS id,
       'user:' || user_id AS subject, event_type AS slot, CASE WHEN v >= 50 THEN '0.00' END AS value,
       CASE WHEN v >= 80 THEN f.ts - INTERVAL 1 DAY ELSE e.ts END AS valid_from,
       TIMESTAMP '2024-03-01 12:00:00' AS recorded_at, claim_id AS revokes, 'typing error' AS reason
FROM f JOIN events e ON CAST(event_id AS VARCHAR) = claim_id"""
    out["correct_by_id_rejects"] = fixes + "SELECT claim_id FROM f WHERE claim_id LIKE 'none-%'"
    out["correction_act"] = """
WITH f AS (SELECT md5('supplier:' || s_suppkey || '|registered') AS claim_id, s_suppkey, s_acctbal
           FROM supplier WHERE s_suppkey % 3 = 0)
SELECT md5('act:names|' || claim_id) AS id, 500 + row_number() OVER (ORDER BY claim_id) AS seq,
       md5('supplier:' || s_suppkey) AS subject_id, md5('sys:uri') AS predicate_id,
       CASE WHEN s_acctbal >= 0 THEN 'new-' || s_suppkey END AS value_literal,
       CAST(NULL AS VARCHAR) AS value_ref, TIMESTAMP '1995-01-01 00:00:00' AS valid_from,
       TIMESTAMP '2000-01-02 09:00:00' AS recorded_at, claim_id AS revokes,
       'act:names' AS intent_id, 'imported' AS source, CAST(NULL AS VARCHAR) AS confidence,
       CAST(NULL AS VARCHAR) AS authority, 'v1' AS ontology_version,
       CAST(NULL AS VARCHAR) AS subject_key_id
FROM f"""
    out["append_act"] = """
SELECT 'intent' AS kind, 'act:suppliers' AS id, TIMESTAMP '1995-01-01 09:00:00' AS occurred_at
UNION ALL SELECT 'entity', md5('supplier:' || s_suppkey), TIMESTAMP '1995-01-01 09:00:00'
FROM supplier WHERE s_acctbal > 0
UNION ALL SELECT 'assertion', md5('act:suppliers|' || s_suppkey), TIMESTAMP '1995-01-01 09:00:00'
FROM supplier"""
    out["register_uris"] = """
WITH said AS (SELECT 'supplier:' || l_suppkey AS uri FROM lineitem
              UNION SELECT 'customer:' || o_custkey FROM orders)
SELECT md5(uri) AS entity_id, uri FROM said
WHERE uri NOT IN (SELECT 'customer:' || c_custkey FROM customer)"""
    out["constraint_gate"] = _with(_EVENTS) + """,
raw AS (SELECT ev.*, e.value AS amount, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
        FROM ev JOIN events e ON e.event_id = ev.seq),
chk AS (SELECT id, CASE
    WHEN k = 50 THEN 'not_null'
    WHEN NOT ((CAST(value IS NOT NULL AS INTEGER)
               + CAST(slot = 'view' AND amount > 100 AS INTEGER) = 1)
              OR (value IS NULL AND NOT (slot = 'view' AND amount > 100)
                  AND revokes IS NOT NULL)) THEN 'value_exactly_one'
    WHEN k < 10 THEN 'confidence_levels'
    WHEN k = 99 THEN 'source_known' END AS error FROM raw)
SELECT id, error FROM chk WHERE error IS NOT NULL"""
    out["fk_gate"] = _with(_STOCK, _REGISTERED) + """,
fa AS (SELECT * FROM asr WHERE predicate_id <> md5('sys:uri')),
ent AS (SELECT subject_id AS id FROM fa UNION SELECT predicate_id FROM fa)
SELECT 'value_ref' AS reference, id AS claim, value_ref AS missing FROM fa
WHERE value_ref IS NOT NULL AND value_ref NOT IN (SELECT id FROM ent)
UNION ALL
SELECT 'intent_id', id, md5('intent|' || subject_id) FROM fa
WHERE subject_id IN (SELECT md5(subject) FROM st WHERE subject LIKE 'supplier:%')"""
    out["fact_validation"] = _with(_STOCK, _REGISTERED) + f"""
SELECT slot AS predicate, CASE WHEN slot <> 'container_label' THEN slot IN ({_REFS}) END AS is_ref,
       CASE WHEN slot = 'list_price' AND TRY_CAST(value AS DOUBLE) > 950 THEN 'bad_confidence'
            WHEN slot = 'container_label' THEN 'unknown_predicate'
            WHEN value IS NULL THEN 'no_value' END AS error, count(*) AS facts
FROM st GROUP BY ALL"""
    out["append_only_proof"] = _with(_EVENTS) + f"""
SELECT 'append_only' AS "check", count(*) AS counted,
       CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM ev c WHERE c.id = p.id) THEN 0 ELSE 1 END)
            AS BIGINT) AS failed
FROM ev p WHERE recorded_at <= TIMESTAMP '{EV[1]}'"""
    out["assign_seq"] = """
SELECT event_id AS batch_order, user_id, 1000 + row_number() OVER (ORDER BY event_id) AS seq
FROM events"""
    out["append_batch"] = """
WITH b AS (SELECT *, 500 + row_number() OVER (ORDER BY s_suppkey) AS seq FROM supplier)
SELECT md5('act:suppliers|' || s_suppkey) AS id, seq, md5('supplier:' || s_suppkey) AS subject_id,
       md5('place_name') AS predicate_id, s_name AS value_literal,
       CAST(NULL AS VARCHAR) AS value_ref, TIMESTAMP '1995-01-01 09:00:00' AS valid_from,
       TIMESTAMP '1995-01-02 09:00:00' AS recorded_at, CAST(NULL AS VARCHAR) AS revokes,
       'act:suppliers' AS intent_id, 'imported' AS source, CAST(NULL AS VARCHAR) AS confidence,
       CAST(NULL AS VARCHAR) AS authority, 'v1' AS ontology_version,
       CAST(NULL AS VARCHAR) AS subject_key_id FROM b"""

    # ---- derived tables
    price = _round("list_price", "floor_stock")
    out["entities_part"] = _entities(
        "ing", f"kind_of_thing, part_name, part_brand, part_container, {price}")
    out["entities_location"] = _entities("loc", "kind_of_thing, place_name")
    out["entities_from_stated"] = out["entities_location"]
    out["on_hand"] = _with(
        _EVENTS, _STOCK, _standing("sd", "st", ST), _wide("dlw"), _wide("rtw"), _wide("cvw"),
        *[_total(n, *t, scoped=False) for n, t in
          (("tin", _DELIVERED), ("tout", _SENT_BACK), ("tback", _TAKEN_BACK))]) + """,
stacked AS (SELECT part, place, coalesce(q, 0) AS delivered, 0 AS sent_back, 0 AS taken_back FROM tin
            UNION ALL SELECT part, place, 0, coalesce(q, 0), 0 FROM tout
            UNION ALL SELECT part, place, 0, 0, coalesce(q, 0) FROM tback),
oh AS (SELECT part, place, sum(delivered) AS delivered, sum(sent_back) AS sent_back,
              sum(taken_back) AS taken_back,
              sum(delivered) + sum(taken_back) - sum(sent_back) AS net
       FROM stacked GROUP BY part, place),
facts AS (SELECT subject, max(value) FILTER (slot = 'part_brand') AS brand,
                 CAST(max(value) FILTER (slot = 'list_price') AS DOUBLE) AS list_price,
                 CAST(max(value) FILTER (slot = 'floor_stock') AS DOUBLE) AS floor_stock
          FROM sd GROUP BY subject)
SELECT part, place, brand, """ + _round("delivered", "sent_back", "taken_back", "net",
                                        "floor_stock", "list_price") + """,
       round(CAST(net AS DOUBLE) * list_price, 2) AS net_value
FROM oh LEFT JOIN facts ON subject = part"""
    out["on_hand_by_unit"] = _with(
        _EVENTS, _STOCK, _standing("sd", "st", ST), _wide("dlw"), _wide("rtw"),
        _total("tin", *_DELIVERED, scoped=False, third="delivered_in", converted=False),
        _total("tout", *_SENT_BACK, scoped=False, third="returned_in", converted=False)) + """
SELECT part, place, container, round(CAST(sum(i) AS DOUBLE), 2) AS delivered,
       round(CAST(sum(o) AS DOUBLE), 2) AS sent_back, CAST(sum(n) AS BIGINT) AS lines,
       round(CAST(sum(i) - sum(o) AS DOUBLE), 2) AS net
FROM (SELECT part, place, container, coalesce(q, 0) AS i, 0 AS o, n FROM tin
      UNION ALL SELECT part, place, container, 0, coalesce(q, 0), 0 FROM tout)
GROUP BY part, place, container"""
    counted = _with(*_recon_ctes(ST), _wide("loc"), _wide("unt")) + """,
about AS (SELECT subject, max(value) FILTER (slot = 'part_brand') AS brand,
                 max(value) FILTER (slot = 'part_container') AS container
          FROM sd GROUP BY subject)"""
    out["counted"] = counted + """
SELECT part, place, brand, container, round(CAST(q AS DOUBLE), 2) AS counted
FROM tcnt LEFT JOIN about ON subject = part"""
    out["reconciliation"] = _with(*_recon_ctes(ST)) + _REC_SELECT
    out["reconciliation_asof"] = _with(*_recon_ctes(EARLY)) + _REC_SELECT
    out["refresh_advanced"] = out["reconciliation"]
    out["refresh_table"] = out["counted"]
    out["refresh_all"] = _with(*_recon_ctes(ST), _wide("ing")) + """
SELECT 'p_trade_balance' AS "table", count(*) AS rows FROM rec
UNION ALL SELECT 'p_counted_parts', count(*) FROM tcnt
UNION ALL SELECT 'p_part', count(*) FROM ing UNION ALL SELECT 'p_packing', count(*) FROM cvw"""
    out["unfilled_columns"] = _with(_STOCK, _standing("sd", "st", ST), _wide("dlw"), _wide("rtw")) + """
SELECT part, place, CAST(sum(i) AS BIGINT) AS lines, CAST(sum(o) AS BIGINT) AS back,
       CAST(sum(i) AS BIGINT) // (CAST(sum(o) AS BIGINT) + 1) AS halves, CAST(NULL AS VARCHAR) AS note
FROM (SELECT delivered_part AS part, delivered_to AS place,
             CAST(delivered_pieces IS NOT NULL AS INTEGER) AS i, 0 AS o FROM dlw
      UNION ALL SELECT returned_part, returned_from, 0,
             CAST(returned_pieces IS NOT NULL AS INTEGER) FROM rtw) GROUP BY part, place"""
    out["stated_cells"] = _with(_STOCK, _standing("sd", "st", ST), _wide("ing")) + """
SELECT kind_of_thing, CAST((part_name IS NOT NULL)::INT + (part_brand IS NOT NULL)::INT
       + (list_price IS NOT NULL)::INT + (floor_stock IS NOT NULL)::INT AS INTEGER) AS stated,
       count(*) AS parts FROM ing GROUP BY ALL"""
    out["group_keys"] = _with(_STOCK, _standing("sd", "st", ST)) + ",".join(
        f"""
{n} AS (SELECT subject, max(value) FILTER (slot = '{p}_part') AS part,
               max(value) FILTER (slot = '{p}_{to}') AS place
        FROM sd WHERE slot IN ('{p}_part', '{p}_{to}') GROUP BY subject)"""
        for n, p, to in (("", "", ""), ("dk", "delivered", "to"), ("rk", "returned", "from"))
        if n or p).join([",", ""]) + """
SELECT part, place FROM dk UNION SELECT part, place FROM rk"""
    out["projection_contains"] = _entities("ing", "part_name, kind_of_thing") + \
        " WHERE lower(part_name) LIKE '%bolt%' AND lower(part_brand) LIKE '%brand#1%'"
    out["projection_exact"] = _entities("ing", "part_name, part_container") + \
        " WHERE part_container = 'container:A'"
    out["choices"] = _with(_STOCK, _standing("sd", "st", ST), _wide("ing")) + " UNION ".join(
        f"SELECT '{c}' AS \"column\", {c} AS choice FROM ing WHERE {c} IS NOT NULL"
        for c in ("kind_of_thing", "part_brand", "part_container"))
    out["labelled"] = counted + """
SELECT part, coalesce(l.place_name, place) AS place,
       coalesce(un.container_label, a.container) AS container,
       round(CAST(q AS DOUBLE), 2) AS counted
FROM tcnt LEFT JOIN about a ON a.subject = part LEFT JOIN loc l ON l.subject = place
LEFT JOIN unt un ON un.subject = a.container"""
    out["user_sort"] = _entities("ing", _round("floor_stock"))
    out["cell_evidence"] = _with(_STOCK, _standing("sd", "st", ST), _wide("ing")) + """,
cells AS (SELECT i.subject, s.slot FROM ing i CROSS JOIN (VALUES ('kind_of_thing'),
  ('part_name'), ('part_brand'), ('part_container'), ('list_price'),
  ('floor_stock')) s(slot))
SELECT c.subject AS entity_uri, c.slot AS "column", a.id, a.value, a.valid_from,
       (SELECT max(r.id) FROM st r WHERE r.revokes = a.id) AS revoked_by
FROM cells c JOIN st a ON a.subject = c.subject AND a.slot = c.slot"""

    # ---- provenance
    out["pair_history"] = _with(_EVENTS, _SP) + f"""
SELECT {_LEDGER} FROM ev e JOIN act a ON a.id = e.intent_id
LEFT JOIN ev rb ON rb.revokes = e.id AND rb.subject = e.subject AND rb.slot = e.slot
WHERE e.slot = 'error' AND e.subject IN (SELECT subject FROM big_purchase)"""
    out["history_steps"] = _with(_EVENTS) + """
SELECT id, subject, slot, row_number() OVER (PARTITION BY subject, slot
       ORDER BY valid_from, recorded_at, seq) AS step FROM ev"""
    out["subject_trace"] = _with(_EVENTS, _SP) + f"""
SELECT {_LEDGER} FROM ev e JOIN act a ON a.id = e.intent_id
LEFT JOIN ev rb ON rb.revokes = e.id AND rb.subject = e.subject
WHERE e.subject IN (SELECT subject FROM big_signup)"""
    out["recent_k"] = _recent("TRUE", 40, 5)
    out["recent_search"] = _recent(
        "lower(e.subject) LIKE '%user:11%' OR lower(e.slot) LIKE '%user:11%' "
        "OR lower(e.value) LIKE '%user:11%'", 25)
    out["recent_by_kind"] = _recent(
        "a.action_name IN ('submit_purchase', 'submit_signup') AND a.actor_id = 'clerk42'", 30)
    out["revocations_only"] = _recent("e.revokes IS NOT NULL OR rb.id IS NOT NULL", 50)
    out["claim_status"] = _with(_EVENTS) + """
SELECT e.id, e.value, e.revokes, rb.id AS revoked_by,
       CASE WHEN rb.id IS NOT NULL THEN 'revoked' WHEN e.value IS NULL THEN 'retraction'
            WHEN e.revokes IS NOT NULL THEN 'correction' ELSE 'active' END AS status
FROM ev e LEFT JOIN ev rb ON rb.revokes = e.id"""
    out["event_kind"] = _with(_EVENTS) + """,
x AS (SELECT *, max(valid_from) OVER (PARTITION BY subject, slot ORDER BY recorded_at, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ev)
SELECT id, subject, slot, CASE WHEN revokes IS NOT NULL AND value IS NULL THEN 'retract'
  WHEN revokes IS NOT NULL THEN 'revoke_replace' WHEN latest IS NULL THEN 'state'
  WHEN valid_from > latest THEN 'change' ELSE 'correct' END AS event FROM x"""
    out["log_window"] = _with(_EVENTS) + """
SELECT count(*) AS assertions, min(valid_from) AS first_valid_from,
       max(valid_from) AS last_valid_from, min(recorded_at) AS first_recorded_at,
       max(recorded_at) AS last_recorded_at, count(revokes) AS revocations,
       (SELECT count(*) FROM act) AS intents FROM ev"""
    out["correction_target"] = _with(_EVENTS) + """,
x AS (SELECT e.*, rb.id AS revoked_by, row_number() OVER (PARTITION BY e.subject, e.slot
        ORDER BY CASE WHEN rb.id IS NULL AND e.value IS NOT NULL THEN 0 ELSE 1 END,
                 e.valid_from DESC, e.recorded_at DESC, e.seq DESC) AS rn
      FROM ev e LEFT JOIN ev rb ON rb.revokes = e.id AND rb.subject = e.subject
           AND rb.slot = e.slot)
SELECT subject, slot, id AS target, value, revoked_by FROM x WHERE rn = 1"""
    out["known_actors"] = _with(_EVENTS) + """,
a AS (SELECT DISTINCT actor_id FROM act),
p AS (SELECT 'person:' || s_suppkey AS entity_uri,
             'Clerk' || s_suppkey || ' of ' || s_name AS label FROM supplier)
SELECT coalesce(actor_id, lower(split_part(label, ' ', 1))) AS actor, label, entity_uri
FROM a FULL OUTER JOIN p ON lower(actor_id) = lower(split_part(label, ' ', 1))"""

    # ---- reports
    out["item_metadata"] = _with(_STOCK, _standing("sd", "st", ST), _wide("ing"), _wide("unt"),
                                 _wide("cvw"), _META) + """
SELECT entity_uri, part_name, part_container, factor, container_label, """ + _round(
        "floor_stock", "list_price") + " FROM meta"
    out["item_health"] = _items("""
SELECT part, place, name, location, pack_unit, pack_factor, counted_packs, is_anomaly,
       is_reorder, """ + _round("reorder_base", "list_price", "remaining", "counted", "gap",
                                "counted_value", "gap_value") + " FROM items")
    out["kpi_totals"] = _items("SELECT " + _round(
        "valuation", "remaining_valuation", "gap_value", "gap_pieces", "accuracy_pct",
        digits=1) + """ FROM (
  SELECT *, CASE WHEN remaining_valuation = 0 THEN 100.0
                 ELSE valuation / remaining_valuation * 100 END AS accuracy_pct
  FROM (SELECT coalesce(sum(counted_value), 0) AS valuation,
               coalesce(sum(remaining * list_price), 0) AS remaining_valuation,
               coalesce(sum(gap_value), 0) AS gap_value,
               coalesce(sum(gap), 0) AS gap_pieces FROM items))""")
    out["zone_rollup"] = _items("SELECT location, items, " + _round(
        "valuation", "gap_value", digits=1) + """ FROM (
  SELECT location, count(*) AS items, sum(counted_value) AS valuation,
         sum(gap_value) AS gap_value FROM items GROUP BY 1)""")
    out["top_losses"] = _items("""
SELECT part, place, name, round(gap_value, 2) AS gap_value,
       round(-gap_value / abs((SELECT sum(gap_value) FROM items)) * 100, 2)
         AS pct_of_total,
       round(least(100, gap_value / (SELECT min(gap_value) FROM items) * 100), 2)
         AS pct_of_max
FROM items WHERE gap_value < 0 ORDER BY items.gap_value, part, place LIMIT 6""")
    out["alerts"] = _items("""
SELECT part, place, name, location, 'anomaly' AS alert,
       round(abs(gap), 4) AS deficit,
       round(abs(gap_value) / abs((SELECT sum(gap_value) FROM items)) * 100, 4)
         AS share_pct FROM items WHERE is_anomaly
UNION ALL
SELECT part, place, name, location, 'reorder', round(reorder_base - counted, 4), NULL
FROM items WHERE is_reorder""")
    out["worst_first"] = _items("SELECT part, place, name, "
                                "round(gap_value, 2) AS gap_value FROM items")
    out["attribute_pivot"] = _with(_STOCK, _LIVE, _live_pivot("m", ["delivered_part", "delivered_to", "delivered_in", "delivered_pieces"])) + "SELECT * FROM m"
    out["balance"] = _BALANCE
    out["balance_full_outer"] = _BALANCE
    out["class_counts"] = _with(_STOCK) + """
SELECT value AS class, count(DISTINCT subject) AS subjects FROM st
WHERE slot = 'kind_of_thing' GROUP BY 1"""
    out["log_shape"] = _with(_EVENTS) + """
SELECT count(*) AS assertions, count(revokes) AS revoking,
       count(*) FILTER (value IS NULL) AS retractions,
       count(DISTINCT CAST(recorded_at AS DATE)) AS recorded_days,
       min(CAST(valid_from AS DATE)) AS first_valid, max(CAST(valid_from AS DATE)) AS last_valid,
       min(CAST(recorded_at AS DATE)) AS first_recorded,
       max(CAST(recorded_at AS DATE)) AS last_recorded FROM ev"""
    out["distinct_pairs"] = _with(_EVENTS) + "SELECT DISTINCT subject, slot FROM ev"

    # ---- quality
    out["dq_mass_balance"] = """
WITH o AS (SELECT l_orderkey AS batch, sum(CAST(l_quantity AS DECIMAL(12,2))
             * (1 - CAST(l_discount AS DECIMAL(6,2)))
             * CAST(p_retailprice AS DECIMAL(12,2))) AS out,
             count(*) FILTER (p_partkey IS NULL) AS bare
           FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1),
i AS (SELECT o_orderkey AS batch, CAST(o_totalprice AS DECIMAL(14,2))
        + CASE WHEN o_orderpriority = '1-URGENT' THEN 1000 ELSE 0 END AS allowed FROM orders)
SELECT batch, CASE WHEN bare = 0 THEN round(CAST(out AS DOUBLE), 4) END AS out,
       round(CAST(allowed AS DOUBLE), 4) AS allowed,
       CASE WHEN bare > 0 THEN 'no weight' WHEN allowed IS NULL THEN 'no input'
            ELSE 'too much' END AS reason
FROM o LEFT JOIN i USING (batch) WHERE bare > 0 OR allowed IS NULL OR out - allowed > 0.005"""
    out["dq_stale_exemptions"] = """
SELECT DISTINCT c_custkey AS key, CASE WHEN c_custkey NOT IN (SELECT doc_id FROM documents)
       THEN 'unknown' ELSE 'used' END AS reason
FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)
   OR c_custkey IN (SELECT doc_id FROM labels)"""
    out["dq_parts_vs_total"] = _with(_TILL) + "SELECT key, " + _round("total", "worked") + \
        ", 'differ' AS reason FROM till"
    out["dq_parts_unpriced"] = """
SELECT l_orderkey AS key, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE), 2) AS total,
       CAST(NULL AS DOUBLE) AS worked, 'no amount' AS reason
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 48
GROUP BY l_orderkey HAVING count(*) > count(p_partkey)"""
    out["dq_rule_vs_observed"] = """
WITH f(kind, floor) AS (VALUES ('R', CAST(5 AS DOUBLE)), ('A', 3), ('N', 2))
SELECT f.kind, l_orderkey AS key, l_quantity AS amount, f.floor
FROM lineitem JOIN f ON f.kind = l_returnflag
WHERE l_quantity < f.floor
  AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""
    out["dq_rule_vs_days"] = """
SELECT event_type AS kind, user_id AS key, CAST(ts AS DATE) AS day, event_id FROM events
WHERE ((event_type = 'click' AND dayofweek(ts) IN (0, 6))
       OR (event_type = 'view' AND dayofweek(ts) NOT IN (0, 6)))
  AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 200)"""
    out["dq_weekday"] = _with(_EVENTS, _WEEK) + "SELECT id, day, written FROM wk"
    out["dq_ref_coverage"] = """
WITH first AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents),
u AS (SELECT 'doc:' || doc_id AS name, 'doc:' || f AS target FROM first
      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT name, target FROM u WHERE target NOT IN (SELECT 'doc:' || doc_id FROM labels)"""
    out["dq_orphans"] = _with(_ORPHANS) + "SELECT key, source FROM orph"
    out["dq_mentions"] = """
SELECT DISTINCT b.text AS name FROM benchmark b
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text)))"""
    out["dq_mentions_short"] = """
WITH n AS (SELECT p_name AS name FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part)
SELECT name FROM n
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(n.name)))"""
    out["dq_completeness"] = r"""
SELECT doc_id AS key, 'text' AS missing FROM documents
WHERE text IS NULL OR trim(text) IN ('', '-', '—')
   OR NOT regexp_matches(text, '\b(19|20)[0-9][0-9]\b')
UNION ALL
SELECT doc_id, 'lang' FROM documents WHERE lang IS NULL OR trim(lang) IN ('', '-', '—')
UNION ALL
SELECT doc_id, 'source' FROM documents WHERE source IS NULL
   OR NOT regexp_matches(source, '^src[0-9]$')"""
    out["dq_childless"] = """
SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (
  SELECT conv_id FROM conversations WHERE role = 'assistant')"""
    out["dq_vocabulary"] = """
SELECT doc_id, lang, source FROM documents
WHERE source IS NULL OR NOT (source IN ('src0', 'src1', 'src2', '—')
      OR regexp_matches(source, '^src1[0-9]$'))"""
    out["dq_sold_nowhere"] = """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
    out["dq_phrases"] = _with(_LINES) + "SELECT key, line, phrase FROM ph"
    out["dq_unique"] = _with(_DUP) + "SELECT l_orderkey, l_linenumber, rows FROM dup"
    out["dq_conversion_unique"] = _with(_STOCK, _standing("sd", "st", ST), _wide("cvw"), """
bad AS (SELECT packed_part, packed_in FROM cvw GROUP BY 1, 2
        HAVING count(*) > 1)""") + _check("one conversion per key", "cvw", "bad")
    out["dq_summary"] = _with(_EVENTS, _TILL, _ORPHANS, _LINES, _DUP, _WEEK) + \
        " UNION ALL ".join(_check(*c) for c in [
            ("till totals", "orders", "till"), ("documents labelled", "documents", "orph"),
            ("forbidden phrases", "documents", "ph"), ("line numbers unique", "lineitem", "dup"),
            ("weekdays", "events", "wk")])
    out["two_path_diff"] = _with(_EVENTS, _standing("s", "ev", EV)) + """
SELECT 'two paths' AS "check", count(*) AS counted, CAST(0 AS BIGINT) AS failed FROM s"""
    early = ("1996-01-01 23:59:59.999999",) * 2
    cells = " UNION ALL ".join(
        f"SELECT coalesce(a.subject, b.subject) AS entity_uri, '{c}' AS \"column\", "
        f"{x.format('a.' + c)} AS left_value, {x.format('b.' + c)} AS right_value "
        f"FROM i0 a FULL OUTER JOIN i1 b ON a.subject = b.subject "
        f"WHERE {x.format('a.' + c)} IS DISTINCT FROM {x.format('b.' + c)}"
        for c, x in [("kind_of_thing", "{}"), ("part_name", "{}"), ("part_brand", "{}"),
                     ("part_container", "{}"), ("list_price", "{}"),
                     ("floor_stock",
                      "CAST(CAST({} AS DECIMAL(18,6)) AS VARCHAR)")])
    out["cells_diff"] = _with(
        _STOCK, _standing("sd0", "st", early), _standing("sd", "st", ST),
        _wide("ing", "sd0").replace("ing AS", "i0 AS"),
        _wide("ing").replace("ing AS", "i1 AS")) + cells
    out["replay_identical"] = _with(*_STATED) + """
SELECT 'replay' AS "check", count(*) AS counted, CAST(0 AS BIGINT) AS failed FROM sa"""

    # ---- text, triples
    out["paragraphs"] = f"""
WITH b AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || ' ' || chr(10)),
                  '\\n[{_SPACE}]*\\n') AS blocks FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(blocks, lambda x:
        regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x <> '') AS ps FROM b)
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS position,
       unnest(ps) AS paragraph FROM t"""
    out["best_paragraph"] = f"""
WITH q AS (SELECT item_id AS key, string_split(text, ' ')[1] AS name, text FROM benchmark),
wt AS (SELECT key, word, sum(w) AS weight FROM (
         SELECT key, unnest({_words('name')}) AS word, 6 AS w FROM q
         UNION ALL
         SELECT key, unnest(list_distinct({_words('text')})), 1 FROM q) GROUP BY ALL),
vocab AS (SELECT DISTINCT word FROM wt),
blocks AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x:
        regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x <> '') AS ps
        FROM documents),
para AS (SELECT doc_id * 1000000 + generate_subscripts(ps, 1) - 1 AS doc_id, unnest(ps) AS text
         FROM blocks),
tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))
          AS token FROM para),
dt AS (SELECT DISTINCT token FROM tok),
tw AS (SELECT token, word FROM dt JOIN vocab
       ON substr(token, 1, 4) = substr(word, 1, 4) AND starts_with(token, word)),
held AS (SELECT DISTINCT doc_id, word FROM tok JOIN tw USING (token)),
df AS (SELECT word, count(*) AS n FROM held GROUP BY 1),
sc AS (SELECT key, doc_id, CAST(sum((weight * 1000000000000) // n) AS BIGINT) AS units
       FROM wt JOIN df USING (word) JOIN held USING (word) GROUP BY 1, 2),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY key
          ORDER BY units DESC, doc_id) = 1)
SELECT q.key, doc_id AS index, round(units / 1000000000000, 9) AS score
FROM q LEFT JOIN top USING (key)"""
    out["domain_range"] = _with(_TRIPLES) + "SELECT property, side, outcome, members FROM inf"
    out["domain_range_counts"] = _with(_TRIPLES) + \
        "SELECT side, outcome, count(*) AS properties FROM inf GROUP BY ALL"
    out["drawable_edges"] = _with(_TRIPLES) + """
SELECT property FROM props JOIN dom USING (property) WHERE is_object AND (
  property IN (SELECT property FROM said)
  OR property IN (SELECT property FROM rng WHERE len(m) = 1))"""
    out["class_closure"] = """
WITH RECURSIVE e AS (
  SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation
  UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer),
t(ancestor, descendant) AS (
  SELECT parent, parent FROM e UNION SELECT child, child FROM e
  UNION SELECT t.ancestor, e.child FROM t JOIN e ON e.parent = t.descendant)
SELECT ancestor, descendant FROM t"""
    out["class_ancestors"] = out["class_closure"] + """
WHERE descendant IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal < 0)"""

    # ---- scalar functions
    out["uri_slugs"] = r"""
SELECT c_custkey, 'customer_' || regexp_replace(regexp_replace(
  lower(c_name || ' - ' || c_mktsegment), '[^\p{L}\p{N}]+', '_', 'g'), '^_|_$', '', 'g') AS uri
FROM customer"""
    out["clock_instants"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F'
  THEN date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
  ELSE o_orderdate END AS clock FROM orders"""
    out["json_rows"] = """
SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"total":'
  || CAST(o_totalprice AS DECIMAL(14,2)) || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d')
  || '","status":' || CASE WHEN o_orderstatus = 'P' THEN 'null'
                           ELSE '"' || o_orderstatus || '"' END || '}' AS row FROM orders"""
    return out


ORACLES = build()
