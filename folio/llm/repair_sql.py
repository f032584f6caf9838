"""The repair of conversations in SQL: costs and edits as texts that sort by cost, then by edits, from
the last turn to the first."""

from __future__ import annotations

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 of a short ASCII text k, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _plus(state: str, cost: str, letters: str) -> str:
    return f"lpad((left({state}, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letters}' || substr({state}, 10)"


def _row(state: int, keep: dict[str, int], to: int) -> str:
    """The least of what may be done with a turn in a state: delete, keep (by role), rerole."""
    kept = " ".join(f"WHEN x = '{role}' THEN {_plus(f'c{q}', 't', 'K')}" for role, q in keep.items())
    return f"least({_plus(f'c{state}', '3', 'D')}, CASE WHEN gone THEN NULL {kept} END, CASE WHEN NOT gone THEN {_plus(f'c{to}', '2 + t', 'R')} END) AS r{state}"


_ROWS = ", ".join([_row(0, {"s": 1, "u": 2}, 2), _row(1, {"u": 2}, 2), _row(2, {"a": 3}, 3), _row(3, {"u": 2}, 2)])
_TWO, _THREE = _plus("r2", "2", "I"), _plus("r3", "2", "I")
_FIRST = ", ".join(f"least(r{q}, {_TWO}, {_plus('r3', '4', 'II')})" for q in (0, 1))

SQL = f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 h AS (SELECT *, {_CRC} % 20 AS how FROM d),
 m AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
 r AS (SELECT *, left(role, 1) AS x, trim(text, {_WHITE}) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM m),
 f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM r),
 s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
 dp AS (SELECT conv_id, n + 1 AS i, '000000000' AS c0, '000000004II' AS c1, '000000002I' AS c2, '000000000' AS c3 FROM s
 UNION ALL SELECT conv_id, i, {_FIRST}, least(r2, {_THREE}), least(r3, {_TWO})
 FROM (SELECT conv_id, i, {_ROWS} FROM (SELECT dp.*  EXCLUDE (i), f.i, f.x, f.fault IN (1, 2) AS gone, CASE f.fault WHEN 3 THEN 1 ELSE 0 END AS t FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i - 1))),
 a AS (SELECT conv_id, left(c0, 9)::BIGINT AS cost, substr(c0, 10) AS audit FROM dp WHERE i = 1),
 l AS (SELECT conv_id, j, audit[j] AS e, length(replace(left(audit, j), 'I', '')) AS i FROM a, unnest(range(1, length(audit) + 1)) AS u(j)),
 o AS (SELECT l.conv_id, l.e, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY j) - 1 AS place, first_value(l.e = 'K' AND f.x = 's') OVER (PARTITION BY l.conv_id ORDER BY j) AS led FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE l.e <> 'D'),
 t AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place % 2 = 1) = led THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS h FROM o GROUP BY conv_id)
 SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""
