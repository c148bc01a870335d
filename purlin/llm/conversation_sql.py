"""SQL of crc32, and of the conversation repair: the lattice solved row by row in a recursive query."""

from __future__ import annotations

# the table of crc32 by the polynomial's rule
CRC_TABLE = """crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([n]::BIGINT[] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)))"""


def crc32(text: str, latin: bool = False) -> str:
    """crc32 of an ASCII expression (``latin``: of letters below U+0100 too), over rows that are joined with ``crc``."""
    code = "CAST(ord(x) AS BIGINT)"
    codes = f"list_transform(string_split({text}, ''), lambda x: {code})"
    if latin:  # two bytes in UTF-8
        codes = f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [{code}] ELSE [192 + ({code} >> 6), 128 + ({code} & 63)] END))"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _then(state: str, cost: str, edit: str, line: str | None = None) -> str:
    lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {lines}}}"


def _inserted(prefix: str, b: list[str]) -> str:
    """Columns n2 and n3: the states after insertions."""
    two = _least(b[2], *[_then(b[s], "3", "I", "'user:'") for s in (0, 1, 3)])
    return f"SELECT *, {_least(b[3], _then('n2', '3', 'I', repr('assistant:')))} AS n3 FROM (SELECT *, {two} AS n2 FROM {prefix})"


def repair_sql() -> str:
    kept = "role || ':' || text"
    steps = {
        "b0": _then("b0", "4", "D"),
        "b1": _least(_then("b1", "4", "D"), _then("b0", "extra + if(l = 's', 0, far)", "K", kept)),
        "b2": _least(
            _then("n2", "4", "D"),
            *[_then(s, "extra + if(l = 'u', 0, far)", "K", kept) for s in ("b0", "b1", "n3")],
            *[_then(s, "extra + 3", "R", "'user:' || text") for s in ("b0", "b1", "n3")],
        ),
        "b3": _least(_then("n3", "4", "D"), _then("n2", "extra + if(l = 'a', 0, far)", "K", kept), _then("n2", "extra + 3", "R", "'assistant:' || text")),
    }
    start, none = "{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}", "{'c': far, 'a': '', 't': CAST([] AS VARCHAR[])}"
    return rf"""
    WITH RECURSIVE {CRC_TABLE},
    dealt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, crc),
    harmed AS (SELECT conv_id, turn, if(f = 4, 'user', role) AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM dealt, range(2) copies(k) WHERE f <> 0 AND (k = 0 OR f = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS l FROM harmed),
    judged AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, lag(l) OVER (PARTITION BY conv_id ORDER BY i) || l AS pair, CAST(1000000000 AS BIGINT) AS far FROM placed),
    faults AS (SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, if(blank OR duplicate, far, 0) + 3 * CAST(NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS BIGINT) AS extra FROM judged),
    lattice AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS i, {start} AS b0, {none} AS b1, {none} AS b2, {none} AS b3 FROM (SELECT DISTINCT conv_id, far FROM faults)
      UNION ALL
      SELECT conv_id, i, {steps["b0"]}, {steps["b1"]}, {steps["b2"]}, {steps["b3"]} FROM ({_inserted("(SELECT p.conv_id, f.i, b0, b1, b2, b3, f.l, f.role, f.text, f.extra, f.far FROM lattice p JOIN faults f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1)", ["b0", "b1", "b2", "b3"])})
    ),
    counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
    solved AS (SELECT conv_id, i, {_least("b0", "n3")} AS best FROM ({_inserted("lattice", ["b0", "b1", "b2", "b3"])}))
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e
    LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN solved s ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.n
    """
