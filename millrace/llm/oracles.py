"""SQL of the operators whose statements are put together from parameters."""

from __future__ import annotations

from millrace.llm.merkle import FANOUT, FIELDS
from millrace.llm.winnowing import BASES, GRAM, PRIME, WINDOW


def _doubled(base: int, start: str, out: str) -> list[str]:
    """Steps that take hashes of one code to hashes of ``GRAM`` codes (a power of two)."""
    steps, size, value = [], 1, start
    while size < GRAM:
        factor = pow(base, size, PRIME)
        name = f"{out}{2 * size}"
        steps.append(f"({value} + {factor} * lead({value}, {size}, 0) OVER w) % {PRIME} AS {name}")
        size, value = 2 * size, name
    return steps


def winnowing_sql() -> str:
    first, second = _doubled(BASES[0], "code", "x"), _doubled(BASES[1], "code", "y")
    steps, source = [], "codes"
    for k, (x, y) in enumerate(zip(first, second)):
        steps.append(f"g{k} AS (SELECT *, {x}, {y} FROM {source} WINDOW w AS (PARTITION BY doc_id, kind ORDER BY j))")
        source = f"g{k}"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n_chars FROM documents
), n AS (
  SELECT *, coalesce(lead(body) OVER w, first_value(body) OVER w) AS follower,
    coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM t WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT *, left(body, n_chars - n_chars // 2) || left(follower, n_chars // 2) AS changed FROM n
), pair AS (
  SELECT doc_id, 0 AS kind, body FROM e UNION ALL SELECT doc_id, 1, changed FROM e
), chars AS (
  SELECT doc_id, kind, unnest(range(length(body))) AS i, unnest(string_split(body, '')) AS c FROM pair WHERE body <> ''
), codes AS (
  SELECT doc_id, kind, i, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) - 1 AS j,
    count(*) OVER (PARTITION BY doc_id, kind) AS m,
    CAST(unicode(CASE WHEN c BETWEEN 'A' AND 'Z' THEN lower(c) ELSE c END) + 1 AS BIGINT) AS code
  FROM chars WHERE unicode(c) <> 32 AND unicode(c) NOT BETWEEN 9 AND 13
), {", ".join(steps)}, grams AS (
  SELECT doc_id, kind, i, j, x{GRAM} * {PRIME + 1} + y{GRAM} AS v, x{GRAM} * {PRIME + 1} + {PRIME} - j AS rank,
    greatest(m - {GRAM}, 0) + 1 AS n
  FROM {source} WHERE j <= greatest(m - {GRAM}, 0)
), least AS (
  SELECT doc_id, kind, j, n, min(rank) OVER (PARTITION BY doc_id, kind ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS r FROM grams
), chosen AS (
  SELECT DISTINCT doc_id, kind, {PRIME} - r % {PRIME + 1} AS j FROM least WHERE j <= greatest(n - {WINDOW}, 0)
), f AS (
  SELECT doc_id, kind, string_agg(format('{{:08x}}{{:016x}}', i, v), ',' ORDER BY j) AS f, list(DISTINCT v) AS vs
  FROM chosen JOIN grams USING (doc_id, kind, j) GROUP BY ALL
), own AS (SELECT * FROM f WHERE kind = 0), edit AS (SELECT * FROM f WHERE kind = 1), p AS (
  SELECT e.doc_id, n_chars, sha256(changed) AS edited_sha256, coalesce(own.f, '') AS fingerprint, coalesce(edit.f, '') AS edited_fingerprint,
    coalesce(own.vs, []) AS a, coalesce(edit.vs, []) AS b, coalesce(nxt.vs, []) AS c
  FROM e LEFT JOIN own ON own.doc_id = e.doc_id LEFT JOIN edit ON edit.doc_id = e.doc_id LEFT JOIN own AS nxt ON nxt.doc_id = next_id
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c)) / len(list_distinct(a || c)) END AS near_next
FROM p
"""


def _leaf_sql(text: str) -> str:
    parts = []
    for field in FIELDS:
        value = text if field == "text" else f"CAST({field} AS VARCHAR)"
        parts.append(f"coalesce(strlen({value}) || ':' || {value}, '-')")
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, source: str, levels: int) -> str:
    """Tables ``{name}0`` … of nodes with what stands beside them in their run; trees are told apart by ``tree``."""
    beside = f"""string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
      string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
    FROM nodes WINDOW w AS (PARTITION BY tree, i // {FANOUT} ORDER BY i)"""
    tables = []
    for k in range(levels):
        nodes = f"SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM {source}" if k == 0 else f"""
      SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (
        SELECT tree, CASE WHEN n > 1 THEN i // {FANOUT} ELSE i END AS i,
          CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY {name}{k - 1}.i)) ELSE any_value(h) END AS h
        FROM {name}{k - 1} GROUP BY tree, CASE WHEN n > 1 THEN i // {FANOUT} ELSE i END)"""
        tables.append(f"{name}{k} AS (WITH nodes AS ({nodes}) SELECT tree, i, h, n, {beside})")
    return ", ".join(tables)


def _folds(name: str, levels: int, node: str) -> tuple[str, str]:
    """The root that ``node`` leads to, and all siblings, for rows joined with every level as ``{name}0`` …"""
    fold, proof = node, []
    for k in range(levels):
        t = f"{name}{k}"
        fold = f"CASE WHEN {t}.n > 1 THEN sha256(coalesce({t}.l, '') || {fold} || coalesce({t}.r, '')) ELSE {fold} END"
        proof.append(f"coalesce({t}.l, '') || coalesce({t}.r, '')")
    return fold, " || ".join(proof)


def merkle_sql(levels: int = 5, source_levels: int = 4) -> str:
    """Enough levels for 16^4 rows a source and 16^3 sources; the last level of either only holds roots."""
    leaf_join = "\n  ".join(f"JOIN a{k} ON a{k}.tree = s.tree AND a{k}.i = s.i // {FANOUT ** k}" for k in range(levels))
    top_join = "\n  ".join(f"JOIN b{k} ON b{k}.tree = 0 AND b{k}.i = u.i // {FANOUT ** k}" for k in range(source_levels))
    # each level is its own step, so that the statement does not double with every level
    low = ", ".join(f"a{k}.n AS an{k}, coalesce(a{k}.l, '') AS al{k}, coalesce(a{k}.r, '') AS ar{k}" for k in range(levels))
    high = ", ".join(f"b{k}.n AS bn{k}, coalesce(b{k}.l, '') AS bl{k}, coalesce(b{k}.r, '') AS br{k}" for k in range(source_levels))
    names = [f"{t}{{}}{k}" for t, count in (("a", levels), ("b", source_levels)) for k in range(count)]
    folds, source = [], "joined"
    for step, n in enumerate(names):
        folds.append(f"f{step} AS (SELECT * EXCLUDE (fold), CASE WHEN {n.format('n')} > 1 "
                     f"THEN sha256({n.format('l')} || fold || {n.format('r')}) ELSE fold END AS fold FROM {source})")
        source = f"f{step}"
    proof = " || ".join(f"{n.format('l')} || {n.format('r')}" for n in names)
    return f"""
WITH crcs AS (
  SELECT list(c ORDER BY b) AS crc_table FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) AS r(b))
), t AS (
  SELECT *, coalesce('s' || source, '') AS tree, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))) % 5 = 0 AS touched,
    {_leaf_sql("text")} AS h,
    {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed
  FROM documents, crcs
), s AS (
  SELECT doc_id, source, tree, h, CASE WHEN touched THEN changed ELSE h END AS seen,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM t
), {_tree_sql("a", "s", levels)}, u AS (
  SELECT tree AS source_tree, h, 0 AS tree, row_number() OVER (ORDER BY CAST(encode(tree) AS BLOB)) - 1 AS i FROM a{levels - 1}
), {_tree_sql("b", "u", source_levels)}, joined AS (
  SELECT s.doc_id, s.h AS leaf, s.seen AS fold, u.h AS subroot, b{source_levels - 1}.h AS root, {low}, {high}
  FROM s
  {leaf_join}
  JOIN u ON u.source_tree = s.tree
  {top_join}
), {", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {source}
"""
